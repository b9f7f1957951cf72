"""Extension points: filters by Python functions, and scripts kept as metadata."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Events that a questionnaire script may hang on.
TRIGGERS = ("onInit", "onPageEnter", "onPageExit", "onQuestionShow", "onAnswer", "onSubmit", "onRandomize")


@dataclass(frozen=True)
class FilterRule:
    """Rows for which a Python function of the answers (a dict) is true.

    The slow path: rows go to Python in Arrow batches and are judged one by one, and nothing can be pushed down. Use an
    expression where one can say the same. A null answer is None.
    """

    predicate: Callable[[dict], bool]
    description: str = ""

    def apply(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        names, predicate = columns or df.columns, self.predicate

        @F.pandas_udf("boolean")
        def judged(rows: pd.DataFrame) -> pd.Series:
            plain = rows.astype(object).where(rows.notna(), None)
            return pd.Series([bool(predicate(dict(zip(names, r, strict=True)))) for r in plain.itertuples(index=False, name=None)], dtype=bool)

        return df.filter(judged(F.struct(*[F.col(f"`{c}`") for c in names])))


@dataclass(frozen=True)
class Script:
    """Front-end code that belongs to a questionnaire; it is stored and never run here."""

    trigger: str
    code: str
    target: str | None = None

    def __post_init__(self):
        if self.trigger not in TRIGGERS:
            raise ValueError(f"trigger is one of {', '.join(TRIGGERS)}")
