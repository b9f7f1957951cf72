"""Survey datasets: an immutable DataFrame with its variable registry, and the transforms on it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import mapped, number, quoted, without_codes
from tallyframe.functions.expressions import Expression, derived_column
from tallyframe.operators.variables import Variable, VariableMap


def _text(x) -> str:
    return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)


def bin_column(column: Column, edges: Sequence[float], right: bool = False) -> Column:
    """Codes 1..k of ordered bins: [a, b), or (a, b] with the lowest edge in the first bin."""
    out = None
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if right:
            inside = ((column > a) if i else (column >= a)) & (column <= b)
        else:
            inside = (column >= a) & (column < b)
        out = F.when(inside, F.lit(i + 1)) if out is None else out.when(inside, F.lit(i + 1))
    return out.cast("long")


@dataclass(frozen=True)
class SurveyData:
    """Responses with metadata. Every transform returns a new object and stays lazy."""

    frame: DataFrame
    variables: VariableMap = field(default_factory=VariableMap)
    questionnaire: Any = None
    weight: str | None = None

    def __post_init__(self):
        if not isinstance(self.variables, VariableMap):
            object.__setattr__(self, "variables", VariableMap(self.variables))

    @cached_property
    def analysis(self):
        from tallyframe.operators.statistics import DataAnalysis

        return DataAnalysis(self)

    @cached_property
    def tables(self):
        from tallyframe.operators.banner import BannerTables

        return BannerTables(self)

    @cached_property
    def report(self):
        from tallyframe.operators.tables import ReportAccessor

        return ReportAccessor(self)

    @cached_property
    def plot(self):
        from tallyframe.operators.charts import PlotAccessor

        return PlotAccessor(self)

    def with_frame(self, frame: DataFrame) -> SurveyData:
        return replace(self, frame=frame)

    def with_weight(self, column: str) -> SurveyData:
        self._need(column)
        return replace(self, weight=column)

    def _need(self, *columns: str) -> None:
        if absent := [c for c in columns if c not in self.frame.columns]:
            raise KeyError(f"no column {', '.join(absent)}")

    def labels_of(self, column: str) -> dict:
        return dict(self.variables[column].labels) if column in self.variables else {}

    def label_of(self, column: str) -> str:
        return (self.variables[column].label or column) if column in self.variables else column

    def scale_of(self, column: str) -> str | None:
        return self.variables[column].scale if column in self.variables else None

    def type_of(self, column: str) -> T.DataType:
        return self.frame.schema[column].dataType

    def drop_missing(self, column: str) -> SurveyData:
        self._need(column)
        return self.with_frame(self.frame.filter(quoted(column).isNotNull()))

    def apply_missing_values(self, kinds: Sequence[str] | None = None) -> SurveyData:
        """Coded missing values, of the given kinds or all, as null; one projection for all columns."""
        codes = {n: [m.code for m in v.missing if kinds is None or m.kind in kinds] for n, v in self.variables.items()}
        columns = [without_codes(quoted(c), codes.get(c, ())).alias(c) for c in self.frame.columns]
        return self.with_frame(self.frame.select(columns))

    def _derived(self, name: str, column: Column, variable: Variable) -> SurveyData:
        return replace(self, frame=self.frame.withColumn(name, column), variables=self.variables.replaced(variable))

    def recode(self, column: str, *, into: str, bins: Sequence[float], labels: Sequence[str] | None = None, right: bool = False, label: str | None = None) -> SurveyData:
        """Ordered bins of a numeric column as codes 1..k; values outside all bins become null."""
        self._need(column)
        k = len(bins) - 1
        if k < 1 or any(a >= b for a, b in zip(bins[:-1], bins[1:], strict=True)):
            raise ValueError("bins need two ascending edges or more")
        if labels is not None and len(labels) != k:
            raise ValueError(f"{k} bins need {k} labels")
        names = labels or [f"{_text(a)}-{_text(b)}" for a, b in zip(bins[:-1], bins[1:], strict=True)]
        variable = Variable(into, "ordinal", label or into, dict(enumerate(names, 1)), role="derived", dtype="int")
        return self._derived(into, bin_column(number(quoted(column), self.type_of(column)), bins, right), variable)

    def recode_values(self, column: str, mapping: dict, *, into: str | None = None, label: str | None = None, scale: str | None = None) -> SurveyData:
        """Values by a mapping; values that it does not name become null. The source column stays."""
        self._need(column)
        into = into or f"{column}_recoded"
        known = self.variables.get(column)
        variable = Variable(into, scale or (known.scale if known else None) or "nominal", label or into, role="derived")
        return self._derived(into, mapped(quoted(column), mapping), variable)

    def derive(self, *, name: str, expression: Expression, label: str | None = None, scale: str = "nominal", labels: dict | None = None) -> SurveyData:
        """A 0/1 column from a predicate, in the derivation reading of missing answers."""
        expression.validate(self.frame.columns)
        variable = Variable(name, scale, label or name, labels or {0: "No", 1: "Yes"}, role="derived", dtype="int")
        return self._derived(name, derived_column(expression).cast("int"), variable)

    def numeric_items(self, items: Sequence[str]) -> list[Column]:
        """Items as doubles, with coded missing values and text that is no number as null."""
        self._need(*items)
        codes = {c: self.variables[c].missing_values if c in self.variables else () for c in items}
        return [number(without_codes(quoted(c), codes[c]), self.type_of(c)) for c in items]

    def create_index(self, name: str, *, items: Sequence[str], method: str = "mean", label: str | None = None) -> SurveyData:
        """Mean of the items that are there; null if none is."""
        if method != "mean":
            raise ValueError("the only method of an index is mean")
        if not items:
            raise ValueError("an index needs items")
        columns = self.numeric_items(items)
        total, count = F.lit(0.0), F.lit(0)
        for c in columns:
            total, count = total + F.coalesce(c, F.lit(0.0)), count + c.isNotNull().cast("int")
        variable = Variable(name, "interval", label or name, role="derived", dtype="float")
        return self._derived(name, F.when(count > 0, total / count), variable)

    def scale_alpha(self, items: Sequence[str]) -> float:
        """Cronbach's alpha over complete rows; 0.0 for no rows or no variance, NaN for one row."""
        if len(items) < 2:
            raise ValueError("alpha needs two items or more")
        names = [f"i{k}" for k in range(len(items))]
        rows = self.frame.select([c.alias(n) for c, n in zip(self.numeric_items(items), names, strict=True)]).dropna()
        total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
        got = rows.agg(F.count("*").alias("n"), F.var_samp(total).alias("t"), *[F.var_samp(n).alias(n) for n in names]).first()
        if got["n"] == 0 or (got["t"] is not None and got["t"] <= 0):
            return 0.0
        if got["n"] == 1:
            return float("nan")
        k = len(items)
        return k / (k - 1) * (1 - sum(got[n] for n in names) / got["t"])

    def codebook(self) -> DataFrame:
        """A row per variable."""
        schema = "name string, label string, scale string, dtype string, role string, labels string, missing string, valid_range string, construct string, description string"
        rows = [
            (
                v.name, v.label, v.scale, v.dtype, v.role, "; ".join(f"{k}={x}" for k, x in v.labels.items()),
                "; ".join(f"{m.code}={m.label} ({m.kind})" for m in v.missing), None if v.valid_range is None else f"{v.valid_range[0]}..{v.valid_range[1]}",
                v.construct, v.description,
            )
            for v in self.variables.values()
        ]
        return self.frame.sparkSession.createDataFrame(rows, schema)

    def describe_variables(self) -> DataFrame:
        """name, label, scale, n, n_missing, n_unique of every variable, from one aggregation."""
        names = list(self.variables)
        there = [n for n in names if n in self.frame.columns]
        counts = [F.struct(F.count(quoted(n)).alias("n"), F.count_if(quoted(n).isNull()).alias("n_missing"), F.count_distinct(quoted(n)).alias("n_unique")).alias(f"v{i}") for i, n in enumerate(there)]
        zero = F.struct(*[F.lit(0).cast("long").alias(k) for k in ("n", "n_missing", "n_unique")])
        wide = self.frame.agg(*counts) if counts else self.frame.sparkSession.range(1)
        rows = F.array(
            *[
                F.struct(F.lit(n).alias("name"), F.lit(self.label_of(n)).alias("label"), F.lit(self.scale_of(n)).alias("scale"), (F.col(f"v{there.index(n)}") if n in there else zero).alias("c"))
                for n in names
            ]
        )
        return wide.select(F.inline(rows)).select("name", "label", "scale", "c.n", "c.n_missing", "c.n_unique")

    def validate(self, raise_on_error: bool = False):
        from tallyframe.operators.validation import validate_data

        return validate_data(self, raise_on_error)

    def export(self, kind: str, path: str) -> str:
        from tallyframe.sources.files import export

        return export(self, kind, path)

    def export_dictionary(self, path: str) -> str:
        from tallyframe.sources.files import DictionaryWriter

        if not self.variables:
            raise ValueError("there is no metadata to export")
        return DictionaryWriter().write(self.variables, path)


def recode_in_place(data: SurveyData, column: str, mapping: dict) -> SurveyData:
    """Replaces the values that a mapping names and keeps all others; metadata and weight are dropped."""
    return SurveyData(data.frame.withColumn(column, mapped(quoted(column), mapping, quoted(column))))
