"""Column helpers: labels, numbers, rounding, names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def number(column: Column, kind: T.DataType | None = None) -> Column:
    """A column as double; what is not a number, and NaN, becomes null."""
    plain = column.try_cast("double") if kind is None or isinstance(kind, T.StringType) else column.cast("double")
    return F.when(~F.isnan(plain), plain)


def without_codes(column: Column, codes) -> Column:
    """column with the given codes as null; null stays null."""
    codes = [c for c in codes if c is not None]
    return F.when(~column.isin(codes), column) if codes else column


def mapped(column: Column, mapping: dict, otherwise: Column | None = None) -> Column:
    """Values of a mapping by literal keys; keys of another type than the column are compared after Spark's cast."""
    out = None
    for key, value in mapping.items():
        test = column.isNull() if key is None else column == F.lit(key)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    fallback = F.lit(None) if otherwise is None else otherwise
    return fallback if out is None else out.otherwise(fallback)


def label_of(column: Column, labels: dict, fallback: str = "text") -> Column:
    """Value label as text. fallback for codes without one: 'text' (the code as text) or 'null'."""
    other = column.cast("string") if fallback == "text" else F.lit(None).cast("string")
    return mapped(column, {k: str(v) for k, v in labels.items()}, other)


def half_even(column: Column, places: int) -> Column:
    return F.bround(column, places)


def slug(column: Column, joint: str = "_") -> Column:
    plain = F.regexp_replace(F.lower(column), "[^a-z0-9]+", joint)
    return F.regexp_replace(plain, f"^{joint}+|{joint}+$", "")


def answered(column: Column, kind: T.DataType) -> Column:
    """Whether an answer is given: not null, not empty text, list or map."""
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(column) > 0, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(F.trim(column) != "", F.lit(False))
    return column.isNotNull()


def piped(template: str, labels: dict[str, dict]) -> Column:
    """A text with the answers of a row put in: {answer:x} and {var:x} give the code, {label:x} its label where there is one,
    and nothing where the answer is missing. Other braces stay."""
    parts, at = [], 0
    for m in re.finditer(r"\{(answer|var|label):([^{}]+)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        code = quoted(m[2].strip())
        shown = label_of(code, labels.get(m[2].strip(), {})) if m[1] == "label" else code.cast("string")
        parts.append(F.coalesce(shown, F.lit("")))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))
