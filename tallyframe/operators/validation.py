"""Validation of responses against their metadata: all value checks of all columns in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import number, quoted, without_codes
from tallyframe.operators.variables import Variable

if TYPE_CHECKING:
    from tallyframe.operators.dataset import SurveyData


@dataclass(frozen=True)
class Issue:
    code: str
    severity: str
    variable: str | None
    message: str
    count: int = 0
    examples: tuple = ()  # least and greatest offending value, as text


class ValidationError(ValueError):
    def __init__(self, issues: list[Issue]):
        super().__init__("; ".join(i.message for i in issues))
        self.issues = issues


def _fits(v: Variable, kind: T.DataType, x: Column) -> Column | None:
    """Whether a value fits the declared dtype; None where the column's type alone decides that it does."""
    whole, real = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType, T.DecimalType)
    no = F.lit(False)
    if v.dtype == "int":
        return None if isinstance(kind, whole) else (x % 1 == 0 if isinstance(kind, real) else no)
    if v.dtype == "float":
        return None if isinstance(kind, whole + real) else no
    if v.dtype == "bool":
        return None if isinstance(kind, T.BooleanType) else (x.isin(0, 1) if isinstance(kind, whole + real) else no)
    if v.dtype in ("str", "category"):
        return None if isinstance(kind, T.StringType) else no
    if v.dtype == "datetime":
        return None if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else no
    return None


def _out_of_range(v: Variable, kind: T.DataType, x: Column) -> Column:
    n = number(x, kind if not isinstance(kind, T.BooleanType) else None)
    low, high = v.valid_range
    bad = n.isNull()
    if low is not None:
        bad = bad | (n < low)
    if high is not None:
        bad = bad | (n > high)
    return bad


def _checks(data: SurveyData) -> list[tuple[str, str, str, Column, Column]]:
    """(variable, code, message, offends, value) of every check on values that applies."""
    out = []
    for name, v in data.variables.items():
        if name not in data.frame.columns:
            continue
        kind = data.type_of(name)
        listed = isinstance(kind, T.ArrayType)
        x = quoted(name) if listed else without_codes(quoted(name), v.missing_values)
        here = x.isNotNull()
        if v.dtype and not listed and (fits := _fits(v, kind, x)) is not None:
            out.append((name, "INVALID_DTYPE", f"{name}: values are not of type {v.dtype}", here & ~F.coalesce(fits, F.lit(False)), x.cast("string")))
        if v.valid_range is not None and not listed:
            out.append((name, "OUT_OF_RANGE", f"{name}: values outside {v.valid_range[0]}..{v.valid_range[1]}", here & _out_of_range(v, kind, x), x.cast("string")))
        if v.scale in ("nominal", "ordinal") and v.labels:
            known = [c for c in v.labels if c is not None]
            if listed:
                allowed = known + list(v.missing_values)
                odd = F.array_except(F.filter(x, F.isnotnull), F.array(*map(F.lit, allowed)))
                out.append((name, "INVALID_LABEL_VALUE", f"{name}: values without a label", here & (F.size(odd) > 0), F.array_join(odd.cast("array<string>"), ",")))
            else:
                out.append((name, "INVALID_LABEL_VALUE", f"{name}: values without a label", here & ~x.isin(known), x.cast("string")))
    return out


def _offending(name: str, values: Column, known: list) -> Column:
    """(variable, value) of the values of a list that are not known."""
    out = F.filter(values, lambda x: x.isNotNull() & ~x.isin(known)).cast("array<string>")
    return F.transform(out, lambda x: F.struct(F.lit(name).alias("variable"), x.alias("value")))


def label_offenders(data: SurveyData) -> DataFrame:
    """(variable, value, n): every value that its variable gives no label, list items one by one, with the rows that hold it.

    All variables are laid out one below the other and counted together, in one pass."""
    odd = []
    for name, v in data.variables.items():
        if name not in data.frame.columns or v.scale not in ("nominal", "ordinal") or not v.labels:
            continue
        known = [c for c in (*v.labels, *v.missing_values) if c is not None]
        values = F.array_distinct(quoted(name)) if isinstance(data.type_of(name), T.ArrayType) else F.array(quoted(name))
        odd.append(_offending(name, values, known))
    if not odd:
        return data.frame.sparkSession.createDataFrame([], "variable string, value string, n long")
    found = data.frame.select(F.explode(F.flatten(F.array(*[F.coalesce(o, F.array().cast("array<struct<variable:string,value:string>>")) for o in odd]))).alias("x"))
    return found.groupBy("x.variable", "x.value").agg(F.count("*").alias("n"))


def validate_frame(data: SurveyData) -> list[Issue]:
    """Issues in order of variables: columns, then values, then metadata."""
    issues, frame = [], data.frame
    for name in data.variables:
        if name not in frame.columns:
            issues.append(Issue("MISSING_COLUMN", "error", name, f"{name}: no such column"))
    issues += [Issue("EXTRA_COLUMN", "warning", c, f"{c}: column without metadata") for c in frame.columns if c not in data.variables]
    checks = _checks(data)
    aggregates = []
    for i, (_, _, _, offends, value) in enumerate(checks):
        aggregates += [F.count_if(offends).alias(f"n{i}"), F.min(F.when(offends, value)).alias(f"e{i}"), F.max(F.when(offends, value)).alias(f"f{i}")]
    got = frame.agg(*aggregates).first() if aggregates else {}
    by_variable: dict[str, list[Issue]] = {}
    for i, (name, code, message, _, _) in enumerate(checks):
        if got[f"n{i}"]:
            ends = tuple(dict.fromkeys((got[f"e{i}"], got[f"f{i}"])))
            by_variable.setdefault(name, []).append(Issue(code, "error", name, message, got[f"n{i}"], ends))
    for name, v in data.variables.items():
        issues += by_variable.get(name, [])
        for code in v.missing_values:
            if v.labels and code not in v.labels and any(m.code == code and m.label == str(code) for m in v.missing):
                issues.append(Issue("MISSING_VALUE_WITHOUT_LABEL", "warning", name, f"{name}: missing code {code} has no label"))
        if name in frame.columns and v.role == "weight" and not isinstance(data.type_of(name), T.NumericType):
            issues.append(Issue("INVALID_WEIGHT", "error", name, f"{name}: a weight is a number"))
        if name in frame.columns and v.role == "id":
            twice = frame.filter(quoted(name).isNotNull()).groupBy(quoted(name).alias("id")).count().filter("count > 1")
            n, example = twice.agg(F.count("*"), F.min("id")).first()
            if n:
                issues.append(Issue("DUPLICATE_ID", "error", name, f"{name}: ids occur more than once", n, (str(example),)))
    return issues


def validate_data(data: SurveyData, raise_on_error: bool = False) -> list[Issue]:
    """All issues of a dataset; with raise_on_error, ValidationError if any is an error."""
    issues: list[Issue] = []
    if not data.variables:
        issues.append(Issue("MISSING_METADATA", "warning", None, "the dataset has no metadata"))
    else:
        issues += validate_frame(data)
    if data.weight:
        if data.weight not in data.frame.columns:
            issues.append(Issue("MISSING_WEIGHT_COLUMN", "error", data.weight, f"{data.weight}: no such column"))
        elif not isinstance(data.type_of(data.weight), T.NumericType):
            issues.append(Issue("INVALID_WEIGHT", "error", data.weight, f"{data.weight}: a weight is a number"))
    if data.questionnaire is not None:
        for name in data.questionnaire.variable_names():
            if name not in data.frame.columns:
                issues.append(Issue("QUESTIONNAIRE_COLUMN_MISSING", "error", name, f"{name}: the questionnaire's column is missing"))
    errors = [i for i in issues if i.severity == "error"]
    if raise_on_error and errors:
        raise ValidationError(errors)
    return issues


def issues_frame(data: SurveyData, issues: list[Issue]):
    """Issues as a DataFrame."""
    rows: list[tuple[Any, ...]] = [(i.code, i.severity, i.variable, i.message, i.count) for i in issues]
    return data.frame.sparkSession.createDataFrame(rows, "code string, severity string, variable string, message string, count long")
