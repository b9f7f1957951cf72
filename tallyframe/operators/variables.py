"""Variable metadata: scales, labels, coded missing values, and the registry that travels with a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tallyframe.functions.expressions import Expression, compare

# The vocabulary of variable metadata.
SCALES = ("nominal", "ordinal", "interval", "ratio")
DTYPES = ("int", "float", "str", "bool", "category", "datetime")
ROLES = ("input", "target", "weight", "id", "grouping", "derived")
MISSING_KINDS = ("refusal", "dont_know", "not_applicable", "not_asked", "system_missing")


def _one_of(what: str, value: str | None, allowed: tuple) -> str | None:
    if value is None:
        return None
    plain = str(value).strip().lower()
    if plain not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return plain


def _code(text: Any) -> Any:
    """A JSON object key as a code: an int if it reads as one, else a float, else itself."""
    for kind in (int, float):
        try:
            return kind(text)
        except (TypeError, ValueError):
            pass
    return text


@dataclass(frozen=True)
class MissingValue:
    code: Any
    label: str | None = None
    kind: str = "system_missing"

    def __post_init__(self):
        object.__setattr__(self, "kind", _one_of("kind", self.kind, MISSING_KINDS))
        object.__setattr__(self, "label", str(self.code) if self.label is None else self.label)

    def to_dict(self) -> dict:
        return {"code": self.code, "label": self.label, "kind": self.kind}


@dataclass(frozen=True)
class Variable:
    name: str
    scale: str | None = None
    label: str | None = None
    labels: dict = field(default_factory=dict)
    missing: tuple = ()
    missing_values: tuple = ()
    missing_labels: dict = field(default_factory=dict)
    dtype: str | None = None
    role: str | None = None
    description: str | None = None
    construct: str | None = None
    source: str | None = None
    valid_range: tuple | None = None

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        if not isinstance(self.name, str) or not self.name.strip():
            raise ValueError("a variable needs a name")
        put("scale", _one_of("scale", self.scale, SCALES))
        put("dtype", _one_of("dtype", self.dtype, DTYPES))
        put("role", _one_of("role", self.role, ROLES))
        merged: dict = {}
        for m in self.missing:
            m = MissingValue(**m) if isinstance(m, dict) else m
            merged.setdefault(m.code, m)
        for code in self.missing_values:
            merged.setdefault(code, MissingValue(code, self.missing_labels.get(code)))
        if unknown := [c for c in self.missing_labels if c not in merged]:
            raise ValueError(f"{self.name}: missing_labels names codes that are not missing: {unknown}")
        put("missing", tuple(merged.values()))
        put("missing_values", tuple(merged))
        if self.valid_range is not None:
            low, high = self._checked_range()
            put("valid_range", (low, high))

    def _checked_range(self):
        if len(self.valid_range) != 2:
            raise ValueError(f"{self.name}: valid_range needs two ends")
        low, high = self.valid_range
        if low is not None and high is not None and low > high:
            raise ValueError(f"{self.name}: valid_range is out of order")
        return low, high

    def __hash__(self):
        return hash(self.name)

    def is_missing(self, value: Any) -> bool:
        return value is None or value != value or value in self.missing_values

    def eq(self, value) -> Expression:
        return compare(self, "=", value)

    def ne(self, value) -> Expression:
        return compare(self, "!=", value)

    def gt(self, value) -> Expression:
        return compare(self, ">", value)

    def ge(self, value) -> Expression:
        return compare(self, ">=", value)

    def lt(self, value) -> Expression:
        return compare(self, "<", value)

    def le(self, value) -> Expression:
        return compare(self, "<=", value)

    def isin(self, *values) -> Expression:
        return compare(self, "in", _flat(values))

    def notin(self, *values) -> Expression:
        return compare(self, "not in", _flat(values))

    __gt__, __ge__, __lt__, __le__ = gt, ge, lt, le

    def to_dict(self) -> dict:
        plain = {k: getattr(self, k) for k in ("name", "scale", "label", "dtype", "role", "description", "construct", "source")}
        return plain | {
            "labels": {str(k): v for k, v in self.labels.items()},
            "missing": [m.to_dict() for m in self.missing],
            "valid_range": None if self.valid_range is None else list(self.valid_range),
        }

    @classmethod
    def from_dict(cls, tree: dict) -> Variable:
        known = {k: v for k, v in tree.items() if k in cls.__dataclass_fields__ and v is not None}
        known["labels"] = {_code(k): v for k, v in known.get("labels", {}).items()}
        if "missing_labels" in known:
            known["missing_labels"] = {_code(k): v for k, v in known["missing_labels"].items()}
        for k in ("missing", "missing_values", "valid_range"):
            if k in known:
                known[k] = tuple(known[k])
        return cls(**known)


def _flat(values: tuple) -> tuple:
    return tuple(values[0]) if len(values) == 1 and isinstance(values[0], (list, tuple, set, frozenset)) else values


class VariableMap(dict):
    """Variables by name, in order."""

    def __init__(self, variables: Iterable[Variable] | dict = ()):
        super().__init__()
        for v in variables.values() if isinstance(variables, dict) else variables:
            self.add(v)

    def add(self, variable: Variable) -> None:
        if variable.name in self:
            raise ValueError(f"variable {variable.name!r} is there already")
        self[variable.name] = variable

    def replaced(self, variable: Variable) -> VariableMap:
        """With the variable put last, in place of any of its name."""
        return VariableMap([v for k, v in self.items() if k != variable.name] + [variable])

    def require(self, name: str) -> Variable:
        if name not in self:
            raise KeyError(f"no variable {name!r}")
        return self[name]

    def by_scale(self, scale: str) -> list[Variable]:
        return [v for v in self.values() if v.scale == scale]

    def by_role(self, role: str) -> list[Variable]:
        return [v for v in self.values() if v.role == role]

    def labels_dict(self) -> dict[str, str]:
        return {k: v.label or k for k, v in self.items()}

    def value_labels_dict(self) -> dict[str, dict]:
        return {k: dict(v.labels) for k, v in self.items() if v.labels}

    def missing_dict(self) -> dict[str, list]:
        return {k: list(v.missing_values) for k, v in self.items() if v.missing}

    def missing_labels_dict(self) -> dict[str, dict]:
        return {k: {m.code: m.label for m in v.missing} for k, v in self.items() if v.missing}

    def missing_kinds_dict(self) -> dict[str, dict]:
        return {k: {m.code: m.kind for m in v.missing} for k, v in self.items() if v.missing}

    def to_dict(self) -> dict:
        return {k: v.to_dict() for k, v in self.items()}

    @classmethod
    def from_dict(cls, tree: dict) -> VariableMap:
        if not isinstance(tree, dict):
            raise ValueError("a dictionary of variables is an object")
        return cls([Variable.from_dict({"name": k} | v) for k, v in tree.items()])


def attach_metadata(df: DataFrame, variables: VariableMap) -> DataFrame:
    """df with each variable's metadata in its column, so that it survives Parquet."""
    for name in df.columns:
        if name in variables:
            df = df.withMetadata(name, {"variable": variables[name].to_dict()})
    return df


def metadata_of(df: DataFrame) -> VariableMap:
    """The registry that attach_metadata left in df's columns."""
    found = [f.metadata["variable"] for f in df.schema.fields if "variable" in (f.metadata or {})]
    return VariableMap([Variable.from_dict(x) for x in found])
