"""Typed predicates over answers, compiled to Spark columns with exact handling of missing answers.

A predicate is a tree of comparisons joined by and, or and not. Two readings of a missing answer exist:

- derivation: a comparison with a missing answer is false, its negative forms (`!=`, `not in`) are true;
- routing: an ordering comparison (`>`, `>=`, `<`, `<=`) with a missing answer is an error that makes the whole
  condition false, unless and/or decide before they reach it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDERING = {">", ">=", "<", "<="}
COMPARISONS = {"=", "!=", "in", "not in"} | ORDERING
OPERATORS = COMPARISONS | {"and", "or", "not", "raw"}


@dataclass(frozen=True)
class VarRef:
    """The answer to a variable, by name."""

    name: str

    def __hash__(self):
        return hash(self.name)


def _named(x) -> VarRef:
    return x if isinstance(x, VarRef) else VarRef(x if isinstance(x, str) else x.name)


@dataclass(frozen=True)
class Expression:
    """A node: operands are expressions under and/or/not, a VarRef and a literal under a comparison."""

    op: str
    left: Any = None
    right: Any = None

    def __and__(self, other: Expression) -> Expression:
        return Expression("and", self, other)

    def __or__(self, other: Expression) -> Expression:
        return Expression("or", self, other)

    def __invert__(self) -> Expression:
        return Expression("not", self)

    def variables(self) -> set[str]:
        out: set[str] = set()
        for side in (self.left, self.right):
            if isinstance(side, VarRef):
                out.add(side.name)
            elif isinstance(side, Expression):
                out |= side.variables()
        return out

    def validate(self, known: Iterable[str]) -> None:
        """Raises ValueError for unknown operators or variables and for raw text."""
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}")
        if self.op == "raw":
            raise ValueError("raw expressions cannot be checked or compiled")
        if unknown := self.variables() - set(known):
            raise ValueError(f"unknown variables: {', '.join(sorted(unknown))}")
        for side in (self.left, self.right):
            if isinstance(side, Expression):
                side.validate(known)

    def to_dict(self) -> dict:
        def out(side):
            if isinstance(side, Expression):
                return side.to_dict()
            if isinstance(side, VarRef):
                return {"var": side.name}
            return {"value": list(side) if isinstance(side, (tuple, set, frozenset)) else side}

        found = {"op": self.op, "left": out(self.left)}
        return found if self.op == "not" else found | {"right": out(self.right)}

    @staticmethod
    def from_dict(tree: dict) -> Expression:
        def read(side):
            if side is None:
                return None
            if "op" in side:
                return Expression.from_dict(side)
            return VarRef(side["var"]) if "var" in side else side["value"]

        return Expression(tree["op"], read(tree.get("left")), read(tree.get("right")))

    def evaluate(self, answers: dict) -> bool:
        """Reference reading on one Python dict (absent answers are None); ordering a None raises TypeError."""
        if self.op == "raw":
            raise ValueError("raw expressions cannot be evaluated")
        if self.op == "and":
            return self.left.evaluate(answers) and self.right.evaluate(answers)
        if self.op == "or":
            return self.left.evaluate(answers) or self.right.evaluate(answers)
        if self.op == "not":
            return not self.left.evaluate(answers)
        x, y = (answers.get(s.name) if isinstance(s, VarRef) else s for s in (self.left, self.right))
        if self.op in ORDERING:
            return {">": lambda: x > y, ">=": lambda: x >= y, "<": lambda: x < y, "<=": lambda: x <= y}[self.op]()
        return {"=": lambda: x == y, "!=": lambda: x != y, "in": lambda: x in y, "not in": lambda: x not in y}[self.op]()

    def to_text(self) -> str:
        """Readable form with variables in braces."""

        def out(side):
            if isinstance(side, Expression):
                return f"({side.to_text()})" if side.op in ("and", "or") else side.to_text()
            if isinstance(side, VarRef):
                return f"{{{side.name}}}"
            if isinstance(side, str):
                return f"'{side}'"
            return "[" + ", ".join(map(out, side)) + "]" if isinstance(side, (list, tuple, set)) else str(side)

        if self.op == "raw":
            return str(self.left)
        return f"not {out(self.left)}" if self.op == "not" else f"{out(self.left)} {self.op} {out(self.right)}"


def compare(name, op: str, value) -> Expression:
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}")
    return Expression(op, _named(name), value)


def AND(*parts: Expression) -> Expression:  # noqa: N802
    return _joined("and", parts)


def OR(*parts: Expression) -> Expression:  # noqa: N802
    return _joined("or", parts)


def NOT(part: Expression) -> Expression:  # noqa: N802
    return Expression("not", part)


def raw(text: str) -> Expression:
    return Expression("raw", text)


def _joined(op: str, parts) -> Expression:
    if len(parts) < 2:
        raise ValueError(f"{op} needs two operands or more")
    return reduce(lambda a, b: Expression(op, a, b), parts)


def _side(side, columns: dict[str, Column] | None) -> Column:
    if isinstance(side, VarRef):
        return F.col(f"`{side.name}`") if columns is None else columns.get(side.name, F.lit(None))
    return F.lit(side)


def _comparison(e: Expression, columns) -> Column:
    x = _side(e.left, columns)
    if e.op in ("in", "not in"):
        values = [v for v in e.right if v is not None]
        found = x.isin(values) if values else F.lit(False) & x.isNotNull()
        return ~found if e.op == "not in" else found
    y = _side(e.right, columns)
    return {"=": x == y, "!=": x != y, ">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[e.op]


def derived_column(e: Expression, columns: dict[str, Column] | None = None) -> Column:
    """The predicate as a boolean column without nulls, in the derivation reading."""
    if e.op == "and":
        return derived_column(e.left, columns) & derived_column(e.right, columns)
    if e.op == "or":
        return derived_column(e.left, columns) | derived_column(e.right, columns)
    if e.op == "not":
        return ~derived_column(e.left, columns)
    if e.op not in COMPARISONS:
        raise ValueError(f"cannot compile {e.op!r}")
    return F.coalesce(_comparison(e, columns), F.lit(e.op in ("!=", "not in")))


def _with_error(e: Expression, columns) -> tuple[Column, Column]:
    """(value, error) of the routing reading; the value of an error is not used."""
    if e.op == "not":
        value, error = _with_error(e.left, columns)
        return ~value, error
    if e.op in ("and", "or"):
        (a, a_bad), (b, b_bad) = _with_error(e.left, columns), _with_error(e.right, columns)
        reached = a if e.op == "and" else ~a
        return (a & b if e.op == "and" else a | b), a_bad | (reached & b_bad)
    if e.op not in COMPARISONS:
        raise ValueError(f"cannot compile {e.op!r}")
    if e.op in ORDERING:
        error = reduce(lambda p, q: p | q, [_side(s, columns).isNull() for s in (e.left, e.right)])
        return F.coalesce(_comparison(e, columns), F.lit(False)), error
    return derived_column(e, columns), F.lit(False)


def routed_column(e: Expression, columns: dict[str, Column] | None = None) -> Column:
    """The predicate as a boolean column without nulls, in the routing reading."""
    value, error = _with_error(e, columns)
    return value & ~error


def condition(when, columns: dict[str, Column] | None = None) -> Column:
    """A show or hide condition: none and text count as met."""
    return routed_column(when, columns) if isinstance(when, Expression) and when.op != "raw" else F.lit(not isinstance(when, Expression))
