"""Questionnaires: questions on pages, the checks on them, and the variables they produce."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

from tallyframe.functions.expressions import Expression
from tallyframe.operators.variables import Variable, VariableMap

PAGE_KINDS = ("content", "disqualification", "final", "redirect")
#: Variables in the text of a condition.
NAMED = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")


def slugify(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")


@dataclass(frozen=True)
class Option:
    code: Any
    label: str
    show_if: Any = None
    hide_if: Any = None


@dataclass(kw_only=True)
class Question:
    text: str = field(kw_only=False)
    var: Any = field(default=None, kw_only=False)
    id: str | None = None
    required: bool = False
    show_if: Any = None
    hide_if: Any = None
    skip_to: str | None = None
    other_specify: bool = False
    metadata: dict = field(default_factory=dict)

    #: Scales that the question's variables may have; empty for any.
    scales = ()

    def __post_init__(self):
        self.id = self.id or slugify(self.text) or "question"
        if self.var is None:
            raise ValueError(f"{self.id}: a question needs a variable")

    def variables(self) -> list[Variable]:
        return list(self.var) if isinstance(self.var, (list, tuple)) else [self.var]

    def codes(self) -> list:
        """Codes on offer: those of explicit choices, else the variable's labels."""
        choices = getattr(self, "choices", None)
        return [c.code for c in choices] if choices else list(self.variables()[0].labels)


@dataclass(kw_only=True)
class SingleChoice(Question):
    display: str = "radio"
    none_of_above: bool = False
    choices: list | None = None
    scales = ("nominal", "ordinal")

    def __post_init__(self):
        super().__post_init__()
        if self.display not in ("radio", "dropdown", "buttons"):
            raise ValueError("display is radio, dropdown or buttons")


@dataclass(kw_only=True)
class MultiChoice(Question):
    vars: list | None = None
    min_answers: int = 1
    max_answers: int | None = None
    exclusive: list = field(default_factory=list)
    mode: str = "array"
    choices: list | None = None

    def __post_init__(self):
        self.var = self.vars if self.var is None else self.var
        super().__post_init__()
        if self.mode not in ("array", "wide"):
            raise ValueError("mode is array or wide")
        if self.mode == "wide" and not isinstance(self.var, (list, tuple)):
            raise ValueError("wide mode needs a list of variables")
        if self.max_answers is not None and self.max_answers < self.min_answers:
            raise ValueError("max_answers is below min_answers")


@dataclass(kw_only=True)
class LikertScale(Question):
    points: int = 5
    left_label: str | None = None
    right_label: str | None = None
    na_option: Any = False
    scales = ("ordinal",)

    def __post_init__(self):
        super().__post_init__()
        if self.points < 2:
            raise ValueError("a Likert scale has two points or more")


@dataclass(kw_only=True)
class NumericInput(Question):
    display: str = "input"
    unit: str | None = None
    step: float = 1
    scales = ("interval", "ratio")

    def __post_init__(self):
        super().__post_init__()
        if self.display not in ("input", "slider"):
            raise ValueError("display is input or slider")


@dataclass(kw_only=True)
class OpenText(Question):
    multiline: bool = False
    max_chars: int | None = None


@dataclass(kw_only=True)
class Matrix(Question):
    subquestions: list | None = None
    column_labels: list | None = None
    na_option: Any = False

    def __post_init__(self):
        super().__post_init__()
        if not isinstance(self.var, (list, tuple)) or not self.var:
            raise ValueError("a matrix needs a list of variables")
        if self.subquestions and len(self.subquestions) != len(self.var):
            raise ValueError("a matrix has a subquestion per variable")


@dataclass(kw_only=True)
class Ranking(Question):
    max_ranked: int | None = None
    choices: list | None = None


@dataclass
class Block:
    items: list
    title: str | None = None
    show_if: Any = None
    hide_if: Any = None


def opened(items: list) -> list[Question]:
    """Questions of items in order; blocks, and blocks within them, are opened."""
    return [q for x in items for q in (opened(x.items) if isinstance(x, Block) else [x])]


@dataclass
class Page:
    name: str
    items: list = field(default_factory=list)
    title: str | None = None
    kind: str = "content"
    show_if: Any = None
    hide_if: Any = None
    next_if: list = field(default_factory=list)
    default_next: str | None = None
    redirect_url: str | None = None

    def __post_init__(self):
        if self.kind not in PAGE_KINDS:
            raise ValueError(f"page kind is one of {', '.join(PAGE_KINDS)}")

    @property
    def is_terminal(self) -> bool:
        return self.kind != "content"

    def questions(self) -> list[Question]:
        """Questions in order, blocks opened (their conditions do not take part in simulation)."""
        return opened(self.items)

    def targets(self) -> list[str]:
        return [t for _, t in self.next_if] + ([self.default_next] if self.default_next else [])


@dataclass(frozen=True)
class LintWarning:
    code: str
    where: str
    message: str
    severity: str = "warning"


@dataclass
class Questionnaire:
    title: str
    pages: list[Page] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    variables: VariableMap | None = None
    max_responses: int | None = None
    deadline: str | None = None
    scripts: list = field(default_factory=list)

    def questions(self) -> list[Question]:
        return [q for p in self.pages for q in p.questions()] + opened(self.blocks)

    def variable_map(self) -> VariableMap:
        return self.variables or VariableMap({v.name: v for q in self.questions() for v in q.variables()})

    def variable_names(self) -> list[str]:
        return list(dict.fromkeys(v.name for q in self.questions() for v in q.variables()))

    def conditions(self) -> Iterator[tuple[str, Any]]:
        """(where, condition) of everything that is shown, hidden or led to under one; blocks within blocks are opened."""

        def shown(where: str, x) -> Iterator[tuple[str, Any]]:
            yield from ((where, c) for c in (x.show_if, x.hide_if) if c is not None)

        def of(where: str, item) -> Iterator[tuple[str, Any]]:
            if isinstance(item, Block):
                yield from shown(f"{where}, block {item.title or 'without a title'}", item)
                for x in item.items:
                    yield from of(where, x)
            else:
                yield from shown(item.id, item)
                for option in getattr(item, "choices", None) or []:
                    if isinstance(option, Option):
                        yield from shown(f"{item.id}, option {option.code}", option)

        for p in self.pages:
            yield from shown(p.name, p)
            yield from ((p.name, c) for c, _ in p.next_if)
            for x in p.items:
                yield from of(p.name, x)
        for x in self.blocks:
            yield from of(self.title, x)

    def _check_condition(self, where: str, c, names: Sequence[str]) -> None:
        """Conditions are expressions or texts with variables in braces, know their variables, and can be tried on an answer
        of 0 to everything."""
        if isinstance(c, str):
            if unknown := sorted(set(NAMED.findall(c)) - set(names)):
                raise ValueError(f"{where}: unknown variables: {', '.join(unknown)}")
            return
        if not isinstance(c, Expression):
            raise ValueError(f"{where}: a condition is an expression or a text")
        try:
            c.validate(names)
            c.evaluate(dict.fromkeys(names, 0))
        except Exception as e:
            raise ValueError(f"{where}: {e}") from e

    def validate(self, strict: bool = False) -> None:
        """Raises ValueError for repeated or blank names, unknown targets or variables, variables that the registry lacks or
        defines otherwise, conditions that cannot be tried, unreachable pages and cycles; `strict` also for lint errors."""
        ids, names, pages = [q.id for q in self.questions()], [v.name for q in self.questions() for v in q.variables()], [p.name for p in self.pages]
        for what, found in (("question id", ids), ("variable", names), ("page", pages)):
            if twice := sorted({x for x in found if found.count(x) > 1}):
                raise ValueError(f"{what} used twice: {', '.join(twice)}")
        if any(not p.strip() for p in pages):
            raise ValueError("a page needs a name")
        if self.variables is not None:  # it may know more variables than are asked
            odd = sorted(v.name for q in self.questions() for v in q.variables() if v.name not in self.variables or self.variables[v.name] != v)
            if odd:
                raise ValueError(f"the registry lacks or defines otherwise: {', '.join(odd)}")
        for where, c in self.conditions():
            self._check_condition(where, c, names)
        for script in self.scripts:
            if script.target and script.target not in ids + pages:
                raise ValueError(f"a script is for unknown {script.target}")
        for q in self.questions():
            if q.skip_to and q.skip_to not in ids + pages:
                raise ValueError(f"{q.id}: skips to unknown {q.skip_to}")
        for p in self.pages:
            if unknown := [t for t in p.targets() if t not in pages]:
                raise ValueError(f"{p.name}: leads to unknown {', '.join(unknown)}")
        graph = self.graph()
        if unreached := set(pages) - self._reached(graph):
            raise ValueError(f"pages out of reach: {', '.join(sorted(unreached))}")
        if self._has_cycle(graph):
            raise ValueError("pages lead back to themselves")
        if strict and (errors := [w for w in self.lint("strict") if w.severity == "error"]):
            raise ValueError("; ".join(f"{w.code}: {w.message}" for w in errors))

    def graph(self) -> dict[str, set[str]]:
        """Page to pages that may come next: its targets and, unless it has a default, the following one. A page that ends the
        survey for some respondents is followed too, as its condition may let others pass."""
        out: dict[str, set[str]] = {}
        for p, after in zip(self.pages, [*self.pages[1:], None], strict=True):
            out[p.name] = set(p.targets())
            if not p.default_next and after is not None:
                out[p.name].add(after.name)
        return out

    def _reached(self, graph) -> set[str]:
        todo, seen = [p.name for p in self.pages[:1]], set()
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += graph[x]
        return seen

    @staticmethod
    def _has_cycle(graph) -> bool:
        left = {k: set(v) for k, v in graph.items()}
        while ends := [k for k, v in left.items() if not v & set(left)]:
            for k in ends:
                del left[k]
        return bool(left)

    def lint(self, level: str = "basic") -> list[LintWarning]:
        """Warnings in order of pages; `strict` adds those on questions and variables and makes empty pages errors."""
        if level not in ("basic", "strict"):
            raise ValueError("level is basic or strict")
        if not self.pages and not self.blocks:
            return [LintWarning("EMPTY_QUESTIONNAIRE", self.title, "the questionnaire has neither pages nor blocks")]
        out, graph = [], self.graph()
        for p, after in zip(self.pages, [*self.pages[1:], None], strict=True):
            if not p.items:
                out.append(LintWarning("EMPTY_PAGE", p.name, f"{p.name} holds nothing", "error" if level == "strict" else "warning"))
            if after is not None and p.default_next == after.name:
                out.append(LintWarning("REDUNDANT_NAVIGATION", p.name, f"{p.name} leads to the next page anyway"))
            if after is not None and not graph[p.name]:
                out.append(LintWarning("MISSING_NAVIGATION", p.name, f"{p.name} leads nowhere"))
        return out + (self._strict_warnings() if level == "strict" else [])

    def _strict_warnings(self) -> list[LintWarning]:
        """Of questions and variables. A scale that does not fit, or is not given where one is needed, and a choice whose
        categories have no labels are errors, as their tables could not be made."""
        out = []
        for q in self.questions():
            if q.required and q.show_if is not None:
                out.append(LintWarning("REQUIRED_CONDITIONAL", q.id, f"{q.id} is required and conditional"))
            for v in q.variables():
                if q.scales and v.scale not in q.scales:
                    out.append(LintWarning("INCOMPATIBLE_QUESTION_SCALE", q.id, f"{q.id}: the scale of {v.name} is {v.scale or 'not given'}, not {' or '.join(q.scales)}", "error"))
                if isinstance(q, (SingleChoice, MultiChoice)) and v.scale in ("nominal", "ordinal") and not v.labels:
                    out.append(LintWarning("CATEGORICAL_WITHOUT_LABELS", q.id, f"{q.id}: {v.name} has no labels", "error"))
        unused = set(self.variables or ()) - set(self.variable_names())
        return out + [LintWarning("UNUSED_VARIABLE", v, f"{v} belongs to no question") for v in sorted(unused)]

    def simulate(self, spark, n: int = 100, seed: int = 42):
        from tallyframe.sources.simulate import simulate

        return simulate(spark, self, n, seed)


@dataclass(frozen=True)
class Quota:
    """At most `limit` responses with a value of a variable."""

    variable: str
    target_value: Any
    limit: int
