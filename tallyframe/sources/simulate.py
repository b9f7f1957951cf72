"""Synthetic responses that follow a questionnaire's skip logic.

Every draw is a hash of (respondent, seed, variable), so results depend on neither partitioning nor order,
and n may be as large as the cluster allows. Samples without replacement order the codes by their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.expressions import condition
from tallyframe.operators.dataset import SurveyData
from tallyframe.sources.questionnaire import LikertScale, Matrix, MultiChoice, NumericInput, OpenText, Question, Questionnaire, Ranking


def draw(low: int, high: int, *salt) -> Column:
    """Uniform integer in low..high."""
    return F.pmod(F.xxhash64("_id", *map(F.lit, salt)), F.lit(high - low + 1)) + F.lit(low)


def shuffled(codes: list, *salt) -> Column:
    """The codes in a random order."""
    keyed = F.transform(F.array(*map(F.lit, codes)), lambda c: F.struct(F.xxhash64(c, F.col("_id"), *map(F.lit, salt)).alias("h"), c.alias("c")))
    return F.transform(F.sort_array(keyed), lambda x: x["c"])


def sample(codes: list, least: int, most: int, *salt) -> Column:
    """A random number, least..most, of different codes in random order."""
    return F.slice(shuffled(codes, *salt), F.lit(1), draw(least, most, *salt, "size").cast("int"))


def _pick(codes: list, *salt) -> Column:
    return F.element_at(F.array(*map(F.lit, codes)), draw(1, len(codes), *salt).cast("int"))


def _bounds(q: MultiChoice, n: int) -> tuple[int, int]:
    most = min(q.max_answers or n, n)
    return min(q.min_answers, most), most


def raw_values(q: Question, seed: int) -> dict[str, Column]:
    """Value columns of a question, as if it were always shown."""
    if isinstance(q, MultiChoice) and q.mode == "wide":
        names = [v.name for v in q.variables()]
        chosen = sample(names, *_bounds(q, len(names)), seed, q.id)
        return {n: F.array_contains(chosen, n).cast("int") for n in names}
    if isinstance(q, Matrix):
        return {v.name: _pick(list(v.labels) or [1, 2, 3, 4, 5], seed, v.name) for v in q.variables()}
    v = q.variables()[0]
    if isinstance(q, NumericInput):
        low, high = v.valid_range or (18, 70)
        return {v.name: draw(int(low if low is not None else 18), int(high if high is not None else 70), seed, v.name)}
    if isinstance(q, LikertScale):
        return {v.name: draw(1, q.points, seed, v.name)}
    if isinstance(q, OpenText):
        return {v.name: F.lit("sample text")}
    codes = q.codes() or [1]
    if isinstance(q, MultiChoice):
        chosen = sample(codes, *_bounds(q, len(codes)), seed, v.name)
        alone = F.filter(chosen, lambda c: c.isin(q.exclusive)) if q.exclusive else F.array()
        return {v.name: F.when(F.size(alone) > 0, F.slice(alone, 1, 1)).otherwise(chosen) if q.exclusive else chosen}
    if isinstance(q, Ranking):
        return {v.name: sample(codes, 1, min(q.max_ranked or len(codes), len(codes)), seed, v.name)}
    return {v.name: _pick(codes, seed, v.name)}


def _visible(item, answered: dict[str, Column]) -> Column:
    """Shown and not hidden, given the answers so far. A text as hide_if hides."""
    shown = F.lit(True) if item.show_if is None else condition(item.show_if, answered)
    return shown if item.hide_if is None else shown & ~condition(item.hide_if, answered)


def simulate(spark: SparkSession, questionnaire: Questionnaire, n: int = 100, seed: int = 42) -> SurveyData:
    """n respondents. With pages, hidden pages and questions give nulls; without, all questions are answered."""
    rows: DataFrame = spark.range(n).withColumnRenamed("id", "_id")
    raw = {name: c for q in questionnaire.questions() for name, c in raw_values(q, seed).items()}
    rows = rows.withColumns(raw)
    answered: dict[str, Column] = {}
    for page in questionnaire.pages:
        gate = f"_page_{page.name}"
        conditional = page.show_if is not None or page.hide_if is not None
        if conditional:
            rows = rows.withColumn(gate, _visible(page, answered))
        for q in page.questions():
            if conditional or q.show_if is not None or q.hide_if is not None:
                shown = _visible(q, answered) & (F.col(gate) if conditional else F.lit(True))
                rows = rows.withColumns({v.name: F.when(shown, F.col(f"`{v.name}`")) for v in q.variables()})
            answered |= {v.name: F.col(f"`{v.name}`") for v in q.variables()}
    return SurveyData(rows.select([F.col(f"`{c}`") for c in questionnaire.variable_names()]), questionnaire.variable_map(), questionnaire)
