"""Quality rules as a short-circuit cascade, in Spark's own functions only.

Each rule is a Column that is true for texts to reject. On a sample of bounded size every rule is timed: jobs over
copies of each row, in turn with jobs that read the same columns and judge nothing, with more copies until the
difference stands out from the spread of equal jobs. What cannot be told apart from nothing, and all below LEAST_COST
a row, counts as equally cheap, and costs are rounded to powers of four, so that noise does not make the order. Then the
rule with the most rejections per cost among the rows still left is taken first, the next one is judged on the rows that
it lets through, and so on. The rules stand in one CASE in that order, so that a later rule is only evaluated for rows
that the earlier ones let through. The order depends on timing; whether a row is kept does not.

Cases: null, empty and blank texts have no words (and fail any rule on a least number of words); rules see
whole texts; a document of any length is one row, so repeated rows, ties and empty tables need no care, and
other columns pass through.
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import words_of, written

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: Copies of a sampled row in the timings, tried in turn; seconds a row that a rule counts as at least; files that a sample is
#: taken from.
REPEATS, LEAST_COST, SAMPLE_FILES = (8, 64), 1e-6, 64
BASE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def symbol_count(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, "")), F.lit(0)).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def worded_lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))


def duplicate_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def window_hashes(words: Column) -> Column:
    """64-bit hashes of all WINDOW-word windows, in order."""

    def hashes(w: Column) -> Column:
        last = F.size(w) - WINDOW
        each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashes)  # bound once, also where Spark moves the expression into a filter


def covered_by_repeats(hashes: Column) -> Column:
    """Words in windows that occur twice or more: equal hashes meet in sorted order, and the words that
    the repeated windows cover are counted once. Texts without a repeat skip the sort."""

    def spans(at: Column) -> Column:
        own = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    def starts(ordered: Column) -> Column:
        twin = lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"])
        found = F.filter(ordered, lambda x, k: F.coalesce(F.when(k == 0, F.get(ordered, k + 1)["h"] == x["h"]).otherwise(twin(x, k)), F.lit(False)))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        slow = let(ordered, lambda s: let(starts(s), spans))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow).cast("long")

    return let(hashes, covered)


def stutters(words: Column) -> Column:
    """Words equal to the word before them."""
    return let(words, lambda w: F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))))


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns BASE (columns of these names are replaced)."""
    split = df.withColumns({"_words": words_of(F.col(text)), "_lines": worded_lines(F.col(text))})
    hashed = split.withColumn("_windows", window_hashes(F.col("_words")))
    counted = hashed.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in BASE],
        F.size("_words").cast("long").alias("n_words"), word_chars(F.col("_words")).alias("word_chars"), symbol_count(F.col(text)).alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"), duplicate_lines(F.col("_lines")).alias("n_dup_lines"), covered_by_repeats(F.col("_windows")).alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


@dataclass(frozen=True)
class Rule:
    """A named rule; `rejects` is true for rows that it rejects (null counts as false)."""

    name: str
    rejects: Column


def default_rules(text: str = "text") -> list[Rule]:
    """Rules on the shape of a text, over the counts of with_base where those serve."""
    t, n = F.col(text), F.greatest(F.col("n_words"), F.lit(1))
    letters = lambda kind: F.length(F.regexp_replace(t, f"[^\\p{{{kind}}}]", ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("word_chars")),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 5 * F.col("n_lines")),
        Rule("exclamations", 2 * (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))) > n),
        Rule("upper_case", 2 * letters("Lu") > letters("L")),
        Rule("bars", 5 * (F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))) > n),
        Rule("stutter", 4 * stutters(words_of(t)) > n),
    ]


def some_files(scan: DataFrame, most: int = SAMPLE_FILES, seed: int = 7) -> DataFrame:
    """A scan of files cut to `most` random ones, so that a sample does not read a whole table. For estimates only."""
    names = sorted({f.rsplit("/", 1)[-1] for f in scan.inputFiles()})
    if len(names) <= most:
        return scan
    some = random.Random(seed).sample(names, most)  # by name: paths are spelled differently in inputFiles and in _metadata
    return scan.filter(F.col("_metadata.file_name").isin(some + [unquote(f) for f in some]))


def row_costs(sample: DataFrame, rules: Sequence[Rule], rows: int) -> dict[str, float]:
    """Seconds a row of every rule, LEAST_COST or a power of four times it."""
    nothing = F.lit(True)
    for c in sample.columns:  # the idle job reads what the rules read
        nothing = nothing & F.col(f"`{c}`").isNotNull()
    out: dict[str, float] = {}
    for copies in REPEATS:
        copied = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))

        def seconds(test: Column, copied=copied) -> float:
            began = time.perf_counter()
            copied.agg(F.count_if(F.coalesce(test, F.lit(False)))).collect()  # one row
            return time.perf_counter() - began

        seconds(nothing)
        idle = [seconds(nothing)]
        for rule in [r for r in rules if r.name not in out]:
            if copies == REPEATS[0]:
                sample.agg(F.count_if(F.coalesce(rule.rejects, F.lit(False)))).collect()  # reads and compiles it
            took = [seconds(rule.rejects), seconds(rule.rejects)]
            idle.append(seconds(nothing))
            more, spread = min(took) - min(idle[-2:]), max(abs(took[0] - took[1]), abs(idle[-1] - idle[-2]))
            if more > 4 * spread or copies == REPEATS[-1]:
                cost = max((more if more > spread else 0.0) / max(rows * copies, 1), LEAST_COST)
                out[rule.name] = LEAST_COST * 4.0 ** round(math.log(cost / LEAST_COST, 4))
    return out


def best_order(costs: dict[str, float], patterns: Sequence[tuple[frozenset, int]]) -> list[str]:
    """Rule names, each time the one with the most rejections per cost among the rows that those before let through.
    patterns: the names of the rules that reject a row, and the number of such rows. Ties go by name."""
    order, left = [], sorted(costs)
    while left:
        open_rows = [(names, n) for names, n in patterns if not names & set(order)]
        worth = {r: (sum(n for names, n in open_rows if r in names) + 0.5) / max(costs[r], LEAST_COST) for r in left}
        left.sort(key=lambda r: (-worth[r], r))
        order.append(left.pop(0))
    return order


def ordered_rules(
    df: DataFrame, rules: Sequence[Rule], sample_rows: int = 2_000, seed: int = 7, prepare: Callable = lambda x: x, before: Column | None = None
) -> list[Rule]:
    """Rules in the order of the cascade, as measured on about sample_rows random rows of df, to which `prepare` adds the
    columns that the rules need; rows where `before` holds never reach a rule and are left out."""
    share = min(1.0, sample_rows / max(df.count(), 1))
    sample = prepare(df.sample(fraction=share, seed=seed).repartition(4))
    sample = written(sample if before is None else sample.filter(~F.coalesce(before, F.lit(False))), "rule-sample")
    costs = row_costs(sample, rules, sample.count())
    flags = [F.coalesce(r.rejects, F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
    found = sample.select(*flags).groupBy(*[f"r{i}" for i in range(len(rules))]).count().collect()  # at most a row a sampled row
    patterns = [(frozenset(r.name for r, hit in zip(rules, row, strict=False) if hit), row["count"]) for row in found]
    place = {name: i for i, name in enumerate(best_order(costs, patterns))}
    return sorted(rules, key=lambda r: place[r.name])


def first_failure(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects a row, null if none does; later rules are then not evaluated."""
    verdict = F
    for rule in rules:
        verdict = verdict.when(rule.rejects, F.lit(rule.name))
    return verdict if rules else F.lit(None).cast("string")


def apply_cascade(df: DataFrame, rules: Sequence[Rule], before: Column | None = None, into: str = "failed_rule") -> DataFrame:
    """df with the name of the first failing rule; rows where `before` holds are decided without the rules."""
    verdict = first_failure(rules)
    return df.withColumn(into, verdict if before is None else F.when(before, F.lit("base")).otherwise(verdict))
