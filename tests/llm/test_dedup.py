import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import near_dedup, substring_dedup
from tests.llm.helpers import SF, documents, hostile, near_classes, repeated_bytes, weighted_classes

DIGEST = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]


def check_repeats(spark, rows):
    got = substring_dedup.deduplicated(documents(spark, rows)).select(DIGEST).collect()
    want = [(*r[:5], None if t is None else r[5].decode("utf-8", "ignore")) for r, (_, t) in zip(repeated_bytes(rows), rows, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def passages(seed=3, n=40):
    r = random.Random(seed)
    base = "".join(r.choice("abcdefgh \né") for _ in range(3000))
    rows = []
    for i in range(n):
        a = r.randint(0, 2400)
        text = "".join(r.choice("xyz ") for _ in range(r.randint(0, 150))) + base[a : a + r.randint(100, 600)] + "".join(r.choice("xyz ") for _ in range(r.randint(0, 150)))
        if r.random() < 0.5:
            p = r.randint(0, len(text) - 1)
            text = text[:p] + "Q" + text[p + 1 :]
        rows.append((i, text))
    return rows


def test_repeated_strings_equal_brute_force(spark):
    rows = passages() + [(100, "ab" * 400), (101, "x" * 199), (102, "y" * 200), (103, "y" * 201), (0, passages()[0][1]), (0, "other " * 60)]
    check_repeats(spark, rows)


def same_tags(spark, texts):
    """Texts by the low 16 bits of Spark's hash."""
    found = {}
    for tag, text in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("pmod(xxhash64(t), 65536)", "t").collect():
        found.setdefault(tag, []).append(text)
    return found


def test_repeated_strings_of_hostile_documents(spark):
    check_repeats(spark, hostile())


def test_texts_of_one_or_no_id_keep_their_own_spans(spark):
    passage = passages(seed=5)[0][1][:20] + "".join(random.Random(5).choice("abcdefgh ") for _ in range(300))
    texts = [f"{i} " * (1 + i % 40) + passage for i in range(2_000)]
    tags = same_tags(spark, texts)
    a, b = next((x, y) for same in tags.values() for x in same for y in same if len(x) < len(y))
    for doc_id in (None, 7):
        check_repeats(spark, [(doc_id, a), (doc_id, b), (None, a[:90]), (8, "tail " * 20 + passage[:250])])


def test_wide_grams_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", 3)
    check_repeats(spark, passages(seed=4))


@pytest.mark.parametrize("group", [3, 8])
def test_wide_grams_are_sorted_by_longer_grams(spark, monkeypatch, group):
    """A common passage among different neighbours, cut and not cut, so that grams are wide and their longer grams in part."""
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(260))
    rows = [(i, "".join(r.choice("xyz ") for _ in range(180)) + passage[r.randint(0, 90) :][: r.randint(120, 260)] + "".join(r.choice("xyz ") for _ in range(180))) for i in range(24)]
    check_repeats(spark, rows + passages(seed=6, n=12))


@pytest.mark.parametrize("group", [4_000, 3, 8])
def test_nothing_is_removed_that_suffix_sorting_did_not_find(spark, monkeypatch, group):
    """With the comparison of neighbours in the sorted order switched off, also for exact copies and wide grams."""
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    reach = substring_dedup._reach

    def blind(raw, groups, longest):
        order, shared = reach(raw, groups, longest)
        return order, np.full(len(shared), -1)

    rows = passages(n=20) + [(900, "copy " * 99), (901, "copy " * 99), (902, "copy " * 99)]
    find = substring_dedup._twin_starts
    with monkeypatch.context() as m:
        m.setattr(substring_dedup, "_sorted_spans", _blind_spans)
        assert substring_dedup.deduplicated(documents(spark, rows)).filter("n_removed > 0").count() == 0
    assert len(find([b"x" * 200, b"x" * 200], np.zeros(2, int), np.zeros(2, int), np.zeros(2, int), 2)) == 2
    monkeypatch.setattr(substring_dedup, "_reach", blind)
    assert len(find([b"x" * 200, b"x" * 200], np.zeros(2, int), np.zeros(2, int), np.zeros(2, int), 2)) == 0


def _blind_spans(batches):
    """_sorted_spans in a worker where neighbours never share a byte."""
    reach = substring_dedup._reach
    substring_dedup._reach = lambda *a: (lambda order, shared: (order, np.full(len(shared), -1)))(*reach(*a))
    try:
        yield from _sorted_spans(batches)
    finally:
        substring_dedup._reach = reach


_sorted_spans = substring_dedup._sorted_spans


@pytest.mark.parametrize("doc_id", [None, 7])
def test_many_rows_of_one_id_or_none(spark, doc_id):
    r = random.Random(2)
    passage = "".join(r.choice("abcdefgh ") for _ in range(400))
    check_repeats(spark, [(doc_id, f"{i} " * (1 + i % 30) + passage[r.randint(0, 150) :] if i % 3 else f"alone {i} " * 3) for i in range(2_000)])


def test_columns_of_added_names_are_replaced(spark):
    df = documents(spark, passages(n=5))
    for name in substring_dedup.ADDED:
        df = df.withColumn(name, F.lit("x"))
    assert substring_dedup.deduplicated(df).select(DIGEST).collect() and len(set(substring_dedup.deduplicated(df).columns)) == len(substring_dedup.deduplicated(df).columns)


def test_repeats_of_an_empty_table(spark):
    assert substring_dedup.deduplicated(documents(spark, [])).count() == 0


def test_repeats_on_test_data(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    check_repeats(spark, rows)


def near(spark, rows, **options):
    return sorted((tuple(r) for r in near_dedup.near_classes(documents(spark, rows), **options).collect()), key=repr)


def variants(n=60, seed=7):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(90)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(90)] = f"z{r.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    return rows + [(1000 + i, " ".join(f"u{r.randint(0, 10**6)}" for _ in range(50))) for i in range(20)]


@pytest.mark.parametrize("chunk", [250_000, 600])
def test_classes_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)  # small chunks: clusters go on in several tasks
    rows = variants()
    assert near(spark, rows) == sorted(near_classes(rows).items(), key=repr)


def test_large_groups_in_small_chunks_equal_brute_force(spark, monkeypatch):
    """Two groups whose buckets mix, dealt by head into chunks of few texts."""
    monkeypatch.setattr(near_dedup, "TEXTS", 7)
    r = random.Random(11)
    rows = variants(n=50, seed=8)
    half = rows[0][1].split()[:45]
    rows += [(2000 + i, " ".join([*half, *(f"k{r.randint(0, 3 + i)}" for _ in range(30 - i))])) for i in range(25)]
    assert near(spark, rows) == sorted(near_classes(rows).items(), key=repr)


def test_texts_of_one_id_or_none_are_judged_one_by_one(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    near_b = b.replace("b30", "other")
    assert near(spark, [(1, a), (1, b), (2, near_b)]) == [(1, 1), (1, 1), (2, 1)]
    rows = [(1, a), (1, b), (2, near_b), (None, a), (None, "n " + a), (None, "only " * 3), (None, "only " * 3), (None, None)]
    kept = [(x["doc_id"], x["text"]) for x in near_dedup.near_deduplicated(documents(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted([(1, a), (1, b), (None, "only " * 3), (None, None)], key=repr)


def test_classes_on_test_data(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert near(spark, rows) == sorted(near_classes(rows).items(), key=repr)


def test_classes_of_hostile_documents(spark):
    got = near(spark, hostile())
    of = {d: c for d, c in got if d is not None}
    assert len(got) == len(hostile())
    assert of[4] == of[5] == 4 and of[6] == of[7] == of[8] == 6 and of[13] not in (6, 7)
    assert (of[1], of[2], of[3]) == (1, 2, 3)
    assert [c for d, c in got if d is None] == [6, None]
    assert near(spark, []) == []


def test_one_document_of_a_class_stays(spark):
    df = documents(spark, hostile())
    kept = near_dedup.near_deduplicated(df)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert 7 not in ids and 8 not in ids and 5 not in ids and ids.count(6) == 2 and {1, 2, 3} <= set(ids)


def test_weighted_classes_count_repeats(spark):
    a = " ".join(["a b c d e"] * 30 + [f"x{i}" for i in range(10)])
    b = " ".join(["a b c d e"] * 10 + [f"x{i}" for i in range(10)])
    assert {c for _, c in near(spark, [(1, a), (2, b)])} == {1}
    assert {c for _, c in near(spark, [(1, a), (2, b)], weighted=True)} == {1, 2}


def test_weighted_classes_equal_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall() + [(10_000 + d, t) for d, t in variants(n=20)]
    assert near(spark, rows, weighted=True) == sorted(weighted_classes(rows).items(), key=repr)
