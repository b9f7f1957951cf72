import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, mixing, near_dedup
from tests.llm.helpers import SF, contained, documents, hostile, plain_words


def test_targets_share_and_stop():
    got = mixing.targets({"b": 100, "a": 1000, None: 10, "c": 0})
    assert sum(got.values()) == pytest.approx(1.5 * 1110)
    assert got["b"] == 200 and got[None] == 20 and got["c"] == 0 and got["a"] == pytest.approx(1445)


def test_tree_keeps_quotas_and_shard_sizes():
    dealt = mixing.split(np.array([1000, 37, 0, 5]), 7, 3)
    assert dealt.sum(0).tolist() == [1000, 37, 0, 5]
    assert max(dealt.sum(1)) - min(dealt.sum(1)) <= 3
    assert (dealt == mixing.split(np.array([1000, 37, 0, 5]), 7, 3)).all()


def test_best_subset():
    assert sorted([5, 9, 4][i] for i in mixing.best_subset([5, 9, 4], 13)) == [4, 9]
    assert mixing.best_subset([50], 13) == []


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_taken_words_meet_targets(spark, sf):
    docs = spark.read.parquet(SF.replace("0.001", sf) + "/documents.parquet")
    rows = mixing.taken(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    of: dict = {}
    for r in rows:
        assert r["size"] == len(plain_words(r["text"])) and r["taken"] in (0, r["size"], 2 * r["size"])
        x = of.setdefault(r["source"], [0, 0, r["target"], r["source_size"], 10**9])
        x[0] += r["taken"]
        x[1] += r["size"]
        x[4] = min(x[4], r["size"])
    want = mixing.targets({s: x[1] for s, x in of.items()})
    for s, x in of.items():
        assert x[1] == x[3] and x[2] == pytest.approx(want[s])
    off = sum(abs(x[0] - x[2]) for x in of.values()) / sum(x[2] for x in of.values())
    assert off < 0.03


def level_targets(sizes):
    """Targets by bisection of the level at which weights meet 150 % of all sizes."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 10.0 * sum(sizes.values()) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[s], level * weight[s]) for s in names) < 1.5 * sum(sizes.values()) else (low, level)
    return {s: min(2 * sizes[s], high * weight[s]) for s in names}


def test_every_source_meets_its_target(spark):
    """Targets against a second computation, and what each source takes against its own target and passes."""
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    text = {(r["doc_id"], r["source"]): len(plain_words(r["text"])) for r in docs.collect()}
    sizes: dict = {}
    for (_, s), n in text.items():
        sizes[s] = sizes.get(s, 0) + n
    want, took = level_targets(sizes), {}
    for r in mixing.taken(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        s, n = r["source"], text[r["doc_id"], r["source"]]
        assert (r["size"], r["source_size"]) == (n, sizes[s]) and r["target"] == pytest.approx(want[s])
        passes = int(want[s] // sizes[s])
        assert r["taken"] in (passes * n, (passes + 1) * n) and r["taken"] <= 2 * n
        took[s] = took.get(s, 0) + r["taken"]
    for s, n in took.items():
        assert n <= want[s] + 1e-6 and want[s] - n <= max(0.02 * want[s], min(x for (_, o), x in text.items() if o == s and x))


@pytest.mark.parametrize("shards", [1, 7, 300])
def test_ranks_are_dealt_as_the_whole_tree_does(spark, monkeypatch, shards):
    monkeypatch.setattr(mixing, "NODES", 5)
    quotas = np.array([1000, 37, 0, 5])
    rows = [tuple(r) for r in mixing.dealt_ranks(spark, quotas, shards, 3).collect()]
    assert sorted((k, r) for k, r, _ in rows) == [(k, r) for k, n in enumerate(quotas) for r in range(1, n + 1)]
    counts = np.zeros((shards, 4), np.int64)
    for k, _, shard in rows:
        counts[shard, k] += 1
    assert (counts == mixing.split(quotas, shards, 3)).all()
    for k in range(4):  # consecutive in the permutation
        of = [s for _, s in sorted((r, s) for kk, r, s in rows if kk == k)]
        assert of == sorted(of)


def test_mix_of_hostile_documents(spark):
    df = documents(spark, hostile() * 2)
    taken = mixing.taken(df, shards=4)
    assert taken.count() == 2 * len(hostile())
    assert taken.filter("taken > 2 * size").count() == 0
    mix = mixing.mixed(df, shards=4)
    assert set(mix.columns) == set(df.columns) | {"copy", "shard", "position"}
    assert mix.count() == taken.agg(F.sum("copies")).first()[0]
    again = mixing.mixed(df.repartition(3), shards=4)
    key = ["doc_id", "text", "copy", "shard"]
    assert sorted(map(repr, mix.select(key).collect())) == sorted(map(repr, again.select(key).collect()))
    assert mixing.mixed(documents(spark, []), shards=4).count() == 0 and mixing.taken(documents(spark, [])).count() == 0


def test_sources_draw_different_blocks_in_every_shard(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    mix = mixing.mixed(docs, shards=8)
    assert mix.groupBy("doc_id", "copy").count().filter("count > 1").count() == 0
    sizes = [r["count"] for r in mix.groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(1))


@pytest.mark.parametrize("block", [2_000_000, 200])
def test_contained_items_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", block)
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    rows = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    long_item = " ".join(plain_words(docs[0][1])[:300])
    rows += [(900, None), (901, " "), (902, "one two"), (903, long_item), (903, long_item), (None, rows[0][1])]
    found = decontaminate.contained_items(documents(spark, docs), items(spark, rows))
    assert {tuple(r) for r in found.collect()} == contained(docs, rows)


def test_items_shorter_than_a_shingle_are_found_inside_texts(spark):
    docs = [(1, "what is the capital of france today"), (2, "capital  of\nfrance"), (3, "capital of"), (4, "the of capital france"), (5, "paris"), (6, "in paris, yes"), (7, "so Paris paris it is"), (8, None)]
    rows = [(1, "capital of france"), (2, "paris"), (3, "so paris"), (4, "is the capital of"), (5, "capital of france")]
    found = decontaminate.contained_items(documents(spark, docs), items(spark, rows)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 1), (1, 4), (1, 5), (2, 1), (2, 5), (5, 2), (7, 2)]
    assert {(r["n_shingles"], r["n_shared"]) for r in found} == {(1, 1)}


def test_rows_of_one_id_have_one_result_an_item(spark):
    """Equal rows give one; parts of an item in two rows of an id do not add up; without an id alike."""
    text = " ".join(f"w{i}" for i in range(14))
    w = text.split()
    docs = [(1, text), (1, text), (1, "x " + " ".join(w[:13])), (2, " ".join(w[:9])), (2, " ".join(w[5:])), (None, text), (None, text)]
    found = decontaminate.contained_items(documents(spark, docs), items(spark, [(7, text)])).collect()
    assert sorted(map(tuple, found), key=repr) == [(1, 7, 10, 10), (None, 7, 10, 10)]


def test_words_made_to_collide_are_told_apart(spark):
    """Words of 1,024 letters after Thue and Morse, whose polynomial hashes modulo a power of two are equal."""
    word = ["".join("ab"[bin(i).count("1") % 2 ^ k] for i in range(1024)) for k in (0, 1)]
    docs = documents(spark, [(1, word[0]), (2, f"a b {word[0]} c d"), (3, f"a b {word[1]} c d")])
    assert decontaminate.contained_items(docs, items(spark, [(1, word[1]), (2, f"a b {word[0]} c d")])).count() == 2
    assert {c for _, c in map(tuple, near_dedup.near_classes(docs).collect())} == {1, 2, 3}


def test_leaks_of_hostile_documents(spark):
    rows = [(1, " ".join(f"word{i}" for i in range(20, 60))), (2, "one two")]
    df = documents(spark, hostile())
    kept = decontaminate.clean_documents(df, items(spark, rows))
    assert kept.columns == df.columns
    gone = {r[0] for r in contained(hostile(), rows)}
    ids = [r["doc_id"] for r in kept.collect()]
    assert gone >= {4, 5, 6, 7, 8, 13} and not gone & {i for i in ids if i is not None}
    assert ids.count(None) == 1 and len(ids) == len([1 for d, _ in hostile() if d is not None and d not in gone]) + 1
    assert decontaminate.clean_documents(df, items(spark, [])).count() == len(hostile())
    assert decontaminate.clean_documents(documents(spark, []), items(spark, rows)).count() == 0
