import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import decontaminate, gam, mixing, queries_text
from tests.llm.helpers import SF, contained, documents, near_classes, repeated_bytes


def test_stages_equal_plain_python(spark):
    """Each stage against a brute-force version on the rows that the stage before it kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near duplicates", "repeated passages", "benchmark leaks", "source mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = corpus_pipeline.written(stage(spark, docs, SF), "test")
        rows = [(r["doc_id"], r["text"]) for r in out.collect()]
        if name != "source mixing":
            assert out.columns == columns
        if name == "quality classifier":
            model = queries_text.quality_model(spark, docs, SF)
            good = model.score(gam.features_of([t for _, t in before])) >= queries_text.QUALITY_CUT
            assert sorted(rows) == sorted(r for r, g in zip(before, good, strict=True) if g) and len(rows) < len(before)
        elif name == "near duplicates":
            classes = near_classes(before)
            assert sorted(rows) == sorted(r for r in before if classes[r[0]] == r[0])
        elif name == "repeated passages":
            assert dict(rows) == {r[0]: r[5].decode("utf-8", "ignore") for r in repeated_bytes(before)}
        elif name == "benchmark leaks":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            leaks = {r[0] for r in contained(before, items, decontaminate.THRESHOLD)}
            assert sorted(rows) == sorted(r for r in before if r[0] not in leaks)
        else:
            copies = {r["doc_id"]: r["copies"] for r in mixing.taken(docs).collect()}
            assert sorted(rows) == sorted(r for r in before for _ in range(copies[r[0]]))
        kept.append(len(rows))
        docs = out
    assert kept[0] >= kept[1] and kept[1] == kept[2] >= kept[3] > 0


CLASHING = ("_quality", "score", "kept_text", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "_row", "digest", "id", "copy", "features", "a.b")


def stage_tables(spark, tmp_path):
    """A folder with labels and a benchmark, and documents with nulls everywhere, repeated rows and clashing columns."""
    r = random.Random(4)
    plain = [" ".join(f"{r.choice('abcdefg')}{r.randint(0, 400)}" for _ in range(80)) + "." for _ in range(30)]
    junk = ["### $$$ !!! ||| " * (10 + i) for i in range(12)]
    shared = " ".join(f"shared{i}" for i in range(40))
    rows = [(i, t) for i, t in enumerate(plain + junk)] + [(0, plain[0]), (None, plain[1] + " x"), (None, None), (None, plain[2]), (90, None), (91, ""), (92, "long " * 40_000)]
    rows += [(100 + i, f"{plain[i]} {shared} {plain[i + 1]}") for i in range(5)] + [(110, shared[:150] + " bench " + " ".join(f"item{i}" for i in range(12)))]
    docs = documents(spark, rows, extra=False)
    for name in CLASHING:
        docs = docs.withColumn(name, F.when(F.col("doc_id") % 2 == 0, F.lit(name)))
    spark.createDataFrame([(i, int(i < 30), 0) for i in range(42)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(12))), (2, None), (None, " ")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, rows


def test_stages_on_hostile_documents(spark, tmp_path):
    docs, rows = stage_tables(spark, tmp_path)
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "test")
        after = out.collect()
        texts = [(r["doc_id"], r["text"]) for r in after]
        at = docs.columns.index("text")
        if name == "source mixing":
            assert set(out.columns) == set(docs.columns) | {"shard", "position"} and {r["doc_id"] for r in after} <= {r[0] for r in before}
            continue
        assert out.columns == docs.columns
        for r in after:  # every other column is as it was
            assert all(r[c] == (c if r["doc_id"] is not None and r["doc_id"] % 2 == 0 else None) for c in CLASHING)
        if name == "repeated passages":
            want = [(d, None if t is None else x[5].decode("utf-8", "ignore")) for x, (d, t) in zip(repeated_bytes([(r[0], r[at]) for r in before]), [(r[0], r[at]) for r in before], strict=True)]
            assert sorted(map(repr, texts)) == sorted(map(repr, want))
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
        else:
            assert not Counter(map(repr, map(tuple, after))) - Counter(map(repr, before))
        if name == "quality classifier":
            assert not {d for d, _ in texts} & set(range(30, 42)) and {d for d, _ in texts} >= set(range(30))
        if name == "near duplicates":
            assert texts.count(rows[0]) == 2 and (None, rows[2][1]) not in texts and all((d, t) in texts for d, t in [(1, rows[1][1]), (3, rows[3][1])])
        if name == "benchmark leaks":
            assert 110 not in {d for d, _ in texts} and len(after) == len([r for r in before if r[0] != 110])
        docs = out


def test_stages_on_an_empty_table(spark, tmp_path):
    docs, _ = stage_tables(spark, tmp_path)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
