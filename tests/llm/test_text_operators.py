import base64
import hashlib
import math
import random
import re
import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import chat, gam, licenses, quality_rules, token_count, warc
from tests.llm.helpers import SF, documents, hostile, plain_words

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    texts = [t for _, t in hostile()] + [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    texts += ["ΑΣ ΑΣΑ", "a<|endoftext|>b<|startoftext|>", "don't we'll I'M", "a\x1cb c", "ＡＢ é Å", "q" * 5000]
    df = documents(spark, list(enumerate(texts)))
    got = {r[0]: r[1] for r in token_count.with_token_count(df, path).select("doc_id", "n_tokens").collect()}
    assert [got[i] for i in range(len(texts))] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert token_count.with_token_count(documents(spark, []), path).count() == 0


def test_token_counts_of_strings_from_all_planes():
    """Strings over every plane, letters of later Unicode versions and the word ends of the pattern among them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, count = tokenizers.Tokenizer.from_file(path), token_count.text_counter(token_count.load_vocabulary(path))
    r = random.Random(5)

    def any_character():
        code = r.randrange(0x20, r.choice([0x80, 0x600, 0x3000, 0x11000, 0x20000, 0x40000, 0x110000]))
        return chr(code) if not 0xD800 <= code < 0xE000 else "'"

    texts = ["".join(any_character() for _ in range(r.randint(1, 12))) for _ in range(12_000)]
    texts += ["\u041d\u0558", "\u20a4'S", "\U00010952'S", "1\u1c89's", "\ua7cb\ua7ce", "\U00010d50 \U00016ea0x", "\U000113c2\U000113c2"]
    texts += [f"{a}{chr(c)}'s" for a in "a#1" for c in range(0x80, 0x34000, 97) if not 0xD800 <= c < 0xE000]
    assert [count(t) for t in texts] == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def plain_base(text):
    w = plain_words(text)
    lines = [x for x in (text or "").split("\n") if plain_words(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(grams) < 2000 else None
    if covered is None:
        from collections import Counter

        seen = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    n, repeats = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeats, n < 10 or 100 * repeats > 20 * n


def test_base_counts_equal_plain_python(spark):
    rows = hostile() + duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = quality_rules.with_base(documents(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((d, *plain_base(t))) for d, t in rows)
    assert "Python" not in got._jdf.queryExecution().toString()


def test_cascade_order_and_verdict(spark):
    df = quality_rules.with_base(documents(spark, hostile()))
    rules = quality_rules.default_rules()
    order = quality_rules.ordered_rules(df, rules, sample_rows=10)
    assert {r.name for r in order} == {r.name for r in rules}
    kept = [{r["doc_id"] for r in quality_rules.apply_cascade(df, o, F.col("base_failed")).filter("failed_rule is null").collect()} for o in (order, order[::-1])]
    assert kept[0] == kept[1] and 6 in kept[0] and 14 not in kept[0]
    assert quality_rules.ordered_rules(df.limit(0), rules)


def test_cascade_judges_a_rule_on_what_the_others_let_through():
    """b rejects most of all, but nearly nothing that a, three times as cheap, lets through."""
    patterns = [(frozenset("ab"), 90), (frozenset("b"), 5), (frozenset("c"), 30), (frozenset(), 100)]
    assert quality_rules.best_order({"a": 1.0, "b": 3.0, "c": 3.0}, patterns) == ["a", "c", "b"]
    assert quality_rules.best_order({"b": 0.0, "a": -1.0}, []) == ["a", "b"]
    assert quality_rules.best_order({}, patterns) == []


def test_costs_and_order_are_the_same_again(spark):
    """A rule that matches backwards over whole texts against rules on counts."""
    text = "some words of a line, and more of them " * 60
    sample = quality_rules.with_base(spark.range(400).select(F.concat(F.lit(text), "id").alias("text"))).repartition(4).cache()
    slow = quality_rules.Rule("slow", F.length(F.regexp_replace("text", "(\\w+) (\\w+)$|[^\\p{Lu}]", "")) < 0)
    rules = [slow, *[quality_rules.Rule(f"free{i}", F.col("n_words") < i) for i in range(3)]]
    first, again = (quality_rules.row_costs(sample, rules, 400) for _ in range(2))
    assert first["slow"] > 4 * quality_rules.LEAST_COST and max(first[f"free{i}"] for i in range(3)) < first["slow"]
    order = [quality_rules.best_order(c, [(frozenset({"slow"}), 40), (frozenset({"free1"}), 30), (frozenset({"free2"}), 5), (frozenset(), 300)]) for c in (first, again)]
    assert order[0] == order[1] and order[0][:2] == ["free1", "free2"]
    sample.unpersist()


def test_tables_and_stutters_are_rejected(spark):
    r = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    rows = [(1, " ".join(r)), (2, " | ".join(" ".join(r[i : i + 2]) for i in range(0, 12, 2))), (3, " ".join(w for w in r[:6] for _ in range(2))), (4, " ".join([*r, *r[:1], *r[:1], *r[:1]]))]
    df = quality_rules.with_base(documents(spark, rows))
    got = {x["doc_id"]: x["failed_rule"] for x in quality_rules.apply_cascade(df, quality_rules.default_rules(), F.col("base_failed")).collect()}
    assert got == {1: None, 2: "bars", 3: "stutter", 4: None}


def test_sample_reads_some_files_only(spark, tmp_path):
    path = f"file://{tmp_path}/many files"
    spark.range(100).withColumn("text", F.lit("x")).repartition(10).write.parquet(path)
    scan = spark.read.parquet(path)
    some = quality_rules.some_files(scan, 3)
    assert 0 < some.count() < 100 and len({r[0] for r in some.select("_metadata.file_path").collect()}) == 3
    assert quality_rules.some_files(scan, 10).count() == 100 and quality_rules.some_files(documents(spark, hostile())).count() == len(hostile())


def test_licences(spark):
    mit = licenses.LICENSES["MIT"]
    odd = mit.replace("Copyright (c) <year> <copyright holders>", "COPYRIGHT 2020 Somebody\n(c) Else").replace(", ", " ,\n ").upper()
    rows = [(1, mit), (2, odd), (3, mit + " extra"), (4, "x\nReleased under the MIT Licence!\ny\nLicensed under CC BY-NC 4.0."), (5, None), (6, ""), (7, "Copyright me"), (1, mit)]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert [got[i]["license"] for i in range(1, 8)] == ["MIT", "MIT", None, None, None, None, None]
    assert got[4]["notices"] == "CC-BY-NC-4.0,MIT" and got[7]["text_digest"] is None and got[3]["text_digest"] is not None
    assert licenses.scan(documents(spark, rows)).count() == 8
    assert licenses.scan(documents(spark, [])).count() == 0
    nothing = spark.createDataFrame([], "license string, text string")
    assert licenses.scan(documents(spark, rows), nothing, nothing).filter("license is not null or notices <> ''").count() == 0


def test_the_full_table_knows_whole_licences_headers_and_two_word_spellings(spark):
    full, notices = licenses.full_licenses(spark), licenses.full_notices(spark)
    texts = {n: t for n, t in full.collect()}
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    mit = licenses.LICENSES["MIT"]
    header = "# Copyright 2020 Somebody\n#\n" + "\n".join(f"# {x}" for x in next(iter(licenses.HEADERS)).replace("except in", "except\nin").split("\n")) + "\n#\n#     http://x\n\nimport os"
    rows = [*enumerate(texts[n] for n in names), (20, mit.replace("sublicense", "sub-license")), (21, header), (22, mit.partition("\n\n")[2])]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, rows), full, notices).collect()}
    assert [got[i]["license"] for i in range(len(names))] == names
    assert (got[20]["license"], got[22]["license"]) == ("MIT", "MIT")
    assert got[21]["notices"] == "Apache-2.0" and got[21]["license"] is None
    plain = {r["doc_id"]: r["text_digest"] for r in licenses.scan(documents(spark, rows)).collect()}
    assert plain == {i: r["text_digest"] for i, r in got.items()} and plain[20] != plain[22]


def wrapped(text, width):
    """Paragraphs filled to a width as editors do, but for those with copyright lines; British spellings and odd case."""
    blocks = []
    for block in re.split(r"\n[ \t]*\n", text):
        keep = re.search(r"(?m)^\W*(copyright|\(c\)|all rights)", block.lower())
        blocks.append(block if keep else textwrap.fill(" ".join(block.split()), width, break_long_words=False, break_on_hyphens=False))
    return re.sub(r"\b(sub)?license([sd]?)\b", r"\1licence\2", "\n\n".join(blocks)).replace("MERCHANTABILITY", "Merchantability")


@pytest.mark.parametrize("width", [72, 60])
def test_every_known_licence_is_found_in_its_usual_line_breaks(spark, width):
    full, notices = licenses.full_licenses(spark), licenses.full_notices(spark)
    known = [tuple(r) for r in full.collect()]
    one_line = [("ISC", " ".join(licenses.LICENSES["ISC"].partition("\n\n")[2].partition("\n\n")[2].split()))]
    rows = [(i, "Copyright (C) 1999, 2004 Somebody <a@b.c>\n" * (i % 2) + wrapped(t, width)) for i, (_, t) in enumerate(known)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(documents(spark, rows), full.unionByName(spark.createDataFrame(one_line, full.schema)), notices).collect()}
    same = {r["digest"]: r["license"] for r in licenses.known_digests(full).collect()}
    assert set(same.values()) == {n for n, _ in known}
    assert [(i, name) for i, (name, _) in enumerate(known) if got[i] != name] == []


def test_lines_of_a_clause_that_begin_with_copyright_stay(spark):
    clause = "Copyright notice and this permission notice appear in all copies.\n"
    lines = ["Copyright (c) <year>", "Copyright 2020 X", "copyright by Y", "# (C) Z", "© W", "Copyright Foo Bar, Inc.", "All rights reserved.", "(c) 2001 V and many others by name"]
    rows = [(0, clause), *((i, f"{x}\n{clause}") for i, x in enumerate(lines, 1)), (20, "(c) You must retain, in the source form, all notices\n" + clause)]
    got = {r["doc_id"]: r["text_digest"] for r in licenses.scan(documents(spark, rows)).collect()}
    assert got[0] is not None and {got[i] for i in range(len(lines) + 1)} == {got[0]} and got[20] != got[0]


MESSAGES = [
    (1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "a<\\|b <\\\\| <| |> tail<"), (1, 1, "assistant", "tie"), (2, 0, "odd\\role\n<|im_end|>", None),
    (2, None, None, "\n\n"), (None, 0, "assistant", "x" * 5000), (3, 0, "user", "same"), (3, 0, "user", "same"),
]


@pytest.mark.parametrize("part_chars", [4_000_000, 10])
def test_chat_round_trip(spark, monkeypatch, part_chars):
    monkeypatch.setattr(chat, "PART_CHARS", part_chars)
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    nulls_first = lambda x: (x is not None, x or 0) if not isinstance(x, str) else (True, x)
    for conv in (1, 2, 3, None):
        turns = sorted((m for m in MESSAGES if m[0] == conv), key=lambda m: tuple(map(nulls_first, m[1:])))
        whole = hashlib.sha256("".join(f"{m[2] or ''}\n{m[3] or ''}\n" for m in turns).encode()).hexdigest()
        loss = "".join(m[3] or "" for m in turns if m[2] == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(turns), whole)
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_parts(spark):
    parts = [
        {"type": "text", "text": "see <"}, {"type": "text", "text": "|image|> "}, {"type": "image", "ref": "a.png", "width": 56, "height": 29},
        {"type": "audio", "ref": "b.wav", "seconds": 2.0}, {"type": "document", "ref": "c.pdf", "pages": 3},
    ]
    rows = [(1, 0, "user", "unused", [tuple(p.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")) for p in parts])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {chat.PARTS_TYPE}")
    got = chat.format_conversations(df).first()
    assert got["formatted"] == "<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|document|><|im_end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in got["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 50), ("document", "c.pdf", 768)]
    assert all(got["formatted"][a["at"] :].startswith(f"<|{a['kind']}|>") for a in got["attachments"])
    assert got["expanded_tokens"] == 822


def test_typed_parts_read_back(spark):
    text = ("text", "a <|audio|> b", None, None, None, None, None)
    rows = [(1, 0, "user", None, [text, ("audio", None, "x", None, None, 0.5, None)]), (1, 1, "assistant", "t", None), (2, 0, "user", "u", [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {chat.PARTS_TYPE}")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert (got[1]["n_attachments"], got[1]["n_placeholders"], got[1]["expanded_tokens"], got[1]["loss_chars"]) == (1, 1, 13, 1)
    assert (got[2]["n_attachments"], got[2]["n_placeholders"], got[2]["expanded_tokens"]) == (0, 0, 0)
    moved = chat.format_conversations(df).withColumn("attachments", F.expr("transform(attachments, a -> named_struct('kind', a.kind, 'ref', a.ref, 'at', a.at + 1, 'tokens', a.tokens))"))
    with pytest.raises(Exception, match="placeholder"):
        chat.read_back(moved).collect()


PAGES = [(5, "http://a/ü b", "same"), (3, None, "same"), (9, "u", None), (8, "u", ""), (7, "v", "<p>é\r\n\r\nWARC/1.1</p>" * 500), (None, "w", "same"), (1, "x", "tiny"), (1, "x", "tiny")]


@pytest.mark.parametrize("least, broadcast", [(0, 200_000), (100, 200_000), (0, 0)])
def test_warc_round_trip(spark, monkeypatch, least, broadcast):
    """Groups of equal payloads are broadcast, or joined under salted keys."""
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", broadcast)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha", F.lit("x"))
    index = warc.write_archives(df, min_revisit_bytes=least)
    got = warc.read_records(index).collect()
    assert len(got) == len(PAGES)
    want = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        revisit = len(raw) >= least and len([1 for _, _, h in PAGES if (h or "") == (html or "")]) > 1 and page != min(same)
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert sorted(map(repr, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(repr, want))
    whole = {r["page_id"]: bytes(r["payload"]) for r in got if r["payload"] is not None}
    assert whole[7] == PAGES[4][2].encode()
    some = index.filter("page_id = 7")
    assert warc.read_records(some).count() == 1
    assert warc.read_records(warc.write_archives(df.limit(0))).count() == 0


def test_warc_files_are_gzip_members(spark, tmp_path):
    import gzip

    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(df, f"file://{tmp_path}/w").collect()
    text = b"".join(gzip.open(f"{tmp_path}/w/{name}").read() for name in {r["file"] for r in index})
    assert text.count(b"WARC/1.1\r\n") == len(PAGES)


def test_classifier_on_held_out_labels(spark):
    from tallyframe.llm.queries_text import op10_quality_classifier

    folder = SF.replace("0.001", "0.01")
    scored = op10_quality_classifier(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    ordered = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert ordered > 0.97
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def added_one_by_one(model, row):
    """A score by plain sums: the table entry of each feature's bin, then those of the pairs."""
    def bin_of(k):
        return sum(1 for e in model.edges[k] if e <= row[k])

    raw = model.intercept + sum(table[bin_of(k)] for k, table in enumerate(model.tables))
    raw += sum(cells[bin_of(i)][bin_of(j)] for (i, j), cells in zip(model.pairs, model.pair_tables, strict=True))
    return 1 / (1 + math.exp(-raw))


def test_scores_are_sums_of_table_entries(spark):
    """op10's rows against lookups added one by one, with the hold-out and the cut of the contract."""
    import zlib

    from tallyframe.llm import queries_text

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    model = queries_text.quality_model(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert model.pairs
    got = {r["doc_id"]: r for r in queries_text.op10_quality_classifier(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        want = added_one_by_one(model, gam.text_features(text))
        assert got[doc_id]["score"] == pytest.approx(want, abs=1e-9)
        assert got[doc_id]["predicted"] == int(got[doc_id]["score"] >= 0.3) and got[doc_id]["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)


def test_shared_folder_and_intermediates(spark):
    from tallyframe.llm import common

    before = spark.conf.get("spark.checkpoint.dir", None)
    common.written(spark.range(3), "kept-for-now")
    assert common.remove_intermediates(spark) >= 1 and common.remove_intermediates(spark) == 0
    assert spark.conf.get("spark.checkpoint.dir", None) == before


def test_classifier_cases(spark):
    df = documents(spark, hostile())
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, label int")
    model = gam.fit_quality(df, labels)
    assert {r["score"] for r in gam.with_score(df, model).select("score").collect()} == {0.5}
    labels = spark.createDataFrame([(i, int(i in (6, 7, 8, 13))) for i in range(1, 17)] + [(6, 1), (6, 0)], "doc_id long, label int")
    model = gam.fit_quality(df, labels, max_rows=100)
    scores = [r["score"] for r in gam.with_score(df, model).collect()]
    assert len(scores) == len(hostile()) and all(0 <= s <= 1 for s in scores)
    assert gam.with_score(documents(spark, []), model).count() == 0
    assert gam.fit_quality(documents(spark, []), labels).score(gam.features_of(["x"]))[0] == 0.5


def test_rows_of_a_labelled_id_are_bounded(spark, monkeypatch):
    sizes = []
    fit = gam.AdditiveModel.fit
    monkeypatch.setattr(gam.AdditiveModel, "fit", lambda self, x, y: sizes.append(len(x)) or fit(self, x, y))
    rows = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    gam.fit_quality(rows, spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, label int"), max_rows=20)
    assert sizes == [20]
