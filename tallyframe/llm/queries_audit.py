"""Driver queries of the operators that audit a corpus (personal data, manifest, sources), with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import divergence, merkle, pii
from tallyframe.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    number = lambda kind: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text with A-Z in small letters where 3 divides the checksum of the decimal doc_id, else null."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.translate(text, UPPER, LOWER))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, roots and proof of every document, and the root that follows where texts were tampered with."""
    docs = table(spark, sf_dir, "documents")
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    changed = tampered_text(F.col("doc_id"), F.col("text"))
    leaves = docs.select(
        "doc_id", "lang", merkle.digest_of(*fields(F.col("text"))).alias("leaf"),
        F.when(changed.isNotNull(), merkle.digest_of(*fields(changed))).alias("changed_leaf"),
    )
    found = merkle.manifest(leaves, group="lang", order=["doc_id"], digest="leaf")
    folded = merkle.folded(F.coalesce("changed_leaf", "leaf"), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and its most overused terms."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


#: Levels of the SQL: enough for 8 ** 7 documents of a language.
SQL_LEVELS = 7


def _merkle_sql() -> str:
    """Bottom up, a pair of steps a level: the siblings and the parent of every node; a node alone in its group stays as it is."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(value, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    checksum = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"""
    steps = [f"""d AS (SELECT *, {leaf('text')} AS leaf, CASE WHEN {checksum} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents)""",
      "n0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM d)",
      "s0 AS (SELECT row_number() OVER () AS r, doc_id, lang, leaf, coalesce(changed, leaf) AS fold, k, leaf AS digest, '' AS proof FROM n0)"]
    for i in range(2 * SQL_LEVELS):
        group = "lang" if i < SQL_LEVELS else "1"
        if i == SQL_LEVELS:  # the subroots become the leaves of the last tree
            steps.append(f"s{i}b AS (SELECT r, doc_id, lang, leaf, fold, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, digest, proof, digest AS subroot FROM s{i})")
        at = f"s{i}b" if i == SQL_LEVELS else f"s{i}"
        keep = ", subroot" if i >= SQL_LEVELS else ""
        steps += [
            f"g{i} AS (SELECT lang, k, digest, max(k) OVER (PARTITION BY {group}) AS last FROM (SELECT DISTINCT {'lang' if i < SQL_LEVELS else 'NULL AS lang'}, k, digest FROM {at}))",
            f"p{i} AS (SELECT lang, k // 8 AS run, max(last) AS last, list(digest ORDER BY k) AS kids FROM g{i} GROUP BY ALL)",
            f"""s{i + 1} AS (SELECT r, doc_id, s.lang, leaf, CASE WHEN last = 0 THEN fold ELSE sha256(array_to_string(kids[:k % 8], '') || fold || array_to_string(kids[k % 8 + 2:], '')) END AS fold, k // 8 AS k,
  CASE WHEN last = 0 THEN digest ELSE sha256(array_to_string(kids, '')) END AS digest,
  CASE WHEN last = 0 THEN proof ELSE proof || array_to_string(kids[:k % 8], '') || array_to_string(kids[k % 8 + 2:], '') END AS proof{keep}
  FROM {at} s JOIN p{i} p ON {'s.lang IS NOT DISTINCT FROM p.lang AND ' if i < SQL_LEVELS else ''}s.k // 8 = p.run)""",
        ]
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = digest AS verified FROM s{2 * SQL_LEVELS}"


ORACLE_13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT r, lang, source, unnest(words) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN v USING (lang, term) GROUP BY ALL),
s AS (SELECT DISTINCT lang, source FROM d), k AS (SELECT lang, count(*) AS v, sum(n) AS total FROM v GROUP BY lang),
x AS (SELECT lang, source, term, coalesce(c.n, 0)::HUGEINT AS n FROM s JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // ((sum(n) OVER (PARTITION BY lang, source))::HUGEINT + 5 * k.v) AS p FROM x JOIN k USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000 * (n::HUGEINT + 5)) // (total::HUGEINT + 5 * k.v) AS q FROM v JOIN k USING (lang)),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""

QUERIES = {"op11_pii": op11_pii, "op12_merkle_manifest": op12_merkle_manifest, "op13_source_divergence": op13_source_divergence}
ORACLES = {"op12_merkle_manifest": _merkle_sql(), "op13_source_divergence": ORACLE_13}
