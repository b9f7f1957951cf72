"""Driver queries of the operators that compare documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import decontaminate, mixing, near_dedup, substring_dedup
from tallyframe.llm.common import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.taken(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op2_dartminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dedup.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def near_dedup_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by weighted similarity: a shingle weighs as often as it occurs in its text."""
    return near_dedup.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), weighted=True)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes under repeated 200-byte strings removed from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.deduplicated(docs).drop("kept_text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with the shingles they share."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_8 = r"""
WITH v AS (SELECT item_id, words, least(5, len(words)) AS k FROM (SELECT item_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM benchmark) WHERE len(words) > 0),
b AS (SELECT DISTINCT item_id, k, array_to_string(words[i:i+k-1], ' ') AS s FROM (SELECT item_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM v)),
n AS (SELECT item_id, k, count(*) AS n_shingles FROM b GROUP BY ALL),
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents),
d AS (SELECT DISTINCT r, doc_id, k, array_to_string(words[i:i+k-1], ' ') AS s FROM
  (SELECT r, doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM v) WHERE len(words) >= k)),
f AS (SELECT r, doc_id, item_id, n_shingles, count(*) AS n FROM d JOIN b USING (k, s) JOIN n USING (item_id, k) GROUP BY ALL HAVING count(*) >= 0.8 * n_shingles)
SELECT doc_id, item_id, n_shingles, max(n) AS n_shared FROM f GROUP BY ALL
"""

QUERIES = {
    "op1_source_mixing": op1_source_mixing, "op2_dartminhash_near_dedup": op2_dartminhash_near_dedup,
    "near_dedup_weighted": near_dedup_weighted,
    "op5_suffix_array_dedup": op5_suffix_array_dedup, "op8_decontamination": op8_decontamination,
}
ORACLES = {"op8_decontamination": ORACLE_8}
