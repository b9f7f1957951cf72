"""A corpus pipeline of five operators: quality, near duplicates, repeated passages, benchmark leaks, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. `run` writes each stage's result as Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, gam, mixing, near_dedup, queries_text, substring_dedup
from tallyframe.llm.common import table, written


def aside(docs: DataFrame) -> DataFrame:
    """(_doc, doc_id, text): whole rows as one struct beside what an operator reads, so that no column name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "doc_id", "text")


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs from rows(_doc, ...), some of them changed."""
    return rows.select(*[changed.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the labelled ones among them, accepts.

    Null and empty texts are scored as any other; a null doc_id has no label but a score; repeated rows are judged alike; with no
    label in the table every document gets the smoothed share and stays; an empty table gives an empty result; other columns,
    whatever their names, pass through.
    """
    scored = gam.with_score(aside(docs), queries_text.quality_model(spark, docs, sf_dir))
    return unpacked(scored.filter(F.col("score") >= queries_text.QUALITY_CUT), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    Texts without words (null, empty, blank) all stay; rows equal in doc_id and text are one document and stay or go together; of
    equal texts without a doc_id one row stays; ties in doc_id are broken by the text's digest; an empty table gives an
    empty result; other columns pass through.
    """
    return near_dedup.near_deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes under repeated 200-byte strings; n_chars, where there is such a column, is counted anew.

    A null text stays null, an empty one empty; every row stays, also when nothing of its text is left; equal rows lose what
    they repeat, each of them; bytes of a character that a cut splits are dropped; an empty table gives an empty result;
    other columns, whatever their names, pass through.
    """
    cut = substring_dedup.deduplicated(aside(docs))
    return unpacked(cut, docs, text=F.col("kept_text"), n_chars=F.length("kept_text").cast("long"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none; null and repeated doc_ids are judged row by row; a null or blank item is in nothing; an
    empty table, or an empty benchmark, gives all rows it has; other columns pass through.
    """
    return unpacked(decontaminate.clean_documents(aside(docs), table(spark, sf_dir, "benchmark")), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken, with copy, shard and position (columns of these names are replaced).

    Null and empty texts have size 0 and go with their block; a null source is a source, the last one; equal rows are taken each;
    an empty table gives an empty result; other columns pass through.
    """
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark leaks", benchmark_leaks),
    ("source mixing", source_mix),
]

#: Minwise hashing, suffix sorting and a fitted classifier have no SQL; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; returns the mix."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
