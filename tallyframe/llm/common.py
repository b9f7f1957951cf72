"""Helpers that the training-data operators share: tables, the shared folder, written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = "[ \\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local_dirs: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). A local one stands in for it where none is set and
    the session runs in one process; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return _local_dirs[app]


def new_folder(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_intermediates(spark: SparkSession) -> int:
    """Deletes what the operators wrote to the shared folder in this application (archives without a folder of their own
    included) and returns the number of folders; results not yet computed can no longer be."""
    from pyarrow import fs

    gone = 0
    for path in _made.pop(spark.sparkContext.applicationId, []):
        store, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        if store.get_file_info(name).type != fs.FileType.NotFound:
            store.delete_dir(name)
            gone += 1
    return gone


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch that goes to Python, so that a worker's memory does not depend on the length of texts.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to BATCH_BYTES (a smaller setting stays as it is). The setting has to
    outlive this call, as Spark reads it when a plan runs."""
    conf = df.sparkSession.conf
    now = conf.get(BATCH_SETTING).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def words_of(text):
    """Array of the words of a text column; empty for null and blank texts. JVM only."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANK_CLASS}+|{BLANK_CLASS}+$", "")
    return F.when(kept == "", F.array().cast("array<string>")).otherwise(F.split(kept, f"{BLANK_CLASS}+"))


def n_words_of(text):
    """Number of words of a text column (null: 0), without building them."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\x09-\\x0D]+")), F.lit(0)).cast("long")
