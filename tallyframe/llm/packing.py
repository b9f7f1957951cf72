"""Texts compressed one by one before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tallyframe.llm.common import small_batches


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed before they are shuffled."""
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        texts = batch.column("text").fill_null("").cast(pa.large_binary())
        raw = [x.as_buffer() for x in texts]
        packed = pa.array([codec.compress(x, asbytes=True) if x.size else b"" for x in raw], pa.binary())
        columns = [packed if n == "text" else batch.column(n) for n in batch.schema.names]
        yield pa.record_batch([*columns, pa.array([x.size for x in raw], pa.int64())], names=[*batch.schema.names, "n_bytes"])


def packed_documents(keyed: DataFrame) -> DataFrame:
    fields = [StructField(f.name, BinaryType() if f.name == "text" else f.dataType) for f in keyed.schema]
    return small_batches(keyed).mapInArrow(_packed, StructType([*fields, StructField("n_bytes", LongType())]))


def unpacked(blob: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(blob, size, asbytes=True) if size else b""
