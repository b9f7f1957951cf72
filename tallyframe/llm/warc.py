"""WARC archives: written from pages, indexed first, read back by coalesced byte ranges.

Writing: every task streams its pages into gzip-per-record archives in a shared folder and returns one
index row (file, offset, length, url, digest, ...) per record. File names carry the task attempt, and only
the index rows of committed tasks are kept, so a lost executor leaves at most an orphan file that no index
row names. Records with equal payloads of at least `min_revisit_bytes` bytes are stored once: the one with
the smallest page_id is a response, the others are revisits that name it.

Reading: the selected index rows are dealt by file and stretch of file, sorted by offset, and neighbouring
ranges are joined into single reads of bounded size.

Cases: null html is an empty payload; a null url is written as `urn:unknown`; equal page_ids with equal
payloads are all responses if theirs is the smallest id; a null page_id is never the smallest; an empty
table gives an empty index. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import new_folder, small_batches, written

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "payload binary"
)
FILE_BYTES, STRETCH, GAP, READ_BYTES = 1 << 30, 64 << 20, 64 << 10, 8 << 20
#: Most groups of equal payloads that are broadcast (some 20 MB), and tasks that share the pages of one group beyond that.
BROADCAST_GROUPS, SALTS = 200_000, 32
DATE = "1970-01-01T00:00:00Z"  # archives of a rerun are equal, byte for byte


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, digest: str, size: int, refers_to=None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head of its payload but no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else 'urn:unknown'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict, dict, bytes]:
    """WARC headers, HTTP headers and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _gzip(raw: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _int(value):
    return None if pd.isna(value) else int(value)


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) with refers_to: the page whose equal payload is stored, null for responses.

    Equal payloads are found by SHA-1 and counted with partial aggregation. The groups of two or more are written to the
    shared folder and counted: up to BROADCAST_GROUPS of them (some 100 bytes each) are broadcast, so no html is shuffled;
    more are joined under SALTS keys a group, so that the pages of one payload are dealt over as many tasks. html of
    revisits goes no further.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = small_batches(pages).select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha"))
    groups = (
        keyed.filter(F.octet_length("html") >= min_revisit_bytes)
        .groupBy("sha")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .filter("copies > 1 and first_id is not null")
        .select("sha", "first_id")
    )
    groups = written(groups, "warc-groups")
    if groups.count() <= BROADCAST_GROUPS:
        joined = keyed.join(F.broadcast(groups), "sha", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", salt).join(salted, ["sha", "salt"], "left").drop("salt")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.select(
        "page_id", "url", "sha", F.octet_length("html").cast("long").alias("size"), refers.alias("refers_to"),
        F.when(refers.isNull(), F.col("html")).alias("html"),
    )


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, level: int = 4) -> DataFrame:
    """Writes archives of pages(page_id, url, html) to a shared folder; returns the stored index."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, sha, size, refers_to, html in batch.itertuples(index=False):
                    if out is None or offset >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    digest, page_id, refers_to = base64.b32encode(bytes.fromhex(sha)).decode(), _int(page_id), _int(refers_to)
                    url = None if pd.isna(url) else url
                    raw = record_bytes(page_id, url, (html or "").encode() if refers_to is None else b"", digest, size, refers_to)
                    packed = _gzip(raw, level)
                    out.write(packed)
                    kind = "response" if refers_to is None else "revisit"
                    rows.append((name, offset, len(packed), page_id, url, digest, kind))
                    offset += len(packed)
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")]).astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    index = with_revisits(pages, min_revisit_bytes).mapInPandas(write, INDEX)
    return written(index, "warc-index").withColumn("folder", F.lit(folder))


def read_records(index: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records that index rows name. Payloads of responses are checked against their digests."""

    def ranges(rows):
        """Neighbouring index rows (sorted by file and offset), joined while the gap and the read stay small."""
        run, stop = [], 0
        for row in rows:
            if run and (row.folder != run[0].folder or row.file != run[0].file or row.offset - stop > GAP or row.offset + row.length - run[0].offset > READ_BYTES):
                yield run
                run = []
            run.append(row)
            stop = row.offset + row.length
        if run:
            yield run

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        stores: dict = {}
        for batch in batches:
            for run in ranges(batch.itertuples(index=False)):
                if (folder := run[0].folder) not in stores:
                    stores[folder] = fs.FileSystem.from_uri(folder)
                store, path = stores[folder]
                with store.open_input_file(f"{path}/{run[0].file}") as f:
                    f.seek(run[0].offset)
                    data = f.read(run[-1].offset + run[-1].length - run[0].offset)
                rows = []
                for row in run:
                    at = row.offset - run[0].offset
                    warc, http, payload = parse_record(zlib.decompress(data[at : at + row.length], 31))
                    digest, kind, size = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"], int(http["Content-Length"])
                    if kind == "response" and (sha1_base32(payload) != digest or len(payload) != size):
                        raise ValueError(f"{row.file} at {row.offset}: the payload does not match its digest")
                    ids = [re.search(r"urn:page:(-?\d+|null)", warc.get(k, "null")) for k in ("WARC-Record-ID", "WARC-Refers-To")]
                    page_id, refers_to = (None if m is None or m[1] == "null" else int(m[1]) for m in ids)
                    rows.append((page_id, row.url, size, digest, kind, refers_to, payload if keep_payload and kind == "response" else None))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # index rows are small, their reads are not
    dealt = index.withColumn("stretch", F.floor(F.col("offset") / STRETCH)).repartition(tasks, "folder", "file", "stretch")
    return dealt.sortWithinPartitions("folder", "file", "offset").select("folder", "file", "offset", "length", "url").mapInPandas(read, RECORD)
