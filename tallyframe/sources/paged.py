"""Paged tables as a Spark source: sheets kept as pages of text cells, and hosted tables read page by page over HTTP.

A page is a partition (in large sheets a part of many pages is), the header row gives the columns, and filters reach the
source: pages of a sheet whose bounds rule a filter out are not read, hosted tables get it as part of the request. Register once: `register(spark)`, then
`spark.read.format("sheet_pages").load(folder)` and `spark.read.format("hosted_pages").option("url", ...).load()`.
"""

from __future__ import annotations

import itertools
import json
import math
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

INDEX = "index/index.json"
#: The index of sheets whose index named every page itself.
FLAT_INDEX = "index.json"
#: Pages that a part of the index names at most.
PART_PAGES = 100
#: Pages up to which each is a partition; above, the parts that a filter leaves are, and their tasks choose the pages.
PLANNED_PAGES = 200
#: Rows of a page unless said otherwise. Fixed value: that of the hosted service.
PAGE_ROWS = 1_000
# Comparison signs in requests.
SIGNS = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "gte", LessThan: "lt", LessThanOrEqual: "lte"}


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SheetPages)
    spark.dataSource.register(HostedPages)


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else path.replace("file:", "file://", 1))


def _bounds(cells: Iterable[str]) -> tuple[bool | None, list | None]:
    """(whether all cells that are not empty are numbers, their bounds); bounds are [] where not known."""
    found = [c for c in cells if c != ""]
    if not found:
        return None, None
    try:
        numbers = list(map(float, found))
    except ValueError:
        return False, [min(found), max(found)]
    return True, [] if any(map(math.isnan, numbers)) else [min(numbers), max(numbers)]


def _joint(kinds: Sequence[bool | None]) -> bool | None:
    """Whether a column is a number on all of several pages, of which those of None are empty."""
    return False if False in kinds else True if True in kinds else None


def _summary(pages: Sequence[dict]) -> dict:
    """Kinds and bounds of several pages together."""
    numeric, bounds = [], []
    for kinds, found in zip(zip(*(p["numeric"] for p in pages), strict=True), zip(*(p["bounds"] for p in pages), strict=True), strict=True):
        known = [b for b in found if b is not None]
        mixed = [] in known or len({k for k in kinds if k is not None}) > 1  # bounds of numbers and texts do not compare
        numeric.append(_joint(kinds))
        bounds.append(None if not known else [] if mixed else [min(b[0] for b in known), max(b[1] for b in known)])
    return {"numeric": numeric, "bounds": bounds}


def rules_out(test: Filter, bounds: dict[str, list | None]) -> bool:
    """Whether no row of a page with such bounds can pass; bounds of None mean that the column is empty there."""
    name = ".".join(test.attribute) if hasattr(test, "attribute") else None
    if name not in bounds or not isinstance(test, (*SIGNS, In)):
        return False
    if bounds[name] is None:
        return True
    low, high = bounds[name]
    value = test.value
    if isinstance(test, In):
        return all(v is None or not low <= v <= high for v in value)
    return {
        EqualTo: lambda: not low <= value <= high, GreaterThan: lambda: high <= value, GreaterThanOrEqual: lambda: high < value,
        LessThan: lambda: low >= value, LessThanOrEqual: lambda: low > value,
    }[type(test)]()


@dataclass
class Page(InputPartition):
    """A page, or with `part` all pages that a part of an index names."""

    at: str
    part: bool = False

    def __post_init__(self):
        super().__init__(self.at)


@dataclass
class Written(WriterCommitMessage):
    parts: list


class SheetPages(DataSource):
    """A folder with an index (header, parts and their bounds; a file a part with its pages and their bounds) and a JSON file a
    page: {"values": [[cell, ...], ...]}.

    Tasks write parts and read them, so the driver and each task meet a line for PART_PAGES pages. Cells are texts; short rows are padded, empty cells are null, and a column is numeric if all its cells on all pages are
    numbers. Options: path; page_rows when writing.
    """

    @classmethod
    def name(cls) -> str:
        return "sheet_pages"

    def schema(self) -> StructType:
        index = _index(*_folder(self.options["path"]))
        return StructType([StructField(h, DoubleType() if n else StringType()) for h, n in zip(index["header"], _numeric(index), strict=True)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetReader(self.options["path"], _index(*_folder(self.options["path"])), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SheetWriter(self.options["path"], schema.names, int(self.options.get("page_rows", PAGE_ROWS)), overwrite)


def _json(store: fs.FileSystem, path: str):
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


def _index(store: fs.FileSystem, root: str) -> dict:
    if store.get_file_info(f"{root}/{INDEX}").type == fs.FileType.NotFound:
        flat = _json(store, f"{root}/{FLAT_INDEX}")
        return {"header": flat["header"], "parts": flat["pages"]}
    return _json(store, f"{root}/{INDEX}")


def _numeric(index: dict) -> list[bool]:
    """For each column whether it is a number wherever it is not empty, and somewhere it is not."""
    kinds = [p["numeric"] for p in index["parts"]]
    return [_joint([k[i] for k in kinds]) is True for i in range(len(index["header"]))]


class SheetReader(DataSourceReader):
    def __init__(self, path: str, index: dict, schema: StructType):
        self.path, self.header, self.parts, self.schema, self.filters = path, index["header"], index["parts"], schema, []
        self.numeric = _numeric(index)

    def __getstate__(self) -> dict:
        """Tasks get their pages with their partition."""
        return self.__dict__ | {"parts": []}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters choose pages here; Spark applies them to the rows."""
        self.filters = filters
        return filters

    def _left(self, pages: Iterable[dict]) -> list[dict]:
        """The pages, or parts, that the filters do not rule out."""
        kept = []
        for page in pages:
            bounds = {}
            for h, number, own, b in zip(self.header, self.numeric, page["numeric"], page["bounds"], strict=True):
                if b != [] and (own is not True or number):  # bounds of numbers say nothing of a column that is text elsewhere
                    bounds[h] = b
            if not any(rules_out(f, bounds) for f in self.filters):
                kept.append(page)
        return kept

    def partitions(self) -> Sequence[Page]:
        kept = self._left(self.parts)
        if sum(p.get("pages", 1) for p in kept) <= PLANNED_PAGES:
            store, root = _folder(self.path)
            kept = [page for p in kept for page in (self._left(_json(store, f"{root}/{p['file']}")) if "pages" in p else [p])]
        return [Page(p["file"], "pages" in p) for p in kept] or [Page("")]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        if not partition.at:
            return
        store, root = _folder(self.path)
        names = [p["file"] for p in self._left(_json(store, f"{root}/{partition.at}"))] if partition.part else [partition.at]
        place = {h: i for i, h in enumerate(self.header)}
        for name in names:
            rows = _json(store, f"{root}/{name}")["values"]
            columns = []
            for field in self.schema.fields:
                i = place[field.name]
                texts = [r[i] if i < len(r) and r[i] != "" else None for r in rows]
                real = isinstance(field.dataType, DoubleType)
                columns.append(pa.array([None if t is None else float(t) for t in texts], pa.float64()) if real else pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, self.schema.names)


class SheetWriter(DataSourceWriter):
    """Each task writes pages and parts of its own; the index names the parts once all tasks are done, so a lost task leaves no rows."""

    def __init__(self, path: str, header: list[str], page_rows: int, overwrite: bool):
        self.path, self.header, self.page_rows, self.overwrite = path, header, page_rows, overwrite

    def _page(self, store: fs.FileSystem, root: str, rows: list[list[str]]) -> dict:
        name = f"page-{uuid.uuid4().hex}.json"
        trimmed = [r if r and r[-1] != "" else r[: max((i + 1 for i, c in enumerate(r) if c != ""), default=0)] for r in rows]
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(json.dumps({"values": trimmed}, ensure_ascii=False).encode())
        found = [_bounds(c) for c in zip(*rows, strict=True)]
        return {"file": name, "rows": len(rows), "numeric": [n for n, _ in found], "bounds": [b for _, b in found]}

    def _part(self, store: fs.FileSystem, root: str, pages: list[dict]) -> dict:
        name = f"{INDEX.rsplit('/', 1)[0]}/part-{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(json.dumps(pages, ensure_ascii=False).encode())
        return {"file": name, "pages": len(pages), "rows": sum(p["rows"] for p in pages), **_summary(pages)}

    def write(self, iterator: Iterator) -> Written:
        cell = lambda x: x if type(x) is str else "" if x is None else x.isoformat(sep=" ") if hasattr(x, "isoformat") and hasattr(x, "hour") else str(x)
        store, root = _folder(self.path)
        store.create_dir(f"{root}/{INDEX.rsplit('/', 1)[0]}", recursive=True)
        parts, pages = [], []
        while rows := [[cell(x) for x in row] for row in itertools.islice(iterator, self.page_rows)]:
            pages.append(self._page(store, root, rows))
            if len(pages) == PART_PAGES:
                parts.append(self._part(store, root, pages))
                pages = []
        if pages:
            parts.append(self._part(store, root, pages))
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _folder(self.path)
        store.create_dir(f"{root}/{INDEX.rsplit('/', 1)[0]}", recursive=True)
        before: list = []
        if not self.overwrite and any(i.type != fs.FileType.NotFound for i in store.get_file_info([f"{root}/{INDEX}", f"{root}/{FLAT_INDEX}"])):
            old = _index(store, root)
            if old["header"] != self.header:
                raise ValueError(f"the sheet's columns are {', '.join(old['header'])}")
            before = old["parts"]
        parts = before + [p for m in messages if m is not None for p in m.parts]
        with store.open_output_stream(f"{root}/{INDEX}.writing") as f:
            f.write(json.dumps({"header": self.header, "parts": parts}, ensure_ascii=False).encode())
        store.move(f"{root}/{INDEX}.writing", f"{root}/{INDEX}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _folder(self.path)
        for part in (p for m in messages if m is not None for p in m.parts):
            for page in _json(store, f"{root}/{part['file']}"):
                store.delete_file(f"{root}/{page['file']}")
            store.delete_file(f"{root}/{part['file']}")


class HostedPages(DataSource):
    """A table behind a REST endpoint that answers GET url?order=...&offset=...&limit=... with a JSON list of objects, says
    the number of rows in Content-Range, and takes filters as column=sign.value.

    Options: url, order (a unique column), page_rows, token (sent as bearer). Columns come from the first row unless a schema
    is given; nested values are JSON text.
    """

    @classmethod
    def name(cls) -> str:
        return "hosted_pages"

    def schema(self) -> StructType:
        rows, _ = ask(self.options, [], 0, 1)
        kind = lambda v: DoubleType() if isinstance(v, (int, float)) and not isinstance(v, bool) else StringType()
        return StructType([StructField(k, kind(v)) for k, v in (rows[0] if rows else {}).items()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return HostedReader(dict(self.options), schema)


def ask(options: dict, conditions: list[tuple[str, str]], offset: int, limit: int) -> tuple[list[dict], int]:
    """(rows of a page, rows in all) of a hosted table."""
    query = [*conditions, ("order", options.get("order", "id")), ("offset", str(offset)), ("limit", str(limit))]
    headers = {"Accept": "application/json", "Prefer": "count=exact"} | ({"Authorization": f"Bearer {options['token']}"} if options.get("token") else {})
    request = urllib.request.Request(f"{options['url']}?{urllib.parse.urlencode(query)}", headers=headers)
    with urllib.request.urlopen(request, timeout=60) as answer:
        total = answer.headers.get("Content-Range", "*/0").rsplit("/", 1)[1]
        return json.loads(answer.read()), int(total)


class HostedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema, self.conditions = options, schema, []
        self.page_rows = int(options.get("page_rows", PAGE_ROWS))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons go into the request; Spark applies the others."""
        for f in filters:
            if type(f) in SIGNS and len(f.attribute) == 1 and isinstance(f.value, (str, int, float)) and not isinstance(f.value, bool):
                value = f"{f.value:.17g}" if isinstance(f.value, float) else str(f.value)
                self.conditions.append((f.attribute[0], f"{SIGNS[type(f)]}.{value}"))
            else:
                yield f

    def partitions(self) -> Sequence[Page]:
        _, total = ask(self.options, self.conditions, 0, 1)
        return [Page(str(k * self.page_rows)) for k in range(math.ceil(total / self.page_rows))] or [Page("")]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition.at:
            rows, _ = ask(self.options, self.conditions, int(partition.at), self.page_rows)
            text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
            real = [isinstance(f.dataType, DoubleType) for f in self.schema.fields]
            for r in rows:
                yield tuple(None if r.get(n) is None else float(r[n]) if x else text(r[n]) for n, x in zip(self.schema.names, real, strict=True))
