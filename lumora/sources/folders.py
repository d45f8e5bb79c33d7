"""Spark data sources over the files of a folder that need not be read whole: heads, workbook sheets, HTML tables.

A folder's files are dealt out in shares by a checksum of their path. Each task lists the folder and opens the files of
its share only, so the driver sees neither files nor paths, and one job serves any number of files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumora.sources.sniff import HEAD_BYTES, SNIFF_SCHEMA, sniff_head
from lumora.sources.tables import WORKBOOK_SCHEMA, page_tables, workbook_sheet

HEAD_SCHEMA = "path string, name string, ext string, size long, head binary"
HTML_SCHEMA = "path string, table_count int, table_index int, row int, cells array<string>"
#: Tasks that share the files, at most.
MOST_SHARES = 256
#: Rows and bytes of text that a task holds before it hands them on.
BATCH_ROWS, BATCH_BYTES = 1_000, 1 << 20
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}


class Share(InputPartition):
    def __init__(self, number: int, count: int) -> None:
        self.number, self.count = number, count


def opened(folder: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, root in it, what stands before the root in a full path)."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder, "file:"
    store, root = fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
    return store, root, "file:" if isinstance(store, fs.LocalFileSystem) else folder[: folder.index("://") + 3] + folder.split("://", 1)[1].split(root, 1)[0]


def readable(folder: str) -> bool:
    """Whether there is a library for the folder's store."""
    try:
        opened(folder)
    except Exception:  # noqa: BLE001  (only Spark opens it)
        return False
    return True


def batches(rows: Iterable[tuple], columns: str) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size, so that memory doesn't grow with the number of files of a share."""
    schema = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))])
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), schema.types)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(v) if isinstance(v, (str, bytes)) else sum(len(x) for x in v if x) for v in row if isinstance(v, (str, bytes, list)))
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class FolderReader(DataSourceReader):
    """Files of a share, in order of their path. Names that begin with `_` or `.` are bookkeeping and skipped."""

    columns: str
    exts: tuple[str, ...] = ()

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.count, self.options = options["path"], int(options.get("shares", "8")), dict(options)

    def partitions(self) -> list[Share]:
        return [Share(i, self.count) for i in range(self.count)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        return batches(self.share_rows(share), self.columns)

    def share_rows(self, share: Share) -> Iterator[tuple]:
        store, root, prefix = opened(self.folder)

        def own(info: fs.FileInfo) -> bool:
            inner = info.path[len(root):].lstrip("/")
            hidden = any(part[:1] in "_." for part in inner.split("/"))
            return info.type == fs.FileType.File and not hidden and zlib.crc32(inner.encode()) % share.count == share.number

        for info in sorted(filter(own, store.get_file_info(fs.FileSelector(root, recursive=True))), key=lambda f: f.path):
            ext = info.base_name.rsplit(".", 1)[-1].lower() if "." in info.base_name else ""
            if not self.exts or ext in self.exts:
                yield from self.rows(store, info, f"{prefix}{info.path}", ext)

    def rows(self, store: fs.FileSystem, info: fs.FileInfo, path: str, ext: str) -> Iterator[tuple]:
        raise NotImplementedError


class _Heads(FolderReader):
    columns = HEAD_SCHEMA

    def rows(self, store, info, path, ext):
        with store.open_input_file(info.path) as f:
            yield path, info.base_name, ext, info.size, f.read(HEAD_BYTES)


class _Kinds(FolderReader):
    columns = SNIFF_SCHEMA

    def rows(self, store, info, path, ext):
        with store.open_input_file(info.path) as f:
            yield tuple(sniff_head(path, f.read(HEAD_BYTES)).values())


class _Workbooks(FolderReader):
    columns = WORKBOOK_SCHEMA
    exts = ("xlsx",)

    def rows(self, store, info, path, ext):
        sheet = self.options.get("sheet", "0")
        try:
            with store.open_input_file(info.path) as f:  # the archive's directory and the members in use are read
                names, chosen, rows = workbook_sheet(f, int(sheet) if sheet.isdigit() else sheet)
        except Exception as e:  # noqa: BLE001  (the error row names the reason)
            yield path, None, None, None, None, f"{type(e).__name__}: {e}"[:300]
            return
        if not rows:
            yield path, names, chosen, None, None, "ValueError: empty sheet"
        for i, cells in enumerate(rows):
            yield path, names, chosen, i, cells, None


class _Pages(FolderReader):
    columns = HTML_SCHEMA
    exts = ("html", "htm")

    def rows(self, store, info, path, ext):
        with store.open_input_file(info.path) as f:
            found = page_tables(f.read().decode("utf-8", errors="replace"))
        chosen = found if self.options.get("all", "false") == "true" else found[:1]
        for i, table in enumerate(chosen):
            for k, cells in enumerate(table):
                yield path, len(found), i, k, cells


def _source(source_name: str, source_reader: type[FolderReader]) -> type[DataSource]:
    class Folder(DataSource):
        @classmethod
        def name(cls) -> str:
            return source_name

        def schema(self) -> str:
            return source_reader.columns

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return source_reader(self.options)

    return Folder


SOURCES = {
    "file_heads": _source("file_heads", _Heads), "file_kinds": _source("file_kinds", _Kinds),
    "workbook_sheets": _source("workbook_sheets", _Workbooks), "html_files": _source("html_files", _Pages),
}


def read_folder(spark: SparkSession, source: str, folder: str, **options: str) -> DataFrame:
    """One of SOURCES over all files below `folder`."""
    spark.dataSource.register(SOURCES[source])
    shares = min(MOST_SHARES, max(1, spark.sparkContext.defaultParallelism))
    return spark.read.format(source).option("shares", str(shares)).options(**options).load(folder)


def file_heads(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, ext, size, head) of every file; of a store that only Spark can open, contents are read to their end."""
    if not readable(folder):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        name = F.element_at(F.split("path", "/"), -1)
        ext = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
        return files.select("path", name.alias("name"), ext.alias("ext"), F.col("length").alias("size"), F.substring("content", 1, HEAD_BYTES).alias("head"))
    return read_folder(spark, "file_heads", folder)
