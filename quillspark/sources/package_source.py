"""A data source of word-processing packages, for batch reads and streams: ``spark.read.format("packages").load(folder)``.

One row per file with the nested content of ``packages.parse_package``; a file that isn't taken has a code (415: its
name, 413: its size, 422: what is in it), one that can't be read has an error as well. Files are listed once, on the driver, by name, size and time;
filters on doc_id, filename, path, length and code 413 or 415 are answered from the listing, so files that they exclude are never opened.
Partitions hold files of about ``partitionBytes`` together. Any file system that pyarrow knows by its URI can hold the folder.

Options: ``recursive`` (true), ``partitionBytes`` (64 MB), ``mostBytes`` of a file (20 MB), ``newest`` (false: true leaves only
the newest file of each doc_id, before any is opened).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema

from .packages import ROW, parse_package

NAME = "packages"
SCHEMA = f"doc_id string, filename string, path string, modificationTime timestamp, length long, code int, {ROW}"
REASONS = {415: "not a .docx name", 413: "too large", 422: "not a zip package"}


def stem_of(filename: str) -> str:
    """``functions.text.safe_stem`` for a listing."""
    clean = re.sub(r"[^A-Za-z0-9._-]+", "_", re.sub(r"(?i)\.docx$", "", re.split(r"[/\\]", filename)[-1]))
    return (re.sub(r"^[._]+|[._]+$", "", clean) or "document")[:100]


@dataclass(frozen=True, order=True)
class Listed:
    """A file; files are ordered by time, then path."""

    modified: int
    path: str
    length: int

    @property
    def filename(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    @property
    def doc_id(self) -> str:
        return stem_of(self.filename)

    def code(self, most: int) -> int | None:
        return 415 if not self.filename.lower().endswith(".docx") else 413 if self.length > most else None


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub("^file:", "", path)


class Folder:
    """Options of a source and its listing."""

    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.schema = to_arrow_schema(schema)
        if not options.get("path"):
            raise ValueError("a folder must be given to load()")
        self.path, self.recursive = options["path"], options.get("recursive", "true").lower() == "true"
        self.together, self.most = int(options.get("partitionBytes", 64 << 20)), int(options.get("mostBytes", 20 << 20))
        self.newest = options.get("newest", "false").lower() == "true"

    def files(self) -> list[Listed]:
        fs, base = opened(self.path)
        found = fs.get_file_info(pafs.FileSelector(base, recursive=self.recursive, allow_not_found=True))
        hidden = lambda x: any(p.startswith(("_", ".")) for p in x.path[len(base) :].split("/"))
        return sorted(Listed(x.mtime_ns or 0, x.path, x.size) for x in found if x.is_file and not hidden(x))

    def parts(self, files: list[Listed]) -> list[Files]:
        """Files dealt by size: in order of size, each to a partition until that is full."""
        if self.newest:
            files = list({f.doc_id: f for f in sorted(files) if f.code(self.most) is None}.values()) + [f for f in files if f.code(self.most) is not None]
        out, held, size = [], [], 0
        for f in sorted(files, key=lambda f: (-f.length, f.path)):
            if held and size + f.length > self.together:
                out.append(Files(held))
                held, size = [], 0
            held, size = [*held, f], size + min(f.length, self.most)
        return [*out, *([Files(held)] if held else [])]

    def read(self, part: Files | None) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        for f in part.files if part is not None else ():  # Spark reads one empty partition where there is none
            row = {"doc_id": f.doc_id, "filename": f.filename, "path": f.path, "modificationTime": datetime.fromtimestamp(f.modified / 1e9, UTC), "length": f.length, "code": f.code(self.most), "styles": [], "paragraphs": [], "cells": [], "parts": []}
            if row["code"] is None:
                try:
                    with fs.open_input_file(f.path) as file:
                        content = file.read()
                    row |= parse_package(content) if content[:4] == b"PK\x03\x04" else {"code": 422, "error": REASONS[422]}
                except OSError as e:  # gone or locked since it was listed
                    row |= {"error": f"{type(e).__name__}: {e}"[:500]}
                row["code"] = 422 if row.get("error") else None
            else:
                row["error"] = REASONS[row["code"]]
            yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in self.schema], schema=self.schema)


class Files(InputPartition):
    def __init__(self, files: list[Listed]) -> None:
        super().__init__(None)
        self.files = files


#: What a filter asks of a value from the listing.
TESTS = {
    EqualTo: lambda x, v: x == v, EqualNullSafe: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x, IsNotNull: lambda x, v: x is not None,
}


class PackageReader(DataSourceReader):
    def __init__(self, folder: Folder) -> None:
        self.folder, self.wanted = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if type(f) in TESTS and name in ("doc_id", "filename", "path", "length") and not (value is None and not isinstance(f, IsNotNull)):
                self.wanted.append((name, TESTS[type(f)], value))
            elif type(f) is EqualTo and name == "code" and value in (413, 415):
                self.wanted.append((name, TESTS[EqualTo], value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        of = lambda f, name: f.code(self.folder.most) if name == "code" else getattr(f, name)
        return self.folder.parts([f for f in self.folder.files() if all(test(of(f, name), value) for name, test, value in self.wanted)])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


class PackageStreamReader(DataSourceStreamReader):
    """Files in order of time and path; an offset is the last one that was taken."""

    def __init__(self, folder: Folder) -> None:
        self.folder, self.last = folder, None

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.folder.files()
        return {"modified": files[-1].modified, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        place = lambda x: (x["modified"], x["path"])
        return self.folder.parts([f for f in self.folder.files() if place(start) < (f.modified, f.path) <= place(end)])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> PackageReader:
        return PackageReader(Folder(self.options, schema))

    def streamReader(self, schema: T.StructType) -> PackageStreamReader:
        return PackageStreamReader(Folder(self.options, schema))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackageSource)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """The relation of a folder, for ``packages.package_model`` and ``refused``."""
    register(spark)
    return spark.read.format(NAME).options(**{k: str(v) for k, v in options.items()}).load(path)


def read_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.readStream.format(NAME).options(**{k: str(v) for k, v in options.items()}).load(path)


def refused(rows: DataFrame) -> DataFrame:
    """doc_id, code, detail of the files of ``read`` that aren't taken or can't be read."""
    return rows.filter("code is not null").selectExpr("doc_id", "code", "error as detail")
