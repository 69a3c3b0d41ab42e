"""Repositories as a data source: ``spark.read.format("repository").load(folder)``.

The driver looks at a root's own entries only; each folder there is read by ``slots`` tasks,
which walk it level by level and keep the files that fall to them by a checksum of the path.  The schema
is known without reading anything.  Filters on ``suffix`` (equal, in) and on the end
of ``path`` are taken before a file is opened.

Options: ``repo_id`` (default: the root's own name), ``repositories`` (true: each folder below
the root is a repository of that name, its own files are left out), ``content`` (false: null contents, no file is
opened), ``slots``.  Every file is a row, hidden and empty ones included; content is that of relevant files that are UTF-8, else null.
Links to folders are not followed.  Roots are what Arrow's file systems open: local paths and URIs.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith
from pyspark.sql.types import StructType

from strata.functions import paths, vocab
from strata.operators.graph import KEY

SCHEMA = f"{KEY} string, path string, suffix string, size bigint, content string"
_ARROW = pa.schema([(KEY, pa.string()), ("path", pa.string()), ("suffix", pa.string()), ("size", pa.int64()), ("content", pa.string())])
BATCH_BYTES = 8 << 20
BATCH_ROWS = 10_000


_SUFFIX = re.compile(r"[^.](\.[^.]+)$")


def suffix_of(path: str) -> str:
    """As ``paths.suffix``."""
    found = _SUFFIX.search(path.rsplit("/", 1)[-1])
    return found[1].lower() if found else ""


def is_relevant(path: str) -> bool:
    return suffix_of(path) in paths.SCAN_SUFFIXES and not set(path.split("/")) & set(vocab.IGNORED_DIRS)


@dataclass
class Part(InputPartition):
    repo_id: str
    base: str  # folder that paths are relative to
    folder: str  # where to begin
    deep: bool
    slot: int = 0
    slots: int = 1


class RepositoryReader(DataSourceReader):
    def __init__(self, root: str, options: dict):
        self.root, self.options = root, options
        self.suffixes: list[set[str]] = []
        self.ends: list[str] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            match f:
                case EqualTo(attribute=("suffix",), value=v):
                    self.suffixes.append({v})
                case In(attribute=("suffix",), value=vs):
                    self.suffixes.append(set(vs))
                case StringEndsWith(attribute=("path",), value=v):
                    self.ends.append(v)
                case IsNotNull(attribute=("path" | "suffix",)):
                    pass  # they never are
                case _:
                    yield f

    def partitions(self) -> list[Part]:
        system, root = fs.FileSystem.from_uri(self.root)
        root, slots = root.rstrip("/"), int(self.options.get("slots", 1))
        folders = sorted(i.path for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory)
        if str(self.options.get("repositories", "false")).lower() == "true":
            return [Part(f.rsplit("/", 1)[-1], f, f, True, k, slots) for f in folders for k in range(slots)]
        repo = self.options.get("repo_id", root.rsplit("/", 1)[-1])
        return [Part(repo, root, root, False), *(Part(repo, root, f, True, k, slots) for f in folders for k in range(slots))]

    def _files(self, system: fs.FileSystem, part: Part) -> Iterator[tuple[str, str, int]]:
        todo = [part.folder]
        while todo:
            for info in system.get_file_info(fs.FileSelector(todo.pop())):
                path = info.path[len(part.base) + 1 :]
                if info.type == fs.FileType.Directory:
                    if part.deep:
                        todo.append(info.path)
                elif zlib.crc32(path.encode()) % part.slots == part.slot:
                    own = suffix_of(path)
                    if all(own in s for s in self.suffixes) and all(path.endswith(e) for e in self.ends):
                        yield info.path, path, info.size

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.root)
        wanted = str(self.options.get("content", "true")).lower() == "true"
        rows, held = [], 0
        for at, path, size in self._files(system, part):
            content = None
            if wanted and is_relevant(path):
                with system.open_input_stream(at) as f:
                    body = f.read()
                try:
                    content = body.decode("utf-8")
                except UnicodeDecodeError:
                    pass
            rows.append((part.repo_id, path, suffix_of(path), size, content))
            held += size if content is not None else 0
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RepositoryReader:
        root = self.options["path"]
        return RepositoryReader(root if "://" in root else os.path.abspath(root.removeprefix("file:")), dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepositorySource)


def read(spark: SparkSession, root: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("repository").options(**options).load(root)
