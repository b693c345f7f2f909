"""A tree of files as a source.

Folders are listed by executors, a level of the tree at a time and pruned by name before they are entered; files are read
by executors in tasks of about the same number of bytes. The driver learns how many folders and bytes there are, and no
path. Hidden names are left out, names that begin with an underscore are not. The root must be a folder that all
executors see. `file_tree` is the same tree as a data source for SQL; its listing runs on the driver, so it is for small trees.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..cluster import checkpoint_folder
from ..functions import encodings
from ..operators.filters import skipped_dirs
from ..plans.conditions import SearchConditions

SCHEMA = "path string, full_path string, length long, content binary"
#: Bytes of files that one task reads, about.
TASK_BYTES = 32 << 20
#: Folders that one task lists, about, and entries in a batch of a listing.
TASK_FOLDERS = 256
_ENTRIES = 10_000
#: Bytes of files in one batch of a task's rows.
_BATCH_BYTES = 8 << 20


def entries(root: str, folder: str, skip: set[str], hidden: bool = False) -> Iterator[tuple[str, bool, int]]:
    """Relative path, whether it is a folder, and size of what lies in a folder; links and what cannot be read are passed over."""
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            for e in found:
                if not hidden and e.name.startswith("."):
                    continue
                try:
                    if e.is_dir(follow_symlinks=False):
                        if e.name not in skip:
                            yield os.path.join(folder, e.name), True, 0
                    elif e.is_file(follow_symlinks=False):
                        yield os.path.join(folder, e.name), False, e.stat(follow_symlinks=False).st_size
                except OSError:
                    continue
    except OSError:
        return


def _local(root: str) -> str:
    """The root as a path of the file system that executors share."""
    return root.removeprefix("file:").replace("//", "/") if root.startswith("file:") else root


def listed(root: str, skip_dirs: str = "", hidden: bool = False) -> Iterator[tuple[str, int]]:
    """Relative path and size of every regular file below root, by one process."""
    skip, folders = set(skipped_dirs(skip_dirs)), [""]
    while folders:
        for path, is_folder, length in sorted(entries(root, folders.pop(), skip, hidden)):
            if is_folder:
                folders.append(path)
            else:
                yield path, length


def listing(spark: SparkSession, root: str, skip_dirs: str = "", hidden: bool = False) -> DataFrame:
    """path, length of every regular file below root. Each level of folders is one job, whose rows are written to the shared folder."""
    root, skip, target = _local(root), set(skipped_dirs(skip_dirs)), f"{checkpoint_folder(spark)}/tree-{uuid.uuid4().hex}"

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "is_folder", "length"]
        for pdf in batches:
            rows = []
            for folder in pdf["path"]:
                for row in entries(root, folder, skip, hidden):
                    rows.append(row)
                    if len(rows) == _ENTRIES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    schema, level, folders, tasks = "path string, is_folder boolean, length long", 0, spark.createDataFrame([("",)], "path string"), 1
    while tasks:
        folders.repartition(tasks).mapInPandas(found, schema).write.parquet(f"{target}/level={level}")
        folders = spark.read.schema(schema).parquet(f"{target}/level={level}").where("is_folder").select("path")
        tasks, level = -(-folders.count() // TASK_FOLDERS), level + 1
    return spark.read.schema(schema).parquet(*[f"{target}/level={i}" for i in range(level)]).where("NOT is_folder").select("path", "length")


class Part(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(0)
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.skip = options.get("skipdirs", "")
        self.most = int(options.get("maxbytes", 1 << 40))
        self.hidden = options.get("hidden", "false") == "true"

    def partitions(self) -> list[Part]:
        parts, now, size = [], [], 0
        for path, length in listed(self.root, self.skip, self.hidden):
            if length > self.most:
                continue
            if now and size + length > TASK_BYTES:
                parts.append(Part(now))
                now, size = [], 0
            now.append((path, length))
            size += length
        return [*parts, Part(now)]

    def read(self, partition: Part) -> Iterator[tuple]:
        for path, length in partition.files:
            full = os.path.join(self.root, path)
            try:
                with open(full, "rb") as f:
                    yield path, full, length, f.read()
            except OSError:
                continue


class TreeSource(DataSource):
    """spark.read.format("file_tree").option("skipDirs", ".git;target").load(root), once sql.register was called."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def scan(spark: SparkSession, root: str, skip_dirs: str = "", max_bytes: int | None = None) -> DataFrame:
    """path, full_path, length, content of the files below root, of at most max_bytes each. The listing runs now, the reading when the rows are wanted."""
    root, files = _local(root), listing(spark, root, skip_dirs)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "full_path", "length", "content"]
        for pdf in batches:
            rows, size = [], 0
            for path, length in zip(pdf["path"], pdf["length"], strict=True):
                full = os.path.join(root, path)
                try:
                    with open(full, "rb") as f:
                        rows.append((path, full, length, f.read()))
                except OSError:
                    continue
                size += length
                if size >= _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    total = files.agg(F.sum("length"), F.count("*")).first()
    tasks = max(1, (total[0] or 0) // TASK_BYTES, total[1] // _ENTRIES)
    return files.repartition(tasks).mapInPandas(read, SCHEMA)


def files(spark: SparkSession, conditions: SearchConditions) -> DataFrame:
    """The decoded text files that the conditions' root, skipped folders and size limit let through."""
    found = scan(spark, conditions.search_dir, conditions.skip_dirs, conditions.max_file_size_mb * 1024 * 1024)
    return encodings.decoded(found, conditions.file_encoding_preference).select("path", "length", "text", F.col("text_encoding"))
