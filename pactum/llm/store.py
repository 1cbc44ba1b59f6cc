"""Tables, shared scratch space and files that every executor can reach."""

from __future__ import annotations

import ctypes
import functools
import os
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.shared import delete, shared_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: With it Spark deletes the shuffle files of a query when the query has ended, not when the driver collects garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Intermediate tables written to the shared folder: lineage ends there, and a lost executor loses nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{label}"

    def cut(self, df: DataFrame, label: str, *drop: DataFrame) -> DataFrame:
        """The table written and read again; tables that only it was made from can then be dropped."""
        path, before = self.path(label), self.spark.conf.get(_CLEAN_UP, None)
        self.spark.conf.set(_CLEAN_UP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(_CLEAN_UP) if before is None else self.spark.conf.set(_CLEAN_UP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._pactum_path = path
        self.drop(*drop)
        if hasattr(df, "_pactum_work"):
            df._pactum_work.close()
        return out

    def lend(self, df: DataFrame) -> DataFrame:
        """A result that still reads tables of this workspace: where it is written by cut(), they go."""
        df._pactum_work = self
        return df

    def drop(self, *frames: DataFrame | None) -> None:
        """Deletes the files behind tables that nothing reads any more."""
        for df in frames:
            if df is not None:
                delete(self.spark, df._pactum_path)

    def close(self) -> None:
        """Deletes the whole folder, once no table in it is read any more."""
        delete(self.spark, self.root)


#: Megabytes of a worker from which on it gives back what it has freed.
TIDY_MB = 200


def tidied(run):
    """A function of a task's batches that, when the task has ended, gives freed memory back to the system: workers live
    on, and what one has once used would stay with it."""

    @functools.wraps(run)
    def again(parts):
        try:
            yield from run(parts)
        finally:
            _release()

    return again


def _release() -> None:
    try:
        with open("/proc/self/statm") as f:
            large = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") > TIDY_MB << 20
        if large:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another system
        pass


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def keyed(docs: DataFrame, id_col: str, keep: str, work: Workspace, whole: bool = False) -> tuple[DataFrame, str]:
    """(docs, a column that is unique, never null and grows from the row to keep on): id_col where it is all that, or
    else a new column, with the rows in a written table. whole: the column also has to be of an integer type."""
    kind = docs.select(F.col(f"`{id_col}`")).dtypes[0][1]
    if not whole or kind in _WHOLE:
        counts = docs.select(F.col(f"`{id_col}`").alias("id")).groupBy("id").agg(F.count("*").alias("k"))
        if counts.where("id IS NULL OR k > 1").isEmpty():
            return docs, id_col
    key = "_row"
    while key.lower() in map(str.lower, docs.columns):
        key = f"_{key}"
    column = F.col(f"`{id_col}`")
    rows = docs.orderBy(column.asc_nulls_last() if keep == "smallest" else column.desc_nulls_last())
    return work.cut(rows.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


class Files:
    """Binary files in the shared folder, opened from a task.

    file:// goes through the operating system, any other scheme through pyarrow's file systems.
    A file appears under its name only when whole: it is written under a name of the attempt and then moved.
    """

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        parts = urlparse(self.uri)
        self.local = parts.path if parts.scheme in ("", "file") else None
        self.fs = None
        self.base = self.local
        if self.local is None:
            from pyarrow import fs

            self.fs, self.base = fs.FileSystem.from_uri(self.uri)

    def make(self) -> None:
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
        else:
            self.fs.create_dir(self.base, recursive=True)

    def write(self, name: str):
        return _Pending(self, name)

    def read(self, name: str):
        """A seekable binary file."""
        path = f"{self.base}/{name}"
        return open(path, "rb") if self.local is not None else self.fs.open_input_file(path)

    def size(self, name: str) -> int:
        path = f"{self.base}/{name}"
        return os.path.getsize(path) if self.local is not None else self.fs.get_file_info(path).size


class _Pending:
    def __init__(self, files: Files, name: str):
        self.files, self.name = files, name
        files.make()
        self.temp = f"{files.base}/.{name}.{uuid.uuid4().hex}.tmp"
        self.out = open(self.temp, "wb") if files.local is not None else files.fs.open_output_stream(self.temp)
        self.bytes = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def commit(self) -> None:
        self.out.close()
        path = f"{self.files.base}/{self.name}"
        if self.files.local is not None:
            os.replace(self.temp, path)
        else:
            self.files.fs.move(self.temp, path)

    def abort(self) -> None:
        self.out.close()
        if self.files.local is not None:
            os.unlink(self.temp)
        else:
            self.files.fs.delete_file(self.temp)
