"""Shared plumbing: table access, staged tables in the cluster's shared folder, size-checked joins."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest build side, in bytes of its own columns, that attach() sends to every executor.
BROADCAST_BYTES = 24 << 20
#: Rows and bytes of an Arrow batch on its way to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Rough size of one row of a hash relation besides its own columns.
ROW_OVERHEAD = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A temporary one only if there are no other machines (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="quillstack-")
        named = _own_dirs[app]
    return named.rstrip("/")


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a folder that Spark names by URI or by path."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return fs.LocalFileSystem(), uri


class Staged:
    """A table written once to the shared folder, so that what follows survives lost executors."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/staged-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; nothing that reads them may run afterwards."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_scopes = threading.local()


@contextmanager
def scratch() -> Iterator[None]:
    """Tables staged inside are deleted at the end, but for those that are to be kept."""
    held = _scopes.__dict__.setdefault("held", [])
    held.append([])
    try:
        yield
    finally:
        for table in held.pop():
            table.drop()


def stage(df: DataFrame, keep: bool = False) -> DataFrame:
    """df written and read again; keep: it outlives the innermost scratch()."""
    made, held = Staged(df), _scopes.__dict__.get("held", [])
    if len(held) > keep:
        held[-1 - keep].append(made)
    return made.df


def arrow_udf(kind: str):
    """F.arrow_udf, with Arrow batches of the session bounded to what small Python workers can hold."""
    small_batches(SparkSession.active())
    return F.arrow_udf(kind)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def row_key(*cols: str | Column) -> Column:
    """A non-null 64-bit key of a row's content: rows that repeat share it and get the same answer."""
    return F.xxhash64(*cols)


#: The greatest number that draw() gives.
LAST_DRAW = (1 << 63) - 1


def draw(*cols: str | Column) -> Column:
    """A number of 63 bits by a hash of columns. Rows with at most bound(share) are a sample of about this share."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(LAST_DRAW))


def bound(share: float) -> int:
    """No share is too small for it."""
    return min(LAST_DRAW, int(share * (1 << 63)))


def attach(left: DataFrame, small: DataFrame, key: str, payload: list[str], how: str = "left") -> DataFrame:
    """Join a staged table of one row a key. It is broadcast if its measured bytes are under
    BROADCAST_BYTES; otherwise both sides are shuffled. Either way the rows are the same."""
    kinds = dict(small.dtypes)
    size = F.lit(ROW_OVERHEAD)
    for c in payload:
        wide = F.length(c) if kinds[c] in ("string", "binary") else F.size(c) * 8 if kinds[c].startswith("array") else F.lit(8)
        size = size + F.coalesce(wide, F.lit(0))
    total = small.agg(F.sum(size.cast("long"))).first()[0] or 0
    side = small.select(key, *payload)
    return left.join(F.broadcast(side) if total <= BROADCAST_BYTES else side.hint("merge"), key, how)


class Memo(dict):
    """A bounded cache of a pure function with two generations: what is still in use outlives a turn-over."""

    def __init__(self, compute, cap: int):
        super().__init__()
        self.compute, self.cap, self.old = compute, cap, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
