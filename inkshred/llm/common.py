"""Shared pieces: the shared work folder, row keys and column hygiene."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside these (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares, named by ``spark.checkpoint.dir``.

    A session of one machine (``local[..]``, as in tests) that leaves it unset
    gets a folder of this machine; on a cluster that would scatter the rows
    over the executors' own disks, so there an unset folder is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="inkshred-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: The tables to remove, per thread: each runs its own stages.
_local = threading.local()


def _scratch() -> list[list[str]]:
    if not hasattr(_local, "open"):
        _local.open = []
    return _local.open


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the tables that ``written`` makes inside, but for those with ``keep``.

    Only for work whose result is itself written with ``keep``: nothing may
    read the others afterwards, not even a retry.
    """
    _scratch().append([])
    try:
        yield
    finally:
        for name in _scratch().pop():
            _remove(spark, name)


def _remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def removed(df: DataFrame) -> None:
    """Remove a table of ``written`` that nothing will read again."""
    for name in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _remove(df.sparkSession, name)


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Let each query that runs inside remove its shuffle files when it ends.

    Otherwise they stay until the driver's memory runs short, and those of all
    steps pile up.  Only for queries that are not run again.
    """
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts the lineage, survives lost executors (every replica is a file all of
    them see) and lets several consumers read only the columns they need.  What
    the write shuffled is removed at once.  ``keep``: beyond the ``scratch``
    around, until the end of the one around that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_scratch()) > keep:
        _scratch()[-1 - keep].append(path)
    with released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch of texts, in the JVM, on the wire and in the Python worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, kernel, schema) -> DataFrame:
    """``mapInArrow`` with batches of about BATCH_BYTES, as texts may be long; a session that sets its own bound keeps it."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(kernel, schema)


#: Rows of a few numbers that may be broadcast: some 16 MB, 32 MB as a hashed relation.
BROADCAST_ROWS = 1 << 20


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (written, of narrow rows) marked for broadcast up to BROADCAST_ROWS rows; beyond, joins shuffle it."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def without(rows: DataFrame, some: DataFrame, on: list[str], passes: int = 4) -> DataFrame:
    """The rows not named in ``some`` (written, of narrow rows).

    Up to ``passes`` broadcasts, each of a checked size, are joined one after
    another in the one scan of ``rows``; beyond that both sides are shuffled.
    """
    n = some.count()
    parts = -(-n // BROADCAST_ROWS)
    if not n:
        return rows
    if parts > passes:
        return rows.join(some, on, "left_anti")
    for i in range(parts):
        own = some if parts == 1 else some.filter(F.pmod(F.xxhash64(*on), F.lit(parts)) == i)
        rows = rows.join(F.broadcast(own), on, "left_anti")
    return rows


def carried(df: DataFrame, *own: str) -> DataFrame:
    """``df`` with its columns under the names in_0, in_1, .., which no name of theirs can clash with, and after them ``own`` once more as they are."""
    names = df.columns
    x = df.toDF(*(f"in_{i}" for i in range(len(names))))
    return x.select("*", *(F.col(f"in_{names.index(c)}").alias(c) for c in own))


def named(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns that ``carried`` renamed, under their own names again."""
    return df.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(names)))


def crc_of(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text: the key of its exact copies."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
