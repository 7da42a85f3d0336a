"""Tables that are written once and read many times, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a session of one machine may leave it unset and gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="inkshred-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Bytes of one Arrow batch on its way to a kernel.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, kernel, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of about BATCH_BYTES, as a package may be large and 10,000 small ones are; a session that sets its own bound keeps it."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(kernel, schema)


def dealt(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows dealt over all shuffle partitions by ``key``, however few bytes they have.

    A document is a few hundred bytes as a row and milliseconds of work in a
    kernel; splits of files and adaptive execution go by bytes and would leave
    a million of them to one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join by document: sorted and merged, never broadcast.

    Spark takes a table's size from its compressed files and 20 bytes for a
    text, so the XML of a million documents counts as a few MB there and would
    go through the driver and to every executor whole.
    """
    return df.hint("merge")


@contextmanager
def spread(spark: SparkSession) -> Iterator[None]:
    """For writes that run kernels: shuffles are read by all their partitions (see ``dealt``), and their files go when the write ends."""
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into the shared folder and read back: computed once, whatever reads it, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with spread(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Joins on more keys than those a table is bucketed by may keep its buckets.
_KEEP = "spark.sql.requireAllClusterKeysForCoPartition"


def stored(nodes: DataFrame, buckets: int | None = None, path: str | None = None, keys: tuple[str, ...] = ("doc_id", "part_key", "node"), dealt: bool = False) -> DataFrame:
    """Node rows written once, in ``buckets`` buckets by doc_id (the number of shuffle partitions without any), and read back.

    Packages are opened and parsed by this write alone.  Every model table is
    a fold or join of the rows of one document, so it reads the columns and
    paths that it needs from the buckets and shuffles nothing; for the joins
    that takes the session's spark.sql.requireAllClusterKeysForCoPartition = false, which is set here unless the
    session says otherwise.  The rows of a bucket are sorted by document, part
    and node.  A document is never split, a bucket holds many.

    keys: what the rows of other tables by document are sorted by.  dealt:
    that rows come by document in as many partitions already, as the XML of
    grouped documents does, so that they need not be shuffled to be one file a
    bucket; if they do not, a bucket is several files.
    """
    spark = nodes.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"nodes_{uuid.uuid4().hex}"
    if spark.conf.get(_KEEP) == "true":
        spark.conf.set(_KEEP, "false")
    rows = nodes if dealt else nodes.repartition(n, "doc_id")
    with spread(spark):
        rows.write.bucketBy(n, "doc_id").sortBy(*keys).option("path", path or f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
