"""Operator 4: two-pass external shuffle into shards, on DataFrame functions alone.

Pass 1 scatters the records uniformly over memory-sized buckets by a seeded
hash, through shuffle files; the buckets' sizes are counted before from hashes
of the rows alone.  Pass 2 reads each bucket whole, shuffles it by Fisher-Yates, its swaps drawn from a hash of seed, bucket
and step (Spark's own ``shuffle`` depends on the partition a row is in, so a
lost task could not repeat it), and lays the buckets end to end: record p of n
goes to shard p * shards div n, so shard counts differ by one at most (law
``rows``) and a shard is a run of buckets that is written where it was shuffled.

Rows equal in every column are numbered (counted once, expanded again), and
their number is part of the hash, so copies of a document scatter like others
and no bucket outgrows its size.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carried, shared_dir, table, written

BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 1024
TASK_BYTES = 32 << 20
#: Copies of one row that one task expands; more are dealt out first.
RUN = 1024
#: Buckets whose starts are summed together.
GROUP = 4096


def permutation(n, seed, bucket):
    """Fisher-Yates on 0 .. n-1: for i from the last place down, swap i with a place up to it."""

    def swap(a, i):
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")
        moved = F.concat(F.slice(a, 1, j), F.array(F.get(a, i)), F.slice(a, j + 2, i - j - 1), F.array(F.get(a, j)), F.slice(a, i + 2, F.size(a) - i - 1))
        return F.when(i == j, a).otherwise(moved)

    one = F.array(F.lit(0))
    return F.when(n < 2, one).otherwise(F.aggregate(F.sequence(F.greatest(n, F.lit(2)) - 1, F.lit(1), F.lit(-1)), F.sequence(F.lit(0), F.greatest(n, F.lit(2)) - 1), swap))


def expanded(counted: DataFrame, most: int) -> DataFrame:
    """Rows with a count ``_n`` as that many rows, numbered in ``_copy`` from 0, RUN at a time in a task.

    most: the largest count.
    """
    names = [c for c in counted.columns if c != "_n"]
    each = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {RUN}"))).alias("_run"))
    if most > RUN:
        each = each.repartition("_run", F.xxhash64(*names))
    last = F.least(F.col("_n"), (F.col("_run") + 1) * RUN) - 1
    return each.select(*names, F.explode(F.sequence(F.col("_run") * RUN, last)).alias("_copy"))


def starts(counts: DataFrame) -> DataFrame:
    """(bucket, start) from (bucket, n): what lies before each bucket, summed in groups of GROUP buckets, then over the groups."""
    group = F.floor(F.col("bucket") / GROUP).alias("group")
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # a row for each GROUP buckets, some 32 GB of input
    groups = counts.groupBy(group).agg(F.sum("n").alias("n")).select("group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("group", group).join(groups, "group").select("bucket", (F.col("base") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("start"))


def shard(docs: DataFrame, shards: int = 24, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, size: str | None = None) -> DataFrame:
    """Every row once, with shard (0 to shards-1) and slot (0, 1, .. in it) added.

    size: a column with the bytes of a record; without it the bytes of
    ``text`` plus 8 (null text: 8).  The bucket comes from a hash of the seed,
    all of a row's columns and its number among equal rows, so copies scatter,
    whether or not they have ids of their own, and runs on the same rows agree
    whatever their partitioning.  Nulls anywhere are values like others, a
    record longer than a bucket fills one, and an empty table gives an empty
    one.  Columns already named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    names = docs.columns
    bytes_of: Column = F.col(f"`{size}`") if size else F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    docs = carried(docs, size or "text").withColumn("bytes", bytes_of.cast("long"))
    kept = docs.select(*(f"in_{i}" for i in range(len(names))))
    key = [F.xxhash64(F.lit(i), *kept.columns).alias(f"k{i}") for i in (1, 2)]  # 128 bits tell rows apart
    keys = written(docs.select(*key, "bytes").groupBy("k1", "k2").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), "keys", keep=True)
    total, n, most = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    buckets = max(1, math.ceil(total / bucket_bytes), math.ceil(n / BUCKET_ROWS))
    tasks = min(buckets, max(1, math.ceil(total / TASK_BYTES), math.ceil(n / (256 * BUCKET_ROWS))))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "k1", "k2", "_copy"), F.lit(buckets)).cast("int").alias("bucket")
    counts = expanded(keys.select("k1", "k2", F.col("n").alias("_n")), most).groupBy(bucket).agg(F.count("*").alias("n"))
    at = written(starts(counts), "starts", keep=True)

    # pass 1: a bucket is one array of about bucket_bytes or BUCKET_ROWS rows, whichever is less; neighbouring buckets share a task
    each = expanded(kept.groupBy(*kept.columns).agg(F.count("*").alias("_n")), most) if most > 1 else kept.withColumn("_copy", F.lit(0).cast("long"))
    placed = each.select("*", *key).select(bucket, F.struct("k1", "k2", "_copy", *kept.columns).alias("row"))
    placed = placed.withColumn("run", F.expr(f"cast(cast(bucket as bigint) * {tasks} div {buckets} as int)"))
    rows = placed.repartition(tasks, "run").groupBy("run", "bucket").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    # pass 2
    order = permutation(F.size("rows"), seed, F.col("bucket"))
    mixed = rows.withColumn("order", order).select("bucket", F.transform("order", lambda k: F.get("rows", k)).alias("rows"))
    mixed = mixed.join(F.broadcast(at) if buckets <= 1 << 20 else at, "bucket").select("start", F.posexplode("rows").alias("i", "row"))
    p = F.col("start") + F.col("i")
    which = F.expr(f"cast((start + i) * {shards} div {max(n, 1)} as int)")
    first = F.expr(f"(cast({n} as bigint) * shard + {shards - 1}) div {shards}")
    out = mixed.select("row", p.alias("p"), which.alias("shard"))
    return out.select(*(F.col("row")[f"in_{i}"].alias(c) for i, c in enumerate(names)), "shard", (F.col("p") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, each record in its slot's order.

    Every task writes the buckets it read, runs of neighbours that lie in few
    shards; a shard is several files, each a stretch of slots, so no shard is
    one task's work.
    """
    names = [c for c in sharded.columns if c not in ("shard", "slot")]
    sharded.sortWithinPartitions("shard", "slot").select("shard", "slot", *names).write.partitionBy("shard").mode("overwrite").parquet(path)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` shuffled and written as shards; the result is the digest of the records read back.

    A null text has size 8 and the checksum of the empty text.
    """
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    sharded = shard(table(spark, sf_dir, "documents"))
    write_shards(sharded, path)
    out = spark.read.schema(sharded.schema).parquet(path)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
