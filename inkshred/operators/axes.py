"""Axes over node rows: children, descendants and attributes by local name.

A node and its descendants are the numbers node to node + size of a part, so
an element lies inside another if and only if its number does.  The descendant
axis is a containment join on these intervals: the numbers are cut into blocks,
an interval is a row for each block it meets, and an element meets the
intervals of its own block alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["doc_id", "part_key"]
BLOCK = 256


def children(nodes: DataFrame, of: DataFrame, name: str | None = None) -> DataFrame:
    """The node rows directly inside those of ``of`` (doc_id, part_key, node), with ``of_node``; of a local name where one is given."""
    some = nodes if name is None else nodes.filter(F.col("tag") == name)
    asked = of.select(*KEYS, F.col("node").alias("of_node")).distinct()
    return some.withColumn("of_node", F.col("parent")).join(asked, [*KEYS, "of_node"])


def descendants(nodes: DataFrame, of: DataFrame, name: str | None = None, block: int = BLOCK) -> DataFrame:
    """The node rows anywhere inside those of ``of`` (doc_id, part_key, node, size), one for each they lie in, with ``of_node``."""
    some = nodes if name is None else nodes.filter(F.col("tag") == name)
    first, last = F.floor((F.col("node") + 1) / block), F.floor((F.col("node") + F.col("size")) / block)
    asked = of.filter("size > 0").select(*KEYS, F.col("node").alias("of_node"), (F.col("node") + F.col("size")).alias("_last"), F.explode(F.sequence(first, last)).alias("_block")).distinct()
    x = some.withColumn("_block", F.floor(F.col("node") / block)).join(asked, [*KEYS, "_block"])
    return x.filter((F.col("node") > F.col("of_node")) & (F.col("node") <= F.col("_last"))).drop("_block", "_last")


def first(found: DataFrame) -> DataFrame:
    """Of what an axis found, the first in document order for each ``of_node``: find child, find descendant."""
    at = F.row_number().over(Window.partitionBy(*KEYS, "of_node").orderBy("node"))
    return found.withColumn("_r", at).filter("_r = 1").drop("_r")


def attribute(name: str) -> Column:
    """An attribute of a node row by its local name; null where there is none."""
    return F.col("attrs")[name]
