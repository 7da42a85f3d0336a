"""Operator 10: benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the power of two, u, above their number of shingles;
for each partition the documents are read in windows of 2u shingles, one every
u, so that a passage of up to u lies whole in one window and the Jaccard
similarity of item and window stays bounded however long the document is.
Items and windows are compared by one-permutation MinHash: ``bins`` residues
of the shingle hash, the smallest hash in each.  Any equal bin makes a
candidate (with b filled bins and similarity s about (1-s)^b are missed, under
1e-6 from DIRECT shingles on), and candidates are verified by exact shingle
containment.

Items of fewer shingles have too few bins for that: any shingle they share
with a text makes a candidate.  Items of under k words have one shingle, the
whole of them, which is searched among the windows of as many words.

A window can only agree with an item in a bin through a shingle that is one of
the items' minima; so one scan looks every shingle up among these first, and
minima are taken only of windows that hold one, of the sizes that met the text.
All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, carried, named, scratch, table, text_key, without, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Items of fewer shingles are candidates wherever one of their shingles is.
DIRECT = 16


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(text: Column, k: int) -> Column:
    """Hashes of the k-word windows of a text, in order; empty for fewer words or null."""
    return F.transform(
        F.array(_words(text)),
        lambda w: F.when(F.size(w) < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.xxhash64(*(F.get(w, i + j - 1) for j in range(k))))),
    )[0]


def _short(texts: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(k1, k2, item_id): texts that hold an item of fewer than k words, word for word."""
    n = F.size(_words(F.col("text")))
    items = written(items.filter((n > 0) & (n < k)).select("item_id", "text", n.alias("n")).distinct(), "short")
    found = [r.n for r in items.select("n").distinct().orderBy("n").collect()]  # k - 1 lengths at most
    out = texts.join(items.select("item_id"), F.lit(False)).select("k1", "k2", "item_id")  # none, in the right types
    for length in found:
        own = items.filter(F.col("n") == length).select("item_id", F.get(shingles(F.col("text"), length), F.lit(0)).alias("h"))
        told = texts.select("k1", "k2", F.explode(F.array_distinct(shingles(F.col("text"), length))).alias("h"))
        out = out.union(told.join(bounded(own), "h").select("k1", "k2", "item_id"))
    return out.distinct()


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 75, bins: int = 64) -> DataFrame:
    """(k1, k2, item_id, n_shared, n_item): texts that hold percent% of an item's distinct shingles.

    k1, k2 are the hashes of a text (``common.text_key``): exact copies are
    searched once, and rows without an id are found like others.  A-Z is
    lower-cased.  An item of under k words counts as one shingle.  Items
    without words, null texts and texts shorter than an item match nothing;
    repeated item rows count once; an empty table finds nothing.
    """
    texts = docs.select(*text_key(F.col("text")), "text").filter("text is not null")
    short = _short(texts, items, k)
    items = items.select("item_id", F.explode(shingles(F.col("text"), k)).alias("h")).distinct()
    items = written(items, "items")
    sizes = items.groupBy("item_id").agg(F.count("*").alias("n_item"))
    sizes = written(sizes.withColumn("u", F.pow(F.lit(2), F.ceil(F.log2("n_item"))).cast("int")), "sizes")
    per_bin = F.pmod("h", F.lit(bins)).cast("int").alias("bin")
    sized = items.join(sizes, "item_id")
    minima = sized.filter(F.col("n_item") >= DIRECT).groupBy("item_id", "u", per_bin).agg(F.min("h").alias("h"))
    # the whole of an item with few shingles, with bin and u of none
    minima = written(minima.union(sized.filter(F.col("n_item") < DIRECT).select("item_id", F.lit(0).alias("u"), F.lit(-1).alias("bin"), "h")), "minima")
    n_minima, n_items = minima.count(), items.count()
    by_item = bounded(sizes, n_items)

    marks = written(minima.select("h", "u").distinct(), "marks")
    told = texts.select("k1", "k2", F.posexplode(shingles(F.col("text"), k)).alias("i", "h"))
    met = told.join(bounded(marks, n_minima), "h").select("k1", "k2", "i", "u").distinct()
    met = written(met, "met")
    holders = written(met.groupBy("k1", "k2").agg(F.collect_set("u").alias("us")), "holders")  # sizes are powers of two
    some = texts.join(bounded(holders), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    told = written(some.select("k1", "k2", "us", F.posexplode(shingles(F.col("text"), k)).alias("i", "h")), "told")

    def windows(rows: DataFrame, *keep: str) -> DataFrame:
        """The two windows of size u that a shingle is in, -1 the one that begins before the text."""
        at = F.floor(F.col("i") / F.col("u")).cast("int")
        return rows.filter("u > 0").select("k1", "k2", *keep, "u", F.explode(F.array(at, at - 1)).alias("window"))

    live = windows(met).distinct()
    signature = windows(told.select("k1", "k2", "i", "h", F.explode("us").alias("u")), "h").join(live, ["k1", "k2", "u", "window"], "left_semi").groupBy("k1", "k2", "u", "window", per_bin).agg(F.min("h").alias("h"))
    found = signature.join(bounded(minima, n_minima), ["u", "bin", "h"]).select("k1", "k2", "item_id")
    direct = told.join(bounded(minima.filter("u = 0"), n_minima), "h").select("k1", "k2", "item_id")
    asked = found.union(direct).distinct().join(bounded(items, n_items), "item_id")
    shared = asked.join(told.select("k1", "k2", "h").distinct(), ["k1", "k2", "h"]).groupBy("k1", "k2", "item_id").agg(F.count("*").alias("n_shared"))
    out = shared.join(by_item, "item_id").filter(f"100 * n_shared >= {percent} * n_item").select("k1", "k2", "item_id", "n_shared", "n_item")
    one = F.lit(1).cast("long")
    return out.union(short.select("k1", "k2", "item_id", one.alias("n_shared"), one.alias("n_item")))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no item, columns unchanged.

    Null and empty texts and rows without an id stay; copies of a text go or
    stay together; columns may have any names; without items or documents
    nothing goes.
    """
    with scratch(docs.sparkSession):
        bad = written(contaminated(docs, items, **options).select("k1", "k2").distinct(), "bad", keep=True)
    keyed = carried(docs, "text").select("*", *text_key(F.col("text"))).drop("text")
    return named(without(keyed, bad, ["k1", "k2"]), docs.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = written(contaminated(docs, table(spark, sf_dir, "benchmark")), "found")
    keys = docs.select("doc_id", *text_key(F.col("text")))
    return keys.join(bounded(found), ["k1", "k2"]).select("doc_id", "item_id", "n_shared", "n_item")


SQL10 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM v WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS h FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, k)),
t AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS h FROM (SELECT item_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM v WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM t GROUP BY item_id)
SELECT doc_id, item_id, n_shared, n_item
FROM (SELECT doc_id, item_id, count(*) AS n_shared FROM s JOIN t USING (h, k) GROUP BY doc_id, item_id) JOIN n USING (item_id)
WHERE 100 * n_shared >= 75 * n_item
"""
