"""Operator 7: mixing sources to target weights by Pareto order sampling.

Each source's target in words divided by its size gives the copies r that each
of its words should have on average.  floor(r) whole copies of every document
are certain; the words that are still missing are a sample without replacement
with unequal probabilities: a document's inclusion probability p grows with its
size, p = min(1, size / t), where t is such that the expected words are those
missing.  Documents with p = 1 are certain; the others are ranked by their
random odds u/(1-u) divided by their inclusion odds p/(1-p) (Rosen 1997), u a
seeded uniform number of the row, and those with the smallest ratios are taken.

The number taken is fixed beforehand: the sum of p of a source, dealt over its
classes of size (16 for each doubling) by rounding the running sums up from a
seeded start, so that in each class as many are taken as its p sum up to, less
or more than one.  As sizes in a class differ by 4.4 % at most, the words lie
near the target.  What is still missing or too much is corrected by one swap at
the border: the last document taken of one class for the first one not taken
of another, where that brings the source nearer.

Nothing is sorted by source as a whole, as a source may be hot.  t follows from
sums over the classes, a class's cut from counts over slices of the rank (128
for each doubling of the odds ratio), and only the slice in which the cut falls
is ordered row by row.  All these sums are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, bounded, carried, named, scratch, table, without, written
from .shards import expanded

#: Classes of size, and slices of the rank, for each doubling.
SIZE_CLASSES, SLICES = 16, 128
CAP = 3


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Add target to (source, source_size): weights 1, 2, 3, repeating by code point, null last.

    All sizes are shared by weight; a target stops at CAP times its source's
    size and the excess is reshared by weight.  The table has a row per
    source, so one ordered window over it is small.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sizes.withColumn("weight", F.pmod(rank - 1, F.lit(3)) + 1)
    # fill from the source that reaches its cap first: the level at which the others share the rest
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    all_of = Window.partitionBy()
    capped = F.coalesce(F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * CAP
    open_weight = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    s = s.select("source", "source_size", "weight", ((F.sum("source_size").over(all_of) - capped) / open_weight).alias("level"))
    s = s.withColumn("fits", F.col("level") * F.col("weight") <= F.col("source_size") * CAP)
    # levels rise up to the first source that fits and fall after it
    level = F.max(F.when(F.col("fits"), F.col("level"))).over(all_of)
    return s.select("source", "source_size", F.least((F.col("source_size") * CAP).cast("double"), level * F.col("weight")).alias("target"))


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))


def _class(size: Column) -> Column:
    return F.floor(F.log2(size) * SIZE_CLASSES).cast("int")


def _ranked(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with the certain copies, their probability of one more, their class of size and the rank: log2 of Pareto's odds ratio.

    Rows that are certain or out of the question have no rank (sources of
    empty texts alone cost nothing and are taken).
    """
    r = docs.join(plan, "skey")
    p = F.when(F.col("source_size") == 0, 1.0).when(F.col("threshold").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col("size") / F.col("threshold")))
    r = r.select(*docs.columns, "source_size", "target", F.floor("rate").cast("long").alias("whole"), p.alias("probability"))
    drawn = (F.col("probability") > 0) & (F.col("probability") < 1)
    odds = F.col("uniform") / (1 - F.col("uniform")) * (1 - F.col("probability")) / F.col("probability")
    certain = F.col("whole") + F.when(F.col("probability") >= 1, 1).otherwise(0)
    return r.withColumns({"certain": certain, "rank": F.when(drawn, F.log2(odds)), "class": F.when(drawn, _class(F.col("size")))}).drop("whole")


def _thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(skey, threshold): the size from which a document is certain, so that sum(min(1, size / threshold) size) is the part of the target beyond whole copies.

    At the largest size of each class that sum is exact; between two of them
    the inverse is interpolated.
    """
    sized = rows.filter("size > 0").groupBy("skey", _class(F.col("size")).alias("class"))
    sized = sized.agg(F.sum("size").alias("w"), F.sum((F.col("size").cast("decimal(19,0)") * F.col("size")).cast("decimal(38,0)")).cast("double").alias("q"), F.max("size").alias("m"))
    along = Window.partitionBy("skey").orderBy("class")  # some hundreds of rows a source
    above = F.coalesce(F.sum("w").over(along.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    sized = sized.select("skey", "class", "m", above.alias("above"), F.sum("q").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("below"))
    sized = sized.withColumn("g", F.col("above") + F.col("below") / F.col("m"))
    sized = sized.select("*", F.lag("m").over(along).alias("m0"), F.lag("g").over(along).alias("g0"))
    part = plan.select("skey", (F.col("target") - F.floor("rate") * F.col("source_size")).alias("part")).filter("part > 0")
    x = sized.join(part, "skey")
    # the first class whose sum is not above the part, else all documents lie below the threshold
    between = 1 / (1 / F.col("m") + (1 / F.col("m0") - 1 / F.col("m")) * (F.col("part") - F.col("g")) / (F.col("g0") - F.col("g")))
    t = F.when(F.col("m0").isNull(), F.col("below") / (F.col("part") - F.col("above"))).otherwise(between)
    return x.groupBy("skey").agg(F.coalesce(F.min_by(F.when(F.col("g") <= F.col("part"), t), F.when(F.col("g") <= F.col("part"), F.col("class"))), F.max("below") / F.first("part")).alias("threshold"))


def _uniform(seed: int, *key: str) -> Column:
    """52 bits of a hash of the seed and columns, in (0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 12) + F.lit(0.5)) / F.lit(float(1 << 52))


def _keys(docs: DataFrame) -> list[Column]:
    return [F.xxhash64(F.lit(i), *(F.col(c) for c in docs.columns)).alias(f"k{i}") for i in (1, 2)]


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    """The rows of ``docs`` (``carried`` with text and source) with size, skey and uniform, those equal in every column each with a number of their own."""
    own = docs.drop("text", "source")
    sized = docs.select(*own.columns, *_keys(own), words_of(F.col("text")).alias("size"), _source_key().alias("skey"))
    with scratch(docs.sparkSession):
        again = sized.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1")
        again = written(again, "again", keep=True)
    one = sized.withColumn("_copy", F.lit(0).cast("long"))
    n_again, most = again.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    if not n_again:
        return one.withColumn("uniform", _uniform(seed, "k1", "k2", "_copy")).drop("k1", "k2", "_copy")
    keys = bounded(again.select("k1", "k2"), n_again)
    counted = sized.join(keys, ["k1", "k2"], "left_semi").groupBy(*sized.columns).agg(F.count("*").alias("_n"))
    rows = without(one, again.select("k1", "k2"), ["k1", "k2"]).select(*one.columns).unionByName(expanded(counted, most))
    return rows.withColumn("uniform", _uniform(seed, "k1", "k2", "_copy")).drop("k1", "k2", "_copy")


def _plan(rows: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """A table with a row per source: its target, whole copies and threshold; and one with a row per source and class: the rank at which its sample is cut.

    rows: (size, skey, uniform), written.
    """
    sizes = rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
    sizes = sizes.select(F.when(F.col("skey") != "-", F.substring("skey", 2, 1 << 30)).alias("source"), "source_size")
    goal = written(targets(sizes).withColumn("skey", _source_key()).drop("source"), "targets")
    plan = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = written(plan.join(_thresholds(rows, plan), "skey", "left"), "plan", keep=True)
    ranked = _ranked(rows, bounded(plan))
    free = written(ranked.filter("rank is not null").select("skey", "class", "size", "rank"), "free")
    cuts = written(_cuts(free, _numbers(free, plan, seed)), "bounds")

    certain = ranked.filter("certain > 0").groupBy("skey").agg(F.sum(F.col("certain") * F.col("size")).alias("certain"))
    missing = goal.join(certain, "skey", "left").select("skey", (F.col("target") - F.coalesce("certain", F.lit(0))).alias("missing"))
    return plan, written(_swapped(free, cuts, missing), "cuts", keep=True)


def _numbers(free: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(skey, class, take): how many documents of each class are taken: the running sums of p, rounded from a start between 0 and 1.

    Sums are of whole sizes, divided once, so they are the same in every run.
    """
    sums = free.groupBy("skey", "class").agg(F.sum("size").alias("w")).join(plan.select("skey", "threshold"), "skey")
    along = Window.partitionBy("skey").orderBy("class")  # some hundreds of rows a source
    upto = F.sum("w").over(along)
    at = lambda w: F.floor(w / F.col("threshold") + _uniform(seed, "skey"))
    return sums.withColumns({"a": upto - F.col("w"), "b": upto}).select("skey", "class", (at(F.col("b")) - at(F.col("a"))).alias("take"))


def _cuts(free: DataFrame, numbers: DataFrame) -> DataFrame:
    """(skey, class, bound): the rank of the last of the ``take`` documents with the smallest ranks of each class; null where none is taken."""
    numbers = written(numbers, "numbers")
    cut = F.floor(F.col("rank") * SLICES).cast("long")
    slices = free.groupBy("skey", "class", cut.alias("slice")).agg(F.count("*").alias("n"))
    along = Window.partitionBy("skey", "class").orderBy("slice")  # some thousands of rows a class
    slices = slices.withColumn("upto", F.sum("n").over(along)).join(numbers, ["skey", "class"]).filter("take > 0 and upto >= take")
    edge = slices.groupBy("skey", "class").agg(F.min(F.struct("slice", (F.col("take") - F.col("upto") + F.col("n")).alias("need"))).alias("e")).select("skey", "class", "e.slice", "e.need")
    edge = written(edge, "edges")
    inner = Window.partitionBy("skey", "class").orderBy("rank")
    last = free.withColumn("slice", cut).join(bounded(edge), ["skey", "class", "slice"]).withColumn("at", F.row_number().over(inner)).filter("at = need")
    return numbers.select("skey", "class").join(last.select("skey", "class", F.col("rank").alias("bound")), ["skey", "class"], "left")


def _swapped(free: DataFrame, cuts: DataFrame, missing: DataFrame) -> DataFrame:
    """(skey, class, bound, closed): the cuts after one swap a source; ``closed``: the bound itself is taken.

    The candidates are the two documents at the border of each class, some
    hundreds a source at most.
    """
    inside = F.col("bound").isNotNull() & (F.col("rank") <= F.col("bound"))
    border = free.join(bounded(cuts), ["skey", "class"]).groupBy("skey", "class").agg(
        F.sum(F.when(inside, F.col("size")).otherwise(0)).alias("words"),
        F.max(F.when(inside, F.struct("rank", "size"))).alias("last"), F.min(F.when(~inside, F.struct("rank", "size"))).alias("next"),
    )
    side = lambda c: F.array_sort(F.array_compact(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col("class"), F.col(f"{c}.size").alias("size"), F.col(f"{c}.rank").alias("rank"))))))
    each = border.groupBy("skey").agg(F.sum("words").alias("words"), side("last").alias("outs"), side("next").alias("ins")).join(missing, "skey")
    each = each.withColumn("gap", F.col("missing") - F.col("words"))
    pair = lambda o, i: F.struct(F.abs(F.col("gap") - i["size"] + o["size"]).alias("off"), o["class"].alias("out"), i["class"].alias("in"), i["rank"].alias("rank"))
    best = lambda o: F.array_min(F.transform(F.filter("ins", lambda i: i["class"] != o["class"]), lambda i: pair(o, i)))
    swap = each.select("skey", "gap", F.array_min(F.transform("outs", best)).alias("s")).filter("s.off < abs(gap)").select("skey", "s.out", "s.in", F.col("s.rank").alias("rank"))
    x = cuts.join(swap, "skey", "left")
    bound = F.when(F.col("class") == F.col("in"), F.col("rank")).otherwise(F.col("bound"))
    return x.select("skey", "class", bound.alias("bound"), (~F.coalesce(F.col("class") == F.col("out"), F.lit(False))).alias("closed"))


def _copies(rows: DataFrame, plan: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add source_size, target, probability, rank and copies to the rows, from the row and two tables of a row per source, and per source and class."""
    r = _ranked(rows, bounded(plan)).join(bounded(cuts), ["skey", "class"], "left")
    taken = F.coalesce(F.when(F.col("closed"), F.col("rank") <= F.col("bound")).otherwise(F.col("rank") < F.col("bound")), F.lit(False))
    return r.select(*rows.columns, "source_size", "target", "probability", "rank", (F.col("certain") + F.when(taken, 1).otherwise(0)).cast("int").alias("copies"))


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, probability, rank, copies, uniform for every row of ``docs``.

    size: words of the text (null: 0).  copies: how often the mix takes the
    document, 0 to CAP.  probability: of one copy beyond the whole ones; null
    and empty texts have size 0 and get none (where a whole source is empty,
    one each).  rank: log2 of the odds ratio, null where nothing is drawn.  u
    comes from a hash of seed, doc_id, source and text, so reruns agree; rows
    equal in all three are numbered, and each has its own u.  A null source is
    a source of its own, after all others.  Extra columns are ignored; an
    empty table gives an empty one.

    A source's taken words differ from its target by half its largest drawn
    document and 5 % of the drawn words at most where it has over some 20
    documents to draw from, mostly by far less; with fewer, by a document.
    """
    rows = written(_rows(carried(docs.select("doc_id", "source", "text"), "text", "source"), seed).drop("in_2"), "sizes")
    slim = rows.select("size", "skey", "uniform")
    return _copies(rows, *_plan(slim, seed)).select(F.col("in_0").alias("doc_id"), F.col("in_1").alias("source"), "size", "source_size", "target", "probability", "rank", "copies", "uniform")


def mixed(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The documents as the mix has them: each ``copies`` times, columns unchanged.

    A row's copies follow from the row and the cuts, so no text is shuffled
    (but for rows equal in every column): only sizes are, to find the cuts.
    Null texts and sources, ties and repeated rows are handled as in ``mix``;
    columns may have any names; an empty table gives an empty one.
    """
    rows = _rows(carried(docs, "text", "source"), seed)
    with scratch(docs.sparkSession):
        plan, cuts = _plan(written(rows.select("size", "skey", "uniform"), "sizes"), seed)
    many = _copies(rows, plan, cuts).filter("copies > 0")
    return named(many.select(*(f"in_{i}" for i in range(len(docs.columns))), F.explode(F.sequence(F.lit(1), "copies"))), docs.columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes of it (whole documents, 0 to CAP times)."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "probability")
