"""Operator 11: fill-in-middle transformation, relationally.

A text is a row of units (a word with the white space before it, or white
space at the end), matched once, in the scan.  The lengths of the documents
that are to be cut are dealt by row; there they are exploded with their
ordinals, a window sums them, a document's cut request meets the sums at its
two unit ordinals, and the offsets found are grouped by document and meet its
text, from which the pieces are cut.  Explosion, window, join and grouping
keep the partitioning by row, so no unit is ever shuffled by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def digest(doc_id: Column, seed: int = 42) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: from the sha256 of seed and id; a null id counts as an empty one."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def planned(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, text, form, lengths, n, cut_a, cut_b: what is to become of each document, and the code points of its units.

    ``rate`` percent are cut, of these ``spm`` percent begin with the suffix.
    A text that is null (as if empty), empty or holds a sentinel stays plain.
    """
    h1, h2, h3, h4 = digest(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(sentinel))
    plain = (text == "") | marked | (F.pmod(h3, F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(h4, F.lit(100)) < spm, "spm").otherwise("psm")
    x = docs.select("doc_id", text.alias("text"), form.alias("form"), F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), F.length).alias("lengths"))
    n = F.size("lengths").cast("long")
    a, b = F.pmod(h1, n + 1), F.pmod(h2, n + 1)
    return x.withColumns({"n": n, "cut_a": F.least(a, b), "cut_b": F.greatest(a, b)})


def cut_offsets(rows: DataFrame) -> DataFrame:
    """(row, at_a, at_b): the code points before the two cuts of (row, lengths, cut_a, cut_b), partitioned by row.

    A document's cut request holds both of its unit ordinals, so that it meets
    the running sums by row alone and keeps their partitioning.  Ordinal 0 is
    offset 0; an ordinal k is where unit k - 1 ends; units after the later cut
    are not asked for.  The join is told to merge: the size the planner knows
    is that of the arrays, not of what they explode to.
    """
    dealt = rows.select("row", F.slice("lengths", F.lit(1), F.col("cut_b").cast("int")).alias("lengths")).repartition("row")
    units = dealt.select("row", F.posexplode("lengths").alias("unit", "length"))
    running = F.sum("length").over(Window.partitionBy("row").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0))
    ends = units.select("row", (F.col("unit") + 1).alias("ordinal"), running.alias("offset"))
    asked = rows.select(F.col("row").alias("asked"), "cut_a", "cut_b")
    met = asked.join(ends.hint("merge"), (F.col("row") == F.col("asked")) & ((F.col("ordinal") == F.col("cut_a")) | (F.col("ordinal") == F.col("cut_b"))), "left")
    at = lambda c: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(c), F.col("offset"))), F.lit(0))
    return met.groupBy(F.col("asked").alias("row")).agg(at("cut_a").alias("at_a"), at("cut_b").alias("at_b"))


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n, form, output, prefix_chars and middle_chars of every row of ``docs`` (doc_id, text).

    Rows stand for themselves: repeated ones each give theirs, equal ids cut
    alike.  Null and empty texts are plain and give an empty output; other
    columns are not read.  The rows to be cut are written once with a number
    of their own, so that what is found for a number is of the same row after
    a retry, whatever ``docs`` is computed from.  Texts may have any length:
    exploded units are sorted by Spark, which spills.
    """
    p = planned(docs, seed, rate, spm)
    null = F.lit(None).cast("long")
    same = p.filter("form = 'plain'").select("doc_id", "n", "form", F.col("text").alias("output"), null.alias("prefix_chars"), null.alias("middle_chars"))
    rows = written(p.filter("form != 'plain'").withColumn("row", F.monotonically_increasing_id()), "cut")
    x = rows.select("row", "doc_id", "n", "form", "text").join(cut_offsets(rows), "row")
    a, b = F.col("at_a").cast("int"), F.col("at_b").cast("int")
    prefix, middle, suffix = F.substring(F.col("text"), F.lit(1), a), F.substring(F.col("text"), a + 1, b - a), F.substring(F.col("text"), b + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_ = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    moved = x.select("doc_id", "n", "form", F.when(F.col("form") == "psm", psm).otherwise(spm_).alias("output"), a.cast("long").alias("prefix_chars"), (b - a).cast("long").alias("middle_chars"))
    return same.unionByName(moved)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    left = lambda mark: F.substring(F.substring_index(head, mark, 1), 4, 1 << 30)
    right = lambda mark: F.substring_index(head, mark, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(left(SUFFIX), middle, right(SUFFIX))).otherwise(F.concat(right(PREFIX), middle, left(PREFIX)))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed, by digests of its output and of the text rebuilt from it."""
    out = transform(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL11 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, h, list_transform(regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda x: length(x)) AS l, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, len(l)::BIGINT AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, coalesce(list_sum(l[1:least(h1 % (n + 1), h2 % (n + 1))]), 0)::BIGINT AS a, coalesce(list_sum(l[1:greatest(h1 % (n + 1), h2 % (n + 1))]), 0)::BIGINT AS b FROM f),
p AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
