"""Edits of a part in place: every byte that no edit names stays as it is.

An edit is a row (doc_id, part_key, at, upto, rank, xml): the bytes from ``at``
up to ``upto`` of a part give way to ``xml``; equal places are an insertion.
The builders here turn what is wanted of nodes (``sources.docx.nodes``, whose
rows know where their elements stand) into such rows, by joins on node
numbers; ``splice`` cuts the parts at them.  What the model does not know,
such as comments, unknown elements and the way tags are written, is never
looked at and so is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ooxml import RUN_PROPERTIES
from ..sinks.docx import escaped

KEYS = ["doc_id", "part_key"]
_EDIT = ("doc_id", "part_key", "at", "upto", "rank", "xml")


def _prefix(qname: Column) -> Column:
    """What stands before the local name: ``w:``, or nothing."""
    return F.regexp_extract(qname, "^([^:]*:)?", 0)


def _edit(rows: DataFrame, at: Column, upto: Column, xml: Column, rank: Column | int = 0) -> DataFrame:
    rank = rank if isinstance(rank, Column) else F.lit(rank)
    return rows.select(*KEYS, at.cast("int").alias("at"), upto.cast("int").alias("upto"), rank.cast("int").alias("rank"), xml.alias("xml"))


def _empty() -> Column:
    """Whether an element is written as one tag."""
    return F.col("at_inner") == F.col("at_after")


def replaced(nodes: DataFrame, xml: Column | str) -> DataFrame:
    """Edits that put ``xml`` in place of whole elements (none of it: removes them)."""
    return _edit(nodes, F.col("at_open"), F.col("at_after"), xml if isinstance(xml, Column) else F.lit(xml))


def inserted(nodes: DataFrame, xml: Column | str, where: str, rank: Column | int = 0) -> DataFrame:
    """Edits that put ``xml`` ``before`` or ``after`` elements, or into them as their ``first`` or ``last`` content; an element of one tag is opened."""
    xml = xml if isinstance(xml, Column) else F.lit(xml)
    if where in ("before", "after"):
        at = F.col("at_open" if where == "before" else "at_after")
        return _edit(nodes, at, at, xml, rank)
    at = F.col("at_inner" if where == "first" else "at_close")
    opened = F.concat(F.lit(">"), xml, F.lit("</"), "qname", F.lit(">"))
    return _edit(nodes, F.when(_empty(), F.col("at_after") - 2).otherwise(at), F.when(_empty(), F.col("at_after")).otherwise(at), F.when(_empty(), opened).otherwise(xml), rank)


def run_texts(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Edits that give runs (doc_id, part_key, run, text) another text.

    The first of a run's texts and tabs gives way to the new text (line ends
    and tabs become elements), the others go; breaks, pictures, fields and
    properties stay.  A run without text gets one at its end.  A run that is
    not there is an edit without a place, which ``splice_violations`` names.
    """
    asked = texts.select(*KEYS, F.col("run").alias("node"), F.coalesce("text", F.lit("")).alias("_text")).dropDuplicates([*KEYS, "node"])
    runs = asked.join(nodes.filter("tag = 'r'").select(*KEYS, "node", "qname", "at_open", "at_inner", "at_close", "at_after"), [*KEYS, "node"], "left")
    held = nodes.filter("tag in ('t', 'tab')").select(*KEYS, F.col("parent").alias("node"), F.struct("at_open", "at_after").alias("_piece"))
    pieces = held.groupBy(*KEYS, "node").agg(F.array_sort(F.collect_list("_piece")).alias("_pieces"))
    x = runs.join(pieces, [*KEYS, "node"], "left").withColumn("_prefix", _prefix(F.coalesce("qname", F.lit(""))))
    open_ = F.concat(F.lit("<"), "_prefix", F.lit('t xml:space="preserve">'))
    close = F.concat(F.lit("</"), "_prefix", F.lit("t>"))
    inner = escaped(F.col("_text"))
    for char, tag in (("\n", "br"), ("\t", "tab")):
        inner = F.replace(inner, F.lit(char), F.concat(close, F.lit("<"), "_prefix", F.lit(f"{tag}/>"), open_))
    x = x.withColumn("_new", F.when(F.col("_text") == "", F.lit("")).otherwise(F.concat(open_, inner, close)))
    some = x.filter("_pieces is not null").select("*", F.posexplode("_pieces").alias("_i", "_p"))
    cut = _edit(some, F.col("_p.at_open"), F.col("_p.at_after"), F.when(F.col("_i") == 0, F.col("_new")).otherwise(F.lit("")))
    return cut.unionByName(inserted(x.filter("_pieces is null"), F.col("_new"), "last"))


def run_properties(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edits that set properties of runs (doc_id, part_key, run, properties: a map of names to values).

    A value becomes the ``val`` of the property's element, an empty one an
    element without; a null value removes it.  A property that is there gives
    way, another is put where the format's order wants it, into properties
    that are made where a run has none.  Names out of the order's list are
    left out (``splice_violations`` is about places alone).
    """
    at = F.create_map(*(F.lit(x) for i, name in enumerate(RUN_PROPERTIES) for x in (name, i)))
    asked = wanted.select(*KEYS, "run", F.explode("properties").alias("_name", "_value")).withColumn("_order", at[F.col("_name")]).filter("_order is not null")
    runs = nodes.filter("tag = 'r'").select(*KEYS, F.col("node").alias("run"), "qname", "at_open", "at_inner", "at_close", "at_after")
    place = lambda c: F.struct("qname", "at_open", "at_inner", "at_close", "at_after").alias(c)
    heads = nodes.filter("tag = 'rPr'").select(*KEYS, F.col("parent").alias("run"), F.col("node").alias("_head_node"), place("_head")).dropDuplicates([*KEYS, "run"])
    inner = nodes.filter(F.col("path").rlike("/r/rPr/[^/]+$")).select(*KEYS, F.col("parent").alias("_head_node"), F.struct(at[F.col("tag")].alias("order"), "tag", "at_open", "at_after").alias("_x"))
    inner = inner.groupBy(*KEYS, "_head_node").agg(F.array_sort(F.collect_list("_x")).alias("_held"))
    x = asked.join(runs, [*KEYS, "run"], "left").join(heads, [*KEYS, "run"], "left").join(inner, [*KEYS, "_head_node"], "left")
    prefix = _prefix(F.coalesce("qname", F.lit("")))
    val = F.when(F.col("_value") == "", F.lit("")).otherwise(F.concat(F.lit(" "), prefix, F.lit('val="'), escaped(F.col("_value")), F.lit('"')))
    element = F.coalesce(F.concat(F.lit("<"), prefix, "_name", val, F.lit("/>")), F.lit(""))
    old = F.filter("_held", lambda h: h["tag"] == F.col("_name"))
    later = F.filter("_held", lambda h: h["order"] > F.col("_order"))
    x = x.select("*", element.alias("_xml"), F.get(old, F.lit(0)).alias("_old"), F.get(later, F.lit(0)).alias("_later"))
    cut = _edit(x.filter("_old is not null"), F.col("_old.at_open"), F.col("_old.at_after"), F.col("_xml"))
    new = x.filter("_old is null and _xml != ''")
    before = _edit(new.filter("_later is not null"), F.col("_later.at_open"), F.col("_later.at_open"), F.col("_xml"), F.col("_order"))
    rest = new.filter("_later is null")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_order", "_xml"))), lambda s: s["_xml"]), "")
    ends = rest.filter("_head is not null").groupBy(*KEYS, "run").agg(whole.alias("_xml"), F.first("_head").alias("_head")).select(*KEYS, "_xml", "_head.*")
    bare = rest.filter("_head is null").groupBy(*KEYS, "run").agg(whole.alias("_xml"), F.first(F.struct("qname", "at_open", "at_inner", "at_close", "at_after")).alias("_run")).select(*KEYS, "_xml", "_run.*")
    prefix = _prefix(F.coalesce("qname", F.lit("")))
    made = F.concat(F.lit("<"), prefix, F.lit("rPr>"), "_xml", F.lit("</"), prefix, F.lit("rPr>"))
    return cut.unionByName(before).unionByName(inserted(ends, F.col("_xml"), "last", 1 << 20)).unionByName(inserted(bare, made, "first", -1))


def _judged(edits: DataFrame) -> DataFrame:
    """Edits with ``reason``: null, or why they are not made: no place, or an earlier edit reaches into theirs."""
    by = Window.partitionBy(*KEYS).orderBy("at", "upto", "rank", "xml")
    reach = F.max("upto").over(by.rowsBetween(Window.unboundedPreceding, -1))
    lost = F.col("at").isNull() | F.col("upto").isNull()
    return edits.select(*_EDIT).withColumn("reason", F.when(lost, "no place").when(F.col("at") < F.coalesce(reach, F.lit(0)), "overlap"))


def splice_violations(edits: DataFrame) -> DataFrame:
    """The edits that ``splice`` leaves out, with ``reason``."""
    return _judged(edits).filter("reason is not null")


def splice(parts: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, part_key, part_name, data): the parts named by edits with these made, all other bytes equal.

    Edits are made in the order of their places; insertions in one place by
    rank, then xml.  One that reaches into an earlier one, or has no place (a
    node that is not there, a part in another encoding), is left out and named
    by ``splice_violations``.  Linear in the part and its edits.
    """
    by = Window.partitionBy(*KEYS).orderBy("at", "upto", "rank", "xml")
    good = _judged(edits).filter("reason is null").withColumn("_from", F.coalesce(F.lag("upto").over(by), F.lit(0)))
    lists = good.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("at", "upto", "rank", F.coalesce("xml", F.lit("")).alias("xml"), F.col("_from").alias("start")))).alias("_edits"))
    x = parts.filter("data is not null").select(*KEYS, "part_name", "data").join(lists, KEYS)
    piece = lambda e: F.concat(F.hex(F.substring(F.col("data"), e["start"] + 1, e["at"] - e["start"])), F.hex(F.encode(e["xml"], "UTF-8")))
    end = F.element_at("_edits", -1)["upto"]
    tail = F.hex(F.substring(F.col("data"), end + 1, F.octet_length("data")))
    return x.select(*KEYS, "part_name", F.unhex(F.concat(F.array_join(F.transform("_edits", piece), ""), tail)).alias("data"))
