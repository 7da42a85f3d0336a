"""Structure operators over model tables: ordinals, bookmarks, counts, lookups, relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import media_type
from ..sources.store import written


def text_blocks(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, block_idx, text): one paragraph per line of a text; a null text has none."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("block_idx", "text"))


def concat_in_order(rows: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """(key, text): the texts of a key put together in order, without separators."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda s: s["t"])
    return rows.groupBy(key).agg(F.array_join(pieces, "").alias("text"))


def heading_bookmarks(blocks: DataFrame, key: str, order: str, is_heading: Column) -> DataFrame:
    """(key, order, bookmark_id, bookmark_name): headings numbered from 0 in document order, named _Toc{n}."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return blocks.filter(is_heading).select(key, order, n.cast("long").alias("bookmark_id"), F.concat(F.lit("_Toc"), n.cast("string")).alias("bookmark_name"))


def section_ordinals(blocks: DataFrame, key: str, order: str, is_break: Column) -> DataFrame:
    """Every block with section_idx, the number of section breaks before it."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("section_idx", F.coalesce(F.sum(F.when(is_break, 1).otherwise(0)).over(before), F.lit(0)).cast("long"))


def first_blocks(blocks: DataFrame, n: int = 3, width: int = 60) -> DataFrame:
    """The first n blocks of each document, texts cut to ``width`` characters (the report's own limits)."""
    return blocks.filter(F.col("block_idx") < n).withColumn("text", F.substring("text", 1, width))


def counts(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    return blocks.groupBy(key).agg(F.count("*").alias("n_paragraphs"), F.sum(F.length("text")).alias("n_chars"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_r", at).filter("_r = 1").drop("_r")


def resolve(rows: DataFrame, rels: DataFrame, rel_id: str = "rel_id", how: str = "left") -> DataFrame:
    """Relationship ids to targets; ``left`` keeps what does not resolve, ``left_anti`` lists it."""
    return rows.join(rels, rel_id, how)


def content_type(parts: DataFrame, overrides: DataFrame, defaults: DataFrame) -> DataFrame:
    """The override of a part's name, else the default of its ending, else empty."""
    ending = F.lower(F.regexp_extract("part_name", r"\.([^./]*)$", 1))
    joined = parts.withColumn("ending", ending).join(overrides.withColumnRenamed("content_type", "_o"), "part_name", "left").join(defaults.withColumnRenamed("content_type", "_d"), "ending", "left")
    return joined.withColumn("content_type", F.coalesce("_o", "_d", F.lit(""))).drop("_o", "_d")


def next_rel_id(rels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, next_id): one above the largest numeric suffix of rId ids."""
    n = F.max(F.expr("try_cast(regexp_extract(rel_id, '^rId([0-9]+)$', 1) as int)"))
    return rels.groupBy(key).agg((F.coalesce(n, F.lit(0)) + 1).alias("next_id"))


def with_base_rels(rels: DataFrame, documents: DataFrame, base: DataFrame) -> DataFrame:
    """Relationships with those of the base set (rel_type, target) that a document lacks, numbered on from its largest id."""
    wanted = documents.select("doc_id").distinct().crossJoin(base)  # the base set is a constant of five rows
    lacking = wanted.join(rels.select("doc_id", "target"), ["doc_id", "target"], "left_anti")
    lacking = lacking.join(next_rel_id(rels), "doc_id", "left")
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("target")) - 1
    rel_id = F.concat(F.lit("rId"), (F.coalesce("next_id", F.lit(1)) + at).cast("string"))
    return rels.unionByName(lacking.select("doc_id", rel_id.alias("rel_id"), "rel_type", "target"), allowMissingColumns=True)


def add_relationships(rels: DataFrame, added: DataFrame) -> DataFrame:
    """Relationships with those added (doc_id, rel_type, target, target_mode), numbered on from their document's largest id, in the order of type and target.

    A target mode other than External counts as internal, which is empty.
    Added rows without a type or target are left out.
    """
    added = added.filter("doc_id is not null and rel_type != '' and target != ''").join(next_rel_id(rels), "doc_id", "left")
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("rel_type", "target")) - 1
    mode = F.when(F.lower(F.trim("target_mode")) == "external", "External").otherwise("")
    rows = added.select("doc_id", F.concat(F.lit("rId"), (F.coalesce("next_id", F.lit(1)) + at).cast("string")).alias("rel_id"), "rel_type", "target", mode.alias("target_mode"))
    return rels.unionByName(rows, allowMissingColumns=True)


def register_relationships(rels: DataFrame, existing: DataFrame) -> DataFrame:
    """Relationships with those of another list under their own ids; an id that is taken keeps its row, incomplete rows are left out."""
    own = existing.filter("rel_id != '' and rel_type != '' and target != ''").withColumn("target_mode", F.when(F.lower(F.trim("target_mode")) == "internal", "").otherwise(F.coalesce(F.trim("target_mode"), F.lit(""))))
    return rels.unionByName(own.dropDuplicates(["doc_id", "rel_id"]).join(rels.select("doc_id", "rel_id"), ["doc_id", "rel_id"], "left_anti"), allowMissingColumns=True)


def remove(rows: DataFrame, removed: DataFrame, keys: tuple[str, ...] = ("doc_id", "rel_id")) -> DataFrame:
    """Relationships, media or styles without those named; ``not_found`` lists the names that met nothing."""
    return rows.join(removed.select(*keys).distinct(), list(keys), "left_anti")


def not_found(rows: DataFrame, asked: DataFrame, keys: tuple[str, ...] = ("doc_id", "rel_id")) -> DataFrame:
    """The names asked for (a lookup or removal) that no row has."""
    return asked.select(*keys).distinct().join(rows.select(*keys), list(keys), "left_anti")


def add_media(media: DataFrame, added: DataFrame) -> DataFrame:
    """Media (doc_id, media_id, target, content_type, data) with those added (doc_id, place, name, data): numbered on in the order of ``place``, named media/image<n>.<ending>."""
    last = media.groupBy("doc_id").agg(F.max(F.expr("try_cast(regexp_extract(target, '([0-9]+)[.][^.]*$', 1) as int)")).alias("last"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) + F.coalesce("last", F.lit(0))
    rows = added.join(last, "doc_id", "left").withColumn("n", n.cast("string"))
    target = F.concat(F.lit("media/image"), "n", F.lit("."), F.lower(F.regexp_extract("name", r"\.([^./]*)$", 1)))
    return media.unionByName(rows.select("doc_id", F.concat(F.lit("img"), "n").alias("media_id"), target.alias("target"), media_type(F.col("name")).alias("content_type"), "data"))


def header_targets(assigned: DataFrame, rels: DataFrame) -> DataFrame:
    """Headers and footers (doc_id, section_idx, kind, type, and perhaps target and rel_id) with the targets and relationship ids they lack.

    Targets are header1.xml, header2.xml, .. of a document in the order of
    sections and types (default, first, even), past the numbers that are
    taken; ids go on from the largest of the document's relationships ``rels``.
    """
    of = lambda c: F.col(c) if c in assigned.columns else F.lit(None).cast("string")
    x = assigned.withColumns({"target": F.nullif(of("target"), F.lit("")), "rel_id": F.nullif(of("rel_id"), F.lit(""))})
    number = F.expr("try_cast(regexp_extract(target, '^(?:header|footer)([0-9]+)[.]xml$', 1) as int)")
    taken = F.coalesce(F.max(number).over(Window.partitionBy("doc_id", "kind")), F.lit(0))
    turn = F.when(F.col("type") == "default", 0).when(F.col("type") == "first", 1).otherwise(2)
    n = F.sum(F.when(F.col("target").isNull(), 1).otherwise(0)).over(Window.partitionBy("doc_id", "kind").orderBy("section_idx", turn, "type"))
    x = x.withColumn("target", F.coalesce("target", F.concat("kind", (taken + n).cast("string"), F.lit(".xml"))))
    m = F.sum(F.when(F.col("rel_id").isNull(), 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("section_idx", "kind", turn, "type"))
    x = x.withColumn("_m", m).join(next_rel_id(rels), "doc_id", "left")
    return x.withColumn("rel_id", F.coalesce("rel_id", F.concat(F.lit("rId"), (F.coalesce("next_id", F.lit(1)) + F.col("_m") - 1).cast("string")))).drop("_m", "next_id")


def assign_headers(sections: DataFrame, assigned: DataFrame) -> DataFrame:
    """Sections with ``references``, an array of (kind, type, rel_id), from (doc_id, section_idx, kind, type, rel_id); the first id of a kind and type counts."""
    one = assigned.groupBy("doc_id", "section_idx", "kind", "type").agg(F.min("rel_id").alias("rel_id"))
    lists = one.groupBy("doc_id", "section_idx").agg(F.array_sort(F.collect_list(F.struct("kind", "type", "rel_id"))).alias("references"))
    return sections.drop("references").join(lists, ["doc_id", "section_idx"], "left")


def reachable(rels: DataFrame, spare: int = 64) -> DataFrame:
    """(doc_id, part_key, hops): the parts that relationships (``model.part_relationships``) lead to from the package itself, by the shortest way.

    One join a hop, each round's findings written; packages take three or
    four, and a ring of parts ends by itself.  More than ``spare`` rounds are
    an error.
    """
    edges = written(rels.filter("target_key is not null").select("doc_id", F.col("source_key").alias("part_key"), "target_key").distinct(), "edges")
    edge = edges.filter("part_key = ''").select("doc_id", F.col("target_key").alias("part_key"), F.lit(1).alias("hops"))
    found = edge = written(edge.distinct(), "reached")
    for hop in range(2, spare + 2):
        step = edge.select("doc_id", "part_key").join(edges, ["doc_id", "part_key"]).select("doc_id", F.col("target_key").alias("part_key"), F.lit(hop).alias("hops")).distinct()
        edge = written(step.join(found, ["doc_id", "part_key"], "left_anti"), "reached")
        if edge.isEmpty():
            return found
        found = found.unionByName(edge)
    raise ValueError(f"parts lie over {spare} relationships deep")


def unreachable(parts: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, part_key): parts that no relationship leads to; the list of content types and lists of relationships need none."""
    some = parts.filter("part_key is not null and part_key != '[content_types].xml'").filter(~F.col("part_key").endswith(".rels"))
    return some.select("doc_id", "part_key").join(found, ["doc_id", "part_key"], "left_anti")


def place_pictures(pictures: DataFrame, taken: int = 5) -> DataFrame:
    """Pictures (doc_id, source, place, name, data, ..) with target, rel_id, number and content_type.

    source: the part below word/ in which a picture stands (null: the main
    document), place: its order there.  Equal bytes of a document are one part,
    named by the order in which they first occur; a part has one relationship
    for each source, numbered on from ``taken`` in the main document and
    from 0 elsewhere; the drawing numbers of a document run through all its
    parts, the main one first.  Names without an ending are png.
    """
    x = pictures.withColumn("_sha", F.sha2("data", 256))
    order = [F.col("source").asc_nulls_first(), F.col("place")]
    x = x.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    x = x.withColumn("_first", F.min("number").over(Window.partitionBy("doc_id", "_sha")))
    x = x.withColumn("_n", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_first")))
    x = x.withColumn("_r", F.dense_rank().over(Window.partitionBy("doc_id", "source").orderBy("_n")))
    ending = F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1))
    ending = F.first(F.when(ending == "", "png").otherwise(ending)).over(Window.partitionBy("doc_id", "_sha").orderBy("number"))
    x = x.withColumn("target", F.concat(F.lit("media/image"), F.col("_n").cast("string"), F.lit("."), ending))
    rel_id = F.concat(F.lit("rId"), (F.col("_r") + F.when(F.col("source").isNull(), taken).otherwise(0)).cast("string"))
    return x.withColumn("rel_id", rel_id).withColumn("content_type", media_type(F.col("target"))).drop("_sha", "_first", "_n", "_r")


def picture_parts(placed: DataFrame) -> DataFrame:
    """The parts of placed pictures as ``sinks.docx.assemble`` takes them: one for each source and target."""
    one = placed.groupBy("doc_id", "source", "rel_id", "target").agg(F.min("content_type").alias("content_type"), F.min("data").alias("data"))
    return one.withColumn("rel_kind", F.lit("image")).withColumn("target_mode", F.lit(None).cast("string"))
