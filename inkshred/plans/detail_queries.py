"""Registered queries of the format's details over the driver's tables, with their SQL: words, floating pictures, fields, errors, empty documents, header numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import enums
from ..operators import edits, structure, styles
from ..sinks import docx as sink
from ..sources import docx as source
from ..sources.store import dealt, stored, written
from . import model


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(by: Column, *values) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


_WORDS = ("left", "Both", "both", "EXACT", "atLeast", "Landscape", "EVENPAGE", "First", "Dash", "darkgray", "topAndBottom", "behind", "outside", None, "nothing")


def enum_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the events pick, as each kind understands them, and how many kinds know them."""
    word = F.col("word")
    e = _t(spark, sf_dir, "events").select("event_id", _pick(F.col("event_id"), *_WORDS).alias("word"))
    n = sum((enums.known(k, word).cast("int") for k in enums.KINDS), F.lit(0))
    return e.select("event_id", *(enums.meaning(k, word).alias(k) for k in enums.KINDS), n.alias("n_known"))


def floating_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A floating picture for every part, placed and wrapped in its own way; written and read back."""
    p = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    place = {"offset_x": F.pmod(k, F.lit(3)) * 635, "offset_y": F.pmod(k, F.lit(4)) * 1270, "h_align": _pick(k, "left", "center", "outside"), "v_align": _pick(k, "bottom", "inside"), "wrap": _pick(k, "square", "tight", "through", "topBottom", "behindText", "inFrontText"), "z_order": k}
    runs = p.select(k.cast("string").alias("doc_id"), F.lit(0).alias("block_idx"), F.lit(0).alias("run_idx"), F.lit("").alias("text"), sink.drawing(F.lit("rId6"), F.lit(1), F.lit(9525), F.lit(9525), F.col("p_name"), place).alias("drawing"))
    nodes = stored(sink.assemble_and_scan(sink.document_xml(sink.paragraph_xml(runs)), "document", "document_rels", places=False), dealt=True)
    none = spark.createDataFrame([], "doc_id string, part_key string, width_px int, height_px int")
    got = model.wrap_type(model.images(nodes, none))
    return got.select(F.col("doc_id").cast("long").alias("p_partkey"), "description", "wrap_type", "behind_text", "z_order", F.col("h_align").alias("h_align"), F.col("v_align").alias("v_align"), "offset_x", "offset_y")


def field_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field for every customer, made by its type, edited and brought up to date."""
    k = F.col("c_custkey")
    kind = _pick(k, "PAGE", "HYPERLINK", "STYLEREF", "TOC", "SEQ")
    f = _t(spark, sf_dir, "customer").select(k, styles.field(kind, F.col("c_name"), F.col("c_mktsegment")).alias("f"))
    f = f.withColumn("f", F.when(F.pmod(k, F.lit(3)) == 0, styles.set_field_code(F.col("f"), F.when(k % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit("REF "), k.cast("string"))))).when(F.pmod(k, F.lit(3)) == 1, styles.set_field_property(F.col("f"), "display", F.lit("shown"))).otherwise(styles.set_field_result(F.col("f"), F.lit("given"))))
    dirty = F.col("f.is_dirty").alias("was_dirty")
    new = f.select(k, dirty, styles.update_field(F.col("f")).alias("f"))
    return new.select(k, F.col("f.type").alias("type"), "f.code", "f.result", "was_dirty", F.col("f.is_dirty").alias("is_dirty"), F.col("f.properties")["display"].alias("display"))


def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of customers, some without bytes, some whose document is no XML: each error as a line with its context."""
    c = _t(spark, sf_dir, "customer")
    k = F.pmod(F.col("c_custkey"), F.lit(3))
    xml = c.select(F.col("c_custkey").cast("string").alias("doc_id"), F.when(k == 1, "<a>").otherwise("<a/>").alias("document_xml"))
    content = sink.assemble(dealt(xml)).withColumn("content", F.when(F.pmod(F.col("doc_id").cast("long"), F.lit(3)) == 2, F.lit(None)).otherwise(F.col("content")))
    parts = written(source.parts(content, "document"), "parts")
    errors = source.errors(parts, source.nodes(parts, "document"))
    return errors.select(F.col("doc_id").cast("long").alias("c_custkey"), "code", "part", source.error_text(errors).alias("line"))


def empty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new document for every supplier, with counts of its orders' size as extended properties: what is in it."""
    s = _t(spark, sf_dir, "supplier")
    docs = sink.empty_documents(s.select(F.col("s_suppkey").alias("doc_id")))
    counts = s.select(F.col("s_suppkey").cast("string").alias("doc_id"), F.col("s_nationkey").alias("n_paragraphs"), F.when(F.col("s_suppkey") % 2 == 0, 3).alias("n_tables"))
    nodes = stored(sink.assemble_and_scan(dealt(docs), metadata=counts, places=False), dealt=True)
    blocks = model.blocks(nodes).groupBy("doc_id").agg(F.count("*").alias("n_blocks"))
    sections = model.sections(nodes).groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.max("width").alias("width"))
    rels = model.relationships(nodes).groupBy("doc_id").agg(F.count("*").alias("n_rels"))
    out = sections.join(rels, "doc_id").join(blocks, "doc_id", "left").join(model.app_properties(nodes), "doc_id")
    return out.select(F.col("doc_id").cast("long").alias("s_suppkey"), "n_sections", "width", "n_rels", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), "n_paragraphs", "n_tables")


def header_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header or footer for every supplier in its nation's document, some with targets and ids of their own: what the others get."""
    s = edits.number_rows(_t(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", "k")
    k = F.col("k")
    doc = F.col("s_nationkey").cast("string").alias("doc_id")
    asked = s.select(doc, k.alias("section_idx"), F.when(k % 2 == 0, "header").otherwise("footer").alias("kind"), _pick(k, "default", "first", "even").alias("type"), F.when(k == 2, "header7.xml").alias("target"), F.when(k == 3, "rId2").alias("rel_id"))
    rels = s.filter("k = 1").select(doc, F.concat(F.lit("rId"), F.pmod("s_suppkey", F.lit(9)).cast("string")).alias("rel_id"))
    return structure.header_targets(asked, rels).select(F.col("doc_id").cast("int").alias("n_nationkey"), F.col("section_idx").cast("int").alias("section_idx"), "target", "rel_id")


QUERIES = {"enum_meanings": enum_meanings, "floating_pictures": floating_pictures, "field_edits": field_edits, "error_texts": error_texts, "empty_documents": empty_documents, "header_numbers": header_numbers}


def _meaning(kind: str) -> str:
    words, other = (enums.EXACT | enums.LOWER)[kind]
    return f"CASE {'w' if kind in enums.EXACT else 'lower(w)'} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in words.items()) + f" ELSE '{other}' END AS {kind}"


def _known(kind: str) -> str:
    words, _ = (enums.EXACT | enums.LOWER)[kind]
    return f"CASE WHEN {'w' if kind in enums.EXACT else 'lower(w)'} IN ({', '.join(repr(x) for x in words)}) THEN 1 ELSE 0 END"


_LIST = "[" + ", ".join("NULL" if w is None else f"'{w}'" for w in _WORDS) + "]"
SQL = {
    "enum_meanings": f"SELECT event_id, {', '.join(map(_meaning, enums.KINDS))}, {' + '.join(map(_known, enums.KINDS))} AS n_known FROM (SELECT event_id, {_LIST}[(event_id % {len(_WORDS)} + 1)::INTEGER] AS w FROM events)",
    "floating_pictures": """SELECT p_partkey, p_name AS description, ['square', 'tight', 'through', 'topBottom', 'behindText', 'inFrontText'][(p_partkey % 6 + 1)::INTEGER] AS wrap_type, p_partkey % 6 = 4 AS behind_text, p_partkey AS z_order,
CASE WHEN p_partkey % 3 = 0 THEN 'left' END AS h_align, CASE WHEN p_partkey % 4 = 0 THEN 'bottom' END AS v_align, nullif(p_partkey % 3 * 635, 0) AS offset_x, nullif(p_partkey % 4 * 1270, 0) AS offset_y FROM part""",
    "field_edits": r"""WITH f AS (SELECT c_custkey AS k, c_name, c_mktsegment, ['PAGE', 'HYPERLINK', 'STYLEREF', 'TOC', 'SEQ'][(c_custkey % 5 + 1)::INTEGER] AS type FROM customer),
g AS (SELECT *, CASE type WHEN 'PAGE' THEN 'PAGE' WHEN 'HYPERLINK' THEN 'HYPERLINK "' || c_name || '"' WHEN 'STYLEREF' THEN 'STYLEREF "' || c_name || '"' WHEN 'TOC' THEN 'TOC \\o "1-3" \\h \\z \\u' ELSE 'SEQ ' || c_name END AS code,
CASE type WHEN 'HYPERLINK' THEN c_mktsegment WHEN 'PAGE' THEN '1' WHEN 'TOC' THEN 'Table of Contents' WHEN 'SEQ' THEN '1' ELSE '' END AS result, k % 3 = 1 OR (k % 3 = 0 AND k % 2 = 1) AS dirty FROM f)
SELECT k AS c_custkey, type, CASE WHEN k % 3 = 0 AND k % 2 = 1 THEN 'REF ' || k ELSE code END AS code, CASE WHEN k % 3 = 2 THEN 'given' WHEN k % 3 = 1 AND type = 'HYPERLINK' THEN 'shown' ELSE result END AS result, dirty AS was_dirty, false AS is_dirty,
CASE WHEN k % 3 = 1 THEN 'shown' WHEN type = 'HYPERLINK' THEN c_mktsegment END AS display FROM g""",
    "error_texts": """SELECT c_custkey, 'INVALID_STATE' AS code, NULL AS part, 'operation=open | code=INVALID_STATE | no bytes' AS line FROM customer WHERE c_custkey % 3 = 2
UNION ALL SELECT c_custkey, 'XML_ERROR', 'word/document.xml', 'operation=parse | code=XML_ERROR | no element found: line 1, column 3 | context={place=line 1, column 3}' FROM customer WHERE c_custkey % 3 = 1""",
    "empty_documents": "SELECT s_suppkey, 1 AS n_sections, 11906 AS width, 5 AS n_rels, 0 AS n_blocks, s_nationkey AS n_paragraphs, CASE WHEN s_suppkey % 2 = 0 THEN 3 END AS n_tables FROM supplier",
    "header_numbers": """WITH s AS (SELECT s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, first_value(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) % 9 + 1 AS next FROM supplier),
t AS (SELECT *, k % 2 = 0 AS head, row_number() OVER (PARTITION BY n, k % 2 ORDER BY k) AS j FROM s)
SELECT n AS n_nationkey, k::INTEGER AS section_idx, CASE WHEN head THEN 'header' || CASE WHEN k = 2 THEN 7 ELSE 6 + j END ELSE 'footer' || j END || '.xml' AS target, 'rId' || CASE WHEN k = 3 THEN 2 WHEN k > 3 THEN next + k - 2 ELSE next + k - 1 END AS rel_id FROM t""",
}
