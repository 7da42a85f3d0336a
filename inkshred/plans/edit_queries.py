"""Registered queries of edits in place, axes and edit scripts over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ooxml
from ..builder import Template
from ..operators import axes, edits, splice, structure
from ..sinks import docx as sink
from ..sources import datasource
from ..sources import docx as source
from ..sources.store import dealt, shared_folder, stored, written
from . import model

_OPEN = f'<w:document xmlns:w="{ooxml.W}" xmlns:x="urn:own" xmlns:r="{ooxml.R}"><!-- kept > --><w:body><x:own a=\'1\'  b="2 > 1"/><w:p w:rsidR="00A1"><w:r><w:rPr><w:b/></w:rPr><w:t>'
_SDT = '</w:t></w:r><w:sdt><w:sdtContent><w:r><w:t>kept</w:t></w:r></w:sdtContent></w:sdt><w:r >'
_INS = '</w:p><w:p><w:ins w:id="1"><w:r><w:t xml:space="preserve">'
_CLOSE = "</w:t></w:r></w:ins></w:p><w:p/></w:body></w:document>\n"


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a package with elements the model does not know around two runs and the text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = sink.escaped(F.coalesce("text", F.lit("")))
    xml = F.concat(F.lit(sink.HEAD + _OPEN), sink.escaped(F.coalesce("source", F.lit("-"))), F.lit(_SDT + '<w:t>old</w:t><w:tab/><w:lastRenderedPageBreak/><w:t>tail</w:t></w:r>' + _INS), text, F.lit(_CLOSE))
    return sink.assemble(d.select(F.col("doc_id").cast("string").alias("doc_id"), xml.alias("document_xml")))


def lossless_run_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another text for one run and formatting for another, in place: a digest of each rewritten part, and how many other parts kept their bytes."""
    content = written(_planted(spark, sf_dir), "planted")
    nodes = stored(source.scan(content, "document"))
    runs = model.runs(nodes).select("doc_id", "part_key", "run", "run_idx")
    texts = runs.filter("run_idx = 1").select("doc_id", "part_key", "run", F.concat(F.lit("Edited\t<"), "doc_id", F.lit(">\n ")).alias("text"))
    looks = runs.filter("run_idx = 0").select("doc_id", "part_key", "run", F.create_map(F.lit("i"), F.lit(""), F.lit("color"), F.lit("FF0000")).alias("properties"))
    changes = splice.run_texts(nodes, texts).unionByName(splice.run_properties(nodes, looks))
    changed = splice.splice(source.parts(content, "document"), changes)
    out = sink.rewrite(content, changed.select("doc_id", "part_name", "data"))
    before = source.parts(content).select("doc_id", "part_key", F.sha2("data", 256).alias("before"))
    after = source.parts(out).select("doc_id", "part_key", F.sha2("data", 256).alias("after"))
    both = before.join(after, ["doc_id", "part_key"])
    kept = F.count_if((F.col("before") == F.col("after")) & (F.col("part_key") != "word/document.xml"))
    return both.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("part_key") == "word/document.xml", F.col("after"))).alias("document_sha256"), kept.alias("n_kept"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a document: elements nested to a depth of its own, with marks among them."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.pmod("p_partkey", F.lit(5)).cast("int") + 1
    level = lambda tag: F.concat_ws("", F.transform(F.sequence(F.lit(1), k), tag))
    opens = level(lambda i: F.concat(F.lit('<x:box no="'), i.cast("string"), F.lit('"><w:t>t</w:t><y:mark v="'), i.cast("string"), F.lit('"/>')))
    xml = F.concat(F.lit(f'<w:document xmlns:w="{ooxml.W}" xmlns:x="urn:x" xmlns:y="urn:y"><w:body><y:mark v="0"/>'), opens, F.repeat(F.lit("</x:box>"), k), F.lit('<y:mark v="9"/></w:body></w:document>'))
    return dealt(p.select(F.col("p_partkey").cast("string").alias("doc_id"), xml.alias("document_xml")))


def node_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each box of every part: the marks inside it, those directly inside, the first one, and an attribute."""
    nodes = stored(sink.assemble_and_scan(_nested(spark, sf_dir), "document", places=False), dealt=True)
    boxes = nodes.filter("tag = 'box'")
    value = axes.attribute("v").cast("int")
    inside = axes.descendants(nodes, boxes, "mark", block=4)
    deep = inside.groupBy("doc_id", "part_key", "of_node").agg(F.count("*").alias("n_inside"), F.sum(value).alias("sum_inside"))
    direct = axes.children(nodes, boxes, "mark").groupBy("doc_id", "part_key", "of_node").agg(F.count("*").alias("n_children"))
    one = axes.first(inside).select("doc_id", "part_key", "of_node", value.alias("first_inside"))
    out = boxes.select("doc_id", "part_key", F.col("node").alias("of_node"), axes.attribute("no").cast("int").alias("box"), "depth")
    for x in (deep, direct, one):
        out = out.join(x, ["doc_id", "part_key", "of_node"])
    return out.select(F.col("doc_id").cast("long").alias("p_partkey"), "box", "depth", "n_inside", "sum_inside", "n_children", "first_inside")


def _script(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders of a customer as the rows of a table, and an edit for every line item of them, in their order, some out of range."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = edits.number_rows(o, "o_custkey", "o_orderkey", "k").select(F.col("o_custkey").alias("table_id"), (F.col("k") - 1).cast("long").alias("row_idx"), F.lit(0).alias("col_idx"), F.col("o_orderkey").cast("string").alias("text"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_linenumber <= 2").join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("table_id")), "l_orderkey")
    kind = F.when(F.pmod("l_partkey", F.lit(3)) == 0, "delete").otherwise("insert")
    script = lines.select("table_id", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("_by"), kind.alias("op"), F.pmod("l_suppkey", F.lit(12)).cast("long").alias("at"))
    return rows, edits.number_rows(script, "table_id", "_by", "seq").drop("_by")


def row_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many row edits a table, each on what those before it left: the texts of every table in order, and the edits refused."""
    rows, script = _script(spark, sf_dir)
    out = edits.edit_rows(rows, script)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.coalesce("text", F.lit("+")).alias("t")))), lambda s: s["t"]), " ")
    bad = edits.script_violations(rows, script).groupBy("table_id").agg(F.count("*").alias("n_refused"))
    per = rows.select("table_id").distinct().join(out.groupBy("table_id").agg(texts.alias("texts")), "table_id", "left")
    return per.join(bad, "table_id", "left").select("table_id", F.coalesce("texts", F.lit("")).alias("texts"), F.coalesce("n_refused", F.lit(0)).alias("n_refused"))


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a package: a picture and a link in the body and in a header, the pictures equal for every second one, a part that nothing leads to for every third."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    png = lambda w: F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(w), 8, "0"), F.lpad(F.hex(F.lit(5)), 8, "0"), F.lit("0806000000")))
    own = lambda source, w: F.struct(F.lit(source).cast("string").alias("source"), F.lit(0).alias("place"), F.lit("a.png").alias("name"), png(w).alias("data"))
    pictures = s.select(k.cast("string").alias("doc_id"), F.explode(F.array(own(None, k + 1), own("header1.xml", F.when(k % 2 == 0, k + 1).otherwise(k + 2)))).alias("p")).select("doc_id", "p.*")
    placed = structure.place_pictures(pictures)
    drawing = sink.drawing(F.col("rel_id"), F.col("number"), F.lit(9525), F.lit(9525), F.lit("Logo"))

    def block(test: str) -> DataFrame:
        shown = placed.filter(test).select("doc_id", F.lit(0).alias("block_idx"), F.lit(0).alias("run_idx"), F.lit("").alias("text"), drawing.alias("drawing"), F.lit(None).cast("string").alias("rel_id"))
        link = s.select(k.cast("string").alias("doc_id"), F.lit(0).alias("block_idx"), F.lit(1).alias("run_idx"), F.col("s_name").alias("text"), F.lit("").alias("drawing"), F.lit("rId9").alias("rel_id"))
        return sink.paragraph_xml(shown.unionByName(link))

    part = lambda df, rel_id, kind, target, content_type, data, mode, source: df.select("doc_id", F.lit(rel_id).alias("rel_id"), F.lit(kind).alias("rel_kind"), target.alias("target"), F.lit(content_type).cast("string").alias("content_type"), data.alias("data"), F.lit(mode).cast("string").alias("target_mode"), F.lit(source).cast("string").alias("source"))
    docs = s.select(k.cast("string").alias("doc_id"))
    null = F.lit(None).cast("binary")
    parts = structure.picture_parts(placed).unionByName(part(sink.header_xml(block("source is not null")), "rId20", "header", F.lit("header1.xml"), ooxml.WORD_TYPE + "header+xml", F.col("data"), None, None))
    for source in (None, "header1.xml"):
        parts = parts.unionByName(part(docs, "rId9", "hyperlink", F.concat(F.lit(f"https://{'body' if source is None else 'header'}/"), "doc_id"), None, null, "External", source))
    content = sink.assemble(sink.document_xml(block("source is null"), sink.section_xml(references=(("header", "default", "rId20"),))), parts=parts)
    orphan = s.filter(k % 3 == 0).select(k.cast("string").alias("doc_id"), F.lit("word/orphan.xml").alias("part_name"), F.encode(F.lit("<x/>"), "UTF-8").alias("data"))
    return sink.rewrite(content, orphan)


def header_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and pictures of bodies and headers, each by its own part's relationships, with the header's section, the media that are stored, and what nothing leads to."""
    content = written(_headed(spark, sf_dir), "headed")
    nodes = stored(source.scan(content))
    parts = source.parts(content).select("doc_id", "part_key", "kind", "data")
    links = model.hyperlinks(nodes, model.runs(nodes)).select("doc_id", "part_key", "text", "url")
    images = model.images(nodes, source.image_dims(parts.filter("kind = 'media'"))).select("doc_id", "part_key", "width_px", "number")
    used = model.section_parts(nodes).select("doc_id", "part_key", F.col("kind").alias("used_as"))
    lost = structure.unreachable(parts, structure.reachable(model.part_relationships(nodes))).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("part_key")), ",").alias("unreachable"))
    media = parts.filter("kind = 'media'").groupBy("doc_id").agg(F.count("*").alias("n_media"))
    out = links.join(images, ["doc_id", "part_key"]).join(used, ["doc_id", "part_key"], "left").join(media, "doc_id").join(lost, "doc_id", "left")
    return out.select(F.col("doc_id").cast("long").alias("s_suppkey"), "part_key", "text", "url", "width_px", "number", "used_as", "n_media", "unreachable")


def docx_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package per customer through the data source: written twice (the second time in place of the first), then its document parts alone read back."""
    datasource.register(spark)
    path = f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    runs = c.select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit(0).alias("block_idx"), F.lit(0).alias("run_idx"), F.col("c_name").alias("text"))
    content = sink.assemble(sink.document_xml(sink.paragraph_xml(runs)))
    content.limit(10).withColumn("doc_id", F.concat(F.lit("old"), "doc_id")).write.format("docx").mode("overwrite").save(path)
    content.write.format("docx").mode("overwrite").save(path)
    parts = written(spark.read.format("docx").load(path).filter("kind = 'document'"), "source-parts")  # packages are opened once for both uses
    texts = model.runs(source.nodes(parts, "document")).select("doc_id", "text")
    half = F.col("bytes_read") < F.col("package_size")
    return parts.select("doc_id", F.regexp_extract("path", r"([0-9]+)\.docx$", 1).cast("long").alias("c_custkey"), half.alias("read_in_part")).join(texts, "doc_id").select("c_custkey", "text", "read_in_part")


def nested_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as documents: a table of nations, in each nation's cell a table of its suppliers, in each of theirs one of name and phone; through package and back."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    n = edits.number_rows(read("nation"), "n_regionkey", "n_nationkey", "k").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("nk"), "n_name", (F.col("k") - 1).alias("k"))
    s = edits.number_rows(read("supplier"), "s_nationkey", "s_suppkey", "k").select(F.col("s_nationkey").alias("nk"), F.col("s_suppkey").alias("sk"), "s_name", "s_nationkey", (F.col("k") - 1).alias("k")).join(n.select("nk", "r"), "nk")
    null = F.lit(None).cast("string")
    cell = lambda df, depth, table, cell_id, parent, row, col, text: df.select(F.col("r").cast("string").alias("doc_id"), F.lit(0).alias("block_idx"), F.lit(depth).alias("depth"), table.alias("table_id"), cell_id.alias("cell_id"), parent.alias("parent_id"), F.lit(0).alias("place"), row.cast("int").alias("row_idx"), F.lit(col).alias("col_idx"), text.alias("text"))
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    top = cell(n, 0, F.lit("t"), name("n", "nk"), null, F.col("k"), 0, F.col("n_name"))
    middle = cell(s, 1, name("tn", "nk"), name("s", "sk"), name("n", "nk"), F.col("k"), 0, F.col("sk").cast("string"))
    deep = [cell(s, 2, name("ts", "sk"), F.concat(name("d", "sk"), F.lit(f"-{c}")), name("s", "sk"), F.lit(0), c, F.col(x).cast("string")) for c, x in enumerate(("s_name", "s_nationkey"))]
    blocks = sink.nested_table_xml(top.unionByName(middle).unionByName(deep[0]).unionByName(deep[1]), 2)
    nodes = stored(sink.assemble_and_scan(sink.document_xml(blocks), "document", places=False), dealt=True)
    got = model.table_cells(nodes, model.paragraphs(nodes, model.runs(nodes)))
    up = got.select("doc_id", F.col("cell").alias("parent_cell"), F.rtrim("text", F.lit("\n")).alias("parent"))
    out = got.join(up, ["doc_id", "parent_cell"], "left")
    return out.select(F.col("doc_id").cast("int").alias("region"), F.rtrim("text", F.lit("\n")).alias("text"), "parent", F.col("row_idx").cast("int").alias("row_idx"), F.col("col_idx").cast("int").alias("col_idx"))


def template_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement for every customer: a heading, a paragraph and a table row for each order, and a last paragraph; written and read back."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    made = Template(c, "c_custkey").paragraph("Heading1").text(F.col("c_name"))
    made = made.each_paragraph(o, "o_custkey", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), bold=F.pmod("o_orderkey", F.lit(2)) == 0)
    made = made.each_table(o, "o_custkey", "o_orderkey", [F.col("o_orderkey"), F.col("o_orderpriority")], header=["order", "priority"]).paragraph().text("Total ").text(F.col("c_mktsegment"))
    nodes = stored(made.nodes("document"), dealt=True)
    runs = model.runs(nodes)
    p = model.paragraphs(nodes, runs)
    bold = runs.groupBy("doc_id", "para").agg(F.max("bold").alias("bold"))
    body = p.filter("container = 'body' and n_runs > 0").join(bold, ["doc_id", "para"]).select("doc_id", F.lit("p").alias("kind"), F.col("para_idx").cast("int").alias("at"), F.lit(0).alias("col"), "text", "bold")
    cells = model.table_cells(nodes, p).select("doc_id", F.lit("tc").alias("kind"), F.col("row_idx").cast("int").alias("at"), F.col("col_idx").cast("int").alias("col"), "text", F.lit(None).cast("boolean").alias("bold"))
    return body.unionByName(cells).withColumn("c_custkey", F.col("doc_id").cast("long")).drop("doc_id")


def template_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for every supplier with a field, a link outside and one to a bookmark, some of them not said; written and read back."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    code = F.when(k % 4 != 0, F.concat(F.lit("SEQ s"), k.cast("string")))
    url = F.when(k % 3 != 0, F.concat(F.lit("https://example.com/?a=1&s="), k.cast("string")))
    note = Template(s, "s_suppkey").paragraph().text("No. ").field(code, k, k % 2 == 0, bold=True)
    note = note.paragraph().link(F.col("s_name"), url, italic=True).text(" or ").link("below", anchor=F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    nodes = stored(note.nodes("document", "document_rels"), dealt=True)
    runs = model.runs(nodes)
    id_ = F.col("doc_id").cast("long").alias("s_suppkey")
    f = model.fields(nodes, runs).select(id_, F.lit("field").alias("kind"), F.col("code").alias("target"), F.col("result").alias("text"), F.col("dirty").alias("flag"))
    look = runs.select("doc_id", "part_key", "para", "run", F.coalesce("italic", F.lit(False)).alias("flag"))
    h = model.hyperlinks(nodes, runs).join(look, ["doc_id", "part_key", "para", "run"]).select(id_, F.lit("link").alias("kind"), F.col("url").alias("target"), "text", "flag")
    p = model.paragraphs(nodes, runs).filter("n_runs > 0").select(id_, F.lit("paragraph").alias("kind"), F.col("para_idx").cast("string").alias("target"), "text", F.lit(False).alias("flag"))
    return f.unionByName(h).unionByName(p.filter("target = '1'"))


QUERIES = {"nested_tables": nested_tables, "template_orders": template_orders, "template_links": template_links, "docx_source": docx_source, "header_parts": header_parts, "lossless_run_edit": lossless_run_edit, "node_axes": node_axes, "row_scripts": row_scripts}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(c: str) -> str:
    t = rf"regexp_replace({c}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{{FFFE}}\x{{FFFF}}]', chr(65533), 'g')"
    for a, b in (("'&'", "'&amp;'"), ("'<'", "'&lt;'"), ("'>'", "'&gt;'"), ("'\"'", "'&quot;'"), ("chr(13)", "'&#13;'")):
        t = f"replace({t}, {a}, {b})"
    return t


_BODY = _OPEN.replace("<w:b/>", '<w:b/><w:i/><w:color w:val="FF0000"/>')
_T = '<w:t xml:space="preserve">'
SQL = {
    "nested_tables": """WITH n AS (SELECT n_regionkey AS r, n_nationkey AS nk, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation),
s AS (SELECT r, nk, n_name, s_suppkey, s_name, row_number() OVER (PARTITION BY nk ORDER BY s_suppkey) - 1 AS k FROM supplier JOIN n ON s_nationkey = nk)
SELECT r AS region, n_name AS text, NULL AS parent, k::INTEGER AS row_idx, 0 AS col_idx FROM n UNION ALL SELECT r, s_suppkey::VARCHAR, n_name, k::INTEGER, 0 FROM s
UNION ALL SELECT r, s_name, s_suppkey::VARCHAR, 0, 0 FROM s UNION ALL SELECT r, nk::VARCHAR, s_suppkey::VARCHAR, 0, 1 FROM s""",
    "template_orders": """WITH o AS (SELECT o_custkey AS c, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
n AS (SELECT c_custkey AS c, c_name, c_mktsegment, (SELECT count(*) FROM o WHERE o.c = c_custkey) AS n FROM customer)
SELECT c AS c_custkey, 'p' AS kind, 0 AS "at", 0 AS col, c_name AS text, false AS bold FROM n UNION ALL SELECT c, 'p', k::INTEGER, 0, 'Order ' || o_orderkey, o_orderkey % 2 = 0 FROM o UNION ALL SELECT c, 'p', n::INTEGER + 1, 0, 'Total ' || c_mktsegment, false FROM n
UNION ALL SELECT c, 'tc', 0, i, t, NULL FROM n, (VALUES (0, 'order'), (1, 'priority')) v(i, t) UNION ALL SELECT c, 'tc', k::INTEGER, 0, o_orderkey::VARCHAR, NULL FROM o UNION ALL SELECT c, 'tc', k::INTEGER, 1, o_orderpriority, NULL FROM o""",
    "template_links": """SELECT s_suppkey, 'field' AS kind, 'SEQ s' || s_suppkey AS target, s_suppkey::VARCHAR AS text, s_suppkey % 2 = 0 AS flag FROM supplier WHERE s_suppkey % 4 != 0
UNION ALL SELECT s_suppkey, 'link', 'https://example.com/?a=1&s=' || s_suppkey, s_name, true FROM supplier WHERE s_suppkey % 3 != 0 UNION ALL SELECT s_suppkey, 'link', '#n' || s_nationkey, 'below', false FROM supplier
UNION ALL SELECT s_suppkey, 'paragraph', '1', s_name || ' or below', false FROM supplier""",
    "docx_source": "SELECT c_custkey, c_name AS text, true AS read_in_part FROM customer",
    "header_parts": """SELECT s_suppkey, part_key, s_name AS text, 'https://' || place || '/' || s_suppkey AS url, (s_suppkey + 1 + CASE WHEN place = 'header' AND s_suppkey % 2 = 1 THEN 1 ELSE 0 END)::INTEGER AS width_px, no AS number, used_as, 1 + s_suppkey % 2 AS n_media, CASE WHEN s_suppkey % 3 = 0 THEN 'word/orphan.xml' END AS unreachable
FROM supplier, (VALUES ('body', 'word/document.xml', 1, NULL), ('header', 'word/header1.xml', 2, 'header')) v(place, part_key, no, used_as)""",
    "lossless_run_edit": f"""SELECT doc_id, sha256({_quoted('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>')} || chr(10) || {_quoted(_BODY)} || {_escaped("coalesce(source, '-')")} || {_quoted(_SDT + _T + 'Edited</w:t><w:tab/>' + _T + '&lt;')} || doc_id || {_quoted('&gt;</w:t><w:br/>' + _T + ' </w:t><w:lastRenderedPageBreak/></w:r>' + _INS)} || {_escaped("coalesce(text, '')")} || {_quoted(_CLOSE.strip())} || chr(10)) AS document_sha256, 10 AS n_kept FROM documents""",
    "node_axes": "SELECT p_partkey, b.box, b.box + 1 AS depth, k - b.box + 1 AS n_inside, (k * (k + 1) - b.box * (b.box - 1)) // 2 AS sum_inside, 1 AS n_children, b.box AS first_inside FROM (SELECT p_partkey, p_partkey % 5 + 1 AS k FROM part) p JOIN (VALUES (1), (2), (3), (4), (5)) b(box) ON b.box <= k",
    "row_scripts": """WITH RECURSIVE r AS (SELECT o_custkey AS t, list(o_orderkey::VARCHAR ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey),
s AS (SELECT o_custkey AS t, l_partkey % 3 = 0 AS del, l_suppkey % 12 AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 2),
f AS (SELECT t, 0::BIGINT AS k, l, 0::BIGINT AS bad FROM r UNION ALL
SELECT f.t, s.k, CASE WHEN del AND w < len(l) THEN l[1:w] || l[w + 2:] WHEN NOT del AND w <= len(l) THEN l[1:w] || ['+'] || l[w + 1:] ELSE l END, f.bad + (CASE WHEN (del AND w >= len(l)) OR (NOT del AND w > len(l)) THEN 1 ELSE 0 END) FROM f JOIN s ON s.t = f.t AND s.k = f.k + 1)
SELECT t AS table_id, array_to_string(l, ' ') AS texts, bad AS n_refused FROM f QUALIFY row_number() OVER (PARTITION BY t ORDER BY k DESC) = 1""",
}
