"""Registered queries of styles and themes over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import styles
from ..sinks import docx as sink
from ..sources.store import stored
from . import model

_THEMES = tuple(styles.THEMES)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for every part: a chain of paragraph styles of a length of its own, some closed to a ring, one with a base that is not there, and two character styles."""
    k = F.col("p_partkey")
    p = _t(spark, sf_dir, "part").select(k.cast("string").alias("doc_id"), k, (F.pmod(k, F.lit(6)) + 1).cast("int").alias("h"))
    i = F.col("i")
    chain = p.select("*", F.explode(F.sequence(F.lit(1), F.col("h"))).alias("i"))
    base = F.when(i > 1, F.concat(F.lit("S"), (i - 1).cast("string"))).when(F.pmod(k, F.lit(7)) == 0, F.concat(F.lit("S"), F.col("h").cast("string"))).when(F.pmod(k, F.lit(11)) == 0, "Nowhere").otherwise("Normal")
    null = lambda kind: F.lit(None).cast(kind)
    row = lambda df, style_id, kind, based_on, default, **said: df.select("doc_id", style_id.alias("style_id"), style_id.alias("name"), F.lit(kind).alias("type"), based_on.alias("based_on"), F.lit(default).alias("is_default"), *(said.get(c, null(t)).cast(t).alias(c) for c, t in (("size", "int"), ("bold", "boolean"), ("italic", "boolean"), ("color", "string"), ("alignment", "string"), ("spacing_before", "int"))))
    links = row(chain, F.concat(F.lit("S"), i.cast("string")), "paragraph", base, False, color=F.when(i == 1, F.lpad(F.hex(k), 6, "0")), bold=F.when(i == 2, True), size=F.when(i == 3, 24 + F.pmod(k, F.lit(10))), alignment=F.when(i % 2 == 0, "center"))
    normal = row(p, F.lit("Normal"), "paragraph", null("string"), True, size=F.lit(30), spacing_before=F.pmod(k, F.lit(50)) + 1)
    character = row(p, F.lit("C0"), "character", null("string"), False, italic=F.lit(True), size=F.lit(40)).unionByName(row(p, F.lit("C1"), "character", F.lit("C0"), False, color=F.lit("00FF00")))
    return links.unionByName(normal).unionByName(character)


def effective_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of several hops written and read back: three runs of every part as they are shown, with what is wrong about their paragraph's style."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), (F.pmod("p_partkey", F.lit(6)) + 1).cast("int").alias("h"))
    run = lambda b, i, style=None, size=None: F.struct(F.lit(b).alias("block_idx"), F.lit(i).alias("run_idx"), F.lit(f"r{b}{i}").alias("text"), F.lit(style).cast("string").alias("style"), F.lit(size).cast("int").alias("size"))
    runs = p.select("doc_id", F.explode(F.array(run(0, 0), run(0, 1, "C1"), run(1, 0, size=26))).alias("r")).select("doc_id", "r.*")
    about = p.select("doc_id", F.lit(0).alias("block_idx"), F.concat(F.lit("S"), F.col("h").cast("string")).alias("style_id")).unionByName(p.select("doc_id", F.lit(1).alias("block_idx"), F.lit(None).cast("string").alias("style_id")))
    documents = sink.document_xml(sink.paragraph_xml(runs, about)).join(sink.style_sheets(_sheets(spark, sf_dir), "doc_id"), "doc_id")
    nodes = stored(sink.assemble_and_scan(documents, "document", "styles", places=False), dealt=True)
    # read by four joins, made once
    whole = stored(styles.resolved(model.styles(nodes), model.STYLE_FORMATS), keys=("doc_id", "style_id"), dealt=True)
    r = model.stored_runs(nodes)
    got = model.effective_formatting(r, model.paragraphs(nodes, r), whole)
    bad = whole.select("doc_id", F.col("style_id").alias("paragraph_style"), "hops", F.array_join("violations", ",").alias("violations"))
    out = got.join(bad, ["doc_id", "paragraph_style"])
    shown = ("size", "bold", "italic", "color", "alignment", "spacing_before")
    return out.select(F.col("doc_id").cast("long").alias("p_partkey"), "text", "paragraph_style", "run_style", "hops", "violations", *(F.col(f"shown.{c}").alias(c) for c in shown))


def style_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with a style for every brand of the parts added, some under ids that are taken or reserved: by type."""
    k = F.col("p_size")
    kind = F.when(k % 3 == 0, "paragraph").when(k % 3 == 1, "character").otherwise("table")
    one = _t(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("p_size"))
    name = F.when(k == 1, "Normal").when(k == 2, "BookTitle").otherwise(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    added = one.select(name.alias("style_id"), F.col("p_brand").alias("name"), kind.alias("type"), F.when(kind == "paragraph", "Normal").alias("based_on"), F.lit(False).alias("is_default"))
    every = styles.with_styles(styles.catalogue(spark), added)
    return every.groupBy("type").agg(F.count("*").alias("n"), F.count_if("is_default").alias("n_default"), F.count("based_on").alias("n_based"))


def _themed(spark: SparkSession, rows: DataFrame, key: str, *ids: str) -> DataFrame:
    """(key, theme, style rows): each row's sheet in a theme picked by its key."""
    pick = F.element_at(F.array(*map(F.lit, _THEMES)), (F.pmod(key, F.lit(len(_THEMES))) + 1).cast("int"))
    sheets = styles.apply_theme(styles.catalogue(spark).filter("type = 'paragraph'").filter(F.col("style_id").isin(*ids)), styles.themes(spark))
    return rows.select(key, pick.alias("theme")).join(sheets, "theme")


def theme_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's styles in a theme."""
    out = _themed(spark, _t(spark, sf_dir, "customer"), "c_custkey", "Normal", "Heading1", "Heading2", "Heading3", "Title", "Subtitle", "Quote", "IntenseQuote", "ListParagraph")
    return out.select("c_custkey", "theme", "style_id", "size", "color", "spacing_before", "spacing_after", "line_value", "indent_left", "indent_right")


def style_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's style sheet in a package, read back."""
    themed = _themed(spark, _t(spark, sf_dir, "supplier"), "s_suppkey", "Normal", "Heading1", "Title", "Subtitle", "IntenseQuote").withColumn("doc_id", F.col("s_suppkey").cast("string"))
    text = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.lit(0).alias("block_idx"), F.lit(0).alias("run_idx"), F.col("s_name").alias("text"))
    back = styles.theme_backgrounds(themed.select("doc_id", "theme").distinct(), styles.themes(spark))
    documents = sink.document_xml(sink.paragraph_xml(text), backgrounds=back).join(sink.style_sheets(themed.drop("theme", "s_suppkey"), "doc_id"), "doc_id")
    nodes = stored(sink.assemble_and_scan(documents, "document", "styles", places=False), dealt=True)
    got = model.styles(nodes).join(model.background(nodes).select("doc_id", F.col("color").alias("background")), "doc_id", "left")
    return got.select(F.col("doc_id").cast("long").alias("s_suppkey"), "style_id", F.col("size").cast("int").alias("size"), "color", "background")


QUERIES = {"effective_formatting": effective_formatting, "style_catalogue": style_catalogue, "theme_apply": theme_apply, "style_sheets": style_sheets}

# The presets' colours (primary, secondary, text, light text, heading), sizes and spacings, whether headings are coloured.
_PRESETS = """(VALUES (0, 'corporate', '2F5496', '4F81BD', '000000', '595959', '2F5496', 22, 0, 160, 240, 120, 480, 32, 26, 24, true),
(1, 'startup', '6A5ACD', '48D1CC', '212121', '757575', '6A5ACD', 22, 0, 200, 320, 160, 560, 36, 28, 24, true),
(2, 'modern', '34495E', '95A5A6', '2C3E50', '7F8C8D', '34495E', 22, 0, 240, 400, 200, 640, 34, 28, 24, true),
(3, 'fintech', '005288', '007BA7', '212121', '616161', '005288', 22, 0, 140, 280, 140, 400, 30, 26, 22, true),
(4, 'academic', '000000', '404040', '000000', '606060', '000000', 24, 0, 0, 240, 120, 480, 28, 26, 24, false),
(5, 'tech-presentation', '007ACC', '505050', '212121', '6C757D', '007ACC', 22, 0, 160, 320, 160, 480, 32, 26, 24, true),
(6, 'tech-darkmode', '4FC0FF', 'CE9178', 'D4D4D4', '969696', '4FC0FF', 22, 0, 160, 320, 160, 480, 32, 26, 24, true)) t(no, theme, pri, sec, txt, light, head, body, pb, pa, hb, ha, ss, h1, h2, h3, use_color)"""
_COLOR = "CASE WHEN style_id IN ('Normal', 'ListParagraph') THEN txt WHEN style_id IN ('Subtitle', 'Quote') THEN light WHEN style_id = 'IntenseQuote' THEN sec WHEN NOT use_color THEN NULL WHEN style_id = 'Title' THEN pri ELSE head END"

SQL = {
    "effective_formatting": """WITH RECURSIVE p AS (SELECT p_partkey AS k, p_partkey % 6 + 1 AS h FROM part),
s AS (SELECT k, 'S' || i AS id, CASE WHEN i > 1 THEN 'S' || (i - 1) WHEN k % 7 = 0 THEN 'S' || h WHEN k % 11 = 0 THEN 'Nowhere' ELSE 'Normal' END AS base, CASE WHEN i = 3 THEN 24 + k % 10 END AS size, CASE WHEN i = 2 THEN true END AS bold, NULL::BOOLEAN AS italic, CASE WHEN i = 1 THEN lpad(upper(to_hex(k)), 6, '0') END AS color, CASE WHEN i % 2 = 0 THEN 'center' END AS alignment, NULL::BIGINT AS before
  FROM (SELECT k, h, unnest(range(1, h + 1)) AS i FROM p)
  UNION ALL SELECT k, 'Normal', NULL, 30, NULL, NULL, NULL, NULL, k % 50 + 1 FROM p
  UNION ALL SELECT k, 'C0', NULL, 40, NULL, true, NULL, NULL, NULL FROM p UNION ALL SELECT k, 'C1', 'C0', NULL, NULL, NULL, '00FF00', NULL, NULL FROM p),
c AS (SELECT k, id, id AS at, 0 AS hop FROM s UNION ALL SELECT c.k, c.id, b.id, hop + 1 FROM c JOIN s ON s.k = c.k AND s.id = c.at JOIN s b ON b.k = c.k AND b.id = s.base WHERE hop < 12),
m AS (SELECT k, id, max(hop) AS hops, max(hop) = 12 AS loops FROM c GROUP BY k, id),
r AS (SELECT c.k, c.id, any_value(CASE WHEN loops THEN NULL ELSE hops END) AS hops, any_value(CASE WHEN loops THEN 'cycle' ELSE '' END) AS bad,
  arg_min(s.size, hop) FILTER (s.size IS NOT NULL) AS size, arg_min(s.bold, hop) FILTER (s.bold IS NOT NULL) AS bold, arg_min(s.italic, hop) FILTER (s.italic IS NOT NULL) AS italic, arg_min(s.color, hop) FILTER (s.color IS NOT NULL) AS color, arg_min(s.alignment, hop) FILTER (s.alignment IS NOT NULL) AS alignment, arg_min(s.before, hop) FILTER (s.before IS NOT NULL) AS before
  FROM c JOIN m USING (k, id) JOIN s ON s.k = c.k AND s.id = c.at WHERE NOT loops OR hop = 0 GROUP BY c.k, c.id),
v AS (SELECT r.*, CASE WHEN bad = '' AND s.base = 'Nowhere' THEN 'unknown base' ELSE bad END AS violations FROM r JOIN s USING (k, id))
SELECT p.k AS p_partkey, t.text, v.id AS paragraph_style, ch.id AS run_style, v.hops::INTEGER AS hops, v.violations, coalesce(t.size, ch.size, v.size)::BIGINT AS size, coalesce(ch.bold, v.bold) AS bold, coalesce(ch.italic, v.italic) AS italic, coalesce(ch.color, v.color) AS color, v.alignment, v.before AS spacing_before
FROM p JOIN (VALUES ('r00', true, NULL, NULL), ('r01', true, 'C1', NULL), ('r10', false, NULL, 26)) t(text, styled, run, size) ON true JOIN v ON v.k = p.k AND v.id = CASE WHEN styled THEN 'S' || h ELSE 'Normal' END LEFT JOIN v ch ON ch.k = p.k AND ch.id = t.run""",
    "style_catalogue": """WITH b AS (SELECT p_brand, min(p_size) AS k FROM part GROUP BY p_brand), a AS (SELECT DISTINCT ON (id) id, kind FROM (SELECT CASE k WHEN 1 THEN 'Normal' WHEN 2 THEN 'BookTitle' ELSE regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') END AS id, ['paragraph', 'character', 'table'][(k % 3 + 1)::INTEGER] AS kind FROM b) WHERE id NOT IN ('Normal', 'BookTitle')),
c AS (SELECT * FROM (VALUES ('paragraph', 29::BIGINT, 1::BIGINT, 28::BIGINT), ('character', 6, 1, 5), ('table', 8, 1, 7)) t(type, n, n_default, n_based))
SELECT type, n + (SELECT count(*) FROM a WHERE kind = type) AS n, n_default, n_based + (SELECT count(*) FROM a WHERE kind = type AND kind = 'paragraph') AS n_based FROM c""",
    "theme_apply": f"""SELECT c_custkey, theme, style_id, CASE style_id WHEN 'Heading1' THEN h1 WHEN 'Heading2' THEN h2 WHEN 'Heading3' THEN h3 WHEN 'Title' THEN h1 + 8 WHEN 'Subtitle' THEN body + 4 WHEN 'IntenseQuote' THEN body + 2 WHEN 'Quote' THEN NULL ELSE body END AS size, {_COLOR} AS color,
CASE WHEN style_id LIKE 'Heading%' THEN hb WHEN style_id = 'Normal' THEN pb WHEN style_id = 'IntenseQuote' THEN 120 END AS spacing_before,
CASE WHEN style_id LIKE 'Heading%' THEN ha WHEN style_id = 'Normal' THEN pa WHEN style_id = 'Title' THEN ha * 2 WHEN style_id = 'Subtitle' THEN ss WHEN style_id = 'ListParagraph' THEN pa // 2 WHEN style_id = 'IntenseQuote' THEN 120 END AS spacing_after,
CASE WHEN style_id = 'Normal' THEN [240, 280, 300, 240, 480, 260, 260][(no + 1)::INTEGER] END AS line_value, CASE WHEN style_id = 'Quote' THEN 720 END AS indent_left, CASE WHEN style_id = 'Quote' THEN 720 END AS indent_right
FROM customer JOIN {_PRESETS} ON no = c_custkey % 7, (VALUES ('Normal'), ('Heading1'), ('Heading2'), ('Heading3'), ('Title'), ('Subtitle'), ('Quote'), ('IntenseQuote'), ('ListParagraph')) s(style_id)""",
    "style_sheets": f"SELECT s_suppkey, style_id, nullif(CASE style_id WHEN 'Heading1' THEN h1 WHEN 'Title' THEN h1 + 8 WHEN 'Subtitle' THEN body + 4 WHEN 'IntenseQuote' THEN body + 2 ELSE body END, 22) AS size, {_COLOR} AS color, CASE theme WHEN 'tech-darkmode' THEN '1E1E1E' ELSE 'FFFFFF' END AS background FROM supplier JOIN {_PRESETS} ON no = s_suppkey % 7, (VALUES ('Normal'), ('Heading1'), ('Title'), ('Subtitle'), ('IntenseQuote')) s(style_id)",
}
