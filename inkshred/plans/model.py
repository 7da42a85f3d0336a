"""From XML nodes to the document model: blocks, paragraphs, runs, fields, tables, sections, relationships.

Each table is a projection or a grouped, ordered fold of the node rows; ties
between them are equi-joins on (doc_id, part_key, ordinal).  A document is
never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ooxml
from ..functions import enums
from ..sources.store import merged, stored

BODY = "document/body"


def _up(levels: int) -> Column:
    """The ancestor ``levels`` above a node (0: itself)."""
    return F.get("ancestors", F.size("ancestors") - 1 - levels)


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def strict_int(text: Column) -> Column:
    """An integer with an optional sign and nothing else; null otherwise."""
    return F.when(text.rlike(r"^[+-]?[0-9]{1,18}$"), text.try_cast("long"))


def on(value: Column) -> Column:
    """An on/off element's value: present means on, unless its value says otherwise."""
    return ~F.lower(F.coalesce(value, F.lit("true"))).isin("0", "false", "off")


def _border() -> Column:
    """A border side's line, its width in eighths of a point and its colour."""
    return F.struct(F.lower(_attr("val")).alias("style"), strict_int(_attr("sz")).alias("size"), _attr("color").alias("color"))


def paragraph_nodes(nodes: DataFrame) -> DataFrame:
    """Paragraph elements of bodies, cells, headers and footers with their container."""
    p = nodes.filter("tag = 'p'")
    container = F.when(F.col("path") == f"{BODY}/p", "body").when(F.col("path").rlike(r"(^|/)tbl/tr/tc/p$"), "cell").when(F.col("path") == "hdr/p", "header").when(F.col("path") == "ftr/p", "footer")
    return p.withColumn("container", container).filter("container is not null").select("doc_id", "part_key", F.col("node").alias("para"), "container", F.col("parent").alias("container_id"), "place")


def of_paragraphs(nodes: DataFrame) -> DataFrame:
    """The nodes that ``runs`` and ``paragraphs`` read, for queries that store no others."""
    return nodes.filter((F.col("tag") == "p") | F.col("path").contains("/pPr/") | F.col("path").contains("/r/"))


def blocks(nodes: DataFrame) -> DataFrame:
    """doc_id, block_idx, kind (p or tbl) and node of the body's children, in order; other elements are skipped."""
    body = nodes.filter(F.col("path").isin(f"{BODY}/p", f"{BODY}/tbl"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("node")) - 1
    return body.select("doc_id", at.alias("block_idx"), F.col("tag").alias("kind"), "node")


def runs(nodes: DataFrame) -> DataFrame:
    """doc_id, part_key, para, run, text, breaks, drawings, formatting and hyperlink of every run.

    A run's text is its ``t`` texts and a tab for every ``tab`` in order; its
    breaks are listed beside it.  Runs stand in a paragraph or in a hyperlink
    or simple field of one; other wrappers are not read.  Runs without text,
    break or picture are none, but for the one at which a field parts code
    from result.  ``said`` holds the switches with a null where the run is
    silent and its styles decide.
    """
    inside = F.col("path").contains("/r/") & F.col("path").rlike(r"(^|/)p/((hyperlink|fldSimple)/)?r/")
    deep = F.when(F.regexp_extract("path", r"(?:^|/)p/(?:(hyperlink|fldSimple)/)?r/", 1) != "", 1).otherwise(0)
    below = F.regexp_extract("path", r"(?:^|/)p/(?:(?:hyperlink|fldSimple)/)?r/(.*)$", 1)
    x = nodes.filter(inside).withColumn("below", below).filter(~F.col("below").rlike(r"(^|/)r/"))
    x = x.withColumn("levels", F.size(F.split("below", "/")))
    x = x.withColumn("run", F.get("ancestors", F.size("ancestors") - 1 - F.col("levels")))
    x = x.withColumn("para", F.get("ancestors", F.size("ancestors") - 2 - F.col("levels") - deep))
    x = x.withColumn("wrapper", F.when(deep == 1, F.get("ancestors", F.size("ancestors") - 2 - F.col("levels"))))
    is_text, is_tab, is_break = F.col("below") == "t", F.col("below") == "tab", F.col("below") == "br"
    piece = F.when(is_text, F.coalesce("text", F.lit(""))).when(is_tab, F.lit("\t"))
    kind = F.when(F.lower(_attr("type")).isin("page", "column"), F.lower(_attr("type"))).otherwise("line")
    first = lambda path, value: F.min(F.when(F.col("below") == path, value))
    ordered = lambda test, value: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("node", value.alias("v"))))), lambda s: s["v"])
    out = x.groupBy("doc_id", "part_key", "para", "run", "wrapper").agg(
        F.array_join(ordered(is_text | is_tab, piece), "").alias("text"),
        ordered(is_break, kind).alias("breaks"),
        F.coalesce(first("rPr/b", on(_attr("val"))), F.lit(False)).alias("bold"),
        F.coalesce(first("rPr/i", on(_attr("val"))), F.lit(False)).alias("italic"),
        F.coalesce(first("rPr/strike", on(_attr("val"))), F.lit(False)).alias("strike"),
        first("rPr/u", F.lower(_attr("val"))).alias("underline"),
        first("rPr/color", _attr("val")).alias("color"),
        F.coalesce(first("rPr/sz", strict_int(_attr("val"))), first("rPr/szCs", strict_int(_attr("val")))).alias("size"),
        first("rPr/highlight", F.lower(_attr("val"))).alias("highlight"),
        first("rPr/rFonts", F.coalesce(_attr("ascii"), _attr("hAnsi"))).alias("font"),
        first("rPr/rFonts", _attr("eastAsia")).alias("font_east_asia"),
        first("rPr/rFonts", _attr("cs")).alias("font_cs"),
        F.array_sort(F.collect_list(F.when(F.col("below") == "drawing", F.col("node")))).alias("drawings"),
        first("rPr/rStyle", _attr("val")).alias("style"),
        F.struct(*(first(f"rPr/{tag}", on(_attr("val"))).alias(name) for name, tag in (("bold", "b"), ("italic", "i"), ("strike", "strike")))).alias("said"),
        F.coalesce(F.max((F.col("below") == "fldChar") & (F.lower(_attr("fldCharType")) == "separate")), F.lit(False)).alias("parts"),
    ).filter((F.col("text") != "") | (F.size("breaks") > 0) | (F.size("drawings") > 0) | F.col("parts")).drop("parts")
    at = F.row_number().over(Window.partitionBy("doc_id", "part_key", "para").orderBy("run")) - 1
    return out.withColumn("run_idx", at)


def stored_runs(nodes: DataFrame) -> DataFrame:
    """``runs`` of stored nodes, stored beside them: for queries that read the runs more than once."""
    return stored(runs(nodes), keys=("doc_id", "part_key", "para", "run"), dealt=True)


def stored_paragraphs(nodes: DataFrame, run_rows: DataFrame) -> DataFrame:
    """``paragraphs`` of stored nodes, stored beside them."""
    return stored(paragraphs(nodes, run_rows), keys=("doc_id", "part_key", "para"), dealt=True)


def paragraphs(nodes: DataFrame, run_rows: DataFrame) -> DataFrame:
    """Every paragraph with container, style, alignment, spacing, indents, numbering, borders and text.

    The text is the run texts in order without separators; breaks add nothing.
    """
    p = paragraph_nodes(nodes)
    props = nodes.filter(F.col("path").contains("p/pPr/") & F.col("path").rlike(r"(^|/)p/pPr/((numPr|pBdr)/)?[^/]+$"))
    below = F.regexp_extract("path", r"(?:^|/)p/pPr/(.*)$", 1)
    up = F.when(below.contains("/"), _up(3)).otherwise(_up(2))
    one = lambda path, value: F.min(F.when(F.col("below") == path, value))
    props = props.withColumn("below", below).groupBy("doc_id", "part_key", up.alias("para")).agg(
        one("pStyle", _attr("val")).alias("style_id"),
        one("jc", _attr("val")).alias("alignment"),
        one("spacing", strict_int(_attr("before"))).alias("spacing_before"),
        one("spacing", strict_int(_attr("after"))).alias("spacing_after"),
        one("spacing", strict_int(_attr("line"))).alias("line_value"),
        one("spacing", _attr("lineRule")).alias("line_rule"),
        one("ind", strict_int(_attr("left"))).alias("indent_left"),
        one("ind", strict_int(_attr("right"))).alias("indent_right"),
        one("ind", strict_int(_attr("firstLine"))).alias("first_line"),
        one("ind", strict_int(_attr("hanging"))).alias("hanging"),
        one("numPr/numId", strict_int(_attr("val"))).alias("num_id"),
        one("numPr/ilvl", strict_int(_attr("val"))).alias("num_level"),
        *(one(f"pBdr/{side}", _border()).alias(f"border_{side}") for side in ooxml.BORDER_SIDES),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_idx", "text"))), lambda s: s["text"]), "")
    texts = run_rows.groupBy("doc_id", "part_key", "para").agg(text.alias("text"), F.count("*").alias("n_runs"))
    keys = ["doc_id", "part_key", "para"]
    out = p.join(merged(props), keys, "left").join(merged(texts), keys, "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_runs", F.coalesce("n_runs", F.lit(0)))
    at = F.row_number().over(Window.partitionBy("doc_id", "part_key", "container_id").orderBy("para")) - 1
    return out.withColumn("para_idx", at)


def relationships(nodes: DataFrame) -> DataFrame:
    """doc_id, rel_id, rel_type, target, target_mode of the main document."""
    r = nodes.filter("part_key = 'word/_rels/document.xml.rels' and path = 'Relationships/Relationship'")
    return r.select("doc_id", _attr("Id").alias("rel_id"), _attr("Type").alias("rel_type"), _attr("Target").alias("target"), F.coalesce(_attr("TargetMode"), F.lit("")).alias("target_mode"))


def part_relationships(nodes: DataFrame) -> DataFrame:
    """doc_id, source_key, rel_id, rel_type, target, target_mode, target_key of all lists of relationships, keyed by the part they belong to (empty: the package).

    target_key: the part that is meant, found from the folder of its source
    (from the root for a target that begins with a slash); null outside the
    package.
    """
    r = nodes.filter(F.col("part_key").endswith(".rels") & (F.col("path") == "Relationships/Relationship"))
    source = F.regexp_replace("part_key", r"(^|/)_rels/([^/]*)\.rels$", "$1$2")
    r = r.select("doc_id", source.alias("source_key"), _attr("Id").alias("rel_id"), _attr("Type").alias("rel_type"), _attr("Target").alias("target"), F.coalesce(_attr("TargetMode"), F.lit("")).alias("target_mode"))
    plain = F.replace(F.col("target"), F.lit("\\"), F.lit("/"))
    whole = F.when(plain.startswith("/"), plain).otherwise(F.concat(F.regexp_replace("source_key", "[^/]*$", ""), plain))
    up = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x.isin("", "."), done).otherwise(F.concat(done, F.array(x)))
    key = F.lower(F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), up), "/"))
    return r.withColumn("target_key", F.when(F.lower("target_mode") != "external", key))


def hyperlinks(nodes: DataFrame, run_rows: DataFrame) -> DataFrame:
    """doc_id, part_key, para, run, text, url: runs in hyperlinks, their target by the relationships of their own part, else #anchor."""
    links = nodes.filter(F.col("path").rlike(r"(^|/)p/hyperlink$")).select("doc_id", "part_key", F.col("node").alias("wrapper"), _attr("id").alias("rel_id"), _attr("anchor").alias("anchor"))
    rels = part_relationships(nodes).select("doc_id", F.col("source_key").alias("part_key"), "rel_id", "target")
    url = F.coalesce("target", F.concat(F.lit("#"), "anchor"))
    return run_rows.join(merged(links), ["doc_id", "part_key", "wrapper"]).join(merged(rels), ["doc_id", "part_key", "rel_id"], "left").select("doc_id", "part_key", "para", "run", "text", url.alias("url"))


def fields(nodes: DataFrame, run_rows: DataFrame) -> DataFrame:
    """doc_id, part_key, para, run, code, result, dirty: simple fields and complex ones, the latter at the run that separates code from result.

    The state machine begin, code .., separate, result .., end runs over the
    nodes of a paragraph in order, however they are dealt over its runs: the
    depth of a node is a running sum of begins and ends, and a node belongs to
    the last begin of its depth, so fields may nest.  A field that is never
    separated is none.
    """
    simple = nodes.filter(F.col("path").rlike(r"(^|/)p/fldSimple$")).select("doc_id", "part_key", F.col("node").alias("wrapper"), _attr("instr").alias("code"), F.coalesce(on(_attr("dirty")) & _attr("dirty").isNotNull(), F.lit(False)).alias("dirty"))
    simple = run_rows.join(merged(simple), ["doc_id", "part_key", "wrapper"]).select("doc_id", "part_key", "para", "run", F.trim("code").alias("code"), F.col("text").alias("result"), "dirty")
    x = nodes.filter(F.col("path").rlike(r"(^|/)p/(hyperlink/)?r/(fldChar|instrText|t|tab)$"))
    run, para = _up(1), F.when(F.col("path").rlike(r"/hyperlink/r/[^/]+$"), _up(3)).otherwise(_up(2))
    char = F.when(F.col("tag") == "fldChar", F.lower(_attr("fldCharType")))
    x = x.select("doc_id", "part_key", para.alias("para"), run.alias("run"), "node", "tag", "text", char.alias("char"), _attr("dirty").alias("said"))
    along = Window.partitionBy("doc_id", "part_key", "para").orderBy("node")
    opened = F.sum(F.when(F.col("char") == "begin", 1).when(F.col("char") == "end", -1).otherwise(0)).over(along)
    x = x.withColumn("depth", opened + F.when(F.col("char") == "end", 1).otherwise(0)).filter("depth > 0")
    level = Window.partitionBy("doc_id", "part_key", "para", "depth").orderBy("node")
    x = x.withColumn("turn", F.sum(F.when(F.col("char") == "begin", 1).otherwise(0)).over(level))
    x = x.withColumn("told", F.max(F.when(F.col("char") == "separate", 1).otherwise(0)).over(Window.partitionBy("doc_id", "part_key", "para", "depth", "turn").orderBy("node")))
    ordered = lambda test, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("node", value.alias("v"))))), lambda s: s["v"]), "")
    got = x.groupBy("doc_id", "part_key", "para", "depth", "turn").agg(
        F.min(F.when(F.col("char") == "separate", F.col("run"))).alias("run"),
        F.trim(ordered((F.col("tag") == "instrText") & (F.col("told") == 0), F.coalesce("text", F.lit("")))).alias("code"),
        ordered(F.col("tag").isin("t", "tab") & (F.col("told") == 1), F.when(F.col("tag") == "tab", "\t").otherwise(F.coalesce("text", F.lit("")))).alias("result"),
        F.coalesce(F.max(F.when((F.col("char") == "begin") & F.col("said").isNotNull(), on(F.col("said")))), F.lit(False)).alias("dirty"),
    )
    return simple.unionByName(got.filter("run is not null").drop("depth", "turn"))


def tables(nodes: DataFrame) -> DataFrame:
    """doc_id, table, block place, n_rows and n_cols (the most cells in a row) of the body's tables."""
    cells = nodes.filter(F.col("path") == f"{BODY}/tbl/tr/tc").groupBy("doc_id", _up(2).alias("table"), _up(1).alias("row")).agg(F.count("*").alias("n"))
    rows = nodes.filter(F.col("path") == f"{BODY}/tbl/tr").select("doc_id", _up(1).alias("table"), F.col("node").alias("row"))
    return rows.join(merged(cells), ["doc_id", "table", "row"], "left").groupBy("doc_id", "table").agg(F.count("*").alias("n_rows"), F.coalesce(F.max("n"), F.lit(0)).alias("n_cols"))


def table_properties(nodes: DataFrame) -> DataFrame:
    """doc_id, table, style_id, alignment, width_type, width of the body's tables."""
    t = nodes.filter(F.col("path").rlike(rf"^{BODY}/tbl/tblPr/(tblStyle|jc|tblW)$"))
    one = lambda tag, value: F.min(F.when(F.col("tag") == tag, value))
    return t.groupBy("doc_id", _up(2).alias("table")).agg(one("tblStyle", _attr("val")).alias("style_id"), one("jc", _attr("val")).alias("alignment"), one("tblW", _attr("type")).alias("width_type"), one("tblW", strict_int(_attr("w"))).alias("width"))


def row_heights(nodes: DataFrame) -> DataFrame:
    """doc_id, row, height of the body's table rows that have one."""
    return nodes.filter(F.col("path") == f"{BODY}/tbl/tr/trPr/trHeight").select("doc_id", _up(2).alias("row"), strict_int(_attr("val")).alias("height"))


def table_cells(nodes: DataFrame, paragraph_rows: DataFrame) -> DataFrame:
    """doc_id, table, row_idx, col_idx, span, vertical merge, borders and text of every cell of the body's tables, nested ones by their parent cell."""
    c = nodes.filter(F.col("path").rlike(r"(^|/)tbl/tr/tc$")).select("doc_id", "part_key", F.col("node").alias("cell"), _up(2).alias("table"), _up(1).alias("row"), F.when(F.col("path").rlike(r"/tc/tbl/tr/tc$"), _up(3)).alias("parent_cell"))
    c = c.withColumn("row_idx", F.dense_rank().over(Window.partitionBy("doc_id", "part_key", "table").orderBy("row")) - 1)
    c = c.withColumn("col_idx", F.row_number().over(Window.partitionBy("doc_id", "part_key", "row").orderBy("cell")) - 1)
    sides = "|".join(ooxml.BORDER_SIDES)
    props = nodes.filter(F.col("path").rlike(rf"(^|/)tc/tcPr/(gridSpan|vMerge|tcW|vAlign|shd|tcBorders/({sides}))$"))
    props = props.groupBy("doc_id", "part_key", F.when(F.col("tag").isin(*ooxml.BORDER_SIDES), _up(3)).otherwise(_up(2)).alias("cell")).agg(
        *(F.min(F.when(F.col("tag") == side, _border())).alias(f"border_{side}") for side in ooxml.BORDER_SIDES),
        F.min(F.when(F.col("tag") == "tcW", strict_int(_attr("w")))).alias("width"),
        F.min(F.when(F.col("tag") == "vAlign", F.lower(_attr("val")))).alias("v_align"),
        F.min(F.when(F.col("tag") == "shd", F.upper(_attr("fill")))).alias("shading"),
        F.min(F.when(F.col("tag") == "gridSpan", strict_int(_attr("val")))).alias("grid_span"),
        F.min(F.when(F.col("tag") == "vMerge", F.coalesce(_attr("val"), F.lit("continue")))).alias("v_merge"),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "text"))), lambda s: s["text"]), "\n")
    texts = paragraph_rows.filter("container = 'cell'").groupBy("doc_id", "part_key", F.col("container_id").alias("cell")).agg(text.alias("text"))
    out = c.join(merged(props), ["doc_id", "part_key", "cell"], "left").join(merged(texts), ["doc_id", "part_key", "cell"], "left")
    return out.withColumn("grid_span", F.coalesce("grid_span", F.lit(1))).withColumn("v_merge", F.coalesce("v_merge", F.lit("none")))


def sections(nodes: DataFrame) -> DataFrame:
    """doc_id, section_idx, page size, margins, orientation, columns and break type in document order."""
    heads = nodes.filter(F.col("path").isin(f"{BODY}/p/pPr/sectPr", f"{BODY}/sectPr")).select("doc_id", F.col("node").alias("section"))
    inner = nodes.filter(F.col("path").rlike(rf"^{BODY}/(p/pPr/)?sectPr/(pgSz|pgMar|cols|type)$")).withColumn("section", _up(1))
    one = lambda tag, name: F.min(F.when(F.col("tag") == tag, strict_int(_attr(name))))
    got = inner.groupBy("doc_id", "section").agg(
        one("pgSz", "w").alias("width"), one("pgSz", "h").alias("height"), F.min(F.when(F.col("tag") == "pgSz", _attr("orient"))).alias("orientation"),
        *(one("pgMar", m).alias(f"margin_{m}") for m in ("top", "right", "bottom", "left", "header", "footer")),
        one("cols", "num").alias("columns"), F.min(F.when(F.col("tag") == "type", _attr("val"))).alias("break_type"),
    )
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("section")) - 1
    own = heads.withColumn("section_idx", at).join(merged(got), ["doc_id", "section"], "left").withColumn("columns", F.coalesce("columns", F.lit(1))).withColumn("orientation", F.coalesce("orientation", F.lit("portrait")))
    # a document without any section has the default one
    bare = nodes.filter("path = 'document'").select("doc_id").join(merged(heads.select("doc_id").distinct()), "doc_id", "left_anti")
    width, height = ooxml.PAGE_SIZES["A4"]
    default = {"section_idx": 0, "width": width, "height": height, "orientation": "portrait", "columns": 1} | {f"margin_{m}": v for m, v in ooxml.MARGINS.items()}
    return own.unionByName(bare.select("doc_id", *(F.lit(v).alias(c) for c, v in default.items())), allowMissingColumns=True)


def background(nodes: DataFrame) -> DataFrame:
    """doc_id, color (RRGGBB) of documents with a background."""
    return nodes.filter("path = 'document/background'").select("doc_id", F.upper(_attr("color")).alias("color")).filter(F.col("color").rlike("^[0-9A-F]{6}$"))


def bookmarks(nodes: DataFrame) -> DataFrame:
    """doc_id, part_key, para, bookmark_id, bookmark_name of the bookmarks that begin in a paragraph."""
    return nodes.filter(F.col("path").rlike(r"(^|/)p/bookmarkStart$")).select("doc_id", "part_key", _up(1).alias("para"), _attr("id").alias("bookmark_id"), _attr("name").alias("bookmark_name"))


def paragraph_styles(paragraph_rows: DataFrame, styles: DataFrame) -> DataFrame:
    """Paragraphs with the name and formatting of their style (Normal without one); an unknown style leaves nulls."""
    s = styles.filter("type = 'paragraph'").select(F.col("style_id").alias("_style"), F.struct(*(c for c in styles.columns if c != "style_id")).alias("style"))
    return paragraph_rows.join(s, F.coalesce("style_id", F.lit("Normal")) == F.col("_style"), "left").drop("_style")


#: Formatting of a style: column, path below the style, attribute, and how it is read.
_STYLE = (
    ("font", "rPr/rFonts", "ascii", None), ("size", "rPr/sz", "val", "int"), ("bold", "rPr/b", "val", "on"), ("italic", "rPr/i", "val", "on"), ("strike", "rPr/strike", "val", "on"),
    ("underline", "rPr/u", "val", "lower"), ("color", "rPr/color", "val", None), ("highlight", "rPr/highlight", "val", "lower"),
    ("alignment", "pPr/jc", "val", None), ("spacing_before", "pPr/spacing", "before", "int"), ("spacing_after", "pPr/spacing", "after", "int"), ("line_value", "pPr/spacing", "line", "int"),
    ("indent_left", "pPr/ind", "left", "int"), ("indent_right", "pPr/ind", "right", "int"), ("first_line", "pPr/ind", "firstLine", "int"), ("hanging", "pPr/ind", "hanging", "int"),
    ("outline_level", "pPr/outlineLvl", "val", "int"), ("keep_next", "pPr/keepNext", "val", "on"), ("keep_lines", "pPr/keepLines", "val", "on"), ("page_break_before", "pPr/pageBreakBefore", "val", "on"),
)
STYLE_FORMATS = tuple(x[0] for x in _STYLE)


def _formats(below: Column) -> list[Column]:
    reads = {None: lambda c: c, "int": strict_int, "on": on, "lower": F.lower}
    return [F.min(F.when(below == path, reads[how](_attr(name)))).alias(column) for column, path, name, how in _STYLE]


def styles(nodes: DataFrame) -> DataFrame:
    """doc_id, style, style_id, type, name, based_on, next, link, is_default, is_custom and STYLE_FORMATS of the styles of every document, as they stand: what a style is silent about is null."""
    n = nodes.filter("part_key = 'word/styles.xml'")
    heads = n.filter("path = 'styles/style'").select("doc_id", F.col("node").alias("style"), _attr("styleId").alias("style_id"), F.coalesce(_attr("type"), F.lit("paragraph")).alias("type"), on(F.coalesce(_attr("default"), F.lit("0"))).alias("is_default"), on(F.coalesce(_attr("customStyle"), F.lit("0"))).alias("is_custom"))
    below = F.expr("substring(path, length('styles/style/') + 1)")
    inner = n.filter(F.col("path").startswith("styles/style/")).withColumn("below", below).groupBy("doc_id", F.get("ancestors", F.lit(1)).alias("style"))
    said = inner.agg(*(F.min(F.when(F.col("below") == tag, _attr("val"))).alias(c) for c, tag in (("name", "name"), ("based_on", "basedOn"), ("next", "next"), ("link", "link"))), *_formats(F.col("below")))
    return heads.join(merged(said), ["doc_id", "style"], "left")


def style_defaults(nodes: DataFrame) -> DataFrame:
    """doc_id and STYLE_FORMATS: what a document's sheet sets for all of its text."""
    n = nodes.filter("part_key = 'word/styles.xml'").withColumn("below", F.regexp_extract("path", "^styles/docDefaults/(?:rPrDefault|pPrDefault)/(.*)$", 1))
    return n.filter("below != ''").groupBy("doc_id").agg(*_formats(F.col("below")))


def effective_formatting(run_rows: DataFrame, paragraph_rows: DataFrame, resolved: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """Runs with the formatting they are shown with, in columns ``shown`` (a struct of STYLE_FORMATS), and paragraph_style and run_style as they took effect.

    What a run says itself comes first, then its character style, its
    paragraph's own settings and style (the document's default one where it
    names none or an unknown one), then the document's defaults.  ``resolved``: of
    ``operators.styles.resolved``.
    """
    keys = ["doc_id", "part_key", "para"]
    look = F.struct(*STYLE_FORMATS)
    of = lambda kind: resolved.filter(F.col("type") == kind)
    named = of("paragraph").select("doc_id", F.col("style_id").alias("_para_id"), look.alias("_para"))
    usual = of("paragraph").filter("is_default").groupBy("doc_id").agg(F.min(F.struct("style", F.col("style_id").alias("id"), look.alias("look"))).alias("_usual"))
    character = of("character").select("doc_id", F.col("style_id").alias("_char_id"), look.alias("_char"))
    own = [c for c in STYLE_FORMATS if c in paragraph_rows.columns]
    p = paragraph_rows.select(*keys, F.col("style_id").alias("_para_id"), F.struct(*own).alias("_own"))
    x = run_rows.join(merged(p), keys).withColumn("_char_id", F.col("style")).join(merged(named), ["doc_id", "_para_id"], "left").join(merged(character), ["doc_id", "_char_id"], "left").join(merged(usual), "doc_id", "left")
    if defaults is not None:
        x = x.join(merged(defaults.select("doc_id", look.alias("_all"))), "doc_id", "left")
    direct = {"bold": F.col("said.bold"), "italic": F.col("said.italic"), "strike": F.col("said.strike")} | {c: F.col(c) for c in ("font", "size", "underline", "color", "highlight")}

    def shown(c: str) -> Column:
        steps = [direct[c], F.col("_char")[c]] if c in direct else [F.col("_own")[c]] if c in own else []
        steps += [F.col("_para")[c], F.when(F.col("_para").isNull(), F.col("_usual.look")[c])] + ([F.col("_all")[c]] if defaults is not None else [])
        return F.coalesce(*steps).alias(c)

    took = F.when(F.col("_para").isNotNull(), F.col("_para_id")).otherwise(F.col("_usual.id"))
    return x.select(*run_rows.columns, took.alias("paragraph_style"), F.when(F.col("_char").isNotNull(), F.col("_char_id")).alias("run_style"), F.struct(*map(shown, STYLE_FORMATS)).alias("shown"))


def content_types(nodes: DataFrame, part_rows: DataFrame) -> DataFrame:
    """doc_id, part_key, content_type: the override of the part, else the default of its ending, else empty."""
    ct = nodes.filter("part_key = '[content_types].xml'")
    over = ct.filter("tag = 'Override'").select("doc_id", F.lower(F.ltrim(_attr("PartName"), F.lit("/"))).alias("part_key"), _attr("ContentType").alias("o")).dropDuplicates(["doc_id", "part_key"])
    base = ct.filter("tag = 'Default'").select("doc_id", F.lower(_attr("Extension")).alias("ending"), _attr("ContentType").alias("d")).dropDuplicates(["doc_id", "ending"])
    p = part_rows.filter("part_key is not null").select("doc_id", "part_key", F.regexp_extract("part_key", r"\.([^./]*)$", 1).alias("ending"))
    return p.join(merged(over), ["doc_id", "part_key"], "left").join(merged(base), ["doc_id", "ending"], "left").select("doc_id", "part_key", F.coalesce("o", "d", F.lit("")).alias("content_type"))


def typed_parts(rows: DataFrame) -> DataFrame:
    """Parts that carry their package's rules (``sources.docx.typed_parts``) with content_type: the override, else the default of the ending, else empty."""
    kind = F.coalesce(F.col("overrides")[F.col("part_key")], F.col("defaults")[F.regexp_extract("part_key", r"\.([^./]*)$", 1)], F.lit(""))
    return rows.filter("part_key is not null and error_code is null").withColumn("content_type", kind).drop("defaults", "overrides")


def images(nodes: DataFrame, media_dims: DataFrame) -> DataFrame:
    """Drawings with their relationship, target part, pixel size, EMU extent and description; a missing target leaves nulls."""
    inside = nodes.filter(F.col("path").rlike(r"r/drawing/")).withColumn("drawing", F.get("ancestors", F.size(F.split(F.regexp_extract("path", r"^(.*?r/drawing)/", 1), "/")) - 1))
    got = inside.groupBy("doc_id", "part_key", "drawing").agg(
        F.min(F.when(F.col("tag") == "blip", _attr("embed"))).alias("rel_id"),
        F.min(F.when(F.col("tag") == "extent", strict_int(_attr("cx")))).alias("cx"), F.min(F.when(F.col("tag") == "extent", strict_int(_attr("cy")))).alias("cy"),
        F.min(F.when(F.col("tag") == "docPr", _attr("descr"))).alias("description"), F.min(F.when(F.col("tag") == "docPr", strict_int(_attr("id")))).alias("number"),
        F.when(F.max(F.when(F.col("tag") == "anchor", 1)) == 1, "floating").otherwise("inline").alias("position"),
        F.coalesce(F.max(F.when(F.col("tag") == "anchor", _attr("behindDoc") == "1")), F.lit(False)).alias("behind_text"),
        F.min(F.when(F.col("tag") == "anchor", strict_int(_attr("relativeHeight")))).alias("z_order"),
        F.min(F.when(F.col("tag").startswith("wrap") & (F.col("tag") != "wrapPolygon"), F.lower(F.substring("tag", 5, 20)))).alias("wrap"),
        *(F.min(F.when(F.col("path").endswith(f"position{d}/align"), F.lower("text"))).alias(f"{d.lower()}_align") for d in "HV"),
        *(F.min(F.when(F.col("path").endswith(f"position{d}/posOffset"), strict_int(F.col("text")))).alias(f"offset_{a}") for d, a in (("H", "x"), ("V", "y"))),
    )
    rels = part_relationships(nodes).select("doc_id", F.col("source_key").alias("part_key"), "rel_id", "target", F.col("target_key").alias("media_key"))
    dims = media_dims.select("doc_id", F.col("part_key").alias("media_key"), "width_px", "height_px")
    return got.join(merged(rels), ["doc_id", "part_key", "rel_id"], "left").join(merged(dims), ["doc_id", "media_key"], "left")


def wrap_type(images: DataFrame) -> DataFrame:
    """Images with wrap_type, the meaning of how text runs around them: without wrapping, a floating one lies behind the text or in front of it."""
    plain = enums.meaning("wrap", F.col("wrap"))
    kind = F.when(F.col("position") == "inline", "none").when((plain == "none") & F.col("behind_text"), "behindText").when(plain == "none", "inFrontText").otherwise(plain)
    return images.withColumn("wrap_type", kind)


def section_parts(nodes: DataFrame) -> DataFrame:
    """doc_id, section, kind (header or footer), type and part_key: the references of every section, resolved; the first of a type wins."""
    refs = nodes.filter(F.col("path").rlike(rf"^{BODY}/(p/pPr/)?sectPr/(header|footer)Reference$"))
    refs = refs.select("doc_id", "node", _up(1).alias("section"), F.replace("tag", F.lit("Reference"), F.lit("")).alias("kind"), F.coalesce(F.when(_attr("type").isin("first", "even"), _attr("type")), F.lit("default")).alias("type"), _attr("id").alias("rel_id"))
    at = F.row_number().over(Window.partitionBy("doc_id", "section", "kind", "type").orderBy("node"))
    refs = refs.withColumn("r", at).filter("r = 1").drop("r", "node")
    rels = part_relationships(nodes).filter("source_key = 'word/document.xml'").select("doc_id", "rel_id", F.col("target_key").alias("part_key"))
    return refs.join(merged(rels), ["doc_id", "rel_id"], "left")


def app_properties(nodes: DataFrame) -> DataFrame:
    """doc_id, application, n_paragraphs, n_tables of the extended properties."""
    p = nodes.filter("part_key = 'docprops/app.xml'")
    one = lambda tag: F.min(F.when(F.col("tag") == tag, F.col("text")))
    return p.groupBy("doc_id").agg(one("Application").alias("application"), strict_int(one("Paragraphs")).alias("n_paragraphs"), strict_int(one("Tables")).alias("n_tables"))


def core_properties(nodes: DataFrame) -> DataFrame:
    """doc_id, title, subject, creator, keywords (array), description, created, modified; times stay text."""
    p = nodes.filter("part_key = 'docprops/core.xml'")
    one = lambda tag: F.min(F.when(F.col("tag") == tag, F.col("text")))
    return p.groupBy("doc_id").agg(*(one(t).alias(t) for t in ("title", "subject", "creator", "description", "created", "modified")), F.split(one("keywords"), r",\s*").alias("keywords"))
