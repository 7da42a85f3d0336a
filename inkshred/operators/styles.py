"""Style catalogue, themes and fields: small constant tables and their joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ooxml import FIELD_CODES, FIELD_RESULTS

# The built-in styles.  Paragraph styles as (id, name, based_on, size, bold, italic, alignment, before, after, outline level).
_P = [
    ("Normal", "Normal", None, None, False, False, "left", None, None, None),
    *((f"Heading{i}", f"Heading {i}", "Normal", (32, 26, 24, 24, 22, 22, 22, 22, 22)[i - 1], i < 6, False, None, 240, 120, i - 1) for i in range(1, 10)),
    ("Title", "Title", "Normal", 52, True, False, "center", None, 180, None),
    ("Subtitle", "Subtitle", "Normal", 28, False, True, "center", None, None, None),
    ("Quote", "Quote", "Normal", None, False, True, None, None, None, None),
    ("IntenseQuote", "Intense Quote", "Normal", 28, True, True, "center", 120, 120, None),
    ("ListParagraph", "List Paragraph", "Normal", None, False, False, None, None, 80, None),
    ("Caption", "caption", "Normal", None, False, True, None, None, 200, None),
    *((f"TOC{i}", f"TOC {i}", "Normal", None, False, False, None, None, None, i - 1) for i in range(1, 10)),
    ("Header", "Header", "Normal", 20, False, False, None, None, None, None),
    ("Footer", "Footer", "Normal", 20, False, False, None, None, None, None),
    ("BodyText", "Body Text", "Normal", None, False, False, None, None, None, None),
    ("NoSpacing", "No Spacing", "Normal", None, False, False, None, 0, 0, None),
]
_C = [("DefaultParagraphFont", "Default Paragraph Font"), ("HeaderChar", "Header Char"), ("Emphasis", "Emphasis"), ("Strong", "Strong"), ("Hyperlink", "Hyperlink"), ("FollowedHyperlink", "Followed Hyperlink")]
_T = [
    ("TableNormal", "Table Normal"), ("TableGrid", "Table Grid"), ("PlainTable1", "Plain Table 1"), ("MediumShading1", "Medium Shading 1"), ("LightShading", "Light Shading"),
    ("ColorfulList", "Colorful List"), ("MediumShading1Accent1", "Medium Shading 1 Accent 1"), ("MediumShading1Accent2", "Medium Shading 1 Accent 2"),
]
#: Both indents of a quotation, half an inch in twips.
QUOTE_INDENT = 720
#: Reserved ids without an object: built in, but not in the catalogue and not to be added.
RESERVED = ("FootnoteText", "EndnoteText", "BodyTextIndent", "Subtle", "IntenseEmphasis", "IntenseReference", "BookTitle")

# The presets' colours (primary, secondary, accent, background, text, light text, heading), fonts and sizes.
THEMES = {
    "corporate": ("2F5496", "4F81BD", "C00000", "FFFFFF", "000000", "595959", "2F5496", "Calibri", "Calibri", 22, 0, 160, 240, 240, 120, 480, 32, 26, 24, True, True, True, True),
    "startup": ("6A5ACD", "48D1CC", "FF6347", "FFFFFF", "212121", "757575", "6A5ACD", "Calibri", "Calibri Light", 22, 0, 200, 280, 320, 160, 560, 36, 28, 24, True, True, False, True),
    "modern": ("34495E", "95A5A6", "2980B9", "FFFFFF", "2C3E50", "7F8C8D", "34495E", "Segoe UI", "Segoe UI Light", 22, 0, 240, 300, 400, 200, 640, 34, 28, 24, False, False, True, True),
    "fintech": ("005288", "007BA7", "009688", "FFFFFF", "212121", "616161", "005288", "Arial", "Arial", 22, 0, 140, 240, 280, 140, 400, 30, 26, 22, True, True, True, True),
    "academic": ("000000", "404040", "800000", "FFFFFF", "000000", "606060", "000000", "Times New Roman", "Times New Roman", 24, 0, 0, 480, 240, 120, 480, 28, 26, 24, True, True, True, False),
    "tech-presentation": ("007ACC", "505050", "ED64A6", "FFFFFF", "212121", "6C757D", "007ACC", "Roboto", "Roboto", 22, 0, 160, 260, 320, 160, 480, 32, 26, 24, True, True, True, True),
    "tech-darkmode": ("4FC0FF", "CE9178", "FF79C6", "1E1E1E", "D4D4D4", "969696", "4FC0FF", "Roboto", "Roboto", 22, 0, 160, 260, 320, 160, 480, 32, 26, 24, True, True, True, True),
}
_THEME_COLUMNS = (
    "theme string, primary string, secondary string, accent string, background string, text_color string, text_light string, heading_color string, body_font string, heading_font string, body_size int, "
    "para_before int, para_after int, line int, heading_before int, heading_after int, section_space int, h1 int, h2 int, h3 int, h1_bold boolean, h2_bold boolean, h3_bold boolean, use_color boolean, "
    "muted string, success string, warning string, error string, monospace string, small_size int"
)

# What the presets name and applying them does not use: muted, success, warning, error colour, monospace font, size of small text.
PALETTES = {
    "corporate": ("D9D9D9", "00B050", "FFC000", "C00000", "Courier New", 18),
    "startup": ("E5E5E5", "2ECC71", "F1C40F", "E74C3C", "Consolas", 18),
    "modern": ("ECF0F1", "27AE60", "F39C12", "C0392B", "Consolas", 18),
    "fintech": ("E0E0E0", "4CAF50", "FF9800", "D32F2F", "Courier New", 18),
    "academic": ("C0C0C0", "008000", "FFA500", "8B0000", "Courier New", 20),
    "tech-presentation": ("EEEEEE", "28A745", "FFC107", "DC3545", "Fira Code", 18),
    "tech-darkmode": ("2D2D2D", "49CC90", "FFCB6B", "FF5555", "Fira Code", 18),
}


def _constant(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of fixed values; as an Arrow table they start no Python workers, which rows of Python objects would, a task each."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [pa.field(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in schema.split(", ")]
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], pa.schema(fields)))


def catalogue(spark: SparkSession) -> DataFrame:
    """style_id, name, type, based_on, is_default and formatting of the built-in styles."""
    rows = [(*p[:2], "paragraph", p[2], p[0] == "Normal", *p[3:]) for p in _P]
    rows += [(i, n, "character", None if k == 0 else "DefaultParagraphFont", k == 0, None, i == "Strong", i == "Emphasis", None, None, None, None) for k, (i, n) in enumerate(_C)]
    rows += [(i, n, "table", None if k == 0 else "TableNormal", k == 0, None, False, False, None, None, None, None) for k, (i, n) in enumerate(_T)]
    return _constant(spark, rows, "style_id string, name string, type string, based_on string, is_default boolean, size int, bold boolean, italic boolean, alignment string, spacing_before int, spacing_after int, outline_level int")


def with_styles(base: DataFrame, added: DataFrame) -> DataFrame:
    """The catalogue with custom styles that have a fresh, non-empty id that is not reserved."""
    fresh = added.filter((F.length("style_id") > 0) & ~F.col("style_id").isin(*RESERVED)).join(base.select("style_id"), "style_id", "left_anti").dropDuplicates(["style_id"])
    return base.unionByName(fresh, allowMissingColumns=True)


def without_styles(styles: DataFrame, removed: DataFrame, built_in: DataFrame) -> DataFrame:
    """Styles without the custom ones named; built-in ones stay."""
    gone = removed.select("style_id").join(built_in.select("style_id"), "style_id", "left_anti")
    return styles.join(gone, "style_id", "left_anti")


def with_default(styles: DataFrame, style_id: str) -> DataFrame:
    """Styles with the named one as the default of its type; an unknown one changes nothing."""
    kind = styles.filter(F.col("style_id") == style_id).select(F.col("type").alias("_type")).dropDuplicates()
    x = styles.join(kind, F.col("type") == F.col("_type"), "left")
    return x.withColumn("is_default", F.when(F.col("_type").isNotNull(), F.col("style_id") == style_id).otherwise(F.col("is_default"))).drop("_type")


def paragraph_style(style_id: str, name: str, based_on: str | None = "Normal", **values) -> dict:
    """A custom paragraph style's row: formatting by the column names of ``catalogue`` (size in half points, spacing in twips)."""
    return {"style_id": style_id, "name": name, "type": "paragraph", "based_on": based_on, "is_default": False, "is_custom": True} | values


def themes(spark: SparkSession) -> DataFrame:
    """The presets, a row each; a variant is a row with other values (``withColumn``)."""
    return _constant(spark, [(k, *v, *PALETTES[k]) for k, v in THEMES.items()], _THEME_COLUMNS)


def apply_palette(runs: DataFrame, theme: DataFrame, role: str = "role") -> DataFrame:
    """Runs (theme, a role, formatting) coloured by their role in a theme.

    The roles are primary, secondary, accent, text, text_light, heading,
    muted, success, warning, error; ``code`` takes the monospace font and
    ``small`` the small size.  Other roles and themes leave a run as it is.
    """
    colors = {"primary": "primary", "secondary": "secondary", "accent": "accent", "text": "text_color", "text_light": "text_light", "heading": "heading_color"} | {c: c for c in ("muted", "success", "warning", "error")}
    said = F.create_map(*(x for r, c in colors.items() for x in (F.lit(r), F.col(c))))
    named = theme.select("theme", said.alias("_colors"), F.col("monospace").alias("_code"), F.col("small_size").alias("_small"))
    old = lambda c: F.col(c) if c in runs.columns else F.lit(None)
    out = runs.join(named, "theme", "left")
    out = out.withColumns({"color": F.coalesce(F.col("_colors")[F.col(role)], old("color")), "font": F.coalesce(F.when(F.col(role) == "code", F.col("_code")), old("font")), "size": F.coalesce(F.when(F.col(role) == "small", F.col("_small")), old("size"))})
    return out.drop("_colors", "_code", "_small")


def apply_theme(styles: DataFrame, theme: DataFrame) -> DataFrame:
    """Styles as a theme sets them (theme: rows of ``themes``; one result per theme and style).

    Touches Normal (with its line spacing), Heading1 to 3, Title, Subtitle,
    Quote (with its indents), IntenseQuote and ListParagraph; whatever a theme
    does not set stays as it is.
    """
    x = styles.crossJoin(theme)  # a style sheet is one row for each pair
    is_ = lambda *ids: F.col("style_id").isin(*ids)
    heading = is_("Heading1", "Heading2", "Heading3")
    use = F.col("use_color")
    pick = lambda old, *cases: F.coalesce(*(F.when(test, value) for test, value in cases), old)
    font = pick(F.lit(None).cast("string"), (heading | is_("Title"), F.col("heading_font")), (is_("Normal", "Subtitle", "Quote", "IntenseQuote", "ListParagraph"), F.col("body_font")))
    size = pick(F.col("size"), (is_("Heading1"), F.col("h1")), (is_("Heading2"), F.col("h2")), (is_("Heading3"), F.col("h3")), (is_("Title"), F.col("h1") + 8), (is_("Subtitle"), F.col("body_size") + 4), (is_("IntenseQuote"), F.col("body_size") + 2), (is_("Normal", "ListParagraph"), F.col("body_size")))
    bold = pick(F.col("bold"), (is_("Heading1"), F.col("h1_bold")), (is_("Heading2"), F.col("h2_bold")), (is_("Heading3"), F.col("h3_bold")), (is_("Title", "IntenseQuote"), F.lit(True)))
    color = pick(F.lit(None).cast("string"), (heading & use, F.col("heading_color")), (is_("Title") & use, F.col("primary")), (is_("Subtitle", "Quote"), F.col("text_light")), (is_("IntenseQuote"), F.col("secondary")), (is_("Normal", "ListParagraph"), F.col("text_color")))
    after = pick(F.col("spacing_after"), (heading, F.col("heading_after")), (is_("Title"), F.col("heading_after") * 2), (is_("Subtitle"), F.col("section_space")), (is_("Normal"), F.col("para_after")), (is_("ListParagraph"), F.floor(F.col("para_after") / 2).cast("int")))
    before = pick(F.col("spacing_before"), (heading, F.col("heading_before")), (is_("Normal"), F.col("para_before")))
    alignment = pick(F.col("alignment"), (heading, F.lit("left")), (is_("Title", "Subtitle", "IntenseQuote"), F.lit("center")))
    italic = pick(F.col("italic"), (is_("Quote"), F.lit(True)))
    line = F.when(is_("Normal"), F.col("line"))
    quoted = F.when(is_("Quote"), F.lit(QUOTE_INDENT))
    about = [c for c in ("name", "type", "based_on", "is_default", "is_custom", "outline_level") if c in styles.columns]
    return x.select("theme", "style_id", *about, font.alias("font"), size.alias("size"), bold.alias("bold"), italic.alias("italic"), color.alias("color"), alignment.alias("alignment"), before.alias("spacing_before"), after.alias("spacing_after"), line.alias("line_value"), quoted.alias("indent_left"), quoted.alias("indent_right"))


def theme_backgrounds(documents: DataFrame, theme: DataFrame) -> DataFrame:
    """(doc_id, color): the backgrounds of documents (doc_id, theme) as their themes set them; an unknown theme sets none."""
    return documents.join(theme.select("theme", F.col("background").alias("color")), "theme").select("doc_id", "color")


def resolved(styles: DataFrame, formats: tuple[str, ...], key: str = "doc_id", order: str = "style") -> DataFrame:
    """Styles with the formatting they inherit: what one is silent about comes from the nearest style it is based on that is not.

    styles: (key, order, style_id, based_on, formats and whatever else); of
    equal ids in a sheet the first by ``order`` counts, the others are left
    out.  Adds hops, the length of the chain, and ``violations``: ``unknown
    base`` where based_on names no style (the chain ends there), ``cycle``
    where the chain never ends; such a style keeps its own formatting and has
    no hops.

    A sheet is one group of some hundred rows.  In it the chains are followed
    by pointer doubling: every round takes over the formatting of the style
    pointed at and then points where that one does, so that a chain of h
    styles takes log2(h) rounds, and a pointer left after all of them is on a
    cycle.
    """
    others = [c for c in styles.columns if c not in (key, *formats)]
    first = styles.withColumn("_r", F.row_number().over(Window.partitionBy(key, "style_id").orderBy(order))).filter("_r = 1").drop("_r")
    sheet = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.struct(*others).alias("about"), F.struct(*formats).alias("look")))).alias("_s"))
    places = F.sequence(F.lit(0), F.size("_s") - 1)
    ids = F.transform("_s", lambda x: x["about"]["style_id"])
    # the ids are bound once a sheet; named as a column they would be gathered again for each of its styles
    base = F.transform(F.array(ids), lambda known: F.transform("_s", lambda x: F.nullif(F.array_position(known, x["about"]["based_on"]).cast("int"), F.lit(0)) - 1))
    x = sheet.withColumn("_base", F.get(base, F.lit(0)))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size("_s") + 1)).cast("int"))
    start = F.struct(F.col("_base").alias("to"), F.transform("_s", lambda x: x["look"]).alias("look"), F.transform("_base", lambda b: F.when(b.isNull(), 0).otherwise(1)).alias("hops"))

    def step(state: Column, _: Column) -> Column:
        def taken(i: Column) -> Column:
            own, other = F.get(state["look"], i), F.get(state["look"], F.get(state["to"], i))
            return F.struct(*(F.coalesce(own[c], other[c]).alias(c) for c in formats))

        return F.struct(
            F.transform(places, lambda i: F.get(state["to"], F.get(state["to"], i))).alias("to"), F.transform(places, taken).alias("look"),
            F.transform(places, lambda i: F.get(state["hops"], i) + F.coalesce(F.get(state["hops"], F.get(state["to"], i)), F.lit(0))).alias("hops"),
        )

    x = x.withColumn("_end", F.aggregate(rounds, start, step)).select(key, F.explode(F.arrays_zip("_s", "_base", F.col("_end.to").alias("to"), F.col("_end.look").alias("look"), F.col("_end.hops").alias("hops"))).alias("x"))
    loops = F.col("x.to").isNotNull()
    unknown = F.col("x._base").isNull() & F.col("x._s.about.based_on").isNotNull()
    bad = F.array_compact(F.array(F.when(loops, F.lit("cycle")), F.when(unknown, F.lit("unknown base"))))
    look = F.when(loops, F.col("x._s.look")).otherwise(F.col("x.look"))
    return x.select(key, *(F.col("x._s.about")[c].alias(c) for c in others), *(look[c].alias(c) for c in formats), F.when(~loops, F.col("x.hops")).alias("hops"), bad.alias("violations"))


def _mapped(values: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key], F.lit(other))


def field(kind: Column, target: Column | None = None, display: Column | None = None) -> Column:
    """struct(type, code, result, is_dirty, properties) of a new field: its default code, placeholder result, a clean state and what it was made with.

    A HYPERLINK takes the target's url and shows ``display``; STYLEREF, SEQ
    and REF name their target.
    """
    target = F.lit(None).cast("string") if target is None else target
    named = F.when(kind == "HYPERLINK", F.concat(F.lit('HYPERLINK "'), target, F.lit('"'))).when(kind == "STYLEREF", F.concat(F.lit('STYLEREF "'), target, F.lit('"'))).when(kind.isin("SEQ", "REF"), F.concat(kind, F.lit(" "), target))
    result = F.when(kind == "HYPERLINK", F.coalesce(display if display is not None else F.lit(None), target)).otherwise(_mapped(FIELD_RESULTS, kind, ""))
    said = F.when(kind == "HYPERLINK", F.create_map(F.lit("url"), target, F.lit("display"), F.coalesce(display if display is not None else F.lit(None), target))).when(kind == "STYLEREF", F.create_map(F.lit("style"), target))
    properties = F.coalesce(said, F.create_map().cast("map<string,string>"))
    return F.struct(kind.alias("type"), F.coalesce(named, field_code(kind)).alias("code"), result.alias("result"), F.lit(False).alias("is_dirty"), properties.alias("properties"))


def set_field_code(field: Column, code: Column) -> Column:
    """The field with another code, which makes it dirty; a blank code changes nothing (``edits.set_values`` can name it)."""
    return F.when(F.trim(F.coalesce(code, F.lit(""))) == "", field).otherwise(field.withField("code", code).withField("is_dirty", F.lit(True)))


def set_field_result(field: Column, result: Column) -> Column:
    """The field with a result of the caller's, which makes it clean."""
    return field.withField("result", result).withField("is_dirty", F.lit(False))


def set_field_property(field: Column, name: Column | str, value: Column) -> Column:
    """The field with a property set, which makes it dirty."""
    name = F.lit(name) if isinstance(name, str) else name
    others = F.map_filter(field["properties"], lambda k, _: k != name)
    return field.withField("properties", F.map_concat(others, F.create_map(name, value))).withField("is_dirty", F.lit(True))


def update_field(field: Column) -> Column:
    """The field brought up to date: a dirty one gets its type's placeholder, a hyperlink its display text; a clean one stays."""
    return field.withField("result", updated_result(field["type"], field["is_dirty"], field["result"], field["properties"]["display"])).withField("is_dirty", F.lit(False))


def field_code(kind: Column) -> Column:
    """The default instruction of a field type; empty for others."""
    return _mapped(FIELD_CODES, kind, "")


def toc_code(levels: Column | None = None, hide_numbers: Column | None = None, hide_leader: Column | None = None) -> Column:
    """A table of contents' instruction with its switches."""
    said = lambda c, x: F.when(F.coalesce(c, F.lit(False)), F.lit(x)).otherwise(F.lit("")) if c is not None else F.lit("")
    return F.concat(F.lit('TOC \\\\o "'), F.coalesce(levels, F.lit("1-3")) if levels is not None else F.lit("1-3"), F.lit('" \\\\h'), said(hide_numbers, " \\\\n"), said(hide_leader, " \\\\p"), F.lit(" \\\\z \\\\u"))


def updated_result(kind: Column, dirty: Column, old: Column, display: Column) -> Column:
    """A dirty field's placeholder result; a hyperlink shows its display text, a clean field keeps its result."""
    return F.when(~dirty, old).when(kind == "HYPERLINK", F.coalesce(display, old)).otherwise(_mapped(FIELD_RESULTS, kind, ""))
