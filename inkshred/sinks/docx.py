"""Sink: model rows -> XML -> package bytes -> files.

XML is put together by string expressions and ordered folds; only the archive
itself is written by a small kernel, one package per row.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ooxml import BORDER_SIDES, CONTENT_TYPES, CORE, EXTENDED, MARGINS, PACKAGE_RELS, PAGE_SIZES, WORD_TYPE, R, W
from ..sources.docx import MOST_BYTES, NODES, NODES_WITHOUT_PLACES, scanner
from ..sources.store import dealt, mapped, merged

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Parts every package has; relationship ids rId1 to rId5 of the main document belong to them.
BASE_RELS = (("rId1", "styles", "styles.xml"), ("rId2", "settings", "settings.xml"), ("rId3", "webSettings", "webSettings.xml"), ("rId4", "fontTable", "fontTable.xml"), ("rId5", "theme", "theme/theme1.xml"))
OVERRIDES = (
    ("/word/document.xml", WORD_TYPE + "document.main+xml"), ("/word/styles.xml", WORD_TYPE + "styles+xml"), ("/word/fontTable.xml", WORD_TYPE + "fontTable+xml"),
    ("/word/theme/theme1.xml", "application/vnd.openxmlformats-officedocument.theme+xml"), ("/word/settings.xml", WORD_TYPE + "settings+xml"), ("/word/webSettings.xml", WORD_TYPE + "webSettings+xml"),
    ("/docProps/core.xml", "application/vnd.openxmlformats-package.core-properties+xml"), ("/docProps/app.xml", "application/vnd.openxmlformats-officedocument.extended-properties+xml"),
)
_DOCUMENT = f'{HEAD}<w:document xmlns:w="{W}" xmlns:r="{R}">'
THEME = '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" name="Office"/>'


#: Nothing but characters XML can hold; one loop, where the search for others tries a pattern at every character.
_HOLDS = "\\A[\\x20-\\uFFFD\\t\\n\\r\\x{10000}-\\x{10FFFF}]*+\\z"


def escaped(text: Column | str) -> Column:
    """Text as XML character data; characters XML cannot hold become U+FFFD."""
    text = F.col(text) if isinstance(text, str) else text
    t = F.when(text.rlike(_HOLDS), text).otherwise(F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "�"))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def text_element(text: Column) -> Column:
    """A ``t`` element, with preserved space where the text begins or ends with one; nothing for an empty text."""
    space = F.when(text.startswith(" ") | text.endswith(" "), F.lit(' xml:space="preserve"')).otherwise(F.lit(""))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("<w:t"), space, F.lit(">"), escaped(text), F.lit("</w:t>")))


def run_properties(columns: list[str]) -> Column:
    """rPr of the formatting columns present; default values are left out."""
    have = lambda c: c in columns
    flag = lambda c, tag: F.when(F.col(c), F.lit(f"<w:{tag}/>")).otherwise(F.lit(""))
    value = lambda c, tag, test: F.when(test, F.concat(F.lit(f'<w:{tag} w:val="'), escaped(F.col(c).cast("string")), F.lit('"/>'))).otherwise(F.lit(""))
    inner = []
    if have("style"):
        inner.append(value("style", "rStyle", F.col("style").isNotNull()))
    fonts = [(c, a) for c, a in (("font", "ascii"), ("font", "hAnsi"), ("font_east_asia", "eastAsia"), ("font_cs", "cs")) if have(c)]
    if fonts:
        named = F.concat(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f' w:{a}="'), escaped(c), F.lit('"'))).otherwise(F.lit("")) for c, a in fonts))
        inner.append(F.when(named == "", F.lit("")).otherwise(F.concat(F.lit("<w:rFonts"), named, F.lit("/>"))))
    inner += [flag(c, tag) for c, tag in (("bold", "b"), ("italic", "i"), ("strike", "strike")) if have(c)]
    if have("color"):
        inner.append(value("color", "color", F.col("color").isNotNull()))
    if have("size"):
        inner += [value("size", tag, F.col("size").isNotNull() & (F.col("size") != 22)) for tag in ("sz", "szCs")]
    if have("highlight"):
        inner.append(value("highlight", "highlight", F.col("highlight").isNotNull() & (F.col("highlight") != "none")))
    if have("underline"):
        inner.append(value("underline", "u", F.col("underline").isNotNull() & (F.col("underline") != "none")))
    both = F.concat(*inner) if inner else F.lit("")
    return F.when(both == "", F.lit("")).otherwise(F.concat(F.lit("<w:rPr>"), both, F.lit("</w:rPr>")))


def field_xml(code: Column, result: Column, dirty: Column, props: Column) -> Column:
    """A complex field: begin, code, separate, result, end, each in a run of its own."""
    char = lambda kind, more="": f'<w:r><w:fldChar w:fldCharType="{kind}"{more}/></w:r>'
    begin = F.when(F.coalesce(dirty, F.lit(False)), F.lit(char("begin", ' w:dirty="true"'))).otherwise(F.lit(char("begin")))
    shown = F.when(F.coalesce(result, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("<w:r>"), props, text_element(result), F.lit("</w:r>")))
    return F.concat(begin, F.lit('<w:r><w:instrText xml:space="preserve">'), escaped(code), F.lit("</w:instrText></w:r>"), F.lit(char("separate")), shown, F.lit(char("end")))


def run_xml(columns: list[str]) -> Column:
    """One run; its text is split at line ends into runs with a break between.

    Where the columns are there: ``breaks`` (page, column, line) follow the
    text, ``drawing`` is XML inside the run, a ``field_code`` with its
    ``field_result`` and ``field_dirty`` goes before the text, and a
    ``rel_id`` or ``anchor`` makes the whole a hyperlink.
    """
    have = lambda c: c in columns
    props = run_properties(columns)
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    inside = F.col("drawing") if have("drawing") else F.lit("")
    if have("breaks"):
        one = lambda b: F.when(b.isin("page", "column"), F.concat(F.lit('<w:br w:type="'), b, F.lit('"/>'))).otherwise(F.lit("<w:br/>"))
        inside = F.concat(F.coalesce(F.array_join(F.transform("breaks", one), ""), F.lit("")), F.coalesce(inside, F.lit("")))
    last = F.size(lines) - 1
    each = F.transform(lines, lambda x, i: F.concat(F.when(i > 0, F.concat(F.lit("<w:r>"), props, F.lit("<w:br/></w:r>"))).otherwise(F.lit("")), F.lit("<w:r>"), props, text_element(x), F.when(i == last, F.coalesce(inside, F.lit(""))).otherwise(F.lit("")), F.lit("</w:r>")))
    out = F.array_join(each, "")
    if have("field_code"):
        optional = lambda c: F.col(c) if have(c) else F.lit(None)
        field = field_xml(F.col("field_code"), optional("field_result").cast("string"), optional("field_dirty").cast("boolean"), props)
        out = F.when(F.col("field_code").isNull(), out).otherwise(F.concat(field, F.when(F.coalesce("text", F.lit("")) == "", F.lit("")).otherwise(out)))
    for c, a in (("anchor", "w:anchor"), ("rel_id", "r:id")):
        if have(c):
            out = F.when(F.col(c).isNull(), out).otherwise(F.concat(F.lit(f'<w:hyperlink {a}="'), escaped(c), F.lit('">'), out, F.lit("</w:hyperlink>")))
    return out


def _folded(order: str, xml: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), xml.alias("x")))), lambda s: s["x"]), "")


def paragraph_xml(runs: DataFrame, paragraphs: DataFrame | None = None) -> DataFrame:
    """doc_id, block_idx, xml: paragraphs from runs (doc_id, block_idx, run_idx, text and formatting).

    ``paragraphs`` adds style_id, num_id and num_level, spacing_before,
    spacing_after, line_value and line_rule, indent_left, indent_right,
    first_line and hanging, alignment, outline_level, border_top, border_left,
    border_bottom and border_right, and bookmark_id with bookmark_name, where
    it has them; paragraphs without runs come from it too.
    """
    # dealt by document at once, so that the folds into paragraphs and documents share one shuffle
    inner = dealt(runs).groupBy("doc_id", "block_idx").agg(_folded("run_idx", run_xml(runs.columns)).alias("inner"))
    head, before, after = F.lit(""), F.lit(""), F.lit("")
    if paragraphs is not None:
        inner = paragraphs.join(merged(inner), ["doc_id", "block_idx"], "left")
        head = paragraph_properties(paragraphs.columns)
        if "bookmark_id" in paragraphs.columns:
            mark = lambda tag, more: F.when(F.col("bookmark_id").isNotNull(), F.concat(F.lit(f'<w:{tag} w:id="'), escaped(F.col("bookmark_id").cast("string")), F.lit('"'), more, F.lit("/>"))).otherwise(F.lit(""))
            before, after = mark("bookmarkStart", F.concat(F.lit(' w:name="'), escaped("bookmark_name"), F.lit('"'))), mark("bookmarkEnd", F.lit(""))
    return inner.select("doc_id", "block_idx", F.concat(F.lit("<w:p>"), head, before, F.coalesce("inner", F.lit("")), after, F.lit("</w:p>")).alias("xml"))


def documents_of_runs(runs: DataFrame) -> DataFrame:
    """``document_xml(paragraph_xml(runs))`` by one fold a document: for documents of nothing but paragraphs of runs."""
    each = F.sort_array(F.collect_list(F.struct(F.col("block_idx").alias("b"), F.col("run_idx").alias("r"), run_xml(runs.columns).alias("x"))))
    rows = dealt(runs).groupBy("doc_id").agg(each.alias("_runs"))
    other = lambda i, x: ~F.get("_runs", i)["b"].eqNullSafe(x["b"])
    opens = lambda x, i: F.when((i == 0) | other(i - 1, x), F.lit("<w:p>")).otherwise(F.lit(""))
    closes = lambda x, i: F.when((i == F.size("_runs") - 1) | other(i + 1, x), F.lit("</w:p>")).otherwise(F.lit(""))
    body = F.array_join(F.transform("_runs", lambda x, i: F.concat(opens(x, i), F.coalesce(x["x"], F.lit("")), closes(x, i))), "")
    return rows.select("doc_id", F.concat(F.lit(_DOCUMENT + "<w:body>"), body, F.lit(f"{section_xml()}</w:body></w:document>")).alias("document_xml"))


def _element(columns: list[str], tag: str, attributes: dict[str, str], skip: tuple = ()) -> Column:
    """An element with those attributes whose columns are there and not null (nor among ``skip``); nothing without any."""
    of = {c: a for c, a in attributes.items() if c in columns}
    if not of:
        return F.lit("")
    text = lambda c: F.col(c).cast("string")
    said = F.concat(*(F.when(F.col(c).isNotNull() & ~text(c).isin(*skip) if skip else F.col(c).isNotNull(), F.concat(F.lit(f' w:{a}="'), escaped(text(c)), F.lit('"'))).otherwise(F.lit("")) for c, a in of.items()))
    return F.when(said == "", F.lit("")).otherwise(F.concat(F.lit(f"<w:{tag}"), said, F.lit("/>")))


def borders_xml(columns: list[str], tag: str) -> Column:
    """An element with those sides whose column border_top, border_left, border_bottom, border_right (style, size, color) names a line."""
    sides = F.lit("")
    for side in BORDER_SIDES:
        b = F.col(f"border_{side}") if f"border_{side}" in columns else None
        if b is not None:
            line = F.concat(F.lit(f'<w:{side} w:val="'), escaped(b["style"]), F.lit('" w:sz="'), F.coalesce(b["size"], F.lit(4)).cast("string"), F.lit('" w:space="0" w:color="'), escaped(F.coalesce(b["color"], F.lit("auto"))), F.lit('"/>'))
            sides = F.concat(sides, F.when(F.coalesce(b["style"], F.lit("none")) == "none", F.lit("")).otherwise(line))
    return F.when(sides == "", F.lit("")).otherwise(F.concat(F.lit(f"<w:{tag}>"), sides, F.lit(f"</w:{tag}>")))


def paragraph_properties(columns: list[str]) -> Column:
    """pPr of the columns present, in the order of the format; default values are left out."""
    numbering = F.concat(_element(columns, "ilvl", {"num_level": "val"}), _element(columns, "numId", {"num_id": "val"}))
    inner = F.concat(
        _element(columns, "pStyle", {"style_id": "val"}),
        F.when(F.col("num_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("<w:numPr>"), numbering, F.lit("</w:numPr>"))) if "num_id" in columns else F.lit(""),
        borders_xml(columns, "pBdr"),
        _element(columns, "spacing", {"spacing_before": "before", "spacing_after": "after", "line_value": "line", "line_rule": "lineRule"}, ("0",)),
        _element(columns, "ind", {"indent_left": "left", "indent_right": "right", "first_line": "firstLine", "hanging": "hanging"}, ("0",)),
        _element(columns, "jc", {"alignment": "val"}, ("left",)),
        _element(columns, "outlineLvl", {"outline_level": "val"}),
    )
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit("<w:pPr>"), inner, F.lit("</w:pPr>")))


def table_xml(cells: DataFrame) -> DataFrame:
    """doc_id, block_idx, xml: tables from cells (doc_id, block_idx, row_idx, col_idx, text, optional width, grid_span, v_merge, shading, v_align, border_top to border_right, h_merge_continuation and xml).

    Cells that continue a horizontal merge are left out.  A cell has a
    paragraph for every line of its text, and after them its ``xml`` (nested
    tables).  Table properties (table_style, table_alignment, table_width in
    twips) and row_height are columns of the cells, equal in a table or row.
    """
    have = cells.columns
    if "h_merge_continuation" in have:
        cells = cells.filter(~F.col("h_merge_continuation"))
    props = [F.lit("")]
    if "width" in have:
        props = [F.when(F.col("width").isNotNull(), F.concat(F.lit('<w:tcW w:type="dxa" w:w="'), F.col("width").cast("string"), F.lit('"/>'))).otherwise(F.lit(""))]
    if "grid_span" in have:
        props.append(F.when(F.col("grid_span") > 1, F.concat(F.lit('<w:gridSpan w:val="'), F.col("grid_span").cast("string"), F.lit('"/>'))).otherwise(F.lit("")))
    if "v_merge" in have:
        props.append(F.when(F.col("v_merge") == "restart", F.lit('<w:vMerge w:val="restart"/>')).when(F.col("v_merge") == "continue", F.lit("<w:vMerge/>")).otherwise(F.lit("")))
    props.append(borders_xml(have, "tcBorders"))
    if "shading" in have:
        props.append(F.when(F.col("shading").isNotNull(), F.concat(F.lit('<w:shd w:val="clear" w:color="auto" w:fill="'), escaped("shading"), F.lit('"/>'))).otherwise(F.lit("")))
    props.append(_element(have, "vAlign", {"v_align": "val"}, ("top",)))
    head = F.concat(*props)
    head = F.when(head == "", F.lit("")).otherwise(F.concat(F.lit("<w:tcPr>"), head, F.lit("</w:tcPr>")))
    lines = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("<w:p><w:r>"), text_element(x), F.lit("</w:r></w:p>"))), "")
    nested = F.coalesce(F.concat("xml", F.lit("<w:p/>")), F.lit("")) if "xml" in have else F.lit("")
    cell = F.concat(F.lit("<w:tc>"), head, lines, nested, F.lit("</w:tc>"))
    tall = F.when(F.max("row_height").isNull(), F.lit("")).otherwise(F.concat(F.lit('<w:trPr><w:trHeight w:val="'), F.max("row_height").cast("string"), F.lit('"/></w:trPr>'))) if "row_height" in have else F.lit("")
    said = {"table_style": '<w:tblStyle w:val="{}"/>', "table_width": '<w:tblW w:type="dxa" w:w="{}"/>', "table_alignment": '<w:jc w:val="{}"/>'}
    about = [F.when(F.max(c).isNull(), F.lit("")).otherwise(F.concat(F.lit(x.split("{}")[0]), escaped(F.max(c).cast("string")), F.lit(x.split("{}")[1]))) for c, x in said.items() if c in have]
    rows = cells.groupBy("doc_id", "block_idx", "row_idx").agg(F.concat(F.lit("<w:tr>"), tall, _folded("col_idx", cell), F.lit("</w:tr>")).alias("row"), F.count("*").alias("n"), F.concat(F.lit("<w:tblPr>"), *about, F.lit("</w:tblPr>")).alias("about"))
    grid = F.concat(F.lit("<w:tblGrid>"), F.expr("repeat('<w:gridCol/>', cast(max(n) as int))"), F.lit("</w:tblGrid>"))
    return rows.groupBy("doc_id", "block_idx").agg(F.concat(F.lit("<w:tbl>"), F.max("about"), grid, _folded("row_idx", F.col("row")), F.lit("</w:tbl>")).alias("xml"))


def nested_table_xml(cells: DataFrame, deepest: int) -> DataFrame:
    """doc_id, block_idx, xml: tables within the cells of tables, folded from the deepest level up.

    cells: as for ``table_xml``, with table_id (of its document), depth (0 to
    ``deepest``), cell_id, and parent_id and place: the cell in which a table
    of depth 1 or more stands, after its text, and its order there.  A table
    whose parent cell is not there is left out.
    """
    cells = cells.drop("xml")
    inner = None
    for depth in range(deepest, -1, -1):
        level = cells.filter(F.col("depth") == depth)
        about = level.groupBy("doc_id", "table_id").agg(F.min("block_idx").alias("_block"), F.min("parent_id").alias("_parent"), F.min("place").alias("_place"))
        own = level.drop("block_idx").withColumnRenamed("table_id", "block_idx")
        if inner is not None:
            own = own.join(merged(inner), ["doc_id", "cell_id"], "left")
        made = table_xml(own).withColumnRenamed("block_idx", "table_id").join(merged(about), ["doc_id", "table_id"])
        if depth == 0:
            return made.select("doc_id", F.col("_block").alias("block_idx"), "xml")
        inner = made.groupBy("doc_id", F.col("_parent").alias("cell_id")).agg(_folded("_place", F.col("xml")).alias("xml"))


def section_xml(width: int = 11906, height: int = 16838, margins: dict | None = None, columns: int = 1, landscape: bool = False, references: tuple = ()) -> str:
    """The final sectPr; landscape swaps a portrait size, columns are written where there are several.

    references: (kind, type, rel_id) of headers and footers.
    """
    m = MARGINS | (margins or {})
    if landscape and width < height:
        width, height = height, width
    turn = ' w:orient="landscape"' if landscape else ""
    around = " ".join(f'w:{k}="{m[k]}"' for k in ("top", "right", "bottom", "left", "header", "footer"))
    several = f'<w:cols w:num="{columns}" w:space="720"/>' if columns > 1 else ""
    refs = "".join(f'<w:{kind}Reference w:type="{which}" r:id="{rel_id}"/>' for kind, which, rel_id in references)
    return f'<w:sectPr>{refs}<w:pgSz w:w="{width}" w:h="{height}"{turn}/><w:pgMar {around} w:gutter="0"/>{several}</w:sectPr>'


def section_properties(columns: list[str], last: Column) -> Column:
    """sectPr of section columns (width, height, orientation, margin_*, columns, break_type, references); the last one has no break type.

    Missing values are the defaults; a landscape section turns a portrait size.
    """
    of = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in columns else F.lit(default)
    wide = of("orientation", "portrait") == "landscape"
    w, h = of("width", PAGE_SIZES["A4"][0]), of("height", PAGE_SIZES["A4"][1])
    size = F.concat(F.lit('<w:pgSz w:w="'), F.when(wide, F.greatest(w, h)).otherwise(w).cast("string"), F.lit('" w:h="'), F.when(wide, F.least(w, h)).otherwise(h).cast("string"), F.when(wide, F.lit('" w:orient="landscape"/>')).otherwise(F.lit('"/>')))
    margins = F.concat(F.lit("<w:pgMar"), *(F.concat(F.lit(f' w:{m}="'), of(f"margin_{m}", v).cast("string"), F.lit('"')) for m, v in MARGINS.items()), F.lit(' w:gutter="0"/>'))
    several = F.when(of("columns", 1) > 1, F.concat(F.lit('<w:cols w:num="'), of("columns", 1).cast("string"), F.lit('" w:space="720"/>'))).otherwise(F.lit(""))
    kind = F.when(last | (of("break_type", "") == ""), F.lit("")).otherwise(F.concat(F.lit('<w:type w:val="'), of("break_type", ""), F.lit('"/>')))
    refs = F.lit("")
    if "references" in columns:
        one = lambda r: F.concat(F.lit("<w:"), r["kind"], F.lit('Reference w:type="'), r["type"], F.lit('" r:id="'), escaped(r["rel_id"]), F.lit('"/>'))
        refs = F.coalesce(F.array_join(F.transform("references", one), ""), F.lit(""))
    return F.concat(F.lit("<w:sectPr>"), refs, kind, size, margins, several, F.lit("</w:sectPr>"))


def document_xml(block_rows: DataFrame, section: str | None = None, sections: DataFrame | None = None, backgrounds: DataFrame | None = None) -> DataFrame:
    """doc_id, document_xml from (doc_id, block_idx, xml), blocks in order.

    sections: (doc_id, section_idx, block_idx and section columns); one with a
    block_idx ends there, with a paragraph of its own, the one without is its
    document's last.  Documents without any get ``section``, the default one.
    backgrounds: (doc_id, color).
    """
    last = F.lit(section or section_xml())
    if sections is not None:
        breaks = F.concat(F.lit("<w:p><w:pPr>"), section_properties(sections.columns, F.lit(False)), F.lit("</w:pPr></w:p>"))
        block_rows = block_rows.select("doc_id", "block_idx", "xml").unionByName(sections.filter("block_idx is not null").select("doc_id", "block_idx", breaks.alias("xml")))
    body = block_rows.groupBy("doc_id").agg(_folded("block_idx", F.col("xml")).alias("body"))
    back = F.lit("")
    if sections is not None:
        body = body.join(merged(sections.filter("block_idx is null").select("doc_id", section_properties(sections.columns, F.lit(True)).alias("last"))), "doc_id", "left")
        last = F.coalesce("last", last)
    if backgrounds is not None:
        body = body.join(merged(backgrounds.select("doc_id", F.col("color").alias("_back"))), "doc_id", "left")
        back = F.coalesce(F.concat(F.lit('<w:background w:color="'), escaped("_back"), F.lit('"/>')), F.lit(""))
    return body.select("doc_id", F.concat(F.lit(_DOCUMENT), back, F.lit("<w:body>"), "body", last, F.lit("</w:body></w:document>")).alias("document_xml"))


def style_sheets(styles: DataFrame, *keys: str) -> DataFrame:
    """(keys, styles_xml): a style sheet for each key (a theme, a document; one for all without any), from catalogue rows with their formatting."""
    columns = styles.columns
    have = lambda c: c in columns
    inner = F.concat(
        F.lit('<w:name w:val="'), escaped("name"), F.lit('"/>'), _element(columns, "basedOn", {"based_on": "val"}), _element(columns, "next", {"next": "val"}),
        paragraph_properties([c for c in columns if c != "style_id"]), run_properties([c for c in columns if c in ("font", "bold", "italic", "color", "size")]),
    )
    flags = [F.when(F.col(c), F.lit(f' w:{a}="1"')).otherwise(F.lit("")) for c, a in (("is_default", "default"), ("is_custom", "customStyle")) if have(c)]
    one = F.concat(F.lit('<w:style w:type="'), F.col("type"), F.lit('"'), *flags, F.lit(' w:styleId="'), escaped("style_id"), F.lit('">'), inner, F.lit("</w:style>"))
    sheet = F.concat(F.lit(f'{HEAD}<w:styles xmlns:w="{W}">'), _folded("style_id", one), F.lit("</w:styles>"))
    return styles.groupBy(*keys).agg(sheet.alias("styles_xml"))


def styles_xml(styles: list[dict] | None = None) -> str:
    one = lambda s: f'<w:style w:type="{s["type"]}" w:styleId="{s["style_id"]}"' + (' w:default="1"' if s.get("is_default") else "") + f'><w:name w:val="{s["name"]}"/>' + (f'<w:basedOn w:val="{s["based_on"]}"/>' if s.get("based_on") else "") + "</w:style>"
    return f'{HEAD}<w:styles xmlns:w="{W}">{"".join(map(one, styles or []))}</w:styles>'


def drawing(rel_id: Column, number: Column, cx: Column, cy: Column, description: Column, position: dict[str, Column] | None = None) -> Column:
    """An inline picture, or a floating one with ``position``: offset_x and offset_y, or where one is 0 or null h_align and v_align; wrap (a meaning of ``functions.enums``), z_order, and behind."""
    text = lambda c: escaped(F.coalesce(c.cast("string"), F.lit("")))
    extent = F.concat(F.lit('<wp:extent cx="'), text(cx), F.lit('" cy="'), text(cy), F.lit('"/>'))
    about = F.concat(F.lit('<wp:docPr id="'), text(number), F.lit('" name="Picture '), text(number), F.lit('" descr="'), text(description), F.lit('"/>'))
    picture = F.concat(
        F.lit('<a:graphic xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:pic xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:nvPicPr><pic:cNvPr id="'),
        text(number), F.lit('" name="Picture"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="'), text(rel_id),
        F.lit('"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="'), text(cx), F.lit('" cy="'), text(cy),
        F.lit('"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic>'),
    )
    space = F.lit('xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"')
    if position is None:
        return F.concat(F.lit("<w:drawing><wp:inline "), space, F.lit(">"), extent, about, picture, F.lit("</wp:inline></w:drawing>"))
    of = lambda c, default: F.coalesce(position[c], F.lit(default)) if c in position else F.lit(default)

    def at(tag: str, base: str, offset: Column, align: Column) -> Column:
        inner = F.when(offset != 0, F.concat(F.lit("<wp:posOffset>"), text(offset), F.lit("</wp:posOffset>"))).otherwise(F.concat(F.lit("<wp:align>"), text(align), F.lit("</wp:align>")))
        return F.concat(F.lit(f'<wp:{tag} relativeFrom="{base}">'), inner, F.lit(f"</wp:{tag}>"))

    wrap = of("wrap", "square")
    behind = of("behind", False) | (wrap == "behindText")
    contour = '<wp:wrapPolygon edited="0"><wp:start x="0" y="0"/><wp:lineTo x="0" y="21600"/><wp:lineTo x="21600" y="21600"/><wp:lineTo x="21600" y="0"/><wp:lineTo x="0" y="0"/></wp:wrapPolygon>'
    around = F.when(wrap == "square", '<wp:wrapSquare wrapText="bothSides"/>').when(wrap == "tight", f'<wp:wrapTight wrapText="bothSides">{contour}</wp:wrapTight>').when(wrap == "through", f'<wp:wrapThrough wrapText="bothSides">{contour}</wp:wrapThrough>')
    around = around.when(wrap == "topBottom", "<wp:wrapTopAndBottom/>").otherwise("<wp:wrapNone/>")
    head = F.concat(
        F.lit("<w:drawing><wp:anchor "), space, F.lit(' distT="114300" distB="114300" distL="114300" distR="114300" simplePos="0" locked="0" layoutInCell="1" allowOverlap="1" behindDoc="'),
        F.when(behind, "1").otherwise("0"), F.lit('" relativeHeight="'), text(of("z_order", 0)), F.lit('"><wp:simplePos x="0" y="0"/>'),
    )
    placed = F.concat(at("positionH", "column", of("offset_x", 0), of("h_align", "left")), at("positionV", "paragraph", of("offset_y", 0), of("v_align", "top")))
    return F.concat(head, placed, extent, F.lit('<wp:effectExtent l="0" t="0" r="0" b="0"/>'), around, about, picture, F.lit("</wp:anchor></w:drawing>"))


def header_xml(paragraphs: DataFrame, kind: str = "header") -> DataFrame:
    """doc_id, data: one header or footer part from paragraphs (doc_id, block_idx, xml)."""
    tag = "hdr" if kind == "header" else "ftr"
    whole = F.concat(F.lit(f'{HEAD}<w:{tag} xmlns:w="{W}" xmlns:r="{R}">'), _folded("block_idx", F.col("xml")), F.lit(f"</w:{tag}>"))
    return paragraphs.groupBy("doc_id").agg(F.encode(whole, "UTF-8").alias("data"))


def safe_target(target: str) -> str:
    """A part's name below word/: forward slashes, no way up or out."""
    return "/".join(x for x in target.replace("\\", "/").split("/") if x not in ("", ".", ".."))


#: Packages that a kernel makes and hands on together: a row of a hundred bytes becomes thousands.
FEW = 256


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, FEW) for batch in batches for i in range(0, batch.num_rows, FEW))


def _member(name: str, data: bytes) -> tuple[bytes, bytes, bytes]:
    """A member of an archive, and its entry in the directory but for the member's place, which goes before the name; of a fixed time: equal rows give equal bytes."""
    title = name.encode()
    packer = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    about = struct.pack("<5H3L2H", 20, 0 if name.isascii() else 0x800, zipfile.ZIP_DEFLATED, 0, 1 << 5 | 1, zlib.crc32(data), len(packed), len(data), len(title), 0)
    return b"PK\3\4" + about + title + packed, b"PK\1\2" + struct.pack("<2B", 20, 3) + about + struct.pack("<3HL", 0, 0, 0, 0o600 << 16), title


#: Most parts of a package are the same in all of them: those are deflated once.
_fixed = lru_cache(64)(_member)


def _archive(members: list[tuple[str, bytes, bool]]) -> bytes:
    """An archive of (name, data, whether other packages have the same), byte for byte as ``zipfile`` writes it."""
    if len(members) > 0xFFFF:  # more than a plain directory can count
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data, _ in members:
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
        return held.getvalue()
    body, directory, at = [], [], 0
    for name, data, common in members:
        member, entry, title = (_fixed if common else _member)(name.split("\0")[0], data)
        body.append(member)
        directory += (entry, struct.pack("<L", at), title)
        at += len(member)
    listed = b"".join(directory)
    return b"".join((*body, listed, b"PK\5\6", struct.pack("<4H2LH", 0, 0, len(members), len(members), len(listed), at, 0)))


def _packed(batches: Iterator[pa.RecordBatch], styles: str) -> Iterator[pa.RecordBatch]:
    defaults = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    override = lambda n, t: f'<Override PartName="{n}" ContentType="{t}"/>'
    fixed = defaults + "".join(override(*x) for x in OVERRIDES)
    rel = lambda i, kind, target, mode="": f'<Relationship Id={quoteattr(i)} Type="{R}/{kind}" Target={quoteattr(target)}{mode and f" TargetMode={quoteattr(mode)}"}/>'
    core_rel = '<Relationship Id="rId2" Type="http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties" Target="docProps/core.xml"/>'
    root = f'{HEAD}<Relationships xmlns="{PACKAGE_RELS}">{rel("rId1", "officeDocument", "word/document.xml")}{core_rel}{rel("rId3", "extended-properties", "docProps/app.xml")}</Relationships>'
    base = "".join(rel(*x) for x in BASE_RELS)
    plain = lambda tag: f'{HEAD}<w:{tag} xmlns:w="{W}"/>'
    app = lambda n, t: f'{HEAD}<Properties xmlns="{EXTENDED}"><Application>inkshred</Application>{"" if n is None else f"<Paragraphs>{n}</Paragraphs>"}{"" if t is None else f"<Tables>{t}</Tables>"}</Properties>'
    core = None
    for batch in _few(batches):
        out = []
        columns = (batch.column(c).to_pylist() for c in ("document_xml", "core_xml", "styles_xml", "extra", "n_paragraphs", "n_tables"))
        for document, props, own_styles, more, n_paragraphs, n_tables in zip(*columns, strict=True):
            have = {safe_target(m["target"]) for m in more or [] if m["data"] and not m["target_mode"]}
            more = sorted((m for m in more or [] if m["target_mode"] or safe_target(m["target"]) in have), key=lambda m: m["rel_id"])
            of: dict[str, str] = {"document.xml": base}
            for m in more:
                source = safe_target(m["source"] or "document.xml")
                of[source] = of.get(source, "") + rel(m["rel_id"], m["rel_kind"], m["target"], m["target_mode"] or "")
            bare = of == {"document.xml": base}
            links, *others = (f'{HEAD}<Relationships xmlns="{PACKAGE_RELS}">{x}</Relationships>' for x in of.values())
            lists = [(f"word/{'/'.join(['', *x.split('/')][1:-1] + ['_rels', x.split('/')[-1]])}.rels", y) for x, y in zip(list(of)[1:], others, strict=True)]
            more = list({safe_target(m["target"]): m | {"target": safe_target(m["target"])} for m in reversed(more) if m["data"] and not m["target_mode"]}.values())[::-1]
            types = f'{HEAD}<Types xmlns="{CONTENT_TYPES}">{fixed}{"".join(override("/word/" + m["target"], m["content_type"]) for m in more)}</Types>'
            whole = [("[Content_Types].xml", types, not more), ("_rels/.rels", root, True), ("word/document.xml", document, False), ("word/_rels/document.xml.rels", links, bare), ("docProps/core.xml", props, props == core), ("docProps/app.xml", app(n_paragraphs, n_tables), n_paragraphs is None and n_tables is None), ("word/styles.xml", own_styles or styles, not own_styles)]
            whole += [("word/fontTable.xml", plain("fonts"), True), ("word/theme/theme1.xml", HEAD + THEME, True), ("word/settings.xml", plain("settings"), True), ("word/webSettings.xml", plain("webSettings"), True), *((*x, False) for x in lists)]
            out.append(_archive([*((name, data.encode(), common) for name, data, common in whole), *(("word/" + m["target"], m["data"], False) for m in more)]))
            core = props
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "content"])


def core_xml(columns: list[str]) -> Column:
    """Core properties from title, subject, creator, keywords (array), description, created and modified (texts in W3CDTF) where present."""
    tag = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"<{name}>"), escaped(value), F.lit(f"</{name}>"))).otherwise(F.lit(""))
    inner = [tag(name, F.col(c)) for c, name in (("title", "dc:title"), ("subject", "dc:subject"), ("creator", "dc:creator"), ("description", "dc:description")) if c in columns]
    if "keywords" in columns:
        inner.append(tag("cp:keywords", F.array_join("keywords", ", ")))
    for c in ("created", "modified"):
        if c in columns:
            inner.append(F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<dcterms:{c} xsi:type="dcterms:W3CDTF">'), escaped(F.col(c).cast("string")), F.lit(f"</dcterms:{c}>"))).otherwise(F.lit("")))
    spaces = 'xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'
    return F.concat(F.lit(f'{HEAD}<cp:coreProperties xmlns:cp="{CORE}" {spaces}>'), *inner, F.lit("</cp:coreProperties>"))


_EXTRA = "array<struct<rel_id:string,rel_kind:string,target:string,content_type:string,data:binary,target_mode:string,source:string>>"


def _packable(documents: DataFrame, metadata: DataFrame | None, parts: DataFrame | None) -> DataFrame:
    d = documents if metadata is None else documents.join(merged(metadata), "doc_id", "left")
    extra = F.lit(None).cast(_EXTRA)
    if parts is not None:
        mode = F.nullif(F.col("target_mode"), F.lit("")) if "target_mode" in parts.columns else F.lit(None)
        more = parts.groupBy("doc_id").agg(F.collect_list(F.struct("rel_id", "rel_kind", "target", "content_type", "data", mode.cast("string").alias("target_mode"), (F.col("source") if "source" in parts.columns else F.lit(None)).cast("string").alias("source"))).alias("extra"))
        d, extra = d.join(merged(more), "doc_id", "left"), F.col("extra")
    own = F.col("styles_xml") if "styles_xml" in d.columns else F.lit(None).cast("string")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), "document_xml", core_xml(d.columns).alias("core_xml"), own.alias("styles_xml"), extra.alias("extra"), *((F.col(c) if c in d.columns else F.lit(None)).cast("long").alias(c) for c in ("n_paragraphs", "n_tables")))


def assemble(documents: DataFrame, metadata: DataFrame | None = None, styles: list[dict] | None = None, parts: DataFrame | None = None) -> DataFrame:
    """doc_id, content: one package per (doc_id, document_xml) row.

    A column ``styles_xml`` of the documents is their style sheet (see
    ``style_sheets``).  parts: further parts (doc_id, rel_id, rel_kind, target
    below word/, content_type, data) such as headers, footers, media and
    numbering; with a target_mode it is a relationship to something outside,
    such as a hyperlink's; those with neither bytes nor mode are left out.  A
    column ``source`` names the part below word/ whose relationship it is (a
    header; null: the main document), so a part that several name is written
    once, under the lists of relationships of each.  Columns n_paragraphs and
    n_tables of the documents or metadata become extended properties.
    """
    sheet = styles_xml(styles)
    return mapped(_packable(documents, metadata, parts), lambda batches: _packed(batches, sheet), "doc_id string, content binary")


def assemble_and_scan(documents: DataFrame, *kinds: str, metadata: DataFrame | None = None, styles: list[dict] | None = None, parts: DataFrame | None = None, most_bytes: int = MOST_BYTES, places: bool = True) -> DataFrame:
    """The XML nodes of the packages that ``assemble`` makes, as ``sources.docx.scan`` reads them, in one pass: each package is made, opened and parsed in one worker, its bytes never leave it.

    places: whether the nodes have the byte offsets and written names of their
    elements, which only edits in place ask for.
    """
    sheet, scan = styles_xml(styles), scanner(*kinds, most_bytes=most_bytes, places=places)
    return mapped(_packable(documents, metadata, parts), lambda batches: scan(_packed(batches, sheet)), NODES if places else NODES_WITHOUT_PLACES)


def empty_documents(keys: DataFrame) -> DataFrame:
    """doc_id, document_xml of new documents without a block, one for each (doc_id): the default section, and with ``assemble`` the base relationships."""
    spaces = f'xmlns:w="{W}" xmlns:r="{R}"'
    return keys.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(f"{HEAD}<w:document {spaces}><w:body>{section_xml()}</w:body></w:document>").alias("document_xml"))


def save(packages: DataFrame, path: str) -> None:
    """Write (doc_id, content) packages as rows of a Parquet table, the form in which a cluster keeps many small files."""
    packages.write.mode("overwrite").parquet(path)


def file_name(doc_id: str) -> str:
    """A document's file: its id, percent-encoded."""
    return quote(doc_id, safe="") + ".docx"


def write_files(packages: DataFrame, path: str) -> DataFrame:
    """Write each (doc_id, content) package as <doc_id>.docx below ``path`` and return the list of files (doc_id, file, bytes).

    Every task writes its own packages through the file system of the path
    (file, hdfs, s3, gs), which all executors must share.  A file is
    written under another name and then moved, so a file that is there is
    whole, and a task that is tried again replaces its files by equal ones.
    The list is kept as a table beside them, in ``_files``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = fs.FileSystem.from_uri(path)
        where.create_dir(folder, recursive=True)
        for batch in _few(batches):
            files, sizes = [], []
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                name = file_name(doc_id)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as out:
                    out.write(content)
                where.move(part, f"{folder}/{name}")
                files.append(name)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(files, pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "file", "bytes"])

    rows = packages.filter("doc_id is not null and content is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "content")
    mapped(rows, write, "doc_id string, file string, bytes long").write.mode("overwrite").parquet(f"{path}/_files")
    return packages.sparkSession.read.parquet(f"{path}/_files")


def rewrite(packages: DataFrame, changed: DataFrame) -> DataFrame:
    """(doc_id, content): packages with some parts replaced or added, every other part kept byte for byte.

    changed: (doc_id, part_name, data).  Parts keep their order and names
    compare as in the scan; a document without changes, or that is no archive,
    is returned as it is.
    """
    from ..sources.docx import BROKEN, key_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            out = []
            for content, new in zip(batch.column("content").to_pylist(), batch.column("new").to_pylist(), strict=True):
                held = io.BytesIO()
                try:
                    if not new:
                        raise ValueError("nothing to change")
                    left = {key_of(x["part_name"]): (x["part_name"], x["data"]) for x in new}
                    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                        for e in old.infolist():
                            _, data = left.pop(key_of(e.filename), (None, None))
                            z.writestr(e, old.read(e) if data is None else data, e.compress_type)
                        for name, data in left.values():
                            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
                    out.append(held.getvalue())
                except (*BROKEN, TypeError):
                    out.append(content)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "content"])

    new = changed.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("part_name", "data"))).alias("new"))
    return mapped(packages.select("doc_id", "content").join(merged(new), "doc_id", "left"), run, "doc_id string, content binary")
