"""Registered queries of the document engine over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..builder import Template
from ..functions import scalars
from ..operators import edits, structure, styles
from ..sinks import docx as sink
from ..sources import docx as source
from ..sources.store import merged, shared_folder, stored
from . import model


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The XML of each document of the table: one paragraph, its text one run."""
    runs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("block_idx"), F.lit(0).alias("run_idx"), "text")
    return sink.documents_of_runs(runs)


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of the table as a package."""
    return sink.assemble(_documents(spark, sf_dir))


def roundtrip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document as a package and read its text back."""
    runs = model.runs(stored(model.of_paragraphs(sink.assemble_and_scan(_documents(spark, sf_dir), "document", places=False)), dealt=True))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "run", "text"))), lambda s: s["text"]), "")
    texts = runs.groupBy("doc_id").agg(text.alias("text"))
    every = _t(spark, sf_dir, "documents").select("doc_id")
    return every.join(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def paragraph_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One paragraph per line through package and back: per document paragraphs and characters."""
    lines = structure.text_blocks(_t(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("doc_id"), "block_idx", F.lit(0).alias("run_idx"), "text")
    nodes = stored(model.of_paragraphs(sink.assemble_and_scan(sink.documents_of_runs(lines), "document", places=False)), dealt=True)
    p = model.paragraphs(nodes, model.runs(nodes)).filter("container = 'body'")
    return p.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n_paragraphs"), F.sum(F.length("text")).alias("n_chars"))


def _read(block_rows: DataFrame, *kinds: str, parts: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
    """The XML nodes of packages written from block rows, parsed and stored once."""
    return stored(sink.assemble_and_scan(sink.document_xml(block_rows, sections=sections), *(kinds or ("document",)), parts=parts, places=False), dealt=True)


def _nation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the cells of a table per region, two in a row, written and read again as nodes."""
    n = edits.number_rows(_t(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "k")
    cells = n.select(
        F.col("n_regionkey").cast("string").alias("doc_id"), F.lit(0).alias("block_idx"), F.floor((F.col("k") - 1) / 2).cast("int").alias("row_idx"), F.pmod(F.col("k") - 1, F.lit(2)).cast("int").alias("col_idx"), F.col("n_name").alias("text"),
        (F.col("n_nationkey") * 10).alias("width"), F.when(F.col("n_nationkey") % 2 == 0, "center").otherwise("top").alias("v_align"), F.when(F.col("n_nationkey") % 3 == 0, "D9D9D9").alias("shading"),
    )
    return _read(sink.table_xml(cells))


def _cells(nodes: DataFrame) -> DataFrame:
    return model.table_cells(nodes, model.paragraphs(nodes, model.runs(nodes)))


def table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the cells of a table per region, through package and back."""
    got = _cells(_nation_tables(spark, sf_dir))
    return got.select(F.col("doc_id").cast("int").alias("region"), F.col("row_idx").cast("int").alias("row_idx"), F.col("col_idx").cast("int").alias("col_idx"), "text", "width", "v_align", "shading")


def opc_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every generated package with kind and content type."""
    return model.typed_parts(source.typed_parts(_packages(spark, sf_dir))).select("doc_id", "part_key", "kind", "content_type")


def properties_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and language as title and creator of every document's package, read back."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("block_idx"), F.lit(0).alias("run_idx"), F.lit("x").alias("text"), F.col("source").alias("title"), F.col("lang").alias("creator"))
    content = sink.assemble(sink.document_xml(sink.paragraph_xml(docs.drop("title", "creator"))), docs.select("doc_id", "title", "creator"))
    got = model.core_properties(source.scan(content, "core_properties"))
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), "title", "creator")


def image_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes read from PNG headers made of the parts' numbers."""
    word = lambda c: F.lpad(F.hex(c), 8, "0")
    data = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), word(F.col("p_size")), word(F.col("p_partkey")), F.lit("0806000000")))
    media = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit("word/media/image1.png").alias("part_key"), data.alias("data"))
    return source.image_dims(media).select(F.col("doc_id").cast("long").alias("p_partkey"), "width_px", "height_px", "width_emu", "height_emu")


def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.text_blocks(_t(spark, sf_dir, "documents")).select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "text")


def doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.counts(structure.text_blocks(_t(spark, sf_dir, "documents")))


def first_n_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.first_blocks(paragraph_blocks(spark, sf_dir))


def find_replace_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.replace_text(_t(spark, sf_dir, "conversations"), "user", "reader", "role").select("conv_id", "turn", "role")


def heading_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.heading_bookmarks(_t(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")


def section_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.section_ordinals(_t(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "system").select("conv_id", "turn", "section_idx")


def run_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.concat_in_order(_t(spark, sf_dir, "conversations"), "conv_id", "turn")


def table_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.tables(_nation_tables(spark, sf_dir)).select(F.col("doc_id").cast("int").alias("table_id"), "n_rows", "n_cols")


def table_cell_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(_nation_tables(spark, sf_dir)).filter("row_idx = 1 and col_idx = 0").select(F.col("doc_id").cast("int").alias("table_id"), "text")


def row_insert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row inserted into every region's table at an index of its own, out of range for some, then another one deleted."""
    n = edits.number_rows(_t(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "k")
    cells = n.select(F.col("n_regionkey").alias("table_id"), (F.col("k") - 1).cast("long").alias("row_idx"), F.lit(0).alias("col_idx"), F.col("n_name").alias("text"))
    at = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("table_id"), F.col("r_regionkey").alias("at"))
    out = edits.delete_row(edits.insert_row(cells, at.withColumn("at", F.col("at") * 3)), at)
    return out.select("table_id", "row_idx", "text")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.sequence(F.lit(0), F.lit(3))
    return _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("table_id"), F.explode(side).alias("row_idx")).select("table_id", "row_idx", F.explode(side).alias("col_idx"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(F.col("n_regionkey").alias("table_id"), k.alias("region_id"), F.pmod(k, F.lit(3)).alias("r0"), F.pmod(F.floor(k / 3).cast("int"), F.lit(3)).alias("c0"), (F.pmod(k, F.lit(2)) + 1).alias("rows"), (F.pmod(F.floor(k / 2).cast("int"), F.lit(3)) + 1).alias("cols"))


def merge_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = structure.first_wins(_regions(spark, sf_dir), ["table_id"], ["region_id"])
    out = edits.merge_cells(_grid(spark, sf_dir), first)
    return out.select("table_id", "row_idx", "col_idx", F.col("grid_span").cast("int").alias("grid_span"), "v_merge", "h_merge_continuation")


def merge_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("table_id"), F.lit(4).alias("n_rows"), F.lit(4).alias("n_cols"))
    return edits.merge_violations(_regions(spark, sf_dir), tables)


def rel_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation").select("n_name", F.when(F.col("n_nationkey") < 20, F.col("n_regionkey")).otherwise(F.col("n_regionkey") + 100).alias("rel_id"))
    return structure.resolve(n, _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rel_id"), F.col("r_name").alias("target"))).select("n_name", "rel_id", "target")


def content_type_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("part_name"))
    overrides = _t(spark, sf_dir, "pages").filter("page_id = 0").select(F.regexp_replace("url", r"[?#].*$", "").alias("part_name"), F.lit("text/override").alias("content_type"))  # a one-part override, as a package has for its main part
    defaults = spark.createDataFrame([("html", "text/html"), ("xml", "application/xml")], "ending string, content_type string")
    return structure.content_type(pages, overrides, defaults).select("page_id", "content_type")


def merge_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping rectangles of every table: those that are merged."""
    tables = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("table_id"), F.lit(4).alias("n_rows"), F.lit(4).alias("n_cols"))
    return edits.accepted(_regions(spark, sf_dir), tables).select("table_id", "region_id")


def _one_run(df: DataFrame, key: str, **columns) -> DataFrame:
    """A document with one paragraph of one run for every row."""
    return df.select(F.col(key).cast("string").alias("doc_id"), F.lit(0).alias("block_idx"), F.lit(0).alias("run_idx"), *(c.alias(n) for n, c in columns.items()))


def missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures whose relationship leads nowhere: every third supplier's medium is left out."""
    s = _t(spark, sf_dir, "supplier")
    runs = _one_run(s, "s_suppkey", text=F.lit(""), drawing=sink.drawing(F.lit("rId6"), F.lit(1), F.lit(9525), F.lit(9525), F.col("s_name")))
    png = F.unhex(F.lit("89504E470D0A1A0A0000000D4948445200000004000000060806000000"))
    media = s.select(F.col("s_suppkey").cast("string").alias("doc_id"), F.lit("rId6").alias("rel_id"), F.lit("image").alias("rel_kind"), F.lit("media/image1.png").alias("target"), F.lit("image/png").alias("content_type"), F.when(F.col("s_suppkey") % 3 != 0, png).alias("data"))
    content = sink.assemble(sink.document_xml(sink.paragraph_xml(runs)), parts=media)
    nodes = stored(source.scan(content, "document", "document_rels"))
    images = model.images(nodes, source.image_dims(source.parts(content, "media")))
    return images.filter("target is null and width_px is null").select(F.col("doc_id").cast("long").alias("s_suppkey"), "rel_id", "description")


def field_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field per customer, written and read back with code, result and state."""
    c = _t(spark, sf_dir, "customer")
    runs = _one_run(c, "c_custkey", text=F.lit(""), field_code=F.concat(F.lit("SEQ "), "c_mktsegment"), field_result=F.col("c_name"), field_dirty=F.col("c_custkey") % 2 == 0)
    nodes = _read(sink.paragraph_xml(runs))
    return model.fields(nodes, model.runs(nodes)).select(F.col("doc_id").cast("long").alias("c_custkey"), "code", "result", "dirty")


def break_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(F.lit("page"), F.lit("column"), F.lit("line"))
    runs = _one_run(_t(spark, sf_dir, "customer"), "c_custkey", text=F.col("c_name"), breaks=F.slice(kinds, 1, F.pmod("c_custkey", F.lit(3)).cast("int") + 1))
    got = model.runs(_read(sink.paragraph_xml(runs)))
    return got.select(F.col("doc_id").cast("long").alias("c_custkey"), "text", F.array_join("breaks", ",").alias("breaks"))


def hyperlink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url as the target of a hyperlink, read back through its relationship."""
    p = _t(spark, sf_dir, "pages").filter("url is not null and url != ''")
    runs = _one_run(p, "page_id", text=F.lit("page"), style=F.lit("Hyperlink"), rel_id=F.lit("rId6"))
    rels = p.select(F.col("page_id").cast("string").alias("doc_id"), F.lit("rId6").alias("rel_id"), F.lit("hyperlink").alias("rel_kind"), F.col("url").alias("target"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("binary").alias("data"), F.lit("External").alias("target_mode"))
    nodes = _read(sink.paragraph_xml(runs), "document", "document_rels", parts=rels)
    return model.hyperlinks(nodes, model.runs(nodes)).select(F.col("doc_id").cast("long").alias("page_id"), "text", "url")


def corrupt_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of four packages damaged in different ways: what is reported, and the others read."""
    k = F.pmod(F.col("doc_id").cast("long"), F.lit(4))
    bad = F.concat(F.substring("content", 1, 70), F.unhex(F.lit("FF" * 30)), F.substring("content", 101, 1 << 30))
    content = _packages(spark, sf_dir).withColumn("content", F.when(k == 1, F.encode(F.lit("no archive"), "UTF-8")).when(k == 2, F.lit(None)).when(k == 3, bad).otherwise(F.col("content")))
    parts = source.parts(content, "content_types")
    out = source.errors(parts, source.nodes(parts, "content_types"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "code", "op", "part")


def formatting_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run and paragraph formatting of every part number, written and read back."""
    p = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))
    runs = _one_run(p, "p_partkey", text=F.col("p_name"), bold=k % 2 == 0, italic=k % 3 == 0, strike=k % 5 == 0, underline=pick("none", "single", "double"), highlight=pick("green", "none"), color=F.lpad(F.hex(k), 6, "0"), size=(F.pmod(k, F.lit(40)) + 24).cast("int"), font=pick("Arial", "Times New Roman"), font_east_asia=F.lit("SimSun"), font_cs=pick("Arial", None))
    about = p.select(k.cast("string").alias("doc_id"), F.lit(0).alias("block_idx"), pick("Heading1", None).alias("style_id"), pick("left", "center", "right").alias("alignment"), (k % 360).alias("spacing_before"), F.lit(120).alias("spacing_after"), F.lit(480).alias("line_value"), F.lit("exact").alias("line_rule"), (k % 720).alias("indent_left"), F.lit(360).alias("indent_right"), F.when(k % 2 == 0, 240).alias("first_line"), F.when(k % 2 == 1, 200).alias("hanging"), F.when(k % 4 == 0, 1).alias("num_id"), F.when(k % 4 == 0, k % 9).alias("num_level"))
    nodes = _read(sink.paragraph_xml(runs, about))
    r = model.stored_runs(nodes)
    got = model.paragraphs(nodes, r).select("doc_id", "style_id", "alignment", "spacing_before", "spacing_after", "line_value", "line_rule", "indent_left", "indent_right", "first_line", "hanging", "num_id", "num_level")
    names = ("text", "bold", "italic", "strike", "underline", "highlight", "color", "size", "font", "font_east_asia", "font_cs")
    return r.select("doc_id", *names).join(merged(got), "doc_id").withColumn("p_partkey", F.col("doc_id").cast("long")).drop("doc_id")


def section_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sections for every second supplier, one or none for the others, read back in order."""
    s = _t(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    runs = s.select(k.cast("string").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(2))).alias("block_idx"), F.lit(0).alias("run_idx"), F.col("s_name").alias("text"))
    doc = k.cast("string").alias("doc_id")
    first = s.filter(k % 2 == 0).select(doc, F.lit(0).alias("section_idx"), F.lit(1).alias("block_idx"), F.lit("landscape").alias("orientation"), F.lit(2).alias("columns"), F.lit("evenPage").alias("break_type"), (k % 900 + 1).alias("margin_right"))
    last = s.filter(k % 3 != 0).select(doc, F.lit(1).alias("section_idx"), F.lit(None).cast("int").alias("block_idx"), F.lit("portrait").alias("orientation"), F.lit(3).alias("columns"), F.lit("nextPage").alias("break_type"), F.lit(1440).alias("margin_right"))
    nodes = _read(sink.paragraph_xml(runs), sections=first.unionByName(last))
    return model.sections(nodes).select(F.col("doc_id").cast("long").alias("s_suppkey"), F.col("section_idx").cast("int").alias("section_idx"), "width", "orientation", F.col("columns").cast("int").alias("columns"), "break_type", "margin_right")


def border_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borders of a paragraph and of a table cell for every part, written and read back side by side."""
    k = F.col("p_partkey")
    p = _t(spark, sf_dir, "part")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))
    line = pick("single", "dotted", "double", "none")
    about = {"border_top": edits.border(line, k % 24 + 1, F.lpad(F.hex(k), 6, "0")), "border_left": edits.border(pick("thick", "none", "zigzag"), 8), "border_right": edits.border("dashed", 2, "FF0000")}
    content = Template(p, "p_partkey").paragraph(**about).text(F.col("p_name")).table([[F.col("p_brand")]], border_bottom=about["border_top"], border_left=about["border_left"]).packages()
    nodes = stored(source.scan(content, "document"))
    got = model.paragraphs(nodes, model.runs(nodes))
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"border_{s}").alias("b")) for s in ("top", "left", "bottom", "right")))).alias("x")
    both = got.filter("container = 'body'").select("doc_id", F.lit("paragraph").alias("place"), sides).unionByName(model.table_cells(nodes, got).select("doc_id", F.lit("cell").alias("place"), sides))
    return both.filter("x.b.style is not null").select(F.col("doc_id").cast("long").alias("p_partkey"), "place", "x.side", "x.b.style", "x.b.size", "x.b.color")


def _letters(spark: SparkSession, sf_dir: str) -> Template:
    """A letter for every customer: heading, two runs, a table and a landscape first section."""
    c = _t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    letter = Template(c, "c_custkey", title=F.col("c_name"), creator=F.col("c_mktsegment")).paragraph("Heading1", alignment="center").text(F.col("c_name"), bold=True)
    letter.paragraph(spacing_before=k * 300).text("Segment ").text(F.col("c_mktsegment"), italic=k % 2 == 0, size=k)
    return letter.table([["key", k], ["nation", F.col("c_nationkey")]], table_style="TableGrid").section(orientation="landscape", columns=k % 12).section(last=True)


def template_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters written and read back: the blocks of each document with style, size and text."""
    nodes = stored(_letters(spark, sf_dir).nodes("document"), dealt=True)
    runs = model.stored_runs(nodes)
    p = model.stored_paragraphs(nodes, runs)
    sizes = runs.groupBy("doc_id", "para").agg(F.max("size").alias("size"), F.max("italic").alias("italic"))
    texts = p.filter("container = 'body' and n_runs > 0").join(merged(sizes), ["doc_id", "para"]).select("doc_id", F.col("para_idx").cast("int").alias("at"), F.lit("p").alias("kind"), F.col("style_id").alias("style"), "text", F.col("size").cast("long").alias("size"), "italic", "spacing_before")
    cells = model.table_cells(nodes, p).select("doc_id", (F.col("row_idx") * 2 + F.col("col_idx")).cast("int").alias("at"), F.lit("tc").alias("kind"), F.lit(None).cast("string").alias("style"), "text")
    sections = model.sections(nodes).select("doc_id", F.col("section_idx").cast("int").alias("at"), F.lit("sect").alias("kind"), F.col("orientation").alias("style"), F.col("columns").cast("string").alias("text"))
    out = texts.unionByName(cells, allowMissingColumns=True).unionByName(sections, allowMissingColumns=True)
    return out.withColumn("c_custkey", F.col("doc_id").cast("long")).drop("doc_id")


def template_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the letters ask for and may not have."""
    made = _letters(spark, sf_dir).build()
    each = [x.select(F.col("doc_id").cast("long").alias("c_custkey"), F.lit(kind).alias("kind"), F.explode("violations").alias("violation")) for kind, x in made.items()]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


def theme_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's run coloured by its role in a theme."""
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.pmod("event_id", F.lit(len(values))) + 1).cast("int"))
    runs = _t(spark, sf_dir, "events").select("event_id", pick("corporate", "academic", "tech-darkmode", "none").alias("theme"), pick("muted", "success", "warning", "error", "code", "small", "primary").alias("role"), F.lit(22).alias("size"))
    return styles.apply_palette(runs, styles.themes(spark)).select("event_id", "color", "font", "size")


def docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A .docx file per customer, written, then read by path."""
    path = f"{shared_folder(spark)}/docx-{uuid.uuid4().hex}"
    sink.write_files(sink.assemble(sink.document_xml(sink.paragraph_xml(_one_run(_t(spark, sf_dir, "customer"), "c_custkey", text=F.col("c_name"))))), path)
    runs = model.runs(source.scan_listed(spark, path, "document", places=False))
    number = F.regexp_extract("path", r"([0-9]+)\.docx$", 1).cast("long")
    return source.listed(spark, path).select("doc_id", number.alias("c_custkey")).join(merged(runs), "doc_id").select("c_custkey", "text")


def relationship_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships of every region's document: some added, one deleted."""
    n = edits.number_rows(_t(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "k")
    rels = n.select(F.col("n_regionkey").cast("string").alias("doc_id"), F.concat(F.lit("rId"), F.col("k").cast("string")).alias("rel_id"), F.lit("image").alias("rel_type"), F.col("n_name").alias("target"), F.lit("").alias("target_mode"))
    added = _t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("doc_id"), F.lit("hyperlink").alias("rel_type"), F.explode(F.array(F.col("r_name"), F.lit(""), F.lower("r_name"))).alias("target"), F.lit("external").alias("target_mode"))
    gone = _t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("doc_id"), F.concat(F.lit("rId"), (F.col("r_regionkey") + 1).cast("string")).alias("rel_id"))
    return structure.remove(structure.add_relationships(rels, added), gone)


def hex_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda m: F.pmod("p_partkey", F.lit(m)).cast("int")
    return _t(spark, sf_dir, "part").select("p_partkey", scalars.to_hex(c(256), c(251), c(241)).alias("color"))


def hex_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = hex_encode(spark, sf_dir).withColumn("rgb", scalars.from_hex(F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.concat(F.lit("#"), F.lower("color"))).when(F.pmod("p_partkey", F.lit(3)) == 1, F.substring("color", 1, 3)).otherwise(F.concat("color", F.lit("0")))))
    return x.select("p_partkey", *(F.col(f"rgb.{c}").cast("int").alias(c) for c in "rgb"))


def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, inches = F.col("p_size"), F.col("p_size") / F.lit(7.0)
    return _t(spark, sf_dir, "part").select("p_partkey", scalars.pixels_to_emu(px).alias("emu"), scalars.inches_to_pixels(inches).alias("px_in"), scalars.inches_to_emu(inches).alias("emu_in"), scalars.emu_to_pixels(F.col("p_partkey") * 1000).cast("long").alias("px_back"))


def part_name_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("./"), F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), "/", "\\\\"))
    return _t(spark, sf_dir, "pages").select("page_id", scalars.part_name(path).alias("part_key"))


def field_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", scalars.field_type(F.concat(F.lit(" "), F.when(F.col("event_id") % 2 == 0, "page").otherwise(F.lit("ref ")), F.col("event_type"))).alias("field_type"))


def hyperlink_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", scalars.hyperlink_url(F.regexp_extract("html", r"(href=\"[^\"]*\")", 1)).alias("href"))


def atoi_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.element_at(F.array(F.lit(" "), F.lit("x"), F.lit("-"), F.lit("+"), F.lit("")), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", scalars.strict_int(F.concat(bad, F.col("p_size").cast("string"))).alias("value"))


def edit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _t(spark, sf_dir, "part").select("p_partkey", F.lit(22).alias("size"), F.lit("none").alias("underline"))
    out = edits.set_run(runs, size=(F.col("p_partkey") * 3).cast("int"), underline=F.when(F.col("p_partkey") % 2 == 0, "double").otherwise("zigzag"))
    return out.select("p_partkey", "size", "underline", F.array_join("violations", ",").alias("violations"))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.document_violations(_t(spark, sf_dir, "documents"))


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.first_wins(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


QUERIES = {
    "docx_roundtrip_text": roundtrip_text, "docx_roundtrip_paragraphs": paragraph_roundtrip, "docx_roundtrip_tables": table_roundtrip, "opc_parts": opc_parts, "docx_roundtrip_properties": properties_roundtrip, "image_dims": image_dims, "paragraph_blocks": paragraph_blocks,
    "doc_counts": doc_counts, "first_n_paragraphs": first_n_paragraphs, "find_replace_runs": find_replace_runs, "heading_bookmarks": heading_bookmarks, "section_ordinal": section_ordinal,
    "run_concat": run_concat, "table_dims": table_dims, "table_cell_at": table_cell_at, "row_insert_delete": row_insert_delete, "merge_region": merge_region, "merge_overlap": merge_overlap,
    "rel_resolve": rel_resolve, "content_type_lookup": content_type_lookup, "missing_targets": missing_targets, "hex_encode": hex_encode, "hex_decode": hex_decode, "unit_convert": unit_convert,
    "part_name_norm": part_name_norm, "field_classify": field_classify, "hyperlink_extract": hyperlink_extract,
    "merge_accepted": merge_accepted, "field_roundtrip": field_roundtrip, "break_kinds": break_kinds, "hyperlink_roundtrip": hyperlink_roundtrip, "corrupt_packages": corrupt_packages,
    "formatting_roundtrip": formatting_roundtrip, "section_roundtrip": section_roundtrip, "docx_files": docx_files, "relationship_edits": relationship_edits,
    "border_roundtrip": border_roundtrip, "template_documents": template_documents, "template_violations": template_violations, "theme_palette": theme_palette,
    "atoi_validate": atoi_validate, "edit_violations": edit_violations, "violations": violations, "dedupe_first": dedupe_first,
}

_LINES = "SELECT doc_id, i - 1 AS block_idx, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_REGIONS = "SELECT n_regionkey AS table_id, n_nationkey AS region_id, n_nationkey % 3 AS r0, (n_nationkey // 3) % 3 AS c0, n_nationkey % 2 + 1 AS rows, (n_nationkey // 2) % 3 + 1 AS cols FROM nation"
_PAD = "lpad(upper(to_hex(p_partkey % {})), 2, '0')"
_COLOR = "concat(" + ", ".join(_PAD.format(m) for m in (256, 251, 241)) + ")"
_PATH = r"lower(regexp_replace(replace('./' || replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/', '\'), '\', '/'), '^(\./|/)+', ''))"

SQL = {
    "docx_roundtrip_text": r"SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\t-\r\x{85}\p{Z}]')), '') AS text FROM documents",
    "docx_roundtrip_paragraphs": rf"SELECT doc_id, count(*) AS n_paragraphs, sum(CASE WHEN regexp_matches(text, '[^\t-\r\x{{85}}\p{{Z}}]') THEN length(text) ELSE 0 END)::BIGINT AS n_chars FROM ({_LINES}) GROUP BY doc_id",
    "docx_roundtrip_tables": "SELECT n_regionkey AS region, (k // 2)::INTEGER AS row_idx, (k % 2)::INTEGER AS col_idx, n_name AS text, n_nationkey::BIGINT * 10 AS width, CASE WHEN n_nationkey % 2 = 0 THEN 'center' END AS v_align, CASE WHEN n_nationkey % 3 = 0 THEN 'D9D9D9' END AS shading FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation)",
    "opc_parts": """SELECT doc_id::VARCHAR AS doc_id, part_key, kind, content_type FROM documents, (VALUES
('[content_types].xml', 'content_types', 'application/xml'), ('_rels/.rels', 'rels', 'application/vnd.openxmlformats-package.relationships+xml'),
('word/_rels/document.xml.rels', 'document_rels', 'application/vnd.openxmlformats-package.relationships+xml'),
('word/document.xml', 'document', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml'),
('word/styles.xml', 'styles', 'application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml'),
('word/fonttable.xml', 'font_table', 'application/vnd.openxmlformats-officedocument.wordprocessingml.fontTable+xml'),
('word/theme/theme1.xml', 'theme', 'application/vnd.openxmlformats-officedocument.theme+xml'),
('word/settings.xml', 'settings', 'application/vnd.openxmlformats-officedocument.wordprocessingml.settings+xml'),
('word/websettings.xml', 'web_settings', 'application/vnd.openxmlformats-officedocument.wordprocessingml.webSettings+xml'),
('docprops/core.xml', 'core_properties', 'application/vnd.openxmlformats-package.core-properties+xml'),
('docprops/app.xml', 'app_properties', 'application/vnd.openxmlformats-officedocument.extended-properties+xml')) p(part_key, kind, content_type)""",
    "docx_roundtrip_properties": "SELECT doc_id, nullif(source, '') AS title, nullif(lang, '') AS creator FROM documents",
    "image_dims": "SELECT p_partkey, p_size AS width_px, p_partkey::INTEGER AS height_px, p_size::BIGINT * 9525 AS width_emu, p_partkey * 9525 AS height_emu FROM part",
    "paragraph_blocks": _LINES,
    "doc_counts": f"SELECT doc_id, count(*) AS n_paragraphs, sum(length(text))::BIGINT AS n_chars FROM ({_LINES}) GROUP BY doc_id",
    "first_n_paragraphs": f"SELECT doc_id, block_idx, substr(text, 1, 60) AS text FROM ({_LINES}) WHERE block_idx < 3",
    "find_replace_runs": "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'reader' ELSE role END AS role FROM conversations",
    "heading_bookmarks": "SELECT conv_id, turn, n AS bookmark_id, '_Toc' || n AS bookmark_name FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations WHERE role = 'user')",
    "section_ordinal": "SELECT conv_id, turn, coalesce(sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS section_idx FROM conversations",
    "run_concat": "SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "table_dims": "SELECT n_regionkey AS table_id, (count(*) + 1) // 2 AS n_rows, least(count(*), 2) AS n_cols FROM nation GROUP BY n_regionkey",
    "table_cell_at": "SELECT n_regionkey AS table_id, n_name AS text FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation) WHERE k = 2",
    "row_insert_delete": """WITH c AS (SELECT n_regionkey AS t, k AS i, n_name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation)), s AS (SELECT t, count(*) AS n FROM c GROUP BY t),
i AS (SELECT c.t, CASE WHEN 3 * c.t <= n AND i >= 3 * c.t THEN i + 1 ELSE i END AS i, n_name FROM c JOIN s ON c.t = s.t UNION ALL SELECT t, 3 * t, NULL FROM s WHERE 3 * t <= n), m AS (SELECT t, max(i) + 1 AS n FROM i GROUP BY t)
SELECT i.t AS table_id, (CASE WHEN i.t < n AND i.i > i.t THEN i.i - 1 ELSE i.i END)::BIGINT AS row_idx, n_name AS text FROM i JOIN m ON i.t = m.t WHERE NOT (i.t < n AND i.i = i.t)""",
    "merge_region": f"""WITH g AS (SELECT r_regionkey AS table_id, a.i AS row_idx, b.i AS col_idx FROM region, (SELECT unnest([0, 1, 2, 3]) AS i) a, (SELECT unnest([0, 1, 2, 3]) AS i) b),
m AS (SELECT * FROM ({_REGIONS}) QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY region_id) = 1)
SELECT g.table_id, row_idx, col_idx, (CASE WHEN r0 IS NOT NULL AND col_idx = c0 THEN cols ELSE 1 END)::INTEGER AS grid_span,
CASE WHEN r0 IS NULL OR rows = 1 OR col_idx <> c0 THEN 'none' WHEN row_idx = r0 THEN 'restart' ELSE 'continue' END AS v_merge, coalesce(r0 IS NOT NULL AND col_idx <> c0, false) AS h_merge_continuation
FROM g LEFT JOIN m ON g.table_id = m.table_id AND row_idx BETWEEN r0 AND r0 + rows - 1 AND col_idx BETWEEN c0 AND c0 + cols - 1""",
    "merge_overlap": f"""WITH r AS ({_REGIONS}) SELECT a.table_id, a.region_id, a.r0 + a.rows > 4 OR a.c0 + a.cols > 4 AS out_of_bounds, count(b.region_id) AS overlaps
FROM r a LEFT JOIN r b ON a.table_id = b.table_id AND b.region_id < a.region_id AND a.r0 < b.r0 + b.rows AND b.r0 < a.r0 + a.rows AND a.c0 < b.c0 + b.cols AND b.c0 < a.c0 + a.cols GROUP BY ALL""",
    "rel_resolve": "SELECT n_name, rel_id, r_name AS target FROM (SELECT n_name, CASE WHEN n_nationkey < 20 THEN n_regionkey ELSE n_regionkey + 100 END AS rel_id FROM nation) LEFT JOIN region ON rel_id = r_regionkey",
    "content_type_lookup": r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS n FROM pages), o AS (SELECT n FROM p WHERE page_id = 0)
SELECT page_id, CASE WHEN n IN (SELECT n FROM o) THEN 'text/override' WHEN lower(regexp_extract(n, '\.([^./]*)$', 1)) = 'html' THEN 'text/html' WHEN lower(regexp_extract(n, '\.([^./]*)$', 1)) = 'xml' THEN 'application/xml' ELSE '' END AS content_type FROM p""",
    "missing_targets": "SELECT s_suppkey, 'rId6' AS rel_id, s_name AS description FROM supplier WHERE s_suppkey % 3 = 0",
    "hex_encode": f"SELECT p_partkey, {_COLOR} AS color FROM part",
    "hex_decode": f"""WITH c AS (SELECT p_partkey, {_COLOR} AS color FROM part), x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN color WHEN 1 THEN color[1] || color[1] || color[2] || color[2] || color[3] || color[3] END AS h FROM c)
SELECT p_partkey, ('0x' || h[1:2])::INTEGER AS r, ('0x' || h[3:4])::INTEGER AS g, ('0x' || h[5:6])::INTEGER AS b FROM x""",
    "unit_convert": "SELECT p_partkey, p_size::BIGINT * 9525 AS emu, trunc(p_size / 7.0::DOUBLE * 96)::INTEGER AS px_in, trunc(p_size / 7.0::DOUBLE * 914400)::BIGINT AS emu_in, (p_partkey * 1000 + 4762) // 9525 AS px_back FROM part",
    "part_name_norm": f"SELECT page_id, {_PATH} AS part_key FROM pages",
    "field_classify": "SELECT event_id, CASE " + " ".join(f"WHEN starts_with(u, '{p}') THEN '{p}'" for p in ("PAGE", "NUMPAGES", "TOC", "DATE", "TIME", "STYLEREF", "SEQ", "REF", "HYPERLINK")) + " ELSE 'CUSTOM' END AS field_type FROM (SELECT event_id, upper(trim(CASE WHEN event_id % 2 = 0 THEN 'page' ELSE 'ref ' END || event_type)) AS u FROM events)",
    "hyperlink_extract": """SELECT page_id, regexp_extract(html, 'href="([^"]*)"', 1) AS href FROM pages""",
    "merge_accepted": f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY region_id) AS k FROM ({_REGIONS}) WHERE r0 + rows <= 4 AND c0 + cols <= 4),
f AS (SELECT table_id, k, [region_id] AS ids FROM r WHERE k = 1 UNION ALL
SELECT r.table_id, r.k, CASE WHEN EXISTS (SELECT 1 FROM r o WHERE o.table_id = r.table_id AND list_contains(f.ids, o.region_id) AND r.r0 < o.r0 + o.rows AND o.r0 < r.r0 + r.rows AND r.c0 < o.c0 + o.cols AND o.c0 < r.c0 + r.cols) THEN f.ids ELSE list_append(f.ids, r.region_id) END
FROM f JOIN r ON r.table_id = f.table_id AND r.k = f.k + 1)
SELECT table_id, unnest(ids) AS region_id FROM f QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY k DESC) = 1""",
    "field_roundtrip": "SELECT c_custkey, 'SEQ ' || c_mktsegment AS code, c_name AS result, c_custkey % 2 = 0 AS dirty FROM customer",
    "break_kinds": "SELECT c_custkey, c_name AS text, ['page', 'page,column', 'page,column,line'][(c_custkey % 3 + 1)::INTEGER] AS breaks FROM customer",
    "hyperlink_roundtrip": "SELECT page_id, 'page' AS text, url FROM pages WHERE url <> ''",
    "corrupt_packages": "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'IO_ERROR' ELSE 'INVALID_STATE' END AS code, 'open' AS op, CASE WHEN doc_id % 4 = 3 THEN '[content_types].xml' END AS part FROM documents WHERE doc_id % 4 <> 0",
    "formatting_roundtrip": """SELECT p_partkey, p_name AS text, p_partkey % 2 = 0 AS bold, p_partkey % 3 = 0 AS italic, p_partkey % 5 = 0 AS strike, [NULL, 'single', 'double'][(p_partkey % 3 + 1)::INTEGER] AS underline, ['green', NULL][(p_partkey % 2 + 1)::INTEGER] AS highlight, lpad(upper(to_hex(p_partkey)), 6, '0') AS color, p_partkey % 40 + 24 AS size,
['Arial', 'Times New Roman'][(p_partkey % 2 + 1)::INTEGER] AS font, 'SimSun' AS font_east_asia, ['Arial', NULL][(p_partkey % 2 + 1)::INTEGER] AS font_cs, ['Heading1', NULL][(p_partkey % 2 + 1)::INTEGER] AS style_id, [NULL, 'center', 'right'][(p_partkey % 3 + 1)::INTEGER] AS alignment, nullif(p_partkey % 360, 0) AS spacing_before, 120::BIGINT AS spacing_after, 480::BIGINT AS line_value, 'exact' AS line_rule,
nullif(p_partkey % 720, 0) AS indent_left, 360::BIGINT AS indent_right, CASE WHEN p_partkey % 2 = 0 THEN 240::BIGINT END AS first_line, CASE WHEN p_partkey % 2 = 1 THEN 200::BIGINT END AS hanging, CASE WHEN p_partkey % 4 = 0 THEN 1::BIGINT END AS num_id, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 9 END AS num_level FROM part""",
    "section_roundtrip": """SELECT s_suppkey, 0 AS section_idx, 16838::BIGINT AS width, 'landscape' AS orientation, 2 AS columns, 'evenPage' AS break_type, (s_suppkey % 900 + 1)::BIGINT AS margin_right FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END, 11906, 'portrait', CASE WHEN s_suppkey % 3 <> 0 THEN 3 ELSE 1 END, NULL, 1440 FROM supplier""",
    "border_roundtrip": """WITH p AS (SELECT p_partkey, ['single', 'dotted', 'double', 'none'][(p_partkey % 4 + 1)::INTEGER] AS line, p_partkey % 24 + 1 AS size, lpad(upper(to_hex(p_partkey)), 6, '0') AS color FROM part),
b AS (SELECT p_partkey, 'paragraph' AS place, 'top' AS side, line AS style, size, color FROM p UNION ALL SELECT p_partkey, 'cell', 'bottom', line, size, color FROM p
UNION ALL SELECT p_partkey, place, 'left', 'thick', 8, 'auto' FROM part, (VALUES ('paragraph'), ('cell')) v(place) WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'paragraph', 'right', 'dashed', 2, 'FF0000' FROM part)
SELECT * FROM b WHERE style <> 'none'""",
    "template_documents": """SELECT c_custkey, 0 AS "at", 'p' AS kind, 'Heading1' AS style, c_name AS text, NULL::BIGINT AS size, false AS italic, NULL::BIGINT AS spacing_before FROM customer
UNION ALL SELECT c_custkey, 1, 'p', NULL, 'Segment ' || c_mktsegment, CASE WHEN c_custkey BETWEEN 2 AND 3276 AND c_custkey <> 22 THEN c_custkey END, c_custkey % 2 = 0, CASE WHEN c_custkey * 300 BETWEEN 1 AND 31680 THEN c_custkey * 300 END FROM customer
UNION ALL SELECT c_custkey, i, 'tc', NULL, CASE i WHEN 0 THEN 'key' WHEN 1 THEN c_custkey::VARCHAR WHEN 2 THEN 'nation' ELSE c_nationkey::VARCHAR END, NULL, NULL, NULL FROM customer, (VALUES (0), (1), (2), (3)) v(i)
UNION ALL SELECT c_custkey, 0, 'sect', 'landscape', CASE WHEN c_custkey % 12 BETWEEN 1 AND 10 THEN c_custkey % 12 ELSE 1 END::VARCHAR, NULL, NULL, NULL FROM customer
UNION ALL SELECT c_custkey, 1, 'sect', 'portrait', '1', NULL, NULL, NULL FROM customer""",
    "template_violations": """SELECT c_custkey, 'runs' AS kind, 'size' AS violation FROM customer WHERE c_custkey NOT BETWEEN 2 AND 3276
UNION ALL SELECT c_custkey, 'paragraphs', 'spacing_before' FROM customer WHERE c_custkey * 300 > 31680 UNION ALL SELECT c_custkey, 'sections', 'columns' FROM customer WHERE c_custkey % 12 IN (0, 11)""",
    "theme_palette": """SELECT event_id, c[k + 1] AS color, CASE WHEN r = 4 AND k < 3 THEN ['Courier New', 'Courier New', 'Fira Code'][k + 1] END AS font, CASE WHEN r = 5 AND k < 3 THEN [18, 20, 18][k + 1] ELSE 22 END AS size
FROM (SELECT event_id, (event_id % 4)::INTEGER AS k, (event_id % 7)::INTEGER AS r FROM events) JOIN (VALUES (0, ['D9D9D9', 'C0C0C0', '2D2D2D', NULL]), (1, ['00B050', '008000', '49CC90', NULL]), (2, ['FFC000', 'FFA500', 'FFCB6B', NULL]),
(3, ['C00000', '8B0000', 'FF5555', NULL]), (4, [NULL, NULL, NULL, NULL]), (5, [NULL, NULL, NULL, NULL]), (6, ['2F5496', '000000', '4FC0FF', NULL])) v(role, c) ON r = role""",
    "docx_files": "SELECT c_custkey, c_name AS text FROM customer",
    "relationship_edits": """WITH n AS (SELECT n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, n_name FROM nation),
a AS (SELECT r, k, 'image' AS rel_type, n_name AS target, '' AS target_mode FROM n UNION ALL
SELECT r_regionkey, (SELECT count(*) FROM n WHERE r = r_regionkey) + i, 'hyperlink', CASE i WHEN 1 THEN r_name ELSE lower(r_name) END, 'External' FROM region, (VALUES (1), (2)) v(i))
SELECT r::VARCHAR AS doc_id, 'rId' || k AS rel_id, rel_type, target, target_mode FROM a WHERE k <> r + 1""",
    "atoi_validate": "SELECT p_partkey, CASE WHEN regexp_full_match(t, '[+-]?[0-9]{1,18}') THEN try_cast(t AS BIGINT) END AS value FROM (SELECT p_partkey, [' ', 'x', '-', '+', ''][(p_partkey % 5 + 1)::INTEGER] || p_size AS t FROM part)",
    "edit_violations": "SELECT p_partkey, CASE WHEN p_partkey * 3 BETWEEN 2 AND 3276 THEN p_partkey * 3 ELSE 22 END::INTEGER AS size, CASE WHEN p_partkey % 2 = 0 THEN 'double' ELSE 'none' END AS underline, array_to_string(list_filter([CASE WHEN p_partkey * 3 NOT BETWEEN 2 AND 3276 THEN 'size' END, CASE WHEN p_partkey % 2 <> 0 THEN 'underline' END], lambda x: x IS NOT NULL), ',') AS violations FROM part",
    "violations": "SELECT * FROM (SELECT doc_id, array_to_string(list_filter([CASE WHEN length(coalesce(text, '')) = 0 THEN 'empty' END, CASE WHEN length(text) > 20000 THEN 'chars' END, CASE WHEN len(string_split(text, chr(10))) > 100 THEN 'blocks' END], lambda x: x IS NOT NULL), ',') AS violations FROM documents) WHERE violations <> ''",
    "dedupe_first": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
}
