import io
import struct
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkshred import ooxml
from inkshred.builder import DocumentBuilder
from inkshred.functions import scalars
from inkshred.operators import edits, structure, styles
from inkshred.plans import model
from inkshred.sinks import docx as sink
from inkshred.sources import docx as source
from inkshred.sources import store
from inkshred.streaming import documents as streaming

BODY = f'<w:document xmlns:w="{ooxml.W}" xmlns:r="{ooxml.R}"><w:body>%s</w:body></w:document>'
RELS = f'<Relationships xmlns="{ooxml.PACKAGE_RELS}">%s</Relationships>'
TYPES = f'<Types xmlns="{ooxml.CONTENT_TYPES}"><Default Extension="xml" ContentType="application/xml"/></Types>'


def package(body, rels="", **more):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("[Content_Types].xml", TYPES)
        z.writestr("word/document.xml", BODY % body)
        z.writestr("word/_rels/document.xml.rels", RELS % rels)
        for name, data in more.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), data)
    return held.getvalue()


def opened(spark, *contents):
    docs = spark.createDataFrame([(str(i), bytearray(c) if c is not None else None) for i, c in enumerate(contents)], "doc_id string, content binary")
    parts = source.parts(docs)
    nodes = source.nodes(parts).cache()
    return parts, nodes, model.runs(nodes)


def one(df):
    return [r.asDict() for r in df.collect()]


def test_text_tabs_breaks_and_formatting(spark):
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/><w:jc w:val="center"/><w:spacing w:before="360" w:after="120" w:line="480" w:lineRule="exact"/><w:ind w:left="720" w:firstLine="240"/><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:rPr><w:b/><w:i w:val="0"/><w:u w:val="Double"/><w:color w:val="123456"/><w:sz w:val="48"/><w:rFonts w:ascii="Arial"/></w:rPr><w:t>Intro</w:t><w:tab/><w:t xml:space="preserve"> Tab</w:t><w:br w:type="page"/></w:r></w:p>'
    _, nodes, runs = opened(spark, package(body))
    (r,) = one(runs)
    assert (r["text"], r["breaks"], r["bold"], r["italic"], r["underline"], r["color"], r["size"], r["font"]) == ("Intro\t Tab", ["page"], True, False, "double", "123456", 48, "Arial")
    (p,) = one(model.paragraphs(nodes, runs))
    assert (p["text"], p["style_id"], p["alignment"], p["spacing_before"], p["line_rule"], p["indent_left"], p["first_line"], p["num_id"], p["num_level"]) == ("Intro\t Tab", "Heading1", "center", 360, "exact", 720, 240, 1, 0)


def test_white_space_runs_vanish_and_wrappers_are_not_read(spark):
    body = '<w:p><w:r><w:t xml:space="preserve"> </w:t></w:r><w:r><w:t>a</w:t></w:r><w:ins><w:r><w:t>gone</w:t></w:r></w:ins></w:p><w:sdt><w:p><w:r><w:t>gone</w:t></w:r></w:p></w:sdt>'
    _, nodes, runs = opened(spark, package(body))
    assert [p["text"] for p in one(model.paragraphs(nodes, runs))] == ["a"]


def test_blocks_tables_nested_cells_and_merges(spark):
    cell = '<w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>%s</w:t></w:r></w:p>%s</w:tc>'
    inner = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>deep</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    body = f"<w:p/><w:tbl><w:tr>{cell % ('a', inner)}{cell % ('b', '')}</w:tr><w:tr>{cell % ('c', '')}</w:tr></w:tbl><w:p/>"
    _, nodes, runs = opened(spark, package(body))
    assert [r.kind for r in model.blocks(nodes).orderBy("block_idx").collect()] == ["p", "tbl", "p"]
    assert [(t["n_rows"], t["n_cols"]) for t in one(model.tables(nodes))] == [(2, 2)]
    cells = {(c["text"]): c for c in one(model.table_cells(nodes, model.paragraphs(nodes, runs)))}
    assert {k: (c["row_idx"], c["col_idx"], c["grid_span"], c["v_merge"]) for k, c in cells.items()} == {"a": (0, 0, 2, "restart"), "b": (0, 1, 2, "restart"), "c": (1, 0, 2, "restart"), "deep": (0, 0, 1, "none")}
    assert cells["deep"]["parent_cell"] == cells["a"]["cell"] and cells["a"]["parent_cell"] is None


def test_fields_and_hyperlinks(spark):
    rel = f'<Relationship Id="rId9" Type="{ooxml.R}/hyperlink" Target="https://example.com" TargetMode="External"/>'
    body = '<w:p><w:hyperlink r:id="rId9"><w:r><w:t>x</w:t></w:r></w:hyperlink><w:hyperlink w:anchor="top"><w:r><w:t>y</w:t></w:r></w:hyperlink><w:fldSimple w:instr=" PAGE "><w:r><w:t>1</w:t></w:r></w:fldSimple><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>PAGE</w:instrText></w:r><w:r><w:instrText>REF x</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>2</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>'
    _, nodes, runs = opened(spark, package(body, rel))
    assert sorted((h["text"], h["url"]) for h in one(model.hyperlinks(nodes, runs))) == [("x", "https://example.com"), ("y", "#top")]
    assert sorted(f["code"] for f in one(model.fields(nodes, runs))) == ["PAGE", "PAGEREF x"]
    kinds = spark.createDataFrame([(x,) for x in ("PAGEREF x", "toc \\o", " NUMPAGES", "FOO", "hyperlink \\l \"a\"")], "i string").select(scalars.field_type(F.col("i")).alias("k"), scalars.hyperlink_url(F.col("i")).alias("u"))
    assert [(r.k, r.u) for r in kinds.collect()] == [("PAGE", None), ("TOC", None), ("NUMPAGES", None), ("CUSTOM", None), ("HYPERLINK", "#a")]


def test_sections(spark):
    body = '<w:p><w:pPr><w:sectPr><w:type w:val="evenPage"/><w:pgSz w:w="16838" w:h="11906" w:orient="landscape"/><w:pgMar w:top="720" w:right="900" w:bottom="720" w:left="1440" w:header="480" w:footer="600"/><w:cols w:num="2"/></w:sectPr></w:pPr></w:p><w:sectPr><w:cols w:num="3"/></w:sectPr>'
    _, nodes, _ = opened(spark, package(body))
    got = [(s["section_idx"], s["width"], s["orientation"], s["columns"], s["break_type"], s["margin_right"]) for s in one(model.sections(nodes).orderBy("section_idx"))]
    assert got == [(0, 16838, "landscape", 2, "evenPage", 900), (1, None, "portrait", 3, None, None)]


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 4, 6) + b"\x08\x06\x00\x00\x00"
    gif, jpeg = b"GIF89a" + struct.pack("<HH", 7, 9), b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x11\x08" + struct.pack(">HH", 5, 3) + b"\x00" * 9
    assert [source.image_size(x) for x in (png, gif, jpeg, b"BM", b"")] == [(4, 6), (7, 9), (3, 5), None, None]
    rel = f'<Relationship Id="rId7" Type="{ooxml.R}/image" Target="media/image1.png"/>'
    body = '<w:p><w:r><w:drawing><wp:inline xmlns:wp="wp"><wp:extent cx="38100" cy="57150"/><wp:docPr descr="Sample image"/><a:blip xmlns:a="a" r:embed="rId7"/></wp:inline></w:drawing></w:r></w:p>'
    parts, nodes, _ = opened(spark, package(body, rel, word__media__image1_DOT_png=png))
    dims = source.image_dims(parts.filter("kind = 'media'"))
    (i,) = one(model.images(nodes, dims))
    assert (i["width_px"], i["height_px"], i["cx"], i["description"], i["position"]) == (4, 6, 38100, "Sample image", "inline")


def test_unreadable_documents_are_rows(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "x")
    parts, nodes, _ = opened(spark, b"no archive", None, held.getvalue(), package("<w:p>"), package("").replace(b"x", b"x"), package("<w:p/>"))
    codes = {(e["doc_id"], e["code"]) for e in one(source.errors(parts, nodes))}
    assert codes == {("0", "INVALID_STATE"), ("1", "INVALID_STATE"), ("2", "INVALID_STATE"), ("3", "XML_ERROR")}
    with pytest.raises(ValueError):
        source.flatten(b'<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>')


def test_written_packages_hold_the_required_parts(spark):
    built, error = DocumentBuilder("d", {}).paragraph("Heading1").text("a<&>\"b\nc").bold().font_size(24).alignment("center").end().table([["1", "2"], ["3", "4"]]).build(spark)
    assert error is None
    xml = sink.paragraph_xml(built["runs"], built["paragraphs"]).unionByName(sink.table_xml(built["cells"]))
    meta = spark.createDataFrame([("d", "T & t", ["x", "y"])], "doc_id string, title string, keywords array<string>")
    content = sink.assemble(sink.document_xml(xml), meta).first().content
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        assert set(z.namelist()) == {"[Content_Types].xml", "_rels/.rels", "word/document.xml", "word/_rels/document.xml.rels", "docProps/core.xml", "docProps/app.xml", "word/styles.xml", "word/fontTable.xml", "word/theme/theme1.xml", "word/settings.xml", "word/webSettings.xml"}
        assert b"T &amp; t" in z.read("docProps/core.xml") and b"x, y" in z.read("docProps/core.xml")
        assert z.read("word/_rels/document.xml.rels").count(b"<Relationship ") == 5
    _, nodes, runs = opened(spark, content)
    p = model.paragraphs(nodes, runs).filter("container = 'body'").first()
    assert (p.text, p.style_id, p.alignment, p.n_runs) == ('a<&>"bc', "Heading1", "center", 3)
    assert [(r.bold, r.size) for r in runs.filter("text != ''").orderBy("run").limit(1).collect()] == [(True, 48)]
    assert [(t["n_rows"], t["n_cols"]) for t in one(model.tables(nodes))] == [(2, 2)]


def test_builder_errors_stick(spark):
    b = DocumentBuilder("d")
    b.paragraph().bold().text("x").font_size(9999)
    rows, error = b.build(spark)
    assert error == "bold before any text" and rows["runs"].count() == 0
    assert DocumentBuilder("e").build(spark)[1] == "an empty document"
    assert DocumentBuilder("e").table([["x"] * 64]).build(spark)[1] == "a table of 1 x 64"


def test_edit_limits(spark):
    df = spark.createDataFrame([(s,) for s in (1, 2, 3276, 3277)], "new int").withColumn("size", F.lit(22))
    assert [(r["size"], r["violations"]) for r in one(edits.set_run(df, size=F.col("new")))] == [(22, ["size"]), (2, []), (3276, []), (22, ["size"])]
    p = edits.set_paragraph(spark.range(1).withColumn("hanging", F.lit(100)), first_line=F.lit(5), num_level=F.lit(9), alignment=F.lit("left")).first()
    assert sorted(p.violations) == ["first_line", "num_level"] and p.alignment == "left"
    dims = spark.createDataFrame([(0, 3), (3, 0), (1001, 3), (3, 64), (3, 3)], "n_rows int, n_cols int")
    assert [r.violations for r in edits.table_violations(dims).collect()] == [["rows"], ["cols"], ["rows"], ["cols"], []]


def test_merges(spark):
    grid = spark.range(16).selectExpr("1 as table_id", "cast(id div 4 as int) as row_idx", "cast(id % 4 as int) as col_idx")
    region = spark.createDataFrame([(1, 1, 0, 0, 2, 2)], "table_id int, region_id int, r0 int, c0 int, rows int, cols int")
    got = {(r.row_idx, r.col_idx): (r.grid_span, r.v_merge, r.h_merge_continuation) for r in edits.merge_cells(grid, region).collect()}
    assert [got[k] for k in ((0, 0), (1, 0), (0, 1), (1, 1), (2, 2))] == [(2, "restart", False), (2, "continue", False), (1, "none", True), (1, "none", True), (1, "none", False)]


def test_colours_and_units(spark):
    texts = ["000000", "#FF0000", "F00", "#888", "ff0000", "FF00", "GGGGGG", "", "FF0000FF"]
    got = [r.c and tuple(r.c) for r in spark.createDataFrame([(x,) for x in texts], "x string").select(scalars.from_hex(F.col("x")).alias("c")).collect()]
    assert got == [(0, 0, 0), (255, 0, 0), (255, 0, 0), (136, 136, 136), (255, 0, 0), None, None, None, None]
    r = spark.range(1).select(scalars.resized(F.lit(0), F.lit(50), F.lit(200), F.lit(100)).alias("a"), scalars.media_path(F.lit("..\\media\\X.PNG")).alias("b"), scalars.media_type(F.lit("a.JPG")).alias("c"), scalars.media_type(F.lit("a")).alias("d"), scalars.strict_int(F.lit(" 1")).alias("e")).first()
    assert (tuple(r.a), r.b, r.c, r.d, r.e) == ((100, 50), "word/media/x.png", "image/jpeg", "application/octet-stream", None)


def test_styles_and_fields(spark):
    base = styles.catalogue(spark)
    assert base.count() == 43 and base.filter("is_default").count() == 3
    added = spark.createDataFrame([("Mine",), ("Normal",), ("",), ("Subtle",)], "style_id string")
    assert styles.with_styles(base, added).count() == 44
    f = spark.range(1).select(styles.field_code(F.lit("SEQ")).alias("a"), styles.toc_code(F.lit("1-5"), F.lit(True)).alias("b"), styles.updated_result(F.lit("DATE"), F.lit(True), F.lit("old"), F.lit(None)).alias("c"), styles.updated_result(F.lit("DATE"), F.lit(False), F.lit("old"), F.lit(None)).alias("d")).first()
    assert tuple(f) == ("SEQ Figure", 'TOC \\\\o "1-5" \\\\h \\\\n \\\\z \\\\u', "1/1/2025", "old")


def test_relationship_ids(spark):
    rels = spark.createDataFrame([("d", "rId1", "t", "styles.xml"), ("d", "rId7", "t", "x.png"), ("d", "zzz", "t", "y")], "doc_id string, rel_id string, rel_type string, target string")
    assert structure.next_rel_id(rels).first().next_id == 8
    base = spark.createDataFrame([("styles", "styles.xml"), ("settings", "settings.xml"), ("theme", "theme/theme1.xml")], "rel_type string, target string")
    got = {r.target: r.rel_id for r in structure.with_base_rels(rels, rels.select("doc_id"), base).collect()}
    assert (got["styles.xml"], got["settings.xml"], got["theme/theme1.xml"]) == ("rId1", "rId8", "rId9")


def test_stream_of_packages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.docx").write_bytes(package(f"<w:p><w:r><w:t>doc {i}</w:t></w:r></w:p>"))
    stream = streaming.package_stream(spark, str(tmp_path / "in"), per_trigger=2)
    assert stream.isStreaming
    streaming.paragraph_sink(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["doc 0", "doc 1", "doc 2"]
    assert source.packages(spark, str(tmp_path / "in")).count() == 3


def test_headers_media_and_properties_survive_a_round_trip(spark):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 4, 6) + b"\x08\x06\x00\x00\x00"
    runs = spark.createDataFrame([("d", 0, 0, "Section 1 Header")], "doc_id string, block_idx int, run_idx int, text string")
    header = sink.header_xml(sink.paragraph_xml(runs)).select("doc_id", F.lit("rId6").alias("rel_id"), F.lit("header").alias("rel_kind"), F.lit("header1.xml").alias("target"), F.lit("x/header").alias("content_type"), "data")
    media = spark.createDataFrame([("d", "rId7", "image", "media/image1.png", "image/png", bytearray(png)), ("d", "rId8", "image", "media/none.png", "image/png", None)], header.schema)
    box = {"offset_x": F.lit(10), "offset_y": F.lit(-20), "behind": F.lit(True), "z_order": F.lit(3)}
    picture = lambda at: F.concat(F.lit("<w:p><w:r>"), sink.drawing(F.lit("rId7"), F.lit(1), F.lit(38100), F.lit(57150), F.lit('a "picture"'), at), F.lit("</w:r></w:p>"))
    body = spark.range(1).select(F.lit("d").alias("doc_id"), F.explode(F.array(F.struct(F.lit(0).alias("block_idx"), picture(None).alias("xml")), F.struct(F.lit(1).alias("block_idx"), picture(box).alias("xml")))).alias("b")).select("doc_id", "b.*")
    section = sink.section_xml(references=(("header", "default", "rId6"), ("header", "default", "rId9")), landscape=True, columns=2)
    meta = spark.createDataFrame([("d", "T", "me", ["a", "b"])], "doc_id string, title string, creator string, keywords array<string>")
    content = sink.assemble(sink.document_xml(body, section), meta, parts=header.union(media)).first().content
    parts, nodes, got_runs = opened(spark, content)
    (part,) = one(model.section_parts(nodes))
    assert (part["kind"], part["type"], part["part_key"]) == ("header", "default", "word/header1.xml")
    assert [p["text"] for p in one(model.paragraphs(nodes, got_runs).filter("container = 'header'"))] == ["Section 1 Header"]
    images = {i["position"]: i for i in one(model.images(nodes, source.image_dims(parts.filter("kind = 'media'"))))}
    assert {k: (i["width_px"], i["cx"], i["description"]) for k, i in images.items()} == {"inline": (4, 38100, 'a "picture"'), "floating": (4, 38100, 'a "picture"')}
    f = images["floating"]
    assert (f["offset_x"], f["offset_y"], f["behind_text"], f["z_order"], f["wrap"], images["inline"]["behind_text"]) == (10, -20, True, 3, "square", False)
    (props,) = one(model.core_properties(nodes))
    assert (props["title"], props["creator"], props["keywords"]) == ("T", "me", ["a", "b"])
    (s,) = one(model.sections(nodes))
    assert (s["width"], s["height"], s["orientation"], s["columns"]) == (16838, 11906, "landscape", 2)
    types = {t["part_key"]: t["content_type"] for t in one(model.content_types(nodes, parts))}
    assert types["word/header1.xml"] == "x/header" and types["word/media/image1.png"] == "image/png" and "word/media/none.png" not in types


def test_nested_and_packed_fields(spark):
    char = lambda kind, more="": f'<w:fldChar w:fldCharType="{kind}"{more}/>'
    instr = lambda text: f"<w:instrText>{text}</w:instrText>"
    packed = f"<w:p><w:r>{char('begin')}{instr('REF ')}{instr('bookmark')}{char('separate')}<w:t>see</w:t>{char('end')}</w:r></w:p>"
    nested = f"<w:p><w:r>{char('begin', ' w:dirty="1"')}{instr('IF ')}</w:r><w:r>{char('begin')}{instr('PAGE')}{char('separate')}<w:t>3</w:t>{char('end')}</w:r><w:r>{instr(' = 1')}{char('separate')}<w:t>yes</w:t>{char('end')}</w:r><w:r><w:t>after</w:t></w:r></w:p>"
    never = f"<w:p><w:r>{char('begin')}{instr('TIME')}{char('end')}</w:r><w:r>{char('end')}</w:r></w:p>"
    _, nodes, runs = opened(spark, package(packed + nested + never))
    got = sorted((f["code"], f["result"], f["dirty"]) for f in one(model.fields(nodes, runs)))
    assert got == [("IF  = 1", "yes", True), ("PAGE", "3", False), ("REF bookmark", "see", False)]


def test_break_kinds_and_several_drawings(spark):
    drawing = '<w:drawing><wp:inline xmlns:wp="wp"><wp:docPr descr="%s"/></wp:inline></w:drawing>'
    body = f'<w:p><w:r><w:br w:type="textWrapping"/><w:br w:type="Page"/><w:br w:type="odd"/><w:br/>{drawing % "a"}{drawing % "b"}</w:r></w:p>'
    _, nodes, runs = opened(spark, package(body))
    (r,) = one(runs)
    assert r["breaks"] == ["line", "page", "line", "line"] and len(r["drawings"]) == 2


def test_document_types_are_refused_in_any_encoding(spark):
    evil = '<?xml version="1.0" encoding="UTF-16"?><!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'
    for data in (evil.encode("utf-16"), b'<!DOCTYPE a><a/>'):
        with pytest.raises(ValueError):
            source.flatten(data)
    assert source.flatten(b"<a><![CDATA[<!DOCTYPE]]></a>")[0][7] == "<!DOCTYPE"
    assert source.flatten('<?xml version="1.0" encoding="UTF-16"?><a>\u00e9</a>'.encode("utf-16"))[0][7] == "\u00e9"


def test_a_damaged_member_costs_its_part(spark):
    whole = package("<w:p><w:r><w:t>here</w:t></w:r></w:p>", word__media__image1_DOT_png=b"x" * 5000)
    held = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(whole)) as old, zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name in old.namelist():
            z.writestr(name, old.read(name) if "media" not in name else bytes(range(256)) * 40)
    data = bytearray(held.getvalue())
    at = data.index(b"word/media/image1.png") + len("word/media/image1.png")
    data[at + 5 : at + 60] = b"\xff" * 55
    parts, nodes, runs = opened(spark, bytes(data))
    assert [(e["code"], e["part"]) for e in one(source.errors(parts, nodes))] == [("IO_ERROR", "word/media/image1.png")]
    assert [r["text"] for r in one(runs)] == ["here"]
    docs = spark.createDataFrame([("0", data)], "doc_id string, content binary")
    assert {p["kind"] for p in one(source.parts(docs, "document"))} == {"document"}
    assert [p["error_message"] for p in one(source.parts(docs, most_bytes=10))] == ["unpacks to too many bytes"]


def test_part_names_agree(spark):
    names = ["./word\\Document.xml", "/word/a", ".//./x", ".hidden/y", "../up"]
    got = [r.k for r in spark.createDataFrame([(n,) for n in names], "n string").select(scalars.part_name(F.col("n")).alias("k")).collect()]
    assert got == [source.key_of(n) for n in names] and got[3] == ".hidden/y"


def test_merges_refuse_overlap(spark):
    grid = spark.range(9).selectExpr("1 as table_id", "cast(id div 3 as int) as row_idx", "cast(id % 3 as int) as col_idx")
    regions = spark.createDataFrame([(1, 1, 0, 0, 2, 2), (1, 2, 1, 1, 2, 2), (1, 3, 2, 0, 1, 3), (1, 4, 2, 2, 2, 2)], "table_id int, region_id int, r0 int, c0 int, rows int, cols int")
    got = edits.merge_cells(grid, regions)
    assert got.count() == 9
    assert {(r.row_idx, r.col_idx) for r in got.filter("grid_span > 1").collect()} == {(0, 0), (1, 0), (2, 0)}


def test_row_edits_of_several_tables(spark):
    cells = spark.range(12).selectExpr("cast(id div 6 as int) as table_id", "cast(id % 6 div 2 as int) as row_idx", "cast(id % 2 as int) as col_idx", "cast(id as string) as text")
    at = spark.createDataFrame([(0, 1), (1, 4), (7, 0)], "table_id int, at int")
    got = {(r.table_id, r.row_idx, r.col_idx): r.text for r in edits.insert_row(cells, at).collect()}
    assert len(got) == 14 and got[(0, 1, 0)] is None and got[(0, 2, 0)] == "2" and got[(1, 1, 0)] == "8"
    assert {r.table_id: r.violations for r in edits.row_violations(cells, at, 1).collect()} == {0: [], 1: ["row"], 7: ["table"]}
    left = {(r.table_id, r.row_idx, r.col_idx): r.text for r in edits.delete_row(cells, at).collect()}
    assert len(left) == 10 and left[(0, 1, 0)] == "4" and (0, 2, 0) not in left


def test_relationships_and_media_edits(spark):
    rels = spark.createDataFrame([("d", "rId3", "image", "a.png", ""), ("d", "own", "image", "b.png", "")], "doc_id string, rel_id string, rel_type string, target string, target_mode string")
    added = spark.createDataFrame([("d", "hyperlink", "http://x", "External"), ("e", "header", "header1.xml", "Internal"), ("d", "", "y", None)], "doc_id string, rel_type string, target string, target_mode string")
    got = {(r.doc_id, r.rel_id): (r.target, r.target_mode) for r in structure.add_relationships(rels, added).collect()}
    assert got[("d", "rId4")] == ("http://x", "External") and got[("e", "rId1")] == ("header1.xml", "") and len(got) == 4
    more = structure.register_relationships(rels, spark.createDataFrame([("d", "rId3", "t", "taken", ""), ("d", "rId9", "t", "new", "internal")], rels.schema))
    assert {r.rel_id: r.target for r in more.collect()} == {"rId3": "a.png", "own": "b.png", "rId9": "new"}
    asked = spark.createDataFrame([("d", "own"), ("d", "nobody")], "doc_id string, rel_id string")
    assert structure.remove(rels, asked).count() == 1 and [r.rel_id for r in structure.not_found(rels, asked).collect()] == ["nobody"]
    media = spark.createDataFrame([("d", "img1", "media/image1.png", "image/png", bytearray(b"a"))], "doc_id string, media_id string, target string, content_type string, data binary")
    new = structure.add_media(media, spark.createDataFrame([("d", 1, "x.JPG", bytearray(b"b")), ("e", 0, "y.gif", bytearray(b"c"))], "doc_id string, place int, name string, data binary"))
    assert sorted((r.doc_id, r.media_id, r.target, r.content_type) for r in new.collect()) == [("d", "img1", "media/image1.png", "image/png"), ("d", "img2", "media/image2.jpg", "image/jpeg"), ("e", "img1", "media/image1.gif", "image/gif")]


def test_custom_styles_defaults_and_lookups(spark):
    base = styles.catalogue(spark)
    mine = spark.createDataFrame([styles.paragraph_style("Mine", "My own", size=30, bold=True)], "style_id string, name string, type string, based_on string, is_default boolean, is_custom boolean, size int, bold boolean")
    every = styles.with_styles(base, mine)
    gone = spark.createDataFrame([("Mine",), ("Title",)], "style_id string")
    assert {r.style_id for r in every.collect()} - {r.style_id for r in styles.without_styles(every, gone, base).collect()} == {"Mine"}
    assert [r.style_id for r in styles.with_default(every, "Mine").filter("is_default and type = 'paragraph'").collect()] == ["Mine"]
    p = spark.createDataFrame([("Mine",), (None,), ("Nobody",)], "style_id string")
    assert {r.style_id: r.style and r.style.name for r in model.paragraph_styles(p, every).collect()} == {"Mine": "My own", None: "Normal", "Nobody": None}
    sheet = sink.style_sheets(every.fillna(False, ["is_custom"])).first().styles_xml
    assert '<w:style w:type="paragraph" w:customStyle="1" w:styleId="Mine"><w:name w:val="My own"/><w:basedOn w:val="Normal"/><w:rPr><w:b/><w:sz w:val="30"/>' in sheet
    f = spark.range(1).select(styles.field(F.lit("HYPERLINK"), F.lit("http://x"), F.lit("X")).alias("a"), styles.field(F.lit("PAGE")).alias("b"), styles.field(F.lit("SEQ"), F.lit("Table")).alias("c")).first()
    assert (f.a.code, f.a.result, f.b.code, f.b.result, f.c.code) == ('HYPERLINK "http://x"', "X", "PAGE", "1", "SEQ Table")
    q = spark.createDataFrame([(x,) for x in ("#F00", "abcdef", "abcd", None)], "c string").select(scalars.is_color(F.col("c")).alias("k"), scalars.default_position().alias("p")).collect()
    assert [r.k for r in q] == [True, True, False, False] and q[0].p.wrap == "square"


def test_packages_are_rewritten_around_what_is_kept(spark):
    old = package("<w:p/>", customXml__item1_DOT_xml=b"<kept/>")
    docs = spark.createDataFrame([("a", bytearray(old)), ("b", bytearray(b"no archive")), ("c", bytearray(old))], "doc_id string, content binary")
    new = spark.createDataFrame([("a", "/word/Document.xml", bytearray(b"<new/>")), ("a", "word/more.xml", bytearray(b"<more/>")), ("b", "x", bytearray(b"y"))], "doc_id string, part_name string, data binary")
    got = {r.doc_id: bytes(r.content) for r in sink.rewrite(docs, new).collect()}
    assert got["b"] == b"no archive" and got["c"] == old
    with zipfile.ZipFile(io.BytesIO(got["a"])) as z:
        assert z.namelist() == ["[Content_Types].xml", "word/document.xml", "word/_rels/document.xml.rels", "customXml/item1.xml", "word/more.xml"]
        assert z.read("word/document.xml") == b"<new/>" and z.read("customXml/item1.xml") == b"<kept/>"


def test_files_backgrounds_bookmarks_and_times(spark, tmp_path):
    runs = spark.createDataFrame([("a/1", 0, 0, "x"), ("b", 0, 0, "y")], "doc_id string, block_idx int, run_idx int, text string")
    about = spark.createDataFrame([("a/1", 0, 0, "_Toc0"), ("b", 0, None, None)], "doc_id string, block_idx int, bookmark_id int, bookmark_name string")
    back = spark.createDataFrame([("b", "00ff00")], "doc_id string, color string")
    meta = spark.createDataFrame([("a/1", "2024-01-02T03:04:05Z")], "doc_id string, created string")
    content = sink.assemble(sink.document_xml(sink.paragraph_xml(runs, about), backgrounds=back), meta)
    where = "file://" + str(tmp_path / "out")
    for _ in range(2):  # a second run replaces the files
        files = sink.write_files(content, where)
    assert sorted(r.file for r in files.collect()) == ["a%2F1.docx", "b.docx"] and sorted(p.name for p in (tmp_path / "out").glob("*.docx")) == ["a%2F1.docx", "b.docx"]
    read = source.packages(spark, where)
    nodes = source.nodes(source.parts(read))
    assert [r.color for r in model.background(nodes).collect()] == ["00FF00"]
    assert [(r.bookmark_id, r.bookmark_name) for r in model.bookmarks(nodes).collect()] == [("0", "_Toc0")]
    assert {r.created for r in model.core_properties(nodes).collect()} == {"2024-01-02T03:04:05Z", None}
    assert {(r.width, r.margin_top, r.columns) for r in model.sections(nodes).collect()} == {(11906, 1440, 1)}


def test_default_section_and_table_properties(spark):
    body = '<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/><w:tblW w:type="dxa" w:w="5000"/><w:jc w:val="center"/></w:tblPr><w:tr><w:trPr><w:trHeight w:val="400"/></w:trPr><w:tc><w:p/></w:tc></w:tr></w:tbl>'
    _, nodes, _ = opened(spark, package(body))
    (t,) = one(model.table_properties(nodes))
    assert (t["style_id"], t["alignment"], t["width_type"], t["width"]) == ("TableGrid", "center", "dxa", 5000)
    assert [r["height"] for r in one(model.row_heights(nodes))] == [400]
    assert [(s["width"], s["height"], s["margin_header"], s["section_idx"]) for s in one(model.sections(nodes))] == [(11906, 16838, 720, 0)]
    cells = spark.createDataFrame([("d", 0, 0, 0, "a\nb", 400, "TableGrid", "center", 5000)], "doc_id string, block_idx int, row_idx int, col_idx int, text string, row_height int, table_style string, table_alignment string, table_width int")
    _, nodes, runs = opened(spark, sink.assemble(sink.document_xml(sink.table_xml(cells))).first().content)
    (t,) = one(model.table_properties(nodes))
    assert (t["style_id"], t["alignment"], t["width"]) == ("TableGrid", "center", 5000) and [r["height"] for r in one(model.row_heights(nodes))] == [400]
    assert [c["text"] for c in one(model.table_cells(nodes, model.paragraphs(nodes, runs)))] == ["a\nb"]


def test_header_assignment(spark):
    sections = spark.createDataFrame([("d", 0), ("d", 1)], "doc_id string, section_idx int")
    given = spark.createDataFrame([("d", 1, "header", "default", "rId7"), ("d", 1, "header", "default", "rId6"), ("d", 1, "footer", "first", "rId8")], "doc_id string, section_idx int, kind string, type string, rel_id string")
    got = {r.section_idx: r.references and [tuple(x) for x in r.references] for r in structure.assign_headers(sections, given).collect()}
    assert got == {0: None, 1: [("footer", "first", "rId8"), ("header", "default", "rId6")]}
    last = structure.assign_headers(sections, given).filter("section_idx = 1").withColumn("block_idx", F.lit(None).cast("int"))
    block = spark.createDataFrame([("d", 0, "<w:p/>")], "doc_id string, block_idx int, xml string")
    assert '<w:headerReference w:type="default" r:id="rId6"/>' in sink.document_xml(block, sections=last).first().document_xml


def test_template_refuses_what_it_gets_wrong(spark):
    from inkshred.builder import Template

    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    with pytest.raises(ValueError, match="before any paragraph"):
        Template(rows, "id").text("x")
    with pytest.raises(ValueError, match="before any paragraph"):
        Template(rows, "id").paragraph().table([["x"]]).text("x")
    with pytest.raises(ValueError, match="have no weight"):
        Template(rows, "id").paragraph().text("x", weight=1)
    with pytest.raises(ValueError, match="a table of 0 x 0"):
        Template(rows, "id").table([])
    with pytest.raises(ValueError, match="empty document"):
        Template(rows, "id").packages()


def test_template_makes_a_document_of_every_row(spark):
    from inkshred.builder import Template

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "x" * 100_000)], "id long, name string")
    letter = Template(rows, "id").paragraph("Title").paragraph(alignment=F.when(F.col("id") == 1, "sideways").otherwise("center")).text(F.col("name"))
    assert {(r.doc_id, r.block_idx, tuple(r.violations)) for r in letter.build()["paragraphs"].collect() if r.violations} == {("1", 1, ("alignment",))}
    nodes = source.nodes(source.parts(letter.packages(), "document"), "document")
    got = model.paragraphs(nodes, model.runs(nodes)).orderBy("doc_id", "para").collect()
    assert [(r.doc_id, r.style_id, r.alignment, len(r.text)) for r in got] == [("1", "Title", None, 0), ("1", None, None, 1), ("2", "Title", None, 0), ("2", None, "center", 0), ("3", "Title", None, 0), ("3", None, "center", 100_000)]
    assert Template(rows.limit(0), "id").paragraph().text("x").packages().count() == 0
    assert Template(rows, "id").paragraph().packages().count() == 3


def test_borders_without_a_line_are_not_written(spark):
    p = spark.createDataFrame([("d", 0)], "doc_id string, block_idx int").withColumn("border_top", edits.border("none")).withColumn("border_left", F.lit(None).cast("struct<style:string,size:bigint,color:string>")).withColumn("border_right", edits.border("wavy"))
    runs = spark.createDataFrame([("d", 0, 0, "x")], "doc_id string, block_idx int, run_idx int, text string")
    assert "pBdr" not in sink.paragraph_xml(runs, p).first().xml
    order = sink.paragraph_xml(runs, p.withColumn("border_right", edits.border("thick")).withColumn("border_top", edits.border("single", 6, "00FF00"))).first().xml
    assert order.index('<w:top w:val="single" w:sz="6" w:space="0" w:color="00FF00"/>') < order.index('<w:right w:val="thick" w:sz="4" w:space="0" w:color="auto"/>')


def test_few_bytes_are_still_dealt_over_all_tasks(spark):
    """Adaptive execution joins small partitions by bytes; a package is little to read and much work."""
    runs = spark.range(200).select(F.col("id").cast("string").alias("doc_id"), F.lit(0).alias("block_idx"), F.lit(0).alias("run_idx"), F.lit("x").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sink.document_xml(sink.paragraph_xml(runs)).rdd.getNumPartitions() == n
    told = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(told)
    out = store.written(runs.groupBy("doc_id").count().select("doc_id", F.spark_partition_id().alias("p")), "dealt")
    assert out.select("p").distinct().count() == n  # one partition before
    assert spark.conf.get(told) == before


def test_packages_are_handed_on_a_few_at_a_time():
    """A batch of narrow rows is thousands of packages, of kilobytes each."""
    n = 3 * sink.FEW + 1
    extra = pa.list_(pa.struct([("rel_id", pa.string())]))
    rows = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(n)]), pa.array(["<a/>"] * n), pa.array(["<b/>"] * n), pa.nulls(n, pa.string()), pa.nulls(n, extra), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], ["doc_id", "document_xml", "core_xml", "styles_xml", "extra", "n_paragraphs", "n_tables"])
    out = list(sink._packed(iter([rows]), sink.styles_xml()))
    assert [b.num_rows for b in out] == [sink.FEW] * 3 + [1]
    assert [x for b in out for x in b.column("doc_id").to_pylist()] == [str(i) for i in range(n)]
