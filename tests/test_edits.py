import io
import random
import zipfile

import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_documents import BODY, opened, package

from inkshred import ooxml
from inkshred.builder import Template
from inkshred.operators import axes, edits, splice, structure
from inkshred.plans import edit_queries, model
from inkshred.sinks import docx as sink
from inkshred.sources import datasource, store
from inkshred.sources import docx as source


def spliced(spark, content, make):
    """The document part after the edits that ``make`` gives for its nodes."""
    parts, nodes, _ = opened(spark, content)
    changes = make(nodes)
    out = splice.splice(parts, changes).collect()
    return {r.doc_id: bytes(r.data).decode() for r in out}, sorted(r.reason for r in splice.splice_violations(changes).collect())


def test_elements_know_their_bytes():
    data = '﻿<?xml version="1.0"?><!-- c --><a x="1>2"><b/><c y=\'/>\' >t&amp;é<!--x--> v</c ><d\n></d></a>'.encode()
    rows = source.flatten(data)
    cut = [(data[r[11] : r[14]].decode(), data[r[12] : r[13]].decode()) for r in rows]
    assert cut[1:] == [("<b/>", ""), ("<c y='/>' >t&amp;é<!--x--> v</c >", "t&amp;é<!--x--> v"), ("<d\n></d>", "")]
    assert [(r[0], r[8], r[9]) for r in rows] == [(0, 3, 0), (1, 0, 1), (2, 0, 1), (3, 0, 1)] and rows[2][7] == "t&é v"
    assert source.flatten('<?xml version="1.0" encoding="UTF-16"?><a/>'.encode("utf-16"))[0][11:] == [None] * 4


def test_texts_of_runs_in_place(spark):
    body = '<w:p><w:r/><w:r ><w:t>a</w:t><w:br/><w:t>b</w:t></w:r><w:r><w:br/></w:r><!-- k --></w:p>'

    def make(nodes):
        runs = nodes.filter("tag = 'r'").select("doc_id", "part_key", F.col("node").alias("run"), F.concat(F.lit("n&"), F.col("place").cast("string")).alias("text"))
        lost = runs.limit(1).withColumn("run", F.lit(999))
        return splice.run_texts(nodes, runs.unionByName(lost))

    got, bad = spliced(spark, package(body), make)
    t = lambda i: f'<w:t xml:space="preserve">n&amp;{i}</w:t>'
    assert got["0"] == BODY % f"<w:p><w:r>{t(0)}</w:r><w:r >{t(1)}<w:br/></w:r><w:r><w:br/>{t(2)}</w:r><!-- k --></w:p>"
    assert bad == ["no place"]


def test_properties_of_runs_in_place(spark):
    body = "<w:p><w:r/><w:r><w:rPr/></w:r><w:r><w:rPr><w:rStyle w:val='S'/><w:u w:val='single'/><x:y xmlns:x='u'/></w:rPr></w:r><w:r><w:rPr><w:b/><w:sz w:val='20'/></w:rPr></w:r></w:p>"

    def make(nodes):
        props = F.create_map(F.lit("b"), F.lit(None).cast("string"), F.lit("i"), F.lit(""), F.lit("sz"), F.lit("30"), F.lit("unknown"), F.lit("1"))
        return splice.run_properties(nodes, nodes.filter("tag = 'r'").select("doc_id", "part_key", F.col("node").alias("run"), props.alias("properties")))

    got, bad = spliced(spark, package(body), make)
    i, sz = "<w:i/>", '<w:sz w:val="30"/>'
    assert got["0"] == BODY % f"<w:p><w:r><w:rPr>{i}{sz}</w:rPr></w:r><w:r><w:rPr>{i}{sz}</w:rPr></w:r><w:r><w:rPr><w:rStyle w:val='S'/>{i}{sz}<w:u w:val='single'/><x:y xmlns:x='u'/></w:rPr></w:r><w:r><w:rPr>{i}{sz}</w:rPr></w:r></w:p>"
    assert bad == []


def test_splices_that_meet(spark):
    def make(nodes):
        p = nodes.filter("tag = 'p'")
        return splice.replaced(p, "<w:p/>").unionByName(splice.replaced(nodes.filter("tag = 't'"), "")).unionByName(splice.inserted(p, "2", "before", 2)).unionByName(splice.inserted(p, "1", "before", 1)).unionByName(splice.inserted(p, "3", "after"))

    got, bad = spliced(spark, package("<w:p><w:r><w:t>a</w:t></w:r></w:p>é<w:p/>"), make)
    assert got["0"] == BODY % "12<w:p/>3é12<w:p/>3" and bad == ["overlap"]


def test_packages_keep_what_is_not_edited(spark):
    content = package("<w:p><w:r><w:t>a</w:t></w:r></w:p>", word__numbering_DOT_xml=b"<raw>\x00", word__x_DOT_bin=b"\x01")
    parts, nodes, runs = opened(spark, content)
    changed = splice.splice(parts, splice.run_texts(nodes, runs.select("doc_id", "part_key", "run", F.lit("b").alias("text"))))
    docs = spark.createDataFrame([("0", bytearray(content))], "doc_id string, content binary")
    out = bytes(sink.rewrite(docs, changed.select("doc_id", "part_name", "data")).first().content)
    with zipfile.ZipFile(io.BytesIO(content)) as a, zipfile.ZipFile(io.BytesIO(out)) as b:
        assert a.namelist() == b.namelist()
        assert {n for n in a.namelist() if a.read(n) != b.read(n)} == {"word/document.xml"}


def test_axes_against_ancestors(spark):
    r = random.Random(3)

    def tree(depth):
        return "".join(f"<w:{t}>{tree(depth - 1) if depth else ''}</w:{t}>" for t in (r.choice("abc") for _ in range(r.randint(0, 4))))

    _, nodes, _ = opened(spark, package(tree(5)), package(tree(4)))
    of = nodes.filter("tag = 'a'")
    every = [x for x in nodes.filter("part_key = 'word/document.xml'").collect()]
    boxes = {(x.doc_id, x.node) for x in every if x.tag == "a"}
    want = sorted((x.doc_id, up, x.node) for x in every if x.tag == "b" for up in x.ancestors[:-1] if (x.doc_id, up) in boxes)
    for block in (1, 3, 256):
        assert sorted((x.doc_id, x.of_node, x.node) for x in axes.descendants(nodes, of, "b", block).collect()) == want
    assert sorted((x.doc_id, x.of_node, x.node) for x in axes.children(nodes, of, "b").collect()) == sorted((x.doc_id, x.parent, x.node) for x in every if x.tag == "b" and (x.doc_id, x.parent) in boxes)


def test_linked_pictures_and_field_runs(spark):
    pic = '<w:drawing><wp:inline xmlns:wp="wp"><wp:extent cx="1" cy="1"/><a:blip xmlns:a="a" r:embed="rId7"/></wp:inline></w:drawing>'
    char = lambda k: f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>'
    body = f'<w:p><w:hyperlink w:anchor="x"><w:r><w:t>see</w:t>{pic}</w:r></w:hyperlink></w:p><w:p>{char("begin")}<w:r><w:instrText>PAGE</w:instrText></w:r>{char("separate")}<w:r><w:t>1</w:t></w:r>{char("end")}<w:r/></w:p>'
    _, nodes, runs = opened(spark, package(body))
    assert [(p.text, p.n_runs) for p in model.paragraphs(nodes, runs).orderBy("para").collect()] == [("see", 1), ("1", 2)]
    assert [(f.code, f.result) for f in model.fields(nodes, runs).collect()] == [("PAGE", "1")]
    assert [len(r.drawings) for r in runs.orderBy("run").collect()] == [1, 0, 0]


def test_damaged_lzma_member_is_a_row(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_LZMA) as z:
        z.writestr("word/document.xml", BODY % ("<w:p/>" * 200))
        z.writestr("[Content_Types].xml", "<Types/>", zipfile.ZIP_STORED)
    data = bytearray(held.getvalue())
    data[60:90] = b"\xff" * 30
    parts, nodes, _ = opened(spark, bytes(data), package("<w:p/>"))
    assert {(e.doc_id, e.code) for e in source.errors(parts, nodes).collect()} == {("0", "IO_ERROR")}
    assert nodes.filter("doc_id = '1' and tag = 'p'").count() == 1


def test_scan_equals_parts_and_nodes_and_is_stored_once(spark):
    docs = spark.createDataFrame([("a", bytearray(package("<w:p><w:r><w:t>x</w:t></w:r></w:p>"))), ("b", bytearray(b"no")), ("c", bytearray(package("<w:p>")))], "doc_id string, content binary")
    two = source.nodes(source.parts(docs, "document"), "document")
    rows = lambda df: sorted(map(str, df.filter("error_code is null").collect()))
    kept = store.stored(source.scan(docs, "document"), 3)
    assert rows(kept) == rows(two) == rows(source.scan(docs, "document"))
    assert sorted((r.doc_id, r.error_code) for r in kept.filter("error_code is not null").collect()) == [("b", "INVALID_STATE"), ("c", "XML_ERROR")]
    plan = model.paragraphs(kept, model.runs(kept))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "hashpartitioning" not in plan  # neither parsed again nor shuffled


def test_row_scripts(spark):
    cells = spark.createDataFrame([(t, r, c, f"{t}{r}{c}") for t in (1, 2) for r in range(3) for c in range(2)], "table_id long, row_idx long, col_idx int, text string")
    script = spark.createDataFrame([(1, 1, "delete", 0), (1, 2, "delete", 0), (1, 3, "delete", 0), (1, 4, "delete", 0), (1, 5, "insert", 1), (1, 6, "insert", 0), (1, 7, "turn", 0), (1, 8, "insert", None), (9, 1, "insert", 0)], "table_id long, seq int, op string, at long")
    assert sorted((r.table_id, r.row_idx, r.col_idx, r.text) for r in edits.edit_rows(cells, script).collect() if r.table_id == 1) == [(1, 0, 0, None), (1, 0, 1, None)]
    assert edits.edit_rows(cells, script).filter("table_id = 2").count() == 6
    assert sorted((r.table_id, r.seq) for r in edits.script_violations(cells, script).collect()) == [(1, 4), (1, 5), (1, 7), (1, 8), (9, 1)]
    at = spark.createDataFrame([(2, 1), (2, 3), (2, 7), (2, 1)], "table_id long, at long")
    column = lambda df: [r.text for r in df.filter("table_id = 2 and col_idx = 0").orderBy("row_idx").collect()]
    assert column(edits.insert_row(cells, at)) == ["200", None, None, "210", "220", None]
    assert column(edits.delete_row(cells, at)) == ["200", "220"]


def test_data_source_reads_what_is_asked_for(spark, tmp_path):
    datasource.register(spark)
    big = bytes(range(256)) * 4000
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.docx").write_bytes(package("<w:p/>", word__media__image1_DOT_png=big))
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    (tmp_path / "y.txt").write_bytes(b"no")
    read = lambda **o: spark.read.format("docx").options(**o).load(f"file://{tmp_path}")
    rows = read().collect()
    assert {(r.path.rsplit("/", 1)[1], r.part_key, r.error_code) for r in rows} == {("x.docx", k, None) for k in ("[content_types].xml", "word/document.xml", "word/_rels/document.xml.rels", "word/media/image1.png")} | {("bad.docx", None, "INVALID_STATE")}
    for some in (read().filter("kind = 'document'"), read().filter("kind in ('document', 'styles')"), read(kinds="document").filter("error_code is null")):
        (r,) = some.collect()
        assert r.part_key == "word/document.xml" and r.bytes_read < 5000 < r.package_size
    assert [r.bytes_read > len(big) / 2 or r.bytes_read for r in read(kinds="media").filter("kind = 'media'").collect()] != []
    (lost,) = spark.read.format("docx").load(f"file://{tmp_path}/none").collect()
    assert (lost.error_code, lost.part_key) == ("NOT_FOUND", None)


def test_data_source_commits_whole_or_not_at_all(spark, tmp_path):
    datasource.register(spark)
    path = f"file://{tmp_path}/out"
    docs = spark.createDataFrame([(f"d/{i}", bytearray(package(f"<w:p><w:r><w:t>{i}</w:t></w:r></w:p>"))) for i in range(6)], "doc_id string, content binary").repartition(3)
    names = lambda: sorted(r.path.rsplit("/", 1)[1] for r in spark.read.format("docx").load(path).filter("kind = 'document'").collect())
    docs.write.format("docx").mode("append").save(path)
    assert names() == [f"d%2F{i}.docx" for i in range(6)]
    with pytest.raises(Exception, match="needs doc_id"):
        docs.unionByName(spark.createDataFrame([("z", None)], docs.schema)).write.format("docx").mode("overwrite").save(path)
    assert names() == [f"d%2F{i}.docx" for i in range(6)]
    files = sorted(p.name for p in (tmp_path / "out").rglob("*.docx"))
    assert files == [f"d%2F{i}.docx" for i in range(6)]  # the failed job left nothing
    docs.limit(2).withColumn("doc_id", F.concat(F.lit("n"), "doc_id")).write.format("docx").mode("append").save(path)
    assert len(names()) == 8
    docs.filter("doc_id = 'd/1'").write.format("docx").mode("overwrite").save(path)
    assert names() == ["d%2F1.docx"] == [p.name for p in (tmp_path / "out").rglob("*.docx")]


def test_data_source_leaves_the_list_of_files_to_the_tasks(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/out"
    content = package("<w:p/>")
    batch = lambda a, b: pa.RecordBatch.from_pydict({"doc_id": [f"d{i}" for i in range(a, b)], "content": [content] * (b - a)})
    monkeypatch.setattr(datasource, "MOST_FILES", 40)
    job = datasource._Writer(path, True)
    lost = job.write(iter([batch(0, 5)]))  # an attempt that does not count
    job.commit([job.write(iter([batch(0, 60), batch(60, 100)])), job.write(iter([])), job.write(iter([batch(100, 110)]))])
    reader = lambda **o: datasource._Reader({"path": path} | o)
    groups = reader().partitions()
    assert ".docx" not in repr(groups)  # as long as the list of pieces, not as that of packages
    assert sum(len(g.folders) for g in groups) == 4 and len(groups) >= 3
    names = lambda r: sorted(p.rsplit("/", 1)[1] for g in r.partitions() for b in r.read(g) for p in b.column("path").to_pylist())
    every = sorted(f"d{i}.docx" for i in range(110) for _ in range(3))
    assert names(reader()) == names(reader(partitionBytes=2 * len(content))) == every
    assert max(len(g.paths) for g in reader(partitionBytes=2 * len(content)).partitions()) == 2
    assert not (tmp_path / "out" / lost.folder).exists()


def test_tasks_of_a_failed_job_have_nowhere_to_write(tmp_path):
    job = datasource._Writer(f"file://{tmp_path}/out", True)
    rows = pa.RecordBatch.from_pydict({"doc_id": ["a"], "content": [b"x"]})

    def late():
        yield rows
        job.abort([])
        yield rows

    for batches in (late(), iter([rows])):
        with pytest.raises(OSError):
            job.write(batches)
    assert list((tmp_path / "out").iterdir()) == []


def test_docx_source_opens_packages_once(spark):
    plan = edit_queries.docx_source(spark, DATA)._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert "BatchScan" not in plan


def test_relationships_lead_from_part_to_part(spark):
    rel = lambda i, target, mode="": f'<Relationship Id="{i}" Type="t" Target="{target}"{mode}/>'
    more = {"_rels/.rels": rel("r1", "/word/document.xml") + rel("r2", "docProps/core.xml"), "word/_rels/header1.xml.rels": rel("r1", "../word/./media/A.png") + rel("r2", "document.xml") + rel("r3", "https://x", ' TargetMode="External"')}
    content = package("<w:p/>", rel("r5", "header1.xml"), word__header1_DOT_xml=b"<hdr/>", word__media__a_DOT_png=b"x", word__lost_DOT_xml=b"<x/>")
    held = io.BytesIO(content)
    with zipfile.ZipFile(held, "a") as z:
        for name, inner in more.items():
            z.writestr(name, f'<Relationships xmlns="{ooxml.PACKAGE_RELS}">{inner}</Relationships>')
    parts, nodes, _ = opened(spark, held.getvalue())
    rels = model.part_relationships(nodes)
    assert {(r.source_key, r.rel_id): r.target_key for r in rels.collect()} == {("", "r1"): "word/document.xml", ("", "r2"): "docprops/core.xml", ("word/document.xml", "r5"): "word/header1.xml", ("word/header1.xml", "r1"): "word/media/a.png", ("word/header1.xml", "r2"): "word/document.xml", ("word/header1.xml", "r3"): None}
    found = structure.reachable(rels)
    assert {(r.part_key, r.hops) for r in found.collect()} == {("word/document.xml", 1), ("docprops/core.xml", 1), ("word/header1.xml", 2), ("word/media/a.png", 3)}
    assert [r.part_key for r in structure.unreachable(parts, found).collect()] == ["word/lost.xml"]


def test_pictures_are_stored_once(spark):
    rows = [("d", None, 2, "b.PNG", b"two"), ("d", None, 1, "a.gif", b"one"), ("d", None, 3, "c", b"one"), ("d", "header1.xml", 1, "x.png", b"two"), ("d", "header1.xml", 2, "y.jpg", b"three"), ("e", "header1.xml", 1, "z", b"one")]
    placed = structure.place_pictures(spark.createDataFrame([(*r[:4], bytearray(r[4])) for r in rows], "doc_id string, source string, place int, name string, data binary"))
    got = {(r.doc_id, r.source, r.place): (r.target, r.rel_id, r.number) for r in placed.collect()}
    assert got == {
        ("d", None, 1): ("media/image1.gif", "rId6", 1), ("d", None, 2): ("media/image2.png", "rId7", 2), ("d", None, 3): ("media/image1.gif", "rId6", 3),
        ("d", "header1.xml", 1): ("media/image2.png", "rId1", 4), ("d", "header1.xml", 2): ("media/image3.jpg", "rId2", 5), ("e", "header1.xml", 1): ("media/image1.png", "rId1", 1),
    }
    assert structure.picture_parts(placed).count() == 5


def test_templates_of_child_tables(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, name string")
    children = spark.createDataFrame([(1, 5, "x"), (1, 4, None), (9, 1, "orphan")], "k long, no int, t string")
    made = Template(rows, "k").paragraph().text(F.col("name")).each_paragraph(children, "k", "no", F.col("t"), size=F.col("no") * 1000).each_table(children, "k", "no", [F.col("no"), F.col("t")], width=7).section(columns=2).paragraph().text("end")
    out = made.build()
    assert sorted((r.doc_id, r.text, r.size, r.violations) for r in out["runs"].collect()) == [("1", "", None, ["size"]), ("1", "a", None, []), ("1", "end", None, []), ("1", "x", None, ["size"]), ("2", "b", None, []), ("2", "end", None, [])]
    assert sorted((r.doc_id, r.row_idx, r.col_idx, r.text, r.width) for r in out["cells"].collect()) == [("1", 0, 0, "4", 7), ("1", 0, 1, "", 7), ("1", 1, 0, "5", 7), ("1", 1, 1, "x", 7)]
    nodes = store.stored(source.scan(made.packages(), "document"))
    blocks = sorted((r.doc_id, r.block_idx, r.kind) for r in model.blocks(nodes).collect())
    assert [k for d, _, k in blocks if d == "1"] == ["p", "p", "p", "tbl", "p", "p"] and [k for d, _, k in blocks if d == "2"] == ["p", "p", "p"]
    with pytest.raises(ValueError):
        made.each_table(children, "k", "no", [])


def test_template_fields_and_links(spark):
    rows = spark.createDataFrame([(1, "https://a.example/?x=1&y=2", "PAGE"), (2, None, " "), (3, "", None)], "k long, u string, c string")
    made = Template(rows, "k").paragraph().field(F.col("c"), "7").link("go", F.col("u"), anchor="here", size=F.col("k") * 2000).section(columns=2)
    assert sorted((r.doc_id, r.violations) for r in made.build()["runs"].filter("text = 'go'").collect()) == [("1", []), ("2", ["size"]), ("3", ["size"])]
    nodes = store.stored(source.scan(made.packages(), "document", "document_rels"))
    runs = model.runs(nodes)
    assert sorted((r.doc_id, r.text, r.url) for r in model.hyperlinks(nodes, runs).collect()) == [("1", "go", "https://a.example/?x=1&y=2"), ("2", "go", "#here"), ("3", "go", "#here")]
    assert [(r.doc_id, r.code, r.result) for r in model.fields(nodes, runs).collect()] == [("1", "PAGE", "7")]
    for wrong in (lambda t: t.field("PAGE"), lambda t: t.link("x", "y"), lambda t: t.paragraph().link("x", "y", weight=1)):
        with pytest.raises(ValueError):
            wrong(Template(rows, "k"))


def test_shared_folder_is_never_guessed_on_a_cluster():
    class Cluster:
        conf = {}
        master = "spark://host:7077"

    Cluster.sparkContext = Cluster
    with pytest.raises(ValueError):
        store.shared_folder(Cluster)
    assert ooxml.RUN_PROPERTIES.index("b") < ooxml.RUN_PROPERTIES.index("sz")
