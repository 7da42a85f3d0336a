import gc
import io
import zipfile

from conftest import DATA

from inkshred import ooxml
from inkshred.plans import edit_queries, queries
from inkshred.sinks import docx as sink
from inkshred.sources import docx as source
from inkshred.sources import store


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_packages_are_made_and_read_in_one_worker(spark):
    documents = edit_queries._nested(spark, DATA)
    two, one = source.scan(sink.assemble(documents), "document", "styles"), sink.assemble_and_scan(documents, "document", "styles")
    assert _plan(one).split("Physical Plan")[1].count("MapInArrow") == 1
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(one) == plain(two)


def test_nodes_dealt_by_document_are_a_file_a_bucket_without_a_shuffle(spark):
    nodes = sink.assemble_and_scan(edit_queries._nested(spark, DATA), "document")
    kept = store.stored(nodes, dealt=True)
    buckets = [f.split("/")[-1].split("_")[-1].split(".")[0] for f in kept.inputFiles()]
    assert len(buckets) == len(set(buckets)) > 1
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, nodes.collect()))


def test_archives_are_those_of_zipfile():
    members = [("[Content_Types].xml", b"<Types/>" * 50, True), ("word/é.xml", "é".encode() * 900, False), ("word/media/a.png", bytes(range(256)), False), ("e", b"", True)]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data, _ in members:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    assert sink._archive(members) == sink._archive(members) == held.getvalue()
    many = [(f"p{i}", b"", True) for i in range(70_000)]
    with zipfile.ZipFile(io.BytesIO(sink._archive(many))) as z:
        assert len(z.namelist()) == 70_000


def test_a_flattened_part_leaves_nothing_to_the_garbage_collector():
    data = b"<a>" + b"<b c='1'>t</b>" * 500 + b"</a>"
    source.flatten(data)
    gc.collect()
    gc.disable()
    try:
        rows = source.flatten(data)
        assert gc.collect() < 50 and len(rows) == 501
    finally:
        gc.enable()


def test_long_parts_are_cut_into_bounded_batches():
    whole = ("<r>" + ("<i a='1'>" + "x" * 1_000_000 + "</i>") * 12 + "</r>").encode()
    small = b"<r><i a='1' b='2'/></r>"
    found = [("d", "k", x, None, None) for x in (whole, small, b"<r")] + [("d", "k", None, "IO_ERROR", "no")]
    batches = list(source._node_batches(iter(found)))
    assert sum(b.num_rows for b in batches) == 13 + 2 + 2
    assert max(b.nbytes for b in batches) < 2 * source._BYTES
    rows = [r for b in batches for r in b.to_pylist()]
    assert [r["attrs"] for r in rows if r["tag"] == "i"] == [[("a", "1")]] * 12 + [[("a", "1"), ("b", "2")]]
    assert [r["error_code"] for r in rows if r["tag"] is None] == ["XML_ERROR", "IO_ERROR"]
    assert all(r["ancestors"] is None and r["attrs"] is None for r in rows if r["tag"] is None)


def test_xml_of_documents_is_never_broadcast(spark):
    """Spark takes a row's XML for 20 bytes, so that of a million documents would go through the driver."""
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("bB")) > 1 << 20
    letters = queries._letters(spark, DATA)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(letters.nodes("document")) and "SortMergeJoin" in plan(letters.nodes("document"))
    assert "Broadcast" not in plan(queries.template_documents(spark, DATA))


def test_written_files_are_listed_by_tasks(spark, tmp_path):
    """The driver holds no file's name: a folder of a million packages is read from the list that the write left."""
    got = queries.docx_files(spark, DATA)
    text = _plan(got).split("Physical Plan")[1]
    assert "binaryFile" not in text and "Broadcast" not in text
    assert got.count() == spark.read.parquet(f"{DATA}/customer.parquet").count()
    where = f"file://{tmp_path}/out"
    runs = spark.createDataFrame([(x, 0, 0, f"text {x}") for x in ("a/1", "b ä", "c%", "1")], "doc_id string, block_idx int, run_idx int, text string")
    sink.write_files(sink.assemble(sink.documents_of_runs(runs)), where)
    plain = lambda df: sorted(map(repr, df.collect()))
    found, tasks = source.packages(spark, where), source.listed(spark, where)
    assert plain(tasks) == plain(found.drop("content")) and tasks.count() == 4
    assert plain(source.scan_listed(spark, where, "document")) == plain(source.scan(found, "document"))


def test_runs_and_styles_that_several_joins_read_are_made_once(spark):
    from inkshred.plans import style_queries

    got = style_queries.effective_formatting(spark, DATA)
    text = _plan(got).split("Physical Plan")[1]
    assert "part_key = word/styles.xml" not in text and "at_open" not in text  # neither the sheets nor their chains are folded again
    assert text.count("FileScan") >= 4 and "aggregate(sequence" not in text


def test_fixed_tables_start_no_python_workers(spark):
    from inkshred.operators import styles

    for made in (styles.catalogue(spark), styles.themes(spark)):
        assert "ExistingRDD" not in _plan(made)
    assert styles.themes(spark).count() == len(styles.THEMES)
    assert styles.catalogue(spark).filter("is_default").count() == 3


def test_nodes_without_places_are_the_same_but_for_these(spark):
    documents = edit_queries._nested(spark, DATA)
    every, lean = sink.assemble_and_scan(documents, "document"), sink.assemble_and_scan(documents, "document", places=False)
    assert set(every.columns) - set(lean.columns) == set(source.PLACES)
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(lean) == plain(every.drop(*source.PLACES)) != []
    bad = [("d", "k", b"<r", None, None), ("d", "k", None, "IO_ERROR", "no"), ("d", "k", b"<r>t</r>", None, None)]
    every, lean = ([r for b in source._node_batches(iter(bad), places=x) for r in b.to_pylist()] for x in (True, False))
    assert lean == [{k: v for k, v in r.items() if k not in source.PLACES} for r in every] and len(lean) == 3


def test_plain_archives_are_read_as_zipfile_reads_them():
    def archive(*names, packing=zipfile.ZIP_DEFLATED, comment=b""):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", packing) as z:
            z.comment = comment
            for i, name in enumerate(names):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), f"<a>{i}{name}</a>" * 40, packing)
        return held.getvalue()

    names = ("[Content_Types].xml", "word/document.xml", "/Word\\é.xml", "e")
    whole = [archive(*names), archive(*names, packing=zipfile.ZIP_STORED), archive("a"), archive(), sink._archive([(n, b"<x/>", True) for n in names])]
    both = lambda data, kinds=frozenset(), most=1 << 20: (source._plain_members("d", data, kinds, most), list(source.members("d", io.BytesIO(data), kinds, most)))
    for data in whole:
        for kinds in (frozenset(), frozenset(["document"])):
            got, expected = both(data, kinds)
            assert got == expected
    assert both(whole[0], most=100)[0] is None  # would unpack to too much: an error row
    for other in (archive(*names, comment=b"c"), archive(*names, "dir/"), b"no" + whole[0], whole[0] + b"x", b""):
        assert source._plain_members("d", other, frozenset(), 1 << 20) is None
    for data in whole:
        for i in range(len(data)):
            damaged = data[:i] + bytes([data[i] ^ 0x55]) + data[i + 1 :]
            got, expected = both(damaged)
            assert got is None or got == expected


def test_nodes_that_no_paragraph_reads_are_not_stored(spark):
    from inkshred.plans import model

    body = '<w:p><w:pPr><w:jc w:val="center"/><w:pBdr><w:top w:val="single"/></w:pBdr></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>a</w:t><w:tab/></w:r><w:hyperlink><w:r><w:t>b</w:t></w:r></w:hyperlink></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/><w:sectPr/>'
    docs = spark.createDataFrame([("d", f'<w:document xmlns:w="{ooxml.W}"><w:body>{body}</w:body></w:document>')], "doc_id string, document_xml string")
    nodes = sink.assemble_and_scan(docs, "document").cache()
    kept = model.of_paragraphs(nodes)
    rows = lambda n: (sorted(map(repr, model.runs(n).collect())), sorted(map(repr, model.paragraphs(n, model.runs(n)).collect())))
    assert rows(kept) == rows(nodes) and kept.count() < nodes.count()


def test_documents_of_runs_are_folded_once(spark):
    rows = [("a", 1, 0, "x & y\nz"), ("a", 0, 1, None), ("a", 0, 0, " b "), ("a", 0, 10, ""), ("a", 0, 2, "c"), ("b", None, 0, "n"), ("b", None, 1, "m"), ("b", 3, None, "o"), ("b", 3, 0, "p"), ("c", 0, 0, None), ("a", 1, 0, "same place"), (None, 0, 0, "q")]
    runs = spark.createDataFrame([(*r, i % 3 == 0) for i, r in enumerate(rows)], "doc_id string, block_idx int, run_idx int, text string, bold boolean")
    one, two = sink.documents_of_runs(runs), sink.document_xml(sink.paragraph_xml(runs))
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(one) == plain(two) and one.count() == 4
    count = lambda df: _plan(df).split("Physical Plan")[1].count("collect_list(")
    assert count(one) < count(two)


def test_only_texts_with_other_characters_are_searched_for_them(spark):
    odd = ["", None, "a\tb\nc\rd", "\x7f\x85\u2028\ud7ff\ue000\ufffd", "\U00010000\U0010ffff", "a\x00b", "\x08", "\x0b\x0c", "\x1f ", "\ufffe", "x\uffff", "\U0001f600\x01", "x" * 3_000_000, "\U0001f600" * 300_000 + "\x02", "<&>\"\r"]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, text string")
    expected = [t and "".join("\ufffd" if ord(c) < 32 and c not in "\t\n\r" or c in "\ufffe\uffff" else c for c in t) for t in odd]
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        expected = [t and t.replace(a, b) for t in expected]
    assert [r.x for r in df.orderBy("i").select(sink.escaped("text").alias("x")).collect()] == expected
    assert "RLIKE" in _plan(df.select(sink.escaped(df["text"])))
