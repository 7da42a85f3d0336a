"""Scan of document packages: bytes -> parts -> XML nodes.

Two small kernels run in ``mapInArrow`` tasks, one opening the archive, one
flattening an XML part into rows (ordinal, interval, ancestors, attributes, text,
and the byte offsets of the element).
Everything above, from paragraphs to sections, is DataFrame code over the rows.
"""

from __future__ import annotations

import contextlib
import io
import lzma
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import accumulate, islice
from xml.parsers import expat

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ooxml import KNOWN_PARTS
from .store import dealt, mapped

PARTS = "doc_id string, part_name string, part_key string, data binary, error_code string, error_message string, kind string"
NODE_FIELDS = ("node", "parent", "place", "path", "ancestors", "tag", "attrs", "text", "size", "depth", "qname", "at_open", "at_inner", "at_close", "at_after")
#: Those of a node's fields that only edits in place ask for; a scan without ``places`` leaves them out.
PLACES = ("qname", "at_open", "at_inner", "at_close", "at_after")
NODES = "doc_id string, part_key string, node int, parent int, place int, path string, ancestors array<int>, tag string, attrs map<string,string>, text string, size int, depth int, qname string, at_open int, at_inner int, at_close int, at_after int, error_code string, error_message string"
NODES_WITHOUT_PLACES = ", ".join(x for x in NODES.split(", ") if x.split(" ")[0] not in PLACES)
#: A package's contents may unpack to this many bytes, unless the scan is told otherwise.
MOST_BYTES = 1 << 30
#: The kinds of parts that are read as XML where none are named.
XML_KINDS = ("document", "header", "footer", "document_rels", "rels", "content_types", "core_properties", "app_properties", "styles")
#: What an archive or one of its members may raise where its bytes are damaged.
BROKEN = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, EOFError, struct.error, ValueError, OSError, RuntimeError, NotImplementedError)


@lru_cache(1 << 12)
def key_of(name: str) -> str:
    """Part names compare by forward slashes, without leading ./ and /, in lower case."""
    return re.sub(r"^(\./|/)+", "", name.replace("\\", "/")).lower()


@lru_cache(1 << 12)
def kind_of(key: str) -> str:
    """The kind of a part by its key: one with a place of its own, a header, footer, medium or list of relationships, or an additional one."""
    if key in KNOWN_PARTS:
        return KNOWN_PARTS[key]
    for kind in ("header", "footer"):
        if re.match(rf"word/{kind}[^/]*\.xml$", key):
            return kind
    return "media" if key.startswith("word/media/") else "rels" if key.endswith(".rels") else "additional"


def packages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, package_size and content of every .docx file below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select(F.sha2("path", 256).alias("doc_id"), "path", F.col("length").alias("package_size"), "content")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path and package_size, as ``packages`` gives them, of the files that ``sinks.docx.write_files`` wrote below ``path``, from the table it keeps there.

    ``packages`` lists a folder in the driver, which then holds the name of
    every file; this list is only ever read by tasks.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString()
    where = F.concat(F.lit(f"{top}/"), "file")
    return spark.read.parquet(f"{path}/_files").select(F.sha2(where, 256).alias("doc_id"), where.alias("path"), F.col("bytes").alias("package_size"))


def _read(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    where, folder = fs.FileSystem.from_uri(path)

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for doc_id, name in zip(batch.column("doc_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
                with where.open_input_file(f"{folder}/{name.rsplit('/', 1)[1]}") as file:
                    yield doc_id, file.read()

    return together(rows(), ["doc_id", "content"], [pa.string(), pa.binary()], 1)


def scan_listed(spark: SparkSession, path: str, *kinds: str, most_bytes: int = MOST_BYTES, places: bool = True) -> DataFrame:
    """The XML nodes of the ``listed`` files below ``path``, as ``scan`` reads them: every task opens its own files, whose bytes never leave its worker.

    A file that is in the list and not in the folder fails the job.
    """
    scanned = scanner(*kinds, most_bytes=most_bytes, places=places)
    files = dealt(listed(spark, path).select("doc_id", "path"))
    return mapped(files, lambda batches: scanned(_read(batches, path)), NODES if places else NODES_WITHOUT_PLACES)


_PART_NAMES = ["doc_id", "part_name", "part_key", "data", "error_code", "error_message", "kind"]
_PART_TYPES = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.string()]
#: Rows, and bytes of their texts or data, that a kernel hands on together.
_ROWS, _BYTES = 1 << 12, 4 << 20


def _members(doc_id: str, content: pa.Scalar, kinds: frozenset, most_bytes: int) -> Iterator[tuple]:
    data = content.as_py() or b""
    plain = _plain_members(doc_id, data, kinds, min(most_bytes, _BYTES))
    return iter(plain) if plain is not None else members(doc_id, io.BytesIO(data), kinds, most_bytes)


def _plain_members(doc_id: str, data: bytes, kinds: frozenset, most_bytes: int) -> list[tuple] | None:
    """What ``members`` gives for a small whole archive without extras, whose members follow one another as its directory lists them; None for any other, which ``members`` decides about."""
    end = len(data) - 22
    if end < 0 or data[end : end + 4] != b"PK\5\6":
        return None
    disk, start, here, every, length, at, comment = struct.unpack_from("<4H2LH", data, end + 4)
    if disk or start or comment or here != every or at + length != end:
        return None
    last, expected, unpacked = {}, 0, 0
    while at < end:
        if data[at : at + 4] != b"PK\1\2" or at + 46 > end:
            return None
        version, flags, method, _, _, crc, packed, size, n, extra, comment, disk, _, _, offset = struct.unpack_from("<5H3L5H2L", data, at + 6)
        title = data[at + 46 : at + 46 + n]
        begin = offset + 30 + n
        if version > 20 or flags not in (0, 0x800) or method not in (0, 8) or extra or comment or disk or offset != expected or b"\0" in title or title.endswith(b"/"):
            return None
        if data[offset : offset + 4] != b"PK\3\4" or data[offset + 4 : offset + 30] != data[at + 6 : at + 32] or data[offset + 30 : begin] != title:
            return None
        try:
            name = title.decode("utf-8" if flags else "ascii")
        except UnicodeDecodeError:
            return None
        last[key_of(name)] = name, method, crc, size, begin, begin + packed
        expected, unpacked, at = begin + packed, unpacked + size, at + 46 + n
    if at != end or expected != end - length or unpacked > most_bytes:
        return None
    out = []
    for key, (name, method, crc, size, begin, after) in last.items():
        kind = kind_of(key)
        if kinds and kind not in kinds:
            continue  # not unpacked at all
        inner = data[begin:after]
        if method:
            unpacker = zlib.decompressobj(-15)
            try:
                inner = unpacker.decompress(inner, size + 1)
            except zlib.error:
                return None
            if not unpacker.eof or unpacker.unused_data:
                return None
        if len(inner) != size or zlib.crc32(inner) != crc:
            return None
        out.append((doc_id, name, key, inner, None, None, kind))
    out += [(doc_id, None, key, None, "INVALID_STATE", f"missing part {key}", None) for key in sorted({"[content_types].xml", "word/document.xml"} - last.keys())]
    return out


def members(doc_id: str, file, kinds: frozenset, most_bytes: int) -> Iterator[tuple]:
    """The part rows of one package, a file that can be sought in; what could not be read as rows of errors."""
    try:
        if not file.seek(0, io.SEEK_END):
            raise ValueError("no bytes")
        file.seek(0)
        with zipfile.ZipFile(file) as archive:
            entries = [e for e in archive.infolist() if not e.is_dir()]
            if sum(e.file_size for e in entries) > most_bytes:
                raise ValueError("unpacks to too many bytes")
            last = {key_of(e.filename): e for e in entries}
            for key, e in last.items():
                kind = kind_of(key)
                if kinds and kind not in kinds:
                    continue  # not unpacked at all
                try:
                    yield doc_id, e.filename, key, archive.read(e), None, None, kind
                except BROKEN as x:  # a damaged member costs its own part only
                    yield doc_id, e.filename, key, None, "IO_ERROR", str(x), kind
        for key in sorted({"[content_types].xml", "word/document.xml"} - last.keys()):
            yield doc_id, None, key, None, "INVALID_STATE", f"missing part {key}", None
    except BROKEN as x:
        yield doc_id, None, None, None, "INVALID_STATE", str(x), None


def together(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], weight: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded size; ``weight``: the column whose length counts."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"")
        if len(held) >= _ROWS or size >= _BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), types, strict=True)], names)


def _opened(batches: Iterator[pa.RecordBatch], kinds: frozenset, most_bytes: int) -> Iterator[pa.RecordBatch]:
    packages_ = ((d, c) for batch in batches for d, c in zip(batch.column("doc_id").to_pylist(), batch.column("content"), strict=True))
    yield from together((row for d, c in packages_ for row in _members(d, c, kinds, most_bytes)), _PART_NAMES, _PART_TYPES, 3)


def parts(docs: DataFrame, *kinds: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per part of (doc_id, content) packages, with its kind and size; failures are rows with error_code.

    kinds: the kinds wanted (all without any); others are not even unpacked.
    A package that would unpack to over ``most_bytes`` is an error row.
    """
    open_ = partial(_opened, kinds=frozenset(kinds), most_bytes=most_bytes)
    return mapped(docs.select("doc_id", "content"), open_, PARTS).withColumn("size", F.octet_length("data").cast("long"))


#: A start tag from its first byte on: attribute values may hold a closing bracket.
_TAG = re.compile(rb"<[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>")
#: Encodings whose bytes the places of elements are told in.
_PLAIN = (None, "utf-8", "us-ascii", "ascii")


@lru_cache(1 << 12)
def _local(name: str) -> str:
    return name.split("}")[1] if "}" in name else name


@lru_cache(1 << 12)
def _qualified(name: str) -> str:
    """The name as it is written, with its prefix."""
    pieces = name.split("}")
    return f"{pieces[2]}:{pieces[1]}" if len(pieces) == 3 else pieces[-1]


#: NODE_FIELDS as columns of a part's elements; ``ancestors`` and the names and values of ``attrs`` one after another, their numbers beside them.
_COLUMNS = tuple(x for x in NODE_FIELDS if x not in ("ancestors", "attrs"))


def _columns(data: bytes, places_too: bool = True) -> tuple[dict[str, list], list[int], list[str], list[str], list[int]]:
    columns: dict[str, list] = {x: [] for x in _COLUMNS}
    ancestors: list[int] = []
    names: list[str] = []
    values: list[str] = []
    counts: list[int] = []
    parents, places, paths, tags, texts, sizes, depths, qnames, opens, closes = (columns[x] for x in ("parent", "place", "path", "tag", "text", "size", "depth", "qname", "at_open", "at_close"))
    open_: list[int] = []  # the elements around
    children = [0]  # how many of each came so far
    held: list[str] = []  # character data since the last tag, of the innermost of them
    told: list[str | None] = [None]
    parser = expat.ParserCreate(namespace_separator="}")
    parser.namespace_prefixes = parser.buffer_text = True

    def refuse(*_) -> None:
        raise ValueError("document types are not read")

    def pieces() -> None:
        piece = "".join(held)
        held.clear()
        if piece.strip():
            texts[open_[-1]] = (texts[open_[-1]] or "") + piece

    def start(name: str, attrs: dict) -> None:
        if held:
            pieces()
        tag = _local(name)
        if open_:
            parents.append(open_[-1])
            paths.append(f"{paths[open_[-1]]}/{tag}")
        else:
            parents.append(None)
            paths.append(tag)
        depths.append(len(open_))
        places.append(children[-1])
        children[-1] += 1
        children.append(0)
        open_.append(len(tags))
        ancestors.extend(open_)
        if attrs:
            attrs = {_local(k): v for k, v in attrs.items()}
            names.extend(attrs)
            values.extend(attrs.values())
        counts.append(len(attrs))
        tags.append(tag)
        texts.append(None)
        sizes.append(0)
        if places_too:
            qnames.append(_qualified(name))
            opens.append(parser.CurrentByteIndex)
            closes.append(None)

    def end(_: str) -> None:
        if held:
            pieces()
        node = open_.pop()
        children.pop()
        sizes[node] = len(tags) - node - 1
        if places_too:
            closes[node] = parser.CurrentByteIndex

    parser.StartDoctypeDeclHandler, parser.StartElementHandler, parser.EndElementHandler = refuse, start, end
    parser.CharacterDataHandler = held.append
    parser.XmlDeclHandler = lambda version, encoding, alone: told.__setitem__(0, encoding)
    try:
        parser.Parse(data, True)
    finally:  # a parser and its handlers hold each other, and with them all rows
        parser.StartDoctypeDeclHandler = parser.StartElementHandler = parser.EndElementHandler = parser.CharacterDataHandler = parser.XmlDeclHandler = None
    columns["node"] = list(range(len(tags)))
    if not places_too:
        for x in PLACES:
            del columns[x]
        return columns, ancestors, names, values, counts
    plain = (told[0].lower() if told[0] else None) in _PLAIN and data[:2] not in (b"\xff\xfe", b"\xfe\xff")
    inners, afters = columns["at_inner"], columns["at_after"]
    for node, at in enumerate(opens):
        tag = _TAG.match(data, at) if plain else None
        if tag is None:
            opens[node] = closes[node] = inner = after = None
        else:
            inner = after = tag.end()
            if data[inner - 2] == 47:  # />
                closes[node] = inner
            else:
                after = data.index(b">", closes[node]) + 1
        inners.append(inner)
        afters.append(after)
    return columns, ancestors, names, values, counts


def flatten(data: bytes) -> list[list]:
    """NODE_FIELDS of every element, in document order.

    Names are local.  Character data of white space alone is dropped.  A node
    and its ``size`` descendants are numbered one after another.  The last four
    are byte offsets: of an element's start tag, of what is inside, of its end
    tag and of what follows (an empty element's inside and end tag are where it
    ends); null in a part that is neither UTF-8 nor ASCII.  A part with a
    document type is refused, so no entity is ever expanded.
    """
    columns, ancestors, names, values, counts = _columns(data)
    above, pairs = iter(ancestors), iter(zip(names, values, strict=True))
    columns |= {"ancestors": [list(islice(above, d + 1)) for d in columns["depth"]], "attrs": [dict(islice(pairs, n)) for n in counts]}
    return [list(x) for x in zip(*(columns[x] for x in NODE_FIELDS), strict=True)]


_NODE_NAMES = ["doc_id", "part_key", *NODE_FIELDS, "error_code", "error_message"]
_NODE_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]


class _Held:
    """Nodes of parts on their way into batches, by column."""

    def __init__(self, places: bool) -> None:
        self.places = places
        self.columns: dict[str, list] = {x: [] for x in ("doc_id", "part_key", *_COLUMNS) if places or x not in PLACES}
        self.ancestors, self.names, self.values, self.counts = [], [], [], []
        self.bytes = 0

    def add(self, doc_id: str, key: str, data: bytes) -> None:
        columns, *flat = _columns(data, self.places)
        n = len(columns["node"])
        for c, x in (columns | {"doc_id": [doc_id] * n, "part_key": [key] * n}).items():
            self.columns[c] += x
        for have, more in zip((self.ancestors, self.names, self.values, self.counts), flat, strict=True):
            have += more
        self.bytes += len(data)

    def full(self) -> bool:
        return len(self.counts) >= _ROWS or self.bytes >= _BYTES

    def batches(self) -> Iterator[pa.RecordBatch]:
        """All of it in batches of at most _ROWS rows, of fewer where texts are long."""
        n = len(self.counts)
        if not n:
            return
        up, said = [0, *accumulate(d + 1 for d in self.columns["depth"])], [0, *accumulate(self.counts)]
        cuts = list(range(0, n, _ROWS))
        if self.bytes >= 2 * _BYTES:  # a part that is long by itself
            cuts, size = [0], 0
            for i, text in enumerate(self.columns["text"]):
                size += len(text or "")
                if i + 1 < n and (size >= _BYTES or i + 1 - cuts[-1] >= _ROWS):
                    cuts.append(i + 1)
                    size = 0
        for i, j in zip(cuts, [*cuts[1:], n], strict=True):
            at = lambda ends: pa.array([x - ends[i] for x in ends[i : j + 1]], pa.int32())  # noqa: B023, E731
            inside = {
                "ancestors": lambda: pa.ListArray.from_arrays(at(up), pa.array(self.ancestors[up[i] : up[j]], pa.int32())),
                "attrs": lambda: pa.MapArray.from_arrays(at(said), pa.array(self.names[said[i] : said[j]], pa.string()), pa.array(self.values[said[i] : said[j]], pa.string())),
                "error_code": lambda: pa.nulls(j - i, pa.string()), "error_message": lambda: pa.nulls(j - i, pa.string()),
            }
            yield pa.RecordBatch.from_arrays([inside[c]() if c in inside else pa.array(self.columns[c][i:j], k) for c, k in zip(*_node_fields(self.places), strict=True)], _node_fields(self.places)[0])


def _node_fields(places: bool) -> tuple[list[str], list[pa.DataType]]:
    kept = [(n, t) for n, t in zip(_NODE_NAMES, _NODE_TYPES, strict=True) if places or n not in PLACES]
    return [n for n, _ in kept], [t for _, t in kept]


def _node_batches(parts_: Iterator[tuple], places: bool = True) -> Iterator[pa.RecordBatch]:
    """Node rows of parts (doc_id, key, data, error code, message) as batches of a bounded size, a row for what could not be read."""
    held, bad = _Held(places), []
    fields, types = _node_fields(places)
    none = (None,) * (len(fields) - 4)
    for doc_id, key, data, code, message in parts_:
        if code is None:
            try:
                held.add(doc_id, key, data)
            except (expat.ExpatError, ValueError, LookupError) as e:
                code, message = "XML_ERROR", str(e)
        if code is not None:
            bad.append((doc_id, key, *none, code, message))
        if held.full():
            yield from held.batches()
            held = _Held(places)
        if len(bad) >= _ROWS:
            yield from together(iter(bad), fields, types, 9)
            bad = []
    yield from held.batches()
    yield from together(iter(bad), fields, types, 9)


def _flattened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _node_batches((d, k, x.as_py(), None, None) for batch in batches for d, k, x in zip(batch.column("doc_id").to_pylist(), batch.column("part_key").to_pylist(), batch.column("data"), strict=True))


def _scanned(batches: Iterator[pa.RecordBatch], kinds: frozenset, most_bytes: int, places: bool) -> Iterator[pa.RecordBatch]:
    packages_ = ((d, c) for batch in batches for d, c in zip(batch.column("doc_id").to_pylist(), batch.column("content"), strict=True))
    yield from _node_batches(((d, key, data, code, message) for d, c in packages_ for _, _, key, data, code, message, _ in _members(d, c, kinds, most_bytes)), places)


def scanner(*kinds: str, most_bytes: int = MOST_BYTES, places: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel of ``scan``."""
    return partial(_scanned, kinds=frozenset(kinds or XML_KINDS), most_bytes=most_bytes, places=places)


def scan(docs: DataFrame, *kinds: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The XML nodes of (doc_id, content) packages in one pass: ``parts`` and ``nodes`` without the parts' bytes in between.

    kinds: as in ``nodes``.  What could not be opened is a row of an error, as
    what could not be parsed is.
    """
    return mapped(docs.select("doc_id", "content"), scanner(*kinds, most_bytes=most_bytes), NODES)


def nodes(part_rows: DataFrame, *kinds: str) -> DataFrame:
    """The XML nodes of the parts of these kinds (all XML kinds without any); media bytes never get here."""
    rows = part_rows.filter(F.col("kind").isin(*(kinds or XML_KINDS)) & F.col("data").isNotNull())
    return mapped(rows.select("doc_id", "part_key", "data"), _flattened, NODES)


def _typed(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content"), strict=True):
                types: list[dict] = []
                listed = []
                for _, name, key, data, code, message, kind in _members(doc_id, content, frozenset(), most_bytes):
                    if kind == "content_types" and data is not None:
                        with contextlib.suppress(expat.ExpatError, ValueError, LookupError):
                            types = [r[6] | {"tag": r[5]} for r in flatten(data)]
                    listed.append((doc_id, name, key, kind, None if data is None else len(data), code, message))
                defaults = [(t.get("Extension", "").lower(), t.get("ContentType", "")) for t in types if t["tag"] == "Default"]
                overrides = [(key_of(t.get("PartName", "")), t.get("ContentType", "")) for t in types if t["tag"] == "Override"]
                yield from ((*row, dict(reversed(defaults)), dict(reversed(overrides))) for row in listed)

    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.string())]
    names = ["doc_id", "part_name", "part_key", "kind", "size", "error_code", "error_message", "defaults", "overrides"]
    yield from together((tuple(list(x.items()) if isinstance(x, dict) else x for x in row) for row in rows()), names, kinds, 1)


def typed_parts(docs: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The parts of (doc_id, content) packages without their bytes, each with its package's content type rules (maps; the first of a name wins), in one pass."""
    return mapped(docs.select("doc_id", "content"), partial(_typed, most_bytes=most_bytes), "doc_id string, part_name string, part_key string, kind string, size long, error_code string, error_message string, defaults map<string,string>, overrides map<string,string>")


def errors(part_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """doc_id, code, op, message, part, context: what could not be read, one row each; readable documents have none.

    context: what else is known, by name.
    """
    known = lambda **c: F.map_filter(F.create_map(*(x for k, v in c.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    a = part_rows.filter("error_code is not null").select("doc_id", F.col("error_code").alias("code"), F.lit("open").alias("op"), F.col("error_message").alias("message"), F.col("part_key").alias("part"), known(kind=F.col("kind"), name=F.col("part_name")).alias("context"))
    b = node_rows.filter("error_code = 'XML_ERROR'").select("doc_id", F.col("error_code").alias("code"), F.lit("parse").alias("op"), F.col("error_message").alias("message"), F.col("part_key").alias("part"), known(place=F.nullif(F.regexp_extract("error_message", "(line [0-9]+, column [0-9]+)", 1), F.lit(""))).alias("context"))
    return a.union(b)


def error_text(errors: DataFrame) -> Column:
    """An error row as one line: operation, code, message and context, as far as they are known."""
    context = F.array_join(F.transform(F.array_sort(F.map_entries("context")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return F.concat_ws(" | ", F.concat(F.lit("operation="), "op"), F.concat(F.lit("code="), "code"), "message", F.when(F.size("context") > 0, F.concat(F.lit("context={"), context, F.lit("}"))))


def fail_fast(rows: DataFrame) -> DataFrame:
    """Part or node rows that end the job at the first error instead of carrying it."""
    told = F.concat_ws(" | ", F.concat(F.lit("code="), "error_code"), F.concat(F.lit("document="), "doc_id"), F.concat(F.lit("part="), "part_key"), "error_message")
    return rows.filter(F.when(F.col("error_code").isNotNull(), F.raise_error(told).cast("boolean")).otherwise(F.lit(True)))


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height in pixels from a PNG, GIF or JPEG header; None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            marker = data[at + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [image_size(x.as_py()) if x.is_valid else None for x in batch.column("data")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part_key"), pa.array([s and s[0] for s in sizes], pa.int32()), pa.array([s and s[1] for s in sizes], pa.int32())], ["doc_id", "part_key", "width_px", "height_px"])


def image_dims(media: DataFrame) -> DataFrame:
    """(doc_id, part_key, data) -> pixel and EMU sizes read from the image headers; null where none is known."""
    sized = mapped(media.select("doc_id", "part_key", "data"), _sized, "doc_id string, part_key string, width_px int, height_px int")
    return sized.withColumn("width_emu", F.col("width_px").cast("long") * 9525).withColumn("height_emu", F.col("height_px").cast("long") * 9525)
