"""Fluent builders: rows of documents, validated, ready for the sink.

``Template`` makes a document of every row of a DataFrame, as Spark expressions;
``DocumentBuilder`` makes a single one by hand.  In the latter the first error
sticks: ``build`` then returns no rows but the error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ooxml
from .operators import edits
from .sinks import docx as sink
from .sources.store import merged

_RUNS = "doc_id string, block_idx int, run_idx int, text string, bold boolean, italic boolean, underline string, color string, size int"
_PARAGRAPHS = "doc_id string, block_idx int, style_id string, alignment string"
_CELLS = "doc_id string, block_idx int, row_idx int, col_idx int, text string"


@dataclass
class DocumentBuilder:
    """``DocumentBuilder("id").paragraph().text("Hi").bold().end()...build(spark)``."""

    doc_id: str
    metadata: dict = field(default_factory=dict)
    error: str | None = None
    _paragraphs: list = field(default_factory=list)
    _runs: list = field(default_factory=list)
    _cells: list = field(default_factory=list)
    _blocks: int = 0

    def fail(self, message: str) -> None:
        self.error = self.error or message

    def paragraph(self, style: str | None = None) -> ParagraphBuilder:
        at = self._blocks
        self._blocks += 1
        self._paragraphs.append({"doc_id": self.doc_id, "block_idx": at, "style_id": style, "alignment": None})
        return ParagraphBuilder(self, at)

    def table(self, rows: list[list[str]]) -> DocumentBuilder:
        wide = max(map(len, rows), default=0)
        if not (ooxml.ROWS[0] <= len(rows) <= ooxml.ROWS[1] and ooxml.COLS[0] <= wide <= ooxml.COLS[1]):
            self.fail(f"a table of {len(rows)} x {wide}")
        else:
            self._cells += [(self.doc_id, self._blocks, r, c, x) for r, line in enumerate(rows) for c, x in enumerate(line)]
            self._blocks += 1
        return self

    def set_metadata(self, **values) -> DocumentBuilder:
        self.metadata |= values
        return self

    def build(self, spark: SparkSession) -> tuple[dict[str, DataFrame], str | None]:
        """Tables runs, paragraphs and cells, and the first error; an empty document is one."""
        if not self._blocks:
            self.fail("an empty document")
        ok = self.error is None
        runs = [tuple(r[k] for k in ("doc_id", "block_idx", "run_idx", "text", "bold", "italic", "underline", "color", "size")) for r in self._runs]
        paragraphs = [tuple(p.values()) for p in self._paragraphs]
        make = lambda rows, schema: spark.createDataFrame(rows if ok else [], schema)
        return {"runs": make(runs, _RUNS), "paragraphs": make(paragraphs, _PARAGRAPHS), "cells": make(self._cells, _CELLS)}, self.error


@dataclass
class ParagraphBuilder:
    """Formatters act on the last run; without one they are an error."""

    document: DocumentBuilder
    at: int
    _last: dict | None = None
    _n: int = 0

    def text(self, text: str) -> ParagraphBuilder:
        self._last = {"doc_id": self.document.doc_id, "block_idx": self.at, "run_idx": self._n, "text": text, "bold": False, "italic": False, "underline": None, "color": None, "size": None}
        self._n += 1
        self.document._runs.append(self._last)
        return self

    def _set(self, name: str, value, ok: bool = True) -> ParagraphBuilder:
        if self._last is None:
            self.document.fail(f"{name} before any text")
        elif not ok:
            self.document.fail(f"{name} {value}")
        else:
            self._last[name] = value
        return self

    def bold(self) -> ParagraphBuilder:
        return self._set("bold", True)

    def italic(self) -> ParagraphBuilder:
        return self._set("italic", True)

    def underline(self, kind: str = "single") -> ParagraphBuilder:
        return self._set("underline", kind, kind in ooxml.UNDERLINES)

    def color(self, hex_color: str) -> ParagraphBuilder:
        return self._set("color", hex_color)

    def font_size(self, points: int) -> ParagraphBuilder:
        return self._set("size", points * 2, ooxml.SIZE[0] <= points * 2 <= ooxml.SIZE[1])

    def alignment(self, value: str) -> ParagraphBuilder:
        if value in ooxml.ALIGNMENTS:
            self.document._paragraphs[-1 if self.document._paragraphs[-1]["block_idx"] == self.at else [p["block_idx"] for p in self.document._paragraphs].index(self.at)]["alignment"] = value
        else:
            self.document.fail(f"alignment {value}")
        return self

    def end(self) -> DocumentBuilder:
        return self.document


def _value(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


#: Formatting of a template's runs, paragraphs, cells and sections, with the types of the model.
_RUN = {"font": "string", "size": "int", "color": "string", "bold": "boolean", "italic": "boolean", "strike": "boolean", "underline": "string", "highlight": "string"}
#: What a run may be besides its text: a field before it, or a link around it.
_INSIDE = {"field_code": "string", "field_result": "string", "field_dirty": "boolean", "rel_id": "string", "anchor": "string", "url": "string"}
_PARAGRAPH = {"style_id": "string", "alignment": "string", "line_rule": "string"} | dict.fromkeys(("indent_left", "indent_right", "first_line", "hanging", "spacing_before", "spacing_after", "line_value", "num_id", "num_level"), "int") | {f"border_{s}": "struct<style:string,size:bigint,color:string>" for s in ooxml.BORDER_SIDES}
_CELL = {"width": "int", "v_align": "string", "shading": "string", "table_style": "string", "table_alignment": "string", "table_width": "int", "row_height": "int"} | {f"border_{s}": "struct<style:string,size:bigint,color:string>" for s in ooxml.BORDER_SIDES}
_SECTION = {"width": "int", "height": "int", "orientation": "string", "columns": "int", "break_type": "string"} | {f"margin_{m}": "int" for m in ooxml.MARGINS}
_KEYS = {"runs": ("block_idx", "run_idx"), "paragraphs": ("block_idx",), "cells": ("block_idx", "row_idx", "col_idx"), "sections": ("section_idx", "block_idx")}


#: Block numbers between two places of a template that has paragraphs of children.
ROOM = 1 << 32


class Template:
    """One document for each row of ``rows``, every value a Column of the row or a constant.

    ``Template(customers, "c_custkey").paragraph("Heading1").text(F.col("c_name"), bold=True).table([["a", F.col("b")]]).section(columns=2).packages()``

    What the template itself gets wrong (a run before any paragraph, an
    unknown property, a table of no or too many cells) raises ValueError; a
    row's value out of range is left out and named in the ``violations`` of
    the rows that ``build`` returns.  A null text is an empty one.  Rows that
    share a key would share a document, so the key must be unique.
    ``field`` and ``link`` are runs too.  ``each_table`` and ``each_paragraph`` take their rows from a child table
    (the orders of a customer), any number for each document.
    """

    def __init__(self, rows: DataFrame, key: str, title: Column | str | None = None, creator: Column | str | None = None) -> None:
        self.rows, self.key = rows, key
        self.metadata = {k: _value(v) for k, v in (("title", title), ("creator", creator)) if v is not None}
        self._made: dict[str, list[dict]] = {k: [] for k in _KEYS}
        self._each: dict[str, list[tuple[DataFrame, list[str]]]] = {k: [] for k in _KEYS}
        self._blocks = 0
        self._links = 0
        self._room = False  # whether paragraphs of children need block numbers of their own
        self._runs = -1  # of the last paragraph; -1: no paragraph is open

    def _add(self, kind: str, known: dict[str, str], values: dict, **at) -> None:
        unknown = values.keys() - known.keys()
        if unknown:
            raise ValueError(f"{kind} have no {', '.join(sorted(unknown))}")
        self._made[kind].append(at | {c: _value(v).cast(known[c]) for c, v in values.items()})

    def paragraph(self, style_id: Column | str | None = None, **properties) -> Template:
        self._add("paragraphs", _PARAGRAPH, properties | ({"style_id": style_id} if style_id is not None else {}), block_idx=self._blocks)
        self._blocks, self._runs = self._blocks + 1, 0
        return self

    def text(self, text: Column | str, **formatting) -> Template:
        """A run of the last paragraph."""
        if self._runs < 0:
            raise ValueError("text before any paragraph")
        self._add("runs", _RUN, formatting, block_idx=self._blocks - 1, run_idx=self._runs, text=F.coalesce(_value(text).cast("string"), F.lit("")))
        self._runs += 1
        return self

    def field(self, code: Column | str, result: Column | str = "", dirty: Column | bool = False, **formatting) -> Template:
        """A complex field in the last paragraph, shown as ``result``; where ``code`` is null or blank there is none."""
        said = F.nullif(F.trim(_value(code).cast("string")), F.lit(""))
        return self._inside(formatting, text=F.lit(""), field_code=said, field_result=_value(result).cast("string"), field_dirty=_value(dirty).cast("boolean"))

    def link(self, text: Column | str, url: Column | str | None = None, anchor: Column | str | None = None, **formatting) -> Template:
        """A run of the last paragraph that leads to a url outside or to a bookmark (``anchor``); where neither is said it is plain text.

        A url has a relationship of its own, numbered by its
        place among the template's links.
        """
        outside = F.nullif(_value(url).cast("string"), F.lit("")) if url is not None else F.lit(None).cast("string")
        inside = F.when(outside.isNull(), F.nullif(_value(anchor).cast("string"), F.lit(""))) if anchor is not None else F.lit(None).cast("string")
        self._links += 1
        rel_id = F.when(outside.isNotNull(), F.lit(f"rIdLink{self._links}"))
        return self._inside(formatting, text=F.coalesce(_value(text).cast("string"), F.lit("")), url=outside, rel_id=rel_id, anchor=inside)

    def _inside(self, formatting: dict, text: Column, **what: Column) -> Template:
        if self._runs < 0:
            raise ValueError("a field or link before any paragraph")
        self._add("runs", _RUN, formatting, block_idx=self._blocks - 1, run_idx=self._runs, text=text)
        self._made["runs"][-1] |= what
        self._runs += 1
        return self

    def table(self, cells: list[list[Column | str]], **properties) -> Template:
        """A table; ``properties`` hold for all of its cells."""
        wide = max(map(len, cells), default=0)
        if not (ooxml.ROWS[0] <= len(cells) <= ooxml.ROWS[1] and ooxml.COLS[0] <= wide <= ooxml.COLS[1]):
            raise ValueError(f"a table of {len(cells)} x {wide}")
        for r, line in enumerate(cells):
            for c, text in enumerate(line):
                self._add("cells", _CELL, properties, block_idx=self._blocks, row_idx=r, col_idx=c, text=F.coalesce(_value(text).cast("string"), F.lit("")))
        self._blocks, self._runs = self._blocks + 1, -1
        return self

    def each_table(self, children: DataFrame, key: str, order: str, cells: list[Column | str], header: list[Column | str] | None = None, **properties) -> Template:
        """A table with a row for every row of ``children`` whose ``key`` is the document's, in their order, below a ``header`` where there is one.

        ``cells`` are Columns of the children, ``header`` of the document's
        row.  Rows over the format's limit are kept and named in
        ``violations``; a document without children has the header alone, or
        no table.
        """
        if not ooxml.COLS[0] <= len(cells) <= ooxml.COLS[1] or header is not None and len(header) != len(cells):
            raise ValueError(f"a table of {len(cells)} columns")
        for c, text in enumerate(header or []):
            self._add("cells", _CELL, properties, block_idx=self._blocks, row_idx=0, col_idx=c, text=F.coalesce(_value(text).cast("string"), F.lit("")))
        unknown = properties.keys() - _CELL.keys()
        if unknown:
            raise ValueError(f"cells have no {', '.join(sorted(unknown))}")
        at = self._numbered(children, key, order) + int(header is not None)
        each = children.withColumn("_at", at).select(F.col(key).cast("string").alias("doc_id"), F.col("_at").alias("row_idx"), F.posexplode(F.array(*(F.coalesce(_value(c).cast("string"), F.lit("")) for c in cells))).alias("col_idx", "text"), *(_value(v).cast(_CELL[c]).alias(c) for c, v in properties.items()))
        over = F.when(F.col("row_idx") >= ooxml.ROWS[1], F.array(F.lit("rows"))).otherwise(F.array().cast("array<string>"))
        self._each["cells"].append((each.withColumns({"block_idx": F.lit(self._blocks), "violations": over}), list(properties)))
        self._blocks, self._runs = self._blocks + 1, -1
        return self

    def each_paragraph(self, children: DataFrame, key: str, order: str, text: Column | str, style_id: Column | str | None = None, **formatting) -> Template:
        """A paragraph of one run for every row of ``children`` whose ``key`` is the document's, in their order; all of them stand in one place of the template.

        Blocks are then numbered with room for the children between two
        places, so that later blocks follow however many there are.
        """
        unknown = formatting.keys() - _RUN.keys()
        if unknown:
            raise ValueError(f"runs have no {', '.join(sorted(unknown))}")
        self._room = True
        at = F.lit(self._blocks).cast("long") * ROOM + self._numbered(children, key, order)
        doc = F.col(key).cast("string").alias("doc_id")
        none = F.array().cast("array<string>").alias("violations")
        run = children.select(doc, at.alias("block_idx"), F.lit(0).alias("run_idx"), F.coalesce(_value(text).cast("string"), F.lit("")).alias("text"), *(_value(v).cast(_RUN[c]).alias(c) for c, v in formatting.items()), none)
        about = children.select(doc, at.alias("block_idx"), _value(style_id).cast("string").alias("style_id"), none)
        self._each["runs"].append((run, list(formatting)))
        self._each["paragraphs"].append((about, ["style_id"]))
        self._blocks, self._runs = self._blocks + 1, -1
        return self

    @staticmethod
    def _numbered(children: DataFrame, key: str, order: str) -> Column:
        return F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1

    def section(self, last: bool = False, **properties) -> Template:
        """Ends a section here; ``last`` sets the document's final one."""
        self._add("sections", _SECTION, properties, section_idx=len(self._made["sections"]), block_idx=None if last else self._blocks)
        self._blocks, self._runs = self._blocks + (not last), -1
        return self

    def build(self) -> dict[str, DataFrame]:
        """The kinds there are of runs, paragraphs, cells and sections, with ``violations``."""
        known = {"runs": _RUN | _INSIDE, "paragraphs": _PARAGRAPH, "cells": _CELL, "sections": _SECTION}
        rules = {"runs": edits.set_run, "paragraphs": edits.set_paragraph, "cells": edits.set_cell, "sections": edits.set_section}
        out = {}
        for kind, made in self._made.items():
            keys = [*_KEYS[kind], *(["text"] if kind in ("runs", "cells") else [])]
            if made:
                used = [c for c in known[kind] if any(c in m for m in made)]
                null = lambda m, c: F.lit(None).cast(known[kind][c]) if c not in m else m[c]  # noqa: B023, E731
                one = [F.struct(*((m[c] if isinstance(m[c], Column) else F.lit(m[c]).cast("int")).alias(c) for c in keys), *(null(m, c).alias(c) for c in used)) for m in made]
                each = self.rows.select(F.col(self.key).cast("string").alias("doc_id"), F.explode(F.array(*one)).alias("made"))
                bare = each.select("doc_id", *(F.col(f"made.{c}").alias(c) for c in keys), *(F.lit(None).cast(known[kind][c]).alias(c) for c in used), "made")
                out[kind] = rules[kind](bare, **{c: F.col(f"made.{c}") for c in used}).drop("made")
                if self._room:
                    out[kind] = out[kind].withColumn("block_idx", F.col("block_idx").cast("long") * ROOM)
            for rows, used in self._each.get(kind, []):
                if kind == "cells" and self._room:
                    rows = rows.withColumn("block_idx", F.col("block_idx").cast("long") * ROOM)
                rows = rows.join(merged(self.rows.select(F.col(self.key).cast("string").alias("doc_id"))), "doc_id", "left_semi")
                told = rows.select(*(F.col(c) for c in rows.columns if c not in used), *(F.col(c).alias(f"_new_{c}") for c in used), *(F.lit(None).cast(known[kind][c]).alias(c) for c in used))
                more = rules[kind](told, **{c: F.col(f"_new_{c}") for c in used}).drop(*(f"_new_{c}" for c in used))
                out[kind] = out[kind].unionByName(more, allowMissingColumns=True) if kind in out else more
        return out

    def packages(self) -> DataFrame:
        """doc_id, content: the packages of ``build``'s rows."""
        documents, about, links = self._written()
        return sink.assemble(documents, about, parts=links)

    def nodes(self, *kinds: str) -> DataFrame:
        """The XML nodes of ``packages``, made and read in one pass (``assemble_and_scan``)."""
        documents, about, links = self._written()
        return sink.assemble_and_scan(documents, *kinds, metadata=about, parts=links)

    def _written(self) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """doc_id and document_xml, the documents' metadata and their links."""
        if not self._blocks:
            raise ValueError("an empty document")
        made = {k: x.drop("violations") for k, x in self.build().items()}
        blocks, links = [], None
        if "paragraphs" in made:
            runs = made.get("runs")
            if runs is not None and "url" in runs.columns:
                outside = runs.filter("url is not null")
                links = outside.select("doc_id", "rel_id", F.lit("hyperlink").alias("rel_kind"), F.col("url").alias("target"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("binary").alias("data"), F.lit("External").alias("target_mode"))
                runs = runs.drop("url")
            if runs is None:
                runs = made["paragraphs"].select("doc_id", "block_idx", F.lit(0).alias("run_idx"), F.lit("").alias("text"))
            blocks.append(sink.paragraph_xml(runs, made["paragraphs"]))
        if "cells" in made:
            blocks.append(sink.table_xml(made["cells"]))
        rows = blocks[0] if blocks else made["sections"].select("doc_id", F.lit(0).alias("block_idx"), F.lit("").alias("xml"))
        for more in blocks[1:]:
            rows = rows.unionByName(more)
        about = self.rows.select(F.col(self.key).cast("string").alias("doc_id"), *(c.cast("string").alias(k) for k, c in self.metadata.items())) if self.metadata else None
        return sink.document_xml(rows, sections=made.get("sections")), about, links
