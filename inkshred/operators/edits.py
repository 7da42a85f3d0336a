"""Validated edits: DataFrame in, DataFrame out, with a ``violations`` array instead of exceptions.

A value out of range leaves the old one in place and adds its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ooxml


def _with_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    bad = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in checks.items())))
    old = F.col("violations") if "violations" in df.columns else F.array().cast("array<string>")
    return df.withColumn("violations", F.concat(old, bad))


def set_values(df: DataFrame, values: dict[str, Column], allowed: dict[str, Column]) -> DataFrame:
    """Set columns where the new value is allowed (a condition per column, null: allowed)."""
    new = {c: F.when(F.coalesce(allowed.get(c, F.lit(True)), F.lit(True)), v).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c, v in values.items()}
    return _with_checks(df, {c: allowed[c] for c in values if c in allowed}).withColumns(new)


def set_run(df: DataFrame, **values: Column) -> DataFrame:
    """Set text, font, size, underline, highlight, bold, italic, strike or color of runs."""
    v = values
    rules = {"font": lambda x: F.length(x) > 0, "size": lambda x: x.between(*ooxml.SIZE), "underline": lambda x: x.isin(*ooxml.UNDERLINES), "highlight": lambda x: x.isin(*ooxml.HIGHLIGHTS)}
    return set_values(df, v, {c: rules[c](x) for c, x in v.items() if c in rules})


def set_paragraph(df: DataFrame, **values: Column) -> DataFrame:
    """Set style_id, alignment, indents, spacing, line, numbering and borders of paragraphs; first line and hanging exclude each other."""
    v = values
    alone = {"first_line": "hanging", "hanging": "first_line"}
    rules = {
        "style_id": lambda x: F.length(x) > 0, "alignment": lambda x: x.isin(*ooxml.ALIGNMENTS), "line_rule": lambda x: x.isin(*ooxml.LINE_RULES),
        "indent_left": lambda x: x.between(*ooxml.INDENT), "indent_right": lambda x: x.between(*ooxml.INDENT),
        "spacing_before": lambda x: x.between(*ooxml.SPACING), "spacing_after": lambda x: x.between(*ooxml.SPACING), "line_value": lambda x: x.between(*ooxml.SPACING),
        "num_level": lambda x: x.between(*ooxml.LEVELS), "num_id": lambda x: x >= 0,
    }
    checks = {c: rules[c](x) for c, x in v.items() if c in rules}
    for c in alone.keys() & v.keys():
        other = v.get(alone[c], F.col(alone[c]) if alone[c] in df.columns else F.lit(0))
        checks[c] = v[c].between(0, ooxml.INDENT[1]) & ((v[c] == 0) | (F.coalesce(other, F.lit(0)) == 0))
    return set_values(df, v, checks)


def set_section(df: DataFrame, **values: Column) -> DataFrame:
    """Set width, height, margin_*, orientation and columns of sections."""
    rule = lambda c, x: x > 0 if c in ("width", "height") else x >= 0 if c.startswith("margin_") else x.isin(*ooxml.ORIENTATIONS) if c == "orientation" else x.between(*ooxml.COLUMNS)
    return set_values(df, values, {c: rule(c, x) for c, x in values.items() if c not in ("margin_header", "margin_footer")})


def set_cell(df: DataFrame, **values: Column) -> DataFrame:
    """Set width, v_align, grid_span, v_merge, shading, borders or text of cells."""
    rules = {"width": lambda x: x >= 0, "v_align": lambda x: x.isin(*ooxml.CELL_ALIGNMENTS), "grid_span": lambda x: x >= 1, "v_merge": lambda x: x.isin(*ooxml.V_MERGES)}
    return set_values(df, values, {c: rules[c](x) for c, x in values.items() if c in rules})


def border(style: Column | str, size: Column | int = 4, color: Column | str = "auto") -> Column:
    """A side's value for border_top, border_left, border_bottom and border_right of paragraphs and cells; a line that is not known is none."""
    said = lambda x: x if isinstance(x, Column) else F.lit(x)
    line = said(style)
    return F.struct(F.when(line.isin(*ooxml.BORDER_LINES), line).otherwise("none").alias("style"), said(size).cast("long").alias("size"), said(color).alias("color"))


def replace_text(df: DataFrame, old: str, new: str, column: str = "text") -> DataFrame:
    """Runs whose whole text equals ``old`` get ``new``."""
    return df.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


def add_blocks(blocks: DataFrame, added: DataFrame, key: str = "doc_id", order: str = "block_idx") -> DataFrame:
    """Append rows (their own order counts from 0) after the last block of their document."""
    last = blocks.groupBy(key).agg((F.max(order) + 1).alias("_next"))
    moved = added.join(last, key, "left").withColumn(order, F.col(order) + F.coalesce("_next", F.lit(0))).drop("_next")
    return blocks.unionByName(moved, allowMissingColumns=True)


def _scripted(cells: DataFrame, script: DataFrame, key: str, order: str) -> DataFrame:
    """(key, rows, refused): the old indexes of a table's rows in their new order (null: a new row), and the seq of the edits out of range.

    An ordered fold for each table over its edits, whose state is the list of
    rows; tables hold 1,000 rows at most.
    """
    size = cells.groupBy(key).agg((F.max(order) + 1).cast("int").alias("_n"))
    lists = script.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "op", F.col("at").cast("int").alias("at")))).alias("_edits"))
    x = lists.join(size, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rows = F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array().cast("array<int>"))

    def step(state: Column, e: Column) -> Column:
        rows, n, at = state["rows"], F.size(state["rows"]), e["at"]
        fits = F.coalesce((at >= 0) & (((e["op"] == "insert") & (at <= n) & (F.col("_n") > 0)) | ((e["op"] == "delete") & (at < n))), F.lit(False))
        more = F.when(e["op"] == "insert", F.array(F.lit(None).cast("int"))).otherwise(F.array().cast("array<int>"))
        skip = F.when(e["op"] == "insert", 0).otherwise(1)
        here = F.when(fits, at).otherwise(0)
        moved = F.concat(F.slice(rows, F.lit(1), here), more, F.slice(rows, here + skip + 1, F.greatest(n - here, F.lit(0))))
        return F.struct(F.when(fits, moved).otherwise(rows).alias("rows"), F.when(fits, state["refused"]).otherwise(F.concat(state["refused"], F.array(e["seq"].cast("long")))).alias("refused"))

    start = F.struct(rows.alias("rows"), F.array().cast("array<bigint>").alias("refused"))
    return x.select(key, F.aggregate("_edits", start, step).alias("s")).select(key, "s.rows", "s.refused")


def edit_rows(cells: DataFrame, script: DataFrame, key: str = "table_id", order: str = "row_idx") -> DataFrame:
    """Cells after a script of row edits (key, seq, op, at), each made on what those before it left.

    op ``insert``: an empty row at index ``at`` (0 to the number of rows then),
    with a cell for every column of its table, all other values null;
    ``delete``: the row at ``at``.  An edit out of range, with another op or
    with a null changes nothing; ``script_violations`` names it.  Tables
    without edits stay as they are.
    """
    kinds = dict(cells.dtypes)
    new = _scripted(cells, script, key, order).select(key, F.posexplode("rows").alias("_to", "_from"))
    edited = script.select(key).distinct()
    moved = cells.join(edited, key, "left_semi").join(new.filter("_from is not null"), (cells[key] == new[key]) & (cells[order] == F.col("_from"))).select(*(F.col("_to").cast(kinds[order]).alias(c) if c == order else cells[c] for c in cells.columns))
    empty = cells.select(key, "col_idx").distinct().join(new.filter("_from is null"), key).select(key, "col_idx", F.col("_to").cast(kinds[order]).alias(order))
    return cells.join(edited, key, "left_anti").unionByName(moved).unionByName(empty, allowMissingColumns=True)


def script_violations(cells: DataFrame, script: DataFrame, key: str = "table_id", order: str = "row_idx") -> DataFrame:
    """(key, seq): the edits of a script that changed nothing."""
    return _scripted(cells, script, key, order).select(key, F.explode("refused").alias("seq"))


def _as_script(edits: DataFrame, op: str, key: str) -> DataFrame:
    """Edits (key, at) of one kind as a script in which each index is that of the table before: the last one first."""
    return edits.select(key, F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("at"))).alias("seq"), F.lit(op).alias("op"), "at")


def insert_row(cells: DataFrame, edits: DataFrame, key: str = "table_id", order: str = "row_idx") -> DataFrame:
    """Insert empty rows at the indexes ``at`` (0 to the number of rows, of the table as it is) of the tables named in ``edits`` (key, at), any number a table.

    Rows from an index on move down; a new row has a cell for every column of
    its table, all other values null.  An index out of range changes nothing.
    """
    return edit_rows(cells, _as_script(edits, "insert", key), key, order)


def delete_row(cells: DataFrame, edits: DataFrame, key: str = "table_id", order: str = "row_idx") -> DataFrame:
    """Delete the rows at the indexes ``at`` of the tables named in ``edits`` (key, at), any number a table; those below move up, an index out of range changes nothing, nor does one named again."""
    return edit_rows(cells, _as_script(edits.select(key, "at").distinct(), "delete", key), key, order)


def row_violations(cells: DataFrame, edits: DataFrame, last: int = 0, key: str = "table_id", order: str = "row_idx") -> DataFrame:
    """Edits (key, at) with ``violations``: those whose table or row does not exist (last = 1: an insertion may also stand at the end)."""
    size = cells.groupBy(key).agg((F.max(order) + 1).alias("_rows"))
    x = edits.join(size, key, "left")
    return _with_checks(x, {"table": F.col("_rows").isNotNull(), "row": F.col("at").between(0, F.col("_rows") - 1 + last)}).drop("_rows")


def table_violations(tables: DataFrame) -> DataFrame:
    """Dimension checks of new tables (n_rows, n_cols)."""
    return _with_checks(tables, {"rows": F.col("n_rows").between(*ooxml.ROWS), "cols": F.col("n_cols").between(*ooxml.COLS)})


def merge_cells(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Merge rectangles (table_id, region_id, r0, c0, rows, cols) of cells (table_id, row_idx, col_idx).

    A rectangle that leaves its table, or meets one of a smaller region_id
    that was merged, is refused, as ``merge_violations`` reports it.

    The first row of a rectangle spans ``cols`` columns; its other rows
    continue it; cells right of the first column are continuations that a
    sink leaves out.  One range join on the table's key.
    """
    size = cells.groupBy("table_id").agg((F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols"))
    r = accepted(regions, size).select(F.col("table_id").alias("_t"), "r0", "c0", "rows", "cols")
    inside = (F.col("table_id") == F.col("_t")) & F.col("row_idx").between(F.col("r0"), F.col("r0") + F.col("rows") - 1) & F.col("col_idx").between(F.col("c0"), F.col("c0") + F.col("cols") - 1)
    x = cells.join(r, inside, "left")
    hit = F.col("r0").isNotNull()
    first_col, first_row = F.col("col_idx") == F.col("c0"), F.col("row_idx") == F.col("r0")
    span = F.when(hit & first_col, F.col("cols")).otherwise(F.lit(1))
    merge = F.when(~hit | (F.col("rows") == 1) | ~first_col, "none").when(first_row, "restart").otherwise("continue")
    return x.withColumn("grid_span", span).withColumn("v_merge", merge).withColumn("h_merge_continuation", F.coalesce(hit & ~first_col, F.lit(False))).drop("_t", "r0", "c0", "rows", "cols")


def accepted(regions: DataFrame, tables: DataFrame) -> DataFrame:
    """The rectangles that lie in their table and meet no accepted one before them (by region_id).

    A fold over a table's rectangles in order: each is held against those
    accepted so far.
    """
    x = regions.join(tables.select("table_id", "n_rows", "n_cols"), "table_id")
    x = x.filter("rows > 0 and cols > 0 and r0 >= 0 and c0 >= 0 and r0 + rows <= n_rows and c0 + cols <= n_cols")
    of = "region_id", "r0", "c0", "rows", "cols"
    every = F.array_sort(F.collect_list(F.struct(*of)))

    def meets(a: Column, b: Column) -> Column:
        return (a["r0"] < b["r0"] + b["rows"]) & (b["r0"] < a["r0"] + a["rows"]) & (a["c0"] < b["c0"] + b["cols"]) & (b["c0"] < a["c0"] + a["cols"])

    x = x.groupBy("table_id").agg(every.alias("every"))
    kept = F.aggregate("every", F.slice("every", 1, 0), lambda s, r: F.when(F.exists(s, lambda o: meets(o, r)), s).otherwise(F.concat(s, F.array(r))))
    return x.select("table_id", F.explode(kept).alias("r")).select("table_id", *(F.col("r")[c].alias(c) for c in of))


def merge_violations(regions: DataFrame, tables: DataFrame) -> DataFrame:
    """Rectangles with out_of_bounds and overlaps (with an earlier region_id of the table)."""
    r = regions.join(tables.select("table_id", "n_rows", "n_cols"), "table_id", "left")
    out = (F.col("rows") < 1) | (F.col("cols") < 1) | (F.col("r0") + F.col("rows") > F.col("n_rows")) | (F.col("c0") + F.col("cols") > F.col("n_cols"))
    a, b = r.withColumn("out_of_bounds", out).alias("a"), regions.alias("b")
    touch = F.expr("a.table_id = b.table_id and b.region_id < a.region_id and a.r0 < b.r0 + b.rows and b.r0 < a.r0 + a.rows and a.c0 < b.c0 + b.cols and b.c0 < a.c0 + a.cols")
    hits = a.join(b, touch, "left").groupBy("a.table_id", "a.region_id", "a.out_of_bounds").agg(F.count("b.region_id").alias("overlaps"))
    return hits.select("table_id", "region_id", "out_of_bounds", "overlaps")


def document_violations(docs: DataFrame, most_chars: int = 20000, most_blocks: int = 100) -> DataFrame:
    """(doc_id, violations): documents without text, or beyond the given limits, with what is wrong."""
    lines = F.size(F.split("text", "\n"))
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.array_join(F.array_compact(F.array(F.when(F.length(text) == 0, "empty"), F.when(F.length(text) > most_chars, "chars"), F.when(lines > most_blocks, "blocks"))), ",").alias("violations")).filter("violations != ''")


def number_rows(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Ids 1, 2, .. per document in order: what counters hand out, without a counter."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)))
