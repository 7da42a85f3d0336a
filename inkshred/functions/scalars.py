"""Scalar functions of the document format, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..ooxml import DPI, EMU_PER_INCH, EMU_PER_PIXEL, FIELD_PREFIXES, MEDIA_TYPES


def to_hex(r: Column, g: Column, b: Column) -> Column:
    """Channels 0 to 255 as RRGGBB."""
    return F.concat(*(F.lpad(F.hex(x), 2, "0") for x in (r, g, b)))


def from_hex(text: Column) -> Column:
    """struct(r, g, b) of RGB or RRGGBB with or without #; null for anything else."""
    x = F.regexp_extract(text, r"^#?([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6})$", 1)
    long = F.when(F.length(x) == 3, F.regexp_replace(x, "(.)", "$1$1")).otherwise(x)
    channel = lambda i: F.conv(F.substring(long, i, 2), 16, 10).cast("smallint")
    return F.when(x != "", F.struct(channel(1).alias("r"), channel(3).alias("g"), channel(5).alias("b")))


def is_color(text: Column) -> Column:
    """Whether a text is a colour ``from_hex`` reads."""
    return F.coalesce(text.rlike(r"^#?([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6})$"), F.lit(False))


def default_position() -> Column:
    """Where a picture stands that nothing places: inline, left and top, no offset, square wrap, before the text."""
    return F.struct(F.lit("inline").alias("type"), F.lit("left").alias("h_align"), F.lit("top").alias("v_align"), F.lit(0).cast("long").alias("offset_x"), F.lit(0).cast("long").alias("offset_y"), F.lit("square").alias("wrap"), F.lit(0).alias("z_order"), F.lit(False).alias("behind_text"))


def pixels_to_emu(px: Column) -> Column:
    return px.cast("long") * EMU_PER_PIXEL


def inches_to_pixels(x: Column) -> Column:
    return (x * DPI).cast("int")


def inches_to_emu(x: Column) -> Column:
    return (x * EMU_PER_INCH).cast("long")


def emu_to_pixels(emu: Column) -> Column:
    """Rounded half up; nothing below one."""
    return F.when(emu <= 0, F.lit(0).cast("long")).otherwise(F.floor((emu + EMU_PER_PIXEL // 2) / F.lit(EMU_PER_PIXEL)))


def resized(width: Column, height: Column, old_width: Column, old_height: Column) -> Column:
    """struct(width, height): a side of 0 follows from the other and the old aspect; null where both are 0."""
    w = F.when(width == 0, (height * (old_width / old_height)).cast("int")).otherwise(width)
    h = F.when(height == 0, (width * (old_height / old_width)).cast("int")).otherwise(height)
    return F.when((width > 0) | (height > 0), F.struct(w.alias("width"), h.alias("height")))


def part_name(name: Column) -> Column:
    """Forward slashes, no leading ./ or /, lower case."""
    return F.lower(F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), r"^(\./|/)+", ""))


def media_path(target: Column) -> Column:
    """A relationship target as a part name below word/."""
    bare = F.regexp_replace(F.replace(target, F.lit("\\"), F.lit("/")), r"^(\.\./|\./|/)+", "")
    return F.lower(F.when(F.lower(bare).startswith("word/"), bare).otherwise(F.concat(F.lit("word/"), bare)))


def strict_int(text: Column) -> Column:
    """An optional sign and digits, nothing else; null otherwise."""
    return F.when(text.rlike(r"^[+-]?[0-9]{1,18}$"), text.try_cast("long"))


def media_type(name: Column) -> Column:
    ending = F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))
    return F.coalesce(F.create_map(*(F.lit(x) for p in MEDIA_TYPES.items() for x in p))[ending], F.lit("application/octet-stream"))


def field_type(instruction: Column) -> Column:
    """The first known prefix of the upper-cased instruction, in fixed order, else CUSTOM."""
    text = F.upper(F.trim(instruction))
    out = F.lit("CUSTOM")
    for prefix in reversed(FIELD_PREFIXES):
        out = F.when(text.startswith(prefix), F.lit(prefix)).otherwise(out)
    return out


def quoted(text: Column) -> Column:
    """All double-quoted substrings."""
    return F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1))


def hyperlink_url(instruction: Column) -> Column:
    """The url of a HYPERLINK instruction; with \\l a # goes before it."""
    first = F.get(quoted(instruction), F.lit(0))
    return F.when(F.contains(instruction, F.lit("\\l")), F.concat(F.lit("#"), first)).otherwise(first)


def text_after_round_trip(text: Column) -> Column:
    """What a run's text is after one save and open: its lines that are not blank, put together."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?U)\S")), "")
