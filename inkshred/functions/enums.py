"""The format's words as the model's: each kind with the value of what is not known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# For each kind its words and what they mean, and the meaning of any other.  Alignments and line rules are told apart by case, the others are not.
EXACT = {
    "alignment": ({"left": "left", "center": "center", "right": "right", "both": "justify", "distribute": "distribute"}, "left"),
    "line_rule": ({"exact": "exact", "atLeast": "atLeast", "auto": "auto"}, "auto"),
}
LOWER = {
    "orientation": ({"landscape": "landscape", "portrait": "portrait"}, "portrait"),
    "section_break": ({"nextpage": "nextPage", "continuous": "continuous", "evenpage": "evenPage", "oddpage": "oddPage"}, "nextPage"),
    "header_type": ({"first": "first", "even": "even", "default": "default"}, "default"),
    "underline": ({"none": "none", "single": "single", "double": "double", "thick": "thick", "dotted": "dotted", "dash": "dashed", "wave": "wave"}, "none"),
    "highlight": ({x.lower(): x for x in ("none", "yellow", "green", "cyan", "magenta", "blue", "red", "darkBlue", "darkCyan", "darkGreen", "darkMagenta", "darkRed", "darkYellow", "darkGray", "lightGray")}, "none"),
    "wrap": ({"bothsides": "square", "left": "square", "right": "square", "square": "square", "tight": "tight", "through": "through", "topandbottom": "topBottom", "none": "none", "behind": "behindText", "infront": "inFrontText"}, "none"),
    "h_align": ({x: x for x in ("left", "center", "right", "inside", "outside")}, "left"),
    "v_align": ({x: x for x in ("top", "center", "bottom", "inside", "outside")}, "top"),
}
KINDS = (*EXACT, *LOWER)


def _found(kind: str, word: Column) -> Column:
    words, _ = (EXACT | LOWER)[kind]
    return F.create_map(*(F.lit(x) for pair in words.items() for x in pair))[word if kind in EXACT else F.lower(word)]


def meaning(kind: str, word: Column) -> Column:
    """What a word of the format means; the kind's own default for words that are not known, and for null."""
    return F.coalesce(_found(kind, word), F.lit((EXACT | LOWER)[kind][1]))


def known(kind: str, word: Column) -> Column:
    """Whether a word is one of its kind; a null is not."""
    return _found(kind, word).isNotNull()
