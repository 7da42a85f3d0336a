"""Vocabulary and limits of the document format. Fixed values, stated as they must be."""

from __future__ import annotations

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
CONTENT_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
CORE = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
EXTENDED = "http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"
WORD_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml."

#: Units: twips, English metric units and pixels at 96 dpi.
TWIPS_PER_INCH, TWIPS_PER_POINT, EMU_PER_INCH, EMU_PER_PIXEL, EMU_PER_TWIP, DPI = 1440, 20, 914400, 9525, 635, 96
#: Limits of validated edits.
SIZE = (2, 3276)
INDENT = (-31680, 31680)
SPACING = (0, 31680)
ROWS, COLS, COLUMNS = (1, 1000), (1, 63), (1, 10)
LEVELS = (0, 8)

PAGE_SIZES = {"A4": (11906, 16838), "Letter": (12240, 15840), "Legal": (12240, 20160), "A3": (16838, 23811), "Tabloid": (15840, 24480)}
MARGINS = {"top": 1440, "right": 1440, "bottom": 1440, "left": 1440, "header": 720, "footer": 720}
DEFAULT_FONT, DEFAULT_SIZE, DEFAULT_LINE = "Calibri", 22, 240

ALIGNMENTS = ("left", "center", "right", "both", "distribute")
LINE_RULES = ("auto", "exact", "atLeast")
UNDERLINES = ("none", "single", "double", "thick", "dotted", "dash", "wave")
HIGHLIGHTS = ("none", "yellow", "green", "cyan", "magenta", "blue", "red", "darkBlue", "darkCyan", "darkGreen", "darkMagenta", "darkRed", "darkYellow", "darkGray", "lightGray")
BREAKS = ("page", "column", "line")
ORIENTATIONS = ("portrait", "landscape")
SECTION_BREAKS = ("nextPage", "continuous", "evenPage", "oddPage")
CELL_ALIGNMENTS = ("top", "center", "bottom")
V_MERGES = ("none", "restart", "continue")

#: A field's type follows the first of these its instruction begins with.
FIELD_PREFIXES = ("PAGE", "NUMPAGES", "TOC", "DATE", "TIME", "STYLEREF", "SEQ", "REF", "HYPERLINK")
FIELD_RESULTS = {"PAGE": "1", "NUMPAGES": "1", "TOC": "Table of Contents", "DATE": "1/1/2025", "TIME": "12:00:00", "SEQ": "1"}
FIELD_CODES = {"PAGE": "PAGE", "NUMPAGES": "NUMPAGES", "TOC": r'TOC \\o "1-3" \\h \\z \\u', "DATE": "DATE", "TIME": "TIME", "STYLEREF": 'STYLEREF "Heading 1"', "SEQ": "SEQ Figure", "REF": "REF", "HYPERLINK": "HYPERLINK"}

#: Raster formats by file ending and their media types.
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "webp": "image/webp", "wmf": "image/x-wmf", "emf": "image/x-emf"}
#: Parts with a place of their own in a package.
KNOWN_PARTS = {
    "[content_types].xml": "content_types", "_rels/.rels": "rels", "word/_rels/document.xml.rels": "document_rels", "word/document.xml": "document", "word/styles.xml": "styles",
    "word/numbering.xml": "numbering", "word/fonttable.xml": "font_table", "word/settings.xml": "settings", "word/websettings.xml": "web_settings", "word/theme/theme1.xml": "theme",
    "docprops/core.xml": "core_properties", "docprops/app.xml": "app_properties", "docprops/custom.xml": "custom_properties",
}
ERROR_CODES = ("INVALID_STATE", "VALIDATION_ERROR", "IO_ERROR", "XML_ERROR", "NOT_FOUND", "UNSUPPORTED", "INTERNAL_ERROR")

# Border lines, and the sides of a border in the order of the format.
BORDER_LINES = ("none", "single", "dotted", "dashed", "double", "triple", "thick")
BORDER_SIDES = ("top", "left", "bottom", "right")

# The properties of a run in the order of the format.
RUN_PROPERTIES = (
    "rStyle", "rFonts", "b", "bCs", "i", "iCs", "caps", "smallCaps", "strike", "dstrike", "outline", "shadow", "emboss", "imprint", "noProof", "snapToGrid", "vanish", "webHidden", "color", "spacing", "w", "kern", "position",
    "sz", "szCs", "highlight", "u", "effect", "bdr", "shd", "fitText", "vertAlign", "rtl", "cs", "em", "lang", "eastAsianLayout", "specVanish", "oMath",
)
