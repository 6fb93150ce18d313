"""Content features of word-processing packages: rules over XML events, one pass over a package, one row a document."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import FIELD_KINDS, HIDDEN, SCRIPTS
from ..sources.packages import Reader, Refused, pieces, read_parts

# Namespaces: a short name for each vocabulary, and the addresses it goes by.
_OPEN, _MS, _STRICT = "http://schemas.openxmlformats.org/", "http://schemas.microsoft.com/office/", "http://purl.oclc.org/ooxml/"
_SPACES = {
    "a": [_OPEN + "drawingml/2006/main"],
    "a+": [_MS + "drawing/" + x for x in ("2010/main", "2012/main", "2014/main", "2016/11/main", "2016/SVG/main", "2017/decorative", "2018/hyperlinkcolor")],
    "aink": [_MS + "drawing/2016/ink"],
    "am3d": [_MS + "drawing/2017/model3d"],
    "app": [_OPEN + "officeDocument/2006/extended-properties"],
    "c": [_OPEN + "drawingml/2006/chart", _OPEN + "drawingml/2006/chartDrawing"] + [_MS + f"drawing/{x}/chart" for x in ("2007/8/2", "2012", "2014", "2015/06", "2017/03")],
    "cs": [_MS + "drawing/2012/chartStyle"],
    "cx": [_MS + f"drawing/{x}/chartex" for x in ("2014", "2015/9/8", "2015/10/21", *(f"2016/5/{n}" for n in range(9, 15)))],
    "dgm": [_OPEN + "drawingml/2006/diagram", _MS + "drawing/2010/diagram", _MS + "drawing/2008/diagram"],
    "lc": [_OPEN + "drawingml/2006/lockedCanvas"],
    "m": [_OPEN + "officeDocument/2006/math"],
    "mc": [Reader.COMPATIBILITY],
    "o": ["urn:schemas-microsoft-com:office:office"],
    "pic": [_OPEN + "drawingml/2006/picture"],
    "v": ["urn:schemas-microsoft-com:vml"],
    "w": [_OPEN + "wordprocessingml/2006/main"],
    "w10": ["urn:schemas-microsoft-com:office:word"],
    "w14": [_MS + "word/2010/wordml"],
    "w15": [_MS + "word/2012/wordml"],
    "w16": [_MS + "word/" + x for x in ("2015/wordml/symex", "2016/wordml/cid", "2018/wordml", "2018/wordml/cex", "2020/wordml/sdtdatahash", "2023/wordml/word16du", "2024/wordml/sdtformatlock")],
    "wne": [_MS + "word/2006/wordml"],
    "wp": [_OPEN + "drawingml/2006/wordprocessingDrawing"],
    "wp14": [_MS + "word/2010/wordprocessingDrawing"],
    "wpc": [_MS + "word/2010/wordprocessingCanvas"],
    "wpg": [_MS + "word/2010/wordprocessingGroup"],
    "wpi": [_MS + "word/2010/wordprocessingInk"],
    "wps": [_MS + "word/2010/wordprocessingShape"],
    "-": [_OPEN + "officeDocument/2006/" + x for x in ("relationships", "custom-properties", "docPropsVTypes", "customXml")]
    + [_OPEN + x for x in ("package/2006/content-types", "package/2006/relationships", "package/2006/metadata/core-properties", "schemaLibrary/2006/main")]
    + ["http://purl.org/dc/elements/1.1/", "http://purl.org/dc/terms/", "http://purl.org/dc/dcmitype/", _MS + "thememl/2012/main", _MS + "2019/extlst", "http://www.w3.org/2001/XMLSchema-instance", "http://www.w3.org/XML/1998/namespace"],
}
_STRICT_SPACES = {"wordprocessingml/main": "w", "officeDocument/math": "m", "drawingml/main": "a", "drawingml/wordprocessingDrawing": "wp", "drawingml/picture": "pic", "drawingml/lockedCanvas": "lc", "drawingml/chart": "c", "drawingml/chartDrawing": "c", "drawingml/diagram": "dgm", "officeDocument/extendedProperties": "app"}
_STRICT_SPACES |= dict.fromkeys(("officeDocument/relationships", "officeDocument/customProperties", "officeDocument/docPropsVTypes", "officeDocument/customXml", "schemaLibrary/main"), "-")
KNOWN = {uri: short for short, uris in _SPACES.items() for uri in uris} | {_STRICT + tail: short for tail, short in _STRICT_SPACES.items()}

#: Relationship types by their last segment: the role of the part they lead to, or nothing where it is not read.
ROLES = {"officeDocument": "document", "styles": "styles", "numbering": "numbering", "settings": "settings", "fontTable": "fontTable", "theme": "theme", "header": "header", "footer": "footer", "footnotes": "footnotes", "endnotes": "endnotes", "comments": "comments", "commentsExtended": "extensions", "commentsIds": "extensions", "commentsExtensible": "extensions", "people": "extensions", "chart": "chart", "chartEx": "chart"}
OTHER_TYPES = set("""aFChunk activeXControlBinary attachedTemplate attachedToolbars certificate chartColorStyle chartStyle chartUserShapes control custom-properties
customXml customXmlProps core-properties diagramColors diagramData diagramDrawing diagramLayout diagramQuickStyle documenttasks extended-properties font frame glossaryDocument hyperlink image
keyMapCustomizations mailMergeHeaderSource mailMergeSource model3d oleObject origin package printerSettings recipientData signature stylesWithEffects subDocument themeOverride thumbnail transform
vbaProject webSettings wordVbaData""".split())  # fmt: skip
STORIES = {"document", "header", "footer", "footnotes", "endnotes", "comments"}

Predicate = Callable[[dict], bool]


def on(value: str | None) -> bool:
    """An on/off attribute: absent means on."""
    return value is None or value.strip().lower() not in ("0", "false", "off", "none")


def number(value: str | None) -> float | None:
    try:
        return float((value or "").strip().rstrip("%"))
    except ValueError:
        return None


def other(*usual: str) -> Predicate:
    return lambda x: "val" in x and x["val"].strip() not in usual


def number_other_than(usual: float) -> Predicate:
    return lambda x: "val" in x and number(x["val"]) != usual


def shades(x: dict) -> bool:
    """A pattern other than clear, or a fill other than auto; nil never shades."""
    pattern = x.get("val", "clear").strip()
    return pattern != "nil" and (pattern != "clear" or x.get("fill", "auto").strip() != "auto")


def has(*names: str) -> Predicate:
    return lambda x: any(n in x for n in names)


def switched(x: dict) -> bool:
    return on(x.get("val"))


def off(x: dict) -> bool:
    return not on(x.get("val"))


def always(_: dict) -> bool:
    return True


def level(x: dict) -> bool:
    return number(x.get("val")) in range(9)


def turned(x: dict) -> bool:
    """A text direction other than left to right, top to bottom."""
    return "val" in x and x["val"].strip() not in ("lrTb", "tb")


def equation_program(x: dict) -> bool:
    program = x.get("ProgID", x.get("progId", "")).strip().lower()
    return program.startswith("equation.") or "mathtype" in program


#: Sections of the coverage table, and the features of each: key and name. Their number is 139.
SECTIONS: dict[str, dict[str, str]] = {
    "Package and document structure": {
        "Opc": "OPC package, content types, relationships",
        "Compatibility": "Markup Compatibility (AlternateContent, Ignorable)",
        "Strict": "Strict OOXML namespace variant",
        "Unknown": "Unknown parts and extensions preserved",
        "Properties": "Core, app and custom properties",
        "CustomXml": "Custom XML parts",
        "Glossary": "Glossary document (building blocks)",
        "EmbeddedFonts": "Embedded fonts",
        "Encryption": "Password encryption (Agile)",
        "Signatures": "Digital signatures",
        "Vba": "VBA project",
    },
    "Characters and runs": {
        "TextTabsBreaksSymbols": "Text, tabs, breaks, symbols",
        "RunFonts": "Fonts per script slot and hints",
        "SizeBoldItalic": "Size, bold, italic (incl. complex-script variants)",
        "Underline": "Underline styles and colors",
        "StrikeCapsHidden": "Strike, double strike, caps, small caps, hidden",
        "Color": "Color (incl. theme colors, tint, shade)",
        "Highlight": "Highlight and shading",
        "RaisedLowered": "Superscript, subscript, position",
        "CharacterSpacing": "Character spacing, scaling, kerning threshold",
        "TextBorders": "Borders around text",
        "EmphasisMarks": "Emphasis marks, East Asian layout options",
        "FitText": "Fit text",
        "LanguageTags": "Language tags",
        "RightToLeftRuns": "Right-to-left and complex-script flags",
        "TextEffects": "Text effects (glow, shadow, outline, reflection, fill)",
        "OpenType": "OpenType features",
        "Hyperlinks": "Hyperlinks",
        "Ruby": "Ruby (phonetic guide)",
    },
    "Paragraphs": {
        "Alignment": "Alignment (incl. distribute, Thai, kashida variants)",
        "Indentation": "Indentation (left, right, first line, hanging, chars)",
        "ParagraphSpacing": "Spacing before/after, auto spacing, contextual spacing",
        "LineSpacing": "Line spacing (auto, exact, at least)",
        "TabStops": "Tab stops (all alignments and leaders, bar tabs)",
        "KeepTogether": "Keep with next, keep lines together, page break before, widow control",
        "ParagraphBorders": "Paragraph borders and shading (with border merging)",
        "OutlineLevel": "Outline level",
        "Frames": "Drop caps and frames",
        "BidiParagraphs": "Bidirectional paragraphs",
        "AsianLineBreaking": "Snap to grid, East Asian line-breaking options",
        "LineAlignment": "Text alignment on line, text direction",
        "Suppressed": "Suppress line numbers, suppress auto hyphens",
        "MarkFormatting": "Paragraph mark formatting",
    },
    "Styles and themes": {
        "DocumentDefaults": "Document defaults",
        "Styles": "Paragraph, character, linked styles and inheritance",
        "TableStyles": "Table styles with conditional formatting",
        "NumberingStyles": "Numbering styles",
        "LatentStyles": "Latent styles",
        "Toggles": "Toggle properties semantics",
        "Theme": "Theme fonts and colors",
        "AutoRedefine": "Style auto-redefinition (honored, but never silently)",
    },
    "Numbering and lists": {
        "AbstractNumbering": "Abstract numbering and instances, level overrides",
        "NumberFormats": "Number formats (decimal, roman, letters, ordinal, cardinal text, East Asian, Hebrew, Arabic and more)",
        "LevelText": "Level text, suffix, justification, legal numbering",
        "Restart": "Restart rules",
        "PictureBullets": "Picture bullets",
        "LegacyNumbering": "Legacy numbering",
        "HeadingNumbering": "Heading outline numbering",
    },
    "Sections and page layout": {
        "PageSize": "Page size, orientation, margins, gutter",
        "SectionBreaks": "Section breaks (next page, continuous, even, odd)",
        "Columns": "Columns (equal, unequal, separator) and column balancing",
        "PageAlignment": "Vertical alignment of page",
        "PageBorders": "Page borders (including art borders)",
        "LineNumbering": "Line numbering",
        "PageNumbering": "Page numbering format and restart",
        "DocumentGrid": "Document grid (East Asian)",
        "SectionDirection": "Text direction of section, right-to-left gutter",
        "MirrorMargins": "Mirror margins, book fold, gutter at top",
    },
    "Headers and footers": {
        "HeadersFooters": "Default, first-page, even headers and footers",
        "LinkToPrevious": "Link to previous (inheritance across sections)",
        "HeaderDistances": "Header/footer distances and growth into body",
        "Watermarks": "Watermarks (VML/WordArt in header)",
    },
    "Tables": {
        "TableGrid": "Grid, widths, fixed layout",
        "Autofit": "Autofit layout algorithm",
        "CellMerges": "Horizontal and vertical merges",
        "TableBorders": "Borders (with conflict resolution) and shading",
        "CellMargins": "Cell margins and spacing",
        "RowRules": "Row height rules, cannot split, header rows",
        "RowsAcrossPages": "Rows splitting across pages",
        "NestedTables": "Nested tables",
        "FloatingTables": "Floating tables",
        "RightToLeftTables": "Right-to-left tables",
        "CellDirection": "Cell text direction, vertical alignment",
        "TableFormulas": "Table formulas",
    },
    "Fields": {
        "Fields": "Complex and simple fields, nesting",
        "PageFields": "Page fields",
        "DateAndTimeFields": "Date and time with picture switches and calendars",
        "CrossReferences": "Cross-references and sequences",
        "DocumentInformationFields": "Document information",
        "TablesOfContents": "Tables of contents and figures",
        "FormulasAndConditions": "Formulas and conditions",
        "MailMergeFields": "Mail merge fields",
        "IndexesAndAuthorities": "Indexes and authorities",
        "Citations": "Citations and bibliography",
        "LegacyFormFields": "Legacy form fields",
        "ExternalFields": "External and active fields (blocked by default)",
        "FormattingSwitches": "Formatting switches",
    },
    "Notes, comments and review": {
        "Notes": "Footnotes and endnotes (placement, numbering, separators, continuation)",
        "Comments": "Comments with threads, resolution, people",
        "TrackedText": "Tracked insertions and deletions",
        "TrackedMoves": "Tracked moves",
        "TrackedFormatting": "Tracked formatting and property changes",
        "Markup": "Markup display modes and balloons",
        "Compare": "Compare and combine documents",
        "RestrictEditing": "Restrict editing, permissions",
    },
    "Drawings and objects": {
        "Pictures": "Inline and anchored pictures",
        "ImageFormats": "Image formats (PNG, JPEG, GIF, BMP, TIFF, WebP, SVG, EMF, WMF, EMF+)",
        "PictureEffects": "Cropping, recoloring, transparency, basic effects",
        "Wrapping": "Text wrapping (square, tight, through, top and bottom, behind, in front)",
        "Positioning": "Positioning relative to page, margin, column, paragraph, line, character",
        "Shapes": "Shapes: preset and custom geometry, fills, lines, arrowheads",
        "TextBoxes": "Text boxes and linked text boxes",
        "Groups": "Groups and drawing canvases",
        "ShapeEffects": "Shape effects (shadow, glow, soft edges, 3D)",
        "WordArt": "WordArt",
        "Vml": "Legacy VML shapes and pictures",
        "Ole": "OLE objects (preview only; never activated)",
        "Ink": "Ink",
        "Models3d": "3D models",
    },
    "Equations, charts and diagrams": {
        "Equations": "Equations (OMML)",
        "LegacyEquations": "Legacy equations (Equation Editor 3, MathType as OLE with WMF preview)",
        "Charts": "Charts (bar, column, line, pie, area, scatter, combo)",
        "NewerCharts": "Newer chart types (waterfall, treemap, sunburst, histogram, box and whisker, funnel, map)",
        "Charts3d": "3D charts",
        "SmartArt": "SmartArt (from Word's drawing cache)",
    },
    "Content controls and forms": {
        "ContentControls": "Rich text, plain text, picture, checkbox, combo box, drop-down, date controls",
        "Repeating": "Repeating sections, building block galleries",
        "DataBinding": "XML data binding",
    },
    "East Asian and complex scripts": {
        "ArabicHebrew": "Arabic and Hebrew shaping and bidi",
        "Kashida": "Kashida justification",
        "Kinsoku": "Kinsoku (line-breaking rules) incl. custom lists",
        "AutoSpacing": "Auto-spacing between Asian and Latin text and numbers",
        "CharacterGrid": "Character grid",
        "VerticalText": "Vertical text",
        "CombineCharacters": "Combine characters, two lines in one, enclosed characters",
        "IndicSoutheastAsian": "Indic and Southeast Asian shaping and breaking",
    },
    "Compatibility settings": {
        "Mode15": "Compatibility mode 15 (Word 2013+)",
        "OlderModes": "Compatibility modes 14, 12, 11",
        "LegacyOptions": "Individual legacy compatibility options (dozens)",
    },
}
NAMES = {key: name for names in SECTIONS.values() for key, name in names.items()}
#: Features that no markup shows.
NEVER = ("Encryption", "RowsAcrossPages", "Markup", "Compare")

#: Rules (key, element names, predicate) of elements anywhere in a read part, by vocabulary.
_ANYWHERE: dict[str, list[tuple[str, str, Predicate]]] = {
    "w": [
        ("TextTabsBreaksSymbols", "t br cr sym", always),
        ("RunFonts", "rFonts", always),
        ("SizeBoldItalic", "sz szCs", always),
        ("SizeBoldItalic", "b bCs i iCs", switched),
        ("Underline", "u", other("none")),
        ("StrikeCapsHidden", "strike dstrike caps smallCaps vanish", switched),
        ("TextEffects", "outline shadow emboss imprint", switched),
        ("Highlight", "highlight", other("none")),
        ("RaisedLowered", "vertAlign", other("baseline")),
        ("RaisedLowered", "position", number_other_than(0)),
        ("TextBorders", "bdr", always),
        ("EmphasisMarks", "em", other("none")),
        ("EmphasisMarks", "eastAsianLayout", always),
        ("CombineCharacters", "eastAsianLayout", lambda x: any(n in x and on(x[n]) for n in ("combine", "vert"))),
        ("FitText", "fitText", always),
        ("LanguageTags", "lang", always),
        ("RightToLeftRuns", "rtl cs", switched),
        ("Hyperlinks", "hyperlink", always),
        ("Ruby", "ruby", always),
        ("ParagraphSpacing", "contextualSpacing", switched),
        ("TabStops", "tabs", always),
        ("KeepTogether", "keepNext keepLines pageBreakBefore", switched),
        ("KeepTogether", "widowControl", off),
        ("ParagraphBorders", "pBdr", always),
        ("OutlineLevel", "outlineLvl", level),
        ("Frames", "framePr", always),
        ("AsianLineBreaking", "snapToGrid wordWrap overflowPunct kinsoku autoSpaceDE autoSpaceDN", off),
        ("AsianLineBreaking", "topLinePunct", switched),
        ("Kinsoku", "kinsoku", off),
        ("Kinsoku", "noLineBreaksBefore noLineBreaksAfter", always),
        ("AutoSpacing", "autoSpaceDE autoSpaceDN", off),
        ("LineAlignment", "textAlignment", always),
        ("VerticalText", "textDirection", turned),
        ("Suppressed", "suppressLineNumbers suppressAutoHyphens", switched),
        ("DocumentDefaults", "docDefaults", always),
        ("Styles", "style", lambda x: x.get("type", "").strip() in ("paragraph", "character")),
        ("LatentStyles", "latentStyles", always),
        ("AutoRedefine", "autoRedefine", always),
        ("Theme", "rFonts", has("asciiTheme", "hAnsiTheme", "eastAsiaTheme", "cstheme")),
        ("Theme", "color shd", has("themeColor", "themeFill")),
        ("AbstractNumbering", "abstractNum num lvlOverride", always),
        ("LevelText", "lvlText suff lvlJc isLgl", always),
        ("Restart", "lvlRestart startOverride", always),
        ("PictureBullets", "numPicBullet lvlPicBulletId", always),
        ("LegacyNumbering", "legacy", always),
        ("PageSize", "pgSz pgMar", always),
        ("Columns", "cols", lambda x: (number(x.get("num")) or 0) > 1 or ("sep" in x and on(x["sep"]))),
        ("PageBorders", "pgBorders", always),
        ("LineNumbering", "lnNumType", always),
        ("PageNumbering", "pgNumType", has("fmt", "start", "chapStyle", "chapSep")),
        ("DocumentGrid", "docGrid", lambda x: x.get("type", "").strip() in ("lines", "linesAndChars", "snapToChars")),
        ("CharacterGrid", "docGrid", lambda x: x.get("type", "").strip() in ("linesAndChars", "snapToChars")),
        ("SectionDirection", "rtlGutter", switched),
        ("MirrorMargins", "mirrorMargins bookFoldPrinting bookFoldRevPrinting gutterAtTop", switched),
        ("HeadersFooters", "headerReference footerReference", always),
        ("HeadersFooters", "titlePg evenAndOddHeaders", switched),
        ("HeaderDistances", "headerReference footerReference", always),
        ("TableGrid", "tbl", always),
        ("Fields", "fldSimple fldChar", always),
        ("LegacyFormFields", "ffData", always),
        ("Notes", "footnoteReference endnoteReference", always),
        ("Comments", "commentReference commentRangeStart", always),
        ("TrackedText", "ins del", always),
        ("TrackedMoves", "moveFrom moveTo moveFromRangeStart moveToRangeStart", always),
        ("TrackedFormatting", "rPrChange pPrChange tblPrChange tcPrChange trPrChange tblGridChange tblPrExChange numberingChange sectPrChange", always),
        ("RestrictEditing", "documentProtection", lambda x: "enforcement" in x and on(x["enforcement"])),
        ("RestrictEditing", "writeProtection permStart permEnd", always),
        ("ContentControls", "sdt", always),
        ("Repeating", "docPartObj docPartList", always),
        ("DataBinding", "dataBinding", always),
        ("MailMergeFields", "mailMerge", always),
        ("EmbeddedFonts", "embedRegular embedBold embedItalic embedBoldItalic", always),
    ],
    "w14": [("TextEffects", "glow shadow textOutline textFill reflection props3d scene3d", always), ("OpenType", "ligatures numForm numSpacing stylisticSets cntxtAlts", always)],
    "w15": [("Repeating", "repeatingSection repeatingSectionItem", always), ("DataBinding", "dataBinding", always), ("Comments", "commentEx", always)],
}
#: Rules of elements by the element they stand in.
_INSIDE: list[tuple[str, str, str, Predicate]] = [
    ("Color", "rPr", "color", lambda x: other("auto")(x) or "themeColor" in x),
    ("Highlight", "rPr", "shd", shades),
    ("CharacterSpacing", "rPr", "spacing kern", number_other_than(0)),
    ("CharacterSpacing", "rPr", "w", number_other_than(100)),
    ("ParagraphBorders", "pPr", "shd", shades),
    ("ParagraphSpacing", "pPr", "spacing", has("before", "after", "beforeLines", "afterLines", "beforeAutospacing", "afterAutospacing")),
    ("LineSpacing", "pPr", "spacing", has("line")),
    ("Alignment", "pPr", "jc", other("left", "start")),
    ("Kashida", "pPr", "jc", lambda x: "Kashida" in x.get("val", "")),
    ("Indentation", "pPr", "ind", always),
    ("MarkFormatting", "pPr", "rPr", always),
    ("NumberFormats", "lvl", "numFmt", always),
    ("TabStops", "tabs", "tab", always),
    ("PageAlignment", "sectPr", "vAlign", other("top")),
    ("SectionDirection", "sectPr", "bidi", switched),
    ("SectionDirection", "sectPr", "textDirection", turned),
]
#: Rules of table formatting, which in styles count only if the document has a table.
_TABLE: list[tuple[str, str, str, Predicate]] = [
    ("TableBorders", "tcPr tblPr", "shd", shades),
    ("CellDirection", "tcPr", "vAlign", other("top")),
    ("CellDirection", "tcPr", "textDirection", turned),
    ("TableStyles", "", "tblStylePr", always),
    ("CellMerges", "", "gridSpan vMerge hMerge", always),
    ("TableBorders", "", "tblBorders tcBorders", always),
    ("CellMargins", "", "tblCellMar tcMar tblCellSpacing", always),
    ("RowRules", "", "trHeight cantSplit tblHeader", always),
    ("FloatingTables", "", "tblpPr", always),
    ("RightToLeftTables", "", "bidiVisual", switched),
]
_EFFECTS = "alphaBiLevel alphaCeiling alphaFloor alphaInv alphaMod alphaModFix alphaRepl biLevel blur clrChange clrRepl duotone fillOverlay grayscl hsl lum tint"
#: Rules of drawings, objects and equations, which count in the stories only.
_DRAWN: dict[str, list[tuple[str, str, Predicate]]] = {
    "w": [("Vml", "pict", always), ("Ole", "object objectEmbed objectLink", always), ("LegacyEquations", "objectEmbed objectLink", equation_program), ("TextBoxes", "txbxContent", always), ("Ink", "contentPart", always)],
    "w14": [("Ink", "contentPart", always)],
    "wp": [("Wrapping", "wrapSquare wrapTight wrapThrough wrapTopAndBottom wrapNone", always), ("Positioning", "positionH positionV", always)],
    "w10": [("Wrapping", "wrap", always)],
    "pic": [("Pictures", "pic", always)],
    "wps": [("Shapes", "wsp", always), ("TextBoxes", "txbx linkedTxbx", always)],
    "wpg": [("Groups", "wgp", always)],
    "wpc": [("Groups", "wpc", always)],
    "a": [
        ("ImageFormats", "blip", always),
        ("PictureEffects", "srcRect", lambda x: any(x.get(e, "0").strip() not in ("", "0") for e in "ltrb")),
        ("ShapeEffects", "scene3d sp3d", always),
        ("WordArt", "prstTxWarp", lambda x: "prst" in x and x["prst"].strip() != "textNoShape"),
    ],
    "a+": [("ImageFormats", "svgBlip", always)],
    "v": [("Groups", "group", always), ("TextBoxes", "textbox", always), ("ImageFormats", "imagedata", always), ("WordArt", "textpath", always)],
    "o": [("Ole", "OLEObject", always), ("LegacyEquations", "OLEObject", equation_program)],
    "m": [("Equations", "oMath oMathPara", always)],
    "c": [("Charts", "chart", always)],
    "cx": [("NewerCharts", "chart", always)],
    "dgm": [("SmartArt", "relIds", always)],
}
#: Vocabularies of which any element in a story is enough.
_WHOLE = {"wpi": "Ink", "aink": "Ink", "am3d": "Models3d", "v": "Vml"}
#: What a relationship alone shows.
_RELATED = {"core-properties": "Properties", "extended-properties": "Properties", "custom-properties": "Properties", "customXml": "CustomXml", "glossaryDocument": "Glossary", "font": "EmbeddedFonts", "origin": "Signatures", "signature": "Signatures", "vbaProject": "Vba", "hyperlink": "Hyperlinks", "image": "ImageFormats", "oleObject": "Ole", "chart": "Charts", "chartEx": "NewerCharts", "diagramData": "SmartArt", "model3d": "Models3d"}
TOGGLES = set("b bCs i iCs caps smallCaps strike dstrike outline shadow emboss imprint vanish".split())
#: The options that ECMA-376 Part 4 puts into w:compat, in the order of its schema.
OPTIONS = set("""useSingleBorderforContiguousCells wpJustification noTabHangInd noLeading spaceForUL noColumnBalance balanceSingleByteDoubleByteWidth noExtraLineSpacing doNotLeaveBackslashAlone
ulTrailSpace doNotExpandShiftReturn spacingInWholePoints lineWrapLikeWord6 printBodyTextBeforeHeader printColBlack wpSpaceWidth showBreaksInFrames subFontBySize suppressBottomSpacing suppressTopSpacing
suppressSpacingAtTopOfPage suppressTopSpacingWP suppressSpBfAfterPgBrk swapBordersFacingPages convMailMergeEsc truncateFontHeightsLikeWP6 mwSmallCaps usePrinterMetrics doNotSuppressParagraphBorders
wrapTrailSpaces footnoteLayoutLikeWW8 shapeLayoutLikeWW8 alignTablesRowByRow forgetLastTabAlignment adjustLineHeightInTable autoSpaceLikeWord95 noSpaceRaiseLower doNotUseHTMLParagraphAutoSpacing
layoutRawTableWidth layoutTableRowsApart useWord97LineBreakRules doNotBreakWrappedTables doNotSnapToGridInCell selectFldWithFirstOrLastChar applyBreakingRules doNotWrapTextWithPunct
doNotUseEastAsianBreakRules useWord2002TableStyleRules growAutofit useFELayout useNormalStyleForList doNotUseIndentAsNumberingTabStop useAltKinsokuLineBreakRules allowSpaceOfSameStyleInTable
doNotSuppressIndentation doNotAutofitConstrainedTables autofitToFirstFixedWidthCell underlineTabInNumList displayHangulFixedWidth splitPgBreakAndParaMark doNotVertAlignCellWithSp
doNotBreakConstrainedForcedTable doNotVertAlignInTxbx useAnsiKerningPairs cachedColBalance""".split())  # fmt: skip
WORD_SETTINGS = "http://schemas.microsoft.com/office/word"
MAIN_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
EAST_ASIAN, ARABIC_HEBREW = {"Han", "Hiragana", "Katakana", "Hangul", "Bopomofo"}, {"Arabic", "Hebrew"}
INDIC = {"Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Thai", "Lao", "Tibetan", "Myanmar", "Khmer"}
_SLOTS = {"HAnsi": "latin", "Ascii": "latin", "EastAsia": "ea", "Bidi": "cs"}


def _index(rules) -> dict:
    out: dict = {}
    for key, names, fits in rules:
        for name in names.split():
            out.setdefault(name, []).append((key, fits))
    return out


_ANYWHERE_INDEX = {short: _index(rules) for short, rules in _ANYWHERE.items()}
_DRAWN_INDEX = {short: _index(rules) for short, rules in _DRAWN.items()}
_INSIDE_INDEX = {(inside, name): [] for _, inside, names, _ in _INSIDE for name in names.split()}
for _key, _inside, _names, _fits in _INSIDE:
    for _name in _names.split():
        _INSIDE_INDEX[_inside, _name].append((_key, _fits))
_TABLE_INDEX: dict = {}
for _key, _inside, _names, _fits in _TABLE:
    for _name in _names.split():
        _TABLE_INDEX.setdefault(_name, []).append((_key, _inside.split(), _fits))
_KEYWORDS = {word: key for key, words in FIELD_KINDS.items() for word in words.split()}
_HIDDEN = re.compile("[\x00-\x1F\x7F-\x9F" + re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", HIDDEN) + "]")
_SCRIPT_PATTERNS = [(s, regex.compile(rf"\p{{Script={s}}}")) for s in SCRIPTS]


@lru_cache(maxsize=1 << 16)
def script_of(char: str) -> str | None:
    return next((s for s, p in _SCRIPT_PATTERNS if p.match(char)), None)


def language(tag: str) -> str | None:
    """A simple tag (language, perhaps script and region, or x-none) in its usual case, else nothing."""
    tag = tag.strip()
    if tag.lower() == "x-none":
        return "x-none"
    if not re.fullmatch(r"[A-Za-z]{2,3}(-[A-Za-z]{4})?(-([A-Za-z]{2}|[0-9]{3}))?", tag):
        return None
    first, *rest = tag.split("-")
    return "-".join([first.lower(), *(p.title() if len(p) == 4 else p.upper() for p in rest)])


def field_features(instruction: str, in_table: bool) -> set[str]:
    """What a field's instruction shows, by its first word and its switches."""
    text = instruction.strip()
    word = "=" if text.startswith("=") else re.match(r"[^\s\\]*", text)[0].upper()
    flat = re.sub(r"\s", "", text).upper()
    out = {"Fields"}
    if word == "=" and in_table:
        out.add("TableFormulas")
    elif word == "EQ":
        if "\\O\\AD(" in flat and "\\S\\UP" in flat:
            out.add("Ruby")
        elif "\\O\\AC(" in flat or ("\\O(\\S\\UP" in flat and "\\S\\DO" in flat):
            out.add("CombineCharacters")
    elif word in _KEYWORDS:
        out.add(_KEYWORDS[word])
    if "MERGEFORMAT" in flat or any(s in text for s in ("\\*", "\\#", "\\@")):
        out.add("FormattingSwitches")
    return out


class Tagger:
    """Collects what the parts of one package show; result() gives the row."""

    def __init__(self) -> None:
        self.tags, self.in_styles, self.fonts, self.languages, self.options, self.notes = {"Opc"}, set(), set(), set(), set(), set()
        self.asian, self.complex, self.scripts = set(), set(), Counter()
        self.theme, self.slots, self.headings, self.linked = {}, set(), set(), set()
        self.sections, self.with_references, self.inherits = 0, False, False
        self.tables, self.fixed, self.mode, self.application, self.pages = 0, 0, None, None, None

    def font(self, name: str) -> None:
        name = name.strip()
        if _HIDDEN.search(name):
            self.notes.add("a font name with hidden characters was left out")
        elif name:
            self.fonts.add(name)

    def part(self, role: str, events: list[tuple]) -> None:
        """Events (kind, depth, namespace, name, attributes, text) of a part in its role."""
        story, stack, skip = role in STORIES, [], None
        style, codes, section, columns, text = None, [], None, 0, []
        for kind, depth, space, name, attributes, data in events:
            if skip is not None:
                if kind == "end" and depth == skip:
                    skip = None
                continue
            if kind == "text":
                here = stack[-1] if stack else ("", "")
                if here == ("w", "instrText"):
                    if codes and codes[-1] is not None:
                        codes[-1] += data
                elif story and here in (("w", "t"), ("m", "t")):
                    self.scripts.update(Counter(data))
                elif role == "app" and here[0] == "app":
                    text.append((here[1], data))
                continue
            short = KNOWN.get(space)
            if kind == "end":
                stack.pop()
                if short == "w" and name == "style" and style is not None:
                    if style["heading"]:
                        self.headings.add(style["id"])
                    if style["numbered"] and style["heading"]:
                        self.tags.add("HeadingNumbering")
                    style = None
                elif short == "w" and name == "sectPr" and section == depth:
                    if self.with_references and not self.has_references:
                        self.inherits = True
                    self.with_references |= self.has_references
                    section = None
                continue
            if short is None:
                self.tags.add("Unknown")
                skip = depth
                continue
            if space.startswith(_STRICT):
                self.tags.add("Strict")
            parent = stack[-1][1] if stack and stack[-1][0] == "w" else ""
            self.rules(short, name, attributes, parent, role, story, stack)
            if short == "w":
                if name == "style":
                    style = {"id": attributes.get("styleId", "").strip(), "heading": False, "numbered": False, "kind": attributes.get("type", "").strip()}
                elif style is not None:
                    if name in TOGGLES:
                        self.tags.add("Toggles")
                    elif (name == "name" and parent == "style" and re.fullmatch(r"heading [1-9]", attributes.get("val", "").strip().lower())) or (name == "outlineLvl" and level(attributes)):
                        style["heading"] = True
                    elif name == "numPr":
                        style["numbered"] = True
                        if style["kind"] == "numbering":
                            self.tags.add("NumberingStyles")
                if name == "sectPr" and role == "document" and parent != "sectPrChange":
                    self.sections, self.has_references, section = self.sections + 1, False, depth
                elif name in ("headerReference", "footerReference") and section is not None and parent == "sectPr":
                    self.has_references = True
                elif name == "cols":
                    columns = 0
                elif name == "col" and parent == "cols":
                    columns += 1
                    if columns >= 2:
                        self.tags.add("Columns")
                elif name == "fldSimple":
                    self.tags |= field_features(attributes.get("instr", ""), self.in_cell(stack))
                elif name == "fldChar":
                    what = attributes.get("fldCharType", "").strip()
                    if what == "begin":
                        codes.append("")
                    elif codes and what in ("separate", "end"):
                        if codes[-1] is not None:
                            self.tags |= field_features(codes[-1], self.in_cell(stack))
                        codes[-1] = None
                        if what == "end":
                            codes.pop()
            stack.append((short, name))
        if role == "app":
            self.program("".join(t for n, t in text if n == "Application"), "".join(t for n, t in text if n == "Pages"))

    @staticmethod
    def in_cell(stack: list[tuple[str, str]]) -> bool:
        """Whether the element stands in a table cell; a text box starts afresh."""
        for short, name in reversed(stack):
            if short == "w" and name in ("tc", "txbxContent"):
                return name == "tc"
        return False

    def rules(self, short: str, name: str, x: dict, parent: str, role: str, story: bool, stack: list) -> None:
        tags = self.tags
        if role == "chart":
            if short == "c" and name in ("bar3DChart", "line3DChart", "pie3DChart", "area3DChart", "surface3DChart"):
                tags.add("Charts3d")
        elif role == "theme":
            if short == "a" and name in ("latin", "ea", "cs") and stack and stack[-1][1] in ("majorFont", "minorFont") and x.get("typeface", "").strip():
                self.theme[stack[-1][1][:5] + name] = x["typeface"]
            return
        elif role == "app":
            return
        else:
            if short == "w" and parent == "compat" and name != "compatSetting":
                if name not in OPTIONS:
                    self.notes.add("a compatibility option that is not of the standard was not recorded")
                elif switched(x):
                    self.options.add(name)
                return
            for key, fits in _ANYWHERE_INDEX.get(short, {}).get(name, ()):
                if fits(x):
                    tags.add(key)
            if short == "w":
                self.words(name, x, parent, role, stack)
            if story:
                for key, fits in _DRAWN_INDEX.get(short, {}).get(name, ()):
                    if fits(x):
                        tags.add(key)
                if short in _WHOLE:
                    tags.add(_WHOLE[short])
                if short == "a" and stack and stack[-1] == ("a", "effectLst"):
                    tags.add("ShapeEffects")
                elif short == "a" and stack and stack[-1] == ("a", "blip") and name in _EFFECTS.split():
                    tags.add("PictureEffects")
                elif short == "v" and role == "header" and (name == "textpath" or (name == "shape" and x.get("id", "").startswith(("PowerPlusWaterMarkObject", "WordPictureWatermark")))):
                    tags.add("Watermarks")
        if short == "a" and (story or role == "chart") and name in ("latin", "ea", "cs", "sym") and not x.get("typeface", "+").lstrip().startswith("+"):
            self.font(x["typeface"])

    def words(self, name: str, x: dict, parent: str, role: str, stack: list) -> None:
        """Rules of the main vocabulary that look at more than the element."""
        for key, fits in _INSIDE_INDEX.get((parent, name), ()):
            if fits(x) and (parent != "sectPr" or role == "document"):
                self.tags.add(key)
        for key, inside, fits in _TABLE_INDEX.get(name, ()):
            if (not inside or parent in inside) and fits(x):
                (self.in_styles if role == "styles" else self.tags).add(key)
        if name == "tab" and parent != "tabs":
            self.tags.add("TextTabsBreaksSymbols")
        elif name == "bidi" and parent != "sectPr" and switched(x):
            self.tags.add("BidiParagraphs")
        elif name == "textDirection" and parent not in ("sectPr", "tcPr") and turned(x):
            self.tags.add("LineAlignment")
        elif name == "tbl":
            self.tables += 1
            for short, up in reversed(stack):
                if short == "w" and up in ("tbl", "txbxContent"):
                    if up == "tbl":
                        self.tags.add("NestedTables")
                    break
        elif name == "tblLayout" and parent == "tblPr" and x.get("type", "").strip() == "fixed" and ("w", "tbl") in stack:
            self.fixed += 1
        elif name == "comment" and role == "comments":
            self.tags.add("Comments")
        elif name == "pStyle" and parent == "lvl" and "val" in x:
            self.linked.add(x["val"].strip())
        elif name == "rFonts":
            for slot in ("ascii", "hAnsi", "eastAsia", "cs"):
                if slot in x:
                    self.font(x[slot])
            for slot in ("asciiTheme", "hAnsiTheme", "eastAsiaTheme", "cstheme"):
                m = re.fullmatch("(major|minor)(HAnsi|Ascii|EastAsia|Bidi)", x.get(slot, "").strip())
                if m:
                    self.slots.add(m[1] + _SLOTS[m[2]])
        elif (name == "font" and parent == "fonts" and role == "fontTable") or name == "sym":
            self.font(x.get("name" if name == "font" else "font", ""))
        elif name in ("lang", "themeFontLang"):
            for slot, into in (("val", self.languages), ("eastAsia", self.asian), ("bidi", self.complex)):
                if slot in x:
                    tag = language(x[slot])
                    if tag:
                        into.add(tag)
                    else:
                        self.notes.add("a language tag that is not simple was left out")
        elif name == "compatSetting" and parent == "compat" and x.get("name", "").strip() == "compatibilityMode" and x.get("uri", "").strip() == WORD_SETTINGS:
            mode = number(x.get("val"))
            self.mode = None if mode is None else int(mode)

    def related(self, kind: str) -> None:
        """A relationship of the package or of a part that is read."""
        if kind in _RELATED:
            self.tags.add(_RELATED[kind])
        elif kind not in ROLES and kind not in OTHER_TYPES:
            self.tags.add("Unknown")

    def program(self, name: str, pages: str) -> None:
        name = re.sub(r"\{?[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\}?", "", name.split("$")[0])
        name = re.sub(r"\s+", " ", name).strip(" _-")
        self.application = name if name and not _HIDDEN.search(name) else None
        self.pages = int(pages) if re.fullmatch(r"\s*[0-9]{1,9}\s*", pages) else None

    def result(self) -> dict:
        """The row, with what depends on the document as a whole."""
        scripts: Counter = Counter()
        for char, n in self.scripts.items():
            scripts[script_of(char)] += n
        scripts.pop(None, None)
        tags, mode = set(self.tags), 12 if self.mode is None else self.mode
        whole = {
            "SectionBreaks": self.sections >= 2,
            "LinkToPrevious": self.inherits,
            "Autofit": self.tables > self.fixed,
            "Mode15": mode >= 15,
            "OlderModes": mode in (11, 12, 14),
            "HeadingNumbering": bool(self.linked & self.headings),
            "LegacyOptions": bool(self.options),
            "ArabicHebrew": bool(scripts.keys() & ARABIC_HEBREW),
            "IndicSoutheastAsian": bool(scripts.keys() & INDIC),
        }
        tags |= {key for key, shown in whole.items() if shown} | (self.in_styles if self.tables else set())
        languages = self.languages | (self.asian if scripts.keys() & EAST_ASIAN else set()) | (self.complex if scripts.keys() & (ARABIC_HEBREW | INDIC) else set())
        for slot in self.slots & self.theme.keys():
            self.font(self.theme[slot])
        return {"features": sorted(NAMES[t] for t in tags), "fonts": sorted(self.fonts), "languages": sorted(languages), "scripts": sorted(scripts.items()), "mode": self.mode, "options": sorted(self.options), "application": self.application, "pages_hint": self.pages, "notes": sorted(self.notes), "problem": None}


#: Parts of up to this many bytes that only say how a package is put together; packages of one program have the same ones.
RECURRING = 4096


def relations(data: bytes | None) -> list[tuple[str, str, bool]]:
    """(type's last segment, target, external) of a relationships part."""
    return [] if not data else _relations(data) if len(data) > RECURRING else _known_relations(data)


def _relations(data: bytes) -> list[tuple[str, str, bool]]:
    starts = (x for kind, _, _, name, x, _ in Reader().read(data) if kind == "start" and name == "Relationship")
    return [(x.get("Type", "").rstrip("/").rpartition("/")[2], x.get("Target", ""), x.get("TargetMode") == "External") for x in starts]


def stated_types(data: bytes | None) -> dict[str, str | None]:
    """Content types by part, in lower case, and by extension after a dot."""
    return {} if not data else _stated_types(data) if len(data) > RECURRING else _known_types(data)


def _stated_types(data: bytes) -> dict[str, str | None]:
    types = [(name, x) for kind, _, _, name, x, _ in Reader().read(data) if kind == "start"]
    stated = {x.get("PartName", "").lstrip("/").lower(): x.get("ContentType") for name, x in types if name == "Override"}
    return stated | {"." + x.get("Extension", "").lower(): x.get("ContentType") for name, x in types if name == "Default"}


_known_relations, _known_types = lru_cache(512)(_relations), lru_cache(512)(_stated_types)


def resolved(base: str, target: str) -> str | None:
    """The part a target names, seen from the part that refers to it; nothing if it would leave the package."""
    out = [] if target.startswith("/") else base.split("/")[:-1]
    for segment in target.split("/"):
        if segment == "..":
            if not out:
                return None
            out.pop()
        elif segment not in ("", "."):
            out.append(segment)
    return "/".join(out) or None


def tag(data: bytes) -> dict:
    """The row of one package; refused ones raise."""
    if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise Refused("a compound file, not a package")
    parts = dict(read_parts(data))
    lower = {name.lower(): name for name in parts}
    rels = lambda part: relations(parts.get(lower.get("/".join([*part.split("/")[:-1], "_rels", part.split("/")[-1] + ".rels"]).lstrip("/").lower(), "")))
    tagger = Tagger()

    def read(part: str, role: str) -> None:
        reader = Reader(frozenset(KNOWN), drop_ignorable=False)
        tagger.part(role, reader.read(parts[part]))
        if reader.compatibility:
            tagger.tags.add("Compatibility")

    main = None
    for kind, target, external in rels(""):
        tagger.related(kind)
        part = None if external else lower.get((resolved("", target) or "").lower())
        if kind == "officeDocument" and main is None:
            main = part
        elif kind == "extended-properties" and part:
            read(part, "app")
    if main is None:
        raise Refused("no main document part")
    stated = stated_types(parts[lower["[content_types].xml"]]) if "[content_types].xml" in lower else {}
    if stated.get(main.lower(), stated.get("." + main.rpartition(".")[2].lower())) != MAIN_TYPE:
        raise Refused("the main part is not a document")
    done, open_ = set(), [(main, "document")]
    while open_:
        part, role = open_.pop(0)
        if part in done:
            continue
        done.add(part)
        read(part, role)
        if role in STORIES:
            for kind, target, external in rels(part):
                tagger.related(kind)
                name = None if external else resolved(part, target)
                if kind in ROLES and name:
                    if name.lower() in lower:
                        open_.append((lower[name.lower()], ROLES[kind]))
                    else:
                        tagger.notes.add("a part that is referred to is missing")
    return tagger.result()


SCHEMA = "features array<string>, fonts array<string>, languages array<string>, scripts map<string,bigint>, mode int, options array<string>, application string, pages_hint int, notes array<string>, problem string"
_EMPTY = dict.fromkeys(["features", "fonts", "languages", "scripts", "mode", "options", "application", "pages_hint", "notes"])


def tag_packages(files: DataFrame, doc: str = "path", content: str = "content") -> DataFrame:
    """A row for each package (doc, content): its features by name, fonts, languages, scripts, compatibility, program, notes, or a problem.

    One pass over a package's parts, in the task that reads it; no shuffle. Null and damaged packages have a problem and nulls;
    the document's key is kept as it is, null or repeated; other columns are not read.
    """
    kind = files.schema[doc].dataType.simpleString()
    types = [pa.list_(pa.string())] * 3 + [pa.map_(pa.string(), pa.int64()), pa.int32(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]
    names = [*_EMPTY, "problem"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for data in batch.column(1):
                try:
                    rows.append(tag(data.as_py() or b""))
                except Refused as refused:
                    rows.append(_EMPTY | {"problem": str(refused)})
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True))], ["doc", *names])

    return files.select(F.col(doc).alias("doc"), F.col(content)).mapInArrow(run, f"doc {kind}, {SCHEMA}")
