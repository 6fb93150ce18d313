"""The feature tagger on hand-made packages: for each section of the coverage table what shows a feature, and what does not."""

import pytest

from folioscope.operators import tagger as G
from folioscope.sources import packages

O, MS = "http://schemas.openxmlformats.org/", "http://schemas.microsoft.com/office/"
SPACES = " ".join(f'xmlns:{p}="{G._SPACES[k][0]}"' for p, k in (("w", "w"), ("a", "a"), ("wp", "wp"), ("pic", "pic"), ("v", "v"), ("o", "o"), ("m", "m"), ("wps", "wps"), ("wpg", "wpg"), ("w14", "w14"), ("w15", "w15"), ("w10", "w10"), ("c", "c"), ("cx", "cx"), ("dgm", "dgm"), ("mc", "mc"), ("am3d", "am3d"), ("aink", "aink"))) + f' xmlns:asvg="{MS}drawing/2016/SVG/main"'
TYPES = f'<Types xmlns="{O}package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{G.MAIN_TYPE}"/></Types>'
ROOTS = {"styles": "styles", "numbering": "numbering", "settings": "settings", "fontTable": "fonts", "header": "hdr", "footer": "ftr", "footnotes": "footnotes", "comments": "comments"}


def rels(rows):
    body = "".join(f'<Relationship Id="r{i}" Type="{O}officeDocument/2006/relationships/{kind}" Target="{target}"{" TargetMode=" + chr(34) + "External" + chr(34) if external else ""}/>' for i, (kind, target, external) in enumerate(rows))
    return f'<Relationships xmlns="{O}package/2006/relationships">{body}</Relationships>'.encode()


def package(body="", parts=None, top=(), more=(), types=TYPES, spaces=SPACES):
    """A document with this body; parts are contents by role, more are further relationships of the document."""
    out = {"[Content_Types].xml": types.encode(), "word/document.xml": f"<w:document {spaces}><w:body>{body}</w:body></w:document>".encode()}
    edges = list(more)
    for role, content in (parts or {}).items():
        out[f"word/{role}1.xml"] = (content if role in ("theme", "chart") else f"<w:{ROOTS[role]} {SPACES}>{content}</w:{ROOTS[role]}>").encode()
        edges.append((role, f"{role}1.xml", False))
    out["word/_rels/document.xml.rels"] = rels(edges)
    out["_rels/.rels"] = rels([("officeDocument", "word/document.xml", False), *top])
    return packages.write_parts(out)


def shown(*args, **kw):
    keys = {name: key for key, name in G.NAMES.items()}
    return {keys[f] for f in G.tag(package(*args, **kw))["features"]}


BARE = {"Opc", "OlderModes"}


def run(x):
    return f"<w:p><w:r><w:rPr>{x}</w:rPr></w:r></w:p>"


def par(x):
    return f"<w:p><w:pPr>{x}</w:pPr></w:p>"


def field(code):
    return f'<w:p><w:fldSimple w:instr="{code}"/></w:p>'


def table(x, layout="fixed"):
    return f'<w:tbl><w:tblPr><w:tblLayout w:type="{layout}"/></w:tblPr><w:tr><w:tc>{x}</w:tc></w:tr></w:tbl>'


GRID = {"TableGrid"}
CASES = [
    # characters and runs
    ("<w:p><w:r><w:t>x</w:t></w:r></w:p>", {"TextTabsBreaksSymbols"}), (run('<w:rFonts w:ascii="A"/>'), {"RunFonts"}), (run("<w:b/>"), {"SizeBoldItalic"}), (run('<w:b w:val="0"/>'), set()), (run('<w:sz w:val="20"/>'), {"SizeBoldItalic"}),
    (run('<w:u w:val="single"/>'), {"Underline"}), (run('<w:u w:val="none"/>'), set()), (run("<w:caps/>"), {"StrikeCapsHidden"}), (run('<w:color w:val="FF0000"/>'), {"Color"}), (run('<w:color w:val="auto"/>'), set()),
    (run('<w:color w:val="auto" w:themeColor="text1"/>'), {"Color", "Theme"}), (run('<w:highlight w:val="red"/>'), {"Highlight"}), (run('<w:shd w:val="clear" w:fill="FFFF00"/>'), {"Highlight"}), (run('<w:shd w:val="clear" w:fill="auto"/>'), set()),
    (run('<w:shd w:val="nil" w:fill="FFFF00"/>'), set()), (run('<w:vertAlign w:val="superscript"/>'), {"RaisedLowered"}), (run('<w:position w:val="0"/>'), set()), (run('<w:spacing w:val="20"/>'), {"CharacterSpacing"}), (run('<w:w w:val="100"/>'), set()),
    (run('<w:w w:val="90%"/>'), {"CharacterSpacing"}), (run("<w:bdr/>"), {"TextBorders"}), (run('<w:em w:val="dot"/>'), {"EmphasisMarks"}), (run('<w:eastAsianLayout w:combine="1"/>'), {"EmphasisMarks", "CombineCharacters"}), (run("<w:fitText/>"), {"FitText"}),
    (run('<w:lang w:val="en-us"/>'), {"LanguageTags"}), (run("<w:rtl/>"), {"RightToLeftRuns"}), (run("<w:outline/>"), {"TextEffects"}), (run("<w14:glow/>"), {"TextEffects"}), (run("<w14:ligatures/>"), {"OpenType"}), ("<w:hyperlink/>", {"Hyperlinks"}), ("<w:ruby/>", {"Ruby"}),
    # paragraphs
    (par('<w:jc w:val="center"/>'), {"Alignment"}), (par('<w:jc w:val="start"/>'), set()), (par('<w:jc w:val="highKashida"/>'), {"Alignment", "Kashida"}), (par('<w:ind w:left="1"/>'), {"Indentation"}), (par('<w:spacing w:before="1"/>'), {"ParagraphSpacing"}),
    (par('<w:spacing w:line="240"/>'), {"LineSpacing"}), (par('<w:tabs><w:tab w:val="bar"/></w:tabs>'), {"TabStops"}), ("<w:p><w:r><w:tab/></w:r></w:p>", {"TextTabsBreaksSymbols"}), (par("<w:keepNext/>"), {"KeepTogether"}), (par("<w:widowControl/>"), set()),
    (par('<w:widowControl w:val="0"/>'), {"KeepTogether"}), (par("<w:pBdr/>"), {"ParagraphBorders"}), (par('<w:shd w:val="pct10"/>'), {"ParagraphBorders"}), (par('<w:outlineLvl w:val="8"/>'), {"OutlineLevel"}), (par('<w:outlineLvl w:val="9"/>'), set()), (par("<w:framePr/>"), {"Frames"}),
    (par("<w:bidi/>"), {"BidiParagraphs"}), (par('<w:snapToGrid w:val="0"/>'), {"AsianLineBreaking"}), (par("<w:snapToGrid/>"), set()), (par('<w:kinsoku w:val="off"/>'), {"AsianLineBreaking", "Kinsoku"}), (par('<w:autoSpaceDE w:val="0"/>'), {"AsianLineBreaking", "AutoSpacing"}),
    (par("<w:topLinePunct/>"), {"AsianLineBreaking"}), (par("<w:textAlignment/>"), {"LineAlignment"}), (par('<w:textDirection w:val="tbRl"/>'), {"LineAlignment", "VerticalText"}), (par('<w:textDirection w:val="lrTb"/>'), set()), (par("<w:suppressLineNumbers/>"), {"Suppressed"}), (par("<w:rPr/>"), {"MarkFormatting"}),
    # sections
    ("<w:sectPr><w:pgSz/></w:sectPr>", {"PageSize"}), ("<w:p><w:pPr><w:sectPr/></w:pPr></w:p><w:sectPr/>", {"SectionBreaks"}), ('<w:sectPr><w:cols w:num="2"/></w:sectPr>', {"Columns"}), ("<w:sectPr><w:cols><w:col/><w:col/></w:cols></w:sectPr>", {"Columns"}), ("<w:sectPr><w:cols><w:col/></w:cols></w:sectPr>", set()),
    ('<w:sectPr><w:vAlign w:val="center"/></w:sectPr>', {"PageAlignment"}), ("<w:sectPr><w:pgBorders/><w:lnNumType/></w:sectPr>", {"PageBorders", "LineNumbering"}), ('<w:sectPr><w:pgNumType w:start="1"/></w:sectPr>', {"PageNumbering"}), ("<w:sectPr><w:pgNumType/></w:sectPr>", set()),
    ('<w:sectPr><w:docGrid w:type="lines"/></w:sectPr>', {"DocumentGrid"}), ('<w:sectPr><w:docGrid w:type="snapToChars"/></w:sectPr>', {"DocumentGrid", "CharacterGrid"}), ("<w:sectPr><w:bidi/></w:sectPr>", {"SectionDirection"}), ('<w:sectPr><w:textDirection w:val="tbRl"/></w:sectPr>', {"SectionDirection", "VerticalText"}),
    ("<w:sectPr><w:sectPrChange><w:sectPr/></w:sectPrChange></w:sectPr>", {"TrackedFormatting"}), ("<w:p><w:pPr><w:sectPr><w:headerReference/></w:sectPr></w:pPr></w:p><w:sectPr/>", {"SectionBreaks", "HeadersFooters", "HeaderDistances", "LinkToPrevious"}),
    ("<w:p><w:pPr><w:sectPr/></w:pPr></w:p><w:sectPr><w:headerReference/></w:sectPr>", {"SectionBreaks", "HeadersFooters", "HeaderDistances"}), ("<w:sectPr><w:titlePg/></w:sectPr>", {"HeadersFooters"}),
    # tables
    (table(""), GRID), (table("", "auto"), GRID | {"Autofit"}), ("<w:tbl/>", GRID | {"Autofit"}), (table("<w:tcPr><w:vMerge/></w:tcPr>"), GRID | {"CellMerges"}), (table("<w:tcPr><w:tcBorders/><w:tcMar/></w:tcPr>"), GRID | {"TableBorders", "CellMargins"}), (table('<w:tcPr><w:shd w:fill="FF0000"/></w:tcPr>'), GRID | {"TableBorders"}),
    ("<w:trHeight/>", {"RowRules"}), (table(table("")), GRID | {"NestedTables"}), (table(f"<w:p><w:r><w:pict><w:txbxContent>{table('')}</w:txbxContent></w:pict></w:r></w:p>"), GRID | {"Vml", "TextBoxes"}), ("<w:tblpPr/>", {"FloatingTables"}), ("<w:bidiVisual/>", {"RightToLeftTables"}),
    (table('<w:tcPr><w:textDirection w:val="btLr"/></w:tcPr>'), GRID | {"CellDirection", "VerticalText"}), (table('<w:tcPr><w:vAlign w:val="bottom"/></w:tcPr>'), GRID | {"CellDirection"}), (table(field("=SUM(ABOVE)")), GRID | {"Fields", "TableFormulas"}), (field("= 1 + 1"), {"Fields", "FormulasAndConditions"}),
    # fields
    (field(" page "), {"Fields", "PageFields"}), (field("DATE \\@ &quot;d&quot;"), {"Fields", "DateAndTimeFields", "FormattingSwitches"}), (field("REF x"), {"Fields", "CrossReferences"}), (field("AUTHOR"), {"Fields", "DocumentInformationFields"}), (field("TOC"), {"Fields", "TablesOfContents"}),
    (field("MERGEFIELD n"), {"Fields", "MailMergeFields"}), (field("XE x"), {"Fields", "IndexesAndAuthorities"}), (field("CITATION x"), {"Fields", "Citations"}), (field("FORMTEXT"), {"Fields", "LegacyFormFields"}), (field("INCLUDEPICTURE x"), {"Fields", "ExternalFields"}), (field("SYMBOL 1"), {"Fields", "TextTabsBreaksSymbols"}),
    (field("HYPERLINK x"), {"Fields", "Hyperlinks"}), (field("EQ \\o\\ac(a,b)"), {"Fields", "CombineCharacters"}), (field("EQ \\* jc2 \\o\\ad(\\s\\up 11(a),b)"), {"Fields", "Ruby", "FormattingSwitches"}), (field("EQ \\f(1,2)"), {"Fields"}),
    ('<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> NUM</w:instrText></w:r><w:r><w:instrText>PAGES </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>', {"Fields", "PageFields"}),
    ('<w:p><w:fldChar w:fldCharType="begin"/><w:instrText>IF </w:instrText><w:fldChar w:fldCharType="begin"/><w:instrText>SEQ a</w:instrText><w:fldChar w:fldCharType="end"/><w:instrText> x</w:instrText><w:fldChar w:fldCharType="end"/></w:p>', {"Fields", "FormulasAndConditions", "CrossReferences"}),
    # notes, comments and review
    ("<w:footnoteReference/>", {"Notes"}), ("<w:commentReference/>", {"Comments"}), ("<w:ins/><w:del/>", {"TrackedText"}), ("<w:moveFrom/>", {"TrackedMoves"}), (run("<w:rPrChange/>"), {"TrackedFormatting"}), ("<w:permStart/>", {"RestrictEditing"}),
    # drawings, equations, controls
    ("<pic:pic/>", {"Pictures"}), ("<a:blip/>", {"ImageFormats"}), ("<asvg:svgBlip/>", {"ImageFormats"}), ('<a:srcRect l="10"/>', {"PictureEffects"}), ('<a:srcRect l="0"/>', set()), ("<a:blip><a:duotone/></a:blip>", {"ImageFormats", "PictureEffects"}), ("<wp:wrapTight/>", {"Wrapping"}), ("<w10:wrap/>", {"Wrapping"}),
    ("<wp:positionH/>", {"Positioning"}), ("<wps:wsp/>", {"Shapes"}), ("<wps:txbx/>", {"TextBoxes"}), ("<wpg:wgp/>", {"Groups"}), ("<a:effectLst/>", set()), ("<a:effectLst><a:glow/></a:effectLst>", {"ShapeEffects"}), ("<a:sp3d/>", {"ShapeEffects"}), ('<a:prstTxWarp prst="textArchUp"/>', {"WordArt"}), ('<a:prstTxWarp prst="textNoShape"/>', set()),
    ("<w:pict><v:shape><v:imagedata/></v:shape></w:pict>", {"Vml", "ImageFormats"}), ('<w:object><o:OLEObject ProgID="Equation.3"/></w:object>', {"Ole", "LegacyEquations"}), ('<o:OLEObject ProgID="Excel.Sheet.8"/>', {"Ole"}), ("<w14:contentPart/>", {"Ink"}), ("<am3d:model3d/>", {"Models3d"}), ("<aink:x/>", {"Ink"}),
    ("<m:oMath/>", {"Equations"}), ("<c:chart/>", {"Charts"}), ("<cx:chart/>", {"NewerCharts"}), ("<dgm:relIds/>", {"SmartArt"}), ("<w:sdt/>", {"ContentControls"}), ("<w15:repeatingSection/>", {"Repeating"}), ("<w:dataBinding/>", {"DataBinding"}), ("<w:p/>", set()),
    # scripts
    ("<w:p><w:r><w:t>سلام</w:t></w:r></w:p>", {"TextTabsBreaksSymbols", "ArabicHebrew"}), ("<m:t>ไทย</m:t>", {"IndicSoutheastAsian"}), ("<w:p><w:del><w:r><w:delText>سلام</w:delText></w:r></w:del></w:p>", {"TrackedText"}),
    # compatibility of markup
    ('<mc:AlternateContent><mc:Choice Requires="wps"><wps:wsp/></mc:Choice><mc:Fallback><w:pict/></mc:Fallback></mc:AlternateContent>', {"Compatibility", "Shapes"}),
    ('<mc:AlternateContent xmlns:z="urn:z"><mc:Choice Requires="z"><wps:wsp/></mc:Choice><mc:Fallback><w:pict/></mc:Fallback></mc:AlternateContent>', {"Compatibility", "Vml"}), ('<z:a xmlns:z="urn:z"><w:tbl/></z:a>', {"Unknown"}), ('<w:p xmlns:z="urn:z" mc:Ignorable="z"><z:a/></w:p>', {"Compatibility", "Unknown"}),
]


@pytest.mark.parametrize(("body", "extra"), CASES)
def test_bodies(body, extra):
    assert shown(body) == BARE | extra


HEADING = '<w:style w:type="paragraph" w:styleId="H"><w:name w:val="Heading 1"/>{}</w:style>'
NUMBERED = '<w:pPr><w:numPr/></w:pPr>'
PARTS = [
    ("", {"styles": "<w:docDefaults/><w:latentStyles/>"}, {"DocumentDefaults", "LatentStyles"}),
    ("", {"styles": HEADING.format("")}, {"Styles"}),
    ("", {"styles": HEADING.format(NUMBERED)}, {"Styles", "HeadingNumbering"}),
    ("", {"styles": HEADING.format(""), "numbering": '<w:abstractNum><w:lvl><w:pStyle w:val="H"/><w:numFmt w:val="decimal"/><w:lvlText/></w:lvl></w:abstractNum>'}, {"Styles", "HeadingNumbering", "AbstractNumbering", "NumberFormats", "LevelText"}),
    ("", {"styles": HEADING.format(""), "numbering": '<w:num/><w:lvl><w:pStyle w:val="Bullet"/></w:lvl><w:lvlRestart/><w:legacy/>'}, {"Styles", "AbstractNumbering", "Restart", "LegacyNumbering"}),
    ("", {"styles": '<w:style w:type="numbering"><w:name w:val="No List"/></w:style>'}, set()),
    ("", {"styles": f'<w:style w:type="numbering">{NUMBERED}</w:style>'}, {"NumberingStyles"}),
    ("", {"styles": '<w:style w:type="character"><w:rPr><w:i/></w:rPr><w:autoRedefine/></w:style>'}, {"Styles", "Toggles", "SizeBoldItalic", "AutoRedefine"}),
    ("", {"styles": '<w:style w:type="table"><w:tblPr><w:tblCellMar/></w:tblPr><w:tblStylePr/></w:style>'}, set()),
    (table(""), {"styles": '<w:style w:type="table"><w:tblPr><w:tblCellMar/></w:tblPr><w:tblStylePr/></w:style>'}, GRID | {"CellMargins", "TableStyles"}),
    ("", {"numbering": "<w:numPicBullet><w:pict><v:shape><v:imagedata/></v:shape></w:pict></w:numPicBullet>"}, {"PictureBullets"}),
    ("", {"header": '<w:p><w:r><w:pict><v:shape id="PowerPlusWaterMarkObject1"/></w:pict></w:r></w:p>'}, {"Vml", "Watermarks"}),
    ("", {"footer": "<w:p><v:textpath/></w:p>"}, {"Vml", "WordArt"}),
    ("", {"header": "<w:p><v:textpath/></w:p>"}, {"Vml", "WordArt", "Watermarks"}),
    ("", {"header": "<w:sectPr><w:vAlign w:val='center'/></w:sectPr>"}, set()),
    ("", {"comments": ""}, set()),
    ("", {"comments": "<w:comment/>"}, {"Comments"}),
    ("", {"settings": "<w:mirrorMargins/><w:evenAndOddHeaders/><w:mailMerge/>"}, {"MirrorMargins", "HeadersFooters", "MailMergeFields"}),
    ("", {"settings": '<w:documentProtection w:enforcement="0"/>'}, set()),
    ("", {"settings": '<w:documentProtection w:enforcement="1"/>'}, {"RestrictEditing"}),
    ("", {"settings": '<w:compat><w:growAutofit/><w:ownWords/></w:compat>'}, {"LegacyOptions"}),
    ("", {"settings": '<w:compat><w:growAutofit w:val="0"/></w:compat>'}, set()),
    ("", {"fontTable": '<w:font w:name="F"><w:embedBold/></w:font>'}, {"EmbeddedFonts"}),
    ("", {"chart": f'<c:chartSpace {SPACES}><c:pie3DChart/></c:chartSpace>'}, {"Charts", "Charts3d"}),
]


@pytest.mark.parametrize(("body", "parts", "extra"), PARTS)
def test_parts(body, parts, extra):
    assert shown(body, parts) == BARE | extra


def test_compatibility_modes():
    setting = '<w:compat><w:compatSetting w:name="compatibilityMode" w:uri="{}" w:val="{}"/></w:compat>'
    row = lambda uri, mode: G.tag(package(parts={"settings": setting.format(uri, mode)}))
    for mode, feature in ((15, "Mode15"), (16, "Mode15"), (14, "OlderModes"), (13, None)):
        got = row(G.WORD_SETTINGS, mode)
        assert got["mode"] == mode and ({G.NAMES["Mode15"], G.NAMES["OlderModes"]} & set(got["features"])) == ({G.NAMES[feature]} if feature else set())
    assert row("urn:other", 15)["mode"] is None


def test_relationships_alone():
    top = [("core-properties", "docProps/core.xml", False), ("x/origin", "sig", False), ("customXml", "i.xml", False)]
    more = [("glossaryDocument", "none.xml", False), ("image", "i.png", False), ("hyperlink", "http://e.org", True), ("oleObject", "o.bin", False), ("diagramData", "d.xml", False), ("newThing", "n.xml", False), ("header", "lost.xml", False)]
    assert shown(top=top, more=more) == BARE | {"Properties", "Signatures", "CustomXml", "Glossary", "ImageFormats", "Hyperlinks", "Ole", "SmartArt", "Unknown"}
    assert G.tag(package(more=more))["notes"] == ["a part that is referred to is missing"]


def test_strict_and_templates():
    strict = SPACES.replace(G._SPACES["w"][0], "http://purl.oclc.org/ooxml/wordprocessingml/main")
    assert shown("<w:p><w:r><w:t>x</w:t></w:r></w:p>", spaces=strict) == BARE | {"Strict", "TextTabsBreaksSymbols"}
    for bad, why in ((package(types=TYPES.replace("document.main", "template.main")), "not a document"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"x" * 600, "compound"), (b"junk", "archive"), (packages.write_parts({"a.xml": b"<a/>"}), "main"), (package("<w:p>"), "well formed")):
        with pytest.raises(packages.Refused, match=why):
            G.tag(bad)


def test_fonts_languages_scripts_and_program():
    body = run('<w:rFonts w:ascii=" Arial " w:hAnsiTheme="minorHAnsi" w:eastAsiaTheme="majorEastAsia" w:cs="a&#x200B;b"/><w:lang w:val="EN-us" w:eastAsia="ja-jp" w:bidi="ar-SA"/>') + '<w:p><w:r><w:sym w:font="Wingdings"/><w:t>Ab яз 漢 12</w:t></w:r></w:p><a:latin typeface="+mn-lt"/><a:ea typeface="Mincho"/>'
    theme = f'<a:theme {SPACES}><a:minorFont><a:latin typeface="Calibri"/></a:minorFont><a:majorFont><a:latin typeface="Unused"/></a:majorFont></a:theme>'
    made = package(body, {"theme": theme, "fontTable": '<w:font w:name="Table Font"/>'}, top=[("extended-properties", "app.xml", False)])
    parts = dict(packages.read_parts(made)) | {"app.xml": f'<Properties xmlns="{G._SPACES["app"][0]}"><Application>Maker  9 $secret</Application><Pages>7</Pages></Properties>'.encode()}
    got = G.tag(packages.write_parts(parts))
    assert got["fonts"] == ["Arial", "Calibri", "Mincho", "Table Font", "Wingdings"] and got["languages"] == ["en-US", "ja-JP"]
    assert got["scripts"] == [("Cyrillic", 2), ("Han", 1), ("Latin", 2)] and got["application"] == "Maker 9" and got["pages_hint"] == 7
    assert got["notes"] == ["a font name with hidden characters was left out"]


def test_vocabulary():
    assert len(G.NAMES) == len(set(G.NAMES.values())) == 139 and len(G.OPTIONS) == 65
    proven = set().union(*(extra for *_, extra in [*CASES, *PARTS])) | BARE | {"Mode15", "Strict", "Properties", "Signatures", "CustomXml", "Glossary"}
    assert set(G.NAMES) - proven - set(G.NEVER) == {"Vba"}  # a document cannot hold one


def test_rows(spark):
    rows = [("a", package("<w:p><w:r><w:t>x</w:t></w:r></w:p>"), 1), ("b", b"junk", 2), (None, None, 3), ("a", package(), 4)]
    got = G.tag_packages(spark.createDataFrame(rows, "path string, content binary, features int")).collect()
    assert sorted((r.doc or "", r.problem or "", len(r.features or [])) for r in got) == [("", "not an archive", 0), ("a", "", 2), ("a", "", 3), ("b", "not an archive", 0)]
    assert G.tag_packages(spark.createDataFrame([], "path string, content binary")).count() == 0
