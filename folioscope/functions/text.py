"""Scalar text functions as Column expressions; each is exact, takes nulls to nulls, and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelled out: regex engines disagree about \s.
SPACES = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Format characters that show nothing.
HIDDEN = r"\x{061C}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}"
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "\u017ft", "\ufb06": "st"}
#: Scripts that are counted, by the name of their Unicode property; characters common to scripts have none.
SCRIPTS = (
    "Arabic Armenian Bengali Bopomofo Cherokee Cyrillic Devanagari Ethiopic Georgian Greek Gujarati Gurmukhi Han Hangul Hebrew Hiragana Kannada Katakana "
    "Khmer Lao Latin Malayalam Mongolian Myanmar Nko Oriya Sinhala Syriac Tamil Telugu Thaana Thai Tibetan Tifinagh Yi"
).split()


def comparable(text: Column) -> Column:
    """The form in which two renderings of a text are compared: no white space or invisible characters, one hyphen, ligatures apart."""
    out = F.regexp_replace(text, f"[{SPACES}{HIDDEN}]", "")
    out = F.translate(out, "\u00ad\u2010\u2011", "---")
    for ligature, letters in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return out


def comparable_origins(text: Column) -> Column:
    """Array of (at, char) of the comparable form: where in the text, in code points, each of its characters comes from."""
    def one(c: Column, i: Column) -> Column:
        return F.transform(F.split(comparable(c), ""), lambda x: F.struct(i.alias("at"), x.alias("char")))

    places = F.flatten(F.transform(F.split(text, ""), one))
    return F.filter(places, lambda p: p["char"] != "")


def printable(text: Column, limit: int) -> Column:
    """At most `limit` characters, hidden and control characters shown as `?`."""
    return F.regexp_replace(F.substring(text, 1, limit), rf"[\x00-\x1F\x7F-\x9F{HIDDEN}\x{{2028}}\x{{2029}}]", "?")


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]<>|#])", r"\\$1")


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def xml_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def mask(text: Column) -> Column:
    """Capitals become X, small letters x, digits 0, everything beyond ASCII *."""
    return F.translate(F.regexp_replace(text, r"[^\x00-\x7F]", "*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz123456789", "X" * 26 + "x" * 26 + "0" * 9)


def canonical_language(tag: Column) -> Column:
    """A language tag in its usual case (`en-US`, `zh-Hant-TW`); null if it has not the shape of one. After a singleton all is lower case."""
    clean = F.trim(tag)
    shape = clean.rlike("^[A-Za-z]{1,8}(?:-[A-Za-z0-9]{1,8})*$") & F.length(clean).between(2, 35)
    parts = F.split(F.lower(clean), "-")

    def one(part: Column, i: Column) -> Column:
        private = F.exists(F.slice(parts, F.lit(1), i), lambda p: F.length(p) == 1)
        letters = part.rlike("^[a-z]+$") & (i > 0) & ~private
        return F.when(letters & (F.length(part) == 2), F.upper(part)).when(letters & (F.length(part) == 4), F.initcap(part)).otherwise(part)

    return F.when(shape, F.array_join(F.transform(parts, one), "-"))


def is_simple_language(tag: Column) -> Column:
    """A language, perhaps a script and a region; or `x-none`."""
    return tag.rlike("^(?:x-none|[a-z]{2,3}(?:-[A-Za-z]{4})?(?:-(?:[A-Z]{2}|[0-9]{3}))?)$")


def application_name(text: Column) -> Column:
    """Which program saved a document, without what could tell the machine: cut at `$`, no GUIDs, single spaces; null if nothing is left."""
    guid = "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
    out = F.regexp_replace(F.substring_index(text, "$", 1), rf"\{{{guid}\}}|{guid}", "")
    out = F.regexp_replace(F.regexp_replace(out, f"[{SPACES}]+", " "), "^[ _-]+|[ _-]+$", "")
    return F.when(out != "", out)


#: Field keywords by the feature they show.
FIELD_KINDS = {
    "PageFields": "NUMPAGES PAGE PAGEREF SECTIONPAGES",
    "DateAndTimeFields": "CREATEDATE DATE PRINTDATE SAVEDATE TIME",
    "CrossReferences": "NOTEREF REF SEQ STYLEREF",
    "DocumentInformationFields": "AUTHOR COMMENTS DOCPROPERTY DOCVARIABLE EDITTIME FILENAME FILESIZE INFO KEYWORDS LASTSAVEDBY NUMCHARS NUMWORDS REVNUM SUBJECT TEMPLATE TITLE USERADDRESS USERINITIALS USERNAME",
    "TablesOfContents": "TC TOC",
    "FormulasAndConditions": "= COMPARE IF",
    "MailMergeFields": "ADDRESSBLOCK ASK DATABASE FILLIN GREETINGLINE MERGEFIELD MERGEREC MERGESEQ NEXT NEXTIF SKIPIF",
    "IndexesAndAuthorities": "INDEX TA TOA XE",
    "Citations": "BIBLIOGRAPHY CITATION",
    "LegacyFormFields": "FORMCHECKBOX FORMDROPDOWN FORMTEXT",
    "ExternalFields": "DDE DDEAUTO IMPORT INCLUDE INCLUDEPICTURE INCLUDETEXT LINK",
    "Hyperlinks": "HYPERLINK",
    "TextTabsBreaksSymbols": "SYMBOL",
}


def field_keyword(instruction: Column) -> Column:
    text = F.regexp_replace(instruction, f"^[{SPACES}]+", "")
    return F.when(text.startswith("="), F.lit("=")).otherwise(F.upper(F.regexp_extract(text, rf"^([^{SPACES}\\]*)", 1)))


def classify_field(instruction: Column, in_table: Column | None = None) -> Column:
    """The feature of a field by its keyword; null if it shows none."""
    key = field_keyword(instruction)
    out = F.when(key == "EQ", equation_field(instruction))
    if in_table is not None:
        out = out.when((key == "=") & in_table, F.lit("TableFormulas"))
    for feature, keys in FIELD_KINDS.items():
        out = out.when(key.isin(*keys.split()), F.lit(feature))
    return out


def equation_field(instruction: Column) -> Column:
    flat = F.upper(F.regexp_replace(instruction, f"[{SPACES}]", ""))
    ruby = flat.contains("\\O\\AD(") & flat.contains("\\S\\UP")
    combined = flat.contains("\\O\\AC(") | (flat.contains("\\O(\\S\\UP") & flat.contains("\\S\\DO"))
    return F.when(ruby, F.lit("Ruby")).when(combined, F.lit("CombineCharacters"))


def has_formatting_switch(instruction: Column) -> Column:
    up = F.upper(instruction)
    return up.contains("\\*") | up.contains("\\#") | up.contains("\\@") | up.contains("MERGEFORMAT")


def is_heading_style(name: Column) -> Column:
    return F.lower(F.trim(name)).rlike("^heading [1-9]$")


def is_on(value: Column) -> Column:
    """An on/off attribute: absent means on."""
    return F.coalesce(~F.lower(value).isin("0", "false", "off", "none"), F.lit(True))


def differs_from(value: Column, default: Column) -> Column:
    """A property that is there and is not its default."""
    return F.coalesce(value != default, F.lit(False))


def is_source_name(name: Column) -> Column:
    return name.rlike("^[a-z0-9-]+$")


def is_relative_path(path: Column) -> Column:
    """Stays inside its root everywhere: no empty, `.` or `..` segment, no backslash, colon or hidden character."""
    clean = ~path.rlike(rf"[\\:\x00-\x1F\x7F-\x9F{HIDDEN}]") & (path != "")
    return clean & F.forall(F.split(path, "/"), lambda s: ~s.isin("", ".", ".."))


def mark_family(key: Column) -> Column:
    """`family` of a mark key `family:name`; the key itself without a colon."""
    return F.substring_index(key, ":", 1)


def binding(kind: Column, ident: Column) -> Column:
    """A placeholder's binding: kind code and 32 hexadecimal digits."""
    return F.concat(kind, F.lit(":"), F.lpad(F.lower(ident), 32, "0"))


def utf16_length(text: Column) -> Column:
    """Units of UTF-16: characters beyond the basic plane count two."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def script_counts(text: Column) -> Column:
    """Map of script to number of its characters, without scripts that do not occur.

    Characters are counted by the length of what is left without the others, so no array of them is made; ASCII, of which only
    letters have a script, is left out before the scripts' own tables are asked.
    """
    only = lambda c, pattern: F.length(F.regexp_replace(c, pattern, ""))
    beyond = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    ascii_ = only(text, "[^A-Za-z]+")

    def count(rest: Column) -> Column:
        own = lambda s: F.when(rest == "", 0).otherwise(only(rest, rf"\P{{Is{s}}}+"))
        pairs = F.array(*(F.struct(F.lit(s).alias("key"), ((own(s) + ascii_) if s == "Latin" else own(s)).cast("long").alias("value")) for s in SCRIPTS))
        return F.filter(pairs, lambda p: p["value"] > 0)

    return F.map_from_entries(F.flatten(F.transform(F.array(beyond), count)))


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def card_prefix(digits: Column) -> Column:
    return digits.rlike("^[3-6]") & ~digits.rlike("^(?:30000|40000|50000)")


def iban_valid(text: Column) -> Column:
    """Fifteen characters at least and remainder 1 modulo 97, letters as 10 to 35."""
    flat = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))
    alphabet = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def step(acc: Column, c: Column) -> Column:
        n = F.instr(alphabet, c) - 1
        return F.pmod(acc * F.when(n < 10, F.lit(10)).otherwise(F.lit(100)) + n, F.lit(97))

    return (F.length(flat) >= 15) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


def graphemes(text: Column) -> Column:
    """User-perceived characters, by the JVM's regex; close to, not the same as, a full segmentation library."""
    return F.regexp_extract_all(text, F.lit(r"\X"), 0)
