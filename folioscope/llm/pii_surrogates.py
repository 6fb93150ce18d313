"""PII surrogates: detected entities become keyed replacements of their type, gender, script and format. DataFrame functions only."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, lookup

#: Given names by script and gender, in title case; a name's surrogate is another of its own list.
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Peter Hans Karl Stefan Jürgen Wolfgang Pierre Michel Philippe François Louis Carlos Juan José Luis Miguel Antonio Francisco Javier".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Emily Anna Emma Laura Julia Ursula Sabine Petra Monika Marie Sophie Claire Camille Nathalie Isabelle María Carmen Isabel Lucía Pilar Teresa Elena".split(),
    ("cyrillic", "m"): "Иван Сергей Алексей Дмитрий Николай Михаил Андрей Владимир Павел Олег".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παναγιώτης".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Αγγελική Βασιλική".split(),
}
#: Titles by the gender of who bears them; they stay as they are.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "κ"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "κα"], "": ["Dr", "Prof"]}
#: Sixteen syllables of each script; a hexadecimal digit picks one.
SYLLABLES = {
    "latin": "ba do fe gi ka lo mu ne pa ri so tu va wel zan mor".split(),
    "cyrillic": "ба до фе ги ка ло му не па ри со ту ва вел зан мор".split(),
    "greek": "βα δο φε γι κα λο μυ νε πα ρι σο τυ θα βελ ζαν μορ".split(),
    "han": "安 博 成 德 恩 凡 光 海 佳 康 林 明 宁 瑞 文 雅".split(),
}
#: Letters that stand for letters of a script outside names; of other scripts Latin ones do.
ALPHABETS = {"cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "latin": "abcdefghijklmnopqrstuvwxyz"}
#: Chinese surnames in Latin letters; with a capitalised word behind them they begin a name.
SURNAMES = "Chen Guo Huang Liang Liu Wang Xie Xu Yang Zhang Zhao Zheng Zhou Zhu".split()
#: Words that, with a colon, are followed by a name in any script.
NAME_LABELS = "Contact|Customer|Kontakt|Kunde|Name|Nombre|Nom|Patient|Signed by|Имя|姓名|联系人"
#: Feminine surnames and the form they share with masculine ones, and the endings that a coined surname keeps.
FEMININE = ((r"(\p{L}{2,}(?:ов|ев|ёв|ин|ын))а$", "$1", "а"), (r"(\p{L}{2,}[сц]к)ая$", "$1ий", "ая"), (r"(\p{L}{3,})ová$", "$1", "ová"), (r"(\p{L}{2,}(?:ov|ev))a$", "$1", "a"), (r"(\p{L}{2,}[sc]k)a$", "$1i", "a"))
ENDINGS = r"(?<=\p{L}{2})(?:ский|цкий|ов|ев|ёв|ин|ын|а|я|ov|ev|ski|cki|a|ος|ης|ας|ου|α|η)$"
_names = "|".join(n for names in GIVEN.values() for n in names)
_titles = "|".join(t for ts in TITLES.values() for t in ts)
_word = r"\p{Lu}[\p{L}'’-]+"
#: In order: where two could begin at one place, the first is taken.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\d+.,/-])0[1-9]\d{1,3}[ /-]\d{6,8}(?![\d.,/-])|(?<![\d+.,/-])0[1-9](?:[ .]\d{2}){4}(?![\d.,/-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "person": rf"(?<!\p{{L}})(?=[\p{{Lu}}гκ])(?:(?:{_titles})\.? {_word}(?: {_word})?|(?:{_names}) {_word}|(?:{'|'.join(SURNAMES)}) \p{{Lu}}\p{{Ll}}{{1,9}}|(?<=(?:{NAME_LABELS}): ?){_word}(?: {_word}){{0,2}})(?!\p{{L}})|(?<=(?:姓名|联系人)[:：] ?)\p{{IsHan}}{{2,4}}(?!\p{{IsHan}})",
}
ALL = "|".join(PATTERNS.values())
#: Values longer than this (an entity of repeated parts) keep the pattern of their hash beyond it.
DIGEST = 64


def let(value: Column, body) -> Column:
    """body(value), with value computed once: SQL has no let, but a lambda's variable is one."""
    return F.transform(F.array(value), body)[0]


def kind_of(m: Column) -> Column:
    """The type of a match, from its own characters."""
    out = F.when(m.contains("@"), F.lit("email"))
    for kind in ("iban", "phone", "ssn", "ip", "card"):
        out = out.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind))
    return out.otherwise(F.lit("person"))


def canonical(kind: Column, m: Column) -> Column:
    """What makes two mentions one entity: layout and case do not count."""
    return F.when(kind.isin("email", "person"), F.lower(m)).when(kind == "ip", m).otherwise(F.upper(F.regexp_replace(m, "[^A-Za-z0-9+]", "")))


def hmac_hex(key: str, message: Column) -> Column:
    """HMAC-SHA256 of a text by its definition: two digests, over the key's inner and outer block."""
    block = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    block = block.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def digest(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    return hmac_hex(key, F.concat(kind, F.lit("|"), value, F.lit("|"), attempt.cast("string")))


def pick(hexes: Column, at: Column | int) -> Column:
    """A hexadecimal digit of the digest as a number; places go round."""
    place = F.pmod(F.lit(at) if isinstance(at, int) else at, F.lit(DIGEST)) + 1
    return F.instr(F.lit("0123456789abcdef"), F.substring(hexes, place, F.lit(1))) - 1


def reshaped(value: Column, hexes: Column, first: Column | int = 0) -> Column:
    """Characters from `first` on replaced one by one: digits by digits, letters by letters of their case, others kept."""
    first = F.lit(first) if isinstance(first, int) else first

    def letter(i: Column) -> Column:
        return F.pmod(pick(hexes, i) * 16 + pick(hexes, i + 7), F.lit(26)) + 1

    def foreign(c: Column, at: Column) -> Column:
        low = None
        for script, letters in ALPHABETS.items():
            one = F.substring(F.lit(letters), F.pmod(at, F.lit(len(letters))) + 1, F.lit(1))
            low = F.when(script_of(c) == script, one) if low is None else low.when(script_of(c) == script, one)
        low = low.otherwise(F.substring(F.lit(ALPHABETS["latin"]), at, F.lit(1)))
        return F.when(c.rlike(r"\p{Lu}"), F.upper(low)).otherwise(low)

    def one(c: Column, i: Column) -> Column:
        digit = F.pmod(pick(hexes, i) * 16 + pick(hexes, i + 7), F.lit(10)).cast("string")
        return (
            F.when(i < first, c)
            .when(c.rlike("[0-9]"), digit)
            .when(c.rlike("[a-z]"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), letter(i), F.lit(1)))
            .when(c.rlike("[A-Z]"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), letter(i), F.lit(1)))
            .when(c.rlike(r"\p{N}"), digit)
            .when(c.rlike(r"\p{L}"), foreign(c, letter(i)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def mod97(value: Column) -> Column:
    """The remainder of an IBAN's number: first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        n = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(n < 10, F.pmod(acc * 10 + n, F.lit(97))).otherwise(F.pmod(acc * 100 + n, F.lit(97)))

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def script_of(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(value.rlike(r"\p{IsGreek}"), F.lit("greek")).when(value.rlike(r"\p{IsHan}"), F.lit("han")).otherwise(F.lit("latin"))


def stem(value: Column) -> Column:
    """A surname in the form that men and women of the name share."""
    for pattern, shared, _ in FEMININE:
        value = F.regexp_replace(value, pattern, shared)
    return value


def inflected(low: Column, new: Column) -> Column:
    """A surrogate of stem(low), in the form that low has."""
    out = None
    for pattern, shared, ending in FEMININE:
        form = F.concat(F.regexp_replace(new, "(?:ий|i)$", ""), F.lit(ending)) if shared not in ("$1",) else F.concat(new, F.lit(ending))
        out = F.when(low.rlike(pattern), form) if out is None else out.when(low.rlike(pattern), form)
    return out.otherwise(new)


def given_map(key: str) -> dict[str, str]:
    """Each given name's surrogate: the next of its list in a keyed order, so it is another name and no two share it."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hmac.new(key.encode(), n.encode(), hashlib.sha256).digest())
        out |= {a.lower(): b.lower() for a, b in zip(order, order[1:] + order[:1], strict=True)}
    return out


def coined(value: Column, hexes: Column, attempt: Column) -> Column:
    """A name of the value's script from four syllables (two characters of Han), with the value's own ending; after some attempts from one more each, so that there is room for all."""
    out = None
    for script, syllables in SYLLABLES.items():
        table = F.array(*(F.lit(s) for s in syllables))
        places = F.sequence(F.lit(4), F.least(attempt + 2, F.lit(DIGEST - 1)))
        wider = F.when(attempt >= 2, F.array_join(F.transform(places, lambda i: F.element_at(table, pick(hexes, i) + 1)), "")).otherwise(F.lit(""))
        word = F.concat(*(F.element_at(table, pick(hexes, i) + 1) for i in range(2 if script == "han" else 4)), wider)
        out = F.when(script_of(value) == script, word) if out is None else out.when(script_of(value) == script, word)
    return F.concat(out, F.regexp_extract(value, ENDINGS, 0))


def email_surrogate(key: str, value: Column, hexes: Column, attempt: Column) -> Column:
    """Local part and domain are replaced each; the domain by its own hash, so addresses of one domain keep one. The last label stays."""
    # after some attempts a short local part grows, so that there is room for all
    wider = F.when(attempt >= 2, F.substring(F.translate(hexes, "0123456789", "ghijklmnop"), F.lit(50), F.least(attempt, F.lit(14)))).otherwise(F.lit(""))
    domain = F.substring_index(value, "@", -1)
    top = F.substring_index(domain, ".", -1)
    inner = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    new = let(digest(key, F.lit("domain"), domain, F.lit(0)), lambda h: reshaped(inner, h))
    return F.concat(reshaped(F.substring_index(value, "@", 1), hexes), wider, F.lit("@"), new, F.lit("."), top)


def card_surrogate(value: Column, hexes: Column) -> Column:
    """The first digit stays; the last makes the number pass the Luhn check, or not, as the value does."""

    def last(body: Column) -> Column:
        valid = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(body, d.cast("string"))))[0]
        off = F.when(F.call_function("luhn_check", value), F.lit(0)).otherwise(F.lit(1) + F.pmod(pick(hexes, 63), F.lit(9)))
        return F.concat(body, F.pmod(valid + off, F.lit(10)).cast("string"))

    return let(F.substring(reshaped(value, hexes, 1), F.lit(1), F.length(value) - 1), last)


def iban_surrogate(value: Column, hexes: Column) -> Column:
    """The country stays; the check digits are right, or not, as the value's are."""

    def checked(account: Column) -> Column:
        check = F.lit(98) - mod97(account) + F.when(mod97(value) == 1, F.lit(0)).otherwise(F.lit(1))
        return F.concat(F.substring(value, 1, 2), F.lpad(F.pmod(check, F.lit(100)).cast("string"), 2, "0"), F.substring(account, F.lit(5), F.length(value)))

    return let(F.concat(F.substring(value, 1, 2), F.lit("00"), F.substring(reshaped(value, hexes, 4), F.lit(5), F.length(value))), checked)


def ip_surrogate(value: Column, hexes: Column) -> Column:
    def octet(_: Column, i: Column) -> Column:
        return (F.pmod(pick(hexes, i * 3) * 256 + pick(hexes, i * 3 + 1) * 16 + pick(hexes, i * 3 + 2), F.lit(254)) + 1).cast("string")

    return F.array_join(F.transform(F.split(value, r"\."), octet), ".")


def substitute(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The surrogate of a canonical value, canonical itself; of a person's, a coined name."""

    def of(hexes: Column) -> Column:
        phone = reshaped(value, hexes, F.when(value.rlike(r"^\+[17]"), F.lit(2)).when(value.startswith("+"), F.lit(3)).otherwise(F.lit(0)))
        return (
            F.when(kind == "email", email_surrogate(key, value, hexes, attempt)).when(kind == "ip", ip_surrogate(value, hexes)).when(kind == "card", card_surrogate(value, hexes))
            .when(kind == "iban", iban_surrogate(value, hexes)).when(kind == "phone", phone).when(kind == "ssn", reshaped(value, hexes)).otherwise(coined(value, hexes, attempt))
        )

    return let(digest(key, kind, value, attempt), of)


def dressed(kind: Column, raw: Column, value: Column) -> Column:
    """A canonical surrogate in the layout and case of the mention it replaces."""

    def one(c: Column, i: Column) -> Column:
        nth = F.length(F.regexp_replace(F.substring(raw, F.lit(1), i), "[^A-Za-z0-9+]", ""))
        return F.when(c.rlike("[A-Za-z0-9+]"), F.substring(value, nth + 1, F.lit(1))).otherwise(c)

    laid = F.array_join(F.transform(F.split(raw, ""), one), "")
    upper = (raw == F.upper(raw)) & (raw != F.lower(raw))
    cased = F.when(upper & (F.length(raw) > 1), F.upper(value)).when(raw.rlike(r"^\p{Lu}") & (kind == "person"), F.initcap(value)).otherwise(value)
    return F.when(kind == "email", F.when(upper, F.upper(value)).otherwise(value)).when(kind == "person", cased).when(kind == "ip", value).otherwise(laid)


def units(m: Column) -> Column:
    """The parts of a match that are replaced each: (kind, raw, canonical). Persons are names, without titles and given names of the lists."""
    kind = kind_of(m)
    title = rf"^(?:{_titles})\.?$"
    listed = rf"(?iu)^(?:{_names})$"
    names = F.filter(F.split(m, " "), lambda w: ~w.rlike(title) & ~w.rlike(listed))
    person = F.transform(names, lambda w: F.struct(F.lit("person").alias("kind"), w.alias("raw"), stem(F.lower(w)).alias("value")))
    return F.when(kind == "person", person).otherwise(F.array(F.struct(kind.alias("kind"), m.alias("raw"), canonical(kind, m).alias("value"))))


def may_hold(text: Column) -> Column:
    """What every entity implies and costs little to test; most prose has none of it and skips the patterns."""
    numbers = text.rlike("[0-9][0-9.() -]{4,}[0-9]|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")
    names = (text.rlike(r"\p{Lu}[\p{L}'’-]*\.? \p{Lu}|[\p{L}][:：] ?[\p{Lu}\p{IsHan}]") | text.contains("г-") | text.contains("κ")) & text.rlike(PATTERNS["person"])
    return text.contains("@") | numbers | names


def matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ALL), 0)


def values(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, value, n) of all entities; repeats are combined before the shuffle."""
    found = docs.where(may_hold(F.col(text_col))).select(F.explode(matches(F.col(text_col))).alias("m")).select(F.explode(units(F.col("m"))).alias("u"))
    return found.groupBy("u.kind", "u.value").agg(F.count("*").alias("n"))


def exceptions(known: DataFrame, key: str) -> DataFrame:
    """(name, attempt, n) of the values whose first surrogate would be shared or is itself a value of the corpus.

    Collision checks in rounds: of the values that want one surrogate the least gets it, unless another value is spelled so or an
    earlier round gave it away; the others try the next attempt. Each round handles what the last left.
    """
    taken, settled, open_, attempt = None, None, known, 0
    while True:
        wanted = open_.select("kind", "value", "n", substitute(key, F.col("kind"), F.col("value"), F.lit(attempt)).alias("to"))
        first = wanted.groupBy("kind", "to").agg(F.min("value").alias("first"), F.count("*").alias("want"))
        real = known.select("kind", F.col("value").alias("to"), F.lit(True).alias("is_real"))
        state = first.join(real, ["kind", "to"], "left")
        if taken is not None:
            state = state.join(taken.withColumn("is_taken", F.lit(True)), ["kind", "to"], "left")
        free = F.col("is_real").isNull() & (F.col("is_taken").isNull() if taken is not None else F.lit(True))
        verdict = keep(state.select("kind", "to", "first", "want", free.alias("free")))
        bad = verdict.where("want > 1 or not free")
        if not bad.limit(1).count():
            done = open_.select("kind", "value", "n").withColumn("attempt", F.lit(attempt))
            settled = done.where("false") if settled is None else settled.unionByName(done)
            break
        judged = wanted.join(bad, ["kind", "to"])
        losers = keep(judged.where("not free or value <> first").select("kind", "value", "n"))
        if attempt:
            won = open_.join(losers.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", "n").withColumn("attempt", F.lit(attempt))
            settled = won if settled is None else settled.unionByName(won)
        given = verdict.where("free").select("kind", "to")
        taken = given if taken is None else taken.unionByName(given)
        open_, attempt = losers, attempt + 1
    return keep(settled.select(F.concat("kind", F.lit("|"), "value").alias("name"), "attempt", "n"))


def rewrite(text: Column, found: Column, key: str, attempts: Column | None) -> Column:
    """The text with every entity replaced: what lies between matches, and their surrogates, in turn."""
    names = given_map(key)
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    title = rf"^(?:{_titles})\.?$"

    def tries(kind: Column, value: Column) -> Column:
        return F.lit(0) if attempts is None else F.coalesce(F.element_at(attempts, F.concat(kind, F.lit("|"), value)), F.lit(0))

    def name(w: Column) -> Column:
        kind = F.lit("person")
        coin = lambda low: let(stem(low), lambda base: inflected(low, substitute_person(key, base, tries(kind, base))))
        new = let(F.lower(w), lambda low: F.coalesce(F.element_at(table, low), coin(low)))
        return F.when(w.rlike(title), w).otherwise(let(new, lambda n: dressed(kind, w, n)))

    def plain(m: Column, kind: Column) -> Column:
        return let(let(canonical(kind, m), lambda v: substitute(key, kind, v, tries(kind, v))), lambda n: dressed(kind, m, n))

    def one(m: Column) -> Column:
        return let(kind_of(m), lambda kind: F.when(kind == "person", F.array_join(F.transform(F.split(m, " "), name), " ")).otherwise(plain(m, kind)))

    between = F.split(text, ALL, -1)
    new = F.concat(F.transform(found, one), F.array(F.lit("")))
    return F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, b))), "")


def substitute_person(key: str, value: Column, attempt: Column) -> Column:
    return let(digest(key, F.lit("person"), value, attempt), lambda h: coined(value, h, attempt))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text rewritten and two columns more, pii_count and pii_kinds (sorted, distinct).

    E-mail addresses, IBANs, phone and social security numbers, IP addresses, card numbers and persons (a title, a listed given
    name, a listed surname or a label such as `Name:` before capitalised words, or such a label before Han characters) get
    surrogates of the same type: digits for digits, letters for letters of the script, the same separators and case; cards and
    IBANs keep being valid, or not; titles stay. A listed given name becomes another of its gender and script, a real name too;
    other names are coined in their script with their own ending, and feminine surnames keep being those of the masculine ones.
    One value has one surrogate throughout the corpus, whatever its layout; two values never share one, and but for given names
    none is a value of the corpus, by collision checks over all distinct values.

    Surrogates follow from `key`, which is required and secret, by HMAC-SHA256. Null texts stay null with count 0; null ids and
    repeated rows are rewritten like others; an empty table gives an empty result; other columns are kept, but for columns named
    pii_count and pii_kinds, which are replaced. Texts of any length are rewritten whole. Where values collide, texts that hold
    them meet their attempts by the text's hash, in a join of checked size; texts without any are not looked at twice.
    """
    if not key:
        raise ValueError("a secret key is required")
    known = keep(values(docs, text_col))
    special = exceptions(known, key)
    text = F.col(text_col)
    attempts = None
    rows = docs
    if special.limit(1).count():
        here = F.xxhash64(text)
        mention = docs.where(may_hold(text)).select(here.alias("h"), F.explode(F.array_distinct(F.flatten(F.transform(matches(text), lambda m: F.transform(units(m), lambda u: F.concat(u["kind"], F.lit("|"), u["value"])))))).alias("name"))
        mention = mention.groupBy("h", "name").agg(F.count("*").alias("texts"))  # copies of a text are one row
        hit = lookup(mention, special, "name", "n", F.col("h")).where("attempt is not null")
        pair = F.struct("name", "attempt")
        maps = keep(hit.groupBy("h").agg(F.map_from_entries(F.collect_set(pair)).alias("__pii_attempts"), F.max("texts").alias("__pii_n"))).withColumnRenamed("h", "__pii_h")
        rows = lookup(docs.withColumn("__pii_h", F.when(may_hold(text), here)).withColumn("__pii_at", F.monotonically_increasing_id()), maps, "__pii_h", "__pii_n", F.col("__pii_at"))
        attempts = F.col("__pii_attempts")
    hit = F.coalesce(may_hold(text), F.lit(False))
    found = F.when(hit, matches(text)).otherwise(F.array().cast("array<string>"))
    out = rows.withColumn("__pii_found", F.explode(F.array(found)))  # a barrier: the patterns run once a text
    found = F.col("__pii_found")
    new = F.when(F.size(found) > 0, rewrite(text, found, key, attempts)).otherwise(text)
    out = out.withColumns({"__pii_new": new, "pii_count": F.size(found), "pii_kinds": F.array_sort(F.array_distinct(F.transform(found, kind_of)))})
    return out.withColumn(text_col, F.col("__pii_new")).select(*[c for c in docs.columns if c not in ("pii_count", "pii_kinds")], "pii_count", "pii_kinds")
