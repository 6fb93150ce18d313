"""Normalization of structured documents, its invariants, and the fold of edit operations."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Placeholder characters of atoms by kind.
ATOMS = {"\u0001": "paragraph", "\u0002": "break", "\u0003": "tab", "\u0004": "object", "\u0005": "field_begin", "\u0006": "field_separate", "\u0007": "field_end", "\u000e": "bookmark_start", "\u000f": "bookmark_end", "\u0010": "note"}
#: Atoms that stand for an entity of a registry.
BOUND = ("object", "bookmark_start", "bookmark_end", "note")
SECTION_DEFAULTS = {"width": 11906, "height": 16838, "margin_left": 1440, "margin_right": 1440, "margin_top": 1440, "margin_bottom": 1440}
MAX_TABLE_DEPTH = 32


def items(runs: DataFrame) -> DataFrame:
    """Runs (doc, story, seq, text, marks) into items (doc, story, pos, kind, char, entity, marks) by character.

    Placeholders become atoms of their kind, bound to the mark `bind`; other control characters but tab and line feed vanish.
    """
    table = F.create_map(*(F.lit(x) for pair in ATOMS.items() for x in pair))
    chars = runs.select("doc", "story", "seq", "marks", F.posexplode(F.split("text", "")).alias("i", "char")).where("char <> ''")
    kind = F.coalesce(F.element_at(table, F.col("char")), F.lit("text"))
    rows = chars.withColumn("kind", kind).where((F.col("kind") != "text") | ~F.col("char").rlike(r"[\x00-\x08\x0B-\x1F]"))
    order = Window.partitionBy("doc", "story").orderBy("seq", "i")
    storable = F.map_filter("marks", lambda k, v: (k != "bind") & v.isNotNull())
    return rows.select("doc", "story", (F.row_number().over(order) - 1).alias("pos"), "kind", "char", F.when(F.col("kind").isin(*BOUND), F.try_element_at("marks", F.lit("bind"))).alias("entity"), storable.alias("marks"))


def resolved(rows: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): bound atoms whose entity (doc, kind, id) is registered and used for the first time stay; the others go, each with its rule."""
    bound = F.col("kind").isin(*BOUND)
    known = registry.select("doc", F.col("kind").alias("k"), F.col("id").alias("entity"), F.lit(True).alias("is_known"))
    family = F.when(F.col("kind").startswith("bookmark"), "bookmark").otherwise(F.col("kind"))
    joined = rows.withColumn("k", F.when(bound, family)).join(known, ["doc", "k", "entity"], "left")
    again = F.row_number().over(Window.partitionBy("doc", "kind", "entity").orderBy("story", "pos"))
    judged = joined.withColumn("rule", F.when(bound & F.col("is_known").isNull(), "unregistered").when(bound & (again > 1), "used twice"))
    return judged.where("rule is null").select(rows.columns), judged.where("rule is not null").select(*rows.columns, "rule")


def unmatched_fields(rows: DataFrame) -> DataFrame:
    """(doc, story, pos) of the field delimiters that match nothing, found by a stack within each story."""
    from .sequence import fold_rows, matched_fields

    marks = rows.where(F.col("kind").startswith("field_")).withColumn("story_key", F.concat_ws("\u001f", "doc", "story"))

    def unmatched(story: Iterator[tuple]) -> Iterator[tuple]:
        return ((pos,) for pos, begin in matched_fields((p, kind.removeprefix("field_")) for p, kind in story) if begin is None)

    gone = fold_rows(marks, "story_key", "pos", ["kind"], unmatched, "pos int").select(F.split("story_key", "\u001f").alias("s"), "pos")
    return gone.select(F.col("s")[0].alias("doc"), F.col("s")[1].alias("story"), "pos")


def closed_stories(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, put): every story ends with a paragraph; one is put after the last item where it does not."""
    last = rows.groupBy("doc", "story").agg(F.max(F.struct("pos", "kind")).alias("l")).where("l.kind <> 'paragraph'")
    put = last.select("doc", "story", (F.col("l.pos") + 1).alias("pos"), F.lit("paragraph").alias("kind"), F.lit("\u0001").alias("char"), F.lit(None).cast("string").alias("entity"), F.create_map().cast("map<string,string>").alias("marks"))
    return rows.unionByName(put), put


def living_comments(rows: DataFrame, comments: DataFrame) -> DataFrame:
    """Marks of comments that are not in the document (doc, id) go; the set of a document's comments is one row."""
    ids = comments.groupBy("doc").agg(F.collect_set("id").alias("ids"))
    both = rows.join(ids, "doc", "left")
    live = F.map_filter("marks", lambda k, v: (T.mark_family(k) != "comment") | F.array_contains(F.coalesce("ids", F.array().cast("array<string>")), F.substring_index(k, ":", -1)))
    return both.withColumn("marks", live).select(rows.columns)


def sections(properties: DataFrame) -> DataFrame:
    """(doc, id, each property): sizes out of range or missing take their default."""
    def value(name: str) -> Column:
        v = F.try_element_at("props", F.lit(name)).try_cast("long")
        return F.when((v > 0) & (v < 31_680_000), v).otherwise(F.lit(SECTION_DEFAULTS[name])).cast("long").alias(name)

    return properties.select("doc", "id", *(value(n) for n in SECTION_DEFAULTS))


def tables(rows: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, cells) of tables that keep something: rows are (doc, parent table, pos, child row), cells (doc, parent row, pos, child story).

    A child belongs to its first parent; rows without cells go, then tables without rows. nested_tables() follows tables in cells.
    """
    once = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("doc", "child").orderBy("parent", "pos"))).where("n = 1 and child is not null").drop("n")
    cells = once(cells)
    rows = once(rows).join(cells.select("doc", F.col("parent").alias("child")).distinct(), ["doc", "child"], "left_semi")
    return rows, cells.join(rows.select("doc", F.col("child").alias("parent")).distinct(), ["doc", "parent"], "left_semi")


def normal_tables(main: str, stories: dict[str, list[str]], tables_: dict[str, list[str | None]], rows: dict[str, list[str | None]], cells: dict[str, str | None], depth: int = MAX_TABLE_DEPTH) -> tuple[list[tuple], Counter]:
    """((kind, id, parent, depth, story), counts): what a document shows of its tables, from its main story on, each part once.

    stories: the tables that stand in each, in order; tables_: rows of a table; rows: cells of a row; cells: the story of a cell. A
    reference to nothing is `missing`, a second one to the same part `twice`, a row or table that keeps nothing `empty`; a table
    nested deeper than `depth` is `too_deep`. A cell whose story does not exist or has an owner gets a virtual one, whose id
    follows from the cell's.
    """
    out: list[tuple] = []
    counts: Counter = Counter()
    seen: set[tuple[str, str]] = {("story", main)}

    def first(kind: str, ident: str | None, known) -> bool:
        if ident is None or ident not in known:
            counts["missing"] += 1
        elif (kind, ident) in seen:
            counts["twice"] += 1
        else:
            seen.add((kind, ident))
            return True
        return False

    def owned(cell: str) -> str:
        story = cells[cell]
        if story is not None and story in stories and ("story", story) not in seen:
            seen.add(("story", story))
            return story
        attempt = 0
        while True:
            virtual = hashlib.sha256(f"{cell}|story|{attempt}".encode()).hexdigest()[:32]
            if virtual not in stories and ("story", virtual) not in seen:
                seen.add(("story", virtual))
                counts["virtual_story"] += 1
                return virtual
            attempt += 1

    def show(story: str, level: int) -> list[tuple]:
        shown: list[tuple] = []
        for table in stories.get(story, []):
            if level > depth:
                counts["too_deep"] += 1
            elif first("table", table, tables_):
                kept: list[tuple] = []
                for row in tables_[table]:
                    if not first("row", row, rows):
                        continue
                    own: list[tuple] = []
                    for cell in rows[row]:
                        if first("cell", cell, cells):
                            inner = owned(cell)
                            own += [("cell", cell, row, level, inner), *show(inner, level + 1)]
                    if own:
                        kept += [("row", row, table, level, None), *own]
                    else:
                        counts["empty"] += 1
                if kept:
                    shown += [("table", table, story, level, None), *kept]
                else:
                    counts["empty"] += 1
        return shown

    out = show(main, 1)
    return out, counts


def nested_tables(parts: DataFrame, depth: int = MAX_TABLE_DEPTH) -> DataFrame:
    """(doc, kind, id, parent, depth, story) of the tables, rows and cells that a document shows, and a row (doc, kind `count:<rule>`, id n) for each rule.

    parts has (doc, kind, id, children, story): kind main, story (children: its tables), table (rows), row (cells) or cell (story).
    A document's parts meet in one task, sorted, and cross to Python with those of others; it holds one document at a time.
    """
    from .sequence import fold_rows

    def run(rows: Iterator[tuple]) -> list[tuple]:
        by: dict[str, dict] = {k: {} for k in ("story", "table", "row", "cell")}
        main = ""
        for kind, ident, children, story in rows:
            if kind == "main":
                main = ident
                by["story"][ident] = children or []
            elif kind in by:
                by[kind][ident] = story if kind == "cell" else children or []
        found, counts = normal_tables(main, by["story"], by["table"], by["row"], by["cell"], depth)
        return found + [(f"count:{rule}", str(n), None, None, None) for rule, n in sorted(counts.items())]

    return fold_rows(parts.withColumn("doc", F.col("doc").cast("string")), "doc", "kind", ["id", "children", "story"], run, "kind string, id string, parent string, depth long, story string")


def normalise(runs: DataFrame, registry: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, repairs): decode, unregistered and repeated atoms, fields, comment marks, closing paragraphs.

    repairs counts by document what each rule removed or added, where the rule is applied. Normalizing the result again changes
    nothing.
    """
    decoded = items(runs)
    kept, dropped = resolved(decoded, registry)
    loose = unmatched_fields(kept)
    matched = kept.join(loose, ["doc", "story", "pos"], "left_anti")
    closed, put = closed_stories(living_comments(matched, comments))
    order = Window.partitionBy("doc", "story").orderBy("pos")
    out = closed.withColumn("pos", F.row_number().over(order) - 1)
    rule = lambda df, name: df.select("doc", F.lit(name).alias("rule"))
    repairs = dropped.select("doc", "rule").unionByName(rule(loose, "unmatched field")).unionByName(rule(put, "closing paragraph"))
    return out, repairs.groupBy("doc", "rule").agg(F.count("*").alias("n")).select("doc", "n", "rule")


def merged_runs(rows: DataFrame) -> DataFrame:
    """Items back into runs: neighbours of text with the same marks become one (doc, story, run, text, marks)."""
    w = Window.partitionBy("doc", "story").orderBy("pos")
    key = F.to_json(F.struct(F.col("kind"), F.col("entity"), F.array_sort(F.map_entries("marks")).alias("marks")))
    rows = rows.withColumn("k", key)
    change = F.when((F.col("kind") == "text") & (F.col("k") == F.lag("k").over(w)), 0).otherwise(1)
    rows = rows.withColumn("c", change).withColumn("run", F.sum("c").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "char"))), lambda x: x["char"]), "")
    return rows.groupBy("doc", "story", "run").agg(text.alias("text"), F.first("marks").alias("marks"), F.first("entity").alias("entity"))


def invariants(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """(doc, invariant) of what a normalized document must never show; empty for what normalise() gives."""
    w = Window.partitionBy("doc", "story").orderBy("pos")
    dense = rows.withColumn("at", F.row_number().over(w) - 1).where("at <> pos").select("doc", F.lit("positions").alias("invariant"))
    last = rows.groupBy("doc", "story").agg(F.max(F.struct("pos", "kind")).alias("l")).where("l.kind <> 'paragraph'").select("doc", F.lit("closing paragraph").alias("invariant"))
    family = F.when(F.col("kind").startswith("bookmark"), "bookmark").otherwise(F.col("kind"))
    bound = rows.where(F.col("kind").isin(*BOUND)).select("doc", "kind", family.alias("k"), "entity")
    loose = bound.join(registry.select("doc", F.col("kind").alias("k"), F.col("id").alias("entity")), ["doc", "k", "entity"], "left_anti").select("doc", F.lit("registered").alias("invariant"))
    twice = bound.groupBy("doc", "kind", "entity").count().where("count > 1").select("doc", F.lit("used once").alias("invariant"))
    control = rows.where((F.col("kind") == "text") & F.col("char").rlike(r"[\x00-\x08\x0B-\x1F]")).select("doc", F.lit("no control characters").alias("invariant"))
    depth = F.sum(F.when(F.col("kind") == "field_begin", 1).when(F.col("kind") == "field_end", -1).otherwise(0))
    fields = rows.groupBy("doc", "story").agg(depth.alias("d")).where("d <> 0").select("doc", F.lit("fields closed").alias("invariant"))
    return dense.unionByName(last).unionByName(loose).unionByName(twice).unionByName(control).unionByName(fields).distinct()


def plain_text(rows: DataFrame) -> DataFrame:
    """(doc, story, text): what a reader sees; of a field only its result, between separator and end."""
    w = Window.partitionBy("doc", "story").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    code = F.sum(F.when(F.col("kind") == "field_begin", 1).when(F.col("kind") == "field_separate", -1).otherwise(0)).over(w)
    shown = rows.withColumn("code", code).where("code = 0 and kind in ('text', 'paragraph', 'tab', 'break')")
    char = F.when(F.col("kind").isin("paragraph", "break"), "\n").when(F.col("kind") == "tab", "\t").otherwise(F.col("char"))
    out = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", char.alias("c")))), lambda x: x["c"]), "")
    return shown.groupBy("doc", "story").agg(out.alias("text"))


class Story:
    """A story's characters with their marks, under edits; positions out of range refuse an edit and change nothing."""

    def __init__(self):
        self.cells: list[tuple[str, tuple]] = []
        self.refused = 0

    def apply(self, op: str, at: int, to: int, value: str) -> None:
        edits: dict[str, Callable[[], None]] = {"insert": lambda: self.put(at, value), "delete": lambda: self.cut(at, to), "format": lambda: self.mark(at, to, value, True), "clear": lambda: self.mark(at, to, value, False), "split": lambda: self.put(at, "\u0001"), "merge": lambda: self.join(at), "move": lambda: self.move(at, to, int(value or 0))}
        known = edits.get(op)
        if known is None or not 0 <= at <= len(self.cells) or (op in ("delete", "format", "clear", "move") and not at <= to <= len(self.cells)):
            self.refused += 1
        else:
            known()

    def put(self, at: int, text: str) -> None:
        marks = self.cells[at - 1][1] if at else ()
        self.cells[at:at] = [(c, marks) for c in text]

    def cut(self, at: int, to: int) -> None:
        del self.cells[at:to]

    def mark(self, at: int, to: int, name: str, on: bool) -> None:
        self.cells[at:to] = [(c, tuple(sorted({*m, name} if on else set(m) - {name}))) for c, m in self.cells[at:to]]

    def join(self, at: int) -> None:
        end = next((i for i in range(at, len(self.cells)) if self.cells[i][0] == "\u0001"), None)
        if end is None:
            self.refused += 1
        else:
            del self.cells[end]

    def move(self, at: int, to: int, target: int) -> None:
        part = self.cells[at:to]
        del self.cells[at:to]
        target = max(0, min(target, len(self.cells)))
        self.cells[target:target] = part

    def text(self) -> str:
        return "".join(c for c, _ in self.cells)


def edited(operations: DataFrame) -> DataFrame:
    """(story, text, marks, refused) after the operations (story, seq, op, at, to, value) of each story in order."""
    from .sequence import fold_rows

    def run(rows: Iterator[tuple]) -> list[tuple]:
        story, n = Story(), 0
        for n, (_, op, at, to, value) in enumerate(rows, 1):
            story.apply(op, at, to, value or "")
        return [(n, story.text(), sum(bool(m) for _, m in story.cells), story.refused)]

    return fold_rows(operations, "story", "seq", ["op", "at", "to", "value"], run, "operations long, text string, marked long, refused long")


PARAGRAPH, TABLE, OBJECT, COMMENT, BEGIN, SEPARATOR, END, OPEN, CLOSE = "\u0001", "\u0011", "\u0004", "\u0012", "\u0005", "\u0006", "\u0007", "\u000e", "\u000f"
#: Families of marks that text typed behind a marked character takes over; all others stay where they are.
SPREADING = ("r",)


class Refusal(Exception):
    """An edit that would break the document; it changes nothing."""


class Document:
    """A document under edits: stories of (character, marks, entity), tables as rows of cells' stories, and what atoms stand for.

    Every edit keeps the structure: a table stands at a block position (a story's start, or behind a paragraph's end or a table),
    nothing is typed between such a position and its table, and the last paragraph end stays. What would break it is refused.
    """

    def __init__(self):
        self.count = 0
        self.stories: dict[str, list[tuple[str, frozenset, str | None]]] = {}
        self.tables: dict[str, list[list[str]]] = {}
        self.entities: dict[str, dict] = {}
        self.main = self.new_story("")

    def new_id(self) -> str:
        self.count += 1
        return f"{self.count:08x}"

    def new_story(self, text: str) -> str:
        ident = self.new_id()
        self.stories[ident] = [*((c, frozenset(), None) for c in text), (PARAGRAPH, frozenset(), self.paragraph({}))]
        return ident

    def paragraph(self, props: dict) -> str:
        ident = self.new_id()
        self.entities[ident] = {"kind": "paragraph", **props}
        return ident

    def cells(self, story: str) -> list:
        if story not in self.stories:
            raise Refusal("no such story")
        return self.stories[story]

    @staticmethod
    def block(cells: list, at: int) -> bool:
        return at == 0 or cells[at - 1][0] in (PARAGRAPH, TABLE)

    def before_table(self, cells: list, at: int) -> bool:
        return at < len(cells) and cells[at][0] == TABLE and self.block(cells, at)

    def place(self, story: str, at: int, to: int | None = None) -> list:
        """The story's cells, if the positions lie before its last paragraph end."""
        cells = self.cells(story)
        if not 0 <= at < len(cells) or (to is not None and not at <= to < len(cells)):
            raise Refusal("position")
        return cells

    def type_at(self, story: str, at: int) -> list:
        cells = self.place(story, at)
        if self.before_table(cells, at):
            raise Refusal("not a block position")
        return cells

    def insert_text(self, story: str, at: int, text: str) -> None:
        if not text or any(c < " " and c not in "\t\n" for c in text):
            raise Refusal("text")
        cells = self.type_at(story, at)
        marks = frozenset(m for m in (cells[at - 1][1] if at else ()) if m.split(":")[0] in SPREADING)
        cells[at:at] = [(c, marks, None) for c in text]

    def breaks(self, cells: list, at: int, to: int) -> bool:
        """Whether the cells would lose a table's block position without [at, to)."""
        right = cells[to][0] if to < len(cells) else None
        return right == TABLE and at > 0 and cells[at - 1][0] not in (PARAGRAPH, TABLE)

    def delete(self, story: str, at: int, to: int) -> None:
        cells = self.place(story, at, to)
        if at == to:
            raise Refusal("position")
        if self.breaks(cells, at, to):
            raise Refusal("block structure")
        del cells[at:to]

    def format(self, story: str, at: int, to: int, mark: str, on: bool = True) -> None:
        cells = self.place(story, at, to)
        cells[at:to] = [(c, m | {mark} if on else m - {mark}, e) for c, m, e in cells[at:to]]

    def split_paragraph(self, story: str, at: int) -> str:
        cells = self.place(story, at)
        ahead = next(e for c, _, e in cells[at:] if c == PARAGRAPH)
        ident = self.paragraph({k: v for k, v in self.entities[ahead].items() if k != "kind"})
        cells.insert(at, (PARAGRAPH, frozenset(), ident))
        return ident

    def merge_paragraph(self, story: str, at: int) -> None:
        cells = self.cells(story)
        if not 0 <= at < len(cells) - 1 or cells[at][0] != PARAGRAPH:
            raise Refusal("not a paragraph end")
        if self.breaks(cells, at, at + 1):
            raise Refusal("block structure")
        del cells[at]

    def set_paragraph_property(self, paragraph: str, key: str, value: str) -> None:
        if self.entities.get(paragraph, {}).get("kind") != "paragraph":
            raise Refusal("no such paragraph")
        self.entities[paragraph][key] = value

    def insert_table(self, story: str, at: int, rows: int, columns: int) -> str:
        if rows < 1 or columns < 1:
            raise Refusal("last row or column")
        cells = self.place(story, at)
        if not self.block(cells, at):
            raise Refusal("not a block position")
        ident = self.new_id()
        self.tables[ident] = [[self.new_story("") for _ in range(columns)] for _ in range(rows)]
        cells.insert(at, (TABLE, frozenset(), ident))
        return ident

    def rows(self, table: str) -> list[list[str]]:
        if table not in self.tables:
            raise Refusal("no such table")
        return self.tables[table]

    def insert_row(self, table: str, index: int) -> None:
        rows = self.rows(table)
        if not 0 <= index <= len(rows):
            raise Refusal("position")
        like = rows[index] if index < len(rows) else rows[-1]
        rows.insert(index, [self.new_story("") for _ in like])

    def delete_row(self, table: str, index: int) -> None:
        rows = self.rows(table)
        if not 0 <= index < len(rows):
            raise Refusal("position")
        if len(rows) == 1:
            raise Refusal("last row or column")
        del rows[index]

    def move_row(self, table: str, index: int, to: int) -> None:
        rows = self.rows(table)
        if not (0 <= index < len(rows) and 0 <= to < len(rows)):
            raise Refusal("position")
        rows.insert(to, rows.pop(index))

    def insert_column(self, table: str, index: int) -> None:
        rows = self.rows(table)
        if not 0 <= index <= max(map(len, rows)):
            raise Refusal("position")
        for row in rows:
            row.insert(min(index, len(row)), self.new_story(""))

    def delete_column(self, table: str, index: int) -> None:
        rows = self.rows(table)
        if not 0 <= index < max(map(len, rows)):
            raise Refusal("position")
        losing = [row for row in rows if len(row) > index and len(row) > 1]
        if not losing:
            raise Refusal("last row or column")
        for row in losing:
            del row[index]

    def add_comment(self, story: str, at: int, to: int, text: str) -> str:
        cells = self.place(story, at, to)
        if at == to:
            raise Refusal("position")
        if self.before_table(cells, to):
            raise Refusal("not a block position")
        ident = self.new_id()
        self.entities[ident] = {"kind": "comment", "story": self.new_story(text)}
        cells.insert(to, (COMMENT, frozenset(), ident))
        self.format(story, at, to, f"cmt:{ident}")
        return ident

    def insert_field(self, story: str, at: int, code: str, result: str) -> str:
        if not code:
            raise Refusal("text")
        cells = self.type_at(story, at)
        ident = self.new_id()
        self.entities[ident] = {"kind": "field", "code": code}
        plain = lambda text: [(c, frozenset(), None) for c in text]
        atom = lambda c: [(c, frozenset(), ident)]
        cells[at:at] = [*atom(BEGIN), *plain(code), *atom(SEPARATOR), *plain(result), *atom(END)]
        return ident

    def insert_object(self, story: str, at: int) -> str:
        cells = self.type_at(story, at)
        ident = self.new_id()
        self.entities[ident] = {"kind": "object"}
        cells.insert(at, (OBJECT, frozenset(), ident))
        return ident

    def insert_bookmark(self, story: str, at: int, to: int, name: str) -> str:
        cells = self.place(story, at, to)
        if self.before_table(cells, at) or self.before_table(cells, to):
            raise Refusal("not a block position")
        ident = self.new_id()
        self.entities[ident] = {"kind": "bookmark", "name": name}
        cells.insert(to, (CLOSE, frozenset(), ident))
        cells.insert(at, (OPEN, frozenset(), ident))
        return ident

    def inside(self, story: str, part: list) -> bool:
        """Whether the story lies within what part holds, through its tables and comments."""
        for c, _, entity in part:
            owned = [s for row in self.tables.get(entity, []) for s in row] if c == TABLE else [self.entities[entity]["story"]] if c == COMMENT else []
            if any(s == story or self.inside(story, self.stories[s]) for s in owned):
                return True
        return False

    def move_range(self, story: str, at: int, to: int, target: str, place: int) -> None:
        cells, there = self.place(story, at, to), self.place(target, place)
        part, same = cells[at:to], story == target
        if not part or (same and at < place < to):
            raise Refusal("position")
        if self.breaks(cells, at, to):
            raise Refusal("block structure")
        for first, last in ((BEGIN, END), (OPEN, CLOSE)):
            if {e for c, _, e in part if c == first} != {e for c, _, e in part if c == last}:
                raise Refusal("would unbalance")
        if self.inside(target, part):
            raise Refusal("would create a cycle")
        if same and place in (at, to):
            return
        rest = cells[:at] + cells[to:] if same else there
        paste = place - (to - at) if same and place >= to else place
        if part[-1][0] not in (PARAGRAPH, TABLE) and self.before_table(rest, paste) or part[0][0] == TABLE and not self.block(rest, paste):
            raise Refusal("not a block position")
        del cells[at:to]
        there[paste:paste] = part

    def broken(self) -> list[str]:
        """Invariants that do not hold: none after any edits."""
        out = []
        for cells in self.stories.values():
            if not cells or cells[-1][0] != PARAGRAPH:
                out.append("a story ends with a paragraph")
            if any(c == TABLE and not self.block(cells, i) for i, (c, _, _) in enumerate(cells)):
                out.append("tables stand at block positions")
            bound = [e for c, _, e in cells if e is not None]
            if any(e not in self.entities and e not in self.tables for e in bound):
                out.append("atoms stand for entities")
        if any(not rows or any(not row for row in rows) for rows in self.tables.values()):
            out.append("tables have rows and rows cells")
        return out

    def text(self, story: str | None = None) -> str:
        """What a reader sees of a story, tables as their cells in turn."""
        out, code = [], 0
        for c, _, entity in self.stories[story or self.main]:
            code += {BEGIN: 1, SEPARATOR: -1}.get(c, 0)
            if c == TABLE:
                out += [self.text(s) for row in self.tables[entity] for s in row]
            elif not code and c >= " ":
                out.append(c)
            elif c == PARAGRAPH:
                out.append("\n")
        return "".join(out)


#: Edits of a simulation and their weights, which sum to 100.
WEIGHTS = {"insert_text": 30, "delete": 12, "format": 10, "split_paragraph": 10, "merge_paragraph": 5, "set_paragraph_property": 3, "insert_table": 4, "insert_row": 4, "delete_row": 3, "move_row": 2, "insert_column": 3, "delete_column": 2, "add_comment": 3, "insert_field": 3, "insert_object": 2, "insert_bookmark": 2, "move_range": 2}


def _pick(idents: list[str], number: int) -> str:
    """Identifiers are numbered as they are made and kept in that order, which is their own."""
    return idents[number % len(idents)]


#: Each edit's arguments, from what simulate() picked and its numbers; of an edit only its own are worked out.
ARGUMENTS: dict[str, Callable[..., tuple]] = {
    "insert_text": lambda doc, story, table, size, at, to, a, b, c, d, e: (story, b % size, "abcdefgh"[: 1 + c % 8]),
    "delete": lambda doc, story, table, size, at, to, a, b, c, d, e: (story, at, to),
    "format": lambda doc, story, table, size, at, to, a, b, c, d, e: (story, at, to, ("r:b", "link", "r:i")[d % 3], e % 4 > 0),
    "split_paragraph": lambda doc, story, table, size, at, to, a, b, c, d, e: (story, at),
    "merge_paragraph": lambda doc, story, table, size, at, to, a, b, c, d, e: (story, next((i for i in range(at, size) if doc.stories[story][i][0] == PARAGRAPH), size)),
    "set_paragraph_property": lambda doc, story, table, size, at, to, a, b, c, d, e: (_pick([k for k, v in doc.entities.items() if v["kind"] == "paragraph"], b), "align", ("left", "right")[c % 2]),
    "insert_table": lambda doc, story, table, size, at, to, a, b, c, d, e: (story, at, 1 + c % 3, 1 + d % 3),
    "insert_row": lambda doc, story, table, size, at, to, a, b, c, d, e: (table, b % 5),
    "delete_row": lambda doc, story, table, size, at, to, a, b, c, d, e: (table, b % 5),
    "move_row": lambda doc, story, table, size, at, to, a, b, c, d, e: (table, b % 4, c % 4),
    "insert_column": lambda doc, story, table, size, at, to, a, b, c, d, e: (table, b % 5),
    "delete_column": lambda doc, story, table, size, at, to, a, b, c, d, e: (table, b % 5),
    "add_comment": lambda doc, story, table, size, at, to, a, b, c, d, e: (story, at, to, "note"),
    "insert_field": lambda doc, story, table, size, at, to, a, b, c, d, e: (story, at, "PAGE", "1"),
    "insert_object": lambda doc, story, table, size, at, to, a, b, c, d, e: (story, at),
    "insert_bookmark": lambda doc, story, table, size, at, to, a, b, c, d, e: (story, at, to, "name"),
    "move_range": lambda doc, story, table, size, at, to, a, b, c, d, e: (story, at, to, (other := _pick(list(doc.stories), d)), e % len(doc.stories[other])),
}


def plans(seeds: list[int], steps: int) -> list[list[tuple[str, list[int]]]]:
    """Edits (kind, five numbers) of each seed: the same for the same seed anywhere (SplitMix64), drawn for all seeds at once."""
    import numpy as np

    kinds = [k for k, n in WEIGHTS.items() for _ in range(n)]
    start = np.array([s & (1 << 64) - 1 for s in seeds], np.uint64)[:, None]
    z = start + np.arange(1, 6 * steps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    draws = (z ^ z >> np.uint64(31)).reshape(len(seeds), steps, 6).tolist()
    return [[(kinds[n[0] % len(kinds)], n[1:]) for n in rows] for rows in draws]


def plan(seed: int, steps: int) -> list[tuple[str, list[int]]]:
    """The edits of one seed."""
    return plans([seed], steps)[0]


def simulate(edits: list[tuple[str, list[int]]]) -> tuple[Document, Counter]:
    """(document, stats) after the edits: numbers pick stories, places and tables; stats count applied and refused edits by reason."""
    doc, stats = Document(), Counter()
    for kind, (a, b, c, d, e) in edits:
        story = _pick(list(doc.stories), a)
        size = len(doc.stories[story])
        at, to = sorted((b % size, c % size))
        table = _pick(list(doc.tables), a) if doc.tables else ""
        try:
            getattr(doc, kind)(*ARGUMENTS[kind](doc, story, table, size, at, to, a, b, c, d, e))
            stats["applied"] += 1
        except Refusal as refused:
            stats[str(refused)] += 1
    return doc, stats


def shrink(edits: list, fails: Callable[[list], bool]) -> list:
    """Fewer edits that still fail: larger and then smaller pieces are left out while the failure stays."""
    size = len(edits)
    while size:
        at = 0
        while at < len(edits):
            less = edits[:at] + edits[at + size :]
            if fails(less):
                edits = less
            else:
                at += size
        size //= 2
    return edits


def simulated(seeds: DataFrame, steps: int) -> DataFrame:
    """(seed, applied, refused, stories, tables, broken, fingerprint) of each seed's simulation; broken lists invariants, joined.

    A seed is eight bytes and milliseconds of work, so seeds are spread over all cores, however few row groups hold them.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                seeds = batch.column(0).slice(i, 256).to_pylist()
                for seed, edits in zip(seeds, plans(seeds, steps), strict=True):
                    doc, stats = simulate(edits)
                    rows.append((seed, stats["applied"], steps - stats["applied"], len(doc.stories), len(doc.tables), ",".join(sorted(set(doc.broken()))), hashlib.sha256(doc.text().encode()).hexdigest()[:16]))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["seed", "applied", "refused", "stories", "tables", "broken", "fingerprint"])

    own = seeds.select(F.col("seed").cast("long"))
    return own.repartition(max(64, 4 * own.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "seed long, applied long, refused long, stories long, tables long, broken string, fingerprint string")
