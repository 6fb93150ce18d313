"""Alignment of two renderings of one text, break matching, and the agreement measures M1 to M4 and M7.

One document is one unit of work: the lines of both its sides meet, since each step depends on the last. Streams longer than MAX_CHARS are
refused with a reason, so a row's work is bounded.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby, islice
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import EXACT, SUB
from .sequence import increasing, joined_lines

GRAM, DEPTH, EDITS, TOLERATED = 32, 8, 2048, 32
MAX_CHARS = 1 << 24
WORK = 4_000_000_000

Hunk = tuple[int, int, int, int, bool]  # reference from, to, candidate from, to, equal


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    step = np.flatnonzero(a[:n] != b[:n])
    return int(step[0]) if len(step) else n


class Aligner:
    """Alignment within a budget of work; `complete` tells whether it sufficed."""

    def __init__(self, a: np.ndarray, b: np.ndarray, work: int = WORK):
        self.a, self.b, self.left, self.complete = a, b, work, True
        self.found: list[Hunk] = []
        self.align(0, len(a), 0, len(b), 0)

    def add(self, p: int, q: int, r: int, s: int, equal: bool) -> None:
        if q > p or s > r:
            self.found.append((p, q, r, s, equal))

    def align(self, p: int, q: int, r: int, s: int, depth: int) -> None:
        head = common(self.a[p:q], self.b[r:s])
        self.add(p, p + head, r, r + head, True)
        p, r = p + head, r + head
        tail = common(self.a[p:q][::-1], self.b[r:s][::-1])
        q, s = q - tail, s - tail
        self.left -= head + tail + 2
        if p == q or r == s:
            self.add(p, q, r, s, False)
        elif self.left <= 0:
            self.complete = False
            self.add(p, q, r, s, False)
        else:
            deep = depth < DEPTH and min(q - p, s - r) >= 2 * GRAM
            anchors = self.anchors(p, q, r, s) if deep else []
            if anchors:
                x, y = p, r
                for i, j, n in [*anchors, (q, s, 0)]:
                    self.align(x, i, y, j, depth + 1)
                    self.add(i, i + n, j, j + n, True)
                    x, y = i + n, j + n
            else:
                self.edits(p, q, r, s)
        self.add(q, q + tail, s, s + tail, True)

    def anchors(self, p: int, q: int, r: int, s: int) -> list[tuple[int, int, int]]:
        """Runs of GRAM characters that occur once on each side, in the longest chain that ascends on both, as blocks (a, b, length)."""
        def once(x: np.ndarray) -> dict[bytes, int]:
            data = x.tobytes()
            grams = [data[4 * i : 4 * (i + GRAM)] for i in range(len(x) - GRAM + 1)]
            times = Counter(grams)
            return {g: i for i, g in enumerate(grams) if times[g] == 1}

        self.left -= (q - p + s - r) * 20
        left, right = once(self.a[p:q]), once(self.b[r:s])
        pairs = sorted((i, right[g]) for g, i in left.items() if g in right)
        out: list[list[int]] = []
        for k in increasing([j for _, j in pairs]):
            i, j = pairs[k][0] + p, pairs[k][1] + r
            if out and i - out[-1][0] == j - out[-1][1] and i <= out[-1][0] + out[-1][2]:
                out[-1][2] = max(out[-1][2], i + GRAM - out[-1][0])
            elif not out or (i >= out[-1][0] + out[-1][2] and j >= out[-1][1] + out[-1][2]):
                out.append([i, j, GRAM])
        return [(i, j, n) for i, j, n in out]

    def edits(self, p: int, q: int, r: int, s: int) -> None:
        """The fewest insertions and deletions, up to EDITS; beyond, one difference. Furthest points by diagonal, insertion only if strictly further."""
        a, b = self.a[p:q], self.b[r:s]
        n, m = len(a), len(b)
        if abs(n - m) > EDITS:
            return self.add(p, q, r, s, False)
        reach: dict[int, int] = {1: 0}
        rounds: list[dict[int, int]] = []
        for d in range(min(EDITS, n + m) + 1):
            now: dict[int, int] = {}
            for k in range(-d, d + 1, 2):
                insert = k == -d or (k != d and reach[k - 1] < reach[k + 1])
                x = reach[k + 1] if insert else reach[k - 1] + 1
                run = common(a[x:], b[x - k :]) if 0 <= x - k <= m and x <= n else 0
                self.left -= run + 1
                now[k] = x + run
                if now[k] >= n and now[k] - k >= m:
                    rounds.append(now)
                    return self.trace(rounds, p, q, r, s)
            rounds.append(now)
            reach = {**reach, **now}
            if self.left <= 0:
                self.complete = False
                break
        self.add(p, q, r, s, False)
        return None

    def trace(self, rounds: list[dict[int, int]], p: int, q: int, r: int, s: int) -> None:
        steps: list[Hunk] = []
        x, y = q - p, s - r
        for d in range(len(rounds) - 1, 0, -1):
            last, k = rounds[d - 1], x - y
            insert = k == -d or (k != d and last[k - 1] < last[k + 1])
            u = last[k + 1] if insert else last[k - 1]
            v = u - (k + 1) if insert else u - (k - 1)
            i, j = (u, v + 1) if insert else (u + 1, v)
            steps += [(p + i, p + x, r + j, r + y, True), (p + u, p + i, r + v, r + j, False)]
            x, y = u, v
        steps.append((p, p + x, r, r + y, True))
        for h in reversed(steps):
            self.add(*h)

    def hunks(self) -> list[Hunk]:
        """Neighbours of one kind joined."""
        out: list[Hunk] = []
        for h in self.found:
            if out and out[-1][4] == h[4]:
                out[-1] = (out[-1][0], h[1], out[-1][2], h[3], h[4])
            else:
                out.append(h)
        return out


def slide(hunks: list[Hunk], reference: np.ndarray, breaks: list[int]) -> list[Hunk]:
    """Move each deletion between equal text as far as the text allows, so that the fewest breaks lie strictly inside it and, if possible, one at its end.

    Of equally good places the nearest, left on a tie. The equal text before may vanish only at the start of both streams.
    """
    marks = np.array(breaks, np.int64)
    at_break = set(breaks)
    out = list(hunks)

    def inside(start: int, end: int) -> int:
        return max(0, int(np.searchsorted(marks, end, "left") - np.searchsorted(marks, start, "right")))

    for k in range(1, len(out) - 1):
        before, (p, q, r, s, equal), after = out[k - 1], out[k], out[k + 1]
        if equal or s > r or not (before[4] and after[4]):
            continue
        room = before[1] - before[0] - (k > 1)
        back = common(reference[p - room : p][::-1], reference[q - room : q][::-1]) if room > 0 else 0
        ahead = max(0, after[1] - after[0] - 1)
        forward = common(reference[p : p + ahead], reference[q : q + ahead])
        options = sorted(range(-back, forward + 1), key=lambda m: (inside(p + m, q + m), q + m not in at_break, abs(m), m > 0))
        if m := options[0]:
            out[k - 1] = (before[0], before[1] + m, before[2], before[3] + m, True)
            out[k] = (p + m, q + m, r + m, s + m, False)
            out[k + 1] = (after[0] + m, after[1], after[2] + m, after[3], True)
    return out[1:] if out and out[0][4] and out[0][0] == out[0][1] else out


def images(hunks: list[Hunk], breaks: list[int], length: int) -> list[tuple[int, int, bool]]:
    """(low, high, strong) for each break of the reference: where in the candidate it may lie; low above high: nowhere.

    Strong: the text after the break is aligned, or the break ends the stream.
    """
    out = []
    starts = np.array([h[0] for h in hunks], np.int64)
    ends = np.array([h[1] for h in hunks], np.int64)
    for at in breaks:
        places: list[int] = [0] if not hunks and at == 0 else []
        strong = at == length
        for p, q, r, s, equal in hunks[int(np.searchsorted(ends, at, "left")) : int(np.searchsorted(starts, at, "right"))] if at <= length else []:
            if equal:
                places.append(r + at - p)
                strong |= p <= at < q
            elif p == q:
                places += [r, s]
            elif at == p:
                places.append(r)
            elif at == q:
                places.append(s)
            elif q - p <= TOLERATED and 2 <= s - r <= TOLERATED:
                places += [r + 1, s - 1]
        out.append((min(places), max(places), strong) if places else (1, 0, False))
    return out


def match_breaks(where: list[tuple[int, int, bool]], candidate: list[int]) -> list[int | None]:
    """For each reference break the candidate break it pairs with: strong ones first, each the first unused that its image allows."""
    paired: list[int | None] = [None] * len(where)
    free = list(range(len(candidate)))
    for turn in (True, False):
        at = 0
        for i, (low, high, strong) in enumerate(where):
            if strong != turn or low > high:
                continue
            while at < len(free) and candidate[free[at]] < low:
                at += 1
            if at < len(free) and candidate[free[at]] <= high:
                paired[i] = free[at]
                at += 1
        used = set(paired)
        free = [j for j in free if j not in used]
    return paired


def ranges_of(flags: list[bool]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for i, ok in enumerate(flags):
        if ok and out and out[-1][1] == i:
            out[-1] = (out[-1][0], i + 1)
        elif ok:
            out.append((i, i + 1))
    return out


HIDDEN = {*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), 0x061C, 0xFEFF}
SPACES = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
SPELLED = {0xAD: "-", 0x2010: "-", 0x2011: "-", 0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "ſt", 0xFB06: "st"}
TABLE = {**dict.fromkeys(HIDDEN | SPACES, ""), **SPELLED}


def comparable(text: str) -> str:
    return text.translate(TABLE)


#: comparable() of a glyph's few characters, which recur.
shown = lru_cache(1 << 16)(comparable)


Glyph = tuple[int, int, int, int]  # offset and length in the line's text, x and y of the origin in thousandths of a point
#: Distances beyond this many thousandths of a point are reported as this one.
MOST_MILLI = 10**12


class Line(NamedTuple):
    """A joined line: its comparable characters from start to end, its page, and its rows (text, glyphs)."""

    start: int
    end: int
    page: int
    rows: list[tuple[str, list[Glyph]]]


class Stream:
    """The comparable text of one side, with where its pages and its joined lines begin; those without characters take no part."""

    def __init__(self, lines: list[tuple], page_count: int):
        """lines: (page, line, baseline, size, text) and perhaps glyphs, in any order."""
        parts, self.pages, self.page_numbers, self.joined, at = [], [], [], [], 0
        self.page_count = page_count
        for number, page in groupby(sorted(lines, key=lambda r: r[:2]), key=lambda r: r[0]):
            rows = list(page)
            groups = joined_lines([r[2] for r in rows], [r[3] for r in rows])
            begin = at
            for _, members in groupby(zip(rows, groups, strict=True), key=lambda x: x[1]):
                start, held = at, []
                for row, _ in members:
                    text = comparable(row[4] or "")
                    held.append((row[4] or "", (row[5] or []) if len(row) > 5 else []))
                    parts.append(text)
                    at += len(text)
                if at > start:
                    self.joined.append(Line(start, at, number, held))
            if at > begin:
                self.pages.append(begin)
                self.page_numbers.append(number)
        self.lines = [line.start for line in self.joined]
        self.text = "".join(parts)


def agreement(matches: list[int | None]) -> tuple[int, int, list[tuple[int, int]], int | None]:
    """(total, agreed, agreed ranges, first that disagrees)."""
    ok = [m is not None for m in matches]
    return len(ok), sum(ok), ranges_of(ok), next((i for i, x in enumerate(ok) if not x), None)


def shown_glyphs(line: Line) -> list[tuple[int, int, str]]:
    """(x, y, comparable text) of the glyphs that show something, by x; those at one x in their order."""
    out = [(x, y, c) for text, glyphs in line.rows for offset, length, x, y in glyphs if (c := shown(text[offset : offset + length]))]
    return sorted(out, key=itemgetter(0))


def distances_in_turn(mine: Line, yours: Line) -> list[tuple[int, int]] | None:
    """Distances (x, y) of the glyphs of two lines that show the same from left to right; null if they do not."""
    left, right = shown_glyphs(mine), shown_glyphs(yours)
    if len(left) != len(right) or any(a[2] != b[2] for a, b in zip(left, right, strict=True)):
        return None
    return [(abs(a[0] - b[0]), abs(a[1] - b[1])) for a, b in zip(left, right, strict=True)]


class Clusters:
    """Glyphs of a line that show the same characters, and the cluster of each comparable position."""

    def __init__(self, line: Line):
        self.origins: list[list[tuple[int, int]]] = []
        self.at: dict[int, int] = {}
        position = line.start
        for text, glyphs in line.rows:
            spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for offset, length, x, y in glyphs:
                if length > 0:
                    spans.setdefault((offset, length), []).append((x, y))
            mine: dict[int, int] = {}
            for (offset, length), origins in sorted(spans.items()):
                mine |= dict.fromkeys(range(offset, offset + length), len(self.origins))
                self.origins.append(origins)
            for i, c in enumerate(text):
                for _ in comparable(c):
                    if i in mine:
                        self.at[position] = mine[i]
                    position += 1

    def positions(self) -> dict[int, set[int]]:
        out: dict[int, set[int]] = {}
        for position, cluster in self.at.items():
            out.setdefault(cluster, set()).add(position)
        return out


def glyph_distances(mine: Line, yours: Line, partners: dict[int, int]) -> list[tuple[int, int]]:
    """Distances (x, y) of the glyphs of two lines whose breaks agree; partners: aligned positions of mine and yours.

    Lines with the same glyphs from left to right pair them in turn. Else clusters pair if all characters of each are aligned
    with those of the other only, and both have as many glyphs.
    """
    in_turn = distances_in_turn(mine, yours)
    if in_turn is not None:
        return in_turn
    ours, theirs = Clusters(mine), Clusters(yours)
    back = {q: p for p, q in partners.items()}
    wanted, out = theirs.positions(), []
    for cluster, positions in sorted(ours.positions().items()):
        images = {partners.get(p) for p in positions}
        partner = {theirs.at.get(q) for q in images}
        if len(partner) != 1 or None in partner or None in images:
            continue
        other = partner.pop()
        exact = images == wanted[other] and {back.get(q) for q in wanted[other]} == positions
        if exact and len(ours.origins[cluster]) == len(theirs.origins[other]):
            out += [(abs(a[0] - b[0]), abs(a[1] - b[1])) for a, b in zip(ours.origins[cluster], theirs.origins[other], strict=True)]
    return out


def bins(values: list[int]) -> list[dict]:
    """A mergeable histogram: (bin, n, most) of the bins that occur, as functions.numeric bins them."""
    held: dict[int, list[int]] = {}
    for v, n in Counter(values).items():
        e = v.bit_length() - 1
        b = held.setdefault(v if v < EXACT else (e - 11) * SUB + (v >> (e - 10)) - SUB + EXACT, [0, v])
        b[:] = b[0] + n, max(b[1], v)
    return [{"bin": b, "n": n, "most": most} for b, (n, most) in sorted(held.items())]


def spread(histogram: list[dict]) -> tuple[int | None, int | None, int | None]:
    """Median, 95th percentile (nearest rank, a bin's start) and maximum, none beyond MOST_MILLI; nothing of nothing."""
    total, found = sum(b["n"] for b in histogram), []
    for per_mille in (500, 950):
        rank, seen = max(1, -(-total * per_mille // 1000)), 0
        for b in histogram:
            seen += b["n"]
            if seen >= rank:
                number = b["bin"] - EXACT
                found.append(b["bin"] if number < 0 else (number % SUB + SUB) << (number // SUB + 1))
                break
    return tuple(min(v, MOST_MILLI) for v in (*found, histogram[-1]["most"])) if histogram else (None, None, None)


def compare(reference: Stream, candidate: Stream, work: int = WORK) -> dict:
    """M1 (page counts), M2 (page starts), M3 (line starts), M4 (glyphs) and how much text is aligned.

    Every page and line start with characters counts, the first too. Glyphs are measured on lines whose start and end agree, on
    pages whose starts agree with one another.
    """
    a, b = codes(reference.text), codes(candidate.text)
    aligner = Aligner(a, b, work)
    hunks = slide(aligner.hunks(), a, sorted({*reference.lines, *reference.pages}))
    pages = match_breaks(images(hunks, reference.pages, len(a)), candidate.pages)
    lines = match_breaks(images(hunks, reference.lines, len(a)), candidate.lines)
    m2, m3 = agreement(pages), agreement(lines)
    facing = {reference.page_numbers[i]: candidate.page_numbers[j] for i, j in enumerate(pages) if j is not None}
    ends = images(hunks, [line.end for line in reference.joined], len(a))
    measured, xs, ys = 0, [], []
    equal = [h for h in hunks if h[4]]
    starts = [h[0] for h in equal]
    for i, j in enumerate(lines):
        if j is None:
            continue
        mine, yours = reference.joined[i], candidate.joined[j]
        if not ends[i][0] <= yours.end <= ends[i][1] or facing.get(mine.page) != yours.page:
            continue
        measured += 1
        found = distances_in_turn(mine, yours)
        if found is None:  # only then does it matter which characters are aligned
            partners = {}
            for p, q, r, _, _ in equal[max(0, bisect_right(starts, mine.start) - 1) : bisect_right(starts, mine.end)]:
                for at in range(max(p, mine.start), min(q, mine.end)):
                    if yours.start <= r + at - p < yours.end:
                        partners[at] = r + at - p
            found = glyph_distances(mine, yours, partners)
        xs += [x for x, _ in found]
        ys += [y for _, y in found]
    x, y = bins(xs), bins(ys)
    matched = sum(q - p for p, q, _, _, same in hunks if same)
    return {
        "pages_reference": reference.page_count, "pages_candidate": candidate.page_count, "m2_total": m2[0], "m2_agreed": m2[1], "m2_first_difference": m2[3], "m3_total": m3[0], "m3_agreed": m3[1],
        "m3_first_difference": m3[3], "m4_lines": measured, "m4_glyphs": len(xs), "m4_x": x, "m4_y": y, **dict(zip(("x_median", "x_p95", "x_most"), spread(x), strict=True)), **dict(zip(("y_median", "y_p95", "y_most"), spread(y), strict=True)),
        "text_reference": len(a), "text_candidate": len(b), "text_matched": matched, "complete": aligner.complete, "hunks": len(hunks),
    }


BINS = "array<struct<bin:bigint,n:bigint,most:bigint>>"
MEASURES = f"pages_reference long, pages_candidate long, m2_total long, m2_agreed long, m2_first_difference long, m3_total long, m3_agreed long, m3_first_difference long, m4_lines long, m4_glyphs long, m4_x {BINS}, m4_y {BINS}, x_median long, x_p95 long, x_most long, y_median long, y_p95 long, y_most long, text_reference long, text_candidate long, text_matched long, complete boolean, hunks long, problem string"
KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), BINS: pa.list_(pa.struct([("bin", pa.int64()), ("n", pa.int64()), ("most", pa.int64())]))}


def paired(reference: DataFrame, candidate: DataFrame, function: Callable[[Stream, Stream], dict], schema: str) -> DataFrame:
    """(doc, ...) of function over both sides of each document, as streams; rows are (doc, page_count, page, line, baseline, size, text).

    A column glyphs, an array of (offset, length, x, y), is used where there is one. Lines of both sides are shuffled once, sorted
    by document, and cross to Python as lines: it holds a batch of those, one document and the measures of a few, however many
    documents there are. A document that only one side has meets an empty layout.
    """
    columns = [c.strip().split(" ", 1) for c in schema.split(", ")]
    names, kinds = [c[0] for c in columns], [KINDS[c[1]] for c in columns]
    parts = ("offset", "length", "x", "y")

    def side(rows: DataFrame, which: int) -> DataFrame:
        glyphs = [(F.col(f"glyphs.{n}") if "glyphs" in rows.columns else F.lit(None)).cast("array<bigint>").alias(n) for n in parts]
        return rows.select("doc", F.lit(which).alias("side"), F.col("page_count").cast("long"), F.col("page").cast("long"), F.col("line").cast("long"), F.col("baseline").cast("long"), F.col("size").cast("long"), "text", *glyphs)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(doc, side, page_count, line of a Stream) of each row."""
        for batch in batches:
            flat = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in batch.columns[8:]]
            some = (np.diff(flat[0][0]) > 0).tolist()
            for at in range(0, batch.num_rows, 1024):
                rows = zip(*(c.slice(at, 1024).to_pylist() for c in batch.columns[:8]), strict=True)
                for i, (doc, which, count, *line) in enumerate(rows, at):
                    glyphs = list(zip(*(values[offsets[i] : offsets[i + 1]].tolist() for offsets, values in flat), strict=True)) if some[i] else ()
                    yield doc, which, count, (*line, glyphs)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, Stream, Stream]]:
        for doc, rows in groupby(lines(batches), key=lambda r: r[0]):
            held: tuple[list, list] = ([], [])
            counts = [0, 0]
            for _, which, count, line in rows:
                held[which].append(line)
                counts[which] = max(counts[which], count or 0)
            if doc is not None:
                yield doc, Stream(held[0], counts[0]), Stream(held[1], counts[1])
            else:  # nulls are not the same document
                yield from ((doc, Stream(held[0] if i == 0 else [], counts[0] * (i == 0)), Stream(held[1] if i else [], counts[1] * i)) for i in (0, 1) if held[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = documents(batches)
        while some := list(islice(((d, function(x, y)) for d, x, y in every), 256)):
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.string()), *(pa.array([f.get(c) for _, f in some], k) for c, k in zip(names, kinds, strict=True))], ["doc", *names])

    both = side(reference, 0).unionByName(side(candidate, 1)).repartition("doc").sortWithinPartitions("doc")
    return both.mapInArrow(run, f"doc string, {schema}")


def compare_layouts(reference: DataFrame, candidate: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Measures of each document. Sides longer than max_chars get a problem and no measures, never a cut text."""

    def measure(x: Stream, y: Stream) -> dict:
        long = [n for n, s in (("reference", x), ("candidate", y)) if len(s.text) > max_chars]
        return {"problem": f"too long: {', '.join(long)}"} if long else compare(x, y)

    return paired(reference, candidate, measure, MEASURES)


def hint_agreement(text: str, hints: list[int], candidate: Stream) -> dict:
    """M7: hinted page breaks, positions in the displayed text, against the candidate's pages; hint i begins page i + 2."""
    a = codes(text)
    aligner = Aligner(a, codes(candidate.text))
    found = match_breaks(images(slide(aligner.hunks(), a, hints), hints, len(a)), candidate.pages)
    total, agreed, _, _ = agreement(found)
    return {"total": total, "agreed": agreed, "pages_reference": len(hints) + 1, "pages_candidate": candidate.page_count}


def visual_difference(a: np.ndarray, b: np.ndarray, threshold: int = 32) -> tuple[int, int]:
    """(pixels, differing) of two grey rasters of one size: sums of 3 x 3 neighbourhoods, edges repeated, that differ by more than nine thresholds."""
    if a.shape != b.shape:
        raise ValueError("rasters differ in size")

    def blurred(x: np.ndarray) -> np.ndarray:
        wide = np.pad(x.astype(np.int64), 1, mode="edge")
        return sum(wide[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3))

    return a.size, int((np.abs(blurred(a) - blurred(b)) > 9 * threshold).sum())


def image_comparison(a: np.ndarray, b: np.ndarray) -> dict:
    """Pixels, those that differ, beyond 2 and beyond 64, and the largest difference of a channel."""
    if a.shape != b.shape:
        raise ValueError("images differ in size")
    d = np.abs(a.astype(np.int64) - b.astype(np.int64)).reshape(a.shape[0] * a.shape[1], -1).max(axis=1)
    return {"pixels": len(d), "differing": int((d > 0).sum()), "beyond_2": int((d > 2).sum()), "beyond_64": int((d > 64).sum()), "largest": int(d.max(initial=0))}
