"""URL filter: a bit-parallel wildcard automaton that runs all glob rules over each canonical URL at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: URLs of a batch are simulated side by side in blocks of at most this many bytes, sorted by length.
BLOCK_BYTES = 1 << 22


@dataclass(frozen=True)
class Rule:
    """`*` stands for any bytes but `/`, `**` for any bytes, `?` for one byte but `/`. weight: the greatest that fits decides."""

    name: str
    glob: str
    verdict: str
    weight: int


def domain_rule(rule: str, verdict: str) -> Rule:
    """A rule `host/path`: the host, its subdomains, and every path that starts with the rule's. Longer rules win."""
    return Rule(rule, "*." + rule + "**", verdict, len(rule))


class ShiftAnd:
    """Extended Shift-And: one bit for each position of each pattern, packed into 64-bit words.

    A step is D' = ((D << 1) & B[c]) | (D & L[c]): B has the positions that byte c can enter, L those whose wildcard loops on
    c. Wildcards may be empty, so a closure carries bits over loop positions; its length is the longest run of wildcards, here
    one as runs are joined when the glob is parsed.
    """

    def __init__(self, globs: Sequence[str]):
        tokens: list[tuple[str, int]] = []
        first, last = [], []
        for glob in globs:
            first.append(len(tokens))
            tokens += [("start", 0), *self.parse(glob)]
            last.append(len(tokens) - 1)
        self.words = -(-len(tokens) // 64)
        enter = np.zeros((256, self.words), np.uint64)
        loop = np.zeros((256, self.words), np.uint64)
        empty = np.zeros(self.words, np.uint64)
        start = np.zeros(self.words, np.uint64)
        for i, (kind, byte) in enumerate(tokens):
            w, bit = i // 64, np.uint64(1 << (i % 64))
            if kind == "start":
                start[w] |= bit
                continue
            fits = np.ones(256, bool)
            if kind in ("star", "any"):
                fits[ord("/")] = False
            elif kind == "byte":
                fits[:] = False
                fits[byte] = True
            if kind in ("star", "globstar"):
                loop[fits, w] |= bit
                empty[w] |= bit
            else:
                enter[fits, w] |= bit
        self.enter, self.loop, self.empty = enter, loop, empty
        self.start = self.close(start[None, :])[0]
        self.final = np.array(last)

    @staticmethod
    def parse(glob: str) -> list[tuple[str, int]]:
        data, out, i = glob.encode(), [], 0
        while i < len(data):
            if data[i] == ord("*"):
                n = i
                while i < len(data) and data[i] == ord("*"):
                    i += 1
                out.append(("globstar" if i - n > 1 else "star", 0))
            else:
                out.append(("any", 0) if data[i] == ord("?") else ("byte", data[i]))
                i += 1
        return out

    @staticmethod
    def shift(d: np.ndarray) -> np.ndarray:
        up = d << np.uint64(1)
        if d.shape[1] > 1:
            up[:, 1:] |= d[:, :-1] >> np.uint64(63)
        return up

    def close(self, d: np.ndarray) -> np.ndarray:
        return d | (self.shift(d) & self.empty)

    def run(self, urls: list[bytes]) -> np.ndarray:
        """Boolean matrix (urls, patterns): which patterns fit the whole of each URL."""
        out = np.zeros((len(urls), len(self.final)), bool)
        sizes = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and sizes[order[to]] * (to + 1 - at) <= BLOCK_BYTES:
                to += 1
            out[order[at:to]] = self.block([urls[i] for i in order[at:to]], sizes[order[at:to]])
            at = to
        return out

    def block(self, urls: list[bytes], sizes: np.ndarray) -> np.ndarray:
        widest = int(sizes[-1])
        table = np.zeros((len(urls), widest), np.uint8)
        table[np.arange(widest) < sizes[:, None]] = np.frombuffer(b"".join(urls), np.uint8)
        state = np.broadcast_to(self.start, (len(urls), self.words)).copy()
        for t in range(widest):
            live = int(np.searchsorted(sizes, t, side="right"))  # sorted by length: the rest has ended
            d, c = state[live:], table[live:, t]
            state[live:] = self.close((self.shift(d) & self.enter[c]) | (d & self.loop[c]))
        return (state[:, self.final // 64] >> (self.final % 64).astype(np.uint64) & np.uint64(1)).astype(bool)


LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return host.encode().translate(LOWER).decode(), slash + path


def canonical(host: str, path: str) -> bytes:
    """`.host/path`: the leading dot lets `*.org` fit the host org itself."""
    return ("." + host + path).encode()


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of pages.

    All rules run at once over each URL; of those that fit, the greatest weight decides (ties: the first in `rules`), else
    `default` with a null rule. Null URLs and URLs without `://` have an empty host and path and fit only rules that fit the
    bare dot. Null ids stay; repeated rows are judged each; an empty table gives an empty result; other columns of whatever
    name are not read. URLs of any length are simulated whole. One narrow pass: no shuffle, memory of BLOCK_BYTES or one URL.
    """
    ship(pages.sparkSession)
    rules = list(rules)
    machine = ShiftAnd([r.glob for r in rules]) if rules else None
    ranked = np.array(sorted(range(len(rules)), key=lambda i: (-rules[i].weight, i)), np.int64)
    id_type = pages.schema[id_col].dataType

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            names: list[str | None] = [None] * len(parts)
            verdicts = [default] * len(parts)
            if rules and parts:
                fits = machine.run([canonical(*p) for p in parts])[:, ranked]
                best = fits.argmax(axis=1)
                for i in np.flatnonzero(fits.any(axis=1)):
                    rule = rules[ranked[best[i]]]
                    names[i], verdicts[i] = rule.name, rule.verdict
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()), pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                [id_col, "host", "path", "rule", "verdict"],
            )

    return pages.select(F.col(id_col), F.col(url_col)).mapInArrow(judge, f"`{id_col}` {id_type.simpleString()}, host string, path string, rule string, verdict string")


def allowed(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The rows of pages that the filter allows (ids are taken as keys of pages)."""
    bad = judge_urls(pages, rules, default, id_col, url_col).where("verdict = 'block'").select(id_col).distinct()
    return pages.join(bad, id_col, "left_anti")
