"""SentencePiece encoding and decoding: distinct segmentations sampled without replacement by a perturbed A* search.

The lattice of a text has a node for each place in it and an edge for each piece that fits there. A path's probability is the
product of its pieces' weights over the sum for all paths. Gumbel top-k: the search keeps regions of paths, each with the
maximum of the perturbed log-probabilities of its paths, which is an exact bound as the region's mass is known from the
backward sums. It takes the region with the greatest bound; a path drawn from the region carries that value; the rest of the
region is cut into one region for each piece of the path (same pieces before, another piece there), whose maxima are Gumbels
truncated at the value. So paths come out distinct, in order of their perturbed log-probabilities, as if all had been perturbed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import release, ship

#: Lattices are built for the distinct words of so many characters of text at a time (whole documents).
BATCH_CHARS = 3 << 19
#: So far from a word's end backward sums are kept as they are; in longer words each place beyond has a level to which its sum is relative.
WORD_BYTES = 128
#: Weights are scaled by exp(SCALE) a byte, which cancels, so that sums over paths of WORD_BYTES stay within doubles.
SCALE = 5.0
#: Regions this far below the first are not kept: their chance to be taken is under e^-40.
FLOOR = -60.0
#: Pieces of a document among which regions are sought at first.
HEAD = 512
#: White space that no piece contains, runs of spaces with the word that follows, and spaces at the end.
WORDS = re.compile(r"[\n\t\r\x0b\x0c]| *[^ \n\t\r\x0b\x0c]+| +")


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((mix64(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Pieces:
    """The model's pieces as a byte trie, their log-probabilities, and bytes for decoding."""

    def __init__(self, model_file: str, temperature: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.byte_ids = np.full(256, sp.unk_id(), np.int32)
        self.bytes: list[bytes] = [b""] * n
        usual: list[tuple[int, bytes, float]] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace("▁", " ")
                self.bytes[i] = text.encode()
                if " " not in text.lstrip(" ") and not WORDS.match(text) is None and WORDS.match(text).end() == len(text):
                    usual.append((i, text.encode(), sp.get_score(i)))
        scores = np.array([s for _, _, s in usual])
        if np.all(scores == np.round(scores)):  # merge ranks of a BPE model, not log-probabilities: Zipf's law on the rank
            rank = np.where(scores < -1e6, np.arange(len(usual)), -scores)
            scores = -np.log(rank + 10.0)
        scores = scores / temperature
        self.scores = np.full(n, scores.min())
        self.scores[[i for i, _, _ in usual]] = scores
        self.least = float(scores.min())
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i, data, _ in usual:
            node = 0
            for b in data:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                node = children[node][b]
            ends.setdefault(node, i)
        # nodes with children first, so that the table has rows for those only
        inner = [k for k, c in enumerate(children) if c]
        place = np.zeros(len(children), np.int64)
        place[inner] = np.arange(len(inner))
        leaves = [k for k, c in enumerate(children) if not c]
        place[leaves] = len(inner) + np.arange(len(leaves))
        self.next = np.zeros((len(inner) + 1, 256), np.int32)  # 0: none, as the root has no parent; the last row is the leaves'
        for k in inner:
            for b, to in children[k].items():
                self.next[place[k], b] = place[to]
        self.inner = len(inner)
        self.piece = np.full(len(children), -1, np.int32)
        for k, i in ends.items():
            self.piece[place[k]] = i
        self.flat = self.next.reshape(-1)
        self.log_weight = self.scores + SCALE * np.array([len(x) for x in self.bytes])
        self.weight = np.exp(self.log_weight)

    def decode(self, ids) -> str:
        """The text of an encoding: pieces joined, less the space put before it."""
        table = self.bytes
        data = b"".join([table[i] for i in ids])
        return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def pieces(model_file: str, temperature: float) -> Pieces:
    return Pieces(model_file, temperature)


class Lattice:
    """Lattices of many words, side by side. Nodes are byte places (one more at each word's end), edges sorted by their node."""

    FIELDS = ("start", "end", "text", "degree", "base", "to", "id", "node", "cum", "total")

    def __init__(self, model: Pieces, words: list[bytes]):
        self.model = model
        size = np.fromiter(map(len, words), np.int32, len(words))
        # the zero after each word is its end's place; no piece has a zero byte, so no edge runs over it
        self.text = text = np.frombuffer(b"\0".join(words) + b"\0" if words else b"", np.uint8)
        self.end = (np.cumsum(size + 1, dtype=np.int64) - 1).astype(np.int32)
        self.start = self.end - size
        n = len(text)
        first = (text & 0xC0) != 0x80
        first[self.end] = False
        at = np.flatnonzero(first).astype(np.int32)
        first[self.end] = True
        edge_of = np.flatnonzero(first).astype(np.int32)  # characters and ends, in order: the next one ends a character
        char_end = edge_of[np.searchsorted(edge_of, at, side="right")] if len(at) else at
        width = (char_end - at).astype(np.int8)
        begin, to, ids = [], [], []
        single = np.zeros(len(at), bool)
        who, node, reach = np.arange(len(at), dtype=np.int32), np.zeros(len(at), np.int32), 0
        while len(who):
            node = model.flat.take((np.minimum(node, model.inner) << 8) + text.take(at.take(who) + reach, mode="clip"))
            live = np.flatnonzero(node)
            who, node = who.take(live), node.take(live)
            reach += 1
            piece = model.piece.take(node)
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                own = who.take(hit)
                begin.append(at.take(own))
                to.append(begin[-1] + np.int32(reach))
                ids.append(piece.take(hit))
                single[own[width.take(own) == reach]] = True
        alone = np.flatnonzero(~single)  # characters without a piece: one edge, later their bytes
        begin.append(at[alone])
        to.append(char_end[alone].astype(np.int32))
        ids.append(np.full(len(alone), -1, np.int32))
        self.degree = np.zeros(n, np.int32)
        slots = []
        for b in begin:  # places are distinct within one length
            now = self.degree.take(b)
            slots.append(now)
            self.degree[b] = now + 1
        self.base = (np.cumsum(self.degree, dtype=np.int64) - self.degree).astype(np.int32)
        begin = np.concatenate(begin)
        where = self.base.take(begin) + np.concatenate(slots)
        edges = len(begin)
        self.to, self.id, self.node = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges, np.int32)
        self.to[where], self.id[where], self.node[where] = np.concatenate(to), np.concatenate(ids), begin
        del begin, to, ids, slots, where
        weight = self.weight(slice(None))
        # backward sums, from the words' ends, a place of each word at a time
        self.total = total = np.zeros(n)
        total[self.end] = 1.0
        # natural logarithms that `total` leaves out; none where no word is long
        self.level = level = np.zeros(n) if len(words) and int(size.max()) > WORD_BYTES else None
        self.cum = np.empty(edges)
        order = np.argsort(-size, kind="stable")
        ends, longest = self.end[order], np.sort(size)
        for d in range(1, int(longest[-1]) + 1 if len(words) else 1):
            p = ends[: len(words) - int(np.searchsorted(longest, d))] - d
            deg = self.degree.take(p)
            if not deg.all():
                live = np.flatnonzero(deg)
                p, deg = p.take(live), deg.take(live)
            edge = self.base.take(p)
            far = d > WORD_BYTES
            if far and len(p):
                to = self.to.take(edge)
                level[p] = level.take(to) + np.log(total.take(to))
            acc = weight.take(edge) * (self.onward(edge) if far else total.take(self.to.take(edge)))
            self.cum[edge] = acc
            left, k = np.flatnonzero(deg > 1), 1
            while len(left):
                e = edge.take(left) + k
                part = acc.take(left) + weight.take(e) * (self.onward(e) if far else total.take(self.to.take(e)))
                acc[left] = part
                self.cum[e] = part
                k += 1
                left = left[deg.take(left) > k]
            total[p] = acc
        self.cum /= total.take(self.node)

    def weight(self, edges) -> np.ndarray:
        ids = self.id[edges]
        out = self.model.weight.take(ids, mode="wrap")
        lone = np.flatnonzero(ids < 0)
        if len(lone):
            out[lone] = np.exp((self.model.least + SCALE) * (self.to[edges][lone] - self.node[edges][lone]))
        return out

    def onward(self, edges: np.ndarray) -> np.ndarray:
        """The sum at each edge's end, relative to the level of its node."""
        to = self.to.take(edges)
        out = self.total.take(to)
        return out if self.level is None else out * np.exp(self.level.take(to) - self.level.take(self.node.take(edges)))

    def log_total(self, places: np.ndarray) -> np.ndarray:
        out = np.log(self.total.take(places))
        return out if self.level is None else out + self.level.take(places)

    def chance(self, edges: np.ndarray) -> np.ndarray:
        """Of each edge, given that a path is at its node."""
        return self.weight(edges) * self.onward(edges) / self.total.take(self.node.take(edges))

    def with_more(self, more: Lattice) -> Lattice:
        """The words of this and then those of `more`."""
        out = Lattice.__new__(Lattice)
        out.model = self.model
        places, edges = np.int32(len(self.text)), np.int32(len(self.to))
        shift = {"start": places, "end": places, "base": edges, "to": places, "node": places}
        for name in self.FIELDS:
            x = getattr(more, name)
            setattr(out, name, np.concatenate([getattr(self, name), x + shift[name] if name in shift else x]))
        levels = [x.level for x in (self, more)]
        out.level = None if levels[0] is levels[1] is None else np.concatenate([np.zeros(len(x.total)) if x.level is None else x.level for x in (self, more)])
        return out

    def walk(self, begin: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paths drawn by their probability from each place of begin to its word's end: (edges in order, number of each)."""
        count = np.zeros(len(begin), np.int32)
        who, edges = [], []
        active, place = np.arange(len(begin), dtype=np.int32), begin
        step = 0
        while True:
            degree = self.degree.take(place)
            live = np.flatnonzero(degree)
            if not len(live):
                break
            active, place, degree = active.take(live), place.take(live), degree.take(live)
            e = self.base.take(place)
            u = uniform(seed.take(active) + np.uint64(step))
            last = e + degree - 1
            more = np.flatnonzero((self.cum.take(e) < u) & (degree > 1))
            while len(more):
                now = e.take(more) + 1
                e[more] = now
                more = more[(self.cum.take(now) < u.take(more)) & (now < last.take(more))]
            who.append(active)
            edges.append(e)
            count[active] = step + 1
            place = self.to.take(e)
            step += 1
        out = np.empty(int(count.sum(dtype=np.int64)), np.int32)
        offset = np.cumsum(count, dtype=np.int64) - count
        for k, (a, e) in enumerate(zip(who, edges, strict=True)):
            out[offset.take(a) + k] = e
        return out, count

    def ids(self, edges: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of edges, byte pieces for characters without a piece; cuts (ends of each path) in ids; log weights of edges."""
        found = self.id.take(edges)
        alone = np.flatnonzero(found < 0)
        size = np.ones(len(edges), np.int32)
        size[alone] = self.to[edges[alone]] - self.node[edges[alone]]
        weights = self.model.log_weight.take(found, mode="wrap")
        weights[alone] = (self.model.least + SCALE) * size[alone]
        after = np.cumsum(size, dtype=np.int64)
        out = np.repeat(found, size) if int(size.sum()) > len(edges) else found
        for b in range(4):
            at = alone[size[alone] > b]
            out[after[at] - size[at] + b] = self.model.byte_ids[self.text[self.node[edges[at]] + b]]
        return out, np.concatenate([[0], after])[cuts], weights


GOLDEN = 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1
#: Frequent words of which a worker keeps the lattices from batch to batch, and how often a word must occur in a batch to count.
KEPT_WORDS, KEPT_TIMES = 80_000, 2


def scalar_uniform(x: int) -> float:
    return float(uniform(np.array([x & M64], np.uint64))[0])


def split_words(text: str) -> list[str]:
    """White space that no piece contains, and words with the spaces before them, of any length."""
    return WORDS.findall(" " + text)


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Kept:
    """Lattices of frequent words of at most WORD_BYTES."""

    def __init__(self, model: Pieces):
        self.numbers, self.lattice = Numbers(), Lattice(model, [])

    def note(self, fresh: list[str], times: np.ndarray) -> None:
        """Add the frequent of the fresh words while there is room."""
        frequent = np.flatnonzero(times >= KEPT_TIMES)[: max(0, KEPT_WORDS - len(self.numbers))]
        if len(frequent) < 1000 and len(self.numbers):
            return
        words = [fresh[i] for i in frequent if len(fresh[i].encode("utf-8", "replace")) <= WORD_BYTES]
        for w in words:
            self.numbers[w]  # noqa: B018
        self.lattice = self.lattice.with_more(Lattice(self.lattice.model, [w.encode("utf-8", "replace") for w in words]))


def topk(model: Pieces, texts: list[str | None], keys: np.ndarray, k: int, kept: Kept | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k tuples (ids, log-probability, perturbed log-probability, inclusion score), by falling perturbed value.

    keys (uint64) seed the draws, so a text and key give the same result in any batch.
    """
    kept = kept or Kept(model)
    numbers = Numbers(kept.numbers)
    old = len(numbers)
    number = numbers.__getitem__
    parts = [np.zeros(0, np.int32)]
    for text in texts:
        words = split_words(text) if text else []
        parts.append(np.fromiter(map(number, words), np.int32, len(words)))
    seq = np.concatenate(parts)
    bounds = np.cumsum([len(x) for x in parts])
    fresh = list(numbers)[old:]
    new = Lattice(model, [w.encode("utf-8", "replace") for w in fresh])
    lattice = kept.lattice.with_more(new) if old else new
    del new
    if len(kept.numbers) < KEPT_WORDS:
        kept.note(fresh, np.bincount(seq, minlength=len(numbers))[old:])
    n = len(texts)
    out: list[list[tuple[np.ndarray, float, float, float]]] = [[] for _ in range(n)]
    docs = np.repeat(np.arange(n), np.diff(bounds))
    mass = np.concatenate([[0.0], np.cumsum(lattice.log_total(lattice.start.take(seq)))])  # of all paths of the words before
    ordinal = (np.arange(len(seq)) - bounds[docs]).astype(np.uint64) * np.uint64(2 * WORD_BYTES)
    # a region: bound, sample it leaves, piece where it leaves it, edges not to be taken there, log-probability before, chance of those edges
    regions: list[list[tuple[float, int, int, tuple[int, ...], float, float]]] = [[] for _ in range(n)]
    samples: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]

    def seeds(r: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(keys + np.uint64((r * GOLDEN) & M64))

    def finish(which: list[int], edges: np.ndarray, count: np.ndarray, cut: np.ndarray, word_cut: np.ndarray, value: np.ndarray, branch: dict[int, tuple[int, tuple[int, ...], float, float]], r: int) -> None:
        """Note a sample of each document of `which`, and the regions it leaves. edges: of all, cut by document."""
        found, id_cut, weights = lattice.ids(edges, cut)
        paths = np.concatenate([[0.0], np.cumsum(weights)])[cut]
        seed = mix64(seeds(r))
        # regions begin at the branch: what lies before was cut when its parent was taken. The first HEAD pieces of each
        # document nearly always reach FLOOR; where they don't, all its pieces are looked at.
        begin = cut[:-1] + np.array([branch[d][0] if d in branch else 0 for d in which], np.int64)
        size = np.minimum(HEAD, cut[1:] - begin)
        end = np.cumsum(size)
        some = edges.take(np.arange(int(end[-1])) - np.repeat(end - size, size) + np.repeat(begin, size))
        chances = lattice.chance(some)
        logs = np.log(np.maximum(chances, 1e-300))
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        free_of = lattice.degree.take(lattice.node.take(some))
        for x, d in enumerate(which):
            a, b = int(cut[x]), int(cut[x + 1])
            own, g = edges[a:b], float(value[x])
            whole = float(paths[x + 1] - paths[x]) - float(mass[bounds[d + 1]] - mass[bounds[d]])
            out[d].append((found[id_cut[x] : id_cut[x + 1]], min(whole, 0.0), g, 1.0))
            samples[d].append((own, count[word_cut[x] : word_cut[x + 1]]))
            if a == b:
                continue
            s = len(samples[d]) - 1
            at, barred, start, barred_mass = branch.get(d, (0, (), 0.0, 0.0))
            p, q = int(end[x] - size[x]), int(end[x])
            lead, taken, free = sums[p:q] - sums[p], chances[p:q], free_of[p:q]
            if q - p < b - a - at and lead[-1] + logs[q - 1] > FLOOR:
                rest = own[at:]
                taken = lattice.chance(rest)
                step = np.log(np.maximum(taken, 1e-300))
                lead, free = np.cumsum(step) - step, lattice.degree.take(lattice.node.take(rest))
            if barred:
                taken, free = taken.copy(), free.copy()
                free[0] -= len(barred)
                taken[0] += barred_mass
            live = np.flatnonzero((free > 1) & (taken < 1 - 1e-14) & (lead > FLOOR))
            if not len(live):
                continue
            phi = start + lead[live] + np.log(1 - taken[live])
            u = uniform(seed[d] + np.uint64(1 << 40) + (live + at).astype(np.uint64))
            bound = phi - np.log(np.exp(np.minimum(phi - g, 700)) - np.log(u))
            best = np.argpartition(-bound, k)[:k] if len(bound) > k else range(len(bound))
            for y in best:
                j = int(live[y])
                regions[d].append((float(bound[y]), s, j + at, (*(barred if j == 0 else ()), int(own[j + at])), start + float(lead[j]), float(taken[j])))

    with np.errstate(over="ignore"):
        root = seeds(0)
        value = -np.log(-np.log(uniform(root + np.uint64(1 << 41))))
        edges, count = lattice.walk(lattice.start[seq], mix64(root[docs] + ordinal))
    word_end = np.concatenate([[0], np.cumsum(count)])
    finish(list(range(n)), edges, count, word_end[bounds], bounds, value, {}, 0)
    for r in range(1, k):
        which = [d for d in range(n) if regions[d]]
        if not which:
            break
        seed = seeds(r)
        begins, who_seed, heads, branch, values = [], [], [], {}, []
        for d in which:
            regions[d].sort(key=lambda q: -q[0])
            g, s, j, barred, before, barred_mass = regions[d].pop(0)
            own, own_count = samples[d][s]
            place = int(lattice.node[own[j]])
            options = [e for e in range(int(lattice.base[place]), int(lattice.base[place] + lattice.degree[place])) if e not in barred]
            chances = lattice.chance(np.array(options))
            with np.errstate(over="ignore"):
                u = scalar_uniform(int(seed[d]) + (1 << 42)) * chances.sum()
            e = options[min(int(np.searchsorted(np.cumsum(chances), u)), len(options) - 1)]
            word = int(np.searchsorted(np.cumsum(own_count), j, side="right"))
            starts = lattice.start[seq[bounds[d] + word : bounds[d + 1]]].copy()
            starts[0] = lattice.to[e]
            begins.append(starts)
            with np.errstate(over="ignore"):
                who_seed.append(mix64(seed[d] + ordinal[bounds[d] + word : bounds[d + 1]]))
            lead = own_count[:word].copy()
            heads.append((np.append(own[:j], e), lead, j + 1 - int(lead.sum())))
            branch[d] = (j, barred, before, barred_mass)
            values.append(g)
        walked, walked_count = lattice.walk(np.concatenate(begins), np.concatenate(who_seed))
        ends = np.concatenate([[0], np.cumsum(walked_count)])
        all_edges, all_count, cut, word_cut = [], [], [0], [0]
        at = 0
        for x in range(len(which)):
            own, lead, part = heads[x]
            m = len(begins[x])
            rest = walked[ends[at] : ends[at + m]]
            counts = walked_count[at : at + m].copy()
            counts[0] += part
            at += m
            all_edges += [own, rest]
            all_count += [lead, counts]
            cut.append(cut[-1] + len(own) + len(rest))
            word_cut.append(word_cut[-1] + len(lead) + m)
        finish(which, np.concatenate(all_edges), np.concatenate(all_count), np.array(cut), np.array(word_cut), np.array(values), branch, r)
    for d in range(n):
        kappa = max((q[0] for q in regions[d]), default=-np.inf)
        out[d] = [(ids, lp, g, float(-np.expm1(-np.exp(min(lp - kappa, 50.0)))) if kappa > -np.inf else 1.0) for ids, lp, g, _ in out[d]]
    return out


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, k: int = 2, model_file: str | None = None, temperature: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rank, log_prob, gumbel, inclusion, ids) for each row of docs: up to k distinct segmentations of the whole text.

    rank counts from 1 by falling perturbed log-probability `gumbel`; inclusion is the chance that the segmentation is above
    the (k+1)-th, given that one (1 if there are no more). Draws are seeded by the id, so repeated rows give the same result;
    a null id has a seed of its own. Null and empty texts have one segmentation, without pieces. Texts with fewer than k
    segmentations give them all. Pieces hold for spaces and words as the model does; characters without a piece, U+2581 among
    them, become byte pieces, so decoding is exact. Words of any length have one lattice. Regions of segmentations whose bound is
    FLOOR nats below the best are not searched (a chance of e^-60 a document). An empty table gives an empty result; other columns are not read. A batch
    holds BATCH_CHARS of text or one document. No shuffle.
    """
    ship(docs.sparkSession)
    path = model_file or default_model()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, temperature)
        kept = Kept(model)
        for batch in batches:
            texts = batch.column(2)
            sizes = [len(t.as_py() or "") for t in texts]
            at = 0
            while at < len(sizes):
                to, held = at + 1, sizes[at]
                while to < len(sizes) and held + sizes[to] <= BATCH_CHARS:
                    held += sizes[to]
                    to += 1
                keys = batch.column(1)[at:to].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                found = topk(model, texts[at:to].to_pylist(), keys, k, kept)
                counts = [len(f) for f in found]
                flat = [x for f in found for x in f]
                idents = batch.column(0)[at:to].take(pa.array(np.repeat(np.arange(to - at), counts)))
                offsets = np.concatenate([[0], np.cumsum([len(x[0]) for x in flat])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x[0] for x in flat]).astype(np.int32)))
                ranks = pa.array(np.concatenate([np.arange(1, c + 1) for c in counts]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([idents, ranks, *(pa.array(np.array([x[i] for x in flat], np.float64)) for i in (1, 2, 3)), ids], ["doc_id", "rank", "log_prob", "gumbel", "inclusion", "ids"])
                at = to
                del found, flat, idents, ids
                release()

    key = F.xxhash64(F.lit("segment"), F.col(id_col))
    return docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, rank int, log_prob double, gumbel double, inclusion double, ids array<int>")


def decode(encoded: DataFrame, model_file: str | None = None, ids_col: str = "ids") -> DataFrame:
    """encoded with a column `decoded`: the text of the ids. Null ids decode to null, no ids to the empty text."""
    ship(encoded.sparkSession)
    path = model_file or default_model()

    @F.arrow_udf(StringType())
    def text(ids: pa.Array) -> pa.Array:
        model = pieces(path, 1.0)
        return pa.array([None if x is None else model.decode(x) for x in ids.to_pylist()], pa.string())

    return encoded.withColumn("decoded", text(F.col(ids_col)))
