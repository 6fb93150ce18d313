"""Toxicity: a convolutional text classifier over hashed word embeddings, thresholds calibrated by language.

It learns from every labelled row that is not held out, whole texts: counts, gradients and thresholds are sums over all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import keep, measured, release, ship

#: Words, and their parts of GRAM bytes (with a mark at either end), are hashed into so many buckets.
BUCKETS, GRAM = 1 << 20, 5
#: A bucket needs so many training documents to have an embedding; other buckets are unknown and have none.
LEAST_DOCUMENTS = 3
SIZE, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
#: Log odds below so many standard deviations start at zero.
SURE = 2.0
#: Of the thresholds whose F1 is within this share of the best, the middle of the widest gap is taken.
NEAR_BEST = 0.97
#: Words scored at once on an executor.
SCORE_WORDS = 1 << 19
#: Gradients over all rows, and the first step's length.
STEPS, RATE = 10, 0.1
#: Each row's share of a gradient is rounded to so small a unit, so that sums are the same in any order.
UNIT = 2.0**-48
#: Windows of a text that are looked at together, and bytes that are split into words together.
PIECE = 1 << 16
#: Bytes of numbered texts in a task of a pass, about, so that few tasks send sums.
PASS_BYTES = 64 << 20
#: Cells of a unit of log odds in which calibrating rows are counted.
CELLS = 1024

#: A-Z lower-cased; other ASCII but letters is white space.
FOLD = bytes(ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(128)) + bytes(range(128, 256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features of distinct words: (word, bucket), sorted by word. The word itself, and its parts."""
    n = len(words)
    whole = np.fromiter(map(zlib.crc32, words), np.uint64, n)
    size = np.fromiter(map(len, words), np.int64, n) + 2
    data = np.frombuffer(b"<" + b"><".join(words) + b">" if n else b"", np.uint8).astype(np.uint64)
    end = np.cumsum(size)
    word = np.repeat(np.arange(n), size)
    at = np.flatnonzero(np.arange(len(data)) + GRAM <= end[word]) if n else np.zeros(0, np.int64)
    h = np.zeros(len(at), np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(0x100000001B3) + data[at + j] + np.uint64(1)
    word = np.concatenate([np.arange(n), word[at]])
    h = np.concatenate([whole, h ^ np.uint64(0xA5A5A5A5A5A5A5A5)])
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(word, kind="stable")
    return word[order], ((h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1))[order]


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes of all ranges, one after another."""
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - size, size) + np.repeat(start, size)


@dataclass
class Model:
    row: np.ndarray  # bucket -> row of the embedding; 0: unknown
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, SIZE, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float  # of the last layer; the calibrated threshold is score 0.5
    thresholds: dict[str, float] = field(default_factory=dict)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Windows reach two unknown words beyond each end, so every text has some."""
        numbers = Numbers()
        number = numbers.__getitem__
        parts, ends, at = [], [], 0
        pad = np.zeros(4, np.int32)  # windows that begin at one of the first two end in the others
        for text in texts:
            words = words_of(text)
            ends += [at, at + len(words) + 2]
            parts += [np.fromiter(map(number, words), np.int32, len(words)) + 1, pad]
            at += len(words) + 4
        ids = np.concatenate([*parts, pad])
        word, bucket = buckets(list(numbers))
        row = self.row[bucket]
        live = np.flatnonzero(row)
        word, row = word[live], row[live]
        vectors = np.zeros((len(numbers) + 1, SIZE))
        for d in range(SIZE):
            vectors[1:, d] = np.bincount(word, self.embedding[row, d], len(numbers))
        total = np.full(len(texts), self.shift)
        for k, (width, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            found = (vectors @ f[0]).astype(np.float32)[ids[:at]]
            for j in range(1, width):
                found += (vectors @ f[j]).astype(np.float32)[ids[j : at + j]]
            pooled = np.maximum.reduceat(found, ends, axis=0)[::2] if ends else np.zeros((0, FILTERS))
            total += np.maximum(pooled + self.bias[k], 0) @ self.out[k * FILTERS : (k + 1) * FILTERS]
        return total

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Of any number of texts, in turns of SCORE_WORDS, about."""
        out, held, size = [np.zeros(0)], [], 0
        for text in texts:
            held.append(text)
            size += len(text or "") // 5
            if size > SCORE_WORDS:
                out.append(self.logits(held))
                held, size = [], 0
        if held:
            out.append(self.logits(held))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -30, 30)))


#: Some labelled texts as numbers: words (0: none; four after each text), the texts' words, labels and languages; features as in buckets().
CHUNK = "clean long, toxic long, ids binary, size binary, label binary, lang array<string>, word binary, bucket binary"
SUMS = "at int, " + ", ".join(f"g{d} long" for d in range(SIZE))


def numbered(text: str, number) -> np.ndarray:
    """The numbers of a text's words, split by pieces, so that long texts are never a list of words."""
    data = text.encode("utf-8", "replace").translate(FOLD)
    out, at = [np.zeros(0, np.int32)], 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        out.append(np.fromiter(map(number, words), np.int32, len(words)))
        at = end
    return np.concatenate(out)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label, lang) as CHUNKs of SCORE_WORDS, about."""

    def pack(texts: list[str], labels: list[int], languages: list[str | None]) -> pa.RecordBatch:
        numbers = Numbers()
        number = numbers.__getitem__
        pad = np.zeros(4, np.int32)
        parts, size = [], []
        for text in texts:
            ids = numbered(text, number) + 1
            size.append(len(ids))
            parts += [ids, pad]
        word, bucket = buckets(list(numbers))
        row = {"clean": labels.count(0), "toxic": labels.count(1), "ids": np.concatenate(parts).astype(np.int32).tobytes()}
        row |= {"size": np.array(size, np.int64).tobytes(), "label": np.array(labels, np.int8).tobytes(), "lang": languages}
        row |= {"word": word.astype(np.int32).tobytes(), "bucket": bucket.astype(np.int32).tobytes()}
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], list(row))

    held, size = ([], [], []), 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for place, value in zip(held, row, strict=True):
                place.append(value)
            size += len(row[0]) // 5 + 4
            if size > SCORE_WORDS:
                yield pack(*held)
                held, size = ([], [], []), 0
                release()
    if held[0]:
        yield pack(*held)
    release()


@dataclass
class Chunk:
    ids: np.ndarray
    size: np.ndarray
    label: np.ndarray
    lang: list[str | None]
    word: np.ndarray
    bucket: np.ndarray

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
        kinds = {"ids": np.int32, "size": np.int64, "label": np.int8, "word": np.int32, "bucket": np.int32}
        for batch in batches:
            for i in range(batch.num_rows):
                arrays = {k: np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in kinds.items()}
                yield cls(lang=batch.column("lang")[i].as_py(), **arrays)

    @property
    def words(self) -> int:
        return int(self.ids.max(initial=0))

    def counts(self, sides: np.ndarray) -> None:
        """Add to (label, bucket) the texts of the label that hold the bucket."""
        size = np.bincount(self.word, minlength=self.words)
        start = np.cumsum(size) - size
        first = np.cumsum(self.size + 4) - self.size - 4
        for at, n, y in zip(first.tolist(), self.size.tolist(), self.label.tolist(), strict=True):
            own = np.unique(self.ids[at : at + n]) - 1
            sides[y][np.unique(self.bucket[spans(start[own], size[own])])] += 1

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Log odds, hidden values, winning places by width, words' vectors, features' rows. A text's values do not depend on the others."""
        row = model.row[self.bucket]
        vectors = np.zeros((self.words + 1, SIZE))
        if self.words:  # each has a feature at least: itself
            begin = np.flatnonzero(np.diff(self.word, prepend=-1))
            vectors[1:] = np.add.reduceat(model.embedding[row].astype(np.float64), begin, axis=0)
        # the first taps of all filters, then the second ones of those that have some, and so on
        taps = np.concatenate([f[j] for j in range(max(WIDTHS)) for f in model.filters if j < len(f)], axis=1).astype(np.float32)
        narrow = vectors.astype(np.float32)
        table = np.zeros((len(vectors), taps.shape[1]), np.float32)
        for d in range(SIZE):  # not by matmul, whose rounding depends on the number of words
            table += narrow[:, d : d + 1] * taps[d]
        first = np.cumsum(self.size + 4) - self.size - 4
        place = np.zeros((len(first), FILTERS * len(WIDTHS)), np.int64)
        best = np.full(place.shape, -np.inf, np.float32)
        columns = np.arange(place.shape[1])
        for i, (at, n) in enumerate(zip(first.tolist(), self.size.tolist(), strict=True)):
            for a in range(at, at + n + 2, PIECE):
                b = min(a + PIECE, at + n + 2)
                each = table.take(self.ids[a : b + 2], axis=0)
                at_tap = wide = len(columns)
                found = each[: b - a, :wide]
                for j in range(1, max(WIDTHS)):
                    more = FILTERS * sum(width > j for width in WIDTHS)
                    found[:, wide - more :] += each[j : b - a + j, at_tap : at_tap + more]
                    at_tap += more
                top = found.argmax(axis=0)
                value = found[top, columns]
                better = value > best[i]
                best[i][better], place[i][better] = value[better], a + top[better]
        h = best + np.concatenate(model.bias)
        places = [place[:, k * FILTERS : (k + 1) * FILTERS] for k in range(len(WIDTHS))]
        return (np.maximum(h, 0) * model.out).sum(axis=1) + model.shift, h, places, vectors, row

    def gradient(self, model: Model, weight: tuple[float, float], features: np.ndarray, dense: np.ndarray) -> None:
        """Add this chunk's share, in UNITs: to features (row, SIZE), and to dense: filters, biases, last layer, shift, loss."""

        def whole(x: np.ndarray) -> np.ndarray:
            return np.rint(x / UNIT).astype(np.int64)

        z, h, places, vectors, row = self.forward(model)
        y, w = self.label.astype(np.float64), np.array(weight)[self.label]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * w
        back = g[:, None] * model.out * (h > 0)
        of_words = np.zeros((len(vectors), SIZE), np.int64)
        parts = []
        for k, f in enumerate(model.filters):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(len(f)):
                words = self.ids[places[k] + j]
                parts.append(whole(vectors[words] * d[:, :, None]).sum(axis=0).T)
                i, c = np.nonzero((words > 0) & (d != 0))
                steps = whole(f[j].T[c] * d[i, c][:, None])
                for s in range(SIZE):
                    np.add.at(of_words[:, s], words[i, c], steps[:, s])
        parts += [whole(back).sum(axis=0), whole(g[:, None] * np.maximum(h, 0)).sum(axis=0), whole(g).sum(keepdims=True)]
        parts.append(whole(w * np.logaddexp(0, np.where(y == 1, -z, z))).sum(keepdims=True))
        dense += np.concatenate([np.ravel(p) for p in parts])
        live = np.flatnonzero((row > 0) & of_words.any(axis=1)[self.word + 1])
        for s in range(SIZE):
            np.add.at(features[:, s], row[live], of_words[self.word[live] + 1, s])


def counted(some: DataFrame) -> np.ndarray:
    """(label, bucket): the texts of the label that hold the bucket, of all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = np.zeros((2, BUCKETS), np.int64)
        for chunk in Chunk.of(batches):
            chunk.counts(sides)
        at = np.flatnonzero(sides.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sides[0][at]), pa.array(sides[1][at])], ["at", "clean", "toxic"])
        release()

    got = some.mapInArrow(run, "at int, clean long, toxic long").groupBy("at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    sides = np.zeros((2, BUCKETS), np.int64)
    for y, name in enumerate(("clean", "toxic")):
        sides[y][got["at"].to_numpy()] = got[name].to_numpy()
    return sides


def gradients(some: DataFrame, model: Model, weight: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all chunks, of features and of the dense parameters; the last one is the loss. Whole numbers, so no order matters."""
    n = sum(f.size for f in model.filters) + 2 * FILTERS * len(WIDTHS) + 2
    lines = -(-n // SIZE)  # the dense sums travel as rows below zero

    shipped = some.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        features, dense = np.zeros((len(model.embedding), SIZE), np.int64), np.zeros(n, np.int64)
        for chunk in Chunk.of(batches):
            chunk.gradient(model, weight, features, dense)
        at = np.flatnonzero(features.any(axis=1))
        values = np.concatenate([features[at], np.resize(np.append(dense, np.zeros(lines * SIZE - n, np.int64)), (lines, SIZE))])
        at = np.concatenate([at, -1 - np.arange(lines)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.ascontiguousarray(values[:, d])) for d in range(SIZE))], ["at", *(f"g{d}" for d in range(SIZE))])
        release()

    got = some.mapInArrow(run, SUMS).groupBy("at").agg(*(F.sum(f"g{d}").alias(f"g{d}") for d in range(SIZE))).toArrow()
    shipped.destroy()  # else each pass leaves a copy on every executor's disk
    at = got["at"].to_numpy()
    features, dense = np.zeros(model.embedding.shape), np.zeros((lines, SIZE))
    for d in range(SIZE):
        column = got[f"g{d}"].to_numpy() * UNIT
        features[at[at >= 0], d] = column[at >= 0]
        dense[-1 - at[at < 0], d] = column[at < 0]
    return features, dense.ravel()[:n]


def fit(some: DataFrame, count: list[int], seed: int = 7) -> Model:
    """Steps by Adagrad down the logistic loss of all chunks, both labels of one weight; a window that wins the pooling carries the gradient.

    A word's vector is the sum of the embeddings of its hashed features. The embedding's first coordinate starts at the
    confidence-weighted log odds of the bucket, the rest at noise. A step that makes the loss greater is taken back and halved.
    """
    rng = np.random.default_rng(seed)
    sides = counted(some)
    known = np.flatnonzero(sides.sum(axis=0) >= LEAST_DOCUMENTS)
    row = np.zeros(BUCKETS, np.int32)
    row[known] = np.arange(1, len(known) + 1)
    clean, toxic = sides[0][known] + 0.5, sides[1][known] + 0.5
    odds = np.log(toxic / (count[1] + 1)) - np.log(clean / (count[0] + 1))
    sure = odds / np.sqrt(1 / clean + 1 / toxic)
    embedding = rng.normal(0, 0.02, (len(known) + 1, SIZE))
    embedding[1:, 0] = np.sign(sure) * np.clip(np.abs(sure) - SURE, 0, 6) / 3
    embedding[0] = 0
    filters = [rng.normal(0, 0.15, (w, SIZE, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2])
    filters[0][0, 0, 0] = 1.0
    out = np.abs(rng.normal(0, 0.2, FILTERS * len(WIDTHS)))
    out[0] = 1.5
    rows = sum(count)
    weight = (0.5 / count[0], 0.5 / count[1])

    def model_of(dense: np.ndarray, embedding: np.ndarray) -> Model:
        ends = np.cumsum([f.size for f in filters] + [FILTERS] * len(WIDTHS) + [len(out)])
        parts = np.split(dense, ends)
        shapes = [x.reshape(f.shape) for x, f in zip(parts, filters, strict=False)]
        return Model(row, embedding.astype(np.float32), shapes, parts[len(filters) : -2], parts[-2], float(parts[-1][0]))

    dense = np.concatenate([*(f.ravel() for f in filters), np.full(FILTERS * len(WIDTHS), -0.5), out, [-1.0]])
    decay = np.concatenate([np.full(sum(f.size for f in filters), 1e-5), np.zeros(FILTERS * len(WIDTHS)), np.full(len(out), 1e-4), [0]])
    squares = [np.full(dense.shape, 0.1), np.full(embedding.shape, 0.1)]
    best, least, rate = None, np.inf, RATE
    for _ in range(STEPS):
        features, sums = gradients(some, model_of(dense, embedding), weight)
        loss = sums[-1] + (decay * dense * dense).sum() / 2
        if loss <= least:
            steps = [sums[:-1] * rows + decay * rows * dense, features * rows]
            for s, g in zip(squares, steps, strict=True):
                s += g * g
            best, least = (dense, embedding), loss
        else:
            rate /= 2
        dense, embedding = best[0] - rate * steps[0] / np.sqrt(squares[0]), best[1] - 0.3 * rate * steps[1] / np.sqrt(squares[1])
    return model_of(*best)


def best_cut(cell: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> float:
    """The middle of the widest gap among those whose F1 is near the best; cells with their toxic rows and all rows."""
    order = np.argsort(-cell)
    z, hits, all_ = cell[order] / CELLS, np.cumsum(toxic[order]), np.cumsum(rows[order])
    f1 = 2 * hits / (all_ + toxic.sum())
    gap = np.append(z[:-1] - z[1:], 1e-6)
    gap[f1 < NEAR_BEST * f1.max()] = -1
    top = int(gap.argmax())
    return float(z[top] - gap[top] / 2)


def calibrate(some: DataFrame, model: Model) -> Model:
    """A threshold with near the best F1 of all chunks becomes score 0.5.

    Languages with enough rows of both kinds get a threshold of their own, never an input of the score.
    """

    shipped = some.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for chunk in Chunk.of(batches):
            cell = np.rint(np.clip(chunk.forward(model)[0], -60, 60) * CELLS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(chunk.lang, pa.string()), pa.array(cell), pa.array(chunk.label.astype(np.int64))], ["name", "cell", "toxic"])
        release()

    def cut(cells: pa.Table) -> pa.Table:
        found = best_cut(*(cells[c].to_numpy() for c in ("cell", "toxic", "rows")))
        return pa.table({"name": cells["name"][:1], "cut": pa.array([found])})

    cells = keep(some.mapInArrow(run, "name string, cell long, toxic long").groupBy("name", "cell").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("rows")))
    shipped.destroy()
    enough = cells.where("name <> ''").groupBy("name").agg(F.sum("toxic").alias("t"), F.sum("rows").alias("r")).where("t >= 30 and r - t >= 30").select("name")
    every = cells.groupBy(F.lit("").alias("name"), "cell").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"))
    names = cells.join(enough, "name").select("name", "cell", "toxic", "rows")
    cuts = {r["name"]: r["cut"] for r in every.unionByName(names).groupBy("name").applyInArrow(cut, "name string, cut double").collect()}
    model.shift -= cuts[""]
    model.thresholds = {name: float(1 / (1 + np.exp(-np.clip(c - cuts[""], -30, 30)))) for name, c in sorted(cuts.items())}
    return model


def fold(ident: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows of 0 are held out. A null id counts as the empty text (held out)."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Model | None:
    """Learn from every labelled row that is not held out, whole texts: counts, gradients and thresholds are of all of them.

    Ids labelled twice count as toxic if any label says so; null labels and ids, and labels of no document, are left out; of
    copies of a row one counts, of rows that share an id each. Without labels of both kinds there is no model. How rows are
    spread over tasks does not matter.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = keep(known.where((fold(F.col("id")) != 0) & F.col("label").isin(0, 1)))
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), lang.alias("lang"))
    rows = texts.join(F.broadcast(known) if measured(known) else known, "id")
    rows = rows.groupBy("id", "text").agg(F.max("label").alias("label"), F.min("lang").alias("lang"))
    some = keep(rows.select("text", "label", "lang").mapInArrow(chunks, CHUNK))
    size = F.octet_length("ids") + F.octet_length("word") + F.octet_length("bucket")
    *count, size = some.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("clean"), F.col("toxic"), size))).first()
    some = some.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PASS_BYTES)))
    return calibrate(some, fit(some, count)) if all(count) else None


def judge(model: Model | None, texts: list, languages: list) -> tuple[np.ndarray, np.ndarray]:
    """The score of each text, and whether it is above the threshold of its language."""
    found = model.scores(texts) if model else np.zeros(len(texts))
    cuts = np.array([(model.thresholds.get(x or "", 0.5) if model else 1.0) for x in languages])
    return found, found >= cuts


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, score, predicted, toxic) for each row of docs, whole texts.

    predicted is 1 from score 0.5; toxic holds the score against the threshold of the row's language, which is no input of the
    score. Null and empty texts score like a text of unknown words; without a model all score 0. Null ids, null languages and
    repeated rows stay; an empty table gives an empty result; other columns are not read. No shuffle.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found, toxic = judge(model, texts, batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32)), pa.array(toxic)], ["doc_id", "held_out", "score", "predicted", "toxic"])
            del texts, found
            release()

    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"), F.col(text_col).alias("text"), lang.alias("lang"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those above the threshold of their language, all columns untouched.

    Each row goes or stays by its own text and language, so null ids and ids of several rows are no special case. No shuffle.
    """
    model = train(docs, labels, id_col, text_col, lang_col)
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")

    @F.arrow_udf(BooleanType())
    def toxic(texts: pa.Array, languages: pa.Array) -> pa.Array:
        out = pa.array(judge(model, texts.to_pylist(), languages.to_pylist())[1])
        release()
        return out

    return docs.where(~toxic(F.col(text_col), lang))
