"""Quality classifier: a generalised additive model with pairwise interactions.

Whole texts become about twenty numbers (vectorised over bytes and words). Boosting goes
round the features in a fixed cycle; each step fits one shallow tree of a single feature
to the current residuals on its quantile bins and adds a small part of it to that
feature's lookup table. When the main effects have settled, the same is done for the
pairs whose coarse grid explains most of what is left. A score is then a sum of table
entries, one gather a feature for a whole batch.

The fit reads at most ``max_rows`` labelled rows, chosen by hash of the id, the same
number of every class where there are so many; everything is scored.

Defined cases: null text counts as empty, and an empty text has a score like any other;
without labelled rows of both classes every score is the share of good labels (1/2
without labels); repeated rows get equal scores; of texts under one id the least is learned
from, of an id labelled both ways both labels are; a null id is scored, never learned from and
not held out; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.scratch import small_batches
from foliospark.llm.textops import IS_SPACE, U64, pieces, string_bytes, words

FEATURES = [
    "bytes",  # log size
    "words",  # log number of words
    "word_length",  # mean
    "word_spread",  # share of words longer than 12 bytes
    "upper",  # shares of bytes
    "digit",
    "mark",
    "rare_mark",
    "high",
    "line_breaks",
    "capitals",  # shares of words: upper first letter, upper throughout, ending in a mark, repeated
    "shouted",
    "marked",
    "doubled",
    "distinct",  # distinct words over expected for so many words
    "top_word",  # share of the most frequent word
    "neighbour",  # words equal to the one before
    "pairs",  # distinct word pairs over pairs
    "runs",  # bytes equal to the one before
    "stops",  # sentence ends a word
]

_CLASS = np.zeros((256, 6), dtype=np.float32)
_CLASS[65:91, 0] = 1
_CLASS[48:58, 1] = 1
for _b in range(33, 127):
    if not chr(_b).isalnum():
        _CLASS[_b, 2] = 1
        if chr(_b) not in ".,;:'\"!?()-":
            _CLASS[_b, 3] = 1
_CLASS[128:, 4] = 1
_CLASS[10, 5] = 1
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_LOWER[128:] = True  # letters beyond ASCII are mostly lower case
_MARK = np.zeros(256, dtype=bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:"]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 63]] = True


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between consecutive bounds, empty ranges included."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    raw, offsets = string_bytes(column)
    found = words(raw, offsets)
    bound, n_words, n_bytes = found.bound, np.diff(found.bound), np.diff(offsets)
    per_byte, per_word = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    out = np.zeros((len(n_bytes), len(FEATURES)))
    out[:, 0] = np.log1p(n_bytes)
    out[:, 1] = np.log1p(n_words)
    length = found.end - found.start
    out[:, 2] = _sums(length, bound) / per_word
    out[:, 3] = _sums(length > 12, bound) / per_word
    for k in range(6):
        out[:, 4 + k] = _sums(_CLASS[:, k].astype(bool)[raw], offsets) / per_byte
    if len(length):
        upper = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(_UPPER[raw], out=upper[1:])
        lower = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(_LOWER[raw], out=lower[1:])
        ups = upper[found.end] - upper[found.start]
        lows = lower[found.end] - lower[found.start]
        out[:, 10] = _sums(_UPPER[raw[found.start]], bound) / per_word
        out[:, 11] = _sums((ups >= 2) & (lows == 0), bound) / per_word
        last = raw[found.end - 1]
        out[:, 12] = _sums(_MARK[last], bound) / per_word
        before = raw[np.maximum(found.end - 2, found.start)]
        out[:, 13] = _sums(_MARK[last] & (last == before) & (length > 1), bound) / per_word
        same = np.zeros(len(length), dtype=bool)
        same[1:] = found.hash[1:] == found.hash[:-1]
        same[bound[:-1][n_words > 0]] = False
        out[:, 16] = _sums(same, bound) / per_word
        out[:, 19] = _sums(_STOP[last], bound) / per_word
    run = np.zeros(len(raw), dtype=bool)
    run[1:] = (raw[1:] == raw[:-1]) & ~IS_SPACE[raw[1:]]
    out[:, 18] = _sums(run, offsets) / per_byte
    for i in range(len(n_words)):
        n = n_words[i]
        if n:
            h = found.hash[bound[i] : bound[i + 1]]
            ordered = np.sort(h)
            cut = np.flatnonzero(ordered[1:] != ordered[:-1])
            edges = np.concatenate(([-1], cut, [n - 1]))
            out[i, 14] = (len(cut) + 1) / n**0.8
            out[i, 15] = np.diff(edges).max() / n
            if n > 1:
                pair = np.sort((h[:-1] * U64(0x9E3779B97F4A7C15)) ^ (h[1:] >> U64(1)))
                out[i, 17] = (np.count_nonzero(pair[1:] != pair[:-1]) + 1) / (n - 1)
    return out


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)  # inner bin edges of each feature
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edge, x[:, k], side="right")]
        for i, j, ei, ej, table in self.pairs:
            total += table[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, damp: float) -> np.ndarray:
    """Best-first tree over ordered bins: the Newton step of each bin's leaf."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    parts = [(0, len(g))]

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        at = np.arange(a + 1, b)
        lg, lh, rg, rh = cg[at] - cg[a], ch[at] - ch[a], cg[b] - cg[at], ch[b] - ch[at]
        gain = lg**2 / (lh + damp) + rg**2 / (rh + damp) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + damp)
        k = int(np.argmax(gain))
        return float(gain[k]), int(at[k])

    while len(parts) < leaves:
        gain, at, (a, b) = max((*best(a, b), (a, b)) for a, b in parts)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + damp)
    return out


def fit(
    x: np.ndarray,
    y: np.ndarray,
    weight: np.ndarray | None = None,
    bins: int = 48,
    rounds: int = 120,
    rate: float = 0.08,
    n_pairs: int = 6,
    pair_bins: int = 8,
    pair_rounds: int = 40,
    damp: float = 3.0,
) -> Model:
    w = np.ones(len(y)) if weight is None else weight
    good = float((w * y).sum() / w.sum()) if len(y) else 0.5
    model = Model(float(np.log(max(good, 1e-3) / max(1 - good, 1e-3))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [_edges(x[:, k], bins) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return w * (y - p), w * np.maximum(p * (1 - p), 1e-4)

    for _ in range(rounds):
        for k, place in enumerate(binned):
            g, h = residuals()
            size = len(model.tables[k])
            step = rate * _tree(np.bincount(place, g, size), np.bincount(place, h, size), 3, damp)
            model.tables[k] += step
            total += step[place]
    coarse = [_edges(x[:, k], pair_bins) for k in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]
    g, h = residuals()
    ranked = []
    for i in range(x.shape[1]):
        for j in range(i):
            size = (len(coarse[j]) + 1) * (len(coarse[i]) + 1)
            at = cells[j] * (len(coarse[i]) + 1) + cells[i]
            gain = (np.bincount(at, g, size) ** 2 / (np.bincount(at, h, size) + damp)).sum()
            ranked.append((float(gain), j, i))
    for _, i, j in sorted(ranked, reverse=True)[:n_pairs]:
        model.pairs.append((i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))))
    for _ in range(pair_rounds):
        for i, j, ei, ej, table in model.pairs:
            g, h = residuals()
            size = table.size
            at = cells[i] * (len(ej) + 1) + cells[j]
            gg, hh = (np.bincount(at, v, size).reshape(table.shape) for v in (g, h))
            # A shallow tree of two features: a cut on one, then a tree on the other on each side.
            first = _tree(gg.sum(1), hh.sum(1), 2, damp)
            cut = int(np.argmax(np.abs(np.diff(first)))) + 1 if len(first) > 1 else 1
            step = np.empty_like(table)
            for rows in (slice(0, cut), slice(cut, None)):
                step[rows] = _tree(gg[rows].sum(0), hh[rows].sum(0), 2, damp)
            table += rate * step
            total += rate * step.ravel()[at]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: a third, by checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_labelled(
    docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, seed: int = 7, label_col: str = "quality"
) -> Model:
    """Fit on at most ``max_rows`` labelled rows outside the held-out third, half of them of each class."""
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    order = [F.xxhash64(F.lit(seed), "doc_id"), "doc_id"]
    half = max_rows // 2
    sample = chosen.filter("label = 0").orderBy(*order).limit(half)
    sample = sample.unionByName(chosen.filter("label = 1").orderBy(*order).limit(max_rows - half)).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # One text an id, however many rows it has: what reaches the driver is bounded by the sample.
    joined = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    joined = joined.select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            x = pa.FixedSizeListArray.from_arrays(pa.array(features(part.column(1)).ravel()), len(FEATURES))
            yield pa.record_batch({"label": part.column(0), "x": x.cast(pa.list_(pa.float64()))})

    rows = joined.mapInArrow(run, "label int, x array<double>").toArrow()  # at most max_rows
    y = rows.column("label").to_numpy().astype(float)
    x = np.array(rows.column("x").to_pylist()).reshape(len(y), len(FEATURES))
    order_of = np.lexsort((*x.T, y))  # the same model whatever the order of rows
    x, y = x[order_of], y[order_of]
    return fit(x, y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            score = pa.array(shared.value.score(features(part.column(1))))
            yield pa.record_batch({"doc_id": part.column(0), "score": score})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, whole, that score ``least`` or more: one pass, no join."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, at):
            yield part.filter(pa.array(shared.value.score(features(part.column(at))) >= least))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may hold dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
