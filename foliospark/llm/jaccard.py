"""Exact n-gram Jaccard self-join by a pigeonhole over a partitioned universe.

A text's set holds the hashes of its distinct word shingles. Sets whose Jaccard
similarity reaches p/q differ in at most H = (|r| + |s|)(q - p)/(q + p) shingles.
Within a size band the hash space is cut into m segments. A set indexes the content of
its segments (its subsets of the universe's segments), and for the first d of them also
every content with one shingle deleted. Where the contents of a segment differ, that
takes one of the H differences, and two if they differ by more than a deletion. So a set
need not index all segments: the d and then as many of the others as bring the
sum to H + 1 are enough, and segments that are empty in it, which would meet half the
band, are passed over. The set whose choice ends first has only segments that its
partner has chosen too, so similar sets always meet. A set with too few segments that
aren't empty indexes them all.

``measured`` picks m and d for each band by cost: rows written against pairs met by chance,
both counted on a sample of at most ``SAMPLE_SETS`` distinct sets and ``SAMPLE_SHINGLES``
shingles and carried on to all sets. Any choice gives the same links.

Equal sets are one node from the start, so exact copies never meet each other. A node's
number is a 64-bit hash; sets are equal only if a second 64-bit hash is equal too, and a
number that two different sets share is changed for all but one of them. Keys met
by one node only are dropped by an aggregate that carries two numbers a key. What is
left is joined in three rounds of candidates: every node with its key's least node,
then the nearest pairs of different components within a key, then all such pairs, in
blocks. A key's pairs with its least node are settled by the first round, and a key without
close pairs in the second has none in the third, so neither is dealt again.
The nodes of a key's most frequent component are never dealt against each other.
A pair passes only if a parity sketch allows it (its Hamming distance never
exceeds the sets' difference) and is then verified on the whole sets, one row a node;
these are written a round, for the nodes in its pairs.
No link between components is lost, and pairs inside a component are not needed.

Sets are compared by 64-bit hashes of their shingles.

Defined cases: null text counts as empty; a text without words has an empty set and no
links; one with fewer words than a shingle has its whole sequence as one shingle;
repeated rows are copies; a null id is kept, never the smallest of a component unless
all its ids are null; an empty table gives an empty result; other columns are not read.
``keep_one`` judges rows, not ids: rows are told apart by id and text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.components import merge_components
from foliospark.llm.scratch import Scratch, small_batches
from foliospark.llm.textops import U64, mix64, pieces, shingle_sets, string_bytes, words

NO_ID = (1 << 63) - 1  # stands for a null id, so that it is the largest
BLOCK = 1024  # nodes of a key that one task compares at a time
PAIR_COST = 0.01  # a pair met by chance against a row written
FILTER_BITS = 1 << 23
SEEN = 100_000
WIDE = 1 << 14  # bins up to which a sketch is wide, so that few shingles share a bin
SAMPLE_SETS, SAMPLE_SHINGLES = 1_500, 1_000_000  # that allocation is measured on


def difference(total: int, p: int, q: int) -> int:
    """Most shingles in which linked sets of this total size can differ."""
    return total * (q - p) // (q + p)


def _couples(of: np.ndarray) -> float:
    """Pairs of entries with equal values."""
    _, met = np.unique(of, return_counts=True)
    return float((met * (met - 1) / 2).sum())


class Bands:
    """Size bands, each with its segments m and deletion segments d."""

    def __init__(self, p: int, q: int) -> None:
        self.p, self.q = p, q
        edge = [1]
        while edge[-1] < 1 << 31:
            edge.append(edge[-1] * 7 // 4 + 1)
        self.edge = np.array(edge)
        self.of = [self.choices(k)[0] for k in range(len(edge) - 1)]

    def choices(self, band: int) -> list[tuple[int, int]]:
        """(m, d) to choose from: no deletion segments, or as many as an eighth, a quarter or half of the differences."""
        need = difference(2 * (int(self.edge[band + 1]) - 1), self.p, self.q) + 1
        if need == 1:
            return [(0, 0)]  # only equal sets are linked, and those are one node
        # A few segments more, as some are empty.
        return [(math.ceil(1.08 * (need - d)) + 1, d) for d in sorted({0, need // 8, need // 4, need // 2})]

    def measure(self, sample: list[np.ndarray], sets: int) -> Bands:
        """Choose by what the sample's sets write, and meet of other components, carried on to so many sets."""
        grown = max(1.0, sets / max(1, len(sample)))
        members: dict[int, list[tuple[np.ndarray, int]]] = {}
        for one in sample:
            for band, most in self.bands(len(one)):
                members.setdefault(band, []).append((one, most))
        for band, own in members.items():
            sets = [one for one, _ in own]
            labels = np.arange(len(own))
            costs = []
            for m, d in self.choices(band):
                keys = [self.keys_in(one, band, most, m, d) for one, most in own]
                owner = np.repeat(np.arange(len(own)), [len(k) for k in keys])
                _, key = np.unique(np.concatenate(keys), return_inverse=True)
                if not costs:
                    labels = self.joined(sets, key, owner)
                pairs = _couples(key) - _couples(key * len(own) + labels[owner])
                costs.append((len(owner) * grown + PAIR_COST * pairs * grown**2, m, d))
            self.of[band] = min(costs)[1:]
        return self

    def joined(self, sets: list[np.ndarray], key: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Labels of sets after linking each with the first set that has one of its keys, as the first round does."""
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        hub = np.repeat(owner[first], np.diff(np.append(first, len(key))))
        label = np.arange(len(sets))
        for i, j in {(int(i), int(j)) for i, j in zip(hub, owner, strict=True) if i != j}:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if self.q * both >= self.p * (len(sets[i]) + len(sets[j]) - both):
                label[label == label[j]] = label[i]
        return label

    def bands(self, n: int) -> list[tuple[int, int]]:
        """The set's own band, and the next if a linked set can lie there; with the most differences there."""
        own = int(np.searchsorted(self.edge, n, side="right")) - 1
        above, largest = int(self.edge[own + 1]), n * self.q // self.p
        found = [(own, difference(n + min(largest, above - 1), self.p, self.q))]
        return [*found, (own + 1, difference(n + largest, self.p, self.q))] if largest >= above else found

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Index keys of a sorted set of shingle hashes."""
        if not len(s):
            return s
        parts = [self.keys_in(s, band, most, *self.of[band]) for band, most in self.bands(len(s))]
        return np.concatenate(parts)

    def keys_in(self, s: np.ndarray, band: int, most: int, m: int, d: int) -> np.ndarray:
        if not m:
            return np.zeros(0, U64)
        element = mix64(s + U64(0x2545F4914F6CDD1D))
        sums = np.zeros(len(s) + 1, U64)
        np.cumsum(element, out=sums[1:])
        # Segments are equal slices of the hash space, so each is a run of the sorted set.
        segment = ((s >> U64(32)) * U64(m)) >> U64(32)
        at = np.searchsorted(segment, np.arange(m + 1, dtype=U64))
        salt = mix64(np.arange(m, dtype=U64) + U64(band << 32))
        content = sums[at[1:]] - sums[at[:-1]]
        full = np.flatnonzero(at[d + 1 :] > at[d:-1]) + d
        wanted = most + 1 - 2 * d
        chosen = full[: max(0, wanted)] if len(full) >= wanted else np.arange(d, m)
        chosen = np.concatenate([np.arange(d), chosen])
        found = mix64(content[chosen] + salt[chosen])
        if not d:
            return found
        stop = at[d]
        which = segment[:stop].astype(np.int64)
        return np.concatenate([found, mix64(content[which] - element[:stop] + salt[which])])


def sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles in each of a power of two of bins: four to eight for each shingle, in very large sets down to one."""
    bits = 64
    while bits < max(min(4 * len(s), WIDE), len(s)):
        bits *= 2
    counts = np.bincount((mix64(s ^ U64(0x9E6C63D0876A9A47)) & U64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    if not len(s):
        return 0, 0
    return int(mix64(s).sum(dtype=U64)), int(mix64(s * U64(0x9E3779B97F4A7C15) + U64(0xD1B54A32D192ED03)).sum(dtype=U64))


def _as_longs(values: list[int]) -> pa.Array:
    return _longs(np.array(values, dtype=U64))


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


Renamed = dict[tuple[int, int], int]  # both hashes of a set whose first another set has too, to its number


def node_rows(docs: DataFrame, width: int) -> DataFrame:
    """id, h, n, node, check, sketch of each row of docs (id, text, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            found = list(shingle_sets(words(*string_bytes(part.column(1))), width))
            hashes = [set_hash(s) for s in found]
            yield pa.record_batch(
                {
                    "id": part.column(0),
                    "h": part.column(2),
                    "n": pa.array([len(s) for s in found], pa.int64()),
                    "node": _as_longs([x for x, _ in hashes]),
                    "check": _as_longs([x for _, x in hashes]),
                    "sketch": pa.array([sketch(s) for s in found], pa.binary()),
                }
            )

    return docs.mapInArrow(run, "id long, h long, n long, node long, check long, sketch binary")


def key_rows(docs: DataFrame, width: int, bands: Bands, renamed: Renamed) -> DataFrame:
    """key, node: the index rows, those of equal sets once a task (as far as ``SEEN`` nodes back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in pieces(batches, 1):
            ids, keys = [], []
            for s in shingle_sets(words(*string_bytes(part.column(1))), width):
                both = set_hash(s)
                node = renamed.get(both, both[0])
                if node in seen or not len(s):
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                ids.append(node)
                keys.append(bands.keys(s))
            if keys:
                node = np.repeat(np.array(ids, U64), [len(k) for k in keys])
                yield pa.record_batch({"key": _longs(np.concatenate(keys)), "node": _longs(node)})

    return docs.select("id", "text").mapInArrow(run, "key long, node long")


def row_filter(rows: DataFrame) -> np.ndarray:
    """One-hash filter of fixed size over rows (id, h); it may pass others too."""
    filled = rows.groupBy(F.shiftright(_bit(), 5).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id, h), {FILTER_BITS}) % 32 as int))")).alias("bits")
    )
    table = filled.toArrow()  # at most FILTER_BITS / 32 rows
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
    return out


def _bit() -> Column:
    return F.pmod(F.xxhash64("id", "h"), F.lit(FILTER_BITS))


def set_rows(docs: DataFrame, width: int, wanted: DataFrame, renamed: Renamed) -> DataFrame:
    """node and whole set (8 bytes a shingle): one row for each of ``wanted`` (node, id, h: one of its rows).

    Documents pass a filter over (id, h) first, so that few others are read; a task gives a node
    once (as far as ``SEEN`` nodes back), and what is not wanted or comes again goes before the sets are used.
    """
    bits = docs.sparkSession.sparkContext.broadcast(row_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            place = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits.value[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1))
            for part in pieces(iter([batch]), 1):
                ids, wholes = [], []
                for s in shingle_sets(words(*string_bytes(part.column(1))), width):
                    both = set_hash(s)
                    node = renamed.get(both, both[0])
                    if node in seen or not len(s):
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    ids.append(node)
                    wholes.append(s.tobytes())
                if ids:
                    yield pa.record_batch({"node": _as_longs(ids), "whole": pa.array(wholes, pa.binary())})

    found = docs.select("id", "text", _bit().alias("bit")).mapInArrow(run, "node long, whole binary")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def verify(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 2):
            keep = []
            for x, y in zip(part.column(2), part.column(3), strict=True):
                r, s = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.sort(np.concatenate([r, s]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(q * common >= p * (len(both) - common))
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # Only sets that occur in pairs are dealt out.
    left = sets.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi").toDF("a", "whole_a")
    right = sets.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi").toDF("b", "whole_b")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "whole_a", "whole_b")
    return joined.mapInArrow(run, "a long, b long").distinct()


def linked_pairs(
    pairs: DataFrame, rows: DataFrame, width: int, known: DataFrame, renamed: Renamed, p: int, q: int, scratch: Scratch
) -> DataFrame:
    """``verify`` with the whole sets of the nodes in pairs, which are on disk meanwhile; known: node, low (id, h)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = scratch.put(known.select("node", "low.id", "low.h").join(ends, "node", "left_semi"))
    sets = scratch.put(set_rows(rows, width, wanted, renamed))
    found = scratch.put(verify(pairs, sets, p, q))
    scratch.drop(sets)
    return found


def sifted(pairs: DataFrame, known: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow. known: node, n, sketch."""
    sized = pairs.join(known.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    sized = sized.join(known.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    sized = sized.filter(F.least("na", "nb") * q >= F.greatest("na", "nb") * p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            gaps = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                r, s = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                while len(r) != len(s):
                    long = r if len(r) > len(s) else s
                    long = long[: len(long) // 2] ^ long[len(long) // 2 :]
                    r, s = (long, s) if len(r) > len(s) else (r, long)
                gaps[i] = np.bitwise_count(r ^ s).sum()
            yield batch.select([0, 1]).filter(pa.array(gaps * (q + p) <= total * (q - p)))

    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _folded(matrix: np.ndarray) -> np.ndarray:
    """Sketches of half the bins."""
    half = matrix.shape[1] // 2
    return matrix[:, :half] ^ matrix[:, half:]


def close_pairs(
    sizes: np.ndarray, sketches: list[bytes], label: np.ndarray, side: np.ndarray, p: int, q: int, nearest: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of different labels, not both on side 2 or both on side 1 if both sides occur, that sizes and
    sketches allow; ``nearest``: each label's closest only."""
    left, right, far = [], [], []
    widths = np.array([len(x) for x in sketches])
    crossed = side.min() != side.max()
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        bits = np.frombuffer(b"".join(sketches[i] for i in own), np.uint64).reshape(len(own), -1)
        others, against = [own], [bits]
        double = np.flatnonzero(widths == 2 * w)
        if len(double):
            wide = np.frombuffer(b"".join(sketches[i] for i in double), np.uint64).reshape(len(double), -1)
            others.append(double)
            against.append(_folded(wide))
        to, table = np.concatenate(others), np.concatenate(against)
        step = max(1, (1 << 20) // max(1, table.size))
        for a in range(0, len(own), step):
            mine = own[a : a + step]
            total = sizes[mine][:, None] + sizes[to][None, :]
            ok = label[mine][:, None] != label[to][None, :]
            ok &= (mine[:, None] < to[None, :]) | (widths[to][None, :] != w)
            ok &= q * np.minimum(sizes[mine][:, None], sizes[to][None, :]) >= p * np.maximum(
                sizes[mine][:, None], sizes[to][None, :]
            )
            if crossed:
                ok &= side[mine][:, None] != side[to][None, :]
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            gap = np.bitwise_count(bits[a + i] ^ table[j]).sum(axis=1, dtype=np.int64)
            fits = gap * (q + p) <= total[i, j] * (q - p)
            left.append(mine[i[fits]])
            right.append(to[j[fits]])
            far.append(gap[fits])
    if not left:
        none = np.zeros(0, np.int64)
        return none, none
    i, j, gap = np.concatenate(left), np.concatenate(right), np.concatenate(far)
    if nearest and len(i):
        order = np.argsort(gap, kind="stable")
        i, j = i[order], j[order]
        keep = np.zeros(len(i), dtype=bool)
        for ends in (i, j):
            keep[np.unique(label[ends], return_index=True)[1]] = True
        i, j = i[keep], j[keep]
    return i, j


def candidate_pairs(members: DataFrame, known: DataFrame, p: int, q: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of nodes that share a key, differ in label and may be linked, once a block of the key: key, a, b.

    members: key, node, label. known: node, n, sketch. A key's nodes are dealt into
    blocks; each pair of blocks is compared by one task, which streams over its sorted
    rows. The nodes of its most frequent label are blocks of their own, which meet the
    others' blocks only. Sketches join last, for keys with several labels only.
    """
    sized = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"))
    sized = sized.groupBy("key").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("k"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    open_keys = sized.filter("top.k < k").select(
        "key", F.col("top.label").alias("top"), blocks(F.col("k") - F.col("top.k")).alias("few"), blocks(F.col("top.k")).alias("many")
    )
    placed = members.join(open_keys, "key")
    of_top = F.col("label") == F.col("top")
    own = F.when(of_top, F.col("few") + F.pmod(F.xxhash64("node"), F.col("many"))).otherwise(F.pmod(F.xxhash64("node"), F.col("few")))
    last = F.when(of_top, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    placed = placed.select("key", "node", "label", own.cast("int").alias("own"), last.alias("last"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).select(
        "key",
        F.least("own", "other").alias("bi"),
        F.greatest("own", "other").alias("bj"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
        "node",
        "label",
    )
    placed = placed.join(known.select("node", "n", "sketch"), "node")
    placed = placed.select("key", "bi", "bj", "side", "node", "label", "n", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in group.columns]
            node, label, n = (cols[k].to_numpy() for k in (4, 5, 6))
            i, j = close_pairs(n, cols[7].to_pylist(), label, cols[3].to_numpy(), p, q, nearest)
            if len(i):
                a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                key = np.full(len(i), cols[0][0].as_py())
                yield pa.record_batch({"key": pa.array(key, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = placed.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return dealt.mapInArrow(run, "key long, a long, b long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal key, bi, bj; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            this = tuple(ids[:, a])
            if held and this != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = this
    if held:
        yield pa.Table.from_batches(held)


def _sampled(rows: DataFrame, width: int, nodes: DataFrame, renamed: Renamed) -> tuple[list[np.ndarray], int]:
    """A bounded sample of the distinct sets, by hash, and how many sets there are."""
    sets, shingles = nodes.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not sets:
        return [], 0
    share = min(1.0, SAMPLE_SETS / sets, SAMPLE_SHINGLES / shingles)
    chosen = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1))
    chosen = chosen.select("node", "low.id", "low.h")
    small_batches(rows.sparkSession)
    rows = rows.join(F.broadcast(chosen.select("id", "h")), ["id", "h"], "left_semi")  # few texts reach Python
    found = set_rows(rows, width, chosen, renamed).select("whole").toArrow()
    return [np.frombuffer(x.as_buffer(), U64) for x in found.column(0)], sets


def _distinct_sets(base: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, Renamed]:
    """base with final numbers; node, low (id, h), n, sketch of each distinct set; the numbers that were changed."""
    filled = base.filter("n > 0")
    made = [F.min(F.struct("id", "h")).alias("low"), F.first("n").alias("n"), F.first("sketch").alias("sketch")]
    nodes = scratch.put(filled.groupBy("node").agg(*made, F.min("check").alias("c"), F.max("check").alias("d")))
    # Among n sets about n^2 / 2^65 share a number: three among 10^10, a few hundred among 10^11.
    shared = nodes.filter("c <> d").select("node", "c")
    if shared.isEmpty():
        return base, nodes.drop("c", "d"), {}
    others = filled.join(shared, "node").filter("check <> c").select("node", "check").distinct().collect()
    mask = (1 << 64) - 1
    first, second = (np.array([x[c] & mask for x in others], U64) for c in ("node", "check"))
    new = mix64(first ^ mix64(second)).tolist()
    renamed = {(x["node"] & mask, x["check"] & mask): v for x, v in zip(others, new, strict=True)}
    table = base.sparkSession.createDataFrame(
        [(x["node"], x["check"], _signed(v)) for x, v in zip(others, new, strict=True)], "node long, check long, new long"
    )
    base = scratch.put(base.join(table, ["node", "check"], "left").withColumn("node", F.coalesce("new", "node")).select(base.columns))
    return base, scratch.put(base.filter("n > 0").groupBy("node").agg(*made)), renamed


def solve(docs: DataFrame, width: int, p: int, q: int, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (id, h: hash of the text, n, node) and the distinct sets (node, low: least id and h, root: of its component)."""
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text")
    ).withColumn("h", F.xxhash64("text"))
    base, nodes, renamed = _distinct_sets(scratch.put(node_rows(rows, width)), scratch)
    bands = Bands(p, q).measure(*_sampled(rows, width, nodes, renamed))
    # One exchange serves both the count of a key's nodes and the join with the keys that have several.
    keyed = key_rows(rows, width, bands, renamed).repartition("key")
    met = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("far")).filter("hub <> far")
    members = scratch.put(keyed.join(met.select("key", "hub").hint("shuffle_hash"), "key").distinct())
    known = scratch.put(nodes.join(members.select("node").distinct(), "node"))
    star = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    tried = scratch.put(sifted(star, known, p, q))
    labels = known.select("node", F.col("node").alias("label"))
    labels = merge_components(labels, linked_pairs(tried, rows, width, known, renamed, p, q, scratch), scratch)
    # The first round has settled all pairs with a key's hub.
    rest = members.filter("node <> hub").select("key", "node")
    for nearest in (True, False):
        close = scratch.put(candidate_pairs(rest.join(labels, "node"), known, p, q, nearest))
        pairs = scratch.put(close.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
        labels = merge_components(labels, linked_pairs(pairs, rows, width, known, renamed, p, q, scratch), scratch)
        tried = tried.union(pairs)
        # The nearest pairs are some of all: a key that has none has no other.
        rest = rest.join(close.select("key").distinct(), "key", "left_semi")
    found = scratch.put(nodes.join(labels, "node", "left").select("node", "low", F.coalesce("label", "node").alias("root")))
    scratch.keep(base, found)
    return base.select("id", "h", "n", "node"), found


def jaccard_components(
    docs: DataFrame, width: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_shingles, component_id of each row: links are similarities of p/q or more."""
    base, nodes = solve(docs, width, p, q, id_col, text_col, Scratch(docs.sparkSession, "jaccard"))
    least = nodes.groupBy("root").agg(F.min("low.id").alias("least"))
    out = base.join(nodes.join(least, "root").select("node", "least"), "node", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least"))
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(component != NO_ID, component).alias("component_id"),
    )


def keep_one(
    docs: DataFrame, width: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of docs, whole, without all but one of each component: the row of the least id, a null id the largest.

    Rows with the same id and different texts are different rows; of rows with the same id and text one
    stays. Texts without words are in no component and all stay.
    """
    scratch = Scratch(docs.sparkSession, "near")
    base, nodes = solve(docs, width, p, q, id_col, text_col, scratch)
    first = nodes.groupBy("root").agg(F.min("low").alias("first"))
    judged = base.filter("n > 0").join(nodes.join(first, "root").select("node", "first"), "node")
    # Rows and their copies by (id, h) are counted before anything is shuffled by it.
    counted = judged.groupBy("id", "h", (F.struct("id", "h") == F.col("first")).alias("stays")).agg(F.count(F.lit(1)).alias("k"))
    changed = scratch.put(counted.filter("NOT stays OR k > 1"))
    own = [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *own)
    kept = packed.join(changed.select("id", "h"), ["id", "h"], "left_anti")
    again = changed.filter("stays")
    if not again.isEmpty():
        kept = kept.unionByName(packed.join(again.select("id", "h"), ["id", "h"], "left_semi").dropDuplicates(["id", "h"]))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
