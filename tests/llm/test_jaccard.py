"""The join against brute force over planted near copies, and its edge cases."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from foliospark.llm import jaccard
from foliospark.llm.jaccard import NO_ID, Bands, close_pairs, difference, jaccard_components, sketch
from foliospark.llm.textops import U64, mix64

import numpy as np

SCHEMA = "doc_id long, text string, keys string, node long"


def brute(rows, width, p, q):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and q * common >= p * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        k = find(i)
        low[k] = min(low.get(k, NO_ID), NO_ID if doc is None else doc)
    return sorted(((NO_ID if d is None else d), len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def planted(seed, groups=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, doc = [], 0
    passage = [r.choice(vocabulary) for _ in range(14)]
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 9, 12, 14, 20, 33, 60, 150, 400]))]
        if r.random() < 0.3:
            base = passage + base
        rows.append((doc, " ".join(base)))
        doc += 1
        for _ in range(r.randint(0, 6)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((doc, "\n ".join(w).title() if r.random() < 0.3 else " ".join(w)))
            doc += 1
    return rows


def result(spark, rows, width, p, q):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    out = jaccard_components(df, width, p, q).collect()
    big = lambda v: NO_ID if v is None else v
    return sorted((big(x["doc_id"]), x["n_shingles"], big(x["component_id"])) for x in out)


@pytest.mark.parametrize("width,p,q", [(3, 90, 100), (5, 80, 100)])
def test_equals_brute_force(spark, width, p, q):
    rows = planted(width)
    rows += [(9001, None), (9002, ""), (9003, " \t\n"), (None, "lonely text of no id here"), (None, rows[0][1])]
    rows += rows[:5] + [(9004, "Word"), (9005, "word"), (9006, "a b"), (9007, "A  b")]
    assert result(spark, rows, width, p, q) == brute(rows, width, p, q)


def test_join_with_deletion_neighbourhoods(spark, monkeypatch):
    """With half of the differences in deletion segments, whatever they cost."""

    def most(self, sample, sets):
        self.of = [self.choices(k)[-1] for k in range(len(self.of))]
        return self

    monkeypatch.setattr(Bands, "measure", most)
    assert all(d for _, d in Bands(90, 100).measure([], 0).of[8:])
    rows = planted(11)
    assert result(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_allocation_follows_the_measured_collisions():
    """Sets out of few shingles meet by chance: among many of them deletion neighbourhoods pay, among few they don't."""
    r = np.random.default_rng(4)
    universe = mix64(np.arange(3000, dtype=U64))
    sample = [np.sort(r.choice(universe, 400, replace=False)) for _ in range(200)]
    at = Bands(80, 100).bands(400)[0][0]
    assert Bands(80, 100).measure(sample, 200).of[at][1] == 0
    assert Bands(80, 100).measure(sample, 10**9).of[at][1] > 0
    apart = [np.sort(mix64(r.integers(0, 2**63, 400).astype(U64))) for _ in range(200)]
    assert Bands(80, 100).measure(apart, 10**9).of[at][1] == 0


def test_equal_numbers_of_different_sets(spark, monkeypatch):
    """Numbers of eight bits: nearly every set shares its own with others."""

    def short(s):
        full = [int(mix64(s).sum(dtype=U64)), int(mix64(s + U64(1)).sum(dtype=U64))] if len(s) else [0, 0]
        return full[0] & 255, full[1]

    monkeypatch.setattr(jaccard, "set_hash", short)
    rows = planted(21, 40)
    assert result(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_one_set_row_a_node(spark, monkeypatch):
    """Copies by the thousand and a filter that passes all: sets are still one row a node."""
    monkeypatch.setattr(jaccard, "FILTER_BITS", 32)
    texts = ["the first text of two that many copies have in common today", "a second one altogether with other words in it"]
    rows = [(i, texts[i % 2]) for i in range(10_000)] + [(None, texts[0])] * 50
    df = spark.createDataFrame(rows, "id long, text string").withColumn("h", F.xxhash64("text")).repartition(5)
    df = df.withColumn("id", F.coalesce("id", F.lit(NO_ID))).persist()
    nodes = jaccard.node_rows(df, 3).groupBy("node").agg(F.min(F.struct("id", "h")).alias("low"))
    sets = jaccard.set_rows(df, 3, nodes.select("node", "low.id", "low.h"), {}).collect()
    assert len(sets) == 2 and len({x["node"] for x in sets}) == 2
    df.unpersist()
    near = rows + [(20_000, texts[0].replace("today", "now")), (20_001, "unlike")]
    assert result(spark, near, 3, 60, 100) == brute_counted(near, 3, 60, 100)


def brute_counted(rows, width, p, q):
    """As ``brute``, over distinct texts."""
    low = {}
    for d, t in rows:
        low[t] = min(low.get(t, NO_ID), NO_ID if d is None else d)
    solved = {d: (n, c) for d, n, c in brute([(d, t) for t, d in low.items()], width, p, q)}
    return sorted(((NO_ID if d is None else d), *solved[low[t]]) for d, t in rows)


def test_keep_one_judges_rows(spark):
    """Null ids, ids that repeat with other texts, rows that repeat whole, and texts without words."""
    r = random.Random(8)
    text = lambda: " ".join(f"w{r.randrange(400)}" for _ in range(40))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (2, a + " more"), (None, a), (None, b), (None, b + " more"), (3, c), (3, a), (3, c), (4, d), (5, None), (5, None), (6, "")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, node int").repartition(3)
    kept = sorted(((x["doc_id"], x["text"]) for x in jaccard.keep_one(df).collect()), key=str)
    # Of the two null ids with b or nearly b, the one whose text has the smaller hash stays.
    least = df.filter("text = '" + b + "' OR text = '" + b + " more'").orderBy(F.xxhash64("text")).first()["text"]
    assert kept == sorted([(1, a), (None, least), (3, c), (4, d), (5, None), (5, None), (6, "")], key=str)
    assert jaccard.keep_one(df.limit(0)).collect() == [] and jaccard.keep_one(df).columns == df.columns


def test_large_near_copy_group(spark):
    """Many variants of one text, linked only through others, over more than one block."""
    r = random.Random(5)
    base = [f"v{r.randrange(500)}" for _ in range(80)]
    rows = []
    for doc in range(1300):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(80)] = f"x{r.randrange(10**6)}"
        rows.append((doc, " ".join(w)))
    assert result(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_settled_pairs_are_not_dealt_again(spark, monkeypatch):
    """A key's pairs with its hub are settled by the first round, keys without close pairs by the second; only sets in pairs are written."""
    dealt, written = [], []
    pairs, sets = jaccard.candidate_pairs, jaccard.set_rows

    def counted_pairs(members, *rest):
        dealt.append(members.count())
        return pairs(members, *rest)

    def counted_sets(docs, width, wanted, renamed):
        written.append(wanted.count())
        return sets(docs, width, wanted, renamed)

    monkeypatch.setattr(jaccard, "candidate_pairs", counted_pairs)
    monkeypatch.setattr(jaccard, "set_rows", counted_sets)
    r = random.Random(12)
    some = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]

    def family(size):  # three quarters in common: keys are shared, links are none
        common = some(60)
        return [common + some(20) for _ in range(size)]

    def judged(texts):
        dealt.clear(), written.clear()
        rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
        assert result(spark, rows, 5, 80, 100) == brute(rows, 5, 80, 100)
        return dealt, written[1:]  # after the sample

    couples = [w for _ in range(20) for w in family(2)]
    assert judged([*couples, couples[0] + ["more"]])[1] == [2, 0, 0]
    (first, second), none = judged(couples)
    assert first > 0 and second == 0 and none == [0, 0, 0]
    assert judged([w for _ in range(20) for w in family(4)])[0][1] == 0
    # Links between nodes that are no hub, whichever of them is one.
    near = [w for _ in range(20) for f in [family(4)] for w in [*f, *(x[:-1] + some(1) for x in f)]]
    assert judged(near)[0][0] > 0


def test_empty_table(spark):
    assert result(spark, [], 3, 90, 100) == []


@pytest.mark.parametrize("p,q", [(90, 100), (80, 100)])
@pytest.mark.parametrize("choice", [0, 1, -1])
def test_linked_sets_share_a_key_at_every_allocation(p, q, choice):
    r = np.random.default_rng(7)
    bands = Bands(p, q)
    bands.of = [bands.choices(k)[min(choice, len(bands.choices(k)) - 1)] for k in range(len(bands.of))]
    for n in [5, 9, 10, 13, 14, 20, 30, 57, 100, 200, 450]:
        for _ in range(20):
            s = np.unique(mix64(r.integers(0, 2**63, n).astype(U64)))
            gone = int(r.integers(0, n))
            while gone and q * (n - gone) < p * n:
                gone -= 1
            drop, kind = r.permutation(n)[:gone], r.random()
            t = np.delete(s, drop)
            if kind < 0.5:  # some replaced, some dropped
                t = np.unique(np.concatenate([t, mix64(r.integers(0, 2**63, gone // 2).astype(U64))]))
            both = len(np.intersect1d(s, t))
            if both and q * both >= p * (len(s) + len(t) - both) and len(np.setxor1d(s, t)):
                assert len(np.setxor1d(s, t)) <= difference(len(s) + len(t), p, q)
                assert np.intersect1d(bands.keys(s), bands.keys(t)).size, (n, gone)


def test_sketches_refuse_most_pairs_a_little_too_far_apart():
    """A fifth more differences than linked sets have: few such pairs are handed on, once a shared key each."""
    rng = np.random.default_rng(8)
    for n in (60, 200, 900):
        most = difference(2 * n, 80, 100)
        swapped = math.ceil(0.6 * most)
        passed = 0
        for _ in range(100):
            all_of = rng.integers(0, 1 << 63, n + swapped).astype(U64)
            found = [sketch(np.sort(x)) for x in (all_of[:n], all_of[swapped:])]
            label = np.arange(2)
            passed += len(close_pairs(np.full(2, n), found, label, np.zeros(2, np.int64), 80, 100, False)[0])
        assert passed <= 25, (n, passed)


def test_sketch_never_refuses_linked_sets():
    r = np.random.default_rng(3)
    for n in [3, 30, 31, 32, 33, 64, 65, 300]:
        s = np.unique(mix64(r.integers(0, 2**63, n).astype(U64)))
        t = s[: max(1, int(len(s) * 0.95))]
        sizes, labels = np.array([len(s), len(t)]), np.array([1, 2])
        i, _ = close_pairs(sizes, [sketch(s), sketch(t)], labels, np.zeros(2), 80, 100, False)
        assert len(i) == (len(t) * 100 >= 80 * len(s))
