"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline as cp
from tests.llm.test_jaccard import brute


def test_stages(spark, tmp_path):
    r = random.Random(12)
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "ter") for b in ("na", "so", "ri") for c in ("", "n", "st")]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    benchmark = [(i, text(30)) for i in range(3)]
    rows, labels = [], []
    for i in range(300):
        t = text(r.randint(30, 90))
        if i % 10 == 0:
            t = " ".join([t.split()[0]] * 50)
        rows.append((i, t))
        labels.append((i, int(i % 10 != 0), 0))
    rows += [(400 + i, rows[5 + i][1]) for i in range(4)]  # copies
    rows += [(500 + i, rows[21 + i][1] + " extra") for i in range(4)]  # near copies
    rows += [(600 + i, text(20) + " " + benchmark[i][1] + " " + text(20)) for i in range(3)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, ids = docs, [set(i for i, _ in rows)]
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        ids.append({x["doc_id"] for x in kept.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
    assert ids[0] - ids[1] == {i for i in range(300) if i % 10 == 0}
    assert ids[2] == ids[1]
    texts = dict(rows)
    want = {d for d, _, c in brute([(i, texts[i]) for i in sorted(ids[2])], 5, 80, 100) if d == c}
    assert ids[3] == want and not ids[3] & {400, 401, 402, 403, 500, 501, 502, 503}
    assert ids[3] - ids[4] == {600, 601, 602}
    out = cp.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in out} == ids[4] and all(x["n_tokens"] == len(x["ids"]) for x in out)


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, repeated rows, columns with clashing names, and an empty table."""
    r = random.Random(3)
    words = [f"{a}{b}" for a in ("ba", "lo", "mi", "ter") for b in ("na", "so", "ri", "sen")]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    good = [text(r.randint(30, 60)) for _ in range(60)]
    item = text(25)
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(None, good[0]), (None, text(40)), (3, text(40)), (3, good[3]), (7, item), (8, f"{text(9)} {item}"), (None, item), (90, None), (91, ""), (5, LONG := text(30_000)), (None, LONG)]
    names = "doc_id long, text string, lang string, source string, n_chars long, h long, node long, row string, id long, `a.b` string"
    docs = spark.createDataFrame([(i, t, "en", None, 0, 1, 2, "r", 3, "d") for i, t in rows], names).repartition(3)
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = rows
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        got = sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=str)
        if name == "language ID":
            want = [x for x in want if x[1]]
        elif name == "n-gram Jaccard join":
            least = {}
            for i, t in want:
                least[t] = min(least.get(t, 10**9), 10**9 if i is None else i)
            want = [(None if i == 10**9 else i, t) for t, i in least.items()]
        elif name == "benchmark decontamination":
            want = [x for x in want if item.lower().rstrip(".") not in x[1].lower()]
        assert got == sorted(want, key=str), name
        docs = spark.createDataFrame(kept.collect(), names).repartition(2)
    out = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(out) == len(want) and all(x["n_tokens"] > 0 for x in out)
