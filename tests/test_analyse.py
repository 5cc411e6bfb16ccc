"""The composite analyses on literal files."""

from pyspark.sql import functions as F

from foliospark import config as C
from foliospark.operators import analyse, journal

ROWS = "array<struct<y:double,text:string>>"
RULES = [(0, "配电网工程开工报告", "开工报告"), (1, "配电网工程竣工报告", "竣工报告"), (2, "工作票", "工作票")]


def lines(*texts):
    return [(float(i), t) for i, t in enumerate(texts)]


def rule_table(spark):
    return spark.createDataFrame(RULES, "rule_ord int, pattern string, mapping string")


def test_titles(spark):
    attempts = [
        ("/r/f/a.pdf", 0, 0, lines("封面"), 0, None), ("/r/f/a.pdf", 0, 1, lines("配电网工程开工报告", "附件"), 90, None), ("/r/f/a.pdf", 1, 2, lines("工作票"), 0, None),
        ("/r/f/b.pdf", 0, 0, lines("x"), 0, None), ("/r/f/b.pdf", 1, 1, lines("工作票"), 0, None),
        ("/r/f/c.pdf", 0, 0, lines("无关", "文字"), 0, None), ("/r/f/d.pdf", 0, 0, [], 0, "broken file"),
    ]
    df = spark.createDataFrame(attempts, f"path string, stage int, attempt_ord int, rows {ROWS}, angle int, error string")
    out = analyse.analyse_titles(df, rule_table(spark), by_folder=True)
    assert [(r["base_name"], r["status"], r["new_name"]) for r in out.orderBy("path").collect()] == [
        ("a.pdf", "match", "f开工报告.pdf"), ("b.pdf", "match", "f工作票.pdf"), ("c.pdf", "no_match", None), ("d.pdf", "failed", None)
    ]
    assert {r["status"]: r["n"] for r in analyse.status_counts(out).collect()} == {"match": 2, "no_match": 1, "failed": 1}
    shown = {r["base_name"]: (r["status"], r["title"], r["result"]) for r in analyse.preview_titles(out).collect()}
    assert shown["a.pdf"] == ("匹配", "配电网工程开工报告 附件", "f开工报告.pdf") and shown["d.pdf"][2] == "broken file"


def test_cache_spares_recognition(spark):
    pages = spark.createDataFrame([("f", 0, "k0"), ("f", 1, "k1")], "pdf_id string, page int, cache_key string")
    held = spark.createDataFrame([("k0", "开工报告", lines("开工"), 0)], f"cache_key string, mapping string, rows {ROWS}, angle int")
    asked = []

    def recognise(misses):
        asked.extend(r["page"] for r in misses.collect())
        return misses.select("pdf_id", "page", F.lit(0).alias("attempt_ord"), F.array(F.struct(F.lit(0.0).alias("y"), F.lit("工作票").alias("text"))).alias("rows"), F.lit(0).alias("angle"))

    out = analyse.classify_cached(pages, journal.cache_entries(held), recognise, rule_table(spark))
    assert sorted((r["page"], r["mapping"]) for r in out.collect()) == [(0, "开工报告"), (1, "工作票")] and asked == [1]


def test_split(spark):
    one, two = "2026年某市某县乙镇某堡变低压台区维修项目", "某县王村大队一号支线线路改造项目"
    pages = [
        ("f", 0, None, lines("封面")),
        ("f", 1, "开工报告", lines("配电网工程开工报告", "工程名称：" + one.replace("台区", "合区"))),
        ("f", 2, "竣工报告", lines("竣工报告")), ("f", 3, None, lines("续页")), ("f", 4, "竣工报告", lines("竣工报告")),
        ("f", 5, "开工报告", lines("配电网工程开工报告", "工程名称：" + two)), ("f", 6, "工作票", lines("工作票")),
    ]
    df = spark.createDataFrame(pages, f"pdf_id string, page int, mapping string, rows {ROWS}")
    folders = spark.createDataFrame([(0, one + "3225000000000004")], "folder_ord long, folder string")
    config = C.Config(region_words=("某市", "某县"))
    parts = analyse.analyse_split(df, folders, "/out", config, by_folder=False)
    docs = parts["documents"].orderBy("page_start").collect()
    assert [(d["page_start"], d["page_end"], d["unique_name"]) for d in docs] == [
        (0, 0, "前置页面_P0-P0.pdf"), (1, 1, "开工报告.pdf"), (2, 3, "竣工报告.pdf"), (4, 4, "竣工报告_1.pdf"), (5, 5, "开工报告.pdf"), (6, 6, "工作票.pdf")
    ]
    assert docs[0]["target_dir"] == "/out/未匹配项目/_前置页面" and docs[1]["target_dir"] == f"/out/{one}3225000000000004"
    projects = {p["project_ord"]: p for p in parts["projects"].collect()}
    assert projects[1]["matched_folder"] == one + "3225000000000004" and projects[2]["no_folder"]
    assert projects[2]["name"] == two and docs[4]["target_dir"] == f"/out/未匹配项目/{two}"
    assert {(w["kind"]) for w in parts["warnings"].collect()} == {"unmatched", "pre_pages"}
    assert parts["summary"].first().asDict() == {"pdf_id": "f", "page_count": 7, "total_docs": 6, "pre_pages": 1}
    assert analyse.preview_split(parts).count() == 3 + 6 + 2
