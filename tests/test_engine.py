"""Operators on literal cases, sources and effects on temporary folders."""

import itertools
import json
import random
import re
from collections import Counter
from datetime import datetime
from difflib import SequenceMatcher
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark import config as C
from foliospark.functions import text as T
from foliospark.functions.similarity import fuzzy_similarity
from foliospark.operators import journal, learn, match, names, reconcile, rows, rules, segment
from foliospark.sources import effects, files, recognition, reports, workbook
from foliospark.streaming import segments as stream

CONFIG = C.Config()
RULES = [(0, "配电网工程开工报告", "开工报告"), (1, "配电网工程竣工报告", "竣工报告"), (2, "低压电力电缆试验记录", "0.4kV电缆试验报告"), (3, "工作票", "工作票")]


def one(spark, value, *columns):
    return spark.range(1).select(*[f(F.lit(value)) for f in columns]).first()


# text


def test_normalisers(spark):
    got = one(spark, "ＡＢ１２ ，（x）\t-#b　 \x1c%＋", T.normalize_text, T.normalize_name, T.normalize_compare)
    assert got[0] == "AB12xb%+"
    assert got[1].startswith("AB12") and "(x)" in got[1]
    assert one(spark, "10 KV线 0.4kv 与０.４ＫＶ", T.normalize_name)[0] == "10kV线0.4kV与0.4kV"
    assert one(spark, "Ab c（d）#Ｅ", T.normalize_compare)[0] == "abcdｅ"
    assert spark.range(1).select(T.normalize_text(F.lit(None).cast("string"))).first()[0] == ""


def test_fixes_longest_first(spark):
    assert one(spark, "峻工报告与峻工合区", lambda c: T.apply_fixes(c, CONFIG))[0] == "竣工报告与竣工台区"
    assert one(spark, "x", lambda c: T.apply_fixes(c, C.Config(ocr_fixes={})))[0] == "x"
    both = C.Config(ocr_fixes={"a": "1"}, region_ocr_fixes={"a": "2", "b": "3"})
    assert one(spark, "ab", lambda c: T.apply_fixes(c, both))[0] == "13"


def test_filenames(spark):
    assert one(spark, ' a<b>:"/\\|?*c. .. ', T.sanitize_filename)[0] == "a_b________c. "
    path = F.lit("/r/folder/x.pdf")
    got = spark.range(1).select(rules.new_file_name(F.lit("报告"), path, True), rules.new_file_name(F.lit("报告"), path, False), rules.new_file_name(F.lit(""), path, True)).first()
    assert tuple(got) == ("folder报告.pdf", "报告.pdf", "")


def test_common_substring(spark):
    pairs = [("abcdef", "xbcdy"), ("", "a"), ("a", ""), ("某县供电", "甲县供电"), ("aaa", "aa")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[2] for r in df.select("a", "b", T.common_substring_length(F.col("a"), F.col("b"))).collect()]
    assert got == [SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size for a, b in pairs]


def test_codes(spark):
    cases = [("3225000000000004", "3225000000000004", True), ("3225000000000004", "3225000000000106", True), ("3225000000000004", "3226111000000004", False), ("", "1", False), ("12345678901", "1234567890", True), ("1234567890123", "1234567890", False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert df.filter(T.codes_equivalent(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_similarity_is_ratcliff_obershelp(spark):
    words = ["tide", "diet", "", "配电网工程工报告", "配电网工程开工报告", "a" * 250 + "b"]
    df = spark.createDataFrame(list(itertools.product(words, words)), "a string, b string")
    for r in df.select("a", "b", fuzzy_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert r["s"] == (SequenceMatcher(None, r["a"], r["b"]).ratio() if r["a"] and r["b"] else 0.0)


# rules


def mappings(spark, titles, table, config=CONFIG):
    t = spark.createDataFrame(list(enumerate(titles)), "id int, text string")
    r = spark.createDataFrame(table, "rule_ord int, pattern string, mapping string")
    return [x["mapping"] for x in rules.match_titles(t, r, config).orderBy("id").collect()]


def test_rules_strict_then_fuzzy(spark):
    titles = ["配电网工程开工报告 附件", "配电网工程开工报吿", "无关文字", "", None, "工作票\n配电网工程开工报告", "配电网工程开工报告\n工作票", "配电网工程峻工报告"]
    want = ["开工报告", "开工报告", None, None, None, "工作票", "开工报告", "竣工报告"]
    assert mappings(spark, titles, RULES) == want
    assert mappings(spark, titles, [(3 - o, p, m) for o, p, m in RULES]) == want
    assert mappings(spark, titles, []) == [None] * 8


def test_short_keys_need_to_be_close(spark):
    assert mappings(spark, ["开工时间 竣工时间"], [(0, "开工报告", "开工报告")]) == [None]
    assert mappings(spark, ["abcX", "abcd!"], [(0, "abcd", "four")]) == [None, "four"]


def test_fuzzy_equals_plain_search(spark):
    import random

    r = random.Random(0)
    table = [(i, "".join(r.choice("abcd") for _ in range(r.randint(3, 9))), f"m{i}") for i in range(12)]
    titles = ["".join(r.choice("abcde") for _ in range(r.randint(1, 14))) for _ in range(200)]

    def plain(title):
        inside = [(-len(k), o, m) for o, k, m in table if k in title]
        if inside:
            return min(inside)[2]
        best = (0, 0)
        out = None
        for _, k, m in table:
            if len(k) < 4:
                continue
            spans = [title[a : a + len(k)] for a in range(0, len(title) - len(k) + 1, max(1, len(k) // 4))] or [title]
            score = max(SequenceMatcher(None, s, k).ratio() for s in spans)
            if score >= rules.threshold(len(k)) and (score, len(k)) > best:
                best, out = (score, len(k)), m
        return out

    assert mappings(spark, titles, table, C.Config(ocr_fixes={})) == [plain(t) for t in titles]


def test_rule_edits(spark):
    table = spark.createDataFrame(RULES, "rule_ord int, pattern string, mapping string")
    up = spark.createDataFrame([(1, "new", "n"), (9, "nine", "9"), (8, " ", "keyless")], table.schema)
    assert sorted(r["rule_ord"] for r in rules.edit(table, up, [0]).collect()) == [1, 2, 3, 9]


# rows and segments


def test_rows_anchor_at_their_first_box(spark):
    boxes = [(0, 0, "a"), (10, 5, "b"), (20, 1, "c"), (30, 0, "d"), (46, 0, "e")]
    made = [("p", [{"x": float(x), "y": float(y)}, {"x": x + 5.0, "y": y + 5.0}], t) for y, x, t in boxes]
    df = spark.createDataFrame(made, "pdf string, box array<struct<x:double,y:double>>, text string")
    assert [tuple(r) for r in rows.build_rows(df, ["pdf"]).first()["rows"]] == [(0.0, "ab"), (20.0, "cd"), (46.0, "e")]
    assert len(rows.build_rows(df, ["pdf"], 0.0, 2).first()["rows"]) == 2


PAGES = [("f", 0, None, "封面"), ("f", 1, "开工报告", "配电网工程开工报告"), ("f", 2, "竣工报告", "竣工报告 实际开工时间"), ("f", 3, None, "续页"), ("f", 4, "开工报告", "申请开工"), ("f", 5, None, "")]


def page_class(spark, pages):
    df = spark.createDataFrame(pages, "pdf_id string, page int, mapping string, text string")
    return df.withColumn("rows", F.array(F.struct(F.lit(1.0).alias("y"), F.col("text")))).drop("text")


def test_documents_hold_every_page_once(spark):
    docs = segment.documents(page_class(spark, PAGES)).orderBy("page_start").collect()
    assert [(d["project_ord"], d["page_start"], d["page_end"], d["mapping"], d["pages"]) for d in docs] == [
        (0, 0, 0, "", "P0"), (1, 1, 1, "开工报告", "P1"), (1, 2, 3, "竣工报告", "P2-P3"), (2, 4, 5, "开工报告", "P4-P5")
    ]
    assert docs[0]["is_pre_pages"] and docs[0]["title"] == "封面"
    found = segment.projects(segment.documents(page_class(spark, PAGES))).orderBy("project_ord").collect()
    assert [(p["start_page"], p["end_page"], p["page_range"]) for p in found] == [(0, 0, "P0-P0"), (1, 3, "P1-P3"), (4, 5, "P4-P5")]


def test_conservation_over_random_files(spark):
    import random

    r = random.Random(5)
    pages = [(f"f{f}", p, r.choice([None, "", "开工报告", "竣工报告", "工作票"]), r.choice(["开工报告", "工报告", "竣工验收", "文字"])) for f in range(15) for p in range(r.randint(1, 25))]
    docs = segment.documents(page_class(spark, pages)).collect()
    covered = sorted((d["pdf_id"], p) for d in docs for p in range(d["page_start"], d["page_end"] + 1))
    assert covered == sorted((f, p) for f, p, _, _ in pages)


def test_targets_conflicts_and_warnings(spark):
    matched = spark.createDataFrame(
        [("f", "a", "A", 0, False, "P0-P1"), ("f", "b", "A", 2, False, "P2-P3"), ("f", "", None, 4, False, "P4-P4"), ("f", "", None, 0, True, "P0-P0")],
        "pdf_id string, name string, matched_folder string, start_page int, is_pre_pages boolean, page_range string",
    )
    assert [tuple(r) for r in segment.folder_conflicts(matched.filter("NOT is_pre_pages")).collect()] == [("f", "A", 2, [0, 2])]
    assert sorted((w["kind"], w["detail"]) for w in segment.warnings(matched).collect()) == [("conflict", "A P0,P2"), ("pre_pages", "P0-P0"), ("unmatched", "P4")]


def test_unique_names_skip_taken_numbers(spark):
    plan = spark.createDataFrame([(i, "d", n) for i, n in enumerate(["a.pdf", "a.pdf", "a.pdf", "b.pdf", "a_1.pdf", "c", "c"])], "i int, d string, n string")
    there = spark.createDataFrame([("d", "b.pdf"), ("d", "b_1.pdf")], "d string, n string")
    got = [r["unique_name"] for r in segment.unique_names(plan, "d", "n", ["i"], there).orderBy("i").collect()]
    assert got == ["a.pdf", "a_2.pdf", "a_3.pdf", "b_2.pdf", "a_1.pdf", "c", "c_1"]


def test_attempts(spark):
    assert len(rows.attempt_order(True)) == 28 and rows.attempt_order(orientation=90)[4][1:] == (270, rows.TOPS[0])
    line = lambda t: [{"y": 0.0, "text": t}]
    tries = [("p", 0, "", line("long text"), 0), ("p", 1, "m", line("x"), 90), ("q", 0, None, line("a"), 0), ("q", 1, "", line("bbb"), 90), ("q", 2, "", line("ccc"), 270)]
    df = spark.createDataFrame(tries, "page string, attempt_ord int, mapping string, rows array<struct<y:double,text:string>>, angle int")
    assert sorted((r["page"], r["angle"]) for r in rows.best_attempts(df, ["page"]).collect()) == [("p", 90), ("q", 90)]


# names


REGIONS = C.Config(region_words=("某省某市某县", "某省", "某市", "某县"))


def extracted(spark, texts, config=REGIONS):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r["name"] for r in names.extract_names(df, config).orderBy("id").collect()]


def test_name_forms(spark):
    got = extracted(
        spark,
        [
            "某省某市某县3225000000000004张三0.4KV业扩配套工程",
            "2026年某市某县乙镇某堤口2*配变低压合区维休项目3226000000000007",
            "工程名称：某县乙镇某堡变低压台区维修项目包3\n建设单位",
            "甲县乙镇某楼南前片低压维修项目",
            "工程名称 建设单位", "", "3225000000000004", "普通表格文字", None,
        ],
    )
    assert got[:4] == ["某省某市某县张三0.4kV业扩配套工程", "2026年某市某县乙镇某堤口2#配变低压台区维修项目", "某县乙镇某堡变低压台区维修项目包3", "甲县乙镇某楼南前片低压维修项目"]
    assert got[4:] == [""] * 5


def test_suffix_list_decides(spark):
    other = REGIONS.with_(business_suffixes=("光伏并网工程",))
    assert extracted(spark, ["某县乙镇张三光伏并网工程", "某县乙镇某堡变低压维修项目"], other) == ["某县乙镇张三光伏并网工程", ""]


def test_region_tolerance(spark):
    def hit(text, config):
        return spark.range(1).select(names.fuzzy_region(F.lit(text), config)).first()[0]

    base = C.Config(region_words=("某县",))
    assert tuple(hit("年甲县乙", base)) == (1, 2) and hit("年甲乡乙", base) is None
    assert tuple(hit("年某乡乙", base.with_(region_fuzzy_require_suffix_char=False))) == (1, 2)
    assert hit("年甲县乙", base.with_(region_fuzzy_tolerance=0)) is None
    assert [base.with_(region_fuzzy_tolerance=t).tolerance("某县") for t in (0, 1, "auto", 9)] == [0, 1, 0, 1]


def test_vote_parses_pages_alone(spark):
    pages = [("f", 0, "某县乙镇某堡变低压台区维修项目"), ("f", 1, "某县乙镇某堡变"), ("f", 2, "低压维修项目"), ("g", 0, "无")]
    df = spark.createDataFrame(pages, "pdf string, page int, text string").withColumn("rows", F.array(F.struct(F.lit(0.0).alias("y"), F.col("text"))))
    assert [tuple(r)[:2] for r in names.vote(df, ["pdf"], REGIONS).collect()] == [("f", "某县乙镇某堡变低压台区维修项目")]


def test_learning(spark):
    real = ["2026年某省某市某县张三0.4KV业扩配套工程12"] * 30 + ["某省某市某县乙镇某堡变低压台区维修项目包3"] * 30 + ["丙县李四光伏"]
    df = spark.createDataFrame([(n,) for n in real], "name string")
    found = learn.infer(df)
    assert found["region_words"][:2] == ["某省某市某县乙镇", "某省某市某县"] and "丙县" not in found["region_words"]
    assert "0.4kV业扩配套工程" in found["business_suffixes"] and "改造项目" in found["business_suffixes"]
    assert found["valid_keywords"] == ["业扩", "台区", "维修", "配套工程"] or set(found["valid_keywords"]) == {"业扩", "台区", "维修", "配套工程"}
    assert learn.infer(df.limit(0)) == {}
    assert C.merged(found).region_words[0] == "某省某市某县乙镇"


def plain_suffix(name):
    """The longest legal suffix, each place tried."""
    tail = re.sub(r"包\d+$", "包N", re.sub(r"\d+\Z", "", name))
    for i in range(len(tail)):
        volt = re.match(r"\d+(?:\.\d+)?\s*[kK][vV]", tail[i:])
        volt = volt.group() if volt else ""
        body = tail[i + len(volt) :]
        if 3 <= len(body) <= 14 and body.startswith(learn.HEADS) and body.endswith(learn.TAILS) and not re.search(r"\d{5,}", body):
            return re.sub(r"[ \t\n\r\f\v]*[kK][vV]$", "kV", volt) + body


def test_suffix_is_one_search(spark):
    """Twenty thousand names against plain Python: a search a name, no expression a place (which took minutes)."""
    r = random.Random(4)
    bits = [*learn.HEADS, *learn.TAILS, "包", "包12", "0.4", "10", "12345", "kV", "KV", " kv", "\u3000", " ", "甲", "乙省", "年", "\n", "é", "\U00020000", "٣"]
    values = ["".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(20_000)]
    names = spark.createDataFrame([(v,) for v in [*values, None]], "name string")
    found = names.select("name", learn.business_suffix(F.col("name")).alias("word"))
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {x["name"]: x["word"] for x in found.collect()}
    want = {v: plain_suffix(v) for v in values} | {None: None}
    assert got == want and len({*want.values()}) > 1_000
    counted = {x["word"]: x["n"] for x in learn.suffix_counts(names).collect()}
    assert counted == dict(Counter(w for w in map(want.get, values) if w is not None))


# linking


FOLDERS = ["2026年某市某县乙镇某堤口2#配变低压台区维修项目3999111100000007", "2026年某市某县乙镇某堡变低压台区维修项目3225000000000004", "2026年某市某县乙镇某堡变低压台区维修项目3226777000000005", "某县丙镇完全不同工程"]


def linked(spark, value, folders=FOLDERS, config=CONFIG):
    n = spark.createDataFrame([(v,) for v in value], "name string")
    f = spark.createDataFrame([(i, x) for i, x in enumerate(folders)], "folder_ord long, folder string")
    return n, f


def test_folder_links(spark):
    cases = {
        "2026年某市戊县乙镇某堤口2#配变低压合区维修项目": FOLDERS[0],
        "2026年某市某县乙镇某堡变低压台区维修项目3225000000000006": FOLDERS[1],
        "2026年某市某县乙镇某堡变低压台区维修项目3226777000000015": FOLDERS[2],
        "毫无关系": None,
        "": None,
    }
    got = {r["name"]: r["matched_folder"] for r in match.match_folders(*linked(spark, cases), CONFIG).collect()}
    assert got == cases
    assert {r["matched_folder"] for r in match.match_folders(*linked(spark, cases, []), CONFIG).collect()} == {None}


def test_blocks_do_not_change_links(spark, monkeypatch):
    cases = ["2026年某市戊县乙镇某堡变低压合区维修项目", FOLDERS[3], "某县丙镇完全不同"]
    whole = sorted(map(tuple, match.match_folders(*linked(spark, cases), CONFIG).collect()))
    fixed = sorted(map(str, match.correct_names(*linked(spark, cases), CONFIG).collect()))
    monkeypatch.setattr(match, "FOLDERS_A_BLOCK", 1)
    assert sorted(map(tuple, match.match_folders(*linked(spark, cases), CONFIG).collect())) == whole
    assert sorted(map(str, match.correct_names(*linked(spark, cases), CONFIG).collect())) == fixed


def test_corrections(spark):
    folder = ["2026年某市某县乙镇某堡变低压台区维修项目"]
    cases = {
        "2026年某市戊县乙镇某堡变低压合区维修项目": (folder[0], folder[0]),
        folder[0]: (folder[0], None),
        "某堡变低压台区维修项目": ("某堡变低压台区维修项目", None),
        "与此毫不相干的文字": ("与此毫不相干的文字", None),
        "": ("", None),
    }
    got = {r["name"]: (r["corrected"], r["corrected_by"]) for r in match.correct_names(*linked(spark, cases, folder), CONFIG).collect()}
    assert got == cases


# reconciliation


def reconciled(spark, projects, types, found, table=()):
    p = spark.createDataFrame([(n, i) for i, n in enumerate(projects)], "name string, ord int")
    t = spark.createDataFrame([(n, i) for i, n in enumerate(types)], "type string, ord int")
    files_df = spark.createDataFrame([(f, x) for f, xs in found.items() for x in xs], "folder string, file string")
    folders = spark.createDataFrame([(f, i, f == segment.PRE_PAGES) for i, f in enumerate(found)], "folder string, folder_ord int, is_pre_pages boolean")
    r = spark.createDataFrame(list(table), "rule_ord int, pattern string, mapping string")
    return reconcile.report(p, t, files_df, folders, r), folders


def test_report(spark):
    found = {
        "甲项目": ["甲项目开工报告.pdf", "甲项目竣工报告.pdf"],
        "乙项目（张三）": ["开工报告.pdf", "竣工报告.pdf"],
        "丙项目": ["丙项目开工报告.pdf", "丙项目合格证.pdf", "乱放的文件.pdf"],
        "无名": [], segment.PRE_PAGES: ["前置页面_P0-P1.pdf"],
    }
    rep, folders = reconciled(spark, ["甲项目", "乙项目", "丙项目", "甲项目", " "], ["开工报告", "竣工报告"], found)
    got = {r["name"]: r for r in rep.collect()}
    assert set(got) == {"甲项目", "乙项目", "丙项目"}
    assert (got["甲项目"]["status"], got["乙项目"]["status"], got["丙项目"]["status"]) == (reconcile.COMPLETE, reconcile.COMPLETE, reconcile.MISSING)
    third = got["丙项目"]
    assert (third["missing"], third["extra"], third["mismatch"]) == (["竣工报告"], ["合格证"], ["乱放的文件.pdf"])
    extra = reconcile.unlisted(rep, folders)
    assert [r["folder"] for r in extra.collect()] == ["无名"]
    total = reconcile.summary(rep, extra).first().asDict()
    assert (total["projects"], total["required_total"], total["actual_total"], total["missing_total"], total["ok_projects"], total["actual_only_projects"]) == (3, 6, 6, 1, 2, 1)
    assert reconcile.problems(rep).count() == 3


def test_alias_spellings_are_no_difference(spark):
    rep, _ = reconciled(spark, ["甲"], ["0.4kV电缆试验报告"], {"甲": ["甲低压电力电缆试验记录.pdf"]}, RULES)
    row = rep.first()
    assert (row["status"], row["extra"], row["missing"]) == (reconcile.COMPLETE, [], [])


def test_empty_tree(spark):
    rep, folders = reconciled(spark, ["甲", "乙"], ["a", "b"], {})
    assert [r["missing"] for r in rep.collect()] == [["a", "b"]] * 2
    nothing, none = reconciled(spark, [], ["a"], {})
    assert reconcile.summary(nothing, reconcile.unlisted(nothing, none)).first()["missing_total"] == 0


def test_types_from_templates(spark):
    listed = ["1.模板-开工报告.xlsx", "41、带签字模板-竣工报告.docx", "2.模板-开工报告带签字.xls", "x.txt"]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(listed)], "file string, ord int")
    assert [r["type"] for r in reconcile.types_from_templates(df).orderBy("ord").collect()] == ["开工报告", "竣工报告"]
    assert [r["type"] for r in reconcile.required_types(None, None, spark).orderBy("ord").collect()] == list(reconcile.DEFAULT_TYPES)


def test_aliases_self_mapping_overwrites(spark):
    table = spark.createDataFrame([(0, "b", "a"), (1, "c", "b"), (2, "c", "d")], "rule_ord int, pattern string, mapping string")
    assert {r["key"]: r["canon"] for r in reconcile.alias_map(table).collect()} == {"a": "a", "b": "b", "c": "b", "d": "d"}


# journal and cache


def test_journal(spark, tmp_path):
    lines = [{"seq": 1, "time": "t", "items": [{"old": "a", "new": "b"}]}, {"seq": 2, "time": "t", "type": "split", "items": [{"dst": "x"}, {"dst": "y"}]}, {"seq": 3, "time": "t", "type": "odd", "items": [{"old": "c", "new": "d"}, {"old": "e", "new": "f"}]}]
    (tmp_path / "j.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    j = journal.read_journal(spark, str(tmp_path / "j.json"))
    assert j.count() == 3
    assert [(r["pos"], r["from_path"], r["to_path"]) for r in journal.undo_plan(j, "rename").collect()] == [(1, "f", "e"), (0, "d", "c")]
    assert [r["from_path"] for r in journal.undo_plan(j, "split").collect()] == ["y", "x"]
    left = journal.failed_items(j, spark.createDataFrame([(3, 0)], "seq long, pos int"))
    assert {r["seq"]: len(r["items"]) for r in left.collect()} == {1: 1, 2: 2, 3: 1}
    more = spark.range(100, 125).select(F.col("id").alias("seq"), F.lit("split").alias("type"))
    assert [r["seq"] for r in journal.append(j, more).collect()] == list(range(124, 104, -1))


def test_cache(spark):
    page = spark.createDataFrame([("k1", "m", [(1.0, "t")], 0), ("k2", None, [], 90)], "cache_key string, mapping string, rows array<struct<y:double,text:string>>, angle int")
    entries = journal.cache_entries(page)
    wanted = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "cache_key string")
    hits, misses = journal.cached_pages(wanted, entries)
    assert {r["cache_key"]: r["mapping"] for r in hits.collect()} == {"k1": "m", "k2": None} and [r[0] for r in misses.collect()] == ["k3"]
    broken = entries.withColumn("payload", F.when(F.col("cache_key") == "k1", "{").otherwise(F.col("payload")))
    assert journal.cached_pages(wanted, broken)[1].count() == 2
    assert journal.cached_pages(wanted, entries.withColumn("v", F.lit(99)))[0].count() == 0
    held = spark.range(12).select(F.col("id").alias("mtime"), F.col("id").cast("string").alias("cache_key"), F.lit(10).cast("long").alias("bytes"))
    assert journal.evicted(held, 5).count() == 7 and journal.evicted(held, 50, 35).count() == 9 and journal.evicted(held).count() == 0


def test_cache_key_depends_on_everything(spark):
    base = dict(path="/A/x.pdf", length=1, modificationTime=0, page=0, sig="s", scale=1)

    def key(**change):
        v = base | change
        df = spark.range(1).select(F.lit(v["path"]).alias("path"), F.lit(v["length"]).alias("length"), F.timestamp_micros(F.lit(v["modificationTime"])).alias("modificationTime"), F.lit(v["page"]).alias("page"))
        return journal.page_cache_key(df, "page", v["scale"], v["sig"]).first()["cache_key"]

    changes = [{}, {"path": "/B"}, {"length": 2}, {"modificationTime": 1}, {"page": 1}, {"sig": "t"}, {"scale": 2}]
    assert len({key(**c) for c in changes}) == len(changes) and key(scale=1.0) == key() == key(path="/a/X.pdf")


# sources, sinks, effects


@pytest.fixture
def tree(tmp_path):
    for f in ("甲/甲开工报告.pdf", "甲/说明.txt", "未匹配项目/乙/开工报告.PDF", "未匹配项目/_前置页面/前置页面_P0-P1.pdf", "root b.pdf", "a.pdf"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"%PDF")
    (tmp_path / "empty").mkdir()
    (tmp_path / ".hidden").mkdir()
    return tmp_path


def test_scans(spark, tree):
    assert files.scan_pdfs(spark, str(tree)).count() == 4  # not below _前置页面
    assert files.first_pdf(spark, str(tree)).first()["path"].endswith("/a.pdf")
    assert [r["folder"] for r in files.list_folders(spark, str(tree)).orderBy("folder_ord").collect()] == ["empty", "未匹配项目", "甲"]
    folders, got = files.scan_received(spark, str(tree))
    assert {(r["folder"], r["is_unmatched"], r["is_pre_pages"]) for r in folders.collect()} == {("empty", False, False), ("甲", False, False), ("乙", True, False), ("_前置页面", True, True)}
    assert {(r["folder"], r["file"]) for r in got.collect()} == {("甲", "甲开工报告.pdf"), ("乙", "开工报告.PDF"), ("_前置页面", "前置页面_P0-P1.pdf")}


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    workbook.write_workbook(path, {"none": [["x"]], "rules": [["title"], [None, "映射内容", "识别内容"], [None, "m1", "p1"], [None, "m2", None], [None, None, "p3"]], "names": [["项目名称"], ["b"], ["a"], ["b"]], "more": [["n", "项目名称"], [1, "c<&>"]]})
    assert [(r["pattern"], r["mapping"]) for r in workbook.read_rules(spark, path).orderBy("rule_ord").collect()] == [("p1", "m1"), ("p3", "")]
    assert [r["name"] for r in workbook.read_names(spark, path).orderBy("ord").collect()] == ["b", "a", "c<&>"]
    assert workbook.read_names(spark, path, distinct=False).count() == 4
    assert workbook.read_names(spark, path, "absent").count() == 0


class FakeProvider:
    """Pages are bytes: 0 blank, 1 text at 90 degrees, 2 a title in the upper half, 3 one in the corner, 4 no rule, 9 broken."""

    def pages(self, content, first_only):
        if content == b"bad":
            raise ValueError("not a PDF")
        return 1 if first_only else len(content)

    def orientation(self, content, page):
        return 90 if content[page] == 3 else 0

    def recognise(self, content, page, angle, region):
        kind = content[page]
        if kind == 9:
            raise MemoryError
        title = [(30.0, 0.0, "配电网工程"), (31.0, 50.0, "开工报告")]
        if kind == 1:
            return [(5.0, 1.0, "b"), (0.0, 0.0, "a")] if angle == 90 else []
        if kind == 2 and angle == 0:
            return [] if region[3] < 0.15 else [(0.0, 0.0, "x")] if region[3] < 0.5 else title + ([(99.0, 0.0, "工程名称")] if region == rows.WHOLE else [])
        if kind == 3:
            return [(0.0, 0.0, "工作票")] if region == rows.CORNERS[1] and angle == 90 else [(0.0, 0.0, "yy")] if region == rows.WHOLE else []
        return [(0.0, 0.0, "unlike"), (0.0, 9.0, str(angle))] if kind == 4 else []


def test_recognition_is_pluggable(spark):
    df = spark.createDataFrame([("f", bytearray(b"\x01\x00"))], "path string, content binary")
    got = recognition.page_rows(recognition.recognise(df, FakeProvider, prescan=False)).orderBy("page").collect()
    assert [(r["page"], r["angle"], [x["text"] for x in r["rows"]]) for r in got] == [(0, 90, ["ab"]), (1, 0, [])]
    assert recognition.recognise(df, FakeProvider, first_only=True).count() == 1
    with pytest.raises(Exception, match="no page recognition provider"):
        recognition.recognise(df).collect()
    bad = spark.createDataFrame([("a", bytearray(b"\x01")), ("b", bytearray(b"bad")), ("c", bytearray(b"\x01\x09"))], "path string, content binary")
    got = {(r["pdf_id"], r["page"]): r["error"] for r in recognition.recognise(bad, FakeProvider, prescan=False).collect()}
    assert got == {("a", 0): None, ("b", None): "not a PDF", ("c", None): "MemoryError"}
    assert recognition.page_rows(recognition.recognise(bad, FakeProvider)).count() == 1


def test_recognition_ladder(spark):
    df = spark.createDataFrame([("f", bytearray(b"\x00\x02\x03\x04")), ("g", bytearray(b"bad"))], "path string, content binary")
    found = recognition.classify(df, rule_rows(spark), FakeProvider, CONFIG)
    got = {(r["pdf_id"], r["page"]): r for r in recognition.page_rows(found).collect()}
    text = lambda page: [x["text"] for x in got["f", page]["rows"]]
    assert [(got["f", p]["mapping"], got["f", p]["angle"]) for p in range(4)] == [(None, 0), ("开工报告", 0), ("工作票", 90), (None, 270)]
    assert text(0) == [] and text(1) == ["配电网工程开工报告", "工程名称"] and text(2) == ["工作票"] and text(3) == ["unlike270"]
    assert [r["error"] for r in found.filter("pdf_id = 'g'").collect()] == ["not a PDF"]
    corners_left_out = recognition.classify(df, rule_rows(spark), FakeProvider, CONFIG, drawing=False)
    assert {r["page"] for r in corners_left_out.filter("mapping IS NOT NULL").collect()} == {1}


def rule_rows(spark):
    return spark.createDataFrame(RULES, "rule_ord int, pattern string, mapping string")


def test_matcher_equals_match_titles(spark):
    table = rule_rows(spark)
    judge = rules.matcher(rules.prepare(table, CONFIG), CONFIG)
    titles = ["配电网工程开工报告", "前文\n配电网 工程峻工报告。\n工作票", "配电网工呈开工报告", "低压电力电缆试验纪录 表", "无关", "", "工作票\r\n配电网工程开工报告", "工 作　票\x1c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, text string")
    assert [r["mapping"] for r in rules.match_titles(df, table, CONFIG).orderBy("i").collect()] == [judge(t) for t in titles]
    boxes = [(0.0, 2.0, "b"), (10.0, 0.0, "c"), (0.0, 1.0, "a"), (20.0, 0.0, "d"), (40.0, 0.0, "e")]
    same = spark.createDataFrame([([dict(y=y, x=x, text=t) for y, x, t in boxes],)], "b array<struct<y:double,x:double,text:string>>")
    assert [tuple(r) for r in same.select(rows.grouped_rows(F.col("b"))).first()[0]] == rows.rows_of(boxes)


def test_rules_workbook_and_signature(spark, tmp_path):
    path = str(tmp_path / "r.xlsx")
    first, made = workbook.load_rules(spark, path)
    assert made and [(r["pattern"], r["mapping"]) for r in first.orderBy("rule_ord").collect()] == rules.DEFAULT_RULES
    defaults = rules.prepare(first, CONFIG)
    workbook.save_rules(rule_rows(spark), path)
    again, made = workbook.load_rules(spark, path)
    assert not made and again.count() == len(RULES)
    one, other = journal.parameter_signature(rules.prepare(again, CONFIG)), journal.parameter_signature(defaults)
    assert one != other and one != journal.parameter_signature(rules.prepare(again, CONFIG), scale=2)


def test_orientation():
    page = np.full((200, 200), 255.0)
    page[::10] = 0
    assert recognition.orientation(page) == 0 and recognition.orientation(page.T) == 90


def test_reports(spark, tmp_path):
    rep, folders = reconciled(spark, ["甲"], ["a", "b"], {"甲": ["甲a.pdf"], "别": ["2.pdf", "1.pdf"], "空": []})
    others = reconcile.unlisted(rep, folders)
    total = reconcile.summary(rep, others)
    got = spark.createDataFrame([("甲", "甲a.pdf"), ("别", "2.pdf"), ("别", "1.pdf")], "folder string, file string")
    others = reconcile.unlisted_files(others, got)
    made = datetime(2026, 1, 2, 3, 4, 5)
    path = str(tmp_path / "deep" / "r.csv")
    assert reports.export_csv(rep, reconcile.problems(rep), total, path, "/root/x", others, made) == path
    raw = Path(path).read_bytes()
    lines = raw.decode("utf-8-sig").splitlines()
    assert raw.startswith(b"\xef\xbb\xbf") and lines[:3] == ["资料完整性核对报告", "生成时间,2026-01-02 03:04:05", "核对目录,/root/x"]
    assert lines[3:5] == ["项目数,1,应交合计,2,实收合计,1", "缺失合计,1,多余合计,0,命名不一致合计,0"] and "甲,缺失,b" in lines
    assert lines[-2:] == ["别,多余,目录中存在但进度表未列出：1.pdf、2.pdf", "空,多余,目录中存在但进度表未列出："]
    reports.export_xlsx(rep, reconcile.problems(rep), total, str(tmp_path / "r.xlsx"), unlisted=others)
    cells = workbook.cells(spark, str(tmp_path / "r.xlsx"))
    assert cells.filter("value = '缺失'").count() == 3 and cells.filter("value LIKE '目录中存在%'").count() == 2
    table = spark.createDataFrame(RULES, "rule_ord int, pattern string, mapping string")
    assert reports.import_rules(table, str(tmp_path / "rules")) == 4 and reports.import_rules(table.limit(2), str(tmp_path / "rules")) == 2
    with pytest.raises(ValueError, match="no rules"):
        reports.import_rules(table.limit(0), str(tmp_path / "rules"))
    assert spark.read.parquet(str(tmp_path / "rules")).count() == 2


def test_effects(spark, tree):
    results = spark.createDataFrame([(str(tree / "a.pdf"), "报告", "match", True), (str(tree / "root b.pdf"), "报告", "match", True), (str(tree / "gone.pdf"), "x", "match", False)], "path string, mapping string, status string, exists boolean")
    done = effects.apply_renames(journal.rename_plan(results))
    assert [d["error"] for d in done] == [None, "gone", None] and (tree / "报告.pdf").exists() and (tree / "报告_1.pdf").exists()
    items = [{"old": d["old"], "new": d["new"], "dst": None} for d in done if d["new"]]
    j = spark.createDataFrame([(1, "t", None, items)], journal.JOURNAL)
    assert [d["error"] for d in effects.apply_undo(journal.undo_plan(j, "rename"))] == [None, None] and (tree / "root b.pdf").exists()
    plan = spark.createDataFrame([("src", 0, 1, str(tree / "out"), "d.pdf"), ("src", 2, 2, str(tree / "out"), "d.pdf")], "pdf_id string, page_start int, page_end int, target_dir string, unique_name string")
    made = effects.apply_split(plan, lambda s, a, b, t: open(t, "w").write(f"{a}-{b}") and None)
    assert sorted(p.name for p in (tree / "out").iterdir()) == ["d.pdf", "d_1.pdf"]
    j = spark.createDataFrame([(2, "t", "split", [{"old": None, "new": None, "dst": m["dst"]} for m in made] + [{"old": None, "new": None, "dst": "/nowhere"}])], journal.JOURNAL)
    assert [d["error"] for d in effects.apply_undo(journal.undo_plan(j, "split"))] == ["missing", None, None] and not (tree / "out").exists()


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    C.save(CONFIG.with_(max_name_len=70), path)
    assert json.loads(open(path, encoding="utf-8").read()) == {"version": 1, "max_name_len": 70}
    assert C.load(path)[0].max_name_len == 70 and C.load(str(tmp_path / "none"))[0] == CONFIG
    (tmp_path / "bad").write_text("{")
    assert C.load(str(tmp_path / "bad"))[0] == CONFIG and C.load(str(tmp_path / "bad"))[1]
    assert C.merged({"_comment": "x", "noise_words": None, "business_suffixes": ["z"]}).business_suffixes == ("z",)


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    page = lambda f, p, of, m, t: json.dumps({"pdf_id": f, "page": p, "page_count": of, "mapping": m, "rows": [{"y": 1.0, "text": t}]}, ensure_ascii=False)
    (source / "1.json").write_text("\n".join([page("f", 0, 2, "开工报告", "开工报告"), page("g", 0, 2, None, "x")]))
    run = lambda: stream.classify_stream(stream.page_stream(spark, str(source)), lambda df: df, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    assert stream.complete_files(spark, str(tmp_path / "out")).count() == 0
    (source / "2.json").write_text(page("f", 1, 2, None, "续页"))
    run()
    docs = segment.documents(stream.complete_files(spark, str(tmp_path / "out"))).collect()
    assert [(d["pdf_id"], d["page_start"], d["page_end"]) for d in docs] == [("f", 0, 1)]
