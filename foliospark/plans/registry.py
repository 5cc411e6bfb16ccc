"""The engine's operators over the tabular test data, with the same queries in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.functions import similarity
from foliospark.functions import text as T
from foliospark.operators import journal, learn, match, names, reconcile, rows, rules, segment

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PLAIN = Config(ocr_fixes={}, symbol_fixes={})

# Latin rules for prose: the pattern is what a line holds, in order.
LATIN_RULES = [
    (0, "the thing", "thing"),
    (1, "of the", "genitive"),
    (2, "de la", "romance"),
    (3, "der", "german"),
    (4, "ción de", "spanish"),
    (5, "and the", "joined"),
    (6, "All rights reserved", "licence"),
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latin_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LATIN_RULES, "rule_ord int, pattern string, mapping string")


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_SPACES = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}\x{1c}-\x{1f}\x{0b}]+"
def normalize_sql(text: str) -> str:
    """normalize_text in SQL: to half width, then the marks out."""
    half = f"translate(coalesce({text}, ''), '{T.WIDE}', '{T.NARROW.replace(chr(39), chr(39) * 2)}')"
    bare = f"translate({half}, '{T.PUNCTUATION.replace(chr(39), chr(39) * 2)}', '')"
    return f"regexp_replace({bare}, '{_SPACES}', '', 'g')"


def compare_sql(text: str) -> str:
    bare = f"regexp_replace(coalesce({text}, ''), '{_SPACES}', '', 'g')"
    return f"lower(translate({bare}, '{T.COMPARE_MARKS.replace(chr(39), chr(39) * 2)}', ''))"


_RULES_SQL = "(VALUES " + ", ".join(f"({o}, '{p}', '{m}')" for o, p, m in LATIN_RULES) + ") r(rule_ord, pattern, mapping)"
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_MATCH_SQL = f"""
    lines AS (
        SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS place
        FROM (SELECT doc_id, regexp_split_to_array(text, '{_LINES}') AS l FROM documents)
    ), clean AS (SELECT doc_id, place, {normalize_sql("line")} AS line FROM lines),
    keys AS (SELECT rule_ord, {normalize_sql("pattern")} AS key, mapping FROM {_RULES_SQL}),
    hits AS (
        SELECT doc_id, mapping, row_number() OVER (PARTITION BY doc_id ORDER BY place, length(key) DESC, rule_ord) AS r
        FROM clean JOIN keys ON contains(line, key)
    ), mapped AS (SELECT d.doc_id, h.mapping FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id AND h.r = 1)
"""


@query("n8_match_titles", f"WITH {_MATCH_SQL} SELECT coalesce(mapping, '') AS mapping, count(*)::BIGINT AS n FROM mapped GROUP BY 1")
def n8_match_titles(spark, sf_dir):
    """S1, J1, N8 strict, G1: lines of documents against rules, counted by mapping."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    matched = rules.match_titles(docs, latin_rules(spark), PLAIN, fuzzy=False)
    return matched.groupBy(F.coalesce("mapping", F.lit("")).alias("mapping")).agg(F.count(F.lit(1)).alias("n"))


@query("j1_rule_of_each_title", f"WITH {_MATCH_SQL} SELECT doc_id, mapping FROM mapped")
def j1_rule_of_each_title(spark, sf_dir):
    return rules.match_titles(table(spark, sf_dir, "documents").select("doc_id", "text"), latin_rules(spark), PLAIN, fuzzy=False).select("doc_id", "mapping")


@query("j2_fuzzy_rules")
def j2_fuzzy_rules(spark, sf_dir):
    """Part names against rules with one letter wrong; held against difflib in the tests."""
    near = spark.createDataFrame([(i, p, p) for i, p in enumerate(("almond antiqe", "steal polished", "blu spring"))], "rule_ord int, pattern string, mapping string")
    titles = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))
    return rules.match_titles(titles, near, PLAIN)


@query("s1_normalize_text", f"SELECT doc_id, {normalize_sql('text')} AS clean FROM documents")
def s1_normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("clean"))


@query("s3_normalize_compare", f"SELECT page_id, {compare_sql('url')} AS clean FROM pages")
def s3_normalize_compare(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_compare(F.col("url")).alias("clean"))


_FIXES = {"thethe": "the", "the": "THE", "ment": "mt", "ción": "cion"}


def _nested(text: str) -> str:
    for wrong, right in Config(ocr_fixes=_FIXES).fixes:
        text = f"replace({text}, '{wrong}', '{right}')"
    return text


@query("s4_apply_fixes", f"SELECT doc_id, {_nested('text')} AS fixed FROM documents")
def s4_apply_fixes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.apply_fixes(F.col("text"), Config(ocr_fixes=_FIXES)).alias("fixed"))


@query(
    "s8_common_substring",
    """
    WITH p AS (SELECT DISTINCT p_name AS n, split_part(p_brand, '#', 1) || ' ' || p_type AS m FROM part)
    SELECT n, m, coalesce((SELECT max(l) FROM range(1, length(n) + 1) t(l), range(1, length(n) + 1) u(i)
        WHERE i + l - 1 <= length(n) AND contains(m, substr(n, i, l))), 0)::INTEGER AS lcs FROM p
    """,
)
def s8_common_substring(spark, sf_dir):
    """Each part's name against its own brand and type."""
    kind = F.concat_ws(" ", F.split_part("p_brand", F.lit("#"), F.lit(1)), "p_type")
    pairs = table(spark, sf_dir, "part").select(F.col("p_name").alias("n"), kind.alias("m")).distinct()
    return pairs.select("n", "m", T.common_substring_length(F.col("n"), F.col("m")).alias("lcs"))


_MISMATCH = "(SELECT count(*) FROM range(1, length({0}) + 1) t(i) WHERE substr({0}, i, 1) <> substr({1}, i, 1))"


@query(
    "s12_code_equivalence",
    f"""
    WITH c AS (SELECT substr(c_name, 10) AS a, lpad(((c_custkey * 7) % 1500)::VARCHAR, 9, '0') AS b, c_custkey FROM customer)
    SELECT c_custkey, {_MISMATCH.format("a", "b")}::INTEGER AS gap, {_MISMATCH.format("a", "b")} <= 2 AS same FROM c
    """,
)
def s12_code_equivalence(spark, sf_dir):
    """Digit tails of names against other codes of the same length."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.substring("c_name", 10, 100).alias("a"), F.lpad((F.col("c_custkey") * 7 % 1500).cast("string"), 9, "0").alias("b"))
    return c.select("c_custkey", T.char_mismatches(F.col("a"), F.col("b")).alias("gap"), T.codes_equivalent(F.col("a"), F.col("b")).alias("same"))


@query(
    "s13_aligned_replace",
    """
    WITH p AS (SELECT DISTINCT p_name AS n, 'xx ' || translate(p_name, 'ae', 'ea') || ' yy' AS noisy FROM part),
    w AS (SELECT n, noisy, i, (SELECT count(*) FROM range(length(n)) t(k) WHERE substr(noisy, (i + k)::INT, 1) <> substr(n, (1 + k)::INT, 1)) AS gap
        FROM p, LATERAL (SELECT unnest(range(1, length(noisy) - length(n) + 2)) AS i)),
    b AS (SELECT n, noisy, min(gap) AS gap, arg_min(i, gap * 1000 + i) AS i FROM w GROUP BY n, noisy)
    SELECT n, CASE WHEN gap > 0 AND gap / length(n) <= 0.34 THEN substr(noisy, 1, (i - 1)::INT) || n || substr(noisy, (i + length(n))::INT) ELSE noisy END AS fixed FROM b
    """,
)
def s13_aligned_replace(spark, sf_dir):
    n = F.col("p_name")
    noisy = F.concat(F.lit("xx "), F.translate(n, "ae", "ea"), F.lit(" yy"))
    return table(spark, sf_dir, "part").select("p_name").distinct().select(n.alias("n"), T.aligned_replace(noisy, n).alias("fixed"))


@query(
    "s21_file_names",
    """
    WITH t AS (SELECT page_id, regexp_replace(trim(translate(url, '<>:"/\\|?*', '_________')), '\\.+$', '') AS clean FROM pages)
    SELECT page_id, clean, CASE WHEN clean = '' THEN '' ELSE clean || '.pdf' END AS file FROM t
    """,
)
def s21_file_names(spark, sf_dir):
    """S21, C10."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.sanitize_filename(F.col("url")).alias("clean"), rules.new_file_name(F.col("url"), F.lit("a/b.pdf"), False).alias("file"))


@query(
    "w6_unique_names",
    """
    WITH f AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS dir, split_part(url, '/', 4) || '.html' AS name FROM pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY page_id) - 1 AS r FROM f)
    SELECT page_id, dir, name, CASE WHEN r = 0 THEN name ELSE replace(name, '.html', '') || '_' || r || '.html' END AS unique_name FROM r
    """,
)
def w6_unique_names(spark, sf_dir):
    url = F.col("url")
    files = table(spark, sf_dir, "pages").select(
        "page_id",
        F.split_part(F.split_part(url, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("dir"),
        F.concat(F.split_part(url, F.lit("/"), F.lit(4)), F.lit(".html")).alias("name"),
    )
    return segment.unique_names(files, "dir", "name", ["page_id"])


_EVENT_SEGMENTS = """
    numbered AS (
        SELECT *, sum((event_type = 'signup')::INT) OVER w AS p FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
    ), dealt AS (
        SELECT *, sum((event_type = 'signup' OR (p > 0 AND event_type IN ('click', 'purchase')))::INT) OVER w AS d FROM numbered
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
    )
"""


def _event_pages(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "events")
    mapped = F.col("event_type").isin("click", "purchase")
    return segment.number_segments(pages, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", mapped)


@query(
    "w2_segments",
    f"""
    WITH {_EVENT_SEGMENTS}
    SELECT user_id, p::BIGINT AS project_ord, (d - min(d) OVER (PARTITION BY user_id, p))::BIGINT AS doc_ord, min(event_id) AS first_id,
        max(event_id) AS last_id, count(*)::BIGINT AS pages FROM dealt GROUP BY user_id, p, d
    """,
)
def w2_segments(spark, sf_dir):
    """A user's events as pages; signup opens a project."""
    grouped = _event_pages(spark, sf_dir).groupBy("user_id", "project_ord", "doc_ord")
    return grouped.agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("pages"))


@query(
    "w1_conversation_turns",
    """
    WITH n AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS p FROM conversations)
    SELECT conv_id, p::BIGINT AS project_ord, min(turn) AS first_turn, max(turn) AS last_turn, count(*)::BIGINT AS pages FROM n GROUP BY conv_id, p
    """,
)
def w1_conversation_turns(spark, sf_dir):
    numbered = segment.number_segments(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role"], F.col("role") == "user", F.lit(False))
    grouped = numbered.groupBy("conv_id", "project_ord")
    return grouped.agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("pages"))


@query(
    "w4_grouped_rows",
    """
    WITH RECURSIVE b AS (
        SELECT user_id, event_type, epoch(ts::TIMESTAMP) AS y, event_id,
            row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts::TIMESTAMP), event_id) AS i FROM events
    ), f AS (
        SELECT user_id, i, y AS anchor, 1 AS row FROM b WHERE i = 1
        UNION ALL
        SELECT b.user_id, b.i, CASE WHEN abs(b.y - f.anchor) <= 86400 THEN f.anchor ELSE b.y END,
            CASE WHEN abs(b.y - f.anchor) <= 86400 THEN f.row ELSE f.row + 1 END
        FROM f JOIN b ON b.user_id = f.user_id AND b.i = f.i + 1
    )
    SELECT f.user_id, f.row::INTEGER AS row, string_agg(b.event_type, '' ORDER BY b.i) AS text
    FROM f JOIN b ON f.user_id = b.user_id AND f.i = b.i GROUP BY f.user_id, f.row
    """,
)
def w4_grouped_rows(spark, sf_dir):
    """Events as boxes, seconds as heights, a day as tolerance."""
    events = table(spark, sf_dir, "events")
    box = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("y"), F.col("event_id").cast("double").alias("x"), F.col("event_type").alias("text"))
    grouped = events.groupBy("user_id").agg(rows.grouped_rows(F.collect_list(box), 86400e6, 1 << 30).alias("rows"))
    return grouped.select("user_id", F.posexplode("rows").alias("row", "r")).select("user_id", (F.col("row") + 1).alias("row"), F.col("r.text").alias("text"))


@query(
    "w5_best_attempt",
    """
    WITH a AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS mapping,
        length(o_orderpriority) AS n FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (mapping = '')::INT, CASE WHEN mapping = '' THEN -n ELSE 0 END, o_orderkey) AS r FROM a)
    SELECT o_custkey, mapping, o_orderkey AS angle FROM r WHERE r = 1
    """,
)
def w5_best_attempt(spark, sf_dir):
    """The first attempt with a mapping, else the one with most text."""
    line = F.array(F.struct(F.lit(0.0).alias("y"), F.col("o_orderpriority").alias("text")))
    attempts = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.col("o_orderkey").alias("attempt_ord"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("").alias("mapping"),
        line.alias("rows"),
        F.col("o_orderkey").alias("angle"),
    )
    return rows.best_attempts(attempts, ["o_custkey"]).select("o_custkey", "mapping", "angle")


_TYPES = "('1-URGENT', 0), ('2-HIGH', 1), ('3-MEDIUM', 2), ('4-NOT SPECIFIED', 3)"


def _reconciled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, sf_dir, "customer")
    projects = customers.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("ord"))
    types = spark.createDataFrame([("1-URGENT", 0), ("2-HIGH", 1), ("3-MEDIUM", 2), ("4-NOT SPECIFIED", 3)], "type string, ord int")
    aliases = spark.createDataFrame([(0, "3-medium.", "3-MEDIUM")], "rule_ord int, pattern string, mapping string")
    got = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    misnamed = F.col("o_orderkey") % 97 == 0
    file = F.concat(F.when(misnamed, F.lit("odd")).otherwise(F.col("c_name")), "o_orderpriority", F.lit(".pdf"))
    files = got.select(F.col("c_name").alias("folder"), file.alias("file")).distinct()
    folders = files.select("folder").distinct().select("folder", F.substring("folder", 10, 20).cast("long").alias("folder_ord"), F.lit(False).alias("is_pre_pages"))
    # Folders that are listed nowhere.
    others = table(spark, sf_dir, "supplier").select("s_name", (F.lit(1 << 40) + F.col("s_suppkey")).alias("folder_ord"), F.lit(False))
    folders = folders.union(others)
    return reconcile.report(projects, types, files, folders, aliases), folders


_REPORT_SQL = f"""
    t(type, ord) AS (VALUES {_TYPES}),
    got AS (SELECT DISTINCT c_name, o_orderpriority AS type, o_orderkey % 97 = 0 AS odd FROM orders JOIN customer ON o_custkey = c_custkey),
    miss AS (SELECT c_name, string_agg(type, ',' ORDER BY ord) AS missing, count(*) AS n FROM customer, t
        WHERE NOT EXISTS (SELECT 1 FROM got WHERE got.c_name = customer.c_name AND got.type = t.type AND NOT odd) GROUP BY c_name),
    ext AS (SELECT c_name, string_agg(type, ',' ORDER BY type) AS extra, count(*) AS n FROM got WHERE NOT odd AND type NOT IN (SELECT type FROM t) GROUP BY c_name),
    mis AS (SELECT c_name, string_agg('odd' || type || '.pdf', ',' ORDER BY type) AS mismatch, count(*) AS n FROM got WHERE odd GROUP BY c_name),
    act AS (SELECT c_name, count(DISTINCT type) AS n FROM got WHERE NOT odd GROUP BY c_name),
    report AS (SELECT c.c_name AS name, coalesce(missing, '') AS missing, coalesce(extra, '') AS extra, coalesce(mismatch, '') AS mismatch,
        CASE WHEN missing IS NOT NULL THEN '{reconcile.MISSING}' WHEN mismatch IS NOT NULL THEN '{reconcile.MISNAMED}' WHEN extra IS NOT NULL THEN '{reconcile.EXTRA}' ELSE '{reconcile.COMPLETE}' END AS status,
        coalesce(miss.n, 0) AS n_miss, coalesce(ext.n, 0) AS n_ext, coalesce(mis.n, 0) AS n_mis, coalesce(act.n, 0) AS n_act
        FROM customer c LEFT JOIN miss USING (c_name) LEFT JOIN ext USING (c_name) LEFT JOIN mis USING (c_name) LEFT JOIN act USING (c_name))
"""


@query("n15_reconcile", f"WITH {_REPORT_SQL} SELECT name, missing, extra, mismatch, status FROM report")
def n15_reconcile(spark, sf_dir):
    """Customers x priorities expected, order files received."""
    found, _ = _reconciled(spark, sf_dir)
    return found.select("name", *[F.array_join(c, ",").alias(c) for c in ("missing", "extra", "mismatch")], "status")


@query(
    "g2_report_summary",
    f"""
    WITH {_REPORT_SQL} SELECT count(*)::BIGINT AS projects, (4 * count(*))::BIGINT AS required_total, sum(n_act)::BIGINT AS actual_total,
        sum(n_miss)::BIGINT AS missing_total, sum(n_ext)::BIGINT AS extra_total, sum(n_mis)::BIGINT AS mismatch_total,
        count(*) FILTER (status = '{reconcile.COMPLETE}')::BIGINT AS ok_projects, count(*) FILTER (status <> '{reconcile.COMPLETE}')::BIGINT AS problem_projects,
        (SELECT count(DISTINCT s_name) FROM supplier)::BIGINT AS actual_only_projects FROM report
    """,
)
def g2_report_summary(spark, sf_dir):
    """G2, J11."""
    found, folders = _reconciled(spark, sf_dir)
    return reconcile.summary(found, reconcile.unlisted(found, folders))


@query(
    "j8_missing_sizes",
    """
    SELECT s_suppkey, size::INTEGER AS p_size FROM supplier, range(1, 51) r(size)
    WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part p ON l_partkey = p_partkey WHERE l_suppkey = s_suppkey AND p.p_size = size AND l_quantity >= 45)
    """,
)
def j8_missing_sizes(spark, sf_dir):
    """Suppliers x the fifty sizes expected, large deliveries received."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    expected = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("p_size"))
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select("l_partkey", "l_suppkey")
    got = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("s_suppkey"), "p_size").distinct()
    return expected.join(got, ["s_suppkey", "p_size"], "left_anti")


@query(
    "j7_prefix_folders",
    """
    WITH w AS (SELECT DISTINCT p_name AS name FROM part), h AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS folder FROM part)
    SELECT name, (SELECT min(folder) FROM h WHERE starts_with(name, folder)) AS received FROM w
    """,
)
def j7_prefix_folders(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    want = part.select(F.col("p_name").alias("name")).distinct().select("name", F.col("name").alias("folder"), F.lit(0).alias("ord"))
    have = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("folder")).distinct().withColumn("folder_ord", F.col("folder"))
    return reconcile.match_received(want, have).select("name", "received")


@query("j3_folder_scores")
def j3_folder_scores(spark, sf_dir):
    """Part names linked to part types; held against difflib in the tests."""
    part = table(spark, sf_dir, "part")
    folders = part.groupBy(F.col("p_type").alias("folder")).agg(F.min("p_partkey").alias("folder_ord"))
    return match.match_folders(part.select(F.concat_ws(" ", "p_name", "p_type").alias("name")).distinct(), folders, PLAIN)


@query("j4_correct_names")
def j4_correct_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    folders = part.groupBy(F.col("p_type").alias("folder")).agg(F.min("p_partkey").alias("folder_ord"))
    noisy = part.select(F.concat(F.lit("no "), F.translate("p_type", "lE", "1F")).alias("name")).distinct()
    return match.correct_names(noisy, folders, PLAIN)


@query("s7_similarity")
def s7_similarity(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    return part.select("p_name", "p_type", similarity.fuzzy_similarity(F.col("p_name"), F.lower("p_type")).alias("ratio"))


@query(
    "g3_frequent_words",
    """
    WITH w AS (SELECT split_part(text, ' ', 1) AS word, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT count(*) AS n FROM documents)
    SELECT word, w.n::BIGINT AS n FROM w, t WHERE w.n >= greatest(2, floor(t.n * 0.01))
    """,
)
def g3_frequent_words(spark, sf_dir):
    """Counted vocabulary with a threshold on the share."""
    docs = table(spark, sf_dir, "documents")
    counts = docs.groupBy(F.split_part("text", F.lit(" "), F.lit(1)).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    return learn.frequent(counts.crossJoin(F.broadcast(total)), F.col("total"), 0.01, True).select("word", "n")  # one row


def _project_names(spark, sf_dir) -> DataFrame:
    """Project names as they are learned from, made of customers."""
    k = F.col("c_custkey")
    town = F.when(k % 2 == 0, "甲市").otherwise("乙省")
    place = F.when(k % 3 == 0, "丙县").when(k % 3 == 1, "丁区").otherwise("戊镇")
    work = F.when(k % 4 == 0, "10kV业扩配套工程").when(k % 4 == 1, "低压台区维修项目").when(k % 4 == 2, "线路改造项目12").otherwise("无关")
    name = F.concat(F.lit("2024年"), town, place, "c_mktsegment", work)
    return table(spark, sf_dir, "customer").select(name.alias("name"))


@query(
    "g3_region_counts",
    """
    WITH c AS (SELECT CASE c_custkey % 2 WHEN 0 THEN '甲市' ELSE '乙省' END AS a,
        CASE c_custkey % 3 WHEN 0 THEN '丙县' WHEN 1 THEN '丁区' ELSE '戊镇' END AS b FROM customer)
    SELECT word, count(*)::BIGINT AS n FROM (SELECT a AS word FROM c UNION ALL SELECT b FROM c UNION ALL SELECT a || b FROM c) GROUP BY word
    """,
)
def g3_region_counts(spark, sf_dir):
    """Region words at the start of each name, and their chains."""
    return learn.region_counts(_project_names(spark, sf_dir))


@query(
    "g4_suffix_counts",
    """
    SELECT CASE c_custkey % 4 WHEN 0 THEN '10kV业扩配套工程' WHEN 1 THEN '低压台区维修项目' ELSE '线路改造项目' END AS word, count(*)::BIGINT AS n
    FROM customer WHERE c_custkey % 4 < 3 GROUP BY 1
    """,
)
def g4_suffix_counts(spark, sf_dir):
    """The longest legal business suffix of each name."""
    return learn.suffix_counts(_project_names(spark, sf_dir))


_WORDS = ("the", "der", "ción", "que", "zzz")


@query(
    "g5_keywords",
    f"""
    WITH t AS (SELECT count(*) AS n FROM documents)
    SELECT w AS word, (SELECT count(*) FROM documents WHERE contains(text, w))::BIGINT AS n FROM (VALUES {", ".join(f"('{w}')" for w in _WORDS)}) k(w), t
    WHERE (SELECT count(*) FROM documents WHERE contains(text, w)) >= greatest(2.0, t.n * 0.03)
    """,
)
def g5_keywords(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("name"))
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    return learn.frequent(learn.keyword_counts(docs, _WORDS).crossJoin(F.broadcast(total)), F.col("total"), 0.03, False).select("word", "n")


@query(
    "g6_ordered_distinct",
    "SELECT trim(p_type) AS type, min(p_partkey) AS ord FROM part WHERE trim(p_type) <> '' GROUP BY 1",
)
def g6_ordered_distinct(spark, sf_dir):
    return reconcile.ordered_distinct(table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.col("p_partkey").alias("ord")), "type", "ord")


@query(
    "g8_conflicts",
    """
    SELECT 'all' AS pdf_id, c_mktsegment || c_nationkey AS matched_folder, count(*)::BIGINT AS n, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS starts
    FROM customer GROUP BY 2 HAVING count(*) > 1
    """,
)
def g8_conflicts(spark, sf_dir):
    """G8, G13."""
    matched = table(spark, sf_dir, "customer").select(
        F.lit("all").alias("pdf_id"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("matched_folder"), F.col("c_custkey").alias("start_page")
    )
    return segment.folder_conflicts(matched).withColumn("starts", F.array_join(F.col("starts").cast("array<string>"), ","))


@query(
    "g15_rules_signature",
    "SELECT substr(sha1(string_agg(n_name || '=>' || n_regionkey, '|' ORDER BY n_nationkey)), 1, 12) AS signature FROM nation",
)
def g15_rules_signature(spark, sf_dir):
    rule = F.struct(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("pattern"), F.col("n_regionkey").cast("string").alias("mapping"))
    return table(spark, sf_dir, "nation").agg(T.rules_signature(F.array_sort(F.collect_list(rule))).alias("signature"))


@query("w7_latest_records", "SELECT event_type AS kind, max(event_id) AS seq, arg_max(user_id, event_id) AS user_id FROM events GROUP BY 1")
def w7_latest_records(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type", "user_id")
    return journal.latest(events, "event_type").select("kind", "seq", "user_id")


@query("w8_keep_last", "SELECT event_id AS seq, event_type AS type FROM events ORDER BY event_id DESC LIMIT 20")
def w8_keep_last(spark, sf_dir):
    return journal.keep_last(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("type")))


@query(
    "w9_evicted",
    """
    WITH r AS (SELECT page_id, strlen(html) AS bytes, row_number() OVER (ORDER BY page_id DESC) AS place,
        sum(strlen(html)) OVER (ORDER BY page_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM pages)
    SELECT page_id, bytes::BIGINT AS bytes FROM r WHERE place > 200 OR total > 300000
    """,
)
def w9_evicted(spark, sf_dir):
    cache = table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"))
    return journal.evicted(cache, 200, 300_000, ["page_id"])


@query(
    "s22_cache_keys",
    "SELECT page_id, sha1('v1|' || lower(url) || '|' || strlen(html) || '|0|' || page_id || '|1.0|sig') AS cache_key FROM pages",
)
def s22_cache_keys(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.octet_length("html").alias("length"), F.timestamp_micros(F.lit(0)).alias("modificationTime"))
    return journal.page_cache_key(files, "page_id", 1.0, "sig").select("page_id", "cache_key")


@query("g14_cache_stats", "SELECT count(*)::BIGINT AS entries, sum(strlen(html))::BIGINT AS bytes FROM pages")
def g14_cache_stats(spark, sf_dir):
    return journal.cache_stats(table(spark, sf_dir, "pages").select(F.octet_length("html").cast("long").alias("bytes")))


@query(
    "a14_cache_misses",
    "SELECT page_id FROM pages WHERE page_id % 3 <> 0",
)
def a14_cache_misses(spark, sf_dir):
    """Pages whose entries are there, of this version and readable, are hits."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.md5("url").alias("u"), F.concat_ws("-", F.md5("url"), "page_id").alias("cache_key"))
    line = F.array(F.struct(F.lit(1.0).alias("y"), F.col("u").alias("text")))
    entries = journal.cache_entries(pages.select("page_id", "cache_key", F.lit("m").alias("mapping"), line.alias("rows"), F.lit(0).alias("angle")).filter("page_id % 3 <> 1"))
    stale = F.when(F.expr("cast(split_part(cache_key, '-', 2) as long) % 3") == 2, F.lit(0)).otherwise(F.col("v"))
    return journal.cached_pages(pages, entries.withColumn("v", stale))[1].select("page_id")


@query(
    "b7_rename_plan",
    """
    SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'no match' WHEN page_id % 5 = 0 THEN 'gone' WHEN page_id % 3 = 0 THEN 'empty mapping'
        WHEN page_id % 2 = 0 THEN 'unchanged' END AS skip_reason FROM pages
    """,
)
def b7_rename_plan(spark, sf_dir):
    k = F.col("page_id")
    results = table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("/root/a/"), F.when((k % 2 == 0), "x.pdf").otherwise("y.pdf")).alias("path"),
        F.when(k % 3 == 0, "").otherwise("x").alias("mapping"),
        F.when(k % 7 == 0, "no_match").otherwise("match").alias("status"),
        (k % 5 != 0).alias("exists"),
    )
    return journal.rename_plan(results).select("page_id", "skip_reason")


@query(
    "c12_split_targets",
    """
    SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '/r/未匹配项目/_前置页面' WHEN page_id % 4 = 1 THEN '/r/f' || page_id ELSE '/r/未匹配项目/p' || page_id END AS dir,
        CASE WHEN page_id % 4 = 1 THEN 'f' || page_id ELSE 'p' || page_id END || CASE WHEN page_id % 3 = 0 THEN '未识别标题' ELSE 'doc' END || '.pdf' AS file FROM pages
    """,
)
def c12_split_targets(spark, sf_dir):
    """C11, C12."""
    k = F.col("page_id")
    folder, name = F.when(k % 4 == 1, F.concat(F.lit("f"), k.cast("string"))), F.concat(F.lit("p"), k.cast("string"))
    mapping = F.when(k % 3 == 0, "").otherwise("doc")
    return table(spark, sf_dir, "pages").select(
        "page_id", segment.target_dir("/r", folder, name, k % 4 == 0).alias("dir"), segment.file_name(folder, name, mapping, True).alias("file")
    )


_TITLES = [
    (1, "配电网工程开工报告", "开工报告"), (2, "配电网工程峻工报告 实际开工时间", "开工报告"), (3, "配电网工程工报告", "开工报告"),
    (4, "申请开工", None), (5, "工作票", None), (6, "开工准备情况\n竣工验收", None), (7, "", "开工报告"),
]


@query(
    "c2_boundaries",
    "SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, true), (5, false), (6, false), (7, true)) t(page, boundary)",
)
def c2_boundaries(spark, sf_dir):
    """C2 to C5 on literal titles."""
    pages = spark.createDataFrame(_TITLES, "page int, text string, mapping string")
    lines = F.array(F.struct(F.lit(1.0).alias("y"), F.col("text")))
    return pages.select("page", segment.is_boundary(lines, F.col("mapping")).alias("boundary"))


_NAMES = [
    (1, "某省某市某县3225000000000004张三0.4kV业扩配套工程"),
    (2, "2026年某市某县乙镇某堤口2*配变低压合区维休项目3226000000000007"),
    (3, "工程名称：某县乙镇某堡变低压台区维修项目包3 建设单位"),
    (4, "甲县乙镇某楼南前片低压维修项目"),
    (5, "普通表格文字"),
    (6, ""),
]


@query(
    "n5_extract_names",
    """
    SELECT * FROM (VALUES (1, '某省某市某县张三0.4kV业扩配套工程'), (2, '2026年某市某县乙镇某堤口2#配变低压台区维修项目'), (3, '某县乙镇某堡变低压台区维修项目包3'),
        (4, '甲县乙镇某楼南前片低压维修项目'), (5, ''), (6, '')) t(id, name)
    """,
)
def n5_extract_names(spark, sf_dir):
    """N1 to N6, S17, S18, J13 on literal names."""
    config = Config(region_words=("某省", "某市", "某县"))
    return names.extract_names(spark.createDataFrame(_NAMES, "id int, text string"), config).select("id", "name")


@query(
    "t3_top_orders",
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5",
)
def t3_top_orders(spark, sf_dir):
    """Best few of each group."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return orders.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("o_custkey", "o_orderkey")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
