"""Expected against received documents: missing, extra, misnamed, unlisted."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators.rules import MOST_RULES
from foliospark.operators.segment import PRE_TITLE, UNTITLED

DEFAULT_TYPES = ("开工报告", "竣工报告")
MISSING, EXTRA, MISNAMED, COMPLETE = "缺失", "多余", "命名不一致", "齐全"


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """First occurrence of each non-empty value."""
    clean = df.select(F.trim(value).alias(value), order).filter(F.col(value) != "")
    return clean.groupBy(value).agg(F.min(order).alias(order))


def types_from_templates(files: DataFrame, order: str = "ord") -> DataFrame:
    """Document types out of template file names."""
    kept = files.filter(F.lower("file").rlike(r"\.(xlsx|xls|docx)$"))
    name = F.regexp_replace("file", r"\.[^.]*$", "")
    for pattern in (r"(?U)^\d+[\.、]\s*", r"^带签字模板[-—]?", r"^模板[-—]?", r"带签字$"):
        name = F.regexp_replace(name, pattern, "")
    return ordered_distinct(kept.select(name.alias("type"), order), "type", order)


def required_types(rules: DataFrame | None, templates: DataFrame | None, spark) -> DataFrame:
    """type, ord: of the rules, then new ones of the templates; else the default."""
    parts = []
    if rules is not None:
        parts.append(rules.select(F.col("mapping").alias("type"), (F.col("rule_ord") * 2).cast("long").alias("ord")))
    if templates is not None:
        parts.append(types_from_templates(templates).select("type", (F.col("ord") + (1 << 40)).cast("long").alias("ord")))
    default = spark.createDataFrame([(t, (1 << 50) + i) for i, t in enumerate(DEFAULT_TYPES)], "type string, ord long")
    if not parts:
        return default
    own = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    own = ordered_distinct(own, "type", "ord")
    return own.unionByName(default.join(own.limit(1).select(F.lit(1).alias("__any")), F.lit(True), "left_anti"))


def _few(rows: DataFrame) -> list:
    """Rows of a configuration table; a local one is evaluated without a job. More than ``MOST_RULES`` are refused."""
    found = rows.limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rows of configuration")
    return found


def _aliases(rules: DataFrame) -> dict[str, tuple[str, str]]:
    """Key to canonical type and its key: a mapping names itself, the last rule wins; a pattern takes a key that is free."""
    canon = F.trim(F.coalesce("mapping", F.lit("")))
    kc, ks = T.normalize_compare(canon), T.normalize_compare(F.trim("pattern"))
    found: dict[str, tuple[str, str]] = {}
    for r in sorted(_few(rules.select("rule_ord", canon.alias("canon"), kc.alias("kc"), ks.alias("ks"))), key=lambda r: r["rule_ord"]):
        if r["canon"]:
            if r["kc"]:
                found[r["kc"]] = r["canon"], r["kc"]
            if r["ks"]:
                found.setdefault(r["ks"], (r["canon"], r["kc"]))
    return found


def _local(spark, names: list[str], types: list[pa.DataType], rows: list[tuple]) -> DataFrame:
    """A local relation: its size is known when joins are planned."""
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return spark.createDataFrame(pa.table({n: pa.array(c, t) for n, t, c in zip(names, types, columns, strict=True)}))


def alias_map(rules: DataFrame) -> DataFrame:
    """key, canon of each spelling that rules name."""
    rows = [(k, canon) for k, (canon, _) in _aliases(rules).items()]
    return _local(rules.sparkSession, ["key", "canon"], [pa.string()] * 2, rows)


def file_type(stem: Column, folder: Column) -> Column:
    """A file's document type: its stem without the project's name."""
    target = F.length(T.normalize_compare(folder))
    dropped = F.lit(T.COMPARE_MARKS + T.SPACES)
    counted = F.filter(T.upto(F.length(stem)), lambda i: F.call_function("instr", dropped, T.at(stem, i, 1)) == 0)
    rest = F.trim(F.substr(stem, F.get(counted, target - 1) + 1))
    whole = T.normalize_compare(stem)
    starts = (target > 0) & (F.length(whole) > target) & F.startswith(whole, T.normalize_compare(folder))
    own = F.when(starts, F.coalesce(F.nullif(rest, F.lit("")), stem)).otherwise(stem)
    return F.when(F.startswith(own, F.lit(UNTITLED)), UNTITLED).when(F.startswith(own, F.lit(PRE_TITLE)), PRE_TITLE).otherwise(F.trim(own))


def match_received(expected: DataFrame, folders: DataFrame) -> DataFrame:
    """expected (name, folder, ord) with received (or null): the equal folder, else the first that is a prefix either way.

    folders: folder, folder_ord. Equality is a hash join; only what it leaves meets the
    prefix test, and there through every prefix of the longer side as a key, so that is
    a hash join too.
    """
    have = folders.select(F.col("folder").alias("received"), "folder_ord", T.normalize_compare(F.col("folder")).alias("ak"))
    want = expected.withColumn("ek", T.normalize_compare(F.coalesce(F.nullif("folder", F.lit("")), "name")))
    first = have.groupBy("ak").agg(F.min(F.struct("folder_ord", "received")).alias("f")).select("ak", "f.*")
    exact = want.join(first.withColumnRenamed("ak", "ek"), "ek", "left")
    done = exact.filter("received IS NOT NULL OR ek = ''").select(*want.columns, "received", "folder_ord")
    left = exact.filter("received IS NULL AND ek <> ''").select(*want.columns)
    prefixes = lambda c: F.transform(T.upto(F.length(c)), lambda i: F.col(c).substr(F.lit(1), i))
    shorter = left.withColumn("p", F.explode(prefixes("ek"))).join(have.filter("ak <> ''").withColumnRenamed("ak", "p"), "p")
    longer = left.join(have.withColumn("p", F.explode(prefixes("ak"))), F.col("ek") == F.col("p"))
    near = shorter.select("ek", "received", "folder_ord").unionByName(longer.select("ek", "received", "folder_ord"))
    near = near.groupBy("ek").agg(F.min(F.struct("folder_ord", "received")).alias("f")).select("ek", "f.*")
    return done.unionByName(left.join(near, "ek", "left").select(*want.columns, "received", "folder_ord")).drop("ek")


def report(
    projects: DataFrame, types: DataFrame, files: DataFrame, folders: DataFrame, rules: DataFrame
) -> DataFrame:
    """One row a project: required, actual, missing, extra, mismatch (arrays) and status.

    projects: name, ord. types: type, ord. files: folder, file. folders: folder, folder_ord.
    Types and rules are configuration: they reach files as two small lookup tables, so a
    file's verdict is row-wise. Files meet their projects once and are grouped by project
    once, first by type within it.
    """
    spark = projects.sparkSession
    aliases = _aliases(rules)
    asked = [(r["ord"], r["type"], r["key"]) for r in _few(types.filter("type <> ''").select("ord", "type", T.normalize_compare(F.col("type")).alias("key")))]
    asked.sort(key=lambda t: t[:2])
    kinds: dict[str, tuple[int, str]] = {}  # canonical key to place and spelling of the first type with it
    for i, (_, kind, key) in enumerate(asked):
        kinds.setdefault(aliases[key][1] if key in aliases else key, (i, kind))
    known = sorted({*kinds, *aliases, *(k for _, k in aliases.values())})
    known = _local(spark, ["ns", "known"], [pa.string(), pa.bool_()], [(k, True) for k in known])
    listed = [(k, *aliases.get(k, (None, k))) for k in {*aliases, *kinds}]
    listed = _local(spark, ["own", "canon", "key", "asked"], [pa.string()] * 3 + [pa.bool_()], [(*x, x[2] in kinds) for x in sorted(listed)])
    wanted = ordered_distinct(projects, "name", "ord").withColumn("folder", F.col("name"))
    matched = match_received(wanted, folders.select("folder", "folder_ord"))
    got = matched.join(files.select(F.col("folder").alias("received"), "file"), "received", "left")
    got = got.withColumn("stem", F.nullif(F.regexp_replace("file", r"\.[^.]*$", ""), F.lit("")))
    got = got.withColumn("type", file_type(F.col("stem"), F.col("received"))).withColumn("ns", T.normalize_compare(F.col("stem")))
    got = got.withColumn("own", T.normalize_compare(F.col("type"))).join(F.broadcast(known), "ns", "left").join(F.broadcast(listed), "own", "left")
    own = T.normalize_compare(F.col("folder"))
    named = F.coalesce(F.startswith("ns", own) & (own != ""), F.lit(False)) | F.coalesce("known", F.lit(False))
    good = F.col("stem").isNotNull() & named & (F.col("type") != "")
    got = got.select(
        "name", "folder", "ord", "received",
        F.when(good, F.coalesce("key", "own")).alias("key"),
        F.when(good, F.struct("file", F.coalesce("canon", "type").alias("canon"), F.coalesce("asked", F.lit(False)).alias("asked"))).alias("good"),
        F.when(F.col("stem").isNotNull() & ~named, F.col("file")).alias("wrong"),
    )
    # By type first: what is shuffled is one row a type and map task, however many files a project has.
    project = ["name", "folder", "ord", "received"]
    kept = got.groupBy(*project, "key").agg(F.min("good").alias("good"), F.collect_list("wrong").alias("wrong"))
    lists = kept.groupBy(*project).agg(
        F.array_sort(F.collect_list("good")).alias("good"),
        F.collect_set("key").alias("keys"),
        F.array_sort(F.flatten(F.collect_list("wrong"))).alias("mismatch"),
    )
    ordered = sorted((place, key, kind) for key, (place, kind) in kinds.items())
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    places = constant([{"key": k, "type": t} for _, k, t in ordered], "array<struct<key:string,type:string>>")
    out = lists.select(
        *project,
        constant([t for _, t, _ in asked], "array<string>").alias("required"),
        F.transform("good", lambda g: g["canon"]).alias("actual"),
        F.transform(F.filter(places, lambda k: ~F.array_contains("keys", k["key"])), lambda k: k["type"]).alias("missing"),
        F.transform(F.filter("good", lambda g: ~g["asked"]), lambda g: g["canon"]).alias("extra"),
        "mismatch",
    )
    status = (
        F.when(F.size("missing") > 0, MISSING)
        .when(F.size("mismatch") > 0, MISNAMED)
        .when(F.size("extra") > 0, EXTRA)
        .otherwise(COMPLETE)
    )
    return out.withColumn("status", status)


def unlisted(report_rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Received folders that no project uses; those of pages before the first project apart."""
    used = report_rows.select(F.col("received").alias("folder")).filter("folder IS NOT NULL").distinct()
    return folders.filter("NOT is_pre_pages").join(used, "folder", "left_anti")


def unlisted_files(unlisted_rows: DataFrame, files: DataFrame) -> DataFrame:
    """folder, files (sorted) of each unlisted folder."""
    got = unlisted_rows.select("folder").join(files.select("folder", "file"), "folder", "left")
    return got.groupBy("folder").agg(F.array_sort(F.collect_list("file")).alias("files"))


def summary(report_rows: DataFrame, unlisted_rows: DataFrame) -> DataFrame:
    """One row of totals; zeros for an empty report."""
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    own = report_rows.agg(
        F.count(F.lit(1)).alias("projects"),
        total("required").alias("required_total"),
        total("actual").alias("actual_total"),
        total("missing").alias("missing_total"),
        total("extra").alias("extra_total"),
        total("mismatch").alias("mismatch_total"),
        F.count_if(F.col("status") == COMPLETE).alias("ok_projects"),
        F.count_if(F.col("status") != COMPLETE).alias("problem_projects"),
    )
    return own.crossJoin(unlisted_rows.agg(F.count(F.lit(1)).alias("actual_only_projects")))


def problems(report_rows: DataFrame) -> DataFrame:
    """Long form: one row a problem (name, ord, kind, detail)."""
    parts = F.array(*[
        F.struct(F.lit(i).alias("k"), F.lit(kind).alias("kind"), F.col(c).alias("items"))
        for i, (kind, c) in enumerate(((MISSING, "missing"), (EXTRA, "extra"), (MISNAMED, "mismatch")))
    ])
    exploded = report_rows.select("name", "ord", F.explode(parts).alias("p"))
    return exploded.select("name", "ord", F.col("p.k").alias("k"), F.col("p.kind").alias("kind"), F.posexplode("p.items").alias("pos", "detail"))


