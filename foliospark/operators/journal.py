"""Undo journal, page cache table, and the plans whose effects are separate steps."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators.rows import CORNERS, MOST_ROWS, ROW_TOLERANCE, TOPS
from foliospark.operators.rules import FUZZY_LEAST_LENGTH, FUZZY_THRESHOLD, Rule, new_file_name

KEEP = 20
TYPES = ("rename", "split")
JOURNAL = "seq long, time string, type string, items array<struct<old:string,new:string,dst:string>>"
CACHE_VERSION, MOST_ENTRIES, MOST_BYTES = 1, 2000, 2 << 20
ROWS = "array<struct<y:double,text:string>>"


def read_journal(spark, path: str) -> DataFrame:
    """Records of a JSON-lines journal; unreadable lines are skipped."""
    found = spark.read.schema(JOURNAL + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return found.filter("seq IS NOT NULL").drop("_bad")


def record_type(column: str = "type"):
    return F.when(F.col(column).isin(*TYPES), F.col(column)).otherwise(F.lit("rename"))


def keep_last(journal: DataFrame, keep: int = KEEP, order: str = "seq") -> DataFrame:
    """The last ``keep`` records: a top-k, not a global window."""
    return journal.orderBy(F.desc(order)).limit(keep)


def append(journal: DataFrame, records: DataFrame, keep: int = KEEP) -> DataFrame:
    return keep_last(journal.unionByName(records, allowMissingColumns=True), keep)


def latest(journal: DataFrame, by: str | None = None, order: str = "seq") -> DataFrame:
    """The latest record of each type."""
    kind = F.col(by) if by else record_type()
    whole = F.struct(*[F.col(c) for c in journal.columns])
    return journal.groupBy(kind.alias("kind")).agg(F.max_by(whole, order).alias("r")).select("kind", "r.*")


def undo_plan(journal: DataFrame, kind: str) -> DataFrame:
    """Steps that take back the latest record of a kind, in reverse order.

    Renames: move ``from_path`` to ``to_path``. Splits: delete ``from_path``.
    """
    last = latest(journal.withColumn("type", record_type())).filter(F.col("kind") == kind)
    steps = last.select("seq", F.posexplode("items").alias("pos", "item"))
    split = kind == "split"
    return steps.select(
        "seq",
        "pos",
        F.col("item.dst" if split else "item.new").alias("from_path"),
        (F.lit(None).cast("string") if split else F.col("item.old")).alias("to_path"),
    ).orderBy(F.desc("pos"))


def failed_items(journal: DataFrame, failures: DataFrame) -> DataFrame:
    """The journal after an undo: items that failed (seq, pos) stay, emptied records go."""
    items = journal.select("seq", F.posexplode("items").alias("pos", "item"))
    touched = failures.select("seq").distinct()
    kept = items.join(failures.select("seq", "pos"), ["seq", "pos"], "left_semi").groupBy("seq")
    kept = kept.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda s: s["item"]).alias("items"))
    rest = journal.join(touched, "seq", "left_anti")
    return rest.unionByName(journal.drop("items").join(kept, "seq").select(journal.columns))


def rename_plan(results: DataFrame, by_folder: bool = False) -> DataFrame:
    """What a rename would do: new_path, and why a row is skipped.

    results: path, mapping, status, exists.
    """
    name = new_file_name(F.col("mapping"), F.col("path"), by_folder)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    plan = results.withColumn("new_name", name).withColumn("new_path", F.concat_ws("/", folder, F.col("new_name")))
    reason = (
        F.when(F.col("status") != "match", "no match")
        .when(~F.col("exists"), "gone")
        .when(F.col("new_name") == "", "empty mapping")
        .when(F.col("new_path") == F.col("path"), "unchanged")
    )
    return plan.withColumn("skip_reason", reason)


def cache_entries(pages: DataFrame) -> DataFrame:
    """Entries to write: cache_key, v, mapping, payload (JSON), bytes; entries over the size limit are left out."""
    payload = F.to_json(F.struct("mapping", "rows", "angle"))
    made = pages.select("cache_key", F.lit(CACHE_VERSION).alias("v"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"))
    return made.filter(F.col("bytes") <= MOST_BYTES)


def cached_pages(pages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (with mapping, rows, angle) and misses of pages (cache_key, ...). Other versions and unreadable entries miss."""
    parsed = F.from_json("payload", f"mapping string, rows {ROWS}, angle int")
    good = cache.filter(F.col("v") == CACHE_VERSION).withColumn("e", parsed).filter("e.rows IS NOT NULL")
    good = good.select("cache_key", "e.*")
    return pages.join(good, "cache_key"), pages.join(good.select("cache_key"), "cache_key", "left_anti")


def evicted(cache: DataFrame, most: int = MOST_ENTRIES, most_bytes: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Entries to delete: the oldest until the bytes fit, then the oldest beyond the count.

    Running sums need one order over all entries; a cache holds few thousand.
    """
    newest = [F.desc(c) for c in (order or ["mtime", "cache_key"])]
    w = Window.orderBy(*newest)
    ranked = cache.withColumn("__place", F.row_number().over(w)).withColumn("__sum", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = F.col("__place") > most
    if most_bytes:
        over |= F.col("__sum") > most_bytes
    return ranked.filter(over).drop("__place", "__sum")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def progress(done: int, total: int, elapsed: float) -> float:
    """Seconds left at the pace so far."""
    return elapsed / done * (total - done) if done else 0.0


def parameter_signature(rules: list[Rule], **more: object) -> str:
    """What decides a page's class, in one string for its cache key: regions, tolerance, thresholds, rules, and more if given."""
    lines = "|".join(f"{r.key}=>{r.mapping}" for r in rules)
    own = {"tops": TOPS, "corners": CORNERS, "tolerance": ROW_TOLERANCE, "rows": MOST_ROWS, "fuzzy": FUZZY_THRESHOLD, "least": FUZZY_LEAST_LENGTH}
    own["rules"] = hashlib.sha1(lines.encode()).hexdigest()[:12]
    return json.dumps(own | more, sort_keys=True, ensure_ascii=False)


def page_cache_key(files: DataFrame, page: str, scale: float, signature: str) -> DataFrame:
    """binaryFile metadata with cache_key."""
    key = T.cache_key(F.col("path"), F.col("length"), F.col("modificationTime"), F.col(page), F.lit(scale), F.lit(signature))
    return files.withColumn("cache_key", key)
