"""The composite analyses: rename and split, from recognised text to plans and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.operators import match, names, rows, rules, segment
from foliospark.operators.journal import cached_pages
from foliospark.operators.lineage import written

MOST_TITLE, MOST_ERROR = 40, 60
LABELS = {"match": "匹配", "no_match": "未匹配", "failed": "失败", "cancelled": "已取消"}


def classify_attempts(attempts: DataFrame, rule_table: DataFrame, config: Config | None = None, keys: tuple[str, ...] = ("pdf_id", "page")) -> DataFrame:
    """keys, mapping, rows, angle of each page: the first recognition attempt whose rows match a rule, else the fullest.

    attempts: keys, attempt_ord, rows, angle.
    """
    texts = attempts.withColumn("__text", rows.row_text(F.col("rows"), "\n"))
    matched = rules.match_titles(texts, rule_table, config, "__text").drop("__text")
    return rows.best_attempts(matched, list(keys))


def classify_cached(pages: DataFrame, cache: DataFrame, recognise, rule_table: DataFrame, config: Config | None = None) -> DataFrame:
    """Pages (pdf_id, page, cache_key) by the cache; only misses are recognised.

    ``recognise`` turns pages into attempts. A blank page (no text in any attempt) has no mapping.
    """
    hits, misses = cached_pages(pages, cache)
    fresh = classify_attempts(recognise(misses), rule_table, config)
    keyed = misses.select("pdf_id", "page", "cache_key").join(fresh, ["pdf_id", "page"])
    return hits.select(keyed.columns).unionByName(keyed)


def analyse_titles(attempts: DataFrame, rule_table: DataFrame, config: Config | None = None, by_folder: bool = False) -> DataFrame:
    """One row a file: status, title, mapping, new_name.

    attempts: path, stage (0: top of the page, 1: drawing corner), attempt_ord, rows, angle,
    error. The corner counts only where the top has no match; the longer text is shown.
    """
    texts = attempts.withColumn("__text", rows.row_text(F.col("rows"), "\n"))
    matched = rules.match_titles(texts, rule_table, config, "__text")
    hit = F.coalesce("mapping", F.lit("")) != ""
    order = F.struct("stage", "attempt_ord")
    grouped = matched.groupBy("path").agg(
        F.min_by("mapping", F.when(hit, order)).alias("mapping"),
        F.min_by("__text", F.when(hit, order)).alias("hit_text"),
        F.max_by("__text", F.struct(F.length("__text").alias("n"), (-F.col("stage")).alias("s"), (-F.col("attempt_ord")).alias("a"))).alias("long_text"),
        F.min_by("error", F.when(F.col("error").isNotNull(), order)).alias("error"),
        F.count_if(F.col("error").isNull()).alias("good"),
    )
    status = F.when(F.col("mapping").isNotNull(), "match").when(F.col("good") == 0, "failed").otherwise("no_match")
    return grouped.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("base_name"),
        status.alias("status"),
        F.coalesce("hit_text", "long_text").alias("title"),
        "mapping",
        F.when(F.col("mapping").isNotNull(), rules.new_file_name(F.col("mapping"), F.col("path"), by_folder)).alias("new_name"),
        F.when(status == "failed", F.col("error")).alias("error"),
    )


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def analyse_split(page_class: DataFrame, folders: DataFrame, root: str, config: Config | None = None, by_folder: bool = True) -> dict[str, DataFrame]:
    """projects, documents (with file_name, target_dir, unique_name), warnings and summary of classified pages.

    page_class: pdf_id, page, mapping, rows. folders: folder, folder_ord. The pages are
    shuffled once on the file; names and folders meet once a distinct name.
    """
    config = config or Config()
    boundary = segment.is_boundary(F.col("rows"), F.col("mapping"), config)
    docs = written(segment.documents(page_class, config))
    found = segment.projects(docs)
    mapped = F.coalesce(F.col("mapping"), F.lit("")) != ""
    numbered = segment.number_segments(page_class, "pdf_id", ["page"], boundary, mapped).filter("project_ord > 0")
    voted = written(names.vote(numbered, ["pdf_id", "project_ord"], config))
    named = found.join(voted, ["pdf_id", "project_ord"], "left").withColumn("name_raw", F.coalesce("name", F.lit(""))).drop("name")
    corrected = match.correct_names(written(named.withColumnRenamed("name_raw", "name")), folders, config)
    corrected = corrected.withColumnRenamed("name", "name_raw").withColumnRenamed("corrected", "name")
    linked = match.match_folders(written(corrected), folders, config)
    linked = linked.withColumn("matched_folder", F.when(~F.col("is_pre_pages"), F.col("matched_folder"))).withColumn("no_folder", F.col("matched_folder").isNull())
    linked = written(linked)
    pre_name = F.concat(F.lit(segment.PRE_TITLE + "_"), F.format_string("P%d-P%d", "page_start", "page_end"), F.lit(".pdf"))
    planned = docs.join(linked.select("pdf_id", "project_ord", "name", "matched_folder"), ["pdf_id", "project_ord"]).select(
        docs["*"],
        "name",
        "matched_folder",
        F.when(F.col("is_pre_pages"), pre_name)
        .otherwise(segment.file_name(F.col("matched_folder"), F.col("name"), F.col("mapping"), by_folder))
        .alias("file_name"),
        segment.target_dir(root, F.col("matched_folder"), F.col("name"), F.col("is_pre_pages")).alias("target_dir"),
    )
    documents = segment.unique_names(planned, "target_dir", "file_name", ["pdf_id", "page_start"])
    warnings = segment.warnings(linked)
    totals = documents.groupBy("pdf_id").agg(
        F.count(F.lit(1)).alias("total_docs"),
        F.coalesce(F.sum(F.when(F.col("is_pre_pages"), F.col("page_end") - F.col("page_start") + 1)), F.lit(0)).alias("pre_pages"),
    )
    counted = page_class.groupBy("pdf_id").agg(F.count(F.lit(1)).alias("page_count"))
    return {"projects": linked, "documents": documents, "warnings": warnings, "summary": counted.join(totals, "pdf_id")}


def preview_titles(results: DataFrame) -> DataFrame:
    """What a table of rename results shows: one line a title, labels for statuses."""
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return results.select(
        "base_name",
        label[F.col("status")].alias("status"),
        F.substring(F.translate(F.coalesce("title", F.lit("")), "\n", " "), 1, MOST_TITLE).alias("title"),
        F.coalesce("new_name", F.substring("error", 1, MOST_ERROR), F.lit("")).alias("result"),
    )


def preview_split(parts: dict[str, DataFrame]) -> DataFrame:
    """Project, document and warning lines in reading order; each warning once, after its file."""
    last = F.lit((1 << 31) - 1)
    projects = parts["projects"].select(
        "pdf_id", F.col("project_ord").cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit("project").alias("kind"),
        F.concat_ws(" ", F.coalesce("matched_folder", "name"), "page_range").alias("line"),
    )
    documents = parts["documents"].select(
        "pdf_id", F.col("project_ord").cast("long"), F.col("doc_ord").cast("long"), F.lit("document"), F.concat_ws(" ", "pages", "unique_name")
    )
    warned = parts["warnings"].select("pdf_id", last.cast("long"), F.lit(0).cast("long"), F.lit("warning"), F.concat_ws(" ", "kind", "detail"))
    return projects.union(documents).union(warned)


