"""Ordered pages into projects and documents: one shuffle on the file, two running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.functions import text as T
from foliospark.operators.rows import row_text

# What marks a completion or a commencement page.
COMPLETION = ("申请竣工", "申请峻工", "实际竣工", "实际峻工", "竣工验收", "峻工验收", "竣工报告", "峻工报告")
COMMENCEMENT = ("申请开工", "开工准备情况", "开工报告")
COMMENCEMENT_MAPPING, TAIL, TAIL_LEADS = "开工报告", "工报告", ("开", "竣")
UNTITLED, UNMATCHED, PRE_PAGES = "未识别标题", "未匹配项目", "_前置页面"
PRE_TITLE = "前置页面"


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def is_completion(text: Column) -> Column:
    return _contains_any(text, COMPLETION)


def is_commencement(text: Column) -> Column:
    return ~is_completion(text) & _contains_any(text, COMMENCEMENT)


def is_degraded(text: Column) -> Column:
    """The first tail of a title lacks the character that would tell the two kinds apart."""
    place = F.instr(text, TAIL)
    before = F.when(place > 1, T.at(text, place - 1, 1)).otherwise(F.lit(""))
    return (place > 0) & ~before.isin(*TAIL_LEADS)


def is_boundary(rows: Column, mapping: Column, config: Config | None = None) -> Column:
    """Whether a page opens a project; exclusion comes first."""
    text = T.apply_fixes(T.normalize_text(row_text(rows, "\n")), config or Config())
    by_mapping = (F.coalesce(mapping, F.lit("")) == COMMENCEMENT_MAPPING) & ~is_degraded(text)
    return F.when(is_completion(text), F.lit(False)).when(is_commencement(text), F.lit(True)).otherwise(by_mapping)


def number_segments(pages: DataFrame, key: str, order: list[str], boundary: Column, mapped: Column) -> DataFrame:
    """Append project_ord (0: before the first boundary) and doc_ord within the project.

    Both sums share one window, so the pages are shuffled and sorted once.
    """
    ordered = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = pages.withColumn("__b", boundary).withColumn("project_ord", F.sum(F.col("__b").cast("long")).over(ordered))
    starts = F.col("__b") | (mapped & (F.col("project_ord") > 0))
    numbered = numbered.withColumn("__d", F.sum(starts.cast("long")).over(ordered))
    # Documents before the project are the same for all of its pages: the first page's number.
    inside = Window.partitionBy(key, "project_ord")
    return numbered.withColumn("doc_ord", F.col("__d") - F.min("__d").over(inside)).withColumnRenamed("__b", "is_boundary").drop("__d")


def documents(pages: DataFrame, config: Config | None = None) -> DataFrame:
    """Documents of page_class rows (pdf_id, page, mapping, rows): every page is in exactly one."""
    mapped = F.coalesce(F.col("mapping"), F.lit("")) != ""
    numbered = number_segments(pages, "pdf_id", ["page"], is_boundary(F.col("rows"), F.col("mapping"), config), mapped)
    first = lambda c: F.min_by(c, "page")
    grouped = numbered.groupBy("pdf_id", "project_ord", "doc_ord").agg(
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
        first("mapping").alias("mapping"),
        first("is_boundary").alias("opens"),
        first(F.substring(row_text(F.col("rows")), 1, 40)).alias("title"),
    )
    return grouped.select(
        "pdf_id",
        "project_ord",
        "doc_ord",
        (F.col("project_ord") == 0).alias("is_pre_pages"),
        F.when(F.col("opens"), F.coalesce("mapping", F.lit(COMMENCEMENT_MAPPING)))
        .otherwise(F.coalesce("mapping", F.lit("")))
        .alias("mapping"),
        F.when(F.col("opens"), F.lit("")).otherwise(F.col("title")).alias("title"),
        "page_start",
        "page_end",
        T.page_label(F.col("page_start"), F.col("page_end")).alias("pages"),
    )


def projects(docs: DataFrame) -> DataFrame:
    """One row a project, from its documents."""
    return docs.groupBy("pdf_id", "project_ord").agg(
        F.first("is_pre_pages").alias("is_pre_pages"),
        F.min("page_start").alias("start_page"),
        F.max("page_end").alias("end_page"),
        F.count(F.lit(1)).alias("docs"),
        F.format_string("P%d-P%d", F.min("page_start"), F.max("page_end")).alias("page_range"),
    )


def file_name(folder: Column, name: Column, mapping: Column, by_folder: bool) -> Column:
    """Name of a split document: title, after the folder's or else the project's name if wanted."""
    title = T.sanitize_filename(F.coalesce(F.nullif(mapping, F.lit("")), F.lit(UNTITLED)))
    if not by_folder:
        return F.concat(title, F.lit(".pdf"))
    prefix = T.sanitize_filename(F.coalesce(F.nullif(folder, F.lit("")), name, F.lit("")))
    return F.concat(prefix, title, F.lit(".pdf"))


def target_dir(root: str, folder: Column, name: Column, pre_pages: Column) -> Column:
    """Where a split document goes."""
    other = F.concat_ws("/", F.lit(root), F.lit(UNMATCHED), F.coalesce(F.nullif(T.sanitize_filename(name), F.lit("")), F.lit(UNMATCHED)))
    return (
        F.when(pre_pages, F.concat_ws("/", F.lit(root), F.lit(UNMATCHED), F.lit(PRE_PAGES)))
        .when(F.coalesce(folder, F.lit("")) != "", F.concat_ws("/", F.lit(root), folder))
        .otherwise(other)
    )


def folder_conflicts(matched: DataFrame) -> DataFrame:
    """Folders that more than one project is matched to, with the projects' first pages."""
    grouped = matched.filter(F.coalesce("matched_folder", F.lit("")) != "").groupBy("pdf_id", "matched_folder")
    found = grouped.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("start_page")).alias("starts"))
    return found.filter("n > 1")


def warnings(matched: DataFrame) -> DataFrame:
    """pdf_id, kind, detail: unmatched projects, shared folders and pages before the first project."""
    own = matched.filter("NOT is_pre_pages")
    label = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.format_string("P%d", "start_page"))
    alone = own.filter("matched_folder IS NULL").select("pdf_id", F.lit("unmatched").alias("kind"), label.alias("detail"))
    shared = folder_conflicts(own).select("pdf_id", F.lit("conflict"), F.concat_ws(" ", "matched_folder", F.array_join(F.transform("starts", lambda p: F.format_string("P%d", p)), ",")))
    early = matched.filter("is_pre_pages").select("pdf_id", F.lit("pre_pages"), F.col("page_range"))
    return alone.union(shared).union(early)


def unique_names(files: DataFrame, directory: str, name: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Append unique_name: later files of a name get _1, _2, ... in plan order.

    Numbers already taken, by files that exist or that are planned under such a name, are
    skipped: the k-th repeat takes the k-th free number.
    """
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(F.col(name), r"(\.[^.]*)$", 1)
    split = files.withColumn("__stem", stem).withColumn("__ext", ext)
    place = F.row_number().over(Window.partitionBy(directory, name).orderBy(*order)) - 1
    taken = files.select(F.col(directory).alias("__dir"), F.col(name).alias("__name"))
    if existing is not None:
        taken = taken.unionByName(existing.select(F.col(directory).alias("__dir"), F.col(name).alias("__name")))
    numbers = (
        taken.distinct()
        .withColumn("__stem", F.regexp_replace("__name", r"(_\d+)?(\.[^.]*)?$", ""))
        .withColumn("__ext", F.regexp_extract("__name", r"(\.[^.]*)$", 1))
        .withColumn("__k", F.try_to_number(F.nullif(F.regexp_extract("__name", r"_(\d+)(\.[^.]*)?$", 1), F.lit("")), F.lit("999999999")).cast("int"))
        .groupBy("__dir", "__stem", "__ext")
        .agg(F.array_sort(F.collect_set("__k")).alias("__taken"))
    )
    ranked = split.withColumn("__r", place)
    if existing is not None:
        there = existing.select(F.col(directory), F.col(name), F.lit(1).alias("__there")).distinct()
        ranked = ranked.join(there, [directory, name], "left").withColumn("__r", F.col("__r") + F.coalesce("__there", F.lit(0))).drop("__there")
    joined = ranked.join(
        numbers, (F.col(directory) == F.col("__dir")) & ranked["__stem"].eqNullSafe(numbers["__stem"]) & ranked["__ext"].eqNullSafe(numbers["__ext"]), "left"
    ).drop(numbers["__stem"], numbers["__ext"], "__dir")
    free = F.get(F.array_except(F.sequence(F.lit(1), F.col("__r") + F.size(F.coalesce("__taken", F.array().cast("array<int>"))) + 1), F.coalesce("__taken", F.array().cast("array<int>"))), (F.col("__r") - 1).cast("int"))
    unique = F.when(F.col("__r") == 0, F.col(name)).otherwise(F.concat("__stem", F.lit("_"), free.cast("string"), "__ext"))
    return joined.withColumn("unique_name", unique).drop("__stem", "__ext", "__r", "__taken")
