"""Linking extracted names to reference folders, and repairing names by them.

Distinct names meet every folder: that is the operator. Folder lists are sent to the
tasks in blocks of at most ``FOLDERS_A_BLOCK``, each block a row that names are scored
against inside one Arrow batch, so no pair is ever a row and memory stays bounded. The
best folder of a name is then one aggregate over its blocks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.functions import text as T
from foliospark.functions.similarity import folder_score

FOLDERS_A_BLOCK = 2000
MOST_FOLDERS = 100_000  # folders are a directory listing; more are refused
BEST = "folder string, folder_ord long, score double, kind int"


def _blocks(folders: DataFrame, config: Config) -> list[list[tuple]]:
    """Folders as driver-side blocks; they are a directory listing."""
    std = T.normalize_text(F.col("folder"))
    rows = folders.select("folder_ord", "folder", std.alias("std"), T.feature_key(F.col("folder"), config).alias("key"))
    found = sorted((r["folder_ord"], r["folder"], r["std"], r["key"]) for r in rows.filter("std <> ''").limit(MOST_FOLDERS + 1).collect())
    if len(found) > MOST_FOLDERS:
        raise ValueError(f"more than {MOST_FOLDERS} folders")
    return [found[a : a + FOLDERS_A_BLOCK] for a in range(0, len(found), FOLDERS_A_BLOCK)]


def _best(std: Column, key: Column, block: list[tuple], config: Config, template: bool) -> Column:
    """Best folder of one block. ``template``: the first folder that contains the name wins outright."""

    def one(name: str, feature: str) -> tuple:
        best = (None, None, 0.0, 0)
        for order, folder, target, target_key in block:
            if template and target == name:
                return (folder, order, 1.0, 2)
            if template and name in target:
                return (folder, order, 1.0, 1) if not any(t == name for o, _, t, _ in block if o < order) else best
            score = folder_score(name, target, feature, target_key, config)
            if score > best[2]:
                best = (folder, order, score, 0)
        return best

    def run(names: pd.Series, features: pd.Series) -> pd.DataFrame:
        rows = [one(n, f) if n else (None, None, 0.0, 0) for n, f in zip(names, features, strict=True)]
        frame = pd.DataFrame(rows, columns=["folder", "folder_ord", "score", "kind"])
        return frame.astype({"folder_ord": "Int64", "score": "float64", "kind": "int32"})

    return F.pandas_udf(run, BEST).asNondeterministic()(std, key)  # once a distinct name: no filter may move below it


def _ranked(names: DataFrame, folders: DataFrame, config: Config, template: bool) -> DataFrame:
    """name, best: over all blocks the strongest kind, then the score, then the first folder."""
    std = T.normalize_text(F.col("name"))
    distinct = names.select("name").distinct().select("name", std.alias("std"), T.feature_key(F.col("name"), config).alias("key"))
    out = distinct
    columns = []
    for i, block in enumerate(_blocks(folders, config)):
        out = out.withColumn(f"b{i}", _best(F.col("std"), F.col("key"), block, config, template))
        columns.append(F.col(f"b{i}"))
    if not columns:
        return distinct.select("name", "std", F.lit(None).cast(f"struct<{BEST}>".replace(" string", ":string").replace(" long", ":bigint").replace(" double", ":double").replace(" int", ":int")).alias("best"))
    found = F.filter(F.array(*columns), lambda b: b["folder"].isNotNull())
    if template:
        # Whatever comes first in order ends the search: an equal or a containing folder.
        stops = F.filter(found, lambda b: b["kind"] > 0)
        first = F.array_sort(F.transform(stops, lambda b: F.struct(b["folder_ord"].alias("o"), b.alias("b"))))
        chosen = F.get(first, F.lit(0))["b"]
    else:
        chosen = F.lit(None)
    ranked = F.array_sort(F.transform(found, lambda b: F.struct((-b["score"]).alias("s"), b["folder_ord"].alias("o"), b.alias("b"))))
    return out.select("name", "std", F.coalesce(chosen, F.get(ranked, F.lit(0))["b"]).alias("best"))


def match_folders(names: DataFrame, folders: DataFrame, config: Config | None = None) -> DataFrame:
    """names with matched_folder (null below the threshold) and matched_score (of the best folder)."""
    config = config or Config()
    best = _ranked(names, folders, config, False)
    good = F.col("best.score") >= config.folder_score_threshold
    found = best.select(
        "name",
        F.when(good, F.col("best.folder")).alias("matched_folder"),
        F.coalesce("best.score", F.lit(0.0)).alias("matched_score"),
    )
    return names.join(found, "name", "left")


def correct_names(names: DataFrame, folders: DataFrame, config: Config | None = None) -> DataFrame:
    """names with corrected and corrected_by: characters of the best folder's name put where the name differs.

    A name that equals a folder (or it without its code) stays; a repair is kept only if
    the score against that folder does not fall.
    """
    config = config or Config()
    best = _ranked(names, folders, config, True).filter("best IS NOT NULL AND best.folder IS NOT NULL AND std <> ''")
    variants = T.template_variants(F.col("best.folder"))
    tried = best.select("name", "std", "best", F.posexplode(variants).alias("v", "template"))
    # An equal template ends the attempts, so later ones don't count.
    tried = tried.withColumn("fixed", T.aligned_replace(F.col("std"), F.col("template")))
    scored = tried.withColumn("target", T.normalize_text(F.col("best.folder"))).withColumn(
        "new_score",
        _pair_score(config)(
            F.col("fixed"), F.col("target"), T.feature_key(F.col("fixed"), config), T.feature_key(F.col("target"), config)
        ),
    )
    usable = (F.col("fixed") != F.col("std")) & (F.col("new_score") >= F.col("best.score")) & (F.col("best.kind") < 2)
    first = scored.groupBy("name").agg(
        F.min(F.when(F.col("template") == F.col("std"), F.col("v"))).alias("stop"),
        F.min(F.when(usable, F.struct("v", "fixed", F.col("best.folder").alias("folder")))).alias("hit"),
    )
    kept = F.col("hit").isNotNull() & (F.col("stop").isNull() | (F.col("hit.v") < F.col("stop")))
    fixes = first.filter(kept).select("name", F.col("hit.fixed").alias("fixed"), F.col("hit.folder").alias("corrected_by"))
    return names.join(fixes, "name", "left").withColumn("corrected", F.coalesce("fixed", "name")).drop("fixed")


def _pair_score(config: Config):
    def run(a: pd.Series, b: pd.Series, ka: pd.Series, kb: pd.Series) -> pd.Series:
        return pd.Series([folder_score(*x, config) for x in zip(a, b, ka, kb, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double").asNondeterministic()
