"""Titles against an ordered table of rules: strict containment by line, then fuzzy windows.

Rules are configuration: at most ``MOST_RULES`` are carried in the plan as a literal, so
matching is row-wise and needs no join, no shuffle and no second pass for titles without
a match. More rules than that are refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.functions import text as T
from foliospark.functions.similarity import ratio

MOST_RULES = 5000
FUZZY_LEAST_LENGTH = 4
FUZZY_THRESHOLD = 0.70
# The rules that a first run starts with (pattern, mapping).
DEFAULT_RULES = [
    ("配电网工程开工报告", "开工报告"),
    ("配电网工程竣工报告", "竣工报告"),
    ("架空配电线路安装施工记录", "架空配电线路安装施工记录"),
    ("接地装置接地电阻测试报告", "接地电阻测试报告"),
    ("竣工图", "竣工图纸"),
]


@dataclass(frozen=True)
class Rule:
    order: int
    key: str
    mapping: str


def threshold(length: int) -> float:
    """Short keys need to be closer."""
    return 0.85 if length < 5 else 0.78 if length < 7 else FUZZY_THRESHOLD


def prepare(rules: DataFrame, config: Config) -> list[Rule]:
    """Rules (rule_ord, pattern, mapping) with keys normalised once."""
    key = T.normalize_text(T.apply_fixes(F.col("pattern"), config))
    rows = rules.select("rule_ord", key.alias("key"), F.trim(F.coalesce("mapping", F.lit(""))).alias("mapping"))
    found = rows.filter("key <> ''").limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return sorted((Rule(r["rule_ord"], r["key"], r["mapping"]) for r in found), key=lambda r: r.order)


def strict_mapping(title: Column, rules: list[Rule]) -> Column:
    """Mapping of the first line that contains a key; the longest key, then the first rule."""
    ranked = sorted(rules, key=lambda r: (-len(r.key), r.order))
    table = F.array(*[F.struct(F.lit(r.key).alias("key"), F.lit(r.mapping).alias("mapping")) for r in ranked])
    lines = F.transform(T.split_lines(title), lambda line: T.normalize_text(line))
    hits = F.transform(lines, lambda line: F.get(F.filter(table, lambda r: F.contains(line, r["key"])), F.lit(0)))
    return F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0))["mapping"]


def best_fuzzy(title: str, rules: list[Rule]) -> str | None:
    """Mapping of the closest rule: score, then key length, then order. Windows move by a quarter of the key."""
    best, mapping = (0.0, 0), None
    for rule in rules:
        size = len(rule.key)
        if size < FUZZY_LEAST_LENGTH:
            continue
        least = max(threshold(size), best[0])
        if len(title) < size:
            score = ratio(title, rule.key, least)
        else:
            score = 0.0
            for a in range(0, len(title) - size + 1, max(1, size // 4)):
                score = max(score, ratio(title[a : a + size], rule.key, max(least, score)))
                if score >= 1.0:
                    break
        if score >= threshold(size) and (score, size) > best:
            best, mapping = (score, size), rule.mapping
    return mapping


def fuzzy_mapping(title: Column, rules: list[Rule]) -> Column:
    """Null titles (those that need no fuzzy match) cost nothing."""

    def run(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: best_fuzzy(t, rules) if t else None).astype(object)

    return F.pandas_udf(run, "string")(title)


def matcher(rules: list[Rule], config: Config) -> Callable[[str], str | None]:
    """The match of ``match_titles`` on one text, for loops that stop at the first hit."""
    ranked = sorted(rules, key=lambda r: (-len(r.key), r.order))
    breaks = re.compile(T.LINE_BREAK)

    def mapping(text: str) -> str | None:
        for wrong, right in config.fixes:
            text = text.replace(wrong, right)
        for line in map(T.plain_text, breaks.split(text)):
            for rule in ranked:
                if rule.key in line:
                    return rule.mapping
        plain = T.plain_text(text)
        return best_fuzzy(plain, rules) if plain else None

    return mapping


def match_titles(
    titles: DataFrame, rules: DataFrame, config: Config | None = None, text_col: str = "text", fuzzy: bool = True
) -> DataFrame:
    """titles with ``mapping``, null where no rule fits."""
    config = config or Config()
    table = prepare(rules, config)
    if not table:
        return titles.withColumn("mapping", F.lit(None).cast("string"))
    fixed = T.apply_fixes(F.coalesce(F.col(text_col), F.lit("")), config)
    out = titles.withColumn("__fixed", fixed).withColumn("mapping", strict_mapping(F.col("__fixed"), table))
    if fuzzy:
        open_title = F.when(F.col("mapping").isNull(), T.normalize_text(F.col("__fixed")))
        out = out.withColumn("mapping", F.coalesce("mapping", fuzzy_mapping(open_title, table)))
    return out.drop("__fixed")


def new_file_name(mapping: Column, path: Column, by_folder: bool) -> Column:
    """mapping.pdf, or folder + mapping.pdf; '' without a mapping."""
    clean = T.sanitize_filename(mapping)
    folder = T.sanitize_filename(F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit("")))
    name = F.concat(folder, clean, F.lit(".pdf")) if by_folder else F.concat(clean, F.lit(".pdf"))
    return F.when(clean == "", F.lit("")).otherwise(name)


def edit(rules: DataFrame, upserts: DataFrame | None = None, deletes: list[int] | None = None) -> DataFrame:
    """Rules after updates and additions by rule_ord, and deletions; keyless rules go."""
    out = rules
    if upserts is not None:
        out = out.join(upserts.select("rule_ord"), "rule_ord", "left_anti").unionByName(upserts)
    if deletes:
        out = out.filter(~F.col("rule_ord").isin(deletes))
    return out.filter(F.trim(F.coalesce("pattern", F.lit(""))) != "")
