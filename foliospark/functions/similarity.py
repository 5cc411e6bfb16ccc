"""Ratcliff-Obershelp similarity as an Arrow UDF, and scores built on it."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.config import Config


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """Similarity of two strings, argument order kept; 0 as soon as it can't reach ``least``."""
    if not a or not b:
        return 0.0
    matcher = SequenceMatcher(None, a, b)
    if least and (matcher.real_quick_ratio() < least or matcher.quick_ratio() < least):
        return 0.0
    return matcher.ratio()


def fuzzy_similarity(a: Column, b: Column) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def longest_common(a: str, b: str) -> int:
    return SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size


def feature_score(name: str, folder: str) -> float:
    if not name or not folder:
        return 0.0
    if name in folder or folder in name:
        return 1.0
    return max(longest_common(name, folder) / min(len(name), len(folder)), ratio(name, folder))


def equivalent(a: str, b: str, tolerance: int) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= tolerance
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) <= tolerance and short in long


def folder_score(name: str, folder: str, name_key: str, folder_key: str, config: Config) -> float:
    """Score of a name against a folder, all normalised; the keys are their features."""
    if not name or not folder:
        return 0.0
    if folder in name:
        score = 1.0
    elif name in folder:
        score = 0.95
    else:
        whole = max(longest_common(name, folder) / len(folder), 0.9 * ratio(name, folder))
        feature = 0.0
        if min(len(name_key), len(folder_key)) >= config.feature_min_len:
            feature = feature_score(name_key, folder_key)
            feature = feature if feature >= config.feature_score_threshold else 0.0
        score = max(whole, feature)
    if config.code_match_enabled:
        mine, theirs = (set(re.findall(r"\d{10,}", x)) for x in (name, folder))
        if mine and theirs:
            if any(equivalent(a, b, config.code_fuzzy_tolerance) for a in mine for b in theirs):
                return min(1.0, score + config.code_match_bonus)
            return score * config.code_mismatch_penalty
    return score
