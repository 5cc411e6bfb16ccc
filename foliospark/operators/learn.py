"""Learning the name grammar from a column of real names: three counted vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.config import Config

# Words that business suffixes begin and end with, and the keywords that are counted.
HEADS = ("业扩", "配套", "低压", "高压", "台区", "线路", "维修", "维护", "改造", "新建", "配电", "电缆", "箱变", "工程", "项目")
TAILS = ("工程", "项目", "包N")
KEYWORDS = ("业扩", "配套工程", "维修", "维护", "改造", "新建", "台区")
LINK = r"^([一-龥]{1,5}?[省市区县镇乡村])"
MOST_WORDS = 50_000  # of a vocabulary: it becomes configuration; more are refused
# A legal suffix: perhaps a voltage, then 3 to 14 characters up to the end. A search finds the longest first, in one pass over the name.
SUFFIX = (
    rf"(?sU)(?=[\d{''.join(sorted({w[0] for w in HEADS}))}])(?:\d+(?:\.\d+)?\s*[kK][vV])?+"
    rf"(?={'|'.join(HEADS)})(?=.{{3,14}}\z)(?=.*(?:{'|'.join(TAILS)})\z)(?!.*\d{{5}}).+"
)


def region_chain(name: Column) -> Column:
    """Up to four region words in a row at a name's start, after a year."""
    rest = F.regexp_replace(F.substring(name, 1, 18), r"(?U)^20\d{2}年?", "")
    words = []
    for _ in range(4):
        word = F.regexp_extract(rest, LINK, 1)
        word = F.when(F.startswith(word, F.lit("年")), F.lit("")).otherwise(word)
        words.append(word)
        rest = F.when(word == "", F.lit("")).otherwise(F.substr(rest, F.length(word) + 1))
    return F.filter(F.array(*words), lambda w: w != "")


def region_counts(names: DataFrame) -> DataFrame:
    """word, n: each region word, and each name's whole chain."""
    chain = names.select(region_chain(F.col("name")).alias("c"))
    joined = F.when(F.size("c") >= 2, F.array(F.array_join("c", ""))).otherwise(F.array().cast("array<string>"))
    return chain.select(F.explode(F.concat("c", joined)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def business_suffix(name: Column) -> Column:
    """The longest legal suffix of a name, voltages in one spelling; null without one."""
    tail = F.regexp_replace(F.regexp_replace(name, r"(?U)\d+$", ""), r"(?U)包\d+$", "包N")
    part = F.regexp_extract(tail, SUFFIX, 0)
    spelled = F.regexp_replace(part, r"(?U)^(\d+(?:\.\d+)?\s*?)(?-U:\s*)[kK][vV]", "$1kV")
    return F.nullif(spelled, F.lit(""))


def suffix_counts(names: DataFrame) -> DataFrame:
    """word, n. Names without a suffix count nothing; a filter before the aggregate would search each name twice."""
    found = names.select(business_suffix(F.col("name")).alias("word"))
    return found.groupBy("word").agg(F.count("word").alias("n")).filter("n > 0")


def keyword_counts(names: DataFrame, keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """Names that hold each keyword: one pass with a counter a keyword."""
    counted = names.agg(*[F.count_if(F.contains("name", F.lit(w))).alias(f"k{i}") for i, w in enumerate(keywords)])
    pairs = F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"k{i}").alias("n")) for i, w in enumerate(keywords)])
    return counted.select(F.explode(pairs).alias("p")).select("p.*")


def frequent(counts: DataFrame, total: Column, share: float, whole: bool) -> DataFrame:
    """Counts at or above max(2, share of the total), cut to a whole number or not."""
    least = total * share
    least = F.floor(least).cast("double") if whole else least
    return counts.filter(F.col("n") >= F.greatest(F.lit(2.0), least))


def infer(names: DataFrame) -> dict[str, list[str]]:
    """Configuration overrides learned from ``name``; empty without names. What is collected is a grammar."""
    clean = names.select(F.trim(F.col("name").cast("string")).alias("name")).filter("name <> ''")
    total = clean.count()
    if not total:
        return {}
    order = [F.length("word").desc(), F.col("word")]

    def words(df: DataFrame, *by: Column) -> list[str]:
        found = df.orderBy(*by).select("word").limit(MOST_WORDS + 1).collect()
        if len(found) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} words")
        return [r["word"] for r in found]

    regions = words(frequent(region_counts(clean), F.lit(total), 0.05, True), *order)
    learned = words(suffix_counts(clean).filter("n >= 2"), *order)
    suffixes = sorted({*learned, *Config().business_suffixes}, key=lambda s: (-len(s), s))
    keywords = words(frequent(keyword_counts(clean), F.lit(total), 0.03, False), F.desc("n"), F.col("word"))
    found = {"region_words": regions, "business_suffixes": suffixes, "valid_keywords": keywords}
    return {k: v for k, v in found.items() if v}
