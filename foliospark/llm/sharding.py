"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled by a seeded hash and ranked inside their source; a row's
fractional rank (rank - 1/2) / rows-of-source places it on [0, 1). Sorting by it
spreads every source evenly, so equal cuts of the order all carry the same
mixture. Law: shard row counts differ by one at most.

No window spans a whole source or the whole table. A rank is the sum of an offset
of its bucket and a row number inside the bucket; buckets are equal slices of the
hash (first sort) and of the fractional rank (second sort), both uniform by
construction, so a source that holds a third of all rows is many buckets. A bucket that
one id (or null) fills to ``HEAVY`` times its share is cut once more, by a hash of
the row's number in the table, which is written first so that it stays. Bucket
counts are about the square root of the rows, so the offsets' own windows stay
small too.

Defined cases: null text counts no bytes (its checksum is that of the empty
text); a null source is a stratum of its own; null and repeated ids are ids that many rows
have; repeated rows are told apart only by their values, so equal rows trade places
without changing the result; an empty table gives an empty result; columns other than
those named are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.scratch import Scratch

HEAVY = 4  # times a bucket's share
HASH_SPACE = 1 << 48  # the seeded hash is the first 12 hex digits of an MD5


def seeded_hash(seed: int, key: Column) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def _offsets(counts: DataFrame, strata: list[str], bucket: list[str]) -> DataFrame:
    """Rows in earlier buckets of the same stratum, and in the stratum."""
    before = Window.partitionBy(*strata).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *strata,
        *bucket,
        "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy(*strata)).alias("of"),
    )


def bucketed(rows: DataFrame, buckets: int, share: int) -> DataFrame:
    """Rows (stratum, h, u) with hb, their slice of the hash, and cut and v: parts of heavy slices, in which v orders rows."""
    placed = rows.withColumn("hb", F.floor(F.col("h") / F.lit(HASH_SPACE // buckets + 1)).cast("long"))
    counts = placed.groupBy("stratum", "hb").agg(F.count(F.lit(1)).alias("n"))
    # A quarter of the buckets at most, and none where ids are unique.
    heavy = counts.filter(F.col("n") > HEAVY * share).select("stratum", "hb", F.ceil(F.col("n") / share).alias("cuts"))
    placed = placed.join(F.broadcast(heavy), ["stratum", "hb"], "left")
    v = F.when(F.col("cuts").isNotNull(), F.xxhash64("u"))
    return placed.withColumn("v", v).withColumn("cut", F.coalesce(F.pmod("v", "cuts"), F.lit(0))).drop("cuts")


def interleave(
    docs: DataFrame,
    shards: int,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Shard, slot and size of each row: doc_id, source, size, text_crc32, pos, shard, slot."""
    text = F.col(text_col).cast("binary")
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.put(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("stratum"),
            F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
            seeded_hash(seed, F.col(id_col)).alias("h"),
            F.monotonically_increasing_id().alias("u"),
        )
    )
    total = rows.count()
    # Uniform buckets: their number fixes how many rows one window holds.
    share = max(2048, math.isqrt(total))
    buckets = max(1, math.ceil(total / share))
    rows = bucketed(rows, buckets, share)
    counts = rows.groupBy("stratum", "hb", "cut").agg(F.count(F.lit(1)).alias("n"))
    offsets = scratch.put(_offsets(counts, ["stratum"], ["hb", "cut"]))
    # floor(buckets * (2 rank - 1) / (2 of)) in whole numbers: no rounding anywhere.
    slice_of = F.expr(f"((2 * rank - 1) * {buckets}L) div (2 * of)")
    inside = Window.partitionBy("stratum", "hb", "cut").orderBy("v", "h", "doc_id", "text_crc32", "size")
    ranked = (
        rows.withColumn("r", F.row_number().over(inside))
        .join(offsets, ["stratum", "hb", "cut"])
        .select("doc_id", "stratum", "size", "text_crc32", (F.col("before") + F.col("r")).alias("rank"), "of")
        .withColumn("fb", slice_of)
    )
    # A bucket's ranks are before+1 .. before+n, so the second sort's bucket sizes
    # follow from the first one's offsets without another pass over the texts.
    spread = (
        offsets.select("of", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("rank"))
        .groupBy(slice_of.alias("fb"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("all", F.lit(0))
    )
    place = Window.partitionBy("fb").orderBy((2 * F.col("rank") - 1) / (2 * F.col("of")), "stratum", "rank")
    cut = F.expr(f"(pos * {shards}L) div {max(total, 1)}L")
    return (
        ranked.withColumn("r", F.row_number().over(place))
        .join(_offsets(spread, ["all"], ["fb"]).select("fb", "before"), "fb")
        .withColumn("pos", F.col("before") + F.col("r") - 1)
        .withColumn("shard", cut.cast("int"))
        # The first position of shard s is ceil(s * total / shards).
        .withColumn("slot", F.expr(f"pos - (shard * {total}L + {shards - 1}L) div {shards}L"))
        .select(
            "doc_id",
            F.when(F.col("stratum") == "", F.lit(None)).otherwise(F.substring("stratum", 2, 1 << 30)).alias("source"),
            "size",
            "text_crc32",
            "pos",
            "shard",
            "slot",
        )
    )
