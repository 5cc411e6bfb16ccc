"""Optional streaming form, an extension beyond the batch engine.

A directory of page rows is read as a stream; each micro-batch classifies only pages
that the cache table doesn't hold, and files whose pages have all arrived are cut into
documents with the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

PAGES = "pdf_id string, page int, page_count int, mapping string, rows array<struct<y:double,text:string>>"


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(PAGES).json(path)


def classify_stream(pages: DataFrame, classify: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Classify new pages of each micro-batch and append them to ``sink``; a batch that is replayed is overwritten."""

    def batch(df: DataFrame, epoch: int) -> None:
        classify(df.dropDuplicates(["pdf_id", "page"])).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return (
        pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def complete_files(spark: SparkSession, sink: str) -> DataFrame:
    """Pages of the files that have arrived whole."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet(sink).drop("epoch").dropDuplicates(["pdf_id", "page"])
    whole = pages.groupBy("pdf_id").agg(F.count(F.lit(1)).alias("n"), F.max("page_count").alias("of")).filter("n >= of")
    return pages.join(whole.select("pdf_id"), "pdf_id", "left_semi")
