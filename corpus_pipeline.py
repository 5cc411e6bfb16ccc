"""From raw documents to token ids: five stages, each over all that the one before kept.

Stages get (spark, docs, sf_dir) and return a DataFrame; all but the last return the
columns of ``documents``. ``run`` chains them over Parquet in the shared folder.

Defined cases, for every stage: rows are judged, not ids, so null and repeated ids are
judged row by row; null text counts as empty; an empty table gives an empty result; columns
beside ``doc_id, text, lang, source`` pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe, decontaminate, jaccard, langid, quality
from foliospark.llm.queries import table, tokenizer_path
from foliospark.llm.scratch import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores 1/2 or more. Equal texts are judged alike; without labels all stay."""
    model = quality.fit_labelled(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose fused evidence settles on a language that their text fits.

    Texts without letters (null and empty ones too) are in no language and go; rows whose declaration is
    null, or stands on too few rows for a model, are judged by the other evidence; of two languages with equal
    evidence the first by name stands.
    """
    return langid.identify(docs, only_accepted=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word Jaccard similarity of 0.8 or more: that of the smallest id.

    Rows are judged, not ids: a null id counts as the largest, an id that repeats with another text is
    another row, a row that repeats whole stays once. Texts without words (null, empty) are in no group
    and stay; an empty table stays empty.
    """
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Empty texts leak nothing; equal texts under one id go or stay together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digest of their decoding. Empty texts have none; each row gets its row."""
    encoded = bpe.encode(docs, tokenizer_path())
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

# Trained models, a similarity join and an automaton are beyond SQL; tests/llm holds the
# stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
