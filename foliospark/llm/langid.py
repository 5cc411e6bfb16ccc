"""Language identification by Bayesian fusion of four kinds of evidence.

* The text: log-likelihood of its byte trigrams (letters in the middle) under one hashed
  model a language, tempered because neighbouring trigrams overlap.
* The declared markup language: how often declarations agree with texts, as a matrix.
* The address suffix and the host: priors smoothed in a hierarchy, all rows -> suffix ->
  host, from sums of text posteriors by grouped aggregation. A row's own posterior is
  taken out of its host's and suffix's sums before it meets them.

Every declared value on ``LANGUAGE_ROWS`` rows or more is a language, whatever its share and
however many there are. A language's text model is counted on about ``sample`` rows of its
own, chosen by hash of id and text, and all models are carried to the same number of
trigrams, so a rare language gets as good a model as a frequent one and what it has never
seen costs as much; everything else covers all rows. Hosts are pre-aggregated before any
shuffle. Host sums go to every task while there are at most ``KNOWN_HOSTS`` of them; beyond
that only hosts with a hundredth of the rows (a hundred at most) do, and rows of the others
are joined by host.

``from_markup`` reads declared language and visible text off HTML, so that all four kinds
of evidence come from raw pages: text, ``<html lang>``, address suffix and host.

A row is accepted if it has letters, its best language's posterior is at least
``least`` and its text fits that language's model about as well as the sample does.

Defined cases: null text counts as empty: no letters, language ``und``, not accepted; a
null declaration, url or host brings no evidence; a declared value on fewer rows than
``LANGUAGE_ROWS`` is no language here, its rows are judged among the others; of languages
with equal posteriors the first in alphabetical order is taken; a null id is an id like any
other; an empty table gives an empty result; repeated rows get equal results; other columns
pass through, and only then are they read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.scratch import Scratch, small_batches
from foliospark.llm.textops import LOWER, pieces, string_bytes

BUCKETS = 1 << 16
TEMPER = 0.3  # of the text's log-likelihood
PRIOR_ROWS = 8.0  # rows that a parent's prior counts for
KNOWN_HOSTS = 50_000
LANGUAGE_ROWS = 5  # rows that make a declared value a language: fewer are too little text for a model
SALTS = 1024  # places that rows without a host to join are dealt to

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def trigram_codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of letters and the bucket of the trigram around each; a text's ends count as spaces."""
    low = LOWER[raw]
    low = np.where(_LETTER[low], low, np.uint8(32)).astype(np.uint32)
    at = np.flatnonzero(low != 32)
    first, last = np.zeros(len(raw) + 1, dtype=bool), np.zeros(len(raw) + 1, dtype=bool)
    first[offsets[:-1]] = last[offsets[1:] - 1] = True  # those of empty texts fall on ends of others
    before = np.where(first[at], np.uint32(32), low[at - 1])
    after = np.where(last[at], np.uint32(32), low[np.minimum(at + 1, len(raw) - 1)])
    code = (before * np.uint32(65599) + low[at]) * np.uint32(65599) + after
    return at, ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, log probabilities
    floor: np.ndarray  # least plausible mean log-likelihood of each language

    def evidence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-likelihoods and the number of trigrams of each text."""
        raw, offsets = string_bytes(column)
        n = len(offsets) - 1
        if not len(raw) or not self.languages:
            return np.zeros((n, len(self.languages))), np.zeros(n, np.int64)
        at, code = trigram_codes(raw, offsets)
        bound = np.searchsorted(at, offsets)
        count = np.diff(bound)
        total = np.zeros((n, len(self.languages)))
        full = count > 0
        if full.any():
            total[full] = np.add.reduceat(self.table[code], bound[:-1][full], axis=0, dtype=np.float64)
        return total, count


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) if x.shape[1] else x
    return e / e.sum(axis=1, keepdims=True) if x.shape[1] else e


def fit_text(docs: DataFrame, sample: int, seed: int = 11) -> TextModel:
    """docs: id, text, declared. Counts on about ``sample`` rows of each language."""
    by_language = docs.filter(F.col("declared").isNotNull()).groupBy("declared").agg(F.count(F.lit(1)).alias("n"))
    rows_of = {r["declared"]: r["n"] for r in by_language.filter(F.col("n") >= LANGUAGE_ROWS).collect()}
    languages = sorted(rows_of)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in pieces(batches, 0):
            declared = np.array(part.column(1).to_pylist(), dtype=object)
            raw, offsets = string_bytes(part.column(0))
            if not len(raw):
                continue
            at, code = trigram_codes(raw, offsets)
            owner = np.searchsorted(offsets, at, side="right") - 1
            for language in set(declared):
                mine = code[(declared == language)[owner]]
                sums[language] = sums.get(language, 0) + np.bincount(mine, minlength=BUCKETS)
        for language, values in sums.items():
            full = np.flatnonzero(values)
            yield pa.record_batch(
                {
                    "language": pa.array([language] * len(full), pa.string()),
                    "code": pa.array(full, pa.int32()),
                    "n": pa.array(values[full], pa.int64()),
                }
            )

    counts = np.zeros((BUCKETS, len(languages)))

    def add(rows: DataFrame) -> None:
        counted = rows.select("text", "declared").mapInArrow(count, "language string, code int, n long")
        found = counted.groupBy("language", "code").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows a language
        if found.num_rows:
            column = np.array([languages.index(x) for x in found.column("language").to_pylist()])
            counts[found.column("code").to_numpy(), column] += found.column("n").to_numpy()

    if languages:
        parts = [F.lit(x) for name in languages for x in (name, int(min(1.0, sample / rows_of[name]) * 1_000_000) + 1)]
        # With the text, as ids may be null.
        place = F.pmod(F.xxhash64(F.lit(seed), "id", "text"), F.lit(1_000_000))
        add(docs.filter(place < F.create_map(*parts)[F.col("declared")]))
        # A language whose rows are all alike may have missed the sample as one: then all its rows are counted.
        missed = [x for x, n in zip(languages, counts.sum(axis=0), strict=True) if not n and rows_of[x] > sample]
        if missed:
            add(docs.filter(F.col("declared").isin(missed)))
    seen = counts.sum(axis=0)
    counts *= seen.max(initial=0) / np.maximum(seen, 1)
    table = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    # Between a language's own mean log-likelihood and that of trigrams it has never seen,
    # three quarters of the way down: codes, addresses and names inside its texts stay above.
    share_of = counts / np.maximum(counts.sum(axis=0), 1)
    mean = (share_of * table).sum(axis=0)
    unseen = np.log(0.5 / (counts.sum(axis=0) + 0.5 * BUCKETS))
    return TextModel(languages, table, mean + 0.75 * (unseen - mean))


def host_of(url: Column) -> Column:
    """Lower-case host without port; null without a scheme."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.lower(host))


def suffix_of(host: Column) -> Column:
    """The last label of a host with a dot; null otherwise."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def from_markup(html: Column) -> tuple[Column, Column]:
    """Declared language (null without one) and visible text of a page."""
    page = F.coalesce(html.cast("string"), F.lit(""))
    tag = F.regexp_extract(page, r"(?is)<html\b[^>]*", 0)
    declared = F.regexp_extract(tag, r"""(?is)\slang\s*=\s*["']?([a-z]+)""", 1)
    text = F.regexp_replace(page, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]*>", " ")
    text = F.regexp_replace(text, "&[#a-zA-Z0-9]{1,10};", " ")
    return F.when(declared != "", F.lower(declared)), text


def gathered(
    docs: DataFrame,
    text_col: str = "text",
    declared_col: str | None = "lang",
    host_col: str | None = "source",
    url_col: str | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """Evidence columns __text, __declared, __host, __suffix, __id beside __row, a struct of docs' own columns."""
    none = F.lit(None).cast("string")
    host = host_of(F.col(url_col)) if url_col else F.col(host_col).cast("string") if host_col else none
    declared = F.lower(F.trim(F.col(declared_col).cast("string"))) if declared_col else none
    # Own columns are packed, so that none can clash with these.
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.col(id_col).alias("__id"),
        F.col(text_col).cast("string").alias("__text"),
        F.when(declared != "", F.regexp_extract(declared, "^[^-_]*", 0)).alias("__declared"),
        host.alias("__host"),
    )
    return packed.withColumn("__suffix", suffix_of(F.col("__host")))


@dataclass
class Fusion:
    text: TextModel
    agree: np.ndarray  # languages x declared values (the last: any other), P(declared | language)
    overall: np.ndarray  # share of each language
    least: float

    def decide(self, column: pa.Array, declared: list, above: pa.Array, host: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """Language, its posterior, accepted. ``above``, ``host``: sums of the row's suffix and host, or null."""
        names = self.text.languages
        total, count = self.text.evidence(column)
        if not names:
            return ["und"] * len(total), np.zeros(len(total)), np.zeros(len(total), bool)
        said = TEMPER * total
        own = np.where(count[:, None] > 0, _softmax(said), 0.0)
        prior = np.broadcast_to(self.overall, said.shape)
        for known, sums in (_matrix(above, len(names)), _matrix(host, len(names))):
            left = np.maximum(sums - own, 0.0)
            deeper = (left + PRIOR_ROWS * prior) / (left.sum(axis=1, keepdims=True) + PRIOR_ROWS)
            prior = np.where(known[:, None], deeper, prior)
        said = said + np.log(np.maximum(prior, 1e-9))
        index = {n: k for k, n in enumerate(names)} | {None: len(names) + 1}
        agree = np.column_stack([self.agree, np.ones(len(names))])  # without a declaration nothing is said
        said += np.log(agree[:, [index.get(x, len(names)) for x in declared]]).T
        posterior = _softmax(said)
        best = posterior.argmax(axis=1)
        top = posterior[np.arange(len(best)), best]
        mean = total[np.arange(len(best)), best] / np.maximum(count, 1)
        # Short texts scatter more about the mean.
        fits = mean >= self.text.floor[best] - 4.0 / np.sqrt(np.maximum(count, 1))
        accepted = (count > 0) & (top >= self.least) & fits
        return [names[k] if c else "und" for k, c in zip(best, count, strict=True)], top, accepted


def _matrix(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a list, and the lists as rows of a matrix; zeros where there is none."""
    known = np.asarray(lists.is_valid())
    out = np.zeros((len(lists), width))
    out[known] = lists.flatten().to_numpy().reshape(-1, width)
    return known, out


def learn(rows: DataFrame, sample: int, least: float) -> tuple[Fusion, DataFrame]:
    """The fusion and the host sums (__host, __above, __sums, __rows), from gathered evidence."""
    model = fit_text(rows.select(F.col("__id").alias("id"), F.col("__text").alias("text"), F.col("__declared").alias("declared")), sample)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = model.languages
    schema = "declared string, host string, suffix string, p array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 0):
            total, count = shared.value.evidence(part.column(0))
            p = np.where(count[:, None] > 0, _softmax(TEMPER * total), 0.0)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), max(1, p.shape[1])) if names else None
            yield pa.record_batch(
                {
                    "declared": part.column(1),
                    "host": part.column(2),
                    "suffix": part.column(3),
                    "p": lists.cast(pa.list_(pa.float64())) if names else pa.array([[]] * part.num_rows, pa.list_(pa.float64())),
                }
            )

    judged = rows.select("__text", "__declared", "__host", "__suffix").mapInArrow(run, schema)
    sums = [F.sum(F.get("p", F.lit(k))).alias(f"s{k}") for k in range(len(names))]
    known = F.when(F.col("declared").isin(names), F.col("declared")).when(F.col("declared").isNotNull(), F.lit("*"))
    # Rows are summed by host, suffix and declaration in the map tasks already; one aggregate serves all levels.
    levels = judged.groupBy(known.alias("declared"), "host", "suffix").agg(F.count(F.lit(1)).alias("rows"), *sums)
    levels = Scratch(rows.sparkSession, "langid").put(levels)
    again = [F.sum(f"s{k}").alias(f"s{k}") for k in range(len(names))]
    agree = np.full((len(names), len(names) + 1), 0.5)
    for row in levels.groupBy("declared").agg(*again or [F.lit(0)]).collect():  # one row a language and two
        if row["declared"] is not None:
            column = names.index(row["declared"]) if row["declared"] in names else len(names)
            agree[:, column] += [row[f"s{k}"] or 0.0 for k in range(len(names))]
    by_suffix = levels.filter("suffix IS NOT NULL").groupBy("suffix").agg(*again or [F.lit(0)])
    overall = (agree - 0.5).sum(axis=1) + 1.0
    fusion = Fusion(model, agree / agree.sum(axis=1, keepdims=True), overall / overall.sum() if len(names) else overall, least)
    by_host = levels.filter("host IS NOT NULL").groupBy("host", "suffix").agg(F.sum("rows").alias("__rows"), *again)
    listed = F.array(*[f"s{k}" for k in range(len(names))]).cast("array<double>")
    hosts = by_host.select(F.col("host").alias("__host"), listed.alias("__sums"), F.col("suffix").alias("__suffix"), "__rows")
    above = by_suffix.select(F.col("suffix").alias("__suffix"), listed.alias("__above"))
    return fusion, hosts.join(above, "__suffix", "left").select("__host", "__above", "__sums", "__rows")


def _with_hosts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    some = hosts.limit(KNOWN_HOSTS + 1).toArrow()
    if some.num_rows <= KNOWN_HOSTS:
        known = spark.createDataFrame(some, hosts.schema).drop("__rows")
        return rows.join(F.broadcast(known), "__host", "left")
    hosts = Scratch(spark, "hosts").put(hosts)
    total = hosts.agg(F.sum("__rows")).first()[0]
    hot = [r["__host"] for r in hosts.filter(F.col("__rows") * 100 >= total).select("__host").collect()]  # a hundred at most
    # A row whose host is hot, or null, meets nothing in the shuffle and is dealt anywhere.
    salt = F.concat(F.lit("~"), F.pmod(F.xxhash64("__id", "__text"), F.lit(SALTS)).cast("string"))
    is_hot = F.coalesce(F.col("__host").isin(hot), F.lit(True))
    keyed = rows.withColumn("__key", F.when(is_hot, salt).otherwise(F.concat(F.lit("="), "__host")))
    many = hosts.filter(~F.col("__host").isin(hot)).select(
        F.concat(F.lit("="), "__host").alias("__key"), F.col("__above").alias("__a"), F.col("__sums").alias("__s")
    )
    few = hosts.filter(F.col("__host").isin(hot)).drop("__rows")
    joined = keyed.join(many, "__key", "left").join(F.broadcast(few), "__host", "left")
    return joined.withColumn("__above", F.coalesce("__above", "__a")).withColumn("__sums", F.coalesce("__sums", "__s"))


def identify(docs: DataFrame, sample: int = 8000, least: float = 0.5, only_accepted: bool = False, **columns: str | None) -> DataFrame:
    """docs with language, confidence and accepted; or, with ``only_accepted``, docs' own columns of accepted rows."""
    if not only_accepted:
        docs = docs.drop("language", "confidence", "accepted")
    rows = gathered(docs, **columns)
    small_batches(docs.sparkSession)
    fusion, hosts = learn(rows, sample, least)
    shared = docs.sparkSession.sparkContext.broadcast(fusion)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            language, top, accepted = shared.value.decide(part.column(1), part.column(2).to_pylist(), part.column(3), part.column(4))
            own = pa.RecordBatch.from_struct_array(part.column(0))
            if only_accepted:
                yield own.filter(pa.array(accepted, pa.bool_()))
            else:
                own = own.append_column("language", pa.array(language, pa.string()))
                own = own.append_column("confidence", pa.array(top, pa.float64()))
                yield own.append_column("accepted", pa.array(accepted, pa.bool_()))

    joined = _with_hosts(rows, hosts).select("__row", "__text", "__declared", "__above", "__sums")
    schema = docs.schema
    if not only_accepted:
        extra = [("language", T.StringType()), ("confidence", T.DoubleType()), ("accepted", T.BooleanType())]
        schema = T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in extra)])
    return joined.mapInArrow(run, schema)
