"""WARC archives: a JVM-side writer, and a reader that trusts only chains of records.

Writing is one text sink whose line separator is the record separator, so tasks write
and commit as any Spark job does. Of equal payloads of at least ``least`` bytes the one
with the smallest id is a response, others are revisits that name it.

Reading cuts files at the magic, wherever it stands: Spark's text reader takes it as its
line separator, so a file of any size is read in ranges and a task holds one chunk at a
time. Each chunk with a readable header is a candidate and implies its successor's offset.
Offsets are a chunk's place within its range plus the sum of the ranges before. Pointer
jumping then doubles the reach from each file's start until it stands still; records inside
payloads are never reached. The chunks that a reached record's length spans are its
payload; only where there are such are the files read again. The chain of a file takes
three numbers a candidate.

Defined cases: null text is an empty payload; a null url has no target line; line breaks
in urls are percent-encoded; repeated ids each get a record (and so the same record id),
and all rows with the smallest id are responses; null ids are larger than others; an empty
table writes and reads no record; a cut file yields the records before the cut; what
follows the last whole record is passed over; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.scratch import Scratch

MAGIC = b"WARC/1.1\r\n"
RECORDS_A_FILE = 20_000
KNOWN_ROWS = 100_000  # repeated payloads up to this many go to every task; beyond it the join shuffles
DATE = "2024-01-01T00:00:00Z"  # a fixed date keeps archives reproducible

CRLF2 = b"\r\n\r\n"
FIELDS = {
    "path": pa.string(),
    "block": pa.int64(),  # where the file's range starts
    "place": pa.int64(),  # where the chunk starts, from the range's first chunk on
    "size": pa.int64(),
    "stop": pa.int64(),  # where its record stops, from the chunk's start on; null without a readable header
    "whole": pa.bool_(),  # the record stops in this chunk
    "head": pa.int64(),  # bytes before the payload
    "page_id": pa.int64(),
    "record_type": pa.string(),
    "refers_to": pa.int64(),
    "digest": pa.string(),
    "url": pa.string(),
    "payload_bytes": pa.int64(),
    "payload_sha256": pa.string(),
}
OUT = ["path", "offset", "page_id", "record_type", "refers_to", "digest", "url", "payload_bytes", "payload_sha256"]


def prepared(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
    )


def repeated(records: DataFrame, least: int) -> DataFrame:
    """digest and smallest id of payloads that occur more than once."""
    found = (
        records.filter(F.col("bytes") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & F.col("first_id").isNotNull())
        .select("digest", "first_id")
    )
    some = found.limit(KNOWN_ROWS + 1).toArrow()
    if some.num_rows <= KNOWN_ROWS:
        spark = records.sparkSession
        return F.broadcast(spark.createDataFrame(some, "digest string, first_id long"))
    return found


def write(
    pages: DataFrame, path: str, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> None:
    records = prepared(pages, id_col, url_col, html_col)
    joined = records.join(repeated(records, least), "digest", "left")
    again = (
        F.col("first_id").isNotNull()
        & (F.col("bytes") >= least)
        & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")))
    )
    crlf = F.lit("\r\n")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    length = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("bytes"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, crlf)
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.coalesce(line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))), F.lit("")),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            again,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">"))),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        crlf,
    )
    (
        joined.select(F.concat(head, block).alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .option("maxRecordsPerFile", RECORDS_A_FILE)
        .text(path)
    )


def _header(data: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of the header that a chunk begins with (lower-case names) and where its block starts."""
    end = data.find(CRLF2)
    if end < 0:
        return None
    fields = {}
    for one in data[:end].split(b"\r\n"):
        name, colon, value = one.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields, end + 4


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isascii() and number.lstrip("-").isdigit() else None


def parse(chunk: bytes) -> dict:
    """FIELDS of a record that begins with this chunk, from ``size`` on, and its payload as far as it stands here."""
    out = dict.fromkeys(FIELDS) | {"size": len(chunk), "whole": False, "payload": None}
    found = _header(chunk)
    length = found[0].get("content-length", "") if found else ""
    if not (found and length.isascii() and length.isdigit() and len(length) < 19):
        return out
    fields, start = found
    end = start + int(length)
    http = chunk.find(CRLF2, start, end)
    head = http + 4 if http >= 0 else end
    kind = fields.get("warc-type")
    size = end - head
    if kind == "revisit":
        lines = chunk[start:head].split(b"\r\n")
        sizes = [x.split(b":")[1] for x in lines if x.lower().startswith(b"content-length:")]
        size = int(sizes[0]) if sizes and sizes[0].strip().isdigit() else 0
    out |= {"stop": end + 4, "head": head, "page_id": _page(fields.get("warc-record-id")), "record_type": kind}
    out |= {"refers_to": _page(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri"), "payload_bytes": size}
    out["digest"] = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if chunk[end : end + 4] == CRLF2:
        payload = chunk[head:end]
        out |= {"whole": True, "payload": payload, "payload_sha256": sha256(payload).hexdigest()}
    return out


def reachable(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates of one file a chain from offset 0 reaches; both arrays by offset."""
    n = len(offset)
    to = np.searchsorted(offset, successor)
    hit = (to < n) & (offset[np.minimum(to, n - 1)] == successor)
    jump = np.append(np.where(hit, to, n), n)  # n: no candidate there
    reach = np.zeros(n + 1, dtype=bool)
    reach[:n] = offset == 0
    while True:
        further = reach.copy()
        further[jump[reach]] = True
        further[n] = False
        if (further == reach).all():
            return reach[:n]
        reach, jump = further, jump[jump]


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """path, block, content: what stands between magics, in each file range in order."""
    lines = spark.read.option("lineSep", MAGIC.decode()).option("pathGlobFilter", "*.txt").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("content"),
    )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """Chunks with their places: ranges follow each other, each whole, in a task."""
    last, place = None, 0
    for batch in batches:
        for path, block, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (path, block) != last:
                last, place = (path, block), 0
            data = content.as_py()
            yield path, block, place, data
            place += len(data) + len(MAGIC)


def candidates(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row a chunk of all files below ``path``, with what its header says where it has one."""
    types = FIELDS | ({"payload": pa.binary()} if payload else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for name, block, place, data in _placed(batches):
            rows.append(parse(data) | {"path": name, "block": block, "place": place})
            held += len(data) if payload else 0
            if held > 4 << 20 or len(rows) >= 2000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch({k: pa.array([r[k] for r in rows], kind) for k, kind in types.items()})

    sql = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    return chunks(spark, path).mapInArrow(run, ", ".join(f"{k} {sql[kind]}" for k, kind in types.items()))


def with_starts(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Append ``start``, where the chunk starts in its file, and ``file_bytes``."""
    return rows.join(ranges, ["path", "block"]).withColumn("start", F.col("before") + F.col("place")).drop("before")


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records that a chain from their file's start reaches (OUT), and if wanted their payloads.

    Files are parsed once, into a table; only offsets meet in the chains.
    """
    scratch = Scratch(spark, "warc")
    found = scratch.put(candidates(spark, path, payload))
    totals = found.groupBy("path", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    within = Window.partitionBy("path")
    ranges = totals.select(
        "path",
        "block",
        F.coalesce(F.sum("bytes").over(within.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        (F.sum("bytes").over(within) - len(MAGIC)).alias("file_bytes"),
    )
    ranges = scratch.put(ranges)
    found = with_starts(found, ranges)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("start")
        start = table.column("start").to_numpy()
        is_record = np.asarray(table.column("stop").is_valid()) & (start >= len(MAGIC))  # the first chunk stands before any magic
        stop = table.column("stop").fill_null(0).to_numpy()
        at = np.flatnonzero(is_record)
        offset, successor = start[at] - len(MAGIC), start[at] + stop[at]
        kept = reachable(offset, successor)
        # One that ends in a later chunk has its end looked at when it is put together.
        further = stop[at] > table.column("size").to_numpy()[at] + len(MAGIC)
        inside = successor <= table.column("file_bytes").to_numpy()[at]
        at = at[kept & (table.column("whole").to_numpy()[at] | (further & inside))]
        # A chunk belongs to the last such record before it, if that reaches so far.
        own = np.searchsorted(start[at], start, side="right") - 1
        inside = (own >= 0) & (start < (start[at] + stop[at])[np.maximum(own, 0)]) if len(at) else np.zeros(len(start), bool)
        owner = start[at][own[inside]] if len(at) else np.zeros(0, np.int64)
        return pa.table({"path": table.column("path").filter(pa.array(inside)), "start": start[inside], "owner": owner})

    links = found.select("path", "start", "size", "stop", "whole", "file_bytes")
    chain = scratch.put(links.groupBy("path").applyInArrow(run, "path string, start long, owner long"))
    reached = found.join(chain.filter("start = owner"), ["path", "start"]).withColumn("offset", F.col("start") - len(MAGIC))
    wanted = OUT + ["payload"] * payload
    spanning = chain.filter("start <> owner").select("path", "owner").distinct()
    if spanning.isEmpty():
        return reached.select(wanted)
    return reached.join(spanning, ["path", "owner"], "left_anti").select(wanted).unionByName(
        _joined(spark, path, reached, chain, ranges, spanning).select(wanted)
    )


def _joined(spark: SparkSession, path: str, reached: DataFrame, chain: DataFrame, ranges: DataFrame, spanning: DataFrame) -> DataFrame:
    """The reached records whose payloads span chunks, put together from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _placed(batches):
            yield pa.record_batch({k: pa.array([v]) for k, v in zip(("path", "block", "place", "content"), row, strict=True)})

    parts = with_starts(chunks(spark, path).mapInArrow(run, "path string, block long, place long, content binary"), ranges)
    parts = parts.join(chain.join(spanning, ["path", "owner"]), ["path", "start"])
    listed = F.array_sort(F.collect_list(F.struct("start", F.col("content").cast("string").alias("content"))))
    texts = parts.groupBy("path", "owner").agg(F.array_join(F.transform(listed, lambda c: c["content"]), MAGIC.decode()).alias("record"))
    # No payload stands behind a revisit's header.
    size = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    payload = F.substr(F.col("record").cast("binary"), (F.col("head") + 1).cast("int"), size.cast("int"))
    joined = reached.drop("payload", "payload_sha256").join(texts, ["path", "owner"])
    ended = F.substr(F.col("record").cast("binary"), (F.col("stop") - 3).cast("int"), F.lit(4)) == F.lit(CRLF2)
    joined = joined.filter(ended).withColumn("payload", payload)
    return joined.withColumn("payload_sha256", F.sha2("payload", 256))
