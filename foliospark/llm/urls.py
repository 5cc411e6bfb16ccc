"""URL filter: rules first, then a character language-model ratio, all in DataFrame functions.

Two variable-order Markov models over an alphabet of 64 symbols, one for accepted and one
for rejected URLs, are counted by one grouped aggregate over windows of ``ORDER`` + 1
characters; all shorter contexts are sums of its rows. Orders are interpolated by
Witten-Bell smoothing, so a context that was never seen falls back to the shorter one. A
URL's score is the log-likelihood difference divided by its length; the cut is calibrated on
a held-out fifth of the labelled URLs (best balanced accuracy).

The model is a table with a row for every distinct window of the corpus, and grows with it.
Only characters and pairs of them (64 ** 2 numbers) pass through the driver; longer contexts
are smoothed by window functions over the table, dealt by context, of which none has more
than 64 ** (``ORDER`` - 1) rows. Scoring joins windows with the table: it goes to every task
up to ``KNOWN_GRAMS`` rows; beyond that only windows that make up a thousandth of all do,
and the others are joined by window. Sums of a URL start in the map tasks.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule
and is scored as the text that it is (an empty one scores 0); without labelled URLs of
both classes every score is 0 and the cut is 0, so the verdict is ``allow``; repeated
rows each get the same verdict; a null id is kept; columns other than those named are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Symbol 0 is any other character, 1..62 are these, 63 stands before the start.
ALPHABET = LOWER + "0123456789" + "-._/?=&#:%~+@;!,$*'()[]|{}"
K = 64
START = K - 1
ORDER = 5  # characters of the longest context
KNOWN_GRAMS = 200_000
BINS, SPAN = 2000, 5.0  # calibration histogram: bins over scores -SPAN..SPAN


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def fold_case(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    bare = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    slash = F.instr(bare, "/")
    host = fold_case(F.when(slash > 0, F.substr(bare, F.lit(1), slash - 1)).otherwise(bare))
    path = F.when(slash > 0, F.substr(bare, slash)).otherwise(F.lit(""))
    return host, path


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.name)).otherwise(found)
    return found


def windows(url: str) -> str:
    """SQL for the codes of all windows of a URL column, one a character."""
    listed = ALPHABET.replace("'", "''")
    chars = f"filter(split(translate(coalesce(`{url}`, ''), '{UPPER}', '{LOWER}'), ''), c -> c <> '')"
    codes = f"concat(array_repeat({START}L, {ORDER}), transform({chars}, c -> cast(instr('{listed}', c) AS long)))"
    code = "0L"
    for j in range(ORDER + 1):
        code = f"({code} * {K} + c[i + {j}])"
    return f"transform(array({codes}), c -> transform(slice(c, {ORDER + 1}, size(c) - {ORDER}), (x, i) -> {code}))[0]"


def _smoothed(counts: dict[int, int]) -> list[float]:
    """P(c | a) for every pair, by Witten-Bell interpolation down to uniform."""
    by_order = [defaultdict(int) for _ in range(2)]
    for code, n in counts.items():
        for order in range(2):
            by_order[order][code % K ** (order + 1)] += n
    below = [1.0 / K]  # order -1: the same for every symbol
    for order in range(2):
        total, kinds = defaultdict(int), defaultdict(int)
        for code, n in by_order[order].items():
            total[code // K] += n
            kinds[code // K] += 1
        now = []
        for code in range(K ** (order + 1)):
            context = code // K
            lower = below[code % K**order] if order else below[0]
            n = total[context]
            now.append((by_order[order][code] + kinds[context] * lower) / (n + kinds[context]) if n else lower)
        below = now
    return below


def log_ratios(table: DataFrame) -> DataFrame:
    """g, n, ratio of each window: table has g, n and its counts n1 and n0 in accepted and rejected URLs."""
    pair = (F.col("g") % K**2).cast("int")
    pairs = table.groupBy(pair.alias("pair")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).collect()  # at most 64 ** 2
    counts = [{r["pair"]: r[c] for r in pairs if r[c]} for c in ("n0", "n1")]
    if not all(counts):
        return table.select("g", "n", F.lit(0.0).alias("ratio"))
    now = table
    for i, of in enumerate(counts):
        known = F.split(F.lit(",".join(f"{x:.17g}" for x in _smoothed(of))), ",").cast("array<double>")
        now = now.withColumn(f"p{i}", F.get(known, pair))
    for order in range(2, ORDER + 1):
        # Dealt by context, so the windows of a context and those of a symbol behind it meet without another exchange.
        now = now.withColumns({"context": F.expr(f"(g % {K ** (order + 1)}L) div {K}"), "symbol": F.col("g") % K}).repartition("context")
        here, behind = Window.partitionBy("context"), Window.partitionBy("context", "symbol")
        now = now.withColumn("first", F.row_number().over(behind.orderBy("g")) == 1)
        now = now.withColumns({f"c{i}": F.sum(f"n{i}").over(behind) for i in range(2)})
        now = now.withColumns({f"all{i}": F.sum(f"n{i}").over(here) for i in range(2)})
        now = now.withColumns({f"kinds{i}": F.sum((F.col("first") & (F.col(f"c{i}") > 0)).cast("int")).over(here) for i in range(2)})
        longer = lambda i: F.expr(f"if(all{i} > 0, (c{i} + kinds{i} * p{i}) / (all{i} + kinds{i}), p{i})")
        now = now.select("g", "n", "n0", "n1", *[longer(i).alias(f"p{i}") for i in range(2)])
    return now.select("g", "n", (F.log("p1") - F.log("p0")).alias("ratio"))


def scored(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """a, b, score, held, m of rows (a, b: keys, grams, held): the mean ratio of each key's windows, and its rows."""
    taken = rows.select("a", "b", "held", F.greatest(F.size("grams"), F.lit(1)).alias("len"), F.explode_outer("grams").alias("g"))
    known, total = ratios.agg(F.count(F.lit(1)), F.sum("n")).first()
    if known <= KNOWN_GRAMS:
        met = taken.join(F.broadcast(ratios.select("g", "ratio")), "g", "left")
    else:
        hot = F.col("n") * 1000 >= (total or 0)  # a thousand at most
        few = ratios.filter(hot).select("g", F.col("ratio").alias("hot_ratio"))
        met = taken.join(F.broadcast(few), "g", "left")
        # A window that has met meets nothing in the shuffle, and is dealt anywhere.
        away = -1 - F.pmod("a", F.lit(1024))
        met = met.withColumn("g", F.when(F.col("hot_ratio").isNotNull() | F.col("g").isNull(), away).otherwise(F.col("g")))
        met = met.join(ratios.filter(~hot).select("g", "ratio"), "g", "left").withColumn("ratio", F.coalesce("hot_ratio", "ratio"))
    mean = F.round(F.coalesce(F.avg("ratio"), F.lit(0.0)), 9)  # whatever the order of summing
    return met.groupBy("a", "b").agg(
        mean.alias("score"), F.max("held").alias("held"), (F.count(F.lit(1)) / F.max("len")).cast("long").alias("m")
    )


def calibrate(rows: DataFrame) -> float:
    """The cut with the best balanced accuracy for rows (score, held: label, m: how many); among equals the middle of the best run."""
    place = F.floor((F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.col("score"))) + SPAN) * (BINS / (2 * SPAN)))
    counted = rows.filter("held IS NOT NULL").groupBy(place.alias("bin"), "held").agg(F.sum("m").alias("m"))
    seen = {0: [0] * (BINS + 1), 1: [0] * (BINS + 1)}
    for row in counted.collect():  # at most 2 * (BINS + 1) rows
        seen[row["held"]][row["bin"]] += row["m"]
    good, bad = sum(seen[1]), sum(seen[0])
    if not good or not bad:
        return 0.0
    best, cuts, kept, below = -1.0, [], good, 0
    for at in range(BINS + 1):
        value = kept / good + below / bad  # the cut stands at the low edge of this bin
        if value > best + 1e-12:
            best, cuts = value, [at]
        elif value > best - 1e-12:
            cuts.append(at)
        kept, below = kept - seen[1][at], below + seen[0][at]
    run = 0
    while run + 1 < len(cuts) and cuts[run + 1] == cuts[run] + 1:
        run += 1
    return (cuts[0] + cuts[run]) / 2 * (2 * SPAN / BINS) - SPAN


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score, cut: one row a page."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    urls = urls.withColumn("host", host).withColumn("path", path)
    urls = urls.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    urls = urls.withColumns({"a": F.xxhash64("page_id", "url"), "b": F.xxhash64(F.lit(1), "page_id", "url")})
    allowed = [r.name for r in rules if r.verdict == "allow"]
    label = F.when(F.col("rule").isNotNull(), F.col("rule").isin(allowed).cast("int"))
    fold = F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % 5
    read = urls.select(
        "a", "b", F.when(fold != 0, label).alias("fit"), F.when(fold == 0, label).alias("held"), F.expr(windows("url")).alias("grams")
    )
    counts = {f"n{i}": F.coalesce((F.col("fit") == i).cast("long"), F.lit(0)) for i in range(2)}
    seen = read.withColumns(counts).select("n0", "n1", F.explode("grams").alias("g"))
    table = scratch.put(seen.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    scores = scratch.put(scored(read, scratch.put(log_ratios(table))))
    cut = calibrate(scores)
    by_model = F.when(F.col("score") >= F.lit(cut), F.lit("allow")).otherwise(F.lit("block"))
    by_rule = F.when(F.col("rule").isin(allowed), F.lit("allow")).otherwise(F.lit("block"))
    return urls.join(scores.select("a", "b", "score"), ["a", "b"]).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_model).alias("verdict"),
        "score",
        F.lit(cut).alias("cut"),
    )
