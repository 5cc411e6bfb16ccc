"""Entity names out of noisy text: candidate generators, validity, scores, votes.

All of it is column expressions over one text: generators give arrays of candidates
(base, name, how), which are cleaned, checked, scored and sorted as arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.functions import text as T
from foliospark.operators.rows import row_text

CODE = r"(?U)\d{10,}"
CANDIDATES = "array<struct<base:double,name:string,how:string>>"


def literal_array(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def places(text: Column, word: Column | str, from_: int = 1) -> Column:
    """1-based places of a word, left to right without overlap."""
    word = F.lit(word) if isinstance(word, str) else word
    hits = F.filter(T.upto(F.length(text) - F.length(word) + 1), lambda i: T.at(text, i, F.length(word)) == word)
    return _apart(hits, F.length(word))


def _apart(starts: Column, length: Column) -> Column:
    """Drop starts that lie inside the match before."""
    none = F.array().cast("array<int>")
    return F.aggregate(
        starts,
        none,
        lambda kept, i: F.when(
            (F.size(kept) == 0) | (i >= F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(0)) + length),
            F.concat(kept, F.array(i)),
        ).otherwise(kept),
    )


def suffix_end(text: Column, start: Column, config: Config) -> Column:
    """Last position of the business suffix that begins first from ``start``; the longest of those; else null."""
    found = F.transform(
        literal_array(config.suffixes),
        lambda s: F.struct(T.locate(s, text, start).alias("at"), (-F.length(s)).alias("less")),
    )
    best = F.array_min(F.filter(found, lambda f: f["at"] > 0))
    return best["at"] - best["less"] - 1


def suffix_found(text: Column, start: Column, config: Config) -> Column:
    """That suffix itself."""
    upto_end = text.substr(F.lit(1), suffix_end(text, start, config))
    # Suffixes are longest first, so the first that ends there is the one that was found.
    return F.get(F.filter(literal_array(config.suffixes), lambda s: F.endswith(upto_end, s)), F.lit(0))


def _with_package(text: Column, end: Column) -> Column:
    """``end`` moved behind a package number that follows."""
    return end + F.length(F.regexp_extract(F.substr(text, (end + 1).cast("int")), r"(?U)^(包\d+)", 1))


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start.cast("int"), (end - start + 1).cast("int"))


def fuzzy_region(text: Column, config: Config) -> Column:
    """Struct (mismatches, at) of the best region window, or null: fewest mismatches, then the first place."""
    options = []
    for word in config.regions:
        if len(word) < config.region_fuzzy_min_len:
            continue
        if config.tolerance(word):
            options.append(_near_windows(text, word, config))
        else:
            place = F.instr(text, word)
            options.append(F.when(place > 0, F.array(F.struct(F.lit(0).alias("gap"), place.alias("at")))))
    if not options:
        return F.lit(None).cast("struct<gap:int,at:int>")
    none = F.array().cast("array<struct<gap:int,at:int>>")
    return F.array_min(F.concat(*[F.coalesce(o.cast("array<struct<gap:int,at:int>>"), none) for o in options]))


def _near_windows(text: Column, word: str, config: Config) -> Column:
    """Structs (gap, at) of the windows close enough to a word."""
    n = len(word)

    def gap(i: Column) -> Column:
        return T.char_mismatches(T.at(text, i, n), F.lit(word))

    def fits(i: Column) -> Column:
        ok = gap(i) <= config.tolerance(word)
        return (T.at(text, i + n - 1, 1) == word[-1]) & ok if config.region_fuzzy_require_suffix_char else ok

    hits = F.filter(T.upto(F.length(text) - n + 1), fits)
    return F.transform(hits, lambda i: F.struct(gap(i).alias("gap"), i.alias("at")))


def exact_region(text: Column, config: Config) -> Column:
    """First place of any region word, or null."""
    found = F.filter(F.transform(literal_array(config.regions), lambda w: F.call_function("instr", text, w)), lambda i: i > 0)
    return F.array_min(found)


def code_ends(text: Column) -> Column:
    """Last positions of digit runs of ten and more."""
    digit = r"(?U)^\d$"
    return F.filter(
        T.upto(F.length(text)),
        lambda i: (i >= 10) & T.at(text, i - 9, 10).rlike(r"(?U)^\d{10}$") & ~T.at(text, i + 1, 1).rlike(digit),
    )


def find_start(text: Column, config: Config) -> Column:
    """Struct (at, how): region, fuzzy region, code, year or head."""
    fuzzy = fuzzy_region(text, config)
    first_end = F.get(code_ends(text), F.lit(0))
    run = F.length(F.regexp_extract(text, r"(?U)(\d{10,})", 1))
    prefix = text.substr(F.lit(1), first_end - run)
    before = (F.length(prefix) >= 2) & prefix.rlike(r"^[一-龥]+$")
    make = lambda at, how: F.struct(at.cast("int").alias("at"), (F.lit(how) if isinstance(how, str) else how).alias("how"))
    return (
        F.when(exact_region(text, config).isNotNull(), make(exact_region(text, config), "region"))
        .when(fuzzy.isNotNull(), make(fuzzy["at"], F.when(fuzzy["gap"] > 0, "region_fuzzy").otherwise("region")))
        .when(first_end.isNotNull() & before, make(F.lit(1), "code_prefix"))
        .when(first_end.isNotNull(), make(first_end + 1, "code"))
        .when(text.rlike(r"(?U)^20\d{2}"), make(F.lit(1), "year"))
        .otherwise(make(F.lit(1), "head"))
    )


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _candidates(starts: Column, cut, base: float, how: str) -> Column:
    made = F.transform(starts, lambda i: F.struct(F.lit(base).alias("base"), cut(i).alias("name"), F.lit(how).alias("how")))
    return F.filter(made, lambda c: c["name"].isNotNull()).cast(CANDIDATES)


def candidates(text: Column, config: Config) -> Column:
    """All candidates of a cleaned text, in the generators' order."""

    def behind_code(i: Column) -> Column:
        return F.regexp_replace(text.substr(F.lit(1), suffix_end(text, i + 1, config)), CODE, "")

    def from_year(i: Column) -> Column:
        end = _with_package(text, suffix_end(text, i, config))
        return F.regexp_replace(_between(text, i, end), r"(?U)\d{11,}$", "")

    def from_place(i: Column) -> Column:
        end = _with_package(text, suffix_end(text, i, config))
        return F.regexp_replace(_between(text, i, end), CODE, "")

    years = _apart(F.filter(T.upto(F.length(text) - 3), lambda i: T.at(text, i, 4).rlike(r"(?U)^20\d{2}$")), F.lit(4))
    exact = [places(text, w) for w in config.regions] or [F.array().cast("array<int>")]
    known = F.concat(*exact)
    fuzzy = fuzzy_region(text, config)
    extra = F.when(
        fuzzy.isNotNull() & (fuzzy["gap"] > 0) & ~F.array_contains(known, F.coalesce(fuzzy["at"], F.lit(0))), F.array(fuzzy["at"])
    ).otherwise(F.array().cast("array<int>"))
    start = find_start(text, config)
    fallback = F.transform(
        F.array(start),
        lambda s: F.struct(
            F.lit(0.8).alias("base"), from_place(s["at"]).alias("name"), F.concat(F.lit("fallback_"), s["how"]).alias("how")
        ),
    )
    return F.concat(
        _candidates(code_ends(text), behind_code, 1.0, "formA"),
        _candidates(years, from_year, 0.95, "formCD"),
        _candidates(F.concat(known, extra), from_place, 0.9, "formB"),
        F.filter(fallback, lambda c: c["name"].isNotNull()).cast(CANDIDATES),
    )


def max_digit_run(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(r"(?U)(\d+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def is_valid_name(name: Column, config: Config) -> Column:
    ok = F.length(name).between(config.min_name_len, config.max_name_len)
    ok &= name.rlike(f"^[{config.name_charset}]+$") & (max_digit_run(name) <= config.max_digit_run)
    ok &= ~F.exists(literal_array([w for w in config.noise_words if w]), lambda w: F.contains(name, w))
    if config.suffixes:
        ok &= F.exists(literal_array(config.suffixes), lambda s: F.contains(name, s))
    return F.coalesce(ok, F.lit(False))


def cleaned_text(text: Column, config: Config) -> Column:
    return T.apply_symbols(T.apply_fixes(T.strip_noise(T.normalize_name(text), config), config), config)


def scored(text: Column, config: Config) -> Column:
    """Valid candidates (score, name, how) of a cleaned text, best first."""
    start = find_start(text, config)
    bonus_suffix = suffix_found(text, start["at"], config)

    def tidy(name: Column) -> Column:
        name = F.regexp_replace(T.apply_fixes(name, config), r"^[：:号\-—_ ]+|[：:号\-—_ ]+$", "")
        return F.trim(F.regexp_replace(name, CODE, ""))

    def score(c: Column) -> Column:
        value = c["base"] + F.when(F.coalesce(F.contains(c["name"], bonus_suffix), F.lit(False)), 0.3).otherwise(0.0)
        keywords = [w for w in config.valid_keywords if w]
        if keywords:
            value = value + F.when(F.exists(literal_array(keywords), lambda w: F.contains(c["name"], w)), 0.15).otherwise(0.0)
        return value + F.least(F.lit(0.2), F.length(c["name"]) * 0.004)

    tidied = F.transform(
        candidates(text, config),
        lambda c, i: F.struct(c["base"].alias("base"), tidy(c["name"]).alias("name"), c["how"].alias("how"), i.alias("ord")),
    )
    valid = F.filter(tidied, lambda c: is_valid_name(c["name"], config))
    ranked = F.array_sort(
        F.transform(
            valid,
            lambda c: F.struct(
                (-score(c)).alias("less"), (-F.length(c["name"])).alias("shorter"), c["ord"].alias("ord"), c["name"].alias("name"), c["how"].alias("how")
            ),
        )
    )
    return F.transform(ranked, lambda c: F.struct((-c["less"]).alias("score"), c["name"].alias("name"), c["how"].alias("how")))


def extract_names(df: DataFrame, config: Config | None = None, text_col: str = "text", top: int = 5) -> DataFrame:
    """df with name ('' if none), name_score, name_how and the ``top`` best candidates."""
    config = config or Config()
    found = df.withColumn("__clean", cleaned_text(F.col(text_col), config)).withColumn("__all", scored(F.col("__clean"), config))
    best = F.get("__all", F.lit(0))
    return (
        found.withColumn("name", F.coalesce(best["name"], F.lit("")))
        .withColumn("name_score", F.coalesce(best["score"], F.lit(0.0)))
        .withColumn("name_how", F.coalesce(best["how"], F.when(F.col("__clean") == "", "empty").otherwise("no_match")))
        .withColumn("candidates", F.slice("__all", 1, top))
        .drop("__clean", "__all")
    )


def vote(pages: DataFrame, keys: list[str], config: Config | None = None, order: str = "page") -> DataFrame:
    """The best name of each group of pages: every page is parsed alone, a name keeps its best score.

    pages: keys, order, rows.
    """
    parsed = extract_names(pages.withColumn("__text", row_text(F.col("rows"))), config, "__text")
    each = parsed.select(*keys, order, F.posexplode("candidates").alias("pos", "c"))
    best = each.groupBy(*keys, F.col("c.name").alias("name")).agg(
        F.max("c.score").alias("score"), F.min(F.struct(order, "pos")).alias("seen")
    )
    first = F.max_by("name", F.struct("score", F.length("name").alias("n"), (-F.col(f"seen.{order}")).alias("p"), (-F.col("seen.pos")).alias("q")))
    return best.groupBy(*keys).agg(first.alias("name"), F.max("score").alias("name_score"))
