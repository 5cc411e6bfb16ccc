"""Scalar functions, Column to Column: everything stays in the JVM.

Positions are 1-based as in SQL. White space and digits follow Unicode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.config import Config

# Full-width forms of ! to ~, and the same in ASCII.
WIDE = "".join(chr(0xFF01 + i) for i in range(94))
NARROW = "".join(chr(0x21 + i) for i in range(94))
# Marks that the three normalisers drop.
PUNCTUATION = "，。、；：？！「」『』《》（）【】<>,.;:!?'\"()[]{}-_/\\|*#@`~"
NAME_MARKS = "，。、；：？！「」『』《》【】"
COMPARE_MARKS = "，。、；：？！「」『』《》（）()[]【】<>.,;:!?'\"-_/\\|*#@`~"
ILLEGAL = '<>:"/\\|?*'
SPACES = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
SPACE = r"(?U)[\s\x1c-\x1f]+"


def translated(text: Column, table: dict[str, str]) -> Column:
    """One pass over the text; an empty replacement deletes."""
    kept = {k: v for k, v in table.items() if v}
    gone = [k for k, v in table.items() if not v]
    return F.translate(text, "".join([*kept, *gone]), "".join(kept.values()))


def _table(drop: str, wide: str = WIDE, narrow: str = NARROW) -> dict[str, str]:
    table = {w: "" if n in drop else n for w, n in zip(wide, narrow, strict=True)}
    return table | {c: "" for c in drop}


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def normalize_text(text: Column) -> Column:
    """For matching titles: half width, no white space, no punctuation. Null gives ''."""
    return without_space(translated(F.coalesce(text, F.lit("")), _table(PUNCTUATION)))


_PLAIN = str.maketrans({c: v or None for c, v in _table(PUNCTUATION).items()})


def plain_text(text: str) -> str:
    """``normalize_text`` of one string."""
    return "".join(text.translate(_PLAIN).split())


def normalize_name(text: Column) -> Column:
    """For entity names: half-width letters, digits and brackets, few marks dropped, voltages as <n>kV."""
    alnum = [(w, n) for w, n in zip(WIDE, NARROW, strict=True) if n.isalnum()]
    table = dict(alnum) | {"（": "(", "）": ")"} | {c: "" for c in NAME_MARKS}
    bare = without_space(translated(F.coalesce(text, F.lit("")), table))
    return F.regexp_replace(bare, r"(?U)(\d+(?:\.\d+)?)\s*[kK][vV]", "$1kV")


def normalize_compare(text: Column) -> Column:
    """For comparing file and folder names: no white space or punctuation, lower case, widths kept."""
    bare = without_space(F.coalesce(text, F.lit("")))
    return F.lower(translated(bare, {c: "" for c in COMPARE_MARKS}))


def replaced(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements one after the other."""
    for wrong, right in pairs:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def apply_fixes(text: Column, config: Config) -> Column:
    return replaced(text, config.fixes)


def strip_noise(text: Column, config: Config) -> Column:
    text = replaced(text, [(w, "") for w in config.noise_words if w])
    for pattern in (config.name_label_pattern, config.code_label_pattern):
        if pattern:
            text = F.regexp_replace(text, "(?U)" + pattern, "")
    return text


def apply_symbols(text: Column, config: Config) -> Column:
    return replaced(text, [(k, v) for k, v in config.symbol_fixes.items() if k])


def sanitize_filename(name: Column) -> Column:
    """Illegal characters become _, outer white space and dots at the end go."""
    text = F.translate(F.coalesce(name, F.lit("")), ILLEGAL, "_" * len(ILLEGAL))
    text = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.regexp_replace(text, r"\.+$", "")


LINE_BREAK = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def at(text: Column, position: Column, length: Column | int) -> Column:
    """Substring by columns."""
    return F.substr(text, position, F.lit(length) if isinstance(length, int) else length)


def locate(part: Column, text: Column, position: Column) -> Column:
    """First place of ``part`` in ``text`` from ``position``, else 0."""
    return F.call_function("locate", part, text, position)


def upto(last: Column) -> Column:
    """1 .. last, empty below 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def char_mismatches(a: Column, b: Column) -> Column:
    """Characters that differ; 999 for unequal lengths."""
    counted = F.size(F.filter(upto(F.length(a)), lambda i: at(a, i, 1) != at(b, i, 1)))
    return F.when(F.length(a) != F.length(b), F.lit(999)).otherwise(counted)


def common_substring_length(a: Column, b: Column) -> Column:
    """Length of the longest common substring, by the row-wise recurrence over b's characters."""
    chars_a = F.filter(F.split(a, ""), lambda c: c != "")
    chars_b = F.filter(F.split(b, ""), lambda c: c != "")
    zero = F.transform(chars_b, lambda _: F.lit(0))

    def row(state: Column, x: Column) -> Column:
        now = F.transform(
            chars_b,
            lambda y, j: F.when(y == x, F.when(j == 0, 1).otherwise(F.get(state["row"], j - 1) + 1)).otherwise(0),
        )
        return F.struct(now.alias("row"), F.greatest(state["best"], F.coalesce(F.array_max(now), F.lit(0))).alias("best"))

    start = F.struct(zero.alias("row"), F.lit(0).alias("best"))
    return F.aggregate(chars_a, start, row, lambda s: s["best"])


def long_codes(text: Column, digits: int = 10) -> Column:
    """Distinct runs of at least ``digits`` digits."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?U)(\d{{{digits},}})"), F.lit(1)))


def codes_equivalent(a: Column, b: Column, tolerance: int = 2) -> Column:
    """Equal, equally long with few differences, or the shorter inside a slightly longer one."""
    short, long = (F.when(F.length(a) < F.length(b), x).otherwise(y) for x, y in ((a, b), (b, a)))
    inside = ((F.length(long) - F.length(short)) <= tolerance) & F.contains(long, short)
    same = F.when(F.length(a) == F.length(b), char_mismatches(a, b) <= tolerance).otherwise(inside)
    return (F.length(a) > 0) & (F.length(b) > 0) & same


def feature_key(text: Column, config: Config) -> Column:
    """What is left of a name without units, years, regions, suffixes and codes."""
    out = normalize_text(text)
    for pattern in (config.design_unit_pattern, config.org_noise_pattern, *config.feature_strip_patterns):
        if pattern:
            out = F.regexp_replace(out, "(?U)" + pattern, "")
    return F.regexp_replace(out, r"[^一-龥A-Za-z0-9#]", "")


def template_variants(folder: Column) -> Column:
    """The normalised folder name, and without a long code at its end; longest first."""
    base = normalize_text(folder)
    bare = F.regexp_replace(base, r"(?U)\d{10,}$", "")
    return F.filter(F.array_distinct(F.array(base, bare)), lambda x: x != "")


def aligned_replace(text: Column, template: Column, most: float = 0.34) -> Column:
    """The text with its closest window of the template's length replaced; the text itself if none is close."""
    m = F.length(template)
    windows = F.transform(
        upto(F.length(text) - m + 1),
        lambda i: F.struct(char_mismatches(at(text, i, m), template).alias("gap"), i.alias("at")),
    )

    def fixed(best: Column) -> Column:
        whole = F.concat(at(text, F.lit(1), best["at"] - 1), template, F.substr(text, best["at"] + m))
        return F.when((m > 0) & (best["gap"] > 0) & (best["gap"] / m <= most), whole).otherwise(text)

    # A one-element array binds the best window, so that it is computed once.
    return F.coalesce(F.get(F.transform(F.array(F.array_min(windows)), fixed), F.lit(0)), text)


def page_label(first: Column, last: Column) -> Column:
    return F.when(first == last, F.format_string("P%d", first)).otherwise(F.format_string("P%d-P%d", first, last))


def rules_signature(rules: Column) -> Column:
    """12 hex digits of ordered pattern=>mapping pairs (an array of structs in order)."""
    lines = F.transform(rules, lambda r: F.concat(r["pattern"], F.lit("=>"), r["mapping"]))
    return F.substring(F.sha1(F.array_join(lines, "|").cast("binary")), 1, 12)


def cache_key(path: Column, size: Column, modified: Column, page: Column, scale: Column, signature: Column, version: int = 1) -> Column:
    """Fingerprint of one page under one set of parameters; modification times are whole microseconds."""
    parts = [F.lit(f"v{version}"), F.lower(path), size, F.unix_micros(modified), page, scale.cast("double"), signature]
    return F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
