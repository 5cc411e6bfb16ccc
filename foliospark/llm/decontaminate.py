"""Benchmark decontamination by template canonicalisation.

Words lose outer punctuation and case; numbers, units and names become typed
placeholders. Windows of ``width`` template tokens with at least half literal tokens are
hashed on both sides and joined, so a question asked again with other numbers or names
still meets its original. A slot check then compares how values repeat: inside a window
the pattern of equal slots must be the same on both sides, and along one alignment each
of the item's slot values must stand for one value of the document.

Beside these, windows of all words as they are, without case (Unicode's, not only A-Z's),
are compared on both sides: capitals then decide nothing, so copies in upper or lower case
are found too.

A capitalised word at a sentence's or line's start may be a name or not. Items' windows are
made with each such word in both typings; as a name it must then stand for itself, as its
capital says nothing. Documents' windows are made with all such words as literals and with
all as names. So neither a sentence put before an item nor a moved line break hides it.

A document leaks an item if consistent windows of either kind cover at least ``least`` of
the item's, or if ``run`` words of it stand in a row as they are, however long the item.
Along one alignment at most ``torn`` of the item's slot values may stand for several values
of the document: copies with a changed place or two are copies still.
Before the join, documents' windows pass a filter of fixed size built from the
benchmark, so few rows are ever shuffled; the join itself is exact.

Capitals are those of all scripts whose letters take two bytes at most (Latin, Greek,
Cyrillic, Armenian). Where a language capitalises nouns these are slots too: an item asked
again keeps them, and the slot check holds them like any value.

Items shorter than a window are one window of their own length. Defined cases: null text
counts as empty and leaks nothing; an item without a window with enough literal tokens
is compared by its words alone; rows are judged by id and text, so a null id is judged (and
reported as null), an id that repeats with another text is another document, and rows that
repeat whole are reported once and go together; an empty table on either side gives no leak;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.scratch import Scratch
from foliospark.llm.textops import U64, Words, hash_ranges, mix64, pieces, string_bytes, window_hashes, words

NAME, NUMBER, UNIT = (U64(k) for k in (0xA11CE5, 0xB0B5, 0xC0FFEE))
# Units that stand for any unit; fixed list.
UNITS = (
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg lb lbs oz gram grams kilogram kilograms "
    "ml l litre litres liter liters gallon gallons second seconds minute minutes min hour hours day days week weeks "
    "month months year years cent cents dollar dollars euro euros pound pounds percent degree degrees km/h mph watt "
    "watts volt volts hz khz mhz ghz kb mb gb tb "
    "stunde stunden sekunde sekunden minuten tag tage tagen woche wochen monat monate monaten jahr jahre jahren gramm prozent grad "
    "meile meilen stück cents heure heures seconde secondes jour jours semaine semaines mois an ans année années mètre mètres "
    "gramme grammes pour-cent degré degrés hora horas segundo segundos minuto minutos día días semana semanas mes meses año años "
    "metro metros gramo gramos litro litros grado grados"
).split()
FILTER_BITS = 1 << 22

_WORD = np.zeros(256, dtype=bool)  # bytes that words begin and end with
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_CAPITAL = np.array([chr(c).isupper() for c in range(0x800)])
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?:;"]] = True


def _unit_hashes() -> np.ndarray:
    raw, offsets = string_bytes(caseless(pa.array(UNITS)))
    return np.sort(hash_ranges(raw, offsets[:-1], offsets[1:], True))


@dataclass
class Template:
    token: np.ndarray  # hash of the literal, or a placeholder
    value: np.ndarray  # hash of what stands there
    slot: np.ndarray  # is it a placeholder?
    bound: np.ndarray
    maybe: np.ndarray  # a literal here, and a name in the middle of a sentence

    def part(self, a: int, b: int) -> Template:
        return Template(self.token[a:b], self.value[a:b], self.slot[a:b], np.array([0, b - a]), self.maybe[a:b])

    def named(self, which: np.ndarray) -> Template:
        """The same with these words as names."""
        return Template(np.where(which, NAME, self.token), self.value, self.slot | which, self.bound, self.maybe)


def caseless(column: pa.Array) -> pa.Array:
    """The column, texts with other than ASCII characters case-folded; neither adds nor drops words."""
    return pa.array([x if x is None or x.isascii() else x.upper().casefold() for x in column.to_pylist()], pa.large_string())


_UNITS = _unit_hashes()


def _trimmed(raw: np.ndarray, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words have a word byte, and their start and end without outer punctuation."""
    # First and last word byte of each word, by nearest-position tables.
    inside = np.flatnonzero(_WORD[raw])
    first = np.searchsorted(inside, found.start)
    last = np.searchsorted(inside, found.end) - 1
    keep = first <= last
    return keep, inside[first[keep]], inside[last[keep]] + 1


def template(column: pa.Array) -> Template:
    raw, offsets = string_bytes(column)
    found = words(raw, offsets, True)
    n = len(found.start)
    if not n:
        none = np.zeros(0, U64)
        return Template(none, none, np.zeros(0, bool), found.bound, np.zeros(0, bool))
    keep, start, end = _trimmed(raw, found)
    owner = np.searchsorted(found.bound, np.arange(n), side="right") - 1
    ends = _ENDS[raw[found.end - 1]]
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    opening = np.ones(n, dtype=bool)  # at a sentence's or line's start, where capitals say nothing
    opening[1:] = ends[:-1] | (owner[1:] != owner[:-1]) | (breaks[found.start[1:]] > breaks[found.end[:-1]])
    opening, owner = opening[keep], owner[keep]
    plain, at, to = raw, start, end
    if (raw >= 128).any():
        plain, bounds = string_bytes(caseless(column))
        _, at, to = _trimmed(plain, words(plain, bounds, True))
    value = hash_ranges(plain, at, to, True)
    lead = raw[start]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    number = _DIGIT[lead] & (2 * (digits[end] - digits[start]) >= end - start)
    unit = _UNITS[np.minimum(np.searchsorted(_UNITS, value), len(_UNITS) - 1)] == value
    second = raw[np.minimum(start + 1, len(raw) - 1)].astype(np.int64)
    two = (lead >= 0xC2) & (lead <= 0xDF)
    capital = np.where(two, _CAPITAL[(lead.astype(np.int64) & 31) << 6 | second & 63], (lead < 128) & _CAPITAL[lead])
    name = capital & ~opening
    slot = number | unit | name
    token = value.copy()
    token[name] = NAME
    token[unit] = UNIT
    token[number] = NUMBER
    return Template(token, value, slot, np.searchsorted(owner, np.arange(len(offsets))), capital & ~slot)


def window_table(t: Template, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window, and which are inside one text with enough literal tokens."""
    hashes = window_hashes(t.token, width)
    n = len(hashes)
    if not n:
        return hashes, np.zeros(0, bool)
    slots = np.concatenate([[0], np.cumsum(t.slot)])
    ok = 2 * (slots[width : width + n] - slots[:n]) <= width
    end = t.bound[1:]
    for k in range(1, width):  # windows over a text's end
        over = end - k
        ok[over[(over >= 0) & (over < n)]] = False
    return hashes, ok


def slot_pattern(value: np.ndarray, slot: np.ndarray) -> tuple[int, list[int]]:
    """Hash of which slots of a window are equal, and the slots' values."""
    values = value[slot]
    if not len(values):
        return 0, []
    _, index, back = np.unique(values, return_index=True, return_inverse=True)
    pattern = index[back].astype(U64)
    return int(window_hashes(mix64(pattern + U64(3)), len(pattern)).view(np.int64)[0]), values.view(np.int64).tolist()


def typings(t: Template) -> Iterator[Template]:
    """The template of one window with every choice of its ``maybe`` words as names that leaves enough literals."""
    at = np.flatnonzero(t.maybe)
    most = len(t.slot) // 2 - int(t.slot.sum())
    for k in range(min(len(at), most) + 1):
        for chosen in combinations(at.tolist(), k):
            which = np.zeros(len(t.slot), bool)
            which[list(chosen)] = True
            yield t.named(which)


ITEMS = (
    "item_id long, width int, at int, windows int, key long, pattern long, slots array<long>, fixed array<int>, literal boolean"
)


def item_windows(benchmark: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            t = template(part.column(1))
            out: list[tuple] = []
            for i, item in enumerate(part.column(0).to_pylist()):
                a, b = int(t.bound[i]), int(t.bound[i + 1])
                w = min(width, b - a)
                if not w or item is None:
                    continue
                one = t.part(a, b)
                places = np.flatnonzero(window_table(one, w)[1]).tolist()
                for at in places:
                    for typed in typings(one.part(at, at + w)):
                        key = int(window_hashes(typed.token, w).view(np.int64)[0])
                        pattern, slots = slot_pattern(typed.value, typed.slot)
                        fixed = np.flatnonzero(typed.maybe[typed.slot]).tolist()
                        out.append((item, w, at, len(places), key, pattern, slots, fixed, False))
                hashes = (window_hashes(one.value, w) ^ U64(1)).view(np.int64).tolist()
                out += [(item, w, at, len(hashes), key, 0, [], [], True) for at, key in enumerate(hashes)]
            if out:
                columns = list(zip(*out, strict=True))
                lists = [pa.list_(pa.int64()), pa.list_(pa.int32())]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *lists, pa.bool_()]
                names = [x.strip().split(" ")[0] for x in ITEMS.split(",")]
                yield pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, columns, types, strict=True)})

    return rows.mapInArrow(run, ITEMS)


NO_ID = (1 << 63) - 1  # stands for a null id
DOCS = "doc_id long, h long, width int, pos long, key long, pattern long, slots array<long>"


def document_windows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Windows of documents (doc_id, text, h) that may be among ``keys`` (width, literal, key)."""
    bit = F.pmod(F.col("key"), F.lit(FILTER_BITS))
    filled = keys.groupBy("width", "literal", F.shiftright(bit, 5).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {FILTER_BITS}) % 32 as int))")).alias("bits")
    )
    filters: dict[tuple[int, bool], np.ndarray] = {}
    for group in filled.toArrow().to_batches():  # bounded: FILTER_BITS / 32 rows for each width
        wide, literal, at, bits = (group.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        for kind in set(zip(wide.tolist(), literal.tolist(), strict=True)):
            table = filters.setdefault(kind, np.zeros(FILTER_BITS // 32, np.uint32))
            mine = (wide == kind[0]) & (literal == kind[1])
            table[at[mine]] = bits[mine].astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            t = template(part.column(1))
            none = np.zeros(len(t.slot), bool)
            words_only, named = Template(t.value, t.value, none, t.bound, none), t.named(t.maybe)
            ids, digest = part.column(0), part.column(2)
            openings = np.concatenate([[0], np.cumsum(t.maybe)])
            for (w, literal), table in shared.value.items():
                for one in (words_only,) if literal else (t, named):
                    hashes, ok = window_table(one, w)
                    if literal:
                        hashes = hashes ^ U64(1)
                    elif one is named:  # without such a word it is the window of t
                        ok &= openings[w : w + len(ok)] > openings[: len(ok)]
                    place = (hashes.view(np.int64) % FILTER_BITS).astype(np.int64)
                    hit = np.flatnonzero(ok & ((table[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1))
                    if not len(hit):
                        continue
                    owner = np.searchsorted(t.bound, hit, side="right") - 1
                    found = [(0, []) if literal else slot_pattern(one.value[k : k + w], one.slot[k : k + w]) for k in hit]
                    yield pa.record_batch(
                        {
                            "doc_id": ids.take(pa.array(owner)),
                            "h": digest.take(pa.array(owner)),
                            "width": pa.array(np.full(len(hit), w), pa.int32()),
                            "pos": pa.array(hit - t.bound[owner], pa.int64()),
                            "key": pa.array(hashes[hit].view(np.int64)),
                            "pattern": pa.array([x[0] for x in found], pa.int64()),
                            "slots": pa.array([x[1] for x in found], pa.list_(pa.int64())),
                        }
                    )

    return docs.mapInArrow(run, DOCS)


def _row_key(id_col: str, text_col: str) -> list:
    """doc_id and h: what rows are told apart by."""
    text = F.col(text_col).cast("string")
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("h")]


def _longest_run(places: str) -> Column:
    """Most consecutive numbers in a sorted array."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc: Column, at: Column) -> Column:
        now = F.when(at == acc["last"] + 1, acc["now"] + 1).otherwise(F.lit(1))
        return F.struct(at.alias("last"), now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(places, start, step, lambda acc: acc["best"])


def _found(
    docs: DataFrame, benchmark: DataFrame, width: int, least: float, run: int, torn: float, id_col: str, text_col: str
) -> DataFrame:
    """doc_id, h (of the text), item_id, coverage, windows, reworded."""
    items = item_windows(benchmark, width)
    rows = docs.select(*_row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    met = document_windows(rows.select("doc_id", "text", "h"), items.select("width", "literal", "key").distinct())
    other = items.withColumnsRenamed({"pattern": "item_pattern", "slots": "item_slots"})
    pairs = met.join(other, ["width", "key"]).filter("pattern = item_pattern AND size(slots) = size(item_slots)")
    pairs = pairs.filter("forall(fixed, k -> slots[k] = item_slots[k])")
    own = ["doc_id", "h", "item_id"]
    pairs = pairs.select(
        *own, "literal", "at", "windows", "width", (F.col("pos") - F.col("at")).alias("shift"), "slots", "item_slots"
    ).distinct()
    pairs = Scratch(docs.sparkSession, "windows").put(pairs)  # read several times below; texts once
    # Slot consistency along an alignment: one value of the document for each of the item's.
    line = [*own, "literal", "shift"]
    values = pairs.filter("size(slots) > 0").select(*line, F.explode(F.arrays_zip("item_slots", "slots")).alias("v"))
    rent = (
        values.groupBy(*line, F.col("v.item_slots").alias("item_value"))
        .agg(F.min("v.slots").alias("lo"), F.max("v.slots").alias("hi"))
        .groupBy(*line)
        .agg(F.avg((F.col("lo") != F.col("hi")).cast("double")).alias("rent"))
    )
    sound = pairs.join(rent, line, "left").filter(F.coalesce("rent", F.lit(0.0)) <= torn)
    per_place = sound.groupBy(*own, "literal", "at").agg(
        F.max("windows").alias("of"), F.min(F.col("slots") != F.col("item_slots")).alias("differs")
    )
    # Items are short, so are the lists of their places.
    in_a_row = pairs.filter("literal").groupBy(*own, "shift", "width").agg(F.sort_array(F.collect_set("at")).alias("places"))
    in_a_row = in_a_row.groupBy(*own).agg(F.max(_longest_run("places") + F.col("width") - 1).alias("in_a_row"))
    kinds = (
        per_place.groupBy(*own, "literal")
        .agg(F.count(F.lit(1)).alias("windows"), F.max("of").alias("of"), F.max("differs").alias("reworded"))
        .withColumn("coverage", F.col("windows") / F.col("of"))
        .join(in_a_row, own, "left")
        .filter(
            (F.col("coverage") >= least) & (F.col("windows") >= F.least(F.lit(3), F.col("of")))
            | F.col("literal") & (F.coalesce("in_a_row", F.lit(0)) >= run)
        )
    )
    # The kind that covers more tells; among equals the words as they are.
    best = kinds.groupBy(*own).agg(F.max(F.struct("coverage", "literal", "windows", "reworded")).alias("best"))
    return best.select(*own, "best.coverage", "best.windows", "best.reworded")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 8,
    least: float = 0.3,
    run: int = 13,
    torn: float = 0.34,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, coverage, windows, reworded (values differ): one row a leaked item of a document."""
    found = _found(docs, benchmark, width, least, run, torn, id_col, text_col)
    return found.drop("h").withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 8,
    least: float = 0.3,
    run: int = 13,
    torn: float = 0.34,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of docs, whole, that leak nothing."""
    found = _found(docs, benchmark, width, least, run, torn, id_col, text_col).select("doc_id", "h").distinct()
    # Written first: its size then decides the join, and small it spares the texts a shuffle.
    found = Scratch(docs.sparkSession, "leaks").put(found)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_row_key(id_col, text_col))
    kept = packed.join(found, ["doc_id", "h"], "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
