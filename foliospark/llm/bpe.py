"""Byte-pair encoding by a tokenization automaton.

The merges are compiled in order into an automaton over tokens, held in integer arrays.
It starts with one state and all symbols as arcs. Merging (u, v) inserts one gadget: the
state behind u loses its arc v, and a new state behind uv takes over what the state behind
v has as it stands then, while arcs uv enter wherever arcs u do. A gadget is three numbers
(left, right, time), and ``has_arc`` reads an arc off them. A merge whose arc has gone
already inserts nothing. What is left accepts exactly one sequence of tokens for each
word: the one that merging gives.

That automaton is made deterministic over letters. A letter state holds, for every token
that may have begun and not ended, the token state it began in and its place in the trie
of arc labels; as each prefix has one path only, exactly one token can end at a letter,
and it is the letter state's label. ``next`` (state and letter to state) and ``label`` are
the tables; a transition is filled in when it is first taken, and the tables start anew
beyond ``STATES``. Encoding a pre-split word is one table step a letter from left to right;
the labels, read back from the last letter, are its tokens. Nothing is ever tried twice, so
a word takes time in proportion to its length. Decoding emits the labels.

Normalisation, pre-splitting and added tokens follow the tokenizer file. Texts of letters up
to Latin Extended-A are lower-cased and split here; for any other text the tokenizers
library's own normaliser and splitter are run, since its Unicode tables (classes, case,
combining classes) are of other versions than Python's and decide the ids. Defined cases:
null counts as empty; an empty text has no ids and decodes to an empty string; a null id
stays null; repeated rows each get their row; an empty table gives an empty result; columns
other than those named are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.llm.scratch import small_batches
from foliospark.llm.textops import HELD, give_back

END = "</w>"
MARK = 256
CACHE = 150_000  # pieces in each of the two generations that one worker remembers
EMITTED = 50_000  # likewise of their labels, which are soon found again
LENGTH = 160  # characters of a piece and what is made of it, to be remembered
STATES = 150_000  # letter states of one worker


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabularies of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


# The pattern below, for texts without letters or numbers beyond Latin Extended-A: the
# standard library splits those several times faster.
LATIN_OF = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\t-\\r \x85\xa0{_LETTERS}0-9]+")
BEYOND = re.compile("[\xb2\xb3\xb9\xbc-\xbe\u0180-\U0010ffff]")


class Automaton:
    """Tokens are numbered by their time: symbols first, then one a merge. The state behind a token has its number."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str = END) -> None:
        made = {a + b for a, b in merges}
        names = [t for t in vocabulary if t not in made]
        self.symbols = len(names)
        number = {t: i for i, t in enumerate(names)}
        self.left, self.right = array("i", [-1] * self.symbols), array("i", [-1] * self.symbols)
        self.lost: dict[int, int] = {}  # state << 20 | arc to the time when the gadget took it
        self.unmade: set[int] = set()
        for a, b in merges:
            self._gadget(number[a], number[b], number.setdefault(a + b, len(number)))
        self.id_of = array("i", [vocabulary[t] for t in number])
        self.labels = list(number)
        # Letters are bytes; a word's end mark is one more, which no token has alone.
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        self.trie: dict[int, int] = {}  # place << 9 | letter to place
        self.token_at = array("i", [-1])  # the arc whose label ends at a place of the trie
        self.length = array("i", [0] * len(number))  # letters of a label
        for t, i in number.items():
            if i not in self.unmade:
                ended = t.endswith(end)
                spelt = [byte_of[x] for x in (t[: -len(end)] if ended else t)]
                self._spell([*spelt, MARK] if ended else spelt, i)
        self._start()

    def _gadget(self, u: int, v: int, uv: int) -> None:
        self.left.append(u)
        self.right.append(v)
        # Where the automaton has no v behind u, earlier merges never leave the two side by side.
        if u in self.unmade or v in self.unmade or not self.has_arc(u, v):
            self.unmade.add(uv)
        else:
            self.lost[u << 20 | v] = uv

    def has_arc(self, x: int, y: int) -> bool:
        """Whether the state behind x has the arc y: no gadget took it from a state that x's is a copy of, nor y's from u."""
        left, right, lost, now = self.left, self.right, self.lost, len(self.left)
        while True:
            if lost.get(x << 20 | y, now) < now:
                return False
            if x > y:
                if x < self.symbols:
                    return True
                now, x = x, right[x]  # x's state was copied then
            else:
                if y < self.symbols:
                    return True
                now, y = y + 1, left[y]  # of equal merges the leftmost comes first, hence up to y's own time

    def _spell(self, label: list[int], token: int) -> None:
        place = 0
        for letter in label:
            place = self.trie.setdefault(place << 9 | letter, len(self.token_at))
            if place == len(self.token_at):
                self.token_at.append(-1)
        self.token_at[place] = token
        self.length[token] = len(label)

    def _start(self) -> None:
        """Letter tables with the start state only: one token may begin, in the state before all tokens."""
        self.next: dict[int, int] = {}  # state << 9 | letter to state
        self.label = array("i", [-1])
        # Of each state: token before (plus one) << 20 | place in the trie, 8 bytes for each begun token.
        self.begun = [bytes(8)]
        self.number: dict[bytes, int] = {}

    def _step(self, state: int, letter: int) -> int:
        """Fill in one transition."""
        begun, ends = array("q"), -1
        for item in memoryview(self.begun[state]).cast("q"):
            place = self.trie.get((item & 0xFFFFF) << 9 | letter)
            if place is not None:
                before = item >> 20
                begun.append(before << 20 | place)
                token = self.token_at[place]
                if ends < 0 <= token and (not before or self.has_arc(before - 1, token)):
                    ends = token
        if ends >= 0:
            begun.append(ends + 1 << 20)
        key = begun.tobytes()
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.begun)
            self.begun.append(key)
            self.label.append(ends)
        self.next[state << 9 | letter] = to
        return to

    def path(self, word: bytes) -> list[int]:
        """Tokens of one word (without the end mark)."""
        if len(self.begun) > STATES:
            self._start()
        table, state, states = self.next, 0, [0]
        for letter in (*word, MARK):
            to = table.get(state << 9 | letter)
            state = self._step(state, letter) if to is None else to
            states.append(state)
        labels, tokens, at = self.label, [], len(word) + 1
        while at:
            token = labels[states[at]]
            if token < 0:
                raise ValueError(f"no path for {word!r}")
            tokens.append(token)
            at -= self.length[token]
        tokens.reverse()
        return tokens


class Tokenizer:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.latin = LATIN.findall if pattern == LATIN_OF else None
        self.spec = {k: spec[k] for k in ("version", "normalizer")} | {"added_tokens": []}
        self.spec["pre_tokenizer"] = spec["pre_tokenizer"]["pretokenizers"][0]
        self.spec["model"] = {"type": "BPE", "vocab": {}, "merges": []}
        self.library = None  # its normaliser and splitter, once a text needs them
        self.decimal = [str(i) for i in self.automaton.id_of]
        self.label_of = {str(i): t for t, i in model["vocab"].items()}
        self.label_of |= {str(i): t for t, i in self.added.items()}
        self.known: dict[str, str] = _Known(self._piece, lambda: CACHE)  # piece to ids
        self.emitted: dict[str, str] = _Known(self._labels, lambda: EMITTED)  # ids to labels

    def _piece(self, piece: str) -> str:
        decimal = self.decimal
        return " ".join([decimal[t] for t in self.automaton.path(piece.encode("utf-8", "surrogatepass"))])

    def pieces(self, text: str) -> list[str]:
        """Normalised and split."""
        if self.latin and not BEYOND.search(text):  # no character there composes or is reordered
            return self.latin(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer as Library

            self.library = Library.from_str(json.dumps(self.spec))
        normal = self.library.normalizer.normalize_str(text)
        return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _plain(self, text: str) -> list[str]:
        return list(map(self.known.__getitem__, self.pieces(text)))

    def paths(self, text: str | None) -> list[str]:
        """The ids of each piece, in decimal with one space between."""
        if not text:
            return []
        if self.special is None or "<|" not in text:
            return self._plain(text)
        parts: list[str] = []
        for part in self.special.split(text):
            if part in self.added:
                parts.append(str(self.added[part]))
            elif part:
                parts += self._plain(part)
        return parts

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for path in self.paths(text) for i in path.split(" ")]

    def emit(self, paths: list[str]) -> str:
        """Decoded text: the labels of the paths' arcs, joined by one space."""
        return " ".join(map(self.emitted.__getitem__, paths))

    def decode(self, ids: list[int]) -> str:
        return self.emit([str(i) for i in ids])

    def _labels(self, path: str) -> str:
        return " ".join([self.label_of[i] for i in path.split(" ")])


class _Known(dict):
    """Pieces already made, in two generations: a full one takes the place of the one before it."""

    def __init__(self, make: Callable[[str], str], most: Callable[[], int]) -> None:
        super().__init__()
        self.make, self.most = make, most
        self.before: dict[str, str] = {}

    def __missing__(self, piece: str) -> str:
        made = self.before.get(piece)
        if made is None:
            made = self.make(piece)
        if len(piece) + len(made) <= LENGTH:
            if len(self) >= self.most():
                self.before = dict(self)
                self.clear()
            self[piece] = made
        return made


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    with open(path, encoding="utf-8") as f:
        return Tokenizer(f.read())


HELD.append(tokenizer.cache_clear)


def encode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids (array<int>), decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for part in _slices(batch):
                paths = [t.paths(x) for x in part.column(1).to_pylist()]
                joined = [" ".join(p) for p in paths]
                counts = np.array([x.count(" ") + 1 if x else 0 for x in joined], np.int64)
                flat = np.fromstring(" ".join(filter(None, joined)), dtype=np.int32, sep=" ")
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.record_batch(
                    {
                        "doc_id": part.column(0),
                        "n_tokens": pa.array(counts),
                        "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                        "decoded": pa.array(list(map(t.emit, paths)), pa.string()),
                    }
                )

    return _chosen(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode`` with its long columns hashed in place."""
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in (part for whole in batches for part in _slices(whole)):
            counts, of_ids, of_text = [], [], []
            for value in batch.column(1):
                paths = t.paths(value.as_py())
                ids = " ".join(paths)
                counts.append(ids.count(" ") + 1 if ids else 0)
                of_ids.append(sha256(ids.encode()).hexdigest())
                of_text.append(sha256(t.emit(paths).encode()).hexdigest())
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array(of_ids, pa.string()),
                    "decoded_sha256": pa.array(of_text, pa.string()),
                }
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _chosen(docs, id_col, text_col).mapInArrow(run, schema)


def _chosen(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)
    give_back()
