"""Round trips, brute force and edge cases of the row-wise operators."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import bpe, chat, decontaminate, langid, media, quality, sharding, urls, warc
from foliospark.llm.queries import FORGED, URL_RULES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, media string, __text string"
LONG = "lorem ipsum dolor " * 20_000


def documents(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 0, "clash", "clash") for i, t, la, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, LONG, "en", "a"), (None, "no id", "de", "b"), (4, "same", "en", "a")]
    return documents(spark, [*rows, (4, "same", "en", "a"), (5, "éü 日本 \x00\x01 <|im_end|> 😀", "fr", None)]).repartition(3)


# sharding


def test_sharding_law_and_mixture(spark):
    r = random.Random(1)
    rows = [(i, "x" * r.randrange(50), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(5000)]
    out = sharding.interleave(documents(spark, rows), 40).collect()
    by_shard = {}
    for x in out:
        by_shard.setdefault(x["shard"], []).append(x)
    counts = [len(v) for v in by_shard.values()]
    assert len(counts) == 40 and max(counts) - min(counts) <= 1
    for v in by_shard.values():
        assert sorted(x["slot"] for x in v) == list(range(len(v)))
        hot = sum(x["source"] == "hot" for x in v)
        assert abs(hot - len(v) * 2 / 3) <= 2  # the mixture holds in every shard
    assert sorted(x["doc_id"] for x in out) == list(range(5000))
    sizes = {i: len(t) for i, t, _, _ in rows}
    assert all(x["size"] == sizes[x["doc_id"]] for x in out)
    assert out and {(x["doc_id"], x["text_crc32"]) for x in out} == {(i, zlib.crc32(t.encode())) for i, t, _, _ in rows}


def test_sharding_edges(spark, odd):
    out = sharding.interleave(odd, 3).collect()
    assert len(out) == 7 and sorted(x["pos"] for x in out) == list(range(7))
    assert sharding.interleave(odd.limit(0), 3).count() == 0


def test_sharding_of_rows_without_ids(spark):
    """A hundred thousand rows of one (null) id, most of them equal: the law holds and no bucket is large."""
    rows = spark.range(100_000).select(
        F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("same").alias("text"), F.lit("s").alias("source")
    )
    rows = rows.unionByName(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("t").alias("source")))
    out = sharding.interleave(rows, 40)
    per = out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("k"), F.max("slot").alias("last")).collect()
    assert {x["n"] for x in per} == {2512, 2513} and all(x["n"] == x["k"] == x["last"] + 1 for x in per) and len(per) == 40
    mixed = out.filter("source = 't'").groupBy("shard").count().collect()
    assert {x["count"] for x in mixed} <= {12, 13}
    hashed = rows.select(F.lit("s").alias("stratum"), sharding.seeded_hash(17, F.col("doc_id")).alias("h"), F.monotonically_increasing_id().alias("u"))
    assert sharding.bucketed(hashed, 49, 2048).groupBy("stratum", "hb", "cut").count().agg(F.max("count")).first()[0] < 3000


# media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1417, 1418, 5000, 100_000])
def test_media_round_trip(n):
    payload = media.padded(bytes(random.Random(n).randbytes(n)))
    found = media.parse(media.carry(payload))
    assert found.payload == payload and len(payload) % 64 == 0 and len(payload) >= 64
    assert (found.crc_bad, found.skipped) == (0, 0) and found.crc_ok == found.frames == found.table_frames
    assert found.samples == 1152 * found.frames


def test_media_payload_that_looks_like_frames_and_tags():
    for text in (b"TAG" + bytes(125), bytes([0xFF, 0xFB, 0x90, 0xC0]) * 900, b"ID3" * 500, b"x" * 1289 + b"TAG" + b"y" * 125):
        payload = media.padded(text)
        assert media.parse(media.carry(payload)).payload == payload


def test_media_resynchronises_and_counts_damage():
    payload = media.padded(bytes(range(256)) * 40)
    whole = media.carry(payload)
    frames = media.parse(whole)
    start = frames.offsets[0]
    noisy = whole[:start] + b"noise\xff\xe0junk" + whole[start:] + b"TAG" + b"A title".ljust(125, b"\0")
    found = media.parse(noisy)
    assert found.payload == payload and found.skipped == len(b"noise\xff\xe0junk") and found.tags["TIT2"] == "A title"
    assert found.offsets == [o + 11 for o in frames.offsets]
    broken = bytearray(whole)
    broken[frames.offsets[1] + 8] ^= 1  # side information, which the checksum covers
    assert media.parse(bytes(broken)).crc_bad == 1
    cut = media.parse(whole[:-100])
    assert cut.frames == frames.frames - 1
    assert media.parse(b"").frames == media.parse(b"\xff" * 100).frames == 0


def test_media_headers_of_other_kinds():
    for version, layer, want in ((3, 3, 417), (2, 3, 208), (3, 1, 136), (3, 2, 470)):
        index = {(3, 3): 9, (2, 3): 8, (3, 1): 5, (3, 2): 9}[version, layer]
        head = bytes([0xFF, 0xE0 | version << 3 | (4 - layer) << 1 | 1, index << 4, 0])
        found = media.header(head)
        assert found.layer == layer and abs(found.size - want) <= 60
    assert media.header(b"\xff\xfb\xf0\x00") is None and media.header(b"\xff\xfb\x90\x02") is None
    vbri = bytes([0xFF, 0xFB, 0x90, 0]) + bytes(32) + b"VBRI" + bytes(6) + (999).to_bytes(4, "big") + (7).to_bytes(4, "big")
    assert media.read_table(vbri, 0, media.header(vbri[:4])) == (True, 7, 999)


def test_media_columns(spark, odd):
    found = media.with_media(odd).withColumn("m", media.load_media(media.F.col("media"))).collect()
    for x in found:
        assert bytes(x["m"]["payload"]) == media.padded((x["text"] or "").encode())
        assert x["m"]["duration"] == x["m"]["samples"] / 32000


# urls


def brute_verdicts(rows):
    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        m = re.fullmatch(r"([^/?#]*)(/[^?#]*)?.*", u.split("://", 1)[1], re.S)
        return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2] or ""

    def rule(h, p):
        fits = [r for r in URL_RULES if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        return max(fits, key=lambda r: len(r.name), default=None)

    def codes(u):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in u or "")
        c = [63] * 5 + [urls.ALPHABET.find(x) + 1 for x in low]
        return [tuple(c[i : i + 6]) for i in range(len(c) - 5)]

    judged = [(i, u, *parts(u), rule(*parts(u))) for i, u in rows]
    counts = {0: {}, 1: {}}
    for _, u, _, _, r in judged:
        if r and zlib.crc32(u.encode()) % 5:
            for g in codes(u):
                table = counts[int(r.verdict == "allow")]
                table[g] = table.get(g, 0) + 1

    def prob(table, code, order=5):
        if order < 0:
            return 1 / 64
        here = {}
        for g, n in table.items():
            if g[5 - order : 5] == code[5 - order : 5]:
                here[g[5]] = here.get(g[5], 0) + n
        lower = prob(table, code, order - 1)
        total = sum(here.values())
        return (here.get(code[5], 0) + len(here) * lower) / (total + len(here)) if total else lower

    memo = {}

    def ratio(g):
        if g not in memo:
            memo[g] = math.log(prob(counts[1], g)) - math.log(prob(counts[0], g))
        return memo[g]

    return [(i, h, p, r.name if r else None, r.verdict if r else None, (sum(map(ratio, codes(u))) / len(codes(u)) if codes(u) else 0.0)) for i, u, h, p, r in judged]


@pytest.mark.parametrize("known", [urls.KNOWN_GRAMS, 1])
def test_urls_equal_brute_force(spark, monkeypatch, known):
    monkeypatch.setattr(urls, "KNOWN_GRAMS", known)
    r = random.Random(4)
    rows = [(None, None), (1, ""), (2, "no scheme"), (3, "http://EXAMPLE.net/en/x"), (4, "http://x.net"), (5, "http://notnet/"), (6, "ftp://a.org/fr/?q#f"), (7, "http://b.org?x/fr/")]
    for i in range(8, 200):
        host = r.choice(["spam.net", "www.example.net", "example.com", "good.org", "cheap-spam.com", "info.com"])
        rows.append((i, f"https://{host}/{r.choice(['en', 'de', 'fr'])}/{r.choice(['win', 'news', 'Ärger'])}{r.randrange(99)}"))
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    out = {(x["page_id"], x["host"], x["path"], x["rule"]): x for x in urls.judge(df, URL_RULES).collect()}
    want = brute_verdicts(rows)
    assert len(out) == len(rows)
    for i, h, p, rule, verdict, score in want:
        x = out[i, h, p, rule]
        assert abs(x["score"] - score) < 1e-5
        assert x["verdict"] == (verdict or ("allow" if x["score"] >= x["cut"] else "block"))
    assert urls.judge(df.limit(0), URL_RULES).count() == 0
    twice = urls.judge(df.union(df).union(df.limit(0)), URL_RULES)
    assert twice.count() == 2 * len(rows) and twice.distinct().count() == len(rows)
    unlabelled = urls.judge(df.filter("url LIKE '%info.com%'"), URL_RULES).collect()
    assert unlabelled and all(x["score"] == 0 and x["verdict"] == "allow" for x in unlabelled)


# bpe


def test_bpe_equals_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_path()), bpe.tokenizer(tokenizer_path())
    r = random.Random(9)
    alphabets = ["aaabbe", "etaoin's <|endoftext|> <|startoftext|>ABCxyz0123 !?.,\t\n", "éüß日本語한İΣςΏ 　😀'\"<|>\x00\x1c‍²½ŁƠ"]
    texts = ["".join(r.choice(a) for _ in range(r.randint(0, 70))) for a in alphabets for _ in range(3000)]
    texts += ["", "a" * 3000, "ha" * 900, "<|endoftext|>x<|startoftext|>", "ΑΣ ΑΣΑ", "ab́cd", "x" * 200_000]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text) == want.ids, text
        assert own.emit(own.paths(text)) == own.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_equals_library_at_every_kind_of_character():
    """Alone, doubled between letters, and with two marks; ideographs, syllables and unassigned ones one in 64."""
    import unicodedata

    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_path()), bpe.tokenizer(tokenizer_path())
    many = {"Cn", "Co", "Lo"}
    kept = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in many or c < 0x3100 or c % 64 == 0]
    texts = [f"a{x}{x}b {x}\u0334\u0301 {x}" for x in map(chr, kept) if not 0xD800 <= ord(x) < 0xE000]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text) == want.ids, ascii(text)


def test_letter_tables_start_anew_when_full(monkeypatch):
    own = bpe.Tokenizer(open(tokenizer_path(), encoding="utf-8").read())
    words = ["".join(random.Random(i).choice("etaoins") for _ in range(9)) for i in range(400)]
    want = [own.automaton.path(w.encode()) for w in words]
    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(bpe, "CACHE", 7)
    assert [own.automaton.path(w.encode()) for w in words] == want
    assert [own.encode(w) for w in words * 2] == [[own.automaton.id_of[t] for t in p] for p in want] * 2


def test_tables_of_a_worker_are_small():
    """What is kept after very many different words: pieces, labels and letter tables."""
    import sys

    own = bpe.Tokenizer(open(tokenizer_path(), encoding="utf-8").read())
    pick = random.Random(5)
    for _ in range(400):
        own.emit(own.paths(" ".join("".join(pick.choices("etaoinshrdlu", k=9)) for _ in range(400))))
    letters, counted = own.automaton, {}
    for table in (own.known, own.known.before, own.emitted, own.emitted.before, letters.next, letters.number):
        counted[id(table)] = sys.getsizeof(table)
        counted |= {id(x): sys.getsizeof(x) for entry in table.items() for x in entry}
    for state in letters.begun:  # a tuple of integers has those beside it
        counted[id(state)] = sys.getsizeof(state)
        if isinstance(state, tuple):
            counted |= {id(x): sys.getsizeof(x) for x in state}
    assert sum(counted.values()) < 80e6


def test_automaton_of_few_merges_is_exact():
    """Every word over a small alphabet, against merging by rank."""
    import itertools

    merges = [("a", "b"), ("b", "a</w>"), ("a", "a"), ("ab", "ab"), ("aa", "b"), ("b", "ab"), ("aa", "aa")]
    vocabulary = {t: i for i, t in enumerate(["a", "b", "a</w>", "b</w>", *(x + y for x, y in merges)])}
    own = bpe.Automaton(vocabulary, merges)
    for n in range(1, 11):
        for word in itertools.product("ab", repeat=n):
            parts = [*word[:-1], word[-1] + "</w>"]
            while True:
                ranks = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
                if not ranks:
                    break
                k, _ = min(ranks)
                merged, i = [], 0
                while i < len(parts):
                    hit = i + 1 < len(parts) and (parts[i], parts[i + 1]) == merges[k]
                    merged.append(parts[i] + parts[i + 1] if hit else parts[i])
                    i += 2 if hit else 1
                parts = merged
            assert [own.labels[t] for t in own.path("".join(word).encode())] == parts


def test_bpe_columns(spark, odd):
    own = bpe.tokenizer(tokenizer_path())
    for x in bpe.encode(odd, tokenizer_path()).collect():
        assert x["n_tokens"] == len(x["ids"]) and own.decode(x["ids"]) == x["decoded"]
    short = {x["doc_id"]: x for x in bpe.digests(odd, tokenizer_path()).collect()}
    assert short[1]["n_tokens"] == short[2]["n_tokens"] == 0
    assert short[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(odd.limit(0), tokenizer_path()).count() == 0


# warc


def test_warc_rejects_magic_inside_payloads(spark, tmp_path):
    forged = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    same = "copy " * 40
    rows = [(1, "http://a", forged * 3), (2, "http://b\r\nWARC-Type: x", None), (3, None, same), (9, "u", same), (5, "u", same), (5, "u", same), (None, "u", same)]
    rows += [(10 + i, "u", "short") for i in range(3)] + [(20, "u", LONG), (21, "u", "é日\r\n\r\n😀"), (22, "u", "\n" * 50 + "WARC/1.1\r\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string").repartition(2)
    warc.write(df, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(back) == len(rows)
    got = sorted((x["page_id"] or -1, x["payload_bytes"], x["record_type"], x["refers_to"]) for x in back)
    want = []
    for i, _, html in rows:
        n = len((html or "").encode())
        again = html == same and i != 3
        want.append((i or -1, n, "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=lambda t: (t[0], t[1], t[2], t[3] or 0))
    for x in back:
        if x["record_type"] == "response":
            assert x["digest"] == hashlib.sha256(bytes(x["payload"])).hexdigest() == x["payload_sha256"]
    found = warc.candidates(spark, str(tmp_path / "w"), payload=False)
    assert found.filter("page_id = 666").count() == 3  # seen, and not reached


def test_warc_in_ranges(spark, tmp_path):
    """Files read in ranges of 64 KiB: records over the bound, magic on and inside their edges, garbage at the end."""
    r = random.Random(6)
    forged = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    texts = ["".join(r.choice(["a", "é", "\r\n\r\n", "WARC/1.1\r\n", forged, "xyz " * 50]) for _ in range(r.choice([1, 5, 40, 900]))) for _ in range(150)]
    df = spark.createDataFrame([(i, "http://u", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    warc.write(df.coalesce(1), str(tmp_path / "w"), least=1 << 40)
    file = next((tmp_path / "w").glob("*.txt"))
    assert file.stat().st_size > 8 << 16
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "w.txt").write_bytes(file.read_bytes() + b"garbage " * 9)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 16))
    try:
        back = {x["page_id"]: x for x in warc.read(spark, str(tmp_path / "g")).collect()}
        short = warc.read(spark, str(tmp_path / "g"), payload=False)
        assert {x["page_id"]: x["payload_sha256"] for x in short.collect()} == {i: x["payload_sha256"] for i, x in back.items()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {i: bytes(x["payload"]).decode() for i, x in back.items()} == dict(enumerate(texts))
    assert all(x["payload_bytes"] == len(texts[i].encode()) and x["digest"] == x["payload_sha256"] for i, x in back.items())


def test_warc_empty_and_cut(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(none, str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0
    warc.write(spark.createDataFrame([(i, "u", f"page {i}") for i in range(9)], none.schema).coalesce(1), str(tmp_path / "c"))
    file = next((tmp_path / "c").glob("*.txt"))
    data = file.read_bytes()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "cut.txt").write_bytes(data[:-20])
    assert warc.read(spark, str(tmp_path / "d")).count() == 8


def test_pointer_jumping():
    offset = np.array([0, 5, 10, 12, 30, 31])
    assert warc.reachable(offset, np.array([10, 12, 30, 31, 40, 50])).tolist() == [True, False, True, False, True, False]
    chain = np.arange(0, 5000)
    assert warc.reachable(chain, chain + 1).all()
    assert not warc.reachable(chain + 1, chain + 2).any()


# chat


def test_chat_escapes_are_reversible():
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice(["<|", "|>", "\\", "<", "|", "im_end", "\n", "n", "a", "é", FORGED]) for _ in range(r.randint(0, 12)))
        role = "".join(r.choice(["user", "\n", "\\", "n", "<|"]) for _ in range(3))
        piece, start, span, _ = chat.format_turn(role, [{"type": "text", "text": text}])
        assert chat.parse_turn(piece) == (role, text)
        assert piece.count("<|") == 2 and span == 0
        piece, start, span, _ = chat.format_turn("assistant", [{"type": "text", "text": text}])
        assert chat.unescape(piece[start : start + span]) == text


def test_chat_visits_typed_parts(spark):
    import json

    parts = [
        {"type": "text", "text": "see <|image_0|>"}, {"type": "image", "ref": "a.png", "width": 28, "height": 15},
        {"type": "audio", "ref": "b.mp3", "seconds": 2.01}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "text", "text": None},
    ]
    df = spark.createDataFrame([(1, 0, "user", "unused", json.dumps(parts))], "conv_id long, turn long, role string, text string, parts string")
    row = chat.format_turns(df, parts_col="parts").first()
    assert "see <\\|image_0|><|image_0|><|audio_1|><|document_2|>" in row["piece"]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "a.png", 4), ("audio", "b.mp3", 51), ("document", "c.pdf", 1536)]


def test_chat_reads_parts_back(spark):
    """Texts that look like attachments, malformed parts, sizes that are none."""
    parts = [{"type": "text", "text": "a<|image_0|>\\"}, {"type": "image", "width": "28", "height": None}, {"type": "video", "ref": 5, "pages": 1e400}, {"text": "x"}]
    piece, _, _, attached = chat.format_turn("user", [*parts, "plain", 7, None, ["l"], {"type": "text", "text": {"a": 1}}])
    assert chat.parse_parts(piece) == ("user", [("text", "a<|image_0|>\\"), ("image", 0), ("document", 1), ("document", 2), ("text", 'plain7null["l"]{"a": 1}')])
    assert [(a["ref"], a["tokens"]) for a in attached] == [(None, 1), ("5", 512), (None, 512)]
    assert chat.parse_parts(chat.format_turn("assistant", [])[0]) == ("assistant", [])
    given = ["{broken", "[1, ", '"only"', '{"type": "audio", "seconds": true}', "[]", "", None, "null"]
    rows = [(1, i, "user", "own", p) for i, p in enumerate(given)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts string")
    read = {x["turn"]: x for x in chat.attachments(chat.format_turns(df, parts_col="parts")).collect()}
    assert [read[i]["texts"] for i in range(8)] == ["{broken", "[1, ", "only", "", "", "own", "own", "null"]
    assert [read[i]["placeholders"] for i in range(8)] == ["", "", "", "audio_0", "", "", "", ""] and read[3]["tokens"] == 1


def test_chat_read_back(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 2, "assistant", "a<|im_end|>"), (2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", chat.F.lit(1)).repartition(3)
    out = {x["conv_id"]: x for x in chat.read_back(chat.format_turns(df)).collect()}
    assert out[1]["turns_sha256"] == hashlib.sha256(b"user\nq\nassistant\n\nassistant\na<|im_end|>\n").hexdigest()
    assert out[1]["loss_chars"] == 11 and out[1]["loss_sha256"] == hashlib.sha256(b"a<|im_end|>").hexdigest()
    assert out[2]["n_turns"] == 2 and out[2]["loss_chars"] == 0 and out[None]["loss_chars"] == 1
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# quality


def prose(r, n):
    return " ".join(r.choice("the of and river stone walked slowly toward old house with morning light over hills".split()) for _ in range(n)).capitalize() + "."


def labelled(spark, n=600):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(r, r.randint(20, 120))
        if bad:
            text = r.choice([text.upper().replace(" ", "!! "), " ".join([text.split()[0]] * 60), text.replace(" ", "### ")])
        rows.append((i, text, "en", "a"))
        labels.append((i, int(not bad), 0))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark, odd):
    docs, labels = labelled(spark)
    model = quality.fit_labelled(docs, labels)
    scored = {x["doc_id"]: x["score"] for x in quality.score(docs, model).collect()}
    held = [i for i in scored if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((scored[i] >= 0.5) == (i % 4 != 0) for i in held) / len(held) > 0.97
    assert all(0 <= x["score"] <= 1 for x in quality.score(odd, model).collect())
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s >= 0.5 for s in scored.values())
    assert not any(x["h"] is None or (x["doc_id"] is None and x["h"]) for x in odd.select("doc_id", quality.held_out(quality.F.col("doc_id")).alias("h")).collect())
    hot = docs.unionByName(documents(spark, [(2, "zz again and again", "en", "a")] * 2000))
    assert [x["score"] for x in quality.score(docs, quality.fit_labelled(hot, labels)).orderBy("doc_id").collect()] == [scored[i] for i in sorted(scored)]
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    again = quality.fit_labelled(docs, flipped)
    assert [x["score"] for x in quality.score(docs, again).orderBy("doc_id").collect()] == [scored[i] for i in sorted(scored)]


def test_quality_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_labelled(odd, none)
    assert {x["score"] for x in quality.score(odd, model).collect()} == {0.5}
    assert quality.score(odd.limit(0), model).count() == 0


def test_pairs_learn_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9
    assert {frozenset(p[:2]) for p in model.pairs} >= {frozenset((0, 2))}


# language


VOCABULARY = {"en": "the house of morning and water with light", "de": "der fluss und das haus mit licht über wasser", "fr": "la maison et le fleuve avec lumière du matin"}


def spoken(r, lang, n=40):
    return " ".join(r.choice(VOCABULARY[lang].split()) for _ in range(n))


def test_language_fuses_evidence(spark):
    r = random.Random(8)
    rows = []
    for i in range(600):
        lang = r.choice(list(VOCABULARY))
        declared = lang if r.random() < 0.9 else r.choice(list(VOCABULARY))
        rows.append((i, spoken(r, lang), declared, f"https://{lang}{i % 5}.example.{lang}/x", lang))
    rows += [(1000, None, "en", None, "und"), (1001, "12 34 !!", "en", None, "und"), (1002, "", None, "not a url", "und")]
    # A text of three letters says little: its host decides, whatever is declared.
    rows += [(1003, "haus"[:3], None, "https://de1.example.de/y", "de")]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, lang string, url string, truth string, language string")
    out = langid.identify(df, url_col="url", host_col=None).collect()
    assert len(out) == len(rows)
    wrong = [x["doc_id"] for x in out if x["language"] != x["truth"]]
    assert len(wrong) <= 3 and not {1000, 1001, 1002, 1003} & set(wrong)
    assert all(x["accepted"] == (x["truth"] != "und") for x in out if x["doc_id"] not in wrong)
    kept = langid.identify(df, only_accepted=True, url_col="url", host_col=None)
    assert kept.columns == df.columns and kept.count() == sum(x["accepted"] for x in out)


def test_language_keeps_rare_languages(spark):
    r = random.Random(5)
    rows = [(i, spoken(r, "en" if i % 2 else "de", 12), "en" if i % 2 else "de", None) for i in range(12_000)]
    rows += [(None if i % 2 else 20_000 + i, spoken(r, "fr", 12), "fr", None) for i in range(90)]  # under a hundredth
    out = langid.identify(documents(spark, rows)).filter("lang = 'fr'").collect()
    assert len(out) == 90 and sum(x["language"] == "fr" and x["accepted"] for x in out) >= 88
    many = spark.createDataFrame([(i, f"text of {i % 70}", f"l{i % 70}") for i in range(700)], "id long, text string, declared string")
    assert len(langid.fit_text(many, 8000).languages) == 70


def test_language_on_twenty_of_three_thousand_rows_without_ids(spark):
    r = random.Random(15)
    rows = [(None, spoken(r, "en" if i % 2 else "de", 20), "en" if i % 2 else "de", None) for i in range(2980)]
    rows += [(None, spoken(r, "fr", 20), "fr", None) for _ in range(20)]
    out = langid.identify(documents(spark, rows), sample=500).collect()
    assert sum(x["language"] == x["lang"] and x["accepted"] for x in out) >= 2990
    assert sum(x["language"] == "fr" and x["accepted"] for x in out if x["lang"] == "fr") == 20


def test_language_whose_rows_are_all_alike(spark):
    rows = [(None, "the house of morning and water", "en", None)] * 3000 + [(1, "der fluss und das haus", "de", None)] * 6
    out = langid.identify(documents(spark, rows), sample=2).collect()
    assert all(x["language"] == x["lang"] for x in out)


def test_language_equals_plain_python(spark):
    """The fusion once more, row by row with dictionaries."""
    r = random.Random(23)
    rows = []
    for i in range(240):
        lang = r.choice(list(VOCABULARY))
        host = r.choice([f"a{i % 3}.example.{lang}", f"b.other.{r.choice(['de', 'en'])}", "nodots", None])
        said = r.choice([lang, lang, lang, "de", "xx", None])
        rows.append((i, spoken(r, lang, r.choice([1, 2, 20])), said, host and f"https://{host}/p"))
    rows += [(900, "", "en", None), (901, None, None, "https://b.other.de/"), (902, "7 8", "fr", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string")
    got = {x["doc_id"]: x for x in langid.identify(df, url_col="url", host_col=None).collect()}

    def trigrams(text):
        low = [b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]
        low = [b if 97 <= b <= 122 or b >= 128 else 32 for b in low]
        for x, y, z in zip(low, low[1:], low[2:]):
            if y != 32:
                yield ((((x * 65599 + y) * 65599 + z) % 2**32) * 0x9E3779B1 % 2**32) >> 16

    names = sorted({d for _, _, d, _ in rows if d and sum(x[2] == d for x in rows) >= langid.LANGUAGE_ROWS})
    assert names == ["de", "en", "fr", "xx"]
    texts = {i: f" {t or ''} " for i, t, _, _ in rows}
    counts = {n: {} for n in names}
    for i, _, d, _ in rows:
        for c in trigrams(texts[i]) if d in counts else ():
            counts[d][c] = counts[d].get(c, 0) + 1
    most = max(sum(c.values()) for c in counts.values())

    def log_p(n, c):
        total = sum(counts[n].values())
        return math.log((counts[n].get(c, 0) * most / total + 0.5) / (most + 0.5 * langid.BUCKETS))

    def softmax(v):
        e = [math.exp(x - max(v)) for x in v]
        return [x / sum(e) for x in e]

    text = {i: [langid.TEMPER * sum(log_p(n, c) for c in trigrams(texts[i])) for n in names] for i in texts}
    own = {i: softmax(v) if any(v) else [0.0] * len(names) for i, v in text.items()}
    host_of = {i: re.match("https://([^/]*)", u)[1] if u else None for i, _, _, u in rows}
    end_of = {i: h.split(".")[-1] if h and "." in h else None for i, h in host_of.items()}
    declared = {i: d for i, _, d, _ in rows}
    add = lambda ids: [sum(own[i][k] for i in ids) for k in range(len(names))]
    agree = {d: [0.5 + x for x in add([i for i in own if declared[i] == d])] for d in names}
    agree[None] = [0.5] * len(names)  # any other declared value
    whole = [sum(v[k] for v in agree.values()) for k in range(len(names))]
    overall = [w - 0.5 * len(agree) + 1.0 for w in whole]
    overall = [x / sum(overall) for x in overall]
    for i in own:
        prior = overall
        for of in (end_of, host_of):
            if of[i] is not None:
                left = [max(a - b, 0.0) for a, b in zip(add([j for j in own if of[j] == of[i]]), own[i])]
                prior = [(x + langid.PRIOR_ROWS * q) / (sum(left) + langid.PRIOR_ROWS) for x, q in zip(left, prior)]
        score = [t + math.log(max(q, 1e-9)) for t, q in zip(text[i], prior)]
        if declared[i] is not None:
            score = [v + math.log(agree[declared[i]][k] / whole[k]) for k, v in enumerate(score)]
        post = softmax(score)
        best = max(range(len(names)), key=lambda k: post[k])
        if any(text[i]):
            assert got[i]["language"] == names[best] and abs(got[i]["confidence"] - post[best]) < 1e-4, i
        else:
            assert got[i]["language"] == "und" and not got[i]["accepted"]


def test_language_reads_markup(spark):
    pages = ["<!DOCTYPE html><HTML class=x LANG='en-GB'><style>p{der}</style><body>The&nbsp;house<script>fluss()</script></body>", "<html><p lang=de>x</p>", None, ""]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    got = df.select(*langid.from_markup(langid.F.col("html"))).collect()
    assert [x[0] for x in got] == ["en", None, None, None]
    assert [x[1].split() for x in got] == [["The", "house"], ["x"], [], []]


def test_language_edges(spark, odd):
    assert langid.identify(odd).count() == 7
    assert langid.identify(odd.limit(0)).count() == 0
    none = odd.withColumn("lang", langid.F.lit(None).cast("string"))
    assert {x["language"] for x in langid.identify(none).collect()} == {"und"}


def test_language_salted_join_is_the_same(spark, monkeypatch):
    r = random.Random(3)
    df = documents(spark, [(i, spoken(r, "en" if i % 2 else "de", 6), "en" if i % 2 else "de", f"s{i % 4}") for i in range(200)])
    small = sorted((x["doc_id"], x["language"], round(x["confidence"], 9)) for x in langid.identify(df).collect())
    monkeypatch.setattr(langid, "KNOWN_HOSTS", 1)
    assert sorted((x["doc_id"], x["language"], round(x["confidence"], 9)) for x in langid.identify(df).collect()) == small


# decontamination


ITEM = "Tom Baker bought 12 apples for 3 dollars at the market and gave Mary 4 apples before he walked 5 km home with the other 8 apples in his old bag"


def leaked(spark, texts, items=(ITEM, "Yes 1 2", "The quick brown fox jumps over the lazy dog near the river bank today")):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(x["doc_id"], x["item_id"]): x for x in decontaminate.leaks(docs, bench).collect()}


def test_decontamination_finds_reworded_items(spark):
    other = ITEM.replace("Tom Baker", "Ann Miller").replace("Mary", "Paul").replace("12", "15").replace("km", "miles").replace("8", "11")
    torn = " ".join(w if i % 5 else "filler" for i, w in enumerate(ITEM.split()))
    prose_text = "nothing of that kind stands in this text about rivers and stones and other things " * 5
    texts = [ITEM, f"{prose_text}\n{ITEM.upper().lower()}\n{prose_text}", f"Intro. {other} Outro.", torn, prose_text, None, "", LONG + ITEM, "Yes 1 2", "No 7 9"]
    found = leaked(spark, texts)
    assert (0, 0) in found and (7, 0) in found and (2, 0) in found and found[2, 0]["reworded"] and not found[0, 0]["reworded"]
    assert not {d for d, _ in found} & {3, 4, 5, 6, 9}
    assert (8, 1) in found


def test_decontamination_checks_slots(spark):
    item = "a train leaves with 5 cars and loses 7 cars so that 5 and 7 give the answer"
    same = item.replace("5", "6").replace("7", "9")
    mixed = "a train leaves with 6 cars and loses 9 cars so that 9 and 6 give the answer"
    found = leaked(spark, [same, mixed], (item,))
    assert set(found) == {(0, 0)}


def test_decontamination_is_blind_to_case(spark):
    item = "Élodie Straße asked Ángel Óscar and Zoë Müller where Île Saint Louis lies before they went to Łódź and Århus"
    texts = [f"so it goes {x} and so on" for q in (ITEM, item) for x in (q.upper(), q.lower(), q.title())]
    found = leaked(spark, texts, (ITEM, item))
    assert set(found) == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1)}
    assert all(x["coverage"] == 1 and not x["reworded"] for x in found.values())


def test_decontamination_of_items_inside_a_line(spark):
    items = ("Tom paid 12 dollars for apples today", "He gave Mary five red apples from his old basket")
    texts = [f"we heard that {items[0]} and left", "we heard that Tom paid 15 dollars for apples today and left", f"we heard that {items[1]} and left"]
    texts += ["then He gave\nAnna five red apples from his old basket", "we heard that Ann paid 15 dollars for apples today and left"]
    found = leaked(spark, texts, items)
    assert set(found) == {(0, 0), (1, 0), (2, 1), (3, 1)}
    assert [found[k]["reworded"] for k in sorted(found)] == [False, True, False, True]


def test_decontamination_in_other_languages(spark):
    """Names with capitals beyond ASCII, nouns in capitals, units of each language."""
    asked = {
        "Combien de pommes Élodie Çağlar peut-elle acheter avec 12 euros si chaque pomme coûte 3 euros et elle marche 5 heures": [("Élodie Çağlar", "Özge Éric"), ("12", "20"), ("5 heures", "7 jours")],
        "Wenn Ömer am Montag 14 Äpfel kauft und sie nach 3 Tagen mit Jürgen teilt wie viele hat er dann noch zu essen": [("Ömer", "Änne"), ("14", "18"), ("3 Tagen", "5 Wochen")],
        "Сколько яблок купил Иван на рынке если у него было 15 рублей и он отдал половину друзьям по имени Жанна потом": [("Иван", "Щукин"), ("15", "27"), ("Жанна", "Юлия")],
    }
    texts = []
    for item, changes in asked.items():
        for old, new in changes:
            item = item.replace(old, new)
        texts.append(f"davor steht dies und {item} danach")
    found = leaked(spark, texts, tuple(asked))
    assert set(found) == {(0, 0), (1, 1), (2, 2)} and all(x["reworded"] for x in found.values())


def test_decontamination_finds_short_runs_of_long_items(spark):
    r = random.Random(31)
    words = [f"{a}{b}" for a in ("ba", "lo", "mi", "ter", "su") for b in ("na", "so", "ri", "ke", "du")]
    item = [r.choice(words) for _ in range(120)]
    texts = [" ".join(["x y z", *item[40 : 40 + n], "z y x"]) for n in (13, 12, 30)]
    assert set(leaked(spark, texts, (" ".join(item),))) == {(0, 0), (2, 0)}


def test_decontamination_judges_rows(spark):
    """Null ids, and an id whose other text leaks."""
    bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    rows = [(None, ITEM), (None, "a clean one"), (None, ITEM), (5, f"so {ITEM}"), (5, "clean too"), (6, None)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, h int, row int").repartition(2)
    assert sorted((x["doc_id"] or -1, x["item_id"]) for x in decontaminate.leaks(docs, bench).collect()) == [(-1, 0), (5, 0)]
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((x["doc_id"] or -1, x["text"] or "") for x in kept.collect()) == [(-1, "a clean one"), (5, "clean too"), (6, "")]


def test_decontamination_equals_plain_matching_of_words(spark):
    """Passages as they are, against every window of every document and item compared one by one."""
    r = random.Random(17)
    words = [f"{a}{b}" for a in ("ba", "lo", "mi", "ter") for b in ("na", "so", "ri", "ke")]
    items = [[r.choice(words) for _ in range(r.choice([3, 8, 12, 25]))] for _ in range(12)]
    texts = []
    for _ in range(120):
        item, own = r.choice(items), [r.choice(words) for _ in range(r.randint(0, 30))]
        a = r.randrange(len(item))
        cut = r.randint(0, len(own))
        texts.append(own[:cut] + item[a : a + r.randint(1, len(item))] + own[cut:])
    want = set()
    for i, item in enumerate(items):
        w = min(8, len(item))
        places = [tuple(item[k : k + w]) for k in range(len(item) - w + 1)]
        for d, text in enumerate(texts):
            have = {}
            for k in range(len(text) - w + 1):
                have.setdefault(tuple(text[k : k + w]), []).append(k)
            hit = [k for k, x in enumerate(places) if x in have]
            row = max((n for n in range(1, len(places) + 1) for k in range(len(places) - n + 1) for at in have.get(places[k], []) if all(at + j in have.get(places[k + j], []) for j in range(n))), default=0)
            if len(hit) / len(places) >= 0.3 and len(hit) >= min(3, len(places)) or row and row + w - 1 >= 13:
                want.add((d, i))
    assert want and set(leaked(spark, [" ".join(t) for t in texts], tuple(" ".join(x) for x in items))) == want


def test_decontamination_edges(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "same"), (None, "no id")], "item_id long, text string")
    assert [(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(odd, bench).collect()] == [(4, 3)]
    assert decontaminate.clean(odd, bench).count() == 5
    assert decontaminate.leaks(odd.limit(0), bench).count() == 0 and decontaminate.leaks(odd, bench.limit(0)).count() == 0
    assert pa.types.is_string(pa.string())
