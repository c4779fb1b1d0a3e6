import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from veilspark.llm import bpe, packing
from veilspark.llm.wordcache import BYTE_UNIT, KNOWN, WORD_UNIT, Ranked, UnitIds, by_ranks, load

BYTE, WORD = (public_tokenizers.path(f"{x}.json") for x in ("byte_bpe_50k", "word_bpe_49k"))
TEXTS = [
    None, "", " ", "Hello, World's end", "naïve café – 12½ €", "汉字 テスト mixed", "áé Å", "tail   ", "\n\n  x\t\ty", "<|endoftext|>", "aa<|endoftext|> <|startoftext|>b",
    "x" * 40_000, "ab1!" * 9_000, " " * 20_000 + "end", "é" * 10_001 + "<|endoftext|>" + "z" * 9_000 + " plain words after", "word " * 20_000, "I'LL İstanbul ΣΑΣ",
    "".join(random.Random(5).choice("abcdefgh") for _ in range(30_000)), "汉" * 9_500,
]


def test_units_agree_with_the_library_for_every_known_code_point():
    for path, pattern in ((BYTE, BYTE_UNIT), (WORD, WORD_UNIT)):
        t = load(path)
        units = UnitIds(t, pattern, list)
        for p in KNOWN:
            for s in (f"a{chr(p)}b", f"1{chr(p)}2", f"!{chr(p)}?", f" {chr(p)} x", f"  {chr(p)}{chr(p)}", chr(p)):
                got = [i for part in units.of_units(units.units(s.lower() if path == WORD else s)) for i in part]
                assert got == t.encode(s, add_special_tokens=False).ids, (hex(p), s)


def test_encoding_and_decoding_match_the_library(spark):
    t = Tokenizer.from_file(BYTE)
    want = []
    for k, x in enumerate(TEXTS):
        ids = t.encode(x or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((k, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for leaf in (8192, 300):
        assert sorted(map(tuple, bpe.encode_texts(docs, BYTE, leaf=leaf).collect())) == want
    ids = {r.doc_id: r for r in bpe.encode_texts(docs, BYTE, "ids").collect()}
    assert ids[3].ids == t.encode(TEXTS[3], add_special_tokens=False).ids and ids[3].decoded == TEXTS[3]
    assert bpe.encode_texts(docs.limit(0), BYTE).collect() == []


def test_join_of_random_halves_is_the_whole():
    c, rng = bpe.codec(BYTE), random.Random(1)
    for _ in range(300):
        s = "".join(rng.choice("aabcdeéß漢") for _ in range(rng.randrange(2, 120)))
        s = "".join(x for x in s if x.isalpha())
        k = rng.randrange(len(s))
        halves = [c.tokenizer.encode(x).ids for x in (s[:k], s[k:])]
        assert c.join(*halves) == c.tokenizer.encode(s).ids


def test_join_of_halves_cut_anywhere_is_the_whole():
    c, rng = bpe.codec(BYTE), random.Random(2)
    parts = ["word", "Hello", "it's", "we're", "they'll", "'", "''", "!!!", "'s", "'re", " ", "  ", "\n", "\n\n", "\t ", "12", "345678", "é", "ß漢字", "x", "ab" * 30, "!?" * 25, " " * 40, "7" * 50, "\u00a0", "\u0301", "🙂", "<|endoftext|>", "’s", "-"]
    for trial in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(2, 14)))
        want = c.tokenizer.encode(s, add_special_tokens=False).ids
        cuts = [k for k in range(1, len(s)) if not any(s.startswith(bpe.SPECIAL, j) for j in range(max(0, k - len(bpe.SPECIAL) + 1), k))]
        if cuts:
            k = rng.choice(cuts)
            halves = [c.tokenizer.encode(x, add_special_tokens=False).ids for x in (s[:k], s[k:])]
            assert c.join(*halves) == want, (trial, s[:k], s[k:])


def test_trees_of_many_levels(spark):
    t, rng = Tokenizer.from_file(BYTE), random.Random(3)
    parts = ["word ", "it's", "\n\n", "<|endoftext|>", "汉字", "x" * 90, " " * 70, "!" * 80, "1234 "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 120))) for _ in range(60)] * 2 + [None, ""]
    docs = spark.createDataFrame([(k % 50 or None, x, "c") for k, x in enumerate(texts)], "doc_id long, text string, row string")
    for leaf in (7, 40, 100_000):
        got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in bpe.encode_texts(docs, BYTE, "ids", leaf=leaf).collect()), key=str)
        want = [(k % 50 or None, t.encode(x or "", add_special_tokens=False).ids, x or "") for k, x in enumerate(texts)]
        assert got == sorted(want, key=str)


def check_packing(texts, rows, limit):
    t = load(WORD)
    want = {k: [*t.encode(x or "", add_special_tokens=False).ids, 2] for k, x in enumerate(texts)}
    pieces, packs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(want[r.doc_id]) and zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length))
        packs[r.sequence_id].append((r.offset, r.length))
    for k, ids in want.items():
        at = 0
        for start, n in sorted(pieces[k]):
            assert start == at
            at += n
        assert at == len(ids)
    for p in packs.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= limit
    return sum(map(len, want.values())), len(packs)


def test_packing_covers_every_id_once(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    check_packing(TEXTS, packing.packed_documents(docs, WORD).collect(), 4096)
    assert packing.packed_documents(docs.limit(0), WORD).collect() == []


def test_packing_of_repeated_rows_null_ids_and_other_columns(spark):
    t = load(WORD)
    texts = ["one two", None, "", "three " * 50]
    rows = [(k or None, x, "c") for k, x in enumerate(texts)] * 2
    got = packing.packed_documents(spark.createDataFrame(rows, "doc_id long, text string, length string"), WORD).collect()
    want = [(d, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for d, x, _ in rows]
    assert sorted(((r.doc_id, r.doc_tokens) for r in got), key=str) == sorted(want, key=str)
    packs = defaultdict(list)
    for r in got:
        packs[r.sequence_id].append((r.offset, r.length))
    for p in packs.values():
        assert [at for at, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))]


def test_packing_many_lengths_pads_little(spark):
    rng = random.Random(2)
    texts = ["same length here"] * 700 + [" ".join("ab cd".split() * rng.randrange(1, 60)) for _ in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = packing.staged(packing.token_pieces(docs, WORD, limit=64), "t")
    tokens, packs = check_packing(texts, packing.pack(pieces, 64).collect(), 64)
    assert tokens > 0.95 * 64 * packs


def test_shortest_pack_first_by_hand():
    assert sorted(packing.shortest_pack_first({6: 2, 5: 1, 4: 2, 1: 1}, 10)) == sorted([((5, 4), 1), ((6, 1), 1), ((6, 4), 1)])
    many = packing.shortest_pack_first({k: 10**9 + k for k in range(1, 513)}, 512)
    assert sum(n * len(p) for p, n in many) == sum(10**9 + k for k in range(1, 513)) and len(many) <= 1024


def test_ranks_agree_with_the_library():
    rng = random.Random(4)
    letters = [chr(p) for p in KNOWN]
    drawn = ["".join(rng.choice(a) for _ in range(rng.randrange(1, 30))) for a in (letters, "abcdefghijklmnopqrstuvwxyz", "etaoin'srd ", " \n\t\u00a0x1!", "ÀÉßæ12") for _ in range(400)]
    for path, pattern in ((BYTE, BYTE_UNIT), (WORD, WORD_UNIT)):
        t, own = load(path), Ranked(path, pattern)
        assert by_ranks(path)
        for s in [*drawn, *letters]:
            assert own.encode(s.lower() if path == WORD else s) == t.encode(s, add_special_tokens=False).ids, s


def test_words_between_spaces_equal_the_library():
    rng = random.Random(5)
    c, p = bpe.codec(BYTE, True), packing.Ids(WORD, True)
    for _ in range(3000):
        s = "".join(rng.choice(["a", "B", "it's", "'s", " ", " ", "  ", "\n", "\t", "\u00a0", "1", "!", "é", "word,"]) for _ in range(rng.randrange(12)))
        ids = c.tokenizer.encode(s, add_special_tokens=False).ids
        assert c.encode(s) == ids and c.joined(s) == ("".join(f"{i}," for i in ids), s), s
        assert p.of(s) == np.array(p.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes(), s


def test_known_words_do_not_meet_the_library(monkeypatch):
    """Word by word, the library took most of the time of op3 and op9."""
    c, p = bpe.Codec(BYTE, by_ranks(BYTE)), packing.Ids(WORD, by_ranks(WORD))
    c.tokenizer = p.tokenizer = c.cache.tokenizer = None
    assert c.decode(c.encode("some invented wordlings, it's")) == "some invented wordlings, it's" and len(p.of("some invented wordlings"))


def test_a_file_whose_ranks_differ_is_refused(tmp_path):
    import json

    with open(BYTE, encoding="utf-8") as f:
        data = json.load(f)
    merges = data["model"]["merges"]
    merges[:] = merges[::-1]
    (tmp_path / "turned.json").write_text(json.dumps(data))
    assert not by_ranks(str(tmp_path / "turned.json"))
