"""Byte-level byte-pair encoding and decoding by a fold of ranked merges in DataFrame functions.

The split pattern cuts a text into words. A word is an array of bytes; a fold joins, again and again, the leftmost of its
neighbours whose merge has the least rank, until none has one. Ranks come from a literal map of the plan: merges of a
left token share a displacement into one table, so that a look-up is three reads of arrays. Ranks of neighbours are kept
beside the tokens, and a merge looks up two of them anew.

All words are counted, and the distinct ones that occur most often, at most CACHED, are folded first and put into the plan
as a table of their own; every other word is folded where it stands. A text's ids are its words' ids in order, so nothing
of a text is shuffled. Decoding looks up each id's bytes and concatenates them.

A fold costs the square of a word's length. A word of more than FOLD_BYTES bytes goes through tiktoken in the rows that
hold one, and in these only; without such words the plan has no Python.

Only the merge that ends a token's own encoding can ever make that token, if every token of the file comes from one: then
the map holds one pair a token. The file is tested for it; one that fails is refused.

Defined results. Null text counts as empty: no ids. doc_id may be null or repeat; each row gives a row. Further columns
are ignored. An empty table gives an empty result. Strings that other vocabularies treat as special are plain text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import staged, whole_text
from veilspark.llm.wordcache import halves

#: Words in the plan's table at most, and bytes of a word that is folded.
CACHED, FOLD_BYTES = 1 << 16, 128
#: White space as the tokenizer's pattern has it.
BLANK = r"\t-\r \x85\xA0  -     　"
#: Letters and numbers that Unicode has gained since the oldest JVM that Spark runs on.
NEW_LETTERS = """
870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4
10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA
10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746
11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF
1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0
1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF
"""
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"
#: No rank, beyond all others; bits of a place in a word, and of an id.
NONE, PLACE = (1 << 23) - 1, 20


def _classes() -> tuple[str, str]:
    """Bodies of the classes of letters and of numbers; what the JVM does not know yet is looked up in the lists."""
    ranges = lambda text: "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in text.split())
    return tuple(rf"\p{{{kind}}}[\p{{Cn}}&&[{ranges(new)}]]" for kind, new in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)))


_L, _N = _classes()
#: public_tokenizers.PATTERN as the JVM reads it, its classes written out.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{BLANK}{_L}{_N}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankMap:
    """(left id, right id) to the id of both: row `left` of a sparse table lies at base[left] in one array."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        rows: dict[int, list[tuple[int, int]]] = {}
        for token, k in ranks.items():
            if len(token) > 1:
                pair = halves(token, ranks)
                if len(pair) != 2:
                    raise ValueError(f"token {k} of the rank file is not a merge of two others")
                rows.setdefault(ranks[pair[0]], []).append((ranks[pair[1]], k))
        self.bytes_of = {k: t for t, k in ranks.items()}
        self.base = np.zeros(self.size + 1, np.int64)  # the last id stands for a word's edges
        room = max(1 << (4 * sum(map(len, rows.values()))).bit_length(), 2 * self.size)  # so sparse that rows soon find a place
        owner, merged = np.full(room, -1, np.int64), np.zeros(room, np.int64)
        rng = np.random.default_rng(1)
        for left in sorted(rows, key=lambda x: -len(rows[x])):
            rights, ids = np.array(rows[left]).T
            while (owner[rights + (at := int(rng.integers(-rights.min(), room - rights.max())))] >= 0).any():
                pass
            self.base[left], owner[rights + at], merged[rights + at] = at, left, ids
        self.owner, self.merged = owner, merged


def _ints(values) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


class Fold:
    """The fold as columns of a plan."""

    def __init__(self, ranks: dict[bytes, int]):
        table = RankMap(ranks)
        self.edge = table.size
        #: Hexadecimal digits of a packed id.
        self.width = 4 if table.size <= 1 << 16 else 8
        self.base, self.owner, self.merged = (_ints(a.tolist()) for a in (table.base, table.owner, table.merged))
        self.of_byte = _ints(ranks[bytes([b])] for b in range(256))
        self.hex_of = F.split(F.lit(",".join(table.bytes_of.get(k, b"").hex().upper() for k in range(table.size))), ",")

    def rank(self, a: Column, b: Column) -> Column:
        at = F.get(self.base, a) + b  # beyond the table for some pairs that have no merge: null
        return F.when(F.get(self.owner, at) == a, F.get(self.merged, at)).otherwise(F.lit(NONE))

    def entry(self, a: Column, b: Column) -> Column:
        """A token a before b in one number: the rank of both, the token's own id, and room for a place."""
        return F.shiftleft(self.rank(a, b).cast("long"), 40).bitwiseOR(F.shiftleft(a.cast("long"), PLACE))

    def ids(self, word: Column) -> Column:
        """The ids of a word."""
        letters = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")  # one for each byte
        begun = F.concat(F.transform(letters, lambda c: F.get(self.of_byte, F.ascii(c))), F.array(F.lit(self.edge)))
        edge, nothing = F.lit((NONE << 40) + (self.edge << PLACE)), F.lit(NONE << 40)
        # what is needed more than once is the element of an array of one, so that it is computed once
        entries = F.transform(F.array(begun), lambda t: F.concat(F.array(edge), F.zip_with(t, F.slice(t, F.lit(2), F.size(t)), lambda a, b: F.when(b.isNull(), edge).otherwise(self.entry(a, b)))))

        def merge(tokens: Column, least: Column) -> Column:
            at, new = least.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"), F.shiftright(least, 40).cast("int")
            pairs = F.array(F.struct(self.own(F.get(tokens, at - 1)).alias("a"), new.alias("b")), F.struct(new.alias("a"), self.own(F.get(tokens, at + 2)).alias("b")))
            return F.concat(F.slice(tokens, F.lit(1), at - 1), F.transform(pairs, lambda p: self.entry(p["a"], p["b"])), F.slice(tokens, at + 3, F.lit(1 << PLACE)))

        def step(tokens: Column, _: Column) -> Column:
            least = F.array_min(F.transform(tokens, lambda e, i: e + i))  # of equal ranks the leftmost
            return F.when(F.array_min(tokens) >= nothing, tokens).otherwise(F.get(F.transform(F.array(least), lambda x: merge(tokens, x)), 0))

        merged = F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), F.get(entries, 0), step)
        return F.filter(F.transform(merged, self.own), lambda i: i != self.edge)

    def own(self, entry: Column) -> Column:
        return F.shiftright(entry, PLACE).bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")

    def packed(self, word: Column) -> Column:
        """The word's ids in hexadecimal, low byte first, a colon, and the text that the ids decode to: a word is whole code
        points, so its tokens' bytes together are a text."""

        def little(i: Column) -> Column:
            h = F.hex(i.cast("long") + F.lit(1 << 32))
            return F.concat(*(F.substring(h, k, 2) for k in (8, 6, 4, 2)[: self.width // 2]))

        both = F.transform(F.array(self.ids(word)), lambda t: F.concat(F.array_join(F.transform(t, little), ""), F.lit(":"), F.decode(F.unhex(F.array_join(F.transform(t, lambda i: F.get(self.hex_of, i)), "")), "UTF-8")))
        return F.get(both, 0)

    def whole(self, ids: Column) -> Column:
        """Packed ids of a text as little-endian unsigned 32-bit integers."""
        return F.unhex(ids if self.width == 8 else F.regexp_replace(ids, "(....)", "$10000"))


class Known:
    """The frequent words' packed values: every word lies in one of two slots that its hash names. A value ends with its word
    behind its only colon, which tells whose it is."""

    def __init__(self, rows: list):
        bits = max(8, (2 * len(rows) - 1).bit_length() if rows else 8)
        self.mask = (1 << bits) - 1
        slots: dict[int, tuple] = {}
        for r in rows:
            entry, at = r, r["h"] & self.mask
            for _ in range(200):
                entry, slots[at] = slots.get(at), entry
                if entry is None:
                    break
                one, two = entry["h"] & self.mask, (entry["h"] >> 32) & self.mask
                at = two if at == one else one
        # a word that found no slot is folded where it stands
        self.values = "\0".join(slots[k]["packed"] if k in slots else "" for k in range(self.mask + 1))

    def pieces(self, words: Column, fold: Fold) -> Column:
        values = F.split(F.lit(self.values), "\\x00", -1)

        def piece(w: Column) -> Column:
            end, h = F.concat(F.lit(":"), w), F.xxhash64(w)
            # one copy of the table in the plan: each is some megabytes for the driver
            held = F.transform(F.array(h, F.shiftrightunsigned(h, 32)), lambda s: F.get(values, s.bitwiseAND(F.lit(self.mask)).cast("int")))
            return F.coalesce(F.get(F.filter(held, lambda v: F.endswith(v, end)), 0), fold.packed(w))

        return F.transform(words, piece)


def _long_words(path: str, width: int):
    """Packed values of the words that are too long for the fold, null for the others."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        # a pattern that takes a word whole: words come cut already
        own = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=read_ranks(path), special_tokens={})

        def packed(word: str) -> str | None:
            if len(word.encode()) <= FOLD_BYTES:
                return None
            ids = own.encode_ordinary(word)
            return f"{np.array(ids, '<u4' if width == 8 else '<u2').tobytes().hex().upper()}:{own.decode(ids)}"

        for batch in batches:
            yield batch.map(lambda words: [packed(w) for w in words])

    return run


def _frequent(words: DataFrame, fold: Fold, cached: int) -> tuple[list, bool]:
    """The most frequent words that can be folded with their packed values, at most `cached`, and whether there are any
    that can't. All words are counted."""
    short = F.octet_length("word") <= FOLD_BYTES
    counted = words.select(F.explode("words").alias("word")).select(F.when(short, F.col("word")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = staged(counted.withColumn("level", F.floor(8 * F.log2("n"))), "fold-counts")
    total, level = 0, 0
    levels = counts.filter("word is not null").groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()  # eight an octave
    for r in sorted(levels, key=lambda r: -r["level"]):
        total, level = total + r["n"], r["level"]
        if total > cached:
            level += 1
            break
    often = counts.filter((F.col("level") >= level) & ~F.contains("word", F.lit("\0")) & ~F.contains("word", F.lit(":"))).repartition(16, "word")
    rows = often.select(F.xxhash64("word").alias("h"), fold.packed(F.col("word")).alias("packed")).collect() if levels else []
    return rows, not counts.filter("word is null").isEmpty()


def fold_texts(docs: DataFrame, path: str, output: str = "digest", id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED) -> DataFrame:
    """doc_id and what `output` names, for every row of docs: "digest" (n_tokens, ids_sha256, decoded_sha256) or "bytes"
    (ids as little-endian unsigned 32-bit integers, and the decoded bytes)."""
    fold = Fold(read_ranks(path))
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_extract_all(whole_text(text_col), F.lit(SPLIT), F.lit(0)).alias("words"))
    rows, some_long = _frequent(words, fold, cached)
    known = Known(rows)
    is_long = lambda w: F.octet_length(w) > FOLD_BYTES
    short = words.filter(~F.exists("words", is_long)) if some_long else words
    done = short.select("doc_id", known.pieces(F.col("words"), fold).alias("pieces"))
    if some_long:
        both = words.filter(F.exists("words", is_long)).withColumn("long", _long_words(path, fold.width)(F.col("words")))
        usual = known.pieces(F.transform("words", lambda w: F.when(is_long(w), F.lit(" ")).otherwise(w)), fold)
        done = done.unionByName(both.select("doc_id", F.zip_with(usual, "long", lambda a, b: F.coalesce(b, a)).alias("pieces")))
    ids = F.array_join(F.transform("pieces", lambda p: F.substring_index(p, ":", 1)), "")
    text = F.array_join(F.transform("pieces", lambda p: F.substring(p, F.instr(p, ":") + 1, F.length(p))), "")
    out = done.select("doc_id", fold.whole(ids).alias("ids"), F.encode(text, "UTF-8").alias("decoded"))
    if output == "bytes":
        return out
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def decode_ids(table: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """table with the bytes of an array of ids: their pieces concatenated; null where an id is unknown."""
    ranks = read_ranks(path)
    size = max(ranks.values()) + 1
    by_id = {k: t for t, k in ranks.items()}
    hex_of = F.split(F.lit(",".join(by_id.get(k, b"").hex().upper() for k in range(size))), ",")
    pieces = F.transform(ids_col, lambda i: F.get(hex_of, i))
    sound = F.forall(pieces, lambda p: p.isNotNull() & (p != ""))
    return table.withColumn(decoded_col, F.when(sound, F.unhex(F.array_join(pieces, ""))))


def brute_ids(text: str, ranks: dict[bytes, int]) -> list[int]:
    """A plain version for words of a text without a pattern: for tests."""
    parts = [bytes([b]) for b in text.encode()]
    while True:
        found = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if found is None:
            return [ranks[p] for p in parts]
        parts[found[1] : found[1] + 2] = [reduce(bytes.__add__, parts[found[1] : found[1] + 2])]
