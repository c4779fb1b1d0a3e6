"""Alignment of two tokenizers over the same text by byte-owner arrays.

Every byte of a text has an owner among A's tokens and one among B's: np.repeat of the token's index by its length. Where
the pair of owners changes, a link begins, a pair of tokens whose bytes overlap; where both owners change at once, both
tokenizers cut, and a group of tokens ends. Tokens partition the bytes, so each overlapping pair is one run of bytes, and
a text's links are no more than its tokens.

How often two ids are linked is counted over all texts: a task counts its own texts with numpy and hands on sums, which
meet by pair of ids. Counts of the FREQUENT most frequent pairs are broadcast and looked up where a text's links lie; its
other pairs meet their counts in a join, and the sums come together by row. Of a text, nothing but rare pairs is shuffled.

Defined results. A null or empty text, and one that either tokenizer does not give back byte for byte, has no tokens: zeros
and an empty string. doc_id may be null or repeat; each row gives a row. Further columns are ignored. An empty table gives
an empty result. Strings that stand for special tokens are plain text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import scratch, slices, staged, whole_text
from veilspark.llm.wordcache import BYTE_UNIT, NO_CUT, Ranked, UnitIds, by_ranks, byte_alphabet, is_known, load

#: Distinct pairs that a task counts before it hands them on.
HELD_PAIRS = 1 << 20
#: The most frequent pairs, as many as are broadcast at most.
FREQUENT = 1 << 18
#: The letter that stands for a space in B's pieces.
SPACE_MARK = "▁"
_ROW = "doc_id long, row string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>, counted boolean"


class BytesTokens:
    """A: a byte-level tokenizer of the tokenizers library."""

    def __init__(self, path: str, ranked: bool):
        self.tokenizer = load(path, special_as_text=True)
        letters = byte_alphabet()
        names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.bytes_of = [bytes(letters[c] for c in x) if x is not None and all(c in letters for c in x) else (x or "").encode() for x in names]
        self.cache = UnitIds(self.tokenizer, BYTE_UNIT, list)
        self.merged = Ranked(path, BYTE_UNIT).encode if ranked else self._units

    def _units(self, text: str) -> list[int]:
        return [i for ids in self.cache.of_units(self.cache.units(text)) for i in ids]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        return [self.merged(t) if is_known(t) else self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


class PieceTokens:
    """B: a model of the sentencepiece library, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = [self.model.is_byte(i) for i in range(len(pieces))]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if b else p.replace(SPACE_MARK, " ").encode() for p, b in zip(pieces, byte, strict=True)]
        #: No piece has a space mark behind another character: nothing merges from a word into the next one's space.
        self.apart = all(SPACE_MARK not in p.lstrip(SPACE_MARK) for p in pieces)


def owners(lengths: np.ndarray) -> np.ndarray:
    """The index of the token that owns each byte."""
    return np.repeat(np.arange(len(lengths)), lengths)


def aligned(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A's token, B's token) of each link in order, and whether a link is the first of a group."""
    own_a, own_b = owners(a_lengths), owners(b_lengths)
    new_a, new_b = (np.concatenate(([True], x[1:] != x[:-1])) for x in (own_a, own_b))
    at = np.flatnonzero(new_a | new_b)
    return own_a[at], own_b[at], (new_a & new_b)[at]


class Aligner:
    """Alignments in one Python worker. A space and the characters up to the next one, single spaces only, and none with other
    white space on both sides, are a word that both tokenizers cut from its neighbours, so that its alignment is computed once and remembered, up to a bound."""

    def __init__(self, path_a: str, path_b: str, ranked: bool, entries: int = 3 << 17):
        self.a, self.b = BytesTokens(path_a, ranked), PieceTokens(path_b)
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes_of], np.int64) for t in (self.a, self.b))
        self.words = re.compile(r" [^ ]+").findall
        self.plain = re.compile(rf"(?: [^ {SPACE_MARK}]+)+").fullmatch if self.b.apart else lambda _: None
        #: An id with each sign that may stand behind it.
        self.shown = [f"{i}{sign}" for i in range(max(len(self.len_a), len(self.len_b))) for sign in ",|;"]
        self.known: dict[str, tuple | None] = {}
        self.entries = entries

    def aligned(self, parts: list[str]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, pairs of its links as bytes, groups as text) of each part, a text or word with its space before it; null where a
        tokenizer does not give it back. All parts' bytes are one array, since a part's end is a cut of both."""
        ids_a, ids_b = self.a.encode(parts), self.b.model.encode([p[1:] for p in parts], num_threads=1)
        sound = self.given_back(ids_a, ids_b, parts)
        ids_a, ids_b = ([x for x, good in zip(ids, sound, strict=True) if good] for ids in (ids_a, ids_b))
        if not ids_a:
            return [None] * len(parts)
        x, y = (np.fromiter(chain.from_iterable(each), np.int64) for each in (ids_a, ids_b))
        link_a, link_b, first = aligned(self.len_a[x], self.len_b[y])
        pairs = (x[link_a] << 32) | y[link_b]
        groups = np.flatnonzero(first)
        # where each part begins among A's and B's tokens, links and groups
        begun, begun_b = (np.cumsum([0, *map(len, ids)]) for ids in (ids_a, ids_b))
        at_link = np.searchsorted(link_a, begun)
        at_group = np.searchsorted(groups, at_link).tolist()
        # a group's A tokens stand before its B tokens, each with the sign behind it
        from_a, from_b = np.append(link_a[groups], len(x)), np.append(link_b[groups], len(y))
        order = np.zeros(len(x) + len(y), np.int64)
        for ids, begin, other, sign in ((x, from_a, from_b[:-1], 1), (y, from_b, from_a[1:], 2)):
            signs = np.zeros(len(ids), np.int64)
            signs[begin[1:] - 1] = sign
            order[np.arange(len(ids)) + np.repeat(other, np.diff(begin))] = 3 * ids + signs
        shown = [self.shown[k] for k in order.tolist()]
        at_link, pairs, at_shown = (8 * at_link).tolist(), pairs.tobytes(), (begun + begun_b).tolist()
        done = iter([(len(u), len(v), g2 - g1, pairs[l1:l2], "".join(shown[s1:s2])[:-1]) for u, v, g1, g2, l1, l2, s1, s2 in zip(ids_a, ids_b, at_group, at_group[1:], at_link, at_link[1:], at_shown, at_shown[1:], strict=False)])
        return [next(done) if good else None for good in sound]

    def given_back(self, ids_a: list[list[int]], ids_b: list[list[int]], parts: list[str]) -> list[bool]:
        """Whether the bytes of both tokenizers' ids are the part's. Usually all are: then they are compared at once."""
        whole, lengths = "".join(parts).encode(), [len(p.encode()) for p in parts]
        sides = ((self.a.bytes_of, ids_a), (self.b.bytes_of, ids_b))
        if all(b"".join([of[i] for i in chain.from_iterable(ids)]) == whole and [sum([len(of[i]) for i in each]) for each in ids] == lengths for of, ids in sides):
            return [True] * len(parts)
        same = lambda of, ids, p: b"".join([of[i] for i in ids]) == p.encode()
        return [same(self.a.bytes_of, x, p) and same(self.b.bytes_of, y, p) for x, y, p in zip(ids_a, ids_b, parts, strict=True)]

    def texts(self, texts: list[str]) -> Iterator[tuple | None]:
        spaced = [" " + t for t in texts]
        cut = [self.words(t) if self.plain(t) and not NO_CUT.search(t) else None for t in spaced]
        new = list({w for words in cut if words for w in words if w not in self.known})
        if len(self.known) + len(new) > self.entries:
            self.known.clear()
            new = list({w for words in cut if words for w in words})
        for k in range(0, len(new), 1 << 14):
            part = new[k : k + (1 << 14)]
            self.known.update(zip(part, self.aligned(part), strict=True))
        for text, whole, words in zip(texts, spaced, cut, strict=True):
            if not text:
                yield None
                continue
            found = [self.known[w] for w in words] if words else self.aligned([whole])
            if None in found:
                yield None
                continue
            n_a, n_b, n_groups, pairs, groups = zip(*found, strict=True)
            yield sum(n_a), sum(n_b), sum(n_groups), np.frombuffer(b"".join(pairs), np.int64), ";".join(groups)


@cache
def aligner(path_a: str, path_b: str, ranked: bool) -> Aligner:
    return Aligner(path_a, path_b, ranked)


def _links(path_a: str, path_b: str, ranked: bool, groups: bool):
    """A row for each text with its links, then rows that hold the task's counts of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b, ranked)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def counts() -> tuple[np.ndarray, np.ndarray]:
            keys, times = np.concatenate([k for k, _ in held]), np.concatenate([t for _, t in held])
            pairs, where = np.unique(keys, return_inverse=True)
            return pairs, np.bincount(where, times, len(pairs)).astype(np.int64)

        def batch_of(columns: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _ROW.split(", ")])

        for batch in slices(batches):
            rows = []
            for found in own.texts(batch.column(2).to_pylist()):
                if found is None:
                    rows.append((0, 0, 0, 0, "", [], []))
                    continue
                n_a, n_b, n_groups, links, text = found
                pairs, times = np.unique(links, return_counts=True)
                held.append((pairs, times))
                waiting += len(pairs)
                rows.append((n_a, n_b, n_groups, len(links), text if groups else hashlib.sha256(text.encode()).hexdigest(), pairs, times.astype(np.int32)))
            yield batch_of([batch.column(0), batch.column(1), *zip(*rows, strict=True), [False] * len(rows)])
            if waiting > HELD_PAIRS:
                held = [counts()]
                waiting = len(held[0][0])
                if waiting > HELD_PAIRS // 2:
                    yield batch_of(_parts(held.pop()))
                    waiting = 0
        if held:
            yield batch_of(_parts(counts()))

    return run


def _parts(counted: tuple[np.ndarray, np.ndarray], size: int = 1 << 14) -> list:
    """Counts as rows of at most `size` pairs; counts of more than 31 bits are split."""
    pairs, times = counted
    most = (1 << 31) - 1
    while (over := times > most).any():
        pairs, times = np.concatenate([pairs, pairs[over]]), np.concatenate([np.minimum(times, most), times[over] - most])
    cut = range(0, len(pairs), size)
    n = len(cut)
    return [[None] * n, [None] * n, *[[None] * n] * 4, [None] * n, [pairs[k : k + size] for k in cut], [times[k : k + size].astype(np.int32) for k in cut], [True] * n]


def _resolved(frequent):
    """Each row's sums over its pairs that are in the broadcast table, and the pairs that are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = frequent.value
        for batch in slices(batches, 64):
            out = []
            for pairs, times in zip(batch.column(1), batch.column(2), strict=True):
                pairs, times = (x.values.to_numpy(zero_copy_only=False) for x in (pairs, times))
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                there = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                k = times[there].astype(np.int64)
                out.append((int(k[best[at[there]]].sum()), int((counts[at[there]] * k).sum()), pairs[~there], times[~there]))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["row", "n_best", "count_sum", "pairs", "times"])

    return run


def _frequent(known: DataFrame, most: int):
    """The most frequent pairs as sorted arrays, at most so many."""
    levelled = known.withColumn("level", F.floor(8 * F.log2("n")))
    total, level = 0, 0
    for r in sorted(levelled.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["level"]):  # eight an octave
        total, level = total + r["n"], r["level"]
        if total > most:
            level += 1
            break
    t = levelled.filter(F.col("level") >= level).select("pair", "n", "best").toArrow()
    order = np.argsort(keys := t["pair"].to_numpy())
    return keys[order], t["n"].to_numpy()[order], t["best"].to_numpy(zero_copy_only=False)[order].astype(bool)


def align_texts(docs: DataFrame, path_a: str, path_b: str, output: str = "digest", id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and the groups for every row of docs: with "digest" as
    groups_sha256, with "groups" as their text, `a1,a2|b1;a3|b2,b3`. A link is best if its pair of ids is linked as often as
    any pair with its id of B."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.uuid().alias("row"), whole_text(text_col).alias("text"))
    found = staged(rows.mapInArrow(_links(path_a, path_b, by_ranks(path_a), output == "groups"), _ROW), "align-links")
    of_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    with scratch():
        sums = found.filter("counted").select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
        sums = staged(sums, "align-counts")
        most = sums.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))
        known = staged(sums.withColumn("b", of_b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "align-known")
        table = docs.sparkSession.sparkContext.broadcast(_frequent(known, frequent))
        halves = "row string, n_best long, count_sum long, pairs array<long>, times array<int>"
        seen = staged(found.filter("NOT counted").select("row", "pairs", "times").mapInArrow(_resolved(table), halves), "align-halves")
        # the other pairs, which are rare, meet their counts in a shuffle
        rest = seen.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("k"))
        rest = rest.join(known, "pair").select("row", F.when(F.col("best"), F.col("k").cast("long")).otherwise(0).alias("n_best"), (F.col("n") * F.col("k")).alias("count_sum"))
        of_row = seen.select("row", "n_best", "count_sum").unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        of_row = staged(of_row, "align-sums", keep=True)
    out = found.filter("NOT counted").drop("pairs", "times", "counted").join(of_row, "row")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups_sha256").alias("groups_sha256" if output == "digest" else "groups"))


def brute_alignment(texts: list[str | None], path_a: str, path_b: str) -> list[tuple]:
    """A plain version, pair by pair: for tests. (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    import sentencepiece

    t, s = load(path_a, special_as_text=True), sentencepiece.SentencePieceProcessor(model_file=path_b)
    letters, all_links, shapes = byte_alphabet(), [], []
    for text in texts:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)) if text else ([], [])
        bytes_a = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace(SPACE_MARK, " ").encode() for i in b]
        if not text or b"".join(bytes_a) != (whole := (" " + text).encode()) or b"".join(bytes_b) != whole:
            all_links.append([])
            shapes.append((0, 0, 0, 0, ""))
            continue
        end_a, end_b = [sum(map(len, bytes_a[: k + 1])) for k in range(len(a))], [sum(map(len, bytes_b[: k + 1])) for k in range(len(b))]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(end_a[i] - len(bytes_a[i]), end_b[j] - len(bytes_b[j])) < min(end_a[i], end_b[j])]
        cuts, groups, begun = sorted(set(end_a) & set(end_b)), [], 0
        for c in cuts:
            inside = lambda ids, ends, lo=begun, hi=c: ",".join(str(x) for x, e in zip(ids, ends, strict=True) if lo < e <= hi)
            groups.append(inside(a, end_a) + "|" + inside(b, end_b))
            begun = c
        all_links.append(links)
        shapes.append((len(a), len(b), len(cuts), len(links), ";".join(groups)))
    counts: dict = {}
    for links in all_links:
        for link in links:
            counts[link] = counts.get(link, 0) + 1
    best: dict = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(*shape[:4], sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), shape[4]) for links, shape in zip(all_links, shapes, strict=True)]
