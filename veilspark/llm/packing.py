"""Packing token sequences: shortest pack first over the length histogram.

Documents become pieces of at most `limit` ids; a document longer than that gives full pieces and one remainder. The
histogram of piece lengths has `limit` bins whatever the corpus, so the packing itself runs on counts: lengths are
placed longest first, each into the shortest pack that still has room, and only counts of packing patterns change.
Every length then owns ranges of ranks, each range a pattern; a piece finds its sequence and offset from its rank
among the pieces of its length. Ranks come from counts by (length, salt), so a length that a third of all pieces share
is ranked in many tasks.

Defined results. Null or empty text is the end id alone. Rows may repeat; each gives its own pieces. Null doc_id is
kept. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.shared import slices, staged, whole_text
from veilspark.llm.wordcache import WORD_UNIT, Known, Ranked, UnitIds, by_ranks, is_known, load

LIMIT = 4096
END_ID = 2
#: A length is ranked in as many tasks as there are shuffle partitions, and in these at least.
SALTS = 64
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Ids:
    """A text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, ranked: bool = False):
        self.tokenizer = load(path)
        if ranked:
            merges = Ranked(path, WORD_UNIT)
            number = [i.to_bytes(4, "little") for i in range(max(merges.ids) + 1)]
            self.known = Known(lambda word: b"".join([number[i] for i in merges.encode(word)]), 1 << 19)
        else:
            units = UnitIds(self.tokenizer, WORD_UNIT, lambda ids: np.array(ids, "<u4").tobytes())
            self.known = Known(lambda word: b"".join(units.of_units(units.units(word))), 1 << 18)

    def of(self, text: str) -> bytes:
        # the special tokens' own strings are matched before lower-casing; only the library knows them
        if "<|" in text or not is_known(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        # no unit holds white space
        return b"".join(map(self.known.__getitem__, text.lower().split(" ")))


@cache
def _ids(path: str, ranked: bool) -> Ids:
    return Ids(path, ranked)


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece, in the order of the document; with_ids adds the ids themselves."""
    end, ranked = int(end_id).to_bytes(4, "little"), by_ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _ids(path, ranked)
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokens.of(text) + end
                n = len(ids) // 4
                for start in range(0, n, limit):
                    piece = ids[4 * start : 4 * (start + limit)]
                    for column, v in zip(out, (doc_id, start, len(piece) // 4, zlib.crc32(piece), n, np.frombuffer(piece, "<u4") if with_ids else None), strict=True):
                        column.append(v)
            arrays = [pa.array(c, pa.int64()) for c in out[:5]] + [pa.array(out[5], pa.list_(pa.int64()))] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, _PIECES + ", ids array<long>" * with_ids)


def shortest_pack_first(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, count) for all packs; a pattern lists its lengths, longest first.

    Each length closes or extends whole groups of equal packs and splits at most one, so there are at most two groups
    per length whatever the counts are.
    """
    room: dict[int, list[list]] = {}  # by tokens left: [pattern, count]

    def put(free: int, pattern: tuple[int, ...], count: int) -> None:
        room.setdefault(free, []).append([pattern, count])

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo and room and (free := max(room)) >= length:
            pattern, count = room[free].pop()
            if not room[free]:
                del room[free]
            used = min(count, todo)
            if count > used:
                put(free, pattern, count - used)
            put(free - length, (*pattern, length), used)
            todo -= used
        # nothing has room: new packs, each filled with this length
        each = limit // length
        packs, rest = divmod(todo, each)
        if packs:
            put(limit - each * length, (length,) * each, packs)
        if rest:
            put(limit - rest * length, (length,) * rest, 1)
    return [(tuple(p), n) for free in sorted(room) for p, n in room[free]]


def rank_ranges(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length, consecutive ranges of ranks: first rank, copies in a pack, first sequence, offset of the first copy."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in dict.fromkeys(pattern):
            copies = pattern.count(length)
            rows.append((length, taken[length], copies, sequence, offset))
            taken[length] += copies * count
            offset += copies * length
        sequence += count
    return pd.DataFrame(rows, columns=["length", "first", "copies", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """pieces with sequence_id, offset and the tokens that its sequence is padded to. pieces must be a staged table."""
    spark = pieces.sparkSession
    salts = max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # at most `limit` rows of two numbers
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns = shortest_pack_first(histogram, limit)
    ranges = rank_ranges(patterns)
    fills = np.array([sum(p) for p, _ in patterns], np.int64)
    firsts = np.cumsum([0, *(n for _, n in patterns)], dtype=np.int64)[:-1]
    bounds = {int(k): g[["first", "copies", "sequence", "offset"]].to_numpy(np.int64) for k, g in ranges.groupby("length")}
    # bounded by the patterns, thus by `limit`: see shortest_pack_first
    table = spark.sparkContext.broadcast((bounds, fills, firsts))

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["length", "salt"])

    @F.pandas_udf("sequence_id long, offset long, padded_length long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        bounds, fills, firsts = table.value
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        for one in np.unique(lengths):
            mine = np.flatnonzero(lengths == one)
            b = bounds[int(one)]
            first, copies, begin, at = b[np.searchsorted(b[:, 0], ranks[mine], "right") - 1].T
            nth = ranks[mine] - first
            sequence[mine], offset[mine] = begin + nth // copies, at + nth % copies * one
        fill = fills[np.searchsorted(firsts, sequence, "right") - 1] if len(fills) else sequence
        return pd.DataFrame({"sequence_id": sequence, "offset": offset, "padded_length": np.where(fill & (fill - 1), limit, fill)})

    placed = ranked.withColumn("place", place("length", F.col("base") + F.col("nth")))
    return placed.select(*pieces.columns, "place.sequence_id", "place.offset", "place.padded_length")


def packed_documents(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length for each piece of docs."""
    return pack(staged(token_pieces(docs, path, limit=limit), "pieces"), limit)
