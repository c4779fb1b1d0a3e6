"""Exact deduplication by Grace hash partitioning.

Each map task folds its own rows first, so a text that a third of all rows hold leaves a task once. What remains is
dealt out by a hash of the text and folded again. Both folds use the same routine: an open-addressing table that
compares complete content while the distinct texts fit the memory given, and else spill files, dealt by a seeded hash,
that are folded one after the other with another seed, as deep as needed.

Defined results. Null text counts as empty. Null doc_id ranks below every number. Of rows that repeat both text and
doc_id, one stays. An empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import lower_ascii, slices, staged, whole_text

FANOUT = 16
#: Bytes of distinct text that one table may hold before it spills.
TABLE_BYTES = 96 << 20
#: Rows of a result that a task holds.
FLUSH_ROWS = 50_000


class ContentTable:
    """Open addressing with linear probing. Slots hold entry numbers; a match needs equal hash and equal content."""

    def __init__(self, seed: int):
        self.seed, self.bytes = seed, 0
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.keys: list[bytes] = []
        self.values: list[list] = []

    def _grow(self) -> None:
        self.slots = np.full(len(self.slots) * 4, -1, np.int64)
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k

    def find_or_add(self, key: bytes, value: list) -> int:
        """The number of the entry that already holds this content, or -1 after adding it."""
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        mask = len(self.slots) - 1
        at = h & mask
        while (k := int(self.slots[at])) >= 0:
            if self.hashes[k] == h and self.keys[k] == key:
                return k
            at = (at + 1) & mask
        self.slots[at] = len(self.keys)
        self.hashes.append(h)
        self.keys.append(key)
        self.values.append(value)
        self.bytes += len(key) + 200
        if 2 * len(self.keys) > len(self.slots):
            self._grow()
        return -1


def grace_fold(records: Iterable[tuple[bytes, list]], merge, budget: int = TABLE_BYTES, depth: int = 0) -> Iterator[tuple[bytes, list]]:
    """Yields each distinct key once with its values merged; merge(into, value) changes the first.

    Equal keys meet in the table or in the same spill file, so a file holds fewer distinct keys at each depth and a
    file of a single key always fits.
    """
    table, files = ContentTable(depth), None
    for key, value in records:
        if files is None:
            if (k := table.find_or_add(key, value)) >= 0:
                merge(table.values[k], value)
            elif table.bytes > budget and len(table.keys) > 1:
                files = [tempfile.TemporaryFile() for _ in range(FANOUT)]  # noqa: SIM115
                for one in zip(table.keys, table.values, strict=True):
                    _spill(files, one, depth)
                table = ContentTable(depth)
        else:
            _spill(files, (key, value), depth)
    if files is None:
        yield from zip(table.keys, table.values, strict=True)
        return
    for file in files:
        with file:
            file.seek(0)
            yield from grace_fold(_records(file), merge, budget, depth + 1)


def _spill(files: list, record: tuple[bytes, list], depth: int) -> None:
    # the high bits, since the table of the next depth uses the low ones
    pickle.dump(record, files[(xxhash.xxh3_64_intdigest(record[0], 1000 + depth) >> 32) % FANOUT], protocol=5)


def _records(file) -> Iterator[tuple[bytes, list]]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


_LOCAL = "doc_id long, gid long, first_top boolean, is_group boolean, text binary, rows long, top long"


def _merge_local(into: list, value: list) -> None:
    """[entries, rows, top]: entries are the numbers under which rows were seen."""
    into[0].extend(value[0])


def _local_groups(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []

        def rows():
            for batch in slices(batches):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids.append(doc_id)
                    yield text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text, [[len(ids) - 1]]

        out: dict[str, list] = {}

        def start():
            out.update({k: [] for k in ("doc_id", "gid", "first_top", "is_group", "text", "rows", "top")})

        def flush():
            names = list(out)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)], names)

        start()
        held = 0
        for gid, (key, (members,)) in enumerate(grace_fold(rows(), _merge_local, budget)):
            top = max((ids[m] for m in members if ids[m] is not None), default=None)
            first = next(m for m in members if ids[m] == top)
            for m in members:
                for name, v in zip(out, (ids[m], base + gid, m == first, False, None, None, None), strict=True):
                    out[name].append(v)
            for name, v in zip(out, (None, base + gid, False, True, key, len(members), top), strict=True):
                out[name].append(v)
            held += len(key)
            if held > 8 << 20 or len(out["gid"]) > FLUSH_ROWS:
                yield flush()
                start()
                held = 0
        if out["gid"]:
            yield flush()

    return run


def _rank(value: list) -> tuple:
    return value[2] is not None, value[2] or 0, -value[3]


def _merge_global(into: list, value: list) -> None:
    """[local groups, rows, top doc_id, local group that holds it]: ties go to the lowest group."""
    if _rank(value) > _rank(into):
        into[2:] = value[2:]
    into[0].extend(value[0])
    into[1] += value[1]


def _global_groups(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in slices(batches):
                gid, text, n, top = (batch.column(i).to_pylist() for i in range(4))
                for g, t, c, d in zip(gid, text, n, top, strict=True):
                    yield t, [[g], c, d, g]

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())

        def flush(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["gid", "keep_id", "group_size", "winner", "text_sha256"])

        out: list[list] = [[], [], [], [], []]
        for key, (gids, n, top, winner) in grace_fold(rows(), _merge_global, budget):
            sha = hashlib.sha256(key).hexdigest()
            for column, v in zip(out, (gids, [top] * len(gids), [n] * len(gids), [winner] * len(gids), [sha] * len(gids)), strict=True):
                column.extend(v)
            if len(out[0]) >= FLUSH_ROWS:
                yield flush(out)
                out = [[], [], [], [], []]
        if out[0]:
            yield flush(out)

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Per-row facts (doc_id, local group) never meet in one task:
    they are joined to their local group's outcome, and a local group is no larger than one input split.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(lower_ascii(whole_text(text_col)), "UTF-8").alias("text"))
    local = staged(rows.mapInArrow(_local_groups(table_bytes), _LOCAL), "exact-local")
    groups = local.filter("is_group").select("gid", "text", "rows", "top")
    outcome = groups.repartition(F.xxhash64("text")).mapInArrow(_global_groups(table_bytes), "gid long, keep_id long, group_size long, winner long, text_sha256 string")
    members = local.filter("not is_group").select("doc_id", "gid", "first_top")
    return members.join(outcome, "gid").select("doc_id", "keep_id", "group_size", (F.col("first_top") & (F.col("gid") == F.col("winner"))).alias("kept"), "text_sha256")
