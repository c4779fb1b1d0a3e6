"""Byte-pair encoding and decoding of whole texts, long texts by tree concatenation.

A text of more than LEAF code points is cut anywhere into leaves, which become rows that Spark deals out and encodes in
parallel. Then neighbours are joined pairwise, level by level, each level's joins dealt out to tasks; a text that is whole
leaves the tree at once. At a join, a window of tokens from both sides is encoded anew and widened until both sides agree:

- A window may end at a hard cut, two code points between which the split pattern always cuts whatever stands around
  them (a letter and then no letter, a digit and then no digit, a sign and then white space or a digit). Either side of
  a hard cut is encoded by itself.
- Or it ends within a run of one kind, if the window's encoding begins there with the left side's token or ends with the
  right side's. A unit's tokens are its encoding exactly if each two neighbours are the encoding of theirs, and the pair
  across the window's edge is then a pair that already stood.

Defined results. Null text counts as empty: no tokens, and the SHA-256 of nothing twice. doc_id may be null or repeat;
each row gives a row. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import forget, scratch, slices, staged, whole_text
from veilspark.llm.wordcache import BYTE_UNIT, NO_CUT, Known, Ranked, UnitIds, by_ranks, byte_alphabet, is_known, load

#: Code points in a leaf. A longer text takes the tree.
LEAF = 1 << 14
#: Tokens of each side in a join's first window.
WINDOW = 8
SPECIAL = "<|endoftext|>"


class Codec:
    """Encoding and decoding in one Python worker."""

    def __init__(self, path: str, ranked: bool = False):
        self.tokenizer = load(path)
        letters = byte_alphabet()
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(i) for i in range(n)]
        self.bytes_of = [bytes(letters[c] for c in x) if x is not None and all(c in letters for c in x) else (x or "").encode() for x in names]
        self.text_of = [str(i) for i in range(n)]
        self.cache = UnitIds(self.tokenizer, BYTE_UNIT, list)
        self.special, self.kinds = self.tokenizer.token_to_id(SPECIAL), {}
        self.merged = Ranked(path, BYTE_UNIT).encode if ranked else self._units
        #: By word with the space before it left out: ids; ids as text and the word that they decode to.
        self.ids_of, self.digests = Known(lambda word: self.merged(" " + word), 1 << 18), Known(self._digest, 1 << 19)

    def encode(self, text: str) -> list[int]:
        if SPECIAL in text or not is_known(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if NO_CUT.search(text):
            return self._units(text)
        first, *words = text.split(" ")
        ids = list(self.merged(first))
        for part in map(self.ids_of.__getitem__, words):
            ids += part
        return ids

    def _digest(self, word: str) -> tuple[str, str]:
        ids = self.merged(" " + word)
        decoded = self.decode(ids).removeprefix(" ")
        return ",".join([self.text_of[i] for i in ids]) + ",", word if decoded == word else decoded

    def joined(self, text: str) -> tuple[str, str]:
        """The text's ids, a comma behind each, and the text that they decode to."""
        if SPECIAL in text or not is_known(text) or NO_CUT.search(text):
            ids = self.encode(text)
            return "".join([self.text_of[i] + "," for i in ids]), self.decode(ids)
        first, *words = text.split(" ")
        begun = self.merged(first)
        ids, texts = zip(("".join([self.text_of[i] + "," for i in begun]), self.decode(begun)), *map(self.digests.__getitem__, words), strict=True)
        return "".join(ids), " ".join(texts)

    def _units(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.cache.of_units(self.cache.units(text)):
            ids += part
        return ids

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")

    def kind(self, c: str) -> str:
        """L, N, S (white space) or O, as the tokenizer's own split has it: runs of one kind are not cut."""
        if (k := self.kinds.get(c)) is None:
            units = self.tokenizer.pre_tokenizer.pre_tokenize_str
            k = self.kinds[c] = next((k for k, x in (("L", "a"), ("N", "1"), ("O", "!")) if len(units(x + c)) == 1), "S")
        return k

    def hard_cut(self, ids: list[int], at: int) -> bool:
        """Whether the split pattern cuts before the token at this place, whatever stands around."""
        if self.special in (ids[at - 1], ids[at]):
            return True
        after = self.bytes_of[ids[at]]
        if 0x80 <= after[0] < 0xC0:  # within a code point
            return False
        before, k = b"", at
        while k > 0 and len(before) < 4 and ids[k - 1] != self.special:
            k -= 1
            before = self.bytes_of[ids[k]] + before
        x, y = before.decode(errors="ignore")[-1:], after.decode(errors="ignore")[:1] or self._first(ids, at)
        if not x or not y:
            return False
        x, y = self.kind(x), self.kind(y)
        return x in "LN" and x != y or x == "O" and y in "NS"

    def _first(self, ids: list[int], at: int) -> str:
        """The code point that begins with the token at this place and goes on in the next ones."""
        return b"".join(self.bytes_of[i] for i in ids[at : at + 4]).decode(errors="ignore")[:1]

    def in_run(self, ids: list[int], at: int) -> bool:
        """Whether the tokens on both sides of this place are whole code points of one kind."""
        try:
            text = self.bytes_of[ids[at - 1]].decode() + self.bytes_of[ids[at]].decode()
        except UnicodeDecodeError:
            return False
        return self.special not in (ids[at - 1], ids[at]) and len({self.kind(c) for c in text}) == 1

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the text of both. Windows grow until both sides agree."""
        if not left or not right:
            return left or right
        width = WINDOW
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            a = max([a, *(k + 1 for k in range(a, len(left)) if left[k] == self.special)])
            b = min([b, *(k for k in range(b) if right[k] == self.special)])
            while a > 0 and not (hard_a := self.hard_cut(left, a) if a < len(left) else True) and not self.in_run(left, a):
                a -= 1
            while b < len(right) and not (hard_b := self.hard_cut(right, b) if b else True) and not self.in_run(right, b):
                b += 1
            window = b"".join(self.bytes_of[i] for i in [*left[a:], *right[:b]]).decode()
            ids = self.tokenizer.encode(window, add_special_tokens=False).ids
            # short forms such as 're are two letters long: only behind a third one is a run of letters surely a run
            settled = b == len(right) or hard_b or ids[-1] == right[b - 1] and len({self.kind(c) for c in window[-3:]}) == 1
            if settled and (a == 0 or hard_a or ids[0] == left[a]):
                return [*left[:a], *ids, *right[b:]]
            width *= 2


@cache
def codec(path: str, ranked: bool = False) -> Codec:
    return Codec(path, ranked)


def digest(c: Codec, ids: list[int]) -> tuple:
    table = c.text_of
    joined = ",".join([table[i] for i in ids])
    return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()


def digest_of_text(c: Codec, text: str) -> tuple:
    ids, decoded = c.joined(text)
    return ids.count(","), hashlib.sha256(ids[:-1].encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def ids_and_text(c: Codec, ids: list[int]) -> tuple:
    return list(ids), c.decode(ids)


#: What a row of the result holds: schema, Arrow fields, function of a codec and ids.
OUTPUTS: dict[str, tuple[str, list, Callable]] = {
    "digest": ("n_tokens long, ids_sha256 string, decoded_sha256 string", [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())], digest),
    "ids": ("ids array<int>, decoded string", [("ids", pa.list_(pa.int32())), ("decoded", pa.string())], ids_and_text),
}


def _whole(path: str, ranked: bool, output: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, (_, fields, finish) = codec(path, ranked), OUTPUTS[output]
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            rows = [digest_of_text(c, t) for t in texts] if output == "digest" else [finish(c, c.encode(t)) for t in texts]
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(n for n, _ in fields)])

    return run


#: A node of the tree: the text's row and number of leaves, the node's place on its level, its ids.
_NODE = "row string, doc_id long, leaves long, at long, "


def _leaves(leaf: int) -> Callable:
    """Rows of leaves. The special token's own string is never cut."""

    def cut(text: str) -> Iterator[str]:
        begun = 0
        while begun < len(text):
            end = begun + leaf
            inside = text.find(SPECIAL, max(begun, end - len(SPECIAL) + 1), end + len(SPECIAL) - 1)
            end = inside if begun < inside < end else inside + len(SPECIAL) if inside == begun else end
            yield text[begun:end]
            begun = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            for k, text in enumerate(batch.column(2).to_pylist()):
                texts = list(cut(text))
                n = len(texts)
                same = [pa.array([batch.column(c)[k].as_py()] * n, kind) for c, kind in ((0, pa.string()), (1, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array([n] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(texts, pa.string())], ["row", "doc_id", "leaves", "at", "leaf"])

    return run


def _encode_leaves(path: str, ranked: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, ranked)
        for batch in slices(batches, 64):
            ids = [c.encode(x) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.list_(pa.int32()))], ["row", "doc_id", "leaves", "at", "ids"])

    return run


def _join_level(path: str, ranked: bool) -> Callable:
    """Joins neighbours; rows come in order, so that two of them at most are held. Whole texts pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, held = codec(path, ranked), None
        names, kinds = ["row", "doc_id", "leaves", "at", "ids"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in slices(batches, 64):
            out = []
            for row, doc_id, leaves, at, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and held[0] == row and held[3] == at // 2:
                    out.append((row, doc_id, leaves, at // 2, c.join(held[4], ids)))
                    held = None
                    continue
                if held:
                    out.append(held)
                held = (row, doc_id, leaves, at // 2, ids)
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([held])

    return run


def _finished(path: str, ranked: bool, output: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, (_, fields, finish) = codec(path, ranked), OUTPUTS[output]
        for batch in slices(batches, 64):
            rows = [finish(c, x.values.to_numpy().tolist()) for x in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(n for n, _ in fields)])

    return run


def encode_texts(docs: DataFrame, path: str, output: str = "digest", id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id and what `output` names, for every row of docs: "digest" or "ids" (the ids and the decoded text).

    Texts of at most `leaf` code points are a tree of one leaf: they are encoded where they are read, and nothing of them
    is shuffled. The others are staged once, so that a row keeps its number when a task runs again. A level's nodes are
    dealt by text and pair; texts that are whole after a level are staged and leave.
    """
    schema, ranked = f"doc_id long, {OUTPUTS[output][0]}", by_ranks(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    long = F.length("text") > leaf
    done = rows.filter(~long).mapInArrow(_whole(path, ranked, output), schema)
    with scratch():
        tall = staged(rows.filter(long).select(F.uuid().alias("row"), "doc_id", "text"), "bpe-long")
        leaves = tall.mapInArrow(_leaves(leaf), _NODE + "leaf string").repartition(F.col("row"), F.col("at"))
        nodes = staged(leaves.mapInArrow(_encode_leaves(path, ranked), _NODE + "ids array<int>"), "bpe-nodes")
        deepest = nodes.agg(F.max("leaves")).collect()[0][0] or 1  # one number
        for level in range(1, (deepest - 1).bit_length() + 1):
            pairs = nodes.repartition(F.col("row"), F.floor(F.col("at") / 2)).sortWithinPartitions("row", "at")
            before, nodes = nodes, staged(pairs.mapInArrow(_join_level(path, ranked), _NODE + "ids array<int>"), "bpe-nodes")
            forget(before)
            whole = F.col("leaves") <= 1 << level
            done = done.unionByName(staged(nodes.filter(whole).select("doc_id", "ids").mapInArrow(_finished(path, ranked, output), schema), "bpe-done", keep=True))
            nodes = _and_path(nodes.filter(~whole), nodes)
    return done


def _and_path(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, a part of the staged table, which is forgotten with it."""
    df.staged_at = table.staged_at
    return df
