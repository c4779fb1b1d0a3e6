"""Quality rules as a short-circuit cascade.

Each rule rejects a text by whole-number arithmetic over counts that a `Measured` text computes when first asked. On a
bounded sample the executors time every rule, words split anew for each, and note what it rejects; the driver then orders
the rules greedily by rejections per second among the texts that the rules before leave. The cascade stops at a text's
first failed rule, so most rejected texts never pay for the dear counts. Where the counts themselves are asked for, as in
the registered query, all texts pay for those and the cascade saves the other rules only. The verdict does not depend on
the order.

Defined results. Null text has no words and fails. Null or repeated doc_ids give a row each. An empty table gives an
empty result, and the rules keep their given order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from time import perf_counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import hash_sample, slices, whole_text

#: Fixed values of the measures.
BLANKS, SYMBOLS, UPPERS, FOLLOWING = b" \t\n\v\f\r", b"#*$%&|<>", bytes(range(65, 91)), bytes(range(0x80, 0xC0))
LETTERS = UPPERS + bytes(range(97, 123))
#: Rows that costs and selectivities are estimated on.
SAMPLE_ROWS = 400


def _without(data: bytes, drop: bytes) -> int:
    """How many bytes of data are in drop."""
    return len(data) - len(data.translate(None, drop))


class Measured:
    """A text in UTF-8 and its counts, each computed once at most."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.data) - _without(self.data, BLANKS + FOLLOWING)

    @cached_property
    def n_symbols(self) -> int:
        return _without(self.data, SYMBOLS)

    @cached_property
    def n_bangs(self) -> int:
        return self.data.count(b"!")

    @cached_property
    def n_upper(self) -> int:
        return _without(self.data, UPPERS)

    @cached_property
    def n_letters(self) -> int:
        return _without(self.data, LETTERS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before."""
        return sum(map(bytes.__eq__, self.words, self.words[1:]))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words - 4
        if n < 2:
            return 0
        number = {w: k for k, w in enumerate(dict.fromkeys(self.words))}
        ids, size = np.fromiter(map(number.__getitem__, self.words), np.int64, self.n_words), len(number)
        code, most = ids[:n], size
        for k in range(1, 5):
            if most * size >= 1 << 62:  # a further number would not fit: rank what is there, at most n values
                code = np.unique(code, return_inverse=True)[1]
                most = n
            code = code * size + ids[k : k + n]
            most *= size
        _, where, times = np.unique(code, return_inverse=True, return_counts=True)
        if len(times) == n:
            return 0
        twice = times[where] > 1
        covered = np.zeros(self.n_words, bool)
        for k in range(5):
            covered[k : n + k] |= twice
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """rejects(m) is whether the measured text fails."""

    name: str
    rejects: Callable[[Measured], bool]


BASE = [
    Rule("few_words", lambda m: m.n_words < 10),
    Rule("repeated_passages", lambda m: 100 * m.n_repeat_words > 20 * m.n_words),
]
MORE = [
    Rule("symbols", lambda m: 100 * m.n_symbols > 20 * m.n_words),
    Rule("shouting", lambda m: 100 * m.n_upper > 40 * m.n_letters),
    Rule("exclaiming", lambda m: 100 * m.n_bangs > 30 * m.n_words),
    Rule("odd_word_length", lambda m: m.word_chars < 2 * m.n_words or m.word_chars > 25 * m.n_words),
    Rule("stuttering", lambda m: 100 * m.n_stutters > 25 * m.n_words),
    Rule("repeated_lines", lambda m: 100 * m.n_dup_lines > 60 * len(m.lines)),
]


def _as_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(whole_text(text_col), "UTF-8").alias("text"))


def profile(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Seconds and verdict of each rule on each sampled row; only these numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seconds, verdicts = [], []
            for data in batch.column(1).to_pylist():
                took, failed = [], []
                for rule in rules:
                    m, begun = Measured(data), perf_counter()
                    failed.append(bool(rule.rejects(m)))
                    took.append(perf_counter() - begun)
                seconds.append(took)
                verdicts.append(failed)
            yield pa.RecordBatch.from_arrays([pa.array(seconds, pa.list_(pa.float64())), pa.array(verdicts, pa.list_(pa.bool_()))], ["seconds", "failed"])

    sample = hash_sample(_as_bytes(docs, id_col, text_col), F.col("doc_id"), sample_rows)
    rows = sample.mapInArrow(run, "seconds array<double>, failed array<boolean>").collect()
    shape = (len(rows), len(rules))
    return np.array([r.seconds for r in rows]).reshape(shape), np.array([r.failed for r in rows], bool).reshape(shape)


def cascade_order(seconds: np.ndarray, failed: np.ndarray) -> list[int]:
    """Greedy: next comes the rule with the most rejections per second among the rows still standing."""
    left, standing, order = list(range(seconds.shape[1])), np.ones(len(seconds), bool), []
    while left:
        gain = lambda k: failed[standing, k].sum() / max(seconds[standing, k].sum(), 1e-9)  # noqa: B023, E731
        best = max(left, key=gain)
        order.append(best)
        left.remove(best)
        standing &= ~failed[:, best]
    return order


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_verdicts(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", counts: bool = True, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, kept, and with counts the five counts and base_failed, for every row of docs."""
    rules = [*BASE, *MORE] if rules is None else rules
    ordered = [rules[k] for k in cascade_order(*profile(docs, rules, id_col, text_col, sample_rows))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [Measured(x) for x in batch.column(1).to_pylist()]
            kept = pa.array([not any(r.rejects(m) for r in ordered) for m in texts], pa.bool_())
            more = []
            if counts:
                more = [pa.array([getattr(m, c) for m in texts], pa.int64()) for c in _COUNTS]
                more.append(pa.array([any(r.rejects(m) for r in BASE) for m in texts], pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), kept, *more], ["doc_id", "kept", *[*_COUNTS, "base_failed"][: len(more)]])

    schema = "doc_id long, kept boolean" + "".join(f", {c} long" for c in _COUNTS) * counts + ", base_failed boolean" * counts
    return _as_bytes(docs, id_col, text_col).mapInArrow(run, schema)
