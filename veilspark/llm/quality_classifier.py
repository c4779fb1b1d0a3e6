"""Quality classifier by co-training.

Two views of a document train apart: its whole text (the words and byte trigrams it is made of, hashed to places, and
measured shares of symbols, capitals, repeats and the like), and its page metadata (the other columns).
Over some rounds each view labels the unlabelled rows that move it furthest from the base rate, and these pseudo-labels
go to the other view's training rows. Each view is then calibrated on labelled rows that neither trained on, and the two
calibrated log odds add up, the base rate counted once. A view that knows nothing calibrates to the base rate, gives no
confident labels and does not sway the result.

Training sees about SAMPLE labelled and POOL unlabelled documents, chosen by a hash of doc_id, of each doc_id one row; only
their features reach the driver. Every row is scored on its whole text.

Defined results. Null text counts as empty, a null column as a value of its own. Contradicting labels count by majority.
Without labels of both kinds every score is 0.5 and every document is kept. Rows may repeat. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.quality_rules import Measured
from veilspark.llm.shared import free_names, quoted_name, slices, whole_text

SAMPLE, POOL, ROUNDS = 8000, 4000, 4
#: Log odds beyond the base rate from which a pseudo-label is confident, and new labels of each kind in a round.
CONFIDENT, PER_ROUND = 2.5, 200
KEEP = 0.4
#: Places that the values of one metadata column are hashed to.
PLACES = 32
META = ("lang", "source", "n_chars")
#: Places that a text's words and byte trigrams are hashed to; numbers that are measured on it.
WORD_PLACES, TRIGRAM_PLACES, MEASURES = 128, 64, 14
N_TEXT = MEASURES + WORD_PLACES + TRIGRAM_PLACES
#: Ridge on the measures' weights, and on those of places, which are many.
RIDGE, PLACE_RIDGE = 1.0, 20.0


class WordPlaces(dict):
    """The place of each word seen, at most so many remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = place = xxhash.xxh32_intdigest(word.lower()) % WORD_PLACES
        return place


def text_features(data: bytes, places: WordPlaces) -> np.ndarray:
    """Measures, then the square roots of the shares of words and of byte trigrams (A-Z lowered) at each place."""
    m = Measured(data)
    words = np.bincount(np.fromiter(map(places.__getitem__, m.words), np.int64, m.n_words), minlength=WORD_PLACES)
    b = np.frombuffer(data.lower(), np.uint8).astype(np.uint32)
    trigrams = np.bincount((((b[:-2] * 961 + b[1:-1] * 31 + b[2:]) * 2654435761 & 0xFFFFFFFF) >> 26) if len(b) > 2 else np.zeros(0, np.int64), minlength=TRIGRAM_PLACES)
    return np.concatenate([measures(m), *(np.sqrt(x / max(1, x.sum())) for x in (words, trigrams))])


def measures(m: Measured) -> list[float]:
    data = m.data
    n, lines = m.n_words + 1.0, len(m.lines) + 1.0
    distinct = len(set(m.words))
    bars = m.data.count(b" | ") + m.data.count(b" |\n")
    digits = sum(map(m.data.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9")))
    shares = [
        m.n_symbols / n, m.n_bangs / n, m.n_upper / (m.n_letters + 1.0), m.n_stutters / n, m.n_dup_lines / lines, m.n_repeat_words / n,
        bars / n, digits / (len(data) + 1.0), 1 - distinct / n,
    ]
    return [*(min(3.0, x**0.5) for x in shares), m.word_chars / n / 10, np.log(n) / 5, np.log(lines) / 5, distinct / n**0.8 / 3, min(n, 12.0) / 12]


def meta_features(values: tuple, kinds: list[bool]) -> tuple[list[int], list[float]]:
    """Places of the categorical values, and of each number its size and its square."""
    places, numbers = [], []
    for k, (v, is_number) in enumerate(zip(values, kinds, strict=True)):
        if is_number:
            size = float(np.log1p(abs(v))) / 5 if v is not None else 0.0
            numbers += [size, size * size]
        places.append(k * PLACES + (0 if v is None else 1 if is_number else 1 + xxhash.xxh32_intdigest(str(v).encode()) % (PLACES - 1)))
    return places, numbers


@dataclass
class View:
    """Logistic regression over standardised features, and the line that calibrates its log odds."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))]) @ self.weights
        return np.clip(self.slope * z + self.shift, -20, 20)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float | np.ndarray) -> np.ndarray:
    """Weights, the last one free, by damped Newton steps."""
    w, prior = np.zeros(x.shape[1]), np.zeros(x.shape[1]) + ridge
    prior[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(prior), x.T @ (p - y) + prior * w)
        w -= step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_view(x: np.ndarray, y: np.ndarray) -> View:
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    ridge = np.full(x.shape[1] + 1, RIDGE)
    if x.shape[1] == N_TEXT:
        ridge[MEASURES:-1] = PLACE_RIDGE
    return View(logistic(np.column_stack([(x - mean) / scale, np.ones(len(x))]), y, ridge), mean, scale)


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    z = view.odds(x)
    w = logistic(np.column_stack([z, np.ones(len(z))]), y, 0.05)
    view.slope, view.shift = max(float(w[0]), 0.0), float(w[1])
    if w[0] <= 0:  # says nothing: the base rate
        view.shift = base_odds(y)


def base_odds(y: np.ndarray) -> float:
    return float(np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5)))


@dataclass
class Model:
    text: View
    meta: View
    base: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.text.odds(text) + self.meta.odds(meta) - self.base)))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS) -> Model | None:
    """y: 0 or 1 for the rows of text and meta; the pool has no labels. Every fourth labelled row only calibrates."""
    held = np.arange(len(y)) % 4 == 3
    if len(y) < 8 or len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        return None
    views, pools, full = [text[~held], meta[~held]], [pool_text, pool_meta], [text, meta]
    rows, labels = [views[0], views[1]], [y[~held], y[~held]]
    given = [np.zeros(len(pool_text), bool), np.zeros(len(pool_text), bool)]  # pool rows that a view was taught already
    models = [fit_view(rows[k], labels[k]) for k in (0, 1)]
    for _ in range(rounds if len(pool_text) else 0):
        news = []
        for k in (0, 1):
            calibrate(models[k], full[k][held], y[held])
            gain = models[k].odds(pools[k]) - base_odds(y[held])
            for label, by in ((1, gain), (0, -gain)):
                free = np.flatnonzero((by > CONFIDENT) & ~given[1 - k])
                news.append((1 - k, free[np.argsort(-by[free], kind="stable")][:PER_ROUND], label))
        for k, picked, label in news:
            given[k][picked] = True
            rows[k] = np.concatenate([rows[k], pools[k][picked]])
            labels[k] = np.concatenate([labels[k], np.full(len(picked), label)])
        models = [fit_view(rows[k], labels[k]) for k in (0, 1)]
    for k in (0, 1):
        calibrate(models[k], full[k][held], y[held])
    return Model(models[0], models[1], base_odds(y[held]))


def _matrices(docs: DataFrame, meta_cols: list[str]):
    """What turns a batch (text, then metadata) into the two views' matrices."""
    types = {f.name: f.dataType for f in docs.schema}
    kinds = [isinstance(types[c], T.NumericType) for c in meta_cols]
    width = PLACES * len(kinds) + 2 * sum(kinds)

    def of(columns: list[list], places: WordPlaces) -> tuple[np.ndarray, np.ndarray]:
        text = np.array([text_features(x, places) for x in columns[0]], np.float64).reshape(-1, N_TEXT)
        meta = np.zeros((len(text), width))
        for i, values in enumerate(zip(*columns[1:], strict=True) if kinds else ()):
            places, numbers = meta_features(values, kinds)
            meta[i, places] = 1
            meta[i, PLACES * len(kinds) :] = numbers
        return text, meta

    return of


def _inputs(docs: DataFrame, meta_cols: list[str]) -> list:
    """The text's bytes and the metadata, under names that docs has not."""
    types = {f.name: f.dataType for f in docs.schema}
    names = free_names(docs.columns, "x", *(f"m{k}" for k in range(len(meta_cols))))
    meta = (F.col(c).cast("double" if isinstance(types[c], T.NumericType) else "string").alias(n) for n, c in zip(names[1:], meta_cols, strict=True))
    return [F.encode(whole_text(), "UTF-8").alias(names[0]), *meta]


def train(docs: DataFrame, labels: DataFrame, meta_cols: list[str], sample: int = SAMPLE, pool: int = POOL) -> Model | None:
    verdict = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("quality"))
    below = lambda share: F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))
    n_labels, n_docs = verdict.count(), docs.count()
    picked = verdict.filter(below(sample / max(n_labels, 1))).limit(2 * sample)  # so bounded, the list is broadcast
    of, n_meta = _matrices(docs, meta_cols), len(meta_cols)
    base = docs.select("doc_id", F.struct(F.xxhash64(whole_text()).alias("h"), *_inputs(docs, meta_cols)).alias("row"))
    labelled = base.join(F.broadcast(picked), "doc_id")
    free = base.filter(below(pool / max(n_docs, 1))).withColumn("quality", F.lit(None).cast("int"))
    # one row of each doc_id, however often it is there; of a labelled one with its label
    both = labelled.unionByName(free).groupBy("doc_id").agg(F.min("row").alias("row"), F.max("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = WordPlaces()
        for batch in slices(batches, 200):
            text, meta = of([batch.column(2 + k).to_pylist() for k in range(1 + n_meta)], places)
            x = np.column_stack([text, meta]).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes() for row in x], pa.binary())], ["doc_id", "quality", "x"])

    inputs = [F.col(f"row.`{c}`") for c in both.schema["row"].dataType.names[1:]]
    got = both.select("doc_id", "quality", *inputs).mapInArrow(run, "doc_id long, quality int, x binary").toPandas()  # SAMPLE and POOL rows
    if got.empty:
        return None
    got["h"] = [xxhash.xxh32_intdigest(str(d).encode()) for d in got["doc_id"]]
    got = got.sort_values(["h", "doc_id"])
    x, y = np.stack([np.frombuffer(b, "<f4") for b in got["x"]]).astype(np.float64), got["quality"].to_numpy(np.float64)
    known = ~np.isnan(y)
    return co_train(x[known, :N_TEXT], x[known, N_TEXT:], y[known], x[~known, :N_TEXT], x[~known, N_TEXT:])


def quality_scores(
    docs: DataFrame, labels: DataFrame, meta_cols: tuple[str, ...] = META, keep: float = KEEP, model: Model | None = None, score_col: str = "_score", kept_col: str = "_kept"
) -> DataFrame:
    """docs with the likelihood of good quality (score_col) and whether it is enough (kept_col) added; columns of docs under
    these names are replaced. labels: doc_id, quality (0 or 1)."""
    columns = [c for c in meta_cols if c in docs.columns]
    model = model or train(docs, labels, columns)
    own = [c for c in docs.columns if c.lower() not in (score_col.lower(), kept_col.lower())]
    of, n, types = _matrices(docs, columns), len(own), {f.name: f for f in docs.schema}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, m = WordPlaces(), shared.value
        for batch in slices(batches):
            values = m.scores(*of([batch.column(n + k).to_pylist() for k in range(1 + len(columns))], places)) if m else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(values, pa.float64()), pa.array(values >= keep, pa.bool_())], [*own, score_col, kept_col])

    out = T.StructType([*(types[c] for c in own), T.StructField(score_col, T.DoubleType()), T.StructField(kept_col, T.BooleanType())])
    # under plain names: mapInArrow looks its columns up by name, unquoted
    plain = free_names(docs.columns, *(f"c{k}" for k in range(n)))
    return docs.select(*(F.col(quoted_name(c)).alias(p) for c, p in zip(own, plain, strict=True)), *_inputs(docs, columns)).mapInArrow(run, out)
