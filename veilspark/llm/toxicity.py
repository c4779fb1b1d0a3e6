"""Toxicity by subword-bag embeddings in a linear softmax.

A word is the mean of the vectors of its character n-grams, so an unseen misspelling shares most vectors with the word
it distorts. A window of consecutive words is the mean of its words; a linear softmax over that mean, trained jointly
with the n-gram vectors in numpy, tells toxic windows. Labels are of documents, so it is trained twice: on windows of
WINDOW words under their document's label, then on windows of SHARP words, of a toxic text those that the first
training finds most toxic, of a clean one those too and others at random.

A document is scored by the log odds that the softmax gives its windows of SPAN words: the mean of the TOP highest and the
count of the clear ones, with the text's length, go through a logistic curve that is fitted to labelled documents by
halves that did not train on them. The softmax is linear in the vectors, so each word is worth one number, remembered per worker, and a window's log
odds are the mean of its words' numbers and the softmax's bias.

Runs longer than LONG_RUN are scored by their pieces, each like a word. Training sees at most TRAIN_CHARS code points of
labelled rows, texts of at most LONGEST, and of each text TOXIC_WINDOWS or CLEAN_WINDOWS windows at most, then SHARP_TOXIC
or twice SHARP_CLEAN; scoring sees every row and whole texts.

Defined results. Null or empty text scores as a text without words. Rows without a usable label train nothing; if only
one label is there, every score is 0.5. Labels that contradict each other count as toxic when most say so. Null doc_id
is never trained on. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.shared import slices, whole_text

BUCKETS, DIM, WINDOW = 1 << 17, 12, 96
NGRAMS = (3, 4, 5)
#: Words of a window in the second training, and how many such windows of a toxic and (twice) of a clean text train.
SHARP, SHARP_TOXIC, SHARP_CLEAN = 8, 3, 2
#: Words of a window that is scored, how many of the highest count, and the log odds around which a window is clearly toxic.
SPAN, TOP, CLEAR = 4, 3, 3.0
#: Training documents that must hold an n-gram.
FEWEST = 4
TRAIN_CHARS, LONGEST = 10_000_000, 50_000
#: Windows of a toxic and of a clean labelled text that train at most.
TOXIC_WINDOWS, CLEAN_WINDOWS = 8, 2
#: A run of more than LONG_RUN characters (a script without spaces, words joined by signs) counts as the words between its
#: signs and as parts of PART characters, each beginning PART // 2 after the one before, so that what is no longer than
#: that is whole in one.
LONG_RUN, PART = 40, 20
#: Words remembered in a worker.
REMEMBERED = 1 << 19
_LETTERS = re.compile(r"[^\W_]+(?:['’\-*@$!0-9]+[^\W_]+)*")
_SIGNS = re.compile(r"['’\-*@$!0-9]+")


def words_of(text: str) -> list[str]:
    """The text's words, long runs in pieces that leave out nothing."""
    words = _LETTERS.findall(text.lower())
    if max(map(len, words), default=0) <= LONG_RUN:
        return words
    return [part for w in words for part in ([w] if len(w) <= LONG_RUN else pieces_of(w))]


def pieces_of(run: str) -> list[str]:
    between = [w for w in _SIGNS.split(run) if w]
    return parts_of(run) + ([w for w in between if len(w) <= LONG_RUN] if len(between) > 1 else [])


def parts_of(run: str) -> list[str]:
    step = PART // 2
    return [run[at : at + PART] for at in range(0, len(run) - step, step)]


def ngrams(word: str) -> list[int]:
    """Buckets of the word's character n-grams, its ends marked, and of the whole word."""
    w = f"<{word}>"
    parts = {w} | {w[i : i + n] for n in NGRAMS for i in range(len(w) - n + 1)}
    return sorted(xxhash.xxh32_intdigest(p.encode()) % BUCKETS for p in parts)


@dataclass
class Model:
    """worth: for each bucket, its vector times the softmax's direction; a word's number is the mean over its buckets.
    bias is the softmax's; slopes (of the parts of summary()) and shift make the curve."""

    worth: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float

    def word(self, word: str) -> float:
        return float(self.worth[ngrams(word)].mean())

    def score(self, numbers: np.ndarray) -> float:
        """0 to 1; a text without words scores as a window of nothing."""
        z = float(self.slopes @ summary(numbers, self.bias) + self.shift)
        return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


class Bags:
    """Words of the training texts as bags of buckets."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for t in texts]
        bags = [np.array(ngrams(w), np.int64) for w in number]
        self.starts = np.cumsum([0, *map(len, bags)])
        self.buckets = np.concatenate(bags) if bags else np.zeros(0, np.int64)
        seen = np.zeros(BUCKETS, np.int64)
        for ids in self.docs:
            seen[np.unique(self.of_words(np.unique(ids))[0])] += 1
        #: Buckets of few documents stay at nothing, as those never seen do: a rare word can't be learnt by heart.
        self.common = seen >= FEWEST

    def of_words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the given words, one after the other, and how many each has."""
        n = self.starts[ids + 1] - self.starts[ids]
        base = np.repeat(self.starts[ids] - np.cumsum(n) + n, n)
        return self.buckets[base + np.arange(n.sum())], n


    def word_means(self, worth: np.ndarray) -> np.ndarray:
        """For each word, the mean of worth over its buckets."""
        if not len(self.buckets):
            return np.zeros(0)
        return np.add.reduceat(worth[self.buckets], self.starts[:-1]) / np.diff(self.starts)


def window_odds(numbers: np.ndarray, bias: float, span: int = SPAN) -> np.ndarray:
    """The softmax's log odds for the mean of each window of span words; a shorter text is one window, filled up."""
    sums = np.concatenate([[0.0], np.cumsum(numbers)])
    return (sums[span:] - sums[:-span] if len(numbers) > span else sums[-1:]) / span + bias


def summary(numbers: np.ndarray, bias: float) -> tuple[float, float, float]:
    """What a document's score is made of: the mean log odds of its highest windows, half overlapping; how many windows
    are clearly toxic, counted softly around CLEAR; its length."""
    odds = window_odds(numbers, bias)
    clear = (1 / (1 + np.exp(-2 * np.clip(odds - CLEAR, -15, 15)))).sum() / SPAN
    return float(np.sort(odds[:: SPAN // 2])[-TOP:].mean()), float(np.log1p(clear)), float(np.log(len(numbers) + 20))


def windows_of(bags: Bags, docs: np.ndarray, y: np.ndarray, rng, toxic_windows: int = TOXIC_WINDOWS, clean_windows: int = CLEAN_WINDOWS) -> list[tuple[np.ndarray, int]]:
    """Windows with their document's label, of each document at most so many, chosen at random."""
    out = []
    for k in docs:
        ids, most = bags.docs[k], toxic_windows if y[k] else clean_windows
        if len(ids):
            starts = np.arange(0, max(1, len(ids) - WINDOW // 2), WINDOW)
            out += [(ids[at : at + WINDOW], int(y[k])) for at in (starts if len(starts) <= most else rng.choice(starts, most, replace=False))]
    return out


def sharp_windows(bags: Bags, docs: np.ndarray, y: np.ndarray, worth: np.ndarray, rng, toxic: int = SHARP_TOXIC, clean: int = SHARP_CLEAN) -> list[tuple[np.ndarray, int]]:
    """Short windows with their document's label: the most toxic by the model so far, and of clean texts others too."""
    numbers, out = bags.word_means(worth), []
    for k in docs:
        ids = bags.docs[k]
        if len(ids):
            starts = np.arange(0, max(1, len(ids) - SHARP // 2), SHARP // 2)
            highest = np.argsort([-numbers[ids[at : at + SHARP]].mean() for at in starts], kind="stable")[: toxic if y[k] else clean]
            more = [] if y[k] else rng.choice(len(starts), min(clean, len(starts)), replace=False)
            out += [(ids[at : at + SHARP], int(y[k])) for at in starts[np.unique(np.concatenate([highest, more]).astype(np.int64))]]
    return out


def fit(bags: Bags, chosen: list[tuple[np.ndarray, int]], rng, epochs: int = 3, steps: int = 200, batch: int = 64) -> tuple[np.ndarray, float]:
    """Trains n-gram vectors and softmax jointly; gives each bucket's vector times the softmax's direction, and
    its bias. Few windows are gone through more often, for as many steps."""
    vectors, out = rng.normal(0, 0.05, (BUCKETS, DIM)) * bags.common[:, None], rng.normal(0, 0.3, (DIM, 2))
    bias, squares, out_squares = np.zeros(2), np.full(BUCKETS, 1e-6), 1e-6
    for _ in range(max(epochs, steps * batch // max(len(chosen), 1))):
        order = rng.permutation(len(chosen))
        for begin in range(0, len(order), batch):
            part = [chosen[k] for k in order[begin : begin + batch]]
            lengths = np.array([len(w) for w, _ in part])
            target = np.array([t for _, t in part])
            buckets, n = bags.of_words(np.concatenate([w for w, _ in part]))
            window = np.repeat(np.arange(len(part)), lengths)
            at, share = np.repeat(window, n), np.repeat(1 / (n * lengths[window]), n)
            mean = np.stack([np.bincount(at, share * vectors[buckets, d], len(part)) for d in range(DIM)], 1)
            logits = mean @ out + bias
            wrong = np.exp(logits - logits.max(1, keepdims=True))
            wrong /= wrong.sum(1, keepdims=True)
            wrong[np.arange(len(part)), target] -= 1
            share *= bags.common[buckets]
            gradient = share[:, None] * (wrong @ out.T)[at]
            touched, where = np.unique(buckets, return_inverse=True)
            total = np.stack([np.bincount(where, gradient[:, d], len(touched)) for d in range(DIM)], 1)
            squares[touched] += (total**2).mean(1)
            vectors[touched] -= 0.1 * total / np.sqrt(squares[touched])[:, None]
            g = mean.T @ wrong
            out_squares += (g**2).mean()
            out -= 0.1 * g / np.sqrt(out_squares)
            bias -= 0.02 * wrong.mean(0)
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """Vectors and softmax from all texts. The curve from windows' log odds to scores is fitted to log odds that the other
    half of the texts taught, so it knows how a text fares that was not trained on."""
    y = np.array(labels, bool)
    if y.all() or not y.any():
        return Model(np.zeros(BUCKETS), 0.0, np.zeros(3), 0.0)
    rng = np.random.default_rng(seed)
    bags = Bags(texts)

    def taught(docs: np.ndarray) -> tuple[np.ndarray, float]:
        worth, _ = fit(bags, windows_of(bags, docs, y, rng), rng)
        return fit(bags, sharp_windows(bags, docs, y, worth, rng), rng)

    half = np.where(y, np.cumsum(y), np.cumsum(~y)) % 2  # every other text of each label
    halves = [(bags.word_means(worth), bias) for worth, bias in (taught(np.flatnonzero(half == k)) for k in (0, 1))]
    other = [(numbers[ids], bias) for k, ids in zip(half, bags.docs, strict=True) for numbers, bias in [halves[1 - k]]]
    parts = np.array([summary(*x) for x in other])
    slopes, shift = _logistic(parts, y)
    for k in np.flatnonzero(slopes[:2] < 0):  # toxic windows never speak for a text
        parts[:, k] = 0
        slopes, shift = _logistic(parts, y)
    worth, bias = taught(np.arange(len(y)))
    return Model(worth, bias, slopes, shift)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of the logistic curve through (x, y), by Newton's method with a light prior."""
    scale = np.maximum(x.std(0), 0.1)  # what hardly varies here says nothing of what varies elsewhere
    z = np.column_stack([(x - x.mean(0)) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    prior = np.diag([*[0.3] * x.shape[1], 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + prior
        w -= np.clip(np.linalg.solve(h, z.T @ (p - y) + prior @ w), -2, 2)
    return w[:-1] / scale, float(w[-1] - (w[:-1] / scale * x.mean(0)).sum())


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, train_chars: int = TRAIN_CHARS, longest: int = LONGEST) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled texts, chosen by a hash of doc_id; held-out rows never."""
    verdict = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") > 0.5).alias("toxic"))
    verdict = verdict.filter(~held_out(F.col("doc_id")))
    total = verdict.groupBy("toxic").count().collect()
    # a toxic and a clean half at most, each thinned by hash before any text moves
    most = train_chars // 4000
    share = {r["toxic"]: min(1.0, most / r["count"]) for r in total}
    picked = verdict.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * F.when(F.col("toxic"), F.lit(share.get(True, 0.0))).otherwise(F.lit(share.get(False, 0.0))))
    picked = picked.limit(4 * most)  # about twice `most` by the hash; so bounded, the list is broadcast and meets texts in the scan
    texts = docs.select("doc_id", whole_text().alias("text")).filter(F.length("text") <= longest)
    # of rows that repeat a doc_id one stays, whichever way they are dealt
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    sofar = F.sum(F.length("text")).over(Window.partitionBy("salt").orderBy(F.xxhash64(F.lit(7), "doc_id")))
    got = rows.withColumn("sofar", sofar).filter(F.col("sofar") <= train_chars // 16).select("doc_id", "text", F.col("toxic").cast("int")).collect()
    got.sort()
    return [r[1] for r in got], [r[2] for r in got]


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (columns doc_id and text)."""
    model = model or train(*training_rows(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** 17 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value

        class Known(dict):
            def __missing__(self, word: str) -> float:
                if len(self) >= REMEMBERED:
                    self.clear()
                self[word] = v = m.word(word)
                return v

        known = Known()
        for batch in slices(batches):
            scores = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                numbers = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                scores.append(m.score(numbers))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
