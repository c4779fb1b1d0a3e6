"""Ranked lexical search over a tiered index.

The index is built over every document. Its forward table has a row for each document with a term of the queries: the
terms and how often each occurs. A posting's impact s depends on that and on the document's length; per term, a histogram
of impacts cuts the postings into tiers, those of highest impact first, so many as TIERS says at least. What a tier leaves
out is bounded by one number a term, the highest impact left, its residual.

Queries go through the tiers. In a tier, postings join the queries' terms; a document's sum is its score from what was
seen, and with the residuals of the terms that it was not seen under a bound of its score. The CANDIDATES best documents
of a query are scored exactly from the forward table. A query is done if its last result beats what any other document
can reach: the bound of every other one seen, and the sum of all residuals for those not seen. Equality proves nothing,
as a lower doc_id would come first. A query without such a proof falls to the next tier. The last tier is the whole
forward table: each task scores its documents against all queries left, a block of documents at a time, and keeps a
query's best; those meet by query. So nothing is cut short, and the proof only spares work.

Queries are taken in blocks whose terms a task can hold (BLOCK_TERMS); a document's text is read once a block.

Defined results. Null text has no terms; documents without terms do not count, queries without terms have no results.
Repeated rows are documents, or queries, of their own; of equal scores the lower doc_id comes first, null last. Further
columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.shared import lower_ascii, scratch, slices, staged, whole_text

#: Results of a query; postings of a term in each tier at least; documents that a tier scores exactly for a query.
TOP, TIERS, CANDIDATES = 10, (500, 8000), 40
#: Terms of a block of queries, counted once a query, unless one query alone has more.
BLOCK_TERMS = 1 << 15
#: Bands of impacts in a term's histogram. Impacts are below MOST.
BANDS, MOST = 64, 1_000_000
#: What a term is made of.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of terms, A-Z lower-cased, and a space for all others.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_FORWARD = "row long, doc_id long, n long, terms array<int>, times array<int>, docs long, tokens long"


def impacts(times: np.ndarray, n: np.ndarray, docs: int, tokens: int) -> np.ndarray:
    """The impact of terms that occur so often in documents of n terms."""
    m = 100 - 90 + (90 * n * docs) // tokens
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _forward(vocabulary):
    """A row for each document with terms of the vocabulary; then the task's counts of documents and terms, and of the
    documents that hold each term (times of terms, row being null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        df, docs, tokens = np.zeros(len(known), np.int64), 0, 0
        row = TaskContext.get().partitionId() << 40
        names = [f.split()[0] for f in _FORWARD.split(", ")]
        ints = pa.list_(pa.int32())
        for batch in slices(batches):
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = data.translate(_BYTES).split(b" ") if data else []
                terms = [t for t in terms if t]
                if not terms:
                    continue
                docs, tokens, row = docs + 1, tokens + len(terms), row + 1
                ids = np.fromiter(map(known.get, terms, repeat(-1)), np.int32, len(terms))
                ids, times = np.unique(ids[ids >= 0], return_counts=True)
                if len(ids):
                    df[ids] += 1
                    rows.append((row, doc_id, len(terms), ids, times.astype(np.int32)))
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [*[pa.int64()] * 3, ints, ints], strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], names)
        held = np.flatnonzero(df)
        cut = [held[k : k + 4096] for k in range(0, max(len(held), 1), 4096)]
        n = len(cut)
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array([c.astype(np.int32) for c in cut], ints), pa.array([df[c].astype(np.int32) for c in cut], ints), pa.array([docs, *[0] * (n - 1)]), pa.array([tokens, *[0] * (n - 1)])], names)

    return run


def _arrays(batch: pa.RecordBatch, docs: int, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the document in the batch, term, impact) of all postings of a batch of n, terms, times."""
    n, terms, times = (batch.column(c) for c in ("n", "terms", "times"))
    lengths = terms.value_lengths().to_numpy()
    place = np.repeat(np.arange(batch.num_rows), lengths)
    flat = lambda x: x.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return place, flat(terms), impacts(flat(times), n.to_numpy(zero_copy_only=False)[place], docs, tokens)


def _histogram(docs: int, tokens: int):
    """Postings and highest impact by term and band, of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, most = (np.zeros(0, np.int64) for _ in range(3))
        for batch in slices(batches):
            _, terms, s = _arrays(batch, docs, tokens)
            key = np.concatenate([keys, terms * BANDS + s * BANDS // MOST])
            one, top = np.concatenate([counts, np.ones(len(terms), np.int64)]), np.concatenate([most, s])
            keys, where = np.unique(key, return_inverse=True)
            counts, most = np.bincount(where, one, len(keys)).astype(np.int64), np.zeros(len(keys), np.int64)
            np.maximum.at(most, where, top)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts), pa.array(most)], ["key", "n", "most"])

    return run


def tiers_of(histogram: pa.Table, n_terms: int, tiers: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """By tier and term: the lowest band of the tier, and the highest impact below it."""
    keys, n, most = (histogram[c].to_numpy() for c in ("key", "n", "most"))
    order = np.argsort(-keys)
    keys, n, most = keys[order], n[order], most[order]
    term, band = keys // BANDS, keys % BANDS
    first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(keys) else np.zeros(0, np.int64)
    total = np.cumsum(n)
    before = total - n - np.repeat((total - n)[first], np.diff([*first, len(keys)]))  # postings of higher bands of the term
    lowest, residual = np.full((len(tiers), n_terms), BANDS), np.zeros((len(tiers), n_terms), np.int64)
    for k, size in enumerate(tiers):
        inside = before < size
        np.minimum.at(lowest[k], term[inside], band[inside])
        np.maximum.at(residual[k], term[~inside], most[~inside])
    return lowest, residual


def _high(lowest: np.ndarray, docs: int, tokens: int):
    """The postings of all tiers but the last, each with its tier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            place, terms, s = _arrays(batch, docs, tokens)
            band = s * BANDS // MOST
            tier = sum(((band < lowest[k][terms]).astype(np.int32) for k in range(len(lowest))), np.zeros(len(terms), np.int32))
            keep = np.flatnonzero(tier < len(lowest))
            of = pa.array(place[keep])
            yield pa.RecordBatch.from_arrays([pa.array(tier[keep], pa.int32()), pa.array(terms[keep], pa.int32()), batch.column("row").take(of), batch.column("doc_id").take(of), pa.array(s[keep])], ["tier", "term", "row", "doc_id", "s"])

    return run


class Queries:
    """The terms of a block of queries as a sparse table: of a term, the queries that hold it."""

    def __init__(self, of: list[np.ndarray], weights: np.ndarray):
        query, term = np.repeat(np.arange(len(of)), list(map(len, of))), np.concatenate([*of, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(term, kind="stable")
        self.query, self.size, self.weights = query[order], len(of), weights
        self.begin = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def scores(self, place: np.ndarray, terms: np.ndarray, s: np.ndarray, rows: int) -> np.ndarray:
        """Scores by document and query, whole numbers below 2 ** 53."""
        times = self.begin[terms + 1] - self.begin[terms]
        of = np.repeat(np.arange(len(terms)), times)
        at = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + self.begin[terms][of]
        key = place[of] * self.size + self.query[at]
        return np.bincount(key, (self.weights[terms] * s)[of], rows * self.size).reshape(rows, self.size)


def _scored(queries, docs: int, tokens: int, top: int):
    """A task's best documents of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        kth = np.zeros(q.size)  # the score that a task's document must reach
        held: list[np.ndarray] = []

        def pruned(parts: list[np.ndarray]) -> np.ndarray:
            every = np.concatenate([*parts, np.zeros((0, 5), np.int64)])
            every = every[np.lexsort((every[:, 2], every[:, 3], -every[:, 1], every[:, 0]))]
            query = every[:, 0]
            first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(every) else np.zeros(0, np.int64)
            place = np.arange(len(every)) - np.repeat(first, np.diff([*first, len(every)]))
            kept, last = every[place < top], every[place == top - 1]
            kth[last[:, 0]] = last[:, 1]
            return kept

        for batch in slices(batches, max(1, min(1000, (1 << 22) // max(q.size, 1)))):
            place, terms, s = _arrays(batch, docs, tokens)
            found = q.scores(place, terms, s, batch.num_rows)
            doc, query = np.nonzero((found >= kth) & (found > 0))
            ids = batch.column("doc_id")
            missing = ids.is_null().to_numpy(zero_copy_only=False)[doc]
            # null ids come last: (query, score, id, whether it is missing, row)
            held.append(np.stack([query, found[doc, query].astype(np.int64), ids.fill_null(0).to_numpy()[doc], missing, batch.column("row").to_numpy()[doc]], 1).astype(np.int64))
            held = [pruned(held)]
        out = pruned(held)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2], mask=out[:, 3] == 1), pa.array(out[:, 4])], ["query", "score", "doc_id", "row"])

    return run


def _best(scores: DataFrame, most: int) -> DataFrame:
    """The first of each query by score, doc_id and row."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


class Index:
    """The tiered index of documents for a vocabulary."""

    def __init__(self, docs: DataFrame, vocabulary: dict[bytes, int], tiers: tuple[int, ...], id_col: str, text_col: str):
        spark = self.spark = docs.sparkSession
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(whole_text(text_col), "UTF-8").alias("text"))
        every = staged(rows.mapInArrow(_forward(spark.sparkContext.broadcast(vocabulary)), _FORWARD), "search-forward")
        self.forward = every.filter("row is not null").select("row", "doc_id", "n", "terms", "times")
        totals = every.filter("row is null")
        self.docs, self.tokens = (int(x or 0) for x in totals.agg(F.sum("docs"), F.sum("tokens")).collect()[0])  # one row
        counts = totals.select(F.explode(F.arrays_zip("terms", "times")).alias("p")).groupBy("p.terms").agg(F.sum("p.times")).toArrow()  # a row for each term
        self.weights, self.tiers = np.zeros(len(vocabulary), np.int64), tiers
        for term, df in zip(counts[0].to_pylist(), counts[1].to_pylist(), strict=True):
            self.weights[term] = weight(self.docs, df)
        self.args = self.docs, max(self.tokens, 1)
        by_band = self.forward.select("n", "terms", "times").mapInArrow(_histogram(*self.args), "key long, n long, most long").groupBy("key").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
        lowest, self.residual = tiers_of(by_band.toArrow(), len(vocabulary), tiers)  # BANDS rows a term at most
        self.high = staged(self.forward.mapInArrow(_high(lowest, *self.args), "tier int, term int, row long, doc_id long, s long"), "search-high")

    def search(self, of: list[np.ndarray], top: int, candidates: int) -> DataFrame:
        """query (its place in the list), rank, doc_id, score."""
        open_, done = list(range(len(of))), []
        for tier in range(len(self.tiers)):
            if open_:
                found, proven = self.in_tier(tier, open_, of, top, candidates)
                done.append(found.filter(F.col("query").isin(*proven)) if proven else found.limit(0))
                open_ = [k for k in open_ if k not in set(proven)]
        self.left = len(open_)
        if open_:
            queries = self.spark.sparkContext.broadcast(Queries([of[k] for k in open_], self.weights))
            schema = "query long, score long, doc_id long, row long"
            last = _best(self.forward.mapInArrow(_scored(queries, *self.args, top), schema), top)
            back = F.array(*map(F.lit, open_))
            done.append(last.select(F.get(back, F.col("query").cast("int")).cast("long").alias("query"), "rank", "doc_id", "score"))
        out = done[0].select("query", "rank", "doc_id", "score")
        for more in done[1:]:
            out = out.unionByName(more.select("query", "rank", "doc_id", "score"))
        return out

    def in_tier(self, tier: int, open_: list[int], of: list[np.ndarray], top: int, candidates: int) -> tuple[DataFrame, list[int]]:
        """Results from a tier and those above it, and the queries whose results are proven."""
        rows = [(k, int(t), int(self.weights[t]), int(self.weights[t] * self.residual[tier][t])) for k in open_ for t in of[k]]
        terms = self.spark.createDataFrame(pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query", "term", "w", "rest"), zip(*rows, strict=True), strict=True)}))
        rest = {k: int((self.weights[of[k]] * self.residual[tier][of[k]]).sum()) for k in open_}
        seen = self.high.filter(F.col("tier") <= tier).join(F.broadcast(terms), "term")  # BLOCK_TERMS rows
        sums = seen.groupBy("query", "row", "doc_id").agg(F.sum(F.col("w") * F.col("s")).alias("score"), F.sum("rest").alias("known"))
        ranked = staged(_best(sums, candidates + 1), f"search-tier-{tier}")
        first = ranked.filter(F.col("rank") <= candidates)
        # of those that are not scored: by their own bounds, for which all sums are read again
        cut = ranked.groupBy("query").agg(F.max("rank").alias("n"))
        others = sums.join(F.broadcast(first.select("query", "row")), ["query", "row"], "left_anti").groupBy("query").agg(F.max(F.col("score") - F.col("known")).alias("over"))
        bounds = {r["query"]: r["over"] for r in others.join(cut.filter(F.col("n") > candidates), "query", "left_semi").collect()}  # a row a query
        whole = first.select("query", "row").join(self.forward, "row").select("query", "row", "doc_id", "n", F.explode(F.arrays_zip("terms", "times")).alias("p"))
        m = F.lit(100 - 90) + F.expr(f"(90 * n * {self.args[0]}L) div {self.args[1]}L")
        whole = whole.withColumn("m", m).selectExpr("query", "row", "doc_id", "p.terms AS term", "(1000000000L * p.times) div (1000 * p.times + 8 * m) AS s")
        exact = whole.join(F.broadcast(terms), ["query", "term"]).groupBy("query", "row", "doc_id").agg(F.sum(F.col("w") * F.col("s")).alias("score"))
        results = staged(_best(exact.filter("score > 0"), top), f"search-found-{tier}", keep=True)
        last = {r["query"]: (r["n"], r["least"]) for r in results.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).collect()}  # a row a query
        proven = []
        for k in open_:
            n, least = last.get(k, (0, 0))
            unseen = rest[k]
            best_other = max(unseen, bounds[k] + unseen) if k in bounds else unseen
            if best_other == 0 or n == top and least > best_other:
                proven.append(k)
        return results, proven


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, tiers: tuple[int, ...] = TIERS, candidates: int = CANDIDATES, block_terms: int = BLOCK_TERMS, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents, score above 0."""
    terms = F.array_distinct(F.regexp_extract_all(lower_ascii(whole_text(text_col)), F.lit(TERM), F.lit(0)))
    asked = staged(items.select(F.col(item_col).alias("item_id"), terms.alias("terms"), F.xxhash64(text_col).alias("h")), "search-items")
    total = asked.agg(F.sum(F.size("terms"))).collect()[0][0] or 0  # one number
    blocks = -(-total // block_terms) or 1
    out = None
    for k in range(blocks):
        with scratch():
            rows = asked.filter((F.size("terms") > 0) & (F.pmod("h", F.lit(blocks)) == k)).collect()  # a block of queries
            words = sorted({t for r in rows for t in r["terms"]})
            ids = {t: i for i, t in enumerate(words)}
            index = Index(docs, {t.encode(): i for t, i in ids.items()}, tiers, id_col, text_col)
            if not rows:
                found = index.forward.limit(0).selectExpr("0L AS query", "0 AS rank", "doc_id", "0L AS score")
            else:
                found = index.search([np.array(sorted(ids[t] for t in r["terms"])) for r in rows], top, candidates)
            kind = asked.schema["item_id"].dataType
            names = asked.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"query long, item_id {kind.simpleString()}")
            done = found.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
            done = staged(done, "search-results", keep=True)
        out = done if out is None else out.unionByName(done)
    return out


def brute_search(docs: list[tuple], items: list[tuple], top: int = TOP) -> list[tuple]:
    """A plain version without an index: for tests. docs and items: (id, text)."""
    import re

    def terms(text: str | None) -> list[str]:
        return re.findall(TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    held = [(d, t) for d, text in docs if (t := terms(text))]
    n_docs, tokens = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        scores = []
        for k, (d, words) in enumerate(held):
            m, score = 100 - 90 + (90 * len(words) * n_docs) // tokens, 0
            for term in set(terms(text)):
                if tf := words.count(term):
                    df = sum(term in w for _, w in held)
                    score += weight(n_docs, df) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0, k, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, _, d) in enumerate(sorted(scores)[:top])]
    return out
