"""Secret scans in DataFrame operations only: known shapes by regular expression, unknown ones by Markov models.

Two character Markov models of first order, one of random strings and one of ordinary identifiers, are counted from
labelled samples, and the latter also from all words of letters in the texts. Their log-likelihood ratio turns into one table over pairs of characters; a long token whose mean over
its pairs is beyond a threshold becomes a span of kind "random". The table is a constant of the plan, so scoring stays
in the JVM.

Defined results. Null text counts as empty. Positions are code points, ends exclusive. Base spans of different kinds may
overlap and all stay; a "random" span that would overlap a base span is not added. Rows may repeat.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import free_names, quoted_name, whole_text

#: The base patterns. A match counts if the given group has at least so many characters.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
#: What the models judge, and the mean ratio of a pair from which a token is called random.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
THRESHOLD = 0.25
KINDS = [k for k, *_ in BASE] + ["random"]
_SPANS = "array<struct<start:int,rank:int,end:int>>"

#: Ordinary parts of identifiers, for the labelled samples.
PARTS = (
    "access account action active address amount array async average base batch before begin block body buffer build button cache call cell chain change channel char child class clean client clock "
    "close cloud code color column command commit common config connect content context count create current cursor data date default delete depth design device digest direct display document domain "
    "draw driver edge email empty enable encode engine entry error event execute export extra factory field file filter final find first flag flow folder format found frame from function get global "
    "graph group handle hash head height help hidden host icon image import index info init input insert integer invoice item join keyboard label language last layer layout left length level library "
    "limit line link list load local location lock logger main manager map margin match maximum memory message meta method minimum mode model module mouse move multi name native network next node "
    "normal notify null number object offset open option order origin output owner page panel parent parse partition path pattern payload percent person pixel plan player plugin point policy pool "
    "port position prefix price print process product profile project property public query queue random range read record refresh region register remove render repeat report request reset resource "
    "response result return right role root route row rule run sample save scale schema scope screen script search section select send sequence server service session set shared signal simple single "
    "size slice socket sort source space stack stage start state static status step storage store stream string style submit suffix summary switch sync system table target task template test text "
    "thread time title toggle total trace track transfer transform type unique unit update upload user value variable vector version video view visible warning weight widget width window worker wrapper write zone"
).split()


def labelled_samples(seed: int = 5, n: int = 6000) -> Iterable[tuple[str, int]]:
    """(string, 1 if random): strings drawn evenly from usual alphabets, and identifiers, paths, numbers and rules of lines."""
    rng = random.Random(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [upper + lower + digits + "+/", upper + lower + digits, upper + lower + digits + "-_", upper + digits, lower + digits]
    for _ in range(n):
        yield "".join(rng.choice(a) for a in [rng.choice(alphabets)] for _ in range(rng.randrange(20, 65))), 1
        parts = [rng.choice(PARTS) for _ in range(rng.randrange(2, 7))]
        shape = rng.randrange(9)
        if shape < 7:
            joined = [
                "_".join(parts), "-".join(parts), "_".join(parts).upper(), parts[0] + "".join(p.title() for p in parts[1:]),
                "".join(p.title() for p in parts), "/" + "/".join(parts), "".join(parts),
            ][shape]
            yield joined + (rng.choice(["_", "-", "", "/"]) + str(rng.randrange(3000)) if rng.random() < 0.3 else ""), 0
        elif shape == 7:
            yield "".join(rng.choice(digits) for _ in range(rng.randrange(20, 40))), 0
        else:
            yield rng.choice("-=_+/") * rng.randrange(20, 60), 0


def corpus_pairs(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of letter pairs within words of letters, over all rows and whole texts. A copy counts like any row."""
    words = docs.select(F.col(text_col).alias("t")).select(F.explode(F.expr(r"regexp_extract_all(t, '(?<![A-Za-z0-9+/_=-])[A-Za-z]{4,}(?![A-Za-z0-9+/_=-])', 0)")).alias("w"))
    # the pairs that begin at odd places, then those at even ones: a word of any length is gone through twice
    pairs = words.select(F.explode(F.expr("concat(regexp_extract_all(w, '..', 0), regexp_extract_all(substring(w, 2), '..', 0))")).alias("p"))
    counts = np.zeros((128, 128))
    for r in pairs.groupBy("p").count().collect():  # at most 52 * 52 rows
        counts[ord(r["p"][0]), ord(r["p"][1])] += r["count"]
    return counts


def ratio_table(samples: Iterable[tuple[str, int]], ordinary_pairs: np.ndarray | None = None) -> np.ndarray:
    """Log-likelihood ratio of random over ordinary for each pair of ASCII characters."""
    counts = np.zeros((2, 128, 128))
    for s, label in samples:
        codes = np.frombuffer(s.encode("ascii"), np.uint8)
        np.add.at(counts[label], (codes[:-1], codes[1:]), 1)
    if ordinary_pairs is not None and ordinary_pairs.sum():
        # the words in small, capital and mixed letters, weighing as much as the samples
        share = ordinary_pairs * counts[0].sum() / ordinary_pairs.sum() / 2
        for a in range(128):
            for b in np.flatnonzero(share[a]):
                x, y = chr(a), chr(int(b))
                counts[0, a, b] += share[a, b]
                counts[0, ord(x.upper()), ord(y.upper())] += share[a, b] / 2
    smooth = counts + 0.5
    given = smooth / smooth.sum(2, keepdims=True)
    return np.log(given[1]) - np.log(given[0])


class Growing:
    """A list that a fold adds to: a part of at most CHUNK elements grows, full parts are put aside, so that a long list is not copied
    whole for every element."""

    CHUNK = 200

    def __init__(self, kind: str):
        self.kind = kind

    def empty(self) -> list[Column]:
        return [F.expr(f"cast(array() as array<{self.kind}>)").alias("part"), F.expr(f"cast(array() as array<array<{self.kind}>>)").alias("full")]

    def added(self, acc: Column, more: Column, adds: Column | None = None) -> list[Column]:
        """part and full with the array `more` (few elements), where `adds` holds."""
        over, adds = F.size(acc["part"]) >= self.CHUNK, F.lit(True) if adds is None else adds
        part = F.when(~adds, acc["part"]).when(over, more).otherwise(F.concat(acc["part"], more))
        return [part.alias("part"), F.when(adds & over, F.concat(acc["full"], F.array(acc["part"]))).otherwise(acc["full"]).alias("full")]

    @staticmethod
    def all(acc: Column) -> Column:
        return F.concat(F.flatten(acc["full"]), acc["part"])


_SPAN_LIST, _TEXT_LIST = Growing("struct<start:int,rank:int,end:int>"), Growing("string")


def _located(text: Column, pattern: str, group: int, least: int, rank: int) -> Column:
    """Spans of the pattern's matches, left to right: the gaps between matches give the positions."""
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("m"), tested.alias("g"))
    zero = F.struct(F.lit(0).alias("at"), *_SPAN_LIST.empty())

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        return F.struct(end.alias("at"), *_SPAN_LIST.added(acc, span, F.length(x["g"]) >= least))

    return F.when(text.rlike(pattern), F.aggregate(rows, zero, step, Growing.all)).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _random_flags(table: np.ndarray, threshold: float, text: Column) -> Column:
    """Whether each match of TOKEN is random. A token is cut into codes once, and its pairs are looked up in them."""
    values = F.split(F.lit(",".join(f"{v:.4f}" for v in table.ravel())), ",").cast("array<double>")

    def judged(codes: Column) -> Column:
        ratios = F.zip_with(codes, F.slice(codes, F.lit(2), F.size(codes)), lambda a, b: F.coalesce(F.get(values, a * 128 + b), F.lit(0.0)))
        return F.aggregate(ratios, F.lit(0.0), lambda acc, v: acc + v) / (F.size(codes) - 1) > threshold

    codes = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.transform(F.split(t, ""), F.ascii))
    return F.transform(codes, judged)


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens that meet no base span. Both are in order of their starts: going on, the furthest end of the base spans so far
    tells of those that begin before a token's end; they stand before a token that begins where they do, or inside it."""
    bound = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(0).alias("token"), b["start"].alias("start"), b["end"].alias("end")))
    # a token is judged at its end, when all base spans that begin before it are known
    ends = F.transform(tokens, lambda t: F.struct((t["end"] - 1).alias("at"), F.lit(1).alias("token"), t["start"].alias("start"), t["end"].alias("end")))
    zero = F.struct(F.lit(-1).alias("far"), *_SPAN_LIST.empty())

    def step(acc: Column, x: Column) -> Column:
        free = (x["token"] == 1) & (acc["far"] <= x["start"])
        span = F.array(F.struct(x["start"].alias("start"), F.lit(len(BASE)).alias("rank"), x["end"].alias("end")))
        return F.struct(F.when(x["token"] == 0, F.greatest(acc["far"], x["end"])).otherwise(acc["far"]).alias("far"), *_SPAN_LIST.added(acc, span, free))

    return F.aggregate(F.array_sort(F.concat(bound, ends)), zero, step, Growing.all)


#: Code points of a piece that a text is cut into before parts of it are taken, so that no part is sought from its begin.
PIECE = 4096


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """The text from start to end, from its pieces."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    part = lambda k: F.substring(F.get(pieces, k), F.greatest(start - k * PIECE, F.lit(0)) + 1, F.least(end - k * PIECE, F.lit(PIECE)) - F.greatest(start - k * PIECE, F.lit(0)))
    return F.when(start < end, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise(F.lit(""))


def _joined(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"], s["end"])), ",")


_HELPERS = ("text", "flags", "free", "random", "base", "spans", *(k for k, *_ in BASE))


def find_secrets(docs: DataFrame, text_col: str = "text", table: np.ndarray | None = None, threshold: float = THRESHOLD, prefix: str = "_") -> DataFrame:
    """docs with the columns base and spans, each behind the prefix, added: arrays of (start, rank, end), rank being the
    kind's place in KINDS; and an array for each base kind. Columns of docs under these names are replaced."""
    if table is None:
        table = ratio_table(labelled_samples(), corpus_pairs(docs, text_col))
    name = {k: prefix + k for k in _HELPERS}
    text, base = F.col(name["text"]), F.col(name["base"])
    df = docs.withColumn(name["text"], whole_text(text_col))
    # hex and access: a failing match takes its whole run, so asking for the length in the pattern finds the same
    shapes = [ASSIGN, r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"]
    for rank, ((kind, _, group, least), pattern) in enumerate(zip(BASE, shapes, strict=True)):
        df = df.withColumn(name[kind], _located(text, pattern, group, least, rank))
    df = df.withColumn(name["base"], F.array_sort(F.concat(*(F.col(name[k]) for k, *_ in BASE))))
    # a match of TOKEN has 20 characters or more, so all are spans, in the order of their flags
    flagged = F.zip_with(_located(text, TOKEN, 0, 20, len(BASE)), name["flags"], lambda s, random: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), random.alias("random")))
    tokens = F.transform(F.filter(flagged, lambda x: x["random"]), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
    df = df.withColumn(name["flags"], _random_flags(table, threshold, text)).withColumn(name["free"], tokens)
    df = df.withColumn(name["random"], F.when(F.size(name["free"]) == 0, F.col(name["free"])).otherwise(_apart(F.col(name["free"]), base)))
    df = df.withColumn(name["spans"], F.when(F.size(name["random"]) == 0, base).otherwise(F.array_sort(F.concat(base, F.col(name["random"])))))
    return df.drop(name["text"], name["flags"], name["free"], name["random"])


def secret_report(docs: DataFrame, **more) -> DataFrame:
    """doc_id, counts of the base kinds and of "random", base_sha256, spans, for every row of docs."""
    found = find_secrets(docs.select("doc_id", "text"), **more)
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k, *_ in BASE]
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), *counts, (F.size("_spans") - F.size("_base")).cast("long").alias("n_random"), F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans")
    )


def mask_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", **more) -> DataFrame:
    """docs with every span of the text, overlapping ones as one, replaced by the mark; all other columns as they are,
    whatever their names."""
    prefix = free_names(docs.columns, *_HELPERS)[0].removesuffix(_HELPERS[0])
    found = find_secrets(docs, text_col, prefix=prefix, **more)
    text, spans = F.col(quoted_name(text_col)), F.col(prefix + "spans")

    def masked(pieces: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), *_TEXT_LIST.empty())

        def step(acc: Column, s: Column) -> Column:
            more = F.array(_between(pieces, acc["at"], s["start"]), F.lit(mark))
            apart = s["start"] >= acc["at"]  # else it carries on the span before
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), *_TEXT_LIST.added(acc, more, apart))

        return F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(Growing.all(acc), ""), _between(pieces, acc["at"], F.length(text))))

    # the element of an array of one is computed once
    whole = F.get(F.transform(F.array(_pieces(text)), masked), 0)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, whole).otherwise(text)).select(*map(quoted_name, docs.columns))


def mean_ratio(table: np.ndarray, token: str) -> float:
    """What the plan computes for a token, for tests and for tuning."""
    values = [round(float(table[ord(a), ord(b)]), 4) for a, b in zip(token, token[1:], strict=False)]
    return math.fsum(values) / len(values)
