"""N-gram Jaccard self-join by token-combination prefixes, and its components.

A document is its set of word shingles, hashed to 64 bits. Documents with equal sets form one node, its hash of 64 bits;
where two differing sets meet in one, a second hash tells, and their nodes become that one. Tokens are ordered from rare
to frequent by a sketch that counts the shingles of all documents. With threshold t, a partner misses at most d = n - ceil(t n) of a
set's n tokens. Rare tokens are indexed singly. Frequent ones fall into classes of k = 2 or 3, dealt by hash into small
groups, and are indexed by every combination of k tokens of a group. The prefix is extended until no choice of d missing
tokens could break all its entries: a single costs one missing token, a group of c tokens c - k + 1. The prefix that
ends first in the common order lies within the other, so two documents that link share an entry.

Entries that two or more nodes share lead to candidates without listing a large group's pairs. First each node is tested
with its entry's leader, the node with the fewest rare tokens; links join nodes to components. The large entries of a
leader are its family. A leader may be linked with none of its family while the others are near copies of each other, so
a second leader follows: a node of the largest component outside is tested with the family, until that links nothing more.
Only entries that still hold several components go on. In an entry of at most FEW nodes, nodes of differing components meet, at most FEW / 2
rows an entry. In a larger one every node x is described by what sets it apart from the leader, D(x) = x ^ leader, since
x ^ y = D(x) ^ D(y). With threshold t of 100, x and y link exactly if S(x) + S(y) <= 2 (100 + t) |D(x) & D(y)|, where
S(x) = (100 + t) |D(x)| - (100 - t) |x|. Where the left side is not positive both link to the entry's node of least S, so
that pair is enough; else they share a token of D, and prefixes of D over the common order, as long as S asks for, find
the pair. What members of a family of copies have in common is not in D, so it brings nobody together. Nodes that several
families hold meet in that of their least common leader only. Sizes, and
parities of token counts over 256 bits that bound the symmetric difference from below, discard candidates exactly; the
others are verified on their whole sets.

Defined results. Null, empty or blank text gives an empty set that links with nothing. Fewer words than a shingle make
one shingle of the whole sequence. Repeated rows, doc_ids that repeat with other texts, and null doc_ids are fine: each
row gives a row, and a component's id is its least doc_id that is not null. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.components import connected_components
from veilspark.llm.shared import forget, scratch, slices, staged, whole_text

#: Rows of a broadcast id list at most; beyond, the join shuffles.
BROADCAST_IDS = 500_000
#: Nodes of an entry up to which those of differing components meet pair by pair. What sets a node apart from a leader is
#: tens to hundreds of tokens, a row each, so that for fewer nodes the pairs are fewer rows.
FEW = 64
#: Second leaders of a family at most: they only save pairs, what they leave is found without them.
SECOND = 5
CHUNK = 1 << 14
_M = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _M(31))) * _M(0x7FB5D329728EA185)
        x = (x ^ (x >> _M(27))) * _M(0x81DADEF4BC2DD44D)
    return x ^ (x >> _M(33))


class Words:
    """Hashes of words, remembered up to a bound."""

    def __init__(self, entries: int = 1 << 18):
        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= entries:
                    self.clear()
                self[word] = h = xxhash.xxh3_64_intdigest(word)
                return h

        self.known = Known()

    def shingles(self, data: bytes, size: int) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles."""
        words = data.lower().split()  # bytes: lowers A-Z only, splits at ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        width = min(size, len(h))
        n = len(h) - width + 1
        with np.errstate(over="ignore"):
            code = np.full(n, width, np.uint64)
            for k in range(width):
                code = _mixed(code * _M(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(code)


def hashes_of(tokens: np.ndarray) -> tuple[int | None, int | None]:
    """Two hashes of a set, each of 64 bits; none of an empty set."""
    if not len(tokens):
        return None, None
    first, second = divmod(xxhash.xxh3_128_intdigest(tokens.tobytes()), 1 << 64)
    return first - (1 << 63), second - (1 << 63)


def node_of(tokens: np.ndarray, twice: frozenset = frozenset()) -> int | None:
    """The first hash, or the second where differing sets share the first (twice)."""
    first, second = hashes_of(tokens)
    return second if first in twice else first


def parities(tokens: np.ndarray) -> np.ndarray:
    """Parity of the number of tokens in each of 256 classes, as four 64-bit numbers."""
    return np.packbits((np.bincount((tokens & _M(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view("<i8")


_FACTS = "doc_id long, mark long, node long, again long, n long, p0 long, p1 long, p2 long, p3 long, chunk int, counts binary"


def _facts(size: int, width: int):
    """A row of facts for each document, and the task's counts of tokens by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, nothing = Words(), np.zeros(1 << width, np.uint32), np.zeros(0, np.uint64)  # counts of a task
        names = [f.split()[0] for f in _FACTS.split(", ")]
        for batch in slices(batches):
            sets = [words.shingles(data, size) for data in batch.column(1).to_pylist()]
            buckets, times = np.unique(np.concatenate([nothing, *sets]) >> _M(64 - width), return_counts=True)
            counts[buckets.astype(np.int64)] += times.astype(np.uint32)
            rows = [(*hashes_of(t), len(t), *parities(t).tolist()) for t in sets]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            empty = [pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns, *empty], names)
        used = [k for k in range(0, 1 << width, CHUNK) if counts[k : k + CHUNK].any()]
        data = [zlib.compress(counts[k : k + CHUNK].astype("<i8").tobytes(), 1) for k in used]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(used), pa.int64())] * 9, pa.array([k // CHUNK for k in used], pa.int32()), pa.array(data, pa.binary())], names)

    return run


def _summed(part: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for data in part.column("counts").to_pylist():
        total += np.frombuffer(zlib.decompress(data), "<i8")
    return pa.table({"chunk": pa.array([part.column("chunk")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())})


def levels(counted: DataFrame, width: int) -> tuple[np.ndarray, float]:
    """Half-octave of each bucket's count, one byte a bucket, and the mean count. Summed in two steps of salted tasks."""
    salted = counted.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(32)))
    schema = "chunk int, counts binary"
    once = salted.groupBy("chunk", "salt").applyInArrow(_summed, schema)
    out, total = np.zeros(1 << width, np.uint8), 0
    for r in once.groupBy("chunk").applyInArrow(_summed, schema).collect():  # 2 ** width counts, compressed
        c = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = _level(c)
        total += int(c.sum())
    return out, total / (1 << width)


def _level(counts) -> np.ndarray:
    return np.minimum(255, np.floor(2 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


class Prefixes:
    """Index entries of a set. percent is the threshold; see the module's text for the rule."""

    def __init__(self, percent: int, table: np.ndarray, mean: float):
        self.percent, self.table = percent, table
        self.shift = _M(64 - int(len(table)).bit_length() + 1)
        #: Up to this level a token counts as rare, up to the next as frequent.
        self.rare = int(_level(np.array(max(8.0, 4 * mean))))
        self.frequent = self.rare + 10
        self.step = np.log(100 / percent)

    def ordered(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens from rare to frequent, and their levels."""
        level = self.table[(tokens >> self.shift).astype(np.int64)]
        order = np.lexsort((_mixed(tokens), level))
        return tokens[order], level[order]

    def missing(self, n: int) -> int:
        return n + (-self.percent * n) // 100

    def size_level(self, n: int) -> int:
        return int(np.floor(np.log(n) / self.step + 1e-9))

    def groups(self, level: int) -> int:
        """How many groups a frequent class is dealt into for sets of this level; 0: all tokens count as rare."""
        low, high = int(np.exp(level * self.step)), int(np.ceil(np.exp((level + 1) * self.step)))
        spare = (low - self.missing(high) - 1) // 3  # the groups of two classes cost 1 and 2 tokens each
        return 0 if low < 16 or spare < 1 else max(1, min(spare, int(np.ceil(0.375 * self.missing(high)))))

    def entries(self, tokens: np.ndarray) -> tuple[np.ndarray, int]:
        """Keys of the set's entries, and how many of its tokens are rare."""
        n = len(tokens)
        tokens, level = self.ordered(tokens)
        need = self.missing(n) + 1
        rare = int((level <= self.rare).sum())
        if rare >= need:
            return _mixed(tokens[:need]), rare
        keys = []
        own = self.size_level(n)
        for at in sorted({own, self.size_level(max(n, 100 * n // self.percent))}):
            keys.append(self._with_groups(tokens, level, need, at))
        return np.unique(np.concatenate(keys)), rare

    def _with_groups(self, tokens: np.ndarray, level: np.ndarray, need: int, at: int) -> np.ndarray:
        groups = self.groups(at)
        if not groups:
            return _mixed(tokens[:need])
        k = np.where(level <= self.rare, 1, np.where(level <= self.frequent, 2, 3))
        singles = tokens[k == 1]
        where = np.where(k == 1, 0, k * _M(groups) + _mixed(tokens + _M(1)) % _M(groups)).astype(np.int64)
        held, broken, end = {}, len(singles), len(tokens)
        for i in range(len(singles), len(tokens)):  # rare tokens come first in the order
            held.setdefault(int(where[i]), []).append(i)
            broken += len(held[int(where[i])]) >= k[i]
            if broken >= need:
                end = i + 1
                break
        if broken < need:
            raise AssertionError(f"a prefix of all {end} tokens falls short of {need}")
        out = [_mixed(singles)]
        for members in held.values():
            m = np.sort(tokens[members])
            picks = np.array(list(combinations(range(len(m)), int(k[members[0]]))), np.int64)
            if len(picks):
                with np.errstate(over="ignore"):
                    code = np.full(len(picks), _M(at + 1000), np.uint64)
                    for column in picks.T:
                        code = _mixed(code * _M(0x9E3779B97F4A7C15) + m[column])
                out.append(code)
        return np.concatenate(out)


def _postings(size: int, prefixes, twice: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, p, seen = Words(), prefixes.value, set()
        for batch in slices(batches):
            keys, nodes, ranks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for data in batch.column(0).to_pylist():
                tokens = words.shingles(data, size)
                node = node_of(tokens, twice)
                if len(tokens) < 2 or node in seen:  # a set of one token links with equal sets only
                    continue
                if len(seen) > 1 << 18:
                    seen.clear()
                seen.add(node)
                k, rare = p.entries(tokens)
                keys.append(k)
                nodes.append(np.full(len(k), node))
                ranks.append(np.full(len(k), rare))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(ranks))], ["key", "node", "rare"])

    return run


def _sets(size: int, twice: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches):
            tokens = [words.shingles(x, size) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(t, twice) for t in tokens], pa.int64()), pa.array([t.view(np.int64) for t in tokens], pa.list_(pa.int64()))], ["node", "tokens"])

    return run


_APART = "leader long, node long, label long, outside boolean, n long, p0 long, p1 long, p2 long, p3 long, leaders array<long>, d long, s long, place long, token long, within boolean"


def _differences(prefixes):
    """For each node of an entry (leader, node, label, outside, size and parities, its leaders, its tokens, the leader's): rows of the
    tokens that set it apart from the leader, in order. Nodes outside the leader's component give all, the others their prefix (within)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = prefixes.value
        more, less = 100 + p.percent, 100 - p.percent
        for batch in slices(batches):
            keys, columns = [], []
            for k, (outside, x, base) in enumerate(zip(batch.column(3).to_pylist(), batch.column(10), batch.column(11), strict=True)):
                x, base = (a.values.to_numpy(zero_copy_only=False).view(np.uint64) for a in (x, base))
                tokens = p.ordered(np.setxor1d(x, base, assume_unique=True))[0]
                d = len(tokens)
                s = more * d - less * len(x)
                # a partner outside has S > less * |leader|, so at least so many tokens of D are in common
                common = max(1, -(-(s + less * len(base) + 1) // (2 * more)))
                length = d if outside else d - common + 1
                keys.append(np.full(length, k))
                columns.append((np.full(length, d), np.full(length, s), np.arange(1, length + 1), tokens[:length].view(np.int64), np.arange(1, length + 1) <= d - common + 1))
            if keys:
                of = batch.select(list(range(10))).take(pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([*of.columns, *(pa.array(np.concatenate(c)) for c in zip(*columns, strict=True))], [f.split()[0] for f in _APART.split(", ")])

    return run


class JaccardJoin:
    """The join's steps over one table, each staged where it is used more than once."""

    def __init__(self, docs: DataFrame, percent: int, size: int, id_col: str, text_col: str, width: int | None, few: int = FEW):
        self.percent, self.size, self.few = percent, size, few
        data = F.encode(whole_text(text_col), "UTF-8")
        self.rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("text"), F.xxhash64(data).alias("mark"))
        if width is None:  # about four buckets a document; one byte a bucket is broadcast, 16 MB at most
            width = min(24, max(16, (4 * max(docs.count(), 1) - 1).bit_length()))
        self.width = width

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, node, n of each row), (a, b: linked nodes that span each component)."""
        facts = staged(self.rows.mapInArrow(_facts(self.size, self.width), _FACTS), "ngram-facts")
        self.facts = self.with_nodes(facts.filter("chunk is null").drop("chunk", "counts"))
        table, mean = levels(facts.filter("chunk is not null").select("chunk", "counts"), self.width)
        self.prefixes = self.rows.sparkSession.sparkContext.broadcast(Prefixes(self.percent, table, mean))
        with scratch():  # entries and sets go as soon as pairs are known
            first, pairs = self.candidates(self.shared_entries())
        with scratch():
            second = self.verified(pairs, self.sets(pairs))
        return self.facts, first.unionByName(second)

    def candidates(self, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(links with leaders, pairs that are left to verify)."""
        known = self.facts.join(shared.select("node").distinct(), "node", "left_semi")
        self.nodes = staged(known.groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), *(F.first(c).alias(c) for c in ("n", "p0", "p1", "p2", "p3"))), "ngram-nodes", keep=True)
        others = shared.filter("node <> leader")
        families = staged(others.filter(F.col("size") > self.few).select("leader", "node").distinct(), "ngram-families")
        pairs = staged(self.plausible(others.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()), "ngram-pairs")
        sets = self.sets(pairs, families.select(F.col("leader").alias("a"), F.col("node").alias("b")))
        first, labels = self.led_again(families, sets, self.verified(pairs, sets))
        again = self.within_few(self.labelled(shared.filter(F.col("size") <= self.few), labels))
        apart = self.plausible(self.apart(self.labelled(families, labels), sets))
        return first, staged(again.unionByName(apart).distinct(), "ngram-pairs", keep=True)

    def with_nodes(self, facts: DataFrame) -> DataFrame:
        """facts with nodes that tell differing sets apart, whose first hashes may be equal."""
        both = facts.filter("node is not null").groupBy("node").agg(F.min("again").alias("lo"), F.max("again").alias("hi"))
        self.twice = frozenset(r["node"] for r in both.filter("lo < hi").collect())  # of n sets, about n ** 2 / 2 ** 65
        if self.twice:
            facts = facts.withColumn("node", F.when(F.col("node").isin(*self.twice), F.col("again")).otherwise(F.col("node")))
        return facts.drop("again")

    def shared_entries(self) -> DataFrame:
        """key, node, leader, size: the entries that several nodes hold, and how many."""
        with scratch():
            posted = staged(self.rows.select("text").mapInArrow(_postings(self.size, self.prefixes, self.twice), "key long, node long, rare long"), "ngram-entries")
            several = posted.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key")
            shared = staged(posted.join(several, "key", "left_semi").distinct(), "ngram-shared")
            forget(posted)
            lead = shared.groupBy("key").agg(F.min(F.struct("rare", "node")).alias("lead"), F.count(F.lit(1)).alias("size")).select("key", F.col("lead.node").alias("leader"), "size")
            return staged(shared.select("key", "node").join(lead, "key"), "ngram-led", keep=True)

    def _passes(self, x: str, y: str) -> Column:
        """Neither sizes nor parities rule the pair out."""
        n, m, t = F.col(f"{x}n"), F.col(f"{y}n"), self.percent
        differ = sum(F.bit_count(F.col(f"{x}p{k}").bitwiseXOR(F.col(f"{y}p{k}"))) for k in range(4))
        return (100 * F.least(n, m) >= t * F.greatest(n, m)) & ((100 + t) * differ <= (100 - t) * (n + m))

    def _side(self, name: str) -> DataFrame:
        return self.nodes.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", "p0", "p1", "p2", "p3")))

    def plausible(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self._side("a"), "a").join(self._side("b"), "b").filter(self._passes("a_", "b_")).select("a", "b")

    def labelled(self, entries: DataFrame, labels: DataFrame) -> DataFrame:
        """Entries with the components of their node (label) and leader (top)."""
        label = labels.select("node", "label")
        top = labels.select(F.col("node").alias("leader"), F.col("label").alias("top"))
        both = entries.join(label, "node", "left").join(top, "leader", "left")
        return both.withColumn("label", F.coalesce("label", "node")).withColumn("top", F.coalesce("top", "leader"))

    def led_again(self, families: DataFrame, sets: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(links with those that second leaders of families add, labels by them). A round tests each node of a family once."""
        labels = connected_components(links)
        for _ in range(SECOND):
            led = staged(self.labelled(families, labels), "ngram-second")
            parts = led.filter("label <> top").groupBy("leader", "label").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("second"))
            second = parts.groupBy("leader").agg(F.max(F.struct("nodes", "second", "label")).alias("m")).select("leader", "m.second", F.col("m.label").alias("its_label"))
            pairs = led.join(second, "leader").filter("label <> its_label").select(F.least("node", "second").alias("a"), F.greatest("node", "second").alias("b")).distinct()
            more = self.verified(self.plausible(pairs), sets)
            if more.isEmpty():
                break
            links = links.unionByName(more)
            labels = connected_components(links)
        return links, labels

    def within_few(self, led: DataFrame) -> DataFrame:
        """Candidates of small entries that still hold several components."""
        open_keys = led.filter("label <> top").select("key").distinct()
        open_ = staged(led.join(open_keys, "key", "left_semi").join(self.nodes.drop("rep"), "node"), "ngram-open")
        columns = ["node", "label", "n", "p0", "p1", "p2", "p3"]
        a = open_.filter("label <> top").select(F.col("key").alias("a_key"), *(F.col(c).alias(f"a_{c}") for c in columns))
        b = open_.filter("node <> leader").select(F.col("key").alias("b_key"), *(F.col(c).alias(f"b_{c}") for c in columns), (F.col("label") == F.col("top")).alias("with_leader"))
        once = F.col("with_leader") | (F.col("a_node") < F.col("b_node"))
        pairs = a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("a_label") != F.col("b_label")) & once & self._passes("a_", "b_"))
        return pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()

    def apart(self, families: DataFrame, sets: DataFrame) -> DataFrame:
        """Candidates of large entries, by what sets their nodes apart from the leader."""
        facts = ["n", "p0", "p1", "p2", "p3"]
        led = families.withColumn("outside", F.col("label") != F.col("top"))
        led = staged(led.join(led.filter("outside").select("leader").distinct(), "leader", "left_semi"), "ngram-outside")
        leaders = led.groupBy("node").agg(F.collect_set("leader").alias("leaders"))
        led = led.join(self.nodes.drop("rep"), "node").join(sets, "node").join(sets.select(F.col("node").alias("leader"), F.col("tokens").alias("base")), "leader").join(leaders, "node")
        rows = staged(led.select("leader", "node", "label", "outside", *facts, "leaders", "tokens", "base").mapInArrow(_differences(self.prefixes), _APART), "ngram-apart")
        a = rows.filter("outside").select("leader", "token", *(F.col(c).alias(f"a_{c}") for c in ("node", "label", "d", "s", "place", "leaders", *facts)))
        b = rows.filter("within").select("leader", "token", *(F.col(c).alias(f"b_{c}") for c in ("node", "label", "d", "s", "place", "leaders", *facts)))
        common = F.ceil((F.col("a_s") + F.col("b_s")) / (2 * (100 + self.percent)))
        near = (F.col("a_label") != F.col("b_label")) & (F.col("a_place") + common <= F.col("a_d") + 1) & (F.col("b_place") + common <= F.col("b_d") + 1)
        first = F.array_min(F.array_intersect("a_leaders", "b_leaders")) == F.col("leader")
        met = a.join(b, ["leader", "token"]).filter(near & self._passes("a_", "b_") & first)
        # each node's first row; the node of least S stands for all whose difference is small enough without a common token
        once = rows.filter("place = 1")
        least = once.groupBy("leader").agg(F.min(F.struct("s", "node", "label")).alias("m"))
        sure = once.filter("outside").join(least, "leader").filter("label <> m.label AND s + m.s <= 0").select(F.col("node").alias("a_node"), F.col("m.node").alias("b_node"))
        return met.select("a_node", "b_node").unionByName(sure).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()

    def sets(self, pairs: DataFrame, *more: DataFrame) -> DataFrame:
        """node, tokens of the nodes in the pairs, read from one row's text each."""
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
        for p in more:
            wanted = wanted.unionByName(p.select(F.col("a").alias("node"))).unionByName(p.select(F.col("b").alias("node")))
        # one row stands for a node; only rows that are equal as wholes could come twice, which repeats a link
        ids = staged(self.nodes.join(wanted.distinct(), "node", "left_semi").select("rep.doc_id", "rep.mark"), "ngram-wanted")
        few = ids.count() <= BROADCAST_IDS
        match = self.rows["doc_id"].eqNullSafe(ids["doc_id"]) & (self.rows["mark"] == ids["mark"])
        texts = self.rows.join(F.broadcast(ids) if few else ids, match, "left_semi").select("text")
        return staged(texts.mapInArrow(_sets(self.size, self.twice), "node long, tokens array<long>"), "ngram-sets")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs whose whole sets reach the threshold."""
        left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        linked = pairs.join(left, "a").join(right, "b").filter(100 * both >= self.percent * (F.size("x") + F.size("y") - both))
        return staged(linked.select("a", "b").distinct(), "ngram-links", keep=True)


def near_components(docs: DataFrame, percent: int = 90, size: int = 3, id_col: str = "doc_id", text_col: str = "text", width: int | None = None, marks: bool = False, few: int = FEW) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; links are 100 * intersection >= percent * union. With marks
    also mark, a hash of the row's text, and label, the least node of its component (null without shingles)."""
    with scratch():
        facts, links = JaccardJoin(docs, percent, size, id_col, text_col, width, few).run()
        labels = connected_components(links)
        least = facts.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
        # a component's least doc_id; nodes without links are their own
        labelled = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        top = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
        ids = labelled.select("node", "label").join(top, "label").select("node", "component_id", "label")
        out = facts.join(ids, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *["mark", "label"] * marks)
        return staged(out, "ngram-components", keep=True)
