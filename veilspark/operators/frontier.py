"""Breadth-first traversal: documents of a bounded number of edges as rows, larger ones by joins.

Edges are counted by document first. One of at most WHOLE edges is gathered in a row, and rows are walked many at a time, so that
small documents take one pass, whatever their depth, and a table that is dealt out by document already is not shuffled again. A
larger one is walked level by level: a staged frontier meets the edges, and what was seen before goes. There each level is a join
on (doc_id, node), so the objects of one large document are spread; a level's new nodes are staged, and so is the set of all
seen, once a few levels have gathered. The plan of a level reads staged tables only, so that depth does not make plans longer.

Defined results. Nulls in an edge lead nowhere; a root that no edge begins at is reached itself. Repeated edges and roots count
once, cycles end. A document whose traversal would go deeper than max_depth fails: it gives one row, node and depth null,
and is never cut short. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from veilspark.operators.stage import forget, staged

#: Keys that lead upward and are not followed; the depth beyond which a document fails.
UPWARD, MAX_DEPTH = ("Parent", "P"), 10_000
#: Levels that gather before they join the set of all seen.
GATHERED = 8
#: Edges of a document, its roots included, that a row holds; as many edges are walked at a time.
WHOLE = 500_000


def _and(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def levels(edges: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH, whole: int = WHOLE) -> DataFrame:
    """doc_id, node, depth of all that the roots (doc_id, node) reach along edges (doc_id, src, dst), each at its least depth."""
    node = edges.select(F.coalesce("src", "dst").alias("node")).unionByName(roots.select("node")).schema["node"].dataType
    steps = edges.select("doc_id", F.col("src").cast(node).alias("src"), F.col("dst").cast(node).alias("dst")).dropna()
    begins = roots.select("doc_id", F.lit(None).cast(node).alias("src"), F.col("node").alias("dst")).dropna(subset=["doc_id", "dst"])
    every = steps.unionByName(begins)
    large = staged(every.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > whole).select("doc_id"), "frontier-large")
    none = large.isEmpty()
    schema = StructType().add("doc_id", steps.schema["doc_id"].dataType).add("node", node).add("depth", IntegerType())
    rows = (every if none else every.join(large, "doc_id", "left_anti")).groupBy("doc_id").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    small = rows.mapInArrow(_walks(max_depth, whole), schema)
    if none:
        forget(large)
        return small
    return small.unionByName(_by_levels(steps.join(large, "doc_id", "left_semi"), roots.join(large, "doc_id", "left_semi"), max_depth))


def _walks(max_depth: int, whole: int):
    """Rows of a document's edges, its roots being those without a src, to its nodes and depths; one row of nulls if it is deeper."""

    def walk(docs: pa.Array, edges: pa.ListArray) -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(docs)), edges.value_lengths().to_numpy())
        src, dst = edges.flatten().flatten()
        both = pa.concat_arrays([dst, src]).dictionary_encode()
        codes = both.indices.fill_null(-1).to_numpy().astype(np.int64)
        ids = np.concatenate([doc, doc]) * len(both.dictionary) + codes
        nodes, at = np.unique(ids[codes >= 0], return_inverse=True)
        of, place = np.divmod(nodes, len(both.dictionary))
        begins = codes[len(doc) :] < 0
        to, start = at[: len(doc)], at[len(doc) :]
        new, to = np.unique(to[begins]), to[~begins][np.argsort(start, kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=len(nodes)))])
        depth, level, deep = np.full(len(nodes), -1, np.int32), 0, np.zeros(len(docs), bool)
        while len(new):
            if level > max_depth:
                deep[of[new]] = True
                break
            depth[new] = level
            n = ends[new + 1] - ends[new]
            found = to[np.repeat(ends[new] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            new, level = np.unique(found[depth[found] < 0]), level + 1
        seen, fails = np.flatnonzero((depth >= 0) & ~deep[of]), np.flatnonzero(deep)
        node = pa.concat_arrays([both.dictionary.take(pa.array(place[seen])), pa.nulls(len(fails), both.dictionary.type)])
        least = pa.concat_arrays([pa.array(depth[seen]), pa.nulls(len(fails), pa.int32())])
        return pa.RecordBatch.from_arrays([docs.take(pa.array(np.concatenate([of[seen], fails]))), node, least], ["doc_id", "node", "depth"])

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.cumsum(batch["edges"].value_lengths().to_numpy())
            cuts = np.flatnonzero(np.diff(held // whole, prepend=0))  # a part's edges: fewer than whole, and those of one document
            for begin, end in zip([0, *cuts], [*cuts, len(held)], strict=True):
                if end > begin:
                    part = batch.slice(begin, end - begin)
                    yield walk(part["doc_id"], part["edges"])

    return walks


def _by_levels(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    down = staged(edges.select("doc_id", "src", "dst").dropna(), "frontier-edges")
    recent = [staged(roots.select("doc_id", "node").dropna().distinct().withColumn("depth", F.lit(0)), "frontier")]
    seen: DataFrame | None = None
    depth = 0
    while True:
        at = recent[-1].select("doc_id", F.col("node").alias("src"))
        following = down.join(at, ["doc_id", "src"]).select("doc_id", F.col("dst").alias("node")).distinct()
        for known in [*([seen] if seen is not None else []), *recent]:
            following = following.join(known.select("doc_id", "node"), ["doc_id", "node"], "left_anti")
        new = staged(following.withColumn("depth", F.lit(depth + 1)), "frontier")
        if new.isEmpty():
            forget(new)
            break
        depth += 1
        if depth > max_depth:
            return _failed(_and([*([seen] if seen is not None else []), *recent]), new)
        recent.append(new)
        if len(recent) > GATHERED:
            before = ([seen] if seen is not None else []) + recent[:-1]
            seen, recent = staged(_and(before), "frontier-seen"), recent[-1:]
            forget(*before)
    forget(down)
    return _and([*([seen] if seen is not None else []), *recent])


def _failed(found: DataFrame, deeper: DataFrame) -> DataFrame:
    """The documents that end within the depth, and one row of nulls for those that go on."""
    deep = deeper.select("doc_id").distinct()
    null = F.lit(None)
    return found.join(deep, "doc_id", "left_anti").unionByName(deep.select("doc_id", null.cast("long").alias("node"), null.cast("int").alias("depth")))


def reachable(edges: DataFrame, root: int = 0, max_depth: int = MAX_DEPTH, roots: DataFrame | None = None) -> DataFrame:
    """doc_id, node, depth for every object that a document's root reaches, or its roots (doc_id, node), each once and never
    upward. edges: doc_id, src, key, dst."""
    if roots is None:
        roots = edges.select("doc_id").distinct().withColumn("node", F.lit(root).cast("long"))
    down = edges.filter(~F.coalesce(F.col("key").isin(*UPWARD), F.lit(False)))
    return levels(down, roots, max_depth)


def blanked(strings: DataFrame, held: DataFrame, inside: DataFrame) -> DataFrame:
    """strings (doc_id, node, text) with blank: those of the traversed objects (doc_id, node, depth) that hold a term
    (held: doc_id, node) become empty, all others stay. Of a document that failed nothing can be said to be clean: its strings
    become null, and blank is null."""
    deep = inside.filter("node is null").select("doc_id").distinct().withColumn("deep", F.lit(True))
    hits = held.select("doc_id", "node").distinct().join(inside.select("doc_id", "node"), ["doc_id", "node"], "left_semi").withColumn("hit", F.lit(True))
    marked = strings.select("doc_id", "node", "text").join(hits, ["doc_id", "node"], "left").join(deep, "doc_id", "left")
    fails, hit = F.coalesce("deep", F.lit(False)), F.coalesce("hit", F.lit(False))
    return marked.select("doc_id", "node", F.when(fails, F.lit(None)).when(hit, F.lit("")).otherwise(F.col("text")).alias("text"), F.when(~fails, hit).alias("blank"))


def flattened(nodes: DataFrame, entries: DataFrame, removed: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """doc_id, position, node, place, rewritten for the entries of a name tree that stay, in the tree's order.

    nodes: doc_id, node, parent (null for the root), nth (its place among its parent's children); entries: doc_id, node,
    place; removed: the (doc_id, node, place) of entries that go. A node's children come before its own entries. Where
    an entry goes, the document's tree is rewritten as one flat list, and position counts its entries; else it stays as it
    is, and position is null. A node that the root does not reach has no entries. A document deeper than max_depth fails: one row
    of nulls but for doc_id.

    An entry's key is the path to it, the places of the nodes on the way and then its own behind all children; keys compare
    as arrays do. They grow by a level's join, as the traversal does.
    """
    behind = F.lit((1 << 62)).cast("long")
    tree = staged(nodes.select("doc_id", "node", "parent", F.col("nth").cast("long").alias("nth")).filter("node is not null"), "tree")
    none = F.expr("cast(array() as array<bigint>)")
    level = staged(tree.filter("parent is null").groupBy("doc_id", "node").agg(F.first("nth").alias("nth")).select("doc_id", "node", none.alias("path")), "tree-level")
    found, depth = [level], 0
    while True:
        above = level.select("doc_id", F.col("node").alias("parent"), "path")
        below = tree.join(above, ["doc_id", "parent"]).select("doc_id", "node", F.concat("path", F.array("nth")).alias("path"))
        below = below.groupBy("doc_id", "node").agg(F.min("path").alias("path"))
        for known in found:
            below = below.join(known.select("doc_id", "node"), ["doc_id", "node"], "left_anti")
        level = staged(below, "tree-level")
        if level.isEmpty():
            break
        depth += 1
        if depth > max_depth:
            break
        found.append(level)
        if len(found) > GATHERED:
            found = [staged(_and(found), "tree-levels")]
    deep = level.select("doc_id").distinct()  # empty unless it went too deep
    paths = _and(found).join(deep, "doc_id", "left_anti")
    gone = removed.select("doc_id", "node", "place").distinct()
    touched = gone.join(entries.select("doc_id", "node", "place"), ["doc_id", "node", "place"], "left_semi").join(paths.select("doc_id", "node"), ["doc_id", "node"], "left_semi")
    rewritten = touched.select("doc_id").distinct().withColumn("rewritten", F.lit(True))
    kept = entries.select("doc_id", "node", "place").join(paths, ["doc_id", "node"]).join(gone, ["doc_id", "node", "place"], "left_anti").join(rewritten, "doc_id", "left")
    key = F.concat("path", F.array(behind, F.col("place").cast("long")))
    kept = staged(kept.select("doc_id", "node", "place", key.alias("path"), F.coalesce("rewritten", F.lit(False)).alias("rewritten")), "tree-kept")
    # ranks by bands of the first step of a path, whose sizes are summed first, so that no task ranks a whole document
    band = F.coalesce(F.get("path", 0), behind)
    return _ranked(kept.withColumn("band", band)).unionByName(deep.selectExpr("doc_id", "cast(null as long) AS position", "cast(null as long) AS node", "cast(null as long) AS place", "cast(null as boolean) AS rewritten"))


def _ranked(kept: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    sizes = kept.groupBy("doc_id", "band").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "band").orderBy("path")))
    joined = ranked.join(sizes.select("doc_id", "band", before.alias("before")), ["doc_id", "band"])
    position = F.when(F.col("rewritten"), F.col("before") + F.col("rank"))
    return joined.select("doc_id", position.cast("long").alias("position"), F.col("node").cast("long").alias("node"), F.col("place").cast("long").alias("place"), "rewritten")
