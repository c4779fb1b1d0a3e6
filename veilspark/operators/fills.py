"""Solid fills that touch a zone, in paint order: which of them hid something, and must be painted over everything again.

The log of a page's content says in which order it was painted. A fill hid something if it overlaps an entry painted before it
that shows: one that is not invisible text, does not lie in a zone as a whole, and is not itself a fill that hid nothing. The
last condition makes the fate of a fill depend on that of the fills below it. Entries that are no such fill show for
sure; what they lie under is over, and so is whatever lies on an over one. So the fills that hid something are those
that edges of overlap, from earlier to later, lead to from the entries that are no candidates: a traversal, which takes
pages of bounded size as rows and larger ones by staged frontiers. A fill that is over also says whether anything was painted on it later.

Defined results. A fill may have several rectangles, rows of one seqno. Entries and rectangles without extent, or with nulls,
overlap nothing. Repeated rows count once. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.frontier import levels
from veilspark.operators.grid import CELL, CORNERS, overlapping
from veilspark.operators.stage import forget, staged

#: Entries of the log that cannot be seen.
INVISIBLE = "ignore-text"
KEYS = ["doc_id", "page"]


def touched_fills(log: DataFrame, fills: DataFrame, zones: DataFrame, side: float = CELL) -> DataFrame:
    """doc_id, page, seqno, over, later for the fills that touch a zone.

    log: doc_id, page, seqno, kind, x0, y0, x1, y1 of everything painted, the fills among it; fills: doc_id, page, seqno, x0, y0,
    x1, y1; zones: doc_id, page, x0, y0, x1, y1.
    """
    rect = [*KEYS, *CORNERS]
    zone = zones.select(*rect)
    own = ["seqno", *rect]
    near = overlapping(fills.select(*own), zone, KEYS, side).select(*(F.col(f"l_{k}").alias(k) for k in KEYS), F.col("l_seqno").alias("seqno")).distinct()
    chosen = staged(near, "fills")
    rects = fills.select(*own).join(chosen, [*KEYS, "seqno"], "left_semi")
    shown = log.filter(~F.col("kind").eqNullSafe(F.lit(INVISIBLE))).select(*own)
    inside = overlapping(shown, zone, KEYS, side).filter("l_x0 >= r_x0 AND l_y0 >= r_y0 AND l_x1 <= r_x1 AND l_y1 <= r_y1").select(*(F.col(f"l_{c}").alias(c) for c in own)).distinct()
    shown = shown.join(inside, own, "left_anti")
    met = overlapping(rects, shown, KEYS, side).filter("l_seqno <> r_seqno")
    page = F.struct(*KEYS).alias("doc_id")
    pairs = met.select(*(F.col(f"l_{k}").alias(k) for k in KEYS), F.col("l_seqno").alias("fill"), F.col("r_seqno").alias("entry")).distinct()
    edges = staged(pairs.select(page, "fill", "entry"), "fill-edges")  # distinct before its pages are structs, by which nothing is dealt out
    mine = chosen.select(page, "seqno")
    below = edges.filter("entry < fill").select("doc_id", F.col("entry").alias("src"), F.col("fill").alias("dst"))
    sure = below.join(mine.select("doc_id", F.col("seqno").alias("src")), ["doc_id", "src"], "left_anti").select("doc_id", F.col("dst").alias("node"))
    over = levels(below, sure, max_depth=1 << 30).select("doc_id", F.col("node").alias("seqno"), F.lit(True).alias("over"))
    after = edges.filter("entry > fill").select("doc_id", F.col("fill").alias("seqno"), F.lit(True).alias("later")).distinct()
    both = mine.join(over, ["doc_id", "seqno"], "left").join(after, ["doc_id", "seqno"], "left")
    hid = F.coalesce("over", F.lit(False))
    out = both.select("doc_id.*", "seqno", hid.alias("over"), (hid & F.coalesce("later", F.lit(False))).alias("later"))
    return out
