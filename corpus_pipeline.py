"""From documents to packed training sequences: five stages, each written and read again.

Rejected by the quality classifier, documents go; boilerplate lines of their site go from the rest; of documents that
link by five-word shingles at a Jaccard similarity of 0.8 or more, one of each group stays; secrets are masked; the
texts are packed into sequences of 4096 tokens. All stages but the last return the columns of documents, whatever further
columns there are and whatever their names.

Defined results. Null text counts as empty in every stage and stays null where a stage keeps it. Null or repeated doc_ids
are kept apart by their texts. An empty table gives an empty result. Ties go to the least doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.line_dedup import drop_boilerplate
from veilspark.llm.ngram_join import near_components
from veilspark.llm.packing import packed_documents
from veilspark.llm.quality_classifier import quality_scores
from veilspark.llm.secrets import mask_secrets
from veilspark.llm.shared import forget, free_names, quoted_name, read_table, small_batches, staged

SIMILARITY, SHINGLE = 80, 5


def _sized(before: DataFrame, after: DataFrame) -> DataFrame:
    """The columns of before, n_chars following the text."""
    if "n_chars" in before.columns:
        after = after.withColumn("n_chars", F.length("text").cast("long"))
    return after.select(*map(quoted_name, before.columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the co-trained classifier rejects go."""
    small_batches(spark)
    score, kept = free_names(docs.columns, "score", "kept")
    return quality_scores(docs, read_table(spark, sf_dir, "labels"), score_col=score, kept_col=kept).filter(F.col(kept)).select(*map(quoted_name, docs.columns))


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines that stand on too many pages of a source go; a page that loses all keeps its row.

    Copies are still there at this stage, so a page is a distinct text: else a copied document would lose all its lines.
    """
    lines, dropped = free_names(docs.columns, "lines", "dropped")
    return _sized(docs, drop_boilerplate(docs, by_content=True, lines_col=lines, dropped_col=dropped))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of linked documents the one with the least doc_id stays. Empty texts link with nothing and stay.

    Rows that repeat a doc_id within a group count as one document, of which one row stays; in groups that do not link, each
    keeps its own. Rows without a doc_id go if
    they link with one that has it, and otherwise stay.
    """
    small_batches(spark)
    found = near_components(docs, SIMILARITY, SHINGLE, marks=True).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    stays = found.filter(alone).select("doc_id", "mark").unionByName(found.filter(~alone).groupBy("label", "doc_id").agg(F.min("mark").alias("mark")).drop("label"))
    own, its_mark, twice = free_names(docs.columns, "id", "mark", "several")
    stays = stays.select(F.col("doc_id").alias(own), F.col("mark").alias(its_mark))
    mark = F.xxhash64(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    kept = docs.join(stays, docs["doc_id"].eqNullSafe(F.col(own)) & (mark == F.col(its_mark)), "left_semi")
    # usually every doc_id is there once; only rows of the others are compared as wholes
    several = staged(docs.select("doc_id").groupBy("doc_id").count().filter((F.col("count") > 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(twice)), "repeated-ids")
    if several.isEmpty():
        return kept
    again = kept["doc_id"] == F.col(twice)
    return kept.join(several, again, "left_anti").unionByName(kept.join(several, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: secrets become a mark."""
    return _sized(docs, mask_secrets(docs))


def pack_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of sequences."""
    small_batches(spark)
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", keep_good), ("line_dedup", drop_site_lines), ("ngram_jaccard", one_of_each_group), ("secret_scan", hide_secrets), ("packing", pack_texts)]

#: Co-training, Markov models and tokens are beyond SQL; the tests hold run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written, read again by the next one and deleted once that is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
            if before is not None:
                forget(before)
            before = docs
    return docs
