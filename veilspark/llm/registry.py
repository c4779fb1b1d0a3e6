"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilspark.llm.alignment import align_texts
from veilspark.llm.bpe import encode_texts
from veilspark.llm.exact_dedup import exact_duplicates
from veilspark.llm.lexical_search import TERM, ranked_search
from veilspark.llm.licenses import TEMPLATES, license_matches
from veilspark.llm.line_dedup import MIN_PAGES, RATIO, drop_boilerplate
from veilspark.llm.ngram_join import near_components
from veilspark.llm.packing import packed_documents
from veilspark.llm.quality_classifier import quality_scores
from veilspark.llm.quality_rules import quality_verdicts
from veilspark.llm.rankfold import fold_texts
from veilspark.llm.secrets import secret_report
from veilspark.llm.shared import read_table, short_plans, small_batches
from veilspark.llm.toxicity import toxicity_scores


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read_table(spark, sf_dir, "documents"))


#: The counts and rules in SQL; the order of the cascade does not show in its verdicts.
OP2_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM base WHERE len(w) >= 5
), keyed AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + 4], ' ')) AS times FROM grams
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM keyed WHERE times > 1) GROUP BY r
), filled AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM base) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), counted AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(filled.dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(filled.n, 0) AS n_lines,
         length(t) - length(replace(t, '!', '')) AS bangs, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS uppers,
         length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS letters,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS stutters
  FROM base LEFT JOIN covered USING (r) LEFT JOIN filled USING (r)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * uppers > 40 * letters OR 100 * bangs > 30 * n_words
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 100 * stutters > 25 * n_words OR 100 * n_dup_lines > 60 * n_lines) AS kept
FROM judged
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_scores(docs, read_table(spark, sf_dir, "labels"), score_col="score", kept_col="kept").select("doc_id", "score", "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
lines AS (SELECT r, source, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT r, source, string_split(text, chr(10)) AS l FROM d WHERE text IS NOT NULL)),
bad AS (
  SELECT l.source, line FROM lines l JOIN pages p ON l.source IS NOT DISTINCT FROM p.source
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY l.source, line, pages
  HAVING count(DISTINCT r) >= {MIN_PAGES} AND count(DISTINCT r) > {RATIO} * pages
), marked AS (
  SELECT r, i, l.line, bad.line IS NOT NULL AS gone FROM lines l LEFT JOIN bad ON l.line = bad.line AND l.source IS NOT DISTINCT FROM bad.source
), rebuilt AS (
  SELECT r, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM marked GROUP BY r
)
SELECT doc_id, b.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM d LEFT JOIN rebuilt b USING (r)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(read_table(spark, sf_dir, "documents"))


_QUOTED = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in TEMPLATES.items())
#: Every text against every template, without retrieval.
OP7_SQL = rf"""
WITH words AS (
  SELECT r, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w
  FROM (SELECT row_number() OVER () AS r, text AS t FROM documents UNION ALL SELECT name, text FROM (SELECT -row_number() OVER () AS name, text FROM (VALUES {_QUOTED}) v(n, text)))
), names AS (SELECT -row_number() OVER () AS r, n AS license FROM (VALUES {_QUOTED}) v(n, text)
), ids AS (SELECT row_number() OVER () AS r, doc_id FROM documents
), shingles AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
), templates AS (SELECT license, s, count(*) OVER (PARTITION BY license) AS n FROM shingles JOIN names USING (r))
SELECT doc_id, license, n AS n_template, count(*) AS n_found
FROM shingles JOIN templates USING (s) JOIN ids USING (r) GROUP BY r, doc_id, license, n HAVING count(*) >= 0.8 * n
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read_table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, without prefixes, then every reachable document.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.b, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id
"""


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: Every document that shares a term with an item, scored without an index.
OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w FROM documents
), stats AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_tokens FROM d WHERE len(w) > 0
), post AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term
), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term
), q AS (
  SELECT DISTINCT k, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM (SELECT row_number() OVER () AS k, item_id, text FROM benchmark)
), weighed AS (
  SELECT k, item_id, term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight FROM q JOIN dfs USING (term), stats
), scored AS (
  SELECT k, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * n_docs) // n_tokens)))) AS BIGINT) AS score
  FROM weighed JOIN post USING (term) JOIN d USING (r), stats GROUP BY k, item_id, r, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id ASC NULLS LAST, r) AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_plans(spark)
    return fold_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


OPERATORS = [op1_secret_scan, op2_quality_rules, op3_packing, op4_quality_classifier, op5_line_dedup, op6_toxicity, op7_licenses, op8_exact_dedup, op9_bpe, op10_ngram_join, op11_ranked_search, op12_alignment, op13_byte_bpe]


def _tuned(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _tuned(f) for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op5_line_dedup": OP5_SQL, "op7_licenses": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op10_ngram_join": OP10_SQL, "op11_ranked_search": OP11_SQL}
