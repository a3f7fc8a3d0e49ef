"""The queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm import ann, arc, bpe, decontam, langid, license_scan, ngram_join, quality, token_counts, url_rules
from ballast.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """Ranks from a vocabulary file (by default the public one named above), and the pattern that splits texts."""
    import public_tokenizers

    return bpe.read_ranks(path or public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and chance of the top grade (neither toxic nor of low quality) of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.ratings_of(table(spark, sf_dir, "labels")), 3)
    graded = quality.grade(docs, model, ["doc_id"])
    return graded.withColumn("kept", F.col("p_top") >= quality.KEEP_FROM)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *vocabulary())


def op5_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.archived(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits whose places a hash of its id gives."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", token_counts.sample_edits().alias("edits"))
    return token_counts.edited_counts(docs, *vocabulary())


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document of the same number: to block if toxic or of low quality."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("block")
    )
    return url_rules.judge(table(spark, sf_dir, "pages"), labels)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences by windows of the whole text; the SQL sees one line at a time and gives the same rows where no notice is wrapped or inside a longer line."""
    found = license_scan.passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "n_hits", F.floor(F.col("dice") * 1000000 + 0.5).alias("dice_millionths"))


def _licenses_sql(threshold: float = 0.8) -> str:
    rows = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(license_scan.TEMPLATES))
    words = "list_filter(string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '')"
    grams = "list_distinct(CASE WHEN len(words) < 2 THEN words ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END)"
    return f"""
WITH t0(t_id, license, notice) AS (VALUES {rows}),
t1 AS (SELECT t_id, license, {words.format("notice")} AS words FROM t0),
t AS (SELECT t_id, license, {grams} AS t_grams FROM t1),
l0 AS (SELECT doc_id, unnest(string_split_regex(text, '[\\n\\r]+')) AS line FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT doc_id, {words.format("line")} AS words FROM l0),
l AS (SELECT doc_id, {grams} AS l_grams FROM l1 WHERE len(words) > 0),
d AS (SELECT doc_id, license, 2e0 * len(list_intersect(l_grams, t_grams)) / (len(l_grams) + len(t_grams)) AS dice
      FROM l CROSS JOIN t WHERE len(l_grams) BETWEEN len(t_grams) * 6e-1 AND len(t_grams) * 16e-1)
SELECT doc_id, license, count(*) AS n_hits, CAST(floor(max(dice) * 1000000 + 5e-1) AS BIGINT) AS dice_millionths
FROM d WHERE dice >= {threshold} GROUP BY doc_id, license"""


_ARCHIVES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          CAST((CAST('0x' || substr(hex, 5 * CAST(k // 4 AS INT) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest
      FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to
FROM m"""

_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN words IS NULL OR len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams
  FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT a AS doc_id, a AS other FROM links
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, coalesce(min(other), s.doc_id) AS component_id
FROM s LEFT JOIN reach USING (doc_id) GROUP BY s.doc_id, grams"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_archives": _ARCHIVES_SQL, "op7_jaccard": _JACCARD_SQL, "op10_licenses": _licenses_sql()}
