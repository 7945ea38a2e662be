"""Registered queries of the numbered problems, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from . import clusters, lookalike, mixing, nearest, page_body, site_lines, split_sections, tokens

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sections.split_oversized(table(spark, d, "ms_docs")).select("id", "section_no").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_sections.split_oversized(table(spark, d, "ms_docs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return page_body.furniture_lines(table(spark, d, "ms_docs"))


def p2_bodies(spark: SparkSession, d: str) -> DataFrame:
    return page_body.page_bodies(table(spark, d, "ms_docs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, d, "ms_docs"))


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "ms_docs")
    return site_lines.without_lines(docs, site_lines.repeated_lines(docs)).select("id", "cleaned").distinct()


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """Repeated lines by site: how many there are, and the largest share of a site's documents that one stands in."""
    lines = site_lines.line_shares(table(spark, d, "ms_docs"))
    return lines.groupBy("site").agg(F.count("*").alias("lines"), F.max("documents").alias("most"), F.round(F.max("share"), 9).alias("top_share"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.same_cluster(table(spark, d, "cluster_probes"), clusters.cluster_rows(table(spark, d, "raptor_sac")))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_report(clusters.cluster_rows(table(spark, d, "raptor_sac")))


def _all_vectors(spark: SparkSession, d: str) -> DataFrame:
    cols = ["id", "embedding", "ingested_at"]
    return nearest.vector_table(table(spark, d, "ms_docs").select(*cols).unionByName(table(spark, d, "raptor_sac").select(*cols)))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return nearest.nearest(_all_vectors(spark, d)).select("id", F.col("nid").alias("neighbour_id"), "sim")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = nearest.nearest(_all_vectors(spark, d), least=0.95)
    return found.select(F.least("id", "nid").alias("id_a"), F.greatest("id", "nid").alias("id_b")).distinct()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p6_edits(spark: SparkSession, d: str) -> DataFrame:
    """Every document's ids after its language and source were appended to the encoded text."""
    docs = table(spark, d, "documents").select(F.struct("doc_id", "text", "lang", "source").alias("row"), "text")
    coded = tokens.encode_corpus(docs, "row", "text")
    size = F.length(F.coalesce("row.text", F.lit("")))
    edits = coded.select("row.doc_id", "row.text", "ids", size.alias("start"), size.alias("end"), F.concat_ws(" ", F.lit(""), "row.lang", "row.source").alias("new"))
    return tokens.edit_corpus(edits).select("doc_id", "ids")


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(_mixed(spark, d), table(spark, d, "mix_targets")).where("short").select("source").distinct()


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(_mixed(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "documents"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return lookalike.consistent_texts(docs).select("doc_id", "form")


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_classes(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_bodies, p3_found, p3_cleaned, p3_shares, p4_found, p4_clusters, p5_found, p5_neighbours, p6_ids, p6_edits, p7_found, p7_mixture, p7_shares, p8_found, p8_forms, p8_classes)}

_SITE = r"regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"
_P3 = rf"""
WITH docs AS (
  SELECT id, {_SITE} AS site, string_split(content, chr(10)) AS ls
  FROM ms_docs WHERE content IS NOT NULL AND url IS NOT NULL AND id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1
), lines AS (
  SELECT id, site, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM docs WHERE site <> ''
), keyed AS (
  SELECT id, site, line, line_no, regexp_replace(lower(line), '[^\p{{L}}]+', '', 'g') AS k FROM lines
), frequent AS (
  SELECT site, k FROM keyed WHERE length(k) >= 20 GROUP BY site, k HAVING count(DISTINCT id) >= 8
)"""

_P1 = r"""
WITH docs AS (
  SELECT id, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM ms_docs WHERE content IS NOT NULL AND id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1
), lines AS (
  SELECT id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM docs
), marked AS (
  SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no) % 2 AS fenced FROM lines
), numbered AS (
  SELECT *, sum(CASE WHEN fenced = 0 AND regexp_matches(line, '^#{1,6}\s+\S') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no) AS section_no FROM marked
)
SELECT id, CAST(section_no AS INTEGER) AS section_no FROM numbered GROUP BY id, section_no
HAVING length(regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\s+|\s+$', '', 'g')) > 2000"""

_P5 = """
WITH rows_ AS (SELECT id, embedding, ingested_at FROM ms_docs UNION ALL SELECT id, embedding, ingested_at FROM raptor_sac), firsts AS (
  SELECT id, embedding::DOUBLE[] AS v FROM rows_ WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1
), usable AS (
  SELECT id, v FROM firsts WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), near AS (
  SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM usable a JOIN usable b ON a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY sim DESC, b.id) <= 5
)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM near WHERE sim >= 0.95"""

ORACLE_SQL: dict[str, str] = {
    "p1_found": _P1,
    "p5_found": _P5,
    "p3_shares": _P3
    + """, counted AS (SELECT site, k, count(DISTINCT id) AS n FROM keyed JOIN frequent USING (site, k) GROUP BY site, k), sites AS (SELECT site, count(*) AS total FROM docs WHERE site <> '' GROUP BY site)
SELECT site, count(*) AS lines, max(n) AS most, round(max(n / total), 9) AS top_share FROM counted JOIN sites USING (site) GROUP BY site""",
    "p3_found": _P3 + " SELECT id, CAST(line_no AS INTEGER) AS line_no FROM keyed JOIN frequent USING (site, k)",
}
