"""Near-duplicate links among all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.common import table
from strandloom.llm.neighbours import near_duplicates


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), u AS (
  SELECT vec_id, v FROM d
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM d
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT d.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, d.vec_id = c.component_id AS kept
FROM d JOIN c ON d.vec_id = c.vec_id LEFT JOIN n ON d.vec_id = n.vec_id
"""
