"""Queries on entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators.components import components
from ..sources.tables import table
from .registry import query


@query("""
WITH RECURSIVE e AS (SELECT entity_id AS a, redirects_to AS b FROM extracted_entity WHERE redirects_to IS NOT NULL), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS seen FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node""")
def redirect_components(spark: SparkSession, d: str) -> DataFrame:
    return components(table(spark, d, "extracted_entity", F.col("entity_id").alias("a"), F.col("redirects_to").alias("b")))


@query("""
WITH g AS (SELECT s_suppkey AS k, list_distinct(list_transform(range(1, length(x) + 1), lambda i: substring(' ' || x || ' ', CAST(i AS INT), 3))) AS g FROM (SELECT s_suppkey, lower(s_name) AS x FROM supplier)),
p AS (SELECT a.k AS a, b.k AS b, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS s FROM g a JOIN g b ON a.k < b.k) SELECT a, b, round(i * 1.0 / (s - i), 6) AS similarity FROM p WHERE round(i * 1.0 / (s - i), 6) >= 0.8""")
def gram_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier", "s_suppkey", F.lower("s_name").alias("x"))
    return E.gram_pairs(rows, "s_suppkey", "x", 0.8)


@query()
def resolved_surfaces(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_entity", "entity_id", "entity_type", "canonical_name", "redirects_to")
    must = rows.where("redirects_to is not null").select(F.col("entity_id").alias("a"), F.col("redirects_to").alias("b"))
    return E.resolve(rows, "entity_id", "canonical_name", "entity_type", must=must)


@query("""
SELECT vec_id, other, round(score, 6) AS score, rank FROM (SELECT q.vec_id, v.vec_id AS other, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) DESC, v.vec_id) AS rank
FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 12""")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    return E.nearest(table(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding").select("vec_id", "other", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT lower(surface) AS fold, count(DISTINCT entity_id) AS entities, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS who FROM extracted_entity_alias WHERE entity_id IS NOT NULL AND surface IS NOT NULL GROUP BY 1 HAVING count(DISTINCT entity_id) > 1")
def shared_surfaces(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_entity_alias", "surface", "entity_id").where("entity_id is not null and surface is not null")
    by = rows.groupBy(F.lower("surface").alias("fold")).agg(F.countDistinct("entity_id").alias("entities"), F.array_join(F.sort_array(F.collect_set("entity_id")), ",").alias("who"))
    return by.where("entities > 1")
