"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .materialize import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return (
        down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(low.select("a", F.col("m").alias("b")))
        .where("a != b").distinct()
    )


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and their number and sum of hashes, counted while they are written."""
    seen = Observation()
    out = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hash")))
    return out, (seen.get["n"], seen.get["hash"])


def components(edges: DataFrame, a: str = "a", b: str = "b", node: str = "node", component: str = "component", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node joined with it.

    Nulls at either end and loops make no edge; an empty table gives an empty result. The minimum of each star is found
    by a map-side aggregate and joined back, so a node with very many edges is split by the skew join and never lies in
    one list. A round reads a written table only, so lost executors cost no more than the round; log(n) rounds are usual.
    Raises RuntimeError where `rounds` do not suffice.
    """
    kind = edges.select(a).schema[0].dataType
    now, mark = _written(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    for _ in range(rounds if mark[0] else 0):
        after, new = _written(_small_star(_large_star(now)))
        release(now)
        now, same, mark = after, new == mark, new
        if same:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components: not stable after {rounds} rounds")
    star = now.select(F.col("a").alias(node), F.col("b").alias(component))
    return star.union(now.select(F.col("b").alias(node), F.col("b").alias(component)).distinct()).withColumn(node, F.col(node).cast(kind))
