"""Resolving surfaces to entities: blocking by equal folds and by shared n-grams, scores, constraints, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .components import components
from .materialize import materialize


def gram_pairs(surfaces: DataFrame, key: str, value: str, threshold: float, n: int = 3) -> DataFrame:
    """(a, b, similarity) of all pairs whose n-gram sets reach the Jaccard `threshold`, by prefix filtering.

    Grams are ordered by rarity; a pair at the threshold must share one of the first |x| - ceil(t |x|) + 1 grams of each, so
    only those are indexed, and a frequent gram is indexed only where a name has nothing rarer. No pair is lost.
    """
    base = materialize(surfaces.select(key, F.array_sort(text.grams(F.col(value), n)).alias("g")).where(F.size("g") > 0))
    each = base.select(key, F.size("g").alias("size"), F.explode("g").alias("gram"))
    df = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("df", "gram"))
    keep = F.col("size") - F.ceil(F.col("size") * threshold) + 1
    prefix = materialize(each.join(df, "gram").withColumn("place", place).where(F.col("place") <= keep).select(key, "size", "gram"))
    l, r = prefix.alias("l"), prefix.alias("r")
    fits = (F.least("l.size", "r.size") >= F.greatest("l.size", "r.size") * threshold) & (F.col(f"l.{key}") < F.col(f"r.{key}"))
    pairs = l.join(r, (F.col("l.gram") == F.col("r.gram")) & fits).select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b")).distinct()
    both = pairs.join(base.select(F.col(key).alias("a"), F.col("g").alias("ga")), "a").join(base.select(F.col(key).alias("b"), F.col("g").alias("gb")), "b")
    return both.select("a", "b", F.round(text.jaccard(F.col("ga"), F.col("gb")), 6).alias("similarity")).where(F.col("similarity") >= threshold)


def resolve(surfaces: DataFrame, key: str, value: str, kind: str, threshold: float = 0.62, must: DataFrame | None = None, never: DataFrame | None = None) -> DataFrame:
    """(key, entity): surfaces of one kind with equal folds or gram similarity of `threshold` are one entity.

    `must` and `never` are (a, b) pairs in any order: forced links and links that are taken out. A forbidden pair may still
    be joined through others. Null and empty surfaces stay alone.
    """
    folded = materialize(surfaces.select(key, kind, text.squeeze(text.unicode_fold(F.col(value))).alias("fold")).where("fold != ''"))
    one = folded.groupBy("fold", kind).agg(F.min(key).alias("rep"))
    same = folded.join(one, ["fold", kind]).where(F.col(key) != F.col("rep")).select(F.col(key).alias("a"), F.col("rep").alias("b"))
    near = gram_pairs(one, "rep", "fold", threshold).join(one.select(F.col("rep").alias("a"), F.col(kind).alias("ka")), "a").join(one.select(F.col("rep").alias("b"), F.col(kind).alias("kb")), "b").where("ka = kb").select("a", "b")
    order = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = order(same.union(near))
    if never is not None:
        edges = edges.join(order(never), ["a", "b"], "left_anti")
    if must is not None:
        edges = edges.union(order(must))
    groups = components(edges)
    return surfaces.select(key).distinct().join(groups.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("component", key).alias("entity"))


def nearest(vectors: DataFrame, key: str, vector: str, k: int = 12, block: int = 2000) -> DataFrame:
    """(key, other, score, rank): the k greatest dot products of each query vector (ids divisible by 100) against all.

    Queries are a stated set, sent in blocks; each partition of the others keeps its own best k in one matrix product a
    batch, and the partial lists are merged. Ties go to the smaller id.
    """
    import numpy as np
    import pyarrow as pa

    queries = vectors.where(F.col(key) % 100 == 0).select(F.col(key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("qv"))
    blocks = queries.withColumn("block", F.floor(F.row_number().over(Window.partitionBy(F.pmod(F.col("q"), F.lit(64))).orderBy("q")) / block) * 64 + F.pmod(F.col("q"), F.lit(64)))
    asked = blocks.groupBy("block").agg(F.collect_list(F.struct("q", "qv")).alias("qs"))  # at most `block` in a list
    parts = vectors.select(F.col(key).cast("long").alias("v"), F.col(vector).cast("array<double>").alias("vv")).withColumn("slice", F.pmod(F.xxhash64("v"), F.lit(64)))
    slices = parts.groupBy("slice", F.floor(F.col("v") / 100_000).alias("page")).agg(F.collect_list(F.struct("v", "vv")).alias("vs"))  # bounded by ids in a page

    def run(batches):
        for batch in batches:
            rows = {"q": [], "v": [], "s": []}
            for qs, vs in zip(batch.column("qs").to_pylist(), batch.column("vs").to_pylist()):
                q = np.array([x["qv"] for x in qs])
                v = np.array([x["vv"] for x in vs])
                vid = np.array([x["v"] for x in vs])
                for x, score in zip(qs, q @ v.T):
                    order = np.lexsort((vid, -score))[: k + 1]
                    for i in order:
                        if vid[i] != x["q"]:
                            rows["q"].append(x["q"])
                            rows["v"].append(int(vid[i]))
                            rows["s"].append(float(score[i]))
            yield pa.RecordBatch.from_arrays([pa.array(rows["q"], pa.int64()), pa.array(rows["v"], pa.int64()), pa.array(rows["s"], pa.float64())], names=["q", "v", "s"])

    found = slices.crossJoin(asked).select("qs", "vs").mapInArrow(run, "q long, v long, s double")  # a stated query set, in blocks
    w = Window.partitionBy("q").orderBy(F.col("s").desc(), "v")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(key), F.col("v").alias("other"), F.col("s").alias("score"), "rank")
