"""Mixing sources to target shares of all tokens, by hash-random order and distributed prefix sums.

Each document gets a hash-random key. The keys of a source are cut into equal ranges, as many as keep a range at about
`RANGE_ROWS` documents; tokens are summed by range, the sums are added up along each source's few ranges, and within a
range a running sum completes the prefix. A source of any size is thus ordered without ever lying in one task. The order
depends on ids and the seed only, not on partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.materialize import materialize
from .tokens import encoded

#: Documents in a key range, about.
RANGE_ROWS = 20_000
_HALF = 62


def sized(documents: DataFrame, mix: DataFrame, path: str | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, key) of the documents whose source is listed in `mix`; key is below 2**62."""
    listed = documents.select("doc_id", "text", "source").join(F.broadcast(mix.select("source").distinct()) if _small(mix) else mix.select("source").distinct(), "source", "left_semi")
    both = F.struct("doc_id", "source").alias("row")
    counted = encoded(listed.select(both, "text"), "row", "text", path, only_count=True)
    mixed = F.xxhash64(F.col("row.doc_id"), F.lit(seed))
    return counted.select("row.doc_id", "row.source", "n_tokens", F.shiftrightunsigned(mixed, 64 - _HALF).alias("key"))


def _small(mix: DataFrame, most: int = 100_000) -> bool:
    """Whether the mixture lists few enough sources to be sent to every executor."""
    return mix.limit(most + 1).count() <= most


def budgets(documents: DataFrame, mix: DataFrame, total: int | None = None) -> DataFrame:
    """One row for each listed source: documents and tokens there are, budget, whole epochs and tokens of the last part.

    `total` is the size wanted in tokens; by default all tokens of the listed sources, each counted once. The budget is
    target_share * total, at most max_repeat * tokens. A source without documents or tokens has budget 0.
    """
    there = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    rows = (
        mix.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeat", F.lit(1)), F.lit(0)).alias("max_repeat"))
        .dropDuplicates(["source"]).join(there, "source", "left").fillna(0, ["n_docs", "n_tokens"])
    )
    everything = F.lit(total) if total is not None else F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))  # a row a source
    rows = rows.withColumn("total", everything.cast("long"))
    wanted = F.least(F.round(F.col("target_share") * F.col("total")), F.col("max_repeat") * F.col("n_tokens")).cast("long")
    return (
        rows.withColumn("budget", wanted)
        .withColumn("epochs", F.when(F.col("n_tokens") > 0, F.expr("budget div n_tokens")).otherwise(0).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("n_tokens"))
    )


def mixed(documents: DataFrame, mix: DataFrame, total: int | None = None, path: str | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): chosen has doc_id, source, n_tokens, copies (1 to max_repeat) for each document of the set; shares
    has for each listed source its target, what there is, its budget and the tokens and share it has in the set.

    A source's documents are all taken `epochs` times; of the rest those come once more, in key order, of which at least
    half fits into what is left, so a source misses its budget by half a document at most. Sources that max_repeat keeps
    below their budget stay below; nothing else is put in their place.

    Documents of null or unlisted source are not used; null and empty texts have 0 tokens and go with their neighbours.
    Ties of the key are broken by the id and the size; a repeated row is a document of its own. Null shares count as 0,
    null repeats as 1, a source listed twice is taken once. Empty tables give no documents and zero shares.
    """
    rows = materialize(sized(documents, mix, path, seed))
    plan = materialize(budgets(rows, mix, total))
    ranges = F.pow(F.lit(2.0), F.least(F.lit(40), F.ceil(F.log2(F.greatest(F.col("n_docs") / RANGE_ROWS, F.lit(1.0)))))).cast("long")
    by_source = plan.select("source", "epochs", "rest", "max_repeat", "budget", (F.lit(1 << _HALF).cast("long") / ranges).cast("long").alias("wide"))
    placed = rows.join(by_source, "source").where("budget > 0").withColumn("part", F.expr("key div wide"))
    sums = placed.groupBy("source", "part").agg(F.sum("n_tokens").alias("here"))
    ahead = sums.withColumn("before", F.sum("here").over(Window.partitionBy("source").orderBy("part")) - F.col("here")).drop("here")
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.join(ahead, ["source", "part"]).withColumn("until", F.col("before") + F.sum("n_tokens").over(within))
    fits = (F.col("until") - F.col("n_tokens") / 2) < F.col("rest")
    copies = F.least(F.col("epochs") + F.when(fits, 1).otherwise(0), F.col("max_repeat")).cast("int")
    chosen = run.withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    return chosen, plan


def shares(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """The report: target and actual tokens and share of each listed source."""
    got = chosen.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs_used"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens")
    )
    rows = plan.join(got, "source", "left").fillna(0, ["docs_used", "copies", "most_copies", "actual_tokens"])
    everything = F.sum("actual_tokens").over(Window.partitionBy(F.lit(0)))
    return rows.select(
        "source", "target_share", "max_repeat", F.col("n_docs").alias("docs_available"), F.col("n_tokens").alias("tokens_available"),
        F.round(F.col("target_share") * F.col("total")).cast("long").alias("target_tokens"), "budget", "docs_used", "copies", "most_copies", "actual_tokens",
        F.when(everything > 0, F.col("actual_tokens") / everything).otherwise(0.0).alias("actual_share"),
    )
