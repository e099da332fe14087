"""Joins beyond equality: overlapping and containing intervals, nearness in a document, longest prefix, as-of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _bins(rows: DataFrame, start: str, end: str, width: int) -> DataFrame:
    last = F.greatest(F.col(start), F.col(end) - 1)
    return rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = 512) -> DataFrame:
    """Pairs whose half-open spans overlap, within equal `on`. Column names other than `on` must differ.

    Spans are put into bins of `width`; a pair that shares several bins is kept only in the first of them, so no distinct is
    needed. Long documents are spread over many bins and tasks. Empty spans and nulls overlap nothing.
    """
    (ls, le), (rs, re_) = left_span, right_span
    a, b = _bins(left.where(F.col(ls) < F.col(le)), ls, le, width), _bins(right.where(F.col(rs) < F.col(re_)), rs, re_, width)
    both = a.join(b, [*on, "_bin"])
    first = F.floor(F.greatest(F.col(ls), F.col(rs)) / width) == F.col("_bin")
    return both.where((F.col(ls) < F.col(re_)) & (F.col(le) > F.col(rs)) & first).drop("_bin")


def containment_join(outer: DataFrame, inner: DataFrame, on: list[str], outer_span: tuple[str, str], inner_span: tuple[str, str], width: int = 512) -> DataFrame:
    """Pairs in which the inner span lies within the outer one; the inner is looked up by its start's bin only."""
    (os_, oe), (is_, ie) = outer_span, inner_span
    a = _bins(outer.where(F.col(os_) < F.col(oe)), os_, oe, width)
    b = inner.withColumn("_bin", F.floor(F.col(is_) / width))
    return a.join(b, [*on, "_bin"]).where((F.col(is_) >= F.col(os_)) & (F.col(ie) <= F.col(oe))).drop("_bin")


def near_join(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, reach: int) -> DataFrame:
    """Pairs at most `reach` apart, within equal `on`: bins of `reach`, the right side in its own and both neighbouring bins."""
    a = left.withColumn("_bin", F.floor(F.col(left_at) / reach))
    b = right.withColumn("_bin", F.explode(F.array(*[F.floor(F.col(right_at) / reach) + i for i in (-1, 0, 1)])))
    return a.join(b, [*on, "_bin"]).where(F.abs(F.col(left_at) - F.col(right_at)) <= reach).drop("_bin")


def longest_prefix(rows: DataFrame, text: str, codes: DataFrame, prefix: str, value: str, key: list[str]) -> DataFrame:
    """Each row of `rows` with the value of the longest prefix its text begins with, or null.

    The text is cut at each length that occurs among the prefixes and joined by equality, so the table of codes may be of
    any size. Equal prefixes with several values give the least value.
    """
    lengths = codes.select(F.length(prefix).alias("n")).where("n > 0").distinct()
    one = codes.groupBy(F.col(prefix).alias("_p")).agg(F.min(value).alias("_v"))
    cut = rows.select(*key, text).crossJoin(F.broadcast(lengths)).where(F.length(text) >= F.col("n")).withColumn("_p", F.expr(f"substring({text}, 1, n)"))  # few lengths
    best = cut.join(one, "_p").groupBy(*key).agg(F.max_by("_v", "n").alias(value))
    return rows.join(best, key, "left")


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, carried: list[str]) -> DataFrame:
    """Each left row with the latest right row at or before its time, within equal `on`: one sort over both sides, no pairs.

    `carried` are right columns; where two right rows share a time the greater values go.
    """
    a = left.withColumn("_at", F.col(left_at)).withColumn("_side", F.lit(1))
    b = right.select(*on, F.col(right_at).alias("_at"), F.struct(F.col(right_at).alias("at"), *carried).alias("_r")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*on).orderBy("_at", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_r", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*left.columns, F.col("_last.at").alias(f"{right_at}_as_of"), *[F.col(f"_last.{c}").alias(c) for c in carried])


def merge_full(left: DataFrame, right: DataFrame, key: str, least: list[str], greatest: list[str], summed: list[str]) -> DataFrame:
    """Two rollups by the same key as one: least and greatest ignore nulls, sums count a missing side as 0."""
    r = right.select(F.col(key), *[F.col(c).alias(f"_r_{c}") for c in [*least, *greatest, *summed]])
    j = left.join(r, key, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(key, *[F.least(c, f"_r_{c}").alias(c) for c in least], *[F.greatest(c, f"_r_{c}").alias(c) for c in greatest], *[(zero(c) + zero(f"_r_{c}")).alias(c) for c in summed])


def phrase_matches(texts: DataFrame, words: str, phrases: DataFrame, phrase: str, sizes: tuple[int, ...]) -> DataFrame:
    """`texts` with each phrase of `phrases` that stands in their word list, once: an equality join on runs of `sizes` words."""
    w = F.col(words)
    runs = lambda k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))
    said = F.array_distinct(F.concat(*[runs(k) for k in sizes]))
    return texts.withColumn(phrase, F.explode(said)).join(phrases.select(phrase).distinct(), phrase)
