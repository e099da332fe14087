"""Reading in phases, filters that may be open, queues, choices by key, and bands."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialize import materialize


def fetch_bodies(chosen: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    """The rows of `chosen` (small columns) with the wide columns of `bodies` for their keys alone. Keys without a body are dropped.

    `chosen` is written first, so that its size is known and the planner may broadcast it under its own limit.
    """
    return materialize(chosen).join(bodies, key)


def since(rows: DataFrame, at: str, mark: DataFrame) -> DataFrame:
    """Rows not older than the one row `mark` (since); rows of null time are left out."""
    return rows.crossJoin(F.broadcast(mark)).where(F.col(at) >= F.col("since")).drop("since")  # one row


def matching(rows: DataFrame, wanted: dict[str, Any]) -> DataFrame:
    """Rows that have each given value; a column wanted as None is open. The filter is made before planning, so open ones cost nothing."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return rows


def page_after(rows: DataFrame, key: str, cursor: Any, size: int) -> DataFrame:
    """The next `size` rows behind `cursor` in the order of `key`, as a top-k; the first page for None."""
    return (rows if cursor is None else rows.where(F.col(key) > cursor)).orderBy(key).limit(size)


def without_hosts(rows: DataFrame, host: str, blocked: DataFrame, column: str) -> DataFrame:
    """Rows whose host is not blocked and has no blocked parent domain: an anti-join on each suffix of the host."""
    labels = F.split(host, "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select(host).distinct().select(host, F.explode(suffixes).alias(column))
    return rows.join(hosts.join(blocked.select(column).distinct(), column).select(host).distinct(), host, "left_anti").select(*rows.columns)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each key. Spark limits each group within each task before it is shuffled, so a hot key travels as n rows a task."""
    return rows.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank_") <= n).drop("rank_")


def cohort_rank(rows: DataFrame, cohort: str, value: str, name: str) -> DataFrame:
    """percent_rank of `value` in its cohort, from counts of distinct values: (rows below) / (rows - 1), 0 for a single row.

    Rows are counted by value before they meet, so the window sees one row a value of a cohort; cohort and value are not null.
    """
    counts = rows.groupBy(cohort, value).agg(F.count(F.lit(1)).alias("c_"))
    up = Window.partitionBy(cohort).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = counts.withColumn("below_", F.coalesce(F.sum("c_").over(up), F.lit(0))).withColumn("all_", F.sum("c_").over(Window.partitionBy(cohort)))
    rank = F.when(F.col("all_") > 1, F.col("below_") / (F.col("all_") - 1)).otherwise(0.0)
    return rows.join(below.select(cohort, value, rank.alias(name)), [cohort, value])


def queue_class(at: Column, now: Column, share: Column) -> Column:
    """P3 for what is a day old; else P0, P1 and P2 by the rank in the cohort."""
    return F.when(at <= now - F.expr("interval 24 hours"), "P3").when(share >= 0.75, "P0").when(share >= 0.40, "P1").otherwise("P2")


def queue_state(size: Column, at: Column, now: Column) -> Column:
    """Too short rows are parked, old ones deferred, the others ready."""
    return F.when(size < 200, "parked").when(at <= now - F.expr("interval 30 days"), "deferred").otherwise("ready")


def longest_keyword(text: Column, categories: dict[str, str]) -> Column:
    """The category of the longest keyword in a text; ties go to the alphabet, null where none is found."""
    ordered = sorted(categories, key=lambda k: (-len(k), k))
    return F.coalesce(*[F.when(text.contains(k), F.lit(categories[k])) for k in ordered])


def banded(value: Column, bands: list[tuple[float, str]], below: str, missing: str) -> Column:
    """The name of the first band (from the top) whose floor a value reaches."""
    out = F.when(value.isNull(), missing)
    for floor, name in sorted(bands, reverse=True):
        out = out.when(value >= floor, name)
    return out.otherwise(below)


def blended(parts: list[tuple[Column, float]]) -> Column:
    """The weighted mean of the parts that are not null; null where all are."""
    weight = sum((F.when(p.isNotNull(), w).otherwise(0.0) for p, w in parts), F.lit(0.0))
    return F.when(weight > 0, sum((F.coalesce(p * w, F.lit(0.0)) for p, w in parts), F.lit(0.0)) / weight)


def chunks(rows: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, n, start_c, end_c) of chunks of whole lines with at most `most` code points; a longer line is a chunk of its own.

    Chunks follow one another without gaps, so their texts joined are the text. Null and empty texts have none.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, n, start, end = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                a = e = k = 0
                for line in (t or "").splitlines(keepends=True):
                    if e > a and e + len(line) - a > most:
                        which.append(i), n.append(k), start.append(a), end.append(e)
                        a, k = e, k + 1
                    e += len(line)
                if e > a:
                    which.append(i), n.append(k), start.append(a), end.append(e)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int32())), *(pa.array(x, pa.int32()) for x in (n, start, end))], names=[key, "n", "start_c", "end_c"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, n int, start_c int, end_c int")
