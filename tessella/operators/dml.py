"""Writes expressed as frames: upsert, insert-ignore, carry-forward, replace by owner, merge of JSON objects, delete and check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first by `order`; nulls of the key make a group of their own."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, key: list[str], blank: bool = False) -> DataFrame:
    """Rows of both; a value of `new` goes before one of `old` unless it is null (or, with `blank`, an empty text).

    Keys are expected once on each side (use `latest`). Columns are those of `old`.
    """
    other = [c for c in old.columns if c not in key]
    value = lambda c: F.nullif(F.col(c), F.lit("")) if blank and dict(new.dtypes)[c.removeprefix("_n_")] == "string" else F.col(c)
    fresh = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in other if c in new.columns])
    joined = old.join(fresh, key, "full_outer")
    return joined.select(*key, *[F.coalesce(value(f"_n_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in other])


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """`old` and the rows of `new` whose key it lacks."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti").select(*old.columns))


def carry_forward(rebuilt: DataFrame, before: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """`rebuilt` with blanks (null or empty text) in `columns` filled from `before`."""
    kept = before.select(*key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    joined = rebuilt.join(kept, key, "left")
    return joined.select(*[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")).cast(dict(rebuilt.dtypes)[c]), F.col(f"_o_{c}")).alias(c) if c in columns else F.col(c) for c in rebuilt.columns])


def carry_missing(rebuilt: DataFrame, before: DataFrame, key: list[str], allowed: DataFrame) -> DataFrame:
    """`rebuilt` and those whole rows of `before` that it lacks and whose key is in `allowed`."""
    gone = before.join(rebuilt.select(*key), key, "left_anti").join(allowed.select(*key).distinct(), key, "left_semi")
    return rebuilt.unionByName(gone.select(*rebuilt.columns))


def replace_owned(stored: DataFrame, rebuilt: DataFrame, owner: str, mine: str) -> DataFrame:
    """`stored` with all rows of one owner exchanged for `rebuilt`; rows of a null owner stay."""
    return stored.where(~F.col(owner).eqNullSafe(mine)).unionByName(rebuilt.withColumn(owner, F.lit(mine)).select(*stored.columns))


def merge_json(old: Column, new: Column) -> Column:
    """Two JSON objects of plain values as one; keys of `new` win, null keeps the other side."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(as_map(old), lambda k, v: ~F.map_contains_key(as_map(new), k))
    return F.map_concat(kept, as_map(new))


def union_ledger(old: DataFrame, new: DataFrame, key: list[str], stamp: str) -> DataFrame:
    """A ledger that never shrinks: all keys of both, each with its latest row."""
    return latest(old.unionByName(new), key, [F.col(stamp).desc_nulls_last()])


def deleted(rows: DataFrame, doomed: Column) -> DataFrame:
    """Rows for which the condition is not true; unknown keeps the row, as a conditional DELETE does."""
    return rows.where(~F.coalesce(doomed, F.lit(False)))
