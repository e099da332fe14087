"""Corroboration across independent sources, tiers, threads and facets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tier(host: Column, tiers: dict[str, list[str]], default: str = "news") -> Column:
    """The first tier of which a suffix equals the host or stands behind a dot at its end."""
    out = None
    for name, suffixes in tiers.items():
        hit = F.lit(False)
        for s in suffixes:
            hit = hit | (host == s.lstrip(".")) | host.endswith("." + s.lstrip("."))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def consensus(readings: DataFrame, key: list[str], value: str, source: str, least: int = 2) -> DataFrame:
    """Values of a key that `least` independent sources give: key, value, sources, readings."""
    by = readings.where(F.col(value).isNotNull() & F.col(source).isNotNull()).groupBy(*key, value, source).agg(F.count(F.lit(1)).alias("_k"))
    return by.groupBy(*key, value).agg(F.count(F.lit(1)).alias("sources"), F.sum("_k").cast("long").alias("readings")).where(F.col("sources") >= least)


def facet(rows: DataFrame, values: str, given: list[str] | None = None) -> DataFrame:
    """(value, n): rows behind each value of an array column, a value repeated in a row counted once; nulls and blanks not."""
    each = rows.select(F.explode(F.array_distinct(F.filter(F.col(values), lambda x: x.isNotNull() & (F.trim(x) != "")))).alias("value"))
    by = each.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return by if given is None else by.withColumn("place", F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, given)), F.col("value")), F.lit(0)), F.lit(len(given) + 1)))


def canonical_spelling(rows: DataFrame, value: str, key: Column) -> DataFrame:
    """(key, spelling, n): of spellings with the same key the most used one, ties by the alphabet."""
    by = rows.where(F.col(value).isNotNull()).groupBy(key.alias("key"), F.col(value).alias("spelling")).agg(F.count(F.lit(1)).alias("k"))
    return by.groupBy("key").agg(F.expr("min_by(spelling, struct(-k, spelling))").alias("spelling"), F.sum("k").cast("long").alias("n"))


def threads(items: DataFrame, key: str, at: str, item: str, duplicate_days: int = 0, gap_days: int = 90) -> DataFrame:
    """Items of a thread in order of time, each a duplicate of, continuing or unlinked to the last item that is no duplicate.

    An item of the same day as that one is its duplicate. Whether an item is a duplicate depends on the one before it, so
    the fold runs over each thread's sorted rows in batches that pass its state on; a thread may be of any length.
    """
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        thread = last = last_at = None
        for pdf in batches:
            links, roles = [], []
            for r in pdf.itertuples(index=False):
                k, t, i = r
                if k != thread:
                    thread, last, last_at = k, None, None
                gap = None if last_at is None else (t.normalize() - last_at.normalize()).days
                role = "first" if gap is None else "duplicate" if gap <= duplicate_days else "continues" if gap <= gap_days else "unlinked"
                links.append(last if role in ("duplicate", "continues") else None)
                roles.append(role)
                if role != "duplicate":
                    last, last_at = i, t
            yield pd.DataFrame({key: pdf[key], at: pdf[at], item: pdf[item], "role": roles, "previous": links})

    rows = items.select(key, at, item).where(f"{key} is not null and {at} is not null")
    ordered = rows.repartition(F.col(key)).sortWithinPartitions(key, at, item)
    kinds = dict(rows.dtypes)
    return ordered.mapInPandas(run, f"`{key}` {kinds[key]}, `{at}` {kinds[at]}, `{item}` {kinds[item]}, role string, previous {kinds[item]}")


def _earliest(titles: DataFrame, threshold: float, *group: str) -> DataFrame:
    """(set, group, near): the least key of another title of Jaccard `threshold`, of those below the title's own last key.

    Of `titles` (set, group, first, last, w, bits), w holds words from rare to frequent, so two that reach the threshold share one
    of their first |w| - ceil(t |w|) + 1; bits differ in one bit at most for each word that one of them lacks. All is decided
    inside the join, so that what leaves it are titles, not pairs.
    """
    n, slack = F.size("w"), 1e-9  # products of decimal fractions may lie beside whole numbers
    each = titles.withColumn("word", F.explode(F.slice("w", F.lit(1), (n - F.ceil(n * threshold - slack) + 1).cast("int"))))
    l, r = each.alias("l"), each.alias("r")
    a, b = F.size("l.w"), F.size("r.w")
    fits = (F.col("l.set") != F.col("r.set")) & (F.col("l.first") < F.col("r.last")) & (F.least(a, b) >= F.greatest(a, b) * threshold - slack)
    apart = F.bit_count(F.col("l.bits").bitwiseXOR(F.col("r.bits"))) <= (a + b) * ((1 - threshold) / (1 + threshold)) + slack
    common = F.size(F.array_intersect("l.w", "r.w"))
    same = F.col("l.word") == F.col("r.word")
    for g in group:
        same = same & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    met = l.join(r, same & fits & apart & (common / (a + b - common) >= threshold))
    return met.groupBy("r.set", *(f"r.{g}" for g in group)).agg(F.min("l.first").alias("near"))


def near_titles(rows: DataFrame, key: str, title: str, group: str, alone: float = 0.75, together: float = 0.6) -> DataFrame:
    """(key, kept): whether an item's title is no near duplicate of an earlier item's; word sets of Jaccard `alone`, or
    `together` within one group. Compared with all earlier items, not only with kept ones.

    Titles of the same words are compared once, by their least and greatest keys: all of them, and those of each group."""
    from .materialize import materialize

    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"(?U)\W+"), lambda w: w != "")))
    base = materialize(rows.select(key, F.col(group).alias("group"), F.array_join(words, " ").alias("words")))
    ends = F.min("first").alias("first"), F.max("last").alias("last")
    inside = base.where("words != ''").withColumns({"first": F.col(key), "last": F.col(key)}).groupBy("words", "group").agg(*ends)
    sets = materialize(inside.groupBy("words").agg(*ends).withColumn("set", F.monotonically_increasing_id()))
    each = sets.select("set", F.explode(F.split("words", " ")).alias("word"))
    df = materialize(each.groupBy("word").agg(F.count(F.lit(1)).alias("df")).withColumn("id", F.monotonically_increasing_id()))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    coded = each.join(df, "word").groupBy("set").agg(F.sort_array(F.collect_list(F.struct("df", "id"))).alias("o")).select("set", F.col("o.id").alias("w"))
    coded = materialize(coded.withColumn("bits", F.aggregate("w", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(bit(x)))))
    wide = _earliest(sets.select("set", "first", "last").join(coded, "set"), alone)
    close = _earliest(inside.join(sets.select("words", "set"), "words").drop("words").join(coded, "set"), together, "group")
    of = sets.select("words", "set", "first").join(wide, "set", "left").select("words", "set", F.least("first", "near").alias("first"))
    item = base.where("words != ''").join(of, "words").alias("i").join(close.alias("c"), (F.col("i.set") == F.col("c.set")) & F.col("i.group").eqNullSafe(F.col("c.group")), "left")
    dup = item.where(F.least("i.first", "c.near") < F.col(f"i.{key}")).select(F.col(f"i.{key}").alias(key)).distinct().withColumn("_dup", F.lit(True))
    return base.select(key).join(dup, key, "left").select(key, F.col("_dup").isNull().alias("kept"))
