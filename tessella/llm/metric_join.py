"""Joins of words within an edit distance, by partitioning the metric space around pivots.

A point is a word in a named space. The metric is the edit distance of the words, plus `APART` where the spaces differ (the
sum of two metrics is a metric); `APART` is beyond every radius, so points of two spaces are never joined, and every space
that holds a point has pivots of its own, so nearest pivots lie in the point's own space.

Pivots are points drawn by hash, one for about `CELL` points of a space, at most `FAN` a step. A point has its home in the
cell of its nearest pivot and is copied to each cell a partner may have its home in: by the triangle inequality those whose
pivot is no farther than the nearest one plus twice the point's radius, and no farther than the cell's own reach plus the
radius. Cells above `CELL` get pivots of their own in the next step, so a point meets `FAN` pivots a step however many there
are. In a light cell homes meet members whose distances to the pivot differ by the radius at most, under the true edit metric.

Where a step makes the heavy cells no lighter (their words lie evenly apart) it is taken back, and in those cells words meet
by keys instead of each with each (`_given`, `_asked`): strings that two words within the radius must share, so that the pairs
looked at do not grow with the square of a cell.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize, release

#: Points of a cell beyond which it gets pivots of its own, and the most pivots of one step.
CELL, FAN = 64, 4
#: Steps at most; what is still above `CELL` then meets by keys.
STEPS = 6
#: Pairs a task looks at, about, and keys that it sorts.
PAIRS, KEYS = 2_000_000, 200_000
#: Distance of two spaces.
APART = 1000
#: The greatest radius, of long words.
RADIUS = 3


@dataclass
class Partition:
    """What the partition was made of, for tests and reports."""

    cells: int = 0
    points: int = 0
    copies: int = 0
    largest: int = 0


def radius(length: Column) -> Column:
    """The radius by the shorter word's length: 0 below 4 letters, 1 below 6, 2 below 9, then 3."""
    return F.when(length < 4, 0).when(length < 6, 1).when(length < 9, 2).otherwise(RADIUS)


def _distance(points: DataFrame, pivots: DataFrame) -> DataFrame:
    """points joined with the pivots of their own space within their cell, with the distance d to each."""
    return points.join(pivots, ["cell", "space"]).withColumn("d", F.levenshtein("word", "pivot"))


def _step(points: DataFrame, heavy: DataFrame) -> DataFrame:
    """The points of `heavy` cells (cell, space, n) in the cells of new pivots: home, and copies where a partner may be at home."""
    mine = points.join(heavy, ["cell", "space"])
    drawn = mine.where("home").select("cell", "space", "word", "n").distinct()
    take = F.least(F.lit(FAN), F.ceil(F.col("n") / CELL) + 1)
    pick = F.pmod(F.xxhash64("word", "cell"), F.col("n")) < 2 * take
    least = drawn.groupBy("cell", "space").agg(F.expr("min_by(word, xxhash64(word, cell))").alias("pivot"))
    ranked = drawn.where(pick).groupBy("cell", "space").agg(F.slice(F.sort_array(F.collect_set(F.struct(F.xxhash64("word").alias("h"), "word"))), 1, FAN).alias("few"))  # about 2 * FAN words
    pivots = materialize(ranked.select("cell", "space", F.explode("few.word").alias("pivot")).union(least).distinct())
    far = _distance(mine.drop("n", "d"), pivots)
    nearest = far.groupBy("cell", "space", "word", "is_left", "is_right", "home").agg(F.min(F.struct("d", "pivot")).alias("least"), F.collect_list(F.struct("d", "pivot")).alias("every"))
    cut = materialize(nearest)
    reach = cut.where("home").groupBy("cell", "space", F.col("least.pivot").alias("pivot")).agg(F.max("least.d").alias("reach"))
    out = cut.withColumn("x", F.explode("every")).withColumn("pivot", F.col("x.pivot")).join(reach, ["cell", "space", "pivot"])
    near = (F.col("x.d") <= F.col("least.d") + 2 * radius(F.length("word"))) & (F.col("x.d") <= F.col("reach") + radius(F.length("word")))
    here = F.col("pivot") == F.col("least.pivot")
    placed = materialize(
        out.where(here | near & F.col("is_right"))
        .select(F.xxhash64("cell", "space", "pivot").alias("cell"), "space", "word", "is_left", "is_right", (F.col("home") & here).alias("home"), F.col("x.d").alias("d"))
        .where("home or is_right")
    )
    release(pivots)
    release(cut)
    return placed


def _weights(points: DataFrame) -> DataFrame:
    """Pairs each cell will look at: homes of the left times members of the right."""
    return points.groupBy("cell", "space").agg(F.count_if(F.expr("home and is_left")).alias("homes"), F.count_if("is_right").alias("members"), F.count_if("home").alias("n"))


def _grams(word: Column) -> Column:
    """A bit for each two neighbouring letters: an edit changes four bits at most, so more than four for each edit rule a pair out."""
    at = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
    return F.aggregate(at, F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.substr(word, i, F.lit(2))), F.lit(63)).cast("int"))))


def _cut(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(cell, space, word, is_left, is_right, home, d) of the words of both sides in light cells; those in cells that pivots cut no
    further, as they are and as the last step left them; and the number of points."""
    tidy = lambda df, one, two: df.select("space", "word").where("space is not null and word != ''").select("space", "word", F.lit(one).alias("l"), F.lit(two).alias("r"))
    both = tidy(left, True, True) if left is right else tidy(left, True, False).union(tidy(right, False, True))
    points = both.groupBy("space", "word").agg(F.max("l").alias("is_left"), F.max("r").alias("is_right"))
    # the first step: each space is a cell of its own, since pivots of other spaces are APART
    points = materialize(points.select(F.xxhash64("space").alias("cell"), "space", "word", "is_left", "is_right", F.lit(True).alias("home"), F.lit(0).alias("d")))
    total, done = points.count(), points.limit(0)
    heavy_of = lambda df: materialize(_weights(df).where((F.col("n") > CELL) & (F.col("members") > 0) & (F.col("homes") > 0)).select("cell", "space", "n", F.expr("homes * members").alias("pairs")))
    for _ in range(STEPS):
        heavy = heavy_of(points)
        if heavy.isEmpty():
            return done.unionByName(points), points.limit(0), points.limit(0), total
        done = done.unionByName(points.join(heavy, ["cell", "space"], "left_anti"))
        placed = _step(points, heavy.select("cell", "space", "n"))
        before, after = (x or 0 for x in (heavy.agg(F.sum("pairs")).first()[0], _weights(placed).agg(F.sum(F.expr("homes * members"))).first()[0]))
        if after > 0.85 * before:  # pivots help no further
            return done, points.join(heavy, ["cell", "space"], "left_semi"), placed, total
        points = placed
    heavy = heavy_of(points)
    rest = points.join(heavy, ["cell", "space"], "left_semi")
    return done.unionByName(points.join(heavy, ["cell", "space"], "left_anti")), rest, rest, total


def partitioned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, int]:
    """(cell, space, word, is_left, is_right, home, d) of the words of both sides after all steps, and the number of points."""
    light, _, placed, total = _cut(left, right)
    return materialize(light.unionByName(placed)), total


def described(points: DataFrame, total: int) -> Partition:
    """What a partition of `total` points looks like."""
    info = _weights(points).agg(F.count(F.lit(1)).alias("cells"), F.max("members").alias("largest")).first()
    return Partition(info.cells or 0, total, points.count() - total, info.largest or 0)


def _without(word: Column, n: int = 1) -> Column:
    """The strings that are left of a word without one letter, or without two."""
    less = lambda w, i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1))
    size = F.greatest(F.length(word), F.lit(n))  # a shorter word gives nothing that a word of the least length has
    if n == 1:
        return F.transform(F.sequence(F.lit(1), size), lambda i: less(word, i))
    return F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.transform(F.sequence(i, size - 1), lambda j: less(less(word, i), j))))


def _tagged(tag: int, strings: Column) -> Column:
    return F.transform(strings, lambda s: F.xxhash64(F.col("cell"), F.col("space"), F.lit(tag), s))


def _short(word: Column) -> Column:
    """Keys by which pairs meet of which the shorter word has at most 8 letters, and so a radius of 2 at most.

    Each of the two becomes the same string without as many letters as the radius, or fewer in the shorter one.
    """
    n, none = F.length(word), F.array().cast("array<string>")
    one = F.when(n.between(4, 8), F.concat(F.array(word), _without(word))).otherwise(none)
    return _tagged(0, F.concat(one, F.when(n.between(6, 10), _without(word, 2)).otherwise(none)))


#: Letters at either end of a word of 9 or more by which it meets others; they do not overlap, so of three edits one end has
#: one at most. Words of 9 have one letter less at their end.
END = 5


def _given(word: Column) -> Column:
    """Keys of a word: short ones, and both ends, whole and without a letter."""
    n, none = F.length(word), F.array().cast("array<bigint>")
    end = lambda tag, w, k: _tagged(tag, F.concat(F.array(F.left(w, F.lit(k))), _without(F.left(w, F.lit(k)))))
    back = F.reverse(word)
    long = F.concat(end(1, word, END), F.when(n == 9, end(3, back, END - 1)).otherwise(end(2, back, END)))
    return F.array_distinct(F.concat(_short(word), F.when(n >= 9, long).otherwise(none)))


def _asked(word: Column) -> Column:
    """Keys of a word that meet one of `_given` of each word within the radius: an end of the other one is this one's end but for
    a letter that is changed (both without it), too many here (this one without it) or missing here (the other one without it)."""
    n, none = F.length(word), F.array().cast("array<bigint>")
    left = lambda w, k: F.left(w, F.lit(k))
    end = lambda tag, w, k: _tagged(tag, F.concat(F.array(left(w, k - 1)), _without(left(w, k)), _without(left(w, k + 1))))
    back = F.reverse(word)
    long = F.concat(end(1, word, END), end(2, back, END), F.when(n <= 9 + RADIUS, end(3, back, END - 1)).otherwise(none))
    return F.array_distinct(F.concat(_short(word), F.when(n >= 9, long).otherwise(none)))


def _near(most: int) -> Column:
    """The radius of the pair l.word, r.word."""
    return F.least(radius(F.length("l.word")), radius(F.length("r.word")), F.lit(most))


def proposed(points: DataFrame, most: int = RADIUS, tasks: int | None = None) -> DataFrame:
    """Homes l of the left joined with members r of the right that share a key and fit by length, once for each key that
    they share. `points` is as `partitioned` has it."""
    tasks = tasks or max(1, math.ceil(points.count() * 50 / KEYS))
    spread = points.repartition(tasks, "word")  # small files, of which each row makes many
    of = lambda who, keys: spread.where(who).select("space", "word", F.explode(keys(F.col("word"))).alias("key")).repartition(tasks, "key", "space")
    l, r = of("home and is_left", _asked).alias("l"), of("is_right", _given).alias("r")
    fits = F.abs(F.length("l.word") - F.length("r.word")) <= _near(most)
    return l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.space") == F.col("r.space")) & fits & (F.col("l.word") != F.col("r.word")))


def _paired(joined: DataFrame, most: int) -> DataFrame:
    """(space, a, b, distance) of the joined pairs that are within the radius."""
    d = F.levenshtein(F.col("l.word"), F.col("r.word"), most)
    return joined.select(F.col("l.space").alias("space"), F.col("l.word").alias("a"), F.col("r.word").alias("b"), d.alias("distance"), _near(most).alias("near")).where("distance between 0 and near").drop("near")


def within_radius(left: DataFrame, right: DataFrame, most: int = RADIUS) -> DataFrame:
    """Pairs (space, a, b, distance) of different words of `left` and `right` (both: space, word) within their radius, and `most`.

    Each pair stands once, also where both sides hold both words in turn: a is of `left`, b of `right`; with one frame on
    both sides a pair stands in both orders. Null or empty words match nothing; repeated points count once.
    """
    light, heavy, _, _ = _cut(left, right)
    light = materialize(light)
    weights = _weights(light).agg(F.sum(F.expr("homes * members"))).first()[0] or 0
    told = light.withColumns({"n": F.length("word"), "r": F.least(radius(F.length("word")), F.lit(most)), "grams": _grams(F.col("word"))})
    tasks = max(1, min(20_000, math.ceil(weights / PAIRS)))  # by the pairs they look at, not by bytes
    homes, members = (told.where(who).repartition(tasks, "cell", "space") for who in ("home and is_left", "is_right"))
    near = F.least("l.r", "r.r")
    same = (F.col("l.cell") == F.col("r.cell")) & (F.col("l.space") == F.col("r.space"))
    cheap = (F.abs(F.col("l.n") - F.col("r.n")) <= near) & (F.abs(F.col("l.d") - F.col("r.d")) <= near) & (F.bit_count(F.col("l.grams").bitwiseXOR(F.col("r.grams"))) <= 4 * near)
    found = _paired(homes.alias("l").join(members.alias("r"), same & cheap & (F.col("l.word") != F.col("r.word"))), most)
    heavy = materialize(heavy)
    return materialize(found if heavy.isEmpty() else found.unionByName(_paired(proposed(heavy, most), most).distinct()))
