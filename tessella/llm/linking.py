"""Linking the spellings of one firm or person.

Each name is parsed (names.py) into a point: a firm's own words in the space of its line of business, a person's family
name in the space of the given name. Points within the edit radius in one space form an identity (metric_join.py,
components.py). Names that lack the line of business, have initials for a given name or a firm's first word, or are
short forms, are looked up in wider spaces, and linked where only one identity answers best.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.materialize import materialize, tidied
from . import lexicon
from .metric_join import within_radius
from .names import Lexicon, parse

_PARTS = ("kind", "head", "tail", "bag", "business", "given", "initials", "short", "legal")


def parsed(names: DataFrame, words: Lexicon) -> DataFrame:
    """`names` (key, owner, role, name) with the parts of the name; role and owner are carried along."""
    shared = names.sparkSession.sparkContext.broadcast(words)  # bounded where it is learned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names_ = batch.column(3).to_pylist()
            seen = {n: parse(n, shared.value) for n in set(names_)}
            parts = [seen[n] for n in names_]
            columns = [pa.array([p[k] for p in parts], pa.string()) for k in _PARTS]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], names=["key", "owner", "role", *_PARTS])

    return names.select("key", "owner", "role", "name").mapInArrow(run, "key string, owner string, role string, " + ", ".join(f"{k} string" for k in _PARTS))


def with_point(rows: DataFrame) -> DataFrame:
    """Adds space and word of the names that have a full point, null for the others."""
    firm = (F.col("kind") == "f") & (F.col("business") != "") & (F.col("initials") == "")
    person = (F.col("kind") == "p") & (F.col("head") != "")
    return rows.withColumn("space", F.when(firm, F.concat(F.lit("f|"), "business")).when(person, F.concat(F.lit("p|"), "given"))).withColumn(
        "word", F.when(firm | person, F.col("head"))
    )


#: A spelling three edits off is a slip where the other one has at least so many times its support.
RARE = 3


def identities(rows: DataFrame) -> DataFrame:
    """(space, word, identity) of all points; identity is the least "space|word" of those tied together.

    Distinct firms may have heads as alike as two slips of one. A spelling is therefore tied only to its best neighbour of
    more support (distinct names; ties by the alphabet): the nearest, then the best supported one. At distance three only
    spellings are tied that are rare beside the other one (`RARE`) or stand in one name only. So two heads of like support
    that are three apart stay two, and a slip between them joins one.
    """
    every = materialize(rows.where("space is not null").groupBy("space", "word").agg(F.countDistinct("key").alias("n")))
    pairs = within_radius(every, every)
    l = every.select("space", F.col("word").alias("a"), F.col("n").alias("na"))
    r = every.select("space", F.col("word").alias("b"), F.col("n").alias("nb"))
    better = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    known = pairs.join(l, ["space", "a"]).join(r, ["space", "b"]).where(better & ((F.col("distance") < 3) | (F.col("na") * RARE <= F.col("nb")) | (F.col("na") == 1)))
    best = known.groupBy("space", "a").agg(F.expr("min_by(b, struct(distance, -nb, b))").alias("b"))
    name = lambda c: F.concat_ws("|", "space", c)
    tied = components(best.select(name("a").alias("a"), name("b").alias("b")))
    return every.withColumn("node", name("word")).join(tied, "node", "left").select("space", "word", F.coalesce("component", "node").alias("identity"))


def targets(rows: DataFrame) -> DataFrame:
    """(space, word, label, legal): the wider points under which the labelled names `rows` can be looked up."""
    firm, two = F.col("kind") == "f", F.col("tail") != ""
    first = F.substring("head", 1, 1)
    spaces = F.array(
        F.when(firm & (F.col("initials") == ""), F.struct(F.lit("F").alias("space"), F.col("head").alias("word"))),
        F.when(firm & two, F.struct(F.concat_ws("|", F.lit("F"), first).alias("space"), F.col("tail").alias("word"))),
        F.when(firm & two & (F.col("business") != ""), F.struct(F.concat_ws("|", F.lit("F"), "business", first).alias("space"), F.col("tail").alias("word"))),
        F.when(firm & (F.col("initials") != ""), F.struct(F.concat_ws("|", F.lit("F"), "initials").alias("space"), F.col("head").alias("word"))),
        F.when(firm & (F.col("initials") != "") & (F.col("business") != ""), F.struct(F.concat_ws("|", F.lit("F"), "business", "initials").alias("space"), F.col("head").alias("word"))),
        F.when(F.col("kind") == "p", F.struct(F.concat_ws("|", F.lit("P"), F.substring("given", 1, 1)).alias("space"), F.col("head").alias("word"))),
        F.when(F.col("kind") == "i", F.struct(F.concat_ws("|", F.lit("P"), F.substring("initials", 1, 1)).alias("space"), F.col("head").alias("word"))),
        F.when(F.col("short") != "", F.struct(F.lit("A").alias("space"), F.col("short").alias("word"))),
        F.when(F.col("bag") != "", F.struct(F.lit("B").alias("space"), F.col("bag").alias("word"))),
    )
    return rows.withColumn("point", F.explode(F.filter(spaces, lambda x: x.isNotNull()))).select("point.space", "point.word", "label", "legal").distinct()


def questions(rows: DataFrame) -> DataFrame:
    """(key, space, word, legal): the wider points by which names without a full point are looked up."""
    firm, single = F.col("kind") == "f", F.col("initials") != ""
    letter = F.substring("initials", 1, 1)
    spaces = F.array(
        F.when(firm & ~single, F.struct(F.lit("F").alias("space"), F.col("head").alias("word"))),
        F.when(firm & single & (F.col("business") == ""), F.struct(F.concat_ws("|", F.lit("F"), letter).alias("space"), F.col("head").alias("word"))),
        F.when(firm & single & (F.col("business") != ""), F.struct(F.concat_ws("|", F.lit("F"), "business", letter).alias("space"), F.col("head").alias("word"))),
        F.when(F.col("kind") == "i", F.struct(F.concat_ws("|", F.lit("F"), letter).alias("space"), F.col("head").alias("word"))),
        F.when(F.col("kind") == "i", F.struct(F.concat_ws("|", F.lit("P"), letter).alias("space"), F.col("head").alias("word"))),
        F.when(F.col("kind") == "a", F.struct(F.lit("A").alias("space"), F.col("short").alias("word"))),
        F.when(F.col("bag") != "", F.struct(F.lit("B").alias("space"), F.col("bag").alias("word"))),
    )
    return rows.withColumn("point", F.explode(F.filter(spaces, lambda x: x.isNotNull()))).select("key", "point.space", "point.word", "legal").distinct()


def answers(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(key, label) where exactly one label of `known` answers a question best.

    A wider space holds more names, so words may differ by two edits there, and by one where only an initial stands before
    them. Nearer words go first, then labels that are known with the question's legal form; a tie of several labels is no answer.
    """
    asked, known = materialize(asked), materialize(known)
    pairs = within_radius(asked, known.where("space != 'A'"), 2).where("space != 'A'").select("space", F.col("a").alias("word"), F.col("b").alias("other"), "distance")
    same = asked.select("space", "word").distinct().withColumn("other", F.col("word")).withColumn("distance", F.lit(0))
    parts = F.size(F.split("space", "[|]"))
    most = F.when(F.col("space").startswith("F|") & (parts == 2) | (F.col("space") == "B"), 1).otherwise(2)
    links = pairs.where(F.col("distance") <= most).unionByName(same)
    label = known.groupBy("space", F.col("word").alias("other"), "label").agg(F.collect_set("legal").alias("legals"))
    found = asked.join(links, ["space", "word"]).join(label, ["space", "other"])
    form = F.when((F.col("legal") != "") & F.array_contains("legals", F.col("legal")), 0).otherwise(1)
    each = found.groupBy("key", "label").agg(F.min(F.struct("distance", form.alias("form"))).alias("score"))
    best = each.withColumn("least", F.min("score").over(Window.partitionBy("key"))).where("score = least")
    return materialize(best.groupBy("key").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n")).where("n = 1").select("key", "label"))


def _known(entities: DataFrame, aliases: DataFrame, patents: DataFrame, words: Lexicon | None) -> tuple[DataFrame, DataFrame]:
    """(key, identity) of the names to be linked, and (entity, identity) of the entities."""
    words = lexicon.learn(entities, aliases) if words is None else words
    entity = entities.select(F.col("entity_id").alias("key"), F.col("entity_id").alias("owner"), F.lit("e").alias("role"), F.col("canonical_name").alias("name")).where("key is not null")
    alias = aliases.select(
        F.when(F.col("entity_id").isNull(), F.col("alias_id")).otherwise(F.concat(F.lit("own|"), "alias_id")).alias("key"), F.col("entity_id").alias("owner"),
        F.when(F.col("entity_id").isNull(), "a").otherwise("o").alias("role"), F.col("surface").alias("name"),
    ).where("key is not null")
    patent = patents.select(F.col("pub_no").alias("key"), F.lit(None).cast("string").alias("owner"), F.lit("p").alias("role"), F.col("assignee").alias("name")).where("key is not null")
    rows = materialize(with_point(parsed(entity.unionByName(alias).unionByName(patent), words)).distinct())
    label = materialize(identities(rows))
    full = materialize(rows.join(label, ["space", "word"]).withColumnRenamed("identity", "label"))

    of = lambda c: F.concat(F.lit("e|"), c)
    named = full.where("owner is not null").select(F.col("owner").alias("entity"), "label").distinct()
    redirects = entities.select(F.col("entity_id").alias("entity"), of("redirects_to").alias("label")).where("entity is not null and label is not null").distinct()
    open_names = rows.where("space is null")
    # entities none of whose names has a full point: by what answers, else by their own words
    lone = materialize(open_names.where("owner is not null").join(named.select(F.col("entity").alias("owner")).distinct(), "owner", "left_anti"))
    # names for looking up: all full names under their identity, the own open names of an entity under the entity
    of_entity = open_names.where("owner is not null").withColumn("label", of("owner"))
    full_entity = full.where("owner is not null").withColumn("label", of("owner"))
    group = materialize(components(named.select(of("entity").alias("a"), F.col("label").alias("b")).union(redirects.select(of("entity"), F.col("label")))))
    regroup = lambda df, g: df.join(g.select(F.col("node").alias("label"), "component"), "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")
    known = targets(regroup(full_entity.unionByName(of_entity.join(lone.select("owner").distinct(), "owner", "left_anti")), group))
    settled = answers(questions(lone.withColumn("key", F.col("owner"))), known).select(F.col("key").alias("entity"), "label")
    # entities that nothing answers stand together where they have the same words: by a node for the words, not by pairs
    loose = lone.join(settled.select(F.col("entity").alias("owner")), "owner", "left_anti")
    own = targets(loose.withColumn("label", of("owner"))).where("space in ('F', 'B') or space like 'P%'")
    alike = own.select(F.col("label").alias("a"), F.concat_ws("|", F.lit("w"), "space", "word").alias("b"))
    edges = group.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(settled.select(of("entity").alias("a"), F.col("label").alias("b"))).unionByName(alike)
    final = materialize(components(edges))
    ids = entity.select("key").distinct()
    members = materialize(regroup(ids.select(F.col("key").alias("entity"), of("key").alias("label")), final))

    everything = targets(regroup(full_entity.unionByName(of_entity), final))
    found = regroup(full.where("owner is null").select("key", "label"), final).join(members.select("label").distinct(), "label", "left_semi")
    # also names with a full point in whose identity no entity stands
    pending = open_names.where("owner is null").unionByName(full.where("owner is null").drop("label").select(*open_names.columns).join(found.select("key").distinct(), "key", "left_anti"))
    by_look = answers(questions(pending), everything)
    return by_look.unionByName(found.select("key", "label")).distinct(), members


@tidied
def members(entities: DataFrame, aliases: DataFrame, patents: DataFrame, words: Lexicon | None = None) -> DataFrame:
    """(key, identity, kind, entities): each entity id ('entity'), and each open alias or publication number ('name') of which
    the identity is known, with the least entity id of its identity and the number of entity ids that it has.

    The form for identities of any size: one row a key, no pairs. Inputs and cases as for `linked`.
    """
    names, inside = _known(entities, aliases, patents, words)
    every = inside.groupBy("label").agg(F.min("entity").alias("identity"), F.count(F.lit(1)).alias("entities"))
    keys = inside.select(F.col("entity").alias("key"), "label", F.lit("entity").alias("kind")).unionByName(names.select("key", "label", F.lit("name").alias("kind")))
    return keys.join(every, "label").select("key", "identity", "kind", "entities").distinct()


@tidied
def linked(entities: DataFrame, aliases: DataFrame, patents: DataFrame, words: Lexicon | None = None) -> DataFrame:
    """(key_a, key_b): two entity ids, or an alias or publication number and an entity id, that mean the same; a < b.

    Inputs are the entity, alias and patent tables; other columns are ignored. Null, empty and blank names, and names with
    nothing but legal forms, link nothing (an entity may still be linked by its other names or by redirects_to). Repeated
    rows give one pair. Ids that stand in no entity row are not linked to. Names that several firms or persons answer
    equally well are not linked to any of them. `words` is learned from the same entities and aliases where it is not given.
    """
    names, inside = _known(entities, aliases, patents, words)
    outside = names.join(inside, "label").select("key", "entity")
    l, r = inside.alias("l"), inside.alias("r")
    pairs = l.join(r, (F.col("l.label") == F.col("r.label")) & (F.col("l.entity") < F.col("r.entity"))).select(F.col("l.entity").alias("key"), F.col("r.entity").alias("entity"))
    both = outside.unionByName(pairs).where("key != entity")
    return both.select(F.least("key", "entity").alias("key_a"), F.greatest("key", "entity").alias("key_b")).distinct()
