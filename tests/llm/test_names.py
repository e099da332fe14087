from __future__ import annotations

import itertools
import os
import random

import pytest

from tessella.llm.linking import linked
from tessella.llm.metric_join import radius, within_radius
from tessella.llm import lexicon, metric_join
from tessella.llm.linking import members
from tessella.llm.names import Lexicon, near, parse

TRADES = {"marine": "marine", "mar": "marine", "robotiks": "robotics", "rbtks": "robotics", "optik": "optics", "optiks": "optics"}
WORDS = Lexicon(TRADES, {"villiam": "villiam", "bill": "villiam", "elizabeth": "elizabeth", "liz": "elizabeth", "farida": "farida"})


@pytest.mark.parametrize(
    "name, kind, head, more",
    [
        ("Messrs. Bako Druno Mar. Eng. (Pvt. Ltd.)", "f", "bakodruno", ("business", "marine")), ("Верги Роботикс", "f", "vergi", ("business", "robotics")), ("DRUVAN, Bill", "p", "druvan", ("given", "villiam")),
        ("Col. Liz J. Padun", "p", "padun", ("initials", "j")), ("Padun E.J.", "i", "padun", ("initials", "ej")), ("B. Druno Optik GmbH", "f", "druno", ("initials", "b")), ("Nami Godre Optics S.L. (NGOS)", "f", "namigodre", ("short", "NGOS")),
        ("NGOS", "a", "", ("short", "NGOS")), ("Ltd.", "", "", ("legal", "ltd")), ("Kor1nu Société Anonyme", "f", "korinu", ("legal", "sa")),
    ],
)
def test_parse(name, kind, head, more):
    p = parse(name, WORDS)
    assert (p["kind"], p["head"], p[more[0]]) == (kind, head, more[1])
    assert parse(None, WORDS)["kind"] == parse("  ", WORDS)["kind"] == ""


@pytest.mark.parametrize("cell", [metric_join.CELL, 5])
def test_radius_join_against_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(metric_join, "CELL", cell)
    rng = random.Random(7)
    points = [(rng.choice("xy"), rng.choice("ab") + "".join(rng.choice("abc") for _ in range(rng.randrange(0, 10)))) for _ in range(150)]
    points = sorted(set(points))
    monkeypatch.setattr(metric_join, "FAN", 3)
    reach = lambda n: 0 if n < 4 else 1 if n < 6 else 2 if n < 9 else 3
    want = {(s, a, b) for (s, a), (t, b) in itertools.permutations(points, 2) if s == t and near(a, b, reach(min(len(a), len(b))))}
    df = spark.createDataFrame([*points, (None, "abc"), ("x", ""), ("x", None)], "space string, word string")
    assert {(r.space, r.a, r.b) for r in within_radius(df, df).collect()} == want
    assert within_radius(df.limit(0), df).count() == 0
    some = df.where("word >= 'b'")
    two = {(r.space, r.a, r.b) for r in within_radius(some, df, 2).collect()}
    assert two == {(s, a, b) for s, a, b in want if a >= "b" and near(a, b, 2)}
    parts, total = metric_join.partitioned(df, df)
    shape = metric_join.described(parts, total)
    if cell == 5:
        assert shape.cells > 10 and shape.copies > 0  # pivots beyond those of the spaces, and boundary copies


def test_pivots_cut_real_names(spark):
    """On names of the supplied tables each space has several cells, and boundary names are copied."""
    path = "/root/testdata/sf0.1/extracted_entity.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    names = spark.read.parquet(path).selectExpr("'f' as space", "lower(regexp_replace(canonical_name, '[^A-Za-z]', '')) as word")
    parts, total = metric_join.partitioned(names, names)
    shape = metric_join.described(parts, total)
    assert shape.cells > 1 and shape.copies > 0 and shape.points == total


def test_lexicon_is_learned(spark):
    """Trades, given names and their forms that no list holds, with a hot entity, slips, nulls and repeated rows."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    trades = {"Ceramics": ["Keramik", "Cerms"], "Textile Mills": ["Textilwerk", "Txt Mls"]}
    given = {"Hiroshi": "Hiro", "Kwame": "Kwa"}
    entity, alias = [], []
    for i in range(240):
        e, own = f"e{i}", word().capitalize()
        if i % 2:
            full, forms = rng.choice([*trades.items()])
            entity.append((e, f"{own} {full} Ltd"))
            alias += [(e, f"{own} {forms[i % 4 // 2]}"), (e, f"{own[:-1]} {full}")]
        else:
            full, form = rng.choice([*given.items()])
            entity.append((e, f"{full} {own}"))
            alias += [(e, f"{own}, {form}"), (e, f"{full} {own}x")]
    alias += [(None, "Keramik"), ("e1", None)] + [alias[0]] * 300
    learned = lexicon.learn(spark.createDataFrame(entity, "entity_id string, canonical_name string"), spark.createDataFrame(alias, "entity_id string, surface string"))
    one = lambda d, *ws: len({d[w] for w in ws}) == 1
    assert one(learned.business, "keramiks", "keramik", "kerms") and one(learned.business, "tekstile", "mills", "tekstilverk", "tkst")
    assert one(learned.given, "hiroshi", "hiro") and one(learned.given, "kvame", "kva")
    assert len({*learned.business.values()}) == len({*learned.given.values()}) == 2
    assert lexicon.learn(spark.createDataFrame([], "entity_id string, canonical_name string"), spark.createDataFrame([], "entity_id string, surface string")).business == {}


def test_linked(spark):
    entity = [("e1", "Bakodruno Optics Ltd", None), ("e2", "BAKODRUUNO Optik", None), ("e3", "Bakodruno Robotics", None), ("e4", "Elizabeth Padunana", None), ("e5", "Liz Padunaan", None), ("e6", "Farida Padunana", None), ("e7", "Zorg Qux", "e3"), ("e8", None, None)]
    alias = [("a1", "e1", "Bakodruno"), ("a2", None, "Бакодруно Оптикс"), ("a3", None, "E. Padunana"), ("a4", None, "Bakodruno"), ("a5", None, "Unheard Systems"), ("a2", None, "Бакодруно Оптикс"), ("a6", None, " ")]
    patent = [("P1", "Bakodruno Rbtcs S.A."), ("P2", None), ("P1", "Bakodruno Rbtcs S.A.")]
    frames = spark.createDataFrame(entity, "entity_id string, canonical_name string, redirects_to string"), spark.createDataFrame(alias, "alias_id string, entity_id string, surface string"), spark.createDataFrame(patent, "pub_no string, assignee string")
    got = sorted(tuple(r) for r in linked(*frames, WORDS).collect())
    assert got == [("P1", "e3"), ("P1", "e7"), ("a2", "e1"), ("a2", "e2"), ("a3", "e4"), ("a3", "e5"), ("e1", "e2"), ("e3", "e7"), ("e4", "e5")]
    assert {(r.key, r.identity) for r in members(*frames, WORDS).collect()} >= {("e1", "e1"), ("e2", "e1"), ("a2", "e1"), ("P1", "e3"), ("e7", "e3"), ("e8", "e8")}
    assert linked(*(f.limit(0) for f in frames), WORDS).count() == 0
    assert linked(*(f.limit(0) for f in frames)).count() == 0


def test_even_spaces_meet_by_keys(spark, monkeypatch):
    """Words that lie evenly apart, which pivots do not cut: all pairs are found, and few others are looked at."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(n))
    points = {word(rng.randrange(2, 8)) for _ in range(150)}
    for w in sorted(points):  # slips of one to three letters, at both ends and within
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(w) + 1)
            w = w[:at] + rng.choice(["", "x", rng.choice("aeiou")]) + w[at + rng.randrange(2) :]
        points.add(w)
    reach = lambda a, b: metric_join.RADIUS if (n := min(len(a), len(b))) >= 9 else 0 if n < 4 else 1 if n < 6 else 2
    want = {x for a, b in itertools.combinations(sorted(points), 2) if abs(len(a) - len(b)) < 4 and near(a, b, reach(a, b)) for x in ((a, b), (b, a))}
    df = spark.createDataFrame([("x", w) for w in sorted(points)], "space string, word string")
    got = [(r.a, r.b) for r in within_radius(df, df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    _, heavy, _, total = metric_join._cut(df, df)
    assert heavy.count() == total == len(points)  # as they were, without copies
    assert metric_join.proposed(heavy).count() < len(points) ** 2 / 10
