"""Core operators on small fixtures, against brute force."""

from __future__ import annotations

import itertools
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.functions import dates, measures, text
from tessella.operators import dml, entities, evidence, joins, ranking, textual
from tessella.operators.components import components


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000, i) for i in range(1001, 1300)] + [(i, i + 1) for i in range(2000, 2064)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    want = sorted((x, find(x)) for x in {x for a, b in edges if a != b for x in (a, b)})
    got = components(spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long"))
    assert rows(got, "node", "component") == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_joins_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    make = lambda n: [(rng.randrange(3), i, s := rng.randrange(3000), s + rng.randrange(0, 700)) for i in range(n)]
    a, b = make(60), make(60)
    left, right = spark.createDataFrame(a, "k long, l long, ls long, le long"), spark.createDataFrame(b, "k long, r long, rs long, re long")
    want = sorted((x[1], y[1]) for x, y in itertools.product(a, b) if x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and x[3] > y[2])
    assert rows(joins.overlap_join(left, right, ["k"], ("ls", "le"), ("rs", "re"), 256), "l", "r") == want
    want = sorted((x[1], y[1]) for x, y in itertools.product(a, b) if x[0] == y[0] and x[2] < x[3] and y[2] >= x[2] and y[3] <= x[3])
    assert [x for x in rows(joins.containment_join(left, right, ["k"], ("ls", "le"), ("rs", "re"), 256), "l", "r")] == want
    want = sorted((x[1], y[1]) for x, y in itertools.product(a, b) if x[0] == y[0] and abs(x[2] - y[2]) <= 90)
    assert rows(joins.near_join(left, right, ["k"], "ls", "rs", 90), "l", "r") == want


def test_as_of(spark):
    t = lambda m: datetime(2025, 1, 1) + timedelta(minutes=m)
    left = spark.createDataFrame([(1, t(5)), (1, t(0)), (2, t(9))], "k int, at timestamp")
    right = spark.createDataFrame([(1, t(1), 10), (1, t(5), 20), (1, t(6), 30)], "k int, seen timestamp, v int")
    assert rows(joins.as_of(left, right, ["k"], "at", "seen", ["v"]), "k", "at", "v") == [(1, t(0), None), (1, t(5), 20), (2, t(9), None)]


def test_upsert_keeps_known_values(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, name string, note string")
    new = spark.createDataFrame([(2, "", "n"), (3, "c", None)], "id int, name string, note string")
    assert rows(dml.upsert(old, new, ["id"], blank=True), "id", "name", "note") == [(1, "a", "x"), (2, "b", "n"), (3, "c", None)]
    assert rows(dml.insert_ignore(old, new, ["id"]), "id", "name") == [(1, "a"), (2, "b"), (3, "c")]


def test_mid_rank_small_cohort_and_ties(spark):
    df = spark.createDataFrame([("a", i % 2) for i in range(40)] + [("b", 1), ("a", None)], "c string, s int")
    got = {(r.c, r.s): r.mid_rank for r in ranking.mid_rank(df, ["c"], "s").collect()}
    assert got == {("a", 0): 0.25, ("a", 1): 0.75, ("b", 1): 0.5, ("a", None): 0.5}


def test_pages_number_every_row_once(spark):
    df = spark.createDataFrame([(i,) for i in range(123)], "i int").repartition(7)
    got = ranking.pages(df, [df.i.desc()]).collect()
    assert sorted((r.row_no, r.i) for r in got) == [(n, 123 - n) for n in range(1, 124)]
    assert sorted({r.page: 0 for r in got}) == [1, 2, 3]


def test_gram_pairs_lose_none(spark):
    rng = random.Random(2)
    names = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(3, 9)))) for i in range(60)]

    def grams(x):
        x = f" {x} "
        return {x[i : i + 3] for i in range(len(x) - 2)}

    want = sorted((a, b) for (a, x), (b, y) in itertools.combinations(names, 2) if round(len(grams(x) & grams(y)) / len(grams(x) | grams(y)), 6) >= 0.5)
    assert rows(entities.gram_pairs(spark.createDataFrame(names, "k int, v string"), "k", "v", 0.5), "a", "b") == want


def test_resolve_with_constraints(spark):
    df = spark.createDataFrame([(1, "Acme Ltd", "o"), (2, "ACME  ltd", "o"), (3, "Acme Ltd", "p"), (4, "Zorg", "o"), (5, None, "o")], "k int, n string, t string")
    pair = lambda a, b: spark.createDataFrame([(a, b)], "a int, b int")
    assert rows(entities.resolve(df, "k", "n", "t"), "k", "entity") == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]
    assert rows(entities.resolve(df, "k", "n", "t", must=pair(4, 1), never=pair(2, 1)), "k", "entity") == [(1, 1), (2, 2), (3, 3), (4, 1), (5, 5)]


def test_tokens_offsets_are_code_points(spark):
    t = "é́ 𝒳 12,5 кот!"
    got = textual.tokens(spark.createDataFrame([(1, t), (2, None), (3, "")], "k int, t string"), "k", "t").collect()
    assert all(t[r.start_c : r.end_c] == r.token for r in got) and [r.token for r in got][-3:] == ["12,5", "кот", "!"]


def test_merge_spans_longest_wins(spark):
    df = spark.createDataFrame([(1, 0, 10, "a", "x"), (1, 2, 6, "b", "x"), (1, 2, 6, "a", "x"), (1, 8, 14, "c", "x"), (1, 8, 9, "b", "x")], "k int, start_c int, end_c int, kind string, value string")
    assert rows(textual.merge_spans(df, "k"), "start_c", "end_c", "kind") == [(0, 10, "a"), (2, 6, "b")]


def test_threads(spark):
    day = lambda n: datetime(2025, 1, 1) + timedelta(days=n)
    df = spark.createDataFrame([("t", day(0), "a"), ("t", day(0), "b"), ("t", day(40), "c"), ("t", day(200), "d"), (None, day(1), "e")], "k string, at timestamp, i string")
    assert [(r.i, r.role, r.previous) for r in evidence.threads(df, "k", "at", "i").orderBy("i").collect()] == [("a", "first", None), ("b", "duplicate", "a"), ("c", "continues", "a"), ("d", "unlinked", None)]


def test_printed_dates(spark):
    given = ["2025-03-09T10:00:00Z", "9 June 2026", "June 9, 2026", "13/05/2024", "05/06/2024", "06/06/2024", "2025-07", "in 2019", "1888", "none", None]
    want = ["2025-03-09", "2026-06-09", "2026-06-09", "2024-05-13", "2024-06", "2024-06-06", "2025-07", "2019", None, None, None]
    df = spark.createDataFrame([(x,) for x in given], "v string")
    assert [r[0] for r in df.select(dates.label(dates.printed_date(df.v))).collect()] == want


def test_text_functions(spark):
    from pyspark.sql import functions as F

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.unicode_fold(F.lit("Čafé STRASSE 한글"))) == "cafe strasse 한글"
    assert one(text.company_key(F.lit("the a.b.c. co ltd"))) == "the abc" and one(text.company_key(F.lit("ltd"))) == "ltd"
    assert one(text.url_key(F.lit("https://www.x.example/en/a/index.html?q=1#z"))) == "x.example/a"
    assert one(text.has_word(F.lit("naïve plan"), "na")) is False
    assert one(text.initialism(F.lit("World Trade Centre"))) == "WTC" and one(text.initialism(F.lit("A 1 B"))) is None
    assert one(text.contains_run(F.lit("a b c"), F.lit("b c"))) is True
    assert one(measures.js_round(F.lit(-2.5))) == -2 and one(measures.shrunk_index(F.lit(1), F.lit(0))) == 75.0
    assert one(measures.shrunk_index(F.lit(0), F.lit(0))) is None


def test_html_and_feeds(spark, tmp_path):
    from tessella.sources import pages

    html = "<html><title>T</title><body><p>One <b>two</b></p><script>x()</script><a href='/a#b'>l</a></body>"
    r = pages.html_text(spark.createDataFrame([(1, html, "https://x.example/q"), (2, None, None)], "k int, h string, u string"), "k", "h", "u").orderBy("k").collect()
    assert (r[0].title, r[0].text, r[0].links) == ("T", "One two\nl", ["https://x.example/a"]) and r[1].text is None
    (tmp_path / "f.xml").write_text('<rss><channel><item><title><![CDATA[A & B]]></title><link>u</link><dc:date xmlns:dc="d">2025</dc:date></item></channel></rss>')
    assert [tuple(x) for x in pages.feed_entries(spark, str(tmp_path / "f.xml")).collect()] == [("A & B", "u", "2025")]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{broken\n')
    assert sorted((r.a or 0) for r in pages.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").cache().collect()) == [0, 1]


def fetch_page(n):
    return [(f"{n}-{i}", "t", None) for i in range(2)]


def test_paged_source(spark, monkeypatch):
    from tessella.sources.pages import PagedSource, _Page, _PagedReader

    reader = _PagedReader({"fetch": "tests.test_operators:fetch_page", "pages": "2"})
    assert len(reader.partitions()) == 2 and [*reader.read(_Page(1))][0][:2] == (1, "1-0")
    assert PagedSource.name() == "paged"


def test_state_machines(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessella.streaming import pipelines as P

    events = [("w", i, k, e) for i, (k, e) in enumerate([("claim", 0), ("commit", 9), ("expire", 1), ("commit", 1), ("claim", 0), ("commit", 2), ("claim", 0)])]
    df = spark.createDataFrame(events, "k string, o int, what string, e long")
    df.write.parquet(str(tmp_path / "in"))
    out = P.run_once(P.leases(P.read(spark, str(tmp_path / "in"), df), "k", "o", "what", "e"), str(tmp_path / "run"))
    assert [(r.state, r.epoch, r.attempts) for r in out.orderBy("o").collect()] == [("leased", 1, 0), ("leased", 1, 0), ("ready", 1, 1), ("ready", 1, 1), ("leased", 2, 1), ("done", 2, 1), ("done", 2, 1)]
    stored = P.read(spark, str(tmp_path / "in"), df)
    P.store(stored.withColumn("p", F.col("o") % 2), str(tmp_path / "st"), str(tmp_path / "log")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "st")).count() == 7


def test_quotes_anywhere_against_brute_force(spark):
    quotes = [("P1", "Unit costs fell by a third."), ("P2", "Тендер на  поставку радаров"), ("P3", "調達契約は防衛省が公告した装備品である"), ("P4", "Unit costs"), ("P5", "Unit costs fell by a third."), ("P6", "x" * 200), ("P7", None), ("P8", "")]
    texts = [(1, "NEWS\nunit costs  fell by a third. More"), (2, 'He said: "Unit costs fell by a third."'), (3, "Рынок: тендер на поставку радаров объявлен"), (4, "本日、調達契約は防衛省が公告した装備品である。"), (5, None), (6, ""), (None, "(Unit costs fell"), (7, "y" + "x" * 300)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    wanted = spark.createDataFrame(quotes, "pub_no string, abstract string")
    squeeze = lambda t: re.sub(r"\s+", " ", t.lower())
    want = {(i, p, squeeze(t).index(squeeze(q))) for i, t in texts if t for p, q in quotes if q and squeeze(q) in squeeze(t)}
    got = [tuple(r) for r in textual.quotes(docs, wanted, "doc_id", "text", "pub_no", "abstract").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert textual.quotes(docs, wanted.limit(0), "doc_id", "text", "pub_no", "abstract").count() == 0


def test_shared_folder_is_demanded_on_clusters(spark):
    from types import SimpleNamespace

    from tessella.operators.materialize import shared_folder

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        shared_folder(cluster)


def test_tidied_leaves_its_results_only(spark):
    import os

    from tessella.operators.materialize import materialize, shared_folder, tidied

    @tidied
    def two(n):
        part = materialize(spark.range(n))
        return part.where("id > 1"), 7

    here = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(here))
    out, seven = two(5)
    assert seven == 7 and out.count() == 3 and len(set(os.listdir(here)) - before) == 1


def test_ranges_decide_by_their_nearest_ends(spark):
    from tessella.functions.measures import ranges_decide

    rows = [(98.0, 100.0, 104.0, 10000.0), (104.0, 10000.0, 98.0, 100.0), (98.0, 100.0, 101.0, 10000.0), (1.0, 5.0, 4.0, 9.0), (-2.0, -1.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert [r[0] for r in df.select(ranges_decide(*(F.col(c) for c in "abcd"))).collect()] == [-1, 1, 0, 0, -1]


def test_chunks_follow_one_another(spark):
    from tessella.operators.flows import chunks

    texts = {1: "ab\ncdef\ngh\n", 2: None, 3: "", 4: "x" * 30 + "\ny", 5: "\r\n\r\na"}
    rows = chunks(spark.createDataFrame([*texts.items()], "k int, t string"), "k", "t", 8).collect()
    for k, t in texts.items():
        mine = sorted((r.n, r.start_c, r.end_c) for r in rows if r.k == k)
        assert "".join((t or "")[a:e] for _, a, e in mine) == (t or "") and [n for n, _, _ in mine] == [*range(len(mine))]
        assert all(e - a <= 8 or "\n" not in t[a : e - 1] for _, a, e in mine)


def test_open_filters_and_hosts(spark):
    from tessella.operators.flows import matching, page_after, without_hosts

    df = spark.createDataFrame([(1, "a.b.example"), (2, "b.example"), (3, "xb.example"), (4, None)], "id int, host string")
    assert matching(df, {"id": None, "host": None}).count() == 4 and matching(df, {"id": [1, 2]}).count() == 2
    assert [r.id for r in page_after(df, "id", 2, 1).collect()] == [3]
    kept = without_hosts(df, "host", spark.createDataFrame([("b.example",)], "blocked string"), "blocked")
    assert sorted(r.id for r in kept.collect()) == [3, 4]


def test_designators_are_one_token(spark):
    from tessella.operators.textual import tokens

    got = [r.token for r in tokens(spark.createDataFrame([(1, "The T-90 fires 5.56x45mm, 1,200 rounds.")], "k int, t string"), "k", "t").orderBy("i").collect()]
    assert got == ["The", "T-90", "fires", "5.56x45mm", ",", "1,200", "rounds", "."]


def test_near_titles_against_all_pairs(spark, monkeypatch):
    """Titles against every earlier one, with null titles, groups and keys and repeated titles; titles, not pairs, leave the join."""
    rng = random.Random(4)
    word = lambda: rng.choice(["plant", "trials", "delays", "costs", "adds", "shift", "é", "x1", "x2", "x3"])
    rows = [(f"k{i:03}", rng.choice(["g", "h", None]), rng.choice([None, "", "...", "Plant: trials"]) if i % 9 == 0 else " ".join(word() for _ in range(rng.randrange(1, 9)))) for i in range(140)]
    rows += [(None, "g", "plant trials"), (None, None, "costs")]
    words = {r: {w for w in re.split(r"\W+", (r[2] or "").lower()) if w} for r in rows}

    def twin(a, b):
        if a[0] is None or b[0] is None or not a[0] < b[0] or not words[a] or not words[b]:
            return False
        like = len(words[a] & words[b]) / len(words[a] | words[b])
        return like >= 0.75 or like >= 0.6 and a[1] == b[1]

    want = sorted(((b[0], not any(twin(a, b) for a in rows)) for b in rows), key=str)
    assert {True, False} == {k for _, k in want}
    df = spark.createDataFrame(rows, "k string, g string, t string")
    assert sorted(((r.k, r.kept) for r in evidence.near_titles(df, "k", "t", "g").collect()), key=str) == want
    assert evidence.near_titles(df.limit(0), "k", "t", "g").count() == 0
    seen = []
    one = evidence._earliest
    monkeypatch.setattr(evidence, "_earliest", lambda titles, t, *g: seen.append((titles.count(), one(titles, t, *g).count())) or one(titles, t, *g))
    evidence.near_titles(spark.createDataFrame([(f"{i:04}", "g", f"plant adds a shift at site {i % 100}") for i in range(600)], "k string, g string, t string"), "k", "t", "g").count()
    assert seen == [(100, 100), (100, 100)]  # of 600 titles, 100 sets of words


@pytest.mark.parametrize("few", [8, 2, 0])
def test_most_shared_against_all_pairs(spark, monkeypatch, few):
    """By subsets and by single words: the most shared words, ties to the least item, a null item last."""
    from tessella.operators import select

    monkeypatch.setattr(select, "SUBSETS", few)
    rng = random.Random(6)
    words = lambda: sorted({rng.choice("abcdefghi") for _ in range(rng.randrange(0, 6))})
    left, right = ([(f"{side}{i:02}", words()) for i in range(60)] for side in "ki")
    right.append((None, ["a", "z"]))
    left.append(("kz", ["z"]))
    want = set()
    for k, a in left:
        scored = [(-len({*a} & {*b}), i is None, i or "", i) for i, b in right if {*a} & {*b}]
        if scored:
            want.add((k, min(scored)[3], -min(scored)[0]))
    a, b = spark.createDataFrame(left, "k string, ws array<string>"), spark.createDataFrame(right, "i string, ws array<string>")
    got = select.most_shared(a, b, "k", "i", "ws").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_most_shared_of_a_word_in_every_row(spark):
    """Four million pairs share a word; 1,000 of them share a second one."""
    from tessella.operators import select

    a = spark.createDataFrame([(f"k{i}", ["forge", f"own{i}"]) for i in range(2000)], "k string, ws array<string>")
    b = spark.createDataFrame([(f"i{i:04}", ["forge", f"own{i + 1000}"]) for i in range(2000)], "i string, ws array<string>")
    out = select.most_shared(a, b, "k", "i", "ws")
    assert sorted((r.k, r.i, r.n) for r in out.collect()) == sorted((f"k{i}", f"i{i - 1000:04}" if i >= 1000 else "i0000", 2 if i >= 1000 else 1) for i in range(2000))
