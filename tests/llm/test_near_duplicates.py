from __future__ import annotations

import itertools
import random

import pytest

from tessella.llm import near_duplicates as nd


def brute(texts, threshold):
    feats = {k: set(nd.features(nd.plain(t)).tolist()) for k, t in texts.items() if t and nd.plain(t)}
    up = {k: k for k in feats}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(feats, 2):
        if len(feats[a] & feats[b]) >= threshold * len(feats[a] | feats[b]):
            up[find(a)] = find(b)
    return {(a, b) for a, b in itertools.combinations(sorted(feats), 2) if find(a) == find(b)}


def made(n=60, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    texts = {}
    for i in range(n):
        base = [rng.choice(words) for _ in range(120)]
        for j in range(rng.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                w = w[40:] + w[:40]
            texts[f"d{i:03d}{j}"] = " ".join(w)
    return texts


@pytest.mark.parametrize("hot", [nd.HOT, 2])
def test_same_pairs_as_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(nd, "HOT", hot)
    texts = made()
    texts |= {"n0": None, "n1": "", "n2": " \n", "n3": "?!", "s1": "Short", "s2": "short.", "s3": "other", "c1": texts["d0000"].upper(), "c2": texts["d0000"] + "!"}
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], "document_id string, text string, id int, rid string")
    members, links = nd.near_duplicates(df)
    got = {tuple(r) for r in nd.duplicate_pairs(members).collect()}
    assert got == brute(texts, 0.5)
    classes = {r.document_id: r for r in nd.duplicate_classes(members, links).collect()}
    assert classes["s1"].class_document_id == "s1" and classes["s2"].class_document_id == "s1" and "n1" not in classes


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "document_id string, text string")
    assert nd.duplicate_pairs(nd.near_duplicates(empty)[0]).count() == 0
    long = "lorem ipsum dolor sit amet " * 40_000
    df = spark.createDataFrame([("a", long), ("b", long + "x"), ("b", long + "x"), (None, long)], "document_id string, text string")
    assert [tuple(r) for r in nd.duplicate_pairs(nd.near_duplicates(df)[0]).collect()] == [("a", "b")]


def test_links_are_whole_in_full_postings(spark, monkeypatch):
    monkeypatch.setattr(nd, "HOT", 2)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150)]
    texts = {f"d{i:02d}": " ".join([*base[:i], f"changed{i}", *base[i + 1 :]]) for i in range(30)}
    df = spark.createDataFrame([*texts.items()], "document_id string, text string")
    members, links = nd.near_duplicates(df)
    assert {r.document_id: r.n_links for r in nd.duplicate_classes(members, links).collect()} == {k: 29 for k in texts}
    assert links.count() == 30 * 29 // 2
