from __future__ import annotations

import os
import random

import pytest

from tessella.llm import mixing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.vocabulary_path()), reason="no vocabulary files")
TEXTS = ["", " ", "Hello  world's 12,5!\n\n\tx", "日本語テキスト कहानी", "a" * 5000, "<|endoftext|> é é ​😀", "ว" * 3000, "don't WE'LL"]


def test_same_ids_as_another_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    rng = random.Random(1)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), 32, 10])) for _ in range(80)) for _ in range(200)]
    codec = tokens.codec(tokens.vocabulary_path())
    ours = codec.encode(texts)
    assert ours == [other.encode(t, add_special_tokens=False).ids for t in texts]
    assert [codec.decode(x) for x in ours] == texts


def test_frame_edges(spark):
    df = spark.createDataFrame([(1, "Hi", "k"), (2, None, "k"), (3, "", "k"), (1, "Hi", "k"), (None, "Hi", "k")], "doc_id long, text string, ids string")
    got = {(r.doc_id, tuple(r.ids)) for r in tokens.encoded(df).collect()}
    assert got == {(1, (17250,)), (2, ()), (3, ()), (None, (17250,))} and tokens.encoded(df).count() == 5
    assert {r.text for r in tokens.decoded(tokens.encoded(df)).collect()} == {"Hi", ""} and tokens.encoded(df.limit(0)).count() == 0


def test_mixture_meets_budgets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    rng = random.Random(2)
    docs = [(i, " word" * rng.randrange(1, 30), rng.choice(["a", "a", "a", "b", None, "z"])) for i in range(300)] + [(900, None, "a"), (901, "", "b"), (902, " word", "c"), (902, " word", "c")]
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + (t or "").count("word")
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumnRenamed("x", "x")
    mix = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.05, 4), ("d", 0.05, 9)], "source string, target_share double, max_repeat int")
    chosen, plan = mixing.mixed(df, mix)
    report = {r.source: r for r in mixing.shares(chosen, plan).collect()}
    total = sizes["a"] + sizes["b"] + sizes["c"]
    for s, share, repeat in (("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.05, 4)):
        budget = min(round(share * total), repeat * sizes[s])
        assert abs(report[s].actual_tokens - budget) <= 15 and report[s].budget == budget and report[s].most_copies <= repeat
    assert report["d"].actual_tokens == 0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    again = mixing.mixed(df.repartition(13), mix)[0]
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))
    none, plan = mixing.mixed(df.limit(0), mix)
    assert none.count() == 0 and {r.actual_share for r in mixing.shares(none, plan).collect()} == {0.0}
