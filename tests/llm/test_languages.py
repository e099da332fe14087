from __future__ import annotations

import random

from tessella.llm import languages as L

WORDS = {
    "en": "the of and to in is that for it was on are with they have this from had not but".split(),
    "de": "der die und das nicht mit auf ist ein eine dem den von zu sich auch als nach wie über".split(),
    "fr": "le la les des et dans une pour que qui sur pas avec ce sont il est du au plus".split(),
}


def sentence(lang, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(14)).capitalize() + "."


def test_held_out_accuracy_with_wrong_labels():
    rng = random.Random(3)
    samples = {x: [[sentence(x if rng.random() > 0.15 else rng.choice([*WORDS]), rng) for _ in range(4)] for _ in range(60)] for x in WORDS}
    model = L.Identifier(samples, {x: "Latn" for x in WORDS} | {"th": "Thai"})
    truth = [rng.choice([*WORDS]) for _ in range(200)]
    found = model.pieces([sentence(x, rng) for x in truth])
    assert sum(max(s, key=s.get) == x for x, (_, s, _) in zip(truth, found)) >= 196
    assert model.pieces(["เขาไปบ้าน", "123 !"])[0][1] == {"th": 0.0}
    assert model.held > 100 and model.accuracy > 0.8 and sum(n for _, _, n in model.reliability) == model.held  # a text of the sample holds sentences of other languages
    script, scores, n = model.pieces(["zxqj vkwq jjxz qqqq wxyz kkvq zzzz xxqj"])[0]
    best = max(scores, key=scores.get)
    assert model.rejected(script, best, scores[best], n) and model.refused == {0}


def test_scripts():
    assert L.script_of("Trove-29的重量约为60吨") == "Han" and L.script_of("Zanoha工場の生産は") == "Kana" and L.script_of("Hello 123") == "Latn"


def test_stretches_change_once_and_ignore_noise():
    a, b = ("Latn", {"en": -10.0, "de": -60.0}, 30), ("Latn", {"en": -60.0, "de": -10.0}, 30)
    bare = ("Latn", {"en": -1.0, "de": -1.5}, 2)
    spans = [(0, 5)] * 5
    assert [x[:3] for x in L.stretches(spans, [a, bare, a, b, ("", {}, 0)])] == [(0, 2, "en"), (3, 4, "de")]
    assert L.stretches([(0, 1)], [("", {}, 0)]) == []


def test_frame_edges(spark):
    rng = random.Random(5)
    reference = spark.createDataFrame([("en", "eng", "Latn"), ("de", "deu", "Latn"), ("th", "tha", "Thai")], "code string, code3 string, script string")
    body = [(f"{x}{i}", " ".join(sentence(x, rng) for _ in range(4)), "deu" if x == "de" else "en-GB", "z") for x in ("en", "de") for i in range(30)]
    mixed = " ".join(sentence("en", rng) for _ in range(4)) + "\n\n" + " ".join(sentence("de", rng) for _ in range(3))
    df = spark.createDataFrame([*body, ("m", mixed, "en", "z"), ("w", body[0][1], "und", "z"), ("x", None, None, "z"), ("y", "", "en", "z"), ("q", "??", None, "z")], "document_id string, text string, language string, main string")
    cut = L.segmented(df, reference)
    asked = {(r.document_id, r.start_c, r.language) for r in L.questionable(cut).collect()}
    assert asked == {("m", 0, "en"), ("m", mixed.index("\n\n") + 2, "de"), ("w", 0, "en")}
    assert all(0 <= r.confidence <= 1 for r in cut.collect())
    assert L.segmented(df.limit(0), reference).count() == 0
