from __future__ import annotations

import time

import pytest

from tessella.llm.sentences import Words, opening_words, sentences, split

OPEN = {w: 1.0 for w in "The Die Am Nobody Trials He Er Il La Los See".split()}
CASES = [
    (["Dr. A. Weber met Mr. Li at 4 p.m. on Monday.", "He left."], " "),
    (["The stake is 6.5 percent of Lor Ltd.", "The rest follows."], " "),
    (["Die Teile, z. B. Achsen, wiegen ca. 4,5 t.", "Am 2. und 3. Tag fiel er aus."], " "),
    (["She was blunt: “No. We wait. We see.”", "The board agreed."], " "),
    (["“We wait! We see.” said Ann Lee.", "See p. 4 of it."], " "),
    (["题为《一年。》的报告由他发布。", "“真的吗？不知道。”李这样说道。", "他走了！"], ""),
    (["「行く。見る。」と彼は述べた。", "冊子『なぜ？』は本だ。"], ""),
    (["क्या वह आया?", "वह घर गया।", "काम पूरा हुआ |"], " "),
    (["متى يصل؟", "لم يصل بعد."], " "),
    (["เขาไปบ้าน", "เธออยู่ที่นี่"], " "),
    (["A heading on its own line", "The text follows here."], "\n\n"),
    (["1. First item here", "2. Second item here"], "\n"),
    (["(The rest was not shown.)", "Nobody came."], " "),
]


@pytest.mark.parametrize("parts, gap", CASES)
def test_cases(parts, gap):
    text = gap.join(parts)
    assert [text[a:e] for a, e in sentences(text, OPEN)] == parts


def test_wrapped_lines_stay_together():
    text = "The ministry wants more of the new vehicles and so far it has paid\nfor all of those that were delivered in the first half of the year\nunder the plan. He left."
    assert [text[a:e] for a, e in sentences(text, OPEN)] == [text[: text.index(" He left")], "He left."]


def test_no_letter_is_lost_or_taken_twice():
    text = " \r\n“Open (quote. Mr. B! Ü… c?? \n\n- x\n- y 。。 z end"
    spans = sentences(text, {})
    assert all(a < e for a, e in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    left = set(range(len(text))) - {i for a, e in spans for i in range(a, e)}
    assert all(text[i].isspace() for i in left)


def test_frame_edges(spark):
    df = spark.createDataFrame([("a", "One. Two.", 1), ("b", None, 2), ("c", "", 3), ("d", "  ", 4), ("a", "One. Two.", 1), (None, "x", 5), ("e", "word. " * 30_000, 6)], "document_id string, text string, start_c int")
    got = split(df).collect()
    assert sorted((r.document_id, r.start_c) for r in got if r.document_id == "a") == [("a", 0), ("a", 0), ("a", 5), ("a", 5)]
    assert not {r.document_id for r in got} & {"b", "c", "d"} and split(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["He said “we go (now. Then) later. But no.” Then A. Li left [see p. 3]. ", "We go (now. Then) later. But no. "])
def test_a_megabyte_in_one_block(unit):
    body = unit * (1_000_000 // len(unit))
    text = body if "“" in unit else f"“{body}” he said."
    began = time.time()
    spans = sentences(text, OPEN)
    assert time.time() - began < 15  # about 3 s; all pairs of places took hours
    assert len(spans) > 10_000 if "“" in unit else spans == [(0, len(text))]


def test_long_spans_are_considered():
    """A quotation is one sentence however long it is."""
    text = "He left. “" + "We stay here. " * 2000 + "Why?” asked Ann. She left."
    assert [text[a:e][-9:] for a, e in sentences(text, OPEN)] == ["He left.", "sked Ann.", "She left."]


def test_abbreviations_are_learned(spark):
    """An abbreviation that no list holds is learned from how it stands; a word that ends sentences is not taken for one."""
    texts = [f"We met Adv. Khan{i} at noon. The trial of Abschn. {i} went on.\n\nThey paid {i} coins. She said at noon that it was over." for i in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    words = opening_words(df, listed=False)
    assert {"adv", "abschn"} <= words.never and not {"over", "noon", "coins"} & words.never
    cut = [texts[0][a:e] for a, e in sentences(texts[0], words)]
    assert cut[:2] == ["We met Adv. Khan0 at noon.", "The trial of Abschn. 0 went on."]
    assert opening_words(df.limit(0)) == {} and "dr" in Words({}).never
