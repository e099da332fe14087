from __future__ import annotations

import itertools

import pytest

from tessella.llm import personal as P
from tessella.llm.surrogates import Surrogates

GIVEN = {"Elizabeth": "f", "Walter": "m", "Ursula": "f"}
KNOWN = P.Known(GIVEN, endings=frozenset(["Optics"]), common=frozenset(["Contact"]))

CASES = [
    ("Write to Elizabeth M. Padun at e.padun+x@mail.example.", [("Elizabeth M. Padun", "person_name"), ("e.padun+x@mail.example", "email")]),
    ("Mail padun7 at nobi dot mail dot example or p_x [at] nobi.test today.", [("padun7 at nobi dot mail dot example", "email"), ("p_x [at] nobi.test", "email")]),
    ("Ring +999 69 929 4868, (372) 555 0108 or 0221-431 95 83.", [("+999 69 929 4868", "phone"), ("(372) 555 0108", "phone"), ("0221-431 95 83", "phone")]),
    ("电话: ＋９９９－１７－９６８５５１８", [("＋９９９－１７－９６８５５１８", "phone")]),
    ("Her passport 962-36-0352 and invoice 972-95-5770 of contract XK5004262; PAN ZZZPB2430Z", [("962-36-0352", "id_number"), ("ZZZPB2430Z", "id_number")]),
    ("Send it to Flat 32B, 231 Fizibir Close, Upper Najos ZX7 7QP.", [("Flat 32B, 231 Fizibir Close, Upper Najos ZX7 7QP", "address")]),
    ("Adresse: 93 bis, rue Sajavi, 00445 Godrek", [("93 bis, rue Sajavi, 00445 Godrek", "address")]),
    ("Анна: ул. Дратрифал, д. 161, кв. 72", [("ул. Дратрифал, д. 161, кв. 72", "address")]),
    ("Contact: PADUN, Walter | P.O. Box 12, Lifo", [("PADUN, Walter", "person_name"), ("P.O. Box 12, Lifo", "address")]),
    ("Dr. Ursula Padun spoke. Padun’s firm Padun & Sons and Lifo Optics did not.", [("Ursula Padun", "person_name"), ("Padun", "person_name")]),
    ("SSN 123-45-6789; account DE89 3704 0044 0532 0130 00, card 4111 1111 1111 1111, not 4111 1111 1111 1112.", [("123-45-6789", "id_number"), ("DE89 3704 0044 0532 0130 00", "id_number"), ("4111 1111 1111 1111", "id_number")]),
    ("Dr. Amina Okafor came; later Okafor left.", [("Amina Okafor", "person_name"), ("Okafor", "person_name")]),
    ("Coordinates 41.09, 29.112; firmware 10.2.0.14 fixes ticket 7962-61-5936; see www.x.example/1.", []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_cases(text, want):
    assert [(text[a:e], k) for a, e, k in P.find(text, KNOWN)] == want


def test_spans_never_overlap():
    text = " ".join(t for t, _ in CASES)
    spans = P.find(text, KNOWN)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert P.find(None, KNOWN) == P.find("", KNOWN) == []


def test_surrogates_keep_form_and_reference():
    s = Surrogates(b"k", KNOWN.given)
    text = "Elizabeth Padun met WALTER PADUN; Padun's number is +999 69 929 4868, passport ZX5500387."
    spans = P.find(text, KNOWN)
    new = s.rewrite(text, spans)
    again = Surrogates(b"k", KNOWN.given).rewrite(text, spans)
    assert new == again and new != Surrogates(b"other", KNOWN.given).rewrite(text, spans)
    assert "Padun" not in new and "+999 " in new and "929 4868" not in new and new.endswith(".") and " met " in new
    first, rest = new.split(" met ")
    family = first.split(" ")[1]
    assert first.split(" ")[0].endswith("a") and rest.split(" ")[0].endswith("O") and f"{family}'s number" in new and family.upper() in rest
    assert s.word("Падун") != "Падун" and P.fold(s.word("Падун"))[0] != "П"


def test_surrogates_are_one_to_one():
    s = Surrogates(b"k", KNOWN.given)
    words = {"".join(x) for x in itertools.product("bdfgklmnprst", "aeiou", "bdfgklmnprst", "aeiou", "lmnrs")}  # all words of a pattern
    words |= {w + "s" for w in [*words][:20_000]} | {w[:3] for w in words}
    assert len({s.word(w) for w in words}) == len(words)
    phones = {f"+44 20 {i:04d} {j:04d}" for i in range(0, 10_000, 100) for j in range(0, 10_000, 10)}
    assert len(phones) == 100_000
    new = {s.replace(p, "phone") for p in phones}
    assert len(new) == len(phones) and all(n.startswith("+44 ") and len(n) == 16 for n in new) and not new & {"+44 20 0000 0000"}
    assert all(s.number(n, 1000, "x") != n for n in range(1000)) and len({s.number(n, 1000, "x") for n in range(1000)}) == 1000
    for value, kind, rule in (("DE89 3704 0044 0532 0130 00", "id_number", P.iban), ("4111 1111 1111 1111", "id_number", lambda t: P.luhn(t.replace(" ", "")))):
        assert s.replace(value, kind) != value and rule(s.replace(value, kind))
    mail = s.replace("jane.padun@padun.example", "email")
    assert mail.endswith(".example") and mail.count(s.word("padun")) == 2 and "padun" not in mail
    assert s.word("ทดสอบ") != "ทดสอบ" and s.word("東京") != "東京" and len(s.word("東京")) == 2
    with pytest.raises(ValueError):
        Surrogates(b"")


def test_frame_edges(spark, monkeypatch):
    monkeypatch.setattr(P, "given_names", lambda texts, total: GIVEN)
    df = spark.createDataFrame([(1, CASES[0][0], "x"), (2, None, "x"), (3, "", "x"), (1, CASES[0][0], "x"), (4, "no one " * 50_000, "x")], "doc_id long, text string, kind string")
    got = sorted((r.doc_id, r.kind) for r in P.located(df, known=KNOWN).collect())
    assert got == [(1, "email"), (1, "email"), (1, "person_name"), (1, "person_name")]
    shown = {r.doc_id: r.text for r in P.rewritten(df, {"email": "[EMAIL]", "person_name": "[NAME]"}).collect()}
    assert shown[1] == "Write to [NAME] at [EMAIL]." and shown[2] is None and shown[3] == ""
    assert {r.doc_id: r.n_found for r in P.rewritten(df, key=b"k").collect()} == {1: 2, 2: 0, 3: 0, 4: 0}
    with pytest.raises(ValueError):
        P.rewritten(df)
    assert P.located(df.limit(0)).count() == 0


def test_given_names_are_learned(spark):
    """Names that no list holds, behind titles; a name before one family name only, and firms, are not taken for given names."""
    families = ["".join(c).capitalize() + "nu" for c in itertools.product("bdfgk", "aeiou", "lmnrs", "aeiou")]
    texts = [f"Report {i}. Dr. {g} {families[i]} spoke of Bakor Dragic Works. Later {families[i]} left." for i, g in enumerate(["Hiroshi", "Amina", "Kwame", "Fatima Zahra"] * 10)]
    texts += [f"Then Hiroshi {families[100 + i]} and KWAME {families[200 + i].upper()} met." for i in range(20)] + [f"Mr. Lone Family met {i} people." for i in range(9)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")
    known = P.fit(df)
    assert {"hiroshi", "amina", "kvame", "fatima", "zahra"} <= {*known.given} and "lone" not in known.given and "bakor" not in known.given
    got = P.located(df, known=known).toPandas()
    found = {texts[i][a:e] for i, a, e in got[["doc_id", "start_c", "end_c"]].values}
    assert {f"Hiroshi {families[100 + i]}" for i in range(20)} | {f"KWAME {families[200 + i].upper()}" for i in range(20)} <= found
    assert f"Fatima Zahra {families[3]}" in found and not any("Bakor" in f for f in found)


def test_family_name_of_a_full_form_is_found_however_often_it_stands(spark, monkeypatch):
    monkeypatch.setattr(P, "given_names", lambda texts, total: GIVEN)
    texts = [f"Report {i}. Elizabeth Padun spoke in town. Later that day Padun left." for i in range(60)]
    copies = ["Walter Bakonu came. Then Bakonu went."] * 60
    df = spark.createDataFrame([*enumerate(texts + copies)], "doc_id int, text string")
    known = P.fit(df)
    assert "Report" in known.common and "Padun" not in known.common and "Then" not in known.common
    assert P.located(df, known=known).count() == 240
    assert P.find(texts[0], P.Known(GIVEN, common=frozenset(["Padun"]))) == P.find(texts[0], P.Known(GIVEN))


def test_surroundings_are_counted_over_all_distinct_texts(spark, monkeypatch):
    monkeypatch.setattr(P, "HELD", 50)
    monkeypatch.setattr(P, "given_names", lambda texts, total: GIVEN)
    names = ["".join(c) for c in itertools.product("bdfgk", "aeiou", "lmnrs", "aeiou")]
    texts = [f"Item {i}. The report was signed by Elizabeth {names[i % 600].capitalize()}nu on day {i}." for i in range(4)]
    filler = [f"item {i} has nothing." for i in range(40_000)]
    df = spark.createDataFrame([*enumerate(texts + filler + [texts[0]] * 50)], "doc_id int, text string")
    assert "lgned by " in P.fit(df).around
    other = spark.createDataFrame([*enumerate(texts[:3] + filler + [texts[0]] * 50)], "doc_id int, text string")
    assert "lgned by " not in P.fit(other).around


def test_text_of_capitals_with_small_letters_at_its_start():
    text = "mail ab@nobi.example\n" + "THE REPORT WENT ROUND AND STAYED THERE. " * 5 + "IT WAS SIGNED BY J. LOMADUN TODAY."
    found = [text[a:e] for a, e, k in P.find(text, P.Known(around={"lgned by ": 2.0})) if k == "person_name"]
    assert found == ["J. LOMADUN"]


def test_titles_before_names():
    """Titles with the names behind them, as they are told from words, other scripts and long names."""
    from tessella.llm.personal import titled

    long = "A" + "b" * 300
    assert titled("Mr. Jan McDonald-Smith met XMr Jan Bo, Mrs\xa0Éva O’Hara Bö. Dr Who") == [("Mr", ["Jan", "McDonald-Smith"]), ("Mrs", ["Éva", "O’Hara", "Bö"])]
    assert titled(f"Инженер Иван Петров; Dr. {long} Bo. Mr. Jan") == [("Инженер", ["Иван", "Петров"]), ("Dr", [long, "Bo"])]
    assert titled("") == titled("Mr.") == titled("mr. Jan Bo") == []
