"""Consistent form and sentence units."""

import unicodedata

import pyarrow as pa
import pytest

from marram.llm import forms, sentences


def form(*texts):
    con = forms.connect()
    con.register("b", pa.table({"i": list(range(len(texts))), "text": pa.array(texts, pa.string())}))
    rows = dict(con.sql(forms.form_sql(keep="i", outs="i, s4")).fetchall())
    return [rows[i] for i in range(len(texts))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("plain text, été! 图书馆，好。", None), ("ｆｕｌｌ ４２", "full 42"), ("a b c　d", "a b c d"), ("ze​ro­", "zero"), ("été", "été"), ("nехt", "next"), ("«СКЛАД 86»", None),
        ("23Η36", "23H36"), ("بین", "بين"), ("کتاب", "كتاب"), ("ﻻ ﺑيت", "لا بيت"), ("ﬁn", "fin"), ("ทำงานที่", None), ("क़लम", "क़लम"), ("tab\tand\nline", None), ("", None),
    ],
)
def test_form(text, want):
    assert form(text) == [text if want is None else want]


def test_form_null_and_order():
    assert form(None, "ａ", "b") == [None, "a", "b"]


def test_letters_and_digits_agree_with_nfkc():
    chars = [chr(o) for o in range(0x80, 0x3000) if unicodedata.category(chr(o))[0] in "LN" and unicodedata.decomposition(chr(o)).startswith(("<wide>", "<font>", "<compat>", "<initial>"))]
    got = form(*[f"q{c}q" for c in chars])
    for c, g in zip(chars, got, strict=True):
        n = unicodedata.normalize("NFKC", c)
        if n != c and n[0] != " " and not 0xE00 <= ord(c) < 0xF00 and not any(0x300 <= ord(x) < 0x590 for x in n):
            assert g in (f"q{n}q", f"q{c}q"), (hex(ord(c)), g)


def test_found(spark):
    reports = spark.createDataFrame([("r1", "ok"), ("r1", "ok"), ("r2", "nеxt"), ("r2", "nеxt"), ("r3", None), (None, "ａ")], "report_id string, raw_text string")
    claims = spark.createDataFrame([("e1", "st​ade"), ("e2", ""), ("e3", None)], "event_id string, location_text string")
    assert sorted(map(tuple, forms.found(reports, claims).collect())) == [("claims", "e1"), ("reports", "r2")]
    assert forms.found(reports.limit(0), claims.limit(0)).count() == 0


def test_consistent_keeps_keys_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "ａ", "x")], "form int, text string, s0 string")
    assert forms.consistent(df, ["form", "s0"], "text").columns == ["form", "s0", "form"]


def parts(text):
    return [text[a:b] for a, b in sentences.units(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. Tan saw it at 9.26! Go e.g. home.", ["Dr. Tan saw it at 9.26!", "Go e.g. home."]),
        ('She told us "The wall moved. Stay away." and left. Next one', ['She told us "The wall moved. Stay away." and left.', "Next one"]),
        ("Il a dit : « Au secours ! Par ici ! » et puis rien ! Fin", ["Il a dit : « Au secours ! Par ici ! » et puis rien !", "Fin"]),
        ("Cf. le point, p. ex. ici. Ils restent.", ["Cf. le point, p. ex. ici.", "Ils restent."]),
        ("墙倒了。17人被困！“有人吗？快来！”，有人喊。", ["墙倒了。", "17人被困！", "“有人吗？快来！”，有人喊。"]),
        ("वह डॉ. से मिला। सब ठीक है!", ["वह डॉ. से मिला।", "सब ठीक है!"]),
        ("ไฟดับตั้งแต่ 17.37 น. ทุกบ้าน ครับ เราผ่านซอย 7 ไม่ได้", ["ไฟดับตั้งแต่ 17.37 น. ทุกบ้าน ครับ", "เราผ่านซอย 7 ไม่ได้"]),
        ("قال د. سعيد «تحرك. ابتعد.» ثم ذهب. جاء", ["قال د. سعيد «تحرك. ابتعد.» ثم ذهب.", "جاء"]),
        ("Place: here / Time: 10:24 / People: 3", ["Place: here", "Time: 10:24", "People: 3"]),
        ("Lieu: gare\nHeure: 22:15\nPersonnes: 60", ["Lieu: gare", "Heure: 22:15", "Personnes: 60"]),
        ("The way is\nblocked by mud. We need\nhelp now.", ["The way is\nblocked by mud.", "We need\nhelp now."]),
        ("First line here\nSecond line here\nThird one", ["First line here", "Second line here", "Third one"]),
        ("URGENT - The path is shut\nSend help", ["URGENT - The path is shut", "Send help"]),
        ("End of it.The next begins", ["End of it.", "The next begins"]),
        ("+++ 12 34 ???", ["+++ 12 34 ???"]), ("   ", []), ("", []), ("?", ["?"]),
    ],
)
def test_units(text, want):
    assert parts(text) == want


def test_units_cover_every_word():
    long = "Word after word goes on. " * 20_000
    spans = sentences.units(long)
    assert len(spans) == 20_000 and all(a < b for a, b in spans)


def test_p1_found(spark):
    df = spark.createDataFrame([("r1", " A b. C d. ", 1), ("r1", " A b. C d. ", 1), ("r2", None, 1), ("r3", "", 2)], "report_id string, raw_text string, start_pos int")
    assert sorted(map(tuple, sentences.found(df).collect())) == [("r1", 2, 5), ("r1", 7, 10)]
    assert [tuple(r) for r in sentences.counts(df).collect()] == [("r1", 2)]


def test_every_text_of_a_repeated_id_counts(spark):
    rows = [("r1", "One here. Two there."), ("r1", "One here. Two there."), ("r1", "A longer beginning of it. End."), ("r2", None)]
    df = spark.createDataFrame(rows, "report_id string, raw_text string")
    assert sorted(map(tuple, sentences.found(df).collect())) == [("r1", 1, 9), ("r1", 1, 25), ("r1", 11, 20), ("r1", 27, 30)]
    assert sorted(map(tuple, sentences.counts(df).collect())) == [("r1", 2)]


def test_each_language_has_its_own_table():
    assert parts("The men saw the ud. We left the place.") == ["The men saw the ud.", "We left the place."]  # an abbreviation of another language
    assert parts("Quedan 3 ud. de agua en la calle.") == ["Quedan 3 ud. de agua en la calle."]
    assert parts("Il y a du monde bd. Kel. The gate is shut by Mr. Lo.") == ["Il y a du monde bd. Kel.", "The gate is shut by Mr. Lo."]
    assert sentences.shown("the gate is shut, la porte est là") == ("en", "fr") and sentences.shown("xyz") == ("en", "fr", "es")
    assert sentences.cascade("arabic", ("en",), False)[-1] == sentences.COMMON[-1]


def test_script_is_looked_for_however_far_back():
    gap = " 12" * 60
    assert parts(f"水位上涨{gap}。好。") == [f"水位上涨{gap}。", "好。"]
    assert parts("جاء د" + " " * 50 + ". ثم") == parts("جاء د" + " " * 50 + ". ثم")
    long = "word " * 40_000
    assert parts(f"{long}end. Next one.")[-1] == "Next one." and len(parts(f"{long}end. Next one.")) == 2
