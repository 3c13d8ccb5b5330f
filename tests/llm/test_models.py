"""Places, languages, leaks, mixing and levels on small fixtures."""

import random

import numpy as np
import pytest

from marram.llm import languages, leaks, levels, mixing, places

GAZETTEER = [
    ("P1", "Kelghadou clinic", "en", "clinic"), ("P1", "dispensaire Kelghadou", "fr", "clinic"), ("P1", "عيادة كلغادو", "ar", "clinic"), ("P1", "克嘎杜诊所", "zh", "clinic"),
    ("P2", "Mizrifjas clinic", "en", "clinic"), ("P2", "dispensaire Mizrifjas", "fr", "clinic"), ("P2", "عيادة ميزرفجس", "ar", "clinic"), ("P2", "米里贾诊所", "zh", "clinic"),
    ("P3", "Kelghadou bridge", "en", "bridge"), ("P3", "pont Kelghadou", "fr", "bridge"), ("P3", "جسر كلغادو", "ar", "bridge"), ("P3", "克嘎杜大桥", "zh", "bridge"),
    ("P4", "Tisorta bridge", "en", "bridge"), ("P4", "pont Tisorta", "fr", "bridge"), ("P4", "جسر تيسورتا", "ar", "bridge"), ("P4", "蒂索塔大桥", "zh", "bridge"),
    ("P5", "Tisorta market", "en", "market"), ("P5", "marché Tisorta", "fr", "market"), ("P5", "سوق تيسورتا", "ar", "market"), ("P5", "蒂索塔市场", "zh", "market"),
    ("P6", "Mizrifjas market", "en", "market"), ("P6", "marché Mizrifjas", "fr", "market"), ("P6", "سوق ميزرفجس", "ar", "market"), ("P6", "米里贾市场", "zh", "market"),
]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("KELGHADOU  CLINIC", "P1"), ("the Kelgahdou clinic (north side)", "P1"), ("Kelghadou, dispensaire", "P1"), ("disp. Kelghadou", "P1"), ("pont_Kelgadou", "P3"), ("near Tisorta br.", "P4"), ("Tisorta mkt", "P5"),
        ("Tisorta hospital", "NONE"), ("garage Kelghadou", "NONE"), ("Kelghadou bakery, east gate", "NONE"), ("here", "NONE"), ("Tisornam bridge", "NONE"), ("العيادة كلغاادو", "P1"), ("靠近克嘎杜大桥", "P3"), ("克嘎杜面包店", "NONE"), ("marche tisorta ?", "P5"),
    ],
)
def test_places(value, want):
    assert places.Gazetteer(GAZETTEER).resolve(value) == want


def test_places_found(spark):
    gaz = spark.createDataFrame([(*g, g[2] == "en") for g in GAZETTEER], "group_id string, name string, language string, kind string, preferred boolean")
    claims = spark.createDataFrame([("e1", "Kelghadou clinic"), ("e2", "kelghadou clinic"), ("e2", "kelghadou clinic"), ("e3", None), ("e4", " "), ("e5", "x" * 5000), (None, "pont Tisorta !")], "event_id string, location_text string")
    ents = spark.createDataFrame([("n1", "pont-Tisorta", "place"), ("n2", "pont-Tisorta", "organisation"), ("n3", None, "place")], "entity_id string, name string, entity_type string")
    got = sorted(map(tuple, places.found(claims, ents, gaz).collect()))
    assert got == [("claims", "e2", "P1"), ("claims", "e5", "NONE"), ("entities", "n1", "P4")]
    assert sorted(map(tuple, places.resolved(claims, gaz).collect())) == [("e1", "P1", "Kelghadou clinic"), ("e2", "P1", "Kelghadou clinic"), ("e5", "NONE", None)]
    assert places.found(claims.limit(0), ents.limit(0), gaz).count() == 0
    assert {r.group_id for r in places.found(claims, ents, gaz.limit(0)).collect()} == {"NONE"}


def test_places_behind_many_likelier_names():
    decoys = [(f"{k}{i}{j}", f"{name} bridge", "en", "bridge") for i in "aeiou" for j in "bdfglmnp" for k, name in (("A", f"Tizorta{i}{j}"), ("B", f"{i}{j}tizorta"))]
    assert places.Gazetteer([*decoys, ("T", "Tisorta bridge", "en", "bridge")]).resolve("Tizorta bridge") == "T"


def test_places_margin_is_a_difference(monkeypatch):
    g = places.Gazetteer([("A", "Kelmira bridge", "en", "bridge"), ("B", "Kelvira bridge", "en", "bridge"), ("C", "Tisorta bridge", "en", "bridge")])
    monkeypatch.setattr(places.Gazetteer, "candidates", lambda self, s, token: [("kelmira", 0.6005), ("kelvira", 0.5995)] if s == "latin" else [])  # across a rounding step
    assert g.resolve("Keltira bridge") == "NONE"


def test_places_one_error_in_scripts_without_spaces():
    g = places.Gazetteer([("A", "清河医院", "zh", "h"), ("B", "安宁医院", "zh", "h"), ("C", "清河学校", "zh", "s"), ("D", "安宁学校", "zh", "s"), ("E", "โรงเรียนเกลกาดู", "th", "s"), ("F", "โรงเรียนนีเซมริฟ", "th", "s")])
    assert [g.resolve(v) for v in ("青河医院", "靠近清河学校", "青河大桥", "安宁医院旁边的学校", "โรงเรียนเกลกดู", "หน้าโรงเรียนนีเซมริฟ", "โรงเรียนกาโกดตี")] == ["A", "C", "NONE", "B", "E", "F", "NONE"]


def test_places_index_equals_brute_force():
    import math

    r = random.Random(3)
    names = sorted({"".join(r.choice(["kel", "miz", "sor", "ta", "dou", "rif", "na"]) for _ in range(3)) for _ in range(80)})
    index = places.Index(names, False)
    held = {n: places._grams(n, index.sizes) for n in names}
    weight = lambda g: math.log(1 + len(names) / max(1, sum(g in h for h in held.values()))) ** 2
    norm = lambda grams: math.sqrt(sum(map(weight, grams)))
    for token in [*names[:5], "kelmizz", "xxxx", "tadouri"]:
        mine = places._grams(token, index.sizes)
        want = {n: sum(map(weight, mine & h)) / norm(mine) / norm(h) for n, h in held.items()}
        assert dict(index.near([token])[0]) == pytest.approx({n: c for n, c in want.items() if c >= index.threshold and c > 0})


def test_places_every_name_calibrates_the_threshold():
    r = random.Random(1)
    names = sorted({"".join(r.choice(["kel", "miz", "sor", "dou", "rif", "che", "lin"]) for _ in range(6)) for _ in range(1200)})
    names.insert(1, "lin")  # the shortest name is the least like its variants
    index = places.Index(names, False)
    asked = list(places._variants("lin"))
    assert len(names) > 1000 and all("lin" in dict(near) for near in index.near(asked))


SENTENCES = {
    "en": ["The water rose {n} m near {p} lane and reached the yard.", "Please send help to {p} Road now.", "Nobody has answered the phone since {n}:10."],
    "fr": ["L'eau est montée de {n} m près de rue {p}.", "Envoyez vite des secours à {p}, merci.", "Personne ne répond au téléphone depuis {n}h10."],
    "es": ["El agua subió {n} m junto a calle {p}.", "Manden ayuda a {p} por favor.", "Nadie contesta el teléfono desde las {n}:10."],
}


def labelled(n, seed):
    r = random.Random(seed)
    name = lambda: "".join(r.choice(["kel", "miz", "sor", "ta", "dou", "rif"]) for _ in range(3)).capitalize()
    return [(lang, " ".join(r.choice(SENTENCES[lang]).format(n=r.randint(1, 99), p=name()) for _ in range(3))) for _ in range(n) for lang in SENTENCES]


def test_language_heldout_accuracy():
    rows = labelled(60, 1)
    rows = [(("es" if i % 17 == 0 else lang), t) for i, (lang, t) in enumerate(rows)]  # some labels are wrong
    net = languages.fit(rows)
    test = labelled(30, 2)
    kind, sure = net.classify([t for _, t in test])
    assert np.mean([net.classes[k] == lang for k, (lang, _) in zip(kind, test, strict=True)]) > 0.97
    assert (sure > 0.3).all()


def test_language_found(spark):
    rows = [(f"r{i}", lang, t) for i, (lang, t) in enumerate(labelled(60, 3))]
    rows += [("x1", None, rows[0][2]), ("x2", "fr-FR", rows[0][2]), ("x3", "eng", rows[0][2]), ("x4", "en", f"{SENTENCES['en'][0]} {SENTENCES['fr'][0]}".format(n=3, p="Kel")), ("x5", "??", "12 -- 34"), ("x6", "en", None)]
    got = sorted(map(tuple, languages.found(spark.createDataFrame(rows, "report_id string, source_language string, raw_text string")).collect()))
    assert got == [("x1", "en"), ("x2", "en"), ("x4", "en"), ("x4", "fr")]


def test_each_text_of_a_repeated_id_keeps_its_own_label(spark):
    rows = [(f"r{i}", lang, t) for i, (lang, t) in enumerate(labelled(60, 3))]
    en, fr = (SENTENCES[k][0].format(n=3, p="Kel") for k in ("en", "fr"))
    rows += [("y1", "fr", fr), ("y1", "en", en), ("y1", "en", en), ("y2", "fr", en), ("y2", "fr", fr), ("y3", "en", f"{en} {fr}")]
    df = spark.createDataFrame(rows, "report_id string, source_language string, raw_text string")
    assert sorted(map(tuple, languages.found(df).collect())) == [("y2", "en"), ("y3", "en"), ("y3", "fr")]
    assert [(x.part, x.language) for x in languages.settled(df).where("report_id = 'y3'").orderBy("part").collect()] == [(0, "en"), (1, "fr")]


def test_language_windows_cover_the_text():
    texts = ["a" * 200, "b", "", "é" * 70]
    x, owner = languages.windows(texts)
    for i, t in enumerate(texts):
        rows = x[owner == i]
        assert len(rows) == max(1, -(-len(t.encode()) // languages.WINDOW))
    assert languages.canonical(" FR_fr") == "fr" and languages.canonical("ary") == "dar" and languages.canonical("n/a") is None


def brute_share(text, item):
    """Share of the item's words in common runs of at least SEED words."""
    a, b = leaks.words(text), leaks.words(item)
    mark = [False] * len(b)
    for i in range(len(b)):
        for j in range(len(a)):
            n = 0
            while i + n < len(b) and j + n < len(a) and a[j + n] == b[i + n]:
                n += 1
            if n >= leaks.SEED:
                mark[i : i + n] = [True] * n
    return sum(mark) / max(1, len(b))


def test_leaks_match_brute_force():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(40))) for i in range(12)]
    docs = []
    for k in range(60):
        w = [r.choice(vocab) for _ in range(60)]
        src = items[k % 12][1].split()
        a = r.randint(0, 25)
        w[20:20] = src[a : a + r.randint(3, 40)]
        docs.append(" ".join(w))
    tests = leaks.Items(items)
    got = tests.matches([None, *docs, ""])
    for d, doc in enumerate(docs, 1):
        for i, (_, item) in enumerate(items):
            share = tests.covered(i, got[d, i])[0] / 40 if (d, i) in got else 0
            exact = brute_share(doc, item)
            assert share >= exact - 1e-9 and (share == pytest.approx(exact) or share - exact <= 2 * leaks.GAP / 40)


def test_leaks_found(spark):
    item = "Gate 43 of the old stadium stays shut until 15:31 says volunteer group Miz from block 672 of Kel near the river bank tonight"
    typo = item.replace("stadium", "stadum").replace("volunteer", "volunter").upper().replace(" ", "  ")
    docs = [(1, f"News. {item}. More"), (2, "Nothing here"), (3, typo), (4, " ".join(item.split()[:8])), (5, None), (6, ""), (1, f"News. {item}. More")]
    ordinary = spark.createDataFrame([("near the river bank tonight we sleep",)], "raw_text string")
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")
    assert sorted(map(tuple, leaks.found(d, i, ordinary).collect())) == [(1, 7), (3, 7)]
    assert sorted(r.doc_id for r in leaks.clean(d, i, ordinary).collect()) == [2, 4, 5, 6]
    assert leaks.found(d, i.limit(0), ordinary).count() == 0


def test_leaks_of_equal_items_and_items_that_a_report_quotes(spark):
    r = random.Random(9)
    vocab = [f"v{i}" for i in range(300)]
    one, two = (" ".join(r.choice(vocab) for _ in range(30)) for _ in range(2))
    d = spark.createDataFrame([(1, f"before {one} after"), (2, two), (3, "v1 v2 v3")], "doc_id long, text string")
    i = spark.createDataFrame([(5, one), (6, one.upper()), (7, two)], "item_id long, text string")
    shared = " ".join(two.split()[:6])
    ordinary = spark.createDataFrame([(f"they say {two} again",), (f"they say {two} once more",), (f"now {shared} x",), (f"then {shared} y",)], "raw_text string")
    assert sorted(map(tuple, leaks.found(d, i, ordinary).collect())) == [(1, 5), (1, 6), (2, 7)]
    part = spark.createDataFrame([(4, f"{shared} z")], "doc_id long, text string")
    assert leaks.every(part, i, ordinary).count() == 0  # phrasing that several reports use
    rows = leaks.every(spark.createDataFrame([(8, f"a b {' '.join(one.split()[3:12])} c")], "doc_id long, text string"), i, ordinary).collect()
    assert sorted((x.item_id, x.words, x.longest, x.word_at) for x in rows) == [(5, 9, 9, 2), (6, 9, 9, 2)]


def test_suffixes_sort_by_words():
    run = np.array([5, 1, 300, 2, 5, 1, 299, 0], np.int32)
    got = leaks.Items.suffixes(run, np.arange(8))
    assert sorted(range(8), key=lambda k: run[k:].tolist() + [0] * 40) == np.argsort(got, kind="stable").tolist()


def test_flow_is_cheapest_and_shares_are_reached():
    given = mixing.plan({("a",): 100, ("b",): 100, ("a", "b"): 50}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3})
    per = {s: sum(n for (_, x), n in given.items() if x == s) for s in "ab"}
    assert abs(per["a"] - per["b"]) <= 1 and per["a"] == 150
    assert sum(n for (p, _), n in given.items() if p == ("a", "b")) <= 50


def test_mix(spark):
    r = random.Random(2)
    rows = [(i, "big" if i % 5 else "small", f"text number {i} " + "word " * r.randint(5, 30)) for i in range(400)] + [(900, None, "no source"), (901, "big", None), (902, "other", "not wanted")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3)], "source string, target_share double, max_repeats int")
    out = {x.source: x for x in mixing.mix(docs, targets).collect()}
    assert abs(out["big"].actual_share - 0.6) < 0.01 and out["big"].repeats_used == 1 and 1 < out["small"].repeats_used <= 3
    one, two = (sorted(map(tuple, mixing.select(docs, targets).collect())) for _ in range(2))
    assert one == two


def test_more_patterns_than_the_flow_holds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 3)
    rows, n = [], 0
    for i in range(300):
        for s in {f"s{i % 5}", f"s{(i * 7 + i // 5) % 5}"}:
            n += 1
            rows.append((n, s, f"shared text number {i} with some words in it"))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([(f"s{k}", 0.2, 1 + k % 2) for k in range(5)], "source string, target_share double, max_repeats int")
    chosen = mixing.select(docs, targets).collect()
    held = {}
    for d, s, t in rows:
        held.setdefault(t, set()).add(s)
    text = {d: t for d, _, t in rows}
    uses = {}
    for r in chosen:
        assert r.source in held[text[r.doc_id]]
        uses[text[r.doc_id]] = uses.get(text[r.doc_id], 0) + r.uses
    assert all(n <= min(1 + int(s[1]) % 2 for s in held[t]) for t, n in uses.items())
    shares = [x.actual_share for x in mixing.mix(docs, targets).collect()]
    assert all(abs(x - 0.2) < 0.03 for x in shares)


def test_many_patterns_are_planned_like_few(spark, monkeypatch):
    shared = ["abc", "bcd", "cda", "ab", "bc", "cd", "da", "a", "b", "c", "d"]
    docs = spark.createDataFrame([(10 * i + k, s, f"text number {i} with some words in it") for i in range(200) for k, s in enumerate(shared[i % 11])], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.55, 3), ("b", 0.25, 1), ("c", 0.1, 2), ("d", 0.1, 1)], "source string, target_share double, max_repeats int")
    whole = sorted(mixing.select(docs, targets).collect())
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    assert sorted(mixing.select(docs, targets).collect()) == whole


def test_levels(spark):
    r = random.Random(1)
    easy, news, hard = "dog ran mud cold bread cat sun big red home".split(), "council repaired damaged bridges announced shelters residents weekend district officials".split(), "heteroscedasticity epistemological jurisprudential commensurability instrumentation extrapolation promulgation circumspection asymmetry substrata".split()
    make = lambda v, n: " ".join(" ".join(["the", "of", *(r.choice(v) for _ in range(n))]) + "." for _ in range(14))
    rows = [(i, make((easy, news, hard)[i % 3], (5, 12, 18)[i % 3]), "en") for i in range(150)]
    rows.append((500, make(easy, 5) + " " + make(hard, 18)[:200], "fr"))
    docs = spark.createDataFrame([*rows, (600, None, "en"), (601, "", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, "x", i % 3 + 1) for i in range(60)] + [(3, "y", 3), (None, "y", 2)], "doc_id long, rater string, level int")
    got = {x.doc_id: x.level for x in levels.found(docs, labels).collect()}
    assert [got[i] for i in range(150)] == [i % 3 + 1 for i in range(150)] and got[500] == 1 and got[600] == 1 and len(got) == 153
    assert levels.found(docs.limit(0), labels).count() == 0
