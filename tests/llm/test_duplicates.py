"""Format duplicates and near-duplicates against brute force."""

import random

from marram.llm import duplicates as D
from marram.llm import near as N


def brute(texts, link):
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i in ids:
        for j in ids:
            if i < j and link(texts[i], texts[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((find(i), i) for i in ids if find(i) != i)


def corpus(n=60, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))
    out = {}
    for i in range(n):
        text = [[word() for _ in range(r.randint(6, 10))] for _ in range(3)]
        out[f"R{i:03d}a"] = " ".join(" ".join(s).capitalize() + "." for s in text)
        for k in range(r.randint(0, 4)):
            edited = [w if r.random() > 0.06 else word() for s in text for w in s]
            out[f"R{i:03d}b{k}"] = " ".join(edited)
    return out


def test_near_equals_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "report_id string, raw_text string")
    got = sorted(map(tuple, N.near_found(df).collect()))
    norm = lambda t: " ".join(t.lower().replace(".", " ").split())
    assert got == brute({i: norm(t) for i, t in texts.items()}, lambda a, b: N.jaccard(a, b) >= N.THRESHOLD)


def test_near_hot_group_and_edges(spark):
    rows = [(f"C{i:04d}", "The same text over and over again.") for i in range(3000)]
    rows += [("A", None), ("B1", "ab"), ("B2", "AB!"), ("B3", ""), ("B4", "?"), (None, "x y z w"), ("V1", "The same text over and over again and."), ("V1", "The same text over and over again and.")]
    df = spark.createDataFrame(rows, "report_id string, raw_text string")
    got = {r.report_id: r.first_report_id for r in N.near_found(df).collect()}
    assert got["C2999"] == "C0000" and got["V1"] == "C0000" and got["B2"] == "B1" and "A" not in got and got["B4"] == "B3"
    assert len(got) == 2999 + 1 + 1 + 1


def test_wide_buckets_lose_no_link(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    texts = {}
    for i in range(60):
        words = list(base)
        for _ in range(3):
            words[r.randrange(40)] = f"z{r.randrange(10**6)}"
        texts[f"W{i:02d}"] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "report_id string, raw_text string")
    assert sorted(map(tuple, N.near_found(df).collect())) == brute(texts, lambda a, b: N.jaccard(a, b) >= N.THRESHOLD)


def test_format_groups(spark):
    rows = [
        ("r1", "First one here. Second part 12!"), ("r2", "SECOND  PART 12. first one, here"), ("r3", "first one here\nsecond part 12"), ("r4", "First one here. Second part 21!"), ("r5", "here one First. Second part 12!"),
        ("r6", "Place: X | Time: 3:00 | People: 9"), ("r7", "time: 3.00\nplace: x\npeople: 9"), ("r8", None), ("r9", "ｆirst one here. Second part 12"), ("r9", "ｆirst one here. Second part 12"),
    ]
    df = spark.createDataFrame(rows, "report_id string, raw_text string")
    assert sorted(map(tuple, D.format_found(df).collect())) == [("r1", "r2"), ("r1", "r3"), ("r1", "r9"), ("r6", "r7")]
    copies = {x.report_id: x.copies for x in D.format_records(df).collect()}
    assert copies == {"r1": 4, "r4": 1, "r5": 1, "r6": 2}
    assert D.format_found(df.limit(0)).count() == 0


def test_every_layout_of_a_contested_sequence_counts(spark):
    rows = [("m1", "ab cd ef gh"), ("m2", "Ab cd. Ef gh."), ("m3", "AB CD EF GH"), ("m4", "Ef gh. Ab cd.")]  # the ends of m1 to m3 hide the boundary
    rows += [("n1", "Red boat. Old. Big mill."), ("n2", "Red boat. Old big mill."), ("n3", "Old big mill. Red boat.")]  # the form of most units isn't the one that matches
    df = spark.createDataFrame(rows, "report_id string, raw_text string")
    want = [("m1", "m2"), ("m1", "m3"), ("m1", "m4"), ("n1", "n2"), ("n1", "n3")]
    assert sorted(map(tuple, D.format_found(df).collect())) == want
    assert {x.report_id: x.copies for x in D.format_records(df).collect()} == {"m1": 4, "n1": 3}
    assert sorted(map(tuple, N.near_found(df).collect())) == want


def test_copies_whose_every_form_hides_a_boundary(spark, monkeypatch):
    rows = [("a1", "Red boat left.St. Kel shut. Old mill."), ("a2", "Old mill. Red boat left. St. Kel shut."), ("a3", "Old mill. Boat red left. St. Kel shut."), ("b1", "Xx yy. Yy xx. Zz zz."), ("b2", "Zz zz. Yy xx. Xx yy.")]
    df = spark.createDataFrame(rows, "report_id string, raw_text string")
    for size in (500, 1):
        monkeypatch.setattr(D, "MEETING", size)
        assert sorted(map(tuple, D.format_found(df).collect())) == [("a1", "a2"), ("b1", "b2")]
    assert ("a1", "a2") in set(map(tuple, N.near_found(df).collect()))
    assert D.tiles("abab", ["ab", "ab"]) and D.tiles("aaab", ["a", "aab"]) and D.tiles("aabaa", ["aa", "aab"]) and not D.tiles("abba", ["ab", "ab"]) and not D.tiles("ab", ["ab", "ab"]) and D.tiles("", []) and D.tiles("ok" * 300 + "x", ["ok", "okok"] * 100 + ["x"]) and not D.tiles("ok" * 300 + "y", ["ok", "okok"] * 100 + ["x"]) and not D.tiles("a" * 60 + "b", ["a", "aa", "aaa"] * 10 + ["c"])


def test_near_links_copies_that_differ_in_arabic_marks(spark):
    df = spark.createDataFrame([("a1", "جسر؛ باب؛ دار"), ("a2", "جسر\nباب\nدار"), ("a3", "دار، باب")], "report_id string, raw_text string")
    assert sorted(map(tuple, D.format_found(df).collect())) == [("a1", "a2")]
    assert sorted(map(tuple, N.near_found(df).collect())) == [("a1", "a2")]


def test_signatures_agree_with_similarity():
    a = "the quick brown fox jumps over the lazy dog near the river bank today"
    sig = N.superminhash([a, a + " again", "zzz", a])
    same = (sig[0] == sig[1]).mean()
    assert abs(same - N.jaccard(a, a + " again")) < 0.12 and (sig[0] == sig[3]).all() and (sig[0] == sig[2]).mean() < 0.05


def test_blocks_round_trip():
    import numpy as np

    r = np.random.default_rng(2)
    for n, bits in ((1, 36), (4096, 36), (777, 60)):
        key = np.sort(r.integers(0, 2**bits, n).astype(np.uint64))
        text, flag = r.integers(0, 1 << 15, n).astype(np.uint64), r.integers(0, 2, n).astype(np.uint64)
        k, x, f = N.unpack(N.pack(7 << 32, key, text << np.uint64(1) | flag))
        assert (k == key).all() and (x == text.astype(np.int64) + (7 << 32)).all() and (f == flag.astype(bool)).all()


def test_one_text_a_hundred_thousand_times(spark):
    from pyspark.sql import functions as F

    many = spark.range(100_000).select(F.format_string("C%06d", "id").alias("report_id"), F.lit("The very same text comes again and again.").alias("raw_text"))
    rest = spark.createDataFrame([("A1", "Another text that nobody repeats at all."), ("B1", "the very same text comes again and again!")], "report_id string, raw_text string")
    got = N.near_found(many.union(rest))
    assert got.count() == 100_000 and got.select("first_report_id").distinct().count() == 1


def test_many_unlike_members_of_one_bucket(spark, monkeypatch):
    """Every likely pair of a divided bucket is emitted once, in units of bounded size."""
    import numpy as np

    from marram.plans.shared import Kept

    monkeypatch.setattr(N, "UNIT", 700)
    r = np.random.default_rng(4)
    n = 5000
    sketch = r.integers(-(2**63), 2**63 - 1, (n, 4))
    for i in range(0, 300, 2):
        sketch[i + 1] = sketch[i] ^ (1 << (i % 60))  # likely pairs
    root = np.arange(n)
    root[1000:2500] = 1000  # the largest component
    sketch[10] = sketch[1500] ^ 1
    sketch[2001] = sketch[2000]  # of one component: no pair
    places = spark.createDataFrame([(i, i, *map(int, sketch[i])) for i in range(n)], "loc long, id long, s0 long, s1 long, s2 long, s3 long")
    wide = spark.createDataFrame([(7, i) for i in range(n)] + [(8, 0), (8, 1)], "key long, loc long")
    found = spark.createDataFrame([(i, 1000) for i in range(1000, 2500)], "node long, root long")
    got = sorted(map(tuple, N._across(wide, places, found, N.THRESHOLD, Kept()).collect()))
    most = 256 - N.least_bits(N.THRESHOLD)
    u = sketch.view(np.uint64)
    want = sorted((i, int(j)) for i in range(n) for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1 :]).sum(1, dtype=int) <= most) + i + 1 if root[i] != root[j])
    assert got == want and len(got) >= 150


def test_buckets_large_in_one_task_meet_the_others(spark, monkeypatch):
    """A template's texts share bands in several flushes; small flushes, same groups as brute force."""
    monkeypatch.setattr(N, "FLUSH", 1020)
    test_wide_buckets_lose_no_link(spark)
