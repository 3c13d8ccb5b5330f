"""Freely typed places mapped to a canonical list (problem 2).

Distinct values are brought to the consistent form and normalised; a character
n-gram inverted index over the list's proper names, one a script, gives
candidates, scored by idf-weighted cosine for a batch of words at once. The
threshold is calibrated on the list: the lowest cosine that a name of it has
with one of its own single-error variants. An exact check follows: one typing
error at most, and what the value says besides the name must agree with the
candidate's kind of facility, read off the list itself: the part that the names
of one kind and language share. Abbreviations and single typing errors of such
words count; another kind, or no kind at all, is no match. Of what is left the
best is accepted if its cosine is ahead of the next place's by the margin. In
scripts without spaces the words are the stretches beside a kind's phrase.

Defined results: null and blank values have no row; verbatim names of the list
are theirs; values that mean no place of the list are NONE; ties between
different places, closer in cosine than the margin, are NONE; an empty list makes every value NONE.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm import forms
from marram.plans.shared import checked, salted_join, small_rows

MOST_NAMES = 200_000
MARGIN = 0.08
#: Cosines that are counted at once.
CELLS = 4_000_000

# Words of relation that name nothing.
STOP = set("de du des d la le les l el los las the a an al of in to at en y et".split())
# Abbreviations that could stand for several kinds and by convention stand for one.
CONVENTIONAL = {"est": "estacion"}
_ARABIC_FOLD = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "ؤ": "و", "ئ": "ي", "ـ": None})
_TOKENS = re.compile(r"[^\W_]+")
_DENSE = re.compile(r"[฀-๿⺀-鿿]")


def fold(value: str) -> str:
    """Lower case, no accents on Latin letters, Arabic letter variants as one; separators become spaces."""
    value = unicodedata.normalize("NFKD", value.lower())
    value = unicodedata.normalize("NFC", "".join(c for c in value if not 0x300 <= ord(c) < 0x370 and not 0x64B <= ord(c) < 0x660)).translate(_ARABIC_FOLD)
    return re.sub(r"[^\wऀ-ॿ฀-๿]+|_+", " ", value).strip()


def script(text: str) -> str:
    for c in text:
        o = ord(c)
        if o >= 0x2E80:
            return "han"
        if 0x0600 <= o < 0x0780:
            return "arabic"
        if 0x0900 <= o < 0x0980:
            return "devanagari"
        if 0x0E00 <= o < 0x0E80:
            return "thai"
    return "latin"


def distance(a: str, b: str, most: int = 1) -> int:
    """0 for equal words, 1 if one letter was changed, added, lost or swapped with its neighbour, else 2; at most `most` + 1."""
    if a == b:
        return 0
    if most < 1 or abs(len(a) - len(b)) > 1:
        return most + 1
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]:
        return 1
    return 1 if a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :] else 2


def shortens(token: str, word: str) -> bool:
    """Is the token an abbreviation: the word's first letter and some of its others in order?"""
    if token in CONVENTIONAL:
        return word == CONVENTIONAL[token]
    if len(token) < 2 or len(token) > len(word) - 2 or token[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in token)


def _grams(name: str, sizes: tuple[int, ...]) -> set[str]:
    padded = f"^{name}$"
    return {padded[i : i + n] for n in sizes for i in range(len(padded) - n + 1)} - {"^", "$"}


def _variants(name: str) -> Iterator[str]:
    """The name with one letter lost, changed, added or swapped with its neighbour."""
    for i in range(len(name)):
        yield name[:i] + "\x01" + name[i + 1 :]
        yield name[:i] + "\x01" + name[i:]
        if len(name) > 3:
            yield name[:i] + name[i + 1 :]
        if i + 1 < len(name) and name[i] != name[i + 1]:
            yield name[:i] + name[i + 1] + name[i] + name[i + 2 :]


class Index:
    """Character n-gram inverted index over names."""

    def __init__(self, names: list[str], dense: bool) -> None:
        self.names, self.sizes = names, (1, 2) if dense else (2, 3)
        posting: dict[str, list[int]] = defaultdict(list)
        for k, p in enumerate(names):
            for g in _grams(p, self.sizes):
                posting[g].append(k)
        self.number = {g: n for n, g in enumerate(posting)}
        self.length = np.array([len(v) for v in posting.values()], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.array([k for v in posting.values() for k in v], np.int64)
        self.weight = np.log(1 + len(names) / np.maximum(1, self.length)) ** 2
        self.new = math.log(1 + len(names)) ** 2
        self.norm = np.sqrt([sum(self.weight[self.number[g]] for g in _grams(p, self.sizes)) for p in names])
        self.threshold, place = 1.0, {p: k for k, p in enumerate(names)}
        for p in names:
            own = _grams(p, self.sizes)
            for v in _variants(p):
                grams = _grams(v, self.sizes)
                weight = [self.weight[self.number[g]] if g in self.number else self.new for g in grams]
                shared = sum(self.weight[self.number[g]] for g in grams & own)
                cosine = shared / math.sqrt(sum(weight)) / self.norm[place[p]]
                self.threshold = min(self.threshold, cosine - 1e-9)
        if not names:
            self.threshold = 0.0

    def near(self, tokens: list[str]) -> list[list[tuple[str, float]]]:
        """Of each token, every name whose weighted cosine reaches the threshold, with it."""
        out: list[list[tuple[str, float]]] = [[] for _ in tokens]
        if not self.names:
            return out
        step = max(1, CELLS // len(self.names))
        for i in range(0, len(tokens), step):
            grams = [_grams(t, self.sizes) for t in tokens[i : i + step]]
            known = [[n for g in s if (n := self.number.get(g)) is not None] for s in grams]
            n = np.array([x for k in known for x in k], np.int64)
            token = np.repeat(np.arange(len(grams)), [len(k) for k in known])
            foreign = np.array([len(s) - len(k) for s, k in zip(grams, known, strict=True)])
            norm = np.sqrt(np.bincount(token, self.weight[n], len(grams)) + foreign * self.new)
            many = self.length[n]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.start[n], many)
            cell = np.repeat(token, many) * len(self.names) + self.flat[at]
            cosine = np.bincount(cell, np.repeat(self.weight[n], many), len(grams) * len(self.names)).astype(float).reshape(len(grams), -1)
            cosine /= np.maximum(norm, 1e-9)[:, None] * self.norm
            for t, k in zip(*(x.tolist() for x in np.nonzero((cosine >= self.threshold) & (cosine > 0))), strict=True):
                out[i + t].append((self.names[k], float(cosine[t, k])))
        return out


def _common(names: list[str], dense: bool) -> tuple[str, str]:
    """What all these names begin with and end with, in whole words unless the script has none."""
    if dense:
        pre = next((names[0][:i] for i in range(min(map(len, names)), 0, -1) if all(n.startswith(names[0][:i]) for n in names)), "")
        suf = next((names[0][-i:] for i in range(min(map(len, names)), 0, -1) if all(n.endswith(names[0][-i:]) for n in names)), "")
        return pre, suf
    words = [n.split() for n in names]
    a = b = 0
    while all(len(w) > a + 1 and w[a] == words[0][a] for w in words):
        a += 1
    while all(len(w) > a + b + 1 and w[-b - 1] == words[0][-b - 1] for w in words):
        b += 1
    return " ".join(words[0][:a]), " ".join(words[0][len(words[0]) - b :])


def heard(name: str) -> str:
    """A Latin name as it sounds: French and English spellings of one sound alike, other scripts as they are."""
    return name.replace("ch", "sh").replace("ou", "u").replace("gh", "g").replace("kh", "k").replace("q", "k") if name.isascii() else name


def _agrees(s: str, word: str, part: str) -> int:
    """2 if the word is the part of a kind's phrase, 1 with one typing error or shortened, else 0."""
    forms_ = [word, word[2:]] if s == "arabic" and word.startswith("ال") and len(word) > 4 else [word]
    if part in forms_:
        return 2
    return int(len(part) > 3 and any(distance(w, part, 1) <= 1 for w in forms_) or s == "latin" and shortens(word, part))


class Gazetteer:
    """The canonical list: proper names and kinds per script, and the n-gram index."""

    def __init__(self, rows: list[tuple[str, str, str, str]]) -> None:
        self.verbatim = {name for _, name, _, _ in rows}
        by: dict[tuple[str, str], list[tuple[str, str]]] = defaultdict(list)
        for group, name, language, kind in rows:
            by[language or "", kind or ""].append((group, fold(name)))
        self.kinds: dict[str, dict[str, set[str]]] = defaultdict(lambda: defaultdict(set))  # script, kind: its phrases
        self.groups: dict[str, dict[str, set[tuple[str, str]]]] = defaultdict(lambda: defaultdict(set))  # script, proper: (kind, group)
        for (_, kind), named in by.items():
            dense = bool(_DENSE.search(named[0][1]))
            pre, suf = _common([n for _, n in named], dense) if len(named) > 1 else ("", "")
            for group, name in named:
                proper = name[len(pre) : len(name) - len(suf)].strip()
                self.groups[script(name)][proper].add((kind, group))
                self.kinds[script(name)][kind] |= {p for p in (pre, suf) if p}
        self.parts = defaultdict(set, {s: {w for phrases in kinds.values() for p in phrases for w in p.split()} for s, kinds in self.kinds.items()})
        self.sounds: dict[str, set[str]] = defaultdict(set)
        for p in self.groups["latin"]:
            self.sounds[heard(p)].add(p)
        self.index = {s: Index(sorted(propers), s == "han") for s, propers in [*self.groups.items(), ("heard", self.sounds)]}
        self.lengths = {s: sorted({len(p) for p in propers}) for s, propers in self.groups.items()}
        self.known: dict[tuple[str, str], list[tuple[str, float]]] = {}

    def ask(self, asked: set[tuple[str, str]]) -> None:
        """Looks tokens (script, token) up that the next values need; what is known stays for the batches that follow, up to a bound."""
        if len(self.known) > 200_000:
            self.known.clear()
        by: dict[str, list[str]] = defaultdict(list)
        for s, t in asked:
            if (s, t) not in self.known:
                by[s].append(t)
        for s, tokens in by.items():
            near = self.index[s].near(tokens) if s in self.index else [[] for _ in tokens]
            self.known.update({(s, t): n for t, n in zip(tokens, near, strict=True)})

    def candidates(self, s: str, token: str) -> list[tuple[str, float]]:
        """Every proper name that reaches the threshold, with its weighted cosine."""
        if (s, token) not in self.known:
            self.ask({(s, token)})
        return self.known[s, token]

    def says(self, s: str, words: list[str], at: tuple[int, int]) -> dict[str, int]:
        """Kinds that the words beside the name words[at[0]:at[1]] speak of: 2 in full, 1 with a typing error or shortened."""
        left = [w for w in words[: at[0]] if w not in STOP]
        right = [w for w in words[at[1] :] if w not in STOP]
        out: dict[str, int] = {}
        for kind, phrases in self.kinds.get(s, {}).items():
            for phrase in phrases:
                parts = [p for p in phrase.split() if p not in STOP]
                for side in (left[-len(parts) :], right[: len(parts)]):
                    if parts and len(side) == len(parts):
                        level = min(_agrees(s, w, p) for w, p in zip(side, parts, strict=True))
                        out[kind] = max(out.get(kind, 0), level and level + len(parts) - 1)
        return {k: v for k, v in out.items() if v}

    def resolve_all(self, values: list[str]) -> list[str]:
        """The group of each value, lookups made together: single words first, then pairs of neighbours that may be one name."""
        texts = [fold(v) for v in values]
        kinds = [script(t) for t in texts]
        out: list[str | None] = [None] * len(texts)
        for size in (1, 2):
            spans = {i: [("".join(w[k : k + size]), (k, k + size)) for k in range(len(w) - size + 1)] for i, t in enumerate(texts) if out[i] is None and kinds[i] not in ("han", "thai") for w in [t.split()]}
            self.ask({(s, w) for i, ts in spans.items() for t, _ in ts if self._nameable(kinds[i], t) for s, w in ((kinds[i], t), ("heard", heard(t))) if s != "heard" or kinds[i] == "latin"})
            for i, ts in spans.items():
                out[i] = self._among(kinds[i], texts[i].split(), ts)
        dense = {i: self._beside(kinds[i], t.replace(" ", "")) for i, t in enumerate(texts) if kinds[i] in ("han", "thai")}
        self.ask({(kinds[i], w) for i, b in dense.items() for _, _, w in b})
        for i, b in dense.items():
            out[i] = self._dense(kinds[i], b)
        return [g or "NONE" for g in out]

    def _nameable(self, s: str, token: str) -> bool:
        return len(token) > 2 and token not in STOP and token not in self.parts[s]

    def resolve(self, value: str) -> str:
        return self.resolve_all([value])[0]

    def _among(self, s: str, words: list[str], spans: list[tuple[str, tuple[int, int]]]) -> str | None:
        """The group whose proper name one of the tokens is and whose kind the words beside it speak of; None if there is no such."""
        found: dict[str, tuple[float, int]] = {}
        for token, at in spans:
            if not self._nameable(s, token):
                continue
            most = 0 if len(token) < 4 else 1
            near = [(cosine, p) for p, cosine in self.candidates(s, token) if distance(token, p, most) <= most]
            if s == "latin":
                near += [(cosine, p) for h, cosine in self.candidates("heard", heard(token)) if distance(heard(token), h, most) <= most for p in self.sounds[h]]
            if not near:
                continue
            spoken = self.says(s, words, at)
            for cosine, proper in near:
                for kind, group in self.groups[s][proper]:
                    if kind in spoken:
                        found[group] = max(found.get(group, (0.0, 0)), (cosine, spoken[kind]))
        return self._best(found)

    @staticmethod
    def _best(found: dict[str, tuple[float, int]]) -> str | None:
        """The group of the highest cosine; of one name's groups that whose kind is spoken of more clearly; NONE without the margin."""
        if not found:
            return None
        ranked = sorted(found.items(), key=lambda g: (g[1], g[0]), reverse=True)
        (group, (cosine, clear)), rest = ranked[0], ranked[1:]
        for _, (c, k) in rest:
            if cosine - c < MARGIN and (k == clear or cosine != c):
                return "NONE"
        return group

    def _beside(self, s: str, text: str) -> list[tuple[str, str, str]]:
        """(kind, its phrase, stretch beside it of a name's length) in a text without spaces."""
        out = []
        for kind, phrases in self.kinds.get(s, {}).items():
            for phrase in phrases:
                at = text.find(phrase)
                while at >= 0:
                    rest = text[:at] if s == "han" else text[at + len(phrase) :]
                    more = (0,) if s == "han" else (-1, 0, 1)
                    lengths = sorted({n + d for n in self.lengths[s] for d in more if 0 < n + d <= len(rest)})
                    out += [(kind, phrase, rest[-n:] if s == "han" else rest[:n]) for n in lengths]
                    at = text.find(phrase, at + 1)
        return out

    def _dense(self, s: str, beside: list[tuple[str, str, str]]) -> str | None:
        """Scripts without spaces: the kind is found inside the text, the name beside it; the longest exact name first."""
        found: dict[str, tuple[float, int]] = {}
        longest = 0
        for kind, phrase, token in beside:
            for proper, cosine in self.candidates(s, token):
                if distance(token, proper, 1) > 1 or s == "han" and len(token) != len(proper):
                    continue
                if token == proper and len(proper) + len(phrase) > longest:
                    longest, found = len(proper) + len(phrase), {}
                if not longest or token == proper and len(proper) + len(phrase) == longest:
                    for k, group in self.groups[s][proper]:
                        if k == kind:
                            found[group] = max(found.get(group, (0.0, 0)), (cosine, len(phrase)))
        return self._best(found)


def gazetteer(df: DataFrame) -> Gazetteer:
    rows = small_rows(df.where("name IS NOT NULL AND group_id IS NOT NULL").select("group_id", "name", "language", "kind").distinct(), "the gazetteer", MOST_NAMES)
    return Gazetteer(sorted((r.group_id, r.name, r.language or "", r.kind or "") for r in rows))


def resolve(values: DataFrame, places: Gazetteer) -> DataFrame:
    """value, group_id of each distinct value (one column `value`) that is not blank."""
    sql = forms.form_sql("text", keep="text AS value", outs="value, s4 AS form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in forms.run_sql(batches, sql):
            b = b.filter(pc.match_substring_regex(b.column("form"), r"\S"))
            yield pa.RecordBatch.from_arrays([b.column("value").cast(pa.string()), pa.array(places.resolve_all(b.column("form").to_pylist()), pa.string())], names=["value", "group_id"])

    distinct = values.where("value IS NOT NULL").distinct()
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.repartition(tasks).select(F.col("value").alias("text")).mapInArrow(run, "value string, group_id string")


def typed(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """source_table, row_id, value of every typed place; copies count once."""
    a = claims.select(F.lit("claims").alias("source_table"), F.col("event_id").alias("row_id"), F.col("location_text").alias("value"))
    b = entities.where("entity_type = 'place'").select(F.lit("entities").alias("source_table"), F.col("entity_id").alias("row_id"), F.col("name").alias("value"))
    return a.unionByName(b).where("row_id IS NOT NULL AND value IS NOT NULL").distinct()


def found(claims: DataFrame, entities: DataFrame, gazetteer_df: DataFrame) -> DataFrame:
    """p2_found: the group of every typed place that is not verbatim a name of the list."""
    rows = typed(claims, entities)
    names = gazetteer_df.select(F.col("name").alias("value")).where("value IS NOT NULL").distinct()
    rows = salted_join(rows, names, ["value"], "row_id", "left_anti")
    known = resolve(rows.select("value"), gazetteer(gazetteer_df))
    return salted_join(rows, known, ["value"], "row_id").select("source_table", "row_id", "group_id")


def resolved(claims: DataFrame, gazetteer_df: DataFrame) -> DataFrame:
    """event_id, group_id and resolved_location (the group's preferred name) of every claim with a typed place; null where NONE."""
    rows = claims.select(F.col("event_id").alias("row_id"), F.col("location_text").alias("value")).where("row_id IS NOT NULL AND value IS NOT NULL").distinct()
    names = gazetteer_df.where("name IS NOT NULL").groupBy(F.col("name").alias("value")).agg(F.min("group_id").alias("exact"))
    rows = salted_join(rows, names, ["value"], "row_id", "left")
    known = resolve(rows.where("exact IS NULL").select("value"), gazetteer(gazetteer_df))
    rows = salted_join(rows, known, ["value"], "row_id", "left").withColumn("group_id", F.coalesce("exact", "group_id"))
    best = gazetteer_df.where("preferred").groupBy("group_id").agg(F.min("name").alias("resolved_location"))
    return rows.where("group_id IS NOT NULL").join(checked(best), "group_id", "left").select(F.col("row_id").alias("event_id"), "group_id", "resolved_location")


def unmatched(claims: DataFrame, entities: DataFrame, gazetteer_df: DataFrame) -> DataFrame:
    """The typed values that mean no place of the list, with their number of records."""
    rows = typed(claims, entities)
    none = resolve(rows.select("value"), gazetteer(gazetteer_df)).where("group_id = 'NONE'").select("value")
    return salted_join(rows, none, ["value"], "row_id").groupBy("value").agg(F.count("*").alias("records"))
