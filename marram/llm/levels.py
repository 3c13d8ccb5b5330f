"""Reading level of each document (problem 10).

Familiar-word formula: the share of words outside high-frequency lists that
come from the corpus's own document frequencies, plus average sentence length.
With one list fewer levels came out right (README), so there are two. Documents
vote by word length: a word is familiar to everybody if it is frequent in the
quarter of a language's documents with the shortest words, and familiar to the
general reader if it is frequent in their shorter-worded 60 %; the share is the
mean of those outside the one and outside the other. All documents vote: those
without a label with the language whose lists know most of their words, those of
a label whose list another, larger language's list covers, with that language.
Each sentence gets a score, the prevailing sentences decide, so quoted passages
in another register don't. Cut points lie between the median scores of rated
documents, which the PRIOR scores outweigh only where few are rated; at most
MOST_RATED of them are read (a documented sample of labelled rows, all rows
below that bound).

Defined results: null or wordless text is level 1; a null or wrong language
label doesn't matter, the language is taken from the text; where no document has
a label, the corpus counts as one language; doc_id null is kept.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marram.plans.shared import Kept, spread

#: Shares of a language's documents, by mean word length, whose frequent words make the lists.
EASY, GENERAL = 0.25, 0.6
#: A frequent word is in so many of those documents; so a list never holds more than mean distinct words / FREQUENT.
FREQUENT = 0.02
#: Running text without marks counts in pieces of so many words; what a word of sentence length adds to a score.
PIECE, LENGTH = 30, 0.005
MOST_RATED = 5000
#: Scores that the levels have before any document is rated, and the number of rated documents they count as.
PRIOR, PRIOR_WEIGHT = {1: 0.05, 2: 0.65, 3: 1.45}, 1

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?؟。])\s+|\n+")


class Lists:
    """Each language's listed words with their class: 0 familiar to everybody, 1 to the general reader; 2 stands for the others."""

    def __init__(self, by: dict[str, dict[str, int]]) -> None:
        self.languages = sorted(by)
        self.row = {w: n for n, w in enumerate(sorted({w for words in by.values() for w in words}), 1)}
        self.table = np.full((len(self.row) + 1, max(1, len(by))), 2, np.uint8)
        for k, lang in enumerate(self.languages):
            for w, c in by[lang].items():
                self.table[self.row[w], k] = c

    def classes(self, words: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts given as their words one after the other, each with at least one: every word's class and each text's language."""
        get = self.row.get
        known = self.table[np.fromiter((get(w, 0) for w in words), np.int64, len(words))]
        start = np.cumsum(size) - size
        lang = np.add.reduceat((known < 2).astype(np.int32), start, axis=0).argmax(1)
        return known[np.arange(len(words)), np.repeat(lang, size)], lang


def _count(lists: Lists | None = None):
    """Document frequencies of a partition, by language label (or by the lists) and mean word length in tenths; '' counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, size), words in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array([size] * len(words), pa.int32()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "size", "word", "n"])
            seen.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = _WORD.findall(text.lower())
                if words:
                    if lists:
                        lang = lists.languages[lists.classes(words, np.array([len(words)]))[1][0]]
                    size = min(10_000, 10 * sum(map(len, words)) // len(words))
                    seen[lang, size].update({"", *words})
            if sum(map(len, seen.values())) > 500_000:
                yield from flush()
        yield from flush()

    return run


_COUNTS = "lang string, size int, word string, n long"


def _lists(counts: DataFrame) -> dict[str, dict[str, int]]:
    """The lists from document frequencies, by one aggregation over all languages."""
    sizes = defaultdict(list)
    for r in counts.where("word = ''").groupBy("lang", "size").agg(F.sum("n").alias("n")).orderBy("lang", "size").collect():  # a row per label and tenth of a letter
        sizes[r.lang].append((r["size"], r.n))
    tops = []
    for lang, s in sizes.items():
        total, row = sum(n for _, n in s), [lang]
        for share in (EASY, GENERAL):
            acc, top = 0, s[0][0]
            for size, n in s:
                top, acc = size, acc + n
                if acc >= share * total:
                    break
            row += [top, acc * FREQUENT]
        tops.append(tuple(row))
    if not tops:
        return {}
    of = counts.sparkSession.createDataFrame(tops, "lang string, t0 int, n0 double, t1 int, n1 double")
    within = [F.sum(F.when(F.col("size") <= F.col(f"t{k}"), F.col("n")).otherwise(0)) >= F.first(f"n{k}") for k in (0, 1)]
    rows = counts.where("word <> ''").join(F.broadcast(of), "lang").groupBy("lang", "word").agg(within[0].alias("easy"), within[1].alias("general")).where("easy OR general")  # of: a row a label
    out: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for r in rows.collect():  # bounded, see FREQUENT
        out[r.lang][r.word] = 0 if r.easy else 1
    return out


def familiar(docs: DataFrame) -> Lists:
    """The lists, after every document has voted."""
    keep = Kept()
    src = spread(docs.where("text IS NOT NULL").select(F.lower(F.substring("lang", 1, 2)).alias("lang"), "text"))
    counts = keep(src.where("lang IS NOT NULL").mapInArrow(_count(), _COUNTS).groupBy("lang", "size", "word").agg(F.sum("n").alias("n")))
    by = _lists(counts)
    if not by:
        counts = keep(src.select(F.lit("").alias("lang"), "text").mapInArrow(_count(), _COUNTS).groupBy("lang", "size", "word").agg(F.sum("n").alias("n")))
        by = _lists(counts)
    else:
        whole = {r.lang: r.n for r in counts.where("word = ''").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        alias: dict[str, str] = {}
        for lang in sorted(by, key=lambda g: (-whole[g], g)):  # a label of stray documents speaks a larger label's language
            alias[lang] = next((g for g in alias if alias[g] == g and by[lang] and 2 * len(by[lang].keys() & by[g].keys()) > len(by[lang])), lang)
        rest = src.where("lang IS NULL").mapInArrow(_count(Lists({g: by[g] for g in by if alias[g] == g})), _COUNTS)
        table = F.create_map(*[F.lit(x) for pair in alias.items() for x in pair])
        by = _lists(keep(counts.withColumn("lang", table[F.col("lang")]).unionByName(rest).groupBy("lang", "size", "word").agg(F.sum("n").alias("n"))))
    keep.release()
    return Lists(by)


def scores(texts: list[str], lists: Lists) -> np.ndarray:
    """(score, share of unfamiliar words, words a sentence) of each text; the score is the median over its sentences."""
    out = np.zeros((len(texts), 3))
    words: list[str] = []
    owner, sentence = [], []  # of each sentence: its text, its words
    for i, text in enumerate(texts):
        for part in _SENTENCE.split(text.lower()):
            if w := _WORD.findall(part):
                words += w
                owner.append(i)
                sentence.append(len(w))
    if not words:
        return out
    owner, sentence = np.array(owner), np.array(sentence)
    has, first = np.unique(owner, return_index=True)
    size = np.add.reduceat(sentence, first)
    kind, _ = lists.classes(words, size)
    # sentences, long ones in pieces
    n = -(-sentence // PIECE)
    of = np.repeat(np.arange(len(sentence)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(PIECE, sentence[of] - nth * PIECE)
    score = np.add.reduceat(kind.astype(np.int64), np.cumsum(length) - length) / length + LENGTH * length
    counted = (length >= 3) | (n[of] == 1)
    piece, value = owner[of][counted], score[counted]
    order = np.lexsort((value, piece))
    piece, value = piece[order], value[order]
    begin = np.searchsorted(piece, has)
    count = np.r_[begin[1:], len(piece)] - begin
    out[has, 0] = (value[begin + (count - 1) // 2] + value[begin + count // 2]) / 2
    out[has, 1] = np.add.reduceat((kind == 2).astype(np.int64), np.cumsum(size) - size) / size
    out[has, 2] = size / np.bincount(owner, minlength=len(texts))[has]
    return out


_SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("unfamiliar", T.DoubleType()), T.StructField("sentence_words", T.DoubleType())])


def scored(docs: DataFrame, lists: Lists) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                x = scores([t or "" for t in b.column(1).to_pylist()], lists)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(3))], names=_SCORED.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCORED)


def cut_points(docs: DataFrame, labels: DataFrame, lists: Lists) -> tuple[float, float]:
    """Between the median scores of the levels among rated documents."""
    rated = labels.where("doc_id IS NOT NULL AND level BETWEEN 1 AND 3").groupBy("doc_id").agg(F.percentile("level", 0.5).alias("level")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_RATED)
    rows = scored(docs.join(F.broadcast(rated.select("doc_id")), "doc_id", "left_semi"), lists).join(F.broadcast(rated), "doc_id").groupBy("level").agg(F.percentile("score", 0.5).alias("m"), F.count("*").alias("n"))
    m = dict(PRIOR)
    for r in rows.collect():
        if r.level == int(r.level):
            k = int(r.level)
            m[k] = (r.n * r.m + PRIOR_WEIGHT * PRIOR[k]) / (r.n + PRIOR_WEIGHT)
    one, two, three = sorted(m.values())
    return (one + two) / 2, (two + three) / 2


def profile(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, level, score, share of unfamiliar words and words a sentence of every document."""
    lists = familiar(docs)
    low, high = cut_points(docs, labels, lists)
    return scored(spread(docs.select("doc_id", "text")), lists).withColumn("level", F.when(F.col("score") < low, 1).when(F.col("score") < high, 2).otherwise(3))


def found(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """p10_found."""
    return profile(docs, labels).select("doc_id", "level")
