"""Evaluation texts that leaked into training text (problem 8).

Every shard of the corpus (texts of a partition, SHARD characters at a time) gets
a sparse suffix array: its suffixes, word by word, that begin with a phrase of
some test item, sorted. Every test suffix is binary-searched in it by its words;
the suffixes between the two places found are its matches, with their locations,
each extended to the longest verbatim match. Matches of one item in one document
are chained over small gaps (typing errors), and the item's share of words
covered decides. Phrases that different items share, or that several ordinary
reports use, start no match; equal items are searched as one and all reported.

Defined results: null texts and texts of fewer than SEED words match nothing;
items of fewer than SEED words can't be found; repeated documents are found one
by one; an empty corpus or test set gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.plans.shared import small_rows, spread

#: Words that start a match, words by which suffixes are sorted, gap bridged, share of an item that counts as a leak.
SEED, DEPTH, GAP, SHARE = 4, 24, 4, 0.5
#: Characters of a shard whose suffixes are sorted at once.
SHARD = 2_000_000
MOST_ITEMS = 20_000

_TOKEN = re.compile(r"[฀-໿⺀-鿿]|[^\W_]+")


def words(text: str) -> list[str]:
    """Words of a text regardless of case, width and punctuation; single characters in scripts without spaces."""
    return _TOKEN.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


class Items:
    """The test set as word numbers: classes of equal items, their distinctive phrases, their suffixes in order."""

    def __init__(self, rows: list[tuple[int, str]], common: set[int] = frozenset()) -> None:
        texts = [words(t) for _, t in rows]
        self.vocab = {w: n for n, w in enumerate(sorted({w for t in texts for w in t}), 1)}
        members: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for (i, _), t in zip(rows, texts, strict=True):
            members[tuple(self.vocab[w] for w in t)].append(i)
        self.ids = [sorted(set(m)) for m in members.values()]
        self.words = [np.array(w, np.int32) for w in members]
        self.size = np.array([len(w) for w in self.words], np.int64)
        # all classes one after the other, a 0 behind each
        self.begin = np.cumsum(self.size + 1) - self.size - 1
        self.run = np.concatenate([*(x for w in self.words for x in (w, np.zeros(1, np.int32))), np.zeros(DEPTH, np.int32)])
        keys = self.keys(self.run)
        at = np.flatnonzero(keys)
        owner = np.searchsorted(self.begin, at, "right") - 1
        pair = np.unique(np.stack([keys[at].view(np.int64), owner], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        every, classes = np.unique(pair[:, 0], return_counts=True)
        self.every = np.sort(every.view(np.uint64))
        own = np.setdiff1d(every[classes == 1].view(np.uint64), np.array(list(common), np.uint64))
        self.phrases = np.bincount(pair[:, 1], minlength=len(self.words))
        at = at[np.isin(keys[at], own)]
        self.own = np.sort(own)
        # the test suffixes that begin with a distinctive phrase, in order
        suffix = self.suffixes(self.run, at)
        order = np.argsort(suffix, kind="stable")
        self.at, self.suffix = at[order], suffix[order]

    @staticmethod
    def keys(w: np.ndarray) -> np.ndarray:
        """A number for each SEED words; 0 where one of them is in no item."""
        n = len(w) - SEED + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        k, ok = np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(SEED):
            part = w[j : j + n]
            ok &= part > 0
            k = (k ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            k ^= k >> np.uint64(29)
        k[~ok] = 0
        return k

    @staticmethod
    def suffixes(run: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first DEPTH words behind each position as byte strings, whose order is that of the words."""
        if not len(at):
            return np.zeros(0, f"S{4 * DEPTH}")
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([run, np.zeros(DEPTH, np.int32)]), DEPTH)[at]
        return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * DEPTH}").ravel()

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of the texts one after the other, 0 for foreign words and between texts, and where each begins."""
        get, out, begin = self.vocab.get, [], []
        for t in texts:
            begin.append(len(out))
            if t:
                out.extend([get(w, 0) for w in words(t)])
            out.append(0)
        return np.array(out, np.int32), np.array(begin, np.int64)

    def matches(self, texts: list[str | None]) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
        """(document, class) to its longest verbatim matches (position in the item, in the document, words)."""
        run, begin = self.numbers(texts)
        out: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        keys = self.keys(run)
        if not len(self.at) or not len(keys):
            return out
        # the shard's suffix array: its suffixes that begin like some test suffix, in order
        near = np.searchsorted(self.own, keys)
        at = np.flatnonzero((keys > 0) & (self.own[np.minimum(near, len(self.own) - 1)] == keys))
        suffix = self.suffixes(run, at)
        order = np.argsort(suffix, kind="stable")
        at, suffix = at[order], suffix[order]
        # every test suffix is searched: the suffixes of the shard that share its first SEED words lie between the two places
        head = self.suffix.view(np.uint8).reshape(-1, 4 * DEPTH).copy()
        head[:, 4 * SEED :] = 0
        low = np.searchsorted(suffix, head.view(f"S{4 * DEPTH}").ravel(), "left")
        head[:, 4 * SEED :] = 255
        high = np.searchsorted(suffix, head.view(f"S{4 * DEPTH}").ravel(), "right")
        n = np.maximum(high - low, 0)
        q = np.repeat(np.arange(len(n)), n)
        a = at[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + low[q]]
        p = self.at[q]
        # one match a run of neighbouring hits on a diagonal
        order = np.lexsort((a, a - p))
        a, p = a[order], p[order]
        lead = np.r_[True, (np.diff(a) != 1) | (np.diff(a - p) != 0)] if len(a) else np.zeros(0, bool)
        a, p = a[lead], p[lead]
        size, live = np.full(len(a), SEED, np.int64), np.arange(len(a))
        padded = np.concatenate([run, np.zeros(1, np.int32)])
        while len(live):  # zeros lie behind every text and item, so no match leaves its own
            x, y = padded[np.minimum(a[live] + size[live], len(run))], self.run[p[live] + size[live]]
            live = live[(x == y) & (x > 0)]
            size[live] += 1
        live = np.flatnonzero((a > 0) & (p > 0))
        while len(live):
            x, y = run[a[live] - 1], self.run[p[live] - 1]
            live = live[(x == y) & (x > 0)]
            a[live] -= 1
            p[live] -= 1
            size[live] += 1
            live = live[(a[live] > 0) & (p[live] > 0)]
        found = np.unique(np.stack([a, p, size], 1), axis=0) if len(a) else np.zeros((0, 3), np.int64)
        docs = np.searchsorted(begin, found[:, 0], "right") - 1
        items = np.searchsorted(self.begin, found[:, 1], "right") - 1
        for d, i, (x, y, k) in zip(docs.tolist(), items.tolist(), found.tolist(), strict=True):
            out[d, i].append((y - int(self.begin[i]), x - int(begin[d]), k))
        return out

    def covered(self, item: int, hits: list[tuple[int, int, int]]) -> tuple[int, int]:
        """Words of the class that the matches cover, gaps of typing errors included, and the longest match."""
        mark = np.zeros(len(self.words[item]) + 1, np.int64)
        hits = sorted(set(hits))
        for p, _, n in hits:
            mark[p : p + n] = 1
        for p, a, n in hits:
            for p2, a2, _ in hits[bisect_right(hits, (p + n, 1 << 62, 0)) : bisect_right(hits, (p + n + GAP, 1 << 62, 0))]:
                if 0 <= a2 - a - n <= GAP + 2:
                    mark[p + n : p2] = 1
        return int(mark.sum()), max(n for _, _, n in hits)


def test_items(items: DataFrame, ordinary: DataFrame | None = None) -> Items:
    """The test set. A phrase that at least two different ordinary texts (one column) use starts no match; texts that hold half of an item's phrases quote it and don't count."""
    rows = [(int(r.item_id), r.text) for r in small_rows(items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text"), "the test set", MOST_ITEMS)]
    plain = Items(rows)
    if ordinary is None or not rows:
        return plain
    keys = plain.keys(plain.run)
    at = np.flatnonzero(keys)
    owner = np.searchsorted(plain.begin, at, "right") - 1
    holders: dict[int, set[int]] = defaultdict(set)
    for k, i in zip(keys[at].tolist(), owner.tolist(), strict=True):
        holders[k].add(i)

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[int]] = defaultdict(set)  # the least two different texts of each phrase
        for b in batches:
            texts = b.column(0).to_pylist()
            run, begin = plain.numbers(texts)
            keys = plain.keys(run)
            hit = np.flatnonzero(keys > 0)
            hit = hit[np.isin(keys[hit], plain.every)]
            doc = np.searchsorted(begin, hit, "right") - 1
            ends = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)]
            for s, e in zip(ends, ends[1:], strict=False):
                if s == e:
                    continue
                own, text = set(keys[hit[s:e]].tolist()), texts[doc[s]]
                held = Counter(i for k in own for i in holders[k])
                quoted = {i for i, n in held.items() if 2 * n >= plain.phrases[i]}
                h = xxhash.xxh64_intdigest(" ".join(words(text))) >> 1
                for k in own:
                    if not holders[k] & quoted and h not in seen[k]:
                        seen[k] = set(sorted({*seen[k], h})[:2])
        cells = [(k - (1 << 64) if k >= 1 << 63 else k, h) for k, s in seen.items() for h in s]
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], pa.int64()) for i in range(2)], names=["key", "h"])

    # at most two rows for each phrase of the test set and partition, one in the end; the set's size was checked
    common = spread(ordinary).mapInArrow(used, "key long, h long").groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x < y").select("key")
    return Items(rows, {r.key % 2**64 for r in common.collect()})


def overlaps(docs: DataFrame, tests: Items) -> DataFrame:
    """doc_id, item_id, words (covered), share of the item's words, longest verbatim match, its place in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def shard() -> pa.RecordBatch:
            rows = []
            for (d, c), hits in tests.matches(texts).items():
                n, longest = tests.covered(c, hits)
                at = next(a for _, a, k in hits if k == longest)
                rows += [(ids[d], i, n, n / len(tests.words[c]), longest, at) for i in tests.ids[c]]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "words", "share", "longest", "word_at"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(d)
                texts.append(t)
                size += len(t)
                if size >= SHARD:
                    yield shard()
                    ids, texts, size = [], [], 0
        if ids:
            yield shard()

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")).mapInArrow(run, "doc_id long, item_id long, words int, share double, longest int, word_at int")


def every(docs: DataFrame, items: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """All overlaps, those of less than the share included."""
    return overlaps(docs, test_items(items, None if reports is None else reports.select("raw_text").where("raw_text IS NOT NULL")))


def leaks(docs: DataFrame, items: DataFrame, reports: DataFrame | None = None, share: float = SHARE) -> DataFrame:
    """The overlaps that reach the share."""
    return every(docs, items, reports).where(F.col("share") >= share)


def found(docs: DataFrame, items: DataFrame, reports: DataFrame) -> DataFrame:
    """p8_found."""
    return leaks(docs, items, reports).select("doc_id", "item_id").distinct()


def clean(docs: DataFrame, items: DataFrame, reports: DataFrame) -> DataFrame:
    """The documents that hold no leaked item."""
    return docs.join(found(docs, items, reports).select("doc_id").distinct(), "doc_id", "left_anti")


