"""Language of each document and of its parts (problem 7).

A byte convolutional network: byte embeddings, filters of several widths, the
maximum over a window, softmax. It is trained in numpy on labelled reports (at
most PER_LANGUAGE of each language, chosen by a hash of the text: a documented
bound on labelled rows) and trained again without the sentences whose label it
doubts, as labels are partly wrong. It is applied to fixed-length windows in
batches; filters are folded into tables over pairs of bytes, so a window costs
a few table rows a byte. Every sentence of every text is classified.

Defined results: null or wordless text has no language; a language without
labelled rows can't be found; labels that name no known language are missing
labels; with no labelled row at all nothing is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marram.llm import forms, sentences
from marram.plans.shared import spread

PER_LANGUAGE, WINDOW, EMBED, FILTERS, WIDTHS = 400, 64, 8, 16, (2, 4, 6)
EPOCHS, RATE, SURE = 5, 0.01, 0.7

# Names that a language goes by, besides its code.
NAMES = {
    "fr": "fra fre french français francais française",
    "ar": "ara arabic msa العربية عربي arb",
    "dar": "ary darija الدارجة moroccan",
    "en": "eng english anglais",
    "es": "spa spanish español espanol castellano",
    "zh": "zho chi chinese 中文 汉语 cmn",
    "th": "tha thai ไทย ภาษาไทย",
    "hi": "hin hindi हिन्दी हिंदी",
}
_KNOWN = {n: k for k, v in NAMES.items() for n in [k, *v.split()]}
_LETTER = re.compile(r"[^\W\d_]")


def canonical(label: str | None) -> str | None:
    """The language a label names, or None if it is missing or meaningless."""
    if not label:
        return None
    label = label.strip().lower()
    return _KNOWN.get(label) or _KNOWN.get(re.split(r"[-_ ]", label)[0])


def _label(col: str) -> F.Column:
    low = F.lower(F.trim(col))
    table = F.create_map(*[F.lit(x) for kv in _KNOWN.items() for x in kv])
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, F.split(low, "[-_ ]")[0]))


def parts(text: str) -> list[tuple[int, int]]:
    """The units to classify: sentences, or a form as a whole."""
    if sentences._form(text) is not None:
        return [(0, len(text))]
    return [(a, b) for a, b in sentences.units(text) if _LETTER.search(text, a, b)]


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts in lower case, cut into windows, and the text each window is of.

    A text's last window ends with the text; texts shorter than a window are padded with zeros.
    """
    raw = [t.lower().encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate([np.frombuffer(b"".join(raw), np.uint8), np.zeros(WINDOW, np.uint8)])
    n = np.maximum(1, -(-sizes // WINDOW))
    owner = np.repeat(np.arange(len(texts)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = np.minimum(k * WINDOW, np.maximum(0, sizes[owner] - WINDOW))
    rows = flat[(starts[owner] + at)[:, None] + np.arange(WINDOW)]
    rows[np.arange(WINDOW) >= (sizes[owner] - at)[:, None]] = 0
    return rows, owner


class Net:
    """The network; train() fits it, tables() prepares it for fast use."""

    def __init__(self, classes: list[str], seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"E": r.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"W{w}"] = r.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["V"] = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.p["c"] = np.zeros(len(classes), np.float32)

    def _step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy of a batch of windows."""
        p, n = self.p, len(x)
        emb = p["E"][x]
        pooled, kept = [], []
        for w in WIDTHS:
            patch = np.lib.stride_tricks.sliding_window_view(emb.reshape(n, -1), w * EMBED, axis=1)[:, ::EMBED]
            act = patch.reshape(-1, w * EMBED) @ p[f"W{w}"]
            act = act.reshape(n, -1, FILTERS) + p[f"b{w}"]
            best = act.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(act, best[:, None], 1)[:, 0], 0))
            kept.append((patch, best))
        h = np.concatenate(pooled, 1)
        z = h @ p["V"] + p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        g = {"V": h.T @ d, "c": d.sum(0), "E": np.zeros_like(p["E"])}
        dh = (d @ p["V"].T) * (h > 0)
        for i, w in enumerate(WIDTHS):
            patch, best = kept[i]
            dp = dh[:, i * FILTERS : (i + 1) * FILTERS]
            chosen = patch[np.arange(n)[:, None], best]  # batch, filter, patch
            g[f"W{w}"] = np.einsum("nfk,nf->kf", chosen, dp)
            g[f"b{w}"] = dp.sum(0)
            de = np.einsum("nf,kf->nfk", dp, p[f"W{w}"]).reshape(n, FILTERS, w, EMBED)
            at = x[np.arange(n)[:, None, None], best[:, :, None] + np.arange(w)]
            for e in range(EMBED):
                g["E"][:, e] += np.bincount(at.ravel(), de[..., e].ravel(), 256).astype(np.float32)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> None:
        """Adam over batches drawn evenly from the classes."""
        r = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.classes))]
        each = max(1, 96 // len(by))
        steps = max(60, epochs * len(y) // (each * len(by)))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            pick = np.concatenate([r.choice(b, each) for b in by if len(b)])
            rate = RATE * (1 - t / (steps + 1))
            for k, g in self._step(x[pick], y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)

    def tables(self) -> None:
        """Each pair of bytes' share in each filter, for the pairs at offsets 0, 2, 4."""
        e = self.p["E"]
        self.pairs = []
        for w in WIDTHS:
            one = [e @ self.p[f"W{w}"][k * EMBED : (k + 1) * EMBED] for k in range(w)]
            self.pairs.append([(one[k][:, None] + one[k + 1][None]).reshape(65536, FILTERS) for k in range(0, w, 2)])

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Class scores of windows."""
        if not hasattr(self, "pairs"):
            self.tables()
        out = []
        for i in range(0, len(x), 512):
            b = x[i : i + 512]
            pair = b[:, :-1].astype(np.int32) * 256 + b[:, 1:]
            h = []
            for w, tables in zip(WIDTHS, self.pairs, strict=True):
                n = WINDOW - w + 1
                act = tables[0][pair[:, :n]]
                for k, table in enumerate(tables[1:], 1):
                    act += table[pair[:, 2 * k : 2 * k + n]]
                h.append(np.maximum(act.max(1) + self.p[f"b{w}"], 0))
            out.append(np.concatenate(h, 1) @ self.p["V"] + self.p["c"])
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)), np.float32)

    def classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class and confidence of each text: its windows' mean score, by length."""
        if not texts:
            return np.zeros(0, int), np.zeros(0)
        x, owner = windows(texts)
        z = self.logits(x)
        n = np.bincount(owner, minlength=len(texts))
        z = np.stack([np.bincount(owner, z[:, c], len(texts)) for c in range(z.shape[1])], 1) / n[:, None]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        return z.argmax(1), z.max(1)


def fit(rows: list[tuple[str, str]]) -> Net | None:
    """A network from (language, text) rows; a second fit leaves out sentences whose label the first doubts."""
    classes = sorted({lang for lang, _ in rows})
    if len(classes) < 2:
        return None
    texts, y = [], []
    for lang, text in rows:
        for a, b in parts(text):
            texts.append(text[a:b])
            y.append(classes.index(lang))
    labels = np.array(y)
    x, owner = windows(texts)
    net = Net(classes)
    net.train(x, labels[owner], epochs=2)
    said, _ = net.classify(texts)
    good = said == labels
    for k in range(len(classes)):  # a class never loses most of its sentences
        if good[labels == k].mean() < 0.5:
            good[labels == k] = True
    keep = good[owner]
    net = Net(classes)
    net.train(x[keep], labels[owner][keep])
    net.tables()
    return net


def train(reports: DataFrame, per_language: int = PER_LANGUAGE) -> Net | None:
    """Fits the network on at most about twice per_language reports of each label."""
    rows = reports.select(_label("source_language").alias("lang"), F.col("raw_text").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return None
    least = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, max(1, n // per_language))])
    sample = rows.where(F.pmod(F.xxhash64("text"), least[F.col("lang")]) == 0).groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    form = forms.consistent(sample, ["lang", "h"], "text")
    return fit([(r.lang, r.form) for r in sorted(form.limit(2 * per_language * len(sizes)).collect(), key=lambda r: (r.lang, r.h))])


def segments(reports: DataFrame, net: Net) -> DataFrame:
    """report_id, source_language, h (of the text), part, language and confidence of every part of every row; copies aren't removed."""
    sql = forms.form_sql("text", keep="report_id, label, h", outs="report_id, label, h, s4 AS form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in forms.run_sql(batches, sql):
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                texts, at, nth = [], [], []
                for j, t in enumerate(b.column("form").to_pylist()):
                    for k, (s, e) in enumerate(parts(t)):
                        texts.append(t[s:e])
                        at.append(j)
                        nth.append(k)
                kind, sure = net.classify(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(pa.array(at, pa.int32())) for c in range(3)), pa.array(nth, pa.int32()), pa.array([net.classes[c] for c in kind], pa.string()), pa.array(sure, pa.float64())],
                    names=["report_id", "source_language", "h", "part", "language", "confidence"],
                )

    src = reports.select("report_id", F.col("source_language").alias("label"), F.xxhash64("raw_text").alias("h"), F.col("raw_text").alias("text")).where("report_id IS NOT NULL AND text IS NOT NULL")
    return spread(src).mapInArrow(run, "report_id string, source_language string, h long, part int, language string, confidence double")


def _segments(reports: DataFrame) -> DataFrame:
    net = train(reports)
    if net is None:
        return reports.sparkSession.createDataFrame([], "report_id string, source_language string, h long, part int, language string, confidence double")
    return segments(reports, net)


def settled(reports: DataFrame) -> DataFrame:
    """report_id, source_language, part, language and confidence of every part; a doubtful part takes the language of most of its report's sure parts."""
    own = Window.partitionBy("report_id", "source_language", "h")  # one report's parts
    sure = [F.sum(F.when((F.col("confidence") >= SURE) & (F.col("language") == k), 1).otherwise(0)).over(own) for k in NAMES]
    seg = _segments(reports).distinct().withColumn("main", F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(k).alias("k")) for n, k in zip(sure, NAMES, strict=True)])))
    language = F.when((F.col("confidence") < SURE) & (F.col("main.n") > 0), F.col("main.k")).otherwise(F.col("language"))
    return seg.select("report_id", "source_language", "part", language.alias("language"), F.round("confidence", 4).alias("confidence"))


def documents(reports: DataFrame) -> DataFrame:
    """report_id, its main language with a confidence, and all its languages; doubtful parts name none. A row for each differing text or label of a report_id.

    Copies count alike in every part of a report, so neither its main language nor its mean confidence depends on their number.
    """
    per = _segments(reports).groupBy("report_id", "source_language", "h", "language").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.max("confidence").alias("most"))
    return per.groupBy("report_id", "source_language", "h").agg(
        F.max_by("language", F.struct("c", "language")).alias("language"), F.max_by(F.col("c") / F.col("n"), F.struct("c", "language")).alias("confidence"),
        F.array_sort(F.collect_list(F.when(F.col("most") >= SURE, F.col("language")))).alias("sure"),
    ).select("report_id", "source_language", "language", "confidence", F.when(F.size("sure") == 0, F.array("language")).otherwise(F.col("sure")).alias("languages"))


def found(reports: DataFrame) -> DataFrame:
    """p7_found."""
    docs = documents(reports).withColumn("label", _label("source_language"))
    wrong = docs.where("label IS NULL OR size(languages) > 1 OR label <> languages[0]")
    return wrong.select("report_id", F.explode("languages").alias("language")).distinct()
