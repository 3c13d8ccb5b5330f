"""Text functions over columns, native expressions throughout.

Only compatibility normalisation has no native form; it runs in one Arrow
function, over texts that are not plain, and can be left out where the text is
known to be in composed form.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marram.functions import vocab as V

# What separates words, a clock time, the end of a sentence, an event of the wire text.
NON_WORD = r"[^\p{L}\p{N}_؀-ۿ]+"
CLOCK = r"(?<![\p{L}\p{N}_])(?:[01]?\d|2[0-3]):[0-5]\d(?![\p{L}\p{N}_])"
SENTENCE = r"(?<=[.!?؟。；])\s+|\n+"
EVENT = r"\{type:([a-z_]+),location:((?:\"(?:[^\"]|\"\")*\")|null),people:([0-9]+|null),severity:([a-z]+),time:((?:\"(?:[^\"]|\"\")*\")|null),desc:((?:\"(?:[^\"]|\"\")*\")|null)\}"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def unaccented(s: pd.Series) -> pd.Series:
    return s.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), na_action="ignore")


def nfkc(c: Column) -> Column:
    """NFKC; ASCII text skips the Arrow function's work."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(_nfkc(c))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def segments(c: Column, least: int = 8) -> Column:
    """Sentences by end marks and line breaks; those shorter than least are dropped unless all are; none for blank text."""
    parts = F.filter(F.transform(F.split(c, SENTENCE, -1), strip), lambda s: s != "")
    long = F.filter(parts, lambda s: F.length(s) >= least)
    return F.when(blank(c), F.array().cast("array<string>")).when(F.size(long) > 0, long).otherwise(F.array(strip(c)))


def injection_signals(c: Column) -> Column:
    """The instruction-shaped patterns that fire, in list order."""
    return F.array_compact(F.array(*[F.when(c.rlike(f"(?iu){p}"), F.lit(p)) for p in V.INJECTION_PATTERNS]))


def model_view(c: Column) -> Column:
    """The text without its instruction-shaped sentences; the whole text if nothing else is left."""
    parts = F.filter(F.transform(F.split(c, SENTENCE, -1), strip), lambda s: (s != "") & ~s.rlike("(?iu)" + "|".join(f"(?:{p})" for p in V.INJECTION_PATTERNS)))
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(strip(c))


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def licensed_severity(c: Column) -> Column:
    """The strongest severity whose marker no cue takes back within the words before it; unknown if none."""
    cues = F.array(*[F.lit(x) for x in V.NEGATION_CUES])

    def says(w: Column, level: str) -> Column:
        marks = F.array(*[F.lit(x) for x in V.SEVERITY_MARKERS[level]])
        window = lambda i: F.slice(w, F.greatest(i - V.NEGATION_WINDOW + 1, F.lit(1)), F.least(i, F.lit(V.NEGATION_WINDOW)))
        # most texts have no marker at all: the words are gone through one by one only where one has
        return F.arrays_overlap(w, marks) & F.exists(F.transform(w, lambda x, i: F.array_contains(marks, x) & ~F.arrays_overlap(window(i), cues)), lambda b: b)

    def strongest(w: Column) -> Column:
        out = F.lit("unknown")
        for level in reversed(list(V.SEVERITY_MARKERS)):
            out = F.when(says(w, level), level).otherwise(out)
        return out

    # the words are cut once, inside a one-element array
    return F.when(c.isNull(), "unknown").otherwise(F.transform(F.array(words(c)), strongest)[0])


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in V.SEVERITIES]), c).cast("int") - 1


def capped_severity(claimed: Column, licensed: Column, flagged: Column) -> Column:
    """What is claimed, never above what the text licenses; unknown for flagged or unlicensed text."""
    known = claimed.isin(V.SEVERITIES[1:])
    return F.when(F.coalesce(flagged, F.lit(False)) | (licensed == "unknown"), "unknown").when(known & (severity_rank(claimed) <= severity_rank(licensed)), claimed).otherwise(licensed)


def placeholder_fold(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(unaccented(c)), r"\s+", " "))


def cleaned(c: Column, folded: Column | None = None) -> Column:
    """Null for texts that stand for no answer."""
    return F.when((placeholder_fold(c) if folded is None else folded).isin(V.PLACEHOLDERS), None).otherwise(strip(c))


def is_echo(c: Column) -> Column:
    return c.isin(V.ECHOES) | F.lower(c).isin(V.ECHOES) | c.contains("UNTRUSTED_REPORT")


def grounded_count(value: Column, source: Column) -> Column:
    """The count if it is positive and stands in the source as a number of its own, else null."""
    n = value.try_cast("bigint")
    return F.when((n > 0) & F.array_contains(F.regexp_extract_all(source, F.lit(r"(?U)\d+"), F.lit(0)), n.cast("string")), n.cast("int"))


def normal(c: Column, compatibility: bool = True) -> Column:
    """The comparison normal form: one digit set, lower case, words separated by single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(nfkc(c) if compatibility else c, *V.DIGITS)), NON_WORD, " "))


def place_key(c: Column, compatibility: bool = True) -> Column:
    """Places equal regardless of case and punctuation; empty for null."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(nfkc(c) if compatibility else c), NON_WORD, " ")), F.lit(""))


def place_name(c: Column, compatibility: bool = True) -> Column:
    """place_key without a leading Arabic article."""
    low = F.lower(strip(nfkc(c) if compatibility else c))
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(low, r"^(?:ال|أل|الـ)\s*", ""), NON_WORD, " ")), F.lit(""))


def is_generic(name: Column) -> Column:
    return (name == "") | name.isin(V.GENERIC_PLACES)


def content_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name, " "), lambda w: (F.length(w) > 1) & ~w.isin(V.PLACE_STOPWORDS)))


def fingerprint(c: Column, compatibility: bool = True) -> Column:
    """The same for the same sentences in any order."""
    parts = segments(c)
    if compatibility:  # an Arrow function can't run inside a lambda: the segments go through it as one text
        parts = F.split(nfkc(F.array_join(parts, "\x1f")), "\x1f")
    return F.sha2(F.array_join(F.array_sort(F.transform(parts, lambda s: normal(s, False))), " || "), 256)


def trigrams(form: Column) -> Column:
    """Distinct character trigrams of a normal form, spaces as underscores; shorter texts are one element."""
    t = F.replace(form, F.lit(" "), F.lit("_"))
    return F.when(F.length(t) < 3, F.array(t)).otherwise(F.array_distinct(F.regexp_extract_all(t, F.lit("(?s)(?=(...))"), F.lit(1))))


def similarity(a: Column, b: Column) -> Column:
    """Trigram Jaccard of two normal forms; the sets are made once, inside a one-element array."""
    return F.transform(F.array(F.struct(trigrams(a).alias("a"), trigrams(b).alias("b"))), lambda p: jaccard(p["a"], p["b"]))[0]


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(n / (F.size(a) + F.size(b) - n))


def duplicate_class(same: Column, similarity: Column) -> Column:
    return F.when(same, "exact_fingerprint").when(similarity >= 0.92, "trigram_strong").when(similarity >= 0.72, "trigram_review").otherwise("trigram_weak")


def clocks(c: Column) -> Column:
    """Distinct clock times HH:MM in a text, sorted; empty for none."""
    found = F.regexp_extract_all(c, F.lit(CLOCK), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda t: F.lpad(t, 5, "0"))))


def minutes(clock: Column) -> Column:
    return F.substring(clock, 1, 2).cast("int") * 60 + F.substring(clock, 4, 2).cast("int")


def place_of(resolved: Column, typed: Column) -> Column:
    """The resolved place, else the typed one; empty is none."""
    return F.coalesce(F.nullif(resolved, F.lit("")), F.nullif(typed, F.lit("")))


def side_text(kind: Column, place: Column, people: Column, severity: Column, time: Column) -> Column:
    """One side of a contradiction in words."""
    return F.concat_ws(", ", F.concat(F.lit("type "), kind), F.concat(F.lit("at "), place), F.concat(F.lit("people "), people.cast("string")), F.when(severity != "unknown", F.concat(F.lit("severity "), severity)), F.concat(F.lit("time "), F.nullif(time, F.lit(""))))


def wire_events(c: Column) -> Column:
    """Events of the wire text as an array of structs; doubled quotes inside values are undone."""
    text = lambda g: F.transform(F.regexp_extract_all(c, F.lit(EVENT), F.lit(g)), lambda v: F.when(v != "null", F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))))
    plain = lambda g: F.transform(F.regexp_extract_all(c, F.lit(EVENT), F.lit(g)), lambda v: F.when(v != "null", v))
    return F.arrays_zip(plain(1).alias("event_type"), text(2).alias("location_text"), plain(3).alias("people_affected"), plain(4).alias("severity"), text(5).alias("time_reference"), text(6).alias("description"))
