"""One consistent form for text that only looks the same (problem 6).

The work is done by DuckDB inside Arrow partitions: every batch of a
partition is handed to an in-process DuckDB connection as a table and comes
back through one embedded SQL expression (translate for single characters,
nfc_normalize for decomposed accents, regular expressions as guards, word
lists for look-alike letters).

Defined results: null text stays null; empty text stays empty; text without
odd characters comes back unchanged, whatever its length. Extra columns never
reach the operator, so clashing names cannot disturb it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marram.plans.shared import spread

# Letters of other alphabets and the Latin letters they look like.
CYRILLIC = "аеорсухіјѕһԁԛԝАВЕЗКМНОРСТУХІЈЅԌ"
CYRILLIC_AS = "aeopcyxijshdqwABE3KMHOPCTYXIJSG"
GREEK = "ονιαρυχκγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_AS = "oviapuxkyABEZHIKMNOPTYX"
# Latin letters foreign to the languages at hand.
LATIN = "ıɑɡɩʏʀⅼ"
LATIN_AS = "iagiyrl"
# Persian and Urdu letters that look like Arabic ones.
ARABIC = "یکہھەۀ"
ARABIC_AS = "يكهههه"

_SCRIPT_OWN = [(0x0900, 0x0980), (0x0E00, 0x0F00)]  # Devanagari, Thai and Lao
_LOOSE = {"wide", "narrow", "font", "initial", "medial", "final", "isolated", "compat", "circle", "square", "noBreak"}


@lru_cache(1)
def tables() -> dict[str, object]:
    """Character tables, by rule from the Unicode data that Python carries."""
    one_from, one_to, many, invisible, spaces = [], [], {}, [], []
    for o in range(0x80, 0x30000):
        c = chr(o)
        kind = unicodedata.category(c)
        if kind == "Zs":
            spaces.append(c)
        elif (kind == "Cf" and not (0x600 <= o <= 0x605 or o in (0x6DD, 0x70F, 0x8E2))) or 0xFE00 <= o <= 0xFE0F or o in (0x34F, 0x115F, 0x1160, 0x180E, 0x3164, 0xFFA0):
            invisible.append(c)
        elif kind[0] in "LN" and not any(a <= o < b for a, b in _SCRIPT_OWN):
            d = unicodedata.decomposition(c)
            if d.startswith("<") and d[1 : d.index(">")] in _LOOSE and (n := unicodedata.normalize("NFKC", c)) != c:
                if len(n) == 1:
                    one_from.append(c)
                    one_to.append(n)
                elif n[0] != " ":
                    many[c] = n
    pairs = [*zip(one_from, one_to, strict=True), *((c, " ") for c in spaces)]
    first = {*spaces, *invisible}
    block = lambda c: 0 if c in first else 1 if "\uff00" <= c else 2 if "\ufb1d" <= c < "\uff00" else 3 if c < "\ufb1d" else 4
    parts = []  # small maps, as translate builds its map for every row
    for n in range(5):
        of = [p for p in pairs if block(p[0]) == n]
        parts.append(("".join(a for a, _ in of) + ("".join(invisible) if n == 0 else ""), "".join(b for _, b in of)))
    return {"parts": [p for p in parts if p[0]], "many": many}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _cls(chars: str) -> str:
    """A regular-expression class of these characters, as ranges."""
    points, out = sorted(map(ord, chars)), []
    for o in points:
        if out and o == out[-1][1] + 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in out) + "]"


#: Devanagari letters that NFC itself takes apart; usual in the script.
_NUKTA = {chr(o): unicodedata.normalize("NFC", chr(o)) for o in range(0x958, 0x960)}
_WORD = r"[\p{L}\p{M}\p{N}]+"


def _steps(col: str) -> list[tuple[str, str]]:
    """Named SQL steps from the column to its consistent form."""
    t = tables()
    nukta = col
    for a, b in _NUKTA.items():
        nukta = f"replace({nukta}, {_q(a)}, {_q(b)})"
    one = []
    for i, (a, b) in enumerate(t["parts"]):
        x = f"p{i - 1}" if i else "s0"
        one.append((f"p{i}", f"CASE WHEN regexp_matches({x}, '{_cls(a)}') THEN translate({x}, {_q(a)}, {_q(b)}) ELSE {x} END"))
    one[-1] = ("s1", one[-1][1])
    latin = f"translate(w, {_q(CYRILLIC + GREEK + LATIN)}, {_q(CYRILLIC_AS + GREEK_AS + LATIN_AS)})"
    word = (
        f"CASE WHEN NOT regexp_matches(w, '[\\p{{Cyrillic}}\\p{{Greek}}{ARABIC}]|{_cls(LATIN)}') THEN w WHEN regexp_matches(w, '[A-Za-z0-9\\x{{C0}}-\\x{{24F}}]') AND regexp_matches(w, '[\\p{{Cyrillic}}\\p{{Greek}}]|{_cls(LATIN)}') THEN {latin} "
        f"WHEN regexp_matches(w, '[{ARABIC}]') AND NOT regexp_matches(w, '[پچژگ]') THEN translate(w, {_q(ARABIC)}, {_q(ARABIC_AS)}) ELSE w END"
    )
    return [
        ("s0", f"CASE WHEN regexp_matches({col}, '[\\x{{958}}-\\x{{95F}}]') THEN {nukta} ELSE {col} END"),
        *one,
        ("s2", f"CASE WHEN regexp_matches(s1, '{_cls(''.join(t['many']))}') THEN array_to_string(list_transform(string_split(s1, ''), lambda c: coalesce(many[c], c)), '') ELSE s1 END"),
        ("s3", "CASE WHEN regexp_matches(s2, '[\\p{M}\\x{F900}-\\x{FAFF}\\x{212A}\\x{212B}]') THEN replace(replace(nfc_normalize(s2), 'ํา', 'ำ'), 'เเ', 'แ') ELSE s2 END"),
        ("s4", f"CASE WHEN regexp_matches(s3, '[\\p{{Cyrillic}}\\p{{Greek}}{ARABIC}]|{_cls(LATIN)}') THEN array_to_string(list_transform(regexp_extract_all(s3, '{_WORD}|[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: {word}), '') ELSE s3 END"),
    ]


#: Characters that are as they should be in the languages at hand; a text of only these is its own consistent form.
_ORDINARY = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in [(0x9, 0xA), (0x20, 0x7E), (0xA1, 0xA7), (0xAB, 0xAB), (0xB0, 0xB1), (0xB6, 0xB7), (0xBB, 0xBB), (0xBF, 0xFF), (0x152, 0x153), (0x60C, 0x60C), (0x61B, 0x61B), (0x61F, 0x61F), (0x621, 0x63A), (0x641, 0x652), (0x660, 0x66C), (0x900, 0x957), (0x960, 0x97F), (0xE01, 0xE3F), (0xE41, 0xE4C), (0xE4E, 0xE5B), (0x2013, 0x2014), (0x2018, 0x201E), (0x2022, 0x2022), (0x2026, 0x2026), (0x20AC, 0x20AC), (0x3001, 0x3003), (0x3008, 0x3011), (0x4E00, 0x9FFF), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20)])
#: Sara e is ordinary unless doubled, which looks like sara ae.
_AS_IS = f"regexp_full_match(_t, '(?:[{_ORDINARY}]|\\x{{E40}}[{_ORDINARY}])*')"


def form_sql(col: str = "text", table: str = "b", keep: str = "*", outs: str = "s4 AS form") -> str:
    """The embedded SQL: consistent form of a column of a registered batch; ordinary texts pass by the steps."""
    many = tables()["many"]
    keys = "[" + ", ".join(map(_q, many)) + "]"
    values = "[" + ", ".join(map(_q, many.values())) + "]"
    src = f"(SELECT *, {_AS_IS} AS _same FROM (SELECT {keep}, {col} AS _t FROM {table}))"
    sql = f"(SELECT * FROM {src} WHERE NOT _same)"
    extra = [name for name, _ in _steps("_t") if name[0] == "p"]
    for name, x in _steps("_t"):
        m = f", map({keys}, {values}) AS many" if name == "s1" else ""
        sql = f"(SELECT *, {x} AS {name}{m} FROM {sql})"
    plain = f"(SELECT *, _t AS s0, _t AS s1, _t AS s2, _t AS s3, _t AS s4 FROM {src} WHERE _same IS NULL OR _same)"
    return f"SELECT {outs} FROM (SELECT * EXCLUDE ({", ".join(["many", *extra])}) FROM {sql} UNION ALL SELECT * FROM {plain})"


def connect():
    """A small DuckDB connection for one Python worker."""
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("SET threads = 1")
    con.execute("SET memory_limit = '300MB'")
    con.execute("SET preserve_insertion_order = true")
    return con


def run_sql(batches: Iterator[pa.RecordBatch], sql: str) -> Iterator[pa.RecordBatch]:
    """Each Arrow batch through the SQL, as table b."""
    con = connect()
    for batch in batches:
        if batch.num_rows:
            con.register("b", pa.Table.from_batches([batch]))
            yield from con.sql(sql).to_arrow_table().to_batches()
            con.unregister("b")


def consistent(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and `form`, the consistent form of the text; null for null."""
    sql = form_sql("text", keep="* EXCLUDE (text)", outs=", ".join([f'"k{i}"' for i in range(len(keys))] + ["s4 AS form"]))
    src = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField(f"k{i}", src.schema[i].dataType) for i in range(len(keys))] + [T.StructField("form", T.StringType())])
    out = src.mapInArrow(lambda it: run_sql(it, sql), schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "form")


def lookalikes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The keys of the rows whose text is not in its consistent form, with both forms."""
    names = [f"k{i}" for i in range(len(keys))]
    sql = form_sql("text", keep="* EXCLUDE (text)", outs=", ".join([*names, "_t AS original", "s4 AS form"])) + " WHERE s4 <> s0"
    src = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(text).cast("string").alias("text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("original", T.StringType()), T.StructField("form", T.StringType())])
    out = src.mapInArrow(lambda it: run_sql(it, sql), schema)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "original", "form")


def _records(df: DataFrame, table: str, key: str, text: str) -> DataFrame:
    return spread(df.select(F.lit(table).alias("source_table"), F.col(key).alias("row_id"), F.col(text).alias("text")).where("row_id IS NOT NULL AND text IS NOT NULL"))


def _both(reports: DataFrame, claims: DataFrame) -> DataFrame:
    return _records(reports, "reports", "report_id", "raw_text").unionByName(_records(claims, "claims", "event_id", "location_text"))


def all_forms(reports: DataFrame, claims: DataFrame) -> DataFrame:
    """source_table, row_id and the consistent form of every raw_text and location_text; copies count once."""
    return consistent(_both(reports, claims), ["source_table", "row_id"], "text").distinct()


def found(reports: DataFrame, claims: DataFrame) -> DataFrame:
    """p6_found: records whose raw_text or location_text holds look-alike characters.

    Null keys or texts give no row; a key whose copies differ gives one row. Copies
    fall away among the keys found, so no text is shuffled.
    """
    return lookalikes(_both(reports, claims), ["source_table", "row_id"], "text").select("source_table", "row_id").distinct()
