"""Sentence boundaries across languages and scripts (problem 1).

Cascading segmentation rule tables: every possible boundary of a text is held
against ordered (break?, before, after) regular-expression pairs; the first
pair that fits decides. A cascade is made of the tables of the languages that
the text shows, then of the script around the boundary, then of all scripts.
Line breaks and marks that close a quotation have cascades of their own. Two
things are told beforehand, because no pair of neighbouring characters shows
them: where quotations and the fields of forms lie. A line break that no pair
decides either wraps running sentences or is one of the layout; that is told
from all such line breaks of the text together.

Defined results: null text gives no unit; text without letters, empty or blank
included, gives one unit over its stripped extent (none if nothing is left);
units never overlap and cover every character that is not white space or a
form's separator.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marram.plans.shared import spread

END = ".!?؟。！？।॥…｡"
CLOSE = "\"'»”’)\\]」』"

# Words that a full stop shortens, per language.
ABBREVIATIONS = {
    "en": "dr mr mrs ms st sgt capt cpt lt col gen prof ave av blvd rd e.g i.e approx vs ver vol fig tel art num ex dept est jr resp cf".split(),
    "fr": "dr mr ms mme mlle mgr st ste sgt cpt capt lt col gen prof av bd blvd ave p.ex c.-à-d c.à.d cf env approx vs ver vol fig tel tél art num ex ing dpt dept resp".split(),
    "es": "dr dra sr sra srta st sgt cpt capt lt col gen prof av avda blvd p.ej ej aprox vs ver vol fig tel tél art núm num ud uds ex lic ing depto dpto".split(),
    "ar": "د م أ ص ت".split(),
    "dar": "د م أ ص ت".split(),
    "hi": "डॉ प्रो श्री कु सु पं".split(),
    "th": "น พ.ศ ค.ศ กม ม ดร ถ ซ ต อ จ รพ".split(),
}
# Words by which a text shows that it is, also, in a language of the Latin script.
SHOWN_BY = {
    "en": "the of and is are at to from with for we has have was not near please".split(),
    "fr": "le les des du est et à au aux dans pour avec sur une nous pas qui sont près il elle ce cette par vers depuis selon".split(),
    "es": "el los las del y en que una por con para está hay no se junto son".split(),
}
# Thai words that carry a sentence on, and polite particles that close one.
THAI_ON = "เมตร คน หลัง ไม่ ไป ต้องการ กับ และ ได้ ด้วย บ้าง แล้ว จาก ที่ ถึง ซึ่ง เพราะ หรือ แต่ โดย ของ ใน บน ใกล้ ตรง กิโล กม ลิตร น. ทุก เวลา ตั้งแต่ ก่อน จน ให้ เพื่อ อยู่ เมื่อ ว่า พา ๆ".split()
THAI_TAILS = "อีก จริง จริงๆ มาก ตอนนี้ แล้วนะ".split()
THAI_PARTICLES = "ค่ะ ครับ คะ นะคะ นะครับ จ้ะ จ้า ฮะ".split()


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


Rows = list[tuple["bool | None", "re.Pattern | None", "re.Pattern | None"]]


def _table(*rows: tuple[bool | None, str, str]) -> Rows:
    return [(br, re.compile(f"(?:{b})$", re.I) if b else None, re.compile(a) if a else None) for br, b, a in rows]


_ALONE = r"(?<!\d )(?<!\d)(?<![\w.'’\u0300-\u036f\u200b-\u200d\u2060\ufeff\u00ad])"
_LOWER = r"[a-zà-ÿ]"

#: First fitting pair decides. before ends at the possible boundary, after begins behind its white space.
LANGUAGES = {
    "en": _table((False, rf"(?<![\w.])(?:{_any(ABBREVIATIONS['en'])})\.", r""), (False, r"(?<![\w.])no\.", r"\d")),
    "fr": _table((False, rf"(?<![\w.])(?:{_any(ABBREVIATIONS['fr'])})\.", r""), (False, r"(?<![\w.])n[o°]\.", r"\d"), (False, r"(?<![\w.])p\.", r"(?i:ex)\.")),
    "es": _table((False, rf"(?<![\w.])(?:{_any(ABBREVIATIONS['es'])})\.", r""), (False, r"(?<![\w.])n[o°]\.", r"\d"), (False, r"(?<![\w.])p\.", r"(?i:ej)\.")),
    "ar": _table((False, rf"(?<!\w)(?:{_any(ABBREVIATIONS['ar'])})\.", r"\w")),
    "dar": _table((False, rf"(?<!\w)(?:{_any(ABBREVIATIONS['dar'])})\.", r"\w")),
    "hi": _table((False, rf"(?<!\w)(?:{_any(ABBREVIATIONS['hi'])})\.", r"")),
    "zh": _table(),
    "th": _table(
        (False, r"", rf"(?:{_any(THAI_PARTICLES)})(?![฀-๿])"),
        (True, r"[!?！？]+", r""),
        (False, rf"(?<![฀-๿.])(?:{_any(ABBREVIATIONS['th'])})\.", r""),
        (True, rf"(?:^|[\s\d฀-๿])(?:{_any(THAI_PARTICLES)})", r""),
        (False, r"", rf"(?:{_any(THAI_ON)}|(?:{_any(THAI_TAILS)})(?![฀-๿]))"),
        (False, r"[฀-๿,:(]", r"[\d(]"),
        (False, r"(?:และ|หรือ|ที่|ของ|ว่า|กับ|ถนน|ซอย)", r""),
        (True, r"[฀-๿\d)]", r"[^\W\d_]"),
    ),
}
#: The languages of each script; a text shows which of the Latin ones are its own.
OF_SCRIPT = {"latin": ["en", "fr", "es"], "arabic": ["ar", "dar"], "devanagari": ["hi"], "han": ["zh"], "thai": ["th"]}
SCRIPTS = {
    "latin": _table((False, rf"{_ALONE}(?-i:[A-ZÀ-Ý])\.", r"[^\W\d_]"), (False, rf"{_ALONE}(?-i:{_LOWER})\.", _LOWER), (False, r"(?<!\w)[ap]\.\s?m\.|(?<!\w)etc\.", r"[^A-ZÀ-Ý]"), (False, r"…|\.\.\.", _LOWER)),
    "arabic": _table(),
    "devanagari": _table(),
    "han": _table(),
    "thai": _table(),
}
#: Text in capitals, whose next letter shows no beginning.
LOUD = _table((False, r"(?<!\w)(?-i:[AP]\.\s?M|ETC)\.", r""))
COMMON = _table((True, rf"[{END}][{CLOSE}]*", r""))
#: Line breaks; after begins at the line break. None: the line breaks of the text decide together.
LINES = _table(
    (False, rf"[{END}][{CLOSE}]+", r"\s*(?-i:[^\W\dA-ZÀ-Ý_])(?<=[a-zà-ÿ])"),
    (True, rf"[{END}][{CLOSE}]+", r""),
    (False, r"[:：\-–—]", r""),
    (True, r"", r"[^\S\n]*\n\s*\n|\n[^\S\n]*\n|\s*\Z"),
)
#: Marks that close a quotation, which goes on unless a beginning is clear; after begins behind the quotation.
QUOTED = _table((True, r"", r"\n\s*(?![a-zà-ÿ])"), (True, r"", r"\s+[A-ZÀ-Ý¿¡]"))
QUOTED_LOUD = QUOTED[:1]
#: Columns that wrapped text keeps to, and those that show it even where no sentence ends inside a line.
COLUMNS, NARROW = 75, 50
#: Letters of a word that no language shortens by a stop.
PLAIN = 1 + max(len(part) for k in SHOWN_BY for w in [*ABBREVIATIONS[k], "etc"] for part in re.split(r"\W", w))
#: No pair looks farther back.
LOOK = max(len(w) for words in [*ABBREVIATIONS.values(), THAI_PARTICLES] for w in words) + 12


def shown(text: str) -> tuple[str, ...]:
    """The Latin-script languages that a word of theirs shows; all of them where none does."""
    words = set(_TOKEN.findall(text.lower()))
    return tuple(k for k, v in SHOWN_BY.items() if not words.isdisjoint(v)) or tuple(SHOWN_BY)


@lru_cache(256)
def cascade(script: str, languages: tuple[str, ...], loud: bool) -> Rows:
    """The pairs for a boundary, in order."""
    own = [k for k in OF_SCRIPT[script] if script != "latin" or k in languages]
    return [*(LOUD if loud else []), *(row for k in own for row in LANGUAGES[k]), *SCRIPTS[script], *([] if script == "thai" else COMMON)]


_QUOTES = re.compile(r"«[^«»]*»|“[^“”]*”|\"[^\"]*\"|「[^「」]*」|『[^『』]*』|„[^„“]*“")
_HAS_QUOTE = re.compile(r"[«“\"「『„]")
#: A mark with what closes it and white space behind; a mark of scripts without spaces; a line break; a space in Thai.
_MARK = rf"[{END}\n](?:(?<=\n)|(?:[{END}]|\s(?=[!?]))*[{CLOSE}]*(?=\s|$)|(?<=[。！？｡।!?؟])[。！？｡।!?؟]*[{CLOSE}]*(?=[\w“「『«])|(?<=[^\W\d_][^\W_]\.)(?=[^\W\d_])|(?<=[\d\s̀-ͯ]\.)(?=[^\W\d_])|(?<=\s[a-zà-ÿ]\.)(?=[A-ZÀ-Ý][a-zà-ÿ]))"
_POSSIBLE = re.compile(_MARK)
_POSSIBLE_THAI = re.compile(rf"{_MARK}|(?<=[ะบ])[^\S\n]+(?=\d)|(?<=[฀-๿\d).])[^\S\n]+(?=[฀-๿A-Za-zÀ-ÿ؀-ۿऀ-ॿ一-鿿])")
_THAI = re.compile(r"[฀-๿]")
_LETTER = re.compile(r"[^\W\d_]")
_TOKEN = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"\s*(\S*)")
_WORDS = re.compile(r"\w")
_FIELD = re.compile(r"\s*[^\W\d_][^:：.!?؟。\n\d]{0,40}?\s?[:：]\s*\S")
_SEPARATORS = [(c, re.compile(p)) for c, p in (("\n", r"\n"), ("/", r"\s+/\s+"), ("|", r"\s*\|\s*"), (";؛；", r"\s*[;؛；]\s*"), ("·•", r"\s+[·•]\s+"))]
_RANGES = [("thai", 0x0E00, 0x0E80), ("arabic", 0x0600, 0x0780), ("devanagari", 0x0900, 0x0980), ("han", 0x2E80, 0xA000)]


def _script(text: str, at: int, since: int = 0, otherwise: str = "latin") -> str:
    """Script of the last letter before the position, looked for back to `since`."""
    for i in range(at - 1, since - 1, -1):
        if (c := text[i]).isalpha() or (0x0E00 <= ord(c) < 0x0E80 or 0x0900 <= ord(c) < 0x0980) and c != "।":
            o = ord(c)
            for name, a, b in _RANGES:
                if a <= o < b:
                    return name
            return "latin" if o < 0x3000 else "han"
    return otherwise


def _form(text: str) -> list[tuple[int, int]] | None:
    """Fields of a form, or None: at least three parts, two thirds of them labelled."""
    if ":" not in text and "：" not in text:
        return None
    for sign, sep in _SEPARATORS:
        if not any(c in text for c in sign):
            continue
        cuts = [m.span() for m in sep.finditer(text)]
        if len(cuts) < 2:
            continue
        parts = [p for a, b in zip([0, *(c[1] for c in cuts)], [*(c[0] for c in cuts), len(text)], strict=True) if (p := _strip(text, a, b))]
        if len(parts) >= 3 and 3 * sum(bool(_FIELD.match(text, a, b)) for a, b in parts) >= 2 * len(parts):
            return parts
    return None


def _strip(text: str, a: int, b: int) -> tuple[int, int] | None:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return (a, b) if a < b else None


def _fits(rows: Rows, text: str, stop: int, after: int) -> tuple[bool | None, bool]:
    """What the first fitting pair says, and whether one fits."""
    for br, b, a in rows:
        if (b is None or b.search(text, max(0, stop - LOOK), stop)) and (a is None or a.match(text, after)):
            return br, True
    return None, False


def _cased(c: str) -> bool:
    return c.isdigit() or c.lower() != c.upper()


def _tight(text: str, lines: list[int]) -> list[bool]:
    """Of each line break: would the next word have been too long for its line?"""
    width = max(map(len, text.split("\n")))
    return [i - text.rfind("\n", 0, i) + len(_WORD.match(text, i + 1)[1]) > width for i in lines]


def _breaks(text: str, lines: list[int], inner: bool) -> list[int]:
    """Those of the line breaks, none of them decided by a pair, that don't wrap a running sentence.

    Where sentences end inside lines, or lines begin in lower case, line breaks
    wrap; where case shows nothing, they do if every line keeps to the columns that
    text is customarily wrapped at. Among wrapped lines that hold no end, a break
    is one of the layout if the next word would still have fitted.
    """
    tight = _tight(text, lines)
    if text.islower() or text.isupper():
        wraps = max(map(len, text.split("\n"))) < (COLUMNS if inner else NARROW)
    else:
        wraps = inner or any(_WORD.match(text, i + 1)[1][:1].islower() for i in lines)
    if not wraps:
        return lines
    return [] if inner else [i for i, t in zip(lines, tight, strict=True) if not t and not _WORD.match(text, i + 1)[1][:1].islower()]


def _line(text: str, at: int, k: int, rows: Rows, script: str) -> bool | None:
    """Is the line break at `at`, behind text that ends at k, a boundary? None if all such line breaks have to tell."""
    said, fits = _fits(LINES, text, k, at)
    if fits:
        return said
    if text[k - 1] in END:
        return _fits(rows, text, k, at + 1)[0] is not False
    j = _WORD.match(text, at + 1).start(1)
    running = (_cased(text[k - 1]) or text[k - 1] in ",;)'’%°\"»”") and (_cased(text[j]) or text[j] in "«\"(“") and script == "latin"
    return None if running else True


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit, 0-based, end exclusive."""
    if not _LETTER.search(text):
        return [u] if (u := _strip(text, 0, len(text))) else []
    if (fields := _form(text)) is not None:
        return fields
    quotes = [m.span() for m in _QUOTES.finditer(text)] if _HAS_QUOTE.search(text) else []
    loud, languages = text.isupper(), None
    cuts: list[int] = []
    lines: list[int] = []
    inner = False
    script, since, q = "latin", 0, 0
    for m in (_POSSIBLE_THAI if _THAI.search(text) else _POSSIBLE).finditer(text):
        at, end = m.start(), m.end()
        while q < len(quotes) and quotes[q][1] <= at:
            q += 1
        quote = quotes[q] if q < len(quotes) and quotes[q][0] < at < quotes[q][1] else None
        if quote and (end < quote[1] or text[at] == "\n"):
            continue
        script, since = _script(text, at, since, script), at
        if text[at] == "\n":
            k = at
            while k and text[k - 1].isspace():
                k -= 1
            if not k:
                continue
            languages = languages or shown(text)
            said = _line(text, at, k, cascade(script, languages, loud), script)
            if said is None:
                lines.append(at)
            elif said:
                cuts.append(at)
            continue
        mark = text[at] in END
        if mark and quote:
            if _fits(QUOTED_LOUD if loud else QUOTED, text, end, end)[0]:
                cuts.append(end)
            continue
        own = "thai" if not mark and text[at].isspace() else script
        if own == "thai" and mark and text[at] == "." and end < len(text) and text[end] != "\n":
            continue  # the space behind it is held against the table
        j = end
        while j < len(text) and text[j].isspace():
            j += 1
        if not mark and own == "thai" and not _THAI.search(text, max(0, at - 12), at):
            continue
        stop = at if not mark else end
        if own != "thai" and mark and (text[at] not in ".…" or own == "latin" and at >= PLAIN and text[at - PLAIN : at].isalpha()):
            said = True  # only the last pair can fit: another mark, or a word longer than any that a stop shortens
        else:
            languages = languages or shown(text)
            said = _fits(cascade(own, languages, loud), text, stop, j)[0]
        if said:
            cuts.append(stop)
            if j < len(text) and "\n" not in text[end:j]:
                inner = True
    if lines:
        cuts = sorted([*cuts, *_breaks(text, lines, inner)])
    out: list[tuple[int, int]] = []
    last = 0
    for cut in [*cuts, len(text)]:
        if u := _strip(text, last, cut):
            if out and not _WORDS.search(text, *u):
                out[-1] = (out[-1][0], u[1])
            else:
                out.append(u)
        last = max(last, cut)
    if len(out) > 1 and not _WORDS.search(text, *out[0]):
        out[:2] = [(out[0][0], out[1][1])]
    return out


SCHEMA = T.StructType([T.StructField("row_id", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, starts, ends = [], [], []
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for a, b in units(text):
                ids.append(row)
                starts.append(a + 1)
                ends.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["row_id", "start_pos", "end_pos"])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(units(t)) for t in batch.column(1).to_pylist()], pa.int32())], names=["report_id", "segment_count"])


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return spread(df.select(F.col(key).cast("string").alias("row_id"), F.col(text).alias("text")).where("row_id IS NOT NULL AND text IS NOT NULL"))


def split(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per sentence unit of each row: key as row_id, 1-based start_pos and end_pos in code points."""
    return _texts(df, key, text).mapInArrow(_cut, SCHEMA)


def found(reports: DataFrame) -> DataFrame:
    """p1_found: the sentence units of every distinct report.

    Copies fall away among the units, which are smaller than the texts; a
    report_id with differing texts has the units of all of them.
    """
    return split(reports, "report_id", "raw_text").distinct().select(F.col("row_id").alias("report_id"), "start_pos", "end_pos")


def counts(reports: DataFrame) -> DataFrame:
    """report_id and the segment_count that follows from its units; a row for each count that differing texts of one report_id have."""
    return _texts(reports, "report_id", "raw_text").mapInArrow(_number, "report_id string, segment_count int").where("segment_count > 0").distinct()
