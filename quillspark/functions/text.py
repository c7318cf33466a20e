"""Scalar text functions: folding, cleaning, measures, redaction.

Functions over Column are JVM expressions unless named ``*_udf`` (Arrow).
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a canonical decomposition, and what stands for them in folded text.
SPECIAL_LETTERS = {
    "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "œ": "oe", "Œ": "OE",
    "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D", "ħ": "h", "ı": "i",
}
# Punctuation that is unified, by what it becomes.
UNIFIED = {
    "'": "\u2018\u2019\u201a\u201b",
    '"': "\u201c\u201d\u201e\u201f\u00ab\u00bb",
    "-": "\u2013\u2014\u2015\u2212\u2010\u2011",
    " ": "\u00a0\u2007\u202f\u2009\u200a\u2002\u2003",
    "\n": "\u2028\u2029",
    "": "\u00ad\ufeff\u200b\u200c\u200d",
}
ELLIPSIS = "\u2026"


class Remembered(dict):
    """The last results of a function of strings. It goes to workers empty and by value, which lru_cache() does not."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __reduce__(self):
        return Remembered, (self.make, self.most)

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.make(*key) if isinstance(key, tuple) else self.make(key)
        return out


class _Folded(dict):
    """What each character is folded to, found when it first occurs. No character depends on those around it, as combining marks go."""

    def __reduce__(self):
        return _Folded, ()

    def __missing__(self, code: int) -> str:
        spelled = unicodedata.normalize("NFKD", SPECIAL_LETTERS.get(chr(code), chr(code)))
        self[code] = folded = "".join(c for c in spelled if not unicodedata.combining(c)).casefold()
        return folded


_FOLDED = _Folded()


def fold_text(text: str) -> str:
    """Compatibility-decomposed, without combining marks, special letters spelled out, case folded."""
    return text.casefold() if text.isascii() else text.translate(_FOLDED)


HANGUL, HANGUL_LAST = 0xAC00, 0xD7A3  # syllables, whose letters follow from their number


def _folds(codes: Iterable[int]) -> tuple[str, str, str, dict[str, str]]:
    """Of the characters: those that become one letter and which, those that vanish, those that become more."""
    one, to, gone, more = [], [], [], {}
    for c in map(chr, codes):
        folded = fold_text(c)
        if not folded:
            gone.append(c)
        elif len(folded) > 1:
            more[c] = folded
        elif folded != c:
            one.append(c)
            to.append(folded)
    return "".join(one), "".join(to), "".join(gone), more


_ONE, _TO, _GONE, _MORE = _folds([*range(0x41, 0x5B), *range(0x80, 0x250), *range(0x300, 0x370)])


def _ranges(codes: list[int]) -> str:
    """A regular expression's class of code points, by ranges: single characters would be tried one after the other."""
    ends = [k for i, k in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != k + 1]
    starts = [k for i, k in enumerate(codes) if i == 0 or codes[i - 1] != k - 1]
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True))


#: What the short way of fold() does not know: other code points, and Latin ones that become more but are no special letters.
_WIDE = "[\\x{250}-\\x{2FF}\\x{370}-\\x{10FFFF}" + _ranges([ord(c) for c in _MORE if c not in SPECIAL_LETTERS]) + "]"


_WIDE_FOLDS: list[tuple[str, str, str, dict[str, str]]] = []


def _wide_folds() -> tuple[str, str, str, dict[str, str]]:
    """Made when they are first asked for."""
    if not _WIDE_FOLDS:
        _WIDE_FOLDS.append(_made_wide_folds())
    return _WIDE_FOLDS[0]


def _made_wide_folds() -> tuple[str, str, str, dict[str, str]]:
    codes = (k for r in (range(0xD800), range(0xE000, 0x110000)) for k in r if not HANGUL <= k <= HANGUL_LAST)
    known = (k for k in codes if (c := chr(k)) != c.casefold() or c in SPECIAL_LETTERS or unicodedata.combining(c) or unicodedata.decomposition(c))
    return _folds(known)


def fold(text: Column) -> Column:
    """fold_text() as a JVM expression, for any text. Most have Latin letters alone and go a short way."""
    short = text
    for c, folded in _MORE.items():
        short = F.replace(short, F.lit(c), F.lit(folded)) if c in SPECIAL_LETTERS else short
    return F.when(text.rlike(_WIDE), _fold_wide(text)).otherwise(F.lower(F.translate(short, _ONE + _GONE, _TO)))


def _fold_wide(text: Column) -> Column:
    """By all characters of Unicode: what becomes one letter by a table, what becomes more as often as a text has different ones."""
    one, to, gone, more = _wide_folds()
    spelled = F.str_to_map(F.lit("\x01".join(f"{c}\x02{folded}" for c, folded in more.items())), F.lit("\x01"), F.lit("\x02"))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("([" + "".join(more) + f"{chr(HANGUL)}-{chr(HANGUL_LAST)}])"), F.lit(1)))
    return F.translate(F.aggregate(found, text, lambda out, c: F.replace(out, c, F.coalesce(F.try_element_at(spelled, c), _jamo(c)))), one + gone, to)


def _jamo(syllable: Column) -> Column:
    """The letters of a Hangul syllable."""
    n = F.ascii(syllable) - HANGUL
    lead = lambda at: F.substr(F.lit("".join(chr(0x1100 + i) for i in range(19))), at + 1, F.lit(1))
    vowel = lambda at: F.substr(F.lit("".join(chr(0x1161 + i) for i in range(21))), at + 1, F.lit(1))
    tail = lambda at: F.when(at == 0, "").otherwise(F.substr(F.lit("".join(chr(0x11A8 + i) for i in range(27))), at, F.lit(1)))
    return F.concat(lead(F.floor(n / 588).cast("int")), vowel(F.floor(n % 588 / 28).cast("int")), tail(n % 28))


def fold_udf():
    """fold_text() over Arrow batches, exact for any text."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else fold_text(t))

    return run


def unify(text: Column) -> Column:
    """Punctuation unified, control characters blank. (NFC is up to clean_udf().)"""
    drop = UNIFIED[""]
    source = "".join(v for k, v in UNIFIED.items() if k)
    target = "".join(k * len(v) for k, v in UNIFIED.items() if k)
    text = F.translate(F.replace(text, F.lit(ELLIPSIS), F.lit("...")), source + drop, target)
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")


#: Steps of white space normalisation, in order; the last two depend on whether paragraphs are kept.
_SPACE_STEPS = [(r"\r\n?", "\n"), (r"(?U)(\w)-\n(\w)", "$1$2"), (r"[ \t\f\r]+", " "), (r"[ \t]+\n", "\n")]


def normalize_space(text: Column, paragraphs: bool = True) -> Column:
    """Unix line ends, hyphenated line breaks joined, runs of blanks single, one empty line at most (none without ``paragraphs``)."""
    for pattern, to in _SPACE_STEPS:
        text = F.regexp_replace(text, pattern, to)
    if paragraphs:
        text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    else:
        text = F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), r"[ \t\f\r]+", " ")
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column) -> Column:
    return normalize_space(unify(text))


_UNIFIED = {ord(c): k for k, v in UNIFIED.items() for c in v}
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
#: The steps in order, but for single blanks, each with what a text must have for it.
_CLEANED = [
    ("\r", re.compile(r"\r\n?"), "\n"), ("-\n", re.compile(r"(\w)-\n(\w)"), r"\1\2"), ("", re.compile(r"[ \t\f\r]{2,}|[\t\f\r]"), " "),
    ("\n", re.compile(r"[ \t]+\n"), "\n"), ("\n\n\n", re.compile(r"\n{3,}"), "\n\n"),
]


def clean_text(text: str) -> str:
    """unify() after NFC and normalize_space(), for single texts such as queries."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace(ELLIPSIS, "...").translate(_UNIFIED)
    text = _CONTROL.sub(" ", text)
    for mark, pattern, to in _CLEANED:
        text = pattern.sub(to, text) if mark in text else text
    return text.strip()


_BLANK = r"(?U)\s"


def alpha_ratio(text: Column) -> Column:
    """Share of letters and digits among characters that aren't white space; 0 without any."""
    solid = F.length(F.regexp_replace(text, _BLANK, ""))
    useful = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return F.when(solid == 0, 0.0).otherwise(useful / solid)


def is_garbage(text: Column, least_ratio: float = 0.45) -> Column:
    """No text, over 2 % replacement characters, or too few letters and digits."""
    solid = F.regexp_replace(text, _BLANK, "")
    broken = F.length(solid) - F.length(F.replace(solid, F.lit("\ufffd"), F.lit("")))
    return (F.length(solid) == 0) | (broken > 0.02 * F.length(solid)) | (alpha_ratio(text) < least_ratio)


def collapse_runs(text: Column, most: int = 3) -> Column:
    """Runs of one character cut to ``most``."""
    return F.regexp_replace(text, r"(?s)(.)\1{%d,}" % most, "$1" * most)


def strip_separators(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\-–—./\\_]", "")


def words(text: Column) -> Column:
    """Latin words and digit runs, in order."""
    return F.regexp_extract_all(text, F.lit("([0-9A-Za-zÀ-ɏ]+)"), F.lit(1))


def tokens(folded: Column) -> Column:
    """Index tokens of folded text: runs of letters, digits and private-use characters."""
    return F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


# Characters that recognition takes for each other.
CONFUSIONS = {
    "0": "OoQD", "1": "lI|i", "2": "Zz", "5": "Ss", "6": "Gb", "8": "B", "9": "gq", "O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "B": "8", "Z": "2",
}


def digits_meant(text: Column) -> Column:
    """Letters that recognition puts for a digit as that digit, where it is the only one."""
    letters = {c: d for c, d in CONFUSIONS.items() if not c.isdigit()}
    return F.translate(text, "".join(letters), "".join(letters.values()))


def cleaned_lower(text: Column) -> Column:
    """Cleaned and in lower case, letters with their marks."""
    return F.lower(clean(text))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Polish plural form for a count."""
    low = (n % 10).between(2, 4) & ~(n % 100).between(12, 14)
    return F.when(n == 1, one).when(low, few).otherwise(many)


SIZE_UNITS = ("KB", "MB", "GB", "TB", "PB")


def _tenths(n: Column, bits: int) -> Column:
    """n / 2 ** bits in tenths, of ties the even one, as printf rounds the double. In whole numbers: a double's shortest digits may show a tie that is none."""
    n = n.cast("double").cast("long")
    rest = n.bitwiseAND(2**bits - 1) * 10
    tenths, left, half = F.shiftright(n, bits) * 10 + F.shiftright(rest, bits), rest.bitwiseAND(2**bits - 1), 2 ** (bits - 1)
    return tenths + ((left > half) | ((left == half) & (tenths % 2 == 1))).cast("long")


def human_size(n: Column, units: tuple[str, ...] = SIZE_UNITS) -> Column:
    """Bytes in the largest of the units that leaves one or more, one decimal with a comma from KB on."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(units, 1):
        shown = F.regexp_replace(_tenths(n, 10 * power).cast("string"), "(.)$", ",$1")
        out = F.when(n >= 1024**power, F.concat(shown, F.lit(" " + unit))).otherwise(out)
    return out


# What stands for masked text, and the keys whose values are masked or only measured.
MASK = "[usunieto]"
MASKED_KEYS = frozenset(
    """access_token refresh_token id_token authorization auth password passwd secret client_secret api_key apikey token credential credentials cookie set-cookie
    x-api-key proxy-authorization query query_text search_query embedding vector""".split()
)
MEASURED_KEYS = frozenset("content text body snippet chunk_text document_text full_text".split())
#: Patterns that are masked, in order, and what replaces them.
MASKED_PATTERNS = [
    (r"(?i)\bbearer\s+[A-Za-z0-9._\-+/=]{8,}", f"Bearer {MASK}"),
    (r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\b", MASK),
    (r"(?i)\b(access_token|refresh_token|id_token|client_secret|password|api[_-]?key|token)\s*[=:]\s*[\"']?([^\s\"',;&]{4,})", f"$1={MASK}"),
    (r"\b[A-Fa-f0-9]{40,}\b", MASK),
]


def redact(text: Column, most: int = 200) -> Column:
    """Secrets masked, long texts cut with a count of what was cut."""
    for pattern, to in MASKED_PATTERNS:
        text = F.regexp_replace(text, pattern, to)
    cut = F.concat(F.substring(text, 1, most), F.lit("...[+"), (F.length(text) - most).cast("string"), F.lit(" znak\u00f3w]"))
    return F.when(F.length(text) > most, cut).otherwise(text)


# Levels of nesting and entries of a list that are shown.
MOST_LEVELS, MOST_ENTRIES = 4, 20


def redact_json(text: Column):
    """A JSON text with every value redacted by its key, at any depth: masked, measured or searched for secrets; null if it is no JSON."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if t is None else _redacted_json(t))

    return run(text)


def _redacted_json(text: str) -> str | None:
    try:
        return json.dumps(redacted("", json.loads(text)), ensure_ascii=False)
    except ValueError:
        return None


def redacted(key: str, value: object, level: int = 0) -> object:
    """A value as diagnostics may show it."""
    name = key.lower()
    if name in MEASURED_KEYS:
        return f"<{len(value)} znaków>" if hasattr(value, "__len__") else MASK
    if name in MASKED_KEYS or level > MOST_LEVELS + 1:
        return MASK
    match value:
        case dict():
            return {k: redacted(str(k), v, level + 1) for k, v in value.items()}
        case list() | tuple():
            return [redacted(key, v, level + 1) for v in value[:MOST_ENTRIES]]
        case None | bool() | int() | float():
            return value
    return redacted_text(str(value))


def redacted_text(text: str, most: int = 200) -> str:
    """redact() for single texts."""
    for pattern, to in MASKED_PATTERNS:
        text = re.sub(pattern, to.replace("$", "\\"), text)
    return text if len(text) <= most else f"{text[:most]}...[+{len(text) - most} znaków]"


def redact_map(values: Column) -> Column:
    """redact() over a map of strings, by key: masked, measured or searched for secrets."""

    def one(key: Column, value: Column) -> Column:
        lower = F.lower(key)
        return (
            F.when(lower.isin(*MEASURED_KEYS), F.concat(F.lit("<"), F.length(value).cast("string"), F.lit(" znak\u00f3w>")))
            .when(lower.isin(*MASKED_KEYS), MASK)
            .otherwise(redact(value))
        )

    return F.transform_values(values, one)


def safe_url(url: Column) -> Column:
    """Without fragment, the query masked."""
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    return F.when(F.contains(bare, F.lit("?")), F.concat(F.split_part(bare, F.lit("?"), F.lit(1)), F.lit("?[parametry usuni\u0119te]"))).otherwise(bare)


def file_name(raw: Column, fallback: str, most: int = 120) -> Column:
    """A name safe for file systems."""
    name = F.regexp_replace(F.regexp_replace(raw, r'[<>:"/\\|?*\x00-\x1F]', "_"), r"^[\s.]+|[\s.]+$", "")
    return F.when(F.length(name) == 0, fallback).otherwise(F.substring(name, 1, most))
