"""Latin letters with marks: folding to base letters as Column expressions.

The tables come from Unicode decompositions; what has none is listed here.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters without a decomposition, by common transliteration.
UNDECOMPOSED = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ĳ": "ij", "Ĳ": "IJ", "þ": "th", "Þ": "TH",
    "ð": "d", "Ð": "D", "đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŋ": "ng", "Ŋ": "NG",
}
#: Letters that a language (ISO 639-3) writes out otherwise.
BY_LANGUAGE = {
    "deu": {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"},
    "tur": {"ö": "oe", "ü": "ue", "Ö": "Oe", "Ü": "Ue", "ş": "sh", "Ş": "Sh", "ç": "ch", "Ç": "Ch", "ğ": "g", "Ğ": "G"},
}
#: Two-letter language codes (ISO 639-1) and their three-letter ones.
LANGUAGE_CODES = {
    "ar": "ara", "be": "bel", "bg": "bul", "de": "deu", "el": "ell", "en": "eng", "es": "spa", "fa": "fas", "fr": "fra", "he": "heb",
    "hi": "hin", "kk": "kaz", "ko": "kor", "ja": "jpn", "ky": "kir", "lt": "lit", "lv": "lav", "mk": "mkd", "mr": "mar", "ne": "nep",
    "ru": "rus", "sr": "srp", "ta": "tam", "th": "tha", "tr": "tur", "ug": "uig", "uk": "ukr", "yi": "yid", "zh": "zho",
}


@cache
def folds() -> dict[str, str]:
    """Letter -> base letters, for Latin, Greek and Cyrillic letters with marks."""
    table = dict(UNDECOMPOSED)
    for cp in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base != c and base and unicodedata.category(c)[0] == "L":
            table.setdefault(c, base)
    return table


def replaced(text: Column, table: dict[str, str]) -> Column:
    """All single-character replacements in one pass, longer ones one by one."""
    short = {k: v for k, v in table.items() if len(v) == 1}
    out = F.translate(text, "".join(short), "".join(short.values())) if short else text
    for k, v in table.items():
        if len(v) != 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def deaccent(text: Column) -> Column:
    """``text`` with Latin, Greek and Cyrillic letters without their marks, case kept; ASCII passes by unchanged."""
    return F.when(is_ascii(text), text).otherwise(replaced(text, folds()))


def deaccent_lower(text: Column) -> Column:
    return F.lower(deaccent(text))


def folded_by(text: Column, table: dict[str, str], lower: bool = False) -> Column:
    """``text`` with the characters of a caller's own table replaced, and before that in lower case if wanted."""
    return replaced(F.lower(text) if lower else text, table)


def romanize_latin(text: Column, lcode: Column | None = None) -> Column:
    """Latin text in base letters, by the habits of the language where it has its own."""
    out = deaccent(text)
    if lcode is not None:
        for code, own in BY_LANGUAGE.items():
            out = F.when(lcode == code, F.when(is_ascii(text), text).otherwise(replaced(replaced(text, own), folds()))).otherwise(out)
    return out


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def language_code(code: Column) -> Column:
    """Three-letter code of a two- or three-letter one."""
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, code), code)
