"""Dimension tables of characters, derived from Unicode names and categories.

Letter names tell sounds: an abugida's LETTER KA is "ka", an alphabet's letters
BE, EF and ALPHA sound as the consonants or the first vowel of their names.
What a name doesn't tell is listed by script.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from fractions import Fraction
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from ..functions import latin
from ..functions.numbers import DENOMINATORS, HAN_DIGITS, HAN_POWERS, HAN_UNITS

#: Scripts whose consonants carry a vowel that the next sign may remove; all have "a".
ABUGIDAS = frozenset("BENGALI BRAHMI DEVANAGARI GUJARATI GURMUKHI KANNADA KHMER MALAYALAM MODI MYANMAR ORIYA SINHALA SUNDANESE TAMIL TELUGU TIBETAN".split())
SYLLABARIES = frozenset(("ETHIOPIC", "HIRAGANA", "KATAKANA", "CHEROKEE", "CANADIAN", "YI", "VAI", "LINEAR B", "CYPRIOT", "BOPOMOFO"))

#: Sounds of letters by script, in the usual transliteration.
SOUNDS = {
    "cyrillic": dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґђћљњџјѕўѓќ", "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh shch - y - e yu ya yo i yi ye g dj tsh lj nj dzh j dz u g k".split(), strict=True)),
    "greek": {"ύ": "u"} | dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t y ph ch ps o".split(), strict=True)),
    "arabic": dict(zip("ابتثجحخدذرزسشصضطظعغفقكلمنهويىةءآأإؤئپچژگکیھەەۇۆۈۋېڭ", "a b t th j h kh d dh r z s sh s d t z ' gh f q k l m n h w y a a ' a a i u ye p ch zh g k y h e e u oe ue w e ng".split(), strict=True)),
    "hebrew": dict(zip("אבגדהוזחטיכךלמםנןסעפףצץקרשת", "- b g d h v z ch t y k k l m m n n s ' p p ts ts q r sh t".split(), strict=True)),
    "georgian": dict(zip("აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ", "a b g d e v z t i k l m n o p zh r s t u ph k gh q sh ch ts dz ts ch x j h".split(), strict=True)),
    "armenian": dict(zip("աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆև", "a b g d e z e e t zh i l kh ts k h dz gh ch m y n sh o ch p j r s v t r ts w p k o f ev".split(), strict=True)),
    "runic": dict(zip("ᚠᚢᚦᚨᚩᚪᚫᚱᚳᚷᚹᚻᚾᛁᛄᛇᛈᛉᛋᛏᛒᛖᛗᛚᛝᛟᛞᚣᛠᛡᚧ", "f u th a o a ae r c g w h n i j eo p x s t b e m l ng oe d y ea io th".split(), strict=True)),
    "tamil": dict(zip("ட ண ற ள ழ ன".split(), "tta nna ra lla la na".split(), strict=True)),
    "tifinagh": dict(zip("ⴰⴱⴳⴷⴹⴻⴼⴽⵀⵃⵄⵅⵇⵉⵊⵍⵎⵏⵓⵔⵕⵖⵙⵚⵛⵜⵟⵡⵢⵣⵥⵯ", "a b g d d e f k h h ' kh q i j l m n u r r gh s s sh t t w y z z -".split(), strict=True)),
    "ogham": dict(zip("ᚁᚂᚃᚄᚅᚆᚇᚈᚉᚊᚋᚌᚍᚎᚏᚐᚑᚒᚓᚔᚖ", "b l f s n h d t k q m g v z r a o u e i oi".split(), strict=True)) | {"᚛": "-", "᚜": "-", "\u1680": " "},
    "hebrew points": dict(zip("\u05b0\u05b1\u05b2\u05b3\u05b4\u05b5\u05b6\u05b7\u05b8\u05b9\u05ba\u05bb", "e e a o i e e a a o o u".split(), strict=True)),
    "thai": {"อ": "", "ย": "y", "ใ": "ai", "ไ": "ai", "เ": "e", "แ": "ae", "โ": "o", "ะ": "a", "ั": "a", "็": "", "์": "", "ๆ": "", "ฯ": ""},
    "tibetan": {"འ": "'"},
    "oriya": {"ୟ": "ya"},
    "hieroglyphs": dict(zip("𓄿𓇋𓇌𓂝𓅱𓃀𓊪𓆑𓅓𓐝𓈖𓂋𓃭𓉔𓎛𓐍𓄡𓊃𓋴𓈙𓈎𓎡𓎼𓏏𓍿𓂧𓆓𓍯", "a i y ' w b p f m m n r l h h kh kh z s sh q k g t tj d dj o".split(), strict=True)),
    "kana": {"ェ": "e", "ァ": "a", "ィ": "i", "ゥ": "u", "ォ": "o", "を": "o", "ヲ": "o"},
    "punctuation": {"־": "-", "።": ".", "፣": ",", "।": ".", "॥": "||", "。": ". ", "、": ", ", "་": "·", "᛫": " ", "᛬": ".", " ": " ", "«": '"', "»": '"', "։": ".", "՝": ",", "،": ",", "؛": ";", "؟": "?"},
}

#: Dots of the braille letters a to j; the next ten add dot 3, the rest dots 3 and 6.
BRAILLE_DOTS = "1 12 14 145 15 124 1245 125 24 245".split()


#: The digits 1 to 9 and 0 of braille: the letters a to j.
BRAILLE_DIGITS = "".join(chr(0x2800 + sum(1 << (int(d) - 1) for d in dots)) for dots in BRAILLE_DOTS)
BRAILLE_SIGNS = "⠂⠲⠤⠄⠠⠼⠆⠖⠦⠴"


def braille_letters() -> dict[str, str]:
    """Letter -> braille cell, from the decades of the code."""
    cell = lambda dots: chr(0x2800 + sum(1 << (int(d) - 1) for d in dots))
    letters = dict(zip("abcdefghij", map(cell, BRAILLE_DOTS), strict=True)) | {c: cell(d + "3") for c, d in zip("klmnopqrst", BRAILLE_DOTS, strict=True)}
    return letters | {c: cell(d + "36") for c, d in zip("uvxyz", BRAILLE_DOTS, strict=False)} | {"w": cell("2456")}


_VOWELS = "AEIOU"
_NAME = re.compile(r"^(?P<script>.+?) (?:(?:CAPITAL|SMALL|FINAL|DEPENDENT|INDEPENDENT) )*(?P<kind>LETTER|VOWEL SIGN|SYLLABLE|SYLLABICS|VOWEL|CONSONANT SIGN|SUBJOINED LETTER|SIGN|CHARACTER|DIGIT)\b ?(?P<rest>.*)$")


def _sound(label: str, script: str) -> str:
    """What a letter's own name says of its sound."""
    words = re.split(r" WITH | WITHOUT ", label)[0].split(" ")
    # Thai letters are called by their sound and a word that begins with it
    word = words[0] if script == "THAI" and words[0] != "SARA" else words[-1]
    if script in ABUGIDAS or script in SYLLABARIES:
        return word.lower()
    runs = re.findall(rf"[{_VOWELS}]+|[^{_VOWELS}]+", word)
    if not runs:
        return ""
    if len(runs) == 2 and runs[0][0] in _VOWELS:
        return runs[1].lower()
    if runs[0] == "Y" and len(runs) > 1:
        return (runs[0] + runs[1]).lower()
    return runs[0].lower()


@cache
def letter_sounds() -> dict[str, str]:
    table = {c: "" if t == "-" and len(own) > 12 else t for own in SOUNDS.values() for c, t in own.items()}
    table |= {cell: c for c, cell in braille_letters().items()} | {"\u2800": " ", "⠠": "", "⠼": "", "⠂": ",", "⠲": ".", "⠤": "-", "⠄": "'"}
    for c, t in list(table.items()):
        if c.upper() != c and len(c.upper()) == 1:
            table.setdefault(c.upper(), t[:1].upper() + t[1:])
    return table


HAN_NUMERALS = "".join([*HAN_DIGITS, *HAN_UNITS, *HAN_POWERS])
#: Words in the names of numerals that stand by themselves.
_NO_NUMERAL = ("SUPERSCRIPT", "SUBSCRIPT", "CIRCLED", "PARENTHESIZED", "SEGMENTED", "MATHEMATICAL", "ROMAN NUMERAL", "FULL STOP", "COMMA")


def number_properties(c: str) -> tuple[int | None, int | None, str | None]:
    """(value, base, fraction) of a numeral: 500 has the base 100, what counts ones has the base 1."""
    han = {**HAN_DIGITS, **HAN_UNITS, **HAN_POWERS}
    number = han.get(c, unicodedata.numeric(c, None))
    if number is None or any(w in unicodedata.name(c, "") for w in _NO_NUMERAL):
        return None, None, None
    if number == int(number):
        value = int(number)
        base = 1 if value < 10 else 10 ** (len(str(value)) - len(str(value).rstrip("0")))
        return (value, base, None) if value >= 0 and (base > 1 or value < 10) else (None, None, None)
    part = Fraction(number).limit_denominator(max(DENOMINATORS))
    known = "FRACTION" in unicodedata.name(c, "") and abs(part - Fraction(number)) < 1e-6
    return None, None, f"{part.numerator}/{part.denominator}" if known else None


def script_of_name(name: str, known: frozenset[str]) -> str | None:
    """The script that a character's name begins with: words are left off its end until what remains is a known script."""
    words = name.split(" ")
    return next((s for n in range(len(words), 0, -1) if (s := " ".join(words[:n])) in known), None)


def character_row(cp: int) -> tuple | None:
    """(cp, category, script, kind, rom, digit, value, base, fraction, vocalic, decomposed) of a character that isn't ASCII; null rom: it stands for itself."""
    c = chr(cp)
    name, category = unicodedata.name(c, ""), unicodedata.category(c)
    m = _NAME.match(name)
    script = m["script"] if m else name.split(" ")[0]
    digit = unicodedata.digit(c, None) if category == "Nd" else None
    kind, rom, decomposed = "other", None, False
    if category in ("Cf", "Co"):
        kind, rom = "format", ""
    elif digit is not None:
        kind, rom = "digit", str(digit)
    elif m and (m["kind"] == "VOWEL SIGN" or m["rest"].startswith("SARA ")):
        kind, rom = "vowel sign", _sound(m["rest"], script)
    elif "VIRAMA" in name or name.endswith("SIGN COENG") or "SIGN AL-LAKUNA" in name:
        kind, rom = "virama", ""
    elif m and m["kind"] == "CONSONANT SIGN" and "MEDIAL" in name:
        kind, rom = "medial", _sound(m["rest"], script)
    elif m and m["kind"] == "SUBJOINED LETTER":
        kind, rom = "medial", _sound(m["rest"], script)
    elif re.search(r"ANUSVARA|CANDRABINDU|SIGN BINDI|TIPPI", name):
        kind, rom = "tail", "m"
    elif "VISARGA" in name:
        kind, rom = "tail", "h"
    elif category[0] == "M":
        kind, rom = "mark", ""
    elif category[0] == "L" and m:
        kind = "letter"
        rom = _sound(m["rest"], script)
        if "CAPITAL" in name:
            rom = rom[:1].upper() + rom[1:]
        if script not in ABUGIDAS | SYLLABARIES and not rom.isascii():
            rom = None
    if 0x2801 <= cp <= 0x28FF and c not in BRAILLE_SIGNS:
        kind = "letter"
    if c in latin.folds() and latin.folds()[c].isascii():
        rom = latin.folds()[c]
    if c in letter_sounds():
        rom = letter_sounds()[c]
    if rom is None or (kind in ("letter", "other") and c not in letter_sounds()):
        raised = unicodedata.decomposition(c).startswith(("<super>", "<sub>", "<noBreak>"))
        plain = c if raised else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).replace("\u2044", "/")
        if plain != c and all(x.isascii() or x in letter_sounds() for x in plain):
            rom, decomposed = "".join(letter_sounds().get(x, x) for x in plain), unicodedata.decomposition(c).startswith("<")
    if rom is not None and not rom.isascii() and rom not in ("·",):
        rom = None
    return cp, category, script, kind, rom, digit, *number_properties(c), "VOCALIC" in name, decomposed


def in_word(c: str) -> bool:
    """Whether a character is a letter or a mark."""
    return unicodedata.category(c)[0] in "LM"


@cache
def character_rows() -> tuple[tuple, ...]:
    return tuple(character_row(cp) for cp in range(0x80, min(sys.maxunicode + 1, 0x20000)) if unicodedata.category(chr(cp)) not in ("Cn", "Cs") and not 0x3400 <= cp < 0xA000 and not 0xAC00 <= cp < 0xD7A4)


@cache
def signs(*kinds: str) -> str:
    """A pattern of one character of the abugidas that is of one of these kinds."""
    return "^[" + "".join(chr(r[0]) for r in character_rows() if r[2] in ABUGIDAS and r[3] in kinds) + "]$"


def pinyin_rows(spark: SparkSession) -> list[tuple]:
    """Rows of the unified Han block by the Han-Latin rules of the ICU library that Spark ships, without tones.

    Raises where the JVM can't be reached: Han text isn't silently left as it is.
    """
    try:
        convert = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin")
    except (AttributeError, TypeError) as e:
        raise RuntimeError("the table of Han readings needs a session with access to its JVM") from e
    han = [chr(cp) for cp in range(0x4E00, 0xA000)]
    read = convert.transliterate("\n".join(han)).split("\n")
    return [(ord(c), "Lo", "CJK", "letter", toneless_pinyin(t).strip() if t != c else None, None, *number_properties(c), False, False) for c, t in zip(han, read, strict=True) if t != c or number_properties(c) != (None, None, None)]


def toneless_pinyin(t: str) -> str:
    """Pinyin without tone marks, ü as u."""
    return "".join(x for x in unicodedata.normalize("NFD", t) if not unicodedata.combining(x))


_han_words: dict[str, tuple[tuple[str, str], ...]] = {}


def han_words(spark: SparkSession, signs: str) -> tuple[tuple[str, str], ...]:
    """Han numerals and ``signs``, and how each is read where it is no number, or none's."""
    key = spark.sparkContext.applicationId + signs
    if key not in _han_words:
        roms = {row[0]: row[4] for row in (*map(character_row, map(ord, HAN_NUMERALS + signs)), *pinyin_rows(spark))}
        _han_words[key] = tuple((c, c if roms[ord(c)] is None else roms[ord(c)]) for c in HAN_NUMERALS + signs)
    return _han_words[key]


_tables: dict[str, DataFrame] = {}


def characters(spark: SparkSession) -> DataFrame:
    """The rows of ``character_row``: some 70,000, a number that Unicode fixes."""
    key = spark.sparkContext.applicationId
    if key not in _tables:
        rows = [*character_rows(), *pinyin_rows(spark)]
        _tables[key] = spark.createDataFrame(rows, "cp int, category string, script string, kind string, rom string, digit int, value long, base long, fraction string, vocalic boolean, decomposed boolean")
    return _tables[key]


def rejected_numerals(spark: SparkSession) -> DataFrame:
    """(cp, name, number): characters with a numeric value that no number is composed of, such as circled digits."""
    rows = []
    for cp in range(0x80, 0x20000):
        number = unicodedata.numeric(chr(cp), None)
        if number is not None and number_properties(chr(cp)) == (None, None, None):
            rows.append((cp, unicodedata.name(chr(cp), ""), float(number)))
    return spark.createDataFrame(rows, "cp int, name string, number double")


def names(spark: SparkSession) -> DataFrame:
    """(cp, name): the names of all characters that have one, some 140,000."""
    return spark.createDataFrame([(cp, n) for cp in range(sys.maxunicode + 1) if (n := unicodedata.name(chr(cp), ""))], "cp int, name string")
