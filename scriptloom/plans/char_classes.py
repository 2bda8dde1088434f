"""Classes of characters as a table of ranges of code points.

Whole blocks have a class, or belong to a script, of which digits, numbers,
fractions, punctuation and currency signs are told by Unicode's categories.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranges (hexadecimal) and their class; of two for one code point the first counts.
RANGES = """
0009-000D ASCII whitespace
0020-0020 ASCII whitespace
0000-001F ASCII control-character
007F-007F ASCII control-character
0024-0024 ASCII currency
0030-0039 ASCII digit
0041-005A ASCII Latin letter
0061-007A ASCII Latin letter
0000-007F ASCII punctuation
0080-009F non-ASCII control-character
00A0-00A0 non-ASCII whitespace
00A2-00A5 non-ASCII currency
00BC-00BE fraction
00B2-00B3 superscript digit
00B9-00B9 superscript digit
00B5-00B5 non-ASCII Latin letter
00A0-00BF non-ASCII punctuation
00D7-00D7 non-ASCII punctuation
00F7-00F7 non-ASCII punctuation
0132-0133 Latin ligature letter
0152-0153 Latin ligature letter
00C0-024F non-ASCII Latin letter
0250-02FF IPA
0300-036F combining-diacritic
03E2-03EF Coptic letter
0591-05AE Hebrew accent
05BE-05BE Hebrew punctuation
05B0-05BF Hebrew point
05C1-05C2 Hebrew point
05C7-05C7 Hebrew point
05D0-05F2 Hebrew letter
0640-0640 Arabic tatweel
0660-0669 Arabic Indic digit
06F0-06F9 Arabic Indic digit
0700-070F Syriac punctuation
0730-074A Syriac diacritic
08A0-08BF Arabic letter
08C0-08FF other Arabic
09F2-09F9 Bengali currency
0C78-0C7E Telegu fraction
0D58-0D5E Malayalam digit
0D66-0D78 Malayalam digit
0F01-0F14 Tibetan punctuation
0F15-0F1F Tibetan sign
0F20-0F33 Tibetan digit
1680-1680 Ogham whitespace
1100-11FF Korean Hangul letter
1369-1371 Ethiopic digit
1372-137C Ethiopic number
1B61-1B7F Balinese symbol
1D00-1DBF IPA
1E00-1EFF non-ASCII Latin letter
1F00-1FFF Greek letter
2000-200A non-ASCII whitespace
202F-202F non-ASCII whitespace
200B-200B zero-width space
200C-200C zero-width non-space
200D-200D zero-width joiner
200E-200F directional mark
202A-202E directional mark
2010-205E non-ASCII punctuation
2071-2071 superscript letter
207F-207F superscript letter
2070-2079 superscript digit
207A-207E superscript punctuation
2080-2089 subscript digit
208A-208E subscript punctuation
20A0-20BF non-ASCII currency
2100-214F letterlike symbol
2150-215E fraction
2160-217F Roman number
2190-21FF arrow symbol
2200-22FF mathematical operator
2300-23FF technical symbol
2460-24FF enclosed alphanumeric
2500-257F box drawing
25A0-25FF geometric shape
2600-27BF pictograph
2B12-2B2F geometric shape
2B50-2B59 geometric shape
2BBA-2BC8 geometric shape
2BCA-2BCF geometric shape
2B00-2BB9 arrow symbol
2BC9-2BFF symbol
2D80-2DDF Ethiopic syllable
3012-3012 symbol
3020-3020 symbol
3036-3037 symbol
3000-3011 non-ASCII punctuation
3014-301F non-ASCII punctuation
3030-3030 non-ASCII punctuation
303B-303D non-ASCII punctuation
3040-309F Japanese hiragana character
30A0-30FF Japanese katakana character
3100-312F Bopomofo letter
3130-318F Korean Hangul letter
31A0-31BF Bopomofo letter
31C0-31EF CJK stroke
31F0-31FF Japanese kana character
3200-32FF CJK symbol
3371-33DF CJK square Latin abbreviation
33FF-33FF CJK square Latin abbreviation
4E00-9FFF CJK character
A000-A4BF Yi syllable
A700-A721 modifier tone
AC00-D7BF Korean Hangul syllable
F8D0-F8E9 Klingon letter
F8F0-F8F9 Klingon digit
F8FD-F8FE Klingon punctuation
F8FF-F8FF Klingon symbol
E000-EFFF private use character
FB00-FB06 Latin typographic ligature
FB1D-FB4F Hebrew presentation letter
FB50-FDFF Arabic presentation letter
FE70-FEFC Arabic presentation letter
FE10-FE19 non-ASCII punctuation
FE30-FE6B non-ASCII punctuation
FEFF-FEFF byte-order mark/zero-width no-break space
FF04-FF04 fullwidth currency
FF10-FF19 fullwidth digit
FF21-FF3A fullwidth Latin letter
FF41-FF5A fullwidth Latin letter
FF00-FF60 fullwidth punctuation
FF61-FF64 halfwidth Japanese punctuation
FF65-FF9F halfwidth Japanese katakana character
FFE0-FFE6 fullwidth currency
FFFD-FFFD replacement character
10050-1005F Linear B symbol
10000-1005D Linear B syllable
10080-100FF Linear B ideogram
10CFA-10CFF Old Hungarian number
12400-1246F Cuneiform digit
12470-1247F Cuneiform punctuation
12000-1257F Cuneiform sign
13068-13068 Egyptian hieroglyph number
130AD-130B6 Egyptian hieroglyph number
13190-13190 Egyptian hieroglyph number
131BC-131C4 Egyptian hieroglyph number
13362-1336B Egyptian hieroglyph number
13386-13392 Egyptian hieroglyph number
133FA-13403 Egyptian hieroglyph number
13000-1343F Egyptian hieroglyph
1F000-1F02F Mahjong symbol
1F030-1F09F Domino symbol
1F0A0-1F0FF Playing card symbol
1F100-1F1FF enclosed alphanumeric
1F200-1F2FF CJK symbol
1F300-1F6FF pictograph
1F780-1F7FF geometric shape
1F800-1F8FF non-ASCII punctuation
1F900-1FAFF pictograph
20000-2FFFF CJK character
E0000-E007F tag
E0100-E01FF variation selector
F0000-10FFFF private use character
"""
#: Blocks of scripts, and what is in them beside digits, numbers, fractions, punctuation and currency.
SCRIPTS = """
0370-03FF Greek letter
0400-052F Cyrillic letter
0530-058F Armenian letter
0590-05FF Hebrew other
0600-06FF Arabic letter
0710-072F Syriac letter
0780-07BF Thaana letter
0900-097F Devanagari letter
0980-09FF Bengali letter
0A00-0A7F Gurmukhi letter
0A80-0AFF Gujarati letter
0B00-0B7F Oriya letter
0B80-0BFF Tamil letter
0C00-0C7F Telegu letter
0C80-0CFF Kannada letter
0D00-0D7F Malayalam letter
0D80-0DFF Sinhala letter
0E00-0E7F Thai character
0E80-0EFF Lao character
0F00-0FFF Tibetan letter
1000-109F Myanmar letter
10A0-10FF Georgian letter
1200-137F Ethiopic syllable
13A0-13FF Cherokee letter
1400-167F Canadian syllable
1681-169C Ogham letter
16A0-16FF Runic letter
1780-17FF Khmer letter
1800-18AF Mongolian letter
18B0-18FF Canadian syllable
1A00-1A1F Buginese letter
1B00-1B60 Balinese letter
1B80-1BBF Sundanese letter
1C80-1C8F Cyrillic letter
1C90-1CBF Georgian letter
1CC0-1CCF Sundanese punctuation
2C80-2CFF Coptic letter
2D00-2D2F Georgian letter
2D30-2D7F Tifinagh letter
A4D0-A4FF Lisu letter
A640-A69F Cyrillic letter
A980-A9DF Javanese letter
AB00-AB2F Ethiopic syllable
AB70-ABBF Cherokee letter
ABC0-ABFF Meetai Mayek letter
10330-1034F Gothic letter
10900-1091F Phoenician letter
10C80-10CFF Old Hungarian letter
"""
OTHER = "other character"
#: Classes of letters.
LETTERS = r"\b((CJK|hiragana|kana|katakana) character|diacritic|letter|syllable)\b"
#: Code points that one row of the table may cover: characters meet their range under their number divided by it.
BLOCK = 256


def _lines(table: str) -> list[tuple[int, int, str]]:
    rows = [line.split(" ", 1) for line in table.strip().split("\n")]
    return [(int(span.split("-")[0], 16), int(span.split("-")[1], 16), label) for span, label in rows]


def _of_script(cp: int, label: str) -> str:
    """The class of a code point of a script, by its category."""
    script, kind = label.rsplit(" ", 1)
    c = chr(cp)
    category = unicodedata.category(c)
    found = {"Nd": "digit", "No": "number", "Nl": "number", "Sc": "currency"}.get(category, "punctuation" if category[0] == "P" else kind)
    if found == "number" and "FRACTION" in unicodedata.name(c, ""):
        found = "fraction"
    return f"other {script}" if found == "other" or (script == "Arabic" and found == "letter" and category[0] not in "LM") else f"{script} {found}"


@cache
def ranges() -> tuple[tuple[int, int, str], ...]:
    """(first, last, class) in order, disjoint; code points of no class are in none."""
    of: dict[int, str] = {}
    for first, last, label in _lines(SCRIPTS):
        of |= {cp: _of_script(cp, label) for cp in range(first, last + 1)}
    for first, last, label in reversed(_lines(RANGES)):
        of |= dict.fromkeys(range(first, last + 1), label)
    # neighbours of one class have one difference between number and place
    runs = groupby(enumerate(sorted(of)), lambda x: (of[x[1]], x[1] - x[0]))
    return tuple((members[0][1], members[-1][1], label) for (label, _), run in runs if (members := list(run)))


_tables: dict[str, DataFrame] = {}


def table(spark: SparkSession) -> DataFrame:
    """(block, first, last, char_class): a row for each range and block of code points that it touches; some thousands, a number that Unicode fixes."""
    key = spark.sparkContext.applicationId
    if key not in _tables:
        rows = [(block, first, last, label) for first, last, label in ranges() for block in range(first // BLOCK, last // BLOCK + 1)]
        _tables[key] = spark.createDataFrame(rows, "block int, first int, last int, char_class string")
    return _tables[key]


def with_class(df: DataFrame, char_col: str) -> DataFrame:
    """``df`` with char_class and is_letter of the first character of ``char_col``; both null for null and empty text.

    A broadcast hash join on the block of the code point; the range decides among the few rows of a block.
    """
    spans = F.broadcast(table(df.sparkSession)).select(F.col("block").alias("__block"), F.col("first").alias("__first"), F.col("last").alias("__last"), F.col("char_class").alias("__class"))
    rows = df.withColumn("__cp", F.when(F.length(char_col) > 0, F.ascii(char_col)))
    rows = rows.join(spans, (F.floor(F.col("__cp") / BLOCK).cast("int") == F.col("__block")) & F.col("__cp").between(F.col("__first"), F.col("__last")), "left")
    found = F.when(F.col("__cp").isNotNull(), F.coalesce("__class", F.lit(OTHER)))
    return rows.withColumns({"char_class": found, "is_letter": is_letter_class(found)}).drop("__cp", "__block", "__first", "__last", "__class")


def is_letter_class(char_class: Column) -> Column:
    return char_class.rlike(LETTERS)
