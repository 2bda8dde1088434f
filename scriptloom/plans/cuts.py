"""Where a word can be cut: between characters of which neither's reading needs more of the other's side than what stands next to it.

A word is written in classes, one for each character; a pattern over these
finds its pieces.  A letter can begin and end a piece if every reading of it
ends in a letter; a virama behind a letter and a vowel sign can end one.  No
piece ends inside of the source of a rule.  Numerals, braille, Thai, Tibetan
and Han, and whatever else isn't listed, stay with what is beside them.
"""

from __future__ import annotations

from functools import cache

from . import char_tables
from .rules import RULES

#: Classes: a letter that no rule goes on from or to, goes on from, to, or both; a vowel sign, a virama, a numeral, other ASCII.
FREE, FROM, TO, BOTH, VOWEL, VIRAMA, NUMERAL, ASCII = "sfgbwvnd"
#: Words with one of these are never cut: the signs of braille hold on over any distance.
BRAILLE = "[⠀-⣿]"
#: Scripts whose letters look further than to what stands next to them, or have no reading of their own.
_FAR = frozenset("THAI TIBETAN BRAILLE CJK MODIFIER".split())
#: Kana that are read by, or with, the ones beside them.
_KANA = "っッーゃゅょャュョ"
#: Code points from which letters are listed no more, beside kana.
_END, _KANA_BLOCK = 0x2E00, range(0x3041, 0x30FF)
_L = f"[{FREE}{FROM}{TO}{BOTH}{ASCII}]"
#: A piece of two characters or more, up to where the next can begin.
PIECE = f"(?s).{{1,2}}(?:(?!(?:(?<=[{FREE}{TO}{VOWEL}{ASCII}]){_L}|(?<=[{FROM}{BOTH}])[{FREE}{FROM}{ASCII}]|(?<=[{FREE}{FROM}{TO}{BOTH}]{VIRAMA}){_L})).)*"


@cache
def classes() -> tuple[str, str]:
    """Characters, and the class of each."""
    goes_on, follows = {c for s, *_ in RULES for c in s[:-1]}, {c for s, *_ in RULES for c in s[1:]}
    # a rule that isn't read as a letter, or that has a second reading
    odd = {s[-1] for s, t, *_ in RULES if not t[-1:].isalpha()} | {c for s, _, _, _, *more in RULES if more and more[0] for c in s}
    found = {chr(cp): ASCII for cp in range(0x80)}
    rows = [(ord(c), "Ll", "LATIN", "letter", c, None, None, None, None, False, False) for c in map(chr, range(0x80)) if c.isalpha()]
    for cp, category, script, kind, rom, _, value, _, fraction, *_ in (*rows, *char_tables.character_rows()):
        c, read = chr(cp), chr(cp) if rom is None else rom
        if value is not None or fraction is not None:
            found[c] = NUMERAL
        elif script in _FAR or c in odd or c in _KANA or (cp >= _END and cp not in _KANA_BLOCK):
            continue
        elif kind == "letter" and category[0] == "L" and read[-1:].isalpha():
            found[c] = {(False, False): FREE, (True, False): FROM, (False, True): TO, (True, True): BOTH}[c in goes_on, c in follows]
        elif script in char_tables.ABUGIDAS and c not in goes_on:
            if kind == "virama":
                found[c] = VIRAMA
            elif kind == "vowel sign" and read[-1:].isalpha():
                found[c] = VOWEL
    found |= {c: NUMERAL for c in char_tables.HAN_NUMERALS}
    return "".join(found), "".join(found.values())
