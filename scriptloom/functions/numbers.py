"""Number functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Han numerals.
HAN_DIGITS = {c: i for i, c in enumerate("〇一二三四五六七八九")} | {"零": 0, "两": 2, "兩": 2, "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9}
HAN_UNITS = {"十": 10, "百": 100, "千": 1000, "拾": 10, "佰": 100, "仟": 1000}
HAN_POWERS = {"万": 10**4, "萬": 10**4, "亿": 10**8, "億": 10**8, "兆": 10**12}
#: Numerals that by themselves are words.
NOT_ALONE = "兩參参伍陆陸什"
#: Roman numerals.
ROMAN = {"M": 1000, "D": 500, "C": 100, "L": 50, "X": 10, "V": 5, "I": 1}
#: First code points of the decimal digits 0 to 9 of other scripts.
DIGIT_ZEROS = (
    0x0660, 0x06F0, 0x07C0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0DE6, 0x0E50, 0x0ED0, 0x0F20,
    0x1040, 0x1090, 0x17E0, 0x1810, 0x1946, 0x19D0, 0x1A80, 0x1A90, 0x1B50, 0x1BB0, 0x1C40, 0x1C50, 0xA620, 0xA8D0, 0xA900, 0xA9D0, 0xA9F0, 0xAA50, 0xABF0, 0xFF10,
)


def _value_of(char: Column, table: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x).cast("long") if isinstance(x, int) else F.lit(x) for kv in table.items() for x in kv]), char)


def ascii_digits(text: Column) -> Column:
    """Decimal digits of all scripts as 0-9."""
    return F.translate(text, "".join(chr(z + d) for z in DIGIT_ZEROS for d in range(10)), "0123456789" * len(DIGIT_ZEROS))


#: A composed number: places in the run, its text, and its value where it has one.
NUMBER = "struct<start:int,end:int,txt:string,value:double>"
_ITEM = re.compile(r"[0-9]+(?:\.[0-9]+)?|.", re.DOTALL)


def plain_text(value: Column) -> Column:
    """A decimal without zeros after its last digit."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


@dataclass(slots=True)
class _Open:
    """A number that more may be added to: what large powers gave so far, the block below them, and the ones that wait for a unit.

    Values are whole numbers, or decimals where digits have a point or are many.
    """

    start: int
    middle: int
    total: int | Decimal | None = None
    total_base: int = 0
    block: int | Decimal | None = None
    block_base: int = 0
    low: int | Decimal | None = None
    low_txt: str | None = None
    tag: bool = False
    parts: int = 0

    def texts(self, end: int) -> Iterator[tuple[int, int, str, float]]:
        if not self.parts:
            return
        shown = lambda v: str(v) if isinstance(v, int) else f"{v.normalize():f}"
        low = self.low
        if self.tag and self.block is None and low is not None and 1 <= low <= 9 and self.total_base >= 1000:
            low = low * self.total_base // 10  # a tag is a Han digit, a large power a multiple of ten
        rest = None if self.block is None and low is None else (self.block or 0) + (low or 0)
        if self.total is not None and rest is not None and self.total_base <= max(rest, self.block_base):
            yield self.start, self.middle, shown(self.total), float(self.total)
            yield self.middle, end, shown(rest), float(rest)
            return
        whole = (self.total or 0) + (rest or 0)
        yield self.start, end, self.low_txt if self.parts == 1 and self.low_txt else shown(whole), float(whole)

    def fits(self, value: int | Decimal, base: int, digits: bool) -> bool:
        above = self.block_base if self.block is not None else self.total_base
        if not self.parts:
            return True
        if base < 10:
            return (self.low is None and above > max(value, 1)) or (self.low == 0 and not digits and (above or 1000000) > value)
        if base < 10000:
            own = self.low * value if self.low is not None and self.low >= 1 else value
            return (self.low is None or self.low >= 1) and (self.block is None or (self.block_base > own and self.block_base > base))
        return (self.block or 0) + (self.low or 0) > 0 and (self.total is None or self.total_base > base)

    def take(self, at: int, end: int, value: int | Decimal, base: int, text: str | None, tag: bool) -> None:
        if base < 10000 and self.block is None and self.low is None:
            self.middle = at
        if base < 10:
            self.low, self.low_txt, self.tag = value, text, tag and self.total is not None
        elif base < 10000:
            own = self.low * value if self.low is not None and self.low >= 1 else value
            self.block, self.block_base, self.low, self.low_txt = (self.block or 0) + own, base, None, None
        else:
            below = None if self.block is None and self.low is None else (self.block or 0) + (self.low or 0)
            self.total, self.total_base = (self.total or 0) + (value if below is None else below * value), base
            self.block, self.block_base, self.low, self.low_txt, self.middle = None, 0, None, None, end
        self.parts += 1


#: Digits up to which a number is counted in whole numbers.
_WHOLE = 15


def compose(run: str, values: list[int | None], bases: list[int | None], fractions: list[str | None]) -> list[tuple[int, int, str, float | None]]:
    """The numbers of one run of numerals, as ``composed`` describes them."""
    found: list[tuple[int, int, str, float | None]] = []
    number, at = _Open(0, 0), 0
    with localcontext() as context:
        context.prec = 200
        for m in _ITEM.finditer(run):
            at, end, text = m.start(), m.end(), m[0]
            digits = "0" <= text[0] <= "9"
            value, base, fraction = values[at], bases[at], fractions[at]
            if digits:
                value, base, fraction = int(text) if len(text) <= _WHOLE and text.isdecimal() else Decimal(text), 1, None
            if fraction or value is None or not number.fits(value, base, digits):
                found += number.texts(at)
                number = _Open(at, at)
            if fraction:
                found.append((at, end, fraction, None))
            if fraction or value is None:
                number = _Open(end, end)
                continue
            before = values[at - 1] if at else None
            number.take(at, end, value, base, text if digits else None, not digits and value > 0 and bool(before))
        found += number.texts(len(run))
    return found


def _runs(pos: list[int], native: list[bool], start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Runs of numerals from ``start`` to ``stop`` that stand side by side and have one beyond ASCII."""
    for i in range(start, stop):
        if i + 1 == stop or pos[i + 1] != pos[i] + 1:
            if any(native[start : i + 1]):
                yield start, i + 1
            start = i + 1


def composed(numerals: Column) -> Column:
    """The numbers of runs of numerals: array of NUMBER.

    ``numerals`` are (pos, numeral, value, base, fraction, native) in order:
    ``numeral`` is 0-9 for decimal digits of all scripts, or a point inside of
    them; base 1 is for what counts ones, 10, 100 and so on for units and for
    what counts them, from 10000 on for large powers; native is what isn't ASCII.
    Digits stand together, a unit takes the ones before it, smaller units add to
    larger ones in a block, a large power takes its block, and smaller powers add
    to larger ones.  What doesn't fit begins a new number.  A single Han digit
    after a large power counts its tenth.  Null has no numbers.

    Numerals are few: the loop over rows in Python is for the numerals of
    different words, not for whole texts.
    """

    @F.arrow_udf(f"array<{NUMBER}>")
    def read(column: pa.Array) -> pa.Array:
        # the fields of all numerals as flat lists: one object for each field of each numeral would take most of the time
        fields = dict(zip([f.name for f in column.type.value_type], column.flatten().flatten(), strict=True))
        pos, numeral, values, bases, fractions, native = (fields[k].to_pylist() for k in ("pos", "numeral", "value", "base", "fraction", "native"))
        found, ends, start = [], [0], 0
        for n in column.value_lengths().to_pylist():
            stop = start + (n or 0)
            for a, b in _runs(pos, native, start, stop):
                numbers = compose("".join(numeral[a:b]), values[a:b], bases[a:b], fractions[a:b])
                found += [(pos[a] + s, pos[a] + e, txt, value) for s, e, txt, value in numbers]
            ends.append(len(found))
            start = stop
        names, kinds = ("start", "end", "txt", "value"), (pa.int32(), pa.int32(), pa.string(), pa.float64())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True) if found else [()] * 4, kinds, strict=True)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))

    return read(numerals)


#: Numerals up to which runs go in step; longer ones are few.
_IN_STEP = 64


@cache
def han_places() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point the number of a Han numeral, from 1; and by that number its value and its base."""
    bases = dict.fromkeys(HAN_DIGITS, 1) | HAN_UNITS | HAN_POWERS
    places = np.zeros(0x110000, np.uint8)
    places[[ord(c) for c in bases]] = 1 + np.arange(len(bases))
    return places, np.array([0, *(HAN_DIGITS | HAN_UNITS | HAN_POWERS).values()]), np.array([0, *bases.values()])


def _texts_in_step(state: tuple[np.ndarray, ...], end: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """``_Open.texts`` of many numbers of Han numerals."""
    start, middle, total, total_base, block, block_base, low, tag = state
    low = np.where(tag & (block < 0) & (low >= 1) & (total_base >= 1000), low * total_base // 10, low)
    rest = np.maximum(block, 0) + np.maximum(low, 0)
    two = (total >= 0) & ((block >= 0) | (low >= 0)) & (total_base <= np.maximum(rest, block_base))
    whole = np.where(two, total, np.maximum(total, 0) + rest)
    return [(start, np.where(two, middle, end), whole), (middle[two], end[two], rest[two])]


def compose_han(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, value) of the numbers of many runs of Han numerals, in order: ``compose`` with a step for the k-th numeral of all runs.

    Values stay below 10^17, so they are whole numbers of 64 bits.
    """
    places, values, bases = han_places()
    found, size = [], ends - begins
    long = size > _IN_STEP
    for a, b in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
        at = places[codes[a:b]]
        numbers = compose("".join(map(chr, codes[a:b].tolist())), values[at].tolist(), bases[at].tolist(), [None] * (b - a))
        found.append(tuple(np.array(x, np.int64) for x in zip(*((a + s, a + e, int(txt)) for s, e, txt, _ in numbers), strict=True)))
    order = np.flatnonzero(~long)[np.argsort(-size[~long], kind="stable")]
    begin, end, size = begins[order], ends[order], size[order]
    n = len(order)
    none, no_base = (lambda: np.full(n, -1)), (lambda: np.zeros(n, np.int64))
    # -1 is none
    state = start, middle, total, total_base, block, block_base, low, tag = begin.copy(), begin.copy(), none(), no_base(), none(), no_base(), none(), np.zeros(n, bool)
    for k in range(size[0] if n else 0):
        # the longest stand first
        m = np.searchsorted(-size, -k)
        at = begin[:m] + k
        v, b = values[places[codes[at]]], bases[places[codes[at]]]
        ones, large = b < 10, b >= 10000
        st, mid, t, tb, bl, bb, lo, tg = (x[:m] for x in state)
        if k:
            above, own, below = np.where(bl >= 0, bb, tb), np.where(lo >= 1, lo * v, v), np.maximum(bl, 0) + np.maximum(lo, 0)
            fits_ones = ((lo < 0) & (above > np.maximum(v, 1))) | ((lo == 0) & (np.where(above == 0, 1000000, above) > v))
            fits_block = (lo != 0) & ((bl < 0) | ((bb > own) & (bb > b)))
            fits_large = (below > 0) & ((t < 0) | (tb > b))
            ended = np.flatnonzero(~np.where(ones, fits_ones, np.where(large, fits_large, fits_block)))
            if len(ended):
                found += _texts_in_step(tuple(x[ended] for x in state), at[ended])
                for x, new in zip((st, mid, t, tb, bl, bb, lo, tg), (at[ended], at[ended], -1, 0, -1, 0, -1, False), strict=True):
                    x[ended] = new
        own, below = np.where(lo >= 1, lo * v, v), np.maximum(bl, 0) + np.maximum(lo, 0)
        nothing = (bl < 0) & (lo < 0)
        mid[:] = np.where(large, at + 1, np.where(nothing, at, mid))
        tg[:] = np.where(ones, (v > 0) & (t >= 0) & (values[places[codes[at - 1]]] > 0 if k else False), tg)
        t[:], tb[:] = np.where(large, np.maximum(t, 0) + np.where(nothing, v, below * v), t), np.where(large, b, tb)
        bl[:], bb[:] = np.where(ones, bl, np.where(large, -1, np.maximum(bl, 0) + own)), np.where(ones, bb, np.where(large, 0, b))
        lo[:] = np.where(ones, v, -1)
    found += _texts_in_step(state, end)
    starts, stops, whole = (np.concatenate([x[i] for x in found]) for i in range(3))
    order = np.argsort(starts, kind="stable")
    return starts[order], stops[order], whole[order]


def han_number(text: Column) -> Column:
    """Value of a Han numeral such as 三万一千 (31000); strings of digits such as 二〇〇六 read as digits.

    Null if it is none, as powers that rise or repeat aren't, or if it is too large for a long.
    """

    @F.arrow_udf("long")
    def read(column: pa.Array) -> pa.Array:
        texts = [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]
        begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        others = np.concatenate([[0], np.cumsum(han_places()[0][codes] == 0)])
        rows = np.flatnonzero((np.diff(begins) > 0) & (np.diff(others[begins]) == 0))
        start, end, value = compose_han(codes, begins[rows], begins[rows + 1])
        row = np.searchsorted(begins, start, "right") - 1
        whole = (start == begins[row]) & (end == begins[row + 1])
        values = np.zeros(len(texts), np.int64)
        values[row[whole]] = value[whole]
        return pa.array(values, mask=~np.isin(np.arange(len(texts)), row[whole]))

    digits_only = text.rlike("^[" + "".join(HAN_DIGITS) + "]+$")
    plain = F.array_join(F.transform(F.split(text, ""), lambda c: _value_of(c, HAN_DIGITS).cast("string")), "").try_cast("long")
    return F.when(digits_only, plain).otherwise(read(text))


def roman_value(text: Column) -> Column:
    """Value of a well-formed Roman numeral up to 3999, else null."""
    upper = F.upper(text)
    values = F.transform(F.split(upper, ""), lambda c: _value_of(c, ROMAN))
    total = F.aggregate(values, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("last")), lambda a, v: F.struct((a.sum + v - F.when(a.last < v, 2 * a.last).otherwise(0)).alias("sum"), v.alias("last")), lambda a: a.sum)
    well_formed = upper.rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (F.length(upper) > 0)
    return F.when(well_formed, total)


def rounded(value: Column, places: int) -> Column:
    """Half away from zero, as decimal with ``places`` digits; null where that is no decimal of 38 digits."""
    return F.round(value.try_cast("decimal(38,10)"), places).try_cast(f"decimal(38,{places})")


def with_commas(value: Column) -> Column:
    """An integer with thousands separators."""
    return F.regexp_replace(value.try_cast("decimal(38,0)").cast("string"), r"(?<=\d)(?=(?:\d{3})+$)", ",")


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    return F.when(whole == 0, F.lit("n/a")).otherwise(F.concat(rounded(part * 100 / whole, places).cast("string"), F.lit("%")))


def parsed(text: Column) -> Column:
    """The number that ``text`` writes out in digits, as decimal; null if it is none."""
    return F.when(text.rlike(r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\s*$"), F.trim(text).try_cast("decimal(38,10)"))


def plain_number(text: Column) -> Column:
    """Scientific notation written out digit by digit; anything else as it is."""
    pattern = r"^([+-]?)([0-9]+)(?:\.([0-9]*))?[eE]([+-]?[0-9]{1,4})$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    shift, digits, ahead = part(4).try_cast("int"), F.concat(part(2), part(3)), F.length(part(2))
    point = ahead + shift
    left = F.when(point <= 0, F.lit("0")).when(point >= F.length(digits), F.rpad(digits, point, "0")).otherwise(F.substring(digits, F.lit(1), point))
    right = F.when(point <= 0, F.lpad(digits, F.length(digits) - point, "0")).when(point >= F.length(digits), F.lit("")).otherwise(F.substring(digits, point + 1, F.length(digits)))
    left, right = F.regexp_replace(left, "^0+(?=[0-9])", ""), F.regexp_replace(right, "0+$", "")
    sign = F.when(part(1) == "-", F.lit("-")).otherwise(F.lit(""))
    return F.when(text.rlike(pattern), F.concat(sign, left, F.when(right == "", F.lit("")).otherwise(F.concat(F.lit("."), right)))).otherwise(text)


#: Denominators of fractions that have characters.
DENOMINATORS = (2, 3, 4, 5, 6, 8, 12, 16, 20, 32, 40, 64, 80, 160, 320)


def common_fraction(value: Column) -> Column:
    """n/d for values within 1e-6 of one with a numerator from 1 to 11 and a denominator of DENOMINATORS, the least numerator first; else null."""
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(d).alias("d")) for n in range(1, 12) for d in DENOMINATORS])
    first = F.get(F.filter(pairs, lambda x: F.abs(x.n / x.d - value) < 1e-6), F.lit(0))
    return F.when(first.isNotNull(), F.concat(first.n.cast("string"), F.lit("/"), first.d.cast("string")))


def fraction_parts(char: Column) -> Column:
    """n/d of a character such as ¾; null for others."""
    table = {chr(cp): unicodedata.normalize("NFKC", chr(cp)).replace("\u2044", "/") for cp in range(0xA0, 0x3000) if unicodedata.decomposition(chr(cp)).startswith("<fraction>")}
    return _value_of(char, {c: t for c, t in table.items() if t[-1] != "/"})


def shown_number(value: Column, fraction: Column) -> Column:
    """Text of a number with a whole part and a fraction, either of which may be null: 3 1/2, 3, 1/2."""
    return F.concat_ws(" ", plain_text(value.cast("decimal(38,5)")), fraction)
