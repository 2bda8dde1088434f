"""Texts read where they are: the readings of pieces go to the executors, and no text, word or place is shuffled.

Texts are cut into the pieces of ``plans.cuts``, by numpy over their code
points.  Each different piece is read once, by a job of Spark; while these are
no more than MOST, their readings are sent to every executor, which puts them
in their places.  More of them are left to the joins of ``romanize``.  Numbers,
which are all different, aren't pieces: those in decimal digits are read one for
one, those in Han numerals are composed where they stand.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers
from ..plans import cuts

#: Different pieces, and characters in all of them, that executors hold the readings of at most.
MOST, MOST_CHARACTERS = 300_000, 6_000_000
#: Bytes of text that are cut at a time; pieces that a task remembers having given.
SLICE, REMEMBERED = 1 << 18, 500_000
PIECE = "ta long, tb long, token string, lcode string"
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_UNKNOWN = 0x110000
#: Before a negative and a positive number.
MINUS, PLUS = "负負−－", "＋"


@dataclass(frozen=True)
class Signs:
    """By code point: the class of ``plans.cuts``, whether words end there, whether a word with it is looked up, whether it is a decimal digit; and readings of the others, and of digits, by language."""

    kinds: np.ndarray
    breaks: np.ndarray
    hard: np.ndarray
    digits: np.ndarray
    plain: dict[str, dict[int, bytes]]


def members(characters: str) -> np.ndarray:
    """Which code points a character class without escapes holds."""
    found = np.zeros(_UNKNOWN, bool)
    for first, last, one in re.findall("(?s)(.)-(.)|(.)", characters):
        found[ord(first or one) : ord(last or one) + 1] = True
    return found


@cache
def kinds() -> np.ndarray:
    found = np.zeros(_UNKNOWN, np.uint8)
    for c, kind in zip(*cuts.classes(), strict=True):
        found[ord(c)] = ord(kind)
    return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2^64."""
    of = lambda base: np.cumprod(np.concatenate([np.ones(1, U64), np.full(1 << bits, base, U64)]))
    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


@cache
def _salt(lcode: str | None) -> int:
    return 0 if lcode is None else int.from_bytes(hashlib.blake2b(lcode.encode(), digest_size=8).digest(), "little")


@cache
def _bits() -> np.ndarray:
    """By class, from the lowest bit: begins a piece after any letter; a piece can end behind it; behind it if no rule goes on to the next; begins one there; virama; letter."""
    letter = cuts.FREE + cuts.FROM + cuts.TO + cuts.BOTH
    table = np.zeros(256, np.uint8)
    for i, some in enumerate((letter + cuts.ASCII, cuts.FREE + cuts.TO + cuts.VOWEL + cuts.ASCII, cuts.FROM + cuts.BOTH, cuts.FREE + cuts.FROM + cuts.ASCII, cuts.VIRAMA, letter)):
        table[[ord(k) for k in some]] |= 1 << i
    return table


@dataclass
class Cut:
    """Texts of some rows in parts: pieces, and with ``looked`` false single characters that aren't looked up."""

    text: str
    codes: np.ndarray
    begins: np.ndarray  # of the rows, and the end
    starts: np.ndarray  # of the parts
    looked: np.ndarray
    names: np.ndarray  # of the pieces
    left: np.ndarray  # the piece with what stands beside it
    right: np.ndarray
    around: np.ndarray
    words: np.ndarray  # of nothing but Han numerals, and a sign before them
    ends: np.ndarray


def _of(some: str) -> np.ndarray:
    return np.array([ord(c) for c in some], np.uint32)


def cut(texts: list[str], lcodes: list[str | None], signs: Signs, every: bool) -> Cut:
    """``plans.cuts`` for all of the texts at once; without ``every``, only words with a hard character are cut, and of these no numbers in decimal digits or Han numerals."""
    text = "".join(texts)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    n = len(codes)
    none = np.zeros(0, np.int64)
    if not n:
        return Cut(text, codes, begins, none, none.astype(bool), none.astype(U64), none, none, none, none, none)
    is_break = signs.breaks[codes]
    first = np.empty(n, bool)
    first[0], first[1:] = True, is_break[1:] != is_break[:-1]
    first[begins[:-1][begins[:-1] < n]] = True
    words = np.flatnonzero(first)
    any_of = lambda test: np.logical_or.reduceat(test, words) if test.any() else np.zeros(len(words), bool)
    han = none
    if every:
        looked_word = np.ones(len(words), bool)
    else:
        looked_word = any_of(signs.hard[codes]) & any_of(~signs.digits[codes]) & ~is_break[words]
        numeral = numbers.han_places()[0][codes] > 0
        if numeral.any():
            han = np.flatnonzero(any_of(numeral) & ~any_of(~(numeral | (first & np.isin(codes, _of(MINUS + PLUS))))))
            looked_word[han] = False
    han, han_ends = words[han], np.concatenate([words, [n]])[han + 1]
    if not looked_word.any():
        return Cut(text, codes, begins, np.arange(n), np.zeros(n, bool), none.astype(U64), none, none, none, han, han_ends)
    word = np.cumsum(first) - 1
    kind = signs.kinds[codes]
    bits = _bits()[kind]
    # beside numerals of other scripts, digits and signs can be part of a number
    numeral = any_of(kind == ord(cuts.NUMERAL))
    if numeral.any():
        bits[numeral[word] & (kind == ord(cuts.ASCII))] = 0
    before, before2 = np.concatenate([bits[:1] * 0, bits[:-1]]), np.concatenate([bits[:2] * 0, bits[:-2]])
    # after what ends a piece; after a letter that rules go on from; after a letter and its virama
    ends = ((before >> 1 & bits) | (before >> 2 & bits >> 3) | (before >> 4 & before2 >> 5 & bits)) & 1 != 0
    braille = any_of((codes >= 0x2800) & (codes <= 0x28FF))
    if braille.any():
        ends &= ~braille[word]
    ends |= first
    # a piece has two characters at least, so of places side by side every second is taken
    run = ends & (first | ~np.concatenate([[False], ends[:-1]]))
    place = np.arange(n)
    cuts_ = ends & ((place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0)
    starts = np.flatnonzero(cuts_ | ~looked_word[word])
    looked = looked_word[word[starts]]
    piece = np.flatnonzero(looked)
    start, end = starts[piece], np.concatenate([starts[1:], [n]])[piece]
    at_word_start, at_word_end = first[start], np.concatenate([first, [True]])[end]
    left = np.where(at_word_start, 0, 1 + (before[start] >> 4 & 1).astype(np.int64))
    right = np.where(at_word_end, 0, 1)
    around = left * 2 + right
    power, inverse = _powers(max(20, n.bit_length()))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(_mix(codes.astype(U64) + U64(1)) * power[:n])])
    a, b = start - left, end + right
    salts = np.array([_salt(x) for x in lcodes], U64)[np.searchsorted(begins, start, "right") - 1]
    names = _mix((sums[b] - sums[a]) * inverse[a] + ((b - a) * 8 + around).astype(U64) * U64(0xD6E8FEB86659FD93) + salts)
    return Cut(text, codes, begins, starts, looked, names, a, b, around, han, han_ends)


def _numbers(c: Cut) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of the words of Han numerals: the places of numbers and signs, where what each covers ends, and its text.

    What is no number is left: large powers and a few numerals by themselves, and
    signs that none follows.  A number behind another is set off by a dot.
    """
    signed = np.isin(c.codes[c.words], _of(MINUS + PLUS))
    begins = c.words + signed
    start, end, value = numbers.compose_han(c.codes, begins, c.ends)
    kept = ~((end - start == 1) & ((value > 1000) | np.isin(c.codes[start], _of(numbers.NOT_ALONE))))
    start, end, value = start[kept], end[kept], value[kept]
    inside = np.isin(start, begins, invert=True)
    behind = np.concatenate([[False], inside[1:] & (start[1:] == end[:-1])])[: len(start)]
    shown = pa.array(value).cast(pa.string())
    shown = pc.if_else(pa.array(behind), pc.binary_join_element_wise("·", shown, ""), shown) if behind.any() else shown
    sign = c.words[signed & np.isin(begins, start)]
    minus = pa.array(np.isin(c.codes[sign], _of(MINUS)))
    return np.concatenate([sign, start]), np.concatenate([sign + 1, end]), pa.concat_arrays([pc.if_else(minus, "-", "+").cast(pa.string()), shown])


def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], list[str | None]]]:
    """(first row, texts, languages) of the last two columns, of some SLICE bytes."""
    column = batch.column(batch.num_columns - 2).cast(pa.binary())
    step = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
    firsts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
    for first, end in zip(firsts, firsts[1:], strict=False):
        if end > first:
            texts = [(t or b"").decode("utf-8", "replace") for t in column.slice(first, end - first).to_pylist()]
            yield first, texts, batch.column(batch.num_columns - 1).slice(first, end - first).to_pylist()


def _pieces(rows: DataFrame, signs, every: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            for _, texts, lcodes in slices(batch):
                c = cut(texts, lcodes, signs.value, every)
                names, at = np.unique(c.names, return_index=True)
                new = [i for name, i in zip(names.tolist(), at.tolist(), strict=True) if name not in given]
                if len(given) > REMEMBERED:
                    given.clear()
                given.update(c.names[new].tolist())
                if new:
                    row = (np.searchsorted(c.begins, c.left[new], "right") - 1).tolist()
                    tokens = [c.text[a:b] for a, b in zip(c.left[new].tolist(), c.right[new].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.names[new].view(np.int64)), pa.array(c.around[new].astype(np.int64)), pa.array(tokens, pa.string()), pa.array([lcodes[i] for i in row], pa.string())], names=["ta", "tb", "token", "lcode"])

    return rows.mapInArrow(run, PIECE).distinct()


def ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places first, first + 1 ... of each part, as many as its size."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(first - before[:-1], sizes) + np.arange(before[-1])


@dataclass
class Readings:
    """What was read of the pieces, by their names in order: texts, or lists of edges."""

    names: np.ndarray
    column: pa.Array

    @cached_property
    def firsts(self) -> tuple[np.uint64, np.ndarray]:
        """By the first bits of names, where those that begin with them, or later ones, stand: names are hashes, so few share these bits."""
        bits = len(self.names).bit_length() + 2
        return U64(64 - bits), np.searchsorted(self.names, np.arange(1 << bits, dtype=U64) << U64(64 - bits))

    def of(self, c: Cut) -> np.ndarray:
        last = len(self.names) - 1
        at = np.zeros(len(c.names), np.int64)
        if last >= 0:
            shift, firsts = self.firsts
            at = np.minimum(firsts[c.names >> shift], last)
            behind = np.flatnonzero(self.names[at] < c.names)
            while len(behind):
                at[behind] += 1
                behind = behind[at[behind] <= last]
                behind = behind[self.names[at[behind]] < c.names[behind]]
            at = np.minimum(at, last)
        if len(c.names) and not (last >= 0 and (self.names[at] == c.names).all()):
            raise ValueError("the texts aren't those whose pieces were read: the rows given aren't the same each time they are computed")
        return at


def read(rows: DataFrame, signs: Signs, every: bool, found) -> tuple | None:
    """Readings, as a broadcast variable, of all pieces of (text, lcode), the last two columns of ``rows``, as ``found`` gives them for different pieces; None if these are too many."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(signs)
    different = _pieces(rows.select(*rows.columns[-2:]), shared, every).persist()
    try:
        n, size = different.agg(F.count("*"), F.sum(F.length("token"))).first()
        if n > MOST or (size or 0) > MOST_CHARACTERS:
            return None
        table = found(different).toArrow() if n else pa.table({"ta": pa.array([], pa.int64()), "r": pa.array([], pa.string())})
    finally:
        different.unpersist()
    names = table.column(0).to_numpy().view(U64)
    order = np.argsort(names)
    return shared, context.broadcast(Readings(names[order], table.column(1).combine_chunks().take(pa.array(order))))


def with_texts(rows: DataFrame, given: tuple, out_col: str) -> DataFrame:
    """``rows`` without their last two columns (text, lcode), and with the reading of the text."""
    signs, readings = given
    # names with dots aren't found by the function
    numbered = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = readings.value
        known = [(t or "").encode() for t in read.column.to_pylist()]
        plain_at: dict[str, np.ndarray] = {}
        for lcode, table in signs.value.plain.items():
            ids = np.zeros(_UNKNOWN, np.int32)
            ids[list(table)] = len(known) + np.arange(len(table))
            known += table.values()
            plain_at[lcode] = ids
        sizes = np.array([len(t) for t in known], np.int64)
        firsts, blob = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(known), np.uint8)
        for batch in batches:
            for row, texts, lcodes in slices(batch):
                c = cut(texts, lcodes, signs.value, False)
                ids = np.empty(len(c.starts), np.int64)
                ids[c.looked] = read.of(c)
                rest = np.flatnonzero(~c.looked)
                codes = c.codes[c.starts[rest]]
                ids[rest] = plain_at[""][codes]
                if len(plain_at) > 1:
                    of_row = np.searchsorted(c.begins, c.starts[rest], "right") - 1
                    for lcode, table in plain_at.items():
                        own = np.array([x == lcode for x in lcodes])[of_row]
                        ids[rest[own]] = table[codes[own]]
                n, begin, bytes_ = sizes[ids], firsts[ids], blob
                place, end, shown = _numbers(c)
                if len(place):
                    n[np.searchsorted(c.starts, ragged(place, end - place))] = 0
                    at, own = np.searchsorted(c.starts, place), np.frombuffer(shown.buffers()[1], np.int32)[: len(place) + 1].astype(np.int64)
                    n[at], begin[at] = np.diff(own), own[:-1] + len(blob)
                    bytes_ = np.concatenate([blob, np.frombuffer(shown.buffers()[2] or b"", np.uint8)])
                ends = np.concatenate([[0], np.cumsum(n)])
                offsets = ends[np.searchsorted(c.starts, c.begins)].astype(np.int32)
                out = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(bytes_[ragged(begin, n)]))
                yield pa.RecordBatch.from_arrays([*(x.slice(row, len(texts)) for x in batch.columns[:-2]), out], names=[*batch.schema.names[:-2], "read"])

    return numbered.mapInArrow(run, T.StructType([*numbered.schema.fields[:-2], T.StructField("read", T.StringType())])).toDF(*rows.columns[:-2], out_col)


def with_edges(rows: DataFrame, given: tuple, edge: str) -> DataFrame:
    """``rows`` without their last two columns (text, lcode), and with an array of edges in order; places are code points of the text."""
    signs, readings = given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = readings.value
        for batch in batches:
            for row, texts, lcodes in slices(batch):
                c = cut(texts, lcodes, signs.value, True)
                ids = read.of(c)
                rows_at = np.searchsorted(c.starts, c.begins)
                edges = read.column.flatten()
                firsts = read.column.offsets.to_numpy().astype(np.int64)
                n = np.diff(firsts)[ids]
                take, by = ragged(firsts[:-1][ids] - firsts[0], n), np.repeat(c.starts - np.repeat(c.begins[:-1], np.diff(rows_at)), n)
                start, end = (pa.array((edges.field(i).to_numpy()[take] + by).astype(np.int32)) for i in (0, 1))
                txt, kind = (edges.field(i).take(pa.array(take)) for i in (2, 3))
                offsets = np.concatenate([[0], np.cumsum(n)])[rows_at].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([start, end, txt, kind], names=["start", "end", "txt", "type"]))
                yield pa.RecordBatch.from_arrays([*(x.slice(row, len(texts)) for x in batch.columns[:-2]), lists], names=[*batch.schema.names[:-2], "edges"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-2], T.StructField("edges", T._parse_datatype_string(f"array<{edge}>"))]))


def with_sums(rows: DataFrame, given: tuple) -> DataFrame:
    """``rows`` without their last two columns (text, lcode), and with ``read`` and ``sums``: of the (txt, counts) read of the pieces of each text, the texts joined and the counts added."""
    signs, readings = given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, counts = readings.value, None
        for batch in batches:
            for row, texts, lcodes in slices(batch):
                if counts is None:
                    lists = read.column.field("counts")
                    counts = np.ascontiguousarray(lists.flatten().to_numpy().reshape(len(lists), -1).T)
                c = cut(texts, lcodes, signs.value, True)
                ids, rows_at = read.of(c), np.searchsorted(c.starts, c.begins)
                joined = read.column.field("txt").take(pa.array(ids))
                _, offsets, blob = joined.buffers()
                own = np.frombuffer(offsets, np.int32)[rows_at]
                some = np.flatnonzero(np.diff(rows_at))
                sums = np.zeros((len(counts), len(texts)), np.int64)
                if len(some):
                    for of_row, n in zip(sums, counts, strict=True):
                        of_row[some] = np.add.reduceat(n[ids], rows_at[some])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(counts)), pa.array(sums.T.ravel()))
                shown = pa.StringArray.from_buffers(len(texts), pa.py_buffer(own), blob)
                yield pa.RecordBatch.from_arrays([*(x.slice(row, len(texts)) for x in batch.columns[:-2]), shown, lists], names=[*batch.schema.names[:-2], "read", "sums"])

    more = [T.StructField("read", T.StringType()), T.StructField("sums", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-2], *more]))
