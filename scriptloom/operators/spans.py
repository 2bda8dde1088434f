"""Spans of texts that are sources of rules: found along a trie for many texts at once, by numpy over their code points."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import latin
from ..plans import char_tables, rules, trie
from . import in_place

EDGE = "struct<start:int,end:int,txt:string,type:string>"
_CODES = 0x110000


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and where each of them begins, and the end."""
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), begins


class Trie:
    """Numbers of the prefixes of sources; 0 is none."""

    def __init__(self, sources: Iterable[str]):
        self.number: dict[str, int] = {}
        for s in sources:
            for n in range(1, len(s) + 1):
                self.number.setdefault(s[:n], len(self.number) + 1)
        self.first = np.zeros(_CODES, np.int64)
        steps = []
        for s, number in self.number.items():
            if len(s) == 1:
                self.first[ord(s)] = number
            else:
                steps.append((self.number[s[:-1]] << 21 | ord(s[-1]), number))
        self.keys, self.to = np.array(sorted(steps) or [(0, 0)], np.int64).T

    def spans(self, codes: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, numbers) of all spans inside of a text that are prefixes, by length."""
        number = self.first[codes]
        place = np.flatnonzero(number)
        number, end = number[place], begins[np.searchsorted(begins, place, "right")]
        n = 1
        while len(place):
            yield n, place, number
            inside = place + n < end
            place, number, end = place[inside], number[inside], end[inside]
            key = number << 21 | codes[place + n]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            place, number, end = place[found], self.to[at[found]], end[found]
            n += 1


def _from_left(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the spans, in order of their places, are taken from the left: those that begin behind the ones taken before."""
    keep, end = np.ones(len(place), bool), place + size
    reached, free, last = np.flatnonzero(np.maximum.accumulate(end)[:-1] > place[1:]) + 1, 0, -1
    for i in reached.tolist():
        if i - 1 != last:
            free = end[i - 1]
        keep[i] = place[i] >= free
        if keep[i]:
            free = end[i]
        last = i
    return keep


class Replaced:
    """Texts in which, from the left, the longest source at each place, and else a letter, is replaced."""

    def __init__(self, sources: dict[str, str], letters: dict[str, str]):
        self.trie, self.known = Trie(sources), [t.encode() for t in (*sources.values(), *letters.values())]
        self.of_span = np.full(len(self.trie.number) + 1, -1)
        self.of_span[[self.trie.number[s] for s in sources]] = np.arange(len(sources))
        self.of_code = np.full(_CODES, -1)
        self.of_code[[ord(c) for c in letters]] = len(sources) + np.arange(len(letters))

    def texts(self, texts: list[str]) -> pa.Array:
        codes, begins = code_points(texts)
        for code in np.unique(codes[self.of_code[codes] < 0]).tolist():
            self.of_code[code] = len(self.known)
            self.known.append(chr(code).encode())
        ids, size = self.of_code[codes], np.zeros(len(codes), np.int64)
        for n, place, number in self.trie.spans(codes, begins):
            found = self.of_span[number]
            place, found = place[found >= 0], found[found >= 0]
            ids[place], size[place] = found, n
        place = np.flatnonzero(size)
        kept = _from_left(place, size[place]) if len(place) else np.zeros(0, bool)
        # a span that isn't taken leaves its first letter as it is
        ids[place[~kept]] = self.of_code[codes[place[~kept]]]
        inside = np.zeros(len(codes), bool)
        place = place[kept]
        inside[in_place.ragged(place + 1, size[place] - 1)] = True
        starts = np.flatnonzero(~inside)
        sizes = np.array([len(t) for t in self.known], np.int64)
        n = sizes[ids[starts]]
        ends = np.concatenate([[0], np.cumsum(n)])
        blob = np.frombuffer(b"".join(self.known), np.uint8)
        offsets = ends[np.searchsorted(starts, begins)].astype(np.int32)
        return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(blob[in_place.ragged((np.cumsum(sizes) - sizes)[ids[starts]], n)]))


@cache
def _replaced(sources: tuple[tuple[str, str], ...], letters: tuple[tuple[str, str], ...]) -> Replaced:
    return Replaced(dict(sources), dict(letters))


def replaced(text: Column, sources: dict[str, str], letters: dict[str, str]) -> Column:
    """``text`` with, from the left, the longest of ``sources`` at each place, and else a letter, replaced; null stays null."""
    tables = tuple(sources.items()), tuple(letters.items())

    @F.arrow_udf("string")
    def read(column: pa.Array) -> pa.Array:
        own, parts = _replaced(*tables), []
        for first, texts, _ in in_place.slices(pa.RecordBatch.from_arrays([column, pa.nulls(len(column))], names=["text", "lcode"])):
            part = own.texts(texts)
            nulls = column.slice(first, len(texts)).is_valid()
            parts.append(part if nulls.true_count == len(texts) else pa.array([t if ok else None for t, ok in zip(part.to_pylist(), nulls.to_pylist(), strict=True)], pa.string()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return read(text)


class Lattice:
    """The lattice of texts: each letter by its own sound, and each span that is the source of a rule of its language and place.

    What an edge reads doesn't depend on the edges beside it.  Han letters stay
    as they are, as their readings are a table of the JVM.
    """

    def __init__(self) -> None:
        sounds = latin.folds() | char_tables.letter_sounds()
        rows = trie.prefix_rows(rules.RULES)
        self.trie = Trie(s for s, _ in rows)
        self.ids: dict[str, int] = {}
        self.sounds, self.words = sounds, []
        first, count = np.zeros((2, len(self.trie.number) + 1), np.int64)
        txt, place, self.lcodes = [], [], []
        for s, found in rows:
            first[self.trie.number[s]], count[self.trie.number[s]] = len(txt), len(found)
            for t, _, lcodes, where, _ in found:
                txt.append(self._id(t))
                place.append(("", "start", "end", "whole", "mid").index(where))
                self.lcodes.append(lcodes)
        self.first, self.count, self.txt, self.place = first, count, np.array(txt), np.array(place)
        self.own, self.letter, self.orig = np.full(_CODES, -1), np.zeros(_CODES, bool), np.zeros(_CODES, bool)
        self.allowed: dict[str | None, np.ndarray] = {}

    def _id(self, t: str) -> int:
        if t not in self.ids:
            self.ids[t] = len(self.words)
            self.words.append(t)
        return self.ids[t]

    def _fits(self, lcode: str | None) -> np.ndarray:
        """By rule, whether it is of this language."""
        if lcode not in self.allowed:
            self.allowed[lcode] = np.array([not codes or lcode in codes for codes in self.lcodes])
        return self.allowed[lcode]

    def _spans(self, codes: np.ndarray, begins: np.ndarray, lcodes: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, lengths, readings) of the rules that hold."""
        letter = np.concatenate([self.letter[codes], [False]])
        languages = {x: i for i, x in enumerate(dict.fromkeys(lcodes))}
        fits = np.stack([self._fits(x) for x in languages])
        language = np.array([languages[x] for x in lcodes])
        for n, at, number in self.trie.spans(codes, begins):
            place = np.repeat(at, self.count[number])
            rule = in_place.ragged(self.first[number], self.count[number])
            row = np.searchsorted(begins, place, "right") - 1
            before = letter[place - 1] & (place > begins[row])
            after = letter[place + n] & (place + n < begins[row + 1])
            holds = np.choose(self.place[rule], [np.ones(len(place), bool), ~before, ~after, ~before & ~after, before & after]) & fits[language[row], rule]
            yield place[holds], np.full(int(holds.sum()), n), self.txt[rule[holds]]

    def edges(self, texts: list[str], lcodes: list[str | None]) -> pa.ListArray:
        """A list of edges in order for each text; of edges that are the same, one."""
        codes, begins = code_points(texts)
        for code in np.unique(codes[self.own[codes] < 0]).tolist():
            c = chr(code)
            self.own[code] = self._id(self.sounds.get(c, c))
            self.orig[code], self.letter[code] = self.sounds.get(c, c) == c, char_tables.in_word(c)
        own, orig = self.own[codes], self.orig[codes]
        place, size, txt = (np.concatenate(x) for x in zip(*self._spans(codes, begins, lcodes), (np.zeros(0, np.int64),) * 3, strict=True))
        # a rule that reads a letter as its own sound is that edge
        same = (size == 1) & (txt == own[place])
        orig[place[same]] = False
        place, size, txt = place[~same], size[~same], txt[~same]
        different = np.sort(np.unique(np.stack([place, size, txt]), axis=1, return_index=True)[1])
        different = different[np.argsort(place[different], kind="stable")]
        place, size, txt = place[different], size[different], txt[different]
        n, more = len(codes), np.bincount(place, minlength=len(codes))
        before = np.concatenate([[0], np.cumsum(more)])
        letters, spans = np.arange(n) + before[:-1], place + 1 + np.arange(len(place))
        start, end, word, kind = np.empty((4, n + len(place)), np.int32)
        relative = np.arange(n) - np.repeat(begins[:-1], np.diff(begins))
        start[letters], end[letters], word[letters], kind[letters] = relative, relative + 1, own, orig
        start[spans], end[spans], word[spans], kind[spans] = relative[place], relative[place] + size, txt, 0
        fields = [pa.array(start), pa.array(end), pa.array(self.words, pa.string()).take(pa.array(word)), pa.array(["rom", "orig"]).take(pa.array(kind))]
        return pa.ListArray.from_arrays(pa.array((begins + before[begins]).astype(np.int32)), pa.StructArray.from_arrays(fields, names=["start", "end", "txt", "type"]))


@cache
def lattice() -> Lattice:
    """The one of this worker."""
    return Lattice()


def lattice_lists(df: DataFrame, key: str, text_col: str, lcode_col: str | None = None) -> DataFrame:
    """(key, edges): a row for each row of ``df``, with the edges of its text's lattice in order; a null or empty text has none."""
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    lcode = name(lcode_col) if lcode_col else F.lit(None)
    rows = df.select(name(key).alias("key"), name(text_col).cast("string").alias("text"), lcode.cast("string").alias("lcode"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts, lcodes in in_place.slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), lattice().edges(texts, lcodes)], names=["key", "edges"])

    schema = T.StructType([rows.schema.fields[0], T.StructField("edges", T._parse_datatype_string(f"array<{EDGE}>"))])
    return rows.mapInArrow(run, schema).select(F.col("key").alias(key), "edges")
