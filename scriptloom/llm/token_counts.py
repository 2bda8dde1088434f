"""Token counts by byte-pair merging with a heap and a linked list; no token ids are made.

A piece of text starts as one symbol for each byte.  The adjacent pair of the
lowest rank is merged again and again; a piece has as many tokens as symbols
minus merges.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces whose counts a task remembers; when full, it starts anew.
REMEMBERED = 1_000_000
#: Fixed value: how byte-level vocabularies cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(printable))
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class MergeCounter:
    """Counts the tokens of pieces by the merge ranks of a byte-level vocabulary file (.json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        vocab = spec["model"]["vocab"]
        self.symbols = [vocab[c] for _, c in sorted(byte_symbols().items())]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left], vocab[right]] = (rank, vocab[left + right])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, int] = {}

    def merges(self, piece: bytes) -> int:
        """How many merges ``piece`` takes."""
        symbol = [self.symbols[b] for b in piece]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            found = ranks.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two has been merged meanwhile
            done += 1
            symbol[i], symbol[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = ranks.get((new, symbol[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, new, symbol[k], found[1]))
            h = before[i]
            if h >= 0:
                found = ranks.get((symbol[h], new))
                if found:
                    heapq.heappush(heap, (found[0], h, symbol[h], new, found[1]))
        return done

    def _piece(self, piece: str) -> int:
        raw = piece.encode()
        count = self.known[piece] = len(raw) - self.merges(raw)
        return count

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string counts as that one token."""
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, piece_count = self.known.get, self._piece
        for part in parts:
            for piece in self.pieces.findall(part):
                total += known(piece) or piece_count(piece)
        return total


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """The counter of a file, made once for each Python worker."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: Callable[[], str], id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    ``vocabulary`` gives the path of the vocabulary file on the machine where
    it is called.  Null and empty texts have no bytes and no tokens.  Each row
    is counted by itself: repeated rows repeat, a null doc_id stays null, an
    empty table gives no rows, other columns play no part; equally ranked pairs
    merge from the left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary()).count
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
