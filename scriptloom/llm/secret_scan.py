"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions near its hits, and embedded checksums."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int]
#: Characters of a signed token's encoded header; real ones have some hundred.
MOST_HEADER = 4096
#: Rows that are masked at a time.
MASKED_ROWS = 256
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_ending(token: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of the 30 after the prefix, as in access tokens of code and package hosts."""
    body, check = token[4:-6], token[-6:]
    number = zlib.crc32(body.encode("ascii"))
    digits = ""
    while number:
        number, d = divmod(number, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0") == check


def signed_token(token: str) -> bool:
    """Whether the first part of a dotted token, of MOST_HEADER characters at most, decodes to a JSON object that names an algorithm."""
    head = token.partition(".")[0]
    if len(head) > MOST_HEADER:
        return False
    try:
        header = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):  # no base64, no UTF-8, no JSON, or one that nests too deep for a header
        return False
    return isinstance(header, dict) and "alg" in header


@dataclass(frozen=True)
class Kind:
    """What is looked for at a keyword's place: an expression anchored there, and a test of its match.

    Where the expression fails, it fails at every later place within ``run`` from there too.
    """

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern[str]
    valid: Callable[[re.Match[str]], bool]
    run: re.Pattern[str] | None = None


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Kinds in the order of the contract; the first two and hex are the base, the rest need a checksum or a header that decodes.
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "api_key", "apikey"), ASSIGN, lambda m: len(m[2]) >= 6),
    Kind("access", ("akia",), ACCESS, lambda m: len(m[0]) >= 20),
    Kind("host_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: crc_ending(m[0])),
    Kind("signed_token", ("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]{8,}+"), lambda m: signed_token(m[0]), re.compile(r"eyJ[A-Za-z0-9_-]*+")),
)
ORDER = {name: i for i, name in enumerate(("assign", "access", "hex", "host_token", "signed_token"))}


def build_automaton(kinds: tuple[Kind, ...] = KINDS) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for i, kind in enumerate(kinds):
        for word in kind.keywords:
            automaton.add_word(word, (i, len(word)))
    automaton.make_automaton()
    return automaton


class Scanner:
    """Finds the spans (kind, start, end) of a text, in code points, end exclusive."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        self.kinds, self.automaton = kinds, build_automaton(kinds)

    def spans(self, text: str) -> list[Span]:
        found: list[Span] = []
        behind = [0] * len(self.kinds)
        folded = text.encode("utf-8", "replace").lower().decode()  # bytes fold A-Z alone, so places stay
        hits = sorted((end - size + 1, kind) for end, (kind, size) in self.automaton.iter(folded))
        for start, i in hits:
            if start < behind[i]:
                continue
            kind = self.kinds[i]
            if m := kind.pattern.match(text, start):
                behind[i] = m.end()
                if kind.valid(m):
                    found.append((kind.name, start, m.end()))
            elif kind.run and (run := kind.run.match(text, start)):
                behind[i] = run.end()
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        return sorted(found, key=lambda x: (x[1], ORDER[x[0]]))

    def value_spans(self, text: str) -> list[tuple[int, int]]:
        """Disjoint ranges of secret characters, without the names before them."""
        ranges = []
        for kind, start, end in self.spans(text):
            if kind == "assign":
                start = ASSIGN.match(text, start).start(2)
            if ranges and start < ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(end, ranges[-1][1]))
            else:
                ranges.append((start, end))
        return ranges

    def masked(self, text: str, mask: str) -> str:
        for start, end in reversed(self.value_spans(text)):
            text = text[:start] + mask + text[end:]
        return text


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    """The scanner of this Python worker."""
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row.

    Null and empty texts have no spans.  Each row is scanned by itself, to its
    end: repeated rows repeat, a null doc_id stays null, an empty table gives
    no rows, other columns play no part.  Of spans with one start, the kind
    listed first comes first.
    """
    base = ("assign", "access", "hex")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = scanner().spans
        for batch in batches:
            each = [spans_of(t) if t else [] for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == kind for s in spans) for spans in each], pa.int64()) for kind in base]
            hashed = [hashlib.sha256(joined([s for s in spans if s[0] in base]).encode()).hexdigest() for spans in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(hashed, pa.string()), pa.array([joined(s) for s in each], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: Column, mask: str = "<secret>") -> Column:
    """``text`` with the values of all secrets replaced by ``mask``; null stays null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        own = scanner()
        # slices: of a batch of long texts, only some are held as Python strings at a time
        slices = (texts.slice(i, MASKED_ROWS).to_pylist() for i in range(0, len(texts), MASKED_ROWS))
        done = [pa.array([own.masked(t, mask) if t else t for t in some], pa.string()) for some in slices]
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return run(text)
