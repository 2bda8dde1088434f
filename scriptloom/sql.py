"""Functions for SQL: expressions as temporary functions, and edges of a text as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import latin, numbers
from .operators import spans
from .plans import char_tables


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(expression: str, table: dict[str, str]) -> str:
    """SQL that replaces single characters: in one pass where one stands for one or none, the others one by one."""
    short = {k: v for k, v in table.items() if len(v) == 1} | {k: v for k, v in table.items() if not v}
    out = f"translate({expression}, {_quoted(''.join(short))}, {_quoted(''.join(short.values()))})"
    for k, v in table.items():
        if len(v) > 1:
            out = f"replace({out}, {_quoted(k)}, {_quoted(v)})"
    return out


@F.udtf(returnType="start int, end int, txt string, type string")
class LetterEdges:
    """The edges of a text letter by letter, each by its own sound, without regard to its neighbours."""

    def __init__(self) -> None:
        self.sounds = latin.folds() | char_tables.letter_sounds()

    def eval(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        for i, c in enumerate(text or ""):
            t = self.sounds.get(c, c)
            yield i, i + 1, t, "orig" if t == c else "rom"


@F.udtf(returnType="start int, end int, txt string, type string", useArrow=True)
class LatticeEdges:
    """A row for each edge of the lattice of a text (see ``spans.Lattice``); a null text has no edges.

    Rows of edges pass through Python one by one: for whole texts there is ``spans.lattice_lists``.
    """

    def eval(self, text: str, lcode: str) -> Iterator[tuple[int, int, str, str]]:
        edges = spans.lattice().edges([text or ""], [lcode]).flatten()
        yield from zip(*(edges.field(i).to_pylist() for i in range(4)), strict=True)


def register(spark: SparkSession) -> None:
    """Make deaccent, ascii_digits, quick_romanize and the table functions letter_edges and lattice_edges known to SQL."""
    digits = {chr(z + d): str(d) for z in numbers.DIGIT_ZEROS for d in range(10)}
    sounds = {c: t for c, t in char_tables.letter_sounds().items() if t.isascii()}
    for name, table in (("deaccent", latin.folds()), ("ascii_digits", digits), ("quick_romanize", sounds)):
        spark.sql(f"create or replace temporary function {name}(s string) returns string return {_replaced('s', table)}")
    spark.udtf.register("letter_edges", LetterEdges)
    spark.udtf.register("lattice_edges", LatticeEdges)
