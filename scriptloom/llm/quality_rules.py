"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are at from or an not have "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des du et en un une est que qui dans pour par sur au pas ne se il avec ce plus "
    "el los las y del se no al lo su para con una es como más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only if low <= value <= high, where value is a ratio of two counts (0 where the second is 0)."""

    name: str
    count: str
    of: str
    low: float = float("-inf")
    high: float = float("inf")


#: Thresholds of the default filter.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.3),
    Rule("stop_words_per_word", "n_stop_words", "n_words", low=0.03),
    Rule("lettered_words", "n_lettered", "n_words", low=0.6),
    Rule("shouted_words", "n_shouted", "n_words", high=0.4),
    Rule("stuttered_words", "n_stuttered", "n_words", high=0.2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.3),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the array, the first time included.

    Windows go by 64-bit hashes; only arrays with a repeated hash sort their windows.
    """

    def covered(places: Column) -> Column:
        gap = lambda i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - F.get(places, i), F.lit(window)))
        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), F.lit(0), lambda total, i: total + gap(i))

    def places(ordered: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(ordered, i).h == F.get(ordered, j).h, F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.array_sort(F.transform(twice, lambda i: F.get(ordered, i).i))

    def of_windows(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(ordered, lambda o: _let(places(o), covered)))

    def of_words(hashed: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashed) - (window - 1)), lambda i: F.xxhash64(F.slice(hashed, i, window)))
        return _let(windows, of_windows)

    return F.when(F.size(words) <= window, F.lit(0)).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), of_words))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one column, ``m``: a struct of the counts that rules name (all long)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn("m", F.struct(text.alias("text"), F.array_remove(F.split(text, WHITE), "").alias("words"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines")))
    words, lines, text = F.col("m.words"), F.col("m.lines"), F.col("m.text")
    stop = list(dict.fromkeys([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]))
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": F.size(lines),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stop))),
        "n_lettered": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))),
        "n_shouted": F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}{2,}[^\p{Ll}]*$"))),
        "n_stuttered": F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[ \t-\r]*[-*•]"))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[ \t-\r]*$"))),
    }
    return rows.withColumn("m", F.struct(*(v.cast("long").alias(k) for k, v in counts.items())))


def compiled(rules: tuple[Rule, ...], counts: str = "m") -> Column:
    """True where all rules hold."""
    verdict = F.lit(True)
    for r in rules:
        of = F.col(f"{counts}.{r.of}")
        ratio = F.when(of == 0, F.lit(0.0)).otherwise(F.col(f"{counts}.{r.count}") / of)
        if r.low > float("-inf"):
            verdict = verdict & (ratio >= r.low)
        if r.high < float("inf"):
            verdict = verdict & (ratio <= r.high)
    return verdict


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row.

    base_failed: fewer than ``min_words`` words, or over ``max_repeat_percent``
    per cent of them in repeated windows.  kept: not base_failed and within all
    thresholds of ``rules``.

    Null and empty texts have no words, so they fail.  Every row is judged by
    itself: repeated rows give repeated results, a null doc_id stays null, an
    empty table gives no rows and other columns play no part.  A ratio at its
    threshold passes.
    """
    rows = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    m = lambda c: F.col(f"m.{c}")
    failed = (m("n_words") < min_words) | (100 * m("n_repeat_words") > max_repeat_percent * m("n_words"))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *(m(c).alias(c) for c in shown), failed.alias("base_failed"), (~failed & compiled(rules)).alias("kept"))
