"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index is a table of postings (term, document, position) of the test set's
terms in all training texts.  A window of a test item is looked up by its
rarest terms: each posting gives the start that the window would have there,
and only starts that all of these lists share go on.  The lists of the other
terms are then intersected for those few starts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import bounded, table

#: What is no part of a word once A-Z are in lower case.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lists intersected before a start counts as found.
RAREST = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; the shorter way serves where a text is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def term_array(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), "")


def _rows_of_100_bytes(df: DataFrame, size: Column) -> int:
    """How many rows of 100 bytes ``df`` weighs, at least one for each of its rows; ``size`` is what a row has beyond some fixed fields."""
    return df.agg(F.coalesce(F.sum(1 + F.floor(size / 100)), F.lit(0))).first()[0]


@dataclass
class TestSet:
    """The different word sequences of the test items: what is looked up, and whose it is."""

    items: DataFrame  # phrase, item_id
    terms: DataFrame  # phrase, n, j, term


def read_test_set(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> TestSet:
    rows = benchmark.select(F.col(id_col).cast("string").alias("item_id"), term_array(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    rows = table(rows.withColumn("phrase", F.xxhash64("words")), "items")
    terms = rows.dropDuplicates(["phrase"]).select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("j", "term"))
    return TestSet(rows.select("phrase", "item_id").distinct(), table(terms, "phrases"))


@dataclass
class PositionalIndex:
    """Stored postings of the test set's terms, and a row for each document."""

    postings: DataFrame  # term_id, uid, pos
    documents: DataFrame  # uid, doc_id, n_words
    terms: DataFrame  # term, term_id, df
    n_terms: int


def build_index(docs: DataFrame, test: TestSet, id_col: str = "doc_id", text_col: str = "text") -> PositionalIndex:
    """Store the postings of all rows of ``docs``; each row is a document of its own, whatever its id.

    Every document also has a posting of the empty term, at the position after
    its last word.
    """
    terms = test.terms.select("term").distinct().withColumn("term_id", F.xxhash64("term"))
    terms = table(terms, "terms")
    n_terms = _rows_of_100_bytes(terms, F.octet_length("term"))
    wanted = terms.union(docs.sparkSession.createDataFrame([("", -1)], "term string, term_id long"))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), term_array(F.col(text_col)).alias("words"))
    rows = rows.select("uid", "doc_id", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "term"))
    postings = table(rows.join(bounded(wanted, n_terms), "term").select("term", "term_id", "uid", "doc_id", "pos"), "postings")
    df = postings.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    known = table(terms.join(df, "term", "left").select("term", "term_id", F.coalesce("df", F.lit(0)).alias("df")), "terms")
    return PositionalIndex(postings.where("term <> ''").select("term_id", "uid", "pos"), postings.where("term = ''").select("uid", "doc_id", F.col("pos").alias("n_words")), known, n_terms)


def _plans(index: PositionalIndex, test: TestSet, window: int) -> DataFrame:
    """(phrase, n, size, k, terms, wins): a phrase's window size, term ids by position, and each window's k rarest positions."""
    known = bounded(index.terms, index.n_terms)
    by_phrase = test.terms.join(known, "term").groupBy("phrase", "n").agg(F.array_sort(F.collect_list(F.struct("j", "df", "term_id"))).alias("at"))
    sized = by_phrase.withColumn("size", F.least(F.lit(window), "n")).withColumn("k", F.least(F.lit(RAREST), "size"))
    wins = F.transform(
        F.sequence(F.lit(0), F.col("n") - F.col("size")),
        lambda s: F.transform(F.slice(F.array_sort(F.transform(F.slice("at", s + 1, F.col("size")), lambda x: F.struct(x.df.alias("df"), x.j.alias("j")))), 1, F.col("k")), lambda x: x.j),
    )
    return table(sized.select("phrase", "n", "size", "k", F.transform("at", lambda x: x.term_id).alias("terms"), F.array_distinct(wins).alias("wins")), "plans")


def _rare_hits(index: PositionalIndex, plans: DataFrame) -> DataFrame:
    """(uid, phrase, j, start): where the postings of a phrase's rare term j let the phrase start."""
    anchors = plans.select("phrase", "terms", F.explode(F.array_distinct(F.flatten("wins"))).alias("j"))
    anchors = table(anchors.select("phrase", "j", F.element_at("terms", F.col("j") + 1).alias("term_id")), "anchors")
    hits = index.postings.join(bounded(anchors, anchors.count()), "term_id")
    return table(hits.select("uid", "phrase", "j", (F.col("pos") - F.col("j")).alias("start")), "hits")


def _agreed(found: DataFrame, plans: DataFrame, n_plans: int) -> DataFrame:
    """Rows of ``found`` (phrase, js) where a window has all its rarest positions among js."""
    with_plan = found.join(bounded(plans.select("phrase", "k", "wins"), n_plans), "phrase").where(F.size("js") >= F.col("k"))
    return with_plan.where(F.exists("wins", lambda w: F.size(F.array_except(w, "js")) == 0)).drop("k", "wins", "js")


@dataclass
class Matches:
    phrases: DataFrame  # uid, phrase, start, size: each occurrence of a window
    near: DataFrame  # uid, phrase


def find(index: PositionalIndex, test: TestSet, window: int = 10, slop: int = 5) -> Matches:
    """Exact window occurrences, and phrases that occur nearly.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter one.  A phrase is near if the rarest terms of one of its windows
    have starts in one span of 2 * (slop + 1) positions that begins at a
    multiple of slop + 1: all starts that differ by slop + 1 at most are found.
    """
    plans = _plans(index, test, window)
    n_plans = _rows_of_100_bytes(plans, F.size("terms") * 8 + F.size("wins") * (8 + 4 * RAREST))
    hits = _rare_hits(index, plans)
    exact = _agreed(hits.groupBy("uid", "phrase", "start").agg(F.collect_set("j").alias("js")), plans, n_plans)
    exact = table(exact, "starts")
    span = F.floor(F.col("start") / F.lit(slop + 1))
    near = hits.select("uid", "phrase", "j", F.explode(F.array(span, span - 1)).alias("span")).groupBy("uid", "phrase", "span").agg(F.collect_set("j").alias("js"))
    near = _agreed(near, plans, n_plans).select("uid", "phrase").distinct()
    owners = table(exact.select("uid").distinct(), "owners")
    lists = index.postings.join(bounded(owners, owners.count()), "uid", "left_semi")
    wanted = exact.join(bounded(plans.select("phrase", "size", "terms"), n_plans), "phrase").select("uid", "phrase", "start", "size", F.posexplode("terms").alias("j", "term_id"))
    wanted = wanted.withColumn("pos", F.col("start") + F.col("j"))
    both = wanted.join(lists, ["uid", "pos", "term_id"]).groupBy("uid", "phrase", "start", "size").agg(F.sort_array(F.collect_set("j")).alias("js"))
    whole = F.filter(F.sequence(F.lit(1), F.size("js") - F.col("size") + 1), lambda i: F.element_at("js", i + F.col("size") - 1) - F.element_at("js", i) == F.col("size") - 1)
    begins = both.where(F.size("js") >= F.col("size")).select("uid", "phrase", "size", F.explode(F.transform(whole, lambda i: F.element_at("js", i) + F.col("start"))).alias("start"))
    return Matches(table(begins, "matches"), near)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, slop: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) for every row of ``docs``.

    n_hit: words inside an occurrence of a test window; n_items: items with an
    occurring window; items_sha256: SHA-256 of their ids, sorted as strings and
    comma-joined; n_near: items whose rarest terms occur close together.

    Null and empty texts have no words and no hits, as items they match
    nothing.  Rows that repeat are judged each on its own, a null doc_id too.
    Items of equal words count each, one null item_id not at all.  A tie
    between equally rare terms goes to the earlier word and changes no result.
    Empty tables give no rows or no hits; other columns play no part.
    """
    test = read_test_set(benchmark, item_col, item_text_col)
    index = build_index(docs, test, id_col, text_col)
    found = find(index, test, window, slop)
    ends = found.phrases.groupBy("uid", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    covered = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", "end"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.end - F.greatest(x.start, a.to))).cast("long").alias("n"), F.greatest(a.to, x.end).cast("long").alias("to")),
        lambda a: a.n,
    )
    hit = ends.groupBy("uid").agg(covered.alias("n_hit"))
    names = found.phrases.select("uid", "phrase").distinct().join(test.items, "phrase").groupBy("uid").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    near = found.near.join(test.items, "phrase").groupBy("uid").agg(F.countDistinct("item_id").alias("n_near"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return (
        index.documents.join(hit.join(names, "uid", "left").join(near, "uid", "full"), "uid", "left")
        .select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """``docs`` without the rows whose text contains a test window; columns stay.

    Texts are judged, by their 64-bit hashes, not ids: rows that share an id, or
    have none, stay or go by their own texts.  Null and empty texts stay.
    """
    hashed = F.xxhash64(F.col(text_col).cast("string"))
    judged = contamination(docs.select(hashed.alias("text_hash"), F.col(text_col).alias("text")), benchmark, "text_hash", "text", window=window)
    leaks = table(judged.where("contaminated").select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    leaks = bounded(leaks, leaks.count())
    return docs.join(leaks, hashed == leaks["_leak"], "left_anti")
