"""Queries of the library's own operators over the tables of a data folder, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import latin, numbers
from .functions import text as tx
from .operators import distance, romanize, stats
from .streaming import romanize_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The letters with marks in the test tables, and their base letters.
MARKED, BASE = "éóèñçüêäöíÉÈÑÓÇÄÊÜÖÍ", "eoencueaoiEENOCAEUOI"
FOLD_SQL = f"replace(translate({{0}}, '{MARKED}', '{BASE}'), 'ß', 'ss')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL if it has any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def once(c):
    """A column that is computed once for each row: as a generated one it isn't repeated in every filter and expression that uses it."""
    return F.explode_outer(F.array(c))


# ------------------------------------------------------------------ romanization


@query(f"select doc_id, {FOLD_SQL.format('text')} as romanized from documents")
def romanize_documents(spark, d):
    return romanize.romanize(_t(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "romanized")


_DE = "replace(replace(replace(replace(replace(replace(text, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue')"


@query(f"select doc_id, case lang when 'de' then 'deu' when 'fr' then 'fra' when 'es' then 'spa' else 'eng' end as lcode, case when lang = 'de' then {FOLD_SQL.format(_DE)} else {FOLD_SQL.format('text')} end as romanized from documents")
def romanize_documents_by_lang(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text", latin.language_code(F.col("lang")).alias("lcode"))
    return romanize.romanize(docs, "text", lcode_col="lcode").select("doc_id", "lcode", "romanized")


#: Letters that Georgian letters stand for, one for one.
_LATIN_LETTERS, _GEORGIAN = "abgdevziklmnoprsuqjhx", "აბგდევზიკლმნოპრსუყჯჰხ"


@query(f"select doc_id, {FOLD_SQL.format('text')} as romanized from documents")
def romanize_georgian_documents(spark, d):
    """The documents with most of their letters written in Georgian: reading them gives the letters back."""
    docs = _t(spark, d, "documents").select("doc_id", once(F.translate("text", _LATIN_LETTERS, _GEORGIAN)).alias("text"))
    return romanize.romanize(docs, "text").select("doc_id", "romanized")


@query(f"select conv_id, turn, {FOLD_SQL.format('text')} as romanized from conversations")
def romanize_conversations(spark, d):
    return romanize.romanize(_t(spark, d, "conversations").select("conv_id", "turn", "text"), "text").select("conv_id", "turn", "romanized")


@query(f"select conv_id, turn, {FOLD_SQL.format('text')} as romanized from conversations")
def stream_romanize_conversations(spark, d):
    schema = _t(spark, d, "conversations").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/conversations.parquet*").select("conv_id", "turn", "text")
    return romanize_stream.romanize_available(stream, "text").select("conv_id", "turn", "romanized")


@query(f"select token, {FOLD_SQL.format('token')} as romanized, count(*) as n from (select unnest(string_split(text, ' ')) as token from documents) where token <> '' group by token")
def romanize_token_distinct(spark, d):
    found = _t(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    return romanize.romanize(found, "token").select("token", "romanized", "n")


@query(f"""with c as (select item_id, unnest(range(length(text))) as start, text from benchmark), e as (select item_id, start, substring(text, start + 1, 1) as ch from c)
select item_id, start::int as start, (start + 1)::int as "end", {FOLD_SQL.format('ch')} as txt, case when {FOLD_SQL.format('ch')} = ch then 'orig' else 'rom' end as type from e""")
def romanize_edges_benchmark(spark, d):
    return romanize.romanize_edges(_t(spark, d, "benchmark"), "item_id", "text")


@query("""with c as (select item_id, unnest(range(length(text))) as i, text from benchmark), r as (select item_id, i, i + (length(substring(text, 1, i)) - length(replace(substring(text, 1, i), 'ß', ''))) as j from c)
select item_id, string_agg(i || ':' || j, ',' order by i) as alignment from r group by item_id""")
def romanize_offsets(spark, d):
    return romanize.offset_alignment(romanize.romanize_edges(_t(spark, d, "benchmark"), "item_id", "text"), "item_id")


@query(f"""with c as (select item_id, unnest(range(length(text))) as start, text from benchmark), e as (select item_id, start, substring(text, start + 1, 1) as ch from c)
select item_id, start::int as start, (start + 1)::int as "end", {FOLD_SQL.format('ch')} as txt, case when {FOLD_SQL.format('ch')} = ch then 'orig' else 'rom' end as type from e""")
def romanize_lattice(spark, d):
    return romanize.romanize_edges(_t(spark, d, "benchmark"), "item_id", "text", rom_format="lattice")


@query(f"select doc_id, {FOLD_SQL.format('text')} as folded from documents")
def deaccent_documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", latin.deaccent(F.col("text")).alias("folded"))


@query(f"select doc_id, lower({FOLD_SQL.format('text')}) as folded from documents")
def deaccent_lower(spark, d):
    return _t(spark, d, "documents").select("doc_id", latin.deaccent_lower(F.col("text")).alias("folded"))


# ------------------------------------------------------------------ lines and slots


@query("select r_regionkey, 'eng' as lcode, r_name as text from region")
def lcode_directive_parse(spark, d):
    lines = _t(spark, d, "region").select("r_regionkey", F.concat(F.lit("::lcode eng "), "r_name").alias("line"))
    _, lcode, text = tx.lcode_directive(F.col("line"))
    return lines.select("r_regionkey", lcode.alias("lcode"), text.alias("text"))


@query("select n_nationkey, n_name as s, n_regionkey::varchar as region, null::varchar as missing from nation")
def slot_parse(spark, d):
    line = F.concat(F.lit("::s "), "n_name", F.lit(" ::flag ::region "), F.col("n_regionkey").cast("string"))
    rows = _t(spark, d, "nation").select("n_nationkey", line.alias("line"))
    return rows.select("n_nationkey", *[tx.slot(F.col("line"), n).alias(n) for n in ("s", "region", "missing")])


# ------------------------------------------------------------------ profiles


@query("select lang, count(*) as n_tokens, count(*) filter (where regexp_full_match(token, '[\\x00-\\x7F]*')) as n_ascii from (select lang, unnest(string_split(text, ' ')) as token from documents) group by lang")
def ascii_fast_path_share(spark, d):
    words = _t(spark, d, "documents").select("lang", F.explode(F.split("text", " ")).alias("token"))
    return words.groupBy("lang").agg(F.count("*").alias("n_tokens"), F.count_if(latin.is_ascii(F.col("token"))).alias("n_ascii"))


@query("select c as char, count(*) as n from (select unnest(string_split(text, '')) as c from documents) where c <> '' group by c")
def char_frequency(spark, d):
    return stats.character_counts(_t(spark, d, "documents"), "text")


@query("""select lang, t as char_type, count(*) as n from (select lang, case when regexp_full_match(c, '[A-Za-z]') then 'ascii letter' when regexp_full_match(c, '[0-9]') then 'digit' when regexp_full_match(c, '\\s') then 'space'
when regexp_full_match(c, '[\\x21-\\x7E]') then 'ascii punctuation' else 'latin letter' end as t from (select lang, unnest(string_split(text, '')) as c from documents) where c <> '') group by all""")
def script_profile(spark, d):
    return stats.script_profile(_t(spark, d, "documents"), "text", "lang")


# ------------------------------------------------------------------ numbers


@query("select o_orderkey, format('{:,}', (o_totalprice * 100)::bigint) as cents from orders")
def commify_totals(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", numbers.with_commas(F.round(F.col("o_totalprice") * 100)).alias("cents"))


@query("select p_partkey, round(p_retailprice::decimal(38,10), 1)::decimal(38,1)::varchar as price from part")
def round_prices(spark, d):
    return _t(spark, d, "part").select("p_partkey", numbers.rounded(F.col("p_retailprice"), 1).cast("string").alias("price"))


@query("select l_returnflag, round((sum(case when l_quantity > 25 then 1 else 0 end) * 100 / count(*))::decimal(38,10), 1)::decimal(38,1)::varchar || '%' as share from lineitem group by l_returnflag")
def percent_pretty(spark, d):
    counts = _t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("large"), F.count("*").alias("n"))
    return counts.select("l_returnflag", numbers.percent(F.col("large"), F.col("n")).alias("share"))


@query("with k as (select distinct o_custkey, o_orderkey from orders), g as (select *, o_orderkey - row_number() over (partition by o_custkey order by o_orderkey) as i from k) select o_custkey, min(o_orderkey) as first, max(o_orderkey) as last from g group by o_custkey, i")
def integer_ranges(spark, d):
    return stats.integer_ranges(_t(spark, d, "orders"), "o_custkey", "o_orderkey")


_DIGITS = "regexp_replace(x, '^0+([0-9])', '\\1')"


@query(f"select p_name, array_to_string(list_transform(regexp_extract_all(p_name, '[0-9]+|[^0-9]+'), lambda x: case when regexp_full_match(x, '[0-9]+') then lpad(length({_DIGITS})::varchar, 10, '0') || ':' || {_DIGITS} else x end), '') as sort_key from part")
def mixed_alnum_sort_key(spark, d):
    return _t(spark, d, "part").select("p_name", tx.sort_key(F.col("p_name")).alias("sort_key"))


# ------------------------------------------------------------------ comparison

_PAIRS = "(select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_name < b.n_name)"


def _nation_pairs(spark, d):
    n = _t(spark, d, "nation").select("n_name", "n_regionkey")
    return n.withColumnRenamed("n_name", "a").join(n.withColumnRenamed("n_name", "b"), "n_regionkey").where("a < b").select("a", "b")


@query(f"select a, b, levenshtein(a, b)::int as d from {_PAIRS}")
def levenshtein_names(spark, d):
    return _nation_pairs(spark, d).select("a", "b", F.levenshtein("a", "b").alias("d"))


@query(f"select a, b, (select coalesce(max(i), 0) from range(1, length(a) + 1) t(i) where substring(a, 1, i) = substring(b, 1, i) and i <= length(b))::int as n from {_PAIRS}")
def shared_prefix(spark, d):
    return _nation_pairs(spark, d).select("a", "b", tx.shared_prefix(F.col("a"), F.col("b")).alias("n"))


@query(f"select a, b, (select coalesce(max(w), 0) from range(1, length(a) + 1) s(i), range(1, length(a) + 1) t(w) where i + w - 1 <= length(a) and contains(b, substring(a, i, w)))::int as n from {_PAIRS}")
def common_substring(spark, d):
    return _nation_pairs(spark, d).select("a", "b", tx.common_substring(F.col("a"), F.col("b")).alias("n"))


@query()
def cost_distance_names(spark, d):
    return _nation_pairs(spark, d).select("a", "b", distance.cost_distance(F.col("a"), F.col("b")).alias("cost"))


# ------------------------------------------------------------------ markup and repair


@query("select page_id, replace(replace(replace(replace(html, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') as html from pages")
def html_entities(spark, d):
    return _t(spark, d, "pages").select("page_id", tx.entities_decoded(F.col("html")).alias("html"))


@query("select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(?:script|style)\\b.*?</(?:script|style)>|<!--.*?-->|<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), '^ +| +$', '', 'g')) as text from pages")
def strip_tags(spark, d):
    return _t(spark, d, "pages").select("page_id", tx.without_tags(F.col("html")).alias("text"))


@query("select page_id, regexp_matches(url, '^(?:https?|ftp)://[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+(?::[0-9]+)?(?:[/?#][^ ]*)?$') as url_ok, regexp_matches(url, '^[A-Za-z0-9._+-]+@') as email_ok from pages")
def url_predicates(spark, d):
    return _t(spark, d, "pages").select("page_id", tx.is_url(F.col("url")).alias("url_ok"), tx.is_email(F.col("url")).alias("email_ok"))


@query("select item_id, text from benchmark")
def escape_decode(spark, d):
    one = lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(c).cast("long")), 4, "0")))
    escaped = F.array_join(F.transform(tx.characters(F.col("text")), one), "")
    return _t(spark, d, "benchmark").select("item_id", tx.escapes_decoded(escaped).alias("text"))


@query("select doc_id, text from documents")
def mojibake_repair(spark, d):
    twice = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return _t(spark, d, "documents").select("doc_id", tx.decoded_twice(twice).alias("text"))


@query("select doc_id, text from documents")
def delete_invisible(spark, d):
    spaced = F.replace("text", F.lit("e"), F.lit("​e﻿"))
    return _t(spark, d, "documents").select("doc_id", tx.visible(spaced).alias("text"))


@query("select item_id, text from benchmark")
def normalize_punctuation(spark, d):
    curly = F.replace(F.replace("text", F.lit(","), F.lit("，")), F.lit("."), F.lit("．"))
    return _t(spark, d, "benchmark").select("item_id", tx.plain_punctuation(curly).alias("text"))


def _squeezed_sql() -> str:
    """Runs of every character of the tables cut to two: DuckDB has no back-references."""
    sql = "translate(text, '‐‑‒–—−', '------')"
    for c in [*map(chr, range(32, 127)), "\t", *MARKED, "ß"]:
        one = "[\\x{:02X}]".format(ord(c)) if c.isascii() else c
        sql = f"regexp_replace({sql}, '{one}{{{{3,}}}}', chr({ord(c)}) || chr({ord(c)}), 'g')".replace("{{", "{").replace("}}", "}")
    return f"select doc_id, trim(regexp_replace({sql}, '\\s+', ' ', 'g')) as text from documents"


@query(_squeezed_sql())
def squeeze_repeats(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.squeezed(F.col("text")).alias("text"))


# ------------------------------------------------------------------ statistics


@query("""with j as (select lang, quality, count(*) as n from documents join labels using (doc_id) group by all)
select lang, quality, n, log2(n * (sum(n) over ())::double / (sum(n) over (partition by lang) * (sum(n) over (partition by quality)))) as pmi from j""")
def mutual_information(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "lang").join(_t(spark, d, "labels"), "doc_id")
    return stats.mutual_information(rows, "lang", "quality")


@query("""with c as (select count(*) filter (where toxic = 1 and quality = 1) as tp, count(*) filter (where toxic = 1 and quality <> 1) as fp, count(*) filter (where toxic <> 1 and quality = 1) as fn from labels)
select tp, fp, fn, tp / (tp + fp) as precision, tp / (tp + fn) as recall, 2 * tp / (2 * tp + fp + fn) as f1 from c""")
def precision_recall(spark, d):
    return stats.precision_recall(_t(spark, d, "labels"), F.col("toxic") == 1, F.col("quality") == 1)


@query("""with p as (select event_type, count(*) as p from events where value < 50 group by 1), q as (select event_type, count(*) as q from events where value >= 50 group by 1),
b as (select coalesce(p, 0) as p, coalesce(q, 0) as q from p full join q using (event_type)), s as (select sum(p) as sp, sum(q) as sq, count(*) as k from b)
select round(sum((p + 1.0) / (sp + k) * log2(((p + 1.0) / (sp + k)) / ((q + 1.0) / (sq + k)))), 9) as kl from b, s""")
def kl_divergence(spark, d):
    e = _t(spark, d, "events")
    return stats.divergence(e.where("value < 50"), e.where("value >= 50"), "event_type").select(F.round("kl", 9).alias("kl"))


@query("with k as (select distinct o_custkey, o_orderkey from orders), g as (select *, o_orderkey - row_number() over (partition by o_custkey order by o_orderkey) as i from k), r as (select o_custkey, min(o_orderkey) as a, max(o_orderkey) as b from g group by o_custkey, i) select o_custkey, string_agg(case when a = b then a::varchar else a || '-' || b end, ', ' order by a) as ranges from r group by o_custkey")
def integer_range_text(spark, d):
    return stats.range_text(_t(spark, d, "orders"), "o_custkey", "o_orderkey")


@query("""with j as (select lang, source, quality, count(*) as n from documents join labels using (doc_id) group by all), t as (select sum(n)::double as t from j),
a as (select lang, sum(n) as x from j group by lang), b as (select source, sum(n) as y from j group by source), c as (select quality, sum(n) as z from j group by quality)
select lang, source, quality, n, round(log2(n / t) - log2(x / t) - log2(y / t) - log2(z / t), 9) as pmi from j join a using (lang) join b using (source) join c using (quality), t""")
def multi_information(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "lang", "source").join(_t(spark, d, "labels"), "doc_id")
    return stats.multi_information(rows, ["lang", "source", "quality"]).withColumn("pmi", F.round("pmi", 9))


@query("select p_type as type, n, round(n / length(p_type), 9) as ratio from (select p_type, (select coalesce(max(w), 0) from range(1, length(p_type) + 1) s(i), range(1, length(p_type) + 1) t(w) where i + w - 1 <= length(p_type) and contains('STANDARD ANODIZED TIN', substring(p_type, i, w)))::int as n from (select distinct p_type from part))")
def lcs_ratio(spark, d):
    types = _t(spark, d, "part").select(F.col("p_type").alias("type")).distinct()
    found = types.withColumn("r", tx.common_substring_ratios(F.col("type"), F.lit("STANDARD ANODIZED TIN")))
    return found.select("type", F.col("r.n").alias("n"), F.round("r.ratio_a", 9).alias("ratio"))


@query("select doc_id, text from documents")
def normalize_punctuation_documents(spark, d):
    """Typographic punctuation put in, and evened out again."""
    typographic = F.translate("text", "'", "’")
    return _t(spark, d, "documents").select("doc_id", tx.plain_punctuation(typographic).alias("text"))
