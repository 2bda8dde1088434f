"""Romanization as a relational job.

Rows of Latin text are folded by expressions alone.  In the others, only the
words with letters beyond Latin are looked up; each different one is romanized
once: its characters join the character table and see their neighbours by one
window, spans of rules grow along a trie of their sources, and a fold over the
edges of the word takes the longest one from the left, by what was read before.
The readings go back to each different text by the places of its words; words
are named by two hashes and never carried along.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.latin import BY_LANGUAGE, folds, is_ascii, romanize_latin
from ..functions.numbers import NOT_ALONE, composed
from ..functions.text import characters, guarded_html
from ..plans import char_tables, cuts
from ..plans.rules import RULES
from ..plans.trie import RULE, authored, layered, prefix_table, rule_table
from . import in_place, spans

#: Text that expressions alone can romanize: ASCII, Latin letters and general punctuation, but no fractions.
_LATIN = r"\u0000-»¿-ɏḀ-ỿ‐-‧‰-›₠-₿"
LATIN_ONLY = rf"^[{_LATIN}]*$"
#: A word with a letter beyond them.
_BREAKS = " ་၊။។、。《-』！（），：；？"
# ranges of the common letters stand first: a negated class is gone through to its end for each character
_NO_BREAK = rf"[!-\u0F0A[^{_BREAKS}]]"
# a word is tried from its start only
_HARD = rf"((?<!{_NO_BREAK})[!-»¿-ɏ[{_LATIN}&&[^{_BREAKS}]]]*+[ɐ-\u0F0A[^{_LATIN}{_BREAKS}]]{_NO_BREAK}*+)"
ID = ("ta", "tb")
EDGE = "struct<start:int,end:int,txt:string,type:string>"
FORMATS = ("str", "edges", "lattice")
#: Edges that a step of the fold goes through at a time.
SLICE = 64
#: What an edge needs: of the reading on the left, that it ends in no letter, in a letter, in no letter or apostrophe, in no consonant, or is consonants alone; of its syllable, that this letter carries the vowel, or is silent.
NO_LETTER, LETTER, UNMARKED, NO_CONSONANT, CONSONANTS, CARRIES, SILENT = range(1, 8)

#: Thai vowels written before their consonant, tone marks, and final sounds of consonants.
THAI_BEFORE = {"เ": "e", "แ": "ae", "โ": "o", "ใ": "ai", "ไ": "ai"}
THAI_TONES = "\u0e48\u0e49\u0e4a\u0e4b"
THAI_FINALS = {**dict.fromkeys("กขคฆ", "k"), **dict.fromkeys("จชซฌฎฏฐฑฒดตถทธศษส", "t"), **dict.fromkeys("บปพฟภ", "p"), **dict.fromkeys("ญณนรลฬ", "n")}
#: What can stand before the vowel of a Tibetan syllable, beside single letters, and after it.
TIBETAN_ONSETS = "bd br brg brgy bs bsh bst bt bts by bz bzh ch db dby dk dm dp dpy dr gl gn gr gs gt gy gzh kh khr khy kr ky ld lh lt mkh mny mth mtsh ny ph phr phy rgy rk el rn rny rt rts sk skr sky sl sm sn sny sp spy sr st th ts tsh".split()
TIBETAN_CODAS = "bh bs ch cs dd ddh dh dz dzh gh gr gs kh khs kss n nn nt ms ng ngs ns ph rm sh ss th ts tsh tt tth zh zhs".split()
#: Sounds of the parts of Hangul syllables, in the order of Unicode ("-": none).
HANGUL_LEADS = "g gg n d dd r m b bb s ss - j jj c k t p h".split()
HANGUL_VOWELS = "a ae ya yae eo e yeo ye o wa wai oe yo u weo we wi yu eu yi i".split()
HANGUL_TAILS = "- g gg gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j c k t p h".split()
#: Fixed value: between a denominator and its numerator.
OVER = "分之"


def tokens(text: Column) -> Column:
    """Words, and what stands between them (spaces, Tibetan dots, stops and brackets of scripts without spaces), in turns."""
    return F.regexp_extract_all(text, F.lit(f"({_NO_BREAK}+|[{_BREAKS}]+)"), F.lit(1))


def hangul(char: Column) -> Column:
    """A Hangul syllable by its number: lead, vowel, tail."""
    n = F.ascii(char) - 0xAC00
    part = lambda names, i: F.element_at(F.array(*[F.lit("" if x == "-" else x) for x in names]), (i + 1).cast("int"))
    return F.when(n.between(0, 11171), F.concat(part(HANGUL_LEADS, F.floor(n / 588)), part(HANGUL_VOWELS, F.floor(n % 588 / 28)), part(HANGUL_TAILS, n % 28)))


def _in_word(kind: Column) -> Column:
    return F.coalesce(kind.isin("letter", "vowel sign", "virama", "medial", "tail", "mark"), F.lit(False))


def _yes(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _once(f: Callable[..., Column]) -> Callable[..., Column]:
    """Build a large expression of named columns once for each application: it is the same in every plan."""
    built: dict[tuple, Column] = {}

    def get(*args: int) -> Column:
        key = (SparkSession.getActiveSession().sparkContext.applicationId, *args)
        if key not in built:
            built[key] = f(*args)
        return built[key]

    return get


def with_ids(words: DataFrame) -> DataFrame:
    """(token, lcode) with two hashes that name them from here on."""
    return words.withColumns({"ta": F.xxhash64("token", "lcode"), "tb": F.xxhash64(F.lit(1), "token", "lcode")})


def _characters(words: DataFrame) -> DataFrame:
    """A row for each character of (ta, tb, token, lcode), with its properties as struct ``x``."""
    spark = words.sparkSession
    table = F.broadcast(char_tables.characters(spark))
    # a number of partitions is given, as these short rows are much work, and by their bytes Spark would merge them to few tasks
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = words.select(*ID, "lcode", F.posexplode(characters(F.col("token"))).alias("pos", "c")).withColumn("code", F.ascii("c")).repartition(parts, *ID)
    rows = rows.join(table, F.col("code") == F.col("cp"), "left").drop("cp")
    is_hangul = F.col("code").between(0xAC00, 0xD7A3)
    ascii_digit = F.col("code").between(48, 57)
    letter = F.col("c").rlike(r"\p{L}")
    numeral = F.when(ascii_digit, F.col("c")).otherwise(F.coalesce(F.col("digit").cast("string"), "c"))
    x = F.struct(
        "c",
        F.coalesce("kind", F.when(letter, "letter").otherwise("other")).alias("kind"),
        F.coalesce("script", F.when(is_hangul, "HANGUL").otherwise("COMMON")).alias("script"),
        F.when(is_hangul, hangul(F.col("c"))).otherwise(F.coalesce("rom", "c")).alias("rom"),
        numeral.alias("numeral"),
    )
    value, base = F.when(ascii_digit, F.col("code") - 48).otherwise(F.col("value")), F.when(ascii_digit, F.lit(1)).otherwise(F.col("base"))
    number = F.when(value.isNotNull() | F.col("fraction").isNotNull(), F.struct(value.cast("long").alias("value"), base.cast("long").alias("base"), "fraction"))
    return rows.select(*ID, "lcode", "pos", x.alias("x"), number.alias("number"), "category", _yes(F.col("vocalic")).alias("vocalic"), _yes(F.col("decomposed")).alias("decomposed"))


def _with_neighbours(rows: DataFrame, longest: int) -> DataFrame:
    """The characters before (p2, p1) and after (n1, n2 ...), and what signs further left do to this one."""
    w = Window.partitionBy(*ID).orderBy("pos")
    c = F.col("x.c")
    here = lambda test: F.max(F.when(test, F.col("pos"))).over(w)  # noqa: E731  # the last place up to this one
    cell = c.isin([*char_tables.BRAILLE_DIGITS, "⠼", "⠲", "⠂"])
    around = {f"n{k}": F.lead("x", k).over(w) for k in range(1, longest + 1)} | {f"p{k}": F.lag("x", k).over(w) for k in (1, 2)}
    # in braille, two capital signs hold up to a blank, a number sign up to what is no digit
    around |= {"twice": here((c == "⠠") & (F.lag("x.c").over(w) == "⠠")), "blank": here(c == "⠀"), "mark": here(c == "⠼"), "unmarked": here(~cell)}
    rows = rows.withColumns(around)
    after = lambda k: F.coalesce(F.col(k), F.lit(-1))
    return rows.withColumns({"shouted": after("twice") > after("blank"), "mark": F.when(cell & (F.col("mark") > after("unmarked")), F.col("mark"))}).drop("twice", "blank", "unmarked")


def _with_rules(rows: DataFrame, prefixes: DataFrame, longest: int) -> DataFrame:
    """Rules that begin here: array ``rules`` of (n, rule), for every n characters that are the source of one.

    A span grows by its next character only while it is a prefix of a source:
    what isn't has no row in the table of prefixes, and null joins nothing.
    """
    span, found = F.col("x.c"), []
    for k in range(1, longest + 1):
        step = prefixes.select(F.col("prefix").alias(f"prefix{k}"), F.col("rules").alias(f"rules{k}"))
        rows = rows.withColumn(f"span{k}", span).join(step, F.col(f"span{k}") == F.col(f"prefix{k}"), "left")
        span = F.when(F.col(f"prefix{k}").isNotNull(), F.concat(f"span{k}", F.col(f"n{k}.c")))
        found.append(_of_length(F.coalesce(f"rules{k}", F.array()), k))
    some = F.col("prefix1").isNotNull()
    none = F.array().cast(f"array<struct<n:int,rule:{RULE}>>")
    rows = rows.withColumn("rules", F.when(some, F.flatten(F.array(*found))).otherwise(none))
    return rows.drop(*[f"{name}{k}" for name in ("span", "prefix", "rules") for k in range(1, longest + 1)])


def _of_length(rules: Column, n: int) -> Column:
    return F.transform(rules, lambda r: F.struct(F.lit(n).alias("n"), r.alias("rule")))


def _thai_after() -> tuple[Column, Column]:
    """The character after this one and its reading, behind a tone mark."""
    tone = _yes(F.col("n1.c").isin(list(THAI_TONES)))
    return F.when(tone, F.col("n2.c")).otherwise(F.col("n1.c")), F.when(tone, F.col("n2.rom")).otherwise(F.col("n1.rom"))


def _thai_consonant(c: Column) -> Column:
    return _yes(c.rlike("^[\u0e01-\u0e2e]$") & (c != "อ"))


def _thai() -> Column:
    """Readings of a Thai letter: array of (txt, need).

    Where a syllable ends, a final consonant has a sound of its own.  It ends
    before a vowel that is written first, before what is no letter or sign, and,
    if what was read on the left doesn't end in a consonant, before a consonant.
    O ang and wo are vowels between consonants: o ang if what was read on the
    left is consonants alone.  A vowel written before its consonant is read after it.
    """
    rom, c = F.col("x.rom"), F.col("x.c")
    leads = lambda x: _yes(x.isin(list(THAI_BEFORE)))
    after_c, after_rom = _thai_after()
    before_c = F.when(_yes(F.col("p1.c").isin(list(THAI_TONES))), F.col("p2.c")).otherwise(F.col("p1.c"))
    moved = F.coalesce(F.try_element_at(_map(THAI_BEFORE), F.col("p1.c")), F.lit(""))
    # o ang and wo before a consonant are vowels here, o ang before a vowel isn't
    vowel_next = F.when(F.col("n1.c") == "อ", ~_yes(F.col("n2.rom").rlike("^[aeiou]"))).when(F.col("n1.c") == "ว", _thai_consonant(F.col("n2.c"))).otherwise(after_c.isin("อ", "ว") | _yes(after_rom.rlike("^[aeiou]")))
    inside = _in_word(F.col("p1.kind")) & ~leads(F.col("p1.c"))
    ends = leads(after_c) | after_c.isNull() | ~_yes(after_c.rlike(r"^[\p{L}\p{M}]$"))
    final = F.concat(F.coalesce(F.try_element_at(_map(THAI_FINALS), c), rom), moved)
    plain = _reading(F.concat(rom, moved))
    between = _thai_consonant(before_c) & _thai_consonant(after_c) & ~leads(F.col("p2.c"))
    consonant = F.when(inside & ends, F.array(_reading(final))).when(inside & ~vowel_next, F.array(_reading(final, NO_CONSONANT), plain)).otherwise(F.array(plain))
    o_ang = F.when(_thai_consonant(after_c) & _yes(F.col("p1.script") == "THAI"), F.array(_reading(F.concat(F.lit("o"), moved), CONSONANTS), _reading(moved))).otherwise(F.array(_reading(moved)))
    return (
        F.when(leads(c), F.array(_reading(F.lit(""))))
        .when(c == "อ", o_ang)
        .when((c == "ว") & between, F.array(_reading(F.lit("ua"))))
        .when(_thai_consonant(c), consonant)
        .otherwise(F.array(_reading(rom)))
    )


def _reading(txt: Column, need: int = 0) -> Column:
    return F.struct(txt.alias("txt"), F.lit(need).alias("need"))


@_once
def _single() -> Column:
    """The edges of a character by itself: default vowels of abugidas, doubled and lengthened kana, case."""
    x, rom, c = F.col("x"), F.col("x.rom"), F.col("x.c")
    lcode, kind, script = F.col("lcode"), F.col("x.kind"), F.col("x.script")
    khmer = script == "KHMER"
    is_abugida = script.isin(sorted(char_tables.ABUGIDAS)) & (kind == "letter") & (rom.rlike("^[bcdfghjklmnpqrstvwxyz]+a$") | (khmer & rom.rlike("^[bcdfghjklmnpqrstvwxyz]+o$")))
    bare = F.regexp_replace(rom, "[ao]$", "")
    sign = lambda n: _yes(F.col(f"{n}.kind").isin("vowel sign", "virama", "medial"))
    next_sign = sign("n1") | ((F.col("n1.kind") == "mark") & sign("n2"))
    at_end = ~_in_word(F.col("n1.kind"))
    drops = at_end & (((script == "DEVANAGARI") & ~lcode.eqNullSafe("san")) | lcode.isin("asm", "ben", "guj", "kas", "pan"))
    after_virama = F.col("p1.kind") == "virama"
    at_start = ~_in_word(F.col("p1.kind"))
    khmer_yo = khmer & (F.col("n1.c") == "យ") & bare.rlike("^(?:[bcdfghklmnpqrstvwz]|ng)$")
    kept = F.when(_yes(khmer_yo) | next_sign, bare).when(_yes(after_virama | at_start), rom).when(_yes(drops), bare).when(F.col("vocalic"), bare).otherwise(rom)
    doubler, long_mark = c.isin("っ", "ッ", "\u0a71"), c == "ー"
    following = F.substring("n1.rom", 1, 1)
    doubled = F.when(F.col("n1.rom").startswith("ch"), F.when(c == "\u0a71", "c").otherwise("t")).when(following.rlike("[bcdfghjkmlnpqrstvwz]"), following).otherwise("")
    vowel = F.regexp_extract("p1.rom", "([aeiou])$", 1)
    capital = (F.length(rom) > 1) & rom.rlike("^[A-Z]") & _yes(F.col("n1.c").rlike(r"\p{Lu}"))
    braille_capital = ((F.col("p1.c") == "⠠") | F.col("shouted")) & rom.rlike("^[a-z]")
    braille = F.when(F.col("shouted"), F.upper(rom)).otherwise(F.initcap(rom))
    # a grave over a Coptic letter puts an e before it; mu before a Latin unit, and not in a Greek word, is the micro sign
    coptic = (script == "COPTIC") & (F.col("n1.c") == "\u0300")
    micro = c.isin("μ", "µ") & _yes(F.col("n1.c").rlike("^[A-Za-z]$")) & ~_yes(F.col("p1.script") == "GREEK")
    txt = (
        F.when(_yes(braille_capital), braille)
        .when(_yes(micro), "µ")
        .when(_yes(coptic), F.concat(F.lit("e"), rom))
        .when(is_abugida, kept)
        .when(doubler, doubled)
        .when(long_mark, vowel)
        .when(capital, F.upper(rom))
        .otherwise(rom)
    )
    letters = F.regexp_replace(rom, "([bcdfghjklmnpqrstvwxyz'])a$", "$1")
    is_tibetan = (script == "TIBETAN") & kind.isin("letter", "medial")
    tibetan = F.array(_reading(F.lit(""), SILENT), _reading(F.concat(letters, F.lit("a")), CARRIES), _reading(letters))
    is_thai = (script == "THAI") & (kind != "digit")
    # a virama belongs to the letter it silences
    end = F.col("pos") + F.when(_yes((kind == "letter") & (F.col("n1.kind") == "virama")), 2).otherwise(1)
    named = lambda t: (
        F.when(kind == "digit", "num")
        .when(F.col("category") == "Co", "Co")
        .when(kind == "format", "Cf")
        .when((kind == "mark") & (t == ""), "Mn")
        .when(x["c"] == t, "orig")
        .when(kind == "tail", "rom tail")
        .when(F.col("decomposed"), "rom decomp")
        .otherwise("rom")
    )
    # letters of one reading, nearly all, go without a loop: what is inside of one isn't in generated code
    several = F.transform(F.when(_yes(is_tibetan), tibetan).otherwise(_thai()), lambda r, i: _edge(F.col("pos"), end, 100 - i, r.txt, named(r.txt), r.need))
    return F.when(_yes(is_tibetan) | _yes(is_thai), several).otherwise(F.array(_edge(F.col("pos"), end, F.lit(100), txt, named(txt), F.lit(0))))


def _edge(start: Column, end: Column, rank: Column, txt: Column, kind: Column, need: Column) -> Column:
    """An edge with what it is ordered by: place, then the longest, then the highest rank."""
    return F.struct(start.cast("int").alias("start"), (-end).cast("int").alias("shorter"), (-rank).cast("long").alias("lower"), end.cast("int").alias("end"), txt.alias("txt"), kind.alias("type"), need.cast("int").alias("need"))


@_once
def _by_rule() -> Column:
    """Edges of the rules that begin here, where language and place in the word allow them.

    Where a word starts is told by the letter on the left or, after what is no
    letter, by what was read there; where it ends, by the character after the
    span, or by a rule that begins there and gives a letter.
    """
    lcode, script, braille, first, letter_before = F.col("lcode"), F.col("x.script"), F.col("braille"), F.col("first"), F.col("letter_before")
    is_letter = script.isin(sorted(char_tables.ABUGIDAS)) & (F.col("x.kind") == "letter")

    def seen(f: Column) -> Column:
        return F.struct(f.n.alias("n"), f.rule.alias("r"), F.get("nexts", f.n - 1).alias("after"), (~_yes(F.get("sounds_at", f.n - 1))).alias("at_end"))

    def allowed(f: Column) -> Column:
        place = f.r.place
        fits = (F.size(f.r.lcodes) == 0) | F.array_contains(f.r.lcodes, F.coalesce(lcode, F.lit("")))
        ends_well = F.when(place.isin("end", "whole"), f.at_end).when(place == "mid", ~f.at_end).otherwise(True)
        starts_well = F.when(place.isin("start", "whole"), ~letter_before).when(place == "mid", ~first).otherwise(True)
        return fits & ends_well & starts_well

    def judged(f: Column) -> Column:
        sign_after = _yes(f.after.kind.isin("vowel sign", "virama", "medial") & f.after.script.isin(sorted(char_tables.ABUGIDAS)))
        silent = is_letter & f.r.t.rlike("^[bcdfghjklmnpqrstvwxyz]+a$") & (sign_after | (f.at_end & (script == "DEVANAGARI") & ~lcode.eqNullSafe("san")))
        need = F.when(f.r.place.isin("start", "whole") & ~first, F.when(braille, UNMARKED).otherwise(NO_LETTER)).when((f.r.place == "mid") & ~letter_before, LETTER).otherwise(0)
        ended = f.after.isNull() | _yes(f.after.c.isin(list(THAI_BEFORE))) | ~_yes(f.after.c.rlike(r"^[\p{L}\p{M}]$"))
        end = F.col("pos") + f.n + F.when(_yes(is_letter & (f.after.kind == "virama")), 1).otherwise(0)
        txt = F.when(silent, F.regexp_replace(f.r.t, "a$", "")).otherwise(f.r.t)
        # a second target holds where a syllable ends: before what is no letter, or before a consonant that follows no consonant
        closed = f.r.at_syllable_end.isNotNull() & (ended | ~_yes(f.after.rom.rlike("^[aeiou]")))
        return F.struct(txt.alias("txt"), F.when(closed, f.r.at_syllable_end).alias("other"), F.when(ended | (need > 0), need).otherwise(NO_CONSONANT).alias("other_need"), need.alias("need"), end.alias("end"), (f.r.rank * 2 + 10_000).alias("rank"))

    def edges(f: Column) -> Column:
        edge = lambda t, need, more: _edge(F.col("pos"), f.end, f.rank + more, t, F.lit("rom"), need)
        return F.when(f.other.isNotNull(), F.array(edge(f.other, f.other_need, 1), edge(f.txt, f.need, 0))).otherwise(F.array(edge(f.txt, f.need, 0)))

    found = F.transform(F.filter(F.transform("rules", seen), allowed), judged)
    upper, capital = braille & F.col("shouted"), braille & _yes(F.col("p1.c") == "⠠")
    cased = F.transform(found, lambda f: f.withField("txt", F.when(upper, F.upper(f.txt)).when(capital, F.concat(F.upper(F.substring(f.txt, 1, 1)), F.substring(f.txt, F.lit(2), F.length(f.txt)))).otherwise(f.txt)))
    return F.flatten(F.transform(F.when(braille, cased).otherwise(found), edges))


def _tibetan_places(all_: Column) -> Column:
    """(carries, silent): where a default vowel goes, and which apostrophes aren't read, in the syllables of ``all_``.

    ``all_`` are places (pos, syllable, c, kind, letters) of Tibetan letters and
    signs.  A written vowel, or a small a (འ) after the first letter, leaves no
    choice; else the vowel follows the root, the place of least cost by what
    stands before and after it.
    """
    letter_before = lambda s, p: F.exists(s, lambda q: q.pos < p.pos)
    is_vowel = lambda p: (p.kind == "vowel sign") | p.letters.rlike("^[aeiou]+$")
    small_a = lambda p: p.c == "འ"
    under = lambda p: p.kind == "medial"

    def syllable(s: Column) -> Column:
        first, last = F.element_at(s, 1).pos, F.element_at(s, -1).pos
        forced = F.transform(F.filter(s, lambda p: (p.pos > first) & (small_a(p) | (p.c == "\u0fb0"))), lambda p: p.pos - 1)
        written = F.exists(s, is_vowel)
        never = F.concat(F.transform(F.filter(s, lambda p: under(p) & (p.c != "\u0fb0")), lambda p: p.pos - 1), F.transform(F.filter(s, small_a), lambda p: p.pos))
        sounds = F.transform(s, lambda p, i: F.when(small_a(p), F.when((i > 0) & ~_yes(F.get(s, i - 1).letters.isin(*"aeiou")), "a'").otherwise("'")).otherwise(p.letters))
        n = F.size(s)

        def cost(p: Column, i: Column) -> Column:
            before, after = F.array_join(F.slice(sounds, 1, i + 1), ""), F.array_join(F.slice(sounds, i + 2, n), "")
            onset = F.regexp_replace(before, "^'", "")
            good_onset = (F.length(onset) == 1) | (before == "'") | onset.isin(TIBETAN_ONSETS)
            coda = F.regexp_replace(after, "'$", "")
            good_coda = (coda == "") | coda.rlike("^[bcdfghjklmnpqrstvwxz]$") | coda.isin(TIBETAN_CODAS)
            all_under = F.forall(F.slice(s, i + 3, n), under)
            size = F.length(before).cast("double")
            long = F.when(good_coda & good_onset, size * 0.1).when(good_coda, size).when(all_under & good_onset, size * 0.3).when(all_under, size * 0.5)
            return F.when(F.array_contains(never, p.pos), 20.0).when(n == 1, 0.0).when(n == 2, F.when(i == 0, 0.0).otherwise(0.1)).otherwise(long)

        costs = F.filter(F.transform(s, lambda p, i: F.struct(cost(p, i).alias("cost"), p.pos.alias("pos"))), lambda x: x.cost.isNotNull())
        carries = F.when(F.size(forced) > 0, forced).when(written, F.array().cast("array<int>")).otherwise(F.when(F.size(costs) > 0, F.array(F.array_min(costs).pos)).otherwise(F.array().cast("array<int>")))
        at_end = F.transform(F.filter(s, lambda p: small_a(p) & (p.pos > first) & (p.pos == last)), lambda p: p.pos)
        at_start = F.when(small_a(F.element_at(s, 1)) & _yes(F.get(F.transform(s, lambda p: is_vowel(p)), F.lit(1))), F.array(first)).otherwise(F.array().cast("array<int>"))
        return F.struct(carries.alias("carries"), F.concat(at_end, at_start).alias("silent"))

    numbers = F.array_distinct(F.transform(all_, lambda p: p.syllable))
    return F.transform(numbers, lambda k: _let(F.filter(all_, lambda p: p.syllable == k), syllable))


def _number_edges(found: Column, chars: Column) -> Column:
    """Edges of composed numbers, of fractions and percentages of two of them, and with their signs."""
    at = lambda i: F.get(chars, i)
    edge = lambda start, end, txt, kind: F.struct(start.alias("start"), end.alias("end"), txt.alias("txt"), kind.alias("type"))
    alone = lambda n: (n.end - n.start == 1) & ((n.value > 1000) | at(n.start).isin(list(NOT_ALONE)) | at(n.start).rlike(r"\p{Nd}"))

    def with_more(nums: Column) -> Column:
        plain = F.transform(nums, lambda n: edge(n.start, n.end, n.txt, F.when(n.txt.contains("/"), "fraction").otherwise("number")))

        def over(n: Column, i: Column) -> Column:
            m = F.get(nums, i + 1)
            joined = _yes((m.start == n.end + len(OVER)) & (at(n.end) == OVER[0]) & (at(n.end + 1) == OVER[1]) & (n.value > 0))
            hundred = n.value == 100
            return F.when(joined, edge(n.start, m.end, F.when(hundred, F.concat(m.txt, F.lit("%"))).otherwise(F.concat(m.txt, F.lit("/"), n.txt)), F.when(hundred, "percentage").otherwise("fraction")))

        return F.concat(plain, F.filter(F.transform(nums, over), lambda e: e.isNotNull()))

    def with_signs(edges: Column) -> Column:
        sign = lambda e: F.when(e.start > 0, F.when(at(e.start - 1).isin(list(in_place.MINUS)), "-").when(at(e.start - 1).isin(list(in_place.PLUS)), "+"))
        signed = F.transform(F.filter(edges, lambda e: sign(e).isNotNull()), lambda e: edge(e.start - 1, e.end, F.concat(sign(e), e.txt), F.concat(e.type, F.lit(" "), sign(e))))
        return F.concat(edges, signed)

    return _let(_let(F.filter(found, lambda n: ~_yes(alone(n))), with_more), with_signs)


def _braille_numbers(cells: Column) -> Column:
    """Edges of braille numbers: from a number sign over the digits, dots and commas that it holds for; ``cells`` are (mark, pos, d)."""
    of = lambda m: F.filter(cells, lambda p: p.mark == m)
    numbers = F.transform(F.array_distinct(F.transform(cells, lambda p: p.mark)), lambda m: F.struct(m.alias("start"), (F.array_max(F.transform(of(m), lambda p: p.pos)) + 1).alias("end"), F.array_join(F.transform(of(m), lambda p: p.d), "").alias("txt"), F.lit("number").alias("type")))
    return F.filter(numbers, lambda e: e.txt.rlike("[0-9]"))


def _allowed(need: Column, left: Column) -> Column:
    """Whether what was read on the left is what an edge needs."""
    vowelless = "[bcdfghjklmnpqrstvxz]"
    return (
        F.when(need == 0, True)
        .when(need == NO_LETTER, ~left.rlike(r"\p{L}$"))
        .when(need == LETTER, left.rlike(r"\p{L}$"))
        .when(need == UNMARKED, ~left.rlike(r"[\p{L}']$"))
        .when(need == NO_CONSONANT, ~left.rlike(f"{vowelless}$"))
        .when(need == CONSONANTS, left.rlike(r"^[bcdfghjklmnpqrstvwxz]+$"))
        .otherwise(False)
    )


def _path(edges: Column) -> Column:
    """From the left, the first edge in order at each place, if what was read before it allows it.

    The reading on the left goes along the fold, so a rule can depend on it.
    The fold goes by slices, so that long paths aren't copied at each step.
    """
    none = F.array().cast(f"array<{EDGE}>")
    state = lambda at, left, path: F.struct(at.alias("at"), left.alias("left"), path.alias("path"))

    def step(a: Column, e: Column) -> Column:
        left = F.when((e.txt == "") & (e.type != "Cf"), a.left).otherwise(e.txt)
        return F.when((e.start >= a.at) & _allowed(e.need, a.left), state(e.end, left, F.array_append(a.path, F.struct(e.start, e.end, e.txt, e.type).cast(EDGE)))).otherwise(a)

    def piece(a: Column, i: Column) -> Column:
        inner = F.aggregate(F.slice(edges, i, SLICE), state(a.at, a.left, none), step)
        return _let(inner, lambda r: state(r.at, r.left, F.concat(a.path, r.path)))

    starts = F.sequence(F.lit(1), F.greatest(F.size(edges), F.lit(1)), F.lit(SLICE))
    return F.aggregate(starts, state(F.lit(0), F.lit(""), none), piece, lambda a: a.path)


def _pieces(words: DataFrame) -> DataFrame:
    """(ta, tb, at, pa, pb, token, lcode): the pieces of (ta, tb, token, lcode), named by two hashes, and the place of each.

    ``token`` is the piece with one character on either side, or a letter and
    its virama on the left; the last three bits of ``pb`` tell how many.
    """
    kinds = F.translate("token", *cuts.classes())
    # beside numerals of other scripts, digits and signs can be part of a number
    kinds = F.when(kinds.contains(cuts.NUMERAL), F.translate(kinds, cuts.ASCII, "#")).otherwise(kinds)
    cut = words.select("*", kinds.alias("kinds")).select(*ID, "token", "lcode", F.when(F.col("token").rlike(cuts.BRAILLE), F.array("kinds")).otherwise(F.regexp_extract_all("kinds", F.lit(cuts.PIECE), F.lit(0))).alias("parts"))
    around = lambda p, i: F.struct(F.length(p).alias("n"), F.when(i == 0, 0).when(F.get("parts", i - 1).endswith(cuts.VIRAMA), 2).otherwise(1).alias("l"), F.when(i + 1 < F.size("parts"), 1).otherwise(0).alias("r"))
    placed = cut.select(*ID, "token", "lcode", F.inline(F.arrays_zip(F.transform("parts", around).alias("p"), _places(F.col("parts")).alias("at"))))
    part = F.substring("token", F.col("at") - F.col("p.l") + 1, F.col("p.l") + F.col("p.n") + F.col("p.r"))
    rows = placed.select(*ID, "lcode", "at", (F.col("p.l") * 2 + F.col("p.r")).alias("around"), part.alias("token"))
    name = F.xxhash64(F.lit(1), "token", "lcode").bitwiseAND(F.lit(-8)).bitwiseOR(F.col("around").cast("long"))
    return rows.select(*ID, "at", F.xxhash64("token", "lcode").alias("pa"), name.alias("pb"), "token", "lcode")


def _places(parts: Column) -> Column:
    """Where each of the parts begins: a running sum of lengths, in one step for each part."""
    return F.aggregate(parts, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all")), lambda a, t: F.struct((a.sum + F.length(t)).alias("sum"), F.array_append(a.all, a.sum).alias("all")), lambda a: a.all)


def _of_pieces(different: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(ta, tb, edges, every) of different pieces, without the edges of what stands beside them."""
    around = F.col("tb").bitwiseAND(F.lit(7)).cast("int")
    before = F.floor(around / 2).cast("int")
    end = F.element_at("edges", -1).end - around % 2
    own = lambda c: F.transform(F.filter(c, lambda e: (e.start >= F.col("before")) & (e.start < F.col("to"))), lambda e: F.struct((e.start - F.col("before")).alias("start"), (e.end - F.col("before")).alias("end"), e.txt.alias("txt"), e.type.alias("type")))
    return read(different).select("*", before.alias("before"), end.alias("to")).select(*ID, own("edges").alias("edges"), own("every").alias("every"))


def in_pieces(words: DataFrame, read: Callable[[DataFrame], DataFrame], text: bool = False) -> DataFrame:
    """(ta, tb, edges, every) of the different (ta, tb, token, lcode), or with ``text`` (ta, tb, r): what ``read`` gives for each different piece, put together.

    Words are without number, the pieces that they are made of are few.  Where a
    word can be cut is told in ``plans.cuts``; what can't is one piece.
    """
    # the words of one task stay there: what follows is explode and group
    parts = max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    placed = _pieces(words.repartition(parts, *ID))
    different = placed.select(F.col("pa").alias("ta"), F.col("pb").alias("tb"), "token", "lcode").distinct()
    found = _of_pieces(different, read).select(F.col("ta").alias("pa"), F.col("tb").alias("pb"), "edges", "every")
    if text:
        found = found.select("pa", "pb", F.array_join(F.transform("edges", lambda e: e.txt), "").alias("r"))
    names = ["r"] if text else ["edges", "every"]
    grouped = placed.select(*ID, "at", "pa", "pb").join(found, ["pa", "pb"]).groupBy(*ID).agg(F.array_sort(F.collect_list(F.struct("at", *names))).alias("all"))
    if text:
        return grouped.select(*ID, F.array_join(F.transform("all", lambda p: p.r), "").alias("r"))
    moved = lambda name: F.flatten(F.transform("all", lambda p: F.transform(p[name], lambda e: F.struct((e.start + p["at"]).alias("start"), (e.end + p["at"]).alias("end"), e.txt.alias("txt"), e.type.alias("type")))))
    return grouped.select(*ID, moved("edges").alias("edges"), moved("every").alias("every"))


def read_tokens(words: DataFrame, more: tuple[tuple, ...] | DataFrame = (), text: bool = False) -> DataFrame:
    """(ta, tb, edges, every) of the different (ta, tb, token, lcode), or with ``text`` (ta, tb, r): see ``read_whole``; without rules of the caller, words are read in pieces."""
    if isinstance(more, DataFrame) or more:
        read = read_whole(words, more)
        return read.select(*ID, F.array_join(F.transform("edges", lambda e: e.txt), "").alias("r")) if text else read
    return in_pieces(words, read_whole, text)


def read_whole(words: DataFrame, more: tuple[tuple, ...] | DataFrame = ()) -> DataFrame:
    """(ta, tb, edges, every): the chosen edges of the different (token, lcode), and all edges that don't depend on what is chosen, or are.

    One shuffle: a token's characters meet under its two hashes, see their
    neighbours there, grow the spans of rules, and are put together to the path.
    The token itself isn't carried along.  ``more`` are rules of the caller, over
    the authored ones: tuples, or a table of any size.
    """
    if isinstance(more, DataFrame):
        prefixes, longest = prefix_table(layered(authored(words.sparkSession), more))
    else:
        prefixes, longest = rule_table(words.sparkSession, more)
    rows = _with_rules(_with_neighbours(_characters(words), longest), prefixes, longest)
    # whether a word goes on here: a letter or sign, or a rule that gives a letter
    begins = F.exists("rules", lambda f: (f.rule.place != "start") & f.rule.t.rlike(r"\p{L}"))
    nukta = (F.col("x.kind") == "mark") & F.col("x.script").isin(sorted(char_tables.ABUGIDAS))
    rows = rows.withColumn("sounds", F.when(nukta, _in_word(F.col("n1.kind"))).otherwise(_in_word(F.col("x.kind")) | begins))
    w = Window.partitionBy(*ID).orderBy("pos")
    digit = lambda c: _yes(F.col(c).rlike("^[0-9]$"))
    in_run = F.col("number").isNotNull() | ((F.col("x.c") == ".") & digit("p1.numeral") & digit("n1.numeral"))
    tibetan = (F.col("x.script") == "TIBETAN") & F.col("x.kind").isin("letter", "medial", "vowel sign")
    rows = rows.withColumns({f"sounds{k}": F.lead("sounds", k).over(w) for k in range(1, longest + 1)} | {"syllable": F.when(tibetan, F.col("pos") - F.count_if(tibetan).over(w))})
    ruled, braille = F.size("rules") > 0, F.col("x.c").between("\u2800", "\u28ff")
    rows = rows.withColumns({
        "nexts": F.when(ruled, F.array(*[F.col(f"n{k}") for k in range(1, longest + 1)])),
        "sounds_at": F.when(ruled, F.array(*[F.col(f"sounds{k}") for k in range(1, longest + 1)])),
        "braille": braille,
        "first": F.col("p1").isNull(),
        "letter_before": _yes(F.col("p1.c").rlike(r"\p{L}") | (braille & _in_word(F.col("p1.kind")))),
    })
    native = ~F.col("x.c").rlike("^[0-9.]$")
    numeral = F.when(in_run, F.struct("pos", F.col("x.numeral").alias("numeral"), F.col("number.value").alias("value"), F.col("number.base").alias("base"), F.col("number.fraction").alias("fraction"), native.alias("native")))
    cell = F.when(F.col("mark").isNotNull(), F.struct("mark", "pos", F.when(F.col("x.c") == "⠲", ".").when(F.col("x.c") == "⠂", ",").otherwise(F.translate("x.c", char_tables.BRAILLE_DIGITS + "⠼", "1234567890")).alias("d")))
    letters = F.regexp_replace("x.rom", "([bcdfghjklmnpqrstvwxyz])a$", "$1")
    syllable = F.when(F.col("syllable").isNotNull(), F.struct("pos", "syllable", F.col("x.c").alias("c"), F.col("x.kind").alias("kind"), letters.alias("letters")))
    rows = rows.select(*ID, "pos", F.col("x.c").alias("c"), numeral.alias("numeral"), cell.alias("cell"), syllable.alias("syllable"), _single().alias("single"), F.when(ruled, _by_rule()).alias("by_rule"))
    rows = rows.withColumn("own", F.when(F.size("by_rule") > 0, F.concat("single", "by_rule")).otherwise(F.col("single")))
    some = lambda c: F.array_sort(F.collect_list(c))
    grouped = rows.groupBy(*ID).agg(
        F.array_sort(F.collect_list(F.struct("pos", "own", "c"))).alias("places"),
        F.max(F.coalesce(F.col("numeral.native"), F.lit(False))).alias("native"),
        some("numeral").alias("numerals"),
        some("cell").alias("cells"),
        some("syllable").alias("syllables"),
    )
    grouped = grouped.withColumn("found", composed(F.when(F.col("native"), F.col("numerals"))))
    grouped = grouped.withColumns({"chars": F.when(F.size("found") > 0, F.transform("places", lambda p: p.c)), "roots": F.when(F.size("syllables") > 0, _all_roots())})
    grouped = grouped.withColumn("numbers", _all_numbers())
    grouped = grouped.select(*ID, _all_edges().alias("all"), F.size("places").alias("size"))
    # tokens of one edge for each place need no choice
    plain = (F.size("all") == F.col("size")) & F.forall("all", lambda e: (e.need == 0) & (e.end == e.start + 1))
    grouped = grouped.withColumn("plain", plain)
    grouped = grouped.withColumn("path", F.when(F.col("plain"), _listed(F.col("all"))).otherwise(_chosen()))
    return grouped.select(*ID, F.when(F.exists("path", _is_number), _set_off()).otherwise(F.col("path")).alias("edges"), F.when(F.col("plain"), F.col("path")).otherwise(_every()).alias("every"))


def _listed(edges: Column) -> Column:
    return F.transform(edges, lambda e: F.struct(e.start.alias("start"), e.end.alias("end"), e.txt.alias("txt"), e.type.alias("type")))


def _is_number(e: Column) -> Column:
    return e.type.isin("number", "fraction")


@_once
def _all_roots() -> Column:
    return _tibetan_places(F.col("syllables"))


@_once
def _all_numbers() -> Column:
    composed_ = F.when(F.size("found") > 0, _number_edges(F.col("found"), F.col("chars"))).otherwise(F.array())
    return F.concat(composed_, F.when(F.size("cells") > 0, _braille_numbers(F.col("cells"))).otherwise(F.array()))


@_once
def _all_edges() -> Column:
    """Edges of characters, rules and numbers, in the order of the path."""
    own = F.flatten(F.transform("places", lambda p: p.own))
    at = lambda e, name: F.exists("roots", lambda r: F.array_contains(r[name], e.start))
    of_root = F.filter(own, lambda e: F.when(e.need == CARRIES, at(e, "carries")).when(e.need == SILENT, at(e, "silent")).otherwise(True))
    settled = F.transform(of_root, lambda e: F.when(e.need.isin(CARRIES, SILENT), e.withField("need", F.lit(0))).otherwise(e))
    edges = F.when(F.col("roots").isNotNull(), settled).otherwise(own)
    numbers = F.transform("numbers", lambda n: _edge(n.start, n.end, F.lit(10**15), n.txt, n.type, F.lit(0)))
    return F.array_sort(F.when(F.size("numbers") > 0, F.concat(edges, numbers)).otherwise(edges))


@_once
def _chosen() -> Column:
    return _path(F.col("all"))


@_once
def _every() -> Column:
    return F.array_union(_listed(F.filter("all", lambda e: e.need == 0)), F.col("path"))


@_once
def _set_off() -> Column:
    """The path with numbers after digits set off: by a space if they are fractions, else by a dot."""
    follows = lambda e, i: _is_number(e) & e.txt.rlike("^[0-9]") & _yes(F.get("path", i - 1).txt.rlike("[0-9]$"))
    return F.transform("path", lambda e, i: F.when(follows(e, i), e.withField("txt", F.concat(F.when(e.type == "fraction", " ").otherwise("·"), e.txt))).otherwise(e))


def _column(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


@cache
def _breaks_read() -> dict[str, str]:
    every = [c for c in map(chr, (*range(0x2190), *range(0x3000, 0x3100), *range(0xFF00, 0xFF80))) if re.match(f"[{_BREAKS}]", c)]
    return {c: rom for c in every if (rom := char_tables.character_row(ord(c))[4]) is not None and c != " "}


@cache
def _digits_read() -> dict[str, str]:
    """Decimal digits beyond ASCII; a word of nothing but digits is the number that they write, in any script, language or mixture."""
    return {chr(cp): rom for cp, _, _, kind, rom, digit, value, base, *_ in char_tables.character_rows() if kind == "digit" and rom == str(digit) and (value, base) == (digit, 1)}


def _between(lcode: Column | None) -> Callable[[Column], Column]:
    """The reading of what stands between words: Latin text and breaks."""
    breaks = _breaks_read()

    def read(x: Column) -> Column:
        out = romanize_latin(x, lcode)
        for c, t in breaks.items():
            out = F.replace(out, F.lit(c), F.lit(t))
        return F.when(F.octet_length(x) == F.length(x), x).otherwise(out)  # most are a space

    return read


@cache
def _signs(by_language: bool, han: tuple[tuple[str, str], ...]) -> in_place.Signs:
    """What texts are cut by, and the readings of what stands between words, as ``_between`` has them, of decimal digits, and of ``han``."""
    latin, breaks = in_place.members(_LATIN.replace(r"\u0000", "\0")), in_place.members(_BREAKS)
    digits, plain = in_place.members("0-9" + "".join(_digits_read())), {}
    for code in ("", *BY_LANGUAGE) if by_language else ("",):
        table = folds() | BY_LANGUAGE.get(code, {}) | _breaks_read()
        table |= _digits_read()
        plain[code] = {cp: table.get(chr(cp), chr(cp)).encode() for cp in (latin | breaks | digits).nonzero()[0].tolist()} | {ord(c): t.encode() for c, t in han}
    return in_place.Signs(in_place.kinds(), breaks, ~(latin | breaks), digits, plain)


def romanize(df: DataFrame, text_col: str, out_col: str = "romanized", lcode_col: str | None = None, rules: tuple[tuple[str, ...], ...] | DataFrame = ()) -> DataFrame:
    """``df`` with ``out_col``: ``text_col`` in Latin letters.

    ``lcode_col`` names a column of ISO 639-3 codes; ``rules`` are rules of the
    caller: (source, target, space-separated codes, place[, target where a
    syllable ends]), or a table (s, t, lcodes, place) such as rule files give.
    Null texts stay null, the order of rows is not kept.

    What is shuffled beside the rows themselves are the different texts and,
    for each word to look up, the text's two 64-bit hashes, a place and the
    word.  Repeated texts and words are read once.
    """
    text, lcode = _column(text_col), _column(lcode_col) if lcode_col else F.lit(None).cast("string")
    easy = text.isNull() | is_ascii(text) | text.rlike(LATIN_ONLY)
    hard_pattern = _HARD
    if isinstance(rules, DataFrame) or rules:
        easy, hard_pattern = text.isNull(), f"({_NO_BREAK}+)"
    plain = romanize_latin(text, lcode if lcode_col else None)
    if not (isinstance(rules, DataFrame) or rules):
        hard = df.where(~easy).select(*[_column(c) for c in df.columns], text.alias("__text"), lcode.alias("__lcode"))
        joined_up = F.array_join(F.transform("edges", lambda e: e.txt), "").alias("r")
        given = in_place.read(hard, _signs(bool(lcode_col), char_tables.han_words(df.sparkSession, in_place.MINUS + in_place.PLUS)), False, lambda pieces: _of_pieces(pieces, read_whole).select("ta", joined_up))
        if given:
            return df.where(easy).select(*[_column(c) for c in df.columns], plain.alias(out_col)).union(in_place.with_texts(hard, given, out_col))
    keys = {"__a": F.xxhash64(text, lcode), "__b": F.xxhash64(F.lit(1), text, lcode)}
    texts = df.where(~easy).select(text.alias("text"), lcode.alias("lcode"), *[v.alias(k) for k, v in keys.items()]).distinct()
    placed = with_ids(texts.select("__a", "__b", "lcode", F.posexplode(F.regexp_extract_all("text", F.lit(hard_pattern), F.lit(1))).alias("i", "token")))
    words = placed.select(*ID, "token", "lcode").distinct()
    read = read_tokens(words, rules, text=True)
    joined = placed.select("__a", "__b", "i", *ID).join(read, list(ID))
    readings = joined.groupBy("__a", "__b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x.r).alias("__r"))
    # the text between those words; what a word starts with can be punctuation, so nothing else is cut
    between = F.transform(F.split(text, hard_pattern, -1), _between(lcode if lcode_col else None))
    whole = F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get("__r", i), F.lit("")))), "")
    names = [_column(c) for c in df.columns]
    rows = df.withColumns({k: F.when(~easy, v) for k, v in keys.items()})
    easy_rows = df.where(easy).select(*names, plain.alias(out_col))
    hard_rows = rows.where(F.col("__a").isNotNull()).join(readings, ["__a", "__b"], "left")
    return easy_rows.union(hard_rows.select(*names, whole.alias(out_col)))


def _read_texts(df: DataFrame, key: str, text_col: str, lcode_col: str | None, read: Callable[[DataFrame], DataFrame] = read_tokens) -> DataFrame:
    """(__key, offset, edges, every) of each token of each row; places are of the token, ``offset`` is its place in the text.

    Rows with one key are texts of their own.
    """
    lcode = _column(lcode_col) if lcode_col else F.lit(None).cast("string")
    cut = df.select(_column(key).alias("__key"), lcode.alias("lcode"), tokens(_column(text_col)).alias("__tokens"))
    placed = with_ids(cut.select("__key", "lcode", F.inline(F.arrays_zip(F.col("__tokens").alias("token"), _places(F.col("__tokens")).alias("offset")))))
    words = placed.select(*ID, "token", "lcode").distinct()
    return placed.select("__key", "offset", *ID).join(read(words), list(ID))


def _in_place(df: DataFrame, key: str, text_col: str, lcode_col: str | None, whole: Callable[[DataFrame], DataFrame], wanted: Column) -> tuple[DataFrame, tuple | None]:
    """(__key, __text, __lcode) of each row with a text, and what ``wanted``, an expression of what is read of a piece, is for its pieces; None if there are too many different ones."""
    lcode = _column(lcode_col) if lcode_col else F.lit(None).cast("string")
    rows = df.where(F.length(_column(text_col)) > 0).select(_column(key).alias("__key"), _column(text_col).alias("__text"), lcode.alias("__lcode"))
    return rows, in_place.read(rows, _signs(False, ()), True, lambda pieces: _of_pieces(pieces, whole).select("ta", wanted.alias("wanted")))


def _edges_in_place(df: DataFrame, key: str, text_col: str, lcode_col: str | None, whole: Callable[[DataFrame], DataFrame], edges: Column) -> DataFrame | None:
    """(__key, edges) of each row with a text, ``edges`` being an expression of what is read of a piece; None if there are too many different pieces."""
    rows, given = _in_place(df, key, text_col, lcode_col, whole, edges)
    return in_place.with_edges(rows, given, EDGE) if given else None


def edge_sums(df: DataFrame, key: str, text_col: str, types: tuple[str, ...] = (), lcode_col: str | None = None, whole: Callable[[DataFrame], DataFrame] = read_whole) -> DataFrame:
    """(key, n_edges, n_of_types, covered, read): of each text that isn't null or empty, how many edges it has, of all types and of each of ``types``, how many characters they cover in all, and their readings joined.

    Where texts are read in place, these are summed from their pieces, and no edge goes to the JVM.
    """
    n = lambda c: F.size(c).cast("long")
    covered = F.aggregate("edges", F.lit(0).cast("long"), lambda a, e: a + (e.end - e.start))
    counts = F.array(n("edges"), covered, *[n("edges") - n(F.array_remove("edges.type", t)) for t in types])
    read = F.array_join("edges.txt", "")
    rows, given = _in_place(df, key, text_col, lcode_col, whole, F.struct(read.alias("txt"), counts.alias("counts")))
    sums = in_place.with_sums(rows, given) if given else _joined_lists(rows, whole).select("__key", read.alias("read"), counts.alias("sums"))
    of = lambda i: F.get("sums", F.lit(i))
    return sums.select(F.col("__key").alias(key), of(0).alias("n_edges"), F.slice("sums", 3, len(types)).alias("n_of_types"), of(1).alias("covered"), "read")


def edge_lists(df: DataFrame, key: str, text_col: str, lcode_col: str | None = None, whole: Callable[[DataFrame], DataFrame] = read_whole) -> DataFrame:
    """(key, edges): a row for each text that isn't null or empty, with its edges in order."""
    found = _edges_in_place(df, key, text_col, lcode_col, whole, F.col("edges"))
    if found is not None:
        return found.select(F.col("__key").alias(key), "edges")
    lcode = _column(lcode_col) if lcode_col else F.lit(None).cast("string")
    rows = df.where(F.length(_column(text_col)) > 0).select(_column(key).alias("__key"), _column(text_col).alias("__text"), lcode.alias("__lcode"))
    return _joined_lists(rows, whole).select(F.col("__key").alias(key), "edges")


def _joined_lists(rows: DataFrame, whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(__key, edges) of (__key, __text, __lcode) by joins: each different text is read once."""
    rows = rows.withColumn("__hash", F.struct(F.xxhash64("__text", "__lcode").alias("a"), F.xxhash64(F.lit(1), "__text", "__lcode").alias("b")))
    texts = rows.select("__hash", "__text", "__lcode").distinct()
    read = _read_texts(texts, "__hash", "__text", "__lcode", lambda words: in_pieces(words, whole))
    moved = F.transform("edges", lambda e: F.struct((e.start + F.col("offset")).alias("start"), (e.end + F.col("offset")).alias("end"), e.txt.alias("txt"), e.type.alias("type")))
    lists = read.groupBy(F.col("__key").alias("__hash")).agg(F.array_sort(F.collect_list(F.struct("offset", moved.alias("e")))).alias("all"))
    return rows.join(lists, "__hash").select("__key", F.flatten(F.transform("all", lambda p: p.e)).cast(f"array<{EDGE}>").alias("edges"))


def _shifted(rows: DataFrame, key: str, edges: Column) -> DataFrame:
    # the outer form: Spark would repeat the whole expression of the edges in a filter for the other
    e = rows.select(F.col("__key").alias("__k"), "offset", F.inline_outer(edges))
    return e.where("start is not null").select(F.col("__k").alias(key), (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"), "txt", "type")


def rows_of_edges(df: DataFrame, key: str, text_col: str, lcode_col: str | None, whole: Callable[[DataFrame], DataFrame], edges: Column) -> DataFrame:
    """(key, start, end, txt, type): a row for each of ``edges``, an expression of what is read of a word or piece."""
    found = _edges_in_place(df, key, text_col, lcode_col, whole, edges)
    if found is None:
        return _shifted(_read_texts(df, key, text_col, lcode_col, lambda words: in_pieces(words, whole)), key, edges)
    return _shifted(found.withColumn("offset", F.lit(0)), key, F.col("edges"))


def romanize_edges(df: DataFrame, key: str, text_col: str, lcode_col: str | None = None, rom_format: str = "edges") -> DataFrame:
    """(key, start, end, txt, type): the chosen edges, or with "lattice" all of them; places are code points of the whole text.

    Rows with one key are texts of their own.
    """
    if rom_format not in FORMATS[1:]:
        raise ValueError(f"rom_format is one of {FORMATS[1:]}")
    return rows_of_edges(df, key, text_col, lcode_col, read_whole, F.col("edges" if rom_format == "edges" else "every"))


def romanize_alternatives(df: DataFrame, key: str, text_col: str, lcode_col: str | None = None) -> DataFrame:
    """(key, start, end, txt, type): the chosen edges, and as "rom-alt" the other readings of their spans."""
    def others(e: Column) -> Column:
        same = F.filter("every", lambda x: (x.start == e.start) & (x.end == e.end) & (x.txt != e.txt))
        return F.array_distinct(F.transform(same, lambda x: F.struct(x.start, x.end, x.txt, F.lit("rom-alt").alias("type")).cast(EDGE)))

    both = F.concat("edges", F.flatten(F.transform("edges", others)))
    return rows_of_edges(df, key, text_col, lcode_col, read_whole, F.when(F.size("every") > F.size("edges"), both).otherwise(F.col("edges")))


def inline_alternatives(edges: DataFrame, key: str) -> DataFrame:
    """(key, romanized): the readings in order, several of one span as {a|b}."""
    spans = edges.groupBy(key, "start").agg(F.array_sort(F.collect_set(F.struct((F.col("type") == "rom-alt").alias("alt"), "txt"))).alias("r"))
    shown = F.when(F.size("r") == 1, F.col("r")[0].txt).otherwise(F.concat(F.lit("{"), F.array_join(F.transform("r", lambda x: x.txt), "|"), F.lit("}")))
    return spans.select(key, "start", shown.alias("t")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "t"))), lambda x: x.t), "").alias("romanized"))


#: Characters that a match of the quick reading covers at most.
QUICK = 4


@cache
def _quick_rules(lcode: str) -> dict[str, str]:
    """Readings of the sources of two to QUICK characters that hold anywhere in a word, those of the language first."""
    found: dict[str, str] = {}
    for codes in ((), (lcode,)):
        found |= {s: t for s, t, lc, place, *_ in RULES if 1 < len(s) <= QUICK and not place and (not lc if not codes else lcode in lc.split())}
    return found


def quick(text: Column, lcode: str = "") -> Column:
    """A rough reading of one pass: from the left the longest of the rules of up to four characters, else each letter by its own sound.

    Rules hold in any place of a word and without regard to what is beside
    them; those of ``lcode`` come first.  Null stays null.
    """
    sounds = {c: t for c, t in char_tables.letter_sounds().items() if t.isascii()}
    sounds |= {c: sounds[base] for c, base in folds().items() if c not in sounds and base in sounds}
    return F.when(is_ascii(text), text).otherwise(spans.replaced(F.when(~is_ascii(text), text), _quick_rules(lcode), sounds))


def mouse_over(edges: DataFrame, texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, html): the reading, with the original of each changed span as its title."""
    e = edges.join(texts.select(key, F.col(text_col).alias("original")), key)
    piece = F.substring("original", F.col("start") + 1, F.col("end") - F.col("start"))
    shown = F.when(F.col("txt") == piece, guarded_html(piece)).otherwise(F.concat(F.lit('<span title="'), guarded_html(piece), F.lit('">'), guarded_html(F.col("txt")), F.lit("</span>")))
    return e.select(key, "start", shown.alias("h")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "h"))), lambda x: x.h), "").alias("html"))


def offset_alignment(edges: DataFrame, key: str) -> DataFrame:
    """(key, alignment): for the first character of each edge, its place in the text and in the romanization, as o:r pairs."""
    w = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = edges.withColumn("r", F.coalesce(F.sum(F.length("txt")).over(w), F.lit(0)))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("start", "r"))), lambda x: F.concat(x.start.cast("string"), F.lit(":"), x.r.cast("string")))
    return placed.groupBy(key).agg(F.array_join(pairs, ",").alias("alignment"))
