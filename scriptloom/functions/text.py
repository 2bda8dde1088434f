"""Text functions as Column expressions."""

from __future__ import annotations

import html.entities
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities and their characters.
ENTITIES = {f"&{k}": v for k, v in html.entities.html5.items() if k.endswith(";") and len(v) == 1}
_NAMED = re.compile("&[A-Za-z][A-Za-z0-9]{1,31};")
INVISIBLE = r"[\u0000-\u0008\u000B-\u000C\u000E-\u001F\u007F-\u009F\u200B-\u200F\u202A-\u202E\u2060-\u2064\uFE00-\uFE0F\uFEFF\u0640]"


# ------------------------------------------------------------------ slots and directives


def slot(line: Column, name: str) -> Column:
    """Value of ``::name value`` in a line of slots; empty if it has none, null if the slot is missing."""
    value = F.trim(F.regexp_extract(line, rf"(?:^|\s)::{name}(?:\s+(.*?))?(?=\s+::[a-zA-Z]|\s*$)", 1))
    return F.when(has_slot(line, name), value)


def has_slot(line: Column, name: str) -> Column:
    return line.rlike(rf"(?:^|\s)::{name}(?:\s|$)")


def without_slot(line: Column, name: str) -> Column:
    return F.trim(F.regexp_replace(line, rf"(?:^|\s+)::{name}(?:\s.*?)?(?=\s+::|\s*$)", ""))


def dequoted(text: Column) -> Column:
    """``text`` without a pair of quotes around it."""
    return F.regexp_replace(text, r"""^\s*(?:'(.*)'|"(.*)"|[‘“](.*)[’”])\s*$""", "$1$2$3")


def lcode_directive(line: Column) -> tuple[Column, Column, Column]:
    """(prefix, language code, rest) of a line that may start with ``::lcode xyz``; without one: empty, null, the line."""
    pattern = r"(?s)^(::lcode\s+([a-z]{3})\s+)(.*)$"
    has = line.rlike(pattern)
    return F.regexp_extract(line, pattern, 1), F.when(has, F.regexp_extract(line, pattern, 2)), F.when(has, F.regexp_extract(line, pattern, 3)).otherwise(line)


# ------------------------------------------------------------------ repair and clean-up


#: One valid UTF-8 sequence, or a byte that belongs to none, in bytes read as Latin-1.
_SEQUENCE = (
    r"([\x00-\x7F]+|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    r"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}|[\x80-\xFF])"
)
_ALONE = "^[\u0080-\u00ff]$"
#: Bytes that Windows-1252 reads otherwise than Latin-1 does, in either reading.
_CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_WINDOWS = _CONTROLS.encode("latin-1").decode("cp1252")


def valid_utf8(raw: Column) -> Column:
    """Bytes as text, with one U+FFFD for each longest part of a cut-off sequence."""
    return F.make_valid_utf8(raw)


def _sequences(raw: Column) -> Column:
    return F.regexp_extract_all(F.decode(raw.cast("binary"), "ISO-8859-1"), F.lit(_SEQUENCE), F.lit(1))


def _decoded(raw: Column, bad: Callable[[Column], Column]) -> Column:
    good = lambda x: F.when(x.rlike(_ALONE), bad(x)).otherwise(F.decode(F.encode(x, "ISO-8859-1"), "UTF-8"))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.array_join(F.transform(_sequences(raw), good), ""))


def repaired_utf8(raw: Column) -> Column:
    """Bytes as text, with U+FFFD for each byte that belongs to no valid sequence."""
    return _decoded(raw, lambda x: F.lit("\ufffd"))


def bad_bytes(raw: Column) -> Column:
    """How many bytes belong to no valid UTF-8 sequence."""
    return F.when(F.is_valid_utf8(raw.cast("string")), F.lit(0)).otherwise(F.size(F.filter(_sequences(raw), lambda x: x.rlike(_ALONE))))


def enforced_utf8(raw: Column) -> Column:
    """Bytes as text; those that belong to no valid sequence are read as Windows-1252, so its quotes and dashes stay."""
    return _decoded(raw, lambda x: F.translate(x, _CONTROLS, _WINDOWS))


def visible(text: Column) -> Column:
    """Without control, zero-width, direction and variation characters, byte-order marks and tatweel."""
    return F.regexp_replace(text, INVISIBLE, "")


def windows_decoded_twice(text: Column) -> Column:
    """UTF-8 that was read as Windows-1252 and written again, put right; anything else as it is."""
    single_bytes = text.rlike(rf"^[\u0000-\u007F\u00A0-\u00FF{_WINDOWS}]*$") & text.rlike(r"[\u00C2-\u00F4]")
    raw = F.encode(F.translate(F.when(single_bytes, text), _WINDOWS, _CONTROLS), "ISO-8859-1")
    return F.when(F.coalesce(single_bytes & F.is_valid_utf8(raw.cast("string")), F.lit(False)), F.make_valid_utf8(raw.cast("string"))).otherwise(text)


def decoded_twice(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 and written again, put right; anything else as it is."""
    single_bytes = text.rlike(r"^[\u0000-\u00FF]*$") & text.rlike(r"[\u00C2-\u00F4][\u0080-\u00BF]")
    raw = F.encode(F.when(single_bytes, text), "ISO-8859-1")
    return F.when(single_bytes & F.is_valid_utf8(raw.cast("string")), F.make_valid_utf8(raw.cast("string"))).otherwise(text)


def squeezed(text: Column) -> Column:
    """Runs of three or more of a character cut to two, dashes as hyphens, single spaces."""
    dashes = F.translate(text, "‐‑‒–—−", "------")
    return F.trim(F.regexp_replace(F.regexp_replace(dashes, r"(.)\1{2,}", "$1$1"), r"\s+", " "))


def plain_punctuation(text: Column) -> Column:
    """Curly quotes, dashes, ideographic and full-width punctuation as ASCII."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    out = F.translate(text, "‘’‚‛“”„‟«»‐‑‒–—、。〈〉" + wide, "''''" + '""""""' + "-----,.<>" + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)))
    return F.replace(out, F.lit("…"), F.lit("..."))


# ------------------------------------------------------------------ markup


def entities_decoded(text: Column) -> Column:
    """Named entities as characters, each once: &amp;lt; becomes &lt;."""

    @F.arrow_udf("string")
    def decoded(texts: pa.Array) -> pa.Array:
        one = lambda m: ENTITIES.get(m[0], m[0])
        return pa.array([None if t is None else _NAMED.sub(one, t) for t in texts.to_pylist()], pa.string())

    pattern = _NAMED.pattern
    return F.when(text.rlike(pattern), decoded(F.when(text.rlike(pattern), text))).otherwise(text)


def _in_turns(around: Column, found: Column, decoded: Callable[[Column], Column]) -> Column:
    """What stands around some parts, and the parts decoded, in turns; both arrays are made once, not for each part."""
    both = F.array(F.struct(around.alias("around"), found.alias("found")))
    return F.element_at(F.transform(both, lambda s: F.array_join(F.transform(s.around, lambda part, i: F.concat(part, F.coalesce(decoded(F.get(s.found, i)), F.lit("")))), "")), 1)


def numeric_entities_decoded(text: Column) -> Column:
    """&#233; and &#xE9; as characters, where they are valid code points."""
    pattern = r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"
    around, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))

    def decoded(entity: Column) -> Column:
        digits = F.regexp_replace(entity, "[&#xX;]", "")
        value = F.when(entity.rlike("[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        return F.when((value > 0) & (value < 0x110000) & ~value.between(0xD800, 0xDFFF), character(value)).otherwise(entity)

    return _in_turns(around, found, decoded)


def without_tags(html: Column) -> Column:
    """Markup as spaces, white space as single spaces."""
    bare = F.regexp_replace(html, r"(?s)<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def is_url(token: Column) -> Column:
    return token.rlike(r"^(?:https?|ftp)://[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+(?::[0-9]+)?(?:[/?#][^ ]*)?$")


def is_email(token: Column) -> Column:
    return token.rlike(r"^[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$")


def is_filename(token: Column) -> Column:
    return token.rlike(r"^[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.(?:txt|html?|pdf|docx?|csv|json|xml|png|jpe?g|gif|zip|gz)$")


#: Generic top-level domains that links in text commonly have.
TOP_DOMAINS = "com org net edu gov mil int info biz io co app dev".split()


def is_handle(token: Column) -> Column:
    """Whether the token is a user name such as @name or a tag such as #name."""
    return token.rlike(r"^[@#][\p{L}_][\p{L}\p{N}_]*$")


def is_entity(token: Column) -> Column:
    """Whether the token is one character reference."""
    return token.rlike(r"^&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});$")


def has_top_domain(token: Column) -> Column:
    """Whether the token reads like a host name of a common or two-letter top-level domain."""
    return token.rlike(rf"^(?i)(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:{'|'.join(TOP_DOMAINS)}|[a-z]{{2}})(?:/.*)?$")


def is_punctuation(text: Column) -> Column:
    return text.rlike(r"^[\p{P}\p{S}]+$")


def is_rare_punctuation(text: Column) -> Column:
    """Whether the text is punctuation, none of it of ASCII or of the usual quotes, dashes and dots."""
    return is_punctuation(text) & ~text.rlike(r"[\x21-\x7E‘’“”«»–—…·•]")


def is_latin_plus(text: Column) -> Column:
    """Whether all letters are Latin and there is one."""
    return text.rlike(r"\p{IsLatin}") & ~text.rlike(r"[\p{L}&&[^\p{IsLatin}]]")


def is_balanced(text: Column) -> Column:
    """Whether parentheses, brackets and braces close in the order in which they open."""
    start = F.struct(F.lit("").alias("open"), F.lit(True).alias("ok"))
    pairs = F.create_map(*[F.lit(x) for x in (")", "(", "]", "[", "}", "{")])
    signs = F.regexp_extract_all(text, F.lit(r"([()\[\]{}])"), F.lit(1))
    last = lambda a: F.substring(a.open, F.length(a.open), F.lit(1))
    opened = lambda a, c: F.struct(F.concat(a.open, c).alias("open"), a.ok.alias("ok"))
    closed = lambda a, c: F.struct(F.substring(a.open, F.lit(1), F.length(a.open) - 1).alias("open"), (a.ok & (last(a) == F.try_element_at(pairs, c))).alias("ok"))
    return F.aggregate(signs, start, lambda a, c: F.when(c.isin("(", "[", "{"), opened(a, c)).otherwise(closed(a, c)), lambda a: a.ok & (a.open == ""))


def is_guarded_html(text: Column) -> Column:
    """Whether no bare <, > or & is left."""
    return ~text.rlike(r"[<>]|&(?!(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)")


def contains_script(text: Column, script: str) -> Column:
    """Whether a character of the script (its Unicode name, such as "Thai") occurs."""
    return text.rlike(rf"\p{{Is{script}}}")


def contains_han(text: Column) -> Column:
    return contains_script(text, "Han")


def is_braille(text: Column) -> Column:
    """Whether all characters are braille cells, and there is one."""
    return text.rlike("^[\u2800-\u28FF]+$")


def has_pointed_hebrew(text: Column) -> Column:
    """Whether a Hebrew letter with a vowel point occurs."""
    return text.rlike("[\u05D0-\u05EA][\u05C1\u05C2\u05BC]*[\u05B0-\u05BB]")


def guarded_regex(text: Column) -> Column:
    """``text`` as a regular expression that matches it alone."""
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}])", r"\\$1")


def unguarded_html(text: Column) -> Column:
    return entities_decoded(text)


def guarded_html(text: Column) -> Column:
    for k, v in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


# ------------------------------------------------------------------ code points


def character(code_point: Column) -> Column:
    """The character of any code point (Spark's chr stops at 255)."""
    return F.decode(F.unhex(F.lpad(F.hex(code_point.cast("long")), 8, "0")), "UTF-32")


def code_point(text: Column) -> Column:
    return F.ascii(text)


def characters(text: Column) -> Column:
    """Array of the code points of ``text``; none for the empty text."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def escapes_decoded(text: Column) -> Column:
    r"""\xHH, \uHHHH and \UHHHHHHHH of code points above 0x80 as characters."""
    pattern = r"\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})"
    # the text around the escapes, and the escapes, taken in turns
    around = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))

    def decoded(escape: Column) -> Column:
        value = F.conv(F.substring(escape, 3, 8), 16, 10).cast("long")
        usable = (value > 0x80) & (value < 0x110000) & ~value.between(0xD800, 0xDFFF)
        return F.when(usable, character(value)).otherwise(escape)

    return _in_turns(around, found, decoded)


#: How characters beyond ASCII can be shown: before, digits of the code point at least, after.
STYLES = {"<U+>": ("<U+", 4, ">"), "\\u": ("\\u", 4, ""), "<U>": ("<U", 4, ">")}


def shown_as_code_points(text: Column, style: str = "<U+>") -> Column:
    """Characters beyond ASCII by their code points, or with style "<HEX>" by their UTF-8 bytes: <HEX-C3A9>."""

    def one(c: Column) -> Column:
        if style == "<HEX>":
            return F.concat(F.lit("<HEX-"), F.hex(F.encode(c, "UTF-8")), F.lit(">"))
        before, digits, after = STYLES[style]
        code = F.hex(F.ascii(c).cast("long"))
        return F.concat(F.lit(before), F.lpad(code, F.greatest(F.length(code), F.lit(digits)), F.lit("0")), F.lit(after))

    return F.array_join(F.transform(characters(text), lambda c: F.when(F.ascii(c) < 128, c).otherwise(one(c))), "")


def grouped(text: Column, *kinds: str) -> Column:
    """Array of the characters of ``text``, runs of the named kinds together: "numbers", "spaces", "punctuation", "words", "tags"."""
    patterns = {"tags": r"<[^<>]*>|&#?[A-Za-z0-9]+;", "numbers": r"\p{Nd}+(?:[.,]\p{Nd}+)*", "words": r"[\p{L}\p{M}]+", "spaces": r"\s+", "punctuation": r"[\p{P}\p{S}]+"}
    chosen = [p for k, p in patterns.items() if k in kinds]
    return F.regexp_extract_all(text, F.lit("((?s)" + "|".join([*chosen, "."]) + ")"), F.lit(1))


def listed(text: Column) -> Column:
    r"""Array of the parts of a comma-separated list; \, and \\ stand for themselves, spaces around a part are dropped."""
    parts = F.regexp_extract_all(F.concat(text, F.lit(",")), F.lit(r"((?s)(?:\\.|[^,\\])*),"), F.lit(1))
    return F.transform(parts, lambda x: F.regexp_replace(F.trim(x), r"(?s)\\(.)", "$1"))


#: Words that names keep in lower case.
SMALL_WORDS = "of the and in on at for to de la van von der du y e".split()


def recapitalized(name: Column) -> Column:
    """A name in lower or upper case with capitals: small words inside it stay small, mixed case stays as it is."""
    words = F.split(F.lower(name), " ")
    fixed = F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(SMALL_WORDS), w).otherwise(F.initcap(w))), " ")
    return F.when((name == F.lower(name)) | (name == F.upper(name)), fixed).otherwise(name)


def tonal_pinyin(text: Column) -> Column:
    """Syllables with a tone number, such as zhong1 and lu:3 or lv3, with tone marks; a 5 or 0 is dropped.

    The mark goes on a or e, else on the o of ou, else on the last vowel.
    """
    marks = dict(zip("aeiouü", ("āáǎà", "ēéěè", "īíǐì", "ōóǒò", "ūúǔù", "ǖǘǚǜ"), strict=True))
    table = F.create_map(*[F.lit(x) for v, m in marks.items() for t, c in enumerate(m, 1) for x in (f"{v}{t}", c)])
    parts = F.regexp_extract_all(F.replace(F.replace(text, F.lit("u:"), F.lit("ü")), F.lit("v"), F.lit("ü")), F.lit("([a-zü]+[0-5]|(?s).)"), F.lit(1))

    def one(p: Column) -> Column:
        bare, tone = F.regexp_replace(p, "[0-5]$", ""), F.regexp_extract(p, "([0-5])$", 1)
        vowel = F.when(bare.contains("a"), "a").when(bare.contains("e"), "e").when(bare.contains("ou"), "o").otherwise(F.regexp_extract(bare, "([iouü])[^aeiouü]*$", 1))
        last = F.length(bare) - F.position(vowel, F.reverse(bare)) + 1
        at = F.when(vowel.isin("a", "e"), F.position(vowel, bare)).when(bare.contains("ou"), F.position(F.lit("ou"), bare)).otherwise(last)
        marked = F.try_element_at(table, F.concat(vowel, tone))
        with_mark = F.concat(F.substring(bare, F.lit(1), at - 1), marked, F.substring(bare, at + 1, F.length(bare)))
        return F.when(p.rlike("^[a-zü]+[0-5]$"), F.when(marked.isNull() | (vowel == ""), bare).otherwise(with_mark)).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def character_type(c: Column) -> Column:
    """Broad class of a character, by the first test that holds."""
    tests = [
        ("ascii letter", r"^[A-Za-z]$"), ("digit", r"^\p{Nd}$"), ("space", r"^\s$"), ("ascii punctuation", r"^[\x21-\x7E]$"), ("latin letter", r"^\p{IsLatin}$"),
        ("greek letter", r"^\p{IsGreek}$"), ("cyrillic letter", r"^\p{IsCyrillic}$"), ("han", r"^\p{IsHan}$"), ("hangul", r"^\p{IsHangul}$"), ("kana", r"^[\p{IsHiragana}\p{IsKatakana}]$"),
        ("other letter", r"^\p{L}$"), ("mark", r"^\p{M}$"), ("number", r"^\p{N}$"), ("punctuation", r"^\p{P}$"), ("symbol", r"^\p{S}$"),
    ]
    out = F.lit("other")
    for name, pattern in reversed(tests):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


# ------------------------------------------------------------------ comparison


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, in code points."""
    same = F.zip_with(characters(a), characters(b), lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    first_off = F.array_position(same, F.lit(False))
    return F.when(first_off > 0, first_off - 1).otherwise(F.least(F.length(a), F.length(b))).cast("int")


def _longest_common(a: Column, b: Column) -> Column:
    """(n, at): length and place in ``a`` of the first longest window of ``a`` that ``b`` contains.

    Windows only grow, so there are at most twice as many tests as characters:
    fine for names and lines, quadratic in characters for whole texts.
    """
    n = F.length(a)
    start = F.struct(F.lit(0).alias("n"), F.lit(1).alias("at"))

    def from_place(best: Column, i: Column) -> Column:
        longer = lambda w: F.when(b.contains(F.substring(a, i, w.n + 1)) & (i + w.n <= n), F.struct((w.n + 1).alias("n"), i.cast("int").alias("at"))).otherwise(w)
        return F.when(b.contains(F.substring(a, i, best.n + 1)) & (i + best.n <= n), F.aggregate(F.sequence(i, n), best, lambda w, _: longer(w))).otherwise(best)

    return F.when(n == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), n), start, from_place))


def common_substring(a: Column, b: Column) -> Column:
    """Length of the longest common substring."""
    return F.coalesce(_longest_common(a, b).n, F.lit(0))


def common_substring_ratios(a: Column, b: Column) -> Column:
    """(n, ratio_a, ratio_b, substring): the longest common substring, and its length against those of both; 0 for empty texts."""
    ratio = lambda w, x: F.when(F.length(x) == 0, F.lit(0.0)).otherwise(w.n / F.length(x))
    found = F.transform(F.array(_longest_common(a, b)), lambda w: F.struct(w.n.alias("n"), ratio(w, a).alias("ratio_a"), ratio(w, b).alias("ratio_b"), F.substring(a, w.at, w.n).alias("substring")))
    return F.get(found, F.lit(0))


def sort_key(text: Column) -> Column:
    """Key by which embedded numbers of any length sort by value: a number's significant digits after their count."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def number(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), F.lit(":"), digits)

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), number(p)).otherwise(p)), "")
