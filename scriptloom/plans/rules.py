"""Romanization rules: strings of several characters, or readings of one language, over the character table."""

from __future__ import annotations

from . import char_tables

_CELL = char_tables.braille_letters()
_POINTS = "\u05b0\u05b1\u05b2\u05b3\u05b4\u05b5\u05b6\u05b7\u05b8\u05b9\u05bb"
#: Contractions of English braille: cells of two letters or more, and letters that stand for words.
_BRAILLE = (
    *((s, t, "eng", "") for s, t in zip("⠯ ⠿ ⠷ ⠮ ⠾ ⠡ ⠣ ⠩ ⠹ ⠱ ⠫ ⠻ ⠳ ⠪ ⠌ ⠜ ⠬ ⠢ ⠔".split(), "and for of the with ch gh sh th wh ed er ou ow st ar ing en in".split(), strict=True)),
    *((_CELL[s], t, "eng", "whole") for s, t in zip("bcdefghjklmnpqrstuvwxyz", "but can do every from go have just knowledge like more not people quite rather so that us very will it you as".split(), strict=True)),
    ("⠂", "ea", "eng", "mid"),
    *((s, t, "eng", "") for s, t in zip("⠰⠛ ⠰⠎ ⠰⠝ ⠰⠽ ⠰⠞ ⠰⠑ ⠰⠇ ⠨⠎ ⠨⠝ ⠨⠙ ⠨⠑ ⠨⠞".split(), "ong ness tion ity ment ence ful less sion ound ance ount".split(), strict=True)),
    *((s, t, "eng", "") for s, t in (("⠆", "be"), ("⠐⠗", "right"), ("⠘⠮", "these"), ("⠸⠮", "their"), ("⠐⠮", "there"))),
)
#: Thai vowels around a consonant (-): what is written, what is said.
_THAI_FRAMES = dict(zip("เ-าะ เ-า เ-ียะ เ-ีย เ-ือ เ-อะ เ-อ เ-ิ เ-็ เ-ย แ-ะ แ-็ โ-ะ เ-ะ -ัวะ -ัว -วย -ือ -ำ -รร".split(), "o ao ia ia uea oe oe oe e oei ae ae o e ua ua uai uee am an".split(), strict=True))
_THAI = [(chr(cp), char_tables.character_row(cp)[4]) for cp in range(0x0E01, 0x0E2F) if chr(cp) not in "อฤฦ"]
_THAI_RULES = (
    *((frame.replace("-", c), t + vowel, "", "") for c, t in _THAI for frame, vowel in _THAI_FRAMES.items() if frame not in ("-ือ", "-วย")),
    *((frame[1:], vowel, "", "") for frame, vowel in _THAI_FRAMES.items() if frame in ("-ือ", "-วย")),
    # the cancellation mark silences its letter, with a vowel sign or without
    *((c + v + "\u0e4c", "", "", "") for c, _ in [*_THAI, ("อ", ""), ("ฤ", "")] for v in ("", "\u0e34", "\u0e35", "\u0e38", "\u0e39")),
)
#: Source, target, language codes (empty: all), place in the word ("": any, "start", "end", "whole").
RULES = (
    *((s, t, "", "") for s, t in zip("ου γγ γκ γχ γξ μπ ντ τζ τσ αυ ευ".split(), "ou ng ng nch nx b nd dz ts au eu".split(), strict=True)),
    *((s, t, "", "start") for s, t in zip("μπ ντ γκ".split(), "b d g".split(), strict=True)),
    *((s, t, "rus", "") for s, t in zip("ие ае ое уе ее".split(), "iye aye oye uye eye".split(), strict=True)),
    *((s, t, "", "end") for s, t in zip("ый ий".split(), "y y".split(), strict=True)),
    ("йо", "io", "", ""),
    ("е", "ye", "rus", "start"), ("Е", "Ye", "rus", "start"),
    *((s, t, "ukr", "") for s, t in zip("г Г и И х ьо".split(), "h H y Y kh io".split(), strict=True)),
    *((s, t, "ukr", "end") for s, t in zip("ий ій".split(), "y y".split(), strict=True)),
    *((s, t, "bul", "") for s, t in zip("щ ъ х".split(), "sht a h".split(), strict=True)),
    *((s, t, "srp mkd", "") for s, t in zip("х ј".split(), "h j".split(), strict=True)),
    *((s, t, "fas", "") for s, t in zip("و ی ه‌ هٔ".split(), "v i e eye".split(), strict=True)), ("ع", "", "fas", ""), ("ه", "e", "fas", "end"), ("ای", "i", "fas", "start"),
    ("اً", "an", "", ""),
    *((s, t, "uig", "") for s, t in zip("ئا ئە ئې ئى ئو ئۇ ئۆ ئۈ ا ى و غ خ چ ج ش ژ".split(), "a e e i o u oe ue a i o gh x ch j sh zh".split(), strict=True)),
    ("ىيە", "ie", "uig", ""), ("يە", "e", "uig", "start"),
    *((s, t, "yid", "") for s, t in zip("ק ת כ פ ־".split(), "k s ch f -".split(), strict=True)), ("אי", "y", "yid", "start"),
    *((s, t, "yid", "") for s, t in zip("ווא וו יי ײ װ זש טש א ע ו י".split(), "wa w ey ey w zh tsh a e u y".split(), strict=True)),
    *((s + "\u093c", t, "", "") for s, t in zip("फ ज ड ढ क ख ग".split(), "fa za dda ddha qa kha gha".split(), strict=True)),
    *((s, t, "tam", "") for s, t in zip("ட ழ ள".split(), "da la la".split(), strict=True)),
    ("ቸ", "che", "", ""), ("ች", "che", "", ""), ("ቻ", "chaa", "", ""), ("ቼ", "chee", "", ""), ("ቺ", "chi", "", ""), ("ቹ", "chu", "", ""), ("ቾ", "cho", "", ""),
    *((a + b, t, "", "") for a, b, t in (("チ", "ェ", "che"), ("シ", "ェ", "she"), ("ジ", "ェ", "je"), ("フ", "ァ", "fa"), ("フ", "ィ", "fi"), ("フ", "ェ", "fe"), ("フ", "ォ", "fo"), ("テ", "ィ", "ti"), ("デ", "ィ", "di"), ("ウ", "ェ", "we"), ("ウ", "ィ", "wi"))),
    *_BRAILLE,
    *_THAI_RULES,
    *((c + "\u05bc", t, "", "") for c, t in zip("בכךפף", "b k k p p".split(), strict=True)),
    *((c + p, t + v, "heb", "") for c, t in zip("בכפ", "v ch f".split(), strict=True) for p, v in zip(_POINTS, "e e a o i e e a a o u".split(), strict=True)),
    # with a point and a dot inside, with hiriq or tsere and yod; alef with a point; sheva before vav
    *((c + p + "\u05bc" + y, t + v, "heb", "") for c, t in zip("בכפ", "b k p".split(), strict=True) for p, v in zip(_POINTS, "e e a o i e e a a o u".split(), strict=True) for y in (("", "י") if p in "\u05b4\u05b5" else ("",))),
    *((c + p + "י", t + v, "heb", "") for c, t in zip("בכפ", "v ch f".split(), strict=True) for p, v in (("\u05b4", "i"), ("\u05b5", "e"))),
    *(("א" + p, "'" + v, "heb", "") for p, v in zip(_POINTS, "e e a o i e e a a o u".split(), strict=True)),
    *(("א" + p, v, "heb", "start") for p, v in zip(_POINTS, "e e a o i e e a a o u".split(), strict=True) if p != "\u05b7"),
    *(("\u05b4י" + p + dot, "iy" + v, "", "") for p, v in (("", ""), *zip(_POINTS, "e e a o i e e a a o u".split(), strict=True)) for dot in ("", "\u05bc") if p + dot),
    *((c + "\u05b4י" + p + dot, t + "iy" + v, "heb", "") for c, t in zip("בכפ", "v ch f".split(), strict=True) for p, v in zip(_POINTS, "e e a o i e e a a o u".split(), strict=True) for dot in ("", "\u05bc")),
    ("ב", "v", "heb", "end"), ("\u05b4י", "i", "", ""), ("\u05b5י", "e", "heb", ""), ("\u05b0ו", "v", "heb", ""),
    ("ו\u05b9", "o", "", ""), ("ו\u05bc", "u", "", ""), ("ש\u05c1", "sh", "", ""), ("ש\u05c2", "s", "", ""), ("שׁ", "sh", "", ""), ("שׂ", "s", "", ""), ("צ", "ts", "", ""),
    *((s, t, "hye", "") for s, t in zip("ու ՈՒ Ու".split(), "u U U".split(), strict=True)),
    *((k + y, r[:-1] + ("" if r in ("shi", "chi", "ji") else "y") + v, "", "") for ks, ys in (("きしちにひみりぎじぢびぴ", "ゃゅょ"), ("キシチニヒミリギジヂビピ", "ャュョ")) for k, r in zip(ks, "ki shi chi ni hi mi ri gi ji ji bi pi".split(), strict=True) for y, v in zip(ys, "auo", strict=True)),
    *((s, t, "", "") for s, t in zip("し ち つ ふ じ ぢ づ シ チ ツ フ ジ ヂ ヅ ん ン を ヲ".split(), "shi chi tsu fu ji ji zu shi chi tsu fu ji ji zu n n o o".split(), strict=True)),
)
LONGEST = max(len(r[0]) for r in RULES)
