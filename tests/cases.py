"""Queries over small tables of hand-checked cases: inputs, and what each function makes of them.

The inputs of a case go through the Spark function; its SQL is the same rows
with the expected values written out, so a case fails if its function changes
nothing or anything else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions import latin, numbers
from scriptloom.functions import text as tx
from scriptloom.operators import distance, romanize, stats
from scriptloom.sources import text_files
from scriptloom.sql import register

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Spark and DuckDB types by short names.
TYPES = {"s": ("string", "varchar"), "i": ("int", "int"), "l": ("long", "bigint"), "d": ("double", "double"), "b": ("boolean", "boolean")}


def _literal(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        plain = v.replace("'", "''")
        return "'" + plain + "'" if all(c >= " " for c in v) else "(" + " || ".join(f"chr({ord(c)})" if c < " " else "'" + c.replace("'", "''") + "'" for c in v) + ")"
    return repr(v)


def cases(columns: str, rows: list[tuple], given: int) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Register a query: ``columns`` are "name:type" words, the first ``given`` of them inputs; the function adds or derives the others."""
    names = [c.split(":")[0] for c in columns.split()]
    kinds = [TYPES[c.split(":")[1]] for c in columns.split()]

    def decorate(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        schema = ", ".join(f"{n} {k[0]}" for n, k in zip(names[:given], kinds, strict=False))
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
        inputs = list(dict.fromkeys(r[:given] for r in rows))
        QUERIES[f.__name__] = lambda spark, d: f(spark.createDataFrame(inputs, schema) if given else spark.range(1)).select(*names)
        quoted = [f'"{n}"' for n in names]
        ORACLES[f.__name__] = f"select {', '.join(f'{n}::{k[1]} as {n}' for n, k in zip(quoted, kinds, strict=True))} from (values {values}) t({', '.join(quoted)})"
        return f

    return decorate


# ------------------------------------------------------------------ romanization

#: Language, word and reading, for every kind of script.
WORDS = """
deu|Grüße|Gruesse
tur|İstanbul,|Istanbul,
tur|Türkiye'de|Tuerkiye'de
tur|şehir|shehir
tur|ülkenin|uelkenin
eng|⠠⠺⠑|We
eng|⠓⠕⠇⠙|hold
eng|⠘⠮|these
eng|⠞⠗⠥⠹⠎|truths
eng|⠞⠕|to
eng|⠆|be
eng|⠎⠑⠇⠋⠤⠑⠧⠊⠙⠢⠞⠂|self-evident,
ell|Το|To
ell|Λος|Los
ell|Άντζελες|Andzeles
ell|(στα|(sta
ell|ισπανικά|ispanika
ell|Οι|Oi
ell|Άγγελοι)|Angeloi)
rus|Герма́ния|Germaniya
rus|(нем.|(nem.
rus|официальное|ofitsialnoye
rus|название|nazvaniye
rus|—|—
rus|Федерати́вная|Federativnaya
rus|Респу́блика|Respublika
ukr|Володи́мир|Volodymyr
ukr|Олекса́ндрович|Oleksandrovych
ukr|Зеле́нський|Zelensky
ukr|(нар.|(nar.
ukr|січня|sichnya
ukr|Кривий|Kryvy
ukr|Ріг)|Rih)
srp|Сва|Sva
srp|људска|ljudska
srp|бића|bitsha
srp|рађају|radjaju
srp|се|se
srp|слободна|slobodna
srp|и|i
ara|كندا|knda
ara|(بالإنجليزية:|(balinjlyzya:
ara|هي|hy
ara|دولة|dwla
ara|في|fy
ara|أمريكا|amryka
ara|الشمالية|alshmalya
fas|کالیفرنیا|kalifrnia
fas|(به|(be
fas|انگلیسی:|anglisi:
fas|ایالتی|ialti
fas|در|dr
fas|غرب|ghrb
fas|آمریکا|amrika
uig|﻿ئامېرىكا|amerika
uig|قوشما|qoshma
uig|شتاتلىرى|shtatliri
uig|بولسا|bolsa
uig|شىمالىي|shimaliy
uig|ئامېرىكاغا|amerikagha
uig|جايلاشقان|jaylashqan
amh|ኢትዮጵያ|iteyopheyaa
amh|ከዓለም|kaaalame
amh|ሶስቱ|sosetu
amh|ትልቅ|teleqe
amh|የአብርሃም|yaaberehaame
amh|ሀይማኖቶች|hayemaanotoche
amh|ጋር|gaare
hin|कैलिफ़ोर्निया|kailiforniyaa
hin|शब्द|shabda
hin|का|kaa
hin|पहला|pahalaa
hin|अर्थ|artha
hin|था|thaa
hin|जो|jo
mar|लंडन|lamddan
mar|(इंग्लिश:|(imglish:
mar|हे|he
mar|इंग्लंडचे|imglamddace
mar|व|va
mar|युनायटेड|yunaayattedd
mar|किंग्डमचे|kimgddamace
nep|यसको|yasako
nep|उचाइ|ucaai
nep|समुन्द्र|samundra
nep|सतहबाट|satahabaatt
nep|८,८४८|8,848
nep|मीटर|miittar
nep|(२९,०२८|(29,028
tam|தமிழ்நாடு|tamilnaadu
tam|இந்தியாவின்|intiyaavin
tam|மாநிலங்களில்|maanilangkalil
tam|ஒன்றாகும்.|onraakum.
tam|தமிழ்நாடு,|tamilnaadu,
tam|தமிழகம்|tamilakam
tam|என்றும்|enrum
mal|ഇന്ത്യയുടെ|intyayutte
mal|തെക്കുപടിഞ്ഞാറെ|tekkupattinynyaarre
mal|അറ്റത്തുള്ള|arrrrattulllla
mal|സംസ്ഥാനമാണ്|samsthaanamaann
mal|കേരളം.|keerallam.
ori|ଓଡ଼ିଶା|oddishaa
ori|ଭାରତର|bhaaratara
ori|ପୂର୍ବ|puurba
ori|ଉପକୂଳରେ|upakuullare
ori|ଥିବା|thibaa
ori|ଏକ|eka
ori|ପ୍ରଶାସନିକ|prashaasanika
zho|加拿大在一万四千年前即有原住民在此生活。|jianadazai14000nianqianjiyouyuanzhuminzaicishenghuo. 
heb|כֹּל|kol
heb|עוֹד|'od
heb|בַּלֵּבָב|balevav
heb|פְּנִימָה|penimah
heb|נֶפֶשׁ|nefesh
heb|יְהוּדִי|yehudi
heb|הוֹמִיָּה|homiyah
yid|איז|yz
yid|אן|an
yid|העברעישער|hebreysher
yid|זשורנאל|zhurnal
yid|וואס|was
yid|באשרייבט|bashreybt
hye|Տալնոեի|Talnoei
hye|շրջան|shrjan
hye|(ուկր.՝|(ukr.,
hye|Тальнівський|Talnivsky
hye|район),|raion),
hye|Ուկրաինայի|Ukrainayi
hye|Չերկասիի|Cherkasii
tai|มีประเทศอิสระ|miiprathetitra
tai|ประเทศ|prathet
tai|คือ|khuee
tai|ซานมารีโนและนครรัฐวาติกัน|saanmaariinolaenkhanatwaatikan
tai|เป็นดินแดนที่ล้อมรอบไปด้วยพื้นที่ของอิตาลี|pendindaenthiilomroppaiduaiphueenthiikhongitaalii
tai|ในขณะที่เมืองกัมปีโอเนดีตาเลีย|naiknathiimueangkampiionediitaalia
tai|เป็นดินแดนส่วนแยกของอิตาลีที่ถูกล้อมรอบด้วยพื้นที่ประเทศสวิตเซอร์แลนด์|pendindaensuanyaekkhongitaaliithiithuuklomropduaiphueenthiiprathetswitsoelaen
|북쪽에는|bugjjogeneun
|인도네시아와|indonesiawa
|동티모르,|dongtimoreu,
|파푸아|papua
|뉴기니,|nyugini,
|북동쪽에는|bugdongjjogeneun
|솔로몬|solromon
|ಬಾ|baa
|ಇಲ್ಲಿ|illi
|ಸಂಭವಿಸು|sambhavisu
|ಇಂದೆನ್ನ|imdenna
|ಹೃದಯದಲಿ|hrdayadali
|ನಿತ್ಯವೂ|nityavuu
|ಅವತರಿಪ|avataripa
|ვეპხის|vepxis
|ტყაოსანი|tqaosani
|შოთა|shota
|რუსთაველი|rustaveli
|ღმერთსი|ghmertsi
|შემვედრე,|shemvedre,
|ნუთუ|nutu
|᚛ᚐᚅᚋ ᚋᚖᚂᚓᚌᚖᚋᚏᚔᚇ ᚋᚐᚉᚔ ᚍᚓᚉᚒᚋᚓᚅ᚜|anm moilegoimrid maki vekumen
|ᛁᚳ᛫ᛗᚨᚷ᛫ᚷᛚᚨᛋ᛫ᛖᚩᛏᚪᚾ᛫ᚩᚾᛞ᛫ᚻᛁᛏ᛫ᚾᛖ᛫ᚻᛖᚪᚱᛗᛁᚪᚧ᛫ᛗᛖ᛬|ic mag glas eotan ond hit ne hearmiath me.
|𓊪𓏏𓍯𓃭𓐝𓇌𓋴|ptolmys
|チェコスロバキア|chekosurobakia
|ལྷ་ས་གྲོང་ཁྱེར|lha·sa·grong·khyer
|ᓵᓕ|saali
|ᓴᕕᐊᕐᔪᒃ|safiaryok
|ᐃᒻᒥᓂᒃ|imminik
|ᓂᓪᓕᕈᑎᖃᓲᖑᕗᖅ|nillirotiqasoongofoq
|ᑕᐃᑦᓱᒪᓂᑕᑦᓴᔭᐅᓂᕋᕐᓱᓂ.|taitsomanitatsayaonirarsoni.
|ᐃᒻᒥᓂᓪᓗᑕᐅᖅ|imminillotaoq
|ᓂᓪᓕᕈᑎᖃᓱᖑᒻᒥᓱᓂ|nillirotiqasongommisoni
|ⴰⵎⴰⴳⵔⴰⴷ|amagrad
|ⴰⵔ|ar
|ⴷ|d
|ⵜⵜⵍⴰⵍⴰⵏ|ttlalan
|ⵎⵉⴷⴷⵏ|middn
|ⴳⴰⵏ|gan
|ⵉⵍⴻⵍⵍⵉⵜⵏ|ilellitn
"""


@cases("lcode:s word:s romanized:s", [(a or None, b, c) for a, b, c in (x.split("|") for x in WORDS.strip().split("\n"))], 2)
def romanize_words(df):
    return romanize.romanize(df, "word", lcode_col="lcode")


@cases("text:s romanized:s", [("三万一千", "31000"), ("3.5万", "35000"), ("1.25亿", "125000000"), ("五分之三", "3/5"), ("百分之五", "5%"), ("负三十", "-30"), ("十一五", "11·5"), ("二百三十四", "234"), ("三千零一", "3001"), ("三万一", "31000"), ("萬", "wan"), ("23½", "23 1/2"), ("½", "1/2"), ("፲፪", "12"), ("፫፻", "300"), ("८,८४८", "8,848"), ("৩.৫", "3.5"), ("٢٠٠٧", "2007"), ("⠼⠁⠃⠉", "123"), ("⠼⠁⠲⠑", "1.5"), ("一" * 25, "·".join("1" * 25)), ("兩", "liang"), ("百", "100")], 1)
def romanize_numbers(df):
    return romanize.romanize(df, "text")


@cases("text:s romanized:s", [("ក", "ka"), ("ਪੱਚੀ", "paccii"), ("ਬੱਚਾ", "baccaa"), ("きっぷ", "kippu"), ("マッチ", "matchi"), ("ラーメン", "raamen"), ("きょう", "kyou"), ("เกาะ", "ko"), ("การ์ด", "kaat"), ("ⲁ̀", "ea"), ("5 μg", "5 µg"), ("μία", "mia"), ("⠠⠠⠁⠃⠀⠉", "AB c"), ("⠠⠁", "A"), ("ﻼ", "la"), ("㎏", "kg"), ("km²", "km²"), ("a\u200bब", "aba"), ("x\ue000ж", "xzh"), ("བླ", "bla"), ("ཀ", "ka"), ("ଶ୍ରୀ", "shrii"), ("כֹּל", "kol"), ("नेपाल", "nepaal"), ("Щука ЩУКА", "Shchuka SHCHUKA")], 1)
def romanize_contexts(df):
    return romanize.romanize(df, "text")


@cases("text:s start:i end:i txt:s type:s", [("ж1", 0, 1, "zh", "rom"), ("ж1", 1, 2, "1", "orig"), ("三千x", 0, 2, "3000", "number"), ("三千x", 2, 3, "x", "orig"), ("e\u0301а", 0, 1, "e", "orig"), ("e\u0301а", 1, 2, "", "Mn"), ("e\u0301а", 2, 3, "a", "rom"), ("ह\u200d", 0, 1, "ha", "rom"), ("ह\u200d", 1, 2, "", "Cf"), ("٣", 0, 1, "3", "num"), ("¾", 0, 1, "3/4", "fraction"), ("ﬃ", 0, 1, "ffi", "rom decomp"), ("\ue000", 0, 1, "", "Co")], 1)
def edge_types(df):
    return romanize.romanize_edges(df, "text", "text")


@cases("text:s romanized:s", [("γκ", "{g|ng}"), ("ab", "ab"), ("μπα", "ba")], 1)
def alternatives_inline(df):
    return romanize.inline_alternatives(romanize.romanize_alternatives(df, "text", "text"), "text")


@cases("text:s html:s", [("жx", '<span title="ж">zh</span>x'), ("<é>", '&lt;<span title="é">e</span>&gt;')], 1)
def mouse_over_html(df):
    return romanize.mouse_over(romanize.romanize_edges(df, "text", "text"), df.select("text", F.col("text").alias("original_text")), "text", "original_text")


@cases("text:s romanized:s", [("Жук, كندا", "Zhuk, knda"), ("abc", "abc"), ("Ελλάς", "Ellas")], 1)
def quick_romanize(df):
    return df.select("text", romanize.quick(F.col("text")).alias("romanized"))


@cases("text:s alignment:s", [("жук", "0:0,1:2,2:3"), ("ab", "0:0,1:1")], 1)
def offset_pairs(df):
    return romanize.offset_alignment(romanize.romanize_edges(df, "text", "text"), "text")


@cases("text:s plain:s digits:s quick:s n:i", [("Éa٣", "Ea٣", "Éa3", "Éa٣", 3), ("жé", "жe", "жé", "zhé", 2)], 1)
def sql_functions(df):
    register(df.sparkSession)
    df.createOrReplaceTempView("sql_function_texts")
    return df.sparkSession.sql("select text, deaccent(text) as plain, ascii_digits(text) as digits, quick_romanize(text) as quick, length(text) as n from sql_function_texts")


@cases("text:s start:i end:i txt:s type:s", [("жa", 0, 1, "zh", "rom"), ("жa", 1, 2, "a", "orig"), ("é", 0, 1, "e", "rom")], 1)
def sql_letter_edges(df):
    register(df.sparkSession)
    df.createOrReplaceTempView("sql_edge_texts")
    return df.sparkSession.sql("select t.text, e.* from sql_edge_texts t, lateral letter_edges(t.text) e")


# ------------------------------------------------------------------ numbers


@cases("text:s value:l", [(s, v) for s, v in {"三万一千": 31000, "一万四千": 14000, "二百三十四": 234, "十": 10, "十五": 15, "二十": 20, "一百零五": 105, "三千零一": 3001, "一亿二千万": 120000000, "二〇〇六": 2006, "两万": 20000, "九": 9, "三万一": 31000, "千二": 1002, "九千万兆兆": None, "一" * 25: None, "x": None, "二千三万": 20030000}.items()], 1)
def han_numbers(df):
    return df.withColumn("value", numbers.han_number(F.col("text")))


@cases("text:s plain:s", [("1.5e3", "1500"), ("1.5e-12", "0.0000000000015"), ("abc", "abc"), ("1e30", "1" + "0" * 30), ("-2.50E2", "-250"), ("1.5", "1.5"), ("0e0", "0"), ("12e-1", "1.2")], 1)
def scientific_plain(df):
    return df.withColumn("plain", numbers.plain_number(F.col("text")))


@cases("value:d fraction:s", [(0.75, "3/4"), (1 / 3, "1/3"), (7 / 320, "7/320"), (1 / 7, None), (0.1, "2/20"), (0.0, None), (11 / 12, "11/12")], 1)
def common_fractions(df):
    return df.withColumn("fraction", numbers.common_fraction(F.col("value")))


@cases("char:s fraction:s shown:s", [("¾", "3/4", "3 3/4"), ("⅓", "1/3", "3 1/3"), ("a", None, "3")], 1)
def fraction_characters(df):
    return df.withColumn("fraction", numbers.fraction_parts(F.col("char"))).withColumn("shown", numbers.shown_number(F.lit(3), F.col("fraction")))


@cases("text:s number:s", [("3.50", "3.5"), (" -12 ", "-12"), ("1e3", None), ("x", None), (".5", "0.5"), ("", None)], 1)
def parsed_numbers(df):
    return df.withColumn("number", numbers.plain_text(numbers.parsed(F.col("text"))))


@cases("text:s rounded:s commas:s", [("2.345", "2.35", "2"), ("-1234567.5", "-1234567.50", "-1,234,568"), ("x", None, None), ("9" * 40, None, None)], 1)
def rounded_texts(df):
    return df.withColumns({"rounded": numbers.rounded(F.col("text"), 2).cast("string"), "commas": numbers.with_commas(F.col("text"))})


# ------------------------------------------------------------------ lines


@cases("line:s prefix:s lcode:s text:s", [("::lcode hin नेपाल", "::lcode hin ", "hin", "नेपाल"), ("::lcode  rus   да", "::lcode  rus   ", "rus", "да"), ("::lcode xx a", "", None, "::lcode xx a"), ("plain", "", None, "plain"), ("", "", None, "")], 1)
def directive_lines(df):
    prefix, lcode, text = tx.lcode_directive(F.col("line"))
    return df.select("line", prefix.alias("prefix"), lcode.alias("lcode"), text.alias("text"))


@cases("line:s s1:s s2:s", [("'a'\tb", "a", "b"), ("\ufeffx\ty\tz", "x", "y"), ("nothing", None, None)], 1)
def pair_lines(df):
    return df.join(text_files.pairs(df, keep_malformed=True).withColumn("k", F.coalesce("s1", F.lit("nothing"))), F.col("line").contains(F.col("k")))


@cases("line:s s:s t:s codes:s place:s", [("::s ж ::t zh ::lcode rus, ukr ::use-only-at-end-of-word", "ж", "zh", "rus ukr", "end"), ('::s "a b" ::t', "a b", "", "", ""), ("::s x ::t y ::use-only-for-whole-word", "x", "y", "", "whole")], 1)
def rule_file_lines(df):
    rules = text_files.rule_lines(df).select("s", "t", F.array_join("lcodes", " ").alias("codes"), "place")
    return df.join(rules, F.col("line").contains(F.concat(F.lit("::s "), F.when(F.col("s").contains(" "), F.concat(F.lit('"'), "s", F.lit('"'))).otherwise(F.col("s")), F.lit(" "))))


@cases("line:s s:s t:s codes:s", [('{"s": "ж", "t": "j", "lcodes": ["fra"]}', "ж", "j", "fra"), ('{"s": "x"}', "x", "", "")], 1)
def json_rule_lines(df):
    more = df.union(df.sparkSession.createDataFrame([("no rule",)], "line string"))
    rules = text_files.json_rules(more).select("s", "t", F.array_join("lcodes", " ").alias("codes"))
    return df.join(rules, F.get_json_object("line", "$.s") == F.col("s"))


@cases("kind:s line:s s:s t:s", [("simple", "中国\tzhōngguó", "中国", "zhongguo"), ("unihan", "U+4E2D\tkMandarin\tzhōng", "中", "zhong"), ("cedict", "綠 绿 [lu:4] /green/", "绿", "lu")], 2)
def pinyin_lines(df):
    read = [text_files.pinyin(df.where(F.col("kind") == k), k).withColumn("kind", F.lit(k)) for k in text_files.PINYIN_LINES]
    return df.join(read[0].union(read[1]).union(read[2]), "kind")


@cases("text:s slots:s", [("::s a ::t b ::flag", "a|b|"), ("::t 'x y'", "|'x y'|-"), ("none", "||-")], 1)
def slot_values(df):
    c = F.col("text")
    shown = F.concat_ws("|", F.coalesce(tx.slot(c, "s"), F.lit("")), F.coalesce(tx.slot(c, "t"), F.lit("")), F.coalesce(tx.slot(c, "flag"), F.lit("-")))
    return df.withColumn("slots", shown)


# ------------------------------------------------------------------ repair


@cases("hex:s each_byte:s longest_part:s windows:s bad:i", [("6162", "ab", "ab", "ab", 0), ("61E2809C62", "a“b", "a“b", "a“b", 0), ("61E28062", "a\ufffd\ufffdb", "a\ufffdb", "aâ€b", 2), ("93686994", "\ufffdhi\ufffd", "\ufffdhi\ufffd", "“hi”", 2), ("FF", "\ufffd", "\ufffd", "ÿ", 1), ("", "", "", "", 0)], 1)
def utf8_repairs(df):
    raw = F.unhex("hex")
    return df.withColumns({"each_byte": tx.repaired_utf8(raw), "longest_part": tx.valid_utf8(raw.cast("string")), "windows": tx.enforced_utf8(raw), "bad": tx.bad_bytes(raw).cast("int")})


@cases("text:s latin:s windows:s", [("Ã©tÃ©", "été", "été"), ("été", "été", "été"), ("â€œx", "â€œx", "“x"), ("日本", "日本", "日本"), ("", "", "")], 1)
def mojibake_texts(df):
    return df.withColumns({"latin": tx.decoded_twice(F.col("text")), "windows": tx.windows_decoded_twice(F.col("text"))})


@cases("text:s visible:s", [("a\u200bb\ufeff", "ab"), ("x\u202ey\u00adz", "xy\u00adz"), ("مـد", "مد"), ("e\ufe0f!", "e!"), ("tab\tstays", "tab\tstays")], 1)
def invisible_texts(df):
    return df.withColumn("visible", tx.visible(F.col("text")))


@cases("text:s plain:s", [("“a” ‘b’", "\"a\" 'b'"), ("x—y…", "x-y..."), ("、。〈〉", ",.<>"), ("ＡＢ！", "AB!"), ("plain", "plain")], 1)
def punctuation_texts(df):
    return df.withColumn("plain", tx.plain_punctuation(F.col("text")))


@cases("text:s squeezed:s", [("aaaa – b   c", "aa - b c"), ("cooool!!!!", "cool!!"), ("a\t\nb", "a b"), ("xx", "xx"), ("", "")], 1)
def squeezed_texts(df):
    return df.withColumn("squeezed", distance.normalized(F.col("text")))


@cases("text:s decoded:s", [("\\u0915\\x41\\U0001F600", "क\\x41😀"), ("\\xe9\\q", "é\\q"), ("\\uD800", "\\uD800"), ("", "")], 1)
def escaped_texts(df):
    return df.withColumn("decoded", tx.escapes_decoded(F.col("text")))


@cases("text:s named:s numeric:s", [("&eacute;&euro;&mdash;&lt;", "é€—<", "&eacute;&euro;&mdash;&lt;"), ("&amp;lt;", "&lt;", "&amp;lt;"), ("&#233;&#xE9;&#xD800;", "&#233;&#xE9;&#xD800;", "éé&#xD800;"), ("&nosuchname; & x", "&nosuchname; & x", "&nosuchname; & x")], 1)
def entity_texts(df):
    return df.withColumns({"named": tx.entities_decoded(F.col("text")), "numeric": tx.numeric_entities_decoded(F.col("text"))})


@cases("text:s code_points:s u:s hex:s", [("aé", "a<U+00E9>", "a\\u00E9", "a<HEX-C3A9>"), ("😀", "<U+1F600>", "\\u1F600", "<HEX-F09F9880>"), ("", "", "", "")], 1)
def shown_characters(df):
    c = F.col("text")
    return df.withColumns({"code_points": tx.shown_as_code_points(c), "u": tx.shown_as_code_points(c, "\\u"), "hex": tx.shown_as_code_points(c, "<HEX>")})


# ------------------------------------------------------------------ predicates


@cases("text:s rtl:b", [("שלום abc", True), ("abc", False), ("", False), ("سلام", True), ("ab שלוםם", True), ("abcdef ש", False)], 1)
def right_to_left_texts(df):
    return df.withColumn("rtl", stats.right_to_left(F.col("text")))


@cases("token:s url:b email:b file:b handle:b entity:b domain:b", [("http://a.bc/x?y", True, False, False, False, False, False), ("a.b@c.org", False, True, False, False, False, False), ("report.pdf", False, False, True, False, False, False), ("@name", False, False, False, True, False, False), ("&eacute;", False, False, False, False, True, False), ("www.example.com", False, False, False, False, False, True), ("word", False, False, False, False, False, False)], 1)
def token_kinds(df):
    c = F.col("token")
    return df.withColumns({"url": tx.is_url(c), "email": tx.is_email(c), "file": tx.is_filename(c), "handle": tx.is_handle(c), "entity": tx.is_entity(c), "domain": tx.has_top_domain(c)})


@cases("text:s punctuation:b rare:b latin_plus:b balanced:b guarded:b", [("?!", True, False, False, True, True), ("⁂", True, True, False, True, True), ("naïve", False, False, True, True, True), ("a(b[c])", False, False, True, True, True), ("(a]", False, False, True, False, True), ("x < y", False, False, True, True, False), ("жx", False, False, False, True, True), ("a &amp; b", False, False, True, True, True), ("((", True, False, False, False, True)], 1)
def text_kinds(df):
    c = F.col("text")
    return df.withColumns({"punctuation": tx.is_punctuation(c), "rare": tx.is_rare_punctuation(c), "latin_plus": tx.is_latin_plus(c), "balanced": tx.is_balanced(c), "guarded": tx.is_guarded_html(c)})


@cases("text:s thai:b han:b braille:b pointed:b", [("กa", True, False, False, False), ("a漢", False, True, False, False), ("⠁⠃", False, False, True, False), ("⠁b", False, False, False, False), ("בָּ", False, False, False, True), ("שלום", False, False, False, False)], 1)
def script_kinds(df):
    c = F.col("text")
    return df.withColumns({"thai": tx.contains_script(c, "Thai"), "han": tx.contains_han(c), "braille": tx.is_braille(c), "pointed": tx.has_pointed_hebrew(c)})


# ------------------------------------------------------------------ parts and comparison


@cases("text:s characters:s numbers:s words:s all:s", [("ab 12,3!", "a|b| |1|2|,|3|!", "a|b| |12,3|!", "ab| |1|2|,|3|!", "ab| |12,3|!"), ("<b>x</b>", "<|b|>|x|<|/|b|>", "<|b|>|x|<|/|b|>", "<|b|>|x|<|/|b|>", "<b>|x|</b>"), ("", "", "", "", "")], 1)
def grouped_characters(df):
    c, show = F.col("text"), lambda a: F.array_join(a, "|")
    return df.withColumns({"characters": show(tx.grouped(c)), "numbers": show(tx.grouped(c, "numbers")), "words": show(tx.grouped(c, "words")), "all": show(tx.grouped(c, "numbers", "words", "spaces", "tags"))})


@cases("text:s parts:s", [("a, b,c", "a|b|c"), ("a\\,b,c\\\\", "a,b|c\\"), ("", "")], 1)
def list_parts(df):
    return df.withColumn("parts", F.array_join(tx.listed(F.col("text")), "|"))


@cases("text:s capitalized:s", [("bank of the west", "Bank of the West"), ("THE HAGUE", "The Hague"), ("McDonald", "McDonald"), ("", "")], 1)
def recapitalized_names(df):
    return df.withColumn("capitalized", tx.recapitalized(F.col("text")))


@cases("text:s tonal:s", [("zhong1 guo2", "zhōng guó"), ("lu:4", "lǜ"), ("hao3", "hǎo"), ("liu2", "liú"), ("dui4", "duì"), ("gou3", "gǒu"), ("ma5", "ma"), ("xue2", "xué"), ("ABC", "ABC")], 1)
def tonal_syllables(df):
    return df.withColumn("tonal", tx.tonal_pinyin(F.col("text")))


@cases("a:s b:s n:i ratio_a:d ratio_b:d substring:s", [("xabcy", "zabcw", 3, 0.6, 0.6, "abc"), ("ab", "cd", 0, 0.0, 0.0, ""), ("", "x", 0, 0.0, 0.0, ""), ("aaa", "aa", 2, 2 / 3, 1.0, "aa")], 2)
def substring_ratios(df):
    return df.withColumn("r", tx.common_substring_ratios(F.col("a"), F.col("b"))).select("a", "b", "r.*")


@cases("text:s key:s", [("a12b3", "a0000000002:12b0000000001:3"), ("a007", "a0000000001:7"), ("a1234567890123", "a0000000013:1234567890123"), ("", ""), ("b", "b")], 1)
def sort_keys(df):
    return df.withColumn("key", tx.sort_key(F.col("text")))


@cases("text:s folded:s", [("Ärger", "arger"), ("ÑAÑO", "nano"), ("plain", "plain")], 1)
def folded_by_table(df):
    return df.withColumn("folded", latin.folded_by(F.col("text"), {"ä": "a", "ñ": "n"}, lower=True))


@cases("text:s pattern:s", [("a.b*c", "a\\.b\\*c"), ("[x]", "\\[x\\]"), ("plain", "plain")], 1)
def guarded_patterns(df):
    return df.withColumn("pattern", tx.guarded_regex(F.col("text")))


# ------------------------------------------------------------------ distance


@cases("a:s b:s cost:d", [("trap", "strap", 1.0), ("colour", "color", 0.1), ("labeling", "labelling", 0.02), ("organisation", "organization", 0.1), ("Philadelphia", "Filadelfia", 0.02), ("Vladimir", "Volodymyr", 0.5), ("Moskva", "Moskvoy", 0.5), ("same", "same", 0.0), ("", "", 0.0), ("b", "", 1.0), (None, "x", None)], 2)
def cost_distance_pairs(df):
    return df.withColumn("cost", distance.cost_distance(F.col("a"), F.col("b"), lc1="eng", lc2="eng"))


@cases("a:s b:s any:d by_language:d", [("dmitriy", "dmitryy", 0.1, 0.05), ("gora", "hora", 1.0, 0.1), ("ilmen'", "ilmen", 0.05, 0.05), ("il'men", "ilmen", 1.0, 1.0)], 2)
def distance_languages(df):
    return df.withColumns({"any": distance.cost_distance(F.col("a"), F.col("b")), "by_language": distance.cost_distance(F.col("a"), F.col("b"), lc1="rus", lc2="ukr")})


@cases("a:s b:s cost:d", [("γκα", "ga", 0.0), ("γκα", "nga", 0.0), ("γκα", "ka", 1.0), ("", "", 0.0)], 2)
def chart_distances(df):
    readings = lambda c: F.array_sort(F.collect_list(F.struct("start", "end", "txt")))
    edges = lambda c: romanize.romanize_alternatives(df, c, c).groupBy(c).agg(readings(c).alias(f"of_{c}"))
    both = df.join(edges("a"), "a", "left").join(edges("b"), "b", "left")
    none = F.array().cast("array<struct<start:int,end:int,txt:string>>")
    return both.withColumn("cost", distance.chart_distance(F.coalesce("of_a", none), F.coalesce("of_b", none)))


@cases("name:s near:s cost:d", [("Catherine", "Katherine", 0.1), ("Filadelfia", "Philadelphia", 0.02), ("Sara", "Zara", 0.1), ("Victor", "Wictor", 0.1)], 0)
def near_names(df):
    names = df.sparkSession.createDataFrame([(n,) for n in "Catherine Katherine Philadelphia Filadelfia Sara Zara Victor Wictor Paris Berlin".split()], "n string")
    return distance.name_pairs(names, "n", 0.15).select(F.col("a").alias("name"), F.col("b").alias("near"), "cost")


@cases("was:s becomes:s n:l", [("our", "or", 1), ("ph", "f", 2)], 0)
def distance_edits(df):
    pairs = df.sparkSession.createDataFrame([("colour", "color"), ("Philadelphia", "Filadelfia")], "a string, b string")
    return distance.edit_counts(pairs, "a", "b")


# ------------------------------------------------------------------ counts


@cases("lines:l bad_lines:l bad_bytes:l", [(4, 2, 3)], 0)
def bad_byte_report(df):
    raw = df.sparkSession.createDataFrame([(b"ok",), (b"a\xe2\x80b",), (b"\xff",), ("é".encode(),)], "raw binary")
    return stats.bad_byte_counts(raw, "raw")


@cases("char:s name:s number:d n:l", [("①", "CIRCLED DIGIT ONE", 1.0, 2), ("²", "SUPERSCRIPT TWO", 2.0, 1)], 0)
def unread_numerals(df):
    return stats.unread_numerals(df.sparkSession.createDataFrame([("①①x²",)], "t string"), "t")


@cases("char:s n:l category:s script:s kind:s name:s", [("क", 2, "Lo", "DEVANAGARI", "letter", "DEVANAGARI LETTER KA"), ("é", 1, "Ll", "LATIN", "letter", "LATIN SMALL LETTER E WITH ACUTE"), ("a", 1, None, None, None, "LATIN SMALL LETTER A")], 0)
def named_characters(df):
    return stats.character_profile(df.sparkSession.createDataFrame([("ककéa",)], "t string"), "t")


@cases("txt:s type:s n:l", [("𠀀", "orig", 2)], 0)
def suspicious_readings(df):
    texts = df.sparkSession.createDataFrame([(1, "𠀀 ж"), (2, "𠀀x")], "i int, t string")
    return stats.suspicious_readings(romanize.romanize_edges(texts, "i", "t"))
