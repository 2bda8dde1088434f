"""Secret scan, quality rules, token counts: against plain versions."""

import base64
import re
import time
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scriptloom.llm import queries
from scriptloom.llm.quality_rules import judged
from scriptloom.llm.secret_scan import ASSIGN, BASE62, ORDER, Scanner, joined, masked, scan
from scriptloom.llm.token_counts import MergeCounter, token_counts

PARTS = ["password", "Token", "SECRET", "api_key", "ApiKey", "=", '="', ": ", "'", " ", "AKIA", "0123abcdef", "ABCDEFGHIJKLMNOPQRST", "deadbeef" * 4, "é", "İ", "ſecret", "K", "x.y-z/+", "passwdpassword", "\n"]


def plain(text):
    found = [("assign", m.start(), m.end()) for m in re.finditer(ASSIGN.pattern, text, re.I | re.A) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda x: (x[1], ORDER[x[0]]))


@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
@settings(max_examples=500)
def test_base_spans(text):
    assert [s for s in Scanner().spans(text) if s[0] in ("assign", "access", "hex")] == plain(text)


def signed(body):
    n, check = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        check = BASE62[d] + check
    return "ghp_" + body + check.rjust(6, "0")


def test_checksums_decide():
    good = signed("A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5")
    assert ("host_token", 2, 42) in Scanner().spans(f"x {good} y")
    assert not [s for s in Scanner().spans(f"x {good[:-1]}{'0' if good[-1] != '0' else '1'} y") if s[0] == "host_token"]
    assert Scanner().masked("token = abcdefgh, rest", "<secret>") == "token = <secret>, rest"


def test_headers_that_nest_too_deep_or_run_too_long():
    for header in (b'{"a":' + b"[" * 60_000, b'{"alg":' + b"[" * 2_900, b"[" * 2_000, b"7", b'"alg"', b'{"alg":"' + b"x" * 9_000 + b'"}', b"\xff\xfe{"):
        token = b64(header) + ".abcdef.ghijklmnop"
        assert [s for s in Scanner().spans("a " + token + " b") if s[0] == "signed_token"] == []
    good = b64(b'{"alg": "none"}') + ".abcdef.ghijklmnop"
    assert [s[0] for s in Scanner().spans("EYJ" + good)] == ["signed_token"]
    assert [s[0] for s in Scanner().spans("eyJshort.eyJ " + good)] == ["signed_token"]


def b64(raw):
    text = base64.urlsafe_b64encode(raw).decode().rstrip("=")
    return text if text.startswith("eyJ") else "eyJ" + text


@pytest.mark.parametrize("piece", ["eyJ", "token", "AKIA", "ghp_", "eyJaaaaaaaa.", "secret ", "password="])
def test_time_grows_with_length(piece):
    """10 MB of one keyword take seconds, not hours."""
    text = piece * (10_000_000 // len(piece))
    began = time.perf_counter()
    Scanner().spans(text)
    assert time.perf_counter() - began < 60


def test_scan_of_messy_rows(messy, empty):
    rows, texts = scan(messy).collect(), messy.collect()
    assert sorted((r.doc_id, r.spans) for r in rows if r.doc_id) == sorted((t.doc_id, joined(Scanner().spans(t.text or ""))) for t in texts if t.doc_id)
    assert len(rows) == len(texts) and scan(empty).collect() == []
    hidden = messy.select("doc_id", masked(messy.text).alias("text")).collect()
    assert {r.text for r in hidden if r.doc_id == 14} == {"password = <secret>"} and {r.text for r in hidden if r.doc_id == 2} == {None}


def quality_counts(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    at, seen, dup, repeated = defaultdict(list), set(), 0, set()
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    for places in at.values():
        if len(places) > 1:
            for i in places:
                repeated.update(range(i, i + 8))
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), dup, len(repeated)


def test_quality_counts(spark, messy, invented, empty):
    r = invented.random
    extra = []
    for i in range(40):
        block = invented(r.randint(5, 15))
        extra.append((100 + i, " ".join([block, invented(r.randint(0, 9)), block, "\n", block, "\n" + block, "a " * r.randint(0, 30), "#|<"])))
    df = messy.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = sorted(((x.doc_id, *tuple(x)[1:6], x.base_failed) for x in judged(df).collect()), key=repr)
    expected = []
    for x in df.collect():
        c = quality_counts(x.text)
        expected.append((x.doc_id, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert rows == sorted(expected, key=repr)
    assert judged(messy).where("kept and base_failed").count() == 0 and judged(empty).count() == 0


def test_quality_verdicts(spark):
    good = "The cat of the house was in the garden and it ran to the tree with a bird that sang for all of us."
    bad = {2: good.replace(" ", "*** "), 3: good.upper(), 4: "zzz qqq " * 4 + "rrr ttt bbb ppp kkk lll mmm nnn ddd fff ggg hhh jjj vvv www", 5: "of of of of of the the the the the in in in in in to to to to to and and"}
    rows = judged(spark.createDataFrame([(1, good), *bad.items()], "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows if r.kept} == {1}


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
COUNTER = MergeCounter(public_tokenizers.path("byte_bpe_50k.json"))


@given(st.text(st.one_of(st.sampled_from("ab their'sLL \n\t<|endoftext|>0٣½é日😀‍́"), st.characters(exclude_categories=("Cs",))), max_size=80))
@settings(max_examples=500)
def test_token_counts_of_any_text(text):
    assert COUNTER.count(text) == len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_messy_rows(messy, empty):
    rows = sorted((tuple(r) for r in token_counts(messy, queries.byte_bpe_50k).collect()), key=repr)
    expected = []
    for r in messy.collect():
        n = len(TOKENIZER.encode(r.text or "", add_special_tokens=False).ids)
        expected.append((r.doc_id, len((r.text or "").encode()), n, n > 512))
    assert rows == sorted(expected, key=repr) and token_counts(empty, queries.byte_bpe_50k).count() == 0
