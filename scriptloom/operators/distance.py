"""Weighted distance of romanized strings, and of lattices of readings: edits over substrings, with costs from rules.

A rule may hold for two languages only, and ask for what stands left (regular
expressions) and right (bracketed classes, $ for the end) of either side.  What
no rule covers costs 1 for each character that is changed, put in or left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

UNREACHABLE, UNREACHABLE_CHART = 99.99, 99.9999
VOWELS = "aeiouy"


@dataclass(frozen=True)
class Rule:
    """Turning ``one`` into ``two`` costs ``cost``, for languages lc1 and lc2 (empty: any), between the contexts."""

    one: str
    two: str
    cost: float
    lc1: str = ""
    lc2: str = ""
    left1: str = ""
    left2: str = ""
    right1: str = ""
    right2: str = ""

    def flipped(self) -> Rule:
        return Rule(self.two, self.one, self.cost, self.lc2, self.lc1, self.left2, self.left1, self.right2, self.right1)


#: Cheap replacements of spelling variants (either way).
_VARIANTS = (
    ("ph", "f", 0.01), ("v", "f", 0.3), ("c", "k", 0.1), ("ck", "k", 0.02), ("z", "s", 0.1), ("s", "c", 0.3), ("i", "y", 0.1), ("our", "or", 0.1), ("re", "er", 0.1),
    ("j", "y", 0.2), ("w", "v", 0.1), ("q", "k", 0.05), ("x", "ks", 0.05), ("kh", "h", 0.1), ("gh", "g", 0.1), ("th", "t", 0.2), ("sch", "sh", 0.05), ("tz", "ts", 0.02), ("ou", "u", 0.05), ("oo", "u", 0.1),
)
RULES = (
    *(Rule(a, b, c) for a, b, c in _VARIANTS),
    *(Rule(a, "", 0.4 if a == "y" else 0.2) for a in VOWELS),
    *(Rule(a, b, 0.3 if b == "y" else 0.1) for a in VOWELS for b in VOWELS if a < b and (a, b) != ("i", "y")),
    *(Rule(c + c, c, 0.02) for c in "abcdefghijklmnopqrstuvwxyz"),
    # endings of Russian and Ukrainian names, and soft signs at the end of a word
    Rule("iy", "yy", 0.05, "rus", "ukr", right1="[$]", right2="[$]"),
    Rule("g", "h", 0.1, "rus", "ukr"),
    Rule("'", "", 0.05, right1="[$]"),
)


class Costs:
    """Rules both ways, by what they turn into what."""

    def __init__(self, rules: Iterable[Rule] = RULES):
        self.rules = tuple(dict.fromkeys(x for r in rules if r.one != r.two for x in (r, r.flipped())))

    @cached_property
    def by_pair(self) -> dict[tuple[str, str], list[tuple[Rule, re.Pattern | None, re.Pattern | None]]]:
        compiled = lambda p: re.compile(p) if p else None
        out: dict = {}
        for r in self.rules:
            out.setdefault((r.one, r.two), []).append((r, compiled(r.left1), compiled(r.left2)))
        return out

    @cached_property
    def prefixes(self) -> frozenset[str]:
        """Beginnings of what rules turn: a path of these letters may go on."""
        return frozenset(r.one[:n] for r in self.rules for n in range(len(r.one) + 1))

    @cached_property
    def whole(self) -> frozenset[str]:
        return frozenset(r.one for r in self.rules)


class Chart:
    """A string, or readings of its spans, as points in a line and single letters between them.

    arcs[point] lists (next point, letter); an edge of several letters has
    points of its own inside.
    """

    def __init__(self, arcs: list[list[tuple[int, str]]], costs: Costs):
        self.arcs, self.costs, self.last = arcs, costs, len(arcs) - 1
        self.labels = [self._labels(i) for i in range(len(arcs))]

    @classmethod
    def of_string(cls, s: str, costs: Costs) -> Chart:
        return cls([[(i + 1, c)] for i, c in enumerate(s)] + [[]], costs)

    @classmethod
    def of_edges(cls, edges: list[tuple[int, int, str]], costs: Costs) -> Chart:
        """Edges are (start, end, text)."""
        edges = sorted(set(edges))
        ends = sorted({0, *(e for _, e, _ in edges), *(s for s, _, _ in edges)})
        point, inner, n = {}, {}, 0
        for place in ends:
            point[place] = n
            n += 1
            for k, (s, _, t) in enumerate(edges):
                if s == place:
                    inner[k] = n
                    n += max(0, len(t) - 1)
        arcs: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for k, (s, e, t) in enumerate(edges):
            stops = [point[s], *range(inner[k], inner[k] + max(0, len(t) - 1)), point[e]]
            for i in range(len(stops) - 1):
                arcs[stops[i]].append((stops[i + 1], t[i].lower() if t else ""))
        # the last place's point stands at the end
        return cls(arcs[: point[ends[-1]] + 1], costs)

    def _labels(self, at: int) -> list[tuple[int, str]]:
        """(end, letters) from a point: nothing, one letter, and all that rules turn."""
        out, ahead = {(at, "")}, [(at, "")]
        while ahead:
            i, s = ahead.pop()
            for j, c in self.arcs[i]:
                x = (j, s + c)
                if x not in out and (len(x[1]) <= 1 or x[1] in self.costs.prefixes):
                    out.add(x)
                    ahead.append(x)
        return sorted((j, s) for j, s in out if len(s) <= 1 or s in self.costs.whole)

    def follows(self, at: int, classes: str) -> bool:
        """Whether bracketed classes match the letters after a point; $ in a class is the end."""
        if not classes:
            return True
        m = re.match(r"\[([^\[\]]*)\](.*)$", classes)
        if m is None:
            return False
        if not self.arcs[at]:
            return m[1] == "" or "$" in m[1]
        return any(c and c in m[1] and self.follows(j, m[2]) for j, c in self.arcs[at])


def best(a: Chart, b: Chart, costs: Costs, lc1: str = "", lc2: str = "", unreachable: float = UNREACHABLE) -> tuple[float, list[tuple[str, str, float]]]:
    """Least sum of costs from the start of both charts to their ends, and the edits that it takes."""
    found: dict[tuple[int, int], tuple[float, str, str, tuple | None]] = {(0, 0): (0.0, "", "", None)}
    for i in range(a.last + 1):
        for j in range(b.last + 1):
            if (i, j) not in found:
                continue
            here, left1, left2, _ = found[i, j]
            for e1, x in a.labels[i]:
                for e2, y in b.labels[j]:
                    if (e1, e2) == (i, j):
                        continue
                    cost = 0.0 if x == y else 1.0 if len(x) <= 1 and len(y) <= 1 else unreachable
                    if x != y:
                        for rule, before1, before2 in costs.by_pair.get((x, y), ()):
                            fits = rule.lc1 in ("", lc1) and rule.lc2 in ("", lc2) and rule.cost < cost and (not before1 or before1.search(left1)) and (not before2 or before2.search(left2))
                            if fits and a.follows(e1, rule.right1) and b.follows(e2, rule.right2):
                                cost = rule.cost
                    if cost < unreachable and here + cost < found.get((e1, e2), (unreachable,))[0]:
                        found[e1, e2] = (here + cost, left1 + x, left2 + y, (i, j, x, y, cost))
    end = (a.last, b.last)
    if end not in found:
        return unreachable, []
    path, at = [], end
    while (came := found[at][3]) is not None:
        if came[4]:
            path.append(came[2:])
        at = came[:2]
    return round(found[end][0], 6), path[::-1]


def _strings(x: str | None, y: str | None, costs: Costs, lc1: str, lc2: str) -> tuple[float, list] | None:
    if x is None or y is None:
        return None
    return best(Chart.of_string(x.lower(), costs), Chart.of_string(y.lower(), costs), costs, lc1, lc2)


def cost_distance(left: Column, right: Column, rules: Iterable[Rule] = RULES, lc1: str = "", lc2: str = "") -> Column:
    """Weighted distance of two romanized strings, without regard to case; null if either is."""
    costs = Costs(rules)

    @F.arrow_udf("double")
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        both = (_strings(x, y, costs, lc1, lc2) for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True))
        return pa.array([None if d is None else d[0] for d in both], pa.float64())

    return run(left, right)


def edits(left: Column, right: Column, rules: Iterable[Rule] = RULES, lc1: str = "", lc2: str = "") -> Column:
    """The edits of the least cost, in order: array of (was, becomes, cost); count them over many pairs to see which rules matter."""
    costs = Costs(rules)
    kind = pa.list_(pa.struct([("was", pa.string()), ("becomes", pa.string()), ("cost", pa.float64())]))

    @F.arrow_udf("array<struct<was:string,becomes:string,cost:double>>")
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        both = (_strings(x, y, costs, lc1, lc2) for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True))
        return pa.array([None if d is None else [{"was": w, "becomes": b, "cost": c} for w, b, c in d[1]] for d in both], kind)

    return run(left, right)


def chart_distance(left: Column, right: Column, rules: Iterable[Rule] = RULES, lc1: str = "", lc2: str = "") -> Column:
    """Least distance of two lattices: arrays of (start, end, txt) structs, alternatives included; null if either is.

    Lattices whose edges lead to no common end have the distance 99.9999.
    """
    costs = Costs(rules)

    @F.arrow_udf("double")
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        chart = lambda es: Chart.of_edges([(e["start"], e["end"], e["txt"]) for e in es], costs)
        both = zip(xs.to_pylist(), ys.to_pylist(), strict=True)
        return pa.array([None if x is None or y is None else best(chart(x), chart(y), costs, lc1, lc2, UNREACHABLE_CHART)[0] for x, y in both], pa.float64())

    return run(left, right)


def edit_counts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(was, becomes, n): how often each edit is taken."""
    return pairs.select(F.explode(edits(F.col(a), F.col(b))).alias("e")).groupBy("e.was", "e.becomes").agg(F.count("*").alias("n"))


def rules_from(lines: list[str]) -> list[Rule]:
    """Rules of ``::s1 a ::s2 b ::cost 0.1 ::lc1 rus, ukr ::left1 /x$/ ::right1 [ao$]`` lines; lines without a cost or without both strings are left out."""
    out = []
    for line in lines:
        slots = {m[1]: m[2].strip().strip("'\"") for m in re.finditer(r"::([a-z0-9-]+)((?:(?!\s::).)*)", re.sub(r"\s{2,}#.*$", "", line.lstrip("﻿")))}
        if line.lstrip().startswith("#") or not re.fullmatch(r"[0-9]+(?:\.[0-9]+)?", slots.get("cost", "")) or not (slots.get("s1") or slots.get("s2")):
            continue
        codes = lambda k: re.split(r",\s*", slots.get(k, ""))
        left = lambda k: m[1] if (m := re.fullmatch(r"/(.*)/", slots.get(k, ""))) else ""
        right = lambda k: slots.get(k, "") if re.fullmatch(r"(?:\[[^\[\]]*\])+", slots.get(k, "")) else ""
        out += [Rule(slots.get("s1", ""), slots.get("s2", ""), float(slots["cost"]), a, b, left("left1"), left("left2"), right("right1"), right("right2")) for a in codes("lc1") for b in codes("lc2")]
    return out


def signature_letters(rules: Iterable[Rule], most: float) -> dict[str, str]:
    """Letter of these rules -> class letter ("": dropped), such that no rule of at most ``most`` changes the classes of a string, runs of one class taken once."""
    pairs = sorted(((r.one, r.two) for r in rules if r.cost <= most), key=lambda p: len(p[0] + p[1]))
    group = {c: c for one, two in pairs for c in one + two}
    changed = True
    while changed:
        changed = False
        for one, two in pairs:
            a, b = _signature(one, group), _signature(two, group)
            if a == b:
                continue
            changed = True
            # the letters that stand against each other become one class, what is left over is dropped
            merge = {z: min(x, y) for x, y in zip(a, b, strict=False) for z in (x, y) if x != y} or dict.fromkeys((a + b)[2 * min(len(a), len(b)) :] or a, "")
            group = {c: merge.get(g, g) for c, g in group.items()}
    return group


def _signature(s: str, group: dict[str, str]) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join(group.get(c, c) for c in s), flags=re.DOTALL)


@dataclass(frozen=True)
class Blocking:
    """Keys by which names at most ``most`` apart meet.

    Rules of at most ``cheap`` may be applied any number of times, so the
    letters that they can't tell apart are one class in a key.  Dearer rules fit
    into ``most`` twice at the best: a name's keys are its own, and those after
    one dear edit of it.  Of two names, one dear edit is made in the first and
    one in the second; what is left are cheap ones, so they share a key.
    """

    most: float
    rules: tuple[Rule, ...]

    @cached_property
    def cheap(self) -> float:
        """The least bound beyond which at most two rules fit."""
        costs = sorted({0.0, *(r.cost for r in self.rules)})
        return next(c for c in costs if 3 * min((d for d in costs if d > c), default=self.most + 1) > self.most + 1e-9)

    @cached_property
    def dear(self) -> list[tuple[str, str]]:
        if self.cheap >= self.most:
            return []
        return sorted({(r.one, r.two) for x in self.rules for r in (x, x.flipped()) if self.cheap < r.cost <= self.most})

    @cached_property
    def group(self) -> dict[str, str]:
        return signature_letters(self.rules, min(self.cheap, self.most))

    def keys(self, name: str) -> list[str]:
        name = name.lower()
        found = {_signature(name, self.group)}
        for one, two in self.dear:
            at = name.find(one)
            while 0 <= at <= len(name):
                found.add(_signature(name[:at] + two + name[at + len(one) :], self.group))
                at = name.find(one, at + 1) if at < len(name) else -1
        return sorted(found)


def name_pairs(df: DataFrame, name_col: str, most: float, rules: Iterable[Rule] = RULES) -> DataFrame:
    """(a, b, cost) of all pairs of different names at most ``most`` apart, for ``most`` below 1.

    Below 1 only rules apply; names meet by the keys of ``Blocking``, none is
    lost, and a key is shared only by names that few edits can turn into each
    other.  Characters that no rule changes stay in the keys, whatever their
    script.  Null names have no pairs, equal ones are one.
    """
    if most >= 1:
        raise ValueError("from 1 on, any letter may change, so names don't meet by their letters")
    rules = tuple(rules)
    blocking = Blocking(most, rules)

    @F.arrow_udf("array<string>")
    def keys(names: pa.Array) -> pa.Array:
        return pa.array([blocking.keys(n) for n in names.to_pylist()], pa.list_(pa.string()))

    names = df.select(F.col(name_col).alias("n")).where("n is not null").distinct().select("n", F.explode(keys(F.col("n"))).alias("key"))
    pairs = names.select(F.col("n").alias("a"), "key").join(names.select(F.col("n").alias("b"), "key"), "key").where("a < b").select("a", "b").distinct()
    return pairs.select("a", "b", cost_distance(F.col("a"), F.col("b"), rules).alias("cost")).where(F.col("cost") <= most)


def normalized(text: Column) -> Column:
    """Text as the distance compares it best: dashes, repeats and spaces evened out."""
    return tx.squeezed(text)
