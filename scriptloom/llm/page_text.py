"""Main-text extraction from HTML with a tree-structured graphical model.

Each node of a page's block tree is content or not.  Potentials of a node's
features and of parent and child labels are trained from labelled pages by
exact gradients; sum-product messages up and down the tree give each node's
marginal.  The texts of content nodes are the page's main text.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .page_tree import Tree, parse

#: Pages of one round of messages.
PAGES_AT_ONCE = 256


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


class Forest:
    """Trees side by side, in the arrays that messages need."""

    def __init__(self, trees: list[Tree], vocabulary: dict[str, int]):
        sizes = [len(t.parent) for t in trees]
        first = np.cumsum([0, *sizes])
        self.first = first
        self.parent = np.array([p + s if p >= 0 else -1 for t, s in zip(trees, first, strict=False) for p in t.parent], np.int64)
        self.leaf = np.array([x is not None for t in trees for x in t.text], np.int64)
        depth = np.zeros(len(self.parent), np.int64)
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        pairs = [(i + s, vocabulary[f]) for t, s in zip(trees, first, strict=False) for i, fs in enumerate(t.features) for f in fs if f in vocabulary]
        at = np.array(pairs, np.int64).reshape(-1, 2)
        self.node_of, self.feature_of = at[:, 0], at[:, 1]

    def marginals(self, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node; joint marginals [node, parent's label, own label] (roots: 0).

        pair[leaf, parent's label, own label] are log-potentials.
        """
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(self.node_of, weights[self.feature_of], n)
        up, down = np.zeros((n, 2)), np.zeros((n, 2))
        below = own.copy()
        table = pair[self.leaf]
        for level in reversed(self.levels[1:]):
            t, b = table[level], below[level]
            for y in (0, 1):
                up[level, y] = _log_add(t[:, y, 0] + b[:, 0], t[:, y, 1] + b[:, 1])
            np.add.at(below, self.parent[level], up[level])
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            p, t = self.parent[level], table[level]
            above = below[p] + down[p] - up[level]
            for y in (0, 1):
                down[level, y] = _log_add(above[:, 0] + t[:, 0, y], above[:, 1] + t[:, 1, y])
            both = above[:, :, None] + t + below[level][:, None, :]
            both -= both.max((1, 2), keepdims=True)
            joint[level] = np.exp(both) / np.exp(both).sum((1, 2), keepdims=True)
        belief = below + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    pair: np.ndarray

    def texts(self, pages: list[str]) -> list[str]:
        trees = [parse(p) for p in pages]
        forest = Forest(trees, self.vocabulary)
        content, _ = forest.marginals(self.weights, self.pair)
        out = []
        for t, start in zip(trees, forest.first, strict=False):
            plain = sum(x is None for x in t.text) == 1  # the root alone: nothing but text
            out.append("\n\n".join(x for i, x in enumerate(t.text) if x is not None and (plain or content[start + i] > 0.5)))
        return out


def train(labelled: list[str], rounds: int = 150, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """Fit the potentials to pages whose elements carry data-y="1" where content begins and data-y="0" where it ends."""
    trees = [parse(p) for p in labelled]
    names = sorted({f for t in trees for fs in t.features for f in fs})
    model = Model({f: i for i, f in enumerate(names)}, np.zeros(len(names)), np.zeros((2, 2, 2)))
    forest = Forest(trees, model.vocabulary)
    truth = np.array([y for t in trees for y in t.label])
    inner = np.flatnonzero(forest.parent >= 0)
    seen_pair = np.zeros((2, 2, 2))
    np.add.at(seen_pair, (forest.leaf[inner], truth[forest.parent[inner]], truth[inner]), 1)
    parts = [model.weights, model.pair]
    first, second = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts]
    for step in range(1, rounds + 1):
        content, joint = forest.marginals(*parts)
        error = (truth - content)[forest.node_of]
        gradient = [np.bincount(forest.feature_of, error, len(names)), seen_pair - np.stack([joint[forest.leaf == k].sum(0) for k in (0, 1)])]
        for x, g, m, v in zip(parts, gradient, first, second, strict=True):
            g = g / len(trees) - decay * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def labelled_pages(count: int = 400, seed: int = 7) -> list[str]:
    """Invented pages of many layouts, labelled by data-y: an article among menus, headers, adverts, notices, forms, comments and the like."""
    r = random.Random(seed)
    pick = r.choice

    def words(low: int, high: int) -> str:
        return " ".join("".join(pick("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high)))

    def sentence() -> str:
        return words(3, 25).capitalize() + pick(".....!?")

    def prose(low: int = 1, high: int = 8) -> str:
        return " ".join(sentence() for _ in range(r.randint(low, high)))

    def block(tag: str, names: tuple[str, ...], inside: str, y: int | None = None) -> str:
        label = "" if y is None else f' data-y="{y}"'
        name = pick(names)
        named = "" if not name else f' {pick(("class", "class", "id"))}="{name}"'
        return f"<{tag}{named}{label}>{inside}</{tag}>"

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(r.randint(low, high))) + "</ul>"

    noise = {
        "menu": lambda: block(pick(("nav", "nav", "div")), ("menu", "navbar", "main-nav", "nav"), links(3, 9), 0) if r.random() < 0.7 else f'<nav data-y="0">{links(3, 9)}</nav>',
        "head": lambda: f'<header data-y="0"><div>{words(1, 4)}</div>{pick(("", "<p>" + sentence() + "</p>"))}</header>' if r.random() < 0.5 else block("div", ("header", "masthead", "top-banner"), f"<p>{prose(1, 2)}</p>", 0),
        "ad": lambda: block(pick(("div", "aside", "section", "p")), ("ad", "ads", "advert", "sponsored", "ad-box", "promo"), pick((prose(1, 2), f"<p>{prose(1, 3)}</p>")), 0),
        "side": lambda: f'<aside data-y="0"><h3>{words(1, 3)}</h3>{pick((links(2, 6), "<p>" + prose(1, 3) + "</p>"))}</aside>' if r.random() < 0.5 else block("div", ("sidebar", "widget", "related"), f"<h3>{words(1, 3)}</h3><p>{prose(1, 3)}</p>" + links(2, 5), 0),
        "notice": lambda: block(pick(("div", "section")), ("cookie-notice", "notice", "consent", "newsletter", "alert"), f"<p>{prose(1, 2)}</p><button>{words(1, 1)}</button>", 0),
        "form": lambda: f'<form data-y="0"><p>{prose(1, 2)}</p><label>{words(1, 2)}</label><input name="q"><button>{words(1, 1)}</button></form>',
        "talk": lambda: block(pick(("section", "div", "ol")), ("comments", "comment-list", "discussion"), "".join(block(pick(("div", "article", "li")), ("comment", "reply", "comment-body"), f"<p>{prose(1, 4)}</p>") for _ in range(r.randint(1, 4))), 0),
        "share": lambda: block("div", ("share", "social", "tags"), links(2, 4), 0),
    }

    def article(bare: bool) -> str:
        parts = [f"<h1>{words(3, 10).capitalize()}{pick(('', '.'))}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 12)):
            x = r.random()
            if x < 0.7:
                parts.append(f"<p>{pick(('', '<b>', '<em>'))}{prose(1, 6)}" + pick(("</p>", "</p>", "</p>", "<br>")))
            elif x < 0.78:
                parts.append(f"<h{pick('234')}>{words(1, 6)}</h{pick('234')}>")
            elif x < 0.84:
                parts.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.88:
                parts.append(f"<blockquote><p>{prose(1, 3)}</p></blockquote>")
            elif x < 0.91:
                parts.append("<table><tr><td>" + words(1, 3) + "</td><td>" + words(1, 3) + "</td></tr></table>")
            elif x < 0.94:
                parts.append(f'<p>{sentence()} <a href="/x">{words(1, 3)}</a> {sentence()}</p>')
            elif x < 0.96:
                parts.append(f"<p>{words(1, 3)}</p>")
            else:
                parts.append(noise[pick(("ad", "share", "form", "side", "talk", "notice"))]())
        body = "".join(parts)
        if bare:
            return block("div", ("content", "post-body", "article-body", "entry", "main", "story-text", "post"), body, 1)
        return f'<{pick(("article", "article", "main"))} data-y="1">{body}</article>'

    pages = []
    for _ in range(count):
        before = [noise[k]() for k in r.sample(("menu", "head", "ad", "notice", "side", "form"), r.randint(0, 4))]
        after = [noise[k]() for k in r.sample(("side", "ad", "talk", "share", "form", "menu", "notice"), r.randint(0, 4))]
        foot = pick((f'<footer data-y="0">© {sentence()}</footer>', f'<footer data-y="0"><p>{prose(1, 2)}</p>{links(0, 3)}</footer>', block("div", ("footer", "copyright"), f"<p>{prose(1, 2)}</p>", 0), ""))
        inside = "".join([*before, article(r.random() < 0.4), *after])
        if r.random() < 0.3:
            inside = block("div", ("wrapper", "container", "page", ""), inside)
        pages.append(f"<html><head><title>{words(2, 6)}</title></head><body>{inside}{foot}</body></html>")
    return pages


def main_text(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row: the blocks of the main text, joined by blank lines.

    A null or empty page has the empty text, one without any element is its own
    main text.  Each row is read by itself and to
    its end: repeated rows repeat, nulls in id or url stay, an empty table
    gives no rows, other columns play no part.  A node whose marginal is
    exactly one half is no content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), PAGES_AT_ONCE):
                part = batch.slice(i, PAGES_AT_ONCE)
                texts = model.texts([x or "" for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
