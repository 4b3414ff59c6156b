"""Main text of web pages: flat blocks of text, each judged by its words and links and those of its neighbours.

A decision tree, trained on a small labelled table, tells the article's blocks from menus, headers, footers, sidebars,
notices, adverts, forms and comments. Pages are independent of each other: there is no shuffle, and a task holds the pages
of one batch.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import lean, slices, string_bytes
from granary.llm.html_blocks import Block, blocks_of

#: Bytes of html that are split into blocks at once, at least one page.
PAGE_BYTES = 2 << 20
#: The tree: levels, and rows to a leaf, at least.
DEPTH, LEAF = 8, 6
#: Pages of the labelled table, and the seed of the rule that makes it.
LABELLED_PAGES, SEED = 240, 11
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "outside", "article", "elsewhere", "heading", "listed", "sentence")


def features(pages: list[list[Block]]) -> np.ndarray:
    """A row of FEATURES for each block. Beyond the ends of a page there are no words and no links.

    outside: what encloses it isn't the article, by its elements or names; elsewhere: it isn't in the article of a page that names one.
    """
    blocks = [b for page in pages for b in page]
    own = np.array([(b.words, b.linked / b.words) for b in blocks]).reshape(-1, 2)
    sizes = np.array([len(page) for page in pages], np.int64)
    ends = np.cumsum(sizes)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    some = sizes > 0
    before[(ends - sizes)[some]] = 0
    after[ends[some] - 1] = 0
    marked = [any(b.place.article for b in page) for page in pages]
    rest = [(b.place.chrome or b.place.aside or b.place.comments, b.place.article, m and not b.place.article, b.kind[:1] == "h" and b.kind[1:].isdigit(), b.kind in ("li", "dt", "dd", "td", "th"), b.text[-1] in ".!?…:;。\"”»)") for m, page in zip(marked, pages, strict=True) for b in page]
    return np.column_stack([own, before, after, np.array(rest, float).reshape(-1, 6)])


class Tree(NamedTuple):
    """Nodes: feature and threshold (rows above it go right), or -1 and the share of main blocks of a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while (inner := self.feature[node] >= 0).any():
            more = x[np.arange(len(x)), np.maximum(self.feature[node], 0)] > self.threshold[node]
            node = np.where(inner, np.where(more, self.right[node], self.left[node]), node)
        return self.share[node]


def best_split(x: np.ndarray, y: np.ndarray, leaf: int) -> tuple[int, float] | None:
    """The split that lowers the Gini impurity most; ties go to the first feature and the lowest threshold."""
    best, found = len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, None
    for feature in range(x.shape[1]):
        order = np.argsort(x[:, feature], kind="stable")
        value, hits = x[order, feature], np.cumsum(y[order])
        n = np.arange(1, len(y))
        may = (value[1:] > value[:-1]) & (n >= leaf) & (len(y) - n >= leaf)
        if may.any():
            low, high = hits[:-1] / n, (hits[-1] - hits[:-1]) / (len(y) - n)
            cost = np.where(may, 2 * n * low * (1 - low) + 2 * (len(y) - n) * high * (1 - high), np.inf)
            at = int(cost.argmin())
            if cost[at] < best:
                best, found = cost[at], (feature, (value[at] + value[at + 1]) / 2)
    return found


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF) -> Tree:
    """A decision tree on rows of FEATURES and labels (1: main text)."""
    nodes: list[list] = []

    def grow(rows: np.ndarray, level: int) -> int:
        own = len(nodes)
        nodes.append([-1, 0.0, 0, 0, y[rows].mean()])
        split = best_split(x[rows], y[rows], leaf) if level < depth and 0 < y[rows].mean() < 1 else None
        if split:
            feature, threshold = split
            right = x[rows, feature] > threshold
            nodes[own][:2] = split
            nodes[own][2], nodes[own][3] = grow(rows[~right], level + 1), grow(rows[right], level + 1)
        return own

    grow(np.arange(len(y)), 0)
    return Tree(*(np.array(c) for c in zip(*nodes, strict=True)))


def labelled_pages(n: int = LABELLED_PAGES, seed: int = SEED) -> list[tuple[str, set[str]]]:
    """Pages made by a rule, and the blocks of each that are main text. Every block has words of its own."""
    rng, count = np.random.default_rng(seed), 0

    def words(n: int, stop: str = ".") -> str:
        nonlocal count
        count += 1
        return " ".join([f"w{count}", *(f"w{x}" for x in rng.integers(0, 10**6, max(n, 1) - 1))]) + stop

    def links(n: int, of: int = 2) -> str:
        return "".join(f'<li><a href="/{i}">{words(int(rng.integers(1, of + 1)), "")}</a></li>' for i in range(n))

    def some(*choices):
        return choices[rng.integers(len(choices))]

    pages = []
    for i in range(n):
        main: list[str] = []

        def put(tag: str, text: str, own: bool = True, main: list = main) -> str:
            main += [text] if own else []
            return f"<{tag}>{text}</{tag.split()[0]}>"

        body = [put("h1", words(int(rng.integers(1, 14)), ""))]
        for _ in range(int(rng.integers(2, 14))):
            what = rng.random()
            if what < 0.70:
                body.append(put("p", words(int(some(rng.integers(1, 5), rng.integers(4, 25), rng.integers(15, 60), rng.integers(40, 200))), some(".", ".", ".", "!", ""))))
            elif what < 0.78:
                text, link, more = words(int(rng.integers(5, 40)), ""), words(int(rng.integers(1, 5)), ""), words(int(rng.integers(3, 30)))
                main.append(f"{text} {link} {more}")
                body.append(f'<p>{text} <a href="/x">{link}</a> {more}</p>')
            elif what < 0.80 and i % 3 < 2:
                body.append(f"<p><a href='/y'>{put('b', words(int(rng.integers(2, 12)), ''))}</a></p>")
            elif what < 0.86:
                body.append(put(some("h2", "h3"), words(int(rng.integers(1, 9)), "")))
            elif what < 0.93:
                body.append("<ul>" + "".join(put("li", words(int(rng.integers(2, 20)))) for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            else:
                body.append(f"<blockquote>{put('p', words(int(rng.integers(5, 60))))}</blockquote>")
        tag = some("div", "aside")
        between = f'<{tag} class="{some("ad", "advert", "promo", "newsletter")}"><p>{words(int(rng.integers(2, 40)))}</p></{tag}>'
        if rng.random() < 0.3:
            body.insert(len(body) // 2, between)
        menu = f"<ul>{links(int(rng.integers(3, 9)))}</ul>"
        notice = f'<div class="{some("cookie-notice", "consent", "banner notice", "ad", "sponsored")}">{words(int(rng.integers(3, 45)))}</div>'
        side = f"<h3>{words(2, '')}</h3><ul>{links(int(rng.integers(2, 7)), 9)}</ul><p>{words(int(rng.integers(2, 30)))}</p>"
        form = f'<form action="/go"><label>{words(3, "")}</label><p>{words(int(rng.integers(3, 20)))}</p></form>'
        remarks = "".join(f"<div><p>{words(int(rng.integers(1, 70)))}</p></div>" for _ in range(int(rng.integers(1, 6))))
        foot = f"<p>© {words(int(rng.integers(2, 25)), some('', '.'))}</p>" + (f"<ul>{links(int(rng.integers(1, 6)))}</ul>" if i % 3 == 2 or rng.random() < 0.6 else "")
        article = "".join(body)
        stray = ["".join(f"<{some('div', 'p', 'span')}>{words(int(some(rng.integers(1, 6), rng.integers(5, 60))))}</div>" for _ in range(int(rng.integers(0, 3)))) for _ in range(2)]
        ends = rng.random() < 0.3  # the page breaks off after the article
        if i % 3 == 0:  # elements that say what they are
            article = some(f"<article>{article}</article>", f"<main>{article}</main>", f"<main><article>{article}</article></main>")
            page = f"<header>{words(3, '')}</header><nav>{menu}</nav>{notice}{stray[0]}{article}" + f"{stray[1]}<section class='comments'>{remarks}</section><aside>{side}</aside>{form}<footer>{foot}</footer>" * (not ends)
        elif i % 3 == 1:  # names that say it
            page = (
                f"<div id='header'>{words(3, '')}</div>{stray[0]}<div class='{some('menu', 'navbar', 'main-nav')}'>{menu}</div>{notice}"
                f"<div class='{some('post-content', 'entry', 'articleBody', 'story')}'>{article}</div>"
                + f"{stray[1]}<div id='{some('comments', 'disqus_thread')}'>{remarks}</div>"
                f"<div class='{some('sidebar', 'related', 'widget')}'>{side}</div>{form}<div id='footer'>{foot}</div>" * (not ends)
            )
        else:  # nothing but words and links
            page = f"<div>{menu}</div><div>{article}</div>" + (f"<div>{''.join(f'<p>{x}</p>' for x in (f'<a href=/{j}>{words(6)}</a>' for j in range(3)))}</div>" if rng.random() < 0.5 else "") + f"<div>{foot}</div>" * (not ends)
        pages.append((f"<html><head><title>{words(4)}</title><script>if (a < b) go('</p>')</script></head><body>{page}</body></html>", set(main)))
    return pages


@functools.cache
def default_tree() -> Tree:
    """The tree that the labelled table teaches."""
    found = [(blocks_of(page), main) for page, main in labelled_pages()]
    return train_tree(features([blocks for blocks, _ in found]), np.array([b.text in main for blocks, main in found for b in blocks], float))


def main_texts(pages: list[str], tree: Tree) -> list[str]:
    """The main text of each page: its blocks in page order, an empty line between."""
    found = [blocks_of(page) for page in pages]
    keep = tree.predict(features(found)) > 0.5
    texts, at = [], 0
    for blocks in found:
        texts.append("\n\n".join(b.text for b, k in zip(blocks, keep[at : at + len(blocks)], strict=True) if k))
        at += len(blocks)
    return texts


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html", tree: Tree | None = None) -> DataFrame:
    """The columns `keep`, the main text of each page, and n_chars, its code points.

    Null and empty html, and pages without an article, give an empty text. White space of any kind inside a block,
    character references to it included, becomes one space. Whole pages are read, however long; repeated rows and ids
    are pages of their own; an empty table gives no rows; columns that are not kept are not read, whatever their names.
    """
    tree = tree or default_tree()
    rows = pages.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col(html).alias("html"))
    kept, names = rows.drop("html").schema, [*(f"c{i}" for i in range(len(keep))), "text", "n_chars"]

    @lean
    def run(batches):
        for batch in batches:
            html = batch.column(batch.num_columns - 1)
            for a, b in slices(string_bytes(html)[1], PAGE_BYTES):
                texts = pa.array(main_texts([x or "" for x in html.slice(a, b - a).to_pylist()], tree), pa.string())
                own = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, texts, pc.utf8_length(texts).cast(pa.int64())], names=names)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "text string", "n_chars long"])
    return rows.mapInArrow(run, schema).toDF(*keep, "text", "n_chars")
