"""Main text of web pages: flat text blocks, described by their own and their neighbours' words and link density and by what
encloses them, and judged by a decision tree trained on a small labelled table."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_article", "in_margin")
#: Labelled blocks. in_article: 1 inside the page's article, -1 outside it, 0 if the page marks none. in_margin: how many
#: enclosing elements are menus, headers, footers, sidebars, notices, adverts, forms or comments. Last: main text or not.
LABELLED = """
  8 0.00   0 0.00  60 0.02  1 0 1
 60 0.02   8 0.00  45 0.00  1 0 1
 45 0.00  60 0.02   1 0.00  1 0 1
  1 0.00  45 0.00  30 0.10  1 0 1
 30 0.10   1 0.00   4 1.00  1 0 1
  4 1.00  30 0.10   3 1.00  1 0 1
  3 1.00   4 1.00   0 0.00  1 0 1
120 0.00   3 0.00   2 0.00  1 0 1
  2 0.00 120 0.00   6 0.50  1 0 1
  6 0.50   2 0.00  90 0.00  1 0 1
 14 0.00   6 1.00  20 0.00  1 0 1
  1 1.00   9 0.00   9 0.00  1 0 1
  5 0.00   1 1.00   1 1.00  1 0 1
 25 0.00  10 0.00  12 1.00  1 1 0
 12 1.00  25 0.00  10 0.00  1 1 0
 80 0.00  70 0.00  60 0.00  1 1 0
 40 0.05  90 0.00  50 0.00  1 2 0
  9 0.00  50 0.00  35 0.00  1 1 0
  3 0.33  35 0.00   4 0.00  1 2 0
  1 1.00   1 1.00   1 1.00 -1 1 0
  1 1.00   1 1.00   2 1.00 -1 2 0
  2 1.00   1 1.00  11 0.00 -1 1 0
 11 0.00   2 1.00   8 0.00 -1 1 0
 35 0.00   1 1.00  60 0.00 -1 1 0
 70 0.00   1 1.00  90 0.00 -1 1 0
 12 0.00  90 0.00   0 0.00 -1 1 0
  6 0.17  40 0.00   0 0.00 -1 2 0
  9 0.00  12 0.00  30 0.00 -1 0 0
 30 0.00   9 0.00  80 0.00 -1 0 0
  4 0.00  80 0.00   0 0.00 -1 0 0
 55 0.10  20 0.00  60 0.00 -1 0 0
110 0.00   3 1.00  75 0.00 -1 0 0
  3 1.00   2 1.00   4 1.00 -1 0 0
 50 0.00   7 0.00  65 0.00  0 0 1
 65 0.03  50 0.00  22 0.00  0 0 1
 22 0.00  65 0.03  48 0.00  0 0 1
 16 0.00  48 0.00   4 0.00  0 0 1
 34 0.10   5 1.00  40 0.00  0 0 1
 28 0.20  60 0.00   2 1.00  0 0 1
 90 0.25   3 0.00  12 0.00  0 0 1
  5 0.00  40 0.00  70 0.00  0 0 1
  7 0.00  33 0.00  52 0.05  0 0 1
  3 0.00  50 0.00  50 0.00  0 0 1
  9 0.00  24 0.00  31 0.00  0 0 1
 12 0.00  30 0.00  15 0.00  0 0 1
  2 0.00  28 0.10  60 0.00  0 0 1
  2 1.00   0 0.00   2 1.00  0 0 0
  3 1.00   2 1.00   1 1.00  0 0 0
  1 1.00   3 1.00  50 0.00  0 0 0
  4 0.00   2 1.00   3 1.00  0 0 0
 20 0.90   5 1.00  18 0.80  0 0 0
 40 0.70  30 0.80  35 0.90  0 0 0
 18 0.80  20 0.90   2 0.00  0 0 0
  5 0.00   6 1.00   0 0.00  0 0 0
  8 0.10  16 1.00   3 1.00  0 0 0
  6 0.00   0 0.00   2 1.00  0 0 0
  3 0.60  44 0.00   5 1.00  0 0 0
  1 1.00   1 1.00   1 1.00  0 1 0
 60 0.00  50 0.00  40 0.00  0 1 0
 25 0.00   3 1.00  70 0.00  0 1 0
 10 0.00  60 0.00   0 0.00  0 1 0
 14 0.30  10 0.00   8 1.00  0 2 0
 16 0.00   0 0.00   0 0.00  0 0 1
 24 0.00   0 0.00   0 0.00  0 0 1
 60 0.00   0 0.00   0 0.00  0 0 1
  2 0.00   0 0.00   0 0.00  0 0 0
  4 0.00   0 0.00   0 0.00  0 0 0
 18 0.00   0 0.00  22 0.00  0 0 1
 15 0.00  20 0.00   0 0.00  0 0 1
  6 0.00   0 0.00   0 0.00  1 0 1
  2 0.00   2 1.00   3 1.00  1 0 1
  4 1.00   5 1.00   2 1.00  1 0 1
 14 0.80  20 0.90   2 1.00  1 0 1
"""
# Element names of HTML.
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp noscript template svg math object select button".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
IMPLIED = set("p li dt dd td th tr option h1 h2 h3 h4 h5 h6".split())
MARGIN_TAGS = set("nav footer aside form menu dialog fieldset legend".split())
MARGIN_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
ARTICLE_TAGS = set("article main".split())
#: Words of class and id attributes, and the first letters of further ones, that mark margins.
MARGIN_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget comment comments commentlist reply replies respond disqus cookie cookies consent gdpr notice notification alert newsletter subscribe subscription share sharing social related recommended footer popup modal overlay login signup search pager pagination copyright skip toolbar tags".split())
#: Further parts of hyphenated names that may stand beside margin words; any other part ("has-sidebar", "related-work") makes the name another.
BESIDE = set("site main page post top bottom left right primary secondary global inner outer list bar box links link items item container wrapper wrap section area block panel widget form".split())
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_NOT_WORD = re.compile(r"[^a-z0-9]+")


@lru_cache(50_000)
def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is a margin, an article, and a page header (a margin outside articles only)."""
    margin, article, header = tag in MARGIN_TAGS, tag in ARTICLE_TAGS, tag == "header"
    for name, value in _ATTRIBUTE.findall(attributes):
        words = set(_NOT_WORD.split(value.strip("\"'").lower()))
        if name.lower() == "role":
            margin |= bool(words & MARGIN_ROLES)
            article |= bool(words & {"main", "article"})
        elif name.lower() == "itemprop":
            article |= "articlebody" in words
        elif tag not in ("body", "html") and tag not in INLINE:
            for parts in (set(_NOT_WORD.split(w)) - {""} for w in value.strip("\"'").lower().split()):
                margin |= bool(parts & MARGIN_WORDS) and parts <= MARGIN_WORDS | BESIDE
                header |= bool(parts & {"header", "masthead"}) and parts <= {"header", "masthead"} | BESIDE
    return margin and tag not in ARTICLE_TAGS, article, header


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """The text blocks of a page in order: text, words, linked words, whether in an article, enclosing margins.

    An element outside articles that holds over half of the unlinked words of the page's articles, or of the page if it marks
    none, is no margin.
    """
    out: list[tuple[str, int, int, int, tuple[int, ...]]] = []
    open_tags: list[tuple[str, tuple[int, ...], int]] = []  # name, margins so far, articles so far
    pieces: list[str] = []
    margins: tuple[int, ...] = ()
    outer: set[int] = set()  # margins outside articles
    link = articles = link_words = count = 0

    def close() -> None:
        nonlocal link_words
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append((text, text.count(" ") + 1, link_words, articles, margins))
            pieces.clear()
        link_words = 0

    def leave(k: int) -> None:
        nonlocal margins, articles
        close()
        _, margins, articles = open_tags[k]
        del open_tags[k:]

    at = 0
    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            pieces.append(text)
            if link:
                link_words += len(text.split())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "br" or tag == "img" or tag == "wbr":
            pieces.append(" " if tag == "br" else "")
            continue
        if m[1]:
            if tag == "a":
                link = 0
            if tag not in INLINE:
                close()
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == tag:
                    leave(k)
                    break
            continue
        if tag in RAW:
            if tag not in INLINE:
                close()
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}(?![^\s/>])", re.I).search(page, at)
                at = end.start() if end else len(page)
            continue
        if tag == "a":
            link = 1
        if tag not in INLINE:
            close()
            if tag in IMPLIED and open_tags and open_tags[-1][0] == tag:
                leave(len(open_tags) - 1)
        if tag in VOID or m[3].endswith("/"):
            continue
        margin, article, header = _marks(tag, m[3])
        margin = margin or (header and not articles)
        if margin or article or (tag not in INLINE and tag not in IMPLIED):
            close()
            open_tags.append((tag, margins, articles))
            if margin:
                count += 1
                if not articles:
                    outer.add(count)
                margins = (*margins, count)
            articles += article
    close()
    marked = any(b[3] for b in out)
    held: dict[int, int] = dict.fromkeys(outer, 0)
    total = 0
    for _, words, linked, inside, around in out:
        if inside or not marked:
            total += max(words - linked, 0)
            for k in around:
                if k in outer:
                    held[k] += max(words - linked, 0)
    wrappers = {k for k, n in held.items() if 2 * n > total}
    return [(*b[:4], sum(k not in wrappers for k in b[4])) for b in out]


def block_features(found: list[tuple[str, int, int, int, int]]) -> np.ndarray:
    """FEATURES of the blocks of one page."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    words = np.asarray([b[1] for b in found], float)
    density = np.minimum(np.asarray([b[2] for b in found], float) / words, 1)
    inside = np.asarray([b[3] > 0 for b in found])
    article = np.where(inside, 1, -1) if inside.any() else np.zeros(len(found))
    before = lambda x: np.concatenate([[0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0]])
    return np.column_stack([words, density, before(words), before(density), after(words), after(density), article, [b[4] for b in found]])


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple:
    """A binary decision tree by Gini impurity: (feature, value, tree below, tree from value on), or a leaf's verdict."""
    if depth == 0 or y.min() == y.max():
        return (bool(y.mean() >= 0.5),)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for v in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < v
            gini = sum(s.sum() * 2 * y[s].mean() * (1 - y[s].mean()) for s in (low, ~low))
            best = min(best, (gini, f, float(v)))
    if not np.isfinite(best[0]):
        return (bool(y.mean() >= 0.5),)
    low = x[:, best[1]] < best[2]
    return best[1], best[2], train_tree(x[low], y[low], depth - 1), train_tree(x[~low], y[~low], depth - 1)


def judge(tree: tuple, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(node) == 1:
            out[rows] = node[0]
        elif len(rows):
            low = x[rows, node[0]] < node[1]
            todo += [(node[2], rows[low]), (node[3], rows[~low])]
    return out


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    rows = np.asarray([r.split() for r in LABELLED.strip().splitlines()], float)
    return rows[:, :-1], rows[:, -1]


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), tree: tuple | None = None) -> DataFrame:
    """``keep`` columns of ``pages``, ``text`` and ``n_chars`` (its code points) from the whole of ``html``.

    Text blocks are what stands between tags other than inline ones; a break is white space. Character references are
    decoded, white space becomes one space, the blocks that the tree takes for main text are joined by \\n in page order.
    Null or empty html, and pages without main text, give an empty text; a cut-off page is read to its end; repeated rows
    are read each; other columns are ignored.
    """
    tree = tree or train_tree(*labelled_table())
    schema = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col("html").cast("string").alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                b = batch.slice(k, 500)
                found = [blocks(p or "") for p in b.column("html").to_pylist()]
                main = judge(tree, np.concatenate([block_features(f) for f in found])) if found else []
                ends = np.cumsum([0, *map(len, found)])
                texts = ["\n".join(x[0] for x, ok in zip(f, main[i:j], strict=True) if ok) for f, i, j in zip(found, ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*(f"k{i}" for i in range(len(keep))), "text", "n_chars"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.schema.fields[:-1])
    return schema.mapInArrow(read, f"{head}, text string, n_chars bigint").select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text", "n_chars")
