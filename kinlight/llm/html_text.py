"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks of text between block-level tags. Each block is described by its words and link
density, those of its neighbours, and, as weaker hints, by what it stands in; a tree that is grown here from a
small labelled table tells the article's blocks from the rest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlight.llm import common

#: Comments and declarations, then tags with quoted attributes; a tag cut off by the page's end goes, too.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: Elements whose content is never text of the page.
RAW = frozenset("script style title textarea iframe noframes noembed noscript template svg math object select xmp".split())
#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that rarely hold an article's text. Forms are apart, as some pages wrap all they have in one.
BOILER_TAGS = frozenset("nav footer aside menu dialog button head".split())
FORM_TAGS = frozenset(["form", "fieldset"])
ARTICLE_TAGS = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose own name says little unless it is a boilerplate word and nothing else.
TEXT_TAGS = HEADINGS | frozenset("p li dt dd td th blockquote pre figcaption".split())
#: First or last parts of class, id and role names of what is seldom the article.
BOILER_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar share sharing social related recommended newsletter subscribe signup login search widget copyright legal pagination pager toolbar complementary contentinfo".split())
HEADER_NAMES = frozenset(["header", "masthead"])
COMMENT_NAMES = ("comment", "disqus", "repl", "respond", "discussion")

#: What a block is described by: words and share of its letters in links, the same of the block before, the
#: one after and all of up to NEAR blocks on both sides, and, as 0 or 1, what the block stands in.
DENSITIES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "words_near", "links_near")
NEAR = 3
PLACES = ("article", "outside", "boiler", "form", "comments", "header", "heading")
FEATURES = (*DENSITIES, *PLACES)

#: The labelled table, as example pages. ``[n]`` stands for n words of the article, ``(n)`` for n other words.
#: Layouts differ on purpose: the same element holds article text on one page and none on another, so what a
#: block stands in seldom settles its label, and words and links of the block and its neighbours have to.
EXAMPLES = [
    # articles marked as such, with menus, related links and adverts in and around them
    "<nav><ul><li><a>(1)</a><li><a>(1)</a><li><a>(2)</a></ul></nav><div class=ad>(12)</div><article><h1>[10]</h1><p>[60]<p>[2]<p>[9]<p>[45]</article><footer>(9)</footer>",
    "<nav><a>(2)</a> <a>(1)</a></nav><div class=ad>(8)</div><article><h1>[4]</h1><p>[120]</article><footer>(6)<br>(2)</footer>",
    "<div class=ad>(25)</div><article><h1>[1]</h1><p>[3]<p>[5]<p>[1]</article><footer>(14)</footer>",
    "<nav><li><a>(1)</a><li><a>(3)</a></nav><article><h2>[6]</h2><p>[30]<ul><li><a>(4)</a><li><a>(5)</a><li><a>(3)</a></ul><p>[40]<p><a>[5]</a><p>[25]</article><footer>(4)</footer>",
    "<article><h1>[7]</h1><p>[18] <a>[2]</a> [20]<p><a>[6]</a> [3]<p>[50]<div><a>(2)</a> <a>(1)</a> (1) <a>(2)</a></div><div><a>(3)</a></div><div><a>(2)</a> <a>(2)</a></div></article>",
    "<article><p>[35]<p>[12] <a>[9]</a><p>[22]<h3>[3]</h3><ul><li>[4]<li>[7]<li>[2]<li>[9]</ul><p>[28]</article><div><a>(2)</a></div><div><a>(4)</a></div>",
    "<article><h1>[8]</h1><ul><li><a>(2)</a><li><a>(3)</a><li><a>(2)</a><li><a>(4)</a></ul><p>[70]<p>[41]<p><a>(3)</a><p><a>(5)</a><p><a>(4)</a></article><p>(18)</p>",
    "<main><div class=breadcrumb><a>(1)</a> <a>(2)</a></div><h1>[5]</h1><p>[25]<div class=share><a>(1)</a> <a>(1)</a></div><p>[31]<div class=newsletter>(11)</div><p>[16]</main><footer>(20)</footer>",
    "<article><header><h1>[9]</h1><p>(4)</p><p>[26]</p></header><p>[48]<p>[33]<aside>(15)</aside><p>[21]<footer>(7)</footer></article>",
    "<article><header><h1>[2]</h1><p>(3)</p></header><p>[20]<p>[8]</article>",
    "<article><header><h2>[6]</h2><p>(9)</p><p>(5)</p></header><p>[34]</article>",
    "<article><header><h1>[3]</h1><div>(2)</div><div>(6)</div></header><p>[15]<p>[80]</article><aside><h3>(2)</h3><article><p>(22)<p>(9)</article></aside>",
    # articles of many short blocks: lists, verse, talk, tables
    "<article><h1>[2]</h1><p>[1]<p>[3]<p>[2]<p>[5]<p>[1]<p>[13]<p>[2]<p>[8]<p>[40]<p>[2]<p>[1]</article><footer>(3)</footer>",
    "<nav><a>(1)</a></nav><div class=ad>(11)</div><article><p>[6]<p>[60]<p>[4]<p>[14]<p>[11]<p>[9]<p>[90]<p>[7]<h2>[1]</h2><p>[30]<p>[3]</article><footer>(11)</footer>",
    "<div class=ad>(9)</div><article><p>[12]</article><footer>(5)</footer>",
    "<article><table><tr><td>[1]<td>[2]<td>[1]<tr><td>[4]<td>[1]<td>[10]<tr><td>[2]<td>[6]<td>[3]</table></article>",
    "<ul><li><a>(2)</a></ul><div>(13)</div><article><p>[2]<br>[50]<br>[10]<br>[3]<br>[28]<br>[1]</article><div>(7)</div>",
    "<article><p>[25]<p>[1]<p>[70]<p>[13]<p>[35]<p>[4]<p>[100]<p>[14]<h2>[2]</h2><p>[55]<p>[8]<p>[20]<p>[11]</article>",
    # text under a name or element that is boilerplate elsewhere
    "<article class=promo-story><h1>[6]</h1><p class=share-price>[14]<p>[44]<div class=alert><p>(8)</div><p>[27]</article>",
    "<div class=sidebar-left><div class=ad><p>(30)</div><p>(16)</div><article><p>[52]<p>[11]</article>",
    # comments
    "<article><p>[40]<p>[65]</article><section id=comments><h3>(1)</h3><p>(35)<p>(2)<p>(70)</section>",
    "<article><h1>[5]</h1><p>[20]<p>[8]<div class=comment-list><div class=comment>(28)</div><div class=comment>(4)</div></div></article>",
    "<div id=content><h1>[6]</h1><p>[38]<p>[19]</div><div class=replies><p>(44)<p>(12) <a>(2)</a><p>(26)</div>",
    # forms: around a whole page, and small ones
    "<form><div><a>(1)</a> <a>(2)</a></div><article><h1>[6]</h1><p>[55]<p>[4]</article><div>(3)</div></form>",
    "<form><div><a>(1)</a> <a>(1)</a></div><h1>[5]</h1><p>[62]<p>[34]<p>[24]<div>(5)</div></form>",
    "<article><p>[36]<form><label>(2)</label><div>(3)</div><div>(9)</div></form><p>[29]</article>",
    "<article><p>[17]<p>[51]</article><form><div>(4)</div><div>(12)</div><div>(2)</div></form>",
    "<p>[43]<p>[26]<form><p>(6)<p>(2)<p>(11)</form><p>(3)",
    # no element marks the article
    "<div><a>(1)</a></div><div><a>(2)</a></div><h1>[9]</h1><div>[60]</div><div>[18]</div><div>[3]</div><div>[42]</div><div><a>(3)</a></div><div>(5)</div>",
    "<ul><li><a>(2)</a><li><a>(1)</a><li><a>(3)</a></ul><h1>[4]</h1><p>[22]<p>[35]<p>[15]<div>(6)</div><ul><li><a>(2)</a><li><a>(2)</a></ul>",
    "<table><tr><td><a>(1)</a><td><a>(2)</a><tr><td>[75]<td>(4)</table><p>(3)",
    "<h2>[3]</h2><p>[28]<ul><li>[5]<li>[6]<li>[4]<li>[7]</ul><p>[32]<h2>(2)</h2><ul><li><a>(4)</a><li><a>(6)</a></ul>",
    "<div><a>(3)</a> (1) <a>(2)</a></div><p>[24]<p><a>[2]</a> [17] <a>[4]</a><p>[110]<p>(6) <a>(9)</a> (3)<p><a>(4)</a><p>(8)",
    "<div>(4)</div><div>(7)</div><p>[46]<p>[8]<p>[39]<div>(5)</div><div>(2)</div>",
    "<div><a>(2)</a></div><div>(3)</div><div>(5)</div><div><a>(1)</a></div><div>(2)</div>",
    "<div class=header><h1>(2)</h1><a>(1)</a></div><h1>[7]</h1><p>[16]<p>[29]<div class=footer>(9)</div>",
    "<h1>[6]</h1><p>[21]<blockquote>[12]</blockquote><p>[33]<h3>(2)</h3><p><a>(5)</a><p><a>(6)</a>",
    "<div class=cookie>(10)</div><article><header><h1>[3]</h1><p>(2) <a>(1)</a></p></header><p>[5]<p>[6]<p>[1]</article>",
    "<div class=ad>(14)</div><article><header><h1>[8]</h1></header><p>[25]<p>[2]</article>",
    "<form><div><a>(1)</a> <a>(1)</a></div><h1>[2]</h1><p>[20]<p>[20]</form>",
    "<form><p>(3)</p><p>(3)</p><p>(1)</p><p>(5)</p></form>",
    "<div><a>(1)</a> <a>(1)</a></div><h2>[2]</h2><p>[20]<p>[2]<p>[20]<div><a>(1)</a> <a>(1)</a></div>",
    "<div><a>(2)</a></div><h1>[5]</h1><p>[20]<p>[3]<p>[4]<p>[24]<ul><li>[5]<li>[4]<li>[2]</ul><p>[20]",
    "<p>[20]<ul><li>[5]<li>[4]<li>[2]</ul><p>[20]",
    "<p>[15]",
    "<h1>[3]</h1><p>[18]",
    "<p><a>(3)</a><p>(4)<p><a>(2)</a>",
]
_SAMPLE = re.compile(r"([\[(])(\d+)[\])]")


def labelled() -> list[tuple]:
    """FEATURES of each block of the example pages, then 1 for text of the article and 0 for the rest."""
    rows = []
    for page in EXAMPLES:
        found = blocks(_SAMPLE.sub(lambda m: " ".join(["text" if m[1] == "[" else "rest"] * int(m[2])), page))
        rows += [(*x, "text" in block[0].split()) for x, block in zip(describe(found).tolist(), found, strict=True)]
    return rows


def grow(rows: list[tuple]) -> list[tuple]:
    """A decision tree that fits the labelled rows: nodes (feature, threshold, left, right), where a leaf
    has feature -1 and its label as threshold. Splits lower the Gini impurity most; ties go to the feature
    named first and the lowest threshold."""
    nodes: list[tuple] = []

    def impurity(labels: np.ndarray) -> float:
        p = labels.mean() if len(labels) else 0
        return 2 * p * (1 - p) * len(labels)

    def build(data: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(())
        labels = data[:, -1]
        best = None
        for f in range(data.shape[1] - 1):
            values = np.unique(data[:, f])
            for threshold in (values[1:] + values[:-1]) / 2:
                left = data[:, f] <= threshold
                cost = impurity(labels[left]) + impurity(labels[~left])
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, threshold)
        if labels.min() == labels.max() or best is None or best[0] > impurity(labels) - 1e-12:
            nodes[at] = (-1, float(labels.mean() > 0.5), 0, 0)
            return at
        left = data[:, best[1]] <= best[2]
        nodes[at] = (best[1], float(best[2]), build(data[left]), build(data[~left]))
        return at

    build(np.array(rows, float))
    return nodes


def classify(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    """The tree's label of each row of ``x``."""
    feature = np.array([n[0] for n in tree])
    threshold = np.array([n[1] for n in tree])
    left, right = np.array([n[2] for n in tree]), np.array([n[3] for n in tree])
    node = np.zeros(len(x), np.int64)
    inner = feature[node] >= 0
    while inner.any():
        at = np.flatnonzero(inner)
        go = x[at, feature[node[at]]] <= threshold[node[at]]
        node[at] = np.where(go, left[node[at]], right[node[at]])
        inner = feature[node] >= 0
    return threshold[node] > 0.5


def _boiler_name(value: str, whole: bool) -> bool:
    """Whether a class, id or role has a boilerplate word: a name of its own, or, unless ``whole``, the first
    or last part of one."""
    for name in value.split():
        parts = [p.lower() for p in NAME_PARTS.findall(name)]
        if parts and (parts[0] in BOILER_NAMES or parts[-1] in BOILER_NAMES) and (len(parts) == 1 or not whole):
            return True
    return False


class _Place:
    """What an open element means for the blocks in it."""

    __slots__ = ("tag", "article", "boiler", "form", "comments", "header")

    def __init__(self, tag: str, article=False, boiler=False, form=False, comments=False, header=False):
        self.tag, self.article, self.boiler, self.form, self.comments, self.header = tag, article, boiler, form, comments, header

    def inner(self, tag: str, attributes: str) -> _Place:
        article, boiler, form = self.article, self.boiler or tag in BOILER_TAGS, self.form or tag in FORM_TAGS
        comments, header = self.comments, self.header or tag == "header"
        starts = tag in ARTICLE_TAGS
        if attributes and tag not in ("body", "html"):
            for kind, *values in ATTRIBUTE.findall(attributes):
                value = "".join(values)
                starts = starts or (kind.lower() == "role" and value.lower() == "main")
                boiler = boiler or (tag not in ARTICLE_TAGS and _boiler_name(value, tag in TEXT_TAGS))
                parts = {p.lower() for p in NAME_PARTS.findall(value)}
                header = header or (tag not in TEXT_TAGS and bool(parts & HEADER_NAMES))
                comments = comments or any(p.startswith(COMMENT_NAMES) for p in parts)
        if starts and not self.boiler:  # an article in a sidebar is a teaser; one in a form is still the article
            article, boiler, form, header = True, False, False, False
        return _Place(tag, article, boiler, form, comments, header)


def blocks(page: str) -> list[tuple[str, int, _Place, bool]]:
    """The text blocks of a page in order: text, characters of it inside links, surroundings, heading or not.

    Character references are decoded and white space is one space. Elements that were never closed end
    with the element around them; a page may break off anywhere."""
    out: list[tuple[str, int, _Place, bool]] = []
    stack = [_Place("")]
    parts: list[str] = []
    linked: list[str] = []
    in_link = heading = False

    def close() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, len(" ".join("".join(linked).split())), stack[-1], heading))
        parts.clear()
        linked.clear()

    def say(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked.append(text)

    at = 0
    while found := MARKUP.search(page, at):
        say(page[at : found.start()])
        at = found.end()
        ending, tag, attributes = found[1], found[2], found[3]
        if tag is None:
            ending, tag, attributes = found[4], found[5], found[6]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW and not ending:
            if not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            if tag not in INLINE:
                close()
            continue
        if tag == "a":
            in_link = not ending
            if in_link:
                linked.append(" ")
            continue
        if tag in INLINE:
            continue
        close()
        if tag in HEADINGS:
            heading = not ending
        elif tag not in VOID and tag != "p":
            heading = False
            if not ending:
                stack.append(stack[-1].inner(tag, attributes))
                in_link = False
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        in_link = False
                        break
        elif tag == "p":
            heading = False
            if stack[-1].tag == "p":
                stack.pop()
            if not ending and attributes:
                stack.append(stack[-1].inner(tag, attributes))
    say(page[at:])
    close()
    return out


def _near(values: np.ndarray) -> np.ndarray:
    """For each block, the sum over up to NEAR blocks on both sides of it."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    at = np.arange(len(values))
    return total[np.minimum(at + NEAR + 1, len(values))] - total[np.maximum(at - NEAR, 0)] - values


def describe(found: list[tuple[str, int, _Place, bool]]) -> np.ndarray:
    """FEATURES of each block."""
    has_article = any(p.article for _, _, p, _ in found)
    n = len(found)
    out = np.zeros((n, len(FEATURES)))
    words = np.array([len(t.split()) for t, _, _, _ in found], float)
    letters = np.array([len(t) for t, _, _, _ in found], float)
    linked = np.minimum(np.array([k for _, k, _, _ in found], float), letters)
    out[:, 0], out[:, 1] = words, linked / np.maximum(letters, 1)
    out[1:, 2:4], out[:-1, 4:6] = out[:-1, :2], out[1:, :2]
    out[:, 6], out[:, 7] = _near(words), _near(linked) / np.maximum(_near(letters), 1)
    out[:, 8:] = [(p.article, has_article and not p.article, p.boiler, p.form, p.comments, p.header, heading) for _, _, p, heading in found]
    return out


def main_text(page: str | None, tree: list[tuple] | None = None) -> str:
    """The article of a page: its blocks joined by one space; empty if there are none."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = classify(tree or grow(labelled()), describe(found))
    return " ".join(f[0] for f, k in zip(found, keep, strict=True) if k)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = grow(labelled())
    for batch in batches:
        texts = [main_text(page, tree) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of ``pages(page_id, url, html)``.

    Null and empty html, and pages without an article, give empty text. Ids and urls pass as they are, null
    or repeated; other columns are ignored. An empty table gives an empty result. Each page is read in one
    pass by the task that has it; nothing is shuffled.
    """
    common.small_text_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    texts = rows.mapInArrow(common.trimmed(_extract_batches), f"page_id {kind}, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
