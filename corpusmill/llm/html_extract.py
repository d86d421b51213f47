"""Main text of web pages by minimum-cut labelling of blocks.

A page is cut into blocks at block-level tags.  A classifier says how much it costs to call a block
content or boilerplate; these costs become the terminal capacities of a graph.  Neighbouring blocks,
and blocks with the same parent, are tied by smoothness edges, which weigh about as much as the
evidence of an unclear block.  The maximum flow gives the labelling of least total cost, and the
blocks on the content side are the text.

The classifier is a logistic regression over evidence from tags, names, links and text.  Its weights
start from priors and are fitted to a bounded sample of the pages themselves: blocks inside an
element whose tag leaves no doubt (nav, footer, aside and so on against article and main) are the
labelled rows.  A weight is held near its prior by a penalty, so that pages without such tags, or
a table that is empty, leave the priors as they are.

Null and empty pages give an empty text.  Nothing is capped: pages of any length are read whole, in
time in proportion to their length.  Repeated rows are extracted each.  An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
STOP = re.compile("[\"'>]")
NAMED = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
RAW = {t: re.compile(f"</{t}\\s*+>", re.I) for t in "script style noscript template svg iframe title textarea select object canvas video audio".split()}

BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button option head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags and names of elements that hold no article text, and of those that do.
BAD_TAGS = frozenset("nav footer aside form button dialog menu fieldset legend option head".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form note".split())
BAD_WORDS = frozenset("ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login search widget pagination pager copyright legal toolbar skip hidden".split())
GOOD_TAGS = frozenset("article main".split())
GOOD_WORDS = frozenset("article content post entry main story body text".split())

#: Evidence, and the weight in log odds that each has before fitting; positive evidence speaks for content.
EVIDENCE = {"always": -0.5, "bad_tag": -6.0, "bad_name": -5.0, "article": 4.0, "good_name": 1.5, "long": 1.5, "short": -0.4, "sentence": 0.8, "links": -3.0, "heading": 0.8, "words": 0.4, "marks": -0.6}
#: Strength of the priors: as many labelled blocks would have to speak against one to halve its part.
PENALTY = 200.0
#: Pages and blocks of the sample that the classifier is fitted to.
SAMPLE_PAGES, SAMPLE_BLOCKS = 400, 20_000
#: Capacities are log odds times this, rounded.
SCALE = 16
#: Smoothness in log odds: neighbours with one parent, other neighbours, next block with the same parent.
NEAR, NEXT, KIN = 1.2, 0.4, 0.6

Weights = tuple[float, ...]
PRIORS: Weights = tuple(EVIDENCE.values())


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    tag: str
    bad_tag: bool
    bad_name: bool
    article: bool
    good_name: bool
    parent: int


@lru_cache(maxsize=20_000)
def named(attrs: str) -> tuple[bool, bool]:
    """Whether an element's names speak against or for content."""
    bad = good = False
    for m in NAMED.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            found = {w.lower() for w in WORD.findall(value)}
            bad |= not BAD_WORDS.isdisjoint(found)
            good |= not GOOD_WORDS.isdisjoint(found)
        elif key == "role":
            bad |= value.lower() in BAD_ROLES
            good |= value.lower() in ("main", "article")
        elif key == "style":
            bad |= "display:none" in value.replace(" ", "").lower()
        else:
            bad |= value.lower() != "false"
    return bad, good


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, closing, attributes) of each tag in order; comments, declarations and elements without text count as tags without a name.

    Where the quotes of a page do not pair up, a tag ends at the next ">".  Each search that finds
    nothing is the last of its kind, so the time is in proportion to the length.
    """
    n, at, quoted, comments = len(html), html.find("<"), True, True
    last = html.rfind(">")
    while 0 <= at <= last or 0 <= at and html.startswith("<!--", at):
        if comments and html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, "", False, ""
            at = html.find("<", end)
            continue
        closing = html.startswith("/", at + 1)
        m = NAME.match(html, at + 1 + closing)
        if m is None:
            if closing or at + 1 < n and html[at + 1] in "!?":
                end = html.find(">", at) + 1 or n
                yield at, end, "", False, ""
                at = html.find("<", end)
            else:
                at = html.find("<", at + 1)  # a sign, not a tag
            continue
        end = m.end()
        while quoted:
            s = STOP.search(html, end)
            if s is None:
                quoted = False
            elif s[0] == ">":
                end = s.end()
                break
            else:
                end = html.find(s[0], s.end()) + 1
                if not end:
                    quoted = False
        if not quoted:
            end = html.find(">", m.end()) + 1
        name, attrs = m[0].lower(), html[m.end() : end - 1]
        if name in RAW and not closing:
            s = RAW[name].search(html, end)
            end = n if s is None else s.end()
            name = ""
        yield at, end, name, closing, attrs
        at = html.find("<", end)


class _Open(NamedTuple):
    tag: str
    bad_tag: bool
    bad_name: bool
    article: bool
    good_name: bool
    number: int
    block: str  # nearest block-level tag, itself included
    parent: int  # number of the element around that


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    stack = [_Open("", False, False, False, False, 0, "", 0)]
    count: dict[str, int] = {}
    parts: list[str] = []
    linked = at = serial = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                o = stack[-1]
                out.append(Block(text, linked, o.block, o.bad_tag, o.bad_name, o.article, o.good_name, o.parent))
            parts.clear()
            linked = 0

    def close(tag: str) -> None:
        while stack[-1].tag != tag:
            count[stack.pop().tag] -= 1
        count[stack.pop().tag] -= 1

    for begin, end, tag, closing, attrs in tags(html):
        if begin > at:
            part = html[at:begin]
            parts.append(part)
            if count.get("a"):
                linked += len(part)
        at = end
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in BLOCK
        if block:
            flush()
        if closing:
            if count.get(tag):
                close(tag)
            continue
        if block and count.get("p") and tag not in ("button", "option"):
            close("p")
        if tag in ("li", "option", "dd", "dt", "tr", "td", "th") and stack[-1].tag == tag:
            close(tag)
        if tag in VOID:
            continue
        o = stack[-1]
        bad_name, good_name = o.bad_name, o.good_name
        if attrs.strip(" /\n\t"):
            b, g = named(attrs)
            # an element called both, as "post-comments", is no content; the page's own frame is judged by its parts
            bad_name |= b and tag not in ("html", "body") and not (tag in GOOD_TAGS and g)
            good_name |= g
        bad_tag = o.bad_tag or tag in BAD_TAGS or (tag == "header" and not o.article)
        serial += 1
        stack.append(_Open(tag, bad_tag, bad_name, o.article or tag in GOOD_TAGS, good_name, serial, tag if block else o.block, o.number if block else o.parent))
        count[tag] = count.get(tag, 0) + 1
    if at < len(html):
        parts.append(html[at:])
    flush()
    return out


def evidence(b: Block) -> tuple[float, ...]:
    """What is known of a block, in the order of EVIDENCE."""
    n, text = len(b.text), b.text
    letters = sum(map(str.isalpha, text[:400]))  # the share of letters shows early
    marks = min(n, 400) - letters - text.count(" ", 0, 400)
    return (
        1.0, float(b.bad_tag), float(b.bad_name), float(b.article), float(b.good_name), float(n >= 80), float(n < 25), float(text[-1] in ".!?…:;\"”»"),
        float(b.linked * 2 > n), float(b.tag in HEADING and not b.bad_tag), float(text.count(" ") >= 6), float(marks * 5 > min(n, 400)),
    )


def minimum_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least cost: content is the source side after a maximum flow (shortest augmenting levels)."""
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(there)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            tie(source, i, s, 0)
        elif s < 0:
            tie(i, sink, -s, 0)
    for a, b, w in edges:
        tie(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue and level[sink] < 0:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                most = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= most
                    cap[e ^ 1] += most
                k = next(i for i, e in enumerate(path) if not cap[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while tried[a] < len(out[a]):
                e = out[a][tried[a]]
                if cap[e] and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                continue
            path.append(e)
            a = to[e]


def labelled(found: list[Block], weights: Weights = PRIORS) -> tuple[list[bool], list[bool]]:
    """For each block whether it is content, by the cut and by its own evidence alone."""
    scores = [round(SCALE * sum(w * x for w, x in zip(weights, evidence(b), strict=True))) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, round(SCALE * (NEAR if found[i - 1].parent == b.parent else NEXT))))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, round(SCALE * KIN)))
        last[b.parent] = i
    return minimum_cut(scores, edges), [s > 0 for s in scores]


def main_text(html: str, weights: Weights = PRIORS) -> str:
    found = blocks(html)
    keep, _ = labelled(found, weights)
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def fit(x: np.ndarray, y: np.ndarray, priors: Weights = PRIORS, penalty: float = PENALTY, rounds: int = 25) -> Weights:
    """Logistic regression by Newton steps, each weight held to its prior by a quadratic penalty."""
    w0 = np.array(priors)
    w = w0.copy()
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * (w - w0))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def fitted_weights(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_blocks: int = SAMPLE_BLOCKS) -> Weights:
    """Weights fitted to the surely labelled blocks of `sample_pages` pages, chosen by hash; only their evidence, at most `sample_blocks` short rows, reaches the driver.

    The tag that labels a block is left out of its evidence every other time, so that the other evidence has to carry the label too.
    """
    key = F.xxhash64(F.col("page_id").cast("long"), F.col("url").cast("string"))
    chosen = pages.select(key.alias("key")).distinct().orderBy(F.xxhash64("key"), "key").limit(sample_pages)

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        article, bad_tag = (list(EVIDENCE).index(k) for k in ("article", "bad_tag"))
        for batch in batches:
            rows, sure = [], []
            for html in batch.column("html").to_pylist():
                for i, b in enumerate(blocks(html or "")):
                    if b.bad_tag or b.article and not b.bad_name:
                        e = list(evidence(b))
                        if i % 2:
                            e[article] = e[bad_tag] = 0.0
                        rows.append(e)
                        sure.append(float(not b.bad_tag))
            if rows:
                yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), pa.array(sure)], names=["x", "y"])

    sample = pages.select(key.alias("key"), "html").join(F.broadcast(chosen), "key").select("html").mapInArrow(observe, "x array<double>, y double")  # sample_pages keys
    got = sample.limit(sample_blocks).collect()
    return fit(np.array([r["x"] for r in got]).reshape(-1, len(PRIORS)), np.array([r["y"] for r in got]))


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points), n_changed (blocks that the cut labels against their own evidence).  Without `weights` the classifier is fitted to a sample of `pages`."""
    fitted = fitted_weights(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = [], []
            for html in batch.column("html").to_pylist():
                found = blocks(html or "")
                keep, alone = labelled(found, fitted)
                texts.append("\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k))
                changed.append(sum(k != a for k, a in zip(keep, alone, strict=True)))
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(changed, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_changed"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_changed long")
