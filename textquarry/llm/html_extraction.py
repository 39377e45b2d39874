"""Main text of web pages by gradient-boosted trees over DOM nodes, with hierarchical decoding.

Features are the densities of a node's subtree (text, links, punctuation, tags), attribute tokens of the node and above
(each with the log odds that the sample gives it; the trees see the least, the greatest and the sum, and nothing of tokens
that the sample lacks), depth, and place and share among its siblings. A page is decoded as a whole: of all choices of nodes in which
nothing below a dropped node is kept, the one with the highest sum of log odds; so an ancestor and a descendant never disagree.

The trees are fitted with Spark ML on a sample of the pages themselves, at most ``max_pages``: those with the smallest
hashes, pages that mark their article with an ``article`` or ``main`` element before others. Each sampled page is also
shown in variants, in which its text (that of the marked element, else all of it) stands in other wrappers, with and
without such a mark, among menus, sidebars, notices, forms and reader comments made of the page's own words, so that the
trees learn from more than tags. The fitted trees have a fixed bound and are sent along with the tasks; extraction covers
every page and shuffles nothing.

Cases: null or empty markup, and pages without main text, give an empty text; markup that is cut off is read as far as
it goes; repeated pages give repeated results; without any page to learn from, all visible text is main text; an empty
table gives an empty table; nesting of any depth takes time in proportion; a column named like a result is replaced.
"""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialise, per_value, table
from .dom import NOISE_TAGS, Page

_MAIN = re.compile(r"<(article|main)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
_PARA = re.compile(r"<p\b[^>]*>(.*?)(?=<p\b|</p|\Z)", re.S | re.I)


# Names that sites give to boxes beside the main text, and to the main text (fixed values, for the variants).
BOXES = {
    "ad": "ad ads advert advertisement adverts banner sponsor sponsored promo promoted promotion".split(),
    "side": "sidebar aside widget related recommended toolbar".split(),
    "notice": "notice notices alert cookie cookies consent gdpr newsletter popup modal subscribe signup login legal disclaimer".split(),
    "links": "share sharing social tags breadcrumb breadcrumbs pagination pager meta byline author".split(),
    "comments": "comments discussion responses replies respond".split(),
    "comment": "comment reply response commenter".split(),
    "top": "menu nav navbar navigation header masthead topbar skip search".split(),
    "foot": "footer foot copyright".split(),
}
MAIN_NAMES = "article articlebody blog body content entry main post story text".split()
#: What sites add to the names of boxes of either kind.
AFFIXES = "box list left inner wrap block".split()
_TITLE = re.compile(r"<h1\b[^>]*>.*?</h1\s*>", re.S | re.I)
_TAGS = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>", re.S | re.I)


def _outside_menus(markup: str) -> str:
    """The text of a page without a mark, but for what stands in menus, headers and the like, or is links mostly."""
    p = Page(markup)
    aside = [False] * len(p.parent)
    for v in range(1, len(aside)):
        aside[v] = aside[p.parent[v]] or p.tag[v] in NOISE_TAGS
    return " ".join(run for node, run, linked in p.runs if not aside[node] and 2 * linked < len(run)) or " ".join(run for _, run, _ in p.runs)


def variants(markup: str, n: int = 8) -> list[str]:
    """The page with its main element marked, where it has one, and n rearrangements of its text; by the page's own seed."""
    m = _MAIN.search(markup)
    rng = random.Random(zlib.crc32(markup.encode("utf-8", "surrogatepass")))
    words = (_TAGS.sub(" ", m[2]) if m else _outside_menus(markup)).split()
    if not words:
        return []
    if m:
        out, article = [markup[: m.start()] + f"<{m[1]} data-main=1>" + markup[m.start(2) :]], m[2]
    else:
        ends = sorted({min(len(words), rng.randint(1, 60) + 60 * i) for i in range(len(words) // 60 + 1)} | {len(words)})
        out, article = [], "".join(f"<p>{' '.join(words[a:b])}</p>" for a, b in zip([0, *ends], ends, strict=False) if a < b)

    def say(least: int, most: int) -> str:
        k, i = rng.randint(least, most), rng.randrange(len(words))
        return " ".join((words * (1 + k // len(words)))[i : i + k] or words[:k])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{say(1, 3)}</a></li>' for i in range(k))

    pick = rng.choice

    def unheard() -> str:
        return "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))

    def named(kind: str) -> str:
        """A class or id of the kind, often with another word at it; sometimes none that says anything."""
        if rng.random() < 0.25:
            return pick(["", f'class="{unheard()}"', f'id="{unheard()}"'])
        name = pick(BOXES[kind])
        name = pick([name, name, f"{name}-{pick(AFFIXES)}", f"{pick(['site', 'page', 'js', 'the'])}_{name}", f"{name} {pick(BOXES[kind])}"])
        return f'{pick(["class", "class", "id"])}="{name}"'

    def noise() -> str:
        kind = rng.randrange(9)
        if kind == 0:
            return f"<div {named('ad')}>{say(3, 30)}</div>"
        if kind == 1:
            return f"<aside {pick(['', named('side')])}><h3>{say(1, 3)}</h3><ul>{links(rng.randint(3, 8))}</ul><p>{say(5, 40)}</p></aside>"
        if kind == 2:
            return f"<div {named('side')}><h2>{say(1, 4)}</h2><p>{say(5, 50)}</p><ul>{links(rng.randint(2, 8))}</ul></div>"
        if kind == 3:
            return f"<div {named('notice')}><p>{say(5, 40)}</p><button>{say(1, 2)}</button></div>"
        if kind == 4:
            return f'<form action="/s"><label>{say(1, 4)}</label><input name="q"><p>{say(3, 20)}</p><button>{say(1, 1)}</button></form>'
        if kind == 5:
            return f"<div><ul>{links(rng.randint(3, 10))}</ul></div>"
        if kind == 6:
            return f"<div {named('links')}><a href='#'>{say(1, 2)}</a> <a href='#'>{say(1, 2)}</a></div>"
        box = pick(["section", "div", "ol"])
        replies = "".join(f"<div {named('comment')}><p>{say(4, 60)}</p></div>" for _ in range(rng.randint(1, 6)))
        return f"<{box} {named('comments')}><h3>{say(1, 3)}</h3>{replies}</{box}>"

    for _ in range(n):
        body = article
        for spot in [p.start() for p in _PARA.finditer(body)][::-1]:
            if rng.random() < 0.15:
                own = [
                    f"<h2>{say(1, 6)}</h2>",
                    "<ul>" + "".join(f"<li>{say(3, 25)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>",
                    f"<blockquote>{say(8, 50)}</blockquote>",
                    f"<blockquote><p>{say(8, 50)}</p></blockquote>",
                    f"<table><tr><th>{say(1, 2)}<th>{say(1, 2)}</tr><tr><td>{say(1, 9)}<td>{say(1, 9)}</tr></table>",
                    f"<pre>{say(5, 40)}</pre>",
                    f"<p>{say(1, 6)}</p>",
                    f"<h3>{say(1, 5)}</h3>",
                    f"<figure><figcaption>{say(3, 12)}</figcaption></figure>",
                ]
                body = body[:spot] + pick(own) + body[spot:]
            if rng.random() < 0.1:
                body = body[:spot] + noise().replace(">", " data-main=0>", 1) + body[spot:]
        own_name = f'{pick(["class", "id"])}="{pick(MAIN_NAMES)}{pick(["", "", f"-{pick(AFFIXES)}", "-body", " wide"])}"'
        wrap = pick(["article", "main", f"div {own_name}", f"div {own_name}", f"section {own_name}", "div", "section", f'div class="{unheard()}"', f'div id="{unheard()}"'])
        end = wrap.split()[0]
        if end in ("article", "main") and (title := _TITLE.search(body)) and rng.random() < 0.4:  # the article's own header
            body = body[: title.start()] + f"<header>{title[0]}</header>" + body[title.end() :]
        inner = f"<{wrap} data-main=1>{body}</b></{end}>"
        inner = pick([inner, f'<div id="wrap"><div>{inner}</div></div>', f"<main>{inner}</main>"])
        tops = [
            f"<nav><ul>{links(6)}</ul></nav>",
            f"<div {named('top')}><ul>{links(5)}</ul></div>",
            f"<header><h1>{say(1, 4)}</h1><p>{say(2, 12)}</p><nav>{links(4)}</nav></header>",
            f"<div {named('top')}><a href='/'>{say(1, 3)}</a><ul {named('top')}>{links(7)}</ul></div>",
            f"<header><p>{say(1, 8)}</p></header>",
        ]
        feet = [
            f"<footer>&copy; {say(1, 6)}</footer>",
            f"<div {named('foot')}><p>{say(3, 25)}</p></div>",
            f"<footer><p>{say(3, 20)}</p><ul>{links(4)}</ul></footer>",
            f"<div {named('foot')}>{say(2, 10)}</div>",
        ]
        top, foot = pick(tops), pick(feet)
        if rng.random() < 0.1:  # little besides the text
            k = rng.randint(1, 3)
            bare = "".join(f"<p>{say(8, 60)}</p>" for _ in range(k)) if rng.random() < 0.5 else body + "</b>"
            out.append(f"<html><body data-main=1>{bare}</body></html>")
            continue
        before, after = ("".join(noise() for _ in range(rng.randint(0, 2))) for _ in range(2))
        out.append(f"<html><body>{top}{before}{inner}{after}{foot}</body></html>")
    return out


class Trees:
    """Boosted regression trees as flat arrays, evaluated over all nodes and trees at once."""

    def __init__(self, model=None, evidence: dict[str, float] | None = None):
        self.evidence = evidence or {}
        self.weights, rows, self.roots = [], [], []
        for weight, tree in zip(model.treeWeights, model.trees, strict=True) if model else []:
            self.weights.append(weight)
            self.roots.append(len(rows))
            self._add(tree._call_java("rootNode"), rows)
        table_ = np.array(rows or [[0, 0, 0, 0, 0]], float)
        self.feature, self.left, self.right = (table_[:, i].astype(np.int64) for i in (0, 2, 3))
        self.threshold, self.value = table_[:, 1], table_[:, 4]

    def _add(self, node, rows: list) -> int:
        at = len(rows)
        rows.append([0, 0.0, at, at, 0.0])
        if node.getClass().getSimpleName() == "LeafNode":
            rows[at][4] = node.prediction()
        else:
            rows[at][:2] = [node.split().featureIndex(), node.split().threshold()]
            rows[at][2] = self._add(node.leftChild(), rows)
            rows[at][3] = self._add(node.rightChild(), rows)
        return at

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        if not self.roots:  # nothing learnt
            return np.ones(len(x))
        at = np.tile(np.array(self.roots), (len(x), 1))
        rows = np.arange(len(x))[:, None]
        while True:
            new = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            if (new == at).all():
                return 2 * self.value[at] @ np.array(self.weights)
            at = new


def fit(pages: DataFrame, html: str = "html", max_pages: int = 200, max_nodes: int = 500, trees: int = 24, depth: int = 5) -> Trees:
    """Boosted trees from at most max_pages pages, and of each of their variants at most max_nodes nodes."""
    held = pages.filter(F.length(html) > 0).select(F.col(html).alias("html"), F.lower(html).rlike("<(article|main)[ >]").alias("marked"), F.xxhash64(html).alias("h"))
    sample = materialise(held.orderBy(F.desc("marked"), "h", "html").limit(max_pages).select("html"))

    def tokens(markup: str) -> list[tuple]:
        """Each element's attribute tokens, with whether it is or holds main text."""
        pages = [Page(v) for v in variants(markup)]
        return [(label, " ".join(own)) for p in pages for label, own in zip(p.truth().tolist(), p.tokens, strict=True)]

    named = per_value(sample.repartition(16), "html", {"label": "double", "tokens": "string"}, lambda: tokens, many=True)
    seen = materialise(named.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("main")))
    n, main = (float(x or 0) for x in seen.agg(F.sum("n"), F.sum("main")).first())
    if not 0 < main < n:
        return Trees()
    each = seen.select(F.explode(F.split("tokens", " ")).alias("token"), "n", "main").filter("token <> ''").groupBy("token").agg(F.sum("n").alias("n"), F.sum("main").alias("main"))
    # A row a token that occurs in the sample twice or more, so bounded as the sample is.
    evidence = {t: math.log((good + 1) / (all_ - good + 1)) - math.log(main / (n - main)) for t, all_, good in each.filter("n > 1").orderBy("token").collect()}
    forget(seen)

    def nodes(markup: str) -> list[tuple]:
        out = []
        for v in variants(markup):
            page = Page(v)
            truth, x = page.truth(), page.features(evidence).astype(np.float64)
            some = np.random.default_rng(1).permutation(len(x))[:max_nodes]
            out += zip(truth[some].tolist(), x[some], strict=True)
        return out

    rows = materialise(per_value(sample.repartition(16), "html", {"label": "double", "x": "array<double>"}, lambda: nodes, many=True))
    forget(sample)
    train = rows.select("label", array_to_vector("x").alias("features")).coalesce(8)
    train = train.persist()
    try:
        return Trees(GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1, cacheNodeIds=False).fit(train), evidence)
    finally:
        train.unpersist()
        forget(rows)


def extract(pages: DataFrame, trees: Trees, html: str = "html", keep: bool = False) -> DataFrame:
    """pages with text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def one(markup: str | None) -> tuple[str, int]:
        page = Page(markup)
        if not page.runs:
            return "", 0
        text = page.decode(shared.value.odds(page.features(shared.value.evidence)))
        return text, len(text)

    return per_value(pages, html, {"text": "string", "n_chars": "long"}, lambda: one, keep)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", "n_chars")
