"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree.

Each node of a page (an element that makes a block, or a run of text) has features: how much text its subtree holds and how densely, how much of it
in links, punctuation, depth, place among its siblings and what these hold, and what the words of its tag, class, id and role, and those of its
ancestors, have stood for in training. Trees tell the log-odds that main text is in it; second trees, learned on pages that the first haven't seen, weigh them against those of the node's
ancestors and siblings. Decoding takes the choice of nodes of
the greatest summed log-odds in which no node is kept below one that isn't, and none without text that is kept below it.

Labels: no table says which nodes of a page are main text. The trees learn from pages that are composed of labelled parts
(``compose``): layouts, tags and names are drawn, texts come from runs of a bounded sample of the given pages (``SAMPLE``), whole runs of pages of up to
``SAMPLE_CHARS`` characters. Judging takes every page whole.

Defined results: a null or empty page, or one without main text, has an empty text; a page's headline is part of its article; ``<br>`` is white space
inside a block; white space is what Unicode calls so, no-break spaces included; equal pages have equal texts; rows that repeat give equal rows;
null ids and urls are kept; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm import boosting
from sigspark.llm.bytetext import blocks, string_buffers
from sigspark.llm.page_nodes import Page, nodes

#: Pages whose runs of text are used in composed pages, at most, and characters of one of them.
SAMPLE, SAMPLE_CHARS = 256, 1 << 16
#: Composed pages that the trees learn from.
COMPOSED = 1000
TREES, DEPTH, BINS, RATE, LEAF = 40, 4, 32, 0.25, 20.0
#: Labelled nodes that a word's log-odds are shrunk by.
PRIOR = 4.0
#: Log-odds count up to this; each node gets LEAN on top, as a lost paragraph is worse than one too many.
SURE, LEAN = 6.0, 1.25

#: Parts of composed pages: what their elements are called. Fixed values.
NAMES = {
    "main": "article content post entry story main body text blog news single page-content article-body post-content entry-content story-body main-content articleBody markdown prose".split(),
    "wrap": "wrapper container page site layout row inner outer wrap col column grid region section block root app shell".split(),
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu tabs pagination pager toc links skip".split(),
    "head": "header masthead top topbar branding logo banner site-header toolbar hero search login".split(),
    "foot": "footer bottom colophon copyright legal site-footer credits imprint contact".split(),
    "side": "sidebar aside widget related recommended rail secondary popular trending archive tags categories most-read more".split(),
    "notice": "cookie consent notice banner gdpr modal popup overlay alert message subscribe newsletter signup paywall promo privacy".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo banner adsense adbox adslot commercial partner".split(),
    "form": "form search login signup subscribe newsletter contact poll survey".split(),
    "comment": "comments comment respond discussion replies reply feedback disqus thread reader".split(),
    "byline": "byline author date posted meta dateline time info".split(),
    "share": "share social sharing follow buttons like tweet tools print meta".split(),
}
#: Elements that a part may be.
ELEMENTS = {
    "main": "article article article main main div div section", "menu": "nav div ul", "head": "header div", "foot": "footer div", "side": "aside div section", "notice": "div section aside dialog", "advert": "div aside section ins",
    "form": "form div", "comment": "div section ol ul", "share": "div ul section", "wrap": "div section",
}


class Composer:
    """Seeded pages with labelled parts: elements of main text bear data-y="1", the parts in it that are not, data-y="0"."""

    def __init__(self, seed: int, runs: Sequence[str]):
        self.rng, self.runs = random.Random(seed), [r.split() for r in runs]

    def words(self, least: int, most: int) -> str:
        """A stretch of a run of the sample, or, where it is too small, of made-up words."""
        rng, n = self.rng, self.rng.randint(least, most)
        run = rng.choice(self.runs) if len(self.runs) >= 20 and rng.random() < 0.8 else []
        if len(run) < n:
            run = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) + rng.choice(["", "", "", "", ",", "."]) for _ in range(n)]
        at = rng.randint(0, len(run) - n)
        return html.escape(" ".join(run[at : at + n]), quote=False)

    def prose(self) -> str:
        """A paragraph's words: mostly some sentences, at times one word."""
        return self.words(1, 4) if self.rng.random() < 0.12 else self.words(3, 12) if self.rng.random() < 0.2 else self.words(12, 140)

    def named(self, part: str) -> str:
        """Attributes of a part: mostly names that tell what it is, at times others or none."""
        rng = self.rng
        if rng.random() < 0.2:
            return "" if rng.random() < 0.5 else f' class="{"".join(rng.choices("abcdefghkmz", k=rng.randint(1, 8)))}"'
        name = rng.choice(NAMES[part])
        name += rng.choice(["", "", "", "-1", "-inner", "-wrap", "_box", " " + rng.choice(NAMES["wrap"]), " " + rng.choice(NAMES[part])])
        return f' {rng.choice(["class", "class", "class", "id"])}="{name}"'

    def element(self, part: str, inside: str, truth: str = "", bare: float = 0.15) -> str:
        tag = self.rng.choice(ELEMENTS[part].split())
        names = "" if self.rng.random() < bare and tag not in ("div", "section") else self.named(part)
        return f"<{tag}{names}{truth}>{inside}</{tag}>"

    def linked(self, text: str) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{text}</a>'

    def links(self, least: int, most: int) -> str:
        rng = self.rng
        one = [self.linked(self.words(1, rng.choice([2, 3, 9]))) for _ in range(rng.randint(least, most))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in one) + "</ul>" if rng.random() < 0.7 else rng.choice([" ", " | ", ""]).join(one)

    def paragraph(self) -> str:
        """A paragraph, often left open, in parts emphasised or linked."""
        rng, text = self.rng, self.prose()
        if rng.random() < 0.15:
            text = rng.choice(["<b>", "<strong>", "<em>", "<span>"]) + text
        if rng.random() < 0.2:
            text += " " + self.linked(self.words(1, 5)) + " " + self.words(1, 20)
        if rng.random() < 0.1:
            text += "<br>" + (self.words(3, 30) if rng.random() < 0.5 else "")
        return f"<p>{text}" + ("</p>" if rng.random() < 0.75 else "")

    def article(self) -> str:
        rng, made = self.rng, []
        if rng.random() < 0.8:
            title, by = f"<h1>{self.words(2, 14)}</h1>", f'<{(t := rng.choice(["p", "div"]))} class="{rng.choice(NAMES["byline"])}" data-y="0">{self.words(2, 8)}</{t}>' if rng.random() < 0.3 else ""
            made.append(f"<header>{title}{by}</header>" if rng.random() < 0.25 else title + by)
        flat = rng.random() < 0.15  # blocks that are divisions rather than paragraphs
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 20])):
            kind = rng.random()
            if kind < 0.72:
                made.append(f"<div>{self.prose()}</div>" if flat else self.paragraph())
            elif kind < 0.8:
                made.append(f"<h{rng.randint(2, 4)}>{self.words(1, 8)}</h2>")
            elif kind < 0.85:
                made.append(f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{self.words(1, 25)}" for _ in range(rng.randint(2, 7))) + f"</{t}>")
            elif kind < 0.88:
                made.append(f"<blockquote>{self.paragraph()}</blockquote>")
            elif kind < 0.9:
                made.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}<td>{self.words(1, 4)}" for _ in range(rng.randint(2, 5))) + "</table>")
            elif kind < 0.92:
                made.append(f"<pre>{self.words(4, 30)}</pre>")
            elif kind < 0.94:
                made.append(f"<figure><img src=x><figcaption>{self.words(3, 15)}</figcaption></figure>")
            else:
                made.append(self.aside(rng.choice(["advert", "share", "side", "form", "notice"])))
        return self.nested("".join(made), "main")

    def nested(self, inside: str, part: str) -> str:
        for _ in range(self.rng.choice([0, 0, 0, 1, 2])):
            inside = f"<div{self.named('wrap')}>{inside}</div>"
        return inside

    def aside(self, part: str) -> str:
        """A part that isn't main text, wherever it stands."""
        rng = self.rng
        said = lambda: "".join(f"<p>{self.words(3, 40)}</p>" for _ in range(rng.randint(1, 3))) if rng.random() < 0.5 else self.words(2, 40)
        if part == "menu" or part == "share":
            inside = self.links(2, 12)
        elif part == "head":
            inside = rng.choice(["", f"<h1>{self.words(1, 4)}</h1>"]) + self.words(0, 8) + (self.links(2, 8) if rng.random() < 0.5 else "")
        elif part == "foot":
            inside = "&copy; " + self.words(1, 20) + (self.links(2, 10) if rng.random() < 0.5 else "") + (self.paragraph() if rng.random() < 0.3 else "")
        elif part == "side":
            inside = "".join(f"<div{self.named('side')}><h3>{self.words(1, 4)}</h3>{self.links(3, 9) if rng.random() < 0.6 else said()}</div>" for _ in range(rng.randint(1, 3)))
        elif part == "comment":
            tag = rng.choice(["div", "div", "div", "li", "li", "li", "article", "section"])
            one = lambda: f"<{tag}{self.named('comment')}>{self.linked(self.words(1, 2)) if rng.random() < 0.6 else self.words(1, 3)} <p>{self.words(2, 60)}</p></{tag}>"
            inside = f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 8)))
        elif part == "form":
            inside = f"<label>{self.words(1, 5)}</label><input><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button>" + (said() if rng.random() < 0.4 else "")
        else:
            inside = said() + (self.linked(self.words(1, 3)) if rng.random() < 0.5 else "") + (f"<button>{self.words(1, 2)}</button>" if part == "notice" and rng.random() < 0.6 else "")
        return self.element(part, self.nested(inside, part), ' data-y="0"')

    def page(self) -> str:
        rng = self.rng
        before = [self.aside(p) for p, chance in (("notice", 0.3), ("head", 0.6), ("menu", 0.7), ("advert", 0.5), ("menu", 0.3)) if rng.random() < chance]
        after = [self.aside(p) for p, chance in (("share", 0.3), ("side", 0.4), ("comment", 0.4), ("advert", 0.3), ("foot", 0.8), ("notice", 0.2)) if rng.random() < chance]
        if rng.random() < 0.4:
            before.append(self.aside("side"))
        main = self.element("main", self.article(), ' data-y="1"', 0.4) if rng.random() < 0.97 else ""
        inner = main
        if rng.random() < 0.5:  # some parts stand beside the main text in an element of their own
            k = rng.randint(0, len(after))
            inner, after = self.nested(main + "".join(after[:k]), "wrap"), after[k:]
            inner = f"<div{self.named('wrap')}>{inner}</div>"
        return f"<html><head><title>{self.words(1, 9)}</title><script>x('<p>')</script></head><body>{self.nested(''.join(before) + inner + ''.join(after), 'wrap')}"


def compose(n: int, runs: Sequence[str], seed: int = 12) -> list[Page]:
    """``n`` composed pages' nodes, with truths."""
    composer = Composer(seed, runs)
    return [nodes(composer.page()) for _ in range(n)]


def _words_of(page: Page, node: int) -> tuple[str, ...]:
    return (f"<{page.tags[node]}>", *page.words[node])


@dataclass
class Model:
    #: Log-odds of the words of tags and attributes.
    words: dict[str, float]
    trees: boosting.Trees
    second: boosting.Trees

    def extract(self, pages: Sequence[Page]) -> list[str]:
        if not pages:
            return []
        x = features(pages, self.words)
        odds = np.clip(self.second.margin(around(pages, x, self.trees.margin(x))), -SURE, SURE) + LEAN
        odds = odds.tolist()
        out, first = [], 0
        for page in pages:
            out.append(decode(page, odds[first : first + len(page.tags)]))
            first += len(page.tags)
        return out


def decode(page: Page, odds: list[float]) -> str:
    """The texts of the runs kept, in page order.

    Of all choices of nodes in which none is kept below one that isn't, and none without a run kept below it, that of the greatest sum of log-odds.
    """
    n, parents = len(odds), page.parents
    gain, best, forced = [0.0] * n, [-math.inf] * n, [0] * n  # of what is below: the positive values' sum; the greatest value, and whose
    for i in range(n - 1, 0, -1):
        value = odds[i] if page.texts[i] else odds[i] + (gain[i] or best[i])
        p = parents[i]
        if value > 0:
            gain[p] += value
        if value >= best[p]:
            best[p], forced[p] = value, i
        odds[i] = value
    kept, texts = [True] * n, []
    for i in range(1, n):
        p = parents[i]
        kept[i] = kept[p] and (odds[i] > 0 or (p > 0 and not gain[p] and forced[p] == i))
        if kept[i] and page.texts[i]:
            texts.append(page.texts[i])
    return "\n".join(texts)


def features(pages: Sequence[Page], odds: dict[str, float]) -> np.ndarray:
    """A row per node of all pages."""
    sizes = np.array([len(p.tags) for p in pages])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = int(sizes.sum())
    flat = lambda name: [x for p in pages for x in getattr(p, name)]
    parent = np.maximum(np.array(flat("parents")), 0) + first
    end = np.array(flat("ends")) + first
    depth = np.array(flat("depths"))
    texts, tags = flat("texts"), flat("tags")
    chars = np.array([len(t) for t in texts], float)
    run = np.array([t == "#" for t in tags])
    at = np.flatnonzero(run)
    stops = np.zeros(n)
    stops[at] = [t.count(".") + t.count(",") + t.count(";") + t.count("?") + t.count("!") for t in (texts[i] for i in at)]
    tag = np.array([odds.get(f"<{t}>", 0.0) for t in tags])
    named = [[odds[w] for w in ws if w in odds] if ws else () for ws in flat("words")]
    low = np.array([min(x) if x else 0.0 for x in named])
    high = np.array([max(x) if x else 0.0 for x in named])
    # Along the path from the page: the lowest, the highest and the nearest name, and the lowest and highest tag.
    path_low, path_high, path_tag, path_top, near = low.copy(), high.copy(), tag.copy(), tag.copy(), low + high
    for i, (p, is_page) in enumerate(zip(parent.tolist(), (depth == 0).tolist(), strict=True)):
        if is_page:
            continue
        if path_low[p] < path_low[i]:
            path_low[i] = path_low[p]
        if path_high[p] > path_high[i]:
            path_high[i] = path_high[p]
        if path_tag[p] < path_tag[i]:
            path_tag[i] = path_tag[p]
        if path_top[p] > path_top[i]:
            path_top[i] = path_top[p]
        if not near[i]:
            near[i] = near[p]
    below = lambda x: (s := np.concatenate([[0.0], np.cumsum(x)]))[end] - s[np.arange(n)]
    text, links, runs, marks = below(chars), below(np.array(flat("links"), float)), below(run.astype(float)), below(stops)
    count = end - np.arange(n)
    long = below(chars * (chars > 80))
    paragraph = below(chars * np.array([tags[p] == "p" for p in parent.tolist()]))
    whole = text[first]
    before = (s := np.concatenate([[0.0], np.cumsum(chars)]))[np.arange(n)] - s[first]
    # Siblings: numbered by order below their parent.
    order = np.lexsort((np.arange(n), parent))
    own = order[depth[order] > 0]
    starts = np.concatenate([[True], parent[own][1:] != parent[own][:-1]]) if len(own) else np.zeros(0, bool)
    group = np.cumsum(starts) - 1
    begin = np.flatnonzero(starts)
    width = np.diff(np.append(begin, len(own)))
    place, among, alike = np.zeros(n), np.ones(n), np.ones(n)
    if len(own):
        place[own] = np.arange(len(own)) - begin[group]
        among[own] = width[group]
        kinds = np.unique(np.array(tags)[own], return_inverse=True)[1]
        _, back, same = np.unique(group * (kinds.max() + 1) + kinds, return_inverse=True, return_counts=True)
        alike[own] = same[back]
    ahead, behind = np.zeros(n), np.zeros(n)
    if len(own) > 1:
        joined = ~starts[1:]
        ahead[own[1:]] = np.where(joined, text[own[:-1]], 0)
        behind[own[:-1]] = np.where(joined, text[own[1:]], 0)
    # Text of the siblings of the same element that isn't in links.
    plain = np.bincount(parent, (text - links) * (depth > 0), n)[parent]
    share = lambda a, b: a / np.maximum(b, 1)
    log = np.log1p
    columns = [
        run, np.minimum(depth, 20), log(text), log(runs), log(count), share(text, count), share(links, text), share(text, runs), share(long, text), share(marks, text), share(paragraph, text),
        share(before, whole), share(whole - before - text, whole), share(text, whole), share(text, text[parent]), place / among, log(among), alike / among, log(ahead), log(behind), log(plain),
        share(links[parent], text[parent]), share(paragraph[parent], text[parent]), share(long[parent], text[parent]), share(marks[parent], text[parent]),
        tag, low, high, tag[parent], path_low, path_high, path_tag, path_top, near, log(chars),
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


def around(pages: Sequence[Page], x: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The features with the log-odds of the node, of those above it and beside it."""
    sizes = np.array([len(p.tags) for p in pages])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    parent = np.maximum(np.array([i for p in pages for i in p.parents]), 0) + first
    n, odds = len(parent), np.clip(odds, -SURE, SURE)
    inner = np.flatnonzero(parent != np.arange(n))
    weight = np.expm1(x[:, 2])  # characters
    among = lambda v: np.bincount(parent[inner], v[inner], n)
    total, held, least, count = among(weight * odds), among(weight), among(odds), among(np.ones(n))
    siblings = (total[parent] - weight * odds) / np.maximum(held[parent] - weight, 1)
    each = (least[parent] - odds) / np.maximum(count[parent] - 1, 1)
    order = inner[np.lexsort((inner, parent[inner]))]
    before, after = np.zeros(n), np.zeros(n)
    if len(order) > 1:
        same = parent[order[1:]] == parent[order[:-1]]
        before[order[1:]] = np.where(same, odds[order[:-1]], 0)
        after[order[:-1]] = np.where(same, odds[order[1:]], 0)
    above = parent[parent]
    return np.column_stack([x, odds, odds[parent], odds[above], odds[parent[above]], siblings, siblings[parent], each, each[parent], before, after, before[parent], after[parent]])


def truths(pages: Sequence[Page]) -> np.ndarray:
    """Of each node, whether main text is in it."""
    out = []
    for page in pages:
        found = [t == "1" and bool(x) for t, x in zip(page.truths, page.texts, strict=True)]
        for i in range(len(found) - 1, 0, -1):
            if found[i]:
                found[page.parents[i]] = True
        out += found
    return np.array(out, float)


def train(pages: Sequence[Page]) -> Model:
    """A model of pages with truths: one half for the words and the first trees, the other for the second."""
    one, other = pages[: len(pages) // 2], pages[len(pages) // 2 :]
    y, i = truths(one), 0
    seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for page in one:
        for node in range(len(page.tags)):
            for word in _words_of(page, node):
                seen[word][int(y[i])] += 1
            i += 1
    share = (y.mean() if len(y) else 0.5) * PRIOR
    words = {w: math.log((yes + share) / (no + PRIOR - share)) for w, (no, yes) in seen.items() if no + yes >= 4}
    trees = boosting.grow(features(one, words), y, TREES, DEPTH, BINS, RATE, LEAF)
    x = features(other, words)
    return Model(words, trees, boosting.grow(around(other, x, trees.margin(x)), truths(other), TREES, DEPTH, BINS, RATE, LEAF))


def sampled_runs(pages: DataFrame, id_col: str, html_col: str) -> list[str]:
    """Runs of text of up to SAMPLE pages, those whose ids have the smallest hashes; only ids are ordered."""
    rows = pages.select(F.xxhash64(id_col).alias("h"), F.col(html_col).alias("html")).filter(f"length(html) <= {SAMPLE_CHARS}")
    few = F.broadcast(rows.select("h").distinct().orderBy("h").limit(SAMPLE))
    # Of pages that share an id the first in order, so that the sample doesn't depend on how rows are dealt.
    found = sorted(r.html for r in rows.join(few, "h", "left_semi").groupBy("h").agg(F.min("html").alias("html")).collect())
    return [t for source in found for t in nodes(source).texts if t]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Model:
    """A model learned from composed pages, whose texts are those of a bounded sample of the given ones."""
    return train(compose(COMPOSED, sampled_runs(pages, id_col, html_col)))


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(pages, id_col, html_col))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = string_buffers(batch.column(2))
            for a, b in blocks(at):
                texts = shared.value.extract([nodes(data[at[i] : at[i + 1]].tobytes().decode()) for i in range(a, b)])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
