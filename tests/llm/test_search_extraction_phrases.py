import html
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sigspark.llm import html_extraction, lexical_search, phrases
from sigspark.llm.page_nodes import nodes


def _lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _ranked(docs, items, k=10):
    """Search by its definition, over plain lists."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", _lower(t))
    terms = [(i, Counter(split(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        wanted = {t for i, text in items if i == item for t in split(text)}
        scores = []
        for doc, c in terms:
            m = 10 + 90 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score:
                scores.append((-score, doc is None, doc, score))
        out += [(item, rank, x[2], x[3]) for rank, x in enumerate(sorted(scores, key=lambda x: x[:3] if x[2] is not None else (*x[:2], 0))[:k], 1)]
    return out


def _items(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in texts], "item_id long, text string, term string")


def test_search_equals_brute_force_over_odd_texts(spark, odd):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = [(0, "one ONE a b c"), (1, None), (2, ""), (3, "漢字 é ü x"), (4, docs[9][1]), (5, "nowhere-at-all"), (6, "a"), (6, "b c x"), (None, "a b"), (7, " ".join(t or "" for _, t in docs[-30:]))]
    got = lexical_search.rank_documents(odd, _items(spark, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == _ranked(docs, items)


def test_search_keeps_ties_and_common_terms(spark):
    """Terms in nearly every document are left out of the first join and must still decide; many copies tie at the tenth place."""
    rng = random.Random(5)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(400)]
    docs = [(i, " ".join(rng.sample(common, rng.randint(3, 6)) + rng.choices(rare, k=rng.randint(1, 12)))) for i in range(900)]
    docs += [(900 + i, docs[7][1]) for i in range(30)] + [(5, docs[5][1])]
    items = [(i, " ".join(rng.sample(common, 4) + rng.sample(rare, 5))) for i in range(20)] + [(20, " ".join(common)), (21, docs[7][1])]
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = lexical_search.rank_documents(made, _items(spark, items))
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == _ranked(docs, items)


def test_search_joins_what_is_too_large_to_broadcast(spark, odd, monkeypatch):
    monkeypatch.setattr(lexical_search, "ROWS", 0)
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = [(0, "a b c x y"), (1, docs[9][1])]
    got = lexical_search.rank_documents(odd, _items(spark, items))
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == _ranked(docs, items)


def test_search_of_nothing(spark, odd, empty):
    assert lexical_search.rank_documents(empty, _items(spark, [(1, "a")])).collect() == []
    assert lexical_search.rank_documents(odd, _items(spark, [])).collect() == []


def _mined(docs, most, least, top):
    f, words = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, most + 1):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 100 * a for q, b in candidates.items()):
                continue
            score, _, left, right = min((1000 * a * words[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), (lang, " ".join(p), a, left, right, words[lang], score)))
        out += [(x[3][0], i, *x[3][1:]) for i, x in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("most, least, top", [(5, 3, 2000), (5, 2, 7), (2, 2, 50), (3, 4, 50)])
def test_phrases_equal_brute_force(spark, odd, most, least, top):
    rng = random.Random(1)
    extra = [(rng.choice(["en", None, "fr"]), rng.choice(["New York city hall is", "a a a a a a", "x,y z. x y z\vq", "É à la carte; à la"]) + rng.choice(["", ".", " of the"])) for _ in range(120)]
    docs = odd.select("lang", "text", F.lit("q").alias("phrase"), F.lit(1).alias("f")).union(spark.createDataFrame([(*r, "q", 1) for r in extra], "lang string, text string, phrase string, f int"))
    got = phrases.mine(docs.repartition(4), most, least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == _mined([(r.lang, r.text) for r in docs.collect()], most, least, top)


def test_phrases_of_blocks_and_full_filters(spark, odd, monkeypatch):
    """Small blocks, and a filter that lets nearly everything through, change nothing."""
    want = sorted(tuple(r) for r in phrases.mine(odd, 4, 3, 100).collect())
    docs = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    assert want == _mined(docs, 4, 3, 100)
    monkeypatch.setattr(phrases.Frequent, "has", lambda self, hashes: hashes == hashes)
    assert sorted(tuple(r) for r in phrases.mine(odd, 4, 3, 100).collect()) == want


def test_phrases_of_nothing(empty):
    assert phrases.mine(empty).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no";</script></head><body><div id="cookie-notice">We use cookies. <button>OK</button></div>
<header class="site-header"><a href=/>Home</a><p>Site of news.</p></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><main><div class="post"><h1>Headline &amp; more</h1>
<p>First  paragraph has a good\n number of words, and it goes&nbsp;on for a while to be long.</p><p>Short.</p><div class="ad-slot">Buy now! Great offers.</div>
<p>Second &eacute; paragraph of the story, with <a href="x>y">a link</a> inside it<br>and a second line.<ul><li>one item<li>two item</ul></div></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=a>Another story here</a><li><a href=b>More stories there</a></ul></aside>
<section id="comments"><h3>2 comments</h3><div class="comment"><b>Joe</b><p>I think this is a great article, with many words in the comment, really.</p></div>
<form><label>Your comment</label><textarea>x</textarea><button>Send</button></form></section><div class="footer">Copyright 2020 <a href=i>Imprint</a></div></body></html>"""
TEXT = "Headline & more\nFirst paragraph has a good number of words, and it goes on for a while to be long.\nShort.\nSecond é paragraph of the story, with a link inside it and a second line.\none item\ntwo item"


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return html_extraction.fit(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_nodes_close_what_is_left_open():
    page = nodes("<div>a<p>b<p>c<ul><li>d<li>e</ul>f</div>g<table><tr><td>h<td>i<tr><td>j</table></b></div><!-- x --><p>k &lt; l<script>m</script>")
    assert [t for t in page.texts if t] == ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k < l"]
    parents = {page.texts[i]: page.tags[page.parents[i]] for i in range(len(page.tags)) if page.texts[i]}
    assert parents == {"a": "div", "b": "p", "c": "p", "d": "li", "e": "li", "f": "div", "g": "#page", "h": "td", "i": "td", "j": "td", "k < l": "p"}
    assert all(page.parents[i] < i < page.ends[i] <= page.ends[page.parents[i]] for i in range(1, len(page.tags)))


def test_pages_of_any_shape_take_linear_time():
    for source in ("<div>" * 60_000, "<p>x" * 60_000, "</div>" * 60_000, "<a b='" * 60_000, "<!--" * 60_000, "<li>a" * 60_000, "<" * 200_000, "<script>" * 60_000, "<td>" * 60_000, '<p class="' + "a " * 200_000 + '">x'):
        nodes(source)


def test_decoding_equals_all_choices():
    """Against every choice of nodes: none kept below one that isn't, none kept without a run kept below it."""
    rng = random.Random(2)
    for _ in range(60):
        page = nodes("".join(rng.choice(["<div>", "</div>", "x<div>", "<p>y", "z", "</p>"]) for _ in range(rng.randint(2, 9))))
        n = len(page.tags)
        page.texts = [f"{t}{i}" if t else "" for i, t in enumerate(page.texts)]
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        best = (0.0, [])
        for bits in range(1, 1 << (n - 1)):
            kept = [True, *(bool(bits >> i & 1) for i in range(n - 1))]
            if all(kept[page.parents[i]] for i in range(1, n) if kept[i]) and all(page.texts[i] or any(kept[j] and page.texts[j] for j in range(i, page.ends[i])) for i in range(1, n) if kept[i]):
                best = max(best, (sum(o for o, k in zip(odds[1:], kept[1:], strict=True) if k), [t for t, k in zip(page.texts, kept, strict=True) if k and t]))
        assert html_extraction.decode(page, list(odds)) == "\n".join(best[1])


def test_extraction_of_another_layout(model):
    assert model.extract([nodes(PAGE)]) == [TEXT]


def test_extraction_of_held_out_composed_pages(model):
    pages = html_extraction.compose(150, ["some words of a run that is long enough to be cut into parts"] * 30, seed=77)
    missed = extra = both = 0
    for page, text in zip(pages, model.extract(pages), strict=True):
        want = Counter(x for t, x in zip(page.truths, page.texts, strict=True) if t == "1" and x)
        got = Counter(text.split("\n")) if text else Counter()
        size = lambda c: sum(len(t) * n for t, n in c.items())
        missed, extra, both = missed + size(want - got), extra + size(got - want), both + size(got & want)
    assert both / (both + missed) > 0.97
    assert both / (both + extra) > 0.97


def _article(source):
    """What stands in the article element of the test tables' pages."""
    inner = re.search(r"<article>(.*?)(</article>|$)", source or "", re.S)
    blocks = re.split(r"</?(?:p|h1|article)>", inner[1]) if inner else []
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_extraction_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = html_extraction.extract(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    assert all(r.text == _article(r.html) and r.n_chars == len(r.text) for r in rows)


def test_extraction_of_odd_pages(spark, model):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (2, None, "", "x"), (None, "v", "<p>", "x"), (3, "w", "&amp", "x"), (4, "w", "<article>" + "<p>word and words, many of them. " * 30_000, "x"), (5, "w", PAGE, "x"), (5, "w", PAGE, "x")]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2), model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(((r.page_id, r.url, len(r.text)) for r in got.collect()), key=str)
    assert [x for x in found if x[0] in (1, 2, None)] == sorted([(1, "u", 0), (1, "u", 0), (2, None, 0), (None, "v", 0)], key=str)
    assert [x[2] for x in found if x[0] == 5] == [len(TEXT)] * 2
    assert [x[2] for x in found if x[0] == 4] == [len("word and words, many of them.\n") * 30_000 - 1]
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_sample_of_pages_does_not_depend_on_layout(spark, monkeypatch):
    monkeypatch.setattr(html_extraction, "SAMPLE", 5)
    rows = [(i % 9, f"<p>text {i} of page {i % 9}") for i in range(60)] + [(None, "<p>no id"), (3, None), (4, "x" * (html_extraction.SAMPLE_CHARS + 1))]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    one = html_extraction.sampled_runs(pages.coalesce(1), "page_id", "html")
    assert len(one) == 5 and one == html_extraction.sampled_runs(pages.orderBy(F.desc("html")).repartition(7), "page_id", "html")
