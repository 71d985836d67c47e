import random
import re
from collections import Counter

import numpy as np

from sigspark.llm import bytetext, components, near_dedup
from sigspark.llm.lineage import Tables

from .conftest import odd_texts, words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(doc_id, n, component) of each row, by all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        low[r] = i if low.get(r) is None else min(low[r], low[r] if i is None else i)
    return Counter((i, len(sets[k]), low[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows))


def found(df):
    rows = near_dedup.near_duplicates(df).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)


def test_odd_rows(odd, empty):
    assert found(odd) == brute(odd_texts())
    assert near_dedup.near_duplicates(empty).collect() == []


def family(rng, n, length, most):
    """Texts that differ from a base in up to ``most`` words."""
    base = words(rng, length).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, most)):
            own[rng.randrange(length)] = "".join(rng.choices("klmnop", k=6))
        out.append(" ".join(own))
    return out


def test_families_passages_and_chains(spark):
    rng = random.Random(5)
    texts = family(rng, 120, 150, 5) + family(rng, 40, 40, 1) + family(rng, 30, 700, 25)
    passage = words(rng, 60)
    texts += [f"{words(rng, rng.randint(5, 60))} {passage} {words(rng, rng.randint(5, 60))}" for _ in range(60)]
    chain = words(rng, 400).split()
    for i in range(12):  # each links with its neighbours only
        texts.append(" ".join(chain[i * 25 : i * 25 + 120]) if i % 2 else " ".join(chain[i * 12 : i * 12 + 130]))
    texts += [texts[0]] * 40 + [words(rng, 90) for _ in range(100)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    expected = brute(rows)
    assert len({c for _, _, c in expected}) < len(rows) - 100
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == expected


def test_percent_against_all_pairs(spark):
    """Texts whose similarities lie around the threshold, short and long ones."""
    rng = random.Random(9)
    texts = []
    for n, length in ((24, 24), (24, 40), (40, 110), (20, 400)):
        base = words(rng, length).split()
        for _ in range(n):
            tail = rng.randint(0, length // 6)
            texts.append(" ".join(base[: length - tail] + words(rng, tail).split()))
    sets = [shingles(t) for t in texts]
    for percent in (80, 90):
        root = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    low, high = sorted((root[a], root[b]))
                    root = [low if r == high else r for r in root]
        got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), percent=percent).collect()
        assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))
    assert [near_dedup._shared(p) for p in (85, 80)] == [15, 12] and [near_dedup._shared(p, 256) for p in (85, 80)] == [185, 169]


def test_keys_tell_sets_apart():
    a, b = np.array([1, 2, 3], np.uint64), np.array([1, 2, 4], np.uint64)
    assert near_dedup._key(a, a) != near_dedup._key(b, a) != near_dedup._key(b, b) and len(near_dedup._key(a, a)) == 16
    text = np.frombuffer(b"a b c d e f g a b c d e", np.uint8)
    (one, key), (none, empty) = near_dedup._sets(text, np.array([0, len(text), len(text)]))
    assert len(one) == 7 and len(key) == 16 and len(none) == 0 and empty == b""


def thue(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_whose_polynomial_hashes_are_equal(spark):
    """Words of two letters that agree in every polynomial hash modulo a power of two are different words."""
    for n in (64, 1024, 4096):
        data = np.frombuffer((thue(n, "ab") + thue(n, "ba")).encode(), np.uint8)
        for seed in (0, 1):
            one, two = bytetext.span_hashes(data, np.array([0, n]), np.array([n, 2 * n]), seed)
            assert one != two
    rows = [(1, thue(1024, "ab")), (2, thue(1024, "ba")), (3, thue(1024, "ab") + " x"), (4, thue(1024, "ba") + " x")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_word_hashes_tell_words_apart_and_forget_their_place():
    rng = random.Random(2)
    made = sorted({"".join(rng.choices("ab", k=rng.randint(1, 300))) for _ in range(3000)})
    for order in (made, made[::-1]):
        data = np.frombuffer(" ".join(order).encode(), np.uint8)
        starts, ends, _ = bytetext.word_spans(data, np.array([0, len(data)]))
        h = dict(zip(order, bytetext.span_hashes(data, starts, ends).tolist(), strict=True))
        assert len(set(h.values())) == len(made) and (order is made or h == first)
        first = h


def test_a_common_passage_and_a_star(spark, monkeypatch):
    """Texts that mostly consist of one passage but aren't linked, beside a family whose centre has many links; read with and without a broadcast."""
    rng = random.Random(12)
    passage = words(rng, 60)
    texts = [f"{passage} {words(rng, 25)}" for _ in range(120)] + family(rng, 300, 60, 1) + [words(rng, 400) + " " + passage for _ in range(20)]
    rows = list(enumerate(texts))
    expected = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs) == expected
    monkeypatch.setattr(near_dedup, "BROADCAST", 0)
    monkeypatch.setattr(near_dedup, "R", 48)  # sketches smaller than the sets
    assert found(docs) == expected


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(500, 500 + 1)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), Tables(spark)).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[501] == 500
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Tables(spark)).collect() == []
