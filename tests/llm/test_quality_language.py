import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm import language_id, quality

from .conftest import odd_texts, words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORDS.findall(text)
    at, covered = {}, set()
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    for own in at.values():
        if len(own) > 1:
            covered.update(j for i in own for j in range(i, i + 5))
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(100, 140)] + [(140, 0, 0), (141, 1, 1), (None, 1, 0), (100, 1, None)], "doc_id long, quality int, toxic int")


def test_base_counts_of_odd_rows(odd, empty, labels):
    rows = quality.judge(odd, labels).collect()
    assert Counter((r.doc_id, *[r[c] for c in BASE]) for r in rows) == Counter((i, *base(t)) for i, t in odd_texts())
    assert all(not r.kept for r in rows if r.base_failed)
    assert "x0" in {r["size"] for r in rows}  # other columns are carried
    assert quality.judge(empty, labels).collect() == []
    assert all(r.kept != r.base_failed and r.llr_score == 0 for r in quality.judge(odd, labels.limit(0)).collect())


def test_score_against_brute_force(odd, labels, spark):
    """Buckets come from Spark's own hash; counts, weights, scores and the threshold are recounted in Python."""
    half = {r[0]: r[1] for r in quality.trusted_ids(labels).collect()}
    assert set(half) == set(range(100, 140)) and 5 < sum(half.values()) < 35
    trusted = {i for i, counted in half.items() if counted}
    grams = quality._tokens(odd, "text").select("doc_id", quality._grams().alias("g")).collect()
    raw, target = Counter(), Counter()
    for r in grams:
        raw.update(r.g)
        target.update(r.g if r.doc_id in trusted else ())
    n, m = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    weight = {b: math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in range(quality.BUCKETS)}
    score = {r.doc_id: sum(weight[b] for b in r.g) / (len(r.g) + quality.NEUTRAL) for r in grams if r.doc_id is not None}
    own = [score[i] for i in half if i not in trusted]
    low, middle = np.percentile(own, 1), np.percentile(own, 50)
    for r in quality.judge(odd, labels).collect():
        if r.doc_id is not None:
            assert r.llr_score == pytest.approx(score[r.doc_id], abs=1e-6)
            assert r.kept == (not r.base_failed and score[r.doc_id] >= low - quality.SLACK * (middle - low))
    assert sum(len(WORDS.findall(t or "")) + max(0, len(WORDS.findall(t or "")) - 1) for _, t in odd_texts()) == sum(raw.values())


def test_all_trusted_documents_count(spark, odd, labels, monkeypatch):
    many = spark.range(50_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    half = quality.trusted_ids(many).groupBy("_counted").count().collect()
    assert sum(r["count"] for r in half) == 50_000 and all(24_000 < r["count"] < 26_000 for r in half)
    rows = lambda: sorted(map(str, quality.judge(odd, labels).drop("size").collect()))
    broadcast = rows()
    monkeypatch.setattr(quality, "BROADCAST", 0)
    assert rows() == broadcast


def test_ranks_are_exact(spark):
    values = spark.range(9000).select((F.pmod(F.xxhash64("id"), F.lit(700)) / 997 - 0.3).alias("v"))
    found = sorted(r.v for r in values.collect())
    ranks = [0, 89, 90, 4499, 4500, 8999]
    assert quality._at_ranks(values, ranks) == [found[k] for k in ranks]


def test_native_plan_and_filter_barrier(odd, labels):
    kept = quality.judge(odd, labels).filter("kept")
    assert not re.search("Python|Pandas|Arrow", kept._jdf.queryExecution().executedPlan().toString())
    assert kept.count() == sum(r.kept for r in quality.judge(odd, labels).collect())


def test_junk_is_rejected_and_prose_kept(spark):
    rng = random.Random(1)
    vocabulary, symbols = words(rng, 300).split(), ["".join(rng.choices("#$%&!?", k=4)) for _ in range(40)]
    prose = [(i, " ".join(rng.choices(vocabulary, range(300, 0, -1), k=150))) for i in range(300)]
    junk = [(1000 + i, " ".join(rng.choices(symbols, k=60))) for i in range(30)]
    docs = spark.createDataFrame(prose + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.judge(docs, labels).filter("kept").collect()}
    assert kept == {i for i, _ in prose}


def test_labelled_junk_is_rejected_and_held_out_documents_kept(spark):
    """Words with symbols, tables, doubled words: whatever is labelled poor in the given documents."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    own = {r[0]: r[1] for r in quality.trusted_ids(labels).collect()}
    rows = [r for r in quality.judge(docs, labels).collect() if not r.base_failed]
    poor = {r.doc_id for r in labels.filter("quality = 0").collect()}
    assert sum(r.doc_id in poor for r in rows) > 20 and not [r.doc_id for r in rows if r.kept and r.doc_id in poor]
    held_out = [r.kept for r in rows if own.get(r.doc_id) is False]
    assert len(held_out) > 100 and sum(held_out) >= 0.98 * len(held_out)


ALPHABETS = {"aa": "abcdefg", "bb": "efghijk", "cc": "ijklmab"}


def made(spark, n=400):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(5, 60), ALPHABETS[k]), k) for i, k in enumerate(rng.choices(sorted(ALPHABETS), k=n))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_of_held_out_documents(spark):
    docs = made(spark)
    model = language_id.fit(language_id.learnable(docs))
    rows = language_id.predict(docs.filter(language_id.held_out()), model).collect()
    assert len(rows) > 50 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    again = language_id.fit(language_id.learnable(docs.repartition(7)))
    assert (again.embedding == model.embedding).all() and (again.output == model.output).all() and again.reject_below == model.reject_below
    far = spark.createDataFrame([(1, "漢字漢字 " * 20, "xx")], "doc_id long, text string, lang string")
    assert language_id.predict(far, model).first().score < np.median([r.score for r in rows])


def test_scores_equal_the_mean_embedding_read_text_by_text(spark):
    model = language_id.fit(made(spark))
    texts = [t or "" for _, t in odd_texts()]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    got = model.scores(data, np.cumsum([0, *[len(t.encode()) for t in texts]]))
    for t, p in zip(texts, got, strict=True):
        index = language_id.subwords(np.frombuffer(t.encode(), np.uint8))
        z = (model.embedding[index].astype(float).mean(axis=0) @ model.output if len(index) else 0) + model.bias
        e = np.exp((z - z.max()) / model.temperature)
        assert p == pytest.approx(e / e.sum(), abs=1e-4)


def many_languages(spark, n):
    """n languages of letters of their own, the first with 400 rows and the others with three."""
    rows = [(400 * k + i, " ".join(chr(0x4E00 + 40 * k + (7 * i + j * j) % 40) * 3 for j in range(12)), f"l{k:03}") for k in range(n) for i in range(3 if k else 400)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 60)
    docs = many_languages(spark, 30)
    model = language_id.fit(docs)
    assert len(model.languages) == 30 and not model.few
    rows = language_id.predict(docs, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.9
    text = next(r.text for r in rows if r.lang == "l007")
    index = language_id.subwords(np.frombuffer(text.encode(), np.uint8))
    z = model.embedding[index].astype(float).mean(axis=0) @ model.output + model.bias
    e = np.exp((z - z.max()) / model.temperature)
    assert model.scores(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0] == pytest.approx(e / e.sum(), abs=1e-4)


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(language_id, "BYTES", 6 * 2000)
    assert len(language_id.fit(many_languages(spark, 12)).languages) == 12  # their first rows come first


def test_repeated_ids_and_rows_do_not_matter(spark):
    docs = many_languages(spark, 3)
    same = docs.withColumn("doc_id", F.lit(7))
    one, two = language_id.fit(same.union(docs)), language_id.fit(docs.union(same).union(docs).repartition(5))
    assert (one.embedding == two.embedding).all() and one.reject_below == two.reject_below


def test_predictions_of_odd_rows(odd, empty):
    model = language_id.fit(language_id.learnable(odd))
    assert model.languages == ["en", "fr"]
    rows = language_id.predict(odd, model).collect()
    assert len(rows) == len(odd_texts())
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and r.rejected >= (not letters) and (r.score == 0) == (not letters)
    assert language_id.predict(empty, model).collect() == [] and language_id.fit(empty) is None
    assert {(r.lang_pred, r.rejected) for r in language_id.predict(odd, None).collect()} == {("und", True)}
    assert language_id.fit(odd.withColumn("lang", F.lit("one"))).languages == ["one"]
