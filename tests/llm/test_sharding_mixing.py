import itertools
import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigspark.llm import mixing, sharding

from .conftest import odd_texts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards_of_odd_rows(odd, empty):
    rows = sharding.shard(odd, 8).collect()
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in odd_texts())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)
    assert sharding.shard(empty, 8).collect() == []


def test_places_can_be_computed_and_dont_depend_on_layout(odd):
    numbered = sharding.numbered(odd).collect()
    places = {(r.id, r.text_crc32): sharding.permute(r.row_number, r.n_rows, 20) for r in numbered if r.id is not None and r.id != 12}
    for layout in (odd, odd.repartition(7)):
        for r in sharding.shard(layout, 8).collect():
            if (r.doc_id, r.text_crc32) in places:
                assert r.slot * 8 + r.shard == places[r.doc_id, r.text_crc32]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.integers(0, 1000))
def test_permutation_is_one_to_one(n, seed):
    assert sorted(sharding.permute(i, n, seed) for i in range(n)) == list(range(n))


def test_native_plan(odd):
    plan = sharding.shard(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_targets():
    got = mixing.source_targets([("b", 100), (None, 10), ("a", 10), ("c", 1000)], (5, 2, 1), 1.5)
    assert got["a"] == 20 and got["b"] == 200 and got[None] == 20 and abs(sum(got.values()) - 1680) < 1e-6
    assert mixing.source_targets([("a", 0)], (5,), 1.5) == {"a": 0.0}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 120))
def test_knapsack_is_the_best_fit(counts, budget):
    lengths = sorted(counts, reverse=True)
    taken, best = mixing.knapsack(lengths, [counts[x] for x in lengths], budget)
    assert best
    assert all(0 <= t <= counts[x] for t, x in zip(taken, lengths, strict=True))
    reach = {0}
    for x in lengths:
        reach = {r + x * k for r in reach for k in range(counts[x] + 1)}
    assert sum(t * x for t, x in zip(taken, lengths, strict=True)) == max(r for r in reach if r <= budget)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(3000, 20_000), st.integers(1, 3), min_size=1, max_size=5), st.floats(0.02, 0.98))
def test_fit_of_few_long_documents(counts, share):
    lengths = sorted(counts, reverse=True)
    budget = int(share * sum(x * n for x, n in counts.items()))
    taken = mixing.fit_lengths(lengths, [counts[x] for x in lengths], budget)
    assert all(0 <= t <= counts[x] for t, x in zip(taken, lengths, strict=True))
    reach = {0}
    for x in lengths:
        reach = {r + x * k for r in reach for k in range(counts[x] + 1)}
    assert sum(t * x for t, x in zip(taken, lengths, strict=True)) == max(r for r in reach if r <= budget)


def test_fit_of_an_example_that_needs_the_whole_program():
    assert sum(a * b for a, b in zip([11931, 10595, 10328, 9547], mixing.fit_lengths([11931, 10595, 10328, 9547], [2, 3, 3, 3], 21267), strict=True)) == 21190


def test_fit_of_budgets_over_the_program_s_sums(monkeypatch):
    monkeypatch.setattr(mixing, "CELLS", 1 << 10)
    lengths = [9001, 7013, 5003, 3001, 997, 211]
    for budget in (99_991, 800_117, 5_000_011):
        taken = mixing.fit_lengths(lengths, [400] * 6, budget)
        assert all(0 <= t <= 400 for t in taken)
        assert 0 <= budget - sum(a * b for a, b in zip(lengths, taken, strict=True)) < 211


def test_fit_of_many_lengths():
    lengths = list(range(3000, 0, -1))
    counts = [1 + x % 3 for x in lengths]
    for budget in (17, 123_457, 4_000_001):
        taken = mixing.fit_lengths(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        assert sum(t * x for t, x in zip(taken, lengths, strict=True)) == budget


def test_mix_of_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((i, len(WORDS.findall(t or ""))) for i, t in odd_texts())
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert {r.source_size for r in own} == {sum(r["size"] for r in own)}
        taken, target = sum(r.times * r["size"] for r in own), own[0].target
        assert all(0 <= r.times <= 2 for r in own) and taken <= target + 1
        # What is left is less than one document that wasn't taken another time.
        spare = [r["size"] for r in own if r["size"] and r.times < -(-target // max(1, own[0].source_size))]
        assert target - taken < min(spare, default=1) + 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd.repartition(5)).collect()))
    assert mixing.mix(empty).collect() == []


def test_hot_length_is_dealt_by_cells(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("five words in each text").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    taken = mixing.mix(rows, weights=(1, 3), share=0.5).groupBy("source").agg(F.sum(F.col("times") * F.col("size")).alias("n"), F.max("target").alias("t")).collect()
    assert all(abs(r.n - r.t) < 6 for r in taken)


def test_large_budgets_are_closed_to_the_word():
    """Sums far beyond what one pass tells apart: lengths over 100,000 words."""
    lengths, counts = [999_999, 777_777, 555_554], [10**6] * 3
    taken = mixing.fit_lengths(lengths, counts, 10**12 + 7)
    assert sum(a * b for a, b in zip(lengths, taken, strict=True)) == 10**12 + 7 and all(0 <= a <= b for a, b in zip(taken, counts, strict=True))
    rng = random.Random(6)
    for _ in range(6):
        lengths = sorted({rng.randint(10**5, 3 * 10**6) for _ in range(rng.randint(2, 6))}, reverse=True)
        counts = [rng.randint(50, 10**5) for _ in lengths]
        budget = sum(a * b for a, b in zip(lengths, counts, strict=True)) // rng.randint(2, 5)
        taken = mixing.fit_lengths(lengths, counts, budget)
        assert all(0 <= a <= b for a, b in zip(taken, counts, strict=True))
        assert 0 <= budget - sum(a * b for a, b in zip(lengths, taken, strict=True)) < 1000


def test_few_long_documents_equal_brute_force():
    rng = random.Random(7)
    for _ in range(20):
        lengths = sorted({rng.randint(10**5, 3 * 10**6) for _ in range(rng.randint(1, 4))}, reverse=True)
        counts = [rng.randint(1, 6) for _ in lengths]
        budget = rng.randint(1, sum(a * b for a, b in zip(lengths, counts, strict=True)))
        best = max(s for c in itertools.product(*[range(c + 1) for c in counts]) if (s := sum(a * b for a, b in zip(lengths, c, strict=True))) <= budget)
        taken = mixing.fit_lengths(lengths, counts, budget)
        assert all(0 <= a <= b for a, b in zip(taken, counts, strict=True)) and sum(a * b for a, b in zip(lengths, taken, strict=True)) == best
