import math
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigspark.operators import mixture
from sigspark.operators.mixture import Settings, fit_batch

G0 = [120.1, 121.3, 123.9, 124.2, 119.8, 122.0, 123.1, 125.4, 124.8, 121.7, 122.9, 123.3, 120.9, 124.0, 122.4]
G1 = [112.3, 113.9, 111.8, 123.5, 112.9, 114.2, 110.7, 122.8, 113.3, 112.0, 111.5, 114.6, 113.0, 112.6, 124.1]
MEAN, SD = 123.83, 4.79


def _digamma(x):
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)


def scalar_fit(y, g, groups, m, s, rounds):
    """The same equations written with loops, for a fixed number of rounds."""
    tau = 1 / s**2
    p25, p50, p75 = np.percentile(y, (25, 50, 75))
    loc, lam, a, b = [m, p75 if m < p50 else p25], [1.0, 1.0], [tau, tau], [0.5 / tau] * 2
    conc = [[0.001, 0.001] for _ in range(groups)]
    for _ in range(rounds):
        z = []
        for v, k in zip(y, g):
            rho = []
            for c in (0, 1):
                et, el = a[c] / b[c], _digamma(a[c]) - math.log(b[c])
                lw = _digamma(conc[k][c]) - _digamma(sum(conc[k]))
                rho.append(0.5 * (el - math.log(2 * math.pi) - et * ((v - loc[c]) ** 2 + 1 / (lam[c] * et))) + lw)
            d = max(-500, min(500, rho[1] - rho[0]))
            z.append((1 / (1 + math.exp(d)), 1 - 1 / (1 + math.exp(d))))
        conc = [[0.001 + sum(q[c] for q, k in zip(z, g) if k == i) for c in (0, 1)] for i in range(groups)]
        for c in (0, 1):
            n = sum(q[c] for q in z)
            n = 0.0 if n < 1e-30 else n
            bar = sum(q[c] * v for q, v in zip(z, y)) / n if n else 0.0
            var = sum(q[c] * (v - bar) ** 2 for q, v in zip(z, y)) / n if n else 0.0
            lam[c], loc[c] = 1 + n, (n * bar + m) / (1 + n)
            a[c], b[c] = tau + n / 2, 0.5 / tau + 0.5 * (n * var + n / (1 + n) * (bar - m) ** 2)
    return loc, [x / w for x, w in zip(b, a)], conc


def one(y, g, groups, **kw):
    return fit_batch([np.array(y, float)], [np.array(g)], np.array([groups]), np.array([MEAN]), np.array([SD]), Settings(**kw))


def test_worked_example():
    got = one(G0 + G1, [0] * 15 + [1] * 15, 2)
    assert got["iterations"][0] == 18 and got["converged"][0]
    assert got["location"][0] == pytest.approx([122.726875, 115.439375], abs=1e-6)
    assert (got["beta"] / got["alpha"])[0] == pytest.approx([4.22872219, 25.85403596], rel=1e-7)
    w = got["concentration"][0]
    assert (w / w.sum(axis=1, keepdims=True))[:, 1] == pytest.approx([6.6657779e-05, 0.999933342], rel=1e-6)


groups = st.lists(st.tuples(st.floats(100, 140).map(lambda v: round(v, 1)), st.integers(0, 2)), min_size=4, max_size=40)


@settings(max_examples=30, deadline=None)
@given(groups)
def test_against_loops(rows):
    y, g = [r[0] for r in rows], [r[1] for r in rows]
    codes = sorted(set(g))
    g = [codes.index(x) for x in g]
    got = one(y, g, len(codes))
    loc, var, conc = scalar_fit(y, g, len(codes), MEAN, SD, int(got["iterations"][0]))
    assert got["location"][0] == pytest.approx(loc, rel=1e-6)
    assert (got["beta"] / got["alpha"])[0] == pytest.approx(var, rel=1e-6)
    assert got["concentration"][0] == pytest.approx(np.array(conc), rel=1e-5, abs=1e-8)
    assert got["counts"][0].sum(axis=1) == pytest.approx([g.count(i) for i in range(len(codes))])


@settings(max_examples=20, deadline=None)
@given(groups, st.randoms())
def test_order_of_rows_and_batch_dont_matter(rows, random):
    y, g = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    codes, g = np.unique(g, return_inverse=True)
    order = list(range(len(y)))
    random.shuffle(order)
    alone = one(y, g, len(codes))
    both = fit_batch([np.array(G0 + G1), y[order]], [np.array([0] * 15 + [1] * 15), g[order]], np.array([2, len(codes)]), np.array([MEAN] * 2), np.array([SD] * 2))
    assert both["location"][1] == pytest.approx(alone["location"][0], rel=1e-4)
    assert both["location"][0] == pytest.approx([122.726875, 115.439375], abs=1e-6)


@settings(max_examples=15, deadline=None)
@given(groups)
def test_bound_never_falls(rows):
    y, g = [r[0] for r in rows], [r[1] for r in rows]
    codes = sorted(set(g))
    g = [codes.index(x) for x in g]
    bounds = [one(y, g, len(codes), max_iters=n, stopping_criteria=-1.0)["elbo"][0] for n in range(2, 12)]
    assert all(b - a > -1e-6 * abs(a) for a, b in zip(bounds, bounds[1:]))


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Settings(max_iters=1)


def test_largest_batch_takes_few_megabytes():
    """A worker's memory follows the batch of the solver, not the rows that Spark hands over."""
    rng = np.random.default_rng(1)
    size = 512
    sites = mixture.BATCH // size
    y, code = [rng.normal(80, 2, size) for _ in range(sites)], [np.arange(size) % 4 for _ in range(sites)]
    tracemalloc.start()
    fit_batch(y, code, np.full(sites, 4), np.full(sites, 80.0), np.full(sites, 2.0), Settings(max_iters=3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6


def test_batches_of_one_frame_dont_matter(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [("G", p, "ACGTA", f"{c}-a", float(np.round(rng.normal(80 + (p % 3) * 5, 2), 1)), 80.0, 2.0) for p in range(30) for c in "AB" for _ in range(20)]
    seen = spark.createDataFrame(rows, "idx string, position long, kmer string, run string, norm_mean double, ref_mean double, ref_std double")
    packed = mixture.fingerprint(mixture.pack_sites(seen)).coalesce(1)
    whole = sorted(mixture.fit_sites(packed).collect())
    monkeypatch.setattr(mixture, "BATCH", 100)
    assert sorted(mixture.fit_sites(packed).collect()) == whole and len(whole) == 30
    saved = spark.createDataFrame(whole, mixture.fit_sites(packed).schema).withColumn("elbo", F.lit(1.0)).filter("position < 20").withColumn("digest", F.when(F.col("position") < 10, F.col("digest")).otherwise("x"))
    again = {r.position: r for r in mixture.fit_sites(mixture.from_saved(packed, saved)).collect()}
    assert len(again) == 30 and {p for p, r in again.items() if r.elbo == 1.0} == set(range(10))
    assert all(again[r.position] == r for r in whole if r.position >= 20)
