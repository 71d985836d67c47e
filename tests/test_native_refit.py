"""The native store's pruning, the samples' own reference signal, refitting from saved models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark import cli
from sigspark.operators import align, mixture
from sigspark.plans import diffmod
from sigspark.sources import readers, writers
from sigspark.sources.config import Method
from tests.test_sources import write_events


def test_native_store_prunes_buckets(spark, tmp_path):
    names = [f"id{i}" for i in range(200)]
    sites = spark.createDataFrame([(n, p, "ACGTA", [1.0, float(p)]) for n in names for p in range(3)], "idx string, position long, kmer string, y array<double>")
    path = f"{tmp_path}/sites"
    writers.write_sites_parquet(sites, str(tmp_path))
    assert sorted(map(tuple, readers.read_native(spark, path).collect())) == sorted(map(tuple, sites.collect()))
    scanned = lambda df: [p for p in df._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in p]
    some = readers.read_native(spark, path, ["id3", "id77", "missing"])
    assert sorted({r.idx for r in some.collect()}) == ["id3", "id77"]
    assert "bucket" in scanned(some)[0].split("PartitionFilters: [")[1].split("]")[0]
    files = some.select(F.input_file_name().alias("f")).distinct().collect()
    assert 0 < len({r.f.split("bucket=")[1].split("/")[0] for r in files}) <= 2
    table = spark.createDataFrame([("id5",), ("id5",), ("id6",), (None,)], "idx string")
    joined = readers.read_native(spark, path, table)
    assert sorted((r.idx, r.position) for r in joined.collect()) == [(i, p) for i in ("id5", "id6") for p in range(3)]
    assert "bucket" in scanned(joined)[0].split("PartitionFilters: [")[1].split("]")[0]
    read = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in read and "NestedLoop" not in read
    assert readers.read_native(spark, path, []).count() == 0


def test_commands_use_the_native_store(spark, tmp_path):
    write_events(tmp_path / "e.tsv")
    cli.main(["prep", "--events", str(tmp_path / "e.tsv"), "--out", f"{tmp_path}/o", "--native"], spark)
    whole = sorted(map(tuple, readers.read_site_store(spark, f"{tmp_path}/o/data.json").collect()))
    table = spark.createDataFrame([("T1.1",)], "idx string")
    for ids in (None, ["T1.1"], table):
        found = readers.read_store(spark, f"{tmp_path}/o", ids)
        assert sorted(map(tuple, found.collect())) == whole
        assert "parquet" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_own_reference_is_near_exact_quantiles(spark):
    rng = random.Random(4)
    rows = [(k, round(rng.gauss(80 + i, 2 + i), 3)) for i, k in enumerate(("AAAAA", "CCCCC", "GGGGG")) for _ in range(6000)] + [("TTTTT", 5.0), ("TTTTT", None)]
    frame = spark.createDataFrame(rows, "kmer string, norm_mean double").repartition(7)
    for accuracy in (100, 10_000):
        got = {r.kmer: r for r in align.own_reference(frame, accuracy=accuracy).collect()}
        for k in ("AAAAA", "CCCCC", "GGGGG"):
            values = np.sort([v for x, v in rows if x == k])
            for name, share in (("ref_mean", 0.5),):
                rank = np.searchsorted(values, got[k][name], "right")
                assert abs(rank - share * len(values)) <= len(values) / accuracy + 1
            exact = (np.quantile(values, 0.75) - np.quantile(values, 0.25)) / align.QUARTILES
            assert abs(got[k].ref_std - exact) < 0.2 * exact * (100 / accuracy) ** 0.5 + 1e-2
            assert got[k].n == 6000
        assert (got["TTTTT"].ref_mean, got["TTTTT"].ref_std, got["TTTTT"].n) == (5.0, 0.1, 1)
    assert align.own_reference(frame.limit(0)).count() == 0


def test_own_reference_is_exact_beyond_any_sketch(spark):
    rows = spark.range(120_000).select(F.when(F.col("id") % 3 > 0, "ACGTA").otherwise("CCCCC").alias("kmer"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e7 - 20).alias("norm_mean"))
    values = rows.toPandas().groupby("kmer").norm_mean.apply(lambda v: np.sort(v.to_numpy()))
    for got in align.own_reference(rows).collect():
        v = values[got.kmer]
        low, middle, high = (v[-(-k * len(v) // 4) - 1] for k in (1, 2, 3))
        assert (got.ref_mean, got.ref_std, got.n) == (middle, (high - low) / align.QUARTILES, len(v))
    odd = spark.createDataFrame([("A", float(x)) for x in ("nan", "inf", "-inf", 1, 1, 1, 1, 2)] + [("C", 7.5)], "kmer string, norm_mean double")
    assert sorted(map(tuple, align.own_reference(odd).collect())) == [("A", 1.0, pytest.approx(1 / align.QUARTILES), 8), ("C", 7.5, 0.1, 1)]


@pytest.fixture(scope="module")
def observations(spark):
    rng = random.Random(9)
    rows = [
        (c, f"{c}-{r}", "G", p, "ACGTA", round(rng.gauss(80 + (8 if c == "KO" and rng.random() < 0.6 else 0), 2), 1), i) for p in range(6) for c in ("KO", "WT") for r in ("a", "b") for i in range(30)
    ]
    return spark.createDataFrame(rows, "condition string, run string, idx string, position long, kmer string, norm_mean double, read_index long").cache()


RUNS = {"KO": ["KO-a", "KO-b"], "WT": ["WT-a", "WT-b"]}


FINE = Method(stopping_criteria=1e-10)


def test_unchanged_sites_keep_their_models_and_changed_ones_begin_with_them(spark, observations, tmp_path):
    reference = spark.createDataFrame([("ACGTA", 80.0, 2.0)], "kmer string, ref_mean double, ref_std double")
    fewer = observations.filter("position < 3 or read_index < 25")
    writers.write_models(diffmod.fit(fewer, reference, RUNS, method=FINE), f"{tmp_path}/m")
    saved = readers.read_models(spark, f"{tmp_path}/m")
    same = {r.position: r for r in diffmod.fit(fewer, reference, RUNS, method=FINE, models=saved).collect()}
    assert same == {r.position: r for r in saved.collect()} and len(same) == 6
    fresh = {r.position: r for r in diffmod.fit(observations, reference, RUNS, method=FINE).collect()}
    again = {r.position: r for r in diffmod.fit(observations, reference, RUNS, method=FINE, models=saved).collect()}
    for p in range(6):
        if p < 3:
            assert again[p] == same[p]
        else:
            assert again[p].iterations < fresh[p].iterations and again[p].digest == fresh[p].digest
            assert np.allclose(again[p].mu, fresh[p].mu, atol=0.05) and np.allclose(again[p].weights, fresh[p].weights, atol=0.02)
            assert again[p].elbo >= fresh[p].elbo - 1e-4 * abs(fresh[p].elbo)
    # Other settings or another reference fit anew; sites without a saved model and groups that it doesn't know are fitted.
    other = reference.withColumn("ref_mean", F.lit(81.0))
    assert {r.digest for r in diffmod.fit(fewer, other, RUNS, method=FINE, models=saved).collect()}.isdisjoint({r.digest for r in saved.collect()})
    part = saved.filter("position = 1").withColumn("groups", F.array(F.lit("KO-a"), F.lit("KO-b"), F.lit("WT-a"), F.lit("gone"))).withColumn("digest", F.lit("x"))
    got = {r.position: r for r in diffmod.fit(observations, reference, RUNS, method=FINE, models=part).collect()}
    assert all(np.allclose(got[p].mu, fresh[p].mu, atol=0.05) for p in range(6))


def test_one_round_from_a_converged_model():
    rng = np.random.default_rng(3)
    y, code = [np.concatenate([rng.normal(80, 2, 80), rng.normal(88, 2, 40)])], [np.arange(120) % 3]
    args = (y, code, np.array([3]), np.array([80.0]), np.array([2.0]))
    first = mixture.fit_batch(*args, mixture.Settings(stopping_criteria=1e-12))
    start = {0: {"location": first["location"][0], "lam": first["lam"][0], "alpha": first["alpha"][0], "beta": first["beta"][0], "concentration": first["concentration"][0]}}
    again = mixture.fit_batch(*args, mixture.Settings(stopping_criteria=1e-5), start)
    assert again["iterations"][0] == 2 and np.allclose(again["location"], first["location"], rtol=1e-6) and np.allclose(again["concentration"][0], first["concentration"][0], rtol=1e-4)


def test_commands_without_a_reference_and_with_saved_models(spark, tmp_path):
    for name, level in (("ko", 100.0), ("wt", 110.0)):
        write_events(tmp_path / f"{name}.tsv", level)
        cli.main(["prep", "--events", str(tmp_path / f"{name}.tsv"), "--out", str(tmp_path / name)], spark)
    design = f"data:\n  KO: {{r: {tmp_path}/ko}}\n  WT: {{r: {tmp_path}/wt}}\nout: {tmp_path}/"
    for out in ("one", "two"):
        (tmp_path / f"{out}.yml").write_text(design + out)
    cli.main(["diff", "--config", str(tmp_path / "one.yml"), "--save-models"], spark)
    cli.main(["diff", "--config", str(tmp_path / "two.yml"), "--refit", f"{tmp_path}/one", "--ids", "T1.1"], spark)
    one, two = (sorted(map(str, readers.read_result_table(spark, f"{tmp_path}/{x}/diffmod.table").collect())) for x in ("one", "two"))
    assert one == two and len(one) == 3
