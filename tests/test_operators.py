import math
import random

import pytest
from pyspark.sql import functions as F

from sigspark.operators import align, mixture, post, prep, result, stats
from sigspark.plans import diffmod
from sigspark.sources.config import Criteria, Method

EVENTS = "contig string, position long, reference_kmer string, read_index long, event_level_mean double, model_kmer string, start_idx long, end_idx long"


def events(spark):
    return spark.createDataFrame(
        [
            ("T1.1", 10, "GGACT", 7, 100.0, "GGACT", 1000, 1010),
            ("T1.1", 10, "GGACT", 7, 102.0, "GGACT", 970, 1000),
            ("T1.1", 11, "GACTA", 7, 99.0, "NNNNN", 960, 970),
            ("T1.1", 12, "ACTAA", 7, 95.5, "ACTAA", 950, 960),
            ("T1.1", 10, "GGACT", 8, 101.0, "GGACT", 0, 4),
            (None, 10, "GGACT", 8, 101.0, "GGACT", 0, 4),
        ],
        EVENTS,
    )


def test_combine_drops_failed_alignments_and_null_keys(spark):
    rows = {(r.read_index, r.position): r.norm_mean for r in prep.combine_events(prep.successful_alignments(events(spark))).collect()}
    assert rows == {(7, 12): 101.5, (7, 14): 95.5, (8, 12): 101.0}


def test_reads_need_two_positions(spark):
    rows = prep.usable_reads(prep.combine_events(prep.successful_alignments(events(spark)))).collect()
    assert {r.read_index for r in rows} == {7}


def test_cap_admits_one_more(spark):
    reads = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 1)], "idx string, read_index long")
    got = prep.cap_reads(reads, ["idx"], 3)
    assert sorted(r.read_index for r in got.filter("idx = 'a'").collect()) == [0, 1, 2, 3]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_early_stop(spark):
    sites = spark.createDataFrame([("a", 1, "AAAAA"), ("a", 2, "XXXXX"), ("a", 2, "CCCCC"), ("a", 3, "AAAAA"), ("a", 3, "AAAAC"), ("a", 4, "GGGGG"), ("b", 9, "ANAAA")], "idx string, position long, kmer string")
    assert {(r.idx, r.position) for r in prep.unambiguous_positions(sites).collect()} == {("a", 1), ("a", 2)}
    assert {(r.idx, r.position) for r in prep.unambiguous_positions(sites, on_ambiguous="drop_site").collect()} == {("a", 1), ("a", 2), ("a", 4)}


def test_exons_of_both_strands(spark):
    exons = spark.createDataFrame([("p", "+", 100, 109), ("p", "+", 200, 204), ("m", "-", 100, 109), ("m", "-", 200, 204)], "tx_id string, strand string, g_start long, g_end long")
    offsets = prep.exon_offsets(exons)
    assert {(r.tx_id, r.g_start, r.tx_start, r.tx_end) for r in offsets.collect()} == {("p", 100, 0, 9), ("p", 200, 10, 14), ("m", 200, 0, 4), ("m", 100, 5, 14)}
    probe = spark.createDataFrame([(t, i) for t in "pm" for i in range(15)], "tx_id string, position long")
    fasta = spark.createDataFrame([("p", "ACGTACGTACGTACG"), ("m", "ACGTACGTACGTACG")], "tx_id string, seq string")
    got = {(r.tx_id, r.position): (r.g_pos, r.kmer) for r in prep.tx_to_genome(probe, offsets, fasta).collect()}
    assert got["p", 10][0] == 200 and got["m", 0][0] == 204 and got["m", 5][0] == 109
    assert sorted(g for (t, _), (g, k) in got.items() if t == "p" and k == "XXXXX") == [100, 101, 108, 109, 200, 201, 203, 204]
    assert got["p", 4] == (104, "GTACG")
    plan = prep.tx_to_genome(probe, offsets)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert prep.overlapping_exons(offsets).count() == 0


def test_last_transcript_wins(spark):
    rows = spark.createDataFrame([("g", 1, "t1"), ("g", 1, "t2"), ("g", 2, "t1")], "gene_id string, read_index long, tx_ord string")
    assert {tuple(r) for r in prep.last_transcript_wins(rows).select("read_index", "tx_ord").collect()} == {(1, "t2"), (2, "t1")}


SITE = "idx string, condition string, run string, position long, kmer string, norm_mean double"


def test_shared_sites(spark):
    rows = [("i", "A", "a", 5, "K", 1.0), ("i", "B", "b", 5, "K", 1.0), ("i", "A", "a", 6, "K", 1.0), ("j", "A", "c", 1, "K", 1.0)]
    got = align.shared_sites(spark.createDataFrame(rows, SITE)).collect()
    assert {(r.idx, r.position) for r in got} == {("i", 5), ("j", 1)}


def test_gates_and_pooling(spark):
    rows = [("i", c, r, 1, "K", 1.0) for c, r, n in (("A", "a1", 3), ("A", "a2", 1), ("B", "b1", 2), ("C", "c1", 9)) for _ in range(n)]
    df = spark.createDataFrame(rows, SITE)
    assert {(r.run, r["count"]) for r in align.gate_sites(df, 2, 5).groupBy("run").count().collect()} == {("a1", 3), ("b1", 2)}
    # With pooling the reads of a condition out of bounds stay.
    assert align.gate_sites(df, 2, 5, pooling=True).count() == 15
    assert align.gate_sites(df, 4, 8, pooling=True).count() == 0


@pytest.mark.parametrize("pooling", [False, True])
def test_qualified_runs_equal_their_steps(spark, pooling):
    rng = random.Random(3)
    rows = [(f"i{rng.randint(0, 5)}", c, f"{c}{rng.randint(0, 2)}", rng.randint(0, 3), "K", 1.0) for c in rng.choices("ABC", k=900)]
    df = spark.createDataFrame(rows + [("lone", "A", "A0", 1, "K", 1.0)], SITE)
    chosen = align.select_ids(df)
    steps = align.gate_sites(chosen.join(align.shared_sites(chosen), list(align.SITE), "left_semi"), 4, 9 if not pooling else 14, pooling)
    keys = [*align.SITE, "condition", "run"]
    got = {tuple(r) for r in align.qualified_runs(df, 4, 9 if not pooling else 14, pooling).collect()}
    assert got and got == {tuple(r) for r in steps.select(*keys).distinct().collect()}
    assert align.qualified_runs(df, 0, 99, ids=["lone"]).count() == 0


def test_ids_and_codes(spark):
    df = spark.createDataFrame([("i", "A", "a", 1, "K", 1.0), ("i", "B", "b", 1, "K", 1.0), ("j", "A", "a", 1, "K", 1.0)], SITE)
    assert [r.idx for r in align.ids_across_conditions(df).collect()] == ["i"]
    assert align.select_ids(df, ["j"]).count() == 1 and align.select_ids(df).count() == 2
    assert {(r.run, r.code) for r in align.group_codes(df, ["idx"], "run").collect()} == {("a", 0), ("b", 1)}


def test_unknown_kmers_are_counted(spark):
    rows, ref = spark.createDataFrame([("K",), ("L",), ("L",)], "kmer string"), spark.createDataFrame([("K", 1.0, 1.0)], "kmer string, ref_mean double, ref_std double")
    assert align.with_reference(rows, ref).count() == 1
    assert [tuple(r) for r in align.unknown_kmers(rows, ref).collect()] == [("L", 2)]


def test_ztest_and_overlap(spark):
    one = spark.createDataFrame([(0.9, 0.2, 20.0, 30.0)], "a double, b double, m double, n double")
    z = one.select(stats.ztest(F.col("a"), F.col("b"), F.col("m"), F.col("n")).alias("z")).withColumn("p", stats.two_sided("z")).first()
    assert z.z == pytest.approx(7.059072777254549) and z.p == pytest.approx(1.67617e-12, rel=1e-5)
    assert one.select(stats.ztest(F.lit(1.0), F.lit(0.0), F.col("m"), F.col("n")).alias("z")).first().z is None
    rows = spark.createDataFrame([(0, 0.0, 1.0, 3.0, 4.0), (1, 0.0, 1.0, 1.0, 4.0), (2, 0.0, 1.0, 1.0, 1.0), (3, 0.0, 1.0, 0.0, 4.0), (4, 3.0, 4.0, 0.0, 1.0)], "i int, mu0 double, var0 double, mu1 double, var1 double")
    got = {r.i: r.overlap for r in stats.with_overlap(rows).collect()}
    assert got[0] == pytest.approx(0.29221679, abs=1e-7) and got[1] == pytest.approx(0.60993434, abs=1e-7) and got[4] == pytest.approx(got[0])
    assert math.isnan(got[2]) and math.isnan(got[3])
    assert {r.i for r in stats.separated(rows).collect()} == {0, 4}


G0 = [120.1, 121.3, 123.9, 124.2, 119.8, 122.0, 123.1, 125.4, 124.8, 121.7, 122.9, 123.3, 120.9, 124.0, 122.4]
G1 = [112.3, 113.9, 111.8, 123.5, 112.9, 114.2, 110.7, 122.8, 113.3, 112.0, 111.5, 114.6, 113.0, 112.6, 124.1]
RUNS = {"KO": ["KO-r"], "WT": ["WT-r"]}


def observations(spark):
    rows = [("id", c, f"{c}-r", 3, "GGACT", v) for c, vs in (("KO", G0), ("WT", G1)) for v in vs]
    return spark.createDataFrame(rows, SITE), spark.createDataFrame([("GGACT", 123.83, 4.79)], "kmer string, ref_mean double, ref_std double")


def test_ttest(spark):
    rows, _ = observations(spark)
    r = stats.ttest(rows, ["idx"], ["KO", "WT"]).first()
    assert (r.t, r.df, r.p) == (pytest.approx(6.186170732447338), 28, pytest.approx(1.1106072e-06, rel=1e-6))
    assert stats.prefilter(rows, "t-test", 1e-7, ["KO", "WT"]).count() == 0
    assert stats.prefilter(rows, "another", 1e-7, ["KO", "WT"]).count() == 1
    constant = rows.withColumn("norm_mean", F.lit(1.0))
    assert stats.prefilter(constant, "t-test", 0.1, ["KO", "WT"]).count() == 1  # undefined passes


def test_differential_table(spark):
    rows, ref = observations(spark)
    method = Method(prefilter="t-test", threshold=0.1)
    table = diffmod.differential_table(rows, ref, RUNS, Criteria(), method)
    assert table.columns == ["id", "position", "kmer", "diff_mod_rate_KO_vs_WT", "pval_KO_vs_WT", "z_score_KO_vs_WT", "mod_rate_KO-r", "mod_rate_WT-r", "coverage_KO-r", "coverage_WT-r", "mu_unmod", "mu_mod", "sigma2_unmod", "sigma2_mod", "conf_mu_unmod", "conf_mu_mod", "mod_assignment", "t-test"]
    r = table.first()
    assert r["mod_rate_KO-r"] == pytest.approx(6.6657779e-05, rel=1e-6) and r["mod_rate_WT-r"] == pytest.approx(0.999933342)
    assert r["z_score_KO_vs_WT"] == pytest.approx(-335.399017, rel=1e-6) and r["pval_KO_vs_WT"] == 0
    assert r["conf_mu_unmod"] == pytest.approx(0.81786061, abs=1e-7) and r["conf_mu_mod"] == pytest.approx(0.07982605, abs=1e-7)
    assert r["mod_assignment"] == "lower" and r["coverage_KO-r"] == 15
    assert diffmod.fit(rows, ref, RUNS, done=rows.select("idx")).count() == 0


def test_one_versus_rest_columns():
    columns = result.result_columns({"B": ["B-1"], "A": ["A-1", "A-2"], "C": ["C-1"]})
    assert columns[3:6] == ["diff_mod_rate_A_vs_B", "pval_A_vs_B", "z_score_A_vs_B"] and "diff_mod_rate_A_vs_all" in columns
    assert [c for c in columns if c.startswith("mod_rate")] == ["mod_rate_B-1", "mod_rate_A-1", "mod_rate_A-2", "mod_rate_C-1"]
    assert [c for c in result.result_columns({"B": ["B-1"], "A": ["A-1"]}, pooling=True) if c.startswith("coverage")] == ["coverage_A", "coverage_B"]


def test_majority_and_rank(spark):
    table = spark.createDataFrame([("a", 1, "X", "higher", 0.2), ("b", 1, "X", "higher", 0.1), ("c", 1, "X", "lower", None), ("d", 1, "X", "lower", 0.3), ("e", 1, "Y", "higher", 0.4)], "id string, position long, kmer string, mod_assignment string, pval double")
    assert {r.id for r in post.filter_majority(table).collect()} == {"c", "d", "e"}
    assert [r.id for r in post.rank_sites(table, "pval", 2).collect()] == ["b", "a"]


def test_packed_sites_dont_depend_on_order(spark):
    rows, ref = observations(spark)
    a = mixture.pack_sites(align.with_reference(rows, ref)).first()
    b = mixture.pack_sites(align.with_reference(rows.orderBy(F.rand(1)), ref)).first()
    assert a == b and a.groups == ["KO-r", "WT-r"] and sorted(set(a.code)) == [0, 1]


def test_last_transcript_is_found_without_a_join(spark):
    rows = spark.createDataFrame([("g", 1, 1, "a"), ("g", 1, 2, "b"), ("g", 1, 2, "c"), ("g", 2, 1, "d"), ("h", 1, None, "e"), (None, 1, 3, "f")], "gene_id string, read_index long, tx_ord long, kmer string")
    last = prep.last_transcript_wins(rows)
    assert sorted(r.kmer for r in last.collect()) == ["b", "c", "d"] and last.columns == rows.columns
    assert "Join" not in last._jdf.queryExecution().executedPlan().toString()
