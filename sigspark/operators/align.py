"""Sites across samples: ids in several conditions, positions in every run, read-count filters, reference signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SITE = ("idx", "position", "kmer")


def ids_across_conditions(rows: DataFrame, least: int = 2) -> DataFrame:
    """Ids in ``least`` conditions or more."""
    return rows.groupBy("idx").agg(F.count_distinct("condition").alias("n_conditions")).filter(F.col("n_conditions") >= least)


def select_ids(rows: DataFrame, ids: Sequence[str] | None = None) -> DataFrame:
    """Rows of the given ids, or else of ids in two conditions or more."""
    if ids is not None:
        return rows.filter(F.col("idx").isin(list(ids)))
    return rows.join(ids_across_conditions(rows), "idx", "left_semi")


def shared_sites(rows: DataFrame) -> DataFrame:
    """(idx, position, kmer) that occur in every run that has the id."""
    by_run = rows.select(*SITE, "run").distinct()
    site = by_run.groupBy(*SITE).agg(F.count(F.lit(1)).alias("runs"))
    every = by_run.select("idx", "run").distinct().groupBy("idx").agg(F.count(F.lit(1)).alias("all_runs"))
    return site.join(every, "idx").filter("runs = all_runs").select(*SITE)


def gate_sites(rows: DataFrame, least: int = 15, most: int = 1000, pooling: bool = False) -> DataFrame:
    """Observations that a site may use: within the read-count bounds, at sites where two conditions qualify.

    Without pooling, a run with a count out of bounds is left out, and a condition qualifies by any run left. With
    pooling, a condition qualifies by its count over all runs; the reads of one that doesn't stay if two others do.
    """
    by_run = rows.groupBy(*SITE, "condition", "run").agg(F.count(F.lit(1)).alias("n"))
    bounds = lambda c: F.col(c).between(least, most)
    if pooling:
        sites = by_run.groupBy(*SITE, "condition").agg(F.sum("n").alias("n")).filter(bounds("n")).groupBy(*SITE).agg(F.count(F.lit(1)).alias("good")).filter("good >= 2")
        return rows.join(sites.select(*SITE), list(SITE), "left_semi")
    runs = by_run.filter(bounds("n"))
    sites = runs.groupBy(*SITE).agg(F.count_distinct("condition").alias("good")).filter("good >= 2").select(*SITE)
    return rows.join(runs.join(sites, list(SITE), "left_semi").select(*SITE, "condition", "run"), [*SITE, "condition", "run"], "left_semi")


def qualified_runs(rows: DataFrame, least: int = 15, most: int = 1000, pooling: bool = False, ids: Sequence[str] | None = None) -> DataFrame:
    """(idx, position, kmer, condition, run) that the model uses: select_ids, shared_sites and gate_sites in one pass.

    Observations are counted by site and run once; all conditions are windows over that narrow table, dealt by id.
    """
    counts = rows.groupBy(*SITE, "condition", "run").agg(F.count(F.lit(1)).alias("n"))
    whole, site = Window.partitionBy("idx"), Window.partitionBy(*SITE)
    seen = counts.filter(F.col("idx").isin(list(ids))) if ids is not None else counts.withColumn("_conditions", F.size(F.collect_set("condition").over(whole))).filter("_conditions >= 2")
    seen = seen.withColumn("_all", F.size(F.collect_set("run").over(whole))).withColumn("_runs", F.count(F.lit(1)).over(site)).filter("_runs = _all")
    n = F.sum("n").over(Window.partitionBy(*SITE, "condition")) if pooling else F.col("n")
    gated = seen.withColumn("_ok", n.between(least, most)).withColumn("_good", F.size(F.collect_set(F.when(F.col("_ok"), F.col("condition"))).over(site)))
    return gated.filter("_good >= 2" if pooling else "_good >= 2 and _ok").select(*SITE, "condition", "run")


#: Quartiles of a normal lie this many standard deviations apart.
QUARTILES = 1.3489795003921634


def _exact_quartiles(known: DataFrame) -> DataFrame:
    """(kmer, q, n) of rows (kmer, v): the values of ranks ceil(n / 4), ceil(n / 2) and ceil(3 n / 4).

    Equal values are counted first. Running sums go in two steps, over the whole parts of a 5-mer's values and over the values of one whole part, so
    that no task holds a 5-mer's values.
    """
    whole = F.when(F.isnan("v"), F.lit(float("inf"))).otherwise(F.floor("v").cast("double"))
    counts = known.groupBy("kmer", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("_whole", whole)
    parts = counts.groupBy("kmer", "_whole").agg(F.sum("c").alias("_c"))
    of_kmer = Window.partitionBy("kmer")
    ahead = of_kmer.orderBy("_whole").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_c").over(ahead), F.lit(0))).withColumn("n", F.sum("_c").over(of_kmer))
    ranks = [F.expr(e) for e in ("(n + 3) div 4", "(n + 1) div 2", "(3 * n + 3) div 4")]
    within = lambda rank, end: (rank > F.col("_before")) & (rank <= F.col("_before") + F.col(end))
    hit = parts.filter(within(ranks[0], "_c") | within(ranks[1], "_c") | within(ranks[2], "_c")).drop("_c")
    run = F.sum("c").over(Window.partitionBy("kmer", "_whole").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = counts.join(hit, ["kmer", "_whole"]).withColumn("_to", F.col("_before") + run).withColumn("_before", F.col("_to") - F.col("c"))
    return near.groupBy("kmer").agg(F.array(*[F.max(F.when(within(rank, "c"), F.col("v"))) for rank in ranks]).alias("q"), F.first("n").alias("n"))


def own_reference(rows: DataFrame, value: str = "norm_mean", accuracy: int | None = None, least: float = 0.1) -> DataFrame:
    """(kmer, ref_mean, ref_std, n) of each 5-mer from observations themselves, where no table of them is given.

    Median and scaled distance of the quartiles: sites of another signal, as long as they are fewer than a quarter of a 5-mer's observations,
    move neither far. Quantiles are exact, whatever the number of observations; with ``accuracy`` they come from a mergeable sketch, whose ranks are off by
    n / accuracy at most. The spread is ``least`` or more.
    """
    known = rows.filter(F.col(value).isNotNull()).select("kmer", F.col(value).cast("double").alias("v"))
    if accuracy is None:
        sums = _exact_quartiles(known)
    else:
        sums = known.groupBy("kmer").agg(F.percentile_approx("v", [0.25, 0.5, 0.75], accuracy).alias("q"), F.count(F.lit(1)).alias("n"))
    spread = (F.col("q")[2] - F.col("q")[0]) / QUARTILES
    return sums.select("kmer", F.col("q")[1].alias("ref_mean"), F.greatest(spread, F.lit(least)).alias("ref_std"), "n")


def with_reference(rows: DataFrame, kmer_ref: DataFrame) -> DataFrame:
    """Rows with ref_mean and ref_std of their 5-mer; rows of unknown 5-mers are left out (see unknown_kmers)."""
    # 5-mers bound the table at 4**5 + 1 rows.
    return rows.join(F.broadcast(kmer_ref.select("kmer", "ref_mean", "ref_std")), "kmer")


def unknown_kmers(rows: DataFrame, kmer_ref: DataFrame) -> DataFrame:
    """5-mers without a reference, with their numbers of rows."""
    return rows.join(F.broadcast(kmer_ref.select("kmer")), "kmer", "left_anti").groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def group_codes(rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Rows with ``code``: the 0-based place of the label among those present at the key, in sorted order."""
    return rows.withColumn("code", F.dense_rank().over(Window.partitionBy(*keys).orderBy(label)) - 1)
