"""Sinks: site stores, counts, result tables, models. Completed ids are read back from committed output."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sigspark.plans.dataprep import Prepared
from sigspark.sources import commits, site_slices
from sigspark.sources.commits import Commit


#: Buckets of ids of the native store, and tasks that one is dealt to.
BUCKETS, DEALT = 64, 4


def bucket_of(idx: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(idx), F.lit(buckets)).cast("int")


def write_site_store(sites: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """data.json: a line per id, {id: {position: {kmer: [values]}}}."""
    write_site_lines(sites, f"{folder}/data.json", mode)


def write_site_lines(sites: DataFrame, path: str, mode: str = "overwrite") -> None:
    kmers = sites.groupBy("idx", "position").agg(F.sort_array(F.collect_list(F.struct("kmer", "y"))).alias("kmers"))
    ids = kmers.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("position", "kmers"))).alias("positions"))
    nested = F.map_from_entries(F.transform("positions", lambda x: F.struct(x["position"].cast("string"), F.map_from_entries(x["kmers"]))))
    ids.select(F.to_json(F.create_map("idx", nested)).alias("value")).write.mode(mode).text(path)


def write_readcounts(counts: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """data.readcount: idx, n_reads."""
    counts.select("idx", "n_reads").write.mode(mode).option("header", True).csv(f"{folder}/data.readcount")


def write_prepared(commit: Commit, made: Prepared, native: bool = False) -> dict[str, int]:
    """Store, index, counts and log of prepared ids, seen together once the commit is finished; totals of what this job did.

    ``native``: with the native store (``sites``), which readers prefer. The observations are computed once. The log has every id that was looked at, with its reads and whether its sites were cut short, and so do the
    totals, which are observed while the log is written.
    """
    held = replace(made, observed=commit.staged(made.observed, "observed"), ids=commit.staged(made.ids, "ids"))
    status = commit.staged(held.status, "status")
    write_site_lines(held.sites, commit.path("data.json"))
    site_slices.write_index(status.sparkSession, commit.path("data.json"), commit.path("data.index"))
    if native:
        write_native(held.sites, commit.path("sites"))
    status.filter("n_reads > 0").select("idx", "n_reads").write.option("header", True).csv(commit.path("data.readcount"))
    totals = Observation()
    seen = [F.count(F.lit(1)).alias("ids"), F.count_if(~F.col("complete")).alias("cut_short"), F.coalesce(F.sum("n_reads"), F.lit(0)).alias("reads")]
    status.observe(totals, *seen).select("idx", "n_reads", "complete").write.option("header", True).csv(commit.path("data.log"))
    return totals.get


def write_sites_parquet(sites: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """The native store of a folder (``write_native``)."""
    write_native(sites, f"{folder}/sites", buckets)


def write_native(sites: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Long rows, partitioned by a bucket of the id and sorted by it, so that reading some ids skips buckets and row groups.

    A bucket is dealt to DEALT tasks by position: an id of many sites isn't one task's.
    """
    dealt = F.pmod(F.xxhash64("position"), F.lit(DEALT))
    rows = sites.withColumn("bucket", bucket_of("idx", buckets))
    rows.repartition("bucket", dealt).sortWithinPartitions("bucket", "idx", "position").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_result_table(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, ordered by id and position."""
    table.orderBy(*[c for c in ("id", "position", "kmer") if c in table.columns]).write.mode(mode).option("header", True).csv(path)


def write_models(fits: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Posterior parameters of every fitted site."""
    fits.write.mode(mode).parquet(path)


def write_status(ids: DataFrame, path: str, mode: str = "overwrite") -> int:
    """A log of finished ids (idx, status): those of which nothing was left to write are in it too. How many they are."""
    total = Observation()
    done = ids.select("idx").distinct().withColumn("status", F.lit("done"))
    done.observe(total, F.count(F.lit(1)).alias("ids")).write.mode(mode).option("header", True).csv(path)
    return total.get["ids"]


def completed_ids(spark: SparkSession, path: str, column: str = "id") -> DataFrame | None:
    """Ids in committed output at the path, as ``idx``; None if there is none."""
    try:
        found = spark.read.option("header", True).csv(commits.paths(spark, path))
        return found.select(F.col(column).alias("idx")).distinct() if column in found.columns else None
    except AnalysisException:
        return None
