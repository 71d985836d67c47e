"""Postprocessing of the result table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority_direction(table: DataFrame) -> DataFrame:
    """(kmer, chosen): the only direction of a 5-mer, or the more frequent one, with ties to "lower"."""
    counts = table.groupBy("kmer").agg(F.count_if(F.col("mod_assignment") == "higher").alias("higher"), F.count_if(F.col("mod_assignment") == "lower").alias("lower"))
    return counts.select("kmer", F.when(F.col("higher") > F.col("lower"), "higher").otherwise("lower").alias("chosen"))


def filter_majority(table: DataFrame) -> DataFrame:
    """Rows of the majority direction of their 5-mer."""
    chosen = majority_direction(table)  # at most 4**5 5-mers
    return table.join(F.broadcast(chosen), "kmer").filter("mod_assignment = chosen").select(*table.columns)


def rank_sites(table: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    """Sites by a p-value or score, ties by key."""
    ordered = table.orderBy(F.col(f"`{by}`").asc_nulls_last(), "id", "position", "kmer")
    return ordered if limit is None else ordered.limit(limit)
