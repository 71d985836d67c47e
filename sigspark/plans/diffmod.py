"""Differential modelling: samples to the result table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.operators import align, mixture, result, stats
from sigspark.operators.prep import skip_done
from sigspark.sources.config import Criteria, Method


def fit(rows: DataFrame, kmer_ref: DataFrame, runs: dict[str, Sequence[str]], criteria: Criteria = Criteria(), method: Method = Method(), ids: Sequence[str] | None = None, done: DataFrame | None = None, models: DataFrame | None = None) -> DataFrame:
    """Fitted sites of observations (condition, run, idx, position, kmer, norm_mean).

    Filters go before the packed model rows, so that sites that can't qualify never reach Python. ``models``: saved ones to go on from; sites
    whose observations, reference and settings are the same keep theirs, others begin with them.
    """
    chosen = skip_done(rows, done) if done is not None else rows
    runs_used = align.qualified_runs(chosen, criteria.readcount_min, criteria.readcount_max, method.pooling, ids)
    held = chosen.join(runs_used, [*align.SITE, "condition", "run"], "left_semi")
    held = align.with_reference(held, kmer_ref)
    if method.prefilter:
        # The p-value goes along with the observations, so that the test runs once.
        held = held.join(stats.prefilter(held, method.prefilter, method.threshold, list(runs)[:2]), list(align.SITE))
    packed = mixture.pack_sites(held, "condition" if method.pooling else "run")
    settings = mixture.Settings(max_iters=method.max_iters, stopping_criteria=method.stopping_criteria)
    packed = mixture.fingerprint(packed, settings)
    fits = mixture.fit_sites(mixture.from_saved(packed, models) if models is not None else packed, settings)
    return fits if not method.prefilter or method.prefilter in stats.TESTS else fits.withColumn("p", F.lit(float("nan")))


def differential_table(rows: DataFrame, kmer_ref: DataFrame, runs: dict[str, Sequence[str]], criteria: Criteria = Criteria(), method: Method = Method(), ids: Sequence[str] | None = None, done: DataFrame | None = None) -> DataFrame:
    """The result table."""
    return result.result_table(fit(rows, kmer_ref, runs, criteria, method, ids, done), runs, method.pooling, method.prefilter)
