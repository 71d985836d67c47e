"""The per-site model: two normal components shared by all groups, group-specific weights, variational Bayes.

Every site is one row (its observations and their group codes as arrays); a batch of rows is fitted at once, with
observations of all sites laid end to end and segment sums in place of loops. Sites leave the batch when they
converge. Nothing is random: the first responsibilities follow from the initial means.

Posterior: Dirichlet weights for each group, normal-gamma mean and precision for each component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.functions.special import digamma, lgamma

#: Observations in one batch of the solver, which holds some twenty numbers for each; a site of more is a batch of its own. Results don't depend on it.
BATCH = 1 << 16


@dataclass(frozen=True)
class Settings:
    max_iters: int = 500
    stopping_criteria: float = 1e-5
    concentration: float = 0.001
    strength: float = 1.0

    def __post_init__(self) -> None:
        if self.max_iters < 2:
            raise ValueError("max_iters must be 2 or more")


def pack_sites(observations: DataFrame, group_col: str = "run", value_col: str = "norm_mean", key: tuple[str, ...] = ("idx", "position", "kmer")) -> DataFrame:
    """One row per site: key, reference signal, y, the sorted group names present and the group code of each y.

    Expects ref_mean and ref_std; a column p of the site (a prefilter's) is kept. The arrays are sorted by group and value, so that the row doesn't depend on
    the order in which observations arrive.
    """
    of_site = [c for c in ("ref_mean", "ref_std", "p") if c in observations.columns]
    packed = observations.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in of_site],
        F.sort_array(F.collect_list(F.struct(F.col(group_col).alias("g"), F.col(value_col).cast("double").alias("y")))).alias("obs"),
    )
    named = packed.withColumn("groups", F.array_sort(F.array_distinct(F.col("obs.g"))))
    return named.select(
        *key,
        *of_site,
        F.col("obs.y").alias("y"),
        "groups",
        F.transform("obs", lambda o: (F.array_position("groups", o["g"]) - 1).cast("int")).alias("code"),
    )


def _segments(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def fit_batch(
    y: list[np.ndarray], code: list[np.ndarray], n_groups: np.ndarray, mean: np.ndarray, sd: np.ndarray, settings: Settings = Settings(), start: dict[int, dict[str, np.ndarray]] | None = None
) -> dict[str, list | np.ndarray]:
    """Fit all sites. Per site: location, lambda, alpha, beta (2 each), concentration and counts by group, elbo, iterations, converged.

    ``start``: by number of the site, a posterior (location, lam, alpha, beta, concentration) to begin with in place of the prior.
    """
    sites = len(y)
    size = np.array([len(v) for v in y])
    prior_tau = 1 / (sd * sd)
    alpha0, beta0 = prior_tau, 0.5 / prior_tau
    quantiles = np.array([np.percentile(v, (25, 50, 75)) for v in y]).reshape(sites, 3)
    location = np.stack([mean, np.where(mean < quantiles[:, 1], quantiles[:, 2], quantiles[:, 0])], axis=1)
    lam, alpha, beta = np.full((sites, 2), settings.strength), np.stack([alpha0] * 2, axis=1), np.stack([beta0] * 2, axis=1)
    first_group = np.concatenate([[0], np.cumsum(n_groups)])
    conc = np.full((first_group[-1], 2), settings.concentration)
    counts = np.zeros((first_group[-1], 2))
    for i, posterior in (start or {}).items():
        location[i], lam[i], alpha[i], beta[i] = (posterior[k] for k in ("location", "lam", "alpha", "beta"))
        conc[first_group[i] : first_group[i + 1]] = posterior["concentration"]
    elbo, rounds, converged = np.full(sites, -np.inf), np.zeros(sites, int), np.zeros(sites, bool)

    active = np.arange(sites)
    flat_y, flat_g = np.concatenate(y), np.concatenate([c + first_group[i] for i, c in enumerate(code)])

    def laid_out():
        """Index arrays of the active sites' observations and groups."""
        n, k = size[active], n_groups[active]
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        groups = np.concatenate([np.arange(first_group[i], first_group[i + 1]) for i in active])
        local = np.full(first_group[-1], -1)
        local[groups] = np.arange(len(groups))
        site_of_y, site_of_g = np.repeat(np.arange(len(active)), n), np.repeat(np.arange(len(active)), k)
        return at, groups, site_of_y, site_of_g, np.concatenate([[0], np.cumsum(k)[:-1]])

    at, groups, site_of_y, site_of_g, group_at = laid_out()
    group_of_y = flat_g
    local_group = np.searchsorted(groups, group_of_y)
    for iteration in range(1, settings.max_iters):
        a, b, loc, l = alpha[active], beta[active], location[active], lam[active]
        tau, log_tau = a / b, digamma(a) - np.log(b)
        c = conc[groups]
        log_w = digamma(c) - digamma(c.sum(axis=1))[:, None]
        # Responsibilities.
        square = (flat_y[:, None] - loc[site_of_y]) ** 2 + (1 / (l * tau))[site_of_y]
        log_rho = 0.5 * (log_tau[site_of_y] - np.log(2 * np.pi) - tau[site_of_y] * square) + log_w[local_group]
        gap = log_rho[:, 1] - log_rho[:, 0]
        z0 = 1 / (1 + np.exp(np.clip(gap, -500, 500)))
        z = np.stack([z0, 1 - z0], axis=1)
        log_z = log_rho - np.logaddexp(log_rho[:, 0], log_rho[:, 1])[:, None]
        # Statistics of y by component.
        n_k = _segments(z, at)
        n_k = np.where(n_k < 1e-30, 0.0, n_k)
        inverse = np.divide(1.0, n_k, out=np.zeros_like(n_k), where=n_k > 0)
        bar = _segments(z * flat_y[:, None], at) * inverse
        var = _segments(z * (flat_y[:, None] - bar[site_of_y]) ** 2, at) * inverse
        n_gk = np.stack([np.bincount(local_group, z[:, k], len(groups)) for k in (0, 1)], axis=1)
        # Posterior parameters.
        c = settings.concentration + n_gk
        m = mean[active][:, None]
        l = settings.strength + n_k
        loc = (n_k * bar + settings.strength * m) / l
        a = alpha0[active][:, None] + n_k / 2
        b = beta0[active][:, None] + 0.5 * (n_k * var + settings.strength * n_k / l * (bar - m) ** 2)
        conc[groups], counts[groups] = c, n_gk
        location[active], lam[active], alpha[active], beta[active] = loc, l, a, b
        # Evidence lower bound.
        tau, log_tau = a / b, digamma(a) - np.log(b)
        log_w = digamma(c) - digamma(c.sum(axis=1))[:, None]
        square = (flat_y[:, None] - loc[site_of_y]) ** 2 + (1 / (l * tau))[site_of_y]
        fit = 0.5 * (log_tau[site_of_y] - np.log(2 * np.pi) - tau[site_of_y] * square) + log_w[local_group] - log_z
        value = _segments(np.where(z > 0, z * fit, 0.0).sum(axis=1), at)
        c0 = settings.concentration
        weights = lgamma(np.array(2 * c0)) - 2 * lgamma(np.array(c0)) - lgamma(c.sum(axis=1)) + lgamma(c).sum(axis=1) + ((c0 - c) * log_w).sum(axis=1)
        value += _segments(weights, group_at)
        a0, b0, l0 = alpha0[active][:, None], beta0[active][:, None], settings.strength
        prior = 0.5 * (np.log(l0) - np.log(l)) - 0.5 * l0 * tau * ((loc - m) ** 2 + 1 / (l * tau)) + 0.5
        prior += a0 * np.log(b0) - a * np.log(b) + lgamma(a) - lgamma(a0) + (a0 - a) * log_tau - (b0 - b) * tau
        value += prior.sum(axis=1)
        gain = value - elbo[active]
        with np.errstate(invalid="ignore"):
            done = (gain / np.abs(elbo[active]) < settings.stopping_criteria) & (iteration > 1)
        fell = (iteration > 1) & (np.round(gain, 8) < 0)
        elbo[active], rounds[active] = value, iteration
        converged[active] |= done & ~fell
        stop = done | fell
        if stop.any():
            stay = ~stop
            keep = stay[site_of_y]
            active, flat_y, group_of_y = active[stay], flat_y[keep], group_of_y[keep]
            if not len(active):
                break
            at, groups, site_of_y, site_of_g, group_at = laid_out()
            local_group = np.searchsorted(groups, group_of_y)
    split = lambda v: [v[first_group[i] : first_group[i + 1]] for i in range(sites)]
    return {"location": location, "lam": lam, "alpha": alpha, "beta": beta, "concentration": split(conc), "counts": split(counts), "elbo": elbo, "iterations": rounds, "converged": converged}


MODEL = "mu array<double>, sigma2 array<double>, lam array<double>, alpha array<double>, beta array<double>, concentration array<array<double>>, weights array<array<double>>, coverage array<double>, elbo double, iterations int, converged boolean"


def fingerprint(packed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Packed sites with ``digest``, which tells whether a saved model was fitted to the same observations under the same settings."""
    of_site = [c for c in ("y", "groups", "code", "ref_mean", "ref_std") if c in packed.columns]
    seeded = [F.xxhash64(*of_site, F.lit(f"{salt} {settings}")) for salt in (0, 1)]
    return packed.withColumn("digest", F.concat_ws("-", *[h.cast("string") for h in seeded]))


def from_saved(packed: DataFrame, models: DataFrame, key: tuple[str, ...] = ("idx", "position", "kmer")) -> DataFrame:
    """Packed sites (with ``digest``) with the saved model of the same site as ``saved``, null where there is none.

    Unchanged sites give their observations up: nothing but the saved model goes on.
    """
    saved = models.select(*key, F.struct(*[c for c in models.columns if c not in key]).alias("saved"))
    joined = packed.join(saved, list(key), "left").withColumn("unchanged", F.coalesce(F.col("saved.digest") == F.col("digest"), F.lit(False)))
    return joined.withColumn("y", F.when(F.col("unchanged"), F.slice("y", 1, 1)).otherwise(F.col("y"))).withColumn("code", F.when(F.col("unchanged"), F.slice("code", 1, 1)).otherwise(F.col("code")))


def _posterior(saved: dict, groups: list[str], settings: Settings) -> dict[str, np.ndarray]:
    """A saved model as a beginning for the given groups: those that it doesn't know begin with the prior."""
    known = dict(zip(saved["groups"], saved["concentration"], strict=True))
    prior = [settings.concentration] * 2
    return {"location": np.array(saved["mu"]), "lam": np.array(saved["lam"]), "alpha": np.array(saved["alpha"]), "beta": np.array(saved["beta"]), "concentration": np.array([known.get(g, prior) for g in groups], float)}


def fit_sites(packed: DataFrame, settings: Settings = Settings(), key: tuple[str, ...] = ("idx", "position", "kmer")) -> DataFrame:
    """key, groups, ref_mean, ref_std (and p and digest, if there) and the fitted model of every packed site with an observation.

    With ``saved`` and ``unchanged`` (``from_saved``) an unchanged site keeps its saved model as it is, and a changed one begins with it.
    """
    carried = [*key, *[c for c in ("ref_mean", "ref_std", "p", "digest") if c in packed.columns], "groups"]
    again = "saved" in packed.columns
    schema = ", ".join(f"`{c}` {packed.schema[c].dataType.simpleString()}" for c in carried) + ", " + MODEL

    types = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}
    own = {name: types[kind] for name, kind in (f.split() for f in MODEL.split(", "))}

    def made(rows: pa.RecordBatch, model: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[rows.column(c) for c in carried], *[model[c] for c in own]], [*carried, *own])

    def fit(rows: pa.RecordBatch) -> pa.RecordBatch:
        read = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
        groups = rows.column("groups").to_pylist()
        start = {i: _posterior(m, g, settings) for i, (m, g) in enumerate(zip(rows.column("saved").to_pylist(), groups, strict=True)) if m is not None} if again else None
        code, n_groups = list(read("code")), np.array([len(g) for g in groups])
        got = fit_batch(list(read("y")), code, n_groups, read("ref_mean").astype(float), read("ref_std").astype(float), settings, start)
        conc = got["concentration"]
        model = {
            "mu": got["location"].tolist(),
            "sigma2": (got["beta"] / got["alpha"]).tolist(),
            "lam": got["lam"].tolist(),
            "alpha": got["alpha"].tolist(),
            "beta": got["beta"].tolist(),
            "concentration": [c.tolist() for c in conc],
            "weights": [(c / c.sum(axis=1, keepdims=True)).tolist() for c in conc],
            # The soft counts of a group sum to its number of reads; the number itself has no rounding noise.
            "coverage": [np.bincount(c, minlength=n).astype(float).tolist() for c, n in zip(code, n_groups, strict=True)],
            "elbo": got["elbo"],
            "iterations": got["iterations"].astype("int32"),
            "converged": got["converged"],
        }
        return made(rows, {c: pa.array(model[c], t) for c, t in own.items()})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Batches stay Arrow's: of one, only the observations that are being fitted are taken out.
        for batch in batches:
            if again:
                same = batch.filter(batch.column("unchanged"))
                if same.num_rows:
                    yield made(same, {c: pc.struct_field(same.column("saved"), c).cast(t) for c, t in own.items()})
                batch = batch.filter(pc.invert(batch.column("unchanged")))
            sizes = np.cumsum(pc.list_value_length(batch.column("y")).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                before = sizes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, before + BATCH, "right")))
                yield fit(batch.slice(first, last - first))
                first = last

    return packed.filter("size(y) > 0").mapInArrow(work, schema)
