"""From fitted sites to the wide result table."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.special import norm_two_sided_sql
from sigspark.operators.stats import confidence, separated, settled, ztest

KEY = ("idx", "position", "kmer")
CLUSTER = ["mu_unmod", "mu_mod", "sigma2_unmod", "sigma2_mod", "conf_mu_unmod", "conf_mu_mod", "mod_assignment"]


def result_columns(runs: dict[str, Sequence[str]], pooling: bool = False, prefilter: str | None = None) -> list[str]:
    """The table's columns for a design {condition: run labels}, known before anything runs."""
    conditions = sorted(runs)
    pairs = [f"{a}_vs_{b}" for a, b in combinations(conditions, 2)]
    if len(conditions) > 2:
        pairs += [f"{c}_vs_all" for c in conditions]
    names = conditions if pooling else [r for c in runs for r in runs[c]]
    columns = ["id", "position", "kmer"]
    for pair in pairs:
        columns += [f"diff_mod_rate_{pair}", f"pval_{pair}", f"z_score_{pair}"]
    columns += [f"mod_rate_{n}" for n in names] + [f"coverage_{n}" for n in names]
    return columns + CLUSTER + ([prefilter] if prefilter else [])


def label_clusters(fits: DataFrame) -> DataFrame:
    """Which component is the unmodified one: that whose mean agrees strictly better with the reference signal."""
    rows = fits.withColumn("_m0", F.col("mu")[0]).withColumn("_m1", F.col("mu")[1])
    rows = rows.withColumn("_c0", confidence("_m0", "ref_mean", "ref_std")).withColumn("_c1", confidence("_m1", "ref_mean", "ref_std"))
    plain = F.col("_c0") > F.col("_c1")
    pick = lambda a, b: (F.when(plain, a).otherwise(b), F.when(plain, b).otherwise(a))
    out = rows
    for name, a, b in (("mu", F.col("_m0"), F.col("_m1")), ("sigma2", F.col("sigma2")[0], F.col("sigma2")[1]), ("conf_mu", F.col("_c0"), F.col("_c1"))):
        unmod, mod = pick(a, b)
        out = out.withColumn(f"{name}_unmod", unmod).withColumn(f"{name}_mod", mod)
    out = out.withColumn("mod_index", F.when(plain, 1).otherwise(0))
    out = out.withColumn("mod_assignment", F.when(F.col("mu_mod") > F.col("mu_unmod"), "higher").otherwise("lower"))
    return settled(out, fits.columns, [*CLUSTER, "mod_index"])


def _mean(members: Column, names: Column, field: str) -> Column:
    """Mean of a field over the site's groups among the names; null if there are none."""
    held = F.transform(F.filter(members, lambda g: F.array_contains(names, g["name"])), lambda g: g[field])
    return F.try_divide(F.aggregate(held, F.lit(0.0), lambda a, x: a + x), F.size(held))


def statistics(labelled: DataFrame, runs: dict[str, Sequence[str]], pooling: bool = False) -> DataFrame:
    """Adds the pairwise and one-versus-rest statistics and each group's rate and coverage."""
    conditions = sorted(runs)
    group = {c: [c] if pooling else list(runs[c]) for c in conditions}
    names = [n for c in runs for n in group[c]]
    sides = [(f"{a}_vs_{b}", group[a], group[b]) for a, b in combinations(conditions, 2)]
    if len(conditions) > 2:
        sides += [(f"{c}_vs_all", group[c], [n for n in names if n not in group[c]]) for c in conditions]
    zipped = F.arrays_zip(F.col("groups").alias("name"), F.col("weights").alias("w"), F.col("coverage").alias("n"))
    members = F.transform(zipped, lambda g: F.struct(g["name"].alias("name"), F.get(g["w"], F.col("mod_index")).alias("rate"), g["n"].alias("n")))
    pairs = F.array(*[F.struct(F.array(*map(F.lit, one)).alias("one"), F.array(*map(F.lit, two)).alias("two")) for _, one, two in sides])
    means = lambda s: F.struct(*[_mean(F.col("_members"), s[side], field).alias(f"{field}{i}") for i, side in ((1, "one"), (2, "two")) for field in ("rate", "n")])
    compared = lambda m: F.struct((m["rate1"] - m["rate2"]).alias("diff"), ztest(m["rate1"], m["rate2"], m["n1"], m["n2"]).alias("z"))
    # One expression serves all pairs, each step of it a projection of its own.
    rows = labelled.withColumn("_members", members).withColumn("_means", F.transform(pairs, means))
    rows = rows.withColumn("_stats", F.transform("_means", compared)).withColumn("_p", F.expr(f"transform(_stats, q -> transform(array(q.z), v -> {norm_two_sided_sql('v')})[0])"))
    rows = rows.withColumn("_own", F.transform(F.array(*map(F.lit, names)), lambda n: F.get(F.filter("_members", lambda g: g["name"] == n), F.lit(0))))
    computed = {}
    for i, (name, *_) in enumerate(sides):
        computed |= {f"diff_mod_rate_{name}": F.col("_stats")[i]["diff"], f"z_score_{name}": F.col("_stats")[i]["z"], f"pval_{name}": F.col("_p")[i]}
    for i, name in enumerate(names):
        computed |= {f"mod_rate_{name}": F.col("_own")[i]["rate"], f"coverage_{name}": F.col("_own")[i]["n"]}
    return rows.withColumns(computed).drop("_members", "_means", "_stats", "_p", "_own")


def result_table(fits: DataFrame, runs: dict[str, Sequence[str]], pooling: bool = False, prefilter: str | None = None) -> DataFrame:
    """The wide table of the sites whose components are separated. With a prefilter, fits bear its p-value as ``p``."""
    rows = statistics(label_clusters(fits), runs, pooling)
    rows = rows.withColumns({"mu0": F.col("mu")[0], "mu1": F.col("mu")[1], "var0": F.col("sigma2")[0], "var1": F.col("sigma2")[1]})
    rows = separated(rows).withColumn("id", F.col("idx"))
    if prefilter:
        rows = rows.withColumn(prefilter, F.col("p"))
    return rows.select(*[F.col(f"`{c}`") for c in result_columns(runs, pooling, prefilter)])
