"""Statistics between groups: t-test, z-test, overlap of two normals, confidence of a cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.special import erfc_sql, norm_two_sided_sql, student_two_sided_column


def ttest_moments(rows: DataFrame, keys: Sequence[str], conditions: Sequence[str], value: str = "norm_mean") -> DataFrame:
    """n, mean and variance of two conditions' values, and Student's t with pooled variance and its df (null if undefined)."""
    a, b = conditions
    of = lambda c: F.when(F.col("condition") == c, F.col(value).cast("double"))
    got = rows.groupBy(*keys).agg(*[f(of(c)).alias(f"{name}{i}") for i, c in ((1, a), (2, b)) for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    df = F.col("n1") + F.col("n2") - 2
    pooled = F.try_divide((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2"), df)
    scale = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2"))))
    return got.withColumn("df", df).withColumn("t", F.try_divide(F.col("mean1") - F.col("mean2"), scale))


def ttest(rows: DataFrame, keys: Sequence[str], conditions: Sequence[str], value: str = "norm_mean") -> DataFrame:
    """The moments with the two-sided p-value (null where t is undefined)."""
    moments = ttest_moments(rows, keys, conditions, value)
    held = settled(moments, [c for c in moments.columns if c != "t"], ["t"])
    return settled(held.withColumn("p", student_two_sided_column("t", "df")), moments.columns, ["p"])


#: Tests that a prefilter may name: (rows, keys, conditions) -> frame with a column p.
TESTS = {"t-test": ttest}


def prefilter(rows: DataFrame, method: str, threshold: float, conditions: Sequence[str], keys: Sequence[str] = ("idx", "position", "kmer")) -> DataFrame:
    """Sites (keys, p) that the test lets pass: p below the threshold, or undefined (null). An unknown method lets everything pass."""
    if method not in TESTS:
        return rows.select(*keys).distinct().withColumn("p", F.lit(float("nan")))
    return TESTS[method](rows, keys, conditions).select(*keys, "p").filter(F.col("p").isNull() | F.isnan("p") | (F.col("p") < threshold))


def ztest(p1: Column, p2: Column, n1: Column, n2: Column) -> Column:
    """Two-proportion z with unpooled variance; n are mean coverages, rounded half to even. Null if the variance is 0."""
    var = F.try_divide(p1 * (1 - p1), F.rint(n1)) + F.try_divide(p2 * (1 - p2), F.rint(n2))
    return F.try_divide(p1 - p2, F.sqrt(var))


def two_sided(z: str) -> Column:
    """p-value of the z in a column."""
    # As a lambda's variable the argument is computed once and the long expression stays one small tree.
    return F.expr(f"transform(array({z}), v -> {norm_two_sided_sql('v')})[0]")


def settled(rows: DataFrame, held: Sequence[str], computed: Sequence[str]) -> DataFrame:
    """Both kinds of columns, with a generator as barrier: filters above it aren't rewritten over what computes the second kind."""
    return rows.select(*[F.col(f"`{c}`") for c in held], F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in computed]))))


def overlap_sql(mu_x: str, var_x: str, mu_y: str, var_y: str) -> dict[str, str]:
    """SQL of the two intersections of two normals and of the four CDFs there. x must be the narrower one."""
    dv, dm = f"({var_y} - {var_x})", f"({mu_y} - {mu_x})"
    a = f"({mu_x} * {var_y} - {mu_y} * {var_x})"
    b = f"(sqrt({var_x}) * sqrt({var_y}) * sqrt({dm} * {dm} + {dv} * ln({var_y} / {var_x})))"
    return {"low": f"(({a} - {b}) / {dv})", "high": f"(({a} + {b}) / {dv})"}


def with_overlap(df: DataFrame, mu: tuple[str, str] = ("mu0", "mu1"), var: tuple[str, str] = ("var0", "var1")) -> DataFrame:
    """Adds overlap (NaN if the variances or the means are equal) and tails: whether an intersection lies in a shared tail."""
    first = F.expr(f"{var[0]} < {var[1]}")
    named = df
    for name, c, k in (("_mx", mu, 0), ("_my", mu, 1), ("_vx", var, 0), ("_vy", var, 1)):
        named = named.withColumn(name, F.when(first, F.col(c[k])).otherwise(F.col(c[1 - k])).cast("double"))
    cross = overlap_sql("_mx", "_vx", "_my", "_vy")
    named = named.withColumn("_defined", F.expr("_vx <> _vy and _mx <> _my and _vx > 0"))
    for end in ("low", "high"):
        named = named.withColumn(f"_{end}", F.expr(f"case when _defined then {cross[end]} end"))
    ends = [(who, end) for end in ("low", "high") for who in "xy"]
    scaled = ", ".join(f"(_m{who} - _{end}) / (sqrt(_v{who}) * {2**0.5!r}e0)" for who, end in ends)
    named = named.withColumn("_cdf", F.expr(f"transform(array({scaled}), v -> 0.5e0 * {erfc_sql('v')})"))
    named = named.withColumns({f"_f{who}_{end}": F.col("_cdf")[i] for i, (who, end) in enumerate(ends)})
    tails = " or ".join(f"(_fx_{e} < 0.1 and _fy_{e} < 0.1) or (_fx_{e} > 0.9 and _fy_{e} > 0.9)" for e in ("low", "high"))
    out = named.withColumn("overlap", F.expr("coalesce(1e0 - abs(_fy_low - _fx_low) - abs(_fy_high - _fx_high), double('NaN'))")).withColumn("tails", F.expr(f"coalesce({tails}, false)"))
    return settled(out, df.columns, ["overlap", "tails"])


def separated(df: DataFrame, most: float = 0.5) -> DataFrame:
    """Rows whose two normals overlap by at most ``most`` and meet in a shared tail."""
    return with_overlap(df).filter(f"not isnan(overlap) and overlap <= {most} and tails").drop("overlap", "tails")


def confidence(mu: str, ref_mean: str, ref_std: str) -> Column:
    """How well a cluster's mean agrees with the reference signal: the two-sided normal p-value of their distance."""
    return F.expr(f"transform(array(abs({mu} - {ref_mean}) / ({ref_std} * {2**0.5!r}e0)), v -> {erfc_sql('v')})[0]")


def percentiles(rows: DataFrame, keys: Sequence[str], value: str = "norm_mean") -> DataFrame:
    """Exact quartiles with linear interpolation."""
    got = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(*keys).agg(got.alias("p")).select(*keys, F.col("p")[0].alias("p25"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p75"))
