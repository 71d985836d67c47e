"""Special functions.

``*_sql`` return arithmetic that Spark SQL and other SQL engines read alike; inside Spark they stay on the JVM (give
them a lambda's variable: the argument occurs many times). The numpy versions serve the batch solvers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# W. J. Cody's rational approximations of erf and erfc (1969).
_A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
_B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_C = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
_D = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
_ROOT = 0.56418958354775628695


def _number(c: float) -> str:
    """A double literal in any dialect."""
    return repr(c) if "e" in repr(c) else f"{c!r}e0"


def _horner(lead: str, rest: tuple[float, ...], x: str) -> str:
    """((lead * x + c0) * x + c1) * x ... + cn; without a lead the first factor is 1."""
    out = f"({lead} * {x})" if lead else f"({x})"
    for c in rest[:-1]:
        out = f"(({out} + {_number(c)}) * {x})"
    return f"({out} + {_number(rest[-1])})"


def erf_small_sql(x: str) -> str:
    """erf for abs(x) <= 0.46875."""
    square = f"({x} * {x})"
    return f"({x} * {_horner(_number(_A[4]), _A[:4], square)} / {_horner('', _B, square)})"


def erfc_positive_sql(y: str) -> str:
    """erfc for y >= 0.46875, accurate in the far tail."""
    middle = f"({_horner(_number(_C[8]), _C[:8], y)} / {_horner('', _D, y)})"
    inverse = f"(1e0 / ({y} * {y}))"
    tail = f"(({_ROOT!r}e0 - {inverse} * {_horner(_number(_P[5]), _P[:5], inverse)} / {_horner('', _Q, inverse)}) / {y})"
    head = f"(floor({y} * 16e0) / 16e0)"
    scale = f"(exp(-{head} * {head}) * exp(-({y} - {head}) * ({y} + {head})))"
    return f"(case when {y} > 27e0 then 0e0 when {y} <= 4e0 then {scale} * {middle} else {scale} * {tail} end)"


def erfc_sql(x: str) -> str:
    """erfc of a double expression."""
    return f"(case when abs({x}) <= 0.46875e0 then 1e0 - {erf_small_sql(x)} when {x} > 0e0 then {erfc_positive_sql(x)} else 2e0 - {erfc_positive_sql(f'(-{x})')} end)"


def norm_cdf_sql(x: str, mean: str, sd: str) -> str:
    """Probability that a normal variable is at most x."""
    return f"(0.5e0 * {erfc_sql(f'(({mean} - {x}) / ({sd} * {2**0.5!r}e0))')})"


def norm_two_sided_sql(z: str) -> str:
    """Two-sided p-value of a standard normal z, accurate to 1e-115 and below."""
    return erfc_sql(f"(abs({z}) / {2**0.5!r}e0)")


#: Steps of the continued fraction of the incomplete beta function: STEPS and ROOTS times the root of the larger parameter.
STEPS, ROOTS = 48, 5


def _beta_fraction_sql(a: str, b: str, x: str) -> str:
    """Lentz's continued fraction of the incomplete beta function, for x below its turning point."""
    kept = lambda v: f"(case when abs({v}) < 1e-300 then 1e-300 else {v} end)"
    even = f"(m * ({b} - m) * {x} / (({a} + 2 * m - 1) * ({a} + 2 * m)))"
    odd = f"(-({a} + m) * ({a} + {b} + m) * {x} / (({a} + 2 * m) * ({a} + 2 * m + 1)))"
    start = f"(1e0 / {kept(f'(1e0 - ({a} + {b}) * {x} / ({a} + 1))')})"

    def step(state: str, up: str) -> str:
        d, c = f"(1e0 / {kept(f'(1e0 + {up} * {state}.d)')})", kept(f"(1e0 + {up} / {state}.c)")
        return f"transform(array(named_struct('d', {d}, 'c', {c})), w -> named_struct('d', w.d, 'c', w.c, 'f', {state}.f * w.d * w.c))[0]"

    both = f"transform(array({step('s', even)}), h -> {step('h', odd)})[0]"
    count = f"{STEPS} + cast({ROOTS} * sqrt(greatest({a}, {b})) as int)"
    return f"aggregate(sequence(1, {count}), named_struct('d', {start}, 'c', 1e0, 'f', {start}), (s, m) -> {both}, s -> s.f)"


def student_two_sided_column(t: str, df: str) -> Column:
    """Two-sided p-value of Student's t in a column, as an expression of Spark SQL; null where t or df is."""
    # Gamma(a + 1/2) / Gamma(a): ten steps up, then its asymptotic series.
    up = " * ".join(f"((v.a + {k}) / (v.a + {k}.5e0))" for k in range(10))
    r = "(v.a + 10)"
    ratio = f"(0.5e0 * ln{r} - 1 / (8 * {r}) + 1 / (192 * pow({r}, 3)) - 1 / (640 * pow({r}, 5)) + 17 / (14336 * pow({r}, 7)))"
    front = f"(exp({ratio} + v.a * ln(v.x) + 0.5e0 * ln(v.y)) * {up} / sqrt(pi()))"
    low, high = f"{front} * {_beta_fraction_sql('v.a', '0.5e0', 'v.x')} / v.a", f"1e0 - {front} * {_beta_fraction_sql('0.5e0', 'v.a', 'v.y')} / 0.5e0"
    value = f"case when v.y <= 0 then 1e0 when v.x <= 0 then 0e0 when v.x <= (v.a + 1) / (v.a + 2.5e0) then {low} else {high} end"
    square = f"(cast({t} as double) * {t})"
    one = f"named_struct('a', {df} / 2e0, 'x', if(isnan({square}) or {square} = double('infinity'), if(isnan({square}), double('nan'), 0e0), {df} / ({df} + {square})), 'y', if({square} = double('infinity'), 1e0, {square} / ({df} + {square})))"
    return F.expr(f"case when {t} is null or {df} is null or {df} <= 0 then null when isnan({t}) then double('nan') else transform(array({one}), v -> {value})[0] end")


def rint(x: Column, decimals: int = 0) -> Column:
    """Round half to even, as IEEE does (round() rounds half up)."""
    scale = 10.0**decimals
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def digamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: upward recurrence to 10, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        if not low.any():
            break
        out[low] -= 1 / x[low]
        x[low] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i * (1 / 132)))))


def lgamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series above 10, recurrence below."""
    x = np.array(x, float)
    product = np.ones_like(x)
    for _ in range(10):
        low = x < 10
        if not low.any():
            break
        product[low] *= x[low]
        x[low] += 1
    i = 1 / (x * x)
    series = (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised I_x(a, b) by Lentz's continued fraction."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    a2, b2, x2 = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (x2 > 0) & (x2 < 1)
    safe = np.where(inside, x2, 0.5)
    front = np.exp(lgamma(a2 + b2) - lgamma(a2) - lgamma(b2) + a2 * np.log(safe) + b2 * np.log1p(-safe)) / a2
    tiny = 1e-300
    c, d = np.ones_like(safe), 1 - (a2 + b2) * safe / (a2 + 1)
    d = 1 / np.where(abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 500):
        for up in (m * (b2 - m) * safe / ((a2 + 2 * m - 1) * (a2 + 2 * m)), -(a2 + m) * (a2 + b2 + m) * safe / ((a2 + 2 * m) * (a2 + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / np.where(abs(d) < tiny, tiny, d)
            c = 1 + up / c
            c = np.where(abs(c) < tiny, tiny, c)
            step = c * d
            f *= step
        if (abs(step - 1) < 1e-15).all():
            break
    part = np.where(inside, front * f, np.where(x2 <= 0, 0.0, 1.0))
    return np.where(swap, 1 - part, part)


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t; NaN where t is NaN."""
    t, df = np.array(t, float), np.array(df, float)
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where(np.isinf(t), 0.0, df / (df + t * t))
        return np.where(np.isnan(t) | ~(df > 0), np.nan, incomplete_beta(np.where(df > 0, df, 1) / 2, 0.5, np.where(np.isnan(x), 0.5, x)))
