"""The site model as a recursive query: an independent statement of its equations for DuckDB."""

from __future__ import annotations

import math

from sigspark.functions.special import erfc_sql, norm_cdf_sql, norm_two_sided_sql
from sigspark.operators.stats import overlap_sql


def psi(x: str) -> str:
    """Digamma: ten steps up, then the asymptotic series."""
    up, i = f"({x} + 10)", f"(1e0 / (({x} + 10) * ({x} + 10)))"
    steps = " - ".join(f"1e0 / ({x} + {k})" for k in range(10))
    return f"(ln({up}) - 0.5e0 / {up} - {i} * (1e0/12 - {i} * (1e0/120 - {i} * (1e0/252 - {i} * (1e0/240 - {i} * (1e0/132))))) - {steps})"


def student_p(t: str, df: str) -> str:
    """Two-sided p of Student's t with whole degrees of freedom, by the finite series."""
    c = f"({df}::double / ({df} + {t} * {t}))"
    even = f"sqrt(1 - {c}) * list_sum(list_transform(range(0, {df} // 2), lambda k: exp(lgamma(k + 0.5e0) - lgamma(0.5e0) - lgamma(k + 1e0)) * pow({c}, k)))"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({df}::double)) + sqrt(1 - {c}) * sqrt({c}) * coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda k: exp(lgamma(k + 1e0) + lgamma(1.5e0) - lgamma(k + 1.5e0)) * pow({c}, k))), 0))"
    return f"(1 - case when {df} % 2 = 0 then {even} else {odd} end)"


def _sum(f: str) -> str:
    return f"list_sum(list_transform(range(1, n + 1), lambda i: {f}))"


def _prior(k: int) -> str:
    """Expected log prior less expected log posterior of component k's mean and precision."""
    et, el = f"(a{k} / b{k})", f"({psi(f'a{k}')} - ln(b{k}))"
    return (
        f"(-0.5e0 * ln(l{k}) - 0.5e0 * {et} * ((loc{k} - m) * (loc{k} - m) + 1 / (l{k} * {et})) + 0.5e0"
        f" + tau * ln(beta) - a{k} * ln(b{k}) + lgamma(a{k}) - lgamma(tau) + (tau - a{k}) * {el} - (beta - b{k}) * {et})"
    )


def fitted(packed: str, max_iters: int = 500, tolerance: float = 1e-5) -> str:
    """CTEs ending in ``fitted`` from ``packed`` (idx, position, kmer, m, s, y, g: codes from 1, names)."""
    two_pi = repr(math.log(2 * math.pi))
    log_dirichlet = "list_sum(list_transform(range(1, len(names) + 1), lambda j: lgamma(0.002e0) - 2 * lgamma(0.001e0) - lgamma(c0[j] + c1[j]) + lgamma(c0[j]) + lgamma(c1[j]) + (0.001e0 - c0[j]) * w0[j] + (0.001e0 - c1[j]) * w1[j]))"
    logs = ", ".join(f"list_transform(range(1, len(names) + 1), lambda j: {psi(f'c{k}[j]')} - {psi('(c0[j] + c1[j])')}) as w{k}" for k in (0, 1))
    rho = ", ".join(f"list_transform(range(1, n + 1), lambda i: 0.5e0 * (el{k} - {two_pi} - et{k} * ((y[i] - loc{k}) * (y[i] - loc{k}) + 1 / (l{k} * et{k}))) + w{k}[g[i]]) as r{k}" for k in (0, 1))
    expected = ", ".join(f"a{k} / b{k} as et{k}, {psi(f'a{k}')} - ln(b{k}) as el{k}" for k in (0, 1))
    key = "idx, position, kmer, m, tau, beta, y, g, n, names"
    fit = " + ".join(f"{_sum(f'case when z{k}[i] > 0 then z{k}[i] * (0.5e0 * (el{k} - {two_pi} - et{k} * ((y[i] - loc{k}) * (y[i] - loc{k}) + 1 / (l{k} * et{k}))) + w{k}[g[i]] - q{k}[i]) else 0 end')}" for k in (0, 1))
    return f"""
start as (select idx, position, kmer, m, 1e0 / (s * s) as tau, 0.5e0 * s * s as beta, y, g, len(y) as n, names from packed),
fitting as (
  select {key}, m as loc0, case when m < list_aggregate(y, 'quantile_cont', 0.5) then list_aggregate(y, 'quantile_cont', 0.75) else list_aggregate(y, 'quantile_cont', 0.25) end as loc1, 1e0 as l0, 1e0 as l1, tau as a0, tau as a1, beta as b0, beta as b1,
    list_transform(names, lambda x: 0.001e0) as c0, list_transform(names, lambda x: 0.001e0) as c1, cast(null as double) as elbo, 0 as rounds, false as done, false as converged from start
  union all
  select {key}, loc0, loc1, l0, l1, a0, a1, b0, b1, c0, c1, new_elbo, rounds + 1, done_now or fell, done_now and not fell from (
    select *, coalesce((new_elbo - elbo) / abs(elbo) < {tolerance!r}, false) as done_now, coalesce(round(new_elbo - elbo, 8) < 0, false) as fell from (
      select *, {fit} + {log_dirichlet} + {_prior(0)} + {_prior(1)} as new_elbo from (
        select *, {expected}, {logs} from (
          select * exclude (l0, l1, loc0, loc1, a0, a1, b0, b1), 1 + n0 as l0, 1 + n1 as l1, (n0 * bar0 + m) / (1 + n0) as loc0, (n1 * bar1 + m) / (1 + n1) as loc1, tau + n0 / 2 as a0, tau + n1 / 2 as a1,
            beta + 0.5e0 * (n0 * var0 + n0 / (1 + n0) * (bar0 - m) * (bar0 - m)) as b0, beta + 0.5e0 * (n1 * var1 + n1 / (1 + n1) * (bar1 - m) * (bar1 - m)) as b1 from (
            select *, case when n0 > 0 then {_sum("z0[i] * (y[i] - bar0) * (y[i] - bar0)")} / n0 else 0 end as var0, case when n1 > 0 then {_sum("z1[i] * (y[i] - bar1) * (y[i] - bar1)")} / n1 else 0 end as var1 from (
              select *, case when n0 > 0 then {_sum("z0[i] * y[i]")} / n0 else 0 end as bar0, case when n1 > 0 then {_sum("z1[i] * y[i]")} / n1 else 0 end as bar1 from (
                select *, case when list_sum(z0) < 1e-30 then 0 else list_sum(z0) end as n0, case when list_sum(z1) < 1e-30 then 0 else list_sum(z1) end as n1,
                  list_transform(range(1, len(names) + 1), lambda j: 0.001e0 + {_sum("case when g[i] = j then z0[i] else 0 end")}) as c0, list_transform(range(1, len(names) + 1), lambda j: 0.001e0 + {_sum("case when g[i] = j then z1[i] else 0 end")}) as c1 from (
                  select * exclude (r0, r1), list_transform(z0, lambda z: 1 - z) as z1, list_transform(range(1, n + 1), lambda i: r0[i] - greatest(r0[i], r1[i]) - ln(1 + exp(-abs(r0[i] - r1[i])))) as q0, list_transform(range(1, n + 1), lambda i: r1[i] - greatest(r0[i], r1[i]) - ln(1 + exp(-abs(r0[i] - r1[i])))) as q1 from (
                    select *, list_transform(range(1, n + 1), lambda i: 1 / (1 + exp(greatest(-500e0, least(500e0, r1[i] - r0[i]))))) as z0 from (
                      select {key}, elbo, rounds, loc0, loc1, l0, l1, a0, a1, b0, b1, {rho} from (
                        select *, {expected}, {logs} from fitting where not done and rounds < {max_iters - 1})))))))))))),
fitted as (select * from fitting qualify row_number() over (partition by idx, position, kmer order by rounds desc) = 1)
"""


def result_sql(runs: dict[str, list[str]], overlap: float = 0.5) -> str:
    """CTEs and the final select of the result table (several conditions, no pooling) from ``fitted`` and ``packed``."""
    conditions = sorted(runs)
    names = [r for c in runs for r in runs[c]]
    unmod = "conf0 > conf1"
    root = f"{2**0.5!r}e0"
    conf = ", ".join(f"{erfc_sql(f'(abs(loc{k} - m) * sqrt(tau) / {root})')} as conf{k}" for k in (0, 1))
    rate = "case when {u} then c1[j] else c0[j] end / (c0[j] + c1[j])".format(u=unmod)
    members = f"list_transform(range(1, len(names) + 1), lambda j: struct_pack(name := names[j], rate := {rate}, n := len(list_filter(g, lambda v: v = j))::double))"
    sides = [(f"{a}_vs_{b}", runs[a], True, runs[b], True) for i, a in enumerate(conditions) for b in conditions[i + 1 :]]
    if len(conditions) > 2:
        sides += [(f"{c}_vs_all", runs[c], True, runs[c], False) for c in conditions]

    def mean(field: str, own: list[str], inside: bool) -> str:
        test = f"list_contains({list(own)!r}, gr.name)"
        held = f"list_filter(members, lambda gr: {test if inside else 'not ' + test})"
        return f"(list_sum(list_transform({held}, lambda gr: gr.{field})) / nullif(len({held}), 0))"

    raw, out = [], []
    for name, one, in1, two, in2 in sides:
        p1, p2, n1, n2 = mean("rate", one, in1), mean("rate", two, in2), f"round_even({mean('n', one, in1)}, 0)", f"round_even({mean('n', two, in2)}, 0)"
        raw.append(f'{p1} - {p2} as "d_{name}", ({p1} - {p2}) / nullif(sqrt({p1} * (1 - {p1}) / {n1} + {p2} * (1 - {p2}) / {n2}), 0) as "z_{name}"')
        out.append(f'round("d_{name}", 6) as "diff_mod_rate_{name}", round({norm_two_sided_sql(chr(34) + "z_" + name + chr(34))}, 9) as "pval_{name}", round("z_{name}", 4) as "z_score_{name}"')
    for r in names:
        out.append(f'round({mean("rate", [r], True)}, 6) as "mod_rate_{r}", round({mean("n", [r], True)}, 6) as "coverage_{r}"')
    pick = lambda a, b: (f"case when {unmod} then {a} else {b} end", f"case when {unmod} then {b} else {a} end")
    for name, a, b in (("mu", "loc0", "loc1"), ("sigma2", "b0 / a0", "b1 / a1"), ("conf_mu", "conf0", "conf1")):
        for end, x in zip(("unmod", "mod"), pick(a, b), strict=True):
            out.append(f"round({x}, 6) as {name}_{end}")
    mu_unmod, mu_mod = pick("loc0", "loc1")
    cross = overlap_sql("mx", "vx", "my", "vy")
    cdf = lambda who, end: norm_cdf_sql(end, f"m{who}", f"sqrt(v{who})")
    return f"""
trusted as (select *, {conf} from fitted),
grouped as (select *, {members} as members, b0 / a0 < b1 / a1 as first from trusted),
narrow as (select *, case when first then loc0 else loc1 end as mx, case when first then loc1 else loc0 end as my, case when first then b0 / a0 else b1 / a1 end as vx, case when first then b1 / a1 else b0 / a0 end as vy from grouped),
crossed as (select *, {cross['low']} as low, {cross['high']} as high from narrow where vx <> vy and mx <> my),
tails as (select *, {cdf('x', 'low')} as xl, {cdf('y', 'low')} as yl, {cdf('x', 'high')} as xh, {cdf('y', 'high')} as yh from crossed),
separate as (select *, {', '.join(raw)} from tails where 1e0 - abs(yl - xl) - abs(yh - xh) <= {overlap} and ((xl < 0.1 and yl < 0.1) or (xl > 0.9 and yl > 0.9) or (xh < 0.1 and yh < 0.1) or (xh > 0.9 and yh > 0.9)))
select idx as id, position, kmer, {', '.join(out)}, case when {mu_mod} > {mu_unmod} then 'higher' else 'lower' end as mod_assignment from separate
"""
