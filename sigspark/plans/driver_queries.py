"""Queries of the engine over the driver's tables, and the same in DuckDB SQL.

The domain's tables are views of lineitem, events and part; a view's SQL reads alike in both engines.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspark.functions.special import erfc_sql, norm_cdf_sql, norm_two_sided_sql
from sigspark.operators import align, post, prep, result, stats
from sigspark.plans import dataprep, diffmod, model_sql
from sigspark.sources import config, readers, site_slices, writers
from sigspark.sources.commits import Commit
from sigspark.sources.config import Method

RUNS = {c: [f"{c}-{s}" for s in "FO"] for c in "ANR"}

def _kmer_sql(p: str, spark: bool) -> str:
    """The 5-mer of a position: its base-4 digits."""
    div = (lambda n: f"({p} div {n})") if spark else (lambda n: f"({p} // {n})")
    return " || ".join(f"substring('ACGT', cast({div(4**i)} % 4 as int) + 1, 1)" for i in reversed(range(5)))


#: View name -> SQL over the driver's tables ({kmer} stands for the 5-mer of l_suppkey).
VIEWS = {
    "v_events": "select l_orderkey as read_index, 'T' || l_returnflag as contig, cast(l_linenumber as bigint) as position, 'ACGTA' as reference_kmer, case when l_quantity = 50 then 'NNNNN' else 'ACGTA' end as model_kmer, l_quantity as length, l_extendedprice as event_level_mean from lineitem",
    "v_signal": "select l_orderkey as read_index, 'T' || cast(l_suppkey % 10 as varchar(20)) as idx, l_suppkey as position, l_returnflag as condition, l_returnflag || '-' || l_linestatus as run, {kmer} as kmer, l_quantity as length, 80e0 - case when l_discount > 0.05 then 8e0 else 0e0 end + 50e0 * l_tax + l_quantity - 3e0 * floor(l_quantity / 3e0) as level from lineitem",
    "v_pair": "select cast(user_id % 10 as bigint) as site, event_type as condition, value as norm_mean from events where event_type in ('click', 'view')",
    "v_exons": "select 'T' || cast(p_partkey % 20 as varchar(20)) as tx_id, case when p_partkey % 2 = 0 then '+' else '-' end as strand, 100 * p_partkey as g_start, 100 * p_partkey + p_size - 1 as g_end from part",
}


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = {"v_events": "lineitem", "v_signal": "lineitem", "v_pair": "events", "v_exons": "part"}[name]
    sql = VIEWS[name].format(kmer=_kmer_sql("l_suppkey", True)).replace(f"from {table}", "from {source}").replace("varchar(20)", "string")
    return spark.sql(sql, source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _sql(body: str, *views: str) -> str:
    made = ", ".join(f"{v} as ({VIEWS[v].format(kmer=_kmer_sql('l_suppkey', False))})" for v in views)
    return f"with {made}{',' if body.lstrip().startswith('/*with*/') else ''} {body.replace('/*with*/', '')}"


# A read's level at a site and run: the length-weighted mean, to one decimal, half to even.
_COMBINED = "combined as (select condition, run, read_index, idx, position + 2 as position, kmer, round_even(sum(level * length) / sum(length), 1) as norm_mean from v_signal group by all)"


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _view(spark, sf_dir, "v_signal").withColumnsRenamed({"idx": "contig", "kmer": "reference_kmer", "level": "event_level_mean"})
    return prep.combine_events(rows, ["condition", "run"]).withColumnsRenamed({"contig": "idx", "reference_kmer": "kmer"})


def _reference(rows: DataFrame) -> DataFrame:
    """A reference signal for the 5-mers present, from their letters."""
    at = F.expr("ascii(substring(kmer, 5, 1)) + ascii(substring(kmer, 4, 1))")
    return rows.select("kmer").distinct().withColumn("ref_mean", 82 + (at % 5) * 0.5).withColumn("ref_std", 2 + (at % 3) * 0.25)


_REF = "ref as (select distinct kmer, 82 + ((ascii(substring(kmer, 5, 1)) + ascii(substring(kmer, 4, 1))) % 5) * 0.5e0 as ref_mean, 2 + ((ascii(substring(kmer, 5, 1)) + ascii(substring(kmer, 4, 1))) % 3) * 0.25e0 as ref_std from combined)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(function: Callable) -> Callable:
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return register


@query("combine_events", _sql("select read_index, contig, position + 2 as position, reference_kmer, round_even(sum(event_level_mean * length) / sum(length), 1) as norm_mean from v_events where reference_kmer = model_kmer group by read_index, contig, position, reference_kmer", "v_events"))
def combine_events(spark, sf_dir):
    return prep.combine_events(prep.successful_alignments(_view(spark, sf_dir, "v_events")))


@query("min_positions_filter", _sql("/*with*/ c as (select distinct read_index, contig, position + 2 as position from v_events where reference_kmer = model_kmer) select read_index, contig, position from c where (contig, read_index) in (select (contig, read_index) from c group by contig, read_index having count(*) > 1)", "v_events"))
def min_positions_filter(spark, sf_dir):
    rows = combine_events(spark, sf_dir).select("read_index", "contig", "position").distinct()
    return prep.usable_reads(rows)


@query("read_cap", _sql("/*with*/ r as (select distinct idx, run, read_index from v_signal) select idx, run, read_index from r qualify row_number() over (partition by idx, run order by read_index) <= 31", "v_signal"))
def read_cap(spark, sf_dir):
    return prep.cap_reads(_view(spark, sf_dir, "v_signal").select("idx", "run", "read_index").distinct(), ["idx", "run"], 30)


@query("count_gates", _sql("select position, run, count(distinct read_index) as n_reads from v_signal group by position, run having count(distinct read_index) >= 90", "v_signal"))
def count_gates(spark, sf_dir):
    return prep.gated_counts(_view(spark, sf_dir, "v_signal"), ["position", "run"], 90)


@query("collect_sites", _sql(f"/*with*/ {_COMBINED} select run, idx, position, kmer, string_agg(cast(cast(round_even(norm_mean * 10, 0) as bigint) as varchar), ',' order by norm_mean) as y, count(*) as n from combined group by run, idx, position, kmer", "v_signal"))
def collect_sites(spark, sf_dir):
    sites = prep.collect_sites(_combined(spark, sf_dir), ["run", "idx", "position", "kmer"])
    tenths = F.transform("y", lambda v: F.rint(v * 10).cast("long").cast("string"))
    return sites.select("run", "idx", "position", "kmer", F.array_join(tenths, ",").alias("y"), F.size("y").cast("long").alias("n"))


_INJECTED = "case when position % 97 = 90 and read_index % 3 = 0 then 'ACGTC' when position % 98 = 97 then 'ACNTA' when position % 5 = 0 and read_index % 2 = 0 then 'XXXXX' else 'ACGTA' end"


@query(
    "early_stop_positions",
    _sql(
        f"/*with*/ s as (select run as idx, position, {_INJECTED} as kmer from v_signal), shown as (select * from s where kmer <> 'XXXXX'), bad as (select idx, position from shown group by idx, position having count(distinct kmer) > 1 or bool_or(contains(kmer, 'N'))), first as (select idx, min(position) as b from bad group by idx) select shown.idx, position, kmer, count(*) as n from shown left join first on shown.idx = first.idx where b is null or position < b group by all",
        "v_signal",
    ),
)
def early_stop_positions(spark, sf_dir):
    rows = _view(spark, sf_dir, "v_signal").select(F.col("run").alias("idx"), "position", F.expr(_INJECTED).alias("kmer"))
    return prep.unambiguous_positions(rows).groupBy("idx", "position", "kmer").agg(F.count(F.lit(1)).alias("n"))


_OFFSETS = "o as (select *, row_number() over w as exon_ord, coalesce(sum(g_end - g_start + 1) over (w rows between unbounded preceding and 1 preceding), 0) as tx_start from v_exons window w as (partition by tx_id order by case when strand = '-' then -g_start else g_start end)), e as (select *, tx_start + g_end - g_start as tx_end from o)"


@query("exon_offsets", _sql(f"/*with*/ {_OFFSETS} select tx_id, strand, g_start, g_end, cast(exon_ord as int) as exon_ord, cast(tx_start as bigint) as tx_start, cast(tx_end as bigint) as tx_end from e", "v_exons"))
def exon_offsets(spark, sf_dir):
    return prep.exon_offsets(_view(spark, sf_dir, "v_exons"))


@query(
    "tx_to_genome",
    _sql(
        f"/*with*/ {_OFFSETS}, probe as (select distinct 'T' || cast(l_partkey % 25 as varchar) as tx_id, cast(l_orderkey % 4000 as bigint) as position from lineitem) select probe.tx_id, position, cast(case when strand = '-' then g_end - (position - tx_start) else g_start + position - tx_start end as bigint) as g_pos, position - tx_start < 2 or tx_end - position < 2 as masked from probe join e on probe.tx_id = e.tx_id and position between tx_start and tx_end",
        "v_exons",
    ),
)
def tx_to_genome(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    probe = lines.select(F.concat(F.lit("T"), (F.col("l_partkey") % 25).cast("string")).alias("tx_id"), (F.col("l_orderkey") % 4000).alias("position")).distinct()
    return prep.tx_to_genome(probe, prep.exon_offsets(_view(spark, sf_dir, "v_exons")))


@query("read_last_wins", _sql("/*with*/ r as (select distinct condition as gene_id, read_index, position as tx_ord from v_signal) select gene_id, read_index, max(tx_ord) as tx_ord from r group by all", "v_signal"))
def read_last_wins(spark, sf_dir):
    rows = _view(spark, sf_dir, "v_signal").select(F.col("condition").alias("gene_id"), "read_index", F.col("position").alias("tx_ord")).distinct()
    return prep.last_transcript_wins(rows).select("gene_id", "read_index", "tx_ord")


@query("ids_two_conditions", _sql("select cast(position as varchar) as idx, count(distinct condition) as n_conditions from v_signal where level > 80 group by 1 having count(distinct condition) >= 2", "v_signal"))
def ids_two_conditions(spark, sf_dir):
    rows = _view(spark, sf_dir, "v_signal").filter("level > 80").withColumn("idx", F.col("position").cast("string"))
    return align.ids_across_conditions(rows)


@query(
    "site_intersection",
    _sql("/*with*/ r as (select distinct idx, position, kmer, run from v_signal), a as (select idx, count(distinct run) as n from r group by idx) select r.idx, position, kmer from r join a on r.idx = a.idx group by r.idx, position, kmer, n having count(*) = n", "v_signal"),
)
def site_intersection(spark, sf_dir):
    return align.shared_sites(_view(spark, sf_dir, "v_signal"))


# A finer site: a part is missing from some of the runs that its id has.
_PARTS = "parts as (select 'T' || cast(l_partkey % 10 as varchar(20)) as idx, l_partkey as position, {kmer} as kmer, l_returnflag || '-' || l_linestatus as run from lineitem)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _PARTS.removeprefix("parts as (").removesuffix(")").format(kmer=_kmer_sql("l_partkey", True)).replace("from lineitem", "from {source}").replace("varchar(20)", "string")
    return spark.sql(sql, source=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


_PARTS_SQL = _PARTS.format(kmer=_kmer_sql("l_partkey", False))


@query(
    "site_intersection_whole",
    f"with {_PARTS_SQL}, r as (select distinct idx, position, kmer, run from parts), a as (select idx, count(distinct run) as n from r group by idx) select r.idx, position, kmer from r join a on r.idx = a.idx group by r.idx, position, kmer, n having count(*) = n",
)
def site_intersection_whole(spark, sf_dir):
    return align.shared_sites(_parts(spark, sf_dir))


@query("group_codes_whole", f"with {_PARTS_SQL}, r as (select distinct position, run from parts) select position, run, cast(row_number() over (partition by position order by run) - 1 as int) as code from r")
def group_codes_whole(spark, sf_dir):
    return align.group_codes(_parts(spark, sf_dir).select("position", "run").distinct(), ["position"], "run")


@query("run_gate", _sql("/*with*/ r as (select idx, position, kmer, condition, run, count(*) as n from v_signal group by all having count(*) between 95 and 105), s as (select idx, position, kmer from r group by all having count(distinct condition) >= 2) select r.idx, r.position, r.kmer, r.run, n from r join s on r.position = s.position and r.idx = s.idx and r.kmer = s.kmer", "v_signal"))
def run_gate(spark, sf_dir):
    kept = align.gate_sites(_view(spark, sf_dir, "v_signal"), 95, 105)
    return kept.groupBy("idx", "position", "kmer", "run").agg(F.count(F.lit(1)).alias("n"))


@query("condition_gate", _sql("/*with*/ c as (select idx, position, kmer, condition, count(*) as n from v_signal group by all having count(*) between 195 and 205), s as (select idx, position, kmer from c group by all having count(*) >= 2) select idx, position, kmer, condition, count(*) as n from v_signal where (idx, position, kmer) in (select (idx, position, kmer) from s) group by all", "v_signal"))
def condition_gate(spark, sf_dir):
    kept = align.gate_sites(_view(spark, sf_dir, "v_signal"), 195, 205, pooling=True)
    return kept.groupBy("idx", "position", "kmer", "condition").agg(F.count(F.lit(1)).alias("n"))


@query("kmer_reference_join", _sql(f"/*with*/ {_COMBINED}, {_REF} select idx, position, combined.kmer, ref_mean, ref_std, count(*) as n from combined join ref on combined.kmer = ref.kmer group by all", "v_signal"))
def kmer_reference_join(spark, sf_dir):
    rows = _combined(spark, sf_dir)
    return align.with_reference(rows, _reference(rows)).groupBy("idx", "position", "kmer", "ref_mean", "ref_std").agg(F.count(F.lit(1)).alias("n"))


@query("percentile_init", _sql(f"/*with*/ {_COMBINED} select idx, position, round(quantile_cont(norm_mean, 0.25), 6) as p25, round(quantile_cont(norm_mean, 0.5), 6) as p50, round(quantile_cont(norm_mean, 0.75), 6) as p75 from combined group by all", "v_signal"))
def percentile_init(spark, sf_dir):
    got = stats.percentiles(_combined(spark, sf_dir), ["idx", "position"])
    return got.select("idx", "position", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")])


@query("group_codes", _sql("/*with*/ r as (select distinct position, run from v_signal) select position, run, cast(row_number() over (partition by position order by run) - 1 as int) as code from r", "v_signal"))
def group_codes(spark, sf_dir):
    rows = _view(spark, sf_dir, "v_signal").select("position", "run").distinct()
    return align.group_codes(rows, ["position"], "run")


_MOMENTS = "m as (select site, count(*) filter (condition = 'click') as n1, avg(norm_mean) filter (condition = 'click') as mean1, var_samp(norm_mean) filter (condition = 'click') as var1, count(*) filter (condition = 'view') as n2, avg(norm_mean) filter (condition = 'view') as mean2, var_samp(norm_mean) filter (condition = 'view') as var2 from v_pair group by site)"


@query("ttest_statistic", _sql(f"/*with*/ {_MOMENTS} select site, n1, n2, n1 + n2 - 2 as df, round((mean1 - mean2) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2) * (1e0 / n1 + 1e0 / n2)), 6) as t from m", "v_pair"))
def ttest_statistic(spark, sf_dir):
    return stats.ttest_moments(_view(spark, sf_dir, "v_pair"), ["site"], ["click", "view"]).select("site", "n1", "n2", "df", F.round("t", 6).alias("t"))


@query("ttest_prefilter", _sql(f"/*with*/ {_MOMENTS}, t as (select site, n1 + n2 - 2 as df, (mean1 - mean2) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2) * (1e0 / n1 + 1e0 / n2)) as t from m), p as (select site, {model_sql.student_p('t', 'df')} as p from t) select site, round(p, 9) as p from p where p < 0.5", "v_pair"))
def ttest_prefilter(spark, sf_dir):
    return stats.prefilter(_view(spark, sf_dir, "v_pair"), "t-test", 0.5, ["click", "view"], ["site"]).select("site", F.round("p", 9).alias("p"))


# Shares of high levels stand for mixing rates: by (position, condition), with their counts.
_RATES = "rates as (select position, condition, avg(case when level > 80 then 1e0 else 0e0 end) as p, cast(count(*) as double) as n from v_signal group by all)"


def _rates(spark, sf_dir):
    rows = _view(spark, sf_dir, "v_signal")
    return rows.groupBy("position", "condition").agg(F.avg(F.when(F.col("level") > 80, 1.0).otherwise(0.0)).alias("p"), F.count(F.lit(1)).cast("double").alias("n"))


_Z = "(x.p - y.p) / sqrt(x.p * (1 - x.p) / x.n + y.p * (1 - y.p) / y.n)"


@query("ztest_pairwise", _sql(f"/*with*/ {_RATES}, z as (select x.position, x.condition as a, y.condition as b, {_Z} as z from rates x join rates y on x.position = y.position and x.condition < y.condition) select position, a, b, round(z, 6) as z, round({norm_two_sided_sql('z')}, 9) as p from z", "v_signal"))
def ztest_pairwise(spark, sf_dir):
    rates = _rates(spark, sf_dir)
    x, y = rates.select("position", F.col("condition").alias("a"), F.col("p").alias("p1"), F.col("n").alias("n1")), rates.select("position", F.col("condition").alias("b"), F.col("p").alias("p2"), F.col("n").alias("n2"))
    z = x.join(y, "position").filter("a < b").withColumn("z", stats.ztest(F.col("p1"), F.col("p2"), F.col("n1"), F.col("n2")))
    return z.withColumn("p", stats.two_sided("z")).select("position", "a", "b", F.round("z", 6).alias("z"), F.round("p", 9).alias("p"))


@query(
    "ztest_one_vs_rest",
    _sql(
        f"/*with*/ {_RATES}, x as (select * from rates), y as (select x.position, x.condition, avg(r.p) as p, round_even(avg(r.n), 0) as n from x join rates r on x.position = r.position and x.condition <> r.condition group by all), z as (select x.position, x.condition, {_Z} as z from x join y on x.position = y.position and x.condition = y.condition) select position, condition, round(z, 6) as z, round({norm_two_sided_sql('z')}, 9) as p from z",
        "v_signal",
    ),
)
def ztest_one_vs_rest(spark, sf_dir):
    groups = _rates(spark, sf_dir).groupBy("position").agg(F.collect_list(F.struct("condition", "p", "n")).alias("g"))
    mean = lambda f: F.expr(f"aggregate(filter(g, r -> r.condition <> x.condition), 0D, (a, r) -> a + r.{f}) / size(filter(g, r -> r.condition <> x.condition))")
    rows = groups.select("position", "g", F.explode("g").alias("x")).withColumn("p2", mean("p")).withColumn("n2", mean("n"))
    z = rows.withColumn("z", stats.ztest(F.col("x.p"), F.col("p2"), F.col("x.n"), F.col("n2")))
    return z.withColumn("p", stats.two_sided("z")).select("position", F.col("x.condition").alias("condition"), F.round("z", 6).alias("z"), F.round("p", 9).alias("p"))


_NORMALS = "g as (select position, condition, avg(level) as mu, var_samp(level) as v from v_signal group by all), pair as (select x.position, x.condition as a, y.condition as b, case when x.v < y.v then x.mu else y.mu end as mx, case when x.v < y.v then y.mu else x.mu end as my, least(x.v, y.v) as vx, greatest(x.v, y.v) as vy from g x join g y on x.position = y.position and x.condition < y.condition)"
_CROSS = stats.overlap_sql("mx", "vx", "my", "vy")


def _cdfs(who: str, end: str) -> str:
    return norm_cdf_sql(end, f"m{who}", f"sqrt(v{who})")


@query(
    "normal_overlap",
    _sql(
        f"/*with*/ {_NORMALS}, c as (select *, {_CROSS['low']} as low, {_CROSS['high']} as high from pair), f as (select *, {_cdfs('x', 'low')} as xl, {_cdfs('y', 'low')} as yl, {_cdfs('x', 'high')} as xh, {_cdfs('y', 'high')} as yh from c) select position, a, b, round(1e0 - abs(yl - xl) - abs(yh - xh), 6) as overlap, (xl < 0.1 and yl < 0.1) or (xl > 0.9 and yl > 0.9) or (xh < 0.1 and yh < 0.1) or (xh > 0.9 and yh > 0.9) as tails from f",
        "v_signal",
    ),
)
def normal_overlap(spark, sf_dir):
    g = _view(spark, sf_dir, "v_signal").groupBy("position", "condition").agg(F.avg("level").alias("mu"), F.var_samp("level").alias("v"))
    x, y = g.toDF("position", "a", "mu0", "var0"), g.toDF("position", "b", "mu1", "var1")
    pairs = stats.with_overlap(x.join(y, "position").filter("a < b"))
    return pairs.select("position", "a", "b", F.round("overlap", 6).alias("overlap"), "tails")


@query(
    "cluster_confidence",
    _sql(
        f"/*with*/ {_COMBINED}, {_REF}, g as (select idx, position, combined.kmer, condition, avg(norm_mean) as mu, min(ref_mean) as m, min(ref_std) as s from combined join ref on combined.kmer = ref.kmer group by all) select idx, position, kmer, condition, round({erfc_sql(f'(abs(mu - m) / (s * {2**0.5!r}e0))')}, 6) as conf, case when mu > m then 'higher' else 'lower' end as side from g",
        "v_signal",
    ),
)
def cluster_confidence(spark, sf_dir):
    rows = _combined(spark, sf_dir)
    g = align.with_reference(rows, _reference(rows)).groupBy("idx", "position", "kmer", "condition").agg(F.avg("norm_mean").alias("mu"), F.min("ref_mean").alias("ref_mean"), F.min("ref_std").alias("ref_std"))
    got = g.withColumn("conf", stats.confidence("mu", "ref_mean", "ref_std"))
    return got.select("idx", "position", "kmer", "condition", F.round("conf", 6).alias("conf"), F.when(F.col("mu") > F.col("ref_mean"), "higher").otherwise("lower").alias("side"))


@query("result_columns_pivot", _sql("select position, " + ", ".join(f"round(avg(case when run = '{r}' and level > 80 then 1e0 when run = '{r}' then 0e0 end), 9) as \"mod_rate_{r}\", count(*) filter (run = '{r}') as \"coverage_{r}\"" for c in RUNS for r in RUNS[c]) + " from v_signal group by position", "v_signal"))
def result_columns_pivot(spark, sf_dir):
    rows = _view(spark, sf_dir, "v_signal")
    high = F.when(F.col("level") > 80, 1.0).otherwise(0.0)
    aggregates = [x for c in RUNS for r in RUNS[c] for x in (F.round(F.avg(F.when(F.col("run") == r, high)), 9).alias(f"mod_rate_{r}"), F.count_if(F.col("run") == r).alias(f"coverage_{r}"))]
    return rows.groupBy("position").agg(*aggregates)


_DIRECTIONS = "select cast(position as varchar) as id, position, right(kmer, 2) as kmer, condition, case when avg(level) > 79.7 then 'higher' else 'lower' end as mod_assignment from v_signal group by position, kmer, condition"


@query("majority_direction", _sql(f"/*with*/ d as ({_DIRECTIONS}), c as (select kmer, case when count(*) filter (mod_assignment = 'higher') > count(*) filter (mod_assignment = 'lower') then 'higher' else 'lower' end as chosen from d group by kmer) select d.* from d join c on d.kmer = c.kmer where mod_assignment = chosen", "v_signal"))
def majority_direction(spark, sf_dir):
    rows = _view(spark, sf_dir, "v_signal").groupBy("position", "kmer", "condition").agg(F.when(F.avg("level") > 79.7, "higher").otherwise("lower").alias("mod_assignment"))
    return post.filter_majority(rows.select(F.col("position").cast("string").alias("id"), "position", F.right("kmer", F.lit(2)).alias("kmer"), "condition", "mod_assignment"))


@query("resume_anti", _sql("select idx, position, run, count(*) as n from v_signal where idx not in (select idx from v_signal where position % 10 < 4) group by all", "v_signal"))
def resume_anti(spark, sf_dir):
    rows = _view(spark, sf_dir, "v_signal")
    return prep.skip_done(rows, rows.filter("position % 10 < 4")).groupBy("idx", "position", "run").agg(F.count(F.lit(1)).alias("n"))


@query("rank_sites", _sql(f"/*with*/ {_RATES}, z as (select x.position, x.condition as a, y.condition as b, {_Z} as z from rates x join rates y on x.position = y.position and x.condition < y.condition) select position, a || b as id, '-' as kmer, round({norm_two_sided_sql('z')}, 9) as pval from z order by pval nulls last, id, position limit 20", "v_signal"))
def rank_sites(spark, sf_dir):
    rows = ztest_pairwise(spark, sf_dir).select("position", F.concat("a", "b").alias("id"), F.lit("-").alias("kmer"), F.col("p").alias("pval"))
    return post.rank_sites(rows, "pval", 20)


_PACKED = f"{_COMBINED}, {_REF}, runs as (select idx, position, kmer, run, count(*) as n from combined group by all having count(*) between 15 and 1000), held as (select c.* from combined c join runs r on c.idx = r.idx and c.position = r.position and c.kmer = r.kmer and c.run = r.run), named as (select idx, position, kmer, list_sort(list(distinct run)) as names, list(struct_pack(r := run, y := norm_mean) order by run, norm_mean) as obs from held group by all), packed as (select named.* exclude (obs), ref_mean as m, ref_std as s, list_transform(obs, lambda o: o.y) as y, list_transform(obs, lambda o: list_position(names, o.r)) as g from named join ref on named.kmer = ref.kmer)"


def _recursive(body: str) -> str:
    return _sql(f"/*with*/ {_PACKED}, {model_sql.fitted('packed')} {body}", "v_signal").replace("with ", "with recursive ", 1)


def _rounded(df: DataFrame) -> DataFrame:
    """A result table with as many digits as two summation orders agree on."""
    digits = lambda c: 9 if c.startswith("pval") else 4 if c.startswith("z_score") else 6
    return df.select(*[F.round(f"`{c}`", digits(c)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


@query("mixture_fit", _recursive("select idx, position, kmer, round(loc0, 6) as mu0, round(loc1, 6) as mu1, round(b0 / a0, 6) as sigma20, round(b1 / a1, 6) as sigma21, rounds as iterations, converged from fitted"))
def mixture_fit(spark, sf_dir):
    rows = _combined(spark, sf_dir)
    fits = diffmod.fit(rows, _reference(rows), RUNS)
    return fits.select("idx", "position", "kmer", *[F.round(F.col(c)[i], 6).alias(f"{c}{i}") for c in ("mu", "sigma2") for i in (0, 1)], "iterations", "converged")


_TABLE = model_sql.result_sql(RUNS)


@query("diff_table", _recursive(f", {_TABLE}"))
def diff_table(spark, sf_dir):
    rows = _combined(spark, sf_dir)
    return _rounded(diffmod.differential_table(rows, _reference(rows), RUNS))


_LAST = _TABLE.rindex("select idx as id")


@query("majority_table", _recursive(f", {_TABLE[:_LAST]}, d as ({_TABLE[_LAST:]}), c as (select kmer, case when count(*) filter (mod_assignment = 'higher') > count(*) filter (mod_assignment = 'lower') then 'higher' else 'lower' end as chosen from d group by kmer) select d.* from d join c on d.kmer = c.kmer where mod_assignment = chosen"))
def majority_table(spark, sf_dir):
    return post.filter_majority(diff_table(spark, sf_dir))


@query("event_index", _sql("select contig, read_index, min(position) as first_position, count(*) as n_events from v_events group by contig, read_index", "v_events"))
def event_index(spark, sf_dir):
    return prep.event_index(_view(spark, sf_dir, "v_events"))


@query("prep_status", _sql(f"/*with*/ s as (select run || '-' || cast(position // 10 as varchar) as idx, position, {_INJECTED} as kmer from v_signal), shown as (select * from s where kmer <> 'XXXXX'), bad as (select distinct idx from (select idx, position from shown group by idx, position having count(distinct kmer) > 1 or bool_or(contains(kmer, 'N')))) select s.idx, max(bad.idx) is null as complete from s left join bad on s.idx = bad.idx group by s.idx", "v_signal"))
def prep_status(spark, sf_dir):
    rows = _view(spark, sf_dir, "v_signal").select(F.concat("run", F.lit("-"), F.expr("cast(position div 10 as string)")).alias("idx"), "position", F.expr(_INJECTED).alias("kmer"))
    return prep.complete_ids(rows)


@query(
    "transcript_sites",
    _sql(
        "/*with*/ reads as (select distinct contig, read_index from v_events), capped as (select * from reads qualify row_number() over (partition by contig order by read_index) <= 501), c as (select v.contig as idx, v.read_index, position + 2 as position, round_even(sum(event_level_mean * length) / sum(length), 1) as x from v_events v join capped on v.contig = capped.contig and v.read_index = capped.read_index where reference_kmer = model_kmer group by all), usable as (select idx, read_index from c group by all having count(*) > 1) select c.idx, position, count(*) as n, cast(sum(cast(round_even(x * 10, 0) as bigint)) as bigint) as tenths, min(x) as low, max(x) as high from c join usable on c.idx = usable.idx and c.read_index = usable.read_index group by all",
        "v_events",
    ),
)
def transcript_sites(spark, sf_dir):
    sites = dataprep.transcript_sites(_view(spark, sf_dir, "v_events"), 1, 500).sites
    tenths = F.aggregate(F.transform("y", lambda v: F.rint(v * 10).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
    return sites.select("idx", "position", F.size("y").cast("long").alias("n"), tenths.alias("tenths"), F.array_min("y").alias("low"), F.array_max("y").alias("high"))


# Pooled runs: a condition's reads are one group.
_POOLED = _PACKED.replace("select idx, position, kmer, run, count(*) as n from combined", "select idx, position, kmer, condition as run, count(*) as n from combined").replace("c.run = r.run", "c.condition = r.run").replace("distinct run", "distinct condition").replace("r := run", "r := condition").replace("order by run, norm_mean", "order by condition, norm_mean")


@query("pooled_table", _recursive(f", {model_sql.result_sql({c: [c] for c in RUNS})}").replace(_PACKED, _POOLED))
def pooled_table(spark, sf_dir):
    rows = _combined(spark, sf_dir)
    return _rounded(diffmod.differential_table(rows, _reference(rows), RUNS, method=Method(pooling=True)))


#: Genes of two transcripts each; a transcript's letters follow from its number and the place.
_LETTER = "substring('ACGT', cast(({i} * {i} + 3 * {i} + {t}) {div} 5 % 4 as int) + 1, 1)"
_TX_EVENTS = "select 'T' || cast(l_partkey % 20 as varchar(20)) || '.1' as contig, l_suppkey as read_index, cast(l_orderkey % 2600 as bigint) as position, 'ACGTA' as reference_kmer, case when l_quantity = 50 then 'NNNNN' else 'ACGTA' end as model_kmer, l_quantity as length, l_extendedprice as event_level_mean from lineitem"


@query(
    "genome_sites",
    _sql(
        f"/*with*/ {_OFFSETS}, v as (select *, split_part(contig, '.', 1) as tx_id, 'G' || cast(cast(substring(split_part(contig, '.', 1), 2) as bigint) // 2 as varchar) as gene from ({_TX_EVENTS})), capped as (select * from (select distinct gene, tx_id, read_index from v) qualify row_number() over (partition by gene order by tx_id, read_index) <= 151), "
        "c as (select v.gene, v.tx_id, v.read_index, position + 2 as position, round_even(sum(event_level_mean * length) / sum(length), 1) as x from v join capped on v.tx_id = capped.tx_id and v.read_index = capped.read_index where reference_kmer = model_kmer group by all), usable as (select * from c qualify count(*) over (partition by tx_id, read_index) > 1), "
        "latest as (select * from usable qualify tx_id = max(tx_id) over (partition by gene, read_index)), placed as (select gene, position as p, cast(substring(latest.tx_id, 2) as bigint) as t, x, case when strand = '-' then g_end - (position - tx_start) else g_start + position - tx_start end as g_pos from latest join e on latest.tx_id = e.tx_id and position between tx_start and tx_end where position - tx_start >= 2 and tx_end - position >= 2) "
        "select gene as idx, cast(g_pos as bigint) as position, " + " || ".join(_LETTER.format(i=f"(p + {d})", t="t", div="//") for d in range(-2, 3)) + " as kmer, count(*) as n, cast(sum(cast(round_even(x * 10, 0) as bigint)) as bigint) as tenths from placed group by all",
        "v_exons",
    ),
)
def genome_sites(spark, sf_dir, placed=False):
    events = spark.sql(_TX_EVENTS.replace("from lineitem", "from {source}").replace("varchar(20)", "string"), source=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    exons = _view(spark, sf_dir, "v_exons").withColumn("gene_id", F.expr("concat('G', cast(cast(substring(tx_id, 2) as bigint) div 2 as string))"))
    letter = _LETTER.format(i="i", t="cast(substring(tx_id, 2) as bigint)", div="div")
    length = exons.groupBy("tx_id").agg(F.sum(F.col("g_end") - F.col("g_start") + 1).alias("n"))
    exons = exons.withColumn("place", -F.expr("cast(substring(tx_id, 2) as bigint)")) if placed else exons
    fasta = length.select("tx_id", F.expr(f"array_join(transform(sequence(0L, n - 1), i -> {letter}), '')").alias("seq"))
    sites = dataprep.genome_sites(events, exons, fasta, 1, 150).sites
    tenths = F.aggregate(F.transform("y", lambda v: F.rint(v * 10).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
    return sites.select("idx", "position", "kmer", F.size("y").cast("long").alias("n"), tenths.alias("tenths"))


# The annotation lists a gene's transcripts from the one of the highest number down: not in the order of their ids.
ORACLES["genome_sites_annotated_order"] = ORACLES["genome_sites"].replace("order by tx_id, read_index", "order by cast(substring(tx_id, 2) as bigint) desc, read_index").replace("tx_id = max(tx_id) over", "cast(substring(tx_id, 2) as bigint) = min(cast(substring(tx_id, 2) as bigint)) over")


@query("genome_sites_annotated_order", ORACLES["genome_sites_annotated_order"])
def genome_sites_annotated_order(spark, sf_dir):
    """Which reads a gene's cap takes, and which transcript wins a read, go by the annotation's order."""
    return genome_sites(spark, sf_dir, placed=True)


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query writes and reads, gone when the driver's Python ends: in the cluster's shared folder, or, on a local master without one, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sigspark-")
    made = f"{folder}/{name}-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, made)
    return made


def _removed(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@query("site_store_round_trip", _sql(f"/*with*/ {_COMBINED} select run || ':' || idx as idx, position, kmer, string_agg(cast(cast(round_even(norm_mean * 10, 0) as bigint) as varchar), ',' order by norm_mean) as y from combined group by run, idx, position, kmer", "v_signal"))
def site_store_round_trip(spark, sf_dir):
    folder = _scratch(spark, "sites")
    sites = prep.collect_sites(_combined(spark, sf_dir).withColumn("idx", F.concat("run", F.lit(":"), "idx")))
    writers.write_site_store(sites, folder)
    tenths = F.transform("y", lambda v: F.rint(v * 10).cast("long").cast("string"))
    return readers.read_site_store(spark, f"{folder}/data.json").select("idx", "position", "kmer", F.array_join(tenths, ",").alias("y"))


@query("site_slices", _sql(f"/*with*/ {_COMBINED} select run || ':' || idx as idx, position, kmer, string_agg(cast(cast(round_even(norm_mean * 10, 0) as bigint) as varchar), ',' order by norm_mean) as y from combined where (run || ':' || idx) in (select run || ':T' || cast(i as varchar) from (select distinct run from v_signal), range(10) as r(i) where i % 3 = 1) group by run, idx, position, kmer", "v_signal"))
def site_slices_of_ids(spark, sf_dir):
    """The store's slices of some ids of each run, found in its index."""
    folder = _scratch(spark, "slices")
    sites = prep.collect_sites(_combined(spark, sf_dir).withColumn("idx", F.concat("run", F.lit(":"), "idx")))
    writers.write_site_store(sites, folder)
    site_slices.write_index(spark, f"{folder}/data.json", f"{folder}/data.index")
    ids = [f"{run}:T{i}" for c in RUNS for run in RUNS[c] for i in (1, 4, 7)]
    tenths = F.transform("y", lambda v: F.rint(v * 10).cast("long").cast("string"))
    return site_slices.read_slices(spark, folder, ids).select("idx", "position", "kmer", F.array_join(tenths, ",").alias("y"))


# Reference signal of 5-mers from the samples themselves.
@query(
    "own_kmer_reference",
    _sql(f"/*with*/ {_COMBINED}, q as (select kmer, quantile_disc(norm_mean, [0.25, 0.5, 0.75]) as q, count(*) as n from combined group by kmer) select kmer, round(q[2], 6) as ref_mean, round(greatest((q[3] - q[1]) / {align.QUARTILES!r}e0, 0.1e0), 6) as ref_std, n from q", "v_signal"),
)
def own_kmer_reference(spark, sf_dir):
    """Quantiles are exact for any number of observations."""
    got = align.own_reference(_combined(spark, sf_dir))
    return got.select("kmer", F.round("ref_mean", 6).alias("ref_mean"), F.round("ref_std", 6).alias("ref_std"), "n")


@query("native_store_ids", _sql(f"/*with*/ {_COMBINED}, wanted as (select run || ':' || idx as idx from v_signal group by run, idx having count(*) % 2 = 0) select run || ':' || idx as idx, position, kmer, string_agg(cast(cast(round_even(norm_mean * 10, 0) as bigint) as varchar), ',' order by norm_mean) as y from combined where (run || ':' || idx) in (select idx from wanted) group by run, idx, position, kmer", "v_signal"))
def native_store_ids(spark, sf_dir):
    """The native store written, and the ids of a table read back: only their buckets are read."""
    path = _scratch(spark, "native")
    writers.write_native(prep.collect_sites(_combined(spark, sf_dir).withColumn("idx", F.concat("run", F.lit(":"), "idx"))), path)
    wanted = _view(spark, sf_dir, "v_signal").groupBy("run", "idx").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 0").select(F.concat("run", F.lit(":"), "idx").alias("idx"))
    tenths = F.transform("y", lambda v: F.rint(v * 10).cast("long").cast("string"))
    return readers.read_native(spark, path, wanted).select("idx", "position", "kmer", F.array_join(tenths, ",").alias("y"))


# Sites of odd positions get new reads after the first fit.
@query("refitted_table", ORACLES["mixture_fit"].replace("round(loc0, 6) as mu0, round(loc1, 6) as mu1, round(b0 / a0, 6) as sigma20, round(b1 / a1, 6) as sigma21, rounds as iterations, converged", "position % 2 = 1 as changed, case when position % 2 = 0 then round(loc0, 6) end as mu0, case when position % 2 = 0 then round(loc1, 6) end as mu1, case when position % 2 = 0 then rounds else 0 end as iterations, converged"))
def refitted_table(spark, sf_dir):
    """Models refitted from saved ones: sites without new reads keep theirs (the values shown), the others begin with them."""
    # Both fits read the observations several times: they are combined once.
    staged, path = _scratch(spark, "combined"), _scratch(spark, "models")
    _combined(spark, sf_dir).write.parquet(staged)
    rows = spark.read.parquet(staged)
    reference = _reference(rows)
    writers.write_models(diffmod.fit(rows.filter("read_index % 3 > 0 or position % 2 = 0"), reference, RUNS), path)
    saved = readers.read_models(spark, path)
    fits = diffmod.fit(rows, reference, RUNS, models=saved)
    before = saved.select(*align.SITE, F.col("digest").alias("before"))
    told = fits.join(before, list(align.SITE), "left").withColumn("changed", ~F.col("digest").eqNullSafe(F.col("before")))
    same = lambda c: F.when(~F.col("changed"), c)
    return told.select("idx", "position", "kmer", "changed", *[same(F.round(F.col("mu")[i], 6)).alias(f"mu{i}") for i in (0, 1)], same(F.col("iterations")).otherwise(0).alias("iterations"), "converged")


_CUT_EVENTS = "select 'T' || cast(l_partkey % 20 as varchar(20)) as contig, l_suppkey as read_index, cast(l_orderkey % 2600 as bigint) as position, case when l_orderkey % 97 = 90 and l_partkey % 20 < 4 and l_suppkey % 3 = 0 then 'ACGTC' when l_orderkey % 98 = 97 and l_partkey % 20 = 7 then 'ACNTA' when l_orderkey % 5 = 0 and l_suppkey % 2 = 0 then 'XXXXX' else 'ACGTA' end as reference_kmer, case when l_quantity = 50 then 'NNNNN' end as other, l_quantity as length, l_extendedprice as event_level_mean from lineitem"


@query(
    "prep_log",
    f"with v as ({_CUT_EVENTS}), seen as (select distinct contig, read_index from v), reads as (select * from seen qualify row_number() over (partition by contig order by read_index) <= 301), c as (select v.contig as idx, v.read_index, position, reference_kmer as kmer from v join reads on v.contig = reads.contig and v.read_index = reads.read_index where other is null group by all), "
    "obs as (select * from c qualify count(*) over (partition by idx, read_index) > 1), n as (select idx, count(distinct read_index) as n_reads from obs group by idx), bad as (select distinct idx from (select idx, position from obs where kmer <> 'XXXXX' group by idx, position having count(distinct kmer) > 1 or bool_or(contains(kmer, 'N')))) "
    "select i.idx, coalesce(n_reads, 0) as n_reads, bad.idx is null as complete from (select distinct contig as idx from reads) i left join n on i.idx = n.idx left join bad on i.idx = bad.idx",
)
def prep_log(spark, sf_dir):
    """The log of a job that is committed: of every id its reads, and whether a position with several 5-mers cut its sites short."""
    return readers.read_prep_log(spark, _prepared(spark, sf_dir))


def _prepared(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a committed job's outputs."""
    folder = _scratch(spark, "prepared")
    events = spark.sql(_CUT_EVENTS.replace("from lineitem", "from {source}").replace("varchar(20)", "string"), source=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    commit = Commit(spark, folder)
    combined = commit.staged(prep.combine_reads(events.withColumn("model_kmer", F.coalesce("other", "reference_kmer"))), "combined")
    writers.write_prepared(commit, dataprep.transcripts_of(combined, 1, 300))
    commit.finish()
    return folder


@query(
    "annotated_sequences",
    "select 'T' || cast(p_partkey as varchar) as tx_id, 'G' || cast(p_partkey % 50 as varchar) as gene_id, 'chr' || cast(p_partkey % 3 as varchar) as chr, case when p_partkey % 2 = 0 then '+' else '-' end as strand, 100 * p_partkey + 1000 * i as g_start, 100 * p_partkey + 1000 * i + p_size as g_end, replace(upper(p_type), ' ', '') as seq, cast(1 as bigint) as n from part, range(1, 3) as r(i)",
)
def annotated_sequences(spark, sf_dir):
    """A FASTA and a GTF file of two exons a part, written and read."""
    folder = _scratch(spark, "annotation")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("chr", F.expr("concat('chr', p_partkey % 3)")).withColumn("strand", F.expr("if(p_partkey % 2 = 0, '+', '-')"))
    part.select(F.expr(r"concat('>T', p_partkey, '.1 part>', p_size, ' gene:G', p_partkey % 50, '.2\n', replace(upper(p_type), ' ', '\n'))").alias("value")).write.text(f"{folder}/fasta")
    exon = r"""concat_ws('\t', chr, 'x', 'exon', cast(100 * p_partkey + 1000 * i as string), cast(100 * p_partkey + 1000 * i + p_size as string), '.', strand, '.', concat('gene_id "G', p_partkey % 50, '.2"; transcript_id "T', p_partkey, '.1"; exon_number ', i, ';'))"""
    part.withColumn("i", F.explode(F.array(F.lit(1), F.lit(2)))).select(F.expr(exon).alias("value")).write.text(f"{folder}/gtf")
    fasta = readers.read_fasta(spark, f"{folder}/fasta")
    exons = readers.read_annotation(spark, f"{folder}/gtf", fasta)
    rows = exons.join(fasta, ["tx_id", "gene_id"])
    return rows.groupBy("tx_id", "gene_id", "chr", "strand", "g_start", "g_end", "seq").agg(F.count(F.lit(1)).alias("n"))


@query(
    "gff3_genes",
    "select 'T' || cast(p_partkey as varchar) as tx_id, 'G' || cast(p_partkey % 50 as varchar) as gene_id, 'chr' || cast(p_partkey % 3 as varchar) as chr, case when p_partkey % 2 = 0 then '+' else '-' end as strand, count(*) as exons, min(100 * p_partkey + 1000 * i) as low, max(100 * p_partkey + 1000 * i + p_size) as high, cast(row_number() over (partition by p_partkey % 50 order by p_partkey desc) as int) as line_order from part, range(1, 3) as r(i) group by p_partkey",
)
def gff3_genes(spark, sf_dir):
    """A GFF3 file, whose transcripts take their genes from the sequences' headers; a gene's transcripts are numbered in the order of its lines."""
    folder = _scratch(spark, "gff3")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part.select(F.expr(r"concat('>T', p_partkey, '.1 cdna gene:G', p_partkey % 50, '.2\nACGT')").alias("value")).write.text(f"{folder}/fasta")
    lines = part.select("p_partkey", F.expr("concat('chr', p_partkey % 3)").alias("chr"), F.expr("if(p_partkey % 2 = 0, '+', '-')").alias("strand"), F.expr("explode(array(0, 1, 2))").alias("i"), "p_size")
    line = r"""concat_ws('\t', chr, 'x', if(i = 0, 'mRNA', 'exon'), cast(100 * p_partkey + 1000 * i as string), cast(100 * p_partkey + 1000 * i + p_size as string), '.', strand, '.', if(i = 0, concat('ID=transcript:T', p_partkey), concat('Parent=transcript:T', p_partkey, '.1;rank=', i)))"""
    # The files' names are in the order of their lines: transcripts of the highest numbers first.
    lines.repartitionByRange(4, F.desc("p_partkey")).sortWithinPartitions(F.desc("p_partkey"), "i").select(F.expr(line).alias("value")).write.text(f"{folder}/gff3")
    exons = readers.read_annotation(spark, f"{folder}/gff3", readers.read_fasta(spark, f"{folder}/fasta"), placed=True)
    rows = exons.groupBy("tx_id", "gene_id", "chr", "strand", "place").agg(F.count(F.lit(1)).alias("exons"), F.min("g_start").alias("low"), F.max("g_end").alias("high"))
    return rows.withColumn("line_order", F.row_number().over(Window.partitionBy("gene_id").orderBy("place"))).drop("place")


@query("explicit_ids", _sql("/*with*/ n as (select idx, run, position, kmer, condition, count(*) as n from v_signal where idx in ('T2', 'T5', 'T8') group by all having count(*) between 95 and 105), s as (select idx, position, kmer from n group by all having count(distinct condition) >= 2) select n.idx, n.position, n.kmer, n.run from n join s on n.idx = s.idx and n.position = s.position and n.kmer = s.kmer", "v_signal"))
def explicit_ids(spark, sf_dir):
    """The runs that the model uses at the sites of given ids, whatever the number of conditions that have them."""
    return align.qualified_runs(_view(spark, sf_dir, "v_signal"), 95, 105, ids=["T2", "T5", "T8"]).select("idx", "position", "kmer", "run")


@query("event_files", _sql("select contig, read_index, position + 2 as position, reference_kmer, round_even(sum(event_level_mean * length) / sum(length), 1) as norm_mean from v_events where reference_kmer = model_kmer group by contig, read_index, position, reference_kmer", "v_events"))
def event_files(spark, sf_dir):
    """Events as compressed tables of 15 columns, written, read by position and combined."""
    path = _scratch(spark, "events")
    rows = _view(spark, sf_dir, "v_events").withColumns({"start_idx": F.lit(7).cast("long"), "end_idx": F.expr("cast(7 + length as long)")})
    names = [c.split()[0] for c in readers.EVENTS.split(", ")]
    table = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names])
    table.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    return prep.combine_events(prep.successful_alignments(readers.read_events(spark, path))).select("contig", "read_index", "position", "reference_kmer", "norm_mean")


@query("samples_union", _sql(f"/*with*/ {_COMBINED} select condition, run, idx, position, kmer, norm_mean, count(*) as n from combined group by all", "v_signal"))
def samples_union(spark, sf_dir):
    """The runs' stores, each in a folder of its own, read as the samples of a design."""
    folder, rows = _scratch(spark, "samples"), _combined(spark, sf_dir)
    for label in (r for c in RUNS for r in RUNS[c]):
        writers.write_site_store(prep.collect_sites(rows.filter(F.col("run") == label)), f"{folder}/{label}")
    design = config.parse({"data": {c: {r.removeprefix(f"{c}-"): f"{folder}/{r}" for r in RUNS[c]} for c in RUNS}, "out": folder})
    return readers.read_samples(spark, design.data).groupBy("condition", "run", "idx", "position", "kmer", "norm_mean").agg(F.count(F.lit(1)).alias("n"))


@query("prep_counts", ORACLES["prep_log"].replace("select i.idx, coalesce(n_reads, 0) as n_reads, bad.idx is null as complete from", "select i.idx, n_reads from").replace(" left join n on", " join n on"))
def prep_counts(spark, sf_dir):
    """The counts of a committed job: ids with a usable read."""
    return readers.read_readcounts(spark, _prepared(spark, sf_dir))


@query("result_files", ORACLES["diff_table"])
def result_files(spark, sf_dir):
    """The result table written by a job that commits it with its models, and read back."""
    rows = _combined(spark, sf_dir)
    commit = Commit(spark, _scratch(spark, "result"))
    writers.write_models(diffmod.fit(rows, _reference(rows), RUNS), commit.path("models"))
    writers.write_result_table(result.result_table(spark.read.parquet(commit.path("models")), RUNS), commit.path("diffmod.table"))
    commit.finish()
    return _rounded(readers.read_result_table(spark, f"{commit.folder}/diffmod.table"))


@query("saved_models", ORACLES["mixture_fit"])
def saved_models(spark, sf_dir):
    """Models written and read back."""
    rows, path = _combined(spark, sf_dir), _scratch(spark, "saved")
    writers.write_models(diffmod.fit(rows, _reference(rows), RUNS), path)
    fits = readers.read_models(spark, path)
    return fits.select("idx", "position", "kmer", *[F.round(F.col(c)[i], 6).alias(f"{c}{i}") for c in ("mu", "sigma2") for i in (0, 1)], "iterations", "converged")
