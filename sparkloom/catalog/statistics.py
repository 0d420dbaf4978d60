"""ST: statistics over result tables."""

from pyspark.sql import functions as F

from ..functions.draws import sql_poisson1, sql_replicate, sql_uniform
from ..functions.numeric import sql_norm_cdf, sql_norm_ppf
from ..operators import stats as S
from ..plans.tables import table
from .base import query, r


def results(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("workflow"), F.when(k < 50, "base").otherwise("future").alias("config"),
        F.col("value").alias("latency"), k.cast("double").alias("memory"))


RES = """res AS (SELECT event_id, event_type AS workflow, CASE WHEN (props->>'$.k')::BIGINT < 50 THEN 'base' ELSE 'future' END AS config,
value AS latency, (props->>'$.k')::DOUBLE AS memory FROM events)"""
DESC = RES + """,
lg AS (SELECT workflow, config, metric, x FROM (SELECT workflow, config, 'latency' AS metric, latency AS x FROM res
  UNION ALL SELECT workflow, config, 'memory', memory FROM res)),
ds AS (SELECT workflow, config, metric, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max, """ + ", ".join(
    f"quantile_cont(x, {p}) AS {n}" for n, p in S.QUANTILES.items()) + """ FROM lg GROUP BY 1, 2, 3),
des AS (SELECT *, p75 - p25 AS iqr, CASE WHEN mean = 0 THEN 0 ELSE std / mean * 100 END AS cv_pct FROM ds)"""
_COLS = ["mean", "std", "min", "max", *S.QUANTILES, "iqr", "cv_pct"]


def described(spark, d):
    return S.describe_metrics(results(spark, d), ["workflow", "config"], ["latency", "memory"])


@query("ST-01", f"WITH {DESC} SELECT workflow, config, metric, n, {', '.join(f'round({c}, 5) AS {c}' for c in _COLS)} FROM des")
def _(spark, d):
    return described(spark, d).select("workflow", "config", "metric", "n", *[r(c, 5).alias(c) for c in _COLS])


@query("ST-02", f"""WITH {DESC} SELECT a.workflow, a.config, a.metric, round((b.median - a.median) / b.median * 100, 5) AS improvement_pct
FROM des a JOIN des b ON a.workflow = b.workflow AND a.metric = b.metric AND a.config <> 'base' AND b.config = 'base'""")
def _(spark, d):
    return S.vs_baseline(described(spark, d), "base").select("workflow", "config", "metric", r("improvement_pct", 5).alias("improvement_pct"))


@query("ST-03", f"""WITH {RES}, rk AS (SELECT workflow, config, rank() OVER w + (count(*) OVER (PARTITION BY workflow, latency) - 1) / 2 AS rk
FROM res WINDOW w AS (PARTITION BY workflow ORDER BY latency)),
a AS (SELECT workflow, sum(rk) FILTER (WHERE config = 'base') AS r1, count(*) FILTER (WHERE config = 'base') AS nx,
count(*) FILTER (WHERE config <> 'base') AS ny FROM rk GROUP BY 1),
u AS (SELECT workflow, nx, ny, least(r1 - nx * (nx + 1) / 2, nx * ny - (r1 - nx * (nx + 1) / 2)) AS u FROM a),
z AS (SELECT *, -abs((u - nx * ny / 2) / sqrt(nx::DOUBLE * ny * (nx + ny + 1) / 12)) AS z FROM u)
SELECT workflow, nx, ny, round(u, 4) AS u, round(2 * {sql_norm_cdf('z')}, 6) AS p_value FROM z""")
def _(spark, d):
    m = S.mann_whitney(results(spark, d), ["workflow"], "config", "base", "latency")
    return m.withColumn("u", r("u", 4)).withColumn("p_value", r("p_value"))


@query("ST-04", f"""WITH {RES}, a AS (SELECT workflow, count(*) FILTER (WHERE config = 'base') AS nx, count(*) FILTER (WHERE config <> 'base') AS ny,
avg(latency) FILTER (WHERE config = 'base') AS mx, avg(latency) FILTER (WHERE config <> 'base') AS my,
var_samp(latency) FILTER (WHERE config = 'base') AS vx, var_samp(latency) FILTER (WHERE config <> 'base') AS vy FROM res GROUP BY 1),
e AS (SELECT *, (mx - my) / sqrt(((nx - 1) * vx + (ny - 1) * vy) / (nx + ny - 2)) AS d FROM a)
SELECT workflow, nx, ny, round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8
THEN 'medium' ELSE 'large' END AS label FROM e""")
def _(spark, d):
    return S.cohens_d(results(spark, d), ["workflow"], "config", "base", "latency").withColumn("d", r("d"))


REPS = 50


def _pct(p):
    pos = f"(({p}) * (len(b) - 1))"
    return f"(b[floor({pos})::INT + 1] + (b[ceil({pos})::INT + 1] - b[floor({pos})::INT + 1]) * ({pos} - floor({pos})))"


def _adj(q):
    return f"adj_{q}"


@query("ST-05", f"""WITH {RES}, rp AS (SELECT workflow, config, latency, event_id, rep FROM res, range(1, {REPS + 1}) t(rep)),
uu AS MATERIALIZED (SELECT *, {sql_replicate('42', 'event_id')} AS u FROM rp),
w AS (SELECT *, {sql_poisson1('u')} AS w FROM uu),
bs AS (SELECT workflow, config, rep, sum(w * latency) / sum(w) AS stat FROM w GROUP BY 1, 2, 3 HAVING sum(w) > 0),
ob AS (SELECT workflow, config, avg(latency) AS estimate, count(*) AS n, var_pop(latency) AS vp FROM res GROUP BY 1, 2),
sk AS (SELECT workflow, config, avg(pow(latency - estimate, 3)) / pow(any_value(vp), 1.5) AS skew FROM res JOIN ob USING (workflow, config) GROUP BY 1, 2),
g AS (SELECT workflow, config, any_value(n) AS n, any_value(estimate) AS estimate, any_value(skew) / (6 * sqrt(any_value(n))) AS acc,
  list_sort(list(stat)) AS b, avg(CASE WHEN stat < estimate THEN 1.0 ELSE 0.0 END) AS below FROM bs JOIN ob USING (workflow, config)
  JOIN sk USING (workflow, config) GROUP BY 1, 2),
h AS (SELECT *, {sql_norm_ppf('below')} AS z0 FROM g),
i AS (SELECT *, z0 + {sql_norm_ppf('0.025')} AS zl, z0 + {sql_norm_ppf('0.975')} AS zh FROM h),
k AS (SELECT *, z0 + zl / (1 - acc * zl) AS yl, z0 + zh / (1 - acc * zh) AS yh FROM i),
l AS (SELECT *, {sql_norm_cdf('yl')} AS al, {sql_norm_cdf('yh')} AS ah FROM k)
SELECT workflow, config, n, round(estimate, 5) AS estimate, round({_pct('0.025')}, 5) AS ci_low, round({_pct('0.975')}, 5) AS ci_high,
round({_pct('al')}, 5) AS bca_low, round({_pct('ah')}, 5) AS bca_high FROM l""")
def _(spark, d):
    b = S.bootstrap_ci(results(spark, d), ["workflow", "config"], "latency", ["event_id"], REPS)
    return b.select("workflow", "config", "n", *[r(c, 5).alias(c) for c in ("estimate", "ci_low", "ci_high", "bca_low", "bca_high")])


PERMS = 300


@query("ST-06", f"""WITH {RES}, ob AS (SELECT count(*) FILTER (WHERE config = 'base') AS na, count(*) AS n, sum(latency) AS total,
abs(avg(latency) FILTER (WHERE config = 'base') - avg(latency) FILTER (WHERE config <> 'base')) AS obs FROM res),
rk AS (SELECT rep, latency, row_number() OVER (PARTITION BY rep ORDER BY u, event_id) AS rn FROM (
 SELECT rep, latency, event_id, {sql_uniform('perm', "rep || ':' || event_id")} AS u FROM res, range(1, {PERMS + 1}) t(rep))),
st AS (SELECT rep, sum(latency) FILTER (WHERE rn <= na) AS sa FROM rk, ob GROUP BY 1),
df AS (SELECT abs(sa / na - (total - sa) / (n - na)) AS diff, obs FROM st, ob)
SELECT round(max(obs), 6) AS observed, round(avg(diff), 6) AS perm_mean, round(avg(CASE WHEN diff >= obs THEN 1.0 ELSE 0.0 END), 6) AS p_value,
count(*) AS permutations FROM df""")
def _(spark, d):
    p = S.permutation_test(results(spark, d), "config", "base", "latency", "event_id", PERMS)
    return p.select(r("observed").alias("observed"), r("perm_mean").alias("perm_mean"), r("p_value").alias("p_value"), "permutations")


@query("ST-07", f"""WITH {DESC} SELECT workflow, metric, """ + ", ".join(
    f"round(max({m}) FILTER (WHERE config = '{c}'), 5) AS {c}_{m}" for c in ("base", "future") for m in ("median", "iqr", "p95")
) + " FROM des GROUP BY 1, 2")
def _(spark, d):
    t = S.summary_table(described(spark, d), ["base", "future"])
    return t.select("workflow", "metric", *[r(f"{c}_{m}", 5).alias(f"{c}_{m}") for c in ("base", "future") for m in ("median", "iqr", "p95")])


@query("ST-08", f"""WITH {RES} SELECT config, count(*) AS n, round(avg(latency), 5) AS avg_latency, round(avg(memory), 5) AS avg_memory,
round(quantile_cont(latency, 0.5), 5) AS p50, round(quantile_cont(latency, 0.95), 5) AS p95, round(quantile_cont(latency, 0.99), 5) AS p99,
round(avg(latency) / avg(memory), 5) AS latency_per_memory FROM res GROUP BY 1""")
def _(spark, d):
    m = S.mode_summary(results(spark, d), "config", "latency", "memory")
    return m.select("config", "n", *[r(c, 5).alias(c) for c in ("avg_latency", "avg_memory", "p50", "p95", "p99", "latency_per_memory")])


RESAMPLES = 10_000


def _interval(spark, d, statistic):
    b = S.bootstrap_interval(results(spark, d), ["workflow", "config"], "latency", statistic, RESAMPLES)
    return b.select("workflow", "config", "n", *[r(c, 5).alias(c) for c in ("estimate", "ci_low", "ci_high", "bca_low", "bca_high")])


@query("ST-05-median")
def _(spark, d):
    return _interval(spark, d, "median")


@query("ST-05-mean")
def _(spark, d):
    return _interval(spark, d, "mean")


def billed_results(spark, d):
    """Results with a billed duration (whole units) and its cost."""
    rows = results(spark, d).withColumn("billed", F.ceil("latency").cast("double"))
    return rows.withColumn("cost", F.col("billed") * F.col("memory") / 1024)


@query("ST-01-intervals")
def _(spark, d):
    t = S.describe_with_intervals(results(spark, d), ["workflow", "config"], ["latency", "memory"], RESAMPLES)
    return t.select("workflow", "config", "metric", "n", *[r(c, 5).alias(c) for c in (*_COLS, "ci_lower", "ci_upper")])


@query("ST-07-intervals")
def _(spark, d):
    t = S.describe_with_intervals(billed_results(spark, d), ["workflow", "config"], ["latency", "billed", "cost"], RESAMPLES)
    t = S.main_results(t, "latency", "cost", "billed")
    return t.select("workflow", "config", *[r(c, 5).alias(c) for c in t.columns[2:]])


@query("ST-03-significance", f"""WITH {RES}, rk AS (SELECT workflow, config, rank() OVER w + (count(*) OVER (PARTITION BY workflow, latency) - 1) / 2 AS rk
FROM res WINDOW w AS (PARTITION BY workflow ORDER BY latency)),
a AS (SELECT workflow, sum(rk) FILTER (WHERE config = 'base') AS r1, count(*) FILTER (WHERE config = 'base') AS nx,
count(*) FILTER (WHERE config <> 'base') AS ny FROM rk GROUP BY 1),
u AS (SELECT workflow, nx, ny, least(r1 - nx * (nx + 1) / 2, nx * ny - (r1 - nx * (nx + 1) / 2)) AS u FROM a),
z AS (SELECT *, -abs((u - nx * ny / 2) / sqrt(nx::DOUBLE * ny * (nx + ny + 1) / 12)) AS z FROM u),
p AS (SELECT *, 2 * {sql_norm_cdf('z')} AS p FROM z),
m AS (SELECT workflow, avg(latency) FILTER (WHERE config = 'base') AS mx, avg(latency) FILTER (WHERE config <> 'base') AS my,
var_samp(latency) FILTER (WHERE config = 'base') AS vx, var_samp(latency) FILTER (WHERE config <> 'base') AS vy FROM res GROUP BY 1),
e AS (SELECT workflow, u, p, (mx - my) / sqrt(((nx - 1) * vx + (ny - 1) * vy) / (nx + ny - 2)) AS d FROM p JOIN m USING (workflow))
SELECT workflow, round(u, 4) AS u, round(p, 6) AS p_value, p < 0.05 AS significant, round(d, 6) AS cohens_d,
CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect_size FROM e""")
def _(spark, d):
    c = S.compare(results(spark, d), ["workflow"], "config", "base", "latency")
    return c.select("workflow", r("u", 4).alias("u"), r("p_value").alias("p_value"), "significant", r("cohens_d").alias("cohens_d"), "effect_size")
