"""MX and MC: matrices, regression, Monte Carlo."""

import math

from pyspark.sql import functions as F

from ..functions.draws import normal, sql_normal, sql_poisson1, sql_replicate, sql_uniform, uniform
from ..operators import matrix as M
from ..operators import montecarlo as C
from ..plans.joins import attach
from ..plans.tables import spread, table
from .base import query, r


def emb(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding")


LONG = """
lg AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::INT AS col FROM embeddings),
st AS (SELECT col, avg(v) AS mean, var_pop(v) AS variance, min(v) AS min, max(v) AS max,
  CASE WHEN stddev_samp(v) < 1e-10 THEN 1.0 ELSE stddev_samp(v) END AS sd FROM lg GROUP BY 1),
zz AS (SELECT vec_id, col, (v - mean) / sd AS z FROM lg JOIN st USING (col))"""


@query("MX-01", f"WITH {LONG} SELECT col, round(mean, 8) AS mean, round(variance, 8) AS variance, round(min, 8) AS min, round(max, 8) AS max FROM st")
def _(spark, d):
    return M.column_stats(emb(spark, d), "embedding").select("col", *[r(c, 8).alias(c) for c in ("mean", "variance", "min", "max")])


@query("MX-02", f"WITH {LONG} SELECT vec_id, col, round(z, 6) AS z FROM zz")
def _(spark, d):
    z = M.standardise(emb(spark, d), "embedding", "z")
    return z.select("vec_id", F.posexplode("z").alias("col", "z")).withColumn("z", r("z"))


@query("MX-03", f"WITH {LONG} SELECT a.col AS i, b.col AS j, round(sum(a.v * b.v), 6) AS v FROM lg a JOIN lg b ON a.vec_id = b.vec_id AND a.col <= b.col GROUP BY 1, 2")
def _(spark, d):
    return M.gram(emb(spark, d), "embedding").withColumn("v", r("v"))


@query("MX-03-cov", f"""WITH {LONG}, n AS (SELECT count(*) - 1 AS n1 FROM embeddings)
SELECT a.col AS i, b.col AS j, round(sum(a.z * b.z) / any_value(n1), 6) AS v FROM zz a JOIN zz b ON a.vec_id = b.vec_id AND a.col <= b.col, n GROUP BY 1, 2""")
def _(spark, d):
    return M.covariance(emb(spark, d), "embedding").withColumn("v", r("v"))


@query("MX-03-norms", f"WITH {LONG} SELECT col, round(sqrt(sum(v * v)), 6) AS norm FROM lg GROUP BY 1")
def _(spark, d):
    return M.column_norms(M.gram(emb(spark, d), "embedding")).withColumn("norm", r("norm"))


@query("MX-04")
def _(spark, d):
    e = M.top_eigen(M.covariance(emb(spark, d), "embedding"), 5)
    return e.withColumn("eigenvalue", r("eigenvalue")).withColumn("explained", r("explained"))


def items(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


@query("MX-05", """SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS b0, round(regr_slope(l_extendedprice, l_quantity), 4) AS b1,
round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem""")
def _(spark, d):
    o = M.ols(items(spark, d), "l_extendedprice", ["l_quantity"])
    return o.select(r(F.element_at("coefficients", 1), 3).alias("b0"), r(F.element_at("coefficients", 2), 4).alias("b1"), r("r2").alias("r2"), "n")


@query("MX-05-multi")
def _(spark, d):
    o = M.ols(items(spark, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return o.select(F.posexplode("coefficients").alias("i", "coefficient"), "r2", "residual_std", "n").withColumn("coefficient", r("coefficient", 3)).withColumn(
        "r2", r("r2")).withColumn("residual_std", r("residual_std", 2))


@query("MX-06")
def _(spark, d):
    row = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return M.kfold_ridge(items(spark, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], row, 5, 0.01).withColumn("r2", r("r2"))


@query("MX-07", f"""WITH {LONG}, s AS (SELECT count(*) AS n, sum(variance) AS t, sum(variance * variance) AS q FROM st WHERE variance > 0),
c AS (SELECT (q - t * (t / n)) / (t / n) AS chi2, n - 1 AS df FROM s)
SELECT round(chi2, 8) AS chi2, df, round(1 - 1 / (1 + exp(-1.7 * ((pow(chi2 / df, 1.0 / 3) - (1 - 2 / (9.0 * df))) / sqrt(2 / (9.0 * df))))), 6) AS p_value FROM c""")
def _(spark, d):
    return M.chi2_gof(M.column_stats(emb(spark, d), "embedding"), "variance").withColumn("chi2", r("chi2", 8)).withColumn("p_value", r("p_value"))


R2REPS = 200


@query("MX-08", f"""WITH rp AS MATERIALIZED (SELECT (props->>'$.k')::DOUBLE AS x, value AS y, rep, {sql_replicate('456', 'event_id')} AS u FROM events, range(1, {R2REPS + 1}) t(rep)),
w AS (SELECT *, {sql_poisson1('u')} AS w FROM rp),
s AS (SELECT rep, sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy FROM w GROUP BY 1),
c AS (SELECT sxy - sx * sy / n AS cxy, sxx - sx * sx / n AS cxx, syy - sy * sy / n AS cyy FROM s),
p AS (SELECT cxy * cxy / (cxx * cyy) AS r2, cxy / cxx AS slope FROM c)
SELECT round(quantile_cont(r2, 0.025), 8) AS r2_low, round(quantile_cont(r2, 0.975), 8) AS r2_high, round(quantile_cont(slope, 0.025), 6) AS slope_low,
round(quantile_cont(slope, 0.975), 6) AS slope_high FROM p""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    b = M.bootstrap_r2(e, "value", "k", "event_id", R2REPS)
    return b.select(r("r2_low", 8).alias("r2_low"), r("r2_high", 8).alias("r2_high"), r("slope_low").alias("slope_low"), r("slope_high").alias("slope_high"))


def quality(spark, d):
    fit = M.ols(items(spark, d), "l_extendedprice", ["l_quantity"]).select("r2")
    row = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    folds = M.kfold_ridge(items(spark, d), "l_extendedprice", ["l_quantity"], row, 5, 0.01).agg(F.avg("r2").alias("cv_mean"), F.stddev_pop("r2").alias("cv_std"))
    pi = points_pi(spark, d).agg(F.max_by("error", "samples").alias("pi_error"))
    opt = C.mc_option_price(contracts(spark, d), "o_orderkey", DRAWS).agg(F.avg("price").alias("option_price"), F.avg("std_error").alias("option_se"))
    one = attach(attach(attach(fit, folds), pi), opt)
    return M.model_quality(one)


@query("MX-09")
def _(spark, d):
    q = quality(spark, d)
    return q.select("quality", "grade", *[r(c, 5).alias(c) for c in ("r2", "cv_mean", "pi_error", "quality_score", "combined_confidence", "overall")])


@query("MX-10")
def _(spark, d):
    return M.render_report(quality(spark, d))


CHECKPOINTS = [100, 1000, 10000, 50000, 100000, 200000, 500000]


def points_pi(spark, d):
    return C.mc_pi(table(spark, d, "orders"), "o_orderkey", CHECKPOINTS)


@query("MC-01", f"""WITH p AS MATERIALIZED (SELECT o_orderkey AS i, {sql_uniform('pi', 'o_orderkey', 0)} AS u, {sql_uniform('pi', 'o_orderkey', 1)} AS v FROM orders),
h AS (SELECT i, CASE WHEN u * u + v * v <= 1 THEN 1.0 ELSE 0.0 END AS hit FROM p),
c AS (SELECT DISTINCT n, s FROM (SELECT c.c, count(*) AS n, sum(hit) AS s FROM h JOIN (VALUES {', '.join(f'({c})' for c in [*CHECKPOINTS, 10 ** 15])}) c(c) ON i < c.c GROUP BY 1))
SELECT n AS samples, round(4.0 * s / n, 8) AS estimate, round(abs(4.0 * s / n - pi()), 8) AS error FROM c""")
def _(spark, d):
    return points_pi(spark, d).select("samples", r("estimate", 8).alias("estimate"), r("error", 8).alias("error"))


STEPS = 40


@query("MC-02", f"""WITH pr AS (SELECT c_custkey, abs(c_acctbal) / 100 + 1 AS start, c_nationkey / 250.0::DOUBLE AS drift, 0.1 + c_nationkey / 100.0::DOUBLE AS vol FROM customer),
z AS (SELECT pr.*, i, {sql_normal('walk', "c_custkey || ':' || i")} AS z FROM pr, range(1, {STEPS + 1}) t(i)),
p AS (SELECT c_custkey, start, i, start * exp(sum((drift - 0.5 * vol * vol) / {STEPS}.0 + vol * sqrt(1.0::DOUBLE / {STEPS}) * z) OVER (PARTITION BY c_custkey ORDER BY i)) AS pos FROM z
 UNION ALL SELECT c_custkey, start, 0, start FROM pr)
SELECT c_custkey, round(max(pos) FILTER (WHERE i = {STEPS}), 6) AS final, round(max(pos), 6) AS max, round(min(pos), 6) AS min, round(avg(pos), 6) AS mean,
round(stddev_pop(pos), 4) AS std, round((max(pos) FILTER (WHERE i = {STEPS}) - any_value(start)) / any_value(start) * 100, 6) AS return_pct FROM p GROUP BY 1""")
def _(spark, d):
    p = spread(table(spark, d, "customer")).select("c_custkey", (F.abs("c_acctbal") / 100 + 1).alias("start"), (F.col("c_nationkey") / 250.0).alias("drift"),
                                                   (0.1 + F.col("c_nationkey") / 100.0).alias("vol"))
    g = C.gbm_paths(p, "c_custkey", STEPS)
    return g.select("c_custkey", *[r(c).alias(c) for c in ("final", "max", "min", "mean")], r("std", 4).alias("std"), r("return_pct").alias("return_pct"))


DRAWS = 64


def contracts(spark, d):
    o = spread(table(spark, d, "orders").select("o_orderkey", "o_totalprice"))
    spot = F.col("o_totalprice") / 1000
    return o.select("o_orderkey", spot.alias("spot"), (spot * (0.8 + 0.4 * uniform("strike", "o_orderkey"))).alias("strike"), F.lit(0.05).alias("rate"),
                    F.lit(0.2).alias("vol"), F.lit(1.0).alias("expiry"))


@query("MC-03", f"""WITH c AS (SELECT o_orderkey, o_totalprice / 1000 AS spot, o_totalprice / 1000 * (0.8 + 0.4 * {sql_uniform('strike', 'o_orderkey')}) AS strike FROM orders),
g AS (SELECT c.*, exp((0.05 - 0.5 * 0.2 * 0.2)::DOUBLE + 0.2::DOUBLE * {sql_normal('option', "o_orderkey || ':' || i")}) AS gr FROM c, range(1, {DRAWS + 1}) t(i)),
a AS (SELECT o_orderkey, any_value(spot) AS spot, exp(-0.05::DOUBLE) * avg(greatest(spot * gr - strike, 0)) AS price,
 exp(-0.05::DOUBLE) * stddev_samp(greatest(spot * gr - strike, 0)) / sqrt({DRAWS}) AS se, exp(-0.05::DOUBLE) * avg(greatest(spot * 1.01::DOUBLE * gr - strike, 0)) AS up FROM g GROUP BY 1)
SELECT o_orderkey, round(price, 6) AS price, round(se, 4) AS std_error, round(price - 1.96::DOUBLE * se, 4) AS ci_low, round(price + 1.96::DOUBLE * se, 4) AS ci_high,
round((up - price) / (spot * 0.01::DOUBLE), 6) AS delta FROM a""")
def _(spark, d):
    c = C.mc_option_price(contracts(spark, d), "o_orderkey", DRAWS)
    return c.select("o_orderkey", r("price").alias("price"), r("std_error", 4).alias("std_error"), r("ci_low", 4).alias("ci_low"),
                    r("ci_high", 4).alias("ci_high"), r("delta").alias("delta"))


@query("MC-04", f"""SELECT o_orderkey, round({sql_uniform('u', 'o_orderkey')}, 9) AS u, round({sql_normal('z', 'o_orderkey')}, 8) AS z FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", r(uniform("u", "o_orderkey"), 9).alias("u"), r(normal("z", "o_orderkey"), 8).alias("z"))
