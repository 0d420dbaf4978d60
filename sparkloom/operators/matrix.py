"""Column statistics, Gram matrices, eigenvalues, regression and cross-validation.

Rows may be many, columns are few: everything that leaves a task is at most width x width numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import poisson1
from ..functions.draws import replicates as draw_replicates
from ..plans.joins import attach


def column_stats(df: DataFrame, vector: str) -> DataFrame:
    """Mean, population variance, minimum and maximum of every column."""
    long = df.select(F.posexplode(vector).alias("col", "v")).select("col", F.col("v").cast("double").alias("v"))
    return long.groupBy("col").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("variance"), F.min("v").alias("min"), F.max("v").alias("max"))


def standardise(df: DataFrame, vector: str, out: str = "z") -> DataFrame:
    """Column-wise z-scores; the statistics are one row (two arrays of the matrix width)."""
    long = df.select(F.posexplode(vector).alias("col", "v")).select("col", F.col("v").cast("double").alias("v"))
    stats = long.groupBy("col").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    one = stats.agg(F.array_sort(F.collect_list(F.struct("col", "m", F.when(F.col("s") < 1e-10, 1.0).otherwise(F.col("s")).alias("s")))).alias("st"))
    z = F.zip_with(F.col(vector), F.col("st"), lambda v, s: (v.cast("double") - s["m"]) / s["s"])
    return attach(df, one).withColumn(out, z).drop("st")


def gram(df: DataFrame, vector: str) -> DataFrame:
    """Upper triangle of XᵀX as ``(i, j, v)``.

    Every task multiplies its Arrow batches into one width x width matrix and emits that partial
    sum only, so the shuffle is tasks x width², whatever the number of rows.
    """
    def partial(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy()).astype(float)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(total.shape[0])
            yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "v": total[i, j]})

    rows = df.select(F.col(vector).cast("array<double>").alias("x"))
    return rows.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def covariance(df: DataFrame, vector: str) -> DataFrame:
    """Covariance of the standardised columns: Gram matrix over n - 1."""
    n = df.agg((F.count("*") - 1).alias("n1"))
    return attach(gram(standardise(df, vector, "z"), "z"), n).select("i", "j", (F.col("v") / F.col("n1")).alias("v"))


def column_norms(g: DataFrame) -> DataFrame:
    return g.where(F.col("i") == F.col("j")).select(F.col("i").alias("col"), F.sqrt("v").alias("norm"))


def top_eigen(cov: DataFrame, k: int = 5) -> DataFrame:
    """Largest eigenvalues with their explained share; the aggregated matrix is one small row."""
    packed = cov.groupBy().agg(F.collect_list("i").alias("i"), F.collect_list("j").alias("j"), F.collect_list("v").alias("v"))

    @F.pandas_udf("array<double>")
    def values(i: pd.Series, j: pd.Series, v: pd.Series) -> pd.Series:
        def one(a, b, x):
            a, b = np.asarray(a), np.asarray(b)
            m = np.zeros((b.max() + 1, b.max() + 1))
            m[a, b] = x
            m[b, a] = x
            return list(np.linalg.eigvalsh(m)[::-1])
        return pd.Series([one(*t) for t in zip(i, j, v)])

    e = packed.select(values("i", "j", "v").alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return e.select(total.alias("total"), F.posexplode(F.slice("e", 1, k)).alias("rank", "eigenvalue")).select(
        (F.col("rank") + 1).alias("rank"), "eigenvalue", (F.col("eigenvalue") / F.col("total")).alias("explained"))


# ---------------------------------------------------------------- regression
def _moments(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Sums of products of ``[1, x…, y]`` per key: the sufficient statistics of least squares."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs], F.col(y).cast("double")]
    names = range(len(cols))
    aggs = [F.sum(cols[a] * cols[b]).alias(f"m{a}_{b}") for a in names for b in names if a <= b]
    flat = df.groupBy(*keys).agg(*aggs) if keys else df.groupBy().agg(*aggs)
    pairs = [f"m{a}_{b}" for a in names for b in names if a <= b]
    return flat.select(*keys, F.array(*pairs).alias("m"))


def _unpack(m, p: int) -> np.ndarray:
    a = np.zeros((p + 2, p + 2))
    iu = np.triu_indices(p + 2)
    a[iu] = m
    return a + np.triu(a, 1).T


def _fit(a: np.ndarray, lam: float = 0.0) -> np.ndarray:
    x = a[:-1, :-1].copy()
    pen = lam * np.eye(len(x))
    pen[0, 0] = 0.0
    return np.linalg.solve(x + pen, a[:-1, -1])


def _sse(a: np.ndarray, beta: np.ndarray) -> float:
    return float(a[-1, -1] - 2 * beta @ a[:-1, -1] + beta @ a[:-1, :-1] @ beta)


def ols(df: DataFrame, y: str, xs: list[str], keys: list[str] | None = None) -> DataFrame:
    """Least squares by normal equations per key: coefficients, R², residual std, sums of squares.

    One aggregation over the rows; the small system is solved from the sums.
    """
    p, keys = len(xs), keys or []

    @F.pandas_udf("coefficients array<double>, r2 double, residual_std double, ss_res double, ss_tot double, n long")
    def solve(m: pd.Series) -> pd.DataFrame:
        rows = []
        for v in m:
            a = _unpack(v, p)
            beta = _fit(a)
            n = a[0, 0]
            res, tot = _sse(a, beta), float(a[-1, -1] - a[0, -1] ** 2 / n)
            rows.append((list(beta), 1 - res / tot if tot > 0 else 0.0, float(np.sqrt(max(res, 0) / max(n - p - 1, 1))), res, tot, int(n)))
        return pd.DataFrame(rows, columns=["coefficients", "r2", "residual_std", "ss_res", "ss_tot", "n"])

    return _moments(df, keys, y, xs).withColumn("f", solve("m")).select(*keys, "f.*")


def kfold_ridge(df: DataFrame, y: str, xs: list[str], row_id: Column, k: int = 5, lam: float = 0.01) -> DataFrame:
    """Ridge regression scored on k folds in one pass: training sums are the total minus the fold."""
    p = len(xs)
    fold = (F.conv(F.substring(F.md5(row_id.cast("string")), 1, 8), 16, 10).cast("long") % k).cast("int")
    parts = _moments(df.withColumn("fold", fold), ["fold"], y, xs)
    packed = parts.groupBy().agg(F.array_sort(F.collect_list(F.struct("fold", "m"))).alias("f")).select(
        F.transform("f", lambda s: s["fold"]).alias("fold"), F.flatten(F.transform("f", lambda s: s["m"])).alias("m"))

    @F.pandas_udf("array<double>")
    def score(folds: pd.Series, ms: pd.Series) -> pd.Series:
        def one(f, m):
            mats = [_unpack(v, p) for v in np.asarray(m).reshape(len(f), -1)]
            total = sum(mats)
            out = []
            for a in mats:
                beta = _fit(total - a, lam)
                tot = a[-1, -1] - a[0, -1] ** 2 / a[0, 0]
                out.append(float(1 - _sse(a, beta) / tot))
            return out
        return pd.Series([one(f, m) for f, m in zip(folds, ms)])

    return packed.select(F.inline(F.arrays_zip("fold", score("fold", "m").alias("r2"))))


def chi2_gof(df: DataFrame, value: str) -> DataFrame:
    """Chi-squared of positive values against equal shares, cube-root normal approximation, logistic tail."""
    pos = df.where(F.col(value) > 0)
    s = pos.agg(F.count("*").alias("n"), F.sum(value).alias("t"), F.sum(F.col(value) * F.col(value)).alias("q"))
    e = F.col("t") / F.col("n")
    s = s.withColumn("chi2", (F.col("q") - F.col("t") * e) / e).withColumn("df", F.col("n") - 1)
    w = 2.0 / (9.0 * F.col("df"))
    z = (F.pow(F.col("chi2") / F.col("df"), F.lit(1.0 / 3)) - (1 - w)) / F.sqrt(w)
    return s.withColumn("p_value", F.when(F.col("df") > 0, 1.0 - 1.0 / (1.0 + F.exp(-1.7 * z))).otherwise(1.0)).select("chi2", "df", "p_value")


def bootstrap_r2(df: DataFrame, y: str, x: str, row_id: str, replicates: int = 200, seed: str = "456") -> DataFrame:
    """R² and slope of every bootstrap replicate (Poisson weights), then their interval."""
    base = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(row_id).alias("id"))
    reps = draw_replicates(base, replicates, seed, "id").withColumn("w", poisson1(F.col("u")))
    s = reps.groupBy("rep").agg(*[F.sum(F.col("w") * e).alias(n) for n, e in (
        ("n", F.lit(1.0)), ("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")),
        ("sxy", F.col("x") * F.col("y")), ("syy", F.col("y") * F.col("y")))])
    cxy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    cxx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    cyy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    per = s.select("rep", (cxy * cxy / (cxx * cyy)).alias("r2"), (cxy / cxx).alias("slope"))
    return per.agg(*[F.percentile(c, p).alias(f"{c}_{n}") for c in ("r2", "slope") for n, p in (("low", 0.025), ("high", 0.975))])


def model_quality(row: DataFrame) -> DataFrame:
    """Quality label, cross-method indicators and overall grade from one row of metrics.

    Needs ``r2, cv_mean, cv_std, pi_error, option_price, option_se``.
    """
    r2, cv, sd, pe = F.col("r2"), F.col("cv_mean"), F.col("cv_std"), F.col("pi_error")
    flag = lambda c: F.when(c, 1).otherwise(0)
    hits = flag(r2 > 0.7) + flag(pe < 0.01) + flag(sd < 0.1) + flag(
        (F.col("option_price") > 0) & (F.try_divide(F.col("option_se"), F.col("option_price")) < 0.05))
    out = row.withColumn("quality", F.when((r2 > 0.9) & (cv > 0.85), "excellent").when((r2 > 0.7) & (cv > 0.65), "good")
                         .when(r2 > 0.5, "moderate").otherwise("poor"))
    out = out.withColumn("quality_score", hits / 4.0).withColumn("combined_confidence", (r2 + F.greatest(F.lit(0.0), 1 - pe)) / 2)
    zero, one = F.lit(0.0), F.lit(1.0)
    overall = (F.least(one, r2) + F.greatest(zero, 1 - sd * 5) + F.greatest(zero, 1 - pe * 100) + F.col("quality_score")) / 4
    out = out.withColumn("overall", overall)
    o = F.col("overall")
    return out.withColumn("grade", F.when(o > 0.85, "A").when(o > 0.7, "B").when(o > 0.5, "C").when(o > 0.3, "D").otherwise("F"))


def render_report(row: DataFrame) -> DataFrame:
    """Text report of one row of metrics."""
    f = F.format_string
    lines = [
        F.concat(F.lit("Model Quality: "), F.upper("quality")), f("R-squared: %.4f", "r2"),
        f("Cross-Validation Mean R2: %.4f (+-%.4f)", "cv_mean", "cv_std"), f("Pi error: %.6f", "pi_error"),
        f("Option Price: $%.4f (SE: %.4f)", "option_price", "option_se"), F.concat(F.lit("Grade: "), "grade"),
        f("Score: %.2f/1.00", "overall")]
    return row.select(F.concat_ws("\n", *lines).alias("report"))
