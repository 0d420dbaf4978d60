"""SQ-25 … SQ-48: motifs, clusters, domains, conservation, walks."""

import math

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.draws import sql_normal, sql_poisson1, sql_replicate, sql_uniform
from ..operators import sequence as Q
from .base import query, r
from .sequences import (AA, AB, ISL, ISO, ORF, PF, SEG, SEQ, SMO, VAR, abundance, clusters, lo, orfs, pe, segments, seqs)

_STEPS = ", ".join(f"('{m}', '{n}', '{m[i:i + 2]}')" for m, n in L.MOTIFS.items() for i in range(len(m) - 1))
MOT = AB + f""",
ms AS (SELECT seq_id, motif, name, avg(ratio) AS score FROM ab JOIN (VALUES {_STEPS}) m(motif, name, d) ON d = dinuc GROUP BY 1, 2, 3)"""


@query("SQ-25", f"WITH {SEQ}, {MOT} SELECT seq_id, motif, name, round(score, 6) AS score, score > 0.8 AS likely FROM ms")
def _(spark, d):
    return Q.motif_scores(abundance(spark, d)).withColumn("score", r("score"))


@query("SQ-26", f"""WITH {SEQ}, {AB} SELECT seq_id, dinuc, round(ratio, 6) AS ratio, CASE WHEN ratio > 1.3 THEN 'overrepresented'
WHEN ratio < 0.7 THEN 'underrepresented' ELSE 'neutral' END AS bias FROM ab""")
def _(spark, d):
    return Q.step_bias(abundance(spark, d)).withColumn("ratio", r("ratio"))


_MS = ", ".join(f"('{m}', {len(m) - 1})" for m in L.MOTIFS)


@query("SQ-27", f"""WITH {SEQ}, {MOT}, si AS MATERIALIZED (SELECT motif, id, avg(greatest(0, 1 + 0.3 * {sql_normal('motif', "motif || ':' || id || ':' || step")})) AS s
FROM (SELECT motif, id, unnest(range(1, steps + 1)) AS step FROM (VALUES {_MS}) m(motif, steps), range(1, 301) t(id)) GROUP BY 1, 2),
sl AS (SELECT motif, list(s) AS l FROM si GROUP BY 1)
SELECT seq_id, motif, round(len(list_filter(l, lambda s: s >= score)) / 300.0, 6) AS p_value FROM ms JOIN sl USING (motif)""")
def _(spark, d):
    p = Q.empirical_pvalue(Q.motif_scores(abundance(spark, d)), Q.motif_draws(spark, 300))
    return p.select("seq_id", "motif", r("p_value").alias("p_value"))


@query("SQ-28", f"""WITH {SEQ}, {VAR}, cu AS (SELECT seq_id, position, round(sum(skew) OVER (PARTITION BY seq_id ORDER BY position), 9) AS c FROM sk),
x AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY c, position) AS a, row_number() OVER (PARTITION BY seq_id ORDER BY c DESC, position) AS b FROM cu)
SELECT seq_id, max(position) FILTER (WHERE a = 1) AS origin, round(min(c), 6) AS min_cumulative, max(position) FILTER (WHERE b = 1) AS terminus,
round(max(c), 6) AS max_cumulative FROM x GROUP BY 1""")
def _(spark, d):
    out = Q.skew_extrema(seqs(spark, d), 100, 50)
    return out.withColumn("min_cumulative", r("min_cumulative")).withColumn("max_cumulative", r("max_cumulative"))


CS = ISL + """,
cs AS (SELECT seq_id, start, "end", n_orfs, least(density / 5.0, 1.0) AS density_score, CASE WHEN n_orfs % 2 = 0 THEN 1.0 ELSE 0.7 END * least(density / 5.0, 1.0)
 AS symmetry_score, greatest(0, 1 - abs(avg_orf_len - 300) / 1000) AS regularity FROM isl)"""


@query("SQ-29", f"""WITH {SEQ}, {ORF}, {CS} SELECT seq_id, start, "end", n_orfs, round(density_score, 6) AS density_score, round(symmetry_score, 6) AS symmetry_score,
round(regularity, 6) AS regularity FROM cs""")
def _(spark, d):
    c = Q.cluster_scores(clusters(spark, d))
    return c.select("seq_id", "start", "end", "n_orfs", *[r(x).alias(x) for x in ("density_score", "symmetry_score", "regularity")])


@query("SQ-30", f"""WITH {SEQ}, {ORF}, {ISL} SELECT a.seq_id, a.start AS start_a, b.start AS start_b, b.start - a."end" AS gap, b.start - a."end" < 0 AS overlapping
FROM isl a JOIN isl b ON a.seq_id = b.seq_id AND b.start > a.start AND b.start - a."end" < 1000""")
def _(spark, d):
    return Q.interval_pairs(clusters(spark, d), 1000)


CHI = AA + """,
ch2 AS (SELECT seq_id, sum(n)::BIGINT AS total, count(*) AS k, (sum(n * n) - sum(n) * (sum(n) / count(*))) / greatest(sum(n) / count(*), 1) AS chi2 FROM aac GROUP BY 1)"""


@query("SQ-31", f"WITH {SEQ}, {ORF}, {CHI} SELECT seq_id, total, k, round(chi2, 6) AS chi2 FROM ch2")
def _(spark, d):
    return Q.chi2_uniform(Q.aa_counts(orfs(spark, d))).withColumn("chi2", r("chi2"))


BREP = 200


@query("SQ-31-bootstrap", f"""WITH {SEQ}, {ORF}, le AS (SELECT seq_id, frame, start, unnest(string_split(peptide, '')) AS aa,
 generate_subscripts(string_split(peptide, ''), 1) - 1 AS i FROM orf),
uu AS MATERIALIZED (SELECT *, {sql_replicate('chi2', "seq_id || ':' || frame || ':' || start || ':' || i")} AS u FROM le, range(1, {BREP + 1}) t(rep)),
c AS (SELECT seq_id, rep, aa, sum({sql_poisson1('u')}) AS n FROM uu GROUP BY 1, 2, 3),
kk AS (SELECT seq_id, count(DISTINCT aa) AS k FROM le GROUP BY 1),
x AS (SELECT seq_id, rep, (sum(n * n) - sum(n) * (sum(n) / any_value(k))) / greatest(sum(n) / any_value(k), 1) AS chi2 FROM c JOIN kk USING (seq_id) GROUP BY 1, 2)
SELECT seq_id, round(avg(chi2), 8) AS mean, round(quantile_cont(chi2, 0.05), 8) AS p5, round(quantile_cont(chi2, 0.95), 8) AS p95 FROM x GROUP BY 1""")
def _(spark, d):
    b = Q.chi2_bootstrap(orfs(spark, d), BREP)
    return b.select("seq_id", *[r(c, 8).alias(c) for c in ("mean", "p5", "p95")])


@query("SQ-32", f"""WITH {SEQ}, {ORF}, {ISL}, {AA}, c AS (SELECT *, n * (t - n) AS rw FROM (SELECT *, sum(n) OVER (PARTITION BY seq_id) AS t FROM aac
 WHERE seq_id IN (SELECT seq_id FROM isl))), d AS (SELECT *, sum(rw) OVER (PARTITION BY seq_id) AS al FROM c)
SELECT a.seq_id, a.aa AS aa_a, b.aa AS aa_b, round(ln((a.n * b.n / a.al) / greatest((a.rw / a.al) * (b.rw / a.al), 1e-10)), 6) AS pmi
FROM d a JOIN d b ON a.seq_id = b.seq_id AND a.aa < b.aa""")
def _(spark, d):
    o = orfs(spark, d)
    return Q.pair_pmi(Q.aa_counts(o), Q.orf_islands(o, 150, 2)).withColumn("pmi", r("pmi"))


FRM = """fe AS (SELECT seq_id, -sum(p * log2(p)) AS entropy FROM (SELECT seq_id, count(*) / sum(count(*)) OVER (PARTITION BY seq_id) AS p FROM orf
 GROUP BY seq_id, frame) GROUP BY 1),
fb AS (SELECT seq_id, entropy, entropy / """ + repr(max(math.log2(3), 1.0)) + " AS balance FROM fe)"


def frame_balance(spark, d):
    n = orfs(spark, d).groupBy("seq_id", "frame").agg(F.count("*").alias("n"))
    return Q.category_entropy(n, ["seq_id"], "n", 3)


@query("SQ-33", f"WITH {SEQ}, {ORF}, {FRM} SELECT seq_id, round(entropy, 6) AS entropy, round(balance, 6) AS balance FROM fb")
def _(spark, d):
    return frame_balance(spark, d).select("seq_id", r("entropy").alias("entropy"), r("balance").alias("balance"))


ORG = ISO + """,
og AS (SELECT seq_id, n_segments, high_gc, low_gc, low_complexity, coalesce(n_iso, 0) AS n_isochores, coalesce(m, 0) AS iso_gc_mean, gc_range,
 CASE WHEN gc_range > 0.15 THEN 'heterogeneous' WHEN gc_range > 0.08 THEN 'moderately_heterogeneous' ELSE 'homogeneous' END AS organization,
 coalesce(c, 0) / n_segments AS coverage, low_complexity / n_segments * 100 AS repeat_score, n_segments - high_gc - low_gc AS balanced
 FROM sm LEFT JOIN (SELECT seq_id, count(*) AS n_iso, sum(n_segments) AS c, avg(avg_gc) AS m FROM iso GROUP BY 1) USING (seq_id))"""


def organisation(spark, d):
    seg = segments(spark, d)
    return Q.organisation(Q.segment_summary(seg), Q.isochores(seg, 0.3))


@query("SQ-34", f"""WITH {SEQ}, {ORG} SELECT seq_id, n_segments, high_gc, low_gc, low_complexity, n_isochores, round(iso_gc_mean, 9) AS iso_gc_mean,
round(gc_range, 6) AS gc_range, organization, round(coverage, 6) AS coverage, round(repeat_score, 6) AS repeat_score, balanced FROM og""")
def _(spark, d):
    o = organisation(spark, d).withColumn("iso_gc_mean", r("iso_gc_mean", 9))
    for c in ("gc_range", "coverage", "repeat_score"):
        o = o.withColumn(c, r(c))
    return o


@query("SQ-35", f"""WITH {SEQ}, {SEG}, g AS (SELECT seq_id, gc, round(gc - lag(gc) OVER (PARTITION BY seq_id ORDER BY gc), 9) AS gap FROM (SELECT DISTINCT seq_id, gc FROM seg))
SELECT seq_id, gap, gc AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY gap DESC, gc) AS k FROM g WHERE gap IS NOT NULL) WHERE k = 1""")
def _(spark, d):
    return Q.largest_gap(segments(spark, d), ["seq_id"], "gc")


TM = SEG + """,
dl AS (SELECT seq_id, chunk, CASE WHEN gc > 0.55 THEN 'gc_rich' WHEN gc < 0.45 THEN 'at_rich' ELSE 'balanced' END AS st FROM seg),
tmx AS (SELECT seq_id, from_state, to_state, n, n / sum(n) OVER (PARTITION BY seq_id, from_state) AS prob FROM (SELECT seq_id, from_state, to_state, count(*) AS n
 FROM (SELECT seq_id, st AS to_state, lag(st) OVER (PARTITION BY seq_id ORDER BY chunk) AS from_state FROM dl) WHERE from_state IS NOT NULL GROUP BY ALL))"""


def transitions(spark, d):
    return Q.transition_matrix(Q.domain_labels(segments(spark, d)), "seq_id", "chunk", "state")


@query("SQ-36", f"WITH {SEQ}, {TM} SELECT seq_id, from_state, to_state, n, round(prob, 6) AS prob FROM tmx")
def _(spark, d):
    return transitions(spark, d).withColumn("prob", r("prob"))


CON = PF + """,
con AS MATERIALIZED (SELECT *, 1 - entropy / 2 AS c, CASE WHEN 1 - entropy / 2 > 0.3 THEN 'conserved' WHEN 1 - entropy / 2 < 0.1 THEN 'variable' ELSE 'middle' END AS cl FROM pe)"""


def cons(spark, d):
    return Q.conservation(pe(spark, d))


@query("SQ-37", f"WITH {SEQ}, {CON} SELECT seq_id, position, dominant, round(c, 6) AS conservation, cl AS class FROM con")
def _(spark, d):
    return cons(spark, d).select("seq_id", "position", "dominant", r("conservation").alias("conservation"), "class")


@query("SQ-38", f"""WITH {SEQ}, {CON}, x AS (""" + " UNION ALL ".join(
    f"""SELECT seq_id, position, {w} AS "window", avg(c) OVER w AS mean, var_pop(c) OVER w AS variance, count(*) OVER w AS k FROM con
 WINDOW w AS (PARTITION BY seq_id ORDER BY position ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)""" for w in (5, 10, 20, 50)
) + """) SELECT seq_id, position, "window", round(mean, 6) AS mean, round(variance, 8) AS variance FROM x WHERE k = "window" """)
def _(spark, d):
    x = Q.rolling(cons(spark, d), "conservation", [5, 10, 20, 50])
    return x.withColumn("mean", r("mean")).withColumn("variance", r("variance", 8))


@query("SQ-39", f"""WITH {SEQ}, {CON} SELECT a.seq_id, round(avg(1 - abs(a.c - b.c)), 6) AS mean_similarity FROM con a JOIN con b
ON a.seq_id = b.seq_id AND a.position < b.position GROUP BY 1""")
def _(spark, d):
    return Q.mean_pair_similarity(cons(spark, d), "conservation").withColumn("mean_similarity", r("mean_similarity"))


REG = CON + "," + SMO + """,
sv AS (SELECT seq_id, position, 1 - smoothed / 2 AS v FROM smo),
g0 AS (SELECT *, v > 0.2 AS hit, coalesce(lead(position) OVER w, position) AS nx, sum(CASE WHEN v > 0.2 THEN 0 ELSE 1 END) OVER w AS g FROM sv
 WINDOW w AS (PARTITION BY seq_id ORDER BY position)),
reg AS (SELECT seq_id, min(position) AS start, max(nx) AS "end", max(nx) - min(position) AS length FROM g0 WHERE hit GROUP BY seq_id, g)"""


def regions(spark, d):
    sm = Q.moving_avg(pe(spark, d), "entropy", 20).withColumn("v", 1 - F.col("smoothed") / 2)
    return Q.runs(sm, "v", 0.2)


@query("SQ-40", f"""WITH {SEQ}, {REG} SELECT seq_id, start, "end", length FROM reg""")
def _(spark, d):
    return regions(spark, d)


@query("SQ-41", f"""WITH {SEQ}, {lo('q4', 4, 100)}, {lo('q3', 3)}, p AS (SELECT q4.seq_id, q4.kmer, q4.log_odds AS lo4, unnest([substr(q4.kmer, 1, 3), substr(q4.kmer, 2, 3)]) AS sub FROM q4),
j AS (SELECT p.seq_id, p.kmer, max(lo4) AS lo4, round(avg(coalesce(q3.log_odds, 0)), 9) AS avg3 FROM p LEFT JOIN q3 ON q3.seq_id = p.seq_id AND q3.kmer = p.sub GROUP BY 1, 2)
SELECT seq_id, round(avg(CASE WHEN avg3 = 0 OR (lo4 > 0) = (avg3 > 0) THEN 1.0 ELSE 0.0 END), 6) AS consistency, count(*) AS n_kmers FROM j GROUP BY 1""")
def _(spark, d):
    c = Q.kmer_consistency(seqs(spark, d), 100)
    return c.withColumn("consistency", r("consistency"))


_DY = "CASE b WHEN 'A' THEN 1.0 WHEN 'T' THEN -1.0 WHEN 'G' THEN 0.5 ELSE -0.5 END"
WALK = f"""
wb AS (SELECT seq_id, p::INT AS p, substr(s, p::INT + 1, 1) AS b FROM (SELECT seq_id, s, unnest(range(0, length(s))) AS p FROM sq)),
wk AS MATERIALIZED (SELECT seq_id, p + 1 AS step, (p + 1)::DOUBLE AS x, sum(({_DY})::DOUBLE) OVER (PARTITION BY seq_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS y FROM wb
 UNION ALL SELECT seq_id, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM sq)"""


@query("SQ-42", f"""WITH {SEQ}, {WALK}, l AS (SELECT *, y - lag(y) OVER w AS dy, row_number() OVER (PARTITION BY seq_id ORDER BY step DESC) AS k FROM wk WINDOW w AS (PARTITION BY seq_id ORDER BY step))
SELECT seq_id, round(d, 6) AS displacement, round(p, 6) AS path_length, round(p / greatest(d, 0.01), 6) AS tortuosity FROM (
SELECT seq_id, sum(sqrt(1 + dy * dy)) AS p, max(sqrt(x * x + y * y)) FILTER (WHERE k = 1) AS d FROM l GROUP BY 1)""")
def _(spark, d):
    return Q.walk_stats(seqs(spark, d)).select("seq_id", *[r(c).alias(c) for c in ("displacement", "path_length", "tortuosity")])


@query("SQ-42-walk", f"WITH {SEQ}, {WALK} SELECT seq_id, max(step) AS n_steps, min(y) AS y_min, max(y) AS y_max, sum(y) AS y_sum FROM wk GROUP BY 1")
def _(spark, d):
    return Q.walk(seqs(spark, d)).groupBy("seq_id").agg(
        F.max("step").alias("n_steps"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.sum("y").alias("y_sum"))


@query("SQ-43", f"""WITH {SEQ}, {WALK}, sp AS (SELECT seq_id, min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y), 1.0) AS span FROM wk GROUP BY 1),
bx AS (SELECT seq_id, k, count(DISTINCT floor((x - x0) / (span / k)) * 1e6 + floor((y - y0) / (span / k))) AS n FROM wk JOIN sp USING (seq_id),
 (VALUES (4), (8), (16), (32), (64), (128)) s(k) GROUP BY 1, 2)
SELECT seq_id, round(regr_slope(ln(n), ln(k)), 6) AS dimension, sum(n)::BIGINT AS n_boxes FROM bx GROUP BY 1""")
def _(spark, d):
    return Q.box_dimension(seqs(spark, d)).withColumn("dimension", r("dimension"))


LAGS = 100


@query("SQ-44", f"""WITH {SEQ}, {WALK}, c AS (SELECT seq_id, step, y - avg(y) OVER (PARTITION BY seq_id) AS y FROM wk),
v AS (SELECT seq_id, avg(y * y) AS va, count(*) AS n FROM c GROUP BY 1),
a AS (SELECT a.seq_id, k AS lag, sum(a.y * b.y) AS s FROM (SELECT c.*, unnest(range(1, {LAGS + 1})) AS k FROM c) a JOIN c b ON b.seq_id = a.seq_id AND b.step = a.step + k GROUP BY 1, 2),
x AS (SELECT seq_id, lag::INT AS lag, s / ((n - lag) * CASE WHEN va = 0 THEN 1 ELSE va END) AS r FROM a JOIN v USING (seq_id))
SELECT seq_id, lag, round(r, 6) AS correlation, coalesce(round(r, 9) > lag(round(r, 9)) OVER w AND round(r, 9) > lead(round(r, 9)) OVER w AND r > 0.1, FALSE) AS peak
FROM x WINDOW w AS (PARTITION BY seq_id ORDER BY lag)""")
def _(spark, d):
    return Q.autocorrelation(seqs(spark, d), LAGS).select(
        "seq_id", "lag", r("correlation").alias("correlation"), F.coalesce("peak", F.lit(False)).alias("peak"))


SCORE = """
sco AS (SELECT seq_id, count(*) FILTER (WHERE cl = 'conserved') AS n_conserved, count(*) FILTER (WHERE cl = 'variable') AS n_variable, count(*) AS n_positions,
 count(*) FILTER (WHERE cl = 'conserved') / count(*) AS score FROM con GROUP BY 1)"""


def score(spark, d):
    return Q.conservation_score(cons(spark, d))


@query("SQ-45", f"""WITH {SEQ}, {ORF}, {CS}, {FRM}, {ORG}, {CON}, {SCORE},
ob AS (SELECT seq_id, length(s) AS bases, coalesce(n, 0) AS n_orfs, coalesce(t, 0) / length(s) AS coding_density FROM sq LEFT JOIN
 (SELECT seq_id, count(*) AS n, sum(length) AS t FROM orf GROUP BY 1) USING (seq_id)),
sy AS (SELECT seq_id, avg(symmetry_score) AS sym FROM cs GROUP BY 1),
q AS (SELECT og.*, score, (least(coding_density * 5, 1.0) + coalesce(balance, 0) + n_orfs / 100 + coalesce(sym, 0)) / 4 AS q FROM og JOIN ob USING (seq_id)
 LEFT JOIN fb USING (seq_id) LEFT JOIN sy USING (seq_id) JOIN sco USING (seq_id))
SELECT seq_id, round(q, 6) AS quality, CASE WHEN q > 0.7 THEN 'A' WHEN q > 0.5 THEN 'B' WHEN q > 0.3 THEN 'C' ELSE 'D' END AS grade,
CASE WHEN repeat_score > 20 THEN 'high' WHEN repeat_score > 10 THEN 'moderate' ELSE 'low' END AS repeat_category,
CASE WHEN iso_gc_mean > 0.55 THEN 'H3' WHEN iso_gc_mean > 0.47 THEN 'H2' WHEN iso_gc_mean > 0.41 THEN 'H1' WHEN iso_gc_mean > 0.37 THEN 'L2' ELSE 'L1' END AS isochore_class,
CASE WHEN score > 0.3 THEN 'under_selection' WHEN score > 0.1 THEN 'neutral_drift' ELSE 'rapid_evolution' END AS status FROM q""")
def _(spark, d):
    s = seqs(spark, d)
    o = Q.find_orfs(s, 75)
    g = Q.grade_rules(organisation(spark, d), Q.orf_stats(s, o), frame_balance(spark, d), Q.cluster_scores(Q.orf_islands(o, 150, 2)), score(spark, d))
    return g.withColumn("quality", r("quality"))


@query("SQ-46", f"""WITH {SEQ}, {TM}, rw AS MATERIALIZED (SELECT id, j, -ln({sql_uniform('dirichlet', "id || ':' || j")}) AS w FROM range(1, 501) a(id), range(1, 10) b(j)),
rp AS (SELECT id, w / sum(w) OVER (PARTITION BY id) AS p FROM rw), sims AS (SELECT list(e) AS l FROM (SELECT id, -sum(p * log2(p)) AS e FROM rp GROUP BY 1)),
ob AS (SELECT seq_id, -sum(prob * log2(prob)) AS e FROM tmx GROUP BY 1)
SELECT seq_id, round(e, 6) AS entropy, round(len(list_filter(l, lambda s: s <= e)) / 500.0, 6) AS p_value FROM ob, sims""")
def _(spark, d):
    t = Q.transition_test(transitions(spark, d), Q.random_entropies(spark, 500, 9))
    return t.select("seq_id", r("entropy").alias("entropy"), r("p_value").alias("p_value"))


_H = ["high_gc", "low_gc", "balanced", "low_complexity"]


@query("SQ-46-homogeneity", f"""WITH {SEQ}, {ORG}, h AS (SELECT seq_id, {', '.join(f'1 - abs({k} / greatest(high_gc + low_gc + balanced + low_complexity, 1) - 0.25) AS h_{k}' for k in _H)} FROM og)
SELECT seq_id, {', '.join(f'round(h_{k}, 6) AS h_{k}' for k in _H)}, round(({' + '.join(f'h_{k}' for k in _H)}) / 4, 6) AS overall FROM h""")
def _(spark, d):
    return Q.homogeneity(organisation(spark, d)).select("seq_id", *[r(c).alias(c) for c in [*(f"h_{k}" for k in _H), "overall"]])


BDRAW = 500


@query("SQ-47", f"""WITH {SEQ}, {CON}, {SCORE}, b AS (SELECT seq_id, score, greatest(n_conserved + n_variable, 1) AS n FROM sco),
dr AS (SELECT seq_id, draw, count(*) FILTER (WHERE {sql_uniform('cons', "seq_id || ':' || draw || ':' || i")} < score) / any_value(n) AS v FROM (
 SELECT seq_id, score, n, draw, unnest(range(1, n + 1)) AS i FROM b, range(1, {BDRAW + 1}) t(draw)) GROUP BY 1, 2)
SELECT seq_id, round(avg(v), 6) AS mean, round(list_sort(list(v))[{int(BDRAW * 0.025) + 1}], 6) AS lower, round(list_sort(list(v))[{int(BDRAW * 0.975) + 1}], 6) AS upper,
round(stddev_pop(v), 6) AS std FROM dr GROUP BY 1""")
def _(spark, d):
    return Q.binomial_ci(score(spark, d), BDRAW).select("seq_id", *[r(c).alias(c) for c in ("mean", "lower", "upper", "std")])


@query("SQ-48", f"""WITH {SEQ}, {REG}, {SCORE}, g AS (SELECT seq_id, count(*) AS n, avg(length) AS a, max(length) AS m, sum(length)::BIGINT AS t FROM reg GROUP BY 1),
j AS (SELECT *, CASE WHEN 1 - score < 0.75 THEN -0.75 * ln(1 - 4.0 / 3 * (1 - score)) END AS dist FROM sco LEFT JOIN g USING (seq_id))
SELECT seq_id, round(score, 6) AS score, round(dist, 6) AS distance, coalesce(n, 0) AS n_regions, round(coalesce(a, 0), 6) AS avg_length, coalesce(m, 0) AS max_length,
coalesce(t, 0) AS total_span, round(coalesce(dist / 1e6, 0), 10) AS rate FROM j""")
def _(spark, d):
    j = Q.jukes_cantor(score(spark, d), regions(spark, d))
    return j.select("seq_id", r("score").alias("score"), r("distance").alias("distance"), "n_regions", r("avg_length").alias("avg_length"),
                    "max_length", "total_span", r("rate", 10).alias("rate"))
