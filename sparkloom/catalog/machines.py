"""SE, IT and VD: sensors, power series, detections."""

from pyspark.sql import functions as F

from ..operators import detections as V
from ..operators import sensors as S
from ..plans.joins import join_lookup
from ..plans.tables import epoch_us, table
from .base import query, r


def readings(spark, d):
    us = epoch_us("ts")
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("machine_id"), us.alias("us"), F.floor(us / F.lit(86400000000)).alias("day"),
        "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


RD = """rd AS (SELECT event_id, user_id AS machine_id, epoch_us(ts) AS us, epoch_us(ts) // 86400000000 AS day, event_type, value,
(props->>'$.k')::BIGINT AS k, extract(hour FROM ts) AS hh FROM events)"""
SAFE = RD + """,
sf0 AS (SELECT machine_id, day, max(value) AS max_vibration, bool_or(event_type = 'error' AND k > 90) AS forced FROM rd GROUP BY 1, 2),
safety AS (SELECT machine_id, day, max_vibration, (forced OR max_vibration > 14) AS threshold_exceeded,
 CASE WHEN forced OR max_vibration > 14 THEN 'CRITICAL_STOP' ELSE 'safety_ok' END AS status,
 CASE WHEN forced THEN 'force_critical_flag' WHEN max_vibration > 14 THEN 'vibration_threshold_exceeded' END AS reason,
 CASE WHEN forced OR max_vibration > 14 THEN 'EMERGENCY_SHUTDOWN' ELSE 'CONTINUE' END AS action,
 CASE WHEN forced OR max_vibration > 14 THEN 'RED' ELSE 'GREEN' END AS alert_level FROM sf0)"""


def safety(spark, d):
    return S.safety_check(readings(spark, d), ["machine_id", "day"], "value",
                          (F.col("event_type") == "error") & (F.col("k") > 90), 14.0)


@query("SE-01", f"WITH {SAFE} SELECT * FROM safety")
def _(spark, d):
    return safety(spark, d)


HANN = RD + """,
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY us, event_id) - 1 AS i FROM rd) WHERE i < 32),
hn AS (SELECT machine_id, i, n, value * CASE WHEN n > 1 THEN 0.5 * (1 - cos(2 * pi() * i / (n - 1))) ELSE 1 END AS windowed
 FROM (SELECT *, count(*) OVER (PARTITION BY machine_id) AS n FROM fr))"""


def windowed(spark, d):
    return S.hann(S.first_readings(readings(spark, d), ["machine_id"], ["us", "event_id"], 32), "value")


@query("SE-02", f"WITH {HANN} SELECT machine_id, i::INT AS i, n, round(windowed, 6) AS windowed FROM hn")
def _(spark, d):
    return windowed(spark, d).select("machine_id", "i", "n", r("windowed").alias("windowed"))


@query("SE-03", f"""WITH {HANN}, ft AS (SELECT machine_id, n, f.k AS k, (pow(sum(windowed * cos(2 * pi() * f.k * i / n)), 2) +
pow(sum(windowed * sin(2 * pi() * f.k * i / n)), 2)) / n AS p FROM hn, range(1, 17) f(k) WHERE f.k <= n / 2 GROUP BY 1, 2, 3),
b AS (SELECT machine_id, n, sum(p) AS energy, arg_max(k, round(p, 6) * 1000000 - k * 0.0000001) AS k FROM ft GROUP BY 1, 2)
SELECT machine_id, n::INT AS n, round(k * 1000.0 / n, 6) AS dominant_hz, round(k * 2000.0 / n, 6) AS harmonic2_hz,
round(k * 3000.0 / n, 6) AS harmonic3_hz, round(energy, 4) AS energy, round(1000.0 / n, 6) AS resolution_hz, 500.0::DOUBLE AS nyquist_hz FROM b""")
def _(spark, d):
    s = S.spectrum(windowed(spark, d), ["machine_id"], 1000.0)
    return s.select("machine_id", "n", r("dominant_hz").alias("dominant_hz"), r("harmonic2_hz").alias("harmonic2_hz"),
                    r("harmonic3_hz").alias("harmonic3_hz"), r("energy", 4).alias("energy"),
                    r("resolution_hz").alias("resolution_hz"), "nyquist_hz")


@query("SE-04", f"""WITH {RD} SELECT event_id, machine_id, CASE WHEN hh >= 6 AND hh < 14 THEN 'day' WHEN hh >= 14 AND hh < 22 THEN 'evening'
ELSE 'night' END AS shift, c_mktsegment AS mode, c_acctbal AS uptime FROM rd LEFT JOIN customer ON c_custkey = machine_id""")
def _(spark, d):
    rd = readings(spark, d)
    hour = (F.floor(F.col("us") / F.lit(3600000000)) % 24)
    state = table(spark, d, "customer").select(F.col("c_custkey").alias("machine_id"), F.col("c_mktsegment").alias("mode"),
                                               F.col("c_acctbal").alias("uptime"))
    return join_lookup(rd.select("event_id", "machine_id", S.shift_of(hour).alias("shift")), state, "machine_id")


@query("SE-05", f"""WITH {RD}, p AS (SELECT event_id, k / 280.0 AS p FROM rd) SELECT event_id,
CASE WHEN p > 0.25 THEN 'HIGH' WHEN p > 0.10 THEN 'MEDIUM' ELSE 'LOW' END AS risk, CASE WHEN p > 0.25 THEN 'schedule_immediate_maintenance'
WHEN p > 0.10 THEN 'increase_monitoring' ELSE 'nominal_operation' END AS recommended FROM p""")
def _(spark, d):
    risk = S.risk_level(F.col("k") / 280.0)
    return readings(spark, d).select("event_id", risk.alias("risk"), S.recommended_action(risk).alias("recommended"))


@query("SE-06", f"""WITH {SAFE}, s AS (SELECT machine_id || '-' || day AS mday, status FROM safety),
c AS (SELECT machine_id || '-' || day AS mday, max(k) > 50 AS mw, max(k) / 280.0 AS p FROM rd GROUP BY 1),
j AS (SELECT s.mday, status, mw, CASE WHEN p > 0.25 THEN 'HIGH' WHEN p > 0.10 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM s JOIN c USING (mday))
SELECT mday, CASE WHEN status = 'CRITICAL_STOP' THEN 'EMERGENCY_STOP' ELSE 'DISPATCHED' END AS status,
CASE WHEN status = 'CRITICAL_STOP' THEN 'EMERGENCY_SHUTDOWN' WHEN risk = 'HIGH' AND mw THEN 'IMMEDIATE_MAINTENANCE'
WHEN risk = 'HIGH' THEN 'SCHEDULE_URGENT_MAINTENANCE' WHEN risk = 'MEDIUM' THEN 'INCREASE_MONITORING' ELSE 'NOMINAL_OPERATION' END AS action,
CASE WHEN status = 'CRITICAL_STOP' THEN 1 ELSE 3 END AS branches_used FROM j""")
def _(spark, d):
    mday = F.concat_ws("-", F.col("machine_id"), F.col("day")).alias("mday")
    rd = readings(spark, d).select(mday, "k")
    context = rd.groupBy("mday").agg((F.max("k") > 50).alias("maintenance_window"))
    pred = rd.groupBy("mday").agg(S.risk_level(F.max("k") / 280.0).alias("risk"))
    return S.dispatch(safety(spark, d).select(mday, "status"), context, pred, "mday")


POWER = RD + """,
pw AS (SELECT machine_id, count(*) AS n, sum(value) AS total_power, min(us) AS start_us, max(us) AS end_us,
 (list_sort(list(us))[2] - list_sort(list(us))[1]) / 60e6 * count(*) AS total_minutes FROM rd GROUP BY 1),
pwa AS (SELECT *, total_power / nullif(total_minutes, 0) AS average_power FROM pw)"""


def power(spark, d):
    return S.power_summary(readings(spark, d), "machine_id", "us", "value")


@query("IT-01", f"""WITH {POWER} SELECT machine_id, n, start_us, end_us, round(total_power, 4) AS total_power,
round(total_minutes, 4) AS total_minutes, round(average_power, 6) AS average_power FROM pwa""")
def _(spark, d):
    return power(spark, d).select("machine_id", "n", "start_us", "end_us", r("total_power", 4).alias("total_power"),
                                  r("total_minutes", 4).alias("total_minutes"), r("average_power").alias("average_power"))


@query("IT-02", f"WITH {POWER} SELECT machine_id, CASE WHEN average_power > 1 THEN 1 ELSE 0 END AS reduce_power FROM pwa")
def _(spark, d):
    return S.controller(power(spark, d), 1.0).select("machine_id", "reduce_power")


DET = """det AS (SELECT event_id AS frame_id, event_id // 5 AS batch_id, event_type AS class, least(value / 100, 1.0) AS confidence FROM events),
dc AS (SELECT frame_id, batch_id, class, count(*) AS n, avg(confidence) AS mc, CASE grouping(frame_id, batch_id, class) WHEN 3 THEN 'frame'
 WHEN 5 THEN 'batch' ELSE 'class' END AS grain FROM det WHERE confidence > 0.5
 GROUP BY GROUPING SETS ((frame_id), (batch_id), (class)))"""


def detections(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("frame_id"), F.floor(F.col("event_id") / 5).alias("batch_id"), F.col("event_type").alias("class"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"))


@query("VD-01", """SELECT event_id // 5 AS batch_id, min(event_id) AS start_frame, max(event_id) AS end_frame, count(*) AS n_frames FROM events GROUP BY 1""")
def _(spark, d):
    return V.batch_frames(table(spark, d, "events"), "event_id", 5)


@query("VD-02", f"WITH {DET} SELECT coalesce(frame_id, -1) AS frame_id, coalesce(batch_id, -1) AS batch_id, class, n, round(mc, 6) AS mean_confidence, grain FROM dc")
def _(spark, d):
    return V.detection_counts(detections(spark, d)).withColumn("mean_confidence", r("mean_confidence")).fillna(
        -1, ["frame_id", "batch_id"])


@query("VD-03", f"WITH {DET} SELECT class, sum(n)::BIGINT AS n FROM dc WHERE grain = 'class' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, d):
    return V.detection_summary(V.detection_counts(detections(spark, d)), 5)
