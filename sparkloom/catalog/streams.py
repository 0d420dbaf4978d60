"""ST-S: streaming jobs over the tables, drained, with their batch results as checks."""

from pyspark.sql import functions as F

from ..plans.tables import epoch_us, table
from ..streaming import flows as W
from ..streaming.run import drain, latest, read_stream
from .base import query, r


def _events(spark, d, stream=True):
    e = read_stream(spark, d, "events") if stream else table(spark, d, "events")
    return e.withColumn("us", epoch_us("ts")).withColumn("at", F.timestamp_micros(F.col("us")))


ASM = """SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS user, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS assistant
FROM conversations GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'user') > 0 AND count(*) FILTER (WHERE role = 'assistant') > 0"""


@query("ST-S1", f"SELECT conv_id, md5(user) AS user, md5(assistant) AS assistant FROM ({ASM})")
def _(spark, d):
    a = W.assemble_fields_batch(table(spark, d, "conversations"), "conv_id", "role", "text", "turn", ["user", "assistant"])
    return a.select("conv_id", F.md5("user").alias("user"), F.md5("assistant").alias("assistant"))


@query("ST-S1-stream", f"SELECT conv_id, md5(user) AS user, md5(assistant) AS assistant, 2 AS n_ready, FALSE AS timed_out FROM ({ASM})")
def _(spark, d):
    s = W.assemble_fields(read_stream(spark, d, "conversations"), "conv_id", "role", "text", ["user", "assistant"], order="turn")
    return drain(s).select("conv_id", F.md5("user").alias("user"), F.md5("assistant").alias("assistant"), "n_ready", "timed_out")


FIELDS = ["click", "view", "purchase", "signup", "error"]


@query("ST-S2", """WITH s AS (SELECT user_id * 100 + extract(day FROM ts) AS session, count(DISTINCT event_type)::INT AS n_ready, max(epoch_us(ts)) // 1000 AS last_ms,
 """ + ", ".join(f"coalesce(round(arg_min(value, epoch_us(ts)) FILTER (WHERE event_type = '{e}'), 4), -1) AS first_{e}" for e in FIELDS) + """ FROM events GROUP BY 1),
m AS (SELECT max(epoch_us(ts)) // 1000 - 3600000 AS wm FROM events)
SELECT session::BIGINT AS session, n_ready, n_ready < 5 AS timed_out, """ + ", ".join(f"first_{e}" for e in FIELDS) + """ FROM s, m WHERE n_ready = 5 OR last_ms + 300000 < wm""")
def _(spark, d):
    e = _events(spark, d).withColumn("session", F.col("user_id") * 100 + F.dayofmonth("ts")).withWatermark("at", "1 hour")
    s = W.assemble_fields(e.withColumn("text", F.col("value").cast("string")), "session", "event_type", "text",
                          FIELDS, "at", 300, "-1")
    return drain(s).select("session", "n_ready", "timed_out", *[F.round(F.col(e).cast("double"), 4).alias(f"first_{e}") for e in FIELDS])


@query("ST-S3", "SELECT user_id, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    t = drain(W.running_total(_events(spark, d), "user_id", "value"), "update")
    return latest(t, ["user_id"]).withColumn("total", r("total", 4))


@query("ST-S4", """WITH w AS (SELECT epoch_us(ts) // 3600000000 AS h, event_type, avg(value) AS p, count(*) AS n FROM events GROUP BY 1, 2),
m AS (SELECT max(epoch_us(ts)) - 600000000 AS wm FROM events)
SELECT h * 3600 AS start_s, event_type, n, round(p, 6) AS average_power, CASE WHEN p > 1 THEN 1 ELSE 0 END AS reduce_power FROM w, m
WHERE (h + 1) * 3600000000 <= wm""")
def _(spark, d):
    c = drain(W.stream_controller(_events(spark, d), "at", "value", "event_type", "1 hour"))
    return c.select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n", r("average_power").alias("average_power"), "reduce_power")


@query("ST-S5", "SELECT user_id, min(epoch_us(ts)) AS us FROM events WHERE value > 14 GROUP BY 1")
def _(spark, d):
    e = _events(spark, d).withColumn("status", F.when(F.col("value") > 14, "CRITICAL_STOP").otherwise("safety_ok"))
    return drain(W.stream_short_circuit(e, "user_id", "status", "us")).drop("batch")


@query("ST-S6", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def _(spark, d):
    twice = _events(spark, d).select("event_id", "event_type", "at", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    out = drain(W.stream_dedupe(twice, ["event_id"], "at"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


FAN = """a AS (SELECT event_id AS early_id, user_id, epoch_us(ts) AS early_us FROM events WHERE event_type = 'click'),
b AS (SELECT event_id AS late_id, user_id, epoch_us(ts) AS late_us FROM events WHERE event_type = 'purchase')"""


@query("ST-S7", f"""WITH {FAN} SELECT early_id, coalesce(late_id, -1) AS late_id FROM a LEFT JOIN b ON a.user_id = b.user_id AND late_us BETWEEN early_us AND early_us + 3600000000""")
def _(spark, d):
    e = _events(spark, d, False)
    a = e.where("event_type = 'click'").select(F.col("event_id").alias("early_id"), "user_id", F.col("us").alias("early_us"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("late_id"), "user_id", F.col("us").alias("late_us"))
    return W.fan_in_batch(a, b, "user_id", "early_us", "late_us").select("early_id", F.coalesce("late_id", F.lit(-1).cast("long")).alias("late_id"))


@query("ST-S7-stream", f"""WITH {FAN} SELECT early_id, late_id FROM a JOIN b ON a.user_id = b.user_id AND late_us BETWEEN early_us AND early_us + 3600000000""")
def _(spark, d):
    a = _events(spark, d).where("event_type = 'click'").select(F.col("event_id").alias("early_id"), "user_id", F.col("at").alias("early_at"))
    b = _events(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("late_id"), "user_id", F.col("at").alias("late_at"))
    out = drain(W.stream_fan_in(a, b, "user_id", "early_at", "late_at"))
    return out.where(F.col("late_id").isNotNull()).select("early_id", "late_id")


ITEM = """it AS (SELECT event_id, value * 2 + 100 AS p FROM events),
gr AS (SELECT event_id, p AS processed_value, floor(sqrt(p) * 10)::BIGINT AS analyzed_value, least(100, floor(p / 10)::BIGINT)::BIGINT AS score,
 CASE WHEN p > 500 THEN 'high' WHEN p > 200 THEN 'medium' ELSE 'low' END AS category FROM it),
gd AS (SELECT *, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS grade FROM gr)"""


@query("ST-S8", f"WITH {ITEM} SELECT event_id, round(processed_value, 6) AS processed_value, analyzed_value, score, category, grade FROM gd")
def _(spark, d):
    return W.item_pipeline(table(spark, d, "events")).select("event_id", r("processed_value").alias("processed_value"), "analyzed_value",
                                                             F.col("score").cast("long").alias("score"), "category", "grade")


@query("ST-S8-stream", f"WITH {ITEM} SELECT grade, count(*) AS n, sum(score)::BIGINT AS total_score FROM gd GROUP BY 1")
def _(spark, d):
    g = drain(W.grade_summary(W.item_pipeline(read_stream(spark, d, "events"))), "complete")
    return latest(g, ["grade"])
