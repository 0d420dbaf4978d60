"""LG and IO-08: function logs rendered from the events, parsed back into metrics."""

from pyspark.sql import functions as F

from ..functions.lexicon import PRICES
from ..operators import logs as G
from ..plans.tables import epoch_us, table
from ..sources.logs import read_logs
from ..sources.store import shared_folder
from .base import query, r


def logs(spark, d):
    """Six kinds of lines per event, written inside the row."""
    us = epoch_us("ts")
    e = table(spark, d, "events").select(
        "event_id", "event_type", "value", F.floor(us / 1000).alias("t0"),
        F.get_json_object("props", "$.k").cast("long").alias("k"), F.concat(F.lit("r"), F.col("event_id")).alias("rid"))
    t1 = F.col("t0") + F.floor("value")
    k = F.col("k")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    extra = (F.when(F.col("event_type") == "error", text("[ERROR] failed ", F.col("rid")))
             .when(F.col("event_type") == "click", F.lit("[DEBUG] DynamoDB PutItem ok"))
             .when(F.col("event_type") == "view", F.lit("[DEBUG] Ready: 1/2")))
    init = F.when(k > 90, text(" Init Duration: ", k, ".5 ms")).otherwise("")
    report = text("REPORT RequestId: ", F.col("rid"), " Duration: ", F.format_string("%.2f", F.col("value")), " ms Billed Duration: ",
                  F.ceil("value"), " ms Memory Size: 128 MB Max Memory Used: ", k + 30, " MB", init)
    lines = [("t0", text("START RequestId: ", F.col("rid"), " Version: 1")),
             ("t0", text("[METRICS] dynamo_reads=", k, " dynamo_writes=", k % 5)),
             ("t0", text("[METRICS] s3_puts=", k % 3, " s3_gets=", k % 7)),
             ("t0", extra), ("t1", text("END RequestId: ", F.col("rid"))), ("t1", report)]
    rows = F.array(*[F.struct(F.col(t).alias("ts_ms"), (F.col("event_id") * 6 + i).alias("seq"), m.alias("message"))
                     for i, (t, m) in enumerate(lines)])
    return e.withColumn("t1", t1).select(F.col("event_type").alias("log_group"), F.inline(rows)).where(
        F.col("message").isNotNull()).select("ts_ms", "seq", "log_group", "message")


def runs(spark, d):
    us = epoch_us("ts")
    e = table(spark, d, "events").select(
        F.concat(F.lit("r"), F.col("event_id")).alias("request_id"), F.floor(us / 1000).alias("t0"),
        F.concat_ws("-", "user_id", F.floor(us / F.lit(86400000000))).alias("run_id"))
    first = e.groupBy("run_id").agg((F.min("t0") - 5).alias("invocation_ms"))
    return e.select("request_id", "run_id").join(first, "run_id")


LOGS = """ev AS (SELECT event_id, event_type, value, user_id, epoch_us(ts) // 1000 AS t0, epoch_us(ts) // 1000 + floor(value)::BIGINT AS t1,
 (props->>'$.k')::BIGINT AS k, 'r' || event_id AS rid, epoch_us(ts) // 86400000000 AS day FROM events),
logs AS (SELECT t0 AS ts_ms, event_id * 6 AS seq, event_type AS log_group, 'START RequestId: ' || rid || ' Version: 1' AS message FROM ev
 UNION ALL SELECT t0, event_id * 6 + 1, event_type, '[METRICS] dynamo_reads=' || k || ' dynamo_writes=' || k % 5 FROM ev
 UNION ALL SELECT t0, event_id * 6 + 2, event_type, '[METRICS] s3_puts=' || k % 3 || ' s3_gets=' || k % 7 FROM ev
 UNION ALL SELECT t0, event_id * 6 + 3, event_type, CASE event_type WHEN 'error' THEN '[ERROR] failed ' || rid WHEN 'click'
   THEN '[DEBUG] DynamoDB PutItem ok' ELSE '[DEBUG] Ready: 1/2' END FROM ev WHERE event_type IN ('error', 'click', 'view')
 UNION ALL SELECT t1, event_id * 6 + 4, event_type, 'END RequestId: ' || rid FROM ev
 UNION ALL SELECT t1, event_id * 6 + 5, event_type, 'REPORT RequestId: ' || rid || ' Duration: ' || printf('%.2f', value) || ' ms Billed Duration: '
   || ceil(value)::BIGINT || ' ms Memory Size: 128 MB Max Memory Used: ' || k + 30 || ' MB' ||
   CASE WHEN k > 90 THEN ' Init Duration: ' || k || '.5 ms' ELSE '' END FROM ev)"""
SESS = LOGS + r""",
own AS (SELECT *, nullif(regexp_extract(message, 'RequestId:\s*([\w-]+)', 1), '') AS own FROM logs),
sess AS (SELECT * FROM (SELECT ts_ms, seq, log_group, message, last_value(own IGNORE NULLS) OVER (PARTITION BY log_group ORDER BY ts_ms, seq
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS request_id FROM own) WHERE request_id IS NOT NULL)"""
_X = ("regexp_extract(message, 'REPORT RequestId:\\s*([\\w-]+)\\s+Duration:\\s*([0-9.]+)\\s*ms\\s+Billed Duration:\\s*([0-9]+)\\s*ms\\s+"
      "Memory Size:\\s*([0-9]+)\\s*MB\\s+Max Memory Used:\\s*([0-9]+)\\s*MB(?:\\s+Init Duration:\\s*([0-9.]+)\\s*ms)?', {g})")


def rep(g):
    return f"nullif({_X.format(g=g)}, '')"


def _last(expr):
    return f"arg_max({expr}, ts_ms * 1000000 + seq)"


FM = SESS + f""",
fm AS (SELECT *, init_ms > 0 AS cold_start FROM (SELECT log_group, request_id,
 max(ts_ms) FILTER (WHERE message LIKE 'START RequestId%') AS start_ms, max(ts_ms) FILTER (WHERE message LIKE 'END RequestId%') AS end_ms,
 {_last(rep(2) + '::DOUBLE')} AS duration_ms, {_last(rep(3) + '::DOUBLE')} AS billed_ms, {_last(rep(4) + '::BIGINT')} AS memory_mb,
 {_last(rep(5) + '::BIGINT')} AS max_memory_mb, coalesce({_last(rep(6) + '::DOUBLE')}, 0) AS init_ms,
 (coalesce({_last("nullif(regexp_extract(message, 'dynamo_reads=([0-9]+)', 1), '')::BIGINT")}, 0) + count(*) FILTER (WHERE message LIKE '[DEBUG] Ready%'))::BIGINT AS table_reads,
 (coalesce({_last("nullif(regexp_extract(message, 'dynamo_writes=([0-9]+)', 1), '')::BIGINT")}, 0) + count(*) FILTER (WHERE message LIKE '%PutItem%'))::BIGINT AS table_writes,
 coalesce({_last("nullif(regexp_extract(message, 's3_puts=([0-9]+)', 1), '')::BIGINT")}, 0) AS object_puts,
 coalesce({_last("nullif(regexp_extract(message, 's3_gets=([0-9]+)', 1), '')::BIGINT")}, 0) AS object_gets,
 arg_min(message, ts_ms * 1000000 + seq) FILTER (WHERE message LIKE '[ERROR]%') AS error
 FROM sess GROUP BY 1, 2)),
rn0 AS (SELECT rid AS request_id, user_id || '-' || day AS run_id, t0 FROM ev),
rn AS (SELECT request_id, run_id, min(t0) OVER (PARTITION BY run_id) - 5 AS invocation_ms FROM rn0),
rm AS (SELECT run_id, max(invocation_ms) AS invocation_ms, max(end_ms) AS completion_ms, min(start_ms) AS first_start_ms, count(*) AS n_functions,
 sum(billed_ms) AS billed_ms, max(max_memory_mb) AS peak_memory_mb, count(*) FILTER (WHERE cold_start) AS cold_starts,
 sum(table_reads)::BIGINT AS table_reads, sum(table_writes)::BIGINT AS table_writes, sum(object_puts)::BIGINT AS object_puts,
 sum(object_gets)::BIGINT AS object_gets, sum(billed_ms / 1000.0 * (memory_mb / 1024.0)) AS gb_seconds, count(error) AS n_errors,
 max(end_ms) - max(invocation_ms) AS e2e_ms FROM fm JOIN rn USING (request_id) GROUP BY 1)"""


def metrics(spark, d):
    return G.function_metrics(G.sessionise_logs(logs(spark, d)))


def run_table(spark, d):
    return G.run_metrics(metrics(spark, d), runs(spark, d))


@query("IO-08", f"WITH {LOGS} SELECT ts_ms, seq, log_group, message FROM logs WHERE ts_ms >= 1704600000000")
def _(spark, d):
    path = shared_folder(spark, "logs")
    logs(spark, d).write.parquet(path)
    return read_logs(spark, path, 1704600000000)


@query("LG-01", f"""WITH {LOGS} SELECT log_group, ts_ms, {rep(1)} AS request_id, {rep(2)}::DOUBLE AS duration_ms, {rep(3)}::DOUBLE AS billed_ms,
{rep(4)}::BIGINT AS memory_mb, {rep(5)}::BIGINT AS max_memory_mb, {rep(6)}::DOUBLE AS init_ms, {rep(6)} IS NOT NULL AS cold_start
FROM logs WHERE message LIKE '%REPORT RequestId%'""")
def _(spark, d):
    return G.parse_reports(logs(spark, d))


def _cnt(name):
    return f"coalesce(nullif(regexp_extract(message, '{name}=([0-9]+)', 1), '')::BIGINT, 0)"


@query("LG-02", f"""WITH {LOGS} SELECT log_group, ts_ms, seq, CASE WHEN message LIKE '[METRICS]%' THEN 'metrics' ELSE 'debug' END AS kind,
{_cnt('dynamo_reads')} AS table_reads, {_cnt('dynamo_writes')} AS table_writes, {_cnt('s3_puts')} AS object_puts, {_cnt('s3_gets')} AS object_gets,
CASE WHEN message LIKE '[DEBUG]%PutItem%' THEN 1 ELSE 0 END AS debug_writes, CASE WHEN message LIKE '[DEBUG] Ready%' THEN 1 ELSE 0 END AS debug_reads
FROM logs WHERE message LIKE '[METRICS]%' OR message LIKE '[DEBUG]%'""")
def _(spark, d):
    return G.parse_metrics(logs(spark, d))


@query("LG-03", f"WITH {SESS} SELECT ts_ms, seq, log_group, message, request_id FROM sess")
def _(spark, d):
    return G.sessionise_logs(logs(spark, d))


@query("LG-04", f"""WITH {FM} SELECT log_group, request_id, start_ms, end_ms, duration_ms, billed_ms, memory_mb, max_memory_mb, init_ms,
table_reads, table_writes, object_puts, object_gets, error, cold_start FROM fm""")
def _(spark, d):
    return metrics(spark, d)


@query("LG-05", f"WITH {FM} SELECT * REPLACE (round(gb_seconds, 8) AS gb_seconds) FROM rm")
def _(spark, d):
    return run_table(spark, d).withColumn("gb_seconds", r("gb_seconds", 8))


@query("LG-06", f"""WITH {FM} SELECT run_id, min(start_ms) - max(invocation_ms) AS delay_ms FROM fm JOIN rn USING (request_id)
WHERE log_group = 'purchase' AND start_ms > 0 GROUP BY 1""")
def _(spark, d):
    return G.aggregator_delay(metrics(spark, d), runs(spark, d), "purchase")


@query("LG-07", f"""WITH {FM} SELECT run_id, round(gb_seconds * {PRICES['gb_second']!r} + n_functions * {PRICES['request']!r}::DOUBLE +
table_reads * {PRICES['table_read']!r}::DOUBLE + table_writes * {PRICES['table_write']!r}::DOUBLE + object_puts * {PRICES['object_put']!r}::DOUBLE +
object_gets * {PRICES['object_get']!r}::DOUBLE, 10) AS cost_usd FROM rm""")
def _(spark, d):
    return G.run_cost(run_table(spark, d)).select("run_id", r("cost_usd", 10).alias("cost_usd"))


@query("LG-08", f"WITH {LOGS} SELECT event_type AS log_group, rid AS request_id, t0 AS start_ms, t1 AS end_ms, t1 - t0 AS runtime_ms FROM ev")
def _(spark, d):
    return G.pair_start_end(logs(spark, d))


@query("LG-09", f"""WITH {LOGS}, a AS (SELECT t0, row_number() OVER (ORDER BY t0, event_id) AS k FROM ev WHERE event_type = 'click'),
b AS (SELECT t1, row_number() OVER (ORDER BY t1, event_id) AS k FROM ev WHERE event_type = 'view')
SELECT 'all' AS grp, k, t0 AS start, t1 AS "end", t1 - t0 AS e2e FROM a JOIN b USING (k)""")
def _(spark, d):
    lines = logs(spark, d)
    m = F.col("message")

    def side(group, prefix):
        return lines.where((F.col("log_group") == group) & m.startswith(prefix)).select(F.lit("all").alias("grp"), "ts_ms", "seq")

    return G.zip_kth(side("click", "START RequestId"), side("view", "END RequestId"), ["grp"], "ts_ms", "seq")


@query("LG-10", f"""WITH {FM} SELECT run_id, log_group, request_id, start_ms - min(start_ms) OVER w AS rel_start,
end_ms - min(start_ms) OVER w AS rel_end FROM fm JOIN rn USING (request_id) WINDOW w AS (PARTITION BY run_id)""")
def _(spark, d):
    return G.timeline(metrics(spark, d), runs(spark, d))


@query("LG-11", f"""WITH {FM} SELECT cold_starts > 0 AS cold, count(*) AS runs, round(avg(e2e_ms), 4) AS avg_e2e_ms,
round(avg(billed_ms), 4) AS avg_billed_ms FROM rm GROUP BY 1""")
def _(spark, d):
    c = G.cold_warm(run_table(spark, d))
    return c.withColumn("avg_e2e_ms", r("avg_e2e_ms", 4)).withColumn("avg_billed_ms", r("avg_billed_ms", 4))


@query("LG-12", f"""WITH {FM} SELECT n_functions, count(*) AS runs, round(avg(completion_ms - first_start_ms), 4) AS avg_ms,
max(completion_ms - first_start_ms) AS max_ms FROM rm GROUP BY 1""")
def _(spark, d):
    return G.scaling(run_table(spark, d)).withColumn("avg_ms", r("avg_ms", 4))
