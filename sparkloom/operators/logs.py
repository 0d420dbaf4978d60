"""Function logs to per-request, per-run and cost metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import PRICES
from ..plans.ordered import carry_forward, row_numbers

# ---- fixed values: log line formats ----
REPORT = (
    r"REPORT RequestId:\s*([\w-]+)\s+Duration:\s*([0-9.]+)\s*ms\s+Billed Duration:\s*([0-9]+)\s*ms\s+"
    r"Memory Size:\s*([0-9]+)\s*MB\s+Max Memory Used:\s*([0-9]+)\s*MB(?:\s+Init Duration:\s*([0-9.]+)\s*ms)?"
)
TABLE_COUNTERS = r"\[METRICS\]\s*dynamo_reads=([0-9]+)\s+dynamo_writes=([0-9]+)"
OBJECT_COUNTERS = r"\[METRICS\]\s*s3_puts=([0-9]+)\s+s3_gets=([0-9]+)"
REQUEST_ID = r"RequestId:\s*([\w-]+)"
POLL = r"\[DEBUG\]\s*Ready:\s*[0-9]+/[0-9]+"

DAY_MS = 86_400_000


def _field(message: Column, pattern: str, group: int, kind: str) -> Column:
    found = F.regexp_extract(message, pattern, group)
    return F.when(found != "", found).cast(kind)


def parse_reports(logs: DataFrame) -> DataFrame:
    """Typed fields of REPORT lines; an init duration marks a cold start."""
    m = F.col("message")
    return logs.where(m.contains("REPORT RequestId")).select(
        "log_group", "ts_ms", _field(m, REPORT, 1, "string").alias("request_id"),
        _field(m, REPORT, 2, "double").alias("duration_ms"), _field(m, REPORT, 3, "double").alias("billed_ms"),
        _field(m, REPORT, 4, "long").alias("memory_mb"), _field(m, REPORT, 5, "long").alias("max_memory_mb"),
        _field(m, REPORT, 6, "double").alias("init_ms"),
        (F.regexp_extract(m, REPORT, 6) != "").alias("cold_start"))


def _line_kind(m: Column) -> Column:
    return (F.when(m.startswith("START RequestId"), "start").when(m.startswith("END RequestId"), "end")
            .when(m.contains("REPORT RequestId"), "report").when(m.contains("[METRICS]"), "metrics")
            .when(m.contains("[DEBUG]"), "debug").when(m.contains("[ERROR]") | m.contains("Traceback"), "error"))


def _debug_writes(m: Column) -> Column:
    return m.contains("PutItem") | m.contains("put_item") | F.lower(m).contains("checkpoint")


def _debug_reads(m: Column) -> Column:
    once = F.when(m.contains("GetItem") | m.contains("get_item") | F.lower(m).contains("get_checkpoint"), 1).otherwise(0)
    return once + F.when(m.rlike(POLL), 1).otherwise(0)


def parse_metrics(logs: DataFrame) -> DataFrame:
    """I/O counters of [METRICS] lines and operations seen in [DEBUG] lines."""
    m = F.col("message")
    kind = _line_kind(m)
    return logs.withColumn("kind", kind).where(F.col("kind").isin("metrics", "debug")).select(
        "log_group", "ts_ms", "seq", "kind",
        *[F.coalesce(_field(m, p, g, "long"), F.lit(0).cast("long")).alias(n) for n, p, g in (
            ("table_reads", TABLE_COUNTERS, 1), ("table_writes", TABLE_COUNTERS, 2),
            ("object_puts", OBJECT_COUNTERS, 1), ("object_gets", OBJECT_COUNTERS, 2))],
        F.when(kind == "debug", F.when(_debug_writes(m), 1).otherwise(0)).otherwise(0).alias("debug_writes"),
        F.when(kind == "debug", _debug_reads(m)).otherwise(0).alias("debug_reads"))


def sessionise_logs(logs: DataFrame, block_ms: int = DAY_MS) -> DataFrame:
    """Give every line the last request id seen in its log group.

    One busy log group may hold most lines, so the carry-forward works on ``(group, time block)``
    and passes only the last id of each block on.
    """
    own = _field(F.col("message"), REQUEST_ID, 1, "string")
    marked = logs.withColumn("own_id", own)
    out = carry_forward(marked, ["log_group"], ["ts_ms", "seq"], "own_id", "request_id",
                        F.floor(F.col("ts_ms") / block_ms))
    return out.where(F.col("request_id").isNotNull()).drop("own_id", "__block")


def function_metrics(sessions: DataFrame, error_chars: int | None = None) -> DataFrame:
    """One row per request: times, memory, I/O and the first error, in a single aggregation.

    Debug operations add to the request's last counter line.
    """
    m = F.col("message")
    order = F.struct("ts_ms", "seq")
    lines = sessions.withColumn("kind", _line_kind(m))

    def last(pattern, group, cast):
        v = _field(m, pattern, group, cast)
        return F.max_by(v, F.when(v.isNotNull(), order))

    def counter(pattern, group):
        return F.coalesce(last(pattern, group, "long"), F.lit(0).cast("long"))

    debug = F.col("kind") == "debug"
    return lines.groupBy("log_group", "request_id").agg(
        F.max(F.when(F.col("kind") == "start", F.col("ts_ms"))).alias("start_ms"),
        F.max(F.when(F.col("kind") == "end", F.col("ts_ms"))).alias("end_ms"),
        last(REPORT, 2, "double").alias("duration_ms"), last(REPORT, 3, "double").alias("billed_ms"),
        last(REPORT, 4, "long").alias("memory_mb"), last(REPORT, 5, "long").alias("max_memory_mb"),
        F.coalesce(last(REPORT, 6, "double"), F.lit(0.0)).alias("init_ms"),
        (counter(TABLE_COUNTERS, 1) + F.sum(F.when(debug, _debug_reads(m)).otherwise(0))).alias("table_reads"),
        (counter(TABLE_COUNTERS, 2) + F.count_if(debug & _debug_writes(m))).alias("table_writes"),
        counter(OBJECT_COUNTERS, 1).alias("object_puts"), counter(OBJECT_COUNTERS, 2).alias("object_gets"),
        F.min_by(F.trim(m) if error_chars is None else F.substring(F.trim(m), 1, error_chars), F.when(F.col("kind") == "error", order)).alias("error"),
    ).withColumn("cold_start", F.col("init_ms") > 0)


def run_metrics(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: latency, billed time, peak memory, cold starts, I/O sums, cost."""
    joined = metrics.join(runs, "request_id")
    gb = F.col("billed_ms") / 1000.0 * (F.col("memory_mb") / 1024.0)
    out = joined.groupBy("run_id").agg(
        F.max("invocation_ms").alias("invocation_ms"), F.max("end_ms").alias("completion_ms"),
        F.min("start_ms").alias("first_start_ms"), F.count("*").alias("n_functions"),
        F.sum("billed_ms").alias("billed_ms"), F.max("max_memory_mb").alias("peak_memory_mb"),
        F.count_if("cold_start").alias("cold_starts"), F.sum("table_reads").alias("table_reads"),
        F.sum("table_writes").alias("table_writes"), F.sum("object_puts").alias("object_puts"),
        F.sum("object_gets").alias("object_gets"), F.sum(gb).alias("gb_seconds"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"))
    return out.withColumn("e2e_ms", F.col("completion_ms") - F.col("invocation_ms"))


def aggregator_delay(metrics: DataFrame, runs: DataFrame, function: str) -> DataFrame:
    """Earliest start of the aggregating function after the invocation."""
    agg = metrics.where((F.col("log_group") == function) & (F.col("start_ms") > 0))
    return agg.join(runs, "request_id").groupBy("run_id").agg(
        (F.min("start_ms") - F.max("invocation_ms")).alias("delay_ms"))


def run_cost(runs: DataFrame, prices: dict[str, float] = PRICES) -> DataFrame:
    cost = (
        F.col("gb_seconds") * prices["gb_second"] + F.col("n_functions") * prices["request"]
        + F.col("table_reads") * prices["table_read"] + F.col("table_writes") * prices["table_write"]
        + F.col("object_puts") * prices["object_put"] + F.col("object_gets") * prices["object_get"])
    return runs.withColumn("cost_usd", cost)


def pair_start_end(logs: DataFrame) -> DataFrame:
    """Runtime per execution id from its start and end lines."""
    m = F.col("message")
    ids = logs.where(m.startswith("START RequestId") | m.startswith("END RequestId")).select(
        "log_group", _field(m, REQUEST_ID, 1, "string").alias("request_id"), "ts_ms", m.startswith("START").alias("is_start"))
    out = ids.groupBy("log_group", "request_id").agg(
        F.min(F.when(F.col("is_start"), F.col("ts_ms"))).alias("start_ms"),
        F.max(F.when(~F.col("is_start"), F.col("ts_ms"))).alias("end_ms"))
    return out.withColumn("runtime_ms", F.col("end_ms") - F.col("start_ms"))


def zip_kth(a: DataFrame, b: DataFrame, keys: Sequence[str], ts: str, tie: str, block_ms: int = DAY_MS) -> DataFrame:
    """Pair the k-th row of one stream with the k-th of another (positional join) and subtract times.

    Row numbers are exact but built per time block, so even a single global key is not sorted in one task.
    """
    def numbered(df, name):
        n = row_numbers(df, keys, [F.col(ts), F.col(tie)], F.floor(F.col(ts) / block_ms), "k")
        return n.select(*keys, "k", F.col(ts).alias(name))

    return numbered(a, "start").join(numbered(b, "end"), [*keys, "k"]).withColumn("e2e", F.col("end") - F.col("start"))


def timeline(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Start and end of every function relative to the first start of its run."""
    joined = metrics.join(runs, "request_id")
    first = joined.groupBy("run_id").agg(F.min("start_ms").alias("t0"))
    return joined.join(first, "run_id").select(
        "run_id", "log_group", "request_id", (F.col("start_ms") - F.col("t0")).alias("rel_start"),
        (F.col("end_ms") - F.col("t0")).alias("rel_end"))


def cold_warm(runs: DataFrame) -> DataFrame:
    return runs.groupBy((F.col("cold_starts") > 0).alias("cold")).agg(
        F.count("*").alias("runs"), F.avg("e2e_ms").alias("avg_e2e_ms"), F.avg("billed_ms").alias("avg_billed_ms"))


def scaling(runs: DataFrame, size: str = "n_functions") -> DataFrame:
    """Latency from first start to last end by fan-out size."""
    span = F.col("completion_ms") - F.col("first_start_ms")
    return runs.groupBy(size).agg(F.count("*").alias("runs"), F.avg(span).alias("avg_ms"), F.max(span).alias("max_ms"))
