"""Machine safety, spectra, risk, dispatch and power control."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import top_k


def safety_check(readings: DataFrame, keys: Sequence[str], value: str, forced: Column, limit: float = 14.0) -> DataFrame:
    """CRITICAL_STOP when forced or when the strongest vibration exceeds the limit."""
    out = readings.groupBy(*keys).agg(F.max(value).alias("max_vibration"), F.bool_or(forced).alias("forced"))
    over = F.col("max_vibration") > limit
    critical = F.col("forced") | over
    return out.select(
        *keys, "max_vibration", critical.alias("threshold_exceeded"),
        F.when(critical, "CRITICAL_STOP").otherwise("safety_ok").alias("status"),
        F.when(F.col("forced"), "force_critical_flag").when(over, "vibration_threshold_exceeded").alias("reason"),
        F.when(critical, "EMERGENCY_SHUTDOWN").otherwise("CONTINUE").alias("action"),
        F.when(critical, "RED").otherwise("GREEN").alias("alert_level"))


def first_readings(readings: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 32) -> DataFrame:
    """The first ``n`` readings per machine (position from 0) and how many there are."""
    first = top_k(readings, keys, [F.asc(c) for c in order], n, "rnk")
    sizes = first.groupBy(*keys).agg(F.count("*").alias("n"))
    return first.join(sizes, list(keys)).withColumn("i", F.col("rnk") - 1)


def hann(first: DataFrame, value: str) -> DataFrame:
    weight = F.when(F.col("n") > 1, 0.5 * (1 - F.cos(2 * math.pi * F.col("i") / (F.col("n") - 1)))).otherwise(1.0)
    return first.withColumn("windowed", F.col(value) * weight)


def spectrum(windowed: DataFrame, keys: Sequence[str], rate: float = 1000.0) -> DataFrame:
    """Discrete Fourier transform of at most a few dozen readings, evaluated inside each machine's row."""
    series = F.transform(F.array_sort(F.collect_list(F.struct("i", "windowed"))), lambda s: s["windowed"])
    rows = windowed.groupBy(*keys).agg(series.alias("v")).withColumn("n", F.size("v"))

    def part(fn, k):
        return F.aggregate(F.transform("v", lambda x, i: x * fn(2 * math.pi * k * i / F.col("n"))), F.lit(0.0),
                           lambda a, x: a + x)

    bins = F.filter(F.sequence(F.lit(1), F.greatest(F.floor(F.col("n") / 2).cast("int"), F.lit(1))),
                    lambda k: k <= F.col("n") / 2)
    power = F.transform(bins, lambda k: F.struct(
        ((F.pow(part(F.cos, k), F.lit(2.0)) + F.pow(part(F.sin, k), F.lit(2.0))) / F.col("n")).alias("raw"),
        (-k).alias("k")))
    power = F.transform(power, lambda s: F.struct(F.round(s["raw"], 6).alias("p"), s["k"].alias("k"), s["raw"].alias("raw")))
    rows = rows.withColumn("power", power).withColumn("best", F.array_max("power"))
    step = F.lit(float(rate)) / F.col("n")
    top = -F.col("best.k") * step
    return rows.where(F.size("power") > 0).select(
        *keys, "n", top.alias("dominant_hz"), (top * 2).alias("harmonic2_hz"), (top * 3).alias("harmonic3_hz"),
        F.aggregate("power", F.lit(0.0), lambda a, x: a + x["raw"]).alias("energy"), step.alias("resolution_hz"),
        F.lit(rate / 2).alias("nyquist_hz"))


def shift_of(hour: Column) -> Column:
    return F.when((hour >= 6) & (hour < 14), "day").when((hour >= 14) & (hour < 22), "evening").otherwise("night")


def risk_level(probability: Column) -> Column:
    return F.when(probability > 0.25, "HIGH").when(probability > 0.10, "MEDIUM").otherwise("LOW")


def recommended_action(risk: Column) -> Column:
    return (F.when(risk == "HIGH", "schedule_immediate_maintenance").when(risk == "MEDIUM", "increase_monitoring")
            .otherwise("nominal_operation"))


def dispatch(safety: DataFrame, context: DataFrame, prediction: DataFrame, key: str) -> DataFrame:
    """Emergency stop, or the action by risk and maintenance window."""
    joined = safety.join(context, key, "left").join(prediction, key, "left")
    stop = F.col("status") == "CRITICAL_STOP"
    risk = F.coalesce("risk", F.lit("LOW"))
    action = (
        F.when(stop, "EMERGENCY_SHUTDOWN")
        .when((risk == "HIGH") & F.coalesce("maintenance_window", F.lit(False)), "IMMEDIATE_MAINTENANCE")
        .when(risk == "HIGH", "SCHEDULE_URGENT_MAINTENANCE")
        .when(risk == "MEDIUM", "INCREASE_MONITORING").otherwise("NOMINAL_OPERATION"))
    return joined.select(key, F.when(stop, "EMERGENCY_STOP").otherwise("DISPATCHED").alias("status"),
                         action.alias("action"), F.when(stop, 1).otherwise(3).alias("branches_used"))


def power_summary(series: DataFrame, key: str, ts_us: str, value: str) -> DataFrame:
    """Step from the first two timestamps, total time in minutes, total and average power.

    The two smallest timestamps come from a group-limited rank; the rest is a plain aggregate, so
    a hot series is combined map-side.
    """
    two = top_k(series.select(key, ts_us), [key], [F.asc(ts_us)], 2).groupBy(key).agg(
        (F.max(ts_us) - F.min(ts_us)).alias("step_us"))
    out = series.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total_power"),
                                  F.min(ts_us).alias("start_us"), F.max(ts_us).alias("end_us"))
    minutes = F.col("step_us") / 60e6 * F.col("n")
    return out.join(two, key).withColumn("total_minutes", minutes).withColumn(
        "average_power", F.try_divide(F.col("total_power"), F.col("total_minutes")))


def controller(summary: DataFrame, limit: float = 1.0, average: str = "average_power") -> DataFrame:
    return summary.withColumn("reduce_power", F.when(F.col(average) > limit, 1).otherwise(0))
