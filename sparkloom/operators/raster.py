"""Raster operators over image rows ``(image_id, y, v)`` with ``v`` an array of pixel values.

An image row is bounded by the image width.  Vertical neighbours come from an aggregation on
``(image_id, y)``, so even one huge image spreads over all tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import KERNELS

IMAGE = "image_id"


def _stack(rows: DataFrame, reach: int) -> DataFrame:
    """Each row with its neighbours ``-reach … reach`` as columns ``r0 … r(2 reach)``; border rows are dropped."""
    shifts = F.explode(F.array(*[F.lit(s) for s in range(-reach, reach + 1)])).alias("s")
    moved = rows.select(IMAGE, "y", "v", shifts).select(IMAGE, (F.col("y") - F.col("s")).alias("y"), "s", "v")
    picked = moved.groupBy(IMAGE, "y").agg(*[
        F.max(F.when(F.col("s") == s, F.col("v"))).alias(f"r{s + reach}") for s in range(-reach, reach + 1)])
    full = F.lit(True)
    for i in range(2 * reach + 1):
        full = full & F.col(f"r{i}").isNotNull()
    return picked.where(full)


def convolve(rows: DataFrame, kernel: str | tuple) -> DataFrame:
    """3x3 convolution with scale and offset; borders are dropped."""
    weights, scale, offset = KERNELS[kernel] if isinstance(kernel, str) else kernel
    s = _stack(rows, 1)

    def at(x):
        total = F.lit(0.0)
        for dy in range(3):
            for dx in range(3):
                w = weights[dy * 3 + dx]
                if w:
                    total = total + F.lit(float(w)) * F.element_at(F.col(f"r{dy}"), x + dx)
        return total / float(scale) + float(offset)

    width = F.size("r1")
    return s.where(width >= 3).select(IMAGE, "y", F.transform(F.sequence(F.lit(1), width - 2), at).alias("v"))


def blur(rows: DataFrame, radius: int = 1) -> DataFrame:
    """Separable blur with binomial weights: across the row, then down the columns."""
    n = 2 * radius
    weights = [math.comb(n, i) / 2.0 ** n for i in range(n + 1)]

    def across(x):
        total = F.lit(0.0)
        for i, w in enumerate(weights):
            total = total + w * F.element_at("v", x + i)
        return total

    flat = rows.where(F.size("v") > n).select(IMAGE, "y", F.transform(F.sequence(F.lit(1), F.size("v") - n), across).alias("v"))
    s = _stack(flat, radius)

    def down(x):
        total = F.lit(0.0)
        for i, w in enumerate(weights):
            total = total + w * F.element_at(F.col(f"r{i}"), x)
        return total

    return s.select(IMAGE, "y", F.transform(F.sequence(F.lit(1), F.size("r0")), down).alias("v"))


def pixels(rows: DataFrame) -> DataFrame:
    return rows.select(IMAGE, "y", F.posexplode("v").alias("x", "v")).select(IMAGE, "x", "y", F.col("v").cast("double").alias("v"))


def _bounds(px: DataFrame) -> DataFrame:
    return px.groupBy(IMAGE).agg(F.max("x").alias("mx"), F.max("y").alias("my"))


def remap(px: DataFrame, x: Column, y: Column) -> DataFrame:
    """New coordinates as expressions over ``x, y, mx, my``."""
    return px.join(_bounds(px), IMAGE).select(IMAGE, x.alias("x"), y.alias("y"), "v")


def rotate(px: DataFrame, quarter_turns: int) -> DataFrame:
    """Rotate counter-clockwise by multiples of 90 degrees."""
    x, y, mx, my = (F.col(c) for c in ("x", "y", "mx", "my"))
    return remap(px, *{0: (x, y), 1: (y, mx - x), 2: (mx - x, my - y), 3: (my - y, x)}[quarter_turns % 4])


def flip(px: DataFrame, axis: str) -> DataFrame:
    if axis == "left_right":
        return remap(px, F.col("mx") - F.col("x"), F.col("y"))
    return remap(px, F.col("x"), F.col("my") - F.col("y"))


def transpose(px: DataFrame) -> DataFrame:
    return px.select(IMAGE, F.col("y").alias("x"), F.col("x").alias("y"), "v")


def downsample(px: DataFrame, size: int = 128) -> DataFrame:
    """Block mean to at most ``size`` pixels along the longer side; smaller images stay as they are."""
    scale = F.least(F.lit(1.0), F.lit(float(size)) / (F.greatest("mx", "my") + 1))
    j = px.join(_bounds(px), IMAGE).withColumn("s", scale)
    return j.groupBy(IMAGE, F.floor(F.col("x") * F.col("s")).alias("x"), F.floor(F.col("y") * F.col("s")).alias("y")).agg(
        F.avg("v").alias("v"), F.count("*").alias("n"))
