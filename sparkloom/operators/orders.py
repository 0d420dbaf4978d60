"""Order processing: stock check, invoice chain, confirmation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import join_lookup
from .dataflow import short_circuit

SHIPPING_COST = 12.99  # fixed value: flat express tariff


def check_inventory(items: DataFrame, stock: DataFrame, order: str = "order_id") -> DataFrame:
    """Fast branch: an order is available when every item fits its stock."""
    joined = join_lookup(items, stock, "sku")
    fits = F.coalesce(F.col("quantity") <= F.col("in_stock"), F.lit(False))
    return joined.groupBy(order).agg(F.bool_and(fits).alias("available"),
                                     F.count_if(~fits).alias("n_short"), F.count("*").alias("n_items"))


def invoice(items: DataFrame, shipping: Column | None = None, order: str = "order_id") -> DataFrame:
    """Slow chain: amount, shipping and total per order."""
    amount = items.groupBy(order).agg(F.sum("amount").alias("amount"))
    ship = F.lit(SHIPPING_COST) if shipping is None else shipping
    return amount.withColumn("shipping", ship).withColumn("total", F.col("amount") + F.col("shipping"))


def confirm_orders(inventory: DataFrame, chain: DataFrame, order: str = "order_id") -> DataFrame:
    """Merge both branches into a confirmed or rejected order record."""
    out = inventory.join(chain, order, "left")
    ok = F.col("available")
    return out.withColumn("status", F.when(ok, "confirmed").otherwise("rejected")).withColumn(
        "reason", F.when(~ok, "inventory_unavailable"))


def confirm_early(inventory: DataFrame, items: DataFrame, order: str = "order_id") -> DataFrame:
    """The same result without pricing orders that the stock check rejects."""
    out = short_circuit(inventory, items, lambda d: invoice(d, order=order), order, "available")
    return out.withColumn("status", F.when(F.col("available"), "confirmed").otherwise("rejected"))


def branch_spread(df: DataFrame, key: str, branch: str, time: str) -> DataFrame:
    """Fastest and slowest branch per key, their difference and ratio."""
    out = df.groupBy(key).agg(
        F.min_by(branch, F.struct(time, branch)).alias("fastest"),
        F.max_by(branch, F.struct(time, branch)).alias("slowest"),
        F.min(time).alias("min_time"), F.max(time).alias("max_time"), F.count("*").alias("n_branches"))
    return out.withColumn("spread", F.col("max_time") - F.col("min_time")).withColumn(
        "ratio", F.try_divide(F.col("max_time"), F.col("min_time")))
