"""Dashboard blocks over a sales schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import attach, join_lookup


def sales_facts(items: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame,
                region: DataFrame) -> DataFrame:
    """Line revenue with its region.

    Revenue is summed per order before the star join, so the large table is reduced map-side and
    shuffled once on the order key; the dimension tables are broadcast while small.
    """
    revenue = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev")
    per_order = items.select(F.col("l_orderkey").alias("o_orderkey"), revenue).groupBy("o_orderkey").agg(
        F.sum("rev").alias("revenue"))
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
    who = join_lookup(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), places, "c_nationkey")
    out = per_order.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    return join_lookup(out, who, "o_custkey").select("o_orderkey", "region", "revenue")


def sales_by_region(facts: DataFrame) -> DataFrame:
    return facts.groupBy("region").agg(
        F.sum("revenue").alias("revenue"), F.count("*").alias("transactions"), F.avg("revenue").alias("avg_order_value"))


def top_products(items: DataFrame, part: DataFrame, k: int = 3) -> DataFrame:
    """Best products; names are looked up for the ``k`` winners only."""
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")
    best = items.groupBy("l_partkey").agg(revenue, F.sum("l_quantity").alias("sales")).orderBy(
        F.desc(F.round("revenue", 4)), F.asc("l_partkey")).limit(k)
    return part.select(F.col("p_partkey").alias("l_partkey"), "p_name").join(F.broadcast(best), "l_partkey")


def inventory_block(stock: DataFrame, warehouse: str, level: str, reorder_point: int) -> DataFrame:
    return stock.groupBy(warehouse).agg(
        F.count("*").alias("items"), F.sum(level).alias("units"),
        F.count_if((F.col(level) > 0) & (F.col(level) < reorder_point)).alias("low_stock"),
        F.count_if(F.col(level) == 0).alias("out_of_stock"))


def reorder_list(stock: DataFrame, sku: str, level: str, reorder_point: int) -> DataFrame:
    return stock.where(F.col(level) < reorder_point).select(sku, level, F.lit(reorder_point).alias("reorder_point"))


def funnel_block(events: DataFrame, channel: str, shown: str, clicked: str, bought: str) -> DataFrame:
    """Impressions, clicks, conversions and their rates per channel."""
    out = events.groupBy(channel).agg(
        F.count_if(F.col("event_type") == shown).alias("impressions"),
        F.count_if(F.col("event_type") == clicked).alias("clicks"),
        F.count_if(F.col("event_type") == bought).alias("conversions"))
    return out.withColumn("ctr", F.try_divide(F.col("clicks") * 100.0, F.col("impressions"))).withColumn(
        "conversion_rate", F.try_divide(F.col("conversions") * 100.0, F.col("clicks")))


def price_matrix(products: DataFrame, seller: str, category: str, price: str) -> DataFrame:
    """Prices per seller x category with margins, in one pass by grouping sets, and the market position."""
    out = products.groupingSets([[seller, category], [seller], [category], []], seller, category).agg(
        F.avg(price).alias("avg_price"), F.min(price).alias("min_price"), F.max(price).alias("max_price"),
        F.count("*").alias("product_count"), F.grouping_id().alias("margin"))
    return out


def market_position(matrix: DataFrame) -> DataFrame:
    """Each seller's average against the whole market."""
    market = matrix.where("margin = 3").select(F.col("avg_price").alias("market_avg"))
    sellers = matrix.where("margin = 1")
    ratio = F.col("avg_price") / F.col("market_avg")
    return attach(sellers, market).withColumn("competitiveness", ratio).withColumn(
        "position", F.when(ratio > 1.1, "premium").when(ratio < 0.9, "value").otherwise("mid-market"))


def block_message(source: str, df: DataFrame, request: str, metric: str) -> DataFrame:
    """A block's total as one ``(source, request_id, status, metric, value)`` row."""
    return df.agg(F.sum(metric).cast("double").alias("value"), F.count("*").alias("n")).select(
        F.lit(source).alias("source"), F.lit(request).alias("request_id"),
        F.when(F.col("n") > 0, "success").otherwise("empty").alias("status"), "value")


def merge_dashboard(blocks: Sequence[DataFrame]) -> DataFrame:
    """Sources, failures and totals per request."""
    merged = blocks[0]
    for b in blocks[1:]:
        merged = merged.unionByName(b)
    return merged.groupBy("request_id").agg(
        F.count("*").alias("total_sources"), F.count_if(F.col("status") == "success").alias("ok_sources"),
        F.max(F.when(F.col("source") == "sales", F.col("value"))).alias("sales_total"),
        F.max(F.when(F.col("source") == "inventory", F.col("value"))).alias("inventory_total"),
        F.max(F.when(F.col("source") == "marketing", F.col("value"))).alias("marketing_total"))


def expand_request(df: DataFrame, sources: Sequence[str]) -> DataFrame:
    """One row per request and source; the fixed source list is exploded in the row."""
    return df.select("*", F.posexplode(F.array(*[F.lit(s) for s in sources])).alias("index", "source"))
