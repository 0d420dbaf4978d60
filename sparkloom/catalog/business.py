"""OR and DB: orders and dashboards."""

from pyspark.sql import functions as F

from ..functions.lexicon import DASHBOARD_SOURCES
from ..operators import dashboard as B
from ..operators import orders as O
from ..plans.tables import table
from .base import query, r


def items(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku"), F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))


def stock(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("sku"), F.col("p_size").alias("in_stock"))


def inventory(spark, d):
    return O.check_inventory(items(spark, d).select("order_id", "sku", "quantity"), stock(spark, d))


INV = """inv AS (SELECT l_orderkey AS order_id, bool_and(coalesce(l_quantity <= p_size, FALSE)) AS available,
count(*) FILTER (WHERE NOT coalesce(l_quantity <= p_size, FALSE)) AS n_short, count(*) AS n_items
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1),
ch AS (SELECT l_orderkey AS order_id, sum(l_extendedprice * (1 - l_discount)) AS amount FROM lineitem GROUP BY 1)"""


@query("OR-01", f"WITH {INV} SELECT order_id, available, n_short, n_items FROM inv")
def _(spark, d):
    return inventory(spark, d)


@query("OR-02", f"""WITH {INV} SELECT order_id, round(amount, 4) AS amount, 12.99::DOUBLE AS shipping,
round(amount + 12.99, 4) AS total FROM ch""")
def _(spark, d):
    return O.invoice(items(spark, d)).select("order_id", r("amount", 4).alias("amount"), "shipping", r("total", 4).alias("total"))


@query("OR-03", f"""WITH {INV} SELECT order_id, CASE WHEN available THEN 'confirmed' ELSE 'rejected' END AS status,
CASE WHEN NOT available THEN 'inventory_unavailable' END AS reason, n_short, round(amount + 12.99, 4) AS total
FROM inv LEFT JOIN ch USING (order_id)""")
def _(spark, d):
    out = O.confirm_orders(inventory(spark, d), O.invoice(items(spark, d)))
    return out.select("order_id", "status", "reason", "n_short", r("total", 4).alias("total"))


@query("OR-04", f"""WITH {INV} SELECT order_id, CASE WHEN available THEN 'confirmed' ELSE 'rejected' END AS status,
CASE WHEN available THEN round(amount + 12.99, 4) END AS total FROM inv LEFT JOIN ch USING (order_id)""")
def _(spark, d):
    out = O.confirm_early(inventory(spark, d), items(spark, d))
    return out.select("order_id", "status", r("total", 4).alias("total"))


@query("OR-05", """WITH g AS (SELECT l_orderkey AS order_id, l_linenumber AS branch, sum(l_quantity) AS t FROM lineitem GROUP BY 1, 2),
a AS (SELECT order_id, min(t) AS min_time, max(t) AS max_time, count(*) AS n_branches, list(branch ORDER BY t, branch) AS l FROM g GROUP BY 1)
SELECT order_id, l[1] AS fastest, l[len(l)] AS slowest, min_time, max_time, n_branches, max_time - min_time AS spread,
round(max_time / min_time, 6) AS ratio FROM a""")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("branch")).agg(
        F.sum("l_quantity").alias("t"))
    return O.branch_spread(g, "order_id", "branch", "t").withColumn("ratio", r("ratio"))


def facts(spark, d):
    t = lambda n: table(spark, d, n)
    return B.sales_facts(t("lineitem"), t("orders"), t("customer"), t("nation"), t("region"))


@query("DB-01", """WITH o AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1)
SELECT r_name AS region, round(sum(revenue), 2) AS revenue, count(*) AS transactions, round(avg(revenue), 2) AS avg_order_value
FROM o JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def _(spark, d):
    return B.sales_by_region(facts(spark, d)).withColumn("revenue", r("revenue", 2)).withColumn(
        "avg_order_value", r("avg_order_value", 2))


@query("DB-01-top", """SELECT l_partkey, p_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, sum(l_quantity) AS sales
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 ORDER BY round(sum(l_extendedprice * (1 - l_discount)), 4) DESC, 1 LIMIT 3""")
def _(spark, d):
    return B.top_products(table(spark, d, "lineitem"), table(spark, d, "part"), 3).withColumn("revenue", r("revenue", 2))


@query("DB-02", """SELECT p_brand AS warehouse, count(*) AS items, sum(p_size)::BIGINT AS units,
count(*) FILTER (WHERE p_size > 0 AND p_size < 10) AS low_stock, count(*) FILTER (WHERE p_size = 0) AS out_of_stock FROM part GROUP BY 1""")
def _(spark, d):
    return B.inventory_block(table(spark, d, "part").withColumnRenamed("p_brand", "warehouse"), "warehouse", "p_size", 10)


@query("DB-02-reorder", "SELECT p_partkey, p_size, 5 AS reorder_point FROM part WHERE p_size < 5")
def _(spark, d):
    return B.reorder_list(table(spark, d, "part"), "p_partkey", "p_size", 5)


@query("DB-03", """WITH e AS (SELECT *, CASE WHEN (props->>'$.k')::BIGINT < 25 THEN 'email' WHEN (props->>'$.k')::BIGINT < 50 THEN 'social'
WHEN (props->>'$.k')::BIGINT < 75 THEN 'search' ELSE 'display' END AS channel FROM events),
a AS (SELECT channel, count(*) FILTER (WHERE event_type = 'view') AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks,
count(*) FILTER (WHERE event_type = 'purchase') AS conversions FROM e GROUP BY 1)
SELECT *, round(clicks * 100.0 / nullif(impressions, 0), 6) AS ctr, round(conversions * 100.0 / nullif(clicks, 0), 6) AS conversion_rate FROM a""")
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    channel = F.when(k < 25, "email").when(k < 50, "social").when(k < 75, "search").otherwise("display")
    out = B.funnel_block(table(spark, d, "events").withColumn("channel", channel), "channel", "view", "click", "purchase")
    return out.withColumn("ctr", r("ctr")).withColumn("conversion_rate", r("conversion_rate"))


MATRIX = """mx AS (SELECT p_brand AS seller, p_type AS category, avg(p_retailprice) AS avg_price, min(p_retailprice) AS min_price,
max(p_retailprice) AS max_price, count(*) AS product_count, grouping(p_brand, p_type)::BIGINT AS margin FROM part
GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand), (p_type), ()))"""


def matrix(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("seller"), F.col("p_type").alias("category"), "p_retailprice")
    return B.price_matrix(p, "seller", "category", "p_retailprice")


@query("DB-04", f"WITH {MATRIX} SELECT seller, category, round(avg_price, 8) AS avg_price, min_price, max_price, product_count, margin FROM mx")
def _(spark, d):
    return matrix(spark, d).withColumn("avg_price", r("avg_price", 8))


@query("DB-04-position", f"""WITH {MATRIX}, m AS (SELECT avg_price AS market_avg FROM mx WHERE margin = 3)
SELECT seller, round(avg_price / market_avg, 6) AS competitiveness, CASE WHEN avg_price / market_avg > 1.1 THEN 'premium'
WHEN avg_price / market_avg < 0.9 THEN 'value' ELSE 'mid-market' END AS position FROM mx, m WHERE margin = 1""")
def _(spark, d):
    p = B.market_position(matrix(spark, d))
    return p.select("seller", r("competitiveness").alias("competitiveness"), "position")


@query("DB-05", """SELECT 'r1' AS request_id, 3::BIGINT AS total_sources, 3::BIGINT AS ok_sources,
(SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) AS sales_total,
(SELECT sum(p_size)::DOUBLE FROM part) AS inventory_total,
(SELECT count(*)::DOUBLE FROM events WHERE event_type = 'purchase') AS marketing_total""")
def _(spark, d):
    inv = B.inventory_block(table(spark, d, "part").withColumnRenamed("p_brand", "warehouse"), "warehouse", "p_size", 10)
    fun = B.funnel_block(table(spark, d, "events"), "event_type", "view", "click", "purchase")
    out = B.merge_dashboard([
        B.block_message("sales", B.sales_by_region(facts(spark, d)), "r1", "revenue"),
        B.block_message("inventory", inv, "r1", "units"),
        B.block_message("marketing", fun, "r1", "conversions")])
    return out.withColumn("sales_total", r("sales_total", 2))


_SRC = ", ".join(f"({i}, '{s}')" for i, s in enumerate(DASHBOARD_SOURCES))


@query("DB-06", f"""SELECT 'q' || c_custkey AS request_id, '7d' AS time_range, s.i AS "index", s.source FROM customer,
(VALUES {_SRC}) s(i, source)""")
def _(spark, d):
    req = table(spark, d, "customer").select(F.concat(F.lit("q"), F.col("c_custkey")).alias("request_id"), F.lit("7d").alias("time_range"))
    return B.expand_request(req, DASHBOARD_SOURCES)
