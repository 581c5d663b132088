"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import profile, shipping
from .sources.tables import scan

REVENUE = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
DAY = "TIMESTAMP '1995-03-15'"


def q3_sql_text(segment: str = "BUILDING", cut: str = "1995-03-15", tail: str = "ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10") -> str:
    return f"""SELECT l_orderkey, CAST(sum({REVENUE}) AS DOUBLE) AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority
FROM customer, orders, lineitem WHERE c_mktsegment = '{segment}' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
AND o_orderdate < TIMESTAMP '{cut}' AND l_shipdate > TIMESTAMP '{cut}' GROUP BY l_orderkey, o_orderdate, o_orderpriority {tail}"""


def filter_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass each comparison with an order key."""
    each = [scan(spark, sf_dir, "orders", ["o_orderkey"], [("o_orderkey", op, 700)]).agg(F.lit(op).alias("op"), F.count("*").alias("n")) for op in ("=", "!=", "<", "<=", ">", ">=")]
    return profile.union(each)


def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "orders", ["o_orderpriority", "o_orderkey"])


def filter_unprojected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "lineitem", ["l_orderkey"], [("l_shipdate", ">", profile.cut())])


def dated(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("date"))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shipping.joined(spark, sf_dir)
    return df.select("l_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority", "l_extendedprice", "l_discount")


def fan(table: str, key: str) -> str:
    return f"""SELECT count(*) AS n_keys, min(n) AS min_n, max(n) AS max_n, round(avg(n), 6) AS mean_n, round(stddev_pop(n), 6) AS stddev_n,
median(n) AS median_n FROM (SELECT count(*) AS n FROM {table} GROUP BY {key})"""


def hist(table: str, key: str, edges: list[int]) -> str:
    last = edges[-1]
    bins = ", ".join(f"({a}, {b})" for a, b in zip(edges, edges[1:]))
    return f"""SELECT CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, count(n) AS n FROM (VALUES {bins}) e(lo, hi)
LEFT JOIN (SELECT count(*) AS n FROM {table} GROUP BY {key}) k ON n >= lo AND (n < hi OR hi = {last} AND n = hi) GROUP BY lo, hi"""


def column_sql(table: str, column: str) -> str:
    x = f"CAST({column} AS DECIMAL(12,2))" if column in ("l_extendedprice", "l_discount") else f"CAST({column} AS DATE)" if "date" in column else column
    return f"SELECT '{table}' AS table_name, '{column}' AS column_name, count(DISTINCT {x}) AS n_distinct, CAST(min({x}) AS VARCHAR) AS min_value, CAST(max({x}) AS VARCHAR) AS max_value FROM {table}"


def density_sql(table: str, key: str) -> str:
    return f"""SELECT '{key}' AS key, count({key}) AS n_rows, count(DISTINCT {key}) AS n_distinct, min({key}) AS min_key, max({key}) AS max_key,
max({key}) - min({key}) + 1 AS key_range, CAST(count(DISTINCT {key}) AS DOUBLE) / (max({key}) - min({key}) + 1) AS density FROM {table}"""


def stage_sql(name: str, table: str, where: str) -> str:
    return f"SELECT '{name}' AS stage, count(*) AS rows_in, count(*) FILTER ({where}) AS rows_out, CAST(count(*) FILTER ({where}) AS DOUBLE) / count(*) AS selectivity FROM {table}"


def measure_sql(name: str, x: str) -> str:
    v = f"CAST({x} AS DOUBLE)"
    return f"SELECT '{name}' AS measure, min({v}) AS min_v, max({v}) AS max_v, round(CAST(sum({x}) AS DOUBLE) / count(*), 6) AS mean_v, round(stddev_pop({v}), 4) AS stddev_v, round(median({v}), 6) AS median_v FROM lineitem"


KEPT = f"SELECT o_orderkey FROM orders WHERE o_orderdate < {DAY} AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"
PER_ORDER = f"SELECT sum({REVENUE}) AS r FROM lineitem GROUP BY l_orderkey"

QUERIES = {
    "q3_shipping_priority": shipping.shipping_priority,
    "q3_sql": shipping.shipping_priority_sql,
    "q3_balanced": lambda s, d: shipping.shipping_priority(s, d, shipping.BALANCED),
    "q3_machinery": lambda s, d: shipping.shipping_priority(s, d, shipping.Parameters(segment="MACHINERY")),
    "topk_revenue": shipping.shipping_priority,
    "scan_project": scan_project,
    "filter_ops": filter_ops,
    "filter_unprojected": filter_unprojected,
    "scan_customer_segment": shipping.customers,
    "scan_orders_before": lambda s, d: dated(shipping.orders(s, d), "o_orderdate"),
    "scan_lineitem_after": lambda s, d: dated(shipping.lineitems(s, d), "l_shipdate"),
    "semi_join_keys": lambda s, d: shipping.customers(s, d).select("c_custkey").distinct(),
    "semi_join_orders": lambda s, d: dated(shipping.qualified_orders(s, d), "o_orderdate"),
    "hash_join": joined,
    "join_aggregate": shipping.revenues,
    "profile_cardinality": profile.cardinality,
    "profile_segment_frequency": profile.segment_frequency,
    "profile_filter_selectivity": profile.filter_selectivity,
    "profile_fanout_orders": lambda s, d: profile.fanout(s, d, "orders", "o_custkey"),
    "profile_fanout_items": lambda s, d: profile.fanout(s, d, "lineitem", "l_orderkey"),
    "hist_orders_per_customer": profile.hist_orders,
    "hist_items_per_order": profile.hist_items,
    "key_density": profile.density,
    "key_memory_estimate": profile.memory_estimate,
    "key_gap_frequency": profile.gap_frequency,
    "profile_price_stats": profile.price_stats,
    "discount_values": profile.discount_values,
    "order_revenue_stats": profile.order_revenue_stats,
    "kth_order_revenue": profile.kth_revenue,
    "orderdate_split": profile.orderdate_split,
    "monthly_orders": profile.monthly_orders,
    "profile_scaling": profile.scaling,
    "parquet_row_groups": profile.parquet_row_groups,
    "parquet_structure": profile.parquet_structure,
    "parquet_sort_order": profile.parquet_sort_order,
}

ORACLES = {
    "q3_shipping_priority": q3_sql_text(),
    "q3_sql": q3_sql_text(),
    "q3_balanced": q3_sql_text(cut="1998-06-01"),
    "q3_machinery": q3_sql_text("MACHINERY"),
    "topk_revenue": q3_sql_text(),
    "scan_project": "SELECT o_orderpriority, o_orderkey FROM orders",
    "filter_ops": " UNION ALL ".join(f"SELECT '{op}' AS op, count(*) AS n FROM orders WHERE o_orderkey {op} 700" for op in ("=", "!=", "<", "<=", ">", ">=")),
    "filter_unprojected": f"SELECT l_orderkey FROM lineitem WHERE l_shipdate > {DAY}",
    "scan_customer_segment": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    "scan_orders_before": f"SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders WHERE o_orderdate < {DAY}",
    "scan_lineitem_after": f"SELECT l_orderkey, l_extendedprice, l_discount, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem WHERE l_shipdate > {DAY}",
    "semi_join_keys": "SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "semi_join_orders": f"SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders WHERE o_orderkey IN ({KEPT})",
    "hash_join": f"SELECT l_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority, l_extendedprice, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > {DAY} AND o_orderkey IN ({KEPT})",
    "join_aggregate": q3_sql_text(tail=""),
    "profile_cardinality": " UNION ALL ".join(column_sql(t, c) for t, cs in profile.NEEDED.items() for c in cs),
    "profile_segment_frequency": "SELECT c_mktsegment, count(*) AS n, CAST(100.0 AS DOUBLE) * count(*) / CAST(sum(count(*)) OVER () AS BIGINT) AS pct FROM customer GROUP BY c_mktsegment",
    "profile_filter_selectivity": " UNION ALL ".join([
        stage_sql("customer_segment", "customer", "c_mktsegment = 'BUILDING'"),
        stage_sql("orders_date", "orders", f"o_orderdate < {DAY}"),
        stage_sql("orders_date_semi", f"(SELECT *, o_orderkey IN ({KEPT}) AS hit FROM orders)", "hit"),
        stage_sql("lineitem_shipdate", "lineitem", f"l_shipdate > {DAY}"),
        stage_sql("lineitem_shipdate_join", f"(SELECT *, l_shipdate > {DAY} AND l_orderkey IN ({KEPT}) AS hit FROM lineitem)", "hit"),
    ]),
    "profile_fanout_orders": fan("orders", "o_custkey"),
    "profile_fanout_items": fan("lineitem", "l_orderkey"),
    "hist_orders_per_customer": hist("orders", "o_custkey", profile.ORDER_EDGES),
    "hist_items_per_order": hist("lineitem", "l_orderkey", profile.ITEM_EDGES),
    "key_density": density_sql("customer", "c_custkey") + " UNION ALL " + density_sql("orders", "o_orderkey"),
    "key_memory_estimate": """SELECT e AS est_entries, e * 100 // 1048576 + 1 AS dict_mb, r * 16 // 1048576 AS direct_mb, e * 8 // 1048576 + 1 AS sorted_mb
FROM (SELECT count(DISTINCT o_orderkey) // 10 AS e, max(o_orderkey) - min(o_orderkey) + 1 AS r FROM orders)""",
    "key_gap_frequency": """SELECT gap, count(*) AS n FROM (SELECT k - lag(k) OVER (ORDER BY k) AS gap FROM (SELECT o_orderkey AS k FROM orders ORDER BY k LIMIT 100))
WHERE gap IS NOT NULL GROUP BY gap ORDER BY n DESC, gap LIMIT 5""",
    "profile_price_stats": " UNION ALL ".join([measure_sql("price", "CAST(l_extendedprice AS DECIMAL(12,2))"), measure_sql("discount", "CAST(l_discount AS DECIMAL(4,2))"), measure_sql("revenue", f"({REVENUE})")]),
    "discount_values": "SELECT DISTINCT CAST(CAST(l_discount AS DECIMAL(4,2)) AS DOUBLE) AS l_discount FROM lineitem",
    "order_revenue_stats": f"SELECT count(*) AS n_orders, CAST(min(r) AS DOUBLE) AS min_v, CAST(max(r) AS DOUBLE) AS max_v, round(CAST(sum(r) AS DOUBLE) / count(*), 6) AS mean_v, round(median(CAST(r AS DOUBLE)), 6) AS median_v FROM ({PER_ORDER})",
    "kth_order_revenue": f"SELECT k, CAST(r AS DOUBLE) AS revenue FROM (VALUES (10), (100)) v(k) LEFT JOIN (SELECT r, row_number() OVER (ORDER BY r DESC) AS n FROM ({PER_ORDER})) ON n = k",
    "orderdate_split": f"SELECT count(*) FILTER (o_orderdate < {DAY}) AS before_cut, count(*) FILTER (o_orderdate >= {DAY}) AS on_or_after_cut FROM orders",
    "monthly_orders": """SELECT CAST(m AS DATE) AS month, count(o_orderkey) AS n FROM (SELECT unnest(range(DATE '1994-10-01', DATE '1995-09-01', INTERVAL 1 MONTH)) AS m)
LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY m""",
    "profile_scaling": f"SELECT (SELECT count(*) FROM customer) AS customer_rows, (SELECT count(*) FROM orders) AS orders_rows, (SELECT count(*) FROM lineitem) AS lineitem_rows, (SELECT count(*) FROM lineitem WHERE l_shipdate > {DAY}) AS lineitem_filtered",
}
