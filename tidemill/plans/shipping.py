"""The shipping-priority query: unshipped orders of a market segment with the largest revenue.

The fixtures have no ship priority, so the order priority takes its place as the carried column.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import revenue, total
from ..operators.relational import semi_join, top_k
from ..sources.tables import register, scan


@dataclass(frozen=True)
class Parameters:
    segment: str = "BUILDING"
    order_before: dt.datetime = dt.datetime(1995, 3, 15)
    ship_after: dt.datetime = dt.datetime(1995, 3, 15)
    k: int = 10


BALANCED = Parameters(order_before=dt.datetime(1998, 6, 1), ship_after=dt.datetime(1998, 6, 1))


def customers(spark: SparkSession, sf_dir: str, p: Parameters = Parameters()) -> DataFrame:
    return scan(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"], [("c_mktsegment", "=", p.segment)])


def orders(spark: SparkSession, sf_dir: str, p: Parameters = Parameters()) -> DataFrame:
    return scan(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"], [("o_orderdate", "<", F.lit(p.order_before).cast("timestamp_ntz"))])


def lineitems(spark: SparkSession, sf_dir: str, p: Parameters = Parameters()) -> DataFrame:
    return scan(spark, sf_dir, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount", "l_shipdate"], [("l_shipdate", ">", F.lit(p.ship_after).cast("timestamp_ntz"))])


def qualified_orders(spark: SparkSession, sf_dir: str, p: Parameters = Parameters()) -> DataFrame:
    """Orders before the cut by customers of the segment; customers only filter, so this is a semi-join."""
    return semi_join(orders(spark, sf_dir, p), customers(spark, sf_dir, p), "o_custkey", "c_custkey")


def joined(spark: SparkSession, sf_dir: str, p: Parameters = Parameters()) -> DataFrame:
    """Lineitems with their orders. Orders are the smaller side after filters; adaptive execution broadcasts them when their
    measured size allows, and otherwise both sides meet by order key, which also serves the aggregation."""
    o, li = qualified_orders(spark, sf_dir, p), lineitems(spark, sf_dir, p)
    return li.join(o, li.l_orderkey == o.o_orderkey)


def revenues(spark: SparkSession, sf_dir: str, p: Parameters = Parameters()) -> DataFrame:
    groups = joined(spark, sf_dir, p).groupBy("l_orderkey", "o_orderdate", "o_orderpriority")
    return groups.agg(total(revenue()).alias("revenue")).select("l_orderkey", "revenue", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")


def shipping_priority(spark: SparkSession, sf_dir: str, p: Parameters = Parameters()) -> DataFrame:
    """At most k orders by revenue (largest first), date and key."""
    return top_k(revenues(spark, sf_dir, p), p.k, F.desc("revenue"), "o_orderdate", "l_orderkey")


def shipping_priority_sql(spark: SparkSession, sf_dir: str, p: Parameters = Parameters()) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(
        """SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue,
             CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority
           FROM customer, orders, lineitem
           WHERE c_mktsegment = :segment AND c_custkey = o_custkey AND l_orderkey = o_orderkey
             AND o_orderdate < CAST(:before AS TIMESTAMP_NTZ) AND l_shipdate > CAST(:after AS TIMESTAMP_NTZ)
           GROUP BY l_orderkey, o_orderdate, o_orderpriority
           ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT """ + str(int(p.k)),
        args={"segment": p.segment, "before": str(p.order_before), "after": str(p.ship_after)},
    )


def as_text(df: DataFrame) -> str:
    """The result (at most k rows) as a table of fixed widths."""
    rows = [f"{'l_orderkey':>12} {'revenue':>14} {'o_orderdate':>12} {'priority':>14}", "-" * 55]
    rows += [f"{r[0]:>12} {r[1]:>14.4f} {r[2]!s:>12} {r[3]:>14}" for r in df.collect()]
    return "\n".join(rows)


def to_csv(df: DataFrame, path: str) -> None:
    """The result (at most k rows) as one CSV file, revenue with four decimals."""
    with open(path, "w") as f:
        f.write(",".join(df.columns) + "\n")
        f.writelines(f"{r[0]},{r[1]:.4f},{r[2]},{r[3]}\n" for r in df.collect())
