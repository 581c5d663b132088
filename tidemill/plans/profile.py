"""The profiling report: what explains the shipping-priority query's behaviour, a query per table of the report."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import ratio, revenue, total
from ..operators.relational import histogram
from ..operators.statistics import median_of_counts, medians
from ..sources.footers import footers
from ..sources.tables import read
from . import shipping

CUT = shipping.Parameters().order_before
NEEDED = {"customer": ["c_custkey", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"], "lineitem": ["l_orderkey", "l_extendedprice", "l_discount", "l_shipdate"]}


def cut() -> Column:
    return F.lit(CUT).cast("timestamp_ntz")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for table, columns in NEEDED.items():
        df = read(spark, sf_dir, table)
        text = lambda c: (F.date_format(c, "yyyy-MM-dd") if "date" in c else F.col(c).cast("decimal(12,2)").cast("string") if c in ("l_extendedprice", "l_discount") else F.col(c).cast("string"))
        as_key = lambda c: F.col(c).cast("decimal(12,2)") if c in ("l_extendedprice", "l_discount") else F.col(c)
        one = df.agg(*(F.struct(F.lit(c).alias("column_name"), F.count_distinct(as_key(c)).alias("n_distinct"), F.min_by(text(c), as_key(c)).alias("min_value"), F.max_by(text(c), as_key(c)).alias("max_value")).alias(c) for c in columns))
        out.append(one.select(F.lit(table).alias("table_name"), F.explode(F.array(*columns)).alias("x")).select("table_name", "x.*"))
    return union(out)


def segment_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return n.select("c_mktsegment", "n", (F.lit(100.0).cast("double") * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("pct"))


def marked(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """df with column found: whether its key is among the keys."""
    keys = keys.toDF("found_key").distinct().withColumn("found", F.lit(True))
    return df.join(keys, df[key] == keys["found_key"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def filter_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before and after each filter: one pass over each table, with the keys that its semi-join looks for."""
    early, late = F.col("o_orderdate") < cut(), F.col("l_shipdate") > cut()
    c = read(spark, sf_dir, "customer").select((F.col("c_mktsegment") == shipping.Parameters().segment).alias("hit"))
    o = marked(read(spark, sf_dir, "orders"), "o_custkey", shipping.customers(spark, sf_dir).select("c_custkey"))
    li = marked(read(spark, sf_dir, "lineitem"), "l_orderkey", shipping.qualified_orders(spark, sf_dir).select("o_orderkey"))

    def stages(df: DataFrame, **hits: Column) -> DataFrame:
        counts = df.agg(F.count("*").alias("rows_in"), *(F.count_if(hit).alias(name) for name, hit in hits.items()))
        each = F.explode(F.array(*(F.struct(F.lit(name).alias("stage"), F.col(name).alias("rows_out")) for name in hits))).alias("x")
        return counts.select("rows_in", each).select("x.stage", "rows_in", "x.rows_out", ratio(F.col("x.rows_out"), F.col("rows_in")).alias("selectivity"))

    return union([
        stages(c, customer_segment=F.col("hit")),
        stages(o, orders_date=early, orders_date_semi=early & F.col("found")),
        stages(li, lineitem_shipdate=late, lineitem_shipdate_join=late & F.col("found")),
    ])


def per_key(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    return read(spark, sf_dir, table).groupBy(key).agg(F.count("*").alias("n"))


def fanout(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """Rows per key. All is computed from how many keys have how many rows, which is short."""
    c = per_key(spark, sf_dir, table, key).groupBy("n").agg(F.count("*").alias("keys"))
    keys, rows = F.sum("keys"), F.sum(F.col("n") * F.col("keys"))
    whole = Window.partitionBy()
    mean = F.sum(F.col("n") * F.col("keys")).over(whole) / F.sum("keys").over(whole)
    spread = c.withColumn("off", (F.col("n") - mean) ** 2 * F.col("keys"))
    stats = spread.agg(
        keys.alias("n_keys"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.round(rows / keys, 6).alias("mean_n"), F.round(F.sqrt(F.sum("off") / keys), 6).alias("stddev_n"),
    )
    return stats.join(F.broadcast(median_of_counts(c, "n", "keys").withColumnRenamed("median", "median_n")))


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(table: str, key: str) -> DataFrame:
        x = read(spark, sf_dir, table).agg(F.count(key).alias("n_rows"), F.count_distinct(key).alias("n_distinct"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))
        x = x.withColumn("key_range", F.col("max_key") - F.col("min_key") + 1)
        return x.select(F.lit(key).alias("key"), "n_rows", "n_distinct", "min_key", "max_key", "key_range", ratio(F.col("n_distinct"), F.col("key_range")).alias("density"))

    return union([one("customer", "c_custkey"), one("orders", "o_orderkey")])


def memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Megabytes that a dictionary, a directly indexed array and a sorted array of a tenth of the order keys take.

    Fixed values, of the report: 100 bytes for an entry of a dictionary, 16 for one of a direct index, 8 for one of an array."""
    x = density(spark, sf_dir).where(F.col("key") == "o_orderkey").withColumn("est", F.expr("n_distinct div 10"))
    return x.select(F.col("est").alias("est_entries"), F.expr("est * 100 div 1048576 + 1").alias("dict_mb"), F.expr("key_range * 16 div 1048576").alias("direct_mb"), F.expr("est * 8 div 1048576 + 1").alias("sorted_mb"))


def gap_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between the 100 smallest order keys, the five most frequent."""
    keys = read(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").limit(100)
    gaps = keys.select((F.col("o_orderkey") - F.lag("o_orderkey").over(Window.orderBy("o_orderkey"))).alias("gap")).where("gap IS NOT NULL")
    return gaps.groupBy("gap").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gap").limit(5)


def price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution of prices, discounts and revenues: one pass for all, and those that the medians take."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), F.col("l_discount").cast("decimal(4,2)").alias("discount"), revenue().alias("revenue"))
    middle = medians(li, li.columns)

    def one(name: str) -> Column:
        v = F.col(name).cast("double")
        return F.struct(
            F.lit(name).alias("measure"), F.min(v).alias("min_v"), F.max(v).alias("max_v"), F.round(total(F.col(name)) / F.count(name), 6).alias("mean_v"),
            F.round(F.stddev_pop(v), 4).alias("stddev_v"), F.round(F.lit(middle[name]).cast("double"), 6).alias("median_v"),
        ).alias(name)

    return li.agg(*map(one, li.columns)).select(F.explode(F.array(*li.columns)).alias("x")).select("x.*")


def discount_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_discount").cast("decimal(4,2)").cast("double").alias("l_discount")).distinct().orderBy("l_discount")


def order_revenues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(revenue()).alias("r"))


def order_revenue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("r").cast("double")
    orders = order_revenues(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)  # for the passes of the median
    try:
        middle = medians(orders, ["r"])["r"]
        stats = orders.agg(F.count("*").alias("n_orders"), F.min(v).alias("min_v"), F.max(v).alias("max_v"), F.round(total(F.col("r")) / F.count("*"), 6).alias("mean_v")).first()
    finally:
        orders.unpersist()
    row = (stats.n_orders, stats.min_v, stats.max_v, stats.mean_v, middle)
    out = spark.createDataFrame([row], "n_orders long, min_v double, max_v double, mean_v double, median_v double")
    return out.withColumn("median_v", F.round("median_v", 6))


def kth_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10th and the 100th largest order revenue; null where there are fewer orders."""
    best = order_revenues(spark, sf_dir).orderBy(F.desc("r")).limit(100).agg(F.sort_array(F.collect_list("r"), asc=False).alias("r"))
    return best.select(F.explode(F.array(F.lit(10), F.lit(100))).alias("k"), "r").select("k", F.get("r", F.col("k") - 1).cast("double").alias("revenue"))


def orderdate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.col("o_orderdate") < cut()
    return read(spark, sf_dir, "orders").agg(F.count_if(early).alias("before_cut"), F.count_if(~early).alias("on_or_after_cut"))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each month from 1994-10 to 1995-08, also of those without any."""
    months = spark.range(1).select(F.explode(F.expr("sequence(DATE'1994-10-01', DATE'1995-08-01', INTERVAL 1 MONTH)")).alias("month"))
    counts = read(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ'1994-10-01' AND o_orderdate < TIMESTAMP_NTZ'1995-09-01'")
    counts = counts.groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(F.count("*").alias("n"))
    return months.join(F.broadcast(counts), "month", "left").select("month", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def scaling(spark: SparkSession, *sf_dirs: str) -> DataFrame:
    """Rows of the tables, and lineitems after the filter, of each scale factor in order: one pass a table."""
    out = []
    for sf_dir in sf_dirs:
        counts = [read(spark, sf_dir, t).agg(F.lit(f"{t}_rows").alias("name"), F.count("*").alias("n"), F.lit(None).cast("long").alias("kept")) for t in ("customer", "orders")]
        counts.append(read(spark, sf_dir, "lineitem").agg(F.lit("lineitem_rows").alias("name"), F.count("*").alias("n"), F.count_if(F.col("l_shipdate") > cut()).alias("kept")))
        each = [F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in ("customer_rows", "orders_rows", "lineitem_rows")]
        out.append(union(counts).agg(*each, F.max("kept").alias("lineitem_filtered")))
    return union(out)


def parquet_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union([footers(spark, f"{sf_dir}/{t}.parquet").select(F.lit(t).alias("table_name"), "*") for t in NEEDED])


def parquet_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File size in MiB, rows, row groups and bytes of each table, its compression, the share of the columns that the query
    reads and the MiB that projection saves; and a row for the total of the files."""
    rows = parquet_row_groups(spark, sf_dir)
    needed = F.lit(False)
    for t, columns in NEEDED.items():
        needed = needed | ((F.col("table_name") == t) & F.col("column_name").isin(columns))
    groups = rows.groupBy("table_name", "file", "row_group").agg(
        F.first("file_bytes").alias("file_bytes"), F.first("group_rows").alias("rows"), F.count("*").alias("cols"), F.sum("compressed").alias("c"), F.sum("uncompressed").alias("u"), F.sum(F.when(needed, F.col("compressed")).otherwise(0)).alias("q")
    )
    mib = lambda x: x / F.lit(1024.0 * 1024.0)
    file_mib = mib(F.sum(F.when(F.col("row_group") == 0, F.col("file_bytes")).otherwise(0))).alias("file_mib")
    tables = groups.groupBy("table_name").agg(
        file_mib, F.sum("rows").alias("n_rows"), F.count("*").alias("n_groups"), F.max("cols").alias("n_columns"), F.min("rows").alias("min_group_rows"), F.max("rows").alias("max_group_rows"), F.avg("rows").alias("avg_group_rows"),
        F.sum("c").alias("compressed"), F.sum("u").alias("uncompressed"), ratio(F.sum("u"), F.sum("c")).alias("compression"), F.sum("q").alias("needed_bytes"), ratio(F.sum("q"), F.sum("c")).alias("needed_share"),
        mib(F.sum("c") - F.sum("q")).alias("saved_mib"),
    )
    return tables.unionByName(groups.agg(F.lit("TOTAL").alias("table_name"), file_mib), allowMissingColumns=True)


# The columns that the report looks at, by table.
SORT_COLUMNS = {"customer": ["c_custkey", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderdate"], "lineitem": ["l_orderkey", "l_shipdate"]}


def parquet_sort_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the row groups' ranges of a column are apart (sorted, partly or unsorted), the first and last range, and how
    many groups the query's cut-off skips (null for columns that it does not filter)."""
    wanted = F.lit(False)
    for t, columns in SORT_COLUMNS.items():
        wanted = wanted | ((F.col("table_name") == t) & F.col("column_name").isin(columns))
    rows = parquet_row_groups(spark, sf_dir).where(wanted & F.col("min_value").isNotNull())
    order = Window.partitionBy("table_name", "column_name").orderBy("file", "row_group")
    below = F.coalesce(F.col("min_number") <= F.lag("max_number").over(order), F.col("min_value") <= F.lag("max_value").over(order))
    rows = rows.withColumn("overlap", F.coalesce(below.cast("int"), F.lit(0)))
    skip = F.when(F.col("column_name") == "o_orderdate", F.col("min_value") >= str(CUT)).when(F.col("column_name") == "l_shipdate", F.col("max_value") <= str(CUT))
    place, span = F.struct("file", "row_group"), F.concat_ws("..", "min_value", "max_value")
    out = rows.groupBy("table_name", "column_name").agg(
        F.count("*").alias("n_groups"), F.sum("overlap").cast("long").alias("overlaps"), F.sum(skip.cast("long")).alias("skippable"),
        F.min_by(span, place).alias("first_range"), F.max_by(span, place).alias("last_range"),
    )
    state = F.when(F.col("overlaps") == 0, "SORTED").when(F.col("overlaps") == F.col("n_groups") - 1, "UNSORTED").otherwise("PARTIAL")
    return out.withColumn("state", state)


# The edges of the report's histograms.
ORDER_EDGES = [0, 5, 10, 15, 20, 25, 30, 50, 100]
ITEM_EDGES = [0, 1, 2, 3, 4, 5, 6, 7, 8]


def hist_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(per_key(spark, sf_dir, "orders", "o_custkey"), "n", ORDER_EDGES)


def hist_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(per_key(spark, sf_dir, "lineitem", "l_orderkey"), "n", ITEM_EDGES)
