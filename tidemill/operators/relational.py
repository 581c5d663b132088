"""The relational operators of the shipping-priority query, as DataFrame compositions that Catalyst plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of left whose key is in right: no row twice, null keys never."""
    return left.join(right, left[left_key] == right[right_key], "left_semi")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of a total order; fewer if there are fewer. Plans as a bounded heap per task."""
    return df.orderBy(*order).limit(k)


def histogram(values: DataFrame, column: str, edges: list[int]) -> DataFrame:
    """Counts per [lo, hi), the last bin closed; empty bins are zero and values outside are dropped."""
    spark, last = values.sparkSession, len(edges) - 2
    bins = spark.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    lo, hi = F.array(*map(F.lit, edges[:-1])), F.array(*map(F.lit, edges[1:]))
    bins = bins.select("bin", F.get(lo, F.col("bin")).cast("long").alias("lo"), F.get(hi, F.col("bin")).cast("long").alias("hi"))
    v = F.col(column)
    place = F.lit(None).cast("int")
    for i in range(last, -1, -1):
        place = F.when((v >= edges[i]) & ((v <= edges[i + 1]) if i == last else (v < edges[i + 1])), F.lit(i)).otherwise(place)
    counts = values.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(F.broadcast(counts), "bin", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
