"""The profiling report as text: its sections in order, each a few short tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from . import profile

SECTIONS = {
    "1. Parquet structure": [profile.parquet_structure],
    "2. Column cardinality": [profile.cardinality, profile.segment_frequency],
    "3. Filter selectivity": [profile.filter_selectivity],
    "4. Join fan-out": [
        lambda s, d: profile.fanout(s, d, "orders", "o_custkey"), profile.hist_orders, lambda s, d: profile.fanout(s, d, "lineitem", "l_orderkey"), profile.hist_items,
    ],
    "5. Sort order and clustering": [profile.parquet_sort_order],
    "6. Key distribution": [profile.density, profile.memory_estimate, profile.gap_frequency],
    "7. Values": [profile.price_stats, profile.discount_values, profile.order_revenue_stats, profile.kth_revenue],
    "8. Order dates": [profile.orderdate_split, profile.monthly_orders],
}


def as_table(df: DataFrame) -> str:
    """All rows of a short result, in columns."""
    cell = lambda x: f"{x:.6g}" if isinstance(x, float) else "" if x is None else str(x)
    rows = [df.columns, *([cell(x) for x in r] for r in df.collect())]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    lines = ["  ".join(x.rjust(w) for x, w in zip(r, widths)) for r in rows]
    return "\n".join([lines[0], "-" * len(lines[0]), *lines[1:]])


def report(spark: SparkSession, data: str, others: list[str] = ()) -> Iterator[str]:
    """The report on a folder, section by section; with others, also how they all scale."""
    for title, tables in SECTIONS.items():
        yield title
        for table in tables:
            yield as_table(table(spark, data))
    if others:
        yield "9. Scaling"
        yield as_table(profile.scaling(spark, data, *others))
