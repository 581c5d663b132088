"""Exact money arithmetic: sums stay decimal and become double last, so results do not depend on partitioning."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def revenue(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    """price * (1 - discount) as an exact decimal."""
    return F.col(price).cast("decimal(12,2)") * (F.lit(1).cast("decimal(1,0)") - F.col(discount).cast("decimal(4,2)"))


def total(column: Column) -> Column:
    return F.sum(column).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b in double; 0 where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))
