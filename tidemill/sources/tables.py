"""The tables, with explicit schemas so that no footer is read to infer one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}
OPERATORS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; FileNotFoundError where there is none."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    try:
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{sf_dir}/{name}.parquet") from e
        raise


def scan(spark: SparkSession, sf_dir: str, name: str, columns: list[str], filters: list[tuple] = ()) -> DataFrame:
    """Columns in the order given, of the rows that pass all (column, operator, value) filters. A filter's column need not
    be among the columns; Catalyst pushes filters and columns into the Parquet scan."""
    df = read(spark, sf_dir, name)
    for column, operator, value in filters:
        if operator not in OPERATORS:
            raise ValueError(f"unknown operator {operator!r}")
        df = df.where(OPERATORS[operator](df[column], value))
    return df.select(*columns)


def register(spark: SparkSession, sf_dir: str, names=("customer", "orders", "lineitem")) -> None:
    for name in names:
        read(spark, sf_dir, name).createOrReplaceTempView(name)
