"""Parquet footers as a table: a row per file, row group and column, read by a Python data source with a partition a file."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = """file string, file_bytes bigint, row_group int, group_rows bigint, column_name string, compressed bigint, uncompressed bigint,
min_value string, max_value string, min_number double, max_number double"""


def as_number(value) -> float | None:
    """A number, date or time in the order of its kind; None for others."""
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=value.tzinfo or dt.timezone.utc).timestamp()
    if isinstance(value, dt.date):
        return float(value.toordinal())
    return float(value) if isinstance(value, (int, float)) else None


class Footers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FooterReader(self.options["files"].split("\n"))


class FooterReader(DataSourceReader):
    def __init__(self, files: list[str]):
        self.files = files

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        fs, path = pafs.FileSystem.from_uri(partition.value)
        with fs.open_input_file(path) as f:
            size, meta = f.size(), pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                for c in range(group.num_columns):
                    col = group.column(c)
                    s = col.statistics
                    low, high = (s.min, s.max) if s is not None and s.has_min_max else (None, None)
                    text = [None if x is None else str(x) for x in (low, high)]
                    yield path.rsplit("/", 1)[-1], size, g, group.num_rows, col.path_in_schema, col.total_compressed_size, col.total_uncompressed_size, *text, as_number(low), as_number(high)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """The footers of all files that a Parquet path holds."""
    files = spark.read.parquet(path).inputFiles()
    spark.dataSource.register(Footers)
    return spark.read.format("parquet_footers").option("files", "\n".join(files)).load()
