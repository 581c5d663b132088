"""The shipping-priority query on the command line.

python -m tidemill.cli --data DIR                     run it and print the result
python -m tidemill.cli --data DIR --out FILE          write the result as CSV
python -m tidemill.cli --data DIR --validate          compare it with DuckDB; exit code 1 if they differ
python -m tidemill.cli --data DIR --benchmark         time it against DuckDB
python -m tidemill.cli --benchmark-all DIR...         the same for several folders, with a summary
python -m tidemill.cli --data DIR --report [--scaling DIR...]
"""

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .plans import report, validate
from .plans.shipping import Parameters, as_text, shipping_priority, to_csv
from .queries import q3_sql_text


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--data", help="folder with customer.parquet, orders.parquet and lineitem.parquet")
    parser.add_argument("--out", help="CSV file for the result")
    parser.add_argument("--segment", default="BUILDING")
    parser.add_argument("--validate", action="store_true")
    parser.add_argument("--benchmark", action="store_true")
    parser.add_argument("--benchmark-all", nargs="+", metavar="DIR")
    parser.add_argument("--runs", type=int, default=6, help="the first is a warm-up")
    parser.add_argument("--report", action="store_true")
    parser.add_argument("--scaling", nargs="+", default=[], metavar="DIR")
    given = parser.parse_args(args)
    if not given.data and not given.benchmark_all:
        parser.error("--data is required (or --benchmark-all)")
    spark = SparkSession.builder.getOrCreate()
    sql, p = q3_sql_text(given.segment), Parameters(segment=given.segment)
    if given.benchmark or given.benchmark_all:
        print(validate.summary(validate.benchmark(spark, given.benchmark_all or [given.data], q3_sql_text(), given.runs)))
    elif given.validate:
        checks = validate.validate(spark, given.data, sql, p)
        for name, holds, detail in checks:
            print(f"[{'PASS' if holds else 'FAIL'}] {name}" + f"  ({detail})" * bool(detail))
        return int(not all(holds for _, holds, _ in checks))
    elif given.report:
        for part in report.report(spark, given.data, given.scaling):
            print(part, end="\n\n")
    else:
        began = time.perf_counter()
        result = shipping_priority(spark, given.data, p)
        if given.out:
            to_csv(result, given.out)
            print(f"Result written to {given.out}")
        else:
            print(as_text(result))
        print(f"\nTotal time: {time.perf_counter() - began:.4f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
