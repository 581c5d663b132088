"""The shipping-priority query against DuckDB on the same files: results, and times."""

from __future__ import annotations

import os
import platform
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from . import shipping

#: Fixed value: how far a revenue may be off, as both sides may have summed in double.
TOLERANCE = 0.01


def duckdb_connection(data: str, threads: int | None = None):
    import duckdb

    con = duckdb.connect()
    if threads:
        con.execute(f"PRAGMA threads={threads}")
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def compare(expected: list[tuple], got: list[tuple], tolerance: float = TOLERANCE) -> list[tuple[str, bool, str]]:
    """Checks (name, whether it holds, detail) of two results of rows (key, revenue, date, priority), in order."""
    column = lambda rows, i: [str(r[i])[:10] if i == 2 else r[i] for r in rows]
    checks = [("row count", len(expected) == len(got), f"expected {len(expected)}, got {len(got)}")]
    checks.append(("l_orderkey", column(expected, 0) == column(got, 0), f"expected {column(expected, 0)}, got {column(got, 0)}"))
    off = max((abs(a[1] - b[1]) for a, b in zip(expected, got)), default=0.0) if len(expected) == len(got) else float("inf")
    checks.append(("revenue", off <= tolerance, f"largest difference {off:.6f}, tolerance {tolerance}"))
    for i, name in ((2, "o_orderdate"), (3, "o_orderpriority")):
        checks.append((name, column(expected, i) == column(got, i), ""))
    return checks


def validate(spark: SparkSession, data: str, sql: str, p: shipping.Parameters = shipping.Parameters(), tolerance: float = TOLERANCE) -> list[tuple[str, bool, str]]:
    con = duckdb_connection(data)
    try:
        expected = con.execute(sql).fetchall()
    finally:
        con.close()
    return compare(expected, [tuple(r) for r in shipping.shipping_priority(spark, data, p).collect()], tolerance)


def timed(runs: int, once: Callable[[], dict[str, float]]) -> dict:
    """Phases and total of each run; the first is a warm-up, and the averages are of the others (or of it, if alone)."""
    each = [once() for _ in range(max(1, runs))]
    measured = each[1:] or each
    phases = {k: sum(x[k] for x in measured) / len(measured) for k in measured[0]}
    return {"warmup": each[0]["total"], "times": [x["total"] for x in measured], "avg": phases["total"], "phases": phases}


def time_duckdb(data: str, sql: str, runs: int) -> dict:
    """DuckDB with one thread; connecting and registering the files does not count."""

    def once() -> dict[str, float]:
        con = duckdb_connection(data, 1)
        began = time.perf_counter()
        con.execute(sql).fetchall()
        took = time.perf_counter() - began
        con.close()
        return {"total": took}

    return timed(runs, once)


def time_spark(spark: SparkSession, data: str, runs: int) -> dict:
    """Spark fuses scan, joins and aggregation, so the phases are planning and running."""

    def once() -> dict[str, float]:
        began = time.perf_counter()
        df = shipping.shipping_priority(spark, data)
        df._jdf.queryExecution().executedPlan()
        planned = time.perf_counter()
        df.collect()
        return {"plan": planned - began, "run": time.perf_counter() - planned, "total": time.perf_counter() - began}

    return timed(runs, once)


def benchmark(spark: SparkSession, folders: list[str], sql: str, runs: int = 6) -> list[dict]:
    """For each folder that exists: both times, their ratio and a verdict on it."""
    out = []
    for data in folders:
        if not Path(data).is_dir():
            out.append({"data": data, "skipped": True})
            continue
        duck, own = time_duckdb(data, sql, runs), time_spark(spark, data, runs)
        ratio = own["avg"] / duck["avg"] if duck["avg"] else float("inf")
        said = "faster" if ratio < 1 else "within 2x" if ratio < 2 else "within 5x" if ratio < 5 else f"{ratio:.1f}x slower"
        out.append({"data": data, "duckdb": duck, "spark": own, "ratio": ratio, "verdict": said})
    return out


def machine() -> dict:
    return {"platform": platform.platform(), "processor": platform.processor(), "cpu_count": os.cpu_count(), "python": platform.python_version(), "machine": platform.machine()}


def summary(results: list[dict]) -> str:
    """A table with a row for each folder, the phases, and the machine."""
    lines = [f"{'data':<28} {'DuckDB (s)':>12} {'Spark (s)':>12} {'ratio':>8}", "-" * 63]
    for r in results:
        name = Path(r["data"]).name
        if r.get("skipped"):
            lines.append(f"{name:<28} not found")
            continue
        lines.append(f"{name:<28} {r['duckdb']['avg']:>12.4f} {r['spark']['avg']:>12.4f} {r['ratio']:>7.2f}x  {r['verdict']}")
        total = r["spark"]["phases"]["total"] or 1.0
        lines += [f"  {k:<26} {v:>12.4f} s {100 * v / total:>6.1f} %" for k, v in r["spark"]["phases"].items()]
    m = machine()
    return "\n".join([*lines, "", f"Machine: {m['processor'] or m['machine']}, {m['cpu_count']} cores, Python {m['python']}, {m['platform']}"])
