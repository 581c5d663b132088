"""Every registered query outside the subpackage against DuckDB, and the operators on hand-made rows."""

import datetime as dt
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemill import cli, queries
from tidemill.operators.relational import histogram, semi_join, top_k
from tidemill.operators.statistics import medians
from tidemill.plans import profile, report, shipping, validate
from tidemill.sources.tables import read, scan

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, con, name):
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


@pytest.fixture(scope="module")
def grouped(tmp_path_factory):
    """The tables in files of several row groups: orders sorted by date, lineitem partly sorted by ship date and in two
    files, customer unsorted."""
    at = tmp_path_factory.mktemp("grouped")
    tables = {t: pq.read_table(f"{SF}/{t}.parquet") for t in ("customer", "orders", "lineitem")}
    pq.write_table(tables["customer"].take(np.random.default_rng(0).permutation(1500)), at / "customer.parquet", row_group_size=400)
    pq.write_table(tables["orders"].sort_by("o_orderdate"), at / "orders.parquet", row_group_size=2000, compression="zstd")
    items = tables["lineitem"].sort_by("l_shipdate")
    (at / "lineitem.parquet").mkdir()
    pq.write_table(items.slice(0, 30_000), at / "lineitem.parquet/a.parquet", row_group_size=10_000)
    mixed = items.slice(30_000).take(np.random.default_rng(1).permutation(30_000))
    pq.write_table(mixed, at / "lineitem.parquet/b.parquet", row_group_size=10_000)
    return at


def metadata(at, table):
    files = sorted(Path(at, f"{table}.parquet").glob("*.parquet")) if Path(at, f"{table}.parquet").is_dir() else [Path(at, f"{table}.parquet")]
    return [(f, pq.ParquetFile(f).metadata) for f in files]


@pytest.mark.parametrize("table", sorted(profile.NEEDED))
def test_row_groups(spark, grouped, table):
    want = []
    for f, m in metadata(grouped, table):
        for g in range(m.num_row_groups):
            for c in range(m.num_columns):
                x = m.row_group(g).column(c)
                s = x.statistics
                want.append((table, f.name, f.stat().st_size, g, m.row_group(g).num_rows, x.path_in_schema, x.total_compressed_size, x.total_uncompressed_size, str(s.min), str(s.max)))
    got = profile.parquet_row_groups(spark, f"file://{grouped}").where(F.col("table_name") == table).drop("min_number", "max_number")
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_structure(spark, grouped):
    got = {r.table_name: r for r in profile.parquet_structure(spark, str(grouped)).collect()}
    total = 0
    for t, needed in profile.NEEDED.items():
        groups = [m.row_group(g) for _, m in metadata(grouped, t) for g in range(m.num_row_groups)]
        size = sum(f.stat().st_size for f, _ in metadata(grouped, t))
        columns = [g.column(c) for g in groups for c in range(g.num_columns)]
        packed, plain = sum(c.total_compressed_size for c in columns), sum(c.total_uncompressed_size for c in columns)
        used = sum(c.total_compressed_size for c in columns if c.path_in_schema in needed)
        rows, r = [g.num_rows for g in groups], got[t]
        assert (r.n_rows, r.n_groups, r.n_columns, r.min_group_rows, r.max_group_rows) == (sum(rows), len(rows), groups[0].num_columns, min(rows), max(rows))
        assert (r.compressed, r.uncompressed, r.needed_bytes) == (packed, plain, used) and r.file_mib == size / 2**20
        assert r.avg_group_rows == pytest.approx(np.mean(rows)) and r.compression == pytest.approx(plain / packed) and r.needed_share == pytest.approx(used / packed)
        assert r.saved_mib == pytest.approx((packed - used) / 2**20)
        total += size
    assert got["TOTAL"].file_mib == pytest.approx(total / 2**20) and got["TOTAL"].n_rows is None


def test_sort_order(spark, grouped):
    got = {r.column_name: r for r in profile.parquet_sort_order(spark, str(grouped)).collect()}
    assert set(got) == {"c_custkey", "c_mktsegment", "o_orderkey", "o_custkey", "o_orderdate", "l_orderkey", "l_shipdate"}
    for t, columns in profile.SORT_COLUMNS.items():
        for column in columns:
            stats = [m.row_group(g).column(c).statistics for _, m in metadata(grouped, t) for g in range(m.num_row_groups) for c in range(m.num_columns) if m.row_group(g).column(c).path_in_schema == column]
            overlaps = sum(b.min <= a.max for a, b in zip(stats, stats[1:]))
            state = "SORTED" if not overlaps else "UNSORTED" if overlaps == len(stats) - 1 else "PARTIAL"
            skip = sum(s.min >= profile.CUT for s in stats) if column == "o_orderdate" else sum(s.max <= profile.CUT for s in stats) if column == "l_shipdate" else None
            r = got[column]
            assert (r.n_groups, r.overlaps, r.state, r.skippable) == (len(stats), overlaps, state, skip)
            assert r.first_range == f"{stats[0].min}..{stats[0].max}" and r.last_range == f"{stats[-1].min}..{stats[-1].max}"
    assert got["c_custkey"].state == "UNSORTED" and got["l_shipdate"].state == "PARTIAL" and got["o_orderdate"].skippable > 0


def test_footers_of_the_fixtures(spark):
    """A file of one row group is sorted as there is nothing to overlap."""
    assert {r.state for r in profile.parquet_sort_order(spark, SF).collect()} == {"SORTED"}


def test_workers_need_no_package(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    code = f"""
import sys
sys.path.insert(0, {root!r})
from tidemill import queries
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("parquet_row_groups", "parquet_structure", "parquet_sort_order"):
    assert queries.QUERIES[name](spark, {SF!r}).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]


@pytest.mark.parametrize("kind", ["spread", "hot", "few", "two", "none"])
def test_medians(spark, kind):
    rng = np.random.default_rng(3)
    values = {"spread": rng.normal(size=5001), "hot": np.concatenate([np.full(3000, 7.25), rng.normal(size=2000)]), "few": rng.integers(0, 4, 5000) * 1.0, "two": np.repeat([1.0, 2.0], 2500), "none": np.zeros(0)}[kind]
    df = spark.createDataFrame([(float(v), float(-v)) for v in values] + [(None, None)], "a double, b double").repartition(3)
    for at_once in (10, 10**6):
        got = medians(df, ["a", "b"], at_once=at_once, buckets=16)
        assert got == ({"a": np.median(values), "b": -np.median(values)} if len(values) else {"a": None, "b": None})


def test_compare():
    rows = [(1, 10.0, dt.date(1995, 1, 1), "1-URGENT"), (2, 9.0, dt.date(1995, 1, 2), "2-HIGH")]
    holds = lambda a, b: [ok for _, ok, _ in validate.compare(a, b)]
    assert holds(rows, [(1, 10.009, "1995-01-01 00:00:00", "1-URGENT"), rows[1]]) == [True] * 5
    assert holds(rows, [(1, 10.02, *rows[0][2:]), rows[1]]) == [True, True, False, True, True]
    assert holds(rows, rows[::-1]) == [True, False, False, False, False] and holds(rows, rows[:1]) == [False, False, False, False, False]
    assert holds([], []) == [True] * 5


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["--data", SF, "--validate"]) == 0 and capsys.readouterr().out.count("[PASS]") == 5
    assert cli.main(["--benchmark-all", SF, str(tmp_path / "nowhere"), "--runs", "2"]) == 0
    out = capsys.readouterr().out
    assert "sf0.01" in out and "not found" in out and "Machine:" in out and "plan" in out
    assert cli.main(["--data", SF, "--benchmark", "--runs", "1"]) == 0 and "ratio" in capsys.readouterr().out
    assert cli.main(["--data", SF, "--report", "--scaling", "/root/testdata/sf0.001"]) == 0
    out = capsys.readouterr().out
    assert all(title in out for title in report.SECTIONS) and "9. Scaling" in out and "TOTAL" in out
    assert cli.main(["--data", SF, "--out", str(tmp_path / "o.csv")]) == 0 and (tmp_path / "o.csv").read_text().count("\n") == 11
    capsys.readouterr()
    assert cli.main(["--data", SF]) == 0
    lines = capsys.readouterr().out.splitlines()
    # The widths of the text table, and a row of the known answer.
    assert lines[0].split() == ["l_orderkey", "revenue", "o_orderdate", "priority"] and lines[2].split() == ["5253", "520542.1771", "1995-01-26", "2-HIGH"] and len(lines[2]) == len(lines[0])
    with pytest.raises(SystemExit):
        cli.main([])


def test_scaling_over_folders(spark):
    got = [tuple(r)[:3] for r in profile.scaling(spark, "/root/testdata/sf0.001", SF).collect()]
    assert got == [(150, 1500, 6000), (1500, 15000, 60000)]


def test_known_answer(spark):
    rows = shipping.shipping_priority(spark, SF).collect()
    assert [(r.l_orderkey, round(r.revenue, 4), r.o_orderdate, r.o_orderpriority) for r in rows[:2]] == [(5253, 520542.1771, dt.date(1995, 1, 26), "2-HIGH"), (1181, 477990.6589, dt.date(1995, 1, 25), "3-MEDIUM")]
    assert shipping.shipping_priority(spark, SF, shipping.Parameters(segment="NONE")).collect() == []
    assert len(shipping.shipping_priority(spark, SF, shipping.Parameters(k=10**6)).collect()) == 87


def test_plan(spark):
    plan = shipping.shipping_priority(spark, SF)._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "TakeOrderedAndProject" in plan and "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan


def test_operators(spark, tmp_path):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, v string")
    right = spark.createDataFrame([(1,), (1,), (None,)], "j long")
    assert sorted(r.v for r in semi_join(left, right, "k", "j").collect()) == ["a", "b"]
    ties = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0)], "k long, r double")
    assert [r.k for r in top_k(ties, 2, F.desc("r"), "k").collect()] == [3, 1]
    bins = histogram(spark.createDataFrame([(0,), (4,), (5,), (10,), (11,)], "n long"), "n", [0, 5, 10]).orderBy("lo").collect()
    assert [(r.lo, r.hi, r.n) for r in bins] == [(0, 5, 2), (5, 10, 2)]
    with pytest.raises(FileNotFoundError):
        read(spark, str(tmp_path), "orders")
    with pytest.raises(ValueError):
        scan(spark, SF, "orders", ["o_orderkey"], [("o_orderkey", "~", 1)])
    shipping.to_csv(shipping.shipping_priority(spark, SF), str(tmp_path / "out.csv"))
    lines = (tmp_path / "out.csv").read_text().splitlines()
    assert lines[0] == "l_orderkey,revenue,o_orderdate,o_orderpriority" and lines[1] == "5253,520542.1771,1995-01-26,2-HIGH" and len(lines) == 11
