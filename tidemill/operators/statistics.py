"""Exact medians that no single task has to hold all values for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values that one task may sort.
AT_ONCE = 200_000
BUCKETS = 4096


def median_of_counts(counts: DataFrame, value: str, n: str) -> DataFrame:
    """One row: the median of values that occur n times each. counts has a row per distinct value, and should be short."""
    upto = F.sum(n).over(Window.orderBy(value))
    ranked = counts.select(F.col(value).cast("double").alias("v"), upto.alias("upto"), F.sum(n).over(Window.partitionBy()).alias("all"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    return ranked.agg(((at(F.floor((F.col("all") - 1) / 2)) + at(F.floor(F.col("all") / 2))) / 2).alias("median"))


def medians(df: DataFrame, columns: list[str], at_once: int = AT_ONCE, buckets: int = BUCKETS) -> dict[str, float | None]:
    """The exact median of each column, as double; None without values. Histograms narrow each column down to the buckets
    that hold its middle values, by one pass over df a round, until few enough values are left to be sorted."""
    v = {c: F.col(c).cast("double") for c in columns}
    first = df.agg(*(x for i, c in enumerate(columns) for x in (F.min(v[c]).alias(f"lo{i}"), F.max(v[c]).alias(f"hi{i}"), F.count(v[c]).alias(f"n{i}")))).first()
    # For each column: the range that holds both middle values, the values below it and in it, and the middle ranks.
    state = {c: [first[f"lo{i}"], first[f"hi{i}"], 0, first[f"n{i}"], (first[f"n{i}"] - 1) // 2, first[f"n{i}"] // 2] for i, c in enumerate(columns)}
    out: dict[str, float | None] = {}
    while open_ := [c for c in columns if c not in out]:
        for c in open_:
            lo, hi, _, n, _, _ = state[c]
            if not n or lo == hi:
                out[c] = lo if n else None
        wide = [c for c in open_ if c not in out and state[c][3] > at_once]
        near = [c for c in open_ if c not in out and c not in wide]
        if near:
            # Below `at_once` values are left; the middle of what the range holds is found by rank.
            picked = df.agg(*(F.sort_array(F.collect_list(F.when((v[c] >= state[c][0]) & (v[c] <= state[c][1]), v[c]))).alias(f"x{i}") for i, c in enumerate(near)))
            picked = picked.select(*(F.struct(*(F.get(f"x{i}", F.lit(state[c][r] - state[c][2])).alias(f"r{r}") for r in (4, 5))).alias(f"x{i}") for i, c in enumerate(near))).first()
            out |= {c: (picked[i]["r4"] + picked[i]["r5"]) / 2 for i, c in enumerate(near)}
        if wide:
            place = {c: F.least(F.floor((v[c] - state[c][0]) / ((state[c][1] - state[c][0]) / buckets)), F.lit(buckets - 1)) for c in wide}
            there = F.array(*(F.when((v[c] >= state[c][0]) & (v[c] <= state[c][1]), F.struct(F.lit(c).alias("c"), place[c].alias("b"), v[c].alias("v"))) for c in wide))
            rows = df.select(F.explode(F.filter(there, lambda x: x.isNotNull())).alias("x")).groupBy("x.c", "x.b").agg(F.count("*").alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi"))
            found = sorted(rows.collect(), key=lambda r: (r.c, r.b))  # at most `buckets` rows a column
            for c in wide:
                below, (low, high) = state[c][2], state[c][4:]
                inside = []
                for r in (r for r in found if r.c == c):
                    if below + r.n > low and below <= high:
                        inside.append((r, below))
                    below += r.n
                state[c][:4] = [inside[0][0].lo, inside[-1][0].hi, inside[0][1], sum(r.n for r, _ in inside)]
                if len(inside) == 2:  # the middle values are the ends of two buckets
                    out[c] = (inside[0][0].hi + inside[1][0].lo) / 2
    return out
