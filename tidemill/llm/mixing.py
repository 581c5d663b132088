"""Mixing sources to target weights by capped water-filling.

Every source gets a share of all words by its weight, but no more than ``cap`` times its own words (the most epochs); what
the cap takes away is dealt to the others by weight until none is above. With sources ordered by cap / weight the full ones
are a prefix, so one running sum over a row per source finds the level at which the others stand.

A source's target is then taken as whole copies of all its documents and one fractional copy: documents in the order of a
seeded hash of id and text while their sizes fit; past one that does not fit, each round takes from there on what fits among
documents of at most what is left, and halves the largest size admitted, so that the rounds are as few as the target has
binary digits; at last the one further document that comes nearest to what is left. The choice is a hash range and a size
for each round and one document a source, so that applying it to the documents needs no shuffle.

Equal rows share a hash. They are counted as one group before anything is shuffled, however many they are, and a group is
taken in part where only some of its rows fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import BROADCAST_ROWS, drop, small, stored

WHITE = " \t\n\x0b\x0c\r"
#: Hex digits of the hash whose sums find the place where a source's rest ends.
DIGITS = 4


def word_count(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(F.length(t) > 0, F.size(F.split(t, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def seeded(doc_id: Column, text: Column, seed: int) -> Column:
    """The place of a document in the seeded order: the same wherever and whenever it is computed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))))


def water_fill(sources: DataFrame, cap: float = 3.0, weights: tuple = (1, 2, 3)) -> DataFrame:
    """source, source_size -> with target. Sources by code point, null last, take the weights in turn."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights))
    s = sources.withColumn("weight", weight.cast("double"))
    limit = F.col("source_size") * F.lit(float(cap))
    full_first = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = full_first.rowsBetween(Window.unboundedPreceding, -1)
    after = full_first.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    s = s.select("source", "source_size", "weight", limit.alias("limit"), (left / F.sum("weight").over(after)).alias("level"), F.row_number().over(full_first).alias("at"))
    full = F.col("weight") * F.col("level") >= F.col("limit")
    s = s.withColumn("found", F.min(F.when(~full, F.struct("at", "level"))).over(all_rows))
    below = F.coalesce(F.col("at") < F.col("found.at"), F.lit(True))
    return s.select("source", "source_size", F.when(below, F.col("limit")).otherwise(F.col("weight") * F.col("found.level")).alias("target"))


def in_ranges(h: Column, size: Column) -> Column:
    """Whether a round of the plan took the documents of that hash and size."""
    return F.coalesce(F.exists("ranges", lambda x: (h > x["start"]) & (h <= x["upto"]) & (size <= x["most"])), F.lit(False))


def of_source(df: DataFrame, other: DataFrame, few: bool) -> DataFrame:
    """df with what other, at most a row per source, has for its source. few: there are so few sources that it is sent to
    all tasks."""
    other = other.withColumnRenamed("source", "its")
    return df.join(F.broadcast(other) if few else other, F.col("source").eqNullSafe(F.col("its"))).drop("its")


def cut(groups: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """One round. state (source, start, most, rest) with upto, the last hash after start whose groups of documents of size
    at most most still fit as a whole, and left; stop, the group that does not fit (null if all fit), and some, how many of
    its rows do."""
    # Sums of hash buckets find where the rest ends, and only that bucket is gone through group by group.
    bucket = F.substring("h", 1, DIGITS)
    able = of_source(groups, state, few).where((F.col("h") > F.col("start")) & (F.col("size") <= F.col("most")))
    able = able.withColumn("all", F.col("size") * F.col("m"))
    sums = able.groupBy("source", "rest", bucket.alias("bucket")).agg(F.sum("all").alias("sum"))
    sums = sums.withColumn("so_far", F.sum("sum").over(Window.partitionBy("source").orderBy("bucket")))
    ends = sums.where(F.col("so_far") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("so_far") - F.col("sum")).alias("before"))).alias("x"))
    ends = ends.select("source", F.col("x.bucket").alias("bucket"), F.col("x.before").alias("before"))
    rows = of_source(able, ends, few).where(bucket == F.col("bucket"))
    rows = rows.withColumn("sum", F.col("before") + F.sum("all").over(Window.partitionBy("source").orderBy("h")))
    fits = F.col("sum") <= F.col("rest")
    partly = F.floor((F.col("rest") - F.col("sum") + F.col("all")) / F.col("size"))
    rows = rows.groupBy("source").agg(
        F.max(F.when(fits, F.col("h"))).alias("in_bucket"), F.max(F.when(fits, F.col("sum"))).alias("in_sum"),
        F.min(F.when(~fits, F.struct("h", partly.alias("some"), "size"))).alias("x"), F.first("bucket").alias("bucket"), F.first("before").alias("before"),
    )
    # A bare bucket sorts before all hashes in it, and so takes the buckets before it and none of its own; "~" sorts after all.
    used = F.coalesce("in_sum", "before") + F.col("x.some") * F.col("x.size")
    rows = rows.select(F.col("source").alias("c"), F.coalesce("in_bucket", "bucket").alias("upto"), used.alias("used"), F.col("x.h").alias("stop"), F.col("x.some").alias("some"))
    every = sums.groupBy(F.col("source").alias("e")).agg(F.sum("sum").alias("every"))
    found = state.join(rows, F.col("source").eqNullSafe(F.col("c")), "left").join(every, F.col("source").eqNullSafe(F.col("e")), "left")
    left = F.col("rest") - F.coalesce("used", "every", F.lit(0))
    return found.select("source", "start", "most", F.coalesce("upto", F.lit("~")).alias("upto"), left.alias("left"), "stop", F.coalesce("some", F.lit(0)).alias("some"))


def mixing_plan(groups: DataFrame, cap: float, weights: tuple) -> tuple[DataFrame, DataFrame]:
    """A row per source: its, source_size, target, whole (copies of all), ranges (documents of which hashes and sizes get
    one more), also (further hashes that do). And a row per group of equal rows of which only some get one more: its, h,
    some. groups: source, size, h, m (rows)."""
    sources = water_fill(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), cap, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole)
    sources = stored(sources.withColumn("gap", F.col("target") - F.col("whole") * F.col("source_size")), "sources")
    few = sources.count() <= BROADCAST_ROWS
    state = sources.select("source", F.lit("").alias("start"), F.lit(float("inf")).alias("most"), F.col("gap").alias("rest"))
    cuts, last = None, stored(cut(groups, state, few), "cuts")
    while True:
        cuts = last if cuts is None else cuts.union(last)
        state = last.where("stop is not null").select("source", F.col("stop").alias("start"), F.least(F.col("left"), F.col("most") / 2).alias("most"), F.col("left").alias("rest")).where("most >= 1")
        if not state.limit(1).count():
            break
        last = stored(cut(groups, state, few), "cuts")
    ranges = F.collect_list(F.struct("start", "most", "upto")).alias("ranges")
    partial = F.collect_list(F.when(F.col("some") > 0, F.struct(F.col("stop").alias("h"), "some"))).alias("partial")
    cuts = stored(cuts.groupBy("source").agg(ranges, partial, F.min("left").alias("rest")), "ranges")  # what the last round left is the least
    near = F.abs(F.col("size") - F.col("rest"))
    picks = of_source(groups, cuts.drop("partial"), few).where(~in_ranges(F.col("h"), F.col("size")) & (F.col("size") > 0) & (near < F.col("rest")))
    picks = picks.groupBy("source").agg(F.min(F.struct(near.alias("off"), F.col("h").alias("h"))).alias("x")).select("source", F.col("x.h").alias("h"), F.lit(1).cast("long").alias("some"))
    partly = cuts.select("source", F.explode("partial").alias("x")).select("source", "x.h", "x.some").union(picks).groupBy("source", "h").agg(F.sum("some").alias("some"))
    partly = stored(groups.join(F.broadcast(partly.withColumnRenamed("source", "its").withColumnRenamed("h", "its_h")), F.col("source").eqNullSafe(F.col("its")) & (F.col("h") == F.col("its_h"))).select("its", "h", "m", "some"), "partly")
    also = partly.where("some >= m").groupBy(F.col("its").alias("p")).agg(F.collect_list("h").alias("also"))
    plan = sources.join(cuts.select(F.col("source").alias("c"), "ranges"), F.col("source").eqNullSafe(F.col("c")), "left").join(also, F.col("source").eqNullSafe(F.col("p")), "left")
    return plan.select(F.col("source").alias("its"), "source_size", "target", "whole", "ranges", F.coalesce("also", F.array().cast("array<string>")).alias("also")), partly.where("some < m").drop("m")


def with_copies(docs: DataFrame, seed: int, cap: float, weights: tuple) -> DataFrame:
    """row (a struct of all columns of docs), size, source_size, target and copies."""
    size, h = word_count(F.col("text")), seeded(F.col("doc_id"), F.col("text"), seed)
    groups = stored(docs.select("source", size.alias("size"), h.alias("h")).groupBy("source", "size", "h").agg(F.count("*").alias("m")), "groups")
    plan, partly = mixing_plan(groups, cap, weights)
    plan = stored(plan, "plan")
    drop(groups)
    rows = docs.select(F.struct("*").alias("row"), h.alias("h"), size.alias("size"))
    some, rest = None, rows
    if partly.limit(1).count():
        # Equal rows of which only some are taken, numbered by the part of the table that they are in: no part is large.
        same = F.col("row.source").eqNullSafe(F.col("its")) & (F.col("h") == F.col("its_h"))
        named = small(partly.withColumnRenamed("h", "its_h"))
        some = stored(rows.join(named, same).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "some")
        counts = some.groupBy("its", "its_h", "part").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("its", "its_h").orderBy("part")) - F.col("n")
        counts = counts.select(F.col("its").alias("c"), F.col("its_h").alias("c_h"), F.col("part").alias("c_part"), before.alias("before"))
        mine = F.row_number().over(Window.partitionBy("its", "its_h", "part").orderBy("at"))
        some = some.withColumn("mine", mine).join(small(counts), F.col("its").eqNullSafe(F.col("c")) & (F.col("its_h") == F.col("c_h")) & (F.col("part") == F.col("c_part")))
        some = some.select("row", "h", "size", (F.col("before") + F.col("mine") <= F.col("some")).alias("more"))
        rest = rows.join(named, same, "left_anti")

    def copies(df: DataFrame, more: Column) -> DataFrame:
        out = df.join(small(plan), F.col("row.source").eqNullSafe(F.col("its")))
        return out.select("row", "size", "source_size", "target", (F.col("whole") + more.cast("long")).alias("copies"))

    out = copies(rest, (F.col("size") > 0) & (in_ranges(F.col("h"), F.col("size")) | F.array_contains("also", F.col("h"))))
    return out if some is None else out.union(copies(some, F.col("more")))


def mix_sources(docs: DataFrame, seed: int = 8, cap: float = 3.0, weights: tuple = (1, 2, 3)) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies for every row of docs.

    A null text has no words; null sources are one source, the last; a null doc_id is an id of its own. Of equal rows as
    many are taken as fit, whichever they are; rows that share an id but not the text are apart. Documents without words
    count for nothing, and get whole copies only; no row gets more than ``cap``. An empty table gives no rows, and if no
    document has words every target is 0. Other columns are ignored.
    """
    out = with_copies(docs.select("doc_id", "source", "text"), seed, cap, weights)
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "row.source", "copies")


def mixed_documents(docs: DataFrame, seed: int = 8, cap: float = 3.0, weights: tuple = (1, 2, 3)) -> DataFrame:
    """docs as the mix reads them: each row as often as it is taken, with all its columns. See mix_sources."""
    out = with_copies(docs, seed, cap, weights).where(F.col("copies") > 0)
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
