"""Benchmark decontamination: containment search for short test items in long documents.

An item of n distinct shingles is contained in a document when the document has at least ceil(0.8 n) of them, so any
n - ceil(0.8 n) + 1 of its shingles include one that the document has. Items are partitioned by size (powers of two of
their shingle counts); each partition fixes how many of the smallest hashes, the items' bottom-k MinHash sketches, are
indexed, by its largest size, and how many shingles a document must have to be probed at all. Comparing a document's own
MinHashes, as for Jaccard similarity, would miss short items in long documents: the two sets hardly overlap there. All of
a document's shingles are probed against the sketches instead, so no contained item is missed. Candidates are verified by
the exact intersection of the shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import small, stored

WHITE = " \t\n\x0b\x0c\r"


def shingle_hashes(words: Column, n: Column, k: int) -> Column:
    """Distinct hashes of k-word shingles; the whole sequence is the one shingle of a shorter text; none without words."""
    each = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(words[i + j] for j in range(k))))
    return F.when(n >= k, F.array_distinct(each)).when(n > 0, F.array(F.xxhash64(n, F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def shingled(df: DataFrame, key: str, k: int) -> DataFrame:
    """key and its shingle hashes h, in three steps that the optimizer leaves apart, so that no step is done twice."""
    words = df.select(key, F.btrim(F.lower(F.coalesce("text", F.lit(""))), F.lit(WHITE)).alias("t"))
    words = words.select(key, F.split("t", r"[\x20\x09-\x0D]+").alias("w"), F.length("t").alias("len"))
    words = words.select(key, "w", F.when(F.col("len") > 0, F.size("w")).otherwise(0).alias("n"))
    return words.select(key, shingle_hashes(F.col("w"), F.col("n"), k).alias("h"))


def required(n: Column, threshold: float) -> Column:
    """The fewest shared shingles that reach the threshold (to twelve decimals, so that 0.8 x 5 is 4)."""
    return F.ceil(F.round(n * F.lit(float(threshold)), 9)).cast("int")


def item_sketches(items: DataFrame, threshold: float) -> DataFrame:
    """item_id, h, least: the sketch's hashes and the shingles that a document of that size partition must have."""
    n = F.size("h")
    low = F.pow(F.lit(2.0), F.length(F.bin(n)) - 1).cast("int")
    high = low * 2 - 1
    sized = items.where(n > 0).select("item_id", F.array_sort("h").alias("h"), required(low, threshold).alias("least"), (high - required(high, threshold) + 1).alias("k"))
    return sized.select("item_id", "least", F.explode(F.expr("slice(h, 1, k)")).alias("h"))


def contained_items(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows doc_id, item_id, item_shingles, shared, containment for every item contained in a document.

    Texts are lower-cased; words are runs of anything but white space. Null, empty and blank texts contain nothing and
    are contained in nothing. A text of fewer than k words has its whole sequence as one shingle, which only an equally
    short text shares. Rows without id are left out. Rows that share an id are judged by themselves, and the largest
    count is returned once. Other columns are ignored. Empty tables give no rows.
    """
    items = stored(shingled(benchmark.where(F.col("item_id").isNotNull()), "item_id", k), "items")
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    sized = shingled(docs, "doc_id", k).select("doc_id", F.size("h").alias("size"), "h")  # before the explosion, whose rows would each carry the array
    # An inner explosion would infer a filter on the array's size, and push its whole computation down into the scan.
    probes = sized.select("doc_id", "size", F.explode_outer("h").alias("h"))
    sketches = item_sketches(items, threshold)
    found = probes.join(small(sketches), "h").where(F.col("size") >= F.col("least"))
    candidates = stored(found.select("doc_id", "item_id").distinct(), "candidates")
    ids = small(candidates.select("doc_id").distinct())
    sets = shingled(docs.join(ids, "doc_id", "left_semi"), "doc_id", k)
    pairs = sets.join(small(candidates), "doc_id").join(small(items.select("item_id", F.col("h").alias("item_h"))), "item_id")
    pairs = pairs.select("doc_id", "item_id", F.size("item_h").alias("item_shingles"), F.size(F.array_intersect("item_h", "h")).alias("shared"))
    pairs = pairs.where(F.col("shared") >= required(F.col("item_shingles"), threshold))
    pairs = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("shared", "item_shingles")).alias("x"))
    share = F.col("x.shared").cast("double") / F.col("x.item_shingles")
    return pairs.select("doc_id", "item_id", F.col("x.item_shingles").cast("long").alias("item_shingles"), F.col("x.shared").cast("long").alias("shared"), share.alias("containment"))
