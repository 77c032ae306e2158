"""Shared pieces of the training-data operators.

Nothing here holds a table on the driver: the helpers cut lineage through the
shared checkpoint folder, number rows and build running sums bucket by bucket,
and label connected components with joins.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators.lineage import checkpoint, ensure_checkpoint_dir  # noqa: F401  (operators take them from here)

#: Words as the contracts define them: runs of anything but space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim_memory() -> None:
    """Hand what this process has freed back to the system; workers live on from stage to stage, and their freed memory with them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidied(work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``work`` for mapInPandas, with the worker's memory trimmed as a task ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from work(batches)
        finally:
            trim_memory()

    return run


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(rows: int, per_bucket: int = 50_000) -> int:
    """Buckets for ``rows`` rows: at least 512, so that many tasks share the work at any size."""
    return max(512, math.ceil(rows / per_bucket))


def running_sum(df: DataFrame, groups: list[str], bucket: str, order: list[Column], measure: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``measure`` over all rows of the group that come before.

    Rows of a group are ordered by ``bucket`` first, then ``order``. Only the
    sums per (group, bucket) meet in one task per group; the rows themselves are
    dealt out by (group, bucket), so a group that holds a third of the table is
    spread over all tasks. ``df`` is evaluated twice; hand in a checkpointed one.
    """
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        df.groupBy(*groups, bucket)
        .agg(F.sum(measure).alias("__sum"))
        .withColumn("__head", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
        .select(*[F.col(g).alias(f"__k{i}") for i, g in enumerate([*groups, bucket])], "__head")
    )
    rows = df.withColumn("__inside", F.coalesce(F.sum(measure).over(inside), F.lit(0)))
    same = [rows[g].eqNullSafe(heads[f"__k{i}"]) for i, g in enumerate([*groups, bucket])]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return rows.join(heads, cond).withColumn(out, F.col("__head") + F.col("__inside")).select(*df.columns, out)


def number_rows(df: DataFrame, keys: list[str], out: str, groups: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in an order that ``keys`` alone decide.

    Rows that agree in all keys may swap numbers. ``df`` should be checkpointed.
    """
    buckets = bucket_count(df.count() if rows is None else rows)
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).withColumn("__one", F.lit(1).cast("long"))
    out_df = running_sum(dealt, groups or [], "__bucket", [F.col(k) for k in keys], "__one", out)
    return out_df.drop("__bucket", "__one")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, root), root the least node reached.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). A
    step is a grouped minimum and a join on the same key; no neighbour list is
    ever gathered, so a star with millions of leaves is only a large join key,
    which adaptive execution splits. Each round is checkpointed. Nodes without
    an edge are not returned. Raises RuntimeError if it has not settled after
    ``max_rounds`` (it needs about log2 of the longest path).
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
        flat = pairs.select(lo, hi).filter("lo <> hi").distinct()
        if large:
            both = flat.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(flat.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        else:
            both = flat.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        joined = both.join(least, both.u == least.w)
        if large:
            return joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("w").alias("a"), F.col("m").alias("b")))

    now = checkpoint(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a <> b").distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    was = mark(now)
    for _ in range(max_rounds):
        now = checkpoint(star(star(now, True), False).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        is_now = mark(now)
        if tuple(is_now) == tuple(was):
            leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return leaves.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        was = is_now
    raise RuntimeError("connected components have not settled")
