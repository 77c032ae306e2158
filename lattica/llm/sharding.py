"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 without gaps, the number is sent through a keyed
bijection of that range, and shard and slot follow by arithmetic: anyone who
knows (n, seed, shards) can compute where row r lies, and which row lies at
(shard, slot), without the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import checkpoint, number_rows

SHARDS = 16
SEED = 20_240_611


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class FeistelPermutation:
    """A keyed bijection of range(n).

    A balanced Feistel network permutes the least even power of two that holds
    n; a value that falls outside range(n) walks its cycle until it is inside.
    The power is at most 4n, so a walk takes under four steps on average, and it
    always ends since the cycle holds the inside value it began with.
    """

    def __init__(self, n: int, seed: int = SEED, rounds: int = 8):
        if n < 0:
            raise ValueError("n must not be negative")
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        with np.errstate(over="ignore"):
            self.keys = [_mix(np.array([(seed * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0] for i in range(1, rounds + 1)]

    def _step(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        with np.errstate(over="ignore"):
            if back:
                for key in reversed(self.keys):
                    left, right = right ^ (_mix(left + key) & self.mask), left
            else:
                for key in self.keys:
                    left, right = right, left ^ (_mix(right + key) & self.mask)
        return (left << self.half) | right

    def _walk(self, values, back: bool) -> np.ndarray:
        x = np.asarray(values, dtype=np.int64)
        if x.size and (x.min() < 0 or x.max() >= self.n):
            raise ValueError("value outside the permuted range")
        y = self._step(x.astype(np.uint64), back)
        while (out := np.flatnonzero(y >= np.uint64(self.n))).size:
            y[out] = self._step(y[out], back)
        return y.astype(np.int64)

    def forward(self, values) -> np.ndarray:
        return self._walk(values, False)

    def inverse(self, values) -> np.ndarray:
        return self._walk(values, True)


def shard_rows(df: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add row_number, position, shard and slot (all long but shard, an int).

    ``keys`` decide the row numbers; rows equal in all keys may swap. Shard
    counts differ by one at most and slots of a shard are 0..count-1. Nulls in
    keys order like any value; an empty table gives an empty one. Columns named
    like the added ones are refused with ValueError. Other columns pass through.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    if clash := {"row_number", "position", "shard", "slot"} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    rows = checkpoint(df)
    n = rows.count()
    numbered = number_rows(rows, keys, "row_number", rows=n)
    spec = (n, seed)

    @F.pandas_udf("long")
    def permuted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        permutation = FeistelPermutation(*spec)
        for s in batches:
            yield pd.Series(permutation.forward(s.to_numpy()))

    placed = numbered.withColumn("position", permuted("row_number"))
    return placed.withColumn("shard", F.pmod("position", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"position div {shards}"))


def document_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size and text_crc32 of each document; a null text counts as empty, any other column is left out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The `rows` law over documents: only ids, sizes and checksums are moved, never texts."""
    placed = shard_rows(document_keys(docs), ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")
