"""Document fingerprints from closed syncmers.

A k-mer of UTF-8 bytes is chosen if the least of its s-mers (by hash) stands at
its first or last place. The choice looks at the k-mer alone, so equal passages
choose equal anchors whatever surrounds them. The fingerprint keeps the least
anchor hashes (a bottom sketch) with their positions: hashes tell how much two
texts share, positions where, and by how far it was moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import partitions, tidied

#: One rule for texts of any length; every 15 bytes or more hold an anchor (k + k - s - 1).
K, S = 12, 8
SKETCH = 64
#: Documents in an id range, and most ranges: their ends (8 bytes each) are held on the driver and sent with the tasks.
PER_RANGE, MOST_RANGES = 4000, 20_000
_PAD = bytes(16)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _grams(data: bytes, n: int, size: int) -> np.ndarray:
    """A hash of each of the n windows of ``size`` bytes (8 to 16 of them) from two overlapping loads."""
    words = np.ndarray(shape=(n + size - 8,), dtype="<u8", buffer=data, strides=(1,)).copy()
    return _mix(words[:n] ^ _mix(words[size - 8 : size - 8 + n]))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: bytes, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the closed syncmers; 8 <= s <= 16 and s < k <= 2s are needed.

    A text with no k-mer chosen (always under k + k - s - 1 bytes) has one
    anchor: the whole text at 0. The empty text has none.
    """
    if not 8 <= s <= 16 or not s < k <= 2 * s:
        raise ValueError("needs 8 <= s <= 16 and s < k <= 2s")
    n = len(data) - k + 1
    if n > 0:
        small = _grams(data + _PAD, len(data) - s + 1, s)
        width = k - s + 1
        least = _sliding_min(small, width)
        at = np.flatnonzero((small[:n] == least) | (small[width - 1 : width - 1 + n] == least))
        if at.size:  # k <= 2s, so the first and the last s-mer cover the k-mer
            return at, _mix(small[at] ^ (_mix(small[at + width - 1]) + np.uint64(k)))
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    whole = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")
    return np.zeros(1, np.int64), np.array([whole], np.uint64)


def sketch(data: bytes, k: int = K, s: int = S, size: int = SKETCH) -> np.ndarray:
    """The ``size`` least anchors, rising: the upper 32 bits of each number are a hash, the lower its position (modulo 2**32).

    The r-th occurrence of an anchor counts as an anchor of its own, so a text
    of repeated lines is weighed by its length, not by its few different lines.
    """
    at, hashes = anchors(data, k, s)
    found = np.sort((hashes & _HIGH) | (at.astype(np.uint64) & _LOW))  # equal hashes by position
    if found.size > 1:
        key = found >> np.uint64(32)
        place = np.arange(found.size)
        first = np.concatenate([[True], key[1:] != key[:-1]])
        again = place - np.maximum.accumulate(np.where(first, place, 0))
        if not first.all():
            found = np.where(again > 0, (_mix((key << np.uint64(32)) + again.astype(np.uint64)) & _HIGH) | (found & _LOW), found)
            found = np.sort(found)
            key = found >> np.uint64(32)
            found = found[np.concatenate([[True], key[1:] != key[:-1]])]
    return found[:size]


def shared_anchors(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions in a, positions in b) of the anchors that both sketches have among the ``size`` least of their union, and the union's size."""
    both = np.concatenate([a, b])
    key = both >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[:size]
    twice = first[(first + 1 < key.size)]
    twice = twice[key[twice] == key[np.minimum(twice + 1, key.size - 1)]]
    return (both[order[twice]] & _LOW).astype(np.int64), (both[order[twice + 1]] & _LOW).astype(np.int64), first.size


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> tuple[float, float]:
    """(share of the least hashes of both that both have, share of those that keep one distance): an estimate of the Jaccard index, and of how much stands in one place.

    The distance is the commonest difference of positions. Two empty sketches
    are alike (1, 1); without shared anchors both are 0.
    """
    if not a.size and not b.size:
        return 1.0, 1.0
    at_a, at_b, union = shared_anchors(a, b, size)
    if not at_a.size:
        return 0.0, 0.0
    return at_a.size / union, int(np.unique(at_a - at_b, return_counts=True)[1].max()) / at_a.size


def _hex(x: np.ndarray) -> str:
    return x.astype(">u8").tobytes().hex()


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_place_edited double, in_place_next double"


def edited_text(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as many characters from the start of ``following`` (or all)."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def fingerprint_documents(docs: DataFrame, k: int = K, s: int = S, size: int = SKETCH, per_range: int = PER_RANGE) -> DataFrame:
    """Fingerprints of every text and its edited text, compared with the next document's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, in_place_edited, in_place_next. "Next" is by
    (doc_id, text), null ids first; after the last comes the first. Null texts
    count as empty; a single document is its own next; an empty table gives an
    empty one; further columns are left out.

    Texts move once: documents are dealt into id ranges, and the first document
    of a range goes to the range before it as well. The ranges' ends come from a
    pass over ids only, at most ``MOST_RANGES``; rows that share an id share a
    range, through which a task streams.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    rows = ids.count()
    parts = max(partitions(docs), min(MOST_RANGES, -(-rows // per_range)))
    steps = [i / parts for i in range(1, parts)]
    cuts = sorted(set(ids.approxQuantile("doc_id", steps, 1 / (4 * parts)) if steps and rows else []))
    spark = docs.sparkSession
    # one row for each cut: a table of ranges, bounded by the number of partitions
    bucket = F.lit(0)
    if cuts:
        ends = np.array(cuts, dtype=np.int64)
        bucket = _bucket_of(ends)(F.col("doc_id"))
    heads = ids.select("doc_id", bucket.alias("b")).groupBy("b").agg(F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("nulls")).orderBy("b").collect()
    firsts = [(None if h.nulls else h["head"]) for h in heads]
    held = [h.b for h in heads]
    if not held:
        return spark.createDataFrame([], _RESULT)
    before = {first: held[i - 1] for i, first in enumerate(firsts)}  # -1: the first document follows the last
    pairs = [(x is None, 0 if x is None else int(x), int(b)) for x, b in before.items()]

    @F.pandas_udf("array<struct<bucket:int,extra:boolean>>")
    def places(keys: pd.DataFrame) -> pd.Series:
        known = {(null, x): b for null, x, b in pairs}
        return pd.Series([[(b, False)] + ([(known[x], True)] if (x := (bool(null), 0 if null else int(i))) in known else []) for i, null, b in zip(keys["i"], keys["n"], keys["b"], strict=True)])

    key = F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("n"), F.coalesce(bucket, F.lit(0)).alias("b"))
    placed = base.withColumn("p", F.explode(places(key))).select("doc_id", "text", F.col("p.bucket").alias("bucket"), F.col("p.extra").alias("extra"))
    dealt = placed.repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        np.seterr(over="ignore")
        last = None  # (doc_id, text, sketch) that waits for its next document
        last_bucket, taken = None, False
        out: list[tuple] = []

        def close(doc, following) -> tuple:
            doc_id, text, own = doc
            edited = edited_text(text, following[1]).encode()
            other = sketch(edited, k, s, size)
            near_edited, at_edited = likeness(own, other, size)
            near_next, at_next = likeness(own, following[2], size)
            return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), _hex(own), _hex(other), near_edited, near_next, at_edited, at_next)

        columns = [c.split()[0] for c in _RESULT.split(", ")]
        for frame in batches:
            for doc_id, text, b, extra in zip(frame["doc_id"].astype("Int64"), frame["text"], frame["bucket"], frame["extra"], strict=True):
                if b != last_bucket:
                    last, last_bucket, taken = None, b, False
                if extra and taken:
                    continue
                doc = (None if doc_id is pd.NA else int(doc_id), text, sketch(text.encode(), k, s, size))
                if last is not None:
                    out.append(close(last, doc))
                last, taken = doc, bool(extra)
            if out:
                done, out = pd.DataFrame(out, columns=columns), []
                done["doc_id"] = done["doc_id"].astype("Int64")
                yield done

    return dealt.mapInPandas(tidied(run), _RESULT)


def _bucket_of(ends: np.ndarray):
    """A column function: the number of ``ends`` at or below a value; null: 0."""
    shared = ends.tolist()

    @F.pandas_udf("int")
    def bucket(x: pd.Series) -> pd.Series:
        found = np.searchsorted(np.array(shared, dtype=np.int64), x.fillna(np.iinfo(np.int64).min).astype("int64").to_numpy(), side="right")
        return pd.Series(found.astype(np.int32))

    return bucket
