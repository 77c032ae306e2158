"""Best-fit packing of tokenized documents into fixed-length sequences.

Bulk-synchronous best fit: pieces and the gaps of open sequences are ranged by
size, and every round one distributed sweep over both gives each piece its
successor, the closest gap that holds it. Pieces that want the same gap are
told apart by rank, gaps shrink, and the round repeats. Pieces go in by octaves
of length, longest first, since a short piece fits later whatever was done
before. Rounds are a few for each octave, whatever the corpus holds; the driver
keeps how many pieces and gaps there are of each size and nothing else.
"""

from __future__ import annotations

import math
import os
import string
import struct
import threading
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import checkpoint, running_sum, tidied, trim_memory

CAPACITY, SEPARATOR = 2048, 0
#: Stretches and words whose ids a worker remembers, and the longest string kept.
STRETCHES, WORDS, LONGEST = 500_000, 800_000, 48
#: Seconds without a task after which a worker forgets them all.
IDLE = 5.0
#: Rows, about, that are ranked together.
PER_BUCKET = 200_000


def _byte_characters() -> dict[int, str]:
    """Byte-level spelling: printable bytes stand for themselves, the others for characters from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(0x100 + i) for i, b in enumerate(others)}


_BYTE_CHARACTERS = _byte_characters()


class WordTokenizer:
    """Token ids as little-endian uint32 bytes, one white-space-free stretch at a time.

    The tokenizer drops white space and never joins tokens across it, so a text
    tokenizes as its stretches do. It splits letters from what follows them as
    well: a stretch of letters and closing ASCII punctuation is the word and the
    run of punctuation. Anything else is tokenized as a whole. Ids of stretches
    and words are remembered; a full memory is emptied, which costs time only.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.stretches: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {"": b""}

    def _encode(self, stretches: list[str], store: dict[str, bytes]) -> None:
        for at in range(0, len(stretches), 20_000):
            part = stretches[at : at + 20_000]
            for word, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                store[word] = struct.pack(f"<{len(got.ids)}I", *got.ids)

    def _word(self, word: str) -> bytes:
        """One lower-case word or run of punctuation, straight from the merges: bytes are spelled as the model's characters."""
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, unknown: set[str]) -> dict[str, bytes]:
        """Ids of new stretches; those too long to keep are returned only."""
        if len(self.words) > WORDS:
            self.words = {"": b""}
        words, stretches, fresh, odd = self.words, self.stretches, {}, []
        for w in unknown:
            body = w.rstrip(string.punctuation)
            low = body.lower() if body.isascii() else "".join([c.lower() for c in body])
            if len(w) <= LONGEST and low.isalpha() and body.isalpha() and (body.isascii() or unicodedata.is_normalized("NFC", body)):
                tail = w[len(body) :]
                for part in (low, tail):
                    if part not in words:
                        words[part] = self._word(part)
                stretches[w] = words[low] + words[tail] if tail else words[low]
            else:
                odd.append(w)
        self._encode([w for w in odd if len(w) <= LONGEST], stretches)
        self._encode([w for w in odd if len(w) > LONGEST], fresh)
        return fresh

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if len(self.stretches) > STRETCHES:
            self.stretches = {"": b""}
        split = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        known = self.stretches
        found = [list(map(known.get, words)) for words in split]
        unknown = {w for words, got in zip(split, found, strict=True) if None in got for w, g in zip(words, got, strict=True) if g is None}
        if unknown:
            fresh = self._learn(unknown)
            for words, got in zip(split, found, strict=True):
                if None in got:
                    got[:] = [g if g is not None else known[w] if w in known else fresh[w] for w, g in zip(words, got, strict=True)]
        return list(map(b"".join, found))


_tokenizers: dict[str, WordTokenizer] = {}
_timer: threading.Timer | None = None


def tokenizer_of(path: str) -> WordTokenizer:
    """One per Python worker, with its memory, for all tasks the worker runs until it is idle."""
    if _timer is not None:
        _timer.cancel()
    tokenizer = _tokenizers.get(path)
    if tokenizer is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = _tokenizers[path] = WordTokenizer(path)
    return tokenizer


def _forget() -> None:
    _tokenizers.clear()  # a task that has just begun holds its own reference
    trim_memory()


def release_when_idle() -> None:
    """Workers outlive the stage: drop the tokenizers unless a task asks for one within ``IDLE`` seconds."""
    global _timer
    if _timer is not None:
        _timer.cancel()
    _timer = threading.Timer(IDLE, _forget)
    _timer.daemon = True
    _timer.start()


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, batch_chars: int = 2_000_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and a separator, cut at ``capacity``.

    Null texts count as empty and give one piece of the separator alone.
    """
    end = np.array([separator], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = tokenizer_of(tokenizer_path)
        try:
            for frame in batches:
                ids, texts = frame["doc_id"].astype("Int64"), frame["text"].fillna("").tolist()
                at = 0
                while at < len(texts):
                    upto, chars = at, 0
                    while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= batch_chars):
                        chars += len(texts[upto])
                        upto += 1
                    row, piece, start, length, crc = [], [], [], [], []
                    for k, encoded in enumerate(tokenizer.encode_batch(texts[at:upto])):
                        data = encoded + end
                        for p in range(0, len(data), 4 * capacity):
                            part = data[p : p + 4 * capacity]
                            row.append(at + k)
                            piece.append(p // (4 * capacity))
                            start.append(p // 4)
                            length.append(len(part) // 4)
                            crc.append(zlib.crc32(part))
                    yield pd.DataFrame({"doc_id": ids.iloc[row].to_numpy(), "piece": np.array(piece, np.int32), "start": start, "length": length, "ids_crc32": crc}).astype({"doc_id": "Int64"})
                    at = upto
        finally:
            release_when_idle()

    return docs.select("doc_id", "text").mapInPandas(tidied(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _compact(df: DataFrame, n_rows: int) -> DataFrame:
    """Few partitions for few rows, since a round's tasks are as many as the partitions it reads."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / PER_BUCKET)))


def _per_size(spark: SparkSession, heads: dict[tuple[int, int], int]) -> DataFrame:
    """(size, kind, head), at most two rows for each size up to the capacity, for a broadcast."""
    keys = sorted(heads)
    columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([heads[k] for k in keys], pa.int64())]
    return F.broadcast(spark.createDataFrame(pa.table(columns, ["size", "kind", "head"])))


def _ranked(rows: DataFrame, heads: dict[tuple[int, int], int], n_rows: int) -> DataFrame:
    """Rows (size, kind, id, slot) with their ``rank`` from 0 within size and kind, and the ``head`` of these.

    Ranks come from hash buckets, so a size that holds a third of all rows is spread.
    """
    buckets = math.ceil(n_rows / PER_BUCKET)
    if buckets == 1:
        ranked = rows.withColumn("rank", (F.row_number().over(Window.partitionBy("size", "kind").orderBy("id", "slot")) - 1).cast("long"))
    else:
        dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64("id", "slot"), F.lit(buckets))).withColumn("__one", F.lit(1).cast("long"))
        ranked = running_sum(dealt, ["size", "kind"], "__bucket", [F.col("id"), F.col("slot")], "__one", "rank")
    return ranked.join(_per_size(rows.sparkSession, heads), ["size", "kind"])


def _sweep(pieces: DataFrame, slots: DataFrame, n_pieces: dict[int, int], n_slots: dict[int, int]) -> DataFrame:
    """One round: rows (kind, id, size, sequence, used), a piece's sequence null if it found no gap.

    From the largest size down, a gap (kind 0) opens and the next piece (kind 1)
    closes the gap opened last, which is the closest fit still free: both stand
    at one level of the balance of gaps less pieces, where gaps and pieces take
    turns. A level has at most one gap and one piece of a size, so no level
    holds more than 2 * capacity rows.
    """
    heads, balance = {}, 0
    for size in sorted({*n_pieces, *n_slots}, reverse=True):
        heads[size, 0], heads[size, 1] = balance, balance + n_slots.get(size, 0)
        balance = heads[size, 1] - n_pieces.get(size, 0)
    rows = slots.select("size", F.lit(0).alias("kind"), F.col("sequence").alias("id"), "slot").unionAll(pieces.select("size", F.lit(1).alias("kind"), "id", F.lit(0).alias("slot")))
    at = F.when(F.col("kind") == 0, F.col("head") + F.col("rank") + 1).otherwise(F.col("head") - F.col("rank"))
    level = Window.partitionBy("level").orderBy(F.desc("size"), "kind")
    n_rows = sum(n_pieces.values()) + sum(n_slots.values())
    swept = (
        _ranked(rows, heads, n_rows)
        .withColumn("level", at)
        .withColumn("found", F.lag(F.when(F.col("kind") == 0, F.col("id"))).over(level))
        .withColumn("taker", F.lead(F.when(F.col("kind") == 1, F.col("size"))).over(level))
    )
    swept = swept.select("kind", "id", "size", F.when(F.col("kind") == 1, F.col("found")).alias("sequence"), F.when(F.col("kind") == 0, F.coalesce("taker", F.lit(0))).alias("used"))
    return checkpoint(_compact(swept, n_rows))


def _open(pieces: DataFrame, n_pieces: dict[int, int], capacity: int, first: int) -> tuple[DataFrame, int]:
    """Pieces (id, size) with the new ``sequence`` each starts or joins, and the first number that is free.

    Longest first, a sequence takes capacity // size pieces of one rank after another, which surely fit.
    """
    heads, free, each, ahead = {}, first, 0, 0
    for size in sorted(n_pieces, reverse=True):
        if capacity // size != each:
            free += math.ceil(ahead / each) if each else 0
            each, ahead = capacity // size, 0
        heads[size, 1] = free * each + ahead
        ahead += n_pieces[size]
    rows = pieces.select("size", F.lit(1).alias("kind"), "id", F.lit(0).alias("slot"))
    ranked = _ranked(rows, heads, sum(n_pieces.values()))
    return checkpoint(ranked.select("id", "size", F.floor((F.col("head") + F.col("rank")) / F.floor(F.lit(capacity) / F.col("size"))).alias("sequence"))), free + math.ceil(ahead / each)


def _sizes(pieces: DataFrame, gaps: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """How many pieces and gaps there are of each size, at most ``capacity`` sizes each."""
    counts: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for r in pieces.select("size", F.lit(0).alias("of")).unionAll(gaps.select("size", F.lit(1).alias("of"))).groupBy("size", "of").count().collect():
        counts[r["of"]][r["size"]] = r["count"]
    return counts


def match_pieces(pieces: DataFrame, histogram: dict[int, int], capacity: int = CAPACITY) -> DataFrame:
    """(id, sequence) for rows (id, size), which are read once for each octave of sizes.

    Octaves are taken from the longest down. In a round every piece of the
    octave that is left and every gap take part in one sweep; then gaps shrink,
    and the rounds go on until the pieces are placed or no gap holds one. Those
    open new sequences. In its r-th round an octave may put 2**r pieces into
    one gap, which is offered in slots as wide as the longest of them.
    """
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError("a piece must have 1 to `capacity` tokens")
    pieces = _compact(pieces, sum(histogram.values()))
    gaps, n_gaps, done, first, lengths = None, {}, [], 0, sorted(histogram, reverse=True)
    while lengths:
        longest = lengths[0]
        octave = [n for n in lengths if n > (capacity // 2 if longest > capacity // 2 else longest // 2)]
        lengths = lengths[len(octave) :]
        left, n_left, at_once = pieces.filter(F.col("size").between(octave[-1], longest)), {n: histogram[n] for n in octave}, 1
        while n_left and n_gaps and min(n_left) <= max(n_gaps):
            least = min(n_left)
            fits = gaps.filter(F.col("size") >= least)
            each = F.greatest(F.lit(1), F.least(F.lit(at_once), F.floor(F.col("size") / F.lit(longest)))).cast("int")
            parts = fits.withColumn("__n", each).select("sequence", "size", "__n", F.explode(F.sequence(F.lit(1), "__n")).alias("slot"))
            slots = parts.select("sequence", "slot", F.when(F.col("slot") < F.col("__n"), F.lit(longest)).otherwise(F.col("size") - (F.col("__n") - 1) * F.lit(longest)).cast("long").alias("size"))
            n_slots: Counter[int] = Counter()
            for size, count in n_gaps.items():
                if size >= least:
                    n = max(1, min(at_once, size // longest))
                    n_slots[size - (n - 1) * longest] += count
                    if n > 1:
                        n_slots[longest] += (n - 1) * count
            swept = _sweep(left, slots, n_left, n_slots)
            done.append(swept.filter("kind = 1 AND sequence IS NOT NULL").select("id", "sequence"))
            left = swept.filter("kind = 1 AND sequence IS NULL").select("id", "size")
            shrunk = swept.filter("kind = 0").select(F.col("id").alias("sequence"), (F.col("size") - F.col("used")).alias("size"))
            shrunk = shrunk if at_once == 1 else shrunk.groupBy("sequence").agg(F.sum("size").alias("size"))
            gaps = checkpoint(_compact(gaps.filter(F.col("size") < least).unionAll(shrunk.filter("size > 0")), sum(n_gaps.values())))
            n_left, n_gaps = _sizes(left, gaps)
            at_once *= 2
        if n_left:
            opened, first = _open(left, n_left, capacity, first)
            done.append(opened.select("id", "sequence"))
            fresh = opened.groupBy("sequence").agg((F.lit(capacity) - F.sum("size")).alias("size")).filter("size > 0")
            gaps = checkpoint(_compact(fresh if gaps is None else gaps.unionAll(fresh), sum(n_gaps.values()) + sum(n_left.values())))
            n_gaps = _sizes(left.limit(0), gaps)[1] if lengths else {}
    if not done:
        return pieces.select("id", F.lit(0).cast("long").alias("sequence")).limit(0)
    return reduce(DataFrame.unionAll, done)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with a column length.

    Offsets of a sequence run from 0 without gaps and never exceed the capacity.
    Which of several pieces of one length goes where depends on the partitioning,
    how many sequences there are does not. An empty table stays empty.
    """
    rows = checkpoint(pieces.withColumn("__id", F.monotonically_increasing_id()))
    histogram = {int(r["length"]): int(r["count"]) for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    placed = match_pieces(rows.select(F.col("__id").alias("id"), F.col("length").alias("size")), histogram, capacity)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "__id").rowsBetween(Window.unboundedPreceding, -1)  # at most `capacity` rows
    return (
        rows.join(placed.select(F.col("id").alias("__id"), F.col("sequence").alias("sequence_id")), "__id")
        .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack: one row per piece.

    Null and empty texts give one piece, the separator; repeated rows and null
    doc_ids are packed like others; texts of any length are cut, never dropped;
    an empty table gives an empty one; further columns are left out.
    """
    return pack_pieces(tokenize_pieces(docs, tokenizer_path, capacity), capacity)
