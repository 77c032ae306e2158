"""Removal of repeated byte strings by suffix arrays built with induced sorting.

A string of ``WINDOW`` bytes that starts in two places is dealt to one shard by
its minimizer, the least hash among its k-mers: equal strings have equal
minimizers. Neighbouring strings with one minimizer travel as one stretch of
text, equal stretches as one with their number. Each shard concatenates its
stretches, sorts all suffixes by induced sorting (Nong, Zhang, Chan 2009), and
compares each suffix with its predecessor in that order (permuted common
prefixes). Strings that a neighbour shares for a whole window are removed from
every document they came from. Minimizers that occur once are dropped by count
before any text moves. A minimizer whose different stretches would not fit one
suffix array is divided to the end: each of its strings is a shard of its own,
known by its digest, and is repeated if that shard holds more than one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import checkpoint, tidied

WINDOW, KMER = 200, 32
#: Different stretches of a minimizer (of 200 to 368 bytes each) beyond which its strings are dealt out one by one.
HOT = 20_000
#: A minimizer with more than this share of all occurrences, and this many, is spread over ``SALTS`` keys when occurrences meet their counts.
HEAVY, HEAVY_ROWS, SALTS = 1 / 1000, 4096, 64
#: Bytes of text for one suffix array (small enough for the processor's cache); a minimizer's stretches are never divided.
SHARD_BYTES = 300_000
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


# ---- induced sorting -------------------------------------------------------


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S type); the last, a sentinel, is S."""
    n = len(text)
    small = np.ones(n, bool)
    step = np.sign(text[1:].astype(np.int64) - text[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    ends = following < n
    small[:-1][ends] = step[following[ends]] > 0
    small[:-1][~ends] = False
    return small


def _scatter(sa: np.ndarray, place: np.ndarray, target: np.ndarray, values: np.ndarray, down: bool) -> None:
    """Append values to their buckets in order: ``place`` holds each bucket's next free slot."""
    order = np.argsort(target if len(place) > 65_536 else target.astype(np.uint16), kind="stable")
    t = target[order]
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    count = np.diff(np.append(first, len(t)))
    rank = np.arange(len(t)) - np.repeat(first, count)
    if down:
        sa[place[t] - rank] = values[order]
        place[t[first]] -= count
    else:
        sa[place[t] + rank] = values[order]
        place[t[first]] += count


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes in order, given ``lms`` (leftmost-smaller suffixes) sorted within their buckets.

    Buckets are scanned in runs: as long as nothing that is induced falls into
    the run, a whole run of buckets is one array operation.
    """
    n, sigma = len(text), len(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(n, -1, np.int32)
    tail = ends - 1
    _scatter(sa, tail, text[lms[::-1]], lms[::-1], True)

    head, c, run = starts.copy(), 0, 64
    while c < sigma:
        hi = min(sigma, c + run)
        seg = sa[starts[c] : ends[hi - 1]]
        prev = seg[seg > 0] - 1
        prev = prev[~small[prev]]
        target = text[prev]
        if not prev.size or (least := int(target.min())) >= hi:
            if prev.size:
                _scatter(sa, head, target, prev, False)
            c, run = hi, min(2 * run, sigma)
        elif least > c:
            run = least - c
        else:  # the bucket feeds itself: wave by wave, then its leftmost-smaller suffixes
            low, limit = starts[c], tail[c] + 1
            while low < head[c]:
                wave, low = sa[low : head[c]], head[c]
                prev = wave[wave > 0] - 1
                prev = prev[~small[prev]]
                if prev.size:
                    _scatter(sa, head, text[prev], prev, False)
            rest = sa[limit : ends[c]]
            prev = rest[rest > 0] - 1
            prev = prev[~small[prev]]
            if prev.size:
                _scatter(sa, head, text[prev], prev, False)
            c, run = c + 1, max(2, run // 2)

    # forget the leftmost-smaller suffixes (all but the sentinel), then induce the S type from the right
    keep = sa >= 0
    keep[keep] = ~small[sa[keep]]
    sentinel = n - 1
    sa[~keep] = -1
    tail = ends - 1
    sa[starts[text[sentinel]]] = sentinel
    c, run = sigma - 1, 64
    while c >= 0:
        lo = max(0, c - run + 1)
        seg = sa[starts[lo] : ends[c]][::-1]
        prev = seg[seg > 0] - 1
        prev = prev[small[prev]]
        target = text[prev]
        if not prev.size or (most := int(target.max())) < lo:
            if prev.size:
                _scatter(sa, tail, target, prev, True)
            c, run = lo - 1, min(2 * run, sigma)
        elif most < c:
            run = c - most
        else:
            high = ends[c] - 1
            while high > tail[c]:
                wave, high = sa[tail[c] + 1 : high + 1][::-1], tail[c]
                prev = wave[wave > 0] - 1
                prev = prev[small[prev]]
                if prev.size:
                    _scatter(sa, tail, text[prev], prev, True)
            rest = sa[starts[c] : head[c]][::-1]
            prev = rest[rest > 0] - 1
            prev = prev[small[prev]]
            if prev.size:
                _scatter(sa, tail, text[prev], prev, True)
            c, run = c - 1, max(2, run // 2)
    return sa


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings in text order, equal ones alike, and their number."""
    following = np.append(lms[1:], len(text) - 1)
    length = np.zeros(len(text), np.int32)
    length[lms] = following - lms + 1
    a, b = ordered[:-1], ordered[1:]
    alive = np.flatnonzero(length[a] == length[b])
    same = np.zeros(len(a), bool)
    offset = 0
    while alive.size:
        over = length[a[alive]] == offset
        same[alive[over]] = True
        alive = alive[~over]
        alive = alive[text[a[alive] + offset] == text[b[alive] + offset]]
        offset += 1
    rank = np.concatenate([[0], np.cumsum(~same)])
    name = np.zeros(len(text), np.int32)
    name[ordered] = rank
    return name[lms], int(rank[-1]) + 1


def _by_doubling(name: np.ndarray) -> np.ndarray:
    """Suffix order of a short reduced text: ranks are paired with those 1, 2, 4, ... on, where they still tie."""
    n = len(name)
    order = np.argsort(name, kind="stable")
    ranked = name[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    tied = np.flatnonzero(~first | np.append(~first[1:], False))  # places in `order` that are not settled
    step = 1
    while tied.size:
        who = order[tied]
        ahead = who + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        sub = np.lexsort((second, rank[who]))
        who, head, second = who[sub], rank[who][sub], second[sub]
        order[tied] = who
        new = np.concatenate([[True], (head[1:] != head[:-1]) | (second[1:] != second[:-1])])
        rank[who] = tied[np.maximum.accumulate(np.where(new, np.arange(len(who)), 0))]
        tied = tied[~new | np.append(~new[1:], False)]
        step *= 2
    return order


def suffix_array(text: np.ndarray, base: int = 1 << 17) -> np.ndarray:
    """The suffix array of int symbols; the last symbol must be the least and occur once.

    Reduced texts recurse; one that is short or has few repeated names left
    (where buckets hold single suffixes) is ordered by doubling.
    """
    text = np.ascontiguousarray(text, np.int32)
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    sizes = np.bincount(text)
    small = _types(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    found = _induce(text, small, lms, sizes)
    first = np.zeros(n, bool)
    first[lms] = True
    ordered = found[first[found]]
    name, count = _names(text, lms, ordered)
    if count < len(lms):
        ordered = lms[_by_doubling(name) if len(name) <= base or 3 * count > len(name) else suffix_array(name, base)]
    return _induce(text, small, ordered, sizes)


def repeated_starts(stretches: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each stretch, which of its ``window``-byte strings start anywhere else in the stretches."""
    lengths = np.array([len(x) for x in stretches])
    joined = b"\x00".join(stretches) + b"\x00"
    text = np.zeros(len(joined) + 1, np.int32)
    text[:-1] = np.frombuffer(joined, np.uint8)
    text[:-1] += 2
    begins = np.cumsum(lengths + 1) - lengths - 1
    text[begins + lengths] = 1
    sa = suffix_array(text)
    valid = np.zeros(len(text), bool)
    for b, n in zip(begins.tolist(), lengths.tolist(), strict=True):
        valid[b : b + n - window + 1] = True
    order = sa[valid[sa]]  # strings that share a window are neighbours among the valid ones
    shared = shared_windows(joined, order, window, len(text))
    return [shared[b : b + n - window + 1] for b, n in zip(begins.tolist(), lengths.tolist(), strict=True)]


def shared_windows(joined: bytes, order: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which positions share ``window`` bytes with a neighbour in ``order``."""
    data = joined + bytes(window + 16)
    words = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    prefix = np.zeros(n, np.int32)  # permuted: by text position, with the predecessor in suffix order
    here, before = order[1:].astype(np.int64), order[:-1].astype(np.int64)
    for step in [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]:
        same = words[here + step] == words[before + step]
        here, before = here[same], before[same]
        prefix[here] = min(step + 8, window)
    full = prefix >= window
    full[before] = True
    return full


# ---- minimizers ------------------------------------------------------------


def _kmer_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each 32-byte string of ``data``."""
    n = len(data) - KMER + 1
    x = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,)).copy()
    h = x[:n] * _C[0]
    for i in (1, 2, 3):
        h ^= h >> np.uint64(31)
        h += x[8 * i : 8 * i + n]
        h *= _C[i]
    h ^= h >> np.uint64(29)
    h *= _C[0]
    h ^= h >> np.uint64(32)
    return h


def minimizer_runs(data: bytes, window: int = WINDOW, part: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, number of starts) of each run of window starts with one minimizer, leftmost on ties."""
    np.seterr(over="ignore")
    width = window - KMER + 1
    total = len(data) - window + 1
    out: list[tuple] = []
    for at in range(0, max(0, total), part):
        h = _kmer_hashes(data[at : min(len(data), at + part + window - 1)])
        key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if width > span:
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        where = (key[first] & np.uint64(0xFFFFFF)).astype(np.int64)
        out.append((h[where], first + at, np.diff(np.append(first, len(key)))))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keys() -> tuple:
    """id (doc_id, null as the least long) and th (a hash of the text): together they name a row up to copies of its text."""
    return F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")


def _keyed(docs: DataFrame) -> DataFrame:
    """id, th, doc_id and text (null: empty)."""
    return docs.select(*_keys(), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _occurrences(keyed: DataFrame, window: int) -> DataFrame:
    """Every run of every document: m (minimizer), s (hash of the stretch), its document, first start, number of starts."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh64_intdigest
        for frame in batches:
            ids = frame["id"].to_numpy()
            row, ms, ss, starts, counts = [], [], [], [], []
            held = 0

            def flush() -> pd.DataFrame:
                at = np.repeat([r for r, _ in row], [n for _, n in row])
                return pd.DataFrame({
                    "id": ids[at], "th": frame["th"].to_numpy()[at], "m": np.concatenate(ms).view(np.int64), "s": np.array(ss, np.uint64).view(np.int64),
                    "start": np.concatenate(starts).astype(np.int32), "n": np.concatenate(counts).astype(np.int32),
                })

            for k, text in enumerate(frame["text"]):
                data = text.encode()
                if len(data) < window:
                    continue
                m, start, count = minimizer_runs(data, window)
                ss.extend([digest(data[a:b]) for a, b in zip(start.tolist(), (start + count + (window - 1)).tolist(), strict=True)])
                row.append((k, len(m)))
                ms.append(m)
                starts.append(start)
                counts.append(count)
                held += len(m)
                if held > 200_000:
                    yield flush()
                    row, ms, ss, starts, counts = [], [], [], [], []
                    held = 0
            if row:
                yield flush()

    return keyed.select("id", "th", "text").mapInPandas(tidied(scan), "id long, th long, m long, s long, start int, n int")


def _stretches(with_text: DataFrame, window: int) -> DataFrame:
    """The bytes of each wanted stretch, cut from its document."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for text, wanted in zip(frame["text"], frame["wanted"], strict=True):
                data = text.encode()
                rows += [(w["m"], w["s"], w["copies"], data[w["start"] : w["start"] + w["n"] + window - 1]) for w in wanted]
            if rows:
                yield pd.DataFrame(rows, columns=["m", "s", "copies", "bytes"])

    return with_text.mapInPandas(tidied(cut), "m long, s long, copies long, bytes binary")


def _windows(with_text: DataFrame, window: int) -> DataFrame:
    """Every window of each wanted stretch by its 128-bit digest d, to be counted.

    A stretch may come twice from a repeated row; its copies are above one then, and it is repeated anyway.
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, columns = xxhash.xxh3_128_digest, ["m", "s", "from", "copies", "d"]
        rows: list[tuple] = []
        for frame in batches:
            for text, wanted in zip(frame["text"], frame["wanted"], strict=True):
                data = text.encode()
                for w in wanted:
                    m, s, start, copies = w["m"], w["s"], w["start"], w["copies"]
                    rows += [(m, s, i, copies, digest(data[start + i : start + i + window])) for i in range(w["n"])]
                    if len(rows) > 50_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return with_text.mapInPandas(tidied(digests), "m long, s long, from int, copies long, d binary")


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _judge(stretches: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """(m, s, spans): per stretch the [from, to) starts whose window is repeated. A shard holds whole minimizers and gets a suffix array."""

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size, last = 0, None
        columns = ["m", "s", "spans"]

        def close() -> list[tuple]:
            rows = []
            for (m, s, copies, _), flags in zip(held, repeated_starts([x[3] for x in held], window), strict=True):
                spans = [(0, len(flags))] if copies > 1 else _spans(flags)
                if spans:
                    rows.append((m, s, [{"from": a, "to": b} for a, b in spans]))
            return rows

        out: list[tuple] = []
        for frame in batches:
            for m, s, copies, data in zip(frame["m"], frame["s"], frame["copies"], frame["bytes"], strict=True):
                if last == (m, s):
                    continue  # one stretch, fetched from a repeated row as well
                data = bytes(data)
                if size >= shard_bytes and held[-1][0] != m:
                    out += close()
                    held, size = [], 0
                held.append((m, s, copies, data))
                size += len(data)
                last = (m, s)
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if held:
            out += close()
        if out:
            yield pd.DataFrame(out, columns=columns)

    return stretches.repartition("m").sortWithinPartitions("m", "s").mapInPandas(tidied(shard), "m long, s long, spans array<struct<from:int,to:int>>")


def _counted(windows: DataFrame) -> DataFrame:
    """(m, s, spans): as _judge(), for windows whose digest counts more than once."""
    often = windows.groupBy("d").agg(F.sum("copies").alias("c")).filter("c > 1").select(F.col("d").alias("again"))
    starts = windows.join(often, windows.d == often.again).groupBy("m", "s").agg(F.collect_set("from").alias("at"))  # at most 200 each

    @F.pandas_udf("array<struct<from:int,to:int>>")
    def spans(starts: pd.Series) -> pd.Series:
        out = []
        for at in starts:
            flags = np.zeros(int(max(at)) + 1, bool)
            flags[np.asarray(at)] = True
            out.append([{"from": a, "to": b} for a, b in _spans(flags)])
        return pd.Series(out)

    return starts.select("m", "s", spans("at").alias("spans"))


def _repeated_runs(keyed: DataFrame, window: int) -> DataFrame:
    """The occurrences of minimizers that occur more than once.

    Counts meet the occurrences on the minimizer; those that hold a large share
    of all rows (at most 1 / ``HEAVY`` of them) are spread over ``SALTS`` keys.
    """
    runs = _occurrences(keyed, window)
    counts = checkpoint(runs.groupBy("m").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    least = max(HEAVY_ROWS, int((counts.agg(F.sum("c")).first()[0] or 0) * HEAVY))
    heavy = [r.m for r in counts.filter(F.col("c") > least).select("m").collect()]  # at most 1 / HEAVY of them
    salt = F.when(F.col("m").isin(heavy), F.pmod(F.xxhash64("id", "start"), F.lit(SALTS))).otherwise(0) if heavy else F.lit(0).cast("long")
    salts = F.when(F.col("m").isin(heavy), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if heavy else F.array(F.lit(0))
    often = counts.select(F.col("m").alias("again"), F.explode(salts.cast("array<long>")).alias("at"))
    salted = runs.withColumn("salt", salt)
    return checkpoint(salted.join(often, (salted.m == often.again) & (salted.salt == often["at"])).drop("again", "at", "salt"))


def repeated_intervals(docs: DataFrame, window: int = WINDOW, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents by row key with text, and per row key __id, __th the [from, to) byte __ranges covered by repeated strings).

    Each stretch is judged once, whatever the number of its copies, and gives one
    row of spans; rows equal in doc_id and text share one row of ranges.
    """
    keyed = _keyed(docs)
    found = _repeated_runs(keyed, window)
    one = F.min(F.struct("id", "th", "start", "n")).alias("x")
    stretches = found.groupBy("m", "s").agg(F.count(F.lit(1)).alias("copies"), one)
    too_many = checkpoint(stretches.groupBy("m").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") > hot).select(F.col("m").alias("hot_m")))
    any_hot = not too_many.isEmpty()
    flagged = stretches.join(too_many, stretches.m == too_many.hot_m, "left") if any_hot else stretches.withColumn("hot_m", F.lit(None).cast("long"))
    wanted = (
        flagged.select("m", "s", "copies", F.col("hot_m").isNotNull().alias("hot"), F.col("x.start").alias("start"), F.col("x.n").alias("n"), F.col("x.id").alias("w_id"), F.col("x.th").alias("w_th"))
        .groupBy("w_id", "w_th")
        .agg(F.collect_list(F.struct("m", "s", "copies", "hot", "start", "n")).alias("wanted"))
    )
    # all joins to the texts use one exchange: the same columns, dealt by the same keys, within one job
    texts = keyed.join(wanted, (keyed.id == wanted.w_id) & (keyed.th == wanted.w_th)).select("doc_id", "text", "wanted")

    def some(is_hot: bool) -> DataFrame:
        return texts.withColumn("wanted", F.filter("wanted", lambda w: w["hot"] == F.lit(is_hot))).filter("size(wanted) > 0")

    hits = _judge(_stretches(some(False), window), window, shard_bytes)
    if any_hot:
        hits = hits.unionAll(_counted(_windows(some(True), window)))
    hits = hits.select(F.col("m").alias("h_m"), F.col("s").alias("h_s"), "spans")
    ranges = F.transform("spans", lambda x: F.struct((F.col("start") + x["from"]).cast("long").alias("a"), (F.col("start") + x["to"] + (window - 1)).cast("long").alias("b")))
    covered = (
        found.join(hits, (found.m == hits.h_m) & (found.s == hits.h_s))
        .select(F.col("id").alias("__id"), F.col("th").alias("__th"), ranges.alias("r"))
        .groupBy("__id", "__th")
        .agg(F.flatten(F.collect_set("r")).alias("__ranges"))
    )
    return keyed, covered


def merge_ranges(ranges) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; ranges that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted((int(r["a"]), int(r["b"])) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def whole_characters(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The part of [a, b) that holds whole UTF-8 characters; a character cut through stays."""
    while a < len(data) and data[a] & 0xC0 == 0x80:
        a += 1
    while b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, max(a, b)


def remove_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """Per document: what stays when every byte of a repeated ``window``-byte string is removed.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the
    remaining bytes) and spans (the removed [a, b) byte ranges). Strings are judged on the input, and
    never reach across documents. Null texts count as empty; texts shorter than
    the window are never touched; repeated rows are each other's repeats; an
    empty table gives an empty one; further columns are left out.
    """
    keyed, covered = repeated_intervals(docs, window, **options)
    joined = keyed.join(covered, (keyed.id == covered["__id"]) & (keyed.th == covered["__th"]), "left").select("doc_id", "text", F.col("__ranges").alias("ranges"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for text, ranges in zip(frame["text"], frame["ranges"], strict=True):
                data = text.encode()
                spans = merge_ranges(ranges) if ranges is not None else []
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                rest = b"".join(kept)
                rows.append((len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest, [{"a": a, "b": b} for a, b in spans]))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64"})

    return joined.mapInPandas(tidied(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<a:long,b:long>>")


def without_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """The columns of ``docs`` with repeated strings cut from text (and n_chars set anew where it was cut).

    Every row stays, texts that consisted of repeats alone become empty. Null
    texts come back as they were. Rows meet their cut text by doc_id and a hash
    of the text; other columns never take part.
    """
    _, covered = repeated_intervals(docs, window, **options)
    row_id, th = _keys()
    rows = docs.select(*docs.columns, row_id.alias("__row"), th.alias("__text"))
    joined = rows.join(covered, (rows["__row"] == covered["__id"]) & (rows["__text"] == covered["__th"]), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, ranges, strict=True):
            if text is not None and found is not None:
                data, at, parts = text.encode(), 0, []
                for a, b in merge_ranges(found):
                    a, b = whole_characters(data, a, b)
                    parts.append(data[at:a])
                    at = max(a, b)
                text = b"".join([*parts, data[at:]]).decode()
            out.append(text)
        return pd.Series(out, dtype=object)

    new = joined.withColumn("__cut", cut("text", "__ranges")).withColumn("text", F.col("__cut"))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("__ranges").isNull(), F.col("n_chars")).otherwise(F.length("__cut").cast(docs.schema["n_chars"].dataType)))
    return new.select(*docs.columns)
