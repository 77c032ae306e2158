"""SimHash near-duplicates by a binary trie self-join.

Fingerprints form a binary trie. Pairs of its nodes are traversed together:
the bits in which their paths differ add up, and a pair is dropped as soon as
they exceed the error budget. The top of the trie is dealt out as pairs of
prefixes, the rest of each pair is traversed level by level inside a task.

deduplicate() finds texts of similarity 0.8 or more with the same join: it takes
512-bit SimHashes of five-word shingles, walks several tries over different bits
of them, keeps a forest of the closest links and confirms those on the texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import checkpoint, components, partitions, tidied

SHINGLE, BUDGET, SEED, BITS = 3, 2, 42, 64
#: A node pair with at most this many fingerprint pairs below it is compared directly.
LEAF = 64
#: Fingerprint pairs compared at once.
AT_ONCE = 1 << 20

#: deduplicate(): words in a shingle, the similarity (as a fraction) from which texts are near copies, 64-bit words of a fingerprint.
WIDTH, SIMILAR, WORDS = 5, (4, 5), 8
#: Differing bits up to which two fingerprints are a candidate: similar texts differ in about 78 of 512, and hardly ever in over 112.
WIDE_BUDGET = 120
#: Share of the pairs of the least similarity that the tries together must meet; more tries are walked for more texts.
RECALL = 0.99
#: Fingerprints that share a prefix, about, so that two prefixes fit a task.
PER_PREFIX = 1 << 20


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text; 0 without words.

    A-Z is lower-cased, words split at space and tab to carriage return, and
    shingles of ``width`` words hashed by XXH64, repeats included; a bit is set
    if more than half of the hashes have it.
    """
    hashes = shingle_hashes(text, width, seed)
    n = len(hashes)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist()))


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``width`` lower-cased words, repeats included; of the whole sequence if it has fewer; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths) + np.arange(len(words))
    n = max(1, len(words) - width + 1)
    starts = (ends - lengths)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[len(words) - n :].tolist(), strict=True)), np.uint64, n)


def add_fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and fp, the SimHash of text as a signed long."""

    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            found = np.array([fingerprint(t) for t in s], dtype=np.uint64)
            yield pd.Series(found.view(np.int64))

    return docs.select(*keep, simhash(F.col("text")).alias("fp"))


def _expand(lo: np.ndarray, hi: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Where each node's range splits: its fingerprints with a 0 at this bit come first."""
    return lo + (zeros[hi] - zeros[lo])


def _products(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with i in [a0, a1) and j in [b0, b1) of each row, at most about ``AT_ONCE`` together."""
    total = (a1 - a0) * (b1 - b0)
    for k in np.flatnonzero(total > AT_ONCE).tolist():
        step = max(1, AT_ONCE // int(b1[k] - b0[k]))
        for lo in range(int(a0[k]), int(a1[k]), step):
            some = np.arange(lo, min(lo + step, int(a1[k])))
            yield np.repeat(some, int(b1[k] - b0[k])), np.tile(np.arange(int(b0[k]), int(b1[k])), len(some))
    fit = np.flatnonzero(total <= AT_ONCE)
    group = np.cumsum(total[fit]) // AT_ONCE
    for part in np.split(fit, np.flatnonzero(np.diff(group)) + 1) if fit.size else []:
        n, nb = total[part], (b1 - b0)[part]
        which = np.repeat(np.arange(len(part)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield a0[part][which] + k // nb[which], b0[part][which] + k % nb[which]


def close_pairs(left: np.ndarray, right: np.ndarray | None, depth: int, budget: int = BUDGET, upto: int = BITS, chunk: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sorted uint64 ``left`` and ``right`` that differ in at most ``budget`` of their first ``upto`` bits.

    ``right`` None joins ``left`` with itself, each pair once. The first
    ``depth`` bits are the same within each side. Node pairs are held in chunks
    and traversed depth first, so memory stays bounded whatever the pairs number.
    """
    own = right is None
    other = left if own else right
    start = bin(int(left[0] ^ other[0]) >> (BITS - depth)).count("1") if depth and len(left) and len(other) else 0
    if not len(left) or not len(other) or start > budget:
        return
    zero_l: dict[int, np.ndarray] = {}
    zero_r: dict[int, np.ndarray] = {}
    rest = np.uint64(BITS - upto)

    def zeros(store: dict, values: np.ndarray, bit: int) -> np.ndarray:
        if bit not in store:
            is_zero = ((values >> np.uint64(BITS - 1 - bit)) & np.uint64(1)) == 0
            store[bit] = np.concatenate([[0], np.cumsum(is_zero)])
        return store[bit]

    one = np.array
    stack = [(depth, one([0]), one([len(left)]), one([0]), one([len(other)]), one([start]))]
    while stack:
        bit, a0, a1, b0, b1, d = stack.pop()
        small = (a1 - a0) * (b1 - b0) <= LEAF if bit < upto else np.ones(len(a0), bool)
        if small.any():
            for i, j in _products(a0[small], a1[small], b0[small], b1[small]):
                ok = np.bitwise_count((left[i] ^ other[j]) >> rest) <= budget
                if own:
                    ok &= i < j
                if ok.any():
                    yield i[ok], j[ok]
            a0, a1, b0, b1, d = a0[~small], a1[~small], b0[~small], b1[~small], d[~small]
        if not len(a0):
            continue
        am, bm = _expand(a0, a1, zeros(zero_l, left, bit)), _expand(b0, b1, zeros(zero_l if own else zero_r, other, bit))
        crossed = (d < budget) & ((a0 != b0) if own else np.ones(len(d), bool))
        lower = d < budget
        children = (
            (a0, am, b0, bm, d, np.ones(len(d), bool)),
            (am, a1, bm, b1, d, np.ones(len(d), bool)),
            (a0, am, bm, b1, d + 1, lower),
            (am, a1, b0, bm, d + 1, crossed),
        )
        parts = [tuple(v[keep] for v in c[:5]) for c in children if (keep := c[5] & (c[1] > c[0]) & (c[3] > c[2])).any()]
        if parts:
            merged = [np.concatenate(v) for v in zip(*parts, strict=True)]
            for at in range(0, len(merged[0]), chunk):
                stack.append((bit + 1, *(v[at : at + chunk] for v in merged)))


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index that each of n nodes reaches over the pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j = i[differ], j[differ]
            lo, hi = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
            np.minimum.at(label, hi, lo)
            while (label != label[label]).any():
                label = label[label]
    return label


def link_fingerprints(fps: DataFrame, rows: int, budget: int = BUDGET, per_prefix: int = 4096) -> DataFrame:
    """Edges (a, b) that connect the distinct ``fp`` values as all links within ``budget`` bits do.

    The prefix length follows the row count; a prefix meets those within
    ``budget`` bits of its own. A task returns a spanning forest of the links it
    finds, so a dense group costs rows in proportion to its size.
    """
    depth = 0
    while depth < 24 and rows >> depth > per_prefix:
        depth += 1
    masks = [sum(1 << i for i in c) for r in range(min(budget, depth) + 1) for c in combinations(range(depth), r)]
    mine = F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")
    met = F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))
    dealt = (
        fps.select("fp", mine.alias("p"), met.alias("m"))
        .withColumn("q", F.col("p").bitwiseXOR(F.col("m")))
        .select("fp", (F.least("p", "q") * F.lit(1 << depth) + F.greatest("p", "q")).alias("node"), (F.col("p") > F.col("q")).alias("second"))
    )
    tasks = max(partitions(fps), 1 << max(0, depth - 4))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def close(node: int, values: list[np.ndarray], seconds: list[np.ndarray]) -> pd.DataFrame | None:
            fp, second = np.concatenate(values), np.concatenate(seconds)
            left, right = np.sort(fp[~second].view(np.uint64)), np.sort(fp[second].view(np.uint64))
            own = depth == 0 or node >> depth == node & ((1 << depth) - 1)
            if own:
                label, nodes = _forest(len(left), close_pairs(left, None, depth, budget)), left
            else:
                shifted = ((i, j + len(left)) for i, j in close_pairs(left, right, depth, budget))
                label, nodes = _forest(len(left) + len(right), shifted), np.concatenate([left, right])
            found = np.flatnonzero(label != np.arange(len(label)))
            return pd.DataFrame({"a": nodes[found].view(np.int64), "b": nodes[label[found]].view(np.int64)}) if found.size else None

        node, values, seconds = None, [], []
        for frame in batches:
            keys = frame["node"].to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if lo == hi:
                    continue
                if node is not None and keys[lo] != node:
                    if (done := close(node, values, seconds)) is not None:
                        yield done
                    values, seconds = [], []
                node = int(keys[lo])
                values.append(frame["fp"].to_numpy()[lo:hi].copy())
                seconds.append(frame["second"].to_numpy()[lo:hi].astype(bool))
        if node is not None and (done := close(node, values, seconds)) is not None:
            yield done

    return dealt.repartition(tasks, "node").sortWithinPartitions("node").mapInPandas(tidied(join), "a long, b long")


def simhash_components(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links, itself included).

    Null and wordless texts have fingerprint zero and link like any other.
    Null doc_ids are never a component's id while it holds another. Repeated
    rows come back as often as given; further columns are left out.
    """
    return labelled_components(add_fingerprints(docs, ["doc_id"]), budget).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def labelled_components(fingerprinted: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Add component_id to rows of (doc_id, fp, ...). Equal fingerprints are collapsed before anything is joined."""
    rows = checkpoint(fingerprinted)
    fps = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = link_fingerprints(fps.select("fp"), fps.count(), budget)
    groups = components(edges)
    rooted = fps.join(groups, fps.fp == groups.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select(F.col("fp").alias("__fp"), "component_id")
    return rows.join(named, rows.fp == named["__fp"]).drop("__fp")


# ---- near copies of similarity 0.8 or more ------------------------------------


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles, rising."""
    return np.unique(shingle_hashes(text, width, 0))


def set_hash(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64)) if found.size else 0


def similar(shared: int, a: int, b: int) -> bool:
    """Whether sets of a and b members with ``shared`` in common reach ``SIMILAR``, in whole numbers."""
    p, q = SIMILAR
    return shared * (p + q) >= p * (a + b)


def wide_fingerprint(found: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The SimHash of a set of hashes in ``words`` words; each hash is stretched to as many bits by mixing it with odd constants."""
    counts = np.zeros(64 * words, np.int64)
    salts = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 2048):
            x = (found[at : at + 2048, None] ^ salts) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(found), bitorder="little").view(np.uint64)


def tries_for(rows: int) -> tuple[int, int, int]:
    """(bits, errors, tries): a trie's first ``bits`` tell ``rows`` texts apart, ``errors`` of them may differ.

    A bit differs with the angle between the sets over pi: 0.152 at the least
    similarity. So many tries, each over other bits, meet ``RECALL`` of such pairs.
    """
    p, q = SIMILAR
    differ = math.acos(2 * p / (p + q)) / math.pi
    bits = min(32, max(16, math.ceil(math.log2(max(2, rows)))))
    errors = max(2, round(0.17 * bits))
    met = sum(math.comb(bits, e) * differ**e * (1 - differ) ** (bits - e) for e in range(errors + 1))
    return bits, errors, min(2 * WORDS, math.ceil(math.log(1 - RECALL) / math.log(1 - met)))


def trie_key(words: np.ndarray, trie: int) -> np.ndarray:
    """The 64 bits that a trie orders fingerprints by: one half of a word first, then the other."""
    word = words[:, trie // 2]
    return word if trie % 2 == 0 else (word << np.uint64(32)) | (word >> np.uint64(32))


def closest_forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], held: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A least spanning forest of links (i, j, distance) over n nodes; links are thinned as they come, so memory stays bounded."""

    def thin(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((j, i, d))
        i, j, d = i[order], j[order], d[order]
        label, chosen = np.arange(n), np.zeros(len(i), bool)
        while True:  # every tree takes its closest link, until no link joins two trees
            at = np.flatnonzero(label[i] != label[j])
            if not at.size:
                return i[chosen], j[chosen], d[chosen]
            best = np.full(n, len(i))
            np.minimum.at(best, label[i[at]], at)
            np.minimum.at(best, label[j[at]], at)
            take = np.unique(best[best < len(i)])
            chosen[take] = True
            label = _forest(n, iter([(label[i[take]], label[j[take]])]))[label]

    parts, count = [], 0
    for link in links:
        parts.append(link)
        count += len(link[0])
        if count > held:
            parts = [thin(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
            count = len(parts[0][0])
            held = max(held, 2 * count)
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return thin(*(np.concatenate(x) for x in zip(*parts, strict=True)))[:2]


def candidate_links(classes: DataFrame, rows: int, budget: int = WIDE_BUDGET) -> DataFrame:
    """Distinct edges (a, b) between the ``fp`` of ``classes`` (fp, bits): the closest links that the tries find within ``budget`` bits.

    Each trie is dealt out as pairs of prefixes that differ in no more than the
    allowed errors; a task joins one pair of them and returns a forest, never all pairs.
    """
    bits, errors, tries = tries_for(rows)
    depth = 2
    while depth < 16 and rows >> depth > PER_PREFIX:
        depth += 1
    masks = np.array([sum(1 << i for i in c) for r in range(min(errors, depth) + 1) for c in combinations(range(depth), r)], np.int64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if not len(frame):
                continue
            words = np.frombuffer(b"".join(frame["bits"]), np.uint64).reshape(len(frame), -1)
            for t in range(tries):
                p = (trie_key(words, t) >> np.uint64(BITS - depth)).astype(np.int64)
                for m in masks.tolist():
                    q = p ^ m
                    node = (t << 2 * depth) | (np.minimum(p, q) << depth) | np.maximum(p, q)
                    yield pd.DataFrame({"node": node, "second": p > q, "fp": frame["fp"], "bits": frame["bits"]})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def close(node: int, parts: list[tuple]) -> pd.DataFrame:
            fp, second = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
            words = np.frombuffer(b"".join([x[2] for x in parts]), np.uint64).reshape(len(fp), -1)
            key = trie_key(words, node >> 2 * depth)
            order = np.lexsort((fp, key, second))
            fp, key, words, n = fp[order], key[order], words[order], int(np.count_nonzero(~second))
            own = (node >> depth) & ((1 << depth) - 1) == node & ((1 << depth) - 1)
            shift = 0 if own else n

            def links() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                for i, j in close_pairs(key[:n], None if own else key[n:], depth, errors, bits):
                    d = np.bitwise_count(words[i] ^ words[j + shift]).sum(axis=1, dtype=np.int32)
                    ok = d <= budget
                    if ok.any():
                        yield i[ok], j[ok] + shift, d[ok]

            i, j = closest_forest(len(fp), links())
            return pd.DataFrame({"a": np.minimum(fp[i], fp[j]), "b": np.maximum(fp[i], fp[j])})

        node, parts = None, []
        for frame in batches:
            keys = frame["node"].to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if lo == hi:
                    continue
                if node is not None and keys[lo] != node:
                    yield close(node, parts)
                    parts = []
                node = int(keys[lo])
                parts.append((frame["fp"].to_numpy()[lo:hi].copy(), frame["second"].to_numpy()[lo:hi].astype(bool), b"".join(frame["bits"].iloc[lo:hi])))
        if node is not None:
            yield close(node, parts)

    dealt = classes.select("fp", "bits").mapInPandas(tidied(deal), "node long, second boolean, fp long, bits binary")
    tasks = max(partitions(classes), min(4096, tries << 2 * depth))
    return dealt.repartition(tasks, "node").sortWithinPartitions("node").mapInPandas(tidied(join), "a long, b long").distinct()


def add_sets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, fp (a hash of the text's set of shingles; 0 without words) and bits (its wide fingerprint; null without words)."""

    @F.pandas_udf("fp long, bits binary")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            found = [shingles(t) for t in s]
            yield pd.DataFrame({"fp": np.array([set_hash(x) for x in found], np.int64), "bits": [wide_fingerprint(x).tobytes() if x.size else None for x in found]})

    return docs.select(*keep, sets(F.col("text")).alias("__x")).select(*keep, "__x.*")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose texts (fp, text) have similar sets of shingles."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, None)
        for frame in batches:
            ok = []
            for b, x, y in zip(frame["b"], frame["x"], frame["y"], strict=True):
                if last[0] != b:
                    last = (b, shingles(y))
                one, two = shingles(x), last[1]
                ok.append(similar(np.intersect1d(one, two, assume_unique=True).size, one.size, two.size))
            yield frame.loc[np.array(ok, bool), ["a", "b"]]

    left, right = texts.select(F.col("fp").alias("a"), F.col("text").alias("x")), texts.select(F.col("fp").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(tidied(compare), "a long, b long")


def deduplicate(docs: DataFrame, budget: int = WIDE_BUDGET) -> DataFrame:
    """The columns of ``docs``; of texts linked by a five-word Jaccard similarity of 0.8 or more the row with the least doc_id stays.

    Texts with one set of shingles are one class; so are all null and wordless
    ones. The trie join offers each class its closest others and no link counts
    before it is confirmed on the texts, so nothing less similar is dropped. A
    pair at the threshold is met with a chance of ``RECALL``, a closer one more
    surely; between two groups only the closest links are tried. Repeated rows
    go but for one, null doc_ids go last, further columns pass through.
    """
    rows = checkpoint(add_sets(docs.select("doc_id", "text"), ["doc_id"]))
    classes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("bits").alias("bits")))
    able = classes.filter("bits is not null").select("fp", "bits")
    pairs = checkpoint(candidate_links(able, able.count(), budget))
    used = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    named = classes.join(used, "fp", "left_semi").select(F.col("fp").alias("__fp"), "least")
    owners = docs.select("doc_id", "text").join(named, docs.doc_id.eqNullSafe(named.least)).select("text", "__fp")
    texts = owners.mapInPandas(tidied(_own_texts), "fp long, text string").dropDuplicates(["fp"])
    groups = components(confirm(pairs, texts))
    rooted = checkpoint(classes.join(groups, classes.fp == groups.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids_of = rooted.join(ids, "root").select(F.col("fp").alias("__fp"), "component_id")
    marked = rows.select("doc_id", "fp").join(ids_of, F.col("fp") == F.col("__fp")).drop("__fp")
    return keep_least(docs, checkpoint(marked), lambda: with_set_hash(docs))


def _own_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """fp and text of the rows whose text has the set that is asked for: rows may share a doc_id."""
    for frame in batches:
        ok = [set_hash(shingles(t)) == fp for t, fp in zip(frame["text"], frame["__fp"], strict=True)]
        yield pd.DataFrame({"fp": frame["__fp"], "text": frame["text"]})[ok]


def _set_hash_of():
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([set_hash(shingles(t)) for t in texts], dtype="int64")

    return hashed


def with_set_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__set", _set_hash_of()("text"))


def keep_least(docs: DataFrame, marked: DataFrame, again: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that are the least of their component in ``marked`` (doc_id, fp, component_id); ``again`` gives ``docs`` with __set, the fp."""
    dropped = marked.filter("doc_id <> component_id or (doc_id is null and component_id is not null)").select(F.col("doc_id").alias("__id")).distinct()
    if marked.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.join(dropped, docs.doc_id.eqNullSafe(dropped["__id"]), "left_anti")
    # doc_ids repeat, so a row is known by its id and fingerprint
    keys = marked.filter("doc_id <=> component_id").select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), F.col("component_id").alias("__c")).distinct()
    rows = again()
    met = rows.join(keys, rows.doc_id.eqNullSafe(keys["__id"]) & (rows["__set"] == keys["__fp"]))
    order = [F.col(c) for c in ["doc_id", *[c for c in docs.columns if c != "doc_id"]]]
    return met.groupBy("__c").agg(F.min(F.struct(*order)).alias("__x")).select(*[F.col(f"__x.{c}").alias(c) for c in docs.columns])
