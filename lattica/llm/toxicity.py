"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled documents is indexed: terms are character strings
of words that tell the labels apart, weights are TF-IDF with document
frequencies over all documents. A block-max inverted index keeps posting lists
in blocks of examples and, for each term and block that holds it, the largest
weight; a query opens blocks by falling upper bound and stops when no bound can
beat its k-th neighbour, so the neighbours are exact. Distance-weighted votes
are calibrated on the examples themselves, each judged by its neighbours but itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import checkpoint, tidied

#: Most examples of each label; terms, votes and calibration come from these alone.
EXAMPLES = 3000
#: Lengths of character strings (a word's start counts as one); whole words are taken too.
GRAMS = (3, 4, 5, 6, 7, 8)
NEIGHBOURS, BLOCK = 10, 64
#: Blocks opened first.
FIRST = 4
THRESHOLD = 0.7
_OTHER = re.compile(r"[\W_]+")


def normalized(text: str | None) -> str:
    """Lower case, words (runs of letters and digits) parted by one space, a space at either end."""
    low = (text or "").lower()
    odd = [c for c in set(low) if c != " " and not c.isalnum()]
    if len(odd) > 64:
        low = _OTHER.sub(" ", low)
    else:
        for c in odd:
            low = low.replace(c, " ")
    return f" {' '.join(low.split())} "


def grams(text: str | None) -> set[str]:
    """The distinct character strings that terms are chosen from: pieces of words, a leading space marking a word's start."""
    out: set[str] = set()
    for word in set(normalized(text).split()):
        marked = " " + word
        for n in GRAMS:
            out.update(marked[i : i + n] for i in range(len(marked) - n + 1))
        out.add(f" {word} ")
    return out


@dataclass
class Index:
    """Terms, their idf, the examples and the block-max lists; plain arrays, small enough to ship with a task.

    Block b holds the places from b * ``BLOCK`` on. Term t has the entries from
    entry_at[t] to entry_at[t + 1], one for each block that holds it: the
    block, its largest weight there, and the postings from posting_at[e] to
    posting_at[e + 1].
    """

    terms: list[str]
    idf: np.ndarray
    entry_at: np.ndarray
    entry_block: np.ndarray
    entry_most: np.ndarray
    posting_at: np.ndarray
    places: np.ndarray
    posting_weights: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    ids: np.ndarray
    none_toxic: float  # weight of toxic ones among examples without any term, of all of these, and the share of toxic ones overall
    none_all: float
    prior: float
    steps: tuple[np.ndarray, np.ndarray]  # calibration: raw votes, scores

    @property
    def blocks(self) -> int:
        return -(-len(self.labels) // BLOCK)

    def none_rate(self, toxic: float = 0.0, weight: float = 0.0) -> float:
        """The share of toxic ones among termless examples, less one of ``weight``, drawn to the overall share by one example."""
        return (self.none_toxic - toxic * weight + self.prior) / (self.none_all - weight + 1)


def build_lists(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK) -> dict[str, np.ndarray]:
    """The posting lists of Index for examples given as (terms, weights), in their places."""
    place = np.repeat(np.arange(len(vectors)), [len(at) for at, _ in vectors]).astype(np.int64)
    term = np.concatenate([np.asarray(at, np.int64) for at, _ in vectors] or [np.empty(0, np.int64)])
    weight = np.concatenate([w for _, w in vectors] or [np.empty(0)])
    order = np.lexsort((place, term))
    place, term, weight = place[order], term[order], weight[order]
    of_block = place // block
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (of_block[1:] != of_block[:-1])])) if place.size else np.empty(0, np.int64)
    return {
        "entry_at": np.searchsorted(term[first], np.arange(terms + 1)), "entry_block": of_block[first], "entry_most": np.maximum.reduceat(weight, first) if first.size else np.empty(0),
        "posting_at": np.append(first, len(place)), "places": place, "posting_weights": weight,
    }


def _vector(counts: Counter, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(sorted(counts), dtype=np.int64)
    w = (1 + np.log(np.array([counts[i] for i in at.tolist()], dtype=np.float64))) * idf[at]
    return at, w / np.sqrt((w * w).sum())


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., last[0] - 1, first[1], ..."""
    n = last - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def nearest(index: Index, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
    """(places, cosines) of the k examples of greatest positive cosine, exact; ties go to the lower place.

    The blocks of greatest bound are opened first; of the others those that
    their k-th cosine does not rule out.
    """
    lo, hi = index.entry_at[at], index.entry_at[at + 1]
    entry = _ranges(lo, hi)
    own, of_block = np.repeat(w, hi - lo), index.entry_block[entry]
    bounds = np.bincount(of_block, own * index.entry_most[entry], index.blocks)

    def opened(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(blocks[of_block])
        e = entry[some]
        lo, hi = index.posting_at[e], index.posting_at[e + 1]
        posting = _ranges(lo, hi)
        sims = np.bincount(index.places[posting], np.repeat(own[some], hi - lo) * index.posting_weights[posting], 1)
        hit = np.flatnonzero(sims)
        return hit, sims[hit]

    def best(places: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(places) > 8 * k:  # all that may still be among the k
            cut = np.partition(cosines, len(cosines) - k)[len(cosines) - k] - 1e-11
            few = np.flatnonzero(cosines >= cut)
            places, cosines = places[few], cosines[few]
        top = np.lexsort((places, -cosines.round(12)))[:k]
        return places[top], cosines[top]

    first = np.zeros(index.blocks, bool)
    first[np.argsort(-bounds, kind="stable")[:FIRST]] = True
    places, cosines = best(*opened(first))
    kth = cosines[-1] - 1e-11 if len(cosines) == k else 0.0
    rest = (bounds > 0) & (bounds >= kth) & ~first
    if rest.any():
        more, theirs = opened(rest)
        places, cosines = best(np.concatenate([places, more]), np.concatenate([cosines, theirs]))
    return places, cosines


def raw_vote(index: Index, counts: Counter, but: int | None = None, k: int = NEIGHBOURS) -> tuple[float, np.ndarray]:
    """The distance-weighted share of toxic neighbours, and their places; without neighbours the share among termless examples.

    ``but`` leaves out one place: an example that is judged by the others.
    """
    if not counts:
        return index.none_rate(), np.empty(0, np.int64)
    places, cosines = nearest(index, *_vector(counts, index.idf), k=k if but is None else k + 1)
    if but is not None:
        others = np.flatnonzero(places != but)[:k]
        places, cosines = places[others], cosines[others]
    if not places.size:
        return index.none_rate(), places
    vote = index.weights[places] / (1.05 - np.minimum(cosines, 1.0))
    return float((vote * index.labels[places]).sum() / vote.sum()), places


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps (x, value) that fit y best in weighted squares (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    stack: list[list[float]] = []
    for i in order.tolist():
        stack.append([x[i], y[i] * w[i], w[i]])
        while len(stack) > 1 and (stack[-2][0] == stack[-1][0] or stack[-2][1] / stack[-2][2] >= stack[-1][1] / stack[-1][2]):
            last = stack.pop()
            stack[-1] = [last[0], stack[-1][1] + last[1], stack[-1][2] + last[2]]
    return np.array([s[0] for s in stack]), np.array([s[1] / s[2] for s in stack])


def calibrated(steps: tuple[np.ndarray, np.ndarray], raw: float) -> float:
    """Linear between the steps; a little of the raw vote breaks ties and keeps the order."""
    x, y = steps
    base = float(np.interp(raw, x, y)) if len(x) else raw
    return min(1.0, max(0.0, 0.98 * base + 0.02 * raw))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _samples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, weight, text: a bounded sample of the training labels by hash order, one text (the least) for each."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64(F.lit("toxicity"), "doc_id"))
    parts = []
    for toxic in (0, 1):
        own = known.filter(F.col("toxic") == toxic)
        count = own.count()
        top = own.orderBy("h", "doc_id").limit(EXAMPLES).collect()
        parts += [(r.doc_id, toxic, count / len(top)) for r in top]
    sample = docs.sparkSession.createDataFrame(parts, "s_id long, toxic int, weight double")
    drawn = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("s_id"))  # at most twice EXAMPLES rows
    return checkpoint(drawn.groupBy("doc_id", "toxic", "weight").agg(F.min("text").alias("text")))


def _counter(terms: list[str]):
    """Counts of the terms in a text; the automaton is built once per Python worker and call."""
    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(t, i)
    if terms:
        found.make_automaton()

    def count(text: str | None) -> Counter:
        return Counter(i for _, i in found.iter(normalized(text))) if terms else Counter()

    return count


def choose_terms(sample: DataFrame) -> list[str]:
    """The character strings whose chi-square between the labels exceeds what chance gives the best of as many strings.

    Of M strings without any bearing on the label the greatest chi-square is
    about 2 ln M; the limit follows the sample, whatever its size.
    """
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return []

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for frame in batches:
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                totals[toxic].update(grams(text))
        for toxic, c in totals.items():
            if c:
                yield pd.DataFrame({"term": list(c), "toxic": toxic, "n": list(c.values())})

    a, b = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0))
    per_term = sample.select("text", "toxic").mapInPandas(tidied(features), "term string, toxic int, n long").groupBy("term").agg(a.alias("a"), b.alias("b"))
    expected = (F.col("a") + F.col("b")) * (n1 / (n0 + n1))
    rest = (n0 + n1) - (F.col("a") + F.col("b"))
    expected_rest = rest * (n1 / (n0 + n1))
    chi2 = (F.col("a") - expected) ** 2 * (1 / expected + 1 / F.greatest(expected_rest, F.lit(1e-9))) * ((n0 + n1) / n0)
    judged = checkpoint(per_term.select("term", chi2.alias("chi2")))  # the strings of the sample
    least = 2 * np.log(max(2, judged.count()))
    return sorted(r.term for r in judged.filter(F.col("chi2") >= float(least)).collect())


def fit_index(docs: DataFrame, labels: DataFrame) -> Index:
    """Choose terms on the sample, count them over all documents, index the sample, calibrate on it.

    Only rows with crc32(doc_id) mod 3 other than 1 lend their labels. What
    reaches the driver is bounded by the sample: the terms that tell its labels
    apart, their document frequencies, its term counts and votes.
    """
    sample = _samples(docs, labels)
    terms = choose_terms(sample)

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total, rows = _counter(terms), Counter(), 0
        for frame in batches:
            for text in frame["text"]:
                rows += 1
                total.update(count(text).keys())
        yield pd.DataFrame({"t": [-1, *total], "n": [rows, *total.values()]})

    df = {int(r.t): int(r.n) for r in docs.select("text").mapInPandas(tidied(frequencies), "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    n_docs = max(1, df.get(-1, 0))
    idf = np.array([np.log((1 + n_docs) / (1 + df.get(i, 0))) + 1 for i in range(len(terms))])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(terms)
        for frame in batches:
            got = [count(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "toxic": frame["toxic"], "weight": frame["weight"], "t": [list(c) for c in got], "n": [list(c.values()) for c in got]})

    rows = sample.mapInPandas(counted, "doc_id long, toxic int, weight double, t array<int>, n array<int>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.toxic))
    bare, kept = [r for r in rows if not r.t], [r for r in rows if r.t]
    total = sum(r.weight for r in rows)
    # neighbours in one block resemble each other, so that bounds are tight: order by label and heaviest term
    counts = [Counter(dict(zip(r.t, r.n, strict=True))) for r in kept]
    vectors = [_vector(c, idf) for c in counts]
    order = sorted(range(len(kept)), key=lambda i: (kept[i].toxic, int(vectors[i][0][vectors[i][1].argmax()]), kept[i].doc_id))
    index = Index(
        terms=terms, idf=idf, **build_lists([vectors[i] for i in order], len(terms)),
        labels=np.array([kept[i].toxic for i in order], dtype=np.float64), weights=np.array([kept[i].weight for i in order]), ids=np.array([kept[i].doc_id for i in order], dtype=np.int64),
        none_toxic=sum(r.weight * r.toxic for r in bare), none_all=sum(r.weight for r in bare),
        prior=sum(r.weight * r.toxic for r in rows) / total if total else 0.0, steps=(np.empty(0), np.empty(0)),
    )
    if {r.toxic for r in rows} == {0, 1}:
        raw = np.array([*votes_of_examples(docs, index, [counts[i] for i in order]), *[index.none_rate(r.toxic, r.weight) for r in bare]])
        judged = [*[kept[i] for i in order], *bare]
        index.steps = isotonic(raw, np.array([float(r.toxic) for r in judged]), np.array([r.weight for r in judged]))
    return index


def votes_of_examples(docs: DataFrame, index: Index, counts: list[Counter]) -> list[float]:
    """The vote of each indexed example by its neighbours but itself, in the order of places; dealt to the executors."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(index)  # bounded by EXAMPLES

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            votes = [raw_vote(shared.value, Counter(dict(zip(t, n, strict=True))), int(p))[0] for p, t, n in zip(frame["place"], frame["t"], frame["n"], strict=True)]
            yield pd.DataFrame({"place": frame["place"], "vote": votes})

    rows = [(p, list(c), list(c.values())) for p, c in enumerate(counts)]
    asked = spark.createDataFrame(rows, "place int, t array<int>, n array<int>").repartition(32, "place")
    return [r.vote for r in sorted(asked.mapInPandas(judge, "place int, vote double").collect(), key=lambda r: r.place)]


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add held_out, score (0 to 1), predicted (1 at ``THRESHOLD`` or more) and evidence (doc_ids of the five nearest examples).

    Only the text is an input of a score. Null and empty texts, and texts
    without any term, get the rate of the examples without terms. Without usable
    labels every score is 0; with one class only, that class's rate. Labels
    that repeat for a doc_id count as toxic if one does; of texts that repeat
    for one the least is its example. Rows repeat as given, further columns pass
    through, an empty table stays empty.
    """
    if clash := {"held_out", "score", "predicted", "evidence"} & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    scored = _scored(docs, labels)
    return scored.select(
        *docs.columns, held_out(F.col("doc_id")).alias("held_out"), F.col("__x.score").alias("score"),
        (F.col("__x.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("__x.evidence").alias("evidence"),
    )


def _scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with __x: score and evidence."""
    index = fit_index(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by EXAMPLES

    @F.pandas_udf("struct<score:double,evidence:array<long>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        count = _counter(own.terms)
        seen: dict[frozenset, tuple] = {}
        for texts in batches:
            scores, evidence = [], []
            for t in texts:
                counts = count(t)
                key = frozenset(counts.items())
                if key not in seen:
                    if len(seen) > 50_000:
                        seen.clear()
                    raw, places = raw_vote(own, counts)
                    seen[key] = (calibrated(own.steps, raw), own.ids[places[:5]].tolist())
                s, e = seen[key]
                scores.append(s)
                evidence.append(e)
            yield pd.DataFrame({"score": scores, "evidence": evidence})

    return docs.withColumn("__x", score("text"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``docs``, whatever their names, for the rows not predicted toxic.

    Scored as by score_toxicity(): null and empty texts stay unless termless
    examples are mostly toxic; repeated rows are judged alike.
    """
    return _scored(docs, labels).filter(F.col("__x.score") < THRESHOLD).select(*docs.columns)
