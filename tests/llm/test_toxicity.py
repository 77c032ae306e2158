"""Toxicity scores against a plain version: dense vectors, every cosine, every example."""

import collections
import math
import zlib

import numpy as np
import pytest

from lattica.llm import toxicity

RNG = np.random.default_rng(12)
WORDS = ["".join(RNG.choice(list("abcdefghij"), int(RNG.integers(2, 7)))) for _ in range(200)]
BAD = ["grumbold", "vexgrim", "snarkle"]


def fixture():
    rows, labels = [], []
    for i in range(400):
        words = list(RNG.choice(WORDS, int(RNG.integers(0, 40))))
        toxic = i % 6 == 0
        if toxic:
            words += [b + str(RNG.choice(["", "s", "ing"])) for b in RNG.choice(BAD, int(RNG.integers(1, 4)))]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic) if i % 50 else 1 - int(toxic)))
    rows += [rows[0], rows[6], (7, "another text under one id"), (900, None), (901, ""), (902, rows[12][1]), (903, "grumbold " * 3000)]
    labels += [(6, 0), (5000, 1), (8, None)]
    return rows, labels


def plain_scores(rows, labels):
    known = {}
    for doc, toxic in labels:
        if toxic in (0, 1) and zlib.crc32(str(doc).encode()) % 3 != 1:
            known[doc] = max(toxic, known.get(doc, 0))
    text_of = {}
    for doc, text in rows:
        if doc in known:
            text_of[doc] = min(x for x in (text_of.get(doc), text) if x is not None)
    sample = [(doc, known[doc], text_of[doc]) for doc in sorted(text_of)]
    # labels of documents that are not there still count for the weights
    share = {t: sum(v == t for v in known.values()) / max(1, sum(v == t for v in known.values())) for t in (0, 1)}
    n1, n = sum(t for _, t, _ in sample), len(sample)
    count = collections.Counter(), collections.Counter()
    for _, toxic, text in sample:
        count[toxic].update(toxicity.grams(text))
    strings = set(count[0]) | set(count[1])
    terms = []
    for w in sorted(strings):
        m = count[0][w] + count[1][w]
        e, rest = m * n1 / n, max(1e-9, (n - m) * n1 / n)
        if (count[1][w] - e) ** 2 * (1 / e + 1 / rest) * n / (n - n1) >= 2 * math.log(len(strings)):
            terms.append(w)

    def times(text):
        text = toxicity.normalized(text)
        return np.array([sum(text.startswith(t, i) for i in range(len(text))) for t in terms])

    counts = [times(t) for _, t in rows]
    idf = np.log((1 + len(rows)) / (1 + sum(c > 0 for c in counts))) + 1

    def unit(c):
        v = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * idf
        return v / max(1e-300, np.sqrt((v * v).sum()))

    vectors, y = np.array([unit(times(t)) for _, _, t in sample]), np.array([t for _, t, _ in sample], float)
    bare, w = ~vectors.any(axis=1), np.array([share[int(t)] for t in y])

    def raw(v, but=None):
        if v.any():
            sims = vectors @ v
            near = sorted((i for i in range(n) if sims[i] > 0 and i != but), key=lambda i: (-round(sims[i], 12), rank[i]))[: toxicity.NEIGHBOURS]
            if near:
                vote = [w[i] / (1.05 - min(sims[i], 1.0)) for i in near]
                return sum(a * y[i] for a, i in zip(vote, near)) / sum(vote)
            but = None
        out = np.zeros(n, bool)
        out[[but] if but is not None else []] = True
        return ((w * y)[bare & ~out].sum() + (w * y).sum() / w.sum()) / (w[bare & ~out].sum() + 1)

    order = sorted(np.flatnonzero(~bare), key=lambda i: (y[i], vectors[i].argmax(), sample[i][0]))
    rank = {i: r for r, i in enumerate(order)}
    votes = np.array([raw(vectors[i], i) for i in range(n)])
    steps = toxicity.isotonic(votes, y, w)
    return {(doc, text): toxicity.calibrated(steps, raw(unit(c))) for (doc, text), c in zip(rows, counts)}


def test_scores_against_the_plain_version(spark):
    rows, labels = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, known).collect()
    plain = plain_scores(rows, labels)
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(plain[r.doc_id, r.text], abs=1e-6)
        assert r.predicted == int(r.score >= toxicity.THRESHOLD)
    clean = [r for r in got if r.held_out and r.doc_id < 400 and r.doc_id % 50]
    assert np.mean([r.predicted == int(r.doc_id % 6 == 0) for r in clean]) > 0.95


def test_columns_may_clash(spark):
    rows, labels = fixture()
    docs = spark.createDataFrame([(d, t, 1.0, "x", [1]) for d, t in rows], "doc_id long, text string, score double, predicted string, evidence array<long>")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    kept = toxicity.keep_clean(docs, known)
    assert kept.columns == docs.columns and 0.6 * len(rows) < kept.count() < len(rows)
    with pytest.raises(ValueError):
        toxicity.score_toxicity(docs, known)
    assert toxicity.keep_clean(docs.limit(0), known).count() == 0 and toxicity.keep_clean(docs, known.limit(0)).count() == len(rows)


def test_block_max_is_exact():
    terms, n = 12, 250
    dense = RNG.random((n, terms)) * (RNG.random((n, terms)) < 0.3)
    dense[:, 0] += 0.01 * (dense.sum(axis=1) == 0)
    dense /= np.sqrt((dense**2).sum(axis=1, keepdims=True))
    vectors = [(np.flatnonzero(v), v[v > 0]) for v in dense]
    index = toxicity.Index([], np.ones(terms), **toxicity.build_lists(vectors, terms), labels=np.zeros(n), weights=np.ones(n), ids=np.arange(n), none_toxic=0.0, none_all=0.0, prior=0.0, steps=(np.empty(0), np.empty(0)))
    for _ in range(30):
        at = np.sort(RNG.choice(terms, 4, replace=False))
        w = RNG.random(4)
        sims = dense[:, at] @ w
        places, cosines = toxicity.nearest(index, at, w, 10)
        assert cosines == pytest.approx(np.sort(sims[sims > 0])[::-1][:10]) and sims[places] == pytest.approx(cosines)
