"""The pipeline's near-copy stage (wide SimHash tries) against all pairs by brute force."""

import itertools

import numpy as np

import corpus_pipeline
from lattica.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_go(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    line = list(rng.choice(words, 12))
    texts = [None, "", " ", "one two", "One  two", "three"]
    for n in (30, 60, 200, 200, 500):
        base = list(rng.choice(words, n))
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            new = list(base)
            for at in rng.integers(0, n, edits):
                new[at] = "x" + str(rng.integers(1 << 30))
            texts.append(" ".join(new))
    chain = list(rng.choice(words, 100))
    for step in range(0, 60, 4):  # neighbours are near copies, the ends are not
        texts.append(" ".join(chain[step:] + [f"y{i}" for i in range(step)]))
    texts += [" ".join([*line, *rng.choice(words, 40)]) for _ in range(40)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    sets = [word_sets(t) for t in texts]
    label = list(range(len(texts)))
    wide = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            wide += (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 2
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    assert wide > 20
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == sorted(set(label))
    twice = docs.unionAll(docs.filter("doc_id in (7, 100)"))
    assert sorted(r.doc_id for r in stage(spark, twice, "").collect()) == sorted(set(label))
    assert stage(spark, docs.limit(0), "").count() == 0


def test_similarity_is_exact_at_the_limit():
    assert simhash.similar(8, 8, 10) and not simhash.similar(7, 8, 10) and simhash.similar(80, 90, 90) and not simhash.similar(79, 90, 90)


def test_products_and_forest_are_whole():
    a0, a1, b0, b1 = (np.array(x) for x in ([0, 5, 7], [5, 6, 7 + 3000], [0, 1, 2], [2, 9, 2 + 3000]))
    got = [p for i, j in simhash._products(a0, a1, b0, b1) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) == 10 + 8 + 3000 * 3000 and max(len(i) for i, _ in simhash._products(a0, a1, b0, b1)) <= simhash.AT_ONCE
    rng = np.random.default_rng(3)
    n, i, j, d = 60, *(rng.integers(0, m, 400) for m in (60, 60, 9))
    parts = [(i[k : k + 40], j[k : k + 40], d[k : k + 40]) for k in range(0, 400, 40)]
    x, y = simhash.closest_forest(n, iter(parts), held=50)
    weight = {}
    for p, q, w in zip(i.tolist(), j.tolist(), d.tolist()):
        weight[p, q] = weight[q, p] = min(w, weight.get((p, q), 99))
    label, total = list(range(n)), 0  # Kruskal
    for w, p, q in sorted((w, p, q) for (p, q), w in weight.items() if p != q):
        if label[p] != label[q]:
            label, total = [label[p] if v == label[q] else v for v in label], total + w
    assert sum(weight[p, q] for p, q in zip(x.tolist(), y.tolist())) == total and len(x) == n - len(set(label))


def test_tries_grow_with_the_texts():
    shapes = [simhash.tries_for(n) for n in (0, 1, 10**4, 10**6, 10**8, 10**10)]
    assert shapes == sorted(shapes, key=lambda s: s[0]) and all(t <= 2 * simhash.WORDS for _, _, t in shapes)


def test_stage_on_tables_against_all_pairs(spark):
    """Documents of a table: what the tries and the confirmation find is what all pairs give."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        sets.setdefault(frozenset(simhash.shingles(r.text).tolist()), []).append(r.doc_id)
    keys = list(sets)
    label = list(range(len(keys)))
    for i, j in itertools.combinations(range(len(keys)), 2):
        a, b = keys[i], keys[j]
        if label[i] != label[j] and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and simhash.similar(len(a & b), len(a), len(b)):
            old, new = label[i], label[j]
            label = [new if x == old else x for x in label]
    least = {}
    for k, ids in zip(label, sets.values(), strict=True):
        least[k] = min([least.get(k, min(ids)), *ids])
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == sorted(least.values())
