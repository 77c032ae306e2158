"""The stages over the smallest documents, held against brute force where a stage's input is known, and over odd rows."""

import pytest

import corpus_pipeline
from lattica.llm import packing, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def sets_of(rows):
    return {r.doc_id: frozenset(simhash.shingles(r.text).tolist()) for r in rows}


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.collect()
    results = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == COLUMNS
        results[name] = docs.collect()
    kept = {r.doc_id for r in results["toxicity"]}
    assert len(kept) > 0.8 * len(before)
    sets = sets_of(results["toxicity"])
    near = lambda a, b: a == b or (bool(a) and bool(b) and simhash.similar(len(a & b), len(a), len(b)))
    label = {d: d for d in sets}
    for _ in range(6):
        for d in sets:
            label[d] = min(label[o] for o in sets if near(sets[d], sets[o]))
    assert {r.doc_id for r in results["simhash near-dedup"]} == set(label.values())
    windows = {}
    for r in results["simhash near-dedup"]:
        data = (r.text or "").encode()
        for i in range(len(data) - 199):
            windows.setdefault(data[i : i + 200], []).append(r.doc_id)
    for r in results["suffix-array dedup"]:
        data = (r.text or "").encode()
        assert all(len(windows.get(data[i : i + 200], [0])) < 2 for i in range(len(data) - 199))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.filter("piece = 0").count() == docs.count()
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).filter(f"`sum(length)` > {packing.CAPACITY}").isEmpty()


def odd_rows():
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    texts = [None, "", " \n", "one", "one", long, long + " end", "a b c d e f g", "A  b c d e f g", "x" * 5000, None]
    return [(i if i < 9 else None, t, None if i % 3 else "en", ["s1", None, "s2"][i % 3], 1) for i, t in enumerate(texts)]


CLASHES = {"takes": 1, "ranges": "r", "c_id": 2, "c_th": 2, "score": 0.5, "predicted": 1, "evidence": "e", "position": 1.0, "rank": 1, "fp": 3, "bits": "b", "id": 4, "th": 5, "m": 6, "size": 7, "length": 8, "root": 9, "component_id": 9, "least": 1, "words": 2}


@pytest.mark.parametrize("twice", [False, True])
def test_odd_rows_and_clashing_columns(spark, twice):
    rows = odd_rows() + ([odd_rows()[7], odd_rows()[7], odd_rows()[0]] if twice else [])
    docs = spark.createDataFrame([(*r, *CLASHES.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in CLASHES.items()))
    sf_dir = "/root/testdata/sf0.001"
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        if name != "best-fit packing":
            assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts[0] == len(rows) and counts[1] == 5 and counts[2] == 5
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).filter(f"`sum(length)` > {packing.CAPACITY}").isEmpty()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0
