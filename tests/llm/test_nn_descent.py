"""NN-descent where lists of neighbours are full of links, and what its audit sees."""

import numpy as np
import pytest

from lattica.llm import nn_descent


def test_full_lists_do_not_hide_another_group(spark):
    rng = np.random.default_rng(3)
    rows, dims, half = [], 64, 25
    for _ in range(12):  # two tight halves of 25; every cosine between the halves is 0.955 to 0.97
        basis = np.linalg.qr(rng.standard_normal((dims, 2)))[0].T
        for centre in (basis[0], 0.963 * basis[0] + np.sqrt(1 - 0.963**2) * basis[1]):
            rows += [centre + 0.0015 * rng.standard_normal(dims) for _ in range(half)]
    rows += list(rng.standard_normal((300, dims)))
    data = [(i, [float(v) for v in x]) for i, x in enumerate(rows)]
    got = {r.vec_id: r for r in nn_descent.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    unit = np.array(rows)
    unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
    true = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert true[:600].min() == 49
    assert [got[i].n_links for i in range(len(rows))] == true.tolist()
    assert sum(r.kept for r in got.values()) == 12 + 300


def hot_group_and_pairs():
    rng = np.random.default_rng(4)
    pairs = rng.standard_normal((100, 64))
    rows = [*(np.ones(64) + 0.001 * rng.standard_normal((300, 64))), *np.repeat(pairs, 2, axis=0) + 0.01 * rng.standard_normal((200, 64))]
    return [x / np.sqrt((x**2).sum()) for x in rows]


def as_classes(spark, unit):
    rows = [(i, i, [float(y) for y in x], 1) for i, x in enumerate(unit)]
    return spark.createDataFrame(rows, "cid long, root long, v array<double>, copies long").repartition(3).cache()


def test_a_hot_group_does_not_hide_lost_pairs(spark):
    classes = as_classes(spark, hot_group_and_pairs())
    lost = spark.createDataFrame([(i, 300 if i < 300 else 1) for i in range(500)], "cid long, links long")
    assert nn_descent.audit(classes, lost, 0.95) == 0
    found = spark.createDataFrame([(i, 300 if i < 300 else 2) for i in range(500)], "cid long, links long")
    assert nn_descent.audit(classes, found, 0.95) == 1


def test_what_the_audit_refuses_is_searched_exactly(spark, monkeypatch):
    unit = hot_group_and_pairs()
    monkeypatch.setattr(nn_descent, "RETRIES", 0)
    monkeypatch.setattr(nn_descent, "CHUNK", 64)
    monkeypatch.setattr(nn_descent, "enlarge", lambda graph, *rest: nn_descent.components(graph.filter("a < 0").select("a", "b")))
    got = nn_descent.near_duplicates(spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(unit)], "vec_id long, embedding array<double>")).collect()
    sims = np.array(unit) @ np.array(unit).T >= 0.95
    assert {r.vec_id: r.n_links for r in got} == {i: int(n) - 1 for i, n in enumerate(sims.sum(axis=1))}
    assert {r.recall for r in got} == {1.0}


def brute(rows):
    """n_links and least reachable id by all pairs, summed pair by pair."""
    unit = [x / np.abs(x).max() for x in rows]
    unit = np.array([x / np.sqrt((x * x).sum()) for x in unit])
    links = np.array([[(x * y).sum() >= 0.95 for y in unit] for x in unit])
    label = np.arange(len(rows))
    while True:
        new = np.array([label[links[i]].min() for i in range(len(rows))])
        if (new == label).all():
            return links.sum(axis=1) - 1, label
        label = new


@pytest.mark.parametrize("parts", ["1", "8", "211"])
def test_few_alike_vectors_at_any_partition_count(spark, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    rng = np.random.default_rng(6)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        for n in (2, 5, 10) if parts != "211" else (3,):
            rows = [np.ones(16) + 0.05 * rng.standard_normal(16) for _ in range(n)] + [rng.standard_normal(16)]
            data = [(i, [float(y) for y in x], "a", 1) for i, x in enumerate(rows)]
            docs = spark.createDataFrame(data, "vec_id long, embedding array<double>, label string, cid int").repartition(n)
            got = {r.vec_id: r for r in nn_descent.near_duplicates(docs).collect()}
            links, label = brute(rows)
            assert [got[i].n_links for i in range(n + 1)] == links.tolist() and [got[i].component_id for i in range(n + 1)] == label.tolist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_a_loose_component_and_planted_links(spark, monkeypatch):
    """One component that no ball holds (a walk), small groups, and pairs within 1e-12 of the threshold."""
    monkeypatch.setattr(nn_descent, "CHUNK", 64)
    rng = np.random.default_rng(7)
    rows, x = [], rng.standard_normal(24)
    for _ in range(500):
        x = x + 0.12 * rng.standard_normal(24)
        rows.append(x / np.sqrt((x * x).sum()))
    for _ in range(40):
        centre = rng.standard_normal(24)
        rows += [centre + 0.1 * rng.standard_normal(24) for _ in range(int(rng.integers(1, 6)))]
    for shift in (-4e-13, -1e-15, 0.0, 1e-15, 4e-13):
        a, b = np.linalg.qr(rng.standard_normal((24, 2)))[0].T
        rows += [a, (0.95 + shift) * a + np.sqrt(1 - (0.95 + shift) ** 2) * b]
    data = [(i, [float(y) for y in r]) for i, r in enumerate(rows)]
    got = {r.vec_id: r for r in nn_descent.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(7)).collect()}
    links, label = brute(rows)
    assert [got[i].n_links for i in range(len(rows))] == links.tolist()
    assert [got[i].component_id for i in range(len(rows))] == label.tolist()


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert nn_descent.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    one = [1.0, 2.0, 3.0]
    rows = [(5, one), (5, one), (None, one), (7, [2.0, 4.0, 6.0]), (8, [3.0, -1.0, 0.5]), (9, None), (10, [0.0] * 3), (11, [1.0, 2.0]), (None, None)]
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in nn_descent.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [
        (False, 5, 3, 5, True), (False, 5, 3, 5, True), (False, 7, 3, 5, False), (False, 8, 0, 8, True), (False, 9, 0, 9, True), (False, 10, 0, 10, True),
        (False, 11, 0, 11, True), (True, 0, 0, None, True), (True, 0, 3, 5, False),
    ]
