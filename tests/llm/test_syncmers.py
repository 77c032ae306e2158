"""Syncmer fingerprints against a plain version that looks at every k-mer by itself."""

import collections

import numpy as np

from lattica.llm import syncmers

K, S = syncmers.K, syncmers.S


def gram(data, size):
    return int(syncmers._grams(data + bytes(16), 1, size)[0])


def plain_anchors(data):
    out = []
    for p in range(len(data) - K + 1):
        hashes = [gram(data[q : q + S], S) for q in range(p, p + K - S + 1)]
        if min(hashes) in (hashes[0], hashes[-1]):
            out.append((p, data[p : p + K]))
    return out or ([(0, data)] if data else [])


def plain_likeness(a, b):
    """Jaccard index of the anchors with their repeats: what a sketch that holds all of them must say."""
    bags = [collections.Counter(w for _, w in plain_anchors(x)) for x in (a, b)]
    if not any(bags):
        return 1.0
    return sum((bags[0] & bags[1]).values()) / sum((bags[0] | bags[1]).values())


def texts(rng):
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    plain = ["".join(rng.choice(letters, n)) for n in (*range(0, 30), 71, 72, 73, 90, 120)]
    return [*plain, None, plain[-1][:60], "é" + plain[-3], plain[-1], plain[-1], "na " * 30, "na " * 20]


def test_against_the_plain_version(spark):
    rng = np.random.default_rng(8)
    rows = list(enumerate(texts(rng)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text").selectExpr("doc_id", "text", "1 as bucket", "2 as extra", "3 as near_next").repartition(4)
    got = {r.doc_id: r for r in syncmers.fingerprint_documents(docs, size=1000, per_range=7).collect()}
    assert sorted(got) == list(range(len(rows)))
    for i, text in rows:
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = syncmers.edited_text(text, following).encode()
        assert abs(got[i].near_edited - plain_likeness(text.encode(), edited)) < 1e-9
        assert abs(got[i].near_next - plain_likeness(text.encode(), following.encode())) < 1e-9
        found = syncmers.anchors(text.encode())[0].tolist()
        assert found == [p for p, _ in plain_anchors(text.encode())]
    by_text = collections.defaultdict(set)
    for i, text in rows:
        by_text[text or ""].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({min(v) for v in by_text.values()}) == len(by_text)


def test_one_rule_for_all_lengths():
    """Likeness falls steadily as a text is cut, whatever lengths lie on either side."""
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 80)).encode()
    whole = syncmers.sketch(text)
    for n in range(20, 81):
        assert syncmers.likeness(whole, syncmers.sketch(text[:n]))[0] > 0.5 * n / 80 - 0.1


def test_positions_tell_moved_from_shuffled():
    rng = np.random.default_rng(10)
    parts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 100)).encode() for _ in range(6)]
    text, moved, mixed = b"".join(parts), b"xyz" * 5 + b"".join(parts), b"".join(parts[::-1])
    near, in_place = syncmers.likeness(syncmers.sketch(text), syncmers.sketch(moved))
    assert near > 0.8 and in_place == 1.0
    near, in_place = syncmers.likeness(syncmers.sketch(text), syncmers.sketch(mixed))
    assert near > 0.6 and in_place < 0.5
