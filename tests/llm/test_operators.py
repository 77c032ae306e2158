"""Each training-data operator against a brute-force version on a small fixture with nulls, ties, repeats and odd texts."""

import collections
import hashlib
import itertools
import math
import re
import time
import zlib

import numpy as np
import pytest

from lattica.llm import html_text, mixing, nn_descent, packing, sharding, simhash, suffix, syncmers, toxicity, urls
from lattica.llm.common import components
from lattica.llm.queries import QUERIES, word_tokenizer_path

RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdeé"), int(RNG.integers(2, 8)))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


SHARED = prose(60)
BASE = prose(90)
TEXTS = [
    BASE, BASE, BASE.replace(" ", "  ", 1), BASE + " extra", None, "", "  \n\t ", "x", "Ab cd", prose(4000), "na " * 300,
    prose(30) + "\n" + SHARED + "\n" + prose(10), SHARED, prose(20) + SHARED, "é" * 250, "a<|endoftext|>b it's John's", prose(50), prose(51),
]
ROWS = [(i, t, "en", [None, "s2", "s10", "s1"][i % 4], 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s1", 7)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_feistel_is_a_bijection_with_an_inverse():
    for n in (0, 1, 2, 3, 17, 1000, 4097):
        p = sharding.FeistelPermutation(n)
        out = p.forward(np.arange(n))
        assert sorted(out.tolist()) == list(range(n)) and (p.inverse(out) == np.arange(n)).all()
    with pytest.raises(ValueError):
        sharding.FeistelPermutation(5).forward([5])


def test_op1(docs, none):
    got = sharding.shard_documents(docs, 4).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        text = TEXTS[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    place = lambda rows: sorted((r.doc_id, r.shard, r.slot) for r in rows)
    assert place(got) == place(sharding.shard_documents(docs.repartition(7), 4).collect())
    assert sharding.shard_documents(none).count() == 0


def test_op2(docs, none):
    order = sorted(ROWS, key=lambda r: (r[0], r[1] or ""))
    got = sorted(syncmers.fingerprint_documents(docs, per_range=5).collect(), key=lambda r: r.doc_id)
    for i, (row, r) in enumerate(zip(order, got, strict=True)):
        edited = syncmers.edited_text(row[1] or "", order[(i + 1) % len(order)][1] or "")
        assert (r.n_chars, r.edited_sha256) == (len(row[1] or ""), hashlib.sha256(edited.encode()).hexdigest())
    same = {r.doc_id: r for r in got}
    assert same[0].fingerprint == same[1].fingerprint and same[0].near_next == 1.0 and same[9].near_edited > 0.4 > 0.1 > same[9].near_next
    assert syncmers.fingerprint_documents(none).count() == 0


def test_syncmers_do_not_depend_on_context():
    np.seterr(over="ignore")
    data = prose(80).encode()
    at, hashes = syncmers.anchors(data)
    for cut in (1, 7, 50):
        other = dict(zip(*(x.tolist() for x in syncmers.anchors(b"zzz" + data[cut:])), strict=True))
        kept = {p - cut + 3: h for p, h in zip(at.tolist(), hashes.tolist(), strict=True) if p >= cut}
        assert kept.items() <= other.items()


def test_suffix_arrays():
    for n, k, base in itertools.product((1, 2, 9, 60, 300), (1, 2, 4), (0, 5, 1 << 17)):
        text = np.append(RNG.integers(1, k + 1, n), 0)
        assert suffix.suffix_array(text, base).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())


def brute_repeats(rows, window):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = collections.Counter(d[i : i + window] for _, d in data for i in range(len(d) - window + 1))
    out = []
    for doc, d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        out.append((doc, len(d), len(d) - len(kept), len(suffix._spans(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [24_000, 1])
def test_op4(docs, none, hot):
    got = suffix.remove_repeats(docs, hot=hot).drop("kept", "spans").collect()
    assert sorted(map(tuple, got)) == brute_repeats(ROWS, 200)
    assert suffix.remove_repeats(none).count() == 0
    cut = {r.doc_id: r.text for r in suffix.without_repeats(docs, hot=hot).collect()}
    assert cut[4] is None and cut[0] == "" and cut[16] == TEXTS[16] and SHARED not in cut[11]


@pytest.mark.parametrize("hot", [suffix.HOT, 20])
def test_op4_on_a_common_passage(spark, monkeypatch, hot):
    """A passage that most documents share between texts of their own, on either side of both limits, and many equal rows."""
    monkeypatch.setattr(suffix, "HEAVY_ROWS", 50)
    monkeypatch.setattr(suffix, "HEAVY", 0.0)
    rows = [(i, prose(int(RNG.integers(1, 30))) + " " + SHARED + " " + prose(int(RNG.integers(1, 30)))) for i in range(120)] + [(500, BASE)] * 60 + [(501, prose(80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix.remove_repeats(docs, hot=hot)
    assert sorted(map(tuple, got.drop("kept", "spans").collect())) == brute_repeats(rows, 200)
    _, covered = suffix.repeated_intervals(docs, hot=hot)
    assert covered.filter("__id = 500").selectExpr("size(__ranges)").first()[0] < 30  # not one set for each of the equal rows


def test_op5(docs, none):
    plan = mixing.plan_mix(docs).collect()
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r] or "")) for r in range(len(TEXTS))}
    total = collections.Counter()
    for r in plan:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-6
        assert all(0 <= t.position <= 1 for t in r.takes)
        total[r.source] += r.taken
    for r in plan:
        assert abs(total[r.source] - r.target) <= 0.5
    assert mixing.plan_mix(none).count() == 0
    mixed = mixing.mix_documents(docs).collect()
    assert sum(len((r.text or "").split()) for r in mixed) == sum(total.values())


def test_op6(spark, none):
    texts = [prose(40) + (" vexgrim" + "abc"[i % 3] if i % 5 == 0 else "") + " " + prose(5) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    own = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in own]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    unlabelled = toxicity.score_toxicity(docs, labels.filter("toxic > 1")).collect()
    assert {r.score for r in unlabelled} == {0.0} and toxicity.keep_clean(none, labels).count() == 0


def test_op7(spark):
    page = """<html><head><title>no</title><style>x{}</style><body><p>one<p>two &amp; <b>three</b><ul><li>a<li>b<ol><li>c</ol></ul>
    <div hidden>no</div><span style="display: none">no</span><table><tr><th>k<th>value<tr><td>long key<td>1</table>t<br>u<script>"</p>"</script><pre> x
  y</pre>"""
    assert html_text.page_text(page) == "one\n\ntwo & three\n\n- a\n- b\n  1. c\n\nk         value\nlong key  1\n\nt\nu\n\n x\n  y"
    for odd in ("", None, "<", "a < b", "<p", "<!-- x", "<div>" * 3000 + "deep", "<table>x<tr>y</table>", "</p></div>z"):
        assert isinstance(html_text.page_text(odd), str)
    df = spark.createDataFrame([(1, None), (2, "<p>a"), (2, "<p>a")], "page_id long, html string")
    assert sorted(r.text for r in html_text.extract_text(df).collect()) == ["", "a", "a"]
    with pytest.raises(ValueError):
        html_text.extract_text(df.withColumnRenamed("page_id", "text"))


def brute_components(values, near):
    label = list(range(len(values)))
    for _ in values:
        for i, j in itertools.combinations(range(len(values)), 2):
            if near(values[i], values[j]):
                label[i] = label[j] = min(label[i], label[j])
    return label


def test_op8(docs, none):
    got = simhash.simhash_components(docs).collect()
    prints = [simhash.fingerprint(r[1]) for r in ROWS]
    label = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((r[0], f"{prints[i]:016x}", ROWS[label[i]][0]) for i, r in enumerate(ROWS))
    assert simhash.simhash_components(none).count() == 0
    words = [(t or "").lower().split() for _, t, *_ in ROWS]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = brute_components(sets, lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b))
    kept = [r.doc_id for r in simhash.deduplicate(docs).collect()]
    assert sorted(kept) == sorted({ROWS[x][0] for x in label})


def test_trie_pairs_and_prefixes(spark):
    base = RNG.integers(0, 2**63, 40).astype(np.uint64)
    flips = np.array([(1 << int(a)) | (1 << int(b)) for a, b in RNG.integers(0, 64, (120, 2))], dtype=np.uint64)
    values = np.unique(np.concatenate([base, np.repeat(base, 3) ^ flips]))
    expected = {(i, j) for i, j in itertools.combinations(range(len(values)), 2) if int(values[i] ^ values[j]).bit_count() <= 2}
    got = [(int(i), int(j)) for a, b in simhash.close_pairs(values, None, 0) for i, j in zip(a, b, strict=True)]
    assert set(got) == expected and len(got) == len(expected)
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    edges = simhash.link_fingerprints(fps, len(values), per_prefix=8)
    groups = {r.node: r.root for r in components(edges).collect()}
    label = brute_components(values.tolist(), lambda a, b: (a ^ b).bit_count() <= 2)
    own = [groups.get(int(v), int(v)) for v in values.view(np.int64)]
    assert len(set(own)) == len(set(label)) and len(set(zip(own, label, strict=True))) == len(set(label))


def test_components_of_a_path(spark):
    edges = spark.range(50).selectExpr("id * 7 % 51 a", "(id + 1) * 7 % 51 b")
    assert {r.root for r in components(edges).collect()} == {0}


def test_op9(docs, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(word_tokenizer_path())
    got = packing.pack_documents(docs, word_tokenizer_path(), 256).collect()
    expected = []
    for doc, text, *_ in ROWS:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(doc, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())) for k in range(0, len(ids), 256)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(none, word_tokenizer_path()).count() == 0


def test_idle_workers_forget_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "IDLE", 0.05)
    path = word_tokenizer_path()
    before = packing.tokenizer_of(path).encode_batch([BASE])
    packing.release_when_idle()
    assert packing.tokenizer_of(path) is packing.tokenizer_of(path)  # asked for in time: kept
    time.sleep(0.3)
    assert path in packing._tokenizers
    packing.release_when_idle()
    time.sleep(0.5)
    assert path not in packing._tokenizers
    assert packing.tokenizer_of(path).encode_batch([BASE]) == before


def _plain_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


@pytest.mark.parametrize(("shape", "per_bucket"), [("mixed", 200_000), ("mixed", 40), ("short", 200_000), ("one length", 200_000)])
def test_rounds_against_plain_best_fit(spark, monkeypatch, shape, per_bucket):
    monkeypatch.setattr(packing, "PER_BUCKET", per_bucket)
    rng = np.random.default_rng(5)
    lengths = {"mixed": np.minimum(rng.lognormal(2.5, 1, 400).astype(int) + 1, 64), "short": rng.integers(1, 5, 300), "one length": np.full(150, 21)}[shape].tolist()
    pieces = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long").repartition(5)
    got = packing.pack_pieces(pieces, 64).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        ends = np.cumsum([n for _, n in sorted(b)])
        assert ends[-1] <= 64 and [o for o, _ in sorted(b)] == [0, *ends[:-1]]
    assert len(bins) <= math.ceil(_plain_best_fit(lengths, 64) * 1.02)


def test_a_sweep_takes_the_closest_gap_by_rank(spark):
    slots = spark.createDataFrame([(s, 1, n) for s, n in enumerate([9, 7, 7, 4])], "sequence long, slot int, size long")
    pieces = spark.createDataFrame(list(enumerate([8, 6, 6, 6, 3])), "id long, size long")
    rows = packing._sweep(pieces, slots, {8: 1, 6: 3, 3: 1}, {9: 1, 7: 2, 4: 1}).filter("kind = 1").collect()
    assert sorted((r.size, -1 if r.sequence is None else r.sequence) for r in rows) == [(3, 3), (6, -1), (6, 1), (6, 2), (8, 0)]


def test_op10(spark):
    cases = ["http://a.Example.COM/en/71?q", "https://com/en/x", "http://xcom/en/1", "http://n.net/de/1", "http://example.net/de/8#f", "x", None, "http://w.org/es/", "http://w.org?/es/", "a://b://c.com/en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] * 2, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, urls.rules_frame(spark)).collect()}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and got[1] == ("com", "/en/x", "com/en/", "block")
    assert got[2][2:] == (None, "allow") and got[4][2:] == ("example.net/de/8", "block") and got[5] == got[6] == ("", "", None, "allow")
    assert got[7][3] == "block" and got[8] == ("w.org", "", None, "allow") and got[9][:2] == ("b:", "//c.com/en/")
    assert urls.filter_urls(pages, urls.rules_frame(spark, [("com", "", "block")])).count() == 20
    assert urls.filter_urls(pages.limit(0), urls.rules_frame(spark)).count() == 0


def test_op3(spark):
    centres = RNG.standard_normal((6, 16))
    rows = [x + 0.05 * RNG.standard_normal(16) for x in np.repeat(centres, 40, axis=0)] + list(RNG.standard_normal((60, 16)))
    data = [(i, [float(v) for v in x]) for i, x in enumerate(np.float32(rows))]
    data += [(300, data[0][1]), (301, None), (302, [0.0] * 16), (303, [float("nan")] + [1.0] * 15), (304, [])]
    got = {r.vec_id: r for r in nn_descent.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()}
    able = [i for i, x in data if i <= 300]
    unit = np.array([data[i][1] for i in able])
    unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
    sims = unit @ unit.T >= 0.95
    assert len(got) == len(data)
    found = np.array([got[i].n_links for i in able])
    assert (found <= sims.sum(axis=1) - 1).all() and found.sum() >= 0.97 * (sims.sum() - len(able))
    assert got[300].component_id == 0 and not got[300].kept and all(got[i].n_links == 0 and got[i].kept for i in (301, 302, 303, 304))


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 11))
