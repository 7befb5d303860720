import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import simhash, substring_dedup
from tessera.llm.components import components
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """doc_id -> least doc_id reachable, from (doc_id, fingerprint) pairs, by comparing all."""
    ids, parent = [i for i, _ in prints], list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    v = np.array([p for _, p in prints], np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 2).tolist():
            parent[find(i)] = find(j)
    least = defaultdict(list)
    for k in range(len(ids)):
        least[find(k)].append(ids[k])
    return [(ids[k], min((x for x in least[find(k)] if x is not None), default=None)) for k in range(len(ids))]


def test_fingerprints(texts):
    for t in list(texts.values())[:60] + [t for _, t in ODD] + ["A b", "É É É É", "a  b\tc\nd"]:
        assert simhash.fingerprint_of(t) % 2**64 == plain_fingerprint(t)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4)), max_size=40), st.integers(0, 5))
def test_bit_sliced_pairs_are_all_pairs(seeds, n_copies):
    groups, values = [], []
    for g, v, flips in sorted(seeds):
        for x in {v, *(v ^ (1 << f) for f in flips), v ^ sum(1 << f for f in flips)}:
            groups.append(g)
            values.append(x)
    v, g = np.array(values, np.uint64), np.array(groups, np.int64)
    a, b = simhash.close_pairs(v, g)
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if g[i] == g[j] and bin(values[i] ^ values[j]).count("1") <= 2}
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(want)


def test_a_large_bucket_is_compared_whole():
    v = np.arange(700, dtype=np.uint64)
    a, b = simhash.close_pairs(v, np.zeros(700, int))
    assert len(a) == sum(bin(i ^ j).count("1") <= 2 for i in range(700) for j in range(i))
    assert set(simhash.spanning(700, a, b)) == {0}


def test_near_duplicates_query(spark, data, texts):
    got = simhash.op1_simhash_near_dedup(spark, data).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in sorted(texts.items())]
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints}
    assert {r.doc_id: r.component_id for r in got} == dict(plain_components(prints)) and len(got) == len(texts)


def test_crowded_buckets_are_dealt_anew(spark, monkeypatch):
    """A chain of one-bit steps and a cloud around one value, with buckets split from 3 fingerprints on."""
    rng = np.random.default_rng(2)
    values = {0}
    for b in range(40):
        values.add(int(2**b - 1))
    cloud = int(rng.integers(0, 2**62))
    for _ in range(80):
        values.add(cloud ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(1, 4))))
    bits = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in sorted(values)], "bits long")
    v = [(x, x) for x in sorted(values)]
    monkeypatch.setattr(simhash, "CROWD", 2)
    found = {r.node: r.root for r in components(simhash.links(bits)).collect()}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    groups = defaultdict(set)
    for x, root in plain_components(v):
        groups[root].add(signed(x))
    mine = defaultdict(set)
    for x in values:
        mine[found.get(signed(x), signed(x))].add(signed(x))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200)] + [(301, 300), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 160)) and got[301] == 300 and got.get(200, 200) == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_rows(odd, nothing):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, r.bits % 2**64, r.component_id) for r in simhash.near_duplicates(odd).collect()), key=key)
    prints = sorted(((i, plain_fingerprint(t)) for i, t in ODD), key=key)
    assert got == [(i, p, c) for (i, p), (_, c) in zip(prints, plain_components(prints))]
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    least = {c for (i, _), (_, c) in zip(prints, plain_components(prints)) if i is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i in least if i is not None}) and ids.count(None) == 1


# --- substring dedup


def plain_dedup(rows):
    """For (id, text) rows: id, words, removed, kept text."""
    seen = Counter()
    for _, t in rows:
        w = WORD.findall(t or "")
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_paths_cover_every_window_once(texts):
    for t in list(texts.values())[:80]:
        joined, starts, ends = substring_dedup._words(t)
        _, first, n = substring_dedup.paths(t)
        w = (t or "").encode().split()
        assert b" ".join(w) == joined and [joined[a:b] for a, b in zip(starts, ends)] == w
        covered = [k for a, c in zip(first.tolist(), n.tolist()) for k in range(a, a + c)]
        assert covered == list(range(max(0, len(w) - 34)))
        assert all(c <= 28 for c in n)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    common = " ".join(f"w{k}" for k in rng.integers(0, 50, 200))

    def anchor_of(prefix):
        anchors, first, n = substring_dedup.paths(prefix + common)
        at = len(prefix.split())
        flat = {k: a for a, f, c in zip(anchors.tolist(), first.tolist(), n.tolist()) for k in range(f, f + c)}
        return [flat[at + k] for k in range(200 - 34)]

    assert anchor_of("") == anchor_of("x y z ") == anchor_of("q " * 40)


def test_substring_query(spark, data, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op8_substring_dedup(spark, data).collect()}
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain_dedup(sorted(texts.items()))}
    assert got == want and sum(v[1] for v in want.values()) > 0


def test_substring_edges(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(5000)]

    def words(n):
        return [vocabulary[k] for k in rng.integers(0, 5000, n)]

    passage, docs = words(90), []
    for k in range(12):  # one passage, cut to different lengths on both sides, some with an edit in it
        a, b = int(rng.integers(0, 40)), int(rng.integers(60, 91))
        mid = passage[a:b]
        if k % 3 == 0:
            mid = [*mid[:20], "edited", *mid[21:]]
        docs.append(words(int(rng.integers(0, 50))) + mid + words(int(rng.integers(0, 50))))
    docs += [passage[:35], passage[:34], ["z"] * 36, ["z"] * 34, ["p", "q"] * 30]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = sorted(tuple(r) for r in substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_dedup(rows)


def test_substring_of_odd_rows(odd, nothing):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    got = sorted((tuple(r) for r in substring_dedup.deduplicate(odd).collect()), key=key)
    assert got == sorted(plain_dedup(ODD), key=key)
    assert substring_dedup.deduplicate(nothing).count() == 0
    whole = substring_dedup.without_repeats(odd)
    assert whole.columns == odd.columns and whole.count() == len(ODD)
    by_text = {(i, len(WORD.findall(t or ""))): k for (i, t), (_, _, gone, k) in zip(ODD, plain_dedup(ODD)) if gone}
    for r in whole.collect():
        if r.text is not None and r.doc_id in (4, 5, 6):
            assert r.text in by_text.values() and r.n_chars == len(r.text)


@pytest.mark.parametrize("n, runs, want", [(40, [{"first": 0, "n": 6, "places": -1}], 40), (40, [{"first": 0, "n": 6, "places": 0b100000}], 35), (40, None, 0)])
def test_covered(n, runs, want):
    assert substring_dedup.covered(n, runs).sum() == want


def same_32_bit_hash(spark):
    """Two different texts of 40 words that Spark's 32-bit hash takes for one."""
    base = " ".join(f"v{k}" for k in range(39))
    made = spark.range(400_000).selectExpr(f"concat('{base} z', id) as text").selectExpr("text", "hash(text) as h")
    pair = made.groupBy("h").agg(F.collect_list("text").alias("all")).where("size(all) > 1").selectExpr("all").first()[0]
    return pair[:2]


def test_rows_without_an_id_are_told_apart_by_their_whole_text(spark):
    a, b = same_32_bit_hash(spark)
    rows = [(None, a), (None, a), (None, b + " tail"), (None, b)]
    got = sorted((r.n_words, r.n_removed, r.kept) for r in substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(r[1:] for r in plain_dedup(rows))
    alone = "n " * 34 + "q"
    rows = [(None, a), (None, a), (None, alone)]
    got = sorted((r.n_words, r.n_removed) for r in substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(35, 0), (40, 40), (40, 40)]


def test_most_rows_under_one_key(spark):
    """Nine rows of ten have no id and one text; one of the others shares a passage with them."""
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(None, passage)] * 450 + [(i, " ".join(f"u{i}_{k}" for k in range(50))) for i in range(49)] + [(99, "x y " + " ".join(passage.split()[5:45]) + " z")]
    got = [tuple(r) for r in substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(plain_dedup(rows), key=key)


def test_long_texts_go_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    long = [f"w{k}" for k in rng.integers(0, 900, 70_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[30_000:34_000])), (3, " ".join(long[100:160]) + " end"), (4, "solo")]
    got = sorted(tuple(r) for r in substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_dedup(rows)
    monkeypatch.setattr(substring_dedup, "PART", 50)
    _, first, n = substring_dedup.paths(" ".join(long[:500]))
    assert [k for a, c in zip(first.tolist(), n.tolist()) for k in range(a, a + c)] == list(range(466))


def test_coordinates_are_verified():
    words = [f"w{k}" for k in range(50)]
    joined, starts, ends = substring_dedup._words(" ".join(words))
    h = xxhash.xxh3_128_intdigest(" ".join(words[3:40]).encode())
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    run = {"first": 3, "n": 3, "places": -1, "path_hi": signed(h >> 64), "path_lo": signed(h % 2**64)}
    substring_dedup._verify(joined, starts, ends, [run])
    for wrong in (run | {"first": 4}, run | {"n": 2}, run | {"n": 60}, run | {"path_lo": 5}):
        with pytest.raises(ValueError, match="coordinates"):
            substring_dedup._verify(joined, starts, ends, [wrong])
