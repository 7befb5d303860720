import base64
import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tessera.llm import media, mixing, multiset_hash, quality, toxicity
from tests.llm.conftest import ODD

BIG = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    _, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    del order
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def held_out(spark, got, label, sf):
    m = got.toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    m = m[m.held_out]
    return m, m[label].to_numpy()


# --- toxicity


def test_toxicity_held_out(spark):
    m, y = held_out(spark, toxicity.op9_toxicity(spark, BIG), "toxic", BIG)
    assert auc(m.score.to_numpy(), y) > 0.75 and (m.predicted == y).mean() > 0.9


def test_toxicity_fold_and_cut(spark, data):
    for r in toxicity.op9_toxicity(spark, data).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def synthetic(n=240):
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(4000)]
    rows = []
    for i in range(n):
        words = [vocabulary[k] for k in rng.integers(0, 4000, 120)]
        if i % 3 == 0:
            for k in rng.integers(0, 120, 4):
                words[k] = ["zorgle", "quixbat", "vurmish"][int(rng.integers(0, 3))]
        rows.append((" ".join(words), int(i % 3 == 0)))
    return rows


def test_toxic_dictionary_learns_what_tells_the_classes_apart():
    rows = synthetic()
    model = toxicity.train(rows[:180])
    assert b"zorgle" in model.toxic and b"zorgle" not in model.ordinary
    of = model.scorer()
    got = np.array([of(t) >= 0.5 for t, _ in rows[180:]])
    assert (got == np.array([y == 1 for _, y in rows[180:]])).mean() > 0.9
    assert of(None) == of("") and 0 <= of("") < 0.5


def test_toxicity_training_takes_one_row_of_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(7, f"text {i}", 1) for i in range(900)] + [(i, "long " * 5000, 1) for i in range(100)] + [(8, None, 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, i % 2, 5) for i in range(100)] + [(7, 0, 5), (7, 1, 5), (None, 1, 5), (3, None, 5)], "doc_id long, toxic int, text int")
    rows, _ = toxicity.training_rows(docs, labels)
    inside = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    assert len(rows) == len(inside) and sum(y for _, y in rows) == sum(i % 2 for i in inside) and all(0 < len(t) <= toxicity.LONGEST for t, _ in rows)
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 5)
    monkeypatch.setattr(toxicity, "MOST_ORDINARY", 4)
    assert len(toxicity.training_rows(docs, labels)[0]) == 9


def plain_toxicity(model, text):
    """A model applied with compressors of its two dictionaries, window by window, feature by feature."""
    a, b = (zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.ordinary, model.toxic))
    words, features = (text or "").lower().encode().split(), [1.0]
    for size in (8, 11):
        apart, at = [], 0
        while True:
            w = b" " + b" ".join(words[at : at + size]) + b" "
            apart.append(len(a.compress(w)) - len(b.compress(w)))
            at += size - 1
            if at >= len(words) - 1:
                break
        n, mean, top = len(apart), sum(apart) / len(apart), sorted(apart)[::-1][:3]
        reach = [sum(x >= k for x in apart) for k in (1, 2, 3, 4, 5, 6, 8)]
        features += [mean, sum(top) / len(top), top[0], n**-0.5, mean * n**-0.5, *[r / n for r in reach], *[np.log1p(r) for r in reach], np.log(n)]
    return 1 / (1 + np.exp(-np.clip(np.dot(features, model.weights), -30, 30)))


def test_toxicity_query_against_plain_scores(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(*toxicity.training_rows(docs, labels))
    got = {r.doc_id: r.score for r in toxicity.op9_toxicity(spark, BIG).collect()}
    for r in docs.collect()[:150]:
        assert abs(got[r.doc_id] - plain_toxicity(model, r.text)) < 1e-9


def test_toxicity_without_examples(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(*toxicity.training_rows(odd, labels))
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.0}
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.without_toxic(odd, model).count() == len(ODD)


def test_odd_rows_get_scores(odd):
    model = toxicity.train(synthetic())
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2, 3)} == {toxicity.Model.scorer(model)("")}
    assert toxicity.without_toxic(odd, model).columns == odd.columns


# --- quality


def test_quality_held_out(spark):
    m, y = held_out(spark, quality.op2_quality(spark, BIG), "quality", BIG)
    assert auc(m.score.to_numpy(), y) > 0.95 and (m.predicted == y).mean() > 0.95


def test_quality_expression_is_the_ensemble(spark, documents):
    stats = quality.statistics(documents)
    pdf = stats.toPandas()
    x = pdf[list(quality.STATISTICS)].to_numpy(float)
    y = (x[:, 3] > np.median(x[:, 3])).astype(int)
    model = quality.train(x, y)
    assert model.rules or model.linear
    got = {r.doc_id: r.score for r in quality.score(stats, model).collect()}
    assert np.allclose([got[i] for i in pdf.doc_id], model.evaluate(x))
    assert len(model.rules) < 200


def plain_statistics(text):
    """From the definitions, by characters and words of Python."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [float(len(raw))] + [0.0] * 21
    n, k = len(raw), len(words)
    share = lambda chars: sum(raw.count(bytes([c])) for c in chars) / n
    letters, upper = range(97, 123), range(65, 91)
    marks, symbols, spaces = b".,;:!?'\"-()", b"#$%&*+/<=>@[\\]^_`{|}~", b" \t\n\x0b\x0c\r"
    known = {*letters, *upper, *range(48, 58), *marks, *symbols, *spaces}
    lines = [x for x in raw.split(b"\n") if x.strip()]
    most = max(words.count(w) for w in set(words))
    pairs = list(zip(words, words[1:]))
    return [
        n, k, sum(map(len, words)) / k, max(map(len, words)), share([*letters, *upper]), share(upper), share(range(48, 58)), share(spaces), share(symbols), share(marks), share([c for c in range(256) if c not in known]),
        len(set(words)) / k, len(set(pairs)) / len(pairs) if pairs else 1.0, most / k, sum(a == b for a, b in pairs) / len(pairs) if pairs else 0.0,
        1 - len(set(lines)) / len(lines), len(lines), n / len(lines), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), sum(len(w) <= 3 for w in words) / k, sum(w[0] in upper for w in words) / k,
        sum(len(zlib.compress(raw[i : i + 4096], 1)) for i in range(0, n, 4096)) / n,
    ]


def test_quality_statistics_against_their_definitions(texts):
    for t in [*list(texts.values())[:60], *[t for _, t in ODD], "a a a", "x" * 1_500_000, "word " * 300_000]:
        assert np.allclose(quality.statistics_of(t), plain_statistics(t))


def plain_score(model, row):
    """A model applied to one row of statistics, rule by rule."""
    z = model.bias
    for rule, w in model.rules:
        z += w * all(row[s] > t if above else row[s] <= t for s, above, t in rule)
    for s, low, high, w in model.linear:
        z += w * min(max(row[s], low), high)
    return 1 / (1 + np.exp(-z))


def test_quality_query_against_plain_scores(spark):
    """The whole query, with the model trained on rows outside the fold and applied in plain Python to plain statistics."""
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(*quality.training_rows(quality.statistics(docs), labels))
    got = {r.doc_id: r for r in quality.op2_quality(spark, BIG).collect()}
    assert 0 < len(model.rules) < 60
    for r in docs.collect():
        want = plain_score(model, plain_statistics(r.text))
        assert abs(got[r.doc_id].score - want) < 1e-9 and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_a_thousand_rules_compile(spark):
    rng = np.random.default_rng(3)
    n = len(quality.STATISTICS)
    rules = [(tuple((int(s), bool(a), float(t)) for s, a, t in zip(rng.integers(0, n, 3), rng.integers(0, 2, 3), rng.normal(size=3))), float(w)) for w in rng.normal(size=1000)]
    model = quality.Ensemble(0.1, rules, [(1, -1.0, 1.0, 0.5)])
    x = rng.normal(size=(20, n))
    stats = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "doc_id long, " + ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = {r.doc_id: r.score for r in quality.score(stats, model).collect()}
    assert np.allclose([got[i] for i in range(20)], [plain_score(model, row) for row in x])


def test_training_takes_one_row_of_an_id(spark, monkeypatch):
    """Ids repeat in both tables, one of them in nine rows of ten; names of other columns clash."""
    docs = spark.createDataFrame([(7, f"text {i}", 1) for i in range(900)] + [(i, f"other {i} words", 1) for i in range(100)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, i % 2, 0, 5) for i in range(100)] + [(7, 0, 0, 5), (7, 1, 0, 5), (None, 1, 0, 5), (3, None, 0, 5)], "doc_id long, quality int, toxic int, n_words int")
    x, y = quality.training_rows(quality.statistics(docs), labels)
    inside = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(y) == len(inside) and y.sum() == sum(i % 2 and i != 7 for i in inside)
    monkeypatch.setattr(quality, "MOST_GOOD", 5)
    monkeypatch.setattr(quality, "MOST_BAD", 4)
    assert len(quality.training_rows(quality.statistics(docs), labels)[1]) == 9


def test_quality_of_odd_rows(odd, nothing):
    stats = quality.statistics(odd)
    model = quality.train(np.random.default_rng(0).normal(size=(60, len(quality.STATISTICS))), np.arange(60) % 2)
    got = quality.score(stats, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)
    assert quality.statistics(nothing).count() == 0


def test_quality_with_one_class():
    x = np.zeros((5, len(quality.STATISTICS)))
    assert quality.train(x, np.ones(5, int)).evaluate(x).min() > 0.99 and quality.train(x, np.zeros(5, int)).evaluate(x).max() < 0.01
    assert quality.train(x[:0], np.zeros(0, int)).evaluate(x)[0] == 0.5


# --- media


def test_media_round_trip(texts):
    for t in [*list(texts.values())[:50], *[t for _, t in ODD]]:
        raw = (t or "").encode()
        payload = media.payload_of(t)
        assert payload.startswith(raw) and set(payload[len(raw) :]) <= {255} and len(payload) % 576 == 0 and 0 < len(payload) < len(raw) + 577
        assert media.from_wav(media.to_wav(payload)) == payload


def test_peak_pairs_name_a_tone():
    t = np.arange(576 * 8)
    tone = (127 + 100 * np.sin(2 * np.pi * t * 40 / 576)).astype(np.uint8).tobytes()
    pairs = media.peak_pairs(tone)
    strongest = [p for p in pairs if p >> 14 & 1023 == 40 and p >> 4 & 1023 == 40]
    assert len({p >> 24 for p in strongest}) >= 14 and {p & 15 for p in strongest} == {1, 2, 3} and any(p & 15 == 0 for p in pairs)
    shifted = media.peak_pairs(tone[288:])
    assert {p & 0xFFFFFF for p in strongest} <= {int(p) & 0xFFFFFF for p in shifted}


def plain_pairs(payload):
    """Frame by frame and peak by peak, from a transform written out as sums of cosines and sines."""
    t, f = np.arange(576), np.arange(289)
    wave_of = np.exp(-2j * np.pi * np.outer(t, f) / 576)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * t / 575)
    x = np.frombuffer(payload, np.uint8).astype(float) - 128
    peaks = []
    for at in range(0, len(x) - 575, 288):
        m = np.abs((x[at : at + 576] * hann) @ wave_of).astype(np.float32).round(1)
        tops = [b for b in range(1, 288) if m[b] > m[b - 1] and m[b] >= m[b + 1]]
        peaks.append(sorted(tops, key=lambda b: (-m[b], b))[:3])
    out = []
    for i, mine in enumerate(peaks):
        out += [(i, a, b, 0) for k, a in enumerate(mine) for b in mine[k + 1 :]]
        out += [(i, a, b, gap) for gap in (1, 2, 3) if i + gap < len(peaks) for a in mine for b in peaks[i + gap]]
    return sorted((i << 24) + (a << 14) + (b << 4) + gap for i, a, b, gap in out)


def test_media_features_against_a_plain_transform(spark, data, texts):
    """The arrays in the query's result; rounding may part two peaks of nearly equal strength."""
    same = whole = 0
    for r in media.op3_media_columns(spark, data).where("doc_id % 9 = 0 and n_bytes < 6000").collect():
        want = plain_pairs(media.payload_of(texts[r.doc_id]))
        same, whole = same + len(set(r.pairs) & set(want)), whole + len(set(r.pairs) | set(want))
        assert r.pairs == sorted(r.pairs)
        frames = (r.payload_bytes - 576) // 288 + 1
        assert r.feature == f"{frames}-{len(r.pairs)}-{xxhash.xxh3_128_hexdigest(np.array(r.pairs, '<i8').tobytes())}"
    assert same > 0.995 * whole > 0


def test_media_query(spark, data, texts):
    by_text = {}
    for r in media.op3_media_columns(spark, data).collect():
        t = texts[r.doc_id]
        payload = media.payload_of(t)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes == 44 + len(payload) and r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest()
        assert by_text.setdefault(t, r.feature) == r.feature
    assert len(set(by_text.values())) > 0.9 * len(by_text)


def test_media_of_odd_rows(odd, nothing):
    got = media.media_table(odd).collect()
    assert sorted(r.n_bytes for r in got) == sorted(len((t or "").encode()) for _, t in ODD)
    assert media.media_table(nothing).count() == 0


# --- fingerprints


def test_multiset_hash_is_homomorphic():
    M = multiset_hash
    a, b = ["one", "two", "two"], ["three"]
    assert (M.insert(M.signs_of(a), b) == M.signs_of(b + a)).all() and (M.delete(M.signs_of(a + b), b) == M.signs_of(["two", "one", "two"])).all()
    assert (M.signs_of(a) != M.signs_of(["one", "two"])).any() and not M.signs_of([]).any()
    assert (M.read(M.written(M.signs_of(a))) == M.signs_of(a)).all()


def test_likeness_follows_the_share_in_common():
    M = multiset_hash
    for shared in (0, 30, 60, 90, 100):
        x, y = [f"p{i}" for i in range(100)], [f"p{i}" for i in range(shared)] + [f"q{i}" for i in range(100 - shared)]
        assert abs(M.likeness(M.signs_of(x), M.signs_of(y)) - shared / 100) < 0.25
    assert M.likeness(M.signs_of(x), M.signs_of(x)) == 1 and M.likeness(M.signs_of([]), M.signs_of([])) == 1


def plain_units(text):
    """Lines and sentences; longer ones in groups of words, cut behind words that their ends and length choose, or after 16."""
    out = []
    for line in re.sub(r"([.!?])\s", "\\1\n", text).split("\n"):
        line = line.strip()
        words = line.split() if len(line) > 64 else [line] if line else []
        group = []
        for k, w in enumerate(words):
            group.append(w)
            if len(words) == 1 or (7 * ord(w[0]) + 3 * ord(w[-1]) + len(w)) % 4 == 0 or len(group) == 16 or k == len(words) - 1:
                out.append(" ".join(group))
                group = []
    return out


def plain_signs(text):
    """Lane by lane, bit by bit, in whole numbers."""
    lanes = [0] * 256
    for unit, times in Counter(plain_units(text)).items():
        bits = "".join(f"{x:08b}" for x in hashlib.blake2b(unit.encode(), digest_size=32).digest())
        lanes = [a + (times if b == "1" else -times) for a, b in zip(lanes, bits)]
    return lanes


def plain_likeness(a, b):
    apart, whole = sum((x - y) ** 2 for x, y in zip(a, b)), sum(x * x + y * y for x, y in zip(a, b))
    return 1.0 if not apart else max(0.0, 1 - apart / whole)


def plain_written(lanes):
    wide = any(not -(2**15) <= x < 2**15 for x in lanes)
    return base64.b64encode(struct.pack(f"<256{'i' if wide else 'h'}", *lanes)).decode()


def plain_next(rows):
    def place(r):
        h = xxhash.xxh64_intdigest((r[1] or "").encode(), 42) if r[1] is not None else 42
        return (-(r[0] if r[0] is not None else -(2**63)), h - 2**64 if h >= 2**63 else h, r[1] is not None, r[1] or "")

    order = sorted(rows, key=place)
    out = []
    for k, (i, t) in enumerate(order):
        text, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        new = text[: len(text) - n] + following[:n]
        a, b, c = plain_signs(text), plain_signs(new), plain_signs(following)
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), plain_written(a), plain_written(b), plain_likeness(a, b), plain_likeness(a, c)))
    return out


def test_counts_of_repeats_do_not_wrap():
    M = multiset_hash
    f = [M.signs_of(["line"] * n) for n in (400, 600, 40_000, 60_000, 65_536, 0)]
    assert abs(M.likeness(f[2], f[3]) - M.likeness(f[0], f[1])) < 1e-9 and M.likeness(f[4], f[5]) < 0.1
    assert M.written(f[4]) != M.written(f[5]) and all((M.read(M.written(x)) == x).all() for x in f)
    assert (M.signs_of(["a"] * 32_768) != M.signs_of(["b"] * 32_768)).any()


def test_most_rows_under_one_id(spark, monkeypatch):
    monkeypatch.setattr(multiset_hash, "BUCKET", 10)
    rows = [(None, f"text number {k} stands here") for k in range(270)] + [(k, f"another {k}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in multiset_hash.compare_with_next(df).collect()), key=key) == sorted(plain_next(rows), key=key)
    found = multiset_hash._in_order(df, "doc_id", "text").where("extra = 0").groupBy("place").count().collect()
    assert max(r["count"] for r in found) <= 30


@pytest.mark.parametrize("bucket", [20_000, 23])
def test_fingerprint_query(spark, data, texts, bucket, monkeypatch):
    monkeypatch.setattr(multiset_hash, "BUCKET", bucket)
    got = sorted(tuple(r) for r in multiset_hash.op4_multiset_fingerprints(spark, data).collect())
    assert got == sorted(plain_next(list(texts.items())))
    assert np.mean([r[5] > r[6] for r in got]) > 0.95


@pytest.mark.parametrize("bucket", [20_000, 3])
def test_fingerprints_of_odd_rows(odd, nothing, bucket, monkeypatch):
    monkeypatch.setattr(multiset_hash, "BUCKET", bucket)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in multiset_hash.compare_with_next(odd).collect()), key=key) == sorted(plain_next(ODD), key=key)
    assert multiset_hash.compare_with_next(nothing).count() == 0
    one = odd.where("doc_id = 8")
    r = multiset_hash.compare_with_next(one).first()
    assert r.near_next == 1.0


# --- mixing


def check_mix(rows, size_of_source):
    """Targets are the fixed point, documents stay within twice their size, and what a source takes comes to its target."""
    total = sum(size_of_source.values())
    weights = dict(zip(sorted(size_of_source, key=lambda s: (s is None, s or "")), [5, 2, 1] * len(size_of_source)))
    goal = dict.fromkeys(size_of_source, 0.0)
    open_, rest = set(size_of_source), 1.5 * total
    while open_:
        level = rest / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * size_of_source[s]}
        if not over:
            goal |= {s: level * weights[s] for s in open_}
            break
        goal |= {s: 2.0 * size_of_source[s] for s in over}
        rest -= sum(2 * size_of_source[s] for s in over)
        open_ -= over
    taken = dict.fromkeys(size_of_source, 0)
    for source, r in rows:
        assert r.source_size == size_of_source[source] and abs(r.target - goal[source]) < 1e-6 * max(1, goal[source])
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    assert all(taken[s] == int(goal[s] + 1e-9) or abs(taken[s] - goal[s]) < 1.001 for s in taken)


@pytest.mark.parametrize("slice_", [20_000, 7])
def test_mixing_query(spark, data, documents, slice_, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", slice_)
    source = {r.doc_id: (r.source, len((r.text or "").encode().split())) for r in documents.collect()}
    got = mixing.op5_source_mixing(spark, data).collect()
    sizes = {}
    for s, n in source.values():
        sizes[s] = sizes.get(s, 0) + n
    assert len(got) == len(source) and all(r.size == source[r.doc_id][1] for r in got)
    check_mix([(source[r.doc_id][0], r) for r in got], sizes)
    again = mixing.op5_source_mixing(spark, data).collect()
    assert sorted(got) == sorted(again)


def test_mixing_slices_do_not_change_the_mix(spark, data, monkeypatch):
    a = sorted(mixing.op5_source_mixing(spark, data).collect())
    monkeypatch.setattr(mixing, "SLICE", 5)
    assert sorted(mixing.op5_source_mixing(spark, data).collect()) == a


def test_mixing_of_odd_rows(odd, nothing):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and {r.taken for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(nothing).count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    words = sum(len((r.text or "").encode().split()) for r in mixed.collect())
    assert words == sum(r.taken for r in got)
    assert mixing.mixed_documents(nothing).count() == 0


def test_mixing_of_many_rows_without_an_id(spark, monkeypatch):
    """Nine rows of ten have no id and one source; slices stay small, blocks add up."""
    monkeypatch.setattr(mixing, "SLICE", 20)
    monkeypatch.setattr(mixing, "BLOCK", 3)
    rows = [(None, "word " * (k % 7) + f"n{k}", "hot") for k in range(900)] + [(k, "a b c", f"s{k % 5}") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing._taken(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    assert len(got) == len(rows)
    check_mix([(r.source, r) for r in got], dict(sizes))
    draws = docs.select((F.floor((1 - F.exp(F.log(mixing.uniform(F.col("doc_id"), F.col("text"))))) * 50)).alias("slice")).groupBy("slice").count().collect()
    assert max(r["count"] for r in draws) < 60


def test_heavier_documents_come_first(spark):
    rows = [(i, "plain words " * 20 if i % 2 else "#### $$$$ " * 20, "s") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    twice = [r.doc_id for r in got if r.taken > r.size]
    assert len(twice) > 150 and np.mean([i % 2 for i in twice]) > 0.65


def test_mixing_main_path_is_native(spark, data):
    plan = mixing.op5_source_mixing(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))
    assert F is not None
