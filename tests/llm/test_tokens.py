import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import _tokens as K
from tessera.llm import packing, token_counts, token_store
from tests.llm.conftest import ODD

BYTE, WORD = K.default_path("byte_bpe_50k.json"), K.default_path("word_bpe_49k.json")
ALPHABET = st.sampled_from(list("aB z\n\t'#1²éßİ\u0085\x1f日") + ["'s", "  ", "<|endoftext|>", "the ", " don't"])


def library(path, text):
    return K.load(path).encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(texts):
    enc = K.Encoder(BYTE)
    for t in texts.values():
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == library(BYTE, t)


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=25).map("".join))
def test_ids_of_any_text(text):
    assert np.frombuffer(K.encoder(BYTE).ids(text), "<u4").tolist() == library(BYTE, text)


SIGNS = st.sampled_from(list("aBz09 \n\t\r'#.|²µª«×÷\xa0éßİĀȿɏ\x7f日") + ["'s", "'ll ", " '", "  ", "\r\n", "<|endoftext|>", "word"])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.none() | st.lists(ALPHABET | SIGNS, max_size=12).map("".join), max_size=8), st.sampled_from([pa.string(), pa.large_string()]))
def test_ids_of_many_texts_at_once(texts, kind):
    flat, n = K.encoder(BYTE).all_ids(pa.array(["before", *texts, "behind"], kind).slice(1, len(texts)), 2)
    want = [[*library(BYTE, t or ""), 2] for t in texts]
    assert n.tolist() == list(map(len, want)) and flat.tolist() == sum(want, [])


def test_ids_of_all_texts_at_once(texts):
    texts = list(texts.values())
    flat, n = K.Encoder(BYTE).all_ids(pa.array(texts), 2)
    want = [[*library(BYTE, t), 2] for t in texts]
    assert n.tolist() == list(map(len, want)) and flat.tolist() == sum(want, [])


def test_the_store_looks_recurring_pieces_up_once(spark, monkeypatch):
    looked = []

    class Pieces(K._Pieces):
        def get(self, piece, default=None):
            looked.append(piece)
            return super().get(piece, default)

        def __getitem__(self, piece):
            looked.append(piece)
            return super().__getitem__(piece)

    enc = K.Encoder(BYTE)
    enc.pieces = Pieces(enc._piece)
    monkeypatch.setattr(K, "encoder", lambda *a: enc)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    text = " ".join(f"word{'abcdefghij'[i % 10]}, 12." for i in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([text] * 20)], names=["doc_id", "text"])

    class Docs:
        sparkSession = spark
        schema = None

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return list(run(iter([batch])))

    rows = token_store._rows(Docs(), BYTE, 2, "doc_id", "text", "bigint")
    assert sum(b.num_rows for b in rows) > 20 and len(looked) < 200 < 20 * 2000


def test_batches_for_encoding_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(token_store, "AT_ONCE", 10)
    texts = ["aaaa", None, "bbbb", "", "cccc", "d" * 50, "e", None]
    got = [b.column(1).to_pylist() for b in token_store._sliced([pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["doc_id", "text"])])]
    assert sum(got, []) == texts and all(len(b) == 1 or sum(len(t or "") for t in b) <= 10 for b in got) and len(got) < 8


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=25).map("".join))
def test_counts_of_any_text(text):
    inc = token_counts._prefixes(WORD).increments(text)
    assert len(inc) == len(text) and token_counts.tokens_at(inc, len(inc)) == len(library(WORD, text))


def test_piece_tables_stay_bounded(monkeypatch):
    monkeypatch.setattr(K, "KEPT", 50)
    p = K._Pieces(lambda x: x.encode())
    for i in range(1000):
        p = p.current()
        assert p[f"{i}"] == f"{i}".encode() and p["often"] == b"often"
        assert len(p) <= 51 and len(p.old) <= 51
    for i in range(1000):
        p[f"in one text {i}"]
    assert len(p) <= 100


def test_every_prefix_has_its_count(texts):
    rng = random.Random(5)
    p = token_counts._prefixes(WORD)
    for t in rng.sample(sorted(texts.values()), 40):
        inc = p.increments(t)
        for k in rng.sample(range(len(t) + 1), min(8, len(t) + 1)):
            assert token_counts.tokens_at(inc, k) == len(library(WORD, t[:k]))


def test_longest_prefix_within_a_budget(texts):
    t = max(texts.values(), key=len)[:900]
    inc = token_counts._prefixes(WORD).increments(t)
    for budget in (0, 1, 17, 100, 10**6):
        want = max(k for k in range(len(t) + 1) if len(library(WORD, t[:k])) <= budget)
        assert token_counts.longest_within(inc, budget) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(ALPHABET, st.sampled_from(list("”“—’ж語한🙂e\u0301\u0327\u0338=ΑΣᄒ\u1161\u11ab") + ["’s", "<|endoftext", "word "])), max_size=25).map("".join))
def test_every_prefix_of_any_text_has_its_count(text):
    inc = token_counts._prefixes(WORD).increments(text)
    assert [token_counts.tokens_at(inc, k) for k in range(len(text) + 1)] == [len(library(WORD, text[:k])) for k in range(len(text) + 1)]


def test_every_prefix_of_long_pieces_has_its_count(texts):
    letters = "".join(c for t in list(texts.values())[:20] for c in t.lower() if c.isalpha())
    for t in ("x" * 700, letters[:900], "!?'-" * 150, "日本語" * 120, "’" + letters[:300], "e\u0301" * 200):
        inc = token_counts._prefixes(WORD).increments(t)
        assert [token_counts.tokens_at(inc, k) for k in range(len(t) + 1)] == [len(library(WORD, t[:k])) for k in range(len(t) + 1)]


def test_longest_prefix_with_a_curly_quote(texts):
    for t in [x for x in texts.values() if len(x) > 900][:10]:
        t = "“quoted” " + t[:900]
        inc = token_counts._prefixes(WORD).increments(t)
        for budget in (17, 100):
            assert token_counts.longest_within(inc, budget) == max(k for k in range(len(t) + 1) if len(library(WORD, t[:k])) <= budget)


def test_counts_of_odd_rows(odd, nothing):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.prefix_counts(odd).collect())
    assert got == sorted((i or -1, len((t or "").encode()), len(library(WORD, t or ""))) for i, t in ODD)
    assert token_counts.prefix_counts(nothing).count() == 0


def test_count_query(spark, data, texts):
    for r in token_counts.op10_token_counts(spark, data).collect():
        n = len(library(WORD, texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


# --- token store


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60000), min_size=1, max_size=3000), st.integers(0, 5))
def test_cut_points(ids, seed):
    ids = np.array(ids, "<u4")
    ends = token_store.cut_points(ids)
    assert ends == sorted(set(ends)) and ends[-1] == len(ids)
    assert all(b - a <= token_store.MOST for a, b in zip([0, *ends], ends))


def test_texts_are_cut_together_as_they_are_alone(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 300, int(n)))) for i, n in enumerate([0, 1, 40, 500, 3000, 20, 9000, 63, 64, 65, 2])]
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), f"{tmp_path}/s")
    bodies = {r.doc_id: r.body for r in spark.read.parquet(f"{tmp_path}/s/recipes").collect()}
    for i, t in rows:
        ids = np.array([*library(BYTE, t), 2], "<u4")
        ends = token_store.cut_points(ids)
        refs = [token_store.key_of(ids[a:b].astype("<u2").tobytes()) + (b - a).to_bytes(4, "little") for a, b in zip([0, *ends], ends)]
        assert bytes(bodies[i]) == token_store.merkle_root(refs) + b"".join(refs)


def test_equal_passages_share_chunks():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 50000, n).astype("<u4") for n in (20000, 777, 1234))

    def chunks(x):
        return {x[i:j].tobytes() for i, j in zip([0, *token_store.cut_points(x)], token_store.cut_points(x))}

    x, y = chunks(np.concatenate([a, common])), chunks(np.concatenate([b, common]))
    assert len(x & y) >= 0.8 * len(x)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=6))
def test_crc_from_parts(parts):
    after = [sum(map(len, parts[i + 1 :])) for i in range(len(parts))]
    whole = np.bitwise_xor.reduce(token_store.shifted_crc(np.array([zlib.crc32(p) for p in parts]), np.array(after)))
    assert int(whole) == zlib.crc32(b"".join(parts))


def store_want(rows):
    at, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library(BYTE, t or ""), 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_store_query(spark, data, texts):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.op6_token_store(spark, data).collect())
    assert got == store_want(texts.items())


def test_store_round_trip_of_odd_rows(spark, odd, nothing, tmp_path):
    token_store.write_store(odd, f"{tmp_path}/s")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = store_want(ODD)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.digest(spark, f"{tmp_path}/s").collect()), key=key) == want
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in token_store.read_documents(spark, f"{tmp_path}/s").collect()), key=key) == want
    chunks = spark.read.parquet(f"{tmp_path}/s/chunks/kind=chunk")
    assert chunks.count() == chunks.select("key").distinct().count()
    token_store.write_store(nothing, f"{tmp_path}/n")
    assert token_store.digest(spark, f"{tmp_path}/n").count() == 0 and token_store.read_documents(spark, f"{tmp_path}/n").count() == 0


def test_store_notices_damage(spark, odd, tmp_path):
    token_store.write_store(odd, f"{tmp_path}/s")
    chunks = spark.read.parquet(f"{tmp_path}/s/chunks/kind=chunk")
    keep = chunks.orderBy("key").limit(chunks.count() - 1).collect()
    spark.createDataFrame(keep, chunks.schema).write.mode("overwrite").parquet(f"{tmp_path}/t/chunks/kind=chunk")
    spark.read.parquet(f"{tmp_path}/s/recipes").write.parquet(f"{tmp_path}/t/recipes")
    with pytest.raises(Exception, match="a chunk is missing"):
        token_store.digest(spark, f"{tmp_path}/t").collect()
    bad = [(r.key, None, r.n, bytes([r.body[0] ^ 1]) + bytes(r.body[1:])) for r in chunks.collect()]
    spark.createDataFrame(bad, chunks.schema).write.mode("overwrite").parquet(f"{tmp_path}/u/chunks/kind=chunk")
    spark.read.parquet(f"{tmp_path}/s/recipes").write.parquet(f"{tmp_path}/u/recipes")
    with pytest.raises(Exception, match="does not have the content"):
        token_store.digest(spark, f"{tmp_path}/u").collect()


def test_reading_documents_notices_altered_chunks(spark, odd, tmp_path):
    token_store.write_store(odd, f"{tmp_path}/s")
    chunks = spark.read.parquet(f"{tmp_path}/s/chunks/kind=chunk")
    bad = [(r.key, None, r.n, bytes([r.body[0] ^ 1]) + bytes(r.body[1:])) for r in chunks.collect()]
    spark.createDataFrame(bad, chunks.schema).write.parquet(f"{tmp_path}/u/chunks/kind=chunk")
    spark.read.parquet(f"{tmp_path}/s/recipes").write.parquet(f"{tmp_path}/u/recipes")
    with pytest.raises(Exception, match="does not have the content"):
        token_store.read_documents(spark, f"{tmp_path}/u").collect()


def test_store_notices_lost_recipes(spark, odd, tmp_path):
    token_store.write_store(odd, f"{tmp_path}/s")
    recipes = spark.read.parquet(f"{tmp_path}/s/recipes")
    left = recipes.collect()[1:]
    spark.createDataFrame(left, recipes.schema).write.parquet(f"{tmp_path}/left")
    (tmp_path / "s/recipes").rename(tmp_path / "old")
    (tmp_path / "left").rename(tmp_path / "s/recipes")
    for reader in (token_store.digest, token_store.read_documents):
        with pytest.raises(ValueError, match="the manifest names"):
            reader(spark, f"{tmp_path}/s").collect()


def test_merkle_root_depends_on_order_and_count():
    r = token_store.merkle_root
    assert len({r([]), r([b"a"]), r([b"a", b"b"]), r([b"b", b"a"]), r([b"a", b"b", b"b"])}) == 5


# --- packing


def check_packing(got, ids_of):
    """``got``: rows; ids_of: (doc_id, ids) pairs."""
    by_sequence, tokens = defaultdict(list), 0
    pieces = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for v in by_sequence.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        tokens += at
    want = defaultdict(list)
    for i, ids in ids_of:
        want[i].append(ids)
    assert set(want) == set(pieces)
    for i, all_ids in want.items():
        copies = len(all_ids)  # rows of one id are alike here
        parts = sorted(pieces[i])
        assert sum(p[1] for p in parts) == copies * len(all_ids[0])
        for start, length, crc, whole in parts:
            assert whole == len(all_ids[0]) and crc == zlib.crc32(all_ids[0][start : start + length].tobytes())
    return len(by_sequence), tokens


def ids_with_end(t):
    return np.array([*library(BYTE, t or ""), 0], "<u4")


def test_packing_query(spark, data, texts):
    n, tokens = check_packing(packing.op7_packing(spark, data).collect(), [(i, ids_with_end(t)) for i, t in texts.items()])
    assert n * 1024 <= 1.01 * tokens + 1024


@pytest.mark.parametrize("words", [1, 3, 8])
def test_short_texts_fill_sequences(spark, words):
    rows = spark.range(6000).selectExpr("id as doc_id", f"repeat(' the', {words}) as text").coalesce(2)
    got = packing.pack_documents(rows).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in got) == 6000 * (words + 1) and sum(r.n for r in got) >= 0.97 * 1024 * (len(got) - 2)


@pytest.mark.parametrize("pieces, want", [([(25, 0)] * 40, (100, 4, 0)), ([(3, 0)] * 40, (30, 10, 0)), ([(20, 25)] * 40, (40, 2, 50))])
def test_all_three_limits_bind(pieces, want):
    """Tokens, segments and loss-bearing tokens: each ends the sequences of one pool."""
    pool = [packing.Piece(i, 0, n, np.ones(bears, np.uint8)) for i, (n, bears) in enumerate(pieces)]
    made = [(sum(p.length for p in s), len(s), sum(p.loss_tokens for p in s)) for s in packing.fill(pool, packing.Limits(100, 10, 50), 0, cuttable=False)]
    assert set(made) == {want}


def test_packing_odd_rows(odd, nothing):
    check_packing(packing.pack_documents(odd).withColumn("ids_crc32", F.crc32("ids")).collect(), [(i, ids_with_end(t)) for i, t in ODD])
    assert packing.pack_documents(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(1, 6), st.integers(20, 100))
def test_fill_keeps_all_limits(lengths, segments, loss):
    limits = packing.Limits(100, segments, loss)
    pool = [packing.Piece(i, 0, n, np.ones(n) if i % 2 else None) for i, n in enumerate(lengths) if n <= loss]
    want = sum(p.length for p in pool)
    made = list(packing.fill(pool, limits, 0))
    assert not pool and sum(p.length for s in made for p in s) == want
    for s in made:
        assert sum(p.length for p in s) <= 100 and len(s) <= segments and sum(p.loss_tokens for p in s) <= loss


def test_fill_does_not_cut_unless_allowed():
    pool = [packing.Piece(i, 0, n) for i, n in enumerate([60, 60, 60, 30, 30])]
    made = list(packing.fill(pool, packing.Limits(100, 8, 100), 0, cuttable=False))
    assert sorted(p.length for s in made for p in s) == [30, 30, 60, 60, 60]
    with pytest.raises(ValueError):
        list(packing.fill([packing.Piece(0, 0, 101)], packing.Limits(100, 8, 200), 0))


def test_packing_conversations(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet")
    odd = spark.createDataFrame([(10**6, 1, "user", None), (10**6, 2, None, "hello"), (10**6, 3, "assistant", "hi there"), (None, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    every = rows.select("conv_id", "turn", "role", "text").unionByName(odd)
    limits = packing.Limits(1024, 3, 300)
    got = packing.pack_conversations(every, limits=limits).collect()
    turns = defaultdict(list)
    for r in every.collect():
        turns[r.conv_id].append((r.turn, r.role, r.text))
    ids, loss = {}, {}
    for c, v in turns.items():
        parts = [(ids_with_end(t), role == "assistant") for _, role, t in sorted(v, key=lambda x: x[0])]
        ids[c], loss[c] = np.concatenate([p for p, _ in parts]), np.concatenate([np.full(len(p), b) for p, b in parts])
    seen, per_sequence = defaultdict(int), defaultdict(lambda: [0, 0, 0])
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length].tolist()
        seen[r.doc_id] += r.length
        for k, x in enumerate((r.length, 1, int(loss[r.doc_id][r.start : r.start + r.length].sum()))):
            per_sequence[r.sequence_id][k] += x
    assert {c: len(x) for c, x in ids.items()} == dict(seen)
    assert all(n <= 1024 and s <= 3 and b <= 300 for n, s, b in per_sequence.values())
