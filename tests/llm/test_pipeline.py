import zlib
from collections import defaultdict

import numpy as np

import __spark_entry__
import corpus_pipeline
from tessera.llm import _tokens, mixing, packing, toxicity
from tessera.llm import _common as C
from tests.llm.conftest import ODD
from tests.llm.test_dedup import plain_components, plain_dedup, plain_fingerprint
from tests.llm.test_models import plain_toxicity


def test_stages_against_plain_versions(spark, data):
    """Each stage on all that the one before kept, against a plain version of it."""
    docs, names = C.table(spark, data, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        before = docs.collect()
        out = C.stored(stage(spark, docs, data), f"test-{name}")
        if name == "toxicity":
            of_model = toxicity.train(*toxicity.training_rows(docs, C.table(spark, data, "labels")))
            of = of_model.scorer()
            assert sorted(out.collect()) == sorted(r for r in before if of(r.text) < 0.5) and out.count() < len(before)
            assert all(abs(of(r.text) - plain_toxicity(of_model, r.text)) < 1e-9 for r in before[:40])
        elif name == "simhash_near_dedup":
            found = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in before])
            assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, c in found if i == c)
            assert set(out.collect()) <= set(before)
        elif name == "substring_dedup":
            want = {i: (gone, kept) for i, _, gone, kept in plain_dedup([(r.doc_id, r.text) for r in before])}
            old = {r.doc_id: r for r in before}
            for r in out.collect():
                gone, kept = want[r.doc_id]
                assert r.text == (kept if gone else old[r.doc_id].text) and r.n_chars == len(r.text) and r.lang == old[r.doc_id].lang
            assert out.count() == len(before)
        elif name == "source_mixing":
            taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
            words = {}
            for r in out.collect():
                words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
                assert r.n_chars == len(r.text)
            assert words == {i: n for i, n in taken.items() if n}
        else:
            tok = _tokens.load(_tokens.default_path(packing.VOCABULARY))
            got = out.collect()
            ids_of = sorted((r.doc_id, [*tok.encode(r.text, add_special_tokens=False).ids, 0]) for r in before)
            want, found = defaultdict(list), defaultdict(list)
            for i, ids in ids_of:
                want[i].append(ids)
            for r in got:
                found[r.doc_id].append((r.doc_tokens, r.start, r.length, np.frombuffer(r.ids, "<u4").tolist()))
            assert set(want) == set(found)
            for i, texts in want.items():  # of an id's texts, whole or cut, each is put together from its pieces
                assert sum(n for _, _, n, _ in found[i]) == sum(map(len, texts))
                for n, start, length, ids in found[i]:
                    assert len(ids) == length and any(len(t) == n and t[start : start + length] == ids for t in texts)
            assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
            by = {}
            for r in got:
                by.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert all(sum(n for _, n in v) <= 1024 and [o for o, _ in sorted(v)] == np.r_[0, np.cumsum([n for _, n in sorted(v)])][:-1].tolist() for v in by.values())
        if name != "packing":
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        docs = out
    assert names == ["toxicity", "simhash_near_dedup", "substring_dedup", "source_mixing", "packing"]


def test_queries_are_registered():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert "op5_source_mixing" in __spark_entry__.oracle_sql()


def test_pipeline_on_odd_rows(spark, odd, nothing, data):
    for docs in (odd, nothing):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            kept = C.stored(stage(spark, kept, data), f"odd-{name}")
        assert (kept.count() > 0) == (docs is odd)
        if docs is odd:
            # 1 to 3 have no words, 10 is a copy of 9 and 6 of 5; 4 and 5 are one sentence over and over
            assert {r.doc_id for r in kept.collect()} == {None, 7, 8, 9} < {i for i, _ in ODD}


def test_run_gives_the_rows_of_the_stages_chained_by_hand(spark, data):
    docs = C.table(spark, data, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = C.stored(stage(spark, docs, data), f"chained-{name}")
    rows = [sorted(map(tuple, x.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())) for x in (docs, corpus_pipeline.run(spark, data))]
    assert rows[0] and rows[0] == rows[1]


def test_every_query_on_empty_tables(spark, data, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in __spark_entry__.queries().items():
        if name.startswith("op") and name[2].isdigit() or name == "pipeline":
            assert query(spark, str(tmp_path)).count() == 0, name
