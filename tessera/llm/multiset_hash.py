"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs. Each paragraph is hashed (blake2b) to LANES signs, +1 or -1, and the fingerprint is
the sum of these vectors modulo 2^32, lane by lane. So it does not depend on the order; inserting or deleting a paragraph adds
or subtracts one vector; equal multisets have equal fingerprints. The lanes of two fingerprints' difference are sums of
random signs over the paragraphs in which the texts differ, so the difference's mean square estimates how many those are, from which
``likeness`` follows without either text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tessera.llm import _common as C

LANES = 256
#: A paragraph ends at a line's end or a sentence's end; one that is longer goes on as several, cut behind
#: a word whose first and last character decide it, so that a cut moves with the words around it.
LONG = 64
#: Documents that a bucket of the order by id is meant to hold, and buckets to a task. The driver holds the cut points: from MOST_BUCKETS on the buckets
#: grow with the input, with the same results (a task sorts on disk and reads its bucket as a stream, so its memory does not grow).
BUCKET, PER_TASK, MOST_BUCKETS = 2000, 4, 50_000
_LEAST = -(2**63)


def paragraphs(text: str) -> list[str]:
    """The units that are hashed; white space around a unit doesn't count, empty units neither."""
    out = []
    for line in re.split(r"\n|(?<=[.!?])\s", text):
        line = line.strip()
        if len(line) <= LONG:
            if line:
                out.append(line)
            continue
        held: list[str] = []
        for w in line.split():
            held.append(w)
            if (7 * ord(w[0]) + 3 * ord(w[-1]) + len(w)) % 4 == 0 or len(held) == 16:
                out.append(" ".join(held))
                held = []
        if held:
            out.append(" ".join(held))
    return out


def signs_of(units: list[str]) -> np.ndarray:
    """The sum of the units' sign vectors, modulo 2^32."""
    if not units:
        return np.zeros(LANES, np.uint32)
    h = hashlib.blake2b
    total = np.zeros(LANES, np.int64)
    for at in range(0, len(units), 4096):
        bits = np.unpackbits(np.frombuffer(b"".join([h(u.encode(), digest_size=LANES // 8).digest() for u in units[at : at + 4096]]), np.uint8).reshape(-1, LANES // 8), axis=1)
        total += 2 * bits.sum(axis=0, dtype=np.int64) - len(bits)
    return total.astype(np.uint32)


def fingerprint(text: str | None) -> np.ndarray:
    return signs_of(paragraphs(text or ""))


def insert(fp: np.ndarray, units: list[str]) -> np.ndarray:
    return fp + signs_of(units)


def delete(fp: np.ndarray, units: list[str]) -> np.ndarray:
    return fp - signs_of(units)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, about 2 |A and B| / (|A| + |B|) of the multisets otherwise, within 0 to 1."""
    x, y = a.view(np.int32).astype(np.float64), b.view(np.int32).astype(np.float64)
    apart = (a - b).view(np.int32).astype(np.float64)
    whole = float(x @ x + y @ y)
    return 1.0 if not apart.any() else max(0.0, 1.0 - float(apart @ apart) / whole) if whole else 1.0


def written(fp: np.ndarray) -> str:
    """Two bytes a lane where all lanes fit (texts of up to 32,767 units do), else four."""
    signed = fp.view(np.int32)
    return base64.b64encode(signed.astype("<i2" if signed.min() >= -(2**15) and signed.max() < 2**15 else "<i4").tobytes()).decode()


def read(fp: str) -> np.ndarray:
    raw = base64.b64decode(fp)
    return np.frombuffer(raw, "<i2" if len(raw) == 2 * LANES else "<i4").astype(np.int32).view(np.uint32)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the first of the text that follows, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint; one row for a row. A null text counts as empty, whose fingerprint is all zeros."""

    def run(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield doc_id, written(fingerprint(text))

    return C.arrow_map(C.texts(docs, id_col, text_col), run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fingerprint string", rows=512)


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """place (bucket of the order by descending id, then hash of the text, then text), at, doc_id, text, extra: each bucket holds its documents and, as an
    extra row, the document that follows its last one. Only ids and hashes are looked at to deal the buckets; the texts are shuffled once.

    Cut points are quantiles of the ids, as many as make buckets of about BUCKET documents. An id with more rows than that (null, say) has
    buckets of its own, by ranges of the hash; rows of equal ids and equal texts stay together.
    """
    keyed = C.texts(docs, id_col, text_col, F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("at"), F.xxhash64(F.col(text_col)).alias("hash"))
    met = C.stored(keyed.groupBy("at").agg(F.count(F.lit(1)).alias("n")), "multiset-ids")
    n = met.agg(F.sum("n")).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(1, -(-n // BUCKET)))
    size = -(-n // buckets)
    heavy = {r["at"]: -(-r["n"] // size) for r in met.where(F.col("n") > size).collect()}  # no more than there are buckets
    found = keyed.agg(F.percentile_approx("at", [i / buckets for i in range(1, buckets)], max(10_000, 20 * buckets))).first()[0] if buckets > 1 else []
    # a bucket has the ids up to its cut and above the cut before; those of a heavy id are cut off on both sides
    cuts = np.array(sorted({*(found or []), *heavy, *(i - 1 for i in heavy if i > _LEAST)}), np.int64)
    parts = np.ones(len(cuts) + 1, np.int64)
    for i, k in heavy.items():
        parts[np.searchsorted(cuts, i, side="left")] = k
    behind = parts.sum() - np.cumsum(parts)  # descending ids, ascending places

    def place(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        b = np.searchsorted(cuts, ids, side="left")
        share = (hashes.astype(np.float64) + 2.0**63) / 2.0**64
        return behind[b] + np.minimum((share * parts[b]).astype(np.int64), parts[b] - 1)

    @F.pandas_udf(IntegerType())
    def bucket(at, hash):
        import pandas as pd

        return pd.Series(place(at.to_numpy(), hash.to_numpy()), dtype="int32")

    # the head of each bucket that has any document: a row a bucket
    first = F.max(F.struct("at", (-F.col("hash") - 1).alias("low")))  # -x - 1 turns the order of longs around
    heads = {r["place"]: (r["head"]["at"], -r["head"]["low"] - 1) for r in keyed.select("at", "hash", bucket("at", "hash").alias("place")).groupBy("place").agg(first.alias("head")).collect()}
    order = sorted(heads)
    before = {heads[p]: order[i - 1] for i, p in enumerate(order)}  # of the first, the last: the order is a ring

    @F.pandas_udf(ArrayType(IntegerType()))
    def places(at, hash):
        import pandas as pd

        ids, hashes = at.to_numpy(), hash.to_numpy()
        return pd.Series([[p, before[i]] if i in before else [p] for p, i in zip(place(ids, hashes).tolist(), zip(ids.tolist(), hashes.tolist()))])

    dealt = keyed.select("at", "hash", "doc_id", "text", F.posexplode(places("at", "hash")).alias("extra", "place"))
    return dealt.repartitionByRange(len(order) // PER_TASK + 1, "place").sortWithinPartitions("place", "extra", F.col("at").desc(), "hash", F.col("text").asc_nulls_first())


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, for each document and the one behind
    it in descending order of doc_id (behind the last: the first; a single document is behind itself).

    A null text counts as empty. Null ids come last; rows of equal ids stand in the order of their texts' hashes (XXH64, seed 42, signed) and then of
    their texts. A very long text is hashed whole. Other columns, whatever their names, are not read. An empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = C.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [], None  # last: place, doc_id, text, fingerprint of the row that waits for the one behind it
        for b in C.sliced(batches):
            for place, extra, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("place", "extra", "doc_id", "text"))):
                text = text or ""
                if extra and (last is None or last[0] != place):
                    continue  # of several rows with the head's id, the first in order is the one
                fp = fingerprint(text)
                if last is not None and last[0] == place:
                    new = edited(last[2], text)
                    other = fingerprint(new)
                    rows.append((last[1], len(last[2]), hashlib.sha256(new.encode()).hexdigest(), written(last[3]), written(other), likeness(last[3], other), likeness(last[3], fp)))
                    if len(rows) >= 512:
                        yield C.to_batch(rows, out)
                        rows = []
                last = None if extra else (place, doc_id, text, fp)
        if rows:
            yield C.to_batch(rows, out)

    return _in_order(docs, id_col, text_col).mapInArrow(run, schema)


def op4_multiset_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(C.table(spark, sf_dir, "documents"))
