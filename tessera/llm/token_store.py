"""Content-addressed store of token ids.

Files under one folder of the shared file system:

* ``chunks`` (Parquet, by kind; there the rows of kind chunk): key (blake2b-128 of the body), ids (count) and body (ids, 2 or 4 bytes each, little-endian): each
  distinct chunk once. Chunks end where a rolling hash over the last 16 ids meets a mask, so equal passages give equal
  chunks wherever they stand.
* ``recipes`` (Parquet, in ascending doc_id order): per document its chunk keys and counts, the Merkle root over
  them, its tokens and its first token's place within the file's part.
* ``manifest``: per part of the recipes their number and a sum of their hashes.

Reading back checks every chunk against its key, every recipe against its root and the recipes against the manifest; a mismatch, a missing
chunk or a missing recipe raises. A store without a manifest is read without that last check.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import _common as C
from tessera.llm import _tokens as K

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: A chunk ends at an id where the rolling hash's low bits are 0: LEAST ids at least, MOST at most, about MASK + 1 on average.
LEAST, MASK, MOST = 64, 511, 4096
_KEY = 16
#: Pieces that the encoder of a worker keeps in a generation: this operator has the memory for more than others.
PIECES = 700_000
#: Bytes of text that are encoded together.
AT_ONCE = 1 << 22
#: Keys of chunks that a task has sent already; bounded, and begun anew when full.
_SEEN = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))


@lru_cache(maxsize=1)
def _mixed() -> np.ndarray:
    return (_mix(np.arange(65536, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _marks(ids: np.ndarray) -> np.ndarray:
    """Where, behind an id, the hash of the last 16 ids calls for a cut."""
    if not len(ids):
        return np.empty(0, np.int64)
    h = _mixed()[ids] if ids.max() < 65536 else (_mix(ids.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    m, step = 0x9E3779B1, 1
    with np.errstate(over="ignore"):
        while step < 16:  # the hash over 2, 4, 8, 16 ids
            more = np.zeros_like(h)
            more[step:] = h[:-step] if step < len(h) else 0
            h = h + more * np.uint32(m)
            m, step = m * m % 2**32, 2 * step
    return np.flatnonzero((h >> np.uint32(16)) & np.uint32(MASK) == 0) + 1


def _ends(marks: list[int], n: int) -> list[int]:
    ends, last = [], 0
    for e in [*marks, n]:
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST or e == n and e > last:
            ends.append(e)
            last = e
    return ends


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    return _ends(_marks(ids).tolist(), len(ids)) if len(ids) else []


def key_of(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=_KEY).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Leaves and inner nodes are hashed with different prefixes; an odd node moves up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=32).digest() for x in leaves] or [b"\0" * 32]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=32).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


# crc32 is linear: crc(A + B) is crc(B) xor crc(A) times x^(8 len B) in GF(2)[x] modulo the polynomial (bits reflected).


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape), np.uint32)
    b = np.broadcast_to(b, out.shape).copy()
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


@lru_cache(maxsize=1)
def _powers() -> list[np.ndarray]:
    """x^(8 * 2^k), k = 0..47."""
    p = [np.array(0x00800000, np.uint32)]
    for _ in range(47):
        p.append(_times(p[-1], p[-1]))
    return p


def shifted_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What the crc of a part adds to that of a whole in which n_bytes follow it."""
    out, left, k = crc.astype(np.uint32), n_bytes.astype(np.uint64), 0
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        if odd.any():
            out = np.where(odd, _times(out, _powers()[k]), out)
        left, k = left >> np.uint64(1), k + 1
    return out


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about AT_ONCE bytes of text (a longer text alone): the more at once, the more of their pieces are the same."""
    for b in batches:
        behind = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = behind[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(behind, before + AT_ONCE, "right")))
            yield b.slice(at, to - at)
            at = to


def _rows(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, id_type: str) -> DataFrame:
    wide = K.load(path).get_vocab_size(with_added_tokens=True) > 65536
    code = "<u4" if wide else "<u2"
    schema = f"kind string, key binary, doc_id {id_type}, n int, body binary"
    out = C.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = K.encoder(path, PIECES)
        seen: set[bytes] = set()
        rows, number, part = [], 0, TaskContext.get().partitionId()
        for batch in _sliced(batches):
            # all texts at once: a cut is LEAST ids behind a text's start at least, where the hash is of that text's ids only
            flat, counts = enc.all_ids(batch.column(1), end_id)
            marks, stored, start = _marks(flat), flat.astype(code), 0
            for doc_id, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                inside = marks[np.searchsorted(marks, start, "right") : np.searchsorted(marks, start + n, "left")] - start
                last, refs = 0, []
                for e in _ends(inside.tolist(), n):
                    body = stored[start + last : start + e].tobytes()
                    refs.append((key := key_of(body)) + (e - last).to_bytes(4, "little"))
                    if key not in seen:
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(key)
                        rows.append(("chunk", key, None, e - last, body))
                    last = e
                start += n
                rows.append(("recipe", part.to_bytes(8, "big") + number.to_bytes(8, "big"), doc_id, n, merkle_root(refs) + b"".join(refs)))
                number += 1
                if len(rows) >= 1024:
                    yield C.to_batch(rows, out)
                    rows = []
        if rows:
            yield C.to_batch(rows, out)

    return C.texts(docs, id_col, text_col).mapInArrow(run, schema)


def write_store(docs: DataFrame, folder: str, *, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text (null: empty), append ``end_id`` and write chunks and recipes under ``folder``.

    Texts are encoded once and shuffled never: only chunks that a task meets first, and recipes, go through the one
    exchange that keeps each chunk once. Repeated rows get a recipe each; rows of a null id come first. A very long text is cut into
    chunks like any other. Other columns, whatever their names, are not read. An empty table makes a store that reads back empty.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = _rows(docs, path or K.default_path(VOCABULARY), end_id, id_col, text_col, id_type)
    rows.repartition("kind", "key").dropDuplicates(["kind", "key"]).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").partitionBy("kind").parquet(f"{folder}/chunks")
    found = spark.read.schema(f"key binary, doc_id {id_type}, n int, body binary, kind string").parquet(f"{folder}/chunks")
    ordered = found.where("kind = 'recipe'").select("doc_id", "key", "n", "body").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("key")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            local = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(local)], names=[*b.schema.names, "part", "local_start"])

    kinds = f"doc_id {id_type}, key binary, n int, body binary, part int, local_start long"
    ordered.mapInArrow(places, kinds).write.option("compression", "zstd").parquet(f"{folder}/recipes")
    _summed(spark.read.schema(kinds).parquet(f"{folder}/recipes")).coalesce(1).write.parquet(f"{folder}/manifest")


def _summed(recipes: DataFrame) -> DataFrame:
    """part, recipes, hashes: one row a part, the same in whatever order the recipes are read."""
    rest = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "n", "part", "local_start")
    hashed = F.sha2(F.concat("key", "body", F.encode(rest, "utf-8")), 256)
    return recipes.groupBy("part").agg(F.count(F.lit(1)).alias("recipes"), F.sum(F.conv(F.substring(hashed, 1, 15), 16, 10).cast("decimal(28,0)")).alias("hashes"))


def _recipes(spark: SparkSession, folder: str) -> DataFrame:
    """All recipes, once they agree with the manifest."""
    recipes = spark.read.parquet(f"{folder}/recipes")
    try:
        manifest = spark.read.schema("part int, recipes long, hashes decimal(38,0)").parquet(f"{folder}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return recipes
    told, found = manifest.select("part", F.struct("recipes", "hashes").alias("told")), _summed(recipes).select("part", F.struct("recipes", "hashes").alias("found"))
    wrong = told.join(found, "part", "full").where(~F.col("told").eqNullSafe(F.col("found"))).select("part").head(1)
    if wrong:
        raise ValueError(f"the recipes of part {wrong[0].part} are not those that the manifest names")
    return recipes


def _refs(recipes: DataFrame) -> DataFrame:
    """recipe (key), at (place in the document), chunk (key), n, after (ids behind it); checks the Merkle roots."""

    def run(batch: pa.RecordBatch) -> Iterator[tuple]:
        for recipe, n, body in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "body"))):
            refs = [body[i : i + _KEY + 4] for i in range(32, len(body), _KEY + 4)]
            if merkle_root(refs) != body[:32]:
                raise ValueError(f"the recipe {recipe.hex()} does not have the root that it names")
            for at, r in enumerate(refs):
                n -= (k := int.from_bytes(r[_KEY:], "little"))
                yield recipe, at, r[:_KEY], k, n

    return C.arrow_map(recipes.select("key", "n", "body"), run, "recipe binary, at int, chunk binary, n int, after long")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.schema("key binary, n int, body binary, kind string").parquet(f"{folder}/chunks")
    return found.where("kind = 'chunk'").select(F.col("key").alias("chunk"), F.col("n").alias("stored"), "body")


def _unpacked(body: bytes, n: int) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4").astype("<u4").tobytes()


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Rebuild: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), by joining the recipes' references with the chunks."""
    recipes = _with_start(_recipes(spark, folder))
    parts = _refs(recipes).join(_chunks(spark, folder), "chunk", "left").groupBy("recipe").agg(F.array_sort(F.collect_list(F.struct("at", "n", "chunk", "body"))).alias("parts"))

    def run(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, start, n, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "parts"))):
            for p in parts:
                if p["body"] is None:
                    raise ValueError("a chunk is missing")
                if key_of(p["body"]) != p["chunk"]:
                    raise ValueError(f"the chunk {p['chunk'].hex()} does not have the content that it names")
            yield doc_id, start, n, b"".join(_unpacked(p["body"], p["n"]) for p in parts)

    kind = recipes.schema["doc_id"].dataType.simpleString()
    joined = recipes.join(parts, recipes["key"] == parts["recipe"]).select("doc_id", "start", F.col("n").cast("long").alias("n_tokens"), "parts")
    return C.arrow_map(joined, run, f"doc_id {kind}, start long, n_tokens long, ids binary", rows=64)


def _with_start(recipes: DataFrame) -> DataFrame:
    """The ids before each document: what earlier parts hold (one row a part) and what the part has before it."""
    sums = recipes.groupBy("part").agg(F.sum(F.col("n").cast("long")).alias("in_part"))
    before = sums.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    return recipes.join(before, "part").withColumn("start", F.col("before") + F.col("local_start"))


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files, without moving a chunk: each stored chunk is read, checked and
    summed up once where it lies, and a document's crc32 is put together from its chunks' by linearity."""

    def sums(batch: pa.RecordBatch) -> Iterator[tuple]:
        for key, n, body in zip(*(batch.column(c).to_pylist() for c in ("chunk", "stored", "body"))):
            if key_of(body) != key:
                raise ValueError(f"the chunk {key.hex()} does not have the content that it names")
            yield key, n, zlib.crc32(_unpacked(body, n))

    def shifts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.column("crc").null_count:
                raise ValueError("a chunk is missing")
            crc = shifted_crc(b.column("crc").to_numpy(zero_copy_only=False), 4 * b.column("after").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("recipe"), b.column("stored"), pa.array(crc.astype(np.int64))], names=["recipe", "n", "crc"])

    chunks = C.arrow_map(_chunks(spark, folder), sums, "chunk binary, stored int, crc long")
    read = _recipes(spark, folder)
    recipes = _with_start(read)
    joined = _refs(read).join(chunks, "chunk", "left").select("recipe", "stored", "after", "crc").mapInArrow(shifts, "recipe binary, n int, crc long")
    whole = joined.groupBy("recipe").agg(F.sum(F.col("n").cast("long")).alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return recipes.join(whole, recipes["key"] == whole["recipe"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_token_store(spark, sf_dir: str) -> DataFrame:
    folder = C.new_path(spark, "token-store")
    write_store(C.table(spark, sf_dir, "documents"), folder)
    return digest(spark, folder)
