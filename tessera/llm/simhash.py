"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: each 3-word shingle's XXH64 votes on 64 bits. Equal fingerprints are one class; distinct ones are linked
when they differ in at most RADIUS bits. Candidates come from the pigeonhole principle: of BLOCKS bit blocks, at least
BLOCKS - RADIUS agree in every such pair, so each choice of that many blocks is one bucket key, and no link is
missed. A bucket's fingerprints are stored as vertical bit planes, 64 to a machine word; a query's distances to all of them are counted by
carry-save bitwise adders over the planes, and a word is abandoned once its 64 lanes exceed the radius.

A bucket leaves 26 bits free. One with more than CROWD fingerprints is dealt anew by the same principle over four
blocks of those bits, which leaves 14 free: at most 2^14 distinct fingerprints share such a key, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _common as C
from tessera.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: (first bit, width) of the blocks of a fingerprint.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
CROWD = 4096
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint_of(text: str | None) -> int:
    """As a signed 64-bit number; 0 for a text without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[s : e - 1], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :])] if len(words) >= SHINGLE else [h(joined, SEED)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += part.sum(axis=0, dtype=np.uint16 if len(part) < 65536 else np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bits (signed long); one row for a row. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint_of(t) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "bits"])

    return C.texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, bits long")


def _block(bits: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, first).bitwiseAND((1 << width) - 1)


def _keys(bits: Column, blocks, choose: int, tag: Column | None = None) -> Column:
    """One number per choice of blocks: their bits and the choice."""
    out = []
    for n, chosen in enumerate(combinations(blocks, choose)):
        key, at = F.lit(n).cast("long"), 4
        for first, width in chosen:
            key = key.bitwiseOR(F.shiftleft(_block(bits, first, width).cast("long"), at))
            at += width
        out.append(key)
    return F.array(*out)


def _free_blocks(n: int) -> tuple:
    """Four (first, width) blocks of the bits that the n-th key leaves free."""
    chosen = list(combinations(BLOCKS, len(BLOCKS) - RADIUS))[n]
    return tuple(piece for first, width in BLOCKS if (first, width) not in chosen for piece in ((first, width // 2), (first + width // 2, width - width // 2)))


def _bucketed(distinct: DataFrame) -> DataFrame:
    """key, again (-1, or the second key of a crowded bucket), bits."""
    keyed = distinct.select("bits", F.explode(_keys(F.col("bits"), BLOCKS, len(BLOCKS) - RADIUS)).alias("key"))
    # stored, so that the join has a partitioning of its own, in which Spark can split a hot key
    sizes = C.stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-sizes")
    sized = keyed.join(sizes, "key")
    n_keys = len(list(combinations(BLOCKS, len(BLOCKS) - RADIUS)))
    again = reduce(lambda rest, n: F.when(F.col("key").bitwiseAND(15) == n, _keys(F.col("bits"), _free_blocks(n), 2)).otherwise(rest), range(n_keys), F.array(F.lit(-1).cast("long")))
    return sized.select("key", F.explode(F.when(F.col("n") > CROWD, again).otherwise(F.array(F.lit(-1).cast("long")))).alias("again"), "bits")


def close_pairs(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of one group whose values differ in at most RADIUS bits. ``groups`` is ascending; values are unsigned.

    Lanes are 64 values of one group. Work items are (query, lane) with the query in the lane's group, not behind the lane.
    """
    n = len(values)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, n])
    lanes_of = -(-sizes // 64)
    first_lane = np.cumsum(lanes_of) - lanes_of
    group = np.repeat(np.arange(len(starts)), sizes)
    within = np.arange(n) - starts[group]
    lane, slot = first_lane[group] + within // 64, within % 64
    total = int(lanes_of.sum())
    planes = np.zeros((64, total), np.uint64)
    there = np.zeros(total, np.uint64)
    np.bitwise_or.at(there, lane, np.uint64(1) << slot.astype(np.uint64))
    for b in range(64):
        np.bitwise_or.at(planes[b], lane, ((values >> np.uint64(b)) & np.uint64(1)) << slot.astype(np.uint64))
    todo = lanes_of[group] - within // 64  # lanes from the query's own on
    left, right = [], []
    at = 0
    ends = np.cumsum(todo)
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, side="right")))
        counts = todo[at:upto]
        q = np.repeat(np.arange(at, upto), counts)
        ln = lane[q] + (np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts))
        ones, twos, over = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64), ~there[ln]
        for b in range(64):
            differs = planes[b][ln] ^ -((values[q] >> np.uint64(b)) & np.uint64(1))
            carry = ones & differs
            ones ^= differs
            over |= (twos & carry) | (ones & twos)  # 4 or 3 differences: above the radius
            twos |= carry
            if b % 8 == 7 and b < 63:
                live = over != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not live.all():
                    q, ln, ones, twos, over = q[live], ln[live], ones[live], twos[live], over[live]
        hits = ~over
        for s in range(64):
            found = np.flatnonzero((hits >> np.uint64(s)) & np.uint64(1))
            g = group[q[found]]
            other = starts[g] + (ln[found] - first_lane[g]) * 64 + s
            keep = other > q[found]
            left.append(q[found][keep])
            right.append(other[keep])
        at = upto
    return np.concatenate(left) if left else np.empty(0, int), np.concatenate(right) if right else np.empty(0, int)


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n items the least item that the pairs connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        for side in (left, right):
            np.minimum.at(new, side, low)
            np.minimum.at(new, root[side], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(distinct: DataFrame) -> DataFrame:
    """a, b (bits): edges that connect just the fingerprints of ``distinct`` (bits, no repeats) that links of at most RADIUS bits connect.

    A bucket's links are reduced to a spanning star where they are found, so no more edges leave it than it has fingerprints.
    """
    lists = _bucketed(distinct).groupBy("key", "again").agg(F.collect_list("bits").alias("all")).where(F.size("all") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(col.offsets.to_numpy())
            for i, j in _blocks(sizes):
                at = int(sizes[:i].sum())
                values = flat[at : at + int(sizes[i:j].sum())]
                x, y = close_pairs(values.view(np.uint64), np.repeat(np.arange(j - i), sizes[i:j]))
                root = spanning(len(values), x, y)
                out = np.flatnonzero(root != np.arange(len(values)))
                yield pa.RecordBatch.from_arrays([pa.array(values[root[out]]), pa.array(values[out])], names=["a", "b"])

    return lists.select("all").mapInArrow(run, "a long, b long")


def _blocks(sizes: np.ndarray, most: int = 50_000) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(sizes):
        j, held = i + 1, int(sizes[i])
        while j < len(sizes) and held + sizes[j] <= most:
            held += int(sizes[j])
            j += 1
        yield i, j
        i = j


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bits, component_id: the least doc_id reachable over links of at most RADIUS differing bits, its own included.

    Null and wordless texts have fingerprint zero and link like any other. A null id is no component's least unless all of its
    ids are null. Repeated rows stay. Other columns are not read. Fingerprints are computed once and stored.
    """
    prints = C.stored(fingerprints(docs, id_col, text_col), "simhash")
    classes = prints.groupBy("bits").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(prints.select("bits").distinct()), "simhash-links")
    rooted = classes.join(roots, classes["bits"] == roots["node"], "left").select("bits", "least_id", F.coalesce("root", "bits").alias("root"))
    rooted = C.stored(rooted, "simhash-classes")
    # stored, so that the join has a partitioning of its own, in which Spark can split a giant component
    least = C.stored(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-least")
    by_bits = rooted.join(least, "root").select("bits", "component_id")
    return prints.join(by_bits, "bits").select("doc_id", "bits", "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that have the least id of their component. Rows of one id are one document: one of them
    stays. Rows without an id can't be told apart by it and stay."""
    named = docs.where(F.col(id_col).isNotNull())
    found = near_duplicates(named, id_col, text_col)
    least = found.where("doc_id = component_id").select(F.col("doc_id").alias("least")).distinct()
    whole = named.select(F.col(id_col).alias("id"), F.struct(*docs.columns).alias("row"))
    kept = whole.join(least, F.col("id") == F.col("least"), "left_semi").dropDuplicates(["id"]).select("row.*")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
