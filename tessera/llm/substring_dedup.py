"""Substring dedup by De Bruijn compaction.

The windows of WINDOW words are the edges of a De Bruijn graph over all texts; an edge that is met twice or more marks its words. The graph
is never spelled out edge by edge:

1. Every text's edges are cut into paths: the longest runs of successive windows that share a minimizer (the k-mer of
   ANCHOR words with the least hash among those of a window, the leftmost at a tie). Equal windows have equal
   minimizers at equal places, so a repeated edge is only ever met on paths with the same anchor.
2. Paths whose anchor is met once in the corpus are unique and go no further.
3. Equal paths compact into one by a join on the 128-bit hash of their words: if met twice, all their edges are repeated.
4. Only where an anchor has different paths (a graph node that branches) is one representative of each, read back by its source
   coordinates, spelled out into edges; an edge is repeated if two paths have it, or one that is met twice.
5. Coordinates turn the repeated edges of each path into word ranges of all its sources; touching ranges join into the repeated spans.
   There the words that lie at the coordinates are hashed again and must give the path's hash, else the job fails.

Two runs of words count as equal if their 128-bit hashes (XXH3 of the words joined by single spaces) are, and two texts if theirs (XXH64 under two
seeds) are. With n different runs a false match has a chance of about n^2 / 2^129: below 1e-14 for 10^12 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _common as C

WINDOW, ANCHOR = 35, 8
#: Windows of one text, and words of several texts, that are looked at together; a longer text goes in parts, a path ends where a part ends.
PART = 1 << 15
_SPACE = 32
_MULT = 0x9E3779B97F4A7C15


def _words(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, their first bytes and the bytes behind their last."""
    joined = b" ".join((text or "").encode().split())
    if not joined:
        return joined, np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == _SPACE)
    return joined, np.r_[0, gaps + 1], np.r_[gaps, len(joined)]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _minimizers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a run of word hashes: the least hash among its k-mers, and where that k-mer starts (leftmost at a tie)."""
    with np.errstate(over="ignore"):
        k = hashes
        for step in (1, 2, 4):  # k-mers of ANCHOR = 8 words by doubling; the order matters, so the halves are mixed differently
            k = _scramble(k[:-step] * np.uint64(_MULT) + k[step:])
    span, low, at, width = WINDOW - ANCHOR + 1, k, np.arange(len(k)), 1
    while width < span:  # over 2, 4, ... and at last span k-mers
        step = min(width, span - width)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        width += step
    return low, at


class _Paths:
    """Paths of the parts of texts that were added, all parts at once: numpy's cost for each call is shared by short texts."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.parts: list[tuple[int, ...]] = []  # of each part: its first word in its text, its number of words, what names the text

    def add(self, text: str | None, *source: int) -> Iterator[tuple]:
        """What is ready."""
        words = (text or "").encode().split()
        for at in range(0, len(words) - WINDOW + 1, PART):
            part = words[at : at + PART + WINDOW - 1]
            self.words += part
            self.parts.append((at, len(part), *source))
            if len(self.words) >= PART:
                yield self.flush()

    def flush(self) -> tuple:
        """The source (a row for each path), anchor, first window and number of windows of each path; the words joined, and each path's first byte and the one
        behind its last."""
        words, parts = self.words, np.array(self.parts, np.int64)
        self.words, self.parts = [], []
        if not words:
            none = np.empty(0, np.int64)
            return none.reshape(0, 0), none, none, none, b"", none, none
        offset, count = parts[:, 0], parts[:, 1]
        low, at = _minimizers(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        begins = np.cumsum(count) - count
        part = np.repeat(np.arange(len(count)), count)
        inside = part[: len(low)] == part[WINDOW - 1 :]  # a window over the words of two parts is none
        new = np.r_[True, (at[1:] != at[:-1]) | (part[1 : len(low)] != part[: len(low) - 1]) | (inside[1:] & ~inside[:-1])]
        first = np.flatnonzero(new & inside)
        ends = np.r_[np.flatnonzero(new | ~inside), len(low)]
        n = ends[np.searchsorted(ends, first, side="right")] - first
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin_of = np.cumsum(lengths) - lengths
        last = first + n + WINDOW - 2
        p = part[first]
        return parts[p, 2:], low[first].view(np.int64), first - begins[p] + offset[p], n, b" ".join(words), begin_of[first], begin_of[last] + lengths[last] - 1


def paths(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each path of a text: its anchor's hash, its first window and its number of windows."""
    found = _Paths()
    done = [*found.add(text), found.flush()]
    return tuple(np.concatenate([d[i] for d in done]) for i in (1, 2, 3))


def _hashes(joined: bytes, begins: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of runs of words, as two longs."""
    h = xxhash.xxh3_128_digest
    two = np.frombuffer(b"".join([h(joined[a:b]) for a, b in zip(begins, ends)]), ">i8").reshape(-1, 2).astype(np.int64)
    return two[:, 0], two[:, 1]


def _anchors(keyed: DataFrame) -> DataFrame:
    """anchor, met: how often it is met in a few texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Paths()

        def counted(done: tuple) -> pa.RecordBatch:
            anchor, met = np.unique(done[1], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(met)], names=["anchor", "met"])

        for b in C.sliced(batches):
            for text in b.column(0).to_pylist():
                yield from map(counted, found.add(text))
        yield counted(found.flush())

    return keyed.select("text").mapInArrow(run, "anchor long, met long")


_SOURCE = "key long, text_hi long, text_lo long"
_PATH = "path_hi long, path_lo long"


def _path_rows(keyed: DataFrame) -> DataFrame:
    schema = f"anchor long, {_PATH}, {_SOURCE}, first int, n byte"
    out = C.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Paths()

        def rows_of(done: tuple) -> pa.RecordBatch:
            source, anchor, first, n, joined, begins, ends = done
            cols = [anchor, *_hashes(joined, begins.tolist(), ends.tolist()), *source.reshape(-1, 3).T, first, n]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(cols, out)], schema=out)

        for b in C.sliced(batches):
            for *source, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                yield from map(rows_of, found.add(text, *source))
        yield rows_of(found.flush())

    return keyed.select("key", "text_hi", "text_lo", "text").mapInArrow(run, schema)


def _keys(id_col: str, text_col: str) -> list[Column]:
    """key, text_hi and text_lo name a row by its id and its text: rows that share them are alike in every result. Rows without an id have the least key,
    and differ by their texts' hashes."""
    text = F.col(text_col)
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.xxhash64(text).alias("text_hi"), F.xxhash64(F.lit("w"), text).alias("text_lo")]


_BY_TEXT = ["key", "text_hi", "text_lo"]
_BY_PATH = ["path_hi", "path_lo"]
_BY_EDGE = ["edge_hi", "edge_lo"]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, text_hi, text_lo, runs array<struct<first, n, places, path_hi, path_lo>>: for each row that has any, its paths with repeated windows: first
    window, number of windows, which of them (bits; -1: all) and the path's hash. One row for rows of equal ids and texts."""
    keyed = C.texts(docs, id_col, text_col, *_keys(id_col, text_col)).drop("doc_id")
    with C.Scratch(docs.sparkSession, "substring") as scratch:
        # Lists of keys are stored before they are joined: a join right behind their aggregate would take over its partitioning, and
        # Spark could not split the partition of a hot key.
        # 2. anchors met twice or more; the count combines before its shuffle
        again = scratch.stored(_anchors(keyed).groupBy("anchor").agg(F.sum("met").alias("met")).where("met > 1").select("anchor"), "anchors")
        met = scratch.stored(_path_rows(keyed).join(again, "anchor"), "paths")
        # 3. equal paths become one, with a representative source
        compact = scratch.stored(met.groupBy("anchor", *_BY_PATH).agg((F.count(F.lit(1)) > 1).alias("twice"), F.min(F.struct(*_BY_TEXT, "first", "n")).alias("at")), "compact")
        branching = scratch.stored(compact.groupBy("anchor").agg(F.count(F.lit(1)).alias("ways")).where("ways > 1").select("anchor"), "branching")
        # 4. representatives where an anchor branches, spelled out into edges
        spelt = compact.join(branching, "anchor").select(*_BY_PATH, "twice", "at.*")
        wanted = scratch.stored(spelt.groupBy(*_BY_TEXT).agg(F.collect_list(F.struct(*_BY_PATH, "first", "n", "twice")).alias("wanted")), "wanted")
        edges = scratch.stored(_edges(keyed.join(wanted, _BY_TEXT).select("wanted", "text")), "edges")
        one, other = F.struct(*[F.min(c).alias(c) for c in _BY_PATH]), F.struct(*[F.max(c).alias(c) for c in _BY_PATH])
        repeated = edges.groupBy(*_BY_EDGE).agg(one.alias("one"), other.alias("other"), F.max("twice").alias("twice")).where("twice or one <> other")
        listed = scratch.stored(repeated.select(*_BY_EDGE), "repeated")
        marked = edges.where("not twice").join(listed, _BY_EDGE).groupBy(*_BY_PATH).agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("places"))
        # 5. back to all sources: all windows of a path met twice, the marked ones of the others
        hit = compact.where("twice").select(*_BY_PATH, F.lit(-1).cast("long").alias("places")).unionByName(marked)
        hit = scratch.stored(hit, "hit")
        runs = met.join(hit, _BY_PATH).groupBy(*_BY_TEXT).agg(F.collect_set(F.struct("first", "n", "places", *_BY_PATH)).alias("runs"))
        return C.stored(runs, "substring-spans")


def _edges(sources: DataFrame) -> DataFrame:
    """The edges of the paths that ``wanted`` names: path, whether it is met twice, place (of the edge on its path), edge (128-bit hash of its words)."""
    schema = f"{_PATH}, twice boolean, place byte, edge_hi long, edge_lo long"
    out = C.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.sliced(batches):
            for wanted, text in zip(b.column(0), b.column(1).to_pylist()):
                w = wanted.values
                joined, starts, ends = _words(text)
                path_hi, path_lo, first, n = (w.field(c).to_numpy(zero_copy_only=False) for c in (*_BY_PATH, "first", "n"))
                twice, n = w.field("twice").to_numpy(zero_copy_only=False), n.astype(np.int64)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(first, n) + place
                of = np.repeat(np.arange(len(n)), n)
                for i in range(0, len(at), PART):
                    part = slice(i, i + PART)
                    edge = _hashes(joined, starts[at[part]].tolist(), ends[at[part] + WINDOW - 1].tolist())
                    cols = [path_hi[of[part]], path_lo[of[part]], twice[of[part]], place[part].astype(np.int8), *edge]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=out)

    return sources.mapInArrow(run, schema)


def _verify(joined: bytes, starts: np.ndarray, ends: np.ndarray, runs: list[dict]) -> None:
    """The words at a run's coordinates are those of the path that it stands for."""
    for r in runs:
        last = r["first"] + r["n"] + WINDOW - 2
        if last >= len(ends) or xxhash.xxh3_128_intdigest(joined[starts[r["first"]] : ends[last]]) != (r["path_hi"] % 2**64) << 64 | r["path_lo"] % 2**64:
            raise ValueError("the words at the coordinates of a repeated span are not those that were counted")


def covered(n_words: int, runs: list[dict] | None) -> np.ndarray:
    """True for each word that a repeated window covers."""
    edge = np.zeros(n_words + 1, np.int32)
    for r in runs or ():
        if r["places"] == -1:
            edge[r["first"]] += 1
            edge[r["first"] + r["n"] + WINDOW - 1] -= 1
        else:
            for place in range(r["n"]):
                if r["places"] >> place & 1:
                    edge[r["first"] + place] += 1
                    edge[r["first"] + place + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def _cut(text: str | None, runs: list[dict] | None) -> tuple[int, list[bytes]]:
    """How many words the text has, and those that stay."""
    words = (text or "").encode().split()
    if not runs:
        return len(words), words
    _verify(*_words(text), runs)
    return len(words), [w for w, gone in zip(words, covered(len(words), runs).tolist()) if not gone]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by single spaces); one row for a row.

    A null text has no words; a text of fewer than WINDOW words loses none. Rows with equal id and text repeat each other and
    lose what a window covers, like any other copies; so do rows without an id, each by its own text. Null ids pass through. A very long text is
    looked at in parts, with the same result. Other columns are not read. An empty table gives an empty one.
    """
    keyed = C.texts(docs, id_col, text_col, *_keys(id_col, text_col))
    joined = keyed.join(repeated_spans(docs, id_col, text_col), _BY_TEXT, "left").select("doc_id", "text", "runs")

    def run(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
            n, left = _cut(text, runs)
            yield doc_id, n, n - len(left), b" ".join(left).decode()

    return C.arrow_map(joined, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept string", rows=256)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with the covered words gone from the texts that have any (their other words joined by single
    spaces); ``n_chars``, where there is such a column, is that of the new text."""
    spans = repeated_spans(docs, id_col, text_col)
    whole = docs.select(F.struct(*docs.columns).alias("row"), *_keys(id_col, text_col)).join(spans, _BY_TEXT, "left")
    joined = whole.select("row.*", F.col("runs").alias(C.fresh(docs, "runs")))
    at = docs.columns.index(text_col)
    n_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.sliced(batches):
            cols = b.columns[:-1]
            new, sizes = [], []
            for text, runs in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if runs:
                    text = b" ".join(_cut(text, runs)[1]).decode()
                new.append(text)
                sizes.append(len(text) if runs else None)
            cols[at] = pa.array(new, cols[at].type)
            if n_chars is not None:
                cols[n_chars] = pa.array([old if s is None else s for s, old in zip(sizes, cols[n_chars].to_pylist())], cols[n_chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    d = deduplicate(C.table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
