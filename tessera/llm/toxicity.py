"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. Their common part is trained (COVER) on windows of both; behind it
stand the segments that tell the classes apart: heads of words whose document frequencies differ by at least LEAST_Z standard errors,
near copies among the training texts counted once. A window of a text that compresses shorter with the toxic dictionary than
with the ordinary one is nearer to toxic text. A document's score is a logistic function of the differences over all its windows, with
weights and threshold calibrated on training rows that the dictionaries behind the features were not trained on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _common as C

#: Bounds of the labelled sample, for training only: ids of each class, and characters of a text that training looks at.
MOST_TOXIC, MOST_ORDINARY, LONGEST = 2500, 5000, 10_000
#: Bounds of what the dictionaries' common part is trained on: texts of each class, and each how manieth of their windows.
COMMON_ORDINARY, COMMON_TOXIC, COMMON_EVERY = 1000, 300, 3
#: Words in a window, for each of the passes over a text; a pass steps by one word less.
WINDOWS, LEVEL = (8, 11), 6
FOLDS = 5
AT_LEAST = (1, 2, 3, 4, 5, 6, 8)
#: Words in a window that the common part is trained on.
SAMPLE = 20
COMMON_BYTES = 2500
#: A head stands out from this many standard errors on; at most so many of a class are kept, which keeps a dictionary within zstandard's short offsets.
LEAST_Z, MOST_SEGMENTS = 5.5, 200
#: The head of a word that may be a segment: the space before it and so many bytes in all.
HEADS = range(5, 12)
_TWICE = b"\0"
_EDGES = b".,;:!?#$%&*|()\"'"


def windows(text: str | None, size: int = WINDOWS[0]) -> list[bytes]:
    """Overlapping by a word; lower-cased; at least one."""
    words = (text or "").lower().encode().split()
    step = size - 1
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, max(1, len(words) - size + step), step)]


def _heads(text: str) -> set[bytes]:
    """The heads of the text's words; those that two different words or more have, also with _TWICE behind them."""
    n = Counter()
    for w in {w.strip(_EDGES) for w in text.lower().encode().split()}:
        w = b" " + w + b" "
        n.update(w[:k] for k in HEADS if k <= len(w))
    return {*n, *(h + _TWICE for h, k in n.items() if k > 1)}


def _without_copies(texts: list[str]) -> list[str]:
    """One of each group of near copies: texts that agree in three of six min-hashes of their longer words."""
    seen: set[tuple] = set()
    out = []
    for t in texts:
        words = [w for w in set(t.lower().encode().split()) if len(w) >= 6]
        if words:
            low = [min(xxhash.xxh64_intdigest(w, k) for w in words) for k in range(6)]
            marks = [(k, *(low[i] for i in k)) for k in combinations(range(6), 3)]
        else:
            marks = [t]
        if not any(m in seen for m in marks):
            out.append(t)
        seen.update(marks)
    return out


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] = field(default_factory=list)  # empty: no toxic example was given, every score is 0

    def scorer(self):
        if not self.weights:
            return lambda text: 0.0
        a, b = (_compressor(d) for d in (self.ordinary, self.toxic))
        w = np.array(self.weights)

        def score(text: str | None) -> float:
            return float(1 / (1 + np.exp(-np.clip(_features(text, a, b) @ w, -30, 30))))

        return score


def _compressor(content: bytes):
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)


def _features(text: str | None, ordinary, toxic) -> np.ndarray:
    """1, and for each window size, of the windows' length differences: mean, mean of the top three, largest, how many reach each of AT_LEAST (as
    shares and as logarithms of counts), and the number of windows."""
    a, b, out = ordinary.compress, toxic.compress, [np.ones(1)]
    for size in WINDOWS:
        d = np.array([len(a(w)) - len(b(w)) for w in windows(text, size)], float)
        top, n = np.sort(d)[::-1], len(d)
        reach = (d >= np.array(AT_LEAST)[:, None]).sum(axis=1)
        out.append(np.r_[d.mean(), top[:3].mean(), top[0], n**-0.5, d.mean() * n**-0.5, reach / n, np.log1p(reach), np.log(n)])
    return np.concatenate(out)


def _contrast(a: Counter, m: int, b: Counter, n: int) -> list[bytes]:
    """Heads that stand out in the class of m texts whose document counts are ``a``, against n texts with ``b``; most telling last (a dictionary's
    end is its cheapest part); none contains another."""

    def z(h: bytes) -> float:
        p = (a[h] + b[h]) / (m + n)
        return (a[h] / m - b[h] / n) / max(1e-9, (p * (1 - p) * (1 / m + 1 / n)) ** 0.5)

    found = [(z(h), h) for h, k in a.items() if k >= 3 and b[h] * m <= 0.3 * k * n]
    kept: list[bytes] = []
    for s, h in sorted(found, key=lambda x: (-round(x[0], 1), -len(x[1]), x[1])):
        if s < LEAST_Z or len(kept) >= MOST_SEGMENTS:
            break
        h = h.removesuffix(_TWICE)
        if not any(h in k or k in h for k in kept):
            kept.append(h)
    return kept[::-1]


@dataclass
class _Counts:
    """Document counts, fold by fold, of the heads that three texts of a class have at least; the fold of a text is its place modulo FOLDS."""

    one: list[str]
    other: list[str]

    def __post_init__(self) -> None:
        self.wanted = {h for h, k in Counter(h for t in self.one for h in _heads(t)).items() if k >= 3}
        self.a, self.b = self._by_fold(self.one), self._by_fold(self.other)

    def _by_fold(self, texts: list[str]) -> list[Counter]:
        out = [Counter() for _ in range(FOLDS)]
        for i, t in enumerate(texts):
            out[i % FOLDS].update(_heads(t) & self.wanted)
        return out

    def contrast(self, without: int | None) -> list[bytes]:
        keep = [f for f in range(FOLDS) if f != without]
        a, b = (sum((c[f] for f in keep), Counter()) for c in (self.a, self.b))
        m, n = (sum(len(x[f::FOLDS]) for f in keep) for x in (self.one, self.other))
        return _contrast(a, m, b, n) if m and n else []


def train(rows: list[tuple[str, int]], stands_for: float = 1.0) -> Model:
    """From (text, label) rows, in which an ordinary row stands for so many. The weights are fitted to features of rows that the
    dictionaries behind them have not seen, by FOLDS rounds of leaving a part of each class out; the dictionaries that are kept are trained on all.

    The ordinary segments are looked for in as many ordinary texts as there are toxic ones, so that LEAST_Z means the same on both sides."""
    toxic, ordinary = (_without_copies([t for t, y in rows if bool(y) is label]) for label in (True, False))
    if len(toxic) < 2 or len(ordinary) < 2:
        return Model()
    there, back = _Counts(toxic, ordinary), _Counts(ordinary[: len(toxic)], toxic)

    def dictionaries(without: int | None) -> Model:
        some = [[t for i, t in enumerate(x) if i % FOLDS != without][:most] for x, most in ((ordinary, COMMON_ORDINARY), (toxic, COMMON_TOXIC))]
        samples = [w for x in some for t in x for w in windows(t, SAMPLE)][::COMMON_EVERY]
        try:
            common = zstandard.train_dictionary(COMMON_BYTES + 500, samples, k=32, d=6).as_bytes()[-COMMON_BYTES:]
        except zstandard.ZstdError:  # too little text to train on
            common = b"".join(samples)[:COMMON_BYTES]
        a, b = b"".join(there.contrast(without)), b"".join(back.contrast(without))
        size = max(len(a), len(b))
        return Model(common + a.rjust(size, b"\0"), common + b.rjust(size, b"\0"))

    x, y = [], []
    for fold in range(FOLDS):
        part = dictionaries(fold)
        a, b = _compressor(part.ordinary), _compressor(part.toxic)
        for label, texts in ((1, toxic[fold::FOLDS]), (0, ordinary[fold::FOLDS])):
            x += [_features(t, a, b) for t in texts]
            y += [label] * len(texts)
    model = dictionaries(None)
    model.weights = _logistic(np.array(x), np.array(y, float), stands_for).tolist()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, stands_for: float = 1.0, ridge: float = 1.0) -> np.ndarray:
    """Newton's method on standardised columns, moved so that 0.5 is the cut of least cost: a toxic text that is missed costs the fourth root of how
    many ordinary ones there are to it, an ordinary one that is taken for toxic costs 1."""
    mean, std = x[:, 1:].mean(0), np.maximum(x[:, 1:].std(0), 1e-9)
    z = np.c_[np.ones(len(x)), (x[:, 1:] - mean) / std]
    w, penalty = np.zeros(z.shape[1]), np.r_[0, np.full(z.shape[1] - 1, ridge)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    order = np.argsort(s)
    ys, m, n = y[order], y.sum(), (1 - y).sum() * stands_for
    cost = np.r_[0, np.cumsum(ys)] * (n / m) ** 0.25 + n - np.r_[0, np.cumsum(1 - ys)] * stands_for
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = int(best[len(best) // 2])
    cut = (s[order][max(0, k - 1)] + s[order][min(len(s) - 1, k)]) / 2
    w[0] -= cut
    return np.r_[w[0] - (w[1:] * mean / std).sum(), w[1:] / std]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[str, int]], float]:
    """The bounded sample, and how many rows an ordinary one in it stands for: labelled ids outside the held-out fold, the least hashes of their ids first in each
    class, a row for each.

    Ids are chosen from ``labels`` alone; only they (a proven bound) are broadcast, so the other texts are not shuffled. An id with both labels counts as
    toxic; of several rows of an id the one with the least text counts, null texts don't. Of a longer text training sees the first LONGEST characters.
    """
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (C.crc_mod("doc_id", 5) != 0))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(MOST_TOXIC).unionByName(known.where("toxic = 0").orderBy(*order).limit(MOST_ORDINARY))
    toxic, ordinary = known.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    rate = max(1.0, min(MOST_TOXIC, toxic or 0)) / max(1.0, toxic or 0)
    stands_for = max(1.0, (ordinary or 0) / MOST_ORDINARY) * rate
    texts = C.texts(docs, id_col, text_col).where(F.col("text").isNotNull()).withColumn("text", F.substring("text", 1, LONGEST))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas()
    found["h"] = [xxhash.xxh64_intdigest(str(i)) for i in found["doc_id"]]
    found = found.sort_values(["h", "doc_id"])
    return list(zip(found["text"], found["toxic"].astype(int))), stands_for


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on, a score of just 0.5 included); one row for a row, repeated rows too, no shuffle.

    A null text is scored as an empty one, a very long one whole; an empty table gives an empty one. Null and repeated ids pass through; a null id counts as the empty text for the fold. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in C.sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    scored = C.texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")
    return scored.select("doc_id", (C.crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below 0.5; no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in C.sliced(batches):
            yield b.filter(pa.array([of(t) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return score(docs, train(*training_rows(docs, C.table(spark, sf_dir, "labels"))))
