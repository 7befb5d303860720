"""Quality by a sparse rule ensemble.

Statistics of the text, one pass over its bytes, are the only inputs. Shallow trees grown on random subsamples of labelled rows give rules: each
path from a root to a node is a conjunction of comparisons. Rules and the (winsorised) statistics are the columns of a logistic
regression with an L1 penalty, which leaves few of them with a weight; of the PENALTIES the largest is taken that cross-validation can't tell from the best.
The ensemble that remains is compiled to one Spark column expression over the statistics, a balanced sum, so scoring is plain projection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zlib
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _common as C

#: Bounds of the labelled sample: rows of each class.
MOST_GOOD, MOST_BAD = 6000, 4000
TREES, DEPTH, LEAST_LEAF = 60, 3, 8
#: L1 penalties to choose from, strongest first, by so many folds.
PENALTIES, FOLDS = (0.07, 0.05, 0.035, 0.025, 0.017, 0.012, 0.008, 0.005, 0.003, 0.002), 5
#: predicted is 1 from here on.
CUT = 0.7

STATISTICS = (
    "n_bytes", "n_words", "word_mean", "word_max", "letters", "upper", "digits", "spaces", "symbols", "marks", "other_bytes",
    "distinct_words", "distinct_pairs", "top_word", "same_next", "line_repeats", "n_lines", "line_mean", "ended_lines", "short_words", "capital_words", "packed",
)

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 mark of prose, 6 symbol, 7 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 5
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6


def statistics_of(text: str | None) -> tuple[float, ...]:
    """The STATISTICS of one text; all 0 where there is no word."""
    raw = (text or "").encode()
    words = raw.split()
    n, k = len(raw), len(words)
    if not k:
        return (float(n), *[0.0] * (len(STATISTICS) - 1))
    of = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / n
    keys = np.fromiter(map(hash, words), np.int64, k)
    lengths = np.fromiter(map(len, words), np.int64, k)
    _, counts = np.unique(keys, return_counts=True)
    with np.errstate(over="ignore"):
        pairs = keys[:-1] * np.int64(1_000_003) + keys[1:]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    first = np.fromiter((w[0] for w in words), np.uint8, k)
    # how far the whole text packs; blocks of equal size keep it comparable between short and long texts
    blocks = [raw[i : i + 4096] for i in range(0, n, 4096)]
    packed = sum(len(zlib.compress(b, 1)) for b in blocks) / n
    return (
        float(n), float(k), float(lengths.mean()), float(lengths.max()), float(of[1] + of[2]), float(of[2]), float(of[3]), float(of[4]), float(of[6]), float(of[5]), float(of[0] + of[7]),
        len(counts) / k, (len(np.unique(pairs)) / (k - 1)) if k > 1 else 1.0, float(counts.max()) / k, float((keys[1:] == keys[:-1]).mean()) if k > 1 else 0.0,
        1 - len(set(lines)) / len(lines), float(len(lines)), n / len(lines), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), float((lengths <= 3).mean()), float(((first >= 65) & (first <= 90)).mean()), packed,
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the STATISTICS (doubles); one row for a row, repeated rows too, no shuffle. A null text counts as empty; a very long one is looked at
    whole. Other columns, whatever their names, are not read."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATISTICS)
    out = C.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.sliced(batches):
            rows = np.array([statistics_of(t) for t in b.column(1).to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, i]) for i in range(len(STATISTICS)))], schema=out)

    return C.texts(docs, id_col, text_col).mapInArrow(run, schema)


#: A rule: (statistic, is above, threshold), all of which hold.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Ensemble:
    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    linear: list[tuple[int, float, float, float]] = field(default_factory=list)  # statistic, low, high (winsorised there), weight

    def expression(self, column=F.col) -> Column:
        """The score as a Spark expression over the statistics."""
        terms = [F.lit(self.bias)]
        for rule, w in self.rules:
            holds = reduce(lambda a, b: a & b, [column(STATISTICS[s]) > t if above else column(STATISTICS[s]) <= t for s, above, t in rule])
            terms.append(F.when(holds, F.lit(w)).otherwise(F.lit(0.0)))
        for s, low, high, w in self.linear:
            terms.append(F.least(F.greatest(column(STATISTICS[s]), F.lit(low)), F.lit(high)) * F.lit(w))
        while len(terms) > 1:  # a balanced tree: its depth is the logarithm of the number of rules
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        return 1 / (1 + F.exp(-terms[0]))

    def evaluate(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in self.rules:
            z += w * holds(rule, x)
        for s, low, high, w in self.linear:
            z += w * np.clip(x[:, s], low, high)
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, s] > t) if above else (x[:, s] <= t) for s, above, t in rule])


def _paths(x: np.ndarray, y: np.ndarray, rows: np.ndarray, rng, path: Rule, out: list[Rule]) -> None:
    """Grow one node by the split with the largest gain of squared error, among a random half of the statistics, and note both paths."""
    if len(path) == DEPTH or len(rows) < 2 * LEAST_LEAF or y[rows].std() < 1e-9:
        return
    best = (1e-9, None)
    for s in rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]:
        order = rows[np.argsort(x[rows, s], kind="stable")]
        v, left = x[order, s], np.cumsum(y[order])
        k = np.arange(1, len(order))
        ok = (v[1:] > v[:-1]) & (k >= LEAST_LEAF) & (len(order) - k >= LEAST_LEAF)
        if ok.any():
            gain = np.where(ok, left[:-1] ** 2 / k + (left[-1] - left[:-1]) ** 2 / (len(order) - k) - left[-1] ** 2 / len(order), -1)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (int(s), float((v[at] + v[at + 1]) / 2)))
    if best[1] is None:
        return
    s, t = best[1]
    for above in (False, True):
        longer = (*path, (s, above, t))
        out.append(longer)
        _paths(x, y, rows[(x[rows, s] > t) == above], rng, longer, out)


def _lasso(a: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, start: tuple[float, np.ndarray] | None = None, rounds: int = 250) -> tuple[float, np.ndarray]:
    """Weighted logistic loss with an L1 penalty by accelerated proximal steps; columns are scaled already."""
    n = len(y)
    b, w = start or (0.0, np.zeros(a.shape[1]))
    v, c, t = w, b, 1.0
    root, u = np.sqrt(weight / n), np.ones(a.shape[1])
    for _ in range(12):  # the largest singular value by power iteration; the constant column adds at most the sum of the weights
        u = a.T @ (root**2 * (a @ u))
        u /= max(1e-30, np.linalg.norm(u))
    step = 4 / max(1e-9, 1.2 * np.linalg.norm(root * (a @ u)) ** 2 + weight.mean())
    for _ in range(rounds):
        g = weight * (1 / (1 + np.exp(-np.clip(a @ v + c, -30, 30))) - y) / n
        w2 = v - step * (a.T @ g)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2, t2 = c - step * g.sum(), (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w


def _wrong_pairs(score: np.ndarray, y: np.ndarray) -> float:
    """Of the pairs of a good and a bad row, the share in which the bad one scores higher; equal scores count half."""
    good, bad = np.sort(score[y == 1]), score[y == 0]
    if not len(good) or not len(bad):
        return float("nan")
    return float((np.searchsorted(good, bad, "left") + np.searchsorted(good, bad, "right")).mean() / (2 * len(good)))


def _chosen_penalty(a: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int) -> float:
    """The strongest penalty whose cross-validated share of wrongly ordered pairs is within one standard error of the least. (Where rules part the classes
    well, a loss would go on falling with the penalty, as weights grow.)"""
    fold = np.random.default_rng(seed).permutation(len(y)) % FOLDS
    losses = np.full((len(PENALTIES), FOLDS), np.nan)
    for f in range(FOLDS):
        inside, outside = fold != f, fold == f
        if not outside.any() or y[inside].min() == y[inside].max():
            continue
        fit = None
        for i, penalty in enumerate(PENALTIES):  # each starts from the one before
            fit = _lasso(a[inside], y[inside], weight[inside], penalty, fit, 60)
            losses[i, f] = _wrong_pairs(a[outside] @ fit[1], y[outside])
    kept = losses[:, ~np.isnan(losses).any(axis=0)]
    if kept.shape[1] < 2:
        return PENALTIES[-1]
    mean = kept.mean(axis=1)
    best = int(mean.argmin())
    return PENALTIES[int(np.flatnonzero(mean <= mean[best] + kept[best].std(ddof=1) / kept.shape[1] ** 0.5)[0])]


def train(x: np.ndarray, y: np.ndarray, penalty: float | None = None, seed: int = 7) -> Ensemble:
    """From statistics and 0/1 labels; without a ``penalty``, one is chosen. Classes weigh alike; the bias is then moved so that CUT is the best cut between
    them. Of rules that hold for the same rows the shortest is a column. No rows give score 0.5, rows of one class the score of that class."""
    if len(y) == 0 or y.min() == y.max():
        return Ensemble(bias=0.0 if not len(y) else (30.0 if y.max() else -30.0))
    rng, found = np.random.default_rng(seed), []
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    draw = np.where(y == 1, 1 / y.sum(), 1 / (1 - y).sum()) / 2
    for _ in range(TREES):
        rows = rng.choice(len(y), size=min(len(y), max(50, min(1000, len(y) // 2))), replace=True, p=draw / draw.sum())
        _paths(x, y.astype(float) - 0.5, rows, rng, (), found)
    by_rows: dict[bytes, Rule] = {}
    for q in sorted(dict.fromkeys(found), key=len):
        h = holds(q, x)
        if 0.01 < h.mean() < 0.99:
            by_rows.setdefault(h.tobytes(), q)
    rules = list(by_rows.values())
    low, high = np.quantile(x, [0.025, 0.975], axis=0)
    used = [s for s in range(x.shape[1]) if high[s] > low[s]]
    r = np.array([holds(q, x) for q in rules], float).T.reshape(len(y), len(rules))
    z = np.clip(x[:, used], low[used], high[used])
    scale = np.r_[np.maximum(r.std(0), 0.05), z.std(0) / 0.4 + 1e-12]
    a = np.c_[r, z]
    middle = a.mean(0)
    a = (a - middle) / scale
    b, w = _lasso(a, y.astype(float), weight, penalty or _chosen_penalty(a, y.astype(float), weight, seed))
    w = w / scale
    b -= float(middle @ w)
    kept = [(q, float(v)) for q, v in zip(rules, w[: len(rules)]) if v]
    linear = [(s, float(low[s]), float(high[s]), float(v)) for s, v in zip(used, w[len(rules) :]) if v]
    model = Ensemble(float(b), kept, linear)
    p = model.evaluate(x)
    s = np.log(np.maximum(p, 1e-300) / np.maximum(1 - p, 1e-300))
    order = np.argsort(s, kind="stable")
    # cost of cutting before the i-th: good rows below it and bad rows from it on, each as a share of its class
    cost = np.r_[0, np.cumsum(y[order])] / y.sum() + 1 - np.r_[0, np.cumsum(1 - y[order])] / (1 - y).sum()
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = int(best[len(best) // 2])
    cut = (s[order][max(0, k - 1)] + s[order][min(len(s) - 1, k)]) / 2
    model.bias += float(np.log(CUT / (1 - CUT)) - cut)
    return model


def training_rows(stats: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The bounded sample: labelled ids outside the held-out fold, the least hashes of their ids first in each class, a row for each.

    Ids are chosen from ``labels`` alone and only they, a proven bound, are broadcast. An id with both labels counts as not good; of several rows
    of an id the one with the least statistics counts. Other columns are not read.
    """
    known = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (C.crc_mod("doc_id", 4) != 2))
    known = known.groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("quality = 1").orderBy(*order).limit(MOST_GOOD).unionByName(known.where("quality = 0").orderBy(*order).limit(MOST_BAD))
    met = stats.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*STATISTICS)).alias("row"))
    found = met.select("doc_id", "row.*", "quality").toPandas()
    found["h"] = [xxhash.xxh64_intdigest(str(i)) for i in found["doc_id"]]
    found = found.sort_values(["h", "doc_id"])
    return found[list(STATISTICS)].to_numpy(float), found["quality"].to_numpy(int)


def score(stats: DataFrame, model: Ensemble) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from CUT on, a score of just CUT included); one row for a row of ``statistics``, repeated rows too.

    Null ids count as the empty text for the fold. An empty table gives an empty one."""
    scored = stats.select("doc_id", model.expression().alias("score"))
    return scored.select("doc_id", (C.crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    stats = C.stored(statistics(C.table(spark, sf_dir, "documents")), "quality-statistics")
    return score(stats, train(*training_rows(stats, C.table(spark, sf_dir, "labels"))))
