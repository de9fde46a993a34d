"""Quality classifier: naive Bayes log-count ratios under a linear hinge-loss model.

*Features* are indicators of n-grams: words, word pairs, word shapes (runs of
capitals, small letters, digits, other scripts, and each mark as it is) in
sequences of one to three, and whether a word repeats the one before it or
the one two before.  They are hashed into a table of fixed size.

*Scaling.*  An indicator counts log((a + p) / |p|) - log((a + q) / |q|), p and q
being the numbers of labelled texts of either class with the n-gram; all
labelled training rows are counted.  Texts are scaled to unit length.

*Fit.*  A linear hinge-loss model by dual coordinate descent, and a logistic
curve over its margins on rows it was not fitted to, use at most FIT_ROWS
labelled rows, those of the smallest key hash.

Defined cases: null and empty texts have no features and get the curve's value
at the bias; labels other than 0 and 1 and null ids are not learnt from;
without both labels all scores are the share of label 1 (0.0 without rows).
Texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.llm.kernels import LOWER, _PLACE, _STEP, flat, mix, slices, stream, tidy
from matchlake.llm.tables import bounded

BUCKETS, SMOOTH, FIT_ROWS, EPOCHS, COST = 1 << 18, 1.0, 20_000, 12, 1.0
GROUP = 1 << 20  # bytes per pass
_U = np.uint64
#: Shape of each byte: capital, small, digit, beyond ASCII, or itself.
_SHAPE = np.arange(256)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 128
_SHAPE_VALUE = stream(256, 11)


def features(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Distinct feature buckets of each text, in a fixed order."""
    out: list[np.ndarray] = []
    for lo, hi in slices(at, GROUP):
        word, off, first, last = LOWER.hashes(data, at[lo : hi + 1], spans=True)
        out += _features(data, word, first, last, off)
    return out


def _features(data, word, first, last, off) -> list[np.ndarray]:
    n = len(word)
    if not n:
        return [np.zeros(0, np.int32)] * (len(off) - 1)
    base = int(first[0])
    b = _SHAPE[data[base : last[-1]]]
    start, end = first - base, last - base
    new = np.append(True, b[1:] != b[:-1])
    new[start] = True
    run = np.cumsum(new) - 1
    inside = run - np.repeat(run[start], np.diff(np.append(start, len(b))))
    value = np.where(new, _SHAPE_VALUE[b] * _PLACE[inside & 4095], _U(0))
    total = np.append(_U(0), np.cumsum(value, dtype=np.uint64))
    shape = mix(total[end] - total[start])
    kinds = [(1, word, 20), (1, shape, 21)]
    if n > 1:
        kinds += [(2, word[:-1] * _STEP[1] + word[1:], 22), (2, shape[:-1] * _STEP[1] + shape[1:], 23), (2, (word[:-1] == word[1:]).astype(np.uint64), 24)]
    if n > 2:
        two = word[:-2] == word[2:]
        kinds += [(3, shape[:-2] * _STEP[2] + shape[1:-1] * _STEP[1] + shape[2:], 25), (3, two.astype(np.uint64), 26), (3, (two & (word[1:-1] == word[2:])).astype(np.uint64), 27)]
    buckets = [(k, (mix(h + _STEP[kind]) & _U(BUCKETS - 1)).astype(np.int32)) for k, h, kind in kinds]
    last, out = np.zeros(BUCKETS, np.int32), []
    for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        f = np.concatenate([np.zeros(0, np.int32), *(h[x : y - k + 1] for k, h in buckets if y - x >= k)])
        place = np.arange(len(f), dtype=np.int32)
        last[f] = place
        out.append(f[last[f] == place])
    return out


@dataclass
class Model:
    weight: np.ndarray  # of each bucket, log-count ratio included
    ratio: np.ndarray
    bias: float
    rows: tuple[int, int]
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, f: np.ndarray) -> float:
        if not len(f):
            return self.bias
        r = self.ratio[f]
        return float(self.weight[f].sum() / max(1e-12, np.sqrt((r * r).sum()))) + self.bias

    def probability(self, margins: np.ndarray) -> np.ndarray:
        if min(self.rows) == 0:
            return np.full(len(margins), self.rows[1] / max(1, sum(self.rows)))
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(margins) + self.offset, -500, 500)))


def descend(xs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Hinge-loss weights by dual coordinate descent over sparse rows (buckets, values) with a bias of 1."""
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(xs))
    square = np.array([(v * v).sum() + 1.0 for _, v in xs])
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        worst = 0.0
        for k in rng.permutation(len(xs)):
            f, v = xs[k]
            g = y[k] * (w[f] @ v + bias) - 1
            old = alpha[k]
            new = min(max(old - g / square[k], 0.0), cost)
            if new != old:
                step = (new - old) * y[k]
                w[f] += step * v
                bias += step
                alpha[k] = new
                worst = max(worst, abs(new - old))
        if worst < 1e-3:
            break
    return w, bias


def logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a light ridge."""
    x, w = np.column_stack((z, np.ones(len(z)))), np.zeros(2)
    ridge = np.array([1e-3, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Learns from the documents that have a label and satisfy `train`, a condition on the key."""
    marked = labels.where(F.col(label).isin(0, 1) & train).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def count(batches):
        for b in batches:
            y = b.column("_label").to_numpy(zero_copy_only=False)
            fs = features(*flat(b.column("_text")))
            both = [np.bincount(np.concatenate([np.zeros(0, np.int32), *(f for f, v in zip(fs, y, strict=True) if v == k)]), minlength=BUCKETS) for k in (1, 0)]
            at = np.flatnonzero(both[0] + both[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[0][at]), pa.array(both[1][at])], names=["bucket", "p", "q"])

    def listed(batches):
        for b in batches:
            fs = [f.astype(np.int32).tobytes() for f in features(*flat(b.column("_text")))]
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_label"), pa.array(fs, pa.binary())], names=["_key", "label", "f"])

    rows = texts.join(bounded(marked), "_key")
    found = rows.select("_label", "_text").mapInArrow(tidy(count), "bucket long, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).toArrow()
    p, q = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = found.column("bucket").to_numpy()
    p[at], q[at] = found.column("p").to_numpy(), found.column("q").to_numpy()
    by = {r["_label"]: r["count"] for r in marked.groupBy("_label").count().collect()}
    ratio = np.log((SMOOTH + p) / (SMOOTH + p).sum()) - np.log((SMOOTH + q) / (SMOOTH + q).sum())
    model = Model(np.zeros(BUCKETS), ratio, 0.0, (by.get(0, 0), by.get(1, 0)))
    if min(model.rows) == 0:
        return model
    if sum(by.values()) > fit_rows:
        chosen = marked.orderBy(F.xxhash64("_key"), "_key").limit(fit_rows)
        rows = texts.join(bounded(chosen), "_key")
    kind = docs.schema[key].dataType
    seen = rows.select("_key", "_label", "_text").mapInArrow(tidy(listed), T.StructType([T.StructField("_key", kind), T.StructField("label", T.IntegerType()), T.StructField("f", T.BinaryType())])).toArrow().to_pandas()
    seen = seen.sort_values("_key", kind="stable")  # the same order on any cluster
    xs, y = [], np.where(seen["label"].to_numpy() == 1, 1.0, -1.0)
    for raw, v in zip(seen["f"], y, strict=True):
        f = np.frombuffer(raw, np.int32)
        own = np.log((SMOOTH + p[f] - (v > 0)) / (SMOOTH + p).sum()) - np.log((SMOOTH + q[f] - (v < 0)) / (SMOOTH + q).sum())  # without the row itself
        xs.append((f, own / max(1e-12, np.sqrt((own * own).sum()))))
    part = np.arange(len(xs)) % 5
    fitting, test = np.flatnonzero(part != 0), np.flatnonzero(part == 0)
    w, model.bias = descend([xs[k] for k in fitting], y[fitting])
    if len(set(y[test])) == 2:
        z = np.array([w[f] @ v + model.bias for f, v in (xs[k] for k in test)])
        model.slope, model.offset = logistic(z, (y[test] > 0).astype(float))
    model.weight = w * ratio
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and quality_score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("quality_score", T.DoubleType())])

    def run(batches):
        m = shared.value
        for b in batches:
            z = np.array([m.margin(f) for f in features(*flat(b.column(text)))])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(m.probability(z))], names=[f.name for f in schema.fields])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(tidy(run), schema)
