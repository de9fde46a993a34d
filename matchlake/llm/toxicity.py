"""Toxicity by maximum-scoring segments.

*Model.*  A token's score is the log-odds of its rate in toxic against clean
labelled text.  Counts have informative Dirichlet priors in two steps: a
token's prior comes from the tokens that begin with the same letters, whose
own prior is the overall rate.  Tokens and beginnings are hashed into tables
of fixed size, so the model has the same size for any corpus.

*Segments.*  Scores less a small drift are summed over the text; a linear scan
finds all maximal segments, each of a positive sum that no extension or part
exceeds.

*Calibration.*  The largest segment of clean text of n tokens follows an
extreme-value (Gumbel) law of location log(K n) / lambda.  lambda and K are
fitted to clean labelled texts.  Segments above the location are significant;
a text's evidence is the sum of their excesses, and a logistic curve fitted to
labelled texts turns it into a score.  Labelled texts are scored with their own
counts taken out, so that the fit is not flattered.

Defined cases: null and empty texts and texts without letters have no
evidence and get the curve's value at 0; labels other than 0 and 1 and null
doc_ids are not learnt from; documents labelled twice count twice; without
both labels in the training rows all scores are the share of toxic rows (0.0
without rows).  Texts are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.llm.kernels import _BYTE_STREAM, ALNUM, flat, mix, slices, tidy
from matchlake.llm.tables import bounded

TOKENS, STARTS = 1 << 20, 1 << 18
#: Bytes of a token's beginning; pseudo-counts of the two priors; drift per token.
START, ALPHA, BETA, DRIFT = 4, 2.0, 3.0, 3.0
#: At most so many labelled rows, by the hash of doc_id, fit the calibration (the counts use all rows).
CALIBRATION_ROWS = 40_000
_U = np.uint64


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token buckets, beginning buckets and each text's token range; digits-only tokens count as any other."""
    h, off, first, last = ALNUM.hashes(data, at, spans=True)
    token = (h & _U(TOKENS - 1)).astype(np.int64)
    start = np.zeros(len(h), np.uint64)
    for j in range(START):
        inside = first + j < last
        start[inside] += ALNUM.value[data[first[inside] + j]] * _BYTE_STREAM[j]
    return token, (mix(start) & _U(STARTS - 1)).astype(np.int64) + TOKENS, off


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [a, b) with their sums, in linear time.

    Neighbours of one sign are merged first, which changes no segment.
    """
    if not len(score):
        return []
    sign = score > 0
    cut = np.flatnonzero(np.append(True, sign[1:] != sign[:-1]))
    sums = np.add.reduceat(score, cut).tolist()
    ends = np.append(cut[1:], len(score)).tolist()
    open_: list[list] = []  # begin, end, total before, total at the end, link to the last one with a smaller total before
    total = 0.0
    for begin, end, s in zip(cut.tolist(), ends, sums, strict=True):
        before, total = total, total + s
        if s <= 0:
            continue
        begin_, low = begin, before
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= low:
                j = open_[j][4]
            if j < 0 or open_[j][3] >= total:
                open_.append([begin_, end, low, total, j])
                break
            begin_, low = open_[j][0], open_[j][2]
            del open_[j:]
    return [(a, b, t - low) for a, b, low, t, _ in open_]


@dataclass
class Model:
    """Log-odds tables and calibration; its size does not depend on the corpus."""

    toxic: np.ndarray
    clean: np.ndarray
    rows: tuple[int, int]
    decay: float = 1.0
    location: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self):
        self.totals = max(1.0, self.toxic[:TOKENS].sum()), max(1.0, self.clean[:TOKENS].sum())

    def odds(self, token, start, own=None) -> np.ndarray:
        """Log-odds of token occurrences. own: (toxic, clean, toxic of the beginning, clean of it) counts to leave out."""
        n1, n0 = self.totals
        g1, g0, c1, c0 = self.toxic[start], self.clean[start], self.toxic[token], self.clean[token]
        if own is not None:
            c1, c0, g1, g0 = c1 - own[0], c0 - own[1], g1 - own[2], g0 - own[3]
        share = n1 / (n1 + n0)
        p = (g1 + BETA * share) / (g1 + g0 + BETA)
        return np.log((c1 + ALPHA * p) / n1) - np.log((c0 + ALPHA * (1 - p)) / n0)

    def usable(self) -> bool:
        return min(self.rows) > 0

    def evidence(self, odds: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """Summed excess of the significant segments, and these segments."""
        s = odds - DRIFT
        found = segments(s) if len(s) and s.max() > 0 else []
        bar = self.location + math.log(max(1, len(s))) / self.decay
        kept = [x for x in found if x[2] > bar]
        return math.log1p(sum((x[2] - bar) * self.decay for x in kept)), kept

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if not self.usable():
            return np.full(len(evidence), self.rows[1] / max(1, sum(self.rows)))
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(evidence) + self.offset, -500, 500)))


def _counted(rows: DataFrame, label: str, text: str) -> DataFrame:
    schema = "bucket long, toxic long, clean long"

    def run(batches):
        n = TOKENS + STARTS
        for b in batches:
            data, texts = flat(b.column(text))
            labels = b.column(label).to_numpy(zero_copy_only=False).astype(np.int64)
            both = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
            for lo, hi in slices(texts):
                token, start, off = tokens(data, texts[lo : hi + 1])
                y = np.repeat(labels[lo:hi], np.diff(off))
                for k, v in enumerate((1, 0)):
                    both[k] += np.bincount(token[y == v], minlength=n) + np.bincount(start[y == v], minlength=n)
            at = np.flatnonzero(both[0] + both[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[0][at]), pa.array(both[1][at])], names=["bucket", "toxic", "clean"])

    counts = rows.select(label, text).mapInArrow(tidy(run), schema)
    return counts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _left_out(model: Model, rows: DataFrame, label: str, text: str) -> np.ndarray:
    """(label, tokens, segments' sums) of labelled texts without their own counts."""

    def run(batches):
        m = shared.value
        for b in batches:
            data, texts = flat(b.column(text))
            labels = b.column(label).to_pylist()
            ys, sizes, sums = [], [], []
            each = ((token, start, y, a, z) for lo, hi in slices(texts) for token, start, off in [tokens(data, texts[lo : hi + 1])] for y, a, z in zip(labels[lo:hi], off[:-1].tolist(), off[1:].tolist(), strict=True))
            for token, start, y, a, z in each:
                t, g = token[a:z], start[a:z]
                if len(t):
                    ut, it, ct = np.unique(t, return_inverse=True, return_counts=True)
                    ug, ig, cg = np.unique(g, return_inverse=True, return_counts=True)
                    own = (ct[it] * y, ct[it] * (1 - y), cg[ig] * y, cg[ig] * (1 - y))
                    s = m.odds(t, g, own) - DRIFT
                    parts = [x[2] for x in segments(s)] if s.max() > 0 else []
                else:
                    parts = []
                ys.append(y)
                sizes.append(z - a)
                sums.append(parts)
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=["label", "n", "sums"])

    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rows.select(label, text).mapInArrow(tidy(run), "label int, n long, sums array<double>").toArrow().to_pandas()


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", key: str = "doc_id", text: str = "text", calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Learns from the documents that have a label and satisfy `train`, a condition on the key.

    Counts cover all such rows; the calibration uses at most calibration_rows of them, the smallest by key hash.
    """
    marked = labels.where(F.col(label).isin(0, 1) & train).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(bounded(marked), "_key")
    found = _counted(rows, "_label", "_text").toArrow()
    toxic, clean = np.zeros(TOKENS + STARTS), np.zeros(TOKENS + STARTS)
    at = found.column("bucket").to_numpy()
    toxic[at], clean[at] = found.column("toxic").to_numpy(), found.column("clean").to_numpy()
    del found
    by = {r["_label"]: r["count"] for r in marked.groupBy("_label").count().collect()}
    model = Model(toxic, clean, (by.get(0, 0), by.get(1, 0)))
    if not model.usable():
        return model
    total = sum(by.values())
    if total > calibration_rows:
        chosen = marked.orderBy(F.xxhash64("_key"), "_key").limit(calibration_rows)
        rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(bounded(chosen), "_key")
    calibrate(model, _left_out(model, rows, "_label", "_text"))
    return model


def calibrate(model: Model, seen) -> None:
    """Fits the Gumbel law to clean texts and the logistic curve to all."""
    clean = seen[(seen["label"] == 0) & (seen["n"] > 0)]
    best = np.array([max(s, default=0.0) if len(s) else 0.0 for s in clean["sums"]])
    size = np.log(np.maximum(1, clean["n"].to_numpy()))
    if len(best) > 10 and best.max() > 0:
        decay = 1.0
        for _ in range(20):  # moments of the law of best - log(n) / decay
            spread = (best - size / decay).std()
            decay = min(4.0, max(0.25, math.pi / math.sqrt(6) / max(spread, 1e-6)))
        model.decay = decay
        model.location = float((best - size / decay).mean() - 0.5772156649 / decay)
    z = np.zeros(len(seen))
    for k, (n, sums) in enumerate(zip(seen["n"], seen["sums"], strict=True)):
        bar = model.location + math.log(max(1, n)) / model.decay
        z[k] = math.log1p(sum((s - bar) * model.decay for s in sums if s > bar))
    y = seen["label"].to_numpy().astype(float)
    w = np.zeros(2)
    x = np.column_stack((z, np.ones(len(z))))
    ridge = np.array([1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.offset = max(0.0, float(w[0])), float(w[1])


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", passages: bool = False, out: str = "toxic_score") -> DataFrame:
    """The columns `keep`, the score as `out` and, if asked for, the significant passages as (begin, end) token ranges with their sums."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    part = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("sum", T.DoubleType())])
    fields = [docs.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())]
    if passages:
        fields.append(T.StructField("passages", T.ArrayType(part)))
    names = [f.name for f in fields]
    arrow = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("sum", pa.float64())]))

    def run(batches):
        m = shared.value
        for b in batches:
            data, texts = flat(b.column(text))
            evidence, found = np.zeros(len(b)), []
            for lo, hi in slices(texts):
                token, start, off = tokens(data, texts[lo : hi + 1])
                odds = m.odds(token, start) if m.usable() else np.zeros(len(token))
                for k, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    evidence[lo + k], kept = m.evidence(odds[a:z])
                    if passages:
                        found.append([{"begin": x, "end": y, "sum": s} for x, y, s in kept])
            columns = [b.column(c) for c in keep] + [pa.array(m.probability(evidence))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(found, arrow)] if passages else []), names=names)

    read = docs.select(*dict.fromkeys([*keep, text]))
    return read.mapInArrow(tidy(run), T.StructType(fields))
