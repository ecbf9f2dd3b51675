"""Quality classification by positive-unlabelled learning.

A small network scores features of the whole text (shares of byte classes and of single signs, word
lengths, repetition of words and lines). It minimises the non-negative unbiased risk
prior * risk(positives as 1) + max(0, risk(unlabelled as 0) - prior * risk(positives as 0)), from
trusted positives (quality 1) and unlabelled web text (all else). The class prior is estimated from
the two alone by best-bin estimation, and scores are shifted so that their mean over unlabelled text is
the prior; labelled negatives play no part.

Training uses the whole texts of a bounded sample (PER_KIND rows and KIND_BYTES bytes of each of
positives and unlabelled; see common.draw).
Nulls: a null text is empty and has the features of an empty text; it is not learnt from. Without any
positive every score is 0. A very long text's features take some 60 times its bytes in one task's
memory. Repeated rows get equal results, each its own row; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, draw, joined, prefix_hash, released, slices, span_hash, texts, words
from .toxicity import logistic

PER_KIND = 3000
KIND_BYTES = 64 << 20
HIDDEN, STEPS, BATCH = 24, 1500, 256
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0\n\t "
_CLASS = np.zeros((256, 5 + len(_SIGNS)), np.float64)
_CLASS[97:123, 0] = _CLASS[65:91, 1] = _CLASS[48:58, 2] = _CLASS[128:, 3] = _CLASS[:32, 4] = 1
for _i, _c in enumerate(_SIGNS):
    _CLASS[_c, 5 + _i] = 1
N_FEATURES = _CLASS.shape[1] + 12


def features(parts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(parts), N_FEATURES))
    data, start, end = joined(parts, b"\n")
    prefix = prefix_hash(data)
    begin, stop = words(data, ~SPACE)
    code, size = span_hash(prefix, begin, stop), (stop - begin).astype(float)
    w0, w1 = np.searchsorted(begin, start), np.searchsorted(begin, end)
    breaks = np.flatnonzero(data == 10)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    for i, (a, b, x, y) in enumerate(zip(start.tolist(), end.tolist(), w0.tolist(), w1.tolist(), strict=True)):
        n = b - a
        if not n:
            continue
        out[i, : _CLASS.shape[1]] = np.bincount(data[a:b], minlength=256) @ _CLASS / n
        c, s = code[x:y], size[x:y]
        k = y - x
        lines = breaks[np.searchsorted(breaks, a) : np.searchsorted(breaks, b)]
        edges = np.concatenate([[a - 1], lines, [b]])
        line_code = span_hash(prefix, edges[:-1] + 1, edges[1:])
        rest = np.zeros(12)
        rest[0] = np.log1p(n) / 10
        rest[1] = len(np.unique(line_code)) / len(line_code)
        rest[2] = np.log1p(n / len(line_code)) / 10
        if k:
            many = np.unique(c, return_counts=True)[1]
            rest[3] = len(many) / k
            rest[4] = many.max() / k
            rest[5] = (c[1:] == c[:-1]).sum() / k
            rest[6] = s.mean() / 10
            rest[7] = min(s.std() / 10, 5)
            rest[8] = np.log1p(k) / 10
            rest[9] = (s <= 1).sum() / k
            rest[10] = len(many) / np.sqrt(k) / 10
            rest[11] = ((upper[stop[x:y]] - upper[begin[x:y]]) >= 2).sum() / k
        out[i, _CLASS.shape[1] :] = rest
    return out


class PuModel:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, layers: list[np.ndarray], calibration: np.ndarray, prior: float) -> None:
        self.mean, self.scale, self.layers, self.calibration, self.prior = mean, scale, layers, calibration, prior

    def raw(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum(np.clip((x - self.mean) / self.scale, -8, 8) @ a + b, 0) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) * self.calibration[0] + self.calibration[1], -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 9) -> PuModel:
    """Non-negative PU risk with the sigmoid loss, by Adam; a batch whose negative part falls below
    zero takes a step back on that part instead."""
    rng = np.random.default_rng(seed)
    everything = np.concatenate([positive, unlabelled])
    mean, scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
    p, u = np.clip((positive - mean) / scale, -8, 8), np.clip((unlabelled - mean) / scale, -8, 8)
    par = [rng.normal(0, 0.2, (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(())]
    one, two = [np.zeros_like(q) for q in par], [np.zeros_like(q) for q in par]
    for step in range(1, STEPS + 1):
        x = np.concatenate([p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]])
        a, b, c, d = par
        h = np.maximum(x @ a + b, 0)
        g = 1 / (1 + np.exp(-np.clip(h @ c + d, -30, 30)))  # loss as negative: g; as positive: 1 - g
        slope = g * (1 - g) / BATCH
        negative = g[BATCH:].mean() - prior * g[:BATCH].mean()
        back = np.zeros(len(x))
        if negative >= 0:
            back[:BATCH] = -2 * prior * slope[:BATCH]
            back[BATCH:] = slope[BATCH:]
        else:
            back[:BATCH] = prior * slope[:BATCH]
            back[BATCH:] = -slope[BATCH:]
        inner = np.outer(back, c) * (h > 0)
        for i, grad in enumerate((x.T @ inner + 1e-4 * a, inner.sum(axis=0), h.T @ back, back.sum())):
            one[i] = 0.9 * one[i] + 0.1 * grad
            two[i] = 0.999 * two[i] + 0.001 * grad * grad
            par[i] = par[i] - 0.005 * (one[i] / (1 - 0.9**step)) / (np.sqrt(two[i] / (1 - 0.999**step)) + 1e-8)
    return PuModel(mean, scale, par, np.array([1.0, 0.0]), prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 4, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, by best-bin estimation: a classifier of positives against
    unlabelled, learnt on one half, scores the other; of all thresholds, the one whose ratio of the
    shares above it has the least upper confidence bound gives the estimate."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8)[rng.permutation(len(x))] for x in (positive, unlabelled))
    i, j = (len(p) + 1) // 2, (len(u) + 1) // 2
    x, y = np.concatenate([p[:i], u[:j]]), np.repeat([1.0, 0.0], [i, j])
    w = logistic(x, y, np.where(y == 1, len(y) / 2 / i, len(y) / 2 / j))
    p, u = (p[i:], u[j:]) if len(p) > i and len(u) > j else (p, u)
    above = np.sort(p @ w[:-1])
    over = np.sort(u @ w[:-1])
    share_p = 1 - np.arange(len(above)) / len(above)
    share_u = 1 - np.searchsorted(over, above) / len(over)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(p)) + np.sqrt(np.log(4 / delta) / 2 / len(u))
    best = ((share_u + 1.01 * slack) / share_p).argmin()
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


def calibrated(model: PuModel, unlabelled: np.ndarray) -> PuModel:
    """Scores whose mean over the unlabelled is the prior: labels play no part in it."""
    z = model.raw(unlabelled)
    slope = 3.0 / max(float(z.std()), 1e-6)
    low, high = -40.0, 40.0
    for _ in range(60):
        shift = (low + high) / 2
        if (1 / (1 + np.exp(-np.clip((z - z.mean()) * slope + shift, -30, 30)))).mean() < model.prior:
            low = shift
        else:
            high = shift
    model.calibration = np.array([slope, shift - slope * z.mean()])
    return model


def train(rows: DataFrame, docs: DataFrame | None = None, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", per_kind: int = PER_KIND) -> PuModel | None:
    """rows: ids with labels, of which 1 is trusted and all else is unlabelled; docs: ids with texts,
    which may be rows itself."""
    docs = rows if docs is None else docs

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(list(features(texts(batch))), pa.list_(pa.float64()))], ["y", "doc_id", "x"])

    some = draw(rows.where(F.col(label_col) == 1).withColumn(label_col, F.lit(1)), docs, per_kind, KIND_BYTES, id_col, label_col, text_col, rest=0)
    if some is None:
        return None
    sample = some.select("y", "doc_id", "text").mapInArrow(run, "y int, doc_id bigint, x array<double>").toPandas().sort_values(["y", "doc_id"])
    x, y = np.array(sample["x"].tolist()).reshape(-1, N_FEATURES), sample["y"].to_numpy()
    if not (y == 1).any():
        return None
    # The unlabelled are the web text: documents of all kinds, positives among them that nobody marked.
    unlabelled = x[y == 0] if (y == 0).any() else x
    return calibrated(fit(x[y == 1], unlabelled, class_prior(x[y == 1], unlabelled)), unlabelled)


def score(docs: DataFrame, model: PuModel | None, text_col: str = "text", score_out: str = "score") -> DataFrame:
    """docs with the score as one more column (which replaces a column of this name)."""
    base = docs.drop(score_out)
    schema = T.StructType([*base.schema.fields, T.StructField(score_out, T.DoubleType())])
    share = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in schema.fields]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = share.value
        for batch in slices(batches, text_col):
            value = np.zeros(batch.num_rows) if model is None else model.scores(features(texts(batch, text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names)

    return base.mapInArrow(run, schema)
