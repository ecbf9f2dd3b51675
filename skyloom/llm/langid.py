"""Language identification by a byte convolutional network, trained here in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over a window of fixed
length and classified by a softmax layer; a text's score is the mean over its windows. Training
uses all windows of the whole texts of a bounded sample of labelled rows (PER_CLASS rows and
CLASS_BYTES bytes a language; see common.draw), texts in equal shares.
At inference an embedding and its filter are one table row per (offset, byte), so a batch of
windows is a few table look-ups, a maximum and a small product.

Nulls: a text that is null or has no letter is `und` with score 0. Rows with a null language or text
are not learnt from. If no language can be learnt at all, every text is `und`. Very long texts are
scored over all their windows, 64 at a time. Ties between languages go to the first in order.
Repeated rows get equal results, each its own row; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import draw, released, slices, texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
PER_CLASS = 800  # the bound of the training sample, rows a language
CLASS_BYTES = 16 << 20
STEPS, BATCH = 400, 128


class ByteConvNet:
    """classes, tables (offset, byte, filter) with bias, and the output layer."""

    def __init__(self, classes: list[str], tables: np.ndarray, bias: np.ndarray, out: np.ndarray, shift: np.ndarray) -> None:
        self.classes, self.tables, self.bias, self.out, self.shift = classes, tables, bias, out, shift

    def features(self, windows: np.ndarray) -> np.ndarray:
        """Pooled filters of windows (n, WINDOW) of bytes."""
        most = max(WIDTHS)
        total = np.take(self.tables[0], windows[:, : WINDOW - most + 1], axis=0)
        for k in range(1, most):
            total += np.take(self.tables[k], windows[:, k : WINDOW - most + 1 + k], axis=0)
        return np.maximum(total.max(axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(windows), 64):
            z = self.features(windows[i : i + 64]) @ self.out + self.shift
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)))


def as_windows(parts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, the last of each padded with zeros, and each text's number of them."""
    count = np.array([-(-len(x) // size) for x in parts], np.int64)
    data = b"".join(x.ljust(int(n) * size, b"\0") for x, n in zip(parts, count, strict=True))
    return np.frombuffer(data, np.uint8).reshape(-1, size), count


def fit(windows: np.ndarray, labels: np.ndarray, classes: list[str], share: np.ndarray, seed: int = 5) -> ByteConvNet:
    """Adam on the cross-entropy; windows (n, WINDOW) of bytes, labels as indices of classes, share:
    each window's weight in the draws."""
    rng = np.random.default_rng(seed)
    until = np.cumsum(share) / share.sum()
    most, n_out, n_filters = max(WIDTHS), len(classes), FILTERS * len(WIDTHS)
    mask = np.zeros((most, EMBED, n_filters), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
    par = [rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, 0.3, (most, EMBED, n_filters)) * mask, np.zeros(n_filters), rng.normal(0, 0.3, (n_filters, n_out)), np.zeros(n_out)]
    par = [p.astype(np.float32) for p in par]
    one, two = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    length = WINDOW - most + 1
    for step in range(1, STEPS + 1):
        pick = np.minimum(np.searchsorted(until, rng.random(BATCH), "right"), len(windows) - 1)
        x, y = windows[pick], labels[pick]
        embed, kernel, bias, out, shift = par
        e = embed[x]
        cols = np.stack([e[:, k : k + length] for k in range(most)], axis=2).reshape(BATCH, length, most * EMBED)
        conv = cols @ kernel.reshape(most * EMBED, n_filters)
        where = conv.argmax(axis=1)
        pooled = np.take_along_axis(conv, where[:, None], axis=1)[:, 0] + bias
        hidden = np.maximum(pooled, 0)
        z = hidden @ out + shift
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(BATCH), y] -= 1
        z /= BATCH
        grad_out, grad_shift = hidden.T @ z, z.sum(axis=0)
        back = (z @ out.T) * (pooled > 0)
        picked = cols[np.arange(BATCH)[:, None], where]  # (batch, filter, offset * embed)
        grad_kernel = np.einsum("bf,bfk->kf", back, picked).reshape(kernel.shape) * mask
        grad_cols = np.einsum("bf,kf->bfk", back, kernel.reshape(most * EMBED, n_filters)).reshape(BATCH, n_filters, most, EMBED)
        places = where[:, :, None] + np.arange(most)
        grad_embed = np.zeros_like(embed)
        np.add.at(grad_embed, x[np.arange(BATCH)[:, None, None], places], grad_cols)
        for i, g in enumerate((grad_embed, grad_kernel, back.sum(axis=0), grad_out, grad_shift)):
            one[i] = 0.9 * one[i] + 0.1 * g
            two[i] = 0.999 * two[i] + 0.001 * g * g
            par[i] = par[i] - 0.01 * (one[i] / (1 - 0.9**step)) / (np.sqrt(two[i] / (1 - 0.999**step)) + 1e-8)
        par[1] *= mask
    embed, kernel, bias, out, shift = par
    tables = np.einsum("ve,kef->kvf", embed, kernel).astype(np.float32)
    return ByteConvNet(classes, np.ascontiguousarray(tables), bias.astype(np.float32), out, shift)


def train(rows: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", per_class: int = PER_CLASS) -> ByteConvNet | None:
    """Learn from a bounded sample of rows (common.draw); texts without letters are not learnt from."""
    known = rows.where(F.col(text_col).rlike(r"\p{L}"))
    some = draw(known.withColumn(label_col, F.col(label_col).cast("string")), known, per_class, CLASS_BYTES, id_col, label_col, text_col)
    if some is None:
        return None
    sample = sorted((r["y"], r["doc_id"], r["text"].encode()) for r in some.collect())
    classes = sorted({y for y, _, _ in sample})
    windows, count = as_windows([x for _, _, x in sample])
    return fit(windows, np.repeat([classes.index(y) for y, _, _ in sample], count), classes, np.repeat(1 / count, count))


def identify(docs: DataFrame, model: ByteConvNet | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with two more columns (which replace columns of these names): language and score."""
    base = docs.drop(lang_out, score_out).withColumn("__letters", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType([*base.schema.fields[:-1], T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    share = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in schema.fields]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = share.value
        for batch in slices(batches, text_col):
            letters = np.array(batch.column(batch.num_columns - 1).to_pylist(), bool)
            lang, score = np.full(len(letters), "und", object), np.zeros(len(letters))
            if net is not None:
                windows, count = as_windows([x if ok else b"" for x, ok in zip(texts(batch, text_col), letters, strict=True)])
                have = np.flatnonzero(count)
                if len(have):
                    mean = np.add.reduceat(net.probabilities(windows), (np.cumsum(count) - count)[have], axis=0) / count[have, None]
                    lang[have] = np.array(net.classes, object)[mean.argmax(axis=1)]
                    score[have] = np.clip(mean.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang.tolist(), pa.string()), pa.array(score)], names)

    return base.mapInArrow(run, schema)
