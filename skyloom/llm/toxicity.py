"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text; a window that the
toxic dictionary compresses better than the ordinary one speaks for toxicity. The toxic
dictionary is trained on windows of toxic texts, in two parts, since most of a toxic document is
ordinary text: words that are far more frequent in toxic than in ordinary training texts, as they
stand there with AROUND bytes on both sides, and all the other text, which holds short and rare
words, phrases and scripts without spaces. Both dictionaries also share the same ordinary
samples, so they differ by what is toxic. A text's best window, the mean of its three
best and the share of windows beyond a threshold are calibrated by logistic regression.

Before compression each byte becomes two, drawn from a fixed table (letters in lower case), and the
dictionaries are used as raw content, so that small windows keep raw literals: a literal then costs
two bytes and a match as much as ever, and one marked word shows in a window's compressed length.
The toxic content stands before the ordinary content, at whose offsets nothing changes.

Training uses the whole texts of a bounded sample of labelled rows (PER_CLASS rows and CLASS_BYTES
bytes a class; see common.draw), of their windows at most SAMPLES for each part of a dictionary,
and at most STEMS marked words.
Nulls: null and empty texts have no window and get the score of a text without evidence. Rows with
null labels are not learnt from; if one class is missing, every score is 0. Very long texts are
scored over all their windows. Repeated rows get equal results, each its own row; an empty table
gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import draw, released, slices, texts

WINDOW = 64
PER_CLASS = 2000
CLASS_BYTES = 16 << 20
SAMPLES = 6000  # windows that a dictionary is trained on, drawn from all windows of the training texts
STEMS = 200  # marked words at most, those that stand out most
DICT = 24576
AROUND = 2  # bytes before and after a marked word that go with it
MATCH, STRATEGY = 7, 4  # zstandard's lazy search, whose matches hang little on how its tables were filled

_CODE = np.random.Generator(np.random.PCG64(11)).permuted(np.tile(np.arange(256, dtype=np.uint8), (2, 1)), axis=1).T[[*range(65), *range(97, 123), *range(91, 256)]].copy()


def expanded(text: bytes) -> bytes:
    return _CODE[np.frombuffer(text, np.uint8)].tobytes()


class CompressionClassifier:
    def __init__(self, ordinary: bytes, toxic: bytes, threshold: float, weights: np.ndarray) -> None:
        self.ordinary, self.toxic, self.threshold, self.weights = ordinary, toxic, threshold, weights

    def open(self) -> None:
        import zstandard

        bare = zstandard.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=15, search_log=3, min_match=MATCH, target_length=64, strategy=STRATEGY, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.tools = []
        for content in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=bare)
            self.tools.append(zstandard.ZstdCompressor(dict_data=d, compression_params=bare).compress)

    def differences(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that the toxic dictionary saves over the ordinary one, for all windows of all texts;
        each text's number of windows. Windows overlap by 8 bytes."""
        step = WINDOW - 8
        wide = [expanded(x) for x in parts]
        cut = [w[2 * i : 2 * (i + WINDOW)] for x, w in zip(parts, wide, strict=True) for i in range(0, max(1, len(x) - 8) if x else 0, step)]
        count = np.array([len(range(0, max(1, len(x) - 8) if x else 0, step)) for x in parts], np.int64)
        one, two = self.tools
        return np.array([len(one(w)) - len(two(w)) for w in cut], np.float32), count

    def evidence(self, parts: list[bytes]) -> np.ndarray:
        """(texts, 7): of each text's windows the best difference, the mean of its three best, the log of
        all bytes saved and of windows beyond the threshold, and the shares beyond three thresholds."""
        diff, count = self.differences(parts)
        out = np.zeros((len(parts), 7))
        at = 0
        for i, n in enumerate(count.tolist()):
            if n:
                d = np.sort(np.maximum(diff[at : at + n], 0))[::-1]
                over = [(d >= t * self.threshold).sum() for t in (1, 2, 3)]
                out[i] = d[0], d[:3].mean(), np.log1p(d.sum()), np.log1p(over[0]), *(min(k / n, 0.2) for k in over)
                at += n
        return out

    def scores(self, parts: list[bytes]) -> np.ndarray:
        z = self.evidence(parts) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on the samples; of too few samples, their last bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-(size - 512) :]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:].rjust(8, b" ")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last weight is the constant's."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)) * weight.sum() / len(x)
        w = w + np.linalg.solve(h, a.T @ (weight * (y - p)) - ridge * weight.sum() / len(x) * w)
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def stems(parts: list[bytes], labels: np.ndarray) -> list[tuple[bytes, int]]:
    """Beginnings of words that stand out in toxic texts, with the number of texts that have them: by
    the share of texts that hold one, or hold it three times, against that of ordinary texts."""
    strip = bytes(set(range(128)) - set(range(97, 123)))
    n = [max(1, int((labels == y).sum())) for y in (0, 1)]
    z: dict[bytes, tuple[float, int]] = {}
    for least in (1, 3):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for x, y in zip(parts, labels.tolist(), strict=True):
            here = Counter(w[:k] for w in (w.strip(strip) for w in x.lower().split()) for k in range(4, min(len(w), 12) + 1))
            seen[y].update(w for w, k in here.items() if k >= least)
        for w, k in seen[1].items():
            p, q = k / n[1], (seen[0][w] + 0.5) / (n[0] + 1)
            value = (p - q) / np.sqrt(q * (1 / n[0] + 1 / n[1]))
            if k >= 4 and p > 3 * q and value > max(7.0, z.get(w, (0.0, 0))[0]):
                z[w] = value, k
    out: list[tuple[bytes, int]] = []
    for w, (_, k) in sorted(z.items(), key=lambda item: (-round(item[1][0], 6), -len(item[0]), item[0])):
        if not any(w.startswith(v) or v.startswith(w) for v, _ in out):
            out.append((w, k))
    return out[:STEMS]


def toxic_windows(parts: list[bytes], marked: list[tuple[bytes, int]], rng: np.random.Generator) -> tuple[list[bytes], list[bytes]]:
    """Windows of toxic texts: the surroundings of their marked words, and the text outside of them."""
    find = re.compile(rb"(?<![a-z])(?:" + b"|".join(re.escape(w) for w, _ in marked) + rb")[a-z]*") if marked else None
    near, others = [], []
    for x in parts:
        at = 0
        for m in find.finditer(x.lower()) if find else ():
            a, b = max(at, m.start() - AROUND), m.end() + AROUND
            near.append(x[a:b])
            others += [x[i : min(i + 256, a)] for i in range(at, a, 256)]
            at = max(at, b)
        others += [x[i : i + 256] for i in range(at, len(x), 256)]
    near, others = ([v[i] for i in rng.permutation(len(v))[:SAMPLES]] for v in (near, others))
    return near, others


def fit(parts: list[bytes], labels: np.ndarray) -> CompressionClassifier | None:
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(3)
    half = rng.random(len(parts)) < 0.6  # these train the dictionaries, the others the thresholds
    if len(set(labels[half].tolist())) < 2 or len(set(labels[~half].tolist())) < 2:
        half[:] = True
    marked = stems([x for x, use in zip(parts, half.tolist(), strict=True) if use], labels[half])
    ordinary = [x[i : i + 256] for x, y, use in zip(parts, labels.tolist(), half.tolist(), strict=True) if use and y == 0 for i in range(0, len(x), 256)]
    ordinary = [ordinary[i] for i in rng.permutation(len(ordinary))[:SAMPLES]]
    near, others = toxic_windows([x for x, y, use in zip(parts, labels.tolist(), half.tolist(), strict=True) if use and y == 1], marked, rng)
    shared = _dictionary([expanded(x) for x in ordinary], DICT)
    content = b""
    for samples, size in ((others, DICT // 8), (near, DICT // 4)):
        wide = [expanded(x) for x in samples]
        content += _dictionary(wide * (1 + 2000 // len(wide)), size) if wide else b""
    model = CompressionClassifier(shared, content + shared, 0.0, np.zeros(8))
    model.open()
    use = ~half if not half.all() else half
    pick = np.flatnonzero(use)
    chosen, y = [parts[i] for i in pick], labels[pick]
    diff, count = model.differences(chosen)
    owner = np.repeat(y, count)
    best, model.threshold = -1.0, 2.0
    for t in range(2, 9):  # the threshold that parts the classes best
        gain = (diff[owner == 1] >= t).mean() - (diff[owner == 0] >= t).mean() if len(diff) else 0
        if gain > best:
            best, model.threshold = gain, float(t)
    x = model.evidence(chosen)
    weight = np.where(y == 1, 0.3 / max(1, y.sum()), 0.7 / max(1, (1 - y).sum())) * len(y)  # clean texts weigh more: they are to stay
    model.weights = logistic(x, y.astype(float), weight)
    del model.tools
    return model


def train(rows: DataFrame, docs: DataFrame | None = None, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", per_class: int = PER_CLASS) -> CompressionClassifier | None:
    """rows: ids with labels; docs: ids with texts, which may be rows itself."""
    some = draw(rows.where(F.col(label_col).isin(0, 1)).withColumn(label_col, F.col(label_col).cast("int")), rows if docs is None else docs, per_class, CLASS_BYTES, id_col, label_col, text_col)
    sample = sorted((r["y"], r["doc_id"], r["text"].encode()) for r in some.collect()) if some is not None else []
    return fit([x for _, _, x in sample], np.array([y for y, _, _ in sample], int)) if sample else None


def score(docs: DataFrame, model: CompressionClassifier | None, text_col: str = "text", score_out: str = "score") -> DataFrame:
    """docs with the score as one more column (which replaces a column of this name)."""
    base = docs.drop(score_out)
    schema = T.StructType([*base.schema.fields, T.StructField(score_out, T.DoubleType())])
    share = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in schema.fields]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = share.value
        if tool is not None:
            tool.open()
        for batch in slices(batches, text_col):
            value = np.zeros(batch.num_rows) if tool is None else tool.scores(texts(batch, text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names)

    return base.mapInArrow(run, schema)
