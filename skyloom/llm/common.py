"""Helpers shared by the training-data operators: bounded slices of Arrow batches, and vectorised hashing of words and byte strings.

Conventions of every operator: a null text counts as empty unless stated, columns other than the
id and the text are ignored (so extra or clashing columns are harmless), repeated rows each get
their own output row, and an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import ctypes
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import forget, shared_dir, written  # noqa: F401
from ..operators.graph import components  # noqa: F401

SLICE_BYTES = 1 << 19  # text handled at once by a numpy kernel


def crc_mod(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod (null ids: 0)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % mod, F.lit(0))


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id bigint, text string) only, nulls as empty texts."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def released(run: Callable) -> Callable:
    """A worker lives on after its task: what the task's arrays took goes back to the system."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of at most `most` bytes in `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        i = 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
            yield batch.slice(i, j - i)
            i = j


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts, null as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_binary(col.type):
        col = col.cast(pa.binary())
    return [x or b"" for x in col.to_pylist()]


def joined(parts: list[bytes], gap: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte array with `gap` after each; starts and ends of the texts."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.cumsum(size + len(gap)) - size - len(gap)
    return np.frombuffer(gap.join([*parts, b""]), np.uint8), start, start + size


# -- hashing ------------------------------------------------------------------------------------
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _RNG.integers(1, 2**63, (2, 256), dtype=np.int64).view(np.uint64) | np.uint64(1)
BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """BASE[which] ** (0, 1, ..., n - 1) modulo 2**64, or of its inverse."""
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        base = int(BASE[which])
        base = _inverse(base) if inverse else base
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        step, filled = base, 1
        while filled < size:  # doubling: have[filled:2*filled] = have[:filled] * base**filled
            have[filled : 2 * filled] = have[:filled] * np.uint64(step)
            step, filled = step * step % (1 << 64), 2 * filled
        if size <= 1 << 20:
            _POWERS[which, inverse] = have
    return have[:n]


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64: span_hash() takes any span from them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[which][data] * powers(which, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(which, len(prefix), True)[start] + (end - start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place where it can."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ALNUM = np.zeros(256, bool)  # bytes of the words of license scans: not ASCII, or letter or digit
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which `inside` holds."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = inside[data]
    edge = np.diff(flags)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def text_words(parts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, for each text the first and one-past-last word, and the words' lengths)."""
    data, start, end = joined(parts, b" ")
    data = LOWER[data]
    begin, stop = words(data, inside)
    return span_hash(prefix_hash(data), begin, stop), np.searchsorted(begin, start), np.searchsorted(begin, end), stop - begin


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


# -- bounded training samples ---------------------------------------------------------------------
MOST_CLASSES = 256  # labels that are learnt: the commonest


def draw(labels: DataFrame, docs: DataFrame, per_class: int, most_bytes: int, id_col: str, label_col: str, text_col: str, rest: int | None = None) -> DataFrame | None:
    """(y, doc_id, text): a sample of docs with their labels, bounded by per_class rows and most_bytes
    bytes of text a class, in the order of a hash of the id; a text beyond most_bytes is left out.
    Texts are whole. With `rest`, documents without label are the class `rest`.

    Only ids, labels and sizes are joined and dealt out; the driver gets about 1.3 * per_class ids a
    class, and the texts come by one scan with these ids. Rows without id, text or (but for rest) label
    are not learnt from; an id with several labels counts with the largest, one with several texts
    with the one of the smallest hash. None if nothing is left.
    """
    size = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.max(F.octet_length(text_col)).alias("bytes"))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.max(label_col).alias("y"))
    known = size.join(known, "doc_id", "inner" if rest is None else "left")
    known = known if rest is None else known.withColumn("y", F.coalesce("y", F.lit(rest)))
    known = written(known.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))).where(F.col("bytes") <= most_bytes), "known")
    count = known.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(MOST_CLASSES).collect()
    if not count:
        return None
    near = F.lit(False)
    for r in count:
        near |= (F.col("y") == r["y"]) & (F.col("h") < min(1 << 30, int((1.2 * per_class + 100) / r["n"] * (1 << 30)) + 1))
    taken: dict[object, list[int]] = {r["y"]: [0, 0] for r in count}
    chosen = []
    for r in sorted(known.where(near).select("y", "h", "doc_id", "bytes").collect(), key=lambda r: (r["h"], r["doc_id"])):
        have = taken[r["y"]]
        if have[0] < per_class and have[1] + r["bytes"] <= most_bytes:
            taken[r["y"]] = [have[0] + 1, have[1] + r["bytes"]]
            chosen.append((r["y"], r["doc_id"]))
    few = docs.sparkSession.createDataFrame(chosen, known.select("y", F.col("doc_id").alias("__id")).schema)
    forget(known)
    # at most per_class * MOST_CLASSES ids: a proven bound
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(few), "__id")
    return rows.groupBy("y", F.col("__id").alias("doc_id")).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


# -- packed texts for shuffles --------------------------------------------------------------------
def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the text as zstandard bytes, so that shuffles move about a third."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tool.compress(x) for x in texts(batch)], pa.binary())], ["doc_id", "z"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, z binary")
