"""Binary particle snapshots (header and POS / VEL / ID blocks, layouts 1 and 2) and record files.

A file is one task of a binaryFile scan, so a snapshot of many files is read in parallel; only
particles of type 1 are kept. Blocks that are not asked for are skipped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The 256-byte header.
HEADER = np.dtype([("npart", "<u4", 6), ("mass", "<f8", 6), ("time", "<f8"), ("redshift", "<f8"), ("flag_sfr", "<i4"), ("flag_feedback", "<i4"), ("total", "<u4", 6), ("flag_cooling", "<i4"), ("num_files", "<i4"), ("box", "<f8"), ("omega0", "<f8"), ("omegal", "<f8"), ("hubble", "<f8"), ("fill", "S96")])
SCHEMA = {"id": "bigint", "x": "double", "y": "double", "z": "double", "vx": "double", "vy": "double", "vz": "double"}


def _blocks(data: bytes, layout: int) -> Iterator[tuple[int, int]]:
    """(start, size) of each block; record marks must agree."""
    at = 0
    while at + 4 <= len(data):
        if layout == 2:
            at += 16
        (size,) = struct.unpack_from("<I", data, at)
        if data[at + 4 + size : at + 8 + size] != data[at : at + 4]:
            raise ValueError("record marks of a block differ")
        yield at + 4, size
        at += 8 + size


def parse(data: bytes, layout: int = 1, position: float = 1.0, velocity: float = 1.0, wanted: Sequence[str] = tuple(SCHEMA)) -> dict[str, np.ndarray]:
    blocks = list(_blocks(data, layout))
    if blocks[0][1] != HEADER.itemsize:
        raise ValueError("the header is not 256 bytes")
    head = np.frombuffer(data, HEADER, 1, blocks[0][0])[0]
    first, n, total = int(head["npart"][0]), int(head["npart"][1]), int(head["npart"].sum())
    out: dict[str, np.ndarray] = {}
    for (at, size), names, scale in zip(blocks[1:4], (("x", "y", "z"), ("vx", "vy", "vz"), ("id",)), (position, velocity, None), strict=True):
        if not set(names) & set(wanted) or not total:
            continue
        width = size // (total * len(names))
        kind = np.dtype(f"<{'f' if scale is not None else 'u'}{width}")
        rows = np.frombuffer(data, kind, n * len(names), at + first * len(names) * width).reshape(n, len(names))
        for i, c in enumerate(names):
            out[c] = rows[:, i].astype(np.float64) * scale if scale is not None else rows[:, i].astype(np.int64)
    return out


def read_snapshot(spark: SparkSession, path: str, layout: int = 1, position: float = 1.0, velocity: float = 1.0, columns: Sequence[str] = tuple(SCHEMA)) -> DataFrame:
    """Particles of type 1 of all files that the path or glob names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = parse(data.as_py(), layout, position, velocity, columns)
                yield pa.RecordBatch.from_arrays([pa.array(rows.get(c, np.zeros(0))) for c in columns], list(columns))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"{c} {SCHEMA[c]}" for c in columns))


def write_snapshot(particles: dict[str, np.ndarray], box: float, layout: int = 1) -> bytes:
    """One file of type-1 particles."""
    head = np.zeros(1, HEADER)
    head["npart"][0][1] = head["total"][0][1] = len(particles["id"])
    head["box"], head["num_files"] = box, 1
    blocks = [(b"HEAD", head.tobytes())]
    for label, names in ((b"POS ", "xyz"), (b"VEL ", ("vx", "vy", "vz"))):
        blocks.append((label, np.column_stack([particles[c] for c in names]).astype("<f4").tobytes()))
    blocks.append((b"ID  ", np.asarray(particles["id"]).astype("<u4").tobytes()))
    out = b""
    for label, data in blocks:
        if layout == 2:
            out += struct.pack("<I4sII", 8, label, len(data) + 8, 8)
        out += struct.pack("<I", len(data)) + data + struct.pack("<I", len(data))
    return out


def read_polylines(data: bytes, by_id: bool = False) -> list[np.ndarray]:
    """Count-prefixed polylines: node ids, or xyz triplets."""
    (n,) = struct.unpack_from("<I", data, 0)
    at, out = 4, []
    for _ in range(n):
        (size,) = struct.unpack_from("<I", data, at)
        out.append(np.frombuffer(data, "<u4", size, at + 4).astype(np.int64) if by_id else np.frombuffer(data, "<f4", 3 * size, at + 4).reshape(size, 3).astype(np.float64))
        at += 4 + size * (4 if by_id else 12)
    return out


def read_edges(data: bytes) -> np.ndarray:
    """Count-prefixed (i, j) pairs."""
    (n,) = struct.unpack_from("<I", data, 0)
    return np.frombuffer(data, "<u4", 2 * n, 4).reshape(n, 2).astype(np.int64)
