"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors go to the cell of their nearest pivot (the root of their number, at most PIVOTS, of the vectors
with the smallest hashes, which is all that is sampled). Summaries of the cells (count, radius, largest norm) reach the
driver, bounded by PIVOTS rows. For a query q, a vector v of the cell of pivot c has
q.c - |q| r <= q.v <= min(q.c + |q| r, |q| max|v|); the lower bounds of the cells, best first, until
they hold k + 1 vectors, give a score that the k-th best reaches at least, and q is sent only to
cells whose upper bound reaches it. Cells are salted into parts of about PART vectors, so a hot cell
is many tasks; each part keeps the k best of each of its queries and a window takes the k best.

Nulls: vectors that are null, empty, or hold null or non-finite components take no part, as queries
or candidates; so do rows with a null id and vectors whose length differs from the commonest one.
Scores beyond 64 bits are the nearest 64-bit number. Ties go to the smaller id. An empty table gives
an empty one. Rows that repeat an id are candidates each; a query never meets its own id,
and of a repeated query id the smallest vector asks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import released, written

PIVOTS = 1024
PART = 4096
SCALE = 64
SAFE = float(2**52)  # inner products below it are exact in doubles


def integer_vectors(table: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(id, v), finite vectors of the commonest length as floor(scale * x) in doubles, and their number."""
    v = F.col(vec_col)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = table.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    ok = ok.select(F.col(id_col).cast("bigint").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    most = ok.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return ok.where(F.size("v") == (most["n"] if most else 1)), most["count"] if most else 0


def _floors(column: pa.Array, scale: int) -> np.ndarray:
    """In doubles, which hold what a 64-bit number can't; products beyond doubles stay the largest double."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(_matrix(column) * float(scale)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by doubles where they are exact, else by Python integers."""
    if not len(a) or not len(b) or np.abs(a).max() * np.abs(b).max() * a.shape[1] < SAFE:
        return (a @ b.T).astype(np.int64)
    rows, columns = ([[int(x) for x in p] for p in m] for m in (a, b))
    return np.array([[min(max(sum(x * y for x, y in zip(p, q, strict=True)), -(1 << 63)), (1 << 63) - 1) for q in columns] for p in rows], np.int64)


def search(table: DataFrame, is_query: Callable[[Column], Column], k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is a query's."""
    spark = table.sparkSession
    whole, total = integer_vectors(table, id_col, vec_col, scale)
    most = min(PIVOTS, max(16, math.isqrt(total)))
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    near = whole.where(h < min(1 << 30, int((1.3 * most + 60) / max(1, total) * (1 << 30)) + 1)).groupBy("id", h.alias("h")).agg(F.min("v").alias("v"))
    near = sorted(near.collect(), key=lambda r: (r["h"], r["id"]))[:most]
    if total and not near:  # few rows, and none of small hash
        near = whole.limit(1).collect()
    pivots = _floors(pa.array([r["v"] for r in near], pa.list_(pa.float64())), scale) if near else []
    if not len(pivots):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    share = spark.sparkContext.broadcast(pivots)

    @released
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = share.value
        with np.errstate(over="ignore"):
            square = (pivots * pivots).sum(axis=1)
        for batch in batches:
            if batch.num_rows:
                v = _floors(batch.column(1), scale)
                with np.errstate(over="ignore", invalid="ignore"):
                    norm = (v * v).sum(axis=1)
                    far = np.nan_to_num(np.maximum(norm[:, None] + square - 2 * (v @ pivots.T), 0), nan=np.inf, posinf=np.inf)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), v.ravel()), pa.array(cell.astype(np.int32)), pa.array(np.sqrt(far[np.arange(len(cell)), cell])), pa.array(np.sqrt(norm))], ["id", "v", "cell", "far", "norm"])

    cells = written(whole.mapInArrow(assign, "id bigint, v array<double>, cell int, far double, norm double"), "cells")
    count, radius, norm = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r"), F.max("norm").alias("m")).collect():
        count[r["cell"]], radius[r["cell"]], norm[r["cell"]] = r["n"], r["r"] * (1 + 1e-9) + 1e-6, r["m"] * (1 + 1e-9)
    parts = np.maximum(1, -(-count // PART))
    summary = spark.sparkContext.broadcast((pivots, count, radius, norm, parts))

    @released
    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, count, radius, norm, parts = summary.value
        for big in batches:
            for i in range(0, big.num_rows, 512):
                batch = big.slice(i, 512)
                q = _matrix(batch.column(1))
                with np.errstate(over="ignore", invalid="ignore"):  # bounds beyond doubles bind nothing
                    size = np.sqrt((q * q).sum(axis=1))[:, None] * (1 + 1e-9)
                    mid = q @ pivots.T
                    slack = 1e-9 * size * (np.sqrt((pivots * pivots).sum(axis=1)) + radius)  # rounding
                    low = np.nan_to_num(mid - size * radius - slack, nan=-np.inf, neginf=-np.inf, posinf=np.inf)
                    high = np.nan_to_num(np.minimum(mid + size * radius, size * norm) + slack, nan=np.inf, neginf=-np.inf, posinf=np.inf)
                order = np.argsort(-low, axis=1, kind="stable")
                have = np.cumsum(count[order], axis=1)
                at = np.minimum((have < k + 1).sum(axis=1), len(count) - 1)
                floor = np.where(have[:, -1] < k + 1, -np.inf, np.take_along_axis(low, order, axis=1)[np.arange(len(q)), at])
                row, cell = np.nonzero((high >= floor[:, None] - 1e-6) & (count > 0))
                n = parts[cell]
                row, cell, salt = np.repeat(row, n), np.repeat(cell, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(np.ones(len(row), np.int32)), batch.column(0).take(take), batch.column(1).take(take)], ["cell", "salt", "role", "id", "v"])

    share_of = F.element_at(F.array(*[F.lit(int(x)) for x in parts]), F.col("cell") + 1)
    data = cells.select("cell", F.pmod(F.xxhash64("id", "v"), share_of).cast("int").alias("salt"), F.lit(0).alias("role"), "id", "v")
    asking = cells.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    asked = asking.mapInArrow(replicate, "cell int, salt int, role int, id bigint, v array<double>")
    both = data.unionByName(asked).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "role")

    @released
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows = None, [], []
        for big in batches:
            cell, salt, role = (big.column(i).to_numpy() for i in range(3))
            if not len(cell):
                continue
            cut = np.flatnonzero((np.diff(cell) != 0) | (np.diff(salt) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, len(cell)], strict=True):
                v, name = _matrix(big.column(4).slice(a, b - a)), big.column(3).slice(a, b - a).to_numpy()
                if (cell[a], salt[a]) != at:
                    at, ids, rows = (cell[a], salt[a]), [], []
                if role[a] == 0:
                    ids.append(name)
                    rows.append(v)
                elif rows:
                    if len(rows) > 1:
                        ids, rows = [np.concatenate(ids)], [np.concatenate(rows)]
                    for i in range(0, len(v), 256):
                        yield best(name[i : i + 256], v[i : i + 256], ids[0], rows[0])

    def best(query: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        score = _product(q, rows)
        out: list[list] = [[], [], []]
        for name, s in zip(query.tolist(), score, strict=True):
            ok = np.flatnonzero(ids != name)
            if len(ok) > k:
                kth = np.partition(s[ok], len(ok) - k)[len(ok) - k]
                ok = ok[s[ok] >= kth]
            ok = ok[np.lexsort((ids[ok], -s[ok]))[:k]]
            out[0] += [name] * len(ok)
            out[1] += ids[ok].tolist()
            out[2] += s[ok].tolist()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(solve, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

