"""Solids: Voronoi cells, convex hulls, volumes of unions of spheres.

Each kernel works on a bounded neighbourhood (points within reach, overlapping spheres, a part of a group), so
no group is gathered whole. Points with a null coordinate or id take no part; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import AXES, minimum_image
from ..functions.tables import written
from .blocks import Grid, blocked, columns, image

# -- Voronoi cells ------------------------------------------------------------------------------------
SIDES = np.array([[-1.0, 0, 0], [1, 0, 0], [0, -1, 0], [0, 1, 0], [0, 0, -1], [0, 0, 1]])
IMAGES = np.array([[x, y, z] for x in (0, -1, 1) for y in (0, -1, 1) for z in (0, -1, 1)], float)
FIRST, MORE = 14, 10  # nearest points that cut a cell at first, and those that cut it again at most
CELLS = 200  # cells of a block, on average
BATCH = 16  # cells cut at once
SHIFT = 0.2360679775  # of the grid on which corners are merged: corners of lattice points lie on halves


def _edges(n: np.ndarray, h: np.ndarray, tol: float) -> tuple[np.ndarray, ...]:
    """Edges of the solids n . x <= h (cells, planes, 3) with unit normals (0 for a missing plane): cell, both planes, both
    ends, and the distances of the edge from both planes' feet. Two planes' line is an edge where all others leave
    more than `tol` of it; of planes through one line only the outermost two have the edge."""
    i, j = np.triu_indices(n.shape[1], 1)
    t = n.transpose(0, 2, 1)
    g, w = (n @ t)[:, i, j], np.cross(n[:, i], n[:, j])
    size = np.sqrt((w * w).sum(2))
    ok = size > 1e-10
    size = np.where(ok, size, 1.0)
    w /= size[..., None]
    si, sj = (h[:, j] - g * h[:, i]) / size, (h[:, i] - g * h[:, j]) / size
    base = (sj / size)[..., None] * n[:, i] + (si / size)[..., None] * n[:, j]
    den, num = w @ t, h[:, None] - base @ t
    p = np.arange(len(i))
    for own in (i, j):
        den[:, p, own], num[:, p, own] = 0.0, 1.0
    flat = np.abs(den) < 1e-10
    ok &= ~(flat & (num < -tol)).any(2)
    for c, e, k in zip(*np.nonzero(flat & (num <= tol) & ok[..., None]), strict=True):  # plane k holds the line
        a, b, q, d = n[c, i[e]], n[c, j[e]], n[c, k], w[c, e]
        ok[c, e] &= np.cross(q, b) @ d > -1e-10 and np.cross(a, q) @ d > -1e-10
    with np.errstate(divide="ignore", invalid="ignore"):
        at = num / den
    hi = np.where(den >= 1e-10, at, np.inf).min(2)
    lo = np.where(den <= -1e-10, at, -np.inf).max(2)
    c, e = np.nonzero(ok & (hi - lo > tol))
    ends = [base[c, e] + v[c, e][:, None] * w[c, e] for v in (lo, hi)]
    return c, i[e], j[e], *ends, si[c, e], sj[c, e]


def voronoi_cells(off: np.ndarray, d: np.ndarray, box: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(volumes, means of the distinct corners, farthest corners, cells and points of the neighbours) of the cells of the
    origin among points at offsets (cells, points, 3) in order of distance d (inf for a missing point),
    within the cube of side `box`. A cell is cut by its nearest points, then by those that its corners show to cut it,
    until there is none."""
    many, most = d.shape
    eps, tol, half = box * 1e-12, box * 1e-11, np.where(np.isfinite(d), d / 2, np.inf)
    unit = np.where(np.isfinite(d)[..., None], off / np.where(np.isfinite(d), d, 1.0)[..., None], 0.0)
    volume, mean, reach = np.zeros(many), np.zeros((many, 3)), np.zeros(many)
    beside: list[tuple[np.ndarray, np.ndarray]] = []
    fresh = np.isfinite(d)
    live = np.arange(many)
    which = np.where(fresh[:, :FIRST], np.arange(min(FIRST, most)), -1)
    while len(live):
        row, col = np.nonzero(which >= 0)
        fresh[live[row], which[row, col]] = False
        n, h = np.zeros((len(live), which.shape[1], 3)), np.ones((len(live), which.shape[1]))
        n[row, col], h[row, col] = unit[live[row], which[row, col]], half[live[row], which[row, col]]
        n = np.concatenate([np.broadcast_to(SIDES, (len(live), 6, 3)), n], 1)
        h = np.concatenate([np.full((len(live), 6), box / 2), h], 1)
        c, i, j, a, b, si, sj = _edges(n, h, tol)
        order = np.argsort(np.concatenate([c, c]), kind="stable")
        cell, spots = np.concatenate([c, c])[order], np.concatenate([a, b])[order]
        count = np.bincount(cell, minlength=len(live))
        corners = np.zeros((len(live), int(count.max()), 3))
        corners[cell, np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)] = spots
        far = np.sqrt((corners * corners).sum(2).max(1))
        ends = int((d[live] < 2 * far[:, None]).sum(1).max())
        cuts = np.zeros((len(live), ends), bool)
        step = max(1, PAIRS // (len(live) * corners.shape[1]))
        for k in range(0, ends, step):
            to = slice(k, min(ends, k + step))
            cuts[:, to] = fresh[live, to] & ((unit[live, to] @ corners.transpose(0, 2, 1)).max(2) > half[live, to] + eps)
        again = cuts.any(1)
        long = np.sqrt(((b - a) ** 2).sum(1))
        planes = n.shape[1]
        area = (np.bincount(c * planes + i, si * long, len(live) * planes) + np.bincount(c * planes + j, sj * long, len(live) * planes)).reshape(-1, planes) / 2
        done = np.flatnonzero(~again)
        volume[live[done]], reach[live[done]] = ((area * h).sum(1) / 3)[done], far[done]
        got, col = np.nonzero(~again[:, None] & (2 * area[:, 6:] > (1e-7 * far[:, None]) ** 2))
        beside.append((live[got], which[got, col]))
        place = np.column_stack([cell, np.floor(spots / (1e-9 * box) + SHIFT)])
        order = np.lexsort(place.T[::-1])
        place, spots, cell = place[order], spots[order], cell[order]
        new = np.concatenate([[True], (place[1:] != place[:-1]).any(1)])
        total = np.bincount(cell[new], minlength=len(live))
        middle = np.column_stack([np.bincount(cell[new], spots[new, x], len(live)) for x in range(3)]) / total[:, None]
        mean[live[done]] = middle[done]
        # the next round: planes with edges, and the nearest of the points that cut
        kept = np.zeros((len(live), planes), bool)
        kept[c, i] = kept[c, j] = True
        kept, old, cuts = kept[again, 6:], which[again], cuts[again]
        live = live[again]
        cuts &= np.cumsum(cuts, 1) <= MORE
        width = int((kept.sum(1) + cuts.sum(1)).max()) if len(live) else 0
        which = np.full((len(live), width), -1)
        for pick, source, start in ((kept, old, np.zeros(len(live), int)), (cuts, np.broadcast_to(np.arange(cuts.shape[1]), cuts.shape), kept.sum(1))):
            row, col = np.nonzero(pick)
            which[row, start[row] + (np.cumsum(pick, 1) - 1)[row, col]] = source[row, col]
    cells, points = (np.concatenate(x) for x in zip(*beside, strict=True)) if beside else (np.zeros(0, int), np.zeros(0, int))
    return volume, mean, reach, cells, points


def _padded(row: np.ndarray, point: np.ndarray, off: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, distances and numbers of each row's points in order of distance, as (rows, most points)."""
    d = np.sqrt((off * off).sum(1))
    order = np.lexsort((d, row))
    row, point, off, d = row[order], point[order], off[order], d[order]
    count = np.bincount(row, minlength=many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    most = max(1, int(count.max()) if many else 1)
    wide, far, who = np.zeros((many, most, 3)), np.full((many, most), np.inf), np.zeros((many, most), np.int64)
    wide[row, at], far[row, at], who[row, at] = off, d, point
    return wide, far, who


def _start(me: np.ndarray, at: np.ndarray, box: float, reach: float) -> np.ndarray:
    """The radius in which a centre's points are sought first: `reach`, or less where points are dense."""
    rel = [np.floor(image(x - me[0], box) / reach).astype(np.int64) for x in (at, me)]
    low = np.minimum(rel[0].min(0), rel[1].min(0)) - 1
    size = np.maximum(rel[0].max(0), rel[1].max(0)) - low + 2
    cells = [np.ravel_multi_index((r - low).T, size) for r in rel]
    have = np.bincount(cells[0], minlength=int(size.prod()))
    near = sum(have[cells[1] + (x * size[1] + y) * size[2] + z] for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1))
    return reach * np.minimum(1.0, (2000 / np.maximum(near, 1)) ** (1 / 3))


def _cells_of(me: np.ndarray, ids: np.ndarray, at: np.ndarray, names: np.ndarray, box: float, reach: float, whole: bool) -> pa.Table:
    """Cells of centres among points, which are all within `reach` of a centre, or `whole`: all there are, and
    their images are tried too."""
    volume, mean, certain = np.zeros(len(me)), np.zeros((len(me), 3)), np.full(len(me), whole)
    beside: list[tuple[np.ndarray, np.ndarray]] = []

    def cut(some: np.ndarray, row: np.ndarray, point: np.ndarray, off: np.ndarray, radius: np.ndarray | None) -> None:
        wide, far, who = _padded(row, point, off, len(some))
        v, m, r, c, p = voronoi_cells(wide, far, box)
        sure = np.ones(len(some), bool) if radius is None else (2 * r <= radius) & (2 * r <= box / 2)
        volume[some], mean[some], certain[some] = v, m, sure
        ok = sure[c]
        beside.append((some[c[ok]], names[who[c[ok], p[ok]]]))

    if whole:
        for k in range(len(me)):
            others = np.flatnonzero(names != ids[k])
            off = (image(at[others] - me[k], box)[:, None] + box * IMAGES).reshape(-1, 3)
            cut(np.array([k]), np.zeros(len(off), int), np.repeat(others, 27), off, None)
    else:
        radius, grid = _start(me, at, box, reach), Grid(at, box, max(reach / 2, box / 64))
        left = np.argsort(radius, kind="stable")
        while len(left):
            for k in range(0, len(left), BATCH):
                some = left[k : k + BATCH]
                r = radius[some]
                found = []
                for row, point in grid.candidates(me[some] - r[:, None], me[some] + r[:, None]):
                    off = image(at[point] - me[some[row]], box)
                    ok = ((off * off).sum(1) <= (r * r)[row]) & (names[point] != ids[some[row]])
                    found.append((row[ok], point[ok], off[ok]))
                row, point, off = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros((0, 3)))
                cut(some, row, point, off, r)
            left = left[~certain[left] & (radius[left] < reach)]
            radius[left] = np.minimum(radius[left] * 1.6, reach)
    mean = np.mod(me + mean, box)
    c, p = (np.concatenate(x) for x in zip(*beside, strict=True))
    order = np.lexsort((p, c))
    c, p = c[order], p[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (p[1:] != p[:-1])
    stops = np.concatenate([[0], np.cumsum(np.bincount(c[new], minlength=len(me)))]).astype(np.int32)
    return pa.table({"id": ids, "volume": volume, **{f"c{a}": mean[:, x] for x, a in enumerate(AXES)}, "neighbours": pa.ListArray.from_arrays(pa.array(stops), pa.array(p[new])), "certain": certain})


def voronoi(points: DataFrame, box: float, k: int = 96) -> DataFrame:
    """(id, volume, cx, cy, cz, neighbours): cells of distinct points in the periodic box, the mean of their corners
    (wrapped), sorted neighbours. Of points at one place that of smallest id has the cell. Cells are cut in blocks of
    the box, by the points within a radius that holds 1.6 k on average; cells with a corner farther than half of it
    again with those within 1.6 times the radius, at last with all points and their images."""
    where = [F.col(c).isNotNull() for c in ("id", *AXES)]
    sites = points.where(where[0] & where[1] & where[2] & where[3]).groupBy(*AXES).agg(F.min("id").alias("id")).select(F.col("id").cast("bigint").alias("id"), *AXES)
    sites = written(sites, "sites")
    total, left, out = sites.count(), sites, None
    reach, todo = max(box * (1.6 * k / max(1, total) / 4.19) ** (1 / 3), box / 500), total
    schema = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("volume", "cx", "cy", "cz")), T.StructField("neighbours", T.ArrayType(T.LongType())), T.StructField("certain", T.BooleanType())])
    while True:
        whole = reach > box / 2
        side = box / 2 if whole else reach

        def kernel(p: pa.Table, q: pa.Table, whole: bool = whole, side: float = side) -> pa.Table:
            return _cells_of(columns(p, *AXES), p["id"].to_numpy(), columns(q, *AXES), q["id"].to_numpy(), box, side, whole)

        wide = side * (1 + 1e-9)
        around = sites.select("*", *((F.col(c) - wide).alias(f"l{c}") for c in AXES), *((F.col(c) + wide).alias(f"h{c}") for c in AXES))
        cells = written(blocked(left, around, box, kernel, schema, CELLS, max(1, min(2000, -(-todo // CELLS)))), "cells")
        part = cells.where("certain").drop("certain")
        out = part if out is None else out.unionByName(part)
        again = cells.where("not certain").select("id")
        todo = 0 if whole else again.count()
        if not todo:
            return out
        left, reach = written(left.hint("merge").join(again.hint("merge"), "id", "left_semi"), "uncertain"), 1.6 * reach


def voronoi_edges(cells: DataFrame, group: DataFrame) -> DataFrame:
    """(a, b), a < b: neighbouring cells whose points are of the same group (id, gid), each once."""
    e = cells.select("id", F.explode("neighbours").alias("other")).where("id != other")
    e = e.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    of = lambda side: group.select(F.col("id").alias(side), F.col("gid").alias(f"g{side}"))
    return e.hint("merge").join(of("a").hint("merge"), "a").hint("merge").join(of("b").hint("merge"), "b").where("ga = gb").select("a", "b")


def relaxed(points: DataFrame, box: float, times: int) -> DataFrame:
    """Points moved `times` times to the mean of their cell's corners; of points at one place one is left."""
    for _ in range(times):
        points = voronoi(points, box).select("id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return points


# -- convex hulls --------------------------------------------------------------------------------------
PART = 4096  # points hulled at once


def hull(p: np.ndarray) -> np.ndarray:
    """Corner numbers (m, 3) of the hull's triangles, seen from outside anticlockwise; none for flat sets."""
    scale = np.abs(p - p[0]).max() if len(p) else 0.0
    if len(p) < 4 or not scale:
        return np.zeros((0, 3), int)
    eps = scale * 1e-10
    a = int(np.lexsort(p.T)[0])
    b = int(((p - p[a]) ** 2).sum(1).argmax())
    off = np.cross(p - p[a], p[b] - p[a])
    c = int((off**2).sum(1).argmax())
    normal = np.cross(p[b] - p[a], p[c] - p[a])
    size = np.sqrt(normal @ normal)
    if size <= eps * scale:
        return np.zeros((0, 3), int)
    height = (p - p[a]) @ normal / size
    d = int(np.abs(height).argmax())
    if abs(height[d]) <= eps:
        return np.zeros((0, 3), int)
    if height[d] > 0:
        b, c = c, b
    faces = np.array([[a, b, c], [a, d, b], [b, d, c], [c, d, a]])

    def planes(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]])
        n = n / np.maximum(np.sqrt((n * n).sum(1, keepdims=True)), 1e-300)
        return n, (n * p[f[:, 0]]).sum(1)

    n, at = planes(faces)
    left = np.arange(len(p))
    while True:
        above = p[left] @ n.T - at
        out = above.max(1)
        left, above, out = left[out > eps], above[out > eps], out[out > eps]
        if not len(left):
            return faces
        i = int(out.argmax())
        seen = above[i] > eps
        edges = {(int(f[j]), int(f[j - 2])) for f in faces[seen] for j in range(3)}
        new = np.array([[u, v, left[i]] for u, v in sorted(edges) if (v, u) not in edges])
        faces = np.concatenate([faces[~seen], new])
        m, to = planes(new)
        n, at = np.concatenate([n[~seen], m]), np.concatenate([at[~seen], to])


def solid_of(p: np.ndarray, f: np.ndarray) -> tuple[float, float]:
    """(volume, area) within triangles."""
    u, v, w = (p[f[:, i]] - p[0] for i in range(3))
    return float((np.cross(u, v) * w).sum() / 6), float(np.sqrt((np.cross(v - u, w - u) ** 2).sum(1)).sum() / 2)


def convex_hulls(members: DataFrame, box: float) -> DataFrame:
    """(gid, n, corners, faces, volume, area) of each group's members, unwrapped from the member of smallest id
    (groups smaller than half the box). Large groups are hulled in parts by id, and the parts' corners again
    until each group is one part; flat groups have no faces and volume 0."""
    ref = members.groupBy("gid").agg(F.count("*").alias("n"), *(F.min_by(c, "id").alias(f"o{c}") for c in AXES))
    p = members.select("gid", "id", *AXES).join(ref, "gid").select("gid", "id", "n", *(minimum_image(F.col(c) - F.col(f"o{c}"), box).cast("double").alias(c) for c in AXES))

    def corners(t: pa.Table) -> pa.Table:
        xyz = np.column_stack([t[c].to_numpy() for c in AXES])
        f = hull(xyz)
        return t.take(np.unique(f)) if len(f) else t.take(_flat_corners(xyz))

    def whole(t: pa.Table) -> pa.Table:
        xyz = np.column_stack([t[c].to_numpy() for c in AXES])
        f = hull(xyz)
        volume, area = solid_of(xyz, f) if len(f) else (0.0, 0.0)
        return pa.table({"gid": t["gid"][:1], "n": t["n"][:1], "corners": pa.array([len(np.unique(f))], pa.int64()), "faces": pa.array([len(f)], pa.int64()), "volume": [volume], "area": [area]})

    cols = ["gid", "id", "n", *AXES]
    left, ready = written(p.select(*cols), "members"), []
    while True:
        have = left.count()
        large = written(left.groupBy("gid").agg(F.count("*").alias("have")).where(F.col("have") > PART), "large")
        ready.append(left.join(large, "gid", "left_anti"))
        if large.isEmpty():
            break
        # parts of groups that are still large; a hull's corners are few against its points
        split = left.join(large, "gid").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("have") / (PART // 2)))).select(*cols, "part")
        left = written(split.groupBy("gid", "part").applyInArrow(lambda t: corners(t).select(cols), left.schema), "hulls")
        if left.count() > 0.9 * have:  # nearly all are corners: no further part would help
            ready.append(left)
            break
    p = reduce(DataFrame.unionByName, ready)
    return p.groupBy("gid").applyInArrow(whole, "gid bigint, n bigint, corners bigint, faces bigint, volume double, area double")


def _flat_corners(p: np.ndarray) -> np.ndarray:
    """All distinct points of a flat set: whether they are corners shows with the other parts."""
    return np.sort(np.unique(p, axis=0, return_index=True)[1])


# -- unions of spheres ----------------------------------------------------------------------------------
NODES, WEIGHTS = np.polynomial.legendre.leggauss(48)
TURN = 2 * math.pi


def exposed(r: float, c: np.ndarray, other: np.ndarray) -> float:
    """A third of the integral of x . n over the part of a sphere (radius r, centre c) outside of the others (offset
    of the centre, radius): the sphere's share of the union's volume. Along each circle of latitude
    the uncovered arcs are exact; over heights Gauss rules between all heights where arcs appear,
    vanish or meet."""
    d = np.sqrt((other[:, :3] ** 2).sum(1))
    if (d + r <= other[:, 3]).any():
        return 0.0
    other, d = other[(d < r + other[:, 3]) & (d + other[:, 3] > r)], d[(d < r + other[:, 3]) & (d + other[:, 3] > r)]
    u, a = other[:, :3] / d[:, None], (d * d + r * r - other[:, 3] ** 2) / (2 * r * d)
    tilt, wide = np.arccos(np.clip(u[:, 2], -1, 1)), np.arccos(np.clip(a, -1, 1))
    breaks = [np.array([-1.0, 1.0]), np.cos(tilt + wide), np.cos(tilt - wide)]
    i, j = np.triu_indices(len(d), 1)
    g = (u[i] * u[j]).sum(1)
    ok = 1 - g * g > 1e-14
    i, j, g = i[ok], j[ok], g[ok]
    det = 1 - g * g
    base = ((a[i] - g * a[j]) / det)[:, None] * u[i] + ((a[j] - g * a[i]) / det)[:, None] * u[j]
    rest = (1 - (base * base).sum(1)) / det
    ok = rest >= 0
    turn = np.sqrt(rest[ok]) * np.cross(u[i[ok]], u[j[ok]])[:, 2]
    breaks += [base[ok, 2] + turn, base[ok, 2] - turn]
    at = np.unique(np.clip(np.concatenate(breaks), -1, 1))
    mid, half = (at[1:] + at[:-1]) / 2, (at[1:] - at[:-1]) / 2
    # the sine takes the square roots at both ends of an interval away
    h = (mid[:, None] + half[:, None] * np.sin(math.pi / 2 * NODES)).ravel()
    w = (half[:, None] * (math.pi / 2 * np.cos(math.pi / 2 * NODES) * WEIGHTS)).ravel()
    rho = np.sqrt(np.maximum(1 - h * h, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        q = (a - h[:, None] * u[:, 2]) / (rho[:, None] * np.sqrt(np.maximum(1 - u[:, 2] ** 2, 0)))
    q = np.where(np.isnan(q), np.inf, q)
    arc = np.arccos(np.clip(q, -1, 1))
    start = np.where(q < 1, (np.arctan2(u[:, 1], u[:, 0]) - arc) % TURN, 0.0)
    end = start + np.where(q < 1, 2 * arc, 0.0)
    start, end = np.concatenate([start, np.zeros((len(h), 1))], 1), np.concatenate([end, np.zeros((len(h), 1))], 1)
    order = np.argsort(start, axis=1, kind="stable")
    start, end = np.take_along_axis(start, order, 1), np.take_along_axis(end, order, 1)
    run = np.maximum.accumulate(np.concatenate([end.max(1, keepdims=True) - TURN, end], 1), 1)[:, :-1]
    stop = np.maximum(start, run)
    free = (r + c[2] * h) * (stop - run).sum(1) + rho * (c[0] * (np.sin(stop) - np.sin(run)).sum(1) - c[1] * (np.cos(stop) - np.cos(run)).sum(1))
    return float(r * r / 3 * (w * free).sum())


MANY = 4096  # spheres of a key that are held at once; keys of more are dealt out in cells
PAIRS = 1 << 20  # pairs handled at once


def _ranges(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every j in lo[i] ... hi[i] - 1, in chunks of whole i."""
    ends, i = np.cumsum(hi - lo), 0
    while i < len(lo):
        done = ends[i - 1] if i else 0
        k = max(i + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        size = hi[i:k] - lo[i:k]
        yield np.repeat(np.arange(i, k), size), np.arange(ends[k - 1] - done) + np.repeat(lo[i:k] - (ends[i:k] - size - done), size)
        i = k


def shares(group: np.ndarray, c: np.ndarray, r: np.ndarray, home: np.ndarray) -> np.ndarray:
    """What the spheres (centre c, radius r) add to the volume of the union of their group (0, 1, ... in order), summed
    by group. Only spheres at `home` add, and of equal ones one. Where the caps that others cut off are
    apart or nested the share is a closed form, else exposed()."""
    total = np.zeros(int(group.max()) + 1 if len(group) else 0)
    order = np.lexsort((r, c[:, 2], c[:, 1], c[:, 0], group))
    g, c, r, home = group[order], c[order], r[order], home[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1]).any(1) | (r[1:] != r[:-1])
    g, c, r, home = g[new], c[new], r[new], home[new]
    if not len(g):
        return total
    # along x, one group after the other
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.append(first, len(g)))
    begin, most = np.repeat(first, size), np.repeat(np.maximum.reduceat(r, first), size)
    at = c[:, 0] - c[begin, 0]
    gap = at.max() + 4 * most.max()
    at += np.repeat(np.arange(len(first)), size) * gap
    near = (r + most) * (1 + 1e-9) + 1e-12 * (at[-1] + gap)
    lo = np.where(home, np.maximum(np.searchsorted(at, at - near), begin), 0)
    hi = np.where(home, np.minimum(np.searchsorted(at, at + near, "right"), begin + np.repeat(size, size)), 0)
    share = np.where(home, 4 / 3 * math.pi * r**3, 0.0)
    for i, j in _ranges(lo, hi):
        off = c[j] - c[i]
        d = np.sqrt((off**2).sum(1))
        share[i[(i != j) & (d + r[i] <= r[j])]] = 0
        cut = (share[i] > 0) & (d < r[i] + r[j]) & (d + r[j] > r[i]) & (i != j)
        i, j, off, d = i[cut], j[cut], off[cut], d[cut]
        u, a = off / d[:, None], (d * d + r[i] ** 2 - r[j] ** 2) / (2 * r[i] * d)
        wide = np.arccos(np.clip(a, -1, 1))
        start, stop = np.searchsorted(i, i), np.searchsorted(i, i, "right")
        crowd = stop - start > 64  # exposed() has these as they are
        nested, meets = np.zeros(len(i), bool), [np.flatnonzero(crowd)]
        for p, q in _ranges(np.where(crowd, 0, start), np.where(crowd, 0, stop)):
            angle = np.arctan2(np.sqrt((np.cross(u[p], u[q]) ** 2).sum(1)), (u[p] * u[q]).sum(1))
            nested[p[(p != q) & (angle + wide[p] <= wide[q] - 1e-9)]] = True
            touch = (p != q) & (angle < wide[p] + wide[q] - 1e-9)
            p, q = p[touch], q[touch]
            meets.append(p[~nested[p] & ~nested[q]])  # a sphere's caps are all in this chunk
        hard = np.zeros(len(r), bool)
        hard[i[np.concatenate(meets)]] = True
        plain = ~nested & ~hard[i]
        cap = math.pi * r[i] ** 2 / 3 * (2 * r[i] * (1 - a) + (c[i] * u).sum(1) * (1 - a * a))
        np.subtract.at(share, i[plain], cap[plain])
        for k in np.flatnonzero(hard):
            mine = np.arange(np.searchsorted(i, k), np.searchsorted(i, k, "right"))
            mine = mine[~nested[mine]]
            share[k] = exposed(float(r[k]), c[k], np.column_stack([off[mine], r[j[mine]]]))
    return np.bincount(g, share, len(total))


def _unions(spheres: DataFrame, key: str) -> DataFrame:
    """(key, volume, caps): volumes of the union of each key's spheres (key, x, y, z, r, cap) and of that of those with
    `cap` alone. Spheres are shuffled once, by key; those of keys with over MANY go to the cells, 16 largest radii
    wide, that their reach meets, so a long chain is spread over many tasks. `spheres` is read three times."""
    s = spheres.where("r > 0").select(key, *AXES, "r", "cap").na.drop()
    kind = s.schema[key].dataType.simpleString()
    counts = s.groupBy(key).agg(F.count("*").alias("many"), F.max("r").alias("most"))
    counts = written(counts.withColumn("large", F.col("many") > MANY).groupBy("large", F.when(F.col("large"), F.col(key)).alias(key)).agg(F.sum("many").alias("many"), F.max("most").alias("most")), "large")
    large, cell = counts.where("large").select(key, "most"), [f"i{c}" for c in AXES]

    def run(whole: bool):
        def solved(t: pa.Table, first: np.ndarray) -> pa.RecordBatch:
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, t.num_rows)))
            c, r = np.column_stack([t[a].to_numpy().astype(float) for a in AXES]), t["r"].to_numpy().astype(float)
            home, cap = (t[a].to_numpy(zero_copy_only=False).astype(bool) for a in ("home", "cap"))
            if whole:  # all of a key: from its first sphere on, which costs fewer digits
                c = c - c[first][group]
            caps = np.zeros(len(first))
            some = shares(group[cap], c[cap], r[cap], home[cap])
            caps[: len(some)] = some
            return pa.RecordBatch.from_arrays([t[key].combine_chunks().take(pa.array(first)), pa.array(shares(group, c, r, home)), pa.array(caps)], [key, "volume", "caps"])

        def starts(t: pa.Table) -> np.ndarray:
            ids = np.column_stack([t[key].combine_chunks().dictionary_encode().indices.to_numpy(), *(t[a].to_numpy() for a in cell)])
            return np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(1)]))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                if batch.num_rows:
                    t = pa.Table.from_batches([batch])
                    held = t if held is None else pa.concat_tables([held, t])
                    first = starts(held)
                    if len(first) > 1:
                        yield solved(held.slice(0, int(first[-1])), first[:-1])
                        held = held.slice(int(first[-1]))
            if held is not None:
                yield solved(held, starts(held))

        return each

    schema = f"{key} {kind}, volume double, caps double"
    sizes = {r["large"]: r["many"] for r in counts.groupBy("large").agg(F.sum("many").alias("many")).collect()}
    tasks = lambda many: max(1, min(2000, -(-many // 4000)))
    small = s if True not in sizes else s.join(large, key, "left_anti")
    small = small.repartition(tasks(sizes.get(False, 0)), key).sortWithinPartitions(key).select("*", *(F.lit(0).alias(i) for i in cell), F.lit(True).alias("home"))
    out = small.mapInArrow(run(True), schema)
    if True in sizes:
        side, reach, rows = 16.0 * F.col("most"), F.col("r") + F.col("most"), s.join(large, key)
        own = F.lit(True)
        for c, i in zip(AXES, cell, strict=True):
            rows = rows.withColumn(i, F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))))
            own &= F.col(i) == F.floor(F.col(c) / side)
        rows = rows.select(key, *AXES, "r", "cap", *cell, own.alias("home"))
        rows = rows.repartition(tasks(sizes[True]), key, *cell).sortWithinPartitions(key, *cell)
        out = out.unionByName(rows.mapInArrow(run(False), schema).groupBy(key).agg(F.sum("volume").alias("volume"), F.sum("caps").alias("caps")))
    return out


def union_volumes(spheres: DataFrame, key: str) -> DataFrame:
    """(key, volume) of the union of each key's spheres (key, x, y, z, r > 0; not periodic: unwrapped)."""
    return _unions(spheres.withColumn("cap", F.lit(False)), key).select(key, "volume")


def tube_volumes(nodes: DataFrame, ends: DataFrame, r: float, key: str = "fil") -> DataFrame:
    """(key, volume): what the spheres of radius r around nodes (key, x, y, z unwrapped) add to the end spheres
    (key, x, y, z, r): the union of all less the union of the ends."""
    around = nodes.select(key, *(F.col(c).cast("double") for c in AXES), F.lit(float(r)).alias("r"), F.lit(False).alias("cap"))
    caps = written(ends.select(key, *(F.col(c).cast("double") for c in AXES), F.col("r").cast("double"), F.lit(True).alias("cap")), "caps")
    return _unions(around.unionByName(caps), key).select(key, F.greatest(F.col("volume") - F.col("caps"), F.lit(0.0)).alias("volume"))
