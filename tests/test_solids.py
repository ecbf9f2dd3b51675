"""Voronoi cells, hulls and unions of spheres against closed forms, invariants and sampling."""

import math
import random
import re

import numpy as np
import pytest

from skyloom.operators import profiles, rangejoin, solids

BOX = 100.0


def ball(r):
    return 4 / 3 * math.pi * r**3


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(5)
    rows = [(i, *(rng.uniform(0, BOX) for _ in range(3))) for i in range(150)]
    rows += [(900, *rows[3][1:]), (901, None, 1.0, 1.0), (None, 1.0, 2.0, 3.0)]  # a copy, and rows without a place or an id
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    return rows[:150], points, {r.id: r for r in solids.voronoi(points, BOX, 24).collect()}


def test_cells_fill_the_box(cells):
    rows, _, got = cells
    assert sorted(got) == [r[0] for r in rows]
    assert sum(r.volume for r in got.values()) == pytest.approx(BOX**3, rel=1e-9)
    assert all(a in got[b].neighbours for a in got for b in got[a].neighbours if a != b)


def test_cells_hold_the_nearest_places(cells):
    rows, _, got = cells
    at = np.array([r[1:] for r in rows])
    probe = np.random.default_rng(2).uniform(0, BOX, (60_000, 3))
    d = np.zeros((len(probe), len(at)))
    for c in range(3):
        off = np.abs(probe[:, None, c] - at[None, :, c])
        d += np.minimum(off, BOX - off) ** 2
    share = np.bincount(d.argmin(1), minlength=len(at)) / len(probe)
    volume = np.array([got[r[0]].volume for r in rows]) / BOX**3
    assert np.abs(share - volume).max() < 5 * math.sqrt(volume.max() / len(probe))


def test_few_points(spark):
    one = spark.createDataFrame([(1, 5.0, 5.0, 5.0)], "id long, x double, y double, z double")
    assert solids.voronoi(one, BOX).first().volume == pytest.approx(BOX**3)
    two = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 30.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert [(r.id, round(r.volume, 3), 3 - r.id in r.neighbours) for r in solids.voronoi(two, BOX).orderBy("id").collect()] == [(1, 500_000.0, True), (2, 500_000.0, True)]
    assert solids.voronoi(one.where("id < 0"), BOX).count() == 0


def test_edges_stay_in_their_group(spark, cells):
    rows, points, got = cells
    group = spark.createDataFrame([(r[0], r[0] % 3) for r in rows], "id long, gid long")
    table = spark.createDataFrame([(i, r.neighbours) for i, r in got.items()], "id long, neighbours array<long>")
    expected = {(a, b) for a in got for b in got[a].neighbours if a < b and a % 3 == b % 3}
    edges = [tuple(r) for r in solids.voronoi_edges(table, group).collect()]
    assert len(edges) == len(set(edges)) and set(edges) == expected


def test_relaxed_points_are_the_corners_means(cells):
    _, points, got = cells
    moved = {r.id: (r.x, r.y, r.z) for r in solids.relaxed(points, BOX, 1).collect()}
    assert sorted(moved) == sorted(got)
    assert all(moved[i] == pytest.approx((r.cx, r.cy, r.cz), abs=1e-6) for i, r in got.items())


def test_hulls(spark, monkeypatch):
    monkeypatch.setattr(solids, "PART", 256)
    rng = random.Random(3)
    rows = [(1, i, (98 + i % 5) % 100, i // 5 % 4, i // 20 % 3) for i in range(60)]  # a block across the box's face
    rows += [(2, i, i % 7, i // 7, 4) for i in range(40)]  # flat
    rows += [(3, 0, 1, 1, 1), (4, 0, 2, 2, 2), (4, 1, 2, 2, 2)]  # a point, and a point twice
    rows += [(5, i, rng.randint(0, 40), rng.randint(0, 40), rng.randint(0, 40)) for i in range(500)]  # in parts
    members = spark.createDataFrame(rows, "gid long, id long, x long, y long, z long")
    got = {r.gid: r for r in solids.convex_hulls(members, 100).collect()}
    assert (got[1].volume, got[1].area, got[1].n) == (pytest.approx(24.0), pytest.approx(52.0), 60)
    assert [(got[i].faces, got[i].volume) for i in (2, 3, 4)] == [(0, 0.0)] * 3
    p = np.array([r[2:] for r in rows if r[0] == 5], float)
    f = solids.hull(p)
    assert got[5].volume == pytest.approx(solids.solid_of(p, f)[0]) and got[5].n == 500
    assert got[5].corners - got[5].faces // 2 == 2  # Euler
    n = np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]])
    assert ((p @ n.T) <= (n * p[f[:, 0]]).sum(1) + 1e-6).all()  # every point is inside of every face
    assert solids.convex_hulls(members.where("gid > 9"), 100).count() == 0


def test_unions(spark):
    rows = [(1, 0.0, 0.0, 0.0, 1.0), (1, 1.3, 0.2, 0.4, 1.2), (2, 50.0, 1.0, 1.0, 2.0), (2, 50.0, 1.0, 1.0, 2.0), (2, 50.0, 1.5, 1.0, 1.0), (3, 0.0, 0.0, 0.0, 1.0), (3, 9.0, 0.0, 0.0, 1.5), (4, 0.0, 0.0, 0.0, None)]
    rows += [(5, *(random.Random(i).uniform(20, 23) for _ in range(3)), 0.5 + i % 7 / 10) for i in range(12)]
    spheres = spark.createDataFrame(rows, "fil long, x double, y double, z double, r double")
    got = {r.fil: r.volume for r in solids.union_volumes(spheres, "fil").collect()}
    d = math.sqrt(1.3**2 + 0.2**2 + 0.4**2)
    from pyspark.sql import functions as F

    lens = spark.range(1).select(profiles.lens_volume(F.lit(1.0), F.lit(1.2), F.lit(d))).first()[0]
    assert got[1] == pytest.approx(ball(1) + ball(1.2) - lens, rel=1e-9)
    assert got[2] == pytest.approx(ball(2.0)) and got[3] == pytest.approx(ball(1) + ball(1.5)) and 4 not in got
    x = np.random.default_rng(1).uniform(18, 25, (400_000, 3))
    inside = np.zeros(len(x), bool)
    for r in rows[8:]:
        inside |= ((x - np.array(r[1:4])) ** 2).sum(1) < r[4] ** 2
    assert got[5] == pytest.approx(7**3 * inside.mean(), rel=0.02)
    ends = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (3, 0.0, 0.0, 0.0, 30.0)], "fil long, x double, y double, z double, r double")
    tubes = {r.fil: r.volume for r in solids.tube_volumes(spheres.where("fil in (1, 3)").drop("r"), ends, 1.0).collect()}
    lens = spark.range(1).select(profiles.lens_volume(F.lit(1.0), F.lit(1.0), F.lit(d))).first()[0]
    assert tubes == {1: pytest.approx(ball(1) - lens), 3: 0.0}
    assert solids.union_volumes(spheres.where("fil > 9"), "fil").count() == 0


def test_voronoi_joins_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Files of neighbours are far smaller than their rows; a broadcast table is built in the driver."""
    rng = random.Random(6)
    spark.createDataFrame([(i, *(rng.uniform(0, BOX) for _ in range(3))) for i in range(60)], "id long, x double, y double, z double").write.parquet(f"{tmp_path}/p")
    points, found = spark.read.parquet(f"{tmp_path}/p"), []
    for module in (solids, rangejoin):
        monkeypatch.setattr(module, "written", lambda df, name, write=module.written: found.append(df) or write(df, name))
    cells = solids.voronoi(points, BOX, 12)
    found.append(solids.voronoi_edges(cells, points.selectExpr("id", "id % 2 AS gid")))
    used = set().union(*(re.findall(r"\w+Join\b", df._jdf.queryExecution().executedPlan().toString()) for df in found))
    assert used == {"SortMergeJoin"} and found[-1].count() > 0


def test_unions_share_no_exploded_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    group, c, r = np.repeat(np.arange(40), 6), rng.integers(0, 40, (240, 3)).astype(float), rng.choice([3.0, 8.0, 20.0], 240)
    want = np.zeros(40)
    for k in range(40):
        own = sorted({(*x, y) for x, y in zip(c[group == k].tolist(), r[group == k].tolist(), strict=True)})
        for x in own:
            near = [(*(np.array(y[:3]) - x[:3]), y[3]) for y in own if y != x and math.dist(x[:3], y[:3]) < x[3] + y[3]]
            want[k] += solids.exposed(x[3], np.array(x[:3]), np.array(near, dtype=float).reshape(-1, 4))
    assert solids.shares(group, c, r, np.ones(240, bool)) == pytest.approx(want, rel=1e-8)
    spheres = spark.createDataFrame([(int(g), *x, y) for g, x, y in zip(group, c.tolist(), r.tolist(), strict=True)], "fil bigint, x double, y double, z double, r double")
    out = solids.union_volumes(spheres, "fil")
    assert "explode" not in out._jdf.queryExecution().toString()  # a sphere is shuffled once
    assert {x.fil: x.volume for x in out.collect()} == pytest.approx(dict(enumerate(want)), rel=1e-8)
    long = spark.range(60).selectExpr("7L as fil", "id * 9D as x", "pmod(id * 7, 11) * 1D as y", "0D as z", "if(id % 3 = 0, 3D, 8D) as r")
    whole = solids.union_volumes(long, "fil").collect()
    monkeypatch.setattr(solids, "MANY", 20)
    assert solids.union_volumes(long, "fil").collect()[0].volume == pytest.approx(whole[0].volume, rel=1e-8)


def test_cells_are_cut_in_blocks(spark, monkeypatch):
    """No table of neighbours is made and shuffled. A lattice, whose planes meet in common lines and whose corners in more
    than three planes; and a dense group in thin surroundings."""
    names, write = [], solids.written
    for module in (solids, rangejoin):
        monkeypatch.setattr(module, "written", lambda df, name: names.append((name, df._jdf.queryExecution().toString())) or write(df, name))
    monkeypatch.setattr(solids, "CELLS", 30, raising=False)
    lattice = spark.range(216).selectExpr("id", "id % 6 * 100D / 6 + 5 AS x", "id DIV 6 % 6 * 100D / 6 + 5 AS y", "id DIV 36 * 100D / 6 + 5 AS z")
    got = solids.voronoi(lattice, BOX).collect()
    assert len(got) == 216 and all(c.volume == pytest.approx(BOX**3 / 216) and len(c.neighbours) == 6 for c in got)
    at = {r.id: (r.x, r.y, r.z) for r in lattice.collect()}
    assert all((c.cx, c.cy, c.cz) == pytest.approx(at[c.id], abs=1e-6) for c in got)
    rng = np.random.default_rng(8)
    places = np.concatenate([rng.normal(99, 1.5, (250, 3)) % BOX, rng.uniform(0, BOX, (250, 3))])
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "id long, x double, y double, z double")
    cells = {c.id: c for c in solids.voronoi(rows, BOX).collect()}
    assert sorted(cells) == list(range(500)) and sum(c.volume for c in cells.values()) == pytest.approx(BOX**3, rel=1e-9)
    assert all(a in cells[b].neighbours for a in cells for b in cells[a].neighbours)
    assert {n for n, _ in names} <= {"sites", "cells", "uncertain"} and not any("Window" in plan for _, plan in names)
