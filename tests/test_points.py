"""The point-catalogue operators: hand cases, brute force, and SQL twins at the smallest scale."""

import glob
import math
import os
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry_points
from skyloom.functions import geometry as g
from skyloom.operators import blocks, controls, graph, halos, polyline, profiles, rangejoin, stacking
from skyloom.plans import catalog
from skyloom.plans.catalog import ORACLES, QUERIES
from skyloom.sources import fixtures, snapshots

SF = "/root/testdata/sf0.001"


def points(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, x bigint, y bigint, z bigint")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", ["jn2_range_self_join", "gr2_fof_groups", "gr3_nested_fof", "ag2_to_ag9_halo_properties", "ag6_overdensity_radius", "poly3_poly4_poly5_properties", "jn13_nearest_piece", "ag17_ag18_shell_profile", "topk1_nearest", "ag31_ag32_quantile_jackknife"])
def test_sql_twin(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (p[columns].sort_values(columns).reset_index(drop=True) for p in (got, want))
    assert len(got) == len(want)
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("rows, r, box, want", [
    ([(1, 0, 0), (999, 0, 0)], 3, 1000, {(0, 1, 4)}),
    ([(0, 0, 0), (10, 0, 0)], 10, 1000, set()),
    ([(0, 0, 0), (10, 0, 0), (0, 15, 0)], 20, 40, {(0, 1, 100), (0, 2, 225), (1, 2, 325)}),
    ([(0, 0, 0), (10, 0, 0)], 30, 30, {(0, 1, 100)}),
])
def test_pairs(spark, rows, r, box, want):
    assert {tuple(x) for x in rangejoin.range_self_join(points(spark, rows), r, box).collect()} == want


def test_chain_and_nested(spark):
    p = points(spark, [(9 * i, 0, 0) for i in range(5)])
    assert {(r.id, r.gid, r.n) for r in graph.fof(p, 10, 1000, 5).collect()} == {(i, 0, 5) for i in range(5)}
    assert graph.fof(p, 10, 1000, 6).count() == 0
    two = points(spark, [(0, 0, 0), (5, 0, 0), (17, 0, 0), (22, 0, 0)])
    got = {(r.level, r.id, r.gid, r.save) for r in graph.nested_fof(two, [("o", 15), ("i", 6)], 1000, 2).collect()}
    assert got == {("o", i, 0, 0) for i in range(4)} | {("i", 0, 0, 0), ("i", 1, 0, 0), ("i", 2, 2, 0), ("i", 3, 2, 0)}


def test_spanning_forest(spark):
    rng = np.random.default_rng(3)
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 40, (120, 2)) if a != b})
    rows = [(a, b, float(rng.integers(0, 6))) for a, b in edges]
    root = list(range(40))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    want = set()
    for w, a, b in sorted((w, a, b) for a, b, w in rows):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, w))
    df = spark.createDataFrame(rows, "i bigint, j bigint, w double")
    got = [tuple(r) for r in graph.spanning_forest(df, F.col("w")).collect()]
    assert set(got) == want and len(got) == len(want)


def polylines(spark, *lines):
    return spark.createDataFrame([(f, k, *p) for f, line in enumerate(lines) for k, p in enumerate(line)], "fil bigint, k bigint, x bigint, y bigint, z bigint")


def test_polylines(spark):
    n = polylines(spark, [(10 * k, 0, 0) for k in range(5)], [(0, 0, 0), (10, 0, 0), (10, 10, 0)], [(995, 0, 0), (5, 0, 0)])
    got = {r.fil: r for r in polyline.properties(n, 1000).collect()}
    assert (got[0].len, got[0].elong, got[0].rms) == (40, 1, 0)
    assert got[1].len == 20 and math.isclose(got[1].elong, math.sqrt(2) / 2) and math.isclose(got[1].rms, math.sqrt(50 / 3))
    assert got[2].len == 10
    again = polyline.resampled(n, 1000, 5).where("fil = 0").orderBy("i").collect()
    assert [r.x for r in again] == [0, 10, 20, 30, 40]
    longer = {r.k: r.x for r in polyline.prolonged(n, 1000, 10).where("fil = 0").collect()}
    assert longer[-1] == 990 and longer[6] == 60 and len(longer) == 9


def test_nearest_piece_tie(spark):
    n = polylines(spark, [(0, 0, 0), (20, 0, 0), (20, 20, 0)])
    p = points(spark, [(15, 5, 0)]).selectExpr("*", "1 as vx", "0 as vy", "0 as vz")
    r = profiles.nearest_piece(p, n, 30, 1000).collect()
    assert len(r) == 1 and r[0].k == 0 and r[0].perp2 == 25 and r[0].along == 15


def test_axes(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3, 3))
    m = a @ a.T
    df = spark.createDataFrame([tuple(float(m[i, j]) for i in range(3) for j in range(i, 3))], "mxx double, mxy double, mxz double, myy double, myz double, mzz double")
    r = halos.axes_of(df).first()
    assert np.allclose([r.aa, r.bb, r.cc], np.sqrt(np.linalg.eigvalsh(m)[::-1]))


def test_jackknife_median(spark):
    for n in (3, 8, 9):
        x = np.random.default_rng(n).normal(size=n)
        leave = np.array([np.median(np.delete(x, i)) for i in range(n)])
        df = spark.createDataFrame([(1, float(v)) for v in x], "q int, v double")
        r = stacking.jackknife_median(df, "v", ["q"]).first()
        assert math.isclose(r.error, math.sqrt((n - 1) / n * ((leave - leave.mean()) ** 2).sum()), rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(r.estimate, n * np.median(x) - (n - 1) * leave.mean(), rel_tol=1e-9)


def test_bins_and_lens(spark):
    edges = g.log_edges(10, 1, 4)
    assert len(edges) == 5 and math.isclose(edges[-1], 1) and edges[0] == 100
    r = spark.range(1).select(g.ring(F.lit(99.0), edges).alias("a"), g.ring(F.lit(100.0), edges).alias("b"), g.ring(F.lit(0.5), edges).alias("c"), profiles.lens_volume(F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("v")).first()
    assert (r.a, r.b, r.c) == (0, -1, 4)
    rng = np.random.default_rng(0).uniform(-3, 3, (200_000, 3))
    inside = ((rng**2).sum(1) < 4) & (((rng - [4, 0, 0]) ** 2).sum(1) < 9)
    assert abs(r.v - inside.mean() * 216) < 0.4


def test_mass_matched(spark):
    pairs = QUERIES["rn4_mass_matched_pairs"](spark, SF)
    mass = {r.id: r.numpart for r in fixtures.halos(spark, SF).collect()}
    rows = pairs.collect()
    assert rows and all(mass[r.a] == mass[r.ra] and mass[r.b] == mass[r.rb] for r in rows)


@pytest.mark.parametrize("layout", [1, 2])
def test_snapshot_round_trip(spark, tmp_path, layout):
    p = {"id": np.arange(50), **{c: np.arange(50) * 0.5 + i for i, c in enumerate(("x", "y", "z", "vx", "vy", "vz"))}}
    for i in range(2):
        (tmp_path / f"snap.{i}").write_bytes(snapshots.write_snapshot({k: v[25 * i : 25 * i + 25] for k, v in p.items()}, 1000.0, layout))
    rows = snapshots.read_snapshot(spark, f"{tmp_path}/snap.*", layout, position=2.0).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(50)) and [r.x for r in rows] == [float(i) for i in range(50)]
    assert snapshots.read_snapshot(spark, f"{tmp_path}/snap.*", layout, columns=("id", "z")).columns == ["id", "z"]


def test_exists_within(spark):
    probes, pts = points(spark, [(0, 0, 0), (500, 500, 500)]), points(spark, [(996, 0, 0)])
    assert [r.id for r in rangejoin.exists_within(probes, pts.drop("id"), 5, 1000).collect()] == [0]


def test_nearest_k(spark):
    rng = np.random.default_rng(5)
    pts = [tuple(int(v) for v in p) for p in rng.integers(0, 100, (60, 3))]
    p, c = points(spark, pts), points(spark, [(1, 1, 1), (50, 50, 50)])
    got = {(r.centre, r["rank"]): r.point for r in rangejoin.nearest_k(p, c, 7, 5.0, 100).collect()}
    for j, q in enumerate([(1, 1, 1), (50, 50, 50)]):
        d = sorted((sum(min(abs(a - b), 100 - abs(a - b)) ** 2 for a, b in zip(q, x, strict=True)), i) for i, x in enumerate(pts))
        assert [got[j, r + 1] for r in range(7)] == [i for _, i in d[:7]]
    assert len(got) == 14


def joins(df):
    return set(re.findall(r"\w+Join\b", df._jdf.queryExecution().executedPlan().toString()))


def test_exploded_tables_are_not_broadcast(spark, tmp_path, monkeypatch):
    """A small file, 27 times as many rows in its cells: Spark judges by the file."""
    spark.range(1000).selectExpr("id", "id * 7919 % 1000 AS x", "id * 31 % 1000 AS y", "id * 577 % 1000 AS z").write.parquet(f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    rows = graph.fof(p, 140, 1000, 2)
    for df in (rangejoin.range_join(p, p, 140, 1000), rangejoin.exists_within(p, p, 140, 1000), rangejoin.cell_candidates(p, p.withColumnRenamed("id", "fil"), 140, 1000, "fil"), rangejoin.range_self_join(p, 140, 1000), rows):
        assert not joins(df) - {"SortMergeJoin"}
    found, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: found.append(joins(df)) or write(df, name))
    assert graph.fof(p, 140, 1000, 2).count() == rows.count() > 0
    assert set().union(*found) == {"SortMergeJoin"}


def test_tubes_are_sought_around_their_middles(spark, monkeypatch):
    """Against brute force, across faces of the box; the search reaches no farther than a tube's corners."""
    rng = np.random.default_rng(5)
    pts, start, way = rng.integers(0, 100, (400, 3)), rng.integers(0, 100, (20, 3)), rng.normal(size=(20, 3))
    way, long = way / np.sqrt((way**2).sum(1, keepdims=True)), rng.uniform(3, 12, 20)
    rays = spark.createDataFrame([("left", *map(int, s), *map(float, e), float(d)) for s, e, d in zip(start, way, long, strict=True)], "side string, x bigint, y bigint, z bigint, ex double, ey double, ez double, d double")
    reach, join = [], profiles.range_join
    monkeypatch.setattr(profiles, "range_join", lambda *a, **k: reach.append(a[2]) or join(*a, **k))
    got = {(x["ix"], x["iy"]): x["n"] for x in profiles.direction_matrix(points(spark, pts.tolist()), rays, 8, 12, [64.0, 16.0], 2, 1, 100).collect() if x["side"] == "left"}
    off = (pts[None] - start[:, None] + 50) % 100 - 50
    along = (off * way[:, None]).sum(2)
    perp2 = (off * off).sum(2) - along**2
    want = {(ix, iy): int(((along >= 0) & (along < long[:, None]) & (np.floor(along / long[:, None] * 2) == ix) & ((perp2 < 16) if iy else (perp2 < 64) & (perp2 >= 16))).sum()) for ix in (0, 1) for iy in (0, 1)}
    assert got == {k: v for k, v in want.items() if v} and len(got) == 4
    assert reach[0] < 10.01


def test_group_joins_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Nearly as many groups as members: a broadcast table of them is built in the driver. Queries that read
    members more than once read them from one table."""
    spark.range(1000).selectExpr("id DIV 3 AS gid", "id", *(f"id * {k} % 1000 AS {c}" for c, k in zip(("x", "y", "z", "vx", "vy", "vz"), (7919, 31, 577, 3, 5, 7), strict=True))).write.parquet(f"{tmp_path}/m")
    m = spark.read.parquet(f"{tmp_path}/m")
    for df in (halos.properties(m, 1000), halos.kinetic_energy(m, 1000), halos.overdensity_radius(m, 1000, 0.1), halos.potential(m, 1000, 1.0), halos.spin(m, 1000, 1.0)):
        assert joins(df) == {"SortMergeJoin"}
    made, members = [], catalog.members
    monkeypatch.setattr(catalog, "members", lambda *a: made.append(a) or members(*a))
    for name in ("ag2_to_ag9_halo_properties", "ag5_angular_momentum", "ag6_overdensity_radius", "ag8_long_axis", "ag8_shape_tensor", "ag9_kinetic_energy", "ag10_most_bound", "ag10_potential", "flt7_single_group"):
        scans = re.findall(r"Location: InMemoryFileIndex.*?/(members|orders)", QUERIES[name](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        assert set(scans) == {"members"}, name
    assert len(made) == 9


def test_blocks_meet_every_pair_once(spark):
    """Brute force across faces, with a block of so many points that it is dealt out in parts; extended rows are not
    exploded to cells, and pairs are not joined by Spark."""
    rng = np.random.default_rng(7)
    pts, rows = (np.concatenate([rng.integers(0, 100, (n, 3)), rng.integers(96, 104, (m, 3)) % 100]) for n, m in ((60, 90), (30, 10)))
    p, q = points(spark, pts.tolist()), points(spark, rows.tolist())
    q = q.select("*", *((F.col(c) - 9).alias(f"l{c}") for c in "xyz"), *((F.col(c) + 9).alias(f"h{c}") for c in "xyz"))

    def kernel(a, b):
        at, to = blocks.columns(a, *"xyz"), blocks.columns(b, *"xyz")
        got = [(r, i) for r, i in blocks.Grid(at, 100, 9).candidates(to - 9, to + 9)]
        r, i = (np.concatenate([x[c] for x in got] or [np.zeros(0, int)]) for c in (0, 1))
        near = (blocks.image(at[i] - to[r], 100) ** 2).sum(1) < 81
        return pa.table({"a": a["id"].take(pa.array(i[near])), "b": b["id"].take(pa.array(r[near]))})

    got = [tuple(x) for x in blocks.blocked(p, q, 100, kernel, T.StructType([T.StructField(c, T.LongType()) for c in "ab"]), 6).collect()]
    off = (pts[:, None] - rows[None] + 50) % 100 - 50
    assert sorted(got) == sorted(map(tuple, np.argwhere((off * off).sum(2) < 81).tolist())) and len(got) > 100


def test_nearest_piece_shuffles_no_pairs(spark):
    p = points(spark, [(5, 5, 5)]).selectExpr("*", "1 AS vx", "1 AS vy", "1 AS vz")
    n = spark.createDataFrame([(1, 0, 1, 5, 5), (1, 1, 9, 5, 6)], "fil long, k long, x long, y long, z long")
    near = profiles.nearest_piece(p, n, 5, 100)
    assert not joins(near) and near.columns == list(profiles.PROJECTED) and near.count() == 1
    matrix = spark.createDataFrame([(1, 0, 1, 5, 2.0)], "fil long, ix int, iy int, n long, v double")
    dense = profiles.densified(matrix, 2, 2)
    assert not joins(dense)  # the matrix is read once
    assert sorted(map(tuple, dense.collect())) == [(1, 0, 0, 0, 0.0), (1, 0, 1, 5, 2.0), (1, 1, 0, 0, 0.0), (1, 1, 1, 0, 0.0)]


def test_ratio_profile_reads_each_side_once(spark):
    rows = spark.createDataFrame([(1, 0, 2.0), (1, 0, 0.5), (1, 1, 2.0)], "fil long, k long, perp2 double")
    out = profiles.ratio_profile(rows, rows, [4.0, 1.0], 10.0)
    assert not joins(out) and sorted(map(tuple, out.collect())) == [(1, 0, 10.0, 1), (1, 1, 10.0, 1)]


def test_fixings_in_blocks_equal_rays_of_all_pairs(spark, monkeypatch):
    """Nodes and particles that share places, rows without a place or an id; no pair and no ray is joined by Spark."""
    rng = np.random.default_rng(11)
    at, pts = rng.integers(0, 100, (60, 3)), rng.integers(0, 100, (500, 3))
    rows = [(k * 7, *map(int, p)) for k, p in enumerate(np.concatenate([at, at[:30], at[:30]]))]
    nodes = spark.createDataFrame([*rows, (3, None, 1, 1), (None, 1, 2, 3)], "id long, x long, y long, z long")
    p = points(spark, [*pts.tolist(), *pts[:200].tolist()])
    near = rangejoin.range_join(nodes, nodes, 12, 100, p="b_", c="a_").where("a_id < b_id and d2 >= 16")
    pairs = near.select((F.col("a_id") * 1000003 + F.col("b_id")).alias("id"), *(F.col(f"{e}_{c}").alias(f"{e}{c}") for e in "ab" for c in "xyz"), F.sqrt(F.col("d2").cast("double")).alias("d"))
    want = profiles.direction_matrix(p, controls.fixings(pairs, 3), 8, 12, [64.0, 16.0], 2, 3, 100)
    monkeypatch.setattr(profiles, "NODES", 20)
    got = profiles.fixing_matrix(p, nodes, 4, 12, 3, [64.0, 16.0], 2, 100)
    key = lambda df: {(r["side"], r["ix"], r["iy"]): r["n"] for r in df.collect()}
    assert not joins(got) and key(got) == pytest.approx(key(want)) and len(key(got)) == 12
    assert not profiles.fixing_matrix(p, nodes.where("id < 0"), 4, 12, 3, [64.0, 16.0], 2, 100).count()
    assert "Join" not in QUERIES["ag26_ag27_direction_matrix"](spark, SF)._jdf.queryExecution().executedPlan().toString()
