"""Ends, trees, slices, random controls and names against hand-made cases and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions.geometry import hashed_uniform
from skyloom.operators import controls, graph, polyline, profiles, rangejoin
from skyloom.sources.naming import RunParameters, name_flags, unfinished, write_groups

# a junction 0 with branches of 1 (1), 2 (2, 3) and 6 (4..9) nodes
Y = [(0, 1), (0, 2), (2, 3), (0, 4), *((i, i + 1) for i in range(4, 9))]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def forest(spark, edges):
    return spark.createDataFrame(edges, "i long, j long")


def masses(spark, heavy=()):
    return spark.createDataFrame([(i, 900 if i in heavy else 10) for i in range(10)], "id long, numpart long")


def test_pruning_short_branches(spark):
    """The first pass takes the branch of one node; then no junction is left, and passes end."""
    assert rows(graph.pruned(forest(spark, Y), masses(spark), 4)) == sorted(e for e in Y if e != (0, 1))


@pytest.mark.parametrize("heavy", [1, 0])
def test_pruning_is_stopped_by_heavy_nodes(spark, heavy):
    assert rows(graph.pruned(forest(spark, Y), masses(spark, {heavy}), 4, 500)) == sorted(Y)


def test_pruning_takes_short_paths_and_nothing_from_nothing(spark):
    assert rows(graph.pruned(forest(spark, [(1, 2)]), masses(spark), 1)) == []
    assert rows(graph.pruned(forest(spark, []), masses(spark), 3)) == []


def test_rooting_at_the_heaviest(spark):
    got = {r["id"]: (r["root"], r["parent"], r["depth"]) for r in graph.rooted(forest(spark, Y), masses(spark, {9})).collect()}
    assert got[9] == (9, None, 0) and got[8] == (9, 9, 1) and got[0] == (9, 4, 6) and got[3] == (9, 2, 8) and len(got) == 10
    assert graph.rooted(forest(spark, []), masses(spark)).count() == 0


def test_admissible_edges_need_points_all_along(spark):
    e = spark.createDataFrame([(1, 2, 0, 0, 0, 10, 0, 0, 10.0, 1), (3, 4, 0, 50, 0, 10, 0, 0, 10.0, 1)], "i long, j long, x long, y long, z long, ex long, ey long, ez long, d double, sub long")
    pts = spark.createDataFrame([(x, 0, 0, 1) for x in range(0, 11, 2)] + [(x, 50, 0, 1) for x in (0, 2, 10)], "x long, y long, z long, sub long")
    assert rows(graph.admissible(e, pts, 2.0, 1.0, 100, "sub")) == [(1, 2)]


def test_admissible_pairs_in_blocks_equal_admissible_edges(spark):
    rng = random.Random(4)
    halos = [(k, rng.randrange(100), rng.randrange(100), rng.randrange(100), k % 2) for k in range(120)]
    halos += [(k + 500, *h[1:]) for k, h in enumerate(halos[:40])]  # copies at the same places
    nodes = spark.createDataFrame(halos, "id bigint, x bigint, y bigint, z bigint, sub bigint")
    pts = spark.createDataFrame([(rng.randrange(100), rng.randrange(100), rng.randrange(100), k % 2) for k in range(3000)], "x bigint, y bigint, z bigint, sub bigint")
    near = rangejoin.range_join(nodes, nodes, 30, 100, p="b_", c="a_").where("a_id < b_id and a_sub = b_sub")
    e = near.select(F.col("a_id").alias("i"), F.col("b_id").alias("j"), *(F.col(f"a_{c}").alias(c) for c in "xyz"), *(v.alias(f"e{c}") for c, v in zip("xyz", rangejoin.offsets("a_", "b_", 100), strict=True)), F.sqrt(F.col("d2").cast("double")).alias("d"), F.col("a_sub").alias("sub"))
    want = sorted(rows(graph.admissible(e, pts, 7.5, 6.0, 100, "sub")))
    assert want and sorted(rows(graph.admissible_pairs(nodes, pts, 30, 7.5, 6.0, 100, "sub"))) == want
    assert rows(graph.admissible_pairs(nodes.limit(0), pts, 30, 7.5, 6.0, 100, "sub")) == []


def test_reach_changes_no_pair(spark):
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(rng.integers(0, 100, (300, 3)))], "id long, x long, y long, z long")
    want = None
    for reach in (1, 2, 3):
        got = rows(rangejoin.range_join(pts, pts, 13, 100, reach=reach).select("p_id", "c_id", "d2"))
        want = want or got
        assert got == want and len(got) > 300


def test_draws_of_two_seeds_are_independent(spark):
    got = spark.range(20000).select(hashed_uniform(F.col("id"), 1).alias("u"), hashed_uniform(F.col("id"), 2).alias("v")).toPandas()
    shift = (got.v - got.u) % 1
    assert np.histogram2d(got.u, got.v, 10)[0].min() > 120 and shift.std() > 0.25


def test_uniform_points_fill_the_box(spark):
    got = controls.uniform_points(spark, 27000, 30).toPandas()
    assert got.groupby([got.x // 10, got.y // 10, got.z // 10]).size().between(800, 1200).all()


def test_ratio_profile_counts_over_random_points(spark):
    cols = "fil long, k long, perp2 double"
    data = spark.createDataFrame([(1, 0, 3.0), (1, 0, 0.5), (1, 0, 0.2), (1, 1, 3.0)], cols)
    rand = spark.createDataFrame([(1, 0, 3.0), (1, 0, 2.0), (1, 0, 0.5), (1, 1, 2.0)], cols)
    got = rows(profiles.ratio_profile(data, rand, [4.0, 1.0], 10.0))
    assert got == [(1, 0, 5.0, 1), (1, 1, 20.0, 1)]


def test_slices_against_brute_force(spark):
    line = spark.createDataFrame([(1, k, 95 + 10 * k if k == 0 else (95 + 10 * k) % 100, 50, 50) for k in range(4)], "fil long, k long, x long, y long, z long")
    rng = np.random.default_rng(2)
    pts = rng.integers(0, 100, (4000, 3))
    p = spark.createDataFrame([(i, *map(int, x), 1, 2, 3) for i, x in enumerate(pts)], "id long, x long, y long, z long, vx long, vy long, vz long")
    cut = profiles.slices(line, 100, 4)
    got = {(r["i"], r["iy"]): (r["n"], r["vpar"]) for r in profiles.slice_profile(p, cut, [64.0, 16.0], 5.0, 100, True).collect()}
    mi = lambda d: (d + 50) % 100 - 50
    for i in range(4):
        along, perp2 = mi(pts[:, 0] - (95 + 10 * i)), mi(pts[:, 1] - 50) ** 2 + mi(pts[:, 2] - 50) ** 2
        for iy, edge in enumerate((64, 16)):
            assert got[i, iy] == (int(((abs(along) < 5) & (perp2 < edge)).sum()), 1.0)
    more = {r["i"]: r["x"] for r in profiles.slices(line, 100, 4, True).collect()}
    assert more == {-1: 85.0, -2: 75.0, 4: 35.0, 5: 45.0}


def test_tube_statistics_of_one_particle(spark):
    cols = "pid long, fil long, perp2 double, s double, len double, vx double, vy double, vz double, ux double, uy double, uz double"
    one = spark.createDataFrame([(1, 1, 1.0, 5.0, 10.0, 1.0, 2.0, 3.0, 1.0, 0.0, 0.0)], cols)
    r = profiles.tube_statistics(one, 2.0).first()
    assert (r["n"], r["n_in"], r["sigma"], r["bx"], r["n_mid"]) == (1, 1, 0.0, 1.0, 1)
    assert r["mid"] == pytest.approx(1 / (math.pi * 4 * 5))


def test_fractions_end_at_one(spark):
    line = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 1, 3, 0, 0), (1, 2, 3, 9, 0), (2, 0, 5, 5, 5), (2, 1, 5, 5, 5)], "fil long, k long, x long, y long, z long")
    assert [r["t"] for r in polyline.fractional(line, 100).orderBy("k").collect()] == [0.0, 0.25, 1.0]


def test_names_and_parameters(spark, tmp_path):
    name = spark.createDataFrame([("matrix_fixed_LIN_0.79_0.17.bin",), (None,)], "n string")
    got = name.select(*name_flags(F.col("n"))).first()
    assert tuple(got) == (True, False, False, False, True, False, "0.79", "0.17")
    run = RunParameters.parse("2\n/data/\nsnap\n3.5\n2\n0.79\n0.17\n30\n10\n10000\n")
    assert run.levels == [0.79, 0.17] and run.rings == 10 and run.least_mass is None and run.paths() == ["/data/snap.0", "/data/snap.1"]
    work, done = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2,), (None,)], "id long")
    assert rows(unfinished(work, done, "id")) == [(1,)]
    write_groups(spark.createDataFrame([("a", 1, 2)], "level string, gid long, id long"), f"{tmp_path}/groups")
    assert rows(spark.read.parquet(f"{tmp_path}/groups").select("level", "gid", "id")) == [("a", 1, 2)]


def test_extended_slices_in_blocks_against_brute_force(spark):
    rng = random.Random(8)
    p = [(k, *(rng.uniform(0, 100) for _ in "xyz"), *(rng.uniform(-200, 200) for _ in "xyz")) for k in range(4000)]
    points = spark.createDataFrame(p, "id bigint, x double, y double, z double, vx double, vy double, vz double")
    lines = [(f, k, (7 * f + 11 * k) % 100, (31 * f + 5 * k) % 100, (97 + 3 * k * f) % 100) for f in range(6) for k in range(4)]
    nodes = spark.createDataFrame(lines, "fil bigint, k bigint, x bigint, y bigint, z bigint")
    cut, whole = profiles.slices(nodes, 100, 5), profiles.slices(nodes, 100, 5, True)
    # no bound on the thickness: each slice has its own box
    got = {(r["i"], r["iy"]): r for r in profiles.slice_profile(points, cut.where("i in (0, 4)"), [64.0, 16.0], None, 100, ahead=2).collect()}
    want = {}
    for c in whole.collect():
        for _, *x in p:
            d = [(x[j] - c[a] + 50) % 100 - 50 for j, a in enumerate("xyz")]
            along = sum(d[j] * c[f"u{a}"] for j, a in enumerate("xyz"))
            perp2 = sum(y * y for y in d) - along * along
            if abs(along) < c["half"] and perp2 < 64:
                want.setdefault((c["i"], int(perp2 < 16)), []).append(sum(x[3 + j] * c[f"u{a}"] for j, a in enumerate("xyz")))
    assert {k: r["n"] for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    for k, v in want.items():
        mean = sum(v) / len(v)
        assert abs(got[k]["vpar"] - mean) < 1e-6
        assert abs(got[k]["spar"] - (math.sqrt(sum((y - mean) ** 2 for y in v) / (len(v) - 1)) if len(v) > 10 else 0)) < 1e-6
