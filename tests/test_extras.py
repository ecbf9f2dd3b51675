"""Trees, spins, ranks and ring edges against brute force."""

import math
import random

import pytest

from skyloom.functions import geometry as g
from skyloom.functions import tables
from skyloom.operators import halos, profiles, stacking, trees
from skyloom.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tree(spark):
    rng = random.Random(11)
    # a long chain, a bushy tree and a lone root
    rows = [(i, i - 1 if i else None, rng.randint(1, 60)) for i in range(70)]
    rows += [(100, None, 50)] + [(100 + i, 100 + rng.randrange(i), rng.randint(1, 60)) for i in range(1, 120)] + [(900, None, 5)]
    return rows, spark.createDataFrame(rows, "id bigint, parent bigint, mass bigint")


def walked(rows, cut):
    """The climbs one after the other, as a loop over nodes from the heaviest on."""
    parent, mass = {i: p for i, p, _ in rows}, {i: m for i, _, m in rows}
    seen, out = set(), set()
    for s in sorted(parent, key=lambda i: (-mass[i], -i)):
        if parent[s] is None or s in seen:
            continue
        path, seg, v = [s], 0, s
        seen.add(s)

        def end():
            if len(path) > 1:
                out.update((s, seg, k, i) for k, i in enumerate(path))

        while parent[v] is not None:
            v = parent[v]
            met = v in seen
            path.append(v)
            seen.add(v)
            if met:
                break
            if mass[v] > cut and parent[v] is not None:
                end()
                path, seg = [v], seg + 1
        end()
    return out


def test_path_sums(tree):
    rows, df = tree
    parent, mass = {i: p for i, p, _ in rows}, {i: m for i, _, m in rows}

    def up(i):
        return (0, 0) if parent[i] is None else tuple(a + b for a, b in zip(up(parent[i]), (mass[i], 1), strict=True))

    assert {r.id: (r.total, r.depth) for r in trees.path_sums(df, "mass").collect()} == {i: up(i) for i in parent}


def test_segments(tree):
    rows, df = tree
    for cut in (25, 45, 1000):
        assert {tuple(r) for r in trees.segments(df, cut).collect()} == walked(rows, cut)


def test_spin_of_a_ring(spark):
    """Four members on a circle that turn about its centre."""
    rows = [(1, i, 500.0 + x, 500.0 + y, 500.0, -5.0 * y, 5.0 * x, 0.0) for i, (x, y) in enumerate([(2, 0), (0, 2), (-2, 0), (0, -2)])]
    df = spark.createDataFrame(rows, "gid bigint, id bigint, x double, y double, z double, vx double, vy double, vz double").selectExpr("*", "4 as n")
    got = halos.spin(df, 1000, 0.5).first()
    ep = -halos.GCONS * (1 / 0.5 + 2 / (math.sqrt(8) + 0.5) + 1 / 4.5)
    want = 4 * 20 * math.sqrt(abs(4 * 50 + 4 * ep / 2)) / (halos.GCONS * 32)
    assert abs(got.spin / want - 1) < 1e-9


def test_ranked(spark):
    rows = [(i, i * 7 % 5) for i in range(40)]
    got = {r.id: r["rank"] for r in stacking.ranked(spark.createDataFrame(rows, "id bigint, m bigint"), "m", "id").collect()}
    assert got == {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}


def test_filament_edges(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 100.0)], "fil bigint, len double")
    got = {(r.fil, r.i): r.edge for r in profiles.filament_edges(df, 40.0, 4).collect()}
    assert got[1, 0] == 10 and got[2, 0] == 40 and abs(got[1, 4] - 0.2) < 1e-9 and all(got[f, i] > got[f, i + 1] for f in (1, 2) for i in range(1, 4))
    flat = {(r.fil, r.i): r.edge for r in profiles.filament_edges(df, 40.0, 4, log=False).collect()}
    assert [flat[2, i] for i in range(5)] == [40, 30, 20, 10, 0]


def test_shared_folder_needs_a_setting_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        tables.shared_dir(Session())


def test_registered():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100
    assert g.linear_edges(20.0, 0.0, 2) == [400.0, 100.0, 0.0]
