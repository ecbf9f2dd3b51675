"""Connectivity: components, friends-of-friends groups (single, multi-level, nested), spanning forests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import AXES
from ..functions.tables import forget, written
from .blocks import CHUNK, ROWS, Grid, blocked, columns
from .rangejoin import exists_within, range_self_join


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): nodes of edges (a, b) other than the smallest of their component, with that.

    Large-star and small-star rounds (O(log^2 n) of them) until the edges are stars. Minima are
    pre-aggregated and the joins are plain equi-joins, which Spark splits when a hub is hot (hinted as
    merges, since the files of a round are far smaller than its rows); each round is a table in the
    shared folder.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first())

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), name)
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.hint("merge").join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.hint("merge").join(least.hint("merge"), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = written(small, name)
        forget(now)
        now, before = new, seen
        seen = state(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def labels(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """nodes with `root`, the smallest id of their component; isolated nodes are their own."""
    found = components(edges.select("a", "b"))
    return nodes.hint("merge").join(found.select(F.col("node").alias(id_col), "root").hint("merge"), id_col, "left").withColumn("root", F.coalesce("root", id_col))


def with_group(labelled: DataFrame, least: int, root: str = "root") -> DataFrame:
    """Members of groups of at least `least`, with the group's size `n` (pre-aggregated, then joined)."""
    sizes = labelled.groupBy(root).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return labelled.hint("merge").join(sizes.hint("merge"), root)


def fof(points: DataFrame, r: float, box: float, least: int = 20) -> DataFrame:
    """Friends-of-friends: members (of groups of `least` or more) with gid, the group's smallest id."""
    pairs = range_self_join(points, r, box)
    return with_group(labels(points, pairs), least).withColumnRenamed("root", "gid")


def fof_levels(points: DataFrame, radii: dict[str, float], box: float, least: int = 20) -> DataFrame:
    """Independent levels from one range join at the largest radius: rows (level, id, gid, n)."""
    pairs = written(range_self_join(points, max(radii.values()), box), "pairs")
    out = None
    for level, r in radii.items():
        part = with_group(labels(points.select("id"), pairs.where(F.col("d2") < r * r)), least)
        part = part.select(F.lit(level).alias("level"), "id", F.col("root").alias("gid"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def nested_fof(points: DataFrame, radii: list[tuple[str, float]], box: float, least: int = 20) -> DataFrame:
    """Nested levels, each on the members of the one before and within its groups' survivors; save is
    the group of the level before (its own at the first). One range join at the largest radius."""
    pairs = written(range_self_join(points, max(r for _, r in radii), box), "pairs")
    alive, out = points.select("id").withColumn("save", F.lit(None).cast("bigint")), None
    for level, r in radii:
        linked = pairs.where(F.col("d2") < r * r).join(alive.select(F.col("id").alias("a")), "a").join(alive.select(F.col("id").alias("b")), "b")
        part = written(with_group(labels(alive, linked), least).select(F.lit(level).alias("level"), "id", F.col("root").alias("gid"), F.coalesce("save", "root").alias("save"), "n"), "level")
        out = part if out is None else out.unionByName(part)
        alive = part.select("id", F.col("gid").alias("save"))
    return out


def spanning_forest(edges: DataFrame, weight: Column) -> DataFrame:
    """Minimum spanning forest of edges (i, j) by Boruvka rounds on the total order (weight, i, j):
    rows (i, j, weight). Each round every component takes its least outgoing edge."""
    left = written(edges.select("i", "j", weight.alias("weight")).where("i != j").withColumns({"a": F.col("i"), "b": F.col("j")}), "edges")
    chosen = None
    while not left.isEmpty():
        both = left.select("a", "weight", "i", "j").unionByName(left.select(F.col("b").alias("a"), "weight", "i", "j"))
        best = both.groupBy("a").agg(F.min(F.struct("weight", "i", "j")).alias("e")).select("e.i", "e.j", "e.weight").distinct()
        best = written(best, "chosen")
        chosen = best if chosen is None else chosen.unionByName(best)
        ends = left.join(best.select("i", "j"), ["i", "j"], "left_semi").select("a", "b")
        to = written(components(ends), "contract")
        moved = left.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        moved = moved.select("i", "j", "weight", F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a != b")
        new = written(moved, "edges")
        forget(left)
        left = new
    return chosen if chosen is not None else edges.select("i", "j", weight.alias("weight")).limit(0)


def admissible(edges: DataFrame, points: DataFrame, r0: float, step: float, box: float, same: str) -> DataFrame:
    """Edges (i, j, x, y, z, ex, ey, ez, d, `same`) of which every sample on the way, one each `step` from
    half a step on and the last amid the remainder, has a point of the same `same` within r0."""
    m = F.floor(F.col("d") / step).cast("int")
    t = F.explode(F.sequence(F.lit(0), m))
    rows = edges.where("d > 0").withColumn("m", m).withColumn("t", t)
    at = F.when(F.col("t") < F.col("m"), (F.col("t") + 0.5) * step).otherwise((F.col("m") * step + F.col("d")) / 2)
    probes = rows.select("i", "j", "t", same, *(F.pmod(F.col(c) + F.col(f"e{c}") * at / F.col("d"), F.lit(float(box))).alias(c) for c in AXES))
    good = exists_within(probes, points, r0, box, same).groupBy("i", "j").agg(F.count("*").alias("good"))
    return rows.groupBy("i", "j").agg(F.count("*").alias("good")).join(good, ["i", "j", "good"]).select("i", "j")


def admissible_pairs(nodes: DataFrame, points: DataFrame, reach: float, r0: float, step: float, box: float, same: str) -> DataFrame:
    """(i, j), i < j: what admissible() gives for the edges between all nodes (id, x, y, z, `same`) nearer than
    `reach` that share `same`. Found in blocks of the box that hold the nodes and points around theirs, so that
    neither edges nor samples are shuffled; nodes and points at one place are tried once."""
    known = " and ".join(f"{c} is not null" for c in (*AXES, same))
    nodes = nodes.select("id", *AXES, same).where(known).where("id is not null")
    points = written(points.select(*AXES, same).where(known).distinct(), "places")
    many, half = max(1, nodes.count()), float(box) / 2
    far = (reach + r0) * (1 + 1e-9)
    around = nodes.unionByName(points.select(F.lit(None).cast(nodes.schema["id"].dataType).alias("id"), *AXES, same))
    around = around.select("*", *((F.col(c) - far).alias(f"l{c}") for c in AXES), *((F.col(c) + far).alias(f"h{c}") for c in AXES))

    def places(t: pa.Table, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (kind, x, y, z); ids in their order, and where those of each place begin."""
        at, which = np.unique(np.column_stack([kind, columns(t, *AXES)]), axis=0, return_inverse=True)
        ids = t["id"].to_numpy().astype(np.int64)
        order = np.lexsort((ids, which.ravel()))
        return at, ids[order], np.searchsorted(which.ravel()[order], np.arange(len(at) + 1))

    def kernel(p: pa.Table, q: pa.Table) -> pa.Table:
        kinds = pa.concat_arrays([t[same].combine_chunks() for t in (p, q)]).dictionary_encode().indices.to_numpy()
        mine, theirs = kinds[: p.num_rows].astype(float), kinds[p.num_rows :].astype(float)
        node = q["id"].is_valid().to_numpy()
        a, a_ids, a_at = places(p, mine)
        b, b_ids, b_at = places(q.filter(pa.array(node)), theirs[node])
        spots, spot_kind = columns(q, *AXES)[~node], theirs[~node]
        found: list[np.ndarray] = []
        for kind in np.unique(a[:, 0]):
            to, at = np.flatnonzero(b[:, 0] == kind), spots[spot_kind == kind]
            if not len(at):
                continue
            from_, grid = np.flatnonzero(a[:, 0] == kind), Grid(at, box, r0)
            mid, wide = a[from_, 1:], reach * (1 + 1e-9)
            pairs = [np.zeros((2, 0), np.int64)]
            held = 0
            for m, n in Grid(b[to, 1:], box, reach / 4).candidates(mid - wide, mid + wide):
                m, n = from_[m], to[n]
                d = np.abs(b[n, 1:] - a[m, 1:])
                d = np.minimum(d, box - d)
                d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
                ok = (d2 < reach * reach) & (d2 > 0) & (a_ids[a_at[m]] < b_ids[b_at[n + 1] - 1])
                pairs.append(np.stack([m[ok], n[ok]]))
                held += pairs[-1].shape[1]
                if held > CHUNK:
                    found += tried(np.concatenate(pairs, 1), a, b, at, grid)
                    pairs, held = [np.zeros((2, 0), np.int64)], 0
            found += tried(np.concatenate(pairs, 1), a, b, at, grid)
        m, n = np.concatenate([np.zeros((2, 0), np.int64), *found], 1)
        # ids of the places
        left, right = a_at[m + 1] - a_at[m], b_at[n + 1] - b_at[n]
        size = left * right
        row = np.repeat(np.arange(len(m)), size)
        one, two = np.divmod(np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size), right[row])
        i, j = a_ids[a_at[m[row]] + one], b_ids[b_at[n[row]] + two]
        return pa.table({"i": i[i < j], "j": j[i < j]})

    def tried(pairs: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, grid: Grid) -> list[np.ndarray]:
        """Those pairs of which every sample has a point; most fall by the first."""
        m, n = pairs
        off = b[n, 1:] - a[m, 1:]
        off = off - np.where(off >= half, box, 0.0) + np.where(off < -half, box, 0.0)
        d = np.sqrt(off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1] + off[:, 2] * off[:, 2])
        last, live, t, done = np.floor(d / step), np.arange(len(m)), 0, []
        while len(live):
            go = np.where(t < last[live], (t + 0.5) * step, (last[live] * step + d[live]) / 2)
            probe = np.fmod(a[m[live], 1:] + off[live] * go[:, None] / d[live, None], float(box))
            probe = np.where(probe < 0, np.fmod(probe + box, float(box)), probe)
            hit, wide = np.zeros(len(live), bool), r0 * (1 + 1e-9)
            for row, k in grid.candidates(probe - wide, probe + wide):
                x = np.abs(at[k] - probe[row])
                x = np.minimum(x, box - x)
                hit[row[x[:, 0] * x[:, 0] + x[:, 1] * x[:, 1] + x[:, 2] * x[:, 2] < r0 * r0]] = True
            live = live[hit]
            over = last[live] <= t
            done.append(live[over])
            live, t = live[~over], t + 1
        return [pairs[:, x] for x in done]

    schema = T.StructType([T.StructField(c, T.LongType()) for c in "ij"])
    # a block's points are some eight times those at home in it
    return blocked(nodes, around, box, kernel, schema, max(1, int(ROWS * min(1.0, 8 * many / max(1, points.count())))))


def scaled_weights(edges: DataFrame) -> DataFrame:
    """edges with `scaled`: weights from 0 (the largest) to 1 (the smallest)."""
    ends = edges.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    # one row: its size is proven
    return edges.join(F.broadcast(ends)).withColumn("scaled", F.try_divide(F.col("weight") - F.col("hi"), F.col("lo") - F.col("hi"))).drop("lo", "hi")


def pruned(edges: DataFrame, mass: DataFrame, level: int, survive: float | None = None) -> DataFrame:
    """Forest edges (i, j) without short branches. In pass 1 to `level`, chains from a leaf of at most that
    many nodes to a junction go, and whole paths of so few; nodes (id, numpart) above `survive`, on the
    chain or at its end, protect it. Passes end at the first that removes nothing. Walks are bounded by `level`."""
    left, kept = written(edges.select("i", "j"), "forest"), mass.select(F.col("id").alias("i"), (F.col("numpart") > (float("inf") if survive is None else survive)).alias("heavy"))
    for cut in range(1, level + 1):
        both = left.unionByName(left.select(F.col("j").alias("i"), F.col("i").alias("j")))
        node = written(both.groupBy("i").agg(F.count("*").alias("deg")).join(kept, "i", "left").select("i", "deg", F.coalesce("heavy", F.lit(False)).alias("heavy")), "degrees")
        nxt = node.select(F.col("i").alias("j"), F.col("deg").alias("to_deg"), F.col("heavy").alias("to_heavy"))
        walk = node.where("deg = 1 and not heavy").select("i", F.lit(None).cast("bigint").alias("prev"), F.array("i").alias("path"))
        doomed = None
        for _ in range(cut):
            moved = walk.join(both, "i").where(~F.col("j").eqNullSafe(F.col("prev"))).join(nxt, "j").where("not to_heavy")
            ended = moved.where("to_deg != 2").select(F.explode(F.when(F.col("to_deg") == 1, F.array_append("path", F.col("j"))).otherwise(F.col("path"))).alias("id"))
            doomed = ended if doomed is None else doomed.unionByName(ended)
            walk = moved.where("to_deg = 2").select(F.col("j").alias("i"), F.col("i").alias("prev"), F.array_append("path", F.col("j")).alias("path"))
        doomed = written(doomed.distinct(), "doomed")
        if doomed.isEmpty():
            break
        left = written(left.join(doomed.select(F.col("id").alias("i")), "i", "left_anti").join(doomed.select(F.col("id").alias("j")), "j", "left_anti").select("i", "j"), "forest")
    return left


def rooted(edges: DataFrame, mass: DataFrame) -> DataFrame:
    """(id, root, parent, depth) of every node of forest edges (i, j): each tree hangs from its heaviest
    node (ties to the smaller id). One round, a table, for each level of depth."""
    both = written(edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))), "darts")
    ids = both.select(F.col("i").alias("id")).distinct().join(mass.select("id", "numpart"), "id", "left")
    trees = written(labels(ids, edges.select(F.col("i").alias("a"), F.col("j").alias("b"))), "trees")
    top = trees.groupBy("root").agg(F.max_by("id", F.struct(F.coalesce("numpart", F.lit(-1)), -F.col("id"))).alias("id"))
    now = written(top.select("id", F.col("id").alias("root"), F.lit(None).cast("bigint").alias("parent"), F.lit(0).alias("depth")), "level")
    out = now
    while not now.isEmpty():
        step = now.join(both, now["id"] == both["i"]).where(~F.col("j").eqNullSafe(F.col("parent")))
        now = written(step.select(F.col("j").alias("id"), "root", F.col("id").alias("parent"), (F.col("depth") + 1).alias("depth")), "level")
        out = out.unionByName(now)
    return out
