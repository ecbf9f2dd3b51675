"""Periodic range joins: cell keys turn the distance predicate into an equi-join.

The smaller side (nodes, halos) is exploded to its neighbouring cells, never the larger one. With
fewer than 3 cells a side, wrapped neighbours coincide and are made distinct, so no pair comes twice.
Both inputs are plain exchanges, so AQE splits cells that are hot in bytes. The joins are hinted as
merges: Spark takes an exploded table to be as large as its file, and would broadcast 27 times that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import AXES, cell_key, cell_of, minimum_image
from ..functions.tables import written


def cells_per_side(r: float, box: float, most: int = 512) -> int:
    return max(1, min(most, int(box // r)))


def with_cell(df: DataFrame, n: int, box: float) -> DataFrame:
    return df.withColumn("cell", cell_key(n, *(cell_of(F.col(c), box, n) for c in AXES)))


def with_near_cells(df: DataFrame, n: int, box: float, reach: int = 1) -> DataFrame:
    """A row for each distinct cell within `reach` cells."""
    around = range(-min(reach, n), min(reach, n) + 1)
    near = {f"__{c}": F.array_distinct(F.array(*(F.pmod(cell_of(F.col(c), box, n) + F.lit(o), F.lit(n)) for o in around))) for c in AXES}
    df = df.withColumns(near)  # distinct on each axis, so distinct in space
    for c in near:
        df = df.withColumn(c, F.explode(c))
    return df.withColumn("cell", cell_key(n, *(F.col(c) for c in near))).drop(*near)


def offsets(a: str, b: str, box: float) -> list[Column]:
    """Minimum-image differences b - a of prefixed columns."""
    return [minimum_image(F.col(f"{b}{c}") - F.col(f"{a}{c}"), box) for c in AXES]


def distance2(a: str, b: str, box: float) -> Column:
    """Squared minimum-image distance of prefixed columns; integers stay integers. From the absolute
    difference, which gives the same squares as the signed one with half of the generated code."""
    d = [F.abs(F.col(f"{b}{c}") - F.col(f"{a}{c}")) for c in AXES]
    d = [F.least(x, box - x) for x in d]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def prefixed(df: DataFrame, p: str, keep: str = "cell") -> DataFrame:
    return df.select(*(F.col(c) if c == keep else F.col(c).alias(f"{p}{c}") for c in df.columns))


def range_join(points: DataFrame, centres: DataFrame, r: float, box: float, inclusive: bool = False, p: str = "p_", c: str = "c_", reach: int = 1) -> DataFrame:
    """All (point, centre) with d2 < r**2 (<= if inclusive); columns prefixed, plus d2. The centres are
    exploded to `reach` cells of side r / reach on each side: more, smaller cells for dense points."""
    n = cells_per_side(r / reach, box)
    reach = max(reach, math.ceil(r * n / box))
    both = prefixed(with_cell(points, n, box), p).hint("merge").join(prefixed(with_near_cells(centres, n, box, reach), c).hint("merge"), "cell").drop("cell")
    both = both.withColumn("d2", distance2(c, p, box))
    return both.where(F.col("d2") <= r * r if inclusive else F.col("d2") < r * r)


def cell_candidates(points: DataFrame, centres: DataFrame, r: float, box: float, key: str) -> DataFrame:
    """Distinct (id, key) of points in the cells around a centre's, whatever their distance."""
    n = cells_per_side(r, box)
    near = with_near_cells(centres.select(key, *AXES), n, box).select(key, "cell").distinct()
    return with_cell(points, n, box).select("id", "cell").hint("merge").join(near.hint("merge"), "cell").select("id", key).distinct()


def range_self_join(points: DataFrame, r: float, box: float) -> DataFrame:
    """Pairs (a, b, d2) with a < b and d2 < r**2, each once."""
    few = points.select("id", *AXES)
    return range_join(few, few, r, box, p="b_", c="a_").where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "d2")


def exists_within(probes: DataFrame, points: DataFrame, r: float, box: float, same: str | None = None) -> DataFrame:
    """Probes with a point within r (strictly), of the same value of column `same` if given: a semi-join."""
    n = cells_per_side(r, box)
    left = prefixed(with_near_cells(probes, n, box), "c_")
    right = prefixed(with_cell(points, n, box), "p_")
    on = (left["cell"] == right["cell"]) & (distance2("c_", "p_", box) < r * r)
    if same:
        on &= F.col(f"c_{same}") == F.col(f"p_{same}")
    hit = left.hint("merge").join(right.hint("merge"), on, "left_semi")
    return hit.select(*(F.col(f"c_{c}").alias(c) for c in probes.columns)).distinct()


def nearest_k(points: DataFrame, centres: DataFrame, k: int, step: float, box: float) -> DataFrame:
    """Exact k nearest points of each centre: (centre, point, d2, rank), ties to the smaller id. The radius
    doubles, from `step`, for centres that still have fewer than k, until it covers the box. Cells stay
    small against the radius, so that the last rounds are not one cell of all points."""
    out, left, i = None, centres.select("id", *AXES), 1
    while True:
        r = step * i
        # one step beyond half the box's diagonal every point is near every centre
        last = r > box * math.sqrt(3) / 2
        near = range_join(points.select("id", *AXES), left, r, box, reach=min(i, 7))
        w = Window.partitionBy("c_id").orderBy("d2", "p_id")
        top = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        done = top.groupBy("c_id").agg(F.count("*").alias("have")) if last else top.groupBy("c_id").agg(F.count("*").alias("have")).where(F.col("have") >= k)
        part = top.hint("merge").join(done.select("c_id").hint("merge"), "c_id").select(F.col("c_id").alias("centre"), F.col("p_id").alias("point"), "d2", "rank")
        part = written(part, "knn")
        out = part if out is None else out.unionByName(part)
        left = written(left.hint("merge").join(part.select(F.col("centre").alias("id")).distinct().hint("merge"), "id", "left_anti"), "open")
        if last or left.isEmpty():
            return out
        i *= 2


def nearest_k_within(points: DataFrame, centres: DataFrame, k: int, r: float, box: float) -> DataFrame:
    """Up to k nearest points within a fixed radius."""
    w = Window.partitionBy("c_id").orderBy("d2", "p_id")
    near = range_join(points.select("id", *AXES), centres.select("id", *AXES), r, box)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("c_id").alias("centre"), F.col("p_id").alias("point"), "d2", "rank")
