"""Queries on solids: Voronoi cells and edges, hulls of groups, volumes of tubes. SQL has no such solids; the
tests hold them against closed forms, invariants and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import written
from ..operators import polyline, solids
from ..sources import fixtures as fx
from ..sources.fixtures import BOX
from .catalog import members, query
from .extras import RVIR
from .filaments import filament_ends


@query()
def geo1_voronoi_cells(spark, d):
    return solids.voronoi(fx.halos(spark, d), BOX)


@query()
def geo2_relaxed_points(spark, d):
    """Two rounds of relaxation."""
    return solids.relaxed(fx.halos(spark, d), BOX, 2)


@query()
def gr5_voronoi_edges(spark, d):
    h = fx.halos(spark, d)
    return solids.voronoi_edges(solids.voronoi(h, BOX), h.select("id", F.col("save").alias("gid")))


@query()
def geo3_convex_hulls(spark, d):
    return solids.convex_hulls(members(spark, d), BOX)


def unrolled(spark: SparkSession, d: str) -> DataFrame:
    u = polyline.unwrapped(fx.nodes(spark, d).where("size > 1"), BOX)
    return written(u.select("fil", "k", *(F.col(f"u{c}").alias(c) for c in "xyz")), "unrolled")


TUBE = 8.0  # radius around nodes


@query()
def geo4_union_volumes(spark, d):
    return solids.union_volumes(unrolled(spark, d).withColumn("r", F.lit(TUBE)), "fil")


@query()
def geo5_tube_volumes(spark, d):
    """Tubes without the virial spheres of both ends."""
    u = unrolled(spark, d)
    e = filament_ends(spark, d).select("fil", "m0", "m1")
    ends = u.groupBy("fil").agg(*(f(F.struct(*"xyz"), "k").alias(n) for f, n in ((F.min_by, "a"), (F.max_by, "b")))).hint("merge").join(e.hint("merge"), "fil")
    ends = ends.select("fil", F.explode(F.array(*(F.struct(f"{n}.*", (RVIR * F.cbrt(m)).alias("r")) for n, m in (("a", "m0"), ("b", "m1"))))).alias("e"))
    return solids.tube_volumes(u, ends.select("fil", "e.*"), TUBE)
