"""Queries on filament ends, slices, random controls, trees and names, with their SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import controls, ends, graph, polyline, profiles, rangejoin
from ..sources import fixtures as fx
from ..sources import naming
from ..sources.fixtures import BOX, HALOS_SQL, NODES_SQL, PARTICLES_SQL
from .catalog import FOF_SQL, NEAR_NODES, PARAMS_SQL, PIECES_SQL, STEPS_SQL, members, mi, near_sql, query, separation, sq, uniform_sql

VEL_SQL = "(id*37)%401-200 AS vx, (id*53)%401-200 AS vy, (id*71)%401-200 AS vz"
ENDS_SQL = f"""{NODES_SQL}, {HALOS_SQL}, hv AS (SELECT *, {VEL_SQL} FROM halos), nh AS (SELECT count(*) AS nh FROM halos),
fe AS (SELECT fil, max(size) AS size, (fil*31)%any_value(nh) AS ida, (fil*31+(max(size)-1)*17)%any_value(nh) AS idb FROM nodes, nh WHERE size > 1 GROUP BY fil),
eo AS (SELECT fil, a.numpart > b.numpart AS turned, ida, idb FROM fe JOIN hv a ON a.id = ida JOIN hv b ON b.id = idb),
ea AS (SELECT fil, turned, p.id AS id0, q.id AS id1, p.numpart AS m0, q.numpart AS m1, CAST(p.numpart > 200 AS INTEGER)+CAST(q.numpart > 200 AS INTEGER) AS flag, CAST(p.numpart AS DOUBLE)/q.numpart AS ratio, sqrt({sq('p', 'q')}) AS d,
 {', '.join(f'CAST(p.numpart*p.v{c}+q.numpart*q.v{c} AS DOUBLE)/(p.numpart+q.numpart) AS "b{c}"' for c in 'xyz')},
 ({' + '.join(f'p.v{c}*' + mi(f'q.{c}-p.{c}') for c in 'xyz')})/nullif(sqrt({sq('p', 'q')}), 0) AS rv0, ({' + '.join(f'q.v{c}*' + mi(f'q.{c}-p.{c}') for c in 'xyz')})/nullif(sqrt({sq('p', 'q')}), 0) AS rv1
 FROM eo JOIN hv p ON p.id = CASE WHEN turned THEN idb ELSE ida END JOIN hv q ON q.id = CASE WHEN turned THEN ida ELSE idb END)"""


def moving_halos(spark: SparkSession, d: str) -> DataFrame:
    return fx.halos(spark, d).withColumns({f"v{c}": (F.col("id") * m) % 401 - 200 for c, m in (("x", 37), ("y", 53), ("z", 71))})


def filament_ends(spark: SparkSession, d: str) -> DataFrame:
    h = moving_halos(spark, d)
    many = h.count()
    e = fx.nodes(spark, d).where("size > 1").groupBy("fil").agg(F.max("size").alias("size"))
    e = e.select("fil", ((F.col("fil") * 31) % many).alias("ida"), ((F.col("fil") * 31 + (F.col("size") - 1) * 17) % many).alias("idb"))
    return ends.end_attributes(e, h, 200, BOX)


# -- ends, flags, pairs --------------------------------------------------------------------------------
@query(f"WITH {ENDS_SQL} SELECT fil, turned, id0, id1, m0, m1, flag, {', '.join(f'round(b{c}, 6) AS bulk_{c}' for c in 'xz')} FROM ea")
def poly6_gr14_prj9_end_attributes(spark, d):
    return filament_ends(spark, d).select("fil", "turned", "id0", "id1", "m0", "m1", "flag", *(F.round(f"b{c}", 6).alias(f"bulk_{c}") for c in "xz"))


@query(f"WITH {ENDS_SQL} SELECT fil, round(rv0, 6) AS rv0, round(rv1, 6) AS rv1 FROM ea")
def prj10_relative_velocity(spark, d):
    return filament_ends(spark, d).select("fil", F.round("rv0", 6).alias("rv0"), F.round("rv1", 6).alias("rv1"))


@query(f"WITH {ENDS_SQL} SELECT fil, round(ratio, 6) AS ratio FROM ea WHERE flag = 2 AND ratio > 0.2")
def flt1_flt6_flt9_flag_and_ratio(spark, d):
    return filament_ends(spark, d).where("flag = 2 and ratio > 0.2").select("fil", F.round("ratio", 6).alias("ratio"))


@query(f"WITH {ENDS_SQL} SELECT id0, id1, round(min(d), 6) AS d, any_value(m0) AS m0, any_value(m1) AS m1, count(*) AS n FROM ea GROUP BY id0, id1")
def rn5_set4_endpoint_pairs(spark, d):
    return filament_ends(spark, d).groupBy("id0", "id1").agg(F.round(F.min("d"), 6).alias("d"), F.first("m0").alias("m0"), F.first("m1").alias("m1"), F.count("*").alias("n"))


END_D2 = {e: " + ".join(f"{mi(f'p.{c}-{e}{c}')}*{mi(f'p.{c}-{e}{c}')}" for c in "xyz") for e in "az"}


@query(f"WITH {NODES_SQL}, {PARAMS_SQL}, near AS (SELECT DISTINCT id, fil FROM ({NEAR_NODES})), e AS (SELECT fil, {', '.join(f'min_by({c}, k) AS a{c}, max_by({c}, k) AS z{c}' for c in 'xyz')} FROM nodes WHERE size > 1 GROUP BY fil) SELECT fil, count(*) AS n FROM near JOIN particles p USING (id) JOIN e USING (fil) WHERE {END_D2['a']} > 225 AND {END_D2['z']} > 225 GROUP BY fil")
def flt5_outside_end_spheres(spark, d):
    p, n = fx.particles(spark, d), fx.nodes(spark, d).where("size > 1")
    near = rangejoin.range_join(p.select("id", *"xyz"), n.select("fil", *"xyz"), separation(p, 1.2), BOX).select(F.col("p_id").alias("id"), F.col("c_fil").alias("fil")).distinct()
    e = n.groupBy("fil").agg(*(f(c, "k").alias(f"{q}{c}") for c in "xyz" for q, f in (("a_", F.min_by), ("z_", F.max_by))))
    rows = near.join(p.select("id", *(F.col(c).alias(f"p_{c}") for c in "xyz")), "id").join(e, "fil")
    return rows.where(ends.outside_ends(F.lit(15), rangejoin.distance2("a_", "p_", BOX), rangejoin.distance2("z_", "p_", BOX))).groupBy("fil").agg(F.count("*").alias("n"))


@query(f"WITH {STEPS_SQL}, {HALOS_SQL}, nh AS (SELECT count(*) AS nh FROM halos), l AS (SELECT fil, k, s, max(s) OVER (PARTITION BY fil) AS len FROM a WHERE size > 1) SELECT l.fil, l.k, round(s/len, 6) AS t, numpart AS mass FROM l, nh, halos h WHERE len > 0 AND h.id = (l.fil*31+l.k*17)%nh".replace(", l AS (SELECT fil, k, s", ", lf AS (SELECT fil, k, s").replace("SELECT l.fil, l.k,", "SELECT lf.fil, lf.k,").replace("FROM l, nh, halos", "FROM lf, nh, halos").replace("(l.fil*31+l.k*17)", "(lf.fil*31+lf.k*17)"))
def ag34_jn11_mass_along_filament(spark, d):
    h = fx.halos(spark, d)
    many = h.count()
    rows = polyline.fractional(fx.nodes(spark, d).where("size > 1"), BOX).withColumn("id", (F.col("fil") * 31 + F.col("k") * 17) % many)
    return rows.join(h.select("id", F.col("numpart").alias("mass")), "id").select("fil", "k", F.round("t", 6).alias("t"), "mass")


# -- joins -----------------------------------------------------------------------------------------------
@query(f"WITH {PARTICLES_SQL}, {HALOS_SQL}, {PARAMS_SQL}, near AS ({near_sql('halos', 'particles', 'r2', 'a.id AS cid, b.id AS pid', 'true')}) SELECT cid, pid, d2 FROM near")
def jn5_variable_reach(spark, d):
    p = fx.particles(spark, d)
    near = rangejoin.range_join(p.select("id", *"xyz"), fx.halos(spark, d).select("id", *"xyz"), separation(p, 1.2), BOX, reach=2)
    return near.select(F.col("c_id").alias("cid"), F.col("p_id").alias("pid"), "d2")


@query(f"WITH {NODES_SQL}, {PARAMS_SQL}, near AS ({near_sql('nodes', 'particles', 'r2', 'a.fil*1000+a.k AS node, b.id AS point', 'true')}) SELECT node, point, d2, CAST(row_number() OVER w AS INTEGER) AS rank FROM near WINDOW w AS (PARTITION BY node ORDER BY d2, point) QUALIFY row_number() OVER w <= 3")
def jn6_topk2_node_neighbours(spark, d):
    p = fx.particles(spark, d)
    n = fx.nodes(spark, d).select((F.col("fil") * 1000 + F.col("k")).alias("id"), *"xyz")
    out = rangejoin.nearest_k_within(p, n, 3, separation(p, 1.2), BOX)
    return out.withColumnRenamed("centre", "node")


@query(f"""WITH {NODES_SQL}, {PARAMS_SQL}, cn AS (SELECT CAST(1000//r2 AS BIGINT) AS n FROM params), pc AS (SELECT id, x*n//1000 AS i, y*n//1000 AS j, z*n//1000 AS l FROM particles, cn),
nc AS (SELECT DISTINCT fil, (x*n//1000+o+n)%n AS i, y*n//1000 AS j, z*n//1000 AS l, n FROM nodes, cn, (VALUES (-1),(0),(1)) t(o) WHERE size > 1)
SELECT fil, count(DISTINCT id) AS n FROM nc JOIN pc USING (i) WHERE (pc.j-nc.j+1+n)%n <= 2 AND (pc.l-nc.l+1+n)%n <= 2 GROUP BY fil""")
def jn7_dst1_cell_candidates(spark, d):
    p = fx.particles(spark, d)
    return rangejoin.cell_candidates(p, fx.nodes(spark, d).where("size > 1"), separation(p, 1.2), BOX, "fil").groupBy("fil").agg(F.count("*").alias("n"))


@query(FOF_SQL + " SELECT id, x, y, z, gid AS sub FROM members")
def src7_src8_tagged_members(spark, d):
    """Membership as its own table (gid, id), joined to the particles by id; ungrouped ones drop out."""
    tags = members(spark, d).select("id", F.col("gid").alias("sub"))
    return fx.particles(spark, d).select("id", *"xyz").join(tags, "id")


@query(f"WITH {PARTICLES_SQL}, {HALOS_SQL} SELECT id, numpart FROM halos WHERE id NOT IN (SELECT id FROM particles WHERE z < 300)")
def snk6_resume(spark, d):
    return naming.unfinished(fx.halos(spark, d).select("id", "numpart"), fx.particles(spark, d).where("z < 300").select("id"), "id")


NAME_SQL = "names AS (SELECT id, CASE id%3 WHEN 0 THEN 'matrix_fixed_vcm_LIN' WHEN 1 THEN 'matrix_extend_smooth' ELSE 'rperp_smooth_fixed' END || '_0.79_0.17.bin' AS name FROM halos)"


@query(f"WITH {HALOS_SQL}, {NAME_SQL} SELECT id, {', '.join(f'contains(name, {chr(39)}{m}{chr(39)}) AS {chr(34)}{m.lower()}{chr(34)}' for m in naming.MARKS)}, '0.79' AS outer_b, '0.17' AS inner_b FROM names")
def src18_name_flags(spark, d):
    i = F.col("id") % 3
    name = F.concat(F.when(i == 0, "matrix_fixed_vcm_LIN").when(i == 1, "matrix_extend_smooth").otherwise("rperp_smooth_fixed"), F.lit("_0.79_0.17.bin"))
    return fx.halos(spark, d).select("id", *naming.name_flags(name))


# -- trees -------------------------------------------------------------------------------------------------
ADM_SQL = f"""{PARTICLES_SQL}, {HALOS_SQL}, {PARAMS_SQL}, he AS ({near_sql('halos', 'halos', '60', 'a.id AS i, b.id AS j, a.x, a.y, a.z, a.save%2 AS sub, ' + ', '.join(f"{mi(f'b.{c}-a.{c}')} AS e{c}" for c in 'xyz'), 'a.id < b.id AND a.save%2 = b.save%2')}),
hd AS (SELECT *, sqrt(CAST(d2 AS DOUBLE)) AS d, CAST(floor(sqrt(CAST(d2 AS DOUBLE))/15) AS BIGINT) AS m FROM he WHERE d2 > 0), ht AS (SELECT *, unnest(range(0, m+1)) AS t FROM hd),
hs AS (SELECT i, j, t, sub, x AS x0, y AS y0, z AS z0, ex, ey, ez, d, CASE WHEN t < m THEN (t+0.5::DOUBLE)*15 ELSE (m*15+d)/2 END AS go FROM ht),
hp AS (SELECT i, j, t, sub, {', '.join(f'fmod({c}0+e{c}*go/d+1000, 1000) AS {c}' for c in 'xyz')} FROM hs),
hit AS (SELECT DISTINCT a.i, a.j, a.t FROM hp a JOIN particles b ON a.sub = b.id%2 JOIN params ON true WHERE {sq('a', 'b')} < (0.75*r2)*(0.75*r2))
"""


@query(f"WITH {ADM_SQL} SELECT h.i, h.j FROM hd h JOIN hit USING (i, j) GROUP BY h.i, h.j HAVING count(*) = any_value(m)+1")
def gr6_admissible_edges(spark, d):
    p, h = fx.particles(spark, d), fx.halos(spark, d)
    few = h.select("id", *"xyz", (F.col("save") % 2).alias("sub"))
    return graph.admissible_pairs(few, p.select(*"xyz", (F.col("id") % 2).alias("sub")), 60, 0.75 * separation(p, 1.2), 15.0, BOX, "sub")


@query()
def ag24_rn6_ratio_profile(spark, d):
    """Random points are four times the particles; the estimate is held against brute force in the tests."""
    p, n = fx.particles(spark, d), fx.nodes(spark, d).where("size > 1")
    r, many = separation(p, 1.2), 4 * p.count()
    rand = controls.uniform_points(spark, many, BOX)
    return profiles.ratio_profile(*(profiles.nearest_piece(x, n, r, BOX, ("fil", "k", "perp2")) for x in (p, rand)), [float(r * r), r * r / 4], many / BOX**3)


def sliced(spark: SparkSession, d: str, extended: bool, cumulative: bool) -> DataFrame:
    p, n = fx.particles(spark, d), fx.nodes(spark, d).where("size > 1")
    cut, r = profiles.slices(n, BOX, 5), separation(p, 1.2)
    # extended: both ends' slices stand for the two beyond them, so that an end is shuffled once
    out = profiles.slice_profile(p, cut.where("i in (0, 4)") if extended else cut, [float(r * r), r * r / 4], None, BOX, cumulative, ahead=2 if extended else 0)
    return out.select("i", "iy", "n", F.round("vpar", 4).alias("vpar"), F.round("spar", 4).alias("spar"))


@query()
def jn14_ag16_slice_profile(spark, d):
    return sliced(spark, d, False, True)


@query()
def ag16b_extended_slices(spark, d):
    return sliced(spark, d, True, False)


# -- random controls ------------------------------------------------------------------------------------------
PAIRS_SQL = f"{PARTICLES_SQL}, {HALOS_SQL}, params AS (SELECT 60 AS r, 40 AS r2), big AS (SELECT * FROM halos WHERE numpart >= 200), pr AS ({near_sql('big', 'big', 'r', 'a.id*1000003+b.id AS id, ' + ', '.join(f'a.{c} AS s{c}, b.{c} AS t{c}' for c in 'xyz'), 'a.id < b.id')}), pq AS (SELECT *, sqrt(CAST(d2 AS DOUBLE)) AS d FROM pr WHERE d2 >= 400)"


def rays_sql(side: str, end: str, seed: int) -> str:
    u, v = uniform_sql("id", "rand", str(seed)), uniform_sql("id", "rand", str(seed + 1))
    return f"SELECT id, '{side}' AS side, rand, {end}x AS x, {end}y AS y, {end}z AS z, d, {u} AS u, {v} AS v FROM pq, (VALUES (0),(1),(2)) t(rand)"


RAYS_SQL = f"{PAIRS_SQL}, ry AS ({rays_sql('left', 's', 1)} UNION ALL {rays_sql('right', 't', 3)}), rays AS (SELECT id, side, rand, x, y, z, d, sqrt(1-(2*v-1)*(2*v-1))*cos(2*pi()*u) AS ex, sqrt(1-(2*v-1)*(2*v-1))*sin(2*pi()*u) AS ey, 2*v-1 AS ez FROM ry)"


def rays(spark: SparkSession, d: str) -> DataFrame:
    big = fx.halos(spark, d).where("numpart >= 200").select("id", *"xyz")
    near = rangejoin.range_join(big, big, 60, BOX, p="b_", c="a_").where("a_id < b_id and d2 >= 400")
    pairs = near.select((F.col("a_id") * 1000003 + F.col("b_id")).alias("id"), *(F.col(f"{e}_{c}").alias(f"{e}{c}") for e in "ab" for c in "xyz"), F.sqrt(F.col("d2").cast("double")).alias("d"))
    return controls.fixings(pairs, 3)


@query(f"WITH {RAYS_SQL} SELECT id, side, rand, x, round(ex, 6) AS ex, round(ez, 6) AS ez, round(d, 6) AS d FROM rays")
def rn3_fixings(spark, d):
    return rays(spark, d).select("id", "side", "rand", "x", F.round("ex", 6).alias("ex"), F.round("ez", 6).alias("ez"), F.round("d", 6).alias("d"))


@query(f"""WITH {RAYS_SQL}, near AS ({near_sql('rays', 'particles', '100', 'a.side, a.d, ' + ' + '.join(f"{mi(f'b.{c}-a.{c}')}*a.e{c}" for c in 'xyz') + ' AS along', 'true')}),
g AS (SELECT side, CAST(floor(along/d*4) AS INTEGER) AS ix, CASE WHEN d2-along*along < 400 THEN 1 ELSE 0 END AS iy FROM near WHERE along >= 0 AND along < d AND d2-along*along < 1600)
SELECT side, ix, iy, round(count(*)/3.0::DOUBLE, 6) AS n FROM g GROUP BY GROUPING SETS ((side, ix, iy), (ix, iy))""")
def ag26_ag27_direction_matrix(spark, d):
    p, big = fx.particles(spark, d), fx.halos(spark, d).where("numpart >= 200").select("id", *"xyz")
    out = profiles.fixing_matrix(p, big, 20, 60, 3, [1600.0, 400.0], 4, BOX)
    return out.select("side", "ix", "iy", F.round("n", 6).alias("n"))


@query(f"WITH {RAYS_SQL}, m AS (SELECT *, unnest(range(1, CAST(floor(d/2/7) AS BIGINT)+1)) AS m FROM rays), j AS (SELECT *, unnest([-m, m]) AS j FROM m) SELECT id, side, rand, CAST(j AS INTEGER) AS j, round(fmod(x+ex*CASE WHEN j < 0 THEN j*7 ELSE d+j*7 END+2000, 1000), 5) AS x FROM j".replace("m AS (SELECT *, unnest", "mm AS (SELECT *, unnest").replace("AS j FROM m)", "AS j FROM mm)").replace("j AS (SELECT *, unnest([", "jj AS (SELECT *, unnest([").replace("AS x FROM j", "AS x FROM jj"))
def poly12_extension_points(spark, d):
    out = controls.extension_points(rays(spark, d).withColumn("rand", F.struct("side", "rand")), 7.0, BOX)
    return out.select("id", "rand.side", "rand.rand", "j", F.round("x", 5).alias("x"))


@query(f"WITH {PARTICLES_SQL}, {HALOS_SQL}, k AS (SELECT b.id AS centre, min({sq('b', 'a')}, 8) AS near FROM particles a, halos b GROUP BY b.id) SELECT centre, round(3*8/(4*pi()*pow(list_max(near), 1.5)), 9) AS density FROM k WHERE list_max(near) > 0")
def fn12_neighbour_density(spark, d):
    """Of every halo, from its 8 nearest particles."""
    p = fx.particles(spark, d)
    near = rangejoin.nearest_k(p, fx.halos(spark, d), 8, float(separation(p, 1.6)), BOX)
    return near.groupBy("centre").agg(F.max("d2").alias("d2"), F.count("*").alias("k")).where("d2 > 0").select("centre", F.round(3 * F.col("k") / (4 * math.pi * F.pow("d2", F.lit(1.5))), 9).alias("density"))
