"""Queries, one operator each: trees, halo energies, profiles in full, edges and kernels, sets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import halos, polyline, profiles, rangejoin, stacking, trees
from ..sources import fixtures as fx
from ..sources.fixtures import BOX, HALOS_SQL, NODES_SQL, PARTICLES_SQL
from .catalog import CENTRED_SQL, FOF_SQL, PARAMS_SQL, PIECES_SQL, PROPS_SQL, mi, near_sql, query, separation, written_members
from .filaments import END_D2, ENDS_SQL, NEAR_NODES, filament_ends

AFTER_NODES = ENDS_SQL[len(NODES_SQL) :]  # the common tables of filament ends, for statements that have the nodes


# -- trees -------------------------------------------------------------------------------------------
def tree(spark: SparkSession, d: str) -> DataFrame:
    """Halos hung as a ternary tree by their ids."""
    h = fx.halos(spark, d)
    up = h.select(F.col("id").alias("parent"), F.col("numpart").alias("pm"), *(F.col(c).alias(f"p{c}") for c in "xyz"))
    rows = h.withColumn("parent", F.when(F.col("id") > 0, F.floor(F.col("id") / 3).cast("bigint"))).join(up, "parent", "left")
    d2 = sum((g.minimum_image(F.col(c) - F.col(f"p{c}"), BOX) * g.minimum_image(F.col(c) - F.col(f"p{c}"), BOX) for c in "xyz"), F.lit(0))
    return rows.select("id", "parent", F.col("numpart").alias("mass"), (-F.col("numpart") * F.col("pm") / F.nullif(d2, F.lit(0))).alias("w"))


TREE_SQL = f"{HALOS_SQL}, tree AS (SELECT a.id, b.id AS parent, a.numpart AS mass, coalesce(-CAST(a.numpart*b.numpart AS DOUBLE)/nullif({' + '.join(f'{mi(f'a.{c}-b.{c}')}*{mi(f'a.{c}-b.{c}')}' for c in 'xyz')}, 0), 0) AS w FROM halos a LEFT JOIN halos b ON a.id > 0 AND b.id = a.id // 3)"


@query(f"WITH RECURSIVE {TREE_SQL}, r AS (SELECT id, CAST(0 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, r.total + t.w, r.depth + 1 FROM tree t JOIN r ON t.parent = r.id) SELECT id, round(total, 4) AS total, depth FROM r")
def gr12_path_weights(spark, d):
    t = tree(spark, d).withColumn("w", F.coalesce("w", F.lit(0.0)))
    return trees.path_sums(t, "w").select("id", F.round("total", 4).alias("total"), "depth")


@query(f"""WITH RECURSIVE {TREE_SQL}, up AS (SELECT id AS s, id AS v, parent AS p, CAST(0 AS BIGINT) AS i FROM tree UNION ALL SELECT up.s, t.id, t.parent, up.i + 1 FROM up JOIN tree t ON t.id = up.p),
own AS (SELECT v, p, max_by(s, struct_pack(m := mass, j := s)) AS owner, max_by(i, struct_pack(m := mass, j := s)) AS i FROM up JOIN tree ON tree.id = up.s GROUP BY v, p),
path AS (SELECT owner, v AS id, i, mass > 300 AS heavy FROM own JOIN tree ON tree.id = v UNION ALL SELECT owner, p, i + 1, false FROM (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY owner ORDER BY i DESC) = 1) WHERE p IS NOT NULL),
cuts AS (SELECT *, coalesce(sum(CASE WHEN heavy AND i > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg, lead(id) OVER (PARTITION BY owner ORDER BY i) IS NOT NULL AS more FROM path),
two AS (SELECT owner, id, i, CAST(seg AS BIGINT) AS seg FROM cuts UNION ALL SELECT owner, id, i, CAST(seg + 1 AS BIGINT) FROM cuts WHERE heavy AND i > 0 AND more)
SELECT owner AS start, seg, row_number() OVER (PARTITION BY owner, seg ORDER BY i) - 1 AS k, id FROM two QUALIFY count(*) OVER (PARTITION BY owner, seg) > 1""")
def gr13_segments(spark, d):
    return trees.segments(tree(spark, d), 300)


# -- group properties ----------------------------------------------------------------------------------
SCALE = 0.8  # scale factor of the run


@query(CENTRED_SQL + f" SELECT gid, {', '.join(f'round({SCALE * math.sqrt(SCALE)!r}*sum({e}), 4) AS l{c}' for c, e in zip('xyz', ('ry*wz-rz*wy', 'rz*wx-rx*wz', 'rx*wy-ry*wx'), strict=True))} FROM c GROUP BY gid")
def ag5_angular_momentum(spark, d):
    h = halos.properties(written_members(spark, d), BOX)
    return h.select("gid", *(F.round(SCALE * math.sqrt(SCALE) * F.col(f"l{c}"), 4).alias(f"l{c}") for c in "xyz"))


MOMENTS = [f"{a}{b}" for i, a in enumerate("xyz") for b in "xyz"[i:]]


@query(CENTRED_SQL + f" SELECT gid, {', '.join(f'round(avg(r{m[0]}*r{m[1]}), 4) AS m{m}' for m in MOMENTS)} FROM c GROUP BY gid")
def ag8_shape_tensor(spark, d):
    h = halos.properties(written_members(spark, d), BOX)
    return h.select("gid", *(F.round(f"m{m}", 4).alias(f"m{m}") for m in MOMENTS))


AXES_SQL = (
    CENTRED_SQL
    + f""", m AS (SELECT gid, {', '.join(f'avg(r{m[0]}*r{m[1]}) AS {m}' for m in MOMENTS)} FROM c GROUP BY gid), q AS (SELECT *, (xx+yy+zz)/3 AS q FROM m), p AS (SELECT *, sqrt((pow(xx-q,2)+pow(yy-q,2)+pow(zz-q,2)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM q),
r AS (SELECT *, acos(greatest(-1, least(1, coalesce(((xx-q)*((yy-q)*(zz-q)-yz*yz)-xy*(xy*(zz-q)-yz*xz)+xz*(xy*yz-(yy-q)*xz))/nullif(2*p*p*p, 0), 1))))/3 AS phi FROM p)"""
)


@query(AXES_SQL.replace(", q AS (SELECT *, (xx", ", q1 AS (SELECT *, (xx").replace("FROM q),", "FROM q1),") + " SELECT gid, round(sqrt(greatest(q+2*p*cos(phi), 0)), 3) AS aa, round(q, 4) AS third FROM r")
def ag8_long_axis(spark, d):
    h = halos.axes_of(halos.properties(written_members(spark, d), BOX))
    return h.select("gid", F.round("aa", 3).alias("aa"), F.round((F.col("mxx") + F.col("myy") + F.col("mzz")) / 3, 4).alias("third"))


HUBBLE = 0.1  # H(a) a in the fixture's units


@query(CENTRED_SQL + f" SELECT gid, round(sum({' + '.join(f'pow({math.sqrt(SCALE)!r}*w{c}+{HUBBLE}*r{c}, 2)' for c in 'xyz')})/2, 3) AS ekin FROM c GROUP BY gid")
def ag9_kinetic_energy(spark, d):
    """Peculiar velocities (times the root of the scale factor) and the Hubble flow."""
    return halos.kinetic_energy(written_members(spark, d), BOX, SCALE, HUBBLE).select("gid", F.round("ekin", 3).alias("ekin"))


BOUND_SQL = f"{FOF_SQL}, ep AS (SELECT a.gid, a.id, -{halos.GCONS!r}*(sum(CASE WHEN a.id = b.id THEN 0 ELSE 1/(sqrt({' + '.join(f'{mi(f'b.{c}-a.{c}')}*{mi(f'b.{c}-a.{c}')}' for c in 'xyz')})+1.0) END) + 1/1.0) AS ep FROM members a JOIN members b ON a.gid = b.gid GROUP BY a.gid, a.id)"


@query(BOUND_SQL + " SELECT gid, min_by(id, struct_pack(e := round(ep, 9), i := id)) AS bound, round(sum(ep)/2, 6) AS total FROM ep GROUP BY gid")
def ag10_most_bound(spark, d):
    """With the self term 1 / soft: the most bound member, and half the sum of the potentials."""
    e = halos.potential(written_members(spark, d), BOX, 1.0, self_term=True)
    return e.groupBy("gid").agg(F.min_by("id", F.struct(F.round("ep", 9), "id")).alias("bound"), F.round(F.sum("ep") / 2, 6).alias("total"))


@query(f"""WITH a AS ({CENTRED_SQL} SELECT gid, count(*) AS n, sqrt(pow(sum(ry*wz-rz*wy), 2)+pow(sum(rz*wx-rx*wz), 2)+pow(sum(rx*wy-ry*wx), 2)) AS l, sum({' + '.join(f'pow({math.sqrt(SCALE)!r}*w{c}+{HUBBLE}*r{c}, 2)' for c in 'xyz')})/2 AS ekin FROM c GROUP BY gid),
b AS ({BOUND_SQL} SELECT gid, sum(ep)/2 AS total FROM ep GROUP BY gid) SELECT gid, round(l*sqrt(abs(ekin+total))/({halos.GCONS!r}*pow(n, 2.5)), 1) AS spin FROM a JOIN b USING (gid)""")
def ag11_spin(spark, d):
    m = written_members(spark, d)
    return halos.spin(m, BOX, 1.0, SCALE, HUBBLE).select("gid", F.round("spin", 1).alias("spin"))


@query(FOF_SQL + " SELECT id, x, y, z FROM members WHERE gid = (SELECT min(gid) FROM members)")
def flt7_single_group(spark, d):
    m = written_members(spark, d)
    least = m.agg(F.min("gid").alias("gid"))
    return m.join(F.broadcast(least), "gid").select("id", *"xyz")  # one row: its size is proven


# -- filaments --------------------------------------------------------------------------------------------
@query(f"WITH {PROPS_SQL}{AFTER_NODES} SELECT fil FROM props JOIN ea USING (fil) WHERE flag = 2 AND elong >= 0.7 AND len BETWEEN 30 AND 60")
def flt4_combined_cut(spark, d):
    p = polyline.properties(fx.nodes(spark, d), BOX)
    return p.join(filament_ends(spark, d).where("flag = 2").select("fil"), "fil").where("elong >= 0.7 and len between 30 and 60").select("fil")


RVIR = 2.0  # box units for each cube root of a particle


@query(f"WITH {NODES_SQL}, {PARAMS_SQL}{AFTER_NODES}, near AS (SELECT DISTINCT id, fil FROM ({NEAR_NODES})), e AS (SELECT fil, {', '.join(f'min_by({c}, k) AS a{c}, max_by({c}, k) AS z{c}' for c in 'xyz')} FROM nodes WHERE size > 1 GROUP BY fil) SELECT near.fil, count(*) AS n FROM near JOIN particles p USING (id) JOIN e ON e.fil = near.fil JOIN ea ON ea.fil = near.fil WHERE sqrt({END_D2['a']}) > {RVIR}*cbrt(m0) AND sqrt({END_D2['z']}) > {RVIR}*cbrt(m1) GROUP BY near.fil")
def flt5_outside_virial_spheres(spark, d):
    """Particles near a filament outside the virial sphere of each of its ends."""
    p, n = fx.particles(spark, d), fx.nodes(spark, d).where("size > 1")
    near = rangejoin.range_join(p.select("id", *"xyz"), n.select("fil", *"xyz"), separation(p, 1.2), BOX).select(F.col("p_id").alias("id"), F.col("c_fil").alias("fil")).distinct()
    e = n.groupBy("fil").agg(*(f(c, "k").alias(f"{q}{c}") for c in "xyz" for q, f in (("a_", F.min_by), ("z_", F.max_by)))).join(filament_ends(spark, d).select("fil", "m0", "m1"), "fil")
    rows = near.join(p.select("id", *(F.col(c).alias(f"p_{c}") for c in "xyz")), "id").join(e, "fil")
    far = lambda side, m: F.sqrt(rangejoin.distance2(side, "p_", BOX).cast("double")) > RVIR * F.cbrt(m)
    return rows.where(far("a_", "m0") & far("z_", "m1")).groupBy("fil").agg(F.count("*").alias("n"))


@query(f"WITH {ENDS_SQL} SELECT a.fil AS cut, max(b.fil) AS fil FROM ea a JOIN ea b ON a.id0 = b.id0 AND a.id1 = b.id1 WHERE a.flag = 2 AND b.flag = 2 GROUP BY a.fil")
def jn10_same_ends(spark, d):
    """Catalogue cross-match on the halo ids of both ends, both above the cut; the last match counts."""
    e = filament_ends(spark, d).where("flag = 2").select("fil", "id0", "id1")
    # pre-aggregated: a hot pair of ends gives one row, not all pairs
    last = e.groupBy("id0", "id1").agg(F.max("fil").alias("last"))
    return e.join(last, ["id0", "id1"]).select(F.col("fil").alias("cut"), F.col("last").alias("fil"))


@query(f"WITH {PROPS_SQL} SELECT n.fil, n.k, round(p.len, 5) AS len, p.size FROM nodes n JOIN props p USING (fil)")
def jn12_segments_with_properties(spark, d):
    n = fx.nodes(spark, d)
    return n.select("fil", "k").join(polyline.properties(n, BOX), "fil").select("fil", "k", F.round("len", 5).alias("len"), "size")


@query(f"WITH {PROPS_SQL} SELECT fil, 1 AS kind, round(len, 5) AS len FROM props WHERE size > 3 UNION ALL SELECT fil, 2, round(len, 5) FROM props WHERE size BETWEEN 2 AND 3")
def set2_stacked_kinds(spark, d):
    p = polyline.properties(fx.nodes(spark, d), BOX).select("fil", "size", F.round("len", 5).alias("len"))
    return p.where("size > 3").select("fil", F.lit(1).alias("kind"), "len").unionByName(p.where("size between 2 and 3").select("fil", F.lit(2).alias("kind"), "len"))


@query(f"WITH {NODES_SQL} SELECT fil, k, x FROM nodes WHERE size >= 4")
def set3_spliced_profiles(spark, d):
    """Beginning, middle and end of each profile, spliced without the nodes that they share."""
    n = fx.nodes(spark, d).where("size >= 4").select("fil", "k", "x", "size")
    begin, middle, end = n.where("k <= 1"), n.where("k >= 1 and k <= size - 2"), n.where("k >= size - 2")
    return begin.where("k < 1").unionByName(middle).unionByName(end.where("k > size - 2")).select("fil", "k", "x")


@query(f"WITH {HALOS_SQL} SELECT DISTINCT numpart FROM halos")
def set4_distinct_masses(spark, d):
    return fx.halos(spark, d).select("numpart").distinct()


@query(f"WITH {HALOS_SQL} SELECT id, numpart, row_number() OVER (ORDER BY numpart DESC, id) AS rank FROM halos")
def srt2_mass_order(spark, d):
    return stacking.ranked(fx.halos(spark, d).select("id", "numpart"), "numpart", "id")


# -- edges, kernels, units -------------------------------------------------------------------------------
def listed(spark: SparkSession, values: list[float], digits: int = 6) -> DataFrame:
    return spark.createDataFrame([(i, round(float(v), digits)) for i, v in enumerate(values)], "i int, value double")


@query("SELECT CAST(0 AS INTEGER) AS i, CAST(400.0 AS DOUBLE) AS value UNION ALL SELECT CAST(i+1 AS INTEGER), round(pow(pow(10, log10(0.4::DOUBLE)+(log10(20.0::DOUBLE)-log10(0.4::DOUBLE))/10*(9-i)), 2), 6) FROM range(10) t(i)")
def fn1_log_edges(spark, d):
    return listed(spark, g.log_edges(20.0, 0.4, 10))


@query("SELECT CAST(i AS INTEGER) AS i, round(pow(20.0::DOUBLE-1.9::DOUBLE*i, 2), 6) AS value FROM range(11) t(i)")
def fn2_linear_edges(spark, d):
    return listed(spark, g.linear_edges(20.0, 1.0, 10))


@query(f"WITH {PROPS_SQL}, r AS (SELECT fil, least(len, 40.0) AS r1 FROM props) SELECT fil, CAST(i AS INTEGER) AS i, round(CASE WHEN i = 0 THEN r1 ELSE pow(10, log10(r1/50)+(log10(r1)-log10(r1/50))/5*(5-i)) END, 5) AS edge FROM r, range(6) t(i)")
def fn3b_filament_edges(spark, d):
    return profiles.filament_edges(polyline.properties(fx.nodes(spark, d), BOX).select("fil", "len"), 40.0, 5).select("fil", "i", F.round("edge", 5).alias("edge"))


@query(f"WITH {HALOS_SQL}, {PARTICLES_SQL}, params AS (SELECT 30 AS r), near AS ({near_sql('halos', 'particles', 'r', 'a.id AS cid', 'true')}), b AS (SELECT cid, CAST(floor(round((log10(sqrt(d2))-log10(2.0::DOUBLE))/(log10(30.0::DOUBLE)-log10(2.0::DOUBLE))*6, 9)) AS INTEGER) AS bin FROM near WHERE d2 > 0) SELECT cid, bin, count(*) AS n FROM b WHERE bin BETWEEN 0 AND 5 GROUP BY cid, bin")
def fn4_log_ring(spark, d):
    near = rangejoin.range_join(fx.particles(spark, d).select("id", *"xyz"), fx.halos(spark, d).select("id", *"xyz"), 30, BOX).where("d2 > 0")
    bin_ = g.even_ring(F.sqrt(F.col("d2").cast("double")), 2.0, 30.0, 6, log=True)
    return near.withColumn("bin", bin_).where("bin between 0 and 5").groupBy(F.col("c_id").alias("cid"), "bin").agg(F.count("*").alias("n"))


@query(f"WITH {HALOS_SQL}, {PARTICLES_SQL}, params AS (SELECT 30 AS r), near AS ({near_sql('halos', 'particles', 'r', 'a.id AS cid', 'true')}), u AS (SELECT cid, sqrt(d2)/30 AS u FROM near) SELECT cid, round(sum(CASE WHEN u < 0.5 THEN 1-6*u*u+6*u*u*u ELSE 2*pow(1-u, 3) END)*8/(pi()*27000), 9) AS rho FROM u GROUP BY cid")
def fn11_spline_density(spark, d):
    return profiles.spline_density(fx.particles(spark, d), fx.halos(spark, d), 30, BOX).select("cid", F.round("rho", 9).alias("rho"))


@query(f"WITH {HALOS_SQL}, params AS (SELECT 40 AS r), near AS ({near_sql('halos', 'halos', 'r', 'a.id AS a, b.id AS b, 3*cbrt(a.numpart) AS p, 3*cbrt(b.numpart) AS q', 'a.id < b.id')}), s AS (SELECT *, sqrt(d2) AS d, least(p, q) AS small FROM near) SELECT a, b, round(CASE WHEN d >= p+q THEN 0 WHEN d <= abs(p-q) THEN 4.0/3*pi()*pow(small, 3) ELSE pi()*pow(p+q-d, 2)*(d*d+2*d*(p+q)-3*pow(p-q, 2))/(12*d) END, 3) AS volume FROM s")
def fn13_lens_volume(spark, d):
    h = fx.halos(spark, d).select("id", *"xyz", "numpart")
    near = rangejoin.range_join(h, h, 40, BOX, p="b_", c="a_").where("a_id < b_id")
    v = profiles.lens_volume(3 * F.cbrt("a_numpart"), 3 * F.cbrt("b_numpart"), F.sqrt(F.col("d2").cast("double")))
    return near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(v, 3).alias("volume"))


@query(f"WITH {PARTICLES_SQL}, {HALOS_SQL}, {PARAMS_SQL}, near AS ({near_sql('halos', 'particles', 'r2', 'a.id AS cid', 'true')}) SELECT cid, round(sum(2.5*exp(-d2/200.0))/(pow(0.01::DOUBLE, 3)*0.5*sqrt(0.5::DOUBLE)*2/sqrt(pi())), 1) AS rho FROM near GROUP BY cid")
def fn10_normalised_density(spark, d):
    """Mass-weighted, over h^3 / 2 sqrt(1/2) 2 / sqrt(pi) with h in Mpc."""
    p = fx.particles(spark, d)
    w = profiles.gaussian_density(p, fx.halos(spark, d), 10.0, separation(p, 1.2), BOX)
    return w.select("cid", F.round(2.5 * F.col("w") / ((10.0 / 1000) ** 3 * 0.5 * math.sqrt(0.5) * 2 / math.sqrt(math.pi)), 1).alias("rho"))


@query(f"WITH {PARTICLES_SQL} SELECT id, round(x/1000.0, 6) AS x, round(vx*0.5, 6) AS vx FROM particles")
def prj5_units(spark, d):
    return fx.particles(spark, d).select("id", F.round(F.col("x") / 1000, 6).alias("x"), F.round(F.col("vx") * 0.5, 6).alias("vx"))


@query("SELECT CAST(i AS INTEGER) AS i, round(greatest((0.2::DOUBLE+0.1::DOUBLE*i)*cbrt(0.118219e10/0.25/277.5e9)*1000, 90.0), 6) AS value FROM range(8) t(i)")
def prj6_linking_lengths(spark, d):
    return listed(spark, [g.linking_length(0.2 + 0.1 * i, 0.118219, 0.25, softening=90.0) for i in range(8)])


@query("SELECT CAST(i AS INTEGER) AS i, round((5.0::DOUBLE-i)/5.0*cbrt(1.0::DOUBLE/201), 6) AS value FROM range(5) t(i)")
def prj7_level_ladder(spark, d):
    """Default levels b_i = (n + 1 - i) / (n + 1) cbrt(1 / (1 + 200)), n = 4."""
    return listed(spark, [(5 - i) / 5 * g.fraction_of_overdensity(200) for i in range(5)])


@query("WITH z AS (SELECT i, i*0.5::DOUBLE AS z FROM range(6) t(i)), x AS (SELECT i, 0.25*pow(1+z, 3)/(0.25*pow(1+z, 3)+0.75)-1 AS x FROM z) SELECT CAST(i AS INTEGER) AS i, round(18*pi()*pi()+82*x-39*x*x, 6) AS value FROM x")
def ag7_virial_threshold(spark, d):
    return listed(spark, [halos.virial_overdensity(0.25, 0.75, 0.5 * i) for i in range(6)])


# -- profiles -----------------------------------------------------------------------------------------------
SHELLS_SQL = f"""WITH {PARTICLES_SQL}, {HALOS_SQL}, {PARAMS_SQL}, near AS ({near_sql('halos', 'particles', 'r2', 'a.id AS cid, b.rr AS r2, ' + ', '.join(f"{mi(f'b.{c}-a.{c}')}*b.v{c} AS t{c}" for c in 'xyz'), 'true')}),
b AS (SELECT cid, CASE WHEN d2 < r2*r2/16.0 THEN 2 WHEN d2 < r2*r2/4.0 THEN 1 ELSE 0 END AS iy, coalesce((tx+ty+tz)/nullif(sqrt(d2), 0), 0) AS vr FROM near)"""


@query(SHELLS_SQL + ", g AS (SELECT cid, iy, count(*) AS n, sum(vr) AS s FROM b GROUP BY cid, iy) SELECT cid, iy, CAST(sum(n) OVER w AS BIGINT) AS n_in, round(sum(s) OVER w/sum(n) OVER w, 4) AS vr_in FROM g WINDOW w AS (PARTITION BY cid ORDER BY iy DESC)")
def ag18_cumulative_velocity(spark, d):
    """Mean radial velocity of all shells inside."""
    p = fx.particles(spark, d)
    r = separation(p, 1.2)
    return profiles.shell_profile(p, fx.halos(spark, d), [float(r * r), r * r / 4, r * r / 16], BOX).select("cid", "iy", "n_in", F.round("vr_in", 4).alias("vr_in"))


@query(SHELLS_SQL + " SELECT cid, iy, count(*) AS n, round(CASE WHEN count(*) > 10 THEN stddev_samp(vr) ELSE 0 END, 4) AS sr FROM b GROUP BY cid, iy")
def ag17_shell_dispersion(spark, d):
    p = fx.particles(spark, d)
    r = separation(p, 1.2)
    return profiles.shell_profile(p, fx.halos(spark, d), [float(r * r), r * r / 4, r * r / 16], BOX).select("cid", "iy", "n", F.round("sr", 4).alias("sr"))


BINS_SQL = f"{PIECES_SQL}, b AS (SELECT *, CASE WHEN perp2 < r2*r2/16.0 THEN 2 WHEN perp2 < r2*r2/4.0 THEN 1 ELSE 0 END AS iy, CAST(floor(round(s/len*4, 9)) AS INTEGER) AS ix, (vx*ex+vy*ey+vz*ez)/d AS vpar, coalesce((vx*(rx-num*ex/CAST(e2 AS DOUBLE))+vy*(ry-num*ey/CAST(e2 AS DOUBLE))+vz*(rz-num*ez/CAST(e2 AS DOUBLE)))/nullif(sqrt(perp2), 0), 0) AS vperp FROM proj)"


def binned(spark: SparkSession, d: str) -> DataFrame:
    p, n = fx.particles(spark, d), fx.nodes(spark, d).where("size > 1")
    r = separation(p, 1.2)
    # s as a rounded share of the length, so that both engines bin alike
    proj = profiles.nearest_piece(p, n, r, BOX, ("fil", "perp2", "s", "len", "vpar", "vperp")).withColumn("s", F.round(F.col("s") / F.col("len") * 4, 9)).withColumn("len", F.lit(4.0))
    return profiles.profile_matrix(proj, [float(r * r), r * r / 4, r * r / 16], 4)


@query(f"WITH {BINS_SQL} SELECT fil, ix, iy, count(*) AS n, round(avg(vpar), 4) AS vpar, round(avg(vperp), 4) AS vperp, round(CASE WHEN count(*) > 10 THEN stddev_samp(vpar) ELSE 0 END, 4) AS spar, round(CASE WHEN count(*) > 10 THEN stddev_samp(vperp) ELSE 0 END, 4) AS sperp FROM b WHERE ix < 4 GROUP BY fil, ix, iy")
def ag12_filament_matrix(spark, d):
    return binned(spark, d).select("fil", "ix", "iy", "n", *(F.round(c, 4).alias(c) for c in ("vpar", "vperp", "spar", "sperp")))


@query(f"WITH {BINS_SQL}, m AS (SELECT fil, ix, iy, count(*) AS n, avg(vpar) AS vpar FROM b WHERE ix < 4 GROUP BY fil, ix, iy), f AS (SELECT DISTINCT fil FROM m), gr AS (SELECT fil, CAST(i AS INTEGER) AS ix, CAST(j AS INTEGER) AS iy FROM f, range(4) a(i), range(3) b(j)) SELECT fil, ix, iy, coalesce(n, 0) AS n, round(coalesce(vpar, 0), 4) AS vpar FROM gr LEFT JOIN m USING (fil, ix, iy)")
def ag12_densified_matrix(spark, d):
    return profiles.densified(binned(spark, d).select("fil", "ix", "iy", "n", "vpar"), 4, 3).select("fil", "ix", "iy", "n", F.round("vpar", 4).alias("vpar"))


@query(f"WITH {BINS_SQL}, m AS (SELECT fil, ix, iy, least(greatest(count(*), 1), 3) AS n FROM b WHERE ix < 4 GROUP BY fil, ix, iy) SELECT ix, iy, round(avg(n), 6) AS mean, count(*) AS n FROM m GROUP BY ix, iy")
def ag29_stack(spark, d):
    """Mean over filaments of counts cut to 1 ... 3."""
    return stacking.stacked(binned(spark, d), "n", (1, 3)).select("ix", "iy", F.round("mean", 6).alias("mean"), "n")


@query(f"WITH {BINS_SQL}, m AS (SELECT fil, ix, iy, least(greatest(count(*), 1), 1000) AS n FROM b WHERE ix < 4 GROUP BY fil, ix, iy) SELECT ix, iy, round(log10(avg(n)), 6) AS mean FROM m GROUP BY ix, iy")
def ag30_log_stack(spark, d):
    return stacking.stacked(binned(spark, d), "n", (1, 1000)).select("ix", "iy", F.round(F.log10("mean"), 6).alias("mean"))


@query(f"WITH {PROPS_SQL}, b AS (SELECT CAST(floor(round((log10(len)-log10(5.0::DOUBLE))/(log10(200.0::DOUBLE)-log10(5.0::DOUBLE))*12, 9)) AS INTEGER) AS bin FROM props), k AS (SELECT bin, count(*) AS n FROM b WHERE bin BETWEEN 0 AND 11 GROUP BY bin) SELECT bin, n, round(n/sum(n) OVER (), 8) AS share FROM k")
def ag33_log_histogram(spark, d):
    h = stacking.histogram(polyline.properties(fx.nodes(spark, d), BOX), "len", 5.0, 200.0, 12, log=True)
    return stacking.normalised(h).select("bin", "n", F.round("share", 8).alias("share"))


@query(f"WITH {PROPS_SQL}, b AS (SELECT CAST(floor(round((len-0.5)/150*10, 9)) AS INTEGER) AS i, CAST(floor(round(elong*10, 9)) AS INTEGER) AS j FROM props) SELECT i, j, count(*) AS n FROM b WHERE i BETWEEN 0 AND 9 AND j BETWEEN 0 AND 9 GROUP BY i, j")
def ag33_histogram_2d(spark, d):
    return stacking.histogram_2d(polyline.properties(fx.nodes(spark, d), BOX), ("len", 0.5, 150.5, 10), ("elong", 0.0, 1.0, 10))


@query(f"""WITH {PROPS_SQL}, r AS (SELECT size, len AS v, row_number() OVER (PARTITION BY size ORDER BY len) AS i, count(*) OVER (PARTITION BY size) AS n FROM props), o AS (SELECT a.size, a.i, a.n, CASE WHEN (a.n-1)%2 = 1 THEN max(CASE WHEN b.j = a.n//2 THEN b.v END) ELSE (max(CASE WHEN b.j = (a.n-1)//2 THEN b.v END)+max(CASE WHEN b.j = (a.n-1)//2+1 THEN b.v END))/2 END AS med
FROM r a JOIN (SELECT size, i, v, n, unnest([i, i-1]) AS j, unnest([true, false]) AS low FROM r) b ON a.size = b.size AND ((b.low AND b.i < a.i) OR (NOT b.low AND b.i > a.i)) AND b.j BETWEEN (a.n-1)//2 AND a.n//2+1 GROUP BY a.size, a.i, a.n),
jk AS (SELECT size, count(*) AS n, avg(med) AS m, var_pop(med)*(count(*)-1) AS v FROM o GROUP BY size HAVING count(*) > 2), t AS (SELECT size, median(len) AS med FROM props GROUP BY size)
SELECT size, n, round(n*med-(n-1)*m, 4) AS estimate, round(sqrt(v), 4) AS error FROM jk JOIN t USING (size)""")
def ag32_jackknife_median(spark, d):
    p = polyline.properties(fx.nodes(spark, d), BOX)
    return stacking.jackknife_median(p, "len", ["size"]).select("size", "n", F.round("estimate", 4).alias("estimate"), F.round("error", 4).alias("error"))


@query(f"WITH {PARTICLES_SQL} SELECT id, y, vy FROM particles UNION ALL SELECT id, -y, -vy FROM particles WHERE y <> 0")
def geo9_mirrored_field(spark, d):
    """A flow field and its mirror image at the axis."""
    p = fx.particles(spark, d).select("id", "y", "vy")
    return p.unionByName(p.where("y != 0").select("id", (-F.col("y")).alias("y"), (-F.col("vy")).alias("vy")))
