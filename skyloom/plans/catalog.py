"""The registered queries, one key per operator, and their independent SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.tables import written
from ..operators import controls, graph, halos, polyline, profiles, rangejoin, stacking
from ..sources import fixtures as fx
from ..sources.fixtures import BOX, HALOS_SQL, NODES_SQL, PARTICLES_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def separation(points: DataFrame, factor: float) -> int:
    """floor(factor * mean separation)."""
    return int(factor * (BOX**3 / points.count()) ** (1 / 3))


def mi(d: str) -> str:
    return f"(({d}) - CASE WHEN ({d}) >= 500 THEN 1000 WHEN ({d}) < -500 THEN -1000 ELSE 0 END)"


def sq(a: str, b: str) -> str:
    return "(" + " + ".join(f"{mi(f'{b}.{c}-{a}.{c}')}*{mi(f'{b}.{c}-{a}.{c}')}" for c in "xyz") + ")"


def near_sql(left: str, right: str, r: str, keep: str, on: str, op: str = "<") -> str:
    """Join of two CTEs within r, by slabs in x (three at least)."""
    n = f"greatest(3, CAST(floor(1000/{r}) AS BIGINT))"
    slab = f"CAST(floor(x*{n}/1000) AS BIGINT)"
    return (
        f"SELECT {keep}, {sq('a', 'b')} AS d2 FROM (SELECT {left}.*, (({slab} + o + {n}) % {n}) AS slab FROM {left}, params, (VALUES (-1),(0),(1)) t(o)) a "
        f"JOIN (SELECT {right}.*, {slab} AS slab, {r} AS rr FROM {right}, params) b ON a.slab = b.slab AND {on} WHERE {sq('a', 'b')} {op} rr*rr"
    )


PARAMS_SQL = "params AS (SELECT CAST(floor(0.6*cbrt(1e9/count(*))) AS BIGINT) AS r, CAST(floor(1.2*cbrt(1e9/count(*))) AS BIGINT) AS r2, count(*) AS np FROM particles)"
EDGES_SQL = f"{PARTICLES_SQL}, {PARAMS_SQL}, edges AS ({near_sql('particles', 'particles', 'r', 'a.id AS a, b.id AS b', 'a.id < b.id')})"
LABELS_SQL = """sym AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach AS (SELECT id AS root, id FROM particles UNION SELECT reach.root, sym.b FROM reach JOIN sym ON reach.id = sym.a WHERE sym.b > reach.root),
labels AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""
FOF_SQL = f"WITH RECURSIVE {EDGES_SQL}, {LABELS_SQL}, grp AS (SELECT root AS gid, count(*) AS n FROM labels GROUP BY root HAVING count(*) >= 3), members AS (SELECT p.*, gid, n FROM labels l JOIN grp ON l.root = gid JOIN particles p ON p.id = l.id)"


def linked(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    p = fx.particles(spark, d)
    return p, separation(p, 0.6)


def members(spark: SparkSession, d: str) -> DataFrame:
    p, r = linked(spark, d)
    return graph.fof(p, r, BOX, 3)


def written_members(spark: SparkSession, d: str) -> DataFrame:
    """members() as a table, for operators that read them more than once."""
    return written(members(spark, d), "members")


# -- scans and projections -------------------------------------------------------------------------
@query(f"WITH {PARTICLES_SQL} SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, round(1.001*greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)), 6) AS side FROM particles")
def src6_bounding_box(spark, d):
    p = fx.particles(spark, d)
    return p.agg(*(F.min(c).alias(f"{c}0") for c in "xyz"), F.round(1.001 * F.greatest(*(F.max(c) - F.min(c) for c in "xyz")), 6).alias("side"))


@query(f"WITH {HALOS_SQL} SELECT * FROM halos WHERE numpart >= 200")
def src10_mass_cut(spark, d):
    return fx.halos(spark, d).where("numpart >= 200")


@query(f"WITH {PARTICLES_SQL} SELECT * FROM particles WHERE z > 100 AND z < 200")
def src16_slab(spark, d):
    return fx.particles(spark, d).where("z > 100 and z < 200")


@query(f"WITH {PARTICLES_SQL} SELECT id, CAST(floor(x*41/1000.0)*41*41 + floor(y*41/1000.0)*41 + floor(z*41/1000.0) AS BIGINT) AS cell, CAST(floor(x*41/1000.0) AS BIGINT) AS ix, CAST(floor(z*41/1000.0) AS BIGINT) AS iz FROM particles")
def prj3_cells(spark, d):
    p = rangejoin.with_cell(fx.particles(spark, d), 41, BOX)
    ix, _, iz = g.decode_cell(F.col("cell"), 41)
    return p.select("id", "cell", ix.alias("ix"), iz.alias("iz"))


@query(f"WITH {PARTICLES_SQL} SELECT id, {mi('x-vx*5')} AS dx, CASE WHEN x+vx>=1000 THEN x+vx-1000 WHEN x+vx<0 THEN x+vx+1000 ELSE x+vx END AS wx FROM particles")
def prj1_minimum_image_and_wrap(spark, d):
    return fx.particles(spark, d).select("id", g.minimum_image(F.col("x") - F.col("vx") * 5, BOX).alias("dx"), g.wrap(F.col("x") + F.col("vx"), BOX).alias("wx"))


@query(f"WITH {HALOS_SQL} SELECT id, round(2*cbrt(numpart)*cbrt(3/(4*pi()*1.0*15000))*1000*0.6, 6) AS rvir FROM halos")
def prj8_virial_radius(spark, d):
    return fx.halos(spark, d).select("id", F.round(g.virial_radius(F.col("numpart"), BOX, 1.0, 15000, 0.6, 2.0), 6).alias("rvir"))


# -- range joins -------------------------------------------------------------------------------------
@query(f"WITH {EDGES_SQL} SELECT a, b, d2 FROM edges")
def jn2_range_self_join(spark, d):
    p, r = linked(spark, d)
    return rangejoin.range_self_join(p, r, BOX)


@query(f"WITH {EDGES_SQL} SELECT l.name AS level, count(*) AS pairs FROM edges, params, (VALUES ('a', 1.0), ('b', 0.75), ('c', 0.5)) l(name, f) WHERE d2 < (f*r)*(f*r) GROUP BY l.name")
def jn3_multi_radius(spark, d):
    p, r = linked(spark, d)
    pairs = rangejoin.range_self_join(p, r, BOX)
    levels = F.explode(F.filter(F.array(*(F.struct(F.lit(n).alias("level"), F.lit((f * r) ** 2).alias("r2")) for n, f in (("a", 1.0), ("b", 0.75), ("c", 0.5)))), lambda s: F.col("d2") < s["r2"])).alias("l")
    return pairs.select("d2", levels).groupBy(F.col("l.level").alias("level")).agg(F.count("*").alias("pairs"))


NEAR_NODES = near_sql("nodes", "particles", "r2", "b.id AS id, a.fil AS fil", "a.size > 1")


@query(f"WITH {NODES_SQL}, {PARAMS_SQL}, near AS ({NEAR_NODES}) SELECT id, fil, min(d2) AS d2 FROM near GROUP BY id, fil")
def jn4_particles_near_filaments(spark, d):
    p, n = fx.particles(spark, d), fx.nodes(spark, d).where("size > 1")
    return rangejoin.range_join(p.select("id", *"xyz"), n.select("fil", *"xyz"), separation(p, 1.2), BOX).groupBy(F.col("p_id").alias("id"), F.col("c_fil").alias("fil")).agg(F.min("d2").alias("d2"))


@query(f"WITH {PARTICLES_SQL}, {HALOS_SQL}, {PARAMS_SQL}, near AS ({near_sql('halos', 'particles', 'r', 'a.id AS id', 'true')}) SELECT DISTINCT id FROM near")
def jn8_existence_probe(spark, d):
    p, r = linked(spark, d)
    return rangejoin.exists_within(fx.halos(spark, d).select("id", *"xyz"), p.select(*"xyz"), r, BOX).select("id")


@query(f"WITH {HALOS_SQL}, params AS (SELECT 60 AS r), big AS (SELECT * FROM halos WHERE numpart >= 200), near AS ({near_sql('big', 'big', 'r', 'a.id AS a, b.id AS b', 'a.id < b.id', '<=')}) SELECT a, b, d2 FROM near WHERE d2 >= 400")
def jn9_distance_window_pairs(spark, d):
    big = fx.halos(spark, d).where("numpart >= 200").select("id", *"xyz")
    near = rangejoin.range_join(big, big, 60, BOX, inclusive=True, p="b_", c="a_").where("a_id < b_id and d2 >= 400")
    return near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "d2")


@query(f"WITH {NODES_SQL}, e AS (SELECT fil, min_by(x, k) AS x0, max_by(x, k) AS x1, max(size) AS size FROM nodes WHERE size > 1 GROUP BY fil) SELECT a.fil AS cut, max(b.fil) AS fil FROM e a JOIN e b ON a.x0 = b.x0 AND a.x1 = b.x1 WHERE a.size = 2 GROUP BY a.fil")
def jn10_cross_match(spark, d):
    e = fx.nodes(spark, d).where("size > 1").groupBy("fil").agg(F.min_by("x", "k").alias("x0"), F.max_by("x", "k").alias("x1"), F.max("size").alias("size"))
    cut = e.where("size = 2").select(F.col("fil").alias("cut"), "x0", "x1")
    return cut.join(e.select("fil", "x0", "x1"), ["x0", "x1"]).groupBy("cut").agg(F.max("fil").alias("fil"))


# -- groups ----------------------------------------------------------------------------------------
@query(FOF_SQL + " SELECT id, gid, n FROM members")
def gr2_fof_groups(spark, d):
    return members(spark, d).select("id", "gid", "n")


@query(FOF_SQL + " SELECT n, count(*) AS groups FROM grp GROUP BY n")
def ag1_group_sizes(spark, d):
    return members(spark, d).groupBy("gid").agg(F.first("n").alias("n")).groupBy("n").agg(F.count("*").alias("groups"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, {LABELS_SQL}, outer_ AS (SELECT id, root, count(*) OVER (PARTITION BY root) AS n FROM labels), alive AS (SELECT id, root AS save, n FROM outer_ WHERE n >= 3),
e2 AS (SELECT a, b FROM edges, params WHERE d2 < (0.75*r)*(0.75*r) AND a IN (SELECT id FROM alive) AND b IN (SELECT id FROM alive)), sym2 AS (SELECT a, b FROM e2 UNION ALL SELECT b, a FROM e2),
reach2 AS (SELECT id AS root, id FROM alive UNION SELECT reach2.root, sym2.b FROM reach2 JOIN sym2 ON reach2.id = sym2.a WHERE sym2.b > reach2.root), lab2 AS (SELECT id, min(root) AS root FROM reach2 GROUP BY id),
inner_ AS (SELECT l.id, l.root, save, count(*) OVER (PARTITION BY l.root) AS n FROM lab2 l JOIN alive USING (id))
SELECT 'outer' AS level, id, save AS gid, save, n FROM alive UNION ALL SELECT 'inner', id, root, save, n FROM inner_ WHERE n >= 3""")
def gr3_nested_fof(spark, d):
    p, r = linked(spark, d)
    return graph.nested_fof(p, [("outer", r), ("inner", 0.75 * r)], BOX, 3)


@query(f"""WITH RECURSIVE {EDGES_SQL}, lev AS (SELECT * FROM (VALUES ('a', 1.0), ('c', 0.5)) l(level, f)), sym AS (SELECT level, a, b FROM edges, params, lev WHERE d2 < (f*r)*(f*r) UNION ALL SELECT level, b, a FROM edges, params, lev WHERE d2 < (f*r)*(f*r)),
reach AS (SELECT level, id AS root, id FROM particles, lev UNION SELECT reach.level, reach.root, sym.b FROM reach JOIN sym ON reach.id = sym.a AND reach.level = sym.level WHERE sym.b > reach.root),
labels AS (SELECT level, id, min(root) AS gid FROM reach GROUP BY level, id), counted AS (SELECT *, count(*) OVER (PARTITION BY level, gid) AS n FROM labels) SELECT level, id, gid, n FROM counted WHERE n >= 3""")
def gr4_levels(spark, d):
    p, r = linked(spark, d)
    return graph.fof_levels(p, {"a": r, "c": 0.5 * r}, BOX, 3)


@query()
def gr8_spanning_forest(spark, d):
    """Radius graph of halos with weight -N N / d2; tested against Kruskal."""
    h = fx.halos(spark, d)
    pairs = rangejoin.range_self_join(h, separation(h, 1.0), BOX)
    mass = h.select("id", "numpart")
    e = pairs.join(mass.toDF("a", "na"), "a").join(mass.toDF("b", "nb"), "b").select(F.col("a").alias("i"), F.col("b").alias("j"), "d2", "na", "nb").where("d2 > 0")
    return graph.spanning_forest(e, -F.col("na") * F.col("nb") / F.col("d2"))


# -- group properties ---------------------------------------------------------------------------------
OFF = ", ".join(f"{mi(f'm.{c}-o.{c}')} AS q{c}" for c in "xyz")
CENTRED_SQL = f"""{FOF_SQL}, o AS (SELECT gid, min_by(x, id) AS x, min_by(y, id) AS y, min_by(z, id) AS z FROM members GROUP BY gid),
q AS (SELECT m.gid, m.id, m.vx, m.vy, m.vz, o.x AS ox, o.y AS oy, o.z AS oz, {OFF} FROM members m JOIN o USING (gid)),
c AS (SELECT *, count(*) OVER w AS n, {", ".join(f"q{c} - sum(q{c}) OVER w / count(*) OVER w AS r{c}, sum(q{c}) OVER w / count(*) OVER w AS mean{c}, v{c} - sum(v{c}) OVER w / count(*) OVER w AS w{c}" for c in "xyz")} FROM q WINDOW w AS (PARTITION BY gid))"""


@query(CENTRED_SQL + f" SELECT gid, any_value(n) AS n, {', '.join(f'round(fmod(any_value(o{c}+mean{c})+1000, 1000), 5) AS c{c}, round(avg(v{c}), 5) AS vm{c}, round(stddev_samp(v{c}), 5) AS sig{c}' for c in 'xyz')}, round(sum(rx*wy-ry*wx), 4) AS lz, round(avg(rx*ry), 5) AS mxy, round(avg(rz*rz), 5) AS mzz, round(sum(wx*wx+wy*wy+wz*wz)/2, 4) AS ekin FROM c GROUP BY gid")
def ag2_to_ag9_halo_properties(spark, d):
    h = halos.properties(written_members(spark, d), BOX)
    return h.select("gid", "n", *(F.round(f"{k}{c}", 5).alias(f"{k}{c}") for c in "xyz" for k in ("c", "vm", "sig")), F.round("lz", 4).alias("lz"), F.round("mxy", 5).alias("mxy"), F.round("mzz", 5).alias("mzz"), F.round("ekin", 4).alias("ekin"))


@query(CENTRED_SQL + """, d AS (SELECT gid, id, rx*rx+ry*ry+rz*rz AS r2 FROM c), i AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY round(r2, 9), id) AS i FROM d)
SELECT gid, CAST(coalesce(min(CASE WHEN i >= 3 AND 3*i/(4*pi()*pow(r2, 1.5)) < 0.001 THEN i END), max(i)) AS BIGINT) AS n_in FROM i GROUP BY gid""")
def ag6_overdensity_radius(spark, d):
    return halos.overdensity_radius(written_members(spark, d), BOX, 0.001, 1.0, 3).select("gid", "n_in")


@query(FOF_SQL + f" SELECT a.gid, a.id, round(-{halos.GCONS!r}*sum(1/(sqrt({sq('a', 'b')})+1.0)), 6) AS ep FROM members a JOIN members b ON a.gid = b.gid AND a.id <> b.id GROUP BY a.gid, a.id")
def ag10_potential(spark, d):
    return halos.potential(written_members(spark, d), BOX, 1.0).select("gid", "id", F.round("ep", 6).alias("ep"))


# -- polylines ---------------------------------------------------------------------------------------
STEPS_SQL = f"""{NODES_SQL}, l AS (SELECT *, {", ".join(f"coalesce({mi(f'{c}-lag({c}) OVER w')}, 0) AS d{c}" for c in "xyz")} FROM nodes WINDOW w AS (PARTITION BY fil ORDER BY k)),
u AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS d, {", ".join(f"first({c}) OVER w + sum(d{c}) OVER w AS u{c}" for c in "xyz")} FROM l WINDOW w AS (PARTITION BY fil ORDER BY k ROWS UNBOUNDED PRECEDING)), a AS (SELECT *, sum(d) OVER (PARTITION BY fil ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM u)"""


@query(f"WITH {STEPS_SQL} SELECT fil, k, CAST(ux AS BIGINT) AS ux, CAST(uy AS BIGINT) AS uy, CAST(uz AS BIGINT) AS uz, round(d, 6) AS d, round(s, 5) AS s FROM a")
def poly1_poly2_poly8_arc_length(spark, d):
    return polyline.arc_length(fx.nodes(spark, d), BOX).select("fil", "k", *(F.col(f"u{c}").cast("bigint").alias(f"u{c}") for c in "xyz"), F.round("d", 6).alias("d"), F.round("s", 5).alias("s"))


PROPS_SQL = f"""{STEPS_SQL}, e AS (SELECT fil, count(*) AS size, sum(d) AS len, max(k) AS last, {", ".join(f"min_by(u{c}, k) AS a{c}, max_by(u{c}, k)-min_by(u{c}, k) AS e{c}" for c in "xyz")} FROM a GROUP BY fil HAVING count(*) > 1),
props AS (SELECT fil, any_value(e.size) AS size, any_value(len) AS len, any_value(sqrt(ex*ex+ey*ey+ez*ez)/len) AS elong,
 sqrt(sum(CASE WHEN k>0 AND k<last THEN greatest(0, (ux-ax)*(ux-ax)+(uy-ay)*(uy-ay)+(uz-az)*(uz-az) - coalesce(pow((ux-ax)*ex+(uy-ay)*ey+(uz-az)*ez, 2)/nullif(ex*ex+ey*ey+ez*ez, 0), 0)) ELSE 0 END)/any_value(e.size)) AS rms FROM a JOIN e USING (fil) GROUP BY fil)"""


@query(f"WITH {PROPS_SQL} SELECT fil, size, round(len, 5) AS len, round(elong, 6) AS elong, round(rms, 4) AS rms FROM props")
def poly3_poly4_poly5_properties(spark, d):
    return polyline.properties(fx.nodes(spark, d), BOX).select("fil", "size", F.round("len", 5).alias("len"), F.round("elong", 6).alias("elong"), F.round("rms", 4).alias("rms"))


@query(f"WITH {PROPS_SQL} SELECT fil FROM props WHERE len BETWEEN 30 AND 60 AND elong >= 0.7 AND size >= 4")
def flt2_flt3_flt4_filament_cuts(spark, d):
    return polyline.properties(fx.nodes(spark, d), BOX).where("len between 30 and 60 and elong >= 0.7 and size >= 4").select("fil")


@query(f"WITH {NODES_SQL}, f AS (SELECT fil, bool_and(z > 200 AND z < 600) AS ok FROM nodes GROUP BY fil) SELECT fil FROM f WHERE ok")
def flt8_all_nodes_in_slab(spark, d):
    return fx.nodes(spark, d).groupBy("fil").agg(F.bool_and((F.col("z") > 200) & (F.col("z") < 600)).alias("ok")).where("ok").select("fil")


@query(f"WITH {STEPS_SQL} SELECT fil, k, {', '.join(f'round(coalesce(lag(u{c}) OVER w/4.0+u{c}/2.0+lead(u{c}) OVER w/4.0, u{c}), 6) AS {c}' for c in 'xyz')} FROM a WINDOW w AS (PARTITION BY fil ORDER BY k)")
def poly9_smoothing(spark, d):
    return polyline.smoothed(fx.nodes(spark, d), BOX).select("fil", "k", *(F.round(c, 6).alias(c) for c in "xyz"))


@query(f"WITH {NODES_SQL} SELECT fil, size-1-k AS k, x, y, z FROM nodes")
def poly11_reverse(spark, d):
    return polyline.reversed_(fx.nodes(spark, d)).select("fil", "k", *"xyz")


@query()
def poly7_resample(spark, d):
    return polyline.resampled(fx.nodes(spark, d), BOX, 8)


@query()
def poly10_prolong(spark, d):
    return polyline.prolonged(fx.nodes(spark, d), BOX, 5.0)


# -- profiles ------------------------------------------------------------------------------------------
PIECES_SQL = f"""{STEPS_SQL}, {PARAMS_SQL}, near AS (SELECT DISTINCT id, fil FROM ({NEAR_NODES})),
pc AS (SELECT fil, k, x, y, z, s AS s0, lead(dx) OVER w AS ex, lead(dy) OVER w AS ey, lead(dz) OVER w AS ez, lead(d) OVER w AS d, sum(d) OVER (PARTITION BY fil) AS len FROM a WINDOW w AS (PARTITION BY fil ORDER BY k)),
r0 AS (SELECT near.id, near.fil, k, s0, len, d, ex, ey, ez, vx, vy, vz, {mi('p.x-pc.x')} AS rx, {mi('p.y-pc.y')} AS ry, {mi('p.z-pc.z')} AS rz FROM near JOIN particles p USING (id) JOIN pc ON pc.fil = near.fil AND pc.d > 0),
r1 AS (SELECT *, rx*ex+ry*ey+rz*ez AS num, ex*ex+ey*ey+ez*ez AS e2, rx*rx+ry*ry+rz*rz AS d2 FROM r0), r3 AS (SELECT *, CAST(d2*e2-num*num AS DOUBLE)/CAST(e2 AS DOUBLE) AS perp2 FROM r1, params WHERE num >= 0 AND num <= e2 AND CAST(d2*e2-num*num AS DOUBLE)/CAST(e2 AS DOUBLE) < r2*r2),
proj AS (SELECT *, s0+num/d AS s FROM r3 QUALIFY row_number() OVER (PARTITION BY id, fil ORDER BY perp2, k) = 1)"""


@query(f"WITH {PIECES_SQL} SELECT id AS pid, fil, k, round(perp2, 6) AS perp2, round(s, 5) AS s, round((vx*ex+vy*ey+vz*ez)/d, 5) AS vpar FROM proj")
def jn13_nearest_piece(spark, d):
    p, n = fx.particles(spark, d), fx.nodes(spark, d).where("size > 1")
    return profiles.nearest_piece(p, n, separation(p, 1.2), BOX).select("pid", "fil", "k", F.round("perp2", 6).alias("perp2"), F.round("s", 5).alias("s"), F.round("vpar", 5).alias("vpar"))


@query(f"WITH {PIECES_SQL}, b AS (SELECT *, CASE WHEN perp2 < r2*r2/16.0 THEN 2 WHEN perp2 < r2*r2/4.0 THEN 1 ELSE 0 END AS iy, CAST(floor(round(s/len*4, 9)) AS INTEGER) AS ix, (vx*ex+vy*ey+vz*ez)/d AS vpar FROM proj) SELECT ix, iy, count(*) AS n, round(avg(vpar), 4) AS vpar, round(CASE WHEN count(*) > 10 THEN stddev_samp(vpar) ELSE 0 END, 4) AS spar FROM b WHERE ix < 4 GROUP BY ix, iy")
def ag12_profile_matrix(spark, d):
    p, n = fx.particles(spark, d), fx.nodes(spark, d).where("size > 1")
    r = separation(p, 1.2)
    proj = profiles.nearest_piece(p, n, r, BOX).withColumn("s", F.round(F.col("s") / F.col("len") * 4, 9)).withColumn("len", F.lit(4.0))
    m = profiles.profile_matrix(proj, [float(r * r), r * r / 4, r * r / 16], 4, keys=())
    return m.select("ix", "iy", "n", F.round("vpar", 4).alias("vpar"), F.round("spar", 4).alias("spar"))


@query(f"""WITH {PARTICLES_SQL}, {HALOS_SQL}, {PARAMS_SQL}, near AS ({near_sql('halos', 'particles', 'r2', 'a.id AS cid, b.rr AS r2, ' + ', '.join(f"{mi(f'b.{c}-a.{c}')}*b.v{c} AS t{c}" for c in 'xyz'), 'true')}),
b AS (SELECT cid, CASE WHEN d2 < r2*r2/16.0 THEN 2 WHEN d2 < r2*r2/4.0 THEN 1 ELSE 0 END AS iy, coalesce((tx+ty+tz)/nullif(sqrt(d2), 0), 0) AS vr FROM near), g AS (SELECT cid, iy, count(*) AS n, round(avg(vr), 5) AS vr FROM b GROUP BY cid, iy)
SELECT cid, iy, n, vr, CAST(sum(n) OVER (PARTITION BY cid ORDER BY iy DESC) AS BIGINT) AS n_in FROM g""")
def ag17_ag18_shell_profile(spark, d):
    p = fx.particles(spark, d)
    r = separation(p, 1.2)
    return profiles.shell_profile(p, fx.halos(spark, d), [float(r * r), r * r / 4, r * r / 16], BOX).select("cid", "iy", "n", F.round("vr", 5).alias("vr"), "n_in")


@query(f"""WITH {STEPS_SQL}, {PARAMS_SQL}, inner_ AS (SELECT * FROM nodes WHERE size > 1 AND k < size-1), near AS (SELECT DISTINCT id, fil FROM ({near_sql('inner_', 'particles', 'r2', 'b.id AS id, a.fil AS fil', 'true', '<=')})),
e AS (SELECT fil, sum(d) AS len, {', '.join(f'min_by({c}, k) AS a{c}, max_by({c}, k) AS z{c}' for c in 'xyz')} FROM a WHERE size > 1 GROUP BY fil),
k AS (SELECT near.fil, len FROM near JOIN particles p USING (id) JOIN e ON e.fil = near.fil WHERE {' + '.join(f"{mi(f'p.{c}-a{c}')}*{mi(f'p.{c}-a{c}')}" for c in 'xyz')} > 25 AND {' + '.join(f"{mi(f'p.{c}-z{c}')}*{mi(f'p.{c}-z{c}')}" for c in 'xyz')} > 25)
SELECT fil, CAST(count(*) AS DOUBLE) AS mass, round(CASE WHEN any_value(len) > 10 THEN count(*)/(any_value(len)-10) ELSE 0 END, 5) AS mu FROM k GROUP BY fil""")
def ag19_ag21_tube_mass(spark, d):
    p = fx.particles(spark, d)
    return profiles.tube_mass(p, fx.nodes(spark, d).where("size > 1"), separation(p, 1.2), 5, BOX).select("fil", "mass", F.round("mu", 5).alias("mu"))


@query()
def ag23_transverse_profile(spark, d):
    p = fx.particles(spark, d)
    r = separation(p, 1.2)
    return profiles.transverse_profile(p, fx.nodes(spark, d).where("size > 1"), [float(r * r), r * r / 4, r * r / 16], BOX)


@query(f"WITH {PARTICLES_SQL}, {HALOS_SQL}, {PARAMS_SQL}, near AS ({near_sql('halos', 'particles', 'r2', 'a.id AS cid', 'true')}) SELECT cid, round(sum(exp(-d2/200.0)), 6) AS w FROM near GROUP BY cid")
def fn10_gaussian_density(spark, d):
    p = fx.particles(spark, d)
    return profiles.gaussian_density(p, fx.halos(spark, d), 10.0, separation(p, 1.2), BOX).select("cid", F.round("w", 6).alias("w"))


@query(f"WITH {PARTICLES_SQL}, {HALOS_SQL}, k AS (SELECT b.id AS centre, unnest(min(struct_pack(d2 := {sq('b', 'a')}, point := a.id), 32)) AS v FROM particles a, halos b GROUP BY b.id) SELECT centre, v.point AS point, v.d2 AS d2, CAST(row_number() OVER (PARTITION BY centre ORDER BY v.d2, v.point) AS INTEGER) AS rank FROM k")
def topk1_nearest(spark, d):
    p = fx.particles(spark, d)
    return rangejoin.nearest_k(p, fx.halos(spark, d), 32, float(separation(p, 1.6)), BOX)


@query(f"WITH {PARTICLES_SQL}, {HALOS_SQL}, {PARAMS_SQL}, near AS ({near_sql('halos', 'particles', 'r2', 'a.id AS centre, b.id AS point', 'true')}) SELECT centre, point, d2, CAST(row_number() OVER w AS INTEGER) AS rank FROM near WINDOW w AS (PARTITION BY centre ORDER BY d2, point) QUALIFY row_number() OVER w <= 5")
def topk3_nearest_within(spark, d):
    p = fx.particles(spark, d)
    return rangejoin.nearest_k_within(p, fx.halos(spark, d), 5, separation(p, 1.2), BOX)


# -- controls and stacking ---------------------------------------------------------------------------
def uniform_sql(*keys: str) -> str:
    h = "12345::BIGINT"
    for k in (*keys, "0", "0"):
        h = f"((({h})*(({h})+7919) + ((({k}) % 1000003)*104729) + 1) % 1000003)"
    return f"({h}/1000003.0::DOUBLE)"


@query(f"WITH {HALOS_SQL}, r AS (SELECT id, rand, {uniform_sql('id', 'rand', '1')} AS u, {uniform_sql('id', 'rand', '2')} AS v FROM halos, (VALUES (0),(1),(2)) t(rand)) SELECT id, rand, round(sqrt(1-(2*v-1)*(2*v-1))*cos(2*pi()*u), 6) AS ex, round(sqrt(1-(2*v-1)*(2*v-1))*sin(2*pi()*u), 6) AS ey, round(2*v-1, 6) AS ez FROM r")
def rn2_isotropic_directions(spark, d):
    return controls.isotropic(fx.halos(spark, d).select("id"), 3).select("id", "rand", *(F.round(f"e{c}", 6).alias(f"e{c}") for c in "xyz"))


@query()
def rn4_mass_matched_pairs(spark, d):
    h = fx.halos(spark, d)
    big = h.where("numpart >= 200").select("id", *"xyz")
    pairs = rangejoin.range_self_join(big, 60, BOX).select("a", "b")
    return controls.mass_matched(pairs, h)


@query()
def rn1_rotated_copies(spark, d):
    return controls.rotated_copies(fx.nodes(spark, d), 2, BOX)


@query(f"WITH {PROPS_SQL}, cuts AS (SELECT quantile_cont(len, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM props), b AS (SELECT elong, CASE WHEN len <= q[2] THEN 0 WHEN len <= q[3] THEN 1 WHEN len <= q[4] THEN 2 ELSE 3 END AS q FROM props, cuts) SELECT q, count(*) AS n, round(avg(elong), 6) AS mean, round(stddev_samp(elong)/sqrt(count(*)), 6) AS error FROM b GROUP BY q")
def ag31_ag32_quantile_jackknife(spark, d):
    p = polyline.properties(fx.nodes(spark, d), BOX)
    return stacking.jackknife_mean(stacking.quantile_split(p, "len", 4), "elong", ["q"]).select("q", "n", F.round("mean", 6).alias("mean"), F.round("error", 6).alias("error"))


@query(f"WITH {PROPS_SQL} SELECT round(avg(len), 5) AS mean, round(stddev_pop(len), 5) AS std, round(min(len), 5) AS least, round(max(len), 5) AS most, round(median(len), 5) AS median FROM props")
def ag28_length_statistics(spark, d):
    out = stacking.describe(polyline.properties(fx.nodes(spark, d), BOX), "len")
    return out.select(*(F.round(c, 5).alias(c) for c in out.columns))


@query(f"WITH {PROPS_SQL}, b AS (SELECT CAST(floor((len-0.5)/150*15) AS INTEGER) AS bin FROM props) SELECT bin, count(*) AS n FROM b WHERE bin >= 0 AND bin < 15 GROUP BY bin")
def ag33_histogram(spark, d):
    return stacking.histogram(polyline.properties(fx.nodes(spark, d), BOX), "len", 0.5, 150.5, 15)


from . import extras, filaments, shapes  # noqa: E402,F401  register their queries
