"""Group properties from members (gid, id, x, y, z, vx, vy, vz). Joins on the group are hinted as merges: there
may be nearly as many groups as members, and a broadcast table of them is built in the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import AXES, minimum_image

G_NEWTON = 6.67300e-20  # km^3 / (kg s^2)
SOLAR_MASS, KPC = 1.98892e30, 3.08568025e16  # kg, km
GCONS = G_NEWTON * SOLAR_MASS / KPC * 1e10  # (km/s)^2 kpc per 1e10 solar masses


def centred(members: DataFrame, box: float) -> DataFrame:
    """members with rx, ry, rz: offsets from the centre of mass, which is taken on offsets from the
    member of smallest id (safe across faces), plus cx, cy, cz (wrapped) and velocities relative wx ...
    Aggregates are joined back, so a hot group is never gathered."""
    members = members.drop("n")
    ref = members.groupBy("gid").agg(*(F.min_by(c, "id").alias(f"o{c}") for c in AXES))
    off = members.hint("merge").join(ref.hint("merge"), "gid")
    for c in AXES:
        off = off.withColumn(f"q{c}", minimum_image(F.col(c) - F.col(f"o{c}"), box))
    mean = off.groupBy("gid").agg(F.count("*").alias("n"), *(F.sum(f"q{c}").alias(f"sq{c}") for c in AXES), *(F.sum(f"v{c}").alias(f"sv{c}") for c in AXES))
    out = off.hint("merge").join(mean.hint("merge"), "gid")
    for c in AXES:
        m = F.col(f"sq{c}") / F.col("n")
        out = out.withColumn(f"r{c}", F.col(f"q{c}") - m).withColumn(f"c{c}", F.pmod(F.col(f"o{c}") + m, F.lit(float(box)))).withColumn(f"w{c}", F.col(f"v{c}") - F.col(f"sv{c}") / F.col("n"))
    return out


def properties(members: DataFrame, box: float, mpart: float = 1.0) -> DataFrame:
    """(gid, n, cx..cz, mean velocities, sigma per axis, angular momentum, 6 shape moments, kinetic energy)."""
    c = centred(members, box)
    r, w = [F.col(f"r{a}") for a in AXES], [F.col(f"w{a}") for a in AXES]
    spin = [r[1] * w[2] - r[2] * w[1], r[2] * w[0] - r[0] * w[2], r[0] * w[1] - r[1] * w[0]]
    return c.groupBy("gid").agg(
        F.first("n").alias("n"),
        *(F.first(f"c{a}").alias(f"c{a}") for a in AXES),
        *((F.first(f"sv{a}") / F.first("n")).alias(f"vm{a}") for a in AXES),
        *(F.coalesce(F.stddev_samp(f"v{a}"), F.lit(0.0)).alias(f"sig{a}") for a in AXES),
        *((mpart * F.sum(s)).alias(f"l{a}") for a, s in zip(AXES, spin, strict=True)),
        *(F.avg(r[i] * r[j]).alias(f"m{AXES[i]}{AXES[j]}") for i in range(3) for j in range(i, 3)),
        (mpart / 2 * F.sum(w[0] * w[0] + w[1] * w[1] + w[2] * w[2])).alias("ekin"),
    )


def kinetic_energy(members: DataFrame, box: float, scale: float = 1.0, hubble: float = 0.0, mpart: float = 1.0) -> DataFrame:
    """(gid, ekin): half the sum of squares of peculiar velocities, times the root of the scale factor, plus
    the Hubble flow `hubble` * offset from the centre."""
    c = centred(members, box)
    v = [math.sqrt(scale) * F.col(f"w{a}") + hubble * F.col(f"r{a}") for a in AXES]
    return c.groupBy("gid").agg((mpart / 2 * F.sum(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])).alias("ekin"))


def spin(members: DataFrame, box: float, soft: float, scale: float = 1.0, hubble: float = 0.0, mpart: float = 1.0) -> DataFrame:
    """(gid, spin): |L| sqrt(|E|) / (G M^2.5), E from kinetic_energy() and half the summed potentials."""
    h = properties(members, box, mpart).select("gid", "n", F.sqrt(sum((F.col(f"l{a}") * F.col(f"l{a}") for a in AXES), F.lit(0.0))).alias("l"))
    bound = potential(members, box, soft, mpart, self_term=True).groupBy("gid").agg((F.sum("ep") / 2).alias("ep"))
    rows = h.hint("merge").join(kinetic_energy(members, box, scale, hubble, mpart).hint("merge"), "gid").hint("merge").join(bound.hint("merge"), "gid")
    return rows.select("gid", (F.col("l") * F.sqrt(F.abs(F.col("ekin") + F.col("ep"))) / (GCONS * F.pow(mpart * F.col("n"), F.lit(2.5)))).alias("spin"))


def axes_of(shape: DataFrame) -> DataFrame:
    """shape (mxx ... mzz) with aa >= bb >= cc: roots of the tensor's eigenvalues, in closed form."""
    xx, xy, xz, yy, yz, zz = (F.col(f"m{p}") for p in ("xx", "xy", "xz", "yy", "yz", "zz"))
    q = (xx + yy + zz) / 3
    p2 = ((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6
    p = F.sqrt(p2)
    det = (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)
    cos3 = F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(1.0))
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos3))) / 3
    one, three = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    roots = [one, 3 * q - one - three, three]
    return shape.withColumns({n: F.sqrt(F.greatest(e, F.lit(0.0))) for n, e in zip(("aa", "bb", "cc"), roots, strict=True)})


def overdensity_radius(members: DataFrame, box: float, threshold: float, mpart: float = 1.0, rank: int = 5) -> DataFrame:
    """(gid, n_in, r2, vmax2): members by distance from the centre; the first of rank >= `rank` where the
    enclosed mean density is below `threshold` (else the last); largest G M(<d) / d."""
    d = centred(members, box).withColumn("r2", F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry") + F.col("rz") * F.col("rz"))
    d = d.withColumn("i", F.row_number().over(Window.partitionBy("gid").orderBy("r2", "id")))
    rho = F.try_divide(3 * mpart * F.col("i"), 4 * math.pi * F.pow(F.col("r2"), F.lit(1.5)))
    first = F.min(F.when((F.col("i") >= rank) & (rho < threshold), F.struct("i", "r2")))
    got = d.groupBy("gid").agg(F.coalesce(first, F.max(F.struct("i", "r2"))).alias("at"), F.max(F.try_divide(GCONS * mpart * F.col("i"), F.sqrt("r2"))).alias("vmax2"))
    return got.select("gid", F.col("at.i").cast("bigint").alias("n_in"), F.col("at.r2").alias("r2"), "vmax2")


def potential(members: DataFrame, box: float, soft: float, mpart: float = 1.0, self_term: bool = False) -> DataFrame:
    """(gid, id, ep): softened direct sum over the group's other members (pairs of one group only), and with
    self_term the member itself at no distance."""
    a = members.select("gid", F.col("id").alias("a"), *(F.col(c).alias(f"a{c}") for c in AXES))
    b = members.select("gid", F.col("id").alias("b"), *(F.col(c).alias(f"b{c}") for c in AXES))
    d = [minimum_image(F.col(f"b{c}") - F.col(f"a{c}"), box) for c in AXES]
    r = F.sqrt((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).cast("double"))
    both = a.hint("merge").join(b.hint("merge"), "gid").where("a != b")
    return both.groupBy("gid", F.col("a").alias("id")).agg((-GCONS * mpart * mpart * (F.sum(1 / (r + soft)) + (1 / soft if self_term else 0.0))).alias("ep"))


def virial_overdensity(omegam: float, omegal: float, z: float) -> float:
    """Density contrast at virialisation: Einstein-de Sitter, open, or flat (Bryan and Norman)."""
    e2 = omegam * (1 + z) ** 3 + (1 - omegam - omegal) * (1 + z) ** 2 + omegal
    x = omegam * (1 + z) ** 3 / e2 - 1
    if omegal == 0:
        return 18 * math.pi**2 + 60 * x - 32 * x * x
    return 18 * math.pi**2 + 82 * x - 39 * x * x
