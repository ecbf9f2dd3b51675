"""Polylines: rows (fil, k, x, y, z) in order of k; window operators partitioned by filament."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geometry import AXES, minimum_image


def order() -> WindowSpec:
    return Window.partitionBy("fil").orderBy("k")


def unwrapped(nodes: DataFrame, box: float) -> DataFrame:
    """nodes with ux, uy, uz: positions that run on across the box's faces from the first node."""
    for c in AXES:
        step = minimum_image(F.col(c) - F.lag(c).over(order()), box)
        nodes = nodes.withColumn(f"d{c}", F.coalesce(step, F.lit(0)))
    first = {c: F.first(c).over(order()) for c in AXES}
    return nodes.withColumns({f"u{c}": first[c] + F.sum(f"d{c}").over(order()) for c in AXES})


def arc_length(nodes: DataFrame, box: float) -> DataFrame:
    """nodes with d (length of the piece that ends here), s (running length), and unwrapped positions."""
    out = unwrapped(nodes, box).withColumn("d", F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).cast("double")))
    return out.withColumn("s", F.sum("d").over(order()))


def fractional(nodes: DataFrame, box: float) -> DataFrame:
    """nodes of filaments with a length, with t, their share of it."""
    u = arc_length(nodes, box).withColumn("len", F.max("s").over(Window.partitionBy("fil")))
    return u.where("len > 0").select("fil", "k", *AXES, (F.col("s") / F.col("len")).alias("t"))


def properties(nodes: DataFrame, box: float) -> DataFrame:
    """(fil, size, len, elong, rms): rms is the transverse deviation of inner nodes from the chord over
    all nodes; filaments of one node have no length and are left out."""
    u = arc_length(nodes, box)
    ends = u.groupBy("fil").agg(F.count("*").alias("size"), F.sum("d").alias("len"), F.max("k").alias("last"), *(f(F.col(f"u{c}"), F.col("k")).alias(f"{n}{c}") for c in AXES for n, f in (("a", F.min_by), ("b", F.max_by))))
    ends = ends.where("size > 1")
    for c in AXES:
        ends = ends.withColumn(f"e{c}", (F.col(f"b{c}") - F.col(f"a{c}")).cast("double"))
    ends = ends.withColumn("chord", F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey") + F.col("ez") * F.col("ez")))
    both = u.select("fil", "k", *(f"u{c}" for c in AXES)).join(ends, "fil")
    off = {c: F.col(f"u{c}") - F.col(f"a{c}") for c in AXES}
    along = F.try_divide(sum((off[c] * F.col(f"e{c}") for c in AXES), F.lit(0.0)), F.col("chord"))
    away = sum((off[c] * off[c] for c in AXES), F.lit(0)) - F.coalesce(along * along, F.lit(0.0))
    inner = F.when((F.col("k") > 0) & (F.col("k") < F.col("last")), F.greatest(away, F.lit(0.0))).otherwise(0.0)
    return both.groupBy("fil").agg(F.first("size").alias("size"), F.first("len").alias("len"), (F.first("chord") / F.first("len")).alias("elong"), F.sqrt(F.sum(inner) / F.first("size")).alias("rms"))


def smoothed(nodes: DataFrame, box: float, times: int = 1) -> DataFrame:
    """Kernel 1/4, 1/2, 1/4 applied `times` times on unwrapped positions; the ends stay."""
    out = unwrapped(nodes, box).select("fil", "k", *(F.col(f"u{c}").cast("double").alias(c) for c in AXES))
    for _ in range(times):
        out = out.select("fil", "k", *(F.coalesce(F.lag(c).over(order()) / 4 + F.col(c) / 2 + F.lead(c).over(order()) / 4, F.col(c)).alias(c) for c in AXES))
    return out


def reversed_(nodes: DataFrame) -> DataFrame:
    last = F.max("k").over(Window.partitionBy("fil"))
    return nodes.withColumn("k", last - F.col("k"))


def resampled(nodes: DataFrame, box: float, bins: int) -> DataFrame:
    """bins points at equal arc lengths, the first and last node kept: (fil, i, s, x, y, z)."""
    u = arc_length(nodes, box)
    piece = u.select("fil", "k", "s", "d", *(f"u{c}" for c in AXES), *(F.lag(f"u{c}").over(order()).alias(f"p{c}") for c in AXES), F.max("s").over(Window.partitionBy("fil")).alias("len"), F.max("k").over(Window.partitionBy("fil")).alias("last"))
    step = F.col("len") / (bins - 1)
    # a piece holds the points i with s - d <= i * step < s, the last piece also the end
    lo = F.when(F.col("k") == 1, F.lit(0)).otherwise(F.ceil((F.col("s") - F.col("d")) / step).cast("int"))
    hi = F.when(F.col("k") == F.col("last"), F.lit(bins - 1)).otherwise(F.ceil(F.col("s") / step).cast("int") - 1)
    rows = piece.where("k > 0 and len > 0").withColumn("lo", lo).withColumn("hi", F.least(hi, F.lit(bins - 1))).where("lo <= hi")
    rows = rows.withColumn("i", F.explode(F.sequence("lo", "hi")))
    t = F.coalesce(F.try_divide(F.col("i") * step - (F.col("s") - F.col("d")), F.col("d")), F.lit(0.0))
    t = F.when(F.col("i") == bins - 1, 1.0).otherwise(t)
    return rows.select("fil", "i", (F.col("i") * step).alias("at"), *((F.col(f"p{c}") + t * (F.col(f"u{c}") - F.col(f"p{c}"))).alias(c) for c in AXES))


def prolonged(nodes: DataFrame, box: float, step: float) -> DataFrame:
    """Both ends prolonged along their end pieces by half the length, a point every `step`:
    (fil, k, x, y, z) with k from -n to size - 1 + n."""
    u = arc_length(nodes, box)
    seq = Window.partitionBy("fil")
    ends = u.withColumn("last", F.max("k").over(seq)).withColumn("len", F.max("s").over(seq))
    near = {c: F.lead(f"u{c}").over(order()) for c in AXES}
    ends = ends.withColumns({f"n{c}": near[c] for c in AXES}).withColumn("nd", F.lead("d").over(order())).where("last > 0 and (k = 0 or k = last)")
    n = F.floor(F.col("len") / 2 / step).cast("int")
    more = ends.withColumn("n", n).where("n > 0").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n"))))
    head = F.col("k") == 0
    grow = {c: F.when(head, F.col(f"u{c}") - F.col(f"n{c}")).otherwise(F.col(f"d{c}")) for c in AXES}
    length = F.when(head, F.col("nd")).otherwise(F.col("d"))
    new = more.where(length > 0).select("fil", F.when(head, -F.col("j")).otherwise(F.col("k") + F.col("j")).cast("bigint").alias("k"), *((F.col(f"u{c}") + grow[c] / length * F.col("j") * step).alias(c) for c in AXES))
    return nodes.select("fil", "k", *(F.col(c).cast("double").alias(c) for c in AXES)).unionByName(new.select("fil", "k", *(F.pmod(F.col(c), F.lit(float(box))).alias(c) for c in AXES)))

