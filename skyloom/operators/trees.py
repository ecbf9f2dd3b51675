"""Rooted trees (id, parent, mass): path weights and the cut into filaments, in logarithmic rounds.

Every iteration doubles the reach of a pointer to an ancestor, so a chain of n nodes takes about
log2(n) rounds; each round is a table in the shared folder. Roots have a null parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import forget, written


def path_sums(tree: DataFrame, weight: str) -> DataFrame:
    """(id, total, depth): the sum of `weight` (of a node's edge to its parent) and the number of edges from
    the root to every node."""
    start = F.when(F.col("parent").isNull(), F.lit(0.0)).otherwise(F.col(weight).cast("double"))
    now = written(tree.select("id", F.col("parent").alias("up"), start.alias("total"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth")), "paths")
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("deeper"))
        new = written(now.join(above, "up", "left").select("id", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("depth") + F.coalesce("deeper", F.lit(0))).alias("depth")), "paths")
        forget(now)
        now = new
    return now.select("id", "total", "depth")


def heaviest_below(tree: DataFrame) -> DataFrame:
    """(id, owner): the heaviest node of every node's subtree, itself included; ties to the larger id."""
    now = written(tree.select("id", F.col("parent").alias("up"), F.struct("mass", "id").alias("best")), "owners")
    while not now.where("up is not null").isEmpty():
        # what stands 2**k below a node holds the best of the next 2**k levels
        come = now.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.max("best").alias("come"))
        next_up = now.select(F.col("id").alias("up"), F.col("up").alias("next"))
        new = written(now.join(come, "id", "left").join(next_up, "up", "left").select("id", F.col("next").alias("up"), F.greatest("best", F.coalesce("come", "best")).alias("best")), "owners")
        forget(now)
        now = new
    return now.select("id", F.col("best.id").alias("owner"))


def segments(tree: DataFrame, cut: float) -> DataFrame:
    """(start, seg, k, id): the tree as filaments. From the heaviest node to the lightest, each that no path
    has met climbs to the first node that one has, or to the root; nodes of more than `cut` on the way
    end a filament and begin the next one of the climb. The path of a start is thus the nodes whose
    subtree it is the heaviest of, and the parent of the last of them."""
    deep = path_sums(tree.withColumn("one", F.lit(1)), "one").select("id", "depth")
    own = written(tree.join(heaviest_below(tree), "id").join(deep, "id"), "climbs")
    first = own.where("id = owner").select("owner", F.col("depth").alias("from"))
    own = own.join(first, "owner").withColumn("i", F.col("from") - F.col("depth"))
    top = own.groupBy("owner").agg(F.max_by("parent", "i").alias("id"), (F.max("i") + 1).alias("i")).where("id is not null")
    path = own.select("owner", "id", "i", (F.col("mass") > cut).alias("heavy")).unionByName(top.select("owner", "id", "i", F.lit(False).alias("heavy")))
    w = Window.partitionBy("owner").orderBy("i")
    inner = F.col("heavy") & (F.col("i") > 0)
    path = path.withColumn("seg", F.coalesce(F.sum(inner.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("more", F.lead("id").over(w).isNotNull())
    # a heavy node ends its filament and, unless the climb ends there, begins the next
    both = path.withColumn("seg", F.explode(F.when(inner & F.col("more"), F.array(F.col("seg"), F.col("seg") + 1)).otherwise(F.array("seg"))))
    in_seg = Window.partitionBy("owner", "seg")
    both = both.withColumn("k", F.row_number().over(in_seg.orderBy("i")) - 1).withColumn("size", F.count("*").over(in_seg))
    return both.where("size > 1").select(F.col("owner").alias("start"), F.col("seg").cast("bigint").alias("seg"), F.col("k").cast("bigint").alias("k"), "id")
