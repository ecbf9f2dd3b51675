"""Stacks of profiles, quantile splits, jackknife errors and histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stacked(cells: DataFrame, value: str, clip: tuple[float, float] | None = None) -> DataFrame:
    """(ix, iy, mean, n) over filaments; values clipped first if asked."""
    v = F.col(value) if clip is None else F.least(F.greatest(F.col(value), F.lit(clip[0])), F.lit(clip[1]))
    return cells.groupBy("ix", "iy").agg(F.avg(v).alias("mean"), F.count("*").alias("n"))


def quantile_split(df: DataFrame, value: str, parts: int, pad: float = 1e-6) -> DataFrame:
    """df with `q`: half-open bins (q_i, q_i+1] of linear quantiles, the ends padded. The edges are one row."""
    at = [i / parts for i in range(parts + 1)]
    edges = df.agg(F.percentile(value, F.array(*map(F.lit, at))).alias("edges"))
    both = df.crossJoin(F.broadcast(edges))
    low = F.transform("edges", lambda e, i: F.when(i == 0, e - pad).when(i == parts, e + pad).otherwise(e))
    return both.withColumn("q", F.size(F.filter(low, lambda e: e < F.col(value))) - 1).drop("edges")


def jackknife_mean(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """(keys, mean, error): leave-one-out in closed form, where the mean's jackknife error is s / sqrt(n)."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("error"), F.count("*").alias("n"))


def jackknife_median(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """(keys, estimate, error): leaving one out moves a median to one of three values only, so three
    order statistics and their multiplicities replace n resamples."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("r", F.row_number().over(w.orderBy(value))).withColumn("n", F.count("*").over(w))
    n, r, x = F.col("n"), F.col("r"), F.col(value)
    h = F.floor(n / 2)
    mid = [F.max(F.when(r == h + o, x)) for o in (0, 1, 2)]
    got = ranked.groupBy(*keys).agg(F.first("n").alias("n"), *(m.alias(f"m{i}") for i, m in enumerate(mid)), F.median(value).alias("median"))
    h = F.floor(F.col("n") / 2)
    odd = F.col("n") % 2 == 1
    # odd n = 2h+1: below the middle leaves (m1+m2)/2 (h times), above (m0+m1)/2 (h), the middle (m0+m2)/2
    # even n = 2h: a lower one leaves m1 (h times), an upper one m0 (h times)
    values = [F.when(odd, (F.col("m1") + F.col("m2")) / 2).otherwise(F.col("m1")), F.when(odd, (F.col("m0") + F.col("m1")) / 2).otherwise(F.col("m0")), F.when(odd, (F.col("m0") + F.col("m2")) / 2).otherwise(0.0)]
    times = [h, h, F.when(odd, 1).otherwise(0)]
    mean = sum((v * t for v, t in zip(values, times, strict=True)), F.lit(0.0)) / F.col("n")
    var = sum((t * (v - mean) * (v - mean) for v, t in zip(values, times, strict=True)), F.lit(0.0)) * (F.col("n") - 1) / F.col("n")
    estimate = F.col("n") * F.col("median") - (F.col("n") - 1) * mean
    return got.where("n > 2").select(*keys, estimate.alias("estimate"), F.sqrt(var).alias("error"), "n")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, log: bool = False) -> DataFrame:
    x = F.log10(value) if log else F.col(value)
    lo, hi = (math.log10(low), math.log10(high)) if log else (low, high)
    b = F.floor((x - lo) / (hi - lo) * bins).cast("int")
    return df.withColumn("bin", b).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.count("*").alias("n"))


def normalised(counts: DataFrame) -> DataFrame:
    """counts (bin, n) with `share` of all."""
    total = counts.agg(F.sum("n").alias("total"))  # one row: its size is proven
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total")


def histogram_2d(df: DataFrame, one: tuple[str, float, float, int], two: tuple[str, float, float, int]) -> DataFrame:
    """(i, j, n) of two columns, each (name, low, high, bins)."""
    cell = lambda c, low, high, bins: F.floor(F.round((F.col(c) - low) / (high - low) * bins, 9)).cast("int")
    rows = df.select(cell(*one).alias("i"), cell(*two).alias("j")).where((F.col("i") >= 0) & (F.col("i") < one[3]) & (F.col("j") >= 0) & (F.col("j") < two[3]))
    return rows.groupBy("i", "j").agg(F.count("*").alias("n"))


def ranked(df: DataFrame, value: str, tie: str) -> DataFrame:
    """df with `rank` from 1, by value descending, then `tie`: the counts above each distinct value (one
    narrow window over these) and a window in each value, so rows are never in one task."""
    counts = df.groupBy(value).agg(F.count("*").alias("many"))
    above = counts.withColumn("above", F.coalesce(F.sum("many").over(Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("many")
    inside = F.row_number().over(Window.partitionBy(value).orderBy(tie))
    return df.withColumn("inside", inside).join(above, value).withColumn("rank", F.col("above") + F.col("inside")).drop("inside", "above")


def describe(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"), F.median(value).alias("median"))
