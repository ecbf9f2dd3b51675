"""Column expressions for points in a periodic box: minimum images, cells, bins, vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def minimum_image(d: Column, box: float) -> Column:
    """Difference in [-L/2, L/2)."""
    return d - F.when(d >= box / 2, box).when(d < -box / 2, -box).otherwise(0)


def wrap(x: Column, box: float) -> Column:
    """Position in [0, L), for positions at most one box away."""
    return F.when(x >= box, x - box).when(x < 0, x + box).otherwise(x)


def cell_of(x: Column, box: float, n: int, periodic: bool = True) -> Column:
    """Cell index along an axis; L belongs to cell 0 of a periodic box and is clamped otherwise."""
    i = F.floor(x * n / box).cast("bigint")
    return F.pmod(i, F.lit(n)) if periodic else F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))


def cell_key(n: int, *axes: Column) -> Column:
    key = axes[0]
    for a in axes[1:]:
        key = key * n + a
    return key


def decode_cell(key: Column, n: int) -> tuple[Column, Column, Column]:
    return F.floor(key / (n * n)).cast("bigint"), F.floor(key / n).cast("bigint") % n, key % n


def delta(a: str, b: str, box: float) -> list[Column]:
    """Minimum-image differences b - a of prefixed columns ax ... bz."""
    return [minimum_image(F.col(f"{b}{c}") - F.col(f"{a}{c}"), box) for c in AXES]


def dot(u: Sequence[Column], v: Sequence[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def cross(u: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def log_edges(r_max: float, r_min: float, bins: int) -> list[float]:
    """Squared ring edges, descending, equal in log10 r: bins + 1 of them."""
    lo, step = math.log10(r_min), (math.log10(r_max) - math.log10(r_min)) / bins
    return [r_max**2, *((10 ** (lo + step * (bins - 1 - i))) ** 2 for i in range(bins))]


def linear_edges(r_max: float, r_min: float, bins: int) -> list[float]:
    step = (r_max - r_min) / bins
    return [(r_max - step * i) ** 2 for i in range(bins + 1)]


def ring(d2: Column, edges: Sequence[float]) -> Column:
    """Index of the innermost of the descending squared edges that d2 is below; 0 is the outermost ring."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: d2 < e)) - 1


def even_ring(d: Column, low: float, high: float, bins: int, log: bool = False) -> Column:
    """floor((d - low) / (high - low) * bins), or that of the logarithms; open at both ends."""
    x, lo, hi = (F.log10(d), math.log10(low), math.log10(high)) if log else (d, low, high)
    return F.floor(F.round((x - lo) / (hi - lo) * bins, 9)).cast("int")


def linking_length(b: float, mpart: float, omegam: float, rho_crit: float = 277.50, softening: float = 0.0) -> float:
    """b times the mean particle separation in kpc/h, not below the softening."""
    return max(b * (mpart * 1e10 / omegam / (rho_crit * 1e9)) ** (1 / 3) * 1000, softening)


def fraction_of_overdensity(delta_: float) -> float:
    return (1 / (1 + delta_)) ** (1 / 3)


def virial_radius(m: Column, box: float, mpart: float, npart: int, b: float, factor: float = 1.0) -> Column:
    return factor * F.cbrt(m) * ((3 / (4 * math.pi * mpart * npart)) ** (1 / 3) * box * b)


def hashed_uniform(*keys: Column | int, prime: int = 1_000_003) -> Column:
    """Counter-based uniforms in [0, 1): an integer hash of the keys, the same in any engine. Each round
    squares, and two rounds follow the last key: draws that differ in one key (a seed) are neither
    shifts nor fixed differences of each other. Keys are taken
    modulo the prime before they are multiplied, so nothing overflows."""
    h = F.lit(12_345).cast("bigint")
    for k in (*keys, 0, 0):
        k = F.lit(k) if isinstance(k, int) else k
        h = (h * (h + 7_919) + F.pmod(k.cast("bigint"), F.lit(prime)) * 104_729 + 1) % prime
    return h / prime
