"""Run parameters and the flags that output names carry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks in a name and the flags they set.
MARKS = ("fixed", "extend", "smooth", "vcm", "LIN", "rperp")


@dataclass
class RunParameters:
    """A run's parameter text: one value a line, levels after their number, then optional profile values."""

    files: int
    root: str
    name: str
    softening: float
    levels: list[float] = field(default_factory=list)
    bins: int | None = None
    rings: int | None = None
    radius: float | None = None
    least_mass: float | None = None

    @classmethod
    def parse(cls, text: str) -> RunParameters:
        lines = [x for x in (line.strip() for line in text.splitlines()) if x]
        many = int(lines[4])
        rest = lines[5 + many :]
        out = cls(int(lines[0]), lines[1], lines[2], float(lines[3]), [float(x) for x in lines[5 : 5 + many]])
        for (key, kind), value in zip((("bins", int), ("rings", int), ("radius", float), ("least_mass", float)), rest, strict=False):
            setattr(out, key, kind(value))
        return out

    def paths(self) -> list[str]:
        return [f"{self.root}{self.name}"] if self.files == 1 else [f"{self.root}{self.name}.{i}" for i in range(self.files)]


def name_flags(name: Column) -> list[Column]:
    """A Boolean for each mark, and the two linking fractions at the end of a name, as columns."""
    level = F.regexp_extract(name, r"_(\d+\.\d+)_(\d+\.\d+)\.bin$", 1), F.regexp_extract(name, r"_(\d+\.\d+)_(\d+\.\d+)\.bin$", 2)
    return [*(F.contains(name, F.lit(m)).alias(m.lower()) for m in MARKS), level[0].alias("outer_b"), level[1].alias("inner_b")]


def unfinished(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of work whose key has no output yet: a run goes on where it stopped."""
    return work.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def write_groups(members: DataFrame, path: str, text: bool = False) -> None:
    """Members as Parquet (or CSV), a folder a level."""
    out = members.write.mode("overwrite").partitionBy("level")
    out.option("header", "true").csv(path) if text else out.parquet(path)
