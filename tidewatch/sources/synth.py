"""Made-up tables with given distributions and keys, the same under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(seed: int, name: str) -> Column:
    """A number in [0, 1) from the row's id alone."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(name)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def synth(spark: SparkSession, spec: dict[str, tuple], n: int, seed: int = 1) -> DataFrame:
    """``spec``: column -> ("int", low, high), ("double", low, high), ("choice", values), ("foreign", n_parents), ("null", share, inner spec)."""

    def column(name: str, kind: tuple) -> Column:
        u = _unit(seed, name)
        match kind:
            case ("int", low, high):
                return (F.floor(u * (high - low + 1)) + low).cast("long")
            case ("double", low, high):
                return u * (high - low) + low
            case ("choice", values):
                return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))
            case ("foreign", parents):
                return F.floor(u * parents).cast("long")
            case ("null", share, inner):
                return F.when(_unit(seed, f"{name}?") >= share, column(name, inner))
        raise ValueError(f"unknown kind {kind}")

    return spark.range(n).select("id", *[column(c, k).alias(c) for c, k in spec.items()])
