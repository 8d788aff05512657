"""Column functions on vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vqspark.config import PQConfig


def quantize(vector: Column) -> Column:
    """Each number of about -1 to 1 as a whole number from 0 to 255."""
    return F.transform(vector, lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("long"))


def in_domain(vector: Column, config: PQConfig) -> Column:
    return quantize(vector) if config.domain == "int" else vector.cast("array<double>")


def pad(vector: Column, config: PQConfig) -> Column:
    """Zeros appended up to a multiple of the number of sub-spaces."""
    kind = "array<bigint>" if config.domain == "int" else "array<double>"
    return F.concat(vector, F.array_repeat(F.lit(0), config.padded - config.dim).cast(kind)) if config.padded > config.dim else vector


def split(vector: Column, config: PQConfig) -> Column:
    """Array of the M sub-vectors of a padded vector."""
    return F.transform(F.sequence(F.lit(0), F.lit(config.m - 1)), lambda m: F.slice(vector, m * config.sub + 1, config.sub))


def squared_l2(a: Column, b: Column, kind: str = "double") -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast(kind), lambda s, x: s + x)
