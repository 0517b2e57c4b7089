"""Algebraic objects: planes, lines and spheres with a type registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: type ids and coefficient counts of the format
TYPES = {0: ("plane", 4), 1: ("line", 6), 2: ("sphere", 4)}


def decode(objects: DataFrame) -> DataFrame:
    """Add ``type_name`` and cut the coefficients to the type's count; an unknown type is kept as unknown_<id>."""
    name, size = F.concat(F.lit("unknown_"), F.col("type_id").cast("string")), F.size("coefficients")
    for t, (n, k) in TYPES.items():
        name, size = F.when(F.col("type_id") == t, F.lit(n)).otherwise(name), F.when(F.col("type_id") == t, F.lit(k)).otherwise(size)
    return objects.withColumn("type_name", name).withColumn("coefficients", F.slice("coefficients", F.lit(1), size))


def check(objects: DataFrame) -> DataFrame:
    """Objects of a known type with the wrong number of coefficients."""
    want = F.lit(None)
    for t, (_, k) in TYPES.items():
        want = F.when(F.col("type_id") == t, F.lit(k)).otherwise(want)
    return objects.filter(want != F.size("coefficients"))


def distance(type_id: Column, c: Column, x: Column, y: Column, z: Column) -> Column:
    """Distance of a point to a plane (a, b, c, d), a line (point, direction) or a sphere (centre, radius)."""
    k = lambda i: F.get(c, F.lit(i))
    plane = F.abs(k(0) * x + k(1) * y + k(2) * z + k(3)) / F.sqrt(k(0) * k(0) + k(1) * k(1) + k(2) * k(2))
    dx, dy, dz = x - k(0), y - k(1), z - k(2)
    cx, cy, cz = dy * k(5) - dz * k(4), dz * k(3) - dx * k(5), dx * k(4) - dy * k(3)
    line = F.sqrt(cx * cx + cy * cy + cz * cz) / F.sqrt(k(3) * k(3) + k(4) * k(4) + k(5) * k(5))
    sphere = F.abs(F.sqrt(dx * dx + dy * dy + dz * dz) - k(3))
    return F.when(type_id == 0, plane).when(type_id == 1, line).when(type_id == 2, sphere)
