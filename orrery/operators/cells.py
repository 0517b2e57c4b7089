"""Statistics per grid cell, evenly spread whatever the skew over cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.grid import chunk_key, finite, with_cells
from orrery.operators import skew
from orrery.plans.staging import stage

KEYS = ["dataset_id", "cx", "cy", "cz"]
BY = ["vid", "file_id", "written_at"]
FLAT = -(1 << 62)  #: stands for the third index of a cell of two axes


def level0_cells(vertices: DataFrame, root: DataFrame) -> DataFrame:
    """Rows of level 0 that have a cell."""
    return with_cells(vertices.filter("level = 0"), root)


def hot_cells(vertices: DataFrame, root: DataFrame, percent: int = 3) -> DataFrame:
    """Cells of level 0 that hold at least ``percent`` of all level-0 rows having a cell; copies count.

    An empty table gives no rows.
    """
    rows = level0_cells(vertices.select("dataset_id", "level", "x", "y", "z", *BY), root).select(*KEYS, *BY)
    plan = skew.estimate(rows, KEYS)
    n = skew.aggregate(rows, KEYS, {"n": F.count("*")}, {"n": F.sum("n")}, [F.col(c) for c in BY], plan)
    hot = n.filter(F.col("n") * 100 >= F.lit(plan.total * percent))
    return hot.select("dataset_id", chunk_key([F.col(c) for c in ("cx", "cy", "cz")]).alias("chunk_key"))


def cell_stats(vertices: DataFrame, root: DataFrame) -> DataFrame:
    """Count, bounds, centre and radius of the vertices of every level-0 cell.

    Rows count as they stand, copies too.  Sums are exact: coordinates are taken as whole 2**-20 steps in decimal.
    The radius (greatest distance of a vertex from its cell's centre) joins every vertex with its cell's row; that
    row is copied to the shards of a heavy cell only.  ``z`` columns are null where the dataset has two axes.
    """
    src = vertices.select("dataset_id", "level", "x", "y", "z", *BY)
    rows = level0_cells(src, root).withColumns({a: F.when(finite(F.col(a)) & F.col(f"c{a}").isNotNull(), F.col(a).cast("double") + F.lit(0.0)) for a in "xyz"})
    rows = rows.withColumn("cz", F.coalesce("cz", F.lit(FLAT))).select(*KEYS, "x", "y", "z", *BY)  # null keys do not join
    by = [F.col(c) for c in BY]
    plan = skew.estimate(rows, KEYS)
    step = lambda a: F.round(F.col(a) * F.lit(float(1 << 20))).cast("decimal(28,0)")
    partial, merge = {"n": F.count("*")}, {"n": F.sum("n")}
    for a in "xyz":
        partial |= {f"min_{a}": F.min(a), f"max_{a}": F.max(a), f"s_{a}": F.sum(step(a))}
        merge |= {f"min_{a}": F.min(f"min_{a}"), f"max_{a}": F.max(f"max_{a}"), f"s_{a}": F.sum(f"s_{a}")}
    per = skew.aggregate(rows, KEYS, partial, merge, by, plan)
    centre = {f"centre_{a}": F.col(f"s_{a}").cast("double") / (F.col("n") * F.lit(float(1 << 20))) for a in "xyz"}
    per = stage(per.withColumns(centre).drop("s_x", "s_y", "s_z"), "cells")
    matched = skew.join(rows, per.select(*KEYS, *centre), KEYS, plan, by)
    d2 = sum((F.coalesce(F.pow(F.col(a) - F.col(f"centre_{a}"), 2), F.lit(0.0)) for a in "xyz"), F.lit(0.0))
    far = matched.groupBy("_task", "_shard", *KEYS).agg(F.max(F.sqrt(d2)).alias("r")).groupBy(*KEYS).agg(F.max("r").alias("radius"))
    out = per.join(far, KEYS)
    key = F.when(F.col("cz") == FLAT, chunk_key([F.col("cx"), F.col("cy")])).otherwise(chunk_key([F.col(c) for c in ("cx", "cy", "cz")]))
    return out.select("dataset_id", key.alias("chunk_key"), "n", *[f"{p}_{a}" for a in "xyz" for p in ("min", "max", "centre")], "radius")
