"""Selection of objects: top-k, thinning, spatial coverage, sparsity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.coarsen import match

SLICE_BITS = 12  #: a random order is ranked inside one of so many (as a power of two) slices of hashes


def target(n: Column, sparsity: float) -> Column:
    """Objects to keep: max(1, n * sparsity rounded half to even); everything from a sparsity of 1 on."""
    if sparsity >= 1:
        return n.cast("bigint")
    return F.greatest(F.lit(1), F.bround(n * F.lit(float(sparsity)), 0)).cast("bigint")


def top(df: DataFrame, value: str, k: int, within: list[str], id_: str = "oid", mode: str = "max") -> DataFrame:
    """The k objects of greatest (or least) value per ``within``, equals by least id; nulls come last."""
    if mode not in ("max", "min"):
        raise ValueError(mode)
    by = F.desc_nulls_last(value) if mode == "max" else F.asc_nulls_last(value)
    w = Window.partitionBy(*within).orderBy(by, id_)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def random(df: DataFrame, sparsity: float, within: list[str], id_: str = "oid", seed: int = 0) -> DataFrame:
    """A seeded sample without replacement, the same for any partitioning: least hashes of (id, seed).

    Only the slice of hashes in which a group's last object falls is ranked; all objects of the slices before are taken.
    """
    d = df.withColumn("_h", F.xxhash64(id_, F.lit(seed))).withColumn("_b", F.shiftright("_h", 64 - SLICE_BITS))
    per = d.groupBy(*within, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*within)
    up = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"_k": target(F.sum("_n").over(w), sparsity), "_before": F.coalesce(F.sum("_n").over(up), F.lit(0))}).filter("_before < _k")
    inside = Window.partitionBy(*within, "_b").orderBy("_h", id_)
    out = match(d, per, [*within, "_b"]).withColumn("_r", F.when(F.col("_before") + F.col("_n") > F.col("_k"), F.row_number().over(inside)).otherwise(0))
    return out.filter("_before + _r <= _k").drop("_h", "_b", "_n", "_k", "_before", "_r")


def thin(points: DataFrame, keys: list[str], seed: int | None = None) -> DataFrame:
    """One survivor per bin: the least vid, or with ``seed`` that of least hash (a combined aggregate, no window)."""
    vid = F.min("vid") if seed is None else F.min_by("vid", F.struct(F.xxhash64("vid", F.lit(seed)), F.col("vid")))
    return points.groupBy(*keys).agg(vid.alias("vid"), F.count("*").alias("n_in_bin"))


def subsample(lines: DataFrame, bins: list[str], per_bin: int = 1, selection: str = "longest", seed: int = 0) -> DataFrame:
    """Polylines of each bin of their midpoint: ``longest`` (most vertices, then greatest oid), ``first`` (least oid) or
    ``random`` (least hash of oid and seed).
    """
    order = {"longest": [F.desc("n"), F.desc("oid")], "first": [F.asc("oid")], "random": [F.xxhash64("oid", F.lit(seed)), F.asc("oid")]}
    if selection not in order:
        raise ValueError(selection)
    w = Window.partitionBy(*bins).orderBy(*order[selection])
    return lines.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_bin)


def apply_sparsity(
    objects: DataFrame, sparsity: float, strategy: str = "random", within: Sequence[str] = ("dataset_id",), value: str = "length", mode: str = "max",
    bins: Sequence[str] = (), seed: int = 0,
) -> DataFrame:
    """Objects (within, oid, ..) that survive: about ``sparsity`` of each group, at least one; all from a sparsity of 1 on.

    ``random`` needs ids only, ``length`` and ``attribute`` the column ``value``, ``spatial_coverage`` the columns ``bins``
    of the objects' places; ``point_thinning`` keeps one object a bin whatever the sparsity.  Nulls of ``value`` come last.
    """
    if not 0 < sparsity:
        raise ValueError("sparsity must be positive")
    keys = list(within)
    if strategy == "point_thinning":
        kept = objects.groupBy(*keys, *bins).agg(F.min("oid").alias("oid")).select(*keys, "oid")
    elif sparsity >= 1:
        return objects
    elif strategy == "random":
        return random(objects, sparsity, keys, seed=seed)
    elif strategy in ("length", "attribute"):
        n = objects.groupBy(*keys).agg(target(F.count("*"), sparsity).alias("_k"))
        by = F.desc_nulls_last(value) if strategy == "length" or mode == "max" else F.asc_nulls_last(value)
        w = Window.partitionBy(*keys).orderBy(by, "oid")
        return objects.join(n, keys).withColumn("_r", F.row_number().over(w)).filter("_r <= _k").drop("_r", "_k")
    elif strategy == "spatial_coverage":
        kept = coverage(objects.select(*keys, "oid", *bins), list(bins), keys, sparsity)
    else:
        raise ValueError(strategy)
    return objects.join(kept, [*keys, "oid"], "left_semi")


def coverage(reps: DataFrame, bins: list[str], within: list[str], sparsity: float) -> DataFrame:
    """Spatial coverage: a budget of objects spread over the occupied bins of ``within``.

    With a budget of at most the number of bins, the first object of each first-seen bin is taken; else every bin gets
    one, and the rest goes to bins in proportion to size - 1, floored, leftovers to the largest (first seen of equals).
    Bins are ordered by their least oid; windows run over bins, never over all objects of a hot bin at once.
    """
    per = reps.groupBy(*within, *bins).agg(F.count("*").alias("size"), F.min("oid").alias("first_oid"))
    tot = per.groupBy(*within).agg(F.count("*").alias("nb"), F.sum("size").alias("n"), F.sum(F.col("size") - 1).alias("w_all"))
    tot = tot.withColumn("k", target(F.col("n"), sparsity))
    seen = Window.partitionBy(*within).orderBy("first_oid")
    b = per.join(tot, within).withColumn("seen", F.row_number().over(seen))
    rest = F.greatest(F.col("k") - F.col("nb"), F.lit(0))
    share = F.when(F.col("w_all") > 0, F.floor((F.col("size") - 1) * rest / F.col("w_all"))).otherwise(0).cast("bigint")
    b = b.withColumn("share", share).withColumn("left", rest - F.sum("share").over(Window.partitionBy(*within)))
    big = Window.partitionBy(*within).orderBy(F.desc("size"), "seen")
    b = b.withColumn("big", F.row_number().over(big))
    take = F.when(F.col("k") <= F.col("nb"), (F.col("seen") <= F.col("k")).cast("bigint")).otherwise(
        F.least(F.lit(1) + F.col("share") + (F.col("big") <= F.col("left")).cast("bigint"), F.col("size"))
    )
    b = b.withColumn("take", take)
    w = Window.partitionBy(*within, *bins).orderBy("oid")
    chosen = match(reps, b.select(*within, *bins, "take"), [*within, *bins])
    return chosen.withColumn("_r", F.row_number().over(w)).filter("_r <= take").select(*within, "oid")
