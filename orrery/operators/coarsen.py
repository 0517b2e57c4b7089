"""Coarser levels: meta nodes per bin, per-object levels, links between levels, pyramids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.polylines import OBJECT

BIN = ["bi", "bj", "bk"]


def with_bins(points: DataFrame, root: DataFrame, factor: float) -> DataFrame:
    """Add bins of ``factor`` times the dataset's chunk_shape; ``bk`` is null where there are two axes."""
    size = root.select("dataset_id", F.col("chunk_shape").alias("_cs"))
    out = points.join(size, "dataset_id")
    b = lambda i, a: F.floor(F.col(a) / (F.get("_cs", F.lit(i)) * F.lit(float(factor)))).cast("bigint")
    return out.withColumns({n: b(i, a) for i, (n, a) in enumerate(zip(BIN, "xyz"))}).drop("_cs")


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which some may be null on both sides; the right keys drop out."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    return left.join(r, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], how).drop(*[f"_r_{k}" for k in keys])


def metanodes(binned: DataFrame, keys: Sequence[str] = ("dataset_id", "level"), value: str = "intensity") -> DataFrame:
    """One meta node per bin: mean position, count, members' least vid, and mean, sum, first, min, max of ``value``.

    NaN values of the attribute are left out; first is that of the least vid.
    """
    v = F.when(~F.isnan(value), F.col(value)).cast("double")
    return binned.groupBy(*keys, *BIN).agg(
        F.count("*").alias("n"), *[F.avg(a).alias(f"mean_{a}") for a in "xyz"], F.min("vid").alias("first_vid"),
        F.avg(v).alias("v_mean"), F.sum(v).alias("v_sum"), F.min_by(v, "vid").alias("v_first"), F.min(v).alias("v_min"), F.max(v).alias("v_max"),
    )


def majority(binned: DataFrame, value: str, keys: Sequence[str] = ("dataset_id", "level")) -> DataFrame:
    """The most frequent value of each bin, the least of equals; nulls do not vote."""
    n = binned.filter(F.col(value).isNotNull()).groupBy(*keys, *BIN, value).agg(F.count("*").alias("votes"))
    return n.groupBy(*keys, *BIN).agg(F.min_by(value, F.struct(-F.col("votes"), F.col(value))).alias(value), F.max("votes").alias("votes"))


def medoids(binned: DataFrame, keys: Sequence[str] = ("dataset_id", "level")) -> DataFrame:
    """The vertex of each bin nearest to the bin's mean, the least vid of equals (distances to 9 digits)."""
    mean = binned.groupBy(*keys, *BIN).agg(*[F.avg(a).alias(f"_m{a}") for a in "xyz"])
    d2 = F.lit(0.0)
    for a in "xyz":
        d2 = d2 + F.coalesce(F.pow(F.col(a) - F.col(f"_m{a}"), 2), F.lit(0.0))
    j = match(binned, mean, [*keys, *BIN]).select(*keys, *BIN, "vid", F.round(d2, 6).alias("d2"))
    return j.groupBy(*keys, *BIN).agg(F.min_by("vid", F.struct("d2", "vid")).alias("vid"))


def object_level(lines: DataFrame, bins: Sequence[str] = tuple(BIN)) -> DataFrame:
    """Manifest of a coarse level: per object the sequence of bins, consecutive repeats removed; a revisit counts again."""
    w = Window.partitionBy(*OBJECT).orderBy("ord")
    same = F.col("ord") > 0
    for b in bins:
        same = same & F.col(b).eqNullSafe(F.lag(b).over(w))
    kept = lines.withColumn("_same", same).filter("NOT _same")
    return kept.select(*OBJECT, (F.row_number().over(w) - 1).cast("bigint").alias("place"), *bins)


def implicit_level(points: DataFrame, bins: Sequence[str] = tuple(BIN)) -> DataFrame:
    """Manifest of a coarse level over one implicit object: its bins by chunk, each once; the window runs over bins."""
    w = Window.orderBy("_c", *bins)
    kept = points.groupBy(*bins).agg(F.min(F.struct("cx", "cy", "cz")).alias("_c"))
    return kept.select(F.lit(0).cast("bigint").alias("oid"), (F.row_number().over(w) - 1).cast("bigint").alias("place"), *bins)


def present_mask(objects: DataFrame, kept: DataFrame) -> DataFrame:
    """Every object of the level below with ``present``: whether it survives at the coarse level."""
    k = kept.select("dataset_id", "oid").distinct().withColumn("_k", F.lit(True))
    return objects.join(k, ["dataset_id", "oid"], "left").withColumn("present", F.coalesce("_k", F.lit(False))).drop("_k")


def cross_level(fine: DataFrame, survivors: DataFrame | None = None, implicit: bool = True) -> DataFrame:
    """Edges from every fine vertex to its bin's meta vertex (named by its least surviving vid), with ``aligned``.

    A bin without survivors has no meta vertex; vertices of dropped objects link where a survivor shares the bin.  The
    vertices of a dataset without any object are one implicit object, which survives (not if ``implicit`` is false).
    """
    keep = fine if survivors is None else fine.join(survivors, ["dataset_id", "oid"], "left_semi")
    if survivors is not None and implicit:
        own = fine.filter("oid IS NOT NULL").select("dataset_id").distinct()
        keep = keep.unionByName(fine.join(own, "dataset_id", "left_anti"))
    meta = keep.groupBy("dataset_id", *BIN).agg(F.min("vid").alias("dst_vid"), F.min_by("cell", "vid").alias("dst_cell"))
    e = match(fine, meta, ["dataset_id", *BIN])
    return e.select("dataset_id", F.col("vid").alias("src_vid"), "dst_vid", (F.col("cell") == F.col("dst_cell")).alias("aligned"))


def compose(up1: DataFrame, up2: DataFrame) -> DataFrame:
    """Edges over two levels from edges over one: the parent of the parent."""
    p = up2.select(F.col("src_vid").alias("dst_vid"), F.col("dst_vid").alias("top_vid"))
    return up1.select("dataset_id", "src_vid", "dst_vid").join(p, "dst_vid").select("dataset_id", "src_vid", F.col("top_vid").alias("dst_vid"))


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of cross-level edges, with their delta."""
    a = edges.select("dataset_id", "src_vid", "dst_vid", F.lit(1).alias("delta"))
    return a.unionByName(edges.select("dataset_id", F.col("dst_vid").alias("src_vid"), F.col("src_vid").alias("dst_vid"), F.lit(-1).alias("delta")))


def bin_estimate(n: Column, spans: Sequence[Column], target: Column) -> Column:
    """Edge of cubic bins so that about ``target`` of them hold points: (volume / target) ** (1/d)."""
    volume = F.lit(1.0)
    for s in spans:
        volume = volume * F.greatest(s, F.lit(1e-9))
    return F.pow(volume / F.greatest(F.least(target, n), F.lit(1)), F.lit(1.0 / len(spans)))
