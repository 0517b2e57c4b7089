"""Re-chunking: a leading dimension from groups, object ids or attributes, and new bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.plans.sizing import tasks_for

SLICES = 4096  #: slices of a group's range in which values are counted


def by_edges(value: Column, edges: Sequence[float]) -> Column:
    """Explicit bins: clip(number of edges <= value - 1, 0, k - 1) with k = number of edges."""
    n = sum(((value >= F.lit(e)).cast("int") for e in edges), F.lit(0))
    return F.when(value.isNotNull(), F.least(F.greatest(n - 1, F.lit(0)), F.lit(len(edges) - 1)))


def by_group(objects: DataFrame, groups: DataFrame) -> DataFrame:
    """Add ``prefix``: the greatest gid that an object belongs to, -1 without a group."""
    g = groups.filter("oid IS NOT NULL").groupBy("dataset_id", "oid").agg(F.max("gid").alias("_g"))
    return objects.join(g, ["dataset_id", "oid"], "left").withColumn("prefix", F.coalesce("_g", F.lit(-1).cast("bigint"))).drop("_g")


def by_attribute(df: DataFrame, value: str, within: Sequence[str], few: int = 10) -> DataFrame:
    """Add ``prefix`` from a numeric attribute per ``within``.

    Up to ``few`` distinct values each get a bin in sorted order; otherwise exact quartiles cut the values: the number of
    inner and upper edges <= value, clipped to the last bin, over the distinct edges.  Nulls and NaN get -1.
    """
    d = df.withColumn("_v", F.when(~F.isnan(value), F.col(value).cast("double")))
    n = d.filter("_v IS NOT NULL").groupBy(*within, "_v").agg(F.count("*").alias("_n"))  # a value that many rows share is one row from here
    stats = _few_values(n, within, few).join(quantiles(n, within), list(within))
    rank = F.array_position("_all", F.col("_v")) - 1
    over = F.size(F.filter(F.slice("_e", F.lit(2), F.lit(8)), lambda e: e <= F.col("_v")))
    quart = F.least(F.greatest(over, F.lit(0)), F.greatest(F.size("_e") - 2, F.lit(0)))
    out = d.join(stats, list(within), "left").withColumn("prefix", F.when(F.col("_v").isNull(), -1).when(F.col("_d") <= few, rank).otherwise(quart).cast("bigint"))
    return out.drop("_v", "_d", "_e", "_all")


def _few_values(counts: DataFrame, within: Sequence[str], few: int) -> DataFrame:
    """Number of distinct values of each group, and the values themselves, sorted, where there are at most ``few``."""
    d = counts.groupBy(*within).agg(F.count("*").alias("_d"))
    small = counts.join(d.filter(F.col("_d") <= few), list(within), "left_semi").groupBy(*within).agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    return d.join(small, list(within), "left")


def quantiles(counts: DataFrame, within: Sequence[str], at: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """(within, _e): exact linear quantiles of counts(within, _v, _n) without repeats, ascending.

    Values are counted in SLICES slices of each group's range; only the slices that hold a wanted rank are ordered.
    """
    keys = list(within)
    ends = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_t"))
    part = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (SLICES - 1))).otherwise(0).cast("int")
    c = counts.join(ends, keys).withColumn("_s", part)
    per = c.groupBy(*keys, "_s", "_t").agg(F.sum("_n").alias("_m"))
    up = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_m").over(up), F.lit(0)))
    wanted = F.array(*[f(F.lit(q) * (F.col("_t") - 1)).cast("bigint") for q in at for f in (F.floor, F.ceil)])
    per = per.withColumn("_ranks", F.filter(F.array_distinct(wanted), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_m")))).filter("size(_ranks) > 0")
    inside = Window.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    v = c.join(per.select(*keys, "_s", "_before", "_ranks"), [*keys, "_s"]).withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    hit = v.withColumn("_r", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_n")))))
    found = hit.groupBy(*keys, "_t").agg(F.map_from_entries(F.collect_set(F.struct("_r", "_v"))).alias("_at"))  # at most two ranks a quantile
    edges = []
    for q in at:
        pos = F.lit(q) * (F.col("_t") - 1)
        lo, hi = F.floor(pos).cast("bigint"), F.ceil(pos).cast("bigint")
        a, b = F.element_at("_at", lo), F.element_at("_at", hi)
        edges.append(F.when(lo == hi, a).otherwise(a + (b - a) * (pos - lo)))
    return found.select(*keys, F.array_distinct(F.array(*edges)).alias("_e"))


def map_objects(
    objects: DataFrame, kind: str, groups: DataFrame | None = None, value: str | None = None, edges: Sequence[float] | None = None, within: Sequence[str] = ("dataset_id",)
) -> DataFrame:
    """Add ``prefix``, the leading index of the new grid, to objects(within, oid, ..).

    ``group``: the greatest group an object belongs to; ``object_id``: its own id or the bin of ``edges`` that holds it;
    ``attribute``: a bin by :func:`by_attribute`, or of ``edges``; ``spatial``: 0.
    """
    if kind == "group":
        return by_group(objects, groups) if groups is not None else objects.withColumn("prefix", F.lit(0).cast("bigint"))
    if kind == "object_id":
        return objects.withColumn("prefix", (by_edges(F.col("oid"), edges) if edges else F.col("oid")).cast("bigint"))
    if kind == "attribute":
        return objects.withColumn("prefix", by_edges(F.col(value), edges).cast("bigint")) if edges else by_attribute(objects, value, within)
    if kind == "spatial":
        return objects.withColumn("prefix", F.lit(0).cast("bigint"))
    raise ValueError(kind)


def rewrite(df: DataFrame, prefix: str, cells: Sequence[str], path: str) -> None:
    """Write rows clustered by the new leading dimension and cell; ids are kept, every row is kept, rows without a prefix too.

    Clusters are ranges of (prefix, cell, vid), so a prefix or cell that holds most rows is spread over several files.
    """
    order = [prefix, *cells, "vid"]
    df.repartitionByRange(tasks_for(df, 64 << 20), *order).sortWithinPartitions(*order).write.partitionBy(prefix).parquet(path)
