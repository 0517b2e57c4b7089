"""Checks of a store's tables as DataFrames of findings (check, dataset_id, n)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _finding(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("dataset_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "dataset_id", "n")


def at_least(version: Column, least: str) -> Column:
    """Dotted version compared part by part; null if the version is null."""
    want = [int(p) for p in least.split(".")]
    return F.transform(F.slice(F.split(version, r"\."), 1, len(want)), lambda p: p.cast("int")) >= F.array(*[F.lit(w) for w in want])


def metadata(root: DataFrame) -> DataFrame:
    """Root metadata: version, shape lengths, positive shapes, ordered bounds."""
    rules = {
        "version": ~F.coalesce(at_least(F.col("zv_version"), "0.7.0"), F.lit(False)),
        "shape_length": F.size("chunk_shape") != F.col("ndim"),
        "shape_positive": F.exists("chunk_shape", lambda s: s <= 0),
        "bounds_missing": F.col("bounds_min").isNull() | F.col("bounds_max").isNull(),
        "bounds_order": F.exists(F.arrays_zip("bounds_min", "bounds_max"), lambda b: b["bounds_min"] > b["bounds_max"]),
    }
    return reduce(DataFrame.unionByName, [_finding(root.filter(r), n) for n, r in rules.items()])


def positions(vertices: DataFrame, root: DataFrame) -> DataFrame:
    """Vertices: null or non-finite coordinates among the dataset's axes, and null objects or places."""
    d = lambda a: F.col(a).cast("double")
    bad = lambda a: F.col(a).isNull() | F.isnan(a) | (F.abs(d(a)) == F.lit(float("inf")))
    v = vertices.join(root.select("dataset_id", "ndim"), "dataset_id")
    return _finding(v.filter(bad("x") | bad("y") | ((F.col("ndim") > 2) & bad("z"))), "position").unionByName(
        _finding(v.filter("oid IS NOT NULL AND seq IS NULL"), "seq")
    )


def consistency(vertices: DataFrame, root: DataFrame, links: DataFrame, edges: DataFrame, groups: DataFrame, objects: DataFrame) -> DataFrame:
    """References of all tables that lead nowhere, objects without a vertex, and places used twice, by dataset.

    Targets are keys whether deleted or not; copies of a row count once.  A null or -1 parent is no reference.
    """
    v = vertices.filter("vid IS NOT NULL").select("dataset_id", "level", "vid").distinct()
    o = objects.filter("oid IS NOT NULL").select("dataset_id", "oid").distinct()

    def dangling(refs: DataFrame, key: str, name: str, there: DataFrame, on: Sequence[str]) -> DataFrame:
        r = refs.filter(F.col(key).isNotNull()).select("dataset_id", F.col(key).alias(there.columns[-1]), *[c for c in on if c not in ("dataset_id", there.columns[-1])], "_id")
        return _finding(r.distinct().join(there, list(on), "left_anti"), name)

    ends = edges.withColumn("_id", F.col("link_id"))
    up = ends.withColumn("level", F.col("level") + F.col("delta"))
    child = links.withColumn("_id", F.col("link_id")).withColumn("level", F.lit(0))
    at = ["dataset_id", "level", "vid"]
    used = vertices.filter("oid IS NOT NULL").select("dataset_id", "oid").distinct()
    twice = vertices.filter("deleted_at IS NULL AND oid IS NOT NULL AND seq IS NOT NULL").select("dataset_id", "level", "oid", "seq", "vid").distinct()
    return reduce(DataFrame.unionByName, [
        dangling(ends, "src_vid", "edge_source", v, at), dangling(up, "dst_vid", "edge_target", v, at), dangling(child, "child_vid", "link_child", v, at),
        dangling(child.filter("parent_vid <> -1"), "parent_vid", "link_parent", v, at),
        dangling(groups.withColumn("_id", F.col("member_id")), "oid", "group_member", o, ["dataset_id", "oid"]),
        _finding(o.join(used, ["dataset_id", "oid"], "left_anti"), "object_without_vertex"),
        _finding(twice.groupBy("dataset_id", "level", "oid", "seq").agg(F.count("*").alias("c")).filter("c > 1"), "place_used_twice"),
    ])


def levels(vertices: DataFrame) -> DataFrame:
    """Levels of each dataset with their vertex counts: contiguous from 0 and never more than the level below."""
    n = vertices.filter("deleted_at IS NULL").groupBy("dataset_id", "level").agg(F.count_distinct("vid").alias("n"))
    w = Window.partitionBy("dataset_id").orderBy("level")
    out = n.withColumn("below", F.lag("n").over(w)).withColumn("step", F.col("level") - F.lag("level", 1, -1).over(w))
    return out.select("dataset_id", "level", "n", (F.col("step") == 1).alias("contiguous"), F.coalesce(F.col("n") <= F.col("below"), F.lit(True)).alias("shrinks"))


def conformance(root: DataFrame, vertices: DataFrame, links: DataFrame) -> DataFrame:
    """Geometry against what is stored: which kinds of rows each dataset has."""
    v = vertices.groupBy("dataset_id").agg(F.count("*").alias("n_vertices"), F.count("oid").alias("n_with_object"))
    l = links.groupBy("dataset_id").agg(F.count("*").alias("n_parent_links"))
    out = root.select("dataset_id", "geometry_type").join(v, "dataset_id", "left").join(l, "dataset_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    wrong = (F.coalesce("n_parent_links", F.lit(0)) > 0) != (F.col("geometry_type") == "skeleton")
    return out.select("dataset_id", "geometry_type", zero("n_vertices"), zero("n_with_object"), zero("n_parent_links"), (~wrong).alias("conforms"))
