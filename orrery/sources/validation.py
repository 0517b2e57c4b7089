"""Checks of a whole store, level by level: structure, metadata, consistency, conformance, resolutions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.grid import cell, finite
from orrery.schema import StoreError
from orrery.sources.store import TABLES, GeometryStore

FINDING = "stage int, check string, n bigint"


def structure(store: GeometryStore) -> list[tuple[int, str, int]]:
    """Folders that the metadata names and that are gone, and tables that no store has."""
    out = []
    for name, folders in store.versions.items():
        if name not in TABLES:
            out.append((1, f"unknown table {name}", 1))
        gone = [f for f in folders if not (lambda fs, where: fs.exists(where))(*store._fs(store.spark, f"{store.path}/{name}/{f}"))]
        if gone:
            out.append((1, f"missing folder of {name}", len(gone)))
    return out


def metadata(store: GeometryStore) -> list[tuple[int, str, int]]:
    try:
        store.meta.check()
    except StoreError as e:
        return [(2, str(e), 1)]
    return []


def _count(df: DataFrame, stage: int, check: str) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), F.lit(check).alias("check"), "n")


def _gone(refs: DataFrame, there: DataFrame, on: list[str], stage: int, check: str) -> DataFrame:
    return _count(refs.join(there, on, "left_anti"), stage, check)


def consistency(store: GeometryStore) -> list[DataFrame]:
    """Positions that are no numbers, cells that do not hold their vertices, and references that lead nowhere."""
    v, axes = store.table("vertices"), store.meta.axes
    at = v.select("level", "vid").distinct()
    out = [_count(v.filter(~reduce(lambda a, b: a & b, [finite(F.col(a)) for a in axes])), 3, "position")]
    wrong: Column = F.lit(False)
    for l in store.meta.levels:
        shape = l.chunk_shape or store.meta.chunk_shape
        same = reduce(lambda a, b: a & b, [F.col(f"c{a}").eqNullSafe(cell(F.col(a), s)) for a, s in zip(axes, shape)])
        wrong = wrong | ((F.col("level") == l.level) & ~same)
    out.append(_count(v.filter(wrong), 3, "cell"))
    out.append(_count(v.filter(~F.col("level").isin([l.level for l in store.meta.levels])), 3, "undeclared level"))
    links = store.table("links")
    out.append(_gone(links.select("level", F.col("src_vid").alias("vid")), at, ["level", "vid"], 3, "link source"))
    out.append(_gone(links.select((F.col("level") + F.col("delta")).alias("level"), F.col("dst_vid").alias("vid")), at, ["level", "vid"], 3, "link target"))
    out.append(_gone(store.table("faces").select("level", F.explode("vids").alias("vid")), at, ["level", "vid"], 3, "face corner"))
    objects = store.table("objects")
    held = v.filter("oid IS NOT NULL").select("level", "oid").distinct()
    out.append(_gone(objects.filter("present").select("level", "oid"), held, ["level", "oid"], 3, "present object without vertex"))
    out.append(_count(held.join(objects.filter("NOT present").select("level", "oid"), ["level", "oid"], "left_semi"), 3, "absent object with vertex"))
    out.append(_gone(store.table("groups").filter("oid IS NOT NULL").select("oid"), held.select("oid").distinct(), ["oid"], 3, "group member"))
    return out


def conformance(store: GeometryStore) -> list[DataFrame]:
    """Rules of the geometry types: corners of faces, parents of skeletons, places of polylines."""
    kinds, out = set(store.meta.geometry_types), [_count(store.table("faces").filter("size(vids) < 3 OR vids IS NULL"), 4, "face of fewer than three corners")]
    if kinds == {"skeleton"}:
        per = store.table("links").filter("delta = 0").groupBy("level", "src_vid").agg(F.count_distinct("dst_vid").alias("c"))
        out.append(_count(per.filter("c > 1"), 4, "two parents"))
    if kinds and kinds <= {"polyline", "streamline", "line"}:
        v = store.table("vertices").filter("oid IS NOT NULL")
        out.append(_count(v.filter("seq IS NULL"), 4, "vertex without place"))
        out.append(_count(v.filter("seq IS NOT NULL").groupBy("level", "oid", "seq").agg(F.count("*").alias("c")).filter("c > 1"), 4, "place used twice"))
    if "mesh" not in kinds and kinds:
        out.append(_count(store.table("faces"), 4, "faces without a mesh"))
    return out


def resolutions(store: GeometryStore) -> list[tuple[int, str, int]]:
    """Levels without gaps, with never more vertices and never finer bins than the level below."""
    levels, counts, ratios = store.levels(), store.info()["vertices"], store.ratios()
    size = lambda k: reduce(lambda a, b: a * b, ratios[k], 1)
    pairs = list(zip(levels, levels[1:]))
    found = [
        ("gap between levels", sum(b != a + 1 for a, b in pairs)), ("more vertices than below", sum(counts.get(b, 0) > counts.get(a, 0) for a, b in pairs)),
        ("finer bins than below", sum(size(b) < size(a) for a, b in pairs)),
    ]
    return [(5, c, n) for c, n in found if n]


def validate(store: GeometryStore, level: int = 3) -> DataFrame:
    """(stage, check, n) of all findings of stages 1 to ``level``; after a finding of stage 1 or 2 no more is checked."""
    spark = store.spark
    first = structure(store)
    if not first and level >= 2:
        first = metadata(store)
    if first or level < 3:
        return spark.createDataFrame(first, FINDING)
    parts = consistency(store) + (conformance(store) if level >= 4 else [])
    out = reduce(DataFrame.unionByName, parts).filter("n > 0")
    return out.unionByName(spark.createDataFrame(resolutions(store) if level >= 5 else [], FINDING))
