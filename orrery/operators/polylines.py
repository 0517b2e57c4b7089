"""Polylines and line segments: runs, links between cells, lengths, crops and box tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBJECT = ["dataset_id", "level", "oid"]


def _order() -> Window:
    return Window.partitionBy(*OBJECT).orderBy(F.asc_nulls_last("seq"), "vid")


def ordered(points: DataFrame) -> DataFrame:
    """Vertices of objects with ``ord``, their place from 0 by (seq, vid); vertices without an object drop out."""
    return points.filter("oid IS NOT NULL").withColumn("ord", (F.row_number().over(_order()) - 1).cast("bigint"))


def split_runs(lines: DataFrame) -> DataFrame:
    """Maximal runs of consecutive vertices in one cell: (object, run, first_ord, last_ord, first_vid, last_vid, cell)."""
    w = Window.partitionBy(*OBJECT).orderBy("ord")
    same = F.lit(True)
    for c in ("cx", "cy", "cz"):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    r = lines.withColumn("run", F.sum(F.when(same & (F.col("ord") > 0), 0).otherwise(1)).over(w) - 1)
    return r.groupBy(*OBJECT, "run", "cx", "cy", "cz").agg(
        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.min_by("vid", "ord").alias("first_vid"), F.max_by("vid", "ord").alias("last_vid")
    )


def cross_links(runs: DataFrame) -> DataFrame:
    """Links from the last vertex of a run to the first of the next."""
    w = Window.partitionBy(*OBJECT).orderBy("run")
    out = runs.select(*OBJECT, "run", F.col("last_vid").alias("src_vid"), F.lead("first_vid").over(w).alias("dst_vid"))
    return out.filter("dst_vid IS NOT NULL")


def lengths(lines: DataFrame) -> DataFrame:
    """Vertices and arc length of every polyline; fewer than two vertices give 0."""
    w = Window.partitionBy(*OBJECT).orderBy("ord")
    d2 = F.lit(0.0)
    for a in "xyz":
        d2 = d2 + F.coalesce(F.pow(F.col(a) - F.lag(a).over(w), 2), F.lit(0.0))
    return lines.withColumn("step", F.sqrt(d2)).groupBy(*OBJECT).agg(F.count("*").alias("n"), F.sum("step").alias("length"))


def midpoints(lines: DataFrame) -> DataFrame:
    """The vertex n // 2 of every polyline."""
    w = Window.partitionBy(*OBJECT)
    out = lines.withColumn("n", F.count("*").over(w)).filter(F.col("ord") == F.floor(F.col("n") / 2))
    return out.select(*OBJECT, "n", "vid", "x", "y", "z", "cx", "cy", "cz")


def crop(lines: DataFrame, keep: Column) -> DataFrame:
    """Each maximal run of vertices that ``keep`` selects is a polyline of its own: (object, part, n, first_vid)."""
    w = Window.partitionBy(*OBJECT).orderBy("ord")
    k = lines.withColumn("_in", F.coalesce(keep, F.lit(False)))
    k = k.withColumn("part", F.sum(F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)), 1).otherwise(0)).over(w) - 1)
    return k.filter("_in").groupBy(*OBJECT, "part").agg(F.count("*").alias("n"), F.min_by("vid", "ord").alias("first_vid"))


def touching(lines: DataFrame, inside: Column) -> DataFrame:
    """Whole polylines of which any vertex (or any vertex's cell, by the test given) is inside."""
    hit = lines.filter(inside).select(*OBJECT).distinct()
    return lines.join(hit, OBJECT, "left_semi")


def _keep_points(p: np.ndarray, epsilon: float) -> np.ndarray:
    """Douglas-Peucker with distances to segments: keeps what lies farther than epsilon from its chord."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    todo = [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, rel = p[b] - p[a], p[a + 1 : b] - p[a]
        size = chord @ chord
        t = np.clip(rel @ chord / size, 0, 1) if size > 0 else np.zeros(len(rel))
        d = np.sqrt(((rel - t[:, None] * chord) ** 2).sum(1))
        k = int(d.argmax())
        if d[k] > epsilon:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplify(lines: DataFrame, epsilon: float, min_vertices: int = 2) -> DataFrame:
    """Vertices that Douglas-Peucker keeps, per object; a grouped map, so one object must fit a task.

    Where fewer than ``min_vertices`` are left, that many evenly spaced ones are kept instead (all, if there are fewer).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", ignore_index=True)
        p = pdf[["x", "y", "z"]].fillna(0.0).to_numpy(float)
        keep = _keep_points(p, epsilon)
        if keep.sum() < min_vertices:
            keep[:] = False
            keep[np.unique(np.linspace(0, len(p) - 1, min(min_vertices, len(p))).astype(int))] = True
        return pdf.loc[keep, [*OBJECT, "vid", "ord"]]

    schema = "dataset_id int, level int, oid bigint, vid bigint, ord bigint"
    return lines.select(*OBJECT, "vid", "ord", "x", "y", "z").groupBy(*OBJECT).applyInPandas(run, schema)


def coarsen(lines: DataFrame, epsilon: float | None, bins: Sequence[str] | None, per_bin: int = 1, min_vertices: int = 2, selection: str = "longest") -> DataFrame:
    """Simplify, then keep ``per_bin`` polylines of each bin of their midpoints; either step may be left out.

    ``bins`` are columns of ``lines``.  Returns the vertices kept, with their new places.
    """
    from orrery.operators import select

    kept = lines
    if epsilon is not None:
        kept = lines.join(simplify(lines, epsilon, min_vertices).select(*OBJECT, "vid"), [*OBJECT, "vid"], "left_semi")
        kept = kept.withColumn("ord", (F.row_number().over(Window.partitionBy(*OBJECT).orderBy("ord")) - 1).cast("bigint"))
    if bins is None:
        return kept
    mid = kept.withColumn("n", F.count("*").over(Window.partitionBy(*OBJECT))).filter(F.col("ord") == F.floor(F.col("n") / 2)).select(*OBJECT, "n", *bins)
    chosen = select.subsample(mid, ["dataset_id", "level", *bins], per_bin, selection).select(*OBJECT)
    return kept.join(chosen, OBJECT, "left_semi")


def segments_touching(segments: DataFrame, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
    """Line segments of which either endpoint (x0, y0) or (x1, y1) is in the closed box."""
    end = lambda i: F.col(f"x{i}").between(lo[0], hi[0]) & F.col(f"y{i}").between(lo[1], hi[1])
    return segments.filter(end(0) | end(1))
