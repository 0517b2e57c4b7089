"""Graphs, meshes and trees: endpoint joins, sub-graphs, contraction, clustering, traversal order and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.grid import cell
from orrery.operators import blocks, hierarchy
from orrery.plans.staging import stage


def edge_cells(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Join both endpoints of edges(src, dst, ...) to nodes(id, cell): adds src_cell, dst_cell, same_cell.

    Edges with an endpoint that is no node drop out.
    """
    a = nodes.select(F.col("id").alias("src"), F.col("cell").alias("src_cell"))
    b = nodes.select(F.col("id").alias("dst"), F.col("cell").alias("dst_cell"))
    return edges.join(a, "src").join(b, "dst").withColumn("same_cell", F.col("src_cell") == F.col("dst_cell"))


def subgraph(nodes: DataFrame, edges: DataFrame, keep: Column, within: list[str]) -> DataFrame:
    """Edges with both ends among the kept nodes, with ends renumbered from 0 by id inside ``within``."""
    kept = blocks.number(nodes.filter(keep).select(*within, "id"), within, "id", "i")
    a = kept.select(*within, F.col("id").alias("src"), F.col("i").alias("src_idx"))
    b = kept.select(*within, F.col("id").alias("dst"), F.col("i").alias("dst_idx"))
    return edges.join(a, [*within, "src"]).join(b, [*within, "dst"])


def face_cells(faces: DataFrame, nodes: DataFrame) -> DataFrame:
    """Faces(face_id, vids) of any width: corners, distinct cells, and whether all corners share one cell."""
    corner = faces.select("face_id", F.explode("vids").alias("id")).join(nodes.select("id", "cell"), "id")
    return corner.groupBy("face_id").agg(F.count("*").alias("corners"), F.count_distinct("cell").alias("cells")).withColumn("same_cell", F.col("cells") == 1)


def faces_within(faces: DataFrame, nodes: DataFrame, keep: Column) -> DataFrame:
    """Faces all of whose corners are kept nodes."""
    kept = nodes.filter(keep).select("id")
    corner = faces.select("face_id", F.size("vids").alias("width"), F.explode("vids").alias("id")).join(kept, "id", "left_semi")
    return corner.groupBy("face_id", "width").agg(F.count("*").alias("n")).filter("n = width").select("face_id", "width")


def contract(edges: DataFrame, meta: DataFrame) -> DataFrame:
    """Contract nodes to meta nodes meta(id, meta): undirected edges between different meta nodes, weights summed.

    A null weight counts as 1; loops drop out.
    """
    a = meta.select(F.col("id").alias("src"), F.col("meta").alias("a"))
    b = meta.select(F.col("id").alias("dst"), F.col("meta").alias("b"))
    e = edges.join(a, "src").join(b, "dst").filter("a <> b")
    return e.groupBy(F.least("a", "b").alias("meta_a"), F.greatest("a", "b").alias("meta_b")).agg(
        F.count("*").alias("n_edges"), F.sum(F.coalesce("weight", F.lit(1))).alias("weight")
    )


def cluster_faces(faces: DataFrame, meta: DataFrame) -> DataFrame:
    """Faces over meta nodes: those with a repeated corner and repeated corner sets drop out (the first is kept)."""
    corner = faces.select("face_id", F.posexplode("vids").alias("pos", "id")).join(meta, "id")
    f = corner.groupBy("face_id").agg(F.array_sort(F.collect_list("meta")).alias("corners"), F.count_distinct("meta").alias("d"))
    return f.filter(F.size("corners") == F.col("d")).groupBy("corners").agg(F.min("face_id").alias("face_id"))


def _segments(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains between forks of nodes(node, parent, n, size): the segments, of the same columns, and (node, segment).

    A node with two or more children ends a segment, and the segments of its children begin below it; a segment is named
    by its top node, and its parent is the segment that the fork above ends.
    """
    kids = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("k")).agg(F.count("*").alias("kids"))
    up = nodes.join(kids, F.col("parent") == F.col("k"), "left").withColumn("above", F.when(F.coalesce("kids", F.lit(0)) >= 2, F.lit(None)).otherwise(F.col("parent")))
    of = stage(hierarchy.resolve(hierarchy.build(up.select("node", F.col("above").alias("parent")))).select("node", F.col("root").alias("segment")), "segments")
    at = nodes.join(of, "node")
    size = at.groupBy("segment").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    top = at.filter("node = segment").select("segment", "parent").join(of.toDF("parent", "above"), "parent", "left").select("segment", F.col("above").alias("parent"))
    return stage(size.join(top, "segment").select(F.col("segment").alias("node"), "parent", "n", "size"), "segment-tree"), of


def prune(trees: DataFrame, min_vertices: int, min_length: float = 0.0) -> DataFrame:
    """Nodes left after terminal branches shorter than ``min_vertices`` or ``min_length`` are removed, repeatedly.

    trees(tree, node, parent, x, y, z); a parent that is no node makes a root.  Each pass decides on the state at its
    start, so the result does not depend on the order of branches; a whole tree without a fork stays.  Chains are
    contracted to segments first, and later passes work on segments only, all by joins: no task holds a tree.
    """
    pos = trees.select(F.col("node").alias("_p"), *[F.col(a).alias(f"_{a}") for a in "xyz"])
    d2 = sum((F.pow(F.col(a) - F.col(f"_{a}"), 2) for a in "xyz"), F.lit(0.0))
    step = F.coalesce(F.sqrt(d2), F.lit(0.0))
    level = stage(trees.join(pos, F.col("parent") == F.col("_p"), "left").select("node", F.col("_p").alias("parent"), F.lit(1).cast("bigint").alias("n"), step.alias("size")), "tree-nodes")
    gone: list[tuple[DataFrame, DataFrame]] = []
    while True:
        segments, of = _segments(level)
        ends = segments.join(segments.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").filter("parent IS NOT NULL")
        short = stage(ends.filter((F.col("n") < min_vertices) | (F.col("size") < min_length)).select("node"), "short-branches")
        if short.isEmpty():
            break
        gone.append((of, short))
        level = stage(segments.join(short, "node", "left_anti"), "tree-nodes")
    lost = None
    for of, short in reversed(gone):  # what a pass removed, as segments of the pass before, down to the nodes
        these = short if lost is None else short.unionByName(lost)
        lost = of.join(these.withColumnRenamed("node", "segment"), "segment", "left_semi").select("node")
    out = trees.select("tree", "node")
    return out if lost is None else out.join(lost, "node", "left_anti").select("tree", "node")


def cluster_bin(n_vertices: int, n_faces: int, extents: list[float], target_faces: int | None = None, target_ratio: float | None = None) -> float:
    """Bin edge for clustering to about ``target_faces`` faces (or ``target_ratio`` of them; a quarter by default)."""
    if target_ratio is not None:
        target_faces = int(n_faces * target_ratio)
    want = max(1, n_faces // 4 if target_faces is None else target_faces)
    return sum(extents) / len(extents) * (n_faces / want / max(1, n_vertices)) ** (1 / 3) * 2


def coarsen_mesh(nodes: DataFrame, faces: DataFrame, target_faces: int | None = None, target_ratio: float | None = None, axes: str = "xyz") -> DataFrame:
    """Faces left after clustering the corners into bins of the estimated size; one row of counts decides the size."""
    r = nodes.agg(F.count("*"), *[F.coalesce(F.max(a) - F.min(a), F.lit(0.0)).cast("double") for a in axes]).first()
    n_faces = faces.count()
    if not r[0] or not n_faces:
        return cluster_faces(faces, meta_by_bin(nodes, 1.0, axes))
    return cluster_faces(faces, meta_by_bin(nodes, cluster_bin(r[0], n_faces, list(r[1:]), target_faces, target_ratio) or 1.0, axes))


def meta_by_bin(nodes: DataFrame, bin_size: float, axes: str = "xyz") -> DataFrame:
    """(id, meta): the grid bin of each node, as the text of its indices."""
    return nodes.select("id", F.concat_ws(".", *[cell(F.col(a), bin_size).cast("string") for a in axes]).alias("meta"))
