"""Parent-child links to full hierarchies: weighted disjoint-set forests, merged hierarchically.

Links are range-partitioned by node.  Each partition links its nodes into a weighted forest: every node gets its
*top* (where its chain of parents leaves the partition, or ends) and the weighted distance to it; chains that never
end are cycles.  The tops with a parent elsewhere form a smaller graph of the same kind, whose edges carry the
distance and the path skipped; it is partitioned and solved again until no chain leaves its partition.  Where ids
have no locality, so that a level shrinks too little to fit one task, levels contract by stars instead (a node of one
hash parity joins the parent of the other), which shrinks any graph.  Going down again, depths, paths and descendant
counts of a level come from the level above by one join each, and nodes on a cycle are found by walking the parents
from the points where the contracted cycle enters a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import blocks
from orrery.plans.staging import stage

ROWS = 1 << 17  #: nodes of a level-0 partition
MERGED = 1 << 20  #: nodes that one task may solve at the levels above
BATCH_IDS = 1 << 22  #: ids of the paths that leave a task in one batch
SHRINK = 0.7  #: a level that stays above this part of the one below contracts by stars

_EDGE = "node bigint, ptr bigint, w bigint, entry bigint, weight bigint"
_SOLVED = _EDGE + ", bucket bigint, top bigint, dist bigint, exit bigint, exit_w bigint, cyc bigint, is_on boolean"


def link_forest(node: np.ndarray, ptr: np.ndarray, has: np.ndarray, w: np.ndarray):
    """Weighted forest of the links inside one partition; ``node`` is sorted and distinct.

    Returns per node: index of its parent here (-1: none), index of its top (-1: its chain enters a cycle), distance
    to the top, smallest node of the cycle that the chain enters, whether the node lies on that cycle.
    """
    n = len(node)
    at = np.minimum(np.searchsorted(node, ptr), max(n - 1, 0))
    up = np.where(has & (node[at] == ptr), at, -1)
    jump = np.where(up < 0, np.arange(n), up)
    dist = np.where(up < 0, 0, w).astype(np.int64)
    for _ in range(int(n).bit_length() + 1):  # then every chain that ends has reached its top
        if (jump[jump] == jump).all():
            break
        dist, jump = dist + dist[jump], jump[jump]
    ends = up[jump] < 0
    label, on = np.full(n, -1, np.int64), np.zeros(n, bool)
    for s in np.unique(jump[~ends]):  # these lie on cycles, and every cycle has one
        ring, k = [], s
        while not on[k]:
            on[k] = True
            ring.append(k)
            k = up[k]
        if ring:
            label[ring] = node[ring].min()
    return up, np.where(ends, jump, -1), dist, np.where(ends, -1, label[jump]), on


def _ids(s: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    has = s.notna().to_numpy()
    return s.fillna(0).to_numpy().astype(np.int64), has


def _numbers(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A nullable bigint column as values (0 where null) and where it is not null."""
    return pc.fill_null(col, 0).to_numpy(), pc.is_valid(col).to_numpy()


def _nullable(values: np.ndarray, has: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=~has)


def preorder(up: np.ndarray) -> np.ndarray:
    """Nodes of a forest (index of the parent or -1, no cycles), each after its parent's earlier subtrees."""
    n = len(up)
    by_parent = np.argsort(up, kind="stable")
    first = np.searchsorted(up[by_parent], np.arange(-1, n + 1))
    stack, out = by_parent[: first[1]][::-1].tolist(), np.zeros(n, np.int64)
    for i in range(n):
        out[i] = k = stack.pop()
        stack += by_parent[first[k + 1] : first[k + 2]][::-1].tolist()
    return out


def _paths(up: np.ndarray, order: np.ndarray, pay: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(nodes, their paths) in batches of about BATCH_IDS ids: a path lies in one buffer that a walk in preorder overwrites."""
    starts, flat = pay.offsets.to_numpy(), pay.values.to_numpy()
    size = np.diff(starts)
    longest, end = 0, np.zeros(len(up), np.int64)
    for k in order:
        end[k] = size[k] + (end[up[k]] if up[k] >= 0 else 0)
        longest = max(longest, end[k])
    buffer, lo = np.zeros(longest, np.int64), 0
    while lo < len(order):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(end[order[lo : lo + (1 << 17)]]), BATCH_IDS)))
        part, out = order[lo:hi], []
        for k in part:
            buffer[end[k] - size[k] : end[k]] = flat[starts[k] : starts[k + 1]]
            out.append(buffer[: end[k]].copy())
        offsets = np.concatenate([[0], np.cumsum(end[part])]).astype(np.int32)
        yield part, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
        lo = hi


def _solver(paths: bool):
    """The mapInArrow function that solves one partition; its output leaves in bounded batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by("node")
        node = t.column("node").to_numpy()
        ptr, has = _numbers(t.column("ptr"))
        w = t.column("w").to_numpy()
        up, top, dist, label, on = link_forest(node, ptr, has, w)
        ends = top >= 0
        h = np.where(ends, top, 0)
        leaves = ends & has[h]
        made = {
            "bucket": pa.array(np.full(len(node), TaskContext.get().partitionId()), pa.int64()), "top": pa.array(np.where(ends, node[h], label)),
            "dist": pa.array(np.where(ends, dist, 0)), "exit": _nullable(ptr[h], leaves), "exit_w": pa.array(np.where(leaves, w[h], 0)),
            "cyc": _nullable(label, ~ends), "is_on": pa.array(on),
        }
        for name, col in made.items():
            t = t.append_column(name, col)
        if not paths:
            yield from t.to_batches(1 << 16)
            return
        order = preorder(np.where(ends, up, -1))  # nodes that lead to a cycle have no path
        pay = t.column("pay").combine_chunks()
        for part, acc in _paths(np.where(ends, up, -1), order[ends[order]], pay):
            yield from t.take(pa.array(part)).append_column("acc", acc).combine_chunks().to_batches()
        rest = np.flatnonzero(~ends)
        yield from t.take(pa.array(rest)).append_column("acc", pa.nulls(len(rest), pa.list_(pa.int64()))).to_batches(1 << 16)

    return run


def _solve(edges: DataFrame, parts: int, paths: bool) -> DataFrame:
    schema = _SOLVED + (", acc array<bigint>" if paths else "")
    cols = ["node", "ptr", "w", "entry", "weight"] + (["pay"] if paths else [])
    spread = edges.select(*cols).repartitionByRange(parts, "node") if parts > 1 else edges.select(*cols).repartition(1)
    if paths:
        schema = schema.replace(_EDGE, _EDGE + ", pay array<bigint>")
    return spread.mapInArrow(_solver(paths), schema)


def _stars(edges: DataFrame, level: int, paths: bool) -> DataFrame:
    """One contraction by stars, as joins: tails (by a hash of node and level) join a head that they point to."""
    head = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(2)) == 0
    ext = ["pay"] if paths else []
    p = edges.select(F.col("node").alias("ptr"), F.col("ptr").alias("_pp"), F.col("w").alias("_pw"), *[F.col(c).alias("_ppay") for c in ext])
    e = edges.join(p.filter(head(F.col("ptr"))), "ptr", "left")
    own = F.coalesce(F.col("ptr") == F.col("node"), F.lit(False))
    joins = F.col("_pw").isNotNull() & ~head(F.col("node")) & ~own
    pick = lambda a, b: F.when(own, F.lit(None)).when(joins, a).otherwise(b)
    stops = F.coalesce(F.col("_pp") == F.col("ptr"), F.lit(False)) & joins  # the head is a cycle of its own
    cyc = F.when(own, F.col("node")).when(stops, F.col("ptr")).cast("bigint")
    cols = [F.col(c) for c in ("node", "ptr", "w", "entry", "weight", *ext)] + [
        F.when(joins, F.col("ptr")).otherwise(F.col("node")).alias("bucket"),
        F.when(joins, F.col("ptr")).otherwise(F.col("node")).alias("top"),
        F.when(joins, F.col("w")).otherwise(F.lit(0)).cast("bigint").alias("dist"),
        F.when(stops, F.lit(None)).otherwise(pick(F.col("_pp"), F.col("ptr"))).cast("bigint").alias("exit"),
        F.coalesce(pick(F.col("_pw"), F.col("w")), F.lit(0)).cast("bigint").alias("exit_w"),
        cyc.alias("cyc"),
        own.alias("is_on"),
    ]
    if paths:
        cols.append(F.when(joins, F.concat("_ppay", "pay")).otherwise(F.col("pay")).alias("acc"))
    return e.select(*cols)


@dataclass
class Forest:
    """Solved levels, from the links themselves to the last contraction; each is a table in the shared folder."""

    levels: list[DataFrame]
    paths: bool


def build(links: DataFrame, paths: bool = False, rows: int = ROWS, merged: int = MERGED) -> Forest:
    """Solve links(node, parent).

    A null or -1 parent makes a root; a parent without a row of its own becomes a node, the top of its tree.  Rows with a null
    node are left out; copies count once, and of several parents of a node the smallest is taken.  With ``paths`` the
    levels also carry the skipped paths.  A column ``w`` holds positive distances to the parents, else they are 1.
    """
    step = F.col("w") if "w" in links.columns else F.lit(1)
    rows_ = links.filter("node IS NOT NULL").select("node", F.when(F.col("parent") != -1, F.col("parent")).alias("ptr"), step.cast("bigint").alias("w"))
    tops = rows_.filter("ptr IS NOT NULL").select(F.col("ptr").alias("node"), F.lit(None).cast("bigint").alias("ptr"), F.lit(1).cast("bigint").alias("w"))
    nodes = rows_.unionByName(tops).groupBy("node").agg(F.min("ptr").alias("ptr"), F.max("w").alias("w"))
    nothing = F.lit(None).cast("bigint")
    edges = nodes.select(
        F.col("node").cast("bigint").alias("node"), F.col("ptr").cast("bigint").alias("ptr"), "w",
        nothing.alias("entry"), F.lit(1).cast("bigint").alias("weight"), *([F.array(F.col("node").cast("bigint")).alias("pay")] if paths else []),
    )
    edges = stage(edges, "links")
    n, levels, star = edges.count(), [], False
    while True:
        parts = -(-n // rows) if not levels else (1 if n <= merged else -(-n // merged))
        done = stage(_stars(edges, len(levels), paths) if star else _solve(edges, max(1, parts), paths), "forest")
        levels.append(done)
        if parts <= 1 and not star:
            return Forest(levels, paths)
        ext = ["acc"] if paths else []
        target = done.select(F.col("node").alias("exit"), F.col("top").alias("_top"), F.col("dist").alias("_dist"), *[F.coalesce(c, F.array().cast("array<bigint>")).alias("pay") for c in ext])
        tops = done.filter("node = top AND exit IS NOT NULL AND cyc IS NULL").select("node", "exit", "exit_w")
        size = done.filter("cyc IS NULL").groupBy("top").agg(F.sum("weight").alias("weight")).withColumnRenamed("top", "node")
        edges = stage(tops.join(target, "exit").join(size, "node").select(
            "node", F.col("_top").alias("ptr"), (F.col("exit_w") + F.col("_dist")).alias("w"), F.col("exit").alias("entry"), "weight", *(["pay"] if paths else []),
        ), "contracted")
        before, n = n, edges.count()
        if not n:
            return Forest(levels, paths)
        ends = edges.select(F.col("ptr").alias("node")).distinct().join(edges.select("node"), "node", "left_anti")
        edges = edges.unionByName(ends.select(
            "node", nothing.alias("ptr"), F.lit(1).cast("bigint").alias("w"), nothing.alias("entry"), F.lit(0).cast("bigint").alias("weight"),
            *([F.array().cast("array<bigint>").alias("pay")] if paths else []),
        ))  # where chains end is a node too, so that no chain leaves a level unresolved
        star = n > merged and n > SHRINK * before


def _walk(key: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ptr, has = _ids(pdf["ptr"])
        node = pdf["node"].to_numpy().astype(np.int64)
        up = dict(zip(node[has].tolist(), ptr[has].tolist()))
        here, out = set(node.tolist()), []
        mark, marked = _ids(pdf["mark"])
        for s, m in zip(node[marked].tolist(), mark[marked].tolist()):
            while s in here:
                here.discard(s)
                out.append((s, m))
                s = up.get(s)
        return pd.DataFrame(out, columns=["node", "mark"]).astype("int64")

    return run


def cycles(forest: Forest) -> DataFrame:
    """(node, cycle_id): every node on a cycle; cycle_id is the cycle's smallest node."""
    marks = None
    for i in range(len(forest.levels) - 1, -1, -1):
        level = forest.levels[i]
        here = level.filter("is_on").select("node", F.col("cyc").alias("mark"))
        if marks is not None:  # walk from where the cycle enters the partitions of this level
            entered = level.join(marks.select(F.col("entry").alias("node"), "mark"), "node", "left")
            touched = entered.filter("mark IS NOT NULL").select("bucket").distinct()
            walked = entered.join(touched, "bucket", "left_semi").select("bucket", "node", "ptr", "mark")
            here = here.unionByName(walked.groupBy("bucket").applyInPandas(_walk("node"), "node bigint, mark bigint"))
        if i:
            here = stage(here, "on-cycle")
            marks = here.join(level.select("node", "entry"), "node").filter("entry IS NOT NULL").select("entry", "mark")
        else:
            marks = stage(here, "on-cycle")
    return marks.join(marks.groupBy("mark").agg(F.min("node").alias("cycle_id")), "mark").select("node", "cycle_id")


def _accumulate(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node", ignore_index=True)
    node = pdf["node"].to_numpy().astype(np.int64)
    ptr, has = _ids(pdf["ptr"])
    up, top, dist, _, _ = link_forest(node, ptr, has, np.ones(len(node), np.int64))
    total = pdf["weight"].to_numpy().astype(np.int64)
    order = np.flatnonzero((up >= 0) & (top >= 0))
    order = order[np.argsort(-dist[order], kind="stable")]
    cut = np.flatnonzero(np.diff(dist[order])) + 1
    for step in np.split(order, cut):  # deepest first
        np.add.at(total, up[step], total[step])
    return pd.DataFrame({"node": node, "subtree": total})


def _subtrees(forest: Forest) -> DataFrame:
    """(node, subtree): nodes at or below each node that is on no cycle."""
    below = None
    for i in range(len(forest.levels) - 1, -1, -1):
        level = forest.levels[i].filter("cyc IS NULL")
        weights = level.select("bucket", "node", "ptr", "weight")
        if below is not None:
            weights = weights.join(below, "node", "left").withColumn("weight", F.col("weight") + F.coalesce("extra", F.lit(0))).drop("extra")
        done = weights.groupBy("bucket").applyInPandas(_accumulate, "node bigint, subtree bigint")
        if i:
            done = stage(done, "subtrees")
            below = done.join(level.select("node", "entry"), "node").filter("entry IS NOT NULL")
            below = below.groupBy(F.col("entry").alias("node")).agg(F.sum("subtree").alias("extra"))
    return done


def resolve(forest: Forest) -> DataFrame:
    """(node, root, depth[, acc]): where the chain of each node ends and the distance to it, with the ids between them.

    A chain into a cycle ends at the smallest node of the cycle in the contracted graph.
    """
    above, ids = None, F.array().cast("array<bigint>")
    for i in range(len(forest.levels) - 1, -1, -1):
        s, root, depth, acc = forest.levels[i], F.col("top"), F.col("dist"), F.col("acc") if forest.paths else None
        if above is not None:
            up = above.select(F.col("node").alias("top"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), *([F.col("acc").alias("_acc")] if forest.paths else []))
            s, root, depth = s.join(up, "top", "left"), F.coalesce("_root", "top"), F.col("dist") + F.coalesce("_depth", F.lit(0))
            acc = F.concat(F.coalesce("_acc", ids), "acc") if forest.paths else None
        out = s.select("node", root.alias("root"), depth.alias("depth"), *([acc.alias("acc")] if forest.paths else []))
        above = out if i == 0 else stage(out, "resolved")
    return above


def ranks(links: DataFrame, rows: int = ROWS, merged: int = MERGED) -> DataFrame:
    """(node_id, parent, root, depth, rank, last, branch) of every node that is on no cycle and below none.

    ``rank`` is the node's place in its tree, depth first, siblings by id; the node's descendants are the nodes of its
    tree with ranks above it up to ``last``, so all descendants of all nodes take one row a node.  ``branch`` tells that
    the node before it is not its parent.  A node lies behind its parent by one and the subtrees of its earlier
    siblings: with these distances as weights, a second forest sums the ranks, so no task ever holds a whole tree.
    """
    forest = build(links, rows=rows, merged=merged)
    below = stage(forest.levels[0].select("node", F.col("ptr").alias("parent")).join(_subtrees(forest), "node"), "sizes")
    off = blocks.before(below.filter("parent IS NOT NULL"), ["parent"], "node", "subtree", "_before")
    off = stage(off.select("node", "parent", (F.col("_before") + 1).alias("w")), "offsets")
    tops = below.filter("parent IS NULL").select("node", "parent", F.lit(1).cast("bigint").alias("w"))
    place = resolve(build(off.unionByName(tops), rows=rows, merged=merged)).select("node", F.col("depth").alias("rank"))
    ring = cycles(forest).select(F.col("node").alias("root"))  # where chains into a cycle end
    trees = resolve(forest).join(ring, "root", "left_anti")
    out = trees.join(below, "node").join(place, "node").join(off.select("node", "w"), "node", "left")
    return out.select(
        F.col("node").alias("node_id"), "parent", "root", "depth", "rank", (F.col("rank") + F.col("subtree") - 1).alias("last"), F.coalesce(F.col("w") > 1, F.lit(False)).alias("branch")
    )


def nodes(forest: Forest, rings: DataFrame | None = None) -> DataFrame:
    """(node_id, root, depth, n_descendants, path, on_cycle) of every node.

    Tops that have no row of their own are nodes too.  Depth counts from 0 at the root; path lists the ids from the
    root to the node.  On a cycle, or below one, root is the cycle's smallest node, and depth, n_descendants and path
    are null.  The descendants of a node are the nodes whose path holds it.
    """
    if not forest.paths:
        raise ValueError("build the forest with paths")
    above = resolve(forest)
    on = (rings if rings is not None else cycles(forest)).withColumnRenamed("cycle_id", "_id")
    # a chain into a cycle ends at a label: the smallest node of the cycle in the contracted graph, itself on the cycle
    label = on.select(F.col("node").alias("root"), F.col("_id").alias("_in"))
    out = above.join(label, "root", "left").join(on, "node", "left").join(_subtrees(forest), "node", "left")
    bad = F.col("_in").isNotNull()
    return out.select(
        F.col("node").alias("node_id"), F.coalesce("_in", "root").alias("root"), F.when(~bad, F.col("depth")).alias("depth"),
        F.when(~bad, F.col("subtree") - 1).alias("n_descendants"), F.when(~bad, F.col("acc")).alias("path"), F.col("_id").isNotNull().alias("on_cycle"),
    )


def whole(links: DataFrame, rows: int = ROWS, merged: int = MERGED) -> tuple[DataFrame, DataFrame]:
    """Nodes and (ancestor, descendant) pairs of links(node, parent), cycles and what hangs below them included.

    The first has (node_id, parent, root, cycle_id, depth, n_descendants, path, on_cycle).  Below a cycle, depth and path
    count from the cycle node that the chain enters, which is the root; cycle_id is the cycle's smallest node.  The
    descendants of a node on a cycle are all other nodes on the cycle and below it.
    """
    rings = stage(cycles(build(links, rows=rows, merged=merged)), "rings")
    on = rings.select("node", F.lit(True).alias("_on"))
    cut = links.join(on, "node", "left").select("node", F.when(F.col("_on").isNull(), F.col("parent")).alias("parent"))
    n = nodes(build(cut, paths=True, rows=rows, merged=merged), rings.limit(0)).drop("on_cycle")
    own = links.groupBy(F.col("node").alias("node_id")).agg(F.min(F.when(F.col("parent") != -1, F.col("parent"))).alias("parent"))
    n = n.join(rings.withColumnRenamed("node", "root"), "root", "left").join(own, "node_id", "left")
    n = stage(n.withColumn("on_cycle", F.col("cycle_id").isNotNull() & (F.col("depth") == 0)), "nodes")
    size = n.filter("cycle_id IS NOT NULL").groupBy("cycle_id").agg(F.count("*").alias("_n"))
    below = F.when(F.col("on_cycle"), F.col("_n") - 1).otherwise(F.col("n_descendants"))
    out = n.join(size, "cycle_id", "left").withColumn("n_descendants", below)
    pairs = n.select(F.explode("path").alias("ancestor"), F.col("node_id").alias("descendant")).filter("ancestor != descendant")
    around = n.filter("cycle_id IS NOT NULL").join(rings, "cycle_id").filter("node != root").select(F.col("node").alias("ancestor"), F.col("node_id").alias("descendant"))
    return out.select("node_id", "parent", "root", "cycle_id", "depth", "n_descendants", "path", "on_cycle"), pairs.unionByName(around)
