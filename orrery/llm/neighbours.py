"""Nearest vectors of every vector: a forest of random-projection trees, one shared priority queue, exact reranking.

*Fit*: each (dataset, tree) is fitted by a task of its own on a bounded sample (about ``SAMPLE`` vectors of a dataset); a
split runs between the centres of a short two-means run from two random vectors and is cut at the median.  Every vector
is indexed.  *Search*: a query's queue holds the branches not taken of all trees, keyed by the summed squares of the
margins crossed; the nearest branch is popped and descended to its leaf, again and again, and margins are only computed
along these paths.  The queues of many queries advance together as rows of arrays.  The leaves popped grow with the
power 2/3 of a tree's leaves (``pops``), so work a query grows slower than the collection.  *Rerank*: neighbouring leaves
of a tree form a block of bounded rows, the shuffle's group; a query goes once to each block that holds leaves of its,
and the best candidates are ranked by exact distances in double.  A leaf that outgrew the sample's depth is split by a tree of its
own inside its task, searched by a queue of its own, never by one side alone.

Copies of one position are searched once: the positions' smallest vids stand for all, so a position held by a third of
all rows makes no large leaf, and its members share one result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.grid import finite
from orrery.plans.sizing import small
from orrery.plans.staging import stage

SAMPLE = 65_536  #: vectors of a dataset on which its trees are fitted
GROUP = 16_384  #: vectors of a dataset that one task sends to leaves
BLOCK = 8_192  #: vectors of a tree's neighbouring leaves that meet in one task
SLACK = 8  #: candidates above k that are ranked again in double
OVERFULL = 4  #: a leaf above so many times its target is split inside its task


@dataclass(frozen=True)
class Tree:
    """A complete binary tree of hyperplanes, level by level; node i has the children 2i+1 and 2i+2."""

    normals: np.ndarray
    cuts: np.ndarray
    depth: int


def pops(leaves: float) -> int:
    """Leaves that a query visits in all trees together, by the leaves of one tree."""
    return max(16, int(np.ceil(0.7 * leaves ** (2 / 3))))


def _direction(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Direction of a split: between the centres of a short two-means run that starts at two random rows."""
    v = np.zeros(x.shape[1])
    if len(x) > 1:
        c = x[rng.choice(len(x), 2, replace=False)].astype(np.float64)
        for _ in range(6):
            near = ((x - c[0]) ** 2).sum(1) < ((x - c[1]) ** 2).sum(1)
            if near.all() or not near.any():
                break
            c = np.stack([x[near].mean(0), x[~near].mean(0)])
        v = c[0] - c[1]
    return (v if np.linalg.norm(v) > 0 else rng.normal(size=x.shape[1])).astype(np.float32)


def fit_tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """Fit ``depth`` levels on the rows of ``x`` (float32)."""
    n = (1 << depth) - 1
    normals, cuts = np.zeros((n, x.shape[1]), np.float32), np.zeros(n, np.float32)
    parts: list[np.ndarray] = [np.arange(len(x))]
    for i in range(n):
        rows = parts[i]
        v = _direction(x[rng.choice(rows, min(len(rows), 256), replace=False)], rng)
        normals[i] = v / np.linalg.norm(v)
        p = x[rows] @ normals[i]
        cuts[i] = np.median(p) if len(rows) else 0
        parts += [rows[p < cuts[i]], rows[p >= cuts[i]]]
    return Tree(normals, cuts, depth)


def own_leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf, from 0, of each row."""
    at = np.zeros(len(x), np.int64)
    for _ in range(tree.depth):
        at = 2 * at + 1 + ((x * tree.normals[at]).sum(1) >= tree.cuts[at])
    return at - ((1 << tree.depth) - 1)


def best_first(trees: list[Tree], x: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(tree, leaf) of the ``budget`` leaves that a shared priority queue over all trees pops first, per row of ``x``.

    The queue of a row is a row of ``key`` and ``node``; what cannot be popped any more is dropped every few pops, so it
    never holds more than the pops left and a few paths.  All trees have one depth.
    """
    depth, span = trees[0].depth, 2 << trees[0].depth
    budget = min(budget, len(trees) << depth)
    rows, inner = np.arange(len(x)), (1 << depth) - 1
    normals, cuts = np.zeros((len(trees) * span, x.shape[1]), np.float32), np.zeros(len(trees) * span, np.float32)
    for t, tree in enumerate(trees):
        normals[t * span : t * span + inner], cuts[t * span : t * span + inner] = tree.normals, tree.cuts
    width = len(trees) + budget + 8 * depth
    key, node = np.full((len(x), width), np.inf, np.float32), np.zeros((len(x), width), np.int32)
    key[:, : len(trees)], node[:, : len(trees)] = 0, np.arange(len(trees)) * span
    used, out = len(trees), np.zeros((len(x), budget), np.int64)
    for s in range(budget):
        if used + depth > width:
            best = np.argpartition(key[:, :used], budget - s - 1, axis=1)[:, : budget - s]
            best_k, best_n = np.take_along_axis(key, best, 1), np.take_along_axis(node, best, 1)
            used = budget - s
            key[:, :used], node[:, :used] = best_k, best_n
        j = key[:, :used].argmin(1)
        k, n = key[rows, j], node[rows, j]
        key[rows, j] = np.inf
        for _ in range(depth):
            local = n % span
            go = local < inner
            m = np.einsum("ij,ij->i", x, normals[n]) - cuts[n]
            child = n + local + 1
            right = m >= 0
            key[:, used], node[:, used] = np.where(go, k + m * m, np.inf), np.where(right, child, child + 1)
            n = np.where(go, child + right, n)
            used += 1
        out[:, s] = n
    return out // span, out % span - inner


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length of a list<float> or binary column, as float32."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    if not n:
        return np.zeros((0, 1), np.float32)
    if pa.types.is_binary(col.type):
        ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1]
        flat = np.frombuffer(col.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float32)
    else:
        flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float32, copy=False).reshape(n, -1)


def _binary(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * 4
    offsets = np.arange(0, (len(x) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _lists(row: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """``n`` lists of ``values`` whose sorted owners are ``row``."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))


_TREE = "dataset_id int, tree int, depth int, block_bits int, probes int, local_probes int, normals binary, cuts binary"
_SENT = "dataset_id int, tree int, block int, local_probes int, vid bigint, pos binary, own int, probes array<int>"
_FOUND = "dataset_id int, vid bigint, nbr array<bigint>, d2 array<double>"


def _fitter(leaf_rows: int, probes: int | None, seed: int):
    """applyInArrow over (dataset_id, tree): the tree and how it is searched, as one row."""

    def run(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("pos"))[np.argsort(t.column("vid").to_numpy(), kind="stable")]
        d, tree, n = (t.column(c)[0].as_py() for c in ("dataset_id", "tree", "n"))
        depth = max(0, min(int(np.ceil(np.log2(max(1, n / leaf_rows)))), int(np.log2(max(1, len(x) / 16)))))
        made = fit_tree(x, depth, np.random.default_rng([seed, abs(d), tree]))
        bits = int(np.clip(np.floor(np.log2(BLOCK / max(1.0, n / (1 << depth)))), 0, depth))
        top, every = probes or pops(1 << depth), probes or pops(max(1.0, n / leaf_rows))
        row = [d, tree, depth, bits, top, max(4, -(-every // top)), made.normals.tobytes(), made.cuts.tobytes()]
        names = [f.split()[0] for f in _TREE.split(", ")]
        kinds = [pa.int32()] * 6 + [pa.binary()] * 2
        return pa.table({c: pa.array([v], k) for c, v, k in zip(names, row, kinds)})

    return run


def _send(left: pa.Table, right: pa.Table) -> pa.Table:
    """Cogrouped vectors and trees of a dataset -> a record for each block that a vector lies in or is searched in."""
    kinds = [pa.int32()] * 4 + [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32())]
    names = [f.split()[0] for f in _SENT.split(", ")]
    if not left.num_rows or not right.num_rows:
        return pa.table({c: pa.array([], k) for c, k in zip(names, kinds)})
    x, vid = _matrix(left.column("pos")), left.column("vid").to_numpy()
    rep = left.column("rep").to_numpy()
    trees, number = [], []
    for r in sorted(right.to_pylist(), key=lambda r: r["tree"]):
        trees.append(Tree(np.frombuffer(r["normals"], np.float32).reshape(-1, x.shape[1]), np.frombuffer(r["cuts"], np.float32), r["depth"]))
        number.append(r["tree"])
        bits, budget, local = r["block_bits"], r["probes"], r["local_probes"]
    parts = []
    for lo in range(0, len(x), 4096):
        b, ask = x[lo : lo + 4096], np.flatnonzero(rep[lo : lo + 4096])
        own = np.stack([own_leaves(t, b) for t in trees], 1)
        row, tree, leaf = [np.repeat(np.arange(len(b)), len(trees))], [np.tile(np.arange(len(trees)), len(b))], [own.ravel()]
        kind = [np.zeros(own.size, np.int8)]  # 0: own leaf, 1: leaf to search
        if len(ask):
            t, f = best_first(trees, b[ask], budget)
            row.append(np.repeat(ask, t.shape[1])), tree.append(t.ravel()), leaf.append(f.ravel()), kind.append(np.ones(t.size, np.int8))
        row, tree, leaf, kind = map(np.concatenate, (row, tree, leaf, kind))
        o = np.lexsort((leaf, kind, leaf >> bits, tree, row))
        row, tree, leaf, kind = row[o], tree[o], leaf[o], kind[o]
        first = np.ones(len(row), bool)
        first[1:] = (np.diff(row) != 0) | (np.diff(tree) != 0) | (np.diff(leaf >> bits) != 0)
        record, start = np.cumsum(first) - 1, np.flatnonzero(first)
        r = row[start]
        parts.append(pa.table({
            "dataset_id": pa.array(np.full(len(r), left.column("dataset_id")[0].as_py()), pa.int32()), "tree": pa.array(np.array(number)[tree[start]], pa.int32()),
            "block": pa.array(leaf[start] >> bits, pa.int32()), "local_probes": pa.array(np.full(len(r), local), pa.int32()), "vid": pa.array(vid[lo + r], pa.int64()),
            "pos": _binary(b[r]), "own": pa.array(np.where(kind[start] == 0, leaf[start], -1), pa.int32()),
            "probes": _lists(record[kind == 1], len(r), leaf[kind == 1], pa.int32()),
        }))
    return pa.concat_tables(parts)


class _Block:
    """The vectors of a block: candidates of queries from leaves, by distances in float32 around the block's centre.

    Where more candidates than are kept lie at the k-th distance within the error of float32, the row is decided by
    exact distances and vids, so ties never depend on the order of rows.
    """

    def __init__(self, x: np.ndarray, vid: np.ndarray, k: int, leaf_rows: int, local_probes: int):
        self.x, self.vid, self.k, self.take, self.leaf_rows, self.local_probes = x, vid, k, k + SLACK, leaf_rows, local_probes
        self.a = (x - x.mean(0)).astype(np.float32)
        self.aa = (self.a * self.a).sum(1)
        self.error = 4e-6 * (float(self.aa.max()) + self.aa)

    def least(self, row: np.ndarray, dist: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``take`` candidates of each query that may be among its k nearest."""
        if dist.shape[1] <= self.take:
            return row, dist
        c = np.argpartition(dist, self.take - 1, axis=1)[:, : self.take]
        best = np.take_along_axis(dist, c, 1)
        edge = np.partition(best, self.k - 1, axis=1)[:, self.k - 1] + self.error[queries]
        out, kept = np.take_along_axis(row, c, 1), best
        for i in np.flatnonzero(np.isfinite(edge) & (best.max(1) <= edge)):
            near = np.flatnonzero(dist[i] <= edge[i])
            r = row[i, near]
            exact = ((self.x[r].astype(np.float64) - self.x[queries[i]].astype(np.float64)) ** 2).sum(1)
            o = np.lexsort((self.vid[r], exact))[: self.take]
            out[i], kept[i] = r[o], dist[i, near[o]]
        return out, kept

    def nearest(self, members: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, take): rows of the nearest members and their distances; -1 and inf where there are too few."""
        if len(members) <= OVERFULL * self.leaf_rows:
            return self._dense(members, queries)
        depth = int(np.ceil(np.log2(len(members) / self.leaf_rows)))
        tree = fit_tree(self.x[members], depth, np.random.default_rng(len(members)))
        own = own_leaves(tree, self.x[members])
        order = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[order], np.arange((1 << depth) + 1))
        _, leaf = best_first([tree], self.x[queries], self.local_probes)
        row, dist = np.full((len(queries), self.take), -1, np.int64), np.full((len(queries), self.take), np.inf, np.float32)
        for f in np.unique(leaf):
            q = np.flatnonzero((leaf == f).any(1))
            r, d = self._dense(members[order[ends[f] : ends[f + 1]]], queries[q])
            row[q], dist[q] = self.least(np.concatenate([row[q], r], 1), np.concatenate([dist[q], d], 1), queries[q])
        return row, dist

    def _dense(self, members: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, dist = np.full((len(queries), self.take), -1, np.int64), np.full((len(queries), self.take), np.inf, np.float32)
        for lo in range(0, len(members), 2048):
            m = members[lo : lo + 2048]
            near = self.aa[m][None, :] - 2 * (self.a[queries] @ self.a[m].T)
            r, d = self.least(np.broadcast_to(m, near.shape), near, queries)
            if lo == 0:
                row[:, : r.shape[1]], dist[:, : r.shape[1]] = r, d
            else:
                row, dist = self.least(np.concatenate([row, r], 1), np.concatenate([dist, d], 1), queries)
        return row, dist


def _block_search(k: int, leaf_rows: int):
    """applyInArrow on a block: every query's best members among the leaves that it visits there."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, vid, own = _matrix(t.column("pos")), t.column("vid").to_numpy(), t.column("own").to_numpy()
        lists = t.column("probes").combine_chunks()
        count = lists.value_lengths().to_numpy()
        leaf_of, starts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(count)])
        members = np.flatnonzero(own >= 0)
        members = members[np.argsort(own[members], kind="stable")]
        held = own[members]
        block = _Block(x, vid, k, leaf_rows, t.column("local_probes")[0].as_py())
        ask = np.flatnonzero(count)
        ask = ask[np.argsort(count[ask], kind="stable")]  # queries of like number of leaves go together
        out: list = [[], [], [], []]
        for lo in range(0, len(ask), 4096):
            q = ask[lo : lo + 4096]
            slots = int(count[q].max())
            at = np.concatenate([leaf_of[starts[r] : starts[r + 1]] for r in q])
            who = np.repeat(np.arange(len(q)), count[q])
            slot = np.arange(len(who)) - np.repeat(np.cumsum(count[q]) - count[q], count[q])
            row = np.full((len(q), slots, block.take), -1, np.int64)
            dist = np.full((len(q), slots, block.take), np.inf, np.float32)
            o = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[o])) + 1
            for part in np.split(o, cuts):
                f = at[part[0]]
                m = members[np.searchsorted(held, f) : np.searchsorted(held, f, "right")]
                row[who[part], slot[part]], dist[who[part], slot[part]] = block.nearest(m, q[who[part]])
            r, d = block.least(row.reshape(len(q), -1), dist.reshape(len(q), -1), q)
            exact = ((x[r].astype(np.float64) - x[q][:, None, :].astype(np.float64)) ** 2).sum(2)
            exact[r < 0] = np.inf
            ids = np.where(r < 0, np.iinfo(np.int64).max, vid[r])
            order = np.lexsort((ids, exact), axis=1)[:, :k]
            ids, exact = np.take_along_axis(ids, order, 1), np.take_along_axis(exact, order, 1)
            good = np.isfinite(exact)
            out[0].append(vid[q]), out[1].append(good.sum(1)), out[2].append(ids[good]), out[3].append(exact[good])
        q, n, ids, exact = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        who = np.repeat(np.arange(len(q)), n)
        d = t.column("dataset_id")[0].as_py()
        return pa.table({
            "dataset_id": pa.array(np.full(len(q), d), pa.int32()), "vid": pa.array(q, pa.int64()),
            "nbr": _lists(who, len(q), ids, pa.int64()), "d2": _lists(who, len(q), exact.astype(float), pa.float64()),
        })

    return run


def _merge(k: int):
    """mapInArrow: candidate lists of a vector -> its k nearest, each vid once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d = b.column("nbr"), b.column("d2")
            row = np.repeat(np.arange(len(n)), n.value_lengths().to_numpy())
            ids, dist = n.flatten().to_numpy(), d.flatten().to_numpy()
            o = np.lexsort((ids, dist, row))  # equal ids have equal distances, so they lie together
            row, ids, dist = row[o], ids[o], dist[o]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
            row, ids, dist = row[first], ids[first], dist[first]
            rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
            row, ids, dist = row[rank < k], ids[rank < k], dist[rank < k]
            lists = [_lists(row, len(n), ids, pa.int64()), _lists(row, len(n), dist, pa.float64())]
            yield pa.record_batch([b.column("dataset_id"), b.column("vid"), *lists], names=["dataset_id", "vid", "nbr", "d2"])

    return run


def valid_vectors(vectors: DataFrame, root: DataFrame) -> DataFrame:
    """Distinct (dataset_id, vid, pos) that take part: pos not null, ndim entries, all finite; vid not null."""
    dims = root.select("dataset_id", F.col("ndim").alias("_nd"))
    v = vectors.select("dataset_id", "vid", "pos").join(dims, "dataset_id")
    ok = (F.size("pos") == F.col("_nd")) & F.forall("pos", finite) & F.col("vid").isNotNull() & (F.col("_nd") > 0)
    return v.filter(F.col("pos").isNotNull() & ok).select(F.col("dataset_id").cast("int"), "vid", "pos").distinct()


def _tasks(df: DataFrame, rows: int) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism, rows // 20_000)


def _salted(df: DataFrame, sizes: DataFrame, rows: int) -> DataFrame:
    """Add ``n``, the size of the row's dataset, and ``salt``: a part of the dataset of about ``rows`` rows."""
    parts = F.ceil(F.col("n") / F.lit(rows))
    return df.join(sizes, "dataset_id").withColumn("salt", F.pmod(F.xxhash64("vid", F.lit("part")), parts).cast("int"))


def knn(
    vectors: DataFrame, root: DataFrame, k: int = 10, trees: int = 3, leaf_rows: int = 128, probes: int | None = None, sample: int = SAMPLE, seed: int = 7
) -> DataFrame:
    """(dataset_id, vid, rank, neighbour, d2): the k nearest other vids of every valid vector, ties by smaller vid.

    Approximate where a dataset has more leaves than a query visits (``probes`` leaves of all trees, by default
    :func:`pops` of the leaves of one); recall is measured in the README.  Repeated rows count once; vectors of equal pos
    share one search; datasets with one vector, and empty tables, give no rows.
    """
    v = stage(valid_vectors(vectors, root), "vectors")
    cls = stage(v.groupBy("dataset_id", "pos").agg(F.min("vid").alias("vid"), F.count("*").alias("copies")), "positions")
    sizes = stage(cls.groupBy("dataset_id").agg(F.count("*").alias("n")), "sizes")  # one row a dataset
    part = F.lit(float(1 << 30)) * F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
    picked = cls.join(sizes, "dataset_id").filter(F.pmod(F.xxhash64("vid", F.lit("sample")), F.lit(1 << 30)) < part)
    picked = picked.select("dataset_id", "n", "vid", "pos", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    forest = stage(picked.groupBy("dataset_id", "tree").applyInArrow(_fitter(leaf_rows, probes, seed), _TREE), "forest")

    copied = cls.filter("copies > 1").select("dataset_id", "pos", F.col("vid").alias("rep"))
    shared = stage(v.join(copied, ["dataset_id", "pos"]).filter("vid <> rep").select("dataset_id", "vid", "rep", "pos"), "copies")
    w = Window.partitionBy("dataset_id", "rep").orderBy("vid")
    few = shared.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)  # with rep, k + 1 copies stand for all
    base = cls.select("dataset_id", "vid", "pos", F.lit(True).alias("rep")).unionByName(few.select("dataset_id", "vid", "pos", F.lit(False).alias("rep")))
    tasks = _tasks(v, cls.count())
    keys = ["dataset_id", "salt"]
    spread = _salted(base, sizes, GROUP).drop("n")
    copies = forest.join(sizes, "dataset_id").withColumn("salt", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / F.lit(GROUP)) - 1).cast("int")))).drop("n")
    sent = spread.repartition(tasks, *keys).groupBy(*keys).cogroup(copies.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(_send, _SENT)
    place = ["dataset_id", "tree", "block"]
    found = sent.repartition(tasks, *place).groupBy(*place).applyInArrow(_block_search(k + 1, leaf_rows), _FOUND)
    lists = found.groupBy("dataset_id", "vid").agg(F.flatten(F.collect_list("nbr")).alias("nbr"), F.flatten(F.collect_list("d2")).alias("d2"))
    near = stage(lists.mapInArrow(_merge(k + 1), _FOUND), "nearest")
    held = near.join(shared.select("dataset_id", F.col("rep").alias("vid")).distinct(), ["dataset_id", "vid"], "left_semi").withColumnRenamed("vid", "rep")
    other = shared.join(small(stage(held, "held")), ["dataset_id", "rep"]).select("dataset_id", "vid", "nbr", "d2")
    pairs = F.filter(F.arrays_zip("nbr", "d2"), lambda p: p["nbr"] != F.col("vid"))
    out = near.unionByName(other).select("dataset_id", "vid", F.posexplode(F.slice(pairs, 1, k)).alias("rank", "p"))
    return out.select("dataset_id", "vid", (F.col("rank") + 1).alias("rank"), F.col("p.nbr").alias("neighbour"), F.col("p.d2").alias("d2"))


def neighbour_pairs(nearest: DataFrame) -> DataFrame:
    """(vid_a, vid_b), vid_a < vid_b: one of the two is among the nearest of the other."""
    return nearest.select(F.least("vid", "neighbour").alias("vid_a"), F.greatest("vid", "neighbour").alias("vid_b")).distinct()


def _scan(k: int):
    """Cogrouped part of a dataset and queries -> each query's k nearest of the part, by exact distances."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, vid, q, qid = _matrix(left.column("pos")), left.column("vid").to_numpy(), _matrix(right.column("pos")), right.column("vid").to_numpy()
        out: list = [[], [], []]
        for lo in range(0, len(q) if len(x) else 0, 64):
            d2 = np.stack([((x.astype(np.float64) - p.astype(np.float64)) ** 2).sum(1) for p in q[lo : lo + 64]])
            d2[vid[None, :] == qid[lo : lo + 64, None]] = np.inf
            order = np.lexsort((np.broadcast_to(vid, d2.shape), d2), axis=1)[:, :k]
            d = np.take_along_axis(d2, order, 1)
            good = np.isfinite(d)
            out[0].append(np.repeat(qid[lo : lo + 64], good.sum(1))), out[1].append(vid[order][good]), out[2].append(d[good])
        q, n, d = (np.concatenate(c) if c else np.zeros(0) for c in out)
        who = left if left.num_rows else right
        return pa.table({"dataset_id": pa.array(np.full(len(q), who.column("dataset_id")[0].as_py()), pa.int32()), "vid": pa.array(q, pa.int64()), "neighbour": pa.array(n, pa.int64()), "d2": pa.array(d, pa.float64())})

    return run


def recall(nearest: DataFrame, vectors: DataFrame, root: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(dataset_id, n_queries, n_true, n_hit): how many of the true k nearest of the queries ``nearest`` holds.

    Queries are the valid vectors whose vid is divisible by ``every``; each meets all vectors of its dataset, part by part.
    """
    v = stage(valid_vectors(vectors, root), "vectors")
    sizes = v.groupBy("dataset_id").agg(F.count("*").alias("n"))
    keys = ["dataset_id", "salt"]
    parts = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / F.lit(GROUP)) - 1).cast("int")))
    asked = v.filter(F.col("vid") % every == 0).toDF("dataset_id", "vid", "pos").select(*[F.col(c).alias(c) for c in ("dataset_id", "vid", "pos")])
    left = _salted(v, sizes, GROUP).drop("n").groupBy(*keys)
    right = asked.join(sizes, "dataset_id").withColumn("salt", parts).drop("n").groupBy(*keys)
    each = left.cogroup(right).applyInArrow(_scan(k), "dataset_id int, vid bigint, neighbour bigint, d2 double")
    w = Window.partitionBy("dataset_id", "vid").orderBy("d2", "neighbour")
    true = each.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).select("dataset_id", "vid", "neighbour")
    hit = true.join(nearest.select("dataset_id", "vid", "neighbour", F.lit(1).alias("_hit")), ["dataset_id", "vid", "neighbour"], "left")
    return hit.groupBy("dataset_id").agg(F.count_distinct("vid").alias("n_queries"), F.count("*").alias("n_true"), F.count("_hit").alias("n_hit"))
