import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("orrery.llm")
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import rows  # noqa: E402

from orrery.llm import neighbours  # noqa: E402


def test_knn_of_few_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (80, 4)).astype(float)  # many ties and equal positions
    x[:30] = x[0]  # a position held by many vids
    data = [(3, int(v), list(map(float, p))) for v, p in zip(rng.permutation(500)[:80], x)]
    bad = [(3, 900, None), (3, 901, [1.0] * 3), (3, 902, [float("nan")] * 4), (3, 903, []), (9, 904, [1.0] * 4), (4, 905, [1.0] * 4), (3, None, [1.0] * 4), data[3], data[40]]
    v = spark.createDataFrame([(*r, "clash") for r in data + bad], "dataset_id int, vid bigint, pos array<float>, n string")
    meta = spark.createDataFrame([(3, 4), (4, 4)], "dataset_id int, ndim int")
    got: dict = {}
    for r in neighbours.knn(v, meta, k=10).collect():
        got.setdefault(r["vid"], {})[r["rank"]] = r["neighbour"]
    pos = {i: np.array(p) for _, i, p in data}
    assert set(got) == set(pos)
    for i, p in pos.items():
        want = sorted((float(((p - q) ** 2).sum()), j) for j, q in pos.items() if j != i)[:10]
        assert [got[i][k] for k in range(1, 11)] == [j for _, j in want], i
    assert rows(neighbours.knn(v.limit(0), meta)) == []


def test_ties_do_not_depend_on_the_order_of_rows():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (400, 4)).astype(np.float32)
    vid = rng.permutation(1000)[:400]
    for _ in range(3):
        o = rng.permutation(400)
        t = pa.table({
            "dataset_id": pa.array([1] * 400, pa.int32()), "local_probes": pa.array([4] * 400, pa.int32()), "vid": pa.array(vid[o]), "pos": neighbours._binary(x[o]),
            "own": pa.array((vid[o] % 3).astype(np.int32)), "probes": pa.array([[0, 1, 2]] * 400, pa.list_(pa.int32())),
        })
        got = {r["vid"]: r["nbr"] for r in neighbours._block_search(6, 128)(t).to_pylist()}
        for i, v in enumerate(vid):
            d = ((x.astype(float) - x[i]) ** 2).sum(1)
            assert got[v] == vid[np.lexsort((vid, d))[:6]].tolist()


@pytest.mark.parametrize("sample", [65536, 300])  # with the second the leaves outgrow the sample and are split in their tasks
def test_recall(spark, sample):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16)) * 2
    x = (centres[rng.integers(0, 8, 6000)] + rng.normal(size=(6000, 16))).astype(np.float32)
    v = spark.createDataFrame([(1, i, p.tolist()) for i, p in enumerate(x)], "dataset_id int, vid bigint, pos array<float>")
    meta = spark.createDataFrame([(1, 16)], "dataset_id int, ndim int")
    near = neighbours.knn(v, meta, leaf_rows=32, sample=sample)
    assert near.count() == 60000
    r = neighbours.recall(near, v, meta).first()
    assert r["n_queries"] == 60 and r["n_true"] == 600 and r["n_hit"] >= 540


def test_queue_pops_in_order():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 6)).astype(np.float32)
    trees = [neighbours.fit_tree(x, 4, rng) for _ in range(3)]
    tree, leaf = neighbours.best_first(trees, x[:50], 48)
    assert all(len({*zip(a, b)}) == 48 for a, b in zip(tree, leaf))  # every leaf of every tree once

    def cost(t, f, p):
        node, out = 0, 0.0
        for bit in format(f, "04b"):
            m = p @ t.normals[node] - t.cuts[node]
            out += m * m if (m >= 0) != (bit == "1") else 0
            node = 2 * node + 1 + (bit == "1")
        return out

    for row in range(50):
        c = [cost(trees[t], f, x[row]) for t, f in zip(tree[row], leaf[row])]
        assert all(a <= b + 1e-4 for a, b in zip(c, c[1:]))
        assert {(t, int(neighbours.own_leaves(trees[t], x[row : row + 1])[0])) for t in range(3)} == {*zip(tree[row][:3].tolist(), leaf[row][:3].tolist())}
    few = neighbours.best_first(trees, x[:50], 9)
    assert (few[0] == tree[:, :9]).all() and (few[1] == leaf[:, :9]).all()


def test_positions_that_no_tree_can_tell_apart():
    x = np.zeros((700, 3), np.float32)
    t = pa.table({
        "dataset_id": pa.array([1] * 700, pa.int32()), "local_probes": pa.array([4] * 700, pa.int32()), "vid": pa.array(range(700)), "pos": neighbours._binary(x),
        "own": pa.array([0] * 700, pa.int32()), "probes": pa.array([[0]] * 700, pa.list_(pa.int32())),
    })
    out = neighbours._block_search(5, 16)(t)
    assert out.num_rows == 700 and all(len(n) == 5 for n in out.column("nbr").to_pylist())
