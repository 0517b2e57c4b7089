import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.operators import blocks, graphs, hierarchy


def brute(links):
    """node -> (root, depth, path) for trees; node -> cycle id on or below cycles; set of nodes on cycles."""
    up = {}
    for n, p in links:
        if n is not None and (n not in up or up[n] is None or (p not in (None, -1) and p < up[n])):
            up[n] = p if p != -1 else None
    tree, on, below = {}, {}, {}
    for n in set(up) | {p for p in up.values() if p is not None}:
        path, k = [n], n
        while up.get(k) is not None and up[k] not in path:
            k = up[k]
            path.append(k)
        nxt = up.get(k)
        if nxt is None:
            tree[n] = (path[-1], len(path) - 1, path[::-1])
        else:
            ring = path[path.index(nxt):]
            below[n] = min(ring)
            if n in ring:
                on[n] = min(ring)
    return tree, on, below


def forest_of(kind, seed):
    r = random.Random(seed)
    n = 300
    ids = list(range(1, n + 1)) if kind != "scattered" else r.sample(range(-(10**12), 10**12), n)
    links = []
    for i, v in enumerate(ids):
        x = r.random()
        if x < 0.03:
            p = None
        elif x < 0.05:
            p = -1
        elif x < 0.08:
            p = 10**15 + r.randrange(5)  # no row of its own
        elif kind == "chain":
            p = ids[i - 1] if i else None
        else:
            p = r.choice(ids) if kind == "any" else ids[max(0, i - r.randrange(1, 12))]
        links.append((v, p))
    for _ in range(4):
        a = r.randrange(n - 30)
        for j in range(a, a + r.choice([1, 2, 25])):
            links[j] = (ids[j], ids[j + 1])
        links[j + 1] = (ids[j + 1], ids[a])
    links += r.sample(links, 20) + [(None, 3)]
    r.shuffle(links)
    return links


@pytest.mark.parametrize("kind,size", [("near", (1 << 17, 1 << 20)), ("chain", (40, 60)), ("scattered", (40, 60)), ("any", (60, 40))])
def test_against_brute_force(spark, kind, size):
    links = forest_of(kind, len(kind) + size[0])
    tree, on, below = brute(links)
    forest = hierarchy.build(spark.createDataFrame(links, "node bigint, parent bigint"), paths=True, rows=size[0], merged=size[1])
    assert dict(rows(hierarchy.cycles(forest))) == on
    got = {r["node_id"]: r for r in hierarchy.nodes(forest).collect()}
    assert set(got) == set(tree) | set(below)
    for n, (root, depth, path) in tree.items():
        r = got[n]
        assert (r["root"], r["depth"], r["path"], r["on_cycle"]) == (root, depth, path, False), n
        assert r["n_descendants"] == sum(n in p for _, _, p in tree.values()) - 1, n
    for n, c in below.items():
        r = got[n]
        assert (r["root"], r["depth"], r["path"], r["on_cycle"]) == (c, None, None, n in on), n
    ranked = {r["node_id"]: r for r in hierarchy.ranks(spark.createDataFrame(links, "node bigint, parent bigint"), *size).collect()}
    assert set(ranked) == set(tree)
    for root in {t[0] for t in tree.values()}:
        mine = sorted((n for n in tree if tree[n][0] == root), key=lambda n: tree[n][2])
        assert [ranked[n]["rank"] for n in mine] == list(range(len(mine)))
        for n in mine:
            assert ranked[n]["last"] - ranked[n]["rank"] == sum(n in tree[m][2] for m in mine) - 1


def test_empty_and_self_parent(spark):
    empty = hierarchy.build(spark.createDataFrame([], "node bigint, parent bigint"), paths=True)
    assert rows(hierarchy.cycles(empty)) == [] and rows(hierarchy.nodes(empty)) == []
    one = hierarchy.build(spark.createDataFrame([(5, 5), (6, 5)], "node bigint, parent bigint"))
    assert rows(hierarchy.cycles(one)) == [(5, 5)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.one_of(st.none(), st.integers(0, 30))), max_size=26, unique_by=lambda t: t[0]))
def test_link_forest(links):
    links = sorted(links)
    node = np.array([n for n, _ in links], np.int64)
    has = np.array([p is not None for _, p in links], bool)
    ptr = np.array([p or 0 for _, p in links], np.int64)
    if not len(node):
        return
    up, top, dist, label, on = hierarchy.link_forest(node, ptr, has, np.ones(len(node), np.int64))
    here = dict(links)
    for i, n in enumerate(node.tolist()):
        path, k = [n], n
        while here.get(k) is not None and here[k] in here and here[k] not in path:
            k = here[k]
            path.append(k)
        if here[k] is None or here[k] not in here:
            assert (node[top[i]], dist[i], on[i]) == (path[-1], len(path) - 1, False)
        else:
            ring = path[path.index(here[k]):]
            assert top[i] == -1 and label[i] == min(ring) and on[i] == (n in ring)


def test_preorder_and_prune(spark):
    links = [(1, None), (2, 1), (3, 2), (4, 2), (5, 1), (6, 5), (7, 6), (8, 7)]
    got = sorted(hierarchy.ranks(spark.createDataFrame(links, "node bigint, parent bigint")).collect(), key=lambda r: r["rank"])
    assert [r["node_id"] for r in got] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert [r["node_id"] for r in got if r["branch"]] == [4, 5]
    t = spark.createDataFrame([(1, a, b, float(a), 0.0, 0.0) for a, b in links], "tree bigint, node bigint, parent bigint, x double, y double, z double")
    assert [r[1] for r in rows(graphs.prune(t, 2))] == [1, 5, 6, 7, 8]  # 3 and 4 go, then 2, a branch of one vertex


@pytest.mark.parametrize("least,length", [(3, 0.0), (2, 6.0), (6, 0.0)])
def test_prune_against_brute_force(spark, least, length):
    r = random.Random(least)
    up = {i: (None if i == 0 else max(0, i - r.choice([1, 1, 1, 2, 9]))) for i in range(120)} | {1000 + i: (None if i == 0 else 999 + i) for i in range(5)}
    pos = {n: (r.uniform(0, 4), r.uniform(0, 4), 0.0) for n in up}
    alive = set(up)
    while True:
        kids = {n: sum(up[m] == n for m in alive) for n in alive}
        out = set()
        for leaf in (n for n in alive if not kids[n]):
            branch, n, size = [], leaf, 0.0
            while n is not None and kids[n] < 2:
                branch.append(n)
                size += 0.0 if up[n] is None else sum((a - b) ** 2 for a, b in zip(pos[n], pos[up[n]])) ** 0.5
                n = up[n]
            if n is not None and (len(branch) < least or size < length):
                out |= set(branch)
        if not out:
            break
        alive -= out
    t = spark.createDataFrame([(int(n >= 1000), n, p, *pos[n]) for n, p in up.items()], "tree bigint, node bigint, parent bigint, x double, y double, z double")
    assert sorted(x[1] for x in rows(graphs.prune(t, least, length))) == sorted(alive)


def test_a_deep_chain_leaves_in_bounded_batches():
    n = 20_000
    up = np.arange(-1, n - 1)
    pay = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(np.arange(n)))
    seen = 0
    for part, acc in hierarchy._paths(up, hierarchy.preorder(up), pay):
        assert len(acc.values) <= hierarchy.BATCH_IDS + n
        assert acc.values.to_numpy()[-1] == part[-1]
        seen += len(acc.values)
    assert seen == n * (n + 1) // 2


def test_numbers_inside_hot_groups(spark):
    data = [(None if i % 7 == 0 else i % 2, i * 3 - 500, i) for i in range(400)]
    df = spark.createDataFrame(data, "g int, id bigint, v int")
    for block in (1, 64, 1 << 20):
        got = {(r["g"], r["id"]): r for r in blocks.before(blocks.number(df, ["g"], "id", "i", block), ["g"], "id", "v", "s", block).collect()}
        for g in (None, 0, 1):
            mine = sorted((i, v) for h, i, v in data if h == g)
            assert [got[g, i]["i"] for i, _ in mine] == list(range(len(mine)))
            assert [got[g, i]["s"] for i, _ in mine] == [sum(v for _, v in mine[:k]) for k in range(len(mine))]
    assert rows(blocks.number(df.limit(0), ["g"], "id", "i")) == []
