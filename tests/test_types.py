"""Writers and readers of the geometry types, and the checks of a store with planted faults."""

import json

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from orrery.operators import polylines, rechunk, select
from orrery.schema import StoreError
from orrery.sources.store import GeometryStore
from orrery.sources.validation import validate


def new(spark, tmp_path, name="s", size=10.0, **kw):
    return GeometryStore.create(spark, f"file://{tmp_path}/{name}", [size] * 3, ([0.0] * 3, [100.0] * 3), **kw)


def walk(spark, n=4, k=12):
    return spark.range(n * k).select(
        F.col("id").alias("vid"), F.floor(F.col("id") / k).alias("oid"), (F.col("id") % k).alias("seq"), ((F.col("id") % k) * 2.5).alias("x"), F.floor(F.col("id") / k).cast("double").alias("y"), F.lit(1.0).alias("z")
    )


def test_lines(spark, tmp_path):
    s = new(spark, tmp_path)
    l = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 5.0, 5.0, 5.0, "a"), (2, 50.0, 50.0, 50.0, 60.0, 60.0, 60.0, "b"), (3, 4.0, 4.0, 4.0, 90.0, 90.0, 90.0, None)], "line_id bigint, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, kind string")
    s.write_lines(l)
    s.commit()
    assert rows(s.read_lines()) == rows(l.drop("kind"))
    assert {r["line_id"] for r in s.read_lines(bbox=([3.0] * 3, [55.0] * 3)).collect()} == {1, 2, 3}  # either end, closed
    assert {r["line_id"] for r in s.read_lines(bbox=([59.0] * 3, [61.0] * 3)).collect()} == {2}
    assert {r["line_id"] for r in s.read_lines(object_ids=[1, 3, 99]).collect()} == {1, 3}
    assert rows(s.objects().select("oid", "kind")) == [(1, "a"), (2, "b"), (3, None)]
    with pytest.raises(StoreError):
        s.write_lines(l, "ignore")
    assert rows(validate(s, 5)) == []


def test_polylines(spark, tmp_path):
    s = new(spark, tmp_path)
    g = spark.createDataFrame([(0, 1), (2, 3), (2, 1)], "gid bigint, oid bigint")
    s.write_polylines(walk(spark), groups=g, group_attributes=spark.createDataFrame([(2, "big")], "gid bigint, label string"))
    s.commit()
    assert s.read_polylines().count() == 4 and len(s.read_polylines(object_ids=[2]).first()["positions"]) == 12
    assert {r["oid"] for r in s.read_polylines(group_ids=[2]).collect()} == {1, 3}
    assert {r["oid"] for r in s.read_polylines(bbox=([0, 0, 0], [1, 1.5, 9])).collect()} == {0, 1}
    assert s.read_polylines(bbox=([0, 0, 0], [1, 1.5, 9]), exact=False).count() == 4  # all meet the cell
    parts = rows(s.read_polylines(chunks=[(0, 0, 0), (2, 0, 0)]).select("oid", "part", F.size("positions")))
    assert parts == [(o, p, 4) for o in range(4) for p in (0, 1)]
    assert rows(s.groups()) == [(0, 1, None), (1, 0, None), (2, 2, "big")]
    s.write_object_attributes(spark.createDataFrame([(1, 7.5)], "oid bigint, weight double"))
    assert rows(s.objects().select("oid", "present", "weight")) == [(0, True, None), (1, True, 7.5), (2, True, None), (3, True, None)]
    for bad in (walk(spark).withColumn("seq", F.lit(None).cast("bigint")), walk(spark).withColumn("oid", F.lit(None).cast("bigint"))):
        with pytest.raises(Exception, match="without object or place"):
            s.write_polylines(bad)
        s.discard()
    r = s.rechunk(f"file://{tmp_path}/r", "attribute", "weight")
    assert r.table("vertices").count() == 48 and {x["prefix"] for x in r.table("vertices").filter("oid = 1").collect()} == {0}
    assert r.meta.headers["rechunk"]["kind"] == "attribute" and s.chunk_dim_names("weight") == ["weight", "x", "y", "z"]
    q = s.map_chunks(lambda p: p.groupby("cx").size().reset_index(name="n")[["cx", "n"]], "cx bigint, n bigint")
    assert rows(q) == [(0, 16), (1, 16), (2, 16)]


def test_graph_and_skeleton(spark, tmp_path):
    s = new(spark, tmp_path)
    nodes = walk(spark, 1, 12).drop("seq")
    e = spark.createDataFrame([(i + 1, i, float(i)) for i in range(11)], "src_vid bigint, dst_vid bigint, weight double")
    s.write_graph(nodes, e, kind="skeleton")
    s.commit()
    n, got = s.read_graph(bbox=([5, 0, 0], [20, 5, 5]))
    assert rows(n.select("vid", "idx")) == [(v, v - 2) for v in range(2, 9)]
    assert rows(got.select("src_idx", "dst_idx")) == [(i + 1, i) for i in range(6)]
    assert s.links(chunks=[(0, 0, 0)]).count() == 3 and s.links().filter("same_cell").count() == 9
    with pytest.raises(StoreError):
        s.write_graph(nodes, spark.createDataFrame([(1, 999)], "src_vid bigint, dst_vid bigint"))
    s.discard()
    with pytest.raises(StoreError):
        s.write_graph(nodes, spark.createDataFrame([(1, 2), (1, 3)], "src_vid bigint, dst_vid bigint"), kind="skeleton")
    s.discard()
    assert rows(validate(s, 5)) == []


def test_mesh(spark, tmp_path):
    s = new(spark, tmp_path)
    nodes = spark.range(9).select(F.col("id").alias("vid"), (F.col("id") % 3 * 6.0).alias("x"), F.floor(F.col("id") / 3).cast("double").alias("y"), F.lit(0.0).alias("z"))
    faces = spark.createDataFrame([(0, [0, 1, 4, 3]), (1, [1, 2, 5]), (2, [4, 5, 8, 7])], "face_id bigint, vids array<bigint>")
    s.write_mesh(nodes, faces)
    s.commit()
    _, f = s.read_mesh(bbox=([5, 0, 0], [20, 5, 5]))
    assert rows(f.select("face_id", "corners")) == [(1, [0, 1, 3]), (2, [2, 3, 5, 4])]
    for bad in ([(3, [0, 1])], [(3, [0, 1, 77])]):
        with pytest.raises(StoreError):
            s.write_mesh(nodes, spark.createDataFrame(bad, "face_id bigint, vids array<bigint>"))
        s.discard()
    s.set_bounds([0] * 3, [7, 5, 5], force=True)
    assert rows(s.table("faces").select("face_id")) == [(0,)]


def test_parametric_and_composite(spark, tmp_path):
    s = new(spark, tmp_path, geometry_types=["point_cloud"])
    s.write_points(walk(spark, 1).drop("oid", "seq"))
    s.write_parametric(spark.createDataFrame([(1, 0, [0.0, 0.0, 1.0, 2.0], "floor"), (2, 9, [1.0], "odd")], "object_id bigint, type_id int, coefficients array<double>, name string"))
    n = walk(spark, 1, 3).drop("oid", "seq").withColumn("vid", F.col("vid") + 100)
    s.add_geometry("graph", n, links=spark.createDataFrame([(100, 101)], "src_vid bigint, dst_vid bigint"))
    s.commit()
    assert rows(s.read_parametric().select("object_id", "type_name")) == [(1, "plane"), (2, "unknown_9")] and s.read_parametric([2]).count() == 1
    with pytest.raises(StoreError):
        s.write_parametric(spark.createDataFrame([(3, 1, [1.0], "short")], "object_id bigint, type_id int, coefficients array<double>, name string"))
    c = s.composite()
    assert {k: (t["vertices"].count(), t["links"].count()) for k, t in c.items()} == {"point_cloud": (12, 0), "graph": (3, 1)}


def test_snapshots_fragments_rebin(spark, tmp_path):
    s = new(spark, tmp_path, bin_shape=[5.0] * 3)
    s.write_points(walk(spark, 1).drop("oid", "seq"))
    s.commit("first")
    s.write_points(walk(spark, 1).drop("oid", "seq").withColumn("vid", F.col("vid") + 50))
    s.commit("second")
    old = GeometryStore.open(spark, s.path, snapshot=1)
    assert old.points().count() == 12 and s.points().count() == 24 and [m for _, m in s.snapshots()] == ["first", "second"]
    with pytest.raises(StoreError):
        GeometryStore.open(spark, s.path, snapshot=9)
    with pytest.raises(StoreError):
        old.commit()
    assert s.fragment((0, 0, 0), 4).count() == 4 and s.rebind(s.path).points().count() == 24
    with pytest.raises(StoreError):
        s.fragment((0, 0, 0), 7)
    s.rebin([2.5] * 3)
    assert s.fragment((0, 0, 0), 16).count() == 2
    with pytest.raises(StoreError):
        s.rebin([3.0] * 3)
    assert s.vacuum() == 2


def test_pyramid_options(spark, tmp_path):
    for strategy in ("length", "random", "spatial_coverage", "point_thinning"):
        s = new(spark, tmp_path, strategy, bin_shape=[5.0] * 3)
        s.write_polylines(walk(spark))
        s.commit()
        s.build_pyramid([1, 2], [0.5, 1.0], storage="explicit", depth=2, strategy=strategy, chunk_scales=[1, 2])
        kept = s.objects(1).filter("present").count()
        assert kept == (1 if strategy == "point_thinning" else 2)
        far = s.table("links").filter("delta = 2").select("src_vid", "dst_vid")
        up = {k: {r["src_vid"]: r["dst_vid"] for r in s.table("links").filter(f"level = {k} AND delta = 1").collect()} for k in (0, 1)}
        assert dict(rows(far)) == {a: up[1][b] for a, b in up[0].items() if b in up[1]} and far.count() > 0
        assert s.table("links").filter("delta = -2 AND level = 2").count() == far.count()
        assert rows(validate(s, 5)) == []
    s = new(spark, tmp_path, "none", bin_shape=[5.0] * 3)
    s.write_points(walk(spark).drop("oid", "seq"))
    s.commit()
    s.coarsen_points(0, 1, 2)
    s.coarsen_points(0, 2, 2, medoid=True)
    assert s.points(1).count() == s.points(2).count() == 3


def test_planted_faults(spark, tmp_path):
    s = new(spark, tmp_path, geometry_types=["polyline"])
    s.write_polylines(walk(spark), geometry="polyline")
    s.commit()
    v = s.table("vertices")
    nan = v.filter("vid = 0").withColumns({"vid": F.lit(900), "x": F.lit(float("nan")), "oid": F.lit(None).cast("bigint")})
    s.stage("vertices", nan.unionByName(v.filter("vid = 1").withColumns({"vid": F.lit(901).cast("bigint"), "level": F.lit(3)})))
    s.stage("vertices", v.filter("vid = 2").withColumns({"vid": F.lit(902).cast("bigint"), "cx": F.lit(7).cast("bigint")}))
    s.stage("links", spark.createDataFrame([(0, 0, 1, 5, 7777, 1.0), (0, 1, 2, 8888, 5, 1.0)], "level int, delta int, link_id bigint, src_vid bigint, dst_vid bigint, weight double"))
    s.stage("faces", spark.createDataFrame([(0, 1, [1, 2]), (0, 2, [1, 2, 6666])], "level int, face_id bigint, vids array<bigint>"))
    s.stage("objects", spark.createDataFrame([(0, 77, True), (0, 3, False)], "level int, oid bigint, present boolean"))
    s.stage("groups", spark.createDataFrame([(1, 55, 0)], "gid bigint, oid bigint, member_seq int"))
    s.commit()
    got = {(r["stage"], r["check"]): r["n"] for r in validate(s, 5).collect()}
    assert got == {
        (3, "position"): 1, (3, "undeclared level"): 1, (3, "cell"): 1, (3, "link source"): 1, (3, "link target"): 2, (3, "face corner"): 1, (3, "present object without vertex"): 1,
        (3, "absent object with vertex"): 1, (3, "group member"): 1, (4, "face of fewer than three corners"): 1, (4, "place used twice"): 1, (4, "faces without a mesh"): 2,
    }
    s.meta.chunk_shape = [-1.0] * 3
    assert [r["stage"] for r in validate(s).collect()] == [2]
    fs, where = s._fs(spark, f"{s.path}/groups/{s.versions['groups'][0]}")
    fs.delete(where, True)
    assert rows(validate(s, 5)) == [(1, "missing folder of groups", 1)] and rows(validate(s, 1)) == rows(validate(s, 5))
    json.dumps(s.info())


def test_selection_strategies(spark):
    o = spark.createDataFrame([(d, i, float(i % 7), i % 5) for d in (1, 2) for i in range(50 * d)] + [(None, 3, None, None)], "dataset_id int, oid bigint, length double, b int")
    for name, kw in (("random", {}), ("length", {}), ("attribute", {"mode": "min"}), ("spatial_coverage", {"bins": ["b"]})):
        got = select.apply_sparsity(o.filter("dataset_id IS NOT NULL"), 0.3, name, **kw)
        assert rows(got.groupBy("dataset_id").count()) == [(1, 15), (2, 30)], name
        assert rows(select.apply_sparsity(o.limit(0), 0.3, name, **kw)) == []
    assert select.apply_sparsity(o, 1.0).count() == o.count()
    a, b = (rows(select.random(o, 0.5, ["dataset_id"], seed=s)) for s in (1, 2))
    assert a != b and rows(select.random(o.repartition(7), 0.5, ["dataset_id"], seed=1)) == a
    with pytest.raises(ValueError):
        select.apply_sparsity(o, 0.5, "other")


@pytest.mark.parametrize("values", [[1.0, 1.0, 2.0, 5.0], [float(i) for i in range(101)], [0.0] * 500 + [float(i * i) for i in range(60)] + [1e9], [3.0]])
def test_exact_quantiles(spark, values):
    n = spark.createDataFrame([(1, v) for v in values], "g int, _v double").groupBy("g", "_v").agg(F.count("*").alias("_n"))
    got = rechunk.quantiles(n, ["g"]).first()["_e"]
    want = list(dict.fromkeys(np.quantile(values, [0, 0.25, 0.5, 0.75, 1]).tolist()))
    assert np.allclose(got, want)


def test_simplify_keeps_a_least_number(spark):
    l = polylines.ordered(walk(spark, 2).withColumns({"dataset_id": F.lit(1), "level": F.lit(0)}))
    assert polylines.simplify(l, 1.0).count() == 4 and polylines.simplify(l, 1.0, 5).count() == 10
    out = polylines.coarsen(l.withColumn("bin", F.lit(0)), 1.0, ["bin"], selection="first")
    assert rows(out.select("oid", "ord")) == [(0, 0), (0, 1)]
