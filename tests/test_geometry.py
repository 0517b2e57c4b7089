import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from orrery.functions import grid
from orrery.operators import coarsen, encode, graphs, parametric, points, polylines, rechunk, select, validate


def test_cells_are_half_open(spark):
    df = spark.createDataFrame([(-5.0, 10.0), (5.0, 10.0), (100.0, 100.0), (-0.0, 10.0), (9.999, 10.0)], "x double, s double")
    assert [r[0] for r in df.select(grid.cell(F.col("x"), F.col("s"))).collect()] == [-1, 0, 1, 0, 0]


def test_curves(spark):
    df = spark.createDataFrame([(5, 3, 1)], "a bigint, b bigint, c bigint")
    cols = [F.col(c) for c in "abc"]
    assert df.select(grid.morton(cols)).first()[0] == 87
    code = df.select(grid.morton(cols).alias("m")).select(*grid.unmorton(F.col("m"), 3)).first()
    assert tuple(code) == (5, 3, 1)
    with pytest.raises(ValueError):
        grid.morton(cols, bits=22)
    side = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    order = [tuple(r) for r in side.withColumn("d", grid.hilbert2d(F.col("x"), F.col("y"), 3)).orderBy("d").select("x", "y", "d").collect()]
    assert [d for _, _, d in order] == list(range(64))
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(order, order[1:]))


def test_fragments_and_bins(spark):
    df = spark.createDataFrame([(-1, 5)], "a bigint, b bigint")
    got = df.select(grid.bin_to_chunk(F.col("a"), 4), grid.bin_to_chunk(F.col("b"), 4), grid.linear_fragment([F.col("a"), F.col("b")], [4, 4])).first()
    assert tuple(got) == (-1, 1, 13)


def test_boxes_of_any_size(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(-500, 500, (300, 3))
    pts = spark.createDataFrame([(1, i, *map(float, q), *(int(v) for v in np.floor(q / 10))) for i, q in enumerate(p)], "dataset_id int, vid bigint, x double, y double, z double, cx bigint, cy bigint, cz bigint")
    lo = [[-500.0] * 3, [-3.0, 0.0, -250.0], [20.0] * 3, list(map(float, p[7]))]
    hi = [[500.0] * 3, [-3.0, 400.0, 9.5], [10.0] * 3, list(map(float, p[7]))]
    b = spark.createDataFrame([(k, 1, a, c, [10.0] * 3) for k, (a, c) in enumerate(zip(lo, hi)) if a <= c], "box_id int, dataset_id int, lo array<double>, hi array<double>, chunk_shape array<double>")
    want = {(k, i) for k, (a, c) in enumerate(zip(lo, hi)) for i, q in enumerate(p) if (q >= a).all() and (q <= c).all()}
    got = points.in_boxes(pts, b).select("box_id", "vid").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) >= 301


def test_neighbours(spark):
    c = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 0), (1, 5, 0, 0), (2, 0, 0, 1)], "dataset_id int, cx bigint, cy bigint, cz bigint")
    assert points.neighbours(c.limit(1)).count() == 26 and points.neighbours(c.limit(1), 2, True).count() == 125
    assert len(rows(points.occupied_neighbours(c))) == 2
    with pytest.raises(ValueError):
        points.neighbours(c, -1)


LINE = "dataset_id int, level int, oid bigint, seq int, vid bigint, x double, y double, z double, cx bigint, cy bigint, cz bigint"


def line(spark, xs, oid=1):
    return [(1, 0, oid, i, 100 * oid + i, float(x), 0.0, None, int(x // 10), 0, None) for i, x in enumerate(xs)]


def test_polylines(spark):
    df = spark.createDataFrame(line(spark, [1, 2, 11, 12, 3]) + line(spark, [5], 2) + [(1, 0, None, 0, 9, 0.0, 0.0, None, 0, 0, None)], LINE)
    l = polylines.ordered(df)
    runs = polylines.split_runs(l)
    assert [(r["run"], r["first_vid"], r["last_vid"]) for r in sorted(runs.filter("oid = 1").collect(), key=lambda r: r["run"])] == [(0, 100, 101), (1, 102, 103), (2, 104, 104)]
    assert rows(polylines.cross_links(runs).select("src_vid", "dst_vid")) == [(101, 102), (103, 104)]
    assert rows(polylines.lengths(l).select("oid", "n", "length")) == [(1, 5, 20.0), (2, 1, 0.0)]
    assert rows(polylines.midpoints(l).select("oid", "vid")) == [(1, 102), (2, 200)]
    assert rows(polylines.crop(l, F.expr("x < 10")).select("oid", "part", "n")) == [(1, 0, 2), (1, 1, 1), (2, 0, 1)]
    assert {r["oid"] for r in polylines.touching(l, F.expr("x > 11")).collect()} == {1}


def test_douglas_peucker(spark):
    p = np.array([[0, 0, 0], [1, 0.1, 0], [2, -0.1, 0], [3, 5, 0], [4, 0, 0]], float)
    assert polylines._keep_points(p, 1.0).tolist() == [True, False, True, True, True]
    assert polylines._keep_points(np.zeros((3, 3)), 0.5).tolist() == [True, False, True]
    df = spark.createDataFrame(line(spark, [0, 1, 2, 3]), LINE)
    assert rows(polylines.simplify(polylines.ordered(df), 0.1).select("vid")) == [(100,), (103,)]


def test_graphs(spark):
    nodes = spark.createDataFrame([(1, "a", 0.0), (2, "a", 1.0), (3, "b", 2.0)], "id bigint, cell string, x double")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, None), (3, 2, 2.0), (1, 1, 5.0), (1, 9, 1.0)], "src bigint, dst bigint, weight double")
    assert rows(graphs.edge_cells(edges, nodes).select("src", "dst", "same_cell")) == [(1, 1, True), (1, 2, True), (2, 3, False), (3, 2, False)]
    sub = graphs.subgraph(nodes.withColumn("g", F.lit(1)), edges.withColumn("g", F.lit(1)), F.expr("x >= 1"), ["g"])
    assert rows(sub.select("src_idx", "dst_idx")) == [(0, 1), (1, 0)]
    meta = spark.createDataFrame([(1, "p"), (2, "q"), (3, "q")], "id bigint, meta string")
    assert rows(graphs.contract(edges, meta)) == [("p", "q", 1, 1.0)]
    faces = spark.createDataFrame([(1, [1, 2, 3]), (2, [3, 2, 1])], "face_id bigint, vids array<bigint>")
    assert rows(graphs.face_cells(faces, nodes)) == [(1, 3, 2, False), (2, 3, 2, False)]
    assert rows(graphs.faces_within(faces, nodes, F.expr("x >= 1"))) == []
    three = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "id bigint, meta string")
    assert rows(graphs.cluster_faces(faces, three)) == [(["p", "q", "r"], 1)]
    assert rows(graphs.cluster_faces(faces, meta)) == []


def test_object_level_counts_revisits(spark):
    df = polylines.ordered(spark.createDataFrame(line(spark, [1, 2, 11, 12, 3]), LINE)).withColumns({"bi": F.col("cx"), "bj": F.col("cy"), "bk": F.col("cz")})
    assert [r["bi"] for r in sorted(coarsen.object_level(df).collect(), key=lambda r: r["place"])] == [0, 1, 0]
    m = coarsen.metanodes(df.withColumn("intensity", F.lit(2.0))).collect()
    assert sorted((r["n"], r["mean_x"], r["v_sum"]) for r in m) == [(2, 11.5, 4.0), (3, 2.0, 6.0)]
    assert sorted(r["vid"] for r in coarsen.medoids(df).collect()) == [101, 102]
    assert coarsen.mirrored(spark.createDataFrame([(1, 2, 3)], "dataset_id int, src_vid bigint, dst_vid bigint")).count() == 2


def test_selection(spark):
    df = spark.createDataFrame([(1, o, float(v)) for o, v in ((1, 5), (2, 9), (3, 9), (4, 1))], "d int, oid bigint, v double")
    assert [r["oid"] for r in sorted(select.top(df, "v", 2, ["d"]).collect(), key=lambda r: r["rank"])] == [2, 3]
    with pytest.raises(ValueError):
        select.top(df, "v", 2, ["d"], mode="other")
    n = lambda k, s: df.limit(1).select(select.target(F.lit(k), s)).first()[0]
    assert [n(5, 0.5), n(7, 0.5), n(3, 0.01), n(9, 1.0)] == [2, 4, 1, 9]
    a, b = rows(select.random(df, 0.5, ["d"], seed=1)), rows(select.random(df.repartition(3), 0.5, ["d"], seed=1))
    assert a == b and len(a) == 2
    reps = spark.createDataFrame([(1, o, c) for o, c in zip(range(10), "aaaaaaabbc")], "d int, oid bigint, c string")
    assert [r[1] for r in rows(select.coverage(reps, ["c"], ["d"], 0.2))] == [0, 7]
    assert [r[1] for r in rows(select.coverage(reps, ["c"], ["d"], 0.6))] == [0, 1, 2, 3, 7, 9]


def test_rechunk_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (-1, 0, 29, 30, 80, 1e9)], "v double")
    assert [r[0] for r in df.select(rechunk.by_edges(F.col("v"), [0.0, 30.0, 80.0, float("inf")])).collect()] == [0, 0, 0, 1, 2, 2]
    many = spark.createDataFrame([(1, float(i)) for i in range(12)] + [(1, None), (1, float("nan"))], "d int, v double")
    got = {r["v"]: r["prefix"] for r in rechunk.by_attribute(many, "v", ["d"]).collect() if r["v"] is not None and r["v"] == r["v"]}
    assert [got[float(i)] for i in range(12)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3]
    few = rechunk.by_attribute(many.limit(3), "v", ["d"])
    assert sorted(r["prefix"] for r in few.collect()) == [0, 1, 2]


def test_codes_and_bounds(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "c string")
    assert rows(points.encode_categorical(df, "c")) == [("a", 0), ("b", 1), ("b", 1), (None, -1)]
    with pytest.raises(TypeError):
        points.attribute_bins(spark.createDataFrame([(1.0,)], "c double"), "c")
    p = spark.createDataFrame([(1, 5.0, 5.0, 5.0), (1, 11.0, 0.0, 0.0)], "dataset_id int, x double, y double, z double")
    r = spark.createDataFrame([(1, [0.0, 0.0, 0.0], [10.0, 10.0, 10.0])], "dataset_id int, bounds_min array<double>, bounds_max array<double>")
    assert points.out_of_bounds(p, r, "ignore").count() == 1
    assert points.out_of_bounds(p, r, "expand").first()["hi_x"] == 11.0
    with pytest.raises(Exception, match="outside"):
        points.out_of_bounds(p, r, "raise").collect()
    with pytest.raises(ValueError):
        points.out_of_bounds(p, r, "other")
    q = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "v double").select(encode.quantise(F.col("v"), F.lit(0.0), F.lit(10.0), 8), encode.quantise(F.col("v"), F.lit(1.0), F.lit(1.0), 8))
    assert [tuple(x) for x in q.collect()] == [(0, 0), (128, 0), (255, 0)]


def test_parametric(spark):
    o = spark.createDataFrame([(0, [0.0, 0.0, 2.0, -4.0]), (1, [0.0] * 3 + [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0, 1.0]), (7, [1.0]), (2, [1.0])], "type_id int, coefficients array<double>")
    assert [r["type_name"] for r in parametric.decode(o).collect()] == ["plane", "line", "sphere", "unknown_7", "sphere"]
    assert parametric.check(o).count() == 1
    d = o.limit(3).select(parametric.distance(F.col("type_id"), F.col("coefficients"), F.lit(0.0), F.lit(3.0), F.lit(4.0)))
    assert [r[0] for r in d.collect()] == [2.0, 5.0, 4.0]


def test_validation(spark):
    r = spark.createDataFrame([(1, 3, [1.0, 1.0, 0.0], [0.0], [1.0], "0.6.9"), (2, 2, [1.0], [2.0], [1.0], None), (3, 2, [1.0, 1.0], [0.0], [1.0], "0.10.0")],
                              "dataset_id int, ndim int, chunk_shape array<double>, bounds_min array<double>, bounds_max array<double>, zv_version string")
    assert rows(validate.metadata(r)) == [("bounds_order", 2, 1), ("shape_length", 2, 1), ("shape_positive", 1, 1), ("version", 1, 1), ("version", 2, 1)]
