"""Queries over whole tables: all axes, all levels, all datasets."""

import __spark_entry__ as entry
from conftest import rows
from pyspark.sql import functions as F

from orrery.operators import coarsen, encode, hierarchy, points
from orrery.sources.store import GeometryStore


def put(spark, d, name, data, schema):
    spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")


def test_cells_all_axes(spark, tmp_path):
    a = [0.1] * 64
    put(spark, tmp_path, "embeddings", [(1, a), (1, a[:63] + [0.9]), (1, a)], "label int, embedding array<float>")
    assert sorted(r["n"] for r in entry.queries()["cells_high_d"](spark, str(tmp_path)).collect()) == [1, 2]


def test_quantise_takes_all_axes_and_datasets(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, -1.0, 0.0, None), (2, 3.0, 4.0, None)], "dataset_id int, x double, y double, z double")
    r = spark.createDataFrame([(1, [0.0] * 3, [10.0] * 3), (2, [0.0] * 2, None)], "dataset_id int, bounds_min array<double>, bounds_max array<double>")
    assert rows(encode.axis_ranges(p, r)) == [(1, 0.0, 10.0, 0.0, 10.0, 0.0, 10.0), (2, -1.0, 3.0, 0.0, 4.0, None, None)]
    d = "/root/testdata/sf0.001"
    q = entry.queries()["quantise"](spark, d)
    placed = entry.queries()["local_index"](spark, d)
    assert q.count() == placed.count()
    assert q.join(placed, "vid").filter("(qz IS NULL) != (dataset_id = 3)").count() == 0


def test_a_dataset_without_objects_is_one_implicit_object(spark):
    f = spark.createDataFrame([(1, 1, None, 0, "a"), (1, 2, None, 0, "b"), (2, 3, 7, 0, "a"), (2, 4, None, 0, "a"), (2, 5, 8, 1, "a")], "dataset_id int, vid bigint, oid bigint, bi bigint, cell string")
    f = f.withColumns({b: F.lit(0).cast("bigint") for b in ("bj", "bk")})
    s = spark.createDataFrame([(2, 7)], "dataset_id int, oid bigint")
    assert rows(coarsen.cross_level(f, s)) == [(1, 1, 1, True), (1, 2, 1, False), (2, 3, 3, True), (2, 4, 3, True)]


def test_pyramid_of_a_point_cloud(spark, tmp_path):
    s = GeometryStore.create(spark, f"file://{tmp_path}/s", [10.0] * 3, ([0.0] * 3, [100.0] * 3), bin_shape=[5.0] * 3, geometry_types=["point_cloud"])
    s.write_points(spark.range(40).select(F.col("id").alias("vid"), (F.col("id") / 2).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z")))
    s.commit()
    s.build_pyramid([1, 2], [0.5, 0.5], storage="explicit")
    assert rows(s.table("vertices").filter("level = 1").select("vid", "oid", "seq", "x")) == [(0, 0, 0, 2.25), (10, 0, 1, 7.25), (20, 0, 2, 12.25), (30, 0, 3, 17.25)]
    assert rows(s.table("vertices").filter("level = 2").select("oid", "seq", "x")) == [(0, 0, 4.75), (0, 1, 14.75)]
    assert rows(s.table("objects").select("level", "oid", "present")) == [(1, 0, True), (2, 0, True)]
    assert s.table("links").filter("level = 0 AND delta = 1").count() == 40


def test_two_axes_have_neighbours(spark):
    c = spark.createDataFrame([(3, 0, 0, 0), (3, 0, 0, 1), (3, 1, 0, 2)], "dataset_id int, level int, cx bigint, cy bigint")
    assert points.neighbours(c.limit(1), axes="xy").count() == 8
    assert len(rows(points.occupied_neighbours(c, axes="xy", keys=("dataset_id", "level")))) == 2


def test_queries_of_cells_hold_two_axes(spark):
    for name in ("neighbours", "neighbours_occupied", "morton", "morton_roundtrip", "gray_code", "bins_to_chunk", "fragment_index", "bin_estimate"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").filter("dataset_id = 3").count() > 0


def test_descendants_below_a_cycle(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 3), (6, 5), (7, 7)], "node bigint, parent bigint")
    nodes, pairs = hierarchy.whole(links)
    assert rows(nodes.select("node_id", "parent", "root", "cycle_id", "depth", "n_descendants", "path")) == [
        (1, 2, 1, 1, 0, 3, [1]), (2, 1, 2, 1, 0, 3, [2]), (3, 1, 1, 1, 1, 1, [1, 3]), (4, 3, 1, 1, 2, 0, [1, 3, 4]),
        (5, None, 5, None, 0, 1, [5]), (6, 5, 5, None, 1, 0, [5, 6]), (7, 7, 7, 7, 0, 0, [7]),
    ]
    assert rows(pairs) == [(1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (2, 4), (3, 4), (5, 6)]


def test_rebin_holds_no_ids(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    q = entry.queries()
    for name in ("vertices", "root_metadata"):
        t = spark.read.parquet(f"{d}/{name}.parquet")
        t.withColumn("dataset_id", F.col("dataset_id") + 100).write.parquet(f"{tmp_path}/{name}.parquet")
    assert q["rebin"](spark, str(tmp_path)).count() == q["rebin"](spark, d).count() > 0
