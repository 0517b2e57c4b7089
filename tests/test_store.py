import pytest
from conftest import rows
from pyspark.sql import functions as F

from orrery.schema import Level, Meta, StoreError, ratio
from orrery.sources.store import GeometryStore
from orrery.streaming.append import append_stream, windowed_cells


def vertices(spark, n=40):
    return spark.range(n).select(F.col("id").alias("vid"), (F.col("id") / 2).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"), F.floor(F.col("id") / 10).alias("oid"), F.col("id").alias("seq"), (F.col("id") % 3).alias("kind"))


@pytest.fixture
def store(spark, tmp_path):
    s = GeometryStore.create(spark, f"file://{tmp_path}/s", [10.0, 10.0, 10.0], ([0.0] * 3, [100.0] * 3), bin_shape=[5.0, 5.0, 5.0], geometry_types=["polyline"])
    s.write_points(vertices(spark))
    s.stage("groups", spark.createDataFrame([(1, 0, 0), (1, 2, 1), (2, 3, 0)], "gid bigint, oid bigint, member_seq int"))
    s.commit()
    return s


def test_round_trip_and_filters(spark, store):
    s = GeometryStore.open(spark, store.path)
    assert s.points().count() == 40 and rows(s.chunk_keys()) == [(0, 0, 0), (1, 0, 0)]
    assert s.points(bbox=([0, 0, 0], [5, 5, 5])).count() == 11
    assert s.points(object_ids=[1, 99]).count() == 10 and s.points(chunks=[]).count() == 0 and s.points(chunks=[(1, 0, 0)]).count() == 20
    assert s.points(group_ids=[1], object_ids=[2, 3], where="kind = 0").count() == 3
    assert s.points(attributes=["kind"]).columns == ["vid", "oid", "seq", "x", "y", "z", "kind"]
    with pytest.raises(StoreError):
        s.points(group_ids=[1, 50])
    assert s.has_object(3) and not s.has_object(9) and len(rows(s.present_oids())) == 4
    assert len(s.polylines(object_ids=[0]).first()["positions"]) == 10
    with pytest.raises(StoreError):
        s.replace("vertices", s.table("vertices"))


def test_staging_and_append(spark, store):
    store.append_vertices(vertices(spark, 3).drop("oid").withColumn("vid", F.col("vid") + 100))
    assert store.points().count() == 40
    store.discard()
    store.append_vertices(vertices(spark, 3).drop("oid").withColumn("vid", F.col("vid") + 100))
    store.commit()
    assert sorted(r["oid"] for r in store.points(where="vid >= 100").collect()) == [4, 5, 6]
    with pytest.raises(StoreError):
        store.append_vertices(vertices(spark))
    store.compact()
    assert store.vacuum() >= 2 and GeometryStore.open(spark, store.path).points().count() == 43


def test_bounds(spark, store):
    with pytest.raises(Exception, match="outside"):
        store.write_points(vertices(spark).withColumn("x", F.lit(1e6)))
    store.discard()
    store.write_points(vertices(spark, 1).withColumn("x", F.lit(200.0)).withColumn("vid", F.lit(999)), "expand")
    store.commit()
    assert store.meta.bounds_max[0] == 200.0
    with pytest.raises(StoreError):
        store.set_bounds([0] * 3, [10] * 3)
    store.set_bounds([0] * 3, [10] * 3, force=True)
    assert store.points().count() == 21 and {r["oid"] for r in store.table("groups").collect()} == {0, 2}


def test_levels_and_pyramid(spark, store):
    with pytest.raises(StoreError):
        store.add_level(1, [3, 3, 3])
    store.build_pyramid([2], [0.5], storage="explicit")
    assert store.levels() == [0, 1] and store.ratios()[1] == [2, 2, 2] and store.transforms()[1]["translation"] == [5.0] * 3
    assert rows(store.table("objects").select("oid", "present")) == [(0, True), (1, True), (2, False), (3, False)]
    assert sorted(r["oid"] for r in store.points(1).collect()) == [0, 1]
    assert {r["delta"] for r in store.table("links").collect()} == {1, -1}
    store.remove_level(1)
    assert store.levels() == [0] and store.table("vertices").filter("level = 1").count() == 0
    with pytest.raises(StoreError):
        store.remove_level(0)


def test_shards_headers_geometry(spark, store):
    store.shard(3)
    assert store.points().count() == 40 and store.shard_info().count() <= 3
    store.unshard()
    store.header("trk", {"voxel": [1, 1, 1]})
    assert GeometryStore.open(spark, store.path).header("trk") == {"voxel": [1, 1, 1]}
    store.remove_header("trk")
    with pytest.raises(StoreError):
        store.header("trk")
    store.add_geometry("mesh", vertices(spark, 2).withColumn("vid", F.col("vid") + 500))
    store.commit()
    assert store.table("vertices", "mesh").count() == 2 and store.info()["vertices"] == {0: 42}
    store.add_attribute("colour", spark.createDataFrame([(1, "red")], "vid bigint, colour string"))
    assert store.points(where="colour = 'red'").count() == 1


def test_metadata_rules():
    good = dict(chunk_shape=[10.0] * 3, bounds_min=[0.0] * 3, bounds_max=[1.0] * 3)
    assert Meta.from_json(Meta(**good).to_json()) == Meta(**good)
    for bad in (dict(version="0.6.0"), dict(chunk_shape=[10.0]), dict(chunk_shape=[0.0] * 3), dict(bin_shape=[3.0] * 3), dict(bounds_max=[-1.0] * 3), dict(geometry_types=["blob"]),
                dict(cross_level_storage="all"), dict(levels=[Level(0), Level(1)]), dict(levels=[Level(0, [10.0] * 3, 0)])):
        with pytest.raises(StoreError):
            Meta(**{**good, **bad}).check()
    assert ratio([5.0], [10.0]) == [2]


def test_streams(spark, store, tmp_path):
    src = str(tmp_path / "in")
    new = vertices(spark, 6).withColumn("vid", F.col("vid") + 200)
    new.write.parquet(src)
    for _ in range(2):
        append_stream(spark.readStream.schema(new.schema).parquet(src), store, str(tmp_path / "cp")).awaitTermination()
    assert GeometryStore.open(spark, store.path).points(where="vid >= 200").count() == 6
    append_stream(spark.readStream.schema(new.schema).parquet(src), store, str(tmp_path / "cp2")).awaitTermination()
    assert GeometryStore.open(spark, store.path).points(where="vid >= 200").count() == 12  # another stream of the same rows
    ev = spark.createDataFrame([(1.0, 2.0, "2024-01-01 05:00:00"), (3.0, 2.0, "2024-01-01 09:00:00"), (30.0, 2.0, "2024-01-02 09:00:00")], "x double, y double, ts string")
    assert rows(windowed_cells(ev, 10.0).select("cx", "n")) == [(0, 2), (3, 1)]
