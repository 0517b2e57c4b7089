"""Plans that hold on large tables: no work that grows with the data in one task, in too many tasks, or on the driver."""

from conftest import rows
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from orrery.operators import points
from orrery.plans import geometry
from orrery.sources.store import GeometryStore

_PLACE = "array<struct<chunk_key:string,fragment:bigint>>"


def test_slots_far_apart_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(points, "SLOTS", 4)
    monkeypatch.setattr(points, "TASK_SLOTS", 16, raising=False)
    e = [("0.0", 1)]
    data = [(1, 0, -9, e), (1, 0, -9, e * 3), (1, 0, 3, []), (1, 0, 4, e), (1, 0, 70, None), (1, 1, 900, e), (1, 0, None, e), (2, 0, 7, e * 2)]
    slots = points.dense_slots(spark.createDataFrame(data, f"dataset_id int, level int, oid bigint, manifest {_PLACE}"))
    have = {(1, -9): 3, (1, 3): 0, (1, 4): 1, (1, 70): 0, (2, 7): 2}
    assert rows(slots) == sorted([(d, o, (d, o) in have, have.get((d, o), 0)) for d, o in [(1, o) for o in range(-9, 71)] + [(2, 7)]], key=repr)
    assert "Join" not in slots._jdf.queryExecution().optimizedPlan().toString()  # slots stay where they open out
    assert slots.rdd.getNumPartitions() >= 6  # 81 slots, 16 a task
    assert slots.filter("NOT present").groupBy(F.spark_partition_id()).count().count() > 1


def test_nodes_and_faces_of_a_mesh_are_not_broadcast(spark, tmp_path, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    tested, empty = [], DataFrame.isEmpty
    monkeypatch.setattr(DataFrame, "isEmpty", lambda df: tested.append(plan(df)) or empty(df))
    spark.range(2000).select(F.col("id").alias("p_partkey"), F.lit(1.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    nodes, faces = geometry._mesh(spark, str(tmp_path))
    s = GeometryStore.create(spark, f"file://{tmp_path}/s", [10.0, 10.0], ([0.0] * 2, [50.0] * 2), axes=["x", "y"])
    s.write_mesh(nodes.select(F.col("id").alias("vid"), F.col("x").cast("double"), F.col("y").cast("double")), faces)
    s.commit()
    out = s.read_mesh(bbox=([5, 3], [30, 25]))[1]
    assert out.count() == 2 * 25 * 22 and len(tested) == 2
    for p in [*tested, plan(out)]:
        assert not [j for j in p.splitlines() if "BroadcastHashJoin" in j and ("vid#" in j or "face_id#" in j or " [id#" in j)]


def test_rechunk_takes_its_tasks_from_the_files(spark, tmp_path, monkeypatch):
    ran = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    p = spark.range(30000).select(F.col("id").alias("vid"), (F.col("id") % 300).alias("oid"), F.col("id").alias("seq"), *[F.rand(i).alias(a) for i, a in enumerate("xyz")])
    s = GeometryStore.create(spark, f"file://{tmp_path}/s", [10.0] * 3, ([0.0] * 3, [0.5] * 3))
    s.write_polylines(p.mapInArrow(seen, p.schema), "expand", groups=spark.range(6000).select((F.col("id") % 7).alias("gid"), (F.col("id") % 200).alias("oid")))
    s.commit()
    assert ran.value == 30000 and min(s.meta.bounds_max) > 0.9 and s.objects().count() == 300  # the plan behind the rows ran once
    tasks, ranges = [], DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda df, n, *cols: tasks.append(n) or ranges(df, min(n, 50), *cols))
    new = s.rechunk(f"file://{tmp_path}/t", "group")
    assert len(tasks) == 1 and tasks[0] <= 50
    last = {o: max(i % 7 for i in range(6000) if i % 200 == o) for o in range(200)}
    want = {}
    for i in range(30000):
        want[last.get(i % 300, -1)] = want.get(last.get(i % 300, -1), 0) + 1
    assert rows(new.table("vertices").groupBy("prefix").count()) == sorted(want.items(), key=repr)
