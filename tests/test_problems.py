import datetime as dt
import random

from conftest import rows

from orrery.operators import cells, compaction, references, skew
from pyspark.sql import functions as F

V = "dataset_id int, level int, vid bigint, oid bigint, seq int, x float, y float, z float, fragment bigint, intensity float, category string, file_id bigint, written_at timestamp_ntz, deleted_at timestamp_ntz"
ROOT = "dataset_id int, ndim int, chunk_shape array<double>, name string"
DAY = dt.datetime(2024, 1, 1)


def vertex(vid, x=0.0, y=0.0, z=0.0, ds=1, level=0, frag=0, file=1, day=0, deleted=None, oid=None):
    return (ds, level, vid, oid, None, x, y, z, frag, None, None, file, DAY + dt.timedelta(days=day), deleted)


def root(spark):
    return spark.createDataFrame([(1, 3, [10.0, 10.0, 10.0], "a"), (3, 2, [5.0, 5.0], "flat")], ROOT)


def test_pack_spreads_a_hot_key():
    plan = skew.pack({7: 900}, [50, 50, 0], 4)
    assert len(plan.heavy[7]) >= 12 and set(plan.heavy[7]) == {0, 1, 2, 3} and len(plan.light) == 3
    load = [0.0] * 4
    for t in plan.heavy[7]:
        load[t] += 900 / len(plan.heavy[7])
    for t, n in zip(plan.light, (50, 50, 0)):
        load[t] += n
    assert max(load) <= 1.3 * min(load)
    assert skew.pack({}, [0, 0], 2).total == 0


def test_hot_key_aggregate_and_join(spark):
    data = [(0 if i % 3 else i % 50, i, 1) for i in range(3000)]
    df = spark.createDataFrame(data, "k int, i int, clash int")
    plan = skew.estimate(df, ["k"], tasks=4)
    assert len(plan.heavy) == 1 and plan.total == 3000
    got = skew.aggregate(df, ["k"], {"n": F.count("*"), "m": F.max("i")}, {"n": F.sum("n"), "m": F.max("m")}, [F.col("i")], plan)
    want = rows(df.groupBy("k").agg(F.count("*"), F.max("i")))
    assert rows(got) == want
    right = spark.createDataFrame([(k, k * 2) for k in range(0, 60)] + [(0, 7)], "k int, w int")
    j = skew.join(df, right, ["k"], plan, [F.col("i")])
    assert rows(j.select("k", "i", "w")) == rows(df.join(right, "k").select("k", "i", "w"))
    spread = {r[0] for r in skew.sharded(df, ["k"], plan, [F.col("i")]).filter("k = 0").select("_task").distinct().collect()}
    assert len(spread) == 4
    assert rows(skew.sharded(df, ["k"], plan, [F.col("i")]).filter("k > 0 AND _shard > 0")) == []  # light keys stay whole
    none = df.withColumn("k", F.lit(None).cast("int"))
    assert rows(skew.aggregate(none, ["k"], {"n": F.count("*")}, {"n": F.sum("n")}, [F.col("i")])) == [(None, 3000)]


def test_cells(spark):
    v = [vertex(1, 0.0, 0.0, 0.0), vertex(2, 9.9, 0.0, -0.1), vertex(3, 10.0, 0.0, 0.0), vertex(4, None), vertex(5, float("nan")), vertex(6, float("inf")),
         vertex(7, 1.0, 1.0, float("nan"), ds=3), vertex(8, -0.0, 4.0, None, ds=3), vertex(9, ds=99), vertex(10, level=1), vertex(1, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(v, V).withColumn("n", F.lit("clash"))
    got = {(r["dataset_id"], r["chunk_key"]): r for r in cells.cell_stats(df, root(spark)).collect()}
    assert {k: r["n"] for k, r in got.items()} == {(1, "0.0.0"): 2, (1, "0.0.-1"): 1, (1, "1.0.0"): 1, (3, "0.0"): 2}
    assert got[3, "0.0"]["min_z"] is None and got[3, "0.0"]["centre_y"] == 2.5 and abs(got[3, "0.0"]["radius"] - 2.5**0.5 * 1.0) < 0.3
    assert rows(cells.hot_cells(df, root(spark), 34)) == []
    assert rows(cells.hot_cells(df, root(spark), 33)) == [(1, "0.0.0"), (3, "0.0")]
    assert rows(cells.hot_cells(df.limit(0), root(spark))) == [] and rows(cells.cell_stats(df.limit(0), root(spark))) == []


def test_compaction(spark, tmp_path):
    v = [vertex(i, float(i), file=1 + i // 3) for i in range(12)] + [vertex(0, 0.0, file=3), vertex(5, 5.0, file=2), vertex(11, 11.0, file=9)]
    df = spark.createDataFrame(v, V)
    index = [(1, 0, 1, 48, 3), (1, 0, 1, 48, 3), (1, 0, 2, None, 4), (1, 0, 3, 48, None), (1, 0, 4, 48, 5), (1, 0, 7, 10, 0), (1, 0, 8, 10, 2)]
    s = spark.createDataFrame(index, "dataset_id int, level int, file_id bigint, nbytes bigint, n_records int")
    assert rows(compaction.found(df, s).select("file_id", "issue")) == [(3, "repeat"), (4, "count"), (7, "empty"), (8, "empty"), (9, "repeat"), (9, "unlisted")]
    plan = {r["file_id"]: r for r in compaction.compaction_plan(df, s, 100).collect()}
    assert sorted(plan) == [1, 2, 3, 4, 9] and sum(r["keep_rows"] for r in plan.values()) == 12
    assert [plan[f]["group_no"] for f in (1, 2, 3, 4, 9)] == [0, 0, 1, 1, 2]
    out = rows(compaction.compact(df, s, str(tmp_path / "out"), 100))
    assert all(r[4] == r[5] for r in out) and sum(r[5] for r in out) == 12 and sum(r[3] for r in out) == 15
    assert spark.read.parquet(str(tmp_path / "out")).filter("vid = 0").select("file_id").collect()[0][0] == 1
    assert rows(compaction.found(df.limit(0), s.limit(0))) == []
    assert rows(compaction.compact(df.limit(0), s.limit(0), str(tmp_path / "none"))) == []


def test_compaction_loses_no_row_without_vid_or_file(spark, tmp_path):
    v = [vertex(1, file=1), vertex(2, file=1), vertex(None, file=1), vertex(None, file=1), vertex(1, file=None), vertex(None, file=None)]
    v += [vertex(100 + i, float(i), file=None) for i in range(40)] + [vertex(100, 0.0, file=None)]
    df = spark.createDataFrame(v, V).withColumn("group", F.lit("clash"))
    s = spark.createDataFrame([(1, 0, 1, 48, 4)], "dataset_id int, level int, file_id bigint, nbytes bigint, n_records int")
    out = rows(compaction.compact(df, s, str(tmp_path / "out"), 100))
    assert all(r[4] == r[5] for r in out) and len(out) > 3 and sum(r[3] for r in out) == len(v)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.filter("vid IS NULL").count() == 3 and got.filter("vid IS NOT NULL").count() == 42 == got.select("vid").distinct().count() - 1
    assert rows(compaction.found(df, s).select("file_id", "issue")) == []


def test_plan_blocks(spark):
    m = spark.createDataFrame([(f, 1, 0, 1, True, 1, 1, 10 + f % 7) for f in range(0, 20000, 13)], "file_id bigint, dataset_id int, level int, n_rows bigint, listed boolean, lo int, hi int, bytes bigint")
    got, cum = {r["file_id"]: r["group_no"] for r in compaction.plan_groups(m, 500).collect()}, 0
    for f in range(0, 20000, 13):
        assert got[f] == cum // 500
        cum += 10 + f % 7


def test_references(spark):
    r = random.Random(5)
    v = []
    for vid in [*range(1, 60), *range(100, 140), 65535, 65536, 65537]:
        for _ in range(r.choice([1, 1, 2])):
            v.append(vertex(vid, 1.0, level=vid % 2, frag=vid % 9, day=r.randrange(40), deleted=DAY if r.random() < 0.2 else None))
    v += [vertex(500, None, frag=77)]
    df = spark.createDataFrame(v, V)
    objs = [(i, 1, 0, i // 2, [("0.0.0", r.randrange(12)), ("0.0.0", None), (None, 3), ("x", 1), ("0.0.0", 77)], DAY + dt.timedelta(days=20), DAY if i % 5 == 0 else None) for i in range(20)]
    objs += [(90, 1, 0, 3, None, DAY, None), (91, 1, 0, 4, [], DAY, None), objs[2]]
    o = spark.createDataFrame(objs, "manifest_id bigint, dataset_id int, level int, oid bigint, manifest array<struct<chunk_key string, fragment bigint>>, written_at timestamp_ntz, deleted_at timestamp_ntz")
    links = [(i, 1 if i % 11 else None, r.choice([0, 1]), r.choice([-1, 0, 1]), r.choice([5, 7, -1, 65536, 200, r.randrange(150)]), r.choice([None, 65535, r.randrange(150)]), DAY + dt.timedelta(days=r.randrange(40))) for i in range(300)]
    l = spark.createDataFrame(links + links[:30], "link_id bigint, dataset_id int, level int, delta int, src_vid bigint, dst_vid bigint, written_at timestamp_ntz")
    groups = [(i, 1, 1, r.choice([None, -1, i % 14]), DAY + dt.timedelta(days=i)) for i in range(60)]
    g = spark.createDataFrame(groups, "member_id bigint, dataset_id int, gid bigint, oid bigint, written_at timestamp_ntz")

    def judge(targets, at):
        if not targets:
            return "missing"
        alive = [w for w, d in targets if d is None]
        return "deleted" if not alive else "late" if min(alive) > at else None

    want = set()
    for m in objs:
        for pos, (ck, fr) in enumerate(m[4] or []):
            if ck is not None and fr is not None:
                t = [(x[12], x[13]) for x in v if x[0] == m[1] and x[1] == m[2] and x[8] == fr and ck == "0.0.0" and x[5] is not None]
                want.add(("object_index", m[0], pos, judge(t, m[5]), "2024-01"))
    for k in links:
        for pos, (vid, lev) in enumerate(((k[4], k[2]), (k[5], k[2] + k[3]))):
            if vid is not None:
                t = [(x[12], x[13]) for x in v if x[0] == k[1] and x[1] == lev and x[2] == vid]
                want.add(("cross_chunk_links", k[0], pos, judge(t, k[6]), k[6].strftime("%Y-%m")))
    for k in groups:
        if k[3] is not None:
            t = [(x[5], x[6]) for x in objs if x[1] == k[1] and x[3] == k[3]]
            want.add(("groupings", k[0], 0, judge(t, k[4]), k[4].strftime("%Y-%m")))
    got = references.geometry_broken(df, root(spark), o, l, g)
    assert rows(got) == sorted((w for w in want if w[3]), key=repr)
    empty = references.geometry_broken(df.limit(0), root(spark), o.limit(0), l.limit(0), g.limit(0))
    assert rows(empty) == []
