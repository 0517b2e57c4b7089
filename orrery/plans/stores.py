"""Queries that write a store and read it back, and their SQL over the tables that were written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.plans import geometry, staging
from orrery.plans.geometry import _BOX, _EDGES, _LIVE, _MESH, w
from orrery.sources.store import GeometryStore

QUERIES: dict = {}
SQL: dict[str, str] = {}
BOX = ([-100, -200, -150], [250, 150, 300])


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _store(spark: SparkSession, chunk: list[float]) -> GeometryStore:
    n = len(chunk)
    return GeometryStore.create(spark, staging.new_path(spark, "store"), chunk, ([0.0] * n, [1.0] * n), axes=list("xyz"[:n]))


def _flat(p: DataFrame) -> DataFrame:
    """Vertices of datasets of two axes lie at z = 0."""
    return p.withColumn("z", F.coalesce("z", F.lit(0.0)))


_ENDS = "e AS (SELECT link_id, a.x AS x0, a.y AS y0, coalesce(a.z, 0) AS z0, b.x AS x1, b.y AS y1, coalesce(b.z, 0) AS z1 FROM edges JOIN placed a ON src = a.vid JOIN placed b ON dst = b.vid)"
_IN = "x{i} BETWEEN -100 AND 250 AND y{i} BETWEEN -200 AND 150 AND z{i} BETWEEN -150 AND 300"


@query(w(_LIVE, _EDGES, _ENDS) + f"SELECT link_id AS line_id, x0, y0, z0, x1, y1, z1 FROM e WHERE ({_IN.format(i=0)}) OR ({_IN.format(i=1)})")
def store_lines(spark, d):
    """Edges as segments."""
    p = _flat(geometry._placed(spark, d))
    end = lambda e, c: p.select(F.col("vid").alias(c), *[F.col(a).alias(f"{a}{e}") for a in "xyz"])
    e = geometry._edges(spark, d).select(F.col("link_id").alias("line_id"), "src", "dst").join(end(0, "src"), "src").join(end(1, "dst"), "dst").drop("src", "dst")
    s = _store(spark, [200.0] * 3)
    s.write_lines(e, "expand")
    s.commit()
    return s.read_lines(bbox=BOX)


@query(w(_LIVE) + f"""SELECT oid * 1000 + dataset_id * 10 + level AS oid, CAST(0 AS BIGINT) AS part, CAST(count(*) AS INT) AS n, arg_min(x, ord) AS x_first, arg_max(x, ord) AS x_last FROM lines
    SEMI JOIN (SELECT dataset_id, level, oid FROM lines WHERE {_BOX.replace('z ', 'coalesce(z, 0) ')}) USING (dataset_id, level, oid) GROUP BY 1""")
def store_polylines(spark, d):
    l = _flat(geometry._lines(spark, d))
    s = _store(spark, [200.0] * 3)
    s.write_polylines(l.select("vid", (F.col("oid") * 1000 + F.col("dataset_id") * 10 + F.col("level")).alias("oid"), F.col("ord").alias("seq"), "x", "y", "z"), "expand")
    s.commit()
    r = s.read_polylines(bbox=BOX)
    return r.select("oid", "part", F.size("positions").alias("n"), F.get(F.get("positions", F.lit(0)), F.lit(0)).alias("x_first"), F.get(F.element_at("positions", -1), F.lit(0)).alias("x_last"))


@query(w(_LIVE, _EDGES, f"k AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS i FROM placed WHERE {_BOX.replace('z ', 'coalesce(z, 0) ')})") + "SELECT link_id, a.i AS src_idx, b.i AS dst_idx FROM edges JOIN k a ON a.vid = src JOIN k b ON b.vid = dst")
def store_graph(spark, d):
    p = _flat(geometry._placed(spark, d)).select("vid", "x", "y", "z")
    e = geometry._edges(spark, d).select("link_id", F.col("src").alias("src_vid"), F.col("dst").alias("dst_vid"), "weight")
    for c in ("src_vid", "dst_vid"):  # a store refuses edges whose ends it does not hold
        e = e.join(p.select(F.col("vid").alias(c)), c, "left_semi")
    s = _store(spark, [200.0] * 3)
    s.write_graph(p, e, "expand")
    s.commit()
    return s.read_graph(bbox=BOX)[1].select("link_id", "src_idx", "dst_idx")


@query(w(_MESH, "k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM grid WHERE x BETWEEN 5 AND 30 AND y BETWEEN 3 AND 25)") + """
    SELECT face_id, array_to_string(list(i ORDER BY pos), ',') AS corners FROM corners JOIN k USING (id) GROUP BY 1 HAVING count(*) = 3""")
def store_mesh(spark, d):
    nodes, faces = geometry._mesh(spark, d)
    s = _store(spark, [10.0, 10.0])
    s.write_mesh(nodes.select(F.col("id").alias("vid"), F.col("x").cast("double"), F.col("y").cast("double")), faces, "expand")
    s.commit()
    return s.read_mesh(bbox=([5, 3], [30, 25]))[1].select("face_id", F.array_join("corners", ",").alias("corners"))


@query(w(_LIVE) + """SELECT coalesce(g, -1) AS prefix, count(*) AS n, count(DISTINCT vid) AS n_vids FROM lines
    LEFT JOIN (SELECT oid, max(gid) AS g FROM groupings WHERE oid IS NOT NULL GROUP BY 1) USING (oid) GROUP BY 1""")
def store_rechunk(spark, d):
    """Vertices of objects in a store whose grid is led by the object's group; groups go by oid alone here."""
    l = _flat(geometry._lines(spark, d))
    s = _store(spark, [200.0] * 3)
    s.write_polylines(l.select("vid", "oid", F.col("ord").alias("seq"), "x", "y", "z"), "expand", groups=geometry.table(spark, d, "groupings").filter("oid IS NOT NULL").select("gid", "oid"))
    s.commit()
    new = s.rechunk(staging.new_path(spark, "rechunked"), "group")
    return new.table("vertices").groupBy("prefix").agg(F.count("*").alias("n"), F.count_distinct("vid").alias("n_vids"))


@query(w(_LIVE) + """SELECT CAST(floor(x / 200) AS BIGINT) AS cx, CAST(floor(y / 200) AS BIGINT) AS cy, CAST(floor(z / 200) AS BIGINT) AS cz,
    ((floor(x / 50)::BIGINT % 4 + 4) % 4 * 4 + (floor(y / 50)::BIGINT % 4 + 4) % 4) * 4 + (floor(z / 50)::BIGINT % 4 + 4) % 4 AS fragment, count(*) AS n
    FROM (SELECT x, y, coalesce(z, 0) AS z FROM placed) GROUP BY ALL""")
def store_rebin(spark, d):
    s = _store(spark, [200.0] * 3)
    s.write_points(_flat(geometry._placed(spark, d)).select("vid", "x", "y", "z"), "expand")
    s.commit()
    s.rebin([50.0] * 3)
    return s.table("vertices").groupBy("cx", "cy", "cz", "fragment").agg(F.count("*").alias("n"))


@query(w(_LIVE, """m AS (SELECT floor(x / 100) AS i, floor(y / 100) AS j, floor(z / 100) AS k, min(vid) AS vid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM (SELECT vid, x, y, coalesce(z, 0) AS z FROM placed) GROUP BY 1, 2, 3)""",
         "up1 AS (SELECT p.vid AS src_vid, m.vid AS dst_vid FROM (SELECT vid, x, y, coalesce(z, 0) AS z FROM placed) p JOIN m ON floor(p.x / 100) = i AND floor(p.y / 100) = j AND floor(p.z / 100) = k)",
         "m2 AS (SELECT floor(x / 200) AS i, floor(y / 200) AS j, floor(z / 200) AS k, min(vid) AS vid FROM m GROUP BY 1, 2, 3)",
         "up2 AS (SELECT m.vid AS src_vid, m2.vid AS dst_vid FROM m JOIN m2 ON floor(m.x / 200) = m2.i AND floor(m.y / 200) = m2.j AND floor(m.z / 200) = m2.k)") + """
    SELECT 0 AS level, 1 AS delta, src_vid, dst_vid FROM up1 UNION ALL SELECT 1, 1, src_vid, dst_vid FROM up2
    UNION ALL SELECT 0, 2, a.src_vid, b.dst_vid FROM up1 a JOIN up2 b ON b.src_vid = a.dst_vid""")
def store_pyramid(spark, d):
    """Links of a pyramid of two levels over a cloud without objects, over one and two levels."""
    s = GeometryStore.create(spark, staging.new_path(spark, "store"), [200.0] * 3, ([0.0] * 3, [1.0] * 3), bin_shape=[50.0] * 3)
    s.write_points(_flat(geometry._placed(spark, d)).select("vid", "x", "y", "z"), "expand")
    s.commit()
    s.build_pyramid([2, 4], storage="implicit", depth=-1)
    return s.table("links").select("level", "delta", "src_vid", "dst_vid")
