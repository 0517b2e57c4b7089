"""Queries over the geometry tables and their SQL: one per operator of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import grid
from orrery.operators import coarsen, encode, graphs, hierarchy, parametric, points, polylines, rechunk, select, validate
from orrery.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LIVE = """
  live AS (SELECT vid, min(dataset_id) AS dataset_id, min(level) AS level, min(oid) AS oid, min(seq) AS seq, min(x) AS x, min(y) AS y, min(z) AS z,
                  min(fragment) AS fragment, min(intensity) AS intensity, min(category) AS category
           FROM vertices WHERE deleted_at IS NULL AND vid IS NOT NULL GROUP BY vid),
  placed AS (SELECT vid, dataset_id, level, oid, seq, CAST(x AS DOUBLE) + 0.0 AS x, CAST(y AS DOUBLE) + 0.0 AS y, CASE WHEN ndim > 2 THEN CAST(z AS DOUBLE) + 0.0 END AS z, fragment,
                    intensity, category, ndim, chunk_shape, bounds_min, bounds_max,
                    TRY_CAST(floor(CAST(x AS DOUBLE) / chunk_shape[1]) AS BIGINT) AS cx, TRY_CAST(floor(CAST(y AS DOUBLE) / chunk_shape[2]) AS BIGINT) AS cy,
                    CASE WHEN ndim > 2 THEN TRY_CAST(floor(CAST(z AS DOUBLE) / chunk_shape[3]) AS BIGINT) END AS cz, concat_ws('.', cx, cy, cz) AS chunk_key
             FROM live JOIN root_metadata USING (dataset_id)
             WHERE x IS NOT NULL AND y IS NOT NULL AND isfinite(x) AND isfinite(y) AND (ndim = 2 OR (z IS NOT NULL AND isfinite(z)))),
  lines AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, level, oid ORDER BY seq NULLS LAST, vid) - 1 AS ord FROM placed WHERE oid IS NOT NULL)
"""
_RUNS = """
  flagged AS (SELECT *, sum(CASE WHEN ord > 0 AND cx IS NOT DISTINCT FROM pcx AND cy IS NOT DISTINCT FROM pcy AND cz IS NOT DISTINCT FROM pcz THEN 0 ELSE 1 END)
                        OVER (PARTITION BY dataset_id, level, oid ORDER BY ord) - 1 AS run
              FROM (SELECT *, lag(cx) OVER w AS pcx, lag(cy) OVER w AS pcy, lag(cz) OVER w AS pcz FROM lines WINDOW w AS (PARTITION BY dataset_id, level, oid ORDER BY ord))),
  runs AS (SELECT dataset_id, level, oid, CAST(run AS BIGINT) AS run, chunk_key, min(ord) AS first_ord, max(ord) AS last_ord, arg_min(vid, ord) AS first_vid, arg_max(vid, ord) AS last_vid
           FROM flagged GROUP BY ALL)
"""
_STEPS = """
  steps AS (SELECT dataset_id, level, oid, sqrt(coalesce(power(x - lag(x) OVER w, 2), 0) + coalesce(power(y - lag(y) OVER w, 2), 0) + coalesce(power(z - lag(z) OVER w, 2), 0)) AS step
            FROM lines WINDOW w AS (PARTITION BY dataset_id, level, oid ORDER BY ord)),
  lens AS (SELECT dataset_id, level, oid, count(*) AS n, sum(step) AS length FROM steps GROUP BY ALL)
"""
_BINS = """
  binned AS (SELECT *, CAST(floor(x / (chunk_shape[1] * {f})) AS BIGINT) AS bi, CAST(floor(y / (chunk_shape[2] * {f})) AS BIGINT) AS bj,
                    CASE WHEN ndim > 2 THEN CAST(floor(z / (chunk_shape[3] * {f})) AS BIGINT) END AS bk FROM placed)
"""


def w(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "vertices"), table(spark, d, "root_metadata")


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return points.placed(*_tables(spark, d))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return polylines.ordered(_placed(spark, d))


def _binned(spark: SparkSession, d: str, f: float) -> DataFrame:
    return coarsen.with_bins(_placed(spark, d), table(spark, d, "root_metadata"), f)


# ---- grid

@query(w(_LIVE) + "SELECT dataset_id, level, chunk_key, count(*) AS n FROM placed GROUP BY ALL")
def cell_count(spark, d):
    return _placed(spark, d).groupBy(*points.CELL).agg(F.count("*").alias("n")).select("dataset_id", "level", points.key().alias("chunk_key"), "n")


@query(w(_LIVE, _BINS.format(f=0.25)) + "SELECT dataset_id, level, concat_ws('.', bi, bj, bk) AS bin_key, count(*) AS n FROM binned GROUP BY ALL")
def bin_count(spark, d):
    g = _binned(spark, d, 0.25).groupBy("dataset_id", "level", *coarsen.BIN).agg(F.count("*").alias("n"))
    return g.select("dataset_id", "level", grid.chunk_key([F.col(b) for b in coarsen.BIN]).alias("bin_key"), "n")


@query(w(_LIVE) + "SELECT dataset_id, level, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM placed GROUP BY ALL")
def bounds(spark, d):
    return _placed(spark, d).groupBy("dataset_id", "level").agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])


@query("""SELECT dataset_id, CAST(i - 1 AS INT) AS axis, CAST(greatest(1, ceil((bounds_max[i] - bounds_min[i]) / chunk_shape[i])) AS BIGINT) AS cells
    FROM (SELECT *, unnest(range(1, ndim + 1)) AS i FROM root_metadata WHERE bounds_max IS NOT NULL AND bounds_min IS NOT NULL)""")
def grid_shape(spark, d):
    return points.grid_shape(table(spark, d, "root_metadata"))


_BOX = "x BETWEEN -100 AND 250 AND y BETWEEN -200 AND 150 AND z BETWEEN -150 AND 300"


@query(w(_LIVE) + f"SELECT vid, dataset_id, level, x, y, z FROM placed WHERE {_BOX}")
def bbox_points(spark, d):
    return points.box(_placed(spark, d), [-100, -200, -150], [250, 150, 300]).select("vid", "dataset_id", "level", "x", "y", "z")


@query(w(_LIVE) + f"SELECT vid, dataset_id, level, chunk_key FROM placed WHERE x BETWEEN -100 AND 350 AND y BETWEEN -50 AND 350 AND z BETWEEN -100 AND 350")
def bbox_pruned(spark, d):
    size = table(spark, d, "root_metadata").select("dataset_id", *[F.get("chunk_shape", F.lit(i)).alias(f"s{i}") for i in range(3)])
    p = points.box(_placed(spark, d).join(size, "dataset_id"), [-100, -50, -100], [350, 350, 350], [F.col(f"s{i}") for i in range(3)])
    return p.select("vid", "dataset_id", "level", points.key().alias("chunk_key"))


@query("""SELECT dataset_id, cx, cy, cz FROM (SELECT dataset_id, unnest(range(CAST(floor(-75 / chunk_shape[1]) AS BIGINT), CAST(floor(125 / chunk_shape[1]) AS BIGINT) + 1)) AS cx, chunk_shape
    FROM root_metadata WHERE ndim = 3), LATERAL (SELECT unnest(range(CAST(floor(-75 / chunk_shape[2]) AS BIGINT), CAST(floor(125 / chunk_shape[2]) AS BIGINT) + 1)) AS cy),
    LATERAL (SELECT unnest(range(CAST(floor(-75 / chunk_shape[3]) AS BIGINT), CAST(floor(125 / chunk_shape[3]) AS BIGINT) + 1)) AS cz)""")
def bbox_cells(spark, d):
    b = table(spark, d, "root_metadata").filter("ndim = 3").withColumns({f"s{i}": F.get("chunk_shape", F.lit(i)) for i in range(3)})
    b = b.withColumns({"lo": F.array(*[F.lit(-75.0)] * 3), "hi": F.array(*[F.lit(125.0)] * 3)})
    return points.box_cells(b, ["s0", "s1", "s2"]).select("dataset_id", "cx", "cy", "cz")


@query(w(_LIVE, """boxes AS (SELECT dataset_id, i AS box_id, bounds_min[1] / 4 * i AS lx, bounds_min[2] / 4 * i AS ly, bounds_min[3] / 4 * i AS lz, bounds_max[1] / 4 * i AS hx, bounds_max[2] / 4 * i AS hy,
    bounds_max[3] / 4 * i AS hz FROM (SELECT *, unnest([1, 2, 3]) AS i FROM root_metadata WHERE ndim = 3 AND bounds_max IS NOT NULL))""") + """
    SELECT box_id, dataset_id, count(*) AS n FROM placed JOIN boxes USING (dataset_id) WHERE x BETWEEN lx AND hx AND y BETWEEN ly AND hy AND z BETWEEN lz AND hz GROUP BY ALL""")
def bbox_batch_join(spark, d):
    r = table(spark, d, "root_metadata").filter("ndim = 3 AND bounds_max IS NOT NULL").select("dataset_id", "bounds_min", "bounds_max", "chunk_shape", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("box_id"))
    part = lambda c: F.transform(c, lambda v: v / 4 * F.col("box_id"))
    boxes = r.select("box_id", "dataset_id", "chunk_shape", part("bounds_min").alias("lo"), part("bounds_max").alias("hi"))
    return points.in_boxes(_placed(spark, d), boxes).groupBy("box_id", "dataset_id").agg(F.count("*").alias("n"))


_MORTON = " | ".join(f"((((c{a} + 1048576) >> {k}) & 1) << {3 * k + i})" for k in range(21) for i, a in enumerate("xyz"))


_LEVEL_CELL = ["dataset_id", "level", "cx", "cy", "cz"]
_CELLS = "cells AS (SELECT DISTINCT dataset_id, level, cx, cy, cz FROM placed)"
_FRAG = "CASE WHEN bk IS NULL THEN (bi % 4 + 4) % 4 * 4 + (bj % 4 + 4) % 4 ELSE ((bi % 4 + 4) % 4 * 4 + (bj % 4 + 4) % 4) * 4 + (bk % 4 + 4) % 4 END"
_MORTON2 = " | ".join(f"((((c{a} + 1048576) >> {k}) & 1) << {2 * k + i})" for k in range(21) for i, a in enumerate("xy"))


def _cells(spark, d):
    return _placed(spark, d).select(*_LEVEL_CELL).distinct()


def _by_axes(rows: DataFrame, third: str, f) -> DataFrame:
    """f(rows, axes) of the rows of three axes and of those of two; columns that two axes lack are null."""
    return f(rows.filter(F.col(third).isNotNull()), "xyz").unionByName(f(rows.filter(F.col(third).isNull()), "xy"), allowMissingColumns=True)


@query(w(_LIVE, _CELLS) + """SELECT dataset_id, level, cx, cy, cz, cx + i AS nx, cy + j AS ny, cz + k AS nz FROM cells, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j),
    (SELECT unnest([-1, 0, 1]) AS k) WHERE NOT (i = 0 AND j = 0 AND k = 0) AND (cz IS NOT NULL OR k = 0)""")
def neighbours(spark, d):
    return _by_axes(_cells(spark, d), "cz", lambda c, axes: points.neighbours(c, axes=axes))


@query(w(_LIVE, _CELLS) + """SELECT a.dataset_id, a.level, a.cx, a.cy, a.cz, count(*) AS n FROM cells a JOIN cells b ON a.dataset_id = b.dataset_id AND a.level = b.level AND abs(a.cx - b.cx) <= 1
    AND abs(a.cy - b.cy) <= 1 AND coalesce(abs(a.cz - b.cz), 0) <= 1 AND NOT (a.cx = b.cx AND a.cy = b.cy AND a.cz IS NOT DISTINCT FROM b.cz) GROUP BY ALL""")
def neighbours_occupied(spark, d):
    found = _by_axes(_cells(spark, d), "cz", lambda c, axes: points.occupied_neighbours(c, axes=axes, keys=("dataset_id", "level")))
    return found.groupBy(*_LEVEL_CELL).agg(F.count("*").alias("n"))


def _coded(spark, d):
    return _by_axes(_cells(spark, d), "cz", lambda c, axes: c.withColumn("code", grid.morton([F.col(f"c{a}") for a in axes], offset=1 << 20)))


@query(w(_LIVE, _CELLS) + f"SELECT *, code >> 6 AS shard_id FROM (SELECT *, CASE WHEN cz IS NULL THEN {_MORTON2} ELSE {_MORTON} END AS code FROM cells)")
def morton(spark, d):
    return _coded(spark, d).withColumn("shard_id", F.call_function("div", F.col("code"), F.lit(64).cast("bigint")))


@query(w(_LIVE, _CELLS) + "SELECT * FROM cells")
def morton_roundtrip(spark, d):
    back = lambda c, axes: c.select("dataset_id", "level", *[(v - (1 << 20)).alias(f"c{a}") for v, a in zip(grid.unmorton(F.col("code"), len(axes)), axes)])
    return _by_axes(_coded(spark, d), "cz", back)


@query(w(_LIVE, _CELLS) + """SELECT DISTINCT dataset_id, level, axis, i AS ix, xor(i, i >> 1) AS code FROM (SELECT dataset_id, level, unnest([0, 1, 2]) AS axis, unnest([cx + 32768, cy + 32768, cz + 32768]) AS i FROM cells)
    WHERE i IS NOT NULL""")
def gray_code(spark, d):
    c = _cells(spark, d).select("dataset_id", "level", F.posexplode(F.array(*[F.col(f"c{a}") + 32768 for a in "xyz"])).alias("axis", "ix")).filter("ix IS NOT NULL").distinct()
    return c.withColumn("code", grid.gray(F.col("ix")))


def _frag(axes: str) -> Column:
    return grid.linear_fragment([F.col(b) for b in coarsen.BIN[: len(axes)]], [4] * len(axes))


@query(w(_LIVE, _BINS.format(f=0.25)) + f"""SELECT dataset_id, bi, bj, bk, CAST(floor(bi / 4.0) AS BIGINT) AS cx, CAST(floor(bj / 4.0) AS BIGINT) AS cy, CAST(floor(bk / 4.0) AS BIGINT) AS cz,
    {_FRAG} AS frag FROM binned GROUP BY ALL""")
def bins_to_chunk(spark, d):
    b = _binned(spark, d, 0.25).select("dataset_id", *coarsen.BIN).distinct()
    chunk = {f"c{a}": grid.bin_to_chunk(F.col(c), 4) for c, a in zip(coarsen.BIN, "xyz")}
    return _by_axes(b, "bk", lambda r, axes: r.withColumns(chunk | {"frag": _frag(axes)}))


@query(w(_LIVE, _BINS.format(f=0.25)) + f"""SELECT dataset_id, frag, CAST(floor(frag / CASE WHEN two THEN 4 ELSE 16 END) AS BIGINT) AS ix, CASE WHEN two THEN frag % 4 ELSE CAST(floor(frag / 4) % 4 AS BIGINT) END AS iy,
    CASE WHEN NOT two THEN frag % 4 END AS iz, count(*) AS n FROM (SELECT dataset_id, bk IS NULL AS two, {_FRAG} AS frag FROM binned) GROUP BY ALL""")
def fragment_index(spark, d):
    def index(b, axes):
        g = b.withColumn("frag", _frag(axes)).groupBy("dataset_id", "frag").agg(F.count("*").alias("n"))
        return g.withColumns({f"i{a}": c for a, c in zip(axes, grid.unlinear_fragment(F.col("frag"), [4] * len(axes)))})

    return _by_axes(_binned(spark, d, 0.25), "bk", index).select("dataset_id", "frag", "ix", "iy", "iz", "n")


@query(w(_LIVE) + """SELECT dataset_id, round(power(greatest(max(x) - min(x), 1e-9) * greatest(max(y) - min(y), 1e-9) * coalesce(greatest(CASE WHEN min(ndim) > 2 THEN max(z) - min(z) END, CASE WHEN min(ndim) > 2 THEN 1e-9 END), 1)
    / greatest(least(count(*) / 4.0, count(*)), 1), 1.0 / least(min(ndim), 3)), 4) AS bin_size FROM placed GROUP BY 1""")
def bin_estimate(spark, d):
    g = _placed(spark, d).groupBy("dataset_id").agg(F.count("*").alias("n"), *[(F.max(a) - F.min(a)).alias(f"s{a}") for a in "xyz"])
    size = lambda axes: F.round(coarsen.bin_estimate(F.col("n"), [F.col(f"s{a}") for a in axes], F.col("n") / 4), 4).alias("bin_size")
    return _by_axes(g, "sz", lambda r, axes: r.select("dataset_id", size(axes)))


def _hilbert_sql(order: int = 16) -> str:
    """CTEs h<order>..h0 that walk the curve of two axes bit by bit from cells u(.., x, y)."""
    out = [f"h{order} AS MATERIALIZED (SELECT *, CAST(0 AS BIGINT) AS code FROM u)"]
    for k in range(order - 1, -1, -1):
        low = (1 << k) - 1
        out.append(f"""h{k} AS MATERIALIZED (SELECT * EXCLUDE (rx, ry) REPLACE (code + {1 << 2 * k} * xor(3 * rx, ry) AS code, CASE WHEN ry = 1 THEN x & {low} WHEN rx = 1 THEN {low} - (y & {low}) ELSE y & {low} END AS x,
            CASE WHEN ry = 1 THEN y & {low} WHEN rx = 1 THEN {low} - (x & {low}) ELSE x & {low} END AS y) FROM (SELECT *, (x >> {k}) & 1 AS rx, (y >> {k}) & 1 AS ry FROM h{k + 1}))""")
    return ",".join(out)


_UPPER = ", ".join(f"CASE WHEN c{a} < 0 THEN c{a} + 65536 ELSE c{a} END AS {a}" for a in "xyz")
_GRAY3 = " | ".join(f"(((xor({a}, {a} >> 1) >> {k}) & 1) << {3 * k + i})" for k in range(16) for i, a in enumerate("xyz"))


@query(w(_LIVE, f"u AS (SELECT DISTINCT dataset_id, level, cx, cy, {_UPPER.rsplit(', ', 1)[0]} FROM placed)", _hilbert_sql()) + "SELECT dataset_id, level, cx, cy, code FROM h0")
def hilbert2d(spark, d):
    """Over the first two axes of all cells."""
    c = _cells(spark, d).select("dataset_id", "level", "cx", "cy").distinct()
    return c.withColumn("code", grid.hilbert([F.col("cx"), F.col("cy")]))


@query(w(_LIVE, f"u AS (SELECT DISTINCT dataset_id, level, cx, cy, cz, {_UPPER} FROM placed WHERE cz IS NOT NULL)") + f"SELECT dataset_id, level, cx, cy, cz, {_GRAY3} AS code, ({_GRAY3}) // 64 AS shard_id FROM u")
def hilbert3d(spark, d):
    """Datasets of three axes, as the curve is another one for two (``hilbert2d``)."""
    c, axes = _cells(spark, d).filter("cz IS NOT NULL"), [F.col(f"c{a}") for a in "xyz"]
    return c.withColumns({"code": grid.hilbert(axes), "shard_id": grid.shard_id(axes, "snake")})


@query(w(_LIVE, _CELLS) + "SELECT * FROM cells")
def hilbert_roundtrip(spark, d):
    def back(c, axes):
        coded = c.select("dataset_id", "level", grid.hilbert([F.col(f"c{a}") for a in axes]).alias("code"))
        up = coded.select("dataset_id", "level", *[v.alias(f"c{a}") for v, a in zip(grid.unhilbert(F.col("code"), len(axes)), axes)])
        return up.select("dataset_id", "level", *[F.when(F.col(f"c{a}") >= 32768, F.col(f"c{a}") - 65536).otherwise(F.col(f"c{a}")).alias(f"c{a}") for a in axes])

    return _by_axes(_cells(spark, d), "cz", back)


@query(w(_LIVE, _CELLS) + "SELECT dataset_id, level, cx, cy, cz, cx * 4 AS lo_x, cx * 4 + 3 AS hi_x, cy * 4 AS lo_y, cy * 4 + 3 AS hi_y, cz * 2 AS lo_z, cz * 2 + 1 AS hi_z FROM cells")
def chunk_bin_ranges(spark, d):
    ends = {f"{n}_{a}": e for a, k in (("x", 4), ("y", 4), ("z", 2)) for n, e in zip(("lo", "hi"), grid.chunk_bins(F.col(f"c{a}"), k))}
    return _cells(spark, d).withColumns(ends)


@query(w(_LIVE) + "SELECT vid, dataset_id, level, chunk_key, row_number() OVER (PARTITION BY dataset_id, level, chunk_key ORDER BY vid) - 1 AS local_idx FROM placed")
def local_index(spark, d):
    return points.local_index(_placed(spark, d)).select("vid", "dataset_id", "level", points.key().alias("chunk_key"), "local_idx")


@query(w(_LIVE) + """SELECT dataset_id, level, chunk_key, n, CAST(coalesce(sum(n) OVER (PARTITION BY dataset_id, level ORDER BY cx, cy, cz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row
    FROM (SELECT dataset_id, level, cx, cy, cz, chunk_key, count(*) AS n FROM placed GROUP BY ALL)""")
def chunk_offsets(spark, d):
    return points.cell_offsets(_placed(spark, d)).select("dataset_id", "level", points.key().alias("chunk_key"), "n", "first_row")


# ---- reads

@query(w(_LIVE) + "SELECT vid, dataset_id, oid FROM placed p WHERE EXISTS (SELECT 1 FROM groupings g WHERE g.dataset_id = p.dataset_id AND g.oid = p.oid AND gid IS NOT NULL)")
def read_by_group(spark, d):
    g = table(spark, d, "groupings").filter("gid IS NOT NULL AND oid IS NOT NULL").select("dataset_id", "oid").distinct()
    return points.read(*_tables(spark, d), g).select("vid", "dataset_id", "oid")


@query(w(_LIVE) + "SELECT dataset_id, level, oid, seq, vid, x, y, z FROM placed p WHERE EXISTS (SELECT 1 FROM object_index o WHERE o.dataset_id = p.dataset_id AND o.oid = p.oid AND o.deleted_at IS NULL)")
def read_by_object(spark, d):
    """The vertices of all objects that object_index holds and does not call deleted."""
    o = table(spark, d, "object_index").filter("deleted_at IS NULL AND oid IS NOT NULL").select("dataset_id", "oid").distinct()
    return points.read(*_tables(spark, d), o).select("dataset_id", "level", "oid", "seq", "vid", "x", "y", "z")


@query(w(_LIVE) + "SELECT vid, dataset_id, level, chunk_key FROM placed WHERE chunk_key IN ('0.0.0', '1.0.0', '-1.0.0', '0.0')")
def read_by_chunk(spark, d):
    return _placed(spark, d).withColumn("chunk_key", points.key()).filter(F.col("chunk_key").isin("0.0.0", "1.0.0", "-1.0.0", "0.0")).select("vid", "dataset_id", "level", "chunk_key")


_TIDY = "nullif(regexp_replace(lower(trim(category)), '\\s+', ' ', 'g'), '')"


@query(w(_LIVE) + f"SELECT vid, dataset_id, level FROM placed WHERE {_TIDY} = 'trunk'")
def attr_filter(spark, d):
    return points.read(*_tables(spark, d), points.clean_category(F.col("category")) == "trunk").select("vid", "dataset_id", "level")


@query(w(_LIVE) + f"""SELECT vid, coalesce(r, -1) AS code FROM live LEFT JOIN (SELECT {_TIDY} AS c, row_number() OVER (ORDER BY {_TIDY}) - 1 AS r FROM live WHERE {_TIDY} IS NOT NULL GROUP BY 1)
    ON c = {_TIDY}""")
def categorical(spark, d):
    v = points.live(table(spark, d, "vertices")).select("vid", points.clean_category(F.col("category")).alias("c"))
    return points.encode_categorical(v, "c").select("vid", "code")


@query(w(_LIVE) + f"SELECT vid, {_TIDY} AS c FROM live")
def categorical_roundtrip(spark, d):
    v = points.live(table(spark, d, "vertices")).select("vid", points.clean_category(F.col("category")).alias("c"))
    return points.decode_categorical(points.encode_categorical(v, "c").drop("c"), points.attribute_bins(v, "c"), "c").select("vid", "c")


@query(w(_LIVE) + f"SELECT {_TIDY} AS c, row_number() OVER (ORDER BY {_TIDY}) - 1 AS bin FROM live WHERE {_TIDY} IS NOT NULL GROUP BY 1")
def attr_bins(spark, d):
    return points.attribute_bins(points.live(table(spark, d, "vertices")).select(points.clean_category(F.col("category")).alias("c")), "c")


@query(w(_LIVE) + "SELECT dataset_id, oid, array_to_string(list_sort(list(DISTINCT CAST(level AS VARCHAR))), ',') AS levels FROM live WHERE oid IS NOT NULL GROUP BY ALL")
def object_levels(spark, d):
    return points.object_levels(points.live(table(spark, d, "vertices")))


@query(w(_LIVE) + """SELECT dataset_id, level, oid, CAST(row_number() OVER (PARTITION BY dataset_id, level, oid ORDER BY first_seq NULLS LAST, cx, cy, cz, fragment) - 1 AS INT) AS entry, chunk_key, fragment, n_vertices
    FROM (SELECT dataset_id, level, oid, cx, cy, cz, chunk_key, fragment, min(seq) AS first_seq, count(*) AS n_vertices FROM placed WHERE oid IS NOT NULL GROUP BY ALL)""")
def manifest(spark, d):
    return points.manifest(_placed(spark, d))


@query("""WITH h AS (SELECT dataset_id, oid, max(coalesce(len(manifest), 0)) AS n FROM object_index WHERE oid IS NOT NULL AND level = 0 GROUP BY ALL)
    SELECT s.dataset_id, s.oid, h.oid IS NOT NULL AS present, CAST(coalesce(n, 0) AS INT) AS n_fragments
    FROM (SELECT dataset_id, unnest(range(min(oid), max(oid) + 1)) AS oid FROM h GROUP BY dataset_id) s LEFT JOIN h USING (dataset_id, oid)""")
def dense_slots(spark, d):
    return points.dense_slots(table(spark, d, "object_index"))


@query("SELECT dataset_id, gid, count(*) AS n_members, array_to_string(list_sort(list(oid)), ',') AS oids FROM (SELECT DISTINCT dataset_id, gid, oid FROM groupings WHERE oid IS NOT NULL) GROUP BY ALL")
def group_members(spark, d):
    g = table(spark, d, "groupings").filter("oid IS NOT NULL").select("dataset_id", "gid", "oid").distinct()
    return g.groupBy("dataset_id", "gid").agg(F.count("*").alias("n_members"), F.array_join(F.array_sort(F.collect_list("oid")).cast("array<string>"), ",").alias("oids"))


@query("SELECT dataset_id, level, delta, count(DISTINCT link_id) AS n FROM cross_chunk_links GROUP BY ALL")
def link_deltas(spark, d):
    return table(spark, d, "cross_chunk_links").groupBy("dataset_id", "level", "delta").agg(F.count_distinct("link_id").alias("n"))


# ---- polylines and lines

@query(w(_LIVE, _RUNS) + "SELECT * FROM runs")
def split_runs(spark, d):
    r = polylines.split_runs(_lines(spark, d))
    return r.select(*polylines.OBJECT, "run", points.key().alias("chunk_key"), "first_ord", "last_ord", "first_vid", "last_vid")


@query(w(_LIVE, _RUNS) + "SELECT * FROM (SELECT dataset_id, level, oid, run, last_vid AS src_vid, lead(first_vid) OVER (PARTITION BY dataset_id, level, oid ORDER BY run) AS dst_vid FROM runs) WHERE dst_vid IS NOT NULL")
def cross_links(spark, d):
    return polylines.cross_links(polylines.split_runs(_lines(spark, d)))


@query(w(_LIVE, _STEPS) + "SELECT dataset_id, level, oid, n, round(length, 4) AS length FROM lens")
def polyline_length(spark, d):
    return polylines.lengths(_lines(spark, d)).withColumn("length", F.round("length", 4))


@query(w(_LIVE, _STEPS) + "SELECT dataset_id, level, oid FROM lens WHERE length BETWEEN 50 AND 500")
def length_filter(spark, d):
    return polylines.lengths(_lines(spark, d)).filter("length BETWEEN 50 AND 500").select(*polylines.OBJECT)


_MID = "mid AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY dataset_id, level, oid) AS n FROM lines) WHERE ord = floor(n / 2))"


@query(w(_LIVE, _MID) + "SELECT dataset_id, level, oid, n, vid, x, y, z FROM mid")
def midpoint(spark, d):
    return polylines.midpoints(_lines(spark, d)).drop("cx", "cy", "cz")


@query(w(_LIVE) + f"""SELECT dataset_id, level, oid, CAST(part AS BIGINT) AS part, count(*) AS n, arg_min(vid, ord) AS first_vid FROM (
    SELECT *, sum(CASE WHEN i AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_id, level, oid ORDER BY ord) - 1 AS part FROM (
      SELECT *, coalesce({_BOX}, false) AS i, lag(coalesce({_BOX}, false)) OVER (PARTITION BY dataset_id, level, oid ORDER BY ord) AS p FROM lines)) WHERE i GROUP BY ALL""")
def crop_runs(spark, d):
    return polylines.crop(_lines(spark, d), F.expr(_BOX))


@query(w(_LIVE) + f"SELECT dataset_id, level, oid, count(*) AS n FROM lines SEMI JOIN (SELECT dataset_id, level, oid FROM lines WHERE {_BOX}) USING (dataset_id, level, oid) GROUP BY ALL")
def polyline_bbox_exact(spark, d):
    return polylines.touching(_lines(spark, d), F.expr(_BOX)).groupBy(*polylines.OBJECT).agg(F.count("*").alias("n"))


_BOXCELL = " AND ".join(f"c{a} BETWEEN floor({lo} / s{i}) AND floor({hi} / s{i})" for i, (a, lo, hi) in enumerate((("x", -100, 250), ("y", -200, 150), ("z", -150, 300))))


@query(w(_LIVE, "sized AS (SELECT *, chunk_shape[1] AS s0, chunk_shape[2] AS s1, chunk_shape[3] AS s2 FROM lines)") + f"""SELECT dataset_id, level, oid, count(*) AS n FROM lines
    SEMI JOIN (SELECT dataset_id, level, oid FROM sized WHERE {_BOXCELL}) USING (dataset_id, level, oid) GROUP BY ALL""")
def polyline_bbox_cell(spark, d):
    root = table(spark, d, "root_metadata").select("dataset_id", *[F.get("chunk_shape", F.lit(i)).alias(f"s{i}") for i in range(3)])
    l = _lines(spark, d).join(root, "dataset_id")
    return polylines.touching(l, F.expr(_BOXCELL)).groupBy(*polylines.OBJECT).agg(F.count("*").alias("n"))


_SEGMENTS = """segs AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS x0, o_totalprice AS y0,
    date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS x1, l_extendedprice AS y1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _segments(spark, d):
    day = lambda c: F.datediff(F.col(c), F.lit("1992-01-01").cast("date"))
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day("o_orderdate").alias("x0"), F.col("o_totalprice").alias("y0"), day("l_shipdate").alias("x1"), F.col("l_extendedprice").alias("y1"))


@query(w(_SEGMENTS) + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(x0 AS INT) AS x0, CAST(x1 AS INT) AS x1 FROM segs WHERE (x0 BETWEEN 1200 AND 2000 AND y0 BETWEEN 10000 AND 90000) OR (x1 BETWEEN 1200 AND 2000 AND y1 BETWEEN 10000 AND 90000)")
def lines_bbox_any(spark, d):
    return polylines.segments_touching(_segments(spark, d), [1200, 10000], [2000, 90000]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x0", "x1")


@query(w(_SEGMENTS) + "SELECT floor(x0 / 100.0) = floor(x1 / 100.0) AND floor(y0 / 20000.0) = floor(y1 / 20000.0) AS same_cell, count(*) AS n FROM segs GROUP BY 1")
def lines_same_cell(spark, d):
    s = _segments(spark, d)
    same = (grid.cell(F.col("x0"), 100) == grid.cell(F.col("x1"), 100)) & (grid.cell(F.col("y0"), 20000) == grid.cell(F.col("y1"), 20000))
    return s.groupBy(same.alias("same_cell")).agg(F.count("*").alias("n"))


_PEUCKER = """
  ends AS (SELECT dataset_id, level, oid, max(ord) AS b FROM lines GROUP BY ALL),
  p AS (SELECT dataset_id, level, oid, vid, ord, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(z, 0) AS z FROM lines),
  seg AS (SELECT dataset_id, level, oid, CAST(0 AS BIGINT) AS a, b FROM ends
    UNION ALL
    SELECT dataset_id, level, oid, unnest([a, -best.k]) AS a, unnest([-best.k, b]) AS b FROM (
      SELECT s.dataset_id, s.level, s.oid, s.a, s.b, max(struct_pack(d := coalesce(sqrt(power(m.x - u.x - t * (v.x - u.x), 2) + power(m.y - u.y - t * (v.y - u.y), 2) + power(m.z - u.z - t * (v.z - u.z), 2)), 0), k := -m.ord)) AS best
      FROM seg s JOIN p u ON (u.dataset_id, u.level, u.oid, u.ord) = (s.dataset_id, s.level, s.oid, s.a) JOIN p v ON (v.dataset_id, v.level, v.oid, v.ord) = (s.dataset_id, s.level, s.oid, s.b)
      JOIN p m ON (m.dataset_id, m.level, m.oid) = (s.dataset_id, s.level, s.oid) AND m.ord > s.a AND m.ord < s.b,
      LATERAL (SELECT power(v.x - u.x, 2) + power(v.y - u.y, 2) + power(v.z - u.z, 2) AS size), LATERAL (SELECT CASE WHEN size > 0 THEN
        greatest(0, least(1, ((m.x - u.x) * (v.x - u.x) + (m.y - u.y) * (v.y - u.y) + (m.z - u.z) * (v.z - u.z)) / size)) ELSE 0 END AS t)
      GROUP BY ALL) WHERE best.d > 1.0)"""


@query("WITH RECURSIVE " + _LIVE + "," + _PEUCKER + """ SELECT DISTINCT p.dataset_id, p.level, p.oid, p.vid, p.ord FROM (SELECT dataset_id, level, oid, a AS ord FROM seg UNION SELECT dataset_id, level, oid, b FROM seg) k JOIN p USING (dataset_id, level, oid, ord)""")
def douglas_peucker(spark, d):
    return polylines.simplify(_lines(spark, d), 1.0)


# ---- graphs, meshes, trees

def _edges(spark, d):
    e = table(spark, d, "cross_chunk_links").filter("delta = 0 AND dst_vid IS NOT NULL")
    return e.groupBy("link_id").agg(*[F.min(c).alias(n) for c, n in (("dataset_id", "dataset_id"), ("level", "level"), ("src_vid", "src"), ("dst_vid", "dst"), ("weight", "weight"))])


_EDGES = """edges AS (SELECT link_id, min(dataset_id) AS dataset_id, min(level) AS level, min(src_vid) AS src, min(dst_vid) AS dst, min(weight) AS weight
    FROM cross_chunk_links WHERE delta = 0 AND dst_vid IS NOT NULL GROUP BY 1)"""


@query(w(_LIVE, _EDGES) + "SELECT link_id, a.chunk_key AS src_cell, b.chunk_key AS dst_cell, a.chunk_key = b.chunk_key AS same_cell FROM edges JOIN placed a ON src = a.vid JOIN placed b ON dst = b.vid")
def edge_partition(spark, d):
    nodes = _placed(spark, d).select(F.col("vid").alias("id"), points.key().alias("cell"))
    return graphs.edge_cells(_edges(spark, d).select("link_id", "src", "dst"), nodes).select("link_id", "src_cell", "dst_cell", "same_cell")


_KEPT = f"kept AS (SELECT dataset_id, level, vid, row_number() OVER (PARTITION BY dataset_id, level ORDER BY vid) - 1 AS i FROM placed WHERE {_BOX})"


@query(w(_LIVE, _EDGES, _KEPT) + "SELECT link_id, dataset_id, level, a.i AS src_idx, b.i AS dst_idx FROM edges e JOIN kept a USING (dataset_id, level) JOIN kept b USING (dataset_id, level) WHERE a.vid = src AND b.vid = dst")
def subgraph_bbox(spark, d):
    nodes = _placed(spark, d).withColumnRenamed("vid", "id")
    return graphs.subgraph(nodes, _edges(spark, d), F.expr(_BOX), ["dataset_id", "level"]).select("link_id", "dataset_id", "level", "src_idx", "dst_idx")


_MESH = """grid AS (SELECT p_partkey AS id, p_partkey % 50 AS x, CAST(floor(p_partkey / 50) AS BIGINT) AS y, p_retailprice AS z FROM part),
  faces AS (SELECT a.id * 2 + k AS face_id, CASE WHEN k = 0 THEN [a.id, a.id + 1, a.id + 50] ELSE [a.id + 1, a.id + 51, a.id + 50] END AS vids
            FROM grid a, (SELECT unnest([0, 1]) AS k) WHERE x < 49 AND EXISTS (SELECT 1 FROM grid b WHERE b.id = a.id + 51)),
  corners AS (SELECT face_id, unnest(vids) AS id, unnest(range(3)) AS pos FROM faces)"""


def _mesh(spark, d):
    p = table(spark, d, "part")
    nodes = p.select(F.col("p_partkey").cast("bigint").alias("id"), F.pmod("p_partkey", F.lit(50)).cast("bigint").alias("x"), F.floor(F.col("p_partkey") / 50).alias("y"), F.col("p_retailprice").alias("z"))
    quad = nodes.filter("x < 49").join(nodes.select((F.col("id") - 51).alias("id")).hint("merge"), "id", "left_semi").select("id")
    a = F.col("id")
    tri = lambda k, *v: F.struct((a * 2 + k).alias("face_id"), F.array(*v).alias("vids"))
    faces = quad.select(F.inline(F.array(tri(0, a, a + 1, a + 50), tri(1, a + 1, a + 51, a + 50))))
    return nodes, faces


@query(w(_MESH) + """SELECT face_id, count(*) AS corners, count(DISTINCT c) AS cells, count(DISTINCT c) = 1 AS same_cell FROM corners JOIN (SELECT id, concat_ws('.', CAST(floor(x / 10.0) AS BIGINT), CAST(floor(y / 10.0) AS BIGINT)) AS c FROM grid) USING (id) GROUP BY 1""")
def face_partition(spark, d):
    nodes, faces = _mesh(spark, d)
    return graphs.face_cells(faces, nodes.select("id", grid.chunk_key([grid.cell(F.col("x"), 10), grid.cell(F.col("y"), 10)]).alias("cell")))


@query(w(_MESH) + "SELECT face_id, CAST(3 AS INT) AS width FROM corners JOIN grid USING (id) WHERE x BETWEEN 5 AND 30 AND y BETWEEN 3 AND 25 GROUP BY 1 HAVING count(*) = 3")
def mesh_bbox(spark, d):
    nodes, faces = _mesh(spark, d)
    return graphs.faces_within(faces, nodes, F.expr("x BETWEEN 5 AND 30 AND y BETWEEN 3 AND 25"))


@query(w(_MESH) + """SELECT array_to_string(c, ',') AS corners, min(face_id) AS face_id FROM (SELECT face_id, list_sort(list(m)) AS c, count(DISTINCT m) AS k FROM corners JOIN (SELECT id, concat_ws('.', CAST(floor(x / 2.5) AS BIGINT), CAST(floor(y / 2.5) AS BIGINT)) AS m FROM grid) USING (id)
    GROUP BY 1) WHERE k = 3 GROUP BY 1""")
def mesh_cluster(spark, d):
    nodes, faces = _mesh(spark, d)
    return graphs.cluster_faces(faces, graphs.meta_by_bin(nodes, 2.5, "xy")).select(F.array_join("corners", ",").alias("corners"), "face_id")


@query(w(_LIVE, _EDGES) + """SELECT least(a, b) AS meta_a, greatest(a, b) AS meta_b, count(*) AS n_edges, round(sum(w), 3) AS weight FROM (
    SELECT m.k AS a, n.k AS b, CAST(coalesce(CASE WHEN NOT isnan(weight) THEN weight END, 1) AS DOUBLE) AS w FROM edges JOIN (SELECT vid, concat_ws('.', CAST(floor(x / 40.0) AS BIGINT), CAST(floor(y / 40.0) AS BIGINT), CAST(floor(z / 40.0) AS BIGINT)) AS k FROM placed) m ON m.vid = src
    JOIN (SELECT vid, concat_ws('.', CAST(floor(x / 40.0) AS BIGINT), CAST(floor(y / 40.0) AS BIGINT), CAST(floor(z / 40.0) AS BIGINT)) AS k FROM placed) n ON n.vid = dst) WHERE a <> b GROUP BY 1, 2""")
def graph_coarsen(spark, d):
    e = _edges(spark, d).withColumn("weight", F.when(~F.isnan("weight"), F.col("weight")).cast("double"))
    out = graphs.contract(e, graphs.meta_by_bin(_placed(spark, d).withColumnRenamed("vid", "id"), 40.0))
    return out.withColumn("weight", F.round("weight", 3))


_TREE = """
  up AS (SELECT child_vid AS node, min(CASE WHEN parent_vid <> -1 THEN parent_vid END) AS parent FROM links WHERE child_vid IS NOT NULL GROUP BY 1),
  down AS (SELECT node, node AS root, 0 AS depth, [node] AS path FROM (SELECT node FROM up WHERE parent IS NULL UNION SELECT a.parent FROM up a LEFT JOIN up b ON a.parent = b.node WHERE a.parent IS NOT NULL AND b.node IS NULL)
           UNION ALL SELECT u.node, d.root, d.depth + 1, list_append(d.path, u.node) FROM down d JOIN up u ON u.parent = d.node)
"""


@query("WITH RECURSIVE" + _TREE + """SELECT root, node AS node_id, row_number() OVER w - 1 AS rank, CAST(depth AS BIGINT) AS depth, CASE WHEN depth > 0 THEN path[-2] END AS parent,
    coalesce(lag(node) OVER w <> CASE WHEN depth > 0 THEN path[-2] END, false) AS branch FROM down WINDOW w AS (PARTITION BY root ORDER BY path)""")
def tree_preorder(spark, d):
    l = table(spark, d, "links").select(F.col("child_vid").alias("node"), F.col("parent_vid").alias("parent"))
    return hierarchy.ranks(l).drop("last")


@query()
def prune_skeleton(spark, d):
    l = table(spark, d, "links").select(F.col("child_vid").alias("node"), F.col("parent_vid").alias("parent"))
    n = hierarchy.nodes(hierarchy.build(l, paths=True)).filter("path IS NOT NULL")
    n = n.select(F.col("root").alias("tree"), F.col("node_id").alias("node"), F.when(F.col("depth") > 0, F.element_at("path", -2)).alias("parent"))
    pos = points.live(table(spark, d, "vertices")).select(F.col("vid").alias("node"), *[F.coalesce(F.when(grid.finite(F.col(a)), F.col(a)).cast("double"), F.lit(0.0)).alias(a) for a in "xyz"])
    return graphs.prune(n.join(pos, "node", "left").fillna(0.0, ["x", "y", "z"]), min_vertices=3)


# ---- coarsening

_META = ", ".join(f"round(avg({a}), 4) + 0.0 AS mean_{a}" for a in "xyz")


@query(w(_LIVE, _BINS.format(f=0.5)) + f"""SELECT dataset_id, level, concat_ws('.', bi, bj, bk) AS bin_key, count(*) AS n, {_META}, min(vid) AS first_vid, round(avg(v), 4) + 0.0 AS v_mean, round(sum(v), 4) + 0.0 AS v_sum,
    round(arg_min(v, vid), 4) + 0.0 AS v_first, round(min(v), 4) + 0.0 AS v_min, round(max(v), 4) + 0.0 AS v_max FROM (SELECT *, CAST(CASE WHEN NOT isnan(intensity) THEN intensity END AS DOUBLE) AS v FROM binned) GROUP BY ALL""".replace("arg_min(v, vid)", "arg_min_null(v, vid)"))
def metanodes(spark, d):
    m = coarsen.metanodes(_binned(spark, d, 0.5))
    m = m.withColumns({c: F.round(c, 4) for c in m.columns if c.startswith(("mean_", "v_"))})
    return m.withColumn("bin_key", grid.chunk_key([F.col(b) for b in coarsen.BIN])).drop(*coarsen.BIN)


@query(w(_LIVE, _BINS.format(f=0.5)) + """SELECT dataset_id, level, bin_key, oid, votes FROM (SELECT dataset_id, level, concat_ws('.', bi, bj, bk) AS bin_key, oid, count(*) AS votes,
    row_number() OVER (PARTITION BY dataset_id, level, concat_ws('.', bi, bj, bk) ORDER BY count(*) DESC, oid) AS r FROM binned WHERE oid IS NOT NULL GROUP BY 1, 2, 3, 4) WHERE r = 1""")
def metanode_mode(spark, d):
    m = coarsen.majority(_binned(spark, d, 0.5), "oid")
    return m.withColumn("bin_key", grid.chunk_key([F.col(b) for b in coarsen.BIN])).drop(*coarsen.BIN)


@query(w(_LIVE, _BINS.format(f=0.5)) + """SELECT dataset_id, level, bin_key, vid FROM (SELECT dataset_id, level, bin_key, vid, row_number() OVER (PARTITION BY dataset_id, level, bin_key ORDER BY
    round(power(x - mx, 2) + power(y - my, 2) + coalesce(power(z - mz, 2), 0), 6), vid) AS r FROM (SELECT *, concat_ws('.', bi, bj, bk) AS bin_key FROM binned)
    JOIN (SELECT dataset_id, level, concat_ws('.', bi, bj, bk) AS bin_key, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM binned GROUP BY ALL) USING (dataset_id, level, bin_key)) WHERE r = 1""")
def medoid(spark, d):
    m = coarsen.medoids(_binned(spark, d, 0.5))
    return m.withColumn("bin_key", grid.chunk_key([F.col(b) for b in coarsen.BIN])).drop(*coarsen.BIN)


_LINEBIN = """linebin AS (SELECT l.*, concat_ws('.', bi, bj, bk) AS bin_key FROM lines l JOIN (SELECT vid, bi, bj, bk FROM binned) USING (vid) WHERE level = 0)"""


@query(w(_LIVE, _BINS.format(f=0.5), _LINEBIN) + """SELECT dataset_id, level, oid, row_number() OVER (PARTITION BY dataset_id, level, oid ORDER BY ord) - 1 AS place, bin_key
    FROM (SELECT *, lag(bin_key) OVER (PARTITION BY dataset_id, level, oid ORDER BY ord) AS p FROM linebin) WHERE p IS DISTINCT FROM bin_key""")
def per_object_level(spark, d):
    l = coarsen.with_bins(_lines(spark, d).filter("level = 0"), table(spark, d, "root_metadata"), 0.5)
    m = coarsen.object_level(l)
    return m.withColumn("bin_key", grid.chunk_key([F.col(b) for b in coarsen.BIN])).drop(*coarsen.BIN)


_SURVIVE = "survive AS (SELECT dataset_id, oid FROM (SELECT dataset_id, oid, length, row_number() OVER (PARTITION BY dataset_id ORDER BY round(length, 6) DESC, oid) AS r, count(*) OVER (PARTITION BY dataset_id) AS n FROM lens WHERE level = 0) WHERE r <= greatest(1, round_even(n * 0.5, 0)))"


def _survivors(spark, d):
    n = polylines.lengths(_lines(spark, d).filter("level = 0")).withColumn("length", F.round("length", 6))
    k = n.groupBy("dataset_id").agg(select.target(F.count("*"), 0.5).alias("k"))
    win = Window.partitionBy("dataset_id").orderBy(F.desc("length"), "oid")
    return n.withColumn("r", F.row_number().over(win)).join(k, "dataset_id").filter("r <= k").select("dataset_id", "oid")


@query(w(_LIVE, _STEPS, _SURVIVE) + "SELECT l.dataset_id, l.oid, s.oid IS NOT NULL AS present FROM (SELECT dataset_id, oid FROM lens WHERE level = 0) l LEFT JOIN survive s USING (dataset_id, oid)")
def present_mask(spark, d):
    o = _lines(spark, d).filter("level = 0").select("dataset_id", "oid").distinct()
    return coarsen.present_mask(o, _survivors(spark, d))


_UP = """up1 AS (SELECT b.dataset_id, b.vid AS src_vid, m.vid AS dst_vid, b.chunk_key = m.chunk_key AS aligned FROM (SELECT *, concat_ws('.', bi, bj, bk) AS k FROM binned WHERE level = 0) b
    JOIN (SELECT dataset_id, concat_ws('.', bi, bj, bk) AS k, min(vid) AS vid, arg_min(chunk_key, vid) AS chunk_key FROM binned {join} WHERE level = 0 GROUP BY ALL) m ON m.dataset_id = b.dataset_id AND m.k = b.k)"""


_KEEP = """JOIN (SELECT vid AS kept FROM placed WHERE level = 0 AND ((dataset_id, oid) IN (SELECT (dataset_id, oid) FROM survive)
    OR dataset_id NOT IN (SELECT dataset_id FROM placed WHERE level = 0 AND oid IS NOT NULL))) ON kept = vid"""


@query(w(_LIVE, _BINS.format(f=0.5), _STEPS, _SURVIVE, _UP.format(join=_KEEP)) + "SELECT * FROM up1")
def cross_level_plus1(spark, d):
    fine = _binned(spark, d, 0.5).filter("level = 0").withColumn("cell", points.key())
    return coarsen.cross_level(fine, _survivors(spark, d))


@query(w(_LIVE, _BINS.format(f=0.5), _UP.format(join=""), """far AS (SELECT *, concat_ws('.', CAST(floor(x / chunk_shape[1]) AS BIGINT), CAST(floor(y / chunk_shape[2]) AS BIGINT), CAST(floor(z / chunk_shape[3]) AS BIGINT)) AS k FROM placed WHERE level = 0)""") + """
    SELECT u.dataset_id, u.src_vid, m.vid AS dst_vid FROM up1 u JOIN far f ON f.vid = u.dst_vid
    JOIN (SELECT f.dataset_id, f.k, min(f.vid) AS vid FROM far f SEMI JOIN up1 ON up1.dst_vid = f.vid GROUP BY ALL) m ON m.dataset_id = f.dataset_id AND m.k = f.k""")
def cross_level_plus2(spark, d):
    root = table(spark, d, "root_metadata")
    fine = _binned(spark, d, 0.5).filter("level = 0").withColumn("cell", points.key())
    up1 = coarsen.cross_level(fine)
    metas = fine.join(up1.select(F.col("dst_vid").alias("vid")).distinct(), "vid", "left_semi").drop(*coarsen.BIN)
    return coarsen.compose(up1, coarsen.cross_level(coarsen.with_bins(metas, root, 1.0)))


@query("""SELECT c.link_id, a.chunk_key = b.chunk_key AS aligned, c.delta FROM (SELECT DISTINCT link_id, dataset_id, level, delta, src_vid, dst_vid FROM cross_chunk_links WHERE delta <> 0) c
    JOIN placed a ON a.vid = c.src_vid AND a.level = c.level JOIN placed b ON b.vid = c.dst_vid AND b.level = c.level + c.delta""".join([w(_LIVE), ""]))
def cross_level_edges(spark, d):
    e = table(spark, d, "cross_chunk_links").filter("delta <> 0").select("link_id", "level", "delta", "src_vid", "dst_vid").distinct()
    p = _placed(spark, d).select("vid", "level", points.key().alias("cell"))
    a = p.select(F.col("vid").alias("src_vid"), "level", F.col("cell").alias("a"))
    b = p.select(F.col("vid").alias("dst_vid"), F.col("level").alias("to"), F.col("cell").alias("b"))
    j = e.withColumn("to", F.col("level") + F.col("delta")).join(a, ["src_vid", "level"]).join(b, ["dst_vid", "to"])
    return j.select("link_id", (F.col("a") == F.col("b")).alias("aligned"), "delta")


# ---- selection

@query(w(_LIVE, _STEPS) + "SELECT dataset_id, oid, rank FROM (SELECT dataset_id, oid, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY round(length, 6) DESC, oid) AS INT) AS rank FROM lens WHERE level = 0) WHERE rank <= 20")
def topk_length(spark, d):
    n = polylines.lengths(_lines(spark, d).filter("level = 0")).withColumn("length", F.round("length", 6))
    return select.top(n, "length", 20, ["dataset_id"]).select("dataset_id", "oid", "rank")


@query(w(_LIVE) + """SELECT dataset_id, oid, rank FROM (SELECT dataset_id, oid, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY m NULLS LAST, oid) AS INT) AS rank FROM (
    SELECT dataset_id, oid, max(CASE WHEN NOT isnan(intensity) THEN intensity END) AS m FROM live WHERE oid IS NOT NULL GROUP BY ALL)) WHERE rank <= 10""")
def topk_attr(spark, d):
    v = points.live(table(spark, d, "vertices")).filter("oid IS NOT NULL")
    m = v.groupBy("dataset_id", "oid").agg(F.max(F.when(~F.isnan("intensity"), F.col("intensity"))).alias("m"))
    return select.top(m, "m", 10, ["dataset_id"], mode="min").select("dataset_id", "oid", "rank")


@query(w(_LIVE, _BINS.format(f=0.25)) + "SELECT dataset_id, level, min(vid) AS vid, count(*) AS n_in_bin FROM binned GROUP BY dataset_id, level, bi, bj, bk")
def thinning(spark, d):
    return select.thin(_binned(spark, d, 0.25), ["dataset_id", "level", *coarsen.BIN]).drop(*coarsen.BIN)


@query(w(_LIVE, _MID, """bins AS (SELECT dataset_id, chunk_key, count(*) AS size, min(oid) AS first_oid FROM mid WHERE level = 0 GROUP BY ALL),
  tot AS (SELECT dataset_id, count(*) AS nb, sum(size - 1) AS w_all, greatest(1, round_even(sum(size) * 0.4, 0)) AS k FROM bins GROUP BY 1),
  shared AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY first_oid) AS seen, greatest(k - nb, 0) AS rest, CASE WHEN w_all > 0 THEN floor((size - 1) * greatest(k - nb, 0) / w_all) ELSE 0 END AS share FROM bins JOIN tot USING (dataset_id)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY size DESC, seen) AS big, rest - sum(share) OVER (PARTITION BY dataset_id) AS lft FROM shared),
  take AS (SELECT dataset_id, chunk_key, CASE WHEN k <= nb THEN CASE WHEN seen <= k THEN 1 ELSE 0 END ELSE least(1 + share + CASE WHEN big <= lft THEN 1 ELSE 0 END, size) END AS take FROM ranked)""") + """
  SELECT dataset_id, oid FROM (SELECT dataset_id, oid, take, row_number() OVER (PARTITION BY dataset_id, chunk_key ORDER BY oid) AS r FROM mid JOIN take USING (dataset_id, chunk_key) WHERE level = 0) WHERE r <= take""")
def coverage(spark, d):
    reps = polylines.midpoints(_lines(spark, d).filter("level = 0")).select("dataset_id", "oid", "cx", "cy", "cz")
    return select.coverage(reps, ["cx", "cy", "cz"], ["dataset_id"], 0.4)


@query(w(_LIVE, _MID) + """SELECT dataset_id, oid, rank FROM (SELECT dataset_id, oid, CAST(row_number() OVER (PARTITION BY dataset_id, chunk_key ORDER BY n DESC, oid DESC) AS INT) AS rank FROM mid WHERE level = 0) WHERE rank <= 2""")
def subsample_longest(spark, d):
    m = polylines.midpoints(_lines(spark, d).filter("level = 0"))
    return select.subsample(m, ["dataset_id", "cx", "cy", "cz"], 2).select("dataset_id", "oid", "rank")


@query()
def random_sample(spark, d):
    o = _lines(spark, d).filter("level = 0").select("dataset_id", "oid").distinct()
    return select.random(o, 0.25, ["dataset_id"], seed=11)


@query(w(_LIVE) + """SELECT dataset_id, CAST(greatest(1, round_even(count(*) * 0.25, 0)) AS BIGINT) AS chosen, CAST(greatest(1, round_even(count(*) * 0.25, 0)) AS BIGINT) AS known
    FROM (SELECT DISTINCT dataset_id, oid FROM lines WHERE level = 0) GROUP BY 1""")
def random_sample_counts(spark, d):
    """How many objects ``random_sample`` takes, and how many of them are objects."""
    o = _lines(spark, d).filter("level = 0").select("dataset_id", "oid").distinct().withColumn("_k", F.lit(1))
    s = random_sample(spark, d).select(F.col("dataset_id").alias("dataset_id"), F.col("oid").alias("oid")).join(o, ["dataset_id", "oid"], "left")
    return s.groupBy("dataset_id").agg(F.count_distinct("oid").alias("chosen"), F.count("_k").alias("known"))


@query(w(_LIVE) + "SELECT dataset_id, count(*) AS n, CAST(greatest(1, round_even(count(*) * 0.25, 0)) AS BIGINT) AS k FROM (SELECT DISTINCT dataset_id, oid FROM lines WHERE level = 0) GROUP BY 1")
def sparsity_count(spark, d):
    o = _lines(spark, d).filter("level = 0").select("dataset_id", "oid").distinct()
    return o.groupBy("dataset_id").agg(F.count("*").alias("n"), select.target(F.count("*"), 0.25).alias("k"))


# ---- re-chunking and encoding

_OBJ = "objs AS (SELECT DISTINCT dataset_id, oid FROM object_index WHERE oid IS NOT NULL)"


def _objects(spark, d):
    return table(spark, d, "object_index").filter("oid IS NOT NULL").select("dataset_id", "oid").distinct()


@query(w(_OBJ) + "SELECT dataset_id, oid, coalesce(g, -1) AS prefix FROM objs LEFT JOIN (SELECT dataset_id, oid, max(gid) AS g FROM groupings GROUP BY ALL) USING (dataset_id, oid)")
def rechunk_group(spark, d):
    return rechunk.by_group(_objects(spark, d), table(spark, d, "groupings"))


@query(w(_OBJ) + "SELECT dataset_id, oid, CAST(least(greatest((oid >= 0)::INT + (oid >= 300)::INT + (oid >= 800)::INT + (oid >= 5000)::INT - 1, 0), 3) AS INT) AS prefix FROM objs")
def rechunk_oid(spark, d):
    return _objects(spark, d).withColumn("prefix", rechunk.by_edges(F.col("oid"), [0, 300, 800, 5000]))


@query(w(_LIVE) + """SELECT vid, CAST(CASE WHEN v IS NULL THEN -1 WHEN dd <= 10 THEN r ELSE least(len(list_filter(e[2:], lambda q: q <= v)), len(e) - 2) END AS BIGINT) AS prefix FROM (
    SELECT vid, dataset_id, v, dense_rank() OVER (PARTITION BY dataset_id ORDER BY v NULLS LAST) - 1 AS r FROM (SELECT vid, dataset_id, CASE WHEN NOT isnan(intensity) THEN intensity END AS v FROM live))
    JOIN (SELECT dataset_id, count(DISTINCT v) AS dd, list_sort(list_distinct(quantile_cont(v, [0, 0.25, 0.5, 0.75, 1]))) AS e FROM (SELECT dataset_id, CAST(CASE WHEN NOT isnan(intensity) THEN intensity END AS DOUBLE) AS v FROM live) GROUP BY 1) USING (dataset_id)""")
def rechunk_quartile(spark, d):
    v = points.live(table(spark, d, "vertices")).select("vid", "dataset_id", F.col("intensity").cast("double").alias("intensity"))
    return rechunk.by_attribute(v, "intensity", ["dataset_id"]).select("vid", "prefix")


@query(w(_LIVE) + f"SELECT {_TIDY} AS c, dataset_id, chunk_key, count(*) AS n FROM placed GROUP BY ALL")
def rechunk_attr_bins(spark, d):
    p = _placed(spark, d).withColumn("c", points.clean_category(F.col("category")))
    return p.groupBy("c", *points.CELL[:1], "cx", "cy", "cz").agg(F.count("*").alias("n")).select("c", "dataset_id", points.key().alias("chunk_key"), "n")


@query(w(_LIVE, _BINS.format(f=0.125)) + """SELECT dataset_id, level, chunk_key, concat_ws('.', bi, bj, bk) AS bin_key, count(*) AS n FROM binned WHERE dataset_id IN (1, 2, 3) GROUP BY ALL""")
def rebin(spark, d):
    """Of point clouds only, as the library's; by type, not by the ids in the SQL."""
    clouds = table(spark, d, "root_metadata").filter("geometry_type = 'point_cloud'").select("dataset_id")
    b = _binned(spark, d, 0.125).join(clouds, "dataset_id", "left_semi").groupBy(*points.CELL, *coarsen.BIN).agg(F.count("*").alias("n"))
    return b.select("dataset_id", "level", points.key().alias("chunk_key"), grid.chunk_key([F.col(c) for c in coarsen.BIN]).alias("bin_key"), "n")


@query(w(_LIVE, """ranges AS (SELECT dataset_id, any_value(bounds_min IS NULL OR bounds_max IS NULL) AS own, any_value(bounds_min) AS b, any_value(bounds_max) AS t, """
         + ", ".join(f"min({a}) AS min_{a}, max({a}) AS max_{a}" for a in "xyz") + " FROM placed GROUP BY 1)", "edges AS (SELECT dataset_id, "
         + ", ".join(f"CASE WHEN own THEN min_{a} ELSE b[{i}] END AS l{a}, CASE WHEN own THEN max_{a} ELSE t[{i}] END AS h{a}" for i, a in enumerate("xyz", 1)) + " FROM ranges)")
       + "SELECT vid, " + ", ".join(f"CASE WHEN {a} IS NOT NULL THEN CASE WHEN h{a} > l{a} THEN CAST(floor(({a} - l{a}) / (h{a} - l{a}) * 2047 + 0.5) AS BIGINT) ELSE 0 END END AS q{a}" for a in "xyz")
       + " FROM placed JOIN edges USING (dataset_id)")
def quantise(spark, d):
    p = _placed(spark, d)
    p = p.join(encode.axis_ranges(p, table(spark, d, "root_metadata")), "dataset_id")
    q = lambda a: F.when(F.col(a).isNotNull(), encode.quantise(F.col(a), F.col(f"lo_{a}"), F.col(f"hi_{a}"), 11))
    return p.select("vid", *[q(a).alias(f"q{a}") for a in "xyz"])


@query(w(_LIVE) + """SELECT dataset_id, level, chunk_key, fragment, min(i) AS first, count(*) AS size, max(i) - min(i) + 1 = count(*) AS is_range
    FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, level, chunk_key ORDER BY vid) - 1 AS i FROM placed) GROUP BY ALL""")
def fragment_blocks(spark, d):
    l = points.local_index(_placed(spark, d))
    f = encode.fragment_blocks(l, [*points.CELL, "fragment"], "local_idx")
    return f.select("dataset_id", "level", points.key().alias("chunk_key"), "fragment", "first", "size", "is_range")


@query(w(_LIVE) + """SELECT dataset_id, oid, size, CAST(coalesce(sum(size) OVER (PARTITION BY dataset_id ORDER BY oid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
    FROM (SELECT dataset_id, oid, count(*) AS size FROM lines WHERE level = 0 GROUP BY ALL)""")
def ragged_offsets(spark, d):
    return encode.ragged(_lines(spark, d).filter("level = 0"), ["dataset_id", "oid"], "vid", "ord").select("dataset_id", "oid", "size", "first")


# ---- bounds, composites, parametric objects, validation

_BOUNDED = "live JOIN root_metadata USING (dataset_id)"


@query(w(_LIVE) + """SELECT vid FROM placed WHERE coalesce(x >= bounds_min[1] AND x <= bounds_max[1], true) AND coalesce(y >= bounds_min[2] AND y <= bounds_max[2], true)
    AND coalesce(z >= bounds_min[3] AND z <= bounds_max[3], true)""")
def oob_ignore(spark, d):
    return points.out_of_bounds(_placed(spark, d), table(spark, d, "root_metadata"), "ignore").select("vid")


@query(w(_LIVE) + "SELECT dataset_id, " + ", ".join(f"least(min({a}), min(bounds_min[{i}])) AS lo_{a}, greatest(max({a}), max(bounds_max[{i}])) AS hi_{a}" for i, a in enumerate("xyz", 1)) + " FROM placed GROUP BY 1")
def oob_expand(spark, d):
    return points.out_of_bounds(_placed(spark, d), table(spark, d, "root_metadata"), "expand")


@query(w(_LIVE) + """SELECT dataset_id, vid, coalesce((SELECT max(oid) FROM live o WHERE o.dataset_id = l.dataset_id), -1) + row_number() OVER (PARTITION BY dataset_id ORDER BY vid) AS new_oid FROM live l WHERE oid IS NULL""")
def append_ids(spark, d):
    l = points.live(table(spark, d, "vertices"))
    return points.append_ids(l, l.filter("oid IS NULL"))


@query(w(_LIVE) + """SELECT geometry_type, 'vertex' AS kind, count(*) AS n FROM live JOIN root_metadata USING (dataset_id) GROUP BY 1
    UNION ALL SELECT geometry_type, 'parent_link', count(DISTINCT link_id) FROM links JOIN root_metadata USING (dataset_id) GROUP BY 1
    UNION ALL SELECT geometry_type, 'edge', count(DISTINCT link_id) FROM cross_chunk_links JOIN root_metadata USING (dataset_id) GROUP BY 1
    UNION ALL SELECT geometry_type, 'vector', count(DISTINCT vid) FROM vertices_nd JOIN root_metadata USING (dataset_id) GROUP BY 1""")
def composite_union(spark, d):
    root = table(spark, d, "root_metadata").select("dataset_id", "geometry_type")
    rows = points.live(table(spark, d, "vertices")).select("dataset_id", F.lit("vertex").alias("kind"), F.col("vid").alias("id"))
    for name, kind, id_ in (("links", "parent_link", "link_id"), ("cross_chunk_links", "edge", "link_id"), ("vertices_nd", "vector", "vid")):
        rows = rows.unionByName(table(spark, d, name).select("dataset_id", F.lit(kind).alias("kind"), F.col(id_).alias("id")).distinct())
    return rows.join(root, "dataset_id").groupBy("geometry_type", "kind").agg(F.count("*").alias("n"))


_SHAPES = [(0, 0, [0.0, 0.0, 1.0, -50.0]), (1, 1, [0.0, 0.0, 0.0, 1.0, 1.0, 0.0]), (2, 2, [100.0, 100.0, 100.0, 80.0])]
_SHAPE_SQL = "shapes AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {t}, {c}::DOUBLE[])" for i, t, c in _SHAPES) + ") AS s(object_id, type_id, c))"


@query(w(_LIVE, _SHAPE_SQL) + """SELECT object_id, dataset_id, round(min(dist), 4) AS nearest, sum((dist <= 25)::BIGINT)::BIGINT AS n_near FROM (SELECT object_id, dataset_id, CASE type_id
    WHEN 0 THEN abs(c[1] * x + c[2] * y + c[3] * z + c[4]) / sqrt(c[1] * c[1] + c[2] * c[2] + c[3] * c[3])
    WHEN 1 THEN sqrt(power((y - c[2]) * c[6] - (z - c[3]) * c[5], 2) + power((z - c[3]) * c[4] - (x - c[1]) * c[6], 2) + power((x - c[1]) * c[5] - (y - c[2]) * c[4], 2)) / sqrt(c[4] * c[4] + c[5] * c[5] + c[6] * c[6])
    ELSE abs(sqrt(power(x - c[1], 2) + power(y - c[2], 2) + power(z - c[3], 2)) - c[4]) END AS dist FROM placed, shapes WHERE z IS NOT NULL AND level = 0) GROUP BY ALL""")
def parametric_eval(spark, d):
    rows = F.array(*[F.struct(F.lit(i).alias("object_id"), F.lit(t).alias("type_id"), F.array(*map(F.lit, c)).alias("c")) for i, t, c in _SHAPES])
    p = _placed(spark, d).filter("z IS NOT NULL AND level = 0").select("dataset_id", "x", "y", "z", F.explode(rows).alias("s"))  # a literal list of objects
    dist = parametric.distance(F.col("s.type_id"), F.col("s.c"), F.col("x"), F.col("y"), F.col("z"))
    p = p.withColumn("dist", dist).groupBy(F.col("s.object_id").alias("object_id"), "dataset_id")
    return p.agg(F.round(F.min("dist"), 4).alias("nearest"), F.sum((F.col("dist") <= 25).cast("bigint")).alias("n_near"))


@query("""SELECT 'version' AS "check", dataset_id, count(*) AS n FROM root_metadata WHERE zv_version IS NULL OR NOT (list_transform(string_split(zv_version, '.'), lambda p: p::INT) >= [0, 7, 0]) GROUP BY 2
    UNION ALL SELECT 'shape_length', dataset_id, count(*) FROM root_metadata WHERE len(chunk_shape) <> ndim GROUP BY 2
    UNION ALL SELECT 'shape_positive', dataset_id, count(*) FROM root_metadata WHERE len(list_filter(chunk_shape, lambda s: s <= 0)) > 0 GROUP BY 2
    UNION ALL SELECT 'bounds_missing', dataset_id, count(*) FROM root_metadata WHERE bounds_min IS NULL OR bounds_max IS NULL GROUP BY 2
    UNION ALL SELECT 'bounds_order', dataset_id, count(*) FROM root_metadata WHERE len(list_filter(list_zip(bounds_min, bounds_max), lambda b: b[1] > b[2])) > 0 GROUP BY 2""")
def validate_metadata(spark, d):
    return validate.metadata(table(spark, d, "root_metadata"))


@query("""SELECT 'position' AS "check", dataset_id, count(*) AS n FROM vertices JOIN root_metadata USING (dataset_id) WHERE x IS NULL OR NOT isfinite(x) OR y IS NULL OR NOT isfinite(y) OR (ndim > 2 AND (z IS NULL OR NOT isfinite(z))) GROUP BY 2
    UNION ALL SELECT 'seq', dataset_id, count(*) FROM vertices JOIN root_metadata USING (dataset_id) WHERE oid IS NOT NULL AND seq IS NULL GROUP BY 2""")
def validate_positions(spark, d):
    return validate.positions(table(spark, d, "vertices"), table(spark, d, "root_metadata"))


@query("""SELECT dataset_id, level, n, level - coalesce(lag(level) OVER w, -1) = 1 AS contiguous, coalesce(n <= lag(n) OVER w, true) AS shrinks
    FROM (SELECT dataset_id, level, count(DISTINCT vid) AS n FROM vertices WHERE deleted_at IS NULL GROUP BY ALL) WINDOW w AS (PARTITION BY dataset_id ORDER BY level)""")
def validate_levels(spark, d):
    return validate.levels(table(spark, d, "vertices"))


@query("""SELECT dataset_id, geometry_type, coalesce(n, 0) AS n_vertices, coalesce(o, 0) AS n_with_object, coalesce(k, 0) AS n_parent_links, (coalesce(k, 0) > 0) = (geometry_type = 'skeleton') AS conforms FROM root_metadata
    LEFT JOIN (SELECT dataset_id, count(*) AS n, count(oid) AS o FROM vertices GROUP BY 1) USING (dataset_id) LEFT JOIN (SELECT dataset_id, count(*) AS k FROM links GROUP BY 1) USING (dataset_id)""")
def validate_conformance(spark, d):
    return validate.conformance(table(spark, d, "root_metadata"), table(spark, d, "vertices"), table(spark, d, "links"))


@query("""SELECT label, array_to_string(list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) / 0.25) AS BIGINT)), '.') AS bin_key, count(*) AS n FROM embeddings GROUP BY 1, 2""")
def cells_high_d(spark, d):
    key = F.concat_ws(".", F.transform("embedding", lambda v: F.floor(v.cast("double") / 0.25).cast("string")))
    return table(spark, d, "embeddings").groupBy("label", key.alias("bin_key")).agg(F.count("*").alias("n"))


_ENDPOINT = "SELECT DISTINCT dataset_id, {level} AS level, {key} AS vid, link_id FROM {table} WHERE {key} IS NOT NULL{more}"
_DANGLING = [("edge_source", "cross_chunk_links", "level", "src_vid", ""), ("edge_target", "cross_chunk_links", "level + delta", "dst_vid", ""), ("link_child", "links", "0", "child_vid", ""),
             ("link_parent", "links", "0", "parent_vid", " AND parent_vid <> -1")]


@query(" UNION ALL ".join(f"""SELECT '{name}' AS "check", dataset_id, count(*) AS n FROM ({_ENDPOINT.format(level=level, key=key, table=t, more=more)}) r ANTI JOIN vertices v USING (dataset_id, level, vid) GROUP BY 2""" for name, t, level, key, more in _DANGLING) + """
    UNION ALL SELECT 'group_member', dataset_id, count(*) FROM (SELECT DISTINCT dataset_id, oid, member_id FROM groupings WHERE oid IS NOT NULL) ANTI JOIN object_index USING (dataset_id, oid) GROUP BY 2
    UNION ALL SELECT 'object_without_vertex', dataset_id, count(*) FROM (SELECT DISTINCT dataset_id, oid FROM object_index WHERE oid IS NOT NULL) ANTI JOIN vertices USING (dataset_id, oid) GROUP BY 2
    UNION ALL SELECT 'place_used_twice', dataset_id, count(*) FROM (SELECT dataset_id, level, oid, seq FROM vertices WHERE deleted_at IS NULL AND oid IS NOT NULL AND seq IS NOT NULL GROUP BY ALL HAVING count(DISTINCT vid) > 1) GROUP BY 2""")
def validate_consistency(spark, d):
    return validate.consistency(*[table(spark, d, t) for t in ("vertices", "root_metadata", "links", "cross_chunk_links", "groupings", "object_index")])


# ---- strategies and encodings, there and back

@query(w(_LIVE, _MID, _STEPS) + """, m AS (SELECT dataset_id, oid, n, length, chunk_key FROM mid JOIN (SELECT dataset_id, level, oid, length FROM lens) USING (dataset_id, level, oid) WHERE level = 0),
  k AS (SELECT dataset_id, greatest(1, round_even(count(*) * 0.3, 0)) AS k FROM m GROUP BY 1)
  SELECT 'length' AS strategy, dataset_id, oid FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY round(length, 6) DESC, oid) AS r FROM m JOIN k USING (dataset_id)) WHERE r <= k
  UNION ALL SELECT 'attribute', dataset_id, oid FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY n, oid) AS r FROM m JOIN k USING (dataset_id)) WHERE r <= k
  UNION ALL SELECT 'point_thinning', dataset_id, min(oid) FROM m GROUP BY dataset_id, chunk_key""")
def sparsity_strategies(spark, d):
    l = _lines(spark, d).filter("level = 0")  # objects are chosen at the full level
    m = polylines.midpoints(l).join(polylines.lengths(l).select(*polylines.OBJECT, F.round("length", 6).alias("length")), polylines.OBJECT)
    one = lambda name, **kw: select.apply_sparsity(m, 0.3, name, **kw).select(F.lit(name).alias("strategy"), "dataset_id", "oid")
    return one("length").unionByName(one("attribute", value="n", mode="min")).unionByName(one("point_thinning", bins=["cx", "cy", "cz"]))


@query(w(_LIVE, _MID) + """SELECT dataset_id, oid, rank FROM (SELECT dataset_id, oid, CAST(row_number() OVER (PARTITION BY dataset_id, level, chunk_key ORDER BY oid) AS INT) AS rank, level FROM mid) WHERE rank <= 2 AND level = 0""")
def subsample_first(spark, d):
    m = polylines.midpoints(_lines(spark, d).filter("level = 0"))  # objects are chosen at the full level
    return select.subsample(m, ["dataset_id", "cx", "cy", "cz"], 2, "first").select("dataset_id", "oid", "rank")


@query("WITH RECURSIVE " + _LIVE + "," + _PEUCKER + """, kept AS (SELECT dataset_id, level, oid, ord, row_number() OVER (PARTITION BY dataset_id, level, oid ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY dataset_id, level, oid) AS n
    FROM (SELECT DISTINCT * FROM (SELECT dataset_id, level, oid, a AS ord FROM seg UNION SELECT dataset_id, level, oid, b FROM seg))),
  reps AS (SELECT k.dataset_id, k.level, k.oid, k.n, row_number() OVER (PARTITION BY k.dataset_id, k.level, l.chunk_key ORDER BY k.n DESC, k.oid DESC) AS r FROM kept k JOIN lines l USING (dataset_id, level, oid, ord) WHERE i = floor(n / 2))
  SELECT dataset_id, level, oid, n FROM reps WHERE r <= 1""")
def coarsen_polylines(spark, d):
    out = polylines.coarsen(_lines(spark, d), 1.0, ["cx", "cy", "cz"])
    return out.groupBy(*polylines.OBJECT).agg(F.count("*").alias("n"))


@query(w(_MESH, "size AS (SELECT ((max(x) - min(x)) + (max(y) - min(y))) / 2 * power((SELECT count(*) FROM faces) / greatest(1, floor((SELECT count(*) FROM faces) * 0.1)) / count(*), 1.0 / 3) * 2 AS b FROM grid)") + """
    SELECT array_to_string(c, ',') AS corners, min(face_id) AS face_id FROM (SELECT face_id, list_sort(list(m)) AS c, count(DISTINCT m) AS k FROM corners JOIN (
      SELECT id, concat_ws('.', CAST(floor(x / b) AS BIGINT), CAST(floor(y / b) AS BIGINT)) AS m FROM grid, size) USING (id) GROUP BY 1) WHERE k = 3 GROUP BY 1""")
def mesh_to_ratio(spark, d):
    nodes, faces = _mesh(spark, d)
    return graphs.coarsen_mesh(nodes, faces, target_ratio=0.1, axes="xy").select(F.array_join("corners", ",").alias("corners"), "face_id")


@query(w(_LIVE) + "SELECT dataset_id, level, chunk_key, oid, row_number() OVER (PARTITION BY dataset_id, level, chunk_key, oid ORDER BY vid) - 1 AS pos, vid FROM placed WHERE oid IS NOT NULL")
def ragged_roundtrip(spark, d):
    p = _placed(spark, d).filter("oid IS NOT NULL").withColumn("chunk_key", points.key())
    packed = encode.pack_ragged(p, ["dataset_id", "level", "chunk_key"], "oid", "vid", "vid")
    return encode.unpack_ragged(packed, ["dataset_id", "level", "chunk_key"], "oid", "vid")


@query(w(_LIVE) + "SELECT dataset_id, level, chunk_key, fragment, row_number() OVER (PARTITION BY dataset_id, level, chunk_key ORDER BY vid) - 1 AS local_idx FROM placed")
def fragments_roundtrip(spark, d):
    l = points.local_index(_placed(spark, d)).withColumn("chunk_key", points.key())
    keys = ["dataset_id", "level", "chunk_key", "fragment"]
    return encode.decode_fragments(encode.encode_fragments(l, keys, "local_idx"), keys, "local_idx")


@query("""SELECT DISTINCT manifest_id, CAST(pos - 1 AS INT) AS entry, e.chunk_key AS chunk_key, e.fragment AS fragment FROM (SELECT manifest_id, unnest(manifest) AS e, generate_subscripts(manifest, 1) AS pos FROM object_index)""")
def manifest_roundtrip(spark, d):
    e = table(spark, d, "object_index").select("manifest_id", F.posexplode("manifest").alias("pos", "e")).distinct()
    e = e.select("manifest_id", "pos", F.col("e.chunk_key").alias("chunk_key"), F.col("e.fragment").alias("fragment"))
    return encode.decode_manifests(encode.encode_manifests(e, ["manifest_id"], "pos", "chunk_key", "fragment"), ["manifest_id"], "chunk_key", "fragment")
