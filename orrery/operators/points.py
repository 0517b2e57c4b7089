"""Reads of points: deduplicated deliveries, predicates, groups, objects, manifests and attribute codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.grid import chunk_key, in_box, in_box_cells, with_cells
from orrery.operators import blocks
from orrery.plans.sizing import tasks_of
from orrery.plans.staging import stage

CELL = ["dataset_id", "level", "cx", "cy", "cz"]
SLOTS = 1 << 16  #: object slots that one row opens out to
TASK_SLOTS = 1 << 20  #: object slots of a task


def live(vertices: DataFrame) -> DataFrame:
    """One row per vid that is not deleted.

    All deliveries of a vertex agree in dataset, level, position and fragment; these are keys of the aggregate, so
    filters on them reach the scan.  Of the other attributes the least value stands (nulls lose, NaN counts as
    largest), so the result does not depend on the order of rows.
    """
    keys = ["vid", "dataset_id", "level", "x", "y", "z", "fragment"]
    out = vertices.filter("deleted_at IS NULL AND vid IS NOT NULL").groupBy(*keys).agg(*[F.min(c).alias(c) for c in ("oid", "seq", "intensity", "category")])
    return out.select("vid", "dataset_id", "level", "oid", "seq", "x", "y", "z", "fragment", "intensity", "category")


def placed(vertices: DataFrame, root: DataFrame) -> DataFrame:
    """Live vertices that have a cell, with ``cx, cy, cz`` and double coordinates (``z`` null if ndim is 2)."""
    p = with_cells(live(vertices), root)
    z = F.when(F.col("cz").isNotNull(), F.col("z").cast("double"))
    return p.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double"), "z": z})


def key() -> Column:
    return chunk_key([F.col(c) for c in ("cx", "cy", "cz")])


def box(points: DataFrame, lo: Sequence[float], hi: Sequence[float], size: Sequence[Column | float] | None = None) -> DataFrame:
    """Points inside a closed box; with ``size`` (numbers or Columns), cell ranges are added so that files clustered by cell are skipped."""
    out = points.filter(in_box("xyz"[: len(lo)], lo, hi))
    return out if size is None else out.filter(in_box_cells(["cx", "cy", "cz"][: len(lo)], lo, hi, size))


def box_cells(boxes: DataFrame, sizes: Sequence[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Explode boxes(lo array, hi array, size columns) to the cells that they meet: floor(lo/s)..floor(hi/s)."""
    out = boxes
    for i, (c, s) in enumerate(zip(("cx", "cy", "cz"), sizes)):
        edge = lambda side: F.floor(F.get(F.col(side), F.lit(i)) / F.col(s)).cast("bigint")  # noqa: B023,E731
        out = out.withColumn(c, F.explode(F.sequence(edge(lo), edge(hi))))
    return out


def in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points in each of many closed boxes: an equi-join on the cells that a box meets, then the exact test.

    ``boxes`` has box_id, dataset_id, lo, hi and the dataset's chunk_shape (three entries).  A box is cut into cells of
    the grid that its extent asks for (the base cells, or those of 2**g times their edge), so it opens out to 125 rows at
    most however large it is; a point is looked up once in each grid that a box of its dataset uses.
    """
    span = F.greatest(*[(F.get("hi", F.lit(i)) - F.get("lo", F.lit(i))) / F.get("chunk_shape", F.lit(i)) for i in range(3)])
    g = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(span, F.lit(1.0)) / 4))).cast("int")
    b = boxes.withColumn("g", g).withColumns({f"s{i}": F.get("chunk_shape", F.lit(i)) * F.pow(F.lit(2.0), F.col("g")) for i in range(3)})
    grids = b.select("dataset_id", "g").distinct()
    b = box_cells(b, ["s0", "s1", "s2"]).select("box_id", "dataset_id", "g", *[F.col(f"c{a}").alias(f"_{a}") for a in "xyz"], "lo", "hi")
    p = points.join(grids, "dataset_id").withColumns({f"_{a}": F.floor(F.col(f"c{a}") / F.pow(F.lit(2.0), F.col("g"))).cast("bigint") for a in "xyz"})
    inside = F.lit(True)
    for i, a in enumerate("xyz"):
        inside = inside & F.col(a).between(F.get("lo", F.lit(i)), F.get("hi", F.lit(i)))
    return p.join(b, ["dataset_id", "g", "_x", "_y", "_z"]).filter(inside).drop("lo", "hi", "g", "_x", "_y", "_z")


def neighbours(cells: DataFrame, halo: int = 1, include_self: bool = False, axes: str = "xyz") -> DataFrame:
    """(cell, nx, ny, nz): the (2 halo + 1)**n cells around each cell of the n ``axes``."""
    if halo < 0:
        raise ValueError("halo must not be negative")
    out, same = cells, F.lit(True)
    for a in axes:
        out = out.withColumn(f"n{a}", F.explode(F.sequence(F.col(f"c{a}") - halo, F.col(f"c{a}") + halo)))
        same = same & (F.col(f"n{a}") == F.col(f"c{a}"))
    return out if include_self else out.filter(~same)


def occupied_neighbours(cells: DataFrame, halo: int = 1, axes: str = "xyz", keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Neighbours that are themselves cells of the table (a semi-join)."""
    there = cells.select(*keys, *[F.col(f"c{a}").alias(f"n{a}") for a in axes])
    return neighbours(cells, halo, axes=axes).join(there, [*keys, *[f"n{a}" for a in axes]], "left_semi")


def grid_shape(bounds: DataFrame) -> DataFrame:
    """(dataset_id, axis, cells): max(1, ceil((hi - lo) / s)) per axis of bounds_min, bounds_max and chunk_shape.

    Datasets whose bounds are null are left out.
    """
    e = bounds.filter("bounds_max IS NOT NULL AND bounds_min IS NOT NULL").select(
        "dataset_id", F.posexplode(F.arrays_zip("bounds_min", "bounds_max", "chunk_shape")).alias("axis", "b")
    )
    n = F.ceil((F.col("b.bounds_max") - F.col("b.bounds_min")) / F.col("b.chunk_shape"))
    return e.select("dataset_id", "axis", F.greatest(F.lit(1), n).cast("bigint").alias("cells"))


def local_index(points: DataFrame) -> DataFrame:
    """Add ``local_idx``: the place of a vertex in its cell, from 0, by vid."""
    return blocks.number(points, CELL, "vid", "local_idx")


def cell_offsets(points: DataFrame) -> DataFrame:
    """Exclusive prefix sums of the cells' counts in cell order, per dataset and level, for any number of axes.

    The window runs over one row per cell, not over vertices.
    """
    per = points.groupBy(*CELL).agg(F.count("*").alias("n"))
    w = Window.partitionBy("dataset_id", "level").orderBy("cx", "cy", "cz").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("first_row", F.coalesce(F.sum("n").over(w), F.lit(0)))


def read(vertices: DataFrame, root: DataFrame, wanted: Column | DataFrame, on: Sequence[str] = ("dataset_id", "oid")) -> DataFrame:
    """Placed vertices that a condition on attributes, or a table of keys ``on``, selects.

    Any delivery of a vertex may lack an attribute, so only all its deliveries together tell whether it is selected.  The
    vids of which any delivery is selected are found by a scan with the condition pushed down; their deliveries alone
    are merged, and the test is made again.
    """
    pick = (lambda df: df.filter(wanted)) if isinstance(wanted, Column) else (lambda df: df.join(wanted, list(on), "left_semi"))
    some = pick(vertices.filter("deleted_at IS NULL")).select(F.col("vid").alias("_v")).distinct()
    return pick(placed(vertices.join(some, F.col("vid") == F.col("_v"), "left_semi"), root))


def of_groups(points: DataFrame, groups: DataFrame, gids: Sequence[int] | None = None, oids: Sequence[int] | None = None) -> DataFrame:
    """Points of the members of groups, intersected with ``oids``; an unknown gid raises nothing and selects nothing."""
    members = groups.filter("oid IS NOT NULL")
    if gids is not None:
        members = members.filter(F.col("gid").isin(list(gids)))
    out = points.join(members.select("dataset_id", "oid").distinct(), ["dataset_id", "oid"], "left_semi")
    return out if oids is None else out.filter(F.col("oid").isin(list(oids)))


def manifest(points: DataFrame) -> DataFrame:
    """Derived manifest: per object, its (chunk_key, fragment) places in order of first use, with their counts."""
    per = points.filter("oid IS NOT NULL").groupBy("dataset_id", "level", "oid", "cx", "cy", "cz", "fragment").agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("n_vertices")
    )
    w = Window.partitionBy("dataset_id", "level", "oid").orderBy(F.asc_nulls_last("first_seq"), "cx", "cy", "cz", "fragment")
    return per.withColumn("entry", (F.row_number().over(w) - 1).cast("int")).select(
        "dataset_id", "level", "oid", "entry", key().alias("chunk_key"), "fragment", "n_vertices"
    )


def dense_slots(objects: DataFrame) -> DataFrame:
    """One slot per oid from the dataset's least to its greatest; gaps have present = false and no fragments.

    Oids may lie far apart, so there can be many more slots than objects.  Only objects and blocks of SLOTS slots are
    shuffled, into tasks that follow the measured number of slots; a block opens out where it is returned, each object with
    the gap behind it.
    """
    o = objects.filter("oid IS NOT NULL AND level = 0")
    block = lambda c: F.floor(F.col(c) / F.lit(SLOTS)).cast("bigint")
    span = o.groupBy("dataset_id").agg(F.min("oid").alias("lo"), F.max("oid").alias("hi"))
    total = span.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] or 0
    have = o.groupBy("dataset_id", "oid").agg(F.max(F.coalesce(F.size("manifest"), F.lit(0))).alias("n"))
    mine = have.select("dataset_id", block("oid").alias("b"), F.struct("oid", F.col("n").cast("int").alias("n")).alias("at"))
    every = span.select("dataset_id", "lo", "hi", F.explode(F.sequence(block("lo"), block("hi"))).alias("b"))
    rows = every.unionByName(mine, allowMissingColumns=True).repartition(tasks_of(o.sparkSession, total, TASK_SLOTS), "dataset_id", "b")
    g = rows.groupBy("dataset_id", "b").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list("at")).alias("at"))
    g = g.select("dataset_id", "at", F.greatest("lo", F.col("b") * SLOTS).alias("lo"), F.least("hi", F.col("b") * SLOTS + (SLOTS - 1)).alias("hi"))
    end = lambda i: F.coalesce(F.get(F.col("at"), i)["oid"] - 1, F.col("hi"))
    first = F.array(F.struct(F.col("lo").alias("f"), end(F.lit(0)).alias("t"), F.lit(None).cast("int").alias("n")))
    runs = F.concat(first, F.transform("at", lambda a, i: F.struct(a["oid"].alias("f"), end(i + 1).alias("t"), a["n"].alias("n"))))
    r = g.select("dataset_id", F.inline(runs)).filter("t >= f")  # a block that begins with an object has no gap before it
    out = r.select("dataset_id", "f", "n", F.explode(F.sequence("f", "t")).alias("oid"))
    present = (F.col("oid") == F.col("f")) & F.col("n").isNotNull()
    return out.select("dataset_id", "oid", present.alias("present"), F.when(present, F.greatest("n", F.lit(0))).otherwise(F.lit(0)).alias("n_fragments"))


def attribute_bins(df: DataFrame, value: str) -> DataFrame:
    """(value, bin): dense bins 0..K-1 of a categorical value in sorted order, from its distinct values.

    Floats are no categories.  Nulls have no bin.
    """
    if dict(df.dtypes)[value] in ("float", "double"):
        raise TypeError(f"{value} is not categorical")
    distinct = df.filter(F.col(value).isNotNull()).select(value).distinct()
    ranges = distinct.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), value)
    d = stage(ranges.withColumn("_p", F.spark_partition_id()), "values")  # ranges rise with their number, so no task orders all values
    over = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))  # one row a range
    place = d.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(value)) - 1)
    return place.join(base, "_p").select(value, (F.col("_before") + F.col("_i")).cast("bigint").alias("bin"))


def encode_categorical(df: DataFrame, value: str, fill: int = -1) -> DataFrame:
    """Add ``code``: the value's place among the sorted distinct values, ``fill`` where it is missing."""
    codes = attribute_bins(df, value).withColumnRenamed("bin", "_code")
    return df.join(codes, value, "left").withColumn("code", F.coalesce("_code", F.lit(fill).cast("bigint"))).drop("_code")


def decode_categorical(coded: DataFrame, categories: DataFrame, value: str) -> DataFrame:
    """Turn ``code`` back into the value; codes without a category give null."""
    return coded.join(categories.select(F.col("bin").alias("code"), value), "code", "left")


def clean_category(c: Column) -> Column:
    """Untidy categories made comparable: trimmed, lower case, inner blanks as one; blank is null."""
    out = F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    return F.when(out != "", out)


def object_levels(points: DataFrame) -> DataFrame:
    """Levels at which each object is present."""
    return points.filter("oid IS NOT NULL").groupBy("dataset_id", "oid").agg(F.array_join(F.array_sort(F.collect_set(F.col("level").cast("string"))), ",").alias("levels"))


def out_of_bounds(points: DataFrame, root: DataFrame, policy: str) -> DataFrame:
    """``ignore`` drops points outside their dataset's closed bounds, ``raise`` fails on the first one,
    ``expand`` returns each dataset's bounds widened to hold all points.  A missing bound holds everything.
    """
    b = root.select("dataset_id", "bounds_min", "bounds_max")
    p = points.join(b, "dataset_id")
    inside = F.lit(True)
    for i, a in enumerate("xyz"):
        ok = (F.col(a) >= F.get("bounds_min", F.lit(i))) & (F.col(a) <= F.get("bounds_max", F.lit(i)))
        inside = inside & F.coalesce(ok, F.lit(True))
    if policy == "ignore":
        return p.filter(inside).drop("bounds_min", "bounds_max")
    if policy == "raise":
        return p.filter(F.when(inside, F.lit(True)).otherwise(F.raise_error(F.lit("point outside the bounds")).cast("boolean"))).drop("bounds_min", "bounds_max")
    if policy != "expand":
        raise ValueError(policy)
    per = points.groupBy("dataset_id").agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    out = per.join(b, "dataset_id")
    low = [F.least(f"lo_{a}", F.get("bounds_min", F.lit(i))).alias(f"lo_{a}") for i, a in enumerate("xyz")]
    high = [F.greatest(f"hi_{a}", F.get("bounds_max", F.lit(i))).alias(f"hi_{a}") for i, a in enumerate("xyz")]
    return out.select("dataset_id", *low, *high)


def append_ids(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Ids for appended vertices: one new object each, numbered after the dataset's greatest oid in order of vid."""
    top = existing.groupBy("dataset_id").agg(F.coalesce(F.max("oid"), F.lit(-1)).alias("top"))
    place = blocks.number(new.select("dataset_id", "vid"), ["dataset_id"], "vid", "_i")
    return place.join(top, "dataset_id", "left").select("dataset_id", "vid", (F.coalesce("top", F.lit(-1)) + F.col("_i") + 1).alias("new_oid"))
