"""Encodings as relational operators: quantisation, ragged lists, fragments as ranges or explicit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import blocks

PART = 1 << 16  #: values that one row of an encoded table holds


def quantise(v: Column, lo: Column, hi: Column, bits: int) -> Column:
    """Whole steps 0 .. 2**bits - 1 of [lo, hi]; a range without extent gives 0."""
    top = float((1 << bits) - 1)
    return F.when(hi > lo, F.floor((v - lo) / (hi - lo) * F.lit(top) + F.lit(0.5))).otherwise(0).cast("bigint")


def axis_ranges(points: DataFrame, root: DataFrame) -> DataFrame:
    """(dataset_id, lo_x, hi_x, ..): the bounds of each dataset; where either is null, the range of its points."""
    none = root.filter("bounds_min IS NULL OR bounds_max IS NULL").select("dataset_id")
    seen = points.join(none, "dataset_id", "left_semi").groupBy("dataset_id")
    seen = seen.agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    given = root.filter("bounds_min IS NOT NULL AND bounds_max IS NOT NULL")
    side = lambda n, m, a, i: F.get(f"bounds_{m}", F.lit(i)).cast("double").alias(f"{n}_{a}")
    return given.select("dataset_id", *[side(n, m, a, i) for i, a in enumerate("xyz") for n, m in (("lo", "min"), ("hi", "max"))]).unionByName(seen)


def ragged(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """Concatenated groups as (group, first, size): where each group's values start in the order of groups."""
    n = df.groupBy(*group).agg(F.count("*").alias("size"))
    w = Window.partitionBy(group[0]).orderBy(*group[1:]).rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("first", F.coalesce(F.sum("size").over(w), F.lit(0)))


def fragment_blocks(local: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Fragments as ranges where their rows are consecutive, else as explicit lists: (keys, first, size, is_range)."""
    f = local.groupBy(*keys).agg(F.min(row).alias("first"), F.max(row).alias("last"), F.count("*").alias("size"))
    return f.withColumn("is_range", F.col("last") - F.col("first") + 1 == F.col("size")).drop("last")


def pack_ragged(df: DataFrame, chunk: list[str], group: str, order: str, value: str) -> DataFrame:
    """(chunk, part, buffer, offsets, starts, groups): the values of a chunk's groups one behind the other.

    ``order`` is a whole number, distinct in a chunk; groups stand in ascending order, values by ``order``.  A chunk of
    more than PART values is cut into parts.  ``offsets`` tells where each group begins in the buffer, ``starts`` the
    place in the group of its first value there.
    """
    d = blocks.number(blocks.number(df.select(*chunk, group, order, value), chunk, order, "_i"), [*chunk, group], order, "_p")
    at = F.sort_array(F.collect_list(F.struct(F.col(group).alias("g"), F.col("_p").alias("p"), F.col(value).alias("v"))))
    p = d.groupBy(*chunk, F.floor(F.col("_i") / PART).alias("part")).agg(at.alias("a"))  # PART values at most
    each = lambda f: F.transform("a", lambda e: e[f])
    p = p.select(*chunk, "part", each("v").alias("buffer"), each("g").alias("_g"), each("p").alias("_p")).withColumn("groups", F.array_distinct("_g"))
    p = p.withColumn("offsets", F.transform("groups", lambda g: F.array_position("_g", g) - 1))
    return p.select(*chunk, "part", "buffer", "offsets", F.transform("offsets", lambda o: F.get("_p", o)).alias("starts"), "groups")


def unpack_ragged(packed: DataFrame, chunk: list[str], group: str, value: str) -> DataFrame:
    """(chunk, group, pos, value): the inverse of :func:`pack_ragged`; ``pos`` counts from 0 inside a group."""
    p = packed.select(*chunk, "buffer", "offsets", "starts", F.posexplode("groups").alias("i", group))
    first = F.get("offsets", F.col("i"))
    size = F.coalesce(F.get("offsets", F.col("i") + 1), F.size("buffer").cast("bigint")) - first
    out = p.select(*chunk, group, F.get("starts", F.col("i")).alias("_s"), F.posexplode(F.slice("buffer", (first + 1).cast("int"), size.cast("int"))).alias("_at", value))
    return out.select(*chunk, group, (F.col("_s") + F.col("_at")).alias("pos"), value)


def encode_fragments(local: DataFrame, keys: list[str], row: str, force_explicit: bool = False) -> DataFrame:
    """Fragments as ranges of rows where they are consecutive, else (or if forced) as sorted lists: one row for a fragment
    and PART rows of its chunk.
    """
    f = local.groupBy(*keys, F.floor(F.col(row) / PART).alias("part")).agg(F.min(row).alias("first"), F.count("*").alias("size"), F.max(row).alias("last"), F.sort_array(F.collect_list(row)).alias("rows"))
    whole = (F.col("last") - F.col("first") + 1 == F.col("size")) & F.lit(not force_explicit)
    return f.select(*keys, "part", whole.alias("is_range"), "first", "size", F.when(~whole, F.col("rows")).alias("rows"))


def decode_fragments(blocks: DataFrame, keys: list[str], row: str) -> DataFrame:
    """(keys, row): the inverse of :func:`encode_fragments`; a block whose list and size disagree raises."""
    n = F.when(F.col("is_range") | (F.size("rows") == F.col("size")), F.col("size")).otherwise(F.raise_error(F.lit("corrupt fragment")).cast("bigint"))
    rows = F.when(F.col("is_range"), F.sequence("first", F.col("first") + n - 1)).otherwise(F.filter("rows", lambda r: n >= 0))
    return blocks.select(*keys, F.explode(rows).alias(row))


def encode_manifests(places: DataFrame, object_: list[str], order: str, cell: str, fragment: str) -> DataFrame:
    """(object, cell, fragments as first, size, is_range): an object's places as blocks of one cell with rising fragments."""
    w = Window.partitionBy(*object_).orderBy(order)
    same = (F.col(cell).eqNullSafe(F.lag(cell).over(w))) & (F.col(fragment) == F.lag(fragment).over(w) + 1)
    b = places.withColumn("block", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w) - 1)
    return b.groupBy(*object_, "block", cell).agg(F.min(fragment).alias("first"), F.count("*").alias("size"))


def decode_manifests(blocks: DataFrame, object_: list[str], cell: str, fragment: str) -> DataFrame:
    """(object, entry, cell, fragment): the inverse of :func:`encode_manifests`; entries count from 0."""
    e = blocks.select(*object_, "block", cell, F.explode(F.when(F.col("first").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.sequence("first", F.col("first") + F.col("size") - 1))).alias(fragment))
    w = Window.partitionBy(*object_).orderBy("block", fragment)
    return e.withColumn("entry", F.row_number().over(w) - 1).select(*object_, "entry", cell, fragment)
