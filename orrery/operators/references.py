"""References to records that do not exist, through runs of parent keys.

Sorted integer parent keys of one domain are compressed into contiguous runs that share one state (all rows deleted,
or the time of the earliest living row).  A reference is matched as-of to the preceding run start: beyond the run's
end its target is missing, else the run's state tells whether it is deleted or late.  Keys are cut into blocks of
BLOCK consecutive values, so no task sorts a whole domain, and distinct referenced keys are matched instead of
references, so a key that holds a third of all references is matched once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.grid import chunk_key, with_cells
from orrery.plans.sizing import small
from orrery.plans.staging import stage

BLOCK = 1 << 16
NOWHERE = -(1 << 31)  #: stands for a null part of a reference's domain, which no parent has
DOMAIN = ["kind", "d1", "d2", "d3"]


def _block(key: str) -> Column:
    return F.floor(F.col(key) / F.lit(BLOCK)).cast("bigint")


def _state() -> list[Column]:
    alive = F.col("deleted_at").isNull()
    return [F.max(alive).alias("alive"), F.min(F.when(alive, F.col("written_at"))).alias("first_at")]


def key_runs(parents: DataFrame) -> DataFrame:
    """(domain, block, key = run start, run_end, alive, first_at) of parents(domain, key, alive, first_at).

    ``parents`` has one row per domain and key.
    """
    w = Window.partitionBy(*DOMAIN, "block").orderBy("key")
    p = parents.withColumn("block", _block("key"))
    same = (
        (F.col("key") == F.lag("key").over(w) + 1)
        & F.col("alive").eqNullSafe(F.lag("alive").over(w))
        & F.col("first_at").eqNullSafe(F.lag("first_at").over(w))
    )
    p = p.withColumn("run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    return p.groupBy(*DOMAIN, "block", "run").agg(
        F.min("key").alias("key"), F.max("key").alias("run_end"), F.first("alive").alias("alive"), F.first("first_at").alias("first_at")
    ).drop("run")


def match_runs(runs: DataFrame, keys: DataFrame) -> DataFrame:
    """As-of match of keys(domain, key, ...) to the preceding run start; adds found, alive, first_at."""
    r = runs.select(*DOMAIN, "block", "key", F.struct("run_end", "alive", "first_at").alias("_run"), F.lit(0).alias("_side"))
    k = keys.withColumn("block", _block("key")).withColumn("_side", F.lit(1))
    w = Window.partitionBy(*DOMAIN, "block").orderBy("key", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(k, allowMissingColumns=True).withColumn("_at", F.last("_run", ignorenulls=True).over(w))
    hit = F.coalesce(F.col("key") <= F.col("_at.run_end"), F.lit(False))
    return both.filter("_side = 1").select(
        *keys.columns, hit.alias("found"), F.col("_at.alive").alias("alive"), F.col("_at.first_at").alias("first_at")
    )


def broken(parents: DataFrame, refs: DataFrame) -> DataFrame:
    """References of refs(ref_table, ref_id, pos, domain, key, written_at) whose target is missing, deleted or late.

    Keys that are certainly fine (found, alive, first written no later than any reference to them) drop out before
    the references are joined; copies of a reference are reported once.  Broken keys are broadcast if their measured
    bytes allow; more of them are joined by a shuffle, whose hot keys AQE splits.
    """
    keys = refs.groupBy(*DOMAIN, "key").agg(F.min("written_at").alias("earliest"))
    m = match_runs(key_runs(parents), keys)
    bad = m.filter(~F.col("found") | ~F.col("alive") | (F.col("first_at") > F.col("earliest")))
    bad = small(stage(bad.select(*DOMAIN, "key", "found", "alive", "first_at"), "broken-keys"))  # where broadcast, a hot broken key moves no rows
    reason = (
        F.when(~F.col("found"), F.lit("missing"))
        .when(~F.col("alive"), F.lit("deleted"))
        .when(F.col("first_at") > F.col("written_at"), F.lit("late"))
    )
    out = refs.join(bad, [*DOMAIN, "key"]).withColumn("reason", reason).filter("reason IS NOT NULL")
    period = F.substring(F.col("written_at").cast("string"), 1, 7)
    return out.select("ref_table", "ref_id", "pos", "reason", period.alias("period")).distinct()


def _domain(kind: int, d1: Column | None = None, d2: Column | None = None, d3: Column | None = None) -> list[Column]:
    num = lambda c: F.coalesce(c.cast("int"), F.lit(NOWHERE)) if c is not None else F.lit(0)
    return [F.lit(kind).alias("kind"), num(d1).alias("d1"), num(d2).alias("d2"), (d3 if d3 is not None else F.lit("")).alias("d3")]


VERTEX, PLACE, OBJECT = 0, 1, 2


def geometry_parents(vertices: DataFrame, root: DataFrame, objects: DataFrame) -> DataFrame:
    """Parents of the three kinds: vertices by vid, places by fragment within a chunk, objects by oid."""
    by_vid = vertices.groupBy("dataset_id", "level", "vid").agg(*_state()).select(
        *_domain(VERTEX, F.col("dataset_id"), F.col("level")), F.col("vid").alias("key"), "alive", "first_at"
    )
    placed = with_cells(vertices.select("dataset_id", "level", "x", "y", "z", "fragment", "written_at", "deleted_at"), root)
    by_place = placed.groupBy("dataset_id", "level", "cx", "cy", "cz", "fragment").agg(*_state()).select(
        *_domain(PLACE, F.col("dataset_id"), F.col("level"), chunk_key([F.col(f"c{a}") for a in "xyz"])),
        F.col("fragment").alias("key"), "alive", "first_at",
    )
    by_oid = objects.groupBy("dataset_id", "oid").agg(*_state()).select(
        *_domain(OBJECT, F.col("dataset_id")), F.col("oid").cast("bigint").alias("key"), "alive", "first_at"
    )
    every = reduce(DataFrame.unionByName, [by_vid, by_place, by_oid])
    return every.filter(f"key IS NOT NULL AND d1 <> {NOWHERE} AND d2 <> {NOWHERE}")


def geometry_references(objects: DataFrame, links: DataFrame, groupings: DataFrame) -> DataFrame:
    """All references of the three tables; a null key, chunk_key or entry is no reference."""
    entry = objects.select("manifest_id", "dataset_id", "level", "written_at", F.posexplode("manifest").alias("pos", "e"))
    from_objects = entry.filter("e.chunk_key IS NOT NULL").select(
        F.lit("object_index").alias("ref_table"), F.col("manifest_id").alias("ref_id"), "pos",
        *_domain(PLACE, F.col("dataset_id"), F.col("level"), F.col("e.chunk_key")), F.col("e.fragment").alias("key"), "written_at",
    )
    end = F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.col("level").cast("int").alias("at"), F.col("src_vid").alias("key")),
        F.struct(F.lit(1).alias("pos"), (F.col("level") + F.col("delta")).cast("int").alias("at"), F.col("dst_vid").alias("key")),
    ))
    from_links = links.select("link_id", "dataset_id", "written_at", end.alias("e")).select(
        F.lit("cross_chunk_links").alias("ref_table"), F.col("link_id").alias("ref_id"), F.col("e.pos").alias("pos"),
        *_domain(VERTEX, F.col("dataset_id"), F.col("e.at")), F.col("e.key").alias("key"), "written_at",
    )
    from_groups = groupings.select(
        F.lit("groupings").alias("ref_table"), F.col("member_id").alias("ref_id"), F.lit(0).alias("pos"),
        *_domain(OBJECT, F.col("dataset_id")), F.col("oid").cast("bigint").alias("key"), "written_at",
    )
    return reduce(DataFrame.unionByName, [from_objects, from_links, from_groups]).filter("key IS NOT NULL")


def geometry_broken(vertices: DataFrame, root: DataFrame, objects: DataFrame, links: DataFrame, groupings: DataFrame) -> DataFrame:
    """Broken references of object_index, cross_chunk_links and groupings; no rows for empty tables."""
    return broken(geometry_parents(vertices, root, objects), geometry_references(objects, links, groupings))
