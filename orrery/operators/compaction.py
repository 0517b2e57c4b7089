"""Far too many small files: cumulative-size grouping of a frozen manifest.

The manifest (one row per small file) is ordered, its bytes are summed along that order, and each file goes to the
group in whose target-sized interval it begins.  Planning is SQL only.  The running sum is taken in two steps,
inside blocks of consecutive file ids and over the blocks' totals, so no task orders a whole dataset's files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import coarsen
from orrery.plans import staging
from orrery.plans.sizing import small

TARGET_BYTES = 128 << 20
BYTES_PER_ROW = 16
BLOCK = 4096
NO_FILE = (1 << 63) - 1  #: place of rows without a file in the order of files


def frozen_manifest(vertices: DataFrame, index: DataFrame) -> DataFrame:
    """One row per file that is listed in ``index`` or has rows in ``vertices``.

    Columns: file_id, dataset_id, level, n_rows (0 if the file has none), listed, least and most n_records of its
    index rows (copies of an index row add nothing), bytes (nbytes; where null or unlisted BYTES_PER_ROW a row).
    Rows with a null file_id belong to no file.
    """
    return vertices.sparkSession.sql(
        f"""
        WITH held AS (
          SELECT file_id, min(dataset_id) AS dataset_id, min(level) AS level, count(*) AS n_rows
          FROM {{v}} WHERE file_id IS NOT NULL GROUP BY file_id),
        listed AS (
          SELECT file_id, min(dataset_id) AS dataset_id, min(level) AS level, min(n_records) AS lo,
                 max(n_records) AS hi, max(nbytes) AS nbytes
          FROM {{s}} WHERE file_id IS NOT NULL GROUP BY file_id)
        SELECT file_id, coalesce(h.dataset_id, l.dataset_id) AS dataset_id, coalesce(h.level, l.level) AS level,
               coalesce(h.n_rows, 0) AS n_rows, l.file_id IS NOT NULL AS listed, lo, hi,
               greatest(coalesce(nbytes, {BYTES_PER_ROW} * coalesce(n_rows, 0)), 0) AS bytes
        FROM held h FULL OUTER JOIN listed l USING (file_id)
        """,
        v=vertices.select("file_id", "dataset_id", "level"),
        s=index.select("file_id", "dataset_id", "level", "n_records", "nbytes"),
    )


def plan_groups(manifest: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Add ``group_no``: the target-sized interval of the bytes before the file, per dataset and level, by file_id.

    A file is never cut, so a group exceeds the target by less than one file.  Files without rows keep their place in
    the order but take no bytes.
    """
    return manifest.sparkSession.sql(
        f"""
        WITH m AS (SELECT *, CAST(floor(file_id / {BLOCK}) AS BIGINT) AS block,
                          CASE WHEN n_rows > 0 THEN bytes ELSE 0 END AS w FROM {{m}}),
        blocks AS (SELECT dataset_id, level, block, sum(w) AS w FROM m GROUP BY dataset_id, level, block),
        before AS (SELECT dataset_id AS d, level AS l, block AS b,
                          coalesce(sum(w) OVER (PARTITION BY dataset_id, level ORDER BY block
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM blocks),
        run AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY dataset_id, level, block ORDER BY file_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM m)
        SELECT run.* EXCEPT (block, w, inside), CAST(floor((base + inside) / {int(target_bytes)}) AS BIGINT) AS group_no
        FROM run JOIN before ON dataset_id <=> d AND level <=> l AND block = b
        """,
        m=manifest,
    )


def repeats(vertices: DataFrame) -> DataFrame:
    """(vid, file_id, first_file): vertices held by more than one file, without the file of smallest id.

    Vertices are reduced to their least and greatest file first; only those in several files are joined back.
    """
    v = vertices.select("vid", "file_id").filter("vid IS NOT NULL AND file_id IS NOT NULL")
    several = v.groupBy("vid").agg(F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file"))
    several = several.filter("last_file > first_file").drop("last_file")
    return v.join(several, "vid").filter("file_id > first_file").distinct()


def issues(plan: DataFrame, repeated: DataFrame) -> DataFrame:
    """(dataset_id, level, group_no, file_id, issue): where data and index of a planned file do not agree.

    ``unlisted`` has rows but no index row, ``empty`` the reverse, ``count`` an index row whose non-null n_records
    differs from the rows held, ``repeat`` a vertex that a file of smaller id holds as well.
    """
    state = (
        F.when(~F.col("listed"), F.lit("unlisted"))
        .when(F.col("n_rows") == 0, F.lit("empty"))
        .when((F.col("lo") != F.col("n_rows")) | (F.col("hi") != F.col("n_rows")), F.lit("count"))
    )
    again = plan.join(repeated.select("file_id").distinct().withColumn("_again", F.lit("repeat")), "file_id", "left")
    both = F.filter(F.array(state, F.col("_again")), lambda i: i.isNotNull())
    return again.select("dataset_id", "level", "group_no", "file_id", F.explode(both).alias("issue"))


def found(vertices: DataFrame, index: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Issues of all planned files with their groups; no rows for empty tables.

    The plan is frozen first: what is reported holds for the groups that a rewrite of this plan would make.
    """
    plan = staging.stage(plan_groups(frozen_manifest(vertices, index), target_bytes), "plan")
    return issues(plan, repeats(vertices))


def _file() -> Column:
    """The file of a row as an order: rows without one come after all files."""
    return F.coalesce("file_id", F.lit(NO_FILE))


def _loose_part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("vid", "x", "y", "z"), parts)


def loose_plan(vertices: DataFrame, plan: DataFrame, target_bytes: int) -> DataFrame:
    """(dataset_id, level, first_group, parts) of the rows that name no file: target-sized parts after all planned groups."""
    n = vertices.filter("file_id IS NULL").groupBy("dataset_id", "level").agg(F.count("*").alias("n"))
    top = plan.groupBy(F.col("dataset_id").alias("_d"), F.col("level").alias("_l")).agg((F.max("group_no") + 1).alias("_g"))
    parts = F.ceil(F.col("n") * BYTES_PER_ROW / F.lit(float(target_bytes))).cast("bigint")
    out = n.join(top, F.col("dataset_id").eqNullSafe(F.col("_d")) & F.col("level").eqNullSafe(F.col("_l")), "left")
    return out.select("dataset_id", "level", F.coalesce("_g", F.lit(0)).cast("bigint").alias("first_group"), F.greatest(parts, F.lit(1)).alias("parts"))


def compaction_plan(vertices: DataFrame, index: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """One row per file with rows: its group, and how many records it contributes.

    A vertex is taken from the file of smallest id, once; a row without a vid is a record of its own.  Rows that name no
    file are cut into target-sized parts by a hash and planned as groups of their own (file_id null), after the files;
    a vertex that a file holds as well is taken from the file.
    """
    files = staging.stage(plan_groups(frozen_manifest(vertices, index), target_bytes).filter("n_rows > 0"), "files")
    loose = staging.stage(loose_plan(vertices, files, target_bytes), "loose")
    none = vertices.filter("vid IS NULL")
    keep = vertices.filter("vid IS NOT NULL").groupBy("vid").agg(F.min("file_id").alias("file_id")).select("file_id").unionByName(none.select("file_id"))
    keep = keep.filter("file_id IS NOT NULL").groupBy("file_id").agg(F.count("*").alias("keep_rows"))
    out = files.join(keep, "file_id", "left").withColumn("keep_rows", F.coalesce("keep_rows", F.lit(0).cast("bigint")))
    out = out.select("file_id", "dataset_id", "level", "group_no", "n_rows", "keep_rows", "bytes")
    if loose.isEmpty():
        return out
    where = F.struct("dataset_id", "level", "x", "y", "z")
    only = vertices.filter("vid IS NOT NULL").groupBy("vid").agg(F.min("file_id").alias("f"), F.min(where).alias("m")).filter("f IS NULL").select("vid", "m.*")
    only = only.unionByName(none.filter("file_id IS NULL").select(*only.columns))
    place = ["dataset_id", "level", "group_no"]
    held = _with_loose_group(vertices.filter("file_id IS NULL"), loose).groupBy(*place).agg(F.count("*").alias("n_rows"))
    mine = _with_loose_group(only, loose).groupBy(*place).agg(F.count("*").alias("keep_rows"))
    rows = coarsen.match(held, mine, place, "left").select(
        F.lit(None).cast("bigint").alias("file_id"), *place, "n_rows", F.coalesce("keep_rows", F.lit(0).cast("bigint")).alias("keep_rows"), (F.col("n_rows") * BYTES_PER_ROW).alias("bytes")
    )
    return out.unionByName(rows)


def _with_loose_group(rows: DataFrame, loose: DataFrame) -> DataFrame:
    got = coarsen.match(rows, loose, ["dataset_id", "level"])
    return got.withColumn("group_no", F.col("first_group") + _loose_part(F.col("parts"))).drop("first_group", "parts")


def rewrite(vertices: DataFrame, plan: DataFrame, path: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Write every record once to ``path``, one folder per (dataset_id, level, group_no), and reconcile the counts.

    Of the copies of a vertex in its first file the earliest written stays, of equals the one of least hash.  Rows
    without a vid are kept as they stand.  Returns (dataset_id, level, group_no, rows_in, planned, written) with
    ``written`` read back from the files; ``planned`` equals ``written`` unless rows were lost or doubled, and rows_in
    less written are copies.
    """
    group = ["dataset_id", "level", "group_no"]
    files = plan.filter("file_id IS NOT NULL")
    v = vertices.withColumn("_f", _file())
    several = v.filter("vid IS NOT NULL").groupBy("vid").agg(F.min("_f").alias("first"), F.max("_f").alias("last")).filter("last > first")
    later = v.select("vid", "_f").join(several.drop("last"), "vid").filter("_f > first").select("vid", "_f").distinct()
    rows = v.join(small(staging.stage(later, "repeats")), ["vid", "_f"], "left_anti")
    moved = rows.filter("file_id IS NOT NULL").drop("dataset_id", "level").join(small(files.select("file_id", *group)), "file_id")
    loose = staging.stage(loose_plan(vertices, files, target_bytes), "loose")
    if not loose.isEmpty():
        moved = moved.unionByName(_with_loose_group(rows.filter("file_id IS NULL"), loose))
    moved = moved.drop("_f").repartition(*group)
    other = [c for c in moved.columns if c not in ("vid", *group)]  # copies inside a file merge where the group is written
    best = F.min_by(F.struct(*other), F.struct("written_at", F.xxhash64(*other)))
    once = moved.filter("vid IS NOT NULL").groupBy(*group, "vid").agg(best.alias("r")).select("vid", *group, "r.*")
    once.unionByName(moved.filter("vid IS NULL")).write.partitionBy(*group).parquet(path)
    back = vertices.sparkSession.read.schema("vid bigint, dataset_id int, level int, group_no bigint").parquet(path).groupBy(*group).agg(F.count("*").alias("written"))
    want = plan.groupBy(*group).agg(F.sum("n_rows").alias("rows_in"), F.sum("keep_rows").alias("planned"))
    return coarsen.match(want, back, group, "left").select(*group, "rows_in", "planned", F.coalesce("written", F.lit(0).cast("bigint")).alias("written"))


def compact(vertices: DataFrame, index: DataFrame, path: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Plan, rewrite to ``path`` and reconcile."""
    plan = staging.stage(compaction_plan(vertices, index, target_bytes), "compaction-plan")
    return rewrite(vertices, plan, path, target_bytes)
