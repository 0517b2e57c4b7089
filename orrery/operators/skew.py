"""Per-key work when a few keys hold most rows: fragment-replicate by estimated load.

1. *Estimate*: the rows are counted per key (a hash of it), combined before the shuffle.
2. *Split*: a key heavier than the target load of a task is cut into as many shards as its load needs.
3. *Pack*: shards of heavy keys and hash buckets of light ones are packed into tasks, heaviest first into the least
   loaded task.
4. *Run*: rows go to a shard of their key; the matching side of a join is copied to the shards of its key and to no
   others, and a light key is never copied; partial results per (key, shard) are merged per key in the key's task.

A heavy key holds more than one part in ``SHARDS_PER_TASK * tasks`` of all rows, so there are fewer heavy keys than that
number; they and ``BUCKETS_PER_TASK * tasks`` bucket loads are all that reaches the driver or is broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.plans.staging import stage

BUCKETS_PER_TASK = 8
SHARDS_PER_TASK = 4


@dataclass(frozen=True)
class LoadPlan:
    """Tasks of the shards of every heavy key (by its hash) and of the bucket of every light one."""

    tasks: int
    total: int
    heavy: dict[int, tuple[int, ...]]
    light: tuple[int, ...]

    def route(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Add ``_tasks``: the tasks of the shards of the row's key."""
        spark: SparkSession = df.sparkSession
        heavy = spark.createDataFrame([(h, list(t)) for h, t in self.heavy.items()], "_h bigint, _heavy array<int>")
        light = spark.createDataFrame(list(enumerate(self.light)), "_bucket int, _light int")
        h = F.xxhash64(*[F.col(k) for k in keys])
        out = df.withColumns({"_h": h, "_bucket": F.pmod(h, F.lit(len(self.light))).cast("int")})
        out = out.join(F.broadcast(heavy), "_h", "left").join(F.broadcast(light), "_bucket")  # both bounded by tasks, see above
        return out.withColumn("_tasks", F.coalesce("_heavy", F.array("_light"))).drop("_h", "_bucket", "_heavy", "_light")


def pack(heavy: dict[int, int], light: Sequence[int], tasks: int) -> LoadPlan:
    """Cut heavy keys into shards and pack shards and light buckets into tasks, heaviest first into the least loaded.

    ``heavy`` maps a key's hash to its rows, ``light`` has the rows of every bucket.
    """
    total = sum(heavy.values()) + sum(light)
    target = max(1, -(-total // (tasks * SHARDS_PER_TASK)))
    pieces: list[tuple[float, int, int]] = [(n, 0, b) for b, n in enumerate(light)]
    for h, n in heavy.items():
        shards = min(tasks * SHARDS_PER_TASK, max(1, -(-n // target)))
        pieces += [(n / shards, 1, h)] * shards
    heap = [(0.0, t) for t in range(tasks)]
    of_key: dict[int, list[int]] = {h: [] for h in heavy}
    of_bucket = [0] * len(light)
    for load, kind, k in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        sum_, t = heapq.heappop(heap)
        if kind:
            of_key[k].append(t)
        else:
            of_bucket[k] = t
        heapq.heappush(heap, (sum_ + load, t))
    return LoadPlan(tasks, total, {h: tuple(t) for h, t in of_key.items()}, tuple(of_bucket))


def estimate(df: DataFrame, keys: Sequence[str], tasks: int | None = None) -> LoadPlan:
    """Count the rows of ``df`` per key (one pass, combined before the shuffle) and pack them.

    ``df`` may be empty; null key values form keys of their own.  Keys of equal 64-bit hash count as one.
    """
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = tasks * BUCKETS_PER_TASK
    n = stage(df.groupBy(F.xxhash64(*[F.col(k) for k in keys]).alias("h")).agg(F.count("*").alias("n")), "loads")
    total = n.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * (tasks * SHARDS_PER_TASK) > F.lit(total)
    heavy = {r[0]: r[1] for r in n.filter(hot).select("h", "n").collect()}  # fewer than tasks * SHARDS_PER_TASK rows
    light = [0] * buckets
    for b, m in n.filter(~hot).groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("b")).agg(F.sum("n")).collect():
        light[b] = m
    return pack(heavy, light, tasks)


def sharded(df: DataFrame, keys: Sequence[str], plan: LoadPlan, by: Sequence[Column]) -> DataFrame:
    """Add ``_shard`` and ``_task``: the shard of the row's key, chosen by a hash of ``by``, and where it is packed.

    ``by`` should tell the rows of a key apart; copies of one row share a shard.
    """
    out = plan.route(df, keys)
    out = out.withColumn("_shard", F.pmod(F.xxhash64(*by), F.size("_tasks")).cast("int"))
    return out.withColumn("_task", F.get("_tasks", F.col("_shard"))).drop("_tasks")


def aggregate(
    df: DataFrame,
    keys: Sequence[str],
    partial: dict[str, Column],
    merge: dict[str, Column],
    by: Sequence[Column],
    plan: LoadPlan | None = None,
) -> DataFrame:
    """Per-key results in two steps: ``partial`` per (key, shard), ``merge`` per key over the partial columns.

    Rows are combined before the first shuffle, and a key's shuffled partials are spread over its shards, so no task
    receives a hot key whole; the partials of a key then meet in the task that the packing gives to its first shard.
    Null key values group together, as in GROUP BY; an empty input gives no rows.
    """
    plan = plan or estimate(df, keys)
    routed = plan.route(df, keys)
    shard = F.pmod(F.xxhash64(*by), F.size("_tasks")).cast("int")
    first = routed.withColumns({"_shard": shard, "_home": F.get("_tasks", F.lit(0))}).groupBy("_home", "_shard", *keys)
    parts = first.agg(*[c.alias(n) for n, c in partial.items()]).repartitionById(plan.tasks, F.col("_home"))
    return parts.groupBy("_home", *keys).agg(*[c.alias(n) for n, c in merge.items()]).drop("_home")


def join(left: DataFrame, right: DataFrame, keys: Sequence[str], plan: LoadPlan, by: Sequence[Column]) -> DataFrame:
    """Inner join of a skewed ``left`` with ``right`` on ``keys``, routed by ``plan``.

    Left rows go to one shard of their key; right rows are copied to the shards of their key only.  The tasks are those
    of the packing: both sides are partitioned by ``_task`` itself.  A null key matches nothing, as in SQL.  Columns of
    ``right`` whose names clash with ``left`` (keys aside) must be renamed before.
    """
    r = plan.route(right, keys).select("*", F.posexplode("_tasks").alias("_shard", "_task")).drop("_tasks")
    l = sharded(left, keys, plan, by)
    l = l.repartitionById(plan.tasks, F.col("_task"))
    r = r.repartitionById(plan.tasks, F.col("_task"))
    return l.join(r.hint("shuffle_hash"), ["_task", "_shard", *keys])
