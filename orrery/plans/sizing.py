"""Numbers of tasks that follow the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 100_000
BROADCAST_BYTES = 64 << 20  #: a table above this is never broadcast
UNKNOWN = 1 << 50  #: the optimizer's estimate where it knows nothing is larger than this


def tasks_for(df: DataFrame, bytes_per_task: int = 2 << 20) -> int:
    """Tasks for ``df`` by the optimizer's estimate of its bytes, no fewer than three a core or the session's setting."""
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size > UNKNOWN else min(MOST, max(least, -(-size // bytes_per_task)))


def tasks_of(spark: SparkSession, n: int, per_task: int) -> int:
    """Tasks for ``n`` things, ``per_task`` in each, no fewer than the session's setting."""
    return min(MOST, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // per_task)))


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a staged table in memory, measured by one pass: strings and lists by their lengths, other columns by width."""
    fixed, parts = 16, []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        fixed += 8
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(f.name).cast("bigint"), F.lit(0)))
        elif kind in ("array", "map"):
            parts.append(F.greatest(F.coalesce(F.size(f.name), F.lit(0)), F.lit(0)) * 16)
    total = sum(parts, F.lit(0).cast("bigint")) + F.lit(fixed)
    return df.agg(F.sum(total)).first()[0] or 0


def small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a staged table for broadcast if its measured bytes allow; a larger one is shuffled."""
    return F.broadcast(df) if measured_bytes(df) <= most_bytes else df
