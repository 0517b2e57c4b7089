"""Numbers and running sums inside groups of any size: the groups are cut into blocks of consecutive ids.

A window over a whole group would gather a hot group in one task.  Here totals are taken per block first, their running
sums over blocks (one row a block) second, and a window inside each block last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 14  #: consecutive ids of a block


def before(df: DataFrame, keys: Sequence[str], order: str, value: str | None, name: str, block: int = BLOCK) -> DataFrame:
    """Add ``name``: the sum of ``value`` (the number of rows, if None) over the rows of the group with smaller ``order``.

    ``order`` is a whole number without nulls, distinct inside a group; nulls of ``value`` count as 0, and null keys form
    a group of their own.  An empty table gives no rows.
    """
    amount: Column = F.lit(1).cast("bigint") if value is None else F.coalesce(F.col(value).cast("bigint"), F.lit(0).cast("bigint"))
    d = df.withColumn("_b", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    total = d.groupBy(*keys, "_b").agg(F.sum(amount).alias("_t"))
    back = Window.unboundedPreceding, -1
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(*back)
    base = total.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_base"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_b") == F.col("_kb")]
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(*back)), F.lit(0))
    out = d.withColumn("_in", inside).join(base, same)
    return out.withColumn(name, (F.col("_in") + F.col("_base")).cast("bigint")).drop("_b", "_in", "_base", "_kb", *[f"_k{i}" for i in range(len(keys))])


def number(df: DataFrame, keys: Sequence[str], order: str, name: str, block: int = BLOCK) -> DataFrame:
    """Add ``name``: the place of a row in its group by ``order``, from 0."""
    return before(df, keys, order, None, name, block)
