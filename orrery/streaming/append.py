"""Streams of vertices: exactly-once appends to a store, and cells counted over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.functions.grid import cell
from orrery.sources.store import GeometryStore


def append_stream(rows: DataFrame, store: GeometryStore, checkpoint: str) -> StreamingQuery:
    """Append a stream of vertices(vid, x, y[, z, oid, seq]) batch by batch.

    The number of the last committed batch is kept in the store's headers, for each stream by the id that its checkpoint
    gives it, and saved together with the new version: a batch that is replayed after a failure is written once, and a
    second stream, or the same one with a new checkpoint, starts at its own first batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        key = "stream/" + str(batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"))
        if store.meta.headers.get(key, -1) >= number:
            return
        store.stage("vertices", store.with_grid(batch))
        store.meta.headers[key] = number
        store.commit(f"batch {number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_cells(rows: DataFrame, size: float, at: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Vertices per cell and event-time window; rows later than the watermark are dropped by Spark."""
    stamped = rows.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late)
    g = stamped.groupBy(F.window("_t", window).alias("w"), cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
    return g.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "cx", "cy", "n")
