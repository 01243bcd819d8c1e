"""Request streams: workflow changes applied incrementally with Structured Streaming.

Requests (status changes, favourite clicks) arrive as an event stream. The
same set-based rules as the batch jobs in ``operators.changes`` apply:

* status updates keep, per listing, the last valid request by (ts, event_id)
  in the streaming state store (``max_by`` aggregation, update mode); every
  micro-batch writes its changed listings to a folder of its batch id, and
  the last change per listing is resolved when the changes are read;
* favourite clicks pass the key checks with stream-static semi-joins and are
  appended by the exactly-once parquet file sink.

Both run with ``trigger(availableNow=True)``: everything present is
processed, then the query stops (a scheduled incremental job); with a
processing-time trigger the same code runs continuously.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abode.session import scratch_path
from abode.sources.tpch_binding import ListingTables, favorite_click_requests, status_update_requests


def event_stream(spark: SparkSession, sf_dir: str, events_dir: str | None = None) -> DataFrame:
    """The events table as a file stream (schema fixed, no inference).

    By default the driver's ``events.parquet``; ``events_dir`` names a folder
    that receives event files over time (one micro-batch per file).
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    if events_dir:
        return reader.parquet(events_dir)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


CHANGE = "house_id string, statue string, ts timestamp, event_id bigint"


def _write_changes(base: str):
    """foreachBatch body: the batch's changed listings, in a folder of the batch id.

    Nothing is read back or overwritten but the folder of the same batch, so a
    replayed batch leaves the same files and a crash loses no earlier change.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.select("house_id", "_last.*").write.mode("overwrite").parquet(f"{base}/batch={batch_id}")
    return run


def stream_status_updates(spark: SparkSession, sf_dir: str, events_dir: str | None = None,
                          state_dir: str | None = None) -> DataFrame:
    """Apply the status-change request stream; return the resulting status table.

    ``state_dir`` (in the shared store) holds the stream's checkpoint and
    changes: a later call with the same folder goes on where this one ended.
    """
    t = ListingTables(spark, sf_dir)
    base = state_dir or scratch_path(spark, "status_stream")
    reqs = status_update_requests(event_stream(spark, sf_dir, events_dir)) \
        .join(t.admins.select("admin_id"), "admin_id", "left_semi")
    latest = reqs.groupBy("house_id").agg(
        F.max_by(F.struct("statue", "ts", "event_id"), F.struct("ts", "event_id")).alias("_last"))
    spark.createDataFrame([], CHANGE).write.mode("overwrite").parquet(f"{base}/changes/batch=-1")
    q = latest.writeStream.outputMode("update").foreachBatch(_write_changes(f"{base}/changes")) \
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    changes = spark.read.schema(CHANGE).parquet(f"{base}/changes")
    last = changes.groupBy("house_id").agg(F.max_by("statue", F.struct("ts", "event_id")).alias("_new"))
    return t.listing_status.join(last, "house_id", "left").select(
        "house_id", F.coalesce("_new", "statue").alias("statue"), "poster_id")


def stream_add_favorites(spark: SparkSession, sf_dir: str, events_dir: str | None = None,
                         state_dir: str | None = None) -> DataFrame:
    """Apply the favourite-click stream; return the resulting favourites (a bag)."""
    t = ListingTables(spark, sf_dir)
    base = state_dir or scratch_path(spark, "favorites_stream")
    clicks = favorite_click_requests(event_stream(spark, sf_dir, events_dir)).select("user_id", "house_id")
    ok = clicks.join(t.users.select("user_id"), "user_id", "left_semi") \
        .join(t.listings.select("house_id"), "house_id", "left_semi")
    q = ok.writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/added") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    added = spark.read.schema("user_id string, house_id string").parquet(f"{base}/added")
    return t.favorites.select("user_id", "house_id").unionByName(added)
