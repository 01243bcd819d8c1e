"""Request streams over several micro-batches equal the batch change jobs."""
from pyspark.sql import functions as F

from abode.operators import changes as X
from abode.session import scratch_path
from abode.sources.tpch_binding import ListingTables
from abode.streaming.requests import stream_add_favorites, stream_status_updates
from tests.conftest import SF_SMALL


def bag(df):
    return sorted(tuple(r) for r in df.collect())


def split_events(spark):
    """Events written as 4 files in an order unrelated to time (4 micro-batches)."""
    path = scratch_path(spark, "events_split")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.repartition(4, (F.col("event_id") * 7919) % 4).write.parquet(path)
    return path


def test_status_stream_matches_batch(spark):
    t = ListingTables(spark, SF_SMALL)
    want = X.update_status(t.listing_status, t.admins, t.batch_status_updates())
    got = stream_status_updates(spark, SF_SMALL, events_dir=split_events(spark))
    assert bag(got) == bag(want)


def test_favorite_stream_matches_batch(spark):
    t = ListingTables(spark, SF_SMALL)
    want = X.add_favorites(t.favorites, t.users, t.listings, t.batch_add_favorites())
    got = stream_add_favorites(spark, SF_SMALL, events_dir=split_events(spark))
    assert bag(got) == bag(want)


def test_status_stream_goes_on_in_its_folder(spark):
    """Events that arrive between two runs with one state folder: nothing earlier is lost."""
    t = ListingTables(spark, SF_SMALL)
    events, state = scratch_path(spark, "events_later"), scratch_path(spark, "state")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.filter("event_id % 2 = 0").write.parquet(f"{events}/a")
    stream_status_updates(spark, SF_SMALL, events_dir=f"{events}/*", state_dir=state)
    ev.filter("event_id % 2 = 1").write.parquet(f"{events}/b")
    got = stream_status_updates(spark, SF_SMALL, events_dir=f"{events}/*", state_dir=state)
    assert bag(got) == bag(X.update_status(t.listing_status, t.admins, t.batch_status_updates()))
