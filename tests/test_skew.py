"""A listing holding a third of all favourites is split across tasks by AQE, in single joins and in chains."""
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from abode.operators import activity as A
from abode.operators import changes as X
from abode.operators.dedup import dedup_cascade
from abode.schema import STATUS_SELLING
from abode.sources.files import write_table
from abode.sources.tpch_binding import ListingTables
from tests.conftest import SF_SMALL

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextmanager
def small_thresholds(spark):
    old = {k: spark.conf.get(k, None) for k in CONF}
    try:
        for k, v in CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def t(spark):
    return ListingTables(spark, SF_SMALL)


@pytest.fixture(scope="module")
def skewed(spark, t):
    """Favourites of which a third are of one active listing, dealt over 12 map tasks."""
    fav = t.favorites.join(t.active.select("house_id"), "house_id", "left_semi").select("user_id", "house_id")
    hot = fav.groupBy("house_id").count().orderBy(F.col("count").desc(), "house_id").first()["house_id"]
    n, mine = t.favorites.count(), fav.filter(F.col("house_id") == hot)
    k = max(1, n // (2 * mine.count()))
    # distinct users per copy (identical rows would compress to nothing in the shuffle)
    extra = mine.select(F.posexplode(F.array_repeat(F.col("user_id"), k)).alias("_i", "_u"), "house_id") \
        .select(F.concat(F.col("_u"), F.lit("#"), F.sha1(F.col("_i").cast("string"))).alias("user_id"), "house_id")
    out = t.favorites.unionByName(extra).repartition(12).cache()
    assert out.filter(F.col("house_id") == hot).count() * 4 >= out.count()
    yield out
    out.unpersist()


SHAPES = {
    "favorites_all": lambda t, f: A.favorites_all(t.listings, f),
    "favorites_active": lambda t, f: A.favorites_active(t.listings, f, t.listing_status),
    "processing_queue": lambda t, f: A.processing_queue(
        t.listings, f, t.listing_status.withColumn("statue", F.lit("Đang xử lý"))),
    "favorites_count": lambda t, f: A.favorites_active(t.listings, f, t.listing_status).groupBy("user_id").count(),
    "dedup_cascade": lambda t, f: dedup_cascade(t.listings, f, t.deposits, t.listing_status).favorites,
    "add_favorites": lambda t, f: X.add_favorites(
        t.favorites, f.select("user_id").distinct(), t.listings, f),
    "admin_cancel": lambda t, f: X.admin_cancel(
        t.listing_status, f, t.spark.read.parquet(write_table(t.batch_admin_cancel(), "cancel_batch"))).deposits,
}


@pytest.mark.parametrize("name", SHAPES)
def test_hot_listing_is_split(spark, t, skewed, name):
    want = SHAPES[name](t, skewed).count()
    with small_thresholds(spark):
        out = SHAPES[name](t, skewed)
        rows = len(out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    assert rows == want                            # whole result, nothing dropped
    assert "isSkewJoin=true" in plan or "skew=true" in plan.lower(), plan


def test_cancel_has_no_hot_right_side(spark, t, skewed):
    """The remaining deposits are made distinct per listing before the anti-join."""
    state = X.cancel_deposits(t.listing_status, skewed, skewed.limit(5))
    with small_thresholds(spark):
        plan = state.status._jdf.queryExecution().optimizedPlan().toString()
    anti = plan[plan.index("LeftAnti"):]
    assert "Aggregate [house_id" in anti
    assert STATUS_SELLING in plan
