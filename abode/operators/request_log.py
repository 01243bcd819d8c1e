"""One ordered log of mixed listing requests, applied as if one by one.

A log row is a request on a listing: ``confirm`` (a user's deposit), ``cancel``
(of a user's deposit), ``admin_cancel`` (of all deposits of the listing) or
``status`` (an administrator sets a status), in the order of (ts, event_id). The rules
are those of ``changes``; here each request sees what all earlier ones left:

* confirm adds the pair and sets 'Đang xử lý', unless the pair is there or the
  user or listing is unknown;
* cancel removes the pair; if no deposit of the listing is left, it goes back
  to 'Đang bán', even if nothing was removed;
* admin_cancel removes all pairs of the listing and sets 'Đang bán';
* status sets the given status; unknown administrators are ignored.

No task replays a listing. What a request needs of the requests before it are
running values with an associative combination: the last clearing of the
listing, the pair's last own request, and the sum of the deposits added and
removed since. ``running`` takes them over ranges of the sorted log, first within
each range, then over the ranges (one row per key and range), so a hot listing or
pair is spread over as many tasks as its rows fill. The state after the log is
then one aggregate per listing and one per pair.

Requests without a listing are dropped, as are users' requests without a user;
rows equal in (ts, event_id) are ordered by kind, user, administrator and status. Listings without a status row keep
having none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abode.operators.changes import PAIR, DepositState
from abode.schema import STATUS_PROCESSING, STATUS_SELLING
from abode.session import scratch_path

LOG = ["ts", "event_id", "kind", "house_id", "user_id", "admin_id", "statue"]
_ORDER = ["ts", "event_id", "kind", "user_id", "admin_id", "statue"]


def _written(df: DataFrame, base: str, name: str) -> DataFrame:
    df.write.parquet(f"{base}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/{name}")


def running(df: DataFrame, keys: list[str], order: list[str], base: str, name: str, **values: tuple[str, Column]) -> DataFrame:
    """``df`` with, per value, its sum or maximum over the earlier rows of the same keys.

    ``values``: name -> ('sum' or 'max', column). ``order`` must tell rows apart. The
    rows are cut into sorted ranges; a key's totals per range, not its rows, are
    what one task sees of it.
    """
    how = {"sum": F.sum, "max": F.max}
    df = df.select("*", *[c.alias(f"_of_{v}") for v, (_, c) in values.items()])
    ranged = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    ranged = _written(ranged, base, name)
    earlier = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.select("*", *[how[k](f"_of_{v}").over(earlier).alias(f"_in_{v}") for v, (k, _) in values.items()])
    totals = ranged.groupBy(*keys, "_range").agg(*[how[k](f"_of_{v}").alias(f"_of_{v}") for v, (k, _) in values.items()])
    ranges = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_key_range"),
                           *[how[k](f"_of_{v}").over(ranges).alias(f"_up_{v}") for v, (k, _) in values.items()])
    totals = _written(totals, base, f"{name}-totals")
    same = inside["_range"] == totals["_key_range"]
    for k in keys:
        same = same & inside[k].eqNullSafe(totals[f"_key_{k}"])
    out = inside.join(totals, same)
    for v, (k, _) in values.items():
        up, here = F.col(f"_up_{v}"), F.col(f"_in_{v}")
        both = F.coalesce(up, F.lit(0)) + F.coalesce(here, F.lit(0)) if k == "sum" else F.greatest(up, here)
        out = out.withColumn(v, both)
    return out.select(*[c for c in df.columns if not c.startswith("_of_")], *values)


def apply_log(status: DataFrame, deposits: DataFrame, users: DataFrame, listings: DataFrame, admins: DataFrame,
              log: DataFrame) -> DepositState:
    """The tables after all requests of ``log`` (columns ``LOG``) in their order."""
    base = scratch_path(log.sparkSession, "request-log")
    by_user = F.col("kind").isin("confirm", "cancel")
    valid = log.select(*LOG).filter(F.col("house_id").isNotNull() & (~by_user | F.col("user_id").isNotNull()))
    known = valid.filter("kind = 'confirm'").join(users.select("user_id"), "user_id", "left_semi") \
        .join(listings.select("house_id").distinct(), "house_id", "left_semi")
    told = valid.filter("kind = 'status'").join(admins.select("admin_id"), "admin_id", "left_semi")
    rest = valid.filter(F.col("kind").isin("cancel", "admin_cancel"))
    rows = known.select(*LOG).unionByName(told.select(*LOG)).unionByName(rest)
    # a number per row in the log's order: one value to compare and to take the maximum of
    rows = rows.withColumn("at", F.struct(*_ORDER, F.monotonically_increasing_id().alias("row")))
    rows = _written(rows.select("house_id", "kind", "user_id", "statue", "at"), base, "log")

    cleared = running(rows, ["house_id"], ["at"], base, "clearings",
                      cleared=("max", F.when(F.col("kind") == "admin_cancel", F.col("at"))))
    pairs = running(cleared.filter(F.col("kind").isin("confirm", "cancel")), ["house_id", "user_id"], ["at"], base, "pairs",
                    last=("max", F.struct("at", "kind")))
    first = deposits.select(F.col("user_id").alias("d_user"), F.col("house_id").alias("d_house")).distinct()
    pairs = pairs.join(first, (F.col("user_id") == F.col("d_user")) & (F.col("house_id") == F.col("d_house")), "left")
    own = F.col("last").isNotNull() & (F.col("cleared").isNull() | (F.col("last.at") > F.col("cleared")))
    there = F.when(own, F.col("last.kind") == "confirm").when(F.col("cleared").isNotNull(), F.lit(False)).otherwise(F.col("d_user").isNotNull())
    change = F.when((F.col("kind") == "confirm") & ~there, 1).when((F.col("kind") == "cancel") & there, -1).otherwise(0)
    pairs = pairs.select("house_id", "kind", "user_id", F.lit(None).cast("string").alias("statue"), "at", "cleared", change.alias("change"))
    others = cleared.filter(~F.col("kind").isin("confirm", "cancel")).select(
        "house_id", "kind", "user_id", "statue", "at", "cleared", F.lit(0).alias("change"))
    # deposits after a request: the changes since the last clearing, and without one those of before the log
    moves = running(_written(pairs.unionByName(others), base, "changes"), ["house_id", "cleared"], ["at"], base, "moves",
                    moved=("sum", F.col("change").cast("long")))
    held = first.groupBy(F.col("d_house").alias("h_house")).agg(F.count(F.lit(1)).alias("held"))
    moves = moves.join(held, F.col("house_id") == F.col("h_house"), "left")
    left = F.when(F.col("cleared").isNull(), F.coalesce("held", F.lit(0))).otherwise(F.lit(0)) + F.col("moved") + F.col("change")
    sets = F.when((F.col("kind") == "confirm") & (F.col("change") == 1), F.lit(STATUS_PROCESSING)) \
        .when((F.col("kind") == "cancel") & (left == 0), F.lit(STATUS_SELLING)) \
        .when(F.col("kind") == "admin_cancel", F.lit(STATUS_SELLING)).when(F.col("kind") == "status", F.col("statue"))
    final = moves.select("house_id", "at", sets.alias("sets")).filter("sets is not null") \
        .groupBy(F.col("house_id").alias("s_house")).agg(F.max_by("sets", "at").alias("new"))
    after = status.join(final, F.col("house_id") == F.col("s_house"), "left").select(
        "house_id", F.coalesce("new", "statue").alias("statue"), "poster_id")

    clear = rows.filter("kind = 'admin_cancel'").groupBy(F.col("house_id").alias("c_house")).agg(F.max("at").alias("clear"))
    last = rows.filter(F.col("kind").isin("confirm", "cancel")).groupBy("house_id", "user_id") \
        .agg(F.max(F.struct("at", "kind")).alias("last"))
    state = first.select(F.col("d_user").alias("user_id"), F.col("d_house").alias("house_id")) \
        .join(last, PAIR, "full").join(clear, F.col("house_id") == F.col("c_house"), "left")
    kept = F.when(F.col("last").isNull(), F.col("clear").isNull()) \
        .otherwise((F.col("last.kind") == "confirm") & (F.col("clear").isNull() | (F.col("last.at") > F.col("clear"))))
    return DepositState(after, state.filter(kept).select(*PAIR))
