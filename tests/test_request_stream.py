"""The request log as a stream: micro-batches, a restart in the middle, late requests."""
from pyspark.sql import functions as F

from abode.operators import request_log as R
from abode.session import scratch_path
from abode.sources.tpch_binding import ListingTables
from abode.streaming.request_log import stream_request_log
from tests.conftest import SF_SMALL


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def batch(t, log):
    return R.apply_log(t.listing_status, t.deposits, t.users, t.listings, t.admins, log)


def same(got, want):
    assert bag(got.status) == bag(want.status)
    assert bag(got.deposits.select("user_id", "house_id")) == bag(want.deposits.select("user_id", "house_id"))


def few_listings(ev):
    """The events on seven listings, so that many requests meet on each."""
    return ev.withColumn("user_id", F.col("user_id") % 7 + 1)


def write_parts(spark, ev, path, names, day):
    """A file per part, ten days each, whose requests are shuffled and overlap the next part's by some hours."""
    jitter = F.expr(f"make_interval(0, 0, 0, 0, cast(abs(hash(event_id)) % {day} as int))")
    moved = ev.withColumn("part", F.least(F.lit(2), F.floor(F.dayofmonth(F.col("ts") + jitter) / F.lit(10.01)).cast("int")))
    for i in names:
        moved.filter(F.col("part") == i).drop("part").orderBy(F.hash("event_id")).coalesce(1) \
            .write.mode("append").parquet(path)


def test_stream_equals_batch_over_a_restart(spark):
    t = ListingTables(spark, SF_SMALL)
    ev = few_listings(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    events, state = scratch_path(spark, "events_parts"), scratch_path(spark, "request_state")
    from abode.sources.tpch_binding import log_requests
    write_parts(spark, ev, events, [0, 1], 20)
    first = stream_request_log(spark, SF_SMALL, events, state, delay="1 day")
    seen = spark.read.parquet(events)
    same(first.tables, batch(t, log_requests(seen)))
    write_parts(spark, ev, events, [2], 20)
    second = stream_request_log(spark, SF_SMALL, events, state, delay="1 day")
    same(second.tables, batch(t, log_requests(ev)))
    assert first.late == second.late == 0
    kinds = {r["what"]: r["count"] for r in second.changes.groupBy("what").count().collect()}
    assert {"request", "pair", "clear", "status", "settled"} <= set(kinds)
    waiting = second.changes.filter("what = 'request'").count() - second.changes.groupBy("house_id").agg(
        F.max(F.when(F.col("what") != "request", F.col("seq"))).alias("n")).agg(F.sum("n")).collect()[0][0]
    assert 0 < waiting < kinds["request"] / 4  # the state applied most requests, the rest still waits


def test_late_requests_are_refused_and_counted(spark):
    t = ListingTables(spark, SF_SMALL)
    ev = few_listings(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    events, state = scratch_path(spark, "events_late"), scratch_path(spark, "late_state")
    from abode.sources.tpch_binding import log_requests
    ev.filter("dayofmonth(ts) > 10").coalesce(1).write.parquet(events)
    first = stream_request_log(spark, SF_SMALL, events, state)
    ev.filter("dayofmonth(ts) <= 10").coalesce(1).write.mode("append").parquet(events)
    second = stream_request_log(spark, SF_SMALL, events, state)
    assert first.late == 0 and second.late > 0
    same(second.tables, batch(t, log_requests(ev.filter("dayofmonth(ts) > 10"))))


class CountedState:
    """A state variable in memory that counts its accesses."""

    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("getValue", "get"):
                return self.held.get(args[0] if args else None, None if args else iter(()))
            if name == "updateValue":
                self.held[args[0]] = args[1]
            elif name in ("put", "appendList"):
                self.held[None] = [*(self.held.get(None, []) if name == "appendList" else []), *args[0]]
            elif name == "clear":
                self.held.clear()
        return call


class CountedHandle:
    def __init__(self):
        self.calls, self.timers = [], []

    def state(self, *_):
        return CountedState(self.calls)

    getValueState = getMapState = getListState = state

    def registerTimer(self, at):
        self.timers.append(at)


class Until:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_state_accesses_do_not_grow_with_the_requests():
    import pandas as pd

    from abode.streaming.request_log import RequestProcessor
    n = 3000
    rows = pd.DataFrame({
        "house_id": [f"{i % 3:05d}" for i in range(n)], "at": [1000 * i for i in range(n)], "event_id": range(n),
        "kind": ["admin_cancel" if i % 500 == 499 else "confirm" if i % 7 < 4 else "cancel" for i in range(n)],
        "user_id": [f"u{i % 5}" for i in range(n)], "admin_id": "admin", "statue": None, "was": False, "held": 0})
    handle, processor = CountedHandle(), RequestProcessor()
    processor.init(handle)
    asked = list(processor.handleInputRows((0,), iter([rows.iloc[:n // 2], rows.iloc[n // 2:]]), Until(0)))
    assert sum(len(f) for f in asked) == n
    out = []
    for upto in (1234, 5000):  # the middle of the log, then all of it
        assert min(t for t in handle.timers) <= upto
        out += list(processor.handleExpiredTimer((0,), Until(upto), None))
    assert len(handle.calls) < 100  # 3 listings, 15 pairs, two timers
    found = pd.concat(out)
    stands: dict = {}
    want = []
    for r in rows.itertuples():
        pairs = stands.setdefault(r.house_id, set())
        if r.kind == "admin_cancel":
            pairs.clear()
        elif (r.user_id in pairs) != (r.kind == "confirm"):
            (pairs.add if r.kind == "confirm" else pairs.remove)(r.user_id)
            want.append((r.at, r.house_id, r.user_id, r.kind == "confirm"))
    pairs = found[found["what"] == "pair"]
    assert sorted(zip(pairs["at"], pairs["house_id"], pairs["user_id"], pairs["stands"])) == want
    assert sorted(found[found["what"] == "settled"].groupby("house_id")["seq"].max()) == [n // 3] * 3
