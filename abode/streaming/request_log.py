"""The ordered request log as a stream with state per listing.

Requests arrive in any order within ``delay``. Each waits in its group's
state until the watermark has passed it; a timer then applies the waiting requests
in the order of (ts, event_id), by the rules of ``operators.request_log``.

Listings are hashed into ``GROUPS`` groups, since a call per group and batch and
each state access cost far more than a request. State per group: a map from the listings
to what became of them (number of the last clearing by an administrator, how many
deposits are left, how many requests were applied), a map from the listings and users the
requests named to whether their deposit stands and since which number, and the list of
waiting requests, ``PART`` to a state row. A user's deposit is read and written once per
timer, however many requests name it. Deposits of before the stream are not state: each request brings
from a join with the stored table whether its pair was there and how many
the listing had. So state grows with the requests only, and it lies in RocksDB,
not in a task's memory, but for a group's waiting requests. A listing's requests are applied by one task at a time, as
their order demands; its joins and its changes are split as all rows are.

Every micro-batch writes its rows to a folder of its batch id, so a replayed
batch rewrites its own: the requests received, and what the applied ones
changed. ``current`` reads them: the stored tables with the changes, and
on top the requests still waiting, by the batch job. So after each run the
tables are those of the batch job over all requests received in time.

Late requests (at or before the watermark of the batch before) are refused,
and counted from the progress reports of the run. Requests without a time or a listing
are refused too, as are users' requests without a user. A time without zone is read in the
session's zone (UTC by default).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from abode.operators.changes import PAIR, DepositState
from abode.operators.request_log import LOG, _written, apply_log
from abode.schema import STATUS_PROCESSING, STATUS_SELLING
from abode.session import scratch_path
from abode.sources.tpch_binding import ListingTables, log_requests
from abode.streaming.requests import event_stream

_REQUEST = ["at", "event_id", "kind", "user_id", "admin_id", "statue"]
_WAITS = ["house_id", *_REQUEST, "was", "held"]
#: State keys; as keys of a checkpoint they cannot change with the data.
GROUPS = 1 << 14
#: Waiting requests of one state row.
PART = 1000
#: what: 'request' (received), 'pair' (``stands``), 'clear', 'status' (``statue``) or 'settled' (all up to ``at``).
CHANGE = ("house_id string, what string, seq long, at long, event_id long, kind string, user_id string, "
          "admin_id string, statue string, stands boolean")
_COLUMNS = [c.split()[0] for c in CHANGE.split(", ")]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _values(column: pd.Series, kind: type) -> list:
    """The column's values, nulls as None."""
    return [None if none else kind(v) for v, none in zip(column.tolist(), column.isna().tolist())]


def _packed(requests: list[tuple]) -> list[tuple[str]]:
    """State rows of ``PART`` requests each."""
    return [(json.dumps(requests[a:a + PART]),) for a in range(0, len(requests), PART)]


def _order(row: tuple) -> tuple:
    """The log's order; nulls first."""
    return tuple((v is not None, v) for v in row[1:7])


class RequestProcessor(StatefulProcessor):
    """Applies the requests on a group's listings in their order once the watermark has passed them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.listings = handle.getMapState("listings", "house_id string", "cleared long, held long, seq long")
        self.stands = handle.getMapState("stands", "house_id string, user_id string", "stands boolean, seq long")
        self.waiting = handle.getListState("waiting", "requests string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        kinds = {"at": int, "event_id": int, "was": bool, "held": int}
        for part in rows:
            if part.empty:
                continue
            found = {c: _values(part[c], kinds.get(c, str)) for c in _WAITS}
            self.waiting.appendList(_packed(list(zip(*found.values()))))
            first = min(found["at"]) if first is None else min(first, *found["at"])
            yield _frame({"what": ["request"] * len(part), **{c: found[c] for c in ["house_id", *_REQUEST]}}, len(part))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        due: dict[str, list[tuple]] = {}
        rest = []
        for part in self.waiting.get():
            for r in json.loads(part[0]):
                if r[1] <= upto:
                    due.setdefault(r[0], []).append(tuple(r))
                else:
                    rest.append(r)
        if not due:
            return
        if rest:
            self.waiting.put(_packed(rest))
            self.handle.registerTimer(min(r[1] for r in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        out: list[dict] = []
        for house, requests in due.items():
            out += self._apply(house, sorted(requests, key=_order), upto)
            if len(out) >= 10 * PART:
                yield _frame({c: [r.get(c) for r in out] for c in _COLUMNS}, len(out))
                out = []
        if out:
            yield _frame({c: [r.get(c) for r in out] for c in _COLUMNS}, len(out))

    def _apply(self, house: str, due: list[tuple], upto: int) -> list[dict]:
        """Changes by a listing's requests."""
        before = self.listings.getValue((house,))
        cleared, held, seq = (None, due[0][8], 0) if before is None else before
        # the users' deposits as far as they were read, those to write, and whether none is stored since the last clearing
        stands, changed, emptied = {}, {}, before is None
        out = []
        for _, at, event_id, kind, user, admin, statue, was, _ in due:
            seq += 1
            new = None
            row = {"house_id": house, "seq": seq, "at": at}
            if kind in ("confirm", "cancel"):
                if user not in stands:
                    stored = None if emptied else self.stands.getValue((house, user))
                    if stored is not None and (cleared is None or stored[1] > cleared):
                        stands[user] = stored[0]
                    else:
                        stands[user] = was and cleared is None
                if stands[user] != (kind == "confirm"):
                    held += 1 if kind == "confirm" else -1
                    stands[user] = kind == "confirm"
                    changed[user] = (stands[user], seq)
                    out.append(row | {"what": "pair", "user_id": user, "stands": kind == "confirm"})
                    new = STATUS_PROCESSING if kind == "confirm" else None
                if kind == "cancel" and held == 0:
                    new = STATUS_SELLING
            elif kind == "admin_cancel":
                cleared, held, new = seq, 0, STATUS_SELLING
                stands, changed, emptied = {}, {}, True
                out.append(row | {"what": "clear"})
            else:
                new = statue
            if new is not None:
                out.append(row | {"what": "status", "statue": new})
        for user, there in changed.items():
            self.stands.updateValue((house, user), there)
        self.listings.updateValue((house,), (cleared, held, seq))
        return [*out, {"house_id": house, "what": "settled", "seq": seq, "at": upto}]

    def close(self) -> None:
        pass


def _frame(columns: dict[str, list], n: int) -> pd.DataFrame:
    """``n`` rows of ``CHANGE``; a column that is not named is null."""
    types = {"seq": "Int64", "at": "Int64", "event_id": "Int64", "stands": "boolean"}
    of = lambda c: columns.get(c, [None] * n)
    return pd.DataFrame({c: pd.array(of(c), dtype=types[c]) if c in types else pd.Series(of(c), dtype=object)
                         for c in _COLUMNS})


def checked_requests(log: DataFrame, t: ListingTables, delay: str) -> DataFrame:
    """The valid requests of a stream with their time in microseconds and what was stored of their pair and listing."""
    by_user = F.col("kind").isin("confirm", "cancel")
    valid = log.select(*LOG).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).filter(
        F.col("ts").isNotNull() & F.col("house_id").isNotNull() & (~by_user | F.col("user_id").isNotNull()))
    pairs = t.deposits.select(*PAIR).distinct().select(
        F.col("user_id").alias("d_user"), F.col("house_id").alias("d_house"), F.lit(True).alias("stored"))
    held = t.deposits.select(*PAIR).distinct().groupBy(F.col("house_id").alias("h_house")).agg(F.count(F.lit(1)).alias("stored_n"))
    users = t.users.select(F.col("user_id").alias("u_user"), F.lit(True).alias("is_user")).distinct()
    houses = t.listings.select(F.col("house_id").alias("l_house"), F.lit(True).alias("is_house")).distinct()
    admins = t.admins.select(F.col("admin_id").alias("a_admin"), F.lit(True).alias("is_admin")).distinct()
    rows = valid.join(users, F.col("user_id") == F.col("u_user"), "left") \
        .join(houses, F.col("house_id") == F.col("l_house"), "left") \
        .join(admins, F.col("admin_id") == F.col("a_admin"), "left")
    allowed = F.when(F.col("kind") == "confirm", F.coalesce("is_user", F.lit(False)) & F.coalesce("is_house", F.lit(False))) \
        .when(F.col("kind") == "status", F.coalesce("is_admin", F.lit(False))).otherwise(F.col("kind").isin("cancel", "admin_cancel"))
    rows = rows.filter(allowed) \
        .join(pairs, (F.col("user_id") == F.col("d_user")) & (F.col("house_id") == F.col("d_house")), "left") \
        .join(held, F.col("house_id") == F.col("h_house"), "left")
    return rows.select("ts", "house_id", F.unix_micros("ts").alias("at"), "event_id", "kind", "user_id", "admin_id", "statue",
                       F.coalesce("stored", F.lit(False)).alias("was"), F.coalesce("stored_n", F.lit(0)).alias("held"))


def current(t: ListingTables, changes: DataFrame) -> DepositState:
    """The stored tables after the applied requests, and after those that still wait.

    The batch job for what waits sees the deposits, users and listings that these requests name, not the whole tables.
    """
    of = lambda what: changes.filter(F.col("what") == what)
    new = of("status").groupBy(F.col("house_id").alias("s_house")).agg(F.max_by("statue", "seq").alias("new"))
    status = t.listing_status.join(new, F.col("house_id") == F.col("s_house"), "left").select(
        "house_id", F.coalesce("new", "statue").alias("statue"), "poster_id")
    upto = of("settled").groupBy(F.col("house_id").alias("w_house")).agg(F.max("at").alias("upto"))
    waiting = of("request").join(upto, F.col("house_id") == F.col("w_house"), "left") \
        .filter(F.col("upto").isNull() | (F.col("at") > F.col("upto"))).withColumn("ts", F.col("at")).select(*LOG)
    base = scratch_path(changes.sparkSession, "request-waiting")
    waiting = _written(waiting, base, "requests")
    houses = _written(waiting.select("house_id").distinct(), base, "houses")
    named = lambda df: df.join(houses, "house_id", "left_semi")
    users = t.users.select("user_id").join(waiting.select("user_id"), "user_id", "left_semi")
    last, clear = of("pair"), of("clear")
    open_deposits = _written(_deposits(named(t.deposits.select(*PAIR)), named(last), named(clear)), base, "deposits")
    after = apply_log(status, open_deposits, users, named(t.listings.select("house_id")), t.admins, waiting)
    others = _deposits(t.deposits, last, clear).join(houses, "house_id", "left_anti")
    return DepositState(after.status, after.deposits.select(*PAIR).unionByName(others.select(*PAIR)))


def _deposits(stored: DataFrame, pairs: DataFrame, clears: DataFrame) -> DataFrame:
    """The deposits after the changes (of 'pair' and 'clear')."""
    last = pairs.groupBy(*PAIR).agg(F.max(F.struct("seq", "stands")).alias("last"))
    clear = clears.groupBy(F.col("house_id").alias("c_house")).agg(F.max("seq").alias("clear"))
    kept = F.when(F.col("last").isNull(), F.col("clear").isNull()) \
        .otherwise(F.col("last.stands") & (F.col("clear").isNull() | (F.col("last.seq") > F.col("clear"))))
    return stored.select(*PAIR).distinct().join(last, PAIR, "full") \
        .join(clear, F.col("house_id") == F.col("c_house"), "left").filter(kept).select(*PAIR)


@dataclass
class StreamedLog:
    """The tables after the run, the changes written so far, and the run's refused late requests."""

    tables: DepositState
    changes: DataFrame
    late: int


def _write(base: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")
    return run


def stream_request_log(spark: SparkSession, sf_dir: str, events_dir: str | None = None, state_dir: str | None = None,
                       delay: str = "1 hour") -> StreamedLog:
    """Run the requests that have arrived; a later call with the same ``state_dir`` goes on where this one ended."""
    t = ListingTables(spark, sf_dir)
    base = state_dir or scratch_path(spark, "request_stream")
    requests = checked_requests(log_requests(event_stream(spark, sf_dir, events_dir)), t, delay)
    spark.createDataFrame([], CHANGE).write.mode("overwrite").parquet(f"{base}/changes/batch=-1")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS_DB)
    try:
        changed = requests.withColumn("group", F.pmod(F.xxhash64("house_id"), F.lit(GROUPS)).cast("int")).groupBy("group").transformWithStateInPandas(
            RequestProcessor(), outputStructType=CHANGE, outputMode="Update", timeMode="EventTime")
        q = changed.writeStream.outputMode("update").foreachBatch(_write(f"{base}/changes")) \
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    late = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    changes = spark.read.schema(CHANGE).parquet(f"{base}/changes")
    return StreamedLog(current(t, changes), changes, late)
