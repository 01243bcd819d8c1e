"""Binding of the listing data model onto the driver's TPC-H-style tables.

``orders`` joined with ``customer`` and ``nation`` gives one raw listing per
order (key ``k = o_orderkey``); lineitem and events give favourites, deposits
and request batches. Every table here is derived by Spark from the given
parquet tables, so the work of every query grows with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abode.schema import (
    DIRECTIONS, HANOI_DISTRICTS, RAW_COLUMNS, STATUS_PENDING, STATUS_PROCESSING, STATUS_SELLING,
    STATUS_SOLD, STATUSES,
)
from abode.session import split_skewed_joins, table_path


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan a driver table, pruned to ``columns``; filters are pushed into the scan.

    Joins are not pre-partitioned on purpose: favourites and deposits are
    bags that may hold a third of their rows on one listing, and AQE can only
    split such a hot partition (skew join) or broadcast a small side when the
    join shuffles both inputs itself.
    """
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def house_id_of(key: Column) -> Column:
    """Official id: zero-padded to 5 digits, wider keys keep all digits."""
    return F.format_string("%05d", key + F.lit(1))


def user_id_of(key: Column) -> Column:
    return F.concat(F.lit("u"), key.cast("string"))


def _s(c: Column) -> Column:
    return c.cast("string")


def listing_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as raw listing text (plus status and poster), one row per order.

    ``nation`` is a fixed 25-row dimension; the planner broadcasts it from its
    file statistics. ``customer`` is joined by key (AQE picks broadcast only if
    the runtime size is under the threshold, else sort-merge).
    """
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)

    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    h = F.floor(F.col("o_totalprice") / 1000).cast("bigint")
    m10 = k % 10
    direction = F.lit(None).cast("string")
    for i in reversed(range(len(DIRECTIONS))):
        direction = F.when(k % 9 == i, F.lit(DIRECTIONS[i])).otherwise(direction)
    m50 = k % 50
    # prices with many places, bare digits, digits beyond the money type, unreadable text and quotes
    price = (F.when(m50 == 0, F.concat(_s(F.floor(h / 100)), F.lit(","), F.lpad(_s(h % 100), 2, "0"),
                                       F.lpad(_s(k % 1000), 3, "0"), F.lit(" tỷ")))
             .when(m50 == 10, F.concat(_s(F.floor(h / 10)), F.lit("."), _s(h % 10), F.lpad(_s(k % 1000), 4, "0")))
             .when(m50 == 20, F.concat(_s(F.lit(5500000000) + k), F.lit("00000000")))
             .when(m50 == 30, F.concat(F.lit("Liên hệ "), _s(h)))
             .when(m50 == 40, F.concat(F.lit('"'), _s(F.floor(h / 100)), F.lit(',5" tỷ')))
             .when(m10 <= 3, F.concat(_s(F.floor(h / 100)), F.lit(","),
                                       F.lpad(_s(h % 100), 2, "0"), F.lit(" tỷ")))
             .when(m10 <= 7, F.concat(_s(F.floor(h / 10)), F.lit(","), _s(h % 10),
                                      F.lit(" triệu/m²")))
             .when(m10 == 8, F.lit("Thỏa thuận"))
             .otherwise(F.concat(_s(h), F.lit(" triệu/tháng"))))
    legal = (F.when(k % 5 == 0, "0").when(k % 5 == 1, "Sổ đỏ").when(k % 5 == 2, "Sổ hồng")
             .when(k % 5 == 3, "Giấy tờ hợp lệ").otherwise("Đang chờ sổ"))
    interior = (F.when(k % 4 == 0, "0").when(k % 4 == 1, "Đầy đủ").when(k % 4 == 2, "Cơ bản")
                .otherwise("Cao cấp"))
    statue = status_of(F.col("o_orderstatus"))
    return j.select(
        k.alias("k"),
        ck.alias("ck"),
        house_id_of(k).alias("house_id"),
        F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("n_name"), F.lit(" "), _s(h)).alias("Title"),
        F.concat(F.col("c_name"), F.lit(", "), F.col("n_name")).alias("Address"),
        F.col("n_name").alias("District"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("PostingDate"),
        F.when(m10 == 9, "Cho thuê").otherwise("Bán").alias("PostType"),
        price.alias("Price"),
        F.when(k % 97 == 0, F.lit("KXĐ")).otherwise(
            F.concat(_s(20 + k % 180), F.lit(","), _s(ck % 10), F.lit(" m²"))).alias("Area"),
        direction.alias("Direction"),
        F.concat(_s(k % 6), F.lit(" phòng")).alias("Bedrooms"),
        F.concat(_s(ck % 5), F.lit(" phòng")).alias("Bathrooms"),
        F.concat(_s((k + ck) % 7), F.lit(" tầng")).alias("Floors"),
        F.concat(_s(3 + ck % 9), F.lit(","), _s(k % 10), F.lit(" m")).alias("Width_meters"),
        legal.alias("Legal"),
        interior.alias("Interior"),
        F.when(k % 8 == 0, F.lit("0")).otherwise(F.concat(_s(k % 8), F.lit(",5 m"))).alias("Entrancewidth"),
        statue.alias("statue"),
        user_id_of(ck).alias("poster_id"),
    )


def raw_listings_of(base: DataFrame) -> DataFrame:
    """Raw (all-text) listings as scraped, with their input row ordinal."""
    return base.filter(F.col("k") % 20 != 7).select(
        F.col("k").alias("row_ordinal"), *RAW_COLUMNS)


def status_of(order_status: Column) -> Column:
    return F.when(order_status == "O", STATUS_SELLING).when(order_status == "F", STATUS_SOLD) \
        .otherwise(STATUS_PROCESSING)


def pending_raw_of(base: DataFrame) -> DataFrame:
    """User posts waiting for approval (raw text form, id 't%04d')."""
    return base.filter(F.col("k") % 20 == 7).select(
        F.col("k").alias("row_ordinal"),
        F.concat(F.lit("t"), F.format_string("%04d", F.floor(F.col("k") / 20) + 1)).alias("pending_id"),
        *RAW_COLUMNS, "poster_id")


def status_update_requests(events: DataFrame) -> DataFrame:
    """Admin status changes from 'error' events (batch or stream).

    admin: 'admin' when event_id % 3 != 0, else an unknown id; new status:
    element floor(event_id / 3) % 3 of the statuses; listing: id of
    event_id with its last three bits cleared, so several requests meet on one
    listing and the listings grow with the events.
    """
    eid = F.col("event_id")
    status = F.when(F.floor(eid / 3) % 3 == 0, STATUSES[0]) \
        .when(F.floor(eid / 3) % 3 == 1, STATUSES[1]).otherwise(STATUSES[2])
    return events.filter(F.col("event_type") == "error").select(
        F.when(eid % 3 != 0, "admin").otherwise("nobody").alias("admin_id"),
        house_id_of(eid - eid % 8).alias("house_id"), status.alias("statue"), "ts", "event_id")


def favorite_click_requests(events: DataFrame) -> DataFrame:
    """(user, listing) favourite requests from 'click' events (batch or stream)."""
    return events.filter(F.col("event_type") == "click").select(
        user_id_of(F.col("user_id")).alias("user_id"), house_id_of(F.col("event_id")).alias("house_id"),
        "ts", "event_id")


def log_requests(events: DataFrame) -> DataFrame:
    """A mixed log of listing requests in the order of events (batch or stream): kinds, users and administrators by the event's id."""
    k = F.col("event_id")
    kind = F.when(k % 10 < 4, "confirm").when(k % 10 < 7, "cancel").when(k % 10 == 7, "admin_cancel").otherwise("status")
    return events.select(
        "ts", "event_id", kind.alias("kind"), house_id_of(F.col("user_id")).alias("house_id"),
        user_id_of(F.floor(k / 10) % 5).alias("user_id"),
        F.element_at(F.array(F.lit("admin"), F.lit("mod1"), F.lit("nobody")), (k % 3 + 1).cast("int")).alias("admin_id"),
        F.when(k % 4 == 0, STATUS_SELLING).otherwise(STATUS_PROCESSING).alias("statue"))


class ListingTables:
    """Lazily derived tables of the listing application for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        split_skewed_joins(spark)
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str, columns: list[str] | None = None) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name, columns)

    @cached_property
    def base(self) -> DataFrame:
        return listing_base(self.spark, self.sf_dir)

    @cached_property
    def raw_listings(self) -> DataFrame:
        return raw_listings_of(self.base)

    @cached_property
    def listings(self) -> DataFrame:
        from abode.operators.clean import clean_listings
        return clean_listings(self.raw_listings)

    @cached_property
    def listing_status(self) -> DataFrame:
        """Status and poster need the orders alone: every customer and nation is there."""
        o = self.read("orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
        return o.filter(F.col("o_orderkey") % 20 != 7).select(
            house_id_of(F.col("o_orderkey")).alias("house_id"), status_of(F.col("o_orderstatus")).alias("statue"),
            user_id_of(F.col("o_custkey")).alias("poster_id"))

    @cached_property
    def listing_ids(self) -> DataFrame:
        """Ids of the cleaned listings, from the orders alone (rent rows are those with k % 10 = 9)."""
        o = self.read("orders", ["o_orderkey"])
        return o.filter((F.col("o_orderkey") % 20 != 7) & (F.col("o_orderkey") % 10 != 9)) \
            .select(house_id_of(F.col("o_orderkey")).alias("house_id"))

    @cached_property
    def listing_forms(self) -> DataFrame:
        """Listings as filled-in forms, with every fault that the form check knows in some rows."""
        n = F.col("house_id").cast("bigint")
        districts = F.array(*[F.lit(d) for d in HANOI_DISTRICTS])
        faults = {
            "district": F.when(n % 40 < 30, districts[(n % 30).cast("int")]).otherwise(F.col("district")),
            "width_meters": F.when(n % 11 == 0, F.lit(0.0)).otherwise(F.col("width_meters")),
            "entrancewidth": F.when(n % 13 == 0, F.lit(-1.0)).otherwise(F.col("entrancewidth")),
            "legal": F.when(n % 17 == 0, F.lit("Khác")).otherwise(F.col("legal")),
            "interior": F.when(n % 19 != 0, F.col("interior")),
            "post_type": F.when(n % 23 == 0, F.lit(" ")).otherwise(F.col("post_type")),
            "direction": F.when(n % 29 == 0, F.lit("Giữa")).otherwise(F.col("direction")),
            "bedrooms": F.when(n % 31 == 0, F.lit(0)).otherwise(F.col("bedrooms")),
            "bathrooms": F.when(n % 37 != 0, F.col("bathrooms")),
            "floors": F.when(n % 41 == 0, F.lit(-1)).otherwise(F.col("floors")),
        }
        return self.listings.withColumns(faults)

    @cached_property
    def user_forms(self) -> DataFrame:
        """Registrations: two of three phones have ten digits, some ids and names are faulty."""
        c = self.read("customer", ["c_custkey", "c_name"])
        k = F.col("c_custkey")
        return c.select(
            F.when(k % 7 == 0, F.concat(F.lit("u-"), _s(k))).otherwise(F.concat(F.lit("user"), _s(k))).alias("user_id"),
            F.when(k % 11 == 0, F.lit("  ")).when(k % 13 != 0, F.col("c_name")).alias("username"),
            F.when(k % 3 == 0, F.lit(900000000) + k).otherwise(F.lit(9000000000) + k).cast("bigint").alias("phone"))

    @cached_property
    def pending_listings(self) -> DataFrame:
        from abode.operators.clean import clean_listings
        raw = pending_raw_of(self.base)
        typed = clean_listings(raw, keep=["pending_id", "poster_id"])
        return typed.withColumn("house_id", F.col("pending_id")).drop("pending_id") \
            .withColumn("statue", F.lit(STATUS_PENDING))

    @cached_property
    def users(self) -> DataFrame:
        c = self.read("customer", ["c_custkey", "c_name"])
        return c.select(user_id_of(F.col("c_custkey")).alias("user_id"),
                        F.col("c_name").alias("username"),
                        (F.lit(900000000) + F.col("c_custkey")).cast("bigint").alias("phone"))

    @cached_property
    def admins(self) -> DataFrame:
        # Fixed two-row administrator table.
        return self.spark.createDataFrame(
            [("admin", "Admin"), ("mod1", "Moderator")], "admin_id string, admin_name string")

    def _line_pairs(self, flag: str) -> DataFrame:
        li = self.read("lineitem", ["l_orderkey", "l_suppkey", "l_returnflag"])
        return li.filter((F.col("l_returnflag") == flag) & (F.col("l_orderkey") % 20 != 7)).select(
            "l_orderkey", "l_suppkey",
            user_id_of(F.col("l_suppkey")).alias("user_id"),
            house_id_of(F.col("l_orderkey")).alias("house_id"))

    @cached_property
    def favorites_src(self) -> DataFrame:
        return self._line_pairs("A")

    @cached_property
    def favorites(self) -> DataFrame:
        """Favourites are a bag: duplicates are kept."""
        return self.favorites_src.select("user_id", "house_id")

    @cached_property
    def deposits_src(self) -> DataFrame:
        return self._line_pairs("R").dropDuplicates(["l_orderkey", "l_suppkey"])

    @cached_property
    def deposits(self) -> DataFrame:
        """Deposits are a set (primary key user_id, house_id)."""
        return self.deposits_src.select("user_id", "house_id")

    @cached_property
    def active(self) -> DataFrame:
        from abode.operators.catalog import active_listings
        return active_listings(self.listings, self.listing_status)

    # ---- request batches (events and derived rows) ----
    def events_of(self, event_type: str) -> DataFrame:
        return self.read("events", ["event_id", "ts", "user_id", "event_type"]) \
            .filter(F.col("event_type") == event_type) \
            .select("event_id", "ts", "user_id")

    def events(self) -> DataFrame:
        return self.read("events", ["event_id", "ts", "user_id", "event_type"])

    def batch_add_favorites(self) -> DataFrame:
        return favorite_click_requests(self.events())

    def batch_remove_favorites(self) -> DataFrame:
        f = self.favorites_src
        return f.filter((F.col("l_suppkey") + F.col("l_orderkey")) % 10 == 0).select("user_id", "house_id")

    def batch_confirm_deposits(self) -> DataFrame:
        e = self.events_of("purchase").select(
            user_id_of(F.col("user_id")).alias("user_id"),
            house_id_of(F.col("event_id")).alias("house_id"))
        again = self.deposits_src.filter((F.col("l_suppkey") + F.col("l_orderkey")) % 4 == 1) \
            .select("user_id", "house_id")
        return e.unionByName(again)

    def batch_cancel_deposits(self) -> DataFrame:
        return self.deposits_src.filter((F.col("l_suppkey") + F.col("l_orderkey")) % 4 == 0) \
            .select("user_id", "house_id")

    def batch_admin_cancel(self) -> DataFrame:
        d = self.deposits.select("house_id").distinct()
        return d.join(self.listings.select("house_id"), "house_id", "left_semi") \
            .filter((F.col("house_id").cast("bigint") - 1) % 50 == 0)

    def batch_status_updates(self) -> DataFrame:
        return status_update_requests(self.events())

    def batch_request_log(self) -> DataFrame:
        return log_requests(self.events())

    def batch_buy_requests(self) -> DataFrame:
        e = self.events_of("view")
        return e.select(user_id_of(F.col("user_id") * 37).alias("user_id"),
                        house_id_of(F.col("event_id")).alias("house_id"), "ts", "event_id")

    def batch_post_requests(self, remainder: int) -> DataFrame:
        """New posts from the form: typed text fields of orders with k % 500 == remainder, input order k.

        The price is plain VND text with thousands commas, or negotiable for
        every seventh; rooms may be 0; measures carry no unit.
        """
        b = self.base.filter(F.col("k") % 500 == remainder)
        k, ck = F.col("k"), F.col("ck")
        price = F.when(k % 7 == 0, "Thỏa thuận").otherwise(F.format_number((k + 1) * 1000000 + ck, 0))
        return b.select(
            k.alias("request_order"), F.col("Title").alias("title"), F.col("Address").alias("address"),
            F.col("District").alias("district"), F.col("PostType").alias("post_type"), price.alias("price"),
            F.concat(_s(20 + k % 180), F.lit("."), _s(ck % 10)).alias("area"),
            F.col("Direction").alias("direction"), _s(k % 6).alias("bedrooms"), _s(ck % 5).alias("bathrooms"),
            _s((k + ck) % 7).alias("floors"), F.concat(_s(3 + ck % 9), F.lit(".5")).alias("width_meters"),
            F.col("Legal").alias("legal"), F.col("Interior").alias("interior"),
            F.when(k % 3 != 0, _s(k % 8)).alias("entrancewidth"), "poster_id")

    def batch_approve(self) -> DataFrame:
        p = self.pending_listings.select("house_id")
        n = F.substring("house_id", 2, 100).cast("bigint")
        return p.filter(n % 2 == 0)

    def batch_reject(self) -> DataFrame:
        p = self.pending_listings.select("house_id")
        n = F.substring("house_id", 2, 100).cast("bigint")
        return p.filter((n % 5 == 0) & (n % 2 == 1))

    def batch_delete_users(self) -> DataFrame:
        c = self.read("customer", ["c_custkey"])
        return c.filter(F.col("c_custkey") % 10 == 0).select(user_id_of(F.col("c_custkey")).alias("user_id"))

    def batch_register_users(self) -> DataFrame:
        e = self.events_of("signup")
        return e.select(user_id_of(F.col("user_id") * 37).alias("user_id"),
                        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("username"),
                        (F.lit(910000000) + F.col("user_id")).cast("bigint").alias("phone"),
                        "ts", "event_id")
