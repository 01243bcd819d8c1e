"""Independent DuckDB SQL oracle for every SQL-expressible registered query.

Column names equal the Spark outputs. Money leaves both engines as DOUBLE;
formatted prices are rebuilt here with integer arithmetic (half-up to 2
places), so they are exact and do not depend on a printf rounding mode.
"""

from __future__ import annotations

from abode.plans.oracle_prelude import LOOSE, NUM_RE, with_prelude

SELLING, SOLD, PROCESSING = "Đang bán", "Đã bán", "Đang xử lý"


def cents(v: str) -> str:
    return f"CAST(floor(({v} + 5000000) / 10000000) AS BIGINT)"


def billions_text(v: str) -> str:
    c = cents(v)
    return f"concat(CAST({c} // 100 AS VARCHAR), '.', lpad(CAST({c} % 100 AS VARCHAR), 2, '0'))"


def price_ty(v: str = "price_vnd", raw: str = "price_raw") -> str:
    return f"(CASE WHEN {v} IS NOT NULL THEN concat({billions_text(v)}, ' tỷ') ELSE {raw} END)"


def price_plain(v: str = "price_vnd", raw: str = "price_raw") -> str:
    return (f"(CASE WHEN {v} IS NOT NULL THEN {billions_text(v)} "
            f"ELSE trim(replace(replace({raw}, 'tỷ', ''), ',', '.')) END)")


LOUT = ("house_id, title, address, district, posting_date, post_type, price_raw, "
        "CAST(price_vnd AS DOUBLE) AS price_vnd, area, direction, bedrooms, bathrooms, floors, "
        "width_meters, legal, interior, entrancewidth")

def _form_fields() -> str:
    """A form post as stored: VND as typed (no commas) or negotiable, rooms as typed, the request's date."""
    return """"Title" AS title, "Address" AS address, "District" AS district, '2025-06-01' AS posting_date, "PostType" AS post_type,
  CASE WHEN k%7=0 THEN 'Thỏa thuận' ELSE CAST((k+1)*1000000+ck AS VARCHAR) END AS price_raw,
  CASE WHEN k%7<>0 THEN CAST((k+1)*1000000+ck AS DECIMAL(20,2)) END AS price_vnd,
  CAST(20+k%180 AS DOUBLE) + (ck%10)/10.0 AS area, coalesce("Direction",'') AS direction,
  CAST(k%6 AS INTEGER) AS bedrooms, CAST(ck%5 AS INTEGER) AS bathrooms, CAST((k+ck)%7 AS INTEGER) AS floors,
  3+ck%9+0.5::DOUBLE AS width_meters, "Legal" AS legal, "Interior" AS interior,
  CASE WHEN k%3<>0 THEN CAST(k%8 AS DOUBLE) ELSE 0.0 END AS entrancewidth"""


VIEWS = f"""
pv AS (SELECT house_id, title, district, {price_ty()} AS price, CAST(price_vnd AS DOUBLE) AS price_vnd,
              area, bedrooms, bathrooms FROM listings),
apv AS (SELECT pv.* FROM pv JOIN listing_status s ON pv.house_id = s.house_id WHERE s.statue = '{SELLING}'),
pq AS (SELECT pv.*, d.user_id FROM pv JOIN listing_status s ON pv.house_id = s.house_id
       JOIN deposits d ON pv.house_id = d.house_id WHERE s.statue = '{PROCESSING}'),
survivors AS (SELECT min(house_id) AS house_id FROM listings GROUP BY title),
max_listing AS (SELECT coalesce(max(CAST(house_id AS BIGINT)), 0) AS m FROM listings
                WHERE regexp_matches(house_id, '^[0-9]+$')),
pairs AS (SELECT printf('%05d', o_orderkey+1) AS id_a, printf('%05d', o_orderkey+11) AS id_b FROM orders),
cmp AS (SELECT p.id_a, p.id_b,
          a.title AS a_title, b.title AS b_title, a.district AS a_district, b.district AS b_district,
          a.price_raw AS a_price_raw, b.price_raw AS b_price_raw, a.price_vnd AS a_price_vnd, b.price_vnd AS b_price_vnd,
          a.area AS a_area, b.area AS b_area, a.bedrooms AS a_bedrooms, b.bedrooms AS b_bedrooms,
          a.bathrooms AS a_bathrooms, b.bathrooms AS b_bathrooms, a.floors AS a_floors, b.floors AS b_floors,
          a.width_meters AS a_width_meters, b.width_meters AS b_width_meters
        FROM pairs p JOIN active a ON p.id_a = a.house_id JOIN active b ON p.id_b = b.house_id
        WHERE p.id_a <> p.id_b),
new_posts3 AS (SELECT concat('t', printf('%04d', (SELECT coalesce(max(CAST(substr(house_id,2) AS BIGINT)),0) FROM pending_listings
                      WHERE house_id LIKE 't%' AND regexp_matches(substr(house_id,2), '^[0-9]+$')) + row_number() OVER (ORDER BY k))) AS house_id,
                      {_form_fields()}, 'Đang chờ duyệt' AS statue, poster_id FROM base WHERE k%500=3),
new_posts4 AS (SELECT printf('%05d', (SELECT m FROM max_listing) + row_number() OVER (ORDER BY k)) AS house_id,
                      {_form_fields()} FROM base WHERE k%500=4),
approve_ids AS (SELECT house_id FROM pending_listings WHERE CAST(substr(house_id,2) AS BIGINT) % 2 = 0),
moved AS (SELECT printf('%05d', (SELECT m FROM max_listing) + row_number() OVER (ORDER BY house_id)) AS new_id, *
          FROM pending_listings WHERE house_id IN (SELECT house_id FROM approve_ids))
"""


def Q(body: str, extra: str = "") -> str:
    ctes = VIEWS.strip()
    if extra:
        ctes = ctes + ",\n" + extra.strip()
    return with_prelude(body, ctes)


def page(src: str, order: str, page_no: int = 2, per: int = 10, where: str = "") -> str:
    w = f" WHERE {where}" if where else ""
    off = (page_no - 1) * per
    return f"SELECT * FROM {src}{w} ORDER BY {order} LIMIT {per} OFFSET {off}"


def count_pages(src: str, where: str = "") -> str:
    w = f" WHERE {where}" if where else ""
    return (f"SELECT count(*) AS total, CAST((count(*) + 9) // 10 AS BIGINT) AS total_pages "
            f"FROM {src}{w}")


def ppm2(v: str, area: str) -> str:
    return (f"(CASE WHEN {area} IS NULL OR {area} = 0 THEN NULL ELSE "
            f"CAST(trunc(((coalesce(CAST({v} AS DOUBLE) / 1e9, 0.0)) * 1e9) / {area}) AS BIGINT) END)")


def thousands(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE format('{{:,}}', {x}) END)"


def truncate(c: str, n: int) -> str:
    return f"(CASE WHEN length({c}) > {n} THEN concat(substr({c}, 1, {n}), '...') ELSE {c} END)"


COMBINED = ("(title ILIKE '%machinery%' OR district ILIKE '%machinery%' OR house_id ILIKE '%machinery%') "
            "AND price_vnd >= 1e9 AND price_vnd <= 4e9 AND area >= 50 AND area <= 150 AND bedrooms >= 2")

NEG = "('Thỏa thuận','Thoả thuận')"
LISTING_RULES = [
    ("price_invalid", f"NOT coalesce((price_vnd > 0) OR price_raw IN {NEG}, false)"),
    ("area_not_positive", "NOT coalesce(area > 0, false)"),
    ("width_not_positive", "NOT coalesce(width_meters > 0, false)"),
    ("bedrooms_below_1", "NOT coalesce(bedrooms >= 1, false)"),
    ("bathrooms_below_1", "NOT coalesce(bathrooms >= 1, false)"),
    ("floors_below_1", "NOT coalesce(floors >= 1, false)"),
    ("entrance_negative", "coalesce(entrancewidth < 0, false)"),
    ("missing_required", " OR ".join(f"({c} IS NULL OR trim({c}) = '')" for c in
                                     ["title", "address", "district", "post_type", "price_raw", "legal", "interior"])),
    ("post_type_unknown", "NOT coalesce(post_type IN ('Bán','Cho thuê'), false)"),
    ("direction_unknown", "NOT (direction IS NULL OR direction = '' OR direction IN "
                          "('Đông','Tây','Nam','Bắc','Đông Nam','Đông Bắc','Tây Nam','Tây Bắc'))"),
    ("legal_unknown", "NOT coalesce(legal IN ('Sổ đỏ','Sổ hồng','Giấy tờ hợp lệ','Đang chờ sổ','Không'), false)"),
    ("interior_unknown", "NOT coalesce(interior IN ('Đầy đủ','Cơ bản','Cao cấp','Không nội thất'), false)"),
    ("district_unknown", "NOT coalesce(district IN ('Ba Đình','Cầu Giấy','Hoàn Kiếm','Hai Bà Trưng','Hoàng Mai',"
                         "'Đống Đa','Hà Đông','Tây Hồ','Long Biên','Nam Từ Liêm','Thanh Xuân','Đông Anh','Sóc Sơn',"
                         "'Gia Lâm','Thanh Trì','Mê Linh','Sơn Tây','Bắc Từ Liêm','Chương Mỹ','Ba Vì','Đan Phượng',"
                         "'Hoài Đức','Quốc Oai','Thạch Thất','Phúc Thọ','Thanh Oai','Ứng Hòa','Thường Tín',"
                         "'Phú Xuyên','Mỹ Đức'), false)"),
]
USER_RULES = [
    ("user_id_invalid", "NOT coalesce(regexp_matches(user_id, '^[a-zA-Z0-9_]{3,20}$'), false)"),
    ("phone_invalid", "NOT coalesce(regexp_matches(CAST(phone AS VARCHAR), '^[0-9]{10,11}$'), false)"),
    ("name_missing", "(username IS NULL OR trim(username) = '')"),
]


def failed(key: str, src: str, rules) -> str:
    reasons = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules)
    count = " + ".join(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for _, c in rules)
    return f"SELECT {key}, concat_ws(',', {reasons}) AS failed_rules, CAST({count} AS INTEGER) AS n_failed FROM {src}"


def set_status(hit_cte: str, new: str) -> str:
    return (f"SELECT house_id, CASE WHEN house_id IN (SELECT house_id FROM {hit_cte}) THEN '{new}' "
            f"ELSE statue END AS statue, poster_id FROM listing_status")


PENDING_VIEW = (f"house_id, title, district, {price_ty()} AS price, area, bedrooms, bathrooms, "
                "posting_date, poster_id")
APPROVED = (f"SELECT p.house_id, p.title, p.district, {price_ty('p.price_vnd', 'p.price_raw')} AS price, "
            "p.area, p.bedrooms, p.bathrooms, p.posting_date, s.poster_id, 'Đã phê duyệt' AS status "
            f"FROM listings p JOIN listing_status s ON p.house_id = s.house_id WHERE s.statue = '{SELLING}'")

# each listing's requests one after the other, on its status and its list of depositors
REQUEST_LOG = f"""
log AS (SELECT ts, event_id, CASE WHEN event_id % 10 < 4 THEN 'confirm' WHEN event_id % 10 < 7 THEN 'cancel'
          WHEN event_id % 10 = 7 THEN 'admin_cancel' ELSE 'status' END AS kind,
          printf('%05d', user_id + 1) AS house_id, concat('u', CAST(event_id // 10 % 5 AS VARCHAR)) AS user_id,
          ['admin', 'mod1', 'nobody'][event_id % 3 + 1] AS admin_id,
          CASE WHEN event_id % 4 = 0 THEN '{SELLING}' ELSE '{PROCESSING}' END AS statue FROM events),
good AS (SELECT *, row_number() OVER (PARTITION BY house_id ORDER BY ts, event_id) AS n FROM log
         WHERE (kind <> 'confirm' OR (user_id IN (SELECT user_id FROM users) AND house_id IN (SELECT house_id FROM listings)))
           AND (kind <> 'status' OR admin_id IN (SELECT admin_id FROM admins))),
steps AS (
 SELECT h.house_id, CAST(0 AS BIGINT) AS n, s.statue, coalesce(d.deps, CAST([] AS VARCHAR[])) AS deps
 FROM (SELECT DISTINCT house_id FROM good) h LEFT JOIN listing_status s ON s.house_id = h.house_id
 LEFT JOIN (SELECT house_id, list(user_id) AS deps FROM deposits GROUP BY house_id) d ON d.house_id = h.house_id
 UNION ALL
 SELECT g.house_id, g.n,
  CASE g.kind WHEN 'confirm' THEN CASE WHEN list_contains(p.deps, g.user_id) THEN p.statue ELSE '{PROCESSING}' END
   WHEN 'cancel' THEN CASE WHEN len(list_filter(p.deps, lambda x: x <> g.user_id)) = 0 THEN '{SELLING}' ELSE p.statue END
   WHEN 'admin_cancel' THEN '{SELLING}' ELSE g.statue END,
  CASE g.kind WHEN 'confirm' THEN CASE WHEN list_contains(p.deps, g.user_id) THEN p.deps ELSE list_append(p.deps, g.user_id) END
   WHEN 'cancel' THEN list_filter(p.deps, lambda x: x <> g.user_id) WHEN 'admin_cancel' THEN CAST([] AS VARCHAR[]) ELSE p.deps END
 FROM steps p JOIN good g ON g.house_id = p.house_id AND g.n = p.n + 1),
after_log AS (SELECT house_id, statue, deps FROM steps QUALIFY row_number() OVER (PARTITION BY house_id ORDER BY n DESC) = 1)
"""

CONFIRM = f"""
req AS (SELECT concat('u', CAST(user_id AS VARCHAR)) AS user_id, printf('%05d', event_id+1) AS house_id
        FROM events WHERE event_type = 'purchase'
        UNION ALL SELECT user_id, house_id FROM dep_src WHERE (l_suppkey + l_orderkey) % 4 = 1),
ok AS (SELECT DISTINCT user_id, house_id FROM req r
       WHERE user_id IN (SELECT user_id FROM users) AND house_id IN (SELECT house_id FROM listings)
         AND NOT EXISTS (SELECT 1 FROM deposits d WHERE d.user_id = r.user_id AND d.house_id = r.house_id))
"""
CANCEL = """
req AS (SELECT user_id, house_id FROM dep_src WHERE (l_suppkey + l_orderkey) % 4 = 0),
left_dep AS (SELECT user_id, house_id FROM deposits d
             WHERE NOT EXISTS (SELECT 1 FROM req r WHERE r.user_id = d.user_id AND r.house_id = d.house_id)),
revert AS (SELECT DISTINCT house_id FROM req WHERE house_id NOT IN (SELECT house_id FROM left_dep))
"""
ADMIN_CANCEL = """
hit AS (SELECT DISTINCT house_id FROM deposits
        WHERE house_id IN (SELECT house_id FROM listings) AND (CAST(house_id AS BIGINT) - 1) % 50 = 0)
"""
UPDATE = f"""
upd AS (SELECT CASE WHEN event_id % 3 <> 0 THEN 'admin' ELSE 'nobody' END AS admin_id,
               printf('%05d', event_id - event_id % 8 + 1) AS house_id,
               CASE CAST(floor(event_id / 3) AS BIGINT) % 3 WHEN 0 THEN '{SELLING}' WHEN 1 THEN '{SOLD}'
                    ELSE '{PROCESSING}' END AS statue, ts, event_id
        FROM events WHERE event_type = 'error'),
last AS (SELECT house_id, statue FROM (
           SELECT *, row_number() OVER (PARTITION BY house_id ORDER BY ts DESC, event_id DESC) AS rn
           FROM upd WHERE admin_id IN (SELECT admin_id FROM admins)) WHERE rn = 1)
"""
BUY = """
hit AS (SELECT DISTINCT printf('%05d', event_id + 1) AS house_id FROM events
        WHERE event_type = 'view' AND concat('u', CAST(user_id * 37 AS VARCHAR)) IN (SELECT user_id FROM users))
"""
DELETE_USERS = "gone AS (SELECT concat('u', CAST(c_custkey AS VARCHAR)) AS user_id FROM customer WHERE c_custkey % 10 = 0)"
REGISTER = """
sig AS (SELECT concat('u', CAST(user_id * 37 AS VARCHAR)) AS user_id,
               concat('User ', CAST(user_id AS VARCHAR)) AS username,
               CAST(910000000 + user_id AS BIGINT) AS phone, ts, event_id
        FROM events WHERE event_type = 'signup'),
first_sig AS (SELECT user_id, username, phone FROM (
               SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM sig) WHERE rn = 1)
"""

_DETAIL_COLS = ["title", "address", "district", "posting_date", "post_type", "area", "direction",
                "bedrooms", "bathrooms", "floors", "width_meters", "legal", "interior", "entrancewidth"]
DETAIL = " UNION ALL ".join(
    [f"SELECT house_id, 'price' AS column_name, coalesce({price_plain()}, 'Không có thông tin') AS value FROM listings"]
    + [f"SELECT house_id, '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), 'Không có thông tin') AS value "
       f"FROM listings" for c in _DETAIL_COLS])

ANY_PQ = ("contains(lower(concat_ws(chr(1), " + ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), '')" for c in
    ["house_id", "title", "district", "price", "area", "bedrooms", "bathrooms", "user_id"]) + ")), 'nation_2')")
ANY_USERS = ("contains(lower(concat_ws(chr(1), " + ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), '')" for c in ["user_id", "username", "phone"]) + ")), '#00000012')")

FLAG_SPECS = [("price", "price_vnd", False, False), ("area", "area", True, False),
              ("bedrooms", "bedrooms", True, False), ("bathrooms", "bathrooms", True, False),
              ("floors", "floors", True, True), ("width", "width_meters", True, True)]


def _flags() -> str:
    parts = []
    for name, col, larger, nonzero in FLAG_SPECS:
        a, b = f"a_{col}", f"b_{col}"
        fa = f"coalesce({a} > {b}, false)" if larger else f"coalesce({b} > {a}, false)"
        fb = f"coalesce({b} > {a}, false)" if larger else f"coalesce({a} > {b}, false)"
        if nonzero:
            shown = f"coalesce({a} <> 0 AND {b} <> 0, false)"
            fa, fb = f"({fa} AND {shown})", f"({fb} AND {shown})"
        parts += [f"{fa} AS a_better_{name}", f"{fb} AS b_better_{name}"]
    return ", ".join(parts)


def oracle_queries() -> dict[str, str]:
    o: dict[str, str] = {}
    # 2.1 sources and sinks
    o["src_raw_listings"] = Q("SELECT * REPLACE (row_number() OVER (ORDER BY row_ordinal) - 1 AS row_ordinal) FROM raw_listings")
    o["src_trim_columns"] = Q("SELECT * FROM raw_listings")
    o["src_training_table"] = Q(
        "SELECT house_id, area, bedrooms, bathrooms, floors, width_meters, CAST(price_vnd AS DOUBLE) AS price "
        "FROM listings WHERE price_vnd IS NOT NULL AND area IS NOT NULL AND bedrooms IS NOT NULL "
        "AND bathrooms IS NOT NULL AND floors IS NOT NULL AND width_meters IS NOT NULL")
    o["sink_replace_table"] = Q(f"SELECT {LOUT} FROM listings")
    o["view_property"] = Q("SELECT * FROM pv")
    o["sink_append_rows"] = Q(f"SELECT {LOUT} FROM listings UNION ALL SELECT {LOUT} FROM new_posts4")
    # 2.2 cleaning
    not_rent = "NOT coalesce(contains(\"Price\", '/tháng'), false)"
    o["clean_drop_monthly"] = Q(f'SELECT row_ordinal, "Price" FROM raw_listings WHERE {not_rent}')
    o["clean_price_ty"] = Q("SELECT house_id, price_raw, CAST(price_vnd AS DOUBLE) AS price_vnd FROM listings "
                            "WHERE contains(price_raw, 'tỷ')")
    o["clean_price_plain"] = Q(
        f"SELECT house_id, price_raw, CASE WHEN regexp_matches(trim(replace(price_raw, ',', '.')), '{LOOSE}') "
        f"THEN CAST(trim(replace(price_raw, ',', '.')) AS DOUBLE) END AS price_number "
        f"FROM listings WHERE NOT contains(price_raw, 'tỷ')")
    o["clean_price_per_m2"] = Q(
        "SELECT house_id, price_raw, area, CAST(price_vnd AS DOUBLE) AS price_vnd FROM listings "
        "WHERE NOT contains(price_raw, 'tỷ') AND price_vnd IS NOT NULL")
    o["clean_area"] = Q("SELECT house_id, area FROM listings")
    o["clean_room_counts"] = Q("SELECT house_id, bedrooms, bathrooms, floors FROM listings")
    o["clean_category_defaults"] = Q("SELECT house_id, legal, interior FROM listings")
    o["clean_widths"] = Q("SELECT house_id, width_meters, entrancewidth FROM listings")
    o["clean_surrogate_id"] = Q(f"SELECT row_ordinal, printf('%05d', row_ordinal+1) AS house_id "
                                f"FROM raw_listings WHERE {not_rent}")
    o["clean_reorder"] = Q(f"SELECT {LOUT} FROM listings")
    o["clean_listings"] = Q(f"SELECT {LOUT} FROM listings")
    txt = "(CASE WHEN price_vnd IS NOT NULL THEN CAST(price_vnd AS VARCHAR) ELSE price_raw END)"
    o["numeric_price_guard"] = Q(
        f"SELECT house_id, CAST(TRY_CAST({txt} AS DECIMAL(20,2)) AS DOUBLE) AS price FROM listings "
        f"WHERE regexp_matches({txt}, '{NUM_RE}')")
    o["dedup_title_keep_min_id"] = Q(f"SELECT {LOUT} FROM listings WHERE house_id IN (SELECT house_id FROM survivors)")
    o["dedup_cascade"] = Q("SELECT user_id, house_id FROM favorites WHERE house_id IN (SELECT house_id FROM survivors)")
    o["dedup_cascade__deposits"] = Q("SELECT user_id, house_id FROM deposits WHERE house_id IN (SELECT house_id FROM survivors)")
    o["dedup_cascade__status"] = Q("SELECT house_id, statue, poster_id FROM listing_status "
                                   "WHERE house_id IN (SELECT house_id FROM survivors)")
    # 2.3 filters, search, sort, paging
    o["active_page"] = Q(page("apv", "house_id"))
    o["active_count_pages"] = Q(count_pages("active"))
    o["active_keyset_page"] = Q("SELECT * FROM apv WHERE house_id > '01000' ORDER BY house_id LIMIT 10")
    o["all_page"] = Q(page("pv", "house_id"))
    o["filter_area"] = Q(page("pv", "house_id", where="district ILIKE '%nation_1%'"))
    o["filter_price"] = Q(page("pv", "house_id", where="price_vnd >= 1e9 AND price_vnd <= 4e9"))
    fap = "district ILIKE '%nation_1%' AND price_vnd >= 1e9 AND price_vnd <= 4e9"
    o["filter_area_price"] = Q(page("pv", "house_id", where=fap))
    o["filter_area_price_count_pages"] = Q(count_pages("pv", fap))
    o["find_text"] = Q(f"SELECT house_id, title, address, district, {price_ty()} AS price FROM listings "
                       "WHERE title ILIKE '%machinery%' OR address ILIKE '%machinery%' OR house_id ILIKE '%machinery%'")
    o["search_listings"] = Q(page("apv", "house_id", 1, where=COMBINED))
    o["search_count_pages"] = Q(count_pages("apv", COMBINED))
    o["search_district"] = Q(page("apv", "coalesce(price_vnd, 0) DESC, house_id", 1, where="district = 'NATION_3'"))
    o["sort_house_id"] = Q(page("apv", "house_id"))
    o["sort_newest"] = Q(page("apv", "house_id DESC"))
    o["sort_price_low"] = Q(page("apv", "coalesce(price_vnd, 999999999999) ASC, house_id"))
    o["sort_price_high"] = Q(page("apv", "coalesce(price_vnd, 0) DESC, house_id"))
    o["sort_area_large"] = Q("SELECT * FROM apv ORDER BY area DESC NULLS FIRST, house_id")
    o["sort_unknown_key"] = Q(page("apv", "house_id"))
    o["distinct_districts"] = Q("SELECT DISTINCT district FROM active")
    o["lookup_by_id"] = Q(f"SELECT {LOUT} FROM listings WHERE house_id IN (SELECT house_id FROM favorites)")
    o["detail_unpivot"] = Q(DETAIL)
    o["status_lookup"] = Q("SELECT house_id, statue FROM listing_status WHERE house_id IN (SELECT house_id FROM deposits)")
    o["anycol_contains_processing"] = Q(
        f"SELECT house_id, title, district, price, area, bedrooms, bathrooms, user_id FROM pq WHERE {ANY_PQ}")
    o["anycol_contains_users"] = Q(f"SELECT user_id, username, phone FROM users WHERE {ANY_USERS}")
    o["anycol_contains_users_count"] = Q(f"SELECT count(*) AS match_count FROM users WHERE {ANY_USERS}")
    # 2.4 aggregations
    o["district_counts_top10"] = Q("SELECT district, count(*) AS listing_count FROM active GROUP BY district "
                                   "ORDER BY listing_count DESC, district LIMIT 10")
    o["district_avg_price_top10"] = Q(
        "SELECT district, count(*) AS priced_count, round(CAST(sum(price_vnd) AS DOUBLE) / count(*) / 1e9, 2) "
        "AS avg_price_ty FROM active WHERE price_vnd IS NOT NULL GROUP BY district "
        "ORDER BY avg_price_ty DESC, district LIMIT 10")
    o["pending_count_pages"] = Q(count_pages("pending_listings"))
    o["user_count"] = Q("SELECT count(*) AS user_count FROM users")
    o["favorites_count"] = Q(
        f"SELECT f.user_id, count(*) AS favorite_count FROM favorites f JOIN listings p ON f.house_id = p.house_id "
        f"JOIN listing_status s ON p.house_id = s.house_id WHERE s.statue = '{SELLING}' GROUP BY f.user_id")
    o["deposits_count"] = Q("SELECT user_id, count(*) AS deposit_count FROM pq GROUP BY user_id")
    o["deposits_total"] = Q("SELECT count(*) AS deposit_total FROM pq")
    o["remaining_deposits"] = Q("SELECT house_id, count(*) AS deposit_count FROM deposits GROUP BY house_id")
    # 2.5 joins
    o["join_listing_status"] = Q("SELECT p.house_id, p.title, p.district, s.statue, s.poster_id "
                                 "FROM listings p JOIN listing_status s ON p.house_id = s.house_id")
    fa = (f"SELECT pv.*, f.user_id FROM pv JOIN favorites f ON pv.house_id = f.house_id "
          f"JOIN listing_status s ON pv.house_id = s.house_id WHERE s.statue = '{SELLING}'")
    o["favorites_active"] = Q(fa)
    o["favorites_active_user"] = Q(fa + " AND f.user_id = 'u7'")
    o["favorites_all"] = Q("SELECT pv.*, f.user_id FROM pv JOIN favorites f ON pv.house_id = f.house_id")
    o["my_deposits"] = Q("SELECT * FROM pq WHERE user_id = 'u7'")
    o["processing_queue"] = Q("SELECT * FROM pq")
    o["compare_pair"] = Q(
        f"SELECT id_a, id_b, a_title, b_title, a_district, b_district, "
        f"{price_ty('a_price_vnd', 'a_price_raw')} AS a_price, {price_ty('b_price_vnd', 'b_price_raw')} AS b_price, "
        f"{truncate('a_title', 30)} AS a_title_short, {truncate('b_title', 30)} AS b_title_short FROM cmp")
    o["compare_flags"] = Q(f"SELECT id_a, id_b, {_flags()} FROM cmp")
    a_p, b_p = ppm2("a_price_vnd", "a_area"), ppm2("b_price_vnd", "b_area")
    o["compare_price_per_m2"] = Q(
        f"SELECT id_a, id_b, {a_p} AS a_ppm2, {b_p} AS b_ppm2, {thousands(a_p)} AS a_ppm2_text, "
        f"{thousands(b_p)} AS b_ppm2_text, coalesce({b_p} > {a_p}, false) AS a_better_ppm2, "
        f"coalesce({a_p} > {b_p}, false) AS b_better_ppm2 FROM cmp")
    # 2.6 moderation
    o["pending_page"] = Q(f"SELECT {PENDING_VIEW} FROM pending_listings ORDER BY posting_date DESC, house_id LIMIT 10")
    o["pending_detail"] = Q(
        "SELECT house_id, title, address, district, posting_date, post_type, price_raw, area, direction, bedrooms, "
        "bathrooms, floors, width_meters, legal, interior, entrancewidth, statue, poster_id, "
        f"{price_ty()} AS price FROM pending_listings")
    o["my_posts_pending"] = Q(f"SELECT {PENDING_VIEW}, 'Chờ phê duyệt' AS status FROM pending_listings")
    o["my_posts_pending_user"] = Q(f"SELECT {PENDING_VIEW}, 'Chờ phê duyệt' AS status FROM pending_listings "
                                   "WHERE poster_id IN ('u7', 'u131', 'u222')")
    o["my_posts_approved"] = Q(APPROVED + " ORDER BY p.posting_date DESC, p.house_id LIMIT 50")
    o["my_posts_approved_user"] = Q(APPROVED + " AND s.poster_id = 'u7'")
    o["my_posts_all"] = Q(f"SELECT {PENDING_VIEW}, 'Chờ phê duyệt' AS status FROM pending_listings UNION ALL "
                          f"SELECT * FROM ({APPROVED} ORDER BY p.posting_date DESC, p.house_id LIMIT 50)")
    o["users_list"] = Q("SELECT user_id, username, phone FROM users")
    # 2.7 change batches
    o["chg_add_favorites"] = Q(
        "SELECT user_id, house_id FROM favorites UNION ALL "
        "SELECT b.user_id, b.house_id FROM (SELECT concat('u', CAST(user_id AS VARCHAR)) AS user_id, "
        "printf('%05d', event_id + 1) AS house_id FROM events WHERE event_type = 'click') b "
        "WHERE b.user_id IN (SELECT user_id FROM users) AND b.house_id IN (SELECT house_id FROM listings)")
    o["chg_remove_favorites"] = Q(
        "SELECT user_id, house_id FROM favorites f WHERE NOT EXISTS (SELECT 1 FROM fav_src r "
        "WHERE (r.l_suppkey + r.l_orderkey) % 10 = 0 AND r.user_id = f.user_id AND r.house_id = f.house_id)")
    o["chg_confirm_deposits"] = Q(set_status("ok", PROCESSING), CONFIRM)
    o["chg_confirm_deposits__deposits"] = Q(
        "SELECT user_id, house_id FROM deposits UNION ALL SELECT user_id, house_id FROM ok", CONFIRM)
    o["chg_cancel_deposits"] = Q(set_status("revert", SELLING), CANCEL)
    o["chg_cancel_deposits__deposits"] = Q("SELECT user_id, house_id FROM left_dep", CANCEL)
    o["chg_admin_cancel"] = Q(set_status("hit", SELLING), ADMIN_CANCEL)
    o["chg_admin_cancel__deposits"] = Q(
        "SELECT user_id, house_id FROM deposits WHERE house_id NOT IN (SELECT house_id FROM hit)", ADMIN_CANCEL)
    o["chg_update_status"] = Q(
        "SELECT s.house_id, coalesce(l.statue, s.statue) AS statue, s.poster_id "
        "FROM listing_status s LEFT JOIN last l ON s.house_id = l.house_id", UPDATE)
    o["chg_request_log"] = "WITH RECURSIVE" + Q(
        "SELECT s.house_id, coalesce(a.statue, s.statue) AS statue, s.poster_id FROM listing_status s "
        "LEFT JOIN after_log a ON s.house_id = a.house_id", REQUEST_LOG).removeprefix("WITH")
    o["chg_request_log__deposits"] = "WITH RECURSIVE" + Q(
        "SELECT unnest(deps) AS user_id, house_id FROM after_log UNION ALL "
        "SELECT user_id, house_id FROM deposits WHERE house_id NOT IN (SELECT house_id FROM after_log)", REQUEST_LOG).removeprefix("WITH")
    o["chg_buy_request"] = Q(set_status("hit", PROCESSING), BUY)
    o["chg_submit_posts"] = Q(
        f"SELECT {LOUT}, statue, poster_id FROM pending_listings UNION ALL "
        f"SELECT {LOUT}, statue, poster_id FROM new_posts3")
    o["chg_admin_posts"] = Q(f"SELECT {LOUT} FROM listings UNION ALL SELECT {LOUT} FROM new_posts4")
    o["chg_admin_posts__status"] = Q(
        f"SELECT house_id, statue, poster_id FROM listing_status UNION ALL "
        f"SELECT house_id, '{SELLING}' AS statue, 'admin' AS poster_id FROM new_posts4")
    mv = LOUT.replace("house_id,", "new_id AS house_id,", 1)
    o["chg_approve_posts"] = Q(f"SELECT {LOUT} FROM listings UNION ALL SELECT {mv} FROM moved")
    o["chg_approve_posts__status"] = Q(
        f"SELECT house_id, statue, poster_id FROM listing_status UNION ALL "
        f"SELECT new_id AS house_id, '{SELLING}' AS statue, coalesce(poster_id, 'admin') AS poster_id FROM moved")
    o["chg_approve_posts__pending"] = Q(
        f"SELECT {LOUT}, statue, poster_id FROM pending_listings WHERE house_id NOT IN (SELECT house_id FROM approve_ids)")
    o["chg_reject_posts"] = Q(
        f"SELECT {LOUT}, statue, poster_id FROM pending_listings WHERE NOT "
        f"(CAST(substr(house_id, 2) AS BIGINT) % 5 = 0 AND CAST(substr(house_id, 2) AS BIGINT) % 2 = 1)")
    o["chg_delete_users"] = Q("SELECT user_id, username, phone FROM users WHERE user_id NOT IN "
                              "(SELECT user_id FROM gone)", DELETE_USERS)
    o["chg_delete_users__favorites"] = Q("SELECT user_id, house_id FROM favorites WHERE user_id NOT IN "
                                         "(SELECT user_id FROM gone)", DELETE_USERS)
    o["chg_delete_users__deposits"] = Q("SELECT user_id, house_id FROM deposits WHERE user_id NOT IN "
                                        "(SELECT user_id FROM gone)", DELETE_USERS)
    o["chg_register_users"] = Q(
        "SELECT user_id, username, phone FROM users UNION ALL SELECT user_id, username, phone FROM first_sig "
        "WHERE user_id NOT IN (SELECT user_id FROM users)", REGISTER)
    # 2.8 scalar functions and data quality
    o["fmt_price_ty"] = Q(f"SELECT house_id, price_raw, {price_ty()} AS price_text FROM listings")
    o["fmt_price_plain"] = Q(f"SELECT house_id, {price_plain()} AS price_text FROM listings")
    o["fmt_price_long"] = Q(
        f"SELECT house_id, concat(format('{{:,.2f}}', CAST({cents('price_vnd')} AS DOUBLE) / 100), ' tỷ VND') "
        "AS price_long FROM listings WHERE price_vnd IS NOT NULL")
    pp = ppm2("price_vnd", "area")
    o["fmt_thousands"] = Q(f"SELECT house_id, {pp} AS ppm2, {thousands(pp)} AS ppm2_text FROM listings "
                           "WHERE price_vnd IS NOT NULL AND area > 0")
    o["text_truncate"] = Q(f"SELECT house_id, {truncate('title', 30)} AS title_30, {truncate('title', 45)} AS title_45, "
                           "substr(district, 1, 15) AS district_15 FROM listings")
    o["compare_raw_price"] = Q("SELECT house_id, coalesce(CAST(price_vnd AS DOUBLE) / 1e9, 0.0) AS price_ty FROM listings")
    o["price_input_normalise"] = Q(
        "SELECT row_ordinal, CASE WHEN \"Price\" IN ('Thỏa thuận','Thoả thuận') THEN \"Price\" "
        "ELSE replace(\"Price\", ',', '') END AS price_input FROM raw_listings")
    names = [x.strip().strip("'") for x in LISTING_RULES[-1][1].split("(", 2)[2].split(")")[0].split(",")]
    district = " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(names))
    o["dq_listings"] = Q(failed("house_id", "forms", LISTING_RULES), f"""
forms AS (SELECT * REPLACE (
  CASE WHEN n % 40 < 30 THEN CASE n % 30 {district} END ELSE district END AS district,
  CASE WHEN n % 11 = 0 THEN 0 ELSE width_meters END AS width_meters, CASE WHEN n % 13 = 0 THEN -1 ELSE entrancewidth END AS entrancewidth,
  CASE WHEN n % 17 = 0 THEN 'Khác' ELSE legal END AS legal, CASE WHEN n % 19 <> 0 THEN interior END AS interior,
  CASE WHEN n % 23 = 0 THEN ' ' ELSE post_type END AS post_type, CASE WHEN n % 29 = 0 THEN 'Giữa' ELSE direction END AS direction,
  CASE WHEN n % 31 = 0 THEN 0 ELSE bedrooms END AS bedrooms, CASE WHEN n % 37 <> 0 THEN bathrooms END AS bathrooms,
  CASE WHEN n % 41 = 0 THEN -1 ELSE floors END AS floors)
  FROM (SELECT *, CAST(house_id AS BIGINT) AS n FROM listings))""")
    o["dq_users"] = Q(failed("user_id", "forms", USER_RULES), """
forms AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN concat('u-', c_custkey) ELSE concat('user', c_custkey) END AS user_id,
  CASE WHEN c_custkey % 11 = 0 THEN '  ' WHEN c_custkey % 13 <> 0 THEN c_name END AS username,
  CASE WHEN c_custkey % 3 = 0 THEN 900000000 ELSE 9000000000 END + c_custkey AS phone FROM customer)""")
    ty = "trim(replace(replace(replace(\"Price\",'\"',''),'tỷ',''),',','.'))"
    ppm = "trim(replace(replace(\"Price\",',','.'),'triệu/m²',''))"
    o["dq_raw_prices"] = Q(
        f"""SELECT row_ordinal, "Price", reason FROM (SELECT r.row_ordinal, r."Price",
          CASE WHEN NOT CASE WHEN contains("Price", 'tỷ') THEN regexp_matches({ty}, '{LOOSE}')
                 ELSE (regexp_matches({ppm}, '{LOOSE}') OR trim("Price") IN {NEG}) END THEN 'price_unparsable'
               WHEN l.price_vnd IS NULL AND trim("Price") NOT IN {NEG} AND (contains("Price", 'tỷ') OR l.area IS NOT NULL)
               THEN 'price_out_of_range' END AS reason
          FROM raw_listings r JOIN listings l ON l.house_id = printf('%05d', r.row_ordinal + 1)
          WHERE "Price" IS NOT NULL) WHERE reason IS NOT NULL""")
    # the streams must leave the same tables as the batch jobs
    o["stream_status_updates"] = o["chg_update_status"]
    o["stream_add_favorites"] = o["chg_add_favorites"]
    o["stream_request_log"] = o["chg_request_log"]
    o["stream_request_log__deposits"] = o["chg_request_log__deposits"]
    from abode.plans.model_oracle import model_oracle_queries
    o.update(model_oracle_queries(Q))
    return o
