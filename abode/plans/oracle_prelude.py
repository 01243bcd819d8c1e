"""DuckDB SQL for the independent oracle: fixture binding and cleaning as CTEs.

Written by hand in plain SQL, separately from the DataFrame code, so that the
driver's side-by-side check compares two independent implementations. Each
query in ``oracle_queries`` is ``PRELUDE + <select over these CTE names>``;
DuckDB only evaluates the CTEs a query references.
"""

from __future__ import annotations

LOOSE = r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"
INT_RE = r"^[0-9]+$"
NUM_RE = r"^[0-9]+(\.[0-9]+)?$"

BASE = r"""
base AS (
 SELECT o_orderkey AS k, o_custkey AS ck, printf('%05d', o_orderkey+1) AS house_id,
  concat(c_mktsegment,' ',n_name,' ',CAST(CAST(floor(o_totalprice/1000) AS BIGINT) AS VARCHAR)) AS "Title",
  concat(c_name,', ',n_name) AS "Address", n_name AS "District",
  strftime(o_orderdate,'%Y-%m-%d') AS "PostingDate",
  CASE WHEN o_orderkey%10=9 THEN 'Cho thuê' ELSE 'Bán' END AS "PostType",
  CASE WHEN o_orderkey%50=0 THEN concat(CAST(CAST(floor(h/100) AS BIGINT) AS VARCHAR),',',lpad(CAST(h%100 AS VARCHAR),2,'0'),lpad(CAST(o_orderkey%1000 AS VARCHAR),3,'0'),' tỷ')
       WHEN o_orderkey%50=10 THEN concat(CAST(CAST(floor(h/10) AS BIGINT) AS VARCHAR),'.',CAST(h%10 AS VARCHAR),lpad(CAST(o_orderkey%1000 AS VARCHAR),4,'0'))
       WHEN o_orderkey%50=20 THEN concat(CAST(5500000000+o_orderkey AS VARCHAR), '00000000')
       WHEN o_orderkey%50=30 THEN concat('Liên hệ ', CAST(h AS VARCHAR))
       WHEN o_orderkey%50=40 THEN concat('"',CAST(CAST(floor(h/100) AS BIGINT) AS VARCHAR),',5" tỷ')
       WHEN o_orderkey%10<=3 THEN concat(CAST(CAST(floor(h/100) AS BIGINT) AS VARCHAR),',',lpad(CAST(h%100 AS VARCHAR),2,'0'),' tỷ')
       WHEN o_orderkey%10<=7 THEN concat(CAST(CAST(floor(h/10) AS BIGINT) AS VARCHAR),',',CAST(h%10 AS VARCHAR),' triệu/m²')
       WHEN o_orderkey%10=8 THEN 'Thỏa thuận' ELSE concat(CAST(h AS VARCHAR),' triệu/tháng') END AS "Price",
  CASE WHEN o_orderkey%97=0 THEN 'KXĐ' ELSE concat(CAST(20+o_orderkey%180 AS VARCHAR),',',CAST(o_custkey%10 AS VARCHAR),' m²') END AS "Area",
  CASE o_orderkey%9 WHEN 0 THEN 'Đông' WHEN 1 THEN 'Tây' WHEN 2 THEN 'Nam' WHEN 3 THEN 'Bắc'
       WHEN 4 THEN 'Đông Nam' WHEN 5 THEN 'Đông Bắc' WHEN 6 THEN 'Tây Nam' WHEN 7 THEN 'Tây Bắc' ELSE NULL END AS "Direction",
  concat(CAST(o_orderkey%6 AS VARCHAR),' phòng') AS "Bedrooms",
  concat(CAST(o_custkey%5 AS VARCHAR),' phòng') AS "Bathrooms",
  concat(CAST((o_orderkey+o_custkey)%7 AS VARCHAR),' tầng') AS "Floors",
  concat(CAST(3+o_custkey%9 AS VARCHAR),',',CAST(o_orderkey%10 AS VARCHAR),' m') AS "Width_meters",
  CASE o_orderkey%5 WHEN 0 THEN '0' WHEN 1 THEN 'Sổ đỏ' WHEN 2 THEN 'Sổ hồng' WHEN 3 THEN 'Giấy tờ hợp lệ' ELSE 'Đang chờ sổ' END AS "Legal",
  CASE o_orderkey%4 WHEN 0 THEN '0' WHEN 1 THEN 'Đầy đủ' WHEN 2 THEN 'Cơ bản' ELSE 'Cao cấp' END AS "Interior",
  CASE WHEN o_orderkey%8=0 THEN '0' ELSE concat(CAST(o_orderkey%8 AS VARCHAR),',5 m') END AS "Entrancewidth",
  CASE o_orderstatus WHEN 'O' THEN 'Đang bán' WHEN 'F' THEN 'Đã bán' ELSE 'Đang xử lý' END AS statue,
  concat('u',CAST(o_custkey AS VARCHAR)) AS poster_id
 FROM (SELECT *, CAST(floor(o_totalprice/1000) AS BIGINT) AS h FROM orders) o
 JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
)"""


def digits(text: str) -> str:
    """A number text times 1e10 as a whole number: its digits, with the point moved by hand."""
    return (f"CAST(concat('0', split_part({text},'.',1), rpad(substr(split_part({text},'.',2),1,10),10,'0')) AS HUGEINT)")


def vnd(cents: str, text: str) -> str:
    """Whole hundredths as money; null for numbers that cannot fit 18 places before the point."""
    return (f"(CASE WHEN length(split_part({text},'.',1)) <= 15 AND ({cents}) < 100000000000000000000 THEN "
            f"CAST(concat(CAST(({cents}) // 100 AS VARCHAR), '.', lpad(CAST(({cents}) % 100 AS VARCHAR),2,'0')) AS DECIMAL(20,2)) END)")


def _clean_select(src: str, id_expr: str, extra: str = "") -> str:
    """Cleaning rules over a raw-text relation ``src`` (one projection)."""
    return rf"""
 SELECT {id_expr} AS house_id, "Title" AS title, "Address" AS address, "District" AS district,
  "PostingDate" AS posting_date, "PostType" AS post_type, "Price" AS price_raw,
  CASE WHEN contains("Price",'tỷ') THEN CASE WHEN regexp_matches(ty_txt,'{LOOSE}') THEN {vnd(f"{digits('ty_txt')} * 10", "ty_txt")} END
       WHEN regexp_matches(ppm_txt,'{LOOSE}') AND regexp_matches(a_txt,'{LOOSE}')
       THEN {vnd(f"({digits('ppm_txt')} * {digits('a_txt')} + 500000000000) // 1000000000000", "ppm_txt")}
  END AS price_vnd,
  area_num AS area, "Direction" AS direction,
  CASE WHEN regexp_matches(bed_txt,'{INT_RE}') THEN greatest(TRY_CAST(bed_txt AS INTEGER),1) END AS bedrooms,
  CASE WHEN regexp_matches(bath_txt,'{INT_RE}') THEN greatest(TRY_CAST(bath_txt AS INTEGER),1) END AS bathrooms,
  CASE WHEN regexp_matches(floor_txt,'{INT_RE}') THEN greatest(TRY_CAST(floor_txt AS INTEGER),1) END AS floors,
  CASE WHEN regexp_matches(w_txt,'{LOOSE}') THEN TRY_CAST(w_txt AS DOUBLE) END AS width_meters,
  CASE WHEN "Legal"='0' THEN 'Không' ELSE "Legal" END AS legal,
  CASE WHEN "Interior"='0' THEN 'Không nội thất' ELSE "Interior" END AS interior,
  CASE WHEN e_txt='0' THEN NULL WHEN regexp_matches(e_txt,'{LOOSE}') THEN TRY_CAST(e_txt AS DOUBLE) END AS entrancewidth
  {extra}
 FROM (
  SELECT *,
   trim(replace(replace(replace("Price",'"',''),'tỷ',''),',','.')) AS ty_txt,
   trim(replace(replace("Price",',','.'),'triệu/m²','')) AS ppm_txt,
   trim(replace(replace("Area",'m²',''),',','.')) AS a_txt,
   CASE WHEN regexp_matches(trim(replace(replace("Area",'m²',''),',','.')),'{LOOSE}')
        THEN TRY_CAST(trim(replace(replace("Area",'m²',''),',','.')) AS DOUBLE) END AS area_num,
   trim(replace("Bedrooms",'phòng','')) AS bed_txt,
   trim(replace("Bathrooms",'phòng','')) AS bath_txt,
   trim(replace("Floors",'tầng','')) AS floor_txt,
   trim(replace(replace("Width_meters",'m',''),',','.')) AS w_txt,
   trim(replace(replace("Entrancewidth",'m',''),',','.')) AS e_txt
  FROM {src}
  WHERE NOT coalesce(contains("Price",'/tháng'), false)
 ) c"""


TABLES = rf"""
raw_listings AS (
 SELECT k AS row_ordinal, "Title","Address","District","PostingDate","PostType","Price","Area","Direction",
  "Bedrooms","Bathrooms","Floors","Width_meters","Legal","Interior","Entrancewidth"
 FROM base WHERE k%20<>7
),
listings AS ({_clean_select("raw_listings", "printf('%05d', row_ordinal+1)")}
),
listing_status AS (SELECT house_id, statue, poster_id FROM base WHERE k%20<>7),
pending_listings AS ({_clean_select("(SELECT * FROM base WHERE k%20=7)",
                                    "concat('t', printf('%04d', CAST(floor(k/20) AS BIGINT)+1))",
                                    ", 'Đang chờ duyệt' AS statue, poster_id")}
),
users AS (SELECT concat('u',CAST(c_custkey AS VARCHAR)) AS user_id, c_name AS username,
                 CAST(900000000 + c_custkey AS BIGINT) AS phone FROM customer),
admins AS (SELECT * FROM (VALUES ('admin','Admin'),('mod1','Moderator')) t(admin_id, admin_name)),
fav_src AS (SELECT l_orderkey, l_suppkey, concat('u',CAST(l_suppkey AS VARCHAR)) AS user_id,
                   printf('%05d', l_orderkey+1) AS house_id
            FROM lineitem WHERE l_returnflag='A' AND l_orderkey%20<>7),
favorites AS (SELECT user_id, house_id FROM fav_src),
dep_src AS (SELECT DISTINCT l_orderkey, l_suppkey, concat('u',CAST(l_suppkey AS VARCHAR)) AS user_id,
                   printf('%05d', l_orderkey+1) AS house_id
            FROM lineitem WHERE l_returnflag='R' AND l_orderkey%20<>7),
deposits AS (SELECT user_id, house_id FROM dep_src),
active AS (SELECT p.*, s.statue, s.poster_id FROM listings p JOIN listing_status s ON p.house_id=s.house_id
           WHERE s.statue='Đang bán')"""

PRELUDE = "WITH " + BASE.strip() + ",\n" + TABLES.strip() + "\n"


def with_prelude(body: str, extra_ctes: str = "") -> str:
    """Full oracle statement: prelude CTEs (+ extra CTEs) then ``body``."""
    if extra_ctes:
        return PRELUDE + "," + extra_ctes.strip() + "\n" + body.strip()
    return PRELUDE + body.strip()
