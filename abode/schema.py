"""Schemas and fixed values of the listing data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the application's vocabulary for right results) ---
STATUS_SELLING = "Đang bán"
STATUS_SOLD = "Đã bán"
STATUS_PROCESSING = "Đang xử lý"
STATUS_PENDING = "Đang chờ duyệt"
STATUSES = [STATUS_SELLING, STATUS_SOLD, STATUS_PROCESSING]
POST_LABEL_PENDING = "Chờ phê duyệt"
POST_LABEL_APPROVED = "Đã phê duyệt"
POST_TYPES = ["Bán", "Cho thuê"]
NEGOTIABLE = ["Thỏa thuận", "Thoả thuận"]
DIRECTIONS = ["Đông", "Tây", "Nam", "Bắc", "Đông Nam", "Đông Bắc", "Tây Nam", "Tây Bắc"]
LEGAL_OPTIONS = ["Sổ đỏ", "Sổ hồng", "Giấy tờ hợp lệ", "Đang chờ sổ", "Không"]
INTERIOR_OPTIONS = ["Đầy đủ", "Cơ bản", "Cao cấp", "Không nội thất"]
LEGAL_DEFAULT = "Không"
INTERIOR_DEFAULT = "Không nội thất"
NO_INFO = "Không có thông tin"
DEFAULT_POSTER = "admin"
HANOI_DISTRICTS = [
    "Ba Đình", "Cầu Giấy", "Hoàn Kiếm", "Hai Bà Trưng", "Hoàng Mai", "Đống Đa",
    "Hà Đông", "Tây Hồ", "Long Biên", "Nam Từ Liêm", "Thanh Xuân", "Đông Anh",
    "Sóc Sơn", "Gia Lâm", "Thanh Trì", "Mê Linh", "Sơn Tây", "Bắc Từ Liêm",
    "Chương Mỹ", "Ba Vì", "Đan Phượng", "Hoài Đức", "Quốc Oai", "Thạch Thất",
    "Phúc Thọ", "Thanh Oai", "Ứng Hòa", "Thường Tín", "Phú Xuyên", "Mỹ Đức",
]
UNIT_BILLION = "tỷ"
UNIT_MILLION_PER_M2 = "triệu/m²"
UNIT_PER_MONTH = "/tháng"
UNIT_M2 = "m²"
UNIT_ROOM = "phòng"
UNIT_FLOOR = "tầng"
# Sort sentinels for non-numeric prices: cheapest-first puts them last,
# dearest-first puts them last too (as 0).
PRICE_SORT_HIGH_SENTINEL = 999999999999
PRICE_SORT_LOW_SENTINEL = 0
# Numeric guard used before casting free text.
NUMERIC_TEXT = r"^[0-9]+(\.[0-9]+)?$"
# "digits with at most one dot" (the cleaning rule's test).
LOOSE_NUMBER = r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"
INTEGER_TEXT = r"^[0-9]+$"
USER_ID_PATTERN = r"^[a-zA-Z0-9_]{3,20}$"
PHONE_PATTERN = r"^[0-9]{10,11}$"
# --- end of fixed values ---

RAW_COLUMNS = [
    "Title", "Address", "District", "PostingDate", "PostType", "Price", "Area",
    "Direction", "Bedrooms", "Bathrooms", "Floors", "Width_meters", "Legal",
    "Interior", "Entrancewidth",
]

RAW_SCHEMA = T.StructType(
    [T.StructField("row_ordinal", T.LongType(), True)]
    + [T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS]
)

LISTING_SCHEMA = T.StructType([
    T.StructField("house_id", T.StringType(), False),
    T.StructField("title", T.StringType(), True),
    T.StructField("address", T.StringType(), True),
    T.StructField("district", T.StringType(), True),
    T.StructField("posting_date", T.StringType(), True),
    T.StructField("post_type", T.StringType(), True),
    T.StructField("price_raw", T.StringType(), True),
    T.StructField("price_vnd", T.DecimalType(20, 2), True),
    T.StructField("area", T.DoubleType(), True),
    T.StructField("direction", T.StringType(), True),
    T.StructField("bedrooms", T.IntegerType(), True),
    T.StructField("bathrooms", T.IntegerType(), True),
    T.StructField("floors", T.IntegerType(), True),
    T.StructField("width_meters", T.DoubleType(), True),
    T.StructField("legal", T.StringType(), True),
    T.StructField("interior", T.StringType(), True),
    T.StructField("entrancewidth", T.DoubleType(), True),
])
LISTING_COLUMNS = [f.name for f in LISTING_SCHEMA.fields]

# The 7-column typed projection shown in lists.
PROPERTY_COLUMNS = ["house_id", "title", "district", "price_raw", "price_vnd", "area",
                    "bedrooms", "bathrooms"]

STATUS_SCHEMA = T.StructType([
    T.StructField("house_id", T.StringType(), False),
    T.StructField("statue", T.StringType(), True),
    T.StructField("poster_id", T.StringType(), True),
])

USER_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("username", T.StringType(), True),
    T.StructField("phone", T.LongType(), True),
])

PAIR_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("house_id", T.StringType(), False),
])
