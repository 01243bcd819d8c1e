"""Golden rows for every raw text form the cleaning rules handle."""
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from abode.functions import price as P
from abode.functions.text import truncate
from abode.operators.clean import clean_listings, trim_columns
from abode.schema import RAW_COLUMNS, RAW_SCHEMA


def raw_row(ordinal, price, area="50 m²", bed="3 phòng", bath="2 phòng", floors="2 tầng",
            width="4,5 m", legal="Sổ đỏ", interior="Đầy đủ", entrance="3,5 m"):
    vals = dict(zip(RAW_COLUMNS, [f"Title {ordinal}", "Addr", "Ba Đình", "2024-01-02", "Bán", price,
                                  area, "Đông", bed, bath, floors, width, legal, interior, entrance]))
    return (ordinal, *[vals[c] for c in RAW_COLUMNS])


@pytest.fixture(scope="module")
def cleaned(spark):
    rows = [
        raw_row(0, "5,5 tỷ"),
        raw_row(1, '"5,5 tỷ"'),
        raw_row(2, "95,5 triệu/m²", area="52,5 m²"),
        raw_row(3, "120", area="50"),
        raw_row(4, "12 triệu/tháng"),
        raw_row(5, "Thỏa thuận"),
        raw_row(6, "Thoả thuận"),
        raw_row(7, "500 triệu"),
        raw_row(8, "5 tỷ/m²"),
        raw_row(9, "1.234,5 tỷ"),
        raw_row(10, None),
        raw_row(11, "95,5 triệu/m²", area="KXĐ"),
        raw_row(12, "2 tỷ", bed="0 phòng", bath="0 phòng", floors="0 tầng", legal="0",
                interior="0", entrance="0"),
        raw_row(13, "2 tỷ", bed="ba phòng", width="rộng"),
    ]
    df = spark.createDataFrame(rows, RAW_SCHEMA)
    return {r["house_id"]: r for r in clean_listings(df).collect()}


def test_price_forms(cleaned):
    assert cleaned["00001"]["price_vnd"] == Decimal("5500000000.00")
    assert cleaned["00002"]["price_vnd"] == Decimal("5500000000.00")          # quotes dropped
    assert cleaned["00003"]["price_vnd"] == Decimal("5013750000.00")          # 95.5e6 * 52.5
    assert cleaned["00004"]["price_vnd"] == Decimal("6000000000.00")          # bare digits = million/m2
    assert "00005" not in cleaned                                             # monthly rent dropped
    assert cleaned["00006"]["price_vnd"] is None and cleaned["00006"]["price_raw"] == "Thỏa thuận"
    assert cleaned["00007"]["price_vnd"] is None
    assert cleaned["00008"]["price_vnd"] is None and cleaned["00008"]["price_raw"] == "500 triệu"
    assert cleaned["00009"]["price_vnd"] is None                              # bad 'tỷ' text -> null
    assert cleaned["00010"]["price_vnd"] is None
    assert cleaned["00011"]["price_vnd"] is None and cleaned["00011"]["price_raw"] is None  # null kept
    assert cleaned["00012"]["price_vnd"] is None and cleaned["00012"]["area"] is None      # null area


def test_measures_and_defaults(cleaned):
    r = cleaned["00001"]
    assert (r["area"], r["bedrooms"], r["bathrooms"], r["floors"]) == (50.0, 3, 2, 2)
    assert (r["width_meters"], r["entrancewidth"]) == (4.5, 3.5)
    assert cleaned["00003"]["area"] == 52.5
    z = cleaned["00013"]
    assert (z["bedrooms"], z["bathrooms"], z["floors"]) == (1, 1, 1)         # zero means one
    assert (z["legal"], z["interior"], z["entrancewidth"]) == ("Không", "Không nội thất", None)
    bad = cleaned["00014"]
    assert bad["bedrooms"] is None and bad["width_meters"] is None            # unreadable -> null


def test_ids_keep_gaps_and_come_first(spark, cleaned):
    assert sorted(cleaned)[:4] == ["00001", "00002", "00003", "00004"]
    assert "00005" not in cleaned and "00006" in cleaned
    df = clean_listings(spark.createDataFrame([raw_row(123456, "1 tỷ")], RAW_SCHEMA))
    assert df.columns[0] == "house_id"
    assert df.first()["house_id"] == "123457"                                 # wide ids keep all digits


def test_trim_columns(spark):
    df = spark.createDataFrame([(1, 2)], "` a ` int, `b  ` int")
    assert trim_columns(df).columns == ["a", "b"]


def test_price_formats(spark):
    df = spark.createDataFrame(
        [(Decimal("125000000.00"), "x"), (Decimal("1005000000.00"), "x"), (None, "Thỏa thuận"),
         (Decimal("1234567000000.00"), "x")],
        "v decimal(20,2), raw string")
    got = df.select(P.fmt_price_ty("v", "raw").alias("a"), P.fmt_price_plain("v", "raw").alias("b"),
                    P.fmt_price_long(F.col("v")).alias("c")).collect()
    assert [r["a"] for r in got] == ["0.13 tỷ", "1.01 tỷ", "Thỏa thuận", "1234.57 tỷ"]  # half-up
    assert [r["b"] for r in got] == ["0.13", "1.01", "Thỏa thuận", "1234.57"]
    assert got[3]["c"] == "1,234.57 tỷ VND"


def test_price_input_and_truncate(spark):
    df = spark.createDataFrame([("1,200,000",), ("Thỏa thuận",), ("1.200.000",)], "p string")
    assert [r[0] for r in df.select(P.price_input_normalise(F.col("p"))).collect()] == \
        ["1200000", "Thỏa thuận", "1.200.000"]
    assert [r[0] for r in df.select(P.price_input_normalise(F.col("p"), vi_grouping=True)).collect()] == \
        ["1200000", "Thỏa thuận", "1200000"]
    t = spark.createDataFrame([("a" * 31,), ("short",)], "t string")
    assert [r[0] for r in t.select(truncate("t", 30)).collect()] == ["a" * 30 + "...", "short"]


def test_numeric_guard(spark):
    df = spark.createDataFrame([("12.5",), ("5.5E+9",), ("abc",), ("7",)], "t string")
    got = [r[0] for r in df.select(P.numeric_guard(F.col("t"))).collect()]
    assert got == [Decimal("12.50"), None, None, Decimal("7.00")]


def test_strict_text_reproduces_text_prices(spark):
    rows = [raw_row(0, "5,5 tỷ"), raw_row(1, "95,5 triệu/m²", area="52,5 m²")]
    df = spark.createDataFrame(rows, RAW_SCHEMA)
    strict = {r["house_id"]: r["price_vnd"] for r in clean_listings(df, strict_text=True).collect()}
    loose = {r["house_id"]: r["price_vnd"] for r in clean_listings(df).collect()}
    assert strict["00001"] is None and loose["00001"] == Decimal("5500000000.00")
    assert strict["00002"] == loose["00002"] == Decimal("5013750000.00")


def test_dq_raw_prices_reports_unreadable_text(spark):
    from abode.functions.quality import dq_raw_prices

    prices = ["5 tỷ/m²", "1.234,5 tỷ", "Thỏa thuận", "500 triệu", "12 triệu/tháng", "2 tỷ", None]
    df = spark.createDataFrame([raw_row(i, p) for i, p in enumerate(prices)], RAW_SCHEMA)
    assert [r["Price"] for r in dq_raw_prices(df).orderBy("row_ordinal").collect()] == \
        ["5 tỷ/m²", "1.234,5 tỷ", "500 triệu"]


def test_prices_keep_every_digit(spark):
    rows = [raw_row(0, "1,23456 tỷ"), raw_row(1, "45,123456 triệu/m²", area="50 m²"), raw_row(2, "120", area="33,33333 m²"),
            raw_row(3, "5500000000", area="50 m²"), raw_row(4, "100000000 tỷ"), raw_row(5, "99999999 triệu/m²", area="99999999 m²"),
            raw_row(6, "123456789012345678901234567890 tỷ"), raw_row(7, "0,00000000012 tỷ")]
    df = spark.createDataFrame(rows, RAW_SCHEMA)
    got = [r["price_vnd"] for r in clean_listings(df).orderBy("house_id").collect()]
    assert got == [Decimal("1234560000"), Decimal("2256172800"), Decimal("3999999600"), Decimal("275000000000000000"),
                   Decimal("100000000000000000"), None, None, Decimal("0.10")]
    from abode.functions.quality import dq_raw_prices
    reasons = {r["row_ordinal"]: r["reason"] for r in dq_raw_prices(df).collect()}
    assert reasons == {5: "price_out_of_range", 6: "price_out_of_range"}


def test_plain_number(spark):
    df = spark.createDataFrame([("1234,5",), ("7.",), ("1.2.3",), ("abc",), (None,)], "p string")
    assert [r[0] for r in df.select(P.plain_number("p").cast("double")).collect()] == [1234.5, 7.0, None, None, None]
