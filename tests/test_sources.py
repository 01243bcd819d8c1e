"""Source reads: pruned scans with pushed filters, and real listing files."""
import csv
import random

import pytest
from pyspark.sql import functions as F

from abode.schema import RAW_COLUMNS
from abode.sources.files import read_listings_csv
from abode.sources.split_csv import _lines, read_records, read_split_csv
from abode.sources.tpch_binding import read_table
from tests.conftest import SF_SMALL


def test_filters_reach_the_scan(spark):
    df = read_table(spark, SF_SMALL, "orders", ["o_orderkey"]).filter(F.col("o_orderkey") > 10)
    assert not df.storageLevel.useMemory
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,10)]" in plan


def test_real_listing_file(spark, tmp_path):
    """The 15 headers with blanks, shuffled, among another one; quotes and a line break in a title."""
    headers = list(reversed(RAW_COLUMNS)) + ["Note"]
    rows = [{c: f"{c}{i}" for c in headers} for i in range(5)]
    rows[2]["Title"] = 'two\nlines, "quoted"'
    with open(tmp_path / "listings.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow([f" {h} " for h in headers])
        out.writerows([[r[h] for h in headers] for r in rows])
    got = read_listings_csv(spark, str(tmp_path / "listings.csv")).orderBy("row_ordinal").collect()
    assert [r["row_ordinal"] for r in got] == [0, 1, 2, 3, 4]
    assert got[2]["Title"] == 'two\nlines, "quoted"'
    assert all(r[c] == rows[i][c] for i, r in enumerate(got) for c in RAW_COLUMNS)


def test_missing_column_is_null_and_files_follow_each_other(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"part-{n}.csv").write_text("Title,Price\n" + "".join(f"t{n}{i},1\n" for i in range(4)), encoding="utf-8")
    got = read_listings_csv(spark, str(tmp_path)).orderBy("row_ordinal").collect()
    assert [r["Title"] for r in got] == [f"t{n}{i}" for n in range(3) for i in range(4)]
    assert all(r["Area"] is None for r in got)


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "211")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_csv_equals_one_reader(spark, tmp_path, small_ranges, end):
    """Many byte ranges a file, borders inside quotes, records longer than a range; against Python's csv."""
    rng = random.Random(len(end))
    word = lambda: rng.choice(["a", 'say ""', ',', "\n", "\r\n", "nhà", " ", '"', "\n\n", "x" * 20])
    want = []
    for n, head in enumerate([["Title", " Price ", "Note"], ["Note", "Title", "Price"]]):
        rows = [["".join(word() for _ in range(rng.randrange(1, 9))) + "." for _ in head] for _ in range(60)]
        rows[7][1] = "line\n" * 200 + "end"
        rows[20][0] = '"' * 500 + "\n"
        with open(tmp_path / f"{n}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f, lineterminator=end).writerows([head, *rows[:30]])
            f.write(end + end)
            csv.writer(f, lineterminator=end).writerows(rows[30:])
        names = [h.strip() for h in head]
        want += [(r[names.index("Title")], r[names.index("Price")], None) for r in rows]
    assert _lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 40
    got = read_split_csv(spark, str(tmp_path), ["Title", "Price", "Area"]).orderBy("file", "block", "line").collect()
    assert [(r["Title"], r["Price"], r["Area"]) for r in got] == want
    numbered = read_listings_csv(spark, str(tmp_path)).orderBy("row_ordinal").collect()
    assert [(r["row_ordinal"], r["Title"]) for r in numbered] == [(i, w[0]) for i, w in enumerate(want)]


def test_split_csv_edges(spark, tmp_path, small_ranges):
    (tmp_path / "bom.csv").write_bytes("\ufeffTitle,Price\nt,\n\"\",2\nshort\nlast,3".encode())
    got = read_split_csv(spark, str(tmp_path / "bom.csv"), ["Title", "Price"]).orderBy("block", "line").collect()
    assert [(r["Title"] or "", r["Price"]) for r in got] == [("t", None), ("", "2"), ("short", None), ("last", "3")]
    (tmp_path / "header.csv").write_text("Title,Price\n")
    (tmp_path / "empty.csv").write_text("")
    assert read_split_csv(spark, str(tmp_path / "header.csv"), ["Title"]).count() == 0
    assert read_split_csv(spark, str(tmp_path / "empty.csv"), ["Title"]).count() == 0
    (tmp_path / "open.csv").write_text('Title\n"never closed\n' + "more\n" * 200)
    with pytest.raises(ValueError, match="open.csv"):
        read_records(spark, str(tmp_path / "open.csv"))


def test_district_collation(spark):
    from abode.operators.catalog import distinct_districts

    df = spark.createDataFrame([(d,) for d in ["Đống Đa", "Ba Đình", "an", "Cầu Giấy"]], "district string")
    assert [r[0] for r in distinct_districts(df).collect()] == ["Ba Đình", "Cầu Giấy", "an", "Đống Đa"]
    assert [r[0] for r in distinct_districts(df, "vi").collect()] == ["an", "Ba Đình", "Cầu Giấy", "Đống Đa"]
