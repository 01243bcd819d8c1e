"""Quoted CSV with line breaks in fields, read by many tasks.

A reader of quoted CSV must know whether a place lies inside quotes, which depends
on all that stands before it. Here the scan cuts files into byte ranges and lines
wherever it likes, and the state is found afterwards:

1. the number of quotes in each range, modulo 2 (one row per range);
2. the state at each range's start: the running sum of the parities before it;
3. within a range, the running sum of its lines' quotes. A line that starts
   outside quotes starts a record;
4. a record of one line is complete as it stands. Only the lines of longer ones
   are gathered, by the place of the line that starts them, across ranges too.

The files follow RFC 4180: a field with quotes, commas or line breaks is quoted,
quotes in it are doubled, and lines end with LF or CRLF. So a file has an even
number of quotes; an odd number is an error that names the file, since its last
record would reach to the end of the file. Empty lines between records are no records.

Both scans of the files use the same ranges, as they are parts of one session with
the same settings; a file that is compressed as a whole is one range.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abode.session import scratch_path

#: Distinct headers among the files of a folder; each makes the parse expression longer.
MOST_LAYOUTS = 50
_RANGE = ["file", "block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per LF-ended line: file, start of its byte range, place (ascending within the range), text, quotes."""
    text = F.col("value")
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value", (F.length(text) - F.length(F.replace(text, F.lit('"')))).alias("quotes"))


def range_states(lines: DataFrame) -> DataFrame:
    """Per byte range: ``parity`` of its quotes, and ``inside``, 1 if it starts inside quotes."""
    ranges = lines.groupBy(*_RANGE).agg((F.sum("quotes") % 2).alias("parity"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select(*_RANGE, "parity", (F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2).alias("inside"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files at ``path``: file, block and line of their first line, and their whole text."""
    base = scratch_path(spark, "split-csv")
    lines = _lines(spark, path)
    range_states(lines).write.parquet(f"{base}/ranges")
    ranges = spark.read.parquet(f"{base}/ranges")
    broken = ranges.groupBy("file").agg((F.sum("parity") % 2).alias("odd")).filter("odd = 1").limit(1).collect()
    if broken:
        raise ValueError(f"a quoted field is not closed in {broken[0]['file']}")

    # a range holds no more than the scan gives one task, so its window is bounded as well
    order = Window.partitionBy(*_RANGE).orderBy("line")
    earlier, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    state = (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) + F.col("inside")) % 2
    marked = lines.join(ranges.select(*_RANGE, "inside"), _RANGE).withColumn("starts", state == 0)
    marked = marked.withColumn("first", F.max(F.when(F.col("starts"), F.col("line"))).over(so_far))
    marked.select(*_RANGE, "line", "value", "starts", "first", (F.col("quotes") % 2 == 1).alias("odd")) \
        .write.parquet(f"{base}/lines")
    marked = spark.read.parquet(f"{base}/lines")

    whole = marked.filter("starts and not odd").select(*_RANGE, "line", "value")
    # lines before a range's first record continue the last one that started in an earlier range
    place = F.struct("block", F.col("first").alias("line"))
    starts = marked.groupBy(*_RANGE).agg(F.max(F.when(F.col("starts"), F.struct("block", "line"))).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = starts.select(*_RANGE, F.last("last", ignorenulls=True).over(before).alias("carried"))
    parts = marked.filter("odd or not starts").join(carried, _RANGE)
    parts = parts.select("file", F.when(F.col("first").isNotNull(), place).otherwise(F.col("carried")).alias("at"),
                         F.struct("block", "line", "value").alias("part"))
    joined = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("part")), lambda p: p["value"]))
    long = parts.groupBy("file", "at").agg(joined.alias("value")).select("file", "at.block", "at.line", "value")
    records = whole.unionByName(long).withColumn("value", F.regexp_replace("value", "\r\\z", ""))
    return records.filter("value <> ''")


def _fields(header: str) -> list[str]:
    return [c.strip() for c in next(csv.reader([header.removeprefix("\ufeff")], strict=False))]


def read_split_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``columns`` by header name, as text, of headered files; with file, block and line, the record's place.

    Each file's first record is its header. Names are trimmed and may stand in
    any order, among others that are ignored, and differ from file to file; a
    column that a file lacks is null there. Fields missing at a record's end are null.
    """
    base = scratch_path(spark, "split-csv-records")
    read_records(spark, path).write.parquet(f"{base}/records")
    records = spark.read.parquet(f"{base}/records")
    heads = records.groupBy("file").agg(F.min(F.struct("block", "line", "value")).alias("head"))
    layouts = [r[0] for r in heads.select("head.value").distinct().limit(MOST_LAYOUTS + 1).collect()]
    if len(layouts) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} different headers at {path}")
    names = {h: _fields(h) for h in layouts}
    width = max([1, *[len(n) for n in names.values()]])
    fields = F.from_csv("value", ", ".join(f"_{i} string" for i in range(width)), {"quote": '"', "escape": '"', "multiLine": "true"})
    rows = records.join(heads, "file").filter(F.struct("block", "line") > F.struct("head.block", "head.line"))
    rows = rows.select(*_RANGE, "line", F.col("head.value").alias("header"), fields.alias("fields"))

    def column(name: str) -> Column:
        out = F.lit(None).cast("string")
        for h, found in names.items():
            if name in found:
                out = F.when(F.col("header") == h, F.col("fields")[f"_{found.index(name)}"]).otherwise(out)
        return out.alias(name)
    return rows.select(*_RANGE, "line", *[column(c) for c in columns])
