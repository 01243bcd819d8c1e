"""Sequential ids at scale (no single-partition global window).

New ids must continue an existing maximum in a given request order. A global
``row_number()`` over an unpartitioned window would pull every row into one
task; instead the rows are range-partitioned on the order key, sorted within
partitions and materialised once (reliable checkpoint, so a lost executor
recomputes nothing inconsistent); then only the per-partition row counts
(one number per partition) come back to the driver, and each row's index is
its partition's offset plus its position within the partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.session import checkpoint_dir

_PID_SHIFT = 1 << 33  # monotonically_increasing_id = (partition << 33) + position


def with_sequence(df: DataFrame, order_cols: list[str], start: int = 1, name: str = "seq",
                  num_partitions: int | None = None) -> DataFrame:
    """Append ``name`` = start, start+1, ... following ``order_cols`` (ascending).

    ``order_cols`` must identify rows uniquely for a deterministic numbering.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    ranged = ranged.withColumn("_pid", F.spark_partition_id()) \
        .withColumn("_pos", F.monotonically_increasing_id()).checkpoint(eager=True)
    ranged = ranged.withColumn("_pos", F.col("_pos") - F.col("_pid").cast("bigint") * F.lit(_PID_SHIFT))
    counts = sorted(ranged.groupBy("_pid").count().collect())  # one row per partition
    offsets, acc = [], start
    for row in counts:
        offsets.append((int(row["_pid"]), acc))
        acc += int(row["count"])
    if not offsets:
        return ranged.drop("_pid", "_pos").withColumn(name, F.lit(None).cast("bigint"))
    off_df = spark.createDataFrame(offsets, "_pid int, _off long")
    # The offsets table has one row per partition: a proven, data-independent bound.
    return ranged.join(F.broadcast(off_df), "_pid") \
        .withColumn(name, F.col("_off") + F.col("_pos")).drop("_pid", "_pos", "_off")


def max_numeric_id(df: DataFrame, col: str = "house_id", prefix: str = "") -> int:
    """Largest numeric id (numeric, not text order); 0 when there is none.

    Digits beyond 64 bits are no id of this table and do not count.
    """
    body = F.substring(F.col(col), len(prefix) + 1, 1 << 20) if prefix else F.col(col)
    cond = body.rlike(r"^[0-9]+$")
    if prefix:
        cond = cond & F.col(col).startswith(prefix)
    row = df.filter(cond).agg(F.max(body.try_cast("bigint")).alias("m")).collect()[0]
    return int(row["m"] or 0)
