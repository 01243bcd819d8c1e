"""Sharding by rendezvous hashing over weighted shards. DataFrame functions only.

Each record goes to the shard with the highest score of (record key, shard):
``-weight / ln(u)`` with u uniform in (0, 1) from an md5 of both. Key and
shards alone decide, whatever other records there are. A further shard
changes no other shard's score, so it only takes records into itself.

Defined cases: a null key counts as the text 'null' and equal keys share a
shard; ties between shards go to the lower number; a shard of weight 0 gets
nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one counting bucket within a shard.
BUCKET_ROWS = 50_000
_HEX_DIGITS = 13


def shard_score(key: Column, shard: int, weight: float) -> Column:
    """Rendezvous score of a record for one shard."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")))
    bits = F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("double")
    u = (bits + 0.5) / float(16 ** _HEX_DIGITS)
    return -F.lit(float(weight)) / F.log(u)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a record key: the highest score over all shards of weight above 0."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [F.struct(shard_score(text, s, w).alias("score"), F.lit(-s).alias("s"))
              for s, w in enumerate(weights) if w > 0]
    return (-F.array_max(F.array(*scores))["s"]).cast("int")


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], name: str = "shard") -> DataFrame:
    """``df`` with the shard number of each row (a column of that name is replaced)."""
    return df.withColumn(name, shard_of(F.col(key), weights))


def with_slots(df: DataFrame, order: Sequence[str], shard: str = "shard", name: str = "slot") -> DataFrame:
    """Gapless positions from 0 within each shard, by an md5 of the order columns, then by the columns.

    A shard may hold any share of the rows, so none is numbered in one task:
    the md5's range is cut into buckets, rows are numbered within (shard,
    bucket), and the buckets' counts, one row each, give the offsets. The cut
    changes no position.
    """
    n_buckets = max(1, -(-df.count() // BUCKET_ROWS))
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order])
    place = F.conv(F.substring(F.md5(text), 1, _HEX_DIGITS), 16, 10).cast("long")
    width = -(-(16 ** _HEX_DIGITS) // n_buckets)
    rows = df.withColumn("_place", place).withColumn("_bucket", F.floor(F.col("_place") / F.lit(width)).cast("int"))
    sizes = rows.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(shard, "_bucket").orderBy("_place", *order)
    numbered = rows.withColumn("_row", F.row_number().over(within) - 1)
    return numbered.join(offsets, [shard, "_bucket"]) \
        .withColumn(name, (F.col("_offset") + F.col("_row")).cast("long")) \
        .drop("_place", "_bucket", "_offset", "_row")


def write_shards(df: DataFrame, path: str, shard: str = "shard", files_per_shard: int = 8) -> None:
    """One folder per shard; each shard is spread over several files by a hash of the row."""
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != shard]), F.lit(files_per_shard))
    df.repartition(F.col(shard), salt).write.mode("overwrite").partitionBy(shard).parquet(path)
