"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key u ** (1 / w): u uniform in (0, 1) from an md5 of its
id and text, w its quality weight (equivalently the exponential key -ln(u) / w,
ascending). Within a source the documents with the highest keys are a weighted
sample without replacement. A source's target first takes as many complete
epochs of the source as fit; the rest is filled with the documents of highest
key until the budget is reached, where the document at the border is taken if
its middle lies within the budget.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share the words of all documents; a target stops at 3 times its source's size,
and the excess is shared again by weight until none is above.

Defined cases: a null text has size 0; a source of size 0 has target 0 and
nothing of it is taken. Rows equal in id and text have equal keys and count one
by one. The draw depends on the rows alone, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abode.llm.common import Scratch, words
from abode.operators.ids import with_sequence


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[int, ...] = (5, 2, 1)
    most_epochs: int = 3
    bucket_rows: int = 20_000


def quality_weight(text: Column) -> Column:
    """Between 0.25 and 1: the share of letters and digits among the characters that are no white space."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")
    plain = F.length(F.regexp_replace(body, r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", ""))
    return F.when(F.length(body) > 0, 0.25 + 0.75 * plain / F.length(body)).otherwise(F.lit(0.25))


def sampling_key(doc_id: Column, text: Column, weight: Column) -> Column:
    """u ** (1 / w), u from the first 52 bits of an md5 of id and text."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"),
                            F.md5(F.coalesce(text, F.lit("")))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(16 ** 13)
    return F.exp(F.log(u) / weight)


def source_targets(sources: DataFrame, settings: MixSettings) -> DataFrame:
    """``source, source_size`` with each source's target in words.

    Every round shares what is left over all sources below their ceiling; the
    ceilings that are passed are fixed and the next round starts. A round is
    one aggregate over the sources, and at most two numbers reach the driver.
    """
    ceiling = F.col("source_size") * settings.most_epochs
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).collect()[0]["n"]
    level = None
    while True:
        # at the ceiling: what the last level would give is above it
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) > ceiling
        left = sources.agg(
            F.coalesce(F.sum(F.when(full, ceiling)), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weights")).collect()[0]
        if not left["weights"]:
            break
        now = (total - left["fixed"]) / left["weights"]
        if now == level:
            break
        level = now
    share = F.col("weight") * F.lit(level if level is not None else 0.0)
    return sources.withColumn("target", F.least(share, ceiling.cast("double")))


def mix(df: DataFrame, settings: MixSettings = MixSettings(), text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, row key, size, source_size, target, copies (epochs the mix takes) and taken words.

    One row per row of ``df``, which needs doc_id and the two named columns.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    weight = quality_weight(F.col(text))
    rows = df.select(
        "doc_id", F.xxhash64("doc_id", text).alias("row_key"), F.col(source).alias("source"),
        F.size(words(F.col(text))).cast("long").alias("size"),
        sampling_key(F.col("doc_id"), F.col(text), weight).alias("key"))
    rows = scratch.write(rows, "rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    ordered = with_sequence(sizes.withColumn("no_source", F.col("source").isNull()), ["no_source", "source"], 0)
    cycle = F.array(*[F.lit(w) for w in settings.weights])
    ordered = ordered.withColumn("weight", cycle[(F.col("seq") % len(settings.weights)).cast("int")])
    sources = scratch.write(ordered.select("source", "source_size", "source_rows", "weight"), "sources")
    targets = source_targets(sources, settings)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", epochs.cast("int")) \
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")) \
        .withColumn("n_buckets", F.ceil(F.col("source_rows") / settings.bucket_rows).cast("int"))
    targets = scratch.write(targets.withColumnRenamed("source", "of_source"), "targets")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    # descending keys: bucket 0 holds the highest; no task holds a source
    last = F.col("n_buckets") - 1
    rows = rows.withColumn("bucket", F.least(last, F.floor((1 - F.col("key")) * F.col("n_buckets")).cast("int")))
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(F.col("source").alias("of_source"), F.col("bucket").alias("of_bucket"),
                               F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("before"))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket")))
    within = Window.partitionBy("source", "bucket").orderBy(F.desc("key"), "doc_id", "row_key") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.col("before") + F.sum("size").over(within)
    extra = F.when(reached - F.col("size") / 2 <= F.col("budget"), 1).otherwise(0)
    copies = F.least(F.lit(settings.most_epochs), F.col("epochs") + extra)
    copies = F.when(F.col("size") > 0, copies).otherwise(0)
    return rows.withColumn("copies", copies.cast("int")).select(
        "doc_id", "row_key", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it.

    Of rows equal in id, text and source that straddle the budget's border, so
    many come once more as the mix takes; which of them makes no difference to
    the text. Columns of any name pass through.
    """
    scratch = Scratch(df.sparkSession, "mixed")
    plan = mix(df, settings).groupBy(F.col("doc_id").alias("of_id"), F.col("row_key").alias("of_key"), F.col("source").alias("of_source")) \
        .agg(F.min("copies").alias("copies"), (F.sum("copies") - F.count(F.lit(1)) * F.min("copies")).alias("more")) \
        .filter("copies > 0 or more > 0")
    plan = scratch.write(plan, "plan")
    own = [F.col(c).alias(f"own_{i}") for i, c in enumerate(df.columns)]
    rows = df.select(*own, F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("key"), F.col("source").alias("of"))
    rows = rows.join(plan, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key"))
                     & F.col("of").eqNullSafe(F.col("of_source"))).drop("of_id", "of_key", "of_source")
    names = [F.col(f"own_{i}").alias(c) for i, c in enumerate(df.columns)]

    def repeated(taken: DataFrame) -> DataFrame:
        return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*names)
    out = repeated(rows.filter("more = 0"))
    if not plan.filter("more > 0").limit(1).count():
        return out
    # about one text per source; numbered by their place in a written table, so that many equal rows are not one task
    border = scratch.write(rows.filter("more > 0").withColumn("place", F.monotonically_increasing_id()), "border")
    border = scratch.write(with_sequence(border, ["key", "of", "place"], 0, "number"), "numbered")
    first = border.groupBy("id", "key", "of").agg(F.min("number").alias("first")) \
        .select(F.col("id").alias("f_id"), F.col("key").alias("f_key"), F.col("of").alias("f_of"), "first")
    border = border.join(first, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key")) & F.col("of").eqNullSafe(F.col("f_of")))
    extra = F.when(F.col("number") - F.col("first") < F.col("more"), 1).otherwise(0)
    return out.unionByName(repeated(border.withColumn("copies", F.col("copies") + extra).filter("copies > 0")))
