"""A global rank without moving all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators.lineage import cut


def with_rank(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank`` from 0 in the order of the columns.

    The rows are written first, as finding the cut points reads them once more. Range buckets, as many as shuffle partitions, are cut at sampled quantiles; counts of
    the buckets, one row each, give the offsets, and rows are numbered inside a bucket.
    The result does not depend on where the cuts fall.
    """
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(cut(rows).repartitionByRange(buckets, *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__r", inside).join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__before") + F.col("__r") - 1).drop("__part", "__r", "__before")


def with_running(rows: DataFrame, per: str, order: list[str], amount: str) -> DataFrame:
    """Adds ``before``, the sum of ``amount`` over the rows of the same ``per`` that come earlier.

    As with ranks, rows go to range buckets, and the sums of earlier buckets, one row for
    each bucket and ``per``, are added to those inside a bucket, so a frequent ``per`` is
    spread over many tasks. ``per`` is never null, and the order is total.
    """
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(cut(rows).repartitionByRange(buckets, per, *order).withColumn("__part", F.spark_partition_id()))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("__part", per).agg(F.sum(amount).alias("__sum"))
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(earlier(W.partitionBy(per).orderBy("__part"))), F.lit(0))).drop("__sum")
    inside = F.coalesce(F.sum(amount).over(earlier(W.partitionBy("__part", per).orderBy(*order))), F.lit(0))
    return ranged.withColumn("__in", inside).join(sums, ["__part", per]).withColumn("before", F.col("__base") + F.col("__in")).drop("__part", "__base", "__in")
