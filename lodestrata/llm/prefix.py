"""Global ranks and prefix sums without a global window, from the totals of sorted range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import Workspace, shuffle_partitions


def with_prefix(spark: SparkSession, ws: Workspace, rows: DataFrame, order: list, sums: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0) and, for each column of ``sums``, ``before_<column>``: the sum over all earlier rows.

    Rows are dealt out by ranges of ``order`` and sorted; each partition's totals
    (one row per partition, as many as shuffle partitions) are accumulated alone and
    added to the running sums inside the partition. ``order`` should be unique: ties
    fall in any order, but in one order, as the sorted rows are written first.
    """
    n = shuffle_partitions(spark)
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = ws.table(ranged, "ranged")
    part, at = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    ranged = ranged.withColumn("__part", part).withColumn("__at", at)
    totals = ranged.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__sum_{c}") for c in sums])
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), *[F.coalesce(F.sum(f"__sum_{c}").over(before), F.lit(0)).alias(f"__off_{c}") for c in sums])
    inside = W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__in_{c}") for c in sums]).join(F.broadcast(offsets), "__part")
    names = rows.columns
    return out.select(*names, (F.col("__n0") + F.col("__at")).alias("rank"), *[(F.col(f"__off_{c}") + F.col(f"__in_{c}")).alias(f"before_{c}") for c in sums])
