"""Contiguous shards of balanced bytes, cut from global prefix sums. Native DataFrame operators only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import Workspace, read
from lodestrata.llm.prefix import with_prefix


def _move_cuts(targets: list[int], groups: list, slack: float) -> list[int]:
    """Moves a cut that falls into a group to the group's nearer end, unless that is more than ``slack`` bytes away."""
    cuts = []
    for target in targets:
        ends = [e for g in groups if g.lo < target < g.hi for e in (g.lo, g.hi)]
        near = min(ends, key=lambda e: (abs(e - target), e), default=target)
        cuts.append(near if abs(near - target) <= slack else target)
    return cuts


def shards_by_bytes(spark: SparkSession, docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.02) -> DataFrame:
    """Cuts the rows, in one global order, at equal byte targets.

    The order is (md5 of the text, id), so equal texts stand together. A row's
    size is its UTF-8 bytes plus 1; a null text has none, and a checksum of 0. A row
    belongs to the shard in which its middle byte lies. A cut inside a run of equal texts moves
    to the nearer end of the run if that is at most ``tolerance`` of a shard away;
    larger runs are cut, since balance comes first. Repeated rows are all placed;
    rows that tie in text and id are alike in all that is returned, so their order makes
    no difference. An empty table gives no rows. Other columns are not read.

    Returns id, size, text_crc32, shard, slot.
    """
    ws = Workspace(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("h"))
    placed = ws.table(with_prefix(spark, ws, ws.table(slim, "slim"), ["h", "text_crc32", "id"], ["size"]), "placed")
    total = placed.agg(F.sum("size")).first()[0] or 0
    targets = [total * k // shards for k in range(1, shards)]
    lo, hi = F.col("before_size"), F.col("before_size") + F.col("size")
    # the runs that stand at the targets: shards - 1 at most
    at = placed.where(F.exists(F.array(*[F.lit(x).cast("long") for x in targets] or [F.lit(-1).cast("long")]), lambda x: (x >= lo) & (x < hi))).select("h", "text_crc32")
    runs = placed.join(F.broadcast(at.distinct()), ["h", "text_crc32"]).groupBy("h", "text_crc32").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi")).collect()
    cuts = _move_cuts(targets, runs, tolerance * total / shards)
    shard = sum((F.when(lo + hi >= 2 * c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = placed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select("id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards_by_bytes(spark, read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Checksums byte by byte, then the order's running sums, the cuts and the ends of equal texts near them.
OP6_SQL = """
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
s AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 15))::BIGINT AS h, list_transform(regexp_extract_all(hex(t), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM s),
d AS (SELECT doc_id, h, len(bytes) + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, tab),
o AS (SELECT *, row_number() OVER w - 1 AS rank, (sum(size) OVER w)::BIGINT AS hi, (sum(size) OVER ())::BIGINT AS total FROM d WINDOW w AS (ORDER BY h, text_crc32, doc_id ROWS UNBOUNDED PRECEDING)),
runs AS (SELECT min(hi - size) AS lo, max(hi) AS hi FROM o GROUP BY h, text_crc32),
t AS (SELECT DISTINCT k, total * k // 16 AS target, total FROM o, range(1, 16) r(k)),
n AS (SELECT k, target, total, CASE WHEN target - lo <= hi - target THEN lo ELSE hi END AS near FROM t LEFT JOIN runs ON lo < target AND target < hi),
cuts AS (SELECT CASE WHEN abs(near - target) <= 0.02 * total / 16 THEN near ELSE target END AS cut FROM n),
p AS (SELECT *, (SELECT count(*) FROM cuts WHERE 2 * hi - size >= 2 * cut)::INTEGER AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, rank - min(rank) OVER (PARTITION BY shard) AS slot, NULL::DOUBLE AS grown_shard FROM p
"""
