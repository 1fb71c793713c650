"""Exact top-k inner products: branch and bound on one ball tree per shard.

Candidates are dealt into shards, and each shard's ball tree is built once, as a row of
a table. Queries are dealt into blocks. A task searches one tree for one block: a query
visits the tree's nodes in the order of their upper bound <q, centre> + |q| * radius and
stops at the first bound below its k-th score so far. Blocks search the shards in a few
rounds; after each round every query's current k-th score, over all shards so far, is
what the next round's searches start from.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import Workspace, read

LEAF = 64


class BallTree:
    """Vectors split at the median along the direction of two far points, down to leaves."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.nodes: list[tuple[int, int, int, int]] = []  # first, last, left child, right child
        self.centre, self.radius, order = [], [], np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            me, at = len(self.nodes), order[lo:hi]
            part = x[at]
            c = part.mean(axis=0)
            far = np.linalg.norm(part - c, axis=1)
            self.centre.append(c), self.radius.append(far.max()), self.nodes.append((lo, hi, -1, -1))
            if parent >= 0:
                a, b, left, right = self.nodes[parent]
                self.nodes[parent] = (a, b, me, right) if side == 0 else (a, b, left, me)
            if hi - lo > LEAF and far.max() > 0:
                one = part[far.argmax()]
                two = part[np.linalg.norm(part - one, axis=1).argmax()]
                by = np.argsort(part @ (two - one), kind="stable")
                order[lo:hi] = at[by]
                mid = (lo + hi) // 2
                todo += [(lo, mid, me, 0), (mid, hi, me, 1)]
        self.order = order
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def search(self, qid: int, q: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """The best (score, -id) of the tree that reach ``floor``: scores below it are of no use, equal ones are."""
        bound = self.centre @ q + np.linalg.norm(q) * self.radius
        bound += 1e-9 * (1 + np.abs(bound))  # rounding never hides a node
        best: list[tuple[float, int]] = []
        todo = [(-bound[0], 0)]
        while todo:
            b, node = heapq.heappop(todo)
            if -b < floor:
                break
            lo, hi, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bound[child] >= floor:
                        heapq.heappush(todo, (-bound[child], child))
                continue
            at = self.order[lo:hi]
            score = self.x[at] @ q
            for s, i in zip(score, self.ids[at]):
                if s >= floor and i != qid:
                    entry = (float(s), -int(i))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return best


def _trees(vectors: DataFrame, shards: int) -> DataFrame:
    """dim, shard, tree: one ball tree for the vectors of each shard and length."""

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        tree = BallTree(pdf["id"].to_numpy(np.int64), np.stack(pdf["v"].to_list()).astype(np.float64))
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [pickle.dumps(tree)]})

    rows = vectors.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(shards)).alias("shard"))
    return rows.groupBy("dim", "shard").applyInPandas(build, "dim int, shard long, tree binary")


def _blocks(queries: DataFrame, floors: DataFrame | None) -> DataFrame:
    """dim, block, asked: the queries of a block as one row, with the score that an answer must reach."""

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "asked": [pickle.dumps((pdf["query_id"].to_numpy(np.int64), np.stack(pdf["q"].to_list()), pdf["floor"].to_numpy(np.float64)))]})

    none = F.lit(float("-inf"))
    rows = queries.withColumn("floor", none) if floors is None else queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", none))
    return rows.groupBy("dim", "block").applyInPandas(build, "dim int, block long, asked binary")


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """Each tree's best candidates for each query of a block. pairs: tree, asked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob, asked in zip(pdf["tree"], pdf["asked"]):
                tree = pickle.loads(blob)
                out = [(qid, -i, s) for qid, q, floor in zip(*pickle.loads(asked)) for s, i in tree.search(qid, q, k, floor)]
                yield pd.DataFrame(out, columns=["query_id", "id", "score"])

    return pairs.select("tree", "asked").mapInPandas(run, "query_id long, id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")  # k rows of each search
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 4096, block_rows: int = 1024, rounds: int = 3) -> DataFrame:
    """query_id, rank, id, score: for each query its ``k`` largest inner products with other rows, ties to the smaller id.

    ``vectors``: id and v, an array of numbers; ``queries``: rows of the same form. Rows
    with a null id or a v that is null, empty, or holds null or non-finite numbers take
    no part. A vector meets queries of its own length only. A query's own id is never
    its answer, so rows that repeat a query's id are not either; other repeated rows
    are answers of their own. Of several query vectors under one id the least is asked.
    A query with fewer candidates gets all. A task holds one shard of about
    ``shard_rows`` vectors and one block of about ``block_rows`` queries.
    """
    ws = Workspace(spark, "top-k")
    sound = lambda df: df.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    vectors = sound(vectors.select(F.col("id").cast("long"), F.col("v").cast("array<double>")))
    asked = sound(queries.select(F.col("id").cast("long"), F.col("v").cast("array<double>"))).groupBy(F.col("id").alias("query_id")).agg(F.min("v").alias("q"))
    shards, blocks = max(1, -(-vectors.count() // shard_rows)), max(1, -(-asked.count() // block_rows))
    asked = ws.table(asked.select("query_id", "q", F.size("q").alias("dim"), F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(blocks)).alias("block")), "queries")
    trees = ws.table(_trees(vectors, shards), "trees")
    # a block's first shard differs from block to block, so no shard serves all of them at once
    turn = F.pmod(F.col("shard") - F.col("block"), F.lit(shards))
    turn = F.when(turn == 0, 0).otherwise(1 + turn % max(1, rounds - 1))
    best = None
    for r in range(min(rounds, shards)):
        floors = None if best is None else best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
        each = trees.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).where(turn == r)
        found = _search(each.join(_blocks(asked, floors), ["dim", "block"]).repartition(shards * blocks, "shard", "block"), k)
        if best is not None:
            found = found.unionByName(best.select("query_id", "id", "score"))
        best = ws.table(_best(found, k), "best")
    return best.select("query_id", "rank", "id", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    sound = F.when(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))))
    rows = table.select(F.col("vec_id").alias("id"), sound.alias("v"))
    out = top_k(spark, rows, rows.where("id % 50 = 0"))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
