"""Hard negatives from k-means inverted lists, exactly.

Rows are dealt into inverted lists by their nearest k-means centroid and a hash bucket of
their label; each list stores its radius, the largest distance of a row from the centroid.
By Cauchy-Schwarz an anchor q scores every row of a list between <q, c> - |q| r and
<q, c> + |q| r. An anchor visits its lists in the order of the upper bound, skips lists
that lie outside its score windows, and stops where the bound falls strictly below its
k-th score. Anchors are searched together, in rounds of ever more lists: between two
rounds each anchor's k-th score, over all that it has visited, decides what is left for
it. The centroids are fitted on a bounded sample, but every row is in a list and the
bounds are of all rows, so results are exact whatever the centroids are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import Workspace, read

BUCKETS = 16
#: Bounds are computed in floating point, so a list counts as reaching a little further than it does.
SLACK = 1e-9


def k_means(x: np.ndarray, k: int, steps: int = 12, seed: int = 5) -> np.ndarray:
    """At most ``k`` centroids of the rows of ``x`` by Lloyd's iterations."""
    x = np.unique(x, axis=0)
    centre = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(steps):
        near = nearest(x, centre)[0]
        order = np.argsort(near, kind="stable")
        some, first = np.unique(near[order], return_index=True)
        centre[some] = np.add.reduceat(x[order], first) / np.diff(np.r_[first, len(x)])[:, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` its nearest centroid and the distance to it."""
    near = (0.5 * (centre * centre).sum(axis=1) - x @ centre.T).argmin(axis=1)
    return near, np.linalg.norm(x - centre[near], axis=1)


@dataclass
class Directory:
    """Centroids by vector length, and by (length, centroid, bucket) the radius and the parts of each list."""

    centres: dict[int, np.ndarray]
    lists: dict[int, np.ndarray]  # dim -> rows (cluster, bucket, radius, parts)

    def bounds(self, dim: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each anchor with each list of its length."""
        of = self.lists[dim]
        mid, reach = (q @ self.centres[dim].T)[:, of[:, 0].astype(int)], np.linalg.norm(q, axis=1)[:, None] * of[:, 2]
        reach = reach + SLACK * (1 + np.abs(mid) + reach)
        return mid - reach, mid + reach


def _vectors(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_list()).astype(np.float64)


def _centres(rows: DataFrame, count: int, sample: int, list_rows: int, most: int) -> dict[int, np.ndarray]:
    """Centroids for each vector length in a sample of at most ``sample`` rows, drawn by a hash of id and vector."""

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(np.clip(round(count * len(pdf) / drawn / list_rows), 1, most))
        return pd.DataFrame({"dim": [key[0]], "c": [pickle.dumps(k_means(_vectors(pdf["v"]), k))]})

    some = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample).select(F.size("v").alias("dim"), "v")
    drawn = min(count, sample)
    return {r.dim: pickle.loads(r.c) for r in some.groupBy("dim").applyInPandas(fit, "dim int, c binary").collect()}


def _assign(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """The rows with dim, cluster and far, the distance from the centroid. A length without centroids gets the origin."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["dim"] = pdf["v"].map(len).astype("int32")
            for dim, of in pdf.groupby("dim"):
                x = _vectors(of["v"])
                near, far = nearest(x, shared.value.get(dim, np.zeros((1, dim))))
                yield of.assign(cluster=near.astype(np.int32), far=far)

    return rows.mapInPandas(run, "id long, label long, v array<double>, bucket int, dim int, cluster int, far double")


def _visits(state: DataFrame, directory, same: bool, lo: int, hi: int) -> DataFrame:
    """The lists that each anchor visits in this round, as rows of ``VISIT``.

    ``state`` has, per anchor, the least and the greatest score that are of use in each
    of its windows. The anchor's lists (of its own label's bucket if ``same``, else all)
    are ranked by upper bound, the same in every round; those ranked from ``lo`` to
    ``hi`` whose bounds meet a window are visited.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, of in pdf.groupby("dim"):
                lists = directory.value.lists.get(dim)
                for at in range(0, len(of) if lists is not None else 0, 256):
                    some = of.iloc[at : at + 256]
                    least, most = directory.value.bounds(dim, _vectors(some["v"]))
                    open_to = lists[:, 1] == some["bucket"].to_numpy()[:, None] if same else np.ones(most.shape, bool)
                    order = np.argsort(np.where(open_to, -most, np.inf), axis=1, kind="stable")
                    rank = np.empty_like(order)
                    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
                    floors, tops = _padded(some["floors"], np.inf), _padded(some["tops"], -np.inf)
                    meets = np.zeros(most.shape, bool)
                    for j in range(floors.shape[1]):
                        meets |= (most >= floors[:, [j]]) & (least <= tops[:, [j]])
                    who, which = np.nonzero(open_to & meets & (rank >= lo) & (rank < hi))
                    out = some.iloc[who][["anchor", "label", "dim", "v", "floors", "tops"]].reset_index(drop=True)
                    yield out.assign(cluster=lists[which, 0].astype(np.int32), bucket=lists[which, 1].astype(np.int32), parts=lists[which, 3].astype(np.int32))

    return state.mapInPandas(run, VISIT)


VISIT = "anchor long, label long, dim int, v array<double>, floors array<double>, tops array<double>, cluster int, bucket int, parts int"
LIST = ["dim", "cluster", "bucket"]


def _padded(col: pd.Series, fill: float) -> np.ndarray:
    """Arrays of different lengths as one matrix."""
    out = np.full((len(col), max(map(len, col), default=0)), fill)
    for r, x in enumerate(col):
        out[r, : len(x)] = x
    return out


def _search(lists: DataFrame, visits: DataFrame, same: bool, k: int, task_rows: int) -> DataFrame:
    """anchor, window, id, score: from each part of a list the ``k`` best rows for each window of each visitor.

    A task holds one part of a list and at most about ``task_rows`` visitors; a list with
    more visitors is sent once for each wave of them.
    """

    def run(key, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            rows = rows.sort_values("id", kind="stable")
            x, ids, labels = _vectors(rows["v"]), rows["id"].to_numpy(), rows["label"].to_numpy()
            for at in range(0, len(asked), 256):
                some = asked.iloc[at : at + 256]
                anchor, label = some["anchor"].to_numpy(), some["label"].to_numpy()
                score = _vectors(some["v"]) @ x.T
                may = ((labels == label[:, None]) == same) & (ids != anchor[:, None])
                floors, tops = _padded(some["floors"], np.inf), _padded(some["tops"], -np.inf)
                for j in range(floors.shape[1]):
                    use = may & (score >= floors[:, [j]]) & (score <= tops[:, [j]])
                    if len(x) > k:
                        use &= score >= np.partition(np.where(use, score, -np.inf), -k, axis=1)[:, [-k]]
                    who, which = np.nonzero(use)
                    order = np.lexsort((which, -score[who, which], who))
                    who, which = who[order], which[order]
                    first = np.searchsorted(who, who)
                    best = np.arange(len(who)) - first < k
                    who, which = who[best], which[best]
                    out.append(pd.DataFrame({"anchor": anchor[who], "window": j, "id": ids[which], "score": score[who, which]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor": [], "window": [], "id": [], "score": []})

    waves = visits.groupBy(*LIST).agg(F.ceil(F.count("*") / task_rows).alias("waves"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lists.join(waves, LIST).withColumn("wave", each("waves"))
    asked = visits.join(waves, LIST).withColumn("wave", F.pmod(F.xxhash64("anchor", F.lit(9)), F.col("waves"))).withColumn("parts", F.col("parts").cast("long")).withColumn("part", each("parts"))
    key = [*LIST, "part", "wave"]
    return dealt.select(*key, "id", "label", "v").groupBy(*key).cogroup(asked.select(*key, "anchor", "label", "v", "floors", "tops").groupBy(*key)).applyInPandas(run, "anchor long, window int, id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")  # k rows of each part searched
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rounds(ws: Workspace, lists: DataFrame, directory, state, same: bool, k: int, widest: int, task_rows: int) -> DataFrame:
    """anchor, window, rank, id, score: the ``k`` best rows of each window. state: from the best so far to the anchors' windows."""
    best, lo, width = None, 0, 1
    while lo < widest:
        visits = ws.table(_visits(state(best), directory, same, lo, lo + width), "visits")
        found = _search(lists, visits, same, k, task_rows)
        if best is not None:
            found = found.unionByName(best.select("anchor", "window", "id", "score"))
        best = ws.table(_best(found, k), "best")
        lo, width = lo + width, 16 * width
    return best


def hard_negatives(
    spark: SparkSession,
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    sample: int = 20_000,
    list_rows: int = 1024,
    most_centroids: int = 1024,
    task_rows: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` and ``anchors`` hold id, label and v, an array of numbers; scores are inner
    products (exact for whole numbers up to 2**53). An anchor's positives are the
    ``positives`` best other rows of its label; for each, the ``negatives`` best rows of
    other labels whose score is ``least`` to ``most`` percent of the positive's are
    returned; ties go to the smaller id.

    Rows with a null id or label, or a v that is null, empty, or holds null or
    non-finite numbers take no part, as rows or as anchors. Vectors meet those of their
    own length only. An anchor's own id is never its answer, so rows that repeat it are
    not either; other repeated rows are answers of their own. Of several anchors under
    one id the one with the least label, then vector, is asked. Anchors without
    positives, and positives without a row in their window, give no rows; an empty table
    gives none. Other columns are not read.

    Centroids (``most_centroids`` at most) are fitted on ``sample`` rows; they decide how
    much is skipped, never what is found. A list longer than ``task_rows`` is searched in
    parts.
    """
    ws = Workspace(spark, "hard-negatives")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = lambda df: (
        df.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v"))
        .where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
        .where(~F.exists("v", bad))
        .withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int"))
    )
    source = ws.table(sound(rows), "rows")
    asked = sound(anchors).groupBy(F.col("id").alias("anchor")).agg(F.min(F.struct("label", "v", "bucket")).alias("a"))
    asked = ws.table(asked.select("anchor", "a.label", "a.bucket", "a.v", F.size("a.v").alias("dim")), "anchors")
    size = source.agg(F.count("*").alias("n"), F.count_distinct("bucket").alias("b")).first()
    if not size.n:
        return spark.createDataFrame([], OUT)
    centres = _centres(source, size.n, sample, list_rows * size.b, most_centroids)
    dealt = ws.table(_assign(source, centres), "assigned")
    index = ws.table(dealt.groupBy(*LIST).agg(F.max("far").alias("radius"), F.ceil(F.count("*") / task_rows).alias("parts")), "index")
    entries = index.toPandas()  # a row for each centroid and bucket at most
    by_dim = {int(d): of[["cluster", "bucket", "radius", "parts"]].to_numpy(np.float64) for d, of in entries.groupby("dim")}
    directory = spark.sparkContext.broadcast(Directory({d: centres.get(d, np.zeros((1, d))) for d in by_dim}, by_dim))
    lists = dealt.join(index.select(*LIST, "parts"), LIST).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")))
    widest = max(map(len, by_dim.values()))

    def for_positives(best: DataFrame | None) -> DataFrame:
        if best is None:
            return asked.withColumn("floors", F.array(F.lit(float("-inf")))).withColumn("tops", F.array(F.lit(float("inf"))))
        full = best.groupBy("anchor").agg(F.when(F.count("*") >= positives, F.min("score")).alias("floor"))
        return asked.join(full, "anchor", "left").select("*", F.array(F.coalesce("floor", F.lit(float("-inf")))).alias("floors"), F.array(F.lit(float("inf"))).alias("tops")).drop("floor")

    good = _rounds(ws, lists, directory, for_positives, True, positives, max(of[:, 1].tolist().count(b) for of in by_dim.values() for b in set(of[:, 1])), task_rows)
    windows = good.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    def for_negatives(best: DataFrame | None) -> DataFrame:
        each = windows.withColumn("floor", least * F.col("positive_score") / 100).withColumn("top", most * F.col("positive_score") / 100)
        if best is not None:
            full = best.groupBy("anchor", "window").agg(F.when(F.count("*") >= negatives, F.min("score")).alias("reached"))
            each = each.join(full, ["anchor", "window"], "left").withColumn("floor", F.greatest("floor", "reached"))
        sides = F.sort_array(F.collect_list(F.struct("window", "floor", "top")))  # one entry for each positive
        sides = each.groupBy("anchor").agg(sides.alias("w")).select("anchor", F.col("w.floor").alias("floors"), F.col("w.top").alias("tops"))
        return asked.join(sides, "anchor")

    found = _rounds(ws, lists, directory, for_negatives, False, negatives, widest, task_rows)
    out = found.join(windows, ["anchor", "window"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score double, negative_score double"


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    sound = F.when(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))))
    rows = table.select(F.col("vec_id").alias("id"), label.alias("label"), sound.alias("v"))
    out = hard_negatives(spark, rows, rows.where("id % 50 = 0"))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("positive_score").cast("long").alias("positive_score"), F.col("negative_score").cast("long").alias("negative_score"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
