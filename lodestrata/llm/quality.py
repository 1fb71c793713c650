"""Quality scores from a regularised quadratic discriminant over document statistics.

Each text becomes a few numbers that do not depend on its language (``NAMES``), on scales
where the documents of a class lie roughly as one cloud. A class is a mean and a
covariance; both are sums over its labelled rows, which Spark adds up, so every labelled
row counts. A covariance is shrunk towards that of both classes together and towards a
multiple of the identity. A score compares the two log densities; each needs the
Mahalanobis distance, got by solving with the class's Cholesky factor, which is made once.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import Workspace, give_back, read

NAMES = ["words", "word_bytes", "distinct", "echo", "letters", "capitals", "signs", "stops", "bars", "digits", "lines", "repeated_lines", "spread"]
SIGNS = np.frombuffer(b"#$%&*!@^~<>=+\\/_{}[]", np.uint8)
STOPS = np.frombuffer(b".,;:?", np.uint8)


def share(part: float, whole: float) -> float:
    """A share on a scale that tells small shares apart."""
    return float(np.sqrt((part + 0.1) / (whole + 1)))


def statistics(raw: bytes) -> np.ndarray:
    """The numbers of one whole text, in the order of ``NAMES``."""
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    seen = n and len(set(words))
    echoes = sum(map(operator.eq, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x]
    upper, lower, wide = int(count[65:91].sum()), int(count[97:123].sum()), int(count[128:].sum())
    ink = len(raw) - int(count[[32, 9, 10, 11, 12, 13]].sum())
    p = count[count > 0] / max(1, len(raw))
    return np.array([
        np.log1p(n),
        np.log1p(ink / n if n else 0),
        np.log1p(seen) - np.log1p(n),
        share(echoes, n),
        share(ink - upper - lower - wide, ink),
        share(upper, upper + lower),
        share(count[SIGNS].sum(), ink),
        share(count[STOPS].sum(), ink),
        share(count[124], n),
        share(count[48:58].sum(), ink),
        np.log1p(len(lines)) - np.log1p(n),
        share(len(lines) - len(set(lines)), len(lines)),
        float(-(p * np.log(p)).sum()),
    ])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, stats: the numbers of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(raw.as_py() or b"") for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], names=["id", "stats"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(run, "id long, stats array<double>")


def moments(marked: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each class its rows, their sum and the sum of their outer products. marked: y, stats."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for y, of in pdf.groupby("y"):
                x = np.stack(of["stats"].to_list())
                sums = np.r_[len(x), x.sum(axis=0), (x.T @ x).ravel()]
                yield pd.DataFrame({"y": y, "k": np.arange(len(sums)), "v": sums})

    rows = marked.mapInPandas(partial, "y int, k int, v double")
    sums = rows.groupBy("y", "k").agg(F.sum("v").alias("v")).collect()  # two classes, a fixed number of sums
    d = len(NAMES)
    out = {}
    for y in {r.y for r in sums}:
        s = np.array([r.v for r in sorted((r for r in sums if r.y == y), key=lambda r: r.k)])
        out[y] = (int(s[0]), s[1 : d + 1], s[d + 1 :].reshape(d, d))
    return out


@dataclass
class Discriminant:
    """Log weight, mean and Cholesky factor of each class, label 0 first."""

    weights: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    slope: float = 0.25

    @classmethod
    def fit(cls, of: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled: float = 0.1, ridge: float = 0.02) -> Discriminant | float:
        """From the classes' moments. With one class, or none, the score of every text instead."""
        if set(of) != {0, 1}:
            return float(1 in of)
        n = np.array([of[y][0] for y in (0, 1)], float)
        means = np.stack([of[y][1] / of[y][0] for y in (0, 1)])
        scatter = [of[y][2] - of[y][0] * np.outer(m, m) for y, m in zip((0, 1), means)]
        both = (scatter[0] + scatter[1]) / n.sum()
        d = len(means[0])
        factors = []
        for y in (0, 1):
            lean = max(pooled, d / (n[y] + d))  # few rows lean more on both classes
            c = (1 - lean) * scatter[y] / n[y] + lean * both
            c = (1 - ridge) * c + ridge * np.trace(c) / d * np.eye(d) + 1e-9 * np.eye(d)
            factors.append(np.linalg.cholesky(c))
        return cls(np.log(n / n.sum()), means, np.stack(factors))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """For each row the probability of label 1, with log-density differences damped by ``slope``."""
        log = []
        for w, m, f in zip(self.weights, self.means, self.factors):
            z = np.linalg.solve(f, (x - m).T)
            log.append(w - np.log(np.diag(f)).sum() - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip(self.slope * (log[1] - log[0]), -500, 500)))


def held_out(id_col: str) -> F.Column:
    """Rows that no label is learned from: crc32 of the id as text is divisible by 5. A null id is not among them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, score (0 to 1, label 1 likelier), stats: one row per row of ``docs``.

    Learns from every row that ``labels`` marks 0 or 1 and that is not held out. Whole
    texts are read; null and empty ones are scored by their statistics, as any other.
    Rows with a null id are scored and not learned from; rows that repeat an id are all
    scored, and all learned from; a repeated label counts once, 1 before 0. Without
    labels of both classes every text gets the same score, 1 if all labels are 1, else 0.
    Other columns are not read; an empty table gives no rows.
    """
    stats = Workspace(spark, "quality").table(text_statistics(docs, id_col, text_col), "statistics")
    marks = labels.where(~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    marks = marks.where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    model = Discriminant.fit(moments(stats.join(marks, "id").select("y", "stats")))
    if isinstance(model, float):
        return stats.select("id", F.lit(model).alias("score"), "stats")
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(x)), batch.column(1)], names=["id", "score", "stats"])

    return stats.mapInArrow(score, "id long, score double, stats array<double>")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
