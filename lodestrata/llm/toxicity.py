"""Toxicity scores from a factorization machine over hashed terms.

A text's terms are its distinct words and their first 4, 5 and 6 letters, hashed.
score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), so that a pair of
terms can weigh more or less than its parts. The machine is fitted in numpy, in
one task, on a bounded sample of labelled rows; which terms it knows is chosen by
how unevenly they fall on the two labels of that sample.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import Workspace, read, small

WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
BITS = 22


def word_terms(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    hashes = [xxhash.xxh3_64_intdigest("w" + word)] + [xxhash.xxh3_64_intdigest(f"p{k}" + word[:k]) for k in PREFIXES if len(word) >= k]
    return [h >> (64 - BITS) for h in hashes]


def text_terms(text: str | None) -> set[int]:
    return {t for w in set(WORDS.findall((text or "").lower())) for t in word_terms(w)}


class Machine:
    """w0, w, V over the chosen terms; remembers a bounded number of words."""

    def __init__(self, terms: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray, remember: int = 50_000):
        self.place = {int(t): k for k, t in enumerate(terms)}
        self.w0, self.w, self.v, self.remember = w0, w, v, remember
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        out = self.known.get(word)
        if out is None:
            out = tuple(self.place[t] for t in word_terms(word) if t in self.place)
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[word] = out
        return out

    def score(self, text: str | None) -> float:
        on = set()
        for w in set(WORDS.findall((text or "").lower())):
            on.update(self.word(w))
        z = self.w0
        if on:
            at = np.fromiter(sorted(on), np.int64, len(on))
            v = self.v[at]
            z += self.w[at].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(x: np.ndarray, y: np.ndarray, factors: int, steps: int, rate: float = 0.03, decay: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the log loss, both labels weighing the same in sum up to a ratio of three."""
    rng = np.random.default_rng(7)
    n, d = x.shape
    p = [np.zeros(1, np.float32), np.zeros(d, np.float32), (rng.standard_normal((d, factors)) * 0.01).astype(np.float32)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    up = min(3.0, max(1.0, (y == 0).sum() / max(1, (y == 1).sum())))
    weight = np.where(y == 1, up, 1.0).astype(np.float32)
    weight /= weight.sum()
    for t in range(1, steps + 1):
        xv = x @ p[2]
        z = p[0] + x @ p[1] + 0.5 * (xv**2 - x @ (p[2] ** 2)).sum(axis=1)
        e = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)).astype(np.float32)
        xe = x.T @ e
        grads = [e.sum(keepdims=True), xe + decay * p[1], x.T @ (e[:, None] * xv) - xe[:, None] * p[2] + decay * p[2]]
        for a, g, mm, ss in zip(p, grads, m, s):
            mm *= 0.9
            mm += 0.1 * g
            ss *= 0.999
            ss += 0.001 * g * g
            a -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(ss / (1 - 0.999**t)) + 1e-8)
    return float(p[0][0]), p[1], p[2]


def learn(spark: SparkSession, ws: Workspace, docs: DataFrame, labels: DataFrame, most: int = 2500, most_clean: int = 5000, terms: int = 1024, least_chi2: float = 12.0, factors: int = 4, steps: int = 150) -> Machine:
    """Fits a machine on at most ``most`` rows of label 1 and ``most_clean`` of label 0, drawn by a hash of their id.

    ``docs``: id, text. ``labels``: id, y (1, 0 or null; null is left out). The bounds
    keep the broadcast, the rows that the fitting task gets, and its matrix
    (rows x ``terms``) at a fixed size whatever the input. Without labels the machine
    gives every text the same score.
    """
    drawn = [labels.where(F.col("y") == y).where("id IS NOT NULL").groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, most), (0, most_clean))]
    drawn = drawn[0].unionByName(drawn[1])  # of bounded size
    # one text per id, so that rows that repeat an id do not swell the sample; written, as it is read three times
    sample = ws.table(docs.join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min("text").alias("text")), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[int]] = {0: [], 1: []}
        for batch in batches:
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                by[y].extend(text_terms(text))
        one, n1 = np.unique(np.array(by[1], np.int64), return_counts=True)
        zero, n0 = np.unique(np.array(by[0], np.int64), return_counts=True)
        term = np.concatenate([one, zero])
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.r_[n1, 0 * n0].astype(np.int64)), pa.array(np.r_[0 * n1, n0].astype(np.int64))], names=["term", "n1", "n0"])

    totals = sample.groupBy().agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")).first()
    p, q = totals.p or 0, totals.q or 0
    if not p or not q:
        return Machine(np.empty(0, np.int64), -3.0 if not p else 3.0, np.zeros(0, np.float32), np.zeros((0, factors), np.float32))
    counts = sample.mapInArrow(count, "term long, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    share = (F.col("n1") + F.col("n0") + 1) / F.lit(p + q + 2)
    uneven = (F.col("n1") / p - F.col("n0") / q) ** 2 / (share * (1 - share) * (1 / p + 1 / q))  # chi squared
    chosen = np.array(sorted(r.term for r in counts.where(uneven >= least_chi2).orderBy(F.desc(uneven), "term").limit(terms).collect()), np.int64)
    place = spark.sparkContext.broadcast({int(t): k for k, t in enumerate(chosen)})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [[k for k in (place.value.get(t) for t in text_terms(x)) if k is not None] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(on, pa.list_(pa.int32()))], names=["id", "y", "on"])

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.zeros((len(pdf), len(place.value)), np.float32)
        for r, on in enumerate(pdf["on"]):
            x[r, np.asarray(on, np.int64)] = 1
        return pd.DataFrame({"model": [pickle.dumps(fit(x, pdf["y"].to_numpy(np.float32), factors, steps))]})

    rows = sample.select("id", F.col("y").cast("long").alias("y"), "text").mapInArrow(pick, "id long, y long, on array<int>")
    w0, w, v = pickle.loads(rows.groupBy().applyInPandas(train, "model binary").first().model)
    return Machine(chosen, w0, w, v)


def score_texts(spark: SparkSession, docs: DataFrame, machine: Machine, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The rows of ``docs``, each with the score (0 to 1) of its whole text as ``out_col``, empty and null ones too.

    The columns of ``docs`` stay as they are; ``out_col`` must be a new name.
    """
    model = spark.sparkContext.broadcast(machine)
    rest = docs.columns
    if out_col in rest:
        raise ValueError(f"there is a column {out_col} already")
    at = rest.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            scores = pa.array([model.value.score(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*rest, out_col])

    return docs.mapInArrow(run, schema)


def held_out(id_col) -> F.Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 1 when divided by 3. A null id is not among them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fitted(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine that has learned from the rows of ``docs`` that ``labels`` marks and that are not held out."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marks = labels.where(~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    return learn(spark, Workspace(spark, "toxicity"), texts, marks)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, score of every row of ``docs``. Learns from ``labels`` of rows that are not held out.

    Null and empty texts get the score of no terms. Rows with a null id are scored and
    not learned from; rows that repeat an id are all scored, and the least of their texts
    is learned from; a repeated label counts once, 1 before 0. Other columns are not
    read; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return score_texts(spark, texts, fitted(spark, docs, labels, id_col, text_col, label_col)).select("id", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
