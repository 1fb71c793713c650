"""Language identification with a convolutional network over bytes, trained in numpy.

A text is cut into windows of fixed length. Filters of widths 2, 3 and 4 slide over
the byte embeddings of a window, each filter's largest response is pooled, and a
softmax turns the pooled responses into probabilities; a text's are the mean of its
windows'. For scoring, embeddings and filters are folded into tables by byte and by
pair of bytes, so a filter costs one or two look-ups per position.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import read

WINDOW = 256
WIDTHS = (2, 3, 4)


def windows(raw: bytes, most: int | None = None) -> np.ndarray:
    """The text's windows, the last one filled up with zero bytes; ``most`` evenly spread ones for training."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    out = out.reshape(n, WINDOW)
    return out if most is None or n <= most else out[np.linspace(0, n - 1, most).astype(int)]


class Network:
    def __init__(self, langs: list[str], size: int = 8, filters: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        g = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
        self.langs = langs
        self.p = {"e": g(256, size, k=0.3), "o": g(len(WIDTHS) * filters, len(langs), k=0.1), "c": np.zeros(len(langs), np.float32)}
        for w in WIDTHS:
            self.p[f"f{w}"], self.p[f"b{w}"] = g(w, size, filters, k=(1 / (w * size)) ** 0.5), np.zeros(filters, np.float32)
        self.p["e"][0] = 0

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss over a batch of windows."""
        p, n = self.p, len(x)
        e = p["e"][x]
        pooled, where = [], []
        for w in WIDTHS:
            a = sum(e[:, k : WINDOW - w + 1 + k] @ p[f"f{w}"][k] for k in range(w)) + p[f"b{w}"]
            at = a.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(a, at[:, None], 1)[:, 0])
        h = np.concatenate(pooled, axis=1)
        r = np.maximum(h, 0)
        q = softmax(r @ p["o"] + p["c"])
        q[np.arange(n), y] -= 1
        q *= weight[:, None]
        grad = {"o": r.T @ q, "c": q.sum(axis=0), "e": np.zeros_like(p["e"])}
        back = (q @ p["o"].T) * (h > 0)
        for w, at, d in zip(WIDTHS, where, np.split(back, len(WIDTHS), axis=1)):
            grad[f"b{w}"], gf = d.sum(axis=0), np.zeros_like(p[f"f{w}"])
            for k in range(w):
                bytes_at = np.take_along_axis(x, at + k, 1)  # windows x filters
                emb = p["e"][bytes_at]
                gf[k] = np.einsum("nfs,nf->sf", emb, d)
                np.add.at(grad["e"], bytes_at, d[:, :, None] * p[f"f{w}"][k].T[None])
            grad[f"f{w}"] = gf
        grad["e"][0] = 0
        return grad

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.004) -> None:
        rng = np.random.default_rng(11)
        share = np.bincount(y, minlength=len(self.langs))
        per = (1 / np.maximum(share, 1)).astype(np.float32)
        m, s, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                w = per[y[at]]
                grad, t = self.step(x[at], y[at], w / w.sum()), t + 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)

    def fold(self) -> None:
        """Tables of filter responses by byte and by pair of bytes."""
        one = {(w, k): self.p["e"] @ self.p[f"f{w}"][k] for w in WIDTHS for k in range(w)}
        two = lambda w, k: (one[w, k][:, None] + one[w, k + 1][None]).reshape(65536, -1).astype(np.float32)
        self.t2, self.t3, self.t3b, self.t4, self.t4b = two(2, 0), two(3, 0), one[3, 2].astype(np.float32), two(4, 0), two(4, 2)

    def probabilities(self, x: np.ndarray, chunk: int = 256) -> np.ndarray:
        out = []
        for s in range(0, len(x), chunk):
            b = x[s : s + chunk]
            pair = b[:, :-1].astype(np.int32) * 256 + b[:, 1:]
            a3 = self.t3.take(pair[:, :-1], axis=0)
            a3 += self.t3b.take(b[:, 2:], axis=0)
            a4 = self.t4.take(pair[:, :-2], axis=0)
            a4 += self.t4b.take(pair[:, 2:], axis=0)
            h = np.concatenate([a.max(axis=1) + self.p[f"b{w}"] for w, a in zip(WIDTHS, (self.t2.take(pair, axis=0), a3, a4))], axis=1)
            out.append(softmax(np.maximum(h, 0) @ self.p["o"] + self.p["c"]))
        return np.concatenate(out)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def learn(spark: SparkSession, docs: DataFrame, most: int = 4000, per_text: int = 2, epochs: int = 4) -> Network | None:
    """Trains on at most ``most`` rows of ``docs`` (id, text, lang), drawn by a hash of their id, ``per_text`` windows each.

    One task gets the sample, of fixed size whatever the input. None without any labelled text.
    """
    ids = docs.where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select("id").orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").join(F.broadcast(ids.distinct()), "id")  # of bounded size
    sample = rows.groupBy("id").agg(F.min(F.struct("lang", "text")).alias("r")).select("id", "r.text", "r.lang")  # one row per id, though ids repeat

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "lang", "text"])
        langs = sorted(set(pdf["lang"]))
        x = [windows(t.encode(), per_text) for t in pdf["text"]]
        y = np.repeat([langs.index(v) for v in pdf["lang"]], [len(a) for a in x])
        net = Network(langs)
        net.fit(np.concatenate(x), y, epochs)
        return pd.DataFrame({"model": [pickle.dumps((langs, net.p))]})

    row = sample.groupBy().applyInPandas(train, "model binary").first()
    if row is None:
        return None
    langs, p = pickle.loads(row.model)
    net = Network(langs)
    net.p = p
    return net


def identify(spark: SparkSession, docs: DataFrame, net: Network | None) -> DataFrame:
    """id, lang, score of each row of ``docs`` (id, text).

    All windows of the whole text count. Texts that are null or hold no letter, and all
    texts if there was nothing to learn from, are ``und`` with score 0.
    """
    model = spark.sparkContext.broadcast(net)
    tables: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        if net is not None and not tables:
            net.fold()
            tables.append(net)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            at = [k for k, t in enumerate(texts) if net is not None and t and any(map(str.isalpha, t))]
            for k in range(0, len(at), 64):
                part = at[k : k + 64]
                x = [windows(texts[i].encode()) for i in part]
                q = net.probabilities(np.concatenate(x))
                mean = np.add.reduceat(q, np.cumsum([0, *map(len, x[:-1])]), axis=0) / np.array([len(a) for a in x])[:, None]
                for i, m in zip(part, mean):
                    best = int(m.argmax())
                    langs[i], scores[i] = net.langs[best], min(1.0, float(m[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang", "score"])

    return docs.mapInArrow(run, "id long, lang string, score double")


def held_out(id_col: str) -> F.Column:
    """Rows not learned from: crc32 of the id as text leaves 2 when divided by 4. A null id is not among them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def language(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, score of every row; learns from rows that are not held out.

    Null ids are scored and not learned from; repeated rows are all scored; other
    columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return identify(spark, rows.select("id", "text"), learn(spark, rows.where(~held_out("id"))))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language(spark, read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), F.col("lang").alias("lang_pred"), "score")
