"""Vectors kept as matrix blocks, and many nearest-neighbour questions answered in one pass over them.

A block is a row: the keys of some thousand vectors and their normalised numbers as one
binary value. Blocks are made once per generation of a vault (see ``VectorMatrices``) and
asked often; a task multiplies its blocks with all questions at once and keeps the best
of each, so what is shuffled is ``k`` rows per block and question.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.ranking import top_k


def _matrix(column: pa.Array, keys: list) -> np.ndarray:
    """Rows of length one. A vector that is null, of another length, without direction or not finite is an error that names its key."""
    rows = column.to_pylist() if column.null_count or column.flatten().null_count else None
    sizes = np.diff(column.offsets.to_numpy()) if rows is None else np.array([len(r or []) for r in rows])
    dim = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    bad = [k for k, n in zip(keys, sizes) if n != dim or not n]
    if rows is not None:
        bad += [k for k, r in zip(keys, rows) if r is None or None in r]
    if not bad:
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        norm = np.sqrt((x * x).sum(axis=1))
        bad = [keys[i] for i in np.flatnonzero(~(np.isfinite(norm) & (norm > 0)))]
    if bad:
        raise ValueError(f"broken vector: {bad[0]}")
    return x / norm[:, None]


def vector_blocks(vectors: DataFrame, key: str, column: str = "vector", rows: int = 2048) -> DataFrame:
    """keys, dimension, matrix: the vectors in blocks of up to ``rows``, without a shuffle."""
    kind = vectors.schema[key].dataType

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                keys = part.column(0)
                x = _matrix(part.column(1), keys.to_pylist())
                blob = np.ascontiguousarray(x, "<f4").tobytes()
                listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                yield pa.RecordBatch.from_arrays([listed, pa.array([x.shape[1]], pa.int32()), pa.array([blob], pa.binary())], names=["keys", "dimension", "matrix"])

    return vectors.select(key, column).mapInArrow(build, f"keys array<{kind.simpleString()}>, dimension int, matrix binary")


def nearest_in_blocks(blocks: DataFrame, questions: DataFrame, k: int, most: int = 4096) -> DataFrame:
    """query_id, key, score, rank: the ``k`` most similar vectors for each question (query_id, vector), ties to the smaller key.

    Questions of one call go to every task, so there are at most ``most`` (else an
    error); ask more in several calls. Scores are cosines, rounded to six places.
    """
    asked = questions.select("query_id", "vector").limit(most + 1).toArrow()
    if asked.num_rows > most:
        raise ValueError(f"more than {most} questions in one call")
    ids = asked.column(0).to_pylist()
    q = _matrix(asked.column(1).combine_chunks(), ids) if ids else np.zeros((0, 0))
    kind = questions.schema["query_id"].dataType
    key = blocks.schema["keys"].dataType.elementType
    ids_type = asked.schema.field("query_id").type
    shared = blocks.sparkSession.sparkContext.broadcast((ids, q))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for batch in batches:
            for keys, dim, blob in zip(batch.column(0), batch.column(1), batch.column(2)):
                if not len(ids):
                    continue
                if dim.as_py() != q.shape[1]:
                    raise ValueError("questions and vectors need one dimension")
                x = np.frombuffer(blob.as_buffer(), "<f4").reshape(-1, q.shape[1]).astype(np.float64)
                score = np.round(q @ x.T, 6)
                names = keys.values
                order = np.argsort(np.array(names.to_pylist(), dtype=object), kind="stable")  # columns by key, so that ties are
                score = score[:, order]
                least = np.partition(score, -k, axis=1)[:, [-k]] if score.shape[1] > k else -np.inf
                who, which = np.nonzero(score >= least)
                by = np.lexsort((which, -score[who, which], who))
                who, which = who[by], which[by]
                best = np.arange(len(who)) - np.searchsorted(who, who) < k
                who, which = who[best], which[best]
                yield pa.RecordBatch.from_arrays([pa.array([ids[w] for w in who], ids_type), names.take(pa.array(order[which])), pa.array(score[who, which])], names=["query_id", "key", "score"])

    found = blocks.mapInArrow(ask, f"query_id {kind.simpleString()}, key {key.simpleString()}, score double")
    return top_k(found, k, ["key"])
