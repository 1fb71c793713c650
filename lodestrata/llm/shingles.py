"""Word shingles as 64-bit fingerprints, and counts of them in a table of fixed size."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Odd multiplier that makes a shingle's fingerprint depend on the order of its words.
STEP = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 4096
#: Bytes of a text that are hashed at once, up to the end of a word.
PIECE = 1 << 16
SPACE = re.compile(rb"[ \t-\r]")
IS_SPACE = bytes(b in b" \t\n\v\f\r" for b in range(256))
#: Odd base of the hash of a word's bytes.
BASE = 0xD6E8FEB86659FD93


def word_hashes(text: bytes | None) -> np.ndarray:
    """One 64-bit hash per word, A-Z lower-cased. bytes.lower and bytes.split know ASCII only, as wanted."""
    words = (text or b"").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


@functools.cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and how many words each text has.

    Words are as in ``word_hashes``, their hashes are others: the polynomial of a word's bytes, mixed with its
    length, from running sums over all bytes in place of a call for each word.
    """
    text, at, hashes, starts = b"\n".join(t or b"" for t in texts).lower(), 0, [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    marks = text.translate(IS_SPACE)
    while at < len(text):
        end = len(text)
        if end - at > PIECE and (m := SPACE.search(text, at + PIECE)):
            end = m.start()
        x, space = (np.frombuffer(b, np.uint8, end - at, at) for b in (text, marks))
        size = 1 << max(16, len(x).bit_length())
        inside = np.ones(len(x) + 2, bool)
        inside[1:-1] = space
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edges[::2], edges[1::2]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.multiply(x, _powers(BASE, size)[: len(x)]).cumsum(out=sums[1:])
        h = (sums[stop] - sums[start]) * _powers(pow(BASE, -1, 2**64), size)[start] + (stop - start).astype(np.uint64) * STEP
        h = (h ^ (h >> np.uint64(32))) * STEP
        hashes.append(h ^ (h >> np.uint64(29)))
        starts.append(start + at)
        at = end
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Fingerprints of all runs of ``size`` words in text order; fewer words count as one run, none as no run.

    Runs are put together from runs of half their length, so that long ones take few passes.
    """
    if len(words) == 0:
        return words
    run = min(size, len(words))
    power, out, have = STEP, words, 1
    for bit in bin(run)[3:]:
        # STEP to the power ``have`` stands for the words of a second run of the same length
        out = out[: len(out) - have] * power + out[have:]
        power, have = np.uint64(int(power) ** 2 % 2**64), 2 * have
        if bit == "1":
            out = out[:-1] * STEP + words[have:]
            power, have = np.uint64(int(power) * int(STEP) % 2**64), have + 1
    out = out + np.uint64(run * pow(int(STEP), run - 1, 2**64) % 2**64)
    out = (out ^ (out >> np.uint64(31))) * STEP
    return out ^ (out >> np.uint64(29))


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text)))


def set_signature(s: np.ndarray) -> int:
    """A signed 64-bit hash of a sorted set, equal for equal sets."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes | None]]:
    """(id, text) of batches with these two columns, without ids that are null."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        yield from ((i, t) for i, t in zip(ids, texts) if i is not None)


def pack(names: list[str], kinds: list[pa.DataType], columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    arrays = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64)).cast(k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


class Tally:
    """Counts of buckets in a table of fixed size, given out as compressed blocks."""

    def __init__(self, bits: int):
        self.table, self.waiting, self.n = np.zeros(1 << bits, np.int64), [], 0

    def add(self, buckets: np.ndarray) -> None:
        self.waiting.append(buckets)
        self.n += len(buckets)
        if self.n > 1 << 20:
            self._flush()

    def _flush(self) -> None:
        if self.n:
            self.table += np.bincount(np.concatenate(self.waiting), minlength=len(self.table))
        self.waiting, self.n = [], 0

    def blocks(self) -> Iterator[tuple[list[int], list[bytes]]]:
        """Numbers and compressed counts of the blocks that have any, a few at a time."""
        self._flush()
        blocks = self.table.reshape(-1, min(BLOCK, len(self.table)))
        used = np.flatnonzero(blocks.any(axis=1))
        for part in np.array_split(used, max(1, len(used) // 64)):
            yield part.tolist(), [zlib.compress(blocks[b].tobytes(), 1) for b in part]


def summed(blocks: DataFrame, bits: int) -> np.ndarray:
    """The table of 2**bits counts whose blocks (block, counts) tasks gave out.

    Each task adds up its blocks as they come; the table's size is bounded by ``bits``,
    so it may go to the driver and to all tasks.
    """
    size = min(BLOCK, 1 << bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(zlib.decompress(counts), np.int64)
                totals[block] = totals[block] + more if block in totals else more
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([zlib.compress(t.tobytes(), 1) for t in totals.values()], pa.binary())], names=["block", "counts"])

    table = np.zeros(1 << bits, np.int64).reshape(-1, size)
    for row in blocks.select("block", "counts").repartition("block").mapInArrow(add, "block long, counts binary").collect():
        table[row.block] = np.frombuffer(zlib.decompress(row.counts), np.int64)
    return table.reshape(-1)


def bucket_counts(rows: DataFrame, buckets_of, bits: int) -> np.ndarray:
    """How often each of 2**bits buckets occurs, over all rows; ``buckets_of`` gives a batch's buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(bits)
        for batch in batches:
            for b in buckets_of(batch):
                tally.add(b)
        for part, counts in tally.blocks():
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(counts, pa.binary())], names=["block", "counts"])

    return summed(rows.mapInArrow(count, "block long, counts binary"), bits)


class IdFilter:
    """A bit table of ids, of a bounded size: ids that were put in always pass, others rarely while it is sparse."""

    def __init__(self, ids: DataFrame, size: int):
        self.bits = min(24, max(16, (16 * size).bit_length()))
        self.table = np.packbits(bucket_counts(ids, lambda batch: [self.places(batch.column(0).to_numpy(zero_copy_only=False))], self.bits) > 0)

    def places(self, ids: np.ndarray) -> np.ndarray:
        x = ids.astype(np.int64).view(np.uint64) * STEP
        return ((x ^ (x >> np.uint64(29))) * STEP >> np.uint64(64 - self.bits)).astype(np.int64)

    def passes(self, ids: np.ndarray) -> np.ndarray:
        at = self.places(ids)
        return (self.table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def runs_of_equal(values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Indices, sorted by value and id, of the entries whose value occurs under two ids at least."""
    order = np.lexsort((ids, values))
    v, d = values[order], ids[order]
    if len(v) == 0:
        return order
    starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    ends = np.r_[starts[1:], len(v)]
    mixed = d[starts] != d[ends - 1]
    return order[np.repeat(mixed, ends - starts)]


def keep_shared(postings: DataFrame, partitions: int) -> DataFrame:
    """The postings (value, id, ...) whose value occurs under more than one id. All columns are long."""
    names = postings.columns

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([(n, pa.int64()) for n in names]))
        if table.num_rows == 0:
            return
        keep = runs_of_equal(table.column("value").to_numpy(), table.column("id").to_numpy())
        for at in range(0, len(keep), 50_000):
            yield from table.take(pa.array(keep[at : at + 50_000])).combine_chunks().to_batches()

    return postings.repartition(partitions, "value").mapInArrow(shared, ", ".join(f"{n} long" for n in names))


def parity_bits(s: np.ndarray, bits: int = 512) -> bytes:
    """For each bit, whether an odd number of the set's members falls on it.

    Two sets differ in at least as many members as their parity bits differ in bits.
    """
    odd = np.bincount((s >> np.uint64(33)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def hashed(column: str, seed: int):
    """A pseudo-random order of ids that changes with the seed."""
    return F.xxhash64(F.col(column), F.lit(seed))
