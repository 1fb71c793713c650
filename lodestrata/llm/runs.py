"""Periodic runs of words, by the runs theorem.

A run is a stretch of words with smallest period p, at least ``least_exponent`` periods
long, that cannot be extended with that period. By the theorem every run holds a root of
length p that is the longest Lyndon word starting at its place, in the order of the words
or in the reverse order. The longest Lyndon word at i ends before the next smaller value
of the inverse suffix array (the next greater one for the reverse order), so the roots
are at most two per word. Each is extended to both sides by longest common extensions:
range minima, from a sparse table, over the longest common prefixes of neighbours in the
suffix array, of the words and of the words reversed.

Numpy does each step for all texts of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import WORD, give_back, read

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
#: Words of the texts that are searched together; a longer text is searched alone.
TOGETHER = 100_000


def range_minima(v: np.ndarray) -> list[np.ndarray]:
    """Level k holds the least of each stretch of 2**k values."""
    levels = [v]
    while 2 * (1 << (len(levels) - 1)) <= len(v):
        last, half = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-half], last[half:]))
    return levels


def next_smaller(v: np.ndarray, at: np.ndarray, jumps: int = 24) -> np.ndarray:
    """For each place in ``at`` the next place with a smaller value, which must exist. Values are all different.

    Places jump along each other's candidates; what some jumps leave open descends
    through range minima.
    """
    out = np.arange(1, len(v) + 1)
    todo = at[v[out[at]] > v[at]]
    for _ in range(jumps):
        if not len(todo):
            break
        out[todo] = out[out[todo]]
        todo = todo[v[out[todo]] > v[todo]]
    if len(todo):
        to, least = out[todo], range_minima(v)
        for k in range(len(least) - 1, -1, -1):
            level = least[k]
            inside = to < len(level)
            to = to + ((inside & (level[np.where(inside, to, 0)] > v[todo])).astype(to.dtype) << k)
        out[todo] = to
    return out[at]


class Suffixes:
    """Suffix array of several texts, each closed by a letter of its own that is smaller than its words.

    ``letters``: 0 closes a text; words of a text are numbers from 1 to its length. No
    two texts share a letter, so that suffixes of different texts part at once.
    """

    def __init__(self, letters: np.ndarray, first: np.ndarray):
        n = len(letters)
        key = letters + first  # first: where the text of a place begins
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = self._starts(key[order])
        levels = [rank]
        todo = self._shared(rank, order)
        h = 1
        while len(todo):
            key = rank[todo] * n + rank[todo + h]
            by = np.argsort(key, kind="stable")
            todo, key = todo[by], key[by]
            old = rank[todo]
            within = self._starts(key) - self._starts(old)  # the group's old places are dealt in order
            rank = rank.copy()
            rank[todo] = old + within
            levels.append(rank)
            todo = self._shared(rank, todo)
            h *= 2
        self.rank = rank
        array = np.empty(n, np.int64)
        array[rank] = np.arange(n)
        a, b, common = array[:-1], array[1:], np.zeros(max(n - 1, 0), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            level = levels[k]
            common += (level[a + common] == level[b + common]).astype(np.int64) << k
        self.least = range_minima(common.astype(np.int32))

    @staticmethod
    def _starts(key: np.ndarray) -> np.ndarray:
        """For each entry of a sorted key the place of the first equal one."""
        new = np.r_[True, key[1:] != key[:-1]]
        return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))

    @staticmethod
    def _shared(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Of places in rank order those whose rank another place has."""
        r = rank[order]
        same = r[1:] == r[:-1]
        return order[np.r_[same, False] | np.r_[False, same]]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters the suffixes at ``a`` and at ``b``, different places, share."""
        lo, hi = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for level in np.unique(k):
            m = k == level
            out[m] = np.minimum(self.least[level][lo[m]], self.least[level][hi[m] - (1 << level)])
        return out


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts, each closed by 0; where each text begins; the text of each place."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    letters = np.zeros(int(sizes.sum()), np.int64)
    for at, t in zip(begin, texts):
        letters[at : at + len(t)] = t
    return letters, begin, np.repeat(np.arange(len(texts)), sizes)


def find_runs(texts: list[np.ndarray], least_length: int = 6, least_exponent: int = 4) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in that order. texts: words as numbers from 1 to the text's length."""
    none = np.empty((0, 4), np.int64)
    if not any(len(t) for t in texts):
        return none
    letters, begin, text = _joined(texts)
    suffixes = Suffixes(letters, begin[text])
    words = np.flatnonzero(letters)
    up = suffixes.rank
    down = np.where(letters > 0, -up, -len(up) - 1)  # the letter that closes a text ends each search
    roots = []
    for order in (up, down):
        to = next_smaller(order, words)
        again = letters[to] == letters[words]  # else nothing of the root recurs behind it
        a, b = words[again], to[again]
        right = suffixes.common(a, b)
        # the first root inside a run begins in its first period, so what recurs is at least so long
        far = right >= (least_exponent - 2) * (b - a)
        roots.append(np.stack([a[far], b[far], right[far]]))
    a, b, right = np.concatenate(roots, axis=1)
    if not len(a):
        return none
    some, which = np.unique(text[a], return_inverse=True)
    back, back_begin, back_text = _joined([texts[t][::-1] for t in some])
    turned = Suffixes(back, back_begin[back_text])
    # the word before place x of a text of n words is at n - x in the reversed text
    end = back_begin[which] + np.array([len(texts[t]) for t in some])[which] + begin[text[a]]
    left = np.zeros(len(a), np.int64)
    inner = a > begin[text[a]]
    left[inner] = turned.common((end - a)[inner], (end - b)[inner])
    period = b - a
    out = np.stack([text[a], a - left - begin[text[a]], left + period + right, period], axis=1)
    return np.unique(out[out[:, 2] >= np.maximum(least_length, least_exponent * period)], axis=0)


def _numbers(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array(list(map(known.setdefault, words, range(1, len(words) + 1))), np.int64)


def _kept(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([w for w, over in zip(words, np.cumsum(edge)) if not over])


def periodic_runs(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """id, runs, collapsed: one row per row of ``docs``.

    Words are what ASCII white space parts; the whole text is searched. ``runs`` holds
    (start, length, period), in words, of every run of at least ``least_length`` words and
    ``least_exponent`` periods (3 or more), by start and then period. ``collapsed`` is the
    text with one space between words and one period left of each run.

    Null and empty texts have no words: no runs and an empty ``collapsed``. Rows with a
    null id and rows that repeat an id are kept, each by itself; other columns are not
    read, whatever their names; an empty table gives no rows. A task holds the texts of
    one batch, and the index of about ``TOGETHER`` words or of one longer text: some
    hundred bytes a word.
    """
    if least_exponent < 3:
        raise ValueError("least_exponent must be 3 or more")

    def search(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = find_runs([_numbers(words) for words in texts], least_length, least_exponent)
        cut = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
        fields = [pa.array(found[:, k], pa.int64()) for k in (1, 2, 3)]
        runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        kept = [_kept(words, found[a:b, 1:]) for words, a, b in zip(texts, cut, cut[1:])]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for i, raw in zip(batch.column(0), batch.column(1)):
                words = (raw.as_py() or b"").split()
                if ids and held + len(words) > TOGETHER:
                    yield search(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i.as_py())
                texts.append(words)
                held += len(words)
            if ids:
                yield search(ids, texts)
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: in texts whose id's crc32 ends in 0 the words from some place on repeat the first of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    w, g = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.floor(h / 10)
    rows = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, w).alias("w")).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.transform(F.sequence("a", F.col("n") - 1), lambda i: F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark, planted(read(spark, sf_dir, "documents")))
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.withColumn("first", first)
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("first.start").alias("start"),
        F.col("first.length").alias("length"),
        F.col("first.period").alias("period"),
        F.floor(1000 * F.col("first.length") / F.col("first.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Checksums byte by byte, the rewritten words, equal words of a text at each distance, stretches of such pairs, and of those the ones that no shorter period explains. Columns that hold nulls are read as floats on both sides.
OP13_SQL = r"""
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
ids AS (SELECT DISTINCT doc_id, list_transform(regexp_extract_all(hex(doc_id::VARCHAR), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM ids, tab),
s AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents JOIN crc USING (doc_id)),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM s),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
r AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM p),
u AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM r),
m AS (SELECT l.doc_id, l.i, t.i - l.i AS q FROM u l JOIN u t ON l.doc_id = t.doc_id AND l.x = t.x AND t.i > l.i AND 4 * (t.i - l.i) <= l.n),
o AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM m),
c AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q AS period FROM o GROUP BY doc_id, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)),
f AS (SELECT * FROM c WHERE NOT EXISTS (FROM c y WHERE y.doc_id = c.doc_id AND y.period < c.period AND c.period % y.period = 0 AND y.start <= c.start AND y.start + y.length >= c.start + c.length)),
found AS (SELECT doc_id, count(*) AS n_runs, arg_max({'s': start, 'l': length, 'p': period}, (length, -start, -period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM f GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM f),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS words FROM u WHERE NOT EXISTS (FROM gone WHERE gone.doc_id = u.doc_id AND gone.i = u.i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s::DOUBLE AS start, best.l::DOUBLE AS length, best.p::DOUBLE AS period, (1000 * best.l // best.p)::DOUBLE AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM documents d LEFT JOIN found USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
