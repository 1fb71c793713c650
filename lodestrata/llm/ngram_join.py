"""Jaccard self-join of documents on word five-grams, by vertical partitioning.

Documents with equal sets of n-grams are one member of the join from the start, named
by a signature of the set. All n-grams stand in one global order, rare ones first.
The order comes from a count table over all documents, whose size follows from the
input up to a bound, so it is the same in every task.

1. A link needs a common n-gram in the first part of both sets (the prefix). The
   postings of these n-grams are dealt out by n-gram, and only those held by two
   members or more go on. Lists of frequent n-grams are cut into parts by a hash of
   the member, so no task holds a whole one.
2. Star round: in each part of a list the members are paired with one of them, the
   hub, and the hubs of a list with one of theirs: pairs stay in proportion to the
   list. Sizes, places in the order and parity bits rule out pairs that cannot link,
   and no others. A pair is settled exactly: the order is cut into fragments, each
   fragment counts the pair's partial overlap alone, and the sums per pair decide.
3. Linked members form components, which need no further pair. In later rounds each
   component tries its closest pairs by parity bits with others, as one link is
   enough to join two components. Rounds end when one finds no link.
4. All pairs across the components that are left, that share a posting and that the
   same bounds allow, are listed by pairs of parts and settled in the same way. So no
   link between components is lost, and the components are those of the full join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import Workspace, give_back, read, shuffle_partitions
from lodestrata.llm.graph import components, relabelled
from lodestrata.llm.shingles import STEP, IdFilter, Tally, pack, parity_bits, rows_of, set_signature, shingle_set, summed

#: Parity bits of every member, and the size from which a member has more: about one per n-gram.
PARITY = 512
#: Members of a part of a posting list, about.
PART = 2048
ROWS = 50_000


class Order:
    """The global n-gram order and its cuts into fragments of about equal mass."""

    def __init__(self, counts: np.ndarray, fragments: int):
        self.counts, self.mask = np.minimum(counts, 2**31 - 1).astype(np.int32), np.uint64(len(counts) - 1)
        ordered = np.sort(counts[counts > 0])
        mass = np.cumsum(ordered)
        at = [ordered[np.searchsorted(mass, mass[-1] * k // fragments)] for k in range(1, fragments)] if len(mass) else []
        self.cuts = np.unique(np.array(at, np.int64))
        self.usual = 2 * int(np.median(ordered)) if len(ordered) else 0

    def of(self, values: np.ndarray) -> np.ndarray:
        return self.counts[(values & self.mask).astype(np.int64)]

    def fragment(self, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, self.of(values), side="left")

    def parts(self, values: np.ndarray) -> np.ndarray:
        """Into how many parts a value's list is cut: it is about as long as its bucket's count is above the usual."""
        return np.maximum(1, -(-(self.of(values).astype(np.int64) - self.usual) // PART))


def table_bits(texts: DataFrame, least: int = 16, most: int = 23) -> int:
    """log2 of the buckets for a corpus: about one per 512 bytes of text, 8 million at most."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(most, max(least, (size // 512).bit_length()))


def _measured(texts: DataFrame, bits: int) -> DataFrame:
    """Two kinds of rows from one reading of the texts (id, text, mark).

    id, mark, n, signature and parity bits of each row; and, with a number in ``block``,
    counts of the documents that hold n-grams of each hash bucket.
    """
    names = ["id", "mark", "n", "sig", "bits", "parity", "block", "counts"]
    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), longs, longs, pa.int64(), pa.binary()]

    def rows(columns: list) -> pa.RecordBatch:
        size = max(len(c) for c in columns)
        return pa.RecordBatch.from_arrays([pa.array(c, k) if len(c) else pa.nulls(size, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, mask = Tally(bits), np.uint64((1 << bits) - 1)
        bit = lambda s, n: np.frombuffer(parity_bits(s, n), np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sets = [shingle_set(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for i, s in zip(ids, sets):
                if i is not None:
                    tally.add((s & mask).astype(np.int64))
            if ids:
                wide = [bit(s, 1 << (len(s) - 1).bit_length()) if len(s) > PARITY else None for s in sets]
                yield rows([ids, batch.column(2), [len(s) for s in sets], [set_signature(s) for s in sets], [bit(s, PARITY) for s in sets], wide, [], []])
        for part, counts in tally.blocks():
            if part:
                yield rows([[], [], [], [], [], [], part, counts])
        give_back()

    return texts.mapInArrow(run, "id long, mark long, n long, sig long, bits array<long>, parity array<long>, block long, counts binary")


def _prefixes(texts: DataFrame, order, percent: int) -> DataFrame:
    """value, part, id (signature), n (set size), p (place in the set's order) of each n-gram in a prefix.

    A task gives equal sets once, so copies do not swell the lists.
    """
    names, kinds = ["value", "part", "id", "n", "p"], [pa.int64()] * 5

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, out, rows, seen = order.value, [[] for _ in names], 0, set()
        for _, text in rows_of(batches):
            s = shingle_set(text)
            n, i = len(s), set_signature(s)
            if not n or i in seen:
                continue
            seen.add(i)
            m = n - -(-percent * n // 100) + 1
            first = s[np.lexsort((s, by.of(s)))[:m]]
            for c, x in zip(out, (first.view(np.int64), i % (1 << 32) % by.parts(first), np.full(m, i, np.int64), np.full(m, n, np.int64), np.arange(m, dtype=np.int64))):
                c.append(x)
            rows += m
            if rows > ROWS:
                yield pack(names, kinds, out)
                out, rows = [[] for _ in names], 0
        yield pack(names, kinds, out)
        give_back()

    return texts.mapInArrow(emit, "value long, part long, id long, n long, p long")


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    table = pa.Table.from_batches(list(batches), schema=pa.schema([(x, pa.int64()) for x in names]))
    return [table.column(x).to_numpy() for x in names]


def _sliced(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, max(len(columns[0]), 1), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + ROWS]) for c in columns], names=names)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start; keys are sorted."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


def _mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    x = (ids.view(np.uint64) + np.uint64((2 * seed + 1) * int(STEP) % 2**64)) * STEP
    return (x ^ (x >> np.uint64(31))) * STEP


def _with_hub(postings: DataFrame, order, partitions: int) -> DataFrame:
    """The postings of lists with two members or more, each with its part's hub: the member whose hash is least."""
    names = ["value", "part", "id", "n", "p"]
    out = [*names, "hub", "hn", "hp"]

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _columns(batches, names)
        value, part, ids = columns[:3]
        by = np.lexsort((ids, _mixed(ids, 0), part, value))
        columns = [c[by] for c in columns]
        columns = [c[_starts(*columns[:3])] for c in columns]
        value, part, ids, n, p = columns
        at = _starts(value, part)
        long = np.diff(np.r_[at, len(value)])
        keep = np.repeat((long > 1) | (order.value.parts(value[at].view(np.uint64)) > 1), long)
        hub = np.repeat(at, long)[keep]
        yield from _sliced([c[keep] for c in columns] + [ids[hub], n[hub], p[hub]], out)
        give_back()

    return postings.repartition(partitions, "value", "part").mapInArrow(shared, ", ".join(f"{c} long" for c in out))


def _star_pairs(shared: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """For each member its most promising hub, the one with the most common postings; and hubs of one list's parts with one of them."""
    low = shared.where("id != hub").select("id", "n", "p", "hub", "hn", "hp")
    hubs = shared.where("id = hub")
    tops = hubs.groupBy("value").agg(F.count("*").alias("c"), F.min_by(F.struct("id", "n", "p"), F.xxhash64("id")).alias("top")).where("c > 1")
    high = hubs.join(tops, "value").where("id != top.id").select("id", "n", "p", F.col("top.id").alias("hub"), F.col("top.n").alias("hn"), F.col("top.p").alias("hp"))
    pairs = low.unionByName(high).where(_may_link("n", "p", "hn", "hp", percent)).groupBy(F.col("id").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("c"))
    return _near(pairs, features, percent).groupBy("a").agg(F.max(F.struct("c", "b")).alias("best")).select("a", "best.b")


def _near(pairs: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parity bits allow a link, with ``differ``, a lower bound of their difference, and ``sizes``."""
    for c in ("a", "b"):
        own = features.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "bits", "parity")])
        pairs = pairs.join(own.hint("merge"), c)  # both sides grow with the corpus
    few = sum((F.bit_count(F.get("bits_a", k).bitwiseXOR(F.get("bits_b", k))) for k in range(PARITY // 64)), F.lit(0))
    fits = lambda d: (100 + percent) * d <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    differ = F.when(F.col("parity_a").isNotNull() & F.col("parity_b").isNotNull() & fits(few), _differ(F.col("parity_a"), F.col("parity_b"))).otherwise(few)
    pairs = pairs.withColumn("differ", differ).where(fits(F.col("differ"))).withColumn("sizes", F.col("n_a") + F.col("n_b"))
    return pairs.drop(*[f"{x}_{c}" for x in ("n", "bits", "parity") for c in "ab"])


def _differ(a: Column, b: Column) -> Column:
    """In how many bits two bit strings differ, the longer one folded to the shorter one's length if it is twice as long."""
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    one, two = F.when(F.size(a) > F.size(b), half(a)).otherwise(a), F.when(F.size(b) > F.size(a), half(b)).otherwise(b)
    return F.aggregate(F.zip_with(one, two, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _may_link(n: str, p: str, m: str, q: str, percent: int) -> str:
    """Whether sets of n and m n-grams whose first common one stands at p and q can link."""
    return f"(100 + {percent}) * least({n} - {p}, {m} - {q}) >= {percent} * ({n} + {m})"


def _bridges(lists: DataFrame, features: DataFrame, partitions: int, seed: int, percent: int, tries: int = 4, width: int = 4) -> DataFrame:
    """For each component its closest pairs by parity bits with others, one of each of ``tries`` random parts.

    Each part of a posting list stands in a pseudo-random order of its own, and members
    of different components up to ``width`` places apart are candidates: in proportion to
    postings, with other partners from list to list. One link joins two components
    whatever their sizes, so it is looked for before all pairs are.
    """
    names = ["value", "part", "id", "n", "p", "label"]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _columns(batches, names)
        value, part, ids = columns[:3]
        by = np.lexsort((ids, _mixed(ids ^ value, seed), part, value))
        value, part, ids, n, p, label = (c[by] for c in columns)
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)]
        for step in range(1, width + 1):
            x, y = slice(None, -step), slice(step, None)
            pair = (value[x] == value[y]) & (part[x] == part[y]) & (label[x] != label[y])
            pair &= (100 + percent) * np.minimum(n[x] - p[x], n[y] - p[y]) >= percent * (n[x] + n[y])
            at = np.flatnonzero(pair)
            swap = step * (ids[at] > ids[at + step])
            for c, v in zip(found, (ids[at + swap], ids[at + step - swap], label[at + swap], label[at + step - swap])):
                c.append(v)
        yield from _sliced([np.concatenate(c) for c in found], ["a", "b", "label_a", "label_b"])
        give_back()

    pairs = lists.select(*names).repartition(partitions, "value", "part").mapInArrow(chain, "a long, b long, label_a long, label_b long").distinct()
    pairs = _near(pairs, features, percent).withColumn("near", F.struct(F.col("differ") / F.col("sizes"), "a", "b"))
    ends = pairs.select("a", "b", "near", F.explode(F.array("label_a", "label_b")).alias("mine"))
    best = ends.groupBy("mine", F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(tries)).alias("try")).agg(F.min_by(F.struct("a", "b"), "near").alias("best"))
    return best.select("best.a", "best.b").distinct()


def _open(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The posting lists that hold several components, with each member's component."""
    rows = lists.select("value", "part", "id", "n", "p").join(labels.hint("merge"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    several = rows.groupBy("value").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("value")
    return rows.join(several.hint("merge"), "value", "left_semi")


def _merged(lists: DataFrame) -> DataFrame:
    """One list for all lists of the same members, such as those of one passage, with each member's least place.

    Should different lists share a signature, their union only adds candidates.
    """
    marks = lists.groupBy("value").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(99))).alias("y"))
    marks = marks.select("value", F.xxhash64("c", "x", "y").alias("members"))
    rows = lists.join(marks.hint("merge"), "value").groupBy("members", "id").agg(F.min("p").alias("p"), F.min("n").alias("n"), F.min("label").alias("label"))
    return rows.withColumnRenamed("members", "value")


def _cross_pairs(lists: DataFrame, features: DataFrame, partitions: int, percent: int) -> DataFrame:
    """All pairs of different components in a posting list that lengths, places and parity bits allow.

    A list is cut into parts of about ``PART`` members, and a task gets two parts at a
    time, so that each pair meets once and no task holds a long list.
    """
    long = lists.groupBy("value").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"))
    mine = F.pmod(F.xxhash64("id"), F.col("parts"))
    rows = lists.join(long, "value").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    rows = rows.join(features.select("id", "bits").hint("merge"), "id")
    names = ["value", "lo", "hi", "mine", "id", "n", "p", "label"]
    schema = pa.schema([(x, pa.int64()) for x in names] + [("bits", pa.list_(pa.int64()))])

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b.cast(schema) if b.schema != schema else b for b in batches], schema=schema)
        columns = [table.column(x).to_numpy() for x in names]
        bits = table.column("bits").combine_chunks().flatten().to_numpy().reshape(-1, PARITY // 64).view(np.uint64)
        by = np.lexsort((columns[4], columns[2], columns[1], columns[0]))
        value, lo, hi, mine, ids, n, p, label = (c[by] for c in columns)
        bits = bits[by]
        at = _starts(value, lo, hi)
        end = np.repeat(np.r_[at[1:], len(value)][: len(at)], np.diff(np.r_[at, len(value)])).astype(np.int64)
        here, step = np.arange(len(value)), 0
        held: list[np.ndarray] = [np.empty((0, 2), np.int64)]
        while len(here):
            step += 1
            here = here[here + step < end[here]]
            for k in range(0, len(here), ROWS):
                i = here[k : k + ROWS]
                j = i + step
                fits = (label[i] != label[j]) & ((lo[i] == hi[i]) | (mine[i] != mine[j])) & ((100 + percent) * np.minimum(n[i] - p[i], n[j] - p[j]) >= percent * (n[i] + n[j]))
                i, j = i[fits], j[fits]
                fits = (100 + percent) * np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= (100 - percent) * (n[i] + n[j])
                held.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1)[fits])
                if sum(map(len, held)) > ROWS:
                    yield _pairs(held)
                    held = held[:1]
        yield _pairs(held)
        give_back()

    pairs = rows.select(*names, "bits").repartition(partitions, "value", "lo", "hi").mapInArrow(cross, "a long, b long").distinct()
    return _near(pairs, features, percent).select("a", "b")


def _pairs(held: list[np.ndarray]) -> pa.RecordBatch:
    a = np.unique(np.concatenate(held), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def _segments(texts: DataFrame, order, wanted) -> DataFrame:
    """id (signature), n, fragment and its n-grams of the wanted documents: a set cut along the global order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = order.value
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(wanted.value.passes(batch.column(0).to_numpy())))
            ids, ns, fs, vs = [], [], [], []
            for _, text in rows_of([batch]):
                s = shingle_set(text)
                i, f = set_signature(s), by.fragment(s)
                for k in np.unique(f):
                    ids.append(i), ns.append(len(s)), fs.append(int(k)), vs.append(s[f == k].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(fs, pa.int64()), pa.array(vs, pa.list_(pa.int64()))], names=["id", "n", "fragment", "grams"])
        give_back()

    return texts.mapInArrow(cut, "id long, n long, fragment long, grams array<long>")


def _settle(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: partial overlaps per fragment, summed per pair."""
    left = segments.select(F.col("id").alias("a"), F.col("n").alias("na"), "fragment", F.col("grams").alias("ga"))
    right = segments.select(F.col("id").alias("b"), F.col("n").alias("nb"), "fragment", F.col("grams").alias("gb"))
    both = pairs.select("a", "b").hint("merge").join(left, "a").join(right.hint("merge"), ["b", "fragment"])  # both sides grow with the corpus
    part = both.select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("ga", "gb")).alias("part"))
    part = part.groupBy("a", "b", "fragment").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("part").alias("part"))  # rows that repeat an id
    whole = part.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("part").alias("both"))
    return whole.where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


class _Join:
    """One join: what all its rounds read."""

    def __init__(self, ws: Workspace, texts: DataFrame, features: DataFrame, order, percent: int):
        self.ws, self.texts, self.features, self.order, self.percent = ws, texts, features, order, percent
        self.labels: DataFrame | None = None

    def links(self, pairs: DataFrame, label: str) -> bool:
        """Settles the pairs and puts the components that links join under one label. False if there was none."""
        pairs = self.ws.table(pairs, label)
        ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        rows = self.features.join(ends, "id", "left_semi").select("least")
        size = rows.count()
        if not size:
            return False
        wanted = self.ws.spark.sparkContext.broadcast(IdFilter(rows, size))
        segments = self.ws.table(_segments(self.texts, self.order, wanted), "segments")
        links = self.ws.table(_settle(pairs, segments, self.percent), "links")
        self.ws.drop(segments, pairs)
        if links.isEmpty():
            return False
        old, self.labels = self.labels, relabelled(self.ws, self.labels, links)
        self.ws.drop(links, *([old] if old is not None else []))
        return True


def link_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, rounds: int = 3, fragments: int = 4) -> DataFrame:
    """id, mark, n, component of each row of ``docs``.

    n is the size of the row's set, and component the least id reachable by links, its
    own included; mark is a hash of the text, by which rows that repeat an id can be told apart.

    A document's set holds its distinct five-word n-grams (A-Z lower-cased); fewer
    words count as one n-gram; null or blank texts have none and link with nothing.
    Rows with a null id take no part and have no component. Rows that repeat an id are
    documents of their own, with their own texts. Very long texts are cut along the
    order like any other. Hashes of 64 bits stand for n-grams and for equal sets. Other
    columns are not read; an empty table gives no rows.
    """
    ws = Workspace(spark, "ngram-join")
    parts = shuffle_partitions(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
    bits = table_bits(texts)
    measured = ws.table(_measured(texts, bits), "measured")
    rows = measured.where("block IS NULL").select("id", "mark", "n", "sig")
    counts = summed(measured.where("block IS NOT NULL").select("block", "counts"), bits)
    order = spark.sparkContext.broadcast(Order(counts, fragments))
    sets = measured.where("block IS NULL AND id IS NOT NULL AND n > 0").groupBy(F.col("sig").alias("id")).agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("parity").alias("parity"))
    features = ws.table(sets, "features")
    join = _Join(ws, texts.select("id", "text"), features, order, percent)
    lists = ws.table(_with_hub(_prefixes(join.texts, order, percent), order, parts), "shared")
    found = join.links(_star_pairs(lists, features, percent), "star")
    for r in range(1, rounds + 1):
        if join.labels is None:
            labels = features.limit(0).select("id", F.col("id").alias("label"))
        else:
            labels = join.labels
        if r == 1 or found:
            new = ws.table(_open(lists, labels), "open")
            ws.drop(lists)
            lists = new
        if r == rounds or not found:
            break
        found = join.links(_bridges(lists, features, parts, r, percent), "bridges")
    join.links(_cross_pairs(_merged(lists), features, parts, percent), "cross")
    ws.drop(lists)
    own = features.select("id", "least")
    if join.labels is None:
        component = own.select("id", F.col("least").alias("component"))
    else:
        own = own.join(join.labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        least = own.groupBy("label").agg(F.min("least").alias("component"))
        component = own.join(least, "label").select("id", "component")
    out = rows.join(component.withColumnRenamed("id", "sig"), "sig", "left")
    return out.select("id", "mark", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = link_components(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


#: Sets by a recursive walk over links; a link is found through common shingles.
OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - 3, 2)), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) END AS grams FROM w
), d AS (SELECT doc_id, coalesce(len(grams), 0)::BIGINT AS n, hash(list_sort(grams)) AS h FROM s),
g AS (SELECT DISTINCT h, n, hash(unnest(grams)) AS gram FROM s JOIN d USING (doc_id)),
pairs AS (SELECT x.h AS a, y.h AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.h < y.h AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 80 * (na + nb - c) UNION ALL SELECT b, a FROM pairs WHERE 100 * c >= 80 * (na + nb - c)),
reach AS (SELECT DISTINCT h AS a, h AS b FROM d WHERE n > 0 UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT reach.a, min(doc_id) AS component_id FROM reach JOIN d ON d.h = reach.b AND d.n > 0 GROUP BY reach.a)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id FROM d LEFT JOIN least ON least.a = d.h AND d.n > 0
"""
