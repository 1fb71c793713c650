"""Byte-pair encoding and decoding of whole texts with a public word-end vocabulary.

A word's merges run on a segment tree over the ranks of its adjacent pairs: the
root holds the lowest rank, and of equal ranks the leftmost pair. A merge changes
three leaves, each in logarithmic time, until the root shows that no pair merges.
Words recur, so each task remembers a bounded number of encoded words, those that came
before. New words of a few texts are merged side by side, each in a row of one table of
such trees.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import read, small

NONE = 1 << 62
#: Marks of words that came before; a word whose mark another has set is only remembered sooner.
MARKS = 1 << 20
#: The word split of this vocabulary (fixed values), for any text and for pure ASCII.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z]+|[0-9]|[^ \t-\ra-zA-Z0-9]+")


# What newer Unicode versions add to the Python modules used here. Letters and numbers of version 17, which
# the vocabulary's split takes for signs, and letters of 16 and 17 with the distance to their lower case.
SIGNS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F "
    "12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LOWER = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27)]
# End of fixed values.


@functools.cache
def newer() -> tuple[np.ndarray, dict[int, int], regex.Pattern]:
    """For texts with such letters: which code points they are, a table that lower-cases them, and the split."""
    spans = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in SIGNS.split())
    lower = {x: x + d for a, b, d in LOWER for x in range(a, b + 1)}
    split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{spans}]]+|[\p{{N}}--[{spans}]]|(?:[^\s\p{{L}}\p{{N}}]|[{spans}])+", regex.V1)
    marked = np.zeros(0x110000, bool)
    marked[list(lower)] = True
    for r in SIGNS.split():
        ends = [int(x, 16) for x in r.split("-")]
        marked[ends[0] : ends[-1] + 1] = True
    return marked, lower, split


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class RankTree:
    """Minimum over leaves of rank * size + position: the lowest rank, and of equal ranks the leftmost."""

    def __init__(self, ranks: list[int]):
        size = self.size = 1 << (len(ranks) - 1).bit_length()
        tree = [NONE] * size
        tree += [NONE if r == NONE else r * size + i for i, r in enumerate(ranks)]
        tree += [NONE] * (2 * size - len(tree))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.tree = tree

    def set(self, i: int, rank: int) -> None:
        tree, size = self.tree, self.size
        at = size + i
        tree[at] = NONE if rank == NONE else rank * size + i
        while at > 1:
            a, b = tree[at], tree[at ^ 1]
            at >>= 1
            if b < a:
                a = b
            if tree[at] == a:
                return
            tree[at] = a

    def lowest(self) -> int:
        """Position of the leftmost pair of lowest rank, or -1."""
        return -1 if self.tree[1] == NONE else self.tree[1] % self.size


class RankTrees:
    """A ``RankTree`` of one size for each word, one a row."""

    def __init__(self, ranks: np.ndarray):
        words, size = ranks.shape
        self.size, self.tree = size, np.full((words, 2 * size), NONE)
        self.tree[:, size:] = np.where(ranks == NONE, NONE, ranks * size + np.arange(size))
        while size > 1:
            size >>= 1
            self.tree[:, size : 2 * size] = np.minimum(self.tree[:, 2 * size : 4 * size : 2], self.tree[:, 2 * size + 1 : 4 * size : 2])

    def set(self, rows: np.ndarray, i: np.ndarray, ranks: np.ndarray) -> None:
        flat, at = self.tree.reshape(-1), rows * (2 * self.size)
        node = self.size + i
        flat[at + node] = np.where(ranks == NONE, NONE, ranks * self.size + i)
        for _ in range(self.size.bit_length() - 1):
            node >>= 1
            below = at + 2 * node
            flat[at + node] = np.minimum(flat[below], flat[below + 1])

    def lowest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows in which a pair merges, the leftmost pair of lowest rank, and that rank."""
        rows = np.flatnonzero(self.tree[:, 1] != NONE)
        return rows, self.tree[rows, 1] % self.size, self.tree[rows, 1] // self.size


class Bpe:
    """Encoder and decoder for a vocabulary file with word-end marks; plain data, so it can be broadcast."""

    def __init__(self, path: str, remember: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        self.token = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.rank, self.made = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        pairs = np.array(list(self.rank), np.int64)
        self.order = pairs.argsort()
        self.pairs, self.products = pairs[self.order], np.array(self.made, np.int64)
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.remember = remember
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        self.fresh: dict[str, tuple[bytes, str]] = {}  # words of the texts in hand that came for the first time
        self.came = bytearray()

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        n = len(ids)
        if n == 1:
            return ids
        rank = self.rank.get
        tree = RankTree([rank(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (i := tree.lowest()) >= 0:
            j = after[i]
            new = ids[i] = self.made[rank(ids[i] << 20 | ids[j])]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                tree.set(j, NONE)
                tree.set(i, rank(new << 20 | ids[k], NONE))
            else:
                tree.set(i, NONE)
            h = before[i]
            if h >= 0:
                tree.set(h, rank(ids[h] << 20 | new, NONE))
        return [x for x in ids if x >= 0]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where the pair does not merge or an id is -1."""
        keys = a << 20 | b
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.order[at], NONE)

    def many_ids(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Each word with its ids, as ``word_ids`` gives them, in any order."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode()
            by_size.setdefault(1 << max(len(raw) - 2, 0).bit_length(), []).append((w, raw))
        inner, last = np.array(self.inner), np.array(self.last)
        for size, group in by_size.items():
            n = np.array([len(raw) for _, raw in group])
            raw = np.frombuffer(b"".join(raw for _, raw in group), np.uint8)
            ids = np.full((len(group), size + 2), -1)
            ids[np.arange(size + 2) < n[:, None]] = inner[raw]
            ids[np.arange(len(group)), n - 1] = last[raw[n.cumsum() - 1]]
            after, before = (np.tile(np.arange(d, size + 2 + d), (len(group), 1)) for d in (1, -1))
            trees = RankTrees(self.ranks(ids[:, :size], ids[:, 1 : size + 1]))
            while True:
                rows, i, rank = trees.lowest()
                if not len(rows):
                    break
                new, j = self.products[rank], after[rows, i]
                k = after[rows, j]
                ids[rows, i], ids[rows, j], after[rows, i] = new, -1, k
                inside = k < n[rows]
                before[rows[inside], k[inside]] = i[inside]
                trees.set(rows[inside], j[inside], np.full(int(inside.sum()), NONE))
                trees.set(rows, i, self.ranks(new, ids[rows, k]))
                h = before[rows, i]
                left = h >= 0
                trees.set(rows[left], h[left], self.ranks(ids[rows[left], h[left]], new[left]))
            yield from zip((w for w, _ in group), ([x for x in row if x >= 0] for row in ids.tolist()))

    def learn(self, words: set[str]) -> None:
        """Encodes the words that are not known yet; a few, or long ones, are left to be encoded one by one."""
        new = [w for w in words.difference(self.young) if w not in self.old and len(w) <= 64]
        if len(new) < 32:
            return
        for at in range(0, len(new), 4096):
            for w, ids in self.many_ids(new[at : at + 4096]):
                out = struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)
                if not self.keep(w, out) and len(self.fresh) < self.remember:
                    self.fresh[w] = out

    def keep(self, word: str, out: tuple[bytes, str]) -> bool:
        """Remembers a word that came before: most words of junk never come again."""
        if not self.came:
            self.came = bytearray(MARKS)
        mark = hash(word) % MARKS
        if not self.came[mark]:
            self.came[mark] = 1
            return False
        # two generations: words that recur move on, the rest is forgotten
        if len(self.young) >= self.remember:
            self.young, self.old, self.came = {}, self.young, bytearray()
        self.young[word] = out
        return True

    def encoded(self, word: str) -> tuple[bytes, str]:
        """A word's ids as little-endian 32-bit integers, and its tokens as text."""
        if (out := self.young.get(word)) is None and (out := self.fresh.get(word)) is None:
            if (out := self.old.get(word)) is None:
                ids = self.word_ids(word)
                out = struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)
            if len(word) <= 64:
                self.keep(word, out)
        return out

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return SPLIT_ASCII.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # lower case letter by letter: str.lower would look at a sigma's neighbours
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        marked, lower, split = newer()
        some = marked[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any()
        return split.findall(text.translate(lower)) if some else SPLIT.findall(text)

    def parts(self, text: str | None) -> list[str | list[str]]:
        """Marks of the vocabulary, and between them lists of words."""
        text = text or ""
        parts = [text]
        if any(s in text for s in self.special):
            parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
        return [p if p in self.special else self.words(p) for p in parts]

    def joined(self, parts: list[str | list[str]]) -> tuple[bytes, str]:
        packed, tokens = [], []
        known, encoded = self.young.get, self.encoded
        for part in parts:
            if isinstance(part, str):
                packed.append(struct.pack("<I", self.special[part])), tokens.append(part)
            else:
                done = [known(w) or encoded(w) for w in part]
                packed += [d[0] for d in done]
                tokens += [d[1] for d in done]
        return b"".join(packed), " ".join(tokens)

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """The whole text's ids as little-endian 32-bit integers, and the decoded text. Marks of the vocabulary are split off first."""
        return self.joined(self.parts(text))

    def encode_all(self, texts: list[str | None], words: int = 50_000) -> Iterator[tuple[bytes, str]]:
        """As ``encode`` for each text, but texts of about so many words learn their new words together."""
        waiting, new, held = [], set(), 0
        for k, text in enumerate(texts):
            waiting.append(self.parts(text))
            for part in waiting[-1]:
                if not isinstance(part, str):
                    new.update(part)
                    held += len(part)
            if held > words or k + 1 == len(texts):
                self.learn(new)
                yield from map(self.joined, waiting)
                waiting, new, held = [], set(), 0
                self.fresh.clear()

    def decode(self, ids: list[int]) -> str:
        """Tokens parted by spaces, as the vocabulary names no decoder of its own."""
        return " ".join(self.token[i] for i in ids)


def encode_texts(spark: SparkSession, docs: DataFrame, vocabulary: str, text_col: str = "text", remember: int = 200_000, keep_text: bool = True) -> DataFrame:
    """Adds ``ids`` (little-endian unsigned 32-bit token ids of the whole text) and ``decoded`` to each row.

    Null counts as empty, and an empty text has no ids. Very long texts and words are
    encoded whole; repeated rows stay repeated; an empty table gives none. The input's
    columns stay as they are, even where they are named ``ids`` or ``decoded``: then
    the new ones replace them. Without ``keep_text`` the text itself is left out and
    doesn't travel back from Python. A worker remembers twice ``remember`` encoded words
    at most (some 350 bytes each), which saves time and changes no result.
    """
    model = spark.sparkContext.broadcast(Bpe(vocabulary, remember))  # as large as the vocabulary file, whatever the input
    rest = [c for c in docs.columns if c not in ("ids", "decoded")]
    at = rest.index(text_col)
    stay = [k for k, c in enumerate(rest) if keep_text or c != text_col]
    names = [*(rest[k] for k in stay), "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model.value
        for batch in small(batches):
            done = list(bpe.encode_all(batch.column(at).to_pylist()))
            columns = [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in stay), *columns], names=names)

    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[rest[k]] for k in stay] + [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return docs.select(*rest).mapInArrow(run, schema)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_texts(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), word_vocabulary(), keep_text=False)
    return out.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
