"""Periodic runs, quality scores and hard negatives against brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import hard_negatives as H
from lodestrata.llm import quality as Q
from lodestrata.llm import runs as R

SMALL = "/root/testdata/sf0.001"


# --- runs


def all_runs(w, least_length=6, exponent=4):
    """Every stretch tried at every period, shorter periods first."""
    out = []
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > s and i + p - s >= max(least_length, exponent * p) and not any(p % q == 0 and a <= s and s + (i + p - s) <= a + n for a, n, q in out):
                out.append((s, i + p - s, p))
            i += 1
    return sorted(out)


def collapsed(w, runs):
    return " ".join(x for k, x in enumerate(w) if not any(s + p <= k < s + n for s, n, p in runs))


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from("ab"), max_size=40), min_size=1, max_size=5), exponent=st.sampled_from([3, 4]))
def test_runs_of_two_words_are_those_of_brute_force(texts, exponent):
    found = R.find_runs([R._numbers([x.encode() for x in t]) for t in texts], 6, exponent)
    for k, t in enumerate(texts):
        assert [tuple(map(int, r[1:])) for r in found[found[:, 0] == k]] == all_runs(t, 6, exponent)


def test_runs_of_texts_with_planted_repeats():
    rng = random.Random(3)
    texts = []
    for _ in range(300):
        w = [f"w{rng.randrange(9)}" for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(w) + 1), rng.randint(1, 9)
            w[at:at] = [f"w{rng.randrange(4)}" for _ in range(p)] * rng.randint(3, 6)
        texts.append(w)
    found = R.find_runs([R._numbers([x.encode() for x in t]) for t in texts])
    assert len(found) > 100
    for k, t in enumerate(texts):
        assert [tuple(map(int, r[1:])) for r in found[found[:, 0] == k]] == all_runs(t)


@pytest.mark.parametrize("words", [["a"] * 100_000, [str(k) for k in range(100_000)], [f"{k:06}" for k in range(100_000, 0, -1)], ["a", "b", "c"] * 33_000])
def test_long_texts_of_one_shape(words):
    p = len(set(words))
    expected = [] if p > 3 else [(0, len(words), p)]
    assert [tuple(map(int, r[1:])) for r in R.find_runs([R._numbers([w.encode() for w in words])])] == expected


def test_next_smaller_descends_where_jumps_do_not_reach():
    rng = np.random.default_rng(1)
    v = np.r_[0, np.arange(500, 100, -1), 1 + rng.permutation(100), -1]
    at = np.arange(len(v) - 1)
    expected = [next(j for j in range(i + 1, len(v)) if v[j] < v[i]) for i in at]
    for jumps in (0, 2, 24):
        assert R.next_smaller(v, at, jumps).tolist() == expected


def test_runs_of_awkward_rows(spark):
    long = "x y z " * 60_000 + "end"
    rows = [(1, None, "t"), (2, "", "t"), (3, " \t\n", "t"), (4, "a a a a a a", "t"), (4, "b", "t"), (None, "no\x0bno\fno no no no no", "t"), (5, long, "t"), (6, "           ", "t"), (7, "a a a a a", "t")]
    df = spark.createDataFrame([(i, t, o, o, o) for i, t, o in rows], "doc_id long, text string, id string, runs string, raw string")
    out = sorted((r.id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in R.periodic_runs(spark, df).collect())
    assert out == sorted([(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 6, 1)], "a"), (4, [], "b"), (0, [(0, 7, 1)], "no"), (5, [(0, 180_000, 3)], "x y z end"), (6, [(0, 6, 1)], " "), (7, [], "a a a a a")])
    assert R.periodic_runs(spark, df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.periodic_runs(spark, df, least_exponent=2)


def test_the_query_is_brute_force_over_the_whole_table(spark):
    docs = pd.DataFrame([r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()])
    got = {r.doc_id: r for r in R.op13_runs(spark, SMALL).collect()}
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got.values()) > 10
    for i, text in zip(docs["doc_id"], docs["text"]):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = all_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()


# --- quality


def test_scores_are_those_of_the_two_densities(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    stats = {i: Q.statistics(t.encode()) for i, t in texts.items()}
    learned = [i for i in marks if i in texts and zlib.crc32(str(i).encode()) % 5]
    x, y = np.stack([stats[i] for i in learned]), np.array([marks[i] for i in learned])
    d, logs = x.shape[1], []
    both = sum(len(x[y == c]) * np.cov(x[y == c].T, bias=True) for c in (0, 1)) / len(x)
    for c in (0, 1):
        of = x[y == c]
        lean = max(0.1, d / (len(of) + d))
        cov = (1 - lean) * np.cov(of.T, bias=True) + lean * both
        cov = 0.98 * cov + 0.02 * np.trace(cov) / d * np.eye(d)
        z = np.stack([stats[i] for i in texts]) - of.mean(axis=0)
        logs.append(np.log(len(of) / len(x)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    expected = dict(zip(texts, 1 / (1 + np.exp(-np.clip(0.25 * (logs[1] - logs[0]), -500, 500)))))
    got = {r.id: r.score for r in Q.quality(spark, docs, labels).collect()}
    assert got.keys() == expected.keys()
    assert max(abs(got[i] - expected[i]) for i in got) < 1e-6


def test_quality_on_rows_it_has_not_seen(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = Q.op12_quality(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").toPandas()
    good, bad = out[out["quality"] == 1], out[out["quality"] == 0]
    assert len(good) > 50 and len(bad) > 8
    assert (good["predicted"] == 1).mean() >= 0.98 and (bad["predicted"] == 0).mean() >= 0.95
    assert np.mean([(bad["score"] < s).mean() for s in good["score"]]) >= 0.99


def test_quality_of_awkward_rows(spark):
    good = "The quiet river runs along the old road, and people walk there. "
    rows = [(k, good * (1 + k % 7)) for k in range(40)] + [(100 + k, "BUY!! NOW!! ### " * (1 + k % 7)) for k in range(40)]
    rows += [(200, None), (201, ""), (None, good), (1, good), (202, good * 20_000), (203, "\x00中")]
    docs = spark.createDataFrame([(i, t, "o", "o", "o") for i, t in rows], "doc_id long, text string, id string, score string, stats string")
    marks = spark.createDataFrame([(k, 1) for k in range(40)] + [(100 + k, 0) for k in range(40)] + [(1, 0), (None, 0), (2, None), (9999, 1)], "doc_id long, quality int")
    out = Q.quality(spark, docs, marks).select("id", "score").collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.id: r.score for r in out}
    assert by[3] > 0.9 and by[103] < 0.1
    assert Q.quality(spark, docs.limit(0), marks).count() == 0
    for some, score in ((marks.limit(0), 0.0), (marks.where("quality = 1"), 1.0), (marks.where("quality = 0"), 0.0)):
        assert {r.score for r in Q.quality(spark, docs, some).collect()} == {score}


# --- hard negatives


def brute(rows, anchors, positives=5, negatives=3):
    """(anchor, positive, rank, negative, positive score, negative score) by sorting all pairs."""
    out = []
    for a, (la, va) in anchors.items():
        scored = [(int(np.dot(va, v)), i, lb) for i, lb, v in rows if i != a and len(v) == len(va)]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for s, i, _ in [x for x in scored if x[2] == la][:positives]:
            fits = [x for x in scored if x[2] != la and 50 * s <= 100 * x[0] <= 95 * s][:negatives]
            out += [(a, i, r, j, s, t) for r, (t, j, _) in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows, anchors, **kw):
    frame = lambda x: spark.createDataFrame([(i, lb, [float(c) for c in v]) for i, lb, v in x] or [], "id long, label int, v array<double>")
    out = H.hard_negatives(spark, frame(rows), frame([(a, *x) for a, x in anchors.items()]), **kw)
    return sorted(tuple(map(int, r)) for r in out.collect())


@pytest.mark.parametrize("shape", ["clusters", "sphere", "ties"])
def test_negatives_are_those_of_all_pairs(spark, shape):
    rng = np.random.default_rng(7)
    n, d = 600, 8
    x = rng.standard_normal((n, d)) + (6 * rng.standard_normal((12, d))[rng.integers(0, 12, n)] if shape == "clusters" else 0)
    v = np.floor((2 if shape == "ties" else 64) * x).astype(int)
    if shape == "ties":
        v[100:300] = v[100]
    rows = [(i, int(rng.integers(0, 4)), v[i]) for i in range(n)]
    anchors = {i: (rows[i][1], rows[i][2]) for i in range(0, n, 20)}
    expected = brute(rows, anchors)
    assert len(expected) > 50
    assert found(spark, rows, anchors, list_rows=16) == expected
    # lists in parts, visitors in waves
    assert found(spark, rows, anchors, list_rows=64, task_rows=8) == expected


def test_far_lists_are_not_visited():
    rng = np.random.default_rng(2)
    centres = 50 * rng.standard_normal((40, 16))
    x = np.repeat(centres, 25, axis=0) + rng.standard_normal((1000, 16))
    c = H.k_means(x, 40)
    near, far = H.nearest(x, c)
    lists = np.array([(k, 0, far[near == k].max(), 1) for k in range(len(c))])
    least, most = H.Directory({16: c}, {16: lists}).bounds(16, x[:50])
    score = x[:50] @ x.T
    for k in range(len(c)):
        assert (score[:, near == k] <= most[:, [k]]).all() and (score[:, near == k] >= least[:, [k]]).all()
    fifth = np.sort(score, axis=1)[:, -5]
    assert (most >= fifth[:, None]).sum() < 0.3 * most.size


def test_negatives_of_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [4.0, 4.0]), (1, 1, [4.0, 3.0]), (1, 1, [4.0, 3.0]), (2, 2, [3.0, 3.0]), (2, 2, [3.0, 3.0]), (3, 2, [2.0, 2.0]), (4, 3, [3.0, 2.0]), (5, 1, [-4.0, -4.0]), (0, 2, [3.0, 3.0])]
    bad = [(None, 1, [4.0, 4.0]), (6, None, [4.0, 4.0]), (7, 1, None), (8, 1, []), (9, 1, [4.0, None]), (10, 1, [inf, 1.0]), (11, 1, [nan, 1.0])]
    other = [(12, 1, [9.0, 9.0, 9.0]), (13, 2, [1.0])]
    schema = "id long, label int, v array<double>, bucket string, anchor string, rank string"
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows + bad + other], schema)
    out = sorted(tuple(r) for r in H.hard_negatives(spark, df, df.where("id = 0 OR id > 5")).collect())
    # anchor 0 is asked with its least label; positives 1, 1 (28) and 5 (-32); windows 14 to 26.6
    assert out == sorted([(0, 1, r, n, 28.0, s) for _ in range(2) for r, n, s in ((1, 2, 24.0), (2, 2, 24.0), (3, 4, 20.0))])
    assert H.hard_negatives(spark, df.limit(0), df).count() == 0
    assert H.hard_negatives(spark, df, df.limit(0)).count() == 0


def test_negatives_query_takes_the_whole_table(spark):
    out = H.op11_hard_negatives(spark, SMALL)
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    label = lambda r: (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
    rows = [(r.vec_id, label(r), np.floor(256 * np.array(r.embedding, np.float64)).astype(int)) for r in table]
    expected = brute(rows, {i: (lb, v) for i, lb, v in rows if i % 50 == 0})
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, out.collect())) == expected and expected
