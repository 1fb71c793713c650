"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Among all document rates between 0 and
the most copies allowed, those are chosen that keep the most entropy, weighed by a
document's size plus its source's mean size, and meet the targets. By duality a rate
is an exponential tilt of the document's share a = size / (size + mean size):
rate = most / (1 + (most - 1) * exp(-lambda * a)), 1 at lambda = 0, with one
multiplier lambda per source. Newton's method solves the dual; a step sums gradient
and curvature over a histogram of sizes with Spark and updates all multipliers.
Rates become whole copies by carrying the rounding error from the largest size of a
source to the smallest, so a source's words end near its target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import WORD, Workspace, read, shuffle_partitions
from lodestrata.llm.prefix import with_prefix

WEIGHTS = (3, 1, 2)


def word_count(text_col: str) -> F.Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), 1)), F.lit(0)).cast("long")


def targets(spark: SparkSession, ws: Workspace, sources: DataFrame, percent: int, most: int) -> DataFrame:
    """src, source_size, target. ``sources``: src (a struct that sorts as wanted) and source_size.

    Sources share ``percent`` of all sizes by weight; none takes more than ``most``
    times its size, and the rest goes to the others by weight. Sorted by the factor at
    which a source is full, all sources up to some point are full, and the others
    share what these leave: prefix sums find that point.
    """
    ranked = with_prefix(spark, ws, sources, ["src"], []).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    ranked = ws.table(ranked.drop("rank").withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("full_at", F.col("cap") / F.col("weight")), "sources")
    total = ranked.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    share, weights = (total.s or 0) * percent / 100, total.w or 0.0
    ordered = ws.table(with_prefix(spark, ws, ranked, ["full_at", "src"], ["cap", "weight"]), "ordered")
    level = (share - F.col("before_cap")) / (F.lit(weights) - F.col("before_weight"))
    open_ = ordered.where(F.col("full_at") > level).orderBy("rank").select(level.alias("level")).first()
    level = open_.level if open_ is not None else float("inf")
    return ordered.select("src", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def _rate(most: int) -> F.Column:
    tilt = F.exp(-F.greatest(F.least(F.col("lam") * F.col("a"), F.lit(500.0)), F.lit(-500.0)))
    return F.when(F.col("full"), F.lit(float(most))).otherwise(most / (1 + (most - 1) * tilt))


def multipliers(ws: Workspace, histogram: DataFrame, sources: DataFrame, most: int, rounds: int = 200, near: float = 1e-6) -> DataFrame:
    """src, full, lam: Newton's iterations on the dual, for all sources at once.

    ``histogram``: src, size, a, n. A step that would leave the interval known to hold
    the root is halved into it, so the iterations end; should they not in ``rounds``, that
    is an error. A source whose target is all copies is full: its multiplier would be
    infinite.
    """
    state = sources.select("src", "target", (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("full"), F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"))
    state = ws.table(state, "multipliers")
    for _ in range(rounds):
        r = _rate(most)
        sums = histogram.join(state, "src").groupBy("src").agg(F.sum(F.col("n") * F.col("size") * r).alias("got"), F.sum(F.col("n") * F.col("size") * F.col("a") * r * (1 - r / most)).alias("slope"))
        step = state.join(sums, "src").withColumn("lo", F.when(F.col("got") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("got") > F.col("target"), F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") + (F.col("target") - F.col("got")) / F.greatest("slope", F.lit(1e-12))
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        bounded = F.when(inside, newton).when((F.col("hi") < 1e6) & (F.col("lo") > -1e6), (F.col("lo") + F.col("hi")) / 2).otherwise(F.col("lam") * 2 + F.signum(F.col("target") - F.col("got")))
        done = F.col("full") | (F.abs(F.col("got") - F.col("target")) <= near * F.greatest("target", F.lit(1.0)))
        new = ws.table(step.select("src", "target", "full", F.when(done, F.col("lam")).otherwise(bounded).alias("lam"), "lo", "hi", done.alias("done")), "multipliers")
        settled = new.where("NOT done").isEmpty()
        ws.drop(state)
        state = new.drop("done")
        state._written_at = new._written_at
        if settled:
            return state.select("src", "full", "lam")
    raise RuntimeError(f"the multipliers did not settle in {rounds} rounds")


def _carry(most: int):
    def copies(pdf: pd.DataFrame) -> pd.DataFrame:
        """Copies of each size, from the largest on; what rounding leaves goes to the next size."""
        pdf = pdf.sort_values("size", ascending=False)
        size, n, rate = (pdf[c].to_numpy() for c in ("size", "n", "rate"))
        out, owed = np.zeros(len(pdf), np.int64), 0.0
        for i in range(len(pdf)):
            owed += size[i] * n[i] * rate[i]
            if size[i] > 0:
                out[i] = min(max(round(owed / size[i]), 0), most * n[i])
                owed -= float(out[i] * size[i])
        return pdf.assign(copies=out)[["src", "size", "n", "copies"]]

    return copies


def mix(spark: SparkSession, docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", percent: int = 150, most: int = 2) -> DataFrame:
    """doc (a row of ``docs`` as a struct), size, source_size, target and copies (0 to ``most``), one row per document.

    A document's size is its number of words, 0 for a null text; such documents get no
    copy. Sources stand in code point order, null last and as a source of its own.
    Which documents of one source and size get a copy more is decided by a hash of
    the id and then the id, so reruns agree; rows that repeat an id may share it. An
    empty table gives no rows. Columns keep their values whatever their names.
    """
    ws = Workspace(spark, "mix")
    src = F.struct(F.col(source_col).isNull().cast("int").alias("last"), F.coalesce(F.col(source_col), F.lit("")).alias("name"))
    salts = shuffle_partitions(spark)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), src.alias("src"), word_count(text_col).alias("size"), F.xxhash64(F.col(id_col)).alias("h")).withColumn("salt", F.pmod(F.col("h"), F.lit(salts)))
    counts = ws.table(rows.groupBy("src", "size", "salt").agg(F.count("*").alias("m")), "counts")
    histogram = ws.table(counts.groupBy("src", "size").agg(F.sum("m").alias("n")), "histogram")
    sources = histogram.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    aims = ws.table(targets(spark, ws, sources.select("src", "source_size"), percent, most), "aims")
    mean = sources.select("src", (F.col("source_size") / F.col("docs")).alias("mean"))
    histogram = ws.table(histogram.join(mean, "src").select("src", "size", "n", (F.col("size") / F.greatest(F.col("size") + F.col("mean"), F.lit(1e-9))).alias("a")), "histogram")
    rates = histogram.join(multipliers(ws, histogram, aims, most), "src").select("src", "size", "n", _rate(most).alias("rate"))
    # a source's histogram has a row per size, so it is bounded by the longest text
    copies = ws.table(rates.groupBy("src").applyInPandas(_carry(most), "src struct<last: int, name: string>, size long, n long, copies long"), "copies")
    # each salt's part of a size's extra copies: those that fall into its stretch of the size's rows
    by = W.partitionBy("src", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)  # a row per salt
    parts = counts.join(copies, ["src", "size"]).withColumn("start", F.coalesce(F.sum("m").over(by), F.lit(0)))
    base, extra = F.floor(F.col("copies") / F.col("n")), F.col("copies") % F.col("n")
    quota = parts.join(aims, "src").select("src", "size", "salt", "source_size", "target", base.cast("int").alias("base"), F.greatest(F.least(extra - F.col("start"), F.col("m")), F.lit(0)).alias("extra"))
    order = W.partitionBy("src", "size", "salt").orderBy("h", f"doc.{id_col}")
    ranked = rows.withColumn("place", F.row_number().over(order)).join(ws.table(quota, "quota"), ["src", "size", "salt"])
    return ranked.select("doc", "size", "source_size", "target", (F.col("base") + (F.col("place") <= F.col("extra")).cast("int")).alias("copies"))


def mixed(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it."""
    out = mix(spark, docs, **options)
    return out.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark, read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
