"""Connected components by propagating least labels, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import Workspace


def components(ws: Workspace, links: DataFrame) -> DataFrame:
    """(id, label) for each id in ``links`` (a, b): label is the least id reachable.

    Each round a vertex takes the least label of its neighbours and then its label's
    label, until none changes. Labels and links stay tables in the shared folder;
    only the number of changes comes to the driver. Loops and repeated links do no
    harm; no links give no rows.
    """
    both = ws.table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = ws.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("root"))
        new = ws.table(step.join(jump, "label").select("id", "old", F.least("label", "root").alias("label")), "labels")
        settled = new.where("old != label").isEmpty()
        ws.drop(labels)
        labels = new
        if settled:
            ws.drop(both)
            return labels


def relabelled(ws: Workspace, labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The table (id, label) after new links (a, b): components found before are single vertices, so only new links are walked."""
    if labels is None:
        found = components(ws, links)
        out = ws.table(found.select("id", "label"), "components")
        ws.drop(found)
        return out
    known = labels.select("id", "label")
    ends = links
    for c in ("a", "b"):
        ends = ends.join(known.withColumnsRenamed({"id": c, "label": f"of_{c}"}), c, "left")
    ends = ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    found = components(ws, ends)
    moved = found.select(F.col("id").alias("label"), F.col("label").alias("root"))
    new = found.select("id").join(known, "id", "left_anti").select("id", F.col("id").alias("label"))
    every = known.unionByName(new).join(moved, "label", "left").select("id", F.coalesce("root", "label").alias("label"))
    out = ws.table(every, "components")
    ws.drop(found)
    return out
