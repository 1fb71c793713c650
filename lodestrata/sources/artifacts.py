"""Files of conversions kept by their hash: a draft per attempt, promoted whole or discarded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "artifact_id string, role string, media_type string, sha256 string, content binary"


class ArtifactStore:
    """Artifacts of attempts under a folder that driver and executors share.

    An attempt's files are written as a table to a draft; ``promote`` checks every hash
    and moves the draft to its place, once; ``discard`` removes it. Readers see promoted
    attempts only, and check the hashes again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _place(self, attempt: str, kind: str) -> str:
        if not attempt or any(c in attempt for c in "/\\") or attempt.startswith("."):
            raise ValueError("an attempt needs a plain name")
        return f"{self.root}/{kind}/{attempt}"

    def draft(self, attempt: str, artifacts: DataFrame) -> None:
        """Writes the files of an attempt, with their hashes as stated; a second draft of one name is an error."""
        artifacts.select("artifact_id", "role", "media_type", "sha256", "content").write.parquet(self._place(attempt, "drafts"))

    def faults(self, attempt: str, kind: str = "drafts") -> DataFrame:
        """artifact_id, fault: stated hashes that the bytes do not have, and ids that stand twice."""
        rows = self.spark.read.schema(COLUMNS).parquet(self._place(attempt, kind))
        wrong = rows.where(~F.col("sha256").eqNullSafe(F.sha2("content", 256))).select("artifact_id", F.lit("hash-differs").alias("fault"))
        twice = rows.groupBy("artifact_id").count().where("count > 1").select("artifact_id", F.lit("id-repeated").alias("fault"))
        return wrong.unionByName(twice)

    def promote(self, attempt: str) -> str:
        """The folder of the promoted attempt. A draft with a fault, or a name that is taken, is an error, and the draft goes."""
        fault = self.faults(attempt).first()
        (draft, fs), (final, _) = self._fs(self._place(attempt, "drafts")), self._fs(self._place(attempt, "attempts"))
        if fault is not None or fs.exists(final):
            self.discard(attempt)
            raise ValueError(f"{fault.artifact_id}: {fault.fault}" if fault is not None else "the attempt exists already")
        fs.mkdirs(final.getParent())
        if not fs.rename(draft, final):
            raise ValueError("the attempt could not be moved")
        return final.toString()

    def discard(self, attempt: str) -> None:
        draft, fs = self._fs(self._place(attempt, "drafts"))
        fs.delete(draft, True)

    def read(self, attempt: str) -> DataFrame:
        """The artifacts of a promoted attempt; bytes that differ from their hash are an error."""
        rows = self.spark.read.schema(COLUMNS).parquet(self._place(attempt, "attempts"))
        same = F.col("sha256").eqNullSafe(F.sha2("content", 256))
        return rows.withColumn("content", F.when(same, F.col("content")).otherwise(F.raise_error(F.lit("an artifact has changed")).cast("binary")))

    def snapshot(self, attempt: str, files: DataFrame) -> DataFrame:
        """(path, sha256) of inputs kept as they are now. files: path, expected_sha256, content; a file that has changed is an error."""
        rows = files.select(F.col("path").alias("artifact_id"), F.lit("input").alias("role"), F.lit("application/octet-stream").alias("media_type"), F.col("expected_sha256").alias("sha256"), "content")
        self.draft(attempt, rows)
        self.promote(attempt)
        return self.read(attempt).select(F.col("artifact_id").alias("path"), "sha256")
