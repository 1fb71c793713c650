"""The index as versioned sets of Parquet tables, rendering, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTables:
    """Several tables that change together: a version is written whole and published by a manifest row, last.

    Readers take the newest manifest, so a writer that dies leaves nothing visible.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        """The newest published version; 0 before the first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return 0
        return self.spark.read.schema("version bigint, tables array<string>").json(f"{self.root}/_manifest").agg(F.max("version")).first()[0] or 0

    def write(self, tables: dict[str, DataFrame]) -> int:
        new = self.version() + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v{new}/{name}")
        self.spark.createDataFrame([(new, sorted(tables))], "version bigint, tables array<string>").coalesce(1).write.mode("append").json(f"{self.root}/_manifest")
        return new

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{version or self.version()}/{name}")


def current_documents(documents: DataFrame) -> DataFrame:
    return documents.where("is_current").orderBy("indexed_at", "document_id")


def escape_cell(text: Column) -> Column:
    """A table cell's text so that Markdown shows it as it is: signs, line starts, pipes and line breaks."""
    for pattern, to in (
        (r"([\\\\`*_\[\]<>])", r"\\$1"),
        (r"(?m)^(\s*)(#{1,6})(?=\s)", r"$1\\$2"),
        (r"(?m)^(\s*)([-+])(?=\s)", r"$1\\$2"),
        (r"(?m)^(\s*)(\d+)([.)])(?=\s)", r"$1$2\\$3"),
        (r"(?m)^(\s*)(-{3,})(?=\s*$)", r"$1\\$2"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def render_table(rows: Column) -> Column:
    """A pipe table from an array of rows of cells; the first row is the header."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, 0), lambda c: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(F.get(rows, 0)), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")


def render_markdown(blocks: DataFrame, key: str = "graph_id") -> DataFrame:
    """One Markdown text per graph; noise is left out, and an unresolved block is an error."""
    text = (
        F.when(F.col("kind") == "unresolved", F.raise_error(F.lit("the graph has unresolved content")))
        .when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), F.col("text")))
        .when(F.col("kind") == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
        .otherwise(F.col("text"))
    )
    rows = blocks.where("kind <> 'noise'").select(key, "reading_order", text.alias("md"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("reading_order", "md"))), lambda s: s["md"]), "\n\n").alias("markdown"))


def export_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """One JSON text per session with its messages in order."""
    m = messages.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    return sessions.join(m, "session_id", "left").select("session_id", F.to_json(F.struct(*sessions.columns, "messages")).alias("json"))


def write_report(metrics: DataFrame, path: str, version: int = 1) -> None:
    metrics.withColumn("report_version", F.lit(version)).coalesce(1).write.mode("overwrite").json(path)
