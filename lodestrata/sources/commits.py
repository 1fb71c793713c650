"""Units of an index committed to a log: several tables appear together, and of two writers on one version one fails.

A unit is what one import or reconcile changes: documents, their blocks, paths that
become stale, and projections. Its tables are written to a folder of their own first; a
small manifest then claims the next version. The manifest is moved into place by a
rename that fails where the target exists, so a version has one writer, and a writer that
dies before it leaves files that nothing reads. Readers name the folders in the manifests,
never a listing. ``compact`` folds the log into one base folder, itself a commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "version bigint, folder string, tables array<string>, vaults array<string>, base boolean"
KEYS = {"documents": ["vault_id", "relative_path"]}


class Conflict(RuntimeError):
    """Another writer has committed the version that this one claimed."""


class UnitLog:
    """The committed units under a folder that driver and executors share.

    ``schemas`` gives the columns of each table (documents need vault_id and
    relative_path); a table ``invalidations`` (vault_id, relative_path, reason) is added.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType]):
        self.spark, self.root = spark, root.rstrip("/")
        reasons = T.StructType([T.StructField(n, T.StringType()) for n in ("vault_id", "relative_path", "reason")])
        self.schemas = {**schemas, "invalidations": reasons}

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _publish(self, version: int, manifest: dict) -> None:
        """Moves a manifest to its version's name; the file system lets one writer win."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        draft, final = self._path(f"{self.root}/_drafts/{uuid.uuid4().hex}"), self._path(f"{self.root}/_commits/{version:012d}.json")
        fs = draft.getFileSystem(conf)
        fs.mkdirs(final.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), conf)
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), no_options)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is taken") from e
            raise

    def manifests(self, version: int | None = None) -> DataFrame:
        """The manifests from the newest base on, up to ``version``."""
        path = self._path(f"{self.root}/_commits")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], MANIFEST)
        rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/_commits")
        return rows.where(F.col("version") <= version) if version is not None else rows

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return self.manifests().agg(F.max("version")).first()[0] or 0

    def commit(self, base: int, _folds: bool = False, **tables: DataFrame) -> int:
        """Publishes a unit as version ``base + 1`` and returns it.

        ``base`` is the version that the writer has read. Raises ``Conflict`` where that
        is not the newest any more; the writer then reads again and decides anew. Tables
        that a unit does not name are empty in it.
        """
        unknown = set(tables) - set(self.schemas)
        if unknown:
            raise ValueError(f"no such tables: {sorted(unknown)}")
        if self.version() != base:
            raise Conflict(f"version {base} is not the newest")
        folder = f"{self.root}/unit-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.select(*[F.col(f.name).cast(f.dataType) for f in self.schemas[name].fields], *(["commit"] if _folds else [])).write.parquet(f"{folder}/{name}")
        vaults = set()
        if not _folds:
            for name in tables:
                if "vault_id" in self.schemas[name].names:  # a unit touches few vaults
                    vaults |= {r.vault_id for r in self.spark.read.parquet(f"{folder}/{name}").select("vault_id").distinct().collect()}
        self._publish(base + 1, {"version": base + 1, "folder": folder, "tables": sorted(tables), "vaults": sorted(vaults), "base": _folds})
        return base + 1

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """All rows of a table that were committed, each with its ``commit``."""
        log = self.manifests(version).orderBy("version").collect()
        start = max((m.version for m in log if m.base), default=0)
        schema = T.StructType([*self.schemas[name].fields, T.StructField("commit", T.LongType())])
        out = self.spark.createDataFrame([], schema)
        for m in log:
            if m.version >= start and name in m.tables:
                part = self.spark.read.schema(schema if m.base else self.schemas[name]).parquet(f"{m.folder}/{name}")
                out = out.unionByName(part if m.base else part.withColumn("commit", F.lit(m.version).cast("long")))
        return out

    def documents(self, version: int | None = None) -> DataFrame:
        """Each path's last committed document, with ``is_current`` and ``stale_reason``.

        An invalidation makes stale what was committed before it; in one unit it counts
        first, so a document of the same unit is current.
        """
        docs = self.read("documents", version)
        last = W.partitionBy("vault_id", "relative_path").orderBy(F.desc("commit"))
        docs = docs.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
        stale = self.read("invalidations", version).groupBy("vault_id", "relative_path").agg(F.max("commit").alias("__at"), F.max_by("reason", "commit").alias("stale_reason"))
        rows = docs.join(stale, ["vault_id", "relative_path"], "left")
        gone = F.coalesce(F.col("__at") > F.col("commit"), F.lit(False))
        return rows.withColumn("is_current", ~gone).withColumn("stale_reason", F.when(gone, F.col("stale_reason"))).drop("__at")

    def compact(self, base: int) -> int:
        """Folds the log up to ``base`` into one folder per table; readers of older versions keep what they read."""
        return self.commit(base, _folds=True, **{name: self.read(name, base) for name in self.schemas})

    def generations(self) -> DataFrame:
        """vault_id, generation: how many units have touched each vault."""
        return self.manifests().where("NOT base").select(F.explode("vaults").alias("vault_id")).groupBy("vault_id").agg(F.count("*").alias("generation"))

    def generation(self, vault_id: str) -> int:
        row = self.generations().where(F.col("vault_id") == vault_id).first()
        return row.generation if row else 0


class VectorMatrices:
    """Vectors of a vault and profile kept with the generation they were read at, and read again after a bump.

    ``load(vault_id, profile)`` gives the rows; they are kept by Spark, in memory and on
    disk, and are asked only while the vault's generation is still the one they have.
    """

    def __init__(self, log: UnitLog, load, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.log, self.load, self.level = log, load, level
        self.kept: dict[tuple[str, str], tuple[int, DataFrame]] = {}

    def get(self, vault_id: str, profile: str) -> tuple[int, DataFrame]:
        """(generation, rows); rows of another generation are given up first."""
        now = self.log.generation(vault_id)
        have = self.kept.get((vault_id, profile))
        if have and have[0] == now:
            return have
        self.drop(vault_id, profile)
        self.kept[vault_id, profile] = (now, self.load(vault_id, profile).persist(self.level))
        return self.kept[vault_id, profile]

    def drop(self, vault_id: str, profile: str | None = None) -> None:
        """Gives up the rows of a vault, of one profile or of all."""
        for key in [k for k in self.kept if k[0] == vault_id and profile in (None, k[1])]:
            self.kept.pop(key)[1].unpersist()
