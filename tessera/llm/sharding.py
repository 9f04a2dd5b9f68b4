"""Size-tiered compaction of immutable shards under a versioned manifest, in DataFrame operations only.

A store is a folder: data/ holds runs, each written once and never changed, and manifest/ holds one table for each version
that lists the runs it consists of. An append writes what has arrived as small runs, one for each partition that arrives,
without a shuffle, and commits a version that has them too. A compaction puts runs of like size, by powers of FANOUT, into
one tier; within a tier neighbours in order of age are joined up to TARGET bytes, and a group of at least FANOUT runs, or
one that fills a target, is rewritten as one run. Rounds follow until no tier has such a group, and each commits a version.
A commit writes the manifest beside the others and renames it into place, which fails if the version is there already: a
reader sees all of a version or none of it, and of two writers one wins. Runs that no version lists are remains of a failed
attempt and are never read. Only plans of runs, a few numbers each, are computed apart from the rows.

Defined cases: all columns and rows, null and repeated ones too, are kept as they are, whatever their names: the run column
gets a name that the table does not use; an empty table makes a version without runs, which reads as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TARGET, FANOUT, LEAST = 128 << 20, 4, 1 << 20
MANIFEST = "run string, bytes long, rows long, tier int, made_by string"


class Store:
    """A table of immutable runs at path, with the columns of schema."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.path, self.schema, self.target, self.fanout = spark, path.rstrip("/"), schema, target, fanout
        self.run = "_run"
        while self.run.lower() in {c.lower() for c in schema.names}:
            self.run += "_"
        jvm = spark.sparkContext._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._jpath(self.path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def version(self) -> int:
        """The newest version, 0 before the first."""
        if not self._fs.util().exists(self._jpath(f"{self.path}/manifest")):
            return 0
        names = [s.getPath().getName() for s in self._fs.util().listStatus(self._jpath(f"{self.path}/manifest"))]
        return max((int(n[1:]) for n in names if n[0] == "v"), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """run, bytes, rows, tier, made_by of a version, the newest by default."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{version:09d}")

    def _commit(self, rows: DataFrame, version: int) -> None:
        beside = f"{self.path}/manifest/.{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(beside)
        self._fs.rename(self._jpath(beside), self._jpath(f"{self.path}/manifest/v{version:09d}"), self._no_options)

    def _tier(self, size: Column) -> Column:
        return F.floor(F.log(F.greatest(size / F.lit(LEAST), F.lit(1.0))) / F.log(F.lit(float(self.fanout)))).cast("int")

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("append").option("compression", "zstd").partitionBy(self.run).parquet(f"{self.path}/data")

    def _data(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(self.run, T.StringType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/data")

    def _measured(self, prefix: str, made_by: str) -> DataFrame:
        """Manifest rows of the runs that were just written: sizes come from the files, no column is read."""
        if not self._fs.util().exists(self._jpath(f"{self.path}/data")):
            return self.spark.createDataFrame([], MANIFEST)
        files = self._data().filter(F.col(self.run).startswith(prefix)).groupBy(F.col(self.run).alias("run"), F.col("_metadata.file_path").alias("file")).agg(F.max("_metadata.file_size").alias("bytes"), F.count("*").alias("rows"))
        runs = files.groupBy("run").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        return runs.select("run", "bytes", "rows", self._tier(F.col("bytes")).alias("tier"), F.lit(made_by).alias("made_by"))

    def append(self, rows: DataFrame) -> int:
        """Adds rows as small runs, one for each partition of theirs; the new version."""
        version = self.version() + 1
        prefix = f"v{version:09d}-{uuid.uuid4().hex[:8]}-"
        self._write(rows.select(*[F.col(f"`{c}`") for c in self.schema.names]).withColumn(self.run, F.concat(F.lit(prefix), F.lpad(F.spark_partition_id().cast("string"), 9, "0"))))
        self._commit(self.manifest(version - 1).unionByName(self._measured(prefix, "append")), version)
        return version

    def plan(self) -> DataFrame:
        """run, group: the runs that the next compaction rewrites and the run that each becomes part of."""
        by_age = Window.partitionBy("tier").orderBy("run")
        runs = self.manifest().filter(F.col("bytes") < F.lit(0.75 * self.target))
        runs = runs.withColumn("before", F.sum("bytes").over(by_age) - F.col("bytes")).withColumn("group", F.floor(F.col("before") / F.lit(self.target)))
        group = Window.partitionBy("tier", "group")
        runs = runs.withColumn("n", F.count("*").over(group)).withColumn("total", F.sum("bytes").over(group))
        worth = (F.col("n") >= self.fanout) | ((F.col("n") > 1) & (F.col("total") >= F.lit(0.75 * self.target)))
        return runs.filter(worth).select("run", F.concat_ws("-", F.col("tier").cast("string"), F.lpad(F.col("group").cast("string"), 9, "0")).alias("group"))

    def compact(self) -> int:
        """Rewrites what the plan names, round after round; the newest version."""
        while True:
            version = self.version()
            plan = common.stored(self.plan(), "shard-plan")
            groups = plan.select("group").distinct().count()
            if not groups:
                return version
            prefix = f"v{version + 1:09d}-{uuid.uuid4().hex[:8]}-"
            to = plan.select(F.col("run").alias("_from" + self.run), F.col("group").alias("_to" + self.run))
            rows = self._data().join(to, F.col(self.run) == F.col("_from" + self.run))
            rows = rows.withColumn(self.run, F.concat(F.lit(prefix), "_to" + self.run)).drop("_from" + self.run, "_to" + self.run)
            self._write(rows.repartitionByRange(groups, self.run))  # a range each: hashed, several groups could meet in a task
            kept = self.manifest(version).join(plan, "run", "left_anti")
            self._commit(kept.unionByName(self._measured(prefix, "compaction")), version + 1)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with their run."""
        if not self._fs.util().exists(self._jpath(f"{self.path}/data")):
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField(self.run, T.StringType())]))
        listed = self.manifest(version).select(F.col("run").alias("_listed"))
        return self._data().join(listed, F.col(self.run) == F.col("_listed"), "left_semi")


def op1_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: the run that holds it after compaction, and what the manifest says of that run."""
    docs = common.table(spark, sf_dir, "documents")
    store = Store(spark, common.fresh(spark, "shards"), docs.schema)
    store.append(docs)
    version = store.compact()
    runs = store.manifest(version)
    return store.read(version).select("doc_id", F.col(store.run).alias("shard")).join(runs, F.col("shard") == F.col("run")).select("doc_id", F.lit(version).cast("long").alias("version"), "shard", "tier", "bytes", "rows", "made_by")
