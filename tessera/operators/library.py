"""A library of texts: import that leaves out what is there, an index committed at once, reports with bounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

LEAST_CHARS = 200
LIBRARY = "body_hash string, title string, text string, chars long"


def body_hash(text):
    return F.sha2(T.compact(F.coalesce(text, F.lit(""))), 256)


def judged(batch: DataFrame, library: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """batch (pos, title, text) with body_hash, chars and status: failed (no text), thin, duplicate (in the library, or an earlier one of the batch) or imported."""
    rows = batch.withColumns({"body_hash": body_hash(F.col("text")), "chars": T.valid_chars(F.coalesce("text", F.lit("")))})
    there = library.select(F.col("body_hash").alias("known")).distinct()
    rows = rows.join(there, F.col("body_hash") == F.col("known"), "left")
    good = F.col("text").isNotNull() & (F.col("chars") >= least)
    first = rows.filter(good).groupBy(F.col("body_hash").alias("of")).agg(F.min("pos").alias("first"))
    rows = rows.join(first, F.col("body_hash") == F.col("of"), "left")
    status = F.when(F.col("text").isNull(), "failed").when(F.col("chars") < least, "thin").when(F.col("known").isNotNull() | (F.col("pos") > F.col("first")), "duplicate").otherwise("imported")
    return rows.withColumn("status", status).drop("known", "of", "first")


def receipt(judged_rows: DataFrame) -> DataFrame:
    """status, n, chars, first: what became of a batch, in the order of first sight."""
    return judged_rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.min("pos").alias("first"))


class Library:
    """Versions of an index below a path: each is written whole beside the others and becomes visible by one rename."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        if not self._fs.exists(self._at(self.path)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return max((int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        return self.spark.read.schema(LIBRARY).parquet(f"{self.path}/v{version:09d}") if version else self.spark.createDataFrame([], LIBRARY)

    def add(self, batch: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
        """Imports a batch as the next version; its receipt. Two writers of one version: the second one's rename fails."""
        version = self.version()
        before = self.read(version)
        rows = judged(batch, before, least).persist()
        try:
            new = rows.filter("status = 'imported'").select("body_hash", "title", "text", "chars")
            beside = f"{self.path}/_beside-{uuid.uuid4().hex}"
            before.unionByName(new).write.parquet(beside)
            goal = self._at(f"{self.path}/v{version + 1:09d}")
            if self._fs.exists(goal) or not self._fs.rename(self._at(beside), goal):
                raise RuntimeError(f"version {version + 1} was written by someone else")
            made = receipt(rows).collect()  # a row a status
        finally:
            rows.unpersist()
        return self.spark.createDataFrame(made, "status string, n long, chars long, first long")


#: How many rows of each kind a stored report keeps.
KEPT = {"hits": 40, "sources": 80, "abstracts": 24, "notes": 20, "segments": 150}


def bounded(reports: DataFrame, kept: dict[str, int] | None = None) -> DataFrame:
    """Reports with each list cut to its bound, and beside it how many there were."""
    for name, most in (KEPT if kept is None else kept).items():
        if name in reports.columns:
            reports = reports.withColumns({f"{name}_total": F.coalesce(F.size(name), F.lit(0)), name: F.slice(F.coalesce(name, F.array().cast(reports.schema[name].dataType)), 1, most)})
    return reports


def shrunk(reports: DataFrame, column: str, most_bytes: int) -> DataFrame:
    """Reports whose list gets shorter by halves until their JSON fits; six halvings at most, then the list is empty."""
    size = lambda k: F.octet_length(F.to_json(F.struct(*[F.col(c) if c != column else F.slice(F.col(c), F.lit(1), k).alias(c) for c in reports.columns])))
    n = F.size(column)
    steps = [F.floor(n / (1 << k)).cast("int") for k in range(6)]
    fit = F.coalesce(*[F.when(size(k) <= most_bytes, k) for k in steps], F.lit(0))
    return reports.withColumn(column, F.slice(F.col(column), F.lit(1), fit))


def retained(reports: DataFrame, key: str, most: int) -> DataFrame:
    """The newest so many reports of each key."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("created"), F.desc("id")))
    return reports.withColumn("r", r).filter(F.col("r") <= most).drop("r")
