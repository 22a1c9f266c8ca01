"""The shared folder in which lineage is cut, and files on whatever filesystem Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one on one machine, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not (named := getattr(shared_dir, "own", None)):
            named = shared_dir.own = tempfile.mkdtemp(prefix="kervan-")
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed once and kept as files in the shared folder: what follows reads them again, also after an executor is lost."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Like cut_lineage, but as a Parquet table: smaller for wide or binary columns."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table of fewer bytes for each core is spread over all cores before expensive work on its rows.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, in as many tasks as there are cores if its estimated size is small; larger tables keep the tasks of their scan and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def numbered(df: DataFrame, order: str, name: str = "i") -> DataFrame:
    """df with the number of each row in an order, from 0: rows are sorted by ranges in many tasks, and a task's numbers begin after
    the rows of those before it. On the driver is one count for each task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(cores, min(10_000, size >> 26))
    rows = cut_lineage(df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)  # the number of the task, as monotonically_increasing_id is made
    counts = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    offset = F.element_at(F.lit(offsets).cast("array<bigint>"), part.cast("int") + 1) if offsets else F.lit(0)
    return rows.withColumn(name, offset + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")


class Files:
    """Files by their Hadoop paths (local, hdfs, object stores), seen from the driver; for small files and for questions about paths."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_folder(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def any_match(self, pattern: str) -> bool:
        fs, p = self._at(pattern)
        got = fs.globStatus(p)
        return got is not None and len(got) > 0

    def head(self, path: str, size: int = 4096) -> bytes:
        """The first bytes of a file."""
        fs, p = self._at(path)
        size = min(size, fs.getFileStatus(p).getLen())
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size))) if size else b""
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        return self.head(path, fs.getFileStatus(p).getLen()).decode("utf-8")
