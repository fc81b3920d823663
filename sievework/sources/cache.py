"""A resumable cache of computed features, in chunks with digests.

Rows are numbered; a chunk is a range of numbers. A run computes only chunks
that no manifest row names, writes them, reads them back for their digests and
then writes the manifest rows, so a run that ends early leaves nothing that
counts. Data of such a run is under a name that no manifest row has.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "chunk long, run string, low long, high long, n long, digest string, identity string"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per finished chunk; a chunk that two runs finished counts once."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return rows.groupBy("chunk").agg(F.min_by(F.struct(*rows.columns), "run").alias("r")).select("r.*")


def _digests(rows: DataFrame, value: str) -> DataFrame:
    """``(chunk, run, low, high, n, digest)``; a digest covers the numbers and values of a chunk, whose size is bounded."""
    each = F.struct("index", F.sha2(F.to_json(F.struct(value)), 256).alias("d"))
    return rows.groupBy("chunk", "run").agg(F.min("index").alias("low"), F.max("index").alias("high"), F.count("*").alias("n"), F.sha2(F.to_json(F.array_sort(F.collect_list(each))), 256).alias("digest"))


def fill(df: DataFrame, index: str, value: str, folder: str, identity: str, compute: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *, chunk: int = 4096) -> int:
    """Computes what is missing and returns how many chunks that was.

    ``compute`` maps batches of ``(chunk, index, value)`` to ``schema``, which
    names ``chunk long, index long`` and one more column. ``identity`` says what
    computes; a cache of another identity is refused.
    """
    spark = df.sparkSession
    done = manifest(spark, folder)
    other = done.filter(F.col("identity") != identity).select("identity").limit(1).collect()
    if other:
        raise ValueError(f"the cache was filled by {other[0][0]!r}, not by {identity!r}")
    rows = df.select(F.expr(f"`{index}` div {chunk}").alias("chunk"), F.col(index).cast("long").alias("index"), F.col(value).alias("value"))
    run = uuid.uuid4().hex
    rows.join(done.select("chunk"), "chunk", "left_anti").mapInArrow(compute, schema).write.parquet(f"{folder}/data/run={run}")
    written = spark.read.schema(schema).parquet(f"{folder}/data/run={run}").withColumn("run", F.lit(run))
    feature = next(c for c in written.columns if c not in ("chunk", "index", "run"))
    fresh = _digests(written, feature).withColumn("identity", F.lit(identity)).select(*[c.split()[0] for c in MANIFEST.split(", ")])
    fresh.write.mode("append").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").filter(F.col("run") == run).count()


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The features of finished chunks, each from the run that the manifest names."""
    data = spark.read.schema(f"{schema}, run string").parquet(f"{folder}/data")
    return data.join(manifest(spark, folder).select("chunk", "run"), ["chunk", "run"], "left_semi").drop("run", "chunk")


def violations(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """``(chunk, rule)``: finished chunks whose data is gone or has changed since."""
    data = spark.read.schema(f"{schema}, run string").parquet(f"{folder}/data")
    feature = next(c for c in data.columns if c not in ("chunk", "index", "run"))
    now = _digests(data, feature).select("chunk", "run", F.col("digest").alias("now"))
    j = manifest(spark, folder).join(now, ["chunk", "run"], "left")
    return j.filter(F.col("now").isNull() | (F.col("now") != F.col("digest"))).select("chunk", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("rule"))
