"""What the operators of this subpackage share: Arrow mapping and words.

A *word* is a maximal run of characters other than U+0020 and U+0009..U+000D.
On UTF-8 bytes that is exactly what ``bytes.split()`` returns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Rows handed to Python code at once; a row can be long, so bytes are bounded by Spark's own setting as well.
SLICE_ROWS = 512
#: Order key of a null id: it sorts after every other id.
NULL_ID = (1 << 63) - 1


#: A table of up to this many bytes a core may be read by fewer tasks than there are cores, as row groups are not split.
SMALL = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Deals a small table that has no more tasks than there are cores to all of them, before work on its texts begins; any other is left as its scan deals it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    small = int(str(plan.optimizedPlan().stats().sizeInBytes())) <= cores * SMALL
    return df.repartition(cores) if small and plan.toRdd().getNumPartitions() <= cores else df


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs; any others, of whatever name, stay out of its plan. Null text reads as empty."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def keyed_text(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, text_key)``; rows that are equal in id and text have one key, others (but for 64-bit collisions) differ in id or key."""
    rows = id_and_text(docs)
    return rows.withColumn("text_key", F.xxhash64("text", F.col("doc_id").isNull()))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_slices(batches: Iterator[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices with up to ``most`` bytes in one column, or of one row."""
    for batch in batches:
        before = np.append(0, np.cumsum(pc.binary_length(batch[name]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(before, before[at] + most, side="right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value, without decoding."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_slices(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = SLICE_ROWS
) -> DataFrame:
    """``make()`` runs once for each task and returns the function that turns a slice of rows into output rows."""

    def run(batches):
        step = make()
        for part in slices(batches, rows):
            yield step(part)

    return df.mapInArrow(run, schema)
