"""Scans and sinks of the curation workload."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBER_LIMIT = 100 << 20


# JSON lines


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, value)``: lines of text files, numbered from 0 in each file, however many tasks read a file.

    Spark's row ids ascend inside a block of a file; the lines of the blocks
    before one (a row for each block) give its first number.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def json_lines(spark: SparkSession, path: str, schema: str, *, start: int = 0, limit: int | None = None) -> DataFrame:
    """A1: rows of a JSON-lines file, blank lines skipped; with ``start`` or ``limit`` by line number (from 0) within each file."""
    if not start and limit is None:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = numbered_lines(spark, path).filter(F.trim("value") != "").filter(F.col("line") >= start)
    if limit is not None:
        lines = lines.filter(F.col("line") < start + limit)
    return lines.select("line", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("line", "row.*")


def json_lines_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A2: lines that are no JSON of the schema are left aside."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_lines_errors(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A3: ``(file, line, text)`` of each line, numbered from 1, that is no JSON of the schema or lacks a required field; blank lines are none."""
    kind = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_bad", T.StringType())])
    rows = numbered_lines(spark, path).filter(F.trim("value") != "").withColumn("row", F.from_json("value", kind, {"columnNameOfCorruptRecord": "_bad"}))
    wrong = F.col("row").isNull() | F.col("row._bad").isNotNull()
    for c in required:
        wrong = wrong | F.col("row")[c].isNull()
    return rows.filter(wrong).select("file", (F.col("line") + 1).alias("line"), F.col("value").alias("text"))


def merge_schema(spark: SparkSession, folder: str, name: str, shape: list[int], dtype: str, extra: dict | None = None) -> dict:
    """Describes a raw file in the folder's ``schema.json``: other files stay listed, metadata is that of the latest call."""
    system, at = fs.FileSystem.from_uri(f"{folder}/schema.json")
    system.create_dir(at.rpartition("/")[0], recursive=True)
    known = {}
    if system.get_file_info(at).type == fs.FileType.File:
        with system.open_input_stream(at) as f:
            known = json.loads(f.read())
    merged = {**known, **(extra or {}), "files": {**known.get("files", {}), name: {"shape": list(shape), "dtype": dtype}}}
    attempt = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as out:
        out.write(json.dumps(merged, indent=2, sort_keys=True).encode())
    system.move(attempt, at)
    return merged


def write_sorted_json(df: DataFrame, path: str, *, rows_per_file: int = 0) -> None:
    """JSON lines with sorted fields, at most ``rows_per_file`` in each file."""
    out = df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))
    (out.write.option("maxRecordsPerFile", rows_per_file) if rows_per_file else out.write).text(path)


# point reads, counts


def point_read(df: DataFrame, index: str, wanted: DataFrame) -> DataFrame:
    """The rows of a wanted index set; a semi-join, so Parquet row groups are pruned where the set is small."""
    return df.join(wanted.select(F.col(wanted.columns[0]).alias("_w")).distinct(), F.col(index) == F.col("_w"), "left_semi")


# fixed-size records


class RawRecords(DataSource):
    """``spark.read.format("raw_records")``: headerless files of records of ``record_bytes`` bytes.

    The record's number is its place in the file. A file whose size is no
    multiple of the record's is refused. Partitions are ranges of records.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_records"

    def schema(self) -> str:
        return "index long, record binary"

    def reader(self, schema):
        return _RawReader(self.options)


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _RawReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options["record_bytes"])
        self.per_partition = int(options.get("records_per_partition", "65536"))

    def partitions(self):
        system, at = fs.FileSystem.from_uri(self.path)
        size = system.get_file_info(at).size
        if size is None or size % self.size:
            raise ValueError(f"{self.path}: {size} bytes are no multiple of {self.size}")
        n = size // self.size
        return [_Range(a, min(n, a + self.per_partition)) for a in range(0, n, self.per_partition)] or [_Range(0, 0)]

    def read(self, part):
        system, at = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(at) as f:
            for a in range(part.first, part.last, 4096):
                b = min(part.last, a + 4096)
                data = f.read_at((b - a) * self.size, a * self.size)
                yield pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array([data[i * self.size : (i + 1) * self.size] for i in range(b - a)], pa.binary())], names=["index", "record"])


def raw_records(spark: SparkSession, path: str, record_bytes: int) -> DataFrame:
    spark.dataSource.register(RawRecords)
    return spark.read.format("raw_records").option("record_bytes", record_bytes).load(path)


def write_raw_records(df: DataFrame, order: str, record: str, folder: str) -> list[str]:
    """One file for each range of the order, in order; each is written under an attempt's name and renamed."""

    def write(batches):
        from pyspark import TaskContext

        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.raw"
        system, at = fs.FileSystem.from_uri(path)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        attempt, n = f"{at}.{uuid.uuid4().hex}", 0
        with system.open_output_stream(attempt) as out:
            for b in batches:
                out.write(b"".join(b["record"].to_pylist()))
                n += b.num_rows
        system.move(attempt, at)
        yield pa.RecordBatch.from_pylist([{"path": path, "n": n}])

    rows = df.select(F.col(order).alias("o"), F.col(record).alias("record"))
    n = max(1, rows.rdd.getNumPartitions())
    done = rows.repartitionByRange(n, "o").sortWithinPartitions("o").mapInArrow(write, "path string, n long").collect()  # one row per file
    return [r.path for r in sorted(done) if r.n]


# archives and folders


def members(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), *, pattern: str | None = None, sizes: tuple[int, ...] = (), limit: int = MEMBER_LIMIT) -> DataFrame:
    """``(container, member, size, sha256, content)`` of files in a folder and of ZIP archives in it.

    Members above ``limit`` bytes, of other extensions, off the pattern or off a
    size whitelist are left aside; a broken archive gives one row with an error.
    """
    want = re.compile(pattern) if pattern else None

    def good(name: str, size: int) -> bool:
        return (not extensions or name.lower().endswith(extensions)) and (not want or bool(want.search(name))) and size <= limit and (not sizes or size in sizes)

    def walk(batches):
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                rows, name = [], path.rpartition("/")[2]
                if name.lower().endswith(".zip"):
                    try:
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            for m in z.infolist():
                                if not m.is_dir() and good(m.filename, m.file_size):
                                    rows.append({"container": path, "member": m.filename, "content": z.read(m), "error": None})
                    except (zipfile.BadZipFile, RuntimeError) as e:
                        rows.append({"container": path, "member": None, "content": None, "error": str(e)})
                elif good(name, len(content)):
                    rows.append({"container": path, "member": name, "content": content, "error": None})
                for r in rows:
                    yield pa.RecordBatch.from_pylist([r], schema=pa.schema([("container", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())]))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    found = files.mapInArrow(walk, "container string, member string, content binary, error string")
    return found.select("container", "member", F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"), "content", "error")


def texture_folder(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Path parts of texture files, and the display name of each key where a language table (key, name) has one."""
    parts = F.regexp_extract("member", r"assets/([^/]+)/textures/([^/]+)/(.+)\.png$", 0)
    out = files.filter(parts != "").select(
        "member",
        F.regexp_extract("member", r"assets/([^/]+)/textures/", 1).alias("namespace"),
        F.regexp_extract("member", r"/textures/([^/]+)/", 1).alias("kind"),
        F.regexp_extract("member", r"/textures/[^/]+/(.+)\.png$", 1).alias("name"),
    )
    if names is None:
        return out.withColumn("display", F.lit(None).cast("string"))
    return out.withColumn("_key", F.concat_ws(".", "kind", "namespace", "name")).join(names.select(F.col("key").alias("_key"), F.col("name").alias("display")), "_key", "left").drop("_key")


# review sheets, catalogs


def write_review_sheet(df: DataFrame, path: str) -> None:
    """CSV with a header, lists joined by bars."""
    flat = [F.array_join(F.col(f.name), "|").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name).cast("string").alias(f.name) for f in df.schema]
    df.select(*flat).write.option("header", True).option("escape", '"').csv(path)


def read_review_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All columns as text by name; a byte-order mark before the header does not matter."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    named = raw.select(*[raw[f"`{c}`"].alias(c.lstrip("﻿")) for c in raw.columns])
    want = [f.name for f in T._parse_datatype_string(schema).fields]
    return named.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in want])


def fingerprint(df: DataFrame, key: str) -> DataFrame:
    """One row: the count and a hash of all rows that no order or partitioning changes.

    Rows are hashed as canonical JSON; the table's hash is that of the sums of
    the row hashes' quarters, an aggregate every task contributes to.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    quarters = [F.sum(F.conv(F.substring(row, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")).alias(f"_{i}") for i in range(4)]
    sums = df.agg(F.count(key).alias("rows"), *quarters)
    return sums.select("rows", F.sha2(F.concat_ws(":", "rows", *[F.coalesce(F.col(f"_{i}"), F.lit(0)).cast("string") for i in range(4)]), 256).alias("fingerprint"))


def write_catalog(df: DataFrame, key: str, folder: str, *, version: int, provenance: dict) -> dict:
    """The table, then its description, renamed into place last: without it the catalog does not count."""
    df.write.parquet(f"{folder}/rows")
    stored = df.sparkSession.read.parquet(f"{folder}/rows")
    f = fingerprint(stored, key).first()
    meta = {"schema_version": version, "rows": f.rows, "fingerprint": f.fingerprint, "provenance": provenance}
    system, at = fs.FileSystem.from_uri(f"{folder}/catalog.json")
    with system.open_output_stream(f"{at}.tmp") as out:
        out.write(json.dumps(meta, sort_keys=True).encode())
    system.move(f"{at}.tmp", at)
    return meta


def read_catalog(spark: SparkSession, key: str, folder: str, *, version: int) -> DataFrame:
    """Refuses another version and rows that do not match the fingerprint."""
    system, at = fs.FileSystem.from_uri(f"{folder}/catalog.json")
    with system.open_input_stream(at) as f:
        meta = json.loads(f.read())
    if meta["schema_version"] != version:
        raise ValueError(f"catalog version {meta['schema_version']}, expected {version}")
    rows = spark.read.parquet(f"{folder}/rows")
    if fingerprint(rows, key).first().fingerprint != meta["fingerprint"]:
        raise ValueError("catalog rows changed since they were written")
    return rows


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Relative path, size and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", re.escape(path.rstrip("/").rpartition("/")[2]) + "/(.*)$", 1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


#: Fixed pattern: how a place on a machine begins.
LOCAL_PATH = r"^(/|~|file:|[A-Za-z]:[/\\\\])"


def local_paths(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value)`` of text, at any depth of lists, structs and maps, that names a place on a machine."""

    def texts(column: Column, kind: T.DataType) -> Column | None:
        if isinstance(kind, T.StringType):
            return F.array(column)
        if isinstance(kind, T.ArrayType):
            return None if texts(column, kind.elementType) is None else F.flatten(F.transform(column, lambda x: texts(x, kind.elementType)))
        if isinstance(kind, T.MapType):
            return None if texts(column, kind.valueType) is None else F.flatten(F.transform(F.map_values(column), lambda x: texts(x, kind.valueType)))
        if isinstance(kind, T.StructType):
            parts = [x for f in kind.fields if (x := texts(column[f.name], f.dataType)) is not None]
            return F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in parts])) if parts else None
        return None

    found = [F.struct(F.lit(c).alias("column"), x.alias("values")) for c in columns if (x := texts(F.col(c), df.schema[c].dataType)) is not None]
    if not found:
        return df.select(F.lit("").alias("column"), F.lit("").alias("value")).limit(0)
    long = df.select(F.explode(F.array(*found)).alias("x")).select("x.column", F.explode("x.values").alias("value"))
    return long.filter(F.col("value").rlike(LOCAL_PATH))


def crawl_pages(pages: DataFrame, seen: DataFrame, key: str, order: Column | str) -> DataFrame:
    """New manifest rows of a paginated crawl, each project once, the first page's row."""
    row = F.struct(*pages.columns)
    fresh = pages.join(seen.select(key).distinct(), key, "left_anti")
    return fresh.groupBy(F.col(key).alias("_k")).agg(F.min_by(row, order).alias("_row")).select("_row.*")
