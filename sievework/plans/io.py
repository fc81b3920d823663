"""Queries: sources and sinks on written copies of tables, pixel grids, streams, extensions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..operators.storage import shared_folder
from ..operators.windows import GuardPolicy
from ..sources import cache, files
from ..streaming import monitor
from .registry import query


@query("json_lines_scan", "select doc_id, lang, source from documents")
def json_lines_scan(t):
    path = shared_folder(t.spark, "jsonl")
    files.write_sorted_json(t.documents.select("doc_id", "lang", "source"), path, rows_per_file=300)
    return files.json_lines(t.spark, path, "doc_id long, lang string, source string")


@query("json_lines_tolerant", "select event_id from events where event_id % 10 > 0")
def json_lines_tolerant(t):
    path = shared_folder(t.spark, "jsonl")
    t.events.select(F.when(F.col("event_id") % 10 == 0, '{"event_id": ').otherwise(F.to_json(F.struct("event_id"))).alias("value")).write.text(path)
    return files.json_lines_tolerant(t.spark, path, "event_id long")


@query("json_lines_slice", "select event_id as line, event_id, event_type from events where event_id between 100 and 399")
def json_lines_slice(t):
    """Lines 100 to 399 of one file, found by number whatever the splits."""
    path = shared_folder(t.spark, "jsonl")
    t.events.select("event_id", "event_type").coalesce(1).sortWithinPartitions("event_id").select(F.to_json(F.struct("event_id", "event_type")).alias("value")).write.text(path)
    return files.json_lines(t.spark, path, "event_id long, event_type string", start=100, limit=300)


@query("json_lines_errors", "select event_id + 1 as line, case when event_id % 10 = 0 then '{\"event_id\": ' else '{\"other\": 1}' end as text from events where event_id % 10 in (0, 1)")
def json_lines_errors(t):
    path = shared_folder(t.spark, "jsonl")
    line = F.when(F.col("event_id") % 10 == 0, '{"event_id": ').when(F.col("event_id") % 10 == 1, '{"other": 1}').otherwise(F.to_json(F.struct("event_id")))
    t.events.coalesce(1).sortWithinPartitions("event_id").select(line.alias("value")).write.text(path)
    return files.json_lines_errors(t.spark, path, "event_id long", ["event_id"]).select("line", "text")


@query("sharded_manifest", "select shard, count(*) as n from (select (row_number() over (order by doc_id) - 1) // 70 as shard from documents) group by 1")
def sharded_manifest(t):
    """JSON lines with at most 70 rows in each file, read back by file."""
    path = shared_folder(t.spark, "shards")
    files.write_sorted_json(t.documents.select("doc_id", "source").coalesce(1).sortWithinPartitions("doc_id"), path, rows_per_file=70)
    per = t.spark.read.schema("doc_id long").json(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return per.select((F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("shard"), "n")


@query("chunk_cache", "select page_id, upper(url) as feature from pages")
def chunk_cache(t):
    """A cache that is filled in two runs; the second computes only what the first has not."""
    folder = shared_folder(t.spark, "cache")

    def compute(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["chunk"], b["index"], pc.utf8_upper(b["value"])], names=["chunk", "index", "feature"])

    schema, pages = "chunk long, index long, feature string", t.pages.select("page_id", "url")
    for rows in (pages.filter(F.col("page_id") < 64), pages):
        cache.fill(rows, "page_id", "url", folder, "upper-1", compute, schema, chunk=32)
    if not cache.violations(t.spark, folder, schema).isEmpty():
        raise ValueError("the cache has changed")
    return cache.read(t.spark, folder, schema).select(F.col("index").alias("page_id"), "feature")


@query("parquet_point_read", "select doc_id, source from documents where doc_id in (select doc_id from labels where toxic = 1)")
def parquet_point_read(t):
    return files.point_read(t.documents.select("doc_id", "source"), "doc_id", t.labels.filter("toxic = 1").select("doc_id"))


@query("row_counts", "select 'documents' as name, count(*) as n from documents union all select 'events', count(*) from events")
def row_counts(t):
    return t.documents.agg(F.lit("documents").alias("name"), F.count("*").alias("n")).unionAll(t.events.agg(F.lit("events"), F.count("*")))


@query("raw_records", "select row_number() over (order by event_id) - 1 as index, event_id as value from events")
def raw_records(t):
    folder = shared_folder(t.spark, "raw")
    rows = t.events.select("event_id", F.unhex(F.lpad(F.hex("event_id"), 16, "0")).alias("record")).coalesce(1)
    paths = files.write_raw_records(rows, "event_id", "record", folder)
    found = files.raw_records(t.spark, paths[0], 8)
    return found.select("index", F.conv(F.hex("record"), 16, 10).cast("long").alias("value"))


@query("review_sheet", "select doc_id::varchar as doc_id, source, lang || '|' || source as tags from documents")
def review_sheet(t):
    path = shared_folder(t.spark, "sheet")
    files.write_review_sheet(t.documents.select("doc_id", "source", F.array("lang", "source").alias("tags")), path)
    return files.read_review_sheet(t.spark, path, "doc_id string, source string, tags string")


@query("catalog_roundtrip", "select doc_id, source from documents")
def catalog_roundtrip(t):
    folder = shared_folder(t.spark, "catalog")
    files.write_catalog(t.documents.select("doc_id", "source"), "doc_id", folder, version=2, provenance={"from": "documents"})
    return files.read_catalog(t.spark, "doc_id", folder, version=2)


@query("crawl_manifest", "select user_id, min_by(event_id, ts) as event_id from events where user_id not in (select c_custkey from customer where c_custkey < 50) group by 1")
def crawl_manifest(t):
    seen = t.customer.filter("c_custkey < 50").select(F.col("c_custkey").alias("user_id"))
    return files.crawl_pages(t.events.select("user_id", "event_id", "ts"), seen, "user_id", "ts").select("user_id", "event_id")


# grids of 2 x 2 pixels made from part keys: channel c of pixel i is (key * (i + 1) + 60 * c) % 256, alpha 0 or 255 by parity
def _grid(t, add=0):
    cell = lambda i: [(F.col("p_partkey") * (i + 1) + add) % 256, (F.col("p_partkey") * (i + 1) + 60) % 256, (F.col("p_partkey") * (i + 1) + 120) % 256, F.when((F.col("p_partkey") + i) % 3 == 0, 0).otherwise(255)]
    return F.array(*[x.cast("int") for i in range(4) for x in cell(i)])


@query("grid_metrics", """with a as (select p_partkey as k, unnest([0, 1, 2, 3]) as i from part), b as (select k, i, (k * (i + 1)) % 256 as r, (k * (i + 1) + 9) % 256 as r2, (k * (i + 1) + 60) % 256 as g, (k * (i + 1) + 120) % 256 as bl, case when (k + i) % 3 = 0 then 0 else 255 end as al from a)
  select k as p_partkey, case when count(*) filter (where al = 0) > 0 then 'binary' else 'opaque' end as alpha, count(distinct case when al > 0 then r * 65536 + g * 256 + bl end) as colors, sum(abs(r - r2)) / 16.0::double as error, 1.0::double as iou, max((r * al + 127) // 255) filter (where i = 3)::int as premultiplied from b group by k""")
def grid_metrics(t):
    a, b = _grid(t), _grid(t, 9)
    last = lambda g, c: F.get(g, 12 + c)
    return t.part.select("p_partkey", P.alpha_class(a).alias("alpha"), P.unique_colors(a).cast("long").alias("colors"), P.mean_abs_error(a, b).alias("error"), P.alpha_iou(a, b).cast("double").alias("iou"), P.premultiply(last(a, 0), last(a, 3)).alias("premultiplied"))


@query("grid_hashes", """with h as (select p_partkey, list_transform(range(0, 16), lambda x: case when (p_partkey + x // 4) % 3 = 0 then 0 when x % 4 = 3 then 255 else (p_partkey * (x // 4 + 1) + 60 * (x % 4)) % 256 end) as g from part) select p_partkey, sha256('2x2x' || array_to_string(g, ',')) as hash from h""")
def grid_hashes(t):
    return t.part.select("p_partkey", P.grid_hash(_grid(t), F.lit(2), F.lit(2)).alias("hash"))


@query("grid_udfs")
def grid_udfs(t):
    g = t.part.select("p_partkey", _grid(t).alias("g"), F.lit(2).alias("s"))
    palette = F.array(*map(F.lit, [0, 0, 0, 128, 128, 128, 255, 255, 255]))
    return g.select("p_partkey", P.lossless_cell("g", "s", "s").alias("cell"), P.quantize("g", palette).alias("quantized"))


@query("guard_stream_rows")
def guard_stream_rows(t):
    """The streaming guard over a log written as files; its batch twin is ``bad_streaks``."""
    folder, out = shared_folder(t.spark, "log"), shared_folder(t.spark, "guard")
    e = t.events.select(F.col("event_type").alias("log"), F.col("event_id").alias("step"), (10 + F.col("value") / (1 + F.col("event_id") % 17)).alias("loss"), F.col("value").alias("gradient"))
    files.write_sorted_json(e, folder)
    stream = monitor.tail_json(t.spark, folder, "log string, step long, loss double, gradient double")
    q = monitor.guard_stream(stream, GuardPolicy(gradient_clip=8.0, gradient_ratio=0.5, clipped_fraction=0.5, loss_ratio=1.001))
    q.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(monitor.GUARD_ROWS).parquet(f"{out}/rows")


@query("stub_annotations", "select page_id::varchar as key, upper(split_part(url, ':', 1)) as value, null::varchar as error from pages where page_id % 7 > 0 union all select page_id::varchar, null, 'ValueError: refused' from pages where page_id % 7 = 0")
def stub_annotations(t):
    def worker(url: str) -> str:
        if url.startswith("no"):
            raise ValueError("refused")
        return url.split(":")[0].upper()

    pages = t.pages.select("page_id", F.when(F.col("page_id") % 7 == 0, "no").otherwise(F.col("url")).alias("url"))
    return monitor.annotate(pages, "page_id", "url", worker, wait_s=0.0).select("key", "value", "error")


# extensions: what Spark adds to the surveyed operators


@query("ext_event_windows", "select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, sum(value) as total from events group by all")
def ext_event_windows(t):
    w = monitor.event_windows(t.events, "ts", "1 day", None, ["event_type"], "value", "1 hour")
    return w.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("ext_rollup", "select l_returnflag, l_linestatus, sum(l_quantity) as quantity, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def ext_rollup(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


@query("ext_as_of_join", """select b.event_id, a.event_id as view_id from (select * from events where event_type = 'purchase') b asof left join (select * from events where event_type = 'view') a on a.user_id = b.user_id and a.ts <= b.ts""")
def ext_as_of_join(t):
    from pyspark.sql import Window

    both = t.events.filter("event_type in ('view', 'purchase')").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return both.withColumn("view_id", seen).filter("event_type = 'purchase'").select("event_id", "view_id")
