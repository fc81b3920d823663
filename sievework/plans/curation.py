"""Queries: catalog imports, selections' checks, unions, experiment sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import repair
from ..functions import text as X
from ..operators import curation as C
from ..operators import dedup, splits, vector
from .registry import query


@query("import_manifest_violations", "select 'name' as missing, count(*) as n from part where p_size % 7 = 0")
def import_manifest_violations(t):
    p = t.part.select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_name")).alias("name"), F.array(*map(F.lit, (1, 2, 3, 255))).alias("g"), F.lit(1).alias("h"))
    return C.import_manifest(p, ["p_partkey", "name"], "g", "h", "h")[1].groupBy("missing").agg(F.count("*").alias("n"))


@query("import_manifest", "select p_partkey, case when p_partkey % 2 = 0 then 'opaque' else 'binary' end as alpha, sha256('1x1x' || case when p_partkey % 2 = 0 then '1,2,3,255' else '0,0,0,0' end) as target_hash from part")
def import_manifest(t):
    g = F.array(F.lit(1), F.lit(2), F.lit(3), F.when(F.col("p_partkey") % 2 == 0, 255).otherwise(0))
    return C.import_manifest(t.part.select("p_partkey", g.alias("g"), F.lit(1).alias("h")), ["p_partkey"], "g", "h", "h")[0].select("p_partkey", "alpha", "target_hash")


@query("record_projection", "select doc_id as id, source as lineage, lang as kind from documents")
def record_projection(t):
    return t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("lineage"), F.col("lang").alias("kind"))


@query("metadata_scalars", "select event_id, 'k' as key, json_extract_string(props, '$.k') as value from events")
def metadata_scalars(t):
    m = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: v.isNotNull() & ~v.startswith("{"))
    return t.events.select("event_id", F.explode(m).alias("key", "value"))


@query("block_tileable", "select p_partkey, p_type not in ('PROMO') and p_name not like '%ring%' and p_name not like '%rod%' as tileable from part")
def block_tileable(t):
    kind = X.type_word(F.when(F.col("p_type") == "PROMO", "item").otherwise("block"))
    return t.part.select("p_partkey", ((kind == "block") & ~F.col("p_name").rlike("ring|rod")).alias("tileable"))


@query("compatible_cells", "select first, second, (first = 'red' and second in ('ring', 'bolt')) or (first <> 'red' and second <> 'gear') as ok from (select distinct split_part(p_name, ' ', 1) as first, split_part(p_name, ' ', 2) as second from part)")
def compatible_cells(t):
    a, b = F.col("first"), F.col("second")
    cells = t.part.select(F.split("p_name", " ")[0].alias("first"), F.split("p_name", " ")[1].alias("second")).distinct()
    return cells.withColumn("ok", ((a == "red") & b.isin("ring", "bolt")) | ((a != "red") & (b != "gear")))


@query("positional_join", "select doc_id, lang, source from documents")
def positional_join(t):
    return C.positional_join(t.documents.select("doc_id", "lang"), t.documents.select("doc_id", "source"), "doc_id").select("doc_id", "lang", "source")


@query("weighted_take", "select doc_id from documents where ('0x' || substr(sha256('4:' || doc_id), 1, 16))::ubigint::double / 18446744073709551616.0 < case when lang = 'en' then 0.25 else 0.75 end")
def weighted_take(t):
    return C.weighted_take(t.documents.select("doc_id", "lang"), "doc_id", F.when(F.col("lang") == "en", 0.25).otherwise(0.75), 4).select("doc_id")


@query("fixed_chunks", "select doc_id, (row_number() over (partition by source order by doc_id) - 1) // 8 as chunk from documents")
def fixed_chunks(t):
    return C.chunks(t.documents.select("doc_id", "source"), ["source"], "doc_id", 8).select("doc_id", "chunk")


@query("catalog_union_resplit", """with u as (select 'c' || c_custkey as id, c_nationkey as lineage from customer union all select 's' || s_suppkey, s_nationkey from supplier)
  select id, case when (('0x' || substr(sha1('6:' || lineage), 1, 8))::ubigint % 10000) < 9000 then 'train' when (('0x' || substr(sha1('6:' || lineage), 1, 8))::ubigint % 10000) < 9500 then 'val' else 'test' end as split from u""")
def catalog_union_resplit(t):
    c = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").alias("lineage"))
    s = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").alias("lineage"))
    return splits.group_split(c.unionByName(s), ["lineage"], "id", seed=6).select("id", "split")


@query("ordered_distinct", """with a as (select p_partkey, string_split(p_name, ' ') || [lower(p_type), split_part(p_name, ' ', 1)] as k from part) select p_partkey, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), ' ') as words, array_to_string(list_filter(k[1:2], lambda x: x <> lower(k[3])), ' ') as without from a""")
def ordered_distinct(t):
    k = F.concat(F.split("p_name", " "), F.array(F.lower("p_type"), F.split("p_name", " ")[0]))
    return t.part.select("p_partkey", F.array_join(F.array_distinct(k), " ").alias("words"), F.array_join(F.array_except(F.split("p_name", " "), F.array(F.lower("p_type"))), " ").alias("without"))


@query("derived_prompts", "select p_partkey, replace(p_name, ' ', '_') as stem, case when p_type = 'PROMO' then p_name || ', item icon' else p_name || ', block texture' end as prompt from part")
def derived_prompts(t):
    stem = F.replace("p_name", F.lit(" "), F.lit("_"))
    suffix = F.when(X.type_word(F.when(F.col("p_type") == "PROMO", "item")) == "item", ", item icon").otherwise(", block texture")
    return t.part.select("p_partkey", stem.alias("stem"), F.concat(F.regexp_replace(stem, "_", " "), suffix).alias("prompt"))


@query("greedy_near_duplicates")
def greedy_near_duplicates(t):
    return dedup.greedy_over_all(t.embeddings, "vec_id", "embedding", 0.9)


@query("selection_violations", """with d as (select doc_id, source, case when doc_id % 5 = 0 then 'val' else 'train' end as split from documents),
  s as (select doc_id, case when doc_id % 10 = 3 then 'src3' else source end as source from d where doc_id % 10 in (0, 3) union all select 0, (select source from d where doc_id = 0) union all select -5, 'x'),
  j as (select s.doc_id, s.source, d.doc_id as known, d.source as own from s left join d using (doc_id)),
  r as (select 'repeated' as rule, count(*) - count(distinct doc_id) as n from s union all select 'unknown', count(*) from j where known is null union all select 'identity', count(*) from j where known is not null and source is distinct from own) select rule, n from r where n > 0""")
def selection_violations(t):
    d = t.documents.select("doc_id", "source", F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"))
    s = d.filter("doc_id % 10 in (0, 3)").select("doc_id", F.when(F.col("doc_id") % 10 == 3, "src3").otherwise(F.col("source")).alias("source"))
    odd = t.spark.createDataFrame([(0, None), (-5, "x")], "doc_id long, source string").join(d.select(F.col("doc_id").alias("k"), F.col("source").alias("s0")), F.col("doc_id") == F.col("k"), "left")
    return C.selection_violations(s.unionByName(odd.select("doc_id", F.coalesce("source", "s0").alias("source"))), d, "doc_id", "split", "source")


@query("augmentation_collisions", """with v as (select case when p_partkey % 5 = 0 then 'val' else 'train' end as split, unnest([p_name, p_type]) as hash from part), g as (select hash, count(distinct split) as n from v group by 1) select hash, case when n > 1 then 'crosses_splits' else 'exposed' end as reason from g where n > 1 or hash in (select 'red ring')""")
def augmentation_collisions(t):
    p = t.part.withColumn("split", F.when(F.col("p_partkey") % 5 == 0, "val").otherwise("train"))
    return C.augmentation_collisions(p, "split", F.array("p_name", "p_type"), t.spark.createDataFrame([("red ring",)], "h string"))


@query("hashed_embeddings", """with a as (select p_partkey, string_split(p_name, ' ') || [p_name] as k from part), h as (select p_partkey, k, list_transform(k, lambda g: list_transform(range(0, 64), lambda i: ('0x' || sha256(g)[i + 1])::hugeint)) as d from a),
  m as (select p_partkey, k, list_transform(d, lambda x: list_reduce(x, lambda s, y: (s * 16 + y) % 6144)) as spot, list_transform(d, lambda x: list_reduce(x, lambda s, y: (s * 16 + y) % 8)) as own from h),
  z as (select p_partkey, k, list_transform(spot, lambda x: x % 8) as one, list_transform(list_zip(spot, own), lambda x: (x[1] * 7 + x[2]) % 8) as two from m)
  select p_partkey, list_transform(range(0, 8), lambda j: round((len(list_filter(one, lambda x: x = j)) + 0.5::double * len(list_filter(two, lambda x: x = j))) * 0.1::double / sqrt(len(k) + 1e-6::double), 9)) as v from z""")
def hashed_embeddings(t):
    k = F.split("p_name", " ")
    v = C.hashed_embedding(F.concat(k, F.array("p_name")), 8)
    return t.part.select("p_partkey", F.transform(v, lambda x: F.round(x, 9)).alias("v"))


@query("greedy_hash_duplicates")
def greedy_hash_duplicates(t):
    """I11 by perceptual hash: the sign hash of each vector rounded to whole numbers, four bits."""
    code = vector.sign_hash(F.transform("embedding", lambda x: F.round(x.cast("double"))))
    return dedup.greedy_by_hash(t.embeddings.select("vec_id", code.alias("code")), "vec_id", "code")


@query("first_json_objects", "select event_id, json_extract_string(props, '$.k') as k from events")
def first_json_objects(t):
    text = F.concat(F.lit("answer: "), "props", F.lit(' and {"k": 0}'))
    return t.events.select("event_id", F.get_json_object(repair.first_json(text), "$.k").alias("k"))


@query("fresh_evaluation", """with a as (select doc_id, lang, n_chars, case when doc_id % 10 = 0 then 'test' when doc_id % 10 < 4 then 'val' else 'train' end as split from documents), o as (select * from a qualify row_number() over (partition by n_chars, split order by doc_id) = 1), f as (select * from o where n_chars not in (select n_chars from documents where doc_id % 25 = 1)),
  v as (select *, row_number() over (partition by lang order by doc_id) as r, count(*) over (partition by lang) as n from f where split = 'val'), w as (select doc_id, split from v order by r, n desc, lang limit 30) select doc_id, split from f where split = 'test' union all select * from w""")
def fresh_evaluation(t):
    d = t.documents.select("doc_id", "lang", "n_chars", F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 < 4, "val").otherwise("train").alias("split"))
    return C.fresh_evaluation(d, "split", "n_chars", t.documents.filter("doc_id % 25 = 1").select("n_chars"), "lang", "doc_id", 30).select("doc_id", "split")


@query("composite_cases", "select doc_id, lang, color, seed from (select min(doc_id) as doc_id, lang from documents group by 2), (values ('red', 1), ('red', 2), ('blue', 1)) s(color, seed)")
def composite_cases(t):
    s = t.spark.createDataFrame([("red", 1), ("red", 2), ("blue", 1)], "color string, seed int")
    return C.first_of_each_and_products(t.documents.select("doc_id", "lang"), "lang", "doc_id", s)


@query("legacy_migration", "select c_custkey as id, c_name as text from customer where c_custkey % 2 = 0 union all select c_custkey, coalesce(case when c_custkey % 3 > 0 then c_name end, c_mktsegment) from customer where c_custkey % 2 = 1 and c_acctbal >= 0 and c_nationkey <> 3")
def legacy_migration(t):
    return _migration(t)[0]


@query("legacy_rejections", "select case when c_acctbal < 0 then 'negative' else 'nation' end as reason, count(*) as n from customer where c_custkey % 2 = 1 and (c_acctbal < 0 or c_nationkey = 3) group by 1")
def legacy_rejections(t):
    return _migration(t)[1]


def _migration(t):
    c = t.customer
    primary = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))
    legacy = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("text"), "c_mktsegment", "c_acctbal", "c_nationkey")
    rows, counts = C.migrate(primary, legacy, "id", "text", F.col("c_mktsegment"), [("negative", F.col("c_acctbal") < 0), ("nation", F.col("c_nationkey") == 3)])
    return rows.select("id", "text"), counts


@query("held_out_pool_reasons", """with t as (select distinct source from documents where doc_id % 10 = 0), a as (select case when n_chars in (select n_chars from documents where doc_id % 10 = 0) then 'content' when lang = 'es' then 'policy' when n_chars < 400 then 'shape' else 'keep' end as reason from documents where doc_id % 10 <> 0) select reason, count(*) as n from a group by 1""")
def held_out_pool_reasons(t):
    from ..operators.joins import exclusion_reasons

    d = t.documents.select("doc_id", "n_chars", "lang")
    checks = [("content", ("n_chars", d.filter("doc_id % 10 = 0").select("n_chars"))), ("policy", F.col("lang") == "es"), ("shape", F.col("n_chars") < 400)]
    return exclusion_reasons(d.filter("doc_id % 10 <> 0"), checks).groupBy("reason").agg(F.count("*").alias("n"))


@query("override_decisions", "select p_partkey, case when p_partkey % 20 = 0 then 'keep' when p_name like '%rod%' then 'quarantine' else 'keep' end as decision from part")
def override_decisions(t):
    from ..operators.joins import override_join

    base = t.part.select("p_partkey", F.when(F.contains("p_name", F.lit("rod")), "quarantine").otherwise("keep").alias("rule"))
    over = t.part.filter("p_partkey % 20 = 0").select("p_partkey", F.lit("keep").alias("v"), F.lit(1).alias("o"))
    return override_join(base, over, "p_partkey", "v", "o", "rule", "decision").select("p_partkey", "decision")


@query("hash_role_family", "select s_suppkey, (('0x' || substr(sha1(s_name), 1, 8))::ubigint::double / 4294967295.0) < 0.1 as held from supplier")
def hash_role_family(t):
    value = F.conv(F.substring(F.sha1("s_name"), 1, 8), 16, 10).cast("long")
    return t.supplier.select("s_suppkey", (value.cast("double") / F.lit(float(0xFFFFFFFF)) < 0.1).alias("held"))


@query("content_fingerprint", "select doc_id, sha256('t' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) as hash from documents")
def content_fingerprint(t):
    return t.documents.select("doc_id", K.content_hash("text", F.lit("t")).alias("hash"))
