"""Queries: splits, audits, deduplication, joins, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import dedup, joins, sets, splits
from .registry import query

HASH = "sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))"
BUCKET = "(('0x' || substr(sha1({0}), 1, 8))::ubigint % {1})::bigint"
FRACTION = "(('0x' || substr(sha256({0}), 1, 16))::ubigint::double / 18446744073709551616.0)"


def _docs(t):
    return t.documents.select("doc_id", "source", "lang", "text").withColumn("content", K.content_hash("text"))


DOCS = f"docs as (select doc_id, source, lang, text, {HASH} as content from documents)"
SPLIT = f"case when {BUCKET.format("'7:' || source", 10000)} < 9000 then 'train' when {BUCKET.format("'7:' || source", 10000)} < 9500 then 'val' else 'test' end"


@query("split_role_counts", f"""with {DOCS}, ranked as (select *, row_number() over (partition by content order by doc_id) as r from docs),
  kept as (select *, {SPLIT} as split from ranked where r = 1)
  select split, count(*) as rows, count(distinct content) as contents, count(distinct source) as sources from kept group by split""")
def split_role_counts(t):
    kept = dedup.first_wins(_docs(t).drop("text"), ["content"], ["doc_id"])
    roles = splits.group_split(kept, ["source"], "doc_id", seed=7)
    return roles.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("content").alias("contents"), F.count_distinct("source").alias("sources"))


@query("split_fallback_keys", f"""with g as (select o_orderkey, coalesce(nullif(case when o_orderstatus = 'F' then null else o_orderpriority end, ''),
    case when o_orderkey % 5 = 0 then null else o_custkey::varchar end, '__row__' || o_orderkey) as grp,
    (o_orderstatus = 'F' and o_orderkey % 5 = 0) as by_row from orders)
  select o_orderkey, grp as "group", by_row, case when {BUCKET.format("'3:' || grp", 10000)} < 8000 then 'train' when {BUCKET.format("'3:' || grp", 10000)} < 9000 then 'val' else 'test' end as split from g""")
def split_fallback_keys(t):
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("a"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("b"))
    return splits.group_split(o, ["a"], "o_orderkey", seed=3, fractions=(0.8, 0.1, 0.1), fallback=["b"]).select("o_orderkey", "group", "by_row", "split")


@query("split_frac_sha256", f"""with f as (select distinct source, {FRACTION.format("'5:' || source")} as fraction from documents)
  select source, fraction, case when fraction < 0.8 then 'train' when fraction < 0.9 then 'val' else 'test' end as split from f""")
def split_frac_sha256(t):
    f = t.documents.select("source").distinct().withColumn("fraction", K.hash_fraction(K.seeded(5, "source")))
    return f.withColumn("split", K.role_by_thresholds(F.col("fraction"), (0.8, 0.9)))


@query("split_mod100", f"""select p_partkey, {BUCKET.format('p_name', 100)} as bucket,
  case when {BUCKET.format('p_name', 100)} < 90 then 'train' when {BUCKET.format('p_name', 100)} < 95 then 'val' else 'test' end as split,
  {BUCKET.format('p_name', 10)} = 0 as held_out from part""")
def split_mod100(t):
    b = K.hash_bucket("p_name", 100)
    return t.part.select("p_partkey", b.alias("bucket"), K.role_by_thresholds(b, (90, 95)).alias("split"), (K.hash_bucket("p_name", 10) == 0).alias("held_out"))


@query("exact_dedup_documents", f"with {DOCS} select doc_id, source, content from docs qualify row_number() over (partition by content order by doc_id) = 1")
def exact_dedup_documents(t):
    return dedup.first_wins(_docs(t).select("doc_id", "source", "content"), ["content"], ["doc_id"])


@query("dedup_then_filter_counts", f"""with {DOCS}, a as (select * from docs where lang = 'en' qualify row_number() over (partition by source, content order by doc_id) = 1),
  b as (select * from docs qualify row_number() over (partition by content order by doc_id) = 1)
  select (select count(*) from a) as filter_first, (select count(*) from b where lang = 'en') as dedup_first""")
def dedup_then_filter_counts(t):
    d = _docs(t).drop("text")
    a = dedup.first_wins(d.filter("lang = 'en'"), ["source", "content"], ["doc_id"]).agg(F.count("*").alias("filter_first"))
    b = dedup.first_wins(d, ["content"], ["doc_id"]).filter("lang = 'en'").agg(F.count("*").alias("dedup_first"))
    return a.join(b)  # one row each


@query("quarantine_cross_split", f"""with {DOCS}, r as (select *, case when {FRACTION.format("'0:project:' || source")} < 0.8 then 'train' when {FRACTION.format("'0:project:' || source")} < 0.9 then 'val' else 'test' end as split from docs)
  select doc_id, split, min(split) over (partition by content) <> max(split) over (partition by content) as quarantined from r""")
def quarantine_cross_split(t):
    return splits.project_holdout(_docs(t).drop("text"), "source", "content").select("doc_id", "split", "quarantined")


@query("catalog_violations", f"""with {DOCS}, r as (select doc_id, source, lang, content, {SPLIT} as split from docs),
  s as (select doc_id, split, unnest(['source', 'content']) as kind, unnest([source, content]) as key from r)
  select 'leak_' || kind as rule, key, count(distinct split) as n from s group by kind, key having count(distinct split) > 1
  union all select 'invalid_lang', lang, count(*) from r where lang not in ('en', 'de', 'fr') group by lang""")
def catalog_violations(t):
    roles = splits.group_split(_docs(t).drop("text"), ["source"], "doc_id", seed=7)
    return splits.catalog_violations(roles, "doc_id", "split", ["source", "content"], kinds=("lang", ["en", "de", "fr"]))


# The recursion of SQL walks all pairs; components are small here only because lineages are cut to pairs of parts and suppliers.
@query("transitive_split", f"""with recursive e as (select distinct 'p:' || p_brand || p_size as a, 'c:' || (p_partkey // 7) as b from part),
  n as (select a, b from e union select b, a from e), r as (select a as node, a as seen from n union select r.node, n.b from r join n on n.a = r.seen),
  g as (select node, min(seen) as split_group from r group by node)
  select p_partkey, split_group, case when {FRACTION.format("'1:' || split_group")} < 0.9 then 'train' when {FRACTION.format("'1:' || split_group")} < 0.95 then 'val' else 'test' end as split
  from part join g on node = 'p:' || p_brand || p_size""")
def transitive_split(t):
    p = t.part.select("p_partkey", F.concat("p_brand", F.col("p_size").cast("string")).alias("lineage"), F.expr("p_partkey div 7").alias("content"))
    return splits.transitive_split(p, "lineage", "content", seed=1).select("p_partkey", "split_group", "split")


@query("component_max_role", """with recursive b as (select s_suppkey as id, s_nationkey % 4 || '-' || s_suppkey % 30 as k1, s_suppkey // 3 as k2,
    case when s_acctbal < 6000 then 'train' when s_acctbal < 9000 then 'val' else 'test' end as role from supplier),
  e as (select 'r:' || id as a, '0:' || k1 as b from b union select 'r:' || id, '1:' || k2 from b), n as (select a, b from e union select b, a from e),
  r as (select a as node, a as seen from n union select r.node, n.b from r join n on n.a = r.seen), g as (select node, min(seen) as component from r group by node),
  x as (select id, role, component, case role when 'train' then 1 when 'val' then 2 else 3 end as rank from b join g on node = 'r:' || id),
  y as (select *, max(rank) over (partition by component) as best from x)
  select id, component, role, ['train','val','test'][best] as merged_role, best <> rank as moved from y""")
def component_max_role(t):
    s = t.supplier.select(
        F.col("s_suppkey").alias("id"), F.concat((F.col("s_nationkey") % 4).cast("string"), F.lit("-"), (F.col("s_suppkey") % 30).cast("string")).alias("k1"), F.expr("s_suppkey div 3").alias("k2"),
        F.when(F.col("s_acctbal") < 6000, "train").when(F.col("s_acctbal") < 9000, "val").otherwise("test").alias("role"),
    )
    return splits.component_roles(s, "id", ["k1", "k2"], "role").select("id", "component", "role", "merged_role", "moved")


@query("inherit_global_split", f"""with {DOCS}, r as (select doc_id, source, content, {SPLIT} as split from docs), train as (select distinct source from r where split = 'train'),
  sub as (select *, case when {BUCKET.format("'9:' || source", 10000)} < 9000 then 'train' else 'val' end as inner_split from r where source in (select source from train)),
  held as (select distinct content from sub where inner_split <> 'train')
  select doc_id, inner_split from sub where inner_split <> 'train' or content not in (select content from held)""")
def inherit_global_split(t):
    roles = splits.group_split(_docs(t).drop("text"), ["source"], "doc_id", seed=7).filter("split = 'train'").drop("split", "group", "by_row")
    inner = splits.group_split(roles, ["source"], "doc_id", seed=9, fractions=(0.9, 0.1, 0)).withColumn("inner_split", F.when(F.col("split") == "train", "train").otherwise("val"))
    held = inner.filter("inner_split <> 'train'").select("content").distinct()
    clean = inner.filter("inner_split = 'train'").join(held, "content", "left_anti")
    return clean.select("doc_id", "inner_split").unionByName(inner.filter("inner_split <> 'train'").select("doc_id", "inner_split"))


@query("owner_map_conflicts", """with s as (select unnest(['customer', 'priority']) as kind, unnest([o_custkey::varchar, o_orderpriority]) as key, o_orderstatus from orders)
  select kind, key, count(distinct o_orderstatus) as owners from s group by all having count(distinct o_orderstatus) > 1""")
def owner_map_conflicts(t):
    s = t.orders.select("o_orderstatus", F.explode(F.array(F.struct(F.lit("customer").alias("kind"), F.col("o_custkey").cast("string").alias("key")), F.struct(F.lit("priority").alias("kind"), F.col("o_orderpriority").alias("key")))).alias("o")).select("o.*", "o_orderstatus")
    return s.groupBy("kind", "key").agg(F.count_distinct("o_orderstatus").alias("owners")).filter("owners > 1")


@query("content_conflicts", f"with {DOCS} select content, count(distinct source) as owners, count(*) as n from docs group by content having count(distinct source) > 1")
def content_conflicts(t):
    return dedup.conflicts(_docs(t), "content", "source")


@query("compact_payloads", f"with {DOCS} select doc_id, min(doc_id) over (partition by content) as payload_id from docs")
def compact_payloads(t):
    return dedup.compact(_docs(t).select("doc_id", "content"), "content", "doc_id")[1].select("doc_id", "payload_id")


@query("last_wins_dictionary", "select user_id, event_type, max_by(value, event_id) as value from events group by all")
def last_wins_dictionary(t):
    return dedup.last_wins(t.events.select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], ["event_id"]).drop("event_id")


@query("asymmetric_leaks", f"""with {DOCS}, r as (select doc_id, content, case when {BUCKET.format("'2:' || doc_id", 10)} < 7 then 'train' else 'val' end as split from docs),
  o as (select *, min_by(split, doc_id) over (partition by content) as owner, count(distinct split) over (partition by content) as k from r)
  select doc_id, split, owner, (k > 1 and split = 'val') as dropped from o""")
def asymmetric_leaks(t):
    r = _docs(t).withColumn("split", F.when(K.hash_bucket(K.seeded(2, "doc_id"), 10) < 7, "train").otherwise("val"))
    return splits.asymmetric_leaks(r, "content", "split", "doc_id").select("doc_id", "split", "owner", "dropped")


@query("disjoint_pairs", f"""with {DOCS}, d as (select distinct source, content from docs)
  select a.source as name_a, b.source as name_b, count(*) as shared from d a join d b on a.content = b.content and a.source < b.source group by all""")
def disjoint_pairs(t):
    return splits.disjoint_pairs(_docs(t), "source", "content")


@query("exact_cover", "with n as (select count(*) as n from documents) select count(*) - count(distinct doc_id) as repeated, count(*) filter (where doc_id < 0 or doc_id >= n) as outside, any_value(n) - count(distinct case when doc_id between 0 and n - 1 then doc_id end) as missing from documents, n")
def exact_cover(t):
    n = t.documents.agg(F.count("*").alias("n"))
    return splits.exact_cover(t.documents.select("doc_id").join(F.broadcast(n)), "doc_id", F.col("n"))


@query("holdout_disjoint_train", f"with {DOCS}, r as (select content, {SPLIT} as split from docs) select count(*) as shared from (select content from r where split = 'train' intersect select content from r where split <> 'train')")
def holdout_disjoint_train(t):
    r = splits.group_split(_docs(t), ["source"], "doc_id", seed=7)
    return r.filter("split = 'train'").select("content").intersect(r.filter("split <> 'train'").select("content")).agg(F.count("*").alias("shared"))


@query("leak_counts_benchmark", f"""with {DOCS}, a as (select * from docs where doc_id % 2 = 0), b as (select * from docs where doc_id % 2 = 1)
  select 'content' as kind, count(*) as shared from (select content from a intersect select content from b)
  union all select 'source', count(*) from (select source from a intersect select source from b)
  union all select 'doc_id', count(*) from (select doc_id from a intersect select doc_id from b)""")
def leak_counts_benchmark(t):
    d = _docs(t)
    return sets.overlap_counts(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), {"content": "content", "source": "source", "doc_id": "doc_id"})


@query("union_reindexed", """select 'customer' as source_set, c_custkey as id, c_name as name, c_mktsegment as segment, row_number() over (order by c_custkey) - 1 as place from customer
  union all select 'supplier', s_suppkey, s_name, null, row_number() over (order by s_suppkey) - 1 from supplier""")
def union_reindexed(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return sets.reindexed_union({"customer": c, "supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))}, "id")


@query("priority_key_list", """with a as (select distinct user_id as key from events where event_type = (select min(event_type) from events)), b as (select distinct user_id as key from events)
  select key, 0 as part from a union all select key, 1 from b where key not in (select key from a)""")
def priority_key_list(t):
    first = t.events.agg(F.min("event_type").alias("m"))
    a = t.events.join(F.broadcast(first), F.col("event_type") == F.col("m"))
    return sets.priority_keys(a, t.events, "user_id")


@query("named_subsets", """select 'long' as subset, doc_id from documents where n_chars > 2000 union all select 'english', doc_id from documents where lang = 'en'
  union all select 'hot', doc_id from documents where source = 'src0'""")
def named_subsets(t):
    return sets.named_subsets(t.documents.select("doc_id", "n_chars", "lang", "source"), {"long": F.col("n_chars") > 2000, "english": F.col("lang") == "en", "hot": F.col("source") == "src0"}).select("subset", "doc_id")


@query("prompt_left_join_coverage", """with o as (select l_partkey, max_by(l_shipmode, l_orderkey * 10 + l_linenumber) as mode from (select *, l_returnflag || l_linestatus as l_shipmode from lineitem) where l_quantity > 49 group by 1)
  select p_partkey, o.l_partkey is not null as hit, coalesce(o.mode, p_type) as label from part left join o on l_partkey = p_partkey""")
def prompt_left_join_coverage(t):
    over = t.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"), F.concat("l_returnflag", "l_linestatus").alias("v"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return joins.override_join(t.part.select("p_partkey", "p_type"), over, "p_partkey", "v", "o", "p_type", "label").select("p_partkey", "hit", "label")


@query("two_key_lookup", """select l.doc_id, coalesce(a.turn, b.turn) as turn from labels l left join (select conv_id, max(turn) as turn from conversations group by 1) a on a.conv_id = l.doc_id
  left join (select conv_id, max(turn) as turn from conversations group by 1) b on b.conv_id = l.doc_id // 4""")
def two_key_lookup(t):
    c = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return joins.two_key_lookup(t.labels.select("doc_id", F.expr("doc_id div 4").alias("q")), c.withColumn("c2", F.col("conv_id")), ("doc_id", "q"), ("conv_id", "c2"), "turn", "turn").select("doc_id", "turn")


@query("pending_anti_join", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def pending_anti_join(t):
    return joins.pending(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query("paired_semi", "select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 49)")
def paired_semi(t):
    return t.orders.select("o_orderkey").join(t.lineitem.filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("subset_semi_report", "select count(*) filter (where ok) as kept, count(*) filter (where not ok) as dropped from (select o_custkey in (select c_custkey from customer where c_acctbal > 0) as ok from orders)")
def subset_semi_report(t):
    known = t.customer.filter("c_acctbal > 0").select("c_custkey").withColumn("ok", F.lit(True))
    return t.orders.join(known, F.col("o_custkey") == F.col("c_custkey"), "left").agg(F.count_if(F.col("ok").isNotNull()).alias("kept"), F.count_if(F.col("ok").isNull()).alias("dropped"))


@query("exclusion_reasons", """with big as (select distinct l_orderkey from lineitem where l_quantity >= 50), poor as (select c_custkey from customer where c_acctbal < 0)
  select reason, count(*) as n from (select case when o_orderstatus = 'P' then 'status' when o_orderkey in (select l_orderkey from big) then 'held_item' when o_custkey in (select c_custkey from poor) then 'held_group' else 'keep' end as reason from orders) group by reason""")
def exclusion_reasons(t):
    checks = [
        ("status", F.col("o_orderstatus") == "P"),
        ("held_item", ("o_orderkey", t.lineitem.filter("l_quantity >= 50").select("l_orderkey"))),
        ("held_group", ("o_custkey", t.customer.filter("c_acctbal < 0").select("c_custkey"))),
    ]
    return joins.exclusion_reasons(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), checks).groupBy("reason").agg(F.count("*").alias("n"))


@query("clean_by_project_and_content", f"""with {DOCS}, held as (select source, content from docs where doc_id % 50 = 0), a as (select * from docs where source not in ('src3')), b as (select * from a where content not in (select content from held))
  select (select count(*) from docs) - (select count(*) from a) as by_project, (select count(*) from a) - (select count(*) from b) as by_content, (select count(*) from b) as left_over""")
def clean_by_project_and_content(t):
    d = _docs(t).drop("text")
    held = d.filter("doc_id % 50 = 0").select(F.col("content").alias("h")).distinct().withColumn("hit", F.lit(True))
    x = d.join(held, F.col("content") == F.col("h"), "left").withColumn("p", F.col("source") == "src3")
    return x.agg(F.count_if("p").alias("by_project"), F.count_if(~F.col("p") & F.col("hit").isNotNull()).alias("by_content"), F.count_if(~F.col("p") & F.col("hit").isNull()).alias("left_over"))


@query("archive_paths_collect", "select l_suppkey, l_returnflag, l_linestatus, list_sort(list(distinct l_partkey)) as paths from lineitem group by all")
def archive_paths_collect(t):
    return joins.collect_paths(t.lineitem, ["l_suppkey", "l_returnflag", "l_linestatus"], "l_partkey")


@query("null_safe_mismatch", """with a as (select doc_id, lang, source from documents where doc_id % 7 <> 0), b as (select doc_id, case when doc_id % 5 = 0 then null else lang end as lang, case when doc_id % 11 = 0 then 'x' else source end as source from documents where doc_id % 3 <> 0)
  select count(*) filter (where a.doc_id is not null and b.doc_id is not null) as matched, count(*) filter (where b.doc_id is null) as left_only, count(*) filter (where a.doc_id is null) as right_only,
  count(*) filter (where a.doc_id is not null and b.doc_id is not null and a.lang is distinct from b.lang) as differ_lang, count(*) filter (where a.doc_id is not null and b.doc_id is not null and a.source is distinct from b.source) as differ_source from a full join b on a.doc_id = b.doc_id""")
def null_safe_mismatch(t):
    d = t.documents.select("doc_id", "lang", "source")
    b = d.filter("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.col("source")).alias("source"))
    return joins.mismatch_counts(d.filter("doc_id % 7 <> 0"), b, "doc_id", ["lang", "source"])


@query("paired_difference", """with x as (select user_id, event_type, avg(value) as v from events where event_id % 2 = 0 group by all), y as (select user_id, event_type, avg(value) as v from events where event_id % 2 = 1 group by all)
  select user_id, event_type, y.v - x.v as difference from x join y using (user_id, event_type)""")
def paired_difference(t):
    m = lambda k: t.events.filter(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    a, b = m(0), m(1)
    keys = a.select("user_id", "event_type").intersect(b.select("user_id", "event_type"))
    return joins.paired_difference(a.join(keys, ["user_id", "event_type"], "left_semi"), b.join(keys, ["user_id", "event_type"], "left_semi"), ["user_id", "event_type"], "v")


@query("both_generators", """with g as (select l_partkey, list_sort(list(distinct l_returnflag)) as flags from lineitem where l_returnflag in ('A', 'R') group by 1)
  select len(flags) = 2 as both, count(*) as n from g group by 1""")
def both_generators(t):
    g = t.lineitem.filter("l_returnflag in ('A', 'R')").groupBy("l_partkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return g.groupBy((F.size("flags") == 2).alias("both")).agg(F.count("*").alias("n"))


@query("prefer_sources", """select id, chosen_from, name from (select c_custkey as id, 'customer' as chosen_from, c_name as name, 0 as r from customer where c_custkey % 3 = 0
  union all select s_suppkey, 'supplier', s_name, 1 from supplier) qualify row_number() over (partition by id order by r) = 1""")
def prefer_sources(t):
    return joins.prefer_sources({"customer": t.customer.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))}, "id").select("id", "chosen_from", "name")


@query("role_priority", """with s as (select unnest(['source', 'project']) as kind, unnest([doc_id::varchar, source]) as key, case when doc_id % 10 < 7 then 1 when doc_id % 10 < 9 then 2 else 3 end as rank from documents)
  select kind, key, max(rank)::int as rank from s group by all""")
def role_priority(t):
    d = t.documents.select(F.col("doc_id").alias("source"), F.col("source").alias("project"), F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 9, "val").otherwise("test").alias("role"))
    return splits.role_priority(d, ["source", "project"], "role")


@query("chain_join_pivot", """with c as (select l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) = 1)
  select p_type, max_by(s_name, l_orderkey) filter (where o_orderstatus = 'F') as f, max_by(s_name, l_orderkey) filter (where o_orderstatus = 'O') as o
  from c join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by p_type""")
def chain_join_pivot(t):
    first = dedup.first_wins(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    j = first.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    return j.groupBy("p_type").agg(F.max_by(F.when(F.col("o_orderstatus") == "F", F.col("s_name")), F.when(F.col("o_orderstatus") == "F", F.col("l_orderkey"))).alias("f"), F.max_by(F.when(F.col("o_orderstatus") == "O", F.col("s_name")), F.when(F.col("o_orderstatus") == "O", F.col("l_orderkey"))).alias("o"))


@query("cross_cases_blind", """with c as (select item_id, m, s from benchmark, (values ('text'), ('image')) a(m), (values (1), (2)) b(s))
  select item_id, m as mode, s as seed, row_number() over (order by sha256('4:' || item_id || ':' || m || ':' || s)) as blind_id from c""")
def cross_cases_blind(t):
    from pyspark.sql import Window

    c = t.benchmark.select("item_id", F.explode(F.array(F.lit("text"), F.lit("image"))).alias("mode")).withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2))))
    key = F.concat_ws(":", F.lit("4"), "item_id", "mode", "seed")
    return c.withColumn("blind_id", F.row_number().over(Window.orderBy(F.sha2(key, 256))))  # a benchmark's cases, not the corpus


@query("angle_augmentation", "select doc_id, angle from labels, (values (0), (90), (180), (270)) a(angle)")
def angle_augmentation(t):
    return t.labels.select("doc_id", F.explode(F.array(*map(F.lit, (0, 90, 180, 270)))).alias("angle"))


@query("blind_key_join", """with k as (select item_id, md5('b' || item_id) as blind from benchmark), r as (select md5('b' || item_id) as blind, length(text) % 5 as score from benchmark)
  select item_id, score from k join r using (blind)""")
def blind_key_join(t):
    blind = F.md5(F.concat(F.lit("b"), F.col("item_id").cast("string")))
    k, r = t.benchmark.select("item_id", blind.alias("blind")), t.benchmark.select(blind.alias("blind_r"), (F.length("text") % 5).cast("long").alias("score"))
    j = k.join(r, F.col("blind") == F.col("blind_r"), "full_outer")
    return j.select(F.when(F.col("blind").isNull() | F.col("blind_r").isNull(), F.raise_error(F.lit("review and key hold different ids"))).otherwise(F.col("item_id")).cast("long").alias("item_id"), "score")
