"""Queries: stratified selection, sampling, windows over groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import seeded_order
from ..operators import select as S
from .registry import query

ORD = "sha256('{seed}:' || {col})"


@query("top_n_per_group", f"select source, doc_id from documents qualify row_number() over (partition by source order by {ORD.format(seed=3, col='doc_id')}) <= 5")
def top_n_per_group(t):
    return S.top_per_group(t.documents.select("source", "doc_id"), ["source"], [seeded_order(3, "doc_id")], 5)


@query("first_per_cell", "select p_type, p_brand, p_partkey from part qualify row_number() over (partition by p_type, p_brand order by p_partkey) <= 2")
def first_per_cell(t):
    return S.top_per_group(t.part.select("p_type", "p_brand", "p_partkey"), ["p_type", "p_brand"], ["p_partkey"], 2)


@query("category_rank_order", "select doc_id, lang from documents order by list_position(['de', 'en', 'fr', 'es'], lang), doc_id limit 50")
def category_rank_order(t):
    return t.documents.select("doc_id", "lang").orderBy(F.array_position(F.array(*map(F.lit, ("de", "en", "fr", "es"))), F.col("lang")), "doc_id").limit(50)  # a top-k report


@query("seeded_shuffle_head", f"select o_orderkey from orders order by {ORD.format(seed=8, col='o_orderkey')} limit 100")
def seeded_shuffle_head(t):
    return t.orders.select("o_orderkey").orderBy(seeded_order(8, "o_orderkey")).limit(100)  # a sampling operator


@query("round_robin_strata", f"""with r as (select event_id, event_type, row_number() over (partition by event_type order by {ORD.format(seed=1, col='event_id')}) as r, count(*) over (partition by event_type) as n from events)
  select event_id, event_type from r order by r, n desc, event_type limit 333""")
def round_robin_strata(t):
    return S.round_robin(t.events.select("event_id", "event_type"), "event_type", [seeded_order(1, "event_id")], 333)


@query("nested_round_robin", f"""with a as (select p_partkey, p_type, p_brand, p_name, row_number() over (partition by p_type, p_brand, p_name order by {ORD.format(seed=4, col='p_partkey')}) as n1 from part),
  b as (select *, row_number() over (partition by p_type, p_brand order by n1, {ORD.format(seed=4, col='p_name')}) as n2 from a), c as (select *, row_number() over (partition by p_type order by n2, {ORD.format(seed=4, col='p_brand')}) as n3 from b)
  select p_partkey, p_type from c order by n3, p_type limit 150""")
def nested_round_robin(t):
    return S.nested_round_robin(t.part.select("p_partkey", "p_type", "p_brand", "p_name"), "p_type", "p_brand", "p_name", "p_partkey", 150, 4).select("p_partkey", "p_type")


@query("seven_round_select", f"""with a as (select doc_id, source, lang, n_chars, {ORD.format(seed=2, col='doc_id')} as o from documents),
  r1 as (select doc_id, 1 as round, o from a where lang = 'de' qualify row_number() over (partition by source order by o) <= 2), a2 as (select * from a where doc_id not in (select doc_id from r1)),
  r2 as (select doc_id, 2 as round, o from a2 where n_chars > 3000 qualify row_number() over (partition by source order by o) <= 3), a3 as (select * from a2 where doc_id not in (select doc_id from r2)),
  r3 as (select doc_id, 3 as round, o from a3 where n_chars > 0 qualify row_number() over (partition by lang order by o) <= 10),
  u as (select *, round as part from r1 union all select *, round from r2 union all select *, round from r3 union all select doc_id, 0, o, 4 from a3 where doc_id not in (select doc_id from r3))
  select doc_id, round from u order by part, o limit 160""")
def seven_round_select(t):
    d = t.documents.select("doc_id", "source", "lang", "n_chars")
    return S.capped_rounds(d, "doc_id", [(F.col("lang") == "de", "source", 2), (F.col("n_chars") > 3000, "source", 3), (F.col("n_chars") > 0, "lang", 10)], seeded_order(2, "doc_id"), 160).select("doc_id", "round")


@query("proportional_alloc", """with s as (select event_type, count(*) as size from events group by 1), f as (select *, (777 * size) // (select count(*) from events) as floor from s),
  q as (select *, 777 - sum(floor) over () as short, coalesce(sum(size - floor) over (order by size desc, event_type rows between unbounded preceding and 1 preceding), 0) as before from f),
  k as (select event_type, floor + greatest(0, least(size - floor, short - before)) as quota from q), r as (select event_id, event_type, row_number() over (partition by event_type order by event_id) as r from events)
  select event_id, event_type from r join k using (event_type) where r <= quota""")
def proportional_alloc(t):
    return S.proportional(t.events.select("event_id", "event_type"), "event_type", ["event_id"], 777)


@query("quota_selection", """with q(lang, big, quota) as (values ('en', true, 7), ('de', true, 4), ('fr', false, 5)) select doc_id, d.lang, d.big from (select doc_id, lang, n_chars > 1000 as big, row_number() over (partition by lang, n_chars > 1000 order by doc_id) as r from documents) d join q on q.lang = d.lang and q.big = d.big where r <= quota""")
def quota_selection(t):
    q = t.spark.createDataFrame([("en", True, 7), ("de", True, 4), ("fr", False, 5)], "lang string, big boolean, quota int")
    return S.by_quota(t.documents.select("doc_id", "lang", (F.col("n_chars") > 1000).alias("big")), F.broadcast(q), ["lang", "big"], ["doc_id"])


@query("quota_shortfall", "with q(lang, quota) as (values ('en', 7), ('de', 100000000), ('xx', 3)), h as (select q.lang, q.quota, count(d.lang) as have from q left join documents d using (lang) group by all) select lang, quota, have from h where have < quota")
def quota_shortfall(t):
    q = t.spark.createDataFrame([("en", 7), ("de", 100000000), ("xx", 3)], "lang string, quota int")
    return S.quota_shortfall(t.documents, q, ["lang"])


@query("reservoir_pools", f"select source, doc_id from documents qualify row_number() over (partition by source order by {ORD.format(seed=6, col='doc_id')}, doc_id) <= 3")
def reservoir_pools(t):
    return S.reservoir(t.documents.select("source", "doc_id"), "source", "doc_id", 3, 6)


@query("cyclic_successor", "select s_suppkey, s_nationkey, coalesce(lead(s_suppkey) over w, first_value(s_suppkey) over w) as successor from supplier window w as (partition by s_nationkey order by s_suppkey rows between unbounded preceding and unbounded following)")
def cyclic_successor(t):
    return S.cyclic_successor(t.supplier.select("s_suppkey", "s_nationkey"), "s_nationkey", "s_suppkey")


@query("mixture_draws", """select event_id, case when u < 0.5 then 'a' when u < 0.8 then 'b' else 'c' end as task from (select event_id, ('0x' || substr(sha256('3:' || event_id), 1, 16))::ubigint::double / 18446744073709551616.0 as u from events)""")
def mixture_draws(t):
    return S.mixture_draws(t.events.select("event_id"), "event_id", {"a": 5, "b": 3, "c": 2}, 3, "task")


@query("two_stage_draws", """with g as (select source, count(*) as m, row_number() over (order by source) - 1 as g from documents group by 1), i as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as i from documents),
  d as (select event_id, ('0x' || substr(sha256('5:group:' || event_id), 1, 12))::ubigint % (select count(*) from g)::ubigint as g, ('0x' || substr(sha256('5:member:' || event_id), 1, 12))::ubigint as r from events)
  select d.event_id, g.source, i.doc_id from d join g on g.g = d.g join i on i.source = g.source and i.i = (d.r % g.m::ubigint)""")
def two_stage_draws(t):
    return S.two_stage_draws(t.events.select("event_id"), "event_id", t.documents, "source", "doc_id", 5)


@query("explode_task_views", "select doc_id, view, task, variant from labels, (values ('a', 'text', 1), ('b', 'joint', 2), ('none', 'empty', 0)) v(view, task, variant)")
def explode_task_views(t):
    return S.task_views(t.labels.select("doc_id"), [("a", "text", 1), ("b", "joint", 2), ("none", "empty", 0)])


@query("shard_mod", "select doc_id from (select doc_id, row_number() over (partition by lang order by doc_id) - 1 as rn from documents) where rn % 4 = 1")
def shard_mod(t):
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1
    return t.documents.withColumn("rn", rn).filter("pmod(rn, 4) = 1").select("doc_id")  # the shard is the feature


@query("length_batches", "select doc_id, ceil(log2(greatest(n_chars, 1)))::int as bucket, (row_number() over (partition by ceil(log2(greatest(n_chars, 1))) order by doc_id) - 1) // 16 as batch from documents")
def length_batches(t):
    return S.length_batches(t.documents.select("doc_id", "n_chars"), "n_chars", "doc_id", 16).drop("n_chars")


@query("half_uniform_half_stratified", f"""with a as (select doc_id, source, {ORD.format(seed=9, col='doc_id')} as o from documents), u as (select doc_id, 'uniform' as part from a order by o limit 60), r as (select * from a where doc_id not in (select doc_id from u)),
  s as (select doc_id, 'stratified' as part from r qualify row_number() over (partition by source order by o) <= 3) select * from u union all select * from s""")
def half_uniform_half_stratified(t):
    d = t.documents.select("doc_id", "source")
    u = d.orderBy(seeded_order(9, "doc_id")).limit(60)
    s = S.top_per_group(d.join(u.select("doc_id"), "doc_id", "left_anti"), ["source"], [seeded_order(9, "doc_id")], 3)
    return u.select("doc_id", F.lit("uniform").alias("part")).unionByName(s.select("doc_id", F.lit("stratified").alias("part")))


@query("capped_round_robin")
def capped_round_robin(t):
    return S.capped_round_robin(t.documents, "lang", "source", "doc_id", 60, 4, ["en", "de", "fr", "es"])


@query("dedup_then_round_robin", """with d as (select event_id, event_type, user_id, row_number() over (partition by user_id order by event_id) as k from events), e as (select * from d where k = 1), r as (select *, row_number() over (partition by event_type order by event_id) as r from e)
  select event_id, event_type from r order by r, event_type limit 80""")
def dedup_then_round_robin(t):
    from ..operators.dedup import first_wins

    e = first_wins(t.events.select("event_id", "event_type", "user_id"), ["user_id"], ["event_id"])
    return S.round_robin(e, "event_type", ["event_id"], 80, by_size=False).select("event_id", "event_type")


@query("sample_excluding_earlier", """with early as (select doc_id from labels where doc_id % 3 = 0) select doc_id, quality from labels where doc_id not in (select doc_id from early) qualify row_number() over (partition by quality order by doc_id) <= 20""")
def sample_excluding_earlier(t):
    early = t.labels.filter("doc_id % 3 = 0").select("doc_id")
    return S.top_per_group(t.labels.select("doc_id", "quality").join(early, "doc_id", "left_anti"), ["quality"], ["doc_id"], 20)


@query("category_first_then_fill", """with a as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as r from documents) select doc_id from a order by case when r = 1 then 0 else 1 end, doc_id limit 40""")
def category_first_then_fill(t):
    from pyspark.sql import Window

    first = t.documents.groupBy("lang").agg(F.min("doc_id").alias("doc_id")).select("doc_id").withColumn("p", F.lit(0))
    rest = t.documents.select("doc_id").join(first.select("doc_id"), "doc_id", "left_anti").withColumn("p", F.lit(1))
    return first.unionByName(rest).orderBy("p", "doc_id").limit(40).select("doc_id")


@query("hash_round_robin")
def hash_round_robin(t):
    """languages in turn, one row of each content across all of them."""
    d = t.documents.withColumn("content", F.sha2(F.coalesce("text", F.lit("")), 256))
    return S.capped_round_robin(d, "lang", "content", "doc_id", 80, 1, ["en", "de", "fr", "es"])


@query("cap_after_union", f"""with p as (select doc_id, source from documents where lang = 'en' qualify row_number() over (partition by source order by {ORD.format(seed=3, col='doc_id')}, doc_id) <= 6), q as (select doc_id, source from documents where n_chars > 800 qualify row_number() over (partition by source order by {ORD.format(seed=4, col='doc_id')}, doc_id) <= 6),
  u as (select * from p union select * from q), c as (select * from u qualify row_number() over (partition by source order by {ORD.format(seed=5, col='doc_id')}, doc_id) <= 8) select doc_id, source from c order by {ORD.format(seed=5, col='doc_id')}, doc_id limit 30""")
def cap_after_union(t):
    d = t.documents.select("doc_id", "source", "lang", "n_chars")
    picks = [S.reservoir(d.filter(f), "source", "doc_id", 6, seed).select("doc_id", "source") for f, seed in (("lang = 'en'", 3), ("n_chars > 800", 4))]
    return S.cap_after_union(picks, "doc_id", "source", 8, 30, 5)
