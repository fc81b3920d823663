"""Queries: aggregates, reports, logs, vectors, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize, token_set
from ..operators import aggregates as A
from ..operators import bootstrap, vector, windows
from .registry import query

LOSS = "(10 + value / (1 + event_id % 17))"


@query("grouped_counts", "select source, lang, count(*) as n, count(distinct n_chars) as lengths from documents group by all")
def grouped_counts(t):
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_distinct("n_chars").alias("lengths"))


@query("largest_group", "select max(n) as largest from (select count(*) as n from documents group by source)")
def largest_group(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"))


@query("reason_multiset", """with a as (select case when n_chars > 2000 then 'long' else 'short' end as decision, list_filter([case when lang <> 'en' then 'foreign' end, case when source = 'src0' then 'hot' end, case when n_chars < 500 then 'tiny' end], lambda x: x is not null) as f from documents)
  select decision, reason, count(*) as n from (select decision, unnest(f) as reason from a) group by all""")
def reason_multiset(t):
    f = F.array_compact(F.array(F.when(F.col("lang") != "en", "foreign"), F.when(F.col("source") == "src0", "hot"), F.when(F.col("n_chars") < 500, "tiny")))
    return A.flag_counts(t.documents.select(F.when(F.col("n_chars") > 2000, "long").otherwise("short").alias("decision"), f.alias("flags")), "decision", "flags")


@query("top_group_share", """with s as (select o_custkey, row_number() over (order by count(distinct o_orderdate::date) desc, o_custkey) as r from orders group by 1), o as (select o_orderdate::date as d, o_custkey from orders), c as (select count(distinct d) as n from o)
  select k, (select count(distinct d) from o join s using (o_custkey) where r <= k) / (select n from c) as share from (values (10), (50)) v(k)""")
def top_group_share(t):
    return A.group_share(t.orders.select("o_custkey", F.to_date("o_orderdate").alias("d")), "o_custkey", "d", (10, 50))


@query("vocabulary_coverage", """with v(vocabulary, word) as (values ('color', 'red'), ('color', 'blue'), ('color', 'pink'), ('form', 'ring'), ('form', 'rod')), h as (select distinct p_partkey, unnest(string_split(p_name, ' ')) as word from part)
  select v.vocabulary, count(distinct v.word) as words, count(distinct h.word) as covered, count(distinct p_partkey) as rows from v left join h using (word) group by 1""")
def vocabulary_coverage(t):
    return A.vocabulary_coverage(t.part.select("p_partkey", F.split("p_name", " ").alias("k")), "p_partkey", "k", {"color": ["red", "blue", "pink"], "form": ["ring", "rod"]})


@query("top_dimension_values", """with a as (select unnest(['brand', 'type']) as dimension, unnest([p_brand, p_type]) as value from part), c as (select dimension, value, count(*) as n from a group by all)
  select dimension, value, n, row_number() over (partition by dimension order by n desc, value)::int as rank from c qualify rank <= 12""")
def top_dimension_values(t):
    return A.top_values(t.part.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")), ["brand", "type"], 12)


@query("frequency_histogram", "select n, count(*) as groups from (select p_name, count(*) as n from part group by 1) group by 1")
def frequency_histogram(t):
    return t.part.groupBy("p_name").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("groups"))


@query("macro_means", "select avg(l_quantity) as quantity, avg(l_discount) as discount, avg(l_tax) as tax from lineitem")
def macro_means(t):
    return t.lineitem.agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))


@query("percentiles", "select event_type, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95 from events group by 1")
def percentiles(t):
    return t.events.groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95"))


@query("project_means", """with c as (select l_returnflag, l_suppkey, sum(l_extendedprice) as s, count(*) as n from lineitem group by all)
  select l_returnflag, sum(s) / sum(n) as sample_mean, avg(s / n) as cluster_mean, sum(n)::bigint as n, count(*) as clusters from c group by 1""")
def project_means(t):
    return A.two_level_mean(t.lineitem, ["l_returnflag"], "l_suppkey", "l_extendedprice")


@query("null_excluding_means", "select event_type, avg(case when value > 10 then value end) as mean, count(case when value > 10 then 1 end) as n from events group by 1")
def null_excluding_means(t):
    v = F.when(F.col("value") > 10, F.col("value"))
    return t.events.groupBy("event_type").agg(F.avg(v).alias("mean"), F.count(v).alias("n"))


@query("three_key_means", "select l_returnflag, l_linestatus, l_linenumber, avg(l_quantity) as mean from lineitem group by all")
def three_key_means(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.avg("l_quantity").alias("mean"))


@query("marginal_reports", """select 'all' as dimension, null as level, avg(o_totalprice) as mean, count(*) as n from orders union all select 'status', o_orderstatus, avg(o_totalprice), count(*) from orders group by 2 union all select 'priority', o_orderpriority, avg(o_totalprice), count(*) from orders group by 2""")
def marginal_reports(t):
    return A.marginal_means(t.orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice"), ["status", "priority"], "o_totalprice")


@query("review_summary", """select event_type, count(v) as n, avg(v) as mean, avg(case when v is not null then (v > 15)::int end) as usable_share, count(*) - count(v) as pending from (select event_type, case when event_id % 3 > 0 then value end as v from events) group by 1""")
def review_summary(t):
    e = t.events.select("event_type", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("v"))
    return A.review_summary(e.withColumn("ok", F.col("v") > 15), "event_type", "v", "ok")


@query("review_counts", "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as F, count(*) filter (where o_orderstatus = 'O') as O, count(*) filter (where o_orderstatus = 'X') as X from orders group by 1")
def review_counts(t):
    return A.review_counts(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "X"])


@query("exposure_budget", "select lang, 5000 * 0.25 / count(distinct n_chars) as draws_each, ceil(count(distinct n_chars) * 12 / 64.0)::bigint as steps from documents group by 1")
def exposure_budget(t):
    n = F.count_distinct("n_chars")
    return t.documents.groupBy("lang").agg(A.exposure(n, F.lit(5000.0), F.lit(0.25), F.lit(1.0))[0].alias("draws_each"), A.exposure(n, F.lit(12.0), F.lit(1.0), F.lit(64.0))[1].alias("steps"))


@query("representative_rows", "select source, min_by(doc_id, (lang <> 'en')::int * 1000000000 + doc_id) as doc_id, array_to_string(list_sort(list(distinct lang)), ',') as langs from documents group by 1")
def representative_rows(t):
    rank = F.struct((F.col("lang") != "en").cast("int"), F.col("doc_id"))
    return t.documents.groupBy("source").agg(F.min_by("doc_id", rank).alias("doc_id"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("source_sizes", "select 'customer' as source_set, count(*) as n from customer union all select 'supplier', count(*) from supplier union all select 'part', count(*) from part")
def source_sizes(t):
    parts = [getattr(t, x).select(F.lit(x).alias("source_set")) for x in ("customer", "supplier", "part")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("source_set").agg(F.count("*").alias("n"))


@query("array_length_quantiles", "select q, v from (select unnest([0.0, 0.5, 0.9, 0.99, 1.0]::double[]) as q, unnest(quantile_cont(n, [0.0, 0.5, 0.9, 0.99, 1.0])) as v from (select len(string_split(text, ' ')) as n from documents))")
def array_length_quantiles(t):
    qs = (0.0, 0.5, 0.9, 0.99, 1.0)
    p = t.documents.agg(F.percentile(F.size(F.split("text", " ")), F.array(*map(F.lit, qs))).alias("p"))
    return p.select(F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("p").alias("v"))).alias("x")).select(F.col("x.q").alias("q"), F.col("x.v").alias("v"))


@query("robust_tail_statistics", """with a as (select event_type, value from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 100) select event_type, median(value) as med, avg((value > 20)::int) as clipped, max(value) as top from a group by 1""")
def robust_tail_statistics(t):
    from ..operators.select import top_per_group

    e = top_per_group(t.events.select("event_type", "value", "ts", "event_id"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 100)
    return e.groupBy("event_type").agg(F.median("value").alias("med"), F.avg((F.col("value") > 20).cast("int")).alias("clipped"), F.max("value").alias("top"))


@query("guarded_ratios", "select event_type, coalesce(sum((value > 30)::int) / nullif(sum((value > 20)::int), 0), 0) as share, 0.0 as none from events group by 1")
def guarded_ratios(t):
    n = lambda k: F.sum((F.col("value") > k).cast("int"))
    return t.events.groupBy("event_type").agg(A.guarded_ratio(n(30), n(20)).alias("share"), A.guarded_ratio(n(30), F.lit(0)).alias("none"))


@query("moving_means", "select event_id, avg(round(value * 100)::bigint) over (partition by event_type order by ts, event_id rows between 99 preceding and current row) as moving from events")
def moving_means(t):
    return windows.moving_mean(t.events.select("event_id", "event_type", "ts", F.round(F.col("value") * 100).cast("long").alias("cents")), ["event_type"], ["ts", "event_id"], "cents", 100).select("event_id", "moving")


@query("running_min_flag", """select event_id, min(value) over (w rows between unbounded preceding and current row) as best, coalesce(value < min(value) over (w rows between unbounded preceding and 1 preceding), true) as record from events window w as (partition by event_type order by ts, event_id)""")
def running_min_flag(t):
    return windows.running_best(t.events.select("event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"], "value").select("event_id", "best", "record")


@query("islands_sessions", """with a as (select event_id, user_id, ts, case when value < lag(value) over (partition by user_id order by ts, event_id) then 1 else 0 end as s from events) select event_id, sum(s) over (partition by user_id order by ts, event_id)::bigint as session from a""")
def islands_sessions(t):
    return windows.sessions(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "session")


WINDOWS = """a as (select event_type, value, {loss} as loss, row_number() over (partition by event_type order by ts, event_id) - 1 as r, count(*) over (partition by event_type) as n from events),
  w as (select *, (r - 50) // 20 as win from a where r >= 50 and ((r - 50) // 20 + 1) * 20 <= n - 50),
  b as (select event_type, greatest(median(value), 1e-12) as baseline from a where r >= 20 and r < 50 group by 1),
  m as (select event_type, win, median(loss) as loss_median, median(value) as gradient_median, avg((value > 8)::int) as clipped from w group by all)"""


@query("count_window_medians", f"with {WINDOWS.format(loss=LOSS)} select event_type, win as \"window\", loss_median, gradient_median from m")
def count_window_medians(t):
    e = t.events.select("event_type", "ts", "event_id", "value", (10 + F.col("value") / (1 + F.col("event_id") % 17)).alias("loss"))
    w = windows.count_windows(e, ["event_type"], ["ts", "event_id"], 20, 50)
    return w.groupBy("event_type", "window").agg(F.median("loss").alias("loss_median"), F.median("value").alias("gradient_median"))


@query("bad_streaks", f"""with {WINDOWS.format(loss=LOSS)}, g as (select m.*, min(loss_median) over (partition by m.event_type order by win) as best, baseline from m join b using (event_type)),
  u as (select *, gradient_median > greatest(12.0, 0.5 * baseline) and clipped >= 0.5 and loss_median > 1.001 * best as unhealthy from g),
  i as (select *, sum(case when unhealthy then 0 else 1 end) over (partition by event_type order by win) as island from u), s as (select *, sum(unhealthy::int) over (partition by event_type, island order by win) as bad from i)
  select event_type, win as "window", unhealthy, bad::bigint as bad_windows, bad >= 3 as stop from s""")
def bad_streaks(t):
    e = t.events.select("event_type", "ts", "event_id", "value", (10 + F.col("value") / (1 + F.col("event_id") % 17)).alias("loss"))
    p = windows.GuardPolicy(warmup=20, calibration=30, window=20, patience=3, gradient_clip=8.0, gradient_ratio=0.5, clipped_fraction=0.5, loss_ratio=1.001)
    return windows.stability_windows(e, ["event_type"], ["ts", "event_id"], "loss", "value", p).select("event_type", "window", "unhealthy", "bad_windows", "stop")


@query("resume_prefix", "select user_id as step, max_by(value, event_id) as value from events where user_id <= 90 group by 1")
def resume_prefix(t):
    return windows.resume_prefix(t.events.select(F.col("user_id").alias("step"), "event_id", "value"), "step", "event_id", F.lit(90)).select("step", "value")


@query("loss_transition", "select event_id // 50 as bucket, min(value) as low, avg(value) as mean, max(value) as high from events group by 1")
def loss_transition(t):
    return windows.step_buckets(t.events, "event_id", "value", 50)


@query("rate_samples", """select event_id, round((event_id - first_value(event_id) over w)::double / nullif(epoch_us(ts) / 1e6 - epoch_us(first_value(ts) over w) / 1e6, 0), 9) as rate from events window w as (partition by event_type order by ts, event_id rows between 119 preceding and current row)""")
def rate_samples(t):
    clock = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return windows.rate(t.events.select("event_type", "ts", "event_id"), ["event_type"], ["ts", "event_id"], clock, "event_id", 120).select("event_id", F.round("rate", 9).alias("rate"))


@query("knn_l1", """with q as (select vec_id, embedding from embeddings where vec_id % 20 = 0), d as (select q.vec_id as query, e.vec_id as row, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: abs(x[1]::double - x[2]::double))) / len(q.embedding) as distance from q, embeddings e)
  select query, row from d qualify row_number() over (partition by query order by distance, row) <= 3""")
def knn_l1(t):
    return vector.nearest(t.embeddings.filter("vec_id % 20 = 0"), t.embeddings, "vec_id", "embedding", 3).select("query", "row")


@query("diversity_matrix", """select a.label, round(avg(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: abs(x[1]::double - x[2]::double))) / len(a.embedding)), 9) as diversity, count(*) as pairs from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id group by 1""")
def diversity_matrix(t):
    """The mean over all pairs of a label, from sorted sums of each dimension."""
    e = t.embeddings.select("label", F.posexplode("embedding").alias("dim", "x"))
    gaps = vector.mean_pair_gap(e, ["label", "dim"], "x")
    return gaps.groupBy("label").agg(F.round(F.avg("gap"), 9).alias("diversity"), F.first("pairs").alias("pairs"))


@query("unit_vectors", "select vec_id, list_transform(embedding, lambda x: x::double / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))), 1e-12))[1] as first from embeddings")
def unit_vectors(t):
    return t.embeddings.select("vec_id", vector.unit("embedding")[0].alias("first"))


@query("circular_hues", """with s as (select event_type, sum(value * cos(radians(event_id % 360))) as x, sum(value * sin(radians(event_id % 360))) as y, sum(value) as w from events group by 1)
  select event_type, round(case when degrees(atan2(y, x)) < 0 then degrees(atan2(y, x)) + 360 else degrees(atan2(y, x)) end, 6) as mean, round(sqrt(x * x + y * y) / w, 9) as concentration from s""")
def circular_hues(t):
    c = vector.circular_mean(t.events.withColumn("hue", (F.col("event_id") % 360).cast("double")), "event_type", "hue", "value")
    return c.select("event_type", F.round("mean", 6).alias("mean"), F.round("concentration", 9).alias("concentration"))


@query("histogram_cosine", """with x as (select l_linenumber as k, count(*)::double as x from lineitem where l_returnflag = 'A' group by 1), y as (select l_linenumber as k, count(*)::double as y from lineitem where l_returnflag = 'R' group by 1)
  select round(sum(coalesce(x, 0) * coalesce(y, 0)) / (sqrt(sum(coalesce(x, 0) ** 2)) * sqrt(sum(coalesce(y, 0) ** 2))), 9) as cosine from x full join y using (k)""")
def histogram_cosine(t):
    return vector.histogram_cosine(t.lineitem.filter("l_returnflag = 'A'"), t.lineitem.filter("l_returnflag = 'R'"), "l_linenumber").select(F.round("cosine", 9).alias("cosine"))


@query("structure_correlation", "select l_returnflag, round(corr(l_quantity, l_extendedprice), 9) as r from lineitem group by 1")
def structure_correlation(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 9).alias("r"))


CODE = "list_reduce(list_prepend(0::ubigint, list_transform(range(1, 65), lambda i: case when {v}[i]::double > list_avg(list_transform({v}, lambda e: e::double)) then 1::ubigint else 0::ubigint end)), lambda s, x: ((s & 9223372036854775807) << 1) | x)"


@query("perceptual_hash_retrieval", f"""with v as (select vec_id, embedding, list_transform(embedding, lambda x: round(x::double, 1)) as coarse from embeddings), h as (select vec_id, {CODE.format(v='embedding')} as code, {CODE.format(v='coarse')} as asked from v),
  d as (select q.vec_id as query, r.vec_id as row, bit_count(xor(q.asked, r.code))::int as distance from h q, h r where q.vec_id % 20 = 0), n as (select * from d qualify row_number() over (partition by query order by distance, row) = 1)
  select query, row, distance, row = query as hit from n""")
def perceptual_hash_retrieval(t):
    """Each query's hash is taken from its vector rounded to one decimal; the nearest stored hash should be its own."""
    e = t.embeddings.select("vec_id", vector.sign_hash("embedding").alias("code"))
    q = t.embeddings.filter("vec_id % 20 = 0").select("vec_id", vector.sign_hash(F.transform("embedding", lambda x: F.round(x.cast("double"), 1))).alias("code"))
    return vector.hamming_retrieval(q, e, "vec_id", "code").withColumn("hit", F.col("row") == F.col("query"))


@query("bootstrap_ci", """with m as (select l_returnflag as grp, l_suppkey as cluster, avg(l_quantity) as mean from lineitem group by all), r as (select grp, mean, row_number() over (partition by grp order by cluster) - 1 as i from m),
  s as (select grp, count(*) as n, avg(mean) as estimate from r group by 1), d as (select grp, n, b, unnest(range(0, n)) as k from s, range(0, 200) x(b)),
  p as (select d.grp, b, avg(mean) as m from d join r on r.grp = d.grp and r.i = (('0x' || substr(md5('0:' || d.grp || ':' || b || ':' || k), 1, 12))::bigint % n) group by all)
  select s.grp as "group", s.n, round(any_value(s.estimate), 9) as estimate, round(quantile_cont(m, 0.025), 9) as low, round(quantile_cont(m, 0.975), 9) as high from s join p using (grp) group by all""")
def bootstrap_ci(t):
    b = bootstrap.cluster_bootstrap(t.lineitem, "l_returnflag", "l_suppkey", "l_quantity", resamples=200)
    return b.select("group", "n", *[F.round(c, 9).alias(c) for c in ("estimate", "low", "high")])


@query("paired_bootstrap_ci", """with x as (select l_linestatus as grp, l_suppkey as cluster, avg(l_quantity) filter (where l_returnflag = 'A') - avg(l_quantity) filter (where l_returnflag = 'R') as diff from lineitem group by all), r as (select grp, diff, row_number() over (partition by grp order by cluster) - 1 as i from x where diff is not null),
  s as (select grp, count(*) as n, avg(diff) as estimate from r group by 1), d as (select grp, n, b, unnest(range(0, n)) as k from s, range(0, 200) y(b)),
  p as (select d.grp, b, avg(diff) as m from d join r on r.grp = d.grp and r.i = (('0x' || substr(md5('7:' || d.grp || ':' || b || ':' || k), 1, 12))::bigint % n) group by all)
  select s.grp as "group", s.n, round(any_value(s.estimate), 9) as estimate, round(quantile_cont(m, 0.025), 9) as low, round(quantile_cont(m, 0.975), 9) as high from s join p using (grp) group by all""")
def paired_bootstrap_ci(t):
    d = t.lineitem.groupBy("l_linestatus", "l_suppkey").agg((F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))) - F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")))).alias("diff"))
    b = bootstrap.cluster_bootstrap(d, "l_linestatus", "l_suppkey", "diff", resamples=200, seed=7)
    return b.select("group", "n", *[F.round(c, 9).alias(c) for c in ("estimate", "low", "high")])


@query("caption_f1", """with a as (select conv_id, turn, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) as s from conversations), p as (select a.conv_id, a.turn, a.s as x, b.s as y, len(list_intersect(a.s, b.s)) as o from a join a b on b.conv_id = a.conv_id and b.turn = a.turn + 1)
  select conv_id, turn, case when len(x) = 0 and len(y) = 0 then 1.0 when len(x) = 0 or len(y) = 0 or o = 0 then 0.0 else 2.0 * (o / len(x)) * (o / len(y)) / (o / len(x) + o / len(y)) end as f1 from p""")
def caption_f1(t):
    from ..functions.scores import set_f1

    c = t.conversations
    a = c.select("conv_id", "turn", token_set("text").alias("x"))
    b = c.select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t2"), token_set("text").alias("y"))
    return a.join(b, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2"))).select("conv_id", "turn", set_f1("x", "y").alias("f1"))


@query("scalar_matches", """select p_partkey, (trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(split_part(p_name, ' ', 2) || '-' || split_part(p_name, ' ', 1) || case when p_size % 2 = 0 then ' x' else '' end), '[^a-z0-9]+', ' ', 'g')) or p_size % 2 = 1)::int as matched from part""")
def scalar_matches(t):
    from ..functions.scores import scalar_match

    k = F.split("p_name", " ")
    other = F.concat(k[1], F.lit("-"), k[0], F.when(F.col("p_size") % 2 == 0, " x").otherwise(""))
    return t.part.select("p_partkey", scalar_match("p_name", other).alias("matched"))


@query("latency_attach", """select source, count(n) as timed, quantile_cont(n, 0.5) as p50, coalesce(array_to_string(list_sort(list(distinct case when n is not null then lang end)), ','), '') as models from (select source, lang, case when doc_id % 4 > 0 then n_chars end as n from documents) group by 1""")
def latency_attach(t):
    d = t.documents.select("source", "lang", F.when(F.col("doc_id") % 4 > 0, F.col("n_chars")).alias("n"))
    return d.groupBy("source").agg(F.count("n").alias("timed"), F.percentile("n", F.lit(0.5)).alias("p50"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("n").isNotNull(), F.col("lang")))), ",").alias("models"))


@query("metric_matrix", "select l_returnflag, avg(l_tax) filter (where l_linestatus = 'F') as F, avg(l_tax) filter (where l_linestatus = 'O') as O from lineitem group by 1")
def metric_matrix(t):
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_tax"))


@query("pairwise_response", """with a as (select row_number() over (order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) as i, l_partkey, l_quantity from lineitem) select x.l_partkey, count(*) as pairs, round(avg(abs(x.l_quantity - y.l_quantity)), 9) as response from a x join a y on x.l_partkey = y.l_partkey and x.i < y.i group by all""")
def pairwise_response(t):
    """The rows of a part stand for one text that was asked in several ways."""
    gaps = vector.mean_pair_gap(t.lineitem, ["l_partkey"], "l_quantity").filter("pairs > 0")
    return gaps.select("l_partkey", "pairs", F.round("gap", 9).alias("response"))


@query("response_magnitude", """with x as (select user_id, avg(value) filter (where event_type = 'view') as a, avg(value) filter (where event_type = 'click') as b from events group by 1) select avg(abs(a - b)) as magnitude, avg((a = b)::int) as equal_share from x where a is not null and b is not null""")
def response_magnitude(t):
    v = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    x = t.events.groupBy("user_id").agg(v("view").alias("a"), v("click").alias("b")).dropna()
    return x.agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("magnitude"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("equal_share"))


@query("changed_fraction", "select a.vec_id, len(list_filter(list_zip(a.embedding, b.embedding), lambda x: abs(x[1]::double - x[2]::double) > 0.5)) / len(a.embedding) as changed from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def changed_fraction(t):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("v2"), F.col("embedding").alias("e2"))
    d = F.zip_with("embedding", "e2", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return t.embeddings.join(b, F.col("vec_id") == F.col("v2")).select("vec_id", (F.size(F.filter(d, lambda x: x > 0.5)) / F.size("embedding")).alias("changed"))


@query("revision_counts", "select count(*) filter (where a = '') as empty_before, count(*) filter (where b = '') as empty_after, count(*) filter (where a = '' and b <> '') as recovered, count(*) filter (where contains(b, '-')) as separators from (select case when p_size % 5 = 0 then '' else p_name end as a, case when p_size % 10 = 0 then '' else replace(p_name, 'red ', 'red-') end as b from part)")
def revision_counts(t):
    p = t.part.select(F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_name")).alias("a"), F.when(F.col("p_size") % 10 == 0, "").otherwise(F.replace("p_name", F.lit("red "), F.lit("red-"))).alias("b"))
    return p.agg(F.count_if(F.col("a") == "").alias("empty_before"), F.count_if(F.col("b") == "").alias("empty_after"), F.count_if((F.col("a") == "") & (F.col("b") != "")).alias("recovered"), F.count_if(F.contains("b", F.lit("-"))).alias("separators"))


@query("asset_registry", "select o_custkey, list_sort(list(distinct o_orderstatus)) as archives, count(distinct o_orderpriority) > 1 as conflict from orders group by 1")
def asset_registry(t):
    return t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("archives"), (F.count_distinct("o_orderpriority") > 1).alias("conflict"))


@query("normalized_texts", "select conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as text from conversations")
def normalized_texts(t):
    return t.conversations.select("conv_id", "turn", normalize("text").alias("text"))
