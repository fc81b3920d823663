"""Queries: JSON fields, evidence, captions, the review ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import repair
from ..operators import ledger
from .registry import query


@query("exact_json_keys", "select event_id, event_id % 3 <> 0 as exact from events")
def exact_json_keys(t):
    js = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"z": 1, '), F.expr("substring(props, 2)"))).otherwise(F.col("props"))
    return t.events.select("event_id", E.exact_keys(js, ["k"]).alias("exact"))


@query("coerce_annotations", """select p_partkey, p_name as name, case when p_size % 2 = 0 then split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) when p_size % 3 = 0 then '' else p_type end as tags, p_size % 4 = 0 as emissive, case when p_size % 5 = 0 then 0.0 else p_size / 10.0 end::double as doubt from part""")
def coerce_annotations(t):
    k = F.split("p_name", " ")
    tags = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('["'), k[0], F.lit('", " ", "'), k[1], F.lit('"]'))).when(F.col("p_size") % 3 == 0, F.lit('""')).otherwise(F.concat(F.lit('"'), "p_type", F.lit('"')))
    doubt = F.when(F.col("p_size") % 5 == 0, F.lit('"much"')).otherwise((F.col("p_size") / 10).cast("string"))
    js = F.concat(F.lit('{"name": " '), "p_name", F.lit(' ", "tags": '), tags, F.lit(', "emissive": '), F.when(F.col("p_size") % 4 == 0, '"Yes"').otherwise("false"), F.lit(', "doubt": '), doubt, F.lit("}"))
    c = t.part.select("p_partkey", E.coerce(js, ["name"], ["tags"], ["emissive"], ["doubt"]).alias("c"))
    return c.select("p_partkey", "c.name", F.array_join("c.tags", "|").alias("tags"), "c.emissive", "c.doubt")


@query("semantic_merge", """with a as (select p_partkey, p_size, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] as w1, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] as w2, lower(p_type) as v from part)
  select p_partkey, case when p_size % 3 = 0 then w1 || ' ' || w2 || ' 7' else 'fine ' || lower(w2) || ' ' || lower(w1) end as effective_name, case when p_size % 3 = 0 or p_size % 5 = 0 then 'quarantine' else 'candidate' end as status,
  array_to_string(list_filter([case when p_size % 5 = 0 then 'name_uncertain' end, case when p_size % 3 = 0 then 'name_information_loss' end], lambda x: x is not null), ',') as flags from a""")
def semantic_merge(t):
    k = F.split("p_name", " ")
    name = F.concat(F.lit("item."), F.initcap(k[0]), F.initcap(k[1]), F.lit("_7.png"))
    proposed = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("fine "), k[1])).otherwise(F.concat(F.lit("fine  "), k[1], F.lit(" "), k[0]))
    m = E.semantic_merge(name, proposed, F.when(F.col("p_size") % 5 == 0, "uncertain").otherwise("compatible"), F.lower("p_type"), F.array().cast("array<string>"))
    return t.part.select("p_partkey", m.alias("m")).select("p_partkey", "m.effective_name", "m.status", F.array_join("m.flags", ",").alias("flags"))


@query("evidence_decisions", """with a as (select p_partkey, p_name, lower(p_type) as c, p_size % 7 = 0 as f1, p_size % 11 = 0 as f2, p_size % 3 <> 0 as ok from part)
  select p_partkey, case when not (f1 or f2) and ok then p_name end as file_label, case when not (f1 or f2) then c end as visual_label, case when f1 or f2 then 'quarantine' else 'eligible' end as decision,
  array_to_string(list_sort(list_filter([case when f1 then 'small' end, case when f2 then 'layer' end, case when not ok then 'filename_identity_unverified' end], lambda x: x is not null)), ',') as flags from a""")
def evidence_decisions(t):
    d = E.evidence_decision({"small": F.col("p_size") % 7 == 0, "layer": F.col("p_size") % 11 == 0}, F.col("p_name"), F.col("p_size") % 3 != 0, F.lower("p_type"))
    return t.part.select("p_partkey", d.alias("d")).select("p_partkey", "d.file_label", "d.visual_label", "d.decision", F.array_join("d.flags", ",").alias("flags"))


@query("caption_supervision", """select p_partkey, case when p_size % 9 = 0 then 'manual' when p_size % 7 = 0 then 'annotation_flags:a,b' when p_size % 5 = 0 then 'missing_descriptive_text' when p_size % 3 = 0 then 'identifier_separators_in_description' end as rejection,
  case when p_size % 9 = 0 or p_size % 7 = 0 or p_size % 5 = 0 or p_size % 3 = 0 then 'short' else 'short,long' end as variants from part""")
def caption_supervision(t):
    p = F.col("p_size")
    s = E.caption_supervision(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(p % 5 == 0, " ").when(p % 3 == 0, "a_b").otherwise("a long text"), F.when(p % 7 == 0, F.array(F.lit("b"), F.lit("x"), F.lit("a"))), ["a", "b", "c"], F.when(p % 9 == 0, "manual"))
    return t.part.select("p_partkey", s.alias("s")).select("p_partkey", "s.rejection", F.array_join("s.variants", ",").alias("variants"))


@query("style_views", """select p_partkey, p_name as plain, case when p_size % 2 = 0 then lower(p_type) else p_name end as rich, p_name as third from part""")
def style_views(t):
    js = F.concat(F.lit('{"plain": " '), F.upper("p_name"), F.lit('", "rich": "'), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_name")), F.lit('"}'))
    v = E.style_views(js, ["plain", "rich", "third"])
    return t.part.select("p_partkey", v.alias("v")).select("p_partkey", *[F.col("v")[i]["text"].alias(n) for i, n in enumerate(("plain", "rich", "third"))])


@query("caption_unpivot", "select doc_id || '#0' as id, lang as text from documents union all select doc_id || '#1', source from documents")
def caption_unpivot(t):
    return t.documents.select(E.unpivot_variants("doc_id", F.array("lang", "source")).alias("x")).select("x.*")


@query("two_arm_catalog", "select doc_id, arm, case arm when 'short' then lang else source end as text from documents, (values ('short'), ('long')) a(arm)")
def two_arm_catalog(t):
    d = t.documents.select("doc_id", "lang", "source", F.explode(F.array(F.lit("short"), F.lit("long"))).alias("arm"))
    return d.select("doc_id", "arm", F.when(F.col("arm") == "short", F.col("lang")).otherwise(F.col("source")).alias("text"))


@query("pipe_lists", "select p_partkey, split_part(p_name, ' ', 1) as first, 2 as n from part")
def pipe_lists(t):
    k = F.split("p_name", " ")
    v = E.from_pipes(F.concat(k[0], F.lit(" | |"), k[1], F.lit("|")))
    return t.part.select("p_partkey", v[0].alias("first"), F.size(v).alias("n"))


@query("property_lines", "select p_partkey, p_name as name, 'b=c' as eq, p_type as kind from part")
def property_lines(t):
    text = F.concat(F.lit("#x=1\nname = old\nname="), "p_name", F.lit("\nnothing\neq=b=c\nkind="), "p_type")
    m = E.properties(text)
    return t.part.select("p_partkey", m["name"].alias("name"), m["eq"].alias("eq"), m["kind"].alias("kind"))


@query("json_repair", """select event_id, case when event_id % 4 = 3 then 1 else json_extract(props, '$.k')::int end as k from events""")
def json_repair(t):
    broken = (
        F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n``` done")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "next": {"a": [1, "un'))).otherwise(F.lit('{"k": 1, "half'))
    )
    return t.events.select("event_id", F.get_json_object(repair.read_json(broken), "$.k").cast("int").alias("k"))


EVENTS = "e as (select event_id + 1 as revision, user_id as pair_id, case event_id % 4 when 0 then 'keep' when 1 then 'reject' when 2 then 'unsure' else 'keep' end as state, event_id % 4 = 3 as selected, event_id % 5 = 4 as undo from events)"


def _events(t):
    e = F.col("event_id")
    state = F.when(e % 4 == 1, "reject").when(e % 4 == 2, "unsure").otherwise("keep")
    return t.events.select((e + 1).alias("revision"), F.col("user_id").alias("pair_id"), state.alias("state"), (e % 4 == 3).alias("selected"), F.lit("").alias("reason"), F.lit("").alias("note"), (e % 5 == 4).alias("undo"))


LIVE = f"{EVENTS}, h as (select *, sum(case when undo then -1 else 1 end) over (order by revision) as height from e), l as (select h.* from h where not undo and not exists (select 1 from h u where u.undo and u.revision > h.revision and u.height < h.height)), c as (select * from l qualify row_number() over (partition by pair_id order by revision desc) = 1)"


@query("ledger_current", f"with {LIVE} select pair_id, revision, state, selected from c")
def ledger_current(t):
    return ledger.current(_events(t)).select("pair_id", "revision", "state", "selected")


PAIRS = "p as (select distinct user_id as pair_id, case when user_id % 3 = 0 then 'val' else 'train' end as split from events)"


def _pairs(t):
    return t.events.select(F.col("user_id").alias("pair_id")).distinct().withColumn("split", F.when(F.col("pair_id") % 3 == 0, "val").otherwise("train"))


@query("ledger_summary", f"with {LIVE}, {PAIRS} select split, count(*) filter (where coalesce(state, 'pending') = 'pending') as pending, count(*) filter (where state = 'keep') as keep, count(*) filter (where state = 'reject') as reject, count(*) filter (where state = 'unsure') as unsure from p left join c using (pair_id) group by 1")
def ledger_summary(t):
    return ledger.summary(_pairs(t), ledger.current(_events(t)))


@query("ledger_export", f"with {LIVE}, {PAIRS} select pair_id, split from p left join c using (pair_id) where (split = 'train' and state = 'keep' and selected) or (split = 'val' and coalesce(state, 'pending') <> 'reject')")
def ledger_export(t):
    return ledger.export(_pairs(t), ledger.current(_events(t)))


BATCH = "b as (select pair_id, case when pair_id % 4 = 0 then 'keep' when pair_id % 4 = 1 then 'gone' when pair_id % 4 = 2 then 'reject' end as ns, pair_id % 2 = 0 as sel from p union all select 100000, 'keep', false)"


def _batch(t):
    p = _pairs(t).select("pair_id").unionByName(t.spark.createDataFrame([(100000,)], "pair_id long"))
    k = F.col("pair_id")
    state = F.when(k == 100000, "keep").when(k % 4 == 0, "keep").when(k % 4 == 1, "gone").when(k % 4 == 2, "reject")
    return p.select("pair_id", state.alias("state"), F.when(k == 100000, False).otherwise(k % 2 == 0).alias("selected"), F.lit(None).cast("string").alias("reason"), F.when(k % 6 == 0, "seen").alias("note"))


@query("ledger_violations", f"""with {LIVE}, {PAIRS}, {BATCH}, j as (select b.pair_id, split, sel, coalesce(ns, state, 'pending') as eff from b left join p using (pair_id) left join c using (pair_id)),
  r as (select pair_id, unnest(list_filter([case when split is null then 'unknown_pair' end, case when eff not in ('pending', 'keep', 'reject', 'unsure') then 'unknown_state' end, case when sel and eff <> 'keep' then 'selected_but_not_kept' end, case when sel and split <> 'train' then 'selected_outside_train' end], lambda x: x is not null)) as rule from j) select rule, pair_id from r""")
def ledger_violations(t):
    return ledger.violations(_batch(t), _pairs(t), ledger.current(_events(t)))


@query("ledger_next_events", f"""with {LIVE}, {PAIRS}, {BATCH}, j as (select b.pair_id, coalesce(state, 'pending') as bs, coalesce(ns, state, 'pending') as af, coalesce(sel, selected, false) as s, coalesce(selected, false) as os, case when b.pair_id % 6 = 0 then 'seen' else '' end as note from b left join c using (pair_id))
  select (select max(revision) + 1 from e) as revision, pair_id, af as state, (s and af = 'keep') as selected, note from j where not (af = bs and (s and af = 'keep') = os and note = '')""")
def ledger_next_events(t):
    events = _events(t)
    return ledger.next_events(_batch(t), ledger.current(events), ledger.next_revision(events)).select("revision", "pair_id", "state", "selected", "note")
