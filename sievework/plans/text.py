"""Queries: names, captions, licences, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .registry import query

COLORS, FORMS = ["red", "blue"], ["ring", "bolt", "rod", "plate", "gear"]
IDENT = "p_brand || '_' || p_name || '__' || p_type || '.' || p_size || '_' || p_type"
CAMEL = "'item.' || upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || p_type || upper(p_name[1]) || 'ab' || p_size || '.png'"


def _parts(t):
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    camel = F.concat(F.lit("item."), F.initcap(first), F.initcap(second), F.col("p_type"), F.upper(F.substring("p_name", 1, 1)), F.lit("ab"), F.col("p_size").cast("string"), F.lit(".png"))
    ident = F.concat(F.col("p_brand"), F.lit("_"), F.col("p_name"), F.lit("__"), F.col("p_type"), F.lit("."), F.col("p_size").cast("string"), F.lit("_"), F.col("p_type"))
    return t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", ident.alias("ident"), camel.alias("camel"))


TOK = f"list_filter(regexp_split_to_array(lower({IDENT}), '[_\\-.\\s]+'), lambda x: x <> '')"


@query("name_tokens", f"""with a as (select p_partkey, list_filter({TOK}, lambda x: x not in ('small', 'new') and not regexp_full_match(x, '[0-9]+')) as k, {TOK} as tokens from part)
  select p_partkey, array_to_string(tokens, '|') as tokens, array_to_string(list_filter(k, lambda x, i: i = 1 or x <> k[i - 1]), '|') as concept from a""")
def name_tokens(t):
    p = _parts(t)
    return p.select("p_partkey", F.array_join(X.identifier_tokens("ident"), "|").alias("tokens"), F.array_join(X.concept_tokens("ident", ["small", "new"]), "|").alias("concept"))


@query("label_tokens", """with a as (select p_partkey, regexp_split_to_array(lower(p_name), '[_\\-.\\s]+') as k, lower(p_type) as noise from part), b as (select *, list_filter(k, lambda x: x not in ('ring', 'red') and x <> noise) as s from a)
  select p_partkey, array_to_string(case when len(s) > 0 then s else k end, ' ') as label from b""")
def label_tokens(t):
    return t.part.select("p_partkey", F.array_join(X.label_tokens("p_name", ["ring", "red"], ["p_type"]), " ").alias("label"))


@query("prompt_views", """with a as (select p_partkey, p_name as c, split_part(p_name, ' ', 1) as a1, split_part(p_name, ' ', 2) as a2 from part),
  b as (select *, case when a1 in ('red', 'blue') then a1 || ' ' || a2 when a2 in ('ring', 'bolt', 'rod', 'plate', 'gear') then c else a1 end as s from a)
  select p_partkey, c || '|' || case when substr(c, 1, 1) in ('a', 'e', 'i', 'o', 'u') then 'an ' else 'a ' end || c || case when s <> c then '|' || s else '' end as views from b""")
def prompt_views(t):
    return t.part.select("p_partkey", F.array_join(X.prompt_views(X.identifier_tokens("p_name"), COLORS, FORMS), "|").alias("views"))


@query("type_words", "select p_partkey, case when lower(p_type) like 'pro%' then 'item' else 'block' end as word from part")
def type_words(t):
    return t.part.select("p_partkey", X.type_word(F.when(F.lower("p_type").startswith("pro"), "Item.X").otherwise(F.col("p_type"))).alias("word"))


@query("label_validation", f"select doc_id, regexp_matches(lower(text), '\\bthes?\\b') and regexp_matches(lower(text), '\\bofs?\\b') and regexp_matches(lower(text), '\\bands?\\b') as valid from documents")
def label_validation(t):
    return t.documents.select("doc_id", X.label_valid("text", F.array(F.lit("the"), F.lit("of")), F.lit("and")).alias("valid"))


@query("parse_names", """with a as (select p_partkey, string_split(p_name, ' ') || [lower(p_type), 'hot', 'hot'] as k from part)
  select p_partkey, list_filter(k, lambda x: x in ('ring', 'bolt', 'medium'))[1] as material, list_filter(k, lambda x: x in ('rod', 'plate', 'small', 'large'))[1] as form, array_to_string(list_filter(k, lambda x: x in ('cold', 'old')), ',') || case when k[1] in ('cold', 'old') then ',' else '' end || 'hot' as state from a where k[1] <> 'hot'""")
def parse_names(t):
    p = t.part.filter("p_name not like 'hot%'").select("p_partkey", X.parse_name(F.concat("p_name", F.lit("_"), F.lower("p_type"), F.lit("-hot hot")), ["ring", "bolt", "medium", "hot"], ["rod", "plate", "small", "large"], ["hot", "cold", "old"]).alias("n"))
    return p.select("p_partkey", "n.material", "n.form", F.array_join("n.state", ",").alias("state"))


@query("weak_prompts", """with a as (select p_partkey, p_name, string_split(p_name, ' ') as k from part)
  select p_partkey, coalesce(nullif(concat_ws(' ', case when k[1] in ('hot', 'cold') then k[1] end, case when k[2] in ('rod', 'plate') then k[2] end, case when k[2] in ('ring', 'bolt') then k[2] end), ''), p_name) || ', icon' as prompt from a""")
def weak_prompts(t):
    return t.part.select("p_partkey", X.weak_prompt(X.parse_name("p_name", ["ring", "bolt"], ["rod", "plate"], ["hot", "cold"]), "p_name", ", icon").alias("prompt"))


@query("camel_tokens", f"""select p_partkey, array_to_string(regexp_extract_all(lower(regexp_replace(regexp_replace({CAMEL}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[a-z]+|[0-9]+'), ' ') as tokens,
  array_to_string(list_filter(regexp_split_to_array(regexp_replace(replace(replace({CAMEL}, '.png', ''), 'item.', ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> ''), ' ') as words from part""")
def camel_tokens(t):
    p = _parts(t)
    return p.select("p_partkey", F.array_join(X.camel_tokens("camel"), " ").alias("tokens"), F.array_join(X.filename_words("camel"), " ").alias("words"))


@query("resource_policy", """with a as (select p_partkey, ['item', split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), 'frame', p_size::varchar] as tokens, split_part(p_name, ' ', 1) as a1, split_part(p_name, ' ', 2) as a2, p_type from part),
  b as (select *, list_filter([a1, a2], lambda x: x <> 'hot') as kept, list_sort(list_filter([case when a1 = 'old' then 'layer' end, case when a2 in ('rod', 'plate') then 'component' end, case when p_type = 'PROMO' then 'path_layer' end], lambda x: x is not null)) as reasons from a)
  select p_partkey, array_to_string(kept, ' ') as candidate_text, array_to_string(reasons, ',') as reasons, case when len(reasons) > 0 then 'quarantine' else 'keep' end as decision, array_to_string(list_filter(tokens, lambda x: not list_contains(kept, x)), ' ') as removed from b""")
def resource_policy(t):
    name = F.concat(F.lit("dir/item_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_frame"), F.col("p_size").cast("string"), F.lit(".PNG"))
    paths = F.array(F.concat(F.lit("a/"), F.lower("p_type"), F.lit("/x")))
    n = X.resource_policy(name, paths, {"layer": ["old"], "component": ["rod", "plate"]}, {"path_layer": ["/promo/"]}, ["hot"], FORMS)
    return t.part.select("p_partkey", n.alias("n")).select("p_partkey", "n.candidate_text", F.array_join("n.reasons", ",").alias("reasons"), "n.decision", F.array_join("n.removed_tokens", " ").alias("removed"))


@query("strip_boilerplate", """with a as (select p_partkey, 'The a ' || p_name || ', Icon art; of / ' || lower(p_type) || ' and' as v from part), b as (select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(v, 'icon art', ' ', 'gi'), '[,;|/]+', ' ', 'g'), '\\s+', ' ', 'g')) as v from a)
  select p_partkey, regexp_replace(regexp_replace(regexp_replace(v, '^(a|an|the|of)\\s+', '', 'i'), '^(a|an|the|of)\\s+', '', 'i'), '\\s+(a|an|the|of|and|with|or|in|on)$', '', 'i') as text from b""")
def strip_boilerplate(t):
    v = F.concat(F.lit("The a "), "p_name", F.lit(", Icon art; of / "), F.lower("p_type"), F.lit(" and"))
    return t.part.select("p_partkey", X.strip_boilerplate(v, ["icon art"]).alias("text"))


@query("remove_word", f"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\bthe\\b', '', 'gi'), '\\s+', ' ', 'g'), '\\s+([,.;])', '\\1', 'g')) as text from documents")
def remove_word(t):
    return t.documents.select("doc_id", X.remove_word("text", "the").alias("text"))


@query("token_sets", f"select doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))), ' ') as tokens from documents")
def token_sets(t):
    return t.documents.select("doc_id", F.array_join(X.token_set("text"), " ").alias("tokens"))


RULES = {"metal": ["bolt", "gear", " rod"], "flat": ["plate", "ring"], "tint": ["red ", "blue "]}


@query("keyword_categories", """with a as (select p_partkey, ' ' || p_name || ' ' as v from part), b as (select p_partkey, list_filter([case when v like '%bolt%' or v like '%gear%' or v like '% rod%' then 'metal' end, case when v like '%plate%' or v like '%ring%' then 'flat' end, case when v like '%red %' or v like '%blue %' then 'tint' end], lambda x: x is not null) as c from a)
  select p_partkey, coalesce(c[1], 'other') as primary_category, case when len(c) = 0 then 'other' else array_to_string(c, ',') end as categories from b""")
def keyword_categories(t):
    c = X.keyword_categories("p_name", RULES)
    return t.part.select("p_partkey", c[0].alias("primary_category"), F.array_join(c, ",").alias("categories"))


@query("noun_categories", """select p_partkey, case when regexp_matches(p_name, '\\brings?\\b') and not regexp_matches(p_name, 'hot|cold') then 'jewel' when regexp_matches(p_name, '\\bbolts?\\b') then 'metal' end as category,
  case split_part(p_name, ' ', 2) when 'gizmo' then 'gadget' when 'widget' then 'widget' else case when split_part(p_name, ' ', 1) in ('red') then 'red' end end as last_noun from part""")
def noun_categories(t):
    return t.part.select("p_partkey", X.noun_category("p_name", {"ring": "jewel", "bolt": "metal"}, {"ring": "hot|cold"}).alias("category"), X.last_noun("p_name", ["red", "gizmo", "widget"], {"gizmo": "gadget"}).alias("last_noun"))


@query("caption_assembly", """select p_partkey, case when p_size % 2 = 0 then p_name || '|A ' || p_name || ' seen' else p_name || '|' || p_name || '. Thing' end as captions from part""")
def caption_assembly(t):
    d = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("ICON:  A "), "p_name", F.lit("  seen. Keep all of it."))).otherwise(F.lit("icon: Thing . Without frame"))
    return t.part.select("p_partkey", F.array_join(X.assemble_caption("p_name", d, "icon:", ["Keep all", "Without"]), "|").alias("captions"))


@query("style_and_prefix", "select p_partkey, case when p_size % 3 = 0 then '' else 'hd: ' || p_name end as styled, case when p_name like 'red %' then substr(p_name, 5) else p_name end as bare from part")
def style_and_prefix(t):
    return t.part.select("p_partkey", X.style_prefix("hd", F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_name"))).alias("styled"), X.without_prefix("p_name", "red ").alias("bare"))


@query("split_from_names", "select page_id, case when contains(lower(url), 'validation') or regexp_matches(lower(url), '(^|[^a-z])val([^a-z]|$)') then 'val' when contains(lower(url), 'test') then 'test' else 'train' end as split from pages")
def split_from_names(t):
    return t.pages.select("page_id", X.split_from_name("url").alias("split"))


@query("grid_hints", "select p_partkey, case when p_size % 3 = 0 then p_size end as grid from part")  # SQL of this dialect has no back-reference
def grid_hints(t):
    name = F.concat(F.lit("sheet_"), F.col("p_size").cast("string"), F.lit("x"), (F.col("p_size") + F.when(F.col("p_size") % 3 == 0, 0).otherwise(100)).cast("string"), F.lit(".png"))
    return t.part.select("p_partkey", X.grid_hint(name).alias("grid"))


@query("ngram_counts", """with a as (select string_split(p_name, ' ') as k, p_name from part), g as (select unnest([k[1], k[2], p_name]) as gram from a), c as (select unnest(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i::int, 3))) as gram from a)
  select 'word' as kind, gram, count(*) as n from g group by gram union all select 'char', gram, count(*) from c group by gram""")
def ngram_counts(t):
    k = F.split("p_name", " ")
    w = t.part.select(F.lit("word").alias("kind"), F.explode(F.concat(X.word_ngrams(k, 1), X.word_ngrams(k, 2), X.word_ngrams(k, 3))).alias("gram"))
    c = t.part.select(F.lit("char").alias("kind"), F.explode(X.char_ngrams("p_name", 3)).alias("gram"))
    return w.unionByName(c).groupBy("kind", "gram").agg(F.count("*").alias("n"))


@query("caption_flags", """with a as (select conv_id, turn, trim(text, ' ') as v from conversations), b as (select *, len(list_filter(regexp_split_to_array(v, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) as n from a)
  select conv_id, turn, array_to_string(list_filter([case when contains(v, '_') then 'identifier_separators' end, case when n > 40 then 'too_long' end, case when n < 5 then 'too_short' end, case when regexp_matches(lower(v), '\\b(the|of)\\b') then 'uncertain' end], lambda x: x is not null), ',') as flags from b where not regexp_matches(v, '[^ -~\\n]')""")
def caption_flags(t):
    c = t.conversations.filter(~F.trim("text").rlike(r"[^ -~\n]"))
    return c.select("conv_id", "turn", F.array_join(X.caption_flags("text", 5, 40, ["the", "of"]), ",").alias("flags"))


@query("bullet_lines", "select doc_id, concat_ws(chr(10), '- lang: ' || lang, case when quality = 1 then '- quality: good' end, '- source: ' || source) as lines from documents join labels using (doc_id)")
def bullet_lines(t):
    j = t.documents.join(t.labels, "doc_id")
    return j.select("doc_id", X.bullet_lines({"lang": F.col("lang"), "quality": F.when(F.col("quality") == 1, "good"), "source": F.col("source")}).alias("lines"))


@query("vocabulary_pairs", "select split_part(p_name, ' ', 1) as first, split_part(p_name, ' ', 2) as second, count(*) as n from part where split_part(p_name, ' ', 1) in ('red', 'blue', 'hot') and split_part(p_name, ' ', 2) in ('ring', 'bolt', 'rod', 'plate', 'gear') group by all")
def vocabulary_pairs(t):
    return t.part.select(F.explode(X.vocabulary_pairs(F.split("p_name", " "), ["red", "blue", "hot"], FORMS)).alias("p")).groupBy("p.first", "p.second").agg(F.count("*").alias("n"))


LICENSE = "case when text like '%MIT License%' then 'MIT' when text like '%Apache License%' then 'Apache 2.0' when text like '%GNU General Public%' then 'GPL-3.0' when text like '%CC BY-NC%' then 'CC-BY-NC-4.0' when text like '%All rights reserved%' then 'LicenseRef-All-Rights' when text ilike '%licen%' then 'other-warranty' else '' end"


def _licenses(t):
    c = lambda s: F.contains("text", F.lit(s))
    name = (
        F.when(c("MIT License"), "MIT").when(c("Apache License"), "Apache 2.0").when(c("GNU General Public"), "GPL-3.0").when(c("CC BY-NC"), "CC-BY-NC-4.0")
        .when(c("All rights reserved"), "LicenseRef-All-Rights").when(F.contains(F.lower("text"), F.lit("licen")), "other-warranty").otherwise("")
    )
    return t.documents.select("doc_id", "source", name.alias("license"))


@query("licence_classify", f"""with a as (select doc_id, {LICENSE} as license from documents), b as (select *, replace(trim(lower(license)), ' ', '-') as n from a)
  select doc_id, case when n in ('mit', 'apache-2.0') then 'allow' when n in ('gpl-3.0') then 'review' when contains(n, '-nc') or contains(n, 'all-rights') or contains(n, 'arr') then 'deny' else 'review' end as status,
  case when license in ('MIT', 'Apache 2.0') then 'permissive' when license in ('GPL-3.0') then 'copyleft' when starts_with(license, 'CC-BY-NC') then 'nc' when starts_with(license, 'LicenseRef-All') then 'arr' when license = '' then 'unknown' else 'other' end as license_group from b""")
def licence_classify(t):
    status = X.classify_license("license", F.lit(""), ["mit", "apache-2.0"], ["gpl-3.0"], ["-nc", "all-rights"], ["arr"])
    group = X.license_group("license", {"permissive": ["MIT", "Apache 2.0"], "copyleft": ["GPL-3.0"]}, {"nc": ["CC-BY-NC"], "arr": ["LicenseRef-All"]})
    return _licenses(t).select("doc_id", status.alias("status"), group.alias("license_group"))


@query("keyword_exclude", "select p_partkey from part where not regexp_matches(lower(p_name), 'old|ring|ot g')")
def keyword_exclude(t):
    return t.part.filter(~F.lower("p_name").rlike("old|ring|ot g")).select("p_partkey")


@query("json_field_resolve", "select event_id, coalesce(case when event_type = 'view' then 'flat' end, json_extract_string(props, '$.k'), '') as field, coalesce(json_extract_string(props, '$.none'), '') as missing from events")
def json_field_resolve(t):
    j = lambda k: F.get_json_object("props", f"$.{k}")
    return t.events.select("event_id", F.coalesce(F.when(F.col("event_type") == "view", "flat"), j("k"), F.lit("")).alias("field"), F.coalesce(j("none"), F.lit("")).alias("missing"))


@query("fallback_chain", "select p_partkey, coalesce(case when p_size % 4 = 0 then p_name end, case when p_size % 3 = 0 then lower(p_type) end, 'unknown') as label from part")
def fallback_chain(t):
    a, b = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" "), "p_name")).otherwise("  "), F.when(F.col("p_size") % 3 == 0, F.lower("p_type"))
    return t.part.select("p_partkey", X.first_nonempty(a, b, default="unknown").alias("label"))


@query("filter_funnel", """select count(*) as rows, count(*) filter (where a) as english, count(*) filter (where a and b) as long, count(*) filter (where a and b and c) as hot from (select lang = 'en' as a, n_chars > 1000 as b, source = 'src0' as c from documents)""")
def filter_funnel(t):
    from ..operators.aggregates import funnel

    return funnel(t.documents, {"english": F.col("lang") == "en", "long": F.col("n_chars") > 1000, "hot": F.col("source") == "src0"})


@query("tileable_states", """select p_partkey, coalesce(case when p_size % 10 = 0 then true when p_size % 10 = 1 then false end, case when p_type like 'PRO%' then false when p_name like '%ring%' or p_name like '%rod%' then false when p_name like '%plate%' or p_name like 'red ring' then true end) as tileable from part""")
def tileable_states(t):
    said = F.when(F.col("p_size") % 10 == 0, "Yes").when(F.col("p_size") % 10 == 1, "false").when(F.col("p_size") % 10 == 2, "unknown")
    return t.part.select("p_partkey", X.tri_state_tileable(said, F.when(F.col("p_type").startswith("PRO"), "item"), "p_name", ["ring", "rod"], ["plate", "red ring"]).alias("tileable"))


@query("display_readable", "select p_partkey, split_part(p_name, ' ', 1) in ('red', 'blue', 'small') and split_part(p_name, ' ', 2) in ('ring', 'bolt', 'rod') and split_part(p_name, ' ', 2) <> 'rod' as readable from part")
def display_readable(t):
    return t.part.select("p_partkey", X.display_readable("p_name", 2, 3, ["rod"], ["red", "blue", "small"], ["ring", "bolt", "rod"]).alias("readable"))


@query("search_page", """select conv_id, turn, role from conversations where role = 'user' and contains(lower(text), 'the') and contains(lower(text), 'of') order by conv_id, turn limit 20 offset 10""")
def search_page(t):
    terms = F.array(F.lit("the"), F.lit("of"))
    hit = F.forall(terms, lambda x: F.contains(F.lower("text"), x))
    return t.conversations.filter((F.col("role") == "user") & hit).orderBy("conv_id", "turn").offset(10).limit(20).select("conv_id", "turn", "role")  # a page is the feature


@query("local_path_guard", """select 'nested' as "column", v as value from (select unnest([url, '/tmp/' || page_id, 'C:/x/' || page_id, 'notes/a', case when page_id % 2 = 0 then '~/' || page_id end]) as v from pages) where regexp_matches(v, '^(/|~|file:|[A-Za-z]:[/\\\\])')""")
def local_path_guard(t):
    from ..sources.files import local_paths

    k = F.col("page_id").cast("string")
    nested = F.struct(F.array("url", F.concat(F.lit("/tmp/"), k)).alias("list"), F.create_map(F.lit("a"), F.struct(F.concat(F.lit("C:/x/"), k).alias("p"), F.lit("notes/a").alias("q"))).alias("map"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("~/"), k)).alias("home"), "page_id")
    return local_paths(t.pages.select(nested.alias("nested")), ["nested"])
