"""The queries over these operators, with DuckDB SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_automaton import bpe_encode_decode
from .common import documents
from .divergence import divergence_rules
from .factorization import fit_quality, score_quality
from .line_chunks import dedup_lines
from .media import media_digest, store_as_wave
from .mixing import mix_sources
from .pii import find_pii
from .simhash import simhash_digest
from .substring import remove_repeats
from .token_store import write_token_store


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules(documents(spark, sf_dir))


def op2_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, fit_quality(docs, labels))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.select("rest.doc_id", "rest.source", F.col("copy").alias("copy_no"), "copies", F.round("rate", 6).alias("rate"), "shuffle_key", F.sha2("rest.text", 256).alias("text_sha256"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return write_token_store(docs, vocabulary()).lookup(docs, digests=True)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(store_as_wave(documents(spark, sf_dir)))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), digests=True)


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir), digests=True)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir), digests=True)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_digest(documents(spark, sf_dir))


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode_decode(documents(spark, sf_dir), vocabulary(), digests=True)


QUERIES = {
    "op1_divergence": op1_divergence,
    "op2_factorization": op2_factorization,
    "op3_mixing": op3_mixing,
    "op4_token_store": op4_token_store,
    "op5_media": op5_media,
    "op6_substring": op6_substring,
    "op7_line_chunks": op7_line_chunks,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_bpe_automaton": op10_bpe_automaton,
}
OP3_SQL = """
with sizes as (
  select source, sum(length(coalesce(text, '')))::double as chars from documents group by source
), weighted as (
  select source, chars, case when chars > 0 then sqrt(chars) else 0 end as weight from sizes
), rates as (
  select source, case when chars = 0 then 1.0
    else (select sum(chars) from weighted) * weight / (chars * (select sum(weight) from weighted)) end as rate from weighted
), points as (
  select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::bigint + 1)) as k from rates
), logs as (
  select source, rate, k, case when k = 0 then -rate else ln(rate) - ln(k::double) end as log_step from points
), masses as (
  select source, k, exp(sum(log_step) over (partition by source order by k)) as mass from logs
), steps as (
  select source, k, sum(mass) over (partition by source order by k) as step from masses
), draws as (
  select doc_id, source, text,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint::double / 4503599627370496.0 as u
  from documents
), counted as (
  select d.doc_id, d.source, d.text, count(s.k) as copies
  from draws d left join steps s on s.source is not distinct from d.source and s.step <= d.u group by all
), copied as (
  select *, unnest(range(1, copies + 1)) as copy_no from counted where copies > 0
)
select c.doc_id, c.source, c.copy_no, c.copies, round(r.rate, 6) as rate,
  md5('mix-1-order:' || coalesce(c.doc_id::varchar, '') || ':' || md5(coalesce(c.text, '')) || ':' || c.copy_no::varchar) as shuffle_key, sha256(c.text) as text_sha256
from copied c join rates r on r.source is not distinct from c.source
"""

OP6_SQL = """
with split as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as k from documents
), words as (
  select doc_id, unnest(k) as word, unnest(range(1, len(k) + 1)) as pos, len(k) as n from split
), windows as (
  select *, string_agg(word, ' ') over (partition by doc_id order by pos rows between current row and 19 following) as win from words
), marked as (
  select *, pos + 19 <= n and (doc_id, pos) <> (min((doc_id, pos)) over (partition by win, pos + 19 <= n)) as again from windows
), covered as (
  select *, max(again::int) over (partition by doc_id order by pos rows between 19 preceding and current row) = 1 as gone from marked
), runs as (
  select *, gone and not coalesce(lag(gone) over (partition by doc_id order by pos), false) as opens from covered
), found as (
  select doc_id, count(*) filter (where gone) as n_removed, sha256(coalesce(string_agg(word, ' ' order by pos) filter (where not gone), '')) as kept_sha256,
    count(*) filter (where opens) as n_repeats from runs group by doc_id
)
select s.doc_id, len(s.k)::bigint as n_words, coalesce(n_removed, 0) as n_removed, coalesce(kept_sha256, sha256('')) as kept_sha256, coalesce(n_repeats, 0) as n_repeats
from split s left join found f using (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op3_mixing": OP3_SQL, "op6_substring": OP6_SQL}
