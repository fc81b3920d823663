"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``docs`` is
what the stage before kept, read again from Parquet. All but the last return
the columns of ``documents``. Null texts count as empty, null ids stay rows of
their own in every stage but the near-dedup (see its operator), and an empty
table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.bpe_automaton import bpe_encode_decode
from sievework.llm.divergence import divergence_rules
from sievework.llm.line_chunks import dedup_lines
from sievework.llm.mixing import mix_sources
from sievework.llm.near_copies import near_copy_components
from sievework.llm.queries import vocabulary
from sievework.llm.simhash import keep_representatives
from sievework.operators.storage import remove_folder, shared_folder, shuffles_removed


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return divergence_rules(docs, carry=docs.columns).filter("kept").select("rest.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go; ``n_chars`` follows the text."""
    kept = dedup_lines(docs, carry=[c for c in docs.columns if c not in ("text", "n_chars")])
    change = {"text": kept["text"], "n_chars": F.char_length(kept["text"]).cast("long")}
    return kept.select(*[(change[c] if c in change else kept["rest"][c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return keep_representatives(docs, near_copy_components(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated towards the sources' target weights and shuffled; copies keep their doc_id."""
    return mix_sources(docs).select("rest.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document and what they decode to, as digests; workers that served the stages before remember fewer words."""
    return bpe_encode_decode(docs, vocabulary(), digests=True, words_kept=150_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mixing),
    ("bpe_encode_decode", bpe),
]

#: SQL can't express the chunk boundaries, fingerprints or merges; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage read goes as soon as the next one is written, the rest when the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, read = shared_folder(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        with shuffles_removed(spark):
            out.write.parquet(f"{folder}/{k}-{name}")
        if read:
            remove_folder(spark, read)
        read = f"{folder}/{k}-{name}"
        docs = spark.read.parquet(read)
    return docs
