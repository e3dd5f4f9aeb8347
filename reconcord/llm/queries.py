"""The queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op1_entropy_mixing import entropy_mix
from .op2_pii import find_pii
from .op3_packing import best_fit_pack
from .op4_toxicity_mil import toxicity
from .op5_chat_format import chat_format, masked_text
from .op6_ngram_jaccard import ngram_jaccard
from .op7_lattice_dedup import lattice_dedup
from .op8_url_markov import url_filter
from .op9_risk_rules import risk_rules
from .op10_quality_pu import quality
from .op11_block_max_search import search
from .op12_license_scan import license_scan
from .op13_importance_resampling import resample


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(_documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("sentences").alias("n_offending"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select cast(col1 as bigint) conv_id, cast(col2 as bigint) turn, col3 role, col4 text from values (-7, 0, 'user', '{hard}'), (-7, 1, 'assistant', '{hard}')")
    df = chat_format(own.unionByName(more))
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = masked_text(F.col("formatted"), F.col("loss_spans"))
    return df.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(_documents(spark, sf_dir))


def op7_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = risk_rules(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_documents(spark, sf_dir)).drop("findings")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_entropy_mixing": op1_entropy_mixing,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_chat_format": op5_chat_format,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_lattice_dedup": op7_lattice_dedup,
    "op8_url_markov": op8_url_markov,
    "op9_risk_rules": op9_risk_rules,
    "op10_quality": op10_quality,
    "op11_block_max_search": op11_block_max_search,
    "op12_license_scan": op12_license_scan,
    "op13_importance_resampling": op13_importance_resampling,
}

_SEARCH = r"""
with terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents
), held as (select doc_id, term, count(*)::bigint as tf from terms group by all
), own as (select doc_id, sum(tf)::bigint as n from held group by all
), every as (select count(*)::bigint as docs, sum(n)::bigint as words from own
), asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from held, every group by term, docs
), scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::bigint as score
  from asked join held using (term) join weights using (term) join own using (doc_id), every group by all
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scores where score > 0
) select item_id, rank, doc_id, score from ranked where rank <= 10
"""
ORACLE: dict[str, str] = {"op11_block_max_search": _SEARCH}
