"""The ``opN_<name>`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fill_middle, line_dedup, topk
from .common import table
from .alignment import align_tokens
from .decontaminate import benchmark_leaks
from .line_dedup import dedup_lines
from .minhash_dedup import near_duplicates
from .packing import pack
from .pii import replace_entities
from .quality import score_quality
from .syncmers import edited_fingerprints
from .token_counts import token_counts
from .toxicity import score_toxicity, train

_KEYS: dict[str, str] = {}


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "score", "first_word", "last_word", "seeds")


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # Shares by size ** 0.7: small sources come more often than their size says; all documents are packed.
    return pack(table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), targets=0.7)


def op4_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "line_count", "lines_removed")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path=public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "score")


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a setting of the deployment; without it, a random one of this Spark application, which nobody can look up."""
    key = spark.conf.get("spark.tidewire.surrogateKey", None) or _KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
    kinds = F.array_sort(F.array_distinct("surrogates.kind"))
    return replace_entities(table(spark, sf_dir, "documents"), key=key).select("doc_id", "text", "n_entities", F.concat_ws(",", kinds).alias("kinds"))


def op8_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "p_text", "p_page", "quality", "keep")


def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grades are those of the labels. The table's labels know two, so there is one cut between grades, and the
    expected severity is the probability of the upper one; with labels of more grades, as the tests have them, the same
    call fits as many ordered cuts with shared weights."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", "expected_severity", "grade", "p_toxic", "toxic")


def op10_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each turn of each rendered dialogue, cut from the operator's parts, so that no row grows with a conversation."""
    return chat.rendered_turns(chat.rotate_perspectives(table(spark, sf_dir, "conversations")))


def op11_topk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    whole = fill_middle.restore(F.col("fim_output"), F.col("fim_form"))
    return made.select(
        "doc_id",
        F.col("fim_n").alias("n"),
        F.col("fim_form").alias("form"),
        F.length("fim_prefix").cast("long").alias("prefix_chars"),
        F.length("fim_middle").cast("long").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"),
        F.sha2(whole, 256).alias("restored_sha256"),
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokens(table(spark, sf_dir, "documents"), a_path=public_tokenizers.path("byte_bpe_50k.json"), b_path=public_tokenizers.path("piece_bpe_32k.model")).drop("text_hash")


_QUERIES = (
    op1_minhash_dedup,
    op2_benchmark_leaks,
    op3_mixture_packing,
    op4_syncmer_fingerprints,
    op5_line_dedup,
    op6_token_counts,
    op7_surrogates,
    op8_quality_cotraining,
    op9_ordinal_toxicity,
    op10_chat_perspectives,
    op11_topk_vectors,
    op12_fill_middle,
    op13_token_alignment,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """The rest train models, tokenize, or search for likeness, which SQL can't state; tests hold them to brute force."""
    return {"op5_line_dedup": line_dedup.ORACLE, "op10_chat_perspectives": chat.ORACLE, "op11_topk_vectors": topk.ORACLE, "op12_fill_middle": fill_middle.ORACLE}
