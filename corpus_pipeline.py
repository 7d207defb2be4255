"""From raw documents to packed sequences: classify, clean, deduplicate, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. A caller may
write what a stage returns and hand the table to the next; ``run`` does so
itself, so that a lost executor never costs more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import Shelf, release, shelves, table
from tidewire.llm.decontaminate import drop_contaminated
from tidewire.llm.line_dedup import dedup_lines
from tidewire.llm.minhash_dedup import drop_near_duplicates
from tidewire.llm.packing import pack
from tidewire.llm.quality import drop_low_quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null and empty texts are scored like others, by their form; repeated rows
    are scored each. Without labels of both classes the documents' share of
    good labels decides for all. An empty table stays empty. All columns stay,
    whatever their names; source, lang and n_chars may be missing.
    """
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages go, and with them documents that held nothing else.

    A null text becomes empty and stays, as it lost nothing. Of equal passages
    the first by (id, text hash, position) stays, null ids last; of rows that
    repeat id and text the first by a hash of the other columns. An empty table
    stays empty. All columns stay as they are, whatever their names, but the
    text and, where there is such a column, n_chars of documents that lost lines.
    """
    taken = {c: f"kept_{k}_{c}" for k, c in enumerate(docs.columns) if c in ("line_count", "lines_removed")}
    cleaned = dedup_lines(docs.withColumnsRenamed(taken)).filter((F.col("lines_removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        length = F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", length)
    return cleaned.drop("line_count", "lines_removed").withColumnsRenamed({new: old for old, new in taken.items()}).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (likeness 0.8 on five words) stays, that of the least id.

    Texts without words are like nothing, and stay; so do rows with null ids
    whose texts no other row is like. Of rows that repeat id and text one
    stays. An empty table stays empty; all columns stay.
    """
    return drop_near_duplicates(docs, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item, edited or not, go.

    Null and empty texts stay, and null ids; repeated rows go or stay alike. An
    empty table of documents or items drops nothing; all columns stay.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, in sequences of 2048 tokens; each source has its own share of all tokens.

    A null or empty text is its end token alone. Repeated rows are packed each;
    a null source is a source like any other. An empty table gives no pieces;
    of other columns than id, text and source none is used.
    """
    import public_tokenizers

    return pack(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", clean_lines),
    ("MinHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Training, tokenizing and aligning are not for SQL; tests hold the stages to brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``."""
    shelf = Shelf(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        mark = shelves()
        out = shelf.put(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        release(spark, mark)  # what the stage wrote for itself
        if hasattr(docs, "_shelf_path"):
            shelf.drop(docs)
        docs = out
    return docs
