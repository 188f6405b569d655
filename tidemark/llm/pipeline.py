"""The corpus pipeline: documents to packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``documents``. ORACLE_SQL is None: trained models, MinHash links and raking can't be expressed in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, lines, mixing, packing, simhash
from tidemark.llm.common import stage, table
from tidemark.llm.tokens import vocabulary

#: Bits in which fingerprints of five-word shingles may differ to be candidates; share of the tokens that mixing keeps.
NEAR_BITS, KEEP = 6, 0.9
#: Jaccard similarity of the sets of five-word shingles from which documents are near-duplicates.
NEAR = 0.8
TOKENIZER = "word_bpe_49k.json"
LANGUAGES = {"en": 0.55, "fr": 0.17, "de": 0.16, "es": 0.12}

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their predicted language; those without a letter or with a doubtful language go."""
    return langid.with_language(docs, langid.learn(docs, F.lit(True)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of near-equal lines stays; documents of nothing but copied lines go."""
    return _counted(lines.without_duplicate_lines(docs, least=0.8))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; every link is a pair compared shingle by shingle."""
    return simhash.one_of_each_group(docs, most=NEAR_BITS, n=5, least=NEAR)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that the tokens of each source, language and topic come close to their targets."""
    return mixing.sampled(docs, langs=LANGUAGES, keep=KEEP, source_power=0.9, topic_power=0.9, vocabulary=vocabulary(TOKENIZER))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, placed in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary(TOKENIZER), capacity=2048, end=0).withColumnRenamed("id", "doc_id")


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [("language ID", language), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing", mixture), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, fn) in enumerate(STAGES):
        docs = fn(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-"))
    return docs
