"""A training-data pipeline over ``documents``: five stages, each by one operator of ``stockspark.llm``.

Every stage takes all that its predecessor kept and returns the columns of
``documents``; the last one returns tokens. Null texts fail the quality rules;
rows with a null doc_id cannot be linked or reported and stay; repeated rows share
one fate; an empty table runs through empty. Extra columns of ``documents`` are
carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.llm import decontaminate, near_dup, pii, quality, sentence_pieces
from stockspark.llm.common import documents, prepare, scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component."""
    return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is that of the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_chars): sentence-piece ids of every
    document and the length of the text that they decode to."""
    import public_tokenizers
    return sentence_pieces.with_ids(docs.select("doc_id", "lang", "source", "text"),
                                    public_tokenizers.path("piece_bpe_32k.model")).drop("text")


STAGES = [
    ("quality", quality_rules),
    ("near_dup", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    prepare(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Sentence pieces are not an SQL function: the result is tested against a brute-force version.
ORACLE_SQL = None
