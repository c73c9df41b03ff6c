"""Token totals by source, language and tokenizer version, kept up to date by deltas.

A ledger takes batches of document changes. ``put`` stands for an insert or for a
revised text, ``delete`` for a removal. A batch looks up what it counted before
for its documents, and adds (new - old) to the totals of the groups concerned:
totals are sums of signed deltas, so they never need the other documents.

Tables of a ledger, all under one folder:

    state/batch=N    the documents changed by batch N with their new counts (null: deleted)
    deltas/batch=N   signed sums of batch N per source, language, tokenizer version
    commits          the numbers of the batches that count

A batch is written to its own folders, whole, and counts once its number is in
``commits``. Applying a committed number again does nothing; a batch that broke off
before its commit left nothing that is read and is written anew.

Of several changes of a document in one batch the largest ``seq`` counts (null is
smallest; of equal ones the delete, then the largest text). Deleting an unknown
document and putting an equal count change no totals. A null text has no tokens;
null source or language is a group of its own. Changes with a null doc_id or
an unknown op are left out: nothing could revise them. An empty batch commits and
changes nothing. Other columns are ignored.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.llm.common import documents, prepare, scratch_path, words_of

STATE = "doc_id long, tokenizer string, source string, lang string, n_tokens long, batch long"
DELTAS = "source string, lang string, tokenizer string, d_docs long, d_tokens long, batch long"
COMMITS = "batch long"
GROUP = ["source", "lang", "tokenizer"]

UNIT = r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]"
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda text: F.size(words_of(text)),
    "units-1": lambda text: F.regexp_count(text, F.lit(UNIT)),
}


class TokenLedger:
    """The tables below ``root`` and the batches applied to them."""

    def __init__(self, spark: SparkSession, root: str, tokenizers: dict[str, Callable[[Column], Column]] | None = None):
        prepare(spark)
        self.spark, self.root = spark, root.rstrip("/")
        self.tokenizers = TOKENIZERS if tokenizers is None else tokenizers
        self._empty("commits", COMMITS)

    def _empty(self, table: str, schema: str) -> None:
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.root}/{table}")

    def committed(self) -> list[int]:
        """One number per batch ever applied."""
        return sorted(r["batch"] for r in self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits").distinct().collect())

    def _read(self, table: str, schema: str) -> DataFrame:
        done = self.committed()
        if not done:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{table}/batch={b}" for b in done]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)

    def count(self, docs: DataFrame) -> DataFrame:
        """One row per document and tokenizer version."""
        text = F.coalesce(docs["text"], F.lit(""))
        each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.coalesce(f(text), F.lit(0)).cast("long").alias("n_tokens"))
                         for name, f in self.tokenizers.items()])
        return docs.withColumn("_c", F.explode(each)).select("*", "_c.*").drop("_c", "text")

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Apply ``changes`` (op, doc_id, seq, source, lang, text) once; False if ``batch`` was applied before."""
        if batch in self.committed():
            return False
        rows = changes.where("doc_id IS NOT NULL AND op IN ('put', 'delete')").select("op", "doc_id", "seq", "source", "lang", "text")
        # counted before the shuffle: only numbers move on
        counted = self.count(rows)
        rank = F.struct("seq", F.col("op") == "delete", "n_tokens", "source", "lang")
        last = counted.groupBy("doc_id", "tokenizer").agg(F.max_by(F.struct("op", "source", "lang", "n_tokens"), rank).alias("x"))
        gone = F.col("x.op") == "delete"
        new = last.select("doc_id", "tokenizer", *[F.when(~gone, F.col(f"x.{c}")).alias(c) for c in ("source", "lang", "n_tokens")])
        new.write.mode("overwrite").parquet(f"{self.root}/state/batch={batch}")
        new = self.spark.read.schema(STATE).parquet(f"{self.root}/state/batch={batch}").drop("batch")
        touched = new.select("doc_id").distinct()
        old = (self._read("state", STATE).join(touched, "doc_id", "left_semi").groupBy("doc_id", "tokenizer")
               .agg(F.max_by(F.struct("source", "lang", "n_tokens"), "batch").alias("x")).select("tokenizer", "x.*"))
        # a batch takes back all that it counted for these documents, then adds the new counts
        signed = (old.withColumn("sign", F.lit(-1)).unionByName(new.drop("doc_id").withColumn("sign", F.lit(1)))
                  .where("n_tokens IS NOT NULL"))
        (signed.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("d_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("d_tokens"))
         .write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch}"))
        self.spark.createDataFrame([(batch,)], COMMITS).write.mode("append").parquet(f"{self.root}/commits")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of the groups that hold a document."""
        return (self._read("deltas", DELTAS).groupBy(*GROUP)
                .agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens")).where("n_docs <> 0"))


# The change feed that the query applies, made of the table's rows: every document is put;
# German texts come again without their line ends; short documents are deleted.
JOIN_LINES = "lang = 'de'"
SHORT = "n_chars < 400"


def feed(docs: DataFrame) -> list[tuple[int, DataFrame]]:
    cols = ["doc_id", "source", "lang"]
    put = docs.select(F.lit("put").alias("op"), F.lit(0).alias("seq"), *cols, "text")
    revised = put.where(JOIN_LINES).withColumn("text", F.regexp_replace("text", "\n", ""))
    removed = docs.where(SHORT).select(F.lit("delete").alias("op"), F.lit(0).alias("seq"), *cols, F.lit(None).cast("string").alias("text"))
    return [(1, put), (2, revised), (3, removed), (2, revised)]  # the last one is a batch sent twice


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after inserts, revisions and deletes over all documents, one batch sent twice."""
    prepare(spark)
    ledger = TokenLedger(spark, scratch_path(spark, "ledger"))
    for batch, changes in feed(documents(spark, sf_dir)):
        ledger.apply(batch, changes)
    return ledger.totals()


OP9_SQL = rf"""
WITH last AS (SELECT source, lang, CASE WHEN {JOIN_LINES} THEN replace(coalesce(text, ''), chr(10), '') ELSE coalesce(text, '') END AS t
              FROM documents WHERE doc_id IS NOT NULL AND coalesce(NOT ({SHORT}), true)),
c AS (SELECT source, lang, unnest(['words-1', 'units-1']) AS tokenizer,
             unnest([len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')),
                     len(regexp_extract_all(t, '{UNIT}'))]) AS n FROM last)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM c GROUP BY ALL
"""
