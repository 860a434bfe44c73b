"""From raw `documents` to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; all but the
last return the columns of ``documents``.  ``run`` writes each stage's result to the shared
checkpoint folder, reads it again, and removes what earlier stages wrote.

Rows are judged one by one, so repeated rows and repeated or null ids are no special case but where
a stage says so.  Every stage returns an empty table for an empty one; columns beyond those of
``documents`` pass through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate as contamination
from tallyloom.llm import language_id, line_dedup, mixing, simhash
from tallyloom.llm.common import materialize, remove_tables, small_batches, tables_written
from tallyloom.llm.queries import fold, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text or no letter) and those between two languages (ambiguous) go;
    ``lang`` of the others becomes the predicted language.  Where nothing can be learned (no labelled
    row) all texts with a letter stay as they are."""
    small_batches(spark)
    model = language_id.fit(docs, "text", "lang", fold(3) != 1)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, model, keep_text=True).where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous"))
    return found.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose key stands in ten documents or more go (each row is a document); n_chars follows the
    text.  A null text stays null; a text that loses all its lines stays, empty."""
    small_batches(spark)
    kept = line_dedup.dedup_lines(docs, min_docs=10)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, the one with the smallest id (null last, ties by
    fingerprint, then first row); all texts without a word are one group."""
    small_batches(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark passages go; null and empty texts stay."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: the texts as drawn, repeated and cut, shard by shard in the shuffled order.  Texts
    without a word are never drawn; a null source is a source of its own."""
    small_batches(spark)
    return mixing.draw_mixture(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix),
]

#: Fingerprints, a fitted classifier and seeded draws have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begin = table(spark, sf_dir, "documents"), tables_written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
            remove_tables(spark, begin, tables_written() - 1)
    return docs
