"""Corpus pipeline: five filtering and shaping stages over ``documents``.

Each stage is ``function(spark, docs, sf_dir) -> DataFrame``; its result is
written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns of ``documents``.

All stages take null, empty and very long texts, null and repeated doc_ids, rows
that are equal, empty tables, and further columns of any name; what each makes
of them is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import decontaminate, jaccard, packing, pii, toxicity, work


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go.

    Rows are judged one by one, with or without doc_id; null and empty texts have
    the score of no hit and stay.
    """
    return toxicity.reject(docs, toxicity.train(docs, work.table(spark, sf_dir, "labels")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays.

    Null and empty texts, and texts of white space, are like no other and stay;
    of repeated rows of one doc_id one stays; rows without a doc_id stay.
    """
    return jaccard.keep_one(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts contain none and stay; rows of one doc_id go together, a
    row without one is judged by its text.
    """
    return decontaminate.without_leaks(docs, work.table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind.

    Every row stays; null and empty texts are left as they are.
    """
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into token sequences, a row a piece.

    Null and empty texts are the end id alone; repeated rows, and rows without a
    doc_id, are packed each.
    """
    import public_tokenizers

    return packing.best_two_fit(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), packing.most_pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_near_duplicates),
    ("decontaminate", drop_leaked),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again.

    A stage's scratch tables, and the table it read, are deleted once its result
    is written.
    """
    docs = work.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with work.scope() as made:
            kept = work.cut(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(kept)
        work.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: toxicity is learned, and alignment and packing are no SQL.
ORACLE_SQL = None
