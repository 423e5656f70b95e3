"""Providers: whoever turns items into labels, behind one DataFrame in and one out.

A provider is any function of a DataFrame (id, text) that returns a DataFrame (id, ...) of labels: rules,
a model in a Pandas UDF, or a table of answers.  What it returns is checked as an answer of a
stranger: every item once, no others, and rules for the columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Provider = Callable[[DataFrame], DataFrame]


def by_rules(label: str, otherwise: str, **patterns: str) -> Provider:
    """Provider of the first name whose pattern a text has; it answers nothing for null texts."""

    def run(items: DataFrame) -> DataFrame:
        found = F.lit(otherwise)
        for name, pattern in reversed(patterns.items()):
            found = F.when(F.col("text").rlike(pattern), name).otherwise(found)
        return items.where("text is not null").select("id", found.alias(label))

    return run


def by_batches(predict, schema: str) -> Provider:
    """Provider of a function of (ids, texts) lists that gives rows of ``schema``, on Arrow batches of the executors."""

    def run(items: DataFrame) -> DataFrame:
        import pandas as pd

        names = T._parse_datatype_string(schema).names

        def each(frames):
            for pdf in frames:
                yield pd.DataFrame(predict(pdf["id"].tolist(), pdf["text"].tolist()), columns=names)

        return items.select("id", "text").mapInPandas(each, schema)

    return run


def labelled(items: DataFrame, key: str, text: Column, provider: Provider, rules: dict[str, Column]) -> DataFrame:
    """Items with the provider's columns, ``errors`` and ``status``.

    status: classified; pending, where the provider gave no answer; rejected, where it gave
    several or broke a rule (a condition over its columns that has to be true), which ``errors`` name.  Labels of
    items that were not asked for come back as rows without the item's columns, status 'unknown'.
    """
    asked = items.withColumn("_id", F.col(key))
    answers = provider(items.select(F.col(key).alias("id"), text.alias("text")))
    names = [c for c in answers.columns if c != "id"]
    one = answers.groupBy(F.col("id").alias("_answer")).agg(F.count("*").alias("_n"), F.first(F.struct(*(names or [F.lit(1).alias("_none")]))).alias("_a"))
    rows = asked.join(one, F.col("_id") == F.col("_answer"), "full")
    rows = rows.select(*items.columns, "_id", "_n", *(F.col(f"_a.{c}").alias(c) for c in names))
    broken = [F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]
    errors = F.array_compact(F.array(F.when(F.col("_n") > 1, "answered twice"), *broken)) if broken else F.array_compact(F.array(F.when(F.col("_n") > 1, "answered twice")))
    none = F.array().cast("array<string>")
    errors = F.when(F.col("_n").isNull() | F.col("_id").isNull(), none).otherwise(errors)
    status = F.when(F.col("_id").isNull() & F.col("_n").isNotNull(), "unknown").when(F.col("_n").isNull(), "pending").when(F.size("errors") > 0, "rejected").otherwise("classified")
    return rows.withColumn("errors", errors).withColumn("status", status).drop("_id", "_n")
