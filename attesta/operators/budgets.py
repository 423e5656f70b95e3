"""Budgets: reservations in order, refused where they would pass the limit, and their settlement.

A refused reservation is not stored and costs nothing, so whether one is accepted depends on all
before it.  Sums decide as long as nothing was refused, in blocks of any ledger; only what follows
a ledger's first refusal is told in order, without reservations that no release could make room for.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import placed, running_sum

#: Amounts are whole millionths, so sums are the same in any order.
UNIT = 1_000_000


def units(amount: Column) -> Column:
    """Millionths of a finite amount of 0 or more; null for any other."""
    ok = amount.isNotNull() & ~F.isnan(amount) & (amount >= 0) & (amount < 9e12)
    return F.when(ok, F.round(amount * UNIT).cast("long"))


def _told(batches):
    """(_at, _ok) of each ledger's events after its first refusal, in order; a ledger holds its open reservations."""
    ledger, spent, open_ = None, 0, set()
    for batch in batches:
        out = []
        for by, at, start, limit, amount, settled, change, of, before in zip(*(c.to_pylist() for c in batch.columns)):
            if by != ledger:
                ledger, spent, open_ = by, start, set()
            if amount is not None:
                ok = spent + amount <= limit
                spent += amount if ok else 0
                if ok and settled:
                    open_.add(at)
            else:
                ok = of < before or of in open_
                spent += change if ok else 0
                open_.discard(of)
            out.append(ok)
        yield pa.RecordBatch.from_arrays([batch.column("_at"), pa.array(out, pa.bool_())], names=["_at", "_ok"])


def ledger(events: DataFrame, by: str, order: list[str], kind: str, ident: str, amount: str, limit: float) -> DataFrame:
    """Adds ``outcome`` and ``spent`` (after the event) to events in order of ``order``, ``ident``, each ledger for itself.

    kind 'reserve' asks for an amount, 'settle' tells what the reservation ``ident`` really cost.
    Outcomes: accepted or refused; settled, once a stored reservation; ignored: a settlement that is repeated, of
    unknown cost, or without a stored reservation before it, which keeps its amount; invalid: a reservation whose amount is no number of 0 or more or whose
    ident was asked for before, other kinds, and rows without a ledger, which count nothing.
    """
    top = round(limit * UNIT)
    rows = placed(events.withColumn("_units", units(F.col(amount).cast("double"))), F.struct(by, *order), [ident], "_at", nulls_first=True)
    keyed = rows.where(F.col(by).isNotNull() & F.col("_units").isNotNull() & F.col(ident).isNotNull())
    asked = keyed.where(F.col(kind) == "reserve").groupBy(by, ident).agg(F.min(F.struct("_at", "_units")).alias("_r"))
    used = keyed.where(F.col(kind) == "settle").join(asked, [by, ident]).where(F.col("_at") > F.col("_r._at"))
    used = used.groupBy(by, ident).agg(F.min(F.struct("_at", "_units")).alias("_s"), F.first("_r").alias("_r"))
    first = asked.join(used.drop("_r"), [by, ident], "left").select(F.col("_r._at").alias("_at"), F.col("_r._units").alias("_amount"), F.col("_s").isNotNull().alias("_settled"), F.lit(None).cast("long").alias("_change"), F.lit(None).cast("long").alias("_of"))
    last = used.select(F.col("_s._at").alias("_at"), F.lit(None).cast("long").alias("_amount"), F.lit(False).alias("_settled"), (F.col("_s._units") - F.col("_r._units")).alias("_change"), F.col("_r._at").alias("_of"))
    anonymous = rows.where((F.col(kind) == "reserve") & F.col(by).isNotNull() & F.col(ident).isNull() & F.col("_units").isNotNull())
    facts = first.union(last).union(anonymous.select("_at", "_units", F.lit(False), F.lit(None).cast("long"), F.lit(None).cast("long")))
    rows = rows.drop("_units").join(facts, "_at", "left")

    sure = running_sum(rows.withColumn("_d", F.coalesce("_amount", "_change", F.lit(0))), by, "_at", "_d", "_all")
    over = sure.where(F.col("_amount").isNotNull() & (F.col("_all") > top)).groupBy(by).agg(F.min(F.struct("_at", (F.col("_all") - F.col("_d")).alias("start"))).alias("_o"))
    late = rows.select(by, "_at", "_amount", "_settled", "_change", "_of").join(over, by).where((F.col("_at") >= F.col("_o._at")) & (F.col("_amount").isNotNull() | F.col("_change").isNotNull()))
    back = late.groupBy(by).agg(F.sum(F.least(F.coalesce("_change", F.lit(0)), F.lit(0))).alias("_back"))
    late = late.join(back, by).where(F.col("_amount").isNull() | (F.col("_o.start") + F.col("_back") + F.col("_amount") <= top))
    late = late.select(by, "_at", "_o.start", F.lit(top).cast("long").alias("limit"), "_amount", "_settled", "_change", "_of", F.col("_o._at").alias("before"))
    told = late.repartition(by).sortWithinPartitions(by, "_at").mapInArrow(_told, "_at long, _ok boolean")

    rows = rows.join(over.select(by, F.col("_o._at").alias("_from")), by, "left").join(told, "_at", "left")
    ok = F.when(F.col("_from").isNull() | (F.col("_at") < F.col("_from")), True).otherwise(F.coalesce("_ok", F.lit(False)))
    outcome = F.when(F.col("_amount").isNotNull(), F.when(ok, "accepted").otherwise("refused")).when((F.col(kind) == "settle") & F.col(by).isNotNull(), F.when(F.col("_change").isNotNull() & ok, "settled").otherwise("ignored")).otherwise("invalid")
    rows = rows.withColumn("outcome", outcome)
    counted = F.when(F.col("outcome").isin("accepted", "settled"), F.coalesce("_amount", "_change")).otherwise(0)
    got = running_sum(rows.withColumn("_d", counted), by, "_at", "_d", "spent")
    return got.select(*events.columns, "outcome", F.when(F.col(by).isNotNull(), F.col("spent") / UNIT).alias("spent"))
