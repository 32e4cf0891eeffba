"""Checks of a capture: which rows are dropped, which transactions are put aside, and whether the capture is refused as a whole.

Rows come first: what a bad row says about a transaction is not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint
from ledgerlens.sources.capture import violations

#: Fixed limits: longest id, what a fee may exceed the inputs by, share of transactions put aside at which a capture is refused.
LONGEST_ID, FEE_TOLERANCE, REFUSE_SHARE = 128, 1e-8, 0.5
_LIST = "array<string>"


def _items(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(_LIST))


#: Fixed names of what can be wrong with a transaction.
KINDS = ("ADDRESS_INVALID", "AMOUNT_LIST_MISMATCH", "FEE_EXCEEDS_INPUTS", "NEGATIVE_FEE", "NEGATIVE_OR_NONFINITE_AMOUNT", "TXID_INVALID", "CONFLICTING_CHAIN_FACTS")


def row_kinds() -> Column:
    """What is wrong with the chain facts of one row, as a sorted array of kinds."""
    bad_id = lambda x: x.isNull() | (F.trim(x) == "") | (F.length(x) > LONGEST_ID)
    number = lambda x: x.try_cast("double")
    bad_amount = lambda x: F.coalesce(F.isnan(number(x)) | (F.abs(number(x)) == float("inf")) | (number(x) < 0), F.lit(True))
    sides = (("input_addresses", "input_amounts"), ("output_addresses", "output_amounts"))
    any_of = lambda test: test(*sides[0]) | test(*sides[1])
    amounts_bad = any_of(lambda _, b: F.exists(_items(b), bad_amount))
    total = F.aggregate(_items("input_amounts"), F.lit(0.0), lambda t, x: t + F.coalesce(number(x), F.lit(0.0)))
    fee = F.col("fee").try_cast("double")
    fee_known = fee.isNotNull() & ~F.isnan(fee) & (F.abs(fee) != float("inf"))
    tests = (
        ("ADDRESS_INVALID", any_of(lambda a, _: F.exists(_items(a), bad_id))),
        ("AMOUNT_LIST_MISMATCH", any_of(lambda a, b: (F.size(_items(b)) > 0) & (F.size(_items(a)) != F.size(_items(b))))),
        ("FEE_EXCEEDS_INPUTS", fee_known & (fee >= 0) & ~amounts_bad & (F.size(_items("input_amounts")) > 0) & (fee > total + FEE_TOLERANCE)),
        ("NEGATIVE_FEE", fee_known & (fee < 0)),
        ("NEGATIVE_OR_NONFINITE_AMOUNT", amounts_bad),
        ("TXID_INVALID", (F.length("txid") > LONGEST_ID) | F.col("txid").rlike(r"\s")),
    )
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), k) for k, t in tests]), lambda k: k.isNotNull())


def facts_key() -> Column:
    """Digest of a row's chain facts in their order; null for a row without any."""
    some = (F.size(_items("input_addresses")) > 0) | (F.size(_items("output_addresses")) > 0)
    facts = F.to_json(F.struct(*[_items(c).alias(c) for c in ("input_addresses", "output_addresses", "input_amounts", "output_amounts")], F.col("fee").cast("string").alias("fee")))
    return F.when(some, F.sha2(facts, 256))


def transaction_kinds(rows: DataFrame, order: str = "timestamp") -> DataFrame:
    """``txid, kinds`` of transactions that are put aside: what is wrong with their first row that has chain facts, and rows that contradict each other.

    First is the least by ``order`` and then by the facts' digest.
    """
    keyed = rows.select("txid", F.col(order).alias("_order"), facts_key().alias("_key"), row_kinds().alias("_kinds")).where("_key IS NOT NULL")
    tx = keyed.groupBy("txid").agg(F.min_by("_kinds", F.struct("_order", "_key")).alias("kinds"), (F.min("_key") != F.max("_key")).alias("conflict"))
    kinds = F.array_sort(F.concat("kinds", F.when(F.col("conflict"), F.array(F.lit("CONFLICTING_CHAIN_FACTS"))).otherwise(F.array().cast(_LIST))))
    return tx.select("txid", kinds.alias("kinds")).where(F.size("kinds") > 0)


def gate(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row: ``n_rows, transactions, quarantined, share, refused``."""
    total = rows.agg(F.count("*").alias("n_rows"), F.count_distinct("txid").alias("transactions"))
    out = total.join(F.broadcast(kinds.agg(F.count("*").alias("quarantined"))))
    share = F.when(F.col("transactions") > 0, F.col("quarantined") / F.col("transactions")).otherwise(0.0)
    return out.select("*", F.round(share, 6).alias("share"), (share > REFUSE_SHARE).alias("refused"))


def accepted(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """The rows without transactions put aside; none if the capture is refused."""
    refused = gate(rows, kinds).select("refused")
    return rows.join(kinds.select("txid"), "txid", "left_anti").join(F.broadcast(refused)).where("NOT refused").drop("refused")


@dataclass
class Checked:
    """``report`` (see ``ingest_report``), ``kinds`` (txid, kinds) of transactions put aside, ``gate`` (one row), and ``rows`` that may be used."""

    report: DataFrame
    kinds: DataFrame
    gate: DataFrame
    rows: DataFrame


def enforce(rows: DataFrame, now_s: int) -> Checked:
    """The whole contract over a canonical capture as of a time in seconds.

    Bad rows go first; transactions are judged by the rows that stay. The capture is refused if more than REFUSE_SHARE of the
    transactions that it names, those of dropped rows included, are put aside.
    """
    marked = checkpoint(rows.withColumn("_wrong", violations(now_s)))
    good = marked.where("_wrong IS NULL").drop("_wrong")
    kinds = checkpoint(transaction_kinds(good))
    decided = gate(marked, kinds)
    usable = good.join(kinds.select("txid"), "txid", "left_anti").join(F.broadcast(decided.select("refused"))).where("NOT refused").drop("refused")
    return Checked(ingest_report(marked, kinds, F.col("_wrong")), kinds, decided, usable.select(*rows.columns))


def ingest_report(rows: DataFrame, kinds: DataFrame, violations: Column) -> DataFrame:
    """``part, kind, n``: rows by what is wrong with them (``ok`` if nothing) and transactions put aside by kind, one kind a transaction counted for each."""
    by_row = rows.groupBy(F.coalesce(violations, F.lit("ok")).alias("kind")).agg(F.count("*").alias("n")).select(F.lit("row").alias("part"), "kind", "n")
    by_tx = kinds.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("transaction").alias("part"), "kind", "n")
    return by_row.unionByName(by_tx)
