"""Small column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ramp(x: Column, low: float, high: float) -> Column:
    """0 up to ``low``, 1 from ``high``, linear between."""
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean; 0 where both are 0, null where one is."""
    total = precision + recall
    return F.when(total > 0, 2 * precision * recall / total).when(total == 0, 0.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.ln(q / (1 - q))


def safe_float(value: Column, default: float = 0.0) -> Column:
    """A number, or the default where there is none, or it is infinite, not a number or negative."""
    x = value.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")), x).otherwise(F.lit(default))


#: Fixed format of alert ids: run of 16 hexadecimal digits, colon, number without leading zeros.
ALERT_ID = r"^([0-9a-f]{16}):(0|[1-9][0-9]*)$"


def alert_id(run: Column, number: Column) -> Column:
    return F.concat_ws(":", run, number.cast("string"))


def alert_parts(value: Column) -> tuple[Column, Column]:
    """Run and number of an alert id; null where it isn't one."""
    fits = value.rlike(ALERT_ID)
    return F.when(fits, F.regexp_extract(value, ALERT_ID, 1)), F.when(fits, F.regexp_extract(value, ALERT_ID, 2).try_cast("long"))


def node_label(address: Column) -> Column:
    """An address as a node's label: the first eight and last four characters of long ones."""
    return F.when(F.length(address) > 14, F.concat(F.substring(address, 1, 8), F.lit("…"), F.right(address, F.lit(4)))).otherwise(address)
