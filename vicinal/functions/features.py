"""Payloads to feature vectors, as column expressions.

Two cases that have no defined result elsewhere are fixed here: an average of zero gives 1 for a positive amount and 0 else, and a
missing field makes the row invalid (``payload_error``) instead of being read past its end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.schema import DIM

#: What each amount is divided by.
MAX_AMOUNT, MAX_INSTALLMENTS, AVG_RATIO, MAX_MINUTES, MAX_KM, MAX_TX, MAX_MERCHANT = 10000.0, 12.0, 10.0, 1440.0, 1000.0, 20.0, 10000.0
#: Risk by merchant category, and that of all others.
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
OTHER_RISK = 0.5
SCALE = 10000


def clamp(x: Column) -> Column:
    """x within 0 and 1; what is no number becomes 0."""
    return F.when(F.isnan(x) | (x < 0), 0.0).when(x > 1, 1.0).otherwise(x)


def quantize(x: Column) -> Column:
    """Ten-thousandths, halves away from zero, within -10000 and 10000."""
    return F.when(x <= -1, -SCALE).when(x >= 1, SCALE).otherwise(F.round(x * float(SCALE))).cast("smallint")


def quantize_int8(x: Column) -> Column:
    """Towards zero, then down by 127; what a byte has no room for is an error."""
    return ((x * 254.0).cast("int") - 127).cast("tinyint")


def round4(x: Column) -> Column:
    return F.round(x * 10000.0) / 10000.0


def mcc_risk(mcc: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in MCC_RISK.items() for v in kv])
    return F.coalesce(F.try_element_at(table, mcc), F.lit(OTHER_RISK))


def parse_time(text: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ as a timestamp; null if it isn't one. The session's zone must be UTC."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def is_unknown_merchant(known: Column, merchant: Column) -> Column:
    return F.when(F.coalesce(F.array_contains(known, merchant), F.lit(False)), 0.0).otherwise(1.0)


def vector(p: str = "") -> list[Column]:
    """The 14 features of a payload whose fields are columns, or fields of the struct ``p``."""
    c = lambda name: F.col(f"{p}.{name}" if p else name)
    amount, average = c("transaction.amount"), c("customer.avg_amount")
    now, last = parse_time(c("transaction.requested_at")), c("last_transaction")
    ratio = F.when(average == 0, F.when(amount > 0, 1.0).otherwise(0.0)).otherwise(clamp(amount / F.when(average != 0, average) / AVG_RATIO))
    minutes = (F.unix_timestamp(now) - F.unix_timestamp(parse_time(c("last_transaction.timestamp")))) / 60.0
    return [
        clamp(amount / MAX_AMOUNT),
        clamp(c("transaction.installments").cast("double") / MAX_INSTALLMENTS),
        ratio,
        F.hour(now) / 23.0,
        F.weekday(now) / 6.0,
        F.when(last.isNull(), -1.0).otherwise(clamp(minutes / MAX_MINUTES)),
        F.when(last.isNull(), -1.0).otherwise(clamp(c("last_transaction.km_from_current") / MAX_KM)),
        clamp(c("terminal.km_from_home") / MAX_KM),
        clamp(c("customer.tx_count_24h").cast("double") / MAX_TX),
        c("terminal.is_online").cast("int").cast("double"),
        c("terminal.card_present").cast("int").cast("double"),
        is_unknown_merchant(c("customer.known_merchants"), c("merchant.id")),
        mcc_risk(c("merchant.mcc")),
        clamp(c("merchant.avg_amount") / MAX_MERCHANT),
    ]


def payload_error(p: str = "") -> Column:
    """The first field that is missing or unreadable, else null. last_transaction may be null, its fields may not."""
    c = lambda name: F.col(f"{p}.{name}" if p else name)
    needed = ["transaction.amount", "transaction.installments", "customer.avg_amount", "customer.tx_count_24h", "customer.known_merchants", "merchant.id", "merchant.mcc", "merchant.avg_amount", "terminal.is_online", "terminal.card_present", "terminal.km_from_home"]
    checks = [F.when(c(n).isNull(), F.lit(n)) for n in needed]
    checks.append(F.when(parse_time(c("transaction.requested_at")).isNull(), F.lit("transaction.requested_at")))
    later = c("last_transaction").isNotNull()
    checks.append(F.when(later & parse_time(c("last_transaction.timestamp")).isNull(), F.lit("last_transaction.timestamp")))
    checks.append(F.when(later & c("last_transaction.km_from_current").isNull(), F.lit("last_transaction.km_from_current")))
    return F.coalesce(*checks)


def vectorize(df: DataFrame, p: str = "", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``keep``, v0..v13 (double): the features as columns, so that they stay in generated code."""
    return df.select(*keep, *[v.alias(f"v{i}") for i, v in enumerate(vector(p))])


def quantized(df: DataFrame) -> DataFrame:
    """v0..v13 replaced by q0..q13 (smallint)."""
    names = [f"v{i}" for i in range(DIM)]
    return df.select(*[c for c in df.columns if c not in names], *[quantize(F.col(v)).alias(f"q{i}") for i, v in enumerate(names)])


def part_key(q: str = "q") -> Column:
    """The 8-bit key of the discrete dimensions: two vectors of different keys differ in one of them or lie on other sides of a cut."""
    c = lambda i: F.col(f"{q}{i}")
    bit = lambda cond, b: F.when(cond, 1 << b).otherwise(0)
    risk = F.when(c(12) <= 2047, 0).when(c(12) <= 4095, 1).when(c(12) <= 6143, 2).otherwise(3)
    return (bit(c(5) >= 0, 0) + bit(c(9) > 0, 1) + bit(c(10) > 0, 2) + bit(c(11) > 0, 3) + risk * 16 + bit(c(2) > 4096, 6) + bit(c(8) > 2048, 7)).cast("int")


def part_keys(points: np.ndarray) -> np.ndarray:
    """``part_key`` of quantized vectors that are rows of an array."""
    c = points.T
    risk = (c[12] > 2047).astype(np.int64) + (c[12] > 4095) + (c[12] > 6143)
    flags = ((c[5] >= 0, 1), (c[9] > 0, 2), (c[10] > 0, 4), (c[11] > 0, 8), (c[2] > 4096, 64), (c[8] > 2048, 128))
    return risk * 16 + sum((f.astype(np.int64) * b for f, b in flags), np.zeros(len(points), np.int64))
