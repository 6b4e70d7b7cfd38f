"""Deterministic identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column, length: int = 64, by: str = ":") -> Column:
    """The first ``length`` hex digits of the SHA-256 of the parts joined by ``by``."""
    return F.substring(F.sha2(F.concat_ws(by, *[p.cast("string") for p in parts]), 256), 1, length)


def asset_id(sha: Column, category: Column, detector: Column, version: Column, r: Column) -> Column:
    return digest(sha, category, detector, version, r["x"], r["y"], r["w"], r["h"], length=16)


def fingerprint(version: Column, value: Column, confidence: Column, reason: Column, extra: Column) -> Column:
    """What an acceptance is bound to; the confidence counts to four decimals."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (version, value)]
    rest = [F.coalesce(c.cast("string"), F.lit("")) for c in (reason, extra)]
    return digest(*parts, F.format_string("%.4f conf", F.bround(confidence, 4)), *rest, length=16, by="|")


def confidence(c: Column) -> Column:
    """c where it lies in 0 to 1; anything else, NaN too, is an error."""
    bad = c.isNull() | F.isnan(c) | (c < 0) | (c > 1)
    return F.when(bad, F.raise_error(F.lit("confidence must lie in 0 to 1")).cast("double")).otherwise(c)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
