"""Deterministic hashing: what is picked depends on keys and seeds only, never on row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str) -> Column:
    """`sha256:` and the hex digest of the parts joined by ':'. A null part stands as a NUL, so its place counts."""
    marked = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\0")) for p in parts]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(":", *marked), 256))


def _hex_number(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.sha2(value, 256), 1, digits), 16, 10).cast("long")


def stable_bucket(value: Column, seed: int, modulo: int) -> Column:
    """The first 12 hex digits of sha256('seed:value'), modulo `modulo`."""
    return _hex_number(F.concat(F.lit(f"{seed}:"), value.cast("string")), 12) % modulo


def stable_unit(value: Column) -> Column:
    """A number in [0, 1] from 12 hex digits, without a seed."""
    return _hex_number(value.cast("string"), 12) / F.lit(float(16**12 - 1))


def stable_index(value: Column, n: int) -> Column:
    return _hex_number(value.cast("string"), 8) % n


def order_key(seed: int, *parts: Column) -> Column:
    """A sort key that shuffles rows the same way on every run."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)
