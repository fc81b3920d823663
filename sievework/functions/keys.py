"""Deterministic hash keys: buckets, fractions, content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ROLES = ("train", "val", "test")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_bucket(text: Column | str, modulus: int, digits: int = 8) -> Column:
    """The first hex digits of SHA-1 as a number, modulo ``modulus``."""
    return F.conv(F.substring(F.sha1(col(text)), 1, digits), 16, 10).cast("long") % modulus


def hash_fraction(text: Column | str) -> Column:
    """The first 64 bits of SHA-256 as a fraction of 2^64."""
    return F.conv(F.substring(F.sha2(col(text), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def seeded(seed: int | str, text: Column | str, tag: str = "") -> Column:
    return F.concat(F.lit(f"{seed}:{tag}"), col(text).cast("string"))


def seeded_order(seed: int | str, text: Column | str) -> Column:
    """A fixed order that looks random: hex SHA-256 of seed and key. Never ``rand()``."""
    return F.sha2(seeded(seed, text), 256)


def role_by_thresholds(value: Column, bounds: Sequence[float]) -> Column:
    """The first role whose cumulative bound lies above the value, else the last."""
    return F.when(value < bounds[0], ROLES[0]).when(value < bounds[1], ROLES[1]).otherwise(ROLES[2])


def group_key(*parts: Column | str) -> Column:
    """Parts joined by a bar; null if any part is null, NaN or empty."""
    out, missing = [], F.lit(False)
    for p in parts:
        text = col(p).cast("string")
        missing = missing | text.isNull() | (text == "") | (text == "NaN")
        out.append(text)
    return F.when(~missing, F.concat_ws("|", *out))


def content_hash(text: Column | str, shape: Column | str | None = None) -> Column:
    """SHA-256 of the normalised value, led by its shape where it has one."""
    body = F.trim(F.regexp_replace(F.lower(col(text)), r"\s+", " "))
    return F.sha2(body if shape is None else F.concat(col(shape).cast("string"), body), 256)
