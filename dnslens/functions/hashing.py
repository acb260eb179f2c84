"""Seeded, engine-independent pseudo-random numbers and question hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, key: Column, draw: int) -> Column:
    """A number in [0, 1) that depends only on (seed, key, draw)."""
    text = F.concat_ws("/", F.lit(str(seed)), key.cast("string"), F.lit(str(draw)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def question_hash(qname: Column, qtype: Column, qclass: Column) -> Column:
    """Hash of the case-folded question."""
    return F.md5(
        F.concat_ws("/", F.lower(qname), qtype.cast("string"), qclass.cast("string"))
    )


def hash_bucket(key: Column, buckets: int, salt: str = "") -> Column:
    """A stable bucket number in [0, buckets)."""
    text = F.concat(F.lit(salt), key.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(buckets))
