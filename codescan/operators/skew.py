"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Join of many rows (inner, left or left_anti) with a lookup that holds few rows per key.

    The lookup is repeated ``salts`` times and the left side spread at random over the
    copies, so the rows of one popular key are shared by ``salts`` tasks.  The lookup may be as long
    as a table of the input, and Spark does not count its copies, so both sides are shuffled.
    """
    # The salt is a hash of the row, not a random number: a recomputed task must agree.
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return left.withColumn("_salt", salt.cast("long")).join(spread.hint("merge"), [*keys, "_salt"], how).drop("_salt")
