"""Rows of a large table that questions may need, found where they lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash values of the keys asked for that are broadcast at most, whatever is asked for.
BUCKETS = 1 << 21


def asked_for(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """rows without most of those whose keys aren't among the wanted ones; none of the others goes.

    Hash values of the wanted keys are broadcast, so that a join, which still has to follow, shuffles few rows of a large table. Some rows
    that share the hash value of a wanted key pass.
    """
    hashed = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_asked")
    return rows.select("*", hashed).join(F.broadcast(wanted.select(hashed).distinct()), "_asked", "left_semi").drop("_asked")
