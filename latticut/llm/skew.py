"""Joins and aggregates by keys of which one may hold a third of all rows.

Keys with more rows than a share of all are hot; there are at most 1 / share of them, so their side of a
join is broadcast whatever the size of the table. All other keys are joined by a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that can be hot at once, and rows below which no key is.
MOST_HOT, LEAST_ROWS = 20_000, 256


def _equal(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys])


def attached(rows: DataFrame, values: DataFrame, keys: list[str], count: str, total: int, how: str = "left") -> DataFrame:
    """rows joined to values, which has a row a key; how: left or inner.

    count: a column of values, the key's rows on the left side or more than these; total: all of these.
    """
    hot = F.col(count) > max(LEAST_ROWS, total // MOST_HOT)
    named = values.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in values.columns if c not in keys])
    # at most MOST_HOT rows
    few = F.broadcast(named.where(hot).withColumn("_hot", F.lit(True)))
    both = rows.join(few, _equal(rows, few, keys), "left").drop(*[f"_k_{k}" for k in keys])
    added = [c for c in values.columns if c not in keys]
    done = both.where("_hot").select(*rows.columns, *added)
    rest, cold = both.where("_hot is null").select(*rows.columns), named.where(~F.coalesce(hot, F.lit(False)))
    return done.unionByName(rest.join(cold, _equal(rest, cold, keys), how).select(*rows.columns, *added))


def salted(rows: DataFrame, values: DataFrame, key: str, count: str, each: int = 512) -> DataFrame:
    """rows joined (inner) to values by the key; both have the key's number of rows in the column count.

    values may be wide, so it isn't broadcast: a key with many rows has copies of its value, one for each `each` rows.
    """
    parts = F.ceil(F.col(count) / each).cast("int")
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != count]), parts).cast("int"))
    right = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop(count)
    return left.join(right, [key, "_salt"]).drop("_salt")
