"""Lookup join that stays balanced when a few keys own much of the fact side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """A broadcast copy when ``df`` has at most ``max_rows`` rows, else ``df`` itself.

    The limit bounds what reaches the driver; past it the join shuffles and adaptive
    execution splits skewed partitions.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    *,
    weight: str,
    spread_by: Sequence[str],
    hot_rows: int = 2_000_000,
    max_hot_keys: int = 4_096,
    max_salts: int = 1_024,
) -> DataFrame:
    """Left join of ``facts`` to ``lookup``, which is unique on ``keys``.

    ``weight`` counts the fact rows per key, so hot keys are known before the join.  The
    ``max_hot_keys`` heaviest of them (a bounded, broadcast table) are split over several
    partitions; any key beyond them has less than one ``max_hot_keys``-th of all rows, which
    is no more than an even share of as many tasks: fact rows take a salt from a hash of ``spread_by`` and the lookup row is
    repeated per salt.  All other keys use salt 0, and without any hot key the join is a
    plain one.  Fact rows with a null key match nothing and are spread evenly as well.
    """
    keys = list(keys)
    spread = F.xxhash64(*spread_by)
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    null_salt = F.when(no_key, F.pmod(spread, F.lit(max_salts)).cast("int"))
    salts = F.least(F.lit(max_salts), F.ceil(F.col(weight) / F.lit(hot_rows))).cast("int")
    hot = (
        lookup.where(F.col(weight) > hot_rows)
        .orderBy(F.col(weight).desc(), *keys)
        .limit(max_hot_keys)
        .select(*keys, salts.alias("__salts"))
    )
    found = hot.collect()
    if not found:
        left = facts.withColumn("__salt", F.coalesce(null_salt, F.lit(0)))
        return left.join(lookup.withColumn("__salt", F.lit(0)), [*keys, "__salt"], "left").drop("__salt")
    hot = F.broadcast(facts.sparkSession.createDataFrame(found, hot.schema))
    left = facts.join(hot, keys, "left").withColumn(
        "__salt", F.coalesce(null_salt, F.pmod(spread, F.col("__salts")).cast("int"), F.lit(0))
    )
    right = lookup.join(hot, keys, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    )
    return left.drop("__salts").join(right.drop("__salts"), [*keys, "__salt"], "left").drop("__salt")
