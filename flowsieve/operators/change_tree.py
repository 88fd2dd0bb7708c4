"""Which part of a table changed: fingerprints of key cells in a tree, compared from the root.

A row's key hash names its cell; cells are the leaves of a tree of 16 children per node.  A node's fingerprint is
the number of its rows and the sum of their hashes, so it depends neither on row order nor on files and parents
add up their children.  A stored version has its rows in one folder per node of the first level and, within
it, sorted by cell.  Two versions are compared level by level: nodes with equal fingerprints are not followed, and rows
are read only from the folders and cells in which something differs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.hashing import hash60

# Levels of 4 bits below the root: 4,096 leaves.
LEVELS = 3
BITS = 4


def cell_of(key: Column, levels: int = LEVELS) -> Column:
    """The leaf of a key: the first bits of its hash."""
    return F.shiftright(hash60(key), 60 - BITS * levels).cast("int")


def write_version(df: DataFrame, path: str, key: str, levels: int = LEVELS) -> None:
    """Writes ``df`` under ``path``: ``rows`` in a folder per first-level node, its ``columns``, and the ``tree``.

    Rows of one key share a cell; a key may repeat, and a null key is one like any other.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    marked = df.withColumns({"__cell": cell_of(F.col(key), levels), "__row": row})
    marked = marked.withColumn("__node", F.shiftright("__cell", BITS * (levels - 1)))
    marked.repartition("__node", F.pmod("__row", F.lit(8))).sortWithinPartitions("__cell").write.partitionBy("__node").parquet(f"{path}/rows")
    # A table without rows has no folders; its columns are kept beside them.
    marked.limit(0).write.parquet(f"{path}/columns")
    rows = _rows(df.sparkSession, path)
    leaves = rows.groupBy("__cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__row").cast("decimal(38,0)")).alias("sum"))
    # Every leaf counts for all nodes above it.
    above = [F.struct(F.lit(level).alias("level"), F.shiftright("__cell", BITS * (levels - level)).alias("node")) for level in range(levels + 1)]
    each = leaves.select("n", "sum", F.explode(F.array(*above)).alias("x"))
    tree = each.groupBy("x.level", "x.node").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    tree.coalesce(1).write.parquet(f"{path}/tree")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


def changed_cells(spark: SparkSession, before: str, after: str, levels: int = LEVELS) -> DataFrame:
    """``cell, rows_before, rows_after, change`` of the leaves that differ, found from the root down."""
    old, new = (spark.read.parquet(f"{p}/tree") for p in (before, after))
    both = old.select("level", "node", F.col("n").alias("a"), F.col("sum").alias("x")).join(
        new.select("level", "node", F.col("n").alias("b"), F.col("sum").alias("y")), ["level", "node"], "full"
    )
    differ = both.where(~(F.col("a").eqNullSafe(F.col("b")) & F.col("x").eqNullSafe(F.col("y"))))
    # At most 16 ** levels nodes.
    found = differ.where(F.col("level") == 0)
    for level in range(1, levels + 1):
        parents = found.select(F.col("node").alias("parent"))
        found = differ.where(F.col("level") == level).join(F.broadcast(parents), F.shiftright("node", BITS) == F.col("parent"), "left_semi")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint") for c in ("a", "b")]
    change = F.when(counts[0] == 0, "added").when(counts[1] == 0, "removed").otherwise("changed")
    return found.select(F.col("node").alias("cell"), counts[0].alias("rows_before"), counts[1].alias("rows_after"), change.alias("change"))


def cell_rows(spark: SparkSession, path: str, cells: Sequence[int], levels: int = LEVELS) -> DataFrame:
    """Rows of ``cells``: only their folders are listed, and within them files skip other cells."""
    nodes = sorted({c >> (BITS * (levels - 1)) for c in cells})
    rows = _rows(spark, path)
    return rows.where(F.col("__node").isin(nodes) & F.col("__cell").isin(sorted(cells)))


def changed_keys(spark: SparkSession, before: str, after: str, key: str, levels: int = LEVELS) -> DataFrame:
    """``key, change`` of the keys whose rows differ, from the differing cells only."""
    cells = [r.cell for r in changed_cells(spark, before, after, levels).select("cell").collect()]

    def totals(path: str, name: str) -> DataFrame:
        rows = cell_rows(spark, path, cells, levels)
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.sum(F.col("__row").cast("decimal(38,0)")).alias(f"s_{name}"))

    old, new = totals(before, "a"), totals(after, "b").withColumnRenamed(key, "__key")
    both = old.join(new, F.col(key).eqNullSafe(F.col("__key")), "full")
    same = F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("s_a").eqNullSafe(F.col("s_b"))
    change = F.when(F.col("n_a").isNull(), "added").when(F.col("n_b").isNull(), "removed").otherwise("changed")
    return both.where(~same).select(F.coalesce(F.col(key), F.col("__key")).alias(key), change.alias("change"))
