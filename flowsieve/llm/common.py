"""What the training-data operators share: the word pattern, stored results, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.session import cut_lineage, shared_dir

# Words are runs of anything but ASCII white space, in every operator of this package.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder all executors share.

    Spark deletes such files with the result when ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set.  Meant for narrow rows; ``stored_table`` keeps wide ones compressed.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a compressed table under the shared folder and read back."""
    return cut_lineage(df, name)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents whose labels no model may learn from.

    A null id is never held out and never learned from: it cannot carry a label.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node reachable.

    Alternating large-star and small-star rounds: each node's neighbours are pointed at the
    smallest one, so the number of rounds grows with the logarithm of the longest path.  A
    round needs one minimum per node and one join for either star; no neighbour list is ever
    gathered, and a node with very many neighbours is split like any skewed join key.
    """
    pairs = stored(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = (
            both.join(lowest, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = stored(large.where(F.col("u") != F.col("v")).distinct())
        lowest = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lowest, "u")
        small = small.select("v", "m").union(small.select("u", "m")).toDF("u", "v")
        pairs = stored(small.where(F.col("u") != F.col("v")).distinct())
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """``(text, label)`` of at most ``rows`` labelled documents a model may learn from.

    They are those whose ids hash lowest, so the sample does not depend on the partitioning.
    An id labelled twice counts as 1 if any of its labels is.  At most ``rows`` ids are broadcast.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(stored(chosen)), "doc_id").select("text", "label")
