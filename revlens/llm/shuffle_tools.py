"""Spark helpers shared by the operators: written tables, hot-key joins, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.session import scratch_path

#: A key is hot from this share of all rows on; there are at most 1 / share such keys.
HOT_SHARE = 1 / 1000


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the cluster's checkpoint folder and read it back.

    Cuts the lineage: what follows reads the files, so a lost executor costs
    no recomputation of the steps before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns: str) -> Column:
    """64-bit key of a row's values in ``columns``; NULL differs from every value."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def join_weighted(big: DataFrame, dim: DataFrame, keys: list[str], weight: str, how: str = "left",
                  share: float = HOT_SHARE) -> DataFrame:
    """Join ``big`` with ``dim`` (one row per key), whose ``weight`` counts the key's rows in ``big``.

    Keys with at least ``share`` of the total weight -- at most 1 / share rows,
    whatever the data -- are broadcast, so a key with a third of all rows never
    meets in one task.  The other rows take a shuffled join.  ``big`` and
    ``dim`` are read twice: pass tables, not long plans.
    """
    total = dim.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) >= F.lit(max(1.0, total * share))
    hot, cold = dim.where(is_hot), dim.where(~is_hot)
    mark = hot.select(*keys).withColumn("_hot", F.lit(True))
    in_hot = big.join(F.broadcast(hot), keys, "inner")
    rest = big.join(F.broadcast(mark), keys, "left").where("_hot IS NULL").drop("_hot")
    return in_hot.unionByName(rest.join(cold.hint("merge"), keys, how))


def join_salted(big: DataFrame, dim: DataFrame, keys: list[str], weight: str, row: list[str],
                share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``big`` with ``dim`` (any number of rows per key), whose ``weight`` counts the key's rows in ``big``.

    A key with at least ``share`` of the total weight is dealt over as many
    salts as it holds shares, by a hash of the columns ``row`` of ``big``, and
    its rows of ``dim`` are repeated once per salt.  Only the salt counts of
    such keys -- at most 1 / share -- are broadcast.  Pass tables, not long plans.
    """
    weights = dim.select(*keys, weight).distinct()
    total = weights.agg(F.sum(weight)).first()[0] or 0
    part = F.lit(max(1.0, total * share))
    salts = F.when(F.col(weight) >= part, F.ceil(F.col(weight) / part)).otherwise(F.lit(1)).cast("int")
    hot = weights.where(F.col(weight) >= part).select(*keys, salts.alias("_salts"))
    dealt = big.join(F.broadcast(hot), keys, "left") \
        .withColumn("_salt", F.pmod(F.xxhash64(*row), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    spread = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(weight)
    return dealt.join(spread.hint("merge"), [*keys, "_salt"]).drop("_salt")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): equal roots, same component.

    Rounds of contraction: each node moves to the neighbour (or itself) that
    is first in the round's order, edges are relabelled, and loops and repeats
    go.  Even rounds order by node, which settles stars around their smallest
    node at once; odd rounds by a hash that changes, which halves long chains
    on average.  Every round is written to the shared folder; only whether
    edges are left comes to the driver.
    """
    spark = edges.sparkSession
    left = written(edges.where("a <> b").select("a", "b").distinct(), "cc-edges")
    labels = written(left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
                     .withColumn("root", F.col("node")), "cc-labels")
    for step in range(max_rounds):
        if not left.take(1):
            return labels
        both = left.union(left.select("b", "a"))
        # a node's own entry lets it stay where it is

        def place(node):
            order = F.col(node).cast("long") if step % 2 == 0 else F.xxhash64(node, F.lit(step))
            return F.struct(order.alias("h"), F.col(node).alias("to"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("m"), F.count("*").alias("w"))
        own = place("node")
        moves = written(near.select("node", F.least("m", own)["to"].alias("to"), "w"), "cc-moves")
        first = join_weighted(left, moves.withColumnRenamed("node", "a"), ["a"], "w", "inner") \
            .select(F.col("to").alias("a"), "b")
        second = join_weighted(first, moves.withColumnRenamed("node", "b"), ["b"], "w", "inner") \
            .select("a", F.col("to").alias("b"))
        left = written(second.where("a <> b").distinct(), "cc-edges")
        labels = written(labels.join(moves.select(F.col("node").alias("root"), "to"), "root", "left")
                         .select("node", F.coalesce("to", "root").alias("root")), "cc-labels")
    raise RuntimeError("components did not settle")


def scan_slots(spark: SparkSession) -> int:
    """Task slots of the cluster, at least 1."""
    return max(1, spark.sparkContext.defaultParallelism)
