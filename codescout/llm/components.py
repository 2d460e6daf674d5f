"""Connected components of links between 64-bit keys, by rounds of contraction."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescout.session import materialise, scratch_path

#: Links that one task takes.
ROWS = 100_000


def components(links: DataFrame, left: str = "a", right: str = "b", rows: int = ROWS) -> DataFrame:
    """(``node``, ``root``) for every key that occurs in a link; the root is one key of the component, the same for all of it.

    In each round every key points to the smallest of itself and its neighbours. These pointers form trees; each tree becomes its
    root, and links are redrawn between the roots. Every key with links shares a tree with another one, so at least half of them
    disappear in a round. Minima are combined before the shuffle, so a key with most of the links is no hot spot there. Null keys
    and links of a key to itself are ignored. The result is a checkpoint.

    The rounds run in as many tasks as the links need, ``rows`` for each, and not in one per shuffle partition: a small graph would
    start thousands of empty ones, and the driver keeps a record of every task.
    """
    spark = links.sparkSession
    folder = scratch_path(spark, "components")
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b").distinct()
    edges = _written(edges, f"{folder}/links")
    # No frame of a later round has more rows than twice the links.
    tasks = max(1, -(-edges.count() // rows))
    edges = edges.coalesce(tasks)
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        at = f"{folder}/{len(steps)}"
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).coalesce(tasks)
        step = _roots(_written(lowest.select(F.col("a").alias("node"), F.least("a", "low").alias("to")), f"{at}-lowest"), tasks, at)
        steps.append(step)
        edges = edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").coalesce(tasks)
        edges = edges.join(step.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").coalesce(tasks)
        edges = edges.select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct().coalesce(tasks)
        edges = _written(edges, f"{at}-links").coalesce(tasks)
    if not steps:
        out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        out = functools.reduce(lambda first, second: _then(first, second).coalesce(tasks), steps)
    out = materialise(out)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return out


def _written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written out, so that Spark knows its true size.

    A checkpoint keeps the size that was estimated, for a join the product of both sides. From round to round such a number gets
    several times as many digits, until it fills the driver.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _roots(parent: DataFrame, tasks: int, at: str) -> DataFrame:
    """(``node``, ``root``) of the trees given by (``node``, ``to``), where roots point to themselves; files go to paths like ``at``.

    Every pass goes four times as far up, so passes grow with the logarithm of the depth.
    """
    number = 0
    while True:
        parent = parent.coalesce(tasks)
        above = parent.select(F.col("node").alias("to"), F.col("to").alias("up"))
        twice = parent.join(above, "to").select("node", F.col("up").alias("to")).coalesce(tasks)
        further = twice.select(F.col("node").alias("to"), F.col("to").alias("up"))
        passed = _written(twice.join(further, "to").select("node", "to", "up").coalesce(tasks), f"{at}-pass-{number}").coalesce(tasks)
        if passed.filter("to <> up").isEmpty():
            return passed.select("node", F.col("up").alias("root"))
        parent = passed.select("node", F.col("up").alias("to"))
        number += 1


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """Roots after a further round, which knows only the roots that still had links."""
    moved = second.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return first.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
