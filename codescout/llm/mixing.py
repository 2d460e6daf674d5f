"""Mixing sources to target weights by Poisson replication.

The rate of a source is how often a document of it is to occur on average: the share of the output that the source is to have,
divided by its size. The number of copies of a document is a Poisson number with that mean, found by inverting the distribution
at a uniform number made from a hash of seed and key. So a document's copies don't depend on other documents beyond the sizes of
the sources, and the same rows come out again after a lost task. The copies are dealt over the partitions by a hash and ordered by
it there, which is a random order of the whole.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescout.session import materialise

#: Sources up to which the table of rates (a few hundred bytes each) is sent to every executor.
BROADCAST_SOURCES = 20_000
#: Largest mean that is inverted at once; larger rates are the sum of several draws. With it, more than TERMS copies in a draw
#: have a probability below that of the smallest uniform number.
DRAW, TERMS = 16.0, 80


def uniform(seed: str, *parts: Column) -> Column:
    """A number strictly between 0 and 1 from 52 bits of an md5 hash of the parts; null parts count as ``null``."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    alpha: float = 0.0,
    epochs: float = 1.0,
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """(``_source``, ``_bytes``, ``_rate``) of every source.

    ``weights`` names the weight of each source (others are not drawn); without it a source weighs its size to the power
    ``alpha``: 0 makes all sources equal, 1 keeps the proportions. Sizes are UTF-8 bytes. The output has about ``epochs`` times the
    bytes of the input. A source without any bytes can't fill a share: it has none, and the rate ``epochs``.
    """
    size = F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(size.alias("_bytes"))
    if weights is None:
        sizes = sizes.withColumn("_weight", F.pow(F.col("_bytes").cast("double"), F.lit(float(alpha))))
    elif not weights:
        sizes = sizes.withColumn("_weight", F.lit(0.0))
    else:
        named = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in (pair[0], float(pair[1]))])
        sizes = sizes.withColumn("_weight", F.coalesce(F.element_at(named, F.col("_source")), F.lit(0.0)))
    sizes = materialise(sizes)
    filled = F.when(F.col("_bytes") > 0, F.col("_weight")).otherwise(F.lit(0.0))
    # Decimal sums don't depend on the order of the rows.
    sums = sizes.agg(F.sum("_bytes").alias("bytes"), F.sum(filled.cast("decimal(30, 9)")).cast("double").alias("weight")).first()
    share = F.col("_weight") / F.lit(float(sums.weight or 1))
    empty = F.when(F.col("_weight") > 0, F.lit(float(epochs))).otherwise(F.lit(0.0))
    full = share * F.lit(float(epochs) * (sums.bytes or 0)) / F.nullif("_bytes", F.lit(0))
    return sizes.select("_source", "_bytes", F.when(F.col("_bytes") > 0, full).otherwise(empty).alias("_rate"))


def _inverse(rated: DataFrame) -> DataFrame:
    """For every rate the number of draws, and the distribution function of one draw at 0, 1, 2, ..."""
    draws = F.greatest(F.ceil(F.col("_rate") / DRAW), F.lit(1)).cast("int")
    with_draws = rated.withColumn("_draws", draws).withColumn("_mean", F.col("_rate") / F.col("_draws"))
    first = F.exp(-F.col("_mean"))
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def on(state: Column, k: Column) -> Column:
        p = state["p"] * F.col("_mean") / k
        return F.struct(p.alias("p"), (state["c"] + p).alias("c"), F.concat(state["all"], F.array(state["c"] + p)).alias("all"))

    steps = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, on, lambda s: s["all"])
    return with_draws.select("_source", "_rate", "_draws", steps.alias("_below"))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    alpha: float = 0.0,
    epochs: float = 1.0,
    seed: str = "mix",
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """``docs``, every row as often as drawn (not at all for zero), in a random order, with ``copy`` (from 1), ``copies`` and
    ``shuffle_key``.

    A null source is a source like any other; a null key is hashed as ``null``; repeated rows get the same number of copies. Null and
    empty texts add nothing to a source's size and are drawn like its other rows. Columns of the input named like the new ones are
    replaced; names that begin with ``_`` followed by those of this module (``_source``, ``_rate``, ``_draws``, ``_below``) are
    reserved. Only the shuffle of the output moves texts.
    """
    table = materialise(_inverse(rates(docs, weights, alpha, epochs, source, text)))
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    new = ("copy", "copies", "shuffle_key")
    names = [c for c in docs.columns if c not in new]
    joined = docs.join(table, docs[source].eqNullSafe(table["_source"]))

    def add(total: Column, draw: Column) -> Column:
        at = uniform(seed, F.col(key), draw)
        return total + F.size(F.filter("_below", lambda c: c <= at))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("_draws")), F.lit(0), add)
    drawn = joined.select(*names, copies.alias("copies")).filter("copies > 0")
    copied = drawn.select(*names, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "copies")
    ordered = F.md5(
        F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("copy").cast("string"))
    )
    keyed = copied.withColumn("shuffle_key", ordered)
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
