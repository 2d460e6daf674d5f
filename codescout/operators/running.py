"""Running sums and row numbers over whole tables or groups of any size.

A plain window pulls a group into one task. Here the rows are range-partitioned on
(group, order), summed inside each range, and shifted by the totals of the ranges
before it, so even one group that holds everything is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescout.session import materialise

#: Rows per group up to which Spark limits the groups of a window inside the map tasks.
GROUP_LIMIT = 1000


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    partitions: int | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``sums`` per group in the given order.

    The order must be total inside a group for a reproducible result. One range
    shuffle is all (AQE fits the number of ranges to the data): rows are summed in their sorted range, and since groups lie next
    to each other, only the first group of a range can have begun earlier. The offsets
    are therefore one row per range and are broadcast.
    """
    group, names = list(group), list(sums)
    columns = df.columns
    valued = df.select("*", *[F.coalesce(c, F.lit(0)).alias(name) for name, c in sums.items()])
    kinds = {n: T.DoubleType() if _fractional(valued.schema[n].dataType) else T.LongType() for n in names}
    valued = valued.select(*columns, *[F.col(n).cast(kinds[n]).alias(n) for n in names])
    keys = [F.col(g).asc() for g in group]
    ranged = (
        (
            valued.repartitionByRange(partitions, *keys, *order)
            if partitions
            else valued.repartitionByRange(*keys, *order)
        )
        .sortWithinPartitions(*keys, *order)
        .withColumn("_sum_range", F.spark_partition_id())
        .mapInArrow(
            _sum_batches(group, names),
            T.StructType(
                [*valued.schema.fields, T.StructField("_sum_range", T.IntegerType()), T.StructField("_sum_row", T.LongType())]
            ),
        )
    )
    # Sampled range bounds may differ between two evaluations, so they are frozen here.
    ranged = materialise(ranged)

    held = F.struct(*(group or [F.lit(0).alias("_all")]))
    edges = ranged.groupBy("_sum_range").agg(
        F.min_by(held, "_sum_row").alias("_first"),
        F.max_by(held, "_sum_row").alias("_last"),
        *[F.max_by(n, "_sum_row").alias(f"_end_{n}") for n in names],
    )
    none = [F.lit(0).cast(kinds[n]).alias(f"_end_{n}") for n in names]
    ends = [f"_end_{n}" for n in names]
    both = edges.select("_sum_range", F.col("_first").alias("_group"), F.lit(0).alias("_side"), *none).unionByName(
        edges.select("_sum_range", F.col("_last").alias("_group"), F.lit(1).alias("_side"), *ends)
    )
    # Within one range a group that is both first and last ends after it begins.
    before = Window.partitionBy("_group").orderBy("_sum_range", "_side").rowsBetween(Window.unboundedPreceding, -1)
    offsets = both.select(
        "_sum_range", "_group", "_side", *[F.sum(f"_end_{n}").over(before).alias(f"_offset_{n}") for n in names]
    ).filter((F.col("_side") == 0) & F.col(f"_offset_{names[0]}").isNotNull())
    joined = ranged.join(F.broadcast(offsets.drop("_side")), "_sum_range", "left")
    carried = held.eqNullSafe(F.col("_group"))
    return joined.select(
        *columns,
        *[(F.col(n) + F.when(carried, F.col(f"_offset_{n}")).otherwise(F.lit(0).cast(kinds[n]))).alias(n) for n in names],
    )


def _fractional(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType))


def _sum_batches(group: list[str], names: list[str]):
    """Running sums over the sorted rows of one range, begun anew with each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, carried, seen = None, {}, 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            begins = np.zeros(size, dtype=bool)
            for name in group:
                codes = batch.column(name).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                begins[1:] |= codes[1:] != codes[:-1]
            key = tuple(batch.column(name)[0].as_py() for name in group)
            fresh = key != last_key
            begins[0] = True
            start = np.maximum.accumulate(np.where(begins, np.arange(size), 0))
            head = size if not begins[1:].any() else int(np.argmax(begins[1:])) + 1
            out = {}
            for name in names:
                values = batch.column(name).to_numpy(zero_copy_only=False)
                total = np.cumsum(values)
                running = total - (total - values)[start]
                if not fresh:
                    running[:head] += carried[name]
                carried[name] = running[-1]
                out[name] = pa.array(running)
            last_key = tuple(batch.column(name)[size - 1].as_py() for name in group)
            columns = [out.get(name, batch.column(name)) for name in batch.schema.names]
            columns.append(pa.array(np.arange(seen, seen + size)))
            seen += size
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_sum_row"])

    return run


def row_numbers(
    df: DataFrame, order: Sequence[Column], name: str, group: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """Number the rows from 1 in the given total order, per group if one is given."""
    return running_sums(df, group, order, {name: F.lit(1).cast("long")}, partitions)


def first_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str, part_rows: int = 1 << 17
) -> DataFrame:
    """The first ``n`` rows of each group in the given order, numbered from 1 in the column ``name``, for any ``n``.

    Up to a thousand, Spark's group limit cuts groups inside the map tasks. A group of more rows than ``part_rows`` is first dealt into
    parts of about that size, whatever the rows hold; the first ``n`` of each part go on, in as many rounds as it takes until what is
    left of a group fits a task. How many that are follows from the largest group, the only number that reaches the driver.
    """
    left, part_rows = df, max(part_rows, 4 * n)
    largest = 0 if n <= GROUP_LIMIT else df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    while largest > part_rows:
        parts = -(-largest // part_rows)
        dealt = left.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
        place = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
        left = dealt.withColumn(name, place).filter(F.col(name) <= n).drop(name, "_part")
        largest = parts * n
    return left.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= n)


def exact_percentiles(
    df: DataFrame, group: Sequence[str], value: str, fractions: Sequence[float]
) -> DataFrame:
    """Exact linear percentiles per group (one or more columns), as columns ``q0``, ``q1``, ... in order.

    Equal values are counted first; running counts then place every value, so a group
    of any size is never gathered in one task.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    placed = running_sums(counted, group, [F.col(value).asc()], {"_upto": F.col("_n")})
    sizes = counted.groupBy(*group).agg(F.sum("_n").alias("_size"))
    joined = placed.join(sizes, list(group))
    below = F.col("_upto") - F.col("_n")
    columns = []
    for i, fraction in enumerate(fractions):
        place = F.lit(fraction) * (F.col("_size") - 1)

        def at(index: Column) -> Column:
            return F.max(F.when((index < F.col("_upto")) & (index >= below), F.col(value)))

        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        columns.append((low + (high - low) * part).alias(f"q{i}"))
    return joined.groupBy(*group).agg(*columns)
