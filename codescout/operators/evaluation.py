"""How good retrieval is: precision and recall at k, and the best similarity threshold."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescout.functions.draws import draw
from codescout.functions.text import code_family
from codescout.functions.vectors import cosine
from codescout.operators import blocks
from codescout.operators.running import row_numbers, running_sums

#: Scores whose counts are one row while they are summed up.
_TOGETHER = 1 << 14
_ROUNDED = 1.5 * 2.0**52
#: Bits of the sum of that and the lowest score.
_LOWEST_BITS = np.array([_ROUNDED - blocks.MICRO]).view(np.int64)[0]


def precision_recall_at_k(df: DataFrame, k: int, relevant: str = "relevant", retrieved: str = "retrieved") -> DataFrame:
    """Family-aware precision and recall of ranked code lists, with match counts.

    Precision divides by the retrieved codes with their repeats, recall by the
    distinct relevant families. An empty side gives 0 throughout.
    """
    top = F.slice(retrieved, 1, k)
    families = F.array_distinct(F.transform(relevant, code_family))
    matched = F.size(F.array_intersect(families, F.array_distinct(F.transform(top, code_family))))
    exact = F.size(F.array_intersect(relevant, top))
    usable = (F.size(top) > 0) & (F.size(relevant) > 0)

    def ratio(part: Column, whole: Column) -> Column:
        return F.round(F.when(usable, F.try_divide(part.cast("double"), whole)).otherwise(0.0), 6)

    return df.select(
        "*",
        ratio(matched, F.size(top)).alias("precision"),
        ratio(matched, F.size(families)).alias("recall"),
        F.when(usable, exact).otherwise(0).alias("exact_matches"),
        F.when(usable, matched).otherwise(0).alias("family_matches"),
    )


def family_weighted_precision(exact: Column, family: Column, k: Column) -> Column:
    """Exact matches count whole, family-only matches half."""
    return F.coalesce(F.try_divide(exact + F.lit(0.5) * (family - exact), k), F.lit(0.0))


def assign_folds(queries: DataFrame, folds: int, seed: int = 42, key: str = "query") -> DataFrame:
    """Folds of equal size (within one) over a random order of the distinct queries."""
    distinct = queries.select(key).distinct().withColumn("_draw", draw(seed, F.col(key)))
    numbered = row_numbers(distinct, [F.col("_draw").asc(), F.col(key).asc()], "_place")
    return numbered.select(key, ((F.col("_place") - 1) % folds).cast("int").alias("fold"))


def score_counts(
    queries: DataFrame,
    codes: DataFrame,
    truth: DataFrame,
    fold: str | None = None,
    vector: str = "embedding",
    **limits: int,
) -> DataFrame:
    """Per six-place score (and fold): all (query, code) pairs and the relevant ones.

    All pairs are counted inside the blocks, and there are at most 2,000,001 scores;
    only relevant pairs, which are given, are looked up one by one. ``codes`` has an
    ``ord`` column: a repeated code is relevant at its first row only. Codes of the
    truth that are not in the reference are ignored.
    """
    keyed = queries.withColumn("fold", F.col(fold) if fold else F.lit(0))
    schema = T.StructType(
        [
            T.StructField("fold", T.IntegerType()),
            T.StructField("_part", T.IntegerType()),
            T.StructField("_counts", T.BinaryType()),
        ]
    )

    class Counts(blocks.Total):
        """Pairs per fold and score, counted over all blocks of a task; the counts of many scores are one row."""

        def __init__(self) -> None:
            self.of_fold: dict[int, np.ndarray] = {}

        def add(self, left: blocks.Block, right: blocks.Block) -> None:
            folds = left.columns["fold"].to_numpy(zero_copy_only=False)
            for value in np.unique(folds).tolist():
                if value not in self.of_fold:
                    self.of_fold[value] = np.zeros(-(-(2 * blocks.MICRO + 1) // _TOGETHER) * _TOGETHER, np.int64)
                rows = np.flatnonzero(folds == value)
                for at in range(0, len(rows), blocks.PRODUCT_ROWS):
                    scores = left.unit[rows[at:at + blocks.PRODUCT_ROWS]] @ right.unit.T
                    scores *= blocks.MICRO
                    # Adding 1.5 * 2^52 rounds to a whole number and leaves it in the lowest bits, where it is counted without a copy.
                    scores += _ROUNDED
                    places = scores.view(np.int64)
                    places -= _LOWEST_BITS
                    np.add.at(self.of_fold[value], places.ravel(), 1)

        def result(self) -> dict[str, pa.Array]:
            rows = []
            for value, counts in self.of_fold.items():
                parts = counts.reshape(-1, _TOGETHER)
                rows += [(value, part, parts[part].tobytes()) for part in np.flatnonzero(parts.any(axis=1)).tolist()]
            kinds = (pa.int32(), pa.int32(), pa.binary())
            return {name: pa.array([row[i] for row in rows], kind) for i, (name, kind) in enumerate(zip(schema.names, kinds))}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((f, p, c) for batch in batches for f, p, c in zip(*(batch.column(i) for i in range(3))))
        for (value, part), same in itertools.groupby(rows, key=lambda row: (row[0].as_py(), row[1].as_py())):
            counts = np.zeros(_TOGETHER, np.int64)
            for row in same:
                counts += np.frombuffer(row[2].as_buffer(), np.int64)
            found = np.flatnonzero(counts)
            columns = [np.full(len(found), value, np.int32), found + part * _TOGETHER - blocks.MICRO, counts[found]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["fold", "score", "n"])

    if blocks.fits_task(codes, vector, **limits):
        counted = blocks.beside(keyed, codes, ["query", "fold"], ["code"], vector, Counts, schema)
    else:
        sizes = {name: value for name, value in limits.items() if name != "task_bytes"}
        counted, _ = blocks.meet(keyed, codes, ["query", "fold"], ["code"], vector, Counts, schema, **sizes)
    dealt = counted.repartition("fold", "_part").sortWithinPartitions("fold", "_part")
    parts = dealt.mapInArrow(summed, "fold int, score long, n long")
    first = codes.groupBy("code").agg(F.min_by(vector, "ord").alias("_code_vector"))
    relevant = (
        truth.select("query", "code")
        .distinct()
        .join(first, "code")
        .join(keyed.select("query", "fold", vector), "query")
        .select("fold", F.rint(cosine(vector, "_code_vector") * blocks.MICRO).cast("long").alias("score"))
        .groupBy("fold", "score")
        .agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("hits"))
    )
    return (
        parts.withColumn("hits", F.lit(0).cast("long"))
        .unionByName(relevant)
        .groupBy("fold", "score")
        .agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    )


def _best_threshold(counts: DataFrame) -> DataFrame:
    """Threshold of highest F1 per fold from (fold, score, n, hits)."""
    summed = running_sums(
        counts.select("fold", "score", "n", "hits"),
        ["fold"],
        [F.col("score").desc()],
        {"_retrieved": F.col("n"), "_found": F.col("hits")},
    )
    totals = summed.groupBy("fold").agg(F.max("_found").alias("_relevant"))
    f1 = F.round(2 * F.col("_found") / (F.col("_retrieved") + F.col("_relevant")), 9)
    return (
        summed.join(totals, "fold")
        .withColumn("f1", f1)
        .groupBy("fold")
        .agg(F.max_by(F.struct("score", "f1"), F.struct(F.col("f1"), -F.col("score"))).alias("_best"))
        .select(
            "fold",
            (F.col("_best")["score"] / blocks.MICRO).alias("threshold"),
            F.round(F.col("_best")["f1"], 6).alias("f1"),
        )
    )


def optimal_threshold(
    queries: DataFrame, codes: DataFrame, truth: DataFrame, **limits: int
) -> DataFrame:
    """Similarity threshold of highest F1 over all (query, code) pairs, the lowest on ties."""
    return _best_threshold(score_counts(queries, codes, truth, **limits)).drop("fold")


def cv_threshold(
    queries: DataFrame,
    codes: DataFrame,
    truth: DataFrame,
    folds: int = 5,
    seed: int = 42,
    **limits: int,
) -> DataFrame:
    """Best threshold on the training part of each fold.

    Pairs are counted once per fold; the training part of a fold is the sum of the
    others.
    """
    placed = queries.join(assign_folds(queries, folds, seed), "query")
    counts = score_counts(placed, codes, truth, fold="fold", **limits)
    other_folds = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    training = (
        counts.select(F.explode(other_folds).alias("held_out"), "score", "n", "hits")
        .groupBy(F.col("held_out").alias("fold"), "score")
        .agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    )
    return _best_threshold(training)


def mean_threshold(per_fold: DataFrame) -> DataFrame:
    """Mean of the fold thresholds."""
    return per_fold.agg(
        F.round(F.avg("threshold"), 6).alias("mean_threshold"), F.count("*").alias("folds")
    )
