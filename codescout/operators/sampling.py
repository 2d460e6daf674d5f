"""Sampling plans over two query sources, exact-size draws and data set preparation."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codescout.functions.draws import draw
from codescout.functions.text import instruction_anchor, triplet_word_length
from codescout.operators.running import GROUP_LIMIT, first_per_group, row_numbers, running_sums
from codescout.session import materialise

#: Groups (about 50 bytes each) whose cut-off draws are broadcast.
MOST_CUTS = 1 << 18
TRIPLET = ("anchor", "positives", "negatives")

# Names of the sampling rules as they appear in the plan.
USE_ALL = "Use all available (insufficient total)"
SYNTHETIC_ONLY = "Synthetic only (no paraphrased available)"
ALL_PARAPHRASED = "All paraphrased + synthetic (paraphrased <= {threshold})"
EQUAL_WEIGHT = "Equal weight (paraphrased > 200)"
PRIORITIZE = "Prioritize paraphrased, fill with synthetic"
MANY_PARAPHRASED = 200
PREFERRED_SHARE = 0.7


def query_stats(synthetic: DataFrame, paraphrased: DataFrame) -> DataFrame:
    """Query counts per specialty of the synthetic set; paraphrased ones may be missing."""
    made = synthetic.groupBy("specialty").agg(F.count("*").alias("synthetic"))
    rephrased = paraphrased.groupBy("specialty").agg(F.count("*").alias("paraphrased"))
    joined = made.join(rephrased, "specialty", "left")
    count = F.coalesce("paraphrased", F.lit(0).cast("long"))
    return joined.select(
        "specialty", count.alias("paraphrased"), "synthetic", (count + F.col("synthetic")).alias("total")
    )


def source_overlap(synthetic: DataFrame, paraphrased: DataFrame) -> DataFrame:
    """How many specialties each source has, both share, and only the synthetic one has."""
    marks = (
        synthetic.select("specialty", F.lit(1).alias("s"), F.lit(0).alias("p"))
        .unionByName(paraphrased.select("specialty", F.lit(0).alias("s"), F.lit(1).alias("p")))
        .groupBy("specialty")
        .agg(F.max("s").alias("s"), F.max("p").alias("p"))
    )
    return marks.agg(
        F.count_if(F.col("s") == 1).alias("synthetic"),
        F.count_if(F.col("p") == 1).alias("paraphrased"),
        F.count_if((F.col("s") == 1) & (F.col("p") == 1)).alias("both"),
        F.count_if((F.col("s") == 1) & (F.col("p") == 0)).alias("only_synthetic"),
    )


def sampling_plan(stats: DataFrame, target: int = 250, paraphrased_threshold: int = 50) -> DataFrame:
    """How many queries of each source to draw per specialty, by ordered rules."""
    p, s, total = F.col("paraphrased"), F.col("synthetic"), F.col("total")
    goal = F.lit(target).cast("long")
    half = F.lit(target // 2).cast("long")
    preferred = F.lit(int(target * PREFERRED_SHARE)).cast("long")
    whole = total < target
    none = p == 0
    few = p <= paraphrased_threshold
    many = p > MANY_PARAPHRASED

    # Equal shares: what is missing is taken from the synthetic side unless that side
    # of the paraphrased share was the short one.
    half_p, half_s = F.least(half, p), F.least(half, s)
    missing = goal - half_p - half_s
    short = half_p < half
    equal_p = half_p + F.when((missing > 0) & short, F.least(missing, p - half_p)).otherwise(0)
    equal_s = half_s + F.when((missing > 0) & ~short, F.least(missing, s - half_s)).otherwise(0)

    first_p = F.least(preferred, p)
    fill_s = F.least(goal - first_p, s)
    lead_p = first_p + F.greatest(F.lit(0).cast("long"), F.least(goal - first_p - fill_s, p - first_p))

    zero = F.lit(0).cast("long")
    take_p = F.when(whole, p).when(none, zero).when(few, p).when(many, equal_p).otherwise(lead_p)
    take_s = (
        F.when(whole, s)
        .when(none, F.least(goal, s))
        .when(few, F.least(goal - p, s))
        .when(many, equal_s)
        .otherwise(fill_s)
    )
    strategy = (
        F.when(whole, USE_ALL)
        .when(none, SYNTHETIC_ONLY)
        .when(few, ALL_PARAPHRASED.format(threshold=paraphrased_threshold))
        .when(many, EQUAL_WEIGHT)
        .otherwise(PRIORITIZE)
    )
    planned = stats.select(
        "specialty", p, s, total, take_p.alias("take_p"), take_s.alias("take_s"), strategy.alias("sampling_strategy")
    )
    drawn = F.col("take_p") + F.col("take_s")
    return planned.select(
        "specialty",
        F.col("paraphrased").alias("original_paraphrased"),
        F.col("synthetic").alias("original_synthetic"),
        F.col("total").alias("original_total"),
        F.col("take_p").alias("sampled_paraphrased"),
        F.col("take_s").alias("sampled_synthetic"),
        drawn.alias("total_sampled"),
        F.round(F.coalesce(F.try_divide(F.col("take_p").cast("double"), drawn), F.lit(0.0)), 3).alias("paraphrased_ratio"),
        "sampling_strategy",
        (drawn == target).alias("target_met"),
    )


def sampling_summary(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count("*").alias("specialties"),
        F.count_if("target_met").alias("meeting_target"),
        F.round(F.avg("paraphrased_ratio"), 3).alias("mean_ratio"),
        F.count_if(F.col("original_paraphrased") == 0).alias("without_paraphrased"),
        F.count_if(F.col("original_paraphrased") > MANY_PARAPHRASED).alias("above_200_paraphrased"),
    )


def draw_samples(
    plan: DataFrame, synthetic: DataFrame, paraphrased: DataFrame, target: int = 250, seed: int = 42
) -> DataFrame:
    """The planned number of queries per specialty and source, without replacement.

    A plan never asks for more than ``target`` or than a small specialty has, so each
    task cuts its share of a specialty to ``target`` rows before anything is shuffled.
    """
    wanted = plan.select(
        "specialty",
        F.explode(
            F.create_map(
                F.lit("paraphrased"), F.col("sampled_paraphrased"), F.lit("synthetic"), F.col("sampled_synthetic")
            )
        ).alias("source", "planned"),
    )
    both = paraphrased.select("specialty", "query", F.lit("paraphrased").alias("source")).unionByName(
        synthetic.select("specialty", "query", F.lit("synthetic").alias("source"))
    )
    drawn = sample_per_group(both, target, seed, ["specialty", "source"], place="_place")
    return (
        drawn.join(wanted, ["specialty", "source"])
        .filter(F.col("_place") <= F.col("planned"))
        .select("specialty", "source", "query")
    )


def sample_per_group(
    rows: DataFrame,
    n: int,
    seed: int = 42,
    group: Sequence[str] = ("specialty",),
    keys: Sequence[str] = ("query",),
    place: str | None = None,
) -> DataFrame:
    """Up to n rows per group in a seeded random order.

    Up to a thousand, Spark limits each group inside the map tasks first, so a hot group shuffles at most n rows per task. For more, a
    cut-off draw is found for every group from counts of the draws' first digits, and only rows up to it are ordered.
    """
    name = place or "_place"
    drawn = rows.withColumn("_draw", draw(seed, *[F.col(k) for k in keys]))
    if n > GROUP_LIMIT:
        drawn = _below_cut(drawn, list(group), n)
    kept = first_per_group(drawn, list(group), [F.col("_draw").asc(), *[F.col(k).asc() for k in keys]], n, name).drop("_draw")
    return kept if place else kept.drop("_place")


def _below_cut(drawn: DataFrame, group: list[str], n: int) -> DataFrame:
    """The rows of ``drawn`` that can be among the first ``n`` draws of their group: n and a few more, unless draws are equal.

    Draws are hexadecimal digits in random order, so groups are counted by as many leading digits as make about a hundred rows in
    each bin of the largest group.
    """
    sizes = drawn.groupBy(*group).count()
    largest = sizes.agg(F.max("count")).first()[0] or 0
    digits = max(1, min(8, math.ceil(math.log(max(1.0, largest / 100), 16))))
    bins = drawn.groupBy(*group, F.substring("_draw", 1, digits).alias("_bin")).agg(F.count("*").alias("_rows"))
    # Rows before each bin; the bins of a group are spread over tasks, too.
    summed = running_sums(bins, group, [F.col("_bin").asc()], {"_upto": F.col("_rows")})
    cuts = summed.filter(F.col("_upto") - F.col("_rows") < n).groupBy(*group).agg(F.max("_bin").alias("_cut"))
    # One row per group: sent to the rows where they are, or large groups would go to a task each.
    cuts = materialise(cuts)
    cuts = F.broadcast(cuts) if cuts.count() <= MOST_CUTS else cuts
    same = functools.reduce(Column.__and__, [drawn[g].eqNullSafe(cuts[g]) for g in group])
    cut = drawn.join(cuts, same).filter(F.substring("_draw", 1, digits) <= F.col("_cut"))
    return cut.select(*[drawn[c] for c in drawn.columns])


def first_rows(rows: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first n rows in a given order."""
    return rows.orderBy(*order).limit(n)


def drop_null_rows(rows: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null, in all columns or in the named ones."""
    return rows.na.drop(subset=list(subset) if subset else None)


def dedup_triplets(rows: DataFrame) -> DataFrame:
    """Distinct text triplets."""
    return rows.select(*TRIPLET).dropDuplicates()


def with_instruction_anchor(rows: DataFrame) -> DataFrame:
    """Replace the anchor by its instruction form; a ``query`` column takes precedence."""
    text = F.col("query") if "query" in rows.columns else F.col("anchor")
    return rows.withColumn("anchor", instruction_anchor(F.col("specialty"), text))


def prepare_split(
    rows: DataFrame,
    per_specialty: int | None = None,
    seed: int = 412,
    instruction: bool = False,
    strict: bool = True,
) -> DataFrame:
    """Sample, then drop null rows, then remove repeats; the order of the steps matters.

    ``strict`` also drops rows whose specialty is null.
    """
    columns = [c for c in ("specialty", "anchor", "query", *TRIPLET[1:]) if c in rows.columns]
    out = rows.select(columns)
    text = "query" if "query" in out.columns else "anchor"
    if per_specialty is not None:
        out = sample_per_group(out, per_specialty, seed, keys=[text, "positives", "negatives"])
    out = drop_null_rows(out, None if strict else [text, "positives", "negatives"])
    out = with_instruction_anchor(out) if instruction else out.withColumn("anchor", F.col(text))
    return dedup_triplets(out)


def prepare_splits(
    train: DataFrame, evaluation: DataFrame, test: DataFrame, per_specialty: int | None = 10, **options
) -> dict[str, DataFrame]:
    """Clean all three splits; only the evaluation split is sampled."""
    return {
        "train": prepare_split(train, None, **options),
        "eval": prepare_split(evaluation, per_specialty, **options),
        "test": prepare_split(test, None, **options),
    }


def split_report(raw: dict[str, DataFrame], subset: Sequence[str] | None = TRIPLET) -> DataFrame:
    """Rows, rows removed for nulls and rows left after cleaning, per split.

    ``subset`` names the columns that must not be null and holds the triplet columns;
    None checks all columns.
    """
    checked = list(subset or next(iter(raw.values())).columns)
    parts = [rows.select(F.lit(name).alias("split"), *checked) for name, rows in raw.items()]
    every = functools.reduce(DataFrame.unionByName, parts)
    complete = functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in checked])
    counts = every.groupBy("split").agg(
        F.count("*").alias("rows"), F.count_if(~complete).alias("removed_nulls")
    )
    left = every.filter(complete).select("split", *TRIPLET).distinct().groupBy("split").agg(F.count("*").alias("_left"))
    return counts.join(left, "split", "left").select(
        "split", "rows", "removed_nulls", F.coalesce("_left", F.lit(0).cast("long")).alias("final_rows")
    )


def length_batches(rows: DataFrame, size: int, keys: Sequence[str]) -> DataFrame:
    """Batches of ``size`` rows in the order of ``keys``, each ordered inside by word length.

    Adds the batch number, the length and the place inside the batch. ``keys`` together are unique and not null. Rows are numbered by
    keys and lengths alone; texts meet their numbers in a join on the keys.
    """
    measured = rows.select(*keys, triplet_word_length(*[F.col(c) for c in TRIPLET]).alias("length"))
    numbered = row_numbers(measured, [F.col(k).asc() for k in keys], "_row")
    batched = numbered.withColumn("batch", F.floor((F.col("_row") - 1) / size))
    inside = Window.partitionBy("batch").orderBy("length", "_row")
    placed = batched.withColumn("place", F.row_number().over(inside)).drop("_row")
    return rows.join(placed, list(keys)).select(*rows.columns, "batch", "length", "place")
