"""Latency statistics and comparisons of benchmark runs, and an audit of call rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codescout.operators.running import exact_percentiles, running_sums

RUN_KEYS = ("implementation", "optimization", "params", "batch_size")


def latency_stats(runs: DataFrame, keys: Sequence[str] = RUN_KEYS, value: str = "latency_ms") -> DataFrame:
    """Mean, median, population deviation, range and linear percentiles per configuration.

    Keys must not be null. Percentiles are exact and no configuration is gathered in
    one task, however many of the runs it has.
    """
    x = F.col(value)
    stats = runs.groupBy(*keys).agg(
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.count(x).alias("num_runs"),
    )
    percents = (50, 90, 95, 99)
    quantiles = exact_percentiles(runs.select(*keys, value), keys, value, [p / 100 for p in percents])
    return stats.join(quantiles, list(keys)).select(
        *keys,
        F.round("mean", 6).alias("mean_ms"),
        F.round("q0", 6).alias("median_ms"),
        F.round("std", 6).alias("std_ms"),
        F.col("min").alias("min_ms"),
        F.col("max").alias("max_ms"),
        *[F.round(f"q{i}", 6).alias(f"p{p}_ms") for i, p in enumerate(percents)],
        "num_runs",
    )


def throughput(batch_size: Column, mean_ms: Column) -> Column:
    """Queries per second."""
    return F.round(batch_size * F.lit(1000.0) / mean_ms, 6)


def with_throughput(stats: DataFrame) -> DataFrame:
    return stats.withColumn("throughput_qps", throughput(F.col("batch_size"), F.col("mean_ms")))


def best_by_implementation(stats: DataFrame, order: Sequence[str]) -> DataFrame:
    """Best mean, p95 and throughput per implementation with their batch sizes.

    ``order`` is the input order; the first of equal rows wins.
    """
    rows = with_throughput(stats)
    first = [F.col(c) for c in order]
    last = F.struct(-F.col("throughput_qps"), *first)
    return rows.groupBy("implementation").agg(
        F.min("mean_ms").alias("best_mean_ms"),
        F.min_by("batch_size", F.struct("mean_ms", *first)).alias("best_mean_batch"),
        F.min("p95_ms").alias("best_p95_ms"),
        F.min_by("batch_size", F.struct("p95_ms", *first)).alias("best_p95_batch"),
        F.max("throughput_qps").alias("best_throughput_qps"),
        F.min_by("batch_size", last).alias("best_throughput_batch"),
    )


def overall_recommendation(stats: DataFrame, order: Sequence[str]) -> DataFrame:
    """The single best configuration for mean latency, p95 and throughput."""
    rows = with_throughput(stats)
    first = [F.col(c) for c in order]
    keep = F.struct("implementation", "optimization", "batch_size", "mean_ms", "p95_ms", "throughput_qps")
    goals = {
        "lowest_mean": F.struct("mean_ms", *first),
        "lowest_p95": F.struct("p95_ms", *first),
        "highest_throughput": F.struct(-F.col("throughput_qps"), *first),
    }
    best = rows.agg(*[F.min_by(keep, rank).alias(goal) for goal, rank in goals.items()])
    pairs = F.array(*[F.struct(F.lit(g).alias("goal"), F.col(g).alias("best")) for g in goals])
    return best.select(F.inline(pairs)).select("goal", "best.*")


def compare_runs(baseline: DataFrame, optimised: DataFrame, order: Sequence[str]) -> DataFrame:
    """Speed-up per common batch size; the first row of a batch size counts."""

    def firsts(stats: DataFrame, prefix: str) -> DataFrame:
        row = F.min_by(F.struct("mean_ms", "p95_ms"), F.struct(*order)).alias("_r")
        return stats.groupBy("batch_size").agg(row).select(
            "batch_size",
            F.col("_r")["mean_ms"].alias(f"{prefix}_mean_ms"),
            F.col("_r")["p95_ms"].alias(f"{prefix}_p95_ms"),
        )

    joined = firsts(baseline, "baseline").join(firsts(optimised, "optimised"), "batch_size")
    return joined.select(
        "*",
        F.round(F.col("baseline_mean_ms") / F.col("optimised_mean_ms"), 6).alias("mean_speedup"),
        F.round(F.col("baseline_p95_ms") / F.col("optimised_p95_ms"), 6).alias("p95_speedup"),
    )


def average_improvement(comparison: DataFrame) -> DataFrame:
    return comparison.agg(
        F.round(F.avg("mean_speedup"), 6).alias("avg_mean_improvement"),
        F.round(F.avg("p95_speedup"), 6).alias("avg_p95_improvement"),
    )


def optimization_comparison(stats: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first result of each technique per batch size."""
    kept = F.struct(*[c for c in stats.columns if c not in ("batch_size", "optimization")])
    return (
        stats.filter(F.col("optimization").isNotNull())
        .groupBy("batch_size", "optimization")
        .agg(F.min_by(kept, F.struct(*order)).alias("_r"))
        .select("batch_size", "optimization", "_r.*")
    )


def latency_histogram(
    runs: DataFrame, keys: Sequence[str] = RUN_KEYS, value: str = "latency_ms", bins: int = 30
) -> DataFrame:
    """Counts in equal bins between the smallest and the largest value; the last bin is closed.

    If all values are equal they fall into the middle bin.
    """
    limits = runs.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    placed = runs.join(limits, list(keys))
    share = F.try_divide(F.col(value) - F.col("_low"), F.col("_high") - F.col("_low"))
    place = F.least(F.coalesce(F.floor(share * bins), F.lit(bins // 2)), F.lit(bins - 1))
    counted = (
        placed.withColumn("bin", place.cast("int")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    )
    every = limits.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counted, [*keys, "bin"], "left").select(
        *keys, "bin", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def call_rate_audit(
    calls: DataFrame, max_calls: int, period_us: int, caller: str = "caller", ts: str = "ts"
) -> DataFrame:
    """Calls in the trailing period at each moment a caller calls.

    A call counts while ``now - t < period``. Above ``max_calls`` the moment is over
    capacity, and the wait lasts until the oldest call of the period has left it.
    Every moment enters as +1 and leaves as -1 one period later; running sums over
    both give the counts, so not even one hot caller needs a window in one task.
    """
    moments = (
        calls.select(caller, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"))
        .groupBy(caller, "_at")
        .agg(F.count("*").alias("_calls"))
    )
    leaving = moments.select(
        caller,
        (F.col("_at") + period_us).alias("_at"),
        F.lit(0).alias("_enter"),
        (-F.col("_calls")).alias("_change"),
        F.lit(1).alias("_left"),
    )
    entering = moments.select(
        caller, "_at", F.lit(1).alias("_enter"), F.col("_calls").alias("_change"), F.lit(0).alias("_left")
    )
    summed = running_sums(
        leaving.unionByName(entering),
        [caller],
        [F.col("_at").asc(), F.col("_enter").asc()],
        {"calls_in_period": F.col("_change"), "_gone": F.col("_left"), "_seen": F.col("_enter")},
    ).filter(F.col("_enter") == 1)
    oldest = summed.select(caller, F.col("_seen").alias("_place"), F.col("_at").alias("_oldest"))
    matched = summed.withColumn("_place", F.col("_gone") + 1).join(oldest, [caller, "_place"])
    over = F.col("calls_in_period") > max_calls
    return matched.select(
        caller,
        F.timestamp_micros("_at").alias(ts),
        F.col("_change").alias("calls"),
        "calls_in_period",
        over.alias("over_capacity"),
        F.when(over, F.col("_oldest") + period_us - F.col("_at")).otherwise(0).alias("wait_us"),
    )
