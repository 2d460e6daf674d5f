"""Whole jobs: the operators in the order in which a user runs them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescout.operators import diversity, evaluation, labels, latency, mining, retrieval, sampling
from codescout.operators.embed import Encoder, embed_texts
from codescout.session import materialise


def one_table(tables: dict[str, DataFrame]) -> DataFrame:
    """The tables of a job below each other: ``part`` names the table, columns that it lacks are null, lists are texts."""
    named = []
    for name, table in tables.items():
        lists = {f.name: F.array_join(f.name, "|") for f in table.schema if isinstance(f.dataType, T.ArrayType)}
        named.append(table.withColumns(lists | {"part": F.lit(name)}))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def query_to_code_mapping(
    queries: DataFrame, reference: DataFrame, make_encoder: Callable[[], Encoder], k: int = 10
) -> DataFrame:
    """Embed queries and code descriptions, match them, and list the codes per query.

    The code vectors are measured before they are matched, so they are stored once.
    """
    embedded = embed_texts(queries.select("specialty", "query").distinct(), "query", make_encoder)
    described = materialise(embed_texts(reference.select("code", "description"), "description", make_encoder))
    matches = retrieval.top_k_codes(embedded, described, k, query_keys=("specialty", "query"))
    return retrieval.codes_per_query(matches)


def label_ingest(items: DataFrame, replies: DataFrame, reference: DataFrame, order: str = "ord") -> dict[str, DataFrame]:
    """Validated codes of the replies, their descriptions, open items and progress."""
    asked = replies.join(items.select("specialty", "query"), ["specialty", "query"], "left_semi")
    # All tables start here, so it is stored once.
    codes = materialise(labels.validate_codes(asked, reference))
    descriptions = labels.codes_to_descriptions(codes, labels.last_descriptions(reference, order))
    done = codes.select("specialty", "query", F.lit(True).alias("_done"))
    updated = items.join(done, ["specialty", "query"], "left").withColumn(
        "status", F.when(F.col("_done"), "completed").otherwise(F.col("status"))
    ).drop("_done")
    return {
        "codes": codes,
        "descriptions": descriptions,
        "open": updated.filter(~F.col("status").isin("completed", "failed")),
        "progress": labels.labelling_progress(updated),
    }


def diversity_evaluation(
    vectors: DataFrame, mapping: DataFrame, threshold: float = 0.8, clusters: int | None = None
) -> dict[str, DataFrame]:
    """The choices of both selection methods, their measures, means per method, and which one wins."""
    choices = materialise(diversity.run_comparison(vectors, threshold, clusters))
    measures = materialise(diversity.evaluate_methods(vectors, choices, mapping))
    summary = diversity.method_summary(measures)
    return {"choices": choices, "measures": measures, "summary": summary, "wins": diversity.method_wins(summary)}


def training_set(
    queries: DataFrame, pool: DataFrame, top_k: int = 5, num: int = 50, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Clean flat triplets mined from labelled queries, and their cosine accuracy."""
    rows = mining.explode_triplets(mining.build_triplets(queries, pool, top_k, num, seed))
    clean = materialise(sampling.prepare_split(rows))
    vectors = queries.select(F.col("query").alias("key"), "embedding").unionByName(
        pool.select(F.col("code").alias("key"), "embedding")
    )
    return clean, mining.triplet_accuracy(clean, vectors.dropDuplicates(["key"]))


def sample_queries(
    synthetic: DataFrame, paraphrased: DataFrame, target: int = 250, threshold: int = 50, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """The sampling plan and the sampled queries."""
    plan = sampling.sampling_plan(sampling.query_stats(synthetic, paraphrased), target, threshold)
    return plan, sampling.draw_samples(plan, synthetic, paraphrased, target, seed)


def retrieval_evaluation(queries: DataFrame, codes: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Mean family-aware precision and recall of the nearest codes, and total matches."""
    matches = retrieval.top_k_codes(queries, codes, k)
    retrieved = matches.groupBy("query").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda m: m["code"]).alias("retrieved")
    )
    relevant = truth.select("query", "code").distinct().groupBy("query").agg(F.collect_list("code").alias("relevant"))
    scored = evaluation.precision_recall_at_k(relevant.join(retrieved, "query"), k)
    return scored.agg(
        F.count("*").alias("queries"),
        F.round(F.avg("precision"), 6).alias("precision"),
        F.round(F.avg("recall"), 6).alias("recall"),
        F.sum("exact_matches").alias("exact_matches"),
        F.sum("family_matches").alias("family_matches"),
    )


def latency_report(runs: DataFrame) -> dict[str, DataFrame]:
    """All tables of a benchmark report."""
    order = ["batch_size", "optimization", "params"]
    stats = materialise(latency.latency_stats(runs))
    comparison = latency.compare_runs(
        stats.filter(F.col("implementation") == "baseline"),
        stats.filter(F.col("implementation") == "optimized"),
        order[1:],
    )
    return {
        "stats": latency.with_throughput(stats),
        "best": latency.best_by_implementation(stats, order),
        "recommendation": latency.overall_recommendation(stats, order),
        "techniques": latency.optimization_comparison(stats, order[2:]),
        "comparison": comparison,
        "improvement": latency.average_improvement(comparison),
        "histogram": latency.latency_histogram(runs),
    }
