"""Queries over texts, labels, samples and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescout.functions import text
from codescout.operators import diversity, evaluation, labels, latency, retrieval, sampling
from codescout.operators.embed import split_tokenizer, token_lengths
from codescout.plans import catalog
from codescout.plans.catalog import stacked, with_views

SEED = 42
KEYWORDS = {"eau": ["E10", "E11.9"], "and": ["A00"], "der": ["D22", "D23.1"], "tion": ["T14"], "heron": ["H10", "A00"]}
TEMPLATE = (
    "Query: {medical_query}\nField: {medical_specialty_subspecialty}\nCodes: {icd_code_description_list}\n"
    "Name the codes that do not fit."
)
HOURS_US = 3_600_000_000

# --- texts and codes -----------------------------------------------------------------------


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.table(spark, folder, "documents")


def code_family(spark: SparkSession, folder: str) -> DataFrame:
    codes = catalog.codes(spark, folder)
    both = codes.select("ord", "code").unionByName(codes.select("ord", F.replace("code", F.lit("."), F.lit("")).alias("code")))
    return both.select("ord", "code", text.code_family(F.col("code")).alias("family"))


def keyed_specialty(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.table(spark, folder, "pages").select(
        "page_id", text.keyed_specialty(F.split_part("url", F.lit("?"), F.lit(1)), F.split_part("url", F.lit("?"), F.lit(2))).alias("keyed_specialty")
    )


def file_safe_specialty(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.table(spark, folder, "pages").select("page_id", text.file_safe(F.col("url")).alias("name"))


def parsed_code_lists(spark: SparkSession, folder: str) -> DataFrame:
    parsed = catalog.replies(spark, folder).withColumn("codes", text.parse_code_list(F.col("reply")))
    return parsed.select("specialty", "query", F.size("codes").alias("n"), F.array_join("codes", "|").alias("codes"))


def instruction_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select(
        "doc_id",
        text.instruction_anchor(F.col("source"), F.col("text")).alias("anchor"),
        text.query_prefix(F.col("text")).alias("prefixed"),
    )


def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", text.word_count(F.col("text")).alias("words"))


def token_length_map(spark: SparkSession, folder: str) -> DataFrame:
    count = token_lengths(split_tokenizer)
    return catalog.triplets(spark, folder).select(
        "doc_id", F.greatest(count("anchor"), count("positives"), count("negatives")).alias("triplet_length")
    )


def triplet_lengths(spark: SparkSession, folder: str) -> DataFrame:
    texts = [F.col(c) for c in sampling.TRIPLET]
    return catalog.triplets(spark, folder).select(
        "doc_id", text.triplet_word_length(*texts).alias("word_length"), text.triplet_length(*texts).alias("longest")
    )


def line_triplet_lengths(spark: SparkSession, folder: str) -> DataFrame:
    texts = [F.col(c) for c in sampling.TRIPLET]
    rows = catalog.line_triplets(spark, folder).select("specialty", text.triplet_length(*texts).alias("longest"))
    return rows.groupBy("specialty", "longest").agg(F.count("*").alias("n"))


def clean_line_triplets(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.prepare_split(catalog.line_triplets(spark, folder))


def keyword_codes(spark: SparkSession, folder: str) -> DataFrame:
    queries = _documents(spark, folder).select(F.col("text").alias("query"), F.col("lang").alias("specialty"), "doc_id")
    default = F.concat(F.lit("Z-"), F.col("specialty"))
    found = labels.query_keyword_codes(queries, "doc_id", KEYWORDS, default)
    return found.select(F.md5("query").alias("query"), F.array_join("codes", ",").alias("codes"))


def _label_names(spark: SparkSession, folder: str) -> DataFrame:
    """Known product names as labels in alphabetical order: (ord, label)."""
    names = catalog.table(spark, folder, "part").select(F.col("p_name").alias("label")).distinct()
    return names.select(F.col("label").alias("ord"), "label")


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    guess = (
        F.when(F.col("p_size") % 4 == 0, F.col("p_name"))
        .when(F.col("p_size") % 4 == 1, second)
        .when(F.col("p_size") % 4 == 2, F.concat_ws(" ", second, F.lower("p_type")))
    )
    return catalog.table(spark, folder, "part").select("p_partkey", guess.alias("predicted"))


def closest_labels(spark: SparkSession, folder: str) -> DataFrame:
    found = labels.closest_labels(_predictions(spark, folder), _label_names(spark, folder))
    return found.select("p_partkey", "predicted", F.col("closest").alias("label"))


def validated_labels(spark: SparkSession, folder: str) -> DataFrame:
    found = labels.validated_labels(_predictions(spark, folder), _label_names(spark, folder))
    return found.select("p_partkey", F.col("valid").alias("label"))


def relevance_labels(spark: SparkSession, folder: str) -> DataFrame:
    label = (
        F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, " CANNOT_DECIDE").otherwise("relevant\n"))
        .when(F.col("toxic") == 1, "Non-relevant")
        .otherwise("non-relevant")
    )
    replies = catalog.table(spark, folder, "labels").select("doc_id", label.alias("reply"))
    return replies.select("doc_id", text.parse_relevance_label(F.col("reply")).alias("label"))


def classifications(spark: SparkSession, folder: str) -> DataFrame:
    kind = (
        F.when(F.col("lang") == "en", "diagnostic").when(F.col("lang") == "fr", "procedural").otherwise(F.col("lang"))
    )
    replies = _documents(spark, folder).select(
        "doc_id", F.concat(F.lit("classification: "), kind, F.lit("\nreason: "), F.col("text")).alias("reply")
    )
    return replies.select("doc_id", text.parse_classification(F.col("reply")).alias("r")).select("doc_id", "r.*")


def top_labels(spark: SparkSession, folder: str) -> DataFrame:
    reply = F.concat_ws(", ", F.col("p_name"), F.col("p_type"), F.reverse("p_name"), F.col("p_name"))
    more = F.when(F.col("p_size") % 2 == 0, F.concat_ws(",", reply, F.col("p_name"))).otherwise(reply)
    replies = catalog.table(spark, folder, "part").select("p_partkey", more.alias("reply"))
    parsed = labels.top_labels(replies, _label_names(spark, folder), "p_partkey")
    return parsed.select("p_partkey", F.array_join("labels", "|").alias("labels"), "complete")


def query_list_items(spark: SparkSession, folder: str) -> DataFrame:
    quoted = F.transform(
        F.split("text", "\n"), lambda line: F.concat(F.lit("'"), F.regexp_replace(line, r"(['\\])", r"\\$1"), F.lit("'"))
    )
    replies = _documents(spark, folder).select(
        "doc_id", F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias("reply")
    )
    return replies.select("doc_id", F.posexplode(text.parse_query_list(F.col("reply"))).alias("pos", "query"))


def procedural_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = ("the", "eau", "and", "der")
    return _documents(spark, folder).filter(~text.has_procedural_term(F.col("text"), terms)).select("doc_id", "lang")


def next_status(spark: SparkSession, folder: str) -> DataFrame:
    items = catalog.work_items(spark, folder)
    return items.select(
        "specialty", "query", text.next_status(F.col("status") == "completed", F.col("attempts")).alias("status")
    )


# --- labels ------------------------------------------------------------------------------------


def model_requests(spark: SparkSession, folder: str) -> DataFrame:
    descriptions = labels.last_descriptions(catalog.codes(spark, folder), "ord")
    return labels.build_requests(catalog.label_set(spark, folder), descriptions, TEMPLATE)


def valid_codes(spark: SparkSession, folder: str) -> DataFrame:
    found = labels.validate_codes(catalog.replies(spark, folder), catalog.codes(spark, folder))
    return found.select("specialty", "query", F.array_join("codes", "|").alias("codes"))


def code_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    descriptions = labels.last_descriptions(catalog.codes(spark, folder), "ord")
    found = labels.codes_to_descriptions(catalog.label_set(spark, folder), descriptions)
    return found.select("specialty", "query", F.array_join("descriptions", "|").alias("descriptions"))


def code_description_sets(spark: SparkSession, folder: str) -> DataFrame:
    descriptions = labels.last_descriptions(catalog.codes(spark, folder), "ord")
    found = labels.codes_to_descriptions(catalog.label_set(spark, folder), descriptions, distinct=True)
    return found.select("specialty", "query", F.array_join("descriptions", "|").alias("descriptions"))


def description_codes(spark: SparkSession, folder: str) -> DataFrame:
    parts = catalog.table(spark, folder, "part")
    asked = parts.select(
        "p_partkey",
        F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type")).alias("description"),
    )
    return retrieval.description_to_code(asked, catalog.codes(spark, folder), "ord")


def pending_items(spark: SparkSession, folder: str) -> DataFrame:
    items = catalog.work_items(spark, folder)
    written = items.filter(F.col("specialty") == "BUILDING")
    answered = catalog.label_set(spark, folder).filter(F.size("codes") > 0)
    return labels.pending_items(items, written, answered)


def remaining_codes(spark: SparkSession, folder: str) -> DataFrame:
    labelled = catalog.label_set(spark, folder)
    named = labelled.select(
        "specialty", "query", F.concat(F.element_at(F.concat("codes", F.array(F.lit("none"))), 1), F.lit(", Z99")).alias("reply")
    )
    left = labels.remove_nonrelevant(labelled, named)
    return left.select("specialty", "query", F.array_join("codes", "|").alias("codes"))


def queries_by_specialty(spark: SparkSession, folder: str) -> DataFrame:
    orders = catalog.table(spark, folder, "orders").select(F.col("o_orderkey"), "o_orderpriority")
    records = catalog.label_set(spark, folder).join(orders, F.col("query") == F.col("o_orderkey").cast("string")).select(
        F.when(F.size("codes") % 3 == 0, "").otherwise(F.concat(F.lit("q"), (F.col("o_orderkey") % 1000).cast("string"))).alias("query"),
        F.col("specialty").alias("nucc_class"),
        F.concat(F.lit("A/"), F.col("o_orderpriority")).alias("nucc_spec"),
        F.col("codes").alias("related_icd10cm"),
        "o_orderkey",
    )
    return labels.group_queries_by_specialty(records, "o_orderkey")


def _joined(rows: DataFrame) -> DataFrame:
    return rows.select("specialty", "query", F.array_join("codes", "|").alias("codes"))


def merged_label_list(spark: SparkSession, folder: str) -> DataFrame:
    lines = catalog.label_lines(spark, folder)
    single = F.when(F.col("code").isNull(), F.array().cast("array<string>")).otherwise(F.array("code"))
    return _joined(labels.merge_label_list(lines.select("specialty", "query", single.alias("codes"))))


def consolidated_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _joined(labels.consolidate(*catalog.label_sets(spark, folder)))


def consolidation_summary(spark: SparkSession, folder: str) -> DataFrame:
    first, second = catalog.label_sets(spark, folder)
    return labels.consolidation_summary(first, second, labels.consolidate(first, second))


def empty_queries(spark: SparkSession, folder: str) -> DataFrame:
    return labels.find_empty_queries(labels.consolidate(*catalog.label_sets(spark, folder)))


def precision_recall(spark: SparkSession, folder: str) -> DataFrame:
    first, second = catalog.label_sets(spark, folder)
    both = first.select("specialty", "query", F.col("codes").alias("relevant")).join(
        second.select("specialty", "query", F.col("codes").alias("retrieved")), ["specialty", "query"]
    )
    scored = evaluation.precision_recall_at_k(both, 2)
    weighted = evaluation.family_weighted_precision(
        F.col("exact_matches"), F.col("family_matches"), F.size(F.slice("retrieved", 1, 2))
    )
    return scored.select(
        "specialty", "query", "precision", "recall", "exact_matches", "family_matches", F.round(weighted, 6).alias("weighted")
    )


def code_coverage(spark: SparkSession, folder: str) -> DataFrame:
    everything = catalog.label_set(spark, folder)
    mapping = everything.select("query", F.explode("codes").alias("code"))
    selected = catalog.work_items(spark, folder).filter(F.col("status") == "completed")
    return diversity.code_coverage(selected, everything, mapping)


def labelling_progress(spark: SparkSession, folder: str) -> DataFrame:
    return labels.labelling_progress(catalog.work_items(spark, folder))


def overall_progress(spark: SparkSession, folder: str) -> DataFrame:
    return labels.overall_progress(catalog.work_items(spark, folder))


def specialty_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = catalog.table(spark, folder, "nation").select(F.col("n_name").alias("specialty"), "n_nationkey")
    customers = catalog.table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    queries = customers.join(rows, F.col("c_nationkey") == F.col("n_nationkey")).select("specialty", F.col("c_custkey").alias("query"))
    return labels.split_by_specialty(queries, 4)


def label_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """All tables of the job."""
    from codescout.plans.jobs import label_ingest as job
    from codescout.plans.jobs import one_table

    return one_table(job(catalog.work_items(spark, folder), catalog.replies(spark, folder), catalog.codes(spark, folder)))


# --- samples -------------------------------------------------------------------------------------


def query_stats(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.query_stats(*catalog.two_sources(spark, folder))


def source_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.source_overlap(*catalog.two_sources(spark, folder))


def _plan(spark: SparkSession, folder: str, target: int = 250) -> DataFrame:
    return sampling.sampling_plan(query_stats(spark, folder), target)


def sampling_plan(spark: SparkSession, folder: str) -> DataFrame:
    return _plan(spark, folder)


def sampling_plan_500(spark: SparkSession, folder: str) -> DataFrame:
    return _plan(spark, folder, 500)


def sampling_summary(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sampling_summary(_plan(spark, folder))


def drawn_samples(spark: SparkSession, folder: str) -> DataFrame:
    synthetic, paraphrased = catalog.two_sources(spark, folder)
    return sampling.draw_samples(_plan(spark, folder), synthetic, paraphrased, 250, SEED)


def sample_per_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = _documents(spark, folder).select(F.col("source").alias("specialty"), "doc_id", "lang")
    return sampling.sample_per_group(rows, 10, SEED, keys=["doc_id"])


def large_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of more rows than Spark limits inside the map tasks."""
    rows = catalog.table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("specialty"), "l_orderkey", "l_linenumber")
    return sampling.sample_per_group(rows, 1500, SEED, keys=["l_orderkey", "l_linenumber"])


def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = catalog.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return sampling.first_rows(rows, 100, [F.desc("o_totalprice"), F.asc("o_orderkey")])


def code_set_algebra(spark: SparkSession, folder: str) -> DataFrame:
    first, second = catalog.label_sets(spark, folder)
    both = first.select("specialty", "query", F.col("codes").alias("a")).join(
        second.select("specialty", "query", F.col("codes").alias("b")), ["specialty", "query"]
    )

    def joined(column):
        return F.array_join(F.array_sort(column), "|")

    return both.select(
        "specialty",
        "query",
        joined(F.array_union("a", "b")).alias("all_codes"),
        joined(F.array_intersect("a", "b")).alias("common"),
        joined(F.array_except("a", "b")).alias("only_first"),
    )


def complete_triplets(spark: SparkSession, folder: str) -> DataFrame:
    kept = sampling.drop_null_rows(catalog.triplets(spark, folder), sampling.TRIPLET)
    return kept.select("doc_id", "specialty", "positives", "negatives")


def distinct_triplets(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.dedup_triplets(catalog.triplets(spark, folder))


def prepared_training_split(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.prepare_split(catalog.triplets(spark, folder))


def prepared_evaluation_split(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.prepare_split(catalog.turn_triplets(spark, folder), 10, 412, instruction=True)


def prepared_test_split(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.prepare_split(catalog.page_triplets(spark, folder), strict=False)


def split_report(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.split_report(
        {
            "train": catalog.triplets(spark, folder),
            "eval": catalog.turn_triplets(spark, folder),
            "test": catalog.page_triplets(spark, folder),
        }
    )


def length_batches(spark: SparkSession, folder: str) -> DataFrame:
    batches = sampling.length_batches(catalog.triplets(spark, folder), 64, ["doc_id"])
    return batches.select("doc_id", "batch", "length", "place")


# --- latencies -----------------------------------------------------------------------------------

_ORDER = ("batch_size", "optimization", "params")


def _stats(spark: SparkSession, folder: str) -> DataFrame:
    return latency.latency_stats(catalog.latencies(spark, folder))


def latency_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _stats(spark, folder)


def latency_throughput(spark: SparkSession, folder: str) -> DataFrame:
    rates = latency.with_throughput(_stats(spark, folder))
    return rates.select(*latency.RUN_KEYS, "throughput_qps")


def best_by_implementation(spark: SparkSession, folder: str) -> DataFrame:
    return latency.best_by_implementation(_stats(spark, folder), _ORDER)


def overall_recommendation(spark: SparkSession, folder: str) -> DataFrame:
    return latency.overall_recommendation(_stats(spark, folder), _ORDER)


def optimization_comparison(spark: SparkSession, folder: str) -> DataFrame:
    first = latency.optimization_comparison(_stats(spark, folder), _ORDER[2:])
    return first.select("batch_size", "optimization", "params", "mean_ms", "p95_ms")


def _comparison(spark: SparkSession, folder: str) -> DataFrame:
    stats = _stats(spark, folder)
    kind = F.col("implementation")
    return latency.compare_runs(stats.filter(kind == "baseline"), stats.filter(kind == "optimized"), _ORDER[1:])


def compare_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _comparison(spark, folder)


def average_improvement(spark: SparkSession, folder: str) -> DataFrame:
    return latency.average_improvement(_comparison(spark, folder))


def latency_report(spark: SparkSession, folder: str) -> DataFrame:
    """All tables of the job."""
    from codescout.plans.jobs import latency_report as job
    from codescout.plans.jobs import one_table

    return one_table(job(catalog.latencies(spark, folder)))


def latency_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return latency.latency_histogram(catalog.latencies(spark, folder))


def call_rate_audit(spark: SparkSession, folder: str) -> DataFrame:
    audit = latency.call_rate_audit(catalog.calls(spark, folder), 3, 6 * HOURS_US)
    return audit.withColumn("ts", F.unix_micros("ts"))


QUERIES = {
    f.__name__: f
    for f in (
        code_family, keyed_specialty, file_safe_specialty, parsed_code_lists, instruction_anchors, word_counts,
        token_length_map, triplet_lengths, line_triplet_lengths, clean_line_triplets, keyword_codes, closest_labels, validated_labels, relevance_labels,
        classifications, top_labels, query_list_items, procedural_terms, next_status, model_requests, valid_codes,
        code_descriptions, code_description_sets, description_codes, pending_items, remaining_codes,
        queries_by_specialty, merged_label_list, consolidated_labels, consolidation_summary, empty_queries,
        precision_recall, code_coverage, labelling_progress, overall_progress, specialty_chunks, label_ingest,
        query_stats, source_overlap, sampling_plan, sampling_plan_500, sampling_summary, drawn_samples,
        sample_per_group, large_samples, first_rows, code_set_algebra, complete_triplets, distinct_triplets,
        prepared_training_split, prepared_evaluation_split, prepared_test_split, split_report, length_batches,
        latency_stats, latency_throughput, best_by_implementation, overall_recommendation,
        optimization_comparison, compare_runs, average_improvement, latency_histogram, latency_report, call_rate_audit,
    )
}

# --- SQL -----------------------------------------------------------------------------------------

def _words(column: str) -> str:
    return f"coalesce(len(regexp_extract_all({column}, '[^{text.SPACE_CHARS}]+'))::INTEGER, 0)"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^[{text.SPACE_CHARS}]+|[{text.SPACE_CHARS}]+$', '', 'g')"


def _family(code: str) -> str:
    return (
        f"CASE WHEN contains({code}, '.') THEN split_part({code}, '.', 1) "
        f"WHEN regexp_matches({code}, '^[A-Z][0-9]') THEN regexp_extract({code}, '^[A-Z][0-9]+') ELSE {code} END"
    )


_KEYWORD_TABLE = ", ".join(f"('{w}', {codes!r})" for w, codes in KEYWORDS.items())

_LABELS = """names AS (SELECT p_name AS label, row_number() OVER (ORDER BY p_name) AS ord FROM (SELECT DISTINCT p_name FROM part)),
    guesses AS (
        SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2)
               WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || lower(p_type) END AS predicted FROM part),
    scored AS (
        SELECT DISTINCT predicted, label, ord,
               contains(lower(label), lower(predicted)) OR contains(lower(predicted), lower(label)) AS inside,
               len(list_intersect(string_split(lower(predicted), ' '), string_split(lower(label), ' ')))
                 / greatest(len(list_distinct(string_split(lower(predicted), ' '))),
                            len(list_distinct(string_split(lower(label), ' '))))::DOUBLE AS score
        FROM (SELECT DISTINCT predicted FROM guesses WHERE predicted IS NOT NULL), names),
    nearest AS (
        SELECT predicted, label FROM scored
        QUALIFY row_number() OVER (PARTITION BY predicted ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE score END DESC, ord) = 1)"""

_LAST_DESCRIPTION = "last_text AS (SELECT code, arg_max(description, ord) AS description FROM codes GROUP BY code)"

_CONSOLIDATED = """both_sets AS (SELECT * FROM labels1 UNION ALL SELECT * FROM labels2),
    merged AS (SELECT specialty, query, list_sort(list_distinct(flatten(list(codes)))) AS codes FROM both_sets GROUP BY specialty, query)"""


def _plan_sql(target: int) -> str:
    half, preferred = target // 2, int(target * 0.7)
    return f"""rules AS (
        SELECT specialty, p, s, t,
               CASE WHEN t < {target} THEN 'Use all available (insufficient total)'
                    WHEN p = 0 THEN 'Synthetic only (no paraphrased available)'
                    WHEN p <= 50 THEN 'All paraphrased + synthetic (paraphrased <= 50)'
                    WHEN p > 200 THEN 'Equal weight (paraphrased > 200)'
                    ELSE 'Prioritize paraphrased, fill with synthetic' END AS strategy FROM stats),
    first AS (
        SELECT *, CASE strategy[1:5] WHEN 'Use a' THEN p WHEN 'Synth' THEN 0 WHEN 'All p' THEN p
                       WHEN 'Equal' THEN least({half}, p) ELSE least({preferred}, p) END AS p1,
               CASE strategy[1:5] WHEN 'Use a' THEN s WHEN 'Synth' THEN least({target}, s)
                    WHEN 'All p' THEN least({target} - p, s) WHEN 'Equal' THEN least({half}, s)
                    ELSE least({target} - least({preferred}, p), s) END AS s1 FROM rules),
    plan AS (
        SELECT specialty, p, s, t, strategy,
               (CASE WHEN p1 + s1 < {target} AND (strategy[1:5] = 'Prior' OR (strategy[1:5] = 'Equal' AND p1 < {half}))
                     THEN p1 + least({target} - p1 - s1, p - p1) ELSE p1 END)::BIGINT AS take_p,
               (CASE WHEN strategy[1:5] = 'Equal' AND p1 >= {half} AND p1 + s1 < {target}
                     THEN s1 + least({target} - p1 - s1, s - s1) ELSE s1 END)::BIGINT AS take_s FROM first),
    full_plan AS (
        SELECT specialty, p AS original_paraphrased, s AS original_synthetic, t AS original_total,
               take_p AS sampled_paraphrased, take_s AS sampled_synthetic, take_p + take_s AS total_sampled,
               round(CASE WHEN take_p + take_s > 0 THEN take_p / (take_p + take_s)::DOUBLE ELSE 0 END, 3) AS paraphrased_ratio,
               strategy AS sampling_strategy, take_p + take_s = {target} AS target_met FROM plan)
    """


_COMPARED = """firsts AS (
        SELECT implementation, batch_size, mean_ms, p95_ms FROM run_stats
        QUALIFY row_number() OVER (PARTITION BY implementation, batch_size ORDER BY optimization, params) = 1),
    compared AS (
        SELECT b.batch_size, b.mean_ms AS baseline_mean_ms, b.p95_ms AS baseline_p95_ms,
               o.mean_ms AS optimised_mean_ms, o.p95_ms AS optimised_p95_ms,
               round(b.mean_ms / o.mean_ms, 6) AS mean_speedup, round(b.p95_ms / o.p95_ms, 6) AS p95_speedup
        FROM firsts b JOIN firsts o ON b.batch_size = o.batch_size
        WHERE b.implementation = 'baseline' AND o.implementation = 'optimized')"""

_KEYED = "SELECT specialty, query, array_to_string({0}, '|') AS {1} FROM {2}"

SQL = {
    "code_family": with_views("codes", f"""
        SELECT ord, code, {_family('code')} AS family
        FROM (SELECT ord, code FROM codes UNION ALL SELECT ord, replace(code, '.', '') FROM codes)"""),
    "keyed_specialty": """
        SELECT page_id, replace(lower(split_part(url, '?', 1)) || '_' || lower(split_part(url, '?', 2)), '/', '') AS keyed_specialty
        FROM pages""",
    "file_safe_specialty": "SELECT page_id, replace(url, '/', '_') AS name FROM pages",
    "parsed_code_lists": with_views("replies", """
        SELECT specialty, query, CASE WHEN reply = '[]' THEN 0 ELSE len(string_split(reply, ',')) END::INTEGER AS n,
               CASE WHEN reply = '[]' THEN '' ELSE replace(reply, ', ', '|') END AS codes FROM replies"""),
    "instruction_anchors": """
        SELECT doc_id, 'Instruct: Given a medical query in the field of ' || source
               || ', retrieve the relevant ICD description' || chr(10) || 'Query: ' || text AS anchor,
               'query: ' || text AS prefixed FROM documents""",
    "word_counts": f"SELECT doc_id, {_words('text')} AS words FROM documents",
    "token_length_map": with_views("trip", f"""
        SELECT doc_id, greatest({_words('anchor')}, {_words('positives')}, {_words('negatives')}) AS triplet_length FROM trip"""),
    "triplet_lengths": with_views("trip", f"""
        SELECT doc_id, {_words('anchor')} + {_words('positives')} + {_words('negatives')} AS word_length,
               greatest({_words('anchor')}, {_words('positives')}, {_words('negatives')}) AS longest FROM trip"""),
    "line_triplet_lengths": with_views("line_trip", f"""
        SELECT specialty, greatest({_words('anchor')}, {_words('positives')}, {_words('negatives')}) AS longest, count(*) AS n
        FROM line_trip GROUP BY ALL"""),
    "clean_line_triplets": with_views("line_trip", """
        SELECT DISTINCT anchor, positives, negatives FROM line_trip
        WHERE specialty IS NOT NULL AND anchor IS NOT NULL AND positives IS NOT NULL AND negatives IS NOT NULL"""),
    "keyword_codes": f"""
        WITH words AS (SELECT * FROM (VALUES {_KEYWORD_TABLE}) t(word, codes)),
        latest AS (SELECT text, arg_max(lang, doc_id) AS lang FROM documents GROUP BY text),
        hits AS (SELECT text, unnest(codes) AS code FROM latest JOIN words ON contains(lower(text), word)),
        lists AS (SELECT text, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM hits GROUP BY text)
        SELECT md5(l.text) AS query, coalesce(codes, 'Z-' || lang) AS codes FROM latest l LEFT JOIN lists USING (text)""",
    "closest_labels": f"WITH {_LABELS} SELECT p_partkey, g.predicted, label FROM guesses g LEFT JOIN nearest USING (predicted)",
    "validated_labels": f"""WITH {_LABELS}
        SELECT p_partkey, CASE WHEN g.predicted IS NULL THEN (SELECT label FROM names WHERE ord = 1)
               WHEN g.predicted IN (SELECT label FROM names) THEN g.predicted ELSE n.label END AS label
        FROM guesses g LEFT JOIN nearest n ON g.predicted = n.predicted""",
    "relevance_labels": """
        SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'CANNOT_DECIDE' WHEN quality = 1 THEN 'relevant'
               WHEN toxic = 1 THEN NULL ELSE 'non-relevant' END AS label FROM labels""",
    "classifications": """
        SELECT doc_id, CASE lang WHEN 'en' THEN 'diagnostic' WHEN 'fr' THEN 'procedural' ELSE 'exclude' END AS classification,
               ltrim(split_part(text, chr(10), 1), ' ' || chr(9)) AS reason FROM documents""",
    "top_labels": """
        WITH names AS (SELECT DISTINCT p_name AS label FROM part),
        parts AS (
            SELECT p_partkey, p_size, p_name, generate_subscripts(items, 1) AS pos, unnest(items) AS item
            FROM (SELECT *, [p_name, p_type, reverse(p_name), p_name]
                            || CASE WHEN p_size % 2 = 0 THEN [p_name] ELSE [] END AS items FROM part))
        SELECT p_partkey, string_agg(item, '|' ORDER BY pos) AS labels, count(*) = 3 AS complete
        FROM parts WHERE item IN (SELECT label FROM names) GROUP BY p_partkey""",
    "query_list_items": """
        SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS pos,
               unnest(string_split(text, chr(10))) AS query FROM documents""",
    "procedural_terms": r"""
        SELECT doc_id, lang FROM documents
        WHERE NOT regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(the|eau|and|der)($|[^\p{L}\p{N}_])')""",
    "next_status": with_views("items", """
        SELECT specialty, query, CASE WHEN status = 'completed' THEN 'completed' WHEN attempts >= 3 THEN 'failed'
               ELSE 'pending' END AS status FROM items"""),
    "model_requests": with_views("labels_all", f""", {_LAST_DESCRIPTION},
        singles AS (SELECT specialty, query, unnest(codes) AS code FROM labels_all),
        listed AS (
            SELECT specialty, query, string_agg(code || ': ' || description, ', ' ORDER BY code || ': ' || description) AS l
            FROM singles JOIN last_text USING (code) GROUP BY specialty, query)
        SELECT a.specialty, a.query, 'Query: ' || a.query || chr(10) || 'Field: ' || a.specialty || chr(10) || 'Codes: ['
               || coalesce(l, '') || ']' || chr(10) || 'Name the codes that do not fit.' AS request
        FROM labels_all a LEFT JOIN listed b ON a.specialty = b.specialty AND a.query = b.query"""),
    "valid_codes": with_views("replies", """,
        items AS (
            SELECT specialty, query, generate_subscripts(string_split(reply, ', '), 1) AS pos,
                   unnest(string_split(reply, ', ')) AS code FROM replies WHERE reply <> '[]'),
        kept AS (
            SELECT specialty, query, string_agg(code, '|' ORDER BY pos) AS codes FROM items
            WHERE code IN (SELECT code FROM codes) GROUP BY specialty, query)
        SELECT r.specialty, r.query, coalesce(k.codes, '') AS codes
        FROM replies r LEFT JOIN kept k ON r.specialty = k.specialty AND r.query = k.query"""),
    "code_descriptions": with_views("labels_all", f""", {_LAST_DESCRIPTION},
        items AS (SELECT specialty, query, generate_subscripts(codes, 1) AS pos, unnest(codes) AS code FROM labels_all)
        SELECT specialty, query, string_agg(description, '|' ORDER BY pos) AS descriptions
        FROM items JOIN last_text USING (code) GROUP BY specialty, query"""),
    "code_description_sets": with_views("labels_all", f""", {_LAST_DESCRIPTION},
        items AS (SELECT specialty, query, unnest(codes) AS code FROM labels_all)
        SELECT specialty, query, string_agg(DISTINCT description, '|' ORDER BY description) AS descriptions
        FROM items JOIN last_text USING (code) GROUP BY specialty, query"""),
    "description_codes": with_views("codes", """,
        asked AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_name || ' ' || p_type END AS description FROM part)
        SELECT p_partkey, a.description, coalesce(c.code, 'Unknown') AS code FROM asked a
        LEFT JOIN (SELECT description, arg_max(code, ord) AS code FROM codes GROUP BY description) c USING (description)"""),
    "pending_items": with_views("items labels_all", """
        SELECT i.* FROM items i ANTI JOIN labels_all a ON i.specialty = a.specialty AND i.query = a.query AND len(a.codes) > 0
        WHERE i.specialty <> 'BUILDING'"""),
    "remaining_codes": with_views("labels_all", "SELECT specialty, query, array_to_string(codes[2:], '|') AS codes FROM labels_all"),
    "queries_by_specialty": with_views("labels_all", """,
        records AS (
            SELECT replace(lower(specialty) || '_' || lower('A/' || o_orderpriority), '/', '') AS keyed_specialty,
                   CASE WHEN len(codes) % 3 = 0 THEN '' ELSE 'q' || (o_orderkey % 1000)::VARCHAR END AS q, codes, o_orderkey AS ord
            FROM labels_all JOIN orders ON query = o_orderkey::VARCHAR),
        seen AS (
            SELECT keyed_specialty, 'query' AS kind, q AS item, ord, 0 AS pos FROM records WHERE q <> ''
            UNION ALL
            SELECT keyed_specialty, 'code', unnest(codes), ord, generate_subscripts(codes, 1) - 1 FROM records)
        SELECT keyed_specialty, kind, item, ord AS first_seen, pos::INTEGER AS first_position FROM seen
        QUALIFY row_number() OVER (PARTITION BY keyed_specialty, kind, item ORDER BY ord, pos) = 1"""),
    "merged_label_list": with_views("labels_all", _KEYED.format("codes", "codes", "labels_all")),
    "consolidated_labels": with_views("labels1 labels2", f", {_CONSOLIDATED} " + _KEYED.format("codes", "codes", "merged")),
    "consolidation_summary": with_views("labels1 labels2", f""", {_CONSOLIDATED},
        parts AS (
            SELECT 'set1' AS data_set, count(DISTINCT specialty) AS specialties, count(*) AS queries, count_if(len(codes) = 0) AS empty FROM labels1
            UNION ALL SELECT 'set2', count(DISTINCT specialty), count(*), count_if(len(codes) = 0) FROM labels2
            UNION ALL SELECT 'consolidated', count(DISTINCT specialty), count(*), count_if(len(codes) = 0) FROM merged)
        SELECT data_set, specialties, queries, empty::BIGINT AS empty FROM parts
        UNION ALL
        SELECT 'reduction', 0, 0, sum(CASE WHEN data_set = 'consolidated' THEN -empty ELSE empty END)::BIGINT FROM parts"""),
    "empty_queries": with_views("labels1 labels2", f", {_CONSOLIDATED} SELECT specialty, query FROM merged WHERE len(codes) = 0"),
    "precision_recall": with_views("labels1 labels2", f""",
        pairs AS (
            SELECT a.specialty, a.query, a.codes AS rel, b.codes[1:2] AS got FROM labels1 a
            JOIN labels2 b ON a.specialty = b.specialty AND a.query = b.query),
        fam AS (
            SELECT *, list_distinct(list_transform(rel, lambda c: {_family('c')})) AS rf,
                   list_distinct(list_transform(got, lambda c: {_family('c')})) AS gf FROM pairs),
        hit AS (SELECT *, len(list_intersect(rf, gf)) AS fm, len(list_intersect(rel, got)) AS em FROM fam)
        SELECT specialty, query,
               round(CASE WHEN len(rel) > 0 AND len(got) > 0 THEN fm / len(got)::DOUBLE ELSE 0 END, 6) AS precision,
               round(CASE WHEN len(rel) > 0 AND len(got) > 0 THEN fm / len(rf)::DOUBLE ELSE 0 END, 6) AS recall,
               em::INTEGER AS exact_matches, fm::INTEGER AS family_matches,
               round(CASE WHEN len(got) > 0 THEN (em + 0.5::DOUBLE * (fm - em)) / len(got) ELSE 0 END, 6) AS weighted
        FROM hit"""),
    "code_coverage": with_views("labels_all items", """,
        pairs AS (SELECT specialty, query, unnest(codes) AS code FROM labels_all),
        done AS (SELECT specialty, query FROM items WHERE status = 'completed')
        SELECT a.specialty, round(count(DISTINCT CASE WHEN d.query IS NOT NULL THEN a.code END)
                                  / count(DISTINCT a.code)::DOUBLE, 6) AS code_coverage
        FROM pairs a LEFT JOIN done d ON a.specialty = d.specialty AND a.query = d.query GROUP BY a.specialty"""),
    "labelling_progress": with_views("items", """
        SELECT specialty, count(*) AS total, count_if(status = 'pending')::BIGINT AS pending, 0::BIGINT AS processing,
               count_if(status = 'completed')::BIGINT AS completed, count_if(status = 'failed')::BIGINT AS failed,
               CASE WHEN count_if(status = 'pending') = 0 THEN 'completed' ELSE 'in_progress' END AS status
        FROM items GROUP BY specialty"""),
    "overall_progress": with_views("items", """
        SELECT count(*) AS total, count_if(status = 'pending')::BIGINT AS pending,
               count_if(status = 'completed')::BIGINT AS completed, count_if(status = 'failed')::BIGINT AS failed FROM items"""),
    "specialty_chunks": """
        WITH q AS (SELECT n_name AS specialty, c_custkey AS query FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT specialty, query, ((dense_rank() OVER (ORDER BY specialty) - 1)
               // ceil((SELECT count(DISTINCT specialty) FROM q) / 4.0)::INTEGER)::INTEGER AS chunk FROM q""",
    "query_stats": with_views("stats", "SELECT specialty, p::BIGINT AS paraphrased, s::BIGINT AS synthetic, t AS total FROM stats"),
    "source_overlap": with_views("sources", """,
        marks AS (SELECT specialty, bool_or(paraphrased) AS p, bool_or(NOT paraphrased) AS s FROM sources GROUP BY specialty)
        SELECT count_if(s)::BIGINT AS synthetic, count_if(p)::BIGINT AS paraphrased, count_if(s AND p)::BIGINT AS both,
               count_if(s AND NOT p)::BIGINT AS only_synthetic FROM marks"""),
    "sampling_plan": with_views("stats", ", " + _plan_sql(250) + "SELECT * FROM full_plan"),
    "sampling_plan_500": with_views("stats", ", " + _plan_sql(500) + "SELECT * FROM full_plan"),
    "sampling_summary": with_views("stats", ", " + _plan_sql(250) + """
        SELECT count(*) AS specialties, count_if(target_met)::BIGINT AS meeting_target, round(avg(paraphrased_ratio), 3) AS mean_ratio,
               count_if(original_paraphrased = 0)::BIGINT AS without_paraphrased,
               count_if(original_paraphrased > 200)::BIGINT AS above_200_paraphrased FROM full_plan"""),
    "drawn_samples": with_views("stats", ", " + _plan_sql(250) + f""",
        placed AS (
            SELECT specialty, query, paraphrased, row_number() OVER (
                PARTITION BY specialty, paraphrased ORDER BY md5('{SEED}|' || query), query) AS place FROM sources)
        SELECT a.specialty, CASE WHEN paraphrased THEN 'paraphrased' ELSE 'synthetic' END AS source, query
        FROM placed a JOIN full_plan f ON a.specialty = f.specialty
        WHERE place <= CASE WHEN paraphrased THEN sampled_paraphrased ELSE sampled_synthetic END"""),
    "sample_per_group": f"""
        SELECT source AS specialty, doc_id, lang FROM documents
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}|' || doc_id::VARCHAR), doc_id) <= 10""",
    "large_samples": f"""
        SELECT l_returnflag AS specialty, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag
            ORDER BY md5('{SEED}|' || l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR), l_orderkey, l_linenumber) <= 1500""",
    "first_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "code_set_algebra": with_views("labels1 labels2", """
        SELECT a.specialty, a.query, array_to_string(list_sort(list_distinct(a.codes || b.codes)), '|') AS all_codes,
               array_to_string(list_sort(list_intersect(a.codes, b.codes)), '|') AS common,
               array_to_string(list_sort(list_filter(a.codes, lambda c: NOT list_contains(b.codes, c))), '|') AS only_first
        FROM labels1 a JOIN labels2 b ON a.specialty = b.specialty AND a.query = b.query"""),
    "complete_triplets": with_views("trip", """
        SELECT doc_id, specialty, positives, negatives FROM trip
        WHERE anchor IS NOT NULL AND positives IS NOT NULL AND negatives IS NOT NULL"""),
    "distinct_triplets": with_views("trip", "SELECT DISTINCT anchor, positives, negatives FROM trip"),
    "prepared_training_split": with_views("trip", """
        SELECT DISTINCT anchor, positives, negatives FROM trip
        WHERE specialty IS NOT NULL AND anchor IS NOT NULL AND positives IS NOT NULL AND negatives IS NOT NULL"""),
    "prepared_evaluation_split": with_views("turns", """,
        sampled AS (
            SELECT * FROM turns QUALIFY row_number() OVER (
                PARTITION BY specialty ORDER BY md5(concat_ws('|', '412', anchor, positives, negatives)),
                anchor NULLS FIRST, positives NULLS FIRST, negatives NULLS FIRST) <= 10)
        SELECT DISTINCT 'Instruct: Given a medical query in the field of ' || specialty
               || ', retrieve the relevant ICD description' || chr(10) || 'Query: ' || anchor AS anchor, positives, negatives
        FROM sampled WHERE specialty IS NOT NULL AND anchor IS NOT NULL AND positives IS NOT NULL AND negatives IS NOT NULL"""),
    "prepared_test_split": with_views("page_trip", """
        SELECT DISTINCT anchor, positives, negatives FROM page_trip
        WHERE anchor IS NOT NULL AND positives IS NOT NULL AND negatives IS NOT NULL"""),
    "split_report": with_views("trip turns page_trip", """,
        every AS (
            SELECT 'train' AS split, anchor, positives, negatives FROM trip
            UNION ALL SELECT 'eval', anchor, positives, negatives FROM turns
            UNION ALL SELECT 'test', anchor, positives, negatives FROM page_trip),
        marked AS (SELECT *, anchor IS NULL OR positives IS NULL OR negatives IS NULL AS bad FROM every)
        SELECT split, count(*) AS rows, count_if(bad)::BIGINT AS removed_nulls,
               count(DISTINCT CASE WHEN NOT bad THEN (anchor, positives, negatives) END) AS final_rows
        FROM marked GROUP BY split"""),
    "length_batches": with_views("trip", f""",
        numbered AS (
            SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch,
                   {_words('anchor')} + {_words('positives')} + {_words('negatives')} AS length FROM trip)
        SELECT doc_id, batch, length, (row_number() OVER (PARTITION BY batch ORDER BY length, doc_id))::INTEGER AS place FROM numbered"""),
    "latency_stats": with_views("run_stats", "SELECT * FROM run_stats"),
    "latency_throughput": with_views("run_rates", "SELECT implementation, optimization, params, batch_size, throughput_qps FROM run_rates"),
    "best_by_implementation": with_views("run_rates", """
        SELECT implementation, min(mean_ms) AS best_mean_ms,
               first(batch_size ORDER BY mean_ms, batch_size, optimization, params) AS best_mean_batch, min(p95_ms) AS best_p95_ms,
               first(batch_size ORDER BY p95_ms, batch_size, optimization, params) AS best_p95_batch,
               max(throughput_qps) AS best_throughput_qps,
               first(batch_size ORDER BY throughput_qps DESC, batch_size, optimization, params) AS best_throughput_batch
        FROM run_rates GROUP BY implementation"""),
    "overall_recommendation": with_views("run_rates", """,
        ranked AS (
            SELECT *, row_number() OVER (ORDER BY mean_ms, batch_size, optimization, params) AS a,
                   row_number() OVER (ORDER BY p95_ms, batch_size, optimization, params) AS b,
                   row_number() OVER (ORDER BY throughput_qps DESC, batch_size, optimization, params) AS c FROM run_rates)
        SELECT goal, implementation, optimization, batch_size, mean_ms, p95_ms, throughput_qps FROM (
            SELECT 'lowest_mean' AS goal, * FROM ranked WHERE a = 1 UNION ALL
            SELECT 'lowest_p95', * FROM ranked WHERE b = 1 UNION ALL
            SELECT 'highest_throughput', * FROM ranked WHERE c = 1)"""),
    "optimization_comparison": with_views("run_stats", """
        SELECT batch_size, optimization, params, mean_ms, p95_ms FROM run_stats
        QUALIFY row_number() OVER (PARTITION BY batch_size, optimization ORDER BY params) = 1"""),
    "compare_runs": with_views("run_stats", f", {_COMPARED} SELECT * FROM compared"),
    "average_improvement": with_views("run_stats", f""", {_COMPARED}
        SELECT round(avg(mean_speedup), 6) AS avg_mean_improvement, round(avg(p95_speedup), 6) AS avg_p95_improvement FROM compared"""),
    "latency_histogram": with_views("runs", """,
        limits AS (SELECT implementation, optimization, params, batch_size, min(latency_ms) AS lo, max(latency_ms) AS hi FROM runs GROUP BY ALL),
        bins AS (SELECT limits.*, unnest(range(0, 30)) AS bin FROM limits),
        placed AS (
            SELECT l.implementation, l.optimization, l.params, l.batch_size,
                   CASE WHEN hi = lo THEN 15 ELSE least(floor((latency_ms - lo) / (hi - lo) * 30), 29) END::BIGINT AS bin
            FROM runs r JOIN limits l ON r.implementation = l.implementation AND r.optimization = l.optimization
                 AND r.params = l.params AND r.batch_size = l.batch_size),
        counted AS (SELECT implementation, optimization, params, batch_size, bin, count(*) AS n FROM placed GROUP BY ALL)
        SELECT b.implementation, b.optimization, b.params, b.batch_size, b.bin::INTEGER AS bin, coalesce(n, 0) AS n
        FROM bins b LEFT JOIN counted c ON b.implementation = c.implementation AND b.optimization = c.optimization
             AND b.params = c.params AND b.batch_size = c.batch_size AND b.bin = c.bin"""),
    "call_rate_audit": f"""
        WITH moments AS (SELECT user_id AS caller, epoch_us(ts) AS t, count(*) AS calls FROM events GROUP BY ALL),
        seen AS (
            SELECT caller, t, calls, sum(calls) OVER w AS total, min(t) OVER w AS oldest FROM moments
            WINDOW w AS (PARTITION BY caller ORDER BY t RANGE BETWEEN {6 * HOURS_US - 1} PRECEDING AND CURRENT ROW))
        SELECT caller, t AS ts, calls, total::BIGINT AS calls_in_period, total > 3 AS over_capacity,
               CASE WHEN total > 3 THEN oldest + {6 * HOURS_US} - t ELSE 0 END AS wait_us FROM seen""",
}

_INGESTED = """,
    done AS (SELECT DISTINCT specialty, query FROM replies),
    updated AS (
        SELECT i.* REPLACE (CASE WHEN d.query IS NOT NULL THEN 'completed' ELSE status END AS status)
        FROM items i LEFT JOIN done d ON i.specialty = d.specialty AND i.query = d.query)"""
SQL["label_ingest"] = stacked({
    "codes": SQL["valid_codes"],
    # Codes of a reply are the query's codes, so descriptions are those of its labels; bracketed replies have lost their ends.
    "descriptions": with_views("replies", f""", {_LAST_DESCRIPTION},
        listed AS (
            SELECT specialty, query, generate_subscripts(string_split(reply, ', '), 1) AS pos, unnest(string_split(reply, ', ')) AS code FROM replies)
        SELECT specialty, query, string_agg(description, '|' ORDER BY pos) AS descriptions
        FROM listed JOIN last_text USING (code) GROUP BY specialty, query"""),
    "open": with_views("items replies", _INGESTED + "SELECT * FROM updated WHERE status NOT IN ('completed', 'failed')"),
    "progress": with_views("items replies", _INGESTED + """
        SELECT specialty, count(*) AS total, count_if(status = 'pending')::BIGINT AS pending, 0::BIGINT AS processing,
               count_if(status = 'completed')::BIGINT AS completed, count_if(status = 'failed')::BIGINT AS failed,
               CASE WHEN count_if(status = 'pending') = 0 THEN 'completed' ELSE 'in_progress' END AS status
        FROM updated GROUP BY specialty"""),
})
SQL["latency_report"] = stacked({
    "stats": with_views("run_rates", "SELECT * FROM run_rates"),
    "best": SQL["best_by_implementation"],
    "recommendation": SQL["overall_recommendation"],
    "techniques": with_views("run_stats", """
        SELECT * FROM run_stats QUALIFY row_number() OVER (PARTITION BY batch_size, optimization ORDER BY params) = 1"""),
    "comparison": SQL["compare_runs"],
    "improvement": SQL["average_improvement"],
    "histogram": SQL["latency_histogram"],
})
