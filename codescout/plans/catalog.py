"""Views that read the given tables as the engine's inputs, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codescout.operators.running import row_numbers


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding as a query: (query, specialty, embedding)."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("query"), F.col("label").alias("specialty"), "embedding"
    )


def code_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding as a code: (code, ord, embedding)."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("code"), F.col("vec_id").alias("ord"), "embedding"
    )


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """Relevant codes of a query, as (query, code, pos): the others of its group of six vectors with one label.

    The vectors of a label are numbered by id and cut into groups of six, so every vector is a query and a positive of others (only
    a group of one that is left over has none).
    """
    rows = table(spark, folder, "embeddings").select("vec_id", "label")
    numbered = row_numbers(rows, [F.col("vec_id").asc()], "_p", ["label"])
    members = numbered.select("label", "vec_id", F.floor((F.col("_p") - 1) / 6).alias("_group"))
    others = members.withColumnRenamed("vec_id", "other")
    pairs = members.join(others, ["label", "_group"]).filter(F.col("vec_id") != F.col("other"))
    placed = pairs.withColumn("pos", F.row_number().over(Window.partitionBy("vec_id").orderBy("other")))
    return placed.select(F.col("vec_id").cast("string").alias("query"), F.col("other").cast("string").alias("code"), "pos")


def labelled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Queries with their positives, which may be none: (query, specialty, embedding, positives)."""
    lists = truth(spark, folder).groupBy("query").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda m: m["code"]).alias("positives")
    )
    none = F.array().cast("array<string>")
    return vectors(spark, folder).join(lists, "query", "left").withColumn("positives", F.coalesce("positives", none))


def codes(spark: SparkSession, folder: str) -> DataFrame:
    """A code reference with repeated codes: (ord, code, description)."""
    tail = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("."), F.col("p_size").cast("string")))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("ord"),
        F.concat(
            F.char(F.lit(65) + F.col("p_partkey") % 26),
            F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"),
            tail,
        ).alias("code"),
        F.concat_ws(" ", "p_name", "p_type").alias("description"),
    )


def label_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as single labels: (specialty, query, code or null, line)."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    reference = codes(spark, folder).select("ord", "code")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(reference, F.col("l_partkey") == F.col("ord"))
        .select(
            F.col("c_mktsegment").alias("specialty"),
            F.col("o_orderkey").cast("string").alias("query"),
            F.when(F.col("l_returnflag") == "R", F.col("code")).alias("code"),
            F.col("l_linenumber").alias("line"),
        )
    )


def label_set(spark: SparkSession, folder: str, lines=None) -> DataFrame:
    """Labels as sorted lists, possibly empty: (specialty, query, codes)."""
    rows = label_lines(spark, folder)
    if lines is not None:
        rows = rows.filter(lines)
    rows = rows.select("specialty", "query", "code").distinct()
    return rows.groupBy("specialty", "query").agg(F.array_sort(F.collect_list("code")).alias("codes"))


def label_sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping label sets, from the first and from the last lines of the orders."""
    return label_set(spark, folder, F.col("line") <= 4), label_set(spark, folder, F.col("line") >= 3)


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """Model replies with codes: comma lists, ``[]``, and some in brackets."""
    joined = F.array_join("codes", ", ")
    text = (
        F.when(F.size("codes") == 0, "[]")
        .when(F.col("query").cast("long") % 7 == 0, F.concat(F.lit("["), joined, F.lit("]")))
        .otherwise(F.concat(joined, F.lit(", X99.99")))
    )
    return label_set(spark, folder).select("specialty", "query", text.alias("reply"))


def two_sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Synthetic and paraphrased queries per nation: (specialty, query) each."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("specialty"),
        F.col("o_orderkey").cast("string").alias("query"),
        (F.col("o_orderkey") % 20 < F.col("c_nationkey") % 11).alias("_paraphrased"),
    )
    return (
        rows.filter(~F.col("_paraphrased")).drop("_paraphrased"),
        rows.filter("_paraphrased").drop("_paraphrased"),
    )


def work_items(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as work items: (specialty, query, status, attempts)."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "P", "failed")
        .otherwise("pending")
    )
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("specialty"),
        F.col("o_orderkey").cast("string").alias("query"),
        status.alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("attempts"),
    )


def latencies(spark: SparkSession, folder: str) -> DataFrame:
    """Events as benchmark runs: the event type is the technique."""
    k = F.get_json_object("props", "$.k").cast("int")
    sizes = F.array(*[F.lit(b) for b in (1, 4, 8, 16, 32, 64)])
    return table(spark, folder, "events").select(
        F.when(F.col("event_type") == "view", "baseline").otherwise("optimized").alias("implementation"),
        F.col("event_type").alias("optimization"),
        F.concat(F.lit("q"), (k % 2).cast("string")).alias("params"),
        F.get(sizes, k % 6).alias("batch_size"),
        F.col("value").alias("latency_ms"),
    )


def calls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").alias("caller"), "ts")


def triplets(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as text triplets; unlabelled documents have a null, copies repeat."""
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, folder, "labels")
    mark = F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(" toxic "), F.col("toxic").cast("string"))
    return documents.join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("source").alias("specialty"),
        F.col("text").alias("anchor"),
        F.col("lang").alias("positives"),
        mark.alias("negatives"),
    )


def line_triplets(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as short text triplets with many repeats; unreturned lines have a null."""
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_linestatus").alias("specialty"),
            F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("anchor"),
            F.concat_ws(" ", F.lit("sold by"), F.col("s_name")).alias("positives"),
            F.when(F.col("l_returnflag") != "N", F.concat_ws(" ", F.lit("flag"), F.col("l_returnflag"))).alias("negatives"),
        )
    )


def turn_triplets(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of conversations with the next turn as positive; the last one has a null."""
    turns = table(spark, folder, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("positives"))
    return turns.join(following, ["conv_id", "turn"], "left").select(
        F.col("role").alias("specialty"), F.col("text").alias("anchor"), "positives", F.col("role").alias("negatives")
    )


def page_triplets(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as triplets; a page without a query string has a null specialty."""
    return table(spark, folder, "pages").select(
        F.when(F.contains("url", F.lit("?")), F.split_part("url", F.lit("?"), F.lit(2))).alias("specialty"),
        F.col("url").alias("anchor"),
        F.col("html").alias("positives"),
        F.split_part("url", F.lit("?"), F.lit(1)).alias("negatives"),
    )


# The same views in SQL, to be put together by :func:`with_views`.
VIEWS = {
    "vec": "SELECT vec_id::VARCHAR AS query, label AS specialty, embedding::DOUBLE[] AS e FROM embeddings",
    "sim": "SELECT a.query, a.specialty, b.query AS code, b.specialty AS code_specialty, "
    "round(list_cosine_similarity(a.e, b.e), 6) AS s FROM vec a, vec b",
    "truth": """
        SELECT e.vec_id::VARCHAR AS query, f.vec_id::VARCHAR AS code,
               row_number() OVER (PARTITION BY e.vec_id ORDER BY f.vec_id) AS pos
        FROM sixes e JOIN sixes f USING (label, place) WHERE e.vec_id <> f.vec_id""",
    "sixes": "SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 6 AS place FROM embeddings",
    "codes": """
        SELECT p_partkey AS ord, p_name || ' ' || p_type AS description,
               chr((65 + p_partkey % 26)::INTEGER) || lpad((p_partkey % 100)::VARCHAR, 2, '0')
                 || CASE WHEN p_size % 3 = 0 THEN '' ELSE '.' || p_size::VARCHAR END AS code
        FROM part""",
    "lines": """
        SELECT c_mktsegment AS specialty, o_orderkey::VARCHAR AS query, l_linenumber AS line,
               CASE WHEN l_returnflag = 'R' THEN code END AS code
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN codes ON l_partkey = ord""",
    "labels_all": "SELECT specialty, query, list_sort(coalesce(list(DISTINCT code) FILTER (code IS NOT NULL), [])) AS codes "
    "FROM lines GROUP BY ALL",
    "labels1": "SELECT specialty, query, list_sort(coalesce(list(DISTINCT code) FILTER (code IS NOT NULL), [])) AS codes "
    "FROM lines WHERE line <= 4 GROUP BY ALL",
    "labels2": "SELECT specialty, query, list_sort(coalesce(list(DISTINCT code) FILTER (code IS NOT NULL), [])) AS codes "
    "FROM lines WHERE line >= 3 GROUP BY ALL",
    "replies": """
        SELECT specialty, query,
               CASE WHEN len(codes) = 0 THEN '[]'
                    WHEN query::BIGINT % 7 = 0 THEN '[' || array_to_string(codes, ', ') || ']'
                    ELSE array_to_string(codes, ', ') || ', X99.99' END AS reply
        FROM labels_all""",
    "sources": """
        SELECT c_nationkey AS specialty, o_orderkey::VARCHAR AS query,
               o_orderkey % 20 < c_nationkey % 11 AS paraphrased
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "stats": """
        SELECT specialty, count_if(paraphrased) AS p, count_if(NOT paraphrased) AS s, count(*) AS t
        FROM sources GROUP BY specialty HAVING count_if(NOT paraphrased) > 0""",
    "items": """
        SELECT c_mktsegment AS specialty, o_orderkey::VARCHAR AS query,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status,
               substr(o_orderpriority, 1, 1)::INTEGER AS attempts
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "runs": """
        SELECT CASE WHEN event_type = 'view' THEN 'baseline' ELSE 'optimized' END AS implementation,
               event_type AS optimization, 'q' || (k % 2)::VARCHAR AS params,
               [1, 4, 8, 16, 32, 64][k % 6 + 1] AS batch_size, value AS latency_ms
        FROM (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events)""",
    "run_stats": """
        SELECT implementation, optimization, params, batch_size,
               round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 6) AS median_ms,
               round(stddev_pop(latency_ms), 6) AS std_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms,
               round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.9), 6) AS p90_ms,
               round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms,
               count(*) AS num_runs
        FROM runs GROUP BY ALL""",
    "run_rates": "SELECT *, round(batch_size * 1000.0::DOUBLE / mean_ms, 6) AS throughput_qps FROM run_stats",
    "trip": """
        SELECT d.doc_id, source AS specialty, text AS anchor, lang AS positives,
               'quality ' || quality::VARCHAR || ' toxic ' || toxic::VARCHAR AS negatives
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "line_trip": """
        SELECT l_linestatus AS specialty, p_name || ' ' || p_type || ' ' || p_brand AS anchor, 'sold by ' || s_name AS positives,
               CASE WHEN l_returnflag <> 'N' THEN 'flag ' || l_returnflag END AS negatives
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "turns": """
        SELECT a.role AS specialty, a.text AS anchor, b.text AS positives, a.role AS negatives
        FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "page_trip": """
        SELECT CASE WHEN contains(url, '?') THEN split_part(url, '?', 2) END AS specialty, url AS anchor,
               html AS positives, split_part(url, '?', 1) AS negatives
        FROM pages""",
}

_NEEDS = {
    "sim": ["vec"],
    "truth": ["sixes"],
    "lines": ["codes"],
    "labels_all": ["lines"],
    "labels1": ["lines"],
    "labels2": ["lines"],
    "replies": ["labels_all"],
    "stats": ["sources"],
    "run_stats": ["runs"],
    "run_rates": ["run_stats"],
}


def with_views(names: str, body: str) -> str:
    """``body`` behind a WITH clause of the named views and all that they need.

    A body that starts with ``,`` adds further common tables of its own.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered) + "\n" + body


def stacked(parts: dict[str, str]) -> str:
    """The SQL of :func:`codescout.plans.jobs.one_table`: queries below each other, named in ``part``, missing columns null."""
    return " UNION ALL BY NAME ".join(f"SELECT '{name}' AS part, * FROM ({query})" for name, query in parts.items())
