"""Queries that write the given tables in an input format and read them back, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescout.operators import sampling
from codescout.plans import catalog, relational
from codescout.plans.catalog import with_views
from codescout.session import scratch_path
from codescout.sources import files
from codescout.streaming import jobs as streams

DOCUMENT_ROWS = 100


def _specialty_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of up to a hundred queries of one source each, in order."""
    rows = catalog.table(spark, folder, "documents").select(
        F.col("source").alias("specialty"), "text", F.floor(F.col("doc_id") / DOCUMENT_ROWS).alias("part")
    )
    return rows.groupBy("part", "specialty").agg(F.collect_list("text").alias("queries"))


def read_specialty_queries(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "specialties")
    documents = _specialty_documents(spark, folder).orderBy("part", "specialty")
    documents.select(F.to_json(F.create_map("specialty", "queries")).alias("value")).write.text(path)
    return files.read_specialty_queries(spark, path)


def read_query_map(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "query-map")
    maps = _specialty_documents(spark, folder).groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("specialty", "queries"))).alias("m")
    )
    maps.select(F.to_json("m").alias("value")).write.text(path)
    return files.read_query_map(spark, path)


def read_code_reference(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "codes")
    filler = [F.lit(i).alias(f"c{i}") for i in range(13)]
    rows = catalog.codes(spark, folder).orderBy("ord").select("ord", *filler, "code", "description")
    rows.write.csv(path, header=True, quote='"', escape='"')
    return files.read_code_reference(spark, path)


def _triplet_csv(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark, "triplets")
    catalog.triplets(spark, folder).write.csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return path


def read_triplets(spark: SparkSession, folder: str) -> DataFrame:
    return files.read_triplets(spark, _triplet_csv(spark, folder))


def read_triplet_columns(spark: SparkSession, folder: str) -> DataFrame:
    return files.read_triplets(spark, _triplet_csv(spark, folder), ["specialty", "negatives"])


def read_triplets_limited(spark: SparkSession, folder: str) -> DataFrame:
    rows = files.read_triplets_limited(spark, _triplet_csv(spark, folder), 5000)
    complete = F.col("anchor").isNotNull() & F.col("positives").isNotNull() & F.col("negatives").isNotNull()
    columns = ["anchor", "positives", "negatives"]
    known = read_triplets(spark, folder).select(columns).distinct().withColumn("_known", F.lit(True))
    return rows.join(known, columns, "left").agg(
        F.count("*").alias("rows"),
        F.count_if(~complete).alias("incomplete"),
        F.count_distinct(*columns).alias("different"),
        F.count_if(F.col("_known")).alias("known"),
    )


def read_keywords(spark: SparkSession, folder: str) -> DataFrame:
    csv_path, json_path = scratch_path(spark, "keywords-csv"), scratch_path(spark, "keywords-json")
    parts = catalog.table(spark, folder, "part")
    parts.select(F.col("p_name").alias("Keywords")).write.csv(csv_path, header=True)
    lists = parts.select(F.to_json(F.array("p_type", F.concat_ws(" ", "p_brand", "p_name", "p_type"))).alias("value"))
    lists.write.text(json_path)
    return files.read_keywords(spark, csv_path, json_path)


def merge_specialty_maps(spark: SparkSession, folder: str) -> DataFrame:
    paths = []
    for labels in catalog.label_sets(spark, folder):
        paths.append(scratch_path(spark, "labels"))
        document = F.create_map("specialty", F.create_map("query", "codes"))
        labels.select(F.to_json(document).alias("value")).write.text(paths[-1])
    merged = files.merge_specialty_maps(spark, paths)
    return merged.select("specialty", "query", F.array_join("codes", "|").alias("codes"))


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    catalog.table(spark, folder, "documents").select("text").write.text(path)
    return files.read_lines(spark, path)


def saved_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "embeddings")
    files.save_embeddings(catalog.vectors(spark, folder), path, key="query")
    loaded = files.load_embeddings(spark, path)
    return loaded.select("key", F.posexplode("embedding").alias("pos", "x")).select(
        "key", "pos", F.round(F.col("x").cast("double"), 6).alias("x")
    )


def combined_results(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "results")
    files.write_per_specialty(catalog.label_set(spark, folder), path)
    results = files.combine_results(spark, path)
    return results.select("specialty", "query", F.array_join("codes", "|").alias("codes"))


def sampling_outputs(spark: SparkSession, folder: str) -> DataFrame:
    plan_path, samples_path = scratch_path(spark, "plan"), scratch_path(spark, "samples")
    synthetic, paraphrased = catalog.two_sources(spark, folder)
    plan = relational.sampling_plan(spark, folder)
    samples = sampling.draw_samples(plan, synthetic, paraphrased, 250, relational.SEED)
    files.write_sampling_outputs(plan, samples, plan_path, samples_path)
    planned = spark.read.schema(plan.schema).csv(plan_path, header=True)
    drawn = spark.read.schema(samples.schema).json(samples_path)
    counts = drawn.groupBy("specialty").agg(F.count("*").alias("drawn"))
    return planned.join(counts, "specialty").select("specialty", "total_sampled", "drawn", "sampling_strategy")


def json_safe(spark: SparkSession, folder: str) -> DataFrame:
    orders = catalog.table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"),
        F.struct(F.array(F.col("o_orderdate").cast("date")).alias("days"), F.col("o_totalprice")).alias("detail"),
    )
    safe = files.json_safe(orders)
    return safe.select("o_orderkey", "o_orderdate", F.get("detail.days", F.lit(0)).alias("day"), F.col("detail.o_totalprice").alias("price"))


def json_unsafe_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of ``orders`` and ``events`` that JSON has no type for, with the number of rows that have a value there."""
    tables = {name: catalog.table(spark, folder, name) for name in ("orders", "events")}
    parts = []
    for name, df in tables.items():
        listed = files.json_unsafe_columns(df)
        filled = [F.struct(F.lit(c).alias("column"), F.count(F.col(c)).alias("filled")) for c in df.columns]
        counts = df.agg(F.array(*filled).alias("_c")).select(F.inline("_c"))
        parts.append(listed.join(counts, "column").withColumn("source", F.lit(name)))
    return parts[0].unionByName(parts[1])


def incremental_labelling_intake(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs: conversations arrive first, then the documents and the conversations again."""
    source, queue, checkpoint = (scratch_path(spark, name) for name in ("intake", "queue", "intake-state"))
    conversations = catalog.table(spark, folder, "conversations").select(F.col("role").alias("specialty"), F.col("text").alias("query"))
    documents = catalog.table(spark, folder, "documents").select(F.col("source").alias("specialty"), F.col("text").alias("query"))
    for arrivals in (conversations, documents.unionByName(conversations)):
        arrivals.write.mode("append").json(source)
        streams.incremental_labelling_intake(spark, source, queue, checkpoint).awaitTermination()
    return streams.read_queue(spark, queue)


def streaming_progress(spark: SparkSession, folder: str) -> DataFrame:
    target, checkpoint = scratch_path(spark, "progress"), scratch_path(spark, "progress-state")
    orders = catalog.table(spark, folder, "orders")
    arrivals = spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet").parquet(folder)
    items = arrivals.select(
        F.col("o_orderpriority").alias("specialty"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "P", "failed")
        .otherwise("pending")
        .alias("status"),
    )
    streams.streaming_progress(items, target, checkpoint).awaitTermination()
    return spark.read.parquet(target)


def streaming_call_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs: all calls arrive first, then those of the first days once more, which is too late to count."""
    source, target, checkpoint = (scratch_path(spark, name) for name in ("calls", "rates", "rates-state"))
    calls = catalog.calls(spark, folder).select("caller", F.col("ts").cast("timestamp").alias("ts"))
    last = calls.agg(F.max("ts").alias("_last"))
    late = calls.join(F.broadcast(last), F.col("ts") < F.col("_last") - F.expr("INTERVAL 1 DAY")).select("caller", "ts")
    for arrivals in (calls, late):
        arrivals.write.mode("append").parquet(source)
        stream = spark.readStream.schema(calls.schema).parquet(source)
        rates = streams.streaming_call_rate(stream, "6 hours", "1 hour", "1 hour")
        streams.write_call_rates(rates, target, checkpoint).awaitTermination()
    return spark.read.schema(rates.schema).parquet(target).select(
        "caller", F.unix_micros("window_start").alias("window_start"), F.unix_micros("window_end").alias("window_end"), "calls"
    )


QUERIES = {
    f.__name__: f
    for f in (
        read_specialty_queries, read_query_map, read_code_reference, read_triplets, read_triplet_columns,
        read_triplets_limited, read_keywords, merge_specialty_maps, read_lines, saved_embeddings, combined_results,
        sampling_outputs, json_safe, json_unsafe_columns, incremental_labelling_intake, streaming_progress, streaming_call_rate,
    )
}

_HOUR = relational.HOURS_US

SQL = {
    "read_specialty_queries": f"""
        SELECT source AS specialty, text AS query FROM documents
        QUALIFY doc_id // {DOCUMENT_ROWS} = max(doc_id // {DOCUMENT_ROWS}) OVER (PARTITION BY source)""",
    "read_query_map": "SELECT source AS specialty, text AS query FROM documents",
    "read_code_reference": with_views("codes", """,
        pairs AS (SELECT code, description, min(ord) AS ord FROM codes GROUP BY code, description)
        SELECT code, arg_max(description, ord) AS description FROM pairs GROUP BY code"""),
    "read_triplets": with_views("trip", "SELECT specialty, anchor, positives, negatives FROM trip"),
    "read_triplet_columns": with_views("trip", "SELECT specialty, negatives FROM trip"),
    "read_triplets_limited": with_views("trip", """
        SELECT least(count(*), 5000) AS rows, 0::BIGINT AS incomplete, least(count(*), 5000) AS different,
               least(count(*), 5000) AS known FROM (
            SELECT DISTINCT anchor, positives, negatives FROM trip
            WHERE anchor IS NOT NULL AND positives IS NOT NULL AND negatives IS NOT NULL)"""),
    "read_keywords": f"""
        WITH k AS (
            SELECT p_name AS final_keywords FROM part UNION ALL SELECT p_type FROM part
            UNION ALL SELECT p_brand || ' ' || p_name || ' ' || p_type FROM part)
        SELECT final_keywords, {relational._words('final_keywords')} AS sequence_length FROM k""",
    "merge_specialty_maps": with_views("labels1 labels2", """
        SELECT specialty, query, array_to_string(codes, '|') AS codes FROM labels2
        UNION ALL
        SELECT a.specialty, a.query, array_to_string(a.codes, '|') FROM labels1 a
        ANTI JOIN labels2 b ON a.specialty = b.specialty AND a.query = b.query"""),
    "read_lines": f"""
        SELECT query FROM (SELECT {relational._strip('line')} AS query
                           FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE query <> ''""",
    "saved_embeddings": """
        SELECT vec_id::VARCHAR AS key, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos,
               round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings""",
    "combined_results": with_views("labels_all", "SELECT specialty, query, array_to_string(codes, '|') AS codes FROM labels_all"),
    "sampling_outputs": with_views("stats", ", " + relational._plan_sql(250) + """
        SELECT specialty, total_sampled, total_sampled AS drawn, sampling_strategy FROM full_plan"""),
    "json_safe": """
        SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
               strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice AS price FROM orders""",
    "json_unsafe_columns": """
        SELECT 'o_orderdate' AS "column", 'timestamp_ntz' AS type, count(o_orderdate) AS filled, 'orders' AS source FROM orders
        UNION ALL SELECT 'ts', 'timestamp_ntz', count(ts), 'events' FROM events""",
    "incremental_labelling_intake": """
        SELECT DISTINCT specialty, query, 'pending' AS status, 0::INTEGER AS attempts FROM (
            SELECT role AS specialty, text AS query FROM conversations
            UNION ALL SELECT source, text FROM documents)""",
    "streaming_progress": """
        SELECT o_orderpriority AS specialty, count(*) AS total, count_if(o_orderstatus = 'O')::BIGINT AS pending,
               0::BIGINT AS processing, count_if(o_orderstatus = 'F')::BIGINT AS completed,
               count_if(o_orderstatus = 'P')::BIGINT AS failed,
               CASE WHEN count_if(o_orderstatus = 'O') = 0 THEN 'completed' ELSE 'in_progress' END AS status
        FROM orders GROUP BY o_orderpriority""",
    "streaming_call_rate": f"""
        WITH w AS (
            SELECT user_id AS caller, (epoch_us(ts) // {_HOUR} - unnest(range(0, 6))) * {_HOUR} AS window_start FROM events)
        SELECT caller, window_start, window_start + {6 * _HOUR} AS window_end, count(*) AS calls FROM w
        WHERE window_start + {6 * _HOUR} <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - {_HOUR} FROM events) GROUP BY ALL""",
}
