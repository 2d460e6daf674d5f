"""Queries over vectors: matches, diversity, negatives, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescout.functions.draws import MODULUS, MULTIPLIER
from codescout.functions.vectors import cosine, l2_normalize
from codescout.operators import diversity, evaluation, mining, retrieval
from codescout.operators.embed import embed_texts, hashing_encoder
from codescout.plans import catalog
from codescout.plans.catalog import with_views
from codescout.plans.selection import selection_sql
from codescout.session import materialise

THRESHOLD = 0.25
NEGATIVES = 10
SEED = 42


def _matches(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    return retrieval.top_k_codes(
        catalog.vectors(spark, folder),
        catalog.code_vectors(spark, folder),
        k,
        query_keys=("specialty", "query"),
    )


def top_k_codes(spark: SparkSession, folder: str) -> DataFrame:
    matches = retrieval.top_k_codes(catalog.vectors(spark, folder), catalog.code_vectors(spark, folder))
    described = catalog.code_vectors(spark, folder).select("code", F.concat(F.lit("vector "), "code").alias("description"))
    return retrieval.with_descriptions(matches, described)


def top_k_by_specialty(spark: SparkSession, folder: str) -> DataFrame:
    return _matches(spark, folder)


def batch_search(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieval.top_k_codes(catalog.vectors(spark, folder), catalog.code_vectors(spark, folder), 3)
    return found.select("query", "code", F.col("similarity").alias("score"))


def codes_per_query(spark: SparkSession, folder: str) -> DataFrame:
    lists = retrieval.codes_per_query(_matches(spark, folder))
    return lists.select("query", F.array_join("codes", ",").alias("codes"))


def limited_view(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.limited_view(materialise(_matches(spark, folder, 5)))


def l2_normalized(spark: SparkSession, folder: str) -> DataFrame:
    unit = catalog.vectors(spark, folder).select("query", F.posexplode(l2_normalize(F.col("embedding"))).alias("pos", "x"))
    return unit.select("query", "pos", F.round("x", 6).alias("x"))


def pair_cosine(spark: SparkSession, folder: str) -> DataFrame:
    a = catalog.vectors(spark, folder).select("query", F.col("embedding").alias("a"))
    b = catalog.code_vectors(spark, folder).select("code", F.col("embedding").alias("b"))
    pairs = catalog.truth(spark, folder).join(a, "query").join(b, "code")
    return pairs.select("query", "code", F.round(cosine("a", "b"), 6).alias("similarity"))


def redundancy_profile(spark: SparkSession, folder: str) -> DataFrame:
    return diversity.redundancy_profile(catalog.vectors(spark, folder), THRESHOLD)


def diverse_greedy(spark: SparkSession, folder: str) -> DataFrame:
    return diversity.diverse_greedy(catalog.vectors(spark, folder), THRESHOLD)


def diverse_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return diversity.diverse_cluster(catalog.vectors(spark, folder))


def diversity_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return diversity.run_comparison(catalog.vectors(spark, folder), THRESHOLD)


def average_pairwise_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return diversity.average_pairwise_similarity(catalog.vectors(spark, folder), ["specialty"])


def _known_positives(spark: SparkSession, folder: str) -> DataFrame:
    """The queries that are a positive of another one, as a selection."""
    picked = catalog.truth(spark, folder).select(F.col("code").alias("query")).distinct()
    return catalog.vectors(spark, folder).join(picked, "query", "left_semi")


def embedding_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return diversity.embedding_coverage(_known_positives(spark, folder), catalog.vectors(spark, folder))


def silhouette(spark: SparkSession, folder: str) -> DataFrame:
    first, second = F.get("embedding", F.lit(0)), F.get("embedding", F.lit(1))
    cluster = (first > 0).cast("int") * 2 + (second > 0).cast("int")
    return diversity.silhouette(catalog.vectors(spark, folder).withColumn("cluster", cluster))


def _evaluation(spark: SparkSession, folder: str) -> DataFrame:
    mapping = catalog.truth(spark, folder).select("query", "code")
    vectors = catalog.vectors(spark, folder)
    return diversity.evaluate_methods(vectors, diversity.run_comparison(vectors, THRESHOLD), mapping)


def evaluate_methods(spark: SparkSession, folder: str) -> DataFrame:
    return _evaluation(spark, folder)


def method_summary(spark: SparkSession, folder: str) -> DataFrame:
    return diversity.method_summary(_evaluation(spark, folder))


def diversity_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """All tables of the job."""
    from codescout.plans.jobs import diversity_evaluation as job
    from codescout.plans.jobs import one_table

    mapping = catalog.truth(spark, folder).select("query", "code")
    return one_table(job(catalog.vectors(spark, folder), mapping, THRESHOLD))


def method_wins(spark: SparkSession, folder: str) -> DataFrame:
    return diversity.method_wins(diversity.method_summary(_evaluation(spark, folder)))


def similarity_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return mining.similarity_percentiles(catalog.labelled_vectors(spark, folder), catalog.code_vectors(spark, folder))


def negative_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return mining.negative_candidates(catalog.labelled_vectors(spark, folder), catalog.code_vectors(spark, folder))


def negatives_topk(spark: SparkSession, folder: str) -> DataFrame:
    return mining.mine_negatives_topk(
        catalog.labelled_vectors(spark, folder), catalog.code_vectors(spark, folder), NEGATIVES, seed=SEED
    )


def negatives_band(spark: SparkSession, folder: str) -> DataFrame:
    return mining.mine_negatives_band(
        catalog.labelled_vectors(spark, folder), catalog.code_vectors(spark, folder), NEGATIVES, seed=SEED
    )


def _triplets(spark: SparkSession, folder: str) -> DataFrame:
    return mining.build_triplets(
        catalog.labelled_vectors(spark, folder), catalog.code_vectors(spark, folder), 3, NEGATIVES, SEED
    )


def triplet_lists(spark: SparkSession, folder: str) -> DataFrame:
    return _triplets(spark, folder).select(
        "specialty",
        "anchor",
        F.array_join("positives", ",").alias("positives"),
        F.array_join("negatives", ",").alias("negatives"),
    )


def triplet_rows(spark: SparkSession, folder: str) -> DataFrame:
    return mining.explode_triplets(_triplets(spark, folder))


def training_set(spark: SparkSession, folder: str) -> DataFrame:
    """The clean triplets of the whole job."""
    from codescout.plans.jobs import training_set as job

    queries, codes = catalog.labelled_vectors(spark, folder), catalog.code_vectors(spark, folder)
    return job(queries, codes, 3, NEGATIVES, SEED)[0]


def trimmed_positives(spark: SparkSession, folder: str) -> DataFrame:
    trimmed = mining.trim_positives(
        catalog.label_set(spark, folder).select("specialty", "query", F.col("codes").alias("positives")), 2
    )
    return trimmed.select("specialty", "query", F.array_join("positives", ",").alias("positives"))


def triplet_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    # Whole vectors as text, in millionths, so that both engines write them alike; each is written once and not in every triplet.
    whole = F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string")), ",")
    vectors = materialise(catalog.vectors(spark, folder).select(F.col("query").alias("key"), whole.alias("embedding")))
    attached = mining.triplet_embeddings(triplet_rows(spark, folder), vectors)
    written = [F.col(f"{role}_embedding").alias(role + "_x") for role in ("anchor", "positives", "negatives")]
    return attached.select("specialty", "anchor", "positives", "negatives", *written)


def triplet_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    vectors = catalog.vectors(spark, folder).select(F.col("query").alias("key"), "embedding")
    return mining.triplet_accuracy(materialise(triplet_rows(spark, folder)), vectors)


def optimal_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.optimal_threshold(
        catalog.vectors(spark, folder), catalog.code_vectors(spark, folder), catalog.truth(spark, folder)
    )


def cv_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.cv_threshold(
        catalog.vectors(spark, folder), catalog.code_vectors(spark, folder), catalog.truth(spark, folder), 5, SEED
    )


def mean_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.mean_threshold(cv_threshold(spark, folder))


def code_embeddings_from_text(spark: SparkSession, folder: str) -> DataFrame:
    texts = catalog.table(spark, folder, "documents").select("doc_id", "text")
    embedded = embed_texts(texts, "text", hashing_encoder(64))
    parts = embedded.select("doc_id", F.posexplode("embedding").alias("pos", "x")).filter("x <> 0")
    return parts.select("doc_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


def query_to_code_mapping(spark: SparkSession, folder: str) -> DataFrame:
    from codescout.plans.jobs import query_to_code_mapping as job

    queries = catalog.table(spark, folder, "conversations").select(F.col("role").alias("specialty"), F.col("text").alias("query"))
    reference = catalog.table(spark, folder, "benchmark").select(
        F.col("item_id").cast("string").alias("code"), F.col("text").alias("description")
    )
    return job(queries, reference, hashing_encoder(64), 3).select("query", F.array_join("codes", ",").alias("codes"))


def retrieval_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    from codescout.plans.jobs import retrieval_evaluation as job

    return job(catalog.vectors(spark, folder), catalog.code_vectors(spark, folder), catalog.truth(spark, folder), 20)


QUERIES = {
    f.__name__: f
    for f in (
        top_k_codes, top_k_by_specialty, batch_search, codes_per_query, limited_view, l2_normalized, pair_cosine,
        redundancy_profile, diverse_greedy, diverse_cluster, diversity_comparison, average_pairwise_similarity,
        embedding_coverage, silhouette, evaluate_methods, method_summary, method_wins, diversity_evaluation, similarity_percentiles, negative_candidates,
        negatives_topk, negatives_band, triplet_lists, triplet_rows, training_set, trimmed_positives, triplet_embeddings,
        triplet_accuracy, optimal_threshold, cv_threshold, mean_threshold, code_embeddings_from_text, query_to_code_mapping,
        retrieval_evaluation,
    )
}

_RANKED = """, ranked AS (
    SELECT query, specialty, code, s, row_number() OVER (PARTITION BY query ORDER BY s DESC, code) AS rank FROM sim)"""

_DRAWS = f"""
    draws AS (SELECT query, ('0x' || substr(md5('{SEED}|' || query), 1, 15))::BIGINT AS h FROM vec),
    candidates AS (
        SELECT m.query, m.specialty, m.code, m.s,
               (xor(a.h, b.h) % {MODULUS}) * {MULTIPLIER} % {MODULUS} AS draw
        FROM sim m ANTI JOIN truth t ON m.query = t.query AND m.code = t.code
        JOIN draws a ON m.query = a.query JOIN draws b ON m.code = b.query)"""

# Trimming to three positives comes before the negatives, so only those are barred.
_DRAWS_TRIMMED = _DRAWS.replace("AND m.code = t.code", "AND m.code = t.code AND t.pos <= 3")

_PICKS = f"""
    placed AS (
        SELECT query, code, s, draw, CASE WHEN hard THEN 'hard' ELSE 'easy' END AS kind,
               row_number() OVER (PARTITION BY query, hard ORDER BY draw, code) AS place
        FROM split),
    hard_picks AS (SELECT * FROM placed WHERE kind = 'hard' AND place <= {NEGATIVES // 2}),
    quota AS (
        SELECT v.query, {NEGATIVES} - count(h.query) AS easy
        FROM vec v LEFT JOIN hard_picks h ON v.query = h.query GROUP BY v.query),
    picks AS (
        SELECT query, code, kind, s FROM hard_picks
        UNION ALL
        SELECT p.query, p.code, p.kind, p.s FROM placed p JOIN quota q ON p.query = q.query
        WHERE p.kind = 'easy' AND p.place <= q.easy)"""

_TOPK_PICKS = f""",
    near AS (
        SELECT * FROM candidates
        QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, code) <= {10 * NEGATIVES}),
    cuts AS (SELECT query, round(quantile_cont(s, 0.7), 9) AS cut FROM near GROUP BY query),
    split AS (SELECT n.*, n.s >= c.cut AS hard FROM near n JOIN cuts c USING (query)),""" + _PICKS

_LISTS = """,
    negs AS (SELECT query, string_agg(code, ',' ORDER BY code) AS negatives FROM picks GROUP BY query),
    poss AS (SELECT query, string_agg(code, ',' ORDER BY pos) AS positives FROM truth WHERE pos <= 3 GROUP BY query)"""

_F1 = """,
    totals AS (SELECT fold, sum(hits) AS relevant FROM counts GROUP BY fold),
    summed AS (
        SELECT fold, s, sum(n) OVER w AS retrieved, sum(hits) OVER w AS found
        FROM counts WINDOW w AS (PARTITION BY fold ORDER BY s DESC)),
    scored AS (
        SELECT fold, s, round(2.0::DOUBLE * found / (retrieved + relevant), 9) AS f1
        FROM summed JOIN totals USING (fold)),
    best AS (
        SELECT fold, s AS threshold, round(f1, 6) AS f1 FROM scored
        QUALIFY row_number() OVER (PARTITION BY fold ORDER BY scored.f1 DESC, s) = 1)"""

_TRIPLETS = _LISTS + """
    SELECT v.specialty, v.query AS anchor, positives, negatives
    FROM vec v JOIN poss USING (query) JOIN negs USING (query)"""

_TRIPLET_ROWS = """, rows AS (
    SELECT v.specialty, v.query AS anchor, t.code AS positives, p.code AS negatives
    FROM vec v JOIN truth t ON v.query = t.query AND t.pos <= 3 JOIN picks p ON v.query = p.query)"""

SQL = {
    "top_k_codes": with_views("sim", _RANKED + """
        SELECT query, code, s AS similarity, rank::INTEGER AS rank, 'vector ' || code AS description
        FROM ranked WHERE rank <= 10"""),
    "top_k_by_specialty": with_views("sim", _RANKED + """
        SELECT specialty, query, code, s AS similarity, rank::INTEGER AS rank FROM ranked WHERE rank <= 10"""),
    "batch_search": with_views("sim", _RANKED + "SELECT query, code, s AS score FROM ranked WHERE rank <= 3"),
    "codes_per_query": with_views("sim", _RANKED + """
        SELECT query, string_agg(code, ',' ORDER BY rank) AS codes FROM ranked WHERE rank <= 10 GROUP BY query"""),
    "limited_view": with_views("sim", _RANKED + """,
        shown AS (SELECT specialty, query FROM vec QUALIFY row_number() OVER (PARTITION BY specialty ORDER BY query) <= 5),
        sizes AS (SELECT specialty, count(*) AS n FROM vec GROUP BY specialty)
        SELECT r.specialty, r.query, r.code, r.s AS similarity, r.rank::INTEGER AS rank, greatest(n - 5, 0) AS remaining
        FROM ranked r JOIN shown ON r.query = shown.query JOIN sizes ON r.specialty = sizes.specialty
        WHERE r.rank <= 3"""),
    "l2_normalized": """
        SELECT query, (i - 1)::INTEGER AS pos, round(e[i] / n, 6) AS x
        FROM (SELECT vec_id::VARCHAR AS query, embedding::DOUBLE[] AS e,
                     sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n,
                     unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    "pair_cosine": with_views("vec truth", """
        SELECT t.query, t.code, round(list_cosine_similarity(a.e, b.e), 6) AS similarity
        FROM truth t JOIN vec a ON t.query = a.query JOIN vec b ON t.code = b.query"""),
    "redundancy_profile": with_views("sim", f"""
        SELECT specialty, query,
               round(sum(round(s * 1000000)::BIGINT)::DOUBLE / count(*) / 1000000, 12) AS mean_similarity,
               count_if(s > {THRESHOLD} AND code <> query) AS similar_queries,
               max(s) FILTER (code <> query) AS nearest_similarity
        FROM sim WHERE specialty = code_specialty GROUP BY specialty, query"""),
    "average_pairwise_similarity": with_views("vec", """
        SELECT a.specialty, count(DISTINCT a.query) AS num_queries,
               round(sum(CASE WHEN a.query <> b.query THEN list_cosine_similarity(a.e, b.e) ELSE 0 END)
                     / (count(DISTINCT a.query) * (count(DISTINCT a.query) - 1)), 6) AS avg_similarity
        FROM vec a JOIN vec b ON a.specialty = b.specialty GROUP BY a.specialty"""),
    "embedding_coverage": with_views("sim truth", """,
        best AS (
            SELECT specialty, query, max(s) AS best FROM sim
            WHERE specialty = code_specialty AND code IN (SELECT code FROM truth) GROUP BY specialty, query)
        SELECT specialty, round(sum(round(best * 1000000)::BIGINT)::DOUBLE / count(*) / 1000000, 12) AS coverage
        FROM best GROUP BY specialty"""),
    "silhouette": with_views("vec", """,
        points AS (SELECT *, (e[1] > 0)::INTEGER * 2 + (e[2] > 0)::INTEGER AS cluster FROM vec),
        sums AS (
            SELECT a.specialty, a.query, a.cluster AS own, b.cluster AS other,
                   sum(CASE WHEN a.query = b.query THEN 0 ELSE list_distance(a.e, b.e) END) AS total, count(*) AS n
            FROM points a JOIN points b ON a.specialty = b.specialty GROUP BY ALL),
        parts AS (
            SELECT specialty, query, max(n) FILTER (own = other) AS members,
                   max(total / nullif(n - 1, 0)) FILTER (own = other) AS a, min(total / n) FILTER (own <> other) AS b
            FROM sums GROUP BY ALL)
        SELECT specialty, count(*) AS num_queries,
               round(CASE WHEN count(*) < 4 THEN 0 ELSE avg(CASE WHEN members > 1 AND b IS NOT NULL
                     THEN (b - a) / greatest(a, b) ELSE 0 END) END, 6) AS silhouette
        FROM parts GROUP BY specialty"""),
    "similarity_percentiles": with_views("sim truth", """
        SELECT m.query, count(*) AS candidates, round(quantile_cont(s, 0.7), 9) AS p70, round(quantile_cont(s, 0.9), 9) AS p90
        FROM sim m ANTI JOIN truth t ON m.query = t.query AND m.code = t.code GROUP BY m.query"""),
    "negative_candidates": with_views("truth", """
        SELECT e.vec_id::VARCHAR AS query, (SELECT count(*) FROM embeddings) - count(t.code) AS candidates
        FROM embeddings e LEFT JOIN truth t ON e.vec_id::VARCHAR = t.query GROUP BY e.vec_id"""),
    "negatives_topk": with_views("sim truth", "," + _DRAWS + _TOPK_PICKS + "SELECT query, code, kind, s AS similarity FROM picks"),
    "negatives_band": with_views("sim truth", "," + _DRAWS + """,
        cuts AS (SELECT query, round(quantile_cont(s, 0.7), 9) AS low, round(quantile_cont(s, 0.9), 9) AS high
                 FROM candidates GROUP BY query),
        split AS (SELECT n.*, n.s >= c.low AS hard FROM candidates n JOIN cuts c USING (query) WHERE n.s < c.high),"""
        + _PICKS + "SELECT query, code, kind, s AS similarity FROM picks"),
    "triplet_lists": with_views("sim truth", "," + _DRAWS_TRIMMED + _TOPK_PICKS + _TRIPLETS),
    "triplet_rows": with_views("sim truth", "," + _DRAWS_TRIMMED + _TOPK_PICKS + _TRIPLET_ROWS + "SELECT * FROM rows"),
    "training_set": with_views("sim truth", "," + _DRAWS_TRIMMED + _TOPK_PICKS + _TRIPLET_ROWS
        + "SELECT DISTINCT anchor, positives, negatives FROM rows"),
    "trimmed_positives": with_views("labels_all", """
        SELECT specialty, query, array_to_string(codes[1:2], ',') AS positives FROM labels_all WHERE len(codes) > 0"""),
    "triplet_embeddings": with_views("sim truth", "," + _DRAWS_TRIMMED + _TOPK_PICKS + _TRIPLET_ROWS + """
        , texts AS (SELECT query, array_to_string(list_transform(e, lambda x: round(x * 1000000)::BIGINT), ',') AS x FROM vec)
        SELECT r.specialty, anchor, positives, negatives, a.x AS anchor_x, p.x AS positives_x, n.x AS negatives_x
        FROM rows r JOIN texts a ON anchor = a.query JOIN texts p ON positives = p.query JOIN texts n ON negatives = n.query"""),
    "triplet_accuracy": with_views("sim truth", "," + _DRAWS_TRIMMED + _TOPK_PICKS + _TRIPLET_ROWS + """
        SELECT count(*) AS triplets, round(avg((p.s > n.s)::INTEGER), 6) AS accuracy
        FROM rows r JOIN sim p ON r.anchor = p.query AND r.positives = p.code
        JOIN sim n ON r.anchor = n.query AND r.negatives = n.code"""),
    "optimal_threshold": with_views("sim truth", """,
        counts AS (
            SELECT 0 AS fold, s, count(*) AS n, count(t.code) AS hits
            FROM sim m LEFT JOIN truth t ON m.query = t.query AND m.code = t.code GROUP BY s)"""
        + _F1 + "SELECT threshold, f1 FROM best"),
    "cv_threshold": with_views("sim truth", f""",
        folds AS (SELECT query, ((row_number() OVER (ORDER BY md5('{SEED}|' || query), query) - 1) % 5)::INTEGER AS f FROM vec),
        counts AS (
            SELECT held.f AS fold, s, count(*) AS n, count(t.code) AS hits
            FROM sim m JOIN folds ON m.query = folds.query
            JOIN (SELECT DISTINCT f FROM folds) held ON held.f <> folds.f
            LEFT JOIN truth t ON m.query = t.query AND m.code = t.code GROUP BY held.f, s)"""
        + _F1 + "SELECT fold, threshold, f1 FROM best"),
    "retrieval_evaluation": with_views("sim truth", _RANKED + """,
        lists AS (
            SELECT r.query, count(t.code) AS hits FROM ranked r
            LEFT JOIN truth t ON r.query = t.query AND r.code = t.code WHERE r.rank <= 20 GROUP BY r.query),
        sizes AS (SELECT query, count(*) AS relevant FROM truth GROUP BY query)
        SELECT count(*) AS queries, round(avg(round(hits / 20.0::DOUBLE, 6)), 6) AS precision,
               round(avg(round(hits / relevant::DOUBLE, 6)), 6) AS recall,
               sum(hits)::BIGINT AS exact_matches, sum(hits)::BIGINT AS family_matches
        FROM lists JOIN sizes USING (query)"""),
}

SQL["mean_threshold"] = f"SELECT round(avg(threshold), 6) AS mean_threshold, count(*) AS folds FROM ({SQL['cv_threshold']})"
SQL["code_embeddings_from_text"] = r"""
    WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^ \t\n\r]+')) AS word FROM documents),
    hashed AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT AS h FROM words),
    counts AS (
        SELECT doc_id, ((h >> 1) % 64)::INTEGER AS pos, sum(CASE WHEN h & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS n
        FROM hashed GROUP BY ALL),
    lengths AS (SELECT doc_id, sqrt(sum(n * n)) AS length FROM counts GROUP BY doc_id)
    SELECT doc_id, pos, round((n / length)::FLOAT::DOUBLE, 6) AS x FROM counts JOIN lengths USING (doc_id) WHERE n <> 0"""
SQL["query_to_code_mapping"] = r"""
    WITH sides AS (
        SELECT DISTINCT 'query' AS side, text AS key, text FROM conversations WHERE text IS NOT NULL
        UNION ALL SELECT 'code', item_id::VARCHAR, text FROM benchmark WHERE text IS NOT NULL),
    hashed AS (
        SELECT side, key, ('0x' || substr(md5(word), 1, 8))::BIGINT AS h
        FROM (SELECT side, key, unnest(regexp_extract_all(lower(text), '[^ \t\n\r]+')) AS word FROM sides)),
    counts AS (
        SELECT side, key, ((h >> 1) % 64)::INTEGER AS pos, sum(CASE WHEN h & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS n FROM hashed GROUP BY ALL),
    scaled AS (SELECT side, key, pos, (n / sqrt(sum(n * n) OVER (PARTITION BY side, key)))::FLOAT::DOUBLE AS x FROM counts),
    lengths AS (SELECT side, key, sqrt(sum(x * x)) AS length FROM scaled GROUP BY side, key),
    dots AS (
        SELECT q.key AS query, c.key AS code, sum(q.x * c.x) AS dot FROM scaled q JOIN scaled c ON q.pos = c.pos AND q.side = 'query' AND c.side = 'code'
        GROUP BY ALL),
    ranked AS (
        SELECT q.key AS query, c.key AS code, row_number() OVER (PARTITION BY q.key ORDER BY
            round(coalesce(CASE WHEN a.length * b.length > 0 THEN dot / (a.length * b.length) END, 0), 6) DESC, c.key) AS rank
        FROM sides q JOIN sides c ON q.side = 'query' AND c.side = 'code'
            LEFT JOIN dots ON dots.query = q.key AND dots.code = c.key
            LEFT JOIN lengths a ON a.side = 'query' AND a.key = q.key LEFT JOIN lengths b ON b.side = 'code' AND b.key = c.key)
    SELECT query, string_agg(code, ',' ORDER BY rank) AS codes FROM ranked WHERE rank <= 3 GROUP BY query"""
SQL |= selection_sql(THRESHOLD, SEED)
