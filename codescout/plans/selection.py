"""SQL of the iterative selection methods: recursion whose state is the list of choices, or of centroids and labels, of each group."""

from __future__ import annotations

from codescout.operators.diversity import CLUSTERED, GREEDY, MEASURES
from codescout.plans.catalog import stacked, with_views


def greedy_sql(threshold: float) -> str:
    """Common tables up to ``greedy`` (specialty, query, place)."""
    return f""",
    units AS (SELECT query, specialty, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS length FROM vec),
    totals AS (
        SELECT specialty, list(total ORDER BY i) AS total FROM (
            SELECT specialty, i, sum(e[i] / length) AS total FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM units) GROUP BY specialty, i)
        GROUP BY specialty),
    first AS (
        SELECT specialty, arg_min(query, {{'s': round(list_cosine_similarity(e, total), 9), 'q': query}}) AS query
        FROM vec JOIN totals USING (specialty) GROUP BY specialty),
    inside AS (SELECT specialty, query, code, round(s * 1000000)::BIGINT AS micro FROM sim WHERE specialty = code_specialty),
    picked AS (
        SELECT specialty, [query] AS picks FROM first
        UNION ALL
        SELECT specialty, list_append(picks, query) FROM (
            SELECT p.specialty, p.picks, m.query, row_number() OVER (PARTITION BY p.specialty ORDER BY sum(m.micro), m.query) AS place
            FROM picked p JOIN inside m ON m.specialty = p.specialty AND list_contains(p.picks, m.code)
            WHERE NOT list_contains(p.picks, m.query)
            GROUP BY p.specialty, p.picks, m.query HAVING max(m.micro) <= {round(threshold * 1_000_000)})
        WHERE place = 1),
    greedy AS (SELECT specialty, picks[len(picks)] AS query, len(picks)::INTEGER AS place FROM picked)"""


def clusters_sql(points: str, name: str, seed: int) -> str:
    """Common tables up to ``name`` (grp, query, e, cluster, centroid_similarity): K-means of ``points`` (grp, query, e) per group."""
    return f""",
    {name}_placed AS (
        SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('{seed}|' || query), query) AS place, count(*) OVER (PARTITION BY grp) AS n
        FROM {points}),
    {name}_rounds AS (
        SELECT grp, 0 AS step, list(e ORDER BY place) FILTER (place <= least(greatest(2, least(floor(sqrt(n)), n - 1)), n)) AS middles,
            NULL::BIGINT[] AS labels, false AS done
        FROM {name}_placed GROUP BY grp
        UNION ALL
        SELECT grp, step + 1, CASE WHEN fresh IS NOT DISTINCT FROM labels THEN middles
            ELSE list_transform(range(1, len(middles) + 1), lambda i: CASE WHEN list_contains(fresh, i)
                THEN list_transform(range(1, len(middles[1]) + 1), lambda d:
                    list_avg(list_transform(list_filter(members, lambda m: m.l = i), lambda m: m.e[d])))
                ELSE middles[i] END) END,
            fresh, fresh IS NOT DISTINCT FROM labels
        FROM (
            SELECT grp, step, any_value(middles) AS middles, any_value(labels) AS labels,
                list({{'l': l, 'e': e}} ORDER BY query) AS members, list(l ORDER BY query) AS fresh
            FROM (
                SELECT r.grp, r.step, r.middles, r.labels, p.query, p.e, list_position(distances, list_min(distances))::BIGINT AS l
                FROM (SELECT grp, step, middles, labels FROM {name}_rounds WHERE NOT done) r JOIN {points} p ON p.grp = r.grp,
                    LATERAL (SELECT list_transform(r.middles, lambda m: list_distance(p.e, m)) AS distances))
            GROUP BY grp, step)),
    {name}_last AS (SELECT grp, middles, labels FROM {name}_rounds WHERE done),
    {name} AS (
        SELECT p.grp, p.query, p.e, (labels[spot] - 1)::INTEGER AS cluster, round(list_cosine_similarity(p.e, middles[labels[spot]]), 6) AS centroid_similarity
        FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY query) AS spot FROM {points}) p JOIN {name}_last USING (grp))"""


def silhouette_sql(labelled: str, name: str) -> str:
    """Common tables up to ``name`` (grp, num_queries, silhouette) of ``labelled`` (grp, query, e, cluster)."""
    return f""",
    {name}_sums AS (
        SELECT a.grp, a.query, a.cluster AS own, b.cluster AS other,
            sum(CASE WHEN a.query = b.query THEN 0 ELSE list_distance(a.e, b.e) END) AS total, count(*) AS n
        FROM {labelled} a JOIN {labelled} b ON a.grp = b.grp GROUP BY ALL),
    {name}_parts AS (
        SELECT grp, query, max(n) FILTER (own = other) AS members,
            max(total / nullif(n - 1, 0)) FILTER (own = other) AS a, min(total / n) FILTER (own <> other) AS b
        FROM {name}_sums GROUP BY ALL),
    {name} AS (
        SELECT grp, count(*) AS num_queries, round(CASE WHEN count(*) < 4 THEN 0 ELSE avg(CASE WHEN members > 1 AND b IS NOT NULL
            THEN (b - a) / greatest(a, b) ELSE 0 END) END, 6) AS silhouette
        FROM {name}_parts GROUP BY grp)"""


def _recursive(names: str, body: str) -> str:
    return with_views(names, body).replace("WITH ", "WITH RECURSIVE ", 1)


def selection_sql(threshold: float, seed: int) -> dict[str, str]:
    """SQL of the queries over the two selection methods, by name."""
    groups = ", groups AS (SELECT specialty AS grp, query, e FROM vec)"
    nearest = """,
    chosen AS (
        SELECT grp AS specialty, query, cluster, centroid_similarity,
            row_number() OVER (PARTITION BY grp, cluster ORDER BY centroid_similarity DESC, query)::INTEGER AS place
        FROM clustered QUALIFY place <= 1)"""
    both = f""",
    choices AS (
        SELECT '{GREEDY}' AS method, specialty, query, place FROM greedy
        UNION ALL SELECT '{CLUSTERED}', specialty, query, place FROM chosen)"""
    methods = greedy_sql(threshold) + groups + clusters_sql("groups", "clustered", seed) + nearest + both
    measured = f""",
    complete AS (SELECT specialty FROM choices GROUP BY specialty HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM choices)),
    kept AS (
        SELECT method, specialty, method || '/' || specialty AS grp, query, e
        FROM choices JOIN complete USING (specialty) JOIN vec USING (specialty, query)),
    cells AS (SELECT DISTINCT method, specialty, grp FROM kept),
    likeness AS (
        SELECT a.grp, count(DISTINCT a.query) AS num_queries,
            round(coalesce(sum(CASE WHEN a.query <> b.query THEN list_cosine_similarity(a.e, b.e) ELSE 0 END)
                / nullif(count(DISTINCT a.query) * (count(DISTINCT a.query) - 1), 0), 0), 6) AS avg_similarity
        FROM kept a JOIN kept b ON a.grp = b.grp GROUP BY a.grp),
    reached AS (
        SELECT k.grp, s.query, max(s.s) AS best FROM kept k JOIN sim s ON s.specialty = k.specialty AND s.code = k.query GROUP BY ALL),
    covered AS (SELECT grp, round(sum(round(best * 1000000)::BIGINT)::DOUBLE / count(*) / 1000000, 12) AS coverage FROM reached GROUP BY grp),
    every_code AS (SELECT v.specialty, count(DISTINCT code) AS n FROM vec v JOIN truth USING (query) GROUP BY v.specialty),
    some_codes AS (SELECT grp, count(DISTINCT code) AS n FROM kept JOIN truth USING (query) GROUP BY grp)"""
    measured += clusters_sql("kept", "shaped", seed) + silhouette_sql("shaped", "shapes")
    measured += """,
    evaluation AS (
        SELECT specialty, method, likeness.num_queries, avg_similarity, coverage, silhouette,
            CASE WHEN every_code.n > 0 THEN round(coalesce(some_codes.n, 0) / every_code.n, 6) ELSE 0.0 END AS code_coverage
        FROM cells JOIN likeness USING (grp) JOIN covered USING (grp) JOIN shapes USING (grp)
            LEFT JOIN every_code USING (specialty) LEFT JOIN some_codes USING (grp))"""
    summary = ", ".join(f"round(avg({m}), 6) AS {m}" for m in MEASURES)
    totals = f", summary AS (SELECT method, {summary} FROM evaluation GROUP BY method)"
    wins = " + ".join(f"(c.{m} {'<' if m == MEASURES[0] else '>'} g.{m})::INTEGER" for m in MEASURES)
    decided = f""",
    won AS (
        SELECT {wins} AS challenger_wins FROM summary c, summary g WHERE c.method = '{CLUSTERED}' AND g.method = '{GREEDY}')
    SELECT challenger_wins, {len(MEASURES)} - challenger_wins AS incumbent_wins,
        CASE WHEN challenger_wins * 2 > {len(MEASURES)} THEN '{CLUSTERED}' WHEN challenger_wins * 2 < {len(MEASURES)} THEN '{GREEDY}' ELSE 'tie' END AS better
    FROM won"""
    sql = {
        "diverse_greedy": _recursive("sim", greedy_sql(threshold) + "SELECT * FROM greedy"),
        "diverse_cluster": _recursive("vec", groups + clusters_sql("groups", "clustered", seed) + nearest + "SELECT * FROM chosen"),
        "diversity_comparison": _recursive("sim", methods + "SELECT * FROM choices"),
        "evaluate_methods": _recursive("sim truth", methods + measured + "SELECT * FROM evaluation"),
        "method_summary": _recursive("sim truth", methods + measured + totals + "SELECT * FROM summary"),
        "method_wins": _recursive("sim truth", methods + measured + totals + decided),
    }
    parts = {"choices": "diversity_comparison", "measures": "evaluate_methods", "summary": "method_summary", "wins": "method_wins"}
    return sql | {"diversity_evaluation": stacked({part: sql[name] for part, name in parts.items()})}
