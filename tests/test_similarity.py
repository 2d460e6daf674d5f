"""Vector operators against brute force, on every physical path, with one hot group."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescout.functions import draws
from codescout.functions.vectors import cosine, l2_normalize
from codescout.operators import blocks, diversity, evaluation, mining, retrieval
from codescout.operators.embed import embed_texts, hashing_encoder
from codescout.plans import jobs

PATHS = [
    {},
    {"block_bytes": 400},
    {"block_bytes": 400, "broadcast_bytes": 0},
]


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """The data is small, and most of the time goes into starting tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def unit(matrix):
    matrix = np.asarray(matrix, dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms > 0, norms, 1)


def micro(a, b):
    return np.rint(unit(a) @ unit(b).T * 1e6).astype(np.int64)


@pytest.fixture(scope="module")
def data():
    """120 queries, half of them in one specialty, with copies and a zero vector; 90 codes."""
    rng = np.random.default_rng(7)
    queries = rng.normal(size=(120, 8)).astype(np.float32)
    queries[10:16] = queries[9]
    queries[20] = 0
    codes = rng.normal(size=(90, 8)).astype(np.float32)
    codes[5:9] = codes[4]
    specialties = ["hot" if i % 2 else f"s{i % 3}" for i in range(120)]
    return [f"q{i:03d}" for i in range(120)], specialties, queries, [f"c{i:03d}" for i in range(90)], codes


@pytest.fixture(scope="module")
def queries(spark, data):
    names, specialties, vectors, _, _ = data
    rows = [(n, s, v.tolist()) for n, s, v in zip(names, specialties, vectors)]
    return spark.createDataFrame(rows, "query string, specialty string, embedding array<float>").repartition(3).cache()


@pytest.fixture(scope="module")
def codes(spark, data):
    rows = [(c, i, v.tolist()) for i, (c, v) in enumerate(zip(data[3], data[4]))]
    return spark.createDataFrame(rows, "code string, ord long, embedding array<float>").repartition(4).cache()


def test_cosine_and_norm(spark):
    rows = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select(cosine("a", "b").alias("c"), l2_normalize(F.col("a")).alias("u")).collect()
    assert got[0].c == pytest.approx(0.96) and got[1].c == 0 and got[2].c is None
    assert got[0].u == pytest.approx([0.6, 0.8]) and got[1].u == [0, 0]


@pytest.mark.parametrize("limits", PATHS)
@pytest.mark.parametrize("k", [1, 10, 500])
def test_top_k(data, queries, codes, limits, k):
    names, _, q, code_names, c = data
    scores = micro(q, c)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    got = retrieval.top_k_codes(queries, codes, k, **limits).collect()
    assert {(r.query, r.rank, r.code, r.similarity) for r in got} == {
        (names[i], j + 1, code_names[order[i, j]], scores[i, order[i, j]] / 1e6)
        for i in range(len(names))
        for j in range(order.shape[1])
    }
    assert len(got) == len(names) * min(k, 90)


def test_mixed_dimensions_are_refused(spark, codes):
    odd = spark.createDataFrame([("x", [1.0, 2.0])], "query string, embedding array<float>")
    with pytest.raises(Exception, match="differ in dimension"):
        retrieval.top_k_codes(odd, codes, 1).collect()


def test_top_k_without_codes(queries, codes):
    assert retrieval.top_k_codes(queries, codes.limit(0), 3).count() == 0


@pytest.mark.parametrize("limits", PATHS)
def test_exclusion(data, queries, codes, limits):
    names, _, q, code_names, c = data
    barred = queries.withColumn("positives", F.when(F.col("query") < "q060", F.array(F.lit("c004"), F.lit("c050"), F.lit("zzz"))))
    got = retrieval.top_k_codes(barred, codes, 100, exclude="positives", **limits).collect()
    assert len(got) == 60 * 88 + 60 * 90
    assert not [r for r in got if r.query < "q060" and r.code in ("c004", "c050")]


@pytest.mark.parametrize("limits", PATHS[::2])
def test_percentiles(data, queries, codes, limits):
    names, _, q, code_names, c = data
    barred = queries.withColumn("positives", F.array(F.lit("c001"), F.lit("c002")))
    got = {r.query: r for r in mining.similarity_percentiles(barred, codes, (0, 33, 70, 90, 100), **limits).collect()}
    kept = np.delete(micro(q, c), [1, 2], axis=1) / 1e6
    assert len(got) == len(names)
    for i, name in enumerate(names):
        assert got[name].candidates == 88
        for p in (0, 33, 70, 90, 100):
            assert got[name][f"p{p}"] == pytest.approx(np.percentile(kept[i], p), abs=2e-9)


@pytest.mark.parametrize("limits", PATHS[::2])
def test_band_quotas(data, queries, codes, limits):
    names, _, q, code_names, c = data
    barred = queries.withColumn("positives", F.array(F.lit("c001"), F.lit("c002")))
    rows = mining.mine_negatives_band(barred, codes, 20, **limits).collect()
    scores = micro(q, c) / 1e6
    place = {name: i for i, name in enumerate(code_names)}
    for i, name in enumerate(names):
        mine = [r for r in rows if r.query == name]
        kept = np.delete(scores[i], [1, 2])
        low, high = np.percentile(kept, 70), np.percentile(kept, 90)
        hard, easy = [r for r in mine if r.kind == "hard"], [r for r in mine if r.kind == "easy"]
        n_hard = min(((kept >= low) & (kept < high)).sum(), 10)
        assert len(hard) == n_hard and len(easy) == min((kept < low).sum(), 20 - n_hard)
        assert len({r.code for r in mine}) == len(mine) and not {"c001", "c002"} & {r.code for r in mine}
        for r in mine:
            assert r.similarity == scores[i][place[r.code]]
            assert (low <= r.similarity < high) if r.kind == "hard" else r.similarity < low
    reference = mining.mine_negatives_band(barred, codes, 20).collect()
    assert {(r.query, r.code) for r in rows} == {(r.query, r.code) for r in reference}


def test_topk_quotas_of_a_hundred(spark, queries):
    rng = np.random.default_rng(3)
    pool = spark.createDataFrame(
        [(f"c{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(100, 8)).astype(np.float32))],
        "code string, embedding array<float>",
    )
    asked = queries.filter("query <> 'q020'").withColumn("positives", F.array().cast("array<string>"))
    got = mining.mine_negatives_topk(asked, pool, 50).groupBy("query").pivot("kind", ["hard", "easy"]).count().collect()
    assert len(got) == 119 and {(r.hard, r.easy) for r in got} == {(25, 25)}


def test_few_candidates_are_all_taken(queries, codes):
    asked = queries.withColumn("positives", F.array(F.lit("c001"), F.lit("none")))
    got = mining.mine_negatives_topk(asked, codes, 95)
    counts = got.groupBy("query", "kind").count().collect()
    assert len(counts) == 120 and {(r.kind, r["count"]) for r in counts} == {("all", 89)}
    assert got.filter("code = 'c001'").count() == 0
    band = mining.mine_negatives_band(asked, codes, 95)
    assert band.filter("kind <> 'all'").count() == 0 and band.count() == 120 * 89


def greedy_by_hand(vectors, threshold, limit):
    if len(vectors) <= 1:
        return list(range(len(vectors)))
    scores = micro(vectors, vectors)
    u = unit(vectors)
    total = u.sum(axis=0)
    first = int(np.argmin(np.round(u @ (total / np.linalg.norm(total)), 9)))
    chosen, rest = [first], set(range(len(vectors))) - {first}
    while rest and (limit is None or len(chosen) < limit):
        rest = {i for i in rest if max(scores[i, j] for j in chosen) <= round(threshold * 1e6)}
        if not rest:
            break
        best = min(sorted(rest), key=lambda i: sum(scores[i, j] for j in chosen))
        chosen.append(best)
        rest.remove(best)
    return chosen


@pytest.mark.parametrize(
    "task_bytes, limit", [(1 << 20, None), (1 << 20, 0), (1 << 20, 4), (64 * 30, None), (0, 0), (0, 4), (1000, 9)]
)
def test_greedy(data, queries, task_bytes, limit):
    names, specialties, vectors, _, _ = data
    expected = set()
    for s in sorted(set(specialties)):
        members = [i for i, x in enumerate(specialties) if x == s]
        for place, j in enumerate(greedy_by_hand(vectors[members], 0.3, limit), start=1):
            expected.add((s, names[members[j]], place))
    got = diversity.diverse_greedy(queries, 0.3, limit, task_bytes=task_bytes).collect()
    assert {(r.specialty, r.query, r.place) for r in got} == expected and len(got) == len(expected)


def test_a_round_makes_many_choices(spark, monkeypatch):
    """Vectors with a common direction, as texts have: far fewer rounds than choices, and no window that sorts a specialty."""
    rng = np.random.default_rng(1)
    rows = [("hot", f"q{i:05d}", v.tolist()) for i, v in enumerate(0.5 * rng.normal(size=(1500, 16)) + 1)]
    frame = spark.createDataFrame(rows, "specialty string, query string, embedding array<double>").repartition(3).cache()
    plans, pool = [], diversity._pool

    def watched(state, *others):
        plans.append(state._jdf.queryExecution().executedPlan().toString())
        return pool(state, *others)

    monkeypatch.setattr(diversity, "_pool", watched)
    want = {(r.query, r.place) for r in diversity.diverse_greedy(frame, 0.95, 400).collect()}
    assert not plans
    got = {(r.query, r.place) for r in diversity.diverse_greedy(frame, 0.95, 400, task_bytes=2 * 128 * 400).collect()}
    assert got == want and len(want) == 400 and len(plans) < 40
    assert not any("Window" in plan for plan in plans)


@pytest.mark.parametrize("pool", [1, 7, 40, 500])
def test_pool_of_the_lowest_sums(spark, pool):
    rng = np.random.default_rng(pool)
    rows = [("a", f"k{i:03d}", int(x), 1) for i, x in enumerate(rng.integers(-(10**12), 10**12, 300))]
    rows += [("b", f"k{i:03d}", int(x), 1) for i, x in enumerate(rng.integers(0, 3, 90))]
    state = spark.createDataFrame(rows, "specialty string, query string, _sum long, _cell int").repartition(3)
    inside, outside = (x.collect() for x in diversity._pool(state, "specialty", "query", pool))
    assert sorted(map(tuple, inside + outside)) == sorted(rows)
    for s in "ab":
        mine = [(r._sum, r.query) for r in inside if r.specialty == s]
        others = [(r._sum, r.query) for r in outside if r.specialty == s]
        assert min(pool, 1) <= len(mine) <= pool and (not others or max(mine) < min(others))


@pytest.fixture
def many_tasks(spark):
    before = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_no_task_streams_a_hot_group(spark, many_tasks):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 10 else "cold", f"q{i:05d}", v.tolist()) for i, v in enumerate(rng.normal(size=(4000, 8)).astype(np.float32))]
    frame = spark.createDataFrame(rows, "specialty string, query string, embedding array<float>")
    schema = T.StructType([T.StructField("specialty", T.StringType()), T.StructField("query", T.StringType()), T.StructField("task", T.IntegerType()), T.StructField("met", T.LongType())])

    def kernel(left, right):
        task = TaskContext.get().partitionId()
        return {"query": left.columns["query"], "task": pa.array([task] * len(left), pa.int32()), "met": pa.array([len(right)] * len(left), pa.int64())}

    cell = 32 * 400  # 400 vectors
    met = blocks.meet_in_group(frame, frame, "specialty", ["query"], ["query"], "embedding", kernel, schema, block_rows=100, cell_bytes=cell).cache()
    sums = {r.query: (r.specialty, r.n) for r in met.groupBy("specialty", "query").agg(F.sum("met").alias("n")).collect()}
    assert len(sums) == 4000 and all(n == (3600 if s == "hot" else 400) for s, n in sums.values())
    hot = met.filter("specialty = 'hot'").groupBy("task").agg(F.sum("met").alias("m")).collect()
    assert len(hot) > 20 and max(r.m for r in hot) < 3600 * 3600 / 5
    large = {r.specialty: (r._parts, r._bands) for r in blocks.grids(frame, frame, "specialty", 32, cell).collect()}
    assert large == {"hot": (9, 9)}


def test_silhouette_rows_do_not_grow_with_clusters(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("s", f"q{i:04d}", i % 300, v.tolist()) for i, v in enumerate(rng.normal(size=(1200, 4)))]
    frame = spark.createDataFrame(rows, "specialty string, query string, cluster int, embedding array<double>")
    seen = []
    meet = blocks.meet_in_group
    monkeypatch.setattr(blocks, "meet_in_group", lambda *a, **k: seen.append(meet(*a, **k)) or seen[-1])
    value = diversity.silhouette(frame).first()
    assert value.num_queries == 1200 and seen[0].count() == 1200
    assert diversity.silhouette(frame, block_rows=100).first().silhouette == pytest.approx(value.silhouette, abs=1e-6)
    assert seen[1].count() <= 1200 * 13


def test_a_lone_query_is_kept(spark):
    one = spark.createDataFrame([("s", "q", [1.0, 0.0])], "specialty string, query string, embedding array<float>")
    for task_bytes in (1 << 20, 0):
        assert diversity.diverse_greedy(one, 0.8, 0, task_bytes=task_bytes).count() == 1
        assert diversity.diverse_cluster(one, task_bytes=task_bytes).count() == 1


def test_cluster_count():
    assert [diversity.cluster_count(n, None) for n in (2, 3, 4, 9, 100)] == [2, 2, 2, 3, 10]
    assert diversity.cluster_count(3, 5) == 3


def test_clusters_agree_on_both_paths(queries):
    def labels(task_bytes):
        return {r.query: (r.specialty, r.cluster, round(r.centroid_similarity, 5)) for r in diversity.cluster_queries(queries, task_bytes=task_bytes).collect()}

    small, large = labels(1 << 20), labels(0)
    assert small == large and len(small) == 120


def test_clusters_of_large_values_come_to_an_end(spark):
    rng = np.random.default_rng(4)
    rows = [("s", f"q{i:03d}", (1e9 * rng.normal(size=3)).tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "specialty string, query string, embedding array<double>").repartition(4)
    small, large = ({r.query: r.cluster for r in diversity.cluster_queries(frame, task_bytes=b).collect()} for b in (1 << 20, 0))
    assert small == large


def test_cluster_choice(data, queries):
    labelled = diversity.cluster_queries(queries).collect()
    chosen = diversity.diverse_cluster(queries, per_cluster=2).collect()
    groups = {}
    for r in labelled:
        groups.setdefault((r.specialty, r.cluster), []).append((-r.centroid_similarity, r.query))
    expected = {(s, q) for (s, _), members in groups.items() for _, q in sorted(members)[:2]}
    assert {(r.specialty, r.query) for r in chosen} == expected


def test_average_similarity_is_the_pair_loop(data, queries):
    _, specialties, vectors, _, _ = data
    got = {r.specialty: r for r in diversity.average_pairwise_similarity(queries, ["specialty"]).collect()}
    for s in set(specialties):
        members = [i for i, x in enumerate(specialties) if x == s]
        scores = unit(vectors[members]) @ unit(vectors[members]).T
        np.fill_diagonal(scores, 0)
        n = len(members)
        assert got[s].num_queries == n
        assert got[s].avg_similarity == pytest.approx(scores.sum() / (n * (n - 1)), abs=1e-6)


def test_silhouette_by_hand(data, queries):
    _, specialties, vectors, _, _ = data
    labelled = queries.withColumn("cluster", F.pmod(F.xxhash64("query"), F.lit(3)).cast("int")).cache()
    cluster = {r.query: r.cluster for r in labelled.collect()}
    names = data[0]
    expected = {}
    for s in set(specialties):
        members = [i for i, x in enumerate(specialties) if x == s]
        own = np.array([cluster[names[i]] for i in members])
        points = vectors[members].astype(float)
        d = np.linalg.norm(points[:, None] - points[None], axis=2)
        values = []
        for i in range(len(members)):
            same = own == own[i]
            if same.sum() == 1:
                values.append(0.0)
                continue
            a = d[i][same].sum() / (same.sum() - 1)
            b = min(d[i][own == o].mean() for o in set(own) - {own[i]})
            values.append((b - a) / max(a, b))
        expected[s] = np.mean(values)
    for rows in (4096, 7):
        got = {r.specialty: r.silhouette for r in diversity.silhouette(labelled, block_rows=rows).collect()}
        assert got == {s: pytest.approx(v, abs=2e-6) for s, v in expected.items()}


def test_coverage(data, queries):
    names, specialties, vectors, _, _ = data
    selected = queries.filter("query < 'q030' and specialty <> 's2'")
    got = {r.specialty: r.coverage for r in diversity.embedding_coverage(selected, queries).collect()}
    for s in set(specialties):
        every = [i for i, x in enumerate(specialties) if x == s]
        some = [i for i in every if i < 30 and s != "s2"]
        expected = micro(vectors[every], vectors[some]).max(axis=1).mean() / 1e6 if some else 0.0
        assert got[s] == pytest.approx(expected, abs=1e-6)


def test_code_coverage_without_codes(spark):
    every = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "specialty string, query string")
    mapping = spark.createDataFrame([("1", "X"), ("2", "X"), ("2", "Y")], "query string, code string")
    got = {r.specialty: r.code_coverage for r in diversity.code_coverage(every.filter("query = '1'"), every, mapping).collect()}
    assert got == {"a": 0.5, "b": 0.0}


def best_by_hand(scores, relevant):
    best = (-1.0, None)
    for t in np.unique(scores):
        got = scores >= t
        hit = (got & relevant).sum()
        f1 = round(2 * hit / (got.sum() + relevant.sum()), 9)
        if f1 > best[0]:
            best = (f1, t)
    return best[1] / 1e6, round(best[0], 6)


@pytest.mark.parametrize("limits", PATHS[::2])
def test_threshold(spark, data, queries, codes, limits):
    names, _, q, code_names, c = data
    # The code c003 appears twice; it counts as relevant only at its first row.
    double = codes.unionByName(codes.filter("code = 'c010'").select(F.lit("c003").alias("code"), F.lit(500).cast("long").alias("ord"), "embedding"))
    pairs = [(n, f"c{(i * 7) % 90:03d}") for i, n in enumerate(names)] + [(n, "missing") for n in names] + [(n, "c003") for n in names]
    truth = spark.createDataFrame(pairs, "query string, code string")
    scores = np.hstack([micro(q, c), micro(q, c[[10]])])
    relevant = np.zeros(scores.shape, dtype=bool)
    for i in range(len(names)):
        relevant[i, (i * 7) % 90] = relevant[i, 3] = True
    row = evaluation.optimal_threshold(queries, double, truth, **limits).first()
    assert (row.threshold, row.f1) == best_by_hand(scores, relevant)
    folds = {r.query: r.fold for r in evaluation.assign_folds(queries, 4).collect()}
    assert sorted(np.bincount(list(folds.values()))) == [30, 30, 30, 30]
    got = {r.fold: (r.threshold, r.f1) for r in evaluation.cv_threshold(queries, double, truth, 4, **limits).collect()}
    for fold in range(4):
        train = np.array([folds[n] != fold for n in names])
        assert got[fold] == best_by_hand(scores[train], relevant[train])


def test_precision_recall_case(spark):
    df = spark.createDataFrame(
        [(["F32.44", "M54.5"], ["F32.41", "F32.0", "I10", "M54.5"]), ([], ["A"]), (["A"], [])],
        "relevant array<string>, retrieved array<string>",
    )
    got = evaluation.precision_recall_at_k(df, 3).collect()
    assert (got[0].precision, got[0].recall, got[0].exact_matches, got[0].family_matches) == (0.333333, 0.5, 0, 1)
    assert [(r.precision, r.recall, r.exact_matches) for r in got[1:]] == [(0, 0, 0), (0, 0, 0)]


def test_triplets_and_accuracy(spark, data, queries, codes):
    asked = queries.withColumn("positives", F.array(F.lit(""), F.lit("c001"), F.lit("c002"), F.lit("c003")))
    lists = mining.build_triplets(asked, codes, 2, 10).collect()
    assert len(lists) == 120
    assert all(r.positives == ["c001", "c002"] and not {"c001", "c002"} & set(r.negatives) for r in lists)
    assert {len(r.negatives) for r in lists} <= set(range(5, 11))
    clean, accuracy = jobs.training_set(asked, codes, 2, 10)
    names, _, q, code_names, c = data
    scores = {n: dict(zip(code_names, row)) for n, row in zip(names, micro(q, c))}
    rows = clean.collect()
    expected = np.mean([scores[r.anchor][r.positives] > scores[r.anchor][r.negatives] for r in rows])
    result = accuracy.first()
    assert result.triplets == len(rows) and result.accuracy == pytest.approx(expected, abs=1e-6)


def test_evaluation_of_methods(queries, spark):
    mapping = queries.select("query", F.substring("query", 4, 1).alias("code"))
    choices = diversity.run_comparison(queries, 0.3)
    rows = diversity.evaluate_methods(queries, choices, mapping).collect()
    assert len(rows) == 8 and all(0 < r.coverage <= 1 and 0 < r.code_coverage <= 1 and r.num_queries > 0 for r in rows)
    wins = jobs.diversity_evaluation(queries, mapping, 0.3)["wins"].first()
    assert wins.challenger_wins + wins.incumbent_wins == 4


def test_embed_each_text_once(spark):
    texts = spark.createDataFrame([("a b",), ("a b",), (None,), ("c",)], "text string")
    got = embed_texts(texts, "text", hashing_encoder(16)).collect()
    assert len(got) == 4
    vectors = {r.text: r.embedding for r in got}
    assert vectors[None] is None and len(vectors["a b"]) == 16
    assert np.linalg.norm(vectors["a b"]) == pytest.approx(1, abs=1e-6)


def test_top_cells_breaks_ties_by_column():
    scores = np.array([[5, 7, 7, 1], [0, 0, 0, 0]])
    assert blocks.top_cells(scores, 2).tolist() == [[1, 2], [0, 1]]


@pytest.mark.parametrize("task_bytes", [64 << 20, 64])
def test_rows_that_take_no_part_do_not_depend_on_the_path(spark, task_bytes):
    rng = np.random.default_rng(5)
    rows = [("a", f"q{i:02d}", rng.normal(size=4).tolist()) for i in range(12)]
    odd = [("a", "q90", None), ("a", "q91", []), ("a", "q92", [1.0, None, 0.0, 0.0]), ("a", "q00", rows[0][2]), ("b", "q93", None)]
    schema = "specialty string, query string, embedding array<double>"
    plain, awkward = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + odd, schema)
    for choose in (diversity.diverse_greedy, diversity.cluster_queries):
        wanted = sorted(map(str, choose(plain, task_bytes=64 << 20).collect()))
        assert sorted(map(str, choose(awkward, task_bytes=task_bytes).collect())) == wanted


@pytest.mark.parametrize("limits", PATHS)
def test_percentiles_keep_queries_without_candidates(spark, codes, limits):
    rows = [("x", [1.0] * 8, []), ("y", None, []), ("z", [0.5, *[1.0] * 7], [f"c{i:03d}" for i in range(90)])]
    frame = spark.createDataFrame(rows, "query string, embedding array<float>, positives array<string>")
    got = {r.query: r for r in mining.similarity_percentiles(frame, codes, **limits).collect()}
    assert {q: r.candidates for q, r in got.items()} == {"x": 90, "y": 0, "z": 0}
    assert got["y"].p70 is None and got["z"].p70 is None and got["x"].p70 is not None


def test_scarce_queries_get_all_candidates(spark, codes):
    rows = [("few", [1.0] * 8, [f"c{i:03d}" for i in range(60)]), ("many", [1.0] * 8, ["c000"]), ("none", [1.0] * 8, [f"c{i:03d}" for i in range(90)])]
    frame = spark.createDataFrame(rows, "query string, embedding array<float>, positives array<string>")
    got = mining.mine_negatives_topk(frame, codes, 50).collect()
    assert {r.code for r in got if r.query == "few"} == {f"c{i:03d}" for i in range(60, 90)}
    assert len([r for r in got if r.query == "many"]) == 50 and not [r for r in got if r.query == "none"]
    assert mining.mine_negatives_topk(frame, codes.limit(0), 50).count() == 0


def test_cells_hold_what_they_need(spark):
    """Each vector goes to a task as a row of its own, so no batch holds a block for each other block."""
    rng = np.random.default_rng(3)
    made = rng.normal(size=(700, 4)).astype(np.float32)
    frame = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(made)], "query string, embedding array<float>")
    codes = frame.withColumnRenamed("query", "code")

    schema = T.StructType([T.StructField("query", T.StringType()), T.StructField("held", T.LongType())])

    def kernel(left, right):
        return {"query": left.columns["query"], "held": pa.array(np.full(len(left), len(right)))}

    met, n = blocks.meet(frame, codes, ["query"], ["code"], "embedding", kernel, schema, block_bytes=1600, broadcast_bytes=0)
    text = met._jdf.queryExecution().executedPlan().toString()
    assert n == 7 and "Join" not in text
    got = met.groupBy("query").agg(F.sum("held").alias("n")).collect()
    assert len(got) == 700 and {r.n for r in got} == {700}


def test_high_products_alone_are_ordered():
    rng = np.random.default_rng(5)
    products = np.round(rng.normal(size=(20, 900)) / 4, 2)  # many ties
    products[3, :890] = -np.inf
    products[4] = -np.inf
    rows, places, columns, scores = blocks.top_products(products, 7)
    for i in range(20):
        want = [c for c in np.lexsort((np.arange(900), -products[i]))[:7] if np.isfinite(products[i, c])]
        assert columns[rows == i].tolist() == want and places[rows == i].tolist() == list(range(len(want)))
    assert (scores == np.rint(products[rows, columns] * 1e6)).all()


def test_low_draws_are_the_first_ones(spark, monkeypatch):
    """Picks from pairs with low draws are those from all pairs, also when too few are looked at for some queries."""
    rng = np.random.default_rng(6)
    made = rng.normal(size=(600, 6)).astype(np.float32)
    pool = spark.createDataFrame([(f"c{i}", x.tolist()) for i, x in enumerate(made)], "code string, embedding array<float>")
    asked = pool.limit(40).select(F.col("code").alias("query"), F.array(F.col("code"), F.lit("c7")).alias("positives"), "embedding")
    got = {}
    for looked_at in (1000, 3, 1):
        monkeypatch.setattr(mining, "LOOKED_AT", looked_at)
        rows = mining.mine_negatives_band(asked, pool, 10, block_bytes=2400, broadcast_bytes=0).collect()
        got[looked_at] = sorted(map(tuple, rows))
    assert len(got[1000]) == 400 and got[1000] == got[3] == got[1]


def test_a_task_that_holds_the_pool_finds_the_same(spark):
    """Nearest codes, percentiles and picks of the path for pools that a task holds, and the plan of it: nothing is merged."""
    rng = np.random.default_rng(11)
    made = np.round(rng.normal(size=(5000, 5)), 1).astype(np.float32)  # many equal cosines
    pool = spark.createDataFrame([(f"c{i}", x.tolist()) for i, x in enumerate(made)], "code string, embedding array<float>").repartition(5)
    asked = pool.limit(90).select(F.col("code").alias("query"), F.array(F.col("code"), F.lit("c7"), F.lit("none")).alias("positives"), "embedding")
    asked = asked.unionByName(spark.createDataFrame([("alone", None, [0.0] * 5), ("empty", [], None)], "query string, positives array<string>, embedding array<float>")).cache()
    held, grid = {"broadcast_bytes": 0, "task_bytes": 1 << 30}, {"broadcast_bytes": 0, "block_bytes": 4000}
    assert blocks.fits_task(pool, "embedding", **held) and not blocks.fits_task(pool, "embedding", **grid)

    def rows(frame):
        return sorted(map(tuple, frame.collect()), key=str)

    for k in (1, 30):
        both = [retrieval.nearest(asked, pool, k, ["query"], "code", "embedding", "positives", **limits) for limits in (held, grid)]
        assert "Window" not in both[0]._jdf.queryExecution().executedPlan().toString()
        assert rows(both[0]) == rows(both[1]) and both[0].count() == 91 * k
    assert rows(mining.similarity_percentiles(asked, pool, (0, 33, 70, 100), **held)) == rows(mining.similarity_percentiles(asked, pool, (0, 33, 70, 100), **grid))
    assert rows(mining.mine_negatives_band(asked, pool, 10, **held)) == rows(mining.mine_negatives_band(asked, pool, 10, **grid))


@pytest.mark.parametrize("pivots", [32768, 20])
def test_percentiles_do_not_rest_on_the_pivots(monkeypatch, pivots):
    """Every hundredth code lies apart from all others, and with few pivots only these say where to look."""
    rng = np.random.default_rng(12)
    made = rng.normal(size=(2000, 3))
    made[::100] = made[0] + rng.normal(size=(20, 3)) / 100
    asked = rng.normal(size=(40, 3))
    blocked = [blocks.Block({}, made[i:i + 500]) for i in range(0, 2000, 500)]
    monkeypatch.setattr(mining, "_PIVOTS", pivots)
    barred = rng.random((40, 2000)) < 0.3
    barred[3], barred[4, 1:] = True, True
    starts = {id(b): i * 500 for i, b in enumerate(blocked)}
    places = {x.tobytes(): i for i, x in enumerate(asked)}

    def barred_in(left, right):
        return barred[[places[x.tobytes()] for x in left.matrix], starts[id(right)]:starts[id(right)] + 500]

    counts, values = mining._percentiles_of_all(blocks.Block({}, asked), blocked, (10, 70, 90), barred_in)
    scores = micro(asked, made) / 1e6
    assert counts.tolist() == (~barred).sum(axis=1).tolist()
    for row in range(40):
        if counts[row]:
            assert values[row] == pytest.approx(np.percentile(scores[row][~barred[row]], [10, 70, 90]), abs=1e-9)


def test_low_pairs_are_those_of_all_draws():
    rng = np.random.default_rng(13)
    a, b = rng.integers(0, 1 << 60, 300), rng.integers(0, 1 << 60, 2000)
    a[0], b[5] = b[0], a[1] ^ draws.MODULUS
    for upto in (0, 5_000, 3_000_000, draws.MODULUS - 1):
        want = np.nonzero(draws.pair_draws(a[:, None], b[None, :]) <= upto)
        assert [x.tolist() for x in draws.low_pairs(a, b, upto)] == [x.tolist() for x in want]


def test_scores_are_counted_by_fold(spark):
    """Counts of all pairs, for blocks of many rows, are those of the rounded cosines."""
    rng = np.random.default_rng(14)
    made = np.round(rng.normal(size=(300, 3)), 1).astype(np.float32)
    frame = spark.createDataFrame([(f"q{i:03d}", i % 3, x.tolist()) for i, x in enumerate(made)], "query string, f int, embedding array<float>")
    codes = frame.select(F.col("query").alias("code"), F.col("f").alias("ord"), "embedding")
    truth = spark.createDataFrame([("q000", "q001")], "query string, code string")
    for limits in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "block_bytes": 1000}):
        got = {(r.fold, r.score): (r.n, r.hits) for r in evaluation.score_counts(frame, codes, truth, fold="f", **limits).collect()}
        want = {}
        for i, row in enumerate(micro(made, made)):
            for score in row.tolist():
                want[i % 3, score] = want.get((i % 3, score), 0) + 1
        assert {x: n for x, (n, _) in got.items() if n} == want and sum(h for _, h in got.values()) == 1
