"""Labels, samples, latencies and running sums against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codescout import session
from codescout.operators import labels, latency, running, sampling
from codescout.plans import jobs

LABELS = "specialty string, query string, codes array<string>"


def as_map(df, *keys, value="codes"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_consolidation_cases(spark):
    first = spark.createDataFrame(
        [("s", "both", ["x"]), ("s", "second", []), ("s", "first", ["x"]), ("s", "none", []), ("s", "only1", ["b", "a", "a"])], LABELS
    )
    second = spark.createDataFrame(
        [("s", "both", ["y"]), ("s", "second", ["y"]), ("s", "first", []), ("s", "none", []), ("t", "only2", [])], LABELS
    )
    merged = labels.consolidate(first, second)
    assert as_map(merged, "specialty", "query") == {
        ("s", "both"): ["x", "y"], ("s", "second"): ["y"], ("s", "first"): ["x"], ("s", "none"): [],
        ("s", "only1"): ["a", "b"], ("t", "only2"): [],
    }
    assert {r["query"] for r in labels.find_empty_queries(merged).collect()} == {"none", "only2"}
    summary = {r.data_set: (r.specialties, r.queries, r.empty) for r in labels.consolidation_summary(first, second, merged).collect()}
    assert summary == {"set1": (1, 5, 2), "set2": (2, 5, 3), "consolidated": (2, 6, 2), "reduction": (0, 0, 3)}


def test_entries_are_counted_per_input_list(spark):
    rows = spark.createDataFrame([(1, "s", "a", []), (2, "s", "b", []), (2, "t", "c", [])], "entry int, " + LABELS)
    summary = labels.consolidation_summary(rows, rows, labels.merge_label_list(rows))
    assert {r.data_set: r.specialties for r in summary.collect()}["set1"] == 3


def test_first_seen_order(spark):
    rows = [
        (1, "flu", "A", "X", ["c2", "c1"]), (2, "", "a", "x", ["c3"]), (3, "flu", "a", "X", ["c1"]),
        (4, "cold", "A", "x", []), (5, "cold", "B/", "x", ["c1"]),
    ]
    df = spark.createDataFrame(rows, "ord int, query string, nucc_class string, nucc_spec string, related_icd10cm array<string>")
    got = {(r.keyed_specialty, r.kind, r.item): (r.first_seen, r.first_position) for r in labels.group_queries_by_specialty(df, "ord").collect()}
    assert got == {
        ("a_x", "query", "flu"): (1, 0), ("a_x", "query", "cold"): (4, 0), ("a_x", "code", "c2"): (1, 0),
        ("a_x", "code", "c1"): (1, 1), ("a_x", "code", "c3"): (2, 0), ("b_x", "query", "cold"): (5, 0), ("b_x", "code", "c1"): (5, 0),
    }


@pytest.fixture(scope="module")
def reference(spark):
    rows = [(1, "A00", "one"), (2, "B00", "two"), (3, "A00", "three"), (4, "C00", "two")]
    return spark.createDataFrame(rows, "ord long, code string, description string")


def test_replies_are_validated(spark, reference):
    replies = spark.createDataFrame(
        [("s", "1", "B00, A00,B00 ,zz"), ("s", "2", "[]"), ("s", "3", "[A00, B00]"), ("s", "4", None)],
        "specialty string, query string, reply string",
    )
    codes = labels.validate_codes(replies, reference)
    assert as_map(codes, "query") == {("1",): ["B00", "A00", "B00"], ("2",): [], ("3",): [], ("4",): []}
    last = labels.last_descriptions(reference, "ord")
    assert as_map(last, "code", value="description") == {("A00",): "three", ("B00",): "two", ("C00",): "two"}
    ordered = labels.codes_to_descriptions(codes, last)
    assert as_map(ordered, "query", value="descriptions") == {("1",): ["two", "three", "two"]}
    distinct = labels.codes_to_descriptions(codes, last, distinct=True)
    assert as_map(distinct, "query", value="descriptions") == {("1",): ["three", "two"]}


def test_nonrelevant_codes_leave_the_list(spark):
    have = spark.createDataFrame([("s", "1", ["A", "B", "A", "C"]), ("s", "2", ["A"]), ("s", "3", ["A"])], LABELS)
    replies = spark.createDataFrame([("s", "1", "A, Z"), ("s", "2", "[]")], "specialty string, query string, reply string")
    assert as_map(labels.remove_nonrelevant(have, replies), "query") == {("1",): ["B", "C"], ("2",): ["A"], ("3",): ["A"]}


def test_pending_and_progress(spark):
    items = spark.createDataFrame(
        [("a/b", "1", "pending"), ("a/b", "2", "pending"), ("c", "3", "completed"), ("c", "4", "failed"), ("d", "5", "processing")],
        "specialty string, query string, status string",
    )
    written = spark.createDataFrame([("c",)], "specialty string")
    answered = spark.createDataFrame([("a_b", "2")], "specialty string, query string")
    assert {r["query"] for r in labels.pending_items(items, written, answered).collect()} == {"1", "5"}
    progress = {r.specialty: (r.total, r.completed, r.failed, r.status) for r in labels.labelling_progress(items).collect()}
    assert progress == {"a/b": (2, 0, 0, "in_progress"), "c": (2, 1, 1, "completed"), "d": (1, 0, 0, "in_progress")}


def test_label_ingest_job(spark, reference):
    items = spark.createDataFrame([("s", "1", "pending"), ("s", "2", "pending")], "specialty string, query string, status string")
    replies = spark.createDataFrame([("s", "1", "A00"), ("s", "9", "B00")], "specialty string, query string, reply string")
    out = jobs.label_ingest(items, replies, reference)
    assert as_map(out["codes"], "query") == {("1",): ["A00"]}
    assert [r["query"] for r in out["open"].collect()] == ["2"]
    assert out["progress"].first().completed == 1


@pytest.mark.parametrize("count, chunks, expected", [(5, 2, [0, 0, 0, 1, 1]), (5, 4, [0, 0, 1, 1, 2]), (3, 5, [0, 1, 2]), (0, 2, [])])
def test_chunks(spark, count, chunks, expected):
    rows = spark.createDataFrame([(f"s{i}", j) for i in range(count) for j in range(3)], "specialty string, n int")
    got = labels.split_by_specialty(rows, chunks).select("specialty", "chunk").distinct().orderBy("specialty").collect()
    assert [r.chunk for r in got] == expected


def plan_by_hand(p, s, target, threshold):
    if p + s < target:
        return p, s
    if p == 0:
        return 0, min(target, s)
    if p <= threshold:
        return p, min(target - p, s)
    if p > 200:
        half = target // 2
        a, b = min(half, p), min(half, s)
        if a + b < target:
            if a < half:
                a += min(target - a - b, p - a)
            else:
                b += min(target - a - b, s - b)
        return a, b
    a = min(int(target * 0.7), p)
    b = min(target - a, s)
    if a + b < target and p > a:
        a += min(target - a - b, p - a)
    return a, b


@pytest.mark.parametrize("target", [250, 500, 251, 100])
def test_sampling_plan_over_all_rules(spark, target):
    pairs = [(10, 100), (0, 400), (50, 400), (51, 400), (200, 400), (201, 400), (240, 20), (190, 70), (300, 600), (0, 0)]
    pairs += [(random.Random(i).randrange(0, 600), random.Random(-i).randrange(0, 600)) for i in range(200)]
    stats = spark.createDataFrame([(i, p, s, p + s) for i, (p, s) in enumerate(pairs)], "specialty int, paraphrased long, synthetic long, total long")
    plan = {r.specialty: r for r in sampling.sampling_plan(stats, target).collect()}
    for i, (p, s) in enumerate(pairs):
        expected = plan_by_hand(p, s, target, 50)
        assert (plan[i].sampled_paraphrased, plan[i].sampled_synthetic) == expected, (p, s)
        assert plan[i].target_met == (sum(expected) == target)
    if target == 250:
        assert (plan[6].sampled_paraphrased, plan[6].sampled_synthetic, plan[6].target_met) == (125, 20, False)


def test_samples_are_exact_and_distinct(spark):
    made = spark.createDataFrame([("hot" if i % 3 else f"s{i % 7}", f"m{i}") for i in range(3000)], "specialty string, query string")
    rephrased = spark.createDataFrame([("hot", f"p{i}") for i in range(240)] + [("s0", "p0")], "specialty string, query string")
    plan, drawn = jobs.sample_queries(made, rephrased)
    counts = {(r.specialty, r.source): (r["count"], r.n) for r in drawn.groupBy("specialty", "source").agg(F.count("*").alias("count"), F.countDistinct("query").alias("n")).collect()}
    for r in plan.collect():
        for source, wanted in (("paraphrased", r.sampled_paraphrased), ("synthetic", r.sampled_synthetic)):
            assert counts.get((r.specialty, source), (0, 0)) == (wanted, wanted)


TRIPLETS = "specialty string, anchor string, positives string, negatives string"


def test_split_preparation_order(spark):
    rows = [("s", "a", "p", "n"), ("s", "a", "p", "n"), (None, "b", "p", "n"), ("s", None, "p", "n"), ("t", "c", "p", None)]
    df = spark.createDataFrame(rows, TRIPLETS)
    strict = {tuple(r) for r in sampling.prepare_split(df).collect()}
    loose = {tuple(r) for r in sampling.prepare_split(df, strict=False).collect()}
    assert strict == {("a", "p", "n")} and loose == {("a", "p", "n"), ("b", "p", "n")}
    # Sampling comes first, so a drawn row with a null is lost and not replaced.
    many = spark.createDataFrame([("s", f"a{i}", "p", None if i % 2 else "n") for i in range(40)], TRIPLETS)
    assert sampling.prepare_split(many, 10).count() < 10
    splits = sampling.prepare_splits(df, many, df)
    assert splits["train"].count() == 1 and splits["eval"].count() == sampling.prepare_split(many, 10).count()
    report = {r.split: (r.rows, r.removed_nulls, r.final_rows) for r in sampling.split_report({"x": df, "y": many}).collect()}
    assert report == {"x": (5, 2, 2), "y": (40, 20, 20)}


def test_instruction_takes_the_query_column(spark):
    df = spark.createDataFrame([("s", "q", "p", "n")], "specialty string, query string, positives string, negatives string")
    assert sampling.prepare_split(df, instruction=True).first().anchor.endswith("field of s, retrieve the relevant ICD description\nQuery: q")


def test_length_batches(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 9), "w", None) for i in range(103)]
    df = spark.createDataFrame(rows, "id int, anchor string, positives string, negatives string").repartition(5)
    seen = []
    monkeypatch.setattr(running, "materialise", lambda frame: seen.append(frame.columns) or session.materialise(frame))
    got = sorted(sampling.length_batches(df, 10, ["id"]).collect(), key=lambda r: (r.batch, r.place))
    assert seen and not any("anchor" in columns for columns in seen)
    assert [r.batch for r in got] == [i // 10 for i in range(103)]
    assert all(r.batch == r.id // 10 for r in got)
    assert all(a.length <= b.length for a, b in zip(got, got[1:]) if a.batch == b.batch)


@pytest.mark.parametrize("partitions", [1, 7])
def test_running_sums_with_a_hot_group(spark, partitions):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", i, rng.randrange(-5, 9)) for i in range(2000)]
    rows += [(None, 5000 + i, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, o int, x long").repartition(9)
    got = {(r.g, r.o): (r.total, r.n) for r in running.running_sums(df, ["g"], [F.desc("o")], {"total": F.col("x"), "n": F.lit(1)}, partitions).collect()}
    seen = {}
    for g, o, x in sorted(rows, key=lambda r: -r[1]):
        total, n = seen.get(g, (0, 0))
        seen[g] = (total + x, n + 1)
        assert got[(g, o)] == seen[g]
    assert len(got) == len(rows)
    numbered = running.row_numbers(df, [F.asc("o")], "place", partitions=partitions).orderBy("o").collect()
    assert [r.place for r in numbered] == list(range(1, len(rows) + 1))


def test_exact_percentiles(spark):
    rng = np.random.default_rng(4)
    values = {"a": rng.integers(0, 20, 501), "b": rng.normal(size=37), "c": np.array([3.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs]
    got = {r.g: r for r in running.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0, 0.5, 0.9, 0.99, 1]).collect()}
    for g, vs in values.items():
        for i, p in enumerate((0, 50, 90, 99, 100)):
            assert got[g][f"q{i}"] == pytest.approx(np.percentile(vs, p))


RUNS = "implementation string, optimization string, params string, batch_size int, latency_ms double"


def test_latency_report(spark):
    rng = np.random.default_rng(5)
    rows, by_key = [], {}
    for implementation, optimization, params in (("baseline", "none", ""), ("optimized", "fp16", "a"), ("optimized", "fp16", "b"), ("optimized", "onnx", "")):
        for size in (1, 8):
            values = rng.gamma(3, size, 50)
            by_key[(implementation, optimization, params, size)] = values
            rows += [(implementation, optimization, params, size, float(v)) for v in values]
    out = jobs.latency_report(spark.createDataFrame(rows, RUNS))
    for r in out["stats"].collect():
        v = by_key[(r.implementation, r.optimization, r.params, r.batch_size)]
        assert r.mean_ms == pytest.approx(v.mean(), abs=1e-6) and r.std_ms == pytest.approx(v.std(), abs=1e-6)
        assert [r.p50_ms, r.p90_ms, r.p95_ms, r.p99_ms] == pytest.approx(np.percentile(v, [50, 90, 95, 99]).tolist(), abs=1e-6)
        assert r.throughput_qps == pytest.approx(r.batch_size * 1000 / r.mean_ms, abs=1e-6)
    bins = {}
    for r in out["histogram"].collect():
        bins.setdefault((r.implementation, r.optimization, r.params, r.batch_size), {})[r.bin] = r.n
    for key, v in by_key.items():
        assert [bins[key][b] for b in range(30)] == np.histogram(v, 30)[0].tolist()
    comparison = {r.batch_size: r.mean_speedup for r in out["comparison"].collect()}
    for size in (1, 8):
        expected = by_key[("baseline", "none", "", size)].mean() / by_key[("optimized", "fp16", "a", size)].mean()
        assert comparison[size] == pytest.approx(expected, abs=1e-5)
    assert out["techniques"].count() == 6 and out["recommendation"].count() == 3 and out["best"].count() == 2
    assert out["improvement"].first().avg_mean_improvement == pytest.approx(np.mean(list(comparison.values())), abs=1e-6)


def test_equal_latencies_fill_the_middle_bin(spark):
    df = spark.createDataFrame([("a", "b", "c", 1, 5.0)] * 4, RUNS)
    got = {r.bin: r.n for r in latency.latency_histogram(df).collect()}
    assert [got[b] for b in range(30)] == np.histogram([5.0] * 4, 30)[0].tolist()


def test_call_rate_is_strict_and_counts_ties(spark):
    rng = random.Random(6)
    rows = [("hot", rng.randrange(0, 500)) for _ in range(300)] + [("b", 0), ("b", 10), ("b", 10), ("b", 20)]
    df = spark.createDataFrame(rows, "caller string, t long").select("caller", F.timestamp_micros("t").alias("ts"))
    got = {(r.caller, r.at): r for r in latency.call_rate_audit(df, 2, 10).withColumn("at", F.unix_micros("ts")).collect()}
    assert len(got) == len(set(rows))
    for caller, t in set(rows):
        inside = [o for c, o in rows if c == caller and 0 <= t - o < 10]
        r = got[(caller, t)]
        assert (r.calls, r.calls_in_period, r.over_capacity) == (rows.count((caller, t)), len(inside), len(inside) > 2)
        assert r.wait_us == (min(inside) + 10 - t if len(inside) > 2 else 0)


def test_labels_out_of_a_vocabulary(spark):
    from codescout.operators import labels
    from test_text import closest_by_hand

    names = ["general practice", "Sports Medicine physician", "medicine physician", "oral surgery", "surgery", "ab"]
    rows = ["Sports", "physician of medicine", "ORAL SURGERY clinic", "nothing here", "physician", "practice general", "", "surgery", "b", "xabx", "surgery"]
    vocabulary = spark.createDataFrame(list(enumerate(names)), "ord int, label string")
    asked = spark.createDataFrame([(r,) for r in [*rows, None]], "predicted string")
    got = {r.predicted: r.closest for r in labels.closest_labels(asked, vocabulary).collect()}
    assert got == {**{r: closest_by_hand(r, names) for r in rows}, None: None}
    valid = sorted(str((r.predicted, r.valid)) for r in labels.validated_labels(asked, vocabulary).collect())
    wanted = [(r, r if r in names else closest_by_hand(r, names)) for r in rows] + [(None, names[0])]
    assert valid == sorted(map(str, wanted))
    none = vocabulary.limit(0)
    assert {r.valid for r in labels.validated_labels(asked, none).collect()} == {"general_practice"}
    replies = spark.createDataFrame([(1, "ab, surgery, x, ab"), (2, None), (3, "x"), (4, "surgery,ab")], "id int, reply string")
    found = {r.id: (r.labels, r.complete) for r in labels.top_labels(replies, vocabulary, "id").collect()}
    assert found == {1: (["ab", "surgery", "ab"], True), 2: ([], False), 3: ([], False), 4: (["surgery", "ab"], False)}


def test_a_word_that_all_labels_have_lists_no_pairs(spark, monkeypatch):
    from codescout.operators import labels
    from test_text import closest_by_hand

    names = [f"common of label{i} kind{i % 40}" for i in range(400)] + ["common", "of common"]
    rows = [f"common zz{i}" for i in range(50)] + [f"kind{i} of common w{i}" for i in range(50)] + [f"common kind{i} label{i}" for i in range(50)]
    vocabulary = spark.createDataFrame(list(enumerate(names, 5)), "ord int, label string")
    asked = spark.createDataFrame([(r,) for r in rows], "predicted string")
    sizes = []
    for name in ("word_candidates", "containing"):
        whole = getattr(labels, name)

        def counted(*a, whole=whole):
            found = whole(*a)
            sizes.append(found.count())
            return found

        monkeypatch.setattr(labels, name, counted)
    got = {r.predicted: r.closest for r in labels.closest_labels(asked, vocabulary).collect()}
    assert got == {r: closest_by_hand(r, names) for r in rows}
    # 150 predictions and 402 labels have 60,300 pairs, all with a word in common.
    assert len(sizes) == 4 and sum(sizes) < 60 * len(rows)


@pytest.mark.parametrize("part_rows", [1 << 17, 8000])
def test_first_rows_of_large_groups(spark, part_rows):
    rows = spark.range(60_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.lit(None)).alias("g"), (F.col("id") * 7919 % 60_000).alias("x"))
    got = running.first_per_group(rows, ["g"], [F.col("x").asc()], 1500, "place", part_rows).collect()
    hot = sorted(i * 7919 % 60_000 for i in range(60_000) if i % 10)[:1500]
    other = sorted(i * 7919 % 60_000 for i in range(0, 60_000, 10))[:1500]
    assert sorted((r.x, r.place) for r in got if r.g) == list(zip(hot, range(1, 1501)))
    assert sorted((r.x, r.place) for r in got if not r.g) == list(zip(other, range(1, 1501)))


def test_large_samples_order_little_more_than_they_keep(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 20 > 0, "hot").otherwise("small").alias("specialty"), F.col("id").alias("query"))
    drawn = rows.withColumn("_draw", F.md5(F.concat(F.lit("42|"), F.col("query").cast("string"))))
    left = sampling._below_cut(drawn, ["specialty"], 5000).groupBy("specialty").count().collect()
    assert {r.specialty for r in left} == {"hot", "small"} and all(r["count"] <= 5000 + 400 for r in left)
    got = sampling.sample_per_group(rows, 5000).collect()
    for name, size in (("hot", 5000), ("small", 2000)):
        members = [i for i in range(40_000) if (i % 20 > 0) == (name == "hot")]
        members.sort(key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
        assert {r["query"] for r in got if r.specialty == name} == set(members[:size])


def test_a_scope_leaves_nothing_behind(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    rows = spark.range(100).select(F.col("id").alias("query"), F.lit("s").alias("specialty"))
    with session.scratch_scope(spark) as folder:
        numbered = running.row_numbers(rows, [F.desc("query")], "place")
        path = session.scratch_path(spark, "numbers")
        numbered.write.parquet(path)
        assert spark.read.parquet(path).count() == 100
        place = Path(urlparse(folder).path)
        assert len([p for p in place.rglob("*") if p.is_file()]) > 2
    assert not place.exists()
    with pytest.raises(ValueError, match="broken"):
        with session.scratch_scope(spark) as folder:
            session.materialise(rows)
            raise ValueError("broken")
    assert not Path(urlparse(folder).path).exists()
    assert running.row_numbers(rows, [F.asc("query")], "place").count() == 100


def test_large_groups_stay_where_they_are_when_sampled(spark):
    rows = spark.range(40000).selectExpr("if(id % 10 < 8, 'hot', if(id % 10 = 8, 'b', null)) AS specialty", "id AS query").repartition(4)
    kept = sampling.sample_per_group(rows, 1500)
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert {r.specialty: r["count"] for r in kept.groupBy("specialty").count().collect()} == {"hot": 1500, "b": 1500, None: 1500}


def test_first_sight_is_found_without_a_sort(spark):
    rows = [
        ("q", "S", "C", ["a", "b"], 5), ("q", "S", "C", ["b", "a"], 5), ("r", "S", "C", ["b"], -(1 << 63)), ("r", "S", "C", ["b"], (1 << 63) - 1),
        ("n", "T", "C", ["x", "y"], None), ("n", "T", "C", ["y"], -3), ("", "T", "C", ["z"], -3), ("m", "T", "C", ["w"], (1 << 63) - 1),
    ]
    schema = "query string, nucc_spec string, nucc_class string, related_icd10cm array<string>, ord {}"
    frame = spark.createDataFrame(rows, schema.format("long"))
    found = labels.group_queries_by_specialty(frame, "ord")
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.schema["first_seen"].dataType.simpleString() == "bigint" and found.schema["first_position"].dataType.simpleString() == "int"
    got = {(r.keyed_specialty, r.kind, r.item): (r.first_seen, r.first_position) for r in found.collect()}
    c, d = "c_s", "c_t"
    assert got == {
        (c, "query", "q"): (5, 0), (c, "query", "r"): (-(1 << 63), 0), (c, "code", "a"): (5, 0), (c, "code", "b"): (-(1 << 63), 0),
        (d, "query", "n"): (None, 0), (d, "query", "m"): ((1 << 63) - 1, 0), (d, "code", "x"): (None, 0), (d, "code", "y"): (None, 1),
        (d, "code", "z"): (-3, 0), (d, "code", "w"): ((1 << 63) - 1, 0),
    }
