"""Readers, writers and streams on small files."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codescout.session import scratch_path, shared_dir
from codescout.sources import files
from codescout.streaming import jobs as streams


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_specialty_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"cardio": ["x", "y"], "ignored": ["z"]}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"derma": ["r"]}))
    (tmp_path / "c.json").write_text(json.dumps({"cardio": ["w", "é\n"]}))
    got = files.read_specialty_queries(spark, str(tmp_path), multi_line=True)
    assert pairs(got, "specialty", "query") == [("cardio", "w"), ("cardio", "é\n"), ("derma", "r")]
    everything = files.read_query_map(spark, str(tmp_path / "a.json"), multi_line=True)
    assert pairs(everything, "specialty", "query") == [("cardio", "x"), ("cardio", "y"), ("ignored", "z")]


def test_code_reference_rules(spark, tmp_path):
    header = "idx," + ",".join(f"c{i}" for i in range(13)) + ",CODE,Text,last"
    rows = [("A", "x"), ("A", "y"), ("A", "x"), ("B", '"has, comma\nand line"'), ("C", "NA"), ("", "none")]
    lines = [f"{i}," + "," * 12 + f",{c},{d},z" for i, (c, d) in enumerate(rows)]
    path = tmp_path / "icd.csv"
    path.write_text("\n".join([header, *lines]) + "\n")
    got = files.read_code_reference(spark, str(path))
    # The repeated pair (A, x) is dropped first, so the last remaining pair of A is (A, y).
    assert pairs(got, "code") == [("A",), ("B",), ("C",)]
    assert {r.code: r.description for r in got.collect()} == {"A": "y", "B": "has, comma\nand line", "C": None}


def test_triplet_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        'i,specialty,anchor,positives,negatives\n0,s,"a ""quoted""",p,n\n1,s,NA,p,n\n2,,b,None,n\n'
        '3,s,"multi\nline",p,n\n4,s,"a ""quoted""",p,n\n5,nan,c,p,n/a\n'
    )
    rows = files.read_triplets(spark, str(path)).collect()
    assert [r.anchor for r in rows] == ['a "quoted"', None, "b", "multi\nline", 'a "quoted"', "c"]
    assert [r.specialty for r in rows] == ["s", "s", None, "s", "s", None]
    assert files.read_triplets(spark, str(path), ["anchor", "negatives"]).columns == ["anchor", "negatives"]
    assert files.read_triplets_limited(spark, str(path), 10).count() == 2
    assert files.read_triplets_limited(spark, str(path), 1).count() == 1


def test_keywords_and_lines(spark, tmp_path):
    (tmp_path / "k.csv").write_text("Keywords\nheart attack\nflu\n")
    (tmp_path / "k.json").write_text(json.dumps(["long term care", "x"]))
    got = files.read_keywords(spark, str(tmp_path / "k.csv"), str(tmp_path / "k.json"))
    assert pairs(got, "final_keywords", "sequence_length") == [("flu", 1), ("heart attack", 2), ("long term care", 3), ("x", 1)]
    (tmp_path / "q.txt").write_text("  a b \n\n\t\nc\n")
    assert pairs(files.read_lines(spark, str(tmp_path / "q.txt")), "query") == [("a b",), ("c",)]
    assert pairs(files.read_lines(spark, str(tmp_path / "k.json")), "query") == [("long term care",), ("x",)]


def test_later_maps_win(spark, tmp_path):
    one, two = tmp_path / "1.json", tmp_path / "2.json"
    one.write_text(json.dumps({"s": {"q": ["A"], "r": ["B"]}, "t": {"q": []}}))
    two.write_text(json.dumps({"s": {"q": ["C"]}}))
    got = {(r.specialty, r.query): r.codes for r in files.merge_specialty_maps(spark, [str(one), str(two)]).collect()}
    assert got == {("s", "q"): ["C"], ("s", "r"): ["B"], ("t", "q"): []}


@pytest.mark.parametrize("compression", ["zstd", "gzip", "none"])
def test_embeddings_round_trip(spark, tmp_path, compression):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.5])], "key string, embedding array<float>")
    files.save_embeddings(df, str(tmp_path / "e"), compression)
    assert pairs(files.load_embeddings(spark, str(tmp_path / "e")), "key", "embedding") == [("a", [1.0, 2.0]), ("b", [3.0, 4.5])]


def test_embeddings_errors(spark, tmp_path):
    with pytest.raises(Exception):
        files.load_embeddings(spark, str(tmp_path / "missing"))
    odd = spark.createDataFrame([("a", [1.0]), ("b", [3.0, 4.5])], "key string, embedding array<float>")
    files.save_embeddings(odd, str(tmp_path / "odd"))
    with pytest.raises(ValueError, match="dimension"):
        files.load_embeddings(spark, str(tmp_path / "odd"))


def test_results_of_one_specialty_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "results")
    schema = "specialty string, query string, codes array<string>"
    files.write_per_specialty(spark.createDataFrame([("a/b", "1", ["X"]), ("c", "2", [])], schema), path)
    files.write_per_specialty(spark.createDataFrame([("c", "3", ["Y"])], schema), path)
    got = {(r.specialty, r.query): r.codes for r in files.combine_results(spark, path).collect()}
    assert got == {("a_b", "1"): ["X"], ("c", "3"): ["Y"]}


def test_json_safe(spark):
    df = spark.sql(
        """SELECT 1 AS i, CAST(1.50 AS DECIMAL(5,2)) AS d, array(DATE'2024-01-02') AS days,
           map(1, X'41') AS m, named_struct('t', TIMESTAMP_NTZ'2024-01-01 10:00:00', 'ok', 'x') AS s,
           CAST(NULL AS STRUCT<t: DATE>) AS n"""
    )
    row = files.json_safe(df).first()
    assert (row.i, row.d, row.days, row.m) == (1, "1.50", ["2024-01-02"], {"1": "A"})
    assert (row.s.t, row.s.ok, row.n) == ("2024-01-01 10:00:00", "x", None)
    assert pairs(files.json_unsafe_columns(df), "column", "type") == [
        ("d", "decimal(5,2)"), ("days", "array<date>"), ("m", "map<int,binary>"), ("n", "struct<t:date>"),
        ("s", "struct<t:timestamp_ntz,ok:string>"),
    ]


def test_intake_takes_each_query_once(spark, tmp_path):
    source, queue, state = (str(tmp_path / n) for n in ("in", "queue", "state"))
    schema = "specialty string, query string"
    spark.createDataFrame([("a/b", "1"), ("a/b", "1"), ("c", "2")], schema).write.json(source)
    streams.incremental_labelling_intake(spark, source, queue, state).awaitTermination()
    spark.createDataFrame([("c", "2"), ("c", "3")], schema).write.mode("append").json(source)
    for _ in range(2):
        streams.incremental_labelling_intake(spark, source, queue, state).awaitTermination()
    got = streams.read_queue(spark, queue)
    assert pairs(got, "specialty", "query", "status", "attempts") == [("a_b", "1", "pending", 0), ("c", "2", "pending", 0), ("c", "3", "pending", 0)]


def test_intake_keeps_no_state_and_repeats_a_batch(spark, tmp_path):
    source, queue, state = (str(tmp_path / n) for n in ("in", "queue", "state"))
    schema = "specialty string, query string"
    for number in range(3):
        spark.createDataFrame([("a", None), ("a", str(number)), ("b", str(number % 2))], schema).write.mode("append").json(source)
        query = streams.incremental_labelling_intake(spark, source, queue, state)
        query.awaitTermination()
        assert not query.lastProgress.stateOperators
    before = sorted(str((r.specialty, r["query"])) for r in streams.read_queue(spark, queue).collect())
    assert before == sorted(map(str, [("a", None), ("a", "0"), ("a", "1"), ("a", "2"), ("b", "0"), ("b", "1")]))
    # A batch whose commit was lost is run again.
    (Path(state) / "commits" / "2").unlink()
    (Path(state) / "commits" / ".2.crc").unlink(missing_ok=True)
    streams.incremental_labelling_intake(spark, source, queue, state).awaitTermination()
    assert sorted(str((r.specialty, r["query"])) for r in streams.read_queue(spark, queue).collect()) == before


def test_closed_windows_leave_the_state(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "caller string, s long"

    def arrive(rows):
        spark.createDataFrame(rows, schema).select("caller", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("caller string, ts timestamp").parquet(source)
        query = streams.write_call_rates(streams.streaming_call_rate(stream, "60 seconds", "60 seconds", "60 seconds"), target, state)
        query.awaitTermination()
        got = spark.read.schema("caller string, window_start timestamp, calls long").parquet(target)
        written = sorted((r.caller, r.start, r.calls) for r in got.select("caller", F.unix_seconds("window_start").alias("start"), "calls").collect())
        return written, [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators][-1]

    written, open_windows = arrive([("a", i) for i in range(0, 600, 10)])
    assert written == [("a", start, 6) for start in range(0, 480, 60)] and open_windows == 2
    # Late calls for closed windows are dropped; one for an open window counts.
    written, open_windows = arrive([("a", 5), ("b", 100), ("a", 545), ("a", 1000)])
    assert ("a", 0, 6) in written and not [r for r in written if r[0] == "b"]
    assert ("a", 540, 7) in written and open_windows == 1


def test_progress_follows_new_items(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "report", "state"))
    schema = "specialty string, query string, status string"
    for rows in ([("a", "1", "completed"), ("b", "2", "pending")], [("a", "3", "pending")]):
        spark.createDataFrame(rows, schema).write.mode("append").json(source)
        items = spark.readStream.schema(schema).json(source)
        streams.streaming_progress(items, target, state).awaitTermination()
    got = spark.read.parquet(target)
    assert pairs(got, "specialty", "total", "completed", "status") == [("a", 2, 1, "in_progress"), ("b", 1, 0, "in_progress")]


def test_call_rate_on_a_table(spark):
    calls = spark.createDataFrame([("a", 5), ("a", 12), ("b", 65)], "caller string, s long").select("caller", F.timestamp_seconds("s").alias("ts"))
    got = streams.streaming_call_rate(calls).groupBy("caller").agg(F.max("calls").alias("most"), F.count("*").alias("windows"))
    assert pairs(got, "caller", "most", "windows") == [("a", 2, 7), ("b", 1, 6)]


def test_scratch_lies_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
