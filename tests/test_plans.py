"""Physical plans: groups limited before the shuffle, filters and columns pushed down."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from codescout.operators import sampling  # noqa: E402
from codescout.plans import catalog  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_samples_are_limited_before_the_shuffle(spark):
    rows = catalog.table(spark, FOLDER, "documents").selectExpr("source AS specialty", "doc_id AS query")
    text = plan(sampling.sample_per_group(rows, 5))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_scans_read_only_what_is_used(spark):
    text = plan(entry.queries()["word_counts"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    labels = catalog.label_lines(spark, FOLDER).filter("line <= 4")
    text = plan(labels)
    assert "LessThanOrEqual(l_linenumber,4)" in text and "l_extendedprice" not in text


def test_large_code_tables_are_not_broadcast(spark):
    from codescout.operators.retrieval import top_k_codes

    queries, codes = catalog.vectors(spark, FOLDER), catalog.code_vectors(spark, FOLDER)
    assert "BroadcastHashJoin" in plan(top_k_codes(queries, codes))
    hinted = top_k_codes(queries, codes, block_bytes=4096, broadcast_bytes=0)
    assert "ResolvedHint" not in hinted._jdf.queryExecution().analyzed().toString()
