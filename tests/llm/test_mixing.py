import math

import pytest
from pyspark.sql import functions as F

from codescout.llm import mixing


def test_rates_meet_the_weights(spark, awkward):
    rates = {r._source: r for r in mixing.rates(awkward, alpha=0.0, epochs=2.0).collect()}
    total = sum(r._bytes for r in rates.values())
    filled = [r for r in rates.values() if r._bytes]
    for r in filled:
        assert r._rate * r._bytes == pytest.approx(2.0 * total / len(filled))
    named = {r._source: r for r in mixing.rates(awkward, {"src1": 3.0, "src2": 1.0, "none": 5.0}).collect()}
    assert named["src1"]._rate * named["src1"]._bytes == pytest.approx(3 * named["src2"]._rate * named["src2"]._bytes)
    assert named["src3"]._rate == 0 and named[None]._rate == 0
    kept = mixing.rates(awkward, alpha=1.0).filter("_bytes > 0").collect()
    assert all(r._rate == pytest.approx(1.0) for r in kept)


@pytest.mark.parametrize("rate", [0.0, 0.3, 4.0, 75.5])
def test_inverse_is_poisson(spark, rate):
    frame = spark.createDataFrame([("s", 1, rate)], "_source string, _bytes long, _rate double")
    row = mixing._inverse(frame).first()
    mean = rate / row._draws
    assert mean <= mixing.DRAW
    want, p = [], math.exp(-mean)
    for k in range(mixing.TERMS + 1):
        want.append((want[-1] if want else 0) + p)
        p *= mean / (k + 1)
    assert row._below == pytest.approx(want)
    assert 1 - row._below[-1] < 1e-12


def test_copies(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), (F.col("id") % 4 == 0).cast("string").alias("source"))
    mixed = mixing.mix(rows)
    counts = {(r.source, r.copies): r["count"] for r in mixed.filter("copy = 1").groupBy("source", "copies").count().collect()}
    for source, rate, documents in (("true", 2.0, 5_000), ("false", 2 / 3, 15_000)):
        for k in (1, 2, 3):
            want = documents * math.exp(-rate) * rate**k / math.factorial(k)
            assert abs(counts[source, k] - want) < 5 * math.sqrt(want)
    assert mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("m"), F.max("copies").alias("c")).filter("n <> m OR m <> c").count() == 0
    again = mixing.mix(rows.repartition(7))
    assert mixed.exceptAll(again).count() == 0 and again.exceptAll(mixed).count() == 0
    assert mixing.mix(rows, seed="other").exceptAll(mixed).count() > 0


def test_order_is_by_the_shuffle_key_inside_partitions(spark, awkward):
    parts = mixing.mix(awkward, epochs=5.0).withColumn("p", F.spark_partition_id()).collect()
    for p in {r.p for r in parts}:
        keys = [r.shuffle_key for r in parts if r.p == p]
        assert keys == sorted(keys)


def test_awkward_rows(awkward, no_rows):
    mixed = mixing.mix(awkward, alpha=1.0, epochs=20.0)
    assert mixed.columns == [*awkward.columns, "copy", "copies", "shuffle_key"]
    found = {(str(r.doc_id), r.source) for r in mixed.collect()}
    assert {("9000", None), ("9001", "src0"), ("9002", ""), ("None", "rare")} <= found
    replaced = mixing.mix(awkward.withColumnRenamed("token", "copy"))
    assert replaced.columns == [*awkward.columns[:-1], "copy", "copies", "shuffle_key"]
    assert mixing.mix(no_rows).count() == 0 and mixing.mix(awkward, weights={}).count() == 0
