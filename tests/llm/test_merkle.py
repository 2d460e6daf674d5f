"""Proofs against a tree built row by row."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from codescout.llm import entry, merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, at):
    """(left, right) of each level."""
    out = []
    for level in tree[:-1]:
        first = at - at % 3
        out.append((level[first:at], level[at + 1 : first + 3]))
        at //= 3
    return out


def brute(rows, tampered):
    """Rows as tuples of COLUMNS; the expected result, sorted."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        ordered = sorted(((r[0] is not None, r[0] or 0, leaf_of(r), r) for r in by_source[name]), key=lambda x: x[:3])
        trees[name] = ([x[3] for x in ordered], levels([x[2] for x in ordered]))
    top = levels([trees[name][1][-1][0] for name in names])
    out = []
    for number, name in enumerate(names):
        ordered, tree = trees[name]
        for at, row in enumerate(ordered):
            steps = siblings(tree, at) + siblings(top, number)
            folded = leaf_of(tampered(row))
            for left, right in steps:
                folded = sha("".join([*left, folded, *right]))
            proof = sha("".join(x for left, right in steps for x in [*left, *right]))
            out.append((row[0], tree[0][at], tree[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def without_breaks(row):
    even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
    return (*row[:4], row[4].replace("\n", "") if even and row[4] is not None else row[4])


def found():
    even = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    return {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


@pytest.mark.parametrize("digits", [1, 2, merkle.DIGITS])
def test_awkward_rows(spark, awkward, digits):
    rows = [tuple(r[c] for c in COLUMNS) for r in awkward.collect()]
    clashing = awkward.withColumn("hash", F.lit(1)).withColumn("_number", F.lit("x")).withColumn("kids", F.lit(None))
    got = merkle.manifest(clashing, found=found(), digits=digits)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, without_breaks)


def test_every_size_of_a_source(spark):
    rows = [(i, f"s{n}", None, None, "a\nb") for n in range(1, 30) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    for digits in (1, 2):
        got = merkle.manifest(frame, found=found(), digits=digits).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, without_breaks)
        assert {r.verified for r in got} == {True, False}


def test_untouched_rows_are_verified(spark, awkward, no_rows):
    assert merkle.manifest(awkward).filter("verified").count() == awkward.count()
    assert merkle.manifest(no_rows).count() == 0
    lone = merkle.manifest(awkward.filter("doc_id = 9000")).collect()
    assert lone[0].leaf == lone[0].subroot == lone[0].root and lone[0].proof_sha256 == sha("")


def test_plan_has_no_join_and_no_broadcast(spark, awkward):
    plan = merkle.manifest(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_query(spark):
    got = entry.op11_merkle_manifest(spark, "/root/testdata/sf0.001")
    rows = [tuple(r[c] for c in COLUMNS) for r in entry.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, without_breaks)
