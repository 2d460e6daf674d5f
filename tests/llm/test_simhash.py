import random
import re

import numpy as np
import pytest
import xxhash

from codescout.llm import simhash
from codescout.llm.components import components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, distance=4):
    prints = np.array([brute_print(t) for _, t in rows], np.uint64)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= distance):
            root[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), f"{int(prints[i]):016x}", str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("blocks", [2, 3, 5])
def test_anchors_cover(blocks):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 2**63, 500, dtype=np.int64).view(np.uint64)
    near = 4 // blocks
    for code in simhash.covering(4, blocks):
        anchors, there = code.anchors(x)
        assert there[:, 0].all()
        # The home is within 1, and a value that differs in ``near`` bits of the block visits it.
        value = (x >> np.uint64(code.low)).astype(np.int64) & ((1 << code.bits) - 1)
        assert (np.bitwise_count(anchors[:, 0] ^ value) <= 1).all()
        flips = sum(1 << int(b) for b in draw.choice(code.bits, near, replace=False)) << code.low
        others, visits = code.anchors(x ^ np.uint64(flips))
        assert ((others == anchors[:, :1]) & visits).any(1).all()


@pytest.mark.parametrize(("cell", "at_once"), [(8192, 1024), (16, 4), (16, 1 << 30)])
def test_links_connect_all_that_are_close(spark, cell, at_once, monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    draw = random.Random(4)
    values = [draw.getrandbits(64) for _ in range(60)]
    for centre in values[:10]:  # dense groups, and chains away from them
        for _ in range(12):
            centre ^= sum(1 << b for b in draw.sample(range(64), draw.randint(1, 5)))
            values.append(centre)
    values = list(dict.fromkeys(values))
    prints = np.array(values, np.uint64)
    frame = spark.createDataFrame([(int(v),) for v in prints.view(np.int64)], "print long")
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in simhash.links(frame, cell=cell).collect():
        a, b = (int(np.int64(x).view(np.uint64)) for x in (a, b))
        assert 0 < (a ^ b).bit_count() <= 4
        root[find(a)] = find(b)
    want = {v: v for v in values}
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4):
            old, new = want[values[int(j)]], want[v]
            want = {x: new if y == old else y for x, y in want.items()}
    got = [find(v) for v in values]
    assert [got.index(x) for x in got] == [list(want.values()).index(x) for x in want.values()]


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(500, 1000 + i) for i in range(50)] + [(7, 7), (2000, 2000)]
    frame = spark.createDataFrame(links, "a long, b long")
    roots = {r.node: r.root for r in components(frame).collect()}
    assert roots == {**{i: 0 for i in range(41)}, 500: 500, **{1000 + i: 500 for i in range(50)}}
    assert components(frame.filter("a = b")).count() == 0


def test_components_of_few_links_start_few_tasks(spark):
    """The driver keeps a record of every task, so a small graph must not start one per shuffle partition in each round."""
    draw = random.Random(12)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(50)] + [(1000 + i, 1001 + i) for i in range(12)]
    frame = spark.createDataFrame(links, "a long, b long")
    root = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for a, b in links:
        if a != b and root[a] != root[b]:
            gone, left = root[a], root[b]
            root = {x: left if r == gone else r for x, r in root.items()}
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    for limits in ({}, {"rows": 20}):
        group = f"components-{limits}"
        sc.setJobGroup(group, "")
        try:
            for n, v in names.items():
                spark.conf.set(n, v)
            got = {r.node: r.root for r in components(frame, **limits).collect()}
        finally:
            for n, v in before.items():
                spark.conf.set(n, v)
            sc.setLocalProperty("spark.jobGroup.id", None)
        assert {(x, y) for x in got for y in got if got[x] == got[y]} == {(x, y) for x in root for y in root if root[x] == root[y]}
        stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
        tasks = sum(info.numTasks for s in stages if (info := tracker.getStageInfo(s)))
        # Only the first distinct takes a task for each partition; one round in all of them has several hundred.
        assert tasks > 0 and (limits or tasks < 200)


def test_documents(spark, awkward, no_rows):
    base = awkward.filter("doc_id = 5").first().text.split()
    draw = random.Random(9)
    near = []
    for i in range(40):
        words = list(base)
        words[draw.randrange(len(words))] = f"zz{i}"
        near.append((20_000 + i, " ".join(words), None, None, None, "extra"))
    rows = [(r.doc_id, r.text) for r in awkward.collect()] + [r[:2] for r in near]
    frame = awkward.unionByName(spark.createDataFrame(near, awkward.schema)).repartition(5)
    want = brute_groups(rows)
    got = simhash.groups(frame).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    kept = simhash.keep_one(frame)
    ids = [str(r.doc_id) for r in kept.collect()]
    assert sorted(ids) == sorted({c for _, _, c in want})
    assert kept.columns == awkward.columns
    assert simhash.keep_one(no_rows).count() == 0


def test_a_group_without_ids_keeps_one(spark):
    frame = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (None, "x"), (1, "y y y")], "doc_id long, text string")
    assert sorted(str((r.doc_id, r.text)) for r in simhash.keep_one(frame).collect()) == [
        "(1, 'y y y')",
        "(None, 'a b c d e')",
        "(None, 'x')",
    ]
