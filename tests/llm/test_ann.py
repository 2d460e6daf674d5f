import numpy as np
import pytest

from codescout.llm import ann, entry


def test_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.01"
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    found = entry.op8_nearest_vectors(spark, folder)
    asked = vectors.filter("vec_id % 100 = 0")
    assert found.groupBy("query_id").count().filter("count <> 10").count() == 0
    assert ann.recall(found, vectors, asked) >= 0.9


def clustered(n, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(40, 16)) * 3
    return (centres[draw.integers(0, 40, n)] + draw.normal(size=(n, 16))).astype(np.float32)


def test_few_parts_suffice_where_there_are_clusters(spark):
    data = clustered(3000)
    assert ann.learn(data.astype(float), 10).tries <= 8
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    asked = frame.filter("vec_id % 100 = 0")
    assert ann.recall(ann.top_k(frame, asked), frame, asked) >= 0.9


def test_parts_are_balanced():
    data = clustered(1000).astype(float)
    graph = ann.nearest(data, data, 10, same=True)
    part = ann.balanced_parts(data, graph, 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1.05 * 125)
    assert (part[graph] == part[:, None]).mean() > 0.5


@pytest.mark.parametrize("cell", [16_384, 7])
def test_awkward_vectors_and_ties(spark, cell, monkeypatch):
    monkeypatch.setattr(ann, "CELL", cell)
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=4).astype(np.float32).tolist(), "x") for i in range(40)]
    rows += [(100 + i, rows[0][1], "x") for i in range(30)]  # copies of a query
    rows += [(200, None, "x"), (201, [0.0] * 4, "x"), (202, [1.0, None, 0.0, 0.0], "x"), (203, [float("nan"), 0.0, 0.0, 1.0], "x")]
    rows += [(300, [float("inf"), 0.0, 0.0, 1.0], "x"), (400, [1.0, 2.0], "x"), (None, [1.0, 1.0, 1.0, 1.0], "x"), (500, rows[1][1], "x"), (500, rows[1][1], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    asked = frame.filter("vec_id % 100 = 0 OR vec_id IN (1, 3)")
    got = {}
    for r in ann.top_k(frame, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and i not in (200, 201, 202, 203, 300, 400)]
    assert set(got) == {0, 1, 3, 100, 500}
    for own, found in got.items():
        mine = next(v for i, v in good if i == own)
        true = sorted((float(np.sqrt(((v - mine) ** 2).sum())), i) for i, v in good if i != own)[:10]
        if own in (0, 100):  # the thirty copies come first, smaller ids before
            assert [i for _, i, _ in found] == [i for _, i in true]
        assert [r for r, _, _ in found] == list(range(1, 11))
        scores = dict((i, v) for i, v in good)
        assert all(s == float(np.sqrt(((scores[i] - mine) ** 2).sum())) for _, i, s in found)


def test_fewer_candidates_than_k(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = ann.top_k(frame, frame.filter("vec_id = 0")).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 2), (2, 1)]
    assert ann.top_k(frame.limit(0), frame).count() == 0 and ann.top_k(frame, frame.limit(0)).count() == 0
