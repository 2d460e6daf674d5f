"""Nearest neighbours by learned partitions.

On a bounded sample the graph of nearest neighbours is cut into parts of equal size with few neighbours apart, and a small network
learns to tell from a vector in which part its neighbours lie. Every row is put into its likeliest part. A query goes to the
likeliest parts, as many as the held-out quarter of the sample needs for the wanted recall, and there it is compared with all rows;
distances are computed in double precision on the original vectors. Parts are cut into cells, so a part (or a vector) that has
most of the rows is shared out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescout.llm.common import ready
from codescout.session import materialise

#: Rows that the partition is learned on, neighbours in its graph, parts, and recall on held-out rows that decides how many are tried.
SAMPLE, NEIGHBOURS, PARTS, RECALL = 4096, 10, 16, 0.97
#: Rows of a part that one cell holds, and queries that are compared at a time.
CELL, QUERIES = 16_384, 256
HIDDEN, EPOCHS, RATE, BATCH = 128, 40, 2e-3, 128


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(base: np.ndarray, queries: np.ndarray, k: int, same: bool = False) -> np.ndarray:
    """Places in ``base`` of the k nearest to each query; with ``same`` the queries are the base, and a row isn't its own neighbour."""
    out = []
    for at in range(0, len(queries), 512):
        part = queries[at : at + 512]
        far = (base**2).sum(1)[None, :] - 2 * part @ base.T
        if same:
            far[np.arange(len(part)), at + np.arange(len(part))] = np.inf
        k = min(k, far.shape[1])
        out.append(np.argpartition(far, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for every vertex of the graph: parts of equal size, then moves towards neighbours while there is room."""
    n = len(vectors)
    groups = [np.arange(n)]
    while len(groups) < parts:  # halves along the main direction of the largest group
        largest = max(range(len(groups)), key=lambda i: len(groups[i]))
        rows = groups.pop(largest)
        centred = vectors[rows] - vectors[rows].mean(0)
        direction = np.linalg.svd(centred, full_matrices=False)[2][0] if len(rows) > 1 else np.zeros(vectors.shape[1])
        order = rows[np.argsort(centred @ direction, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    part = np.empty(n, np.int64)
    for number, rows in enumerate(groups):
        part[rows] = number
    room = int(np.ceil(1.05 * n / parts))
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        gain = votes.max(1) - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            to = int(votes[i].argmax())
            if size[to] < room:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer that says how likely a vector's neighbours lie in each part."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    tries: int = 1

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        return np.maximum((vectors - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @classmethod
    def fit(cls, vectors: np.ndarray, goal: np.ndarray) -> Router:
        """Cross-entropy against the shares of the parts among a vector's neighbours, by Adam; the same every time."""
        random = np.random.default_rng(7)
        mean, scale = vectors.mean(0), float(vectors.std()) or 1.0
        x = (vectors - mean) / scale
        width = x.shape[1]
        weights = [random.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN)]
        weights += [random.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, goal.shape[1])), np.zeros(goal.shape[1])]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(EPOCHS):
            order = random.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at : at + BATCH]
                hidden = np.maximum(x[rows] @ weights[0] + weights[1], 0)
                out = hidden @ weights[2] + weights[3]
                out = np.exp(out - out.max(1, keepdims=True))
                error = (out / out.sum(1, keepdims=True) - goal[rows]) / len(rows)
                back = (error @ weights[2].T) * (hidden > 0)
                slopes = [x[rows].T @ back, back.sum(0), hidden.T @ error, error.sum(0)]
                step += 1
                for w, g, m, v in zip(weights, slopes, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(mean, scale, *weights)


def learn(sample: np.ndarray, k: int, parts: int = PARTS, recall: float = RECALL) -> Router:
    """The router for a sample of distinct vectors in random order. Every fourth row is held out to find how many parts to try."""
    held = np.arange(len(sample)) % 4 == 3
    base, asked = sample[~held], sample[held]
    parts = max(1, min(parts, len(base) // 8))
    if parts == 1:
        width = sample.shape[1]
        return Router(np.zeros(width), 1.0, np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = nearest(base, base, NEIGHBOURS, same=True)
    part = balanced_parts(base, graph, parts)
    goal = np.zeros((len(base), parts))
    np.add.at(goal, (np.arange(len(base)), part), 1)
    np.add.at(goal, (np.repeat(np.arange(len(base)), graph.shape[1]), part[graph].ravel()), 1)
    router = Router.fit(base, goal / goal.sum(1, keepdims=True))
    lies = router.logits(base).argmax(1)
    near = lies[nearest(base, asked, k)]
    place = np.argsort(np.argsort(-router.logits(asked), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, near, 1).ravel())
    router.tries = int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) + 1
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the k nearest found of ``vectors`` for each row of ``queries``, by Euclidean distance.

    A query's own key is no candidate. Equal distances go to the smaller key. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do rows without key and vectors of another length than most. A query that occurs
    several times has one answer; candidates that occur several times are found as often. A query is sent to more parts if
    those tried have no more than k rows, so that all candidates are returned if there are fewer than k.
    """
    spark = ready(vectors)
    rows = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector)))
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = queries.filter(F.col(key).isNotNull() & usable(F.col(vector)))
    asked = asked.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).distinct()
    lengths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    width = lengths.width
    rows, asked = rows.filter(F.size("vector") == width), asked.filter(F.size("vector") == width)
    # A fixed number of rows, those with the smallest hashes, whatever the size of the table; copies count once.
    drawn = rows.select("vector", F.xxhash64("vector", F.lit("sample")).alias("h")).distinct().orderBy("h").limit(SAMPLE)
    sample = np.array([r.vector for r in drawn.select("vector").collect()])
    model = spark.sparkContext.broadcast(learn(sample, k))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = model.value.logits(_matrix(batch.column(1))).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], ["id", "vector", "part"])

    indexed = materialise(rows.mapInArrow(assign, "id long, vector array<double>, part int"))
    # One row per part.
    sizes = {r.part: r.n for r in indexed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    held = np.array([sizes.get(p, 0) for p in range(len(model.value.b2))])
    cells = np.maximum(1, -(-held // CELL))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-model.value.logits(_matrix(batch.column(1))), axis=1, kind="stable")
            enough = (np.cumsum(held[order], axis=1) <= k).sum(1) + 1
            tried = np.arange(order.shape[1])[None, :] < np.maximum(model.value.tries, enough)[:, None]
            row, place = np.nonzero(tried & (held[order] > 0))
            part = order[row, place]
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(part.astype(np.int32))], ["id", "vector", "part"])

    routed = asked.mapInArrow(route, "id long, vector array<double>, part int")
    per_part = F.element_at(F.array(*[F.lit(int(c)) for c in cells]), F.col("part") + 1)
    # A row has one cell of its part; a query goes to all of them.
    own = F.pmod(F.xxhash64("id", "vector"), per_part).cast("int")
    dealt = indexed.select("part", own.alias("cell"), F.lit(1).alias("side"), "id", "vector").unionByName(
        routed.select("part", F.explode(F.sequence(F.lit(0), per_part - 1)).alias("cell"), F.lit(2).alias("side"), "id", "vector")
    )
    sorted_cells = dealt.repartition("part", "cell").sortWithinPartitions("part", "cell", "side", "id")
    found = sorted_cells.mapInArrow(lambda batches: _compare(batches, k), "query_id long, query int, vec_id long, score double")
    best = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _compare(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of its cell for each query; the rows of a cell come first and are held, queries are streamed."""
    cell, ids, parts, matrix = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        part, number, side, key = (batch.column(i).to_numpy() for i in range(4))
        vectors = _matrix(batch.column(4))
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (number[1:] != number[:-1]) | (side[1:] != side[:-1])
        starts = np.flatnonzero(new)
        for start, end in zip(starts, [*starts[1:], len(part)]):
            if cell != (part[start], number[start]):
                cell, ids, parts, matrix = (part[start], number[start]), [], [], None
            if side[start] == 1:
                ids.append(key[start:end])
                parts.append(vectors[start:end])
            elif ids:
                if matrix is None:
                    matrix = np.concatenate(parts), np.concatenate(ids)
                for at in range(start, end, QUERIES):
                    stop = min(at + QUERIES, end)
                    yield _nearest_exactly(*matrix, vectors[at:stop], key[at:stop], k)


def _nearest_exactly(base: np.ndarray, ids: np.ndarray, queries: np.ndarray, keys: np.ndarray, k: int) -> pa.RecordBatch:
    squares, own = (base**2).sum(1), (queries**2).sum(1)
    far = own[:, None] + squares[None, :] - 2 * queries @ base.T
    # Products only choose the candidates; the error that they may have is far below this margin.
    margin = 1e-9 * (own + squares.max())
    out: list[list] = [[], [], [], []]
    for i, key in enumerate(keys.tolist()):
        line = np.where(ids == key, np.inf, far[i])
        bound = np.partition(line, k - 1)[k - 1] if len(line) >= k else np.inf
        near = np.flatnonzero((line <= bound + margin[i]) & (ids != key))
        score = np.sqrt(((base[near] - queries[i]) ** 2).sum(1))
        order = np.lexsort((ids[near], score))[:k]
        out[0] += [key] * len(order)
        # Tells queries with one key apart.
        out[1] += [zlib.crc32(queries[i].tobytes()) >> 1] * len(order)
        out[2] += ids[near][order].tolist()
        out[3] += score[order].tolist()
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["query_id", "query", "vec_id", "score"])


def recall(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> float:
    """The share of the true k nearest (by score, so that ties count as found) that ``found`` has; compares everything with everything
    in blocks and is meant for tests."""
    rows = vectors.filter(usable(F.col(vector))).select(key, vector).toPandas()
    asked = queries.filter(usable(F.col(vector))).select(key, vector).toPandas()
    base, ids = np.stack(rows[vector]).astype(np.float64), rows[key].to_numpy()
    worst = {r.query_id: sorted(r.scores) for r in found.groupBy("query_id").agg(F.collect_list("score").alias("scores")).collect()}
    hits = total = 0
    for own, x in zip(asked[key], asked[vector]):
        true = np.sort(np.sqrt(((base[ids != own] - np.asarray(x, np.float64)) ** 2).sum(1)))[:k]
        total += len(true)
        hits += sum(1 for s in worst.get(own, []) if s <= true[-1] + 1e-12)
    return hits / max(total, 1)
