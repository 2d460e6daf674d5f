"""Choosing diverse queries per specialty, and measuring how diverse a choice is.

Specialties whose vectors fit in one task are worked on there, a task per
specialty. Larger ones, whatever their share of the rows, run as iterations over
the whole DataFrame, with the same results.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescout.functions.draws import draw
from codescout.functions.vectors import cosine, l2_normalize, rows_of, unit_rows
from codescout.operators import blocks
from codescout.operators.running import first_per_group, row_numbers, running_sums
from codescout.session import materialise

# Names of the two selection methods in reports.
GREEDY = "Similarity-based"
CLUSTERED = "Cluster-based"

TASK_BYTES = 64 << 20
CUT_EVERY = 8
ROUND_PICKS = 4096
#: Coarse cells of a large specialty, and bins of a histogram of its sums.
CELLS, BINS = 64, 4096


def split_by_size(
    df: DataFrame, group: str, vector: str, task_bytes: int
) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of groups that fit in ``task_bytes`` and rows of larger groups.

    One aggregate finds the largest group and the width of the vectors; a part that
    has no rows comes back as None.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"), F.max(F.size(vector)).alias("_d"))
    extremes = sizes.agg(F.min("_n").alias("low"), F.max("_n").alias("high"), F.max("_d").alias("d")).first()
    limit = task_bytes // (8 * max(1, extremes.d or 1))
    if extremes.high is None or extremes.high <= limit:
        return df, None
    if extremes.low > limit:
        return None, df
    large = sizes.filter(F.col("_n") > limit).select(group)
    return df.join(large, group, "left_anti"), df.join(large, group, "left_semi")


def _both(small: DataFrame | None, large: DataFrame | None) -> DataFrame:
    if small is None:
        return large
    return small if large is None else small.unionByName(large)


def _usable(df: DataFrame, specialty: str, key: str, vector: str) -> DataFrame:
    """Rows with a vector, one for each specialty and key (of several the smallest vector), whatever the size of the group."""
    filled = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()))
    return filled.groupBy(specialty, key).agg(F.min(vector).alias(vector))


def _type(df: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, df.schema[name].dataType)


# --- selection by similarity -------------------------------------------------------------


def diverse_greedy(
    df: DataFrame,
    threshold: float = 0.8,
    max_queries: int | None = None,
    specialty: str = "specialty",
    key: str = "query",
    vector: str = "embedding",
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """Greedy choice of queries that are not too similar to each other.

    Starts with the query of lowest mean similarity to its specialty; then drops
    those above ``threshold`` to any chosen one and adds the one with the lowest mean
    similarity to the chosen ones, the lowest key on ties. Returns the specialty, the
    key and the place in which it was chosen. A lone query is always kept. Rows without a vector take no part, and a key
    that occurs several times in a specialty counts once.
    """
    rows = _usable(df, specialty, key, vector)
    small, large = split_by_size(rows, specialty, vector, task_bytes)
    if small is not None:
        schema = T.StructType([_type(df, specialty), _type(df, key), T.StructField("place", T.IntegerType())])
        small = small.groupBy(specialty).applyInArrow(
            _greedy_in_task(threshold, max_queries, specialty, key, vector), schema
        )
    if large is not None:
        large = _greedy_over_rounds(large, threshold, max_queries, specialty, key, vector, task_bytes)
    return _both(small, large)


def _greedy_in_task(
    threshold: float, max_queries: int | None, specialty: str, key: str, vector: str
) -> Callable[[pa.Table], pa.Table]:
    limit = round(threshold * blocks.MICRO)

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        unit = unit_rows(rows_of(table.column(vector)))
        alive = np.arange(len(unit))
        sums = np.zeros(len(unit), dtype=np.int64)
        place = int(np.argmin(np.round(unit @ unit_rows(unit.sum(axis=0)[None, :])[0], 9)))
        picks = [place]
        while len(unit) > 1 and (max_queries is None or len(picks) < max_queries):
            similar = np.rint(unit[alive] @ unit[picks[-1]] * blocks.MICRO).astype(np.int64)
            keep = (similar <= limit) & (alive != picks[-1])
            alive, sums = alive[keep], (sums + similar)[keep]
            if not len(alive):
                break
            picks.append(int(alive[np.argmin(sums)]))
        chosen = table.take(pa.array(picks)).select([specialty, key])
        return chosen.append_column("place", pa.array(np.arange(1, len(picks) + 1, dtype=np.int32)))

    return choose


def _greedy_over_rounds(
    rows: DataFrame,
    threshold: float,
    max_queries: int | None,
    specialty: str,
    key: str,
    vector: str,
    task_bytes: int,
) -> DataFrame:
    """The same choice for specialties too large for a task, all of them at once.

    Every round takes the queries of lowest similarity to the chosen ones, about as many as
    fit a task, and goes on choosing among them for as long as no query outside can
    have become better. What the outsiders' sums can have fallen to is bounded by coarse cells: an outsider lies within a known angle
    of the centroid of its cell, and its similarity to all choices of the round together is its product with the sum of their unit
    vectors. The choices of a round are then applied to all
    remaining queries in blocks. The state is a number and a cell per query; reliable checkpoints cut its lineage.
    """
    limit = round(threshold * blocks.MICRO)
    _, width = blocks.vector_stats(rows, vector)
    pool = max(1, task_bytes // (2 * max(8, width)))
    kind = np.float32 if isinstance(rows.schema[vector].dataType.elementType, T.FloatType) else np.float64

    # The cosine to the summed unit vectors orders rows like their mean similarity.
    totals = vector_sums(rows, [specialty], vector)
    mean = totals.groupBy(specialty).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda c: c["total"]).alias("_sum")
    )
    start = rows.join(mean, specialty).withColumn("_first", F.round(cosine(vector, "_sum"), 9))
    first = F.min_by(F.struct(key, vector), F.struct("_first", key)).alias("_pick")
    picks = start.groupBy(specialty).agg(first).select(specialty, "_pick.*", F.lit(1).alias("place"))
    picks = materialise(picks)
    chosen = [picks.drop(vector)]
    if max_queries is not None and max_queries <= 1:
        return chosen[0]

    state, cells = _with_cells(rows, specialty, key, vector, kind, width)
    state_schema = T.StructType([*state.schema.fields, T.StructField("_chosen", T.IntegerType())])
    pick_schema = T.StructType([_type(rows, specialty), _type(rows, key), _type(rows, vector), T.StructField("place", T.IntegerType())])
    choose = _greedy_in_pool(limit, max_queries, specialty, key, vector)
    held: DataFrame | None = None
    for rounds in itertools.count(1):
        packed_picks = picks.groupBy(specialty).agg(
            F.flatten(F.collect_list(vector)).alias("_picked"),
            F.collect_list(key).alias("_names"),
            F.max("place").alias("_chosen"),
        )
        small = picks.count() * width <= blocks.BROADCAST_BYTES
        packed = blocks.pack(state, [key, "_sum", "_cell"], vector, blocks.CHUNK_ROWS, same=[specialty])
        state = packed.join(F.broadcast(packed_picks) if small else packed_picks, specialty).mapInArrow(
            _apply_picks(limit, max_queries, specialty, key, vector, kind), state_schema
        )
        state = materialise(state) if rounds % CUT_EVERY == 0 else state.persist()
        inside, outside = _pool(state, specialty, key, pool)
        own = [F.col(specialty).alias("_of"), F.col("_cell").alias("_in")]
        lowest = outside.select(*own, "_sum").groupBy("_of", "_in").agg(F.min("_sum").alias("_lowest"))
        bounds = lowest.join(cells.select(*own, "_centroid", "_radius"), ["_of", "_in"])
        near = inside.groupBy(specialty).cogroup(bounds.groupBy("_of"))
        picks = materialise(near.applyInArrow(choose, pick_schema))
        if held is not None:
            held.unpersist()
        held = state
        if picks.isEmpty():
            break
        chosen.append(picks.drop(vector))
        if len(chosen) % 50 == 0:
            chosen = [materialise(functools.reduce(DataFrame.unionByName, chosen))]
    held.unpersist()
    return functools.reduce(DataFrame.unionByName, chosen)


def _with_cells(
    rows: DataFrame, specialty: str, key: str, vector: str, kind: type, width: int
) -> tuple[DataFrame, DataFrame]:
    """The state before the first choice, and (specialty, ``_cell``, ``_centroid``, ``_radius``): each row is in the cell of the nearest of a
    few drawn rows, and no row is further from it than the radius of the cell, an angle."""
    drawn = Window.partitionBy(specialty).orderBy(draw(0, F.col(key)), key)
    unit = l2_normalize(F.col(vector))
    centroids = materialise(
        rows.select(specialty, unit.alias("_centroid"), F.row_number().over(drawn).alias("_cell")).filter(F.col("_cell") <= CELLS)
    )
    listed = centroids.groupBy(specialty).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_cell", "_centroid"))), lambda c: c["_centroid"])).alias("_centroids"),
        F.count("*").cast("int").alias("_k"),
    )
    shares = rows.groupBy(specialty).agg(
        F.ceil(F.count("*") / F.lit(8 * blocks.CHUNK_ROWS)).cast("int").alias("_shares")
    )
    spread = (
        rows.join(shares, specialty)
        .withColumn("_share", F.pmod(F.xxhash64(key), F.col("_shares")).cast("int"))
        .repartition(specialty, "_share")
        .sortWithinPartitions(specialty, "_share")
    )
    packed = blocks.pack(spread, [key], vector, blocks.CHUNK_ROWS, same=[specialty])
    small = centroids.count() * 8 * max(1, width // 4) <= blocks.BROADCAST_BYTES
    fields = [_type(rows, specialty), _type(rows, key), _type(rows, vector), T.StructField("_sum", T.LongType()), T.StructField("_cell", T.IntegerType())]
    schema = T.StructType([*fields, T.StructField("_angle", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {name: batch.column(name)[row] for name in batch.schema.names}
                size = cell["_rows"].as_py()
                matrix = np.frombuffer(cell["_matrix"].as_buffer(), dtype=kind).reshape(size, -1)
                middle = cell["_centroids"].values.to_numpy(zero_copy_only=False).reshape(cell["_k"].as_py(), -1)
                cosines = unit_rows(matrix) @ middle.T
                nearest = cosines.argmax(axis=1)
                angle = np.arccos(np.clip(cosines[np.arange(size), nearest], -1.0, 1.0))
                # Without a direction on either side, half a turn holds whatever is said.
                angle[~matrix.any(axis=1) | ~middle.any(axis=1)[nearest]] = np.pi
                offsets = pa.array(np.arange(size + 1) * matrix.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(specialty).slice(row, 1).take(pa.array(np.zeros(size, dtype=np.int64))),
                        cell[key].values,
                        pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1))),
                        pa.array(np.zeros(size, dtype=np.int64)),
                        pa.array((nearest + 1).astype(np.int32)),
                        pa.array(angle),
                    ],
                    schema.fieldNames(),
                )

    placed = materialise(packed.join(F.broadcast(listed) if small else listed, specialty).mapInArrow(assign, schema))
    radii = placed.groupBy(specialty, "_cell").agg(F.max("_angle").alias("_radius"))
    return placed.drop("_angle"), materialise(radii.join(centroids, [specialty, "_cell"]))


def _pool(state: DataFrame, specialty: str, key: str, pool: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``state`` with the lowest sums, up to ``pool`` per specialty, and all others.

    The cut is found from histograms of the sums: each pass splits the range that holds it into ``BINS`` bins, until at least half of the
    pool is below the cut or a bin is a single number. If more than ``pool`` rows share the lowest sum, those with the lowest keys
    are taken.
    """
    ranges = state.groupBy(specialty).agg(
        F.min("_sum").alias("_low"), (F.max("_sum") + 1).alias("_high"), F.lit(0).cast("long").alias("_below")
    )
    schema = T.StructType(
        [_type(state, specialty)]
        + [T.StructField(n, T.LongType()) for n in ("_low", "_high", "_below")]
        + [T.StructField("_done", T.BooleanType())]
    )
    ranges = materialise(ranges.withColumn("_done", F.lit(False)))

    def narrow(table: pa.Table) -> pa.Table:
        """The range in which the cut lies, from the counts of its bins; the cut itself, as ``_low``, if it is found."""
        table = table.sort_by("_bin")
        low, step, below = (table.column(c)[0].as_py() for c in ("_low", "_step", "_below"))
        upto = below + np.cumsum(table.column("_rows").to_numpy())
        if upto[-1] <= pool:
            return _row(table, [table.column("_high")[0].as_py()] * 2 + [int(upto[-1]), True])
        first = int(np.argmax(upto > pool))
        below = int(upto[first - 1]) if first else below
        low += table.column("_bin")[first].as_py() * step
        return _row(table, [low, low + step, below, below >= max(1, pool // 2) or step == 1])

    def _row(table: pa.Table, values: list) -> pa.Table:
        head = table.slice(0, 1).select([specialty])
        for field, value in zip(schema.fields[1:], values):
            head = head.append_column(field.name, pa.array([value], pa.bool_() if field.name == "_done" else pa.int64()))
        return head

    while not (going := ranges.filter("not _done")).isEmpty():
        step = F.ceil((F.col("_high") - F.col("_low")) / F.lit(BINS)).alias("_step")
        # One row per large specialty.
        within = state.join(F.broadcast(going.select(specialty, "_low", "_high", "_below", step)), specialty)
        within = within.filter("_sum >= _low and _sum < _high").withColumn("_bin", F.floor((F.col("_sum") - F.col("_low")) / F.col("_step")))
        counted = within.groupBy(specialty, "_low", "_high", "_below", "_step", "_bin").agg(F.count("*").alias("_rows"))
        ranges = materialise(ranges.filter("_done").unionByName(counted.groupBy(specialty).applyInArrow(narrow, schema)))
    cuts = ranges.select(specialty, F.col("_low").alias("_cut"), (F.col("_below") == 0).alias("_tied"))
    marked = state.join(F.broadcast(cuts), specialty)
    inside = marked.filter("_sum < _cut").select(state.columns)
    outside = marked.filter("_sum >= _cut").select(state.columns)
    if not ranges.filter("_below = 0").isEmpty():
        tied = first_per_group(marked.filter("_tied and _sum = _cut"), [specialty], [F.col(key).asc()], pool, "_place")
        tied = materialise(tied.select(state.columns))
        inside = inside.unionByName(tied)
        last = tied.groupBy(specialty).agg(F.max(key).alias("_last"))
        beyond = marked.filter("_sum >= _cut").join(F.broadcast(last), specialty, "left")
        outside = beyond.filter(F.col("_last").isNull() | (F.col("_sum") > F.col("_cut")) | (F.col(key) > F.col("_last"))).select(state.columns)
    return inside, outside


def _apply_picks(
    limit: int, max_queries: int | None, specialty: str, key: str, vector: str, kind: type
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Drop picked queries and those too similar to a pick; add up the similarity of the rest."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {name: batch.column(name)[row] for name in batch.schema.names}
                placed = cell["_chosen"].as_py()
                if max_queries is not None and placed >= max_queries:
                    continue
                matrix = np.frombuffer(cell["_matrix"].as_buffer(), dtype=kind).reshape(cell["_rows"].as_py(), -1)
                names, sums = cell[key].values, cell["_sum"].values.to_numpy(zero_copy_only=False)
                picked = cell["_picked"].values.to_numpy(zero_copy_only=False).reshape(-1, matrix.shape[1])
                similar = np.rint(unit_rows(matrix) @ unit_rows(picked).T * blocks.MICRO).astype(np.int64)
                taken = pa.compute.is_in(names, value_set=cell["_names"].values).to_numpy(zero_copy_only=False)
                keep = np.flatnonzero((similar <= limit).all(axis=1) & ~taken)
                if not len(keep):
                    continue
                offsets = pa.array(np.arange(len(keep) + 1) * matrix.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(specialty).slice(row, 1).take(pa.array(np.zeros(len(keep), dtype=np.int64))),
                        names.take(pa.array(keep)),
                        pa.ListArray.from_arrays(offsets, pa.array(matrix[keep].reshape(-1))),
                        pa.array((sums + similar.sum(axis=1))[keep]),
                        cell["_cell"].values.take(pa.array(keep)),
                        pa.array(np.full(len(keep), placed, dtype=np.int32)),
                    ],
                    [specialty, key, vector, "_sum", "_cell", "_chosen"],
                )

    return apply


def _greedy_in_pool(
    limit: int, max_queries: int | None, specialty: str, key: str, vector: str
) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Choices among the queries of a specialty's pool that no query outside can beat.

    The second table has the lowest sum of the outsiders of each cell.
    """

    def choose(table: pa.Table, outside: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        sums = table.column("_sum").to_numpy().astype(np.int64)
        unit = unit_rows(rows_of(table.column(vector)))
        placed = table.column("_chosen")[0].as_py() if len(table) else 0
        alive, picks = np.arange(len(unit)), []
        total = np.zeros(unit.shape[1])
        if len(outside):
            lowest = outside.column("_lowest").to_numpy().astype(np.float64)
            centroids, radius = rows_of(outside.column("_centroid")), outside.column("_radius").to_numpy()
        while len(alive) and (max_queries is None or placed + len(picks) < max_queries) and len(picks) < ROUND_PICKS:
            best = int(np.argmin(sums))
            # The first choice is sure: nobody outside has a lower sum, or the same and a lower key.
            if picks and len(outside) and not total.any():
                # Only zero vectors so far, which change no sum; keys decide, and those outside are higher.
                if sums[best] > lowest.min():
                    break
            elif picks and len(outside):
                length = np.linalg.norm(total)
                angle = np.arccos(np.clip(centroids @ total / max(length, 1e-300), -1.0, 1.0))
                fallen = length * np.cos(np.minimum(np.pi, angle + radius + 1e-7))
                # Every similarity was rounded by half a millionth at most.
                if sums[best] >= (lowest + fallen * blocks.MICRO).min() - len(picks) - 1:
                    break
            picks.append(int(alive[best]))
            total += unit[picks[-1]]
            similar = np.rint(unit[alive] @ unit[picks[-1]] * blocks.MICRO).astype(np.int64)
            keep = (similar <= limit) & (alive != picks[-1])
            alive, sums = alive[keep], (sums + similar)[keep]
        out = table.take(pa.array(picks, pa.int64())).select([specialty, key, vector])
        places = np.arange(placed + 1, placed + len(picks) + 1, dtype=np.int32)
        return out.append_column("place", pa.array(places))

    return choose


# --- selection by clusters ---------------------------------------------------------------


def cluster_count(n: int, clusters: int | None) -> int:
    """Clusters of n queries: about the square root, at least two, never more than n."""
    wanted = clusters if clusters is not None else max(2, min(int(np.sqrt(n)), n - 1))
    return min(wanted, n)


def cluster_queries(
    df: DataFrame,
    clusters: int | None = None,
    seed: int = 42,
    max_rounds: int | None = None,
    specialty: str = "specialty",
    key: str = "query",
    vector: str = "embedding",
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """K-means per specialty: the cluster of each query and its cosine to the centroid.

    The first centroids are a seeded draw of the queries; a centroid without members
    stays where it is. Runs until no query changes its cluster, unless ``max_rounds`` ends it before. Rows without a vector take
    no part, and a key that occurs several times in a specialty counts once.
    """
    rows = _usable(df, specialty, key, vector).withColumn("_draw", draw(seed, F.col(key)))
    small, large = split_by_size(rows, specialty, vector, task_bytes)
    schema = T.StructType(
        [
            _type(df, specialty),
            _type(df, key),
            T.StructField("cluster", T.IntegerType()),
            T.StructField("centroid_similarity", T.DoubleType()),
        ]
    )
    if small is not None:
        small = small.groupBy(specialty).applyInArrow(
            _lloyd_in_task(clusters, max_rounds, specialty, key, vector), schema
        )
    if large is not None:
        large = _lloyd_over_rounds(large, clusters, max_rounds, specialty, key, vector, schema)
    return _both(small, large)


def _rounds(most: int | None):
    return itertools.count() if most is None else range(most)


def _nearest(matrix: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid by Euclidean distance, the lowest on ties."""
    half = np.einsum("ij,ij->i", centroids, centroids) / 2
    out = np.empty(len(matrix), dtype=np.int32)
    step = max(1, 4_000_000 // max(1, len(centroids)))
    for start in range(0, len(matrix), step):
        part = matrix[start:start + step]
        out[start:start + step] = np.argmin(half - part @ centroids.T, axis=1)
    return out


def _centroid_cosines(matrix: np.ndarray, centroids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    values = np.einsum("ij,ij->i", unit_rows(matrix), unit_rows(centroids)[labels])
    return np.rint(values * blocks.MICRO) / blocks.MICRO


def _lloyd_in_task(
    clusters: int | None, max_rounds: int | None, specialty: str, key: str, vector: str
) -> Callable[[pa.Table], pa.Table]:
    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_draw", "ascending"), (key, "ascending")])
        matrix = rows_of(table.column(vector)).astype(np.float64)
        centroids = matrix[:cluster_count(len(matrix), clusters)].copy()
        seen = set()
        for _ in _rounds(max_rounds):
            labels = _nearest(matrix, centroids)
            state = labels.tobytes()
            if state in seen:  # unchanged, or back at an earlier state by rounding
                break
            seen = {*seen, state} if len(seen) < 8 else {state}
            members = np.bincount(labels, minlength=len(centroids))
            sums = np.zeros_like(centroids)
            np.add.at(sums, labels, matrix)
            filled = members > 0
            centroids[filled] = sums[filled] / members[filled][:, None]
        labels = _nearest(matrix, centroids)
        out = table.select([specialty, key])
        out = out.append_column("cluster", pa.array(labels))
        return out.append_column(
            "centroid_similarity", pa.array(_centroid_cosines(matrix, centroids, labels))
        )

    return fit


def _lloyd_over_rounds(
    rows: DataFrame,
    clusters: int | None,
    max_rounds: int | None,
    specialty: str,
    key: str,
    vector: str,
    schema: T.StructType,
) -> DataFrame:
    """Lloyd's iterations of all large specialties at once.

    Centroids of a specialty number about the square root of its rows, so one row per
    specialty carries them to the packed points; points come back only as sums per
    block and cluster.
    """
    sizes = rows.groupBy(specialty).agg(F.count("*").alias("_n"))
    root = F.floor(F.sqrt("_n")).cast("int")
    wanted = F.lit(clusters) if clusters is not None else F.greatest(F.lit(2), F.least(root, F.col("_n") - 1))
    sizes = sizes.select(specialty, F.least(wanted, F.col("_n")).cast("int").alias("_k"))

    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    order = [F.col("_draw").asc(), F.col(key).asc()]
    numbered = row_numbers(rows.select(specialty, key, "_draw"), order, "_place", [specialty])
    chosen = numbered.join(sizes, specialty).filter(F.col("_place") <= F.col("_k"))
    centroids = materialise(
        rows.join(chosen.select(specialty, key, "_place"), [specialty, key]).select(
            specialty, (F.col("_place") - 1).cast("int").alias("cluster"), doubles.alias("centroid")
        )
    )
    count, width = centroids.count(), blocks.vector_stats(centroids, "centroid")[1]
    fits = count * width <= blocks.BROADCAST_BYTES
    share_count = F.ceil(F.col("_n") / F.lit(8 * blocks.CHUNK_ROWS)).cast("int")
    shares = rows.groupBy(specialty).agg(F.count("*").alias("_n")).select(specialty, share_count.alias("_shares"))
    spread = (
        rows.join(shares, specialty)
        .withColumn("_share", F.pmod(F.xxhash64(key), F.col("_shares")).cast("int"))
        .withColumn("_mark", F.xxhash64(key))
        .repartition(specialty, "_share")
        .sortWithinPartitions(specialty, "_share")
    )
    points = blocks.pack(spread, [key, "_mark"], vector, blocks.CHUNK_ROWS, same=[specialty]).persist()
    kind = np.float32 if isinstance(rows.schema[vector].dataType.elementType, T.FloatType) else np.float64

    def with_centroids() -> DataFrame:
        packed = centroids.groupBy(specialty).agg(
            F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("_all")
        )
        packed = packed.select(
            specialty,
            F.flatten(F.transform("_all", lambda c: c["centroid"])).alias("_centroids"),
            F.size("_all").alias("_k"),
        )
        # Beyond the limit the join is shuffled and AQE splits the blocks of a hot specialty.
        return points.join(F.broadcast(packed) if fits else packed, specialty)

    def decode(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
        def cell(name: str) -> pa.Scalar:
            return batch.column(batch.schema.get_field_index(name))[row]

        matrix = np.frombuffer(cell("_matrix").as_buffer(), dtype=kind).reshape(cell("_rows").as_py(), -1)
        middle = cell("_centroids").values.to_numpy(zero_copy_only=False).reshape(cell("_k").as_py(), -1)
        return matrix.astype(np.float64), middle

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                matrix, middle = decode(batch, row)
                labels = _nearest(matrix, middle)
                present, inverse = np.unique(labels, return_inverse=True)
                sums = np.zeros((len(present), matrix.shape[1]))
                np.add.at(sums, inverse, matrix)
                marks = np.zeros(len(present), dtype=np.int64)
                held = batch.column(batch.schema.get_field_index("_mark"))[row].values
                np.bitwise_xor.at(marks, inverse, held.to_numpy(zero_copy_only=False))
                group = batch.column(batch.schema.get_field_index(specialty)).slice(row, 1)
                offsets = pa.array(np.arange(len(present) + 1) * matrix.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        group.take(pa.array(np.zeros(len(present), dtype=np.int64))),
                        pa.array(present.astype(np.int32)),
                        pa.array(np.bincount(inverse).astype(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(sums.reshape(-1))),
                        pa.array(marks),
                    ],
                    [specialty, "cluster", "members", "total", "mark"],
                )

    sum_schema = T.StructType(
        [
            rows.schema[specialty],
            T.StructField("cluster", T.IntegerType()),
            T.StructField("members", T.LongType()),
            T.StructField("total", T.ArrayType(T.DoubleType())),
            T.StructField("mark", T.LongType()),
        ]
    )
    seen: list[int] = []
    for _ in _rounds(max_rounds):
        totals = (
            with_centroids()
            .mapInArrow(add_up, sum_schema)
            .groupBy(specialty, "cluster")
            .agg(
                F.sum("members").alias("_members"),
                F.bit_xor("mark").alias("_mark"),
                vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("_total"),
            )
        )
        moved = F.transform("_total", lambda x: x / F.col("_members"))
        updated = centroids.join(totals, [specialty, "cluster"], "left").select(
            specialty,
            "cluster",
            F.coalesce(moved, F.col("centroid")).alias("centroid"),
            "_mark",
        )
        updated = materialise(updated)
        # One number for who is in which cluster: unchanged, or back at an earlier state by rounding.
        state = updated.agg(F.bit_xor(F.xxhash64(specialty, "cluster", "_mark")).alias("state")).first().state
        centroids = updated.drop("_mark")
        if state in seen:
            break
        seen = [*seen[-7:], state]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                matrix, middle = decode(batch, row)
                labels = _nearest(matrix, middle)
                group = batch.column(batch.schema.get_field_index(specialty)).slice(row, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        group.take(pa.array(np.zeros(len(labels), dtype=np.int64))),
                        batch.column(batch.schema.get_field_index(key))[row].values,
                        pa.array(labels),
                        pa.array(_centroid_cosines(matrix, middle, labels)),
                    ],
                    [field.name for field in schema],
                )

    labelled = materialise(with_centroids().mapInArrow(label, schema))
    points.unpersist()
    return labelled


def diverse_cluster(
    df: DataFrame,
    clusters: int | None = None,
    per_cluster: int = 1,
    specialty: str = "specialty",
    key: str = "query",
    **options,
) -> DataFrame:
    """The queries nearest to the centroid of each cluster, by cosine."""
    labelled = cluster_queries(df, clusters, specialty=specialty, key=key, **options)
    nearest = Window.partitionBy(specialty, "cluster").orderBy(F.desc("centroid_similarity"), F.asc(key))
    return labelled.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= per_cluster)


def run_comparison(df: DataFrame, threshold: float = 0.8, clusters: int | None = None, **options) -> DataFrame:
    """Choices of both methods over the same queries."""
    greedy = diverse_greedy(df, threshold, **options).withColumn("method", F.lit(GREEDY))
    clustered = diverse_cluster(df, clusters, **options).withColumn("method", F.lit(CLUSTERED))
    keep = ["method", options.get("specialty", "specialty"), options.get("key", "query"), "place"]
    return greedy.select(keep).unionByName(clustered.select(keep))


# --- measures ----------------------------------------------------------------------------


def vector_sums(df: DataFrame, group: list[str], vector: str = "embedding") -> DataFrame:
    """Sum of the unit vectors of each group: one row per group and position.

    Every Arrow batch is summed in its task first, so only sums are shuffled.
    ``members`` counts all vectors, ``nonzero`` those that are not zero.
    """
    source = df.select(*group, F.col(vector).alias("_vector")).filter(F.col("_vector").isNotNull())
    schema = T.StructType(
        [source.schema[name] for name in group]
        + [
            T.StructField("_members", T.LongType()),
            T.StructField("_nonzero", T.LongType()),
            T.StructField("_total", T.ArrayType(T.DoubleType())),
        ]
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(rows_of(batch.column(batch.schema.get_field_index("_vector"))))
            table = pa.Table.from_batches([batch]).select(group)
            table = table.append_column("_row", pa.array(np.arange(len(unit))))
            grouped = table.group_by(group).aggregate([("_row", "list")])
            lists = grouped.column("_row_list").to_pylist()
            sums = np.stack([unit[rows].sum(axis=0) for rows in lists])
            nonzero = [int(unit[rows].any(axis=1).sum()) for rows in lists]
            offsets = pa.array(np.arange(len(lists) + 1) * unit.shape[1], pa.int32())
            columns = [grouped.column(name).combine_chunks() for name in group]
            columns += [
                pa.array([len(rows) for rows in lists], pa.int64()),
                pa.array(nonzero, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(sums.reshape(-1))),
            ]
            yield pa.RecordBatch.from_arrays(columns, [field.name for field in schema])

    parts = source.mapInArrow(add_up, schema)
    return (
        parts.select(*group, "_members", "_nonzero", F.posexplode("_total").alias("pos", "_x"))
        .groupBy(*group, "pos")
        .agg(
            F.sum("_x").alias("total"),
            F.sum("_members").alias("members"),
            F.sum("_nonzero").alias("nonzero"),
        )
    )


def average_pairwise_similarity(df: DataFrame, group: list[str], vector: str = "embedding") -> DataFrame:
    """Mean cosine over all pairs of a group, 0 for a single query.

    The squared length of the summed unit vectors holds every pair, so the cost is
    linear and no pair is ever built.
    """
    whole = vector_sums(df, group, vector).groupBy(*group).agg(
        F.sum(F.col("total") * F.col("total")).alias("_square"),
        F.max("members").alias("_n"),
        F.max("nonzero").alias("_nonzero"),
    )
    mean = F.try_divide(F.col("_square") - F.col("_nonzero"), F.col("_n") * (F.col("_n") - 1.0))
    return whole.select(
        *group,
        F.col("_n").alias("num_queries"),
        F.round(F.coalesce(mean, F.lit(0.0)), 6).alias("avg_similarity"),
    )


def embedding_coverage(
    selected: DataFrame,
    everything: DataFrame,
    specialty: str = "specialty",
    key: str = "query",
    vector: str = "embedding",
) -> DataFrame:
    """Mean over all queries of the highest cosine to a selected one; 0 without selection."""
    schema = T.StructType(
        [_type(everything, specialty), _type(everything, key), T.StructField("_best", T.LongType())]
    )

    def kernel(left: blocks.Block, right: blocks.Block) -> dict[str, pa.Array]:
        return {
            key: left.columns[key],
            "_best": pa.array(blocks.micro_cosines(left, right).max(axis=1)),
        }

    parts = blocks.meet_in_group(everything, selected, specialty, [key], [key], vector, kernel, schema)
    best = parts.groupBy(specialty, key).agg(F.max("_best").alias("_best"))
    means = best.groupBy(specialty).agg((F.sum("_best") / F.count("*") / blocks.MICRO).alias("_mean"))
    return (
        everything.select(specialty)
        .distinct()
        .join(means, specialty, "left")
        .select(specialty, F.round(F.coalesce("_mean", F.lit(0.0)), 12).alias("coverage"))
    )


def redundancy_profile(
    df: DataFrame,
    threshold: float = 0.8,
    specialty: str = "specialty",
    key: str = "query",
    vector: str = "embedding",
) -> DataFrame:
    """What the pairs inside a specialty say about each query, without listing pairs.

    Per query: the mean cosine to its specialty (itself included), the number of
    other queries above the threshold and the highest cosine to another one.
    """
    limit = round(threshold * blocks.MICRO)
    schema = T.StructType(
        [
            _type(df, specialty),
            _type(df, key),
            T.StructField("_sum", T.LongType()),
            T.StructField("_n", T.LongType()),
            T.StructField("_similar", T.LongType()),
            T.StructField("_nearest", T.LongType()),
        ]
    )

    def kernel(left: blocks.Block, right: blocks.Block) -> dict[str, pa.Array]:
        scores = blocks.micro_cosines(left, right)
        sums = scores.sum(axis=1)
        scores[blocks.same_keys(left, right, key)] = -2 * blocks.MICRO
        nearest = scores.max(axis=1)
        return {
            key: left.columns[key],
            "_sum": pa.array(sums),
            "_n": pa.array(np.full(len(left), len(right), dtype=np.int64)),
            "_similar": pa.array((scores > limit).sum(axis=1).astype(np.int64)),
            "_nearest": pa.array(nearest, mask=nearest < -blocks.MICRO),
        }

    parts = blocks.meet_in_group(df, df, specialty, [key], [key], vector, kernel, schema)
    merged = parts.groupBy(specialty, key).agg(
        F.sum("_sum").alias("_sum"),
        F.sum("_n").alias("_n"),
        F.sum("_similar").alias("similar_queries"),
        F.max("_nearest").alias("_nearest"),
    )
    return merged.select(
        specialty,
        key,
        F.round(F.col("_sum") / F.col("_n") / blocks.MICRO, 12).alias("mean_similarity"),
        "similar_queries",
        (F.col("_nearest") / blocks.MICRO).alias("nearest_similarity"),
    )


def code_coverage(selected: DataFrame, everything: DataFrame, mapping: DataFrame, group: str = "specialty") -> DataFrame:
    """Share of the codes of all queries that the selected queries cover, 0 without codes.

    ``mapping`` has one row per query and code.
    """
    pairs = mapping.select("query", "code")
    every = everything.select(group, "query").distinct().join(pairs, "query").select(group, "code").distinct()
    some = (
        selected.select(group, "query").distinct().join(pairs, "query").select(group, "code").distinct()
    )
    counted = (
        every.withColumn("_all", F.lit(1))
        .join(some.withColumn("_some", F.lit(1)), [group, "code"], "full")
        .groupBy(group)
        .agg(F.count("_some").alias("_some"), F.count("_all").alias("_all"))
    )
    return (
        everything.select(group)
        .distinct()
        .join(counted, group, "left")
        .select(
            group,
            F.when(F.col("_all") > 0, F.round(F.col("_some") / F.col("_all"), 6)).otherwise(0.0).alias("code_coverage"),
        )
    )


def _cluster_layout(labelled: DataFrame, specialty: str, key: str, cluster: str, block_rows: int) -> DataFrame:
    """``labelled`` with ``_bucket`` and ``_whole``: clusters of up to ``block_rows`` rows lie whole in a bucket, several in one as long as
    they begin in the same ``block_rows`` rows; a larger cluster has buckets of its own."""
    sizes = labelled.groupBy(specialty, cluster).agg(F.count("*").alias("_n"))
    small = running_sums(sizes.filter(F.col("_n") <= block_rows), [specialty], [F.col(cluster).asc()], {"_upto": F.col("_n")})
    large = sizes.filter(F.col("_n") > block_rows)
    layout = small.select(
        specialty, cluster, F.lit(1).alias("_shares"), F.floor((F.col("_upto") - F.col("_n")) / F.lit(block_rows)).alias("_start")
    ).unionByName(
        large.select(specialty, cluster, F.ceil(F.col("_n") / F.lit(block_rows)).cast("int").alias("_shares"), F.lit(-1).cast("long").alias("_start"))
    )
    layout = materialise(layout)
    layout = F.broadcast(layout) if layout.count() <= blocks.MOST_SIZES else layout
    share = F.pmod(F.xxhash64(key), F.col("_shares")).cast("string")
    own = F.concat(F.lit("cluster "), F.col(cluster).cast("string"), F.lit(" share "), share)
    whole = F.col("_start") >= 0
    placed = labelled.join(layout, [specialty, cluster])
    return placed.withColumn("_bucket", F.when(whole, F.col("_start").cast("string")).otherwise(own)).withColumn("_whole", whole)


def silhouette(
    labelled: DataFrame,
    specialty: str = "specialty",
    key: str = "query",
    cluster: str = "cluster",
    vector: str = "embedding",
    min_queries: int = 4,
    block_rows: int = 4096,
    cell_bytes: int = blocks.CELL_BYTES,
) -> DataFrame:
    """Mean silhouette of each specialty by Euclidean distance.

    Fewer than ``min_queries`` queries, a lone cluster member and a specialty with a
    single cluster count 0. Rows without a cluster or a vector take no part. The other side of the comparison is laid out by cluster:
    where clusters lie whole in a block, their mean distances are finished there and only the least one leaves, so a query has one row
    for each block it met, however many clusters there are. Blocks of a cluster that is too large for one give one sum each.
    """
    labelled = labelled.filter(F.col(cluster).isNotNull())
    kind = labelled.schema[cluster].dataType
    schema = T.StructType(
        [
            _type(labelled, specialty),
            _type(labelled, key),
            T.StructField("_least", T.DoubleType()),
            T.StructField("_own_sum", T.DoubleType()),
            T.StructField("_own_n", T.LongType()),
            T.StructField("_other", kind),
            T.StructField("_sum", T.DoubleType()),
            T.StructField("_n", T.LongType()),
        ]
    )

    def kernel(left: blocks.Block, right: blocks.Block) -> dict[str, pa.Array]:
        a, b = left.matrix.astype(np.float64), right.matrix.astype(np.float64)
        squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
        distances = np.sqrt(np.maximum(squares, 0.0))
        distances[blocks.same_keys(left, right, key)] = 0.0
        names = right.columns[cluster].dictionary_encode()
        codes = names.indices.to_numpy(zero_copy_only=False)
        # Rows are sorted by cluster.
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        sums = np.add.reduceat(distances, starts, axis=1)
        counts = np.diff(np.append(starts, len(codes)))
        order = names.dictionary.take(pa.array(codes[starts]))
        own = pa.compute.index_in(left.columns[cluster], value_set=order)
        here = np.asarray(own.is_valid())
        column = own.fill_null(0).to_numpy(zero_copy_only=False)
        rows = np.arange(len(left))
        own_sum, own_n = sums[rows, column], counts[column]
        empty = np.ones(len(left), dtype=bool)
        if not right.columns["_whole"][0].as_py():
            # One cluster in parts: its mean is not known yet.
            apart = ~here
            least, other = pa.nulls(len(left), pa.float64()), order.take(pa.array(np.zeros(len(left), dtype=np.int64)))
            part = pa.array(sums[:, 0], mask=here), pa.array(np.full(len(left), counts[0], dtype=np.int64), mask=here)
            other = pa.compute.if_else(pa.array(apart), other, pa.scalar(None, other.type))
        else:
            means = sums / counts
            means[rows[here], column[here]] = np.inf
            lowest = means.min(axis=1)
            least = pa.array(lowest, mask=np.isinf(lowest))
            part = pa.array(sums[:, 0], mask=empty), pa.array(np.zeros(len(left), dtype=np.int64), mask=empty)
            other = pa.nulls(len(left), order.type)
        return {
            key: left.columns[key],
            "_least": least,
            "_own_sum": pa.array(own_sum, mask=~here),
            "_own_n": pa.array(own_n.astype(np.int64), mask=~here),
            "_other": other,
            "_sum": part[0],
            "_n": part[1],
        }

    parts = blocks.meet_in_group(
        labelled,
        _cluster_layout(labelled, specialty, key, cluster, block_rows),
        specialty,
        [key, cluster],
        [key, cluster, "_whole"],
        vector,
        kernel,
        schema,
        sort_right=[cluster, key],
        block_rows=block_rows,
        cell_bytes=cell_bytes,
        bucket="_bucket",
    )
    # A query has a row for each cluster in parts here, and one for all others.
    merged = parts.groupBy(specialty, key, "_other").agg(
        F.min("_least").alias("_least"),
        F.sum("_own_sum").alias("_own_sum"),
        F.sum("_own_n").alias("_own_n"),
        (F.sum("_sum") / F.sum("_n")).alias("_mean"),
    )
    points = merged.groupBy(specialty, key).agg(
        F.sum("_own_n").alias("_members"),
        F.try_divide(F.sum("_own_sum"), F.sum("_own_n") - 1).alias("_a"),
        F.least(F.min("_least"), F.min("_mean")).alias("_b"),
    )
    widest = F.greatest("_a", "_b")
    value = F.when(
        (F.col("_members") > 1) & F.col("_b").isNotNull() & (widest > 0),
        F.try_divide(F.col("_b") - F.col("_a"), widest),
    ).otherwise(0.0)
    return points.groupBy(specialty).agg(
        F.count("*").alias("num_queries"),
        F.round(F.when(F.count("*") >= min_queries, F.avg(value)).otherwise(0.0), 6).alias("silhouette"),
    )


def evaluate_methods(
    everything: DataFrame,
    choices: DataFrame,
    mapping: DataFrame | None = None,
    seed: int = 42,
) -> DataFrame:
    """Measures of each method's choice per specialty.

    ``everything`` is (specialty, query, embedding), ``choices`` (method, specialty,
    query), ``mapping`` (query, code). Specialties where a method chose nothing are
    left out. Choices come from iterations, so they are stored before they are measured.
    """
    choices = materialise(choices)
    n_methods = choices.select("method").distinct().count()
    complete = (
        choices.groupBy("specialty")
        .agg(F.count_distinct("method").alias("_m"))
        .filter(F.col("_m") == n_methods)
        .select("specialty")
    )
    cell = F.concat_ws("\x1f", F.col("method"), F.col("specialty").cast("string"))
    kept = choices.join(complete, "specialty", "left_semi")
    cells = kept.select("method", "specialty").distinct().withColumn("cell", cell)
    selected = (
        kept.join(everything, ["specialty", "query"]).withColumn("cell", cell).select("cell", "query", "embedding")
    )
    selected = materialise(selected)
    every = everything.join(cells, "specialty").select("cell", "query", "embedding")
    similarity = average_pairwise_similarity(selected, ["cell"])
    coverage = embedding_coverage(selected, every, "cell")
    clustered = cluster_queries(selected, seed=seed, specialty="cell").select("cell", "query", "cluster")
    shape = silhouette(clustered.join(selected, ["cell", "query"]), "cell").select("cell", "silhouette")
    result = (
        cells.join(similarity, "cell")
        .join(coverage, "cell")
        .join(shape, "cell")
    )
    if mapping is None:
        result = result.withColumn("code_coverage", F.lit(0.0))
    else:
        result = result.join(code_coverage(selected, every, mapping, "cell"), "cell")
    return result.select(
        "specialty", "method", "num_queries", "avg_similarity", "coverage", "silhouette", "code_coverage"
    )


MEASURES = ("avg_similarity", "coverage", "silhouette", "code_coverage")


def method_summary(evaluation: DataFrame) -> DataFrame:
    """Mean of each measure per method."""
    return evaluation.groupBy("method").agg(*[F.round(F.avg(m), 6).alias(m) for m in MEASURES])


def method_wins(summary: DataFrame, challenger: str = CLUSTERED, incumbent: str = GREEDY) -> DataFrame:
    """In how many measures the challenger is strictly better; ties go to the incumbent."""

    def of(method: str, measure: str):
        return F.max(F.when(F.col("method") == method, F.col(measure)))

    lower = (of(challenger, MEASURES[0]) < of(incumbent, MEASURES[0])).cast("int")
    wins = lower
    for measure in MEASURES[1:]:
        wins = wins + (of(challenger, measure) > of(incumbent, measure)).cast("int")
    counted = summary.agg(wins.alias("challenger_wins"))
    return counted.select(
        "challenger_wins",
        (F.lit(len(MEASURES)) - F.col("challenger_wins")).alias("incumbent_wins"),
        F.when(F.col("challenger_wins") * 2 > len(MEASURES), challenger)
        .when(F.col("challenger_wins") * 2 < len(MEASURES), incumbent)
        .otherwise("tie")
        .alias("better"),
    )
