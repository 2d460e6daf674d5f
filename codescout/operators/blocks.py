"""Comparing many vectors with many others, block by block.

Vectors are packed into rows that hold a whole block (keys and one matrix). Blocks
meet in an equi-join, and each meeting is one matrix product in an Arrow task that
emits only an aggregate of it (the top k, a histogram, a maximum), never the pairs.

The right side is broadcast only if its measured size is below a small limit; left rows
then stay where they are. Beyond it both sides meet in a grid: left parts are copied to
every right block and right blocks to every left part. A task sorts the rows of its cells,
holds one side of a cell (a block of bounded size) and streams the other past it, row by
row, so its memory doesn't grow with the tables and no block is sent twice.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescout.functions.vectors import rows_of, unit_rows
from codescout.session import materialise

BLOCK_BYTES = 8 << 20
BROADCAST_BYTES = 512 << 20
#: Bytes of right vectors that are sent along with every left block; more of them meet the left rows in a grid.
SENT_BYTES = 1 << 20
#: Bytes of right vectors up to which a task holds all of them.
TASK_BYTES = 384 << 20
#: Left and right rows that meet at a time where a task holds all right ones; left rows of one product, which then stays in the cache.
TILE_ROWS, TILE_COLUMNS, PRODUCT_ROWS = 1024, 1024, 256
CELL_BYTES = 32 << 20
#: Pairs that are worth a cell of their own.
CELL_PAIRS = 1 << 24
#: Rows of a table of large groups (about 24 bytes each) up to which it is broadcast.
MOST_SIZES = 1 << 20
CHUNK_ROWS = 1024
MICRO = 1_000_000
_PRODUCT_CELLS = 1_000_000


class Block:
    """One decoded side of a meeting: key and carried columns plus the matrix."""

    def __init__(self, columns: dict[str, pa.Array], matrix: np.ndarray):
        self.columns = columns
        self.matrix = matrix
        self._unit: np.ndarray | None = None

    @property
    def unit(self) -> np.ndarray:
        if self._unit is None:
            self._unit = unit_rows(self.matrix)
        return self._unit

    def __len__(self) -> int:
        return len(self.matrix)


def _wrap(column: pa.Array, start: int, size: int) -> pa.Array:
    """A list column with one row that holds a slice of a column."""
    return pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), column.slice(start, size))


def pack(
    df: DataFrame,
    keep: Sequence[str],
    vector: str,
    rows: int,
    same: Sequence[str] = (),
) -> DataFrame:
    """Pack consecutive rows of each partition into blocks of up to ``rows``, without a shuffle.

    ``keep`` columns become arrays; ``same`` columns stay scalars and a block never
    mixes their values, so rows should arrive clustered by them. Rows without a
    vector are left out. Rows that fit one block always end up in one block.
    """
    source = df.select(*same, *keep, F.col(vector).alias("_vector")).filter(
        F.col("_vector").isNotNull() & (F.size("_vector") > 0)
    )
    item = source.schema["_vector"].dataType.elementType
    kind = np.float32 if isinstance(item, T.FloatType) else np.float64
    schema = T.StructType(
        [T.StructField(name, source.schema[name].dataType) for name in same]
        + [T.StructField(name, T.ArrayType(source.schema[name].dataType)) for name in keep]
        + [T.StructField("_matrix", T.BinaryType()), T.StructField("_rows", T.IntegerType())]
    )
    names = [field.name for field in schema]

    def blocks_of(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(name: str) -> pa.Array:
            return pa.concat_arrays([piece.column(name) for piece in pieces])

        vectors = whole("_vector")
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
        offsets = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
        kept = {name: whole(name) for name in keep}
        for start in range(0, len(vectors), rows):
            size = min(rows, len(vectors) - start)
            lengths = np.diff(offsets[start:start + size + 1])
            if (lengths != lengths[0]).any():
                raise ValueError("vectors differ in dimension")
            cells = [pieces[0].column(name).slice(0, 1) for name in same]
            cells += [_wrap(kept[name], start, size) for name in keep]
            cells.append(pa.array([flat[offsets[start]:offsets[start + size]].tobytes()], pa.binary()))
            cells.append(pa.array([size], pa.int32()))
            yield pa.RecordBatch.from_arrays(cells, names)

    def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_key, held_rows = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows - 1, dtype=bool)
            for name in same:
                codes = batch.column(name).dictionary_encode().indices.fill_null(-1)
                codes = codes.to_numpy(zero_copy_only=False)
                change |= codes[1:] != codes[:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                key = tuple(batch.column(name)[low].as_py() for name in same)
                if held and (key != held_key or held_rows + high - low > rows):
                    yield from blocks_of(held)
                    held, held_rows = [], 0
                held.append(batch.slice(low, high - low))
                held_key, held_rows = key, held_rows + high - low
        if held:
            yield from blocks_of(held)

    return source.mapInArrow(pack_batches, schema)


def vector_stats(df: DataFrame, vector: str) -> tuple[int, int]:
    """Number of vectors and bytes per vector, from one small aggregate."""
    row = df.agg(
        F.count(vector).alias("n"), F.coalesce(F.max(F.size(F.col(vector))), F.lit(0)).alias("d")
    ).first()
    item = df.schema[vector].dataType.elementType
    return row.n, max(0, row.d) * (4 if isinstance(item, T.FloatType) else 8)


def _width(df: DataFrame, vector: str) -> type:
    return np.float32 if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else np.float64


Kernel = Callable[[Block, Block], dict[str, pa.Array]]


class Total:
    """What a task keeps over all its meetings and emits once at its end."""

    def add(self, left: Block, right: Block) -> None:
        raise NotImplementedError

    def result(self) -> dict[str, pa.Array]:
        raise NotImplementedError


def meet(
    left: DataFrame,
    right: DataFrame,
    left_keep: Sequence[str],
    right_keep: Sequence[str],
    vector: str,
    kernel: Kernel | type[Total],
    schema: T.StructType,
    block_bytes: int = BLOCK_BYTES,
    broadcast_bytes: int = SENT_BYTES,
) -> tuple[DataFrame, int]:
    """Run ``kernel`` on every (left block, right block); returns rows and right blocks.

    A kernel is a function of two blocks, or a :class:`Total` that sums up a task.
    With a single right block (all of its rows fit) each left row meets all right rows
    in one call and the kernel's result is final; otherwise the caller merges the parts.
    Right blocks are sorted by the first of ``right_keep``.
    """
    count, width = vector_stats(right, vector)
    total = count * width
    buckets = max(1, math.ceil(total / block_bytes))
    block_rows = max(1, block_bytes // max(1, width)) * 2
    kinds = _width(left, vector), _width(right, vector)
    bucket = F.pmod(F.xxhash64(right_keep[0]), F.lit(buckets)).cast("int")

    if total > broadcast_bytes:
        left_count, _ = vector_stats(left, vector)
        parts = math.ceil(_tasks(left, left_count * count) / buckets)
        part = F.pmod(F.xxhash64(left_keep[0], vector), F.lit(parts)).cast("int")
        placed = right.withColumn("_bucket", bucket).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        copied = left.withColumn("_part", part).withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
        dealt = _dealt(placed, copied, right_keep, left_keep, vector, parts * buckets)
        out_names = [field.name for field in schema]
        totals = isinstance(kernel, type)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = kernel() if totals else None
            for pieces, streamed in _cells(batches):
                rights = _blocks(pieces, "a_", right_keep, kinds[1], block_rows)
                for piece in streamed:
                    for whole in _blocks([piece], "b_", left_keep, kinds[0], CHUNK_ROWS):
                        for other in rights:
                            _same_width(whole, other)
                            for some in _slices(whole, len(other)):
                                if totals:
                                    total.add(some, other)
                                    continue
                                columns = kernel(some, other)
                                if len(columns[out_names[0]]):
                                    yield pa.RecordBatch.from_arrays([columns[name] for name in out_names], out_names)
            if totals:
                columns = total.result()
                yield pa.RecordBatch.from_arrays([columns[name] for name in out_names], out_names)

        return dealt.mapInArrow(run, schema), buckets

    stored = right.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).withColumn("_bucket", bucket)
    stored = stored.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", right_keep[0])
    packed_right = _prefix(pack(stored, right_keep, vector, block_rows, same=["_bucket"]), "r_", skip=["_bucket"])
    packed_left = _prefix(pack(left, left_keep, vector, CHUNK_ROWS), "l_")
    # A key that is no literal, so that Spark plans a hash join and no nested loops.
    band = lambda rows: (F.col(rows) * 0).alias("_band")
    sent = F.broadcast(packed_right.select("*", band("r__rows")))
    pairs = packed_left.select("*", band("l__rows")).join(sent, "_band")
    return run_kernel(pairs, left_keep, right_keep, *kinds, kernel, schema), buckets


def fits_task(right: DataFrame, vector: str, block_bytes: int | None = None, broadcast_bytes: int = SENT_BYTES, task_bytes: int | None = None) -> bool:
    """Whether the right side is more than is sent along with every left block, but a task can hold it; limits on blocks say no."""
    most = task_bytes if task_bytes is not None else TASK_BYTES if block_bytes is None else 0
    if not most:
        return False
    count, width = vector_stats(right, vector)
    return broadcast_bytes < count * width <= most


def beside(
    left: DataFrame,
    right: DataFrame,
    left_keep: Sequence[str],
    right_keep: Sequence[str],
    vector: str,
    kernel: Callable[[Block, list[Block]], dict[str, pa.Array]] | type[Total],
    schema: T.StructType,
) -> DataFrame:
    """Like :func:`meet`, for right sides that a task can hold: a left block sees all right rows at once, so the result is final.

    The kernel gets some left rows and all right ones, in blocks of bounded size and in the order of the first of ``right_keep``; a
    :class:`Total` gets the blocks one by one. Only a few tasks per core are made: each has its own left rows and a copy of the right side, which is all that is shuffled.
    """
    left_count, _ = vector_stats(left, vector)
    count, _ = vector_stats(right, vector)
    parts = _tasks(left, left_count * count, 3)
    kinds = _width(left, vector), _width(right, vector)
    part = F.pmod(F.xxhash64(left_keep[0], vector), F.lit(parts)).cast("int")
    one = F.lit(0)
    placed = right.withColumn("_bucket", one).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    copied = left.withColumn("_part", part).withColumn("_bucket", one)
    names = [field.name for field in schema]

    totals = isinstance(kernel, type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = kernel() if totals else None
        for pieces, streamed in _cells(batches):
            rights: list[Block] = []
            while pieces:
                # Taken off the list, so that what came with the vectors is free again.
                rights += _blocks([pieces.pop(0)], "a_", right_keep, kinds[1], TILE_COLUMNS)
            for piece in streamed:
                for some in _blocks([piece], "b_", left_keep, kinds[0], TILE_ROWS):
                    for other in rights if totals else rights[:1]:
                        _same_width(some, other)
                        if totals:
                            # Units of right rows are made anew each time: kept ones would take twice the memory of the vectors.
                            total.add(some, Block(other.columns, other.matrix))
                    if totals:
                        continue
                    columns = kernel(some, rights)
                    if len(columns[names[0]]):
                        yield pa.RecordBatch.from_arrays([columns[name] for name in names], names)
        if totals:
            columns = total.result()
            yield pa.RecordBatch.from_arrays([columns[name] for name in names], names)

    return _dealt(placed, copied, right_keep, left_keep, vector, parts).mapInArrow(run, schema)


class Held:
    """What a task keeps for a block of held rows while all others pass by; it emits once per block."""

    def __init__(self, held: Block) -> None:
        raise NotImplementedError

    def add(self, start: int, held: Block, other: Block) -> None:
        """Take in a part of the held block, which begins at row ``start``, and a block of others."""
        raise NotImplementedError

    def result(self) -> dict[str, pa.Array]:
        raise NotImplementedError


def pass_by(
    held: DataFrame,
    others: DataFrame,
    held_keep: Sequence[str],
    other_keep: Sequence[str],
    vector: str,
    kernel: type[Held],
    schema: T.StructType,
    rows: int,
) -> DataFrame:
    """Like :func:`meet`, but about ``rows`` held rows see all others in one task, so what is known of them needs no merging.

    Every block of held rows has a copy of the others pass by; keys of the held rows should be distinct.
    """
    held_count, _ = vector_stats(held, vector)
    count, _ = vector_stats(others, vector)
    parts = max(math.ceil(held_count / rows), _tasks(held, held_count * count))
    kinds = _width(held, vector), _width(others, vector)
    placed = held.withColumn("_part", F.pmod(F.xxhash64(held_keep[0]), F.lit(parts)).cast("int")).withColumn("_bucket", F.lit(0))
    copied = others.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("_bucket", F.lit(0))
    names = [field.name for field in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces, streamed in _cells(batches):
            blocks = _blocks(pieces, "a_", held_keep, kinds[0], 2 * rows)
            kept = [kernel(block) for block in blocks]
            for piece in streamed:
                for other in _blocks([piece], "b_", other_keep, kinds[1], 4 * CHUNK_ROWS):
                    for block, state in zip(blocks, kept):
                        _same_width(block, other)
                        start = 0
                        for some in _slices(block, len(other)):
                            state.add(start, some, other)
                            start += len(some)
            for state in kept:
                columns = state.result()
                yield pa.RecordBatch.from_arrays([columns[name] for name in names], names)

    return _dealt(placed, copied, held_keep, other_keep, vector, parts).mapInArrow(run, schema)


def _tasks(df: DataFrame, pairs: int, per_core: int = 8) -> int:
    """Cells that keep all cores busy to the end, if there are pairs enough."""
    return max(1, min(per_core * df.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / CELL_PAIRS)))


def _dealt(a: DataFrame, b: DataFrame, a_keep: Sequence[str], b_keep: Sequence[str], vector: str, cells: int) -> DataFrame:
    """Both sides below each other, cell by cell, the rows of ``a`` first and in the order of their first column."""

    def side(df: DataFrame, number: int) -> DataFrame:
        columns = [F.col("_part"), F.col("_bucket"), F.lit(number).alias("_side")]
        for prefix, keep, source in (("a_", a_keep, a), ("b_", b_keep, b)):
            for name in [*keep, vector]:
                missing = F.lit(None).cast(source.schema[name].dataType)
                columns.append((F.col(name) if source is df else missing).alias(prefix + ("_vector" if name == vector else name)))
        return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(*columns)

    # Some cells share a partition by chance; with more partitions than cells fewer do.
    both = side(a, 0).unionByName(side(b, 1)).repartition(1 if cells == 1 else 2 * cells, "_part", "_bucket")
    return both.sortWithinPartitions("_part", "_bucket", "_side", f"a_{a_keep[0]}")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], Iterator[pa.RecordBatch]]]:
    """For each cell the batches of its first side, and an iterator over those of its second side."""

    def runs() -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            change = np.zeros(batch.num_rows - 1, dtype=bool)
            for mark in marks:
                change |= mark[1:] != mark[:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                yield (int(marks[0][low]), int(marks[1][low])), int(marks[2][low]), batch.slice(low, high - low)

    for _, cell in itertools.groupby(runs(), key=lambda run: run[0]):
        first: list[pa.RecordBatch] = []
        rest: list[pa.RecordBatch] = []
        for _, number, piece in cell:
            if number:
                rest.append(piece)
                break
            first.append(piece)
        yield first, itertools.chain(rest, (piece for _, _, piece in cell))


def _blocks(pieces: list[pa.RecordBatch], prefix: str, keep: Sequence[str], kind: type, rows: int) -> list[Block]:
    """Blocks of up to ``rows`` rows of all pieces."""
    if not pieces:
        return []

    def whole(name: str) -> pa.Array:
        return pa.concat_arrays([piece.column(prefix + name) for piece in pieces])

    matrix = rows_of(whole("_vector")).astype(kind, copy=False)
    columns = {name: whole(name) for name in keep}
    starts = range(0, len(matrix), rows)
    return [Block({name: column.slice(at, rows) for name, column in columns.items()}, matrix[at:at + rows]) for at in starts]


def _same_width(left: Block, right: Block) -> None:
    if left.matrix.shape[1] != right.matrix.shape[1]:
        raise ValueError("vectors differ in dimension")


def grids(left: DataFrame, right: DataFrame, group: str, width: int, cell_bytes: int) -> DataFrame:
    """(``group``, ``_parts``, ``_bands``) of the groups that don't fit one cell: how finely their left and right rows are cut.

    Such a group has more than ``cell_bytes`` of vectors, so there are at most as many as the data has cells.
    """
    per_cell = max(1, cell_bytes // max(1, width))
    sizes = left.select(group, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(group, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    counted = sizes.groupBy(group).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    cut = counted.select(
        group,
        F.ceil(F.col("_l") / F.lit(per_cell)).cast("int").alias("_parts"),
        F.ceil(F.col("_r") / F.lit(per_cell)).cast("int").alias("_bands"),
    )
    return cut.filter("_parts > 1 or _bands > 1")


def meet_in_group(
    left: DataFrame,
    right: DataFrame,
    group: str,
    left_keep: Sequence[str],
    right_keep: Sequence[str],
    vector: str,
    kernel: Kernel,
    schema: T.StructType,
    sort_right: Sequence[str] = (),
    block_rows: int = 4096,
    cell_bytes: int = CELL_BYTES,
    bucket: str | None = None,
) -> DataFrame:
    """Like :func:`meet`, but blocks meet only inside the same group.

    A group larger than ``cell_bytes`` on either side is a grid: its left rows are cut into parts and its right rows into bands, parts
    are copied to every band and bands to every part, and each cell of the grid is a join key of its own. So neither side of a cell is
    larger than that, whatever the group's share of the rows. The number of parts and bands comes from a table of these large groups
    only. Partial results are to be merged by the caller.

    ``bucket`` names a right column; right rows with the same value of it are in one block, if they fit, and not with others.
    """
    valid = F.col(vector).isNotNull() & (F.size(vector) > 0)
    left, right = left.filter(valid), right.filter(valid)
    _, width = vector_stats(right, vector)
    large = materialise(grids(left, right, group, width, cell_bytes))
    # Sizes meet the rows where they are, without a shuffle; beyond the limit by a join that AQE splits.
    large = F.broadcast(large) if large.count() <= MOST_SIZES else large

    def cut(side: DataFrame, mine: str, other: str, spread: Column) -> DataFrame:
        sized = side.join(large, group, "left").withColumn("_other", F.coalesce(other, F.lit(1)))
        return sized.withColumn("_own", F.pmod(F.xxhash64(spread), F.coalesce(mine, F.lit(1))).cast("int")).drop("_parts", "_bands")

    def copied(packed: DataFrame, own: str, other: str, prefix: str) -> DataFrame:
        copies = packed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_other") - 1)))
        return _prefix(copies.withColumnRenamed("_own", own).drop("_other", "_bucket"), prefix, skip=[group, "_part", "_band"])

    placed = cut(right, "_bands", "_parts", F.col(bucket or right_keep[0])).withColumn("_bucket", F.col(bucket) if bucket else F.lit(0))
    stored = placed.repartition(group, "_own").sortWithinPartitions(group, "_own", "_bucket", *(sort_right or [right_keep[0]]))
    packed_right = pack(stored, right_keep, vector, 2 * block_rows if bucket else block_rows, same=[group, "_own", "_other", "_bucket"])
    spread = cut(left, "_parts", "_bands", F.col(left_keep[0])).repartition(group, "_own").sortWithinPartitions(group, "_own")
    packed_left = pack(spread, left_keep, vector, CHUNK_ROWS, same=[group, "_own", "_other"])
    pairs = copied(packed_left, "_part", "_band", "l_").join(copied(packed_right, "_band", "_part", "r_"), [group, "_part", "_band"])
    return run_kernel(
        pairs, left_keep, right_keep, _width(left, vector), _width(right, vector), kernel, schema, same=[group]
    )


def _prefix(df: DataFrame, prefix: str, skip: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in skip else F.col(c).alias(prefix + c) for c in df.columns])


def run_kernel(
    pairs: DataFrame,
    left_keep: Sequence[str],
    right_keep: Sequence[str],
    left_kind: type,
    right_kind: type,
    kernel: Kernel | type[Total],
    schema: T.StructType,
    same: Sequence[str] = (),
) -> DataFrame:
    """Decode both blocks of each row and yield what the kernel makes of them."""
    out_names = [field.name for field in schema]

    def decode(batch: pa.RecordBatch, row: int, prefix: str, keep: Sequence[str], kind: type) -> Block:
        def cell(name: str) -> pa.Scalar:
            return batch.column(batch.schema.get_field_index(prefix + name))[row]

        count = cell("_rows").as_py()
        data = np.frombuffer(cell("_matrix").as_buffer(), dtype=kind)
        return Block({name: cell(name).values for name in keep}, data.reshape(count, -1))

    totals = isinstance(kernel, type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = kernel() if totals else None
        for batch in batches:
            for row in range(batch.num_rows):
                left = decode(batch, row, "l_", left_keep, left_kind)
                right = decode(batch, row, "r_", right_keep, right_kind)
                _same_width(left, right)
                scalars = {
                    name: batch.column(batch.schema.get_field_index(name)).slice(row, 1) for name in same
                }
                for part in _slices(left, len(right)):
                    if totals:
                        total.add(part, right)
                        continue
                    columns = dict(kernel(part, right))
                    size = len(next(iter(columns.values())))
                    if not size:
                        continue
                    for name, value in scalars.items():
                        columns[name] = value.take(pa.array(np.zeros(size, dtype=np.int64)))
                    yield pa.RecordBatch.from_arrays([columns[name] for name in out_names], out_names)
        if totals:
            columns = total.result()
            yield pa.RecordBatch.from_arrays([columns[name] for name in out_names], out_names)

    return pairs.mapInArrow(run, schema)


def _slices(block: Block, other: int) -> Iterator[Block]:
    """Parts of the left block whose product with the right block fits in memory."""
    step = max(1, _PRODUCT_CELLS // max(1, other))
    if step >= len(block):
        yield block
        return
    for start in range(0, len(block), step):
        size = min(step, len(block) - start)
        yield Block(
            {name: column.slice(start, size) for name, column in block.columns.items()},
            block.matrix[start:start + size],
        )


def rows_at_a_time(block: Block, rows: int, first: int = 0) -> Iterator[Block]:
    """The block from row ``first`` on, in parts of up to ``rows`` rows."""
    for at in range(first, len(block), rows):
        yield Block({name: column.slice(at, rows) for name, column in block.columns.items()}, block.matrix[at:at + rows])


def micro_cosines(left: Block, right: Block) -> np.ndarray:
    """Cosines rounded to six places, as integers.

    Integers make equal scores equal on every machine, so ranks and thresholds do
    not depend on the order in which a matrix product adds up.
    """
    return np.rint(left.unit @ right.unit.T * MICRO).astype(np.int64)


def top_cells(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores per row, best first, lower column on ties."""
    width = scores.shape[1]
    unique = scores * width + (width - 1 - np.arange(width))
    k = min(k, width)
    if k < width:
        chosen = np.argpartition(-unique, k - 1, axis=1)[:, :k]
    else:
        chosen = np.broadcast_to(np.arange(width), scores.shape)
    order = np.argsort(-np.take_along_axis(unique, chosen, axis=1), axis=1)
    return np.take_along_axis(chosen, order, axis=1)


def top_products(products: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, places, columns, scores) of the k highest six-place scores per row, as :func:`top_cells` orders them.

    Cells of minus infinity are left out. The k-th highest of every 16th column is a bound that few cells reach; only those are ordered.
    """
    sample = products[:, ::16]
    bound = np.full(len(products), -np.inf)
    if sample.shape[1] > 2 * k:
        at = sample.shape[1] - k
        bound = (np.rint(np.partition(sample, at, axis=1)[:, at] * MICRO) - 0.75) / MICRO
    rows, columns = np.nonzero((products >= bound[:, None]) & (products > -np.inf))
    scores = np.rint(products[rows, columns] * MICRO).astype(np.int64)
    rows, columns, scores, places = best_cells(rows, columns, scores, k)
    return rows, places, columns, scores


def best_cells(rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, scores, places) of the k highest scores per row, best first, lower column on ties."""
    if not len(rows):
        return rows, columns, scores, rows
    if rows.max() < 1 << 12 and columns.max() < 1 << 29:
        # One number for row, falling score and column: sorted several times as fast as three.
        keys = np.sort(rows << 51 | (2 * MICRO - scores) << 29 | columns)
        rows, columns, scores = keys >> 51, keys & (1 << 29) - 1, 2 * MICRO - (keys >> 29 & (1 << 22) - 1)
    else:
        order = np.lexsort((columns, -scores, rows))
        rows, columns, scores = rows[order], columns[order], scores[order]
    places = np.arange(len(rows)) - np.searchsorted(rows, rows)
    kept = places < k
    return rows[kept], columns[kept], scores[kept], places[kept]


def same_keys(left: Block, right: Block, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells in which both sides are the same row; keys must be unique."""
    places = pa.compute.index_in(left.columns[key], value_set=right.columns[key])
    rows = np.flatnonzero(np.asarray(places.is_valid()))
    return rows, places.drop_null().to_numpy()
