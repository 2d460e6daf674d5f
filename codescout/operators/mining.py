"""Hard and easy negatives for queries, and the training triplets made from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescout.functions.draws import MODULUS, draw_number, low_pairs, pair_draws
from codescout.functions.vectors import cosine
from codescout.operators import blocks
from codescout.operators.retrieval import exclusion_mask, nearest
from codescout.operators.running import row_numbers
from codescout.session import materialise

_LOWEST = -2 * blocks.MICRO
# A pool up to this size is one block, so that percentiles need a single pass.
WHOLE_POOL_BYTES = 64 << 20
#: Queries that a task holds while the pool passes by: 32 MB of counts for the first digits, as much again for each percentile.
HELD_ROWS = 4096
#: Queries whose pool is counted at a time, and codes of it that say between which cosines their percentiles lie.
HELD_IN_POOL, _PIVOTS = 512, 32768
#: In place of a product that is no number: below all others.
_NO_NUMBER = -3.0
#: How many times the negatives asked for are looked at, in the order of the draws.
LOOKED_AT = 12


def trim_positives(df: DataFrame, k: int = 5, column: str = "positives") -> DataFrame:
    """Drop empty positives, keep the first k, and drop queries left with none."""
    kept = F.slice(F.filter(column, lambda item: item != ""), 1, k)
    return df.withColumn(column, kept).filter(F.size(column) > 0)


# --- percentiles of all candidates ---------------------------------------------------------


def one_row_each(df: DataFrame, key: str) -> DataFrame:
    """One row per key; of several the smallest in the order of the other columns, so that the choice is always the same."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(key, "_row.*")


def similarity_percentiles(
    queries: DataFrame,
    pool: DataFrame,
    percents: Sequence[int] = (70, 90),
    key: str = "query",
    code_key: str = "code",
    vector: str = "embedding",
    exclude: str | None = "positives",
    **limits: int,
) -> DataFrame:
    """Linear percentiles of the cosines of each query to all its candidates.

    A small pool is sorted per query in the task. One that a task can hold passes by its
    queries once: a part of it says between which cosines a percentile must lie, all of it
    is counted, and only what lies between is ordered (a query whose percentile lies
    elsewhere after all has its whole pool ordered). A pool beyond that passes twice by the
    queries that a task holds and is counted by digits of the six-place cosine, so the
    exact value is found from a few thousand counts per query, whatever the size of the
    pool, and no count leaves the task. Columns ``p70`` ... and ``candidates``.
    """
    in_task = blocks.fits_task(pool, vector, **limits)
    limits = {"block_bytes": WHOLE_POOL_BYTES, **{name: value for name, value in limits.items() if name != "task_bytes"}}
    queries = one_row_each(queries, key)
    keep = [key] + ([exclude] if exclude else [])
    names = [f"p{p}" for p in percents]
    query_field = T.StructField(key, queries.schema[key].dataType)

    def scored(left: blocks.Block, right: blocks.Block) -> tuple[np.ndarray, np.ndarray]:
        scores = blocks.micro_cosines(left, right)
        barred = exclusion_mask(left, right, exclude, code_key) if exclude else None
        return scores, np.zeros(scores.shape, dtype=bool) if barred is None else barred

    def whole(left: blocks.Block, right: blocks.Block) -> dict[str, pa.Array]:
        scores, barred = scored(left, right)
        ordered = np.sort(np.where(barred, _LOWEST, scores), axis=1)
        skipped = barred.sum(axis=1)
        counts = scores.shape[1] - skipped
        rows = np.arange(len(scores))
        out = {key: left.columns[key], "candidates": pa.array(counts.astype(np.int64))}
        for percent, name in zip(percents, names):
            place = percent / 100 * np.maximum(counts - 1, 0)
            low, high = np.floor(place).astype(int) + skipped, np.ceil(place).astype(int) + skipped
            last = scores.shape[1] - 1
            a = ordered[rows, np.minimum(low, last)] / blocks.MICRO
            b = ordered[rows, np.minimum(high, last)] / blocks.MICRO
            out[name] = pa.array(np.round(a + (b - a) * (place - np.floor(place)), 9), mask=counts == 0)
        return out

    schema = T.StructType(
        [query_field, T.StructField("candidates", T.LongType())]
        + [T.StructField(name, T.DoubleType()) for name in names]
    )

    def of_all(left: blocks.Block, rights: list[blocks.Block]) -> dict[str, pa.Array]:
        def barred_in(some: blocks.Block, other: blocks.Block) -> np.ndarray | None:
            return exclusion_mask(some, other, exclude, code_key) if exclude else None

        parts = [_percentiles_of_all(some, rights, percents, barred_in) for some in blocks.rows_at_a_time(left, HELD_IN_POOL)]
        counts = np.concatenate([x for x, _ in parts])
        values = np.concatenate([x for _, x in parts])
        out = {key: left.columns[key], "candidates": pa.array(counts)}
        return out | {name: pa.array(values[:, i], mask=counts == 0) for i, name in enumerate(names)}

    if in_task:
        result, n_blocks = blocks.beside(queries, pool, keep, [code_key], vector, of_all, schema), 1
    else:
        result, n_blocks = blocks.meet(queries, pool, keep, [code_key], vector, whole, schema, **limits)
    if n_blocks == 1:
        # Queries without a vector meet no block; they have no candidates here as well.
        return (
            queries.select(key)
            .distinct()
            .join(result, key, "left")
            .select(key, F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"), *names)
        )

    # Cosines as integers 0 .. 2 000 000, split into a high and a low digit of base 1024.
    base, shift = 1024, 10
    width = (2 * blocks.MICRO >> shift) + 1

    def shifted(left: blocks.Block, right: blocks.Block) -> tuple[np.ndarray, np.ndarray]:
        scores, barred = scored(left, right)
        return scores + blocks.MICRO, barred

    def places(counts: np.ndarray) -> np.ndarray:
        return np.array(percents)[None, :] / 100 * np.maximum(counts - 1, 0)[:, None]

    class HighDigits(blocks.Held):
        """Counts of the high digit; the result says in which one each of the wanted ranks is, and how many scores are below it."""

        def __init__(self, held: blocks.Block) -> None:
            self.held, self.counts = held, np.zeros((len(held), width), np.int32)

        def add(self, start: int, held: blocks.Block, other: blocks.Block) -> None:
            scores, barred = shifted(held, other)
            flat = (scores >> shift) + np.arange(len(held))[:, None] * width
            found = np.bincount(flat[~barred] if barred.any() else flat.ravel(), minlength=len(held) * width)
            self.counts[start:start + len(held)] += found.reshape(len(held), width).astype(np.int32)

        def result(self) -> dict[str, pa.Array]:
            total = self.counts.sum(axis=1, dtype=np.int64)
            place = places(total)
            ranks = np.concatenate([np.floor(place), np.ceil(place)], axis=1).astype(np.int64)
            digits, before = np.zeros(ranks.shape, np.int64), np.zeros(ranks.shape, np.int64)
            for row, counts in enumerate(self.counts):
                upto = np.cumsum(counts, dtype=np.int64)
                digits[row] = np.minimum(np.searchsorted(upto, ranks[row], side="right"), width - 1)
                before[row] = upto[digits[row]] - counts[digits[row]]
            listed = [pa.ListArray.from_arrays(pa.array(np.arange(len(ranks) + 1) * ranks.shape[1], pa.int32()), x.ravel()) for x in (digits, ranks - before)]
            return {key: self.held.columns[key], "candidates": pa.array(total), "_digits": listed[0], "_ranks": listed[1]}

    long_list = T.ArrayType(T.LongType())
    fields = [query_field, T.StructField("candidates", T.LongType())]
    high_schema = T.StructType([*fields, T.StructField("_digits", long_list), T.StructField("_ranks", long_list)])
    high = materialise(blocks.pass_by(queries, pool, keep, [code_key], vector, HighDigits, high_schema, HELD_ROWS))

    class LowDigits(blocks.Held):
        """Counts of the low digit of scores with a wanted high one, and the percentiles that follow."""

        def __init__(self, held: blocks.Block) -> None:
            self.held = held
            self.digits, self.ranks = (held.columns[c].flatten().to_numpy().reshape(len(held), -1) for c in ("_digits", "_ranks"))
            # Ranks with the same high digit share a slot; slots without use have a digit that no score has.
            ordered = np.sort(self.digits, axis=1)
            new = np.concatenate([np.ones((len(held), 1), bool), ordered[:, 1:] != ordered[:, :-1]], axis=1)
            slot = np.cumsum(new, axis=1) - 1
            self.wanted = np.full((len(held), slot.max() + 1), -1)
            np.put_along_axis(self.wanted, slot, ordered, axis=1)
            self.counts = np.zeros((*self.wanted.shape, base), np.int32)

        def add(self, start: int, held: blocks.Block, other: blocks.Block) -> None:
            scores, barred = shifted(held, other)
            digits = scores >> shift
            if barred.any():
                digits[barred] = -2
            stop = start + len(held)
            for slot, wanted in enumerate(self.wanted[start:stop].T):
                if wanted.max() < 0:
                    continue
                rows, columns = np.nonzero(digits == wanted[:, None])
                flat = rows * base + (scores[rows, columns] & base - 1)
                self.counts[start:stop, slot] += np.bincount(flat, minlength=len(held) * base).reshape(-1, base).astype(np.int32)

        def result(self) -> dict[str, pa.Array]:
            counts = self.held.columns["candidates"].to_numpy()
            values = np.zeros(self.digits.shape, np.int64)
            for row, (digits, ranks) in enumerate(zip(self.digits, self.ranks)):
                upto = np.cumsum(self.counts[row], axis=1, dtype=np.int64)
                for i, slot in enumerate(np.searchsorted(self.wanted[row][self.wanted[row] >= 0], digits)):
                    values[row, i] = digits[i] * base + np.searchsorted(upto[slot], ranks[i], side="right") - blocks.MICRO
            place, (a, b) = places(counts), np.split(values / blocks.MICRO, 2, axis=1)
            exact = np.round(a + (b - a) * (place - np.floor(place)), 9)
            out = {key: self.held.columns[key], "candidates": self.held.columns["candidates"]}
            return out | {name: pa.array(exact[:, i], mask=counts == 0) for i, name in enumerate(names)}

    marked = queries.join(high, key)
    exact = blocks.pass_by(marked, pool, [*keep, "candidates", "_digits", "_ranks"], [code_key], vector, LowDigits, schema, HELD_ROWS)
    return (
        queries.select(key)
        .distinct()
        .join(exact, key, "left")
        .select(key, F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"), *names)
    )


def _percentiles_of_all(
    left: blocks.Block,
    rights: list[blocks.Block],
    percents: Sequence[int],
    barred_in: Callable[[blocks.Block, blocks.Block], np.ndarray | None],
) -> tuple[np.ndarray, np.ndarray]:
    """Candidates and percentiles of each left row over all right ones, exact.

    Rounding keeps the order, so it is products that are compared, and only those that are chosen are rounded.
    """

    finite = np.isfinite(left.unit).all()

    def products_with(some: np.ndarray, unit: np.ndarray, barred: np.ndarray | None) -> np.ndarray:
        products = some @ unit.T
        if not finite or not np.isfinite(unit.sum()):
            products[np.isnan(products)] = _NO_NUMBER
        if barred is not None:
            products[barred] = -np.inf
        return products

    total = sum(map(len, rights))
    # Between these products the percentiles lie, but for one case in ten thousand.
    every = max(1, total // min(_PIVOTS, max(2048, total // 16)))
    some_rights = blocks.unit_rows(np.concatenate([b.matrix[::every] for b in rights]))
    count = len(some_rights)
    shares = np.array(percents) / 100
    slack = 4 * np.sqrt(count * shares * (1 - shares)) + 2
    at = np.stack([np.floor(shares * (count - 1) - slack), np.ceil(shares * (count - 1) + slack)]).astype(int)
    kept = np.clip(at, 0, count - 1)
    low, high = (np.zeros((len(percents), len(left))) for _ in range(2))
    for start in range(0, len(left), 64):
        ordered = np.partition(left.unit[start:start + 64] @ some_rights.T, np.unique(kept), axis=1)
        low[:, start:start + 64], high[:, start:start + 64] = ordered[:, kept[0]].T, ordered[:, kept[1]].T
    low[at[0] < 0], high[at[1] > count - 1] = -2.0, 2.0

    skipped, below = np.zeros(len(left), np.int64), np.zeros((len(percents), len(left)), np.int64)
    slices = [slice(at, at + blocks.PRODUCT_ROWS) for at in range(0, len(left), blocks.PRODUCT_ROWS)]
    between: list[list[list[tuple[np.ndarray, np.ndarray]]]] = [[[] for _ in percents] for _ in slices]
    for other in rights:
        unit, barred = blocks.unit_rows(other.matrix), barred_in(left, other)
        if barred is not None:
            skipped += barred.sum(axis=1)
        for number, some in enumerate(slices):
            products = products_with(left.unit[some], unit, None if barred is None else barred[some])
            for i in range(len(percents)):
                under = products < low[i][some, None]
                below[i][some] += np.count_nonzero(under, axis=1)
                inside = (products <= high[i][some, None]) ^ under
                found = np.rint(products.ravel()[np.flatnonzero(inside)] * blocks.MICRO).astype(np.int32)
                between[number][i].append((found, np.cumsum([0, *np.count_nonzero(inside, axis=1)])))

    counts = total - skipped
    values = np.zeros((len(left), len(percents)))
    for i, share in enumerate(shares):
        place = share * np.maximum(counts - 1, 0)
        for row in np.flatnonzero(counts):
            wanted = np.array([np.floor(place[row]), np.ceil(place[row])], np.int64) + skipped[row] - below[i][row]
            number, place_in = divmod(int(row), blocks.PRODUCT_ROWS)
            mine = np.concatenate([found[ends[place_in]:ends[place_in + 1]] for found, ends in between[number][i]])
            if wanted[0] < 0 or wanted[1] >= len(mine):
                alone = next(blocks.rows_at_a_time(left, 1, int(row)))
                mine = np.concatenate([products_with(alone.unit, blocks.unit_rows(b.matrix), barred_in(alone, b))[0] for b in rights])
                wanted += below[i][row]
                mine = np.rint(np.partition(mine, wanted) * blocks.MICRO)
            else:
                mine = np.partition(mine, wanted)
            a, b = mine[wanted] / blocks.MICRO
            values[row, i] = np.round(a + (b - a) * (place[row] - np.floor(place[row])), 9)
    return counts, values


# --- selection -------------------------------------------------------------------------------


def _with_quotas(rows: DataFrame, num: int) -> DataFrame:
    """Up to half hard ones and the rest easy ones by draw; nothing is refilled.

    ``rows`` is (query, code, kind, draw, similarity), bounded per query.
    """
    of_query = Window.partitionBy("query")
    by_draw = Window.partitionBy("query", "kind").orderBy("draw", "code")
    hard = F.least(F.count_if(F.col("kind") == "hard").over(of_query), F.lit(num // 2))
    quota = (
        F.when(F.col("kind") == "hard", F.lit(num // 2))
        .when(F.col("kind") == "easy", F.lit(num) - F.col("_hard"))
        .otherwise(F.lit(num))
    )
    placed = rows.withColumn("_hard", hard).withColumn("_place", F.row_number().over(by_draw))
    return placed.filter(F.col("_place") <= quota).select("query", "code", "kind", "similarity")


def mine_negatives_topk(
    queries: DataFrame,
    pool: DataFrame,
    num: int = 50,
    percentile: float = 0.7,
    seed: int = 42,
    **limits: int,
) -> DataFrame:
    """Negatives from the ``10 * num`` candidates nearest to each query.

    ``queries`` is (query, positives, embedding), ``pool`` (code, embedding); the
    candidates are the codes that are not positive. Candidates at or above the
    percentile are hard, the others easy. A query with fewer than ``num`` candidates
    gets all of them. Returns (query, code, kind, similarity).
    """
    queries = one_row_each(queries, "query")
    codes = pool.select("code").distinct()
    pool_size = codes.count()
    positives = queries.select("query", F.explode(F.array_distinct("positives")).alias("code"))
    known = positives.join(codes, "code", "left_semi").groupBy("query").agg(F.count("*").alias("_known"))
    free = F.lit(pool_size) - F.coalesce("_known", F.lit(0))
    counted = queries.join(known, "query", "left").withColumn("_free", free).drop("_known")
    asked = counted.filter(F.col("_free") >= num).drop("_free")
    scarce = None
    longest = queries.agg(F.max(F.size("positives"))).first()[0] or 0
    if 0 < pool_size < num + longest:
        # A scarce query meets every code, by number: fewer than ``num`` and as many as it has positives.
        numbered = row_numbers(codes, [F.col("code").asc()], "_place")
        every = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(pool_size).cast("long"))).alias("_place")
        met = counted.filter(F.col("_free") < num).select("query", "positives", every).join(numbered, "_place")
        scarce = met.filter(~F.coalesce(F.array_contains("positives", F.col("code")), F.lit(False))).select(
            "query", "code", F.lit("all").alias("kind"), F.lit(None).cast("double").alias("similarity")
        )
    drawn = asked.withColumn("draw", draw_number(seed, F.col("query")))
    drawn_pool = pool.withColumn("draw", draw_number(seed, F.col("code")))
    near = nearest(drawn, drawn_pool, 10 * num, ["query"], "code", "embedding", "positives", "draw", **limits)
    cut = F.round(F.percentile("similarity", percentile).over(Window.partitionBy("query")), 9)
    kind = F.when(F.col("similarity") >= F.col("_cut"), "hard").otherwise("easy")
    picked = _with_quotas(near.withColumn("_cut", cut).withColumn("kind", kind), num)
    return picked if scarce is None else picked.unionByName(scarce)


def mine_negatives_band(
    queries: DataFrame,
    pool: DataFrame,
    num: int = 50,
    low: int = 70,
    high: int = 90,
    seed: int = 42,
    **limits: int,
) -> DataFrame:
    """Negatives by percentiles over all candidates that have a vector.

    Hard ones lie in [low, high), easy ones below low, none above. With fewer than
    ``num`` candidates all are returned. First the exact percentiles, then a second
    pass in which every block keeps only the best draws. That pass looks at pairs
    with low draws alone, as many as hold the wanted ones as a rule, and only their
    cosines are taken; queries for which they were too few have all draws looked at.
    """
    cuts = similarity_percentiles(queries, pool, (low, high), **limits)
    sizes = {name: value for name, value in limits.items() if name != "task_bytes"}
    marked = materialise(
        one_row_each(queries, "query").join(cuts, "query").withColumn("draw", draw_number(seed, F.col("query")))
    )
    drawn_pool = pool.withColumn("draw", draw_number(seed, F.col("code")))
    keep = ["query", "positives", "draw", "candidates", f"p{low}", f"p{high}"]
    schema = T.StructType(
        [
            T.StructField("query", queries.schema["query"].dataType),
            T.StructField("code", pool.schema["code"].dataType),
            T.StructField("kind", T.StringType()),
            T.StructField("draw", T.LongType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )

    def kernel(left: blocks.Block, right: blocks.Block) -> dict[str, pa.Array]:
        scores = blocks.micro_cosines(left, right)
        barred = exclusion_mask(left, right, "positives", "code")
        candidate = np.ones(scores.shape, dtype=bool) if barred is None else ~barred
        similarity = scores / blocks.MICRO
        counts = left.columns["candidates"].to_numpy(zero_copy_only=False)
        bottom = left.columns[f"p{low}"].fill_null(0.0).to_numpy(zero_copy_only=False)[:, None]
        top = left.columns[f"p{high}"].fill_null(0.0).to_numpy(zero_copy_only=False)[:, None]
        mine, other = (b.columns["draw"].to_numpy(zero_copy_only=False) for b in (left, right))
        draws = pair_draws(mine[:, None], other[None, :])
        scarce = (counts < num)[:, None]
        kinds = {
            "all": (candidate & scarce, num),
            "hard": (candidate & ~scarce & (similarity >= bottom) & (similarity < top), num // 2),
            "easy": (candidate & ~scarce & (similarity < bottom), num),
        }
        rows, columns, labels = [], [], []
        for kind, (member, quota) in kinds.items():
            if not quota or not member.any():
                continue
            chosen = blocks.top_cells(np.where(member, -draws, -(1 << 40)), quota)
            r, place = np.nonzero(np.take_along_axis(member, chosen, axis=1))
            rows.append(r)
            columns.append(chosen[r, place])
            labels += [kind] * len(r)
        rows = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        columns = np.concatenate(columns) if columns else np.zeros(0, dtype=np.int64)
        return {
            "query": left.columns["query"].take(pa.array(rows)),
            "code": right.columns["code"].take(pa.array(columns)),
            "kind": pa.array(labels, pa.string()),
            "draw": pa.array(draws[rows, columns]),
            "similarity": pa.array(similarity[rows, columns]),
        }

    def all_draws(asked: DataFrame) -> DataFrame:
        return blocks.meet(asked, drawn_pool, keep, ["code", "draw"], "embedding", kernel, schema, **sizes)[0]

    size, _ = blocks.vector_stats(drawn_pool, "embedding")
    if size <= 16 * LOOKED_AT * num:
        return _with_quotas(all_draws(marked), num)
    upto = MODULUS * LOOKED_AT * num // size

    def low_cells(left: blocks.Block, right: blocks.Block) -> dict[str, np.ndarray | pa.Array]:
        mine, other = (b.columns["draw"].to_numpy(zero_copy_only=False) for b in (left, right))
        rows, columns = low_pairs(mine, other, upto)
        draws = pair_draws(mine[rows], other[columns])
        barred = exclusion_mask(left, right, "positives", "code")
        cosines = np.einsum("ij,ij->i", left.unit[rows], blocks.unit_rows(right.matrix[columns]))
        similarity = np.rint(cosines * blocks.MICRO) / blocks.MICRO
        bottom, top = (left.columns[f"p{p}"].fill_null(0.0).to_numpy(zero_copy_only=False)[rows] for p in (low, high))
        member = (similarity < top) & (np.ones(len(rows), bool) if barred is None else ~barred[rows, columns])
        code = right.columns["code"].take(pa.array(columns[member]))
        return {"row": rows[member], "code": code, "draw": draws[member], "similarity": similarity[member], "kind": (similarity >= bottom)[member]}

    def named(left: blocks.Block, rows: np.ndarray, codes: pa.Array, draws: np.ndarray, similarity: np.ndarray, hard: np.ndarray) -> dict[str, pa.Array]:
        return {
            "query": left.columns["query"].take(pa.array(rows)),
            "code": codes,
            "kind": pa.array(np.where(hard, "hard", "easy"), pa.string()),
            "draw": pa.array(draws),
            "similarity": pa.array(similarity),
        }

    def low_draws(left: blocks.Block, right: blocks.Block) -> dict[str, pa.Array]:
        x = low_cells(left, right)
        return named(left, x["row"], x["code"], x["draw"], x["similarity"], x["kind"])

    def low_draws_of_all(left: blocks.Block, rights: list[blocks.Block]) -> dict[str, pa.Array]:
        """The first ones of every query and kind: it sees all its pairs."""
        found = [[x[c] for c in ("row", "draw", "similarity", "kind", "code")] for x in (low_cells(left, right) for right in rights)]
        codes = pa.concat_arrays([x[-1] for x in found])
        rows, draws, similarity, hard = (np.concatenate(x) for x in list(zip(*found))[:-1])
        # Codes come in order, so equal draws stay in that of their codes.
        order = np.lexsort((draws, hard, rows))
        group = rows[order] * 2 + hard[order]
        order = order[np.arange(len(order)) - np.searchsorted(group, group) < num]
        return named(left, rows[order], codes.take(pa.array(order)), draws[order], similarity[order], hard[order])

    plenty = marked.filter(F.col("candidates") >= num)
    if blocks.fits_task(drawn_pool, "embedding", **limits):
        parts = blocks.beside(plenty, drawn_pool, keep, ["code", "draw"], "embedding", low_draws_of_all, schema)
    else:
        parts, _ = blocks.meet(plenty, drawn_pool, keep, ["code", "draw"], "embedding", low_draws, schema, **sizes)
    picked = materialise(_with_quotas(parts, num))
    # All hard ones and the rest easy ones: then nothing with a higher draw is among the first.
    hard, easy = F.count_if(F.col("kind") == "hard"), F.count_if(F.col("kind") == "easy")
    done = picked.groupBy("query").agg(hard.alias("_hard"), easy.alias("_easy")).filter(f"_hard = {num // 2} and _easy = {num - num // 2}")
    open_ends = materialise(marked.join(done, "query", "left_anti"))
    picked = picked.join(done, "query", "left_semi")
    return picked if open_ends.isEmpty() else picked.unionByName(_with_quotas(all_draws(open_ends), num))


def negative_candidates(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """How many codes of the pool are left for each query once its positives are taken out."""
    codes = pool.select("code").distinct()
    total = codes.agg(F.count("*").alias("_n"))
    hits = (
        queries.select("query", F.explode(F.array_distinct("positives")).alias("code"))
        .join(codes, "code", "left_semi")
        .groupBy("query")
        .agg(F.count("*").alias("_hits"))
    )
    size = total.first()["_n"]
    return (
        queries.select("query")
        .distinct()
        .join(hits, "query", "left")
        .select("query", (F.lit(size) - F.coalesce("_hits", F.lit(0))).alias("candidates"))
    )


def build_triplets(
    queries: DataFrame, pool: DataFrame, top_k: int = 5, num: int = 50, seed: int = 42, **limits: int
) -> DataFrame:
    """Anchor, positives and mined negatives as lists, one row per specialty and query.

    ``queries`` is (specialty, query, positives, embedding). A query without a vector
    is left out; one for which nothing could be mined keeps an empty list.
    """
    ready = trim_positives(queries, top_k).filter(F.col("embedding").isNotNull())
    mined = mine_negatives_topk(
        ready.select("query", "positives", "embedding"), pool, num, seed=seed, **limits
    )
    negatives = mined.groupBy("query").agg(F.sort_array(F.collect_list("code")).alias("negatives"))
    empty = F.array().cast(T.ArrayType(pool.schema["code"].dataType))
    return ready.join(negatives, "query", "left").select(
        "specialty",
        F.col("query").alias("anchor"),
        "positives",
        F.coalesce("negatives", empty).alias("negatives"),
    )


def explode_triplets(triplets: DataFrame) -> DataFrame:
    """One row per positive and negative of a triplet."""
    return triplets.select(
        "specialty", "anchor", F.explode("positives").alias("positives"), "negatives"
    ).select("specialty", "anchor", "positives", F.explode("negatives").alias("negatives"))


# --- checking triplets -------------------------------------------------------------------------


def triplet_embeddings(triplets: DataFrame, embeddings: DataFrame, key: str = "key", vector: str = "embedding") -> DataFrame:
    """Attach the vectors of anchor, positive and negative text."""
    table = embeddings.select(key, vector)
    out = triplets
    for role in ("anchor", "positives", "negatives"):
        side = table.select(F.col(key).alias(role), F.col(vector).alias(f"{role}_embedding"))
        out = out.join(side, role, "left")
    return out


def triplet_accuracy(
    triplets: DataFrame,
    embeddings: DataFrame,
    key: str = "key",
    vector: str = "embedding",
    first: int | None = None,
) -> DataFrame:
    """Share of triplets whose positive is nearer to the anchor than the negative.

    Distinct (anchor, other) pairs are scored once: the list form of triplets repeats
    each positive with every negative and the other way round. ``first`` restricts the
    report to that many triplets in the order of their texts. The triplets are read
    twice, so they should be a stored table.
    """
    if first is not None:
        triplets = triplets.orderBy("anchor", "positives", "negatives").limit(first)
    table = embeddings.select(key, vector)
    anchors = table.select(F.col(key).alias("anchor"), F.col(vector).alias("_a"))
    others = table.select(F.col(key).alias("other"), F.col(vector).alias("_b"))
    pairs = (
        triplets.select("anchor", F.explode(F.array("positives", "negatives")).alias("other")).distinct()
    )
    scored = pairs.join(anchors, "anchor").join(others, "other").select(
        "anchor", "other", F.round(cosine("_a", "_b"), 6).alias("_s")
    )
    result = triplets.join(
        scored.select("anchor", F.col("other").alias("positives"), F.col("_s").alias("_positive")),
        ["anchor", "positives"],
    ).join(
        scored.select("anchor", F.col("other").alias("negatives"), F.col("_s").alias("_negative")),
        ["anchor", "negatives"],
    )
    return result.agg(
        F.count("*").alias("triplets"),
        F.round(F.avg((F.col("_positive") > F.col("_negative")).cast("double")), 6).alias("accuracy"),
    )
