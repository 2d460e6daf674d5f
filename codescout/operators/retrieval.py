"""Nearest codes for queries, and reports over the matches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescout.functions.draws import pair_draws
from codescout.operators import blocks


def top_k_codes(
    queries: DataFrame,
    codes: DataFrame,
    k: int = 10,
    query_keys: Sequence[str] = ("query",),
    code_key: str = "code",
    vector: str = "embedding",
    exclude: str | None = None,
    **limits: int,
) -> DataFrame:
    """The k codes of highest cosine for each distinct query, best first.

    Returns ``query_keys, code_key, similarity, rank``; similarity has six places
    and equal ones are ranked by code. Fewer than k codes give all of them.
    ``exclude`` names an array column of codes a query must not be matched with.
    """
    keys = list(query_keys)
    left = queries.select(*keys, *([exclude] if exclude else []), vector).dropDuplicates(keys)
    return nearest(left, codes, k, keys, code_key, vector, exclude, **limits)


def nearest(
    queries: DataFrame,
    codes: DataFrame,
    k: int,
    keys: list[str],
    code_key: str,
    vector: str,
    exclude: str | None = None,
    chance: str | None = None,
    **limits: int,
) -> DataFrame:
    """:func:`top_k_codes` over queries with unique keys.

    ``chance`` names a column of draw numbers on both sides; the random order of each
    pair then comes out in a column of that name.
    """
    if k < 1:
        raise ValueError("k must be positive")
    keep = keys + ([exclude] if exclude else []) + ([chance] if chance else [])
    schema = T.StructType(
        [T.StructField(name, queries.schema[name].dataType) for name in keys]
        + [
            T.StructField(code_key, codes.schema[code_key].dataType),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("rank", T.IntegerType()),
        ]
        + ([T.StructField(chance, T.LongType())] if chance else [])
    )

    def kernel(left_block: blocks.Block, right_block: blocks.Block) -> dict[str, pa.Array]:
        products = left_block.unit @ right_block.unit.T
        barred = exclusion_mask(left_block, right_block, exclude, code_key) if exclude else None
        # A product that is not a number has no place among the best.
        products[np.isnan(products) if barred is None else barred | np.isnan(products)] = -np.inf
        rows, places, columns, scores = blocks.top_products(products, k)
        out = {name: left_block.columns[name].take(pa.array(rows)) for name in keys}
        out[code_key] = right_block.columns[code_key].take(pa.array(columns))
        out["similarity"] = pa.array(scores / blocks.MICRO)
        out["rank"] = pa.array((places + 1).astype(np.int32))
        if chance:
            mine, other = (b.columns[chance].to_numpy(zero_copy_only=False) for b in (left_block, right_block))
            out[chance] = pa.array(pair_draws(mine[rows], other[columns]))
        return out

    def of_all(left_block: blocks.Block, rights: list[blocks.Block]) -> dict[str, pa.Array]:
        """The best of all right rows: only cells above the k-th best so far are looked at."""
        rows, columns, scores = (np.zeros(0, np.int64) for _ in range(3))
        bound, new, waiting = _lowest_of_best(left_block, rights, k, exclude), [], 0
        starts = np.cumsum([0, *map(len, rights)])
        for start, right_block in zip(starts, rights):
            unit = blocks.unit_rows(right_block.matrix)
            barred = exclusion_mask(left_block, right_block, exclude, code_key) if exclude else None
            for at in range(0, len(left_block), blocks.PRODUCT_ROWS):
                some = slice(at, at + blocks.PRODUCT_ROWS)
                products = left_block.unit[some] @ unit.T
                if barred is not None:
                    products[barred[some]] = -np.inf
                cells = np.flatnonzero(products >= bound[some, None])
                values = products.ravel()[cells]
                if len(cells) and values.min() == -np.inf:
                    cells, values = cells[values > -np.inf], values[values > -np.inf]
                new.append((cells // len(unit) + at, cells % len(unit) + start, np.rint(values * blocks.MICRO).astype(np.int64)))
                waiting += len(cells)
            if waiting > k * len(left_block):
                rows, columns, scores = (np.concatenate(x) for x in zip((rows, columns, scores), *new))
                rows, columns, scores, places = blocks.best_cells(rows, columns, scores, k)
                new, waiting = [], 0
                last = places == k - 1
                # Equal scores further on lose to the ones there.
                bound[rows[last]] = (scores[last] + 0.25) / blocks.MICRO
        rows, columns, scores = (np.concatenate(x) for x in zip((rows, columns, scores), *new))
        rows, columns, scores, places = blocks.best_cells(rows, columns, scores, k)
        out = {name: left_block.columns[name].take(pa.array(rows)) for name in keys}
        out[code_key] = pa.chunked_array([b.columns[code_key] for b in rights]).take(pa.array(columns)).combine_chunks()
        out["similarity"] = pa.array(scores / blocks.MICRO)
        out["rank"] = pa.array((places + 1).astype(np.int32))
        if chance:
            mine = left_block.columns[chance].to_numpy(zero_copy_only=False)[rows]
            other = np.concatenate([b.columns[chance].to_numpy(zero_copy_only=False) for b in rights])[columns]
            out[chance] = pa.array(pair_draws(mine, other))
        return out

    right_keep = [code_key] + ([chance] if chance else [])
    if blocks.fits_task(codes, vector, **limits):
        return blocks.beside(queries, codes, keep, right_keep, vector, of_all, schema)
    limits.pop("task_bytes", None)
    parts, n_blocks = blocks.meet(queries, codes, keep, right_keep, vector, kernel, schema, **limits)
    if n_blocks == 1:
        return parts
    best_first = Window.partitionBy(*keys).orderBy(F.desc("similarity"), F.asc(code_key))
    return parts.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def _lowest_of_best(left: blocks.Block, rights: list[blocks.Block], k: int, exclude: str | None) -> np.ndarray:
    """Products that the k best of each left row are not below: the k-th best of a part of the right rows, without those excluded."""
    total = sum(map(len, rights))
    most = pa.compute.max(pa.compute.list_value_length(left.columns[exclude])).as_py() or 0 if exclude else 0
    every = max(1, min(16, total // 2048))
    units = blocks.unit_rows(np.concatenate([b.matrix[::every] for b in rights]))
    bound = np.full(len(left), -np.inf)
    at = len(units) - k - most
    if at < 0 or not (np.isfinite(units).all() and np.isfinite(left.unit).all()):
        return bound
    for start in range(0, len(left), 32):
        products = left.unit[start:start + 32] @ units.T
        bound[start:start + 32] = (np.rint(np.partition(products, at, axis=1)[:, at] * blocks.MICRO) - 0.75) / blocks.MICRO
    return bound


def exclusion_mask(
    left: blocks.Block, right: blocks.Block, exclude: str, code_key: str
) -> np.ndarray | None:
    """True where a right key is in the exclusion list of a left row, None if that is nowhere."""
    lists = left.columns[exclude]
    names = right.columns[code_key].dictionary_encode()
    places = pa.compute.index_in(lists.flatten(), value_set=names.dictionary)
    sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(left)), sizes)
    known = np.asarray(places.is_valid())
    if not known.any():
        return None
    barred = np.zeros((len(left), len(names.dictionary)), dtype=bool)
    barred[rows[known], places.drop_null().to_numpy()] = True
    if len(names.dictionary) == len(right):
        return barred
    return barred[:, names.indices.to_numpy(zero_copy_only=False)]


def with_descriptions(matches: DataFrame, codes: DataFrame, code_key: str = "code") -> DataFrame:
    """Attach the descriptions to matched codes."""
    return matches.join(codes.select(code_key, "description"), code_key, "left")


def description_to_code(rows: DataFrame, codes: DataFrame, order: str) -> DataFrame:
    """Code of each description, the last one if several share it, else ``Unknown``."""
    last = codes.groupBy("description").agg(F.max_by("code", order).alias("code"))
    return rows.join(last, "description", "left").withColumn(
        "code", F.coalesce("code", F.lit("Unknown"))
    )


def codes_per_query(matches: DataFrame, code_key: str = "code") -> DataFrame:
    """Ordered codes per query; a query of several specialties keeps the last one's."""
    per_specialty = matches.groupBy("specialty", "query").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", code_key))), lambda m: m[code_key]
        ).alias("codes")
    )
    return per_specialty.groupBy("query").agg(F.max_by("codes", "specialty").alias("codes"))


def limited_view(
    matches: DataFrame, max_queries: int = 5, max_codes: int = 3, query_order: Column | None = None
) -> DataFrame:
    """First queries per specialty with their first codes, and how many queries remain.

    Reads the matches three times, so they should be stored.
    """
    order = query_order if query_order is not None else F.col("query").asc()
    names = matches.select("specialty", "query").distinct()
    totals = names.groupBy("specialty").agg(F.count("*").alias("_n"))
    first = Window.partitionBy("specialty").orderBy(order)
    shown = names.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= max_queries)
    return (
        matches.filter(F.col("rank") <= max_codes)
        .join(shown.drop("_place"), ["specialty", "query"])
        .join(totals, "specialty")
        .withColumn("remaining", F.greatest(F.col("_n") - max_queries, F.lit(0).cast("long")))
        .drop("_n")
    )
