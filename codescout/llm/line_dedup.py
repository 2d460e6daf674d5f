"""Removal of passages of several lines that occur more than once in a corpus.

A text is cut into chunks of lines where a rolling hash over the hashes of the last lines says so. The cuts depend on the lines
around them only, so lines inserted earlier in a document shift no later cut. A chunk of several lines that occurs more than once
stays at its first place, the smallest key and there the first position, and goes at all others. Equality of bytes decides: chunks
are grouped by hash and bytes, and where different bytes share a hash nothing is removed.

A chunk is found again only if the cuts around it are inside the repeated passage. The finest level takes the rolling window itself at
every line, so that repeated passages of any length go from their first line to their last.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescout.llm import urls
from codescout.llm.common import ready, slices, tidy
from codescout.session import materialise

#: Lines under the rolling hash, one in how many places is a cut, and lines that a chunk has at least.
WINDOW, ONE_IN, LEAST = 2, 4, 2
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def chunks(lines: list[bytes], window: int = WINDOW, one_in: int = ONE_IN, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text, in lines.

    The hash of a window is the sum of its line hashes times powers of a base; it is rolled on by one line at a time. A chunk
    ends after the line whose window hash falls on a cut, once it has ``least`` lines.
    """
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    gone = pow(_BASE, window, 1 << 64)
    out, start, rolling = [], 0, 0
    for i, h in enumerate(hashes):
        rolling = (rolling * _BASE + h) & _MASK
        if i >= window:
            rolling = (rolling - hashes[i - window] * gone) & _MASK
        # The high bits are the well mixed ones.
        if i + 1 - start >= least and (rolling >> 32) % one_in == 0:
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def windows(lines: list[bytes], window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, end) of the windows of ``window`` lines that aren't blank, one from every such line; blank lines between them belong to it."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    return [(i, j + 1) for i, j in zip(full, full[window - 1 :])]


def _spans(lines: list[bytes], finest: bool) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, body) of the chunks with at least ``LEAST`` lines that aren't blank, and of the windows that are no such chunks."""
    seen = set()
    for start, end in chunks(lines):
        if sum(1 for x in lines[start:end] if x.strip()) >= LEAST:
            seen.add((start, end))
            yield start, end, b"\n".join(lines[start:end])
    if finest:
        for start, end in windows(lines):
            # Blank lines inside don't tell windows apart. A chunk with the same lines is one place with its window.
            if (start, end) not in seen or end - start > WINDOW:
                yield start, end, b"\n".join(x for x in lines[start:end] if x.strip())


def _places(docs: DataFrame, key: str, text: str, bodies: bool, finest: bool = False) -> DataFrame:
    """One row for every chunk with at least ``LEAST`` lines that aren't blank, and with ``finest`` for every window.

    ``_again``: the text has had it before, at a place that doesn't overlap this one.
    """
    source = docs.filter(F.col(text).isNotNull()).select(
        F.col(key).alias("_key"), F.xxhash64(text).alias("_text_hash"), F.col(text).alias("_text")
    )
    fields = [
        source.schema["_key"],
        source.schema["_text_hash"],
        T.StructField("_start", T.IntegerType()),
        T.StructField("_end", T.IntegerType()),
        T.StructField("_again", T.BooleanType()),
        T.StructField("_hash", T.BinaryType()),
        *([T.StructField("_body", T.BinaryType())] if bodies else []),
    ]
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                origin, rows = [], []
                for number, value in enumerate(part.column(2).to_pylist()):
                    lines = value.encode().split(b"\n")
                    ends: dict[bytes, int] = {}
                    for start, end, body in sorted(_spans(lines, finest)):
                        digest = xxhash.xxh3_128_digest(body)
                        origin.append(number)
                        rows.append((start, end, start >= ends.setdefault(body, end), digest, body))
                taken = part.take(pa.array(origin, pa.int64()))
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds[: len(fields) - 2])]
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), *columns], [f.name for f in fields])

    return source.mapInArrow(tidy(run), T.StructType(fields))


def _filter(places: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What keeps the places whose hash occurs more than once, and few others; a filter of bounded size is broadcast."""
    several = materialise(places.groupBy("_hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("_hash"))
    table, blocks = urls.bloom_table(several, "_hash")
    table = materialise(table)

    def kept(some: DataFrame) -> DataFrame:
        probed = some.withColumn("_block", urls._block(F.col("_hash"), blocks)).join(F.broadcast(table), "_block")
        bits = [F.col(f"_w{i}").bitwiseAND(urls._bit(F.col("_hash"), i)) != 0 for i in range(urls.WORDS)]
        return probed.filter(functools.reduce(Column.__and__, bits)).select(some.columns)

    return kept


def _merged(ranges: Column) -> Column:
    """Ranges in order, those that overlap or touch made one."""

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["_start"].alias("_start"), F.greatest(last["_end"], r["_end"]).alias("_end"))
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["_end"] >= r["_start"])
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<_start:int,_end:int>>"), add)


def repeated_places(docs: DataFrame, key: str = "doc_id", text: str = "text", finest: bool = False) -> DataFrame:
    """(``_key``, ``_text_hash``, ``_ranges``): per text the line ranges (start, end) that have occurred before, none overlapping.

    Counts are combined before the shuffle, so a passage that is everywhere is no hot spot. With the finest level, hashes are counted
    first and only bodies whose hash is repeated are shuffled.
    """
    ready(docs)
    kept = _filter(_places(docs, key, text, bodies=False, finest=True)) if finest else lambda places: places
    bodies = kept(_places(docs, key, text, bodies=True, finest=finest))
    equal = bodies.groupBy("_hash", "_body").agg(F.min("_key").alias("_first"), F.count("*").alias("_n"))
    known = (
        equal.groupBy("_hash")
        .agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n"), F.count("*").alias("_bodies"))
        .filter("_n > 1 and _bodies = 1")
        .select("_hash", "_first")
    )
    # Written out, both sides of the join are plain shuffles, so the rows of a passage that is everywhere can be split.
    places = kept(_places(docs, key, text, bodies=False, finest=finest)).join(materialise(known), "_hash")
    gone = places.filter(F.col("_again") | ~F.col("_key").eqNullSafe(F.col("_first")))
    ranges = gone.groupBy("_key", "_text_hash").agg(F.collect_set(F.struct("_start", "_end")).alias("_ranges"))
    return ranges.withColumn("_ranges", _merged(F.col("_ranges")))


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", finest: bool = False) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and the new column ``lines_removed``; all rows and columns stay.

    ``finest`` takes out all repeated passages of two lines or more that aren't blank; without it only repeated chunks go.
    Null text stays null; a text of which all lines go becomes empty. Rows with the same key are copies of one document: a passage
    stays in each of them if the key is the smallest that has it. Rows without a key come last; if a passage occurs in such rows
    only, it stays in them. A column of the input that is called ``lines_removed`` is replaced; ``_key``, ``_text_hash`` and
    ``_ranges`` are reserved names.
    """
    gone = repeated_places(docs, key, text, finest)
    names = [c for c in docs.columns if c != "lines_removed"]
    hashed = docs.withColumn("_hash_of_text", F.xxhash64(text))
    same = hashed[key].eqNullSafe(gone["_key"]) & (hashed["_hash_of_text"] == gone["_text_hash"])
    joined = hashed.join(gone, same, "left")

    def kept(line: Column, i: Column) -> Column:
        return ~F.exists("_ranges", lambda r: (i >= r["_start"]) & (i < r["_end"]))

    # Only texts with repeated passages are taken apart.
    rest = F.array_join(F.filter(F.split(F.col(text), "\n", -1), kept), "\n")
    lines = F.aggregate("_ranges", F.lit(0), lambda sum_, r: sum_ + r["_end"] - r["_start"])
    changed = F.when(F.col("_ranges").isNull(), F.col(text)).otherwise(rest)
    return joined.select(
        *[changed.alias(c) if c == text else F.col(c) for c in names],
        F.coalesce(F.when(F.col("_ranges").isNotNull(), lines), F.lit(0)).alias("lines_removed"),
    )
