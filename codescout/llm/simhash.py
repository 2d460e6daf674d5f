"""Near duplicates by SimHash: fingerprints meet at the anchors of a covering code.

A fingerprint is cut into blocks, so that two fingerprints within ``distance`` bits are within ``near = distance // blocks`` bits in
one block at least. The anchors of a block are the words of a Hamming code (further bits are free): every value lies within radius
1 of an anchor. A fingerprint is at home at the anchor nearest to it and visits every anchor within 1 + ``near``. If x and y
are ``near`` each other, y is within 1 + ``near`` of the home of x, so comparing the ones at home with all visitors, anchor by
anchor, finds every link. Equal fingerprints count once. Anchors with many visitors are cut into cells that share the work.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescout.llm.common import ready, slices
from codescout.llm.components import components
from codescout.session import materialise

DISTANCE, SHINGLE, BLOCKS = 4, 4, 3
#: Fingerprints of an anchor that one cell takes on each side; larger anchors have a grid of cells.
CELL = 8192
#: Comparisons of a cell up to which all are made at once; larger cells follow links instead.
AT_ONCE = 1024


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text; zero if it has no words."""
    data = text.encode().lower()  # bytes: only A-Z change, only ASCII white space separates
    words = data.split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    counts, size = np.zeros(64, np.int64), len(starts)
    stops = (ends[shingle - 1 :] - 1).tolist()
    for at in range(0, size, 1 << 16):
        part = [digest(joined[i:j], 42) for i, j in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > size, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(``key``, ``_text_hash``, ``_print``) of every row; null text counts as empty, other columns are ignored."""
    ready(docs)
    source = docs.select(F.col(key).alias(key), F.xxhash64(F.col(text)).alias("_text_hash"), F.col(text).alias("_text"))
    fields = [source.schema[key], source.schema["_text_hash"], T.StructField("_print", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                prints = np.array([fingerprint(x or "", shingle) for x in part.column(2).to_pylist()], np.uint64)
                columns = [part.column(0), part.column(1), pa.array(prints.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))


class Covering:
    """The anchors of one block of bits: a Hamming code on as many bits as it can have, the others free."""

    def __init__(self, low: int, bits: int, near: int):
        self.low, self.bits = low, bits
        r = max(r for r in range(1, 7) if 2**r - 1 <= bits)
        self.coded = 2**r - 1
        # Bit i has the syndrome i + 1; free bits have none.
        self.check = [sum(1 << i for i in range(self.coded) if (i + 1) >> j & 1) for j in range(r)]
        by_syndrome: list[list[int]] = [[] for _ in range(2**r)]
        for weight in range(near + 2):
            for places in itertools.combinations(range(bits), weight):
                syndrome = 0
                for p in places:
                    syndrome ^= p + 1 if p < self.coded else 0
                by_syndrome[syndrome].append(sum(1 << p for p in places))
        width = max(map(len, by_syndrome))
        # The first change of a syndrome is the lightest one, which leads home. Rows are filled up with -1.
        self.changes = np.array([x + [-1] * (width - len(x)) for x in by_syndrome], np.int64)

    def anchors(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each fingerprint the anchors that it visits, its home first; and which of them there are."""
        value = (prints >> np.uint64(self.low)).astype(np.int64) & ((1 << self.bits) - 1)
        syndrome = np.zeros(len(value), np.int64)
        for j, mask in enumerate(self.check):
            syndrome |= (np.bitwise_count(value & mask).astype(np.int64) & 1) << j
        changes = self.changes[syndrome]
        return value[:, None] ^ changes, changes >= 0


def covering(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[Covering]:
    """One covering code per block of a 64-bit fingerprint."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [Covering(a, b - a, distance // blocks) for a, b in itertools.pairwise(cuts)]


def _visits(prints: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(``anchor``, ``home``, ``print``) for every anchor that a fingerprint visits."""
    codes = covering(distance, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096):
                values = part.column(0).to_numpy(zero_copy_only=False)
                for number, code in enumerate(codes):
                    anchors, there = code.anchors(values.view(np.uint64))
                    home = np.zeros(anchors.shape, bool)
                    home[:, 0] = True
                    repeated = np.broadcast_to(values[:, None], anchors.shape)
                    named = anchors | number << 56
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(named[there]), pa.array(home[there]), pa.array(repeated[there])], ["anchor", "home", "print"]
                    )

    return prints.mapInArrow(run, "anchor long, home boolean, print long")


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """Links (``a``, ``b``) between different fingerprints (column ``print``, distinct) that connect all that are within ``distance``.

    Of the links inside one cell only as many are returned as connect the same fingerprints, so a dense group gives a few links
    for each of its members and not all its pairs.
    """
    ready(prints)
    visits = _visits(prints, distance, blocks)
    crowded = visits.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).filter(F.col("n") > cell)
    crowded = crowded.select(
        "anchor", F.ceil(F.col("n") / cell).cast("int").alias("columns"), F.ceil((F.col("homes") + 1) / cell).cast("int").alias("rows")
    )
    # Rows of the grid share out the ones at home, columns the visitors; each side goes to all cells of its row or column.
    one = F.lit(1)
    cut = visits.join(crowded, "anchor", "left").select(
        "anchor", "home", "print", F.coalesce("columns", one).alias("columns"), F.coalesce("rows", one).alias("rows")
    )
    share = F.xxhash64("print", F.lit(7))

    # Both sides in one pass: a row at home is sent in both roles.
    roles = F.when(F.col("home"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    cells = cut.select("anchor", "print", "rows", "columns", F.explode(roles).alias("home"))
    cells = cells.withColumn("_own", F.when(F.col("home"), F.col("rows")).otherwise(F.col("columns")))
    cells = cells.withColumn("_other", F.when(F.col("home"), F.col("columns")).otherwise(F.col("rows")))
    cells = cells.withColumn("_fixed", F.pmod(share, F.col("_own")).cast("int"))
    cells = cells.withColumn("_free", F.explode(F.sequence(F.lit(0), F.col("_other") - 1)))
    cells = cells.select(
        "anchor",
        F.when(F.col("home"), F.col("_fixed")).otherwise(F.col("_free")).alias("row"),
        F.when(F.col("home"), F.col("_free")).otherwise(F.col("_fixed")).alias("column"),
        "home",
        "print",
    )
    dealt = cells.repartition("anchor", "row", "column").sortWithinPartitions("anchor", "row", "column", F.desc("home"))
    return dealt.mapInArrow(lambda batches: _compare(batches, distance), "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut so that no run of equal keys is split."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        same = np.ones(len(columns[0]), bool)
        for c in columns[:keys]:
            same &= c == c[-1]
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        held = [c[cut:] for c in columns]
        if cut:
            yield [c[:cut] for c in columns]
    if held is not None:
        yield held


def _compare(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links inside each cell; the rows of a cell at home come first."""
    for anchor, row, column, home, prints in _runs(batches, 3):
        prints = prints.view(np.uint64)
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (column[1:] != column[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff([*starts, len(anchor)])
        homes = np.add.reduceat(home.astype(np.int64), starts)
        visitors = sizes - homes
        small = (homes * visitors <= AT_ONCE) & (homes > 0)
        pairs = [_all_at_once(prints, starts[small], homes[small], visitors[small], distance)]
        for at, h, v in zip(starts[~small], homes[~small], visitors[~small]):
            if h:
                pairs.append(_following(prints[at : at + h], prints[at + h : at + h + v], distance))
        a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        keep = a < b
        found = np.unique(np.stack([np.where(keep, a, b), np.where(keep, b, a)]), axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])


def _all_at_once(prints, starts, homes, visitors, distance: int):
    """Links of many small cells, all comparisons side by side."""
    pairs = homes * visitors
    cell = np.repeat(np.arange(len(starts)), pairs)
    place = np.arange(len(cell)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    a = prints[starts[cell] + place // visitors[cell]]
    b = prints[starts[cell] + homes[cell] + place % visitors[cell]]
    close = (a != b) & (np.bitwise_count(a ^ b) <= distance)
    return a[close], b[close]


def _following(homes, visitors, distance: int):
    """Links of a large cell, found by following them: whoever has been reached is not compared again."""
    left, right = [], []
    rest = {True: homes, False: visitors}
    while len(rest[True]):
        open_ends = [(rest[True][-1], True)]
        rest[True] = rest[True][:-1]
        while open_ends:
            one, at_home = open_ends.pop()
            others = rest[not at_home]
            close = np.bitwise_count(others ^ one) <= distance
            if close.any():
                found = others[close]
                rest[not at_home] = others[~close]
                left.append(np.full(len(found), one))
                right.append(found)
                open_ends += [(x, not at_home) for x in found]
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(left), np.concatenate(right)
    return a[a != b], b[a != b]


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(``key``, ``_text_hash``, ``fingerprint``, ``component_id``) of every row.

    ``fingerprint`` has 16 hex digits. ``component_id`` is the smallest key of all rows that can be reached over links, itself
    included; null only if all of them are null. Null text counts as empty, and all texts without words share the fingerprint zero.
    Repeated rows stay and are in one group. Other columns are ignored, whatever their names.
    """
    rows = materialise(fingerprints(docs, key, text))
    prints = materialise(rows.groupBy(F.col("_print").alias("print")).agg(F.min(key).alias("_first")))
    roots = components(links(prints.select("print"), distance, blocks))
    placed = prints.join(roots.withColumnRenamed("node", "print"), "print", "left")
    placed = placed.select("print", "_first", F.coalesce("root", "print").alias("_root"))
    smallest = placed.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = placed.join(smallest, "_root").select(F.col("print").alias("_print"), "component_id")
    out = rows.join(named, "_print")
    digits = F.lpad(F.lower(F.hex("_print")), 16, "0")
    return out.select(key, "_text_hash", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """The rows of ``docs`` of which one is kept per group: the one with the smallest key, and of its texts the smallest hash.

    All columns stay as they are. Rows with the same key and the same text count as one document; one of them is kept.
    """
    return keep(docs, groups(docs, key, text, distance, blocks), key, text)


def keep(docs: DataFrame, grouped: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` that ``keep_one`` chooses from the groups given."""
    # Groups without any key are told apart by their fingerprint classes only, so these rows keep one per fingerprint.
    unnamed = F.when(F.col("component_id").isNull(), F.col("fingerprint"))
    chosen = (
        grouped.filter(F.col(key).eqNullSafe(F.col("component_id")))
        .groupBy(F.col(key).alias("_kept_key"), unnamed.alias("_kept_print"))
        .agg(F.min("_text_hash").alias("_kept_hash"))
    )
    hashed = docs.withColumn("_kept_hash", F.xxhash64(F.col(text)))
    same = hashed[key].eqNullSafe(chosen["_kept_key"]) & (hashed["_kept_hash"] == chosen["_kept_hash"])
    return hashed.join(chosen, same, "left_semi").dropDuplicates([key, "_kept_hash"]).select(*docs.columns)
