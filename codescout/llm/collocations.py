"""Phrases whose words occur together more often than apart, counted in tiles of word pairs.

Words are ranked by frequency within their language, so a pair of words is a cell of a square table whose often used cells lie in one
corner. The table is cut into tiles. The tiles of the corner (``HEAD`` ranks on each side) have an address for every cell and are counted
by ``bincount``; the rest is sparse, kept as sorted codes with counts (COO) and dealt by a hash of the code. Tasks send tiles, not pairs,
and each tile is added up where it arrives. Phrases that are frequent enough are ranked again and count as units: a pair of a unit and
the word after it is a phrase that is longer by a word, and is counted in tiles in the same way. A phrase can't be more frequent than
its parts, so only words and units that are frequent enough themselves are looked at, which loses none.

What is sent to all tasks has a fixed largest size: the ``DICTIONARY`` most frequent words (of at most ``LONGEST`` bytes), the ``UNITS``
most frequent phrases of each length, and filters of 8 MB for the frequent words and units beyond these. Windows with such a word or unit
are counted as texts instead of tiles; filters only save work there, as every count is exact. So the results don't depend on the sizes.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescout.llm.common import ready, slices, tidy
from codescout.operators.running import first_per_group
from codescout.session import materialise

#: Occurrences that a phrase has at least, words that it has at most, and the share of a phrase's occurrences inside a longer one, in
#: percent, from which the longer one replaces it.
LEAST, WORDS, SHARE, TOP = 10, 3, 50, 2000
DICTIONARY, LONGEST, UNITS = 1 << 19, 64, 1 << 21
#: Ranks with addressed cells on each side, and the side of a tile.
HEAD, TILE = 1024, 32
#: Bits that a word's rank has in a code; bits of a filter.
RANK_BITS, FILTER_BITS = 20, 26
#: Windows that a task counts at once, texts and words whose counts it holds, and languages with a corner of their own that it holds.
AT_ONCE, HELD, CORNERS = 1 << 21, 1 << 18, 16
#: Words that are broadcast with their counts, as they are parts of very many phrases.
HEAVY = 1 << 16
STRETCH = 1 << 20
NO_LANGUAGE = "und"
_CELLS, _TILES = TILE * TILE, (HEAD // TILE) ** 2

#: Ends of pieces become commas, which no word has, and tabs become spaces; the only white space that is left are spaces.
_PLAIN = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b",,,,,,,,,, ")
_END = b","


def tokens(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Words and ends of pieces of several texts, one stretch after the other; a piece may go on in the next stretch."""
    data = _END.join((t or "").encode() for t in texts).lower().translate(_PLAIN)
    start, size = 0, len(data)
    while start < size:
        stop = data.find(b" ", start + STRETCH)
        stop = size if stop < 0 else stop
        yield data[start:stop].replace(_END, b" , ").split()
        start = stop


def _by_language(part: pa.RecordBatch) -> dict[str, list[str | None]]:
    out: dict[str, list[str | None]] = {}
    for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
        out.setdefault(lang, []).append(text)
    return out


def _rows(counts: dict[str, Counter]) -> pa.RecordBatch:
    """(``lang``, ``phrase``, ``n``) rows of counters of byte strings; None stands for all words."""
    langs, phrases, numbers = [], [], []
    for lang, counter in counts.items():
        langs += [lang] * len(counter)
        phrases += counter.keys()
        numbers += counter.values()
    columns = [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])


def _words(docs: DataFrame) -> DataFrame:
    """(``lang``, ``phrase``, ``n``): counts of words, of all words under a null phrase, added up per task only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for part in slices(batch):
                for lang, texts in _by_language(part).items():
                    counter = counts.setdefault(lang, Counter())
                    for found in tokens(texts):
                        counter.update(found)
                        counter[None] += len(found) - counter.pop(_END, 0)
                if sum(map(len, counts.values())) > HELD:
                    yield _rows(counts)
                    counts = {}
        yield _rows(counts)

    return docs.mapInArrow(tidy(run), "lang string, phrase string, n long")


def _mixed(codes: np.ndarray, lang: str) -> np.ndarray:
    """Well mixed numbers of codes, different in each language."""
    x = codes.astype(np.uint64) ^ np.uint64(xxhash.xxh64_intdigest(lang))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Ranks:
    """The words of a dictionary by language: rank by falling frequency, ties by bytes; and a filter for frequent words beyond it."""

    def __init__(self, words: dict[str, list[bytes]], beyond: np.ndarray | None):
        self.__setstate__((words, beyond))

    def __getstate__(self):
        return self.words, self.beyond

    def __setstate__(self, state):
        self.words, self.beyond = state
        self.rank = {lang: {w: i for i, w in enumerate(words)} for lang, words in self.words.items()}

    def ids(self, found: list[bytes], lang: str) -> np.ndarray:
        """Rank of each word; -1 for ends and rare words, -2 for what may be a frequent word that has no rank."""
        out = np.fromiter(map(self.rank.get(lang, {}).get, found, itertools.repeat(-1)), np.int64, len(found))
        if self.beyond is not None:
            for place in np.flatnonzero(out == -1).tolist():
                if found[place] != _END and _holds(self.beyond, _word_slot(found[place], lang)):
                    out[place] = -2
        return out


class Units:
    """The most frequent phrases of one length by language: codes in order, and the rank of each; and a filter for those beyond."""

    def __init__(self, codes: dict[str, np.ndarray], ranks: dict[str, np.ndarray], beyond: np.ndarray | None):
        self.codes, self.ranks, self.beyond = codes, ranks, beyond

    def ids(self, codes: np.ndarray, lang: str) -> np.ndarray:
        """Rank of each code; -1 for rare ones and negative codes, -2 for what may be a frequent one that has no rank."""
        out = np.full(len(codes), -1, np.int64)
        known = self.codes.get(lang)
        if known is not None:
            place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            out = np.where(known[place] == codes, self.ranks[lang][place], -1)
        if self.beyond is not None:
            out[(out == -1) & (codes >= 0) & _holds(self.beyond, _code_slots(codes, lang))] = -2
        return out

    def decoded(self, ranks: np.ndarray, lang: str) -> np.ndarray:
        codes = np.empty(len(self.codes[lang]), np.int64)
        codes[self.ranks[lang]] = self.codes[lang]
        return codes[ranks]


def _holds(bits: np.ndarray, slots):
    return (bits[slots >> 6] >> (slots & 63) & 1) != 0


def _word_slot(word: bytes, lang: str) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang)) >> (64 - FILTER_BITS)


def _code_slots(codes: np.ndarray, lang: str) -> np.ndarray:
    return (_mixed(codes, lang) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class Tiles:
    """Counts of windows in one task: (unit, word) pairs as addressed tiles and sorted codes, and texts."""

    def __init__(self, parts: int):
        self.parts = parts
        self.corners: dict[str, np.ndarray] = {}
        self.waiting: dict[str, list[np.ndarray]] = {}
        self.texts: dict[str, Counter] = {}
        self.size = 0

    def add(self, lang: str, units: np.ndarray, words: np.ndarray) -> None:
        self.waiting.setdefault(lang, []).append(units << RANK_BITS | words)
        self.size += len(units)

    def count(self) -> Iterator[pa.RecordBatch]:
        """Count the pairs that wait; yields the sparse ones."""
        for lang, arrays in self.waiting.items():
            codes = np.concatenate(arrays)
            units, words = codes >> RANK_BITS, codes & ((1 << RANK_BITS) - 1)
            inside = (units < HEAD) & (words < HEAD)
            u, w = units[inside], words[inside]
            tile = u // TILE * (HEAD // TILE) + w // TILE
            counted = np.bincount(tile * _CELLS + u % TILE * TILE + w % TILE, minlength=HEAD * HEAD)
            self.corners[lang] = self.corners[lang] + counted if lang in self.corners else counted
            rest, counts = np.unique(codes[~inside], return_counts=True)
            part = (_mixed(rest, lang) % np.uint64(self.parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            yield _packed(lang, part[order] + _TILES, rest[order], counts[order])
            if len(self.corners) > CORNERS:
                yield from self.emptied()
        self.waiting, self.size = {}, 0

    def emptied(self) -> Iterator[pa.RecordBatch]:
        for lang, counted in self.corners.items():
            cells = np.flatnonzero(counted)
            yield _packed(lang, cells // _CELLS, (cells % _CELLS).astype(np.uint16), counted[cells])
        self.corners = {}

    def texts_out(self) -> Iterator[pa.RecordBatch]:
        for lang, counter in self.texts.items():
            by_part: dict[int, list[bytes]] = {}
            for text in counter:
                by_part.setdefault(xxhash.xxh3_64_intdigest(text) % self.parts, []).append(text)
            for part, those in by_part.items():
                counts = np.array([counter[t] for t in those], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([-1 - part], pa.int32()), pa.array([_BETWEEN.join(those)]), pa.array([counts.tobytes()])], _NAMES
                )
        self.texts = {}


_NAMES, _PACKED, _BETWEEN = ["lang", "part", "codes", "counts"], "lang string, part int, codes binary, counts binary", b"\n"


def _packed(lang: str, part: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row for each part, given in order."""
    present, starts = np.unique(part, return_index=True)
    bounds = list(zip(starts.tolist(), [*starts[1:].tolist(), len(part)]))
    counts = counts.astype(np.int64)
    columns = [
        pa.array([lang] * len(present), pa.string()),
        pa.array(present.astype(np.int32)),
        pa.array([codes[a:b].tobytes() for a, b in bounds], pa.binary()),
        pa.array([counts[a:b].tobytes() for a, b in bounds], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def windows(texts: list[str | None], lang: str, ranks: Ranks, levels: list[Units]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(words, units, last words) for all windows of ``len(levels) + 2`` words, stretch by stretch.

    The unit is all of the window but its last word. Both are ranks, or -2 where there may be one beyond the dictionaries; -1 in either
    means that the window isn't frequent.
    """
    size = len(levels) + 2
    held: list[bytes] = []
    for found in tokens(texts):
        # No window lies in what is held, so none is seen twice.
        found = held + found
        held = found[max(0, len(found) - size + 1) :]
        if len(found) < size:
            continue
        ids = units = ranks.ids(found, lang)
        for number, level in enumerate(levels):
            after, before = ids[number + 1 :], units[:-1]
            units = level.ids(np.where((before >= 0) & (after >= 0), before << RANK_BITS | after, -1), lang)
            units[(np.minimum(before, after) == -2) & (before != -1) & (after != -1)] = -2
        # What follows the first word must be frequent, too.
        yield found, np.where(units[1:] == -1, -1, units[:-1]), ids[size - 1 :]


def _tiles(docs: DataFrame, ranks, levels: list, parts: int) -> DataFrame:
    """Packed counts of the windows of ``len(levels) + 2`` words, added up per task only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, units_of = Tiles(parts), [level.value for level in levels]
        for batch in batches:
            for part in slices(batch):
                for lang, texts in _by_language(part).items():
                    for found, units, last in windows(texts, lang, ranks.value, units_of):
                        ranked = (units >= 0) & (last >= 0)
                        tiles.add(lang, units[ranked], last[ranked])
                        beyond = np.flatnonzero(~ranked & (units != -1) & (last != -1)).tolist()
                        if beyond:
                            counter = tiles.texts.setdefault(lang, Counter())
                            counter.update(b" ".join(found[i : i + len(levels) + 2]) for i in beyond)
                        if tiles.size > AT_ONCE:
                            yield from tiles.count()
                if sum(map(len, tiles.texts.values())) > HELD:
                    yield from tiles.texts_out()
        yield from tiles.count()
        yield from tiles.emptied()
        yield from tiles.texts_out()

    return docs.mapInArrow(tidy(run), _PACKED)


def _added(packed: DataFrame, ranks, levels: list, least: int) -> DataFrame:
    """(``lang``, ``phrase``, ``n``, ``code``) of the windows that occur ``least`` times; no code where one has no rank.

    A part is added up in the task where it arrives: tiles by address, sorted codes by merging whenever many have come, texts in a
    dictionary.
    """

    def phrases(lang: str, codes: np.ndarray) -> list[bytes]:
        columns = []
        for level in reversed(levels):
            columns.append(codes & ((1 << RANK_BITS) - 1))
            codes = level.value.decoded(codes >> RANK_BITS, lang)
        columns += [codes & ((1 << RANK_BITS) - 1), codes >> RANK_BITS]
        names = ranks.value.words[lang]
        return [b" ".join(names[i] for i in row) for row in zip(*(c.tolist() for c in reversed(columns)))]

    def out(lang: str, texts: list[bytes], counts: np.ndarray, codes: np.ndarray | None) -> pa.RecordBatch:
        columns = [
            pa.array([lang] * len(texts), pa.string()),
            pa.array(texts, pa.binary()).cast(pa.string()),
            pa.array(counts.astype(np.int64)),
            pa.nulls(len(texts), pa.int64()) if codes is None else pa.array(codes),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n", "code"])

    def added(lang: str, part: int, pieces: Iterator[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        if part < 0:
            counter: Counter = Counter()
            for texts, numbers in pieces:
                for text, n in zip(texts.split(_BETWEEN), np.frombuffer(numbers, np.int64).tolist()):
                    counter[text] += n
            kept = [t for t, n in counter.items() if n >= least]
            yield out(lang, kept, np.array([counter[t] for t in kept], np.int64), None)
            return
        if part < _TILES:
            tile = np.zeros(_CELLS, np.int64)
            for cells, numbers in pieces:
                tile[np.frombuffer(cells, np.uint16)] += np.frombuffer(numbers, np.int64)
            cells = np.flatnonzero(tile >= least)
            units = part // (HEAD // TILE) * TILE + cells // TILE
            codes, counts = units << RANK_BITS | part % (HEAD // TILE) * TILE + cells % TILE, tile[cells]
        else:
            held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
            for numbers in pieces:
                held.append(tuple(np.frombuffer(x, np.int64) for x in numbers))
                size += len(held[-1][0])
                if size > 2 * len(held[0][0]) + AT_ONCE:
                    held, size = [_merged(held)], 0
            codes, counts = _merged(held)
            codes, counts = codes[counts >= least], counts[counts >= least]
        for start in range(0, len(codes), HELD):
            some = codes[start : start + HELD]
            yield out(lang, phrases(lang, some), counts[start : start + HELD], some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c) for c in range(4))))
        named = ((lang.as_py(), part.as_py(), codes.as_buffer(), counts.as_buffer()) for lang, part, codes, counts in rows)
        for (lang, part), group in itertools.groupby(named, key=lambda r: r[:2]):
            yield from added(lang, part, ((bytes(r[2]) if part < 0 else r[2], r[3]) for r in group))

    dealt = packed.repartition("lang", "part").sortWithinPartitions("lang", "part")
    return dealt.mapInArrow(tidy(run), "lang string, phrase string, n long, code long")


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order, each with the sum of its counts."""
    codes, counts = (np.concatenate(x) for x in zip(*held))
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[starts], np.add.reduceat(counts, starts)


def _most_frequent(counted: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows with the largest ``n``, at most ``most`` and all of those with equal ``n`` or none, and the others if there are any.

    The limit is found from counts of rows by the size of ``n``, sixteen steps for each doubling.
    """
    step = F.floor(F.log2("n") * 16)
    sizes = {r.step: r["count"] for r in counted.groupBy(step.alias("step")).count().collect()}
    total, lowest = 0, None
    for at in sorted(sizes, reverse=True):
        if total + sizes[at] > most:
            return (counted.limit(0), counted) if lowest is None else (counted.filter(step >= lowest), counted.filter(step < lowest))
        total, lowest = total + sizes[at], at
    return counted, None


def _filter(slots: DataFrame) -> np.ndarray:
    """The bits of a filter from rows (``lang``, ``slot``); at most 2^20 words of it reach the driver."""
    words = slots.groupBy((F.col("slot") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))).alias("bits")
    )
    table = words.toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return bits


def _slotted(rows: DataFrame, of: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            if of == "phrase":
                slots = [_word_slot(w.encode(), lang) for lang, w in zip(langs, batch.column(1).to_pylist())]
            else:
                codes = batch.column(1).to_numpy()
                slots = [int(_code_slots(codes[i : i + 1], lang)[0]) for i, lang in enumerate(langs)]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64())], ["slot"])

    return rows.select("lang", of).mapInArrow(run, "slot long")


def _ranks(words: DataFrame, most: int) -> Ranks:
    """The dictionary: its size is bounded by ``most`` words of ``LONGEST`` bytes."""
    short = F.octet_length("phrase") <= LONGEST
    top, others = _most_frequent(words.filter(short), most)
    long = words.filter(~short)
    beyond = long if others is None else others.unionByName(long)
    table = top.select("lang", F.col("phrase").cast("binary"), "n").toArrow()
    by_lang: dict[str, list[tuple[int, bytes]]] = {}
    for lang, word, n in zip(*(c.to_pylist() for c in table.columns)):
        by_lang.setdefault(lang, []).append((-n, word))
    # No other words: no filter, and no word is looked up in it.
    bits = None if beyond.isEmpty() else _filter(_slotted(beyond, "phrase"))
    return Ranks({lang: [w for _, w in sorted(those)] for lang, those in by_lang.items()}, bits)


def _units(phrases: DataFrame, most: int) -> Units:
    """The units: at most ``most`` codes with their counts."""
    top, beyond = _most_frequent(phrases.filter("code is not null"), most)
    table = top.select("lang", "code", "n").toArrow().combine_chunks()
    langs = np.array(table.column("lang").to_pylist(), object)
    codes, counts = (table.column(c).to_numpy() for c in ("code", "n"))
    by_code, by_rank = {}, {}
    for lang in set(langs.tolist()):
        own = np.flatnonzero(langs == lang)
        own = own[np.lexsort((codes[own], -counts[own]))]
        order = np.argsort(codes[own])
        by_code[lang], by_rank[lang] = codes[own][order], order
    return Units(by_code, by_rank, None if beyond is None else _filter(_slotted(beyond, "code")))


def _parts_of(phrases: DataFrame, words: int) -> DataFrame:
    """``phrases`` (``lang``, ``phrase``, ``a``) with ``cut``, ``side`` and ``part``: both parts for each cut."""
    said = F.split("phrase", " ")
    halves = []
    for k in range(1, words):
        first, rest = (F.array_join(x, " ") for x in (F.slice(said, 1, k), F.slice(said, k + 1, words - k)))
        for side, part in (("l", first), ("r", rest)):
            halves.append(F.struct(F.lit(k).alias("cut"), F.lit(side).alias("side"), part.alias("part")))
    return phrases.select("*", F.explode(F.array(*halves)).alias("_half")).select("*", "_half.*").drop("_half")


def _inside(words: int):
    """All phrases of at least two words inside a phrase of ``words`` words, without itself."""
    said = F.split("phrase", " ")
    return F.array(*[F.array_join(F.slice(said, i + 1, k), " ") for k in range(2, words) for i in range(words - k + 1)])


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    least: int = LEAST,
    words: int = WORDS,
    share: int = SHARE,
    top: int = TOP,
    dictionary: int = DICTIONARY,
    units: int = UNITS,
) -> DataFrame:
    """(``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``): the ``top`` phrases of each language by score.

    Texts in which A-Z count as a-z end pieces at ``.,;:!?`` and line breaks; words are what spaces and tabs leave. Candidates are the
    phrases of 2 to ``words`` words that occur ``least`` times, overlaps included, inside pieces. Cutting a candidate in two parts that
    occur ``l`` and ``r`` times scores floor(10^6 a a / (l r)); the lowest cut counts, the first of equal ones. A candidate is dropped
    if a longer one that contains it occurs ``share`` percent as often or more, whether that is dropped or not. Ranks go by score, then
    ``a``, both falling, then the phrase's bytes; ``n`` is the number of words of the language.

    Null language is ``und``, together with rows that say so; null text is empty. Repeated rows count as often as they are there.
    Other columns are ignored, whatever their names; an empty table has no rows. A language without candidates has none either.
    """
    spark = ready(docs)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).alias("text"))
    counted = _words(source).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    counted = materialise(counted.filter((F.col("n") >= least) | F.col("phrase").isNull()))
    single = counted.filter("phrase is not null")
    totals = counted.filter("phrase is null").select("lang", F.col("n").alias("_total"))

    ranks = spark.sparkContext.broadcast(_ranks(single, dictionary))
    levels: list = []
    known, heavy = single, _most_frequent(single.filter(F.octet_length("phrase") <= LONGEST), HEAVY)[0]
    scored = longer = None
    for size in range(2, words + 1):
        if size > 2:
            levels.append(spark.sparkContext.broadcast(_units(found, units)))
        found = materialise(_added(_tiles(source, ranks, levels, parts), ranks, levels, least))
        phrases = found.select("lang", "phrase", F.col("n").alias("a"))
        new = _scored(phrases, size, known, heavy)
        scored = new if scored is None else scored.unionByName(new)
        known = known.unionByName(found.select("lang", "phrase", "n"))
        if size > 2:
            within = phrases.select("lang", F.explode(F.array_distinct(_inside(size))).alias("phrase"), F.col("a").alias("_longer"))
            longer = within if longer is None else longer.unionByName(within)
    if longer is not None:
        most = longer.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
        scored = scored.join(most, ["lang", "phrase"], "left")
        scored = scored.filter(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * share)).drop("_longer")
    ranked = first_per_group(scored, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("_total").alias("n"), "score")


def _scored(phrases: DataFrame, size: int, known: DataFrame, heavy: DataFrame) -> DataFrame:
    """``phrases`` with ``l``, ``r`` and ``score``. ``known`` has the counts of all shorter phrases, ``heavy`` of some frequent words."""
    halves = _parts_of(phrases, size)
    often = heavy.select("lang", F.col("phrase").alias("part"), F.col("n").alias("_often"))
    halves = halves.join(F.broadcast(often), ["lang", "part"], "left")
    at_hand = halves.filter("_often is not null").withColumnRenamed("_often", "_n")
    fetched = halves.filter("_often is null").drop("_often").join(
        known.select("lang", F.col("phrase").alias("part"), F.col("n").alias("_n")), ["lang", "part"]
    )
    cuts = at_hand.unionByName(fetched).groupBy("lang", "phrase", "a", "cut").agg(
        F.max(F.when(F.col("side") == "l", F.col("_n"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("_n"))).alias("r")
    )
    # Products have up to 38 digits.
    exact = {c: f"cast({c} as decimal(19, 0))" for c in "alr"}
    score = F.expr(f"({exact['a']} * {exact['a']} * cast(1000000 as decimal(7, 0))) div ({exact['l']} * {exact['r']})")
    cuts = cuts.withColumn("score", score)
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("_lowest")
    return cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "_lowest.l", "_lowest.r", "_lowest.score")
