"""Benchmark decontamination: documents stream through a suffix automaton of the test items.

The automaton of a set of word sequences has one state for all substrings that end at the same places. A document is read word by word;
the state and a length say what the longest run of words up to here is that some item has, too. The items are read once more when the
automaton is built, so that states know which items have a window there: a window is ``length`` consecutive words of an item, or fewer if
those already cover the share ``coverage`` of it. A document word inside a window is hit.

Items are cut into pieces that overlap by a window, and pieces are packed into automata of ``ROUND_WORDS`` words at most, built one task
each. An automaton is broadcast, so its size is bounded whatever the benchmark's; a benchmark with several automata takes several
rounds over the documents, each with one broadcast, which is given up when the round has been written.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescout.llm.common import ready, slices, tidy
from codescout.operators.running import running_sums
from codescout.session import materialise

LENGTH, COVERAGE = 10, 1.0
#: Words of the items in one automaton; it has at most twice as many states.
ROUND_WORDS = 1 << 17
#: Words of an item that one piece has, and bytes of a text that are split into words at once.
PIECE_WORDS, STRETCH = 1 << 14, 1 << 20

#: Runs of digits, letters and all that isn't ASCII, A-Z being lower-cased before; in UTF-8.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, stretch by stretch."""
    data = data.lower()
    start, size = 0, len(data)
    while start < size:
        stop = min(start + STRETCH, size)
        if stop < size:
            # A stretch ends where a word does.
            word = _WORD.match(data, stop - 1)
            stop = word.end() if word else stop
        yield _WORD.findall(data, start, stop)
        start = stop


def window_of(item_words: int, length: int, coverage: float) -> int:
    """Words of a window of an item: ``length``, or fewer if they already cover the share ``coverage`` of the item."""
    return min(length, item_words, max(1, -int(-item_words * coverage // 1)))


class Automaton:
    """A generalised suffix automaton of word sequences, with the windows that end in each state.

    ``ends[state]`` lists (window, items): every run of at least ``window`` words that leads to the state ends with a window of ``items``.
    ``hit[state]`` is the nearest state with windows on the way over suffix links, the state itself included, or -1.
    """

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.link, self.longest = [-1], [0]
        self.steps: list[dict[int, int]] = [{}]
        self.ends: dict[int, list[tuple[int, tuple[str | None, ...]]]] = {}
        self.hit: list[int] = []

    def add(self, sequence: list[bytes]) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))

    def _state(self, longest: int, link: int, steps: dict[int, int]) -> int:
        self.longest.append(longest)
        self.link.append(link)
        self.steps.append(steps)
        return len(self.steps) - 1

    def _parted(self, state: int, word: int, longest: int) -> int:
        """The target of a step as a state whose longest run has ``longest`` words, parted from the longer ones where needed."""
        target = self.steps[state][word]
        if self.longest[target] == longest:
            return target
        part = self._state(longest, self.link[target], dict(self.steps[target]))
        self.link[target] = part
        while state >= 0 and self.steps[state].get(word) == target:
            self.steps[state][word] = part
            state = self.link[state]
        return part

    def _extend(self, last: int, word: int) -> int:
        if word in self.steps[last]:
            return self._parted(last, word, self.longest[last] + 1)
        new = self._state(self.longest[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.steps[state]:
            self.steps[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._parted(state, word, self.longest[state] + 1)
        return new

    def mark(self, windows: list[tuple[list[bytes], int, str | None]]) -> None:
        """Say which windows of (sequence, window, item) end in which states. All sequences have been added before."""
        found: dict[int, dict[int, set[str | None]]] = {}
        for sequence, window, item in windows:
            state = 0
            for place, word in enumerate(sequence):
                state = self.steps[state][self.vocabulary[word]]
                # The state of the window alone: shorter runs than it are further up.
                while self.longest[self.link[state]] >= window:
                    state = self.link[state]
                if place + 1 >= window:
                    found.setdefault(state, {}).setdefault(window, set()).add(item)
        self.ends = {
            state: sorted((window, tuple(items)) for window, items in by_window.items()) for state, by_window in found.items()
        }
        self.hit = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.longest.__getitem__):
            self.hit[state] = state if state in self.ends else self.hit[self.link[state]] if state else -1

    def matches(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str | None]]:
        """Number of words, the spans of hit words (start, end; none touch), and the items whose windows occur."""
        link, longest, steps, ends, hit, name = self.link, self.longest, self.steps, self.ends, self.hit, self.vocabulary.get
        state = length = place = 0
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        for stretch in words(text):
            for place, word in enumerate(map(name, stretch), place + 1):
                # ``place`` words have been read with this one.
                if word is None:
                    state = length = 0
                    continue
                target = steps[state].get(word)
                while target is None and state:
                    state = link[state]
                    length = longest[state]
                    target = steps[state].get(word)
                if target is None:
                    continue
                state, length = target, length + 1
                at = hit[state]
                if at < 0:
                    continue
                widest = 0
                while at >= 0:
                    for window, those in ends[at]:
                        if window <= length:
                            widest = max(widest, window)
                            items.update(those)
                    at = hit[link[at]] if at else -1
                if widest:
                    start = place - widest
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, place))
        return place, spans, items


def _pieces(items: DataFrame, key: str, text: str, length: int, coverage: float, piece_words: int) -> DataFrame:
    """(``item``, ``window``, ``words``, ``n``) of the pieces of all items that have words."""
    source = items.select(F.col(key).cast("string").alias("_item"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for item, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    sequence = [w for stretch in words((value or "").encode()) for w in stretch]
                    window = window_of(len(sequence), length, coverage) if sequence else 0
                    for start in range(0, max(0, len(sequence) - window) + 1, piece_words):
                        piece = sequence[start : start + piece_words + window - 1]
                        if piece:
                            rows.append((item, window, b" ".join(piece), len(piece)))
                kinds = [pa.string(), pa.int32(), pa.binary(), pa.int64()]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "window", "words", "n"])

    return source.mapInArrow(run, "item string, window int, words binary, n long")


def automata(
    items: DataFrame, key: str, text: str, length: int, coverage: float, round_words: int = ROUND_WORDS, piece_words: int = PIECE_WORDS
) -> DataFrame:
    """(``round``, ``automaton``): pickled automata over about ``round_words`` words each, one task for each."""
    pieces = _pieces(items, key, text, length, coverage, piece_words)
    order = [F.col("words").asc(), F.col("item").asc(), F.col("window").asc()]
    dealt = running_sums(pieces, [], order, {"_upto": F.col("n")})
    dealt = dealt.withColumn("round", F.expr(f"_upto div {round_words}"))

    def build(table: pa.Table) -> pa.Table:
        made = Automaton()
        windows = [
            (sequence.split(b" "), window, item)
            for sequence, window, item in zip(*(table.column(c).to_pylist() for c in ("words", "window", "item")))
        ]
        for sequence, _, _ in windows:
            made.add(sequence)
        made.mark(windows)
        return pa.table({"round": table.column("round").slice(0, 1), "automaton": pa.array([pickle.dumps(made)], pa.binary())})

    return dealt.groupBy("round").applyInArrow(build, "round long, automaton binary")


def find(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    length: int = LENGTH,
    coverage: float = COVERAGE,
    round_words: int = ROUND_WORDS,
    piece_words: int = PIECE_WORDS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (array of start and end, in words; none touch) and ``hit_items`` (ids as text, ascending).

    All rows stay, in no order. Null text has no words. Items without words (null or empty text) have no windows; an item without an
    id hits words but isn't listed. Equal ids are one item. Columns of the input that have one of the new names are replaced.
    """
    spark = ready(docs)
    new = ("n_words", "hit_spans", "hit_items")
    kept = [c for c in docs.columns if c not in new]
    state = docs.select(
        *kept,
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:long,end:long>>").alias("hit_spans"),
        F.array().cast("array<string>").alias("hit_items"),
    )
    made = materialise(automata(items, item_key, item_text, length, coverage, round_words, piece_words))
    rounds = [r["round"] for r in made.select("round").orderBy("round").toLocalIterator()] or [None]
    for number, which in enumerate(rounds):
        if which is None:
            pickled = pickle.dumps(Automaton())
        else:
            pickled = made.filter(F.col("round") == which).first()["automaton"]
        shared = spark.sparkContext.broadcast(bytes(pickled))
        state = state.mapInArrow(tidy(_streamed(shared, kept.index(text))), state.schema)
        if number + 1 < len(rounds):
            state = materialise(state)
            shared.destroy()
    return state


def _streamed(shared, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = pickle.loads(shared.value)
        for batch in batches:
            for part in slices(batch):
                counts, spans, items = [], [], []
                earlier = zip(part.column(column).to_pylist(), part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist())
                for value, old_spans, old_items in earlier:
                    n, now, those = automaton.matches((value or "").encode())
                    counts.append(n)
                    spans.append(merged([*((s["start"], s["end"]) for s in old_spans), *now]))
                    items.append(sorted({*old_items, *(i for i in those if i is not None)}, key=str.encode))
                columns = [
                    *part.columns[:-3],
                    pa.array(counts, pa.int64()),
                    pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))),
                    pa.array(items, pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove(found: DataFrame, text: str = "text", most_hit: float | None = None) -> DataFrame:
    """The result of :func:`find` with the hit spans cut out of ``text``, and the new column ``words_removed``.

    A span goes from the start of its first word to the end of its last one; what is around it stays, byte by byte. With ``most_hit``,
    documents of which a larger share of the words is hit go altogether. Null text stays null.
    """
    share = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    counted = found.withColumn("words_removed", share)
    if most_hit is not None:
        counted = counted.filter(F.col("words_removed") <= F.lit(most_hit) * F.col("n_words"))
    place, spans_at = counted.columns.index(text), counted.columns.index("hit_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rest = [
                    cut(value, [(s["start"], s["end"]) for s in spans]) if spans else value
                    for value, spans in zip(part.column(place).to_pylist(), part.column(spans_at).to_pylist())
                ]
                columns = list(part.columns)
                columns[place] = pa.array(rest, part.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    # Documents without hits stay on the JVM.
    hit = counted.filter(F.size("hit_spans") > 0)
    return counted.filter(F.size("hit_spans") == 0).unionByName(hit.mapInArrow(tidy(run), T.StructType(hit.schema.fields)))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans, given in order."""
    data, out, kept_from = text.encode(), [], 0
    waiting = iter(spans)
    start, end = next(waiting)
    for number, word in enumerate(_WORD.finditer(data.lower())):
        if number == start:
            out.append(data[kept_from : word.start()])
        if number == end - 1:
            kept_from = word.end()
            start, end = next(waiting, (-1, -1))
            if end < 0:
                break
    out.append(data[kept_from:])
    return b"".join(out).decode()


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` of the result of :func:`find`."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        key,
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )
