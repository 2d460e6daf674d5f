"""Language identification of texts that may mix languages.

Training counts byte n-grams (of 1 to ``ORDER`` bytes, hashed into ``BUCKETS`` places) per language, in all rows that are given.
A text is cut into units of a few words. A unit's likelihood under a language is the product of its n-gram probabilities, and the
text is a mixture: each unit belongs to one language, in proportions that expectation-maximisation estimates. The set of
languages is chosen by penalised likelihood: starting from the best single language, the language that raises the likelihood most
is added as long as the rise exceeds the penalty (half the logarithm of the number of n-grams, per language added).
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescout.llm.common import ready, slices

#: Longest n-gram in bytes, and places that n-grams are hashed into.
ORDER, BUCKETS = 4, 1 << 16
#: Words of a unit, rounds of expectation-maximisation, and the change of a proportion at which they end.
UNIT_WORDS, ROUNDS, CHANGE = 4, 50, 1e-4
#: Added to every count, so that n-grams never seen have a probability.
SMOOTHING = 0.1
#: Bytes of a text that are worked on at a time.
PIECE = 1 << 20
UNDETERMINED = "und"
#: Bytes of letters: A-Z become lower case, other ASCII but letters become a space, all bytes of longer characters stay.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the spaces of the folded bytes are (repeated ones removed), and ``ORDER`` rows with the place of the n-gram that ends at
    each byte."""
    folded = _FOLD[np.frombuffer(data, np.uint8)]
    space = folded == 32
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    folded = np.concatenate([[np.uint8(32)], folded[keep], [np.uint8(32)]])
    code, rows = folded.astype(np.uint32), []
    for n in range(ORDER):
        if n:
            code = code.copy()
            code[n:] = (code[n:] * np.uint32(257)) ^ (_shifted(folded, n)[n:] * np.uint32(2654435761 + 2 * n))
        rows.append(((code * np.uint32(2654435761) + np.uint32(n)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64))
    return folded == 32, np.stack(rows)


def _shifted(values: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros(len(values), np.uint32)
    out[by:] = values[:-by]
    return out


def pieces(data: bytes) -> Iterator[bytes]:
    """A text in parts that end at white space where there is any."""
    while len(data) > PIECE:
        cut = data.rfind(b" ", 1, PIECE) if b" " in data[1:PIECE] else PIECE
        yield data[:cut]
        data = data[cut:]
    yield data


class Model:
    """Log probabilities of hashed n-grams under each language, a table of ``ORDER`` x ``BUCKETS`` numbers per language."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    @classmethod
    def from_counts(cls, counts: dict[str, np.ndarray]) -> Model:
        languages = sorted(counts)
        stacked = np.stack([counts[x] for x in languages], axis=-1).reshape(ORDER, BUCKETS, len(languages)) + SMOOTHING
        return cls(languages, np.log(stacked / stacked.sum(1, keepdims=True)).astype(np.float32))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, languages=np.array(self.languages), table=self.table)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        held = np.load(io.BytesIO(data))
        return cls([str(x) for x in held["languages"]], held["table"])

    def units(self, text: str) -> tuple[np.ndarray, int]:
        """Log likelihoods (units x languages) of a text, and how many n-grams they are made of."""
        found, size = [], 0
        for part in pieces(text.encode()):
            space, places = grams(part)
            if len(space) <= 2:
                continue
            # The mean over the orders: the n-grams that end at one byte are not independent.
            at_byte = self.table[0][places[0]]
            for n in range(1, ORDER):
                at_byte = at_byte + self.table[n][places[n]]
            words = np.flatnonzero(space[:-1])[::UNIT_WORDS]
            found.append(np.add.reduceat(at_byte, words, axis=0) / ORDER)
            size += len(space)
        if not found:
            return np.zeros((0, len(self.languages))), 0
        return np.concatenate(found).astype(np.float64), size

    def mixture(self, text: str) -> np.ndarray:
        """The proportions of the languages in a text; zero for those outside the chosen set."""
        units, size = self.units(text)
        shares = np.zeros(len(self.languages))
        if not len(units):
            return shares
        top = units.max(1, keepdims=True)
        likely = np.exp(units - top)
        chosen = [int(np.argmax(units.sum(0)))]
        best, proportions = float((units[:, chosen[0]] - top[:, 0]).sum()), np.ones(1)
        penalty = 0.5 * np.log(max(size, 2))
        while len(chosen) < len(self.languages):
            trials = []
            for k in range(len(self.languages)):
                # A language that is nowhere the likeliest of the set and itself can hardly help; the bound is exact.
                bound = np.log(np.maximum(likely[:, chosen].max(1), likely[:, k]) + 1e-300).sum()
                if k not in chosen and bound - best > penalty:
                    trials.append((*_fit(likely[:, [*chosen, k]]), k))
            if not trials:
                break
            value, weights, k = max(trials, key=lambda t: (t[0], -t[2]))
            if value - best <= penalty:
                break
            chosen, best, proportions = [*chosen, k], value, weights
        shares[chosen] = proportions
        return shares


def _fit(likely: np.ndarray) -> tuple[float, np.ndarray]:
    """Log likelihood and proportions of a mixture, by expectation-maximisation from equal proportions."""
    weights = np.full(likely.shape[1], 1 / likely.shape[1])
    for _ in range(ROUNDS):
        joint = likely * weights
        new = (joint / np.maximum(joint.sum(1, keepdims=True), 1e-300)).mean(0)
        done = np.abs(new - weights).max() < CHANGE
        weights = new
        if done:
            break
    return float(np.log((likely * weights).sum(1) + 1e-300).sum()), weights


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all rows with text and a language. Counts are summed on the executors.

    Each task sends one table per language that it has seen, and these are added up by language and stripe, so what is shuffled
    depends on tasks and languages. The model comes to the driver: ``4 * ORDER * BUCKETS`` bytes (1 MB) for each language.
    """
    ready(docs)
    source = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string"), F.col(text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                for name, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held = tables.setdefault(name, np.zeros((ORDER, BUCKETS), np.int64))
                    for piece in pieces(value.encode()):
                        places = grams(piece)[1]
                        for n in range(ORDER):
                            held[n] += np.bincount(places[n], minlength=BUCKETS)
        for name, held in tables.items():
            for n in range(ORDER):
                places = np.flatnonzero(held[n])
                for at in range(0, len(places), 4096):
                    some = places[at : at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(some)), pa.array(some + n * BUCKETS), pa.array(held[n][some])], ["lang", "place", "n"]
                    )

    counted = source.mapInArrow(count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    # At most ORDER x BUCKETS rows for each language.
    for part in counted.groupBy("lang").agg(F.collect_list(F.struct("place", "n")).alias("held")).toLocalIterator():
        flat = np.zeros(ORDER * BUCKETS)
        flat[[x.place for x in part.held]] = [x.n for x in part.held]
        counts[part.lang] = flat
    return Model.from_counts(counts) if counts else Model([], np.zeros((ORDER, BUCKETS, 0), np.float32))


@functools.lru_cache(maxsize=2)
def _loaded(data: bytes) -> Model:
    return Model.load(data)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", rows: bool = False) -> DataFrame:
    """``key`` (or, if ``rows`` is set, the whole row as the struct ``row``), ``lang_pred``, ``score`` (its proportion, 0 to 1) and ``languages`` (name to proportion, of the chosen set).

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. Only the text decides: repeated rows get
    the same answer, other columns are ignored. The first of the learned names wins a tie.
    """
    spark = ready(docs)
    held = spark.sparkContext.broadcast(model.dump())
    if rows:
        source = docs.select(F.struct(*docs.columns).alias("row"))
    else:
        source = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    shares = T.MapType(T.StringType(), T.DoubleType())
    fields = [source.schema.fields[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    fields.append(T.StructField("languages", shares))

    def one(known: Model, value: str | None) -> tuple[str, float, list]:
        if value is None or not known.languages or not any(map(str.isalpha, value)):
            return UNDETERMINED, 0.0, []
        found = known.mixture(value)
        best = int(np.argmax(found))
        return known.languages[best], min(1.0, float(found[best])), [(known.languages[k], float(found[k])) for k in np.flatnonzero(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _loaded(held.value)
        for batch in batches:
            for part in slices(batch):
                texts = pc.struct_field(part.column(0), text) if rows else part.column(1)
                found = [one(known, x) for x in texts.to_pylist()]
                columns = [part.column(0), pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.float64())]
                columns.append(pa.array([r[2] for r in found], pa.map_(pa.string(), pa.float64())))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))


def held_out(key: Column | str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the key as text has the remainder 2 by 4. False for a null key."""
    column = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))
