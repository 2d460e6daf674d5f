"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

Merges run by rank. Consider what is known of a text and two ways in which it may go on. The tokens of both agree up to a
front, at first the end of the known part. When a merge ``(u, v)`` joins the last agreeing token ``u`` with a token ``v`` that
only one of the two has, the front moves left by ``len(u)``. The next merge that moves it has a higher rank, and its ``v`` begins
where ``u`` began, so ``u`` is on the chain of first parts of that ``v``. The heaviest such chain of merges is therefore a lookahead
that suffices: tokens that end so many bytes before the end of the known part are final. :class:`StreamEncoder` keeps a window
of that size and emits tokens once they are final. The proof needs a proper merge list (parts are made before they are used, and
no token is made twice); other lists are refused.
"""

from __future__ import annotations

import codecs
import functools
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescout.llm.common import per_slice, ready, tokenizer_file

#: Characters that are cut from a text at a time.
SLICE = 1 << 16
#: A held-back piece that is longer than this is passed to the transducer bit by bit.
LONG_PIECE = 4096
#: Pieces that a worker remembers, and the longest of them in characters.
CACHE_PIECES, CACHE_CHARS = 400_000, 64
_NEVER = 1 << 40

# The published pre-tokenization pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ANY = regex.compile(PATTERN)
# The same pattern for texts below U+0250, spelled out for the faster engine.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_LATIN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
    f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_NOT_LATIN = re.compile("[^\x00-ɏ]")
#: What continues an open piece, by its last character.
_RUNS = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+")]


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes, in order, for the characters from 256 on.
    """
    out, spare = [], 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            out.append(chr(byte))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class MergeTable:
    """Vocabulary and merges of a byte-level BPE tokenizer file, and the lookahead that suffices for them."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        letters = byte_characters()
        byte_of = {c: i for i, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        self.products = [vocab[u + v] for u, v in merges]
        self.rank = {(vocab[u], vocab[v]): rank for rank, (u, v) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.longest = max(map(len, self.bytes_of.values()))
        self.lookahead = sufficient_lookahead(merges)
        self.pairs = _PairTable(self.rank)
        self.byte_row = np.array([*self.byte_ids, -1], np.int64)
        self.product_row = np.array([*self.products, -1], np.int64)

    def merge(self, data: bytes) -> list[int]:
        """The tokens of one piece of bytes, all merges applied by rank, leftmost first."""
        of, products = self.rank.get, self.products
        parts = [self.byte_ids[b] for b in data]
        ranks = list(map(of, zip(parts, parts[1:]), repeat(_NEVER)))
        while ranks:
            low = min(ranks)
            if low == _NEVER:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [products[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = of((parts[i - 1], parts[i]), _NEVER)
            if i < len(ranks):
                ranks[i] = of((parts[i], parts[i + 1]), _NEVER)
        return parts

    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The tokens of many pieces, each merged as in :meth:`merge`; short ones side by side in arrays."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        widths = (8, 16, 32)
        shares: dict[int, list[int]] = {w: [] for w in widths}
        for at, piece in enumerate(pieces):
            width = next((w for w in widths if len(piece) <= w), None)
            if width:
                shares[width].append(at)
            else:
                out[at] = tuple(self.merge(piece))
        for width, places in shares.items():
            for start in range(0, len(places), 8192):
                self._merge_side_by_side(pieces, places[start : start + 8192], width, out)
        return out

    def _merge_side_by_side(self, pieces: list[bytes], places: list[int], width: int, out: list) -> None:
        sizes = np.array([len(pieces[p]) for p in places])
        data = np.frombuffer(b"".join(pieces[p].ljust(width, b"\0") for p in places), np.uint8).reshape(-1, width)
        column = np.arange(width + 1)
        # A row ends in -1; one more column than any piece needs.
        ids = np.full((len(places), width + 1), -1, np.int64)
        ids[:, :width] = self.byte_row[np.where(column[:width] < sizes[:, None], data, 256)]
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        rows = np.array(places)
        while len(rows):
            line = np.arange(len(rows))
            i = ranks.argmin(1)
            low = ranks[line, i]
            done = low == _NEVER
            if done.any():
                for place, size, row in zip(rows[done].tolist(), sizes[done].tolist(), ids[done].tolist()):
                    out[place] = tuple(row[:size])
                go = ~done
                ids, ranks, rows, sizes, i, low = ids[go], ranks[go], rows[go], sizes[go], i[go], low[go]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            after = np.minimum(column + (column > i[:, None]), width)
            ids = np.take_along_axis(ids, after, 1)
            ids[line, i] = self.product_row[low]
            ids[:, -1] = -1
            sizes = sizes - 1
            ranks = np.take_along_axis(ranks, np.minimum(column[:-1] + (column[:-1] >= i[:, None]), width - 1), 1)
            ranks[:, -1] = _NEVER
            ranks[line, i] = self.pairs.ranks(ids[line, i], ids[line, np.minimum(i + 1, width)])
            back = i > 0
            ranks[line[back], i[back] - 1] = self.pairs.ranks(ids[line[back], i[back] - 1], ids[line[back], i[back]])


class _PairTable:
    """Ranks of pairs of ids, looked up for whole arrays."""

    def __init__(self, rank: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * max(1, len(rank))).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NEVER, np.int64)
        keys = [a << 32 | b for a, b in rank]
        for key, slot, value in zip(keys, self._slots(np.array(keys, np.int64)).tolist(), rank.values()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (len(self.keys) - 1)
            self.keys[slot], self.values[slot] = key, value

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shape = a.shape
        keys = (a << 32 | b).ravel()
        keys = np.where((a < 0).ravel() | (b < 0).ravel(), -2, keys)
        slots = self._slots(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], _NEVER)
        left = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] >= 0) & (keys >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)
            there = self.keys[slots[left]]
            same = there == keys[left]
            out[left[same]] = self.values[slots[left[same]]]
            left = left[~same & (there >= 0)]
        return out.reshape(shape)


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """The weight of the heaviest chain of merges by which the end of a text can change tokens before it (see above)."""
    first: dict[str, str] = {}
    moved: dict[str, int] = {}
    for u, v in merges:
        if u + v in first or any(len(x) > 1 and x not in first for x in (u, v)):
            raise ValueError(f"not a proper merge list: {u} {v}")
        first[u + v] = u
        reach, part = 0, v
        while part is not None:
            reach = max(reach, moved.get(part, 0))
            part = first.get(part)
        moved[u] = max(moved.get(u, 0), reach + len(u))
    return max(moved.values(), default=0)


class StreamEncoder:
    """Encodes one piece that arrives in parts; holds no more than lookahead + block bytes."""

    def __init__(self, table: MergeTable):
        self.table, self.held = table, b""
        self.block = max(table.lookahead, 2 * table.longest)

    def feed(self, data: bytes) -> list[int]:
        """The tokens that became final."""
        out: list[int] = []
        size = self.table.lookahead + self.block
        for at in range(0, len(data), self.block):
            self.held += data[at : at + self.block]
            while len(self.held) >= size:
                end = 0
                for token in self.table.merge(self.held[:size]):
                    after = end + len(self.table.bytes_of[token])
                    if after > self.block:
                        break
                    out.append(token)
                    end = after
                self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        """The remaining tokens; the encoder can then take another piece."""
        out, self.held = self.table.merge(self.held), b""
        return out


class _Pieces(dict):
    """Tokens of pieces seen before; a bounded memory, emptied when full."""

    def __init__(self, table: MergeTable):
        super().__init__()
        self.encoder = StreamEncoder(table)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        if len(data) <= self.encoder.block:  # its end is known, so all of it is final
            ids = tuple(self.encoder.table.merge(data))
        else:
            ids = (*self.encoder.feed(data), *self.encoder.finish())
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class TextEncoder:
    """Text to token ids, part by part; special strings inside the text become their tokens."""

    def __init__(self, table: MergeTable):
        self.table, self.pieces = table, _Pieces(table)
        names = sorted(table.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.hold = max(map(len, names), default=1) - 1

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """The tokens of several texts; pieces that are new are merged together first."""
        found = [self._pieces_of(text) for text in texts]
        new = {p for pieces in found if pieces for p in pieces if p not in self.pieces}
        if len(self.pieces) + len(new) > CACHE_PIECES:
            self.pieces.clear()
            new = {p for pieces in found if pieces for p in pieces}
        new = [p for p in new if len(p) <= CACHE_CHARS][:CACHE_PIECES]
        self.pieces.update(zip(new, self.table.merge_many([p.encode() for p in new])))
        return [
            self.encode(text) if pieces is None else list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))
            for text, pieces in zip(texts, found)
        ]

    def _pieces_of(self, text: str) -> list[str] | None:
        """The pieces of a text that is short and without special strings."""
        if len(text) > SLICE or self.special is not None and self.special.search(text):
            return None
        return split(text)

    def encode(self, text: str) -> list[int]:
        if len(text) <= SLICE:
            return self._closed(text)
        return list(chain.from_iterable(self.stream(text[i : i + SLICE] for i in range(0, len(text), SLICE))))

    def stream(self, parts: Iterable[str]) -> Iterator[list[int]]:
        """Final tokens, as parts of one text come in; memory doesn't grow with the text or its longest piece."""
        rest, run, open_piece = "", None, StreamEncoder(self.table)
        for part in chain(parts, (None,)):
            last = part is None
            rest += part or ""
            while True:
                found = self.special.search(rest) if self.special else None
                # What may still become a special string waits for the next part.
                stop = found.start() if found else len(rest) if last else len(rest) - self._unsure(rest)
                ends = last or found is not None
                ids, left, run = self._segment(rest[:stop], ends, run, open_piece)
                yield ids
                if not found:
                    rest = left + rest[stop:]
                    break
                yield [self.table.special[found[0]]]
                rest = rest[found.end() :]

    def _unsure(self, text: str) -> int:
        """The length of the longest end of ``text`` that begins a special string."""
        for n in range(min(self.hold, len(text)), 0, -1):
            if any(name.startswith(text[-n:]) for name in self.table.special):
                return n
        return 0

    def _closed(self, text: str) -> list[int]:
        if self.special is None or not self.special.search(text):
            return list(chain.from_iterable(map(self.pieces.__getitem__, split(text))))
        out, at = [], 0
        for found in self.special.finditer(text):
            out += chain.from_iterable(map(self.pieces.__getitem__, split(text[at : found.start()])))
            out.append(self.table.special[found[0]])
            at = found.end()
        return out + list(chain.from_iterable(map(self.pieces.__getitem__, split(text[at:]))))

    def _segment(self, text: str, ends: bool, run, open_piece: StreamEncoder):
        """Tokens of ``text``, the text left over for the next call, and what continues the piece left open."""
        ids: list[int] = []
        if run is not None:
            found = run.match(text)
            size = found.end() if found else 0
            if size == len(text) and not ends:
                keep = 1 if run is _RUNS[2] and size else 0
                return open_piece.feed(text[: size - keep].encode()), text[size - keep :], run
            # The last of several spaces belongs to what follows them, unless nothing does.
            size -= run is _RUNS[2] and 0 < size < len(text)
            ids = open_piece.feed(text[:size].encode()) + open_piece.finish()
            text = text[size:]
        if ends:
            return ids + list(chain.from_iterable(map(self.pieces.__getitem__, split(text)))), "", None
        pieces = split(text)
        # The last piece may go on, and the one before it may be the start of a contraction.
        ids += chain.from_iterable(map(self.pieces.__getitem__, pieces[:-2]))
        if not pieces or len(pieces[-1]) <= LONG_PIECE:
            return ids, "".join(pieces[-2:]), None
        if len(pieces) > 1:
            ids += self.pieces[pieces[-2]]
        piece = pieces[-1]
        run = next(x for x in _RUNS if x.match(piece[-1]))
        keep = 1 if run is _RUNS[2] else 0
        ids += open_piece.feed(piece[: len(piece) - keep].encode())
        return ids, piece[len(piece) - keep :], run


def split(text: str) -> list[str]:
    """The pieces of a text; merges never cross their ends."""
    return (_ANY if _NOT_LATIN.search(text) else _LATIN).findall(text)


class StreamDecoder:
    """Token ids to text, part by part: the state is the bytes of at most one unfinished character."""

    def __init__(self, table: MergeTable):
        self.table, self.state = table, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.table.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out

    def decode(self, ids: list[int]) -> str:
        """A whole text, a bounded number of tokens at a time."""
        return "".join(self.feed(ids[i : i + SLICE]) for i in range(0, len(ids), SLICE)) + self.finish()


@functools.lru_cache(maxsize=2)
def _encoder(file: bytes) -> TextEncoder:
    return TextEncoder(MergeTable(file))


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """``key``, ``ids`` (array of int) and, if asked for, ``decoded`` (the text that the ids stand for) of every row.

    Null text counts as empty, empty text has no tokens. Rows are neither merged nor dropped: null or repeated keys give a row
    each. Other columns are ignored, whatever their names. One pass without a shuffle; a task holds the slice of rows that it
    works on, the table and a bounded memory of pieces.
    """
    file = tokenizer_file(ready(docs), path)
    source = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    fields = [source.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    fields += [T.StructField("decoded", T.StringType())] if decode else []

    def convert(part: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(file.value)
        decoder = StreamDecoder(encoder.table)
        rows = encoder.encode_many([x or "" for x in part.column(1).to_pylist()])
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        flat = np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))
        columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
        if decode:
            columns.append(pa.array([decoder.decode(x) for x in rows], pa.string()))
        return pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return source.mapInArrow(per_slice(convert), T.StructType(fields))


def decode_documents(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``decoded`` of rows of token ids; null ids give null. Special tokens are written out."""
    file = tokenizer_file(ready(tokens), path)
    source = tokens.select(F.col(key).alias(key), F.col(ids).cast("array<int>").alias("_ids"))
    fields = [source.schema[key], T.StructField("decoded", T.StringType())]

    def convert(part: pa.RecordBatch) -> pa.RecordBatch:
        decoder = StreamDecoder(_encoder(file.value).table)
        texts = [None if x is None else decoder.decode(x) for x in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [f.name for f in fields])

    return source.mapInArrow(per_slice(convert), T.StructType(fields))


def digests(encoded: DataFrame) -> DataFrame:
    """Token count and digests of ids and decoded text, from the output of :func:`encode_documents`."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
