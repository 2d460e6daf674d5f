"""Token counts of whole texts under a lower-casing word BPE, huge documents spliced from overlapping chunks.

Where a chunk may be cut. The tokenizer composes characters (nothing composes across white space), turns white space into
spaces, lower-cases character by character, takes words and drops what lies between them, and merges inside words only. A place
after ASCII white space is therefore a boundary of the whole text's encoding, whatever stands around it: it is *stable*. A place
where two overlapping chunks both start a token after white space is a stable boundary that both encodings have found, and there
they are spliced. If the overlap has none, it is doubled, and after that the chunk.

Documents below a chunk are cut at all their stable boundaries, and the counts of words seen before are remembered.
"""

from __future__ import annotations

import functools
import json
import os
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescout.llm.common import per_slice, ready, tokenizer_file

#: Characters of a chunk and of its overlap with the next one.
CHUNK, OVERLAP = 1 << 15, 256
#: Words that a worker remembers, and the longest of them in bytes.
CACHE_WORDS, CACHE_BYTES = 500_000, 64
_SPACES = " \t\n\r\x0b\x0c"


class WordCounter:
    """Counts tokens of texts; ``file`` is the content of a tokenizers file."""

    def __init__(self, file: bytes, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer

        if not white_space_separates(json.loads(file)):
            raise ValueError("the tokenizer doesn't drop white space between words, so its counts can't be spliced there")
        self.tokenizer = Tokenizer.from_str(file.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap, self.words = chunk, overlap, {}

    def count_many(self, texts: list[str]) -> list[tuple[int, int]]:
        """(UTF-8 bytes, tokens) of each text."""
        data = [t.encode() for t in texts]
        words = [d.split() if len(t) <= self.chunk else None for t, d in zip(texts, data)]
        new = {w for row in words if row for w in row if w not in self.words}
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = {w for row in words if row for w in row}
        fresh = list(new)
        found = self.tokenizer.encode_batch_fast([w.decode() for w in fresh], add_special_tokens=False)
        counts = dict(zip(fresh, map(len, found)))
        known = _Either(self.words, counts)
        out = [
            (len(d), self.spliced(t) if row is None else sum(map(known.__getitem__, row)))
            for t, d, row in zip(texts, data, words)
        ]
        self.words.update((w, n) for w, n in counts.items() if len(w) <= CACHE_BYTES)
        return out

    def spliced(self, text: str) -> int:
        """Tokens of a long text, from chunks that overlap."""
        total, at, size = 0, 0, self.chunk
        starts = self._starts(text, 0, size)
        while at + size < len(text):
            end, overlap, place = at + size, self.overlap, None
            while place is None:
                begin = max(at, end - overlap)
                following = self._starts(text, begin, begin + self.chunk)
                place = self._common(text, starts, following, begin, end)
                if place is None and begin == at:
                    break
                overlap *= 2
            if place is None:  # one word fills the chunk
                size *= 2
                starts = self._starts(text, at, at + size)
                continue
            total += bisect_left(starts, place)
            starts = following[bisect_left(following, place) :]
            at, size = place, begin + self.chunk - place
        return total + len(starts)

    def _starts(self, text: str, begin: int, end: int) -> list[int]:
        """Where the tokens of a chunk start in the text."""
        encoding = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        return [begin + start for start, _ in encoding.offsets]

    @staticmethod
    def _common(text: str, left: list[int], right: list[int], begin: int, end: int) -> int | None:
        """The last stable boundary in (begin, end) that both chunks found."""
        both = set(right)
        for place in reversed(left):
            if place <= begin:
                return None
            if place < end and place in both and text[place - 1] in _SPACES:
                return place
        return None


class _Either:
    """Looks a word up among the remembered ones, then among the new ones."""

    def __init__(self, first: dict, second: dict):
        self.first, self.second = first, second

    def __getitem__(self, word: bytes) -> int:
        n = self.first.get(word)
        return self.second[word] if n is None else n


def white_space_separates(spec: dict) -> bool:
    """Whether normalizer and pre-tokenizer are those for which the proof above holds."""
    normalizer, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    known = all(
        s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and (s["pattern"], s["content"]) == ({"Regex": "\\s+"}, " ")
        for s in steps
    )
    first = pre.get("pretokenizers", [pre])[0]
    drops = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] is True
    pattern = first.get("pattern", {}).get("Regex", "") if drops else ""
    special = all(not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
    return bool(known and drops and special and "\\S" not in pattern and "[^\\s" in pattern and not any(c.isspace() for c in pattern))


@functools.lru_cache(maxsize=2)
def _counter(file: bytes, chunk: int, overlap: int) -> WordCounter:
    return WordCounter(file, chunk, overlap)


def count_tokens(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row.

    Null and empty texts have no bytes and no tokens. Rows are neither merged nor dropped; null or repeated keys give a row each;
    other columns are ignored, whatever their names. One pass without a shuffle, in bounded memory beside the slice of rows.
    """
    file = tokenizer_file(ready(docs), path)
    source = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    fields = [source.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]

    def convert(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = _counter(file.value, chunk, overlap).count_many([x or "" for x in part.column(1).to_pylist()])
        numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([part.column(0), *numbers], [f.name for f in fields])

    return source.mapInArrow(per_slice(convert), T.StructType(fields))
