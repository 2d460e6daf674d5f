"""Vectors and token lengths of texts by pluggable functions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[list[str]], np.ndarray]


def embed_texts(
    df: DataFrame,
    text: str,
    make_encoder: Callable[[], Encoder],
    batch_size: int = 256,
    name: str = "embedding",
) -> DataFrame:
    """Embed each distinct non-null text once and join the vectors back.

    ``make_encoder`` runs once per task, so a model is loaded once, not per batch.
    """
    schema = T.StructType(
        [T.StructField(text, T.StringType()), T.StructField(name, T.ArrayType(T.FloatType()))]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for batch in batches:
            column = batch.column(0)
            for start in range(0, len(column), batch_size):
                texts = column.slice(start, batch_size)
                matrix = np.asarray(encoder(texts.to_pylist()), dtype=np.float32)
                offsets = pa.array(np.arange(len(texts) + 1) * matrix.shape[1], pa.int32())
                vectors = pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1)))
                yield pa.RecordBatch.from_arrays([texts, vectors], [text, name])

    distinct = df.select(text).filter(F.col(text).isNotNull()).distinct()
    return df.join(distinct.mapInArrow(encode, schema), text, "left")


def hashing_encoder(dim: int = 64) -> Callable[[], Encoder]:
    """A deterministic stand-in for a model: words hashed by md5 into ``dim`` signed counts, scaled to length one.

    Words are separated by spaces, tabs and line breaks and compared in lower case.
    """

    def make() -> Encoder:
        word = re.compile(r"[^ \t\n\r]+")

        def encode(texts: list[str]) -> np.ndarray:
            counts = [Counter(word.findall(text.lower())) for text in texts]
            hashes = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for c in counts for w in c}
            out = np.zeros((len(texts), dim))
            for row, found in enumerate(counts):
                for token, n in found.items():
                    out[row, (hashes[token] >> 1) % dim] += n if hashes[token] & 1 else -n
            lengths = np.sqrt((out**2).sum(axis=1))
            return (out / np.where(lengths > 0, lengths, 1.0)[:, None]).astype(np.float32)

        return encode

    return make


def token_lengths(make_tokenizer: Callable[[], Callable[[list[str]], Sequence[int]]]) -> Callable[..., Column]:
    """Column function for the number of tokens of a text; a null text has 0.

    The tokenizer gets a list of texts and returns their lengths.
    """

    @F.pandas_udf(T.IntegerType())
    def lengths(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make_tokenizer()
        for texts in series:
            out = np.zeros(len(texts), dtype=np.int32)
            present = texts.notna().to_numpy()
            if present.any():
                out[present] = tokenizer(texts[present].tolist())
            yield pd.Series(out)

    return lengths


def split_tokenizer() -> Callable[[list[str]], Sequence[int]]:
    """Whitespace tokenizer, the default where no model tokenizer is at hand."""
    return lambda texts: [len(text.split()) for text in texts]
