"""Model plug-ins: text encoder, pair scorer and sparse encoder, with defaults needing no model.

A plug-in is a function over one batch. It runs inside a map over batches, so a real model is loaded
once per Python worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, types as ty

Encoder = Callable[[list[str]], np.ndarray]
PairScorer = Callable[[list[str], list[str]], np.ndarray]
SparseEncoder = Callable[[list[str]], list[dict[str, float]]]

#: Rows that an encoder gets at once, and words whose place it remembers.
ROWS = 1000
KNOWN = 100_000

_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def hashing_encoder(dims: int = 64) -> Encoder:
    """Signed feature hashing of lower-case words, unit length; blank text gives zeros."""
    place: dict[str, tuple[int, int]] = {}

    def encode(texts: list[str]) -> np.ndarray:
        if len(place) > KNOWN:
            place.clear()
        out = np.zeros((len(texts), dims))
        for row, text in enumerate(texts):
            for word in _SPACE.split(text.lower()):
                if not word:
                    continue
                if word not in place:
                    digest = hashlib.md5(word.encode()).digest()
                    place[word] = (int.from_bytes(digest[:4], "big") % dims, 1 if digest[4] < 128 else -1)
                bucket, sign = place[word]
                out[row, bucket] += sign
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1.0, norm)
    return encode


def embed(df: DataFrame, encoder: Encoder, text: str = "text", to: str = "embedding",
          dims: int | None = None) -> DataFrame:
    """Add an embedding column; a batch with another shape than (rows, dims) is an error."""
    schema = ty.StructType(df.schema.fields + [ty.StructField(to, ty.ArrayType(ty.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                vectors = np.asarray(encoder(["" if t is None else str(t) for t in batch.column(text).to_pylist()]), dtype="float64")
                if vectors.ndim != 2 or len(vectors) != batch.num_rows or (dims and vectors.shape[1] != dims):
                    raise ValueError(f"encoder returned shape {vectors.shape} for {batch.num_rows} texts")
                limits = np.arange(batch.num_rows + 1) * vectors.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(vectors.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, to])

    return df.mapInArrow(run, schema)


def score_pairs(pairs: DataFrame, scorer: PairScorer, query: str = "query", text: str = "text",
                to: str = "score") -> DataFrame:
    """Add a score for each (query, text) row from a pair model."""
    schema = ty.StructType([f for f in pairs.schema.fields if f.name != to]
                           + [ty.StructField(to, ty.DoubleType())])
    names = schema.names[:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = np.asarray(scorer(list(pdf[query]), list(pdf[text])), dtype="float64")
            yield pdf[names].assign(**{to: scores})

    return pairs.mapInPandas(run, schema)


def sparse_terms(df: DataFrame, encoder: SparseEncoder, key: str, text: str = "text") -> DataFrame:
    """Long form (key, term, weight) from a sparse text model."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, term, float(w)) for k, weights in zip(pdf[key], encoder(list(pdf[text])))
                    for term, w in weights.items()]
            yield pd.DataFrame(rows, columns=[key, "term", "weight"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {key_type}, term string, weight double")
