"""Text and image encoders: a built-in hashed one, and a hook for real models."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import text as X
from shelfmark.functions.parsing import is_blank
from shelfmark.session import spread

BATCH_ROWS = 100
#: Words whose buckets a task remembers.
VOCABULARY = 1_000_000


def bucket(word: Column, dim: int) -> Column:
    """A stable bucket number of a word, the same in every engine: 28 digest bits."""
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def word_buckets(dim: int) -> Callable[[str], int]:
    """``bucket`` for the words of a task, which mostly come again."""
    known: dict[str, int] = {}

    def of(word: str) -> int:
        if word not in known:
            if len(known) >= VOCABULARY:
                known.clear()
            known[word] = int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % dim
        return known[word]

    return of


def encode_text_hashed(df: DataFrame, column: str, dim: int = 256) -> DataFrame:
    """(pid, embedding): unit vectors of word counts per hash bucket, a row per text; a text without
    words has none. A text is one row, so it is counted where it lies and nothing is shuffled."""
    out = T.StructType([df.schema["pid"], T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, of = re.compile(X.WORD).findall, word_buckets(dim)
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = find(text or "")
                if words:
                    n = np.bincount([of(w) for w in words], minlength=dim).astype(np.float64)
                    at.append(i)
                    rows.append(n / np.sqrt((n * n).sum()))
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, dim * len(rows) + 1, dim), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), lists], names=out.names)

    return spread(df.select("pid", column), "pid").select("pid", F.lower(column).alias("text")).mapInArrow(run, out)


class Encoder(Protocol):
    """What a model has to offer: one unit vector, or None, per input."""

    def encode(self, batch: Sequence) -> Sequence[np.ndarray | None]: ...


def encode_column(df: DataFrame, column: str, make_encoder: Callable[[], Encoder], batch_rows: int = BATCH_ROWS) -> DataFrame:
    """(pid, embedding) from a model that each Python worker builds once. Inputs that the
    model cannot read are left out."""
    out = T.StructType([df.schema["pid"], T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for frame in frames:
            for at in range(0, len(frame), batch_rows):
                part = frame.iloc[at : at + batch_rows]
                vectors = encoder.encode(part[column].tolist())
                rows = [(p, np.asarray(v, "float64")) for p, v in zip(part["pid"], vectors) if v is not None]
                yield pd.DataFrame(rows, columns=["pid", "embedding"])

    return df.select("pid", column).filter(F.col(column).isNotNull()).mapInPandas(run, out)


def encode_text(df: DataFrame, column: str, make_encoder: Callable[[], Encoder] | None = None, dim: int = 256) -> DataFrame:
    named = df.filter(~is_blank(F.col(column)))
    return encode_column(named, column, make_encoder) if make_encoder else encode_text_hashed(named, column, dim)


class GraymapEncoder:
    """Pixels of binary portable graymaps (P5) as a unit vector: a stand-in for a vision
    model that needs no image library."""

    def encode(self, batch: Sequence[bytes]) -> list[np.ndarray | None]:
        return [self._one(bytes(image)) for image in batch]

    @staticmethod
    def _one(image: bytes) -> np.ndarray | None:
        head = image.split(None, 4)
        if len(head) < 5 or head[0] != b"P5":
            return None
        wide, high = int(head[1]), int(head[2])
        pixels = np.frombuffer(image[-wide * high :], "uint8").astype("float64")
        length = np.linalg.norm(pixels)
        return pixels / length if len(pixels) == wide * high and length > 0 else None


def encode_image(images: DataFrame, make_encoder: Callable[[], Encoder] = GraymapEncoder, column: str = "content") -> DataFrame:
    return encode_column(images, column, make_encoder)
