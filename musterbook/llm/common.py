"""Small helpers that the text operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space, the only characters between words.
SPACE = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that all executors share and read again.

    Cuts the lineage: what follows reads files, whichever executor is lost. The folder is
    the cluster's ``spark.checkpoint.dir``; a local one takes its place only in local mode.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "musterbook")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_list(text: Column) -> Column:
    """Words of a text in order; none for NULL."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def id_remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(df: DataFrame, name: str) -> str:
    """A column name near ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# Numpy helpers for Arrow batches


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts back to back, and the offsets of each text (one more than texts)."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = 1 << 21, most: int = 4096):
    """Slices of a batch of about ``size`` text bytes and at most ``most`` rows each, so that work arrays stay small."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, total = 0, 0
    for row, length in enumerate(lengths):
        if row > first and (total + length > size or row - first == most):
            yield batch.slice(first, row - first)
            first, total = row, 0
        total += length
    if first < batch.num_rows:
        yield batch.slice(first)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit multiplicative hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def pack_small(*arrays: np.ndarray) -> bytes:
    """As ``pack``, with more time for less space."""
    return pack(*arrays, level=6)


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    sizes = np.frombuffer(raw, np.int64, len(dtypes), 8)
    ends = 8 * (len(dtypes) + 1) + np.cumsum(sizes)
    return [np.frombuffer(raw[e - s : e], t) for s, e, t in zip(sizes, ends, dtypes)]
