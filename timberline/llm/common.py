"""What several operators share: lineage cuts, word splitting and rolling hashes over Arrow buffers."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import ranked

#: The column of keyed_rows.
ROW = "_tl_row"
#: A word of the contracts: a run of bytes outside this set.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Text is hashed in pieces of about so many bytes, whole documents each, to bound memory.
PIECE_BYTES = 2 << 20


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a new local one only where it names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="timberline-checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in that folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a long of its own for each row as ROW, in the order of doc_id (nulls last).

    That is doc_id where it is unique and never null. Otherwise it is the row's exact rank by doc_id and two hashes of all its
    columns (but maps), so it doesn't depend on how the rows are laid out: only rows that are alike in everything may change places.
    """
    own = F.col("doc_id").cast("long")
    rows, different = docs.agg(F.count("*"), F.count_distinct(own)).first()
    if rows == different:
        return docs.withColumn(ROW, own)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    # the random numbers spread rows that are alike over the ranges
    return ranked(docs, [own.isNull(), own, F.xxhash64(*hashed), F.xxhash64(F.lit(1), *hashed), F.rand(7)], name=ROW)


#: What documents have; a stage takes other columns along without a look at them.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def carrying(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage`` of documents and more, for documents whose other columns may have any name: they travel in one struct."""

    @wraps(stage)
    def run(docs: DataFrame, *more) -> DataFrame:
        names = docs.columns
        extra = [c for c in names if c not in DOCUMENT]
        if not extra:
            return stage(docs, *more)
        packed = docs.select(*[c for c in names if c in DOCUMENT], F.struct(*[F.col(f"`{c}`").alias(f"e{i}") for i, c in enumerate(extra)]).alias("_tl_extra"))
        out = stage(packed, *more)
        return out.select(*[F.col(c) if c in DOCUMENT else F.col(f"_tl_extra.e{extra.index(c)}").alias(c) for c in names])

    return run


def as_bytes(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one binary array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    return column.fill_null(b"")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of its two parts."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def word_bounds(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, whose documents lie between ``offsets``; ``blank`` marks the bytes between words where
    they aren't those of the contracts."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~(_SPACE[data] if blank is None else blank)
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[1:-1][edges]
    ends[edges - 1] = inside[1:-1][edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each word's 64-bit hash, and where each document's words begin and end in that array (n + 1 offsets)."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    hashes, counts, d = [], [], 0
    while d < len(texts):
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + PIECE_BYTES, side="right")) - 1)
        lo, hi = int(offsets[d]), int(offsets[e])
        piece, own = data[lo:hi], offsets[d : e + 1] - lo
        if hi == lo:
            counts.append(np.zeros(e - d, np.int64))
            d = e
            continue
        begin, end = word_bounds(piece, own)
        power = np.full(len(piece) + 1, _BASE, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        power = np.full(len(piece) + 1, _BASE_INV, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        hashes.append(mix((total[end] - total[begin]) * power[begin] + (end - begin).astype(np.uint64)))
        counts.append(np.diff(np.searchsorted(begin, own)))
        d = e
    bounds = np.zeros(len(texts) + 1, np.int64)
    if counts:
        np.cumsum(np.concatenate(counts), out=bounds[1:])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), bounds


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each place on, regardless of document ends."""
    out, power, at, step = None, words, 0, 1
    while True:
        if size & step:
            if out is None:
                out = power
            else:
                n = max(0, min(len(out), len(power) - at))
                out = chain(out[:n], power[at : at + n])
            at += step
        step *= 2
        if step > size:
            return out
        half = step // 2
        power = chain(power[: max(0, len(power) - half)], power[half:])
