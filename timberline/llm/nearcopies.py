"""Near copies by word shingles: the ball hashing of SimHash fingerprints proposes pairs and MinHash bands add what its radius
doesn't reach; the exact Jaccard similarity of the shingle sets decides.

Texts with equal shingle sets are one node. Nodes whose fingerprints (those of op8) are within two bits meet through the variants
of their balls, nodes of one fingerprint at the first of them. Such close fingerprints belong to nearly equal texts only, so nodes that
share a MinHash band meet too. First all nodes of a band are compared with its
centre, the node that meets the most others. What these links haven't joined is compared pair by pair, but for pairs that cannot be similar:
the overlap of two sets is at most the lesser overlap with the centre, and the lesser number of what neither the centre has
nor that one set alone. These bounds are exact, so no pair that shares a band is left out of the components. A pair at the
threshold of 0.8 shares none of the 42 bands of six with a probability of 3e-6, a more similar pair with less.

Defined results: letters A-Z are folded, words are those of the contracts. A text with fewer words than a shingle is one
shingle; null and blank texts are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chain, cut, grams, hashed_words, mix
from .simhash import _LOWER, _fingerprint, ball_links, components

BANDS, ROWS = 42, 6
#: Bits by which fingerprints that meet may differ, and the words of their shingles.
RADIUS, FINGERPRINT = 2, 3
#: Documents whose shingles are hashed at once.
_DOCS = 256


def _sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted, distinct shingle hashes of each text; at least one."""
    words, bounds = hashed_words(pa.array([t.translate(_LOWER) for t in texts], pa.large_binary()))
    runs = grams(words, size)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(runs[lo : hi - size + 1]))
            continue
        short = np.full(1, hi - lo, np.uint64)
        for i in range(lo, hi):
            short = chain(short, words[i : i + 1])
        out.append(short)
    return out


def _bands(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """The band hashes of each set, one row each."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    seeds = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) + np.uint64(seed << 20))
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        value = np.full(len(sets), band, np.uint64)
        for s in seeds[band * ROWS : (band + 1) * ROWS]:
            value = chain(value, np.minimum.reduceat((flat ^ s) * (s | np.uint64(1)), starts))
        out[:, band] = value
    return out


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).view(np.int64)))


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list[bytes], list[np.ndarray]]]:
    for b in batches:
        for lo in range(0, b.num_rows, _DOCS):
            piece = b.slice(lo, _DOCS)
            texts = as_bytes(piece.column(1)).to_pylist()
            yield piece.column(0), texts, _sets(texts, size)


def _sketches(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, sets in _pieces(batches, size):
            fps = np.fromiter((_fingerprint(t, FINGERPRINT, seed, _LOWER) for t in texts), np.uint64, len(texts)).view(np.int64)
            same = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([keys, pa.array(list(map(len, sets)), pa.int32()), pa.array(same[:, 0]), pa.array(same[:, 1]), pa.array(fps), _lists(list(_bands(sets, seed)))], names=["key", "n", "d1", "d2", "fp", "bands"])

    return run


def _shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, sets in _pieces(batches, size):
            yield pa.RecordBatch.from_arrays([keys, _lists(sets)], names=["key", "items"])

    return run


def _sets_of(keys: DataFrame, own: DataFrame, shingle: int) -> DataFrame:
    """key, items (the shingles) of the rows of ``own`` that ``keys`` (key) names."""
    return cut(own.join(keys, "key", "left_semi").select("key", "text").mapInArrow(_shingles(shingle), "key long, items array<long>"))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with n and m (the sizes of the sets of a and b) and both (their overlap)."""
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.join(left, "a").join(right, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("both"))


def _within_balls(marked: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``marked`` (key, fp): the first key of each fingerprint with its others, and with the first keys of the fingerprints
    that ball hashing links to it."""
    heads = cut(marked.groupBy("fp").agg(F.min("key").alias("head")))
    same = marked.join(heads, "fp").filter("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b"))
    links = ball_links(heads.select("fp"), RADIUS).toDF("f", "g")
    near = links.join(heads.toDF("f", "a"), "f").join(heads.toDF("g", "b"), "g").select("a", "b")
    return same.unionByName(near)


def _similar(both, n, m, least: float):
    return both >= least * (n + m - both) - 1e-9


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, seed: int = 42) -> DataFrame:
    """key, component (the smallest key that links reach) of the rows of ``docs`` (key, text) that are the first with their
    shingles; all others are copies of one of these. ``key`` is a long of each row's own."""
    own = docs.select(F.col("key").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    marked = cut(own.mapInArrow(_sketches(shingle, seed), "key long, n int, d1 long, d2 long, fp long, bands array<long>"))
    firsts = cut(marked.groupBy("d1", "d2").agg(F.min("key").alias("key")).select("key"))
    rows = marked.join(firsts, "key", "left_semi").select("key", "n", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    met = cut(rows.join(sizes, "band"))
    popular = met.groupBy("key").agg(F.sum("size").alias("pop"))
    centres = met.join(popular, "key").groupBy("band").agg(F.max(F.struct("pop", (-F.col("key")).alias("k"))).alias("top")).select("band", (-F.col("top.k")).alias("centre"))
    members = cut(met.select("band", "key", "n").join(centres, "band"))
    close = _within_balls(marked.join(firsts, "key", "left_semi").select("key", "fp"))
    stars = cut(members.filter("key <> centre").select(F.col("key").alias("a"), F.col("centre").alias("b")).unionByName(close).distinct())
    ends = stars.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    tested = cut(_overlaps(stars, _sets_of(ends, own, shingle)))
    links = tested.filter(_similar(F.col("both"), F.col("n"), F.col("m"), least)).select("a", "b")
    joined = cut(components(links))
    rooted = members.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    split = rooted.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("band")
    known = tested.select(F.col("a").alias("key"), F.col("b").alias("centre"), "both")
    still = cut(rooted.join(split, "band", "left_semi").join(known, ["key", "centre"], "left").withColumn("o", F.coalesce("both", "n")).select("band", "key", "n", "centre", "root", "o"))
    sets = _sets_of(still.select("key").distinct(), own, shingle)
    alone = sets.select("key", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("c"), F.min("key").alias("key")).filter("c = 1").groupBy("key").agg(F.count("*").alias("alone"))
    left = still.join(alone, "key", "left").withColumn("e", F.col("n") - F.col("o") - F.coalesce("alone", F.lit(0))).filter(F.col("o") + F.col("e") >= least * F.col("n") - 1e-9).drop("alone")
    left = cut(left.join(left.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("band"), "band", "left_semi"))
    most = F.least("o", "p") + F.least("e", "f")
    both = left.toDF("band", "a", "n", "centre", "ra", "o", "e").join(left.drop("centre").toDF("band", "b", "m", "rb", "p", "f"), "band")
    pairs = both.filter("a < b and ra <> rb").filter(_similar(F.least("n", "m"), F.col("n"), F.col("m"), least) & _similar(most, F.col("n"), F.col("m"), least)).select("a", "b").distinct()
    more = cut(_overlaps(pairs, sets)).filter(_similar(F.col("both"), F.col("n"), F.col("m"), least)).select("a", "b")
    roots = components(links.unionByName(more)).withColumnRenamed("node", "key")
    return firsts.join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("component"))
