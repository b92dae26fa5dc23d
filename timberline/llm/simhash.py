"""SimHash near-dedup by meet-in-the-middle ball hashing.

Every distinct fingerprint emits itself and all fingerprints within half the radius; two fingerprints within the radius
then meet at a common variant. A variant is met by the fingerprints of its own ball only, 65 of them at radius 2,
however many documents have them. The members of a meeting are verified against its smallest member; as links within a
ball hold between all its members, the star keeps every connection. Components come from alternating large-star and
small-star rounds, cut by checkpoints.

Defined results: null and blank texts have the fingerprint zero and link like any other. Null doc_ids take part; a
component whose ids are all null has a null id. Repeated rows return once each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, as_bytes, carrying, cut, keyed_rows

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes whose bits are counted at once.
_BLOCK = 1 << 16


def _fingerprint(text: bytes, shingle: int, seed: int, table: np.ndarray) -> int:
    words = text.translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    begins = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=begins[1:])
    digest, a, b = xxhash.xxh64_intdigest, begins[: n - shingle + 1].tolist(), (begins[shingle:] - 1).tolist()
    hashes = np.fromiter((digest(line[i:j], seed) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[i : i + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((_fingerprint(t.as_py(), shingle, seed, _LOWER) for t in as_bytes(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long")


def _masks(radius: int) -> list[int]:
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(1 << i for i in bits)) for k in range(radius + 1) for bits in combinations(range(64), k)]


def ball_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints ``fp`` that join all within ``radius`` (even) of each other."""
    if radius % 2 or not 0 < radius <= 6:
        raise ValueError("radius must be 2, 4 or 6")
    masks = F.array(*[F.lit(m) for m in _masks(radius // 2)])
    # by number, so that the few small rows aren't gathered before they are spread out
    spread = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    met = spread.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("variant"))
    # one shuffle of (fp, variant); a variant has the fingerprints of its own ball only
    least = F.min("fp").over(Window.partitionBy("variant"))
    stars = met.withColumn("a", least).filter("a < fp").select("a", F.col("fp").alias("b")).distinct()
    return stars.filter(F.expr("bit_count(a ^ b)") <= radius)


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b): root is the smallest node reachable."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == state or now[0] == 0:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach) of each row of ``docs`` (doc_id, text)."""
    marked = cut(fingerprints(docs, shingle, seed))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(ball_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(rooted.join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    """The columns of ``op8``: doc_id, fingerprint, component_id."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@carrying
def stage(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies in ``docs`` (five-word shingles, similarity 0.8 or more; op8's radius binds
    op8 only): the one with the smallest doc_id, or without doc_id where none has one."""
    from .nearcopies import near_copies

    rows = keyed_rows(docs)
    keep = near_copies(rows.select(F.col(ROW).alias("key"), "text")).filter("key = component").select(F.col("key").alias(ROW))
    return rows.join(keep, ROW, "left_semi").select(*docs.columns)
