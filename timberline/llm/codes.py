"""Vector code compression: product quantisation in whole numbers, with codebooks that every run finds alike.

Components become whole numbers, vectors are cut into consecutive parts, and each part position has a codebook of its own. A
codebook is a few hundred entries, so it is broadcast; Arrow batches of vectors compute the distances to all entries by the expansion
|x|^2 - 2 x.c + |c|^2 with exact 64-bit products, of which |x|^2 isn't needed to find the first smallest. A task sums the
parts of each entry over all its batches and sends one row for each entry that it used; a grouped shuffle merges these in every round, and
only the merged sums, one row for each part position and entry, come to the driver to be the next codebooks.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. Vectors of different length have
codebooks of their own length. Parts are cut at floor(k * length / parts), so they are equal where the length allows it. Rows without id come
behind all others in the choice of first entries, rows with one id in the order of their components. Components beyond what exact
distances of 64 bits allow (2 ** 27 for 64 components, 131,072 times the unit) count as that bound. ``label_error`` is null if its sum leaves 64 bits.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Labels whose sums are broadcast; more are joined by a shuffle.
FEW_LABELS = 100_000
#: Vectors whose distances are held at once.
_BLOCK = 2048


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole_numbers(m: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * m), held within the bound that keeps every sum of squared differences below 2 ** 62."""
    bound = math.isqrt((1 << 62) // (4 * max(1, m.shape[1])))
    return np.clip(np.floor(m * scale), -bound, bound).astype(np.int64)


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    return [(k * length // parts, (k + 1) * length // parts) for k in range(parts)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of ``book`` for each row of ``x``, and its squared distance."""
    best, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    norms = (book * book).sum(axis=1)
    turned = np.ascontiguousarray(book.T)
    for i in range(0, len(x), _BLOCK):
        own = x[i : i + _BLOCK]
        d = norms[None, :] - 2 * (own @ turned)
        k = d.argmin(axis=1)
        best[i : i + _BLOCK] = k
        far[i : i + _BLOCK] = d[np.arange(len(k)), k] + (own * own).sum(axis=1)
    return best, far


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _sums(books, scale: int):
    """Rows (part, entry, n, sums): what a task's vectors add to the entries they are nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        totals = [np.zeros_like(b) for b in own]
        counts = [np.zeros(len(b), np.int64) for b in own]
        for b in batches:
            if not b.num_rows:
                continue
            m = whole_numbers(_matrix(b.column(0)), scale)
            for k, (lo, hi) in enumerate(bounds(m.shape[1], len(own))):
                entry, _ = nearest(m[:, lo:hi], own[k])
                np.add.at(totals[k], entry, m[:, lo:hi])
                counts[k] += np.bincount(entry, minlength=len(own[k]))
        for k, n in enumerate(counts):
            used = np.flatnonzero(n)
            if len(used):
                t = totals[k][used]
                sums = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * t.shape[1]), pa.array(t.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), sums], names=["part", "entry", "n", "sums"])

    return run


def _codes(books, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        for b in batches:
            m = whole_numbers(_matrix(b.column(2)), scale)
            found = [nearest(m[:, lo:hi], own[k]) for k, (lo, hi) in enumerate(bounds(m.shape[1], len(own)))]
            table = np.column_stack([e for e, _ in found]).astype(np.uint8)
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes().hex() for r in table], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def first_books(own: DataFrame, length: int, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """The parts of the first ``entries`` rows of ``own`` (vec_id, v) by id."""
    numbers = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    rows = own.select("vec_id", "v", numbers.cast("array<double>").alias("_by")).orderBy(F.col("vec_id").asc_nulls_last(), "_by").limit(entries).collect()  # ``entries`` rows at most
    m = whole_numbers(np.array([r["v"] for r in rows], np.float64).reshape(len(rows), length), scale)
    return [np.ascontiguousarray(m[:, lo:hi]) for lo, hi in bounds(length, parts)]


def fit_books(own: DataFrame, length: int, parts: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    """Codebooks of ``own`` (vec_id, v), whose vectors have ``length`` components, after ``rounds`` rounds."""
    sc = own.sparkSession.sparkContext
    books = first_books(own, length, parts, entries, scale)
    widest = max(hi - lo for lo, hi in bounds(length, parts))
    for _ in range(rounds):
        shared = sc.broadcast(books)  # entries x length numbers
        added = own.select("v").mapInArrow(_sums(shared, scale), "part int, entry int, n long, sums array<long>")
        merged = added.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(widest)]).cast("array<long>").alias("sums")).collect()  # parts x entries rows at most
        books = [b.copy() for b in books]
        for r in merged:
            book = books[r["part"]]
            book[r["entry"]] = [s // r["n"] for s in r["sums"][: book.shape[1]]]
        shared.unpersist()
    return books


def codebooks_text(books: list[np.ndarray]) -> str:
    return ",".join(str(x) for b in books for x in b.ravel().tolist())


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """(vec_id, label, code, error, codebooks_sha256) of ``vectors`` (vec_id, embedding, label) and the codebooks by length.

    ``entries`` is 256 at most, so an index is one byte.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.col("label")).filter(usable(F.col("v")))
    lengths = sorted(r["d"] for r in own.select(F.size("v").alias("d")).distinct().collect())  # one row for each length
    books, out = {}, []
    for d in lengths:
        mine = own.filter(F.size("v") == d)
        books[d] = fit_books(mine, d, parts, entries, rounds, scale)
        sha = hashlib.sha256(codebooks_text(books[d]).encode()).hexdigest()
        kind = dict(mine.dtypes)["label"]
        coded = mine.select("vec_id", "label", "v").mapInArrow(_codes(own.sparkSession.sparkContext.broadcast(books[d]), scale), f"vec_id long, label {kind}, code string, error long")
        out.append(coded.withColumn("codebooks_sha256", F.lit(sha)))
    if not out:
        empty = own.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
        return empty.filter(F.lit(False)), books
    return reduce(DataFrame.unionByName, out), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the errors of all rows with its label, nulls being one label."""
    coded = cut(coded)
    sums = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error")))
    sums = F.broadcast(sums) if sums.count() <= FEW_LABELS else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def query(vectors: DataFrame) -> DataFrame:
    """The columns of ``op12``: vec_id, code, error, label_error, codebooks_sha256."""
    return with_label_error(compress(vectors)[0]).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def oracle_sql(parts: int = 4, length: int = 64, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same in DuckDB's SQL for vectors of one length; dot products of doubles are exact below 2 ** 53."""
    step = length // parts
    near = "list_dot_product(c, c) - 2 * list_dot_product(x, c)"
    assign = lambda r: f"a{r} AS MATERIALIZED (SELECT vec_id, j, x, e, far + list_dot_product(x, x) AS far FROM (SELECT p.vec_id, p.j, x, e, {near} AS far, row_number() OVER (PARTITION BY p.vec_id, p.j ORDER BY {near}, e) AS k FROM p JOIN b{r} USING (j)) WHERE k = 1)"
    update = lambda r: f"""u{r} AS (SELECT j, e, list(s ORDER BY i) AS c FROM (SELECT j, e, i, floor(sum(x[i]) / count(*)) AS s FROM a{r - 1}, (SELECT unnest(range(1, {step + 1})) AS i) GROUP BY ALL) GROUP BY j, e),
b{r} AS MATERIALIZED (SELECT j, e, coalesce(u.c, b.c) AS c FROM b{r - 1} b LEFT JOIN u{r} u USING (j, e))"""  # noqa: E731
    body = "".join(f"{assign(r - 1)},\n{update(r)},\n" for r in range(1, rounds + 1))
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor({scale} * CAST(y AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
p AS MATERIALIZED (SELECT vec_id, j, w[j * {step} + 1 : j * {step} + {step}] AS x FROM v, (SELECT unnest(range({parts})) AS j)),
b0 AS MATERIALIZED (SELECT j, e, x AS c FROM (SELECT j, x, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e FROM p) WHERE e < {entries}),
{body}{assign(rounds)},
o AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY j) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
s AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY j, e, i)) AS codebooks_sha256 FROM b{rounds}, (SELECT unnest(range(1, {step + 1})) AS i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN v USING (vec_id) CROSS JOIN s"""
