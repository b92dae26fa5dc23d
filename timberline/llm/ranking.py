"""Ranked lexical search by inverted treaps, one for each term of a shard of documents.

A first pass over whole texts leaves for each document its length and how often it holds the terms that are asked for, in
a checkpoint; the counts of documents, of terms and of documents for each term come from that. Then each shard (a batch of the
checkpoint's rows) builds a treap for each term: in the order of documents a search tree, in the order of impacts (what a posting
adds for a weight of one) a heap, so a root's impact is the largest of its subtree. A query goes through the treaps of its terms at the same time.
A state is a range of documents and for each term the root of the treap's part in that range; the sum of the roots' weighted impacts is
the most that any document of the range can score. A state that cannot enter the query's best k any more is dropped. Otherwise the
document of its heaviest root is scored by searching for it in all of the treaps, and these searches split them at that document into
two states. All arithmetic is done on arrays of states. A task carries its best k from shard to shard; the tasks' lists are merged
in two steps, so no group holds more than a few hundred rows for each query.

Defined results: null and blank texts hold no terms and are no documents of the counts. Documents without id come behind all others in
ties; repeated rows are documents of their own, also in the result. A repeated item is ranked once for each row. An item without known
terms has no rows. Extra columns are ignored. Without documents or items the result is empty.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut

#: What the terms of a block of queries are together at most (a single query may be longer), so their broadcast is bounded.
BLOCK_TERMS = 200_000
#: States of the traversal that are handled at once, times terms of a query.
_CELLS = 1 << 18
#: Texts are split into words in pieces of about so many bytes.
_PIECE = 1 << 22
#: Fixed values of the contract: letters and digits of ASCII and all bytes of other characters are parts of terms; A-Z are lower-cased.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_LAST = np.iinfo(np.int64).max


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists."""
    text = text.translate(_TERM_BYTES)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + _PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n, terms, tfs of each row of ``docs`` with any term: its length and its terms of ``vocabulary`` (a broadcast dict of numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for b in batches:
            ids, n, who, often, ends = [], [], [], [], [0]
            for i, text in enumerate(as_bytes(b.column(1))):
                count, found = 0, Counter()
                for words in terms(text.as_py()):
                    count += len(words)
                    found.update(filter(known.__contains__, words))
                if count:
                    ids.append(i)
                    n.append(count)
                    who += [known[w] for w in found]
                    often += found.values()
                    ends.append(len(who))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((who, pa.int32()), (often, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(own.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>"))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a posting adds for a weight of one: 10**9 tf / (1000 tf + 8 m), m being 10 and 90 times the length over the mean one."""
    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:
        m = np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
    else:
        m = 10 + 90 * n * n_docs // max(1, n_terms)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Treaps:
    """The treaps of all terms of a shard, as arrays over its postings in the order of (term, document)."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.lexsort((doc, term))
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        self.first = np.searchsorted(term, np.arange(n_terms + 1))
        # equal impacts are ordered by a hash of the document, so that no tree becomes a chain of them
        luck = (self.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        self.left, self.right, self.root = _cartesian(self.impact, luck.astype(np.int64), term, self.first)


def _cartesian(impact: np.ndarray, luck: np.ndarray, term: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Children and roots (-1: none) of the heap-ordered tree over each term's postings.

    A stack holds the right edge of the tree over the postings so far, so one pass builds all trees.
    """
    n = len(impact)
    left, right, root = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(len(first) - 1, -1, np.int64)
    if not n:
        return left, right, root
    rank = np.empty(n, np.int64)
    rank[np.lexsort((luck, impact))] = np.arange(n)
    stack: list[int] = []
    ranks, terms_ = rank.tolist(), term.tolist()
    lefts, rights = left.tolist(), right.tolist()
    now = -1
    for i in range(n):
        if terms_[i] != now:
            if stack:
                root[now] = stack[0]
            stack, now = [], terms_[i]
        below, r = -1, ranks[i]
        while stack and ranks[stack[-1]] < r:
            below = stack.pop()
        lefts[i] = below
        if stack:
            rights[stack[-1]] = i
        stack.append(i)
    root[now] = stack[0]
    return np.array(lefts, np.int64), np.array(rights, np.int64), root


class Best:
    """The k best of each query so far: score, place among the ids, nulls last."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.score, self.id, self.there = np.zeros((n_queries, k), np.int64), np.full((n_queries, k), _LAST), np.zeros((n_queries, k), bool)
        self.null = np.zeros((n_queries, k), bool)

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        keep = score > 0
        keep &= (score > self.score[query, -1]) | ~self.there[query, -1] | ((score == self.score[query, -1]) & ((ids < self.id[query, -1]) | self.null[query, -1]))
        query, score, ids, null = query[keep], score[keep], ids[keep], null[keep]
        if not len(query):
            return
        touched, place = np.unique(query, return_inverse=True)
        own = np.repeat(np.arange(len(touched)), self.k)
        q = np.concatenate([own, place])
        cells = [np.concatenate([a[touched].ravel(), b]) for a, b in ((self.score, score), (self.id, ids), (self.null, null), (self.there, np.ones(len(query), bool)))]
        order = np.lexsort((cells[1], cells[2], -cells[0], ~cells[3], q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = order[rank < self.k]
        for a, c in zip((self.score, self.id, self.null, self.there), cells, strict=True):
            a[touched] = c[top].reshape(len(touched), self.k)


def by_size(asked: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, terms) of queries of like size, as matrices that are filled up with -1 to twice the terms at most."""
    out = []
    size = np.array([max(1, len(q) - 1).bit_length() for q in asked])
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        m = np.full((len(at), max(1, *(len(asked[i]) for i in at))), -1, np.int64)
        for row, i in zip(m, at, strict=True):
            row[: len(asked[i])] = asked[i]
        out.append((at, m))
    return out


def search(treaps: Treaps, ids: np.ndarray, null: np.ndarray, places: np.ndarray, queries: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Brings the documents of a shard into ``best``; returns how many were scored.

    ``ids`` are the shard's documents in order (``null`` where they have none), ``queries`` the terms of the queries at ``places`` (-1: none),
    ``weights`` those of the terms.
    """
    doc, left, right, root = (np.append(x, -1).astype(np.int32) for x in (treaps.doc, treaps.left, treaps.right, treaps.root))
    impact, roots = np.append(treaps.impact, 0), root[queries]
    w = np.append(weights, 0)[queries]
    scored = 0
    stack = [(np.arange(len(queries)), np.zeros(len(queries), np.int32), np.full(len(queries), len(ids), np.int32), roots)]
    most = max(1, _CELLS // max(1, queries.shape[1]))
    while stack:
        query, lo, hi, node = stack.pop()
        bounds = (w[query] * impact[node]).sum(axis=1)
        least = best.score[places[query], -1]
        later = (ids[np.minimum(lo, len(ids) - 1)] > best.id[places[query], -1]) & ~best.null[places[query], -1]
        live = np.flatnonzero((bounds > least) | ((bounds == least) & (bounds > 0) & ~later))
        if not len(live):
            continue
        if len(live) > most:  # the most promising part first
            live = live[np.argsort(-bounds[live], kind="stable")]
            rest = live[most:]
            stack.append((query[rest], lo[rest], hi[rest], node[rest]))
            live = live[:most]
        query, lo, hi, node = query[live], lo[live], hi[live], node[live]
        heavy = (w[query] * impact[node]).argmax(axis=1)
        d = doc[node[np.arange(len(node)), heavy]]
        # each treap is searched for d; what is met on the way down first on either side is the root of that side's part
        score = np.zeros(len(node), np.int64)
        lefts, rights = np.full(node.size, -1, np.int32), np.full(node.size, -1, np.int32)
        cell = np.flatnonzero(node.ravel() >= 0)
        s = cell // node.shape[1]
        at, goal, low, high = node.ravel()[cell], d[s], lo[s], hi[s]
        heavy_of = w[query].ravel()
        while len(cell):
            x = doc[at]
            less, more = x < goal, x > goal
            here = np.flatnonzero(~(less | more))
            if len(here):
                at_d, cell_d = at[here], cell[here]
                score += np.bincount(cell_d // node.shape[1], weights=heavy_of[cell_d] * impact[at_d], minlength=len(score)).astype(np.int64)
                # below d both sides may still lack their root
                _side(left[at_d], cell_d, lefts, doc, left, right, low[here], goal[here])
                _side(right[at_d], cell_d, rights, doc, left, right, goal[here] + 1, high[here])
            under = np.flatnonzero(less & (x >= low))
            under = under[lefts[cell[under]] < 0]
            lefts[cell[under]] = at[under]
            over = np.flatnonzero(more & (x < high))
            over = over[rights[cell[over]] < 0]
            rights[cell[over]] = at[over]
            at = np.where(less, right[at], left[at])
            on = np.flatnonzero((less | more) & (at >= 0))
            cell, at, goal, low, high = cell[on], at[on], goal[on], low[on], high[on]
        lefts, rights = lefts.reshape(node.shape), rights.reshape(node.shape)
        scored += len(d)
        best.offer(places[query], score, ids[d], null[d])
        # both sides of all states go on together, so arrays stay long
        nodes = np.concatenate([lefts, rights])
        some = np.flatnonzero((nodes >= 0).any(axis=1))
        stack.append((np.concatenate([query, query])[some], np.concatenate([lo, d + 1])[some], np.concatenate([d, hi])[some], nodes[some]))
    return scored


def _side(at: np.ndarray, cell: np.ndarray, roots: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
    """Where ``roots`` has none yet, the first node from ``at`` on whose document lies in [lo, hi)."""
    on = np.flatnonzero((roots[cell] < 0) & (at >= 0))
    while len(on):
        cell, at, lo, hi = cell[on], at[on], lo[on], hi[on]
        x = doc[at]
        before = x < lo
        outside = before | (x >= hi)
        inside = np.flatnonzero(~outside)
        roots[cell[inside]] = at[inside]
        at = np.where(before, right[at], left[at])
        on = np.flatnonzero(outside & (at >= 0))


def _shards(shared, k: int):
    """A task's best k of each query: item, doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, queries, weights, n_docs, n_terms = shared.value
        best = Best(len(items), k)
        for b in batches:
            raw = b.column("doc_id")
            null = raw.is_null().to_numpy(zero_copy_only=False)
            ids = raw.fill_null(_LAST).to_numpy()
            order = np.lexsort((ids, null))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            sizes = np.diff(b.column("terms").offsets.to_numpy())
            doc = np.repeat(place, sizes)
            n = np.repeat(b.column("n").to_numpy(), sizes)
            term, tf = b.column("terms").flatten().to_numpy().astype(np.int64), b.column("tfs").flatten().to_numpy()
            treaps = Treaps(term, doc, impacts(tf, n, n_docs, n_terms), len(weights))
            for places, own in queries:
                search(treaps, ids[order], null[order], places, own, weights, best)
        q, i = np.nonzero(best.there)
        ids = pa.array(best.id[q, i], mask=best.null[q, i])
        yield pa.RecordBatch.from_arrays([pa.array(items[q]), ids, pa.array(best.score[q, i])], names=["item", "doc_id", "score"])

    return run


def _first(rows: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """The first k of each group, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _ranked(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """item, doc_id, score, rank of a bounded block of ``items`` (item, terms)."""
    spark = docs.sparkSession
    rows = items.collect()  # BLOCK_TERMS terms at most, or one query
    names = sorted({t for r in rows for t in r["terms"]})
    number = {t: i for i, t in enumerate(names)}
    index = postings(docs, spark.sparkContext.broadcast({t.encode(): i for t, i in number.items()}))
    total = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    df = {r["t"]: r["df"] for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # one row for each term
    weights = np.array([weight(total["docs"], df[i]) if i in df else 0 for i in range(len(names))], np.int64)
    asked = [[number[t] for t in r["terms"] if number[t] in df] for r in rows]
    shared = spark.sparkContext.broadcast((np.array([r["item"] for r in rows], np.int64), by_size(asked), weights, total["docs"], total["terms"] or 0))
    found = index.mapInArrow(_shards(shared, k), "item long, doc_id long, score long")
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    return _first(_first(salted, ["item", "_salt"], k).drop("rank"), ["item"], k).drop("_salt")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of ``docs`` (doc_id, text) that score highest for each row of ``items`` (item_id, text)."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted({w for words in terms(t.as_py()) for w in words}) for t in as_bytes(b.column(1))]
            own = [[w.decode("utf-8", "replace") for w in ws] for ws in own]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.string()))], names=["item_id", "terms"])

    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = cut(own.mapInArrow(parsed, "item_id long, terms array<string>").withColumn("item", F.monotonically_increasing_id()))
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("terms")).first()
    if not size["n"]:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).filter(F.lit(False))
    blocks = -(-max(1, size["terms"]) // BLOCK_TERMS)
    parts = [asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i) for i in range(blocks)] if blocks > 1 else [asked]
    found = reduce(DataFrame.unionByName, [_ranked(docs, p.select("item", "terms"), k) for p in parts if not p.isEmpty()])
    return found.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of ``op11``: item_id, rank, doc_id, score."""
    return ranked(docs, items)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def oracle_sql(k: int = 10) -> str:
    """The same in DuckDB's SQL."""
    words = lambda c: rf"regexp_extract_all(translate({c}, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words("text")} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS big, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * big + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p CROSS JOIN s GROUP BY t, big),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({words("text")}) AS t FROM benchmark)),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big) // total)))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN p USING (t) CROSS JOIN s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= {k}"""
