"""Ranked search against plain Python, and that treaps prune."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from timberline.llm import ranking

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    """(item, doc_id, score) of each item's best, best first; docs: (doc_id or None, text)."""
    own = [(i, Counter(words(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        asked = [(t, math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))) for t in set(words(text)) if t in df]
        found = []
        for i, c in own:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in asked if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0], r[1]))


def test_ranks_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "naïve", "日本", "x1"]
    docs = [(int(i * 7 % 601), " ".join(rng.choice(vocab, rng.integers(1, 30)))) for i in range(500)]
    docs += [(None, "w1 w2 W3"), (None, "w1 w2 W3"), (5000, None), (5001, ""), (5002, "-- !!"), (5003, "w1,w2;W1 " * 40_000)]
    docs += [(6000 + i, "w1 w2 w3 copy") for i in range(300)]
    items = [(1, "W1 w2, w2 été"), (2, "nothing known"), (3, None), (4, " ".join(vocab)), (5, "copy"), (6, "日本 naïve"), (7, "w1 w2 w3")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "terms", "tfs", "item", "rank", "score", "item_id")}).repartition(6)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit("clash"))
    assert ordered(tuple(r) for r in ranking.query(d, q).collect()) == ordered(brute(docs, items))


def test_nothing_to_rank(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "item_id long, text string")
    assert ranking.query(d.limit(0), q).count() == ranking.query(d, q.limit(0)).count() == 0
    # the only document holds every term, so a weight is floor(1000 ln(4 / 3))
    assert sorted(str(tuple(r)) for r in ranking.query(d, q).collect()) == [str((i, 1, 1, 287 * (10**9 // 1800))) for i in (1, 1, None)]


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 3)
    docs = [(i, f"t{i % 5} t{i % 7} u") for i in range(60)]
    items = [(i, f"t{i} t{i + 1} u") for i in range(6)]
    got = ranking.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3)
    assert ordered(tuple(r) for r in got.collect()) == ordered(brute(docs, items, 3))


def test_treaps_are_search_trees_and_heaps_and_prune():
    rng = np.random.default_rng(4)
    n, m = 3000, 6
    term, doc = np.nonzero(rng.random((m, n)) < 0.5)
    impact = (1e6 * rng.pareto(1.2, len(doc))).astype(np.int64) // 1000
    t = ranking.Treaps(term, doc, impact, m)
    for i in range(len(t.doc)):
        for child, test in ((t.left[i], t.doc[t.left[i]] < t.doc[i]), (t.right[i], t.doc[t.right[i]] > t.doc[i])):
            assert child < 0 or (test and t.impact[child] <= t.impact[i])
    w, ids = np.arange(1, m + 1), np.arange(n)
    best = ranking.Best(2, 10)
    queries = np.array([[0, 1, 2], [5, 3, -1]])
    scored = ranking.search(t, ids, np.zeros(n, bool), np.array([0, 1]), queries, w, best)
    dense = np.zeros((m, n), np.int64)
    dense[t.doc * 0 + np.repeat(np.arange(m), np.diff(t.first)), t.doc] = t.impact
    for row, q in enumerate(((0, 1, 2), (5, 3))):
        score = (w[list(q), None] * dense[list(q)]).sum(axis=0)
        top = np.lexsort((ids, -score))[:10]
        assert best.id[row].tolist() == top.tolist() and best.score[row].tolist() == score[top].tolist()
    assert scored < n
