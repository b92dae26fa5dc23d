"""How the links of near copies are found."""

import numpy as np
from timberline.llm import nearcopies, simhash


def test_ball_links_shuffle_each_variant_once(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 30).tolist()
    fps = sorted({*base, *(b ^ 1 for b in base[:9]), *(b ^ 1 << 7 ^ 1 << 40 for b in base[5:12])})
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2)
    assert "Join" not in links._jdf.queryExecution().executedPlan().toString()
    got = {tuple(r) for r in links.collect()}
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got <= want
    root = {f: f for f in fps}
    for a, b in got:
        old, new = root[b], root[a]
        root = {f: new if r == old else r for f, r in root.items()}
    assert all(root[a] == root[b] for a, b in want)


def test_near_copies_meet_in_the_balls_of_their_fingerprints(spark, monkeypatch):
    """Without a common band, texts whose fingerprints differ by two bits at most are still compared, and linked by their Jaccard similarity."""
    monkeypatch.setattr(nearcopies, "_bands", lambda sets, seed: np.array([[s.sum()] for s in sets], np.uint64))
    words = [f"w{i * i % 1009}x{i}" for i in range(900)]
    edited = next(e for k in range(899, 0, -1) if 0 < ((f := simhash._fingerprint(" ".join(e := [*words[:k], "other", *words[k + 1 :]]).encode(), 3, 42, simhash._LOWER)) ^ simhash._fingerprint(" ".join(words).encode(), 3, 42, simhash._LOWER)).bit_count() <= 2)
    docs = spark.createDataFrame([(3, " ".join(words)), (5, " ".join(edited)), (7, " ".join(words[::-1])), (9, None)], "key long, text string")
    got = {r["key"]: r["component"] for r in nearcopies.near_copies(docs).collect()}
    assert got == {3: 3, 5: 3, 7: 7, 9: 9}
