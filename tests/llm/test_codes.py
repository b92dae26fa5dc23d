"""Vector codes against plain Python, with messy vectors."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from timberline.llm import codes


def brute(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label) of one length, with usable vectors and unlike ids."""
    rows = sorted(rows)
    step = len(rows[0][1]) // parts
    x = [[[int(np.floor(1024 * float(c))) for c in v[j * step : (j + 1) * step]] for j in range(parts)] for _, v, _ in rows]
    books = [[list(r[j]) for r in x[:entries]] for j in range(parts)]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda p, j: min((dist(p, c), e) for e, c in enumerate(books[j]))
    for _ in range(rounds):
        for j in range(parts):
            groups = {}
            for r in x:
                groups.setdefault(near(r[j], j)[1], []).append(r[j])
            for e, own in groups.items():
                books[j][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[near(r[j], j) for j in range(parts)] for r in x]
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, label), e in zip(rows, error, strict=True):
        by[label] = by.get(label, 0) + e
    return {i: ("".join(f"{e:02x}" for _, e in f), e_, by[label], sha) for (i, _, label), f, e_ in zip(rows, found, error, strict=True)}


def test_codes_equal_plain_python(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=8).round(1)], None if i % 5 == 0 else i % 3) for i in range(400)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    bad = spark.createDataFrame([(-1, None, 1), (-2, [None] * 8, 1), (-3, [float("nan")] * 8, 1), (-4, [float("inf")] + [0.0] * 7, None)], "vec_id long, embedding array<float>, label int")
    got = codes.query(df.unionByName(bad).withColumns({c: F.lit("clash") for c in ("v", "code", "error", "_label", "part", "entry", "n")}))
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect()} == brute(rows)


def test_few_long_short_repeated_and_no_vectors(spark):
    rows = [(1, [0.5] * 6, 1), (1, [0.5] * 6, 1), (None, [1.5] * 6, None), (2, [0.25] * 3, None), (3, [], 2), (4, [3e38] * 6, 1), (5, [0.0] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = codes.query(df).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "2", "3", "4", "5", "None"]
    # each different vector has an entry of its own, the first of equal ones
    assert all(r["error"] == 0 for r in got) and len({r["code"] for r in got if r["vec_id"] == 1}) == 1
    assert next(r for r in got if r["vec_id"] == 3)["codebooks_sha256"] == hashlib.sha256(b"").hexdigest()
    assert codes.query(df.limit(0)).count() == 0


def test_whole_numbers_floor_and_hold():
    assert codes.whole_numbers(np.array([[-0.0001, 0.0009, 0.001, -1.0]]), 1024).tolist() == [[-1, 0, 1, -1024]]
    far = codes.whole_numbers(np.array([[1e30, -1e30] + [0.0] * 62]), 1024)
    assert far[0, 0] == -far[0, 1] == 1 << 27 and codes.nearest(far, far[:, ::-1])[1][0] > 0
