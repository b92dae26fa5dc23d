"""Byte windows against plain Python, and the sort against sorted()."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timberline.llm import suffixes


def brute(rows, length=50):
    """rows: (doc_id or None, text); documents without id are alone and last."""
    own = [((i is None, i or k), (t or "").encode()) for k, (i, t) in enumerate(rows)]
    first = {}
    for key, b in own:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, key), key)
    out = []
    for (i, _), (key, b) in zip(rows, own, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def found(spark, rows, length=50, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("doc", "ord", "block", "bucket", "keys", "kept", "marks", "_tl_spread", "rank")})
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.suffix_dedup(df.repartition(5), length, **more).collect()), key=repr)


def documents(n=120):
    rng = np.random.default_rng(11)
    syllables = ["th", "er", "in", "on", "ü", "日本", " ", " ", ". ", "an"]
    text = lambda k: "".join(rng.choice(syllables, k))
    shared = [text(60) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [text(int(rng.integers(0, 80)))]
        for _ in range(int(rng.integers(0, 4))):
            parts += [shared[int(rng.integers(0, 4))], text(int(rng.integers(0, 40)))]
        rows.append((i, "".join(parts)))
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = documents() + [(500, None), (501, ""), (502, "short"), (503, "la " * 5000), (504, "la " * 4000), (505, "x" * 49), (506, "x" * 50), (507, "x" * 51)]
    assert found(spark, rows) == sorted(brute(rows), key=repr)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(suffixes, "LEAST_BYTES", 700)
    monkeypatch.setattr(suffixes, "_WINDOWS", 500)
    monkeypatch.setattr(suffixes, "_PIECE", 90)
    assert found(spark, rows) == sorted(brute(rows), key=repr)
    assert found(spark, rows[:60], 24) == sorted(brute(rows[:60], 24), key=repr)


def test_repeated_and_missing_ids(spark):
    passage = "".join(f"p{i} " for i in range(30))
    rows = [(1, "one " + passage), (1, "two " + passage), (1, "two " + passage), (None, passage), (None, passage + "end"), ((1 << 62) + 5, passage)]
    got = {(r[0], r[4]): r[2] for r in found(spark, rows)}
    size = len(passage)
    assert got[(1, ("one " + passage).encode())] == got[(1, ("two " + passage).encode())] == 0
    assert got[((1 << 62) + 5, b"")] == size and got[(None, b"")] == size and got[(None, b"end")] in (size, size)


def test_hot_passage_is_sent_once_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 100)
    passage = "".join(f"p{i} " for i in range(60))
    rows = [(i, f"{i} a{i} {passage} b{i}") for i in range(300)]
    table = pa.table({"block": [0] * 300, "doc": list(range(300)), "ord": list(range(300)), "doc_id": list(range(300)), "text": [t for _, t in rows]})
    sent = suffixes.send_grams(50, 16)(table)
    spans = suffixes.send_spans(50, 16)(table, suffixes.meet_grams(sent))
    sizes = [int((np.frombuffer(x, np.uint16).astype(int) + 49).sum()) for x in spans.column("n").to_pylist()]
    # what straddles the ends of the passage is spread over the buckets
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 9000)
    assert found(spark, rows) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("alphabet", [2, 3, 26])
def test_windows_are_sorted(alphabet):
    rng = np.random.default_rng(alphabet)
    piece = rng.integers(97, 97 + alphabet, 40).astype(np.uint8)
    data = np.concatenate([piece if k % 3 else rng.integers(97, 97 + alphabet, 40).astype(np.uint8) for k in range(60)] + [np.zeros(8, np.uint8)])
    length = 50
    start = rng.integers(0, len(data) - 8 - length, 1500)
    group = rng.integers(0, 3, 1500)
    order, lead = suffixes.sort_windows(suffixes.Windows(data, start, length), group)
    strings = [(int(group[i]), data[start[i] : start[i] + length].tobytes()) for i in order]
    assert strings == sorted(strings)
    assert lead.tolist() == [k == 0 or strings[k] != strings[k - 1] for k in range(len(strings))]


def test_blind_tries_alone(monkeypatch):
    monkeypatch.setattr(suffixes, "SHALLOW", 0)
    monkeypatch.setattr(suffixes, "TRIE", 1 << 20)
    test_windows_are_sorted(2)


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.query(df).count() == 0
    with pytest.raises(ValueError):
        suffixes.suffix_dedup(df, 16)
    one = suffixes.query(spark.createDataFrame([(1, None)], df.schema)).collect()
    assert [tuple(r) for r in one] == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest())]
