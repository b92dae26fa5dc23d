"""Operators against brute force and the tokenizers library, on whole small tables."""

import hashlib
import re
import struct
from collections import Counter

import numpy as np
import regex
import xxhash
from pyspark.sql import functions as F

from timberline.llm import bpe, fingerprints, mixing, simhash, substring, vptree
from timberline.llm.toxicity import build_trie, in_quotation, intersect

SF = "/root/testdata/sf0.001"


def documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    return d, sorted((r["doc_id"], r["text"]) for r in d.collect())


def dedup(rows, window):
    seen, out = set(), {}
    for i, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in seen:
                gone[p : p + window] = [True] * window
            seen.add(k)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substring_dedup(spark):
    d, rows = documents(spark)
    for window, levels in ((20, 1), (20, 2), (8, 3)):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"].encode()) for r in substring.substring_dedup(d, window, levels).collect()}
        assert got == dedup(rows, window)


def test_substring_dedup_hot_passage(spark):
    passage = " ".join(f"p{i}" for i in range(45))
    rows = [(i, f"{i} x{i} {passage} y{i} {i * 7} und und und " + "la " * (i % 60)) for i in range(300)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"].encode()) for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == dedup(rows, 20)


def test_simhash_components(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = [(i, re.sub(rf"\bw{i}\b", "zz", base)) for i in range(100, 160)]
    d, rows = documents(spark)
    rows = rows + [(i + 10_000, t) for i, t in near]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fp = {}
    for i, text in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 3]), 42) for j in range(max(1, len(w) - 2))] if w else []
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    ids, group = sorted(fp), {i: i for i in fp}
    changed = True
    values = np.array([fp[i] for i in ids], np.uint64)
    links = [(ids[a], ids[b]) for a in range(len(ids)) for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 2) if b > a]
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            if (group[a], group[b]) != (low, low):
                group[a] = group[b] = low
                changed = True
    assert got == {i: (f"{fp[i]:016x}", group[i]) for i in ids}
    assert any(group[i] != i for i in ids if i >= 10_000)


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    odd = ["I'LL we've <|endoftext|> x<|startoftext|>Y", "ΑΣ ὈΔΥΣΣΕΎΣ İstanbul\x85\x1c á 12 3４ 👍🏽‍ ¾ ǅ ﬁ", "aaa aaaaa '''s", "<|endoftext|", "\x00 ﻿"]
    _, rows = documents(spark)
    rows = rows + [(10_000 + i, t) for i, t in enumerate(odd)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in bpe.query(frame).collect()}
    for i, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = bpe.bpe_round_trip(frame, bpe.default_vocabulary())
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(whole, bpe.default_vocabulary()).collect()}
    assert back == {r["doc_id"]: r["decoded"] for r in whole.collect()}


def paragraphs(text):
    """The paragraphs as the module's docstring has them, in plain Python."""
    out = set()
    for p in re.split(r"\n+|(?<=[.!?…؟۔।])[ \t]+|(?<=[。！？])", text):
        if len(p) > 200:
            words = regex.split(r"[ \t]+|(?<=[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])", p, flags=regex.V1)
            marked = " ".join(w + "\n" if xxhash.xxh64_intdigest(w.encode(), 42) % 8 == 0 else w for w in words)
            out |= set(re.split("\n ?", marked))
        else:
            out.add(p)
    return out - {""}


def test_fingerprints(spark):
    d, rows = documents(spark)
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = {r["doc_id"]: r for r in fingerprints.query(d).collect()}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert int(got[i]["fingerprint"][:8], 16) == len(paragraphs(text))
        assert abs(got[i]["near_edited"] - alike(paragraphs(text), paragraphs(edited))) < 1e-9
        assert abs(got[i]["near_next"] - alike(paragraphs(text), paragraphs(following))) < 1e-9


def test_fingerprint_differences_are_recovered(spark):
    line = lambda xs: "\n".join(f"paragraph {x}" for x in xs)
    cases = [(range(1, 90), range(30, 150)), (range(200), [*range(150), *range(300, 420)]), (range(5), range(5)), ([], range(3)), (range(400), range(1, 400))]
    df = spark.createDataFrame([(i, line(a), line(b)) for i, (a, b) in enumerate(cases)], "i int, a string, b string")
    df = df.withColumns({"x": fingerprints.digests(F.col("a")), "y": fingerprints.digests(F.col("b"))})
    df = df.withColumns({"f": fingerprints.fingerprint("x"), "g": fingerprints.fingerprint("y")})
    tries = []
    for r in df.select("i", "x", "y", fingerprints.difference("f", "g").alias("d"), fingerprints.likeness("f", "g").alias("near")).collect():
        a, b = set(r["x"]), set(r["y"])
        assert abs(r["near"] - (len(a & b) / len(a | b))) < 1e-12
        tries.append(r["d"]["tries"])
        if r["d"]["plus"] is not None:
            assert (set(r["d"]["plus"]), set(r["d"]["minus"])) == (a - b, b - a)
    assert max(tries) > 1


def test_mixing(spark):
    d, _ = documents(spark)
    got, again = mixing.query(d).collect(), mixing.query(d.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {r["doc_id"]: r["source"] for r in d.collect()}
    size, taken = Counter(), Counter()
    for r in got:
        size[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    full: set = set()
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s, w in weight.items() if s not in full and w * level > 2 * size[s]}
        if not more:
            break
        full |= more
    target = {s: 2 * size[s] if s in full else weight[s] * level for s in size}
    biggest = {s: max(r["size"] for r in got if source[r["doc_id"]] == s) for s in size}
    assert all(abs(r["target"] - target[source[r["doc_id"]]]) < 1e-6 for r in got)
    assert all(abs(taken[s] - target[s]) <= biggest[s] / 2 + 1 for s in size)


def test_vantage_point_trees():
    rng = np.random.default_rng(3)
    v = np.vstack([rng.normal(size=(900, 6)), np.repeat(rng.normal(size=(1, 6)), 300, axis=0)])
    ids = rng.permutation(len(v)).astype(np.int64)
    q = np.flatnonzero(ids % 20 == 0)
    recall = {}
    for factor in (1.0, 1.5):
        far, who, measured = vptree.search(v, ids, v[q], ids[q], 10, factor)
        hits = 0
        for k, row in enumerate(q):
            d = np.sqrt(((v - v[row]) ** 2).sum(axis=1))
            d[row] = np.inf
            best = np.lexsort((ids, d))[:10]
            hits += len(set(ids[best]) & set(who[k]))
            if factor == 1:
                assert who[k].tolist() == ids[best].tolist() and np.allclose(far[k], d[best])
        recall[factor] = (hits / 10 / len(q), measured)
    assert recall[1.0][0] == 1 and recall[1.5][0] >= 0.9 and recall[1.5][1] < recall[1.0][1] < len(q) * len(v)


def test_clustered_vectors_visit_few_regions(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 20
    v = np.concatenate([centres[i % 40] + rng.normal(size=(1, 8)) for i in range(4000)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = np.arange(0, 4000, 100)
    for factor, least in ((1.0, 1.0), (1.5, 0.9)):
        got = Counter()
        for r in vptree.nearest(df, F.col("vec_id") % 100 == 0, factor=factor, shard=100).collect():
            d = ((v - v[r["query_id"]]) ** 2).sum(axis=1)
            d[r["query_id"]] = np.inf
            got[factor] += r["vec_id"] in np.argsort(d, kind="stable")[:10]
        assert got[factor] >= least * 10 * len(q)
    top = vptree.Regions(v[::2], np.arange(0, 4000, 2), 4000, 100)
    which, _ = top.visits(v[q], top.kth(v[q], q, 10), 1.0)
    assert len(top.shards) >= 30 and len(which) <= len(q) * len(top.shards) / 4


def test_one_vector_for_each_id(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0, 1.0])]
    got = vptree.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [tuple(r) for r in got] == [(100, 1, 1, 1.0)]


def test_levenshtein_automaton():
    trie = build_trie({"idiot": 1.0, "moron": 2.0})
    found = lambda w, e: {(t, d) for t, _, d in intersect(trie, w, e)}
    assert found("idiot", 1) == {("idiot", 0)} and found("idjot", 1) == {("idiot", 1)} == found("idot", 1) == found("idiott", 1)
    assert found("moorn", 1) == set() and found("moorn", 2) == {("moron", 2)}
    assert in_quotation('they said "you idiot" and left'.split(), 3) and not in_quotation("you idiot and left".split(), 1)
