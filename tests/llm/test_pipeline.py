"""The stages of the pipeline against brute force."""

import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from timberline.llm import mixing, quality, simhash, substring


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups(rows):
    """The smallest key that near copies reach, of each (key, text)."""
    sets, root = {k: shingles(t) for k, t in rows}, {k: k for k, _ in rows}
    for a, b in combinations(sorted(root), 2):
        both = len(sets[a] & sets[b])
        if root[a] != root[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((root[a], root[b]))
            root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_near_copies_stage_reaches_edited_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = groups(rows)
    assert {r["doc_id"] for r in simhash.stage(docs).collect()} == {k for k, r in want.items() if k == r}


def test_near_copies_stage_follows_chains(spark):
    # each text is near the next only, so the links of a band's ends don't join them
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 200])) for i in range(20)] + [(100 + i, " ".join(f"x{i}y{j}" for j in range(60))) for i in range(5)]
    want = groups(rows)
    got = {r["doc_id"] for r in simhash.stage(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k for k, r in want.items() if k == r}


def loose(spark, sf="sf0.001"):
    """Rows of which many that have no label lack a doc_id or share one; copies of a text among both."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    odd = F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, F.floor(F.col("doc_id") / 10)).otherwise(F.col("doc_id"))
    labelled = [r["doc_id"] for r in spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").collect()]
    odd = F.when(F.col("doc_id").isin(labelled), F.col("doc_id")).otherwise(odd)
    own = docs.withColumn("was", F.col("doc_id")).withColumn("doc_id", odd.cast("long"))
    return docs, own


def test_quality_stage_judges_each_row(spark):
    docs, own = loose(spark, "sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    want = own.select("doc_id", F.col("was").alias("_tl_row"), "text")
    good = {r["_tl_row"] for r in quality.quality_scores(want, labels, more=("_tl_row",)).collect() if r["predicted"]}
    got = [r["was"] for r in quality.stage(own, labels).collect()]
    assert sorted(got) == sorted(good) and 0 < len(got) < docs.count()


def test_near_copies_stage_judges_each_row(spark):
    _, own = loose(spark)
    rows = {r["was"]: r for r in own.collect()}
    root = groups([(k, r["text"]) for k, r in rows.items()])
    got = simhash.stage(own).collect()
    assert sorted(root[r["was"]] for r in got) == sorted(set(root.values()))
    for r in got:
        ids = [x["doc_id"] for k, x in rows.items() if root[k] == root[r["was"]] and x["doc_id"] is not None]
        assert r["doc_id"] == min(ids, default=None)


def test_substring_and_mix_stages_judge_each_row(spark):
    words = " ".join(f"p{i}" for i in range(30))
    rows = [(None if i % 3 == 0 else i // 6, f"own{i} {words} end{i}", f"s{i}") for i in range(24)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = substring.stage(d).collect()
    assert sorted(r["source"] for r in got) == sorted(r[2] for r in rows)
    assert all(r["text"].split()[0] == f"own{r['source'][1:]}" and r["n_chars"] == len(r["text"]) for r in got)
    assert sorted(len(r["text"].split()) for r in got) == [2] * 23 + [32]
    mixed = mixing.stage(d).collect()
    taken = {(r["doc_id"], r["text"]) for r in mixed}
    assert taken <= {r[:2] for r in rows} and max(Counter(r["source"] for r in mixed).values()) <= 2
