"""Held-out accuracy of the trained operators, the pipeline, and the SQL of those that have one."""

import random

import duckdb
import pytest

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from timberline.llm import mixing, quality, queries, toxicity, urls

SF = "/root/testdata/sf0.01"


def tables(spark, *names):
    return [spark.read.parquet(f"{SF}/{n}.parquet") for n in names]


def test_quality_held_out(spark):
    d, labels = tables(spark, "documents", "labels")
    got = quality.query(d, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.97 * len(got)


def test_toxicity_held_out(spark):
    d, labels = tables(spark, "documents", "labels")
    got = toxicity.query(d, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.9 * len(got)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    got = queries.queries()[name](spark, SF)
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = want.fetchall()
    text = lambda r: tuple(f"{x:.9f}" if isinstance(x, float) else str(x) for x in r)
    assert sorted(map(text, got.select(*names).collect())) == sorted(map(text, rows))


def test_misspelled_and_quoted_terms(spark):
    d, labels = tables(spark, "documents", "labels")
    model = toxicity.learn(d, labels)
    again = toxicity.learn(d.repartition(40), labels.repartition(3))
    assert (again.terms, again.harmless, again.crowded) == (model.terms, model.harmless, model.crowded) and (again.weights == model.weights).all()
    wrong_by = lambda t: (model.match(toxicity.misspelled(t)) or (0, 0, ""))[1]
    words = sorted(t for t in model.terms if not t.endswith("*") and t not in model.crowded and wrong_by(t))[:2]
    wrong, quoted = " ".join(map(toxicity.misspelled, words)), " ".join(f'"{w}"' for w in words)
    texts = [(1, f"this is {wrong} again"), (2, f"they said {quoted} to us"), (3, "this is it again"), (4, f"this is {' '.join(words)} again"), (5, "")]
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert [got[i]["predicted"] for i in range(1, 6)] == [1, 0, 0, 1, 0]
    assert got[1]["misspelled"] > 0 and got[1]["exact"] == 0 and got[2]["quoted"] > 0


def test_long_words_may_have_two_errors():
    model = toxicity.ToxicityModel({"worthless": 5.0, "scum": 5.0})
    assert model.match("worhtless")[1] == 2 and model.match("wrothles") is None and model.match("scun") is None


def test_sieve_of_words(monkeypatch):
    """The sieve leaves every word that the automaton alone would match, and few of those that it wouldn't."""
    rng = random.Random(3)
    word = lambda signs, a, b: "".join(rng.choices(signs, k=rng.randint(a, b)))

    def changed(w, errors):
        for _ in range(errors):
            i, c = rng.randint(0, len(w)), rng.choice("abcdeé")
            w = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
        return w

    terms = {word("abcde", 3, 15): 4.0 for _ in range(400)} | {"abcd*": 3.0, "edcba*": 5.0}
    crowded = frozenset(sorted(terms)[::7])
    words = sorted({rng.choice(["", "¿", '"', "((", "x", "ß"]) + changed(t.strip("*"), k).upper() + rng.choice(["", "!", "...", "0"]) for t in terms for k in (0, 1, 1, 2, 2, 3)} | {"abcd" * 300, "..."})
    model = toxicity.ToxicityModel(terms, frozenset(map(toxicity.fold, words[::9])), crowded)
    plain = toxicity.ToxicityModel(terms, model.harmless, crowded)
    left = {words[k] for k in model.may_hit(words)}
    hits = {w for w in words if plain.match(w)}
    assert hits <= left and {w for w in words if plain.near(toxicity.fold(w))} <= left and len(hits) > 400

    blanks = [c for c in map(chr, range(0x3001)) if c.isspace()] + [" "] * 20
    texts = [None, "", " \u2003 ", *("".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.randint(1, 40))) for _ in range(300)), '"' + " ".join(sorted(hits)[:5]) + '"']
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 2000)
    got = model.features(pa.array(["not this", *texts]).slice(1))
    for x, text in zip(got, texts, strict=True):
        own = (text or "").split()
        assert x.tolist() == plain.word_features(own, [i for i, w in enumerate(own) if plain.match(w)])

    # unrelated words need no walk; without the sieve about 1,500 of 10,000 such words had one
    walks, walk = [], toxicity.intersect
    monkeypatch.setattr(toxicity, "intersect", lambda *a: walks.append(a) or walk(*a))
    letters = "abcdefghijklmnopqrstuvwxyz"
    model = toxicity.ToxicityModel({word(letters, 5, 14): 4.0 for _ in range(200)})
    model.features(pa.array([" ".join(word(letters, 5, 14) for _ in range(500)) for _ in range(20)]))
    assert len(walks) < 100


def test_discriminant_against_numpy(spark):
    rng = np.random.default_rng(4)
    n = len(quality.STATISTICS)
    x = {0: rng.normal(size=(60, n)), 1: rng.normal(size=(9, n)) * 2 + 1}
    rows = [(v.tolist(), y) for y, m in x.items() for v in m]
    model = quality.fit_discriminant(spark.createDataFrame(rows, "x array<double>, y int"), 0.2, 1e-4)
    cov = {y: np.cov(m.T, bias=True) for y, m in x.items()}
    pooled = np.diag((60 * np.diag(cov[0]) + 9 * np.diag(cov[1])) / 69 + 1e-4)
    for v in rng.normal(size=(5, n)):
        log = {}
        for y, m in x.items():
            s = 0.8 * cov[y] + 0.2 * pooled
            gap = v - m.mean(axis=0)
            log[y] = np.log(len(m) / 69) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * gap @ np.linalg.solve(s, gap)
        assert abs(model.score(v[None])[0] - 1 / (1 + np.exp(log[0] - log[1]))) < 1e-9


def test_url_trees_held_out(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, path = urls.host_and_path(F.col("url"))
    ruled = pages.select("url", host.alias("host"), path.alias("path")).distinct().withColumn("rule", urls.rule_text(F.col("host"), F.col("path"))).filter("rule is not null")
    ruled = ruled.withColumn("y", F.col("rule").isin("example.com/en/", "net/es/", "net/fr/").cast("int"))
    train, test = ruled.filter(F.crc32("url") % 5 != 0), ruled.filter(F.crc32("url") % 5 == 0)
    suffixes = urls.suffix_statistics(train)
    score = urls.train(urls.lexical(train, suffixes))
    got = [(r["y"], r["s"]) for r in urls.lexical(test, suffixes).select("y", F.expr(score).alias("s")).collect()]
    block, allow = [s for y, s in got if y], [s for y, s in got if not y]
    assert sum((b > a) + 0.5 * (b == a) for b in block for a in allow) / len(block) / len(allow) > 0.6
    assert sum(a < 0 for a in allow) / len(allow) > 0.5
    verdicts = {r["verdict"] for r in urls.query(pages).filter("rule is null").select("verdict").distinct().collect()}
    assert verdicts == {"allow", "block"}


def test_url_tree_against_brute_force():
    rng = np.random.default_rng(6)
    bins = rng.integers(0, 4, size=(80, 3)).tolist()
    g = [float((b[1] > 1) - 0.5 + x) for b, x in zip(bins, rng.normal(size=80) * 0.1, strict=True)]
    tests, leaf = urls._grow_tree(bins, g, [1.0] * 80, [3, 3, 3], 1, 1.0, 1.0)
    gain = {}
    for f in range(3):
        for b in range(3):
            low = [x for x, row in zip(g, bins, strict=True) if row[f] <= b]
            high = [x for x, row in zip(g, bins, strict=True) if row[f] > b]
            if low and high:
                gain[f, b] = sum(low) ** 2 / (len(low) + 1) + sum(high) ** 2 / (len(high) + 1)
    f, b = tests[1]
    assert (f, b) == max(gain, key=gain.get)
    for k in (2, 3):
        rows = [x for x, row in zip(g, bins, strict=True) if (row[f] > b) == (k == 3)]
        assert abs(tests[k] - sum(rows) / (len(rows) + 1)) < 1e-9
    assert all(k == 2 + (row[f] > b) for k, row in zip(leaf, bins, strict=True))


def test_pipeline_against_brute_force(spark):
    """Each stage's rows follow from its predecessor's by plain Python (the classifier by its own query)."""
    import corpus_pipeline
    import public_tokenizers
    from test_exact import dedup
    from test_pipeline import groups
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in quality.query(docs, labels).collect() if r["predicted"]}
    kept = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in good}
    roots = groups([(k, r["text"]) for k, r in kept.items()])
    texts = {k: kept[k]["text"] for k, root in roots.items() if k == root}
    cut = {k: t[2].decode() for k, t in dedup(sorted(texts.items()), 20).items() if t[1] == 0 or t[1] < t[0]}
    done = corpus_pipeline.run(spark, sf).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = {k: len(t.encode().split()) for k, t in cut.items()}
    taken: dict = {}
    for r in done:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
        assert r["ids"] == library.encode(cut[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    assert set(taken) <= set(cut) and max(taken.values()) <= 2
    words, drawn = {}, {}
    for k in cut:
        s = kept[k]["source"]
        words[s] = words.get(s, 0) + size[k]
        drawn[s] = drawn.get(s, 0) + size[k] * taken.get(k, 0)
    frame = spark.createDataFrame([(k, cut[k], kept[k]["source"]) for k in cut], "doc_id long, text string, source string")
    target = {kept[r["doc_id"]]["source"]: r["target"] for r in mixing.query(frame).collect()}
    assert all(abs(drawn[s] - target[s]) <= max(size[k] for k in cut if kept[k]["source"] == s) / 2 + 1 for s in words)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
