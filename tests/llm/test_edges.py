"""Null, empty, long, tied and repeated rows, clashing extra columns and empty tables have defined results."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from timberline.llm import bpe, fingerprints, mixing, quality, simhash, substring, toxicity, urls, vptree, warc

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [(1, "a b c d\ne f", "en", "s1", 11), (2, None, None, None, None), (3, "", "en", "s1", 0), (4, LONG, "en", "s2", len(LONG)), (5, "  \t\n ", "de", None, 5), (6, "a b c d\ne f", "en", "s1", 11), (6, "a b c d\ne f", "en", "s1", 11), (None, "no id", "en", "s1", 5), (None, None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = [(1, 1, 0), (3, 0, 1), (3, 0, 1), (4, None, None), (None, 1, 1), (99, 0, 1)]
CLASHES = ("marks", "doc", "key", "at", "fp", "variant", "size", "taken", "copies", "kept", "n_words", "_id", "x", "y", "score", "bucket", "guest", "items", "host", "path", "rule", "payload", "block", "v", "q", "_copy")


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def labels(spark, rows=LABELS):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


OPERATORS = {
    "op1": lambda s, d: fingerprints.query(d), "op3": lambda s, d: substring.query(d), "op4": lambda s, d: bpe.query(d), "op5": lambda s, d: mixing.query(d),
    "op6": lambda s, d: quality.query(d, labels(s)), "op7": lambda s, d: toxicity.query(d, labels(s)), "op8": lambda s, d: simhash.query(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_messy_documents_keep_their_rows(spark, name):
    got = OPERATORS[name](spark, frame(spark)).collect()
    assert len(got) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_documents(spark, name):
    assert OPERATORS[name](spark, frame(spark, [])).count() == 0


def test_defined_results(spark):
    d = frame(spark)
    one = {r["doc_id"]: r for r in fingerprints.query(d).collect()}
    assert one[2]["n_chars"] == 0 and one[1]["fingerprint"] == one[6]["fingerprint"]
    three = {r["doc_id"]: r for r in substring.query(d).collect()}
    assert (three[2]["n_words"], three[2]["n_removed"], three[2]["kept_sha256"]) == (0, 0, EMPTY_SHA)
    assert three[4]["n_removed"] == 30_000 - 977
    four = {r["doc_id"]: r for r in bpe.query(d).collect()}
    assert (four[2]["n_tokens"], four[2]["decoded_sha256"]) == (0, EMPTY_SHA)
    five = [r for r in mixing.query(d).collect()]
    assert all(r["taken"] == 0 for r in five if r["size"] == 0) and all(r["taken"] <= 2 * r["size"] for r in five)
    eight = {r["doc_id"]: r for r in simhash.query(d).collect()}
    assert eight[2]["fingerprint"] == "0" * 16 and eight[2]["component_id"] == 2 == eight[5]["component_id"] and eight[6]["component_id"] == 1


def test_vectors(spark):
    good = [float(i % 7 - 3) for i in range(8)]
    rows = [(100, good), (100, good), (1, good), (2, None), (3, [0.0] * 8), (4, [float("nan")] * 8), (5, [None] + good[1:]), (6, [float("inf")] * 8), (7, good[:3]), (None, good), (8, [x + 1 for x in good]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit("clash"))
    got = [tuple(r) for r in vptree.query(df).orderBy("rank").collect()]
    assert [(r[0], r[1], r[2]) for r in got] == [(100, 1, 1), (100, 2, 8)] and got[0][3] == 0.0
    assert vptree.query(df.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "http://WWW.example.com/en/x", "<p>a &amp; b</p><script>x</script>"), (2, None, None), (3, "no scheme", ""), (4, "x://a.net/fr/?q=1", "<b"), (4, "x://a.net/fr/?q=1", "<b"), (None, "http://b.org", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in CLASHES})
    got = {r["page_id"]: r for r in urls.query(df).collect()}
    assert got[1]["rule"] == "www.example.com/en/" and got[1]["verdict"] == "allow" and got[1]["host"] == "www.example.com"
    assert got[2]["host"] == got[2]["path"] == "" and got[2]["rule"] is None and got[2]["verdict"] in ("allow", "block")
    assert got[4]["rule"] == "net/fr/" and got[4]["verdict"] == "block"
    assert urls.query(df.limit(0)).count() == 0
    made = warc.query(df).collect()
    assert len(made) == 12 and [r["block"] for r in made if r["page_id"] == 1 and r["record_type"] == "conversion"] == ["a & b"]
    assert warc.query(df.limit(0)).count() == 0


def test_stages_with_messy_documents(spark):
    d = frame(spark)
    for stage in (lambda x: quality.stage(x, labels(spark)), simhash.stage, substring.stage, mixing.stage):
        assert stage(d).columns == d.columns
        assert stage(d.limit(0)).count() == 0
        stage(d).collect()


def test_rows_without_id_are_documents_of_their_own(spark):
    words = " ".join(f"p{i}" for i in range(30))
    rows = [(None, f"{words} own{i}", "s", 1) for i in range(6)] + [(1, words, "s", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    assert sorted(r["n_removed"] for r in substring.query(d).collect()) == [0] + [30] * 6
    mixed = mixing.query(d).collect()
    assert len(mixed) == 7 and sum(r["doc_id"] is None for r in mixed) == 6
    assert sorted(r["n_chars"] for r in fingerprints.query(d).collect()) == sorted(len(r[1]) for r in rows)


def test_warc_records(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "a &eacute; &#8217;&#x27; &amp;lt; &lt;b&gt; &bogus; &#0; &nbsp;x&amp;#65;"), (2, "http://b/", "<p>" + "long &amp; " * 50_000 + "</p>")]
    made = warc.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["block"] for r in made if r["record_type"] == "conversion"}
    assert text[1] == "a é ’' &lt; <b> &bogus; � x&#65;" and text[2].count("&") == 50_000
    for r in made:
        lines = r["headers"].rstrip("\r\n").split("\r\n")
        assert lines[0] == "WARC/1.1" and all(": " in x for x in lines[1:]) and "X: y" not in lines
        assert any(x.startswith("WARC-Date: ") for x in lines)
    message = "HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>hé</p>\r\n\r\nmore"
    record = lambda kind, i, m: f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Date: 2020-02-0{i}T00:00:00Z\r\nWARC-Target-URI: http://h/{i}\r\nContent-Length: {len(m.encode())}\r\n\r\n{m}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record("warcinfo", 1, "x: y") + record("response", 2, message) + record("request", 3, "GET /") + record("response", 4, message)).encode())
    read = warc.read_responses(spark, str(tmp_path / "a.warc"))
    got = sorted((r["record_id"], r["date"], r["http_headers"], r["payload"]) for r in read.collect())
    assert got == [(f"<urn:uuid:{i}>", f"2020-02-0{i}T00:00:00Z", "HTTP/1.1 200 OK\r\nServer: x", "<p>hé</p>\r\n\r\nmore") for i in (2, 4)]
    meta = [r for r in warc.derivatives(read).collect() if r["record_type"] == "metadata"]
    assert {r["refers_to"] for r in meta} == {"<urn:uuid:2>", "<urn:uuid:4>"} and all("source-Server: x" in r["block"] for r in meta)


def test_entities_are_decoded_once_from_left_to_right(spark):
    rows = [(1, "u", "&amp;#38; &#38; &amp;amp;#38;"), (2, "u", "&amp;#38;"), (3, "u", "&lt;&amp;lt;&"), (4, "u", "&" * 7), (5, "u", "")]
    made = warc.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["block"] for r in made if r["record_type"] == "conversion"}
    assert text == {1: "&#38; & &amp;#38;", 2: "&#38;", 3: "<&lt;&", 4: "&" * 7, 5: ""}


def test_payloads_that_show_records_are_whole(spark, tmp_path):
    page = "<pre>about\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0 is a format</pre>"
    message = f"HTTP/1.1 200 OK\r\n\r\n{page}".encode()
    record = lambda i, b, size: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\n".encode() + (f"Content-Length: {len(b)}\r\n".encode() if size else b"") + b"\r\n" + b + b"\r\n\r\n"
    plain = record(1, message, True) + record(2, b"HTTP/1.1 200 OK\r\n\r\nlast", False) + record(3, b"no headers", True)
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (record(4, message, True), record(5, b"\r\n\r\n\xff", True))))
    got = {r["record_id"]: r["payload"] for r in warc.read_responses(spark, str(tmp_path)).collect()}
    assert got == {"<1>": page, "<2>": "last", "<3>": "no headers", "<4>": page, "<5>": "�"}


def test_large_ids_beside_missing_ones(spark):
    words = " ".join(f"p{i}" for i in range(30))
    rows = [((1 << 62) + 5, words, "s", 1), (None, words, "s", 1), (-(1 << 62), f"{words} x", "s", 1), ((1 << 63) - 1, "q", "s", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    assert {r["doc_id"]: r["n_removed"] for r in substring.query(d).collect()} == {(1 << 62) + 5: 30, None: 30, -(1 << 62): 0, (1 << 63) - 1: 0}


def test_mixing_agrees_for_repeated_ids_whatever_the_layout(spark):
    rows = [(i % 1500, "w " * (1 + i * i % 17), f"s{i % 3}", i % 7) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        results = []
        for shuffle, parts in ((3, 2), (7, 5), (7, 5)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffle)
            results.append(sorted(map(tuple, mixing.query(d.repartition(parts)).collect())))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert results[0] == results[1] == results[2]


def test_stages_give_back_columns_of_any_name(spark):
    names = ["_tl_row", "_tl_copies", "_tl_extra", "_at", "e0", "a b", "Rank"]
    d = frame(spark).withColumns({c: F.lit(f"mine{i}") for i, c in enumerate(names)})
    for stage in (lambda x: quality.stage(x, labels(spark)), simhash.stage, substring.stage, mixing.stage):
        got = stage(d)
        assert got.columns == d.columns
        assert {tuple(r[c] for c in names) for r in got.collect()} <= {tuple(f"mine{i}" for i in range(len(names)))}
