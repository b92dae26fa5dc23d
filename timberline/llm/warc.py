"""Derivatives of WARC responses: for each a metadata and a plain-text conversion record that refer to it.

Record ids are UUIDs made of digests, so reruns agree and a lost task makes the same records again. Everything is one
projection and one explode in SQL functions; there is no shuffle. Source records come from a table of pages or from WARC files.

Defined results: a null or empty payload gives an empty conversion block, a null URI or null headers are empty. Line ends inside a URI are
percent-encoded, so they cannot end a header. A derivative has the date of its source record, or ``date`` where that has none.
Entities are those of HTML 4 and numeric ones; a number that is no character becomes U+FFFD, an unknown name stays. Repeated rows give
records with the same ids. An empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (pattern, replacement), applied in this order: what isn't shown, block ends, other tags; then plain replacements; then white space.
HTML_PATTERNS = (
    (r"(?is)<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>|<!--.*?-->", ""),
    (r"(?is)<head[^>]*>.*?</head[^>]*>", ""),
    (r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)(?:[ \t\r\n/][^>]*)?>", "\n"),
    (r"<[^>]*>", ""),
)
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8}[0-9]{0,2});"
WHITE_SPACE = ((r"[ \t\r\f\x{00A0}]+", " "), (r" ?\n[ \n]*", "\n"))
#: The date of derivatives whose source has none.
DATE = "1970-01-01T00:00:00Z"
RECORD_COLUMNS = ("record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "refers_to_digest", "headers", "block")


def _character(code: Column) -> Column:
    """The character of a number."""
    real = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(real, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")


def _decoded(entity: Column) -> Column:
    """What an entity stands for; an unknown one for itself."""
    named = F.create_map(*[F.lit(x) for name in sorted(name2codepoint) for x in (name, chr(name2codepoint[name]))])
    inner = F.substring(entity, 2, 9)
    name = F.element_at(named, F.regexp_replace(inner, ";$", ""))
    number = F.when(inner.rlike("^#[xX]"), F.conv(F.regexp_extract(inner, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(inner, "([0-9]+);", 1))
    return F.when(inner.startswith("#"), _character(F.when(inner.startswith("#"), number).otherwise("0").cast("long"))).otherwise(F.coalesce(name, entity))


def unescape(text: Column) -> Column:
    """``text`` with its entities decoded once, from left to right: what lies between them and each one's character in turn."""
    found = F.regexp_extract_all(text, F.lit(ENTITY), 0)
    between = F.split(text, ENTITY, -1)
    whole = F.transform(F.arrays_zip(between.alias("b"), found.alias("e")), lambda p: F.concat(p["b"], F.coalesce(_decoded(p["e"]), F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(whole, "")).otherwise(text)


def plain_text(html: Column) -> Column:
    """The text of HTML, one line for each block."""
    out = html
    for pattern, put in HTML_PATTERNS:
        out = F.regexp_replace(out, pattern, put)
    # the stripped text is looked at several times
    out = F.get(F.transform(F.array(out), unescape), F.lit(0))
    for pattern, put in WHITE_SPACE:
        out = F.regexp_replace(out, pattern, put)
    return F.trim(out, F.lit(" \n"))


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)", 1), r"[ \t\r\n\f]+", " "))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _one_line(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def responses(pages: DataFrame) -> DataFrame:
    """page_id, record_id, target_uri, date, http_headers, payload, payload_digest: a response for each row of ``pages`` (page_id, url, html)."""
    url, html = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    digest = F.concat(F.lit("sha256:"), F.sha2(html, 256))
    record_id = _uuid(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, digest)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), record_id.alias("record_id"), url.alias("target_uri"), F.lit(None).cast("string").alias("date"), F.lit("Content-Type: text/html; charset=utf-8").alias("http_headers"), html.alias("payload"), digest.alias("payload_digest"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The response records of whole files, one after the other by their Content-Length."""
    for b in batches:
        for content in b.column(0):
            for head, block in records(content.as_py()):
                field = lambda name, text=head: (m := re.search(rb"(?im)^" + name + rb":[ \t]*([^\r\n]*)", text)) and (m[1].decode("utf-8", "replace").strip() or None)
                if (field(b"WARC-Type") or "").lower() != "response":
                    continue
                http, gap, payload = block.partition(b"\r\n\r\n")
                http, payload = (http, payload) if gap else (b"", block)
                digest = field(b"WARC-Payload-Digest") or "sha256:" + hashlib.sha256(payload).hexdigest()
                row = (field(b"WARC-Record-ID"), field(b"WARC-Target-URI"), field(b"WARC-Date"), http.decode("utf-8", "replace"), payload.decode("utf-8", "replace"), digest)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], names=["record_id", "target_uri", "date", "http_headers", "payload", "payload_digest"])


def records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(headers, block) of each record of a WARC file, gzipped (as a whole or record by record) or not.

    A record without Content-Length, or with one that the file is too short for, ends where the next version line follows an empty line.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head, begin = data[at:end], end + 4
        size = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)", head)
        stop = begin + int(size[1]) if size else len(data) + 1
        if stop > len(data):
            stop = data.find(b"\r\n\r\nWARC/1.", begin)
            stop = len(data) if stop < 0 else stop
        yield head, data[begin:stop]
        at = stop


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files (plain or gzipped), as ``responses`` gives them, without page_id.

    A file is one task's, its records are cut by their Content-Length; a file is 2 GB at most, as a cell is. Status line and
    headers of the HTTP message are the source headers, what follows them is the payload. A record without a payload digest gets the
    SHA-256 of its payload; bytes that aren't UTF-8 become U+FFFD in the payload.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInArrow(_records, "record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string")
    return found.select(F.lit(None).cast("long").alias("page_id"), "record_id", "target_uri", "date", "http_headers", "payload", "payload_digest")


def derivatives(source: DataFrame, date: str = DATE) -> DataFrame:
    """``source`` (page_id, record_id, target_uri, date, http_headers, payload, payload_digest) as page_id and RECORD_COLUMNS."""
    text = source.withColumns({"text": plain_text(F.coalesce("payload", F.lit(""))), "title": title(F.coalesce("payload", F.lit(""))), "uri": _one_line(F.coalesce("target_uri", F.lit(""))), "http": F.coalesce("http_headers", F.lit(""))})
    fields = F.concat(F.lit("title: "), F.col("title"), F.lit("\r\npayload-length: "), F.octet_length(F.coalesce("payload", F.lit(""))).cast("string"), F.lit("\r\ntext-length: "), F.octet_length("text").cast("string"), F.lit("\r\n"), F.when(F.col("http") == "", "").otherwise(F.concat(F.regexp_replace("http", r"(?m)^", "source-"), F.lit("\r\n"))))
    kinds = F.array(F.struct(F.lit("metadata").alias("t"), F.lit("application/warc-fields").alias("c"), fields.alias("b")), F.struct(F.lit("conversion").alias("t"), F.lit("text/plain; charset=utf-8").alias("c"), F.col("text").alias("b")))
    rows = text.select("page_id", F.col("record_id").alias("refers_to"), F.col("uri").alias("target_uri"), F.coalesce("date", F.lit(date)).alias("warc_date"), F.col("payload_digest").alias("refers_to_digest"), F.explode(kinds).alias("k"))
    rows = rows.select("page_id", F.col("k.t").alias("record_type"), "refers_to", "target_uri", "warc_date", F.col("k.c").alias("content_type"), F.col("k.b").alias("block"), "refers_to_digest")
    rows = rows.withColumns({"record_id": _uuid(F.col("record_type"), F.col("refers_to")), "content_length": F.octet_length("block").cast("long"), "block_digest": F.concat(F.lit("sha256:"), F.sha2("block", 256))})
    lines = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "warc_date"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Block-Digest", "block_digest"), ("WARC-Refers-To-Payload-Digest", "refers_to_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    headers = F.concat(F.lit("WARC/1.1\r\n"), *[F.concat(F.lit(f"{k}: "), F.col(c).cast("string"), F.lit("\r\n")) for k, c in lines])
    return rows.withColumn("headers", headers).select("page_id", *RECORD_COLUMNS)


def record_text(records: DataFrame) -> DataFrame:
    """page_id, record: the whole records, as a WARC file holds them one behind the other."""
    return records.select("page_id", F.concat("headers", F.lit("\r\n"), "block", F.lit("\r\n\r\n")).alias("record"))


def query(pages: DataFrame) -> DataFrame:
    """The rows of ``op10``: page_id and RECORD_COLUMNS, two rows for each page."""
    return derivatives(responses(pages))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL."""
    text = "payload"
    for pattern, put in HTML_PATTERNS:
        text = f"regexp_replace({text}, {_sql_text(pattern)}, {_sql_text(put)}, 'g')"
    tidy = "u"
    for pattern, put in WHITE_SPACE:
        tidy = f"regexp_replace({tidy}, {_sql_text(pattern)}, {_sql_text(put)}, 'g')"
    names = ", ".join(f"({_sql_text('&' + n + ';')}, {c})" for n, c in sorted(name2codepoint.items()))
    code = f"""CASE WHEN e LIKE '&#x%' OR e LIKE '&#X%' THEN CAST('0x' || e[4:-2] AS BIGINT) WHEN e LIKE '&#%' THEN CAST(e[3:-2] AS BIGINT) ELSE (SELECT c FROM names WHERE n = e) END"""
    uuid = lambda h: f"'<urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12) || '>'"
    nl, crlf = "chr(10)", "chr(13) || chr(10)"
    return f"""
WITH names(n, c) AS (VALUES {names}),
s AS (SELECT row_number() OVER () AS i, page_id, coalesce(url, '') AS url, coalesce(html, '') AS payload FROM pages),
d AS (SELECT *, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS target_uri, 'sha256:' || sha256(payload) AS refers_to_digest, {text} AS bare FROM s),
e AS (SELECT DISTINCT unnest(regexp_extract_all(bare, {_sql_text(ENTITY)})) AS e FROM d),
f AS (SELECT e, {code} AS c FROM e),
g AS (SELECT e, CASE WHEN c IS NULL THEN e WHEN c > 0 AND c < 1114112 AND NOT c BETWEEN 55296 AND 57343 THEN chr(CAST(c AS INTEGER)) ELSE chr(65533) END AS c FROM f),
o AS (SELECT i, generate_subscripts(b, 1) AS k, unnest(b) AS b, es FROM (SELECT i, regexp_split_to_array(bare, {_sql_text(ENTITY)}) AS b, regexp_extract_all(bare, {_sql_text(ENTITY)}) AS es FROM d)),
j AS (SELECT i, string_agg(o.b || coalesce(g.c, ''), '' ORDER BY k) AS u FROM o LEFT JOIN g ON g.e = o.es[k] GROUP BY i),
t AS (SELECT d.*, u FROM d JOIN j USING (i)),
r AS (SELECT *, md5('response' || {nl} || coalesce(CAST(page_id AS VARCHAR), '') || {nl} || url || {nl} || refers_to_digest) AS h,
  trim({tidy}, ' ' || {nl}) AS txt, trim(regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>([^<]*)', 1), '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ') AS title FROM t),
i AS (SELECT *, {uuid("h")} AS refers_to FROM r),
k AS (SELECT page_id, refers_to, target_uri, refers_to_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
  'title: ' || title || {crlf} || 'payload-length: ' || strlen(payload) || {crlf} || 'text-length: ' || strlen(txt) || {crlf} || 'source-Content-Type: text/html; charset=utf-8' || {crlf} AS block FROM i
  UNION ALL SELECT page_id, refers_to, target_uri, refers_to_digest, 'conversion', 'text/plain; charset=utf-8', txt FROM i),
m AS (SELECT *, md5(record_type || {nl} || refers_to) AS h, CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest FROM k),
n AS (SELECT *, {uuid("h")} AS record_id FROM m)
SELECT page_id, record_type, record_id, refers_to, target_uri, '{DATE}' AS warc_date, content_type, content_length, block_digest, refers_to_digest,
  'WARC/1.1' || {crlf} || 'WARC-Type: ' || record_type || {crlf} || 'WARC-Record-ID: ' || record_id || {crlf} || 'WARC-Date: {DATE}' || {crlf} || 'WARC-Refers-To: ' || refers_to || {crlf} || 'WARC-Target-URI: ' || target_uri || {crlf}
  || 'WARC-Block-Digest: ' || block_digest || {crlf} || 'WARC-Refers-To-Payload-Digest: ' || refers_to_digest || {crlf} || 'Content-Type: ' || content_type || {crlf} || 'Content-Length: ' || content_length || {crlf} AS headers, block
FROM n"""
