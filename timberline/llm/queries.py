"""The registered queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, codes, fingerprints, mixing, quality, ranking, simhash, substring, suffixes, toxicity, urls, vptree, warc
from .common import table


def _over(f: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": _over(fingerprints.query, "documents"),
        "op2_nearest": _over(vptree.query, "embeddings"),
        "op3_substring_dedup": _over(substring.query, "documents"),
        "op4_bpe": _over(bpe.query, "documents"),
        "op5_mixing": _over(mixing.query, "documents"),
        "op6_quality": _over(quality.query, "documents", "labels"),
        "op7_toxicity": _over(toxicity.query, "documents", "labels"),
        "op8_simhash": _over(simhash.query, "documents"),
        "op9_url_filter": _over(urls.query, "pages"),
        "op10_warc": _over(warc.query, "pages"),
        "op11_ranked_search": _over(ranking.query, "documents", "benchmark"),
        "op12_vector_codes": _over(codes.query, "embeddings"),
        "op13_suffix_dedup": _over(suffixes.query, "documents"),
    }


_OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda s, x: s + x)) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10"""

_OP3 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p+19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
f AS (SELECT k, min({'d': doc_id, 'p': p}) AS first FROM win GROUP BY k HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, p + i AS pos FROM (SELECT win.doc_id, win.p, unnest(range(20)) AS i FROM win JOIN f USING (k) WHERE (win.doc_id, win.p) <> (f.first.d, f.first.p))),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY pos) AS t FROM word ANTI JOIN cov USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


_OP13 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS p FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
cov AS (SELECT DISTINCT doc_id, p + i AS p FROM (SELECT doc_id, p, unnest(range(50)) AS i FROM win JOIN f USING (k) WHERE doc_id > first)),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before <> p - 1) AS n_spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM cov) GROUP BY doc_id),
b AS (SELECT doc_id, h, unnest(range(len(h) // 2)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2), '' ORDER BY p) AS t FROM b ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_nearest": _OP2, "op3_substring_dedup": _OP3, "op10_warc": warc.oracle_sql(), "op11_ranked_search": ranking.oracle_sql(), "op12_vector_codes": codes.oracle_sql(), "op13_suffix_dedup": _OP13}
