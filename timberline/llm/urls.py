"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for what no rule decides.

The URLs that a rule fits are the labelled ones; allowed and blocked ones weigh the same in training. Features are binned by
their quantiles, and equal rows of bins are counted by one aggregation; trees are grown from histograms over these counted
rows, each with the margins of the trees before. The finished trees are one SQL expression. No Python runs on the executors.

Training takes ``most_rows`` labelled URLs at most, by a hash of the URL, so at most as many rows of bins come to the driver;
suffix statistics are those of the same URLs. All URLs are judged.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule, and is judged by the trees by what it
has. Without labels of both kinds the verdict of unruled URLs is that of the labels (allow without labels). Ties of splits go to the first feature and the
smaller edge. Repeated rows are judged each; their urls count once in training. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "fragment", "labels", "hyphens", "suffix_length", "suffix_share", "suffix_blocked", "first_length")


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = tuple(Rule(*x) for x in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to a slash, question mark or number sign, lower-cased; then up to one of the latter two."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return _lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_text(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text of the longest rule that fits, or null; of equally long ones the first in order."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(r.text)) if out is None else out.when(fits, F.lit(r.text))
    return out.otherwise(F.lit(None).cast("string")) if out is not None else F.lit(None).cast("string")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def suffix(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """suffix, share (of the labelled URLs), blocked (share of them, drawn towards a half) of ``labelled`` (host, y)."""
    total = labelled.agg(F.count("*").alias("_total"))
    counts = labelled.groupBy(suffix(F.col("host")).alias("suffix")).agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    return counts.join(total).select("suffix", (F.col("n") / F.col("_total")).alias("share"), ((F.col("k") + 5) / (F.col("n") + 10)).alias("blocked"))


def lexical(df: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``df`` (url, host, path) with FEATURES; ``suffixes`` as of suffix_statistics. An unseen suffix counts as the most frequent one."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    part = "(length(u) - length(replace(u, c, ''))) / length(u)"
    entropy = f"coalesce(transform(array(coalesce(url, '')), u -> aggregate(array_distinct(split(u, '')), 0D, (a, c) -> if(c = '', a, a - {part} * ln({part}))))[0], 0D)"
    values = {
        "length": F.length(url), "host_length": F.length("host"), "depth": _count(F.col("path"), "/"), "digit_ratio": _count(url, "[0-9]") / n, "entropy": F.expr(entropy),
        "parameters": _count(F.regexp_extract(url, r"\?([^#]*)", 1), "="), "fragment": F.instr(url, "#") > 0, "labels": _count(F.col("host"), "\\."), "hyphens": _count(url, "[-_]"),
        "suffix_length": F.length("_suffix"), "suffix_share": F.coalesce("_share", "_usual.share", F.lit(0.0)), "suffix_blocked": F.coalesce("_blocked", "_usual.blocked", F.lit(0.5)), "first_length": F.length(F.regexp_extract("host", r"^([^.]*)", 1)),
    }
    usual = suffixes.agg(F.max(F.struct("share", "blocked")).alias("_usual"))  # one row
    known = df.withColumn("_suffix", suffix(F.col("host"))).join(suffixes.toDF("_of", "_share", "_blocked"), F.col("_suffix") == F.col("_of"), "left").join(F.broadcast(usual))
    return known.select(*[F.col(c) for c in df.columns], *[values[k].cast("double").alias(k) for k in FEATURES])


def _grow_tree(bins: list[list[int]], g: list[float], h: list[float], widths: list[int], depth: int, ridge: float, least: float) -> tuple[dict, list[int]]:
    """Tests (node: feature, bin) and leaf values (node: float) of one tree, and each row's leaf. The root is node 1."""
    tests: dict[int, tuple[int, int] | float] = {}
    at = [1] * len(g)
    for level in range(depth + 1):
        members: dict[int, list[int]] = {}
        for i, k in enumerate(at):
            if k not in tests:
                members.setdefault(k, []).append(i)
        for k, rows in members.items():
            gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
            best = (1e-6, None)
            for f in range(len(widths)) if level < depth else ():
                cells = [[0.0, 0.0] for _ in range(widths[f] + 1)]
                for i in rows:
                    c = cells[bins[i][f]]
                    c[0] += g[i]
                    c[1] += h[i]
                gl = hl = 0.0
                for b in range(widths[f]):
                    gl, hl = gl + cells[b][0], hl + cells[b][1]
                    if hl >= least and hs - hl >= least:
                        gain = gl * gl / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs * gs / (hs + ridge)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, b))
            if best[1] is None:
                tests[k] = gs / (hs + ridge)
                continue
            f, b = tests[k] = best[1]
            for i in rows:
                at[i] = 2 * k + (bins[i][f] > b)
    return tests, at


def _tree_sql(tests: dict, edges: dict[str, list[float]], rate: float, k: int = 1) -> str:
    t = tests[k]
    if isinstance(t, float):
        return f"{rate * t!r}D"
    name = FEATURES[t[0]]
    return f"if({name} > {edges[name][t[1]]!r}D, {_tree_sql(tests, edges, rate, 2 * k + 1)}, {_tree_sql(tests, edges, rate, 2 * k)})"


def train(labelled: DataFrame, rounds: int = 20, depth: int = 4, bins: int = 16, rate: float = 0.3, ridge: float = 1.0, least: float = 1.0) -> str:
    """SQL of the log-odds that a URL with FEATURES is one with y = 1, learned from ``labelled`` (FEATURES, y), both classes
    weighing the same. What comes to the driver is a row for each different row of bins."""
    rows = cut(labelled.select(*FEATURES, F.col("y").cast("int").alias("y")))
    quantiles = [F.percentile_approx(k, [i / bins for i in range(1, bins)], 1000).alias(k) for k in FEATURES]
    head = rows.agg(F.count("*").alias("n"), F.sum("y").alias("ones"), *quantiles).first()
    n, ones = head["n"], head["ones"] or 0
    if not 0 < ones < n:
        return "1D" if n and ones else "-1D"
    edges = {k: sorted(set(head[k])) for k in FEATURES}
    cell = F.array(*[F.expr(" + ".join([*(f"int({k} > {e!r}D)" for e in edges[k]), "0"])) for k in FEATURES])
    counted = sorted((list(r["cell"]), r["y"], r["count"]) for r in rows.groupBy(cell.alias("cell"), "y").count().collect())
    at, ys = [r[0] for r in counted], [float(r[1]) for r in counted]
    weight = [r[2] * n / (2.0 * (ones if r[1] else n - ones)) for r in counted]
    margin, score = [0.0] * len(at), "0D"
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        tests, leaf = _grow_tree(at, [w * (y - q) for w, y, q in zip(weight, ys, p, strict=True)], [w * q * (1 - q) for w, q in zip(weight, p, strict=True)], [len(edges[k]) for k in FEATURES], depth, ridge, least)
        margin = [m + rate * tests[k] for m, k in zip(margin, leaf, strict=True)]
        score = f"{score} + {_tree_sql(tests, edges, rate)}"
    return score


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, most_rows: int = 20_000) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of each row of ``pages`` (page_id, url)."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    ruled = own.withColumns({"host": host, "path": path}).withColumn("rule", rule_text(F.col("host"), F.col("path"), rules))
    actions = F.create_map(*[F.lit(x) for r in reversed(rules) for x in (r.text, r.action)]) if rules else F.lit(None).cast("map<string,string>")
    ruled = ruled.withColumn("by_rule", F.element_at(actions, F.col("rule")))
    chosen = ruled.filter("by_rule is not null").select("url", "host", "path", (F.col("by_rule") == "block").cast("int").alias("y")).distinct()
    sample = cut(chosen.orderBy(F.xxhash64("url"), "url").limit(most_rows))
    suffixes = cut(suffix_statistics(sample))
    score = train(lexical(sample, suffixes))
    judged = lexical(ruled, suffixes).withColumn("block_score", F.expr(f"1 / (1 + exp(-({score})))"))
    verdict = F.coalesce("by_rule", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def query(pages: DataFrame) -> DataFrame:
    """The columns of ``op9``: page_id, host, path, rule, verdict, block_score."""
    return judge_urls(pages)
