"""All registered queries over the test tables, with the same in DuckDB's SQL.

The SQL is written on its own, the impurity formulas too (_FORMULAS): no text of the operators goes into it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.engine import SparkOps
from .functions.rng import RANGE, hash_numbers, hash_sql
from .operators import sample, score, splits, targets, transform
from .plans.forest import Forest, contrast_test
from .plans.grow import Growth
from .plans.scoring import score_leaves
from .sources import formats

Query = Callable[[SparkSession, str], DataFrame]
EVENT_TYPES = ("click", "purchase", "scroll", "signup", "view")
STATUS, PRIORITY = ("F", "O", "P"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
FLAGS = ("A", "N", "R")
DIMENSIONS = [f"d{i}" for i in range(64)]


def _t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


def _events(s: SparkSession, d: str) -> DataFrame:
    return _t("events")(s, d).select(F.col("event_id").alias("case_id"), F.col("event_type").alias("y"), "value", "user_id")


def _holes(s: SparkSession, d: str) -> DataFrame:
    return _events(s, d).withColumn("value", F.when(F.col("case_id") % 7 != 0, F.col("value")))


def _orders(s: SparkSession, d: str) -> DataFrame:
    return _t("orders")(s, d).select(F.col("o_orderkey").alias("case_id"), "o_totalprice", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("day"))


EVENTS = "(SELECT event_id AS case_id, event_type AS y, value, user_id FROM events)"
HOLES = "(SELECT event_id AS case_id, event_type AS y, CASE WHEN event_id % 7 <> 0 THEN value END AS value, user_id FROM events)"
ORDERS = "(SELECT o_orderkey AS case_id, o_totalprice, o_orderstatus AS status, o_orderpriority AS priority, CAST(epoch(o_orderdate) AS DOUBLE) AS day FROM orders)"


#: Impurities in SQL, written by hand. {x} is the prefix of a side's sums: {x}n cases, {x}c0.. of the classes, {x}s and {x}q of values and squares.
_FORMULAS: dict[str, Callable[[int], str]] = {
    "gini": lambda k: "(1 - " + " - ".join(f"pow({{x}}c{i} / {{x}}n, 2)" for i in range(k)) + ")",
    "entropy": lambda k: "(0 - " + " - ".join(f"(CASE WHEN {{x}}c{i} > 0 THEN {{x}}c{i} / {{x}}n * ln({{x}}c{i} / {{x}}n) ELSE 0 END)" for i in range(k)) + ")",
    "sse": lambda k: "({x}q - pow({x}s, 2) / {x}n)",
    "variance": lambda k: "({x}q / {x}n - pow({x}s / {x}n, 2))",
}


def _num_split_sql(source: str, v: str, y: str, formula: str = "gini", classes: tuple[str, ...] = (), leaf: int = 1, keys: str = "", shift: float = 0.0) -> str:
    """SQL of the best numeric cut, by a formula of _FORMULAS or a score: friedman, rate_distance."""
    value = f"(({y}) - {shift})"
    sums = {"n": "count(*)"} | ({f"c{k}": f"count(*) FILTER ({y} = '{c}')" for k, c in enumerate(classes)} if classes else {"s": f"sum({value})", "q": f"sum({value} * {value})"})
    part, lead, key = (f"PARTITION BY {keys}", f"{keys}, ", f"{keys}, ") if keys else ("", "", "")
    stats = ", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in sums.items())
    cum = ", ".join(f"sum({k}) OVER ({part} ORDER BY v ROWS UNBOUNDED PRECEDING) AS l_{k}, sum({k}) OVER ({part}) AS t_{k}" for k in sums)
    right = ", ".join(f"t_{k} - l_{k} AS r_{k}, t_{k} + m_{k} AS w_{k}" for k in sums)
    miss = ", ".join(f"coalesce(sum({k}), 0) AS m_{k}" for k in sums)
    if formula == "friedman":
        gain = "pow(l_s / l_n - r_s / r_n, 2) * l_n * r_n / (l_n + r_n) * (l_n + r_n) / w_n"
    elif formula == "rate_distance":
        gain = "(pow(l_c0 / t_c0 - l_c1 / t_c1, 2) + pow(r_c0 / t_c0 - r_c1 / t_c1, 2)) * t_n / w_n"
    else:
        i = lambda x: _FORMULAS[formula](len(classes)).format(x=x)
        gain = f"{i('w_')} - (l_n * {i('l_')} + r_n * {i('r_')} + CASE WHEN m_n > 0 THEN m_n * {i('m_')} ELSE 0 END) / w_n"
    zero = ", ".join(f"coalesce(m_{k}, 0) AS m_{k}" for k in sums)
    base = "SELECT * FROM p CROSS JOIN m" if not keys else f"SELECT p.*, {zero} FROM p LEFT JOIN m USING ({keys})"
    return f"""
WITH h AS (SELECT {key}{v} AS v, {stats} FROM {source} WHERE {y} IS NOT NULL GROUP BY {key}{v}),
p AS (SELECT {lead}v, lead(v) OVER ({part} ORDER BY v) AS nxt, {cum} FROM h WHERE v IS NOT NULL),
m AS (SELECT {lead}{miss} FROM h WHERE v IS NULL {"GROUP BY " + keys if keys else ""}),
b AS (SELECT *, {right} FROM ({base})),
c AS (SELECT {lead}(v + nxt) / 2 AS threshold, CAST(l_n AS BIGINT) AS n_left, CAST(r_n AS BIGINT) AS n_right, {gain} AS decrease FROM b
  WHERE nxt - v > 1e-7 AND l_n >= {leaf} AND r_n >= {leaf + 1}),
r AS (SELECT *, row_number() OVER ({part} ORDER BY round(decrease, 9) DESC, threshold) AS k FROM c WHERE decrease > 1e-7)
SELECT {lead}round(threshold, 6) AS threshold, n_left, n_right, round(decrease, 6) AS decrease FROM r WHERE k = 1"""


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _num(source, v: str, t: targets.Target, leaf: int = 1, keys: tuple[str, ...] = ()) -> Query:
    return lambda s, d: _rounded(splits.best_num_split(source(s, d), keys, v, t, leaf))


def _impurity(source, key: str, t: targets.Target) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        g = source(s, d).withColumn("w", F.lit(1)).groupBy(F.col(key).alias("grp")).agg(*[F.expr(e).cast("double").alias(k) for k, e in t.stats().items()])
        cols = {k: F.col(k) for k in t.stats()}
        return g.select("grp", F.col("n").cast("long").alias("n"), F.round(t.impurity(cols, SparkOps), 6).alias("impurity"), F.round(t.prediction(cols, SparkOps).cast("double"), 6).alias("predicted"))

    return run


def _group_sql(source: str, key: str, sums: dict[str, str], impurity: str, predicted: str) -> str:
    stats = ", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in sums.items())
    return f"SELECT grp, CAST(n AS BIGINT) AS n, round({impurity}, 6) AS impurity, round(CAST({predicted} AS DOUBLE), 6) AS predicted FROM (SELECT {key} AS grp, {stats} FROM {source} GROUP BY 1)"


def _class_sums(y: str, classes: tuple[str, ...]) -> dict[str, str]:
    return {"n": "count(*)"} | {f"c{k}": f"count(*) FILTER ({y} = '{c}')" for k, c in enumerate(classes)}


def _first_largest(values: list[str]) -> str:
    """SQL of the place of the largest value, the first of equals."""
    return "CASE greatest(" + ", ".join(values) + ") " + " ".join(f"WHEN {v} THEN {k}" for k, v in enumerate(values)) + " END"


def _status_impurities() -> dict[str, str]:
    """SQL of each impurity of order status (costs 1, 2, 5; the Neyman-Pearson class is F) by priority, by hand."""
    counts, sums = ["c0", "c1", "c2"], _class_sums("status", STATUS)
    costed = ["c0", "(2 * c1)", "(5 * c2)"]
    share = lambda c: f"(CASE WHEN {c} > 0 THEN {c} / n * ln({c} / n) ELSE 0 END)"
    np_pos = "c0 / 0.1 >= greatest(c0 / 0.1, c1, c2)"
    price = "(o_totalprice / 100000 - 1.5)"
    number = {"n": "count(*)", "s": f"sum({price})", "q": f"sum({price} * {price})"}
    by = lambda impurity, predicted, own=sums: _group_sql(ORDERS, "priority", own, impurity, predicted)
    return {
        "gini": by("1 - (c0 * c0 + c1 * c1 + c2 * c2) / (n * n)", _first_largest(counts)),
        "entropy": by(f"-({share('c0')} + {share('c1')} + {share('c2')})", _first_largest(counts)),
        "regret": by("(c0 + 2 * c1 + 5 * c2 - greatest(c0, 2 * c1, 5 * c2)) / (2 * n)", _first_largest(costed)),
        "weighted_gini": by("1 - (c0 * c0 + 4 * c1 * c1 + 25 * c2 * c2) / pow(c0 + 2 * c1 + 5 * c2, 2)", _first_largest(costed)),
        "disutility_entropy": by(f"-({share('c0')} + 2 * {share('c1')} + 5 * {share('c2')})", _first_largest(costed)),
        "neyman_pearson": by(f"CASE WHEN {np_pos} THEN 10 * greatest((n - c0) / n - 0.1, 0) ELSE c0 / n END", _first_largest(["(c0 / 0.1)", "c1", "c2"])),
        "sse": by("q - s * s / n", "s / n + 1.5", number),
        "variance": by("q / n - pow(s / n, 2)", "s / n + 1.5", number),
    }


def _cat_split_sql(source: str, v: str, y: str, cats: int, classes: tuple[str, ...] = (), formula: str = "gini", shift: float = 0.0, leaf: int = 1) -> str:
    value = f"(({y}) - {shift})"
    own = _class_sums(y, classes) if classes else {"n": "count(*)", "s": f"sum({value})", "q": f"sum({value} * {value})"}
    stats = ", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in own.items())
    sums = ", ".join(f"sum(CASE WHEN (mask >> i) % 2 = 1 THEN {k} ELSE 0 END) AS l_{k}, sum(CASE WHEN (mask >> i) % 2 = 1 THEN 0 ELSE {k} END) AS r_{k}, sum({k}) AS w_{k}" for k in own)
    i = lambda x: _FORMULAS[formula](len(classes)).format(x=x)
    return f"""
WITH h AS (SELECT {v} AS v, {stats} FROM {source} WHERE {v} IS NOT NULL GROUP BY 1),
i AS (SELECT *, row_number() OVER (ORDER BY v) - 1 AS i FROM h),
c AS (SELECT mask, list(v ORDER BY v) FILTER ((mask >> i) % 2 = 1) AS "left", {sums} FROM i CROSS JOIN (SELECT unnest(range(1, {1 << (cats - 1)})) AS mask) GROUP BY mask),
g AS (SELECT "left", l_n, r_n, {i('w_')} - (l_n * {i('l_')} + r_n * {i('r_')}) / w_n AS decrease FROM c WHERE l_n >= {leaf} AND r_n >= {leaf})
SELECT array_to_string("left", ':') AS left_set, CAST(l_n AS BIGINT) AS n_left, CAST(r_n AS BIGINT) AS n_right, round(decrease, 6) AS decrease FROM g WHERE decrease > 1e-7 ORDER BY round(decrease, 9) DESC, "left" LIMIT 1"""


def _cat(source, v: str, t: targets.Target, search=splits.best_cat_split) -> Query:
    return lambda s, d: _rounded(search(source(s, d), (), v, t).select(F.array_join("left", ":").alias("left_set"), "n_left", "n_right", "decrease"))


#: A small fixed model over orders: the root by price, a class split on the left and a missing branch on the right.
TREES = [
    {"tree": 0, "path": "*", "feature": "o_totalprice", "threshold": 150000.0, "left": None, "pred": "O", "weight": 1.0},
    {"tree": 0, "path": "*L", "feature": "priority", "threshold": None, "left": ["1-URGENT", "5-LOW"], "pred": "O", "weight": 1.0},
    {"tree": 0, "path": "*LL", "feature": None, "threshold": None, "left": None, "pred": "F", "weight": 1.0},
    {"tree": 0, "path": "*LR", "feature": None, "threshold": None, "left": None, "pred": "O", "weight": 1.0},
    {"tree": 0, "path": "*R", "feature": None, "threshold": None, "left": None, "pred": "P", "weight": 1.0},
    {"tree": 1, "path": "*", "feature": "gap", "threshold": 100000.0, "left": None, "pred": "F", "weight": 2.0},
    {"tree": 1, "path": "*L", "feature": None, "threshold": None, "left": None, "pred": "F", "weight": 2.0},
    {"tree": 1, "path": "*R", "feature": None, "threshold": None, "left": None, "pred": "O", "weight": 2.0},
    {"tree": 1, "path": "*M", "feature": "priority", "threshold": None, "left": ["2-HIGH"], "pred": "P", "weight": 2.0},
    {"tree": 1, "path": "*ML", "feature": None, "threshold": None, "left": None, "pred": "P", "weight": 2.0},
    {"tree": 1, "path": "*MR", "feature": None, "threshold": None, "left": None, "pred": "O", "weight": 2.0},
]
_LEAVES_SQL = """
(SELECT case_id, status, o_totalprice, 0 AS tree, CASE WHEN o_totalprice <= 150000 THEN CASE WHEN priority IN ('1-URGENT', '5-LOW') THEN '*LL' ELSE '*LR' END ELSE '*R' END AS path, 1.0 AS weight FROM o
 UNION ALL SELECT case_id, status, o_totalprice, 1, CASE WHEN gap IS NULL THEN CASE WHEN priority = '2-HIGH' THEN '*ML' ELSE '*MR' END WHEN gap <= 100000 THEN '*L' ELSE '*R' END, 2.0 FROM o)"""
_PRED_SQL = "CASE tree * 10 + CASE path WHEN '*LL' THEN 0 WHEN '*LR' THEN 1 WHEN '*R' THEN 2 WHEN '*L' THEN 3 WHEN '*ML' THEN 4 ELSE 5 END WHEN 0 THEN 'F' WHEN 1 THEN 'O' WHEN 2 THEN 'P' WHEN 12 THEN 'O' WHEN 13 THEN 'F' WHEN 14 THEN 'P' WHEN 15 THEN 'O' END"
_VOTES = f"WITH o AS (SELECT *, CASE WHEN case_id % 5 <> 0 THEN o_totalprice END AS gap FROM {ORDERS}), l AS (SELECT *, {_PRED_SQL} AS pred FROM {_LEAVES_SQL})"
_MODE = f"{_VOTES}, v AS (SELECT case_id, status, pred, sum(weight) AS w FROM l GROUP BY ALL), t AS (SELECT case_id, status, pred, row_number() OVER (PARTITION BY case_id ORDER BY w DESC, pred) AS k FROM v), p AS (SELECT case_id, status, pred FROM t WHERE k = 1)"
_VECTORS = f"{_VOTES}, m AS (SELECT case_id, string_agg(tree || ':' || path, ' ' ORDER BY tree || ':' || path) AS leaves FROM l GROUP BY 1)"
_NUMBER = "CASE pred WHEN 'F' THEN 1.0 WHEN 'O' THEN 2.0 ELSE 4.0 END"


def _model(s: SparkSession) -> DataFrame:
    return s.createDataFrame([tuple(n[k] for k in ("tree", "path", "feature", "threshold", "left", "pred", "weight")) for n in TREES], score.NODE)


def _gapped(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).withColumn("gap", F.when(F.col("case_id") % 5 != 0, F.col("o_totalprice")))


def _leaves(s: SparkSession, d: str) -> DataFrame:
    return score_leaves(_gapped(s, d), _model(s), ["o_totalprice", "gap"], ["priority"])


def _numbered(votes: DataFrame) -> DataFrame:
    return votes.withColumn("pred", F.when(F.col("pred") == "F", "1").when(F.col("pred") == "O", "2").otherwise("4"))


def _actual(s: SparkSession, d: str, column: str = "status") -> DataFrame:
    return _orders(s, d).select("case_id", F.col(column).alias("actual"))


def _embedding(s: SparkSession, d: str, dims: int = 64) -> DataFrame:
    return _t("embeddings")(s, d).select(F.col("vec_id").alias("case_id"), F.col("label").cast("string").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(dims)])


def _forest(**more) -> Forest:
    return Forest("label", "case_id", [f"d{i}" for i in range(64)], n_trees=3, how=Growth(max_depth=3, m_try=8), **more)


def _grown(**how) -> Query:
    """The nodes of one tree, grown with another measure of its cuts."""

    def run(s: SparkSession, d: str) -> DataFrame:
        f = Forest("label", "case_id", [f"d{i}" for i in range(64)], n_trees=1, how=Growth(max_depth=2, m_try=8, **how)).fit(_embedding(s, d))
        return _rounded(f.nodes.select("path", "feature", "threshold", "pred", "n", "impurity", "decrease"))

    return run


def _boosted(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d)
    f = Forest("o_totalprice", "case_id", ["day"], ["status", "priority"], n_trees=2, how=Growth(max_depth=2), boost="gbt", bag="none").fit(o)
    return score.regression_errors(f.predict(o), _actual(s, d, "o_totalprice"))


def _boosted_classes(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d).withColumn("y", F.when(F.col("status") == "F", "1").otherwise("0"))
    f = Forest("y", "case_id", ["day", "o_totalprice"], ["priority"], n_trees=2, how=Growth(max_depth=2), boost="gbt", bag="none").fit(o)
    return score.regression_errors(f.predict(o), o.select("case_id", F.col("y").cast("double").alias("actual")))


def _ada(cost: tuple[float, ...]) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        o = _orders(s, d).withColumn("month", F.floor(F.col("day") / 2629800))
        goal = targets.Regret(classes=STATUS, costs=cost)
        f = Forest("status", "case_id", ["month"], ["priority"], n_trees=2, how=Growth(max_depth=2), boost="ada", bag="none", classes=STATUS, impurity=goal).fit(o)
        return score.balanced_error(f.predict(o), _actual(s, d))

    return run


def _contrast(s: SparkSession, d: str) -> DataFrame:
    f = Forest("label", "case_id", [f"d{i}" for i in range(64)], n_trees=2, how=Growth(max_depth=2, m_try=16), classes=tuple(str(i) for i in range(10)))
    e = _embedding(s, d)
    return contrast_test(e, f, 3)[0]


_GINI = targets.Gini(classes=EVENT_TYPES)
_STATUS = {
    "gini": targets.Gini(y="status", classes=STATUS), "entropy": targets.Entropy(y="status", classes=STATUS), "regret": targets.Regret(y="status", classes=STATUS, costs=(1.0, 2.0, 5.0)),
    "weighted_gini": targets.WeightedGini(y="status", classes=STATUS, costs=(1.0, 2.0, 5.0)), "disutility_entropy": targets.DisutilityEntropy(y="status", classes=STATUS, costs=(1.0, 2.0, 5.0)),
    "neyman_pearson": targets.NeymanPearson(y="status", classes=STATUS, positive=0, alpha=0.1, kappa=10.0), "sse": targets.Sse(y="o_totalprice / 100000", shift=1.5), "variance": targets.Variance(y="o_totalprice / 100000", shift=1.5),
}
_ORDINAL = targets.Ordinal(y="label", classes=tuple(str(i) for i in range(10)))
_BOOST = targets.Boosted(y="status", classes=STATUS, costs=(1.0, 2.0, 5.0))


_ORDINAL_SQL = """
WITH l AS (SELECT vec_id % 7 AS grp, label FROM embeddings), c AS (SELECT grp, label, count(*) AS k FROM l GROUP BY 1, 2),
m AS (SELECT grp, label AS mode FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY k DESC, label) AS r FROM c) WHERE r = 1)
SELECT grp, count(*) AS n, round(avg(pow(label - mode, 2)), 6) AS impurity, CAST(any_value(mode) AS DOUBLE) AS predicted FROM l JOIN m USING (grp) GROUP BY 1"""
_BOOST_SQL = f"""
WITH o AS (SELECT priority AS grp, status, (1.0 + case_id % 3) * CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 5 END AS bw FROM {ORDERS}),
c AS (SELECT grp, status, count(*) AS k FROM o GROUP BY 1, 2), m AS (SELECT grp, status AS top FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY k DESC, status) AS r FROM c) WHERE r = 1)
SELECT grp, count(*) AS n, round(CAST(coalesce(sum(bw) FILTER (status <> top), 0) AS DOUBLE), 6) AS impurity, CAST(CASE any_value(top) WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS DOUBLE) AS predicted FROM o JOIN m USING (grp) GROUP BY 1"""


def _weighted_orders(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).withColumn("bw", 1.0 + F.col("case_id") % 3)


_H = hash_sql
_CASES = "(SELECT event_id AS case_id, event_type FROM events)"


def _cases(s: SparkSession, d: str) -> DataFrame:
    return _t("events")(s, d).select(F.col("event_id").alias("case_id"), "event_type", "user_id")


_BOOT = f"SELECT CAST(t AS INTEGER) AS tree, {_H('i', 't', 17)} % (SELECT count(*) FROM events) AS rank FROM (SELECT unnest(range((SELECT count(*) FROM events))) AS i) CROSS JOIN (SELECT unnest(range(2)) AS t)"
_RANK = "SELECT event_id AS case_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS rank FROM events"
_LONG = "SELECT vec_id AS case_id, 'd' || i AS feature, CAST(embedding[i + 1] AS DOUBLE) AS num FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS i)"


_RANDOM_SQL = f"""
WITH h AS (SELECT value AS v, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(count(*) FILTER (event_type = '{c}') AS DOUBLE) AS c{k}" for k, c in enumerate(EVENT_TYPES))} FROM events GROUP BY 1),
p AS (SELECT *, lead(v) OVER (ORDER BY v) AS nxt, {", ".join(f"sum({k}) OVER (ORDER BY v) AS l_{k}, sum({k}) OVER () - sum({k}) OVER (ORDER BY v) AS r_{k}, sum({k}) OVER () AS w_{k}" for k in ("n", "c0", "c1", "c2", "c3", "c4"))} FROM h),
c AS (SELECT *, row_number() OVER (ORDER BY v) AS place, count(*) OVER () AS cuts FROM p WHERE nxt - v > 1e-7 AND r_n >= 2)
SELECT round((v + nxt) / 2, 6) AS threshold, CAST(l_n AS BIGINT) AS n_left, CAST(r_n AS BIGINT) AS n_right,
  round({_FORMULAS["gini"](5).format(x="w_")} - (l_n * {_FORMULAS["gini"](5).format(x="l_")} + r_n * {_FORMULAS["gini"](5).format(x="r_")}) / w_n, 6) AS decrease FROM c WHERE place = {_H("0", "0", 5)} % cuts + 1"""
_L1_SQL = """
WITH k AS (SELECT DISTINCT c_nationkey AS v FROM customer), t AS (SELECT v, lead(v) OVER (ORDER BY v) AS nxt FROM k),
m AS (SELECT t.v, t.nxt, c_acctbal AS y, c_nationkey <= t.v AS l, avg(c_acctbal) OVER (PARTITION BY t.v, c_nationkey <= t.v) AS mu, avg(c_acctbal) OVER (PARTITION BY t.v) AS mw FROM t JOIN customer ON t.nxt IS NOT NULL),
g AS (SELECT (v + nxt) / 2 AS threshold, count(*) FILTER (l) AS n_left, count(*) FILTER (NOT l) AS n_right, avg(abs(y - mw)) - avg(abs(y - mu)) AS decrease FROM m GROUP BY v, nxt)
SELECT round(threshold, 6) AS threshold, n_left, n_right, round(decrease, 6) AS decrease FROM g WHERE n_left >= 20 AND n_right >= 21 AND decrease > 1e-7 ORDER BY decrease DESC, threshold LIMIT 1"""
_TEN = tuple(str(i) for i in range(10))
_ROOT_SQL = f"""
WITH c AS (SELECT 'd' || i AS feature, CAST(embedding[i + 1] AS DOUBLE) AS v, label FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS i)),
h AS (SELECT feature, v, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(count(*) FILTER (label = {k}) AS DOUBLE) AS c{k}" for k in range(10))} FROM c GROUP BY 1, 2),
p AS (SELECT feature, v, lead(v) OVER o AS nxt, {", ".join(f"sum({k}) OVER o AS l_{k}, sum({k}) OVER (PARTITION BY feature) AS w_{k}" for k in ("n", *(f"c{i}" for i in range(10))))} FROM h WINDOW o AS (PARTITION BY feature ORDER BY v)),
b AS (SELECT *, {", ".join(f"w_{k} - l_{k} AS r_{k}" for k in ("n", *(f"c{i}" for i in range(10))))} FROM p),
g AS (SELECT feature, (v + nxt) / 2 AS threshold, w_n, {_FORMULAS["gini"](10).format(x="w_")} AS impurity, {_FORMULAS["gini"](10).format(x="w_")} - (l_n * {_FORMULAS["gini"](10).format(x="l_")} + r_n * {_FORMULAS["gini"](10).format(x="r_")}) / w_n AS decrease FROM b WHERE nxt - v > 1e-7 AND r_n >= 2)
SELECT feature, round(threshold, 6) AS threshold, CAST(w_n AS BIGINT) AS n, round(impurity, 6) AS impurity, round(decrease, 6) AS decrease FROM g ORDER BY round(decrease, 9) DESC, feature, threshold LIMIT 1"""
_ROUND1_SQL = f"""
WITH o AS (SELECT case_id, day, o_totalprice AS y, o_totalprice - (SELECT avg(o_totalprice) FROM orders) AS r, (SELECT avg(o_totalprice) FROM orders) AS base FROM {ORDERS}),
h AS (SELECT day AS v, CAST(count(*) AS DOUBLE) AS n, sum(r) AS s FROM o GROUP BY 1),
p AS (SELECT v, lead(v) OVER (ORDER BY v) AS nxt, sum(n) OVER (ORDER BY v) AS ln, sum(s) OVER (ORDER BY v) AS ls, sum(n) OVER () AS tn, sum(s) OVER () AS ts FROM h),
b AS (SELECT (v + nxt) / 2 AS cut FROM p WHERE nxt IS NOT NULL AND ln >= 50 AND tn - ln >= 51 ORDER BY pow(ls / ln - (ts - ls) / (tn - ln), 2) * ln * (tn - ln) / tn DESC, v LIMIT 1),
f AS (SELECT y, base + 0.1 * avg(r) OVER (PARTITION BY day <= cut) AS f FROM o CROSS JOIN b), e AS (SELECT avg(pow(f - y, 2)) AS mse, var_pop(y) AS v FROM f)
SELECT round(mse / 1e9, 6) AS mse, round(mse / v, 6) AS scaled_error FROM e"""


def _density(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d)
    return splits.region(e, ["y"], ["value"], ["user_id"], targets.Density(), e.count()).select("y", F.round("impurity", 10).alias("impurity"), F.round("predicted", 10).alias("predicted"))


_DENSITY_SQL = f"SELECT y, round(pow(t / big, 2) / (a * u), 10) AS impurity, round(t / big / (a * u), 10) AS predicted FROM (SELECT y, CAST(count(*) AS DOUBLE) AS t, max(value) - min(value) AS a, count(DISTINCT user_id) AS u, (SELECT count(*) FROM events) AS big FROM {EVENTS} GROUP BY y)"


def _transduction(s: SparkSession, d: str) -> DataFrame:
    labels = _t("labels")(s, d).groupBy("doc_id").agg(F.max("quality").alias("q"))
    docs = _t("documents")(s, d).join(labels, "doc_id", "left").withColumn("y", F.coalesce(F.col("q").cast("string"), F.lit("?")))
    goal = targets.Transduction(classes=("?", "0", "1"), unlabelled=0, alpha=0.1)
    return _rounded(splits.region(docs, ["lang"], ["n_chars"], ["source"], goal, docs.count()).select("lang", "impurity", F.col("predicted").cast("int").alias("predicted")))


_TRANSDUCTION_SQL = """
SELECT lang, round(1 - (pow(t - c0 - c1, 2) + c0 * c0 + c1 * c1) / (t * t) + 0.1 * span * k / (t * t), 6) AS impurity, CASE WHEN c0 + c1 = 0 THEN 0 WHEN c0 >= c1 THEN 1 ELSE 2 END AS predicted
FROM (SELECT lang, CAST(count(*) AS DOUBLE) AS t, count(*) FILTER (q = 0) AS c0, count(*) FILTER (q = 1) AS c1, CAST(max(n_chars) - min(n_chars) AS DOUBLE) AS span, count(DISTINCT source) AS k
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id) GROUP BY lang)"""


def _region_split(t: targets.OfRegion) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        o = _orders(s, d).withColumns({"month": F.floor(F.col("day") / 2629800).cast("double"), "price": F.col("o_totalprice") / 100000})
        return _rounded(splits.region_split(o, (), "month", ["month", "price"], ["priority"], t, o.count(), 30), 8)

    return run


def _region_split_sql(impurity: str) -> str:
    """Both sides of each cut are aggregated anew from all orders. {big} is the number of all, v the volume."""
    side = "CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (status = 'F') AS c0, count(*) FILTER (status = 'O') AS c1, count(*) FILTER (status = 'P') AS c2, greatest(max(month) - min(month), 0) AS m, max(o_totalprice) / 100000 - min(o_totalprice) / 100000 AS p, count(DISTINCT priority) AS k"
    v = "(CASE WHEN m > 0 THEN m ELSE 1 END) * (CASE WHEN p > 0 THEN p ELSE 1 END) * k AS v"
    i = impurity.format(big="(SELECT count(*) FROM o)")
    return f"""
WITH o AS (SELECT *, floor(day / 2629800) AS month FROM {ORDERS}), k AS (SELECT DISTINCT month FROM o), t AS (SELECT month AS c, lead(month) OVER (ORDER BY month) AS nxt FROM k),
s AS (SELECT c, nxt, month <= c AS l, {side} FROM t JOIN o ON nxt IS NOT NULL GROUP BY ALL), x AS (SELECT *, {i} AS i FROM (SELECT *, {v} FROM s)),
w AS (SELECT {i} AS i, n FROM (SELECT *, {v} FROM (SELECT {side} FROM o))),
g AS (SELECT (c + nxt) / 2 AS threshold, CAST(sum(n) FILTER (l) AS BIGINT) AS n_left, CAST(sum(n) FILTER (NOT l) AS BIGINT) AS n_right, any_value(wi) - sum(n * i) / any_value(wn) AS decrease FROM x CROSS JOIN (SELECT i AS wi, n AS wn FROM w) GROUP BY c, nxt)
SELECT round(threshold, 8) AS threshold, n_left, n_right, round(decrease, 8) AS decrease FROM g WHERE n_left >= 30 AND n_right >= 31 AND decrease > 1e-7 ORDER BY round(decrease, 9) DESC, threshold LIMIT 1"""


def _root(s: SparkSession, d: str) -> DataFrame:
    """The root that a tree over all dimensions grows."""
    f = Forest("label", "case_id", [f"d{i}" for i in range(64)], n_trees=1, how=Growth(max_depth=1), bag="none").fit(_embedding(s, d))
    return _rounded(f.nodes.filter("path = '*'").select("feature", "threshold", "n", "impurity", "decrease"))


def _round1(s: SparkSession, d: str) -> DataFrame:
    """Errors after one round of gradient boosting."""
    o = _orders(s, d)
    f = Forest("o_totalprice", "case_id", ["day"], n_trees=1, how=Growth(max_depth=1, leaf=50), boost="gbt", bag="none").fit(o)
    return score.regression_errors(f.predict(o), _actual(s, d, "o_totalprice")).select(F.round(F.col("mse") / 1e9, 6).alias("mse"), F.round("scaled_error", 6).alias("scaled_error"))


_TEN_SUMS = ("n", *(f"c{k}" for k in range(10)))


def _boosted_sql(costs: tuple[float, ...]) -> Callable[[str], str]:
    """SQL of AdaBoost's impurity in the first round: the cost of the cases outside the most frequent class over all cases."""
    def of(x: str) -> str:
        own = _first_largest([f"{x}c{k}" for k in range(len(costs))])
        costed = [f"{c} * {x}c{k}" for k, c in enumerate(costs)]
        return f"(({' + '.join(costed)} - CASE {own} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(costed)) + " END) / (SELECT count(*) FROM embeddings))"

    return of


def _gini_sql(x: str) -> str:
    return _FORMULAS["gini"](10).format(x=x)


def _cells_sql() -> str:
    """All components of all vectors: case_id, label, feature, v."""
    return "SELECT vec_id AS case_id, label, 'd' || i AS feature, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS i)"


def _level_sql(name: str, places: str, impurity: Callable[[str], str], leaf: int = 1) -> str:
    """CTEs that end in ``name``: path, n, impurity, feature, threshold, decrease of the best cut of each node of ``places`` (case_id, path) over ``c``."""
    side = lambda p, e: ", ".join(f"{e.format(k=k)} AS {p}_{k}" for k in _TEN_SUMS)
    return f"""
{name}_h AS (SELECT path, feature, v, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(count(*) FILTER (label = {k}) AS DOUBLE) AS c{k}" for k in range(10))} FROM c JOIN {places} USING (case_id) GROUP BY 1, 2, 3),
{name}_p AS (SELECT path, feature, v, lead(v) OVER o AS nxt, {side("l", "sum({k}) OVER o")}, {side("w", "sum({k}) OVER (PARTITION BY path, feature)")} FROM {name}_h WINDOW o AS (PARTITION BY path, feature ORDER BY v)),
{name}_b AS (SELECT *, {side("r", "w_{k} - l_{k}")} FROM {name}_p),
{name}_g AS (SELECT path, feature, (v + nxt) / 2 AS threshold, w_n AS n, {impurity("w_")} AS impurity, {impurity("w_")} - (l_n * {impurity("l_")} + r_n * {impurity("r_")}) / w_n AS decrease FROM {name}_b WHERE nxt - v > 1e-7 AND l_n >= {leaf} AND r_n >= {leaf + 1}),
{name} AS MATERIALIZED (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(decrease, 9) DESC, feature, threshold) AS k FROM {name}_g WHERE decrease > 1e-7) WHERE k = 1)"""


def _moved_sql(name: str, level: str, places: str) -> str:
    """CTE ``name``: case_id, path one step below the cuts of ``level``."""
    return f"{name} AS MATERIALIZED (SELECT c.case_id, {level}.path || CASE WHEN c.v <= threshold THEN 'L' ELSE 'R' END AS path FROM {level} JOIN {places} USING (path) JOIN c ON c.case_id = {places}.case_id AND c.feature = {level}.feature)"


_ALL_AT_ROOT = "a0 AS (SELECT vec_id AS case_id, '*' AS path FROM embeddings)"
_DEPTH2_SQL = f"""
WITH c AS MATERIALIZED ({_cells_sql()}), {_ALL_AT_ROOT},{_level_sql("l0", "a0", _gini_sql)},
{_moved_sql("a1", "l0", "a0")},{_level_sql("l1", "a1", _gini_sql)}
SELECT path, feature, round(threshold, 6) AS threshold, CAST(n AS BIGINT) AS n, round(impurity, 6) AS impurity, round(decrease, 6) AS decrease FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1)"""


def _depth2(s: SparkSession, d: str) -> DataFrame:
    """The inner nodes of a tree of depth two over all dimensions, grown level by level."""
    f = Forest("label", "case_id", [f"d{i}" for i in range(64)], n_trees=1, how=Growth(max_depth=2, local_bytes=0), bag="none").fit(_embedding(s, d))
    return _rounded(f.nodes.filter("feature is not null").select("path", "feature", "threshold", "n", "impurity", "decrease"))


def _ada_round1(costs: tuple[float, ...]) -> Query:
    """Root and say of the first tree of AdaBoost or AdaCost."""
    def run(s: SparkSession, d: str) -> DataFrame:
        goal = targets.Regret(classes=_TEN, costs=costs)
        f = Forest("label", "case_id", [f"d{i}" for i in range(64)], n_trees=1, how=Growth(max_depth=1), boost="ada", bag="none", classes=_TEN, impurity=goal).fit(_embedding(s, d))
        return _rounded(f.nodes.filter("path = '*'").select("feature", "threshold", "n", "weight"))

    return run


def _ada_round1_sql(costs: tuple[float, ...]) -> str:
    return f"""
WITH c AS MATERIALIZED ({_cells_sql()}), {_ALL_AT_ROOT},{_level_sql("l0", "a0", _boosted_sql(costs))},
{_moved_sql("a1", "l0", "a0")},
k AS (SELECT path, label, count(*) AS n FROM a1 JOIN embeddings ON vec_id = case_id GROUP BY 1, 2),
m AS (SELECT path, max(n) AS most FROM k GROUP BY 1),
e AS (SELECT 1 - sum(most) / (SELECT count(*) FROM embeddings) AS err FROM m)
SELECT feature, round(threshold, 6) AS threshold, CAST(n AS BIGINT) AS n, round(CASE WHEN err >= 0.5 THEN 0.0 ELSE 0.5 * ln((1 - err) / greatest(err, 1e-10)) END, 6) AS weight FROM l0 CROSS JOIN e"""


def _ada_numbers_round1(s: SparkSession, d: str) -> DataFrame:
    c = _t("customer")(s, d)
    f = Forest("c_acctbal", "c_custkey", ["c_nationkey"], n_trees=1, how=Growth(max_depth=1, leaf=20), boost="ada", bag="none").fit(c)
    return _rounded(f.nodes.filter("path = '*'").select("threshold", "n", "weight"))


_ADA_NUMBERS_SQL = """
WITH k AS (SELECT DISTINCT c_nationkey AS v FROM customer), t AS (SELECT v, lead(v) OVER (ORDER BY v) AS nxt FROM k),
m AS (SELECT t.v, t.nxt, c_acctbal AS y, c_nationkey <= t.v AS l, avg(c_acctbal) OVER (PARTITION BY t.v, c_nationkey <= t.v) AS mu FROM t JOIN customer ON t.nxt IS NOT NULL),
g AS (SELECT (v + nxt) / 2 AS threshold, count(*) FILTER (l) AS nl, count(*) FILTER (NOT l) AS nr, sum(abs(y - mu)) FILTER (l) AS dl, sum(abs(y - mu)) FILTER (NOT l) AS dr, count(*) AS n FROM m GROUP BY v, nxt),
w AS (SELECT sum(abs(c_acctbal - (SELECT avg(c_acctbal) FROM customer))) AS d FROM customer),
b AS (SELECT *, d / n - (nl * dl / n + nr * dr / n) / n AS decrease FROM g CROSS JOIN w WHERE nl >= 20 AND nr >= 21 ORDER BY round(d / n - (nl * dl / n + nr * dr / n) / n, 9) DESC, threshold LIMIT 1)
SELECT round(threshold, 6) AS threshold, n, round(ln(d / ((dl + dr) / n)), 6) AS weight FROM b"""


def _gbt_class_round1(s: SparkSession, d: str) -> DataFrame:
    """Errors of the probabilities after one round of two-class gradient boosting."""
    o = _orders(s, d).withColumn("y", F.when(F.col("status") == "F", "1").otherwise("0"))
    f = Forest("y", "case_id", ["day"], n_trees=1, how=Growth(max_depth=1, leaf=50), boost="gbt", bag="none").fit(o)
    return score.regression_errors(f.predict(o), o.select("case_id", F.col("y").cast("double").alias("actual"))).select(F.round("mse", 8).alias("mse"))


_GBT_CLASS_SQL = f"""
WITH o AS (SELECT day, CAST(status = 'F' AS DOUBLE) AS y, (SELECT avg(CAST(status = 'F' AS DOUBLE)) FROM {ORDERS}) AS p FROM {ORDERS}),
h AS (SELECT day AS v, CAST(count(*) AS DOUBLE) AS n, sum(y - p) AS s FROM o GROUP BY 1),
q AS (SELECT v, lead(v) OVER (ORDER BY v) AS nxt, sum(n) OVER (ORDER BY v) AS ln_, sum(s) OVER (ORDER BY v) AS ls, sum(n) OVER () AS tn, sum(s) OVER () AS ts FROM h),
b AS (SELECT (v + nxt) / 2 AS cut FROM q WHERE nxt IS NOT NULL AND ln_ >= 50 AND tn - ln_ >= 51 ORDER BY pow(ls / ln_ - (ts - ls) / (tn - ln_), 2) * ln_ * (tn - ln_) / tn DESC, v LIMIT 1),
f AS (SELECT y, ln(p / (1 - p)) + 0.1 * sum(y - p) OVER (PARTITION BY day <= cut) / sum(p * (1 - p)) OVER (PARTITION BY day <= cut) AS f FROM o CROSS JOIN b)
SELECT round(avg(pow(1 / (1 + exp(-f)) - y, 2)), 8) AS mse FROM f"""


def _greedy_sql(source: str, v: str, y: str, shift: float = 0.0) -> str:
    """Forward selection by squared errors: in each step the category that helps most goes left."""
    i = lambda n, s, q: f"({q} - {s} * {s} / {n})"
    gain = f"{i('tn', 'ts', 'tq')} - (ln_ * {i('ln_', 'ls', 'lq')} + (tn - ln_) * {i('(tn - ln_)', '(ts - ls)', '(tq - lq)')}) / tn"
    return f"""
WITH RECURSIVE h AS (SELECT CAST({v} AS VARCHAR) AS v, CAST(count(*) AS DOUBLE) AS n, sum({y} - {shift}) AS s, sum(pow({y} - {shift}, 2)) AS q FROM {source} WHERE {v} IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n) AS tn, sum(s) AS ts, sum(q) AS tq FROM h),
g AS (SELECT CAST([] AS VARCHAR[]) AS chosen, 0.0::DOUBLE AS ln_, 0.0::DOUBLE AS ls, 0.0::DOUBLE AS lq, 1e-7::DOUBLE AS gain
  UNION ALL SELECT chosen, ln_, ls, lq, now FROM (SELECT *, row_number() OVER (ORDER BY round(now, 12) DESC, v) AS k FROM (
    SELECT v, list_append(chosen, v) AS chosen, ln_, ls, lq, gain, {gain} AS now FROM (SELECT h.v, chosen, ln_ + n AS ln_, ls + s AS ls, lq + q AS lq, gain FROM g CROSS JOIN h WHERE NOT list_contains(chosen, h.v)) CROSS JOIN t WHERE ln_ < tn))
    WHERE k = 1 AND now > gain + 1e-12)
SELECT array_to_string(list_sort(chosen), ':') AS left_set, CAST(ln_ AS BIGINT) AS n_left, CAST(tn - ln_ AS BIGINT) AS n_right, round(gain, 6) AS decrease FROM g CROSS JOIN t WHERE len(chosen) > 0 ORDER BY len(chosen) DESC LIMIT 1"""


def _random_cat_sql(seed: int, masks: int = 511) -> str:
    """Divisions of the nations' keys drawn by a hash; their checksums are constants."""
    sums = ", ".join(f"('{k}', {zlib.crc32(str(k).encode())})" for k in range(25))
    side = lambda p, test: ", ".join(f"sum(CASE WHEN {test} THEN {k} ELSE 0 END) AS {p}_{k}" for k in ("n", "s", "q"))
    i = lambda p: f"({p}_q - {p}_s * {p}_s / {p}_n)"
    return f"""
WITH k(v, crc) AS (VALUES {sums}), h AS (SELECT CAST(c_nationkey AS VARCHAR) AS v, CAST(count(*) AS DOUBLE) AS n, sum(c_acctbal / 1000) AS s, sum(pow(c_acctbal / 1000, 2)) AS q FROM customer GROUP BY 1),
d AS (SELECT h.*, mask, {_H('crc', 'mask', seed)} % 2 = 0 AS l FROM h JOIN k USING (v) CROSS JOIN (SELECT unnest(range(1, {masks + 1})) AS mask)),
g AS (SELECT mask, list(v ORDER BY v) FILTER (l) AS "left", {side("l", "l")}, {side("r", "NOT l")}, {side("w", "true")} FROM d GROUP BY mask),
c AS (SELECT "left", l_n, r_n, {i("w")} - (l_n * {i("l")} + r_n * {i("r")}) / w_n AS decrease FROM g WHERE l_n >= 1 AND r_n >= 1)
SELECT array_to_string("left", ':') AS left_set, CAST(l_n AS BIGINT) AS n_left, CAST(r_n AS BIGINT) AS n_right, round(decrease, 6) AS decrease FROM c WHERE decrease > 1e-7 ORDER BY round(decrease, 9) DESC, "left" LIMIT 1"""


def _priced(s: SparkSession, d: str) -> DataFrame:
    """A model made from orders: for each priority a tree that divides at its mean price."""
    means = _orders(s, d).groupBy("priority").agg(F.round(F.avg("o_totalprice")).alias("cut"))
    tree = means.select((F.substring("priority", 1, 1).cast("int") - 1).alias("tree"), "priority", "cut")
    node = lambda path, feature, cut_, pred: F.struct(F.lit(path).alias("path"), F.lit(feature).cast("string").alias("feature"), cut_.cast("double").alias("threshold"), pred.alias("pred"))
    nodes = F.array(node("*", "o_totalprice", F.col("cut"), F.lit("all")), node("*L", None, F.lit(None), F.lit("low")), node("*R", None, F.lit(None), F.col("priority")))
    return tree.select("tree", F.explode(nodes).alias("x")).select("tree", "x.path", "x.feature", "x.threshold", F.lit(None).cast("array<string>").alias("left"), "x.pred", F.lit(1.0).alias("weight"))


_PRICED_SQL = f"SELECT CAST(substr(priority, 1, 1) AS INTEGER) - 1 AS tree, priority, round(avg(o_totalprice)) AS cut FROM {ORDERS} GROUP BY priority"
_PRICED_SF_SQL = f"""
WITH m AS ({_PRICED_SQL})
SELECT 'FOREST=RF,TARGET="priority",NTREES=5,INTERCEPT=0.0' AS line UNION ALL SELECT 'TREE=' || tree || ',TARGET="priority",WEIGHT=1.0' FROM m
UNION ALL SELECT 'NODE=*,PRED="all",SPLITTER="o_totalprice",SPLITTERTYPE=NUMERICAL,LVALUES=' || CAST(cut AS DOUBLE) FROM m UNION ALL SELECT 'NODE=*L,PRED="low"' FROM m UNION ALL SELECT 'NODE=*R,PRED="' || priority || '"' FROM m"""


def _libsvm_cells(s: SparkSession, d: str) -> DataFrame:
    """All cells of the LibSVM lines of orders: target, number of the feature, value."""
    o = _orders(s, d).select("case_id", "status", F.when(F.col("case_id") % 5 != 0, F.col("day")).alias("day"), "priority")
    lines = formats.libsvm_table(o, "status", ["day"], ["priority"], "case_id").select(F.split("line", " ").alias("t"))
    cells = lines.select(F.get("t", F.lit(0)).cast("long").alias("target"), F.explode(F.slice("t", 2, 99)).alias("c"))
    return cells.select("target", F.split("c", ":")[0].cast("int").alias("feature"), F.round(F.split("c", ":")[1].cast("double"), 3).alias("num"))


_LIBSVM_SQL = f"""
WITH o AS (SELECT case_id, status, priority, CASE WHEN case_id % 5 <> 0 THEN day END AS day FROM {ORDERS}), k AS (SELECT status, row_number() OVER (ORDER BY min(case_id)) - 1 AS target FROM o GROUP BY 1),
p AS (SELECT priority, row_number() OVER (ORDER BY priority) + 1 AS feature FROM (SELECT DISTINCT priority FROM o))
SELECT CAST(target AS BIGINT) AS target, 1 AS feature, round(coalesce(day, (SELECT avg(day) FROM o)), 3) AS num FROM o JOIN k USING (status)
UNION ALL SELECT CAST(target AS BIGINT), CAST(feature AS INTEGER), 1.0 FROM o JOIN k USING (status) JOIN p USING (priority)"""


def _drawn_contrast_sql() -> str:
    """The drawn copies, each dealt anew by its own hash."""
    dealt = lambda k, i: f"SELECT a.case_id, 'd{i}:SHUFFLED:{k}' AS feature, b.num FROM (SELECT case_id, row_number() OVER (ORDER BY case_id) AS r FROM c WHERE feature = 'd{i}') a JOIN (SELECT num, row_number() OVER (ORDER BY {_H('case_id', '0', 9 + k)}, case_id) AS r FROM c WHERE feature = 'd{i}') b USING (r)"
    drawn = [int(hash_numbers(k, 0, 9)) % 64 for k in range(2)]
    return f"WITH c AS MATERIALIZED ({_LONG}) SELECT case_id, feature, num FROM c" + "".join(f" UNION ALL {dealt(k, i)}" for k, i in enumerate(drawn))



def _with_sql() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {
        "best_num_split_gini": (_num(_events, "value", _GINI), _num_split_sql(EVENTS, "value", "y", "gini", EVENT_TYPES)),
        "best_num_split_missing": (_num(_holes, "value", _GINI, 5), _num_split_sql(HOLES, "value", "y", "gini", EVENT_TYPES, 5)),
        "best_num_split_entropy": (_num(_holes, "value", targets.Entropy(classes=EVENT_TYPES)), _num_split_sql(HOLES, "value", "y", "entropy", EVENT_TYPES)),
        "best_num_split_sse": (_num(_orders, "day", _STATUS["sse"]), _num_split_sql(ORDERS, "day", "o_totalprice / 100000", "sse", shift=1.5)),
        "best_num_split_friedman": (_num(_orders, "day", targets.Friedman(y="o_totalprice / 100000", shift=1.5)), _num_split_sql(ORDERS, "day", "o_totalprice / 100000", "friedman", shift=1.5)),
        "best_num_split_rate_distance": (_num(_orders, "day", targets.RateDistance(y="status", classes=("F", "O")), 50), _num_split_sql(ORDERS, "day", "status", "rate_distance", ("F", "O"), 50)),
        "best_num_split_by_group": (_num(_orders, "day", _STATUS["gini"], 3, ("priority",)), _num_split_sql(ORDERS, "day", "status", "gini", STATUS, 3, "priority")),
        "best_num_split_lineitem": (_num(_t("lineitem"), "l_extendedprice", targets.Gini(y="l_returnflag", classes=FLAGS)), _num_split_sql("lineitem", "l_extendedprice", "l_returnflag", "gini", FLAGS)),
        "best_bin_split": (_cat(_t("lineitem"), "l_linestatus", targets.Gini(y="l_returnflag", classes=FLAGS)), _cat_split_sql("lineitem", "l_linestatus", "l_returnflag", 2, FLAGS)),
        "best_cat_split_exhaustive": (_cat(_orders, "priority", _STATUS["gini"]), _cat_split_sql(ORDERS, "priority", "status", 5, STATUS)),
        "best_cat_split_sse": (_cat(_orders, "priority", _STATUS["sse"]), _cat_split_sql(ORDERS, "priority", "o_totalprice / 100000", 5, formula="sse", shift=1.5)),
        "best_cat_split_greedy": (_cat(_t("part"), "p_name", targets.Sse(y="p_retailprice", shift=1000.0), splits.greedy_cat_split), None),
        "best_cat_split_greedy_30": (_cat(_t("customer"), "c_nationkey", targets.Sse(y="c_acctbal / 1000"), splits.greedy_cat_split), _greedy_sql("customer", "c_nationkey", "(c_acctbal / 1000)")),
        "best_num_split_l1": (lambda s, d: _rounded(splits.absolute_split(_t("customer")(s, d), (), "c_nationkey", "c_acctbal", 20)), _L1_SQL),
        "impurity_ordinal": (_impurity(lambda s, d: _embedding(s, d, 1).withColumn("g", F.col("case_id") % 7), "g", _ORDINAL), _ORDINAL_SQL),
        "impurity_boosted": (_impurity(_weighted_orders, "priority", _BOOST), _BOOST_SQL),
        "impurity_l1": (
            lambda s, d: _rounded(splits.deviation(_orders(s, d), ["priority"], "o_totalprice").select(F.col("priority").alias("grp"), "impurity"), 4),
            f"SELECT priority AS grp, round(avg(abs(o_totalprice - m)), 4) AS impurity FROM (SELECT *, avg(o_totalprice) OVER (PARTITION BY priority) AS m FROM {ORDERS}) GROUP BY 1",
        ),
        "best_num_split_random": (lambda s, d: _rounded(splits.random_num_split(_events(s, d), (), "value", _GINI, 5)), _RANDOM_SQL),
        "best_cat_split_random": (_cat(_t("customer"), "c_nationkey", targets.Sse(y="c_acctbal / 1000"), lambda rows, keys, v, t: splits.random_cat_split(rows, keys, v, t, 3)), _random_cat_sql(3)),
        "grow_root": (_root, _ROOT_SQL),
        "gbt_round1": (_round1, _ROUND1_SQL),
        "class_costs": (lambda s, d: _orders(s, d).groupBy("priority").agg(F.round(sum(F.count_if(F.col("status") == c) * w for c, w in zip(STATUS, targets.class_costs('{"O": 2.5, "P": 4}', STATUS), strict=True)), 6).alias("cost")), f"SELECT priority, CAST(round(sum(CASE status WHEN 'O' THEN 2.5 WHEN 'P' THEN 4 ELSE 0 END), 6) AS DOUBLE) AS cost FROM {ORDERS} GROUP BY 1"),
        "accuracy": (lambda s, d: _rounded(score.accuracy(score.tally_mode(_leaves(s, d)), _actual(s, d))), f"{_MODE} SELECT count(*) AS n, count(*) FILTER (pred = status) AS n_right, count(*) FILTER (pred IS NULL) AS n_unvoted, round(avg(CAST(pred = status AS DOUBLE)), 6) AS accuracy FROM p"),
        "predictions_tsv": (lambda s, d: formats.tsv_lines(score.predictions(score.tally_mode(_leaves(s, d)), _actual(s, d))), f"{_MODE} SELECT concat_ws(chr(9), case_id, pred, status) AS line FROM p"),
        "counter_tsv": (lambda s, d: formats.tsv_lines(_t("events")(s, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))), "SELECT concat_ws(chr(9), user_id, event_type, count(*)) AS line FROM events GROUP BY user_id, event_type"),
        "fold_test_part": (lambda s, d: sample.fold_parts(_cases(s, d), "case_id", sample.kfold(_cases(s, d), 7, 3), 2)[1], f"SELECT case_id, event_type, user_id FROM (SELECT event_id AS case_id, event_type, user_id, row_number() OVER (ORDER BY {_H('event_id', '0', 3)}, event_id) - 1 AS k, count(*) OVER () // 7 AS size FROM events) WHERE k // size = 2"),
        "poisson_bag": (lambda s, d: sample.poisson_bag(_cases(s, d), 2, 19), f"WITH u AS (SELECT CAST(t AS INTEGER) AS tree, event_id AS case_id, {_H('event_id', 't', 19)} / {float(RANGE)!r} AS u FROM events CROSS JOIN (SELECT unnest(range(2)) AS t)) SELECT tree, case_id, CAST(" + " + ".join(f"CAST(u >= {x!r} AS INTEGER)" for x in sample.POISSON) + f" AS BIGINT) AS mult FROM u WHERE u >= {sample.POISSON[0]!r}"),
        "drawn_contrasts": (lambda s, d: transform.drawn_contrasts(transform.to_cells(_embedding(s, d), "case_id", DIMENSIONS, []), DIMENSIONS, 2, 9).select("case_id", "feature", "num"), _drawn_contrast_sql()),
        "libsvm_table": (_libsvm_cells, _LIBSVM_SQL),
        "grow_depth2": (_depth2, _DEPTH2_SQL),
        "adaboost_round1": (_ada_round1((1.0,) * 10), _ada_round1_sql((1.0,) * 10)),
        "adacost_round1": (_ada_round1((1.0, 1.0, 4.0, 2.0) + (1.0,) * 6), _ada_round1_sql((1.0, 1.0, 4.0, 2.0) + (1.0,) * 6)),
        "num_adaboost_round1": (_ada_numbers_round1, _ADA_NUMBERS_SQL),
        "gbt_class_round1": (_gbt_class_round1, _GBT_CLASS_SQL),
        "best_cat_split_greedy_type": (_cat(_t("part"), "p_type", targets.Sse(y="p_retailprice", shift=1000.0), splits.greedy_cat_split), _greedy_sql("part", "p_type", "p_retailprice", 1000.0)),
        "density": (_density, _DENSITY_SQL),
        "transduction": (_transduction, _TRANSDUCTION_SQL),
        "best_num_split_density": (_region_split(targets.Density(y="status")), _region_split_sql("pow(n / {big}, 2) / v")),
        "best_num_split_transduction": (_region_split(targets.Transduction(y="status", classes=STATUS, alpha=1.0)), _region_split_sql("1 - (c0 * c0 + c1 * c1 + c2 * c2) / (n * n) + v / (n * n)")),
        "parse_missing": (
            lambda s, d: _t("customer")(s, d).select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "NA").when(F.col("c_custkey") % 4 == 1, "?").otherwise(F.col("c_mktsegment")).alias("cell"), F.when(F.col("c_custkey") % 3 == 0, "nan").otherwise(F.col("c_custkey").cast("string")).alias("number")).select("c_custkey", transform.parse_cat("cell").alias("category"), transform.parse_num("number").alias("number")),
            "SELECT c_custkey, CASE WHEN c_custkey % 4 > 1 THEN c_mktsegment END AS category, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey AS DOUBLE) END AS number FROM customer",
        ),
        "cat_codes": (lambda s, d: transform.cat_codes(_cases(s, d), "event_type", "case_id").select("event_type", F.col("code").cast("long").alias("code")), "SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY 1"),
        "impute_mean_mode": (
            lambda s, d: _rounded(transform.impute(_holes(s, d).withColumn("y", F.when(F.col("case_id") % 11 != 0, F.col("y"))), ["value"], ["y"], "case_id").select("case_id", "value", "y")),
            f"WITH h AS (SELECT case_id, value, CASE WHEN case_id % 11 <> 0 THEN y END AS y FROM {HOLES}) SELECT case_id, round(coalesce(value, (SELECT avg(value) FROM h)), 6) AS value, coalesce(y, (SELECT y FROM h WHERE y IS NOT NULL GROUP BY y ORDER BY count(*) DESC, min(case_id) LIMIT 1)) AS y FROM h",
        ),
        "encode_to_num": (lambda s, d: transform.encode_num(_events(s, d).select("case_id", "y"), "y", EVENT_TYPES), "SELECT event_id AS case_id, " + ", ".join(f"CAST(event_type = '{c}' AS DOUBLE) AS \"y=={c}\"" for c in EVENT_TYPES) + " FROM events"),
        "encode_two_classes": (lambda s, d: transform.encode_num(_t("lineitem")(s, d).select("l_orderkey", "l_linestatus"), "l_linestatus", ("F", "O")), "SELECT l_orderkey, CASE l_linestatus WHEN 'F' THEN 0.0 ELSE 1.0 END::DOUBLE AS l_linestatus FROM lineitem"),
        "one_hot": (lambda s, d: transform.one_hot(_events(s, d).select("case_id", "y"), "y", EVENT_TYPES), "SELECT event_id AS case_id, " + ", ".join(f"CASE WHEN event_type = '{c}' THEN 'true' ELSE 'false' END AS \"y=={c}\"" for c in EVENT_TYPES) + " FROM events"),
        "max_categories": (lambda s, d: transform.max_categories(_t("part")(s, d), ["p_name", "p_brand", "p_type", "p_size"], 30), "SELECT * FROM (SELECT 'p_name' AS feature, count(DISTINCT p_name) AS n_cats FROM part UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part) WHERE n_cats <= 30"),
        "strip_names": (lambda s, d: transform.strip_names(_orders(s, d).select("case_id", "o_totalprice", "status"), "status"), f'SELECT status AS "C:0", case_id AS "N:1", o_totalprice AS "N:2" FROM {ORDERS}'),
        "keep_features": (lambda s, d: _t("part")(s, d).select(*transform.keep_features(_t("part")(s, d).columns, "p_partkey", ["p_name"], block="brand", include="^p_")), "SELECT p_partkey, p_type, p_size, p_retailprice FROM part"),
        "permute_target": (
            lambda s, d: transform.permute(_cases(s, d).select("case_id", "event_type"), "case_id", "event_type", 5),
            f"WITH a AS (SELECT event_id AS case_id, row_number() OVER (ORDER BY event_id) AS k FROM events), b AS (SELECT event_type, row_number() OVER (ORDER BY {_H('event_id', '0', 5)}, event_id) AS k FROM events) SELECT case_id, event_type FROM a JOIN b USING (k)",
        ),
        "contrast_features": (
            lambda s, d: transform.contrasts(transform.to_cells(_embedding(s, d), "case_id", DIMENSIONS, []), 3).select("case_id", "feature", "num"),
            f"WITH c AS ({_LONG}), a AS (SELECT case_id, feature, row_number() OVER (PARTITION BY feature ORDER BY case_id) AS k FROM c), b AS (SELECT feature, num, row_number() OVER (PARTITION BY feature ORDER BY {_H('case_id', '0', 3)}, case_id) AS k FROM c) SELECT * FROM c UNION ALL SELECT case_id, feature || ':SHUFFLED', num FROM a JOIN b USING (feature, k)",
        ),
        "bootstrap_bag": (lambda s, d: sample.bootstrap(_cases(s, d), 2, 17), f"WITH b AS ({_BOOT}), r AS ({_RANK}) SELECT tree, case_id, count(*) AS mult FROM b JOIN r USING (rank) GROUP BY 1, 2"),
        "oob_set": (lambda s, d: sample.out_of_bag(_cases(s, d), sample.bootstrap(_cases(s, d), 2, 17), 2), f"WITH b AS ({_BOOT}), r AS ({_RANK}) SELECT CAST(t AS INTEGER) AS tree, case_id FROM r CROSS JOIN (SELECT unnest(range(2)) AS t) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.tree = t AND b.rank = r.rank)"),
        "subsample": (lambda s, d: sample.subsample(_cases(s, d), 2, 23, 100), f"SELECT tree, case_id, CAST(1 AS BIGINT) AS mult FROM (SELECT CAST(t AS INTEGER) AS tree, event_id AS case_id, row_number() OVER (PARTITION BY t ORDER BY {_H('event_id', 't', 23)}, event_id) AS k FROM events CROSS JOIN (SELECT unnest(range(2)) AS t)) WHERE k <= 100"),
        "balanced_bag": (
            lambda s, d: sample.balanced_bag(_cases(s, d), "event_type", 2, 31, 500),
            f"WITH r AS (SELECT event_id AS case_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS rank FROM events), z AS (SELECT event_type, count(*) AS size, row_number() OVER (ORDER BY event_type) - 1 AS code FROM events GROUP BY 1), b AS (SELECT CAST(t AS INTEGER) AS tree, i, t, {_H('i', 't', 31)} % (SELECT count(*) FROM z) AS code FROM (SELECT unnest(range(500)) AS i) CROSS JOIN (SELECT unnest(range(2)) AS t)) SELECT tree, case_id, count(*) AS mult FROM (SELECT tree, event_type, {_H('i', 't', 32)} % size AS rank FROM b JOIN z USING (code)) JOIN r USING (event_type, rank) GROUP BY 1, 2",
        ),
        "secondary_balanced_bag": (
            lambda s, d: sample.secondary_balanced_bag(_orders(s, d), "priority", "status", 2, 41, 400),
            f"WITH o AS {ORDERS}, r AS (SELECT case_id, priority, status, row_number() OVER (PARTITION BY priority, status ORDER BY case_id) - 1 AS rank FROM o), c AS (SELECT priority, status, count(*) AS size, row_number() OVER (PARTITION BY priority ORDER BY status) - 1 AS code FROM o GROUP BY 1, 2), g AS (SELECT priority, sum(size) AS n, count(*) AS k, coalesce(sum(sum(size)) OVER (ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM c GROUP BY 1), b AS (SELECT CAST(t AS INTEGER) AS tree, i, t, {_H('i', 't', 41)} % (SELECT count(*) FROM o) AS u FROM (SELECT unnest(range(400)) AS i) CROSS JOIN (SELECT unnest(range(2)) AS t)), x AS (SELECT *, {_H('i', 't', 42)} % k AS code FROM b JOIN g ON u >= low AND u < low + n), y AS (SELECT tree, priority, status, {_H('i', 't', 43)} % size AS rank FROM x JOIN c USING (priority, code)) SELECT tree, case_id, count(*) AS mult FROM y JOIN r USING (priority, status, rank) GROUP BY 1, 2",
        ),
        "kfold": (lambda s, d: sample.kfold(_cases(s, d), 7, 3), f"SELECT case_id, CAST(k // size AS INTEGER) AS fold FROM (SELECT event_id AS case_id, row_number() OVER (ORDER BY {_H('event_id', '0', 3)}, event_id) - 1 AS k, count(*) OVER () // 7 AS size FROM events) WHERE size > 0 AND k < size * 7"),
        "kfold_stratified": (lambda s, d: sample.kfold(_cases(s, d), 7, 3, "event_type"), f"SELECT case_id, CAST(k // size AS INTEGER) AS fold FROM (SELECT event_id AS case_id, row_number() OVER (PARTITION BY event_type ORDER BY {_H('event_id', '0', 3)}, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) // 7 AS size FROM events) WHERE size > 0 AND k < size * 7"),
        "apply_tree": (lambda s, d: _leaves(s, d).select("tree", "case_id", "path", "pred", "weight"), f"{_VOTES} SELECT CAST(tree AS INTEGER) AS tree, case_id, path, pred, CAST(weight AS DOUBLE) AS weight FROM l"),
        "apply_tree_projection": (lambda s, d: _gapped(s, d).select("case_id", *[F.expr(score.score_sql(TREES, t)).alias(f"vote{t}") for t in (0, 1)]), f"{_VOTES} SELECT case_id, max(pred) FILTER (tree = 0) AS vote0, max(pred) FILTER (tree = 1) AS vote1 FROM l GROUP BY 1"),
        "votes_cat": (lambda s, d: score.tally_mode(_leaves(s, d)), f"{_MODE} SELECT case_id, pred FROM p"),
        "votes_num": (lambda s, d: _rounded(score.tally_mean(_numbered(_leaves(s, d)))), f"{_VOTES} SELECT case_id, round(CAST(sum({_NUMBER} * weight) / sum(weight) AS DOUBLE), 6) AS pred FROM l GROUP BY 1"),
        "votes_sum_expit": (lambda s, d: _rounded(score.tally_sum(_numbered(_leaves(s, d)), -6.0, True)), f"{_VOTES} SELECT case_id, round(1 / (1 + exp(-(CAST(sum({_NUMBER} * weight) AS DOUBLE) - 6))), 6) AS pred FROM l GROUP BY 1"),
        "vote_totals": (lambda s, d: score.vote_totals(_leaves(s, d), list(STATUS)), f'{_VOTES} SELECT case_id, ' + ", ".join(f"CAST(coalesce(sum(weight) FILTER (pred = '{c}'), 0) AS DOUBLE) AS \"{c}\"" for c in STATUS) + " FROM l GROUP BY 1"),
        "balanced_error": (lambda s, d: _rounded(score.balanced_error(score.tally_mode(_leaves(s, d)), _actual(s, d))), f"{_MODE} SELECT round(1 - avg(r), 6) AS balanced_error FROM (SELECT status, avg(CAST(pred = status AS DOUBLE)) AS r FROM p GROUP BY 1)"),
        "confusion": (lambda s, d: _rounded(score.confusion(score.tally_mode(_leaves(s, d)), _actual(s, d))), f"{_MODE}, a AS (SELECT status AS label, count(*) AS n_actual, count(*) FILTER (pred = status) AS n_right FROM p GROUP BY 1), b AS (SELECT pred AS label, count(*) AS n_predicted FROM p GROUP BY 1) SELECT label, n_actual, n_predicted, n_right, round((n_predicted - n_right) / n_predicted, 6) AS false_discovery_rate, round((n_actual - n_right) / n_actual, 6) AS miss_rate FROM (SELECT label, coalesce(n_actual, 0) AS n_actual, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_right, 0) AS n_right FROM a FULL JOIN b USING (label))"),
        "regression_errors": (
            lambda s, d: _rounded(score.regression_errors(score.tally_mean(_numbered(_leaves(s, d))), _orders(s, d).select("case_id", (F.col("o_totalprice") / 100000).alias("actual")))),
            f"{_VOTES}, v AS (SELECT case_id, any_value(o_totalprice) / 100000 AS a, CAST(sum({_NUMBER} * weight) / sum(weight) AS DOUBLE) AS p FROM l GROUP BY 1), e AS (SELECT avg((p - a) * (p - a)) AS mse, var_pop(a) AS v FROM v) SELECT round(mse, 6) AS mse, round(mse / v, 6) AS scaled_error, round(1 - mse / v, 6) AS r2 FROM e",
        ),
        "running_error": (
            lambda s, d: _rounded(score.running_error(_numbered(_leaves(s, d)), _orders(s, d).select("case_id", (F.col("o_totalprice") / 100000).alias("actual")))),
            f"{_VOTES}, v AS (SELECT case_id, tree, o_totalprice / 100000 AS a, CAST(sum({_NUMBER} * weight) OVER w / sum(weight) OVER w AS DOUBLE) AS p FROM l WINDOW w AS (PARTITION BY case_id ORDER BY tree)) SELECT CAST(tree AS INTEGER) AS tree, round(avg((p - a) * (p - a)), 6) AS squared_error FROM v GROUP BY 1",
        ),
        "proximity_members": (lambda s, d: score.leaf_vectors(_leaves(s, d)), f"{_VECTORS} SELECT * FROM m"),
        "proximity_groups": (lambda s, d: score.proximity_groups(_leaves(s, d)), f"{_VECTORS}, g AS (SELECT leaves, count(*) AS cases FROM m GROUP BY 1), x AS (SELECT leaves, cases, unnest(string_split(leaves, ' ')) AS leaf FROM g) SELECT a.leaves AS leaves_a, b.leaves AS leaves_b, count(*) AS n, a.cases AS cases_a, b.cases AS cases_b FROM x a JOIN x b USING (leaf) GROUP BY ALL"),
        "branch_counts": (lambda s, d: score.branch_counts(_leaves(s, d), _model(s)), f"{_VOTES} SELECT case_id, feature, count(*) AS n FROM (SELECT case_id, CASE WHEN tree = 0 THEN 'o_totalprice' ELSE 'gap' END AS feature FROM l UNION ALL SELECT case_id, 'priority' FROM l WHERE length(path) = 3) GROUP BY 1, 2"),
        "split_dump": (lambda s, d: score.split_dump(_priced(s, d)), f"""SELECT 'o_totalprice' AS feature, '["' || string_agg(cut, '","' ORDER BY cut) || '"]' AS splits FROM (SELECT CAST(CAST(cut AS DOUBLE) AS VARCHAR) AS cut FROM ({_PRICED_SQL}))"""),
        "welch_t": (
            lambda s, d: _rounded(score.welch(_events(s, d).withColumn("other", F.when(F.col("case_id") % 3 == 0, F.col("value") * 0.9)), "y", "value", "other").drop("p"), 5),
            f"SELECT y, round(ma, 5) AS mean, round((ma - mb) / sqrt(va / na + vb / nb), 5) AS t, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 5) AS df FROM (SELECT y, avg(value) AS ma, var_samp(value) AS va, count(value) AS na, avg(o) AS mb, var_samp(o) AS vb, count(o) AS nb FROM (SELECT y, value, CASE WHEN case_id % 3 = 0 THEN value * 0.9 END AS o FROM {EVENTS}) GROUP BY y)",
        ),
        "welch_p": (lambda s, d: _rounded(score.welch(_events(s, d).withColumn("other", F.when(F.col("case_id") % 3 == 0, F.col("value") * 0.9)), "y", "value", "other")), None),
        "afm_lines": (lambda s, d: formats.afm_lines(_t("nation")(s, d).select("n_nationkey", F.col("n_name").alias("C:name"), F.col("n_regionkey").alias("N:region")), "n_nationkey"), "SELECT 0 AS at, concat_ws(chr(9), '.', 'C:name', 'N:region') AS line UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey), concat_ws(chr(9), n_nationkey, n_name, n_regionkey) FROM nation"),
        "afm_lines_by_feature": (lambda s, d: formats.afm_lines(_t("region")(s, d).select("r_regionkey", F.col("r_name").alias("C:name")), "r_regionkey", True), "SELECT CAST(0 AS BIGINT) AS at, '.' || chr(9) || string_agg(CAST(r_regionkey AS VARCHAR), chr(9) ORDER BY r_regionkey) AS line FROM region UNION ALL SELECT 1, 'C:name' || chr(9) || string_agg(r_name, chr(9) ORDER BY r_regionkey) FROM region"),
        "arff_lines": (lambda s, d: formats.arff_lines(_orders(s, d).select("case_id", "status"), "orders"), f"SELECT 0 AS part, '@relation orders' AS line UNION ALL SELECT 1, '@attribute case_id numeric' UNION ALL SELECT 2, '@attribute status {{' || (SELECT string_agg(DISTINCT status, ',' ORDER BY status) FROM {ORDERS}) || '}}' UNION ALL SELECT 3, '@data' UNION ALL SELECT 4, case_id || ',' || status FROM {ORDERS}"),
        "libsvm_lines": (lambda s, d: formats.libsvm_lines(_t("part")(s, d).select("p_partkey", F.col("p_size").cast("long").alias("size"), (F.col("p_partkey") % 3).alias("rest")), "p_partkey"), "SELECT p_partkey || ' 1:' || p_size || CASE WHEN p_partkey % 3 <> 0 THEN ' 2:' || (p_partkey % 3) ELSE '' END AS line FROM part"),
        "sf_lines": (lambda s, d: formats.sf_lines(_priced(s, d), "priority").select("line"), _PRICED_SF_SQL),
        "logit_expit": (lambda s, d: _rounded(_t("lineitem")(s, d).select("l_orderkey", "l_linenumber", transform.expit(transform.logit(F.col("l_discount") + 0.01)).alias("p")).distinct()), "SELECT DISTINCT l_orderkey, l_linenumber, round(l_discount + 0.01, 6) AS p FROM lineitem"),
        "sparse_counter": (lambda s, d: _t("events")(s, d).groupBy(F.col("user_id").alias("i"), F.col("event_type").alias("j")).agg(F.count("*").alias("n")), "SELECT user_id AS i, event_type AS j, count(*) AS n FROM events GROUP BY 1, 2"),
        "forest_votes": (lambda s, d: _forest().fit(_embedding(s, d)).predict(_embedding(s, d)), None),
        "forest_oob_error": (lambda s, d: score.balanced_error(_forest().fit(_embedding(s, d)).oob(_embedding(s, d)), _embedding(s, d).select("case_id", F.col("label").alias("actual"))), None),
        "forest_importance": (lambda s, d: _forest().fit(_embedding(s, d)).importance(), None),
        "forest_probabilities": (lambda s, d: _forest().fit(_embedding(s, d)).predict_proba(_embedding(s, d)), None),
        "growth_vetted": (_grown(vet=True), None), "growth_unseen": (_grown(unseen=True), None), "growth_random_cuts": (_grown(random_cuts=True), None),
        "gbt_regression": (_boosted, None), "gbt_classes": (_boosted_classes, None), "adaboost": (_ada((1.0, 1.0, 1.0)), None), "adacost": (_ada((1.0, 1.0, 4.0)), None), "contrast_p_values": (_contrast, None),
    }
    for name, t in _STATUS.items():
        out[f"impurity_{name}"] = (_impurity(_orders, "priority", t), _status_impurities()[name])
    return out


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _with_sql().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _with_sql().items() if sql}
