"""Best splits: prefix sums over value histograms for numbers, category masks or greedy sets for categories.

Rows are first summed to one per group, feature value and statistic (with map-side combine), so what is sorted and
scanned is the histogram and not the rows, in ranges of values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dominance import dominated
from ..functions.engine import NumpyOps, SparkOps
from ..functions.rng import hashed
from ..session import cut
from .targets import OfRegion, Target

#: Gains and value gaps up to this size don't count, categories up to this number are searched exhaustively.
MIN_GAIN, MIN_GAP, EXHAUSTIVE = 1e-7, 1e-7, 5


def histogram(rows: DataFrame, keys: Sequence[str], value: str, target: Target) -> DataFrame:
    """keys, v and the target's statistics for each different value (null: missing) of ``rows`` with a target."""
    if "w" not in rows.columns:
        rows = rows.withColumn("w", F.lit(1))
    known = rows.filter(f"({target.y}) is not null").withColumn("v", F.col(value))
    return known.groupBy(*keys, "v").agg(*[F.expr(e).cast("double").alias(k) for k, e in target.stats().items()])


def gain(target: Target, left: dict, right: dict, missing: dict, whole: dict) -> Column:
    """The decrease of a cut: missing cases are a third part of the node."""
    m = SparkOps
    n, seen = whole["n"], left["n"] + right["n"]
    if target.score:
        return target.split_score(left, right, m) * seen / n
    lost = F.when(missing["n"] > 0, missing["n"] * target.impurity(missing, m)).otherwise(0.0)
    return target.impurity(whole, m) - (left["n"] * target.impurity(left, m) + right["n"] * target.impurity(right, m) + lost) / n


def _sides(hist: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``hist`` with _next (the next value), _l_* (sums up to each value), _t_* (of all values) and _m_* (of the missing ones), by windows of a group."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    order = part.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here, gone, zero = F.col("v").isNotNull(), F.col("v").isNull(), F.lit(0.0)
    return hist.select(
        "*", F.lead("v").over(part.orderBy(F.col("v").asc_nulls_first())).alias("_next"),
        *[F.sum(F.when(here, F.col(k)).otherwise(zero)).over(order).alias(f"_l_{k}") for k in names],
        *[F.sum(F.when(here, F.col(k)).otherwise(zero)).over(part).alias(f"_t_{k}") for k in names],
        *[F.sum(F.when(gone, F.col(k)).otherwise(zero)).over(part).alias(f"_m_{k}") for k in names],
    ).filter(here)


def _scanned(hist: DataFrame, keys: Sequence[str], names: Sequence[str], lows: Sequence[str] = (), highs: Sequence[str] = ()) -> DataFrame:
    """The same in two passes over ranges of a group's values, so that a task has one range: the sums of each range, then those inside it
    behind what the ranges before it have. Of ``lows`` and ``highs`` the smallest and largest so far (_l_*) and of what comes after (_r_*). The
    layout is cut by a checkpoint."""
    ends = [(c, F.min, F.least) for c in lows] + [(c, F.max, F.greatest) for c in highs]
    laid = cut(hist.filter("v is not null").repartitionByRange(*keys, "v").withColumn("_part", F.spark_partition_id()))
    heads = laid.groupBy(*keys, "_part").agg(F.min("v").alias("_first"), *[F.sum(k).alias(k) for k in names], *[f(c).alias(c) for c, f, _ in ends])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    after = group.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    heads = heads.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_own"), F.lead("_first").over(group.orderBy("_part")).alias("_following"),
        *[F.coalesce(F.sum(k).over(before), F.lit(0.0)).alias(f"_b_{k}") for k in names], *[F.sum(k).over(group).alias(f"_t_{k}") for k in names],
        *[f(c).over(before).alias(f"_b_{c}") for c, f, _ in ends], *[f(c).over(after).alias(f"_a_{c}") for c, f, _ in ends],
    )
    lost = hist.filter("v is null").groupBy(*[F.col(k).alias(f"_n_{k}") for k in keys]).agg(*[F.sum(k).alias(f"_m_{k}") for k in names])
    meets = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_part") == F.col("_own"))
    out = laid.join(heads, meets)
    out = out.join(lost, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys]), "left") if keys else out.crossJoin(F.broadcast(lost))
    inside = Window.partitionBy(*keys, "_part").orderBy("v")
    upto, beyond = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow), inside.rowsBetween(1, Window.unboundedFollowing)
    return out.select(
        *keys, "v", F.coalesce(F.lead("v").over(inside), "_following").alias("_next"), *[(F.col(f"_b_{k}") + F.sum(k).over(upto)).alias(f"_l_{k}") for k in names],
        *[f"_t_{k}" for k in names], *[F.coalesce(f"_m_{k}", F.lit(0.0)).alias(f"_m_{k}") for k in names],
        *[most(F.col(f"_b_{c}"), f(c).over(upto)).alias(f"_l_{c}") for c, f, most in ends], *[most(F.col(f"_a_{c}"), f(c).over(beyond)).alias(f"_r_{c}") for c, f, most in ends],
    )


def num_cuts(hist: DataFrame, keys: Sequence[str], target: Target, leaf: int = 1, strict_right: bool = True, scan: bool = True) -> DataFrame:
    """keys, threshold, n_left, n_right, decrease of every allowed cut of ``hist``.

    The right side needs ``leaf`` + 1 cases with ``strict_right``; neighbouring values differ by more than MIN_GAP. With ``scan`` a group's values
    may be more than a task holds, without it (few values a group) one window does.
    """
    names = list(target.stats())
    wide = (_scanned if scan else _sides)(hist, keys, names)
    side = lambda p: {k: F.col(f"_{p}_{k}") for k in names}
    left, total, missing = side("l"), side("t"), side("m")
    right = {k: total[k] - left[k] for k in names}
    whole = {k: total[k] + missing[k] for k in names}
    allowed = wide.filter(F.col("_next").isNotNull() & (F.col("_next") - F.col("v") > MIN_GAP) & (left["n"] >= leaf) & (right["n"] >= leaf + int(strict_right)))
    return allowed.select(*keys, ((F.col("v") + F.col("_next")) / 2).alias("threshold"), left["n"].cast("long").alias("n_left"), right["n"].cast("long").alias("n_right"), gain(target, left, right, missing, whole).alias("decrease"))


def best(cuts: DataFrame, keys: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """The cut with the largest decrease above MIN_GAIN of each group; equal ones (to nine places) in order of ``ties``."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = cuts.filter(F.col("decrease") > MIN_GAIN).withColumn("_r", F.row_number().over(part.orderBy(F.round("decrease", 9).desc(), *ties)))
    return ranked.filter("_r = 1").drop("_r")


def best_num_split(rows: DataFrame, keys: Sequence[str], value: str, target: Target, leaf: int = 1, strict_right: bool = True) -> DataFrame:
    return best(num_cuts(histogram(rows, keys, value, target), keys, target, leaf, strict_right), keys, ["threshold"])


def random_num_split(rows: DataFrame, keys: Sequence[str], value: str, target: Target, seed: int, leaf: int = 1) -> DataFrame:
    """One cut of each group by a hash instead of the best one."""
    return random_cut(num_cuts(histogram(rows, keys, value, target), keys, target, leaf), keys, seed)


def random_cut(cuts: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """One of the cuts of each group, by a hash of its keys."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    cuts = cuts.withColumn("_n", F.count("*").over(part)).withColumn("_key", F.crc32(F.concat_ws(":", *[F.col(k).cast("string") for k in keys])) if keys else F.lit(0))
    return cuts.withColumn("_r", F.row_number().over(part.orderBy("threshold"))).filter(F.col("_r") == hashed("_key", "0", seed) % F.col("_n") + 1).drop("_r", "_n", "_key")


def cat_cuts(hist: DataFrame, keys: Sequence[str], target: Target, leaf: int = 1) -> DataFrame:
    """keys, left (sorted categories), n_left, n_right, decrease of each division of up to some ten categories.

    The last category is always on the right, so each division comes once. For two categories this is the one division.
    """
    names = list(target.stats())
    item = F.struct("v", *names)
    packed = hist.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("v").isNotNull(), item))).alias("cells"), *[F.sum(F.when(F.col("v").isNull(), F.col(k)).otherwise(0.0)).alias(f"_m_{k}") for k in names])
    masks = packed.filter("size(cells) > 1").withColumn("mask", F.explode(F.expr("sequence(1L, shiftleft(1L, size(cells) - 1) - 1)")))
    put = F.expr("transform(cells, (c, i) -> named_struct('c', c, 'l', shiftright(mask, i) % 2 = 1))")
    sides = masks.withColumn("put", put)
    total = lambda k, test: F.expr(f"aggregate(put, 0D, (a, x) -> a + if({test}, x.c.{k}, 0D))")
    sides = sides.select(*keys, F.expr("transform(filter(put, x -> x.l), x -> x.c.v)").alias("left"), *[total(k, "x.l").alias(f"_l_{k}") for k in names], *[total(k, "not x.l").alias(f"_r_{k}") for k in names], *[f"_m_{k}" for k in names])
    side = lambda p: {k: F.col(f"_{p}_{k}") for k in names}
    left, right, missing = side("l"), side("r"), side("m")
    whole = {k: left[k] + right[k] + missing[k] for k in names}
    allowed = sides.filter((left["n"] >= leaf) & (right["n"] >= leaf))
    return allowed.select(*keys, "left", left["n"].cast("long").alias("n_left"), right["n"].cast("long").alias("n_right"), gain(target, left, right, missing, whole).alias("decrease"))


def best_cat_split(rows: DataFrame, keys: Sequence[str], value: str, target: Target, leaf: int = 1) -> DataFrame:
    return best(cat_cuts(histogram(rows, keys, value, target), keys, target, leaf), keys, ["left"])


def random_cat_split(rows: DataFrame, keys: Sequence[str], value: str, target: Target, seed: int, masks: int = 511, leaf: int = 1) -> DataFrame:
    """The best of ``masks`` divisions drawn by a hash of division and category, for any number of categories."""
    hist = histogram(rows, keys, value, target).withColumn("v", F.col("v").cast("string"))
    names = list(target.stats())
    drawn = hist.filter("v is not null").withColumn("mask", F.explode(F.sequence(F.lit(1), F.lit(masks))))
    goes = hashed("_cat", "mask", seed) % 2 == 0
    drawn = drawn.withColumn("_cat", F.crc32("v")).withColumn("_goes", goes)
    both = drawn.groupBy(*keys, "mask").agg(F.array_sort(F.collect_list(F.when(F.col("_goes"), F.col("v")))).alias("left"), *[F.sum(F.when(F.col("_goes") == side, F.col(k)).otherwise(0.0)).alias(f"_{p}_{k}") for p, side in (("l", True), ("r", False)) for k in names])
    lost = hist.groupBy(*keys).agg(*[F.sum(F.when(F.col("v").isNull(), F.col(k)).otherwise(0.0)).alias(f"_m_{k}") for k in names])
    sides = both.join(lost, list(keys)) if keys else both.join(lost)
    side = lambda p: {k: F.col(f"_{p}_{k}") for k in names}
    left, right, missing = side("l"), side("r"), side("m")
    whole = {k: left[k] + right[k] + missing[k] for k in names}
    cuts = sides.filter((left["n"] >= leaf) & (right["n"] >= leaf)).select(*keys, "left", left["n"].cast("long").alias("n_left"), right["n"].cast("long").alias("n_right"), gain(target, left, right, missing, whole).alias("decrease"))
    return best(cuts, keys, ["left"])


def greedy_cat_split(rows: DataFrame, keys: Sequence[str], value: str, target: Target, leaf: int = 1) -> DataFrame:
    """keys, left, n_left, n_right, decrease by forward selection, for many categories: the category that helps most
    goes left as long as one helps. A group is one histogram, with a row for each category."""
    return greedy_cat_cuts(histogram(rows, keys, value, target).withColumn("v", F.col("v").cast("string")), keys, target, leaf)


def greedy_cat_cuts(hist: DataFrame, keys: Sequence[str], target: Target, leaf: int = 1) -> DataFrame:
    """The same on a histogram (keys, v, statistics)."""
    names = list(target.stats())
    types = {f.name: f.dataType.simpleString() for f in hist.schema}
    grouped = list(keys) or ["_all"]
    hist = hist if keys else hist.withColumn("_all", F.lit(0))
    types["_all"] = "int"

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = pdf[pdf.v.notna()].sort_values("v")
        x, m = seen[names].to_numpy(float), NumpyOps
        lost = pdf[pdf.v.isna()][names].to_numpy(float).sum(axis=0)
        split = lambda a: {k: a[..., i] for i, k in enumerate(names)}
        total = x.sum(axis=0)
        out = {k: [pdf[k].iloc[0]] for k in grouped}
        best_gain, chosen, now = MIN_GAIN, [], np.zeros(len(names))
        rest = list(range(len(x)))
        while rest:
            left = now + x[rest]
            right = total - left
            ok = (left[:, 0] >= leaf) & (right[:, 0] >= leaf)
            if not ok.any():
                gains = np.full(len(rest), -np.inf)
            else:
                with np.errstate(divide="ignore", invalid="ignore"):
                    if target.score:
                        gains = target.split_score(split(left), split(right), m) * total[0] / (total[0] + lost[0])
                    else:
                        im = lost[0] * target.impurity(split(lost), m) if lost[0] else 0.0
                        gains = target.impurity(split(total + lost), m) - (left[:, 0] * target.impurity(split(left), m) + right[:, 0] * target.impurity(split(right), m) + im) / (total[0] + lost[0])
                gains = np.where(ok, gains, -np.inf)
            k = int(np.argmax(np.round(gains, 12)))
            if not gains[k] > best_gain + 1e-12:
                break
            best_gain, now = gains[k], left[k]
            chosen.append(rest.pop(k))
        if not chosen:
            return pd.DataFrame({k: pd.Series([], dtype=object) for k in [*grouped, "left", "n_left", "n_right", "decrease"]})
        return pd.DataFrame(out | {"left": [sorted(seen.v.iloc[chosen])], "n_left": [int(now[0])], "n_right": [int(total[0] - now[0])], "decrease": [float(best_gain)]})

    schema = ", ".join(f"{k} {types[k]}" for k in grouped) + ", left array<string>, n_left long, n_right long, decrease double"
    found = hist.groupBy(*grouped).applyInPandas(search, schema)
    return found if keys else found.drop("_all")


def _deviation(n: str, total: str, mean: Column, below: tuple[str, str]) -> Column:
    """Sum of |y - mean| from count and sum of a set of values and those (``below``) of its values up to the mean."""
    count, part = map(F.col, below)
    return mean * count - part + (F.col(total) - part) - mean * (F.col(n) - count)


def deviation(rows: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """keys, n, mean, impurity: mean absolute distance from the mean of each group (nulls are a group)."""
    own = rows.filter(F.expr(y).isNotNull()).select(*keys, F.expr(y).cast("double").alias("_y"))
    means = own.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.avg("_y").alias("_mean"))
    meets = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]) if keys else F.lit(True)
    return own.join(means, meets).groupBy(*keys).agg(F.count("*").alias("n"), F.first("_mean").alias("mean"), F.avg(F.abs(F.col("_y") - F.col("_mean"))).alias("impurity"))


def absolute_split(rows: DataFrame, keys: Sequence[str], value: str, y: str, leaf: int = 1) -> DataFrame:
    """Best cut by mean absolute deviation from the mean (L1), for groups of any size; missing values are a third part.

    The mean moves with the cut, so each side's deviation is the sum over those of its values that lie below its mean: a question for all
    points left of the cut and below the mean, and one for those right of it.
    """
    known = rows.filter(F.expr(y).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    points = cut(known.groupBy(*keys, "x", "y").agg(F.count("*").cast("double").alias("n")).withColumn("s", F.col("n") * F.col("y")))
    sums = _scanned(points.groupBy(*keys, F.col("x").alias("v")).agg(F.sum("n").alias("n"), F.sum("s").alias("s")), keys, ["n", "s"])
    right = F.col("_t_n") - F.col("_l_n")
    cuts = cut(sums.filter(F.col("_next").isNotNull() & (F.col("_next") - F.col("v") > MIN_GAP) & (F.col("_l_n") >= leaf) & (right >= leaf + 1)).withColumns({"_r_n": right, "_r_s": F.col("_t_s") - F.col("_l_s")}))
    seen = points.filter("x is not null")
    low = dominated(seen, cuts.withColumns({"x": F.col("v"), "y": F.col("_l_s") / F.col("_l_n")}), keys, ["n", "s"]).withColumnsRenamed({"_d_n": "_a_n", "_d_s": "_a_s"}).drop("x", "y")
    both = dominated(seen.withColumn("x", -F.col("x")), low.withColumns({"x": -F.col("_next"), "y": F.col("_r_s") / F.col("_r_n")}), keys, ["n", "s"])
    sides = _deviation("_l_n", "_l_s", F.col("_l_s") / F.col("_l_n"), ("_a_n", "_a_s")) + _deviation("_r_n", "_r_s", F.col("_r_s") / F.col("_r_n"), ("_d_n", "_d_s"))
    spread = lambda df, name: deviation(df, keys, "y").select(*[F.col(k).alias(f"_{name}{i}") for i, k in enumerate(keys)], (F.col("n") * F.col("impurity")).alias(name))
    meets = lambda name: reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{name}{i}")) for i, k in enumerate(keys)]) if keys else F.lit(True)
    out = both.join(spread(known, "_all"), meets("_all")).join(spread(known.filter("x is null"), "_gone"), meets("_gone"), "left")
    whole = F.col("_t_n") + F.col("_m_n")
    gain_ = (F.col("_all") - sides - F.coalesce("_gone", F.lit(0.0))) / whole
    found = out.select(*keys, ((F.col("v") + F.col("_next")) / 2).alias("threshold"), F.col("_l_n").cast("long").alias("n_left"), F.col("_r_n").cast("long").alias("n_right"), gain_.alias("decrease"))
    return best(found, keys, ["threshold"])


def _log_volume(spans: Sequence[Column]) -> Column:
    """The sum of the logarithms of the spans above zero."""
    return reduce(Column.__add__, [F.log(F.when(s > 0, s).otherwise(1.0)) for s in spans], F.lit(0.0))


def _regional(target: OfRegion, numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, Column]:
    """Aggregates of a set of cases: the target's statistics, the ends of numbers, the different categories."""
    out = {k: F.expr(e).cast("double") for k, e in target.stats().items()}
    for i, c in enumerate(numeric):
        x = F.expr(f"nullif(cast(`{c}` as double), double('NaN'))")
        out |= {f"lo{i}": F.min(x), f"hi{i}": F.max(x)}
    return out | {f"d{i}": F.count_distinct(F.col(f"`{c}`")).cast("double") for i, c in enumerate(categorical)}


def region(rows: DataFrame, keys: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], target: OfRegion, total: float) -> DataFrame:
    """keys, n, impurity, predicted of the region that each group's cases span; ``total``: cases of the whole table."""
    if "w" not in rows.columns:
        rows = rows.withColumn("w", F.lit(1))
    made = _regional(target, numeric, categorical)
    sums = rows.filter(f"({target.y}) is not null").groupBy(*keys).agg(*[e.alias(f"_{k}") for k, e in made.items()])
    volume = _log_volume([*[F.coalesce(F.col(f"_hi{i}") - F.col(f"_lo{i}"), F.lit(0.0)) for i in range(len(numeric))], *[F.col(f"_d{i}") for i in range(len(categorical))]])
    stats = {k: F.col(f"_{k}") for k in target.stats()}
    return sums.select(*keys, F.col("_n").alias("n"), target.of_region(stats, volume, total, SparkOps).alias("impurity"), target.in_region(stats, volume, total, SparkOps).alias("predicted"))


def region_split(rows: DataFrame, keys: Sequence[str], value: str, numeric: Sequence[str], categorical: Sequence[str], target: OfRegion, total: float, leaf: int = 1) -> DataFrame:
    """Best cut of the feature ``value`` by a target of the regions that both sides span over all features, for groups of any size.

    Along the feature's order the ends of every number run from both directions, and a category counts on the left from its first value
    on and on the right up to its last one; all of that is merged over ranges.
    """
    if "w" not in rows.columns:
        rows = rows.withColumn("w", F.lit(1))
    known = rows.filter(f"({target.y}) is not null").withColumn("_v", F.expr(f"nullif(cast(`{value}` as double), double('NaN'))"))
    made, names = _regional(target, numeric, []), list(target.stats())
    hist = known.groupBy(*keys, F.col("_v").alias("v")).agg(*[e.alias(k) for k, e in made.items()])
    for i, c in enumerate(categorical):
        seen = known.filter(F.col(f"`{c}`").isNotNull() & F.col("_v").isNotNull()).groupBy(*keys, F.col(f"`{c}`").alias("_c")).agg(F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        marks = seen.select(*keys, F.explode(F.array(F.struct(F.col("_from").alias("v"), F.lit(1.0).alias("f"), F.lit(0.0).alias("t")), F.struct(F.col("_to").alias("v"), F.lit(0.0).alias("f"), F.lit(1.0).alias("t")))).alias("m"))
        marks = marks.groupBy(*[F.col(k).alias(f"_o{j}") for j, k in enumerate(keys)], F.col("m.v").alias("_at")).agg(F.sum("m.f").alias(f"from{i}"), F.sum("m.t").alias(f"to{i}"))
        meets = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_o{j}")) for j, k in enumerate(keys)], F.col("v") == F.col("_at"))
        hist = hist.join(marks, meets, "left").drop("_at", *[f"_o{j}" for j in range(len(keys))]).na.fill(0.0, [f"from{i}", f"to{i}"])
    n_num, n_cat = range(len(numeric)), range(len(categorical))
    wide = _scanned(hist, keys, [*names, *[f"{p}{i}" for i in n_cat for p in ("from", "to")]], [f"lo{i}" for i in n_num], [f"hi{i}" for i in n_num])
    span = lambda p: [F.coalesce(F.col(f"_{p}_hi{i}") - F.col(f"_{p}_lo{i}"), F.lit(0.0)) for i in n_num]
    volumes = {"l": _log_volume([*span("l"), *[F.col(f"_l_from{i}") for i in n_cat]]), "r": _log_volume([*span("r"), *[F.col(f"_t_to{i}") - F.col(f"_l_to{i}") for i in n_cat]])}
    left = {k: F.col(f"_l_{k}") for k in names}
    right = {k: F.col(f"_t_{k}") - F.col(f"_l_{k}") for k in names}
    part = lambda df, name: region(df, keys, numeric, categorical, target, total).select(*[F.col(k).alias(f"_{name}{j}") for j, k in enumerate(keys)], F.col("n").alias(f"_{name}_n"), F.col("impurity").alias(f"_{name}_i"))
    meets = lambda name: reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{name}{j}")) for j, k in enumerate(keys)]) if keys else F.lit(True)
    allowed = wide.filter(F.col("_next").isNotNull() & (F.col("_next") - F.col("v") > MIN_GAP) & (left["n"] >= leaf) & (right["n"] >= leaf + 1))
    out = allowed.join(part(known, "all"), meets("all")).join(part(known.filter("_v is null"), "gone"), meets("gone"), "left")
    lost = F.when(F.col("_gone_n") > 0, F.col("_gone_n") * F.col("_gone_i")).otherwise(0.0)
    gained = F.col("_all_i") - (left["n"] * target.of_region(left, volumes["l"], total, SparkOps) + right["n"] * target.of_region(right, volumes["r"], total, SparkOps) + lost) / F.col("_all_n")
    return best(out.select(*keys, ((F.col("v") + F.col("_next")) / 2).alias("threshold"), left["n"].cast("long").alias("n_left"), right["n"].cast("long").alias("n_right"), gained.alias("decrease")), keys, ["threshold"])
