"""Feature transforms: missing tokens, dictionaries, imputation, encodings, contrasts, permutations, column filters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.rng import hash_numbers, hashed

#: The tokens that stand for a missing category, in any case.
MISSING = ("", "?", "nan", "na", "null")


def parse_num(cell: str) -> Column:
    """A number or null; NaN counts as missing, padding is ignored."""
    return F.expr(f"nullif(try_cast(trim({cell}) as double), double('NaN'))")


def parse_cat(cell: str) -> Column:
    return F.when(F.lower(F.col(cell)).isin(*MISSING), None).otherwise(F.col(cell))


def cat_codes(df: DataFrame, value: str, order: str) -> DataFrame:
    """value, code of each category; codes follow the first occurrence by ``order``."""
    first = df.filter(F.col(f"`{value}`").isNotNull()).groupBy(F.col(f"`{value}`")).agg(F.min(order).alias("_first"))
    return ranked(first, ["_first", value], name="code").select(value, "code")


def mode(df: DataFrame, value: str, order: str) -> DataFrame:
    """One row: the most frequent category; of equals the one seen first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"), F.min(order).alias("_f"))
    return counts.orderBy(F.desc("_n"), "_f").limit(1).select(value)


def impute(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], order: str) -> DataFrame:
    """Means for missing numbers, modes for missing categories. Both are one broadcast row."""
    out = df
    if numeric:
        means = df.agg(*[F.avg(c).alias(f"_mean_{c}") for c in numeric])
        out = out.crossJoin(F.broadcast(means)).withColumns({c: F.coalesce(F.col(c).cast("double"), f"_mean_{c}") for c in numeric})
    for c in categorical:
        out = out.crossJoin(F.broadcast(mode(df, c, order).withColumnRenamed(c, f"_mode_{c}"))).withColumn(c, F.coalesce(c, f"_mode_{c}"))
    return out.select(*df.columns)


def encode_num(df: DataFrame, value: str, categories: Sequence[str]) -> DataFrame:
    """Two categories or fewer become one column of codes, more become one 0/1 column each; missing stays missing."""
    if len(categories) <= 2:
        code = F.lit(None).cast("double")
        for k, c in enumerate(categories):
            code = F.when(F.col(value) == c, float(k)).otherwise(code)
        return df.withColumn(value, code)
    return df.withColumns({f"{value}=={c}": F.when(F.col(value).isNull(), None).otherwise((F.col(value) == c).cast("double")) for c in categories}).drop(value)


def one_hot(df: DataFrame, value: str, categories: Sequence[str]) -> DataFrame:
    """More than two categories become a true/false category each; other features pass through."""
    if len(categories) <= 2:
        return df
    return df.withColumns({f"{value}=={c}": F.when(F.col(value).isNull(), None).otherwise(F.when(F.col(value) == c, "true").otherwise("false")) for c in categories}).drop(value)


def keep_features(names: Sequence[str], target: str, blacklist: Sequence[str] = (), block: str | None = None, include: str | None = None) -> list[str]:
    """The feature names that the filters leave; regular expressions never drop the target."""
    fits = lambda n: n == target or ((block is None or not re.search(block, n)) and (include is None or re.search(include, n) is not None))
    return [n for n in names if n not in set(blacklist) and fits(n)]


def max_categories(df: DataFrame, features: Sequence[str], most: int) -> DataFrame:
    """feature, n_cats of the features with ``most`` categories or fewer."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in features])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_cats")) for c in features])).alias("p")
    return counts.select(pairs).select("p.feature", "p.n_cats").filter(F.col("n_cats") <= most)


def permute(df: DataFrame, key: str, value: str, seed: int, within: Sequence[str] = ()) -> DataFrame:
    """``df`` with the values (missing ones too) dealt anew among the rows, inside each group of ``within``."""
    at = ranked(df, [key], within, "_at")
    moved = ranked(df.select(*within, key, value), [hashed(key, "0", seed), key], within, "_at").select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate(within)], F.col("_at").alias("_to"), F.col(value).alias("_moved"))
    meets = F.col("_at") == F.col("_to")
    for i, c in enumerate(within):
        meets = meets & F.col(c).eqNullSafe(F.col(f"_m{i}"))
    return at.join(moved, meets).select(*[F.col("_moved").alias(c) if c == value else F.col(c) for c in df.columns])


def permute_features(df: DataFrame, key: str, pattern: str, seed: int) -> DataFrame:
    """``df`` with each feature whose name fits the regular expression dealt anew on its own."""
    for i, name in enumerate(c for c in df.columns if c != key and re.search(pattern, c)):
        df = permute(df, key, name, seed + i)
    return df


def contrasts(cells: DataFrame, seed: int) -> DataFrame:
    """``cells`` (case_id, feature, num, cat) and a permuted copy of each feature, named feature:SHUFFLED."""
    own = cells.select("case_id", "feature", "num", "cat")
    at = ranked(own.select("case_id", "feature"), ["case_id"], ["feature"], "_at")
    moved = ranked(own, [hashed("case_id", "0", seed), "case_id"], ["feature"], "_at").select("feature", "num", "cat", "_at")
    copy = at.join(moved, ["feature", "_at"]).select("case_id", F.concat("feature", F.lit(":SHUFFLED")).alias("feature"), "num", "cat")
    return own.unionByName(copy)


def drawn_contrasts(cells: DataFrame, names: Sequence[str], n: int, seed: int) -> DataFrame:
    """``cells`` and ``n`` permuted copies of features drawn with replacement; the k-th copy is named feature:SHUFFLED:k."""
    own = cells.select("case_id", "feature", "num", "cat")
    out = own
    for k in range(n):
        name = names[int(hash_numbers(k, 0, seed)) % len(names)]
        one = contrasts(own.filter(F.col("feature") == name), seed + k).filter(F.col("feature") != name)
        out = out.unionByName(one.withColumn("feature", F.lit(f"{name}:SHUFFLED:{k}")))
    return out


def wide_contrasts(df: DataFrame, key: str, names: Sequence[str], seed: int) -> DataFrame:
    """``df`` (key, names) with a permuted copy of each named column, one permutation of whole rows: two ranks and one join."""
    at = ranked(df.select(key, *names), [key], name="_at")
    moved = ranked(df.select(key, *names), [hashed(key, "0", seed), key], name="_at").select("_at", *[F.col(f"`{n}`").alias(f"{n}:SHUFFLED") for n in names])
    return at.join(moved, "_at").drop("_at")


def strip_names(df: DataFrame, target: str) -> DataFrame:
    """The target first, features as N:i or C:i by type."""
    kind = dict(df.dtypes)
    names = [target, *(c for c in df.columns if c != target)]
    return df.select(*[F.col(f"`{c}`").alias(f"{'C' if kind[c] in ('string', 'boolean') else 'N'}:{i}") for i, c in enumerate(names)])


def anonymise(df: DataFrame, order: str, target: str) -> DataFrame:
    """``case`` (0, 1, ... in ``order``) and the features as strip_names names them, categories replaced by their codes."""
    out = ranked(df, [order], name="_n").drop(order)
    for name, kind in out.dtypes:
        if kind == "string":
            codes = cat_codes(out, name, "_n").withColumnRenamed(name, "_of")
            out = out.join(codes, F.col(f"`{name}`") == F.col("_of"), "left").withColumn(name, F.col("code").cast("string")).drop("_of", "code")
    names = [target, *(c for c in out.columns if c not in (target, "_n"))]
    named = strip_names(out.drop("_n"), target).columns
    return out.select(F.col("_n").cast("string").alias("case"), *[F.col(f"`{c}`").alias(n) for c, n in zip(names, named, strict=True)])


def to_cells(df: DataFrame, case_id: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """case_id, feature, num, cat: one row for each case and feature."""
    rows = [F.struct(F.lit(c).alias("feature"), F.expr(f"nullif(cast(`{c}` as double), double('NaN'))").alias("num"), F.lit(None).cast("string").alias("cat")) for c in numeric]
    rows += [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("num"), F.col(c).cast("string").alias("cat")) for c in categorical]
    return df.select(F.col(case_id).cast("long").alias("case_id"), F.explode(F.array(*rows)).alias("x")).select("case_id", "x.*")


def logit(x: Column) -> Column:
    return F.log(x / (1 - x))


def expit(x: Column) -> Column:
    return (F.tanh(x / 2) + 1) / 2


def int_or_fraction(term: str, total: int) -> int:
    """A count, or with a decimal point the share of ``total``, rounded up; what isn't a number is 0."""
    try:
        return -int(-float(term) * total // 1) if "." in term else int(term, 0)
    except ValueError:
        return 0
