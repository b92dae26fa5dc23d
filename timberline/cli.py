"""Command lines: ``python -m timberline.cli train|score|proximity|folds|convert ...``; each is a function as well."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ranks import ranked
from .operators import sample, score, targets, transform
from .plans.forest import Forest, contrast_test
from .plans.grow import Growth
from .plans.scoring import score_leaves
from .sources import formats


def table(spark: SparkSession, path: str, target: str | None = None, blacklist: str | None = None, block: str | None = None, include: str | None = None, most_categories: int | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """The table with a case number ``_case``, its numeric and its categorical features as the filters leave them."""
    df = ranked(formats.load(spark, path), ["case"], name="_case")
    names = [c for c in df.columns if c not in ("case", "_case")]
    dropped = [r["value"].split("\t")[0] for r in spark.read.text(blacklist).collect()] if blacklist else []  # one row for each listed feature
    if unknown := sorted(set(dropped) - set(names)):
        print("not in the table:", ", ".join(unknown))
    kept = [c for c in transform.keep_features(names, target, dropped, block, include) if c != target]
    kinds = dict(df.dtypes)
    texts = [c for c in kept if kinds[c] == "string"]
    if most_categories and texts:
        few = {r["feature"] for r in transform.max_categories(df.select(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(texts)]), [f"f{i}" for i in range(len(texts))], most_categories).collect()}
        texts = [c for i, c in enumerate(texts) if f"f{i}" in few]
    return df, [c for c in kept if kinds[c] != "string"], texts


def _goal(args: argparse.Namespace, classes: tuple[str, ...], number: bool) -> targets.Target | None:
    costs = lambda text: targets.class_costs(text, classes)
    if args.density:
        return targets.Density()
    if number:
        return targets.Absolute() if args.l1 else None
    picks = (
        (args.cost, lambda x: targets.Regret(classes=classes, costs=costs(x))), (args.rfweights, lambda x: targets.WeightedGini(classes=classes, costs=costs(x))),
        (args.dentropy, lambda x: targets.DisutilityEntropy(classes=classes, costs=costs(x))), (args.adacost, lambda x: targets.Boosted(classes=classes, costs=costs(x))),
        (args.entropy, lambda _: targets.Entropy(classes=classes)), (args.hellinger, lambda _: targets.RateDistance(classes=classes)), (args.ordinal, lambda _: targets.Ordinal(classes=classes)),
        (args.np, lambda x: targets.NeymanPearson(classes=classes, positive=classes.index(x), alpha=args.np_alpha, kappa=args.np_kappa)),
        (args.unlabelled, lambda x: targets.Transduction(classes=classes, unlabelled=classes.index(x), alpha=args.trans_alpha, beta=args.trans_beta)),
    )
    return next((make(given) for given, make in picks if given), None)


def train(spark: SparkSession, args: argparse.Namespace) -> Forest:
    """A forest of ``args`` over the table at ``args.train``; writes the model, importances and out-of-bag predictions that are asked for."""
    df, numeric, categorical = table(spark, args.train, args.target, args.blacklist, args.block, args.include)
    number = dict(df.dtypes)[args.target] != "string"
    if args.impute:
        df = transform.impute(df, numeric, categorical, "_case")
    if args.permute:
        df = transform.permute(df, "_case", args.target, args.seed)
    if args.shuffle:
        df = transform.permute_features(df.drop("case"), "_case", args.shuffle, args.seed).withColumn("case", F.col("_case").cast("string"))
    known = df.filter(F.col(f"`{args.target}`").isNotNull())
    classes = () if number else tuple(r[0] for r in known.select(f"`{args.target}`").distinct().orderBy(f"`{args.target}`").collect())
    boost = "gbt" if args.gbt else "ada" if args.adaboost or args.adacost else None
    n = known.count()
    leaf = transform.int_or_fraction(args.leaf, n) if args.leaf else max(1, n // 3) if boost else 4 if number else 1
    m_try = transform.int_or_fraction(args.m_try, len(numeric) + len(categorical)) if args.m_try else None
    if args.contrasts:
        df = df.join(transform.wide_contrasts(df, "_case", [*numeric, *categorical], args.seed).drop(*numeric, *categorical), "_case")
        numeric, categorical = ([*xs, *(f"{x}:SHUFFLED" for x in xs)] for xs in (numeric, categorical))
    how = Growth(leaf=leaf, max_depth=args.depth, m_try=m_try or -int(-((len(numeric) + len(categorical)) ** 0.5) // 1), seed=args.seed, split_missing=args.split_missing, random_cuts=args.extra, vet=args.vet, unseen=args.unseen, force=args.force)
    by = (args.balance_by, args.target) if args.balance_by else (args.target,) if args.balance else ()
    kind = "secondary" if args.balance_by else "balanced" if args.balance else "subsample" if args.no_bag and args.samples else "none" if args.no_bag else "bootstrap"
    bag = sample.Bag(kind, args.seed, transform.int_or_fraction(args.samples, n) if args.samples else None, by)
    f = Forest(args.target, "_case", numeric, categorical, args.trees, how, _goal(args, classes, number), bag, boost, args.gbt or 0.1, args.seed, classes)
    if args.ace:
        tested, last = contrast_test(df, f, args.ace, args.cutoff)
        if args.importance:
            formats.tsv_lines(tested.select("feature", "p", "mean", "t")).write.mode("overwrite").text(args.importance)
        f = last or f.fit(df)
    else:
        f = f.fit(df)
        if args.importance:
            formats.tsv_lines(f.importance()).write.mode("overwrite").text(args.importance)
    actual = df.select(F.col("_case").alias("case_id"), F.col(f"`{args.target}`").alias("actual"))
    if args.model:
        formats.sf_lines(f.nodes, args.target, f.intercept).orderBy("tree", "at").select("line").write.mode("overwrite").text(args.model)
    if args.oob:
        formats.tsv_lines(score.predictions(f.oob(df), actual)).write.mode("overwrite").text(args.oob)
    if args.test:
        f.predict(df)
        (score.regression_errors if number else score.accuracy)(f.predict(df), actual).show()
    return f


def votes(spark: SparkSession, data: str, models: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The table and the votes (forest, tree, case_id, path, pred, weight) of the models' trees."""
    df, numeric, categorical = table(spark, data)
    out = None
    for i, path in enumerate(models):
        one = score_leaves(df.withColumnRenamed("_case", "case_id").select("case_id", *[F.col(f"`{c}`") for c in (*numeric, *categorical)]), formats.read_sf(spark, path), numeric, categorical).withColumn("forest", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return df, out


def apply(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """case, pred (and actual, where the table has the target) of the table at ``args.data``."""
    df, cast = votes(spark, args.data, args.model.split(","))
    head = formats.read_sf(spark, args.model.split(",")[0]).select("target", "intercept").first()
    target, intercept = (head["target"] or "", head["intercept"]) if head else ("", 0.0)
    if args.sum:
        pred = score.tally_sum(cast, intercept, args.expit)
    elif args.mean or (target.startswith("N") and not args.mode):
        pred = score.tally_mean(cast)
    else:
        pred = score.tally_mode(cast)
    actual = F.col(f"`{target}`").cast("string") if target in df.columns else F.lit(None).cast("string")
    out = df.select(F.col("_case").alias("case_id"), "case", actual.alias("actual")).join(pred, "case_id", "left").select("case", "pred", "actual")
    if args.out:
        formats.tsv_lines(out).write.mode("overwrite").text(args.out)
    if args.votes:
        names = [r[0] for r in cast.select("pred").filter("pred is not null").distinct().orderBy("pred").collect()]
        formats.tsv_lines(score.vote_totals(cast, names)).write.mode("overwrite").text(args.votes)
    return out


def proximity(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """leaves_a, leaves_b, n, cases_a, cases_b over all trees of the models; the cases' leaf vectors go to ``args.members``."""
    _, cast = votes(spark, args.data, args.model.split(","))
    placed = cast.withColumn("tree", F.col("forest") * 1_000_000 + F.col("tree"))
    out = score.proximity_groups(placed)
    if args.out:
        formats.tsv_lines(out).write.mode("overwrite").text(args.out)
    if args.members:
        formats.tsv_lines(score.leaf_vectors(placed)).write.mode("overwrite").text(args.members)
    if args.branches:
        nodes = None
        for i, path in enumerate(args.model.split(",")):
            own = formats.read_sf(spark, path).withColumn("tree", F.col("tree") + i * 1_000_000)
            nodes = own if nodes is None else nodes.unionByName(own)
        formats.tsv_lines(score.branch_counts(placed, nodes)).write.mode("overwrite").text(args.branches)
    return out


def folds(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """_case, fold; the parts of each fold go to ``args.out`` as train_i and test_i with its suffix."""
    df, numeric, categorical = table(spark, args.data, args.target, args.blacklist, args.block, args.include, args.most_categories)
    dealt = sample.kfold(df.withColumnRenamed("_case", "case_id"), args.folds, args.seed, args.target if args.stratify else None)
    columns = ["case", *([args.target] if args.target else []), *numeric, *categorical]
    for i in range(args.folds):
        for name, part in zip(("train", "test"), sample.fold_parts(df, "_case", dealt, i), strict=True):
            formats.save(part.select(*[F.col(f"`{c}`") for c in columns]), f"{args.out}/{name}_{i}{args.suffix}", target=args.target)
    return dealt


def convert(spark: SparkSession, args: argparse.Namespace) -> None:
    """The table at ``args.data`` written to ``args.out`` in the format of its suffix, anonymised if asked."""
    df, numeric, categorical = table(spark, args.data, args.target, args.blacklist, args.block, args.include)
    own = df.select("case", *[F.col(f"`{c}`") for c in ([args.target] if args.target else [])], *[F.col(f"`{c}`") for c in (*numeric, *categorical)])
    if args.anonymous:
        own = transform.anonymise(df.select("_case", *[F.col(f"`{c}`") for c in (args.target, *numeric, *categorical)]), "_case", args.target)
    formats.save(own, args.out, target=args.target)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("timberline")
    sub = top.add_subparsers(dest="command", required=True)
    filters = argparse.ArgumentParser(add_help=False)
    for name in ("blacklist", "block", "include", "target"):
        filters.add_argument(f"--{name}")
    t = sub.add_parser("train", parents=[filters])
    t.add_argument("train")
    for name in ("model", "importance", "oob", "samples", "m-try", "leaf", "cost", "rfweights", "dentropy", "adacost", "np", "unlabelled", "balance-by", "shuffle"):
        t.add_argument(f"--{name}")
    for name in ("balance", "no-bag", "impute", "permute", "extra", "vet", "unseen", "force", "split-missing", "l1", "density", "entropy", "hellinger", "ordinal", "adaboost", "test", "contrasts"):
        t.add_argument(f"--{name}", action="store_true")
    for name, kind, default in (("trees", int, 100), ("depth", int, 0), ("seed", int, 1), ("ace", int, 0), ("cutoff", float, None), ("gbt", float, 0.0), ("np-alpha", float, 0.1), ("np-kappa", float, 100.0), ("trans-alpha", float, 10.0), ("trans-beta", float, 0.0)):
        t.add_argument(f"--{name}", type=kind, default=default)
    a = sub.add_parser("score")
    for name in ("data", "model"):
        a.add_argument(name)
    for name in ("out", "votes"):
        a.add_argument(f"--{name}")
    for name in ("sum", "expit", "mean", "mode"):
        a.add_argument(f"--{name}", action="store_true")
    p = sub.add_parser("proximity")
    for name in ("data", "model"):
        p.add_argument(name)
    for name in ("out", "members", "branches"):
        p.add_argument(f"--{name}")
    f = sub.add_parser("folds", parents=[filters])
    for name in ("data", "out"):
        f.add_argument(name)
    f.add_argument("--folds", type=int, default=5)
    f.add_argument("--seed", type=int, default=1)
    f.add_argument("--suffix", default=".afm")
    f.add_argument("--most-categories", type=int)
    f.add_argument("--stratify", action="store_true")
    c = sub.add_parser("convert", parents=[filters])
    for name in ("data", "out"):
        c.add_argument(name)
    c.add_argument("--anonymous", action="store_true")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None):
    args = parser().parse_args(argv)
    run = {"train": train, "score": apply, "proximity": proximity, "folds": folds, "convert": convert}[args.command]
    return run(spark or SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    print(json.dumps({"done": main() is not None}))
