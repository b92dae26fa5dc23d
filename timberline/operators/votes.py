"""How the votes of a case become its prediction: mergeable parts over a case's votes and what is made of them.

A vote is a row (case_id, pred, weight). Parts are Spark aggregates, so each task combines its own votes before the shuffle, and the
same works on a stream. ``Vote`` can be subclassed: Mode, Mean and Sum are instances.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Vote:
    """``parts`` are aggregates by name, ``finish`` gets their columns. Rows where ``known`` isn't true don't vote."""

    def known(self) -> Column:
        return F.col("pred").isNotNull()

    def parts(self) -> dict[str, Column]:
        """All votes of a case, for what needs them one by one; a case has one for each tree."""
        return {"votes": F.collect_list(F.struct("pred", "weight"))}

    def finish(self, parts: dict[str, Column]) -> Column:
        raise NotImplementedError


class Numbers(Vote):
    """Votes that are numbers."""

    def number(self) -> Column:
        return F.expr("try_cast(pred as double)")

    def known(self) -> Column:
        return self.number().isNotNull()


@dataclass(frozen=True)
class Mode(Vote):
    """The class with the largest sum of weights (to nine places), of equals the smallest label."""

    def finish(self, parts):
        votes = parts["votes"]
        weight = lambda label: F.aggregate(F.filter(votes, lambda v: v["pred"] == label), F.lit(0.0), lambda a, v: a + v["weight"])
        sums = F.transform(F.array_distinct(F.transform(votes, lambda v: v["pred"])), lambda label: F.struct((-F.round(weight(label), 9)).alias("w"), label.alias("pred")))
        return F.array_min(sums)["pred"]


@dataclass(frozen=True)
class Mean(Numbers):
    """The weighted mean."""

    def parts(self):
        return {"sum": F.sum(self.number() * F.col("weight")), "weight": F.sum("weight")}

    def finish(self, parts):
        return parts["sum"] / parts["weight"]


@dataclass(frozen=True)
class Sum(Numbers):
    """The weighted sum and an intercept, as a probability if asked."""

    intercept: float = 0.0
    expit: bool = False

    def parts(self):
        return {"sum": F.sum(self.number() * F.col("weight"))}

    def finish(self, parts):
        total = parts["sum"] + self.intercept
        return (F.tanh(total / 2) + 1) / 2 if self.expit else total


def tally(votes: DataFrame, vote: Vote) -> DataFrame:
    """case_id, pred of the cases with any vote, of a table or a stream of votes."""
    parts = vote.parts()
    sums = votes.filter(vote.known()).groupBy("case_id").agg(*[e.alias(f"_{k}") for k, e in parts.items()])
    return sums.select("case_id", vote.finish({k: F.col(f"_{k}") for k in parts}).alias("pred"))
