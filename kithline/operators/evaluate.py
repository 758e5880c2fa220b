"""Metrics and diagnoses of a linkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f05(t: str, p: str, tp: str) -> Column:
    """F0.5 of counts; 1 where both sides are empty."""
    precision, recall = F.col(tp) / F.col(p), F.col(tp) / F.col(t)
    return F.when((F.col(t) == 0) & (F.col(p) == 0), 1.0).when(F.col(tp) == 0, 0.0).otherwise(1.25 * precision * recall / (0.25 * precision + recall))


def counts(spine: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """t_n, p_n and tp of every s1 of the spine."""
    n = lambda df, name: df.groupBy("s1").agg(F.count("*").alias(name))
    hits = pred.select("s1", "q").join(truth, ["s1", "q"])
    return spine.join(n(truth, "t_n"), "s1", "left").join(n(pred, "p_n"), "s1", "left").join(n(hits, "tp"), "s1", "left").na.fill(0, ["t_n", "p_n", "tp"])


def macro_f05(spine: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    return counts(spine, truth, pred).agg(F.avg(f05("t_n", "p_n", "tp")).alias("score"))


def macro_f05_sets(spine: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """The same from sets of ids, a second way to the metric."""
    sets = lambda df, name: df.groupBy("s1").agg(F.collect_set("q").alias(name))
    empty = F.array().cast("array<bigint>")
    both = spine.join(sets(truth, "t"), "s1", "left").join(sets(pred, "p"), "s1", "left").select("s1", F.coalesce("t", empty).alias("t"), F.coalesce("p", empty).alias("p"))
    sized = both.select("s1", F.size("t").alias("t_n"), F.size("p").alias("p_n"), F.size(F.array_intersect("t", "p")).alias("tp"))
    return sized.agg(F.avg(f05("t_n", "p_n", "tp")).alias("score"))


def score_by_country(spine: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    return counts(spine, truth, pred).groupBy("country").agg(F.round(F.avg(f05("t_n", "p_n", "tp")), 4).alias("score"))


def error_report(spine: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    c, single = counts(spine, truth, pred), F.col("t_n") == 0
    share = lambda cond, of: F.avg(F.when(of, cond.cast("double")))
    return c.groupBy("country").agg(
        F.avg(single.cast("double")).alias("singleton_share"), share(F.col("p_n") > 0, single).alias("singletons_wrong"),
        share(F.col("p_n") == 0, ~single).alias("matched_pred_empty"),
        F.avg(F.when(~single & (F.col("p_n") > 0), F.col("tp") / F.greatest("p_n", F.lit(1)))).alias("precision"),
        F.avg(F.when(~single, F.col("tp") / F.col("t_n"))).alias("recall"),
    )


def recall_of(truth: DataFrame, pairs: DataFrame, rank: str) -> DataFrame:
    """Share of true pairs among the candidates, at any rank, at 1 and at 3."""
    found = truth.join(pairs.select("q", "s1", rank), ["q", "s1"], "left")
    at = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return found.agg(at(F.col(rank).isNotNull()).alias("recall"), at(F.col(rank) <= 1).alias("recall_1"), at(F.col(rank) <= 3).alias("recall_3"))


def rank_histogram(truth: DataFrame, pairs: DataFrame, rank: str, most: int = 12) -> DataFrame:
    """Share of found true pairs at each rank, ranks over `most` together."""
    found = truth.join(pairs.select("q", "s1", rank), ["q", "s1"]).select(F.least(F.col(rank), F.lit(most)).alias("rank"))
    n = found.groupBy("rank").agg(F.count("*").alias("n"))
    return n.select("rank", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def missed(truth: DataFrame, pred: DataFrame, pairs: DataFrame, spine: DataFrame) -> DataFrame:
    """Counts of false negatives by country and reason."""
    lost = truth.join(pred.select("q", "s1"), ["q", "s1"], "left_anti")
    owner = pred.select("q", F.col("s1").alias("_to"))
    kinds = lost.join(pairs.select("q", "s1", F.lit(1).alias("_cand")), ["q", "s1"], "left").join(owner, "q", "left")
    kind = F.when(F.col("_cand").isNull(), "blocking_miss").when(F.col("_to").isNotNull(), "given_to_other").otherwise("below_threshold")
    return pivoted(kinds.select("s1", kind.alias("type")), spine, ["below_threshold", "blocking_miss", "given_to_other"])


def wrong(truth: DataFrame, pred: DataFrame, spine: DataFrame) -> DataFrame:
    """Counts of false positives by country and reason."""
    extra = pred.select("q", "s1").join(truth, ["q", "s1"], "left_anti").join(truth.select("q", F.lit(1).alias("_owned")).distinct(), "q", "left")
    kind = F.when(F.col("_owned").isNotNull(), "belongs_to_other").otherwise("matches_nothing")
    return pivoted(extra.select("s1", kind.alias("type")), spine, ["belongs_to_other", "matches_nothing"])


def pivoted(rows: DataFrame, spine: DataFrame, types: list[str]) -> DataFrame:
    return rows.join(spine, "s1").groupBy("country").pivot("type", types).count().na.fill(0)
