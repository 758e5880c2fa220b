"""Pair features: both sides' records, scores, cosines, lengths, flags, margins and popularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import all_scores
from . import similarity
from .windows import with_margins

MARGINS = ("emb", "emb_name", "emb_addr", "name_tset", "core_tset", "sq_partial", "addr_tset", "nums_tset", "tfidf")


def joined(pairs: DataFrame, recs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the records' columns of both sides, prefixed q_ and s1_."""
    side = lambda p: recs.select(F.col("entity_id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return pairs.join(side("q"), "q").join(side("s1"), "s1")


def pairwise(both: DataFrame) -> DataFrame:
    """The fuzzy scores of joined pairs, all from one pass through Python; alt_tset is null without an alias."""
    return both.withColumn("_scores", all_scores()).select(*both.columns, "_scores.*")


def lengths(side: str) -> dict[str, Column]:
    nums = F.col(f"{side}_nums")
    return {
        f"{side}_name_len": F.length(f"{side}_name_n"), f"{side}_addr_len": F.length(f"{side}_addr_n"),
        f"{side}_nums_cnt": F.length(nums) - F.length(F.replace(nums, F.lit(" "), F.lit(""))) + (nums != "").cast("int"),
    }


def popularity(pairs: DataFrame, rank: str = "rank") -> DataFrame:
    """n_cand over q; s1_n_q and s1_n_top1 over s1."""
    q, s = Window.partitionBy("q"), Window.partitionBy("s1")
    return pairs.withColumn("n_cand", F.count("*").over(q)).withColumn("s1_n_q", F.count("*").over(s)).withColumn("s1_n_top1", F.sum((F.col(rank) == 1).cast("int")).over(s))


TEXT = ["name_n", "name_alt", "name_core", "name_sq", "addr_n", "nums", "src", "is_domain", "name_nonascii", "addr_empty"]


def full(pairs: DataFrame, recs: DataFrame) -> DataFrame:
    """All features of candidate pairs (q, s1, tfidf, rank, emb, emb_rank); texts and vectors are dropped at the end.

    recs are records with bag and vectors (similarity.encoded): the vectors of either side
    give emb_name and emb_addr, names and addresses the scores and the rarity features.
    """
    both = joined(pairs, recs, [*TEXT, "emb_name", "emb_addr"])
    both = both.withColumns({c: similarity.dot(F.col(f"q_{c}"), F.col(f"s1_{c}")) for c in ("emb_name", "emb_addr")}).drop(*[f"{p}_{c}" for p in ("q", "s1") for c in ("emb_name", "emb_addr")])
    out = pairwise(both).withColumns(lengths("q") | lengths("s1"))
    drop = [f"{p}_{c}" for p in ("q", "s1") for c in TEXT if (p, c) not in {("q", "src"), ("q", "is_domain"), ("q", "name_nonascii"), ("q", "addr_empty"), ("s1", "addr_empty")}]
    out = popularity(with_margins(out.drop(*drop), list(MARGINS)))
    return out.join(similarity.rarity(recs, pairs.select("q", "s1")), ["q", "s1"])


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in {"q", "s1", "label"}]
