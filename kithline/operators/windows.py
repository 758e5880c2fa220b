"""Per-group analytics over candidate pairs (q, s1, value).

Ties are broken by id: the best s1 of a q by value descending, s1 ascending; the
best q of an s1 by value descending, q ascending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_q(value: str) -> Window:
    return Window.partitionBy("q").orderBy(F.col(value).desc_nulls_last(), "s1")


def per_s1(value: str) -> Window:
    return Window.partitionBy("s1").orderBy(F.col(value).desc_nulls_last(), "q")


def with_margins(pairs: DataFrame, values: list[str]) -> DataFrame:
    """Adds <value>_margin for each value: what it is above the best other of the q (a lone one keeps its value; null is 0).

    All values share one exchange on q and two passes over a group, and nothing is sorted by value.
    """
    w = Window.partitionBy("q")
    value = {v: F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values}
    out = pairs.withColumns({f"_m_{v}": F.max(x).over(w) for v, x in value.items()})
    top = {v: x == F.col(f"_m_{v}") for v, x in value.items()}
    out = out.withColumns({f"_n_{v}": F.sum(t.cast("int")).over(w) for v, t in top.items()} | {f"_s_{v}": F.max(F.when(~top[v], x)).over(w) for v, x in value.items()})
    lone = lambda v: top[v] & (F.col(f"_n_{v}") == 1)
    margins = {f"{v}_margin": x - F.when(lone(v), F.coalesce(f"_s_{v}", F.lit(0.0))).otherwise(F.col(f"_m_{v}")) for v, x in value.items()}
    return out.withColumns(margins).drop(*[f"_{k}_{v}" for v in values for k in "mns"])


def top2(pairs: DataFrame, group: str = "s1", member: str = "q", value: str = "p") -> DataFrame:
    """The best and second member of each group; -1 where there is none."""
    w = Window.partitionBy(group).orderBy(F.desc(value), member)
    ranked = pairs.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    pick = lambda i: F.coalesce(F.max(F.when(F.col("_rn") == i, F.col(member))), F.lit(-1).cast("long"))
    return ranked.groupBy(group).agg(pick(1).alias("best"), pick(2).alias("second"))


def rank_first(pairs: DataFrame, value: str = "p") -> DataFrame:
    """Ranks of the pair among its q's and its s1's pairs."""
    return pairs.withColumn("q_rank", F.row_number().over(per_q(value))).withColumn("s1_rank", F.row_number().over(per_s1(value)))


def graph_features(pairs: DataFrame, q_src: Column | None = None) -> DataFrame:
    """Neighbourhood aggregates of each pair (q, s1, p): first all windows over q, then all over s1."""
    q_src = q_src if q_src is not None else (F.col("q") % 2 + 2)
    q, s = Window.partitionBy("q"), Window.partitionBy("s1")
    out = with_margins(pairs, ["p"]).withColumnRenamed("p_margin", "p1_q_margin")
    out = out.withColumn("p1_q_sum", F.sum("p").over(q)).withColumn("p1_q_rank", F.row_number().over(per_q("p")))
    own = F.when(F.col("p1_q_margin") >= 0, F.col("p")).otherwise(0.0)
    out = out.withColumn("_own", own).withColumn("_src", q_src)
    out = out.withColumn("s1_psum", F.sum("p").over(s)).withColumn("s1_own_sum", F.sum("_own").over(s)).withColumn("s1_pmax", F.max("p").over(s))
    out = out.withColumn("s1_n_hi", F.sum((F.col("p") > 0.5).cast("int")).over(s)).withColumn("s1_prank", F.row_number().over(per_s1("p")))
    for k in (2, 3):
        out = out.withColumn(f"s1_own_src{k}", F.sum(F.when(F.col("_src") == k, F.col("_own")).otherwise(0.0)).over(s))
    out = out.withColumn("p1_rel_s1max", F.col("p") / F.greatest("s1_pmax", F.lit(1e-6)))
    other = lambda c: F.when(F.col("s1_prank") == 1, F.max(F.when(F.col("s1_prank") == 2, F.col(c))).over(s)).otherwise(F.max(F.when(F.col("s1_prank") == 1, F.col(c))).over(s))
    return out.withColumn("anchor_q", other("q")).withColumn("anchor_p1", other("p")).drop("_own", "_src")

