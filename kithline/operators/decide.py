"""Decision rules: which record belongs to which entity, at most one owner a record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import per_q, per_s1

GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))


def best_per_q(pairs: DataFrame, value: str = "p") -> DataFrame:
    return pairs.withColumn("_rn", F.row_number().over(per_q(value))).where("_rn = 1").drop("_rn")


def threshold(pairs: DataFrame, t: float) -> DataFrame:
    """Each q's best s1, if its probability is t or more."""
    return best_per_q(pairs).where(F.col("p") >= t)


def expected_f(pairs: DataFrame, alpha: float = 1.0) -> DataFrame:
    """The rows that maximise each s1's expected F0.5 over its candidates; none where emptiness is likelier."""
    sharp = pairs.withColumn("_p", F.pow(F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6)), F.lit(float(alpha))))
    totals = sharp.groupBy("s1").agg(F.sum("_p").alias("_true"), F.exp(F.sum(F.log1p(-F.col("_p")))).alias("_none"))
    order = per_s1("_p")
    own = best_per_q(sharp, "_p").withColumn("k", F.row_number().over(order))
    own = own.withColumn("_cum", F.sum("_p").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.join(totals, "s1").withColumn("ef", 1.25 * F.col("_cum") / (0.25 * F.col("_true") + F.col("k")))
    top = own.groupBy("s1").agg(F.max(F.struct(F.col("ef"), (-F.col("k")).alias("m"))).alias("_top"))
    kept = own.join(top, "s1").where((F.col("_top.ef") > F.col("_none")) & (F.col("k") <= -F.col("_top.m")))
    return kept.select("q", "s1", "p", "k", "ef")


def sweep(pairs: DataFrame, truth: DataFrame, spine: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """Macro F0.5 at each threshold of the grid; the assignment is made once."""
    from .evaluate import f05

    best = best_per_q(pairs)
    grid_df = F.explode(F.array(*[F.lit(t) for t in grid])).alias("t")
    n_true = truth.groupBy("s1").agg(F.count("*").alias("t_n"))
    marked = best.join(truth.select("q", F.col("s1").alias("_owner")), "q", "left").withColumn("_hit", F.coalesce((F.col("_owner") == F.col("s1")).cast("int"), F.lit(0)))
    counts = marked.select("s1", "p", "_hit", grid_df).where("p >= t").groupBy("t", "s1").agg(F.count("*").alias("p_n"), F.sum("_hit").alias("tp"))
    full = spine.select("s1", grid_df).join(n_true, "s1", "left").join(counts, ["t", "s1"], "left").na.fill(0, ["t_n", "p_n", "tp"])
    return full.groupBy("t").agg(F.avg(f05("t_n", "p_n", "tp")).alias("score"))


def by_country(pairs: DataFrame, spine: DataFrame, rules: dict[str, tuple[str, float]], default: tuple[str, float]) -> DataFrame:
    """Each s1's country has its own rule: ("threshold", t) or ("expected", alpha)."""
    placed = pairs.join(spine.select("s1", "country"), "s1")
    chosen = {c: rules.get(c, default) for c in rules}
    out = None
    for rule, value in sorted({default, *chosen.values()}):
        mine = F.col("country").isin([c for c, r in chosen.items() if r == (rule, value)])
        if (rule, value) == default:
            mine = mine | ~F.col("country").isin(list(chosen)) | F.col("country").isNull()
        kept = (threshold(pairs, value) if rule == "threshold" else expected_f(pairs, value)).select("q", "s1")
        kept = kept.join(placed.where(mine).select("q", "s1", "country"), ["q", "s1"])
        out = kept if out is None else out.unionByName(kept)
    return out


ALPHAS = (0.5, 0.75, 1.0, 1.5, 2.0)


def rules(pairs: DataFrame, truth: DataFrame, spine: DataFrame, grid: tuple[float, ...] = GRID, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """rule, value, score and chosen of every threshold of the grid and every alpha of the expected-F rule; chosen is the best (of equals the threshold, then the smaller value)."""
    from .evaluate import macro_f05

    out = sweep(pairs, truth, spine, grid).select(F.lit("threshold").alias("rule"), F.col("t").alias("value"), "score")
    for a in alphas:
        out = out.unionByName(macro_f05(spine, truth, expected_f(pairs, a)).select(F.lit("expected").alias("rule"), F.lit(float(a)).alias("value"), "score"))
    best = Window.partitionBy().orderBy(F.desc(F.round("score", 9)), F.desc("rule"), "value")  # a row for each rule
    return out.withColumn("chosen", F.row_number().over(best) == 1)
