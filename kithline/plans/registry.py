"""Every query by name, next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as T
from ..operators import decide, evaluate, features, learn, similarity, windows
from ..sources import io
from . import oracle_text as D
from .fixtures import Tables, with_ctes

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}
MAX_DF = 0.05
_FULL = partial(with_ctes, extra=D.CTES, needs=D.NEEDS)


def query(name: str, ctes: str = "", sql: str | None = None) -> Callable:
    def keep(f: Callable[[Tables], DataFrame]) -> Callable:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = _FULL(ctes, sql) if ctes else sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for n, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches of each entity by expected F0.5, one row per entity."""
    t = Tables(spark, sf_dir)
    return io.id_lists(t.spine(), decide.expected_f(t.pairs(), 1.5))




def r6(c: str) -> Column:
    """Six digits, without a negative zero."""
    return F.when(F.abs(F.col(c)) < 5e-7, 0.0).otherwise(F.round(F.col(c), 6)).alias(c)



# ---- scans and sinks


@query("scan_tsv")
def _(t: Tables) -> DataFrame:
    path = io.shared_path(t.spark, "tsv")
    io.write_tsv(t.raw().select(F.col("entity_id").cast("string").alias("entity_id"), F.regexp_replace("business_name", "\\s", " ").alias("business_name"), F.regexp_replace("business_address", "\\s", " ").alias("business_address"), "country"), path)
    return io.read_tsv(t.spark, path)


@query("scan_multi_source", "raw", "select entity_id, country, src from raw")
def _(t: Tables) -> DataFrame:
    raw = t.raw()
    return io.union_sources(*(raw.where(F.col("src") == i).drop("src") for i in (1, 2, 3))).select("entity_id", "country", "src")


@query("scan_parquet_cols", "", "select l_orderkey, l_suppkey from lineitem")
def _(t: Tables) -> DataFrame:
    return t.table("lineitem").select("l_orderkey", "l_suppkey")


@query("scan_schema")
def _(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(c,) for c in features.feature_names(t.pairs())], "feature string")


@query("scan_batches")
def _(t: Tables) -> DataFrame:
    def sizes(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"rows": [len(b)]})

    return t.table("lineitem").select("l_orderkey").mapInPandas(sizes, "rows long")


@query("scan_filtered", "labelled", "select q, s1, p, label from labelled where p >= 0.9")
def _(t: Tables) -> DataFrame:
    return learn.with_label(t.pairs().where("p >= 0.9"), t.truth()).select("q", "s1", "p", "label")


@query("scan_embeddings", "vectors", "select entity_id, src, country, len(emb_name) as name_dim, len(emb_addr) as addr_dim from vectors")
def _(t: Tables) -> DataFrame:
    return t.vectors().select("entity_id", "src", "country", F.size("emb_name").cast("long").alias("name_dim"), F.size("emb_addr").cast("long").alias("addr_dim"))


@query("sink_parquet", "pairs", "select q, s1, p from pairs")
def _(t: Tables) -> DataFrame:
    return io.rewritten(t.pairs(), "pairs")


@query("append_columns", "margins", "select q, s1, p, case when abs(p_margin) < 0.0000005 then 0 else round(p_margin, 6) end as p_margin from margins")
def _(t: Tables) -> DataFrame:
    base = t.pairs()
    extra = windows.with_margins(base, ["p"]).select("q", "s1", r6("p_margin"))
    return io.append_columns(base, extra, ["q", "s1"])


@query("sink_id_lists", "spine pred", "select s.s1, coalesce(l, '') as matched_ids from spine s left join (select s1, string_agg(cast(q as varchar), ',' order by q) as l from pred group by s1) p on p.s1 = s.s1")
def _(t: Tables) -> DataFrame:
    return io.id_lists(t.spine(), decide.threshold(t.pairs(), 0.5))


@query("sink_metadata")
def _(t: Tables) -> DataFrame:
    path = io.shared_path(t.spark, "metadata")
    io.write_metadata(t.spark, path, {"rule": "threshold", "value": 0.5, "features": features.feature_names(t.pairs())})
    return t.spark.createDataFrame([(k, str(v)) for k, v in io.read_metadata(t.spark, path).items()], "key string, value string")


# ---- projections and filters


@query("filter_nonempty_explode", "spine pred", """select s1, cast(q as bigint) as q from (select s1, unnest(string_split(matched_ids, ',')) as q from (
    select s.s1, coalesce(l, '') as matched_ids from spine s left join (select s1, string_agg(cast(q as varchar), ',' order by q) as l from pred group by s1) p on p.s1 = s.s1)) where q <> ''""")
def _(t: Tables) -> DataFrame:
    lists = io.id_lists(t.spine(), decide.threshold(t.pairs(), 0.5))
    return io.truth_pairs(lists, "s1", "matched_ids").select("s1", F.col("q").cast("long").alias("q"))


@query("filter_band", "pairs", "select q, s1, p from pairs where p between 0.01 and 0.99")
def _(t: Tables) -> DataFrame:
    return learn.band(t.pairs())


@query("filter_country_in", "pairs spine", "select q, pairs.s1, p from pairs join spine on spine.s1 = pairs.s1 where country in ('EUROPE', 'ASIA')")
def _(t: Tables) -> DataFrame:
    inside = t.spine().where(F.col("country").isin("EUROPE", "ASIA"))
    return t.pairs().join(inside, "s1", "left_semi").select("q", "s1", "p")


@query("project_pair_text", "raw", "select entity_id, business_name || ' ; ' || business_address as text from raw")
def _(t: Tables) -> DataFrame:
    return t.raw().select("entity_id", F.concat("business_name", F.lit(" ; "), "business_address").alias("text"))


@query("project_lengths", "recs rpairs", """select q, s1, length(a.name_n) as q_name_len, length(a.addr_n) as q_addr_len, length(a.nums) - length(replace(a.nums, ' ', '')) + cast(a.nums <> '' as int) as q_nums_cnt,
    length(b.name_n) as s1_name_len, length(b.addr_n) as s1_addr_len, length(b.nums) - length(replace(b.nums, ' ', '')) + cast(b.nums <> '' as int) as s1_nums_cnt
    from rpairs join recs a on a.entity_id = q join recs b on b.entity_id = s1""")
def _(t: Tables) -> DataFrame:
    out = features.joined(t.record_pairs(), t.records(), ["name_n", "addr_n", "nums"]).withColumns(features.lengths("q") | features.lengths("s1"))
    return out.select("q", "s1", *[F.col(f"{s}_{c}").cast("long").alias(f"{s}_{c}") for s in ("q", "s1") for c in ("name_len", "addr_len", "nums_cnt")])


@query("project_flags", "recs rpairs", "select q, s1, a.src as q_src, a.is_domain as q_is_domain, a.name_nonascii as q_name_nonascii, a.addr_empty as q_addr_empty, b.addr_empty as s1_addr_empty from rpairs join recs a on a.entity_id = q join recs b on b.entity_id = s1")
def _(t: Tables) -> DataFrame:
    out = features.joined(t.record_pairs(), t.records(), ["src", "is_domain", "name_nonascii", "addr_empty"])
    return out.select("q", "s1", "q_src", "q_is_domain", "q_name_nonascii", "q_addr_empty", "s1_addr_empty")


_CE = "select q, s1, 1 - p as ce from pairs where p between 0.2 and 0.8"


@query("case_coalesce", "pairs", f"select pairs.q, pairs.s1, p, coalesce(ce, p) as ce_f from pairs left join ({_CE}) c on c.q = pairs.q and c.s1 = pairs.s1")
def _(t: Tables) -> DataFrame:
    pairs = t.pairs()
    scores = pairs.where("p between 0.2 and 0.8").select("q", "s1", (1 - F.col("p")).alias("ce"))
    return pairs.join(scores, ["q", "s1"], "left").select("q", "s1", "p", F.coalesce("ce", "p").alias("ce_f"))


@query("clip", "ranked", "select q, s1, greatest(least(p, 1 - cast(0.000001 as double)), cast(0.000001 as double)) as p, least(rank, 12) as rank from ranked")
def _(t: Tables) -> DataFrame:
    ranked = t.pairs().withColumn("rank", F.row_number().over(windows.per_q("p")))
    return ranked.select("q", "s1", F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6)).alias("p"), F.least("rank", F.lit(12)).cast("long").alias("rank"))


# ---- joins


@query("join_pairs_to_records", "raw rpairs", "select q, s1, a.business_name as q_business_name, b.business_name as s1_business_name, a.country as q_country, b.country as s1_country from rpairs join raw a on a.entity_id = q join raw b on b.entity_id = s1")
def _(t: Tables) -> DataFrame:
    return features.joined(t.record_pairs(), t.raw(), ["business_name", "country"]).select("q", "s1", "q_business_name", "s1_business_name", "q_country", "s1_country")


@query("join_truth_label", "labelled", "select q, s1, p, label from labelled")
def _(t: Tables) -> DataFrame:
    return learn.with_label(t.pairs(), t.truth()).select("q", "s1", "p", "label")


@query("join_inner_tp", "pred truth", "select pred.q, pred.s1 from pred join truth on truth.q = pred.q and truth.s1 = pred.s1")
def _(t: Tables) -> DataFrame:
    return decide.threshold(t.pairs(), 0.5).select("q", "s1").join(t.truth(), ["q", "s1"])


@query("join_left_recall", "truth ranked", """select avg(cast(rank is not null as double)) as recall, avg(cast(coalesce(rank <= 1, false) as double)) as recall_1, avg(cast(coalesce(rank <= 3, false) as double)) as recall_3
    from truth left join ranked on ranked.q = truth.q and ranked.s1 = truth.s1""")
def _(t: Tables) -> DataFrame:
    return evaluate.recall_of(t.truth(), t.pairs().withColumn("rank", F.row_number().over(windows.per_q("p"))), "rank")


@query("join_indicator", "truth pred", "select truth.q, truth.s1, pred.q is not null as found from truth left join pred on pred.q = truth.q and pred.s1 = truth.s1")
def _(t: Tables) -> DataFrame:
    pred = decide.threshold(t.pairs(), 0.5).select("q", "s1", F.lit(True).alias("_f"))
    return t.truth().join(pred, ["q", "s1"], "left").select("q", "s1", F.col("_f").isNotNull().alias("found"))


@query("join_left_anti", "truth pred", "select q, s1 from truth where not exists (select 1 from pred where pred.q = truth.q and pred.s1 = truth.s1)")
def _(t: Tables) -> DataFrame:
    return t.truth().join(decide.threshold(t.pairs(), 0.5), ["q", "s1"], "left_anti")


@query("join_semi", "truth pred", "select q, s1 from truth where s1 in (select s1 from pred)")
def _(t: Tables) -> DataFrame:
    return t.truth().join(decide.threshold(t.pairs(), 0.5), "s1", "left_semi").select("q", "s1")


@query("join_semi_existence", "truth pred", "select pred.q, pred.s1, exists (select 1 from truth where truth.q = pred.q) as owned from pred")
def _(t: Tables) -> DataFrame:
    owned = t.truth().select("q", F.lit(True).alias("_o")).distinct()
    return decide.threshold(t.pairs(), 0.5).join(owned, "q", "left").select("q", "s1", F.col("_o").isNotNull().alias("owned"))


@query("join_map_lookup", "spine pred", "select spine.s1, coalesce(n, 0) as n from spine left join (select s1, count(*) as n from pred group by s1) p on p.s1 = spine.s1")
def _(t: Tables) -> DataFrame:
    n = decide.threshold(t.pairs(), 0.5).groupBy("s1").agg(F.count("*").alias("n"))
    return t.spine().join(n, "s1", "left").select("s1", F.coalesce("n", F.lit(0)).alias("n"))


@query("join_reindex_all", "counts", "select s1, country, cast(t_n as bigint) as t_n, cast(p_n as bigint) as p_n, cast(tp as bigint) as tp from counts")
def _(t: Tables) -> DataFrame:
    return evaluate.counts(t.spine(), t.truth(), decide.threshold(t.pairs(), 0.5))


# ---- aggregations


@query("agg_doc_freq", "recs", "select country, token, count(*) as df from (select distinct country, entity_id, unnest(list_filter(string_split(name_n, ' '), lambda x: x <> '')) as token from recs) group by country, token")
def _(t: Tables) -> DataFrame:
    return similarity.document_frequency(t.records())


@query("agg_count_by", "raw", "select country, src, count(*) as n from raw group by country, src")
def _(t: Tables) -> DataFrame:
    return t.raw().groupBy("country", "src").agg(F.count("*").alias("n"))


_HIST = "select rank, round(n / sum(n) over (), 6) as share from (select least(rank, 12) as rank, count(*) as n from truth join ranked on ranked.q = truth.q and ranked.s1 = truth.s1 group by 1)"


def _histogram(t: Tables) -> DataFrame:
    ranked = t.pairs().withColumn("rank", F.row_number().over(windows.per_q("p")).cast("long"))
    return evaluate.rank_histogram(t.truth(), ranked, "rank").select(F.col("rank").cast("long").alias("rank"), r6("share"))


query("agg_value_share", "truth ranked", _HIST)(_histogram)


@query("agg_concat", "pred", "select s1, string_agg(cast(q as varchar), ',' order by q) as qs from pred group by s1")
def _(t: Tables) -> DataFrame:
    pred = decide.threshold(t.pairs(), 0.5)
    return io.id_lists(pred.select("s1").distinct(), pred, "qs")


@query("agg_mean_by_country", "counts", "select country, round(avg(p_n), 6) as mean_n, round(avg(cast(p_n = 0 as double)), 6) as empty_share from counts group by country")
def _(t: Tables) -> DataFrame:
    c = evaluate.counts(t.spine(), t.truth(), decide.threshold(t.pairs(), 0.5))
    return c.groupBy("country").agg(F.round(F.avg("p_n"), 6).alias("mean_n"), F.round(F.avg((F.col("p_n") == 0).cast("double")), 6).alias("empty_share"))


_FN = """select country, count(*) filter (type = 'below_threshold') as below_threshold, count(*) filter (type = 'blocking_miss') as blocking_miss, count(*) filter (type = 'given_to_other') as given_to_other from (
    select truth.s1, case when c.q is null then 'blocking_miss' when o.q is not null then 'given_to_other' else 'below_threshold' end as type from truth
    left join pairs c on c.q = truth.q and c.s1 = truth.s1 left join pred o on o.q = truth.q
    where not exists (select 1 from pred x where x.q = truth.q and x.s1 = truth.s1)) l join spine on spine.s1 = l.s1 group by country"""


def _fn_types(t: Tables) -> DataFrame:
    pairs = t.pairs().where("p >= 0.1")
    return evaluate.missed(t.truth(), decide.threshold(pairs, 0.5), pairs, t.spine())


for _name in ("agg_pivot_errors", "diag_fn_types"):
    query(_name, "spine truth pred pairs", _FN.replace("left join pairs c on", "left join (select * from pairs where p >= 0.1) c on"))(_fn_types)


@query("agg_median_profile", "labelled", "select label, round(median(p), 6) as median_p from labelled group by label")
def _(t: Tables) -> DataFrame:
    return learn.with_label(t.pairs(), t.truth()).groupBy("label").agg(F.round(F.median("p"), 6).alias("median_p"))


@query("agg_sum_p", "pairs", "select s1, round(sum(p), 6) as e_true from pairs group by s1")
def _(t: Tables) -> DataFrame:
    return t.pairs().groupBy("s1").agg(F.round(F.sum("p"), 6).alias("e_true"))


@query("agg_product_none", "pairs", "select q, round(exp(sum(ln(1 - least(p, 1 - cast(0.000001 as double))))), 6) as p_none from pairs group by q")
def _(t: Tables) -> DataFrame:
    return t.pairs().groupBy("q").agg(F.round(F.exp(F.sum(F.log1p(-F.least("p", F.lit(1 - 1e-6))))), 6).alias("p_none"))


@query("agg_argmax", "pairs", "select s1, q as best_q from (select *, row_number() over (partition by s1 order by p desc, q) as rn from pairs) where rn = 1")
def _(t: Tables) -> DataFrame:
    return t.pairs().groupBy("s1").agg(F.max_by("q", F.struct("p", -F.col("q"))).alias("best_q"))


_CLIP = "least(greatest(p, cast(0.000001 as double)), 1 - cast(0.000001 as double))"


@query("agg_logloss", "labelled", f"select round(-avg(label * ln({_CLIP}) + (1 - label) * ln(1 - {_CLIP})), 6) as logloss from labelled")
def _(t: Tables) -> DataFrame:
    return learn.with_label(t.pairs(), t.truth()).agg(F.round(learn.logloss(F.col("p"), F.col("label")), 6).alias("logloss"))


@query("agg_global_rates", "labelled", "select round(avg(cast(label as double)), 6) as positives, round(count(*) / count(distinct q), 6) as pairs_per_q from labelled")
def _(t: Tables) -> DataFrame:
    return learn.with_label(t.pairs(), t.truth()).agg(F.round(F.avg(F.col("label").cast("double")), 6).alias("positives"), F.round(F.count("*") / F.countDistinct("q"), 6).alias("pairs_per_q"))


# ---- windows


@query("win_margin", "margins", "select q, s1, case when abs(p_margin) < 0.0000005 then 0 else round(p_margin, 6) end as p_margin from margins")
def _(t: Tables) -> DataFrame:
    return windows.with_margins(t.pairs(), ["p"]).select("q", "s1", r6("p_margin"))


@query("win_top2", "pairs", """select s1, coalesce(max(case when rn = 1 then q end), -1) as best, coalesce(max(case when rn = 2 then q end), -1) as second
    from (select *, row_number() over (partition by s1 order by p desc, q) as rn from pairs) where rn <= 2 group by s1""")
def _(t: Tables) -> DataFrame:
    return windows.top2(t.pairs())


@query("win_rank_first", "pairs", "select q, s1, row_number() over (partition by q order by p desc, s1) as q_rank, row_number() over (partition by s1 order by p desc, q) as s1_rank from pairs")
def _(t: Tables) -> DataFrame:
    return windows.rank_first(t.pairs()).select("q", "s1", F.col("q_rank").cast("long").alias("q_rank"), F.col("s1_rank").cast("long").alias("s1_rank"))


@query("win_cumcount", "best", "select q, s1, row_number() over (partition by s1 order by p desc, q) as k from best")
def _(t: Tables) -> DataFrame:
    return decide.best_per_q(t.pairs()).select("q", "s1", F.row_number().over(windows.per_s1("p")).cast("long").alias("k"))


@query("win_cumsum", "best", "select q, s1, round(sum(p) over (partition by s1 order by p desc, q rows between unbounded preceding and current row), 6) as cum from best")
def _(t: Tables) -> DataFrame:
    w = windows.per_s1("p").rowsBetween(Window.unboundedPreceding, 0)
    return decide.best_per_q(t.pairs()).select("q", "s1", F.round(F.sum("p").over(w), 6).alias("cum"))


_BY = {"q": "(partition by q)", "s": "(partition by s1)"}


@query("win_size", "pairs", f"select q, s1, count(*) over {_BY['q']} as n_cand, count(*) over {_BY['s']} as s1_n_q from pairs")
def _(t: Tables) -> DataFrame:
    return t.pairs().select("q", "s1", F.count("*").over(Window.partitionBy("q")).alias("n_cand"), F.count("*").over(Window.partitionBy("s1")).alias("s1_n_q"))


@query("win_cond_sum", "ranked", f"select q, s1, cast(sum(cast(rank = 1 as int)) over {_BY['s']} as bigint) as s1_n_top1, cast(sum(cast(p > 0.5 as int)) over {_BY['s']} as bigint) as s1_n_hi from ranked")
def _(t: Tables) -> DataFrame:
    out = windows.graph_features(features.popularity(t.pairs().withColumn("rank", F.row_number().over(windows.per_q("p")))))
    return out.select("q", "s1", "s1_n_top1", "s1_n_hi")


@query("win_group_sum", "pairs", f"select q, s1, round(sum(p) over {_BY['q']}, 6) as p1_q_sum, round(sum(p) over {_BY['s']}, 6) as s1_psum from pairs")
def _(t: Tables) -> DataFrame:
    return windows.graph_features(t.pairs()).select("q", "s1", r6("p1_q_sum"), r6("s1_psum"))


@query("win_group_max", "pairs", f"select q, s1, max(p) over {_BY['s']} as s1_pmax, round(p / greatest(max(p) over {_BY['s']}, cast(0.000001 as double)), 6) as p1_rel_s1max from pairs")
def _(t: Tables) -> DataFrame:
    return windows.graph_features(t.pairs()).select("q", "s1", "s1_pmax", r6("p1_rel_s1max"))


_OWN = f"""select q, s1, round(sum(own) over {_BY['s']}, 6) as s1_own_sum, round(sum(case when q % 2 + 2 = 2 then own else 0 end) over {_BY['s']}, 6) as s1_own_src2,
    round(sum(case when q % 2 + 2 = 3 then own else 0 end) over {_BY['s']}, 6) as s1_own_src3 from (select *, case when p_margin >= 0 then p else 0 end as own from margins)"""


@query("win_own_sum", "margins", _OWN)
def _(t: Tables) -> DataFrame:
    return windows.graph_features(t.pairs()).select("q", "s1", r6("s1_own_sum"), r6("s1_own_src2"), r6("s1_own_src3"))


_ANCHOR = """select *, case when pr = 1 then max(case when pr = 2 then q end) over (partition by s1) else max(case when pr = 1 then q end) over (partition by s1) end as anchor_q,
    case when pr = 1 then max(case when pr = 2 then p end) over (partition by s1) else max(case when pr = 1 then p end) over (partition by s1) end as anchor_p1
    from (select *, row_number() over (partition by s1 order by p desc, q) as pr from pairs)"""


@query("win_anchor", "pairs", f"select q, s1, anchor_q, anchor_p1 from ({_ANCHOR})")
def _(t: Tables) -> DataFrame:
    return windows.graph_features(t.pairs()).select("q", "s1", "anchor_q", "anchor_p1")


@query("win_graph_features", "margins pairs ranked", f"""select a.q, a.s1, round(a.p, 6) as p, round(m.p_margin, 6) as p1_q_margin, round(sum(a.p) over (partition by a.q), 6) as p1_q_sum, r.rank as p1_q_rank,
    round(sum(a.p) over (partition by a.s1), 6) as s1_psum, o.s1_own_sum, max(a.p) over (partition by a.s1) as s1_pmax, cast(sum(cast(a.p > 0.5 as int)) over (partition by a.s1) as bigint) as s1_n_hi,
    pr as s1_prank, o.s1_own_src2, o.s1_own_src3, round(a.p / greatest(max(a.p) over (partition by a.s1), cast(0.000001 as double)), 6) as p1_rel_s1max, anchor_p1
    from ({_ANCHOR}) a join margins m on m.q = a.q and m.s1 = a.s1 join ranked r on r.q = a.q and r.s1 = a.s1 join ({_OWN}) o on o.q = a.q and o.s1 = a.s1""")
def _(t: Tables) -> DataFrame:
    g = windows.graph_features(t.pairs())
    return g.select(
        "q", "s1", r6("p"), r6("p1_q_margin"), r6("p1_q_sum"), F.col("p1_q_rank").cast("long").alias("p1_q_rank"), r6("s1_psum"), r6("s1_own_sum"), "s1_pmax", "s1_n_hi",
        F.col("s1_prank").cast("long").alias("s1_prank"), r6("s1_own_src2"), r6("s1_own_src3"), r6("p1_rel_s1max"), "anchor_p1",
    )


# ---- sorts, limits, top-k


@query("topk_per_group", "ranked", "select q, s1, rank from ranked where rank <= 2")
def _(t: Tables) -> DataFrame:
    return t.pairs().withColumn("rank", F.row_number().over(windows.per_q("p"))).where("rank <= 2").select("q", "s1", F.col("rank").cast("long").alias("rank"))


@query("best_per_q", "best", "select q, s1, p from best")
def _(t: Tables) -> DataFrame:
    return decide.best_per_q(t.pairs())


@query("sort_pairs", "pairs", "select q, s1, p from pairs order by q, p desc, s1")
def _(t: Tables) -> DataFrame:
    return t.pairs().orderBy("q", F.desc("p"), "s1")


@query("limit_n", "pairs", "select q, s1, p from pairs order by p desc, q, s1 limit 100")
def _(t: Tables) -> DataFrame:
    return t.pairs().orderBy(F.desc("p"), "q", "s1").limit(100)


@query("sample_fixed_n")
def _(t: Tables) -> DataFrame:
    return t.pairs().orderBy(F.xxhash64("q", "s1", F.lit(42)), "q", "s1").limit(500)


# ---- text vectors and similarity joins


def _bag(t: Tables) -> DataFrame:
    return similarity.bag(similarity.core_names(t.records(), MAX_DF))


@query("tok_record", "bag", "select entity_id, array_to_string(tokens, ',') as tokens from bag")
def _(t: Tables) -> DataFrame:
    return _bag(t).select("entity_id", F.array_join("tokens", ",").alias("tokens"))


@query("tfidf_block", "weights", "select country, entity_id, token, round(w, 6) as w from weights")
def _(t: Tables) -> DataFrame:
    return similarity.tfidf(_bag(t), F.col("tokens"), MAX_DF).select("country", "entity_id", "token", r6("w"))


def _sparse(t: Tables, k: int = 8) -> DataFrame:
    return similarity.sparse_topk(similarity.term_vectors(_bag(t), F.col("tokens"), MAX_DF), k)


@query("join_sparse_topk", "sparse", "select q, s1, round(tfidf, 6) as tfidf, rank from sparse")
def _(t: Tables) -> DataFrame:
    return _sparse(t).select("q", "s1", r6("tfidf"), F.col("rank").cast("long").alias("rank"))


def _blocked(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of both searches, and the records with bag and vectors they come from."""
    recs = io.rewritten(similarity.encoded(_bag(t)), "records")
    return similarity.block(recs, MAX_DF, vectors=recs), recs


@query("block_country", "blocked", D.BLOCK)
def _(t: Tables) -> DataFrame:
    pairs, _ = _blocked(t)
    return pairs.select("q", "s1", r6("tfidf"), F.col("rank").cast("long").alias("rank"), F.round("emb", 5).alias("emb"), F.col("emb_rank").cast("long").alias("emb_rank"))


@query("rowwise_tfidf_dot", "weights rpairs", "select rpairs.q, rpairs.s1, round(coalesce(d, 0), 6) as tfidf from rpairs left join (select p.q, p.s1, sum(a.w * b.w) as d from rpairs p join weights a on a.entity_id = p.q join weights b on b.entity_id = p.s1 and a.token = b.token group by p.q, p.s1) x on x.q = rpairs.q and x.s1 = rpairs.s1")
def _(t: Tables) -> DataFrame:
    weights = similarity.tfidf(_bag(t), F.col("tokens"), MAX_DF)
    return similarity.pair_dot(t.record_pairs(), weights, "tfidf").select("q", "s1", r6("tfidf"))


def _dense(t: Tables) -> DataFrame:
    return similarity.dense_topk(t.vectors()).select("q", "s1", F.round("emb", 5).alias("emb"), F.col("emb_rank").cast("long").alias("emb_rank"))


for _name in ("join_dense_topk", "topk_dense"):
    query(_name, "vectors", D.DENSE)(_dense)


def _vector_pairs(t: Tables) -> DataFrame:
    v = t.vectors()
    q = v.where("src > 1").select(F.col("entity_id").alias("q"), F.col("emb_name").alias("qn"), F.col("emb_addr").alias("qa"))
    s = v.where("src = 1").select(F.col("entity_id").alias("s1"), F.col("emb_name").alias("sn"), F.col("emb_addr").alias("sa"))
    return q.withColumn("s1", F.col("q") - F.col("q") % 3).join(s, "s1")


@query("combined_cosine", "vectors", D.COMBINED)
def _(t: Tables) -> DataFrame:
    return _vector_pairs(t).select("q", "s1", F.round(similarity.combined_cosine(*(F.col(c) for c in ("qn", "qa", "sn", "sa"))), 5).alias("cosine"))


@query("rowwise_cosine", "vectors", D.ROWWISE)
def _(t: Tables) -> DataFrame:
    return _vector_pairs(t).select("q", "s1", F.round(similarity.dot(F.col("qn"), F.col("sn")), 6).alias("emb_name"), F.round(similarity.dot(F.col("qa"), F.col("sa")), 6).alias("emb_addr"))


def _idf(tokens: Callable, name: str) -> Callable:
    def run(t: Tables) -> DataFrame:
        recs = t.records()
        return similarity.pair_dot(t.record_pairs(), similarity.tfidf(recs, tokens()), name).select("q", "s1", r6(name))

    return run


for _name, _of, _tokens in (
    ("addr_idf", "idf_addr_word", lambda: T.words(F.col("addr_n"))), ("name_idf", "idf_name_word", lambda: T.words(F.col("name_n"))), ("name_cidf", "idf_name_char", lambda: T.word_trigrams(F.col("name_n"))),
):
    query(_of, f"{_name} rpairs", f"select q, s1, round({_name}, 6) as {_name} from {_name}")(_idf(_tokens, _name))


@query("idf_margins", "rarity", "select q, s1, case when abs(addr_idf_margin) < 0.0000005 then 0 else round(addr_idf_margin, 6) end as addr_idf_margin, case when abs(name_idf_margin) < 0.0000005 then 0 else round(name_idf_margin, 6) end as name_idf_margin, case when abs(name_cidf_margin) < 0.0000005 then 0 else round(name_cidf_margin, 6) end as name_cidf_margin from rarity")
def _(t: Tables) -> DataFrame:
    return similarity.rarity(t.records(), t.record_pairs()).select("q", "s1", r6("addr_idf_margin"), r6("name_idf_margin"), r6("name_cidf_margin"))


@query("same_name_count", "same rpairs", "select q, s1, q_same_name, s1_same_name from same")
def _(t: Tables) -> DataFrame:
    return similarity.same_name(t.records(), t.record_pairs()).select("q", "s1", "q_same_name", "s1_same_name")


@query("rarity_features", "rarity same", """select rarity.q, rarity.s1, round(addr_idf, 6) as addr_idf, round(name_idf, 6) as name_idf, round(name_cidf, 6) as name_cidf, case when abs(addr_idf_margin) < 0.0000005 then 0 else round(addr_idf_margin, 6) end as addr_idf_margin,
    case when abs(name_idf_margin) < 0.0000005 then 0 else round(name_idf_margin, 6) end as name_idf_margin, case when abs(name_cidf_margin) < 0.0000005 then 0 else round(name_cidf_margin, 6) end as name_cidf_margin, q_same_name, s1_same_name from rarity join same on same.q = rarity.q and same.s1 = rarity.s1""")
def _(t: Tables) -> DataFrame:
    out = similarity.rarity(t.records(), t.record_pairs())
    return out.select("q", "s1", *[r6(c + m) for c in ("addr_idf", "name_idf", "name_cidf") for m in ("", "_margin")], "q_same_name", "s1_same_name")


_SHOWN = lambda c: f"array_to_string(list_transform({c}, lambda x: cast(cast(round(cast(x as double) * 100000) as bigint) as varchar)), ',')"


@query("embed_text", "encoded", f"select entity_id, {_SHOWN('emb_name')} as emb_name, {_SHOWN('emb_addr')} as emb_addr from encoded")
def _(t: Tables) -> DataFrame:
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.round(x.cast("double") * 100000).cast("long").cast("string")), ",").alias(c)
    return similarity.encoded(t.records()).select("entity_id", shown("emb_name"), shown("emb_addr"))


@query("blocking_recall", "sparse raw", """select country, round(avg(cast(rank is not null as double)), 6) as recall, round(avg(cast(coalesce(rank <= 1, false) as double)), 6) as recall_1
    from (select a.entity_id as q, b.entity_id as s1, a.country from raw a join raw b on b.entity_id = a.entity_id - a.entity_id % 3 and a.src > 1 and b.country = a.country) t left join sparse on sparse.q = t.q and sparse.s1 = t.s1 group by country""")
def _(t: Tables) -> DataFrame:
    raw = t.raw().select("entity_id", "src", "country")
    truth = raw.where("src > 1").select(F.col("entity_id").alias("q"), "country", (F.col("entity_id") - F.col("entity_id") % 3).alias("s1"))
    truth = truth.join(raw.select(F.col("entity_id").alias("s1"), "country"), ["s1", "country"], "left_semi")
    found = truth.join(_sparse(t), ["q", "s1"], "left")
    at = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return found.groupBy("country").agg(at(F.col("rank").isNotNull()).alias("recall"), at(F.col("rank") <= 1).alias("recall_1"))


# ---- scalar functions


def _scalar(name: str, expression: Callable, sql: str) -> None:
    query(name, "raw", f"select entity_id, {sql} as value from raw")(lambda t: t.raw().select("entity_id", expression().alias("value")))


_given, _place = (lambda: F.col("business_name")), (lambda: F.col("business_address"))
_scalar("fn_ascii_lower", lambda: T.fold(_given()), D.fold("business_name"))
_scalar("fn_norm_tokens", lambda: T.normalized(_given()), D.normalized("business_name"))
_scalar("fn_token_map", lambda: F.array_join(F.transform(F.split(T.fold(_given()), " "), lambda w: F.coalesce(F.try_element_at(T._map(T.TOKEN_MAP), w), w)), " "), f"array_to_string(list_transform(string_split({D.fold('business_name')}, ' '), lambda w: {D.mapped('w')}), ' ')")
_scalar("fn_addr_drop", lambda: T.normalized(_place(), T.ADDRESS_FILLERS), D.normalized("business_address", T.ADDRESS_FILLERS))
_scalar("fn_strip_zeros", lambda: T.strip_zeros(F.element_at(F.split(_place(), " "), -1)), D.strip_zeros("string_split(business_address, ' ')[-1]"))
_ALIASED = "business_name || case when entity_id % 3 = 0 then ' d/b/a ' || business_address when entity_id % 3 = 1 then ' formerly ' else '' end"
_scalar("fn_alias_dba", lambda: T.alias(F.expr("concat(business_name, case when entity_id % 3 = 0 then concat(' d/b/a ', business_address) when entity_id % 3 = 1 then ' formerly ' else '' end)")), D.alias(f"({_ALIASED})"))
_scalar("fn_is_domain", lambda: T.is_domain(F.concat(F.element_at(F.split(_given(), " "), 1), F.when(F.col("entity_id") % 2 == 0, ".com").otherwise(""))), D.is_domain("(string_split(business_name, ' ')[1] || case when entity_id % 2 = 0 then '.com' else '' end)"))
_scalar("fn_nums", lambda: T.numbers(_place()), D.numbers("business_address"))
_scalar("fn_flags", lambda: F.concat(_given().rlike(r"[^\x00-\x7f]").cast("int").cast("string"), (F.trim(_place()) == "").cast("int").cast("string")), "cast(cast(regexp_matches(business_name, '[^\\x00-\\x7f]') as int) as varchar) || cast(cast(trim(business_address) = '' as int) as varchar)")
_scalar("name_sq", lambda: F.replace(T.normalized(_given()), F.lit(" "), F.lit("")), f"replace({D.normalized('business_name')}, ' ', '')")
_scalar("sorted_tokens", lambda: T.sorted_tokens(T.normalized(_given())), f"array_to_string(list_sort(string_split({D.normalized('business_name')}, ' ')), ' ')")
_scalar("text_len", lambda: F.length(_given()).cast("long"), "length(business_name)")
_scalar("count_char", lambda: (F.length(_given()) - F.length(F.replace(_given(), F.lit(" "), F.lit("")))).cast("long"), "length(business_name) - length(replace(business_name, ' ', ''))")

_RECS = "entity_id, src, country, name_n, name_alt, is_domain, addr_n, nums, name_nonascii, addr_empty"
for _name in ("normalize_record", "normalize_frame"):
    query(_name, "recs", f"select {_RECS} from recs")(lambda t: t.records().select(*_RECS.split(", ")))


@query("core_names", "bag", "select entity_id, name_core, name_sq from bag")
def _(t: Tables) -> DataFrame:
    return similarity.core_names(t.records(), MAX_DF).select("entity_id", "name_core", "name_sq")


# ---- fuzzy scorers


def _scored(t: Tables, column: str, score: str) -> DataFrame:
    both = features.joined(t.record_pairs(), similarity.core_names(t.records(), MAX_DF), [column])
    return both.select("q", "s1", F.round(fuzzy.scorer(score)(F.col(f"q_{column}"), F.col(f"s1_{column}")), 6).alias("score"))


for _feature, _column, _score in fuzzy.PAIR_SCORES:
    _sql = f"select q, s1, round(jaro_winkler_similarity(a.{_column}, b.{_column}), 6) as score from rpairs join bag a on a.entity_id = q join bag b on b.entity_id = s1" if _score == "jaro_winkler" else None
    query(f"fz_{_feature}", "rpairs bag", _sql)(lambda t, c=_column, s=_score: _scored(t, c, s))


@query("fz_alt_tset")
def _(t: Tables) -> DataFrame:
    both = features.joined(t.record_pairs(), t.records(), ["name_n", "name_alt"])
    return both.select("q", "s1", F.when(F.col("q_name_alt") != "", fuzzy.scorer("token_set_ratio")(F.col("q_name_alt"), F.col("s1_name_n"))).alias("score"))


def _anchored(column: str) -> Callable:
    def run(t: Tables) -> DataFrame:
        scored = t.record_pairs().withColumn("p", learn.hash01("q", "s1"))
        g = windows.graph_features(scored).select("q", "s1", "anchor_q")
        recs = t.records().select("entity_id", column)
        both = g.join(recs.select(F.col("entity_id").alias("q"), F.col(column).alias("_a")), "q").join(recs.select(F.col("entity_id").alias("anchor_q"), F.col(column).alias("_b")), "anchor_q", "left")
        return both.select("q", "s1", fuzzy.scorer("token_set_ratio")(F.col("_a"), F.col("_b")).alias("score"))

    return run


query("fz_anchor_name_tset")(_anchored("name_n"))
query("fz_anchor_addr_tset")(_anchored("addr_n"))


# ---- features


def _candidates(t: Tables) -> tuple[DataFrame, DataFrame]:
    recs = similarity.core_names(t.records(), MAX_DF)
    pairs = t.record_pairs().withColumn("tfidf", learn.hash01("q", "s1")).withColumn("rank", F.row_number().over(windows.per_q("tfidf")))
    return pairs, recs


@query("feat_pairwise")
def _(t: Tables) -> DataFrame:
    pairs, recs = _candidates(t)
    return features.pairwise(features.joined(pairs, recs, features.TEXT)).select("q", "s1", *[f for f, _, _ in fuzzy.PAIR_SCORES], "alt_tset")


@query("feat_full")
def _(t: Tables) -> DataFrame:
    pairs, recs = _blocked(t)
    return features.full(io.rewritten(pairs, "pairs"), recs)


@query("feat_margins", "margins", "select q, s1, case when abs(p_margin) < 0.0000005 then 0 else round(p_margin, 6) end as p_margin, case when abs(p_margin) < 0.0000002 then 0 else round(2 * p_margin, 6) end as p2_margin from margins")
def _(t: Tables) -> DataFrame:
    out = windows.with_margins(t.pairs().withColumn("p2", 2 * F.col("p")), ["p", "p2"])
    return out.select("q", "s1", r6("p_margin"), r6("p2_margin"))


@query("feat_popularity", "ranked", "select q, s1, count(*) over (partition by q) as n_cand, count(*) over (partition by s1) as s1_n_q, cast(sum(cast(rank = 1 as int)) over (partition by s1) as bigint) as s1_n_top1 from ranked")
def _(t: Tables) -> DataFrame:
    return features.popularity(t.pairs().withColumn("rank", F.row_number().over(windows.per_q("p")))).select("q", "s1", "n_cand", "s1_n_q", "s1_n_top1")


# ---- sets, splits, samples


@query("set_union_all", "pairs truth", "select q, s1 from pairs union all select q, s1 from truth")
def _(t: Tables) -> DataFrame:
    return t.pairs().select("q", "s1").unionByName(t.truth())


@query("set_union_distinct", "pairs truth", "select q, s1 from pairs union select q, s1 from truth")
def _(t: Tables) -> DataFrame:
    return t.pairs().select("q", "s1").unionByName(t.truth()).distinct()


@query("set_distinct_pairs", "", "select distinct l_orderkey as q, l_suppkey as s1 from lineitem")
def _(t: Tables) -> DataFrame:
    return t.table("lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("s1")).dropDuplicates(["q", "s1"])


@query("set_token_union", "bag", "select distinct country, unnest(list_append(generic, '&')) as token from (select country, list(token) as generic from generic group by country)")
def _(t: Tables) -> DataFrame:
    recs = t.records()
    n = recs.groupBy("country").agg(F.count("*").alias("_n"))
    generic = similarity.document_frequency(recs).join(n, "country").where(F.col("df") > MAX_DF * F.col("_n"))
    return generic.groupBy("country").agg(F.array_union(F.collect_set("token"), F.array(F.lit("&"))).alias("g")).select("country", F.explode("g").alias("token"))


def _h(keys: str, seed: int) -> str:
    return "((" + " + ".join([str(seed), *(f"{k} * {m}" for k, m in zip(keys.split(), (7919, 104729), strict=False))]) + ") % 9973) / cast(9973 as double)"


@query("split_universes", "truth pairs", f"""select r.q as entity_id, case when {_h("coalesce(t.s1,r.q)", 42)} < 0.5 then 'A' else 'B' end as half from (select distinct q from pairs) r left join truth t on t.q = r.q""")
def _(t: Tables) -> DataFrame:
    return learn.split_universes(t.pairs().select(F.col("q").alias("entity_id")).distinct(), t.truth()).select("entity_id", "half")


@query("sample_universe", "raw", f"select entity_id from raw where {_h('entity_id', 11)} < 0.1")
def _(t: Tables) -> DataFrame:
    return t.raw().where(learn.hash01("entity_id", seed=11) < 0.1).select("entity_id")


@query("sample_negatives", "labelled", f"select q, s1, label from labelled where label = 1 or {_h('q s1', 3)} < 0.3")
def _(t: Tables) -> DataFrame:
    return learn.sample_mask(learn.with_label(t.pairs(), t.truth()), 0.3, 3).select("q", "s1", "label")


@query("training_set", "labelled", f"select q, s1, label, round(case when label = 1 then 1 else 1 / cast(0.3 as double) end, 6) as weight from labelled where label = 1 or {_h('q s1', 3)} < 0.3")
def _(t: Tables) -> DataFrame:
    return learn.training_set(learn.with_label(t.pairs(), t.truth()), 0.3, 3).select("q", "s1", "label", r6("weight"))


# ---- models

_X = ["p", "p1_q_margin", "p1_q_sum", "s1_psum", "s1_pmax", "s1_n_hi", "p1_rel_s1max", "anchor_p1"]


def _rows(t: Tables) -> DataFrame:
    """Labelled pairs with graph features, and the half of their s1, kept once for several fits."""
    rows = learn.with_label(windows.graph_features(t.pairs()), t.truth())
    rows = rows.withColumn("half", F.when(learn.hash01("s1", seed=42) < 0.5, "A").otherwise("B"))
    return io.rewritten(rows.select("q", "s1", "label", "half", *_X), "gbm-rows")


def _model(t: Tables, **options):  # noqa: ANN003, ANN202
    rows = _rows(t)
    return rows, learn.train_gbm(learn.training_set(rows.where("half = 'A'"), 0.3), _X, 5, **options)


@query("gbm_train")
def _(t: Tables) -> DataFrame:
    rows = _rows(t)
    train = learn.training_set(rows, 0.3).withColumn("valid", F.col("half") == "B")
    model = learn.train_gbm(train, _X, 5)
    return t.spark.createDataFrame([(model.stages[-1].getNumTrees, model.stages[-1].numFeatures)], "trees long, features long")


for _name, _options in (("gbm_xgb", {"rate": 0.08}), ("gbm_lgb", {"rate": 0.05, "depth": 6}), ("gbm_predict", {})):
    query(_name)(lambda t, o=_options: (lambda rows, m: learn.predict([m], rows.where("half = 'B'"), _X).select("q", "s1", "p"))(*_model(t, **o)))


for _name in ("gbm_importance", "feature_topn"):
    query(_name)(lambda t: t.spark.createDataFrame(learn.importance(_model(t)[1], _X), "feature string, gain double"))


@query("gbm_save")
def _(t: Tables) -> DataFrame:
    from pyspark.ml import PipelineModel

    rows, model = _model(t)
    path = io.shared_path(t.spark, "model")
    model.write().overwrite().save(path)
    return learn.predict([PipelineModel.load(path)], rows.where("half = 'B'"), _X).select("q", "s1", "p")


def _crossfit(t: Tables) -> tuple[DataFrame, list]:
    return learn.crossfit(_rows(t), _X, rounds=5)


query("crossfit_stage1")(lambda t: _crossfit(t)[0].select("q", "s1", "half", "p"))
query("predict_stream")(lambda t: learn.predict(_crossfit(t)[1], _rows(t), _X).select("q", "s1", "p"))


@query("stage2")
def _(t: Tables) -> DataFrame:
    first = _crossfit(t)[0].select("q", "s1", "p")
    rows = learn.with_label(windows.graph_features(io.rewritten(first, "p1")), t.truth()).withColumn("half", F.when(learn.hash01("s1", seed=42) < 0.5, "A").otherwise("B"))
    rows = io.rewritten(rows.select("q", "s1", "label", "half", *_X), "stage2")
    model = learn.train_gbm(learn.training_set(rows.where("half = 'A'"), 0.3), _X, 5)
    return learn.predict([model], rows.where("half = 'B'"), _X).select("q", "s1", "p")


@query("ce_select", "pairs", "select q, s1, p from pairs where p between 0.05 and 0.95")
def _(t: Tables) -> DataFrame:
    return learn.band(t.pairs(), 0.05, 0.95)


def _text_rows(t: Tables) -> DataFrame:
    text = F.concat("business_name", F.lit(" ; "), "business_address")
    raw = t.raw().select("entity_id", text.alias("text"))
    both = features.joined(t.record_pairs(), raw, ["text"])
    return io.rewritten(both.withColumn("label", (F.col("q") - F.col("q") % 3 == F.col("s1")).cast("int")).withColumn("half", F.when(learn.hash01("s1", seed=42) < 0.5, "A").otherwise("B")), "ce-rows")


@query("ce_train")
def _(t: Tables) -> DataFrame:
    scorer = learn.PairTextScorer(iterations=5).fit(_text_rows(t))
    lr = scorer.model.stages[-1]
    return t.spark.createDataFrame([(lr.numFeatures, float(lr.intercept))], "buckets long, intercept double")


@query("ce_score")
def _(t: Tables) -> DataFrame:
    rows = _text_rows(t)
    return learn.PairTextScorer(iterations=5).fit(rows.where("half = 'A'")).score(rows.where("half = 'B'")).select("q", "s1", "ce")


@query("ce_crossfit")
def _(t: Tables) -> DataFrame:
    rows = _text_rows(t)
    a, b = (rows.where(F.col("half") == h) for h in ("A", "B"))
    scored = learn.PairTextScorer(iterations=5).fit(a).score(b).unionByName(learn.PairTextScorer(iterations=5).fit(b).score(a))
    return scored.select("q", "s1", "ce")


@query("ce_fill", "pairs", f"""select q, s1, p, ce, ce_f, round(ce_f - case when rn = 1 then coalesce(m2, 0) else m1 end, 6) as ce_f_margin from (
    select *, max(case when rn = 1 then ce_f end) over (partition by q) as m1, max(case when rn = 2 then ce_f end) over (partition by q) as m2 from (
    select *, row_number() over (partition by q order by ce_f desc, s1) as rn from (select pairs.q, pairs.s1, p, ce, coalesce(ce, p) as ce_f from pairs left join ({_CE}) c on c.q = pairs.q and c.s1 = pairs.s1)))""")
def _(t: Tables) -> DataFrame:
    pairs = t.pairs()
    scores = pairs.where("p between 0.2 and 0.8").select("q", "s1", (1 - F.col("p")).alias("ce"))
    return learn.fill_scores(pairs, scores).select("q", "s1", "p", "ce", "ce_f", r6("ce_f_margin"))


_PSEUDO = f"""select q, s1, p, kind, cast(kind = 'positive' as int) as label from (select *, case when pos then 'positive' when has and inside then 'hard' when inside and p <= 0.02 and {_h('q s1', 5)} < 0.05 then 'easy' end as kind from (
    select *, max(cast(pos as int)) over (partition by q) = 1 as has from (select m.*, country = 'EUROPE' as inside, country = 'EUROPE' and p >= 0.97 and round(p_margin, 9) >= 0.5 as pos from margins m join spine on spine.s1 = m.s1))) where kind is not null"""


def _pseudo(t: Tables) -> DataFrame:
    pairs = t.pairs().join(t.spine(), "s1")
    return learn.pseudo_labels(pairs, F.col("country") == "EUROPE", gap=0.5)


for _name in ("pseudo_labels", "pseudo_teacher"):
    query(_name, "margins spine", _PSEUDO)(_pseudo)


# ---- decisions


@query("decide_threshold", "pred", "select q, s1, p from pred")
def _(t: Tables) -> DataFrame:
    return decide.threshold(t.pairs(), 0.5)


@query("decide_expected_f", "expected", "select q, s1, p, k, round(ef, 6) as ef from expected")
def _(t: Tables) -> DataFrame:
    return decide.expected_f(t.pairs(), 1.5).select("q", "s1", "p", F.col("k").cast("long").alias("k"), r6("ef"))


@query("threshold_sweep", "spine best truth", """select t, round(avg(case when t_n = 0 and p_n = 0 then 1 when tp = 0 then 0 else 1.25 * (tp / p_n) * (tp / t_n) / (0.25 * (tp / p_n) + tp / t_n) end), 6) as score from (
    select g.t, s.s1, coalesce(any_value(x.n), 0) as t_n, count(b.q) as p_n, count(tr.q) as tp from spine s cross join (select cast(round(k * 0.05, 2) as double) as t from range(1, 20) r(k)) g
    left join (select s1, count(*) as n from truth group by s1) x on x.s1 = s.s1 left join best b on b.s1 = s.s1 and b.p >= g.t left join truth tr on tr.q = b.q and tr.s1 = b.s1 group by g.t, s.s1) group by t""")
def _(t: Tables) -> DataFrame:
    return decide.sweep(t.pairs(), t.truth(), t.spine()).select("t", r6("score"))


_F = "case when t_n = 0 and p_n = 0 then 1 when tp = 0 then 0 else 1.25 * (tp / p_n) * (tp / t_n) / (0.25 * (tp / p_n) + tp / t_n) end"


def _metric(pred: str) -> str:
    return f"""(select avg({_F}) from (select s.s1, (select count(*) from truth where truth.s1 = s.s1) as t_n, (select count(*) from {pred} p where p.s1 = s.s1) as p_n,
    (select count(*) from {pred} p join truth on truth.q = p.q and truth.s1 = p.s1 where p.s1 = s.s1) as tp from spine s))"""


def _alpha(a: float) -> str:
    """The matches of the expected-F rule with one alpha, as a subquery."""
    return f"""(select q, s1 from (select *, max(ef) over (partition by s1) as top, min(case when ef = m then k end) over (partition by s1) as k_top from (
        select *, max(ef) over (partition by s1) as m from (select o.q, o.s1, k, 1.25 * cum / (0.25 * e_true + k) as ef, p_none from (
        select *, row_number() over (partition by s1 order by pp desc, q) as k, sum(pp) over (partition by s1 order by pp desc, q rows between unbounded preceding and current row) as cum from (
        select *, row_number() over (partition by q order by pp desc, s1) as rn from {_sharp(a)}) where rn = 1) o
        join (select s1, sum(pp) as e_true, exp(sum(ln(1 - pp))) as p_none from {_sharp(a)} group by s1) t on t.s1 = o.s1))) where top > p_none and k <= k_top)"""


def _sharp(a: float) -> str:
    return f"(select *, pow(least(greatest(p, cast(0.000001 as double)), 1 - cast(0.000001 as double)), cast({a} as double)) as pp from pairs)"


def _scored_rule(a: float) -> str:
    counts = f"""select s.s1, coalesce(t_n, 0) as t_n, coalesce(p_n, 0) as p_n, coalesce(tp, 0) as tp from spine s left join (select s1, count(*) as t_n from truth group by s1) t on t.s1 = s.s1
        left join (select x.s1, count(*) as p_n, count(truth.q) as tp from {_alpha(a)} x left join truth on truth.q = x.q and truth.s1 = x.s1 group by x.s1) p on p.s1 = s.s1"""
    return f"select 'expected' as rule, cast({a} as double) as value, avg({_F}) as score from ({counts})"


_ALL_RULES = f"""select rule, value, round(score, 6) as score, row_number() over (order by round(score, 9) desc, rule desc, value) = 1 as chosen from (
    select 'threshold' as rule, t as value, avg({_F}) as score from (
    select g.t, s.s1, coalesce(any_value(x.n), 0) as t_n, count(b.q) as p_n, count(tr.q) as tp from spine s cross join (select cast(round(k * 0.05, 2) as double) as t from range(1, 20) r(k)) g
    left join (select s1, count(*) as n from truth group by s1) x on x.s1 = s.s1 left join best b on b.s1 = s.s1 and b.p >= g.t left join truth tr on tr.q = b.q and tr.s1 = b.s1 group by g.t, s.s1) group by t
    union all {' union all '.join(_scored_rule(a) for a in decide.ALPHAS)})"""


@query("choose_rule", "spine truth best", _ALL_RULES)
def _(t: Tables) -> DataFrame:
    return decide.rules(t.pairs(), t.truth(), t.spine()).select("rule", "value", r6("score"), "chosen")


_RULES = {"EUROPE": ("threshold", 0.9), "ASIA": ("threshold", 0.3)}
_BY_COUNTRY = "select q, e.s1, country from expected e join spine on spine.s1 = e.s1 where country not in ('EUROPE', 'ASIA') union all select q, b.s1, country from best b join spine on spine.s1 = b.s1 where country = 'EUROPE' and p >= 0.9 or country = 'ASIA' and p >= 0.3"


@query("decide_by_country", "expected best spine", _BY_COUNTRY)
def _(t: Tables) -> DataFrame:
    return decide.by_country(t.pairs(), t.spine(), _RULES, ("expected", 1.5))


@query("variant_report", "expected best spine", f"select spine.country, count(d.q) as matches, round(count(d.q) / count(distinct spine.s1), 6) as avg_matches, round(1 - count(distinct d.s1) / count(distinct spine.s1), 6) as empty_share from spine left join ({_BY_COUNTRY}) d on d.s1 = spine.s1 group by spine.country")
def _(t: Tables) -> DataFrame:
    kept = decide.by_country(t.pairs(), t.spine(), _RULES, ("expected", 1.5))
    n = t.spine().join(kept.groupBy("s1").agg(F.count("*").alias("n")), "s1", "left").na.fill(0, ["n"])
    return n.groupBy("country").agg(F.sum("n").alias("matches"), F.round(F.avg("n"), 6).alias("avg_matches"), F.round(F.avg((F.col("n") == 0).cast("double")), 6).alias("empty_share"))


# ---- metrics and diagnoses


@query("macro_f05", "counts", f"select round(avg({_F}), 6) as score from counts")
def _(t: Tables) -> DataFrame:
    return evaluate.macro_f05_sets(t.spine(), t.truth(), decide.threshold(t.pairs(), 0.5)).select(r6("score"))


query("macro_f05_vec", "counts", f"select round(avg({_F}), 6) as score from counts")(lambda t: evaluate.macro_f05(t.spine(), t.truth(), decide.threshold(t.pairs(), 0.5)).select(r6("score")))


@query("load_eval", "spine truth", "select spine.s1, country, truth.q from spine left join truth on truth.s1 = spine.s1")
def _(t: Tables) -> DataFrame:
    return t.spine().join(t.truth(), "s1", "left").select("s1", "country", "q")


@query("score_kept", "counts", f"select country, round(avg({_F}), 6) as score from counts group by country union all select 'all', round(avg({_F}), 6) from counts")
def _(t: Tables) -> DataFrame:
    pairs, truth, spine = t.pairs(), t.truth(), t.spine()
    kept = decide.threshold(pairs, 0.5)
    scored = evaluate.counts(spine, truth, kept).withColumn("_f", evaluate.f05("t_n", "p_n", "tp"))
    # a cube over one column: each country, and all of them
    return scored.cube("country").agg(F.avg("_f").alias("score"), F.grouping("country").alias("_all")).select(F.when(F.col("_all") == 1, "all").otherwise(F.col("country")).alias("country"), r6("score"))


@query("score_by_country", "counts", f"select country, round(avg({_F}), 4) as score from counts group by country")
def _(t: Tables) -> DataFrame:
    return evaluate.score_by_country(t.spine(), t.truth(), decide.threshold(t.pairs(), 0.5))


@query("error_report", "counts", """select country, round(avg(cast(t_n = 0 as double)), 6) as singleton_share, round(avg(case when t_n = 0 then cast(p_n > 0 as double) end), 6) as singletons_wrong,
    round(avg(case when t_n > 0 then cast(p_n = 0 as double) end), 6) as matched_pred_empty, round(avg(case when t_n > 0 and p_n > 0 then tp / p_n end), 6) as precision, round(avg(case when t_n > 0 then tp / t_n end), 6) as recall from counts group by country""")
def _(t: Tables) -> DataFrame:
    out = evaluate.error_report(t.spine(), t.truth(), decide.threshold(t.pairs(), 0.5))
    return out.select("country", *[r6(c) for c in out.columns if c != "country"])


query("diag_recall_rank", "truth ranked", _HIST)(_histogram)


@query("diag_fp_types", "spine truth pred", """select country, count(*) filter (type = 'belongs_to_other') as belongs_to_other, count(*) filter (type = 'matches_nothing') as matches_nothing from (
    select pred.s1, case when exists (select 1 from truth x where x.q = pred.q) then 'belongs_to_other' else 'matches_nothing' end as type from pred
    where not exists (select 1 from truth x where x.q = pred.q and x.s1 = pred.s1)) l join spine on spine.s1 = l.s1 group by country""")
def _(t: Tables) -> DataFrame:
    return evaluate.wrong(t.truth(), decide.threshold(t.pairs(), 0.5), t.spine())


@query("diag_profile", "margins", "select p >= 0.5 as accepted, round(median(p), 6) as p, round(median(p_margin), 6) as p_margin from margins group by 1")
def _(t: Tables) -> DataFrame:
    rows = windows.with_margins(t.pairs(), ["p"]).withColumn("accepted", F.col("p") >= 0.5)
    return rows.groupBy("accepted").agg(F.round(F.median("p"), 6).alias("p"), F.round(F.median("p_margin"), 6).alias("p_margin"))


@query("diag_examples")
def _(t: Tables) -> DataFrame:
    both = features.joined(t.record_pairs(), t.raw(), ["business_name", "business_address", "country"])
    return both.orderBy(F.xxhash64("q", "s1", F.lit(1)), "q", "s1").limit(6)


@query("test_stats", "spine pred", "select round(avg(n), 6) as avg_matches, round(avg(cast(n = 0 as double)), 6) as empty_share from (select spine.s1, count(pred.q) as n from spine left join pred on pred.s1 = spine.s1 group by spine.s1)")
def _(t: Tables) -> DataFrame:
    n = t.spine().join(decide.threshold(t.pairs(), 0.5).groupBy("s1").agg(F.count("*").alias("n")), "s1", "left").na.fill(0, ["n"])
    return n.agg(F.round(F.avg("n"), 6).alias("avg_matches"), F.round(F.avg((F.col("n") == 0).cast("double")), 6).alias("empty_share"))


@query("resolve")
def _(t: Tables) -> DataFrame:
    from .resolve import resolve

    return resolve(t.raw(), max_df=MAX_DF, df_frac=MAX_DF)
