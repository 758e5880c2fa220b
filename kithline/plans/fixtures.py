"""Record-linkage inputs made from the driver's tables, as Spark frames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = """select q, s1, max(p) as p from (
  select l_orderkey as q, l_suppkey as s1, ((l_partkey*7919 + l_linenumber*104729) % 9973) / cast(9973 as double) as p from {lineitem}) t group by q, s1"""
TRUTH = """select q, s1 from (
  select l_orderkey as q, l_suppkey as s1, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey) as rn
  from {lineitem} where l_orderkey % 4 <> 0) t where rn = 1"""
ENTITIES = """select s.s_suppkey as s1, r.r_name as country from {supplier} s join {nation} n on s.s_nationkey = n.n_nationkey
  join {region} r on n.n_regionkey = r.r_regionkey"""
VECTORS = """select a.vec_id as entity_id, cast(a.vec_id % 3 + 1 as int) as src, a.label as country, a.embedding as emb_name, b.embedding as emb_addr
  from {embeddings} a join {embeddings} b on b.vec_id = (a.vec_id * 7 + 1) % (select count(*) from {embeddings})"""
RECORDS_DUCK = """select doc_id as entity_id, cast(doc_id % 3 + 1 as int) as src, lang as country, array_to_string(list_slice(w,1,6),' ') as business_name,
  case when doc_id % 29 = 0 then '' else array_to_string(list_slice(w,7,14),' ') || ' No ' || lpad(cast(n_chars as varchar),5,'0') end as business_address
  from (select *, string_split(regexp_replace(trim(text),'[ \\t\\r\\n]+',' ','g'),' ') as w from documents) t"""
RECORDS_SPARK = """select doc_id as entity_id, cast(doc_id % 3 + 1 as int) as src, lang as country, array_join(slice(w,1,6),' ') as business_name,
  case when doc_id % 29 = 0 then '' else concat(array_join(slice(w,7,8),' '),' No ',lpad(cast(n_chars as string),5,'0')) end as business_address
  from (select *, split(regexp_replace(regexp_extract(trim(text),'^(?:[^ \\\\t\\\\r\\\\n]*[ \\\\t\\\\r\\\\n]+){{0,13}}[^ \\\\t\\\\r\\\\n]*',0),'[ \\\\t\\\\r\\\\n]+',' '),' ') as w from {documents}) t"""
#: Candidate pairs of records: up to five source-1 records next to each other record.
RECORD_PAIRS_DUCK = """select r.entity_id as q, s.entity_id as s1 from (select *, unnest(range(0, 5)) as k from {recs} where src > 1) r
  join {recs} s on s.entity_id = r.entity_id - r.entity_id % 3 + 3 * r.k and s.src = 1"""

_TABLES = ("lineitem", "supplier", "nation", "region", "embeddings", "documents")


class Tables:
    """The fixtures of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{t: self.table(t) for t in _TABLES if f"{{{t}}}" in text})

    def pairs(self) -> DataFrame:
        return self.sql(PAIRS)

    def truth(self) -> DataFrame:
        return self.sql(TRUTH)

    def spine(self) -> DataFrame:
        return self.sql(ENTITIES)

    def vectors(self) -> DataFrame:
        return self.sql(VECTORS)

    def raw(self) -> DataFrame:
        return self.sql(RECORDS_SPARK)

    def records(self) -> DataFrame:
        from ..operators import similarity

        return similarity.records(self.raw())

    def record_pairs(self) -> DataFrame:
        raw = self.raw().select("entity_id", "src")
        q = raw.where("src > 1").select(F.col("entity_id").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("_k"))
        q = q.withColumn("s1", F.col("q") - F.col("q") % 3 + 3 * F.col("_k"))
        return q.join(raw.where("src = 1").select(F.col("entity_id").alias("s1")), "s1", "left_semi").select("q", "s1")


def plain(text: str) -> str:
    """A fixture's SQL with the oracle's view names."""
    return text.format(**{t: t for t in _TABLES})


CTES = {
    "pairs": plain(PAIRS), "truth": plain(TRUTH), "spine": plain(ENTITIES), "vectors": plain(VECTORS), "raw": RECORDS_DUCK,
    "rpairs": RECORD_PAIRS_DUCK.format(recs="raw"),
    "best": "select q, s1, p from (select *, row_number() over (partition by q order by p desc, s1) as rn from pairs) where rn = 1",
    "pred": "select q, s1, p from best where p >= 0.5",
    "margins": """select q, s1, p, p - case when rn = 1 then coalesce(m2, 0) else m1 end as p_margin from (
        select *, max(case when rn = 1 then p end) over (partition by q) as m1, max(case when rn = 2 then p end) over (partition by q) as m2 from (
        select *, row_number() over (partition by q order by p desc, s1) as rn from pairs))""",
    "labelled": "select p.*, coalesce(t.one, 0) as label from pairs p left join (select q, s1, 1 as one from truth) t on t.q = p.q and t.s1 = p.s1",
    "counts": """select s.s1, s.country, coalesce(t_n, 0) as t_n, coalesce(p_n, 0) as p_n, coalesce(tp, 0) as tp from spine s
        left join (select s1, count(*) as t_n from truth group by s1) t on t.s1 = s.s1 left join (select s1, count(*) as p_n from pred group by s1) p on p.s1 = s.s1
        left join (select truth.s1, count(*) as tp from truth join pred on truth.q = pred.q and truth.s1 = pred.s1 group by truth.s1) h on h.s1 = s.s1""",
    "ranked": "select *, row_number() over (partition by q order by p desc, s1) as rank from pairs",
}
NEEDS = {"best": "pairs", "pred": "best", "margins": "pairs", "labelled": "pairs truth", "counts": "spine truth pred", "ranked": "pairs", "rpairs": "raw"}


def with_ctes(names: str, select: str, extra: dict[str, str] | None = None, needs: dict[str, str] | None = None) -> str:
    """`select` behind the named common table expressions and those they need."""
    ctes, wants, order = CTES | (extra or {}), NEEDS | (needs or {}), []

    def add(name: str) -> None:
        for n in wants.get(name, "").split():
            add(n)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({ctes[n]})" for n in order) + "\n" + select
