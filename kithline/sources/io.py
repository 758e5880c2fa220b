"""Readers and writers: TSV records, Parquet, id lists, metadata."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = ("entity_id", "business_name", "business_address", "country")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir, or under a local folder where that is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/kithline-checkpoints"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def rewritten(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns strings, no quoting, empty cells as empty strings."""
    return spark.read.csv(path, sep="\t", header=True, quote="", escape="", inferSchema=False).na.fill("")


def union_sources(*sources: DataFrame) -> DataFrame:
    """Record tables one after the other, tagged src 1, 2, 3, ..."""
    tagged = [s.withColumn("src", F.lit(i).cast("int")) for i, s in enumerate(sources, 1)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out


def load_split(spark: SparkSession, data_dir: str, split: str) -> DataFrame:
    return union_sources(*(read_tsv(spark, f"{data_dir}/{split}_source{i}.tsv").select(*RAW) for i in (1, 2, 3)))


def truth_pairs(lists: DataFrame, key: str = "source1_entity_id", values: str = "matched_entity_ids") -> DataFrame:
    """(s1, q) from comma-joined id lists; empty entries are no match."""
    return lists.select(F.col(key).alias("s1"), F.explode(F.split(values, ",")).alias("q")).where("q <> ''")


def append_columns(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """base with extra's columns added or replaced, matched by key."""
    new = [c for c in extra.columns if c not in keys]
    return base.drop(*new).join(extra, keys, "left")


def id_lists(spine: DataFrame, pairs: DataFrame, name: str = "matched_ids") -> DataFrame:
    """One row for each s1 of the spine with its distinct q, sorted and comma-joined; empty without any."""
    lists = pairs.select("s1", "q").distinct().groupBy("s1").agg(F.array_join(F.transform(F.array_sort(F.collect_list("q")), lambda x: x.cast("string")), ",").alias(name))
    return spine.select("s1").join(lists, "s1", "left").select("s1", F.coalesce(name, F.lit("")).alias(name))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")


def write_metadata(spark: SparkSession, path: str, metadata: dict) -> None:
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
