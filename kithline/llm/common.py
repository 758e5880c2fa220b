"""What the operators of this subpackage share: the shared folder, written intermediates, the hold-out rule."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot that more than HOT_ROWS rows carry, or more than a MOST_HOT-th of all rows; so at most MOST_HOT keys are hot.
HOT_ROWS, MOST_HOT = 1024, 250_000


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where that setting is absent, as in local tests, a folder of this machine is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.gettempdir()}/kithline-checkpoints"
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, so that a lost executor costs no recomputation of it."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_sources(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def among_least(h: Column, n: Column | int, rows: int) -> Column:
    """Whether a 64-bit hash is in the part of its range that holds about four times `rows` of n hashes.

    The least `rows` of all are among those that pass, but for one case in far more than
    10 ** 100 (rows >= 300); so a top-k over a large table moves few rows. n <= 4 * rows passes all.
    """
    return (h.cast("double") + float(1 << 63)) / float(1 << 64) * n <= F.lit(4.0 * rows)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def hot_bound(groups: DataFrame, size: str) -> int | None:
    """From how many rows on a key is hot, by the sizes of all groups; None if none is."""
    total, most = groups.agg(F.sum(size), F.max(size)).first()
    bound = max(HOT_ROWS, math.ceil((total or 0) / MOST_HOT))
    return bound if (most or 0) > bound else None


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """rows joined with groups (one row a key; `size` is how many rows carry it) without a task for a hot key.

    Groups of hot keys, at most MOST_HOT by the definition of hot_bound, are broadcast, so
    their rows stay where they are; all others meet by a shuffle. groups is read twice.
    """
    bound = hot_bound(groups, size)
    if bound is None:
        return rows.join(groups, key, how)
    hot = groups.where(F.col(size) > bound)
    calm = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(size) <= bound), key, how)
    return calm.unionByName(rows.join(F.broadcast(hot), key))


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as no column of df begins with, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
