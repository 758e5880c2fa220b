"""Token ids as Parquet list columns.

Layout: one file per range of doc_id, rows ascending; the id list is dictionary
encoded (a vocabulary fits the dictionary page), row groups and data pages are
kept small, and Spark's Parquet writer adds column and offset indexes. A reader
that filters on doc_id skips row groups and pages, and one that selects only
metadata columns never touches the ids. Each file's rows carry the number of ids
before them in the file, so a global offset needs one sum per file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .token_ids import encoder

ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 128 << 10
STORED = "doc_id long, file_no int, start_in_file long, n_tokens long, ids array<int>"


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, lead_space: bool,
    files: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
) -> None:
    """Encodes docs (doc_id, text), appends end_id to each, and writes them in ascending doc_id order.

    Null texts are empty. Rows with equal ids follow each other by text; null ids come
    first. Other columns are not read. An empty table writes a readable empty one.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(tokenizer_path, lead_space).encode
        end = np.array([end_id], "<u4").tobytes()
        no, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = [encode(t or "") + end for t in part.column(1).to_pylist()]
                n = np.array([len(r) // 4 for r in raw], np.int64)
                ends = np.cumsum(n)
                ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(raw))])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(n), no, np.int32)), pa.array(before + ends - n), pa.array(n), lists],
                    ["doc_id", "file_no", "start_in_file", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    (
        rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, STORED)
        .write.option("compression", "zstd").option("parquet.enable.dictionary", "true")
        .option("parquet.dictionary.page.size", 1 << 20).option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", 2048)
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids; unselected columns are not read."""
    stored = spark.read.schema(STORED).parquet(path)
    sums = stored.groupBy("file_no").agg(F.sum("n_tokens").alias("_n"))  # a row per file, so never large
    base = sums.select("file_no", (F.sum("_n").over(Window.orderBy("file_no")) - F.col("_n")).alias("_base"))
    return stored.join(F.broadcast(base), "file_no").select("doc_id", (F.col("_base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """The crc32 of each row's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            lists = b.column(3)
            at = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=True).view(np.uint8))
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            n = pa.array(np.diff(at).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place and digest among all ids, as read back from the files."""
    import public_tokenizers

    path = common.shared_dir(spark, "tokens")
    write_tokens(common.text_sources(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2, True)
    return digests(read_tokens(spark, path))
