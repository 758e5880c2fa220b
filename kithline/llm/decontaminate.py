"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the number of shingles they have, and a partition indexes of
each item a sketch, its least hashes: as many as may be missing at the wanted share, and
SURPLUS more. A document's containment of an item is estimated by the share of the sketch
among the document's hashes. If it holds the wanted share of the whole item, at most that
many sketch values can be missing, so at least SURPLUS of them (or all, of small items)
must be there; items below that are dropped without a miss, however long the document
is, and the others are verified by exact containment of all their shingles. A document
is hashed once, next to its text, and nothing is shuffled.

The benchmark travels to the executors in blocks of bounded size (BLOCK_BYTES of text);
of a larger one, each block takes a pass of its own over the documents, whose findings
are written, and its broadcast is freed before the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import WordHasher, binary_rows

WIDTH = 5
CONTAINMENT = 0.8
#: Sketch values of an item beyond those that may be missing.
SURPLUS = 4
BLOCK_BYTES = 16 << 20
#: Up to so many digests of texts with items are broadcast.
BROADCAST_KEYS = 1_000_000
#: ASCII white space, controls and punctuation part words; so do case and punctuation not hide a passage.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_BITS = 20


class _Partition:
    """The sketches of items of one shingle width and like sizes: keys in order, and the item each is of."""

    def __init__(self, width: int, sketches: list[tuple[int, np.ndarray]]) -> None:
        keys = np.concatenate([s for _, s in sketches])
        owners = np.repeat([i for i, _ in sketches], [len(s) for _, s in sketches])
        order = np.argsort(keys, kind="stable")
        self.width, self.keys, self.owners = width, keys[order], owners[order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - _BITS)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of whose sketch a value is among the document's hashes, and how many are."""
        own = np.unique(hashes[self.maybe[hashes >> np.uint64(64 - _BITS)]])
        lo, hi = np.searchsorted(self.keys, own, "left"), np.searchsorted(self.keys, own, "right")
        many = hi - lo
        at = np.arange(many.sum()) + np.repeat(lo - np.cumsum(many) + many, many)
        return np.unique(self.owners[at], return_counts=True)


class ItemIndex:
    """Items (id, UTF-8 text) in partitions by size, with sketches and whole shingle sets."""

    def __init__(self, items: list[tuple], width: int, containment: float) -> None:
        self.hasher = WordHasher(SEPARATORS)
        self.ids, self.sets, self.need, self.least = [], [], [], []
        parts: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            words = self.hasher.words(text or b"")
            if not len(words):
                continue
            k = min(width, len(words))
            s = np.unique(self.hasher.grams(words, k))
            need = ceil(containment * len(s) - 1e-9)
            missing = len(s) - need
            sketch = s[: missing + SURPLUS]
            parts.setdefault((k, len(s).bit_length()), []).append((len(self.ids), sketch))
            self.ids.append(item_id)
            self.sets.append(s)
            self.need.append(need)
            self.least.append(len(sketch) - missing)
        self.least = np.array(self.least, np.int64)
        self.partitions = [_Partition(k, sketches) for (k, _), sketches in sorted(parts.items())]

    def contained(self, text: bytes | np.ndarray) -> list[tuple[object, float]]:
        """(item, share) of each item of whose shingles the text holds the needed share."""
        words, grams, candidates = self.hasher.words(text), {}, []
        for p in self.partitions:
            if len(words) < p.width:
                continue
            if p.width not in grams:
                grams[p.width] = self.hasher.grams(words, p.width)
            items, n = p.hits(grams[p.width])
            candidates += items[n >= self.least[items]].tolist()
        if not candidates:
            return []
        own = np.unique(np.concatenate(list(grams.values())))
        out = []
        for i in sorted(candidates):
            both = int(np.isin(self.sets[i], own, assume_unique=True).sum())
            if both >= self.need[i]:
                out.append((self.ids[i], both / len(self.sets[i])))
        return out


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The benchmark's distinct items in blocks of at most BLOCK_BYTES of text, or of one item."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).where("text is not null").distinct()
    block, size = [], 0
    for item_id, text in items.toLocalIterator():
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item_id, bytes(text)))
        size += len(text)
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, containment for each row of docs (doc_id, text) that holds enough of an item.

    Words are runs of bytes that are neither ASCII white space nor ASCII punctuation, A-Z
    folded. Items of fewer than width words are one shingle of all of them; items and
    texts that are null or have no word match nothing. Repeated rows each give their rows.
    """
    blocks = _item_blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    return _passes(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), blocks, first, second, width, containment)


def _search(rows: DataFrame, block: list[tuple], width: int, containment: float):
    """What one block finds in rows (key, text), as (key, item_id, containment), and its broadcast."""
    sent = rows.sparkSession.sparkContext.broadcast(block)
    kind = rows.schema[0]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = ItemIndex(sent.value, width, containment)
        for b in batches:
            found = [(at, i, c) for at, row in enumerate(binary_rows(b.column(1))) if row is not None and len(row) for i, c in index.contained(row)]
            at, items, shares = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(items, pa.int64()), pa.array(shares, pa.float64())], [kind.name, "item_id", "containment"])

    return rows.mapInArrow(run, f"{kind.name} {kind.dataType.simpleString()}, item_id long, containment double"), sent


def _passes(rows: DataFrame, blocks: Iterator[list[tuple]], first: list[tuple], second: list[tuple] | None, width: int, containment: float) -> DataFrame:
    """_search of all blocks; with more than one, each pass is written and its broadcast freed."""
    found, sent = _search(rows, first, width, containment)
    if second is None:
        return found
    out = common.materialize(found, "bench-pass")
    sent.destroy()
    for block in chain([second], blocks):
        found, sent = _search(rows, block, width, containment)
        out = out.unionByName(common.materialize(found, "bench-pass"))
        sent.destroy()
    return out


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; all columns stay, whatever their names.

    Null and empty texts and rows of a null id stay or go by their text alone, as do repeated
    rows. An empty table, or an empty benchmark, changes nothing.
    """
    blocks = _item_blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(first)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            index = ItemIndex(sent.value, width, containment)
            for b in batches:
                texts = b.column(b.schema.get_field_index("text")).cast(pa.large_binary())
                yield b.filter(pa.array([row is None or not len(row) or not index.contained(row) for row in binary_rows(texts)], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    rows = docs.select(key.alias("text_key"), F.col("text").cast("binary"))
    found = common.materialize(_passes(rows, blocks, first, second, width, containment).select("text_key").distinct(), "bench-found")
    name = common.free_name(docs, "_bench_key")
    found = found.withColumnRenamed("text_key", name)
    return docs.withColumn(name, key).join(F.broadcast(found) if common.fits(found, BROADCAST_KEYS) else found, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, and the share they hold."""
    return contaminated(common.text_sources(spark, sf_dir, "documents"), common.text_sources(spark, sf_dir, "benchmark"))
