"""Hierarchical multi-length packing of documents into training windows.

Every task packs its own documents, so nothing is shuffled. A document's ids are
routed to the shortest context tier that holds them (what exceeds the longest
tier is cut into full windows first). Tiers are packed from the longest down; the
gap behind a window's first piece is filled from the pool of pieces of its own
and shorter tiers, largest fitting piece first, and what is then left of the gap
is filled by cutting a piece. Windows close full; a task keeps at most one open
window between batches. At its end the open window's pieces and all left over
are laid end to end and cut into tier-sized windows, largest first, and the last
few ids form the only padded sequence of the task.

Step groups: the windows of a tier are numbered through all tasks (from one count for
each task and tier), and every so many as hold `group_tokens` tokens form one step group.
So all groups hold equally many tokens, but for the last group of each tier and the
padded sequences, which count as windows of the longest tier.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .token_ids import encoder

TIERS = (128, 256, 512, 1024, 2048)
GROUP_TOKENS = 1 << 16
#: Up to so many counts (tasks times tiers) are broadcast.
MOST_COUNTS = 1_000_000
#: Words an encoder remembers; it lives on in the worker through later stages, so it holds fewer than others do.
CACHE_WORDS = 160_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, window long, padding long"


class _Pool:
    """Pieces (doc, ids, start) by length; a bounded number, since each batch is packed when it has come."""

    def __init__(self) -> None:
        self.by: dict[int, list] = {}
        self.lengths: list[int] = []

    def add(self, piece: tuple) -> None:
        n = len(piece[1])
        if n not in self.by:
            self.by[n] = []
            insort(self.lengths, n)
        self.by[n].append(piece)

    def pop(self, at: int) -> tuple:
        n = self.lengths[at]
        out = self.by[n].pop()
        if not self.by[n]:
            del self.by[n], self.lengths[at]
        return out

    def fitting(self, gap: int) -> tuple | None:
        at = bisect_right(self.lengths, gap)
        return self.pop(at - 1) if at else None


class _Packer:
    def __init__(self, part: int, tiers: tuple[int, ...], keep_ids: bool) -> None:
        self.tiers, self.keep_ids = tiers, keep_ids
        self.pool, self.open, self.gap, self.tier = _Pool(), [], 0, 0
        self.sequence, self.count = part << 32, dict.fromkeys(tiers, 0)
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple], tier: int, padding: int = 0) -> None:
        window, offset = self.count[tier], 0
        self.count[tier] += 1
        for doc_id, ids, start, total in pieces:
            raw = ids.tobytes()
            self.rows.append((doc_id, start, len(ids), zlib.crc32(raw), total, self.sequence, offset, tier, window, padding, raw))
            offset += len(ids)
        self.sequence += 1

    def document(self, doc_id: int | None, ids: np.ndarray) -> None:
        top, start, total = self.tiers[-1], 0, len(ids)
        while total - start >= top:
            self.close([(doc_id, ids[start : start + top], start, total)], top)
            start += top
        if start < total:
            self.pool.add((doc_id, ids[start:], start, total))

    def pack(self) -> None:
        """Packs the pool; at most one window stays open, for want of pieces."""
        pool = self.pool
        while pool.lengths:
            if not self.gap:
                piece = pool.pop(-1)
                self.tier = next(t for t in self.tiers if t >= len(piece[1]))
                self.open, self.gap = [piece], self.tier - len(piece[1])
            while self.gap and pool.lengths:
                piece = pool.fitting(self.gap)
                if piece is None:
                    doc_id, ids, start, total = pool.pop(0)
                    pool.add((doc_id, ids[self.gap :], start + self.gap, total))
                    piece = (doc_id, ids[: self.gap], start, total)
                self.open.append(piece)
                self.gap -= len(piece[1])
            if not self.gap:
                self.close(self.open, self.tier)
                self.open = []

    def finish(self) -> None:
        rest, self.open = self.open, []
        left = sum(len(p[1]) for p in rest)
        while left:
            tier = next((t for t in reversed(self.tiers) if t <= left), 0)
            size, own, held = tier or left, [], 0
            while held < size:
                doc_id, ids, start, total = rest.pop(0)
                take = min(len(ids), size - held)
                own.append((doc_id, ids[:take], start, total))
                if take < len(ids):
                    rest.insert(0, (doc_id, ids[take:], start + take, total))
                held += take
            power = size & (size - 1) == 0
            self.close(own, tier or self.tiers[-1], 0 if power else self.tiers[-1] - size)
            left -= size

    def take(self):
        import pyarrow as pa

        cols = list(zip(*self.rows, strict=True)) or [()] * 11
        self.rows = []
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "window", "padding"]
        if self.keep_ids:
            arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[10]], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, lead_space: bool = False,
    tiers: tuple[int, ...] = TIERS, group_tokens: int = GROUP_TOKENS, keep_ids: bool = False,
) -> DataFrame:
    """Packs docs (doc_id, text) and returns a row per piece, with its ids on request.

    Null and empty texts are documents of the end id alone. Null ids and repeated
    rows are packed like any other row. Other columns are not read. An empty table
    gives no pieces. Texts are encoded whole, however long; a sequence's id holds
    the task's number in its upper half, so ids are unique without coordination.
    The pieces are written to the shared folder before they get their step groups.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be ascending powers of two")

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        encode = encoder(tokenizer_path, lead_space, CACHE_WORDS).encode
        end = np.array([end_id], "<u4").tobytes()
        packer = _Packer(TaskContext.get().partitionId(), tiers, keep_ids)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    packer.document(doc_id, np.frombuffer(encode(text or "") + end, "<u4"))
                packer.pack()
                if packer.rows:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    schema = PIECES + (", ids array<int>" if keep_ids else "")
    pieces = common.materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema), "packed")
    return _with_step_groups(pieces, tiers, group_tokens)


def _with_step_groups(pieces: DataFrame, tiers: tuple[int, ...], group_tokens: int) -> DataFrame:
    """Numbers each tier's windows through all tasks and adds the step group each is in; groups of different tiers differ."""
    task = F.shiftright("sequence_id", 32)
    counts = pieces.groupBy(task.alias("_task"), "tier").agg((F.max("window") + 1).alias("_n"))  # a row for each task and tier
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("tier").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = common.materialize(counts.select("_task", "tier", before.alias("_before")), "packed-counts")
    placed = pieces.withColumn("_task", task).join(F.broadcast(base) if common.fits(base, MOST_COUNTS) else base, ["_task", "tier"])
    windows_of = F.greatest(F.lit(1), F.floor(F.lit(group_tokens) / F.col("tier"))).cast("long")
    number = F.floor((F.col("_before") + F.col("window")) / windows_of).cast("long")
    order = F.array_position(F.array(*[F.lit(t) for t in tiers]), F.col("tier"))
    own = [c for c in pieces.columns if c not in ("window", "padding", "ids")]
    return placed.select(*own, (F.shiftleft(order, 48) + number).alias("step_group"), "padding", *[c for c in pieces.columns if c == "ids"])


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all documents are packed into."""
    import public_tokenizers

    return pack(common.text_sources(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
