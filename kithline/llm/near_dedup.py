"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

Signature: 60 MinHash values of a document's shingle set, 16 bits of each, in 12
chunks of 5. Two signatures that differ in at most 23 values share, by the
pigeonhole principle, a chunk that differs in at most one; so a chunk is indexed
under its five forms with one value left out (the allowed chunk errors, enumerated)
and every pair under that distance meets in some bucket. At a similarity of 0.85 two
signatures differ in 9 values on average, and a pair shares no bucket once in
2,400,000,000 cases; at 0.8 in 12, and once in 9,000,000. Links are then confirmed
on whole shingle sets.

Order of work: rows with equal shingle sets form one class, whatever their ids, and
only classes are indexed, under a number of their own. In every bucket one member is
the centre, and all members are compared with it. Two members of a bucket hence have a
centre in common; where a centre's members are in several components, those outside
the largest are compared with all members of other components, by what each lacks and
adds to the centre's set. Large groups of copies so cost about one comparison a member
and no pair becomes a row. Keys that very many rows carry (a bucket, a centre, a
component, a digest) are joined by broadcast, see common.spread_join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingles import WordHasher, binary_rows, mix

SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
CHUNKS, PER_CHUNK = 12, 5
VALUES = CHUNKS * PER_CHUNK
#: Members of one centre whose signatures differ in more values are not compared; at a similarity of 0.8 one pair in 10 ** 11 is that far apart.
MAX_DISTANCE = 36
#: Comparisons with one centre that go to one task; a centre takes part in at most MOST_PARTS tasks, which get more then.
STAR_ROWS, MOST_PARTS = 256, 4096
#: Hot buckets are foreseen from the buckets of one class in so many, by HOT_SEEN members there or more.
HOT_SAMPLE, HOT_SEEN = 64, 16
#: Members of a group that meet in one task when components are compared.
GROUP_BLOCK = 1024
#: Up to so many ids are broadcast (16 MB) to pick the texts to compare; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_SEED = mix(np.arange(1, VALUES + 1, dtype=np.uint64))[:, None]
_ODD = mix(np.arange(1001, 1001 + VALUES, dtype=np.uint64))[:, None] | np.uint64(1)


def signature(shingles: np.ndarray) -> bytes:
    """60 MinHash values of 16 bits; shingles must not be empty."""
    least = np.full(VALUES, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 2048):
        np.minimum(least, ((shingles[at : at + 2048] ^ _SEED) * _ODD).min(axis=1), out=least)
    return (mix(least) >> np.uint64(48)).astype("<u2").tobytes()


def sketches(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_key (a digest of the text), n_shingles, digest of the shingle set and signature (both null for empty sets)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher = WordHasher(SEPARATORS)
        for b in batches:
            n, digest, sig = [], [], []
            for row in binary_rows(b.column(2)):
                s = hasher.shingles(row, width) if row is not None and len(row) else ()
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "text_key", "n_shingles", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("long"), _text_key(), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, text_key binary, n_shingles long, digest binary, sig binary")


def _text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key")


def _bucket_keys(classes: DataFrame) -> DataFrame:
    """A row for each class and slot (chunk, value left out): key, node."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, CHUNKS, PER_CHUNK).astype(np.uint64)
            keys = np.empty((len(sig), VALUES), np.uint64)
            for slot in range(VALUES):
                chunk, out = divmod(slot, PER_CHUNK)
                h = np.full(len(sig), np.uint64(slot + 1))
                for k in range(PER_CHUNK):
                    if k != out:
                        h = mix(h ^ (sig[:, chunk, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                keys[:, slot] = h
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), VALUES))], ["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def _star_pairs(classes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a bucket's centre, its member of the least number, and each other member."""
    keys = _bucket_keys(classes)
    seen = _bucket_keys(classes.where(F.pmod(F.xxhash64("node"), F.lit(HOT_SAMPLE)) == 0)).groupBy("key").agg(F.count("*").alias("_seen"))
    least = max(HOT_SEEN, classes.count() * VALUES // HOT_SAMPLE // common.MOST_HOT)
    hot = common.materialize(seen.where(F.col("_seen") >= least).select("key"), "nd-hot")

    def pairs(rows: DataFrame, spread: bool) -> DataFrame:
        groups = rows.groupBy("key").agg(F.count("*").alias("_n"), F.min("node").alias("a")).where("_n > 1").drop("_n")
        return rows.join(F.broadcast(groups) if spread else groups, "key").where("node <> a").select("a", F.col("node").alias("b"))

    if common.fits(hot, 0):
        return pairs(keys.repartition("key"), False).distinct()
    calm = keys.join(F.broadcast(hot), "key", "left_anti").repartition("key")
    # the members of hot buckets stay where they are; only each task's least member and count travel
    return pairs(calm, False).union(pairs(keys.join(F.broadcast(hot), "key"), True)).distinct()


def _stars(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Compares whole shingle sets of pairs (a, b) of classes, a being a centre of many b.

    Gives a, b, whether they are linked (100 * intersection >= percent * union), the size
    of a's set, and, for centres with more than one b, what b's set lacks and adds to it.
    A centre's text goes once to each task that compares up to STAR_ROWS with it.
    """
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = common.materialize(classes.join(ids, "node", "left_semi").select("text_key", "node", "rows"), "nd-wanted")
    texts = docs.select(_text_key(), F.col("text").cast("binary").alias("_text"))
    few = common.fits(wanted, BROADCAST_IDS)
    found = texts.join(F.broadcast(wanted), "text_key") if few else common.spread_join(texts, wanted, "text_key", "rows")
    texts = common.materialize(found.groupBy("node").agg(F.first("_text").alias("_text")), "nd-texts")
    sizes = pairs.groupBy("a").agg(F.count("*").alias("_n")).withColumn("_parts", F.least(F.ceil(F.col("_n") / STAR_ROWS), F.lit(MOST_PARTS)).cast("int"))
    sizes = common.materialize(sizes, "nd-centres")
    text_of = lambda c: texts.select(F.col("node").alias(c), "_text")
    firsts = sizes.join(text_of("a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(None).cast("long").alias("b"), "_n", "_text")
    others = common.spread_join(pairs, sizes, "a", "_n").withColumn("_part", F.pmod(F.xxhash64("b"), F.col("_parts")).cast("int"))
    others = others.join(text_of("b"), "b").select("a", "_part", "b", "_n", "_text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher, centre = WordHasher(SEPARATORS), None
        for batch in batches:
            a, b, n, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
            for i, text in enumerate(binary_rows(batch.column(4))):
                s = hasher.shingles(text, width)
                if b[i] is None:
                    centre = s
                    continue
                there = _member(s, centre)
                both = int(there.sum())
                linked = 100 * both >= percent * (len(s) + len(centre) - both)
                lacks = centre[~_member(centre, s)].tobytes() if n[i] > 1 else b""
                out.append((a[i], b[i], linked, len(centre), lacks, s[~there].tobytes() if n[i] > 1 else b""))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["a", "b", "linked", "size", "lacks", "adds"])

    laid = firsts.unionByName(others).repartition("a", "_part").sortWithinPartitions("a", "_part", F.col("b").asc_nulls_first())
    return laid.mapInArrow(run, "a long, b long, linked boolean, size long, lacks binary, adds binary")


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of the sorted x are in the sorted `of`."""
    if not len(of):
        return np.zeros(len(x), bool)
    at = np.searchsorted(of, x)
    at[at == len(of)] = 0
    return of[at] == x


class _Ragged:
    """Sorted arrays of different lengths, laid end to end."""

    def __init__(self, rows: list[bytes]) -> None:
        self.all = np.frombuffer(b"".join(rows), np.uint64)
        self.at = np.concatenate([[0], np.cumsum([len(r) // 8 for r in rows])]).astype(np.int64)
        self.n = np.diff(self.at)

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many values row i has in common with each of the others."""
        n, own = self.n[others], self.all[self.at[i] : self.at[i + 1]]
        if not len(own) or not n.sum():
            return np.zeros(len(others), np.int64)
        starts = np.cumsum(n) - n
        where = np.repeat(self.at[others] - starts, n) + np.arange(n.sum())
        return np.bincount(np.repeat(np.arange(len(others)), n), _member(self.all[where], own), minlength=len(others)).astype(np.int64)


def _links_across(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of components that have members of one centre which are linked.

    members: centre, node, comp, sig, size (of the centre's set), lacks, adds. From what two
    sets lack and add to the same third, the size of their intersection follows exactly.
    Only members outside the centre's largest component (strays) can have a link that is
    missing; blocks of them meet blocks of all members. In a task, components grow
    together as links are found, so at most one link a stray is given.
    """
    counts = members.groupBy("centre", "comp").agg(F.count("*").alias("_c")).groupBy("centre").agg(F.sum("_c").alias("_n"), F.max(F.struct("_c", "comp")).alias("_top"))
    blocks = lambda c: F.ceil(c / GROUP_BLOCK).cast("int")
    strays = F.col("_n") - F.col("_top._c")
    groups = counts.where(strays > 0).select("centre", "_n", F.col("_top.comp").alias("_largest"), blocks(F.col("_n")).alias("_all"), blocks(strays).alias("_strays"))
    met = common.spread_join(members, common.materialize(groups, "nd-groups"), "centre", "_n")
    dealt = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cols = ["centre", "_x", "_y", "_stray", "node", "comp", "sig", "size", "lacks", "adds"]
    own = met.withColumns({"_stray": F.lit(False), "_y": dealt("_all")}).withColumn("_x", every("_strays")).select(*cols)
    asking = met.where("comp <> _largest").withColumns({"_stray": F.lit(True), "_x": dealt("_strays")}).withColumn("_y", every("_all")).select(*cols)

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        size = rows[0][7]
        stray, node, comp = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5))
        given = comp.copy()
        sig = np.frombuffer(b"".join(r[6] for r in rows), "<u2").reshape(len(rows), VALUES)
        lacks, adds = _Ragged([r[8] for r in rows]), _Ragged([r[9] for r in rows])
        n = size - lacks.n + adds.n
        for i in np.flatnonzero(stray):
            cand = np.flatnonzero((comp != comp[i]) & (stray == 0))
            cand = cand[100 * np.minimum(n[cand], n[i]) >= percent * np.maximum(n[cand], n[i])]
            cand = cand[(sig[cand] != sig[i]).sum(axis=1) <= MAX_DISTANCE] if len(cand) else cand
            if not len(cand):
                continue
            both = size - lacks.n[i] - lacks.n[cand] + lacks.shared(i, cand) + adds.shared(i, cand)
            for j in cand[100 * both >= percent * (n[i] + n[cand] - both)]:
                if comp[i] != comp[j]:
                    comp[comp == comp[j]] = comp[i]
                    yield int(given[i]), int(given[j])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def grouped() -> Iterator[tuple[int, int]]:
            rows, at = [], None
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if at != row[:3] and rows:
                        yield from links(rows)
                        rows = []
                    at = row[:3]
                    rows.append(row)
            if rows:
                yield from links(rows)

        a, b = zip(*found, strict=True) if (found := list(grouped())) else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return own.unionByName(asking).repartition("centre", "_x", "_y").sortWithinPartitions("centre", "_x", "_y").mapInArrow(run, "a long, b long")


def _merged(first: DataFrame, links: DataFrame) -> DataFrame:
    """first (id, component), its components joined by links (a, b) between them; lone ids in links are components of one."""
    if common.fits(links, 0):
        return first
    second = components(links).select(F.col("id").alias("component"), F.col("component").alias("_to"))
    held = first.groupBy("component").agg(F.count("*").alias("_held")).join(second, "component", "left")
    moved = common.spread_join(first, common.materialize(held, "nd-held"), "component", "_held").select("id", F.coalesce("_to", "component").alias("component"))
    lone = second.join(first, second["component"] == first["id"], "left_anti").select(F.col("component").alias("id"), F.col("_to").alias("component"))
    return common.materialize(moved.unionByName(lone), "nd-merged")


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and keeper (whether the row is one of the component's least id and text) of each row."""
    if percent < 80:
        raise ValueError("signatures are made for similarities of 0.8 and more")
    rows = common.materialize(sketches(docs, width), "nd-sketch")
    # known ids come before null ones
    least = lambda: F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    found = rows.where("digest is not null").groupBy("digest").agg(F.min(least()).alias("_least"), F.first("sig").alias("sig"), F.count("*").alias("rows"))
    classes = common.materialize(found.select("digest", F.col("_least.doc_id"), F.col("_least.text_key"), "sig", "rows", F.monotonically_increasing_id().alias("node")), "nd-classes")

    stars = common.materialize(_star_pairs(classes), "nd-stars")
    compared = common.materialize(_stars(docs, classes, stars, width, percent), "nd-compared")
    first = components(compared.where("linked"))
    members = compared.join(first, compared["b"] == first["id"], "left").select(F.col("a").alias("centre"), F.col("b").alias("node"), F.coalesce("component", "b").alias("comp"), "size", "lacks", "adds")
    members = common.materialize(members.join(classes.select("node", "sig"), "node"), "nd-members")
    final = _merged(first, common.materialize(_links_across(members, percent), "nd-links"))

    placed = classes.join(final, classes["node"] == final["id"], "left").select("digest", "rows", F.coalesce("component", "node").alias("comp"), least().alias("_least"))
    placed = common.materialize(placed, "nd-placed")
    groups = placed.groupBy("comp").agg(F.min("_least").alias("_keeper"), F.count("*").alias("_n"))
    by_digest = common.spread_join(placed, common.materialize(groups, "nd-groups"), "comp", "_n").select("digest", "rows", "_keeper")
    told = common.spread_join(rows.where("digest is not null").drop("sig"), common.materialize(by_digest, "nd-digests"), "digest", "rows")
    keeper = F.col("doc_id").eqNullSafe(F.col("_keeper.doc_id")) & (F.col("text_key") == F.col("_keeper.text_key"))
    told = told.select("doc_id", "text_key", "n_shingles", F.col("_keeper.doc_id").alias("component_id"), keeper.alias("keeper"))
    # rows without a shingle stand alone
    return told.unionByName(rows.where("digest is null").select("doc_id", F.lit(None).cast("binary").alias("text_key"), "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("keeper")))


def link(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked id) and kept for each row of docs (doc_id, text).

    Texts are taken whole; words are runs of other than ASCII white space, A-Z folded.
    A text of fewer words than width is one shingle, a null or empty one has no shingle
    and stands alone. Each row is linked by its own text: rows that repeat an id and text
    get the same component, rows of one id with different texts only if these are linked.
    Rows whose id is null are linked like others but have no say in component_id, which
    is null where no linked row has an id; kept is doc_id = component_id, null equal to
    null. percent must be 80 or more.
    """
    return _grouped(docs, width, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked rows of docs (doc_id, text); all columns stay, whatever their names.

    Kept is the row of the smallest id, a null id being the largest; of several texts of
    that id, the one of the least digest; of rows that repeat id and text, any one. Rows,
    not ids, are dropped: another text of a dropped row's id stays if nothing is linked
    with it. Rows of null, empty or blank texts all stay. An empty table stays empty.
    """
    marks = _grouped(docs, width, percent).where("text_key is not null").groupBy("doc_id", "text_key").agg(F.max("keeper").alias("keeper"), F.count("*").alias("_n"))
    marks = common.materialize(marks, "nd-marks")
    text, row_id = common.free_name(docs, "_nd_text"), common.free_name(docs, "_nd_id")
    keyed = docs.withColumns({text: _text_key(), row_id: F.col("doc_id").cast("long")})

    def marked(which: Column, how: str) -> DataFrame:
        ids = marks.where(which).select(F.col("doc_id").alias("_mark_id"), F.col("text_key").alias("_mark_text"))
        ids = F.broadcast(ids) if common.fits(ids, BROADCAST_IDS) else ids
        return keyed.alias("_d").join(ids.alias("_m"), F.expr(f"_d.`{text}` = _m._mark_text and _d.`{row_id}` <=> _m._mark_id"), how)

    again = F.col("keeper") & (F.col("_n") > 1)
    out = marked(~F.col("keeper") | again, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if common.fits(marks.where(again), 0):
        return out
    one = marked(again, "left_semi").groupBy(text, row_id).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row"))
    return out.unionByName(one.select("_row.*"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component of near-duplicates each is in."""
    return link(common.text_sources(spark, sf_dir, "documents"))
