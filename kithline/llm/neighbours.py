"""Nearest neighbours by multiprobe p-stable hashing, with exact reranking.

Largest inner product becomes smallest distance by one more dimension that brings
all vectors to the length of the longest. A table hashes a vector with K functions
floor((a.x + b) / w), a normal (2-stable). A query visits in each table its own
bucket and those with some coordinates moved by one, ordered by the sum of squared
distances to the crossed boundaries, the estimated success order. How many functions
and tables there are and how many buckets a query visits is fitted on a bounded sample
against brute force: of the choices that find enough, the one that compares the fewest
rows and visits the fewest buckets. On vectors without structure that can be few
functions and nearly all rows, which is never much dearer than brute force.

Queries travel to buckets, not candidates to queries: a task holds a block of one
bucket's vectors, multiplies it with the queries that visit it in double precision
and keeps each query's best, so no row is made for a candidate. Equal vectors form
one class; of a class only its 21 smallest ids can be among anyone's 20 nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .shingles import mix

#: Functions of a table with the width of their cells, and numbers of tables, that are tried.
SHAPES = ((1, 2.0), (2, 2.0), (4, 2.0), (6, 2.0), (8, 2.0), (4, 0.5), (8, 0.5), (12, 0.5), (16, 0.5))
TABLES, SEED = (1, 2, 4, 8), 7
#: The sample that they and the number of probes are fitted on: rows, queries among them, and the recall wanted there.
SAMPLE_ROWS, SAMPLE_QUERIES, SAMPLE_RECALL = 8192, 96, 0.97
#: How many comparisons a visit to a bucket costs.
VISIT_COST = 64
#: Buckets that a query can visit in a table at most: all moves, or those of fewest coordinates. Fitting ends there.
MOST_PROBES = 2048
BLOCK_ROWS = 4096
#: Hits that a task gathers before it reduces them to each query's best.
HELD_HITS = 400_000


def _moves(functions: int) -> np.ndarray:
    """Moves by -1, 0 or 1 in each coordinate, those of few coordinates first, as long as all of so many come to at most MOST_PROBES."""
    rows, moved = [np.zeros((1, functions), np.int64)], 1
    while moved <= functions:
        own = []
        for at in combinations(range(functions), moved):
            part = np.zeros((2**moved, functions), np.int64)
            part[:, at] = list(product((-1, 1), repeat=moved))
            own.append(part)
        if sum(map(len, rows)) + sum(map(len, own)) > MOST_PROBES:
            break
        rows += own
        moved += 1
    return np.concatenate(rows)


class Index:
    """K functions for each table, the longest vector's length, and the number of tables and probes."""

    def __init__(self, dim: int, longest: float, functions: int, width: float, probes: int = 1, tables: int = 2) -> None:
        rng = np.random.default_rng(SEED)
        self.longest, self.k, self.width, self.probes, self.tables, self.compared = longest, functions, width, probes, tables, 1.0
        most = max(*TABLES, tables)
        self.a = rng.normal(size=(most, dim + 1, functions))
        self.b = rng.uniform(0, width, size=(most, 1, functions))
        self.moves = _moves(functions)

    def _place(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.a[table] + self.b[table]) / self.width

    @staticmethod
    def _key(cells: np.ndarray, table: int) -> np.ndarray:
        h = np.full(cells.shape[:-1], np.uint64(table + 1))
        for i in range(cells.shape[-1]):
            h = mix(h ^ cells[..., i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i))
        return h.view(np.int64)

    def buckets(self, v: np.ndarray, tables: int | None = None) -> np.ndarray:
        """(tables, rows): the bucket of each vector."""
        x = v / self.longest
        x = np.column_stack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))])
        return np.stack([self._key(np.floor(self._place(x, t)).astype(np.int64), t) for t in range(tables or self.tables)])

    def _visits_of(self, v: np.ndarray, table: int, probes: int) -> np.ndarray:
        x = np.column_stack([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros(len(v))])
        out = []
        for i in range(0, len(x), 64):  # costs are held for a few queries at a time
            at = self._place(x[i : i + 64], table)
            cell = np.floor(at)
            low, high = (at - cell) ** 2, (1 - at + cell) ** 2
            cost = low @ (self.moves == -1).T + high @ (self.moves == 1).T
            best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            out.append(self._key(cell.astype(np.int64)[:, None, :] + self.moves[best], table))
        return np.concatenate(out)

    def visits(self, v: np.ndarray) -> np.ndarray:
        """(tables, rows, probes): the buckets each query visits, in estimated success order."""
        return np.stack([self._visits_of(v, t, self.probes) for t in range(self.tables)])

    @classmethod
    def fitted(cls, sample: np.ndarray, longest: float, k: int, rows: int, shapes: tuple[tuple[int, float], ...] = SHAPES) -> Index:
        """The cheapest of the indexes of these shapes for a table of so many rows."""
        made = [cls(sample.shape[1], longest, *shape) for shape in shapes]
        costs = [index.fit(sample, k, rows) for index in made]
        return made[min(range(len(made)), key=lambda i: (costs[i], i))]

    def fit(self, sample: np.ndarray, k: int, rows: int) -> tuple:
        """Takes the tables and probes, powers of two, that find enough of the sample's neighbours at the least cost, which is returned.

        compared becomes the share of the sample's rows that a query is compared with (a row
        met in two tables counts twice). Where no choice finds enough, the one that finds most.
        """
        queries = sample[:SAMPLE_QUERIES]
        if len(sample) < 2:
            return (False, 0.0, 1, 1)
        scores = queries @ sample.T
        scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
        true = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
        own, best, steps = self.buckets(sample, max(TABLES)), None, [1]
        while steps[-1] < len(self.moves):
            steps.append(min(2 * steps[-1], len(self.moves)))
        found = {p: np.zeros(true.shape, bool) for p in steps}
        compared = dict.fromkeys(steps, 0.0)
        for t in range(max(TABLES)):
            keys, size = np.unique(own[t], return_counts=True)
            visits = self._visits_of(queries, t, len(self.moves))
            at = np.searchsorted(keys, visits)
            at[at == len(keys)] = 0
            there = np.where(keys[at] == visits, size[at], 0)
            where = np.full(true.shape, len(self.moves))
            for i in range(len(queries)):  # at which probe each true neighbour is met
                order = np.argsort(visits[i], kind="stable")
                pos = np.minimum(np.searchsorted(visits[i][order], own[t][true[i]]), len(order) - 1)
                where[i] = np.where(visits[i][order][pos] == own[t][true[i]], order[pos], len(self.moves))
            for p in steps:
                found[p] |= where < p
                compared[p] += there[:, :p].sum() / len(queries) / len(sample)
                if t + 1 in TABLES:
                    recall = found[p].mean()
                    cost = compared[p] * rows + VISIT_COST * (t + 1) * p
                    choice = (bool(recall < SAMPLE_RECALL), cost if recall >= SAMPLE_RECALL else -recall, t + 1, p)
                    if best is None or choice < best:
                        best, self.compared = choice, compared[p]
        self.tables, self.probes = best[2], best[3]
        return best


def _best(query: np.ndarray, cid: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """Of the hits each query's best distinct ones, ties to the smaller class."""
    order = np.lexsort((cid, -score, query))
    q, c, s = query[order], cid[order], score[order]
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (c[1:] != c[:-1])])
    q, c, s = q[new], c[new], s[new]
    first = np.concatenate([[True], q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return q[rank < keep], c[rank < keep], s[rank < keep]


def _lists(query: np.ndarray, cid: np.ndarray, score: np.ndarray):
    """A row for each query with the lists of its hits; the arguments are sorted by query."""
    import pyarrow as pa

    starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
    at = pa.array(np.append(starts, len(query)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(query[starts]), pa.ListArray.from_arrays(at, pa.array(cid)), pa.ListArray.from_arrays(at, pa.array(score))], ["query", "cids", "scores"])


def _valid(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where(e.isNotNull() & F.col("vec_id").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0))
    return rows


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shapes: tuple[tuple[int, float], ...] = SHAPES) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row whose vec_id is divisible by every.

    Vectors that are null, zero, hold a null or non-finite component or differ in length
    from most others take no part, nor do rows without an id. A repeated id counts once for
    each distinct vector, repeated rows once. Of equal scores the smaller id comes first. An
    empty table gives no rows.
    """
    rows = _valid(vectors)
    dim_row = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    spark, dim = vectors.sparkSession, dim_row["d"] if dim_row else 1
    rows = rows.where(F.size("embedding") == dim)
    ranked = rows.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    classes = ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.col("ids")[0])
    classes = common.materialize(classes.select("cid", "ids", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "embedding"), "ann-classes")
    n, longest = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    sample = [r[0] for r in classes.where(common.among_least(F.xxhash64("cid"), n, SAMPLE_ROWS)).orderBy(F.xxhash64("cid"), "cid").select("v").limit(SAMPLE_ROWS).toLocalIterator()]
    index = Index.fitted(np.array(sample), longest, k, n, shapes) if sample else Index(dim, 1.0, *shapes[0])

    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    alike = common.materialize(asked.groupBy("embedding").agg(F.count("*").alias("_n")).join(classes.select("cid", "embedding"), "embedding"), "ann-asked")
    asked = common.materialize(common.spread_join(asked, alike, "embedding", "_n").select("vec_id", "cid"), "ann-queries")
    query_vectors = classes.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "v")

    def spread(kind: int):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    v = np.array(part.column(1).to_pylist(), np.float64).reshape(part.num_rows, dim)
                    keys = index.visits(v) if kind else index.buckets(v)[:, :, None]
                    times = keys.shape[0] * keys.shape[2]
                    keys = keys.transpose(1, 0, 2).ravel()
                    ids = np.repeat(part.column(0).to_numpy(), times)
                    raw = [x.tobytes() for x in v for _ in range(times)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), pa.array(raw, pa.binary())], ["key", "cid", "v"])

        return run

    schema = "key long, cid long, v binary"
    members = common.materialize(classes.select("cid", "v").mapInArrow(spread(0), schema), "ann-index")
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_parts"))
    blocks = members.join(sizes, "key").select("key", F.pmod(F.xxhash64("cid"), F.col("_parts")).cast("int").alias("part"), F.lit(0).alias("kind"), "cid", "v")
    probes = query_vectors.mapInArrow(spread(1), schema).join(sizes, "key")
    probes = probes.select("key", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(1).alias("kind"), "cid", "v")

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hits, held, at, own, own_ids, whole, ids = [], 0, None, [], [], None, None

        def reduced() -> tuple[np.ndarray, ...]:
            return _best(*(np.concatenate(c) for c in zip(*hits, strict=True)), k + 1)

        for b in batches:
            key, part, kind, cid = (b.column(i).to_numpy() for i in range(4))
            v = np.frombuffer(b"".join(b.column(4).to_pylist()), np.float64).reshape(-1, dim)
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for x, y in zip(np.r_[0, cut], np.r_[cut, len(key)], strict=True):
                if x == y:
                    continue
                if at != (key[x], part[x]):
                    at, own, own_ids, whole = (key[x], part[x]), [], [], None
                if kind[x] == 0:
                    own.append(v[x:y])
                    own_ids.append(cid[x:y])
                    continue
                if not own:
                    continue
                if whole is None:
                    whole, ids = np.concatenate(own), np.concatenate(own_ids)
                for z in range(x, y, 512):
                    scores = v[z : min(z + 512, y)] @ whole.T
                    few = min(k + 1, len(ids))
                    least = np.partition(scores, len(ids) - few, axis=1)[:, len(ids) - few]
                    i, j = np.nonzero(scores >= least[:, None])
                    hits.append((cid[z : min(z + 512, y)][i], ids[j], scores[i, j]))
                    held += len(i)
                    if held > HELD_HITS:
                        hits = [reduced()]
                        held = len(hits[0][0])
                        if held > HELD_HITS // 2:  # that many queries: let the next step merge them
                            yield _lists(*hits[0])
                            hits, held = [], 0
        if hits:
            yield _lists(*reduced())

    def merge(batches: Iterator) -> Iterator:
        """The best of each query from the lists of all tasks; rows come sorted by query."""
        import pyarrow as pa

        held = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.float64))
        for b in batches:
            n = np.diff(b.column(1).offsets.to_numpy())
            new = (np.repeat(b.column(0).to_numpy(), n), b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy())
            q, c, s = _best(*(np.concatenate(x) for x in zip(held, new, strict=True)), k + 1)
            open_query = q == q[-1] if len(q) else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(x[~open_query]) for x in (q, c, s)], ["query", "cid", "score"])
            held = tuple(x[open_query] for x in (q, c, s))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["query", "cid", "score"])

    laid = blocks.unionByName(probes).repartition("key", "part").sortWithinPartitions("key", "part", "kind")
    lists = laid.mapInArrow(search, "query long, cids array<long>, scores array<double>")
    hits = lists.repartition("query").sortWithinPartitions("query").mapInArrow(merge, "query long, cid long, score double")

    def first(df: DataFrame, key: str, by: str, many: int, name: str = "_rank") -> DataFrame:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), by))).where(F.col(name) <= many)

    hits = common.materialize(hits, "ann-found")
    met = common.materialize(hits.groupBy("cid").agg(F.count("*").alias("_n")).join(classes.select("cid", "ids"), "cid"), "ann-met")
    hits = common.spread_join(hits, met, "cid", "_n").select("query", "score", F.explode("ids").alias("vec_id"))
    lists = first(hits, "query", "vec_id", k + 1).groupBy("query").agg(F.collect_list(F.struct("vec_id", "score")).alias("_hits"))
    lists = asked.groupBy("cid").agg(F.count("*").alias("_n")).join(lists.withColumnRenamed("query", "cid"), "cid")
    # each query takes its class's list, without itself
    out = common.spread_join(asked, common.materialize(lists, "ann-lists"), "cid", "_n")
    own = F.array_sort(F.transform(F.filter("_hits", lambda h: h["vec_id"] != F.col("vec_id")), lambda h: F.struct((-h["score"]).alias("less"), h["vec_id"].alias("vec_id"), h["score"].alias("score"))))
    out = out.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(own, 1, k)).alias("rank", "_hit"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("_hit.vec_id").alias("vec_id"), F.col("_hit.score").alias("score"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return nearest(common.text_sources(spark, sf_dir, "embeddings"))
