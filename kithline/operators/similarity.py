"""TF-IDF and dense candidate search.

A record's vector is one row with its terms; tokens in more than max_df of a country's
records are dropped. Queries and references of a country meet in blocks, as pairs of
matrices; no row is made for a token that two records share. Scores are ranked after
rounding, ties by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import io


def records(raw: DataFrame) -> DataFrame:
    """All normalised columns of raw records (entity_id, src, country, business_name, business_address)."""
    name, addr = F.col("business_name"), F.col("business_address")
    return raw.select(
        "entity_id", "src", "country", "business_name", "business_address", T.normalized(name).alias("name_n"), T.alias(name).alias("name_alt"),
        T.is_domain(name).alias("is_domain"), T.normalized(addr, T.ADDRESS_FILLERS).alias("addr_n"), T.numbers(addr).alias("nums"),
        name.rlike(r"[^\x00-\x7f]").cast("int").alias("name_nonascii"), (F.trim(addr) == "").cast("int").alias("addr_empty"),
    )


def document_frequency(recs: DataFrame, column: str = "name_n") -> DataFrame:
    """country, token and in how many of the country's records it occurs."""
    tokens = recs.select("country", F.explode(F.array_distinct(T.words(F.col(column)))).alias("token"))
    return tokens.groupBy("country", "token").agg(F.count("*").alias("df"))


def core_names(recs: DataFrame, df_frac: float = 0.005) -> DataFrame:
    """Adds name_core (without the country's generic words, or whole if nothing is left) and name_sq."""
    n = recs.groupBy("country").agg(F.count("*").alias("_n"))
    generic = document_frequency(recs).join(n, "country").where(F.col("df") > df_frac * F.col("_n"))
    # at most 1 / df_frac words times the words a name has, so a country's list is short
    lists = generic.groupBy("country").agg(F.collect_set("token").alias("_generic"))
    known = F.array_union(F.coalesce("_generic", F.array().cast("array<string>")), F.array(F.lit("&")))
    words = T.words(F.col("name_n"))
    with_lists = recs.join(lists, "country", "left").withColumn("_known", known)
    core = F.filter(words, lambda t: ~F.array_contains(F.col("_known"), t))
    out = with_lists.withColumn("name_core", F.when(F.size(core) > 0, F.array_join(core, " ")).otherwise(F.array_join(words, " ")))
    return out.withColumn("name_sq", F.replace("name_core", F.lit(" "), F.lit(""))).drop("_generic", "_known")


def bag(recs: DataFrame) -> DataFrame:
    return recs.withColumn("tokens", T.record_tokens(*(F.col(c) for c in ("name_core", "name_alt", "name_sq", "addr_n", "nums"))))


def term_vectors(recs: DataFrame, tokens: Column, max_df: float = 1.0) -> DataFrame:
    """country, entity_id, src and terms (token, w): sublinear term frequency, smoothed idf, unit length over kept tokens."""
    n = recs.groupBy("country").agg(F.count("*").alias("_n"))  # a row per country
    counted = F.transform(F.array_distinct(F.col("_t")), lambda t: F.struct(t.alias("token"), F.size(F.filter("_t", lambda x: x == t)).alias("c")))
    tf = recs.select("country", "entity_id", "src", tokens.alias("_t")).select("country", "entity_id", "src", F.explode(counted).alias("_x")).select("country", "entity_id", "src", "_x.*")
    df = tf.groupBy("country", "token").agg(F.count("*").alias("_df")).join(F.broadcast(n), "country").where(F.col("_df") <= max_df * F.col("_n"))
    idf = df.select("country", "token", (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("_idf"))
    raw = tf.join(idf, ["country", "token"]).withColumn("w", (1 + F.log("c")) * F.col("_idf"))
    whole = raw.groupBy("country", "entity_id", "src").agg(F.collect_list(F.struct("token", "w")).alias("_x"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return whole.select("country", "entity_id", "src", F.transform("_x", lambda x: F.struct(x["token"].alias("token"), (x["w"] / F.col("_norm")).alias("w"))).alias("terms"))


def tfidf(recs: DataFrame, tokens: Column, max_df: float = 1.0) -> DataFrame:
    """country, entity_id, src, token, w: a row for each term of the records' vectors."""
    return term_vectors(recs, tokens, max_df).select("country", "entity_id", "src", F.explode("terms").alias("_x")).select("country", "entity_id", "src", "_x.*")


def top_k(scored: DataFrame, score: str, k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc(F.round(score, 9)), "s1")
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def _in_blocks(records: DataFrame, columns: list[str], references: int, queries: int) -> tuple[DataFrame, DataFrame]:
    """Queries (src > 1) and references (src = 1) of one country, dealt so that each block of the ones meets each of the others.

    Both have country, _x (block of queries), _y (block of references), entity_id and columns.
    A reference goes to each block of queries and the other way round, so what is shuffled is
    a country's records times the number of blocks on the other side.
    """
    blocks = lambda which, size: F.ceil(F.sum(which.cast("int")) / size).cast("int")
    n = records.groupBy("country").agg(blocks(F.col("src") == 1, references).alias("_s"), blocks(F.col("src") > 1, queries).alias("_q"))  # a row per country
    placed = records.join(F.broadcast(n), "country").where("_s > 0 and _q > 0")
    part = lambda c: F.pmod(F.xxhash64("entity_id"), F.col(c)).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cols = ["country", "_x", "_y", "entity_id", *columns]
    return placed.where("src > 1").withColumn("_x", part("_q")).withColumn("_y", spread("_s")).select(*cols), placed.where("src = 1").withColumn("_y", part("_s")).withColumn("_x", spread("_q")).select(*cols)


def _block_search(queries: DataFrame, references: DataFrame, search, score: str) -> DataFrame:
    """search(queries, references) on each pair of blocks, as (q, s1, score)."""
    keys = ["country", "_x", "_y"]
    left, right = (df.select(*[F.col(c).alias(f"{side}{c}") for c in df.columns]) for side, df in (("q", queries), ("s", references)))
    return left.groupBy(*(f"q{k}" for k in keys)).cogroup(right.groupBy(*(f"s{k}" for k in keys))).applyInPandas(search, f"q long, s1 long, {score} double")


def sparse_topk(vectors: DataFrame, k: int = 8, least: float = 1e-6, references: int = 1 << 16, queries: int = 1 << 12) -> DataFrame:
    """q, s1, tfidf, rank: the k nearest source-1 records of the same country, from term vectors.

    Exact. A task holds one block of references as postings (token, reference, weight) and adds
    up the products of a few queries at a time; tokens are known by their 64-bit hashes there.
    """
    import numpy as np

    flat = vectors.select("country", "entity_id", "src", F.transform("terms", lambda x: F.xxhash64(x["token"])).alias("t"), F.transform("terms", lambda x: x["w"]).alias("w"))

    def search(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        none = pd.DataFrame({"q": [], "s1": [], "tfidf": []}).astype({"q": "int64", "s1": "int64", "tfidf": "float64"})
        if not len(a) or not len(b):
            return none
        ref, n = b["sentity_id"].to_numpy(), len(b)
        tokens, weight = np.concatenate(b["st"].to_list()), np.concatenate(b["sw"].to_list())
        owner = np.repeat(np.arange(n), b["st"].map(len))
        order = np.argsort(tokens, kind="stable")
        tokens, weight, owner = tokens[order], weight[order], owner[order]
        found, at_once = [none], max(1, (1 << 22) // n)
        for i in range(0, len(a), at_once):
            part = a.iloc[i : i + at_once]
            asked, own = np.concatenate(part["qt"].to_list()), np.concatenate(part["qw"].to_list())
            who = np.repeat(np.arange(len(part)), part["qt"].map(len))
            lo, hi = np.searchsorted(tokens, asked, "left"), np.searchsorted(tokens, asked, "right")
            many = hi - lo
            at = np.arange(many.sum()) + np.repeat(lo - np.cumsum(many) + many, many)
            scores = np.bincount(np.repeat(who, many) * n + owner[at], np.repeat(own, many) * weight[at], minlength=len(part) * n).reshape(len(part), n)
            few = min(k, n)
            best = np.maximum(np.partition(scores, n - few, axis=1)[:, n - few] - 1e-9, least)
            x, y = np.nonzero(scores >= best[:, None])
            kept = scores[x, y] > least
            found.append(pd.DataFrame({"q": part["qentity_id"].to_numpy()[x[kept]], "s1": ref[y[kept]], "tfidf": scores[x, y][kept]}))
        return pd.concat(found)

    return top_k(_block_search(*_in_blocks(flat, ["t", "w"], references, queries), search, "tfidf"), "tfidf", k)


def pair_dot(pairs: DataFrame, weights: DataFrame, name: str) -> DataFrame:
    """Adds the dot product of the two records' vectors to given pairs; 0 without a common token."""
    q = weights.select(F.col("entity_id").alias("q"), "token", F.col("w").alias("_a"))
    s = weights.select(F.col("entity_id").alias("s1"), "token", F.col("w").alias("_b"))
    dots = pairs.select("q", "s1").join(q, "q").join(s, ["s1", "token"]).groupBy("q", "s1").agg(F.sum(F.col("_a") * F.col("_b")).alias(name))
    return pairs.join(dots, ["q", "s1"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def summed(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def combined_cosine(qn: Column, qa: Column, sn: Column, sa: Column) -> Column:
    """Cosine of the summed name and address vectors, with 1e-6 in the denominator."""
    q, s = summed(qn, qa), summed(sn, sa)
    return dot(q, s) / (F.sqrt(dot(q, q)) * F.sqrt(dot(s, s)) + 1e-6)


def dense_topk(vectors: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """q, s1, emb, emb_rank: exact k nearest source-1 records of the same country by summed name and address vectors.

    Queries and references meet in blocks of one country (the stated query set against all
    references); a task multiplies two blocks and keeps each query's best, and a final
    ranking merges the blocks.
    """
    import numpy as np

    v = vectors.withColumn("v", summed(F.col("emb_name"), F.col("emb_addr"))).withColumn("v", F.transform("v", lambda x: x / (F.sqrt(dot(F.col("v"), F.col("v"))) + 1e-12)))

    def search(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "s1": [], "emb": []}).astype({"q": "int64", "s1": "int64", "emb": "float64"})
        scores = np.stack(a["qv"]) @ np.stack(b["sv"]).T
        few = min(k, scores.shape[1])
        least = np.partition(scores, scores.shape[1] - few, axis=1)[:, scores.shape[1] - few]
        i, j = np.nonzero(scores >= least[:, None] - 1e-9)
        return pd.DataFrame({"q": a["qentity_id"].to_numpy()[i], "s1": b["sentity_id"].to_numpy()[j], "emb": scores[i, j]})

    return top_k(_block_search(*_in_blocks(v, ["v"], block, block), search, "emb"), "emb", k, "emb_rank")


def encoded(recs: DataFrame) -> DataFrame:
    """Adds emb_name and emb_addr of the default encoder."""
    return recs.withColumns({"emb_name": hashed_vector(F.col("name_n")), "emb_addr": hashed_vector(F.col("addr_n"))})


def block(recs: DataFrame, max_df: float = 0.01, k: int = 8, vectors: DataFrame | None = None, emb_k: int = 5) -> DataFrame:
    """Candidate pairs of the TF-IDF search and, if vectors are given, of the dense one.

    Every pair has tfidf (0 for pairs without a common token) and its rank; with vectors
    (entity_id, src, country, emb_name, emb_addr) emb and emb_rank too, whichever search found it.
    """
    terms = io.rewritten(term_vectors(recs, F.col("tokens"), max_df), "terms")
    weights = terms.select("entity_id", F.explode("terms").alias("_x")).select("entity_id", "_x.*")
    ranked = lambda df, score, rank: df.withColumn(rank, F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round(score, 9)), "s1")))
    pairs = sparse_topk(terms, k).select("q", "s1")
    if vectors is None:
        return ranked(pair_dot(pairs, weights, "tfidf"), "tfidf", "rank")
    pairs = pairs.union(dense_topk(vectors, emb_k).select("q", "s1")).distinct()
    side = lambda p: vectors.select(F.col("entity_id").alias(p), F.col("emb_name").alias(f"_{p}_n"), F.col("emb_addr").alias(f"_{p}_a"))
    both = pair_dot(pairs, weights, "tfidf").join(side("q"), "q").join(side("s1"), "s1")
    scored = both.withColumn("emb", combined_cosine(*(F.col(c) for c in ("_q_n", "_q_a", "_s1_n", "_s1_a")))).select("q", "s1", "tfidf", "emb")
    return ranked(ranked(scored, "tfidf", "rank"), "emb", "emb_rank")


def same_name(recs: DataFrame, pairs: DataFrame) -> DataFrame:
    """How many source-1 records carry the sorted name of either side of a pair."""
    keyed = recs.withColumn("_key", F.concat("country", F.lit("|"), T.sorted_tokens(F.col("name_n"))))
    n = keyed.where("src = 1").groupBy("_key").agg(F.count("*").alias("_n"))
    of = keyed.join(n, "_key", "left").select("entity_id", F.coalesce("_n", F.lit(0)).alias("_n"))
    out = pairs.join(of.select(F.col("entity_id").alias("q"), F.col("_n").alias("q_same_name")), "q")
    return out.join(of.select(F.col("entity_id").alias("s1"), F.col("_n").alias("s1_same_name")), "s1")


def rarity(recs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Eight rarity features of given pairs."""
    from .windows import with_margins

    out = pairs.select("q", "s1")
    for name, tokens in (("addr_idf", T.words(F.col("addr_n"))), ("name_idf", T.words(F.col("name_n"))), ("name_cidf", T.word_trigrams(F.col("name_n")))):
        out = pair_dot(out, tfidf(recs, tokens), name)
    return same_name(recs, with_margins(out, ["addr_idf", "name_idf", "name_cidf"]))


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """Unit vector of hashed character 3-grams, the default encoder; null and empty texts are encoded as "query: -"."""
    # an expression named in a lambda is computed anew for each element, so each value is bound once
    let = lambda value, body: F.transform(F.array(value), body)[0]
    # from code points, so that any SQL engine gives the same vectors
    code = lambda g, i, m: F.ascii(F.substring(g, i, F.lit(1))).cast("long") * m
    bucket = lambda g: ((code(g, F.lit(1), 7919) + code(g, F.lit(2), 104729) + code(g, F.lit(3), 1299709)) % 9973 % dim).cast("int")
    each = F.sequence(F.lit(0), F.lit(dim - 1))
    given = F.concat(F.lit("query: "), F.when(F.coalesce(F.trim(text), F.lit("")) == "", "-").otherwise(text))
    at = let(given, lambda t: F.transform(T.trigrams(t), bucket))
    counts = let(at, lambda a: F.transform(each, lambda i: F.size(F.filter(a, lambda x: x == i)).cast("double")))
    unit = lambda c: let(F.sqrt(dot(c, c)), lambda n: F.transform(c, lambda x: (x / n).cast("float")))
    return let(counts, unit)
