"""Hand-worked cases and brute-force comparisons of the linkage operators."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kithline.functions import fuzzy
from kithline.functions import text as T
from kithline.operators import decide, evaluate, learn, similarity, windows
from kithline.plans import registry
from kithline.sources import io

SF = "/root/testdata/sf0.001"


def one(spark, name, address=""):
    return similarity.records(spark.createDataFrame([(1, 1, "x", name, address)], "entity_id long, src int, country string, business_name string, business_address string")).first()


def test_normalise(spark):
    r = one(spark, "Smith & Sons Private Limited d/b/a ACME.com", "Door No 00709, Rue Saint-Denis")
    assert (r.name_n, r.name_alt, r.is_domain) == ("smith & sons pvt ltd d b a acme com", "acme com", 0)
    assert (r.addr_n, r.nums) == ("709 r st denis", "709")
    assert one(spark, "Formerly Cabrera").name_alt == ""
    r = one(spark, "ipower.com")
    assert (r.is_domain, r.name_n, r.addr_n, r.nums, r.addr_empty) == (1, "ipower com", "", "", 1)


def test_fold_any(spark):
    out = spark.createDataFrame([("Straße Çà",), ("दो २३",)], "s string").select(T.fold("s").alias("a"), T.fold_any("s").alias("b")).collect()
    assert out[0].a == "strasse ca" and out[1].b.endswith("23")


def test_record_tokens(spark):
    row = spark.range(1).select(T.record_tokens(*(F.lit(x) for x in ("ab", "", "ab", "x", "5"))).alias("t")).first()
    assert row.t == ["n_ab", "c_#ab", "c_ab#", "a_x", "d_5"]


def test_core_names_of_a_tiny_country_fall_back(spark):
    raw = spark.createDataFrame([(i, 1, "x", f"acme {i}", "") for i in range(9)], "entity_id long, src int, country string, business_name string, business_address string")
    assert all(r.name_core == r.name_n for r in similarity.core_names(similarity.records(raw)).collect())


def test_margins(spark):
    rows = [(1, 1, 0.9), (1, 2, 0.4), (1, 3, None), (2, 1, 0.3), (3, 1, 0.5), (3, 2, 0.5)]
    out = windows.with_margins(spark.createDataFrame(rows, "q long, s1 long, p double"), ["p"]).orderBy("q", "s1").collect()
    assert [round(r.p_margin, 9) for r in out] == [0.5, -0.5, -0.9, 0.3, 0, 0]


def test_threshold_takes_the_smaller_id_on_ties(spark):
    pairs = spark.createDataFrame([(1, 7, 0.6), (1, 3, 0.6)], "q long, s1 long, p double")
    assert [r.s1 for r in decide.threshold(pairs, 0.6).collect()] == [3]


def brute_expected(rows, alpha):
    clip = {(q, s): min(max(p, 1e-6), 1 - 1e-6) ** alpha for q, s, p in rows}
    best = {}
    for (q, s), p in clip.items():
        if q not in best or (p, -s) > (clip[q, best[q]], -best[q]):
            best[q] = s
    out = set()
    for s in {s for _, s in clip}:
        mine = sorted(((p, -q) for (q, x), p in clip.items() if x == s and best[q] == s), reverse=True)
        e_true, none = sum(p for (q, x), p in clip.items() if x == s), math.prod(1 - p for (q, x), p in clip.items() if x == s)
        cum, top = 0.0, (-1.0, 0)
        for k, (p, _) in enumerate(mine, 1):
            cum += p
            ef = 1.25 * cum / (0.25 * e_true + k)
            if ef > top[0]:
                top = (ef, k)
        if top[0] > none:
            out |= {(-q, s) for _, q in mine[: top[1]]}
    return out


def test_expected_f_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(q, s, rng.random()) for q in range(40) for s in rng.sample(range(8), 3)]
    got = {(r.q, r.s1) for r in decide.expected_f(spark.createDataFrame(rows, "q long, s1 long, p double"), 1.5).collect()}
    assert got == brute_expected(rows, 1.5)


def test_macro_f05(spark):
    spine = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "s1 long, country string")
    truth = spark.createDataFrame([(10, 2), (11, 2)], "q long, s1 long")
    pred = spark.createDataFrame([(10, 2), (12, 3)], "q long, s1 long")
    for f in (evaluate.macro_f05, evaluate.macro_f05_sets):
        assert f(spine, truth, pred).first().score == pytest.approx(0.61111, abs=1e-5)


def test_id_lists(spark):
    spine = spark.createDataFrame([("a",), ("b",)], "s1 string")
    pairs = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x")], "s1 string, q string")
    assert {(r.s1, r.matched_ids) for r in io.id_lists(spine, pairs).collect()} == {("a", "x,y"), ("b", "")}


def test_tsv_keeps_quotes_and_empty_cells(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text('entity_id\tbusiness_name\n1\tsay "hi"\n2\t\n3\tNA\n')
    assert [r.business_name for r in io.read_tsv(spark, str(path)).orderBy("entity_id").collect()] == ['say "hi"', "", "NA"]


@pytest.mark.parametrize(
    ("score", "a", "b", "want"),
    [
        ("ratio", "abc", "abd", 66.6667), ("ratio", "", "", 100), ("token_sort_ratio", "b a", "a b", 100), ("token_set_ratio", "a b", "a b c", 100),
        ("token_set_ratio", "", "", 0), ("partial_ratio", "abc", "xxabcxx", 100), ("partial_ratio", "", "a", 0), ("jaro_winkler", "martha", "marhta", 0.961111),
    ],
)
def test_fuzzy(score, a, b, want):
    assert fuzzy.SCORERS[score](a, b) == pytest.approx(want, abs=1e-4)


def test_lcs_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc ", k=rng.randrange(12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert fuzzy.lcs(a, b) == t[-1][-1]


def test_pseudo_labels(spark):
    rows = [(1, 1, 0.98), (1, 2, 0.10), (2, 1, 0.98), (2, 2, 0.30)]
    out = learn.pseudo_labels(spark.createDataFrame(rows, "q long, s1 long, p double"), F.lit(True))
    assert {(r.q, r.s1, r.kind) for r in out.where("kind <> 'easy'").collect()} == {(1, 1, "positive"), (1, 2, "hard")}


def test_gbm_takes_missing_values_and_learns(spark):
    rows = spark.range(400).select(F.col("id").alias("q"), (F.col("id") % 7).alias("s1"), F.when(F.col("id") % 5 > 0, (F.col("id") % 10) / 10.0).alias("x"), (F.col("id") % 10 > 6).cast("int").alias("label"))
    model = learn.train_gbm(rows, ["x"], 3)
    loss = learn.predict([model], rows, ["x"]).agg(learn.logloss(F.col("p"), F.col("label"))).first()[0]
    assert loss < 0.6 and learn.importance(model, ["x"])[0][0] == "x"


@pytest.mark.parametrize("name", ["best_per_q", "decide_expected_f", "threshold_sweep", "win_graph_features", "tfidf_block", "block_country", "core_names", "pseudo_labels", "diag_fn_types", "decide_by_country"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    clean = lambda rows: sorted(repr([round(float(v), 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert clean([r[c] for c in cols] for r in df.collect()) == clean([r[i] for i in at] for r in found.fetchall())


def test_resolve_gives_each_entity_once(spark):
    out = registry.queries()["resolve"](spark, SF).collect()
    qs = [q for r in out for q in r.matched_ids.split(",") if q]
    assert len({r.s1 for r in out}) == len(out) and len(qs) == len(set(qs))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def blocked(spark):
    rows = [(1, 1, "x", "alpha beta", "road 1"), (4, 1, "x", "gamma delta", "lane 2"), (2, 2, "x", "alpha beta", "road 1"), (3, 3, "x", "alphas betas", "roads 17")]
    raw = spark.createDataFrame(rows, "entity_id long, src int, country string, business_name string, business_address string")
    recs = similarity.encoded(similarity.bag(similarity.core_names(similarity.records(raw), 1.0)))
    return recs, similarity.block(recs, 1.0, 1, vectors=recs, emb_k=2)


def test_block_holds_pairs_of_the_dense_search_with_both_scores(spark):
    got = {(r.q, r.s1): r for r in blocked(spark)[1].collect()}
    assert set(got) == {(2, 1), (2, 4), (3, 1), (3, 4)} and got[2, 4].tfidf < got[2, 1].tfidf
    assert (got[2, 1].rank, got[2, 1].emb_rank, got[2, 4].rank, got[2, 4].emb_rank) == (1, 1, 2, 2) and abs(got[2, 1].emb - 1) < 1e-5


def test_batches_score_as_single_pairs_do():
    rng = random.Random(11)
    words = ["alpha", "beta", "st", "été", "x", "co", "9", "日本"]
    text = lambda: " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 4, 12, 40])))
    a, b = ([text() for _ in range(400)] for _ in range(2))
    a += ["abc", "", "", "x" * 64, "x" * 65, "ab" * 70, "\0a"]
    b += ["bca", "", "q", "x" * 64 + "y", "y" + "x" * 64, "ba" * 80, "a\0"]
    for name, one in fuzzy.SCORERS.items():
        assert fuzzy.scored(name, a, b).tolist() == pytest.approx([one(x, y) for x, y in zip(a, b)], abs=1e-9), name
    assert [x != x for x in fuzzy.scored("ratio", ["a", None], [None, "b"])] == [True, True]


def test_pair_scores_cross_to_python_once(spark):
    from kithline.operators import features

    one = dict.fromkeys(["name_n", "name_core", "name_sq", "addr_n", "nums"], "a b 1") | {"name_alt": ""}
    both = spark.createDataFrame([{f"{s}_{c}": v for s in ("q", "s1") for c, v in one.items()} | {"q": 2, "s1": 1}, {f"{s}_{c}": None for s in ("q", "s1") for c in one} | {"q": 3, "s1": 1}], "q long, s1 long, " + ", ".join(f"{s}_{c} string" for s in ("q", "s1") for c in one))
    out = features.pairwise(both)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = {r.q: r for r in out.collect()}
    assert rows[2].name_ratio == 100 and rows[2].core_jw == 1 and rows[2].alt_tset is None and rows[3].addr_partial is None
