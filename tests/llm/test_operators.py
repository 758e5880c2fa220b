"""Each operator against a brute-force version, a round trip or held-out accuracy, and on odd rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kithline.llm import common, components, decontaminate, language, licenses, near_dedup, neighbours, packing, shingles, token_ids, token_output, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"
WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "  ", "a", "Σας ΑΣ", "é ½ ¿qué? ²", "<|endoftext|> x", "tab\tand\r\n\nlines ", " lead  two", "x\x1cy", "日本語 テキスト", "word " * 30000, "z" * 300000]


def odd_docs(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "null id here too", "en", "s", 1), (1, "", None, None, None), (3, "a", None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("_digest", F.lit("clash")).withColumn("sig", F.lit(1))


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_cached_encoding_equals_the_library():
    rng = random.Random(5)
    texts = [t for t in ODD if t] + ["".join(rng.choices("ab Z'9.é\n\t-_ñß’ \u00a0\u3000", k=rng.randrange(40))) for _ in range(300)]
    for path, lead in ((WORD, False), (BYTE, True)):
        e = token_ids.TokenEncoder(path, lead, cache_words=50)
        for t in texts:
            assert np.frombuffer(e.encode(t), "<u4").tolist() == ids_of(path, t), t[:80]


def test_packing_covers_each_id_once(spark):
    docs = odd_docs(spark).union(odd_docs(spark)).repartition(2)
    rows = packing.pack(docs, WORD, keep_ids=True).collect()
    want = sorted(tuple([*ids_of(WORD, t or ""), 1]) for t in [*ODD, "null id here too", "", "a"] * 2)
    whole, seqs = {}, {}
    for r in rows:
        raw = np.array(r.ids, "<u4").tobytes()
        assert zlib.crc32(raw) == r.ids_crc32 and len(r.ids) == r.length > 0
        seqs.setdefault(r.sequence_id, []).append(r)
    assert sum(r.length for r in rows) == sum(map(len, want))
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        n = sum(r.length for r in s)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s[:-1])]).tolist() and n <= 2048
        assert s[0].padding == (0 if n & (n - 1) == 0 else 2048 - n)
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (_, total), pieces in by_doc.items():
        starts = sorted((p.start, p.length) for p in pieces)
        assert sum(n for _, n in starts) % total == 0
    assert sum(s[0].padding for s in seqs.values()) <= 2 * 2048
    whole.clear()
    assert packing.pack(docs.limit(0), WORD).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    docs = odd_docs(spark)
    token_output.write_tokens(docs, f"file://{tmp_path}/t", BYTE, 2, True, files=3)
    rows = token_output.read_tokens(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is not None, x))
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    assert all(r.ids == [*ids_of(BYTE, ODD[r.doc_id] or ""), 2] for r in rows if r.doc_id is not None)
    crc = {(r.start): r.ids_crc32 for r in token_output.digests(token_output.read_tokens(spark, f"file://{tmp_path}/t")).collect()}
    assert all(crc[r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)


def test_warc_round_trip_at_any_split(spark, tmp_path):
    pages = [(1, "http://a.b/ü x", b"same"), (2, None, b"same"), (3, "http://c", b""), (4, "u", None), (5, "v", bytes(range(256)) * 500), (None, "w", b"same"), (5, "v", bytes(range(256)) * 500), (7, "x", warc.MAGIC * 50)]
    df = spark.createDataFrame(pages, "id long, url string, payload binary").withColumn("_owner", F.lit(1))
    made = warc.write_warc(warc.with_revisits(df).coalesce(1), f"file://{tmp_path}/w").collect()
    archives = spark.createDataFrame(made)
    for split in (17, 1000, 1 << 22):
        got = warc.read_warc(archives, split_bytes=split).collect()
        assert len(got) == len(pages)
        kinds = {(r.record_id, r.record_type, r.refers_to) for r in got}
        assert kinds == {("1", "revisit", "2"), ("2", "response", None), ("3", "revisit", "4"), ("4", "response", None), ("5", "response", None), ("", "revisit", "2"), ("7", "response", None)}
        for r in got:
            body = next((p or b"") for i, _, p in pages if str(i if i is not None else "") == r.record_id)
            assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
            assert r.record_type == "revisit" or bytes(r.payload) == body
    (tmp_path / "bad.gz").write_bytes(open(made[0].path.removeprefix("file://"), "rb").read()[:-30])
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark.createDataFrame([(f"file://{tmp_path}/bad.gz", made[0].bytes - 30)], "path string, bytes long")).collect()


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        least[x] = min(d, least.get(x, d))
    return {d: (len(s), least[x]) for (d, _), s, x in zip(rows, sets, label)}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, width, percent):
    rng, rows = random.Random(9), []
    for base in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([4, 60, 150]))]
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(999)}"
            rows.append(" ".join(copy) if rng.random() < 0.8 else " ".join(words).upper())
    rows += ["", " \t", "one", "one two", "ONE  two"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link(docs, width, percent).collect()}
    assert got == brute_components(rows, width, percent)
    kept = {r.doc_id for r in near_dedup.keep_one(docs, width, percent).collect()}
    assert kept == {d for d, (_, c) in got.items() if d == c}


def test_near_duplicates_of_odd_rows(spark):
    out = near_dedup.link(odd_docs(spark)).collect()
    assert len(out) == len(ODD) + 3
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert near_dedup.link(odd_docs(spark).limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_long_words_and_texts_hash_alike_in_any_block():
    h = shingles.WordHasher(b" ")
    words = ["a" * 700_000, "b", "c" * 10] * 3
    got = h.words(" ".join(words).encode())
    assert len(got) == 9 and len(set(got.tolist())) == 3 and got.tolist() == got.tolist()[:3] * 3


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, size=(600, 1))
    x[100:160] = x[99]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (None, [1.0] * 16), (760, [1.0, None] * 8), (780, [1.0])]
    out = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1))).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-9)
    assert set(got) == set(range(0, 600, 20))
    recall = []
    for q, found in got.items():
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        recall.append(len(set(best) & set(found)) / 20)
        assert len(found) == 20
    assert np.mean(recall) >= 0.9
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_url_rules(spark):
    urls = [None, "nothing", "http://A.NET/x", "http://a.example.net/en/1?q", "http://example.com/de/", "http://example.com/de", "x://b.org/fr/#a", "http://net", "http://notnet.example/", "a://b://c/d", "http://cheap-pills.example/win-now"]
    rows = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))).collect()}
    assert [rows[i].rule for i in range(11)] == [None, None, "net/", "example.net/en/", "example.com/de/", None, "org/fr/", None, None, None, None]
    assert [rows[i].host for i in (0, 1, 2, 9)] == ["", "", "a.net", "b:"] and rows[3].path == "/en/1"
    assert rows[2].verdict == "block" and rows[3].verdict == "allow" and rows[0].verdict == "allow" and rows[10].verdict == "block"


def test_licences(spark):
    mit = licenses.LICENCES[0][1]
    texts = [mit.upper().replace("COPYRIGHT (C) HOLDER", "Copyright 2020 Jane Doe, all rights"), mit.replace("sublicense", "sublicence") + "\n\n", None, "a\nReleased under the MIT Licence!\nSPDX-License-Identifier:  GPL-3.0", mit[:-20]]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("license_id", F.lit(1))).collect()}
    assert [rows[i].license_id for i in range(5)] == ["MIT", "MIT", None, None, None] and rows[3].notices == "GPL-3.0,MIT"


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 5, 9, 40])))) for i in range(30)] + [(90, None), (91, ""), (92, "...")]
    docs = []
    for d in range(120):
        own = [word() for _ in range(rng.choice([3, 50, 3000]))]
        if d % 2:
            w = (items[rng.randrange(30)][1]).upper().split()
            if len(w) > 20 and d % 4 == 1:
                w[rng.randrange(len(w))] = "changed"
            own[len(own) // 2 : len(own) // 2] = [x + "," for x in w]
        docs.append((d, " ".join(own)))

    def grams(text, k):
        w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)

    want = set()
    for i, t in items:
        n = grams(t, 1)[1]
        own = grams(t, min(5, n))[0] if n else set()
        for d, text in docs:
            if own and 10 * len(own & grams(text, min(5, n))[0]) >= 8 * len(own):
                want.add((d, i))
    frame = spark.createDataFrame([*docs, (500, None), (501, "")], "doc_id long, text string").withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()} == want and want
    assert {r.doc_id for r in decontaminate.clean(frame, bench).collect()} == {d for d, _ in [*docs, (500, 0), (501, 0)]} - {d for d, _ in want}


def test_language_spans_and_scripts(spark):
    samples = [(i, "the quick brown fox and the other things of that", "en") for i in range(9)] + [(i + 20, "der schnelle braune fuchs und die anderen dinge nicht", "de") for i in range(9)] + [(i + 40, "это быстрая лиса и другие вещи", "ru") for i in range(9)]
    model = language.fit(spark.createDataFrame(samples, "doc_id long, text string, lang string"))
    texts = [*ODD, "the other quick things of that fox and the brown und die anderen dinge nicht der schnelle braune fuchs", "другие вещи", "123 !! —"]
    rows = {r.doc_id: r for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit(1)), model).collect()}
    n = len(ODD)
    assert [s.lang for s in rows[n].spans] == ["en", "de"] and rows[n + 1].lang_pred == "ru"
    assert all(rows[i].lang_pred == "und" for i in (0, 1, 2, n + 2)) and all(0 <= r.score <= 1 for r in rows.values())
    empty = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.identify(odd_docs(spark), empty).collect()} == {"und"}


def test_language_accuracy_on_held_out_rows(spark):
    got = language.op8_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.97


def test_toxicity_on_planted_words(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices(["er", "an", "th", "on", "in", "ed", "st"], k=rng.randrange(1, 5)))
    rows = []
    for i in range(600):
        w = [word() for _ in range(rng.randrange(20, 200))]
        if i % 4 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["Idiot", "moron", "scumbag", "worthless"]))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("_id", F.lit(1))
    model = toxicity.fit(docs.where("doc_id < 400"), docs.where("doc_id < 400").select("doc_id", "toxic"))
    got = toxicity.score(docs.where("doc_id >= 400").drop("toxic"), model).join(docs.select("doc_id", "toxic"), "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    assert right >= 0.9
    odd = toxicity.score(odd_docs(spark), model).collect()
    assert len(odd) == len(ODD) + 3 and all(0 <= r.score <= 1 for r in odd) and all(r.score == 0 for r in odd if r.doc_id in (0, 1))
    blank = toxicity.fit(docs, docs.select("doc_id", "toxic").limit(0))
    assert {r.score for r in toxicity.score(odd_docs(spark), blank).collect()} == {0.0}


def test_toxicity_learns_parts_that_tell_in_the_smaller_language_only():
    """Toxic words of the second language share their beginning with ordinary words of it, so that no part is 20 times as frequent."""
    rng = random.Random(3)

    def text(parts, toxic, own, odd):
        w = ["".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(rng.randrange(40, 120))]
        for _ in range(6 * toxic or int(rng.random() < odd)):
            w.insert(rng.randrange(len(w)), rng.choice(own) + rng.choice(parts))
        return " ".join(w).encode()

    english = lambda y: text(["er", "an", "th", "on", "in", "ed", "st"], y, ["moron", "scumbag"], 0)
    other = lambda y: text(["ül", "zu", "ge", "ö", "pf", "kei", "ß"], y, ["achlich"], 0.3)
    toxic = [(english if i % 4 else other)(True) for i in range(400)]
    plain = [(english if i % 4 else other)(False) for i in range(2400)]
    model = toxicity.ToxicityModel.train(toxic, plain, 1 / 7)
    scores = lambda y: model.scores([np.frombuffer(other(y), np.uint8) for _ in range(100)])
    assert (scores(True) >= toxicity.CUTOFF).mean() >= 0.8 and (scores(False) >= toxicity.CUTOFF).mean() <= 0.1


def test_toxicity_learns_from_toxic_text_itself(monkeypatch):
    """Toxic rows differ by a phrase of digits, which no list of words holds; the last rows count as much as the first."""
    rng = random.Random(4)
    text = lambda y: " ".join(str(rng.randrange(10**6)) for _ in range(60)) + " 4718 2295 6031 8854 1907 3346 " * 3 * y
    toxic, plain = ([text(y).encode() for _ in range(n)] for y, n in ((1, 400), (0, 1600)))
    model = toxicity.ToxicityModel.train(toxic, plain, 0.2)
    scores = lambda y: model.scores([np.frombuffer(text(y).encode(), np.uint8) for _ in range(100)])
    assert (scores(1) >= toxicity.CUTOFF).mean() >= 0.8 and (scores(0) >= toxicity.CUTOFF).mean() <= 0.1
    import zstandard

    drawn, made = [], zstandard.train_dictionary
    monkeypatch.setattr(zstandard, "train_dictionary", lambda size, pieces, **k: drawn.extend(pieces) or made(size, pieces, **k))
    toxicity.ToxicityModel._trained([text(0).encode() for _ in range(4000)] + [b"%d " % i + b"late row of letters " * 20 for i in range(1000)])
    share = sum(b"late" in p for p in drawn) / len(drawn)
    assert len(drawn) == toxicity.PIECES and 0.1 <= share <= 0.3


def test_toxicity_trains_on_few_short_equal_and_blank_rows():
    """Folds without rows, rows without a telling window and equal rows on both sides leave scores within 0 and 1."""
    texts = [np.frombuffer(t, np.uint8) for t in (b"x", b" ", b"some words " * 500, b"\xff\x00")]
    for toxic, plain in (([b"a"], [b"b"]), ([b"a b"] * 2, [b"c d"] * 3), ([b" "] * 9, [b"\n"] * 9), ([b"same words here"] * 40, [b"same words here"] * 40), ([b"z" * 5000] * 4, [b"words and words " * 300] * 30)):
        got = toxicity.ToxicityModel.train(toxic, plain, 0.1).scores(texts)
        assert len(got) == len(texts) and np.isfinite(got).all() and (got >= 0).all() and (got <= 1).all()


def test_pipeline_stages_keep_columns_and_only_drop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    was = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        now = {r.doc_id for r in out.collect()}
        assert now <= was and len(now) > 0.5 * len(was)
        docs, was = out, now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == was


def test_pipeline_on_odd_rows_and_empty_tables(spark):
    for docs in (odd_docs(spark), odd_docs(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_line_feeds_encode_as_the_library_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    from kithline.llm.token_ids import TokenEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, theirs = TokenEncoder(path, True), Tokenizer.from_file(path)
    parts = ("end.", "\n", "\n\n", "\n\n\n", "Next", "'s", "\t", " of", " 中", "É")
    for a in parts:
        for b in parts:
            for c in parts:
                text = f"x{a}{b}{c}y"
                assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, text


def test_least_hashes_are_among_those_that_pass(spark):
    rows = spark.range(20000).select(F.xxhash64("id").alias("h"))
    least = lambda df: [r.h for r in df.orderBy("h").limit(300).collect()]
    passed = rows.where(common.among_least(F.col("h"), 20000, 300))
    assert least(passed) == least(rows) and passed.count() < 1600
    assert rows.limit(1000).where(common.among_least(F.col("h"), 1000, 300)).count() == 1000


def near_copies(n, seed=6):
    """A text of 100 words and n variants of it, each with one other word in place (similarity about 0.94)."""
    rng = random.Random(seed)
    words = [f"v{seed}x{rng.randrange(10**6)}" for _ in range(100)]
    return " ".join(words), [" ".join([*words[:k], f"new{k}", *words[k + 1 :]]) for k in range(n)]


def test_near_duplicates_are_rows_not_ids(spark):
    a, c = (near_copies(0, s)[0] for s in (1, 2))
    rows = [(1, a, "x"), (1, a, "y"), (2, a, "z"), (2, c, "w"), (None, a, "n"), (None, c + " more", "n"), (9, None, "e"), (9, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string").withColumns({"_nd_text": F.lit(1), "_ND_ID": F.lit(2), "text_key": F.lit(3), "component_id": F.lit(4)})
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.where("text is not null").collect()) == [(1, a), (2, c)] and kept.where("text is null").count() == 2
    alone = near_dedup.keep_one(docs.where("doc_id is null or text is null")).collect()
    assert sorted(r.text for r in alone if r.text) == sorted([a, c + " more"])


def test_near_copies_of_a_repeated_ids_second_text_are_linked(spark):
    (a, _), (b, copies) = near_copies(0, 3), near_copies(60)
    rows = [(1, a), (1, b), *((10 + k, t) for k, t in enumerate(copies)), *((100 + k, a) for k in range(100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.link(docs).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {1}
    assert sorted(r.text for r in near_dedup.keep_one(docs).collect()) == sorted([a, b])


def test_near_duplicates_with_hot_keys_and_repeated_ids_against_all_pairs(spark, monkeypatch):
    """Every bound so low that all paths for hot keys and blocks are taken."""
    for module, name, value in ((common, "HOT_ROWS", 3), (near_dedup, "STAR_ROWS", 4), (near_dedup, "MOST_PARTS", 3), (near_dedup, "GROUP_BLOCK", 5), (near_dedup, "HOT_SAMPLE", 1), (near_dedup, "HOT_SEEN", 4), (near_dedup, "BROADCAST_IDS", 2)):
        monkeypatch.setattr(module, name, value)
    rng, texts = random.Random(12), []
    for _ in range(5):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 90]))]
        for _ in range(24):
            words[rng.randrange(len(words))] = f"x{rng.randrange(999)}"  # a chain: each differs in one word from the one before
            texts += [" ".join(words)] * rng.choice([1, 1, 3])
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link(docs).collect()}
    assert got == brute_components(rows, 3, 85)
    # ids that repeat over different texts: components as before, each called by its smallest id
    few = [(i % 40, t) for i, t in rows]
    want = brute_components(rows, 3, 85)
    least = {}
    for i, (_, c) in want.items():
        least[c] = min(least.get(c, i % 40), i % 40)
    again = near_dedup.link(spark.createDataFrame(few, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in again) == sorted((i % 40, want[i][0], least[want[i][1]]) for i, _ in rows)
    assert near_dedup.keep_one(spark.createDataFrame(few, "doc_id long, text string")).count() == len(least)


def best_labelling(cost, penalty):
    """The least total cost over all labellings of a text's words, by trying every one."""
    from itertools import product

    n, langs = cost.shape
    total = lambda path: sum(float(cost[i, j]) for i, j in enumerate(path)) + penalty * sum(a != b for a, b in zip(path, path[1:]))
    return min(map(total, product(range(langs), repeat=n))), total


def test_viterbi_against_every_labelling():
    rng = np.random.default_rng(3)
    for langs in (1, 2, 3):
        labeller = language.Labeller(language.LanguageModel([str(i) for i in range(langs)], np.zeros((1, langs)), np.ones((1, langs), bool)), penalty=1.5)
        lengths = [1, 6, 3, 7, 0, 2, 5]
        cost = rng.uniform(0, 3, size=(sum(lengths), langs)).astype(np.float32)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        label = labeller.viterbi(cost, bounds)
        for a, b in zip(bounds[:-1], bounds[1:]):
            least, total = best_labelling(cost[a:b], 1.5)
            assert total(label[a:b].tolist()) == pytest.approx(least, abs=1e-4)


def test_a_long_text_is_labelled_alike_in_any_blocks():
    samples = {"en": [b"the quick brown fox and other things of that"], "de": ["der schnelle braune fuchs und die anderen dinge nicht".encode()], "es": [b"el rapido zorro y las otras cosas que no"]}
    model, rng = language.LanguageModel.learn(samples), random.Random(2)
    words = " ".join(t[0].decode() for t in samples.values()).split()
    texts = [np.frombuffer(" ".join(rng.choices(words, k=k)).encode(), np.uint8) for k in (500, 1, 90, 0, 3000)]
    whole = language.Labeller(model, 4.0)(texts)
    for costs in (6, 30, 300, 3000):
        small = language.Labeller(model, 4.0, remember=20, step_costs=costs)(texts)
        assert all(np.array_equal(a[0], b[0]) for a, b in zip(whole, small, strict=True))


def test_more_languages_than_a_byte_counts(spark):
    rng = random.Random(7)
    own = {f"l{i:03}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(12)] for i in range(150)}
    rows = [(i, " ".join(rng.choices(words, k=30)), lang) for i, (lang, words) in enumerate(own.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs.drop("lang"), language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 150 and all(r.lang == r.lang_pred for r in got)


def test_wrapping_does_not_change_a_licence(spark):
    import textwrap

    texts = []
    for name, text in licenses.LICENCES:
        for width in (40, 60, 64, 68, 72, 76, 80, 92, 200):
            lines = [x for part in text.split("\n") for x in textwrap.wrap(part, width, break_long_words=False, break_on_hyphens=False)]
            texts.append((name, "Copyright (c) 2019-2021, Some One <a@b.c>\nAll rights reserved.\n\n" + "\n".join("  # " + x for x in lines)))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [name for name, _ in texts]
    odd = licenses.scan(odd_docs(spark).unionByName(odd_docs(spark))).collect()
    assert len(odd) == 2 * (len(ODD) + 3) and all(r.license_id is None for r in odd) and licenses.scan(docs.limit(0)).count() == 0


def test_step_groups_are_balanced_across_tasks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)
    rows = packing.pack(docs, WORD, group_tokens=8192).groupBy("step_group", "tier").agg(F.sum("length").alias("n"), F.sum("padding").alias("padding"), F.countDistinct("sequence_id").alias("windows")).collect()
    by_tier = {}
    for r in rows:
        by_tier.setdefault(r.tier, []).append(r)
    for tier, groups in by_tier.items():
        assert len({r.step_group for r in groups}) == len(groups)
        assert sum(r.windows != 8192 // tier for r in groups) <= 1  # the tier's last group
    assert len(rows) == len({r.step_group for r in rows})


def test_decontamination_in_many_blocks_equals_one(spark, monkeypatch):
    docs, bench = (common.text_sources(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    docs = docs.unionByName(docs.limit(20)).withColumn("_bench_key", F.lit(1))
    found = lambda: sorted((r.doc_id, r.item_id, r.containment) for r in decontaminate.contaminated(docs, bench).collect())
    kept = lambda: sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect())
    one = found(), kept()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert (found(), kept()) == one and one[0] and decontaminate.clean(docs, bench).columns == docs.columns
    for surplus in (1, 2, 50):
        monkeypatch.setattr(decontaminate, "SURPLUS", surplus)
        assert found() == one[0]
    for empty in (docs.limit(0), odd_docs(spark)):
        assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.clean(empty, bench).count() == empty.count()
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_url_regression_on_words_and_hosts_it_has_not_seen():
    table = url_filter.labelled_urls()
    rows = [(*url_filter._split(u), y) for u, y in table]
    kind = lambda h: next(i for i, p in enumerate(("www.", ".net", "blog.", "m.", "-site.info")) if p in h)
    seen = [r for r in rows if kind(r[0]) != 2]
    new = [r for r in rows if kind(r[0]) == 2]
    s = url_filter.scores(url_filter.train(seen), [h for h, _, _ in new], [p for _, p, _ in new])
    assert np.mean((s >= 0.5) == np.array([y for *_, y in new], bool)) >= 0.97
    made = url_filter.train(rows)
    bad = ["best-casino-slots.biz", "poker-betting.co", "xxxporn.tv", "free-viagra-pills.org", "keygen-warez.ru", "sexcams-dating.com"]
    good = ["city-library.gov", "university-museum.edu", "history-journal.org", "school-science.net", "weather-maps.org", "chess-archive.com"]
    s = url_filter.scores(made, bad + good, ["/"] * 12)
    assert (s[:6] >= 0.5).mean() >= 0.8 and (s[6:] < 0.5).mean() >= 0.8
    assert url_filter.scores(made, [], []).shape == (0,)


def test_other_tokenizer_files_are_encoded_by_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer as Tk

    for path, lead in ((WORD, False), (BYTE, True)):
        assert token_ids.TokenEncoder(path, lead).by_words and not token_ids.follows_known_rules(Tk.from_file(path), not lead)
        given = json.loads(Tk.from_file(path).to_str())
        given["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
        (tmp_path / "other.json").write_text(json.dumps(given))
        e = token_ids.TokenEncoder(str(tmp_path / "other.json"), lead)
        for text in ("Hello  there", "two words\nand more"):
            assert not e.by_words and np.frombuffer(e.encode(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_have_small_groups_dictionaries_and_page_indexes(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=300))) for i in range(4000)], "doc_id long, text string")
    token_output.write_tokens(docs, f"file://{tmp_path}/t", BYTE, 2, True, files=1, row_group_bytes=1 << 20, page_bytes=16 << 10)
    (file,) = glob.glob(f"{tmp_path}/t/*.parquet")
    meta = pq.ParquetFile(file).metadata
    ids = [c for c in range(meta.num_columns) if meta.row_group(0).column(c).path_in_schema.startswith("ids")]
    assert meta.num_row_groups > 1
    for g in range(meta.num_row_groups):
        column = meta.row_group(g).column(ids[0])
        assert "RLE_DICTIONARY" in column.encodings or "PLAIN_DICTIONARY" in column.encodings
        assert meta.row_group(g).column(0).has_column_index and meta.row_group(g).column(0).has_offset_index
    stored = spark.read.schema(token_output.STORED).parquet(f"file://{tmp_path}/t")
    plan = stored.where("doc_id = 77").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,77)" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_odd_and_empty_tables_of_the_remaining_operators(spark, tmp_path):
    pages = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "http://A.b/c"), (3, "http://x/" + "y" * 300000)], "page_id long, url string").withColumn("score", F.lit("clash"))
    rows = url_filter.judge(pages).collect()
    assert len(rows) == 5 and all(r.verdict in ("allow", "block") for r in rows) and url_filter.judge(pages.limit(0)).count() == 0
    none = spark.createDataFrame([], "id long, url string, payload binary")
    made = spark.createDataFrame(warc.write_warc(warc.with_revisits(none), f"file://{tmp_path}/w").collect(), "path string, bytes long")
    assert warc.read_warc(made).count() == 0
    long = spark.createDataFrame([(1, "u", bytes(range(256)) * 40000), (2, "u", bytes(range(256)) * 40000)], "id long, url string, payload binary")
    made = spark.createDataFrame(warc.write_warc(warc.with_revisits(long), f"file://{tmp_path}/l").collect())
    assert sorted((r.record_type, r.payload_bytes) for r in warc.read_warc(made, 1 << 16).collect()) == [("response", 10240000), ("revisit", 10240000)]
    token_output.write_tokens(odd_docs(spark).limit(0), f"file://{tmp_path}/e", BYTE, 2, True)
    assert token_output.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def test_neighbours_rank_ties_by_id_and_ignore_repeated_rows(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(60)] * 2
    out = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=25).orderBy("query_id", "rank").collect()
    for q in (0, 20, 40):
        got = [(r.rank, r.vec_id, r.score) for r in out if r.query_id == q]
        want = sorted(((-(1.0 + (q % 3) * (i % 3)), i) for i in range(60) if i != q))[:25]
        assert got == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_probing_compares_few_rows_where_vectors_lie_in_groups():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(300, 32))
    x = centres[rng.integers(300, size=6000)] + 0.05 * rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)  # as embeddings mostly are
    index = neighbours.Index.fitted(x, float(np.linalg.norm(x, axis=1).max()), 20, len(x) * 100)
    own, visits, scores = index.buckets(x[:200]), index.visits(x[:40]), x[:40] @ x.T
    assert index.compared < 0.3 and visits.shape[2] <= neighbours.MOST_PROBES
    all_own = index.buckets(x)
    found = []
    for i in range(40):
        true = [j for j in np.argsort(-scores[i]) if j != i][:20]
        found.append(np.mean([any(all_own[t][j] in visits[t][i] for t in range(index.tables)) for j in true]))
    assert np.mean(found) >= 0.9 and own.shape == (index.tables, 200)
    assert len(neighbours._moves(4)) == 81 and len(neighbours._moves(20)) <= neighbours.MOST_PROBES
