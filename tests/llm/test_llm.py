"""The training-data operators against brute force, the libraries they follow, and awkward rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tonemill.llm import bpe, brown, html_text, jaccard, quality, queries, shards, toxicity, url_lists, vafile, winnow
from tonemill.llm.common import table

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, row string"


def frame(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z") for i, t in zip(ids, texts)], DOCS)


AWKWARD = [None, "", " \n\t", "word", "a b c d e f g h i j k l", "a b c d e f g h i j k l", "x " * 30_000, "é" * 500, "Ünïcode ﬁ ẛ̣ İ ǅ", "q"]


def check_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    got = queries.QUERIES[name](spark, FOLDER)
    want = con.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(got.select(cols).collect()) == plain(want.select(*cols).fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    check_oracle(spark, name)


def brute_components(texts):
    sets = []
    for t in texts:
        w = brown.split_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = list(AWKWARD)
    for _ in range(120):  # one large group of near copies, on both sides of the limit
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.choice([5, 9, 12, 60]))]) for _ in range(60)]
    got = sorted(tuple(r) for r in jaccard.jaccard_components(frame(spark, texts)).collect())
    assert got == brute_components(texts)


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_components(frame(spark, ["a"]).limit(0)).count() == 0
    rows = jaccard.jaccard_components(frame(spark, ["a b", "a b", "a b", None], [7, None, 7, None])).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in rows) == [("7", 1, "7"), ("7", 1, "7"), ("None", 0, "None"), ("None", 1, "7")]


def test_winnowing_on_planted_runs(spark):
    rng = random.Random(2)
    word = lambda: f"v{rng.randrange(4000)}"
    items = [" ".join(word() for _ in range(n)) for n in (30, 10, 12, 4, 1)] + [None, "", "--"]
    long = items[0].split()
    docs = ["x y " + " ".join(long[k : k + n]) + " z" for k in (0, 7, 20) for n in (9, 10)] + [items[3].upper() + "!", items[4] + " " + items[4], *AWKWARD]
    benchmark = spark.createDataFrame(list(enumerate(items)) + [(None, "a b")], "item_id long, text string")
    got = {r["doc_id"]: r for r in winnow.find_contamination(frame(spark, docs), benchmark).collect()}
    for i, d in enumerate(docs):
        words, hit, found = winnow.words_of(d), set(), set()
        for k, item in enumerate(items):
            w = winnow.words_of(item)
            m = min(10, len(w))
            grams = {tuple(w[p : p + m]) for p in range(len(w) - m + 1)} if w else set()
            for p in range(len(words) - m + 1 if w else 0):
                if tuple(words[p : p + m]) in grams:
                    hit |= set(range(p, p + m))
                    found.add(str(k))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"], got[i]["contaminated"]) == (len(words), len(hit), sorted(found), bool(hit))


def test_bpe_equals_the_library(spark):
    tokenizer = Tokenizer.from_str(queries.tokenizer_definition())
    rng = random.Random(3)
    odd = ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x300, 0x2000), 32, 39, 0x1F600])) for _ in range(60)) for _ in range(80)]
    texts = AWKWARD + odd + ["don't  STOP <|endoftext|>now <|startoftext|>", "H̱ ﬀ K ² ½ 12 ٣", "İ'S we'LL"]
    docs = frame(spark, texts).unionByName(table(spark, FOLDER, "documents").select("*", *[F.lit("").alias(c) for c in ("size", "score", "row")]).withColumn("doc_id", F.col("doc_id") + 1000))
    want = {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids for r in docs.collect()}
    for words in (bpe.FREQUENT_WORDS, 50):  # nearly all words frequent, nearly all rare
        bpe.FREQUENT_WORDS, before = words, bpe.FREQUENT_WORDS
        try:
            rows = queries.token_digest(bpe.encode_documents(docs, queries.tokenizer_definition())).collect()
        finally:
            bpe.FREQUENT_WORDS = before
        assert len(rows) == len(want)
        for r in rows:
            ids = want[r["doc_id"]]
            clear = tokenizer.decode(ids, skip_special_tokens=False)
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(clear.encode()).hexdigest()


def test_pack_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1])
    assert (bpe.unpack(bpe.pack(values)) == values).all()
    assert len(bpe.unpack(bpe.pack(values[:0]))) == 0


def test_class_model_counts_and_beats_the_unigrams(spark):
    rows = brown.score_brown(table(spark, FOLDER, "documents")).toPandas().set_index("doc_id")
    texts = {r["doc_id"]: r["text"] for r in table(spark, FOLDER, "documents").collect()}
    from collections import Counter
    from zlib import crc32

    held = {i for i in texts if crc32(str(i).encode()) % 10 == 0}
    counts = Counter()
    for i, t in texts.items():
        if i not in held:
            counts.update([*brown.split_words(t), None])
    total, types = sum(counts.values()), len(counts)
    for i, t in texts.items():
        tokens = [*brown.split_words(t), None]
        r = rows.loc[i]
        base = sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    out = rows[rows.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_rare_words_are_scored_like_frequent_ones(spark):
    docs = table(spark, FOLDER, "documents")
    a = brown.score_brown(docs).toPandas().sort_values("doc_id")
    brown.FREQUENT_WORDS, before = 20, brown.FREQUENT_WORDS
    try:
        b = brown.score_brown(docs).toPandas().sort_values("doc_id")
    finally:
        brown.FREQUENT_WORDS = before
    assert np.allclose(a[["n_known", "base_score", "score"]].to_numpy(float), b[["n_known", "base_score", "score"]].to_numpy(float))


def test_exchange_parts_words_that_behave_differently():
    pairs = np.zeros((9, 9))
    pairs[0:4, 4:8] = 50  # the first four are followed by the others, and those by the first
    pairs[4:8, 0:4] = 50
    cls = brown.exchange(pairs, classes=3)
    assert len(set(cls[:4])) == len(set(cls[4:8])) == 1 and cls[0] != cls[4] and cls[8] == 2


@pytest.mark.parametrize("vectors", [[], [(0, [0.5, 0.1])], [(k, [float(k % 3), 1.0]) for k in range(90)] + [(0, [0.0, 1.0]), (7, None), (8, [None, 1.0]), (9, [float("nan"), 1.0]), (None, [1.0, 1.0])]])
def test_top_k_with_ties(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 20 == 0, 20).collect())
    ok = sorted({(i, tuple(np.floor(64 * np.float64(np.float32(v))).astype(int))) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)})
    want = []
    for q in ok:
        if q[0] % 20 == 0:
            best = sorted((-int(np.dot(q[1], c[1])), c[0]) for c in ok if c != q)[:20]
            want += [(q[0], r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("texts", [[], AWKWARD, ["same"] * 100])
def test_shards_are_even_and_gapless(spark, texts):
    rows = shards.shuffle_shards(frame(spark, texts), bucket_bytes=2000).collect()
    assert sorted(str(r["text"]) for r in rows) == sorted(map(str, texts))
    by = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_url_lists_by_day(spark):
    entries = spark.createDataFrame(
        [("bad", "x.org", 10, "add"), ("bad", "x.org", 20, "remove"), ("bad", "x.org", 70, "add"), ("allow", "a.x.org/ok", 0, "add"), ("bad", "y.org", 5, "add"), ("bad", "y.org", 5, "remove"), (None, "z.org", 1, "add")],
        "list string, key string, day int, action string",
    )
    rows = [(1, "http://a.x.org/p", 9), (2, "http://u@A.X.org:80/p", 10), (3, "http://x.org", 20), (4, "http://x.org", 300), (5, "https://a.x.org/ok/1", 15), (6, "http://y.org", 5), (7, None, 5), (8, "nonsense", 1), (9, "http://x.org", None)]
    got = {r["page_id"]: r["verdict"] for r in url_lists.filter_captures(spark.createDataFrame(rows, "page_id long, url string, day int"), entries).collect()}
    assert got == {1: "pass", 2: "block", 3: "pass", 4: "block", 5: "allow", 6: "pass", 7: "pass", 8: "pass", 9: "pass"}


def test_viterbi_restores_disguised_words(spark):
    words = ["stupid", "idiot", "moron", "scum", "the", "worthless"]
    model = toxicity.character_model(frame(spark, [" ".join(words) * 50]))
    for disguised, clear in {"stup1d": "stupid", "1d1ot": "idiot", "m0r0n!!": "moron", "$cum": "scum", "stuuuuupid": "stupid", "i.d.i.o.t": "idiot", "the***": "the", "2024": "2024"}.items():
        assert toxicity.restore(disguised, model) == clear
    assert toxicity.viterbi("i d i o t", model) == "idiot"


@pytest.mark.parametrize("fit, score, label, remainder", [(quality.fit_quality, quality.score_quality, "quality", (4, 2)), (toxicity.fit_toxicity, toxicity.score_toxicity, "toxic", (3, 1))])
def test_classifiers_on_held_out_rows(spark, fit, score, label, remainder):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = fit(docs, labels)
    rows = score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert ((rows.score >= 0.7) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()
    assert (rows.predicted == rows[label]).mean() > 0.95
    strange = score(frame(spark, AWKWARD), model).collect()
    assert len(strange) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in strange)
    assert score(docs.limit(0), fit(docs.limit(0), labels)).count() == 0


def test_quality_is_fitted_on_every_labelled_row(spark):
    n = 13_000
    text = lambda i: ("Good words in a row here, %d. " if i % 3 else "BAD!! # %d $ ") % (i * 7919 % 1009) * (1 + i % 4)
    docs = spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")
    used = [i for i in range(n) if zlib.crc32(str(i).encode()) % 4 != 2]
    x, y = np.array([quality.text_features(text(i)) for i in used * 2]), np.array([int(i % 3 > 0) for i in used * 2])
    twice = docs.union(docs)  # 19,000 usable rows, one block or several
    for rows in (quality.BLOCK_ROWS, 1_000):
        model = quality.fit_quality(twice, labels, rows)
        assert model.mean == pytest.approx(x.mean(0)) and model.scale == pytest.approx(x.std(0) + 1e-9)
        raw = ((x - model.mean) / model.scale) @ model.weights
        assert model.threshold == pytest.approx(np.quantile(raw, (y == 0).mean())) and model.spread == pytest.approx(raw.std() / 4)


def test_blocks_of_a_rare_kind(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(900, quality.FEATURES)), (np.arange(900) % 90 == 0).astype(int)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(900)], "doc_id long, x array<double>, y int")
    blocks = quality.feature_blocks(rows, {0: 890, 1: 10}, 100)
    counts = quality.of_blocks(blocks, lambda x, y, own: np.array([len(y), own.sum(), y.sum(), len(set(quality.block_pairs(y)[1]))]))
    assert len(counts) == 9 and (counts[:, 2] == 10).all() and counts[:, 1].sum() == 900
    assert counts[:, 3].sum() == 890  # every row of the frequent kind is in a pair
    for q in (0.0, 0.3, 890 / 900, 1.0):
        assert quality.block_quantile(blocks, lambda x: np.round(x[:, 0], 1), 900, q) == np.quantile(np.round(x[:, 0], 1), q)


PARAGRAPH = "A long paragraph of the story, with several clauses, and a full stop at its end. " * 4


def test_main_text(spark):
    boiler = "<div class='sidebar'><ul><li><a href=#>Other news</a></li></ul></div><div class='comments'><p>I liked it.</p></div><footer>&copy; us</footer>"
    pages = table(spark, FOLDER, "pages").select("page_id", "url", "html").unionByName(
        spark.createDataFrame(
            [(-1, "u", f"<body><nav><a href=#>Home</a></nav><div id=content><h1>Head &amp; line</h1><p>{PARAGRAPH}<p>{PARAGRAPH}</div>{boiler}"), (-2, "u", None), (-3, "u", ""), (-4, "u", "<script>x<p>y</script>")],
            "page_id long, url string, html string",
        )
    )
    got = {r["page_id"]: r for r in html_text.extract_text(pages, 60).collect()}
    assert got[-1]["text"] == "\n".join(["Head & line", PARAGRAPH.strip(), PARAGRAPH.strip()])
    assert [got[k]["text"] for k in (-2, -3, -4)] == ["", "", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_decoding_keeps_ancestors_of_what_it_keeps():
    nodes = html_text.parse("<div><p>a</p><div><p>b</p></div></div>")
    keep = html_text.decode(nodes, np.array([0.0, -1.0, 3.0, -5.0, 4.0]))
    assert keep.tolist() == [True, True, True, False, False]


def test_pipeline_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER)
        assert after.columns == columns
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = spark.createDataFrame(after.collect(), after.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, before, FOLDER).count() == before.count() > 100
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), FOLDER).count() == 0


def test_bpe_keeps_ids_and_takes_repeated_rows(spark):
    large = 2**60 + 1
    texts = ["some unusual wordies qzx"] * 300 + ["other"]
    docs = frame(spark, texts, [large] * 150 + [None] * 150 + [large + 1]).repartition(3)
    bpe.FREQUENT_WORDS, before = 1, bpe.FREQUENT_WORDS
    try:
        rows = bpe.encode_documents(docs, queries.tokenizer_definition(), ["doc_id", "row", "score"]).collect()
    finally:
        bpe.FREQUENT_WORDS = before
    assert sorted(str(r["doc_id"]) for r in rows) == sorted([str(large)] * 150 + ["None"] * 150 + [str(large + 1)])
    tokenizer = Tokenizer.from_str(queries.tokenizer_definition())
    for r in rows:
        text = texts[-1] if r["doc_id"] == large + 1 else texts[0]
        assert bytes(r["ids"]) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert (r["row"], r["score"]) == ("z", "y")
    assert bpe.encode_documents(docs.limit(0), queries.tokenizer_definition()).count() == 0
