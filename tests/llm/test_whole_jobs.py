"""Cases in which an operator once did less than its whole job."""

import gc
import random
from itertools import product

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_llm import brute_components, frame
from tonemill.llm import bpe, brown, html_text, jaccard, quality, queries, toxicity, url_lists
from tonemill.llm.common import BATCH_ROWS, stage


def test_gains_are_differences_of_mutual_information():
    rng = np.random.default_rng(0)
    words, classes = 20, 5
    pairs = rng.integers(0, 4, (words, words)).astype(float)
    cls = np.append(rng.integers(0, classes - 1, words - 1), classes - 1)
    table = lambda c: np.eye(classes)[c].T @ pairs @ np.eye(classes)[c]
    own = np.diagonal(pairs)
    other, member = pairs - np.diag(own), np.eye(classes)[cls]
    gain = brown.move_gains(table(cls), cls[:-1], (other @ member)[:-1], (other.T @ member)[:-1], own[:-1])
    for w in range(words - 1):
        for c in range(classes - 1):
            there = cls.copy()
            there[w] = c
            want = brown.mutual_information(table(there)) - brown.mutual_information(table(cls))
            assert abs(gain[w, c] - gain[w, cls[w]] - want) < 1e-9


def test_words_behind_the_most_frequent_are_exchanged_too(spark):
    # 1,600 words of one ending, so of one form, in two kinds that follow each other; with few of them clustered by name
    rng = random.Random(4)
    kinds = [[f"{k}{i}word" for i in range(800)] for k in "ab"]
    docs = frame(spark, [" ".join(rng.choice(kinds[(i + first) % 2]) for i in range(60)) for first in [k % 2 for k in range(400)]])
    before, brown.FREQUENT_WORDS = brown.FREQUENT_WORDS, 1200
    try:
        counts = stage(brown.count_words(docs), "words")
        model, v, classes, rare = brown.fit_brown(docs, counts)
    finally:
        brown.FREQUENT_WORDS = before
    of = dict(zip(v.frequent, classes)) | {bytes(r["word"]): r["k"] for r in rare.collect()}
    assert len(of) == counts.count() > 1500
    first, second = ({of[w] for w in of if w.startswith(k)} for k in (b"a", b"b"))
    assert not first & second
    assert model.tokens == sum(r["n"] for r in counts.collect()) + 400


def test_rounds_leave_neighbours_where_they_are_and_count_every_pair(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{int(rng.paretovariate(0.6)) % 5000}{rng.choice(['s', 'ed', ''])}" for _ in range(rng.randrange(90))) for _ in range(300)]
    docs = frame(spark, [*texts, None, "", "so so so"])
    for name, value in (("FREQUENT_WORDS", 1100), ("BLOCK_WORDS", 400)):
        monkeypatch.setattr(brown, name, value)
    staged = {}

    def kept(df, name, *rows):
        staged.setdefault(name, []).append(out := stage(df, name, *rows))
        return out

    monkeypatch.setattr(brown, "stage", kept)
    counts = stage(brown.count_words(docs), "words")
    v = brown.number_words(counts)
    classes, rare, pairs, forms, _ = brown.exchange_all(docs, v)
    words = counts.count()
    assert v.blocks > 3 and words > 1500 and len(staged["moves"]) > 2
    assert set(staged) == {"rare", "moves", "rare_classes"}  # no neighbours, no row a word in any round
    assert all(x.count() < words / 4 for x in staged["moves"])
    number = {w: brown.rare_id(bytes(w)) for w in (r["word"] for r in v.rare.collect())}
    by_id = {r["id"]: r["k"] for r in rare.collect()}
    of = dict(zip(v.frequent, classes)) | {bytes(w): by_id[i] for w, i in number.items()}
    assert len(of) == words
    want, want_forms = np.zeros((brown.CLASSES, brown.CLASSES)), np.zeros((brown.FORMS, brown.CLASSES))
    for r in docs.collect():
        k = [brown.CLASSES - 1, *(of[w] for w in brown.split_words(r["text"])), brown.CLASSES - 1]
        np.add.at(want, (k[:-1], k[1:]), 1)
    for w, k in of.items():
        want_forms[brown.form_of(w), k] += 1
    assert (pairs == want).all() and (forms == want_forms).all()


@pytest.mark.parametrize("start", ['<a href="/hidden-gems">', '<p title="A hidden truth">', '<article data-hidden="false">', "<div title='aria-hidden=true'>", "<div data-style=\"display:none\">"])
def test_only_an_attribute_of_its_own_hides(start):
    assert not any(v.hidden for v in html_text.parse(start + "text"))


@pytest.mark.parametrize("start", ["<p hidden>", '<p class="a" HIDDEN="">', "<p aria-hidden=true>", "<p style='color:red; display: none'>"])
def test_what_is_hidden_stays_hidden(start):
    assert html_text.parse(start + "text")[1].hidden


def test_unclosed_options_do_not_swallow_the_page():
    nodes = html_text.parse("<form><datalist id=d><option value=a>One<option value=b>Two</datalist></form><p>Story</p>")
    keep = html_text.decode(nodes, np.ones(len(nodes)))
    assert html_text.blocks(nodes, keep) == ["Story"]


def test_all_that_the_channel_can_change_is_decoded(spark):
    words = ["stupid", "idiot", "trash", "scum", "the", "ass", "jackass", "worthless", "hello", "little"]
    model = toxicity.character_model(frame(spark, [" ".join(words) * 50]))
    cases = {
        "stuupid": "stupid", "scumm": "scum", "iddiiott": "idiot", "a$$": "ass", "jacka$$": "jackass", "!diot": "idiot", "tras#": "trash",
        "hello": "hello", "little": "little", "(hello)": "hello", '"stupid!"': "stupid", "the": "the", "2024": "2024",
    }
    assert {raw: toxicity.restore(raw, model) for raw in cases} == cases
    for text in ("s c u m.", '"s c u m"', "s\nc\nu\nm", "s  c  u  m", "s\u3000c u m!", "the s c u m the"):
        assert "scum" in toxicity.Restorer(model).found(text), text


def every_path(columns, model):
    """The best clear text of a lattice by trying every path."""
    best = (-np.inf, "")
    for choice in product(*columns, [(" ", 0.0)]):
        a = b = 0
        total = sum(cost for _, cost in choice)
        for piece, _ in choice:
            for k in toxicity._classes(piece):
                if b or k:
                    total += float(model[a, b, k])
                    a, b = b, k
        best = max(best, (total, "".join(piece for piece, _ in choice).strip()))
    return best


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(4)
    model = np.log(rng.dirichlet(np.ones(toxicity.ALPHABET), (toxicity.ALPHABET, toxicity.ALPHABET))).astype(np.float32)
    for _ in range(150):
        token = "".join(rng.choice(list("abé01@$!.-*tt"), rng.integers(1, 8)))
        columns = toxicity.lattice(token)
        assert toxicity.best_path(columns, model) == every_path(columns, model)[1], token


def test_one_path_tokens_are_not_decoded():
    model = np.zeros((toxicity.ALPHABET,) * 3, np.float32)
    cases = {"word": "word", "(word),": "word", "été…": "été", "...": "", "12": "12", "": "", "a": "a"}
    assert {raw: toxicity.restore(raw, model) for raw in cases} == cases


def test_toxicity_of_awkward_rows(spark):
    weights = {"=" + "idiot": 9.0}
    characters = np.log(np.full((toxicity.ALPHABET,) * 3, 1 / toxicity.ALPHABET)).astype(np.float32)
    model = toxicity.ToxicityModel(characters, weights, -5.0)
    texts = [None, "", " \n", "idiot", "x idiot " * 20_000, "i d i o t", "i\nd\ni\no\nt", "fine words", "idiot"]
    docs = spark.createDataFrame([(None if k == 8 else k, t, "a", "b") for k, t in enumerate(texts)], "doc_id long, text string, score string, held_out string")
    rows = toxicity.score_toxicity(docs, model).collect()
    assert {r["doc_id"]: r["predicted"] for r in rows} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 1, 7: 0, None: 1}
    assert not [r for r in rows if r["doc_id"] is None][0]["held_out"]
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_url_lists_take_odd_days(spark):
    days = [-(2**31), -40, -1, 0, 5, 31, 32, 400, 400_000, 2**31 - 1, None]
    entries = spark.createDataFrame([("bad", f"h{k}.org", d, a) for k in range(2000) for d, a in ((-35, "add"), (3, "remove"), (32, "add"))], "list string, key string, day int, action string")
    captures = [(k, f"http://h{k % 3}.org/", d, "x") for k, d in enumerate(days * 2)] + [(None, None, 5, "x"), (7, "http://h1.org/", 5, None)]
    frame_ = spark.createDataFrame(captures, "page_id long, url string, day int, lists string")
    want = sorted((str(p), str(d), "block" if u and d is not None and (-35 <= d < 3 or d >= 32) else "pass") for p, u, d, _ in captures)
    got = url_lists.filter_captures(frame_, entries).collect()
    assert sorted((str(r["page_id"]), str(r["day"]), r["verdict"]) for r in got) == want
    assert url_lists.filter_captures(frame_.limit(0), entries).count() == 0
    assert {r["verdict"] for r in url_lists.filter_captures(frame_, entries.limit(0)).collect()} == {"pass"}


def test_unlinked_members_of_a_large_group_are_not_all_paired(spark, monkeypatch):
    # long texts with 150 of about 1,200 shingles of their own: no two are linked, and 512 bits do not tell them apart
    rng = random.Random(5)
    base = [f"b{k}" for k in range(1200)]
    texts = []
    for d in range(100):
        copy = list(base)
        for k, at in enumerate(rng.sample(range(0, 1200, 5), 30)):
            copy[at] = f"own{d}x{k}"
        texts.append(" ".join(copy))
    bound, met = jaccard.near_pairs, []
    monkeypatch.setattr(jaccard, "near_pairs", lambda pairs, signatures: met.append(pairs.count()) or bound(pairs, signatures))
    got = sorted(tuple(r) for r in jaccard.jaccard_components(frame(spark, texts)).collect())
    assert got == brute_components(texts)
    assert met[-1] < 500, met  # of 4,950 pairs


def test_links_between_signatures_of_different_lengths(spark):
    assert [jaccard.wide_words(n) for n in (1, 1024, 1025, 2048, 2049, 5000)] == [32, 32, 64, 64, 128, 256]
    long = [f"a{k}" for k in range(1300)]
    texts = [" ".join(long[:n]) for n in (950, 1020, 1028, 1029, 1100, 1300, 1250)] + [" ".join(["z", *long[300:1290]])]
    assert sorted(tuple(r) for r in jaccard.jaccard_components(frame(spark, texts)).collect()) == brute_components(texts)


def test_pieces_between_white_space_have_the_words_of_the_text():
    split = bpe.splitter(queries.tokenizer_definition())
    rng = random.Random(6)
    parts = ["a", "B", "É", "ſ", "'", "'s", "'LL", "7", "<|", "endoftext", "|>", ".,", "-", "×", "º", " ", "  ", "\t", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(5000)]
    cut = [split.chunks(t) for t in texts]
    assert sum(c is not None for c in cut) > 3000
    for text, chunks in zip(texts, cut):
        if chunks is not None:
            assert [w for c in chunks for w in bpe._PLAIN_WORDS.findall(c)] == split.words(text)
    # a special token is one word, its name in capitals is not, and other alphabets are split by the library
    assert [split.chunks(t) for t in ("a <|endoftext|> b", "a <|ENDOFTEXT|> b", "я b", None, "")] == [None, None, None, [], []]


def test_numbers_of_many_documents_are_packed_at_once():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 1 << int(rng.integers(1, 28)), n) for n in (0, 5, 1, 0, 300, 0)]
    count = np.array([len(p) for p in parts])
    values, sizes = bpe.unpack_all(bpe.pack_all(np.concatenate(parts), count))
    assert (sizes == count).all() and (values == np.concatenate(parts)).all()


def test_tables_of_a_worker_go_with_what_was_broadcast(spark):
    shared = spark.sparkContext.broadcast(["a", "b"])
    before = len(bpe._HELD)
    assert bpe.held(shared, len) == 2 and len(bpe._HELD) == before + 1
    del shared
    gc.collect()
    assert len(bpe._HELD) == before


def test_quality_stage_scores_in_small_batches(spark, monkeypatch):
    class Checked(quality.PairwiseModel):
        def score(self, features):
            assert len(features) <= limit, len(features)
            return super().score(features)

    limit = BATCH_ROWS
    model = Checked(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), np.zeros(quality.FEATURES), 0.0, 1.0)
    monkeypatch.setattr(quality, "fit_quality", lambda docs, labels: model)
    docs = frame(spark, ["some words"] * 12_000).coalesce(1)
    assert corpus_pipeline.keep_good(spark, docs, "/root/testdata/sf0.001").count() == 12_000


def test_python_steps_of_a_task_are_one(spark, monkeypatch):
    # two in a row, a filter and what it feeds, are two workers for each core
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    docs = frame(spark, ["a b c d e f g"] * 3 + ["a b c d e f h", None])
    labels = spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "stage", lambda df, name: plan(df) or stage(df, name))
    assert quality.labelled_features(docs, labels).count() > 0
    sets = jaccard.describe_sets(docs, jaccard.shingle_counts(docs)).where("n > 0")
    a, b = sorted(r["set_key"] for r in sets.select("set_key").distinct().collect())
    linked = jaccard.verify(spark.createDataFrame([(a, b)], "a long, b long"), docs, sets)
    plan(linked)
    assert linked.count() == 0  # two of four shingles
    assert len(plans) == 2 and all("MapInPandas" in p and "ArrowEvalPython" not in p for p in plans)


def test_numbered_rows_hold_their_text_once(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(corpus_pipeline, "stage_table", lambda df, name: written.update({name: df.columns}) or stage(df, name))
    docs = frame(spark, ["a b c d e f g", "a b c d e f g", "other words", None])
    assert corpus_pipeline.one_of_each(spark, docs, "").count() == 3
    assert written == {"numbered": ["_doc", "doc_id"]}


def test_tokens_stage_encodes_in_small_batches(spark):
    docs = frame(spark, ["some words", None, "some words", ""], [1, 2, 1, None])
    got = corpus_pipeline.encode(spark, docs, "")
    assert sorted(r["n_tokens"] for r in got.collect()) == [0, 0, 2, 2]
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()  # it ran where batches are small
