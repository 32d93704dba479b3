"""Fill-in-middle, removal of repeated passages and phrase mining against brute force and awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.test_llm import AWKWARD, frame
from tonemill.llm import infill, phrases, suffix_dedup

CLASHING = "n long, form string, output string, prefix_chars string, kept string, spans string, row long, ord long, f long, phrase string, lang string, text string, doc_id long"


def clashing(spark, rows):
    return spark.createDataFrame([(1, "f", "o", "p", "k", "s", 2, 3, 4, "x", lang, text, i) for i, lang, text in rows], CLASHING)


def infill_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infill_of_awkward_rows(spark):
    odd = ["$1 \\2 ${x}", "<P", "a<S", "<<M", "<P> in it", "\r\n\x00\x85 ", "é😀A", "ab " * 200_000, "z" * 300_000, "%s %d"]
    rows = [(i, t) for i, t in enumerate((AWKWARD + odd) * 6)] + [(None, t) for t in odd] + [(1 << 60, "a b"), (7, "a b"), (7, "a b")]
    docs = clashing(spark, [(i, "en", t) for i, t in rows])
    moved = infill.fill_in_middle(docs)
    assert set(moved.columns) == set(docs.columns) | {"middle_chars"}
    got = moved.select("doc_id", F.coalesce("text", F.lit("")), "n", "form", "prefix_chars", "middle_chars", "output", infill.restore(F.col("output"), F.col("form"))).collect()
    want = [(i, t or "", *infill_by_hand(i, t), t or "") for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {w[3] for w in want} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_infill_is_a_projection(spark):
    plan = infill.fill_in_middle(frame(spark, ["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_merge_by_known_prefixes(monkeypatch):
    rng = random.Random(5)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(14))) for _ in range(rng.randrange(40))) for _ in range(k)]
        got = list(suffix_dedup.merge_runs([suffix_dedup.Run(*suffix_dedup.front_code(r)) for r in runs]))
        assert [g[2] for g in got] == sorted(sum(runs, []))
        assert all(b[3] == suffix_dedup.common_prefix(a[2], b[2], 0) for a, b in zip(got, got[1:]))
        assert all(runs[g[0]][g[1]] == g[2] for g in got)
    # known bytes are not read again: every comparison starts at what both keys share with the last winner
    looked = []
    real = suffix_dedup.common_prefix
    monkeypatch.setattr(suffix_dedup, "common_prefix", lambda a, b, known: looked.append((a[:known] == b[:known], known)) or real(a, b, known))
    runs = [suffix_dedup.Run(*suffix_dedup.front_code([b"x" * 30 + bytes([65 + i, 65 + j]) for j in range(5)])) for i in range(4)]
    looked.clear()
    assert len(list(suffix_dedup.merge_runs(runs))) == 20
    assert all(same for same, _ in looked) and sum(known >= 30 for _, known in looked) >= len(looked) - 3


def removed_by_hand(rows, length):
    last = (1 << 63) - 1
    rows = [(i, last if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for _, o, b in rows:
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(o, first.get(b[p : p + length], last + 1))
    out = []
    for i, o, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < o:
                gone[p : p + length] = b"\1" * length
        runs = re.findall(rb"\x01+", bytes(gone))
        out.append((i, len(b), sum(gone), len(runs), bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def removed(docs, length=50):
    rows = suffix_dedup.remove_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    return sorted([(*r[:4], bytes(r[4])) for r in rows], key=repr)


def passages(rng):
    letters = "abcdé "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 70, 300, 300)]
    out = []
    for _ in range(150):
        out.append(text(rng.randrange(40)).join(rng.choice(shared)[rng.randrange(4) :] for _ in range(rng.randrange(4))) + text(rng.randrange(90)))
    return out + [shared[4][:200], shared[4][100:], "a" * 400, "a" * 120, "ab" * 90]


@pytest.mark.parametrize("hot, block, suffixes", [(2048, 4 << 20, 200_000), (0, 4 << 20, 200_000), (1, 100, 300)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, block, suffixes):
    # every gram expanded; texts in pieces; several runs a task
    monkeypatch.setattr(suffix_dedup, "HOT_SENDS", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "RUN_SUFFIXES", suffixes)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 10_000)
    monkeypatch.setattr(suffix_dedup, "BATCH_DOCS", 20)
    texts = passages(random.Random(hot + 11)) + AWKWARD[:6] + ["é" * 500]
    rows = list(enumerate(texts))
    rows += [(None, texts[3]), (None, texts[-1]), ((1 << 60) + 1, texts[8] + "x"), (5, texts[9]), (5, texts[9]), (5, texts[40]), (2, texts[40])]
    rows += [(900 + i, texts[150]) for i in range(40)]
    random.Random(1).shuffle(rows)
    assert removed(clashing(spark, [(i, "en", t) for i, t in rows])) == removed_by_hand(rows, 50)


def test_repeats_of_short_strings(spark):
    rows = list(enumerate(passages(random.Random(3))[:40]))
    assert removed(frame(spark, [t for _, t in rows]), 8) == removed_by_hand(rows, 8)
    assert removed(frame(spark, ["a"]).limit(0)) == []


def bucket_of(texts, length=50, buckets=1):
    """The runs of texts, each a task of its own, as one table."""
    bits = suffix_dedup.filter_bits(buckets)
    words, hot = np.full(buckets * bits // 8, 255, np.uint8), np.zeros(suffix_dedup.HOT_BITS // 32, np.uint32)
    tasks = [suffix_dedup.task_runs(iter([([i], [i], [t])]), words, hot, length, buckets, 1 << 20) for i, t in enumerate(texts)]
    return pa.Table.from_batches([b for task in tasks for b in task])


def test_only_differing_zones_of_a_gram_are_merged(monkeypatch):
    # zones that are alone or equal to others are settled before the loser tree
    looked = []
    real = suffix_dedup.common_prefix
    monkeypatch.setattr(suffix_dedup, "common_prefix", lambda a, b, known: looked.append(known) or real(a, b, known))
    rng = random.Random(4)
    text = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    copy, shared = text(2000), text(200)
    got = suffix_dedup._merge_bucket(bucket_of([text(2000), copy, text(2000), copy, copy]), 50)
    assert got.tolist() == [[3, 0, 2000], [4, 0, 2000]] and not looked
    got = suffix_dedup._merge_bucket(bucket_of([text(300) + shared + b"." + text(300), text(90) + b"!" + shared + b"?" + text(80)]), 50)
    assert got.tolist() == [[1, 91, 291]] and looked


def test_ids_stay_whole_in_runs():
    big = (1 << 60) + 1  # beyond what a double holds
    words, hot = np.full(suffix_dedup.filter_bits(3) * 3 // 8, 255, np.uint8), np.zeros(suffix_dedup.HOT_BITS // 32, np.uint32)
    ids = [-5, big, big + 1, suffix_dedup.LAST]
    rows = list(suffix_dedup.task_runs(iter([(ids, ids, [bytes(range(k, 200)) for k in range(4)])]), words, hot, 50, 3, 1 << 20))
    found = {i for r in rows if r.column("shared")[0].as_py() for i in suffix_dedup._unpacked(r.column("ord")[0].as_py()).tolist()}
    assert found <= set(ids) and -5 in found and big in found


def test_front_coded_rows_come_back():
    rng = random.Random(6)
    runs = [sorted(bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(12))) for _ in range(n)) for n in (1, 30, 0, 7)]
    coded = [suffix_dedup.front_code(r) for r in runs]
    shared, tail = (np.concatenate([c[k] for c in coded]) for k in range(2))
    data = np.frombuffer(b"".join(zstandard.decompress(c[2]) for c in coded), np.uint8)
    rows = suffix_dedup.front_decode(shared, tail, data, 16)
    assert [r.tobytes()[:n] for r, n in zip(rows, shared + tail)] == sum(runs, [])


@pytest.mark.parametrize("paired", [1, 3, 16])
def test_stretches_pair_by_pair_equal_those_by_strings(monkeypatch, paired):
    monkeypatch.setattr(suffix_dedup, "PAIRED", paired)
    monkeypatch.setattr(suffix_dedup, "ROWS", 5)
    rng = random.Random(paired)
    for _ in range(40):
        groups = []
        for _ in range(8):
            gram = bytes(rng.choice(b"ab") for _ in range(4))
            part = lambda n: bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(n)))
            whole = [(part(5), gram + part(5)) for _ in range(rng.randrange(1, 8))]
            groups.append([(left, key, rng.randrange(4)) for left, key in dict.fromkeys(whole) if len(left + key) >= 8])
        want = [h for g in groups for h in suffix_dedup._group_hits(g, 8)]
        flat = [z for g in groups for z in g]
        pad = lambda b: list(b.ljust(8, b"\0"))
        key, left = (np.array([pad(b) for b in c], np.uint8).reshape(-1, 8) for c in ([k for _, k, _ in flat], [x[::-1] for x, _, _ in flat]))
        zones = suffix_dedup.Zones(key, np.array([len(k) for _, k, _ in flat], int), left, np.array([len(x) for x, _, _ in flat], int))
        group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        before, behind = suffix_dedup._stretches(zones, np.array([o for _, _, o in flat], int), group, 8)
        assert [(b, e) if e >= 0 else None for b, e in zip(before.tolist(), behind.tolist())] == want


def test_filter_grows_with_the_shared_grams():
    # a bitmap of one size fills up as tables grow, and then every anchor is exchanged
    assert suffix_dedup.filter_bits(600) * 600 > 1 << 28 and suffix_dedup.filter_bits(100_000) * 100_000 <= suffix_dedup.FILTER_BITS
    buckets, rng = 8, random.Random(9)
    text = lambda n: bytes(rng.randrange(32, 127) for _ in range(n))
    shared = [text(30_000) for _ in range(40)]
    parts, bits = [[] for _ in range(buckets)], 1 << 17
    for texts in (shared, shared, [text(2_000_000)]):
        for bucket, grams in zip(*suffix_dedup.gram_rows(texts, 50, buckets)):
            parts[bucket].append(grams)
    assert max(map(len, (b"".join(p) for p in parts))) < 1.5 * min(map(len, (b"".join(p) for p in parts)))  # spread evenly
    words = np.frombuffer(b"".join(suffix_dedup.several(p, bits, 2048)[0] for p in parts), np.uint8)

    def passing(texts):
        h = np.concatenate([suffix_dedup.zones(np.frombuffer(b[0], np.uint8), b[2], 50)[3] for b in suffix_dedup.blocks(texts, 50)])
        return suffix_dedup.in_filter(words, bits, h, buckets).mean()

    assert passing(shared) == 1
    assert passing([text(500_000)]) < 0.03


def phrases_by_hand(rows, support, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 6):
                for p in range(len(w) - k + 1):
                    counts[lang, tuple(w[p : p + k])] += 1
    found = {key: a for key, a in counts.items() if a >= support and len(key[1]) > 1}
    out = []
    for lang in totals:
        scored = []
        for (of, w), a in found.items():
            if of != lang:
                continue
            longer = (v for (x, v), b in found.items() if x == lang and len(v) > len(w) and 100 * b >= 100 * a)
            if any(v[i : i + len(w)] == w for v in longer for i in range(len(v) - len(w) + 1)):
                continue
            cuts = [(counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min((1000 * a * totals[lang] // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
            scored.append((-score, -a, " ".join(w).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("shard, bits, lowered", [(48 << 20, 1 << 26, 0.5), (400, 1 << 26, 0.5), (3000, 64, 0.5), (1500, 1 << 26, 1)])
def test_phrases_equal_brute_force(spark, monkeypatch, shard, bits, lowered):
    # many shards with a support of one; a bitmap so full that every phrase is counted
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    monkeypatch.setattr(phrases, "CANDIDATE_BITS", bits)
    monkeypatch.setattr(phrases, "LOWERED", lowered)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 3000)
    rng = random.Random(7)
    words = ["New", "york", "city", "é x", "of", "the", "a", "San", "jose", "\x0cend", "tab\tbed"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ", ", ".\n", "\x0b", "! "]) for _ in range(n))
    rows = [(rng.choice(["en", "en", "en", "fr", None, "und"]), text(rng.randrange(60))) for _ in range(120)]
    rows += [("en", "the new york city of " * 30), ("en", "the new york city of " * 30), ("fr", None), ("xx", ""), ("", "a a a a a a a a a a")]
    docs = clashing(spark, [(None if k % 3 else k, lang, t) for k, (lang, t) in enumerate(rows)]).repartition(5)
    for support, top in ((4, 2000), (9, 5)):
        got = phrases.collocations(docs, support, top).collect()
        assert sorted(map(tuple, got)) == phrases_by_hand(rows, support, top)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_local_support_misses_nothing():
    rng = random.Random(2)
    for _ in range(500):
        parts = [rng.randrange(1, 1000) for _ in range(rng.randrange(1, 30))]
        support, whole = rng.randrange(1, 200), sum(parts)
        least = [phrases.local_support(support, p, whole) for p in parts]
        assert sum(n - 1 for n in least) < support  # below it in every shard is below it over all
