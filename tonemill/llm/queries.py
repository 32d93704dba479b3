"""The training-data queries, each over the whole of its tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.llm import bpe, brown, html_text, infill, jaccard, phrases, quality, shards, suffix_dedup, toxicity, url_lists, vafile, winnow
from tonemill.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model)


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_brown(table(spark, sf_dir, "documents"))


def op3_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def tokenizer_definition() -> str:
    return Path(public_tokenizers.path(TOKENIZER)).read_text(encoding="utf-8")


def token_digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_definition()))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op8_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shards.shuffle_shards(table(spark, sf_dir, "documents"))
    return sharded.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: the day each was fetched is a hash of its id, 0 to 365."""
    return pages.select("page_id", "url", _number(F.col("page_id").cast("string"), 1, 366).alias("day"))


def _number(text, start: int, modulo: int):
    return (F.conv(F.substring(F.md5(text.cast("binary")), start, 4), 16, 10).cast("int") % modulo).cast("int")


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for about a third of all hosts, parent domains and first path segments seen in ``pages``.

    The tables hold no URL list, so one is derived from them: a hash of the key chooses the list and the days on which
    the key is added, removed and added again.
    """
    keys = pages.select(F.explode(url_lists.lookup_keys(F.col("url"))).alias("key")).distinct()
    name = F.element_at(F.array(*map(F.lit, ("allow", "adult", "malware", "phishing"))), _number(F.col("key"), 5, 4) + 1)
    start = _number(F.col("key"), 9, 300)
    gap = _number(F.col("key"), 13, 60) + 20
    dated = F.array(
        F.struct(start.alias("day"), F.lit("add").alias("action")),
        F.struct((start + gap).alias("day"), F.lit("remove").alias("action")),
        F.struct((start + 2 * gap).alias("day"), F.lit("add").alias("action")),
    )
    kept = F.slice(dated, 1, _number(F.col("key"), 17, 3) + 1)
    return keys.where(_number(F.col("key"), 1, 3) == 0).select(name.alias("list"), "key", F.explode(kept).alias("e")).select("list", "key", "e.day", "e.action")


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_lists.filter_captures(captures(pages), list_entries(pages))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = moved.withColumns(
        {
            "output_sha256": F.sha2(F.col("output").cast("binary"), 256),
            "restored_sha256": F.sha2(infill.restore(F.col("output"), F.col("form")).cast("binary"), 256),
        }
    )
    return digests.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_brown": op2_brown,
    "op3_vafile": op3_vafile,
    "op4_main_text": op4_main_text,
    "op5_winnowing": op5_winnowing,
    "op6_bpe": op6_bpe,
    "op7_jaccard": op7_jaccard,
    "op8_shuffle": op8_shuffle,
    "op9_pairwise": op9_pairwise,
    "op10_url_lists": op10_url_lists,
    "op11_infill": op11_infill,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_phrases": op13_phrases,
    "pipeline": pipeline,
}

_HASH = "(('0x' || substr(md5({0}), {1}, 4))::INTEGER % {2})"

ORACLES: dict[str, str] = {
    "op3_vafile": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op5_winnowing": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS gram, least(10, len(w)) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM iw WHERE len(w) > 0)
), d AS (
  SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)
), m AS (SELECT d.doc_id, d.p, d.k, g.item_id FROM d JOIN g USING (gram, k)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op10_url_lists": rf"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    regexp_extract(url, '//[^/?#]*(/[^/?#]+)', 1) AS path, {_HASH.format("page_id::VARCHAR", 1, 366)} AS day
  FROM pages
), k AS (
  SELECT page_id, url, day, unnest(list_distinct(
    list_concat(CASE WHEN path <> '' THEN [host || path] ELSE []::VARCHAR[] END, [host],
      list_transform(range(2, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.'))))) AS key
  FROM p WHERE host <> ''
), e AS (
  SELECT key, ['allow', 'adult', 'malware', 'phishing'][{_HASH.format("key", 5, 4)} + 1] AS list, {_HASH.format("key", 9, 300)} AS s,
    {_HASH.format("key", 13, 60)} + 20 AS gap, {_HASH.format("key", 17, 3)} + 1 AS n
  FROM (SELECT DISTINCT key FROM k) WHERE {_HASH.format("key", 1, 3)} = 0
), span AS (
  SELECT key, list, s AS a, CASE WHEN n > 1 THEN s + gap END AS b FROM e
  UNION ALL SELECT key, list, s + 2 * gap, NULL FROM e WHERE n = 3
), hit AS (
  SELECT k.page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
  FROM k JOIN span ON k.key = span.key AND k.day >= a AND (b IS NULL OR k.day < b) GROUP BY k.page_id
)
SELECT page_id, url, day, coalesce(lists, '') AS lists,
  CASE WHEN lists IS NULL THEN 'pass' WHEN list_contains(string_split(lists, ','), 'allow') THEN 'allow' ELSE 'block' END AS verdict
FROM p LEFT JOIN hit USING (page_id)""",
    "op11_infill": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u,
    ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""",
    "op13_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM w, range(1, 6) AS r(k) WHERE len(w) >= k)
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1),
longer AS (
  SELECT DISTINCT lang, array_to_string(w[p:p + m - 1], ' ') AS phrase, a
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS p FROM c, range(2, 5) AS r(m) WHERE m < k)
), free AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.a >= 100 * c.a)),
cut AS (
  SELECT free.lang, free.phrase, free.a, i, l.f AS l, r.f AS r, n.n,
    ((1000::HUGEINT * free.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM free) free
    JOIN f l ON l.lang = free.lang AND l.phrase = array_to_string(free.w[:i], ' ')
    JOIN f r ON r.lang = free.lang AND r.phrase = array_to_string(free.w[i + 1:], ' ')
    JOIN n ON n.lang = free.lang
), best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000""",
}
