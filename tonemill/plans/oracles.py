"""The SQL each registered query is compared with, written for DuckDB over the same tables."""

from __future__ import annotations

# The blanks of the text patterns, in this engine's regular-expression syntax.
WS = r"\s\v\x1c-\x1f\x85\pZ"

VIEWS = {
    "reviews": """
        SELECT doc_id AS row_id, CAST(doc_id % 5 + 1 AS INTEGER) AS class_index,
               CASE WHEN doc_id % 7 <> 0 THEN source END AS review_title,
               CASE WHEN doc_id % 11 <> 0 THEN text END AS review_text
        FROM documents""",
    "docs": "SELECT doc_id AS row_id, text FROM documents",
    "ratings": """
        SELECT o_orderkey AS row_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS class_index FROM orders""",
    "labelled": """
        SELECT row_id, CASE WHEN class_index IN (4, 5) THEN 2 WHEN class_index = 3 THEN 1 ELSE 0 END AS label
        FROM ratings""",
    "doc_labels": """
        SELECT doc_id AS row_id,
               CASE WHEN doc_id % 5 + 1 IN (4, 5) THEN 2 WHEN doc_id % 5 + 1 = 3 THEN 1 ELSE 0 END AS label
        FROM documents""",
    "vectors": "SELECT vec_id AS row_id, embedding AS vec, label FROM embeddings",
    "tokens": """
        SELECT vec_id // 4 AS row_id, CAST(vec_id % 4 AS INTEGER) AS pos,
               CASE WHEN (vec_id // 4) % 3 = 0 AND vec_id % 4 = 3 THEN 0 ELSE 1 END AS mask, embedding AS vec
        FROM embeddings""",
    "history": """
        SELECT CAST(date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS INTEGER) AS epoch,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS f1
        FROM events GROUP BY 1""",
}


def _scores(labels: str) -> str:
    return f"""
        SELECT row_id, y, p0, p1, p2, w0 / 10.0e0 AS l0, w1 / 10.0e0 AS l1, w2 / 10.0e0 AS l2,
               CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred,
               greatest(p0, p1, p2) AS conf
        FROM (SELECT *, w0 / (w0 + w1 + w2) AS p0, w1 / (w0 + w1 + w2) AS p1, w2 / (w0 + w1 + w2) AS p2
              FROM (SELECT row_id, label AS y,
                           CAST(1 + (row_id * 7) % 97 + CASE WHEN label = 0 THEN 60 ELSE 0 END AS DOUBLE) AS w0,
                           CAST(1 + (row_id * 11) % 89 + CASE WHEN label = 1 THEN 40 ELSE 0 END AS DOUBLE) AS w1,
                           CAST(1 + (row_id * 13) % 83 + CASE WHEN label = 2 THEN 60 ELSE 0 END AS DOUBLE) AS w2
                    FROM {labels}))"""


VIEWS["scored"] = _scores("labelled")
VIEWS["scored_docs"] = _scores("doc_labels")
NEEDS = {
    "labelled": ["ratings"],
    "scored": ["labelled"],
    "scored_docs": ["doc_labels"],
    "cells": ["scored"],
    "per_class": ["cells"],
    "pairs": ["scored"],
    "pooled": ["scored"],
    "run": ["pairs"],
    "run_micro": ["pooled"],
    "clean": ["docs"],
    "vocab": ["clean"],
    "losses": ["scored"],
}
VIEWS["cells"] = "SELECT y, pred, count(*) AS n FROM scored GROUP BY 1, 2"
VIEWS["per_class"] = """
        SELECT cls, support, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision,
               CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall,
               CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) END AS f1,
               hits, predicted
        FROM (SELECT cls, CAST(sum(support) AS DOUBLE) AS support, CAST(sum(predicted) AS DOUBLE) AS predicted,
                     CAST(sum(hits) AS DOUBLE) AS hits
              FROM (SELECT y AS cls, n AS support, 0 AS predicted, CASE WHEN y = pred THEN n ELSE 0 END AS hits FROM cells
                    UNION ALL SELECT pred, 0, n, 0 FROM cells) GROUP BY 1)"""
VIEWS["pairs"] = " UNION ALL ".join(
    f"SELECT row_id, CAST({c} AS INTEGER) AS cls, p{c} AS score, CASE WHEN y = {c} THEN 1 ELSE 0 END AS pos FROM scored"
    for c in range(3)
)
VIEWS["pooled"] = VIEWS["pairs"]


def _running(pairs: str, cls: str) -> str:
    return f"""
        SELECT *, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, row_number() OVER w AS rn,
               sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
               sum(pos) OVER (PARTITION BY cls) AS all_pos, sum(neg) OVER (PARTITION BY cls) AS all_neg
        FROM (SELECT {cls} AS cls, score, sum(pos) AS pos, sum(1 - pos) AS neg FROM {pairs} GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY cls ORDER BY score DESC)"""


VIEWS["run"] = _running("pairs", "CAST(cls AS VARCHAR)")
VIEWS["run_micro"] = _running("pooled", "'micro'")
VIEWS["clean"] = rf"""
        SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'http[^{WS}]+', '', 'g'),
                       '[^a-z0-9{WS}]', '', 'g'), '[{WS}]+', ' ', 'g')) AS text FROM docs"""
VIEWS["vocab"] = """
        SELECT token, n, CAST(3 + row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS id
        FROM (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS token FROM clean)
              WHERE token <> '' GROUP BY 1 ORDER BY n DESC, token LIMIT 30000)"""
VIEWS["losses"] = """
        SELECT row_id, ln(exp(l0 - m) + exp(l1 - m) + exp(l2 - m)) + m - CASE y WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END AS loss
        FROM (SELECT *, greatest(l0, l1, l2) AS m FROM scored)"""


def _with(names: str, body: str, recursive: bool = False) -> str:
    """Put the named views, and those they need, in front of ``body``."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    return f"WITH {'RECURSIVE ' if recursive else ''}{views} {body}"


def _name(column: str) -> str:
    return f"(['Negative', 'Neutral', 'Positive'])[{column} + 1]"


def _key(seed: str) -> str:
    return f"md5(CAST(row_id AS VARCHAR) || ':{seed}')"


REVIEW_COLUMNS = ["row_id", "class_index", "review_title", "review_text"]
REVIEW_TYPES = ["bigint", "int", "string", "string"]
FILLED = "SELECT row_id, class_index, coalesce(review_title, '') AS review_title, review_text FROM reviews"


def _clean(text: str) -> str:
    return (
        rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({text}), 'http[^{WS}]+', '', 'g'), "
        rf"'[^a-z0-9{WS}]', '', 'g'), '[{WS}]+', ' ', 'g'))"
    )


CLEAN_REVIEWS = f"""
    SELECT class_index, row_id, {_clean("coalesce(review_title, '') || ': ' || review_text")} AS clean_text
    FROM reviews WHERE review_text IS NOT NULL AND class_index IS NOT NULL"""


def _roc(run: str) -> str:
    return f"""
    SELECT cls, round(score, 6) AS threshold, round(CAST(fp AS DOUBLE) / CAST(all_neg AS DOUBLE), 6) AS fpr,
           round(CAST(tp AS DOUBLE) / CAST(all_pos AS DOUBLE), 6) AS tpr
    FROM {run} WHERE rn = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
    UNION ALL SELECT DISTINCT cls, CAST('inf' AS DOUBLE), 0.0e0, 0.0e0 FROM {run}"""


def _auc(run: str) -> str:
    return f"""
    SELECT cls, CAST(sum(CAST(neg AS HUGEINT) * (2 * tp - pos)) AS DOUBLE)
                / (2 * CAST(max(all_pos) AS DOUBLE) * CAST(max(all_neg) AS DOUBLE)) AS auc
    FROM {run} GROUP BY cls"""


def _pr(run: str) -> str:
    return f"""
    SELECT cls, round(score, 6) AS threshold, round(CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE), 6) AS precision,
           round(CAST(tp AS DOUBLE) / CAST(all_pos AS DOUBLE), 6) AS recall FROM {run}
    UNION ALL SELECT DISTINCT cls, CAST(NULL AS DOUBLE), 1.0e0, 0.0e0 FROM {run}"""


def _ap(run: str) -> str:
    return f"""
    SELECT cls, round(sum(CAST(pos AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE))
                      / CAST(max(all_pos) AS DOUBLE), 6) AS ap FROM {run} GROUP BY cls"""


def _layer(vec: str, rows: int, cols: int, salt: int, relu: bool) -> str:
    """One dense layer of rule weights over a list expression."""
    weight = f"((((r + {salt}) * 31 + (c + 1) * 17) % 23 - 11) / 10.0e0)"
    total = f"list_sum([CAST({vec}[c + 1] AS DOUBLE) * {weight} FOR c IN range({cols})]) + ((r % 3) - 1) / 10.0e0"
    return f"[{f'greatest(0.0e0, {total})' if relu else total} FOR r IN range({rows})]"


def _logits(n: int) -> str:
    return ", ".join(f"round(logits[{i + 1}], 6) AS logit_{i}" for i in range(n))


BINS = 20

ORACLES: dict[str, str] = {
    # Sources and sinks
    "load_splits": """
        SELECT doc_id AS row_id, text, 'train' AS split FROM documents
        UNION ALL SELECT item_id, text, 'test' FROM benchmark""",
    "csv_scan": "SELECT doc_id AS row_id, CAST(doc_id % 3 AS INTEGER) AS label, text FROM documents",
    "csv_roundtrip": _with("reviews", "SELECT * FROM reviews"),
    "csv_reviews": _with("reviews", "SELECT class_index, review_title, review_text, CAST(1 AS BIGINT) AS rows_of_id FROM reviews"),
    "prepared_cache": _with("labelled", f"""
        SELECT row_id, label FROM (
            SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_key('42')}, row_id) AS rn,
                   count(*) OVER (PARTITION BY label) AS size FROM labelled)
        WHERE rn <= round_even(CAST(0.1 AS DOUBLE) * size, 0)"""),
    "eval_report_json": _with("cells per_class", """
        , overall AS (
            SELECT sum(hits) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS p,
                   sum(recall * support) / sum(support) AS r, sum(f1 * support) / sum(support) AS f,
                   avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, sum(support) AS n FROM per_class),
        filled AS (
            SELECT a.c AS y, b.c AS pred, coalesce(n, 0) AS n
            FROM (SELECT unnest(range(3)) AS c) a, (SELECT unnest(range(3)) AS c) b
            LEFT JOIN cells ON cells.y = a.c AND cells.pred = b.c),
        matrix AS (
            SELECT string_agg(line, ';' ORDER BY y) AS conf_matrix
            FROM (SELECT y, string_agg(CAST(n AS VARCHAR), ',' ORDER BY pred) AS line FROM filled GROUP BY 1)),
        entries AS (
            SELECT CAST(cls AS VARCHAR) AS entry, precision AS ep, recall AS er, f1 AS ef, support AS n FROM per_class
            UNION ALL SELECT 'macro avg', mp, mr, mf, n FROM overall
            UNION ALL SELECT 'weighted avg', p, r, f, n FROM overall
            UNION ALL SELECT 'accuracy', NULL, NULL, accuracy, NULL FROM overall)
        SELECT round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, conf_matrix,
               entry, round(ep, 6) AS entry_precision, round(er, 6) AS entry_recall, round(ef, 6) AS entry_f1,
               entries.n AS entry_support
        FROM overall, matrix, entries"""),
    "eval_summary": _with("cells per_class", """
        , report AS (
            SELECT sum(hits) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS p,
                   sum(recall * support) / sum(support) AS r, sum(f1 * support) / sum(support) AS f FROM per_class),
        lines AS (
            SELECT 0 AS line_no, 'EVALUATION RESULTS' AS value
            UNION ALL SELECT 1, repeat('=', 40)
            UNION ALL SELECT 2, printf('Accuracy: %.4f', accuracy) FROM report
            UNION ALL SELECT 3, printf('Precision: %.4f', p) FROM report
            UNION ALL SELECT 4, printf('Recall: %.4f', r) FROM report
            UNION ALL SELECT 5, printf('F1 Score: %.4f', f) FROM report
            UNION ALL SELECT 6, repeat('=', 40)
            UNION ALL SELECT 7, ''
            UNION ALL SELECT 8, 'Classification Report:'
            UNION ALL SELECT 9 + 5 * cls, 'Class ' || (['Negative', 'Neutral', 'Positive'])[cls + 1] || ':' FROM per_class
            UNION ALL SELECT 10 + 5 * cls, printf('  Precision: %.4f', precision) FROM per_class
            UNION ALL SELECT 11 + 5 * cls, printf('  Recall: %.4f', recall) FROM per_class
            UNION ALL SELECT 12 + 5 * cls, printf('  F1-Score: %.4f', f1) FROM per_class
            UNION ALL SELECT 13 + 5 * cls, printf('  Support: %.1f', support) FROM per_class)
        SELECT CAST(line_no AS INTEGER) AS line_no, value FROM lines"""),
    "model_roundtrip": """
        SELECT count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM documents JOIN labels USING (doc_id)""",
    # Profiling
    "head_rows": _with("ratings", "SELECT * FROM ratings ORDER BY row_id LIMIT 5"),
    "split_counts": """
        SELECT 'train' AS split, count(*) AS n FROM documents UNION ALL SELECT 'test', count(*) FROM benchmark""",
    "null_counts": _with("reviews", " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM reviews" for c in REVIEW_COLUMNS)),
    "column_info": _with("reviews", " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS non_null, '{t}' AS dtype FROM reviews"
        for c, t in zip(REVIEW_COLUMNS, REVIEW_TYPES))),
    "value_counts": _with("ratings", """
        SELECT class_index AS value, count(*) AS n FROM ratings WHERE class_index IS NOT NULL GROUP BY 1"""),
    "value_shares": _with("reviews", """
        SELECT review_title AS value,
               CAST(count(*) AS DOUBLE) / CAST((SELECT count(review_title) FROM reviews) AS DOUBLE) AS share
        FROM reviews WHERE review_title IS NOT NULL GROUP BY 1"""),
    "class_count": _with("reviews", """
        SELECT count(DISTINCT review_title) + max(CASE WHEN review_title IS NULL THEN 1 ELSE 0 END) AS classes
        FROM reviews"""),
    "max_words": r"SELECT max(len(regexp_extract_all(text, '[\pL\pN_]+'))) AS max_words FROM documents",
    # Projection, cleaning, labels
    "drop_null_reviews": _with("reviews", """
        SELECT * FROM reviews WHERE review_text IS NOT NULL AND class_index IS NOT NULL"""),
    "fill_titles": _with("reviews", f"SELECT row_id, review_title FROM ({FILLED})"),
    "title_text": _with("reviews", f"SELECT row_id, review_title || ': ' || review_text AS text FROM ({FILLED})"),
    "lower_text": "SELECT doc_id AS row_id, lower(text) AS text FROM documents",
    "strip_urls": rf"""
        SELECT page_id AS row_id, regexp_replace('see ' || url || ' ' || html, 'http[^{WS}]+', '', 'g') AS text FROM pages""",
    "strip_chars": rf"SELECT doc_id AS row_id, regexp_replace(text, '[^a-z0-9{WS}]', '', 'g') AS text FROM documents",
    "squeeze_spaces": rf"SELECT doc_id AS row_id, trim(regexp_replace(text, '[{WS}]+', ' ', 'g')) AS text FROM documents",
    "clean_text": _with("clean", "SELECT row_id, text FROM clean"),
    "drop_columns": _with("reviews", CLEAN_REVIEWS),
    "rename_columns": _with("reviews", f"SELECT row_id, class_index AS label, clean_text AS text FROM ({CLEAN_REVIEWS})"),
    "cast_columns": """
        SELECT o_orderkey AS row_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS label,
               CAST(o_custkey AS VARCHAR) AS text FROM orders""",
    "map_labels": _with("labelled", "SELECT row_id, label AS class_index FROM labelled"),
    "zero_base_labels": _with("ratings reviews", """
        , shift AS (SELECT CASE WHEN count(*) FILTER (class_index = 0) = 0 AND count(*) FILTER (class_index = 1) > 0
                                THEN 1 ELSE 0 END AS s FROM ratings)
        SELECT row_id, CAST(class_index - (SELECT s FROM shift) AS INTEGER) AS label, 'train' AS split FROM ratings
        UNION ALL SELECT row_id, CAST(class_index - (SELECT s FROM shift) AS INTEGER), 'test' FROM reviews"""),
    "class_slice": _with("labelled", "SELECT * FROM labelled WHERE label = 1"),
    "label_guard": _with("ratings", """
        SELECT class_index, count(*) AS n FROM ratings WHERE class_index BETWEEN 0 AND 3 GROUP BY 1
        UNION ALL SELECT -1, count(*) FILTER (class_index NOT BETWEEN 0 AND 3) FROM ratings"""),
    "nan_guard": _with("scored", """
        SELECT y, count(*) AS n FROM scored WHERE row_id % 13 <> 0 GROUP BY 1
        UNION ALL SELECT -1, count(*) FILTER (row_id % 13 = 0) FROM scored"""),
    "text_preview": """
        SELECT doc_id AS row_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview
        FROM documents""",
    # Sampling, splitting, ordering, batching
    "balance_classes": _with("labelled", f"""
        SELECT row_id, label FROM (
            SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_key('42')}, row_id) AS rn FROM labelled)
        WHERE label = 1 OR rn <= (SELECT count(*) FROM labelled WHERE label = 1)"""),
    "union_slices": _with("labelled", "SELECT * FROM labelled WHERE label IN (0, 1, 2)"),
    "train_test_split": _with("labelled", f"""
        , sizes AS (SELECT label, count(*) AS size FROM labelled GROUP BY 1),
        goal AS (SELECT CAST(ceil(CAST(0.2 AS DOUBLE) * sum(size)) AS BIGINT) AS wanted, CAST(sum(size) AS BIGINT) AS total FROM sizes),
        base AS (SELECT label, wanted, wanted * size // total AS base, wanted * size % total AS rest FROM sizes, goal),
        quota AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
                                             <= wanted - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM base),
        ranked AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {_key('42')}, row_id) AS rn FROM labelled)
        SELECT row_id, label, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM ranked JOIN quota USING (label)"""),
    "random_split": _with("labelled", f"""
        SELECT row_id, label, CASE WHEN rn <= ceil(CAST(0.2 AS DOUBLE) * size) THEN 'test' ELSE 'train' END AS split
        FROM (SELECT *, row_number() OVER (ORDER BY {_key('42')}, row_id) AS rn, count(*) OVER () AS size FROM labelled)"""),
    "epoch_order": _with("labelled", f"""
        SELECT row_id, label, row_number() OVER (ORDER BY {_key('42:1')}, row_id) - 1 AS pos FROM labelled"""),
    "epoch_permutation": _with("labelled", """
        , size AS (SELECT count(*) AS n, greatest(CAST(ceil(sqrt(CAST(count(*) AS DOUBLE))) AS BIGINT), 1) AS a FROM labelled),
        square AS (SELECT n, a, greatest((n + a - 1) // a, 1) AS b FROM size),
        walk AS (
            SELECT row_id, epoch, '42:' || epoch AS key, 0 AS step, (row_number() OVER (PARTITION BY epoch ORDER BY row_id) - 1) AS x
            FROM labelled, (SELECT unnest([1, 2, 3]) AS epoch)
            UNION ALL
            SELECT row_id, epoch, key, step + 1, l * b + r FROM (
            SELECT *, (r4 + ('0x' || substr(md5(key || ':5:' || l), 1, 15))::BIGINT) % b AS r FROM (
            SELECT *, (l2 + ('0x' || substr(md5(key || ':4:' || r4), 1, 15))::BIGINT) % a AS l FROM (
            SELECT *, (r2 + ('0x' || substr(md5(key || ':3:' || l2), 1, 15))::BIGINT) % b AS r4 FROM (
            SELECT *, (l1 + ('0x' || substr(md5(key || ':2:' || r2), 1, 15))::BIGINT) % a AS l2 FROM (
            SELECT *, (r0 + ('0x' || substr(md5(key || ':1:' || l1), 1, 15))::BIGINT) % b AS r2 FROM (
            SELECT *, (l0 + ('0x' || substr(md5(key || ':0:' || r0), 1, 15))::BIGINT) % a AS l1 FROM (
            SELECT row_id, epoch, key, step, n, a, b, x // b AS l0, x % b AS r0 FROM walk, square WHERE step = 0 OR x >= n)))))))
        )
        SELECT row_id, epoch, x AS place FROM walk, square WHERE step > 0 AND x < n""", recursive=True),
    "shard_rows": _with("labelled", f"""
        , mixed AS (SELECT row_id, row_number() OVER (ORDER BY {_key('42:0')}, row_id) - 1 AS pos FROM labelled),
        plain AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM labelled),
        size AS (SELECT count(*) AS n, (count(*) + 6) // 7 * 7 AS padded FROM labelled)
        SELECT 'drop' AS mode, row_id, pos, CAST(pos % 7 AS INTEGER) AS shard FROM mixed, size WHERE pos < n - n % 7
        UNION ALL SELECT 'pad', row_id, pos, CAST(pos % 7 AS INTEGER) FROM plain
        UNION ALL SELECT 'pad', row_id, pos + n, CAST((pos + n) % 7 AS INTEGER) FROM plain, size WHERE pos < padded - n"""),
    "batch_rows": _with("labelled", f"""
        SELECT row_id, pos, pos // 64 AS batch_id
        FROM (SELECT row_id, row_number() OVER (ORDER BY {_key('42:0')}, row_id) - 1 AS pos, count(*) OVER () AS n FROM labelled)
        WHERE pos < n - n % 64"""),
    "sample_rows": _with("labelled", f"SELECT * FROM labelled ORDER BY {_key('42')}, row_id LIMIT 10"),
    # Encoding and vectors
    "build_vocab": _with("vocab", "SELECT token, n, id FROM vocab"),
    "encode_text": _with("vocab", """
        , words AS (SELECT row_id, ([t FOR t IN string_split(text, ' ') IF t <> ''])[1:510] AS ws FROM clean),
        spread AS (SELECT row_id, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM words),
        coded AS (SELECT row_id, list(coalesce(id, 1) ORDER BY pos) AS ids FROM spread LEFT JOIN vocab USING (token) GROUP BY 1),
        marked AS (SELECT row_id, [2] || coalesce(ids, []) || [3] AS ids FROM words LEFT JOIN coded USING (row_id))
        SELECT row_id,
               array_to_string(ids || [0 FOR x IN range(512 - len(ids))], ' ') AS input_ids,
               array_to_string([CASE WHEN x < len(ids) THEN 1 ELSE 0 END FOR x IN range(512)], ' ') AS attention_mask,
               array_to_string([0 FOR x IN range(512)], ' ') AS token_type_ids
        FROM marked"""),
    "max_pool": _with("tokens", """
        SELECT row_id, dim, round(max(CASE WHEN mask = 1 THEN CAST(value AS DOUBLE) ELSE -1e9 END), 6) AS value
        FROM (SELECT row_id, mask, unnest(vec) AS value, CAST(unnest(range(len(vec))) AS INTEGER) AS dim FROM tokens)
        GROUP BY 1, 2"""),
    "first_pool": _with("tokens", """
        SELECT row_id, CAST(unnest(range(len(vec))) AS INTEGER) AS dim, CAST(unnest(vec) AS DOUBLE) AS value
        FROM tokens WHERE pos = 0"""),
    "linear_logits": _with("vectors", f"""
        SELECT row_id, {_logits(3)} FROM (SELECT row_id, {_layer('vec', 3, 64, 1, False)} AS logits FROM vectors)"""),
    "mlp_logits": _with("vectors", f"""
        , h1 AS (SELECT row_id, {_layer('vec', 32, 64, 1, True)} AS h FROM vectors),
        h2 AS (SELECT row_id, {_layer('h', 16, 32, 2, True)} AS h FROM h1),
        h3 AS (SELECT row_id, {_layer('h', 3, 16, 3, False)} AS logits FROM h2)
        SELECT row_id, {_logits(3)} FROM h3"""),
    # Scoring
    "score_batches": _with("vectors", f"""
        SELECT row_id, {_logits(10)} FROM (SELECT row_id, {_layer('vec', 10, 64, 1, False)} AS logits FROM vectors)"""),
    "softmax": _with("scored", """
        SELECT row_id, round(exp(l0 - m) / s, 6) AS p0, round(exp(l1 - m) / s, 6) AS p1, round(exp(l2 - m) / s, 6) AS p2
        FROM (SELECT *, exp(l0 - m) + exp(l1 - m) + exp(l2 - m) AS s
              FROM (SELECT *, greatest(l0, l1, l2) AS m FROM scored))"""),
    "argmax": _with("scored", "SELECT row_id, pred FROM scored"),
    "class_names": _with("ratings", """
        SELECT row_id, coalesce((['Negative', 'Neutral', 'Positive'])[class_index], 'Unknown') AS sentiment FROM ratings"""),
    "original_class": _with("scored", "SELECT row_id, pred + 1 AS original_class FROM scored"),
    "confidence": _with("scored", "SELECT row_id, conf AS confidence FROM scored"),
    "spot_check": _with("scored_docs docs", f"""
        SELECT row_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview,
               (['Negative', 'Neutral', 'Positive'])[y + 1] AS true_name,
               (['Negative', 'Neutral', 'Positive'])[pred + 1] AS pred_name, conf AS confidence
        FROM (SELECT * FROM scored_docs ORDER BY {_key('42')}, row_id LIMIT 10) JOIN docs USING (row_id)"""),
    # Loss and metrics
    "row_loss": _with("losses", "SELECT row_id, round(loss, 6) AS loss FROM losses"),
    "epoch_loss": _with("losses", f"""
        SELECT round(avg(m), 6) AS epoch_loss FROM (
            SELECT pos // 64 AS batch_id, avg(loss) AS m
            FROM (SELECT *, row_number() OVER (ORDER BY {_key('42:0')}, row_id) - 1 AS pos FROM losses) GROUP BY 1)"""),
    "accuracy": _with("scored", "SELECT avg(CASE WHEN y = pred THEN 1.0e0 ELSE 0.0e0 END) AS accuracy FROM scored"),
    "weighted_prf": _with("per_class", """
        SELECT round(sum(precision * support) / sum(support), 6) AS precision,
               round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1
        FROM per_class"""),
    "class_report": _with("per_class", """
        SELECT CAST(cls AS VARCHAR) AS cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
               CAST(support AS BIGINT) AS support FROM per_class
        UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM per_class
        UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                         CAST(sum(support) AS BIGINT) FROM per_class
        UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                         round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                         CAST(sum(support) AS BIGINT) FROM per_class"""),
    "confusion_matrix": _with("cells", """
        SELECT CAST(a.c AS INTEGER) AS y, CAST(b.c AS INTEGER) AS pred, coalesce(n, 0) AS n
        FROM (SELECT unnest(range(4)) AS c) a, (SELECT unnest(range(4)) AS c) b
        LEFT JOIN cells ON cells.y = a.c AND cells.pred = b.c"""),
    "top_confusions": _with("cells", """
        SELECT CAST(a.c AS INTEGER) AS y, CAST(b.c AS INTEGER) AS pred, coalesce(n, 0) AS n
        FROM (SELECT unnest(range(3)) AS c) a, (SELECT unnest(range(3)) AS c) b
        LEFT JOIN cells ON cells.y = a.c AND cells.pred = b.c
        WHERE a.c <> b.c ORDER BY n DESC, a.c, b.c LIMIT 5"""),
    "one_vs_rest": _with("pairs", "SELECT * FROM pairs"),
    "roc_curve": _with("run", _roc("run")),
    "roc_micro": _with("run_micro", _roc("run_micro")),
    "roc_auc": _with("run run_micro", f"{_auc('run')} UNION ALL {_auc('run_micro')}"),
    "pr_curve": _with("run run_micro", f"{_pr('run')} UNION ALL {_pr('run_micro')}"),
    "average_precision": _with("run run_micro", f"{_ap('run')} UNION ALL {_ap('run_micro')}"),
    "class_distribution": _with("per_class", """
        SELECT cls, CAST(support AS BIGINT) AS true_n, CAST(predicted AS BIGINT) AS pred_n FROM per_class"""),
    "metric_table": _with("per_class", """
        SELECT (['Negative', 'Neutral', 'Positive'])[cls + 1] AS class_name, round(precision, 6) AS precision,
               round(recall, 6) AS recall, round(f1, 6) AS f1 FROM per_class"""),
    "confidence_histogram": _with("scored", f"""
        , g AS (SELECT CASE WHEN y = pred THEN 'correct' ELSE 'incorrect' END AS grp, conf AS c FROM scored),
        r0 AS (SELECT grp, min(c) AS lo, max(c) AS hi, count(*) AS group_size FROM g GROUP BY 1),
        r AS (SELECT grp, CASE WHEN lo = hi THEN lo - 0.5e0 ELSE lo END AS lo,
                     CASE WHEN lo = hi THEN hi + 0.5e0 ELSE hi END AS hi, group_size FROM r0),
        guess AS (SELECT grp, c, lo, (hi - lo) / {BINS} AS width,
                         CAST(least(floor((c - lo) / (hi - lo) * {BINS}), {BINS} - 1) AS INTEGER) AS i FROM g JOIN r USING (grp)),
        placed AS (SELECT grp, CASE WHEN c < i * width + lo THEN i - 1
                                    WHEN i < {BINS} - 1 AND c >= (i + 1) * width + lo THEN i + 1 ELSE i END AS bin FROM guess),
        counted AS (SELECT grp, bin, count(*) AS n FROM placed GROUP BY 1, 2),
        grid AS (SELECT grp, CAST(bin AS INTEGER) AS bin
                 FROM (SELECT unnest(['correct', 'incorrect']) AS grp), (SELECT unnest(range({BINS})) AS bin)),
        ranged AS (SELECT grp, bin, coalesce(lo, 0.0e0) AS lo, coalesce(hi, 1.0e0) AS hi,
                          coalesce(group_size, 0) AS group_size FROM grid LEFT JOIN r USING (grp))
        SELECT grp, bin, round(bin * ((hi - lo) / {BINS}) + lo, 6) AS bin_lo,
               round(CASE WHEN bin = {BINS} - 1 THEN hi ELSE (bin + 1) * ((hi - lo) / {BINS}) + lo END, 6) AS bin_hi,
               coalesce(n, 0) AS n, group_size
        FROM ranged LEFT JOIN counted USING (grp, bin)"""),
    "misclassified": _with("scored", "SELECT row_id, y, pred FROM scored WHERE y <> pred"),
    "misclassified_sample": _with("scored_docs docs", f"""
        SELECT row_id, text, {_name('y')} AS true_name, {_name('pred')} AS pred_name
        FROM (SELECT * FROM scored_docs WHERE y <> pred ORDER BY {_key('42')}, row_id LIMIT 5) JOIN docs USING (row_id)"""),
    "confident_errors": _with("scored_docs docs", f"""
        SELECT row_id, text, {_name('y')} AS true_name, {_name('pred')} AS pred_name
        FROM (SELECT * FROM scored_docs WHERE y <> pred ORDER BY conf DESC, row_id LIMIT 5) JOIN docs USING (row_id)"""),
    # Fitting and model selection
    "early_stop": _with("history", """
        , h AS (SELECT *, row_number() OVER (ORDER BY epoch) AS i FROM history),
        fold AS (
            SELECT CAST(0 AS BIGINT) AS i, CAST('-inf' AS DOUBLE) AS best, CAST(NULL AS BIGINT) AS best_epoch, 0 AS counter,
                   CAST(NULL AS BIGINT) AS stop_epoch
            UNION ALL
            SELECT h.i, CASE WHEN h.f1 < best + 0.001e0 THEN best ELSE h.f1 END,
                   CASE WHEN h.f1 < best + 0.001e0 THEN best_epoch ELSE CAST(h.epoch AS BIGINT) END,
                   CASE WHEN h.f1 < best + 0.001e0 THEN counter + 1 ELSE 0 END,
                   CASE WHEN h.f1 < best + 0.001e0 AND counter + 1 >= 5 THEN h.epoch END
            FROM fold JOIN h ON h.i = fold.i + 1 WHERE stop_epoch IS NULL)
        SELECT stop_epoch, best_epoch, best AS best_score, counter FROM fold ORDER BY i DESC LIMIT 1""", recursive=True),
    "best_epoch": _with("history", "SELECT epoch, f1 FROM history WHERE f1 > 0 ORDER BY f1 DESC, epoch LIMIT 1"),
}
ORACLES["stratified_sample"] = ORACLES["prepared_cache"]

# Whole jobs: prepared splits from the cleaned reviews, and figures of the evaluation from the queries above.
ORACLES["prepare_job"] = _with("reviews", f"""
    , ready AS (
        SELECT row_id, CASE WHEN class_index IN (4, 5) THEN 2 WHEN class_index = 3 THEN 1 ELSE 0 END AS label, clean_text AS text
        FROM ({CLEAN_REVIEWS})),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_key('42')}, row_id) AS rn FROM ready)
    SELECT row_id, label, text, 'train' AS split FROM ranked WHERE label = 1 OR rn <= 30
    UNION ALL SELECT row_id, label, text, 'test' FROM ready WHERE row_id % 4 = 0""")
ORACLES["evaluate_job"] = f"""
    SELECT 'class_report' AS name, cls AS key, f1 AS value FROM ({ORACLES['class_report']})
    UNION ALL SELECT 'confusion_matrix', y || '-' || pred, CAST(n AS DOUBLE) FROM ({ORACLES['confusion_matrix']}) WHERE y < 3 AND pred < 3
    UNION ALL SELECT 'roc_auc', cls, round(auc, 6) FROM ({ORACLES['roc_auc']})
    UNION ALL SELECT 'average_precision', cls, round(ap, 6) FROM ({ORACLES['average_precision']})"""
