"""Queries opN_<name> over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from llm import chat, clustering, decontamination, exact_dedup, language_id, lexical_search, packing, secrets, simhash, suffix_dedup, token_counts, token_files, warc
from llm.common import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), shortest=0)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json", end_id=0, size=2048)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.held_out()
    return language_id.identify(docs, language_id.fit(docs, ~held_out), held_out)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json", end_id=2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = shared_folder(spark, "counts-cache")
    token_counts.fill_cache(table(spark, sf_dir, "benchmark"), cache, tokenizer="word_bpe_49k.json")  # documents meet a cache that holds counts
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json", limit=2048, cache=cache)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"), length=50)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.lloyd(table(spark, sf_dir, "embeddings"), k=8, rounds=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_decontamination": op1_decontamination,
    "op2_chat_format": op2_chat_format,
    "op3_secret_scan": op3_secret_scan,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc": op5_warc,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_language_id": op7_language_id,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_token_ids": op9_token_ids,
    "op10_token_counts": op10_token_counts,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_centroid_clustering": op13_centroid_clustering,
}

#: A-Z in lower case and nothing else, in DuckDB.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Terms of a text for the ranked search, in DuckDB.
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _lloyd_sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Each round is two common table expressions: the nearest centroid of every vector, then the centroids' new numbers."""
    nearest = "SELECT r, vec_id, v, arg_min(n, (d, n)) AS n, min(d) AS d FROM (SELECT r, vec_id, v, n, CAST(list_sum(list_transform(range(1, {size} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM v, c{i}) GROUP BY r, vec_id, v"
    moved = "SELECT n, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY p) AS c FROM (SELECT n, p, sum(x) AS s, count(*) AS m FROM (SELECT n, unnest(v) AS x, unnest(range({size})) AS p FROM a{i}) GROUP BY n, p) GROUP BY n"
    steps = []
    for i in range(rounds):
        steps += [f"a{i} AS MATERIALIZED ({nearest.format(i=i, size=size)})", f"m{i} AS ({moved.format(i=i, size=size)})", f"c{i + 1} AS MATERIALIZED (SELECT c{i}.n, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (n))"]
    return f"""
        WITH kept AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
        v AS MATERIALIZED (SELECT r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM kept),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS n, v AS c FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM v ORDER BY h LIMIT {k})),
        {", ".join(steps)},
        placed AS ({nearest.format(i=rounds, size=size)})
        SELECT vec_id, CAST(n AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY n) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM placed JOIN c{rounds} USING (n)"""


ORACLES: dict[str, str] = {
    "op11_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        places AS (SELECT r, doc_id, h, unnest(range(CAST(length(h) // 2 - 49 AS BIGINT))) AS p FROM d WHERE length(h) >= 100),
        hashed AS MATERIALIZED (SELECT r, doc_id, p, hash(substr(h, 2 * p + 1, 100)) AS k FROM places),
        starts AS MATERIALIZED (SELECT hashed.r, hashed.doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM hashed JOIN (SELECT k FROM hashed GROUP BY k HAVING min(doc_id) < max(doc_id)) USING (k) JOIN d ON d.r = hashed.r),
        firsts AS (SELECT s, min(doc_id) AS first FROM starts GROUP BY s),
        gone AS (SELECT r, p FROM starts JOIN firsts USING (s) WHERE first < doc_id),
        runs AS (SELECT r, p, CASE WHEN p <= lag(p) OVER w + 50 THEN 0 ELSE 1 END AS begins FROM gone WINDOW w AS (PARTITION BY r ORDER BY p)),
        numbered AS (SELECT r, p, sum(begins) OVER (PARTITION BY r ORDER BY p) AS run FROM runs),
        spans AS (SELECT r, run, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY r, run),
        ends AS (SELECT r, a, b, coalesce(lag(b) OVER w, 0) AS before FROM spans WINDOW w AS (PARTITION BY r ORDER BY a)),
        parts AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM ends JOIN d USING (r) GROUP BY r)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
        FROM d LEFT JOIN parts USING (r)""",
    "op12_lexical_search": f"""
        WITH cut AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
        tf AS (SELECT r, doc_id, t, count(*) AS tf FROM (SELECT r, doc_id, unnest(w) AS t FROM cut) GROUP BY ALL),
        total AS (SELECT count(*) AS N, sum(len(w)) AS L FROM cut WHERE len(w) > 0),
        sized AS (SELECT r, 100 - 75 + CAST((75 * len(w) * N) // L AS BIGINT) AS m FROM cut, total WHERE len(w) > 0),
        df AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(N) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t),
        asked AS (SELECT q, item_id, t, count(*) AS n FROM (SELECT row_number() OVER () AS q, item_id, unnest({WORDS}) AS t FROM benchmark) GROUP BY ALL),
        sums AS (SELECT q, item_id, r, doc_id, CAST(sum(n * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM asked JOIN df USING (t) JOIN tf USING (t) JOIN sized USING (r) GROUP BY q, item_id, r, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM sums WHERE score > 0 QUALIFY rank <= 10""",
    "op13_centroid_clustering": _lloyd_sql(),
    "op2_chat_format": r"""
        WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
        cut AS (SELECT r, conv_id, turn, unnest(string_split_regex(text, '\r?\n')) AS line, unnest(range(len(string_split_regex(text, '\r?\n')))) AS pos FROM m),
        l AS (SELECT r, conv_id, turn, pos, length(regexp_replace(regexp_extract(line, '^(([ \t]*>)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '^([ \t]*>)+', '') AS body FROM cut),
        b AS (SELECT *, level IS DISTINCT FROM lag(level) OVER (PARTITION BY r ORDER BY pos) AS begins FROM l),
        runs AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY pos) AS run FROM b),
        own AS (SELECT r, conv_id, turn, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (level = 0), ''), '^\s+|\s+$', '', 'g') AS text, count(*) FILTER (level > 0) AS quoted FROM l GROUP BY r, conv_id, turn),
        passages AS (SELECT r, conv_id, turn, level, string_agg(body, chr(10) ORDER BY pos) AS text, count(*) + 1 AS weight FROM runs GROUP BY r, conv_id, turn, run, level),
        keys AS (SELECT conv_id, turn, level, weight, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm FROM
            (SELECT conv_id, turn, level, weight, text FROM passages UNION ALL SELECT conv_id, turn, level, 1, body FROM l UNION ALL SELECT conv_id, turn, 0, 1, text FROM own)),
        originals AS (SELECT conv_id, norm, min(turn) AS original FROM keys WHERE level = 0 AND norm <> '' GROUP BY ALL),
        votes AS (SELECT conv_id, turn, level, original, sum(weight) AS weight FROM keys JOIN originals USING (conv_id, norm) WHERE level > 0 AND original < turn GROUP BY ALL),
        parents AS (SELECT conv_id, turn, arg_max(original, (-level, weight, original)) AS parent FROM votes GROUP BY conv_id, turn),
        paths AS (SELECT conv_id, turn, parent AS up, [turn] AS path FROM parents UNION ALL SELECT p.conv_id, p.turn, q.parent, list_prepend(p.up, p.path) FROM paths p JOIN parents q ON p.conv_id = q.conv_id AND p.up = q.turn),
        done AS (SELECT conv_id, turn, list_prepend(up, path) AS path FROM paths p WHERE NOT EXISTS (SELECT 1 FROM parents q WHERE q.conv_id = p.conv_id AND q.turn = p.up)),
        threads AS (SELECT conv_id, turn, path FROM done UNION SELECT conv_id, path[1], path[1:1] FROM done),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, path[1] ORDER BY path) - 1 AS position FROM threads)
        SELECT m.conv_id, m.turn, m.role, parent AS parent_turn, coalesce(path[1], m.turn) AS root_turn, CAST(coalesce(len(path), 1) - 1 AS INT) AS depth, coalesce(position, 0) AS position,
            CAST(quoted AS INT) AS n_quoted_lines, own.text AS text, '<|' || coalesce(m.role, '') || '|>' || chr(10) || own.text AS chat
        FROM m JOIN own USING (r) LEFT JOIN parents ON parents.conv_id = m.conv_id AND parents.turn = m.turn LEFT JOIN placed ON placed.conv_id = m.conv_id AND placed.turn = m.turn""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS INT), 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p""",
    "op1_decontamination": rf"""
        WITH cut AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        spans AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS g
                  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM items WHERE len(w) > 0)),
        starts AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM cut, (SELECT DISTINCT size FROM spans) WHERE len(w) >= size),
        found AS (SELECT r, s, size, array_to_string(w[s : s + size - 1], ' ') AS g FROM starts WHERE g IN (SELECT g FROM spans)),
        hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS p FROM found) GROUP BY r),
        listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found JOIN spans USING (g)) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM cut LEFT JOIN hits USING (r) LEFT JOIN listed USING (r)""",
    "op4_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {LOWER} AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
}
