"""Registered queries of the training-data operators, each over its whole table, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, codes, decontam, lines, minhash, pii, shards, substring, topk, toxicity, trie
from .common import table


def tokenizer_path() -> str:
    """The public vocabulary of the contract; its place is only known where its package is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_hundredths(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR
        NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])),
         lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_report(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (
  SELECT doc_id, i, list_slice(w, i, i + 12) AS p FROM words, unnest(range(1, len(w) - 11)) AS u(i) WHERE len(w) >= 13),
firsts AS (SELECT p, min(doc_id) AS first_doc FROM places GROUP BY p),
gone AS (
  SELECT DISTINCT doc_id, i + j AS k FROM places JOIN firsts USING (p), unnest(range(0, 13)) AS v(j)
  WHERE first_doc < doc_id),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS kept
  FROM (SELECT doc_id, k, w[k] AS x FROM words, unnest(range(1, len(w) + 1)) AS u(k)) AS every
  ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id) LEFT JOIN removed r USING (doc_id)
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_report(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(text,
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
patterns AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS p
  FROM items, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM patterns),
cand AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS p
  FROM words, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
hits AS (SELECT c.doc_id, c.n, c.i, p.item_id FROM cand c JOIN patterns p ON c.n = p.n AND c.p = p.p),
hit_words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(j) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
  FROM hits GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS s
  FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS id, doc_id AS seen FROM documents
  UNION SELECT r.id, l.y FROM reach r JOIN both_ways l ON l.x = r.seen)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT id, min(seen) AS c FROM reach GROUP BY id) m ON m.id = d.doc_id
"""


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, x, w, list_transform(w, lambda y: CASE WHEN regexp_matches(y, '[0-9]') THEN chr(10) ELSE y END) AS t
  FROM (SELECT doc_id, i, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '') AS d,
             unnest(range(1, len(l) + 1)) AS u(i), LATERAL (SELECT l[i] AS x) AS v)),
sized AS (SELECT *, len(list_filter(t, lambda y: y <> chr(10))) AS words FROM lines),
shapes AS (SELECT DISTINCT t, words FROM sized WHERE words > 3),
leaves AS (
  SELECT t, words, {'tree': tree, 'n': len(t), 'a': t[p], 'b': t[p + 1]} AS leaf
  FROM (SELECT *, CASE tree WHEN 'first' THEN 1 WHEN 'middle' THEN len(t) // 2 ELSE len(t) - 1 END AS p
        FROM shapes, (VALUES ('first'), ('middle'), ('last')) AS v(tree))),
crowded AS (SELECT *, count(*) OVER (PARTITION BY leaf) AS shapes FROM leaves),
places AS (
  SELECT t, words, leaf, shapes, k, t[k] AS token
  FROM crowded, unnest(range(1, len(t) + 1)) AS u(k) WHERE shapes > 1 AND t[k] <> chr(10)),
counts AS (SELECT *, count(*) OVER (PARTITION BY leaf, k, token) AS n FROM places),
masked AS (
  SELECT t, words, leaf, step, list({'k': k, 'token': token} ORDER BY k) AS part
  FROM counts, unnest(range(1, 41)) AS u(step) WHERE 2 ** step <= shapes AND n >= 2 ** step GROUP BY t, words, leaf, step),
merged AS (
  SELECT DISTINCT t, leaf, part FROM masked
  WHERE len(part) < words AND 3 * (words - len(part)) <= words AND len(part) >= 3),
keyed AS (
  SELECT doc_id, i, {'leaf': NULL, 'part': NULL, 'whole': t} AS key FROM sized WHERE words > 0
  UNION ALL SELECT doc_id, i, {'leaf': leaf, 'part': part, 'whole': NULL} FROM sized JOIN merged USING (t)),
found AS (SELECT key, min(doc_id) AS first_doc FROM keyed GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
long AS (SELECT w, min(doc_id) AS first_doc FROM lines WHERE len(w) >= 13 GROUP BY w HAVING count(DISTINCT doc_id) >= 2),
gone AS (
  SELECT doc_id, i FROM keyed JOIN found USING (key) WHERE doc_id <> first_doc
  UNION SELECT doc_id, i FROM lines JOIN long USING (w) WHERE doc_id <> first_doc),
counted AS (
  SELECT doc_id, count(*) AS n_lines, count(g.i) AS n_dropped,
         string_agg(x, chr(10) ORDER BY lines.i) FILTER (WHERE g.i IS NULL) AS kept
  FROM lines LEFT JOIN (SELECT doc_id AS d, i AS i, i AS j FROM gone) AS g ON g.d = doc_id AND g.j = lines.i GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN counted c USING (doc_id)
"""


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


OP9_SQL = """
WITH rows AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
places AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM rows),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
         list({'r': role, 't': text} ORDER BY place) AS turns FROM places GROUP BY conv_id),
first AS (SELECT min(conv_id) AS conv_id, n_turns, turns FROM whole GROUP BY n_turns, turns),
kept AS (
  SELECT f.* FROM first f WHERE NOT EXISTS (
    SELECT 1 FROM whole w WHERE w.n_turns > f.n_turns AND w.turns[1] = f.turns[1]
           AND list_slice(w.turns, 1, f.n_turns) = f.turns))
SELECT k.conv_id, k.n_turns, CAST((p.place - 1) // 256 AS BIGINT) AS part,
       string_agg('<|im_start|>' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10), '' ORDER BY p.place) AS text
FROM kept k JOIN places p USING (conv_id) GROUP BY ALL
"""


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_report(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, repeat([0::BIGINT], 8)),
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
whole AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, list({'r': role, 't': text} ORDER BY place) AS seq FROM turns GROUP BY conv_id),
heads AS (
  SELECT conv_id, base, seq, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
         lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) % 6 AS h
  FROM whole, crc_table),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.seq, [])[:c.h], c.seq[c.h + 1:]) AS seq FROM heads c LEFT JOIN whole b ON b.conv_id = c.base),
members AS (
  SELECT conv_id, d AS depth, seq[:d] AS key, d = len(seq) AS ends FROM rebuilt, unnest(range(0, len(seq) + 1)) AS u(d)),
nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN len(key[depth].t) ELSE 0 END) AS chars,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends
  FROM members GROUP BY depth, key),
children AS (SELECT depth - 1 AS depth, key[:depth - 1] AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
sized AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.key = n.key),
below AS (
  SELECT u.d AS depth, key[:u.d] AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved
  FROM sized, unnest(range(0, depth + 1)) AS u(d) GROUP BY ALL)
SELECT s.conv_id, CAST(s.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(s.ends) AS ends_sha256
FROM sized s JOIN below b ON b.depth = s.depth AND b.key = s.key LEFT JOIN nodes p ON p.depth = s.depth - 1 AND p.key = s.key[:s.depth - 1]
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    """Rounds are unrolled: entries of a round from the assignment to those of the one before."""
    rounds = []
    for r in range(codes.ROUNDS + 1):
        rounds.append(f"""
near{r} AS MATERIALIZED (
  SELECT row, p, v, min({{'d': d, 'k': k}}) AS best
  FROM (SELECT w.row, w.p, w.v, e.k, list_sum(list_transform(list_zip(w.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM parts w JOIN entries{r} e USING (p)) GROUP BY ALL)""")
        if r < codes.ROUNDS:
            rounds.append(f"""
mean{r} AS (
  SELECT p, k, list(m ORDER BY i) AS v
  FROM (SELECT p, best.k AS k, i, CAST((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
        FROM near{r}, unnest(range(1, len(v) + 1)) AS u(i) GROUP BY ALL) GROUP BY p, k),
entries{r + 1} AS MATERIALIZED (SELECT e.p, e.k, coalesce(m.v, e.v) AS v FROM entries{r} e LEFT JOIN mean{r} m ON m.p = e.p AND m.k = e.k)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row,
         list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT row, p, list_slice(v, p * len(v) // {codes.PARTS} + 1, (p + 1) * len(v) // {codes.PARTS}) AS v FROM kept, unnest(range({codes.PARTS})) AS u(p)),
entries0 AS MATERIALIZED (SELECT p, row - 1 AS k, v FROM parts WHERE row <= {codes.ENTRIES}),{",".join(rounds)},
coded AS (
  SELECT row, string_agg(lower(printf('%02x', CAST(best.k AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{codes.ROUNDS} GROUP BY row),
digest AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, i)) AS h
  FROM (SELECT p, k, i, v[i] AS x FROM entries{codes.ROUNDS}, unnest(range(1, len(v) + 1)) AS u(i)))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (row), digest
"""


OP12_SQL = _op12_sql()


def op13_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_fiftieths(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_tagger": op1_pii_tagger,
        "op2_toxicity": op2_toxicity,
        "op3_rotated_codes": op3_rotated_codes,
        "op4_substrings": op4_substrings,
        "op5_bpe": op5_bpe,
        "op6_decontamination": op6_decontamination,
        "op7_minhash": op7_minhash,
        "op8_line_templates": op8_line_templates,
        "op9_chat": op9_chat,
        "op10_best_fit": op10_best_fit,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_vector_codes": op12_vector_codes,
        "op13_block_topk": op13_block_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_rotated_codes": OP3_SQL,
        "op4_substrings": OP4_SQL,
        "op6_decontamination": OP6_SQL,
        "op7_minhash": OP7_SQL,
        "op8_line_templates": OP8_SQL,
        "op9_chat": OP9_SQL,
        "op11_prefix_trie": OP11_SQL,
        "op12_vector_codes": OP12_SQL,
        "op13_block_topk": OP13_SQL,
    }
