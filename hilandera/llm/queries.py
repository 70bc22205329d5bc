"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from hilandera.llm import bloom_lm, bpe, compression_classifier, cover_tree, mixing, periodic_runs, quality_rules, releases, secret_scan, sharding, simhash, token_counts, token_files
from hilandera.llm.common import table

QUERIES = {
    "op1_bloom_lm": lambda spark, d: bloom_lm.digest(table(spark, d, "documents")),
    "op7_cover_tree": lambda spark, d: cover_tree.digest(table(spark, d, "embeddings")),
    "op2_simhash": lambda spark, d: simhash.digest(table(spark, d, "documents")),
    "op8_secret_scan": lambda spark, d: secret_scan.digest(table(spark, d, "documents")),
    "op5_compression_classifier": lambda spark, d: compression_classifier.digest(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_bpe": lambda spark, d: bpe.digest(table(spark, d, "documents")),
    "op10_token_files": lambda spark, d: token_files.digest(table(spark, d, "documents")),
    "op4_mixing": lambda spark, d: mixing.digest(table(spark, d, "documents")),
    "op6_sharding": lambda spark, d: sharding.digest(spark, d),
    "op9_quality_rules": lambda spark, d: quality_rules.digest(table(spark, d, "documents")),
    "op11_releases": lambda spark, d: releases.digest(table(spark, d, "conversations")),
    "op12_token_counts": lambda spark, d: token_counts.digest(table(spark, d, "documents")),
    "op13_periodic_runs": lambda spark, d: periodic_runs.digest(table(spark, d, "documents")),
}

#: The other operators draw at random, learn, follow links or need a library: they are tested against brute force.
ORACLES = {
    # crc32 is worked out bit by bit; a conversation's turns follow one another by recursion
    "op11_releases": r"""
WITH RECURSIVE numbered AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations),
strings AS (SELECT conv_id, turn, -1 AS k, text AS s FROM numbered UNION ALL SELECT conv_id, turn, k, k || ':' || conv_id || ':' || turn FROM numbered, range(9) AS r(k)),
bytes AS (SELECT conv_id, turn, k, list_transform(range(1, strlen(s) + 1), lambda i: ('0x' || substr(hex(encode(s)), 2 * i - 1, 2))::BIGINT) AS b FROM strings),
hashes AS (SELECT conv_id, turn, k, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, y: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295) AS h FROM bytes),
turns AS (
  SELECT n.conv_id, n.turn, n.p, max(CASE WHEN k = -1 THEN h END) AS crc, max(CASE WHEN k = 0 THEN h % 5 END) AS back, max(CASE WHEN k = 1 THEN h % 101 < 50 END) AS faulty,
    7 * n.p + max(CASE WHEN k = 2 THEN h % 101 END) AS repair, list(h % 3 <> 0 ORDER BY k) FILTER (k >= 3) AS holds
  FROM numbered n JOIN hashes h ON h.conv_id = n.conv_id AND h.turn = n.turn GROUP BY n.conv_id, n.turn, n.p),
started AS (
  SELECT conv_id, -1::BIGINT AS p, []::STRUCT(status VARCHAR, attempts INTEGER, first_at BIGINT, last_at BIGINT)[] AS done FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT conv_id, p, list_concat(done, [CASE WHEN blocked THEN {status: 'blocked', attempts: 0, first_at: NULL, last_at: NULL}
      WHEN good IS NULL THEN {status: 'dead', attempts: 6, first_at: s, last_at: s + 310} ELSE {status: 'delivered', attempts: good, first_at: s, last_at: s + 10 * (2 ** (good - 1) - 1)::BIGINT} END])
  FROM (SELECT *, CASE WHEN NOT faulty THEN 1 ELSE list_filter([1, 2, 3, 4, 5, 6], lambda a: s + 10 * (2 ** (a - 1) - 1) >= repair AND holds[a])[1] END AS good
    FROM (SELECT t.*, d.done, parent IS NOT NULL AND parent.status <> 'delivered' AS blocked, greatest(7 * t.p, coalesce(parent.last_at, 0)) AS s
      FROM started d JOIN turns t ON t.conv_id = d.conv_id AND t.p = d.p + 1, LATERAL (SELECT CASE WHEN t.back > 0 AND t.back <= t.p THEN d.done[t.p - t.back + 1] END AS parent)))),
ended AS (SELECT t.conv_id, turn, crc, unnest(d.done[t.p + 1]) FROM turns t JOIN started d ON d.conv_id = t.conv_id AND d.p = t.p),
released AS (SELECT *, row_number() OVER (PARTITION BY conv_id, status ORDER BY last_at, turn) AS n FROM ended)
SELECT conv_id, turn, status, attempts, first_at, last_at, CASE WHEN status = 'delivered' THEN n END AS release_no,
  CASE WHEN status = 'delivered' THEN (sum(n * crc) OVER (PARTITION BY conv_id, status ORDER BY n))::BIGINT END AS state FROM released
""",
    # all pairs of vectors
    "op7_cover_tree": r"""
WITH RECURSIVE known AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM known x JOIN known y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_dot_product(x.e, y.e) >= 0.95 * sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))),
reached AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT vec_id, b FROM reached JOIN links ON a = r),
components AS (SELECT vec_id, min(r) AS component_id FROM reached GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN components USING (vec_id) LEFT JOIN counts USING (vec_id)
""",
    # every period of every text; words that occur fewer than four times are in no run
    "op13_periodic_runs": r"""
WITH digits AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ('0x' || substr(hex(encode(doc_id::VARCHAR)), 2 * i - 1, 2))::BIGINT) AS b FROM documents),
hashes AS (SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, y: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295) AS h FROM digits),
plans AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM hashes WHERE n > 0),
words AS (SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM plans)),
often AS (SELECT * FROM words QUALIFY count(*) OVER (PARTITION BY doc_id, word) >= 4),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM often x JOIN often y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY 1, 2, 3),
listed AS (SELECT doc_id, count(*) AS n_runs, arg_min(start, k) AS start, arg_min(length, k) AS length, arg_min(period, k) AS period, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS every
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS k FROM runs) GROUP BY 1),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(every, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op9_quality_rules": r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
places AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) > 2),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM places),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
measured AS (
  SELECT words.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    len(l) AS n_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM words JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
failed AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * n_words)::BIGINT
    + 8 * (word_chars > 30 * n_words)::BIGINT + 16 * (100 * n_dup_lines > 90 * n_lines)::BIGINT AS fail_bits FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits % 4 > 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM failed
""",
}
