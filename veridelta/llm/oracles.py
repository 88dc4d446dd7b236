"""SQL that gives the same rows as the queries that SQL can express."""

WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP5 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 e AS (SELECT *, CASE WHEN NOT regexp_matches(text, '</?s>|\[/?INST[\]:]') THEN 0 WHEN regexp_matches(text, '<~/?s>|\[~/?INST[\]:]') THEN 2 ELSE 1 END AS level FROM c),
 f AS (SELECT *, 20 + length(text) + length(role) + CASE WHEN level > 0 THEN 2 ELSE 0 END + len(regexp_extract_all(role, '[~<\[]')) + CASE level WHEN 1 THEN len(regexp_extract_all(text, '</?s>|\[/?INST[\]:]')) WHEN 2 THEN len(regexp_extract_all(text, '[~<\[]')) ELSE 0 END AS chars FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""

_BUCKET = "v - v % (1::BIGINT << greatest(length(bin(v)) - 6, 0)::INT)"

OP9 = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, {WORDS.format(t='t')} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
 win AS (SELECT rid, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS s FROM w, unnest(range(1, len(w) - 1)) u(i)),
 rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
 cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1),
 m AS (SELECT w.rid, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) AS n_marks, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_marks * 1000 // greatest(n_words, 1) AS mark_rate, n_dup_lines * 1000 // (n_lines + 5) AS dup_line_rate, word_chars * 100 // greatest(n_words, 1) AS word_length FROM m),
 v AS (SELECT lang, source, unnest(['mark_rate', 'dup_line_rate', 'word_length']) AS measure, unnest([mark_rate, CASE WHEN dup_line_rate > 0 THEN dup_line_rate END, word_length])::BIGINT AS v FROM b WHERE NOT base_failed),
 s AS (SELECT lang, source, measure, {_BUCKET} AS bucket, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY ALL),
 q AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM s),
 own AS (SELECT lang, source, measure, min(bucket) FILTER (cum * 4 >= total) AS q1, min(bucket) FILTER (cum * 4 >= total * 3) AS q3 FROM q GROUP BY ALL),
 sa AS (SELECT measure, bucket, sum(n) AS n FROM s GROUP BY ALL),
 qa AS (SELECT *, sum(n) OVER (PARTITION BY measure ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY measure) AS total FROM sa),
 every AS (SELECT measure, min(bucket) FILTER (cum * 4 >= total) AS a1, min(bucket) FILTER (cum * 4 >= total * 3) AS a3 FROM qa GROUP BY 1),
 k AS (SELECT lang, source, measure, q1, q3, a1, a3, a3 - a1 + ceil(a3 / 32) AS wide, CASE WHEN q3 > q1 THEN q3 - q1 + ceil(q3 / 32) ELSE a3 - a1 + ceil(a3 / 32) END AS spread  FROM own JOIN every USING (measure)),
 e AS (SELECT *, least(q3 + 6 * spread, a3 + 6 * wide) AS high, greatest(q1 - 6 * spread, a1 - 6 * wide) AS low FROM k),
 f AS (SELECT lang, source, max(high) FILTER (measure = 'mark_rate') AS s_high, max(high) FILTER (measure = 'dup_line_rate') AS d_high, max(high) FILTER (measure = 'word_length') AS w_high, max(low) FILTER (measure = 'word_length') AS w_low FROM e GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND mark_rate <= coalesce(s_high, mark_rate) AND dup_line_rate <= coalesce(d_high, dup_line_rate) AND word_length <= coalesce(w_high, word_length) AND word_length >= coalesce(w_low, word_length) AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source"""

OP10 = rf"""WITH d AS (SELECT doc_id, source, len({WORDS.format(t="coalesce(text, '')")}) AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 9))::BIGINT AS h FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
 r AS (SELECT *, [1.0::DOUBLE, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 3.0::DOUBLE * source_size AS cap FROM s),
 a AS (SELECT *, coalesce(sum(cap) OVER o, 0)::DOUBLE AS capped, coalesce(sum(w) OVER o, 0)::DOUBLE AS w_capped, (sum(source_size) OVER ())::DOUBLE AS total, sum(w) OVER () AS w_total FROM r WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT *, (total - capped) / (w_total - w_capped) AS level FROM a),
 t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM l WHERE level * w <= cap) * w, cap)) AS target FROM l),
 g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
 b AS (SELECT *, target - whole * source_size AS left_over FROM g),
 x AS (SELECT source, h, sum(size) AS n FROM d GROUP BY ALL),
 c AS (SELECT x.source, h, n, coalesce(sum(n) OVER (PARTITION BY x.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, left_over FROM x JOIN b ON x.source IS NOT DISTINCT FROM b.source),
 y AS (SELECT source, h, left_over > 0 AND (below + n <= left_over OR (below <= left_over AND n - (left_over - below) < left_over - below)) AS more FROM c)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (whole + CASE WHEN more THEN 1 ELSE 0 END))::BIGINT AS taken FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN y ON d.source IS NOT DISTINCT FROM y.source AND d.h = y.h"""



def _clusters(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """One step a round: all vectors against all centroids."""
    near = """(SELECT vec_id, v, c, d FROM (SELECT e.vec_id, e.v, k.c, list_sum(list_transform(range(1, {size} + 1), lambda i: (e.v[i] - k.m[i]) * (e.v[i] - k.m[i]))) AS d FROM e, {k} k)
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
    steps = [f"""e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT sha256('2:' || vec_id) AS h, v FROM e ORDER BY h LIMIT {k}))"""]  # fmt: skip
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED {near.format(size=size, k=f'k{r}')}")
        mean = f"SELECT c, list(floor(s::DOUBLE / n)::BIGINT ORDER BY i) AS m FROM (SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {size + 1}) t(i) GROUP BY ALL) GROUP BY c"
        steps.append(f"k{r + 1} AS MATERIALIZED (SELECT c, coalesce(x.m, k.m) AS m FROM k{r} k LEFT JOIN ({mean}) x USING (c))")
    steps.append(f"z AS MATERIALIZED {near.format(size=size, k=f'k{rounds}')}")
    return "WITH " + ",\n ".join(steps) + f"""
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM z JOIN k{rounds} USING (c)"""


OP11 = _clusters()

_LETTERS = "àáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞß"
_PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~"

# crc32 by its rule, a byte at a time over a table of 256; then one stand-in of one byte for each letter, since levenshtein counts bytes
OP12 = rf"""WITH RECURSIVE crc(i, k, x) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END FROM crc WHERE k < 8),
 tab AS MATERIALIZED (SELECT list(x ORDER BY i) AS t FROM crc WHERE k = 8),
 runs AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
 hashed AS (SELECT w, n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)), '..'), lambda b: ('0x' || b)::BIGINT)),
   lambda h, b: xor(h // 256, t[xor(h % 256, b) + 1]))) AS h FROM runs, tab),
 kept AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
 v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n, translate(word, '{_LETTERS}', '{_PLAIN}') AS p FROM kept WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
 near AS MATERIALIZED (SELECT a.word, a.n, b.word AS other, b.n AS m FROM v a JOIN v b ON abs(length(a.p) - length(b.p)) <= 1 AND levenshtein(a.p, b.p) = 1),
 best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS o, max(m) AS om FROM near GROUP BY ALL),
 f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN om >= 2 * v.n THEN o END AS form, CASE WHEN om >= 2 * v.n THEN om END AS form_n FROM v LEFT JOIN best USING (word)),
 walk(word, pos, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.pos WHERE f.form IS NOT NULL)
SELECT f.word, form, arg_max(walk.pos, step) AS root, n, n_near, form_n FROM f JOIN walk ON walk.word = f.word GROUP BY ALL"""

OP13 = """WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v, len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
 links AS MATERIALIZED (SELECT a.r, b.r AS s FROM e a JOIN e b ON a.ok AND b.ok AND a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
 reach(r, s) AS (SELECT r, r FROM e UNION SELECT reach.r, links.s FROM reach JOIN links ON links.r = reach.s),
 top AS (SELECT reach.r, min(e.vec_id) AS component_id FROM reach JOIN e ON e.r = reach.s GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.r = e.r) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM e JOIN top USING (r)"""

ORACLE = {"op11_clusters": OP11, "op12_spelling": OP12, "op13_vectors": OP13, "op5_chat": OP5, "op9_quality_rules": OP9, "op10_mixing": OP10}
