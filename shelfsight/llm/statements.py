"""SQL counterparts of the operators whose whole result SQL can express. They work by plain definitions (all
windows, all pairs that share a shingle), so they are for small tables."""

from __future__ import annotations

from shelfsight.llm.quality_rules import COMMON_WORDS, Limits

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ALNUM_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
WORD = r"'[^\x20\x09-\x0D]+'"

LEAKS = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), {ALNUM_WORD}) AS w
    FROM documents),
items AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id,
           regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), {ALNUM_WORD}) AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, len(list_slice(w, i, i + 9)) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS g
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)),
places AS (
    SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
    FROM (SELECT r, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i
          FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT r, i, n, item_id FROM places JOIN windows USING (n, g)),
hits AS (
    SELECT r, count(DISTINCT p) AS n_hit
    FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
ids AS (
    SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), {WORD}) AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS g
    FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
pairs AS (
    SELECT a.r AS x, b.r AS y, count(*) AS n_shared FROM shingles a JOIN shingles b ON a.g = b.g AND a.r <> b.r
    GROUP BY a.r, b.r),
links AS (
    SELECT x, y FROM pairs JOIN sizes p ON x = p.r JOIN sizes q ON y = q.r
    WHERE 100 * n_shared >= 85 * (p.n + q.n - n_shared)),
reach(x, y) AS (
    SELECT r, r FROM docs UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
heads AS (SELECT x AS r, min(doc_id) AS component_id FROM reach JOIN docs ON docs.r = reach.y GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM docs JOIN heads USING (r) LEFT JOIN sizes USING (r)
"""


def _quality(limits: Limits = Limits()) -> str:
    listed = ", ".join(f"('{lang}', {i}, '{w}')" for lang, words in COMMON_WORDS.items() for i, w in enumerate(words))
    forms = sorted({f for words in COMMON_WORDS.values() for w in words for f in (w, w.capitalize(), w.upper())})
    among = ", ".join(f"'{f}'" for f in forms)

    def share(histogram: str, total: str) -> str:
        return f"""
    SELECT lang, i, v / greatest(sum(v) OVER (PARTITION BY lang), 1) AS q
    FROM (SELECT lang, i, sum(CAST(round(1e6 * c / {total}) AS BIGINT)) AS v FROM {histogram}
          WHERE n_chars >= {limits.min_chars} AND n_words >= {limits.min_words}
            AND lang IS NOT NULL GROUP BY lang, i)"""

    def distance(histogram: str, total: str, reference: str) -> str:
        return f"""
    SELECT r, round(sqrt(greatest(sum(
               (if(x > 0, x * log2(x / ((x + y) / 2)), 0) + if(y > 0, y * log2(y / ((x + y) / 2)), 0)) / 2 ORDER BY i), 0)), 9)
               AS distance
    FROM (SELECT h.r, h.i, h.c / greatest({total}, 1) AS x, s.q AS y
          FROM {histogram} h JOIN {reference} s ON h.i = s.i AND h.lang = s.lang)
    GROUP BY r"""

    return f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), {WORD}) AS w, length(coalesce(text, '')) AS n_chars
    FROM documents),
listed(lang, i, word) AS (VALUES {listed}),
words AS (SELECT r, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM docs),
counted AS (
    SELECT r, doc_id, lang, n_chars, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
           length(regexp_replace(t, '[^a-z]+', '', 'g')) AS lo, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS up,
           length(regexp_replace(t, '[^0-9]+', '', 'g')) AS digit,
           length(regexp_replace(t, '[\\x00-\\x7F]+', '', 'g')) AS beyond,
           length(regexp_replace(t, '[^.,;:?]+', '', 'g')) AS sentence
    FROM docs),
lines AS (
    SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines
    FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM docs) WHERE regexp_matches(l, {WORD}) GROUP BY r),
windows AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k
    FROM (SELECT r, i, array_to_string([x, lead(x) OVER s, lead(x, 2) OVER s], ' ') AS g, lead(x, 2) OVER s AS last
          FROM words WINDOW s AS (PARTITION BY r ORDER BY i)) WHERE last IS NOT NULL),
repeated AS (
    SELECT r, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE k > 1) GROUP BY r),
characters AS (
    SELECT r, lang, n_chars, n_words, unnest([0, 1, 2, 3, 4, 5, 6]) AS i,
           unnest([lo, up, digit, beyond, sentence, word_chars - lo - up - digit - beyond - sentence, n_chars - word_chars])
               AS c
    FROM counted),
known AS (SELECT r, lower(x) AS word, count(*) AS c FROM words WHERE x IN ({among}) GROUP BY ALL),
frequent AS (
    SELECT d.r, d.lang, d.n_chars, d.n_words, s.i, coalesce(k.c, 0) AS c
    FROM counted d JOIN listed s ON d.lang = s.lang LEFT JOIN known k ON k.r = d.r AND k.word = s.word),
common AS (
    SELECT * FROM frequent
    UNION ALL SELECT r, lang, n_chars, n_words, 1000, n_words - sum(c) FROM frequent GROUP BY r, lang, n_chars, n_words),
character_reference AS ({share("characters", "n_chars")}),
word_reference AS ({share("common", "n_words")}),
character_distances AS ({distance("characters", "n_chars", "character_reference")}),
word_distances AS ({distance("common", "n_words", "word_reference")}),
judged AS (
    SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words, n_chars, c.distance AS character_distance,
           d.distance AS word_distance,
           n_words < {limits.min_words_kept}
               OR 100 * coalesce(n_repeat_words, 0) > {limits.max_repeat_percent} * n_words AS base_failed
    FROM counted LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r)
    LEFT JOIN character_distances c USING (r) LEFT JOIN word_distances d USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(
           (n_chars >= {limits.min_chars} AND character_distance > {limits.character})
           OR (n_words >= {limits.min_words}
               AND word_distance > {limits.word} + {limits.word_slack} / sqrt(greatest(n_words, 1))), false) AS kept,
       character_distance, word_distance
FROM judged
"""

HARD_NEGATIVES = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS z
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_inner_product(a.z, b.z) AS BIGINT) AS score
    FROM r AS a JOIN r AS b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score
    FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

NEAR_VECTORS = """
WITH RECURSIVE r AS (
    SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
           coalesce(label IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
               AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable
    FROM embeddings),
links AS (
    SELECT a.n, b.n AS m
    FROM r AS a JOIN r AS b ON a.label = b.label AND len(a.v) = len(b.v) AND a.n <> b.n
    WHERE a.usable AND b.usable AND list_cosine_similarity(a.v, b.v) >= 0.93),
reached AS (
    SELECT n, n AS m FROM r
    UNION
    SELECT reached.n, links.m FROM reached JOIN links ON reached.m = links.n),
components AS (
    SELECT reached.n, min(r.vec_id) AS component_id FROM reached JOIN r ON r.n = reached.m GROUP BY reached.n)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.n = r.n) AS n_links, component_id,
       vec_id IS NOT DISTINCT FROM component_id AS kept
FROM r JOIN components USING (n)
"""

#: Every window of 200 bytes, as 400 digits.
REPEATS = """
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
windows AS (
    SELECT r, i, sha256(substr(h, 2 * i + 1, 400)) AS k
    FROM (SELECT r, h, unnest(generate_series(0, len(h) // 2 - 200)) AS i FROM docs WHERE len(h) >= 400)),
starts AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM windows) WHERE n > 1),
runs AS (
    SELECT r, min(i) AS a, max(i) + 200 AS b
    FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run
          FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new
                FROM starts))
    GROUP BY r, run),
kept AS (
    SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed,
           string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS b
    FROM (SELECT r, a, b, h, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before
          FROM runs JOIN docs USING (r))
    GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""


ORACLES: dict[str, str] = {
    "op1_induced_suffixes": REPEATS,
    "op6_prefix_join": LEAKS,
    "op8_divergence": _quality(),
    "op10_superminhash": NEAR_DUPLICATES,
    "op11_angular": HARD_NEGATIVES,
    "op13_cap_filters": NEAR_VECTORS,
}
