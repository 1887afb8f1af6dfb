"""The same results in SQL, the direct way: whole-table windows, all pairs, recursive reachability."""

from __future__ import annotations

from roadtrace.llm.shards import SEED, SLICES

LEAKS = r"""
WITH words AS (
    SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM documents WHERE text IS NOT NULL
), item_words AS (
    SELECT DISTINCT item_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM benchmark WHERE text IS NOT NULL
), has AS (
    SELECT DISTINCT doc_id, text,
        unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words
), asked AS (
    SELECT DISTINCT item_id, text,
        unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM item_words
), sized AS (
    SELECT item_id, text, s, count(*) OVER (PARTITION BY item_id, text) AS n_shingles FROM asked
), found AS (
    SELECT h.doc_id, h.text, z.item_id, z.text AS item_text, z.n_shingles, count(*) AS n_found
    FROM has h JOIN sized z USING (s) GROUP BY ALL
)
SELECT DISTINCT doc_id, item_id, n_shingles::INT AS n_shingles, n_found::INT AS n_found,
    n_found::DOUBLE / n_shingles AS containment
FROM found WHERE n_found::DOUBLE / n_shingles >= 0.8
"""

VECTORS = """
WITH RECURSIVE good AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
        AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), part AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN part p ON e.vec_id = p.a LEFT JOIN counted c ON e.vec_id = c.a
"""

# CRC-32 by its table, byte by byte over the hexadecimal form of the text.
SHARDS = f"""
WITH steps AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), sized AS (
    SELECT doc_id, source, coalesce(strlen(text), 0)::BIGINT + 16 AS size,
        CASE WHEN text IS NOT NULL THEN xor(list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'),
                lambda b: (instr('0123456789ABCDEF', b[1]) - 1) * 16 + instr('0123456789ABCDEF', b[2]) - 1)::BIGINT[]),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END AS text_crc32
    FROM documents, steps
), turned AS (
    SELECT *, coalesce('=' || source, '') AS own,
        md5('{SEED}|' || concat_ws('|', doc_id::VARCHAR, text_crc32::VARCHAR)) AS turn FROM sized
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY own ORDER BY turn) - 1 AS r, count(*) OVER (PARTITION BY own) AS n,
        ('0x' || md5('{SEED}|' || own)[1:4])::INT / 65536.0::DOUBLE AS phase
    FROM turned
), lined AS (
    SELECT *, row_number() OVER (ORDER BY floor((r + phase) / n * {SLICES}), (r + phase) / n, own, r) - 1 AS place,
        count(*) OVER () AS total
    FROM ranked
), cut AS (SELECT *, place * 40 // total AS piece FROM lined)
SELECT doc_id, size, text_crc32, 'rows' AS law, piece::INT AS shard,
    place - (piece * total + 39) // 40 AS slot, NULL::INT AS grown_shard
FROM cut
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
    SELECT text, min(doc_id) AS id, any_value(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))
        AS w
    FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY text
), runs AS (
    SELECT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words
), bags AS (SELECT id, s, count(*) AS n FROM runs GROUP BY ALL),
sizes AS (SELECT id, sum(n) AS total FROM bags GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS common FROM bags a JOIN bags b USING (s) WHERE a.id <> b.id
    GROUP BY ALL),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b
    WHERE common::DOUBLE / (x.total + y.total - common) >= 0.8
), reached AS (
    SELECT id AS a, id AS b FROM words UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), part AS (SELECT a, min(b) AS class_id FROM reached GROUP BY a)
SELECT d.doc_id, CASE WHEN d.doc_id IS NULL THEN NULL ELSE coalesce(class_id, d.doc_id) END AS class_id,
    d.doc_id IS NULL OR coalesce(class_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN words w ON d.text = w.text LEFT JOIN part p ON w.id = p.a
"""

CONVERSATIONS = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
        AS loss_sha256,
    sum(length('<|turn|><|content|><|end|>') + length(regexp_replace(role || text,
        '(<|\[)(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')))::BIGINT AS formatted_chars,
    0::BIGINT AS attachment_tokens
FROM said GROUP BY conv_id
"""

REPEATED_LINES = r"""
WITH numbered AS MATERIALIZED (
    SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), keyed AS (
    SELECT row_id, doc_id, lines, list_transform(lines, lambda x: translate(
        trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys
    FROM numbered
), held AS (
    SELECT row_id, doc_id, unnest(list_distinct(list_filter(keys, lambda k: length(k) >= 40))) AS k FROM keyed
), common AS (SELECT k, max(doc_id) AS keeper FROM held GROUP BY k HAVING count(*) >= 5 AND max(doc_id) IS NOT NULL),
lost AS (SELECT row_id, list(k) AS gone FROM held JOIN common USING (k) WHERE doc_id IS DISTINCT FROM keeper GROUP BY row_id),
cut AS (
    SELECT doc_id, lines, CASE WHEN gone IS NULL THEN lines
        ELSE list_filter(lines, lambda x, i: NOT list_contains(gone, keys[i])) END AS stay
    FROM keyed LEFT JOIN lost USING (row_id)
)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(stay))::BIGINT AS n_dropped,
    sha256(array_to_string(stay, chr(10))) AS kept_sha256
FROM cut
"""

# Near words share what is left after deleting one code point, at the same place for a replacement.
SPELLING = r"""
WITH RECURSIVE steps AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{6,}')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents
), held AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
hashed AS (
    SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'),
            lambda b: (instr('0123456789ABCDEF', b[1]) - 1) * 16 + instr('0123456789ABCDEF', b[2]) - 1)::BIGINT[]),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
    FROM held, steps
), printed AS (
    SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM hashed
), counted AS (
    SELECT word, sum(k)::BIGINT AS n FROM printed WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), cut AS (
    SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM counted)
), pairs AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN counted b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN counted b ON a.rest = b.word
), near AS (
    SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM pairs GROUP BY word
), best AS (
    SELECT near.word, n_near, best_n, min(other) AS best
    FROM near JOIN pairs ON near.word = pairs.word AND best_n = other_n GROUP BY ALL
), formed AS (
    SELECT counted.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form,
        CASE WHEN best_n >= 5 * n THEN best_n END AS form_n
    FROM counted LEFT JOIN best USING (word)
), followed AS (
    SELECT word, word AS at, form AS next FROM formed
    UNION ALL SELECT followed.word, formed.word, formed.form FROM followed JOIN formed ON followed.next = formed.word
)
SELECT formed.word, formed.form, followed.at AS root, n, n_near::BIGINT AS n_near, form_n
FROM formed JOIN followed ON formed.word = followed.word AND followed.next IS NULL
"""

SEARCH = r"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS row_id, doc_id, list_transform(
        regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
        lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
    FROM documents WHERE text IS NOT NULL
), items AS MATERIALIZED (
    SELECT row_number() OVER () AS item_row, item_id, list_transform(
        regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
        lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), whole AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0),
asked AS (SELECT item_row, item_id, term, count(*) AS k FROM (SELECT item_row, item_id, unnest(terms) AS term FROM items) GROUP BY ALL),
held AS (
    SELECT row_id, doc_id, n, term, count(*) AS tf FROM (SELECT row_id, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, whole GROUP BY term, n_docs
), impacts AS (
    SELECT row_id, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)) AS x
    FROM held, whole
), scored AS (
    SELECT item_row, item_id, row_id, doc_id, sum(k * w * x)::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 AND doc_id IS NOT NULL QUALIFY rank <= 20
"""


def all_statements() -> dict[str, str]:
    return {
        "op2_decontamination": LEAKS,
        "op4_embeddings": VECTORS,
        "op5_shards": SHARDS,
        "op6_near_duplicates": NEAR_DUPLICATES,
        "op10_chat": CONVERSATIONS,
        "op11_spelling": SPELLING,
        "op12_search": SEARCH,
        "op13_lines": REPEATED_LINES,
    }
