"""The same results in SQL, where SQL can express them."""

from __future__ import annotations

#: Windows of 35 words counted as lists; a word is removed if a repeated window covers it.
SUBSTRINGS = r"""
WITH words AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
    SELECT r, unnest(range(1, len(w) - 33)) AS s FROM words
), windows AS (
    SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM starts JOIN words USING (r)
), repeated AS (
    SELECT r, s FROM windows JOIN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1) USING (h)
), covered AS (
    SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(s, s + 35)) AS p FROM repeated) GROUP BY r
), kept AS (
    SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
        CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS k
    FROM words LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

#: Every sum runs from the first component to the last, as in the query, so scores agree to the last bit.
NEAREST = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), normed AS (
    SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS n FROM usable
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.n * c.n) AS score
    FROM normed q JOIN normed c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""

#: A digest is 40 hexadecimal digits, 8 times 20 bits, each 4 letters of base32.
WARC = """
WITH payloads AS (
    SELECT page_id, encode(coalesce(html, '')) AS p FROM pages
), digests AS (
    SELECT page_id, octet_length(p) AS payload_bytes, sha256(p) AS same, sha1(p) AS hex FROM payloads
), named AS (
    SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY same, payload_bytes) AS first
    FROM digests
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM named
"""

#: Links by shared shingles of all pairs, components by following links.
JACCARD = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
    FROM words
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n_a, y.n AS n_b, count(*) AS c
    FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs WHERE 100 * c >= 85 * (n_a + n_b - c)
), reached AS (
    SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
), least AS (
    SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least USING (doc_id)
"""

#: A crc32 bit by bit; words one edit apart are equal with one letter left out, at one place if both lose it.
SPELLING = r"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents
), counted AS (
    SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS bytes FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
    SELECT run, n, xor(4294967295::BIGINT, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(0, length(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT)),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END))) AS h
    FROM counted
), damaged AS (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
), vocabulary AS (
    SELECT word, sum(n)::BIGINT AS n, length(word) AS size FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), places AS (
    SELECT word, n, size, unnest(range(0, size)) AS i FROM vocabulary
), shortened AS (
    SELECT word, n, size, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM places
), pairs AS (
    SELECT a.word AS word, b.word AS other, b.n AS other_n FROM shortened a JOIN shortened b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM shortened a JOIN vocabulary b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM shortened a JOIN vocabulary b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM pairs GROUP BY word
), judged AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
    FROM vocabulary LEFT JOIN best USING (word)
), followed AS (
    SELECT word, word AS root, 0 AS steps FROM judged
    UNION ALL SELECT f.word, j.form, f.steps + 1 FROM followed f JOIN judged j ON f.root = j.word WHERE j.form IS NOT NULL
), roots AS (
    SELECT word, arg_max(root, steps) AS root FROM followed GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN roots USING (word)
"""

#: Every prefix of every rebuilt conversation, and for subtrees every pair of a node and one below it.
PREFIXES = r"""
WITH original AS (
    SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS seq
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (
    SELECT c, seq, xor(4294967295::BIGINT, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(split(c::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda x, step: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))) % 9 AS h
    FROM original
), rebuilt AS (
    SELECT a.c, list_concat(coalesce(b.seq[1:h], []), a.seq[h + 1:]) AS seq FROM hashed a LEFT JOIN original b ON b.c = a.c - a.c % 5
), members AS (
    SELECT c, len(seq) AS size, unnest(range(0, len(seq) + 1)) AS depth, seq FROM rebuilt
), nodes AS (
    SELECT depth, seq[1:depth] AS path, min(c) AS conv_id, count(*) AS n_convs,
        string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = depth) AS ends
    FROM members GROUP BY ALL
), measured AS (
    SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[depth].t) END AS saved,
        (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.path[1:n.depth] = n.path) AS n_children
    FROM nodes n
), below AS (
    SELECT a.depth, a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens
    FROM measured a JOIN measured b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY ALL
)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM measured m JOIN below b ON b.depth = m.depth AND b.path = m.path
LEFT JOIN nodes p ON p.depth = m.depth - 1 AND p.path = m.path[1:m.depth - 1]
"""

SQL = {
    "op4_warc": WARC,
    "op6_substrings": SUBSTRINGS,
    "op9_nearest": NEAREST,
    "op11_jaccard": JACCARD,
    "op12_spelling": SPELLING,
    "op13_prefixes": PREFIXES,
}
