"""DuckDB SQL for those queries that SQL can express."""

#: A-Z lowered, and the words between white space.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SHINGLES = "CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END"

OP3 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents), b AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest({SHINGLES}) AS sh FROM d), bs AS (SELECT DISTINCT item_id, unnest({SHINGLES}) AS sh FROM b),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS shared_shingles FROM bs JOIN ds USING (sh) GROUP BY ALL)
SELECT doc_id, item_id, item_shingles, shared_shingles, shared_shingles / item_shingles AS containment FROM m JOIN n USING (item_id)
WHERE 100 * shared_shingles >= 80 * item_shingles
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) AS INTEGER), 1)), 'string_agg', '') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS response FROM b)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to FROM m
"""

OP6 = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest({SHINGLES}) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT r.a AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""

#: A turn's key: number, null first, and the digest of what is said.
TURN_ORDER = "ORDER BY turn NULLS FIRST, md5(role || chr(10) || text)"
OP11 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, ['user', 'assistant'][t + 1], '<|im_end|><|im_start|>assistant ok' FROM range(2) r(t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {TURN_ORDER})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' {TURN_ORDER}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '|', '%7C')) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


#: crc32 by its table of 256 remainders; `crc` takes a list of bytes, and `ct.t` must be in scope.
CRC_TABLE = "ct AS (SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY k) AS t FROM range(256) r(k))"


def crc(octets: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, ct.t[1 + (xor(a, b) & 255)])), 4294967295)"


OP12 = rf"""
WITH {CRC_TABLE}, q AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, row_number() OVER (PARTITION BY c {TURN_ORDER}) AS place, role AS r, text AS t FROM q),
n AS (SELECT c, n, {crc("list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} % 4 AS h FROM (SELECT c, count(*) AS n FROM o GROUP BY c), ct),
m AS (SELECT n.c, n.h, least(n.h, coalesce(b.n, 0)) AS taken FROM n LEFT JOIN n b ON b.c = n.c - n.c % 20),
rb AS (SELECT m.c, place AS d, r, t FROM m JOIN o ON o.c = m.c - m.c % 20 AND place <= taken UNION ALL SELECT m.c, place - h + taken, r, t FROM m JOIN o ON o.c = m.c AND place > h),
l AS (SELECT m.c, coalesce(list({{'r': r, 't': t}} ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS ts FROM m LEFT JOIN rb ON rb.c = m.c GROUP BY m.c),
p AS (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM l),
k AS (SELECT c, d, len(ts) = d AS ends, md5(to_json(ts[1:d])::VARCHAR) AS pk, CASE WHEN d > 0 THEN md5(to_json(ts[1:d - 1])::VARCHAR) END AS ppk,
  CASE WHEN d > 0 THEN len(regexp_extract_all(ts[d].t, '[^ 	-
]+')) ELSE 0 END AS words FROM p),
g AS (SELECT pk, min(c) AS conv_id, min(d) AS depth, min(ppk) AS ppk, count(*) AS n_convs, min(words) AS words, list(c ORDER BY c) FILTER (WHERE ends) AS es FROM k GROUP BY pk),
ch AS (SELECT ppk AS pk, count(*) AS n_children FROM g WHERE ppk IS NOT NULL GROUP BY ppk),
w AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN ch USING (pk)),
s AS (SELECT k.pk, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * w.words)::BIGINT AS saved_tokens FROM w JOIN k ON k.c = w.conv_id AND k.d <= w.depth GROUP BY k.pk)
SELECT w.conv_id, w.depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, sha256(coalesce(array_to_string(w.es, ','), '')) AS ends_sha256
FROM w JOIN s USING (pk) LEFT JOIN g up ON up.pk = w.ppk
"""


OP13 = rf"""
WITH RECURSIVE {CRC_TABLE}, r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
h AS (SELECT run, {crc("flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END))")} AS h FROM r, ct WHERE length(run) >= 7),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM h),
v AS (SELECT word, count(*) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v), d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM i),
p AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.less = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.less = v.word),
t AS (SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place FROM p),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN t.n >= 10 * v.n THEN other END AS form, CASE WHEN t.n >= 10 * v.n THEN t.n END AS form_n FROM v LEFT JOIN t ON t.word = v.word AND place = 1),
o(word, root, form) AS (SELECT word, word, form FROM f UNION ALL SELECT o.word, f.word, f.form FROM o JOIN f ON f.word = o.form)
SELECT f.word, f.form, o.root, f.n, f.n_near, f.form_n FROM f JOIN o ON o.word = f.word AND o.form IS NULL
"""


def oracle_sql():
    return {"op11_reply_trees": OP11, "op12_prefix_trie": OP12, "op13_spelling_variants": OP13, "op3_decontaminate": OP3, "op5_warc_salvage": OP5, "op6_exact_dedup": OP6, "op9_ngram_jaccard": OP9}
