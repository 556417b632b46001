"""The package's registered queries and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from featuremart.llm.op10_embedding_dedup import op10_embedding_dedup
from featuremart.llm.op11_prefix_trie import op11_prefix_trie
from featuremart.llm.op12_spelling import op12_spelling
from featuremart.llm.op13_graph_search import op13_graph_search
from featuremart.llm.op1_html import op1_html
from featuremart.llm.op2_langid import op2_langid
from featuremart.llm.op3_jaccard_join import op3_jaccard_join
from featuremart.llm.op4_packing import op4_packing
from featuremart.llm.op5_fingerprint import op5_fingerprint
from featuremart.llm.op6_quality import op6_quality
from featuremart.llm.op7_bpe import op7_bpe
from featuremart.llm.op8_chat import op8_chat
from featuremart.llm.op9_suffix_dedup import op9_suffix_dedup


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html, op2_langid, op3_jaccard_join, op4_packing, op5_fingerprint, op6_quality, op7_bpe, op8_chat,
                                   op9_suffix_dedup, op10_embedding_dedup, op11_prefix_trie,
                                   op12_spelling, op13_graph_search)}


def sql() -> dict[str, str]:
    return {"op3_jaccard_join": OP3, "op8_chat": OP8, "op10_embedding_dedup": OP10, "op11_prefix_trie": OP11,
            "op12_spelling": OP12, "op13_graph_search": OP13}


# Template marks and control strings are the operator's fixed values: a turn adds the marks (23
# characters); every backslash and control string inside it adds one.
OP8 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, 23 + length(regexp_replace(role, p, '\0+', 'g')) + length(regexp_replace(text, p, '\0+', 'g')) AS chars
  FROM rows, (SELECT '\\|<\|turn\|>|<\|text\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>' AS p)),
running AS (
  SELECT *, sum(chars) OVER w AS prefix, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR pos = n THEN prefix ELSE 0 END) AS BIGINT) AS formatted_chars
FROM running GROUP BY conv_id
"""


# Different texts are compared through their common shingles; a class is a distinct text.
OP3 = r"""
WITH RECURSIVE classes AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS rep, count(*) AS m FROM documents GROUP BY 1),
words AS (
  SELECT rep, m, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM classes),
shingles AS (
  SELECT DISTINCT rep, list_aggregate(w[i:i + least(5, len(w)) - 1], 'string_agg', ' ') AS s
  FROM (SELECT rep, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT rep, count(*) AS n FROM shingles GROUP BY rep),
common AS (
  SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.rep <> b.rep GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes sx ON sx.rep = x JOIN sizes sy ON sy.rep = y
  WHERE c >= 0.8 * (sx.n + sy.n - c) - 1e-9),
reach AS (
  SELECT rep AS x, rep AS y FROM classes UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
component AS (SELECT x, min(y) AS least FROM reach GROUP BY x),
degree AS (SELECT x, sum(m) AS d FROM links JOIN classes ON rep = y GROUP BY x)
SELECT doc_id, least AS component_id, CAST(m - 1 + coalesce(d, 0) AS BIGINT) AS n_links, m AS n_copies, doc_id = least AS kept
FROM documents t JOIN classes c ON c.text = coalesce(t.text, '') JOIN component ON component.x = rep LEFT JOIN degree ON degree.x = rep
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS i, vec_id, CAST(embedding AS DOUBLE[]) AS e,
         coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS valid
  FROM embeddings),
links AS (
  SELECT a.i AS x, b.i AS y, b.vec_id FROM v a JOIN v b ON a.valid AND b.valid AND a.i <> b.i AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT i AS x, i AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
component AS (SELECT x, min(v.vec_id) AS least FROM reach JOIN v ON v.i = y GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.x = v.i) AS n_links, least AS component_id, vec_id = least AS kept
FROM v JOIN component ON component.x = v.i
"""


# Nodes are whole lists of turns here; the CRC-32 of an id is taken bit by bit.
OP11 = r"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT c, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
                lambda x: [ord(x), 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END) AS reg
  FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, role, text FROM (
    SELECT h.c, 0 AS own, pos, role, text FROM heads h JOIN turns t ON t.c = h.c - h.c % 5 WHERE pos <= xor(reg, 4294967295) % 9
    UNION ALL
    SELECT h.c, 1, pos, role, text FROM heads h JOIN turns t ON t.c = h.c WHERE pos > xor(reg, 4294967295) % 9)),
prefixes AS (
  SELECT c, d, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY d) AS p, octet_length(encode(text)) AS b FROM rebuilt
  UNION ALL SELECT c, 0, [], 0 FROM heads),
nodes AS (SELECT row_number() OVER () AS id, * FROM (SELECT d, p, min(c) AS conv_id, count(*) AS n, min(b) AS b FROM prefixes GROUP BY d, p)),
members AS (SELECT x.c, x.d, id FROM prefixes x JOIN nodes v ON v.d = x.d AND v.p = x.p),
edges AS (SELECT DISTINCT up.id AS parent, low.id AS child FROM members up JOIN members low ON up.c = low.c AND low.d = up.d + 1),
kids AS (SELECT parent AS id, count(*) AS k FROM edges GROUP BY 1),
below AS (SELECT DISTINCT up.id AS top, low.id AS id FROM members up JOIN members low ON up.c = low.c AND low.d >= up.d),
sums AS (
  SELECT top AS id, count(*) FILTER (k IS NULL) AS leaves, sum((n - 1) * b) AS saved
  FROM below JOIN nodes USING (id) LEFT JOIN kids USING (id) GROUP BY 1),
ended AS (
  SELECT id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
  FROM members m WHERE d = (SELECT max(d) FROM members o WHERE o.c = m.c) GROUP BY id)
SELECT v.conv_id, v.d AS depth, up.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes v JOIN sums USING (id) LEFT JOIN kids USING (id) LEFT JOIN ended USING (id)
LEFT JOIN edges ON edges.child = v.id LEFT JOIN nodes up ON up.id = edges.parent
"""

OP12 = r"""
WITH RECURSIVE runs AS (
  SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS doc, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
           range(octet_length(encode(doc || ':' || run))),
           lambda i: [CAST('0x' || substr(hex(encode(doc || ':' || run)), 2 * i + 1, 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
         lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END)) AS h
  FROM runs),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
less AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word FROM less l JOIN words w ON l.rest = w.word),
ranked AS (SELECT near.word, other, n, max(n) OVER (PARTITION BY near.word) AS top FROM near JOIN words w ON w.word = other),
best AS (SELECT word, count(*) AS n_near, max(top) AS top, min(other) FILTER (n = top) AS form FROM ranked GROUP BY word),
forms AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN form END AS form,
                 CASE WHEN top >= 2 * n THEN top END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS tip FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.tip WHERE f.form IS NOT NULL)
SELECT f.word, f.form, tip AS root, n, n_near, form_n
FROM forms f JOIN chain c ON c.word = f.word WHERE tip IN (SELECT word FROM forms WHERE form IS NULL)
"""

# The exact answer; the operator's is approximate and equals it where every list is found whole (500 vectors).
OP13 = """
WITH v AS (
  SELECT row_number() OVER () AS i, CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false)),
scored AS (
  SELECT q.i, q.vec_id AS query_id, c.vec_id, c.i AS j,
         list_reduce(list_concat([CAST(0 AS DOUBLE)], list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2])), lambda a, x: a + x) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.i <> c.i AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id NULLS LAST, j) AS rank FROM scored)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
