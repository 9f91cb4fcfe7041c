"""DuckDB SQL for the operators that SQL can express on whole tables.

The rest (tokenizers, trained models, packing) has none and is tested against brute force, the library or held-out
rows.
"""

from __future__ import annotations

from .chat_format import BUDGET, HISTORY, MARKUP
from .embedding_dedup import SIMILARITY as COSINE
from .near_dedup import SIMILARITY, WORDS
from .suffix_dedup import LENGTH

SUFFIX_DEDUP = f"""
WITH d AS (SELECT doc_id, coalesce(encode(text), ''::BLOB) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, p, b[p:p + {LENGTH - 1}] AS s FROM (SELECT doc_id, b, unnest(range(1, n - {LENGTH} + 2)) AS p FROM n WHERE n >= {LENGTH})),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
step AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH} OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS new FROM later),
run AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM step),
span AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS z FROM run GROUP BY doc_id, g),
gap AS (SELECT doc_id, lag(z, 1, 1::BIGINT) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS z FROM span UNION ALL SELECT n.doc_id, coalesce(max(s.z), 1), any_value(n.n) + 1 FROM n LEFT JOIN span s USING (doc_id) GROUP BY n.doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[a:z - 1]), '' ORDER BY a) AS h FROM gap JOIN n USING (doc_id) WHERE z > a GROUP BY doc_id),
total AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM n LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS s FROM d WHERE len(w) > 0),
c AS (SELECT doc_id, s, count(*) AS c FROM s GROUP BY ALL),
n AS (SELECT doc_id, sum(c)::BIGINT AS n FROM c GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS o FROM c a JOIN c b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE o.o / (x.n + y.n - o.o)::DOUBLE >= {SIMILARITY}),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reached FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT d.doc_id, min(r.reached) AS class_id, d.doc_id = min(r.reached) AS kept, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles
FROM d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

_STRIDE = (BUDGET - HISTORY) // 2
_ESCAPED = "length({0}) + length({0}) - length(replace(replace(replace({0}, chr(92), ''), '#', ''), '<', ''))"

CHAT_FORMATTING = f"""
WITH t AS (SELECT coalesce(conv_id, -9223372036854775808) AS conv, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))),
k AS (SELECT *, len(regexp_extract_all(text, '[^ \\t-\\r]+')) + {MARKUP} AS tokens,
    13 + 2 + {_ESCAPED.format("role")} + length(role) - length(replace(role, ':', '')) + {_ESCAPED.format("text")} AS chars FROM t),
p AS (SELECT *, (sum(tokens) OVER w - tokens)::BIGINT AS start, row_number() OVER w AS place FROM k WINDOW w AS (PARTITION BY conv ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, start // {_STRIDE} AS win FROM p),
own AS (SELECT conv, win, min(start) AS first, max(start + tokens) AS stop FROM v GROUP BY ALL),
tail AS (SELECT o.conv, o.stop // {_STRIDE} AS win, sum(v.chars) AS chars, min(v.start) AS first FROM own o JOIN v ON v.conv = o.conv AND v.win = o.win AND v.start >= o.stop - {HISTORY} WHERE o.stop // {_STRIDE} > o.win GROUP BY ALL),
sys AS (SELECT conv, chars FROM v WHERE start = 0 AND role = 'system'),
more AS (SELECT own.conv, sum(coalesce(tail.chars, 0) + CASE WHEN least(own.first, coalesce(tail.first, own.first)) = 0 THEN 0 ELSE coalesce(sys.chars, 0) END) AS chars FROM own LEFT JOIN tail USING (conv, win) LEFT JOIN sys USING (conv) GROUP BY own.conv)
SELECT CASE WHEN v.conv <> -9223372036854775808 THEN v.conv END AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (sum(v.chars) + any_value(more.chars))::BIGINT AS formatted_chars
FROM v JOIN more USING (conv) GROUP BY v.conv
"""

EMBEDDING_NEAR_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT vec_id AS id, vec_id AS reached FROM v UNION SELECT r.id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id) AS n_links, min(r.reached) AS component_id, v.vec_id = min(r.reached) AS kept FROM v JOIN r ON r.id = v.vec_id GROUP BY v.vec_id
"""
