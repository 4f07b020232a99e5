"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from obspark.llm.audio import op8_mpeg_audio
from obspark.llm.bpe import op6_bpe
from obspark.llm.chat import op12_chat_format
from obspark.llm.convnet import op1_quality, op3_language
from obspark.llm.fingerprints import minhash_classes, op5_fingerprints
from obspark.llm.html import op10_html
from obspark.llm.jaccard import op2_jaccard_join
from obspark.llm.middles import op13_fill_in_middle
from obspark.llm.packing import instruction_packing, op4_packing
from obspark.llm.prefix_trie import op11_prefix_trie
from obspark.llm.sharding import op7_sharding
from obspark.llm.suffixes import op9_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_language": op3_language,
    "op4_packing": op4_packing,
    "op5_fingerprints": op5_fingerprints,
    "op6_bpe": op6_bpe,
    "op7_sharding": op7_sharding,
    "op8_mpeg_audio": op8_mpeg_audio,
    "op9_repeats": op9_repeats,
    "op10_html": op10_html,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_chat_format": op12_chat_format,
    "op13_fill_in_middle": op13_fill_in_middle,
    "instruction_packing": instruction_packing,
    "minhash_classes": minhash_classes,
}

#: All pairs of documents by shared shingles, then what links reach.
JACCARD_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] END) AS g FROM t),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
 ends AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 c(id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT ends.b, c.m FROM c JOIN ends ON c.id = ends.a),
 r AS (SELECT id, min(m) AS component_id FROM c GROUP BY id)
SELECT r.id AS doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM r LEFT JOIN n ON r.id = n.doc_id
"""

#: The article element of the tables' pages, block by block, with the character references that they use.
HTML_SQL = r"""
WITH b AS (SELECT page_id, url, [trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))
  for x in string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>')] AS l FROM pages),
 t AS (SELECT page_id, url, array_to_string([x for x in l if x <> ''], chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""

#: Prefixes by the hashes of their turns, nodes by grouping, subtrees by the paths of smallest members; CRC-32 bit by bit.
TRIE_SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s, turn FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT c, s, octet_length(encode(text)) AS b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, s) - 1 AS p FROM t),
 k AS (SELECT c, c - c % 5 AS base, CASE WHEN c % 5 = 0 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT for x in string_split(c::VARCHAR, '')]), lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT for i in range(8)]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 9 END AS h FROM (SELECT DISTINCT c FROM t)),
 r AS (SELECT k.c, 0 AS own, o.p, o.s, o.b FROM k JOIN o ON o.c = k.base AND o.p < k.h UNION ALL SELECT k.c, 1, o.p, o.s, o.b FROM k JOIN o ON o.c = k.c AND o.p >= k.h),
 l AS (SELECT c, s, b, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d FROM r),
 x AS (SELECT c, d, b, array_to_string(list(s) OVER (PARTITION BY c ORDER BY d), '') AS path FROM l UNION ALL SELECT c, 0, 0, '' FROM k),
 m AS (SELECT c, max(d) AS len FROM x GROUP BY c),
 n AS (SELECT d, path, min(x.c) AS id, count(*) AS members, any_value(b) AS b, string_agg(x.c::VARCHAR, ',' ORDER BY x.c) FILTER (m.len = x.d) AS ends FROM x JOIN m USING (c) GROUP BY d, path),
 q AS (SELECT n.*, u.id AS parent FROM n LEFT JOIN x ON x.c = n.id AND x.d = n.d - 1 LEFT JOIN n u ON u.d = x.d AND u.path = x.path),
 w AS (SELECT parent, d - 1 AS d, count(*) AS children FROM q WHERE d > 0 GROUP BY ALL),
 v AS (SELECT q.*, coalesce(w.children, 0) AS children FROM q LEFT JOIN w ON w.parent = q.id AND w.d = q.d),
 a AS (SELECT n.id, n.d, sum((v.members - 1) * v.b) AS saved, count(*) FILTER (v.children = 0) AS leaves FROM v JOIN x ON x.c = v.id AND x.d <= v.d JOIN n ON n.d = x.d AND n.path = x.path GROUP BY ALL)
SELECT v.id AS conv_id, v.d AS depth, v.parent AS parent_conv_id, v.members AS n_convs, v.children AS n_children, a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN a ON a.id = v.id AND a.d = v.d
"""

#: Lengths by the template, hashes by the turns themselves.
_MARKS = r"'([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|<TURN>>|</TURN>>)', '\1\\\2\3', 'g'"
CHAT_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
 t AS (SELECT *, length(regexp_replace(text, {_MARKS})) + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 WHEN 'system' THEN 18 ELSE 25 + length(regexp_replace(role, {_MARKS})) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

#: Lines by a regular expression, pieces by slices of the list of lines.
MIDDLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
 h AS (SELECT *, len(l) AS n, [CAST('0x' || x[8 * i + 1:8 * i + 8] AS BIGINT) for i in range(4)] AS h FROM d),
 c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
 p AS (SELECT *, array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

ORACLE_SQL: dict[str, str] = {"op11_prefix_trie": TRIE_SQL, "op12_chat_format": CHAT_SQL, "op13_fill_in_middle": MIDDLE_SQL, "op2_jaccard_join": JACCARD_SQL, "op10_html": HTML_SQL}
