"""DuckDB SQL for the queries that SQL can express; the others are held against brute force in tests/llm."""

from __future__ import annotations

from tessera.llm import line_dedup as L
from tessera.llm.catalog import MIX_EPOCHS, MIX_FRACTION, MIX_SEED, MIX_WEIGHTS, PROBE

_LINES = (f"list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{L.HIDDEN}', ' ', 'g'), "
          f"'{L.BLOCK}', chr(10), 'g'), '{L.TAG}', '', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')")

OP1 = f"""
WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{L.HOST}', 1)) AS host, {_LINES} AS lines FROM pages),
t AS (SELECT host, count(*) AS n FROM p GROUP BY host),
k AS (SELECT host, line, count(*) AS c FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
b AS (SELECT host, list(line) AS common FROM k JOIN t USING (host) WHERE c > 1 AND c > {L.RATIO}::DOUBLE * n GROUP BY host),
o AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(common, []), x)) AS kept FROM p LEFT JOIN b USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS text_sha256 FROM o
"""

_ESC = "replace(replace(replace({}, '\\', '\\\\'), '<', '\\l'), '>', '\\g')"

OP2 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum(length({_ESC.format('role')}) + length({_ESC.format('text')}) + 17)::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

_BASE32 = ("array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
           "1 + ((('0x' || substr(d, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '')")

OP4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS d, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM g
"""

OP5 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS n FROM d)
SELECT doc_id, keep_id, n::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def _share(k: int) -> str:
    """One level of the tree: the parents' shares go to their children, in whole tokens."""
    parent, prev = ("''", "g0") if k == 1 else (f"p{k - 1}", f"g{k - 1}")
    return f"""
a{k} AS (SELECT {parent} AS parent, p{k} AS path, sum(cap)::BIGINT AS cap FROM leaves GROUP BY ALL),
b{k} AS (SELECT a.parent, a.path, a.cap, coalesce(w.weight, 1) AS w, g.get FROM a{k} a LEFT JOIN weights w ON w.path = a.path JOIN {prev} g ON g.path = a.parent
         WHERE coalesce(w.weight, 1) > 0),
c{k} AS (SELECT *, (sum(cap) OVER o - cap)::BIGINT AS before, (sum(w) OVER (PARTITION BY parent) - sum(w) OVER o + w)::BIGINT AS rest_w FROM b{k}
         WINDOW o AS (PARTITION BY parent ORDER BY cap::DOUBLE / w, path)),
d{k} AS (SELECT *, w * (get - before) >= cap * rest_w AS is_full, row_number() OVER (PARTITION BY parent ORDER BY cap::DOUBLE / w, path) AS rn FROM c{k}),
e{k} AS (SELECT parent, arg_min(get - before, rn) AS rest, arg_min(rest_w, rn) AS rest_w FROM d{k} WHERE NOT is_full GROUP BY parent),
g{k} AS (SELECT d.path, CASE WHEN d.is_full THEN d.cap ELSE least(d.cap, (d.w * e.rest) // e.rest_w) END AS get FROM d{k} d LEFT JOIN e{k} e USING (parent))"""


OP6 = f"""
WITH weights(path, weight) AS (VALUES {', '.join(f"('{p}', {w}::BIGINT)" for p, w in MIX_WEIGHTS)}),
s AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens, coalesce(lang, '-') AS lang, coalesce(source, '-') AS source,
             coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 3 AS k FROM documents),
t AS (SELECT doc_id, tokens, CASE k WHEN 0 THEN 'web' WHEN 1 THEN 'news' ELSE 'books' END AS p1, p1 || '/' || lang AS p2, p2 || '/' || source AS p3 FROM s),
leaves AS (SELECT p1, p2, p3, sum(tokens)::BIGINT AS tokens, (sum(tokens) * {MIX_EPOCHS})::BIGINT AS cap FROM t GROUP BY ALL),
g0 AS (SELECT '' AS path, least(sum(cap), floor({MIX_FRACTION}::DOUBLE * sum(tokens)::BIGINT)::BIGINT)::BIGINT AS get FROM leaves),{_share(1)},{_share(2)},{_share(3)},
plan AS (SELECT l.p3, g.get // l.tokens AS whole, g.get % l.tokens AS rest FROM leaves l JOIN g3 g ON g.path = l.p3 WHERE l.tokens > 0),
r AS (SELECT t.*, whole, rest, md5(concat_ws('|', '{MIX_SEED}', whole::VARCHAR, coalesce(doc_id::VARCHAR, ''))) AS h FROM t JOIN plan USING (p3)),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY p3 ORDER BY h) <= rest AS part FROM r)
SELECT doc_id, unnest(range(whole + part::INT))::INT AS epoch, p3 AS leaf, tokens AS n_tokens FROM u
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT uid, m, i, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT uid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM iw))),
h AS (SELECT uid, i, dw.m, item FROM dw JOIN iw USING (m, t)),
n AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(i, i + m)) AS p FROM h) GROUP BY uid),
s AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT uid, item FROM h) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (uid) LEFT JOIN s USING (uid)
"""


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, with the table ``crc.t``."""
    return (f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(octet_length(encode({text}))), "
            f"lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))")


_CRC_TABLE = ("crc AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t "
              "FROM range(256) r(i))")

OP11 = rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
g AS (SELECT d || ':' || run AS x, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, {_crc32('x')} AS h FROM g, crc),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT DISTINCT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
      UNION SELECT cut.word, w.word FROM cut JOIN w ON cut.less = w.word
      UNION SELECT w.word, cut.word FROM cut JOIN w ON cut.less = w.word),
b AS (SELECT x, count(*)::BIGINT AS n_near, arg_max(struct_pack(y := y, n := n), (n, -k)) AS best FROM
      (SELECT x, y, n, row_number() OVER (ORDER BY y) AS k FROM p JOIN w ON w.word = p.y) GROUP BY x),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * n THEN best.y END AS form, CASE WHEN best.n >= 5 * n THEN best.n END AS form_n
      FROM w LEFT JOIN b ON b.x = w.word),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk USING (word) JOIN f last ON last.word = walk.at WHERE last.form IS NULL
"""


def _said(*values: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({v}))::VARCHAR || ':' || {v}, '-')" for v in values) + "))"


#: Trees of up to 2 ** MERKLE_LEVELS leaves; a level in which a tree is one node leaves it as it is.
MERKLE_LEVELS = 40


def _tree(name: str, of: str) -> str:
    """All nodes ``(tree, level, pos, digest)`` over ``of(tree, pos, digest)``."""
    return f"""
{name} AS (SELECT tree, 0 AS level, pos, digest, count(*) OVER (PARTITION BY tree) AS wide FROM {of}
  UNION ALL SELECT tree, any_value(level) + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), any_value((wide + 1) // 2) FROM {name} WHERE wide > 1 AND level < {MERKLE_LEVELS}
  GROUP BY tree, pos // 2)"""


def _climb(at: str, nodes: str) -> str:
    """Siblings of the rows ``at(uid, tree, pos)`` by level."""
    return f"""(SELECT a.uid, n.level, s.digest, (a.pos >> n.level) % 2 = 1 AS is_left FROM {at} a
  JOIN (SELECT DISTINCT tree, level FROM {nodes} WHERE wide > 1) n USING (tree) LEFT JOIN {nodes} s ON s.tree = a.tree AND s.level = n.level AND s.pos = xor(a.pos >> n.level, 1::BIGINT))"""


OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce('1' || lang, '0') AS tree, {_said('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', 'text')} AS digest,
      CASE WHEN {_crc32('coalesce(doc_id::VARCHAR, chr(0))')} % 7 = 0 AND doc_id IS NOT NULL THEN {_said('doc_id::VARCHAR', 'source', 'lang', '(n_chars + 1)::VARCHAR', 'text')} END AS changed
      FROM documents, crc),
leaf AS (SELECT *, (row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1)::BIGINT AS pos FROM d),{_tree('low', 'leaf')},
sub AS (SELECT '' AS tree, tree AS of, digest, (row_number() OVER (ORDER BY encode(tree)) - 1)::BIGINT AS pos FROM low WHERE wide = 1),{_tree('high', 'sub')},
tops AS (SELECT of AS uid, tree, pos FROM sub),
proofs AS (SELECT uid, level, digest, is_left FROM {_climb('leaf', 'low')}
  UNION ALL SELECT leaf.uid, 1000 + x.level, x.digest, x.is_left FROM leaf JOIN {_climb('tops', 'high')} x ON x.uid = leaf.tree),
steps AS (SELECT uid, list(struct_pack(digest := digest, is_left := is_left) ORDER BY level) AS steps, coalesce(string_agg(digest, '' ORDER BY level), '') AS said FROM proofs GROUP BY uid),
o AS (SELECT leaf.uid, doc_id, leaf.digest AS leaf, sub.digest AS subroot, (SELECT digest FROM high WHERE wide = 1) AS root, sha256(coalesce(said, '')) AS proof_sha256,
      coalesce(changed, leaf.digest) AS start, coalesce(steps, []) AS steps FROM leaf JOIN sub ON sub.of = leaf.tree LEFT JOIN steps USING (uid)),
fold AS (SELECT uid, start AS node, steps, 1 AS k FROM o
  UNION ALL SELECT uid, sha256(CASE WHEN steps[k].digest IS NULL THEN node WHEN steps[k].is_left THEN steps[k].digest || node ELSE node || steps[k].digest END), steps, k + 1
  FROM fold WHERE k <= len(steps))
SELECT doc_id, leaf, subroot, root, proof_sha256, node AS folded_root, node = root AS verified FROM o JOIN fold USING (uid) WHERE k > len(fold.steps)
"""

LLM_ORACLE = {"op1_line_dedup": OP1, "op2_chat_trees": OP2, "op4_warc_index": OP4, "op5_exact_dedup": OP5, "op6_mixing": OP6, "op9_decontaminate": OP9,
              "op11_spelling": OP11, "op12_merkle": OP12}
