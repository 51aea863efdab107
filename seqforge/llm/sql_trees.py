"""DuckDB SQL for the Merkle manifest and the conversation trie, written from their definition."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text of ASCII, bit by bit."""
    step = "list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda t, z: xor(t >> 1, 3988292384 * (t & 1)))"
    codes = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT))"
    return f"xor(list_reduce({codes}, lambda a, x: {step}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ['doc_id', 'source', 'lang', n_chars, 'text']))})"


def _tree(name: str, first: str) -> str:
    """Nodes (g, lvl, place, h, n of the level) from leaves (g, place, h, n), up to the level of one node."""
    return f"""{name} AS (SELECT g, 0 AS lvl, place, h, n FROM {first} UNION ALL
  SELECT g, lvl + 1, place // 2, sha256(h || coalesce(twin, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY g ORDER BY place) AS twin FROM {name} WHERE n > 1) WHERE place % 2 = 0),
{name}_step AS (SELECT f.g, f.place, v.lvl, s.h, (f.place >> v.lvl) % 2 AS side FROM {first} f JOIN (SELECT DISTINCT g, lvl FROM {name} WHERE n > 1) v ON v.g = f.g
  LEFT JOIN {name} s ON s.g = f.g AND s.lvl = v.lvl AND s.place = xor(f.place >> v.lvl, 1))"""


MERKLE = f"""WITH RECURSIVE l AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {_leaf('n_chars')} AS h,
  CASE WHEN n_chars IS NOT NULL AND {crc32('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS claim FROM documents),
leaf AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM l),
{_tree('node', 'leaf')},
sub AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n, h FROM node WHERE n = 1),
{_tree('top', 'sub')},
step AS (SELECT g, place, lvl, h, side FROM node_step UNION ALL SELECT f.g, f.place, 1000 + t.lvl, t.h, t.side FROM leaf f JOIN sub u ON u.name = f.g JOIN top_step t ON t.place = u.place),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g, place ORDER BY lvl) AS k FROM step),
fold AS (SELECT g, place, 0 AS k, claim AS h FROM leaf UNION ALL
  SELECT f.g, f.place, f.k + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.side = 1 THEN s.h || f.h ELSE f.h || s.h END) FROM fold f JOIN numbered s ON s.g = f.g AND s.place = f.place AND s.k = f.k + 1),
folded AS (SELECT g, place, arg_max(h, k) AS folded_root FROM fold GROUP BY ALL),
proof AS (SELECT g, place, sha256(coalesce(string_agg(h, '' ORDER BY k), '')) AS proof_sha256 FROM numbered GROUP BY ALL)
SELECT f.doc_id, f.h AS leaf, u.h AS subroot, r.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, d.folded_root, d.folded_root = r.h AS verified
FROM leaf f JOIN sub u ON u.name = f.g JOIN (SELECT h FROM top WHERE n = 1) r ON true JOIN folded d ON d.g = f.g AND d.place = f.place LEFT JOIN proof p ON p.g = f.g AND p.place = f.place"""


_TURN = "md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))"

TRIE = rf"""WITH t AS (SELECT conv_id, {_TURN} AS item, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), {_TURN}) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32('conv_id::VARCHAR')} % 4 AS h, conv_id - conv_id % 20 AS lead FROM (SELECT DISTINCT conv_id FROM t)),
given AS (SELECT c.conv_id, h, count(t.p) AS n FROM c LEFT JOIN t ON t.conv_id = c.lead AND t.p < c.h GROUP BY ALL),
r AS (SELECT c.conv_id, t.p, t.item, t.words FROM c JOIN t ON t.conv_id = c.lead AND t.p < c.h
  UNION ALL SELECT t.conv_id, t.p - g.h + g.n, t.item, t.words FROM given g JOIN t ON t.conv_id = g.conv_id WHERE t.p >= g.h),
m AS (SELECT conv_id, 0 AS depth, '' AS path, 0 AS words FROM c
  UNION ALL SELECT conv_id, p + 1, string_agg(item, '') OVER (PARTITION BY conv_id ORDER BY p), words FROM r),
node AS (SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(words) AS words FROM m GROUP BY path),
child AS (SELECT path[:-33] AS path, count(*) AS n_children FROM node WHERE path <> '' GROUP BY 1),
below AS (SELECT m.path, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM node n JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth LEFT JOIN child k ON k.path = n.path GROUP BY m.path),
ended AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, arg_max(path, depth) AS path FROM m GROUP BY conv_id) GROUP BY path)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM node n JOIN below b ON b.path = n.path LEFT JOIN node up ON n.path <> '' AND up.path = n.path[:-33] LEFT JOIN child k ON k.path = n.path LEFT JOIN ended e ON e.path = n.path"""
