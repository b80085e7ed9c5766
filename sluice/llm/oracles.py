"""SQL twins of the operators that SQL can express, besides mixing."""

from __future__ import annotations


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: CRC-32 of an id in decimal, a bit at a time: the reflected polynomial over the register
_STEP = "CASE WHEN xor(a, e) & 1 = 1 THEN xor(xor(a, e) >> 1, 3988292384) ELSE xor(a, e) >> 1 END"
_CRC = f"""xor(list_reduce(flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
      lambda i: [ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda a, e: {_STEP}, 4294967295::BIGINT), 4294967295::BIGINT)"""

_SIDE = "coalesce(string_agg(digest, '') OVER (PARTITION BY {tree}level, idx // 3 ORDER BY idx ROWS BETWEEN {frame}), '')"
_LEFT, _RIGHT = "UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"


def _sides(nodes: str, tree: str) -> str:
    return (f"SELECT {tree}level, idx, {_SIDE.format(tree=tree, frame=_LEFT)} AS l, {_SIDE.format(tree=tree, frame=_RIGHT)} AS r "
            f"FROM {nodes} WHERE n > 1")


MERKLE_SQL = f"""
WITH RECURSIVE
claims AS (
  SELECT *, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS given FROM documents),
digests AS (SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf('given')} AS claimed FROM claims),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM digests),
nodes AS (
  SELECT tree, 0 AS level, idx, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3
  FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3, n),
subroots AS (SELECT tree, digest FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS level, tree AS idx, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3
  FROM upper_nodes WHERE n > 1 GROUP BY level, idx // 3, n),
sides AS ({_sides('nodes', 'tree, ')}),
upper_sides AS ({_sides('upper_nodes', '')}),
lower_fold AS (
  SELECT tree, idx AS place, 0 AS level, idx, claimed AS acc, '' AS proof FROM leaves
  UNION ALL
  SELECT f.tree, place, f.level + 1, f.idx // 3, sha256(l || acc || r), proof || l || r
  FROM lower_fold f JOIN sides s ON s.tree = f.tree AND s.level = f.level AND s.idx = f.idx),
upper_fold AS (
  SELECT tree, place, 0 AS level, tree AS idx, arg_max(acc, level) AS acc, arg_max(proof, level) AS proof FROM lower_fold GROUP BY tree, place
  UNION ALL
  SELECT f.tree, place, f.level + 1, f.idx // 3, sha256(l || acc || r), proof || l || r
  FROM upper_fold f JOIN upper_sides s ON s.level = f.level AND s.idx = f.idx),
folds AS (SELECT tree, place, arg_max(acc, level) AS folded, arg_max(proof, level) AS proof FROM upper_fold GROUP BY tree, place)
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.digest AS verified
FROM leaves v JOIN folds f ON f.tree = v.tree AND f.place = v.idx JOIN subroots s ON s.tree = v.tree
JOIN (SELECT digest FROM upper_nodes WHERE n = 1) t ON true
"""

_KEY = """translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

LINES_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos FROM split),
keyed AS (SELECT *, {_KEY} AS key FROM lines),
held AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT k.*, h.last IS NULL OR h.last = k.doc_id AS kept FROM keyed k LEFT JOIN held h ON h.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT kept)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""
