"""SQL twins of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from shelfwise.llm.queries import SHARD_BYTES

#: Extendible hashing on the same md5 bits; 24 of them are far more than the oracle's data needs.
_OP1 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS row_bytes,
         lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UBIGINT), 32, '0') AS bits
  FROM documents
), cells AS (
  SELECT depth, substr(bits, 1, depth) AS shard, sum(row_bytes)::BIGINT AS shard_bytes, count(*) AS n
  FROM d, generate_series(0, 24) t(depth) GROUP BY 1, 2
), leaves AS (
  SELECT c.shard, c.depth::INTEGER AS shard_depth, c.shard_bytes
  FROM cells c LEFT JOIN cells p ON p.depth = c.depth - 1 AND p.shard = substr(c.shard, 1, c.depth - 1)
  WHERE (c.shard_bytes <= {SHARD_BYTES} OR c.n = 1) AND (c.depth = 0 OR (p.shard_bytes > {SHARD_BYTES} AND p.n > 1))
)
SELECT doc_id, shard, shard_depth, shard_bytes, row_bytes::BIGINT AS row_bytes
FROM d JOIN leaves ON shard = substr(bits, 1, shard_depth)
"""

_WORDS = r"string_split_regex({}, '[ \t\n\x0b\x0c\r]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sets(table: str, key: str, n: int, name: str) -> str:
    """Distinct n-word shingles of each row's words, a shorter text being one."""
    words = f"list_filter({_WORDS.format(_LOWER)}, lambda x: x <> '')"
    return f"""
{name}_words AS (SELECT {key}, {words} AS w FROM {table} WHERE text IS NOT NULL),
{name} AS (
  SELECT DISTINCT {key}, array_to_string(w[i:i + {n - 1}], ' ') AS g
  FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS i FROM {name}_words WHERE len(w) > 0)
)"""


_OP8 = f"""
WITH {_sets("documents", "doc_id", 5, "d")}, {_sets("benchmark", "item_id", 5, "b")},
sizes AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY 1),
common AS (SELECT doc_id, item_id, count(*) AS n_common FROM d JOIN b USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_common, n_common / n_shingles AS containment
FROM common JOIN sizes USING (item_id) WHERE 100 * n_common >= 80 * n_shingles
"""

_OP9 = f"""
WITH RECURSIVE {_sets("documents", "doc_id", 3, "d")},
sizes AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM d a JOIN d b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 90 * (p.n + q.n - i)),
reach AS (SELECT x AS a, x AS b FROM links UNION SELECT a, y FROM reach JOIN links ON b = x),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id)::BIGINT AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON a = doc_id
"""


#: Every 100-byte window as hex digits; windows all have one length, so spans are islands of starts.
_OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS i FROM d),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY substr(h, 2 * i + 1, 200) ORDER BY doc_id, i) AS n FROM w),
g AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, TRUE) AS new FROM f WHERE n > 1),
m AS (SELECT doc_id, i, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
spans AS (SELECT doc_id, span, min(i) AS s, max(i) + 100 AS e FROM m GROUP BY 1, 2),
cuts AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans),
parts AS (SELECT doc_id, count(*) AS n_spans, sum(e - s)::BIGINT AS n_removed, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS head FROM cuts JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN parts USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": _OP1, "op2_suffix_dedup": _OP2, "op8_decontaminate": _OP8, "op9_jaccard": _OP9}
