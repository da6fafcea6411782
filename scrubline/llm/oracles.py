"""DuckDB SQL of the operators over vectors and of the Merkle manifest, put together level by level and round by round."""

from __future__ import annotations

#: Levels in the SQL of op12: enough for two million documents of a language, and for 512 languages.
LEAF_LEVELS, ROOT_LEVELS = 7, 3


def _levels(name: str, count: int) -> str:
    """Levels 1 to ``count`` of trees over name0 (tree, i, d), and each level's siblings; what is single stays as it is."""
    out = []
    for k in range(count):
        out.append(f""", {name}{k}s AS MATERIALIZED (SELECT tree, i, count(*) OVER (PARTITION BY tree) > 1 AS more,
  coalesce(string_agg(d, '') OVER (PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER (PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}),
{name}{k + 1} AS MATERIALIZED (SELECT tree, i // 8 AS i, CASE WHEN max(c) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {name}{k}) GROUP BY tree, i // 8)""")
    return "".join(out)


def _folds(rows: str, name: str, count: int, out: str) -> str:
    """rows (tree, i, proof, node, ...) with the siblings of ``count`` levels added to proof and folded into node, as ``out``."""
    steps = []
    for k in range(count):
        to = out if k == count - 1 else f"{out}_{k}"
        steps.append(f", {to} AS MATERIALIZED (SELECT f.* REPLACE (f.proof || l || r AS proof, CASE WHEN more THEN sha256(l || f.node || r) ELSE f.node END AS node) FROM {rows} f JOIN {name}{k}s s ON s.tree = f.tree AND s.i = f.i // {8**k})")
        rows = to
    return "".join(steps)


def merkle() -> str:
    part = lambda c: f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')"
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"]
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "list_reduce(flatten([[ord(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s // 2, CASE WHEN s % 2 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295)"
    leaf = lambda text: f"sha256({' || '.join(map(part, [*values, text]))})"
    return (
        f"""WITH h AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {leaf('text')} AS leaf, {leaf(low)} AS other, xor({crc}, 4294967295) % 3 = 0 AS hit FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM h),
n0 AS (SELECT tree, i, leaf AS d FROM p)"""
        + _levels("n", LEAF_LEVELS)
        + f", t0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, d, tree AS lang FROM n{LEAF_LEVELS})"
        + _levels("t", ROOT_LEVELS)
        + ", f AS (SELECT doc_id, tree, i, leaf, '' AS proof, CASE WHEN hit THEN other ELSE leaf END AS node FROM p)"
        + _folds("f", "n", LEAF_LEVELS, "g")
        + ", u AS (SELECT doc_id, '' AS tree, t0.i, leaf, proof, node, d AS subroot FROM g JOIN t0 ON g.tree = t0.lang)"
        + _folds("u", "t", ROOT_LEVELS, "w")
        + f" SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = d AS verified FROM w, (SELECT d FROM t{ROOT_LEVELS})"
    )


_INTEGERS = "list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)"


def clusters(rounds: int = 10, k: int = 8, size: int = 64) -> str:
    out = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, {_INTEGERS} AS e FROM embeddings WHERE len(embedding) = {size} AND {_FINITE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, e FROM (SELECT sha256('3:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {k}))"""
    for r in range(rounds + 1):
        far = "CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        out += f", a{r} AS MATERIALIZED (SELECT n, any_value(vec_id) AS vec_id, any_value(e) AS e, arg_min(k, d * {k} + k) AS k, min(d) AS d FROM (SELECT v.*, c.k, {far} AS d FROM v, c{r} c) GROUP BY n)"
        if r < rounds:
            mean = "CAST((s - ((s % m) + m) % m) // m AS BIGINT)"
            out += f""", c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(b.e, c.e) AS e FROM c{r} c LEFT JOIN (SELECT k, list({mean} ORDER BY p) AS e
 FROM (SELECT k, p, sum(x) AS s, count(*) AS m FROM (SELECT k, unnest(e) AS x, unnest(range({size})) AS p FROM a{r}) GROUP BY k, p) GROUP BY k) b USING (k))"""
    return out + f"""
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (k)"""


def top_inner(k: int = 10) -> str:
    return f"""
WITH v AS (SELECT vec_id, {_INTEGERS} AS e FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}
"""
