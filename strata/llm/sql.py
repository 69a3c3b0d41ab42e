"""SQL for the dealt operators that SQL can express: the manifest (11) and the vector codes (13)."""

from __future__ import annotations

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
# CRC-32 of an ASCII text, bit by bit.
_CRC32 = (
    "xor(list_reduce(list_transform(range(1, len({0}) + 1), lambda k: ascii(substr({0}, k, 1))::BIGINT), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))), 4294967295), 4294967295)"
)


def _row(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, base: str) -> str:
    """Nodes of all levels; ``base`` has grp, i, n and h of the leaves."""
    return f"""{name} AS (
  SELECT grp, 0 AS level, i, n, h FROM ({base})
  UNION ALL
  SELECT grp, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY grp, level, i // 16, n),
{name}_runs AS (SELECT grp, level, i // 16 AS run, list(h ORDER BY i) AS hs FROM {name} WHERE n > 1 GROUP BY ALL),
{name}_tops AS (SELECT grp, h FROM {name} WHERE n = 1)"""


def _folds(name: str, tree: str, base: str) -> str:
    """Paths to the top of ``tree`` one level at a time; ``base`` has id, grp, i, cur and sibs."""
    return f"""{name} AS (
  SELECT id, grp, 0 AS level, i, cur, sibs FROM ({base})
  UNION ALL
  SELECT f.id, f.grp, f.level + 1, f.i // 16, sha256(array_to_string(hs[1:f.i % 16] || [f.cur] || hs[f.i % 16 + 2:], '')),
         f.sibs || array_to_string(hs[1:f.i % 16] || hs[f.i % 16 + 2:], '')
  FROM {name} f JOIN {tree}_runs r ON r.grp = f.grp AND r.level = f.level AND r.run = f.i // 16),
{name}_last AS (SELECT id, grp, arg_max(cur, level) AS cur, arg_max(sibs, level) AS sibs FROM {name} GROUP BY id, grp)"""


MERKLE_MANIFEST = f"""WITH RECURSIVE leaf AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (ORDER BY grp, doc_id NULLS FIRST, h) AS id
  FROM (SELECT doc_id, coalesce('=' || source, '') AS grp, {_row("text")} AS h,
               CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 5 = 0 THEN {_row("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS now
        FROM documents)),
{_levels("own", "SELECT grp, i, n, h FROM leaf")},
groups AS (SELECT grp AS member, '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n, h FROM own_tops),
{_levels("whole", "SELECT grp, i, n, h FROM groups")},
{_folds("lower_path", "own", "SELECT id, grp, i, coalesce(now, h) AS cur, '' AS sibs FROM leaf")},
{_folds("upper_path", "whole", "SELECT l.id, g.grp, g.i, l.cur, l.sibs FROM lower_path_last l JOIN groups g ON g.member = l.grp")}
SELECT l.doc_id, l.h AS leaf, g.h AS subroot, t.h AS root, sha256(u.sibs) AS proof_sha256, u.cur AS folded_root, u.cur = t.h AS verified
FROM leaf l JOIN upper_path_last u ON u.id = l.id JOIN groups g ON g.member = l.grp JOIN whole_tops t ON t.grp = ''"""


def _nearest(step: int) -> str:
    gap = "(x.v[d] - b.v[d]) * (x.v[d] - b.v[d])"
    return f"""near{step} AS (SELECT r, x.p, min({{'d': list_sum(list_transform(range(1, len(x.v) + 1), lambda d: {gap}))::BIGINT, 'k': k}}) AS best FROM part x JOIN book{step} b ON b.p = x.p GROUP BY r, x.p)"""


def _means(step: int) -> str:
    return f"""mean{step} AS (
  SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY d) AS v FROM (
    SELECT p, k, d, sum(value)::BIGINT AS s, count(*) AS n
    FROM (SELECT x.p, best.k AS k, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS value FROM part x JOIN near{step} USING (r, p)) GROUP BY p, k, d) GROUP BY p, k),
book{step + 1} AS (SELECT b.p, b.k, coalesce(m.v, b.v) AS v FROM book{step} b LEFT JOIN mean{step} m ON m.p = b.p AND m.k = b.k)"""


VECTOR_CODES = f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT r, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS v FROM kept, range(16) AS parts(p)),
book0 AS (SELECT p, r AS k, v FROM part WHERE r < 64),
{_nearest(0)},
{_means(0)},
{_nearest(1)},
{_means(1)},
{_nearest(2)},
coded AS (SELECT r, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near2 GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), books"""
