"""DuckDB SQL of operators that SQL can express, in a module of its own for its length."""

from __future__ import annotations


def _assigned(codebook: str) -> str:
    """Each part's nearest entry and its squared distance; ties go to the lower entry."""
    return f"""SELECT p.vec_id, p.label, p.part, p.ints, min(struct_pack(d := d, entry := c.entry)) AS best FROM part p JOIN {codebook} c USING (part),
  LATERAL (SELECT CAST(list_sum(list_transform(list_zip(p.ints, c.ints), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d) GROUP BY ALL"""


def _means(assigned: str, codebook: str) -> str:
    """The codebook after a round: floors of means, entries without parts as they were."""
    return f"""SELECT c.part, c.entry, coalesce(m.ints, c.ints) AS ints FROM {codebook} c LEFT JOIN (SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY pos) AS ints FROM
  (SELECT part, best.entry AS entry, pos, sum(ints[pos]) AS total, count(*) AS n FROM {assigned}, range(1, 1 + len(ints)) r(pos) GROUP BY ALL) GROUP BY ALL) m ON m.part = c.part AND m.entry = c.entry"""


CODES = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
part AS MATERIALIZED (SELECT vec_id, label, part, ints[part * (len(ints) // 16) + 1 : (part + 1) * (len(ints) // 16)] AS ints FROM kept, range(16) r(part)),
c0 AS MATERIALIZED (SELECT part, CAST(dense_rank() OVER (ORDER BY vec_id) - 1 AS INT) AS entry, ints FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
a0 AS MATERIALIZED ({_assigned("c0")}), c1 AS MATERIALIZED ({_means("a0", "c0")}), a1 AS MATERIALIZED ({_assigned("c1")}), c2 AS MATERIALIZED ({_means("a1", "c1")}), a2 AS MATERIALIZED ({_assigned("c2")}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(ints[pos] AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c2, range(1, 1 + len(ints)) r(pos)) AS codebooks_sha256 FROM coded
"""


VECTORS = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e, len(embedding) AS d FROM embeddings),
fit AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND d > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = d AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
link AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM fit a JOIN fit b ON a.label = b.label AND a.d = b.d AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.r) AS n_links, c.component_id, v.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM v JOIN (SELECT reach.a, min(w.vec_id) AS component_id FROM reach JOIN v w ON w.r = reach.b GROUP BY 1) c ON c.a = v.r
"""


_CRC32 = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), [CAST(0 AS BIGINT) FOR z IN range(8)]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END))"""
_SAY = "CASE WHEN out = '' THEN '' ELSE out || chr(10) END ||"

DIALOGUES = rf"""
WITH RECURSIVE keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
  FROM (SELECT *, xor({_CRC32}, CAST(4294967295 AS BIGINT)) % 20 AS kind FROM keyed), range(2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 64), sha256(text)) AS i FROM damaged),
marked AS (SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS empty, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open FROM ranked),
row_ AS MATERIALIZED (SELECT *, empty OR again AS forced, coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS clash FROM marked),
fault AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (empty) AS blank, count(*) FILTER (again AND NOT empty) AS duplicate,
  count(*) FILTER (open AND NOT forced) AS truncated, count(*) FILTER (clash) AS illegal FROM row_ GROUP BY 1),
walk AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, struct_pack(cost := CAST(0 AS BIGINT), audit := '', out := '') AS best FROM conversations
  UNION ALL SELECT conv_id, i, after, min(struct_pack(cost := cost + CASE edit WHEN 'D' THEN 2 ELSE 5 * CAST(open AS INT) + CAST(edit = 'R' AS INT) END, audit := audit || edit,
    out := CASE edit WHEN 'D' THEN out WHEN 'K' THEN {_SAY} role || ':' || text ELSE {_SAY} CASE after WHEN 2 THEN 'user:' ELSE 'assistant:' END || text END))
  FROM (SELECT *, CASE edit WHEN 'D' THEN state WHEN 'R' THEN CASE state WHEN 2 THEN 3 ELSE 2 END
      ELSE CASE WHEN initial = 's' AND state = 0 THEN 1 WHEN initial = 'u' AND state <> 2 THEN 2 WHEN initial = 'a' AND state = 2 THEN 3 END END AS after
    FROM (SELECT r.conv_id, r.i, r.role, r.text, r.initial, r.open, r.forced, CASE WHEN k = 0 THEN w.state WHEN w.state = 2 THEN 3 ELSE 2 END AS state, w.best.cost + 5 * k AS cost, w.best.audit || repeat('I', k) AS audit,
        CASE WHEN k = 0 THEN w.best.out ELSE CASE WHEN w.best.out = '' THEN '' ELSE w.best.out || chr(10) END || CASE w.state WHEN 2 THEN 'assistant:' ELSE 'user:' END END AS out
      FROM walk w JOIN row_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1, (VALUES (0), (1)) ins(k)) before, (VALUES ('K'), ('R'), ('D')) e(edit) WHERE edit = 'D' OR NOT forced)
  WHERE after IS NOT NULL GROUP BY conv_id, i, after),
done AS (SELECT w.conv_id, min(CASE w.state WHEN 2 THEN struct_pack(cost := w.best.cost + 5, audit := w.best.audit || 'I', out := w.best.out || chr(10) || 'assistant:') ELSE w.best END) AS best
  FROM walk w LEFT JOIN fault f ON f.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(f.n, 0) AND w.state <> 1 GROUP BY 1)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, d.best.cost AS cost, d.best.audit AS audit,
  sha256(d.best.out) AS repaired_sha256 FROM done d LEFT JOIN fault f ON f.conv_id IS NOT DISTINCT FROM d.conv_id
"""
