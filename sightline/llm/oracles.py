"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from sightline.llm.mixing import PRIME, ROUNDS, SLOTS_PER_SHARD

_SWAP = f"""list_reduce(list_prepend({{x}}, list_transform(range(1, {ROUNDS + 1}), lambda r: r::BIGINT)), lambda acc, r:
  CASE WHEN (((greatest(acc, ((((({{k}} + r * 15485863) % {PRIME}) * 48271) % {PRIME} - acc) % {{n}} + {{n}}) % {{n}}) + {{k}} * 31 + r * 104729) % {PRIME}) * 69621 % {PRIME}) & 16384 = 0
  THEN acc ELSE ((((({{k}} + r * 15485863) % {PRIME}) * 48271) % {PRIME} - acc) % {{n}} + {{n}}) % {{n}} END)"""

MIX = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, left(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 16) AS hash, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1)::BIGINT AS rk FROM s0),
s2 AS (SELECT *, (CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS w, 2 * source_size AS cap FROM s1),
s3 AS (SELECT *,
  ((SELECT sum(source_size) FROM s2)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev FROM s2),
s4 AS (SELECT *, cap <= lev * w AS capped FROM s3),
s AS (SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE (SELECT lev FROM s4 WHERE NOT capped ORDER BY cap / w, rk LIMIT 1) * w END AS target FROM s4),
p0 AS (SELECT d.*, s.source_size, s.target, s.rk FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
p AS (SELECT rid, doc_id, size, source_size, target, rk, coalesce(sum(size) OVER (PARTITION BY rk ORDER BY hash, doc_id ASC NULLS FIRST, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p0),
q AS (SELECT rk, source_size AS z, ceil(source_size / 512)::BIGINT AS n, floor(target)::BIGINT AS want FROM s WHERE source_size > 0),
g AS (SELECT * FROM (SELECT *, (want // z) * n + ceil((want % z) / 512)::BIGINT AS slots FROM q) WHERE slots > 0),
e AS (SELECT *, sum(slots) OVER (ORDER BY rk)::DOUBLE / (SELECT sum(slots) FROM g)::DOUBLE AS hi, coalesce(sum(slots) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / (SELECT sum(slots) FROM g)::DOUBLE AS lo FROM g),
r0 AS (SELECT unnest(range(a)) AS x FROM (SELECT sum(slots)::BIGINT AS a FROM g)),
r1 AS (SELECT x // {SLOTS_PER_SHARD} AS shard, ((x // {SLOTS_PER_SHARD}) % {PRIME} * 7919 + (x % {SLOTS_PER_SHARD}) * 104729 + 17) % {PRIME} * 48271 % {PRIME} AS x FROM r0),
r2 AS (SELECT shard, xor(x, x >> 13) * 69621 % {PRIME} AS x FROM r1),
r3 AS (SELECT shard, (xor(x, x >> 16) * 48271 % {PRIME})::DOUBLE / {PRIME}::DOUBLE AS u FROM r2),
cnt AS (SELECT shard, rk, count(*) AS drawn FROM r3 JOIN e ON u >= lo AND u < hi GROUP BY ALL),
rn AS (SELECT cnt.*, slots, coalesce(sum(drawn) OVER (PARTITION BY rk ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM cnt JOIN g USING (rk)),
kp AS (SELECT *, greatest(least(drawn, slots - first), 0)::BIGINT AS kept FROM rn),
ex AS (SELECT shard, row_number() OVER (ORDER BY shard) - 1 AS j FROM (SELECT shard, unnest(range(drawn - kept)) FROM kp)),
lk AS (SELECT rk, i, row_number() OVER (ORDER BY rk, i) - 1 AS j FROM (SELECT rk, unnest(range(least(slots, coalesce(t, 0))::BIGINT, slots)) AS i FROM g LEFT JOIN (SELECT rk, sum(drawn) AS t FROM cnt GROUP BY rk) USING (rk))),
al AS (SELECT shard, rk, unnest(range(first, first + kept)) AS i FROM kp UNION ALL SELECT shard, rk, i FROM ex JOIN lk USING (j)),
j AS (SELECT shard, rk, z, n, want, i // n AS turn, i % n AS pos, 17 + rk * 7919 + (i // n) * 1299709 AS k FROM al JOIN g USING (rk)),
slot AS (SELECT shard, rk, CASE WHEN pos = n - 1 THEN n - 1 ELSE {_SWAP.format(x="pos", k="k", n="greatest(n - 1, 1)")} END AS block,
  least(CASE WHEN pos = n - 1 THEN z - (n - 1) * 512 ELSE 512 END, want - turn * z - pos * 512) AS take FROM j),
piece AS (SELECT *, unnest(range(start // 512, (start + size - 1) // 512 + 1)) AS block FROM p WHERE size > 0),
us AS (SELECT piece.rid, shard, greatest(least(least(start + size - piece.block * 512, 512), take) - greatest(start - piece.block * 512, 0), 0) AS used
  FROM piece JOIN slot ON piece.rk = slot.rk AND piece.block = slot.block),
u AS (SELECT rid, sum(used) AS taken, min(shard) FILTER (used > 0) AS first_shard, max(shard) FILTER (used > 0) AS last_shard FROM us GROUP BY rid)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(u.taken, 0)::BIGINT AS taken, first_shard, last_shard FROM p LEFT JOIN u USING (rid)
"""

_CONTROL = r"<\|[A-Za-z0-9_]+\|>|</?s>|<</?SYS>>|\[/?[A-Z_][A-Z_]+\]"
_SHOWN = "length({x}) + CASE WHEN hard THEN length({x}) - length(replace({x}, chr(92), '')) + 2 * len(regexp_extract_all({x}, '" + _CONTROL + "')) ELSE 0 END"

CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations
  UNION ALL SELECT *, NULL FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
h AS (SELECT *, regexp_matches(role || chr(1) || text, '{_CONTROL}') OR contains(role, chr(10)) OR regexp_matches(role || chr(1) || text, '\\\\(\\\\|~)') OR contains(role, chr(92) || '%') AS hard FROM c),
f AS (SELECT *, {_SHOWN.format(x="role")} + CASE WHEN hard THEN length(role) - length(replace(role, chr(10), '')) ELSE 0 END AS role_size, {_SHOWN.format(x="text")} AS text_size FROM h),
a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss, sum(role_size + text_size + 24)::BIGINT AS formatted_chars FROM f GROUP BY conv_id, lone)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, true AS intact FROM a
"""

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_LAST = "coalesce(doc_id, 9223372036854775807)"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LAST} AS key, {_WORDS} AS w FROM documents),
win AS (SELECT rid, key, k, sha256(array_to_string(w[k:k + 49], ' ')) AS s FROM (SELECT rid, key, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
f AS (SELECT s, min(key) AS first FROM win GROUP BY s),
gone AS (SELECT DISTINCT rid, k + j AS p FROM (SELECT rid, k FROM win JOIN f USING (s) WHERE first < key), range(50) t(j)),
word AS (SELECT rid, w[p] AS word, p FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""

SUFFIX_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LAST} AS key, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT rid, key, k, substr(x, 2 * k + 1, 100) AS s FROM (SELECT rid, key, x, unnest(range(length(x) // 2 - 49)) AS k FROM d WHERE length(x) >= 100)),
f AS (SELECT s, min(key) AS first FROM win GROUP BY s),
gone AS (SELECT DISTINCT rid, k + j AS p FROM (SELECT rid, k FROM win JOIN f USING (s) WHERE first < key), range(50) t(j)),
byte AS (SELECT rid, p, substr(x, 2 * p + 1, 2) AS h FROM (SELECT rid, x, unnest(range(length(x) // 2)) AS p FROM d WHERE rid IN (SELECT rid FROM gone))),
kept AS (SELECT rid, string_agg(h, '' ORDER BY p) AS x FROM byte ANTI JOIN gone USING (rid, p) GROUP BY rid),
n AS (SELECT rid, count(*) AS n, count(*) FILTER (last IS NULL OR last < p - 1) AS spans FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS last FROM gone) GROUP BY rid)
SELECT doc_id, length(d.x) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN n IS NULL THEN d.x ELSE coalesce(kept.x, '') END)) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) ELSE w END AS g FROM d),
e AS (SELECT rid, doc_id, len(g) AS n, unnest(g) AS h FROM s),
shared AS (SELECT a.rid AS r0, b.rid AS r1, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.rid < b.rid AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
link AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM shared JOIN s x ON x.rid = r0 JOIN s y ON y.rid = r1 WHERE 100 * k >= 80 * (len(x.g) + len(y.g) - k) AND x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS id, a AS other FROM edge UNION SELECT reach.id, edge.b FROM reach JOIN edge ON edge.a = reach.other),
c AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT doc_id, len(g) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id IS NULL OR coalesce(component, doc_id) = doc_id AS kept FROM s LEFT JOIN c ON c.id = s.doc_id
"""


def vector_codes(rounds: int = 4) -> str:
    """Plain sums of squares over all entries, one CTE a step."""
    square = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"
    sql = """WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
part AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, range(4) t(p)),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS j, x AS c FROM part WHERE rid <= 256)"""
    for r in range(rounds + 1):
        sql += f""",
a{r} AS MATERIALIZED (SELECT rid, p, x, m % 256 AS j, m // 256 AS d FROM (SELECT rid, p, any_value(x) AS x, min({square} * 256 + j) AS m FROM part JOIN b{r} USING (p) GROUP BY rid, p))"""
        if r < rounds:
            sql += f""",
m{r} AS (SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT p, j, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, unnest(range(1, len(x) + 1)) t(i) GROUP BY p, j, i) GROUP BY p, j),
b{r + 1} AS MATERIALIZED (SELECT p, j, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (p, j))"""
    return (
        sql
        + f""",
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b{rounds}),
code AS (SELECT rid, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN code USING (rid), book
"""
    )
