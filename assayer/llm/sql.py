"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from assayer.llm import centroids, mixing, pii
from assayer.llm import quality_rules as rules


def quality_rules() -> str:
    lists = {**rules.COMMON_WORDS, rules.OTHER: rules.OTHER_WORDS}
    common = ", ".join(f"('{k}', {i}, '{w}')" for k, ws in lists.items() for i, w in enumerate(ws))
    known = ", ".join(f"'{k}'" for k in rules.COMMON_WORDS)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({known}) THEN lang ELSE '{rules.OTHER}' END AS r FROM documents),
w AS (SELECT rid, r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
word AS (SELECT rid, r, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM w),
win AS (SELECT rid, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS t FROM word WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM win WHERE t IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(3) AS s(k) GROUP BY rid),
line AS (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (
  SELECT d.rid, doc_id, d.r, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         length(text) - length(regexp_replace(text, '\p{{Ll}}+', '', 'g')) AS c2, length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')) AS c3, length(text) - length(regexp_replace(text, '[0-9]+', '', 'g')) AS c4, length(text) AS total
  FROM d JOIN w ON d.rid = w.rid LEFT JOIN dup ON d.rid = dup.rid LEFT JOIN rep ON d.rid = rep.rid),
common(r, i, x) AS (VALUES {common}),
hit AS (SELECT word.rid, c.i, count(*) AS n FROM word JOIN common c ON c.r = word.r AND c.x = regexp_replace(lower(word.x), '{rules.POINTS}', '', 'g') GROUP BY ALL),
hist AS (
  SELECT rid, r, n_words, n_repeat_words, 'c' AS kind, unnest([0, 1, 2, 3, 4, 5]) AS i, unnest([total - word_chars, n_symbols, c2, c3, c4, word_chars - n_symbols - c2 - c3 - c4]) AS n FROM base
  UNION ALL SELECT b.rid, b.r, n_words, n_repeat_words, 'w', c.i, coalesce(h.n, 0) FROM base b JOIN common c ON c.r = b.r LEFT JOIN hit h ON h.rid = b.rid AND h.i = c.i
  UNION ALL SELECT b.rid, r, n_words, n_repeat_words, 'w', 99, n_words - coalesce(h.n, 0) FROM base b LEFT JOIN (SELECT rid, sum(n) AS n FROM hit GROUP BY rid) h ON h.rid = b.rid),
ref AS (SELECT r, kind, i, sum(n) AS n FROM hist WHERE n_words >= {rules.MIN_WORDS} AND n_repeat_words * 100 <= n_words * 50 GROUP BY ALL),
share AS (
  SELECT rid, kind, p.n::DOUBLE / nullif(sum(p.n) OVER (PARTITION BY rid, kind), 0) AS p, q.n::DOUBLE / nullif(sum(q.n) OVER (PARTITION BY rid, kind), 0) AS q
  FROM hist p LEFT JOIN ref q USING (r, kind, i)),
js AS (SELECT rid, kind, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(p * 2 / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q * 2 / (p + q)) ELSE 0 END) / 2), 0)) AS x, count(p) AND count(q) AS ok FROM share GROUP BY rid, kind),
both_js AS (SELECT rid, max(CASE WHEN kind = 'c' AND ok THEN x END) AS char_distance, max(CASE WHEN kind = 'w' AND ok THEN x END) AS word_distance FROM js GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {rules.MIN_WORDS} OR n_repeat_words * 100 > n_words * 50 AS base_failed,
       NOT (n_words < {rules.MIN_WORDS} OR n_repeat_words * 100 > n_words * 50) AND NOT (n_words >= {rules.MIN_WORDS_COMPARED} AND (
         coalesce(char_distance, 0) > {rules.MAX_CHAR} + {rules.CHAR_NOISE} / sqrt(greatest(n_words, 1)) OR coalesce(word_distance, 0) > {rules.MAX_WORD} + {rules.WORD_NOISE} / sqrt(greatest(n_words, 1)))) AS kept,
       round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
FROM base LEFT JOIN both_js USING (rid)
"""


def pii_spans() -> str:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|(\x20[A-Z0-9]{4}){2,7}(\x20[A-Z0-9]{1,3})?)\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    added = ", ".join(f"'{k.name}'" for k in pii.KINDS if not k.base)
    context = " ".join(f"WHEN '{k.name}' THEN regexp_matches(near, '{k.context}')" for k in pii.KINDS)
    trust = " ".join(f"WHEN '{k.name}' THEN {round((k.score + k.checksum) * 100)}" for k in pii.KINDS)
    gain, least = round(pii.CONTEXT_GAIN * 100), round(pii.MIN_SCORE * 100)
    # each pattern stands as a constant of its own: the engine compiles constants once
    found = " UNION ALL ".join(
        f"SELECT rid, {i} AS k, '{k}' AS kind, regexp_extract_all(text, '{p}') AS ms, regexp_split_to_array(text, '{p}') AS bs FROM d" for i, (k, p) in enumerate(patterns.items())
    )
    letters = " ".join(f"WHEN '{c}' THEN '{v}'" for c, v in pii.LETTER_VALUES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
m AS (SELECT rid, k, kind, unnest(ms) AS m, unnest(bs[1:len(ms)]) AS b, unnest(range(len(ms))) AS i FROM f WHERE len(ms) > 0),
p AS (SELECT rid, k, kind, m, (sum(length(b) + length(m)) OVER (PARTITION BY rid, k ORDER BY i))::BIGINT AS e, regexp_replace(m, '[^0-9]+', '', 'g') AS digits, replace(m, ' ', '') AS compact FROM m),
n AS (SELECT p.*, substr(text, greatest(e - length(m) - {pii.CONTEXT_CHARS}, 0) + 1, least({pii.CONTEXT_CHARS}, e - length(m))) || ' ' || substr(text, e + 1, {pii.CONTEXT_CHARS}) AS near FROM p JOIN d USING (rid)),
v AS (
  SELECT *, CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_max([CAST(x AS HUGEINT) FOR x IN string_split(CASE WHEN kind = 'ip' THEN m ELSE '0' END, '.')]) <= 255
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum([CASE WHEN i % 2 = 0 THEN CASE WHEN x > 4 THEN x * 2 - 9 ELSE x * 2 END ELSE x END FOR x, i IN [CAST(y AS INT) FOR y IN string_split(reverse(digits), '') IF y <> '']]) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'ssn' THEN NOT regexp_matches(m, '^(000|666|9..)|-00-|-0000$')
    ELSE length(compact) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, [CAST(z AS BIGINT) FOR z IN string_split(array_to_string([CASE c {letters} ELSE c END FOR c IN string_split(compact[5:] || compact[:4], '')], ''), '') IF z <> '']), lambda a, z: (a * 10 + z) % 97) = 1
    END AS ok, least(CASE kind {trust} END + CASE WHEN CASE kind {context} END THEN {gain} ELSE 0 END, 100) AS score
  FROM n),
s AS (SELECT rid, k, kind, e - length(m) AS st, kind || ':' || (e - length(m)) || ':' || e AS one, score FROM v WHERE ok AND (kind NOT IN ({added}) OR score >= {least})),
g AS (
  SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(one, ',' ORDER BY k, st) FILTER (kind NOT IN ({added})) AS base, string_agg(one, ',' ORDER BY k, st) AS spans, string_agg(score, ',' ORDER BY k, st) AS scores
  FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores, spans IS NOT NULL AS has_pii
FROM d LEFT JOIN g USING (rid)
"""


def poisson_mixing() -> str:
    number = lambda text: f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / {float(1 << 52)!r})"
    return f"""
WITH c AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {mixing.POWER}) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (sum(w) OVER ()) * (sum(n) OVER ()) / n AS rate FROM c),
k AS (SELECT source, rate, unnest(range(CAST(ceil(rate + sqrt(rate) * 10 + 30) AS BIGINT) + 1)) AS k FROM r),
cdf AS (SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p FROM k),
u AS (SELECT *, {number(f"coalesce(doc_id::VARCHAR, '') || ':{mixing.SEED}'")} AS u FROM documents),
n AS (SELECT u.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source AND cdf.p < u.u) AS n FROM u),
e AS (SELECT *, unnest(range(1, n + 1)) AS copy FROM n)
SELECT doc_id, text, lang, source, n_chars, copy, {number(f"coalesce(doc_id::VARCHAR, '') || ':' || copy || ':{mixing.SEED + 1}'")} AS shuffle_key FROM e
"""


def weighted_centroids() -> str:
    """Rounds unrolled, on rows instead of distinct vectors."""
    dim, k, scale, bound = centroids.DIM, centroids.CENTROIDS, centroids.SCALE, float(centroids.BOUND)
    ranked = lambda r: f"""
d{r} AS MATERIALIZED (
  SELECT rid, vec_id, q, cluster, distance FROM (
    SELECT v.rid, v.vec_id, v.q, c.c AS cluster, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.q, c.q)])::BIGINT AS distance,
      row_number() OVER (PARTITION BY v.rid ORDER BY distance, c.c) AS place FROM v, c{r} c) WHERE place = 1)"""  # noqa: E731
    moved = lambda r: f"""
s{r} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range({dim})) AS i FROM d{r - 1}) GROUP BY ALL),
m{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM s{r} GROUP BY cluster),
c{r} AS MATERIALIZED (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{r - 1} c LEFT JOIN m{r} m ON m.cluster = c.c)"""  # noqa: E731
    last = centroids.ROUNDS
    return f"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, [x::DOUBLE * {scale} FOR x IN embedding] AS x FROM embeddings WHERE len(embedding) = {dim}),
v AS MATERIALIZED (SELECT rid, vec_id, [floor(y)::BIGINT FOR y IN x] AS q FROM e WHERE len([1 FOR y IN x IF NOT isnan(y) AND abs(y) < {bound!r}]) = {dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT q, sha256('{centroids.SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v ORDER BY h, q LIMIT {k})),
{", ".join(ranked(r) if step == 0 else moved(r + 1) for r in range(last + 1) for step in ((0, 1) if r < last else (0,)))}
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM d{last} JOIN c{last} c ON c.c = cluster
"""


def impact_search(k: int = 10) -> str:
    terms = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    lower = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    of = lambda t: terms.format(t=lower.format(t=t))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {of("text")} AS ts FROM documents WHERE text IS NOT NULL),
dn AS (SELECT rid, doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
size AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM dn),
tf AS (SELECT rid, t, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ts) AS t FROM d) GROUP BY ALL),
i AS (SELECT iid, item_id, t, count(*)::BIGINT AS times FROM (SELECT row_number() OVER () AS iid, item_id, unnest({of("text")}) AS t FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY t, n_docs),
s AS (
  SELECT iid, item_id, doc_id, tf.rid, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN tf USING (t) JOIN w USING (t) JOIN dn ON dn.rid = tf.rid, size GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= {k}
"""
