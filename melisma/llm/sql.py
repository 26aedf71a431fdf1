"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP1 = """
WITH RECURSIVE
shards AS (SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range(16) r(i)),
walks AS (
    SELECT i, ('0x' || substr(md5(name || ':offset'), 1, 12))::BIGINT % 2039 AS start_at,
           ('0x' || substr(md5(name || ':skip'), 1, 12))::BIGINT % 2038 + 1 AS skip
    FROM shards),
lists AS (SELECT list((SELECT list((start_at + j * skip) % 2039 ORDER BY j) FROM range(2039) t(j)) ORDER BY i) AS pref FROM walks),
fill(step, slot, taken) AS (
    SELECT 0, NULL::BIGINT, [false FOR x IN range(2039)]
    UNION ALL
    SELECT step + 1, pick, list_transform(taken, lambda v, k: v OR k = pick + 1)
    FROM (SELECT step, taken, list_filter(pref[step % 16 + 1], lambda s: NOT taken[s + 1])[1] AS pick FROM fill, lists WHERE step < 2039)
),
held AS (SELECT slot, 'shard-' || lpad(((step - 1) % 16)::VARCHAR, 2, '0') AS shard FROM fill WHERE step > 0),
placed AS (
    SELECT doc_id, ('0x' || substr(md5(CASE WHEN doc_id IS NULL THEN 'n' ELSE 'v' || doc_id::VARCHAR END), 1, 12))::BIGINT % 2039 AS slot
    FROM documents)
SELECT doc_id, slot, shard FROM placed JOIN held USING (slot)
"""

OP4 = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, t, CASE WHEN t = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(t)),
marked AS (
    SELECT *, lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 AS starts,
           length(replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2')) AS n_text,
           length(replace(replace(replace(replace(role, '\', '\0'), '###', '\1'), '</turn>', '\2'), chr(10), '\3')) AS n_role
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(n_text + 7 + CASE WHEN starts THEN n_role + 5 ELSE 0 END) + count(*) FILTER (WHERE starts) - 1)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP8 = r"""
WITH parsed AS (
    SELECT page_id, url, contains(coalesce(url, ''), '://') AS ok, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
pages2 AS (
    SELECT page_id, url, CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
           CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
           try_cast(regexp_extract(url, '/(\d{1,18})', 1) AS BIGINT) AS doc_id
    FROM parsed),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
    SELECT page_id, url, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
    FROM pages2, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
outcome AS (SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
hosts0 AS (
    SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k FROM pages2 LEFT JOIN outcome USING (doc_id) GROUP BY host),
hosts AS (
    SELECT *, split_part(host, '.', -1) AS suffix,
           CASE WHEN contains(host, '.') THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS domain FROM hosts0),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM domains GROUP BY ALL),
levels AS (
    SELECT 'host' AS level, n::DOUBLE AS n, k::DOUBLE AS k FROM hosts WHERE n > 0
    UNION ALL SELECT 'domain', n, k FROM domains WHERE n > 0
    UNION ALL SELECT 'suffix', n, k FROM suffixes WHERE n > 0),
sums AS (SELECT level, sum(n) AS t, count(*)::DOUBLE AS m, sum(n * n) AS nn, sum(k) AS kt, sum(k * k / n) AS kk FROM levels GROUP BY level),
parts AS (
    SELECT level, m, t, (kk - kt * kt / t) / nullif(m - 1, 0) AS msb, (kt - kk) / nullif(t - m, 0) AS msw, (t - nn / t) / nullif(m - 1, 0) AS n0 FROM sums),
rhos AS (SELECT level, m, t, (msb - msw) / nullif(msb + (n0 - 1) * msw, 0) AS rho FROM parts),
strengths AS (
    SELECT level, greatest(1.0::DOUBLE, least(1000.0::DOUBLE, coalesce(
        CASE WHEN m > 1 AND t > m THEN CASE WHEN rho > 0 THEN (1 - rho) / nullif(rho, 0) ELSE 1000.0 END ELSE 1.0 END, 1.0)))::DOUBLE AS s
    FROM rhos),
strength AS (
    SELECT coalesce(max(s) FILTER (WHERE level = 'suffix'), 1.0)::DOUBLE AS s_suffix, coalesce(max(s) FILTER (WHERE level = 'domain'), 1.0)::DOUBLE AS s_domain,
           coalesce(max(s) FILTER (WHERE level = 'host'), 1.0)::DOUBLE AS s_host,
           (SELECT coalesce(sum(k)::DOUBLE / nullif(sum(n), 0), 0) FROM suffixes) AS top FROM strengths),
up AS (SELECT suffix, (k + s_suffix * top) / (n + s_suffix) AS r FROM suffixes, strength),
mid AS (SELECT domain, d.suffix, (k + s_domain * r) / (n + s_domain) AS r FROM domains d JOIN up USING (suffix), strength),
low AS (
    SELECT host, n, k, k + s_host * r AS a, n - k + s_host * (1 - r) AS b FROM hosts h JOIN mid USING (domain, suffix), strength),
judged AS (SELECT host, n, k, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM low)
SELECT page_id, host, path, fit.rule, coalesce(fit.verdict, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, n AS host_n, k AS host_bad
FROM pages2 JOIN judged USING (host) LEFT JOIN fit USING (page_id, url)
"""

OP9 = rf"""
WITH sized AS (
    SELECT doc_id, source, {_WORDS}::BIGINT AS size, md5(CASE WHEN doc_id IS NULL THEN 'n' ELSE 'v' || doc_id::VARCHAR END || ':' || md5(coalesce(text, ''))) AS who FROM documents),
total AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (3.0 * source_size)::DOUBLE AS cap FROM total),
lot AS (
    SELECT *, (sum(source_size) OVER ())::DOUBLE AS all_size, sum(weight) OVER () AS all_weight,
           coalesce(sum(cap) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before
    FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap <= (all_size - cap_before) / (all_weight - weight_before) * weight AS at_cap FROM lot),
targets AS (
    SELECT source, source_size, CASE WHEN at_cap THEN cap ELSE
        (all_size - sum(CASE WHEN at_cap THEN cap ELSE 0 END) OVER ()) * weight / sum(CASE WHEN at_cap THEN 0 ELSE weight END) OVER () END AS target
    FROM capped),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0 END AS rate FROM targets),
hits AS (
    SELECT sized.source, doc_id, size, number, source_size, target, rate,
           ('0x' || substr(md5('mix-1:' || number::VARCHAR || ':' || who), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) AS hit
    FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source, range(64) n(number)),
sums AS (SELECT source, number, sum(CASE WHEN hit THEN size ELSE 0 END) AS extra FROM hits GROUP BY ALL),
picks AS (
    SELECT source, number FROM sums JOIN rated USING (source)
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(floor(rate) * source_size + extra - target), number) = 1)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN hit THEN 1 ELSE 0 END))::BIGINT AS taken FROM hits JOIN picks USING (source, number)
"""

OP11 = r"""
WITH
pieces AS (
    SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
phrases AS (
    SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
    FROM listed, range(1, 4) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (
    SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first_part, array_to_string(w[cut + 1:], ' ') AS rest
    FROM candidates, range(1, 3) t(cut) WHERE cut < k),
scored AS (
    SELECT c.lang, c.k, c.phrase, c.a, x.f AS l, y.f AS r, c.cut, (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN f x ON c.lang = x.lang AND c.first_part = x.phrase JOIN f y ON c.lang = y.lang AND c.rest = y.phrase),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM candidates WHERE k = 3),
covered AS (SELECT lang, phrase, max(a) AS most FROM longer GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN covered c ON b.lang = c.lang AND b.phrase = c.phrase WHERE c.most IS NULL OR 100 * c.most < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""

OP13 = r"""
WITH
bytes(b, c) AS (SELECT i, i FROM range(256) t(i)),
texts AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
goals AS (
    SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
spread AS (SELECT r, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS feature FROM texts, range(1, 4) t(k)),
goal_spread AS (SELECT unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS feature FROM goals, range(1, 4) t(k)),
table256 AS (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384::UBIGINT)) AS v FROM range(256) x(i))),
named AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT feature FROM spread UNION SELECT feature FROM goal_spread)),
crc AS (
    SELECT feature, xor(list_reduce(list_prepend(4294967295::UBIGINT, [('0x' || h[j:j + 1])::UBIGINT FOR j IN range(1, len(h), 2)]), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 10000 AS bucket
    FROM named, table256),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM spread JOIN crc USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM goal_spread JOIN crc USING (feature) GROUP BY bucket),
sums AS (SELECT (SELECT count(*)::DOUBLE FROM spread) AS ss, (SELECT count(*)::DOUBLE FROM goal_spread) AS tt),
gain AS (
    SELECT b.bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((coalesce(s, 0) + 1) * (tt + 10000))))::BIGINT AS gain
    FROM range(10000) b(bucket) LEFT JOIN s ON b.bucket = s.bucket LEFT JOIN t ON b.bucket = t.bucket, sums),
weights AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM spread JOIN crc USING (feature) JOIN gain USING (bucket) GROUP BY r),
scored AS (
    SELECT x.r, doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)
           + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score,
           coalesce(weight, 0) AS weight
    FROM texts x LEFT JOIN weights y ON x.r = y.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS place, 5 * count(*) FILTER (WHERE fit) OVER () // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= drawn THEN place END AS rank FROM ranked
"""

ORACLES = {"op1_sharding": OP1, "op4_chat_formatting": OP4, "op8_url_filters": OP8, "op9_source_mix": OP9, "op11_phrase_mining": OP11, "op13_importance_resampling": OP13}
