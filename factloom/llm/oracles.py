"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MINHASH = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS t FROM d),
x AS (SELECT doc_id, unnest(t) AS v FROM s), n AS (SELECT doc_id, len(t) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS i FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT n.doc_id, n.n AS n_shingles, MIN(r.c) AS component_id, n.doc_id = MIN(r.c) AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n"""

SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, unnest(h) AS h, generate_subscripts(h, 1) AS i FROM (SELECT doc_id, list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i+49], ' '))) AS h FROM d WHERE len(w) >= 50)),
m AS (SELECT h, MIN(doc_id) AS lo FROM k GROUP BY h),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM k JOIN m USING (h), range(0, 50) r(j) WHERE doc_id > lo),
g AS (SELECT doc_id, list(p) AS gone, COUNT(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, COALESCE(n, 0) AS n_removed, sha256(array_to_string(list_filter(w, lambda x, i: NOT COALESCE(list_contains(gone, i), FALSE)), ' ')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""


def _uniform(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


MIXING = f"""WITH d AS (SELECT doc_id, source, COALESCE(source, chr(0)) AS key, len({WORDS.format("coalesce(text, '')")}) AS size FROM documents),
s AS (SELECT source, key, SUM(size)::BIGINT AS source_size, COUNT(*) AS rows FROM d GROUP BY source, key),
b AS (SELECT CAST(pow(2, greatest(0, ceil(log2(greatest(1.0, sqrt(MAX(rows)) / 8))))) AS BIGINT) AS blocks FROM s),
w AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[(ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * SUM(source_size) OVER () - COALESCE(SUM(cap) OVER q, 0)) / (SUM(w) OVER () - COALESCE(SUM(w) OVER q, 0)) AS level FROM w WINDOW q AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, key, source_size, LEAST(cap, MAX(level) OVER () * w) AS target, {_uniform("'mix:offset:' || key")} AS u FROM l),
p AS (SELECT d.*, CAST(floor({_uniform("'mix:' || COALESCE(doc_id::VARCHAR, md5(text), '')")} * blocks) AS BIGINT) AS block FROM d, b),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY block, CASE WHEN block % 2 = 0 THEN size ELSE -size END, doc_id) AS r FROM p),
c AS (SELECT r.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM r JOIN t USING (key))
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate * r + u) - floor(rate * (r - 1) + u)) AS BIGINT) AS taken, source, CAST(floor(rate * r + u) - floor(rate * (r - 1) + u) AS BIGINT) AS copies FROM c"""


def _strength(level: str, prior: str) -> str:
    return f"""(SELECT 1 / LEAST(0.5, GREATEST(1 / 1001.0::DOUBLE, COALESCE((SUM(pow(x - n * {prior}, 2) / (n * {prior} * (1 - {prior}))) - COUNT(*)) / NULLIF(SUM(n - 1), 0), 0))) - 1 FROM {level} WHERE n > 0)"""


URLS = f"""WITH o AS (SELECT doc_id AS page_id, MAX(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
h AS (SELECT host, COALESCE(SUM(bad), 0)::BIGINT AS x, COUNT(bad) AS n FROM u LEFT JOIN o USING (page_id) GROUP BY host),
h2 AS (SELECT *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS p FROM h),
h3 AS (SELECT host, x, n, CASE WHEN len(p) >= 2 THEN p[-2] || '.' || p[-1] ELSE host END AS domain, p[-1] AS suffix FROM h2),
g AS (SELECT (COALESCE(SUM(x), 0) + 2.0::DOUBLE) / (COALESCE(SUM(n), 0) + 20) AS top FROM h),
s1 AS (SELECT suffix, SUM(x) AS x, SUM(n) AS n FROM h3 GROUP BY 1), s2 AS (SELECT s1.*, top FROM s1, g),
s AS (SELECT suffix, (m * top + x) / (m + n) AS ps FROM s2, (SELECT {_strength('s2', 'top')} AS m)),
d1 AS (SELECT suffix, domain, SUM(x) AS x, SUM(n) AS n FROM h3 GROUP BY 1, 2), d2 AS (SELECT d1.*, ps FROM d1 JOIN s USING (suffix)),
d AS (SELECT suffix, domain, (m * ps + x) / (m + n) AS pd FROM d2, (SELECT {_strength('d2', 'ps')} AS m)),
f AS (SELECT host, x, n, pd FROM h3 JOIN d USING (suffix, domain)),
v AS (SELECT host, (m * pd + x) / (m + n) AS mean, m + n + 1 AS k FROM f, (SELECT {_strength('f', 'pd')} AS m)),
b AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / k) AS bound FROM v),
j AS (SELECT u.*, bound, CASE WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
 WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/' WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
 WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/' WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule FROM u JOIN b USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.3 THEN 'block' ELSE 'allow' END AS verdict FROM j"""

ORACLES = {"op1_minhash": MINHASH, "op3_substrings": SUBSTRINGS, "op4_urls": URLS, "op9_mixing": MIXING}
