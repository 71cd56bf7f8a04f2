"""DuckDB SQL of the operators that SQL can express, over the raw tables.

The others train a model (2, 10), search a graph (3), parse markup and vote (6), tokenise and pack
(8), classify (1) or chunk by hashes (7); tests hold those against brute force, round trips and
held-out labels.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = f"translate(coalesce(text,''),'{_UPPER}','{_LOWER}')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

MIXING = r"""
WITH sized AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [3,1,2][(row_number() OVER (ORDER BY source NULLS LAST)-1)%3+1] AS weight FROM per),
fills AS (SELECT *, 150*(sum(source_size) OVER ()) - 200*coalesce(sum(source_size) OVER (ORDER BY source_size/weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS left_over,
  sum(weight) OVER (ORDER BY source_size/weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM ranked),
judged AS (SELECT *, left_over*weight >= 200*source_size*rest AS is_full FROM fills),
level AS (SELECT left_over, rest FROM judged WHERE NOT is_full ORDER BY source_size/weight, source NULLS LAST LIMIT 1),
targets AS (SELECT j.source, j.source_size, CASE WHEN is_full THEN CAST(2*source_size AS DOUBLE) ELSE CAST(l.left_over*weight AS DOUBLE)/CAST(100*l.rest AS DOUBLE) END AS target FROM judged j LEFT JOIN level l ON true),
rated AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, CASE WHEN t.source_size>0 THEN t.target/t.source_size ELSE 0.0::DOUBLE END AS rate, coalesce(CAST(s.doc_id AS VARCHAR), md5(s.text), '') AS key
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
drawn AS (SELECT *, CAST(CAST('0x'||substr(md5('20240229:'||CAST(k//4 AS VARCHAR)||':'||key),k%4*8+1,8) AS BIGINT) AS DOUBLE)/4294967296.0::DOUBLE < rate-floor(rate) AS extra FROM rated, (SELECT unnest(range(16)) AS k) ks),
missed AS (SELECT source, k, abs(floor(any_value(rate))*any_value(source_size)+sum(CASE WHEN extra THEN size ELSE 0 END)-any_value(target)) AS miss FROM drawn GROUP BY source, k),
best AS (SELECT source, k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY miss, k) AS place FROM missed) x WHERE place=1)
SELECT doc_id, size, source_size, target, CAST(size*(floor(rate)+CAST(extra AS INT)) AS BIGINT) AS taken FROM drawn d JOIN best b ON d.source IS NOT DISTINCT FROM b.source AND d.k=b.k
"""

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w)>=3 THEN list_transform(range(1, len(w)-1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2]) WHEN len(w)>0 THEN [array_to_string(w,' ')] ELSE [] END) AS s FROM w) x),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s=b.s AND a.doc_id<b.doc_id GROUP BY 1,2),
links AS (SELECT x, y FROM shared JOIN n nx ON nx.doc_id=x JOIN n ny ON ny.doc_id=y WHERE 100*c >= 90*(nx.n+ny.n-c)),
edges AS (SELECT x AS u, y AS v FROM links UNION SELECT y, x FROM links),
reach AS (SELECT u, u AS v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v=e.u),
least AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n,0) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least ON u=d.doc_id
"""

DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, {_ALNUM} AS w FROM documents), bw AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
keys AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i+m-1],' ') AS k FROM (SELECT item_id, w, least(10,len(w)) AS m, unnest(range(1,len(w)-least(10,len(w))+2)) AS i FROM bw WHERE len(w)>0) x),
sizes AS (SELECT DISTINCT m FROM keys),
places AS (SELECT doc_id, m, p, array_to_string(w[p:p+m-1],' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1,len(w)-m+2)) AS p FROM dw, sizes WHERE len(w)>=m) x),
hits AS (SELECT doc_id, item_id, m, p FROM places JOIN keys USING (m, k)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p,p+m)) AS q FROM hits) x GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) x GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(n_items,0) AS n_items, sha256(coalesce(ids,'')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
