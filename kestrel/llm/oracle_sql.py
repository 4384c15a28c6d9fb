"""DuckDB statements of the queries that SQL can express, written from the
definitions (whole gram tables, all pairs with a common shingle, sets of
reachable documents), not from the Spark plans."""

from __future__ import annotations

# CRC-32 of a text as a list reduction; the table is that of the reflected polynomial 0xEDB88320
_CRC = """
bits AS (SELECT x AS slot, x AS c, 0 AS step FROM range(256) t(x)),
steps AS (SELECT slot, c, step FROM bits UNION ALL
  SELECT slot, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM steps WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY slot) AS t FROM steps WHERE step = 8)"""


def _crc_of(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''),
  lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)"""


OP1 = f"""
WITH RECURSIVE {_CRC},
docs AS (SELECT doc_id, lang, {_crc_of('CAST(doc_id AS VARCHAR)')} % 4 = 2 AS held_out,
                ' ' || trim(regexp_replace(lower(COALESCE(text, '')), '[^\\p{{L}}]+', ' ', 'g')) || ' ' AS s
         FROM documents, crc_table),
chars AS (SELECT doc_id, UNNEST(string_split(s, '')) AS c, UNNEST(range(length(s))) AS i FROM docs WHERE s <> '  '),
runs AS (SELECT doc_id, c, LEAD(c, 1) OVER w AS c2, LEAD(c, 2) OVER w AS c3 FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
grams AS (SELECT doc_id, g, COUNT(*) AS n FROM (
  SELECT doc_id, c AS g FROM runs WHERE c <> ' '
  UNION ALL SELECT doc_id, c || c2 FROM runs WHERE c2 IS NOT NULL
  UNION ALL SELECT doc_id, c || c2 || c3 FROM runs WHERE c3 IS NOT NULL) x GROUP BY 1, 2),
own AS (SELECT * FROM (SELECT doc_id, g, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS r
                       FROM grams) x WHERE r < 400),
profile AS (SELECT * FROM (
  SELECT lang, g, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY SUM(n) DESC, length(g), g) - 1 AS r
  FROM grams JOIN docs USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g) x WHERE r < 400),
far AS (SELECT o.doc_id, l.lang, SUM(CASE WHEN p.r IS NULL THEN 400 ELSE abs(p.r - o.r) END) AS d, COUNT(*) AS m
        FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.g = o.g
        GROUP BY 1, 2),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY d, lang) AS k FROM far)
SELECT docs.doc_id, held_out, COALESCE(best.lang, 'und') AS lang_pred,
       COALESCE(1.0::DOUBLE - CAST(d AS DOUBLE) / CAST(400 * m AS DOUBLE), 0.0::DOUBLE) AS score
FROM docs LEFT JOIN best ON best.doc_id = docs.doc_id AND k = 1"""

OP2 = """
WITH p AS (SELECT page_id, url, COALESCE(html, '') AS body FROM pages),
d AS (SELECT page_id, url, strlen(body) AS payload_bytes, CAST(unhex(sha1(body)) AS BIT)::VARCHAR AS bits,
             MAX(page_id) OVER (PARTITION BY body) AS response FROM p),
e AS (SELECT *, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + 16 * CAST(bits[5 * k + 1] AS INTEGER) + 8 * CAST(bits[5 * k + 2] AS INTEGER) + 4 * CAST(bits[5 * k + 3] AS INTEGER)
          + 2 * CAST(bits[5 * k + 4] AS INTEGER) + CAST(bits[5 * k + 5] AS INTEGER), 1)), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to,
       '<urn:page:' || page_id || ':' || payload_digest || '>' AS record_id, url AS target_uri
FROM e"""

OP5 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(COALESCE(text, '')), '[\\p{L}\\p{N}]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS sh
      FROM w, UNNEST(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) r(i)),
size AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 10 * c >= 8 * (p.n + q.n - c)),
reach AS (SELECT DISTINCT x, x AS y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
class AS (SELECT x AS doc_id, MIN(y) AS class_id FROM reach GROUP BY 1),
n AS (SELECT x AS doc_id, COUNT(*) AS n_links FROM link GROUP BY 1)
SELECT d.doc_id, COALESCE(class_id, d.doc_id) AS class_id, COALESCE(n_links, 0) AS n_links
FROM documents d LEFT JOIN class USING (doc_id) LEFT JOIN n USING (doc_id)"""



def _mixed(n: int, k: str) -> str:
    """Probability under class k with contexts of n characters, from that with n - 1."""
    return f"""CASE WHEN b{n}.all_{k} > 0 THEN (t{n}.n_{k} + b{n}.kinds_{k} * p_{k}) / (b{n}.all_{k} + b{n}.kinds_{k}) ELSE p_{k} END"""


def _order(n: int) -> str:
    return f"""
t{n} AS (SELECT substr(g, 4 - {n}, {n} + 1) AS key, SUM(a) AS n_a, SUM(r) AS n_r FROM seen GROUP BY 1),
b{n} AS (SELECT substr(key, 1, {n}) AS ctx, SUM(n_a) AS all_a, SUM(n_r) AS all_r, COUNT(*) FILTER (WHERE n_a > 0) AS kinds_a,
                COUNT(*) FILTER (WHERE n_r > 0) AS kinds_r FROM t{n} GROUP BY 1),
m{n} AS (SELECT g, CAST({_mixed(n, 'a')} AS DOUBLE) AS p_a, CAST({_mixed(n, 'r')} AS DOUBLE) AS p_r
         FROM m{n - 1} JOIN t{n} ON t{n}.key = substr(g, 4 - {n}, {n} + 1) JOIN b{n} ON b{n}.ctx = substr(g, 4 - {n}, {n}))"""


# fixed values: the rules of the contract, the longest first
OP6 = f"""
WITH RECURSIVE {_CRC},
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS u FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(u, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, host || path AS text, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule FROM parts),
texts AS (SELECT text, rule, COUNT(*) AS n FROM ruled WHERE text <> '' GROUP BY 1, 2),
labelled AS (SELECT text, n, rule IN ('org/', 'com/fr/') AS ok, {_crc_of('text')} % 5 = 0 AS held_out FROM texts, crc_table),
grams AS (SELECT text, n, ok, held_out, substr(chr(2) || chr(2) || chr(2) || text || chr(3), i, 4) AS g
          FROM labelled, UNNEST(range(1, length(text) + 2)) r(i)),
seen AS (SELECT g, COALESCE(SUM(n) FILTER (WHERE ok AND NOT held_out), 0) AS a,
                COALESCE(SUM(n) FILTER (WHERE NOT ok AND NOT held_out), 0) AS r FROM grams GROUP BY 1),
single AS (SELECT substr(g, 4, 1) AS c, SUM(a) AS a, SUM(r) AS r FROM seen GROUP BY 1),
m0 AS (SELECT g, (single.a + 1.0::DOUBLE) / CAST(x.a + x.v + 1 AS DOUBLE) AS p_a, (single.r + 1.0::DOUBLE) / CAST(x.r + x.v + 1 AS DOUBLE) AS p_r
       FROM seen JOIN single ON single.c = substr(g, 4, 1), (SELECT SUM(a) AS a, SUM(r) AS r, COUNT(*) AS v FROM single) x),
{_order(1)},
{_order(2)},
{_order(3)},
score AS (SELECT text, round(SUM(ln(p_a) - ln(p_r)) / COUNT(*), 6) AS score FROM grams JOIN m3 USING (g) GROUP BY 1),
bands AS (SELECT CAST(floor(score / 0.01::DOUBLE) AS BIGINT) AS k, SUM(n) FILTER (WHERE ok) AS good, SUM(n) FILTER (WHERE NOT ok) AS bad
          FROM labelled JOIN score USING (text) WHERE held_out AND ok IS NOT NULL GROUP BY 1),
tried AS (SELECT v.k, (SELECT COALESCE(SUM(good), 0) FROM bands s WHERE s.k >= v.k) / CAST((SELECT SUM(good) FROM bands) AS DOUBLE)
              + (SELECT COALESCE(SUM(bad), 0) FROM bands s WHERE s.k < v.k) / CAST((SELECT SUM(bad) FROM bands) AS DOUBLE) AS share
          FROM (SELECT UNNEST(range((SELECT MIN(k) FROM bands), (SELECT MAX(k) FROM bands) + 2)) AS k) v),
cut AS (SELECT CASE WHEN (SELECT SUM(good) FROM bands) > 0 AND (SELECT SUM(bad) FROM bands) > 0
  THEN (SELECT k * 0.01::DOUBLE FROM tried ORDER BY round(share, 12) DESC, abs(k), k DESC LIMIT 1) ELSE 0.0::DOUBLE END AS threshold)
SELECT page_id, host, path, rule, COALESCE(score, 0.0::DOUBLE) AS score, threshold,
       CASE WHEN rule IS NOT NULL THEN CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' ELSE 'block' END
            WHEN COALESCE(score, 0.0) >= threshold OR ruled.text = '' THEN 'allow' ELSE 'block' END AS verdict
FROM ruled LEFT JOIN score ON score.text = ruled.text, cut"""

OP11 = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(SUM(size) AS DOUBLE) AS own, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(no - 1) % 3 + 1]::DOUBLE AS weight FROM s),
-- the water level: shared by weight among the sources that are not full, smallest room per weight first
o AS (SELECT *, 2.0::DOUBLE * own / weight AS room, ROW_NUMBER() OVER (ORDER BY 2.0::DOUBLE * own / weight, source NULLS LAST) AS k FROM w),
l AS (SELECT *, (1.5::DOUBLE * SUM(own) OVER () - 2.0::DOUBLE * (SUM(own) OVER (ORDER BY k) - own))
                / (SUM(weight) OVER () - (SUM(weight) OVER (ORDER BY k) - weight)) AS level FROM o),
f AS (SELECT MIN(k) AS k0 FROM l WHERE level <= room),
aim AS (SELECT no, source, own, CASE WHEN k < k0 THEN 2.0::DOUBLE * own
          ELSE LEAST((SELECT level FROM l WHERE k = k0) * weight, 2.0::DOUBLE * own) END AS target FROM l, f),
-- expected copies min(2, c * digits): one c per source
g AS (SELECT no, target, CAST(length(CAST(size AS VARCHAR)) AS DOUBLE) AS favour, CAST(SUM(size) AS DOUBLE) AS words
      FROM d JOIN aim ON d.source IS NOT DISTINCT FROM aim.source GROUP BY ALL),
c AS (SELECT *, (target - 2.0::DOUBLE * (SUM(words) OVER (PARTITION BY no ORDER BY favour DESC) - words))
                / NULLIF(SUM(favour * words) OVER (PARTITION BY no ORDER BY favour), 0.0) AS c FROM g),
e0 AS (SELECT *, MAX(CASE WHEN c * favour <= 2.0 THEN favour END) OVER (PARTITION BY no) AS top FROM c),
e1 AS (SELECT no, favour, words, target, CASE WHEN favour <= top
         THEN GREATEST(MAX(CASE WHEN favour = top THEN c END) OVER (PARTITION BY no) * favour, 0.0) ELSE 2.0 END::DOUBLE AS e FROM e0),
e AS (SELECT *, floor(e + 1e-12::DOUBLE) AS whole, target - SUM(floor(e + 1e-12::DOUBLE) * words) OVER (PARTITION BY no) AS rest FROM e1),
r AS (SELECT doc_id, size, own, e.target, e.no, whole, rest, e - whole AS p,
        (CAST('0x' || substr(md5('11:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN aim ON d.source IS NOT DISTINCT FROM aim.source
        JOIN e ON e.no = aim.no AND e.favour = length(CAST(size AS VARCHAR))),
q AS (SELECT *, CASE WHEN p > 1e-12 AND size > 0 THEN u / (1.0::DOUBLE - u) * ((1.0::DOUBLE - p) / p) END AS rank FROM r),
t AS (SELECT *, SUM(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END)
        OVER (PARTITION BY no ORDER BY rank NULLS FIRST, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM q)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(own AS BIGINT) AS source_size, target, CAST(size * whole
         + CASE WHEN rank IS NULL THEN 0 ELSE GREATEST(0, LEAST(floor(rest + 1e-6::DOUBLE) - upto + size, size)) END AS BIGINT) AS taken
FROM t"""

OP13 = f"""
WITH RECURSIVE {_CRC},
found AS (SELECT doc_id, UNNEST(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
per AS (SELECT doc_id, w, COUNT(*) AS n, hex(encode(CAST(doc_id AS VARCHAR) || ':' || w)) AS x FROM found WHERE length(w) >= 5 GROUP BY ALL),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2),
             lambda k: CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS h
           FROM per, crc_table),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(SUM(n) AS BIGINT) AS n
          FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND SUM(n) >= 3),
less AS (SELECT DISTINCT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS v FROM (SELECT word, n, UNNEST(range(length(word))) AS k FROM words) x),
-- replaced: equal without the letter at one place; inserted or deleted: one is the other without a letter
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.k = b.k AND a.v = b.v AND a.word <> b.word AND length(a.word) = length(b.word)
         UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.v = b.word
         UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.v = b.word),
best AS (SELECT *, COUNT(*) OVER (PARTITION BY word) AS n_near, ROW_NUMBER() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM near),
own AS (SELECT w.word, w.n, COALESCE(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
        FROM words w LEFT JOIN best b ON b.word = w.word AND k = 1),
chain AS (SELECT word, word AS top FROM own UNION ALL SELECT chain.word, form FROM chain JOIN own ON own.word = chain.top WHERE form IS NOT NULL),
root AS (SELECT chain.word, top FROM chain JOIN own ON own.word = chain.top WHERE form IS NULL)
SELECT own.word, form, root.top AS root, n, n_near, form_n FROM own JOIN root ON root.word = own.word"""


ORACLE = {"op1_language_id": OP1, "op2_warc": OP2, "op5_jaccard_join": OP5, "op6_url_filter": OP6, "op11_source_mix": OP11, "op13_spelling_variants": OP13}
