"""DuckDB SQL of those queries that SQL can express."""

from .license_rules import MOST_WORDS, RULES, WEIGHTS
from .license_scan import BASE, BLOCK_WORDS

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
  either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(node, other) AS (SELECT a, a FROM either UNION SELECT node, b FROM reach JOIN either ON a = other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(other) FROM reach WHERE node = d.doc_id), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)"""

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce({}, '')") + ", '[^\\x{{00}}-\\x{{2F}}\\x{{3A}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+')"

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
  b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
  windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
  lengths AS (SELECT DISTINCT size FROM windows),
  places AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS s FROM d, lengths WHERE len(w) >= size),
  found AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, s)),
  hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
  f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha256(p.h) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.h = p.h AND n >= 100"""

_NUMBER = "(CAST('0x' || substr(h, {}, 4) AS BIGINT) % {})"
URL_LISTS = f"""WITH u AS (
    SELECT page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS day,
      regexp_replace(lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')), '(:\\d*)?$|\\.(:\\d*)?$', '') AS host,
      regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
  listed AS (SELECT DISTINCT key, md5(key) AS h FROM (
    SELECT unnest([host, regexp_extract(host, '[^.]+\\.[^.]+$'), CASE WHEN regexp_extract(path, '^/([^/]+)', 1) <> '' THEN host || '/' || regexp_extract(path, '^/([^/]+)', 1) END]) AS key FROM u WHERE host <> '') WHERE key <> ''),
  dated AS (SELECT key, CASE WHEN {_NUMBER.format(5, 4)} = 0 THEN 'allow' ELSE 'block' END AS list, DATE '2024-01-01' + CAST({_NUMBER.format(9, 200)} AS INT) AS added, {_NUMBER.format(13, 3)} AS fate,
      CAST({_NUMBER.format(17, 100)} + 1 AS INT) AS after, CAST({_NUMBER.format(21, 60)} + 1 AS INT) AS again FROM listed WHERE {_NUMBER.format(1, 3)} = 0),
  events AS (SELECT list, key, true AS holds, added AS day FROM dated UNION ALL SELECT list, key, false, added + after FROM dated WHERE fate >= 1 UNION ALL SELECT list, key, true, added + after + again FROM dated WHERE fate = 2),
  daily AS (SELECT list, key, day, bool_or(holds) AS holds FROM events GROUP BY ALL),
  keyed AS (
    SELECT page_id, day, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS key FROM u WHERE host <> ''
    UNION SELECT page_id, day, unnest(list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/'))) FROM (SELECT *, list_filter(string_split(path, '/'), lambda p: p <> '') AS parts FROM u WHERE host <> '')),
  held AS (SELECT page_id, list, key FROM (
    SELECT k.page_id, d.list, d.key, arg_max(d.holds, d.day) AS holds FROM keyed k JOIN daily d ON d.key = k.key AND d.day <= k.day GROUP BY ALL) WHERE holds),
  summed AS (SELECT page_id, bool_or(list = 'block') AS block, bool_or(list = 'allow') AS allowed, count(*) AS n, string_agg(list || ':' || key, ',' ORDER BY list || ':' || key) AS entries FROM held GROUP BY page_id)
SELECT u.page_id, host, CAST(day AS VARCHAR) AS day, coalesce(block AND NOT allowed, false) AS blocked, coalesce(allowed, false) AS allowed, coalesce(n, 0) AS n_entries, coalesce(entries, '') AS entries
FROM u LEFT JOIN summed USING (page_id)"""

# CRC-32 from its table of 256 entries, over the bytes of a string in hex.
_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
SPELLING = f"""WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: {_BIT}) AS c FROM range(256) r(i))),
  runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
  counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= 6 GROUP BY ALL),
  hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]))) AS h FROM counted, crc_table),
  slipped AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
  words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
  without AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
  longer AS (SELECT DISTINCT a.word AS a, b.word AS b FROM without a JOIN words b ON a.k = b.word),
  near AS (SELECT a.word AS a, b.word AS b FROM without a JOIN without b ON a.i = b.i AND a.k = b.k AND a.word <> b.word UNION ALL SELECT a, b FROM longer UNION ALL SELECT b, a FROM longer),
  best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS b, max(n) AS m FROM near JOIN words ON word = b GROUP BY a),
  forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN b END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
  chain AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL"""

# Of a detection's tier or a stronger one, and around it; of equal ones the first rule.
_INSIDE = "e.tier <= d.tier AND e.start <= d.start AND e.stop >= d.stop AND (e.start < d.start OR e.stop > d.stop OR e.tier < d.tier OR e.rule < d.rule)"
_SPACES = "(length({0}) - length(replace({0}, ' ', '')))"
_NORMAL = "trim(regexp_replace(" + _LOWER.format("coalesce(text, '')") + ", '[\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+', ' ', 'g'), ' ')"
_RULE_ROWS = ", ".join("({}, {}, {}, {}, {}, {})".format(r.number, *("'" + x.replace("'", "''") + "'" for x in (r.label, r.keyword, r.pattern)), r.tier, WEIGHTS[r.tier]) for r in RULES)
LICENSES = f"""WITH rules(rule, label, keyword, pattern, tier, weight) AS (VALUES {_RULE_ROWS}),
  base(phrase, label) AS (VALUES {", ".join(f"('{p}', '{label}')" for p, label in BASE.items())}),
  norm AS (SELECT doc_id, x, CASE WHEN x = '' THEN [] ELSE string_split(x, ' ') END AS w FROM (SELECT doc_id, {_NORMAL} AS x FROM documents)),
  blocks AS (SELECT doc_id, a, ' ' || array_to_string(w[a + 1:a + {BLOCK_WORDS + MOST_WORDS}], '  ') || ' ' AS t FROM (SELECT *, unnest(range(0, len(w), {BLOCK_WORDS})) AS a FROM norm)),
  matched AS (SELECT doc_id, a, rule, label, tier, weight, string_split_regex(t, pattern) AS p, regexp_extract_all(t, pattern) AS m FROM blocks, rules WHERE contains(t, keyword) AND regexp_matches(t, pattern)),
  placed AS (SELECT *, a + {_SPACES.format("(array_to_string(p[1:k], '') || array_to_string(m[1:k - 1], ''))")} // 2 AS start, {_SPACES.format("m[k]")} // 2 AS size FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM matched)),
  dets AS (SELECT doc_id, rule, label, tier, weight, start, start + size AS stop FROM placed WHERE start < a + {BLOCK_WORDS}),
  kept AS (SELECT * FROM dets d WHERE NOT EXISTS (SELECT 1 FROM dets e WHERE e.doc_id = d.doc_id AND {_INSIDE})),
  places AS (SELECT doc_id, i - 1 AS start, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM norm) JOIN base ON array_to_string(w[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
  based AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
  every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM kept) GROUP BY doc_id),
  best AS (SELECT doc_id, max(weight) AS score FROM kept GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(CAST(score AS DOUBLE), 0) AS score
FROM norm LEFT JOIN based USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)"""

_CHANCE = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
FILL_IN_MIDDLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l FROM documents),
  c AS (SELECT *, len(l) AS n, least({_CHANCE.format(1)} % (len(l) + 1), {_CHANCE.format(9)} % (len(l) + 1)) AS a, greatest({_CHANCE.format(1)} % (len(l) + 1), {_CHANCE.format(9)} % (len(l) + 1)) AS b FROM d),
  p AS (SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_CHANCE.format(17)} % 100 >= 100 THEN 'plain' WHEN {_CHANCE.format(25)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256 FROM p"""

ORACLE_SQL = {
    "op2_url_lists": URL_LISTS,
    "op3_jaccard_join": JACCARD,
    "op5_decontamination": DECONTAMINATION,
    "op9_warc": WARC,
    "op11_spelling_variants": SPELLING,
    "op12_license_scan": LICENSES,
    "op13_fill_in_middle": FILL_IN_MIDDLE,
}
