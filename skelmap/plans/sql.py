"""DuckDB SQL for the driver's queries, written apart from the engine's own plans."""

from __future__ import annotations

from ..functions.formats import BY_EXTENSION
from ..functions.redact import KEY_WORDS, PLAIN, VALUE_MARKS
from .grammar_queries import grammar_sql

FLOAT = r"[+-]?(inf(inity)?|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)"


def lines(t: str) -> str:
    return f"(CASE WHEN {t} = '' THEN [] ELSE string_split(regexp_replace({t}, '\\n$', ''), chr(10)) END)"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


def squash(t: str) -> str:
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def clip(t: str) -> str:
    return f"(CASE WHEN length({t}) > 200 THEN left({t}, 200) || '…' ELSE {t} END)"


def human(n: str) -> str:
    return f"(CASE WHEN {n} < 1024 THEN CAST({n} AS VARCHAR) || ' B' WHEN {n} < 1048576 THEN printf('%.1f KB', {n} / 1024::DOUBLE) ELSE printf('%.1f MB', {n} / 1048576::DOUBLE) END)"


def breaks(t: str) -> str:
    return f"(length({t}) - length(replace({t}, chr(10), '')) + CASE WHEN {t} <> '' AND right({t}, 1) <> chr(10) THEN 1 ELSE 0 END)"


LINES = f"""
l AS (SELECT doc_id, CAST(len(ls) AS BIGINT) - 1 AS last, CAST(i - 1 AS BIGINT) AS r, ls[i] AS line FROM (SELECT doc_id, {lines('text')} AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i))"""

_COUNTS = ", ".join(f"CAST(len(list_filter(ls, lambda s: contains(s, '{w}'))) AS BIGINT) AS {w.lower()}" for w in ("ERROR", "WARN", "FATAL", "panic", "Traceback"))

PAGES = r"""
raw AS (SELECT page_id, html, list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '/'), lambda x: x <> '') AS full_ FROM pages),
p AS (SELECT page_id, html, full_, full_[1] AS host, full_[2:] AS rel, CAST(strlen(html) AS BIGINT) AS size FROM raw),
small AS (SELECT host FROM p GROUP BY host HAVING count(*) <= 300)"""

_WORDS = "[" + ", ".join(f"'{w}'" for w in KEY_WORDS) + "]"
_PLAIN = ", ".join(f"'{w}'" for w in PLAIN)
_SECRET = "(" + " OR ".join(f"contains({{0}}, '{m}')" for m in VALUE_MARKS) + " OR regexp_matches({0}, '^.*?://[^/?#@]*:[^/?#@]*@'))"
_FORMATS = ", ".join(f"('{e}', '{n}')" for e, n in BY_EXTENSION.items())
_BINDING = r"([A-Za-z_]+) *[=:] *(\S+)"

ORACLES: dict[str, str] = {
    "doc_line_count": f"SELECT doc_id, CAST({breaks('text')} AS BIGINT) AS n_breaks, CAST(len({lines('text')}) AS BIGINT) AS n_lines FROM documents",
    "doc_text_summary": f"""
WITH d AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, {lines('text')} AS ls FROM documents),
f AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: {strip('ls[i]')} <> '') AS full_, list_filter(range(1, len(ls) + 1), lambda i: contains(ls[i], 'ERROR')) AS e FROM d)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, bytes, {human('bytes')} AS size_text, CAST(full_[1] AS BIGINT) AS first_row, '"' || {clip(strip('ls[full_[1]]'))} || '"' AS first_text,
       CAST(full_[-1] AS BIGINT) AS last_row, '"' || {clip(strip('ls[full_[-1]]'))} || '"' AS last_text, {_COUNTS}, CAST(e[1] AS BIGINT) AS first_error_row
FROM f""",
    "doc_text_functions": f"""
WITH d AS (SELECT doc_id, {squash('text')} AS s, regexp_replace(string_split(text, chr(10))[1], '\\s+$', '') AS head FROM documents)
SELECT doc_id, length(s) AS squashed, {clip('s')} AS clipped, head, '"' || {clip(strip('head'))} || '"' AS quoted, {human('(doc_id * doc_id * 37)')} AS size_text,
       regexp_full_match(lower(split_part(head, ' ', 1)), '{FLOAT}') AS numeric
FROM d""",
    "doc_csv_sniff": f"""
WITH d AS (SELECT doc_id, len({lines('text')}) AS total, coalesce({lines('text')}[1], '') AS f FROM documents),
c AS (SELECT *, len(f) - len(replace(f, chr(9), '')) AS t, len(f) - len(replace(f, ';', '')) AS s, len(f) - len(replace(f, ',', '')) AS c FROM d),
w AS (SELECT *, CASE WHEN greatest(t, s, c) = 0 OR c = greatest(t, s, c) THEN ',' WHEN s = greatest(t, s, c) THEN ';' ELSE chr(9) END AS delim FROM c),
x AS (SELECT *, string_split(f, delim) AS cols FROM w),
y AS (SELECT *, f <> '' AND len(list_filter(cols, lambda x: NOT regexp_full_match(lower({strip('x')}), '{FLOAT}'))) > 0 AS head, array_to_string(list_transform(cols, lambda x: {strip('x')}), ', ') AS names FROM x)
SELECT doc_id, CASE WHEN head THEN {clip('names')} END AS header, CAST(len(cols) AS BIGINT) AS n_cols, CAST(CASE WHEN head THEN greatest(total - 1, 0) ELSE total END AS BIGINT) AS n_rows, CASE WHEN delim = chr(9) THEN '\\t' ELSE delim END AS delimiter
FROM y""",
    "doc_env_keys": f"""
WITH {LINES}, s AS (SELECT *, {strip('line')} AS raw FROM l),
t AS (SELECT *, regexp_replace(raw, '^export \\s*', '') AS t FROM s), k AS (SELECT *, {strip("split_part(t, '=', 1)")} AS key FROM t)
SELECT doc_id, r + 1 AS first, r + 1 AS last, CAST(0 AS BIGINT) AS indent, key AS text FROM k WHERE NOT starts_with(raw, '#') AND contains(t, '=') AND key <> ''""",
    "doc_ini_keys": f"""
WITH {LINES}, s AS (SELECT *, {strip('line')} AS t FROM l), h AS (SELECT *, strlen(t) > 2 AND starts_with(t, '[') AND ends_with(t, ']') AS head FROM s),
w AS (SELECT *, coalesce(min(CASE WHEN head THEN r END) OVER (PARTITION BY doc_id ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, last) AS e,
             coalesce(max(head::INT) OVER (PARTITION BY doc_id ORDER BY r), 0) AS inside, {strip("regexp_extract(t, '^([^=:]*)[=:]', 1)")} AS key FROM h)
SELECT doc_id, r + 1 AS first, CASE WHEN head THEN greatest(e, r) ELSE r END + 1 AS last, CAST(CASE WHEN head THEN 0 ELSE inside END AS BIGINT) AS indent, CASE WHEN head THEN {clip('t')} ELSE {clip('key')} END AS text
FROM w WHERE t <> '' AND NOT starts_with(t, ';') AND NOT starts_with(t, '#') AND (head OR key <> '')""",
    "conv_make_targets": f"""
WITH s AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, count(*) OVER (PARTITION BY conv_id) - 1 AS last, split_part(text, chr(10), 1) AS t FROM conversations),
w AS (SELECT *, coalesce(min(CASE WHEN role = 'user' THEN r END) OVER (PARTITION BY conv_id ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, last) AS e, {squash("('t' || turn || ': ' || t)")} AS q FROM s)
SELECT conv_id, r + 1 AS first, CASE WHEN role = 'user' THEN greatest(e, r) ELSE r END + 1 AS last, CAST(0 AS BIGINT) AS indent, CASE WHEN role = 'user' THEN {clip('q')} ELSE 'V' || turn || ' =' END AS text
FROM w WHERE role IN ('user', 'system')""",
    "conv_docker_stages": f"""
WITH s AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, count(*) OVER (PARTITION BY conv_id) - 1 AS last, split_part(text, chr(10), 1) AS t FROM conversations),
w AS (SELECT *, coalesce(min(CASE WHEN role = 'user' THEN r END) OVER (PARTITION BY conv_id ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, last) AS e,
             coalesce(max((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY r), 0) AS seen, {squash("(CASE WHEN role = 'user' THEN 'FROM ' ELSE 'run ' END || t)")} AS q FROM s)
SELECT conv_id, r + 1 AS first, CASE WHEN role = 'user' THEN greatest(e, r) ELSE r END + 1 AS last, CAST(CASE WHEN role = 'user' THEN 0 ELSE seen END AS BIGINT) AS indent,
       CASE WHEN role IN ('user', 'assistant') THEN CASE WHEN role = 'assistant' AND {_SECRET.format('lower(q)')} THEN 'RUN <redacted>' ELSE {clip('q')} END ELSE 'ENV A B' END AS text
FROM w""",
    "doc_secret_bindings": f"""
WITH b AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_BINDING}', 0)) AS b FROM documents), d AS (SELECT doc_id, regexp_extract(b, '{_BINDING}', 1) AS k, regexp_extract(b, '{_BINDING}', 2) AS v FROM b),
s AS (SELECT doc_id, k, list_has_any(string_split_regex(lower(regexp_replace(k, '([a-z])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]'), {_WORDS}) AS sensitive, {_SECRET.format("lower(k || '=' || v)")} AS secret, {_SECRET.format('lower(v)')} AS own, trim(v, '''"') AS bare FROM d WHERE k <> ''),
p AS (SELECT *, bare = '' OR lower(bare) IN ({_PLAIN}) OR regexp_full_match(lower(bare), '{FLOAT}') AS plain FROM s)
SELECT doc_id, k, sensitive, secret, plain, NOT plain AND (sensitive OR own) AS redact FROM p""",
    "event_log_severity": """
WITH e AS (SELECT user_id, upper(event_type) AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
SELECT user_id, count(*) AS n_lines, count(*) FILTER (contains(line, 'ERROR')) AS error, count(*) FILTER (contains(line, 'WARN')) AS warn, arg_min(line, r) AS first_text, arg_max(line, r) AS last_text, min(r) FILTER (contains(line, 'ERROR')) AS first_error_row
FROM e GROUP BY user_id""",
    "event_props_keys": r"""SELECT event_id, '{object, 1 key}' || chr(10) || ' "k": ' || regexp_extract(props, ':\s*([^}]*?)\s*\}', 1) AS outline FROM events""",
    "page_links_capped": """
WITH x AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS a FROM pages),
y AS (SELECT page_id, list_filter(a, lambda v, i: v <> '' AND list_position(a, v) = i) AS a FROM x)
SELECT page_id, array_to_string(CASE WHEN len(a) <= 4 THEN a ELSE list_append(a[1:4], '(+' || (len(a) - 4) || ' more)') END, '|') AS links FROM y""",
    "page_landmarks": f"""
WITH x AS (SELECT page_id, html, CASE WHEN contains(html, '<h1>') THEN left(html, position('<h1>' IN html) - 1) END AS head, {squash("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS h FROM pages)
SELECT page_id, CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS BIGINT) AS h1_row, {clip('h')} AS h1 FROM x""",
    "page_rollup": f"""
WITH {PAGES}, g AS (SELECT CASE WHEN len(full_) > 1 THEN host || '/' ELSE host END AS label, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM p GROUP BY 1)
SELECT label, n_files, bytes, label || repeat(' ', greatest(0, 28 - length(label))) || ' ' || lpad(CAST(n_files AS VARCHAR), CAST(greatest(5, length(CAST(n_files AS VARCHAR))) AS INTEGER), ' ') || ' ' || CASE WHEN n_files = 1 THEN 'file ' ELSE 'files' END || ' ' || {human('bytes')} AS line FROM g""",
    "page_tier": f"""
WITH {PAGES} SELECT host, count(*) AS n_files, count(DISTINCT array_to_string(rel[:len(rel) - 1], '/')) AS n_dirs, CAST(sum(size) AS BIGINT) AS bytes, CASE WHEN count(*) <= 30 THEN 'skeleton' WHEN count(*) <= 300 THEN 'map' ELSE 'rollup' END AS tier FROM p GROUP BY host""",
    "page_map": f"""
WITH {PAGES} SELECT page_id, coalesce(array_to_string(rel, '/'), '') || ' (' || {breaks('html')} || ' lines, ' || {human('size')} || ')' AS line FROM p SEMI JOIN small USING (host)""",
    "page_read_budget": f"""
WITH RECURSIVE {PAGES}, o AS (SELECT host, page_id, size, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM p SEMI JOIN small USING (host)),
f AS (
  SELECT host, page_id, size, n, size <= 12000 AND size <= 9000 AS is_read, size > 12000 AS skipped, 12000 - CASE WHEN size <= 9000 THEN size ELSE 0 END AS rest FROM o WHERE n = 1
  UNION ALL
  SELECT o.host, o.page_id, o.size, o.n, o.size <= f.rest AND o.size <= 9000, o.size > f.rest, f.rest - CASE WHEN o.size <= f.rest AND o.size <= 9000 THEN o.size ELSE 0 END FROM f JOIN o ON o.host = f.host AND o.n = f.n + 1)
SELECT host, page_id, size, is_read, skipped FROM f""",
    "page_order_all": f"""
WITH {PAGES} SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY rel, page_id) AS place FROM p""",
    "doc_markdown_outline": f"""
WITH {LINES}, h AS (SELECT doc_id, r, last, length(line) % 3 + 1 AS level, {squash("(repeat('#', CAST(length(line) % 3 + 1 AS INT)) || ' ' || line)")} AS t FROM l WHERE length(line) < 40),
d AS (SELECT *, (SELECT count(*) FROM h g WHERE g.doc_id = h.doc_id AND g.r < h.r AND g.level < h.level AND NOT EXISTS (SELECT 1 FROM h m WHERE m.doc_id = h.doc_id AND m.r > g.r AND m.r < h.r AND m.level <= g.level)) AS depth,
                coalesce((SELECT min(m.r) - 1 FROM h m WHERE m.doc_id = h.doc_id AND m.r > h.r AND m.level <= h.level), last) AS e FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS n, '[' || (r + 1) || '-' || (greatest(e, r) + 1) || ']' AS span FROM d WHERE depth <= 2),
b AS (SELECT doc_id, string_agg(repeat('  ', CAST(depth + 1 AS INT)) || span || repeat(' ', CAST(greatest(0, 10 - length(span)) AS INT)) || ' ' || t || chr(10), '' ORDER BY r) FILTER (n <= 500) AS body, max(n) AS n FROM n GROUP BY doc_id)
SELECT doc_id, 'doc.md' || chr(10) || coalesce(body, '  (no imports or top-level declarations found)' || chr(10)) || CASE WHEN n > 500 THEN '  … (output truncated at 500 entries — read the file directly for the rest)' || chr(10) ELSE '' END AS text, false AS is_error
FROM documents LEFT JOIN b USING (doc_id)""",
    "conv_sections": """
SELECT conv_id, turn, end_turn FROM (
  SELECT conv_id, turn, role, coalesce(min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, max(turn) OVER (PARTITION BY conv_id)) AS end_turn FROM conversations) WHERE role = 'user'""",
    "conv_nested_sections": """
WITH t AS (SELECT conv_id, turn AS r, length(text) % 6 + 1 AS level, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT h.conv_id, h.r AS turn, CAST(h.level AS BIGINT) AS level,
       (SELECT count(*) FROM t g WHERE g.conv_id = h.conv_id AND g.r < h.r AND g.level < h.level AND NOT EXISTS (SELECT 1 FROM t m WHERE m.conv_id = h.conv_id AND m.r > g.r AND m.r < h.r AND m.level <= g.level)) AS depth,
       greatest(h.r, coalesce((SELECT min(m.r) - 1 FROM t m WHERE m.conv_id = h.conv_id AND m.r > h.r AND m.level <= h.level), h.last)) AS end_turn
FROM t h""",
    "decl_cap": """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem)
SELECT l_suppkey, count(*) FILTER (n <= 500) AS kept, count(*) > 500 AS truncated, max(l_orderkey) FILTER (n <= 500) AS last_order, CAST(sum(l_linenumber) FILTER (n <= 500) AS BIGINT) AS sum_lines FROM o GROUP BY l_suppkey""",
    "skeleton_budget": """
WITH o AS (SELECT source, doc_id, CAST(strlen(text) AS BIGINT) AS bytes, row_number() OVER w AS n, coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT source, doc_id, bytes FROM o WHERE n <= 200 AND before < 262144""",
    "path_miss_ancestor": f"""
WITH {PAGES}, dirs AS (SELECT DISTINCT array_to_string(full_[1:n], '/') AS dir FROM p, unnest(range(0, len(full_))) AS u(n)),
a AS (SELECT page_id, list_concat(full_[1:greatest(len(full_) - 1 - page_id % 2, 0)], ['nowhere', 'x.py']) AS asked FROM p),
s AS (SELECT page_id, asked, n, coalesce(array_to_string(asked[1:n], '/'), '') AS dir FROM a, unnest(range(0, len(asked))) AS u(n))
SELECT page_id, arg_max(dir, n) AS ancestor, arg_max(asked[n + 1], n) AS missing FROM s WHERE dir IN (SELECT coalesce(dir, '') FROM dirs) GROUP BY page_id""",
    "format_of_url": f"""
WITH {PAGES}, b AS (SELECT page_id, coalesce(rel[-1], '') AS base FROM p),
e AS (SELECT *, CASE WHEN base = '.env' OR starts_with(base, '.env.') THEN 'env' WHEN lower(base) IN ('makefile', 'gnumakefile') THEN 'make'
                     WHEN lower(base) IN ('dockerfile', 'containerfile') OR starts_with(lower(base), 'dockerfile.') OR starts_with(lower(base), 'containerfile.') THEN 'dockerfile'
                     WHEN regexp_matches(base, '^.+\\.[^.]*$') THEN regexp_extract(base, '\\.([^.]*)$', 1) ELSE '' END AS ext FROM b)
SELECT page_id, base, ext, f.name AS format FROM e LEFT JOIN (VALUES {_FORMATS}) AS f(x, name) ON f.x = lower(ext)""",
    **grammar_sql(),
}
