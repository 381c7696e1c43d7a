"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .chat_preference import CLOSE, OPEN
from .license_scan import FAMILIES, LOWER, UPPER, templates

OP1 = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n, greatest(1, count(*) // 2) AS h FROM t GROUP BY conv_id),
chosen AS (SELECT conv_id AS id, i, role, text FROM t),
rejected AS (
  SELECT conv_id AS id, i, role, text FROM t JOIN sizes USING (conv_id) WHERE i <= h
  UNION ALL
  SELECT s.conv_id, t.i, t.role, t.text FROM sizes s JOIN t ON t.conv_id = xor(s.conv_id, 1) WHERE t.i > s.h),
off AS (
  SELECT coalesce(c.id, r.id) AS id, min(coalesce(c.i, r.i)) - 1 AS n
  FROM chosen c FULL JOIN rejected r ON c.id = r.id AND c.i = r.i
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY 1),
p AS (SELECT s.conv_id AS id, coalesce(off.n, s.n) AS n FROM sizes s LEFT JOIN off ON off.id = s.conv_id),
sides AS (
  SELECT 'p' AS side, c.id, i, role, text FROM chosen c JOIN p USING (id) WHERE i <= p.n
  UNION ALL SELECT 'c', c.id, i, role, text FROM chosen c JOIN p USING (id) WHERE i > p.n
  UNION ALL SELECT 'r', r.id, i, role, text FROM rejected r JOIN p USING (id) WHERE i > p.n),
drawn AS (
  SELECT *, '{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10) AS s FROM sides),
placed AS (
  SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY side, id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + length(role) + {len(OPEN) + 1} AS a FROM drawn),
whole AS (
  SELECT side, id, string_agg(s, '' ORDER BY i) AS s,
         coalesce(string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(a + length(text) + {len(CLOSE)} AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (role = 'assistant'), '') AS spans
  FROM placed GROUP BY side, id)
SELECT p.id AS conv_id, CAST(p.n AS BIGINT) AS n_prompt_turns, coalesce(a.s, '') AS prompt, coalesce(b.s, '') AS chosen, coalesce(c.s, '') AS rejected,
       coalesce(b.spans, '') AS chosen_spans, coalesce(c.spans, '') AS rejected_spans
FROM p LEFT JOIN whole a ON a.id = p.id AND a.side = 'p' LEFT JOIN whole b ON b.id = p.id AND b.side = 'c' LEFT JOIN whole c ON c.id = p.id AND c.side = 'r'
"""

OP4 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op7() -> str:
    index = templates()
    starts, covers = [], []
    for k, t in enumerate(index):
        inside = lambda i: f"(s + {i} >= 0 AND ws[s + {i + 1}] = '{t.words[i]}')"  # noqa: E731, B023
        starts.append(f"list_filter(range({-len(t.words)}, len(ws)), lambda s: {' AND '.join(inside(i) for i in t.key)}) AS t{k}")
        count = " + ".join(f"coalesce({inside(i)}::INT, 0)" for i in range(len(t.words)))
        covers.append(f"coalesce(list_max(list_transform(t{k}, lambda s: ({count}) / {float(len(t.words))})), 0.0)")
    bases = [k for k, t in enumerate(index) if t.base]
    at = "list_concat(" + ", ".join(f"t{k}" for k in bases) + ")"

    def unversioned(label: str) -> list[str]:
        family = any(label == name for name, _, _ in FAMILIES)
        return [f"len(t{j}) = 0" for j, t in enumerate(index) if family and t.label.startswith(label + "-")]

    def names(ks: list[int]) -> str:
        each = ", ".join(f"CASE WHEN {' AND '.join([f'len(t{k}) > 0', *unversioned(index[k].label)])} THEN '{index[k].label}' END" for k in ks)
        return f"coalesce(array_to_string(list_sort(list_distinct([{each}])), ','), '')"

    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, {', '.join(starts)} FROM w)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len({at}) AS BIGINT) AS n_base, CAST(list_min({at}) AS BIGINT) AS first_word, CAST(list_max({at}) AS BIGINT) AS last_word,
       {names(bases)} AS base_labels, {names(list(range(len(index))))} AS labels, greatest({', '.join(covers)}) AS score
FROM s
"""


OP8 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
wins AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM w, unnest(range(1, len(ws) - 33)) AS r(i)),
rep AS (SELECT h FROM wins GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM wins JOIN rep USING (h), range(35) AS k(j)),
words AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS r(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP11 = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT row, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(ws) AS w FROM b),
words AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
codes AS (
  SELECT w, xor(list_reduce(list_transform(range(0, length(x), 2), lambda i: CAST(CAST('0x' || substr(x, i + 1, 2) AS INT) AS BIGINT)),
                lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM words, crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN codes USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN codes USING (w) GROUP BY 1),
every AS (SELECT (SELECT coalesce(sum(n), 0)::DOUBLE FROM s) AS s, (SELECT coalesce(sum(n), 0)::DOUBLE FROM t) AS t),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (every.s + 10000) / ((s.n::DOUBLE + 1) * (every.t + 10000)))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (bucket), every),
weights AS (SELECT row, sum(g) AS g FROM dw JOIN codes USING (w) JOIN gain USING (bucket) GROUP BY row),
h AS (
  SELECT d.row, doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(g, 0) AS BIGINT) AS weight,
         CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) AS h
  FROM d LEFT JOIN weights ON weights.row = d.row),
scored AS (SELECT row, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM h),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (row)
"""

_OP12_CUTS = " UNION ALL ".join(
    f"SELECT c.*, {k} AS k, l.f AS l, r.f AS r FROM c JOIN grams l ON l.lang = c.lang AND l.ws = c.ws[:{k}] JOIN grams r ON r.lang = c.lang AND r.ws = c.ws[{k + 1}:] WHERE len(c.ws) > {k}"
    for k in range(1, 5)
)
_OP12_INSIDE = " UNION ALL ".join(
    f"SELECT lang, ws[{i + 1}:{i + m}] AS ws, f FROM c WHERE len(ws) >= {i + m} AND len(ws) > {m}" for m in range(2, 5) for i in range(6 - m)
)
OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM d),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
runs AS ({" UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(ws) - {m - 2}), lambda i: ws[i:i + {m - 1}])) AS ws FROM p WHERE len(ws) >= {m}" for m in range(1, 6))}),
grams AS (SELECT lang, ws, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT * FROM grams WHERE len(ws) > 1),
cuts AS ({_OP12_CUTS}),
scored AS (SELECT cuts.*, n, CAST(1000::HUGEINT * f * n // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts JOIN total USING (lang)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inside AS (SELECT lang, ws, max(f) AS longer FROM ({_OP12_INSIDE}) GROUP BY ALL),
kept AS (SELECT best.*, array_to_string(best.ws, ' ') AS phrase FROM best LEFT JOIN inside USING (lang, ws) WHERE longer IS NULL OR 100 * longer < 100 * f)
SELECT lang, row_number() OVER w AS rank, phrase, f AS a, l, r, n, score FROM kept
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_preference": OP1, "op4_exact_dedup": OP4, "op7_license_scan": op7(), "op8_substring_dedup": OP8, "op11_importance": OP11, "op12_collocations": OP12}
