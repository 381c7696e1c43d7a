"""What a request goes through, over whole tables: walks of trees, headings, confinement of paths, help with missing ones, outcomes of files.

The pages of a host are a tree. Their addresses hold no folders that a walk passes over, so their paths get some.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import format_of
from ..operators import links, outline, skeletons, walk
from ..sources.tables import read_table
from .sql import PAGES, breaks, clip, human, lines, strip

ENTRIES = 25
SKELETON_FILES, SKELETON_BYTES = 60, 9_000
LINKS = 6
FOLDERS = ["src", "node_modules", ".git", ".github", "pkg", ".env", "build"]
NAMES = ["a.py", ".env.local", ".hidden.py", "Makefile", "image.png", "README.md", "target", "dockerfile.dev", ".gitlab", "x.", "z.JSON"]
FILES = ["d.log", "d.csv", "d.zig", "Makefile.txt", "gone.log"]


def _pick(values: list[str], n: Column) -> Column:
    return F.array(*map(F.lit, values))[(n % len(values)).cast("int")]


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import _pages

    pages = _pages(spark, sf_dir).select("page_id", "host", "rel")
    rel = F.concat(F.array(_pick(FOLDERS, F.col("page_id"))), F.col("rel"), F.array(_pick(NAMES, F.col("page_id"))))
    return pages.select("page_id", "host", rel.alias("rel"))


def path_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a walk of each host comes to within ENTRIES entries, their numbers, and whether they are kept."""
    entries = walk.walked(_trees(spark, sf_dir), "host", "page_id", ENTRIES)
    return entries.where("NOT is_dir").select("page_id", "host", F.col("nth").cast("long").alias("nth"), F.array_join("rel", "/").alias("path"), "found", "stopped")


def path_walk_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading of each host's walk, with the note of one that stopped."""
    return walk.headings(walk.walked(_trees(spark, sf_dir), "host", "page_id", ENTRIES), "host", ENTRIES)


def path_confined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's path under /work and its host, with up to four steps back: where it leads, whether that is inside, how it is shown or refused."""
    from .queries import _pages

    back = F.array_repeat(F.lit(".."), (F.col("page_id") % 5).cast("int"))
    root = F.array(F.lit("work"), F.col("host"))
    parts = walk.normalised(F.concat(F.array(F.lit("work"), F.lit("."), F.col("host")), F.col("rel"), back, F.array(F.lit(""))))
    rows = _pages(spark, sf_dir).select("page_id", root.alias("root"), parts.alias("parts"))
    path = F.concat(F.lit("/"), F.array_join("parts", "/"))
    is_inside = walk.inside(F.col("parts"), F.col("root"))
    said = F.when(is_inside, walk.shown(F.col("parts"), F.col("root"))).otherwise(walk.filled(walk.OUTSIDE, path=path))
    return rows.select("page_id", path.alias("path"), is_inside.alias("is_inside"), said.alias("said"))


def path_confined_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_confined's paths where folders are links: by the lengths of its names a host's folder is one to a folder beside it, to a shared one, out of the workspace, or to itself."""
    from .queries import _pages

    pages = _pages(spark, sf_dir)
    back = F.array_repeat(F.lit(".."), (F.col("page_id") % 5).cast("int"))
    paths = pages.select("page_id", "host", F.concat(F.array(F.lit("work"), F.lit("."), F.col("host")), F.col("rel"), F.array(F.lit("leaf"), F.lit("")), back).alias("parts"))
    name = F.try_element_at("rel", F.lit(1))
    folders = pages.where(F.size("rel") > 0).select("host", name.alias("name")).distinct()
    kind = (F.length("host") + F.length("name")) % 5
    target = F.when(kind == 1, "alias").when(kind == 2, "../shared/./x").when(kind == 3, F.concat(F.lit("/outside/"), "host")).when(kind == 4, F.col("name"))
    at = F.array(F.lit("work"), F.col("host"), F.col("name"))
    placed = folders.select(at.alias("at"), target.alias("target")).where(F.col("target").isNotNull())
    aliases = pages.select("host").distinct().select(F.array(F.lit("work"), F.col("host"), F.lit("alias")).alias("at"), F.lit("deep/../er").alias("target"))
    shared = aliases.limit(1).select(F.array(F.lit("work"), F.lit("shared"), F.lit("x")).alias("at"), F.lit("/work/real").alias("target"))
    out = links.resolved(paths, placed.unionByName(aliases).unionByName(shared), max_links=LINKS)
    path = F.concat(F.lit("/"), F.array_join("real", "/"))
    return out.select("page_id", path.alias("path"), "looped", walk.inside(F.col("real"), F.array(F.lit("work"), F.col("host"))).alias("is_inside"))


def path_miss_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message for each page's path with its last or its last two components replaced by what isn't there."""
    from .queries import _pages

    pages = _pages(spark, sf_dir).select("page_id", F.concat(F.array("host"), F.col("rel")).alias("rel"))
    depth = F.greatest(F.size("rel") - 1 - (F.col("page_id") % 2).cast("int"), F.lit(0))
    asked = pages.select("page_id", F.concat(F.slice("rel", F.lit(1), depth), F.array(F.lit("nowhere"), F.lit("x.py"))).alias("rel"))
    return walk.miss_messages(asked, pages, "page_id")


def doc_file_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file: a log, a table, a file of no known format, one with a zero byte, one that can't be read."""
    docs = read_table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % len(FILES)
    content = F.when(kind == 3, F.concat(F.lit("\x00"), "text")).when(kind < 3, F.col("text")).cast("binary")
    name = _pick(FILES, F.col("doc_id"))
    files = docs.select(F.col("doc_id").alias("file_id"), name.alias("name"), format_of(name).alias("fmt"), content.alias("content"))
    return outline.outline(files).select(F.col("file_id").alias("doc_id"), "text", "is_error")


def page_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host's pages, 500 ids to a directory, as logs in the order of their paths and ids: the skeletons that SKELETON_FILES and SKELETON_BYTES let through.

    Each seventh page can't be read.
    """
    from .queries import _pages

    rel = F.concat("rel", F.array(F.concat(F.lpad(F.col("page_id").cast("string"), 12, "0"), F.lit(".log"))))
    html = F.when(F.col("page_id") % 7 != 3, F.col("html")).cast("binary")
    folder = F.concat("host", F.lit("/"), F.floor(F.col("page_id") / 500).cast("string"))
    files = _pages(spark, sf_dir).select(folder.alias("folder"), "page_id", rel.alias("rel"), F.lit("log/text").alias("fmt"), html.alias("content"))

    def bodies(some: DataFrame) -> DataFrame:
        return some.where(F.col("content").isNotNull()).withColumn("name", skeletons.skeleton_head(F.array_join("rel", "/"), F.col("content")))

    shown = skeletons.shown_skeletons(files, "folder", bodies, max_files=SKELETON_FILES, max_bytes=SKELETON_BYTES, first=20)
    return skeletons.render_skeletons(files, shown, "folder")


def request_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (path_walk, path_walk_heading, path_confined, path_confined_links, path_miss_message, doc_file_outcome, page_skeletons)}


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# The names that a walk passes over and the files that are kept, told one by one for the names above.
WALK = f"""
{PAGES},
t AS (SELECT page_id, host, list_concat([{_list(FOLDERS)}[page_id % {len(FOLDERS)} + 1]], rel, [{_list(NAMES)}[page_id % {len(NAMES)} + 1]]) AS rel FROM p),
d AS (SELECT DISTINCT host, rel[:n] AS rel FROM t, unnest(range(1, len(rel))) AS u(n)),
e AS (SELECT host, page_id, rel, false AS is_dir FROM t UNION ALL SELECT host, NULL, rel, true FROM d),
c AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY rel, is_dir, page_id) AS nth, count(*) OVER (PARTITION BY host) > {ENTRIES} AS stopped FROM e
      WHERE len(rel) = 1 OR rel[1] NOT IN ('node_modules', '.git', '.env', 'build')),
w AS (SELECT *, NOT is_dir AND rel[-1] IN ('a.py', '.env.local', 'Makefile', 'README.md', 'dockerfile.dev', 'z.JSON') AS found FROM c WHERE nth <= {ENTRIES})"""


def request_sql() -> dict[str, str]:
    file_names = _list(FILES)
    severities = ["ERROR", "WARN", "FATAL", "panic", "Traceback"]
    counts = ", ".join(f"CASE WHEN len(list_filter(ls, lambda s: contains(s, '{w}'))) > 0 THEN len(list_filter(ls, lambda s: contains(s, '{w}'))) || ' {w}' END" for w in severities)
    number = r"[+-]?(inf(inity)?|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)"
    return {
        "path_walk": f"WITH {WALK} SELECT page_id, host, nth, array_to_string(rel, '/') AS path, found, stopped FROM w WHERE NOT is_dir",
        "path_walk_heading": f"""
WITH {WALK}, g AS (SELECT host, count(*) FILTER (found) AS n_files, count(DISTINCT rel[:len(rel) - 1]) FILTER (found) AS n_dirs, bool_or(stopped) AS stopped FROM w GROUP BY host)
SELECT *, host || ' — ' || n_files || CASE WHEN stopped THEN '+' ELSE '' END || ' supported files in ' || n_dirs || CASE WHEN stopped THEN '+ directories — walk stopped at {ENTRIES} entries, so this is a LOWER BOUND; index a subdirectory for a complete view'
       WHEN n_dirs = 1 THEN ' directory' ELSE ' directories' END AS heading FROM g""",
        "path_confined": f"""
WITH {PAGES}, n AS (SELECT page_id, host, len(rel) - page_id % 5 AS deep, rel FROM p),
q AS (SELECT page_id, deep, '/' || array_to_string(CASE WHEN deep >= 0 THEN list_concat(['work', host], rel[:deep]) WHEN deep = -1 THEN ['work'] ELSE [] END, '/') AS path, array_to_string(rel[:greatest(deep, 0)], '/') AS rest FROM n)
SELECT page_id, path, deep >= 0 AS is_inside, CASE WHEN deep = 0 THEN '.' WHEN deep > 0 THEN rest
       ELSE 'index: ' || path || ' is outside the workspace; `index` is confined to the project directory. Use `read` for files outside it (host `read` can be unjailed), or copy the file in first.' END AS said FROM q""",
        "path_confined_links": f"""
WITH RECURSIVE {PAGES.strip()},
folders AS (SELECT DISTINCT host, rel[1] AS name, (length(host) + length(rel[1])) % 5 AS kind FROM p WHERE len(rel) > 0),
l AS (SELECT 'work/' || host || '/' || name AS place, CASE kind WHEN 1 THEN 'alias' WHEN 2 THEN '../shared/./x' WHEN 3 THEN '/outside/' || host ELSE name END AS target FROM folders WHERE kind > 0
      UNION ALL SELECT DISTINCT 'work/' || host || '/alias', 'deep/../er' FROM p UNION ALL SELECT 'work/shared/x', '/work/real' WHERE EXISTS (SELECT 1 FROM p)),
s AS (
  SELECT page_id, host, CAST([] AS VARCHAR[]) AS done, list_concat(['work', '.', host], rel, ['leaf', ''], list_transform(range(page_id % 5), lambda x: '..')) AS rest, 0 AS hops FROM p
  UNION ALL
  SELECT page_id, host, CASE WHEN rest[1] IN ('', '.') THEN done WHEN rest[1] = '..' THEN done[:greatest(len(done) - 1, 0)] WHEN target IS NULL THEN list_append(done, rest[1]) WHEN target[1] = '/' THEN [] ELSE done END,
         CASE WHEN target IS NULL THEN rest[2:] ELSE list_concat(string_split(target, '/'), rest[2:]) END, hops + (target IS NOT NULL)::INT
  FROM s LEFT JOIN l ON rest[1] NOT IN ('', '.', '..') AND place = array_to_string(list_append(done, rest[1]), '/') WHERE len(rest) > 0 AND hops <= {LINKS})
SELECT page_id, CASE WHEN hops <= {LINKS} THEN '/' || array_to_string(done, '/') END AS path, hops > {LINKS} AS looped, CASE WHEN hops <= {LINKS} THEN done[:2] = ['work', host] END AS is_inside FROM s WHERE len(rest) = 0 OR hops > {LINKS}""",
        "path_miss_message": f"""
WITH {PAGES}, dirs AS (SELECT DISTINCT coalesce(array_to_string(full_[1:n], '/'), '') AS dir FROM p, unnest(range(0, len(full_))) AS u(n)),
kids AS (SELECT DISTINCT coalesce(array_to_string(full_[1:n - 1], '/'), '') AS dir, full_[n] || CASE WHEN n < len(full_) THEN '/' ELSE '' END AS kid FROM p, unnest(range(1, len(full_) + 1)) AS u(n)),
l AS (SELECT dir, list(kid ORDER BY kid) AS ks FROM kids GROUP BY dir),
a AS (SELECT page_id, list_concat(full_[1:greatest(len(full_) - 1 - page_id % 2, 0)], ['nowhere', 'x.py']) AS asked FROM p),
s AS (SELECT page_id, asked, n, coalesce(array_to_string(asked[1:n], '/'), '') AS dir FROM a, unnest(range(0, len(asked))) AS u(n)),
b AS (SELECT page_id, any_value(asked) AS asked, arg_max(dir, n) AS dir, arg_max(asked[n + 1], n) AS missing FROM s SEMI JOIN dirs USING (dir) GROUP BY page_id)
SELECT page_id, 'index: no such path ' || array_to_string(asked, '/') || ' — `' || missing || '` is not in ' || CASE WHEN dir = '' THEN 'the workspace root' ELSE dir || '/' END || ', which contains: ' || array_to_string(ks[:50], '  ')
       || CASE WHEN len(ks) > 50 THEN '  … and ' || (len(ks) - 50) || ' more (' || len(ks) || ' total). Use `glob` if the file you want is not listed.' ELSE '' END AS message
FROM b JOIN l USING (dir)""",
        "page_skeletons": f"""
WITH {PAGES}, q AS (SELECT page_id, host || '/' || (page_id // 500) AS folder, list_append(rel, lpad(CAST(page_id AS VARCHAR), 12, '0') || '.log') AS rel, html, {lines('html')} AS ls FROM p),
f AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: {strip('ls[i]')} <> '') AS full_, list_filter(range(1, len(ls) + 1), lambda i: contains(ls[i], 'ERROR')) AS e, array_to_string([{counts}], ', ') AS found FROM q),
b AS (SELECT folder, rel, array_to_string(rel, '/') || ' (' || {breaks('html')} || ' lines, ' || {human('strlen(html)')} || ')' || chr(10) || '  lines: ' || len(ls) || '   bytes: ' || {human('strlen(html)')} || chr(10)
       || CASE WHEN len(full_) > 0 THEN '  first: [' || full_[1] || '] "' || {clip(strip('ls[full_[1]]'))} || '"' || chr(10) || '  last:  [' || full_[-1] || '] "' || {clip(strip('ls[full_[-1]]'))} || '"' || chr(10) ELSE '' END
       || CASE WHEN found <> '' THEN '  matches: ' || found || CASE WHEN len(e) > 0 THEN '  (first ERROR at [' || e[1] || '])' ELSE '' END || chr(10) ELSE '' END || '  (use `read` offset/limit to page through it)' || chr(10) || chr(10) AS text
  FROM f WHERE page_id % 7 <> 3),
r AS (SELECT *, coalesce(sum(strlen(text)) OVER w, 0) AS before, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY folder ORDER BY rel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT folder, count(*) AS k, string_agg(text, '' ORDER BY rel) AS body FROM r WHERE n < {SKELETON_FILES} AND before < {SKELETON_BYTES} GROUP BY folder),
t AS (SELECT folder, count(*) AS n FROM q GROUP BY folder)
SELECT folder, n AS n_files, coalesce(k, 0) AS n_shown, folder || ' — ' || n || ' supported files' || CASE WHEN coalesce(k, 0) < n THEN ' (showing ' || coalesce(k, 0) || '; index a specific file or subdirectory for the rest)' ELSE '' END || chr(10) || chr(10) || coalesce(body, '') AS text
FROM t LEFT JOIN s USING (folder)""",
        "doc_file_outcome": f"""
WITH d AS (SELECT doc_id, doc_id % {len(FILES)} AS kind, {file_names}[doc_id % {len(FILES)} + 1] AS name, text, {lines('text')} AS ls FROM documents),
f AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: {strip('ls[i]')} <> '') AS full_, list_filter(range(1, len(ls) + 1), lambda i: contains(ls[i], 'ERROR')) AS e, array_to_string([{counts}], ', ') AS found, coalesce(ls[1], '') AS head FROM d),
g AS (SELECT *, greatest(len(head) - len(replace(head, chr(9), '')), len(head) - len(replace(head, ';', '')), len(head) - len(replace(head, ',', ''))) AS most FROM f),
h AS (SELECT *, CASE WHEN len(head) - len(replace(head, ',', '')) = most THEN ',' WHEN len(head) - len(replace(head, ';', '')) = most THEN ';' ELSE chr(9) END AS delim FROM g),
c AS (SELECT *, string_split(head, delim) AS cols FROM h),
k AS (SELECT *, head <> '' AND len(list_filter(cols, lambda x: NOT regexp_full_match(lower({strip('x')}), '{number}'))) > 0 AS named, array_to_string(list_transform(cols, lambda x: {strip('x')}), ', ') AS names FROM c)
SELECT doc_id, kind IN (2, 4) AS is_error, CASE kind
  WHEN 0 THEN name || chr(10) || '  lines: ' || len(ls) || '   bytes: ' || {human('strlen(text)')} || chr(10)
       || CASE WHEN len(full_) > 0 THEN '  first: [' || full_[1] || '] "' || {clip(strip('ls[full_[1]]'))} || '"' || chr(10) || '  last:  [' || full_[-1] || '] "' || {clip(strip('ls[full_[-1]]'))} || '"' || chr(10) ELSE '' END
       || CASE WHEN found <> '' THEN '  matches: ' || found || CASE WHEN len(e) > 0 THEN '  (first ERROR at [' || e[1] || '])' ELSE '' END || chr(10) ELSE '' END || '  (use `read` offset/limit to page through it)' || chr(10)
  WHEN 1 THEN name || chr(10) || CASE WHEN named THEN '  header: ' || {clip('names')} || ' (' || len(cols) || ' columns)' ELSE '  header: (none detected) — ' || len(cols) || ' columns' END || chr(10)
       || '  ~' || CASE WHEN named THEN greatest(len(ls) - 1, 0) ELSE len(ls) END || ' rows (delimiter: "' || CASE WHEN delim = chr(9) THEN '\\t' ELSE delim END || '")' || chr(10) || '  (~rows is a raw line count; use `read` offset/limit to page)' || chr(10)
  WHEN 2 THEN 'index: unsupported file type ".zig" — no tree-sitter grammar for it. Fall back to `read` for this file.'
  WHEN 3 THEN name || chr(10) || '  (looks binary — use `read`)' || chr(10)
  ELSE 'index: cannot read ' || name || '. Fall back to `read`.' END AS text FROM k""",
    }
