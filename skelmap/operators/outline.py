"""Outlines of files: imports and declarations of each, and their rendering."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import GRAMMARS, extension
from ..functions.parse import MAX_DECLS, parse
from ..functions.text import base_name
from . import line_formats

MAX_DEPTH = 8
MAX_FILE_BYTES = 2 * 1024 * 1024
DECLS = "array<struct<start:bigint,end:bigint,indent:int,text:string>>"

# The messages.
NOTHING = {
    "dotenv": "  (no keys found)\n",
    "INI": "  (no sections or keys found)\n",
    "Makefile": "  (no targets or variables found)\n",
    "Dockerfile": "  (no instructions found)\n",
}
VALUES_OMITTED = "  (values omitted — .env may contain secrets)\n"
TOO_LARGE = "index: file is %d bytes (> 2 MB limit) — too large to outline. Fall back to `read` (use offset/limit to page through it)."
UNSUPPORTED = 'index: unsupported file type ".%s" — no tree-sitter grammar for it. Fall back to `read` for this file.'
UNREADABLE = "index: cannot read %s. Fall back to `read`."
NO_DECLS = "  (no imports or top-level declarations found)\n"
BINARY = "  (looks binary — use `read`)\n"
CSV_HEAD, CSV_NO_HEAD = "  header: %s (%d columns)\n", "  header: (none detected) — %d columns\n"
CSV_ROWS, CSV_FOOT = '  ~%d rows (delimiter: "%s")\n', "  (~rows is a raw line count; use `read` offset/limit to page)\n"
LOG_HEAD, LOG_FIRST, LOG_LAST = "  lines: %d   bytes: %s\n", "  first: [%d] %s\n", "  last:  [%d] %s\n"
LOG_MATCHES, LOG_ERROR, LOG_FOOT = "  matches: ", "  (first ERROR at [%d])", "  (use `read` offset/limit to page through it)\n"
TRUNCATED = f"  … (output truncated at {MAX_DECLS} entries — read the file directly for the rest)\n"


def bounded_depth(depth: int | None) -> int:
    return min(max(1 if depth is None else depth, 0), MAX_DEPTH)


def decoded(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def grammar_decls(files: DataFrame, depth: int = 1, parity: bool = False, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """file_id, the columns keep, imports, decls, truncated of files (file_id, fmt, text) that have a grammar; one pass, no shuffle."""
    kept = ["file_id", *keep]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [parse(f, t, depth, parity) for f, t in zip(pdf["fmt"], pdf["text"])]
            decls = [[{"start": a, "end": b, "indent": i, "text": s} for a, b, i, s in x.decls] for x in found]
            yield pd.DataFrame({**{k: pdf[k] for k in kept}, "imports": [x.imports for x in found], "decls": decls, "truncated": [x.truncated for x in found]})

    rows = files.where(F.col("fmt").isin(list(GRAMMARS))).select(*dict.fromkeys([*kept, "fmt", "text"]))
    schema = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in kept)
    return rows.mapInPandas(run, f"{schema}, imports array<string>, decls {DECLS}, truncated boolean")


def _line_body(fmt: Column, ls: Column, parity: bool) -> Column:
    """Text of a dotenv, INI, Make or Docker file: at most 500 declarations."""
    found = F.when(fmt == "dotenv", line_formats.env_list(ls)).when(fmt == "INI", line_formats.ini_list(ls)).when(fmt == "Makefile", line_formats.make_list(ls)).otherwise(line_formats.docker_list(ls, parity))
    table = F.create_map(*[F.lit(x) for pair in NOTHING.items() for x in pair])
    foot = F.when(fmt == "dotenv", VALUES_OMITTED).otherwise("")
    some = lambda d: F.concat(decl_lines(F.slice(d, 1, MAX_DECLS), F.size(d) > MAX_DECLS), foot)
    return F.transform(F.array(found), lambda d: F.when(F.size(d) == 0, table[fmt]).otherwise(some(d)))[0]


def decl_lines(decls: Column, truncated: Column) -> Column:
    """Declarations as text: two spaces and two a level, the range from 1 padded to 10, the text."""

    def line(d: Column) -> Column:
        span = F.format_string("[%d-%d]", d["start"] + 1, d["end"] + 1)
        return F.concat(F.repeat(F.lit("  "), d["indent"] + 1), F.rpad(span, F.greatest(F.length(span), F.lit(10)), F.lit(" ")), F.lit(" "), d["text"], F.lit("\n"))

    return F.concat(F.array_join(F.transform(decls, line), ""), F.when(truncated, TRUNCATED).otherwise(""))


def _csv_text() -> Column:
    head = F.when(F.col("header").isNull(), F.format_string(CSV_NO_HEAD, "n_cols")).otherwise(F.format_string(CSV_HEAD, "header", "n_cols"))
    return F.concat(head, F.format_string(CSV_ROWS, "n_rows", "delimiter"), F.lit(CSV_FOOT))


def _log_text() -> Column:
    found = F.array_join(F.array_compact(F.array(*[F.when(F.col(w.lower()) > 0, F.concat(F.col(w.lower()).cast("string"), F.lit(f" {w}"))) for w in line_formats.SEVERITIES])), ", ")
    error = F.when(F.col("first_error_row").isNull(), "").otherwise(F.format_string(LOG_ERROR, "first_error_row"))
    matches = F.when(found == "", "").otherwise(F.concat(F.lit(LOG_MATCHES), found, error, F.lit("\n")))
    ends = F.when(F.col("first_row").isNull(), "").otherwise(F.concat(F.format_string(LOG_FIRST, "first_row", "first_text"), F.format_string(LOG_LAST, "last_row", "last_text")))
    return F.concat(F.format_string(LOG_HEAD, "n_lines", "size_text"), ends, matches, F.lit(LOG_FOOT))


def _grammar_scan(depth: int, parity: bool) -> Callable[..., Column]:
    @F.pandas_udf(f"imports array<string>, decls {DECLS}, truncated boolean")
    def scan(fmt: pd.Series, text: pd.Series) -> pd.DataFrame:
        found = [None if t is None else parse(f, t, depth, parity) for f, t in zip(fmt, text)]
        decls = [x and [{"start": a, "end": b, "indent": i, "text": s} for a, b, i, s in x.decls] for x in found]
        return pd.DataFrame({"imports": [x and x.imports for x in found], "decls": decls, "truncated": [x and x.truncated for x in found]})

    return scan


def outline(files: DataFrame, depth: int | None = 1, parity: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Outline of files (file_id, name, fmt, content): file_id, the columns keep, name, fmt, text, is_error.

    name heads the text. Files over 2 MiB, without content or of no known format get a message and is_error. With parity,
    quirks stay that are mended otherwise (README). One pass over the files, without a join or shuffle: only texts of grammars go to Python
    workers, and a row's format chooses the expression that is worked out. file_id may be null or repeated.
    """
    size, fmt = F.length("content").cast("long"), F.col("fmt")
    is_grammar = fmt.isin(list(GRAMMARS))
    good = F.coalesce((size <= MAX_FILE_BYTES) & fmt.isNotNull(), F.lit(False))
    rows = files.select("file_id", *keep, "name", "fmt", "content", size.alias("size"), good.alias("_good"), (good & ~is_grammar & line_formats.looks_binary(F.col("content"))).alias("_binary"))
    text = F.when(F.col("_good") & ~F.col("_binary"), decoded(F.col("content")))
    rows = rows.select(*keep, "file_id", "name", "fmt", "size", "_good", "_binary", F.col("content").isNull().alias("_unread"), text.alias("text"))
    kept = [*keep, "name", "fmt", "size", "_good", "_binary", "_unread"]

    scan = _grammar_scan(bounded_depth(depth), parity)
    rows = rows.withColumn("_g", scan("fmt", F.when(is_grammar, F.col("text"))))
    g = F.col("_g")
    imports = F.when(F.size(g["imports"]) > 0, F.concat(F.lit("  imports: "), F.array_join(g["imports"], ", "), F.lit("\n"))).otherwise("")
    nothing = F.when((F.size(g["imports"]) == 0) & (F.size(g["decls"]) == 0), NO_DECLS).otherwise("")
    scanned = F.transform(F.array(line_formats.lines(F.col("text"))), lambda ls: _line_body(fmt, ls, parity))[0]
    body = F.when(is_grammar, F.concat(imports, decl_lines(g["decls"], g["truncated"]), nothing)).when(F.col("_binary"), BINARY).when(fmt.isin(list(NOTHING)), scanned)
    rows = rows.select("file_id", *kept, F.when(~fmt.isin(*GRAMMARS, *NOTHING), F.col("text")).alias("text"), F.when(F.col("_good"), body).alias("_body"))

    logs = F.when(fmt == "log/text", F.col("text"))
    rows = line_formats.csv_digest(rows.withColumn("_log", logs).withColumn("text", F.when(fmt == "CSV", F.col("text"))), [*kept, "_body", "_log"])
    rows = rows.select("file_id", *kept, F.coalesce("_body", F.when(F.col("_good") & (fmt == "CSV"), _csv_text())).alias("_body"), F.col("_log").alias("text"))
    rows = line_formats.log_digest(rows, [*kept, "_body"])
    rows = rows.withColumn("_body", F.coalesce("_body", F.when(F.col("_good") & (fmt == "log/text"), _log_text())))

    message = (
        F.when(F.col("_unread"), F.format_string(UNREADABLE, "name"))
        .when(F.col("size") > MAX_FILE_BYTES, F.format_string(TOO_LARGE, "size"))
        .otherwise(F.format_string(UNSUPPORTED, extension(base_name(F.col("name")))))
    )
    return rows.select("file_id", *keep, "name", "fmt", F.when(F.col("_good"), F.concat("name", F.lit("\n"), "_body")).otherwise(message).alias("text"), (~F.col("_good")).alias("is_error"))
