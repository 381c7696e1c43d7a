"""Outlines of line formats: keys, sections, targets and stages as rows; digests of delimited data and logs.

Input is a table of files with file_id and text. Declarations and digests come from arrays of lines, in one pass without a
shuffle; what follows a row is found by bisection of the rows of headers. `nested_sections` does the same for rows of a table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.redact import value_looks_secret
from ..functions.text import clip, human_bytes, lines, looks_numeric, quote_clip, squash, stripped

DECL = "struct<start:bigint,end:bigint,indent:int,text:string>"

# Dockerfile instructions and the words that a log is searched for.
INSTRUCTIONS = "FROM RUN CMD LABEL EXPOSE ENV ADD COPY ENTRYPOINT VOLUME USER WORKDIR ARG ONBUILD STOPSIGNAL HEALTHCHECK SHELL".split()
SEVERITIES = ["ERROR", "WARN", "FATAL", "panic", "Traceback"]


def looks_binary(content: Column) -> Column:
    """A zero byte among the first 8192."""
    return F.locate("\x00", F.substring(content, 1, 8192).cast("string")) > 0


def nested_sections(headings: DataFrame, by: list[str], row: str, level: str, last: Column | None = None, levels: int = 6, block: int = 1 << 16) -> DataFrame:
    """Depth and end of nested sections: headings of level 1 to `levels` in the order of row, a group of any size.

    depth counts the enclosing headings: for each lower level, its last heading before this one encloses it if no heading of
    a lower level came after. A section ends before the next heading of its level or a lower one, else at `last`, by default the last
    row of the group. Rows of a higher level than `levels` bound nothing.

    A group is taken in blocks of `block` row numbers, each a group of the windows. Of other blocks a heading needs, for each level, only the
    last row before its block and the first one after it; those are worked out from one row a block, and stand in the block as rows of
    their own, at most 2 * levels + 1, until its windows are done. So a task holds no group, but a block, or one row for each block of a group. What
    follows is found in the opposite order, so that time is linear. Row numbers are whole; null ones, and null groups, stand like any others. Rows of one number
    are of one block, and are taken in the order of their levels. An empty table gives no rows.
    """
    ks = range(1, levels + 1)
    kind = headings.schema[row].dataType
    mine = {k: F.when(F.col(level) == k, F.col(row)) for k in ks}
    out = headings.withColumn("_block", F.floor(F.col(row) / block).cast("long"))
    blocks = out.groupBy(*by, "_block").agg(*[F.max(mine[k]).alias(f"_hi{k}") for k in ks], *[F.min(mine[k]).alias(f"_lo{k}") for k in ks], F.max(row).alias("_hi"))
    before, after = _around([*by], [F.col("_block")], [F.col("_block").desc()])
    place = lambda at, k: F.struct(at.cast(kind).alias("_r"), F.lit(k).alias("_k"))
    edges = [place(F.max(f"_hi{k}").over(before), k) for k in ks] + [place(F.min(f"_lo{k}").over(after), k) for k in ks] + [place(F.max("_hi").over(after), levels + 1)]
    edges = blocks.select(*by, "_block", F.array(*edges).alias("_xs")).select(*by, "_block", F.explode(F.filter("_xs", lambda x: x["_r"].isNotNull())).alias("_x"))
    edges = edges.select(*by, "_block", F.col("_x._r").alias(row), F.col("_x._k").cast(headings.schema[level].dataType).alias(level), F.lit(True).alias("_edge"))

    rows = out.withColumn("_edge", F.lit(False)).unionByName(edges, allowMissingColumns=True)
    before, after = _around([*by, "_block"], [F.col(row), F.col(level)], [F.col(row).desc(), F.col(level).desc()])
    rows = rows.select("*", *[F.coalesce(F.max(mine[k]).over(before), F.lit(-1)).alias(f"_p{k}") for k in ks], *[F.min(mine[k]).over(after).alias(f"_n{k}") for k in ks], F.max(row).over(Window.partitionBy(*by, "_block")).alias("_last"))
    depth = F.lit(0)
    for k in range(1, levels):
        lower = [F.col(f"_p{m}") for m in range(1, k)] + [F.lit(0), F.lit(0)]
        depth = depth + F.when((F.col(level) > k) & (F.col(f"_p{k}") >= F.greatest(*lower)), 1).otherwise(0)
    ends = F.least(*[F.when(F.col(level) >= k, F.col(f"_n{k}")) for k in ks], F.lit(None).cast("long"))
    end = F.greatest(F.coalesce(ends - 1, F.col("_last") if last is None else last), F.col(row))
    return rows.where(~F.col("_edge")).select(*headings.columns, depth.cast("int").alias("depth"), end.alias("end"))


def _around(by: list[str], order: list[Column], reverse: list[Column]) -> tuple[WindowSpec, WindowSpec]:
    """Windows over the rows of a group before a row and after it; the latter in the opposite order, as Spark goes over a frame that ends with the group anew for each row."""
    frame = (Window.unboundedPreceding, -1)
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(*frame), Window.partitionBy(*by).orderBy(*reverse).rowsBetween(*frame)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _after(rows: Column, row: Column) -> Column:
    """The first of ascending rows that is after row, by bisection; null if none is."""
    steps = F.array(*[F.lit(1 << k) for k in range(29, -1, -1)])
    n = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.coalesce(F.try_element_at(rows, lo + step) <= row, F.lit(False)), lo + step).otherwise(lo))
    return F.try_element_at(rows, n + 1)


def _decl(start: Column, end: Column, indent: Column, text: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), indent.cast("int").alias("indent"), text.alias("text"))


def _each(items: Column, **fields: Callable[[Column], Column]) -> Column:
    """Structs of items with more fields; a field may use those of the items."""
    return F.transform(items, lambda x: F.struct(x["row"].alias("row"), x["line"].alias("line"), x["t"].alias("t"), *[f(x).alias(name) for name, f in fields.items()]))


def _rows(ls: Column) -> Column:
    """Lines as structs of row (from 0), line and t, the line without white space at its ends."""
    return F.transform(ls, lambda s, i: F.struct(i.alias("row"), s.alias("line"), stripped(s).alias("t")))


def _sections(rows: Column, n_lines: Column, is_head: Callable[[Column], Column], body: Callable[[Column, Callable[[Column], Column]], Column]) -> Column:
    """body(rows, end), where end(x) is the row before the next header after x, or the last row."""
    heads = lambda r: F.transform(F.filter(r, is_head), lambda x: x["row"])
    return _let(rows, lambda r: _let(heads(r), lambda h: body(r, lambda x: F.greatest(x["row"], F.coalesce(_after(h, x["row"]) - 1, n_lines - 1)))))


def env_list(ls: Column) -> Column:
    """Names of dotenv bindings, never values."""
    bare = lambda x: F.when(x["t"].startswith("export "), F.regexp_replace(F.substring(x["t"], 8, 1 << 30), r"(?U)^\s+", "")).otherwise(x["t"])
    rows = F.transform(_each(_rows(ls), bare=bare), lambda x: F.struct(x["row"].alias("row"), x["t"].alias("t"), x["bare"].alias("bare"), stripped(F.substring_index(x["bare"], "=", 1)).alias("key")))
    named = F.filter(rows, lambda x: ~x["t"].startswith("#") & x["bare"].contains("=") & (x["key"] != ""))
    return F.transform(named, lambda x: _decl(x["row"], x["row"], F.lit(0), x["key"]))


def ini_list(ls: Column) -> Column:
    """Sections with their spans, and names of keys."""
    head = lambda x: (F.octet_length(x["t"]) > 2) & x["t"].startswith("[") & x["t"].endswith("]")
    rows = _each(_rows(ls), head=head, key=lambda x: stripped(F.regexp_extract(x["t"], "^([^=:]*)[=:]", 1)))

    def body(r: Column, end: Callable[[Column], Column]) -> Column:
        first = F.element_at(F.concat(F.transform(F.slice(F.filter(r, lambda x: x["head"]), 1, 1), lambda x: x["row"]), F.array(F.lit((1 << 31) - 1))), 1)
        spoken = F.filter(r, lambda x: (x["t"] != "") & ~x["t"].startswith(";") & ~x["t"].startswith("#") & (x["head"] | (x["key"] != "")))
        return _let(first, lambda at: F.transform(spoken, lambda x: F.when(x["head"], _decl(x["row"], end(x), F.lit(0), clip(x["t"]))).otherwise(_decl(x["row"], x["row"], (x["row"] > at).cast("int"), clip(x["key"])))))

    return _sections(rows, F.size(ls), lambda x: x["head"], body)


def make_list(ls: Column) -> Column:
    """Make targets with the span to the next target, and names of variables."""

    def target(x: Column) -> Column:
        line = x["line"]
        name = stripped(F.substring_index(line, ":", 1))
        return ~line.rlike("^[ \t]") & (x["t"] != "") & line.contains(":") & ~line.rlike("^[^:]*(:=|::=)") & (name != "") & ~name.contains("=")

    def is_variable(x: Column) -> Column:
        return ~x["line"].rlike("^[ \t]") & x["line"].contains("=") & (x["variable"] != "") & ~x["variable"].rlike(r"(?U)\s")

    def body(r: Column, end: Callable[[Column], Column]) -> Column:
        wanted = F.filter(r, lambda x: ~x["line"].startswith("\t") & ~x["line"].rlike(r"(?U)^\s*#") & (x["target"] | is_variable(x)))
        return F.transform(wanted, lambda x: F.when(x["target"], _decl(x["row"], end(x), F.lit(0), clip(squash(x["line"])))).otherwise(_decl(x["row"], x["row"], F.lit(0), clip(F.concat(x["variable"], F.lit(" ="))))))

    rows = _each(_rows(ls), target=target, variable=lambda x: stripped(F.regexp_replace(F.substring_index(x["line"], "=", 1), r"(?<![:?+!])[:?+!]++$", "")))
    return _sections(rows, F.size(ls), lambda x: x["target"], body)


def docker_list(ls: Column, parity: bool = False) -> Column:
    """Build stages with their spans, and the instructions in them; names only of ENV and ARG.

    An instruction whose text looks like a secret is shown by its name only, and `ENV NAME value` without its value;
    with parity both are shown as they stand.
    """

    def names(word: Column, words: Column) -> Column:
        found = F.filter(F.transform(words, lambda w: F.substring_index(w, "=", 1)), lambda w: w != "")
        if parity:
            return found
        bare = F.array_compact(F.array(F.try_element_at(words, F.lit(1))))
        return F.when(F.size(words) == 0, words).when(words[0].contains("="), F.transform(F.filter(words, lambda w: w.rlike("^[A-Za-z_][A-Za-z0-9_]*=")), lambda w: F.substring_index(w, "=", 1))).when(word == "ENV", bare).otherwise(found)

    def text(x: Column) -> Column:
        words = F.slice(F.split(squash(x["t"]), " "), F.lit(2), F.lit(1 << 30))
        shown = squash(x["t"])
        if not parity:
            shown = F.when(value_looks_secret(shown), F.concat(x["word"], F.lit(" <redacted>"))).otherwise(shown)
        return clip(F.when(x["word"].isin("ENV", "ARG"), _let(words, lambda w: F.concat(x["word"], F.lit(" "), F.array_join(names(x["word"], w), " ")))).otherwise(shown))

    def body(r: Column, end: Callable[[Column], Column]) -> Column:
        stage = lambda x: x["word"] == "FROM"
        first = F.element_at(F.concat(F.transform(F.slice(F.filter(r, stage), 1, 1), lambda x: x["row"]), F.array(F.lit((1 << 31) - 1))), 1)
        wanted = F.filter(r, lambda x: ~x["t"].startswith("#") & x["word"].isin(INSTRUCTIONS))
        return _let(first, lambda at: F.transform(wanted, lambda x: _decl(x["row"], F.when(stage(x), end(x)).otherwise(x["row"]), F.when(stage(x), 0).otherwise((x["row"] >= at).cast("int")), text(x))))

    rows = _each(_rows(ls), word=lambda x: F.upper(F.regexp_extract(x["t"], r"(?U)^(\S+)", 1)))
    return _sections(rows, F.size(ls), lambda x: F.upper(F.regexp_replace(x["line"], r"(?U)^\s+", "")).startswith("FROM "), body)


def _decls(files: DataFrame, scan: Callable[[Column], Column]) -> DataFrame:
    """file_id, start, end, indent, text of each declaration; no shuffle."""
    return files.select("file_id", F.inline(_let(lines(F.col("text")), scan)))


def env_decls(files: DataFrame) -> DataFrame:
    return _decls(files, env_list)


def ini_decls(files: DataFrame) -> DataFrame:
    return _decls(files, ini_list)


def make_decls(files: DataFrame) -> DataFrame:
    return _decls(files, make_list)


def docker_decls(files: DataFrame, parity: bool = False) -> DataFrame:
    return _decls(files, lambda ls: docker_list(ls, parity))


def csv_digest(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """header (null if the first line is all numbers or empty), n_cols, n_rows, delimiter of each file."""
    rows = files.select("file_id", *keep, lines(F.col("text")).alias("ls"))
    rows = rows.select("file_id", *keep, F.size("ls").cast("long").alias("total"), F.coalesce(F.try_element_at("ls", F.lit(1)), F.lit("")).alias("first"))
    tab, semi, comma = (F.length("first") - F.length(F.replace("first", F.lit(c), F.lit(""))) for c in ("\t", ";", ","))
    most = F.greatest(tab, semi, comma)
    rows = rows.withColumn("d", F.when((most == 0) | (comma == most), ",").when(semi == most, ";").otherwise("\t"))
    rows = rows.withColumn("cols", F.split("first", F.concat(F.lit("["), F.col("d"), F.lit("]")), F.lit(-1)))
    head = (F.col("first") != "") & ~F.forall("cols", looks_numeric)
    names = clip(F.array_join(F.transform("cols", stripped), ", "))
    return rows.select(
        "file_id",
        *keep,
        F.when(head, names).alias("header"),
        F.size("cols").cast("long").alias("n_cols"),
        F.when(head, F.greatest(F.col("total") - 1, F.lit(0))).otherwise(F.col("total")).cast("long").alias("n_rows"),
        F.when(F.col("d") == "\t", "\\t").otherwise(F.col("d")).alias("delimiter"),
    )


def log_digest(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Line and byte counts, first and last line with text, lines that hold each severity word, first line with ERROR.

    One pass over an array of lines: no explode and no shuffle. files has file_id, text and, if it differs, size.
    """
    size = F.col("size") if "size" in files.columns else F.octet_length("text")
    rows = files.select("file_id", *keep, size.cast("long").alias("bytes"), lines(F.col("text")).alias("ls"))
    full = F.filter(F.transform("ls", lambda s, i: F.struct((i + 1).cast("long").alias("row"), s.alias("s"))), lambda x: stripped(x.s) != "")
    rows = rows.withColumn("full", full)
    first, last = F.try_element_at("full", F.lit(1)), F.try_element_at("full", F.lit(-1))
    counts = [F.size(_holding(w)).cast("long").alias(w.lower()) for w in SEVERITIES]
    error = F.array_position(F.transform("ls", lambda s: s.contains("ERROR")), True)
    return rows.select(
        "file_id",
        *keep,
        F.size("ls").cast("long").alias("n_lines"),
        "bytes",
        human_bytes(F.col("bytes")).alias("size_text"),
        first["row"].alias("first_row"),
        quote_clip(first["s"]).alias("first_text"),
        last["row"].alias("last_row"),
        quote_clip(last["s"]).alias("last_text"),
        *counts,
        F.when(error > 0, error).cast("long").alias("first_error_row"),
    )


def _holding(word: str) -> Column:
    return F.filter("ls", lambda s: s.contains(word))
