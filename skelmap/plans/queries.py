"""The driver's queries over the test tables: each operator over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import extension, format_of
from ..functions.redact import is_plain, is_sensitive_key, must_redact, value_looks_secret
from ..functions.text import base_name, clip, first_line, human_bytes, line_count, lines, looks_numeric, quote_clip, squash
from ..operators import directory, line_formats, outline
from ..operators.limits import capped, first_rows, greedy_budget, ranked, within_budget
from ..sources.tables import read_table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")


def doc_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", line_count(text).alias("n_breaks"), F.size(lines(text)).cast("long").alias("n_lines"))


def doc_text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_formats.log_digest(_docs(spark, sf_dir)).withColumnRenamed("file_id", "doc_id")


def doc_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    head = first_line(F.col("text"))
    return docs.select("doc_id", F.length(squash(F.col("text"))).cast("long").alias("squashed"), clip(squash(F.col("text"))).alias("clipped"), head.alias("head"), quote_clip(head).alias("quoted"), human_bytes(F.col("doc_id") * F.col("doc_id") * 37).alias("size_text"), looks_numeric(F.split(head, " ")[0]).alias("numeric"))


def doc_csv_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_formats.csv_digest(_docs(spark, sf_dir)).withColumnRenamed("file_id", "doc_id")


def _line_decls(decls: DataFrame) -> DataFrame:
    return decls.select(F.col("file_id").alias("doc_id"), (F.col("start") + 1).alias("first"), (F.col("end") + 1).alias("last"), F.col("indent").cast("long").alias("indent"), "text")


def doc_env_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_decls(line_formats.env_decls(_docs(spark, sf_dir)))


def doc_ini_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_decls(line_formats.ini_decls(_docs(spark, sf_dir)))


def _conversation_files(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    """Each conversation as a file of one line a turn."""
    files = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("ls"))
    return files.select(F.col("conv_id").alias("file_id"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))


def conv_make_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as makefiles: a user turn is a target, an assistant turn its recipe, a system turn a variable."""
    head = F.split("text", "\n")[0]
    line = F.when(F.col("role") == "user", F.concat(F.lit("t"), "turn", F.lit(": "), head)).when(F.col("role") == "system", F.concat(F.lit("V"), "turn", F.lit(" := "), head)).otherwise(F.concat(F.lit("\t"), head))
    return _line_decls(line_formats.make_decls(_conversation_files(spark, sf_dir, line))).withColumnRenamed("doc_id", "conv_id")


def conv_docker_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as build files: a user turn begins a stage, an assistant turn runs in it, a system turn sets variables."""
    word = F.when(F.col("role") == "user", "FROM ").when(F.col("role") == "assistant", "run ").otherwise("ENV A=1 B=")
    files = _conversation_files(spark, sf_dir, F.concat(word, F.split("text", "\n")[0]))
    return _line_decls(line_formats.docker_decls(files)).withColumnRenamed("doc_id", "conv_id")


def doc_secret_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each `name = value` of each document, judged by name and by value; none gives no row."""
    docs = read_table(spark, sf_dir, "documents")
    # possessive, and from the start of a word: each word is tried once; \S would end a value at a vertical tab too, which the SQL's does not
    binding = r"(?<![A-Za-z_])([A-Za-z_]++) *+[=:] *+([^ \t\n\f\r]++)"
    rows = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(binding), 0)).alias("b"))
    rows = rows.select("doc_id", F.regexp_extract("b", binding, 1).alias("k"), F.regexp_extract("b", binding, 2).alias("v"))
    return rows.select("doc_id", "k", is_sensitive_key(F.col("k")).alias("sensitive"), value_looks_secret(F.concat("k", F.lit("="), "v")).alias("secret"), is_plain(F.col("v")).alias("plain"), must_redact(F.col("k"), F.col("v")).alias("redact"))


def event_log_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a log in the order of time: counts by word, first and last line, number of the first error line.

    All are aggregates that combine before the shuffle; the number of the first error counts the lines before it.
    """
    e = read_table(spark, sf_dir, "events").select("user_id", F.upper("event_type").alias("line"), F.struct("ts", "event_id").alias("at"))
    is_error = F.col("line").contains("ERROR")
    out = e.groupBy("user_id").agg(
        F.count("*").alias("n_lines"),
        F.count_if(is_error).alias("error"),
        F.count_if(F.col("line").contains("WARN")).alias("warn"),
        F.min_by("line", "at").alias("first_text"),
        F.max_by("line", "at").alias("last_text"),
        F.min(F.when(is_error, F.col("at"))).alias("first_error"),
    )
    firsts = out.where("first_error IS NOT NULL").select(F.col("user_id").alias("u"), F.col("first_error").alias("f"))
    before = e.join(firsts, (F.col("user_id") == F.col("u")) & (F.col("at") <= F.col("f"))).groupBy("u").agg(F.count("*").alias("first_error_row"))
    return out.join(before, F.col("user_id") == F.col("u"), "left").select("user_id", "n_lines", "error", "warn", "first_text", "last_text", "first_error_row")


def event_props_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline of each event's JSON properties at depth 1: declarations as text."""
    files = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("file_id"), F.lit("JSON").alias("fmt"), F.col("props").alias("text"))
    out = outline.grammar_decls(files, 1)
    return out.select(F.col("file_id").alias("event_id"), F.array_join(F.transform("decls", lambda d: F.concat(F.repeat(F.lit(" "), d["indent"]), d["text"])), "\n").alias("outline"))


def _rel(url: Column) -> Column:
    """Host and path of an address, as components."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?d)[?#].*\z", ""), "^[a-z]+://", "")
    return F.filter(F.split(bare, "/"), lambda x: x != "")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages").withColumn("full", _rel(F.col("url")))
    return p.select("page_id", "url", "html", F.col("full")[0].alias("host"), F.slice("full", F.lit(2), F.lit(1 << 30)).alias("rel"), F.octet_length("html").cast("long").alias("size"))


def page_links_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = capped(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1), 4)
    return read_table(spark, sf_dir, "pages").select("page_id", F.array_join(links, "|").alias("links"))


def page_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of first-level headings in each page, and their text."""
    head = F.regexp_extract("html", "(?s)^(.*?)<h1>", 1)
    row = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    return read_table(spark, sf_dir, "pages").select("page_id", F.when(F.col("html").contains("<h1>"), row + 1).cast("long").alias("h1_row"), clip(squash(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1))).alias("h1"))


def page_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _pages(spark, sf_dir).withColumn("rel", F.concat(F.array("host"), F.col("rel")))
    return directory.rollup(files).select("label", "n_files", "bytes", "line")


def page_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.scale(_pages(spark, sf_dir), ["host"]).select("host", "n_files", "n_dirs", "bytes", "tier")


def _map_tier(pages: DataFrame) -> DataFrame:
    """Pages of the hosts that are small enough to be mapped file by file."""
    small = pages.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") <= directory.MAP_FILES).select("host")
    return pages.join(small, "host", "left_semi")


def page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _map_tier(_pages(spark, sf_dir))
    return pages.select("page_id", directory.map_line(F.col("rel"), line_count(F.col("html")), F.col("size")).alias("line"))


def page_read_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each host which pages are read, in the order of their ids, within 12,000 bytes; pages over 9,000 can't be read."""
    each = _map_tier(_pages(spark, sf_dir)).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("page_id", "size"))).alias("files"))
    read = greedy_budget(F.transform("files", lambda f: f["size"]), 12_000, 9_000)
    out = each.select("host", F.explode(F.arrays_zip("files", read.alias("r"))).alias("x"))
    return out.select("host", F.col("x.files.page_id").alias("page_id"), F.col("x.files.size").alias("size"), F.col("x.r.read").alias("is_read"), F.col("x.r.skipped").alias("skipped"))


def page_order_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each page of a host by the components of its path; an address without components has no host."""
    full = read_table(spark, sf_dir, "pages").select("page_id", _rel(F.col("url")).alias("full"))
    pages = full.select("page_id", F.get("full", F.lit(0)).alias("host"), F.slice("full", F.lit(2), F.lit(1 << 30)).alias("rel"))
    return ranked(pages, "host", ["rel", "page_id"], "place").select("page_id", "host", "place")


def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML outlines of all pages at depth 1."""
    files = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.lit("page.html").alias("name"), F.lit("HTML").alias("fmt"), F.col("html").cast("binary").alias("content"))
    return outline.outline(files, 1).select(F.col("file_id").alias("page_id"), "text", "is_error")


def doc_markdown_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of the documents as Markdown, each line that begins with a capital and is short as a heading of level 1 to 3."""
    head = F.transform(F.split("text", "\n"), lambda s: F.when(F.length(s) < 40, F.concat(F.repeat(F.lit("#"), F.length(s) % 3 + 1), F.lit(" "), s)).otherwise(s))
    files = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.lit("doc.md").alias("name"), F.lit("Markdown").alias("fmt"), F.array_join(head, "\n").cast("binary").alias("content"))
    return outline.outline(files, 2).select(F.col("file_id").alias("doc_id"), "text", "is_error")


def conv_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of turns: a user turn is a header, its section ends before the next one."""
    level = F.when(F.col("role") == "user", 1).otherwise(2)
    t = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), level.alias("level"))
    rows = line_formats.nested_sections(t, ["conv_id"], "turn", "level", levels=1)
    return rows.where("level = 1").select("conv_id", "turn", F.col("end").alias("end_turn"))


def conv_nested_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and span of turns as headings whose level is the length of their text modulo 6, plus 1."""
    t = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("row"), (F.length("text") % 6 + 1).alias("level"))
    out = line_formats.nested_sections(t, ["conv_id"], "row", "level")
    return out.select("conv_id", F.col("row").alias("turn"), F.col("level").cast("long").alias("level"), F.col("depth").cast("long").alias("depth"), F.col("end").alias("end_turn"))


def decl_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 lines of each supplier, in the order of orders, and whether there are more."""
    rows = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    kept = first_rows(rows, ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber")], 501)
    some = F.col("nth") <= 500
    return kept.groupBy("l_suppkey").agg(F.count_if(some).alias("kept"), (F.max("nth") > 500).alias("truncated"), F.max(F.when(some, F.col("l_orderkey"))).alias("last_order"), F.sum(F.when(some, F.col("l_linenumber"))).cast("long").alias("sum_lines"))


def skeleton_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source that are shown: at most 200, in the order of ids, while those before are under 256 KiB."""
    docs = read_table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    shown = within_budget(docs, ["source"], [F.col("doc_id")], "bytes", directory.MAX_SHOWN_FILES, directory.MAX_SHOWN_BYTES)
    return shown.select("source", "doc_id", "bytes")


def path_miss_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's path with its last or its last two components replaced: the deepest folder that exists, and what is missing."""
    pages = _pages(spark, sf_dir).select("page_id", F.concat(F.array("host"), F.col("rel")).alias("rel"))
    depth = F.greatest(F.size("rel") - 1 - (F.col("page_id") % 2).cast("int"), F.lit(0))
    asked = pages.select("page_id", F.concat(F.slice("rel", F.lit(1), depth), F.array(F.lit("nowhere"), F.lit("x.py"))).alias("rel"))
    return directory.nearest_ancestors(asked, directory.folders(pages), "page_id").drop("rel")


def format_of_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    base = F.coalesce(base_name(F.array_join("rel", "/")), F.lit(""))
    return pages.select("page_id", base.alias("base"), extension(base).alias("ext"), format_of(base).alias("format"))


_ALL = (doc_line_count, doc_text_summary, doc_text_functions, doc_csv_sniff, doc_env_keys, doc_ini_keys, conv_make_targets, conv_docker_stages, doc_secret_bindings, event_log_severity, event_props_keys, page_links_capped, page_landmarks, page_rollup, page_tier, page_map, page_read_budget, page_order_all, page_outline, doc_markdown_outline, conv_sections, conv_nested_sections, decl_cap, skeleton_budget, path_miss_ancestor, format_of_url)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .grammar_queries import grammar_queries
    from .line_queries import line_queries
    from .request_queries import request_queries

    return {f.__name__: f for f in _ALL} | grammar_queries() | line_queries() | request_queries()


def oracle_sql() -> dict[str, str]:
    from .line_queries import line_sql
    from .request_queries import request_sql
    from .sql import ORACLES

    return ORACLES | line_sql() | request_sql()
