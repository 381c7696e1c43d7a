"""Text and size functions: for columns, and plain twins for code that runs in Python workers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SIGNATURE = 200
FLOAT = r"[+-]?(inf(inity)?|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)"
_FLOAT = re.compile(FLOAT + r"\Z", re.I | re.A)


def squash(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" "))


def clip(c: Column) -> Column:
    """At most 200 characters, then an ellipsis."""
    return F.when(F.length(c) > MAX_SIGNATURE, F.concat(F.left(c, F.lit(MAX_SIGNATURE)), F.lit("…"))).otherwise(c)


def stripped(c: Column) -> Column:
    # possessive, and from the start of a run: each run is tried once
    return F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++$", "")


def quote_clip(c: Column) -> Column:
    return F.concat(F.lit('"'), clip(stripped(c)), F.lit('"'))


def first_line(c: Column) -> Column:
    return F.regexp_replace(F.split(c, "\r?\n")[0], r"(?U)\s+$", "")


def human_bytes(n: Column) -> Column:
    """N B, N.N KB or N.N MB; ties of the last digit go to the even one."""
    kb = F.format_string("%.1f KB", F.bround(n / F.lit(1024.0), 1))
    mb = F.format_string("%.1f MB", F.bround(n / F.lit(1048576.0), 1))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, kb).otherwise(mb)


def line_count(c: Column) -> Column:
    """Line breaks, and one more for an unterminated last line."""
    breaks = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return (breaks + F.when((F.length(c) > 0) & ~F.endswith(c, F.lit("\n")), 1).otherwise(0)).cast("long")


def lines(c: Column) -> Column:
    """The lines of a text, without line ends; an empty text has none."""
    parts = F.split(c, "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def looks_numeric(c: Column) -> Column:
    return F.lower(stripped(c)).rlike("^" + FLOAT + "$")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


# --- twins ---------------------------------------------------------------------------------------------------------------


def py_squash(s: str) -> str:
    return " ".join(s.split())


def py_clip(s: str) -> str:
    return s if len(s) <= MAX_SIGNATURE else s[:MAX_SIGNATURE] + "…"


def py_first_line(s: str) -> str:
    return s.split("\n", 1)[0].rstrip()


def py_human_bytes(n: int) -> str:
    if n < 1024:
        return f"{n} B"
    return f"{n / 1024:.1f} KB" if n < 1048576 else f"{n / 1048576:.1f} MB"


def py_is_float(s: str) -> bool:
    return _FLOAT.match(s) is not None


def noun(n: int, one: str, many: str) -> str:
    return one if n == 1 else many
