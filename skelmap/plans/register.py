"""The engine's functions in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import formats, redact, text
from ..functions.parse import parse

GRAMMARS = frozenset(formats.GRAMMARS)
OUTLINE = "ord int, start_line int, end_line int, depth int, text string"


class OutlineTable:
    """Declarations of one text; formats without a grammar give no rows."""

    def eval(self, body: str, fmt: str, depth: int):
        if body is not None and fmt in GRAMMARS:
            for n, (start, end, indent, shown) in enumerate(parse(fmt, body, 1 if depth is None else max(0, min(depth, 8))).decls):
                yield n, start + 1, end + 1, indent, shown


FUNCTIONS = {
    "sk_human_bytes": ("n BIGINT", "STRING", lambda: text.human_bytes(F.col("n"))),
    "sk_squash": ("s STRING", "STRING", lambda: text.squash(F.col("s"))),
    "sk_clip": ("s STRING", "STRING", lambda: text.clip(F.col("s"))),
    "sk_line_count": ("s STRING", "BIGINT", lambda: text.line_count(F.col("s"))),
    "sk_looks_numeric": ("s STRING", "BOOLEAN", lambda: text.looks_numeric(F.col("s"))),
    "sk_format": ("path STRING", "STRING", lambda: formats.format_of(text.base_name(F.col("path")))),
    "sk_sensitive_key": ("k STRING", "BOOLEAN", lambda: redact.is_sensitive_key(F.col("k"))),
    "sk_secret_value": ("v STRING", "BOOLEAN", lambda: redact.value_looks_secret(F.col("v"))),
    "sk_redact": ("k STRING, v STRING", "STRING", lambda: F.when(redact.must_redact(F.col("k"), F.col("v")), redact.REDACTED).otherwise(F.col("v"))),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make FUNCTIONS and the table function sk_outline(body, format, depth) known to SQL; their names."""
    for name, (args, kind, make) in FUNCTIONS.items():
        names = [a.split() for a in args.split(", ")]
        frame = spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in names))
        body = frame.select(make().alias("x"))._jdf.queryExecution().analyzed().expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("sk_outline", udtf(OutlineTable, returnType=OUTLINE))
    return [*FUNCTIONS, "sk_outline"]
