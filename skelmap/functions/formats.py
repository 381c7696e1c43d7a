"""Format of a file by its name."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats and their extensions.
GRAMMARS = {
    "Rust": "rs",
    "Go": "go",
    "Python": "py pyi",
    "JavaScript": "js jsx mjs cjs",
    "TypeScript": "ts mts cts",
    "TSX": "tsx",
    "Java": "java",
    "C": "c h",
    "C++": "cc cpp cxx hpp hh hxx",
    "Ruby": "rb",
    "Shell": "sh bash zsh ksh",
    "XML": "xml xsd xsl xslt plist csproj props targets wsdl",
    "HTML": "html htm xhtml",
    "CSS": "css",
    "Markdown": "md markdown",
    "JSON": "json jsonc",
    "YAML": "yaml yml",
    "TOML": "toml",
}
LINE_FORMATS = {
    "dotenv": "env",
    "INI": "ini cfg conf",
    "CSV": "csv tsv",
    "log/text": "log txt",
    "Makefile": "mk make",
    "Dockerfile": "dockerfile",
}
BY_EXTENSION = {e: name for table in (GRAMMARS, LINE_FORMATS) for name, exts in table.items() for e in exts.split()}


def name_extension(base: Column) -> Column:
    """Extension that a whole file name stands for; null for ordinary names."""
    low = F.lower(base)
    return (
        F.when((base == ".env") | base.startswith(".env."), "env")
        .when(low.isin("makefile", "gnumakefile"), "make")
        .when(low.isin("dockerfile", "containerfile") | low.startswith("dockerfile.") | low.startswith("containerfile."), "dockerfile")
    )


def real_extension(base: Column) -> Column:
    """Text after the last dot, but for names without a dot or with none but a leading one."""
    return F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_extract(base, r"\.([^.]*)$", 1)).otherwise("")


def extension(base: Column) -> Column:
    return F.coalesce(name_extension(base), real_extension(base))


def format_of(base: Column) -> Column:
    """Format of a file name; null if it isn't supported."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(BY_EXTENSION.items())])
    return F.try_element_at(table, F.lower(extension(base)))


def py_format_of(base: str) -> str | None:
    low = base.lower()
    if base == ".env" or base.startswith(".env."):
        ext = "env"
    elif low in ("makefile", "gnumakefile"):
        ext = "make"
    elif low in ("dockerfile", "containerfile") or low.startswith(("dockerfile.", "containerfile.")):
        ext = "dockerfile"
    else:
        head, dot, tail = base.rpartition(".")
        ext = tail if dot and head else ""
    return BY_EXTENSION.get(ext.lower())
