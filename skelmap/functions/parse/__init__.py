"""Outlines of structured text in plain Python: what a worker runs for each file that has a grammar.

parse(format, text, depth) gives an Outline: imports and, in the order of the text, declarations with their rows (from 0).
Scanners are lenient: broken input gives the parts that can be told, never an error.
"""

from __future__ import annotations

from . import braces, data, markup, scripts
from .base import MAX_DECLS, MAX_IMPORTS, Outline

_SCANNERS = {
    "JSON": data.json_outline,
    "YAML": data.yaml_outline,
    "TOML": data.toml_outline,
    "XML": markup.xml_outline,
    "HTML": markup.html_outline,
    "CSS": markup.css_outline,
    "Markdown": markup.markdown_outline,
    "Python": scripts.python_outline,
    "Ruby": scripts.ruby_outline,
    "Shell": scripts.shell_outline,
    **{name: braces.scanner(name) for name in ("Go", "Rust", "JavaScript", "TypeScript", "TSX", "Java", "C", "C++")},
}

__all__ = ["MAX_DECLS", "MAX_IMPORTS", "Outline", "parse"]


def parse(fmt: str, text: str, depth: int = 1, parity: bool = False) -> Outline:
    """Outline of text; with parity, quirks stay that are mended otherwise (see the README)."""
    out = Outline(text, depth, parity)
    _SCANNERS[fmt](out)
    return out
