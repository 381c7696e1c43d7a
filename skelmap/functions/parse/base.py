"""What the scanners share."""

from __future__ import annotations

import re
from bisect import bisect_right

from ..redact import REDACTED, py_must_redact
from ..text import py_clip, py_first_line, py_squash

MAX_DECLS = 500
MAX_IMPORTS = 40
#: Headers are read no further than this.
MAX_HEADER = 4096


class Full(Exception):
    """The declarations are as many as are kept, and nothing else is left to find."""


class Outline:
    """Collects imports and declarations of one text, and knows its rows."""

    def __init__(self, text: str, depth: int, parity: bool):
        self.text, self.depth, self.parity = text, depth, parity
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.found: list[str] = []
        self.decls: list[tuple[int, int, int, str]] = []
        self.truncated = False
        self.stops = False  # does the scan end once the outline is full?

    def row(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1)

    @property
    def last_row(self) -> int:
        return max(0, self.row(len(self.text.rstrip("\n")) if self.text.endswith("\n") else len(self.text)))

    def add(self, start: int, end: int, indent: int, text: str) -> int | None:
        """Declaration by rows; its number, or None if it is beyond those that are kept."""
        if len(self.decls) >= MAX_DECLS:
            self.truncated = True
            if self.stops:
                raise Full
            return None
        self.decls.append((start, max(start, end), indent, py_clip(text)))
        return len(self.decls) - 1

    def amend(self, number: int | None, end: int, text: str) -> None:
        if number is None:
            return
        start, _, indent, _ = self.decls[number]
        self.decls[number] = (start, max(start, end), indent, py_clip(text))

    @property
    def imports(self) -> list[str]:
        """Distinct imports in their order, at most 40 and the number of the others."""
        kept = list(dict.fromkeys(x for x in self.found if x))
        return kept if len(kept) <= MAX_IMPORTS else [*kept[:MAX_IMPORTS], f"(+{len(kept) - MAX_IMPORTS} more)"]


def unquote(s: str) -> str:
    return s.strip("\"'`")


def header_to(text: str, start: int, end: int) -> str:
    """Text of a header, squashed."""
    return py_squash(text[start : min(end, start + MAX_HEADER)])


def first_line(text: str, start: int, end: int) -> str:
    return py_first_line(text[start : min(end, start + MAX_HEADER)])


_BINDING = re.compile(r"([\w$]+)\s*(?::[^=]*)?(?::=|=)\s*(.+)")


def guarded(line: str, parity: bool) -> str:
    """A line of code without the value of a binding that must not be shown."""
    m = None if parity else _BINDING.search(line)
    if m and py_must_redact(m[1], m[2].rstrip("; ,")):
        return line[: m.start(2)] + REDACTED
    return line


def stop_when_full(scan):
    """Scanner that ends quietly once the outline is full: one that knows by then all imports, and the ends of what it added."""

    def run(out: Outline) -> None:
        out.stops = True
        try:
            scan(out)
        except Full:
            pass

    run.__doc__ = scan.__doc__
    return run
