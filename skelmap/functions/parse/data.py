"""JSON with comments, YAML and TOML: hierarchies of keys."""

from __future__ import annotations

import re

from ..redact import MAX_VALUE, REDACTED, py_must_redact
from ..text import noun, py_human_bytes, py_squash
from .base import Outline, stop_when_full

# --- JSON ----------------------------------------------------------------------------------------------------------------

_SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)', re.S)
_ATOM = re.compile(r"""[^\s,:{}\[\]"/]+""")
_INNER = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|//[^\n]*|/\*.*?(?:\*/|\Z)|[{}\[\]]', re.S)


class _Json:
    def __init__(self, out: Outline):
        self.out, self.s = out, out.text

    def skip(self, i: int) -> int:
        m = _SKIP.match(self.s, i)
        return m.end() if m else i

    def past(self, i: int) -> int:
        """End of the value at i, however deep it goes."""
        c = self.s[i]
        if c == '"':
            return _STRING.match(self.s, i).end()
        if c in "{[":
            level = 0
            for m in _INNER.finditer(self.s, i):
                if m[0] in ("{", "["):
                    level += 1
                elif m[0] in ("}", "]"):
                    level -= 1
                    if not level:
                        return m.end()
            return len(self.s)
        m = _ATOM.match(self.s, i)
        return m.end() if m else i + 1

    def value(self, key: str | None, i: int, start: int, indent: int) -> int:
        s, out = self.s, self.out
        if out.truncated:  # what is open still counts its parts
            return self.past(i)
        head = f"{key}: " if key is not None else ""
        if s[i] not in "{[":
            end = self.past(i)
            out.add(out.row(start), out.row(end - 1), indent, head + self.scalar(key, i, end))
            return end
        mine = out.add(out.row(start), out.row(start), indent, head)
        count, at, end = 0, self.skip(i + 1), None
        while at < len(s):
            if s[at] in "}]":
                end = at + 1
                break
            if s[at] == ",":
                at = self.skip(at + 1)
                continue
            first = at
            at = self.past(at)
            if s[i] == "[":
                count += 1
            else:
                name_end, at = at, self.skip(at)
                if at < len(s) and s[at] == ":":
                    at = self.skip(at + 1)
                    if at < len(s) and s[at] not in "},]":
                        count += 1
                        at = self.value(s[first:name_end], at, first, indent + 1) if indent < out.depth else self.past(at)
            at = self.skip(at)
        end = len(s) if end is None else end
        what = f"{{object, {count} {noun(count, 'key', 'keys')}}}" if s[i] == "{" else f"[array, {count} {noun(count, 'item', 'items')}]"
        out.amend(mine, out.row(end - 1), head + what)
        return end

    def scalar(self, key: str | None, i: int, end: int) -> str:
        raw = py_squash(self.s[i:end])
        if py_must_redact(key, raw):
            return REDACTED
        if raw[:1] == '"' and len(raw) > MAX_VALUE:
            return f'"<string, {py_human_bytes(len(self.s[i:end].encode()))}>"'
        return raw


def json_outline(out: Outline) -> None:
    """The root value, and the keys of objects down to the depth; arrays are counted, not entered."""
    j = _Json(out)
    at = j.skip(0)
    while at < len(j.s):
        at = j.skip(at + 1 if j.s[at] in ",:}]" else j.value(None, at, at, 0))


# --- TOML ----------------------------------------------------------------------------------------------------------------

_TOML_HEAD = re.compile(r"[ \t]*(\[\[?)\s*((?:\"[^\"\n]*\"|'[^'\n]*'|[^\"'\]\n])*?)\s*\]\]?[ \t]*(?:#[^\n]*)?(?=\n|\Z)")
_TOML_KEY = re.compile(r"[ \t]*((?:\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'|[\w-]+)(?:\s*\.\s*(?:\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'|[\w-]+))*)[ \t]*=")
_TOML_PART = re.compile(r'"""(?:[^\\]|\\.)*?(?:"""|\Z)|\'\'\'.*?(?:\'\'\'|\Z)|"(?:[^"\\\n]|\\.)*"?|\'[^\'\n]*\'?|#[^\n]*|[\[\]{}]|\n', re.S)


def _toml_value_end(s: str, i: int) -> int:
    level = 0
    for m in _TOML_PART.finditer(s, i):
        if m[0] in ("[", "{"):
            level += 1
        elif m[0] in ("]", "}"):
            level -= 1
        elif m[0] == "\n" and level <= 0:
            return m.start()
    return len(s)


def toml_outline(out: Outline) -> None:
    """Tables with their spans, and names of keys."""
    s, at, table = out.text, 0, None
    while at < len(s):
        if m := _TOML_HEAD.match(s, at):
            start = m.start(1)
            if table is not None:
                out.amend(table[0], out.row(at) - 1, table[1])
            name = f"[[{py_squash(m[2])}]]" if m[1] == "[[" else f"[{py_squash(m[2])}]"
            table = out.add(out.row(start), out.row(start), 0, name), name
            if out.truncated:
                return
            at = m.end()
        elif m := _TOML_KEY.match(s, at):
            end = _toml_value_end(s, m.end())
            if not out.truncated and (table is None or out.depth > 0):
                out.add(out.row(m.start(1)), out.row(len(s[:end].rstrip())) if end > at else out.row(at), 0 if table is None else 1, py_squash(m[1]))
            at = end
        else:
            end = s.find("\n", at)
            at = len(s) if end < 0 else end
        at += 1
    if table is not None:
        out.amend(table[0], out.last_row, table[1])


# --- YAML ----------------------------------------------------------------------------------------------------------------

_YAML_KEY = re.compile(r"""(\s*(?:-\s+)*)((?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|\?\s+\S[^#]*?|[^\s#'"\[\]{},%@`|>&*!-][^#\n]*?|[&*!-][^\s#][^#\n]*?))\s*:(?=\s|$)""")
_PROPERTY = re.compile(r"(?:[&!]\S*\s+)+|[&!]\S*$")
_FLOW = re.compile(r"""(?<=[\[\]{},:\s])"(?:[^"\\]|\\.)*"|(?<=[\[\]{},:\s])'(?:[^']|'')*'|(?<=\s)\#[^\n]*|[\[\]{},]""", re.S)


class _Yaml:
    """Block structure by indentation; a node is (kind, first row, last row, parts)."""

    def __init__(self, out: Outline, first: int, end: int, lines: list[str]):
        self.out, self.first, self.end, self.lines = out, first, end, lines

    def content(self, i: int) -> int:
        """The next row with content from i."""
        while i < self.end:
            t = self.lines[i].strip()
            if t and not t.startswith("#"):
                return i
            i += 1
        return i

    @staticmethod
    def indent(line: str) -> int:
        return len(line) - len(line.lstrip(" "))

    def below(self, i: int, indent: int) -> int:
        """Row after the last row with content from i that stands deeper than indent."""
        last = i
        while (i := self.content(i)) < self.end and self.indent(self.lines[i]) > indent:
            i += 1
            last = i
        return last

    def walk(self, i: int, depth: int) -> int:
        """Emit the node whose first row is i; the row after it."""
        line = self.lines[i]
        indent = self.indent(line)
        if re.match(r"-(\s|$)", line.lstrip(" ")):
            n, end = self.items(i, indent)
            self.out.add(i, end - 1, depth, f"[{n} {noun(n, 'item', 'items')}]")
            return end
        if not _YAML_KEY.match(line):
            t = line.strip()
            if t[0] in "[{":
                end, parts = self.flow(i, line.index(t[0]))
                if t[0] == "{":
                    self.pairs(parts, depth)
                else:
                    self.out.add(i, end - 1, depth, f"[{len(parts)} {noun(len(parts), 'item', 'items')}]")
                return end
            end = max(self.below(i + 1, indent - 1), i + 1)
            raw = "\n".join(self.lines[i:end])
            self.out.add(i, end - 1, depth, self.scalar(None, raw))
            return end
        while (i := self.content(i)) < self.end and self.indent(self.lines[i]) == indent:
            m = _YAML_KEY.match(self.lines[i])
            if not m:
                i += 1
                continue
            i = self.pair(i, m, indent, depth)
        return i

    def items(self, i: int, indent: int) -> tuple[int, int]:
        n, end = 0, i
        while (i := self.content(i)) < self.end and self.indent(self.lines[i]) == indent and re.match(r"-(\s|$)", self.lines[i].lstrip(" ")):
            n += 1
            end = i = max(self.below(i + 1, indent), i + 1)
        return n, end

    def keys(self, i: int, indent: int) -> tuple[int, int]:
        """Number of keys of the block mapping at i, and the row after it."""
        n, end = 0, i
        while (i := self.content(i)) < self.end and self.indent(self.lines[i]) == indent:
            m = _YAML_KEY.match(self.lines[i])
            if m is None:
                i += 1
                continue
            n += 1
            end = i = self.value_end(i, m, indent)
        return n, end

    def value_end(self, i: int, m: re.Match, indent: int) -> int:
        rest = self.rest(i, m)
        after = self.content(i + 1)
        if not rest and after < self.end and self.indent(self.lines[after]) == indent and re.match(r"-(\s|$)", self.lines[after].lstrip(" ")):
            return self.items(after, indent)[1]
        if rest[:1] in ("[", "{"):
            return self.flow(i, self.lines[i].index(rest[0], m.end()))[0]
        if rest[:1] in ("|", ">"):
            return self.block(i, indent)
        return max(self.below(i + 1, indent), i + 1)

    def rest(self, i: int, m: re.Match) -> str:
        t = self.lines[i][m.end() :].strip()
        t = "" if t.startswith("#") else t
        return _PROPERTY.sub("", t, count=1).strip() if t[:1] in ("&", "!") else t

    def block(self, i: int, indent: int) -> int:
        j, last = i + 1, i + 1
        while j < self.end and (not self.lines[j].strip() or self.indent(self.lines[j]) > indent):
            j += 1
            if self.lines[j - 1].strip():
                last = j
        return last

    def pair(self, i: int, m: re.Match, indent: int, depth: int) -> int:
        out, key, rest = self.out, py_squash(m[2]), self.rest(i, m)
        end = self.value_end(i, m, indent)
        after = self.content(i + 1)
        if not rest:
            if after < end:
                inner = self.indent(self.lines[after])
                t = self.lines[after].lstrip(" ")
                if re.match(r"-(\s|$)", t):
                    n, _ = self.items(after, inner)
                    out.add(i, end - 1, depth, f"{key}: [{n} {noun(n, 'item', 'items')}]")
                    return end
                if _YAML_KEY.match(self.lines[after]):
                    n, _ = self.keys(after, inner)
                    out.add(i, end - 1, depth, f"{key}: {{{n} {noun(n, 'key', 'keys')}}}")
                    if depth < out.depth:
                        self.walk(after, depth + 1)
                    return end
                out.add(i, end - 1, depth, f"{key}: {self.scalar(key, chr(10).join(self.lines[after:end]))}")
            else:
                out.add(i, i, depth, f"{key}:")
            return end
        if rest[0] in "[{":
            end, parts = self.flow(i, self.lines[i].index(rest[0], m.end()))
            n = len(parts)
            out.add(i, end - 1, depth, f"{key}: {{{n} {noun(n, 'key', 'keys')}}}" if rest[0] == "{" else f"{key}: [{n} {noun(n, 'item', 'items')}]")
            if rest[0] == "{" and depth < out.depth:
                self.pairs(parts, depth + 1)
            return end
        first = self.lines[i][m.end() :].strip()
        if first[0] not in "\"'|>" and end == i + 1:
            first = re.sub(r"\s+#.*", "", first)
        raw = "\n".join([first, *self.lines[i + 1 : end]])
        out.add(i, end - 1, depth, f"{key}: {self.scalar(key, raw)}")
        return end

    def scalar(self, key: str | None, raw: str) -> str:
        shown = py_squash(raw)
        if py_must_redact(key, shown):
            return REDACTED
        return f"<string, {py_human_bytes(len(raw.strip().encode()))}>" if len(shown) > MAX_VALUE else shown

    def flow(self, i: int, column: int) -> tuple[int, list[tuple[int, str]]]:
        """Row after the flow collection at this place, and its parts with their rows."""
        rows = 16
        while True:  # look at more rows until it closes
            s = "\n".join(self.lines[i : min(i + rows, self.end)])
            end, parts = self.flow_parts(s, i, column)
            if end >= 0 or i + rows >= self.end:
                break
            rows *= 4
        return i + s.count("\n", 0, end if end >= 0 else len(s)) + 1, parts

    @staticmethod
    def flow_parts(s: str, i: int, column: int) -> tuple[int, list[tuple[int, str]]]:
        """The end of the flow collection at column, or -1, and its parts."""
        level, start, parts, counted, row = 0, column + 1, [], 0, i
        for m in _FLOW.finditer(s, column):
            if m[0] in ("[", "{"):
                level += 1
            elif m[0] in ("]", "}"):
                level -= 1
            if (m[0] == "," and level == 1) or not level:
                part = s[start : m.start()]
                if part.strip():
                    lead = start + len(part) - len(part.lstrip())
                    row += s.count("\n", counted, lead)
                    counted = lead
                    parts.append((row, part.strip()))
                start = m.end()
            if not level and m[0] in ("]", "}"):
                return m.end(), parts
        return -1, parts

    def pairs(self, parts: list[tuple[int, str]], depth: int) -> None:
        for row, part in parts:
            m = re.match(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^:]+?)\s*:\s*(.*)""", part, re.S)
            key, value = (m[1], m[2]) if m else (part, "")
            end = row + part.count("\n")
            if value[:1] in ("{", "["):
                lines = value.split("\n")
                inner = _Yaml(self.out, 0, len(lines), lines)
                _, sub = inner.flow(0, 0)
                n = len(sub)
                self.out.add(row, end, depth, f"{key}: {{{n} {noun(n, 'key', 'keys')}}}" if value[0] == "{" else f"{key}: [{n} {noun(n, 'item', 'items')}]")
                if value[0] == "{" and depth < self.out.depth:
                    at = row + part[: m.start(2)].count("\n")
                    self.pairs([(at + r, p) for r, p in sub], depth + 1)
            else:
                self.out.add(row, end, depth, f"{key}: {self.scalar(key, value)}" if value else f"{key}:")


@stop_when_full
def yaml_outline(out: Outline) -> None:
    """Keys of mappings down to the depth; sequences are counted. Several documents are told apart."""
    rows = out.text.split("\n")
    if rows and rows[-1] == "":
        rows.pop()
    bounds, start, some = [], 0, False  # some: is there content since start?
    for i, line in enumerate(rows):
        before, some = some, some or (line.strip() != "" and not line.lstrip().startswith(("#", "%")))
        if re.match(r"---(\s|$)", line) and before:
            bounds.append((start, i))
            start, some = i, True
        elif re.match(r"\.\.\.(\s|$)", line):
            bounds.append((start, i))
            start, some = i + 1, False
    bounds.append((start, len(rows)))
    docs = [(a, b) for a, b in bounds if any(x.strip() and not x.lstrip().startswith("#") for x in rows[a:b])]
    for n, (a, b) in enumerate(docs, 1):
        if len(docs) > 1:
            out.add(a, b - 1, 0, f"--- document {n}")
        y = _Yaml(out, a, b, rows)
        i = y.content(a)
        while i < b and re.match(r"(---\s*(#.*)?$|%)", rows[i]):
            i = y.content(i + 1)
        if i < b and (m := re.match(r"---\s+", rows[i])):
            y.lines[i] = " " * m.end() + rows[i][m.end() :]
        while i < b:
            i = y.content(max(y.walk(i, 0), i + 1))
