"""Languages whose blocks are told by indentation or by words: Python, Ruby and Shell."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

from ..text import py_squash
from .base import MAX_HEADER, Outline, header_to, stop_when_full, unquote


def _blanked(m: re.Match, comment: bool) -> str:
    """Comments as blanks; literals as underscores, their line breaks too, so that they end no line."""
    return re.sub(r"[^\n]", " ", m[0]) if comment else "_" * len(m[0])


# --- Python --------------------------------------------------------------------------------------------------------------

_PY_OPAQUE = re.compile(r"""#[^\n]*|(?i:[rbuf]{0,3})(?:\"{3}(?:[^\\]|\\.)*?(?:\"{3}|\Z)|'{3}(?:[^\\]|\\.)*?(?:'{3}|\Z)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)""", re.S)
_PY_DEF = re.compile(r"(?:async\s+)?def\b|class\b")
_PY_IMPORT = re.compile(r"import\s+(.+)", re.S)
_PY_FROM = re.compile(r"from\s+(\.*\s*[\w.]*)\s*import\b")


def _logical(masked: str) -> list[tuple[int, int, int]]:
    """Indent, start and end of each logical line: brackets and backslashes carry on."""
    out, at, n = [], 0, len(masked)
    scan = re.compile(r"[()\[\]{}\n]|\\\n")
    while at < n:
        line_end = masked.find("\n", at)
        line_end = n if line_end < 0 else line_end
        first = at + len(masked[at:line_end]) - len(masked[at:line_end].lstrip())
        if first >= line_end:
            at = line_end + 1
            continue
        level, end = 0, n
        for m in scan.finditer(masked, first):
            if m[0] in "([{":
                level += 1
            elif m[0] in ")]}":
                level -= 1
            elif m[0] == "\n" and level <= 0:
                end = m.start()
                break
        out.append((len(masked[at:first].expandtabs(8)), first, end))
        at = end + 1
    return out


def _header_colon(masked: str, start: int, end: int) -> int:
    level = 0
    for m in re.compile(r"[()\[\]{}:]").finditer(masked, start, end):
        if m[0] in "([{":
            level += 1
        elif m[0] in ")]}":
            level -= 1
        elif m[0] == ":" and level <= 0:
            return m.end()
    return end


def _py_block(out: Outline, masked: str, lines: list, i: int, end: int, depth: int) -> None:
    """Declarations among the lines i to end that stand at the indent of the first."""
    if i >= end:
        return
    indent, decorated = lines[i][0], None
    while i < end:
        mine, start, stop = lines[i]
        after = i + 1
        while after < end and lines[after][0] > mine:
            after += 1
        if mine == indent:
            if masked[start] == "@":
                decorated = start if decorated is None else decorated
                i = after
                continue
            if m := _PY_DEF.match(masked, start):
                colon = _header_colon(masked, start, stop)
                last = lines[after - 1][2]
                out.add(out.row(start if decorated is None else decorated), out.row(len(out.text[:last].rstrip())), depth, header_to(out.text, start, colon))
                if m[0] == "class" and depth < out.depth:
                    _py_block(out, masked, lines, i + 1, after, depth + 1)
            decorated = None
        i = after


@stop_when_full
def python_outline(out: Outline) -> None:
    """Functions and classes with their decorators, methods under classes; modules that are imported."""
    masked = _PY_OPAQUE.sub(lambda m: _blanked(m, m[0][0] == "#"), out.text)
    lines = _logical(masked)
    for indent, start, stop in lines:
        if indent:
            continue
        for piece in masked[start:stop].split(";"):
            piece = piece.strip()
            if m := _PY_FROM.match(piece):
                name = re.sub(r"\s", "", m[1])
                out.found += [name] if name != "__future__" else []
            elif m := _PY_IMPORT.match(piece):
                out.found += [x.split(" as ")[0].strip() for x in py_squash(m[1]).split(",")]
    _py_block(out, masked, lines, 0, len(lines), 0)


# --- Ruby ----------------------------------------------------------------------------------------------------------------

_RB_OPAQUE = re.compile(r"""^=begin\b.*?(?:^=end\b[^\n]*|\Z)|\#(?!\{)[^\n]*|"(?:[^"\\]|\\.)*"?|'(?:[^'\\]|\\.)*'?|(?<![\w)\]\s])/(?:[^/\\\n]|\\.)+/|(?<=[(=,]\s)/(?:[^/\\\n]|\\.)+/""", re.S | re.M)
_RB_WORD = re.compile(r"(?<![\w.:@$])(class|module|def|end|do|begin|case|if|unless|while|until|for)\b(?![?!:])")
#: So much of what stands before a word on its line is looked at.
BEFORE = 60
_RB_REQUIRE = re.compile(r"(require\w*)\s*\(?\s*([\"'])([^\"']*)\2")


def ruby_outline(out: Outline) -> None:
    """Methods, classes and modules, members under them."""
    masked = _RB_OPAQUE.sub(lambda m: _blanked(m, m[0][0] in "#="), out.text)
    stack: list[tuple[str, int | None]] = []  # opening word, number of its declaration
    hiding = 0  # words on the stack that open neither a class nor a module
    line_head = re.compile(r"[^\n]*\n?")
    at = 0
    while at < len(masked):
        end = line_head.match(masked, at).end()
        loop = False
        solid = end - len(masked[at:end].lstrip())
        for m in _RB_WORD.finditer(masked, at, end):
            word = m[1]
            before = masked[max(solid, m.start() - BEFORE) : m.start()].rstrip() or masked[solid : m.start()].rstrip()[-BEFORE:]
            visible = not hiding
            if word == "end":
                if stack:
                    opened, number = stack.pop()
                    hiding -= opened not in ("class", "module")
                    if number is not None:
                        start, _, _, text = out.decls[number]
                        out.amend(number, out.row(m.start()), text)
            elif word in ("class", "module", "def"):
                if word == "class" and masked[m.end() : end].lstrip().startswith("<<"):
                    stack.append(("singleton", None))
                    hiding += 1
                    continue
                stop = next((k for k in (masked.find(";", m.end(), end), end) if k >= 0))
                one_line = word == "def" and re.match(r"\s+[\w.?!]+(\s*\([^\n]*\))?\s*=\s", masked[m.end() : min(end, m.end() + MAX_HEADER)])
                number = None
                if visible and not out.truncated and len(stack) <= out.depth and not (before and word != "def"):
                    # the header goes on over open brackets
                    while stop < min(len(masked), m.start() + MAX_HEADER) and masked[m.start() : stop].count("(") > masked[m.start() : stop].count(")"):
                        stop = line_head.match(masked, stop).end()
                    header = re.sub(r";$", "", header_to(out.text, m.start(), stop)).strip()
                    header = re.sub(r"\s+#.*$", "", header) if "#" in header and "_" not in header[-1:] else header
                    number = out.add(out.row(m.start()), out.row(m.start()), len(stack), header)
                if not one_line:
                    stack.append((word, number))
                    hiding += word == "def"
            elif word == "do":
                if not loop:
                    stack.append((word, None))
                    hiding += 1
                loop = False
            elif word in ("while", "until", "for"):
                if not before or before.endswith(("=", "(", ";")):
                    stack.append((word, None))
                    hiding += 1
                    loop = True
            elif not before or before.endswith(("=", "(", ",", ";", "&&", "||", "return", "then", "do")) or word in ("begin", "case"):
                stack.append((word, None))
                hiding += 1
        if not stack and (m := _RB_REQUIRE.match(out.text, at)):
            out.found.append(m[3])
        at = end


# --- Shell ---------------------------------------------------------------------------------------------------------------

_SH_START = re.compile(r"""['"\\#]|<<|\$\(\(|\$\{""")
_SH_DOUBLE = re.compile(r'"(?:[^"\\]|\\.)*"?', re.S)
_SH_HERE = re.compile(r"""<<-?\s*(['"]?)(\w+)\1[^\n]*\n""")
_SH_MARK = re.compile(r"^[^\S\n]*(\w+)$", re.M)


_SH_FUNCTION = re.compile(r"(?:function\s+([\w:.-]+)\s*(?:\(\s*\))?|([\w:.-]+)\s*\(\s*\))\s*(?=[{(]|\n\s*[{(])")
_SH_ASSIGN = re.compile(r"([A-Za-z_]\w*)(?:\[[^\]]*\])?\+?=")
_SH_DECLARE = re.compile(r"(?:export|declare|typeset|readonly|local)\b((?:[ \t]+[^\s;&|]+)*)")
_SH_SOURCE = re.compile(r"(?:source|\.)[ \t]+(\"[^\"]*\"|'[^']*'|[^\s;&|]+)")
_SH_OPEN = re.compile(r"(?:if|for|while|until|case|select)\b")
_SH_CLOSE = re.compile(r"(?:fi|done|esac)\b")


def _sh_ends(text: str) -> Callable[[int, str], int | None]:
    """Finds the end of what starts at a place, or None; what has no end isn't looked for again."""
    marks: dict[str, list[int]] = {}
    for m in _SH_MARK.finditer(text):
        marks.setdefault(m[1], []).append(m.end())
    missing: set[str] = set()

    def closed(at: int, close: str) -> int | None:
        j = -1 if close in missing else text.find(close, at)
        if j < 0:
            missing.add(close)
            return None
        return j + len(close)

    def end(at: int, start: str) -> int | None:
        if start == "'":
            return closed(at + 1, "'") or len(text)
        if start == '"':
            return _SH_DOUBLE.match(text, at).end()
        if start == "\\":
            return at + 2 if at + 1 < len(text) else None
        if start == "#":
            if at and not (text[at - 1].isspace() or text[at - 1] == ";"):
                return None
            j = text.find("\n", at)
            return j if j >= 0 else len(text)
        if start == "<<":
            m = _SH_HERE.match(text, at)
            ends = marks.get(m[2], []) if m else []
            k = bisect_left(ends, m.end() + len(m[2])) if m else 0
            return ends[k] if k < len(ends) else None
        return closed(at + len(start), "))" if start == "$((" else "}")

    return end


def _sh_masked(text: str) -> str:
    """Comments as blanks; quoted texts, here-documents and expansions as underscores."""
    end_of, parts, pos = _sh_ends(text), [], 0
    while m := _SH_START.search(text, pos):
        end = end_of(m.start(), m[0])
        if end is None:
            parts.append(text[pos : m.end()])
            pos = m.end()
            continue
        parts += [text[pos : m.start()], (" " if m[0] == "#" else "_") * (end - m.start())]
        pos = end
    return "".join([*parts, text[pos:]])


def _sh_close(masked: str, at: int) -> int:
    pair = {"{": "}", "(": ")"}[masked[at]]
    level = 0
    for m in re.compile(re.escape(masked[at]) + "|" + re.escape(pair)).finditer(masked, at):
        level += 1 if m[0] == masked[at] else -1
        if not level:
            return m.end()
    return len(masked)


def shell_outline(out: Outline) -> None:
    """Functions and the names of assigned variables, at the top level; files that are sourced."""
    masked = _sh_masked(out.text)
    at, nested = 0, 0
    while at < len(masked):
        if masked[at] in " \t\r\n;&|{}()":
            at += 1
            continue
        end = re.compile(r"\n|;|&&|\|\|?|\Z").search(masked, at)
        if m := _SH_FUNCTION.match(masked, at):
            close = _sh_close(masked, re.compile("[{(]").search(masked, m.end()).start())
            if not nested:
                out.add(out.row(at), out.row(close - 1), 0, f"{m[1] or m[2]}()")
            at = close
            continue
        if _SH_OPEN.match(masked, at):
            nested += 1
            at = re.compile(r"\w+").match(masked, at).end()
            continue
        if _SH_CLOSE.match(masked, at):
            nested = max(0, nested - 1)
        elif re.compile(r"(?:then|do|else|elif)\b").match(masked, at):
            at = re.compile(r"\w+").match(masked, at).end()
            continue
        elif not nested:
            last = out.row(max(at, end.start() - 1))
            if m := _SH_DECLARE.match(masked, at):
                names = [f"{x[1]}=" for x in map(_SH_ASSIGN.match, m[1].split()) if x]
                if names:
                    out.add(out.row(at), last, 0, " ".join(names))
            elif m := _SH_SOURCE.match(out.text, at):
                out.found.append(unquote(py_squash(m[1])))
            elif (m := _SH_ASSIGN.match(masked, at)) and not re.search(r"\S\s+\S", masked[m.end() : end.start()].replace("_ ", "__")):
                close = end.start()
                if masked[m.end() : m.end() + 1] == "(":
                    close = _sh_close(masked, m.end())
                out.add(out.row(at), out.row(max(at, close - 1)), 0, f"{m[1]}=")
                at = close
                continue
        at = max(end.end(), at + 1)
