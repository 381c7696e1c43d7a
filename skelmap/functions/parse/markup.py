"""XML, HTML, CSS and Markdown."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..redact import MAX_VALUE, py_must_redact, py_shown
from ..text import noun, py_human_bytes, py_squash
from .base import Outline, first_line, header_to, stop_when_full, unquote


@dataclass
class Element:
    name: str
    start: int
    end: int  # offset after the last character
    attributes: list[tuple[str, str | None]] = field(default_factory=list)
    children: list[Element] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    closed: bool = False


_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);")

# HTML elements without an end tag, those whose content is text, those that a start tag ends, and those looked through.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style"])
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "p": set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())}
THROUGH = frozenset(["html", "head", "body"])
IDENTIFYING = ("id", "class", "name", "src", "href")


class _Marks:
    """Marks of a text in their order. What was seen to lead nowhere isn't tried again, so all of them take one pass or a few."""

    _COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)", re.S)
    _NAME = re.compile(r"<(/?)(?=[A-Za-z_:])")
    _NAME_END = re.compile(r"[\s/>]|\Z")
    _SUBSET_END = re.compile(r"\]\s*>")

    def __init__(self, text: str):
        self.text, self.last = text, text.rfind(">")
        self.name_at = self.name_end = -1
        self.failed: list[tuple[list[int], list[int]]] = []  # stretches outside quotes from which no mark's end was found
        self.no_subset_end = self.no_declaration_end = False

    def end(self, at: int) -> int:
        """The `>` after `at` outside quotes, or -1."""
        for starts, ends in self.failed:
            i = bisect_right(starts, at) - 1
            if i >= 0 and at <= ends[i]:
                return -1
        starts, ends, pos = [at], [], at
        while (m := re.compile("[>\"']").search(self.text, pos)) is not None:
            if m[0] == ">":
                return m.start()
            ends.append(m.start())
            close = self.text.find(m[0], m.end())
            if close < 0:
                break
            pos = close + 1
            starts.append(pos)
        else:
            ends.append(len(self.text))
        self.failed.append((starts, ends))
        return -1

    def declaration(self, at: int) -> int:
        """Offset after a declaration such as a document type, or -1."""
        if self.no_declaration_end:
            return -1
        m = re.compile(r"[\[>]").search(self.text, at + 2)
        if m is None:
            self.no_declaration_end = True
            return -1
        if m[0] == ">":
            return m.end()
        close = None if self.no_subset_end else self._SUBSET_END.search(self.text, m.end())
        self.no_subset_end = close is None
        return close.end() if close else -1

    def next(self, at: int) -> tuple[int, int, str, str, str, bool] | None:
        """Start and end of the next mark from `at`, and of a tag its slash, name, attributes and whether it closes itself."""
        text = self.text
        while (at := text.find("<", at)) >= 0:
            if (m := self._COMMENT.match(text, at)) is not None:
                return at, m.end(), "", "", "", False
            if text.startswith("<!", at):
                if (end := self.declaration(at)) >= 0:
                    return at, end, "", "", "", False
            elif at < self.last and (m := self._NAME.match(text, at)) is not None:
                if not self.name_at <= m.end() < self.name_end:
                    self.name_at, self.name_end = m.end(), self._NAME_END.search(text, m.end()).start()
                close = self.end(self.name_end)
                if close >= 0:
                    itself = close > self.name_end and text[close - 1] == "/"
                    return at, close + 1, m[1], text[m.end() : self.name_end], text[self.name_end : close - itself], itself
            at += 1
        return None


def elements(text: str, html: bool) -> list[Element]:
    """The root elements; end tags without a start are passed over, and what stays open ends at the text's end."""
    roots: list[Element] = []
    stack: list[Element] = []
    open_: Counter[str] = Counter()
    marks = _Marks(text)
    at = 0
    while m := marks.next(at):
        start, end, slash, name, attributes, itself = m
        if stack:
            stack[-1].text.append(text[at:start])
        at = end
        if not name:
            continue
        name = name.lower() if html else name
        if slash:
            while open_[name]:
                e = stack.pop()
                open_[e.name] -= 1
                e.end = start
                if e.name == name:
                    e.end, e.closed = end, True
                    break
            continue
        while html and stack and name in ENDED_BY.get(stack[-1].name, ()):
            open_[stack[-1].name] -= 1
            stack.pop().end = start
        e = Element(name, start, end, _ATTRIBUTE.findall(attributes))
        (stack[-1].children if stack else roots).append(e)
        if itself or (html and name in VOID):
            continue
        if html and name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(text, at)
            e.text.append(text[at : close.start() if close else len(text)])
            e.end, e.closed = (close.end(), True) if close else (len(text), False)
            at = e.end
            continue
        stack.append(e)
        open_[name] += 1
    for e in stack:
        e.end = len(text)
    return roots


def _own_text(e: Element) -> str:
    return py_squash(_ENTITY.sub("", "".join(e.text)))


def _counted(n: int) -> str:
    return f" ({n} {noun(n, 'child', 'children')})"


def _xml(out: Outline, e: Element, depth: int) -> None:
    shown = ""
    for key, raw in e.attributes:
        value = unquote(py_squash(raw or ""))
        shown += f' {key}="{py_shown(key, value)}"'
    line = f"<{e.name}{shown}>"
    if e.children:
        line += _counted(len(e.children))
    elif text := _own_text(e):
        line += " " + py_shown(e.name, text)
    out.add(out.row(e.start), out.row(e.end - 1), depth, line)
    if depth < out.depth:
        for child in e.children:
            _xml(out, child, depth + 1)


@stop_when_full
def xml_outline(out: Outline) -> None:
    """Elements with their attributes, and the text of leaves; secrets hidden and long values by their size."""
    for e in elements(out.text, html=False):
        _xml(out, e, 0)


def _html_value(out: Outline, key: str | None, value: str) -> str:
    """Long values by their size; unless parity is asked for, secrets hidden, judged by the value and by name attributes."""
    if out.parity or not py_must_redact(key, value):
        return f"<{py_human_bytes(len(value.encode()))}>" if len(value) > MAX_VALUE else value
    return py_shown(key, value)


def _inside(e: Element) -> Iterator[Element]:
    """The nearest elements in e that aren't looked through, in their order."""
    todo = e.children[::-1]
    while todo:
        x = todo.pop()
        if x.name in THROUGH:
            todo += x.children[::-1]
        else:
            yield x


def _html(out: Outline, e: Element, depth: int) -> None:
    if e.name in THROUGH:
        for child in _inside(e):
            _html(out, child, depth)
        return
    shown = "".join(f' {k.lower()}="{_html_value(out, None, unquote(py_squash(v)))}"' for k, v in e.attributes if v and k.lower() in IDENTIFYING)
    line = f"<{e.name}{shown}>"
    if e.children:
        line += _counted(len(e.children))
    elif text := _own_text(e) if e.name not in RAW else py_squash("".join(e.text)):
        line += " " + _html_value(out, None, text)
    tag_end = out.text.find(">", e.start)
    out.add(out.row(e.start), out.row((e.end if e.closed else tag_end + 1) - 1), depth, line)
    if depth < out.depth:
        for child in e.children:
            _html(out, child, depth + 1)


def _references(out: Outline, roots: list[Element]) -> None:
    """Scripts and links, those inside an element before it."""
    todo = [(e, False) for e in reversed(roots)]
    while todo:
        e, seen = todo.pop()
        if not seen:
            todo.append((e, True))
            todo += [(x, False) for x in reversed(e.children)]
            continue
        want = {"script": "src", "link": "href"}.get(e.name)
        out.found += [unquote(py_squash(v)) for k, v in e.attributes if want and v and k.lower() == want]


@stop_when_full
def html_outline(out: Outline) -> None:
    """Elements with what identifies them; html, head and body are looked through, scripts and links are imports."""
    roots = elements(out.text, html=True)
    _references(out, roots)
    for e in roots:
        _html(out, e, 0)


# --- CSS -----------------------------------------------------------------------------------------------------------------

_CSS_OPAQUE = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?""", re.S)
_CSS_NESTING = re.compile(r"@(?:-\w+-)?(media|supports|keyframes)\b", re.I)
_CSS_IMPORT = re.compile(r"""@import\s+(?:url\(\s*)?["']?([^"')\s;]+)""", re.I)


def _css(out: Outline, masked: str, at: int, end: int, depth: int, frames: bool = False) -> None:
    while at < end:
        if masked[at] in " \t\r\n;}":
            at += 1
            continue
        stop = re.compile("[{;]").search(masked, at, end)
        if stop is None:
            return
        if stop[0] == ";":
            if m := _CSS_IMPORT.match(out.text, at):
                out.found.append(m[1])
            at = stop.end()
            continue
        level, close = 1, stop.end()
        for b in re.compile("[{}]").finditer(masked, stop.end(), end):
            level += 1 if b[0] == "{" else -1
            if not level:
                close = b.end()
                break
        else:
            close = end
        first, last = out.row(at), out.row(close - 1)
        m = _CSS_NESTING.match(masked, at)
        if m:
            out.add(first, last, depth, first_line(out.text, at, stop.end()).rstrip("{").strip())
            if depth < out.depth:
                _css(out, masked, stop.end(), close - 1, depth + 1, m[1].lower() == "keyframes")
        elif masked[at] != "@" and not frames:
            out.add(first, last, depth, header_to(out.text, at, stop.start()))
        at = close


def css_outline(out: Outline) -> None:
    """Selectors of rules, with the rules of media, supports and keyframes blocks under them."""
    masked = _CSS_OPAQUE.sub(lambda m: re.sub(r"[^\n]", " " if m[0].startswith("/*") else "_", m[0]), out.text)
    _css(out, masked, 0, len(masked), 0)


# --- Markdown ------------------------------------------------------------------------------------------------------------

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_ATX = re.compile(r" {0,3}(#{1,6})(?=\s|$)")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)\s*$")
_NO_PARAGRAPH = re.compile(r" {0,3}(?:[-*+](?:\s|$)|\d{1,9}[.)]\s|>|(?:[-*_]\s*){3,}$|<)|( {4}|\t)")


def headings(lines: list[str]) -> list[tuple[int, int, str]]:
    """Row, level and text of each heading; fenced and indented code holds none."""
    found, fence, paragraph = [], "", None
    for i, line in enumerate(lines):
        m = _FENCE.match(line)
        if fence:
            if m and m[1].startswith(fence) and not line.strip().strip(fence[0]):
                fence = ""
            continue
        if m:
            fence, paragraph = m[1], None
        elif m := _ATX.match(line):
            found.append((i, len(m[1]), py_squash(line)))
            paragraph = None
        elif paragraph is not None and (m := _UNDERLINE.match(line)):
            found.append((paragraph, 1 if m[1][0] == "=" else 2, lines[paragraph].strip()))
            paragraph = None
        elif not line.strip() or (paragraph is None and _NO_PARAGRAPH.match(line)):
            paragraph = None
        elif paragraph is None:
            paragraph = i
    return found


@stop_when_full
def markdown_outline(out: Outline) -> None:
    """Headings with the spans of their sections, nested by level down to the depth."""
    lines = out.text.replace("\r\n", "\n").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    found = headings(lines)
    ends: list[int] = [len(lines) - 1] * len(found)
    open_: list[int] = []
    depths = []
    for n, (row, level, _) in enumerate(found):
        while open_ and found[open_[-1]][1] >= level:
            ends[open_.pop()] = row - 1
        depths.append(len(open_))
        open_.append(n)
    for (row, _, text), end, depth in zip(found, ends, depths):
        if depth <= out.depth:
            out.add(row, end, depth, text)
