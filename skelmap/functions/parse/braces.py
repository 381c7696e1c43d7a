"""Languages with braces: Go, Rust, JavaScript, TypeScript, Java, C and C++.

A mask of the text has comments as blanks and literals as underscores, so that brackets and line ends can be trusted. The text of a
block is cut into items; each language says which items are declarations, what their headers are and which blocks to enter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from ..text import py_squash
from .base import Outline, first_line, guarded, header_to, stop_when_full, unquote

_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE, _TICK = r'"(?:[^"\\\n]|\\.)*"?', r"'(?:[^'\\\n]|\\.)*'?", r"`(?:[^`\\]|\\.)*(?:`|\Z)"
_CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,10}?)'"
_PATTERN = r"(?:(?<=[(,=:\[!&|?{};\n])|(?<=return)|(?<=[(,=:\[!&|?{}]\s))/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_OPAQUE = {
    "Go": rf"{_COMMENT}|{_DOUBLE}|`[^`]*(?:`|\Z)|{_CHAR}",
    "Rust": rf'{_COMMENT}|b?r(#*)".*?(?:"\1|\Z)|b?"(?:[^"\\]|\\.)*(?:"|\Z)|b?{_CHAR}',
    "JS": rf"{_COMMENT}|{_PATTERN}|{_DOUBLE}|{_SINGLE}|{_TICK}",
    "Java": rf'{_COMMENT}|"""(?:[^\\]|\\.)*?(?:"""|\Z)|{_DOUBLE}|{_CHAR}',
    "C": rf'{_COMMENT}|R"(\w*)\(.*?(?:\)\1"|\Z)|{_DOUBLE}|{_CHAR}',
}


def _masked(m: re.Match) -> str:
    """Comments as blanks; literals as underscores, their line breaks too, so that they end no item."""
    return re.sub(r"[^\n]", " ", m[0]) if m[0][:2] in ("//", "/*") else "_" * len(m[0])


@dataclass
class Item:
    start: int
    end: int
    open: int = -1  # of its first block, or -1
    close: int = -1  # after that block

    def head_end(self) -> int:
        return self.open if self.open >= 0 else self.end


@dataclass
class Found:
    header: str
    enter: bool = False


_CLOSE = {"(": ")", "[": "]", "{": "}"}
_BRACKET = re.compile(r"[()\[\]{}]")


def _match(s: str, at: int, end: int) -> int:
    """Offset after the bracket that closes the one at `at`."""
    stack: list[str] = []
    open_ = dict.fromkeys(_CLOSE.values(), 0)
    for m in _BRACKET.finditer(s, at, end):
        if m[0] in _CLOSE:
            stack.append(_CLOSE[m[0]])
            open_[stack[-1]] += 1
        elif open_[m[0]]:
            while True:
                last = stack.pop()
                open_[last] -= 1
                if last == m[0]:
                    break
            if not stack:
                return m.end()
    return end


_SOLID = re.compile(r"\S")
#: What an item's text so far is judged by, where it is longer: its beginning and its end.
FRONT, BACK = 60, 140
#: Blocks that didn't end an item, after which no block does: it is an expression.
MANY_BLOCKS = 32


def _seen(s: str, at: int, end: int) -> str:
    return s[at:end] if end - at <= FRONT + BACK else s[at : at + FRONT] + s[end - BACK : end]


def items(s: str, at: int, end: int, lines_end: bool, block_ends: Callable[[str, str], bool]) -> Iterator[Item]:
    """Items of s[at:end]. Where lines_end, a line ends an item unless the text around it must go on."""
    step = re.compile(r"[;({\[\n]")
    while at < end:
        if s[at].isspace() or s[at] in ";,)]}":
            at += 1
            continue
        item, pos, blocks = Item(at, end), at, 0
        decorated = at if s[at] == "@" else -1  # decorators only up to here
        while True:
            m = step.search(s, pos, end)
            if m is None:
                item.end = at + len(s[at:end].rstrip())
                break
            c, pos = m[0], m.end()
            if c == ";":
                item.end = pos
                break
            if c in "([":
                pos = _match(s, m.start(), end)
            elif c == "{":
                pos = _match(s, m.start(), end)
                if item.open < 0:
                    item.open, item.close = m.start(), pos
                solid = _SOLID.search(s, pos, end)
                nxt = solid.start() if solid else end
                blocks += 1
                if blocks <= MANY_BLOCKS and block_ends(_seen(s, at, m.start()), s[pos : min(nxt + 1, pos + BACK)]):
                    item.end = pos
                    break
                if nxt - pos > BACK and "\n" not in s[pos:nxt]:
                    pos = nxt
            elif lines_end:
                solid = _SOLID.search(s, pos, end)
                nxt = solid.start() if solid else end
                stop = m.start()
                while stop > at and s[stop - 1].isspace():
                    stop -= 1
                if decorated >= 0:
                    decorated = stop if _DECORATORS.fullmatch(s, decorated, stop) else -1
                if stop > at and decorated < 0 and not _goes_on(_seen(s, at, stop), s[nxt : nxt + 1]):
                    item.end = stop
                    break
                pos = nxt
        yield item
        at = max(item.end, at + 1)


_DECORATORS = re.compile(r"\s*(?:@[\w.]++(?:\s*+\(.*\))?\s*+)+", re.S)


def _goes_on(last: str, nxt: str) -> bool:
    """Does a line that ends so, before this character, go on?"""
    return last[-1] in ",.=+-*%&|^?:<(" or last.endswith("=>") or nxt in (".", "?", ":", "=", "+", "*", "%", "&", "|", "^", "{") or bool(re.search(r"\b(extends|implements|export|default|const|let|var|type|return|function)$", last[-12:]))


def _usual_end(head: str, rest: str) -> bool:
    """A block ends its item, but for initialisers and for types that name a variable after it."""
    if re.search(r"(?<![=!<>])=(?![=>])|=>\s*$", re.sub(r"\([^()]*\)|<[^<>]*>|\boperator\s*\W+", "", head)):
        return False
    return not head.startswith("typedef") and not re.match(r"[ \t]*(?:[;\w*]|=)", rest) if re.match(r"(?:typedef|struct|union|enum|class)\b", head) and "(" not in head else True


def _script_end(head: str, rest: str) -> bool:
    """In JavaScript and TypeScript assignments, imports, exports of names and type aliases go on after a block."""
    bare = re.sub(r"\([^()]*\)|<[^<>]*>", "", head)
    return not re.search(r"(?<![=!<>])=(?!=)|^\s*(import|export)\s*(type\s*)?$|^\s*export\s+type\s*$|:\s*$|=>\s*$", bare)


# --- languages -----------------------------------------------------------------------------------------------------------


class Language:
    opaque, lines_end = "C", False
    stops = True  # once full; not where imports stand among the items
    block_ends = staticmethod(_usual_end)

    def __init__(self, out: Outline):
        self.out = out
        self.s = re.compile(_OPAQUE[self.opaque], re.S).sub(_masked, out.text)

    def run(self) -> None:
        self.block(0, len(self.s), 0, "")

    def block(self, at: int, end: int, depth: int, inside: str) -> None:
        for item in items(self.s, at, end, self.lines_end, self.block_ends):
            self.item(item, depth, inside)

    def emit(self, item: Item, depth: int, found: Found, start: int | None = None) -> None:
        first = item.start if start is None else start
        self.out.add(self.out.row(first), self.out.row(max(item.end - 1, first)), depth, found.header)
        if found.enter and item.open >= 0 and depth < self.out.depth:
            self.block(item.open + 1, item.close - 1, depth + 1, found.header)

    def item(self, item: Item, depth: int, inside: str) -> None:
        raise NotImplementedError

    # headers
    def to_block(self, item: Item) -> str:
        """Up to the body, or the first line without its end mark."""
        if item.open >= 0:
            return header_to(self.out.text, item.start, item.open)
        return first_line(self.out.text, item.start, item.end).rstrip(";{").strip()

    def to_brace(self, item: Item) -> str:
        return header_to(self.out.text, item.start, item.head_end())

    def line(self, item: Item, strip: str = "") -> str:
        return guarded(first_line(self.out.text, item.start, item.end).rstrip(strip), self.out.parity)


class Go(Language):
    opaque, lines_end, stops = "Go", True, False

    @staticmethod
    def block_ends(head: str, rest: str) -> bool:
        return bool(re.match(r"(func|type)\b", head)) and not re.search(r"\b(interface|struct)\s*$", head) if head.startswith("func") else False

    def item(self, item: Item, depth: int, inside: str) -> None:
        s, text = self.s, self.out.text
        head = s[item.start : item.end]
        if head.startswith("import"):
            self.out.found += [m[0].strip('"`') for m in re.finditer(r'"[^"\n]*"|`[^`]*`', re.sub(_COMMENT, "", text[item.start : item.end], flags=re.S))]
        elif re.match(r"func\b", head):
            body = self.body(item)
            header = header_to(text, item.start, body) if body else self.line(item).rstrip("{").strip()
            self.emit(item, depth, Found(header))
        elif m := re.match(r"type\s*\(", head):
            specs = list(items(s, item.start + m.end(), item.end - 1, True, lambda h, r: False))
            for n, spec in enumerate(specs):
                if self.out.parity:
                    if n == 0:
                        self.emit(item, depth, self.spec(spec.start, spec.end))
                else:
                    self.emit(spec, depth, self.spec(spec.start, spec.end))
        elif m := re.match(r"type\s+", head):
            self.emit(item, depth, self.spec(item.start + m.end(), item.end))
        elif re.match(r"(const|var)\b", head):
            self.emit(item, depth, Found(self.line(item)))

    def body(self, item: Item) -> int:
        """The block of a function: that which ends the item, as results may hold braces too."""
        at, last = item.start, 0
        while (b := self.s.find("{", at, item.end)) >= 0:
            last, at = b, _match(self.s, b, item.end)
        return last

    def spec(self, start: int, end: int) -> Found:
        t = py_squash(self.out.text[start:end])
        m = re.match(r"(\w+(?:\[[^\]]*\])?)\s*=?\s*(struct|interface)\s*\{", t)
        return Found(f"type {m[1].split('[')[0]} {m[2]}" if m else f"type {t}")


class Rust(Language):
    opaque, stops = "Rust", False
    _KIND = re.compile(r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:default\s+)?((?:(?:const|async|unsafe|extern(?:\s+_+)?)\s+)*fn|unsafe\s+trait|unsafe\s+impl|auto\s+trait|struct|enum|union|trait|impl|mod|const|static|type|use|macro_rules!)(?![\w])")

    @staticmethod
    def block_ends(head: str, rest: str) -> bool:
        return not re.match(r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:use|const(?!\s+(?:unsafe\s+|extern\s+\S+\s+)*fn\b)|static|let)\b", head)

    def item(self, item: Item, depth: int, inside: str) -> None:
        s = self.s
        while m := re.compile(r"#!?\s*\[").match(s, item.start):  # attributes stand before the item
            after = _match(s, m.end() - 1, item.end)
            item.start = after + len(s[after : item.end]) - len(s[after : item.end].lstrip())
        m = self._KIND.match(s, item.start)
        if not m:
            return
        kind = m[1].split()[-1]
        if kind == "use":
            self.out.found.append(re.sub(r"\s", "", self.out.text[m.end() : item.end].rstrip().rstrip(";")))
        elif kind == "fn":
            if item.open >= 0 or not self.out.parity:
                self.emit(item, depth, Found(self.to_block(item)))
        elif kind in ("struct", "enum", "union"):
            self.emit(item, depth, Found(self.to_brace(item)))
        elif kind in ("trait", "impl"):
            self.emit(item, depth, Found(self.to_brace(item), True))
        elif kind in ("mod", "macro_rules!"):
            name = re.compile(r"\s*(\w+)").match(s, m.end())
            self.emit(item, depth, Found(f"{kind} {name[1] if name else ''}", kind == "mod"))
        else:
            self.emit(item, depth, Found(self.line(item, ";")))


class Script(Language):
    """JavaScript; with typed, TypeScript."""

    opaque, lines_end, stops, typed = "JS", True, False, False
    block_ends = staticmethod(_script_end)
    _DECORATORS = re.compile(r"(?:@[\w.]+(?:\s*\([^)]*\))?\s*)+")
    _FUNCTION = re.compile(r"(?:async\s+)?function\b")
    _CLASS = re.compile(r"(?:@[\w.]+(?:\s*\([^)]*\))?\s*)*(?:abstract\s+)?class\b")
    _VALUE = re.compile(r"[^=]*?=\s*(?:async\s+)?(?:function\b|class\b|(?:<[^>]*>\s*)?\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*(?::[^=;{]*)?=>|[\w$]+\s*=>)", re.S)

    def item(self, item: Item, depth: int, inside: str) -> None:
        s, first = self.s, item.start
        if depth and inside:
            self.member(item, depth, inside)
            return
        if re.compile(r"import\b(?!\s*[(.])").match(s, first):
            m = re.compile(r"""(?:\bfrom\s*|import\s*)(["'][^"'\n]*["'])""").search(self.out.text, first, item.end)
            self.out.found.append(unquote(m[1]) if m else py_squash(self.out.text[first : item.end]))
            return
        decorated = self._DECORATORS.match(s, item.start)
        if decorated and s.startswith("export", decorated.end()):  # then the decorators belong to the export, not to the class
            item.start = decorated.end()
        while m := re.compile(r"(?:export\s+default|export|declare)\s+(?!default\b|\*|\{)").match(s, item.start):
            item.start = m.end()
        found = self.declaration(item)
        if found:
            self.emit(item, depth, found, first)

    def declaration(self, item: Item) -> Found | None:
        at = lambda p: re.compile(p).match(self.s, item.start)
        if self._FUNCTION.match(self.s, item.start):
            return Found(self.to_block(item)) if item.open >= 0 else None
        if self._CLASS.match(self.s, item.start):
            return Found(self.to_block(item), True)
        if at(r"(?:const\s+)?enum\b") and self.typed or at(r"interface\b") and self.typed:
            return Found(self.to_brace(item), bool(at("interface")))
        if self.typed and at(r"type\s+[\w$]+"):
            return Found(self.line(item))
        if at(r"(?:const|let|var)\b") and self._VALUE.match(self.s[item.start : item.end]):
            return Found(self.line(item))
        return None

    def member(self, item: Item, depth: int, inside: str) -> None:
        head = self.s[item.start : item.head_end()]
        call = re.match(r"(?:@[\w.]+(?:\s*\([^)]*\))?\s*)*(?:(?:public|private|protected|static|override|readonly|async|get|set|abstract)\s+)*\*?\s*[\w$#\[\]._\"']+[?!]?\s*(?:<[^>]*>)?\s*\(", head)
        is_interface = re.match(r"interface\b", inside)
        if call and item.open >= 0 and not is_interface:
            self.emit(item, depth, Found(self.to_block(item)))
        elif self.typed and (is_interface or not re.search(r"\babstract\b", head)) and not re.match(r"\[|static\s*$|\(|new\b", head.strip()):
            self.emit(item, depth, Found(self.line(item, ";,")))


class TypeScript(Script):
    typed = True


class Java(Language):
    opaque, stops = "Java", False
    _TYPE = re.compile(r"(?:@[\w.]+(?:\s*\([^)]*\))?\s+|(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp)\s+)*(class|interface|enum|record|@interface)\s+\w")
    _CALL = re.compile(r"[^=;]*?\b\w+\s*\([^;{]*\)[^;={]*$", re.S)

    @staticmethod
    def block_ends(head: str, rest: str) -> bool:
        return not re.search(r"(?<![=!<>])=(?!=)", re.sub(r"\([^()]*\)", "", head))

    def item(self, item: Item, depth: int, inside: str) -> None:
        head = self.s[item.start : item.head_end()]
        if not depth and (m := re.match(r"import\s+(?:static\s+)?", head)):
            self.out.found.append(py_squash(self.out.text[item.start + m.end() : item.end]).rstrip(";").strip())
        elif self._TYPE.match(head):
            self.emit(item, depth, Found(self.to_brace(item), True))
        elif depth:
            bare = head.rstrip("; \n")
            if self._CALL.match(bare) and (item.open >= 0 or re.match(r"(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:[\w<>\[\],.?&]+\s+)+\w+\s*\(", bare)):
                self.emit(item, depth, Found(self.to_block(item)))
            elif not re.match(r"static\s*$|\{|package\b|import\b", bare) and item.end > item.start and self.s[item.end - 1] == ";" and re.match(r"(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:[\w<>\[\],.?&]+\s+)+\w+", bare) and not (inside and re.search(r"\benum\b", inside) and "=" not in head and " " not in bare.strip()):
                self.emit(item, depth, Found(self.line(item, ";")))


class C(Language):
    opaque, plus = "C", False
    _ACCESS = re.compile(r"(?:public|private|protected|signals|Q_\w+|public\s+slots)\s*:(?!:)\s*")

    def __init__(self, out: Outline):
        super().__init__(out)
        for m in re.finditer(r"^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", self.s, re.M):
            inc = re.match(r"\s*#\s*include\s*(<[^>\n]*>|\"[^\"\n]*\")", out.text[m.start() : m.end()])
            # includes under #if are not at the top level; they count unless parity is asked for
            if inc and not (out.parity and self._conditional(m.start())):
                out.found.append(inc[1])
        hidden = self._blocks() if out.parity else []
        self.s = re.sub(r"^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", lambda m: re.sub(r"[^\n]", " ", m[0]), self.s, flags=re.M)
        # a macro alone on its line, as __BEGIN_DECLS, belongs to no declaration
        self.s = re.sub(r"^[ \t]*_*[A-Z][A-Z0-9_]*[ \t]*$", lambda m: " " * len(m[0]), self.s, flags=re.M)
        for a, b in hidden:
            self.s = self.s[:a] + re.sub(r"[^\n]", " ", self.s[a:b]) + self.s[b:]

    def _blocks(self) -> list[tuple[int, int]]:
        """Spans of outermost #if blocks."""
        out, level, start = [], 0, 0
        for m in re.finditer(r"^[ \t]*#[ \t]*(if\w*|endif)\b", self.s, re.M):
            if m[1] == "endif":
                level -= 1
                if not level:
                    out.append((start, m.end()))
            else:
                start = m.start() if not level else start
                level += 1
        return out

    def _conditional(self, at: int) -> bool:
        return any(a < at < b for a, b in self._blocks())

    def item(self, item: Item, depth: int, inside: str) -> None:
        s = self.s
        while m := self._ACCESS.match(s, item.start):
            item.start = m.end()
        if item.start >= item.end:
            return
        at = lambda p: re.compile(p).match(s, item.start)
        if m := at(r"extern\s+_+\s*(?=\{)"):
            if not self.out.parity:
                self.block(item.open + 1, item.close - 1, depth, inside)
            return
        found = self.declaration(item, inside)
        if found:
            self.emit(item, depth, found)

    def declaration(self, item: Item, inside: str) -> Found | None:
        s = self.s
        head = s[item.start : item.head_end()]
        whole = s[item.start : item.end]
        at = lambda p: re.match(p, head)
        if self.plus and (m := re.match(r"template\s*<", head)):
            close, level = m.end(), 1
            while close < len(head) and level:
                level += {"<": 1, ">": -1}.get(head[close], 0)
                close += 1
            inner = Item(item.start + close + len(head[close:]) - len(head[close:].lstrip()), item.end, item.open, item.close)
            found = self.declaration(inner, inside)
            return Found(f"template {found.header}", found.enter) if found else None
        if at(r"typedef\b"):
            return Found(self.line(item, ";"))
        if self.plus and (m := at(r"(?:inline\s+)?namespace\b\s*([\w:]*)")):
            return Found(f"namespace {m[1]}", True) if item.open >= 0 else None
        if item.open >= 0 and "(" not in re.sub(r"__attribute__\s*\(\(.*?\)\)|alignas\s*\([^)]*\)", "", head) and (m := at(r"(struct|class|union|enum)\b")) and "=" not in head:
            if re.match(r"\s*[\w*]", s[item.close : item.end]):
                return Found(self.line(item, ";"))
            return Found(self.to_brace(item), self.plus and m[1] in ("struct", "class"))
        if at(r"(using|friend|static_assert|_Static_assert|return|if|for|while|switch|goto|asm)\b"):
            return None
        if item.open >= 0 and "(" in head and not re.search(r"(?<![=!<>])=(?![=])", re.sub(r"\([^()]*\)|operator\s*\S+", "", head)):
            return Found(self.to_block(item))
        if whole.rstrip().endswith(";") and re.match(r"[\w:~]", head) and not re.match(r"[A-Z_][A-Z0-9_]*\s*\([^)]*\)\s*;?$", whole.strip() if not inside else ""):
            if re.match(r"(struct|class|union|enum)\s+\w+\s*;", whole):
                return Found(self.to_brace(item).rstrip("; "), False)
            return Found(self.line(item, ";"))
        return None


class Cpp(C):
    plus = True


_LANGUAGES = {"Go": Go, "Rust": Rust, "JavaScript": Script, "TypeScript": TypeScript, "TSX": TypeScript, "Java": Java, "C": C, "C++": Cpp}


def scanner(name: str) -> Callable[[Outline], None]:
    def scan(out: Outline) -> None:
        _LANGUAGES[name](out).run()

    return stop_when_full(scan) if _LANGUAGES[name].stops else scan
