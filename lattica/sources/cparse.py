"""A tolerant reader of C and C++ declarations: text to symbols, references, bases and includes.

It works on a token list, not on a grammar: scopes are found by their braces, declarations by their shape. Unbalanced or unknown
input never fails; what cannot be understood is skipped up to the next ';' or '}'. All branches of conditional directives are read.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

# Fixed values of the languages.
KEYWORDS = set("alignas alignof and asm auto break case catch class const const_cast constexpr continue decltype default delete do dynamic_cast else enum explicit export extern false final for friend goto if inline mutable namespace new noexcept not nullptr operator or override private protected public register reinterpret_cast restrict return sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union using virtual volatile while __attribute__ __declspec".split())
PRIMITIVE = set("void bool char short int long float double signed unsigned wchar_t size_t ssize_t ptrdiff_t intptr_t uintptr_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t char8_t char16_t char32_t _Bool".split())
AGGREGATES = ("struct", "class", "union", "enum")

TOKEN = re.compile(r"""(?P<space>\s+|\\\n)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<directive>(?<![^\n])[ \t]*\#(?:\\\r?\n|/\*.*?\*/|[^\n])*)|(?P<string>(?:u8|[uUL])?"(?:\\.|[^"\\\n])*"?)|(?P<char>(?:u8|[uUL])?'(?:\\.|[^'\\\n])*'?)|(?P<word>[A-Za-z_]\w*)|(?P<number>\.?\d(?:[eEpP][+-]|[\w.'])*)|(?P<sign>->\*?|::|\.\.\.|<<=|>>=|[+\-*/%&|^=!<>]=|&&|\|\||\+\+|--|<<|.)""", re.S | re.X | re.A)


@dataclass
class Symbol:
    name: str
    qualname: str
    kind: str
    line: int
    col: int
    end_line: int
    signature: str
    at: int = 0
    start: int = 0
    end: int = 0


@dataclass
class Ref:
    name: str
    kind: str
    line: int
    col: int
    owner: int  # place in symbols, or -1


@dataclass
class Index:
    symbols: list[Symbol] = field(default_factory=list)
    refs: list[Ref] = field(default_factory=list)
    bases: list[tuple[int, str]] = field(default_factory=list)
    includes: list[tuple[str, int, bool]] = field(default_factory=list)


def blank_macros(text: str, words: list[str]) -> str:
    """Whole words in place of which spaces of the same length are put; words that are no identifiers are left out."""
    words = [w for w in words if re.fullmatch(r"[A-Za-z_]\w*", w, re.A)]
    return re.sub(rf"\b(?:{'|'.join(words)})\b", lambda m: " " * len(m.group()), text, flags=re.A) if words else text


def collapse(text: str, most: int = 240) -> str:
    s = " ".join(text.split())
    return s[: most - 1] + "…" if len(s) > most else s


class Reader:
    def __init__(self, text: str, lang: str = "cpp", references: bool = True):
        self.text, self.cpp, self.references, self.out = text, lang == "cpp", references, Index()
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.tokens: list[tuple[str, str, int]] = []
        for m in TOKEN.finditer(text):
            if m.lastgroup == "directive":
                self.directive(m.group(), m.start())
            elif m.lastgroup not in ("space", "comment"):
                self.tokens.append((m.lastgroup, m.group(), m.start()))
        self.match = self.pairs()
        self.named: set[int] = set()
        self.bodies: list[tuple[int, int]] = []  # token ranges of function bodies and initialisers

    def pairs(self) -> dict[int, int]:
        close, stack, out = {")": "(", "]": "[", "}": "{"}, [], {}
        for i, (_, t, _) in enumerate(self.tokens):
            if t in "([{":
                stack.append(i)
            elif t in close:
                while stack and self.tokens[stack[-1]][1] != close[t] and t == "}" and self.tokens[stack[-1]][1] != "{":
                    stack.pop()
                if stack and self.tokens[stack[-1]][1] == close[t]:
                    out[stack.pop()] = i
        return {k: v for k, v in out.items()} | {k: len(self.tokens) for k in stack}

    def place(self, offset: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.lines, offset) - 1
        head = self.text[self.lines[line] : offset]
        return line, len(head) if head.isascii() else len(head.encode("utf-16-le")) // 2

    def directive(self, text: str, start: int) -> None:
        lead = len(text) - len(text.lstrip())
        if m := re.match(r"\s*#\s*include\s*(<[^>\n]*>|\"[^\"\n]*\")", text):
            raw = m.group(1)
            path = re.sub(r"^(\.\.?/)+", "", raw[1:-1].replace("\\", "/"))
            self.out.includes.append((path, self.place(start + m.start(1))[0], raw[0] == "<"))
        elif m := re.match(r"\s*#\s*define\s+([A-Za-z_]\w*)", text, re.A):
            line, col = self.place(start + m.start(1))
            end = self.place(start + len(text.rstrip()))[0]
            self.out.symbols.append(Symbol(m.group(1), m.group(1), "macro", line, col, end, collapse(text.strip().split("\n")[0].rstrip("\\"), 200), start + m.start(1), start + lead, start + len(text)))

    def add(self, name: str, at: int, kind: str, scope: list[str], first: int, last: int, signature: str, bare: bool = False) -> int:
        """at: token of the whole name; a name with '::' stands for itself."""
        line, col = self.place(self.tokens[at][2])
        start, end = self.tokens[first][2], self.tokens[min(last, len(self.tokens) - 1)]
        stop = end[2] + len(end[1])
        short = name.rsplit("::", 1)[-1]
        qual = name if bare or "::" in name or not scope else "::".join([*scope, name])
        self.named.add(self.tokens[at][2])
        self.out.symbols.append(Symbol(short, qual, kind, line, col, self.place(stop - 1)[0], signature, self.tokens[at][2], start, stop))
        return len(self.out.symbols) - 1

    def tok(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def slice(self, a: int, b: int) -> str:
        """Text from token a up to token b."""
        if a >= b or a >= len(self.tokens):
            return ""
        last = self.tokens[min(b, len(self.tokens)) - 1]
        return self.text[self.tokens[a][2] : last[2] + len(last[1])]

    def angle(self, i: int, end: int) -> int:
        """The token after template arguments that begin at i, or i if they do not close."""
        depth, k = 0, i
        while k < end:
            t = self.tok(k)
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif t in ("(", "["):
                k = self.match.get(k, end)
            elif t in (";", "{", "}", "&&", "||"):
                return i
            k += 1
        return i

    # scopes
    def run(self) -> Index:
        self.scope(0, len(self.tokens), [], None)
        self.uses()
        return self.out

    def scope(self, i: int, end: int, names: list[str], aggregate: str | None) -> None:
        while i < end:
            t = self.tok(i)
            if t in (";", "}", ")", "]", ","):
                i += 1
            elif t == "{":
                i = self.match.get(i, end) + 1
            elif t == "namespace" and self.cpp:
                k = i + 1
                while k < end and self.tok(k) not in ("{", ";", "="):
                    k += 1
                if self.tok(k) == "{":
                    stop = self.match.get(k, end)
                    name = "".join(self.tok(x) for x in range(i + 1, k) if self.tokens[x][0] == "word" and self.tok(x) != "inline" or self.tok(x) == "::")
                    if name:
                        self.add(name, i + 1, "namespace", names, i, stop, f"namespace {name}")
                    self.scope(k + 1, min(stop, end), [*names, name] if name else names, None)
                    i = stop + 1
                else:
                    i = self.semicolon(k, end)
            elif t == "extern" and self.tokens[i + 1 : i + 2] and self.tokens[i + 1][0] == "string":
                if self.tok(i + 2) == "{":
                    stop = self.match.get(i + 2, end)
                    self.scope(i + 3, min(stop, end), names, aggregate)
                    i = stop + 1
                else:
                    i += 2
            elif t == "template" and self.tok(i + 1) == "<":
                k = self.angle(i + 1, end)
                i = k if k > i + 1 else i + 2
            elif t in ("public", "private", "protected") and self.tok(i + 1) == ":":
                i += 2
            elif t in ("using", "friend", "static_assert", "goto"):
                i = self.semicolon(i, end)
            elif t in ("__attribute__", "__declspec", "alignas") and self.tok(i + 1) == "(":
                i = self.match.get(i + 1, end) + 1
            else:
                i = self.declaration(i, end, names, aggregate)

    def semicolon(self, i: int, end: int) -> int:
        while i < end and self.tok(i) != ";":
            i = self.match.get(i, i) + 1 if self.tok(i) in ("(", "[", "{") else i + 1
        return i + 1

    def declaration(self, first: int, end: int, names: list[str], aggregate: str | None) -> int:
        typedef = self.tok(first) == "typedef"
        i, body = first, None
        while i < end:  # an aggregate with a body at the head of the declaration
            t = self.tok(i)
            if t in AGGREGATES:
                body = self.aggregate(i, end, first, names, typedef)
                if body:
                    i = body
                    break
            if t in (";", "(", "=", "{", "}", ","):
                break
            i += 1
        k = i if body else first
        if body and self.tok(k) == ";":
            return k + 1
        # find the end: ';' at depth 0, or a function body
        j, paren, name_at, seen_equal = k, None, None, False
        while j < end:
            t = self.tok(j)
            if t == "<" and self.cpp and j > k and self.tokens[j - 1][0] == "word" and not seen_equal:
                j = max(self.angle(j, end), j + 1)
                continue
            if t == "=" and self.tok(j - 1) != "operator":
                seen_equal = True
            if t in ("(", "["):
                if t == "(" and paren is None and not seen_equal:
                    paren = j
                j = self.match.get(j, end) + 1
                continue
            if t == "{":
                if paren is not None and not seen_equal and (self.tok(j - 1) in (")", "const", "override", "final", "noexcept", "try", "&", "&&") or self.head_of_body(paren, j)):
                    return self.function(first, k, paren, j, end, names, aggregate)
                stop = self.match.get(j, end)
                if seen_equal or paren is not None or self.tokens[j - 1][0] == "word" and self.cpp:
                    self.bodies.append((j, stop))
                    j = stop + 1
                    continue
                return stop + 1
            if t in (";", "}"):
                break
            j += 1
        if j > k:
            self.declarators(first, k, j, names, aggregate, typedef)
        return j + 1

    def head_of_body(self, paren: int, j: int) -> bool:
        """Between the parameters and a brace: initialisers of members, a trailing type or old-style parameters."""
        after = self.match.get(paren, j) + 1
        return self.tok(after) in (":", "->", "noexcept", "const") or all(self.tokens[x][0] == "word" or self.tok(x) in ("*", ",", ";") for x in range(after, j))

    def aggregate(self, i: int, end: int, first: int, names: list[str], typedef: bool) -> int | None:
        """Reads struct, class, union or enum with a body at i; the token after it, or None."""
        kind, k, name, at = self.tok(i), i + 1, "", None
        if kind == "enum" and self.tok(k) in ("class", "struct"):
            k += 1
        while k < end and self.tok(k) in ("__attribute__", "__declspec", "alignas"):
            k = self.match.get(k + 1, k) + 1
        while k < end and (self.tokens[k][0] == "word" and self.tok(k) != "final" or self.tok(k) == "::"):
            if self.tokens[k][0] == "word":
                name, at = (name + self.tok(k), at) if self.tok(k - 1) == "::" and name else (self.tok(k), k)
            else:
                name += "::" if name else ""
            k += 1
            if self.tok(k) == "<":
                k = self.angle(k, end)
        if self.tok(k) == "final":
            k += 1
        bases = []
        if self.tok(k) == ":":
            k += 1
            part = ""
            while k < end and self.tok(k) not in ("{", ";"):
                t = self.tok(k)
                if t == "<":
                    k = max(self.angle(k, end), k + 1)
                    continue
                if t == ",":
                    bases.append(part)
                    part = ""
                elif self.tokens[k][0] == "word" and t not in ("public", "private", "protected", "virtual", "typename"):
                    part = t
                k += 1
            bases.append(part)
        if self.tok(k) != "{":
            return None
        stop = self.match.get(k, end)
        inner = name
        if at is not None:
            n = self.add(name, at, kind, names, i, stop, collapse(self.text[self.tokens[first if typedef else i][2] : self.tokens[stop if stop < len(self.tokens) else -1][2]].split("\n")[0], 200))
            if kind != "enum":
                self.out.bases += [(n, b) for b in bases if b]
        elif typedef:
            x = stop + 1
            while x < end and self.tok(x) not in (";", ",") and self.tokens[x][0] != "word":
                x += 1
            inner = self.tok(x) if x < end and self.tokens[x][0] == "word" else ""
        if kind == "enum":
            x, fresh = k + 1, True
            while x < min(stop, end):
                if fresh and self.tokens[x][0] == "word":
                    y = x
                    while y < stop and self.tok(y) != ",":
                        y = self.match.get(y, y) + 1 if self.tok(y) in ("(", "{", "[") else y + 1
                    self.add(self.tok(x), x, "enumerator", [], x, y - 1, collapse(self.slice(x, y), 160), True)
                    self.bodies.append((x, y))
                    x = y
                fresh = self.tok(x) == ","
                x += 1
        else:
            self.scope(k + 1, min(stop, end), [*names, inner] if inner else names, kind)
        return stop + 1

    def name_before(self, paren: int, low: int) -> tuple[str, int] | None:
        """The qualified name that ends just before a token, and its first token."""
        k = paren - 1
        if self.tok(k) == ">":
            depth = 0
            while k > low:
                depth += (self.tok(k) == ">") - (self.tok(k) == "<")
                k -= 1
                if not depth:
                    break
        x = k
        while x >= low and self.tokens[x][0] != "word" and x > k - 4 and self.tok(x) not in (";", "}", ")", "{"):
            x -= 1  # operator signs
        if x >= low and self.tok(x) == "operator":
            name, at = "operator" + "".join(self.tok(y) for y in range(x + 1, paren)), x
        elif k >= low and self.tokens[k][0] == "word" and self.tok(k) not in KEYWORDS:
            name, at = self.tok(k), k
            if self.tok(k - 1) == "~":
                name, at = "~" + name, k - 1
        else:
            return None
        while at - 2 >= low and self.tok(at - 1) == "::" and (self.tokens[at - 2][0] == "word" or self.tok(at - 2) == ">"):
            y = at - 2
            if self.tok(y) == ">":
                while y > low and self.tok(y) != "<":
                    y -= 1
                y -= 1
            name, at = f"{self.tok(y)}::{name}", y
        return name, at

    def function(self, first: int, low: int, paren: int, brace: int, end: int, names: list[str], aggregate: str | None) -> int:
        stop = self.match.get(brace, end)
        got, p = self.name_before(paren, low), paren
        if got is None and self.tok(paren + 1) in ("*", "(") or got is not None and got[1] == first and not self.cpp and self.tok(first) in PRIMITIVE:
            for x in range(paren + 1, self.match.get(paren, end)):  # the name is inside: a function that returns a function
                if self.tok(x) == "(" and (got := self.name_before(x, paren + 1)):
                    p = x
                    break
        if got:
            kind = "method" if aggregate in ("struct", "class", "union") else "function"
            self.add(got[0], got[1], kind, names, first, stop, collapse(self.text[self.tokens[first][2] : self.tokens[brace][2]]))
            del p
        self.bodies.append((brace, stop))
        return stop + 1

    def declarators(self, first: int, low: int, end: int, names: list[str], aggregate: str | None, typedef: bool) -> None:
        """Declarators between low and end, which a comma at depth 0 parts."""
        if self.tok(first) in ("return", "if", "while", "for", "switch", "else", "do", "case", "default", "break", "continue"):
            self.bodies.append((first, end))
            return
        parts, at, k = [], low, low
        while k < end:
            t = self.tok(k)
            if t in ("(", "[", "{"):
                k = self.match.get(k, end) + 1
                continue
            if t == "<" and self.cpp and k > low and self.tokens[k - 1][0] == "word":
                k = max(self.angle(k, end), k + 1)
                continue
            if t == ",":
                parts.append((at, k))
                at = k + 1
            k += 1
        parts.append((at, end))
        for no, (a, b) in enumerate(parts):
            stop, k = b, a
            while k < b:
                t = self.tok(k)
                if t == "=" and self.tok(k - 1) != "operator" or t == ":" and aggregate:
                    stop = k
                    break
                k = self.match.get(k, k) + 1 if t in ("(", "[", "{") else k + 1
            if stop < b:
                self.bodies.append((stop, b))
            got = self.declarator(a, stop, no == 0 and low == first)
            if not got:
                continue
            name, where, called = got
            kind = "typedef" if typedef else "prototype" if called else "field" if aggregate else "variable"
            text = self.slice(first, end) if not (typedef and low > first) else self.slice(first, end).split("\n")[0]
            self.add(name, where, kind, names, first, end, collapse(text, 160 if aggregate else 240))

    def declarator(self, a: int, b: int, typed: bool) -> tuple[str, int, bool] | None:
        """(name, its first token, whether it is a function) of one declarator; typed: the type stands in front."""
        k = a
        while k < b and self.tok(k) != "(":
            if self.tok(k) == "[":
                break
            if self.tok(k) == "<" and self.cpp and self.angle(k, b) > k:
                k = self.angle(k, b)
                continue
            k += 1
        if k < b and self.tok(k) == "(":
            got = self.name_before(k, a)
            if got and (not typed or got[1] > a) and not (self.tok(k + 1) == "*" and got[0] in PRIMITIVE) and got[0] not in PRIMITIVE and not (self.tok(k + 1) in ("*", "&", "^") and self.tok(self.match.get(k, b) + 1) == "("):
                return *got, True
            inside, close = k + 1, min(self.match.get(k, b), b)
            stars = 0
            while inside < close and self.tok(inside) in ("*", "&", "const", "^"):
                stars += 1
                inside += 1
            for x in range(inside, close):
                if self.tokens[x][0] == "word" and self.tok(x) not in KEYWORDS:
                    # int (*fp)(int) is a variable, void (*f(int))(int) a function
                    called = self.tok(x + 1) == "(" and x + 1 < close or not stars and self.tok(close + 1) == "("
                    return self.tok(x), x, called
            return None
        words = [x for x in range(a, min(k, b)) if self.tokens[x][0] == "word" and self.tok(x) not in KEYWORDS]
        if not words or typed and len([x for x in range(a, min(k, b)) if self.tokens[x][0] == "word"]) < 2:
            return None
        last = words[-1]
        if self.tok(last) in PRIMITIVE:
            return None
        got = self.name_before(last + 1, a)
        return (*got, False) if got else None

    # references
    def uses(self) -> None:
        calls, idents, inside = [], [], [False] * (len(self.tokens) + 1)
        for a, b in self.bodies:
            for k in range(a, min(b, len(self.tokens))):
                inside[k] = True
        for k, (kind, t, offset) in enumerate(self.tokens):
            if kind != "word" or t in KEYWORDS or t in PRIMITIVE:
                continue
            n = k + 1
            if self.cpp and self.tok(n) == "<" and inside[k]:
                n = self.angle(n, min(len(self.tokens), n + 40))
            declares = k and (self.tokens[k - 1][0] == "word" and self.tok(k - 1) not in KEYWORDS | {"return"} - {"const"})
            if inside[k] and self.tok(n) == "(" and not declares:
                calls.append((offset, t))
            else:
                idents.append((offset, t))
        functions = sorted((s.start, s.end, n) for n, s in enumerate(self.out.symbols) if s.kind in ("function", "method"))
        starts = [f[0] for f in functions]
        most, top = [], -1
        for f in functions:
            top = max(top, f[1])
            most.append(top)

        def owner(offset: int) -> int:
            k = bisect.bisect_right(starts, offset) - 1
            while k >= 0 and most[k] >= offset:
                if functions[k][1] >= offset:
                    return functions[k][2]
                k -= 1
            return -1

        for kind, found in (("call", calls), ("ref", [x for x in idents if x[0] not in self.named] if self.references else [])):
            for offset, name in found:
                self.out.refs.append(Ref(name, kind, *self.place(offset), owner(offset)))


def index_text(text: str, lang: str = "cpp", ignore: list[str] | None = None, references: bool = True) -> Index:
    return Reader(blank_macros(text, ignore or []), lang, references).run()
