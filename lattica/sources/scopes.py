"""Local declarations and occurrences of a file: what resolution works on."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from lattica.sources.cparse import AGGREGATES, KEYWORDS, PRIMITIVE, Reader

TYPE_WORDS = {"const", "volatile", "static", "register", "auto", "typename", "constexpr", *AGGREGATES}


@dataclass
class Local:
    """A parameter or local variable, and the part of the text where it can be seen."""

    name: str
    type: str
    kind: str  # 'param' or 'local'
    at: int
    line: int
    col: int
    scope_start: int
    scope_end: int


@dataclass
class Occurrence:
    """An identifier; receiver: steps to the object in front of '.' or '->', such as var:p, call:f, type:T, this:C, field:x."""

    name: str
    at: int
    line: int
    col: int
    call: bool
    receiver: list[str]


class Scopes(Reader):
    def run_scopes(self) -> tuple[list[Local], list[Occurrence]]:
        self.run()
        self.prepare()
        self.locals: list[Local] = []
        for s in self.out.symbols:
            if s.kind in ("function", "method"):
                self.function_scope(s)
        return self.locals, self.occurrences()

    def prepare(self) -> None:
        """Where the bracket is that each closing one belongs to, and methods and functions by where they begin."""
        self.opens = {b: a for a, b in self.match.items()}
        self.functions = sorted((s.start, s.end, s.qualname.rpartition("::")[0]) for s in self.out.symbols if s.kind in ("function", "method"))
        self.starts = [f[0] for f in self.functions]

    def owner_of(self, offset: int) -> str:
        """The scope of the innermost function that a place is in."""
        k = bisect.bisect_right(self.starts, offset) - 1
        while k >= 0 and self.functions[k][1] < offset and offset - self.functions[k][0] < 1 << 20:
            k -= 1
        return self.functions[k][2] if k >= 0 and self.functions[k][1] >= offset else ""

    def index_at(self, offset: int) -> int:
        lo, hi = 0, len(self.tokens)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.tokens[mid][2] < offset:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def declared(self, k: int, end: int) -> tuple[str, list[int], int] | None:
        """(type, name tokens, token after) if a declaration of variables stands at k."""
        kind, i = "", k
        while i < end:
            t = self.tok(i)
            if t in TYPE_WORDS:
                i += 1
            elif t in PRIMITIVE:
                kind = t
                i += 1
            elif self.tokens[i][0] == "word" and t not in KEYWORDS and not kind:
                kind = t
                i += 1
                while self.tok(i) == "::" and self.tokens[i + 1 : i + 2] and self.tokens[i + 1][0] == "word":
                    kind += "::" + self.tok(i + 1)
                    i += 2
                if self.tok(i) == "<":
                    i = self.angle(i, end)
            else:
                break
        if not kind and "auto" not in [self.tok(x) for x in range(k, i)]:
            return None
        names = []
        while i < end:
            while self.tok(i) in ("*", "&", "&&", "const"):
                i += 1
            if i >= end or self.tokens[i][0] != "word" or self.tok(i) in KEYWORDS or self.tok(i) in PRIMITIVE:
                break
            name, i = i, i + 1
            while self.tok(i) == "[":
                i = self.match.get(i, end) + 1
            if self.tok(i) not in ("=", ";", ",", ":", ")", "{", "(") and i < end:
                return None
            if self.tok(i) == "(" and not (self.tok(k) in PRIMITIVE or i - k > 1):
                return None
            names.append(name)
            while i < end and self.tok(i) not in (",", ";", ":", ")"):
                i = self.match.get(i, end) + 1 if self.tok(i) in ("(", "{", "[") else i + 1
            if self.tok(i) != ",":
                break
            i += 1
        return (kind or "auto", names, i) if names else None

    def function_scope(self, s) -> None:
        name = self.index_at(s.at)
        end = self.index_at(s.end)
        paren = name
        while paren < end and self.tok(paren) != "(":
            paren += 1
        close = self.match.get(paren, end)
        k = paren + 1
        while k < close:  # parameters
            stop = k
            while stop < close and self.tok(stop) != ",":
                stop = self.match.get(stop, stop) + 1 if self.tok(stop) in ("(", "[", "{") else self.angle(stop, close) if self.tok(stop) == "<" and self.angle(stop, close) > stop else stop + 1
            found = self.declared(k, min(stop, close))
            if found:
                self.keep_local(found[0], found[1][0], "param", s.start, s.end)
            k = stop + 1
        brace = close + 1
        while brace < end and self.tok(brace) != "{":
            brace += 1
        blocks, fresh, k = [], True, brace
        while k < min(self.match.get(brace, end) + 1, end, len(self.tokens)):
            t = self.tok(k)
            if t == "{":
                blocks.append(self.match.get(k, end))
            while blocks and k >= blocks[-1]:
                blocks.pop()
            if fresh and self.tokens[k][0] == "word" and (found := self.declared(k, end)) and blocks:
                last = self.tokens[min(blocks[-1], len(self.tokens) - 1)][2]
                for n in found[1]:
                    self.keep_local(found[0], n, "local", self.tokens[n][2], last)
            fresh = t in ("{", "}", ";", ":") or t == "(" and self.tok(k - 1) in ("for", "catch", "if", "while", "switch")
            k += 1

    def keep_local(self, kind: str, name: int, what: str, start: int, end: int) -> None:
        self.locals.append(Local(self.tok(name), kind, what, self.tokens[name][2], *self.place(self.tokens[name][2]), start, end))

    def receiver(self, k: int) -> list[str]:
        """Steps of the expression that ends at token k."""
        if k < 0:
            return []
        while self.tok(k) == "]":
            k = self.opens.get(k, -1) - 1
        t = self.tok(k)
        if t == ")":
            a = self.opens.get(k, -1)
            if a < 0:
                return []
            if self.tokens[a - 1 : a] and a > 0 and self.tokens[a - 1][0] == "word" and self.tok(a - 1) not in KEYWORDS:
                before = self.receiver(a - 3) if self.tok(a - 2) in (".", "->") else []
                return [*before, f"field:{self.tok(a - 1)}"] if before else [f"call:{self.tok(a - 1)}"]
            if self.tok(a + 1) == "(":  # a cast in parentheses
                inner = [self.tok(x) for x in range(a + 2, self.match.get(a + 1, k)) if self.tokens[x][0] == "word" and self.tok(x) not in KEYWORDS]
                return [f"type:{inner[-1]}"] if inner else []
            return self.receiver(k - 1)
        if t == "this":
            return ["this:"]
        if self.tokens[k][0] != "word" or t in KEYWORDS:
            return []
        if self.tok(k - 1) in (".", "->"):
            before = self.receiver(k - 2)
            return [*before, f"field:{t}"] if before else []
        return [f"var:{t}"]

    def occurrences(self) -> list[Occurrence]:
        out = []
        for k, (kind, t, offset) in enumerate(self.tokens):
            if kind == "word" and t not in KEYWORDS and t not in PRIMITIVE:
                steps = (self.receiver(k - 2) or ["unknown:"]) if self.tok(k - 1) in (".", "->") else []
                if steps == ["this:"] or steps[:1] == ["this:"]:
                    steps = [f"type:{self.owner_of(offset).rsplit('::', 1)[-1]}", *steps[1:]]
                out.append(Occurrence(t, offset, *self.place(offset), self.tok(k + 1) == "(", steps[:5]))
        return out


def receiver_at_end(text: str, lang: str = "cpp") -> list[str]:
    """Steps of the expression in front of the '.' or '->' that text ends with; none if it ends otherwise."""
    r = Scopes(text, lang)
    r.prepare()
    last = len(r.tokens) - 1
    return (r.receiver(last - 1) or ["unknown:"])[:5] if r.tok(last) in (".", "->") else []
