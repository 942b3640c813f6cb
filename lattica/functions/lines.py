"""Functions over source lines: a lexer that carries block comments, parameter lists, calls around a place, comments above one."""

from __future__ import annotations

import re
from itertools import pairwise

from pyspark.sql.functions import udtf

from lattica.sources.cparse import KEYWORDS, PRIMITIVE, Reader

LEX = re.compile(r"""(?P<comment>//.*|/\*.*?\*/)|(?P<open>/\*.*)|(?P<preprocessor>^\s*\#\s*\w+)|(?P<string>"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?)|(?P<number>\.?\d(?:[eEpP][+-]|[\w.'])*)|(?P<word>[A-Za-z_]\w*)|(?P<operator>[^\s\w])""", re.X | re.A)


def tokenize_line(line: str, in_comment: bool = False) -> tuple[list[tuple[int, int, str]], bool]:
    """((start, end, class) of each token, whether a block comment goes on). Classes: keyword, type, string, comment, number,
    preprocessor, function, macro, identifier, operator."""
    out, at = [], 0
    if in_comment:
        end = line.find("*/")
        if end < 0:
            return ([(0, len(line), "comment")] if line else []), True
        out, at = [(0, end + 2, "comment")], end + 2
    while m := LEX.search(line, at):
        kind, t = m.lastgroup, m.group()
        if kind == "open":
            return [*out, (m.start(), len(line), "comment")], True
        if kind == "word":
            if t in PRIMITIVE:
                kind = "type"
            elif t in KEYWORDS:
                kind = "keyword"
            elif line[m.end() :].lstrip().startswith("("):
                kind = "function"
            else:
                kind = "macro" if len(t) > 1 and t == t.upper() and re.search("[A-Z]", t) else "type" if t.endswith("_t") else "identifier"
        out.append((m.start(), m.end(), kind))
        at = m.end()
    return out, False


@udtf(returnType="line int, start int, stop int, cls string, in_comment boolean")
class Tokens:
    """SELECT * FROM tokens(text): tokens of all lines of a file; in_comment: the line begins inside a block comment."""

    def eval(self, text: str):
        carry = False
        for no, line in enumerate(re.split(r"\r?\n", text or "")):
            before = carry
            found, carry = tokenize_line(line, carry)
            for start, stop, cls in found:
                yield no, start, stop, cls, before


def split_params(text: str) -> list[str]:
    """Parameters of a list, parted at commas outside of brackets and template arguments; empty ones and a lone void are left out."""
    r = Reader(text)
    cuts, k, n = [-1], 0, len(r.tokens)
    while k < n:
        t = r.tok(k)
        if t == ",":
            cuts.append(r.tokens[k][2])
        k = r.match[k] + 1 if k in r.match else max(k + 1, r.angle(k, n)) if t == "<" else k + 1
    parts = (text[a + 1 : b].strip() for a, b in pairwise([*cuts, len(text)]))
    return [p for p in parts if p not in ("", "void")]


def enclosing_call(text: str, lines_before: int = 20) -> tuple[str, int] | None:
    """(callee, number of the argument) of the call that is open at the end of text: the last bracket that nothing closes has to be
    a parenthesis behind a name, and no statement may end or block begin after it."""
    r = Reader("\n".join(text.split("\n")[-1 - lines_before :]))
    n = len(r.tokens)
    last = max((k for k, end in r.match.items() if end == n), default=-1)
    inside = range(last + 1, n)
    if last < 1 or r.tok(last) != "(" or any(r.tok(k) in (";", "{", "}") for k in inside):
        return None
    kind, name, _ = r.tokens[last - 1]
    if kind != "word" or name in KEYWORDS:
        return None
    nested = {x for k in inside if k in r.match for x in range(k, r.match[k])}
    return name, sum(r.tok(k) == "," and k not in nested for k in inside)


def styled_ranges(line: str, in_comment: bool = False, mark: int = -1, length: int = 0) -> tuple[list[tuple[int, int, str, bool]], bool]:
    """((start, end, class, whether marked) of each piece of a line, whether a comment goes on), cut at the ends of the mark too."""
    found, carry = tokenize_line(line, in_comment)
    ends = sorted({mark, mark + length})
    out = []
    for start, end, kind in found:
        cuts = [start, *(x for x in ends if length and start < x < end), end]
        out += [(a, b, kind, length > 0 and mark <= a and b <= mark + length) for a, b in pairwise(cuts)]
    return out, carry


def snippet(lines: list[str], line: int, end_line: int, before: int = 12, after: int = 60) -> list[tuple[int, str]]:
    """(number, text) of a definition's lines, no more than `after` below its first, with the comment above it."""
    first = line - len(comment_above(lines, line, before)) if before else line
    return [(k, lines[k]) for k in range(first, min(end_line, line + after, len(lines) - 1) + 1)]


def comment_above(lines: list[str], at: int, most: int = 12) -> list[str]:
    """The block of comment lines right above a line."""
    out, inside = [], False
    for line in reversed(lines[max(0, at - most) : at]):
        t = line.strip()
        if t.endswith("*/"):
            inside = not t.startswith("/*")
        elif not (inside or t.startswith("//") or t.startswith("*")):
            break
        elif inside and t.startswith("/*"):
            inside = False
        out.append(line)
    return out[::-1]
