"""Tokens of the rule languages."""

from __future__ import annotations

import re
from dataclasses import dataclass


class RuleError(ValueError):
    """A rule that cannot be read or compiled; says where."""


@dataclass(frozen=True)
class Token:
    kind: str  # name var count offset length number float time string regex list op end
    value: object
    line: int
    pos: int
    flags: str = ""


_SPEC = [
    ("skip", r"[ \t\r\n]+|//[^\n]*|/\*.*?\*/"),
    ("time", r"\d+[smhd]\b"),
    ("float", r"\d+\.\d+"),
    ("number", r"0x[0-9A-Fa-f]+|0o[0-7]+|\d+(?:KB|MB)?\b"),
    ("string", r'"(?:\\.|[^"\\\n])*"'),
    ("list", r"%[A-Za-z_]\w*(?:\.\w+)*%?(?![\w(])"),
    ("var", r"\$\w*\*?"),
    ("count", r"\#\w*"),
    ("offset", r"@\w*"),
    ("length", r"!\w+|!(?=\[)"),
    ("name", r"[A-Za-z_]\w*"),
    ("op", r"\.\.\.|\*\*|=>|\.\.|==|!=|=~|!~|<=|>=|<<|>>|[-+*\\%&|^~<>=()\[\]{},.:;?/!]"),
]
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _SPEC), re.S)
_REGEX = re.compile(r"/((?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+)/([a-z]*)")
#: A slash starts a regular expression after one of these, or at the start.
_BEFORE_REGEX = {"=", "==", "!=", "=~", "!~", "(", ",", "=>", "matches", "regex", "and", "or", "not", "in", ":"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def unescape(text: str) -> str:
    """Text of a string literal; \\xHH gives the character with that number."""

    def one(m):
        x = m.group(1)
        if x[0] == "x":
            return chr(int(x[1:], 16))
        if x not in _ESCAPES:
            raise RuleError(f"unknown escape \\{x}")
        return _ESCAPES[x]

    return re.sub(r"\\(x[0-9A-Fa-f]{2}|.)", one, text, flags=re.S)


def tokenize(text: str, percent_lists: bool = False) -> list[Token]:
    out: list[Token] = []
    at, line = 0, 1
    while at < len(text):
        last = out[-1].value if out else None
        if text[at] == "/" and text[at : at + 2] not in ("//", "/*") and (not out or last in _BEFORE_REGEX):
            if m := _REGEX.match(text, at):
                out.append(Token("regex", m.group(1), line, at, m.group(2)))
                at = m.end()
                continue
        m = _ANY.match(text, at)
        if not m:
            raise RuleError(f"line {line}: cannot read {text[at : at + 20]!r}")
        kind, raw = m.lastgroup, m.group()
        if kind == "list" and not percent_lists or kind == "time" and not percent_lists:
            m = re.compile(r"%|\d+").match(text, at)
            kind, raw = ("op" if m.group() == "%" else "number"), m.group()
        if kind != "skip":
            value: object = raw
            if kind == "string":
                value = unescape(raw[1:-1])
            elif kind == "number":
                scale = {"KB": 1024, "MB": 1024 * 1024}.get(raw[-2:], 1)
                value = int(raw.removesuffix("KB").removesuffix("MB"), 0) * scale if not re.fullmatch(r"0\d+", raw) else int(raw)
            elif kind == "float":
                value = float(raw)
            elif kind == "list":
                value = raw.strip("%")
            out.append(Token(kind, value, line, at))
        line += raw.count("\n")
        at += len(raw)
    out.append(Token("end", "", line, at))
    return out


class Stream:
    """Tokens with one place to read at."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def next(self) -> Token:
        t = self.now
        self.at = min(self.at + 1, len(self.tokens) - 1)
        return t

    def has(self, *values: str) -> bool:
        return self.now.kind in ("op", "name") and self.now.value in values

    def take(self, *values: str) -> str | None:
        return str(self.next().value) if self.has(*values) else None

    def need(self, value: str) -> Token:
        if not self.has(value):
            raise RuleError(f"line {self.now.line}: expected {value!r}, found {self.now.value!r}")
        return self.next()

    def kind(self, kind: str) -> Token:
        if self.now.kind != kind:
            raise RuleError(f"line {self.now.line}: expected a {kind}, found {self.now.value!r}")
        return self.next()
