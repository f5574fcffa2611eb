"""Building conditions and hex strings in Python.

    (S("mz").at(0) & (S("url").count > 2) & any_of("a", "b*")) | (filesize < 2 * KB)
    Hex().bytes(0x4D, 0x5A).wildcard(2).jump(2, 4).either("AA", "BB CC").text()
"""

from __future__ import annotations

from rulespark.plans.lexer import RuleError
from rulespark.plans.pattern_rule import hex_text, hex_tokens, text_of

KB, MB = 1024, 1024 * 1024


class E:
    """An expression; operators of Python make larger ones.  `node` is the parser's form of it."""

    def __init__(self, node: tuple):
        self.node = node

    def __str__(self) -> str:
        return text_of(self.node)

    def _(self, op: str, other, swap: bool = False) -> E:
        a, b = (expression(other).node, self.node) if swap else (self.node, expression(other).node)
        return E(("bin", op, a, b))

    def __and__(self, other):
        """`and` of conditions; of numbers, `bitand`."""
        return self._("and", other)

    def __or__(self, other):
        return self._("or", other)

    def __invert__(self):
        return E(("not", self.node))

    def __eq__(self, other):  # type: ignore[override]
        return self._("==", other)

    def __ne__(self, other):  # type: ignore[override]
        return self._("!=", other)

    def __lt__(self, other):
        return self._("<", other)

    def __le__(self, other):
        return self._("<=", other)

    def __gt__(self, other):
        return self._(">", other)

    def __ge__(self, other):
        return self._(">=", other)

    def __add__(self, other):
        return self._("+", other)

    def __radd__(self, other):
        return self._("+", other, True)

    def __sub__(self, other):
        return self._("-", other)

    def __rsub__(self, other):
        return self._("-", other, True)

    def __mul__(self, other):
        return self._("*", other)

    def __rmul__(self, other):
        return self._("*", other, True)

    def __floordiv__(self, other):
        return self._("\\", other)

    def __mod__(self, other):
        return self._("%", other)

    def __lshift__(self, other):
        return self._("<<", other)

    def __rshift__(self, other):
        return self._(">>", other)

    def __xor__(self, other):
        return self._("^", other)

    def __neg__(self):
        return E(("neg", self.node))

    __hash__ = None  # type: ignore[assignment]

    def bitand(self, other) -> E:
        return self._("&", other)

    def bitor(self, other) -> E:
        return self._("|", other)

    def bitnot(self) -> E:
        return E(("inv", self.node))

    def contains(self, other, nocase: bool = False) -> E:
        return self._("icontains" if nocase else "contains", other)

    def startswith(self, other, nocase: bool = False) -> E:
        return self._("istartswith" if nocase else "startswith", other)

    def endswith(self, other, nocase: bool = False) -> E:
        return self._("iendswith" if nocase else "endswith", other)

    def iequals(self, other) -> E:
        return self._("iequals", other)

    def matches(self, pattern: str, flags: str = "") -> E:
        return E(("bin", "matches", self.node, ("regex", pattern, flags)))

    def defined(self) -> E:
        return E(("defined", self.node))

    def member(self, name: str) -> E:
        return E(("member", self.node, name))

    def __getitem__(self, index) -> E:
        return E(("index", self.node, expression(index).node))

    def __call__(self, *args) -> E:
        return E(("call", self.node, [expression(a).node for a in args]))


def expression(x) -> E:
    if isinstance(x, E):
        return x
    if isinstance(x, (bool, int, float, str)):
        return E(("neg", ("lit", -x))) if not isinstance(x, (bool, str)) and x < 0 else E(("lit", x))
    raise RuleError(f"no expression: {x!r}")


class S(E):
    """A string of the rule; without a name, the string of a loop."""

    def __init__(self, sid: str = ""):
        super().__init__(("str", sid.lstrip("$")))
        self.sid = sid.lstrip("$")

    def at(self, place) -> E:
        return E(("at", self.sid, expression(place).node))

    def within(self, low, high) -> E:
        return E(("in", self.sid, expression(low).node, expression(high).node))

    @property
    def count(self) -> E:
        return E(("count", self.sid))

    def count_in(self, low, high) -> E:
        return E(("count", self.sid, expression(low).node, expression(high).node))

    def offset(self, n=1) -> E:
        return E(("offset", self.sid, expression(n).node))

    def length(self, n=1) -> E:
        return E(("length", self.sid, expression(n).node))


def name(path: str) -> E:
    """A name, or members of one: name("pe.machine"), name("math.entropy")(0, filesize)."""
    first, *rest = path.split(".")
    out = E(("id", first))
    for x in rest:
        out = out.member(x)
    return out


filesize = name("filesize")
entrypoint = name("entrypoint")


def _set(sids) -> list | str:
    return [s.lstrip("$") for s in sids] or "them"


def _quantifier(n):
    return n if isinstance(n, str) else expression(n).node


def of(quantifier, *sids: str) -> E:
    """`quantifier of (strings)`; no string stands for them all.  "50%" is a share."""
    if isinstance(quantifier, str) and quantifier.endswith("%"):
        return E(("of", ("percent", ("lit", int(quantifier[:-1]))), _set(sids), None))
    return E(("of", _quantifier(quantifier), _set(sids), None))


def any_of(*sids: str) -> E:
    return of("any", *sids)


def all_of(*sids: str) -> E:
    return of("all", *sids)


def none_of(*sids: str) -> E:
    return of("none", *sids)


def n_of(n: int, *sids: str) -> E:
    return of(n, *sids)


def for_strings(quantifier, body, *sids: str) -> E:
    """`for quantifier of strings : (body)`; `S()` in the body is the string."""
    return E(("forof", _quantifier(quantifier), _set(sids), expression(body).node))


def for_range(quantifier, variable: str, low, high, body) -> E:
    return E(("forin", _quantifier(quantifier), [variable], ("range", expression(low).node, expression(high).node), expression(body).node))


def for_each(quantifier, variable: str, items, body) -> E:
    source = ("list", [expression(x).node for x in items]) if isinstance(items, (list, tuple)) else expression(items).node
    return E(("forin", _quantifier(quantifier), [variable], source, expression(body).node))


class Hex:
    """A hex string under construction."""

    def __init__(self):
        self.tokens: list = []

    def bytes(self, *values: int) -> Hex:
        self.tokens += [("byte", v) for v in values]
        return self

    def wildcard(self, n: int = 1) -> Hex:
        self.tokens += [("any",)] * n
        return self

    def nibble(self, token: str) -> Hex:
        """`4?` or `?4`."""
        self.tokens += hex_tokens(token)
        return self

    def other_than(self, token: str) -> Hex:
        self.tokens += hex_tokens("~" + token)
        return self

    def jump(self, low: int, high: int | None = None) -> Hex:
        self.tokens.append(("jump", low, low if high is None else high))
        return self

    def jump_from(self, low: int) -> Hex:
        self.tokens.append(("jump", low, None))
        return self

    def either(self, *choices: str) -> Hex:
        self.tokens.append(("alt", [hex_tokens(c) for c in choices]))
        return self

    def text(self) -> str:
        out = hex_text(self.tokens)
        hex_tokens(out)  # a string that the parser would refuse is refused here
        return out
