"""Pattern rules (byte strings and conditions over one blob): text -> IR, and back.

Expressions are tuples; see `Parser.primary` for the kinds.  A set of strings is "them" or a list of names, which
may end in a star.  A quantifier is "all", "any", "none", ("percent", e) or an expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .lexer import RuleError, Stream, tokenize

TEXT_MODIFIERS = frozenset("nocase wide ascii xor base64 base64wide fullword private".split())
REGEX_MODIFIERS = frozenset("nocase wide ascii fullword private".split())
JUMP_MAX = 2**31 - 1
#: Modifiers that exclude each other.  Fixed values.
EXCLUSIVE = [("base64", "nocase"), ("base64", "xor"), ("base64", "fullword"), ("base64wide", "nocase"), ("base64wide", "xor"), ("base64wide", "fullword"), ("xor", "nocase")]


@dataclass
class Pattern:
    sid: str
    kind: str  # plain | hex | regex
    value: object  # text | token list | (pattern, flags)
    modifiers: dict = field(default_factory=dict)
    anonymous: bool = False

    @property
    def private(self) -> bool:
        return "private" in self.modifiers


@dataclass
class PatternRule:
    name: str
    private: bool = False
    is_global: bool = False
    tags: list = field(default_factory=list)
    meta: list = field(default_factory=list)  # (key, value)
    strings: list = field(default_factory=list)
    condition: tuple = ("lit", True)

    def resolve(self, names) -> list[Pattern]:
        """The strings of a set."""
        if names == "them":
            return list(self.strings)
        out = [p for p in self.strings if any(p.sid == n or n.endswith("*") and p.sid.startswith(n[:-1]) for n in names)]
        missing = [n for n in names if not n.endswith("*") and all(p.sid != n for p in self.strings)]
        if missing:
            raise RuleError(f"rule {self.name}: undefined string ${missing[0]}")
        return out


@dataclass
class RuleFile:
    imports: list = field(default_factory=list)
    includes: list = field(default_factory=list)
    rules: list = field(default_factory=list)


def hex_tokens(text: str) -> list:
    """("byte", n) ("not", token) ("any",) ("high", n) ("low", n) ("jump", lo, hi) ("alt", [[...], ...])"""
    text = re.sub(r"//[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    items = re.findall(r"~?[0-9A-Fa-f?]{2}|\[\s*\d*\s*(?:-\s*\d*\s*)?\]|[()|]|\S", text)
    at = 0

    def sequence(inside: bool) -> list:
        nonlocal at
        out: list = []
        while at < len(items) and items[at] not in (")", "|"):
            x = items[at]
            at += 1
            if x == "(":
                choices = [sequence(True)]
                while at < len(items) and items[at] == "|":
                    at += 1
                    choices.append(sequence(True))
                if at >= len(items):
                    raise RuleError("unclosed ( in a hex string")
                at += 1
                if not all(choices):
                    raise RuleError("empty alternative in a hex string")
                out.append(("alt", choices))
            elif x[0] == "[":
                m = re.fullmatch(r"\[\s*(\d*)\s*(-?)\s*(\d*)\s*\]", x)
                low = int(m[1] or 0)
                high = int(m[3]) if m[3] else None if m[2] else low
                if not m[1] and not m[2] or (high is not None and (high < low or high > JUMP_MAX)) or high is None and inside:
                    raise RuleError(f"bad jump {x}")
                out.append(("jump", low, high))
            else:
                body = x.lstrip("~")
                if not re.fullmatch(r"[0-9A-Fa-f?]{2}", body):
                    raise RuleError(f"bad hex token {x!r}")
                token = ("any",) if body == "??" else ("low", int(body[1], 16)) if body[0] == "?" else ("high", int(body[0], 16)) if body[1] == "?" else ("byte", int(body, 16))
                if x[0] == "~" and token == ("any",):
                    raise RuleError("~?? matches nothing")
                out.append(("not", token) if x[0] == "~" else token)
        return out

    out = sequence(False)
    if at < len(items):
        raise RuleError("unbalanced ) in a hex string")
    if not out or out[0][0] == "jump" or out[-1][0] == "jump":
        raise RuleError("a hex string begins and ends with a byte")
    return out


class Parser(Stream):
    def __init__(self, text: str):
        self.text = text
        self.hex: dict[int, str] = {}
        super().__init__(tokenize(self.without_hex(text)))

    def without_hex(self, text: str) -> str:
        """Hex strings have their own tokens: each is kept apart, a quoted number stands for it."""
        out, at = [], 0
        scan = re.compile(r'"(?:\\.|[^"\\\n])*"|//[^\n]*|/\*.*?\*/|(\$\w*\s*=\s*)\{([^}]*)\}', re.S)
        for m in scan.finditer(text):
            if m[1]:
                out.append(text[at : m.start()] + m[1] + f'"\\x00{len(self.hex)}"' + "\n" * m[2].count("\n"))
                self.hex[len(self.hex)] = m[2]
                at = m.end()
        return "".join(out) + text[at:]

    def file(self) -> RuleFile:
        out = RuleFile()
        while self.now.kind != "end":
            if self.take("import"):
                out.imports.append(self.kind("string").value)
            elif self.take("include"):
                out.includes.append(self.kind("string").value)
            else:
                out.rules.append(self.rule())
        return out

    def rule(self) -> PatternRule:
        flags = set()
        while self.has("private", "global"):
            flags.add(self.next().value)
        self.need("rule")
        rule = PatternRule(str(self.kind("name").value), "private" in flags, "global" in flags)
        if self.take(":"):
            while self.now.kind == "name":
                rule.tags.append(str(self.next().value))
        self.need("{")
        if self.has("meta"):
            self.next()
            self.need(":")
            while self.now.kind == "name" and self.ahead().value == "=":
                key = str(self.next().value)
                self.next()
                negative = bool(self.take("-"))
                t = self.next()
                value = {"true": True, "false": False}.get(t.value, t.value) if t.kind == "name" else t.value
                rule.meta.append((key, -value if negative else value))
        if self.has("strings", "variables"):
            self.next()
            self.need(":")
            while self.now.kind == "var":
                rule.strings.append(self.string(rule))
        self.need("condition")
        self.need(":")
        rule.condition = self.expression()
        self.need("}")
        return rule

    def string(self, rule: PatternRule) -> Pattern:
        sid = str(self.next().value)[1:]
        self.need("=")
        t = self.next()
        anonymous = not sid
        if anonymous:
            sid = f"anon_{sum(p.anonymous for p in rule.strings)}"
        elif any(p.sid == sid for p in rule.strings):
            raise RuleError(f"rule {rule.name}: string ${sid} twice")
        if t.kind == "regex":
            out = Pattern(sid, "regex", (t.value, t.flags), {}, anonymous)
            if set(t.flags) - set("is"):
                raise RuleError(f"rule {rule.name}: unknown flag in /{t.value}/{t.flags}")
        elif t.kind == "string" and str(t.value).startswith("\x00"):
            out = Pattern(sid, "hex", hex_tokens(self.hex[int(str(t.value)[1:])]), {}, anonymous)
        elif t.kind == "string":
            out = Pattern(sid, "plain", t.value, {}, anonymous)
            if not t.value:
                raise RuleError(f"rule {rule.name}: ${sid} is empty")
        else:
            raise RuleError(f"line {t.line}: not a string value")
        allowed = {"plain": TEXT_MODIFIERS, "regex": REGEX_MODIFIERS, "hex": {"private"}}[out.kind]
        while self.now.kind == "name" and self.now.value in TEXT_MODIFIERS:
            name = str(self.next().value)
            if name not in allowed:
                raise RuleError(f"rule {rule.name}: {name} does not go with a {out.kind} string")
            value: object = True
            if name == "xor":
                value = (0, 255)
                if self.take("("):
                    low = int(self.kind("number").value)
                    high = int(self.kind("number").value) if self.take("-") else low
                    self.need(")")
                    if not 0 <= low <= high <= 255:
                        raise RuleError(f"rule {rule.name}: bad xor range")
                    value = (low, high)
            elif name.startswith("base64") and self.take("("):
                value = str(self.kind("string").value)
                self.need(")")
                if len(value) != 64:
                    raise RuleError(f"rule {rule.name}: a base64 alphabet has 64 characters")
            out.modifiers[name] = value
        for a, b in EXCLUSIVE:
            if a in out.modifiers and b in out.modifiers:
                raise RuleError(f"rule {rule.name}: {a} does not go with {b}")
        return out

    # expressions, weakest first
    def expression(self):
        left = self.conjunction()
        while self.take("or"):
            left = ("bin", "or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.take("and"):
            left = ("bin", "and", left, self.negation())
        return left

    def negation(self):
        if self.take("not"):
            return ("not", self.negation())
        if self.take("defined"):
            return ("defined", self.negation())
        return self.relational()

    def relational(self):
        left = self.ladder(0)
        if op := self.take("==", "!=", "<", "<=", ">", ">=", "contains", "icontains", "startswith", "istartswith", "endswith", "iendswith", "iequals", "matches"):
            return ("bin", op, left, self.ladder(0))
        if self.has("of"):
            self.next()
            return self.of(left)
        if self.has("%") and self.ahead().value == "of":
            self.next()
            self.next()
            return self.of(("percent", left))
        return left

    LADDER = (("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "\\", "%"))

    def ladder(self, level: int):
        if level == len(self.LADDER):
            return self.unary()
        left = self.ladder(level + 1)
        while self.has(*self.LADDER[level]) and not (self.has("%") and self.ahead().value == "of"):
            left = ("bin", str(self.next().value), left, self.ladder(level + 1))
        return left

    def unary(self):
        if self.take("-"):
            return ("neg", self.unary())
        if self.take("~"):
            return ("inv", self.unary())
        return self.postfix(self.primary())

    def of(self, quantifier):
        names = self.set()
        restriction = None
        if self.take("at"):
            restriction = ("at", self.ladder(0))
        elif self.take("in"):
            restriction = ("in", *self.range())
        if restriction and isinstance(quantifier, tuple) and quantifier[0] == "percent":
            raise RuleError("a percentage takes no place")
        return ("of", quantifier, names, restriction)

    def set(self):
        if self.take("them"):
            return "them"
        self.need("(")
        names: list = []
        while not self.take(")"):
            if self.now.kind == "var":
                names.append(str(self.next().value)[1:])
            elif self.now.kind == "name" and self.ahead().value in (",", ")", "*"):
                name = str(self.next().value)
                names.append(("rule", name + "*" if self.take("*") else name))
            else:
                names.append(("expr", self.expression()))
            self.take(",")
        return names

    def range(self):
        self.need("(")
        low = self.ladder(0)
        self.need("..")
        high = self.ladder(0)
        self.need(")")
        return low, high

    def loop(self):
        t = self.now
        quantifier = self.next().value if t.kind == "name" and t.value in ("all", "any", "none") else self.ladder(0)
        if self.has("%"):
            self.next()
            quantifier = ("percent", quantifier)
        if self.take("of"):
            names = self.set()
            self.need(":")
            self.need("(")
            body = self.expression()
            self.need(")")
            return ("forof", quantifier, names, body)
        variables = [str(self.kind("name").value)]
        while self.take(","):
            variables.append(str(self.kind("name").value))
        self.need("in")
        items = self.items()
        self.need(":")
        self.need("(")
        body = self.expression()
        self.need(")")
        return ("forin", quantifier, variables, items, body)

    def items(self):
        """A range, a tuple of values or an array or map expression."""
        if self.has("("):
            mark = self.at
            self.next()
            first = self.expression()
            if self.take(".."):
                high = self.expression()
                self.need(")")
                return ("range", first, high)
            out = [first]
            while self.take(","):
                out.append(self.expression())
            if self.take(")"):
                return ("list", out)
            self.at = mark
        return self.ladder(0)

    def primary(self):
        t = self.next()
        if t.kind in ("number", "float", "string"):
            return ("lit", t.value)
        if t.kind == "regex":
            return ("regex", t.value, t.flags)
        if t.kind == "var":
            sid = str(t.value)[1:]
            if self.take("at"):
                return ("at", sid, self.ladder(0))
            if self.has("in") and self.ahead().value == "(":
                self.next()
                return ("in", sid, *self.range())
            return ("str", sid)
        if t.kind == "count":
            sid = str(t.value)[1:]
            if self.has("in"):
                self.next()
                return ("count", sid, *self.range())
            return ("count", sid)
        if t.kind in ("offset", "length"):
            index = None
            if self.take("["):
                index = self.ladder(0)
                self.need("]")
            return (t.kind, str(t.value)[1:], index)
        if t.kind == "op" and t.value == "!":
            return ("length", "", None)
        if t.value == "(":
            first = self.expression()
            if self.take(".."):
                high = self.expression()
                self.need(")")
                return ("range", first, high)
            if self.has(","):
                out = [first]
                while self.take(","):
                    if not self.has(")"):
                        out.append(self.expression())
                self.need(")")
                return ("tuple", out)
            self.need(")")
            return first
        if t.value == "[":
            return self.brackets()
        if t.value == "{":
            return self.braces()
        if t.value == "...":
            return ("spread", self.unary())
        if t.value == "**":
            return ("spread", self.unary())
        if t.kind == "name":
            if t.value in ("true", "false"):
                return ("lit", t.value == "true")
            if t.value in ("any", "all", "none") and self.take("of"):
                return self.of(t.value)
            if t.value == "for":
                return self.loop()
            if t.value == "with":
                bound = []
                while True:
                    name = str(self.next().value).lstrip("$")
                    self.need("=")
                    bound.append((name, self.expression()))
                    if not self.take(","):
                        break
                self.need(":")
                return ("with", bound, self.expression())
            if t.value == "match":
                value = self.expression()
                self.need("{")
                arms = []
                while not self.take("}"):
                    key = None if self.take("_") else self.expression()
                    self.need("=>")
                    arms.append((key, self.expression()))
                    self.take(",")
                return ("match", value, arms)
            if t.value == "lambda":
                names = []
                while not self.take(":"):
                    names.append(str(self.kind("name").value))
                    self.take(",")
                return ("lambda", names, self.expression())
            return ("id", t.value)
        raise RuleError(f"line {t.line}: unexpected {t.value!r}")

    def comprehension(self, *heads):
        names = [str(self.next().value).lstrip("$")]
        while self.take(","):
            names.append(str(self.next().value).lstrip("$"))
        self.need("in")
        items = self.items()
        return ("comp" if len(heads) == 1 else "dictcomp", *heads, names, items, self.expression() if self.take("if") else None)

    def brackets(self):
        if self.take("]"):
            return ("list", [])
        first = self.expression()
        if self.take("for"):
            out = self.comprehension(first)
            self.need("]")
            return out
        items = [first]
        while self.take(","):
            items.append(self.expression())
        self.need("]")
        return ("list", items)

    def braces(self):
        pairs = []
        while not self.take("}"):
            if self.take("**"):
                pairs.append(("spread", self.unary()))
            else:
                key = self.expression()
                self.need(":")
                value = self.expression()
                if self.take("for"):
                    out = self.comprehension(key, value)
                    self.need("}")
                    return out
                pairs.append((key, value))
            self.take(",")
        return ("dict", pairs)

    def postfix(self, left):
        while True:
            if self.has(".") and self.ahead().kind == "name":
                self.next()
                left = ("member", left, str(self.next().value))
            elif self.take("["):
                parts: list = [None, None, None]
                k = 0
                while not self.take("]"):
                    if self.take(":"):
                        k += 1
                    else:
                        parts[k] = self.expression()
                left = ("slice", left, *parts) if k else ("index", left, parts[0])
            elif left[0] in ("id", "member", "lambda") and self.take("("):
                args = []
                while not self.take(")"):
                    args.append(self.expression())
                    self.take(",")
                left = ("call", left, args)
            else:
                return left


def parse(text: str) -> RuleFile:
    return Parser(text).file()


def walk(node):
    """All tuples of an expression, the node first."""
    if isinstance(node, tuple):
        if node and isinstance(node[0], str):
            yield node
        for x in node:
            yield from walk(x)
    elif isinstance(node, list):
        for x in node:
            yield from walk(x)


def quote(text: str) -> str:
    plain = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}
    return '"' + "".join(plain.get(c, c if 32 <= ord(c) < 127 or ord(c) > 255 else f"\\x{ord(c):02x}") for c in text) + '"'


def hex_text(tokens) -> str:
    one = {"byte": lambda t: f"{t[1]:02X}", "any": lambda t: "??", "low": lambda t: f"?{t[1]:X}", "high": lambda t: f"{t[1]:X}?", "not": lambda t: "~" + hex_text([t[1]]),
           "jump": lambda t: f"[{t[1]}]" if t[1] == t[2] else f"[{t[1]}-{'' if t[2] is None else t[2]}]", "alt": lambda t: "(" + "|".join(map(hex_text, t[1])) + ")"}
    return " ".join(one[t[0]](t) for t in tokens)


def text_of(n) -> str:
    """Source of an expression; brackets wherever they may matter."""
    if n is None:
        return ""
    kind = n[0]
    of_set = lambda s: "them" if s == "them" else "(" + ", ".join(f"${x}" if isinstance(x, str) else x[1] if x[0] == "rule" else text_of(x[1]) for x in s) + ")"
    quantifier = lambda q: q if isinstance(q, str) else f"{text_of(q[1])}%" if q[0] == "percent" else text_of(q)
    if kind == "lit":
        return {True: "true", False: "false"}[n[1]] if isinstance(n[1], bool) else quote(n[1]) if isinstance(n[1], str) else str(n[1])
    if kind == "regex":
        return f"/{n[1]}/{n[2]}"
    if kind == "str":
        return f"${n[1]}"
    if kind == "count":
        return f"#{n[1]}" + (f" in ({text_of(n[2])}..{text_of(n[3])})" if len(n) > 2 else "")
    if kind in ("offset", "length"):
        return ("@" if kind == "offset" else "!") + n[1] + (f"[{text_of(n[2])}]" if n[2] else "")
    if kind == "at":
        return f"${n[1]} at {text_of(n[2])}"
    if kind == "in":
        return f"${n[1]} in ({text_of(n[2])}..{text_of(n[3])})"
    if kind == "of":
        r = n[3]
        return f"{quantifier(n[1])} of {of_set(n[2])}" + ("" if not r else f" at {text_of(r[1])}" if r[0] == "at" else f" in ({text_of(r[1])}..{text_of(r[2])})")
    if kind == "forof":
        return f"for {quantifier(n[1])} of {of_set(n[2])} : ({text_of(n[3])})"
    if kind == "forin":
        items = text_of(n[3]) if n[3][0] != "list" else "(" + ", ".join(map(text_of, n[3][1])) + ")"
        return f"for {quantifier(n[1])} {', '.join(n[2])} in {items} : ({text_of(n[4])})"
    if kind == "bin":
        return f"({text_of(n[2])} {n[1]} {text_of(n[3])})"
    if kind in ("not", "defined"):
        return f"{kind} ({text_of(n[1])})"
    if kind in ("neg", "inv"):
        return ("-" if kind == "neg" else "~") + text_of(n[1])
    if kind == "id":
        return n[1]
    if kind == "member":
        return f"{text_of(n[1])}.{n[2]}"
    if kind == "index":
        return f"{text_of(n[1])}[{text_of(n[2])}]"
    if kind == "slice":
        return f"{text_of(n[1])}[{':'.join(map(text_of, n[2:]))}]"
    if kind == "call":
        return f"{text_of(n[1])}({', '.join(map(text_of, n[2]))})"
    if kind == "range":
        return f"({text_of(n[1])}..{text_of(n[2])})"
    if kind in ("list", "tuple"):
        inside = ", ".join(map(text_of, n[1]))
        return f"[{inside}]" if kind == "list" else f"({inside})"
    if kind == "dict":
        return "{" + ", ".join(f"**{text_of(v)}" if k == "spread" else f"{text_of(k)}: {text_of(v)}" for k, v in n[1]) + "}"
    if kind == "comp":
        return f"[{text_of(n[1])} for {', '.join(n[2])} in {text_of(n[3])}" + (f" if {text_of(n[4])}]" if n[4] else "]")
    if kind == "dictcomp":
        return f"{{{text_of(n[1])}: {text_of(n[2])} for {', '.join(n[3])} in {text_of(n[4])}" + (f" if {text_of(n[5])}}}" if n[5] else "}")
    if kind == "with":
        return "with " + ", ".join(f"${k} = {text_of(v)}" for k, v in n[1]) + f" : ({text_of(n[2])})"
    if kind == "match":
        return f"match {text_of(n[1])} {{ " + ", ".join(f"{text_of(k) if k else '_'} => {text_of(v)}" for k, v in n[2]) + " }"
    if kind == "lambda":
        return f"lambda {', '.join(n[1])}: {text_of(n[2])}"
    if kind == "spread":
        return f"...{text_of(n[1])}"
    raise RuleError(f"no text for {kind}")


def modifier_text(name: str, value) -> str:
    return name if value is True or value == (0, 255) else f"{name}({value[0]})" if isinstance(value, tuple) and value[0] == value[1] else f"{name}({value[0]}-{value[1]})" if isinstance(value, tuple) else f"{name}({quote(value)})"


def generate(rules: RuleFile | PatternRule) -> str:
    """Rule text; parsing it gives equal rules."""
    if isinstance(rules, RuleFile):
        head = [f"import {quote(x)}" for x in rules.imports] + [f"include {quote(x)}" for x in rules.includes]
        return "\n".join(head + [generate(r) for r in rules.rules]) + "\n"
    r = rules
    out = ["global " * r.is_global + "private " * r.private + f"rule {r.name}" + (f" : {' '.join(r.tags)}" if r.tags else "") + " {"]
    if r.meta:
        out += ["  meta:", *(f"    {k} = {text_of(('lit', v))}" for k, v in r.meta)]
    if r.strings:
        out.append("  strings:")
        for p in r.strings:
            value = quote(p.value) if p.kind == "plain" else f"/{p.value[0]}/{p.value[1]}" if p.kind == "regex" else "{ " + hex_text(p.value) + " }"
            out.append(f"    ${'' if p.anonymous else p.sid} = {value}" + "".join(" " + modifier_text(k, v) for k, v in p.modifiers.items()))
    return "\n".join([*out, "  condition:", f"    {text_of(r.condition)}", "}"])
