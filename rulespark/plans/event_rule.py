"""Event rules: text -> IR.

Expressions are tuples: ("lit", v) ("regex", pattern, nocase) ("list", name) ("field", var, path) ("var", name)
("count", name) ("call", name, args) ("bin", op, a, b) ("not", a) ("neg", a) ("null", a, negated)
("in", a, b, negated) ("match", a, b, negated) ("nocase", a) ("if", c, a, b) ("of", n, items).
A path is a tuple of names and of ("key", k) or ("index", i).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .lexer import RuleError, Stream, tokenize

UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}
SECTIONS = ("meta", "events", "match", "outcome", "condition", "options")
AGGREGATES = frozenset("count count_distinct sum avg min max array array_distinct earliest latest string_concat".split())
NAMESPACES = frozenset("metadata principal target observer src dst network security_result about additional".split())


@dataclass
class Window:
    amount: int = 1
    unit: str = "minutes"
    slide: tuple[int, str] | None = None
    anchor: tuple[str, str] | None = None  # (after | before, event variable)

    @property
    def seconds(self) -> int:
        return self.amount * {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}[self.unit]

    @property
    def text(self) -> str:
        return f"{self.amount} {self.unit}"


@dataclass
class EventRule:
    name: str
    meta: dict = field(default_factory=dict)
    events: list = field(default_factory=list)
    joins: list = field(default_factory=list)  # (kind, left, right, condition)
    match: list = field(default_factory=list)  # (name, grouping expression or None)
    window: Window | None = None
    outcome: list = field(default_factory=list)  # (name, expression)
    condition: tuple | None = None
    options: dict = field(default_factory=dict)


class Parser(Stream):
    def __init__(self, text: str):
        super().__init__(tokenize(text, percent_lists=True))

    def rules(self) -> list[EventRule]:
        out = []
        while self.now.kind != "end":
            out.append(self.rule())
        return out

    def rule(self) -> EventRule:
        self.need("rule")
        rule = EventRule(str(self.kind("name").value))
        self.need("{")
        while not self.take("}"):
            section = str(self.kind("name").value)
            if section not in SECTIONS:
                raise RuleError(f"rule {rule.name}: unknown section {section!r}")
            self.need(":")
            getattr(self, "read_" + section)(rule)
        if not rule.events:
            raise RuleError(f"rule {rule.name}: no events")
        if rule.condition is None:
            raise RuleError(f"rule {rule.name}: no condition")
        return rule

    def ends(self) -> bool:
        return self.has("}") or self.now.kind == "name" and self.now.value in SECTIONS and self.ahead().value == ":"

    def read_meta(self, rule):
        while not self.ends():
            key = str(self.kind("name").value)
            self.need("=")
            rule.meta[key] = self.constant()

    def constant(self):
        negative = bool(self.take("-"))
        t = self.next()
        if t.kind == "name" and t.value in ("true", "false"):
            return t.value == "true"
        if t.kind not in ("string", "number", "float", "time"):
            raise RuleError(f"line {t.line}: expected a constant, found {t.value!r}")
        return -t.value if negative else t.value

    def read_options(self, rule):
        while not self.ends():
            key = str(self.kind("name").value)
            self.need("=")
            rule.options[key] = self.constant()
            self.take(",")

    def read_events(self, rule):
        while not self.ends():
            if self.has("join"):
                self.next()
                kind = self.take("left", "right", "full", "inner") or "inner"
                left = str(self.kind("var").value)[1:]
                self.need("with")
                right = str(self.kind("var").value)[1:]
                self.need("on")
                rule.joins.append((kind, left, right, self.expression()))
            elif self.now.kind == "var" and self.ahead().value == "followed":
                a = str(self.next().value)[1:]
                self.next()
                self.need("by")
                b = str(self.kind("var").value)[1:]
                rule.events.append(("followed", a, b))
            else:
                rule.events.append(self.expression())
            self.take(",")

    def duration(self) -> tuple[int, str]:
        t = self.next()
        if t.kind == "time":
            amount, unit = int(t.value[:-1]), UNITS[t.value[-1]]
        elif t.kind == "number":
            amount, unit = int(t.value), "minutes"
        else:
            raise RuleError(f"line {t.line}: expected a duration, found {t.value!r}")
        if amount <= 0:
            raise RuleError(f"line {t.line}: a window must be longer than 0")
        return amount, unit

    def read_match(self, rule):
        alone = False  # whether no variable came since the last window: another `over` then takes its place
        while not self.ends():
            if self.take("over"):
                window = Window(*self.duration()) if not self.has("every") else None
                if self.take("every"):
                    if window:
                        window.slide = self.duration()
                    else:
                        window = Window(*self.duration())
                if how := self.take("after", "before"):
                    window.anchor = (how, str(self.kind("var").value)[1:])
                if rule.window and rule.window != window and not alone:
                    raise RuleError(f"rule {rule.name}: one window for all match variables")
                rule.window, alone = window, True
            else:
                alone = False
                name = str(self.kind("var").value)[1:]
                rule.match.append((name, self.additive() if self.take("=") else None))
            self.take(",")
        rule.window = rule.window or Window()

    def read_outcome(self, rule):
        while not self.ends():
            if self.has("if"):  # without a name it is `_`, then `_2` and so on
                n = sum(k == "_" or k[:1] == "_" and k[1:].isdigit() for k, _ in rule.outcome)
                rule.outcome.append(("_" if not n else f"_{n + 1}", self.expression()))
                self.take(",")
                continue
            t = self.next()
            if t.kind not in ("var", "name"):
                raise RuleError(f"line {t.line}: an outcome needs a name")
            name = str(t.value).lstrip("$")
            if name in dict(rule.outcome):
                raise RuleError(f"rule {rule.name}: outcome {name} twice")
            self.need("=")
            rule.outcome.append((name, self.expression()))
            self.take(",")

    def read_condition(self, rule):
        rule.condition = self.expression()

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
            inner = self.negation()
            if inner[0] in ("in", "match", "null"):
                return (*inner[:-1], not inner[-1])
            return ("not", inner)
        return self.comparison()

    def comparison(self):
        if self.now.kind in ("number", "name") and self.ahead().value == "of" and self.now.value != "not":
            n = self.next().value
            self.next()
            self.need("(")
            items = [self.expression()]
            while self.take(","):
                items.append(self.expression())
            self.need(")")
            return ("of", {"any": 1, "all": len(items)}.get(n, n), items)
        left = self.additive()
        negated = bool(self.has("not") and self.ahead().value in ("in", "matches") and self.next())
        if self.take("is"):
            negated = bool(self.take("not"))
            self.need("null")
            return ("null", left, negated)
        if self.take("in"):
            return ("in", left, self.additive(), negated)
        if op := self.take("matches", "regex", "=~", "!~"):
            return self.nocase(("match", left, self.additive(), negated or op == "!~"))
        if op := self.take("=", "==", "!=", "<", "<=", ">", ">="):
            right = self.additive()
            if right[0] == "regex":
                return self.nocase(("match", left, right, op == "!="))
            return self.nocase(("bin", "==" if op == "=" else op, left, right))
        return self.nocase(left)

    def nocase(self, node):
        return ("nocase", node) if self.take("nocase") else node

    def additive(self):
        left = self.product()
        while op := self.take("+", "-"):
            left = ("bin", op, left, self.product())
        return left

    def product(self):
        left = self.primary()
        while op := self.take("*", "/"):
            left = ("bin", op, left, self.primary())
        return left

    def path(self, first: list) -> tuple:
        while True:
            if self.has(".") and self.ahead().kind == "name":
                self.next()
                first.append(str(self.next().value))
            elif self.take("["):
                t = self.next()
                first.append(("key", t.value) if t.kind == "string" else ("index", t.value))
                self.need("]")
            else:
                return tuple(first)

    def primary(self):
        t = self.next()
        if t.kind in ("string", "number", "float"):
            return ("lit", t.value)
        if t.kind == "time":
            return ("lit", Window(int(t.value[:-1]), UNITS[t.value[-1]]).seconds)
        if t.kind == "regex":
            return ("regex", t.value, "i" in t.flags)
        if t.kind == "list":
            return ("list", t.value)
        if t.kind == "count":
            return ("count", str(t.value)[1:])
        if t.kind == "var":
            name = str(t.value)[1:]
            if self.has(".", "["):
                return ("field", name, self.path([]))
            return ("var", name)
        if t.value == "(":
            inside = self.expression()
            self.need(")")
            return inside
        if t.value == "-":
            return ("neg", self.primary())
        if t.value == "if":
            paren = bool(self.take("("))
            condition = self.expression()
            if paren and self.take(","):
                yes = self.expression()
                no = self.expression() if self.take(",") else None
                self.need(")")
                return ("if", condition, yes, no)
            if paren:
                self.need(")")
            self.need("then")
            yes = self.expression()
            return ("if", condition, yes, self.expression() if self.take("else") else None)
        if t.kind == "name":
            if t.value in ("true", "false"):
                return ("lit", t.value == "true")
            path = self.path([str(t.value)])
            if self.take("("):
                args = []
                while not self.take(")"):
                    args.append(self.expression())
                    self.take(",")
                return ("call", ".".join(path), args)
            if path[0] in NAMESPACES:
                return ("field", None, path)
        raise RuleError(f"line {t.line}: unexpected {t.value!r}")


def parse(text: str) -> list[EventRule]:
    return Parser(text).rules()


def walk(node):
    """All nodes of an expression."""
    if isinstance(node, tuple) and node:
        if isinstance(node[0], str):
            yield node
        for x in node:
            if isinstance(x, (tuple, list)):
                for y in x if isinstance(x, list) else [x]:
                    yield from walk(y)


def event_variables(rule: EventRule) -> list[str]:
    """Names that have fields, in order of appearance; the first stands for bare paths."""
    found: dict[str, None] = {}
    for part in (*rule.events, *(j[3] for j in rule.joins), *(g for _, g in rule.match if g), *(e for _, e in rule.outcome)):
        for n in walk(part):
            if n[0] == "field" and n[1]:
                found[n[1]] = None
            if n[0] == "followed":
                found[n[1]] = found[n[2]] = None
    return list(found) or ["e"]


def text_of(node) -> str:
    """Source of an expression."""
    kind = node[0]
    if kind == "lit":
        return ("true" if node[1] else "false") if isinstance(node[1], bool) else ('"' + node[1].replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(node[1], str) else str(node[1]))
    if kind == "regex":
        return f"/{node[1]}/" + "i" * node[2]
    if kind == "list":
        return f"%{node[1]}%"
    if kind == "var":
        return f"${node[1]}"
    if kind == "count":
        return f"#{node[1]}"
    if kind == "field":
        steps = "".join(f".{s}" if isinstance(s, str) else f'["{s[1]}"]' if s[0] == "key" else f"[{s[1]}]" for s in node[2])
        return f"${node[1]}{steps}" if node[1] else steps[1:]
    if kind == "call":
        return f"{node[1]}({', '.join(map(text_of, node[2]))})"
    if kind == "bin":
        return f"({text_of(node[2])} {node[1]} {text_of(node[3])})"
    if kind == "not":
        return f"not ({text_of(node[1])})"
    if kind == "neg":
        return f"-{text_of(node[1])}"
    if kind == "null":
        return f"{text_of(node[1])} is {'not ' * node[2]}null"
    if kind in ("in", "match"):
        return f"{text_of(node[1])} {'not ' * node[3]}{'in' if kind == 'in' else 'matches'} {text_of(node[2])}"
    if kind == "nocase":
        return f"{text_of(node[1])} nocase"
    if kind == "if":
        return f"if({', '.join(text_of(x) for x in node[1:] if x)})"
    if kind == "of":
        return f"{node[1]} of ({', '.join(map(text_of, node[2]))})"
    if kind == "followed":
        return f"${node[1]} followed by ${node[2]}"
    raise RuleError(f"no text for {kind}")


def generate(rule: EventRule) -> str:
    """Rule text; parsing it gives an equal rule."""
    constant = lambda v: text_of(("lit", v))
    out = [f"rule {rule.name} {{"]
    if rule.meta:
        out += ["  meta:", *(f"    {k} = {constant(v)}" for k, v in rule.meta.items())]
    out += ["  events:", *(f"    {text_of(e)}" for e in rule.events), *(f"    join {k} ${a} with ${b} on {text_of(c)}" for k, a, b, c in rule.joins)]
    if rule.match:
        short = {v: k for k, v in UNITS.items()}
        w = rule.window
        over = f"over {w.amount}{short[w.unit]}" + (f" every {w.slide[0]}{short[w.slide[1]]}" if w.slide else "") + (f" {w.anchor[0]} ${w.anchor[1]}" if w.anchor else "")
        out += ["  match:", "    " + ", ".join(f"${n}" + (f" = {text_of(g)}" if g else "") for n, g in rule.match) + " " + over]
    if rule.outcome:
        out += ["  outcome:", *(f"    ${n} = {text_of(e)}" for n, e in rule.outcome)]
    out += ["  condition:", f"    {text_of(rule.condition)}"]
    if rule.options:
        out += ["  options:", *(f"    {k} = {constant(v)}" for k, v in rule.options.items())]
    return "\n".join([*out, "}"]) + "\n"


#: Scores of a predicate's selectivity: by operator, and by words of the field.  Fixed values.
OPERATOR_SCORES = {"==": 10.0, "!=": 8.0, ">": 5.0, "<": 5.0, ">=": 5.0, "<=": 5.0, "matches": 3.0}
FIELD_SCORES = (("event_type", 5.0), ("hostname", 4.0), ("ip", 4.0), ("user", 3.0), ("timestamp", 2.0))


def selectivity(node) -> float:
    """How much a predicate is likely to leave out; 0 for anything but a field against a value."""
    op, left, right = ("matches", node[1], node[2]) if node[0] == "match" else (node[1], node[2], node[3]) if node[0] == "bin" else ("", (), ())
    if op not in OPERATOR_SCORES or not left or left[0] != "field":
        return 0.0
    parts = [x for x in left[2] if isinstance(x, str)]
    field = next((score for word, score in FIELD_SCORES if word in parts or word == "event_type" and word in ".".join(parts)), 0.0)
    return OPERATOR_SCORES[op] + field + (2.0 if right[0] == "lit" and isinstance(right[1], str) else 0.0)


def by_selectivity(rule: EventRule) -> EventRule:
    """The rule with its most selective event statements first; others keep their order."""
    from dataclasses import replace

    return replace(rule, events=sorted(rule.events, key=lambda e: -selectivity(e)))


def validate(rule: EventRule) -> list[tuple[str, str]]:
    """(severity, message) of what is wrong or doubtful."""
    out = []
    known = set(event_variables(rule)) | {n for n, _ in rule.match} | {n for n, _ in rule.outcome}
    bound = {n[1] for e in rule.events for n in walk(e) if n[0] == "var"}
    for n, grouping in rule.match:
        if n not in bound and not grouping:
            out.append(("error", f"match variable ${n} is not bound in events"))
    for n in walk(rule.condition):
        if n[0] in ("var", "count") and n[1] not in known | bound:
            out.append(("error", f"unknown variable {n[1]} in the condition"))
    for name, e in rule.outcome:
        for n in walk(e):
            if n[0] == "call" and "." not in n[1] and n[1] not in AGGREGATES:
                out.append(("warning", f"unknown function {n[1]} in outcome {name}"))
    for key in ("author", "description"):
        if key not in rule.meta:
            out.append(("warning", f"meta has no {key}"))
    if rule.window and rule.window.seconds > 30 * 86400:
        out.append(("warning", "window longer than 30 days"))
    return out
