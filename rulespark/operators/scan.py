"""Pattern rules over a table of blobs, as Columns.

Bytes are read as a latin-1 string, one character for a byte, so strings of every kind become Java regular
expressions.  `$a` is `contains` or `rlike`; counts, offsets and lengths come from look-aheads, which find
overlapping matches.  Nothing leaves the JVM (but for `many_literals` with large sets), and strings that no
condition needs are never searched.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespark.functions import binaries as B
from rulespark.functions import modules as M
from rulespark.plans.lexer import RuleError
from rulespark.plans.pattern_rule import Pattern, PatternRule, RuleFile, parse, walk

ANY_BYTE = r"[\x00-\xff]"


def _bytes(text: str) -> bytes:
    return text.encode("latin-1") if all(ord(c) < 256 for c in text) else text.encode("utf-8")


def _literal(raw: bytes) -> str:
    return "".join(f"\\x{b:02x}" for b in raw)


def _word(body: str, wide: bool) -> str:
    zero = r"\x00" if wide else ""
    return f"(?<![A-Za-z0-9]{zero})(?:{body})(?![A-Za-z0-9]{zero})"


def base64_forms(raw: bytes, alphabet: str | None = None) -> list[bytes]:
    """The text of raw in base64 at each of the three alignments, without characters that depend on neighbours."""
    standard = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    swap = bytes.maketrans(standard.encode(), (alphabet or standard).encode("latin-1"))
    out = []
    for lead in range(3):
        text = base64.b64encode(b"\0" * lead + raw)
        bits = 8 * (lead + len(raw))
        text = text[(0, 2, 3)[lead] : bits // 6]
        if text:
            out.append(text.translate(swap))
    return out


def hex_regex(tokens) -> str:
    def one(t) -> str:
        if t[0] == "byte":
            return f"\\x{t[1]:02x}"
        if t[0] == "any":
            return ANY_BYTE
        if t[0] == "high":
            return f"[\\x{t[1]:x}0-\\x{t[1]:x}f]"
        if t[0] == "low":
            return "[" + "".join(f"\\x{h:x}{t[1]:x}" for h in range(16)) + "]"
        if t[0] == "not":
            inner = one(t[1])
            return f"[^{inner.strip('[]')}]"
        if t[0] == "jump":
            return f"{ANY_BYTE}{{{t[1]},{'' if t[2] is None else t[2]}}}?"
        return "(?:" + "|".join("".join(map(one, c)) for c in t[1]) + ")"

    return "".join(map(one, tokens))


#: One atom of a regular expression: escape, class, or a single character.
ATOM = re.compile(r"\\x[0-9A-Fa-f]{2}|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", re.S)
QUANTIFIER = re.compile(r"[*+?]\??|\{\d*,?\d*\}\??")


def wide_regex(pattern: str) -> str:
    """A regular expression whose every character has a zero byte after it."""
    out, at = [], 0
    while at < len(pattern):
        if quantifier := QUANTIFIER.match(pattern, at):
            out.append(quantifier.group())
            at = quantifier.end()
            continue
        if group := re.compile(r"\(\?(?:[:=!]|<[=!])").match(pattern, at):
            out.append(group.group())
            at = group.end()
            continue
        atom = ATOM.match(pattern, at)
        text, at = atom.group(), atom.end()
        out.append(text if text in ("(", ")", "|", "^", "$", "\\b", "\\B") else f"(?:{text}\\x00)")
    return "".join(out)


def regex_of(p: Pattern) -> str:
    """A Java regular expression over the latin-1 view of the bytes."""
    m = p.modifiers
    if p.kind == "hex":
        return hex_regex(p.value)
    widths = [w for w in (False, True) if w and "wide" in m or not w and ("ascii" in m or "wide" not in m)]
    if p.kind == "regex":
        pattern, flags = p.value
        # d: only \n ends a line, as for bytes
        flags = "d" + ("i" if "i" in flags or "nocase" in m else "") + ("s" if "s" in flags else "") + ("m" if "m" in flags else "")
        forms = [f"(?{flags}:{wide_regex(pattern) if w else pattern})" for w in widths]
        forms = [_word(x, w) if "fullword" in m else x for x, w in zip(forms, widths)]
        return forms[0] if len(forms) == 1 else "(?:" + "|".join(forms) + ")"
    raw, forms = _bytes(p.value), []
    wide = lambda b: b"".join(bytes((x, 0)) for x in b)
    if "base64" in m or "base64wide" in m:
        for name in ("base64", "base64wide"):
            if name in m:
                for text in base64_forms(raw, m[name] if isinstance(m[name], str) else None):
                    forms.append(_literal(wide(text) if name == "base64wide" else text))
        return "(?:" + "|".join(forms) + ")"
    for w in widths:
        body = wide(raw) if w else raw
        if "xor" in m:
            low, high = m["xor"]
            forms += [_literal(bytes(b ^ k for b in body)) for k in range(low, high + 1)]
        elif "nocase" in m:
            forms.append("(?i:" + _literal(body) + ")")
        else:
            forms.append(_literal(body))
        if "fullword" in m:
            forms[-1] = _word(forms[-1], w)
    return forms[0] if len(forms) == 1 else "(?:" + "|".join(forms) + ")"


def running(numbers: Column, finish=lambda x: x) -> Column:
    """Running sums of an array of longs.

    Sums go by runs of 128: an array that grows by one place is copied each time, so long ones are not grown that way.
    """
    none, run = F.array().cast("array<bigint>"), 128

    def sums(x: Column) -> Column:
        return F.aggregate(x, none, lambda a, n: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("long")) + n))

    def joined(parts: Column) -> Column:
        before = sums(F.transform(parts, lambda x: F.get(x, F.size(x) - 1)))
        return F.flatten(F.zip_with(parts, F.slice(F.concat(F.array(F.lit(0).cast("long")), before), F.lit(1), F.size(parts)), lambda x, b: F.transform(x, lambda y: finish(y + b))))

    whole = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / run).cast("int")), lambda k: sums(F.slice(x, k * run + 1, F.lit(run))))
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return let(numbers, lambda x: F.when(F.size(x) > 0, let(whole(x), joined)).otherwise(none))


@dataclass
class Context:
    data: Column
    latin: Column
    externals: dict = field(default_factory=dict)
    rules: dict = field(default_factory=dict)  # name -> Column
    env: dict = field(default_factory=dict)  # loop and with variables: name -> (Column, kind)
    modules: dict = field(default_factory=dict)  # name -> struct read from the bytes

    def found(self, p: Pattern) -> Column:
        if p.kind == "plain" and not set(p.modifiers) - {"ascii", "private"}:
            return F.contains(self.latin, F.lit(_bytes(p.value).decode("latin-1")))
        return self.latin.rlike(regex_of(p))

    def matches(self, p: Pattern) -> Column:
        """Matched bytes (latin-1) of every start, overlapping ones too."""
        return F.regexp_extract_all(self.latin, F.lit(f"(?=({regex_of(p)})){ANY_BYTE}"), F.lit(1))

    def count(self, p: Pattern) -> Column:
        return F.regexp_count(self.latin, F.lit(f"(?={regex_of(p)}){ANY_BYTE}")).cast("long")

    def offsets(self, p: Pattern) -> Column:
        """Starts of all matches: each is the end of the one before plus the gap in between."""
        # the rest of the text is a match too, or each of its places would be searched to the end; it is cut off
        gaps = F.regexp_extract_all(self.latin, F.lit(f"(?s)(.*?)(?:(?={regex_of(p)}){ANY_BYTE}|\\z)"), F.lit(1))
        gaps = F.slice(gaps, F.lit(1), self.count(p).cast("int"))
        return running(F.transform(gaps, lambda g: F.length(g).cast("long") + 1), lambda x: x - 1)

    def lengths(self, p: Pattern) -> Column:
        return F.transform(self.matches(p), lambda x: F.length(x).cast("long"))


class Compiler:
    """Conditions of one rule to (Column, kind); kinds: bool int float string array map range unknown."""

    def __init__(self, rule: PatternRule, context: Context):
        self.rule, self.c = rule, context
        self.current: Pattern | None = None

    def condition(self) -> Column:
        return F.coalesce(self.truth(self.rule.condition), F.lit(False))

    def string(self, sid: str) -> Pattern:
        if not sid:
            if self.current is None:
                raise RuleError(f"rule {self.rule.name}: $ outside a loop over strings")
            return self.current
        return self.rule.resolve([sid])[0]

    def truth(self, node) -> Column:
        c, kind, *_ = self.value(node)
        if kind in ("int", "float"):
            return c != 0
        if kind == "string":
            return F.length(c) > 0
        return c.cast("boolean") if kind == "unknown" else c

    def column(self, node) -> Column:
        return self.value(node)[0]

    def quantify(self, quantifier, flags: list[Column]) -> Column:
        n = len(flags)
        total = reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags], F.lit(0))
        return self.enough(quantifier, total, F.lit(n))

    def enough(self, quantifier, total: Column, n: Column) -> Column:
        if quantifier == "all":
            return total == n
        if quantifier == "any":
            return total >= 1
        if quantifier == "none":
            return total == 0
        if isinstance(quantifier, tuple) and quantifier[0] == "percent":
            return total >= F.ceil(n * self.column(quantifier[1]) / 100)
        wanted = self.column(quantifier)
        return F.when(wanted == 0, total == 0).otherwise(total >= wanted)

    def place(self, p: Pattern, restriction) -> Column:
        if not restriction:
            return self.c.found(p)
        if restriction[0] == "at":
            at = restriction[1]
            if at == ("lit", 0):
                return self.c.latin.rlike(rf"\A(?:{regex_of(p)})")
            # the place itself with at most two bytes before it, at which a word boundary looks
            start = self.column(at).cast("long")
            test = lambda n: F.substring(self.c.latin, (start - n + 1).cast("int"), F.lit(2**31 - 1)).rlike(rf"(?s)\A.{{{n}}}(?:{regex_of(p)})")
            return F.when(start >= 2, test(2)).when(start == 1, test(1)).when(start == 0, test(0)).otherwise(False)
        low, high = self.column(restriction[1]), self.column(restriction[2])
        return F.exists(self.c.offsets(p), lambda o: o.between(low, high))

    def of(self, node) -> Column:
        _, quantifier, names, restriction = node
        if names != "them" and names and not isinstance(names[0], str):
            flags = []
            for kind, x in names:
                if kind == "rule":
                    found = [k for k in self.c.rules if k == x or x.endswith("*") and k.startswith(x[:-1])]
                    if not found and x in self.c.env:
                        flags.append(self.c.env[x][0])
                    elif not found:
                        raise RuleError(f"rule {self.rule.name}: unknown rule {x}")
                    flags += [self.c.rules[k] for k in found]
                else:
                    flags.append(self.truth(x))
            return self.quantify(quantifier, flags)
        return self.quantify(quantifier, [self.place(p, restriction) for p in self.rule.resolve(names)])

    def loop(self, node) -> Column:
        _, quantifier, names, items, body = node
        if items[0] == "list":
            flags = []
            for x in items[1]:
                flags.append(self.bound({names[0]: self.value(x)}, lambda: self.truth(body)))
            return self.quantify(quantifier, flags)
        array, kind = self.items(items)
        if len(names) == 2:
            array = F.map_entries(array)
        test = lambda x: F.coalesce(self.bound({names[0]: (x["key"], "unknown"), names[1]: (x["value"], "unknown")} if len(names) == 2 else {names[0]: (x, kind)}, lambda: self.truth(body)), F.lit(False))
        array = F.coalesce(array, F.array().cast("array<bigint>")) if kind == "int" and items[0] == "range" else array
        return self.enough(quantifier, F.size(F.filter(array, test)), F.size(array))

    def items(self, node) -> tuple[Column, str]:
        if node[0] == "range":
            low, high = (self.column(x).cast("long") for x in node[1:])
            return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")), "int"
        c, _, *rest = self.value(node)
        return c, rest[0] if rest else "unknown"

    def bound(self, names: dict, body):
        before = self.c.env
        self.c.env = before | names
        try:
            return body()
        finally:
            self.c.env = before

    def value(self, node) -> tuple:
        kind = node[0]
        c = self.c
        if kind == "lit":
            v = node[1]
            return F.lit(v).cast("long") if isinstance(v, int) and not isinstance(v, bool) else F.lit(v), "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "string", v
        if kind == "str":
            return c.found(self.string(node[1])), "bool"
        if kind == "count":
            p = self.string(node[1])
            if len(node) == 2:
                return c.count(p), "int"
            low, high = self.column(node[2]), self.column(node[3])
            return F.size(F.filter(c.offsets(p), lambda o: o.between(low, high))).cast("long"), "int"
        if kind in ("offset", "length"):
            p = self.string(node[1])
            index = self.column(node[2]) if node[2] else F.lit(1)
            return F.get(c.offsets(p) if kind == "offset" else c.lengths(p), (index - 1).cast("int")), "int"
        if kind == "at":
            return self.place(self.string(node[1]), ("at", node[2])), "bool"
        if kind == "in":
            return self.place(self.string(node[1]), ("in", node[2], node[3])), "bool"
        if kind == "of":
            return self.of(node), "bool"
        if kind == "forof":
            flags, before = [], self.current
            for p in self.rule.resolve(node[2]):
                self.current = p
                flags.append(self.truth(node[3]))
            self.current = before
            return self.quantify(node[1], flags), "bool"
        if kind == "forin":
            return self.loop(node), "bool"
        if kind == "not":
            return ~self.truth(node[1]), "bool"
        if kind == "defined":
            return self.column(node[1]).isNotNull(), "bool"
        if kind == "neg":
            x, k, *_ = self.value(node[1])
            return (-x, "float") if k == "float" else (M.subtract(F.lit(0), x), "int")
        if kind == "inv":
            return F.bitwise_not(self.column(node[1])), "int"
        if kind == "bin":
            return self.binary(*node[1:])
        if kind == "id":
            return self.name(node[1])
        if kind in ("list", "tuple"):
            parts = [self.value(x[1]) if x[0] == "spread" else self.value(x) for x in node[1]]
            inner = next((p[1] for p, x in zip(parts, node[1]) if x[0] != "spread"), "unknown")
            if any(x[0] == "spread" for x in node[1]):
                return F.concat(*[p[0] if x[0] == "spread" else F.array(p[0]) for p, x in zip(parts, node[1])]), "array", inner
            return F.array(*[p[0] for p in parts]), "array", inner
        if kind == "dict":
            parts = [self.column(v) if k == "spread" else F.create_map(self.column(k), self.column(v)) for k, v in node[1]]
            return (parts[0] if len(parts) == 1 else F.map_from_entries(F.flatten(F.array(*[F.map_entries(p) for p in parts])))), "map", self.value(node[1][0][1])[1] if node[1] else "unknown"
        if kind == "comp":
            _, body, names, items, test = node
            array, k = self.items(items)
            if test:
                array = F.filter(array, lambda x: self.bound({names[0]: (x, k)}, lambda: self.truth(test)))
            kinds: list[str] = []

            def one(x):
                out = self.bound({names[0]: (x, k)}, lambda: self.value(body))
                kinds.append(out[1])
                return out[0]

            return F.transform(array, one), "array", kinds[0] if kinds else "unknown"
        if kind == "dictcomp":
            _, key, body, names, items, test = node
            array, k = self.items(items)
            env = lambda x: {names[0]: (x, k)}
            if test:
                array = F.filter(array, lambda x: self.bound(env(x), lambda: self.truth(test)))
            return F.map_from_entries(F.transform(array, lambda x: self.bound(env(x), lambda: F.struct(self.column(key), self.column(body))))), "map", "unknown"
        if kind == "with":
            names: dict = {}
            for n, e in node[1]:
                names[n] = self.bound(names, lambda e=e: self.value(self.local(e, names)))
            return self.bound(names, lambda: self.value(self.local(node[2], names)))
        if kind == "match":
            v, arms, out, k = self.column(node[1]), node[2], None, "unknown"
            for key, result in reversed(arms):
                r, k, *_ = self.value(result)
                out = r if key is None else (F.when(v == self.column(key), r) if out is None else F.when(v == self.column(key), r).otherwise(out))
            return out, k
        if kind == "index":
            x, k, *rest = self.value(node[1])
            i = self.value(node[2])
            if k == "map":
                return F.try_element_at(x, i[0]), rest[0] if rest else "unknown"
            if node[1][0] == "tuple" or len(i) > 2 and i[2] < 0 or node[2][0] == "neg":
                j = i[0].cast("int")
                return F.try_element_at(x, F.when(j >= 0, j + 1).otherwise(j)), rest[0] if rest else "unknown"
            return F.get(x, i[0].cast("int")), rest[0] if rest else "unknown"
        if kind == "slice":
            x, k, *rest = self.value(node[1])
            size = F.length(x) if k == "string" else F.size(x)
            edge = lambda e, default: default if e is None else (lambda j: F.when(j < 0, F.greatest(size + j, F.lit(0))).otherwise(F.least(j, size)))(self.column(e).cast("int"))
            low, high = edge(node[2], F.lit(0)), edge(node[3], size)
            n = F.greatest(high - low, F.lit(0))
            out = F.substring(x, low + 1, n) if k == "string" else F.slice(x, low + 1, n)
            if node[4] is not None:
                step = self.column(node[4]).cast("int")
                out = F.array_join(F.filter(F.split(out, ""), lambda ch, j: j % step == 0), "") if k == "string" else F.filter(out, lambda y, j: j % step == 0)
            return (out, k, *rest)
        if kind == "member":
            path = self.dotted(node)
            if path in M.CONSTANTS:
                return F.lit(M.CONSTANTS[path]), "float"
            module, _, rest = path.partition(".")
            if rest in B.CONSTANTS.get(module, ()):
                return F.lit(B.CONSTANTS[module][rest]).cast("long"), "int"
            if path in c.externals:
                return self.name(path)
            return self.column(node[1])[node[2]], "unknown"
        if kind == "call":
            return self.call(node)
        if kind == "range":
            return self.items(node)[0], "array", "int"
        raise RuleError(f"rule {self.rule.name}: {kind} has no value here")

    def local(self, node, names):
        """`$x` for a with variable is its name, unless a string has it."""
        if isinstance(node, tuple):
            if node[:1] == ("str",) and node[1] in names and all(p.sid != node[1] for p in self.rule.strings):
                return ("id", node[1])
            return tuple(self.local(x, names) for x in node)
        return [self.local(x, names) for x in node] if isinstance(node, list) else node

    def name(self, name: str) -> tuple:
        c = self.c
        if name in c.env:
            return c.env[name]
        if name == "filesize":
            return F.octet_length(c.data).cast("long"), "int"
        if name == "entrypoint":
            return F.lit(None).cast("long"), "int"
        if name in c.rules:
            return c.rules[name], "bool"
        if name in c.externals:
            v = c.externals[name]
            return (v, "unknown") if isinstance(v, Column) else self.value(("lit", v))
        if name in B.FROM_BYTES:
            return self.module(name), "unknown"
        raise RuleError(f"rule {self.rule.name}: unknown name {name}")

    def module(self, name: str) -> Column:
        """The struct of a module: the caller's own, or the one that is read from the bytes."""
        c = self.c
        if name in c.externals:
            return c.externals[name]
        if name not in B.FROM_BYTES:
            raise RuleError(f"rule {self.rule.name}: no column for the module {name}")
        return c.modules.setdefault(name, B.FROM_BYTES[name](c.data))

    def dotted(self, node) -> str:
        return node[1] if node[0] == "id" else f"{self.dotted(node[1])}.{node[2]}" if node[0] == "member" else ""

    def call(self, node) -> tuple:
        _, target, args = node
        if target[0] == "lambda":
            return self.bound({n: self.value(a) for n, a in zip(target[1], args)}, lambda: self.value(target[2]))
        name = self.dotted(target)
        if name == "len":
            x, k, *_ = self.value(args[0])
            return (F.length(x) if k == "string" else F.size(x)).cast("long"), "int"
        if name in B.FUNCTIONS:
            build, kind = B.FUNCTIONS[name]
            declared = B.DECLARED.get(name.partition(".")[0])
            if declared:
                _, least, most = declared.functions[name.partition(".")[2]]
                if len(args) < least or most is not None and len(args) > most:
                    raise RuleError(f"rule {self.rule.name}: {name} takes {least} arguments" + (f" to {most}" if most != least else ""))
            values = [(F.lit(a[1]), "regex", a[1]) if a[0] == "regex" else self.value(a) for a in args]
            return build(self.module(name.partition(".")[0]), values), kind
        if name not in M.MODULES:
            raise RuleError(f"rule {self.rule.name}: unknown function {name}")
        build, kind = M.MODULES[name]
        values = [self.value(a) for a in args]
        if name in ("math.min", "math.max", "math.abs") and any(v[1] == "float" for v in values):
            kind = "float"
        return build(self.c, values), kind

    def binary(self, op: str, left, right) -> tuple:
        if op in ("and", "or"):
            a, b = self.truth(left), self.truth(right)
            return (a & b if op == "and" else a | b), "bool"
        if op == "matches":
            if right[0] != "regex":
                raise RuleError(f"rule {self.rule.name}: matches needs a regular expression")
            flags = "".join(f for f in right[2] if f in "is")
            return self.column(left).rlike((f"(?{flags})" if flags else "") + right[1]), "bool"
        (a, ka, *_), (b, kb, *_) = self.value(left), self.value(right)
        if op in ("contains", "icontains", "startswith", "istartswith", "endswith", "iendswith", "iequals"):
            if ka == "array":
                return F.array_contains(a, b), "bool"
            if op[0] == "i":
                a, b, op = F.lower(a), F.lower(b), op[1:]
            return {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith, "equals": lambda x, y: x == y}[op](a, b), "bool"
        if op in ("==", "!=", "<", "<=", ">", ">="):
            return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], "bool"
        if op in ("&", "|", "^"):
            return {"&": a.bitwiseAND(b), "|": a.bitwiseOR(b), "^": a.bitwiseXOR(b)}[op], "int"
        if op in ("<<", ">>"):
            return M.shift(a, b, op == "<<"), "int"
        if "float" in (ka, kb):
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "\\": lambda: a / F.nullif(b, F.lit(0)), "%": lambda: F.try_mod(a, b)}[op](), "float"
        if op == "\\":
            # the least integer has no positive twin: its quotient by -1 wraps to itself
            return F.when(b == -1, M.subtract(F.lit(0), a)).otherwise(F.call_function("div", a, F.nullif(b, F.lit(0).cast("long")))), "int"
        if op == "%":
            return F.when(b == -1, F.lit(0).cast("long")).otherwise(F.try_mod(a, b)), "int"
        return {"+": M.add, "-": M.subtract, "*": M.multiply}[op](a, b), "int"


def order(rules: list[PatternRule]) -> list[PatternRule]:
    """Rules after those that they refer to."""
    names = {r.name: r for r in rules}
    done: dict[str, PatternRule] = {}

    def visit(r: PatternRule, above: tuple = ()):
        if r.name in above:
            raise RuleError("rules refer to each other: " + " -> ".join((*above, r.name)))
        if r.name not in done:
            for x in references(r, names):
                visit(names[x], (*above, r.name))
            done[r.name] = r

    for r in rules:
        visit(r)
    return list(done.values())


def names_in(rule: PatternRule) -> list[str]:
    """Names in a condition that may be rules, with a star where a set has one."""
    out: dict[str, None] = {}
    for n in walk(rule.condition):
        if n[0] == "id" and n[1] != rule.name:
            out[n[1]] = None
        if n[0] == "of" and n[2] != "them":
            out |= {x[1]: None for x in n[2] if isinstance(x, tuple) and x[0] == "rule"}
    return list(out)


def references(rule: PatternRule, names) -> list[str]:
    """Names of rules in a condition."""
    out: dict[str, None] = {}
    for n in walk(rule.condition):
        if n[0] == "id" and n[1] in names and n[1] != rule.name:
            out[n[1]] = None
        if n[0] == "of" and n[2] != "them":
            for x in n[2]:
                if isinstance(x, tuple) and x[0] == "rule":
                    for k in names:
                        if k != rule.name and (k == x[1] or x[1].endswith("*") and k.startswith(x[1][:-1])):
                            out[k] = None
    return list(out)


def compiled(blobs: DataFrame, rules: RuleFile | str, data: str = "data", externals: dict | None = None) -> tuple[DataFrame, list[PatternRule], Context]:
    """Blobs with a boolean column `r_<rule>` for each rule, `_latin`, and the rules in order."""
    if isinstance(rules, str):
        rules = parse(rules)
    rows = blobs.withColumn("_data", F.col(data).cast("binary"))
    rows = rows.withColumn("_latin", F.decode("_data", "ISO-8859-1"))
    context = Context(F.col("_data"), F.col("_latin"), externals or {})
    ordered = order(rules.rules)
    for r in ordered:
        rows = rows.withColumn(f"r_{r.name}", Compiler(r, context).condition())
        context.rules[r.name] = F.col(f"r_{r.name}")
    gates = [F.col(f"r_{r.name}") for r in ordered if r.is_global]
    if gates:
        gate = reduce(lambda a, b: a & b, gates)
        rows = rows.withColumns({f"r_{r.name}": F.col(f"r_{r.name}") & gate for r in ordered})
    return rows, ordered, context


def evaluate(blobs: DataFrame, rules: RuleFile | str, data: str = "data", externals: dict | None = None) -> DataFrame:
    """The input's columns and one boolean column for each rule that is not private."""
    rows, ordered, _ = compiled(blobs, rules, data, externals)
    return rows.select(*[blobs[c] for c in blobs.columns if c != data], *[F.col(f"r_{r.name}").alias(r.name) for r in ordered if not r.private])


def scan(blobs: DataFrame, rules: RuleFile | str, data: str = "data", externals: dict | None = None, fast: bool = False) -> DataFrame:
    """A row for each blob and rule that matches: rule, tags, meta, and unless `fast` the string matches."""
    rows, ordered, context = compiled(blobs, rules, data, externals)
    found = []
    for r in ordered:
        if r.private:
            continue
        spans = [] if fast else [_spans(context, p) for p in r.strings if not p.private]
        strings = F.concat(*spans) if spans else F.array().cast("array<struct<identifier:string,offset:bigint,data:binary>>")
        meta = F.create_map(*[F.lit(x) for k, v in r.meta for x in (k, str(v))]) if r.meta else F.create_map().cast("map<string,string>")
        found.append(F.when(F.col(f"r_{r.name}"), F.struct(F.lit(r.name).alias("rule"), (F.array(*map(F.lit, r.tags)) if r.tags else F.array().cast("array<string>")).alias("tags"), meta.alias("meta"), strings.alias("strings"))))
    keep = [F.col(c) for c in blobs.columns if c != data]
    return rows.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("m")).select(*[c for c in blobs.columns if c != data], "m.*")


def _spans(context: Context, p: Pattern) -> Column:
    return F.zip_with(context.offsets(p), context.matches(p), lambda o, x: F.struct(F.lit("$" + p.sid).alias("identifier"), o.alias("offset"), F.encode(x, "ISO-8859-1").alias("data")))


#: Literals that are tested one by one in the JVM, and characters of literals in one automaton.
FEW_LITERALS, AUTOMATON_CHARS = 64, 8_000_000


def many_literals(blobs: DataFrame, literals: DataFrame, data: str = "text", few: int = FEW_LITERALS, most: int = AUTOMATON_CHARS) -> DataFrame:
    """(blob columns, literal columns): the distinct literals of column `value` that a text holds, for sets too large for a condition.

    No text is shuffled.  A few literals are tested in the JVM.  More are looked up in one pass over each
    text by an automaton of at most `most` characters; larger sets go in several automata, a pass each.
    Null and empty literals and null texts match nothing.
    """
    spark = blobs.sparkSession
    wanted = literals.filter(F.length("value") > 0)
    parts: list[list[str]] = [[]]
    size = 0
    for row in wanted.select("value").distinct().toLocalIterator():
        if parts[-1] and size + len(row["value"]) > most:
            parts.append([])
            size = 0
        parts[-1].append(row["value"])
        size += len(row["value"])
    text = F.col(data).cast("string")
    if len(parts) == 1 and len(parts[0]) <= few:
        every = F.array(*map(F.lit, parts[0])) if parts[0] else F.array().cast("array<string>")
        found = blobs.withColumn("value", F.explode(F.filter(every, lambda v: F.contains(text, v))))
    else:
        found = reduce(DataFrame.unionByName, [_automaton(blobs, spark.sparkContext.broadcast(p), data) for p in parts])
    if literals.columns == ["value"]:
        return found
    return found.join(wanted, "value").select(*[found[c] for c in found.columns], *[c for c in literals.columns if c != "value"])


def _automaton(blobs: DataFrame, shared, data: str) -> DataFrame:
    from pyspark.sql.types import StringType, StructField, StructType

    at = blobs.columns.index(data)

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for word in shared.value:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for batch in batches:
            rows, values = [], []
            for k, text in enumerate(batch.column(at).cast(pa.string())):
                if (t := text.as_py()) is not None:
                    found = {word for _, word in automaton.iter(t)}
                    rows += [k] * len(found)
                    values += found
            for a in range(0, len(rows), 4096):
                part = batch.take(pa.array(rows[a : a + 4096], pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values[a : a + 4096], pa.string())], [*batch.schema.names, "value"])

    return blobs.mapInArrow(run, StructType([*blobs.schema.fields, StructField("value", StringType())]))
