"""Building and changing pattern rules in Python.

    Rule("dropper").tag("win").meta("level", 3).text("a", "MZ").hex("h", "4D 5A ??").where("$a at 0 and #h > 1").done()
"""

from __future__ import annotations

import re
from dataclasses import replace

from .lexer import RuleError
from .pattern_rule import Parser, Pattern, PatternRule, RuleFile, generate, hex_tokens, parse

#: Ready patterns.  Fixed values.
PRESETS = {
    "mz": ("hex", "4D 5A"), "pe": ("hex", "50 45 00 00"), "elf": ("hex", "7F 45 4C 46"), "zip": ("hex", "50 4B 03 04"), "pdf": ("text", "%PDF-"),
    "email": ("regex", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), "ip": ("regex", r"[0-9]{1,3}(\.[0-9]{1,3}){3}"), "url": ("regex", r"https?:\/\/[^\s\"']+"),
}


def condition(text: str) -> tuple:
    return Parser(text).expression()


class Rule:
    """A rule under construction; every call returns it."""

    def __init__(self, name: str):
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise RuleError(f"bad rule name {name!r}")
        self.rule = PatternRule(name)

    def tag(self, *tags: str) -> Rule:
        self.rule.tags += [t for t in tags if t not in self.rule.tags]
        return self

    def meta(self, key: str, value) -> Rule:
        self.rule.meta.append((key, value))
        return self

    def private(self) -> Rule:
        self.rule.private = True
        return self

    def everywhere(self) -> Rule:
        self.rule.is_global = True
        return self

    def _string(self, sid: str, kind: str, value, modifiers: dict) -> Rule:
        if any(p.sid == sid for p in self.rule.strings):
            raise RuleError(f"string ${sid} twice")
        self.rule.strings.append(Pattern(sid, kind, value, modifiers))
        return self

    def text(self, sid: str, value: str, **modifiers) -> Rule:
        return self._string(sid, "plain", value, modifiers)

    def regex(self, sid: str, pattern: str, flags: str = "", **modifiers) -> Rule:
        return self._string(sid, "regex", (pattern, flags), modifiers)

    def hex(self, sid: str, tokens, **modifiers) -> Rule:
        """Tokens as text or as a `Hex` of `plans.expressions`."""
        return self._string(sid, "hex", hex_tokens(tokens if isinstance(tokens, str) else tokens.text()), modifiers)

    def preset(self, sid: str, name: str) -> Rule:
        kind, value = PRESETS[name]
        return getattr(self, kind)(sid, value)

    def where(self, text) -> Rule:
        """The condition, as text or as an expression of `plans.expressions`."""
        self.rule.condition = condition(str(text))
        return self

    def done(self) -> PatternRule:
        return parse(generate(self.rule)).rules[0]  # the parser's checks hold for built rules too


def _renamed(node, names: dict):
    """An expression with strings under new names; wildcards that still fit stay."""
    if isinstance(node, tuple):
        if node and node[0] in ("str", "at", "in", "count", "offset", "length"):
            return (node[0], names.get(node[1], node[1]), *(_renamed(x, names) for x in node[2:]))
        if node and node[0] in ("of", "forof") and node[2] != "them":
            members = []
            for x in node[2]:
                if isinstance(x, str) and x.endswith("*"):
                    members += [names[k] for k in names if k.startswith(x[:-1])]
                else:
                    members.append(names.get(x, x) if isinstance(x, str) else _renamed(x, names))
            return (node[0], _renamed(node[1], names), members, *(_renamed(x, names) for x in node[3:]))
        return tuple(_renamed(x, names) for x in node)
    return [_renamed(x, names) for x in node] if isinstance(node, list) else node


def rename_strings(rule: PatternRule, names: dict[str, str]) -> PatternRule:
    """Strings under new names, in the definitions and the condition."""
    every = {p.sid: names.get(p.sid, p.sid) for p in rule.strings}
    if len(set(every.values())) < len(every):
        raise RuleError("two strings would have one name")
    return replace(rule, strings=[replace(p, sid=every[p.sid]) for p in rule.strings], condition=_renamed(rule.condition, every))


def prefix_strings(rule: PatternRule, prefix: str) -> PatternRule:
    return rename_strings(rule, {p.sid: prefix + p.sid for p in rule.strings})


def rename(rule: PatternRule, name: str) -> PatternRule:
    return replace(rule, name=name)


def add_tag(rule: PatternRule, tag: str) -> PatternRule:
    return rule if tag in rule.tags else replace(rule, tags=[*rule.tags, tag])


def add_meta(rule: PatternRule, key: str, value) -> PatternRule:
    return replace(rule, meta=[(k, v) for k, v in rule.meta if k != key] + [(key, value)])


def map_condition(rule: PatternRule, change) -> PatternRule:
    """The rule with each node of its condition passed through `change`, inner ones first."""

    def visit(node):
        if isinstance(node, tuple):
            out = tuple(visit(x) for x in node)
            return change(out) if out and isinstance(out[0], str) else out
        return [visit(x) for x in node] if isinstance(node, list) else node

    return replace(rule, condition=visit(rule.condition))


def merge(*files: RuleFile) -> RuleFile:
    """All rules of several files; a rule that is there already is not added again."""
    out = RuleFile()
    for f in files:
        out.imports += [x for x in f.imports if x not in out.imports]
        out.includes += [x for x in f.includes if x not in out.includes]
        out.rules += [r for r in f.rules if r not in out.rules]
    return out


def _wrapped(n: int) -> int:
    return (n + 2**63) % 2**64 - 2**63


def fold(rule: PatternRule) -> PatternRule:
    """Constant parts of the condition computed, as 64-bit integers that wrap; undefined results are left as they are."""

    def change(n):
        if n[0] == "bin" and n[2][0] == n[3][0] == "lit" and all(type(x[1]) is int for x in n[2:]):
            a, b = n[2][1], n[3][1]
            simple = {"+": a + b, "-": a - b, "*": a * b, "&": a & b, "|": a | b, "^": a ^ b}
            if n[1] in simple:
                return ("lit", _wrapped(simple[n[1]]))
            if n[1] in ("<<", ">>") and b >= 0:
                return ("lit", 0 if b >= 64 else _wrapped(a << b) if n[1] == "<<" else a >> b)
            compare = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
            if n[1] in compare:
                return ("lit", compare[n[1]])
        if n[0] == "bin" and n[1] in ("and", "or"):
            short = n[1] == "or"
            for x, other in ((n[2], n[3]), (n[3], n[2])):
                if x == ("lit", short):
                    return ("lit", short)
                if x == ("lit", not short) and other[0] in ("bin", "not", "str", "of", "lit", "at", "in"):
                    return other
        if n[0] == "not" and n[1][0] == "lit" and isinstance(n[1][1], bool):
            return ("lit", not n[1][1])
        return n

    return map_condition(rule, change)


def prune(rules: RuleFile) -> RuleFile:
    """Without strings that no condition uses, and private rules that no rule refers to; global rules stay."""
    from rulespark.operators.scan import references
    from rulespark.sources.rules import string_refs

    names = {r.name: r for r in rules.rules}
    needed = {x for r in rules.rules for x in references(r, names)}
    kept = []
    for r in rules.rules:
        if r.private and not r.is_global and r.name not in needed:
            continue
        refs = [x["ref"] for x in string_refs(r)]
        kept.append(replace(r, strings=[p for p in r.strings if any(p.sid == x or x.endswith("*") and p.sid.startswith(x[:-1]) for x in refs)]))
    return replace(rules, rules=kept)
