"""Dialects of rule files, which users may add to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from rulespark.plans import event_rule, pattern_rule
from rulespark.plans.lexer import RuleError
from rulespark.sources.rules import dialect_of


@dataclass(frozen=True)
class Dialect:
    """`detect` says whether a text is in the dialect, `parse` reads it, `generate` writes what `parse` gave."""

    name: str
    detect: Callable[[str], bool]
    parse: Callable[[str], object]
    generate: Callable[[object], str]
    suffixes: tuple[str, ...] = ()


def _events(rules) -> str:
    return "\n".join(map(event_rule.generate, rules))


#: By name; the latest that detects a text wins.
DIALECTS: dict[str, Dialect] = {
    "Y": Dialect("Y", lambda t: dialect_of(t) == "Y", pattern_rule.parse, pattern_rule.generate, (".yar", ".rules")),
    "X": Dialect("X", lambda t: dialect_of(t) == "X", pattern_rule.parse, pattern_rule.generate),
    "L": Dialect("L", lambda t: dialect_of(t) == "L", event_rule.parse, _events),
}


def register(dialect: Dialect) -> None:
    DIALECTS.pop(dialect.name, None)
    DIALECTS[dialect.name] = dialect


def detect(text: str, path: str = "") -> Dialect:
    """The dialect of a text, else by the file's suffix."""
    for d in reversed(list(DIALECTS.values())):
        if d.detect(text):
            return d
    for d in DIALECTS.values():
        if path.endswith(d.suffixes or "\0"):
            return d
    raise RuleError("no dialect reads this text")


def read(text: str, dialect: str | None = None, path: str = "") -> object:
    return (DIALECTS[dialect] if dialect else detect(text, path)).parse(text)
