"""Rule files out: formatted text, JSON, YAML and Parquet; comments, styles and format checks."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rulespark.operators.analysis import line_diff
from rulespark.plans import event_rule
from rulespark.plans.lexer import RuleError
from rulespark.plans.pattern_rule import RuleFile, hex_text, modifier_text, parse, quote, text_of
from rulespark.sources.rules import dialect_of, from_json, to_json


@dataclass(frozen=True)
class Style:
    indent: int = 4
    before_rule: int = 1
    after_imports: int = 1
    between_sections: int = 0
    align_strings: bool = False
    align_meta: bool = False
    line_length: int = 120


#: Styles by name.
STYLES = {
    "default": Style(), "compact": Style(line_length=80), "dense": Style(align_strings=True, line_length=100),
    "readable": Style(before_rule=2, after_imports=2, between_sections=1, align_strings=True, align_meta=True), "verbose": Style(before_rule=3, after_imports=3, between_sections=2, align_strings=True, align_meta=True, line_length=140),
}


def _wrapped(text: str, limit: int, indent: str) -> list[str]:
    """A condition in lines that break before `and` and `or`, outside strings."""
    out, line = [], ""
    for part in re.split(r'(?=\s(?:and|or)\s(?=(?:[^"]*"[^"]*")*[^"]*$))', text):
        if line and len(indent) + len(line) + len(part) > limit:
            out.append(indent + line)
            line = part.strip()
        else:
            line += part
    return [*out, indent + line]


def pretty(rules: RuleFile | str, style: str | Style = "default") -> str:
    """Rule text in a style; parsing it gives equal rules."""
    rules = parse(rules) if isinstance(rules, str) else rules
    s = STYLES[style] if isinstance(style, str) else style
    one, two, gap = " " * s.indent, " " * (2 * s.indent), [""] * s.between_sections
    head = [f"import {quote(x)}" for x in sorted(rules.imports)] + [f"include {quote(x)}" for x in sorted(rules.includes)]
    out = head + [""] * (s.after_imports if head else 0)
    for k, r in enumerate(rules.rules):
        out += [""] * (s.before_rule if k else 0)
        out.append("global " * r.is_global + "private " * r.private + f"rule {r.name}" + (f" : {' '.join(r.tags)}" if r.tags else "") + " {")
        sections = []
        if r.meta:
            wide = max(len(key) for key, _ in r.meta) if s.align_meta else 0
            sections.append([f"{one}meta:", *(f"{two}{key:<{wide}} = {text_of(('lit', v))}" for key, v in r.meta)])
        if r.strings:
            names = ["" if p.anonymous else p.sid for p in r.strings]
            wide = max(map(len, names)) if s.align_strings else 0
            lines = []
            for p, sid in zip(r.strings, names):
                value = quote(p.value) if p.kind == "plain" else f"/{p.value[0]}/{p.value[1]}" if p.kind == "regex" else "{ " + hex_text(p.value) + " }"
                lines.append(f"{two}${sid:<{wide}} = {value}" + "".join(" " + modifier_text(m, v) for m, v in p.modifiers.items()))
            sections.append([f"{one}strings:", *lines])
        condition = text_of(r.condition)
        if condition.startswith("(") and _closes(condition) == len(condition) - 1 and r.condition[0] == "bin":
            condition = condition[1:-1]
        sections.append([f"{one}condition:", *_wrapped(condition, s.line_length, two)])
        for j, section in enumerate(sections):
            out += (gap if j else []) + section
        out.append("}")
    return "\n".join(out) + "\n"


def _closes(text: str) -> int:
    """Place of the bracket that closes the first one."""
    depth, quoted = 0, False
    for k, c in enumerate(text):
        if c == '"' and text[k - 1 : k] != "\\":
            quoted = not quoted
        if not quoted:
            depth += (c == "(") - (c == ")")
            if depth == 0:
                return k
    return -1


def check_format(text: str, style: str = "default") -> tuple[bool, list[str]]:
    """(whether the text is in the style, unified diff to the text that is)."""
    want = pretty(text, style)
    return want == text, line_diff(text, want)


def comments(text: str) -> list[dict]:
    """Comments in order: line, kind ('line' or 'block'), text, and the rule that they stand in or before."""
    from rulespark.sources.rules import _HEAD, split_rules

    scan = re.compile(r'"(?:\\.|[^"\\\n])*"|(//[^\n]*)|(/\*.*?\*/)', re.S)
    spans = [(a, b, _HEAD.match(text, a, b).group().split()[-1]) for a, b in split_rules(text)]
    out = []
    for m in scan.finditer(text):
        if m[1] or m[2]:
            rule = next((name for _, b, name in spans if m.start() < b), None)
            body = m[1][2:] if m[1] else m[2][2:-2]
            out.append({"line": text.count("\n", 0, m.start()) + 1, "kind": "line" if m[1] else "block", "text": body.strip(), "rule": rule})
    return out


def _yaml(value, indent: int = 0) -> str:
    """JSON data as YAML, in block style."""
    pad = "  " * indent
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{json.dumps(k)}:" + (f" {json.dumps(v, ensure_ascii=False)}\n" if not isinstance(v, (dict, list)) or not v else "\n" + _yaml(v, indent + 1)) for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}-" + (f" {json.dumps(v, ensure_ascii=False)}\n" if not isinstance(v, (dict, list)) or not v else "\n" + _yaml(v, indent + 1)) for v in value)
    return f"{pad}{json.dumps(value, ensure_ascii=False)}\n"


def to_yaml(rules: RuleFile) -> str:
    """Whole rule files as YAML; any YAML reader gives the data of `to_json`."""
    return _yaml(json.loads(to_json(rules)))


def minimal_yaml(rules: RuleFile) -> str:
    """Names, tags, strings and conditions as a reader would write them."""
    one = lambda r: {"name": r.name, **({"tags": list(r.tags)} if r.tags else {}), **({"strings": [f"${p.sid}" for p in r.strings]} if r.strings else {}), "condition": text_of(r.condition)}
    return _yaml({"rules": [one(r) for r in rules.rules]})


def to_blob(rules: RuleFile) -> bytes:
    """A compact binary form, zlib over JSON; `from_blob` gives the rules back."""
    import zlib

    return zlib.compress(to_json(rules).encode(), 9)


def from_blob(blob: bytes) -> RuleFile:
    import zlib

    return from_json(zlib.decompress(blob).decode())


def sizes(rules: RuleFile) -> dict:
    """Bytes of each form, and the ratio of the binary one to JSON."""
    text, blob = len(to_json(rules).encode()), len(to_blob(rules))
    return {"json": text, "yaml": len(to_yaml(rules).encode()), "blob": blob, "ratio": blob / text}


def write_rules(parsed: DataFrame, path: str) -> None:
    """Parsed rules as Parquet, files of one dialect together."""
    parsed.write.partitionBy("dialect").parquet(path)


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def round_trip(text: str) -> list[str]:
    """Differences between a file and what its generated text parses to; empty if there are none."""
    if dialect_of(text) == "L":
        rules = event_rule.parse(text)
        again = [x for r in rules for x in event_rule.parse(event_rule.generate(r))]
        return [r.name for r, a in zip(rules, again) if r != a]
    first, second = parse(text), parse(pretty(text))
    out = [f"rule {a.name}" for a, b in zip(first.rules, second.rules) if a != b]
    out += [x for x in ("imports", "includes") if sorted(getattr(first, x)) != sorted(getattr(second, x))]
    return out + (["number of rules"] if len(first.rules) != len(second.rules) else [])


def compare_event_rules(a: str, b: str) -> dict[str, bool]:
    """Whether event rules mean the same by their generated text, and by their structure but for names and meta."""
    from dataclasses import replace

    x, y = event_rule.parse(a), event_rule.parse(b)
    plain = lambda rules: [replace(r, name="", meta={}) for r in rules]
    try:
        semantic = [event_rule.generate(r) for r in x] == [event_rule.generate(r) for r in y]
    except RuleError:
        semantic = x == y
    return {"semantic": semantic, "structural": plain(x) == plain(y)}
