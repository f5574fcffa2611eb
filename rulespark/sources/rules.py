"""Rule files as data: splitting, dialects, parsing to tables, and sinks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.plans import event_rule, pattern_rule
from rulespark.plans.lexer import RuleError
from rulespark.storage import stored

RULE_SCHEMA = """path string, dialect string, pos int, name string, error string, is_private boolean, is_global boolean, tags array<string>,
meta map<string,string>, imports array<string>, includes array<string>, condition string, depth int, cyclomatic int,
strings array<struct<sid:string,kind:string,value:string,length:int,tokens:array<string>,mods:array<string>>>,
refs array<struct<ref:string,kind:string>>, rule_refs array<string>, nodes array<struct<id:int,parent:int,kind:string,op:string,depth:int>>, text string"""

#: Skipped when rules are split: comments, strings, regular expressions.
_SKIP = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|(?<=[=(,])\s*/(?![/*])(?:\\.|[^/\\\n])+/', re.S)
_BRACE = re.compile("[{}]")
_HEAD = re.compile(r"\b(?:(?:private|global)\s+)*rule\s+[A-Za-z_]\w*")


def split_rules(text: str) -> Iterator[tuple[int, int]]:
    """Spans of single rules in a file; braces inside strings, comments and patterns do not count."""
    blank = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    at = 0
    while m := _HEAD.search(blank, at):
        depth, k = 0, len(blank)
        for brace in _BRACE.finditer(blank, m.end()):
            depth += 1 if brace.group() == "{" else -1
            if depth == 0 and brace.group() == "}":
                k = brace.end()
                break
        yield m.start(), k
        at = k


def dialect_of(text: str) -> str:
    """L for event rules, X for the extended dialect, else Y; strings and comments are no evidence."""
    plain = re.sub(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"', " ", text, flags=re.S)
    if re.search(r"^\s*(?:events|outcome)\s*:", plain, re.M) or re.search(r"\$\w+\.(?:metadata|principal|target|network)\b", plain):
        return "L"
    if re.search(r"\bwith\s+\$?\w+\s*=|=>|\blambda\s+\w+\s*:|\[[^\]\n]+\bfor\b[^\]\n]+\bin\b|\.\.\.\[", plain):
        return "X"
    return "Y"


def read_rules(spark: SparkSession, path: str, recursive: bool = True, patterns: str = "*.{yar,yara,rules}") -> DataFrame:
    """(path, text) of rule files."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", recursive).option("pathGlobFilter", patterns).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _strings(rule) -> list[dict]:
    out = []
    for p in rule.strings:
        value = p.value if p.kind == "plain" else pattern_rule.hex_text(p.value) if p.kind == "hex" else p.value[0]
        tokens = [pattern_rule.hex_text([t]) for t in p.value] if p.kind == "hex" else []
        length = len(tokens) if p.kind == "hex" else len(p.value.encode("latin-1", "ignore") if p.kind == "plain" and all(ord(c) < 256 for c in p.value) else str(value).encode())
        out.append({"sid": p.sid, "kind": p.kind, "value": value, "length": length, "tokens": tokens, "mods": sorted(p.modifiers)})
    return out


def string_refs(rule) -> list[dict]:
    """References of a condition to strings: id, wildcard, them, count, offset, length."""
    out: dict[tuple, None] = {}
    for n in pattern_rule.walk(rule.condition):
        if n[0] in ("str", "at", "in") and n[1]:
            out[(n[1], "id")] = None
        elif n[0] in ("count", "offset", "length") and n[1]:
            out[(n[1], n[0])] = None
        elif n[0] in ("of", "forof"):
            for x in ["*"] if n[2] == "them" else n[2]:
                if isinstance(x, str):
                    out[(x, "them" if n[2] == "them" else "wildcard" if x.endswith("*") else "id")] = None
    return [{"ref": r, "kind": k} for r, k in out]


def expression_nodes(condition) -> list[dict]:
    """(id, parent, kind, op, depth) of each node; operators, loops and sets of strings go one deeper."""
    out: list[dict] = []
    deeper = ("bin", "forin", "forof", "of")

    def visit(node, parent, depth):
        if isinstance(node, tuple) and node and isinstance(node[0], str) and node[0] not in ("percent", "expr", "rule"):
            me = len(out)
            depth += node[0] in deeper
            out.append({"id": me, "parent": parent, "kind": node[0], "op": node[1] if node[0] == "bin" else None, "depth": depth})
            for x in node[1:]:
                visit(x, me, depth)
        elif isinstance(node, (tuple, list)):
            for x in node:
                visit(x, parent, depth)

    visit(condition, -1, 0)
    return out


def cyclomatic(condition) -> int:
    """1 for the rule, 1 for each and, or, loop and comprehension, and for each arm of a match."""
    n = 1
    for x in pattern_rule.walk(condition):
        n += x[0] == "bin" and x[1] in ("and", "or") or x[0] in ("forof", "forin", "comp", "dictcomp")
        n += len(x[2]) if x[0] == "match" else 0
    return n


def rule_heads(path: str, text: str | None) -> Iterator[dict]:
    """A row for each rule of a file, not parsed: path, dialect, pos, name, imports, includes, text."""
    text = text or ""
    dialect = dialect_of(text)
    head = re.sub(r"//[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    imports, includes = re.findall(r'^\s*import\s+"([^"]*)"', head, re.M), re.findall(r'^\s*include\s+"([^"]*)"', head, re.M)
    for pos, (a, b) in enumerate(split_rules(text)):
        yield {"path": path, "dialect": dialect, "pos": pos, "name": _HEAD.match(text, a, b).group().split()[-1], "imports": imports, "includes": includes, "text": text[a:b]}


_COLUMNS = dict.fromkeys(x.split()[0] for x in RULE_SCHEMA.replace("\n", " ").split(", ") if " " in x)


def parsed_row(head: dict, known=None) -> dict:
    """The row of one rule; one that cannot be read gives its error.

    `known` are the names that a condition may refer to; without them `rule_refs` are all names in the condition.
    """
    row, text = _COLUMNS | head, head["text"]
    try:
        if head["dialect"] == "L":
            rule = event_rule.parse(text)[0]
            row |= {"meta": {k: str(v) for k, v in rule.meta.items()}, "condition": event_rule.text_of(rule.condition), "is_private": False, "is_global": False, "tags": [], "strings": [], "refs": [], "rule_refs": [], "nodes": []}
        else:
            rule = pattern_rule.parse(text).rules[0]
            nodes = expression_nodes(rule.condition)
            from rulespark.operators.scan import names_in, references

            row |= {
                "is_private": rule.private, "is_global": rule.is_global, "tags": rule.tags, "meta": {k: str(v) for k, v in rule.meta}, "condition": pattern_rule.text_of(rule.condition), "depth": max((n["depth"] for n in nodes), default=0),
                "cyclomatic": cyclomatic(rule.condition), "strings": _strings(rule), "refs": string_refs(rule), "rule_refs": names_in(rule) if known is None else references(rule, known), "nodes": nodes,
            }
    except RuleError as e:
        row["error"] = str(e)
    return row


def rule_rows(path: str, text: str | None) -> Iterator[dict]:
    """A row for each rule of a file; a rule that cannot be read gives its error and does not stop the others."""
    heads = list(rule_heads(path, text))
    known = {h["name"] for h in heads}
    for head in heads:
        yield parsed_row(head, known)


def _rows_of(schema, make):
    """A function over batches that gives rows of a schema; `make` gives them for a batch."""

    def run(batches):
        import pandas as pd

        names = [f.name for f in schema]
        for batch in batches:
            rows = list(make(batch))
            yield pd.DataFrame(rows, columns=names) if rows else pd.DataFrame({n: [] for n in names})

    return run


def _schema(spark: SparkSession, text: str):
    return spark.createDataFrame([], text).schema


def parse_files(files: DataFrame) -> DataFrame:
    """Rows of RULE_SCHEMA from (path, text); files are parsed by the executors."""
    schema = _schema(files.sparkSession, RULE_SCHEMA)
    make = lambda batch: (r for path, text in zip(batch["path"], batch["text"]) for r in rule_rows(path, text))
    return files.select("path", "text").mapInPandas(_rows_of(schema, make), schema)


HEAD_SCHEMA = "path string, dialect string, pos int, name string, imports array<string>, includes array<string>, text string"


def _heads(files: DataFrame) -> DataFrame:
    schema = _schema(files.sparkSession, HEAD_SCHEMA)
    make = lambda batch: (h for path, text in zip(batch["path"], batch["text"]) for h in rule_heads(path, text))
    return stored(files.select("path", "text").mapInPandas(_rows_of(schema, make), schema), "rule-heads")


def parse_corpus(files: DataFrame, rules_per_task: int = 500) -> DataFrame:
    """The same for large files and many of them: files are split into rules, which are dealt out and parsed; stored.

    References to other rules are found by a join with the names of the file, not in a task that holds the whole file.
    """
    spark = files.sparkSession
    heads = _heads(files)
    tasks = max(1, -(-heads.count() // rules_per_task))
    schema = _schema(spark, RULE_SCHEMA)
    names = heads.columns
    to_list = lambda x: list(x) if x is not None else []

    def make(batch):
        for row in batch.itertuples(index=False):
            head = dict(zip(names, row))
            yield parsed_row({**head, "imports": to_list(head["imports"]), "includes": to_list(head["includes"])})

    parsed = stored(heads.repartition(tasks, "path", "pos").mapInPandas(_rows_of(schema, make), schema), "rules")
    known = heads.select("path", "name").distinct()
    wanted = parsed.select("path", "pos", F.col("name").alias("own"), F.explode("rule_refs").alias("ref"))
    plain = wanted.filter("ref not like '%*'").join(known, (wanted["path"] == known["path"]) & (F.col("ref") == known["name"]))
    stars = wanted.filter("ref like '%*'").join(known, (wanted["path"] == known["path"]) & known["name"].startswith(F.expr("left(ref, length(ref) - 1)")))
    pick = lambda d: d.filter(known["name"] != F.col("own")).select(wanted["path"], "pos", known["name"].alias("found"))
    found = pick(plain).union(pick(stars)).groupBy("path", "pos").agg(F.array_sort(F.collect_set("found")).alias("_found"))
    out = parsed.join(found, ["path", "pos"], "left").withColumn("rule_refs", F.when(F.col("rule_refs").isNotNull(), F.coalesce("_found", F.array().cast("array<string>"))))
    return out.select(*parsed.columns)


def to_json(rules: pattern_rule.RuleFile) -> str:
    """Whole rule files as JSON; `from_json` gives them back."""
    pack = lambda x: {"t": [pack(y) for y in x]} if isinstance(x, tuple) else [pack(y) for y in x] if isinstance(x, list) else {"d": {k: pack(v) for k, v in x.items()}} if isinstance(x, dict) else x
    return json.dumps({"imports": rules.imports, "includes": rules.includes, "rules": [pack({**vars(r), "strings": [vars(p) for p in r.strings]}) for r in rules.rules]})


def from_json(text: str) -> pattern_rule.RuleFile:
    def unpack(x):
        if isinstance(x, dict):
            return tuple(unpack(y) for y in x["t"]) if "t" in x else {k: unpack(v) for k, v in x["d"].items()}
        return [unpack(y) for y in x] if isinstance(x, list) else x

    data = json.loads(text)
    rules = [unpack(r) for r in data["rules"]]
    return pattern_rule.RuleFile(data["imports"], data["includes"], [pattern_rule.PatternRule(**{**r, "strings": [pattern_rule.Pattern(**p) for p in r["strings"]]}) for r in rules])


def resolve_includes(files: DataFrame) -> DataFrame:
    """(src, dst, depth) of the closure of includes; a file that includes itself closes a cycle and stops there."""
    from ..operators.corpus import closure

    return closure(files.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(r'(?m)^\s*include\s+"([^"]*)"'), F.lit(1))).alias("dst")).distinct())


def _generated(head: dict) -> str | None:
    """Rule text from the parsed rule; null if it cannot be read."""
    try:
        if head["dialect"] == "L":
            return event_rule.generate(event_rule.parse(head["text"])[0])
        return pattern_rule.generate(pattern_rule.parse(head["text"]).rules[0])
    except RuleError:
        return None


def _same(head: dict, text: str | None) -> bool:
    try:
        if head["dialect"] == "L":
            return text is not None and event_rule.parse(text)[0] == event_rule.parse(head["text"])[0]
        return text is not None and pattern_rule.parse(text).rules == pattern_rule.parse(head["text"]).rules
    except RuleError:
        return False


def _by_rule(files: DataFrame, schema_text: str, make, rules_per_task: int = 500) -> DataFrame:
    spark = files.sparkSession
    heads = _heads(files)
    schema = _schema(spark, schema_text)
    rows = lambda batch: (make({"path": p, "pos": k, "name": n, "dialect": d, "text": t}) for p, k, n, d, t in zip(batch["path"], batch["pos"], batch["name"], batch["dialect"], batch["text"]))
    return heads.repartition(max(1, -(-heads.count() // rules_per_task)), "path", "pos").mapInPandas(_rows_of(schema, rows), schema)


def generate_corpus(files: DataFrame) -> DataFrame:
    """(path, pos, name, text): every rule written anew; null text where a rule cannot be read."""
    return _by_rule(files, "path string, pos int, name string, text string", lambda h: {"path": h["path"], "pos": h["pos"], "name": h["name"], "text": _generated(h)})


def round_trips(files: DataFrame) -> DataFrame:
    """(path, pos, name, readable, same): whether a rule's generated text parses to an equal rule."""

    def make(h):
        text = _generated(h)
        return {"path": h["path"], "pos": h["pos"], "name": h["name"], "readable": text is not None, "same": _same(h, text)}

    return _by_rule(files, "path string, pos int, name string, readable boolean, same boolean", make)
