"""Command line: `python -m rulespark.cli COMMAND FILE...`; results are JSON lines, or text where a command writes rules.

parse fmt check-format validate compat convert diff analyze metrics patterns performance-check optimize graph workspace
serialize info roundtrip scan events batch bench
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from rulespark.plans import build, check, event_rule, pattern_rule
from rulespark.plans.lexer import RuleError
from rulespark.sources import sinks
from rulespark.sources.rules import dialect_of, rule_rows


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _files(paths: list[str]) -> list[tuple[str, str]]:
    out = []
    for p in map(Path, paths):
        every = sorted(x for x in p.rglob("*") if x.suffix in (".yar", ".yara", ".rules")) if p.is_dir() else [p]
        out += [(str(x), x.read_text()) for x in every]
    return out


def _tables(paths: list[str]):
    from rulespark.operators import corpus
    from rulespark.sources.rules import parse_files
    from rulespark.storage import stored

    parsed = stored(parse_files(_spark().createDataFrame(_files(paths), "path string, text string")), "parsed")
    return parsed, corpus.tables(parsed)


def _show(rows) -> None:
    for r in rows:
        print(json.dumps(r, default=str, ensure_ascii=False))


def _frame(df) -> None:
    _show(r.asDict(recursive=True) for r in df.collect())


def parse(a) -> int:
    bad = 0
    for path, text in _files(a.files):
        for row in rule_rows(path, text):
            bad += row["error"] is not None
            _show([{k: row[k] for k in ("path", "dialect", "name", "error", "tags", "condition")}])
    return int(bad > 0)


def fmt(a) -> int:
    for _, text in _files(a.files):
        print(sinks.pretty(text, a.style) if dialect_of(text) != "L" else "\n".join(map(event_rule.generate, event_rule.parse(text))), end="")
    return 0


def check_format(a) -> int:
    bad = 0
    for path, text in _files(a.files):
        good, diff = sinks.check_format(text, a.style)
        bad += not good
        _show([{"path": path, "formatted": good, "diff": diff}])
    return int(bad > 0)


def validate(a) -> int:
    bad = 0
    for path, text in _files(a.files):
        if dialect_of(text) == "L":
            found = [{"path": path, "severity": s, "detail": m} for r in event_rule.parse(text) for s, m in event_rule.validate(r)]
        else:
            found = [{"path": path, **vars(i)} for i in check.validate(text)]
        bad += any(x["severity"] == "error" for x in found)
        _show(found)
    return int(bad > 0)


def compat(a) -> int:
    found = [{"path": path, **vars(i)} for path, text in _files(a.files) for i in check.compatibility(text)]
    _show(found)
    return int(any(x["severity"] == "error" for x in found))


def convert(a) -> int:
    for _, text in _files(a.files):
        print(check.adapt(text, not a.classic), end="")
    return 0


def diff(a) -> int:
    from rulespark.operators import analysis
    from rulespark.sources.rules import parse_files

    (_, old), (_, new) = _files(a.files)[:2]
    spark = _spark()
    one, two = (parse_files(spark.createDataFrame([("f", t)], "path string, text string")) for t in (old, new))
    _frame(analysis.rule_diff(one, two).orderBy("rule", "path"))
    _frame(analysis.logic_or_style(one, two).orderBy("rule"))
    return 0


def analyze(a) -> int:
    from rulespark.operators import analysis, corpus

    _, t = _tables(a.files)
    _frame(analysis.rule_set_quality(t["rules"], t["strings"], t["refs"], t["edges"]))
    _frame(analysis.recommendations(t["rules"], t["strings"], t["refs"], t["edges"]).orderBy("type", "rule"))
    _frame(corpus.lint(t["rules"], t["strings"]).orderBy("rule", "sid"))
    return 0


def metrics(a) -> int:
    from rulespark.operators import corpus

    _, t = _tables(a.files)
    _frame(corpus.totals(t["rules"], t["strings"]))
    _frame(corpus.complexity(t["rules"]).orderBy("rule"))
    grade = corpus.quality(t["rules"], corpus.unused(t["strings"], t["refs"])).first()
    _show([grade.asDict()])
    return int(a.gate is not None and grade["score"] < a.gate)


def patterns(a) -> int:
    from rulespark.operators import analysis

    _, t = _tables(a.files)
    _frame(analysis.pattern_statistics(t["strings"]))
    _frame(analysis.pattern_complexity(t["strings"]).orderBy("rule", "sid"))
    _frame(analysis.similar_patterns(t["strings"]).orderBy("group"))
    return 0


def performance_check(a) -> int:
    from rulespark.operators import analysis

    _, t = _tables(a.files)
    found = analysis.performance_lint(t["strings"])
    found = found.filter(found["severity"] == a.severity) if a.severity else found
    _frame(found.orderBy("rule", "sid").limit(a.limit) if a.limit else found.orderBy("rule", "sid"))
    _frame(analysis.summary(found).orderBy("severity"))
    return 0


def optimize(a) -> int:
    for _, text in _files(a.files):
        rules = build.prune(pattern_rule.parse(text))
        rules.rules = [build.fold(r) for r in rules.rules]
        print(pattern_rule.generate(rules), end="")
    return 0


def graph(a) -> int:
    from rulespark.operators import analysis

    parsed, _ = _tables(a.files)
    print(analysis.dot(analysis.graph(parsed)).first()["dot"], end="")
    return 0


def workspace(a) -> int:
    from rulespark.operators import analysis, corpus

    parsed, t = _tables(a.files)
    _frame(analysis.workspace_report(parsed))
    _frame(corpus.name_conflicts(t["rules"]).orderBy("name"))
    _frame(analysis.top_modules(parsed))
    if a.find:
        _frame(analysis.find_rule(parsed, a.find).select("path", "pos", "name"))
    return 0


def serialize(a) -> int:
    for _, text in _files(a.files):
        rules = pattern_rule.parse(text)
        print({"json": sinks.to_json, "yaml": sinks.to_yaml, "minimal": sinks.minimal_yaml}[a.format](rules))
    return 0


def info(a) -> int:
    _show({"path": path, "rules": len(r.rules), **sinks.sizes(r)} for path, r in ((p, pattern_rule.parse(t)) for p, t in _files(a.files)))
    return 0


def roundtrip(a) -> int:
    found = [{"path": path, "differences": sinks.round_trip(text)} for path, text in _files(a.files)]
    _show(found)
    return int(any(x["differences"] for x in found))


def scan(a) -> int:
    from rulespark.operators.scan import scan as scan_blobs

    rules = "\n".join(text for _, text in _files(a.files))
    blobs = _spark().read.format("binaryFile").load(a.target).selectExpr("path", "content as data")
    _frame(scan_blobs(blobs, rules, fast=a.fast))
    return 0


def events(a) -> int:
    from rulespark.operators.events import detect, security_events

    spark = _spark()
    for _, text in _files(a.files):
        for rule in event_rule.parse(text):
            _frame(detect(rule, security_events(spark.read.parquet(a.target))))
    return 0


def batch(a) -> int:
    from rulespark.operators import analysis

    rows = analysis.batch(_spark().createDataFrame(_files(a.files), "path string, text string"), a.operations.split(","), a.timeout)
    _frame(rows.drop("result") if a.brief else rows)
    _frame(analysis.batch_result(rows).orderBy("operation"))
    return 0


def bench(a) -> int:
    for path, text in _files(a.files):
        began = time.time()
        rules = pattern_rule.parse(text)
        parsed = time.time()
        again = pattern_rule.generate(rules)
        written = time.time()
        pattern_rule.parse(again)
        _show([{"path": path, "rules": len(rules.rules), "parse": parsed - began, "codegen": written - parsed, "roundtrip": time.time() - began}])
    return 0


def features(a) -> int:
    _show([{"feature": k, "default": v} for k, v in check.FEATURES.items()])
    return 0


COMMANDS = {f.__name__.replace("_", "-"): f for f in (parse, fmt, check_format, validate, compat, convert, diff, analyze, metrics, patterns, performance_check, optimize, graph, workspace, serialize, info, roundtrip, scan, events, batch, bench, features)}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rulespark", description=__doc__.split("\n")[0])
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("files", nargs="*")
    p.add_argument("--style", default="default", choices=sorted(sinks.STYLES))
    p.add_argument("--format", default="json", choices=("json", "yaml", "minimal"))
    p.add_argument("--classic", action="store_true", help="convert to the classic dialect")
    p.add_argument("--severity")
    p.add_argument("--limit", type=int)
    p.add_argument("--gate", type=float, help="least quality score")
    p.add_argument("--find", help="rule to look up")
    p.add_argument("--target", help="files to scan, or a table of events")
    p.add_argument("--fast", action="store_true")
    p.add_argument("--operations", default="parse,complexity,validate")
    p.add_argument("--timeout", type=float)
    p.add_argument("--brief", action="store_true")
    a = p.parse_args(argv)
    try:
        return COMMANDS[a.command](a)
    except RuleError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
