"""Forms of rule files, dialects, jobs and the command line."""

import json
import time

import pytest

from rulespark import cli
from rulespark.jobs import Tracker, each_rule, map_rules, scaling
from rulespark.operators import analysis
from rulespark.plans import pattern_rule
from rulespark.plans.lexer import RuleError
from rulespark.sources import dialects, sinks
from rulespark.sources.rules import parse_corpus, parse_files, read_rules

TEXT = r"""// head
import "pe"
include "base.rules"
/* of one */
private rule one : b a { meta: author = "x" long_key = 3 strings: $a = "te\"xt" nocase $long = { 4D 5A ?? } $ = /a{2}b/i condition: $a and ($long at 0 or any of them) and not pe.number_of_sections == 3 }
rule two { condition: one and filesize > 10KB // tail
}
"""
EVENTS = 'rule e { meta: author = "x" events: $e.metadata.event_type = "a" $e.principal.user.userid = $u match: $u over 1h condition: #e > 1 }'


def test_styles():
    rules = pattern_rule.parse(TEXT)
    for style in sinks.STYLES:
        text = sinks.pretty(TEXT, style)
        assert pattern_rule.parse(text) == rules
        assert sinks.check_format(text, style) == (True, [])
    assert not sinks.check_format(TEXT)[0] and sinks.check_format(TEXT)[1]
    narrow = sinks.pretty(TEXT, sinks.Style(line_length=40))
    assert pattern_rule.parse(narrow) == rules and max(map(len, narrow.split("\n"))) < 70
    with pytest.raises(RuleError):
        sinks.pretty("rule x { condition: ( }")


def test_forms():
    yaml = pytest.importorskip("yaml")
    rules = pattern_rule.parse(TEXT)
    assert yaml.safe_load(sinks.to_yaml(rules)) == json.loads(sinks.to_json(rules))
    assert [r["name"] for r in yaml.safe_load(sinks.minimal_yaml(rules))["rules"]] == ["one", "two"]
    assert sinks.from_blob(sinks.to_blob(rules)) == rules
    assert 0 < sinks.sizes(rules)["ratio"] < 1
    assert sinks.round_trip(TEXT) == [] and sinks.round_trip(EVENTS) == []


def test_comments():
    assert [(c["line"], c["kind"], c["text"], c["rule"]) for c in sinks.comments(TEXT)] == [(1, "line", "head", "one"), (4, "block", "of one", "one"), (6, "line", "tail", "two")]


def test_event_comparison():
    assert sinks.compare_event_rules(EVENTS, EVENTS.replace("  ", " ")) == {"semantic": True, "structural": True}
    assert sinks.compare_event_rules(EVENTS, EVENTS.replace('"x"', '"y"')) == {"semantic": False, "structural": True}
    assert sinks.compare_event_rules(EVENTS, EVENTS.replace("> 1", "> 2")) == {"semantic": False, "structural": False}


def test_dialects():
    assert [dialects.detect(t).name for t in (TEXT, EVENTS, "rule x { condition: with $a = 1 : ($a > 0) }")] == ["Y", "L", "X"]
    dialects.register(dialects.Dialect("Z", lambda t: t.startswith("#z"), lambda t: t[2:].split(), " ".join, (".z",)))
    try:
        assert dialects.read("#z a b") == ["a", "b"] and dialects.detect("#z").generate(["q"]) == "q"
        assert dialects.read(EVENTS, "L")[0].name == "e"
    finally:
        dialects.DIALECTS.pop("Z")


def test_rules_one_by_one():
    seen, steps = [], []
    assert [r["name"] for r in each_rule(TEXT, seen.append, steps.append)] == ["one", "two"] and steps == [1, 2] and len(seen) == 2
    assert [len(c) for c in each_rule(TEXT * 3, chunk=4)] == [4, 2]
    stop = iter([False, True])
    assert len(list(each_rule(TEXT, cancelled=lambda: next(stop)))) == 1


def test_jobs(spark):
    t = Tracker(spark)
    assert t.run("count", lambda: spark.range(5).count()).result == 5
    assert t.run("bad", lambda: 1 / 0).status == "failed"

    def slow():
        return spark.range(4).repartition(4).rdd.map(lambda x: time.sleep(30)).count()

    began = time.time()
    assert t.run("slow", slow, timeout=2).status == "timeout" and time.time() - began < 25
    assert [(r["name"], r["status"]) for r in t.table().collect()] == [("count", "done"), ("bad", "failed"), ("slow", "timeout")]
    assert t.statistics()["done"] == 1
    assert [n for n, _ in scaling(spark, lambda n: spark.range(10, numPartitions=n).count(), [1, 2])] == [1, 2]


def test_batches(spark):
    files = spark.createDataFrame([("f", TEXT + "rule bad { condition: ( }")], "path string, text string")

    def picky(row):
        if row["name"] == "two":
            raise ValueError("no")
        return 1

    def sleepy(row):
        time.sleep(3)

    rows = {(r["name"], r["operation"]): r for r in analysis.batch(files, ["serialize", "html_tree", picky]).collect()}
    assert rows["one", "picky"]["ok"] and rows["two", "picky"]["error"] == "ValueError: no" and not rows["bad", "serialize"]["ok"]
    assert "<li>$a plain" in json.loads(rows["one", "html_tree"]["result"])
    assert {r["operation"]: r["failed_count"] for r in analysis.batch_result(analysis.batch(files, ["parse", picky])).collect()} == {"parse": 1, "picky": 2}
    assert {r["error"] for r in analysis.batch(files.limit(1), [sleepy], timeout=0.2).filter("name = 'one'").collect()} == {"TimeoutError: more than 0.2 s"}
    parsed = parse_files(files)
    assert {(r["rule"], r["result"]) for r in map_rules(parsed, lambda row: len(row["strings"] if row["strings"] is not None else [])).collect()} >= {("one", "3"), ("two", "0")}


def test_large_files_are_parsed_alike(spark, tmp_path):
    (tmp_path / "a.yar").write_text(TEXT)
    (tmp_path / "b.yar").write_text("rule one { condition: two* } rule twofold { condition: 1 of (one, tw*) } rule three { condition: nothing }")
    files = read_rules(spark, str(tmp_path))
    key = lambda df: sorted((r["path"], r["pos"], r["name"], r["error"], sorted(r["rule_refs"] or []), r["condition"]) for r in df.collect())
    assert str(key(parse_corpus(files, 2))) == str(key(parse_files(files)))
    sinks.write_rules(parse_files(files), str(tmp_path / "out"))
    assert sinks.read_parsed(spark, str(tmp_path / "out")).count() == 5


def test_command_line(spark, tmp_path, capsys):
    one, two, events = (tmp_path / n for n in ("one.yar", "two.yar", "e.yar"))
    one.write_text(TEXT)
    two.write_text(TEXT.replace('"te\\"xt" nocase', '"other"'))
    events.write_text(EVENTS)
    (tmp_path / "blob").write_bytes(b'MZ te"xt aab')

    def run(*args):
        code = cli.main([str(a) for a in args])
        return code, capsys.readouterr().out

    assert run("parse", one)[0] == 0 and len(run("parse", one)[1].splitlines()) == 2
    assert pattern_rule.parse(run("fmt", one, "--style", "readable")[1]) == pattern_rule.parse(TEXT)
    assert run("check-format", one)[0] == 1
    assert run("validate", one)[0] == 0 and run("validate", events)[0] == 0
    assert run("compat", one)[0] == 0 and "rule one" in run("convert", one)[1]
    assert '"path": "strings.$a", "change": "MODIFIED"' in run("diff", one, two)[1]
    for command in ("analyze", "metrics", "patterns", "performance-check", "workspace", "info", "roundtrip", "bench", "features"):
        assert run(command, one)[0] == 0, command
    assert run("metrics", one, "--gate", "101")[0] == 1
    assert run("graph", one)[1].startswith("digraph")
    assert run("serialize", one, "--format", "minimal")[1].startswith('"rules"')
    assert "rule two" in run("optimize", one)[1]
    assert '"success_rate": 100.0' in run("batch", one, "--operations", "parse", "--brief")[1]
    scan_rule = tmp_path / "scan.yar"
    scan_rule.write_text('rule hit { strings: $a = "aab" condition: $a }')
    assert '"rule": "hit"' in run("scan", scan_rule, "--target", tmp_path / "blob", "--fast")[1]
    assert run("events", events, "--target", "/root/testdata/sf0.001/events.parquet")[0] == 0
    bad = tmp_path / "bad.yar"
    bad.write_text("rule x { condition: ( }")
    assert run("fmt", bad)[0] == 2
