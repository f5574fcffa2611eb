import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rulespark.operators.scan import base64_forms, evaluate, hex_regex, order, regex_of, scan
from rulespark.plans.lexer import RuleError
from rulespark.plans.pattern_rule import generate, hex_tokens, parse
from rulespark.sources.rules import dialect_of, from_json, rule_rows, split_rules, to_json

RULES = r"""import "math"
include "other"
private global rule a : t1 t2 { meta: k = "v" n = -3 b = true
  strings: $a = "tx\x00\"t" nocase wide $b = { 4D 5A ?? [2-4] (AA | BB CC) ~5A 4? } $ = /re[a-z]+\/x/i fullword $x = "k" xor(1-3) $e = "pay" base64
  condition: #a > 2 and (2 of ($a, $b) or any of them) and not $b at 0 and for any i in (1..#a) : (@a[i] < 10) and 50% of them and filesize < 2KB and $a in (0..10) and #a in (1..5) == 2 and !a[1] == 3 }
rule b { condition: a and [x * 2 for x in (1, 2, 3) if x > 1][0] == 4 and with $q = 3 : ($q > 2) and match 3 { 1 => false, _ => true } and "abc"[1:2] == "b" and {"k": 1}["k"] == 1 and any of (1 > 2, 3 > 2) }
"""


def test_round_trips():
    file = parse(RULES)
    assert parse(generate(file)) == file
    assert from_json(to_json(file)) == file


@pytest.mark.parametrize("bad", [
    'rule r { strings: $a = "x" xor nocase condition: $a }', 'rule r { strings: $a = "x" base64 fullword condition: $a }', "rule r { strings: $a = { [2] 41 } condition: $a }", "rule r { strings: $a = { 41 (42 | [2-] 43) } condition: $a }",
    'rule r { strings: $a = "x" $a = "y" condition: $a }', "rule r { strings: $a = /x/ xor condition: $a }", 'rule r { strings: $a = "x" xor(9-3) condition: $a }', "rule r { condition: }", "rule r { strings: $a = { ~?? 41 } condition: $a }",
])
def test_rejects(bad):
    with pytest.raises(RuleError):
        parse(bad)


def test_reference_cycles():
    with pytest.raises(RuleError):
        order(parse("rule a { condition: b } rule b { condition: a }").rules)


def test_splitting_survives_braces_in_strings_and_errors():
    text = 'rule a { strings: $x = "}{" condition: $x } // rule no {\nrule b { condition: /* } */ true } rule bad { condition: ( }'
    assert [text[a:b].split()[1] for a, b in split_rules(text)] == ["a", "b", "bad"]
    rows = list(rule_rows("p", text))
    assert [r["error"] is None for r in rows] == [True, True, False]


def test_dialects():
    assert dialect_of('rule r { events: $e.metadata.id = "x" condition: $e }') == "L"
    assert dialect_of("rule r { condition: with x = 1 : (x > 0) }") == "X"
    assert dialect_of('rule r { strings: $a = "events: with x = 1 =>" condition: $a }') == "Y"


TOKEN = st.one_of(st.integers(0, 255).map(lambda b: f"{b:02X}"), st.just("??"), st.integers(0, 15).map(lambda n: f"{n:X}?"), st.integers(0, 15).map(lambda n: f"?{n:X}"), st.integers(0, 255).map(lambda b: f"~{b:02X}"))


@settings(max_examples=150, deadline=None)
@given(st.lists(TOKEN, min_size=1, max_size=5), st.binary(max_size=40))
def test_hex_tokens_as_regex(tokens, data):
    """The expression for hex tokens finds what a byte by byte comparison finds."""

    def fits(token, byte):
        body = token.lstrip("~")
        ok = all(c == "?" or int(c, 16) == nibble for c, nibble in zip(body, (byte >> 4, byte & 15)))
        return ok != token.startswith("~")

    want = [i for i in range(len(data) - len(tokens) + 1) if all(fits(t, data[i + k]) for k, t in enumerate(tokens))]
    pattern = re.compile(f"(?={hex_regex(hex_tokens(' '.join(tokens)))})", re.S)
    assert [m.start() for m in pattern.finditer(data.decode("latin-1"))] == want


@given(st.binary(min_size=1, max_size=12), st.binary(max_size=5), st.binary(max_size=5))
def test_base64_forms(raw, before, after):
    import base64

    forms = base64_forms(raw)
    if len(raw) > 2:
        assert any(f in base64.b64encode(before + raw + after) for f in forms)


def test_modifiers(spark):
    p = parse('rule r { strings: $a = "ab" wide ascii nocase $b = "cat" fullword condition: all of them }').rules[0].strings
    for data, ok in ((b"xABx", True), (b"a\0B\0", True), (b"a\0b", False)):
        assert bool(re.search(regex_of(p[0]), data.decode("latin-1"))) is ok
    for data, ok in ((b"a cat.", True), (b"cats", False), (b"\xe9cat", True)):
        assert bool(re.search(regex_of(p[1]), data.decode("latin-1"))) is ok


@pytest.fixture(scope="module")
def blobs(spark):
    rows = [(0, b""), (1, b"\0"), (2, bytes(range(256))), (3, b"aaaa"), (4, "naïve €".encode()), (5, b"\xff\xfeMZ"), (6, None)]
    return spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in rows], "blob_id int, data binary")


def test_overlaps_and_edges(blobs):
    rules = 'rule o { strings: $a = "aa" condition: #a == 3 and @a[3] == 2 and $a at 2 and !a[1] == 2 } rule all_bytes { strings: $h = { FE FF } condition: $h } rule small { condition: filesize < 2 } rule undef { condition: not uint32(1000) == 1 }'
    got = {r["blob_id"]: (r["o"], r["all_bytes"], r["small"], r["undef"]) for r in evaluate(blobs, rules).collect()}
    assert got == {0: (False, False, True, False), 1: (False, False, True, False), 2: (False, True, False, False), 3: (True, False, False, False), 4: (False, False, False, False), 5: (False, False, False, False), 6: (False, False, False, False)}


def test_global_gate_and_private(blobs):
    rules = 'global private rule g { condition: filesize == 4 } rule r : t { meta: m = 1 strings: $a = "a" private $b = "aaa" condition: $a } rule any_size { condition: true }'
    rows = scan(blobs, rules).collect()
    assert {(r["blob_id"], r["rule"]) for r in rows} == {(3, "r"), (3, "any_size"), (5, "any_size")}
    r = next(r for r in rows if r["rule"] == "r")
    assert r["tags"] == ["t"] and r["meta"] == {"m": "1"} and [(s["identifier"], s["offset"], bytes(s["data"])) for s in r["strings"]] == [("$b", 0, b"aaa"), ("$b", 1, b"aaa")]


def test_integers_wrap(spark):
    from pyspark.sql import functions as F

    from rulespark.functions import modules as M

    edge = [0, 1, -1, 2, -2, 3, 2**31, -(2**31), 2**32 + 5, 2**62, -(2**62), 2**63 - 1, -(2**63), 3037000500]
    df = spark.createDataFrame([(a, b) for a in edge for b in edge], "a long, b long")
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    for r in df.select("a", "b", M.add(F.col("a"), F.col("b")).alias("s"), M.subtract(F.col("a"), F.col("b")).alias("d"), M.multiply(F.col("a"), F.col("b")).alias("p")).collect():
        assert (r["s"], r["d"], r["p"]) == (wrap(r["a"] + r["b"]), wrap(r["a"] - r["b"]), wrap(r["a"] * r["b"])), r


def test_byte_statistics(spark):
    import math

    from pyspark.sql import functions as F

    from rulespark.functions import modules as M

    for data in (b"a", b"abracadabra" * 3, bytes(range(256))):
        df = spark.createDataFrame([(data.decode("latin-1"),)], "s string")
        s = F.col("s")
        n = len(data)
        shares = [data.count(b) / n for b in set(data)]
        x, below = list(data), n * sum(b * b for b in data) - sum(data) ** 2
        scc = (n * sum(a * b for a, b in zip(x, x[1:] + x[:1])) - sum(x) ** 2) / below if below else -100000.0
        got = df.select(M.entropy(s), M.mean(s), M.deviation(s, F.lit(100.0)), M.serial_correlation(s), M.checksum32(s), M.mode(s)).first()
        want = (-sum(p * math.log2(p) for p in shares), sum(data) / n, sum(abs(b - 100) for b in data) / n, scc, sum(data), min(set(data), key=lambda b: (-data.count(b), b)))
        assert got == pytest.approx(want), data
