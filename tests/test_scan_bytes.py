"""Scans of bytes against a plain search."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulespark.operators.scan import evaluate, many_literals, running, scan, wide_regex


def matched(spark, rule, blobs):
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(blobs)], "id int, data binary")
    return {r["id"] for r in evaluate(df, rule).filter("r").collect()}


def test_dot_and_flags(spark):
    blobs = [b"a\rb", b"a\x85b", b"a\nb", b"axb", b"x\nab"]
    assert matched(spark, "rule r { strings: $a = /a.b/ condition: $a }", blobs) == {0, 1, 3}
    assert matched(spark, "rule r { strings: $a = /a.b/s condition: $a }", blobs) == {0, 1, 2, 3}


def test_wide_regex(spark):
    wide = lambda t: t.encode("utf-16le")
    blobs = [wide("abc"), b"abc", wide("abbbc"), b"a\0bc\0", wide("x-abc-x"), wide("xabcx")]
    assert matched(spark, "rule r { strings: $a = /ab+c/ wide condition: $a }", blobs) == {0, 2, 4, 5}
    assert matched(spark, "rule r { strings: $a = /ab+c/ wide ascii condition: $a }", blobs) == {0, 1, 2, 4, 5}
    assert matched(spark, "rule r { strings: $a = /abc/ wide fullword condition: $a }", blobs) == {0, 4}
    assert wide_regex(r"a(b|[c-d\]]{2,3})\x41$") == r"(?:a\x00)((?:b\x00)|(?:[c-d\]]\x00){2,3})(?:\x41\x00)$"


def test_at_any_place(spark):
    blobs = [b"word", b" word", b"aword", b"ab word", b"abcword", b""]
    rule = "rule r {{ strings: $a = \"word\" {} condition: $a at filesize - 4 }}"
    assert matched(spark, rule.format(""), blobs) == {0, 1, 2, 3, 4}
    assert matched(spark, rule.format("fullword"), blobs) == {0, 1, 3}
    assert matched(spark, 'rule r { strings: $a = "word" condition: $a at 99 or $a at 0 - 1 }', blobs) == set()


def test_running_sums(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        got = spark.range(1).select(running(F.array(*[F.lit(k).cast("long") for k in range(n)]) if n else F.array().cast("array<bigint>"))).first()[0]
        assert got == [k * (k + 1) // 2 for k in range(n)]


def test_offsets_of_many_matches(spark):
    data = b"ab.a" * 500
    df = spark.createDataFrame([(1, bytearray(data))], "id int, data binary")
    found = scan(df, 'rule r { strings: $a = "a" condition: $a }').first()["strings"]
    assert [s["offset"] for s in found] == [m.start() for m in re.finditer(b"(?=a)", data)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("abc", max_size=4), max_size=30), st.lists(st.one_of(st.none(), st.text("abcd", max_size=30)), min_size=1, max_size=6))
def test_many_literals(spark, literals, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    words = spark.createDataFrame([(w,) for w in literals], "value string")
    want = {(k, w) for k, t in enumerate(texts) for w in literals if t is not None and w and w in t}
    for few, most in ((64, 1000), (0, 1000), (0, 5)):  # in the JVM, one automaton, several
        assert {(r["id"], r["value"]) for r in many_literals(rows, words, few=few, most=most).collect()} == want


def test_many_literals_keep_columns(spark):
    rows = spark.createDataFrame([(1, "x", "one two")], "id int, value_of string, text string")
    words = spark.createDataFrame([("two", 5), ("two", 6), (None, 7)], "value string, sid int")
    assert {(r["id"], r["value"], r["sid"]) for r in many_literals(rows, words).collect()} == {(1, "two", 5), (1, "two", 6)}
