import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rulespark.operators.events import detect, security_events
from rulespark.plans import event_rule
from rulespark.plans.lexer import RuleError

RULE = """rule r {
  meta: author = "a" description = "d"
  events:
    $e.metadata.event_type = "login" nocase
    $e.principal.user.userid = $u
  match: $u over 1h
  outcome: $n = count($e.metadata.id) $first = earliest($e.metadata.event_timestamp)
  condition: #e >= 2
}"""


@pytest.fixture(scope="module")
def events(spark):
    at = lambda h, m, s=0: dt.datetime(2024, 1, 1, h, m, s)
    rows = [(1, at(0, 0), 7, "login", 1.0, '{"k": 5}'), (2, at(0, 59, 59), 7, "LOGIN", 2.0, None), (3, at(1, 0), 7, "login", 3.0, "{}"), (4, at(1, 30), None, "login", 4.0, None), (5, at(1, 31), None, "login", None, None), (6, at(2, 0), 8, "buy", 9.0, None), (7, at(1, 59), 8, "login", 0.0, None)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_window_edges_and_null_keys(events):
    got = {(r["u"], r["n"], r["window_start"].hour) for r in detect(RULE, security_events(events)).collect()}
    assert got == {(7, 2, 0), (None, 2, 1)}


def test_zero_values_option(events):
    rule = RULE.replace("\n}", "\n  options: allow_zero_values = false\n}")
    assert {r["u"] for r in detect(rule, security_events(events)).collect()} == {7}


def test_sequence(events):
    rule = 'rule s { events: $a.metadata.event_type = "login" $b.metadata.event_type = "buy" $a.principal.user.userid = $u $b.principal.user.userid = $u match: $u over 5m after $a condition: $a and $b }'
    assert [(r["u"], r["n_a"], r["n_b"]) for r in detect(rule, security_events(events)).collect()] == [(8, 1, 1)]


def test_json_field_missing(events):
    rule = 'rule j { events: $e.additional.fields["k"] > 1 condition: $e }'
    assert [r["e_id"] for r in detect(rule, security_events(events)).collect()] == [1]


def test_round_trip():
    rule = event_rule.parse(RULE)[0]
    assert event_rule.parse(event_rule.generate(rule))[0] == rule


@pytest.mark.parametrize("bad", ["rule r { condition: $e }", "rule r { events: $e.metadata.id = 1 }", "rule r { events: $e.metadata.id = 1 match: $u over 0m condition: $e }", "rule r { nonsense: 1 }"])
def test_rejects(bad):
    with pytest.raises(RuleError):
        event_rule.parse(bad)


def test_validation():
    rule = event_rule.parse('rule r { events: $e.metadata.id = 1 match: $u over 40d condition: $x }')[0]
    messages = [m for _, m in event_rule.validate(rule)]
    assert any("$u" in m for m in messages) and any("unknown variable x" in m for m in messages) and any("30 days" in m for m in messages)


ATOM = st.sampled_from(["#e > 1", "$n < 5", "$e", "not $e", "2 of ($e, $n > 3)"])


@settings(max_examples=50, deadline=None)
@given(st.lists(ATOM, min_size=1, max_size=5), st.lists(st.sampled_from(["and", "or"]), min_size=4, max_size=4))
def test_condition_round_trip(atoms, ops):
    text = " ".join(x for pair in zip(atoms, [*ops, ""]) for x in pair if x).rsplit(" ", 0)[0]
    text = text if len(atoms) == 5 else " ".join(text.split(" "))
    words = text.split()
    text = " ".join(words[:-1] if words[-1] in ("and", "or") else words)
    rule = event_rule.parse("rule r { events: $e.metadata.id = 1 condition: " + text + " }")[0]
    assert event_rule.parse(event_rule.generate(rule))[0] == rule


def test_stream_equals_batch(spark, events, tmp_path):
    from rulespark.streaming.events import detect_stream, run_available, sessions, stream_of

    path = str(tmp_path / "in")
    events.write.parquet(path)
    query = detect_stream(RULE, stream_of(spark, path, events.schema))
    got = {(r["u"], r["n"]) for r in run_available(query, "closed_windows", str(tmp_path / "c")).collect()}
    assert got <= {(7, 2), (None, 2)}
    assert sessions(events, "1 hour").filter("user_id = 7").count() == 1
