import pytest

from rulespark.plans import build
from rulespark.plans.lexer import RuleError
from rulespark.plans.pattern_rule import parse, text_of


def test_builder_equals_text():
    built = build.Rule("r").tag("t").meta("k", 1).text("a", "MZ", nocase=True).hex("h", "4D ?? [1-2] 5A").preset("e", "elf").where("$a at 0 or all of ($h, $e)").done()
    assert built == parse('rule r : t { meta: k = 1 strings: $a = "MZ" nocase $h = { 4D ?? [1-2] 5A } $e = { 7F 45 4C 46 } condition: $a at 0 or all of ($h, $e) }').rules[0]
    with pytest.raises(RuleError):
        build.Rule("r").text("a", "x", xor=True, nocase=True).where("$a").done()


def test_renaming_reaches_the_condition():
    rule = parse('rule r { strings: $a1 = "x" $a2 = "y" condition: #a1 > 1 and any of ($a*) and for all of them : ($) }').rules[0]
    out = build.prefix_strings(rule, "p_")
    assert [p.sid for p in out.strings] == ["p_a1", "p_a2"]
    assert text_of(out.condition) == "(((#p_a1 > 1) and any of ($p_a1, $p_a2)) and for all of them : ($))"
    with pytest.raises(RuleError):
        build.rename_strings(rule, {"a1": "a2"})


def test_folding_and_pruning():
    fold = lambda c: text_of(build.fold(parse(f"rule r {{ condition: {c} }}").rules[0]).condition)
    assert fold("9223372036854775807 + 1 == -5 or true") == "true"
    assert fold("1 << 64 == 0") == "true"
    assert fold("filesize > 2 * 3 and 1 < 2") == "(filesize > 6)"
    assert fold("defined (filesize \\ 0)") == "defined ((filesize \\ 0))"
    file = parse('private rule dead { condition: true } private rule used { condition: true } rule r { strings: $a = "x" $b = "y" condition: $a and used }')
    out = build.prune(file)
    assert [r.name for r in out.rules] == ["used", "r"] and [p.sid for p in out.rules[1].strings] == ["a"]
    assert len(build.merge(file, file).rules) == 3
