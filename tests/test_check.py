import pytest

from rulespark.plans.build import Rule
from rulespark.plans.check import adapt, compatibility, validate
from rulespark.plans.expressions import KB, E, Hex, S, all_of, any_of, filesize, for_each, for_range, for_strings, n_of, name, of
from rulespark.plans.lexer import RuleError
from rulespark.plans.pattern_rule import parse


def issues(condition, strings='$a = "x"', head=""):
    text = f"{head} rule r {{ {'strings: ' + strings if strings else ''} condition: {condition} }}"
    return {(i.severity, i.issue) for i in validate(text)}


@pytest.mark.parametrize("condition,want", [
    ("$a", set()), ("$b and $a", {("error", "undefined_string")}), ("any of ($z*) and $a", {("error", "undefined_string")}), ("filesize > \"x\" and $a", {("error", "type")}), ("$a and other", {("error", "unknown_name")}),
    ("$a and math.entropy(0, filesize) > 7", {("error", "missing_import")}), ("$a and nothing.f(1) > 2", {("error", "unknown_module"), ("error", "unknown_function")}), ("$a and uint16(0, 1) == 1", {("error", "arity")}),
    ("$a and 1 << -1 == 2", {("error", "shift")}), ("$a and filesize % 0 == 1", {("warning", "division")}), ("3 of them", {("warning", "quantifier")}), ("200% of them", {("error", "quantifier")}), ("filesize > 1", {("warning", "unused_string")}),
    ("$a and \"x\" contains 3", {("error", "type")}), ("$a and for any i in (1..3) : (@a[i] > \"s\")", {("error", "type")}), ("$a and for all x in (1, 2) : (x > 0 and y)", {("error", "unknown_name")}), ("$a and with $q = 2 : ($q > 1)", set()),
    ("$a and [x * 2 for x in (1, 2)][0] == 2", set()), ("$a and r", {("error", "unknown_name"), ("error", "self_reference")}), ("$a and (lambda x: x + 1)(1, 2) > 0", {("error", "arity")}),
])
def test_validation(condition, want):
    assert issues(condition) == want


def test_files():
    assert {(i.issue, i.detail) for i in validate('import "math" import "hash" rule a { condition: hash.md5(0, 1) == "x" } rule a { condition: true }')} == {("duplicate_rule", "a"), ("unused_import", "math")}
    assert [i.issue for i in validate("rule a { condition: ( }")] == ["syntax"]
    assert not validate('import "pe" rule a { condition: pe.machine == pe.MACHINE_I386 and pe.sections[0].name == ".text" }')


def test_compatibility():
    text = 'rule a { strings: $a = "ab" base64 $b = /x{y/ $c = "-a" xor fullword $d = { 41 [1-70000] 42 } $e = /\\y/ condition: any of them and with $x = 1 : ($x > 0) and 1 of (filesize > 1, filesize > 2) and [x for x in (1, 2)][0] == 1 }'
    got = {(i.issue, i.severity) for i in compatibility(text)}
    assert got == {("base64_too_short", "error"), ("unescaped_brace", "error"), ("xor_fullword", "warning"), ("large_jump", "warning"), ("invalid_escape", "error"), ("with_statement", "info"), ("tuple_of_expressions", "info"), ("extended_feature", "info")}
    assert {i.issue for i in compatibility(text, minimum_base64_length=0, strict_regex_escaping=False, validate_escape_sequences=False, strict_xor_fullword=False, validate_hex_bounds=False)} == {"with_statement", "tuple_of_expressions", "extended_feature"}
    there = adapt("rule a { strings: $b = /x{y{2,3}/ condition: $b }")
    assert "x\\{y{2,3}" in there and not compatibility(there) and "/x{y{2,3}/" in adapt(there, False)


def test_expressions():
    for built, text in [
        (S("a").at(0) & (S("b").count > 2) | any_of("a", "b*"), "$a at 0 and #b > 2 or any of ($a, $b*)"), (~all_of() & (filesize < 2 * KB), "not all of them and filesize < 2048"),
        (n_of(2, "a") & of("50%") & (S("a").offset(2) + 1 == 5), "2 of ($a) and 50% of them and @a[2] + 1 == 5"), (for_strings("any", S().count > 1, "a"), "for any of ($a) : (# > 1)"),
        (for_range("all", "i", 1, 3, S("a").offset(name("i")) < 10), "for all i in (1..3) : (@a[i] < 10)"), (for_each("any", "x", [1, 2], name("x") > 1), "for any x in (1, 2) : (x > 1)"),
        (name("math.entropy")(0, filesize) > 7.5, "math.entropy(0, filesize) > 7.5"), (name("pe.sections")[0].member("name").startswith(".t", nocase=True), 'pe.sections[0].name istartswith ".t"'),
        ((filesize << 2).bitand(7) == 3, "(filesize << 2) & 7 == 3"), (S("a").within(0, 10) & (S("a").length() >= 3) & (S("a").count_in(0, 5) == 1), "$a in (0..10) and !a[1] >= 3 and #a in (0..5) == 1"),
    ]:
        assert isinstance(built, E)
        want, got = (parse(f'rule r {{ strings: $a = "x" $b = "y" $b1 = "z" condition: {t} }}').rules[0].condition for t in (text, str(built)))
        assert got == want, text


def test_built_rules():
    rule = Rule("made").hex("h", Hex().bytes(0x4D, 0x5A).wildcard(2).nibble("4?").other_than("00").jump(2, 4).either("AA", "BB CC").bytes(1)).where(S("h").at(0)).done()
    assert rule == parse("rule made { strings: $h = { 4D 5A ?? ?? 4? ~00 [2-4] (AA | BB CC) 01 } condition: $h at 0 }").rules[0]
    with pytest.raises(RuleError):
        Hex().jump(1).text()
