"""Reports over rules as data: rule-set quality, recommendations, pattern scores, lint, graphs, diffs and batches.

Inputs are the tables of `operators.corpus.tables`; outputs are tables.  Thresholds and penalties are fixed values of
the reports' definitions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespark.operators import corpus as C


# Quality and recommendations


def rule_set_quality(rules: DataFrame, strings: DataFrame, refs: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: usage efficiency, dependencies, independence, cycles, and a score of 0..100."""
    usage = C.usage(rules, strings, refs).agg(F.sum("n_defined").alias("defined"), F.sum("n_used").alias("used"), F.count("*").alias("n_rules"))
    counts = edges.groupBy("src").agg(F.count("*").alias("n"))
    deps = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_deps"), F.coalesce(F.max("n"), F.lit(0)).alias("max_dependencies"))
    alone = C.isolated(rules, edges).agg(F.count("*").alias("n_alone"))
    cycles = C.cyclic(edges).agg(F.count_distinct("cycle").alias("circular_dependency_score"))
    one = usage.crossJoin(deps).crossJoin(alone).crossJoin(cycles)  # one row each
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    one = one.withColumns({"efficiency": share("used", "defined"), "average": share("n_deps", "n_rules"), "independence": share("n_alone", "n_rules")})
    score = 100.0 - (1 - F.col("efficiency")) * 20 - F.col("circular_dependency_score") * 10 - F.greatest(F.lit(0.0), F.col("average") - 3) * 5
    return one.select(
        F.round("efficiency", 6).alias("string_usage_efficiency"), F.round("average", 6).alias("average_dependencies"), "max_dependencies", F.round("independence", 6).alias("independence_ratio"),
        "circular_dependency_score", F.greatest(F.lit(0), F.least(F.lit(100), score.cast("int"))).alias("overall_quality_score"),
    )


def recommendations(rules: DataFrame, strings: DataFrame, refs: DataFrame, edges: DataFrame) -> DataFrame:
    """(type, severity, rule, detail): unused and undefined strings, cycles, more than 5 dependencies, low use of strings."""

    def rows(df: DataFrame, kind: str, severity: str, rule: str, detail: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.col(rule).alias("rule"), detail.cast("string").alias("detail"))

    listed = lambda df: df.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_set("sid")), ",").alias("sids"))
    usage = C.usage(rules, strings, refs)
    parts = [
        rows(listed(C.unused(strings, refs)), "unused_strings", "warning", "rule", F.col("sids")),
        rows(listed(C.undefined(strings, refs)), "undefined_strings", "error", "rule", F.col("sids")),
        rows(C.cyclic(edges).select("cycle").distinct(), "circular_dependency", "error", "cycle", F.col("cycle")),
        rows(edges.groupBy("src").agg(F.count("*").alias("n")).filter("n > 5"), "high_dependency", "warning", "src", F.col("n")),
        rows(usage.filter("n_defined > 2 and usage_rate < 0.5"), "low_string_usage", "info", "rule", F.col("usage_rate")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Top lists and orders


def top_modules(parsed: DataFrame, n: int = 5) -> DataFrame:
    """Modules by the number of files that import them."""
    used = parsed.select("path", F.explode("imports").alias("module")).distinct()
    return used.groupBy("module").agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "module").limit(n)


def first_prefixes(strings: DataFrame, n: int = 10) -> DataFrame:
    """The first prefixes, most frequent first and then by text."""
    return C.affixes(strings.filter("kind = 'plain'")).orderBy(F.desc("n"), "affix").limit(n)


def by_cost(strings: DataFrame) -> DataFrame:
    """Strings of each rule with their place when cheap ones come first."""
    from pyspark.sql import Window as W

    return C.costs(strings).withColumn("place", F.row_number().over(W.partitionBy("rule").orderBy("cost", "sid")))


def by_complexity(rules: DataFrame, strings: DataFrame) -> DataFrame:
    """(rule, complexity, place): strings count 1 each, conditions by their cyclomatic number and depth; simple rules first."""
    from pyspark.sql import Window as W

    n = strings.groupBy("rule").agg(F.count("*").alias("n_strings"))
    cost = F.coalesce("n_strings", F.lit(0)) + F.coalesce("cyclomatic", F.lit(0)) + F.coalesce("depth", F.lit(0))
    rows = rules.join(n, "rule", "left").select("rule", "path", cost.alias("complexity"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("path").orderBy("complexity", "rule")))


# Patterns


def hex_scores(strings: DataFrame) -> DataFrame:
    """Per hex string: bytes, wildcards, jumps, alternatives, wildcard ratio and score."""
    count = lambda test: F.size(F.filter("tokens", test))
    s = strings.filter("kind = 'hex'").select(
        "rule", "sid", F.size("tokens").alias("n_tokens"), count(lambda t: t.rlike("^~?[0-9A-Fa-f]{2}$")).alias("n_bytes"), count(lambda t: t.startswith("~")).alias("n_negated"),
        count(lambda t: (t == "??") | t.rlike(r"^(?:\?[0-9A-Fa-f]|[0-9A-Fa-f]\?)$")).alias("n_wildcards"), count(lambda t: t.startswith("[")).alias("n_jumps"), count(lambda t: t.startswith("(")).alias("n_alternatives"),
    )
    score = F.col("n_negated") + F.col("n_jumps") * 2 + F.col("n_alternatives") * 3 + F.col("n_wildcards") * 0.5
    return s.withColumns({"wildcard_ratio": F.round(F.when(F.col("n_tokens") > 0, F.col("n_wildcards") / F.col("n_tokens")).otherwise(0.0), 6), "score": score.cast("double")})


def regex_scores(strings: DataFrame) -> DataFrame:
    count = lambda p: F.regexp_count("value", F.lit(p))
    s = strings.filter("kind = 'regex'").select("rule", "sid", count(r"\([^?]").alias("n_groups"), count(r"[*+?{]").alias("n_quantifiers"), count(r"\[[^\]]+\]").alias("n_classes"), count(r"[\^$]").alias("n_anchors"))
    return s.withColumn("score", (F.col("n_groups") * 2 + F.col("n_quantifiers") + F.col("n_classes") * 1.5 + F.col("n_anchors") * 0.5).cast("double"))


def pattern_complexity(strings: DataFrame) -> DataFrame:
    """(rule, sid, kind, complexity, level) of each string."""
    key = ["rule", "sid"]
    printable = F.length(F.regexp_replace("value", r"[^\x20-\x7e]", "")) / F.greatest(F.length("value"), F.lit(1))
    plain = strings.filter("kind = 'plain'").select(*key, (F.floor(F.col("length") / 10) + F.when(printable < 0.8, 2).otherwise(0)).cast("long").alias("own"))
    scored = plain.union(hex_scores(strings).select(*key, F.col("score").cast("long"))).union(regex_scores(strings).select(*key, F.col("score").cast("long")))
    out = strings.select(*key, "kind", F.size("mods").alias("m")).join(scored, key).withColumn("complexity", F.col("own") + F.col("m") + 1)
    return out.select(*key, "kind", "complexity", F.when(F.col("complexity") <= 3, "low").when(F.col("complexity") <= 6, "medium").otherwise("high").alias("level"))


def pattern_statistics(strings: DataFrame) -> DataFrame:
    """One row: patterns by kind and by level of complexity, and their lengths."""
    c = pattern_complexity(strings).agg(*[F.count_if(F.col("level") == x).alias(f"n_{x}") for x in ("low", "medium", "high")])
    s = strings.agg(F.count("*").alias("n_patterns"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("plain", "hex", "regex")], F.min("length").alias("min_length"), F.max("length").alias("max_length"))
    return s.crossJoin(c)


def similar_patterns(strings: DataFrame) -> DataFrame:
    """(group, n, members): plain strings by length, hex strings by share of wildcards, regular expressions."""
    ratio = hex_scores(strings).select("rule", "sid", "wildcard_ratio")
    s = strings.join(ratio, ["rule", "sid"], "left")
    name = (
        F.when(F.col("kind") == "plain", F.when(F.col("length") < 10, "Short Plain").when(F.col("length") < 50, "Medium Plain").otherwise("Long Plain"))
        .when(F.col("kind") == "hex", F.when(F.col("wildcard_ratio") < 0.3, "Precise Hex").otherwise("Flexible Hex"))
        .otherwise("Regex")
    )
    return s.groupBy(name.alias("group")).agg(F.count("*").alias("n"))


# Lint


def optimisation_lint(rules: DataFrame, strings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rule, issue, severity, detail): strings that should be hex, contained strings, strings used often, deep conditions,
    shared values and rules of one form."""
    text = lambda c: c.cast("string")
    rows = lambda df, issue, severity, detail, rule=F.col("rule"): df.select(rule.alias("rule"), F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), text(detail).alias("detail"))
    odd = F.length(F.regexp_replace("value", r"[\x20-\x7e]", ""))
    parts = [
        rows(strings.filter("kind = 'plain'").filter(odd > F.length("value") * 0.3), "should_be_hex", "low", F.col("sid")),
        rows(C.contained(strings), "redundant_pattern", "low", F.col("inner_sid")),
        rows(strings.filter("kind = 'hex'").filter(F.size("tokens") > 4).withColumn("prefix", F.array_join(F.slice("tokens", 1, 4), " ")).filter("not prefix rlike '[?~(\\\\[]'").groupBy("rule", "prefix").agg(F.count("*").alias("n")).filter("n > 2"), "pattern_consolidation", "medium", F.col("prefix")),
        rows(rules.filter("depth > 4"), "condition_complexity", "medium", F.col("depth")),
        rows(strings.groupBy("kind", "value").agg(F.count_distinct("rule").alias("n")).filter("n > 2"), "duplication", "medium", F.col("n"), F.lit("global")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def performance_lint(strings: DataFrame) -> DataFrame:
    """Regular expressions are a warning, plain strings under 3 bytes a remark."""
    issue = F.when(F.col("kind") == "regex", F.struct(F.lit("expensive_regex").alias("issue"), F.lit("warning").alias("severity"))).when((F.col("kind") == "plain") & (F.col("length") < 3), F.struct(F.lit("short_string").alias("issue"), F.lit("info").alias("severity")))
    return strings.select("rule", "sid", issue.alias("i")).filter("i is not null").select("rule", "sid", "i.*")


def summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


# Graphs


def graph(parsed: DataFrame) -> DataFrame:
    """(kind, src, dst): files include files and import modules, define rules, and rules refer to rules."""
    ok = parsed.filter("error is null")
    each = lambda kind, src, dst: parsed.select(F.lit(kind).alias("kind"), F.col(src).alias("src"), F.explode(dst).alias("dst"))
    rules = ok.select(F.lit("defines").alias("kind"), F.col("path").alias("src"), F.col("name").alias("dst"))
    refs = ok.select(F.lit("refers").alias("kind"), F.col("name").alias("src"), F.explode("rule_refs").alias("dst"))
    return each("includes", "path", "includes").unionByName(each("imports", "path", "imports")).unionByName(rules).unionByName(refs).distinct()


def dependents(edges: DataFrame) -> DataFrame:
    """(dst, used_by, n_used_by): the neighbours of `neighbours`, seen from the other side."""
    return edges.groupBy("dst").agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("used_by"), F.count_distinct("src").alias("n_used_by"))


def graph_statistics(rules: DataFrame, edges: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    cycles = C.cyclic(edges).agg(F.count_distinct("cycle").alias("n_cycles"))
    return one(rules.select("rule"), "n_nodes").crossJoin(one(edges, "n_edges")).crossJoin(one(C.isolated(rules, edges), "n_isolated")).crossJoin(cycles)


def dot(graph_rows: DataFrame, name: str = "rules") -> DataFrame:
    """One row: the graph in DOT, edges in order; for graphs that a reader can look at."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = F.concat(F.lit("  "), quote(F.col("src")), F.lit(" -> "), quote(F.col("dst")), F.lit(' [label="'), F.col("kind"), F.lit('"];\n'))
    return graph_rows.agg(F.concat(F.lit(f"digraph {name} {{\n"), F.array_join(F.array_sort(F.collect_list(line)), ""), F.lit("}\n")).alias("dot"))


# Workspaces


def find_rule(parsed: DataFrame, name: str) -> DataFrame:
    return parsed.filter((F.col("name") == name) & F.col("error").isNull())


def workspace_report(parsed: DataFrame) -> DataFrame:
    """One row: files, rules, rules that cannot be read, names in several files."""
    conflicts = C.name_conflicts(parsed.filter("error is null")).agg(F.count("*").alias("n_conflicts"))
    return parsed.agg(F.count_distinct("path").alias("n_files"), F.count_if(F.col("error").isNull()).alias("n_rules"), F.count_if(F.col("error").isNotNull()).alias("n_errors")).crossJoin(conflicts)


def symbols(parsed: DataFrame) -> DataFrame:
    """(path, pos, rule, kind, name): rules, strings, meta keys and tags that files define."""
    ok = parsed.filter("error is null")
    each = lambda kind, names: ok.select("path", "pos", F.col("name").alias("rule"), F.lit(kind).alias("kind"), F.explode(names).alias("name"))
    return each("rule", F.array("name")).unionByName(each("string", F.transform("strings", lambda s: F.concat(F.lit("$"), s["sid"])))).unionByName(each("meta", F.map_keys("meta"))).unionByName(each("tag", F.col("tags")))


def references_to(parsed: DataFrame, name: str) -> DataFrame:
    """(path, pos, rule, kind): rules whose condition refers to a rule, or to a string with this name ($ first)."""
    ok = parsed.filter("error is null")
    if name.startswith("$"):
        hit = F.exists("refs", lambda r: (r["ref"] == name[1:]) | (r["ref"].endswith("*") & F.lit(name[1:]).startswith(F.rtrim(r["ref"], F.lit("*")))))
        return ok.filter(hit).select("path", "pos", F.col("name").alias("rule"), F.lit("string").alias("kind"))
    return ok.filter(F.array_contains("rule_refs", name)).select("path", "pos", F.col("name").alias("rule"), F.lit("rule").alias("kind"))


# Diffs


def parts_of(parsed: DataFrame) -> DataFrame:
    """(rule, path, pos, sign): the parts of each rule with a hash of their content; `pos` counts within the section."""
    ok = parsed.filter("error is null")
    sign = lambda *c: F.substring(F.sha2(F.to_json(F.struct(*c)), 256), 1, 16).alias("sign")
    none = F.lit(-1).alias("pos")
    one = lambda path, c: ok.select(F.col("name").alias("rule"), F.lit(path).alias("path"), none, sign(F.col(c).alias("x")))
    tags = ok.select("name", F.posexplode("tags").alias("pos", "t")).select(F.col("name").alias("rule"), F.concat(F.lit("tags."), "t").alias("path"), "pos", sign("t"))
    meta = ok.select("name", F.explode("meta").alias("k", "v")).select(F.col("name").alias("rule"), F.concat(F.lit("meta."), "k").alias("path"), none, sign("v"))
    strings = ok.select("name", F.posexplode("strings").alias("pos", "s")).select(F.col("name").alias("rule"), F.concat(F.lit("strings.$"), "s.sid").alias("path"), "pos", sign("s.kind", "s.value", "s.mods"))
    out = one("condition", "condition").unionByName(tags).unionByName(meta).unionByName(strings)
    return out.unionByName(one("is_private", "is_private")).unionByName(one("is_global", "is_global"))


def rule_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rule, path, change): parts ADDED, REMOVED, MODIFIED, or MOVED within their section; a whole rule has the path ''."""
    a, b = (parts_of(x) for x in (old, new))
    both = a.select("rule", "path", F.col("sign").alias("s1"), F.col("pos").alias("p1")).join(b.select("rule", "path", F.col("sign").alias("s2"), F.col("pos").alias("p2")), ["rule", "path"], "full_outer")
    change = F.when(F.col("s1").isNull(), "ADDED").when(F.col("s2").isNull(), "REMOVED").when(F.col("s1") != F.col("s2"), "MODIFIED").when(F.col("p1") != F.col("p2"), "MOVED")
    whole = a.select("rule", F.lit(1).alias("x")).distinct().join(b.select("rule", F.lit(1).alias("y")).distinct(), "rule", "full_outer").filter("x is null or y is null")
    own = both.select("rule", "path", change.alias("change")).filter("change is not null").join(whole.select("rule"), "rule", "left_anti")
    return own.unionByName(whole.select("rule", F.lit("").alias("path"), F.when(F.col("x").isNull(), "ADDED").otherwise("REMOVED").alias("change")))


def patch(changes: DataFrame) -> DataFrame:
    """One row: the changes as JSON, in order."""
    return changes.agg(F.to_json(F.array_sort(F.collect_list(F.struct("rule", "path", "change")))).alias("patch"))


def logic_or_style(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rule, change): 'logic' where the strings or the condition differ, 'style' where only the text does."""
    sign = lambda df, n: df.filter("error is null").select("name", F.md5(F.to_json(F.struct("is_private", "is_global", "condition", F.array_sort(F.transform("strings", lambda s: F.struct(s["sid"], s["kind"], s["value"], s["mods"])))))).alias(f"l{n}"), F.md5("text").alias(f"t{n}"))
    both = sign(old, 1).join(sign(new, 2), "name")
    return both.select(F.col("name").alias("rule"), F.when(F.col("l1") != F.col("l2"), "logic").when(F.col("t1") != F.col("t2"), "style").alias("change")).filter("change is not null")


def line_diff(a: str, b: str) -> list[str]:
    """Unified diff of two texts."""
    import difflib

    return list(difflib.unified_diff(a.splitlines(), b.splitlines(), "old", "new", lineterm=""))


# Comparing engines


def differential(blobs: DataFrame, rules: str, one, other, keys: list[str]) -> DataFrame:
    """(keys, rule, side): matches that only one of two engines finds; an engine is a function (blobs, rules) -> rows with `rule`."""
    a, b = (engine(blobs, rules).select(*keys, "rule").distinct() for engine in (one, other))
    return a.exceptAll(b).withColumn("side", F.lit("only_first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_second")))


# Batches

#: Operations on one parsed rule row; each gives a value that JSON can hold.
OPERATIONS = {
    "parse": lambda row: row["name"],
    "complexity": lambda row: row["cyclomatic"],
    "dependency_graph": lambda row: list(row["rule_refs"] or []),
    "html_tree": lambda row: html_tree(row),
    "serialize": lambda row: {k: row[k] for k in ("name", "tags", "meta", "condition")},
    "validate": lambda row: bool(row["name"] and row["condition"]),
}


def html_tree(row: dict) -> str:
    """A rule as nested lists."""
    import html

    item = lambda text, inner="": f"<li>{html.escape(str(text))}{inner}</li>"
    listed = lambda items: f"<ul>{''.join(items)}</ul>" if items else ""
    strings = [item(f"${s['sid']} {s['kind']}: {s['value']}") for s in row["strings"] or []]
    return listed([item(f"rule {row['name']}", listed([item("strings", listed(strings)), item("condition", listed([item(row["condition"])]))]))])


def batch(files: DataFrame, operations: list, timeout: float | None = None) -> DataFrame:
    """(path, name, operation, ok, error, result): operations over all rules, which are parsed once for all of them.

    An operation is a name of OPERATIONS or a function of a parsed row; a failure is a row, and so is one that takes
    longer than `timeout` seconds.  Results are JSON.
    """
    import pandas as pd

    from rulespark.sources.rules import rule_rows

    named = [(o, OPERATIONS[o]) if isinstance(o, str) else (getattr(o, "__name__", "custom"), o) for o in operations]
    columns = ["path", "name", "operation", "ok", "error", "result"]

    def run(batches):
        for frame in batches:
            rows = []
            for path, text in zip(frame["path"], frame["text"]):
                for row in rule_rows(path, text):
                    for name, operation in named:
                        ok, error, result = False, row["error"], None
                        if error is None:
                            try:
                                result, ok = json.dumps(limited(operation, row, timeout), default=str), True
                            except Exception as e:  # a user's function may raise anything; the row says what
                                error = f"{type(e).__name__}: {e}"
                        rows.append((path, row["name"], name, ok, error, result))
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "text").mapInPandas(run, "path string, name string, operation string, ok boolean, error string, result string")


def limited(function, argument, seconds: float | None):
    """function(argument), or TimeoutError after so many seconds."""
    if seconds is None:
        return function(argument)
    import threading

    out: list = []

    def call():
        try:
            out.append((True, function(argument)))
        except Exception as e:
            out.append((False, e))

    thread = threading.Thread(target=call, daemon=True)
    thread.start()
    thread.join(seconds)
    if not out:
        raise TimeoutError(f"more than {seconds} s")
    ok, value = out[0]
    if not ok:
        raise value
    return value


def batch_result(rows: DataFrame) -> DataFrame:
    """Per operation: input_count, successful_count, failed_count, success_rate in percent."""
    out = rows.groupBy("operation").agg(F.count("*").alias("input_count"), F.count_if("ok").alias("successful_count"))
    return out.select("operation", "input_count", "successful_count", (F.col("input_count") - F.col("successful_count")).alias("failed_count"), F.round(F.col("successful_count") * 100.0 / F.col("input_count"), 6).alias("success_rate"))
