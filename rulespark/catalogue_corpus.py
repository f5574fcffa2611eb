"""Queries over rules as data, and the same operators over tables; each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.operators import corpus as C
from rulespark.sources.rules import parse_files, resolve_includes, rule_rows

QUERIES: dict = {}
ORACLES: dict = {}

FILES = [
    ("main.rules", r'''include "base.rules"
import "math"
rule dropper : loader win { meta: author = "ops" level = 3 strings: $mz = "MZ" $url = "http://example.test/a" nocase $url2 = "http://example.test/b" $hex = { 4D 5A ?? ?? 50 } $dead = "never used"
 condition: $mz at 0 and any of ($url*) and #hex > 1 and base_check }
rule loader { meta: author = "ops" strings: $a = "load" $aa = "loader" wide $re = /(.+)+x/ condition: for any of them : (# > 1) or dropper or missing_ok and $zz }
private rule helper { strings: $x = "http://example.test/a" condition: $x or filesize > 10KB and filesize < 20KB }
rule cycle_a { condition: cycle_b and filesize > 1 }
rule cycle_b { condition: cycle_a or helper }
'''),
    ("base.rules", r'''include "more.rules"
rule base_check { meta: author = "qa" strings: $s1 = "alpha beta" $s2 = "alpha gamma" $s3 = "zeta" condition: 2 of ($s*) }
global rule gate { condition: filesize > 0 }
rule x1 { strings: $h1 = { 4D 5A ?? ?? 51 } $h2 = { ?? ?? ?? 41 } condition: all of them }
rule broken { strings: $a = "x condition: }
'''),
    ("more.rules", r'''include "main.rules"
rule helper { strings: $x = "other" fullword $y = "a.b*c" condition: $x and not $y }
rule same_1 { condition: filesize == 7 }
rule same_2 { condition: filesize == 7 }
rule same_3 { condition: filesize == 7 }
rule same_4 { condition: filesize == 7 }
'''),
]


def rules(spark: SparkSession) -> dict[str, DataFrame]:
    return C.tables(parse_files(spark.createDataFrame(FILES, "path string, text string")))


def literal(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]::varchar[]"
    return "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def values() -> str:
    """The normalised rows as a prelude for the SQL."""
    rows = [r for path, text in FILES for r in rule_rows(path, text) if r["error"] is None]
    seen: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (r["name"], r["path"], r["pos"])):
        seen[r["name"]] = seen.get(r["name"], 0) + 1
        r["rule"] = r["name"] + (f"#{seen[r['name']]}" if seen[r["name"]] > 1 else "")
    table = lambda name, cols, data: f"{name}({cols}) as (values " + ", ".join("(" + ", ".join(map(literal, d)) + ")" for d in data) + ")"
    return "with recursive " + ", ".join([
        table("rules", "rule, name, path, pos, is_private, is_global, tags, n_meta, condition, depth, cyclomatic", [(r["rule"], r["name"], r["path"], r["pos"], r["is_private"], r["is_global"], ",".join(r["tags"]), len(r["meta"]), r["condition"], r["depth"], r["cyclomatic"]) for r in rows]),
        table("strings", "rule, sid, kind, value, length, tokens, mods", [(r["rule"], s["sid"], s["kind"], s["value"], s["length"], s["tokens"], s["mods"]) for r in rows for s in r["strings"]]),
        table("refs", "rule, ref, kind", [(r["rule"], s["ref"], s["kind"]) for r in rows for s in r["refs"]]),
        table("edges", "src, dst", sorted({(r["rule"], d) for r in rows for d in r["rule_refs"]})),
    ])


V = values()
USED = "used as (select distinct s.rule, s.sid from strings s join refs r on s.rule = r.rule and (r.ref = s.sid or r.ref like '%*' and starts_with(s.sid, left(r.ref, length(r.ref) - 1))))"
REACH = "reach as (select src, dst from edges union select r.src, e.dst from reach r join edges e on e.src = r.dst)"


def add(name: str, make, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(**rules(spark))
    ORACLES[name] = f"{V}{sql}"


add("co_string_usage", lambda rules, strings, refs, **_: C.usage(rules, strings, refs), f", {USED}, d as (select rule, count(distinct sid) as n from strings group by rule), u as (select rule, count(*) as n from used group by rule) select r.rule, coalesce(d.n, 0) as n_defined, coalesce(u.n, 0) as n_used, coalesce(d.n, 0) - coalesce(u.n, 0) as n_unused, round(case when d.n > 0 then coalesce(u.n, 0) / d.n else 0 end, 6) as usage_rate from rules r left join d using (rule) left join u using (rule)")
add("co_unused", lambda strings, refs, **_: C.unused(strings, refs), f", {USED} select distinct rule, sid from strings anti join used using (rule, sid)")
add("co_undefined", lambda strings, refs, **_: C.undefined(strings, refs), " select distinct rule, ref as sid from refs r where ref not like '%*' and not exists (select 1 from strings s where s.rule = r.rule and s.sid = r.ref)")
add("co_duplicates", lambda strings, **_: C.duplicates(strings), " select value, count(*) as n from strings group by value having count(*) > 1")
add("co_prefixes", lambda strings, **_: C.affixes(strings.filter("kind = 'plain'")), " select left(value, k) as affix, count(*) as n from strings, range(3, 21) r(k) where kind = 'plain' and k <= length(value) group by all having count(*) > 1")
add("co_suffixes", lambda strings, **_: C.affixes(strings.filter("kind = 'plain'"), suffix=True), " select right(value, k) as affix, count(*) as n from strings, range(3, 21) r(k) where kind = 'plain' and k <= length(value) group by all having count(*) > 1")
add("co_length_stats", lambda strings, **_: C.length_stats(strings), " select count(*) as n, min(length) as min_length, max(length) as max_length, round(avg(length), 6) as avg_length, round(median(length), 6) as median_length from strings")
add("co_categories", lambda strings, **_: C.categories(strings), " select kind, count(*) as n from strings group by kind")
add("co_modifier_top3", lambda strings, **_: C.modifiers(strings, 3), " select m as modifier, count(*) as n from (select unnest(mods) as m from strings) group by m order by n desc, m limit 3")
add("co_shared_strings", lambda strings, **_: C.shared(strings), " select value, string_agg(distinct rule, ',' order by rule) as owners, count(distinct rule) as n_owners from strings group by value having count(distinct rule) > 1")
add("co_similar_rules", lambda rules, strings, **_: C.similar_rules(rules, strings), ", n as (select r.rule, r.condition, count(s.sid) as n_strings from rules r left join strings s using (rule) group by all) select n_strings, condition, count(*) as n_rules from n group by all having count(*) >= 4")
add("co_similar_names", lambda strings, **_: C.similar_names(strings), " select a.rule, a.sid as a, b.sid as b from strings a join strings b on a.rule = b.rule and a.sid < b.sid where levenshtein(a.sid, b.sid) = 1")
add("co_contained_strings", lambda strings, **_: C.contained(strings), " select a.rule, a.sid as inner_sid, b.sid as outer_sid from strings a join strings b on a.rule = b.rule and a.sid <> b.sid where a.kind = 'plain' and b.kind = 'plain' and length(a.value) < length(b.value) and contains(b.value, a.value)")
add("co_jaccard", lambda strings, **_: C.char_jaccard(strings), ", c as (select rule, sid, list_distinct(string_split(lower(value), '')) as c from strings) select x.rule, x.sid as a, y.sid as b, round(len(list_intersect(x.c, y.c)) / len(list_distinct(list_concat(x.c, y.c))), 6) as similarity from c x join c y on x.rule = y.rule and x.sid < y.sid")
add("co_hex_prefixes", lambda strings, **_: C.hex_prefixes(strings), " select array_to_string(tokens[1:4], ' ') as prefix, count(*) as n from strings where kind = 'hex' and len(tokens) >= 4 group by all having count(*) > 1")
add("co_cyclomatic", lambda rules, **_: C.complexity(rules), " select rule, depth, cyclomatic, case when cyclomatic <= 3 then 'low' when cyclomatic <= 6 then 'medium' else 'high' end as level from rules")
add("co_complexity_distribution", lambda rules, **_: C.complexity_distribution(rules), " select case when cyclomatic <= 3 then 'low' when cyclomatic <= 6 then 'medium' else 'high' end as level, count(*) as n from rules group by all")
add("co_quality_grade", lambda rules, strings, refs, **_: C.quality(rules, C.unused(strings, refs)), f", {USED}, t as (select (select max(depth) from rules) as d, (select count(*) from (select distinct rule, sid from strings anti join used using (rule, sid))) as u, (select count(*) from rules where cyclomatic > 10) as c, (select count(*) filter (n_meta > 0) / count(*) from rules) as m), s as (select greatest(0.0, least(100.0, 100.0 - case when d > 8 then 20 when d > 5 then 10 else 0 end - least(20, u * 5) - least(25, c * 10) + case when m > 0.8 then 5 else 0 end))::double as score from t) select score, case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 70 then 'C' when score >= 60 then 'D' else 'F' end as grade from s")
add("co_dep_edges", lambda edges, **_: C.neighbours(edges), " select src, string_agg(distinct dst, ',' order by dst) as uses, count(distinct dst) as n_uses from edges group by src")
add("co_dep_closure", lambda edges, **_: C.closure(edges).select("src", "dst"), f", {REACH} select src, dst from reach")
add("co_cycles", lambda edges, **_: C.cyclic(edges), f", {REACH} select a.src as rule, min(least(a.src, a.dst)) as cycle from reach a join reach b on a.src = b.dst and a.dst = b.src group by a.src")
add("co_isolated", lambda rules, edges, **_: C.isolated(rules, edges), " select rule from rules where rule not in (select src from edges) and rule not in (select dst from edges)")
add("co_topo_level", lambda rules, edges, **_: C.levels(rules, edges), f", {REACH}, loops as (select src from reach where src = dst), bad as (select src from reach where dst in (select src from loops) union select src from loops), p as (select src, dst, 1 as l from edges where src not in (select src from bad) union select p.src, e.dst, p.l + 1 from p join edges e on e.src = p.dst) select r.rule, case when r.rule in (select src from bad) then null else coalesce((select max(l) from p where p.src = r.rule), 0) end as level from rules r")
add("co_name_conflicts", lambda rules, **_: C.name_conflicts(rules), " select name, count(distinct path) as n_files from rules group by name having count(distinct path) > 1")
add("co_lint", lambda rules, strings, **_: C.lint(rules, strings), ", b as (select unnest([" + ", ".join(f"'{x}'" for x in C.SLOW_REGEXES) + """]) as p)
 select rule, sid, 'short_string' as issue, 'info' as severity from strings where kind = 'plain' and length < 4 and len(mods) = 0
 union all select rule, sid, 'pattern_characters', 'info' from strings where kind = 'plain' and regexp_matches(value, '[*?\\[\\]]')
 union all select rule, sid, 'many_wildcards', 'warning' from strings where kind = 'hex' and len(list_filter(tokens, lambda t: t = '??')) > len(tokens) * 0.5
 union all select rule, sid, 'unescaped_dot', 'info' from strings where kind = 'regex' and contains(value, '.') and not contains(value, '\\.')
 union all select rule, sid, 'catastrophic_regex', 'warning' from strings where kind = 'regex' and exists (select 1 from b where contains(value, p))
 union all select rule, null, 'rule_name', 'warning' from rules where not regexp_matches(name, '^[a-zA-Z][a-zA-Z_]*$')
 union all select rule, null, 'short_rule_name', 'info' from rules where length(name) < 3""".replace("\\\\", "\\"))
add("co_cost_order", lambda strings, **_: C.costs(strings), " select rule, sid, case kind when 'plain' then length when 'hex' then 100 + len(tokens) else 200 + length(value) end as cost from strings")
add("co_manifest", lambda rules, strings, **_: C.manifest(rules, strings), " select r.rule, is_private, is_global, tags, n_meta, (select count(*) from strings s where s.rule = r.rule) as n_strings from rules r")
add("co_totals", lambda rules, strings, **_: C.totals(rules, strings), " select count(*) as n_rules, count(*) filter (is_private) as n_private, count(*) filter (is_global) as n_global, round(avg(depth), 6) as avg_depth, max(depth) as max_depth, (select count(*) from strings) as n_strings, (select count(*) from strings where kind = 'plain') as n_plain, (select count(*) from strings where kind = 'hex') as n_hex, (select count(*) from strings where kind = 'regex') as n_regex from rules")
add("co_pooling", lambda strings, **_: C.pooling(strings), " select sum(strlen(value) * n)::bigint as total_bytes, sum(strlen(value))::bigint as pooled_bytes, sum(strlen(value) * n) > sum(strlen(value)) * 1.2 as worth_pooling from (select value, count(*) as n from strings group by value)")
add("co_diff", lambda rules, **_: C.diff(rules.filter("path <> 'more.rules'").select("rule", "condition", "depth"), rules.filter("path <> 'base.rules'").select("rule", F.when(F.col("rule") == "loader", "changed").otherwise(F.col("condition")).alias("condition"), "depth")),
    ", o as (select rule, condition, depth from rules where path <> 'more.rules'), n as (select rule, case when rule = 'loader' then 'changed' else condition end as condition, depth from rules where path <> 'base.rules') select coalesce(o.rule, n.rule) as rule, case when o.rule is null then 'added' when n.rule is null then 'removed' else 'modified' end as change from o full join n on o.rule = n.rule where o.rule is null or n.rule is null or o.condition <> n.condition or o.depth <> n.depth")

QUERIES["co_includes"] = lambda spark, sf_dir: resolve_includes(spark.createDataFrame(FILES, "path string, text string"))
ORACLES["co_includes"] = "select * from (values ('main.rules', 'base.rules', 1), ('base.rules', 'more.rules', 1), ('more.rules', 'main.rules', 1), ('main.rules', 'more.rules', 2), ('base.rules', 'main.rules', 2), ('more.rules', 'base.rules', 2), ('main.rules', 'main.rules', 3), ('base.rules', 'base.rules', 3), ('more.rules', 'more.rules', 3)) v(src, dst, depth)"
QUERIES["co_parse_errors"] = lambda spark, sf_dir: parse_files(spark.createDataFrame(FILES, "path string, text string")).filter("error is not null").select("path", "name")
ORACLES["co_parse_errors"] = "select 'base.rules' as path, 'broken' as name"


def over(name: str, make, sql: str) -> None:
    """The same operators over a table of the data set."""
    QUERIES[name] = make
    ORACLES[name] = sql


table = lambda spark, sf_dir, t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
over("co_document_duplicates", lambda s, d: C.duplicates(table(s, d, "documents"), "text"), "select text, count(*) as n from documents group by text having count(*) > 1")
over("co_document_shared", lambda s, d: C.shared(table(s, d, "documents").select("text", "source"), "text", "source"), "select text, string_agg(distinct source, ',' order by source) as owners, count(distinct source) as n_owners from documents group by text having count(distinct source) > 1")
over("co_part_prefixes", lambda s, d: C.affixes(table(s, d, "part"), "p_name"), "select left(p_name, k) as affix, count(*) as n from part, range(3, 21) r(k) where k <= length(p_name) group by all having count(*) > 1")
over("co_document_lengths", lambda s, d: C.length_stats(table(s, d, "documents"), "n_chars"), "select count(*) as n, min(n_chars) as min_length, max(n_chars) as max_length, round(avg(n_chars), 6) as avg_length, round(median(n_chars), 6) as median_length from documents")
over("co_document_pooling", lambda s, d: C.pooling(table(s, d, "documents"), "text"), "select sum(strlen(text) * n)::bigint as total_bytes, sum(strlen(text))::bigint as pooled_bytes, sum(strlen(text) * n) > sum(strlen(text)) * 1.2 as worth_pooling from (select text, count(*) as n from documents group by text)")
over("co_order_diff", lambda s, d: C.diff(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), table(s, d, "orders").filter("o_orderpriority <> '1-URGENT'").select("o_orderkey", F.lower("o_orderstatus").alias("o_orderstatus")), "o_orderkey"), "select o_orderkey, case when o_orderpriority = '1-URGENT' then 'removed' else 'modified' end as change from orders where o_orderpriority = '1-URGENT' or lower(o_orderstatus) <> o_orderstatus")
