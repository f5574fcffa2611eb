"""Analytics over rules as data: usage, duplicates, similarity, complexity, dependencies, lint and diffs.

Inputs are tables: rules(rule, pos, file, is_private, is_global, n_tags, n_meta, depth, cyclomatic),
strings(rule, sid, kind, value, length, tokens, mods), refs(rule, ref, kind), edges(src, dst).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulespark.storage import stored

#: Parts of regular expressions that backtrack without end.  Fixed values.
SLOW_REGEXES = ("(.+)+", "(.+)*", "(.*)+", "(.+)?+", "([^x]+)+", "([^x]*)*")
#: Rounds after which a loop's tables are written and read again.
CUT = 8


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The analytic tables of parsed rule files; a name that occurs again gets #k."""
    ok = parsed.filter("error is null").withColumn("k", F.row_number().over(W.partitionBy("name").orderBy("path", "pos")))
    ok = ok.withColumn("rule", F.when(F.col("k") > 1, F.concat("name", F.lit("#"), F.col("k").cast("string"))).otherwise(F.col("name")))
    return {
        "rules": ok.select("rule", "name", "path", "pos", "dialect", "is_private", "is_global", "tags", "meta", "condition", "depth", "cyclomatic"),
        "strings": ok.select("rule", F.explode("strings").alias("s")).select("rule", "s.*"),
        "refs": ok.select("rule", F.explode("refs").alias("s")).select("rule", "s.*"),
        "edges": ok.select(F.col("rule").alias("src"), F.explode("rule_refs").alias("dst")).distinct(),
        "nodes": ok.select("rule", F.explode("nodes").alias("s")).select("rule", "s.*"),
    }


def used(strings: DataFrame, refs: DataFrame) -> DataFrame:
    """(rule, sid) of defined strings that a reference reaches, by name or by prefix."""
    r = refs.select(F.col("rule").alias("_r"), "ref")
    hit = (F.col("ref") == F.col("sid")) | (F.col("ref").endswith("*") & F.col("sid").startswith(F.expr("left(ref, length(ref) - 1)")))
    return strings.join(r, (strings["rule"] == F.col("_r")) & hit).select("rule", "sid").distinct()


def unused(strings: DataFrame, refs: DataFrame) -> DataFrame:
    return strings.select("rule", "sid").distinct().join(used(strings, refs), ["rule", "sid"], "left_anti")


def undefined(strings: DataFrame, refs: DataFrame) -> DataFrame:
    plain = refs.filter(~F.col("ref").endswith("*")).select("rule", F.col("ref").alias("sid")).distinct()
    return plain.join(strings.select("rule", "sid"), ["rule", "sid"], "left_anti")


def usage(rules: DataFrame, strings: DataFrame, refs: DataFrame) -> DataFrame:
    """Per rule: n_defined, n_used, n_unused, usage_rate (0 without strings)."""
    marked = strings.select("rule", "sid").distinct().join(used(strings, refs).withColumn("u", F.lit(1)), ["rule", "sid"], "left")
    counts = marked.groupBy("rule").agg(F.count("*").alias("n_defined"), F.count("u").alias("n_used"))
    out = rules.select("rule").join(counts, "rule", "left").na.fill(0)
    return out.select("rule", "n_defined", "n_used", (F.col("n_defined") - F.col("n_used")).alias("n_unused"), F.round(F.when(F.col("n_defined") > 0, F.col("n_used") / F.col("n_defined")).otherwise(0.0), 6).alias("usage_rate"))


def duplicates(values: DataFrame, value: str = "value") -> DataFrame:
    return values.groupBy(value).agg(F.count("*").alias("n")).filter("n > 1")


def shared(strings: DataFrame, value: str = "value", owner: str = "rule") -> DataFrame:
    """Values in more than one rule, with the rules."""
    return strings.groupBy(value).agg(F.array_join(F.array_sort(F.collect_set(owner)), ",").alias("owners"), F.count_distinct(owner).alias("n_owners")).filter("n_owners > 1")


def affixes(values: DataFrame, value: str = "value", suffix: bool = False, low: int = 3, high: int = 20) -> DataFrame:
    """Prefixes or suffixes of low..high characters that more than one value has."""
    lengths = F.sequence(F.lit(low), F.least(F.length(value), F.lit(high)))
    rows = values.filter(F.length(value) >= low).select(F.explode(lengths).alias("k"), F.col(value).alias("v"))
    return rows.groupBy((F.right("v", F.col("k")) if suffix else F.left("v", F.col("k"))).alias("affix")).agg(F.count("*").alias("n")).filter("n > 1")


def length_stats(values: DataFrame, length: str = "length") -> DataFrame:
    return values.agg(F.count("*").alias("n"), F.min(length).alias("min_length"), F.max(length).alias("max_length"), F.round(F.avg(length), 6).alias("avg_length"), F.round(F.median(length), 6).alias("median_length"))


def categories(strings: DataFrame) -> DataFrame:
    return strings.groupBy("kind").agg(F.count("*").alias("n"))


def modifiers(strings: DataFrame, top: int | None = None) -> DataFrame:
    out = strings.select(F.explode("mods").alias("modifier")).groupBy("modifier").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "modifier").limit(top) if top else out


def pooling(values: DataFrame, value: str = "value") -> DataFrame:
    """Bytes of all values and of the distinct ones; pooling pays above a ratio of 1.2."""
    one = values.groupBy(value).agg(F.count("*").alias("n")).select(F.octet_length(value).alias("b"), "n")
    out = one.agg(F.sum(F.col("b") * F.col("n")).alias("total_bytes"), F.sum("b").alias("pooled_bytes"))
    return out.withColumn("worth_pooling", F.col("total_bytes") > F.col("pooled_bytes") * 1.2)


def similar_names(strings: DataFrame) -> DataFrame:
    """Pairs of names of one rule at edit distance 1.

    Two such names have a form in common: themselves, or with one character left out; so a rule's names are not paired with
    each other but joined by these forms.
    """
    shorter = F.transform(F.sequence(F.lit(1), F.length("sid")), lambda k: F.concat(F.left("sid", k - 1), F.substring("sid", k + 1, F.length("sid"))))
    forms = F.array_distinct(F.concat(F.array("sid"), F.when(F.length("sid") > 0, shorter).otherwise(F.array().cast("array<string>"))))
    rows = strings.select("rule", "sid").select("rule", "sid", F.explode(forms).alias("form"))
    a, b = rows.select("rule", "form", F.col("sid").alias("a")), rows.select("rule", "form", F.col("sid").alias("b"))
    return a.join(b, ["rule", "form"]).filter("a < b").select("rule", "a", "b").distinct().filter(F.levenshtein("a", "b") == 1)


def contained(strings: DataFrame) -> DataFrame:
    """Plain strings of a rule inside others of it."""
    s = strings.filter("kind = 'plain'")
    a, b = s.select("rule", F.col("sid").alias("inner_sid"), F.col("value").alias("x")), s.select("rule", F.col("sid").alias("outer_sid"), F.col("value").alias("y"))
    return a.join(b, "rule").filter((F.col("inner_sid") != F.col("outer_sid")) & (F.length("x") < F.length("y")) & F.contains("y", "x")).select("rule", "inner_sid", "outer_sid")


def char_jaccard(strings: DataFrame) -> DataFrame:
    """Character-set similarity of the strings of a rule."""
    s = strings.select("rule", "sid", F.array_distinct(F.filter(F.split(F.lower("value"), ""), lambda c: c != "")).alias("c"))
    a, b = s.select("rule", F.col("sid").alias("a"), F.col("c").alias("x")), s.select("rule", F.col("sid").alias("b"), F.col("c").alias("y"))
    return a.join(b, "rule").filter("a < b").select("rule", "a", "b", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("similarity"))


def hex_prefixes(strings: DataFrame, tokens: int = 4) -> DataFrame:
    s = strings.filter((F.col("kind") == "hex") & (F.size("tokens") >= tokens)).withColumn("prefix", F.array_join(F.slice("tokens", 1, tokens), " "))
    return s.groupBy("prefix").agg(F.count("*").alias("n")).filter("n > 1")


def similar_rules(rules: DataFrame, strings: DataFrame, least: int = 4) -> DataFrame:
    """Groups of rules with equally many strings and the same condition."""
    counts = rules.join(strings.groupBy("rule").agg(F.count("*").alias("n_strings")), "rule", "left").na.fill({"n_strings": 0})
    return counts.groupBy("n_strings", "condition").agg(F.count("*").alias("n_rules")).filter(F.col("n_rules") >= least)


def complexity(rules: DataFrame) -> DataFrame:
    return rules.select("rule", "depth", "cyclomatic", F.when(F.col("cyclomatic") <= 3, "low").when(F.col("cyclomatic") <= 6, "medium").otherwise("high").alias("level"))


def complexity_distribution(rules: DataFrame) -> DataFrame:
    return complexity(rules).groupBy("level").agg(F.count("*").alias("n"))


def quality(rules: DataFrame, n_unused: DataFrame, complex_at: int = 10) -> DataFrame:
    """One row: score 0..100 and grade, by fixed penalties (fixed values) for depth, unused strings and complex rules."""
    totals = rules.agg(F.max("depth").alias("depth"), F.count("*").alias("n"), F.count_if(F.col("cyclomatic") > complex_at).alias("n_complex"), F.count_if(F.size(F.map_keys("meta")) > 0).alias("n_meta")).crossJoin(n_unused.agg(F.count("*").alias("n_unused")))
    score = (100.0 - F.when(F.col("depth") > 8, 20).when(F.col("depth") > 5, 10).otherwise(0) - F.least(F.lit(20), F.col("n_unused") * 5) - F.least(F.lit(25), F.col("n_complex") * 10) + F.when(F.col("n_meta") / F.greatest(F.col("n"), F.lit(1)) > 0.8, 5).otherwise(0))
    out = totals.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    return out.select("score", F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").when(F.col("score") >= 70, "C").when(F.col("score") >= 60, "D").otherwise("F").alias("grade"))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, depth): pairs joined by a path, with the length of the shortest."""
    found = frontier = stored(edges.select("src", "dst").distinct().withColumn("depth", F.lit(1)), "closure")
    step = found.select(F.col("src").alias("via"), "dst")
    depth = 1
    while True:
        depth += 1
        # a round reads the frontier twice, so each is written once
        frontier = stored(frontier.select("src", F.col("dst").alias("via")).join(step, "via").select("src", "dst").distinct().join(found, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if not frontier.limit(1).count():
            return found
        found = found.unionByName(frontier)
        if depth % CUT == 0:
            found = stored(found, "closure")


def cyclic(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves, with the smallest node of their cycle."""
    c = closure(edges)
    back = c.select(F.col("src").alias("b"), F.col("dst").alias("a"))
    both = c.join(back, (c["src"] == F.col("a")) & (c["dst"] == F.col("b")))
    return both.groupBy("src").agg(F.min("dst").alias("first")).select(F.col("src").alias("rule"), F.least("src", "first").alias("cycle"))


def levels(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """Topological level: 0 without dependencies, else 1 + the greatest of theirs; null in or above a cycle."""
    loops = cyclic(edges).select("rule")
    c = closure(edges)
    tainted = c.join(loops.withColumnRenamed("rule", "dst"), "dst", "left_semi").select(F.col("src").alias("rule")).union(loops).distinct()
    clean = edges.join(tainted.withColumnRenamed("rule", "src"), "src", "left_anti").select("src", "dst").distinct()
    longest = frontier = clean.select("src", F.lit(1).alias("level"), "dst")
    depth = 1
    while frontier.limit(1).count():
        depth += 1
        frontier = frontier.select("src", F.col("dst").alias("via")).join(clean.select(F.col("src").alias("via"), "dst"), "via").select("src", F.lit(depth).alias("level"), "dst").distinct()
        longest = longest.unionByName(frontier)
        if depth % CUT == 0:
            frontier, longest = stored(frontier, "frontier"), stored(longest, "longest")
    top = longest.groupBy("src").agg(F.max("level").alias("level"))
    out = rules.select("rule").join(top.withColumnRenamed("src", "rule"), "rule", "left").join(tainted.withColumn("bad", F.lit(True)), "rule", "left")
    return out.select("rule", F.when(F.col("bad").isNull(), F.coalesce("level", F.lit(0))).alias("level"))


def isolated(rules: DataFrame, edges: DataFrame) -> DataFrame:
    return rules.select("rule").join(edges.select(F.col("src").alias("rule")), "rule", "left_anti").join(edges.select(F.col("dst").alias("rule")), "rule", "left_anti")


def neighbours(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("uses"), F.count_distinct("dst").alias("n_uses"))


def name_conflicts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("name").agg(F.count_distinct("path").alias("n_files")).filter("n_files > 1")


def diff(old: DataFrame, new: DataFrame, key: str = "rule") -> DataFrame:
    """added, removed and modified rows by key; rows are compared by the hash of all their columns."""
    names = sorted(c for c in old.columns if c != key)
    sign = lambda d, n: d.select(key, F.sha2(F.to_json(F.struct(*names)), 256).alias(n))
    both = sign(old, "_o").join(sign(new, "_n"), key, "full_outer")
    return both.select(key, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "modified").alias("change")).filter("change is not null")


def lint(rules: DataFrame, strings: DataFrame) -> DataFrame:
    """(rule, sid, issue, severity)."""
    bad = F.array(*map(F.lit, SLOW_REGEXES))
    wild = F.size(F.filter("tokens", lambda t: t == "??"))
    of_strings = [
        ("short_string", "info", (F.col("kind") == "plain") & (F.col("length") < 4) & (F.size("mods") == 0)),
        ("pattern_characters", "info", (F.col("kind") == "plain") & F.col("value").rlike(r"[*?\[\]]")),
        ("many_wildcards", "warning", (F.col("kind") == "hex") & (wild > F.size("tokens") * 0.5)),
        ("unescaped_dot", "info", (F.col("kind") == "regex") & F.contains("value", F.lit(".")) & ~F.contains("value", F.lit("\\."))),
        ("catastrophic_regex", "warning", (F.col("kind") == "regex") & F.exists(bad, lambda b: F.contains("value", b))),
    ]
    found = strings.select("rule", "sid", F.explode(F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("issue"), F.lit(level).alias("severity"))) for name, level, test in of_strings]))).alias("i")).select("rule", "sid", "i.*")
    names = rules.select("rule", F.lit(None).cast("string").alias("sid"), F.explode(F.array_compact(F.array(
        F.when(~F.col("name").rlike("^[a-zA-Z][a-zA-Z_]*$"), F.struct(F.lit("rule_name").alias("issue"), F.lit("warning").alias("severity"))),
        F.when(F.length("name") < 3, F.struct(F.lit("short_rule_name").alias("issue"), F.lit("info").alias("severity"))),
    ))).alias("i")).select("rule", "sid", "i.*")
    return found.unionByName(names)


def costs(strings: DataFrame) -> DataFrame:
    """Cost to check a string: its length; 100 more for hex, by tokens, 200 more for a regular expression."""
    return strings.select("rule", "sid", F.when(F.col("kind") == "plain", F.col("length")).when(F.col("kind") == "hex", F.size("tokens") + 100).otherwise(F.length("value") + 200).alias("cost"))


def manifest(rules: DataFrame, strings: DataFrame) -> DataFrame:
    counts = strings.groupBy("rule").agg(F.count("*").alias("n_strings"))
    return rules.join(counts, "rule", "left").select("rule", "is_private", "is_global", F.array_join("tags", ",").alias("tags"), F.size(F.map_keys("meta")).alias("n_meta"), F.coalesce("n_strings", F.lit(0)).alias("n_strings"))


def totals(rules: DataFrame, strings: DataFrame) -> DataFrame:
    s = strings.agg(F.count("*").alias("n_strings"), F.count_if(F.col("kind") == "plain").alias("n_plain"), F.count_if(F.col("kind") == "hex").alias("n_hex"), F.count_if(F.col("kind") == "regex").alias("n_regex"))
    return rules.agg(F.count("*").alias("n_rules"), F.count_if("is_private").alias("n_private"), F.count_if("is_global").alias("n_global"), F.round(F.avg("depth"), 6).alias("avg_depth"), F.max("depth").alias("max_depth")).crossJoin(s)
