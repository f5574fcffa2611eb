"""Event rules as DataFrame plans.

events -> one filtered projection for each event variable; match -> window and keys; outcome -> aggregates;
condition -> a filter over them.  Variables that share only match keys are counted side by side in one
aggregation (one shuffle, no join, so nothing is multiplied); others are joined on their shared placeholders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespark.functions.registry import FUNCTIONS
from rulespark.plans.event_rule import AGGREGATES, EventRule, event_variables, parse, text_of, walk
from rulespark.plans.lexer import RuleError


@dataclass
class Binding:
    """How field paths of event variables read a table."""

    table: DataFrame
    fields: dict[str, Callable[[DataFrame], Column] | str]
    id: str
    time: str
    lists: dict[str, DataFrame] = field(default_factory=dict)

    def column(self, path: tuple) -> Column:
        names, rest = [], list(path)
        while rest and isinstance(rest[0], str):
            names.append(rest.pop(0))
        # parts of a time: whole seconds since the epoch, rounded down, and the nanoseconds after them
        part = names[-1] if names[-1:] in (["seconds"], ["nanos"]) and ".".join(names) not in self.fields else None
        key = ".".join(names[:-1] if part else names)
        if rest and f"{key}[]" in self.fields:
            out = self.fields[f"{key}[]"](rest.pop(0)[1])
        elif key in self.fields:
            how = self.fields[key]
            out = F.col(how) if isinstance(how, str) else how()
        else:
            raise RuleError(f"no column for the field {key}")
        for kind, x in rest:
            out = out[x] if kind == "key" else F.get(out, F.lit(x))
        if part == "seconds":
            return F.unix_seconds(out.cast("timestamp"))
        return F.pmod(F.unix_micros(out.cast("timestamp")), F.lit(1_000_000)) * 1000 if part else out


def security_events(events: DataFrame, lists: dict[str, DataFrame] | None = None) -> Binding:
    """The `events` table under the event model's names."""
    return Binding(events, {
        "metadata.id": "event_id", "metadata.event_timestamp": "ts", "metadata.event_type": "event_type", "principal.user.userid": "user_id",
        "network.sent_bytes": "value", "additional.props": "props", "additional.fields[]": lambda k: F.get_json_object("props", f"$.{k}").try_cast("bigint"),
    }, "event_id", "ts", lists or {})


class Compiler:
    def __init__(self, rule: EventRule, binding: Binding | dict[str, Binding]):
        self.rule, self.names = rule, event_variables(rule)
        self.bindings = binding if isinstance(binding, dict) else {n: binding for n in self.names}
        self.lists = {k: v for b in self.bindings.values() for k, v in b.lists.items()}
        self.fold = rule.options.get("case_sensitive") is False
        self.placeholders: dict[str, list[tuple[str, tuple]]] = {}  # name -> [(variable, expression)]
        self.local: dict[str, list] = {n: [] for n in self.names}
        self.cross: list = []
        self.followed: list[tuple[str, str]] = []
        for node in rule.events:
            for part in self.conjuncts(node):
                self.place(part)

    @staticmethod
    def conjuncts(node):
        if node[0] == "bin" and node[1] == "and":
            yield from Compiler.conjuncts(node[2])
            yield from Compiler.conjuncts(node[3])
        else:
            yield node

    def variables(self, node) -> set[str]:
        out = set()
        for n in walk(node):
            if n[0] == "field":
                out.add(n[1] or self.names[0])
            elif n[0] == "var" and n[1] in self.placeholders:
                out |= {v for v, _ in self.placeholders[n[1]][:1]}
        return out

    def place(self, node) -> None:
        if node[0] == "followed":
            self.followed.append((node[1], node[2]))
            return
        if node[0] == "bin" and node[1] == "==":
            for a, b in ((node[2], node[3]), (node[3], node[2])):
                if a[0] == "var" and a[1] not in self.names and b[0] != "lit" and len(own := self.variables(b)) == 1:
                    variable = own.pop()
                    same = [v for v, _ in self.placeholders.get(a[1], []) if v == variable]
                    if not same:
                        self.placeholders.setdefault(a[1], []).append((variable, b))
                        return
        own = self.variables(node)
        (self.local[own.pop()] if len(own) == 1 else self.cross).append(node)

    # expressions: fields are columns named variable__path, placeholders variable__$name
    def value(self, node, get) -> Column:
        kind = node[0]
        if kind in ("field", "var", "count"):
            return get(node)
        if kind == "lit":
            return F.lit(node[1])
        if kind == "nocase":
            inner = node[1]
            if inner[0] == "bin":
                return self.value(("bin", inner[1], ("call", "strings.to_lower", [inner[2]]), ("call", "strings.to_lower", [inner[3]])), get)
            if inner[0] == "match":
                return self.match(inner, get, True)
            if inner[0] == "call" and inner[1] == "re.regex":
                return self.match(("match", inner[2][0], ("regex", inner[2][1][1], True), False), get, True)
            return self.value(inner, get)
        if kind == "not":
            return ~self.value(node[1], get)
        if kind == "neg":
            return -self.value(node[1], get)
        if kind == "null":
            out = self.value(node[1], get)
            return out.isNotNull() if node[2] else out.isNull()
        if kind == "match":
            return self.match(node, get, False)
        if kind == "if":
            yes = self.value(node[2], get)
            out = F.when(self.value(node[1], get), yes)
            return out.otherwise(self.value(node[3], get)) if node[3] else out
        if kind == "in":
            if node[2][0] != "list":
                raise RuleError("`in` needs a reference list")
            name = node[2][1]
            found = F.coalesce(F.col(f"in__{name.replace('.', '_')}__{self.key(node[1])}"), F.lit(False))
            return ~found if node[3] else found
        if kind == "bin":
            op, a, b = node[1], self.value(node[2], get), self.value(node[3], get)
            if self.fold and op in ("==", "!=") and "lit" in (node[2][0], node[3][0]) and any(isinstance(x[1], str) for x in node[2:4] if x[0] == "lit"):
                a, b = F.lower(a), F.lower(b)
            return {"and": lambda: a & b, "or": lambda: a | b, "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / F.nullif(b, F.lit(0))}[op]()
        if kind == "of":
            return reduce(lambda x, y: x + y, [F.coalesce(self.value(x, get).cast("int"), F.lit(0)) for x in node[2]]) >= node[1]
        if kind == "call":
            if node[1] not in FUNCTIONS:
                raise RuleError(f"unknown function {node[1]}")
            return FUNCTIONS[node[1]](*[x[1] if x[0] in ("lit", "regex") else self.value(x, get) for x in node[2]])
        raise RuleError(f"no value for {kind}")

    def match(self, node, get, nocase) -> Column:
        pattern = node[2][1]
        nocase = nocase or self.fold or node[2][0] == "regex" and node[2][2]
        out = self.value(node[1], get).cast("string").rlike(("(?i)" if nocase else "") + pattern)
        return ~out if node[3] else out

    @staticmethod
    def key(node) -> str:
        return hashlib.md5(text_of(node).encode()).hexdigest()[:8]

    def with_lists(self, df: DataFrame, nodes, get) -> tuple[DataFrame, list]:
        """Reference lists: semi and anti joins for conjuncts, a marked left join inside other expressions."""
        rest = []
        for node in nodes:
            if node[0] == "in" and node[2][0] == "list":
                values = self.list_values(node[2][1])
                df = df.withColumn("_in", self.value(node[1], get).cast("string")).join(values, F.col("_in") == values["_value"], "left_anti" if node[3] else "left_semi").drop("_in")
                continue
            for n in walk(node):
                if n[0] == "in" and (mark := f"in__{n[2][1].replace('.', '_')}__{self.key(n[1])}") not in df.columns:
                    values = self.list_values(n[2][1]).withColumn(mark, F.lit(True)).withColumnRenamed("_value", mark + "_v")
                    df = df.join(values, self.value(n[1], get).cast("string") == F.col(mark + "_v"), "left").drop(mark + "_v")
            rest.append(node)
        return df, rest

    def list_values(self, name: str) -> DataFrame:
        base, _, column = name.partition(".")
        if base not in self.lists:
            raise RuleError(f"unknown reference list {base}")
        df = self.lists[base]
        return df.select(df[column or df.columns[0]].cast("string").alias("_value")).distinct()

    def source(self, name: str) -> DataFrame:
        """Filtered rows of one event variable: its fields, placeholders, id and time."""
        binding = self.bindings[name]

        def get(node):
            if node[0] == "field":
                return binding.column(node[2])
            for variable, expression in self.placeholders.get(node[1], []):
                if variable == name:
                    return self.value(expression, get)
            raise RuleError(f"${node[1]} is not bound to ${name}")

        df, rest = self.with_lists(binding.table, self.local[name], get)
        for node in rest:
            df = df.filter(self.value(node, get))
        columns = {f"{name}__id": F.col(binding.id), f"{name}__ts": F.col(binding.time)}
        everything = [*self.cross, *(j[3] for j in self.rule.joins), *(g for _, g in self.rule.match if g), *(e for _, e in self.rule.outcome), self.rule.condition]
        for part in everything:
            for n in walk(part):
                if n[0] == "field" and (n[1] or self.names[0]) == name:
                    columns[self.field(n)] = binding.column(n[2])
        for placeholder, bound in self.placeholders.items():
            for variable, expression in bound:
                if variable == name:
                    columns[f"{name}__${placeholder}"] = self.value(expression, get)
        return df.select(*[c.alias(k) for k, c in columns.items()])

    def field(self, node) -> str:
        return f"{node[1] or self.names[0]}__" + "_".join(s if isinstance(s, str) else str(s[1]) for s in node[2])

    def joined(self, node) -> Column:
        """Get for rows that hold several variables."""
        if node[0] == "field":
            return F.col(f"`{self.field(node)}`")
        if node[0] == "var" and node[1] in self.placeholders:
            return F.col(f"`{self.placeholders[node[1]][0][0]}__${node[1]}`")
        raise RuleError(f"unknown variable {node[1]}")

    def key_column(self, name: str, grouping, variable: str | None = None) -> Column | None:
        if grouping:
            return self.value(grouping, self.joined) if variable is None or variable in self.variables(grouping) else None
        for v, _ in self.placeholders.get(name, []):
            if variable in (None, v):
                return F.col(f"`{v}__${name}`")
        return None

    def window(self, time: Column, df: DataFrame, name: str) -> Column:
        w = self.rule.window
        if df.schema[name].dataType.typeName() != "timestamp":  # a cast would hide a stream's watermark
            time = time.cast("timestamp")
        return F.window(time, w.text, f"{w.slide[0]} {w.slide[1]}" if w.slide else None)

    def side_by_side(self) -> bool:
        keys = {n for n, _ in self.rule.match}
        shared = {p for p, bound in self.placeholders.items() if len(bound) > 1}
        grouped = all(self.key_column(n, g, v) is not None for n, g in self.rule.match for v in self.names)
        return not self.cross and not self.rule.joins and not self.followed and shared <= keys and grouped and not (self.rule.window and self.rule.window.anchor) and bool(self.rule.match)

    def compile(self) -> DataFrame:
        rule = self.rule
        if self.side_by_side():
            parts = []
            for name in self.names:
                df = self.source(name)
                keys = [self.key_column(n, g, name).alias(n) for n, g in rule.match]
                own = [F.col(f"`{c}`") for c in df.columns]
                parts.append(df.select(*own, self.window(F.col(f"{name}__ts"), df, f"{name}__ts").alias("_w"), *keys))
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        else:
            rows = self.join_all()
            if rule.match:
                keys = [self.key_column(n, g) for n, g in rule.match]
                for (n, _), k in zip(rule.match, keys):
                    if k is None:
                        raise RuleError(f"match variable ${n} is not bound")
                time = F.col(f"`{self.names[0]}__ts`")
                if rule.window.anchor:
                    start = F.col(f"`{rule.window.anchor[1]}__ts`").cast("timestamp")
                    length = F.expr(f"interval {rule.window.text}")
                    w = F.struct(start.alias("start"), (start + length).alias("end")) if rule.window.anchor[0] == "after" else F.struct((start - length).alias("start"), start.alias("end"))
                else:
                    w = self.window(time, rows, f"{self.names[0]}__ts")
                rows = rows.select("*", w.alias("_w"), *[k.alias(n) for (n, _), k in zip(rule.match, keys)])
        if rule.match:
            keys = ["_w", *(n for n, _ in rule.match)]
        else:
            keys = [f"`{n}__id`" for n in self.names]
        return self.finish(rows, keys)

    def join_all(self) -> DataFrame:
        """Rows with all variables: equal placeholders, explicit joins, time order and other predicates."""
        rule, w = self.rule, self.rule.window
        sources = {n: self.source(n) for n in self.names}
        kinds = {right: (kind, condition) for kind, _, right, condition in rule.joins}
        rows, have = sources[self.names[0]], [self.names[0]]
        cross = list(self.cross)
        for name in self.names[1:]:
            on = []
            for placeholder, bound in self.placeholders.items():
                own = [v for v, _ in bound if v == name]
                other = [v for v, _ in bound if v in have]
                if own and other:
                    on.append(F.col(f"`{other[0]}__${placeholder}`") == F.col(f"`{name}__${placeholder}`"))
            kind, condition = kinds.get(name, ("inner", None))
            if condition:
                on.append(self.value(condition, self.joined))
            for node in [n for n in cross if self.variables(n) <= {*have, name}]:
                cross.remove(node)
                on.append(self.value(node, self.joined))
            ts = lambda v: F.col(f"`{v}__ts`").cast("timestamp")
            if rule.match and w.anchor and (w.anchor[1] in have or w.anchor[1] == name):
                for other in have if w.anchor[1] == name else [name]:
                    anchor, length = ts(w.anchor[1]), F.expr(f"interval {w.text}")
                    on.append((ts(other) > anchor) & (ts(other) <= anchor + length) if w.anchor[0] == "after" else (ts(other) < anchor) & (ts(other) >= anchor - length))
            elif rule.match and not w.slide and w.anchor is None and kind == "inner":
                # both in one tumbling window: an equi-join key
                slot = lambda v: F.floor(F.unix_micros(ts(v)) / (w.seconds * 1_000_000))
                on.append(slot(have[0]) == slot(name))
            for a, b in self.followed:
                if {a, b} <= {*have, name} and name in (a, b):
                    on.append(ts(a) < ts(b))
            right, spare = sources[name], []
            if rule.match and w.anchor and kind == "inner" and (w.anchor[1] in have or w.anchor[1] == name):
                # an interval of length w touches two slots of length w: the anchor goes to both, so time is an equi-join key
                slot = lambda v: F.floor(F.unix_micros(ts(v)) / (w.seconds * 1_000_000))
                step = 1 if w.anchor[0] == "after" else -1
                both = lambda v: F.explode(F.array(slot(v), slot(v) + step))
                spare = ["_slot_left", "_slot_right"]
                if w.anchor[1] == name:
                    rows, right = rows.withColumn(spare[0], slot(have[0])), right.withColumn(spare[1], both(name))
                else:
                    rows, right = rows.withColumn(spare[0], both(w.anchor[1])), right.withColumn(spare[1], slot(name))
                on.append(F.col(spare[0]) == F.col(spare[1]))
            if not on:
                raise RuleError(f"rule {rule.name}: nothing ties ${name} to the other events")
            rows = rows.join(right, reduce(lambda x, y: x & y, on), kind).drop(*spare)
            have.append(name)
        rows, rest = self.with_lists(rows, cross, self.joined)
        for node in rest:
            rows = rows.filter(self.value(node, self.joined))
        return rows

    def finish(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        rule = self.rule
        aggregates: dict[str, Column] = {}
        first = self.names[0]
        for n in self.names:
            aggregates[f"n_{n}"] = F.count_distinct(F.col(f"`{n}__id`")) if len(self.names) > 1 and not self.side_by_side() else F.count(F.col(f"`{n}__id`"))

        def aggregate(node) -> str:
            name = f"_a{self.key(node)}"
            if name not in aggregates:
                function, args = node[1], node[2]
                arg = args[0] if args else ("field", first, ("metadata", "id"))
                x = self.value(arg, self.joined)
                time_like = arg[0] == "field" and arg[2][-1] in ("event_timestamp", "ingested_timestamp", "seconds")
                owner = next(iter(sorted(self.variables(arg))), first)
                ts = F.col(f"`{owner}__ts`")
                aggregates[name] = {
                    "count": lambda: F.count(x), "count_distinct": lambda: F.count_distinct(x), "sum": lambda: F.sum(x), "avg": lambda: F.avg(x), "min": lambda: F.min(x), "max": lambda: F.max(x),
                    "array": lambda: F.array_sort(F.collect_list(x)), "array_distinct": lambda: F.array_sort(F.collect_set(x)),
                    "earliest": lambda: F.min(x) if time_like else F.min_by(x, ts), "latest": lambda: F.max(x) if time_like else F.max_by(x, ts),
                    "string_concat": lambda: F.array_join(F.array_sort(F.collect_list(x.cast("string"))), args[1][1] if len(args) > 1 else ","),
                }[function]()
            return name

        def lifted(node):
            """The node with aggregates replaced by their columns, and plain fields by their greatest value in the group."""
            if node[0] == "call" and node[1] in AGGREGATES:
                return ("column", aggregate(node))
            if node[0] == "field":
                return ("column", aggregate(("call", "max", [node])))
            if node[0] == "of":
                return ("of", node[1], [lifted(x) for x in node[2]])
            if node[0] == "call":
                return ("call", node[1], [lifted(x) for x in node[2]])
            return tuple(lifted(x) if isinstance(x, tuple) and x and isinstance(x[0], str) else x for x in node)

        def get(node):
            if node[0] == "count":
                return F.col(f"n_{node[1]}")
            if node[0] == "var":
                if node[1] in dict(rule.outcome) or node[1] in dict(rule.match):
                    return F.col(f"`{node[1]}`")
                if node[1] in self.names:
                    return F.col(f"n_{node[1]}") > 0
                if node[1] in self.placeholders:
                    return F.col(f"`{aggregate(('call', 'max', [node]))}`")
            raise RuleError(f"unknown variable {node[1]}")

        value = self.value
        self.value = lambda node, g: F.col(f"`{node[1]}`") if node[0] == "column" else value(node, g)  # type: ignore[method-assign]
        outcomes = [(n, lifted(e)) for n, e in rule.outcome]
        condition = lifted(rule.condition)
        for part in (*[e for _, e in outcomes], condition):
            for n in walk(part):
                if n[0] == "var" and n[1] in self.placeholders and n[1] not in dict(rule.match) and n[1] not in dict(rule.outcome):
                    aggregate(("call", "max", [n]))
        # outcome columns that are plain aggregates of one group
        out = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
        for n, e in outcomes:
            out = out.withColumn(n, self.value(e, get))
        out = out.filter(F.coalesce(self.value(condition, get), F.lit(False)))
        self.value = value  # type: ignore[method-assign]
        columns = []
        if rule.match:
            if rule.options.get("allow_zero_values") is False:
                for n, _ in rule.match:
                    out = out.filter(F.col(n).isNotNull() & ~F.col(n).cast("string").isin("", "0", "0.0"))
            columns += [F.col("_w.start").cast("timestamp_ntz").alias("window_start"), F.col("_w.end").cast("timestamp_ntz").alias("window_end"), *[F.col(n) for n, _ in rule.match]]
        else:
            columns += [F.col(f"`{n}__id`").alias(f"{n}_id") for n in self.names]
        columns += [F.col(f"`{n}`") for n, _ in rule.outcome] + [F.col(f"n_{n}") for n in self.names]
        out = out.select(F.lit(rule.name).alias("rule"), *columns)
        if limit := rule.options.get("max_matches") or rule.options.get("max_events") or rule.options.get("max_results"):
            order = [c for c, t in out.dtypes if not t.startswith(("array", "map"))]
            out = out.orderBy(*order).limit(int(limit))
        return out


def detect(text: str | EventRule, binding: Binding | dict[str, Binding]) -> DataFrame:
    """Detections of one event rule."""
    rule = parse(text)[0] if isinstance(text, str) else text
    return Compiler(rule, binding).compile()
