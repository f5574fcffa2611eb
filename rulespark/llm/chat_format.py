"""Chat formatting by schema fingerprints, in built-in expressions only.

A record's layout is the sorted list of its nested field paths, of those that some mapping names (other fields,
as ids or dates, do not count); the hash of that list selects a declarative mapping (paths of user, assistant and
system text, or of a list of messages) into canonical turns.  Records with fields of several mappings, for which
no list is known, take the mapping with the most paths of which none is missing.  JSON records are fingerprinted
one by one through the schema of their variant; a table of turns by its own schema.

Template: a turn is `<|role|>\\n`, the escaped text, `<|end|>\\n`.  Inside texts and roles `&` becomes `&amp;` and
`<` becomes `&lt;`, and in roles `|` becomes `&#124;`, so a control string can only come from the template, and
undoing them gives the text back.
The loss mask covers assistant texts.

Turns of one conversation are joined in two steps, by runs of turn numbers and then by conversation, so that a
very long conversation is not gathered row by row in one task.

Defined cases: a null text or role is empty; rows of one conversation go by turn, then role, then text, a null
turn first; repeated rows are turns of their own; null conversation ids form one conversation with a null id;
extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Turns whose numbers share a quotient by this are joined first.
RUN = 64
#: Canonical layouts: field paths -> mapping.  `list` names an array of turns, `role` and `text` its fields;
#: `turns` lists (role, path) of single fields.
LAYOUTS = {
    ("messages[].content", "messages[].role"): {"list": "messages", "role": "role", "text": "content"},
    ("conversations[].from", "conversations[].value"): {"list": "conversations", "role": "from", "text": "value"},
    ("prompt", "response"): {"turns": (("user", "prompt"), ("assistant", "response"))},
    ("completion", "prompt"): {"turns": (("user", "prompt"), ("assistant", "completion"))},
    ("answer", "question"): {"turns": (("user", "question"), ("assistant", "answer"))},
    ("instruction", "output"): {"turns": (("user", "instruction"), ("assistant", "output"))},
    ("input", "instruction", "output"): {"turns": (("user", "instruction"), ("user", "input"), ("assistant", "output"))},
    ("instruction", "output", "system"): {"turns": (("system", "system"), ("user", "instruction"), ("assistant", "output"))},
}
#: Tables with a row for each turn: field paths -> columns of role and text.
ROW_LAYOUTS = {("role", "text"): ("role", "text"), ("content", "role"): ("role", "content"), ("from", "value"): ("from", "value"), ("author", "body"): ("author", "body")}
#: Other names of roles.  Fixed values.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


def fingerprint(paths) -> str:
    import hashlib

    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()


def paths_of(variant: Column) -> Column:
    """Nested field paths of a variant's leaves: a list's elements count as `[]`."""
    tokens = F.regexp_extract_all(F.schema_of_variant(variant), F.lit(r"(?:`[^`]*`|[^\s<>:,`]+): |OBJECT<|ARRAY<|>"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("above"), F.lit("").alias("path"), F.array().cast("array<string>").alias("out"))
    but_last = lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))
    prefix = lambda a: F.coalesce(F.get(a["above"], F.size(a["above"]) - 1), F.lit(""))

    def step(a: Column, t: Column) -> Column:
        state = lambda above, path, out: F.struct(above.alias("above"), path.alias("path"), out.alias("out"))
        name = F.concat(prefix(a), F.replace(F.substring(t, F.lit(1), F.length(t) - 2), F.lit("`"), F.lit("")))
        inner = F.when(a["path"] == "", F.lit("")).otherwise(F.concat(a["path"], F.lit(".")))
        listed = F.concat(a["path"], F.lit("[]"))
        return (
            F.when(t == "OBJECT<", state(F.array_append(a["above"], inner), a["path"], but_last(a["out"])))
            .when(t == "ARRAY<", state(F.array_append(a["above"], listed), listed, F.array_append(but_last(a["out"]), listed)))
            .when(t == ">", state(but_last(a["above"]), a["path"], a["out"]))
            .otherwise(state(a["above"], name, F.array_append(a["out"], name)))
        )

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda a: a["out"])))


def paths_of_schema(kind, path: str = "") -> list[str]:
    """The same of a table's schema."""
    from pyspark.sql.types import ArrayType, StructType

    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in paths_of_schema(f.dataType, f"{path}.{f.name}" if path else f.name)]
    return paths_of_schema(kind.elementType, path + "[]") if isinstance(kind, ArrayType) else [path]


def most_paths(layouts) -> list[tuple[str, ...]]:
    return sorted(layouts, key=lambda paths: (-len(paths), paths))


def _item(how: dict, roles: Column, turn):
    role = lambda x: F.variant_get(x, "$." + how["role"], "string")
    return lambda x: turn(F.coalesce(roles[role(x)], role(x)), F.variant_get(x, "$." + how["text"], "string"))


def canonical(records: DataFrame, column: str = "record") -> DataFrame:
    """Add `layout` (fingerprint) and `turns` (array of role, text); null turns where no mapping is known."""
    rows = records.withColumn("_v", F.try_parse_json(F.col(column)))
    named = sorted({p for paths in LAYOUTS for p in paths})
    rows = rows.withColumn("_paths", F.filter(paths_of(F.col("_v")), lambda p: p.isin(named)))
    rows = rows.withColumn("layout", F.sha2(F.array_join("_paths", ","), 256))
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    role_map = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    turns = rest = F.lit(None).cast("array<struct<role:string,text:string>>")
    for paths in reversed(most_paths(LAYOUTS)):
        how = LAYOUTS[paths]
        if "list" in how:
            items = F.variant_get("_v", "$." + how["list"], "array<variant>")
            made = F.transform(items, _item(how, role_map, turn))
        else:
            made = F.array(*[turn(F.lit(role), F.variant_get("_v", "$." + path, "string")) for role, path in how["turns"]])
        turns = F.when(F.col("layout") == fingerprint(paths), made).otherwise(turns)
        rest = F.when(F.size(F.array_intersect("_paths", F.array(*map(F.lit, paths)))) == len(paths), made).otherwise(rest)
    known = F.col("layout").isin([fingerprint(paths) for paths in LAYOUTS])
    return rows.withColumn("turns", F.when(known, turns).otherwise(rest)).drop("_v", "_paths")


def map_rows(rows: DataFrame, keys: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """Canonical conv_id, turn, role, text of a table of turns, by the fingerprint of its schema's field paths."""
    named = {p for paths in ROW_LAYOUTS for p in paths}
    paths = [p for p in paths_of_schema(rows.schema) if p in named]
    known = {fingerprint(p): columns for p, columns in ROW_LAYOUTS.items()}
    found = known.get(fingerprint(paths)) or next((ROW_LAYOUTS[p] for p in most_paths(ROW_LAYOUTS) if set(p) <= set(paths)), None)
    if not found:
        raise ValueError(f"no mapping for the fields {rows.columns}")
    return rows.select(*keys, F.col(found[0]).alias("role"), F.col(found[1]).alias("text"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("&#124;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#124;"), F.lit("|")))


def render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), escape_role(turn["role"]), F.lit("|>\n"), escape(turn["text"]), F.lit("<|end|>\n"))


def format_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted): the template over a table of conv_id, turn, role, text."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    part = F.floor(F.col("turn") / RUN)
    runs = rows.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    runs = runs.select("conv_id", "part", F.array_join(F.transform("turns", render), "").alias("body"))
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "body"))).alias("parts"))
    return whole.select("conv_id", F.array_join(F.col("parts.body"), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) from a formatted conversation."""
    marked = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda x: x != "")
    return F.transform(marked, lambda x: F.struct(unescape_role(F.substring(x, F.lit(3), F.instr(x, "|>\n") - 3)).alias("role"), unescape(F.substring(x, F.instr(x, "|>\n") + 3, F.length(x))).alias("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = map_rows(read(spark, sf_dir, "conversations"))
    says = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    done = format_rows(rows.unionByName(probe)).withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


ORACLE = """
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
  coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss,
  sum(12 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&#124;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))) as n from c group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(n + n_turns as bigint) as formatted_chars from g
"""
