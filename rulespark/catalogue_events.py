"""Event-rule queries over the event stream and the order tables, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.operators.events import Binding, detect, security_events

QUERIES: dict = {}
ORACLES: dict = {}

BASE = "with e as (select event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) as k from events), vip as (select distinct c_custkey as v from customer where c_nationkey < 5)"


def bind(spark: SparkSession, sf_dir: str) -> Binding:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    vip = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_nationkey < 5").select(F.col("c_custkey").alias("id"))
    return security_events(events, {"vip": vip})


def slot(seconds: int, ts: str = "ts") -> str:
    us = seconds * 1_000_000
    return f"make_timestamp((epoch_us({ts}) // {us}) * {us})"


def add(name: str, body: str, sql: str) -> None:
    text = f"rule {name} {{\n{body}\n}}"
    QUERIES[name] = lambda spark, sf_dir: detect(text, bind(spark, sf_dir))
    ORACLES[name] = sql


def windowed(name: str, where: str, rule_where: str, outcome: str = "", sql_out: str = "", condition: str = "#e > 0", having: str = "true", over: str = "1h", seconds: int = 3600, keys: str = "$u over", binding: str = "$e.principal.user.userid = $u", sql_key: str = "user_id as u", options: str = "") -> None:
    """A rule of one event variable, grouped by user and window."""
    body = f"  events:\n    {rule_where}\n    {binding}\n  match: {keys} {over}\n" + (f"  outcome: {outcome}\n" if outcome else "") + f"  condition: {condition}\n" + (f"  options: {options}\n" if options else "")
    w = slot(seconds)
    inner = f"select {w} as window_start, {w} + to_seconds({seconds}) as window_end, {sql_key}{', ' + sql_out if sql_out else ''}, count(*) as n_e from e where {where} group by all"
    add(name, body, f"{BASE}, g as ({inner}) select '{name}' as rule, * from g where {having}")


U = "$e.principal.user.userid"
T = "$e.metadata.event_type"
V = "$e.network.sent_bytes"

windowed("ev_error_hourly_by_user", "event_type = 'error'", f'{T} = "error"', "$n = count($e.metadata.id) $last = latest($e.metadata.event_timestamp)", "count(event_id) as n, max(ts) as last", "#e > 1", "n_e > 1")
windowed("ev_eq", "event_type = 'click'", f'{T} = "click"')
windowed("ev_neq", "event_type <> 'click'", f'{T} != "click"')
windowed("ev_range", "value >= 10 and value < 50", f"{V} >= 10 {V} < 50")
windowed("ev_regex", "regexp_matches(event_type, '^(click|view)$')", f"{T} = /^(click|view)$/")
windowed("ev_not_regex", "not regexp_matches(event_type, 'i')", f"{T} not matches /i/")
windowed("ev_nocase", "lower(event_type) = 'purchase'", f'{T} = "PURCHASE" nocase')
windowed("ev_in_list", "user_id in (select v from vip)", f"{U} in %vip%")
windowed("ev_not_in_list", "user_id not in (select v from vip)", f"not {U} in %vip%")
windowed("ev_list_in_group", "(user_id in (select v from vip) or value > 90)", f"({U} in %vip.id% or {V} > 90)")
windowed("ev_null_check", "value is not null", f"{V} is not null")
windowed("ev_bool_group", "(event_type = 'error' or (event_type = 'click' and not value < 5))", f'({T} = "error" or ({T} = "click" and not {V} < 5))')
windowed("ev_json_field", "k > 50", '$e.additional.fields["k"] > 50')
windowed("ev_computed_binding", "user_id > 0", f"{U} > 0", binding=f'$u = re.capture({T}, "^([a-z]{{3}})")', sql_key="regexp_extract(event_type, '^([a-z]{3})', 1) as u")
windowed("ev_arith_predicate", "value * 2 - 10 > 60", f"{V} * 2 - 10 > 60")
windowed("ev_count_distinct", "user_id > 0", f"{U} > 0", f"$types = count_distinct({T})", "count(distinct event_type) as types", "$types > 1", "types > 1", "1d", 86400)
windowed("ev_sum_avg", "user_id > 0", f"{U} > 0", f"$total = math.round(sum({V}), 3) $mean = math.round(avg({V}), 6)", "round(sum(value), 3) as total, round(avg(value), 6) as mean", "$total > 100", "total > 100", "1d", 86400)
windowed("ev_min_max", "user_id > 0", f"{U} > 0", f"$low = min({V}) $high = max({V})", "min(value) as low, max(value) as high", over="1d", seconds=86400)
windowed("ev_array", "user_id > 0", f"{U} > 0", f'$all = strings.length(string_concat({T}, "|"))', "length(string_agg(event_type, '|')) as \"all\"", over="1d", seconds=86400)
windowed("ev_array_distinct", "user_id > 0", f"{U} > 0", f"$n = arrays.length(array_distinct({T}))", "len(list_distinct(list(event_type))) as n", over="1d", seconds=86400)
windowed("ev_earliest_latest", "user_id > 0", f"{U} > 0", f"$first = earliest($e.metadata.event_timestamp) $type = latest({T})", "min(ts) as first, max_by(event_type, ts) as type", over="1d", seconds=86400)
windowed("ev_string_concat", "user_id > 0", f"{U} > 0", f'$text = string_concat({T}, ",")', "string_agg(event_type, ',' order by event_type) as text", over="1d", seconds=86400)
windowed("ev_if_nested", "user_id > 0", f"{U} > 0", f"$n = count({T}) $level = if($n > 4, 3, if($n > 2, 2, 1))", "count(event_type) as n, case when count(event_type) > 4 then 3 when count(event_type) > 2 then 2 else 1 end as level", over="1d", seconds=86400)
windowed("ev_if_no_else", "user_id > 0", f"{U} > 0", f"$big = max(if({V} > 50, 1))", "max(case when value > 50 then 1 end) as big", over="1d", seconds=86400)
windowed("ev_outcome_refs_outcome", "user_id > 0", f"{U} > 0", f"$a = count({T}) $b = $a * 2 + 1 $c = $b - $a", "count(event_type) as a, count(event_type) * 2 + 1 as b, count(event_type) + 1 as c", over="1d", seconds=86400)
windowed("ev_arith_outcome", "user_id > 0", f"{U} > 0", f"$ratio = math.round(sum({V}) / count({T}), 6)", "round(sum(value) / count(event_type), 6) as ratio", over="1d", seconds=86400)
windowed("ev_having_or", "user_id > 0", f"{U} > 0", f"$n = count({T}) $t = math.round(sum({V}), 3)", "count(event_type) as n, round(sum(value), 3) as t", "$n > 3 or $t > 150", "n > 3 or t > 150", "1d", 86400)
windowed("ev_daily_window", "event_type = 'purchase'", f'{T} = "purchase"', over="every 1d", seconds=86400)
windowed("ev_multi_key_window", "user_id > 0", f"{U} > 0", keys="$u, $t = $e.metadata.event_type over", sql_key="user_id as u, event_type as t", over="6h", seconds=21600, condition="#e > 1", having="n_e > 1")
windowed("ev_unix_seconds", "epoch(ts)::bigint % 2 = 0 or true", "$e.metadata.event_timestamp.seconds > 0")
windowed("ev_day_of_week", "dayofweek(ts) + 1 = 2", "timestamp.get_day_of_week($e.metadata.event_timestamp) = 2")
windowed("ev_case_insensitive_option", "lower(event_type) = 'error'", f'{T} = "ERROR"', options="case_sensitive = false")

w = slot(3600)
add("ev_limit_option", f'  events: {T} = "view" {U} = $u\n  match: $u over 1h\n  condition: #e > 0\n  options: max_matches = 10',
    f"{BASE} select 'ev_limit_option' as rule, {w} as window_start, {w} + to_seconds(3600) as window_end, user_id as u, count(*) as n_e from e where event_type = 'view' group by all order by window_start, window_end, u limit 10")
add("ev_no_match_section", f'  events: {T} = "error" {V} > 80\n  outcome: $v = max({V})\n  condition: $e',
    f"{BASE} select 'ev_no_match_section' as rule, event_id as e_id, value as v, 1 as n_e from e where event_type = 'error' and value > 80")
hop = "select event_id, user_id, make_timestamp((epoch_us(ts) // 900000000 - i) * 900000000) as s from e, range(4) r(i) where event_type = 'error'"
add("ev_hop_window", f'  events: {T} = "error" {U} = $u\n  match: $u over 1h every 15m\n  condition: #e > 1',
    f"{BASE}, h as ({hop}) select 'ev_hop_window' as rule, s as window_start, s + to_seconds(3600) as window_end, user_id as u, count(*) as n_e from h group by all having count(*) > 1")

TWO = '  events: $a.metadata.event_type = "{}" $b.metadata.event_type = "{}" $a.principal.user.userid = $u $b.principal.user.userid = $u\n'
AB = f"{BASE}, a as (select *, {slot(86400)} as s from e where event_type = '{{}}'), b as (select *, {slot(86400)} as s from e where event_type = '{{}}')"


def two(name: str, first: str, second: str, rest: str, sql: str) -> None:
    add(name, TWO.format(first, second) + rest, AB.format(first, second) + " " + sql.replace("NAME", f"'{name}' as rule"))


SIDE = "select coalesce(x.s, y.s) as window_start, coalesce(x.s, y.s) + to_seconds(86400) as window_end, coalesce(x.user_id, y.user_id) as u, coalesce(x.n, 0) as n_a, coalesce(y.n, 0) as n_b from (select s, user_id, count(*) as n from a group by all) x full join (select s, user_id, count(*) as n from b group by all) y on x.s = y.s and x.user_id = y.user_id"
two("ev_window_cooccur", "click", "purchase", "  match: $u over 1d\n  condition: #a > 1 and $b", f"select NAME, * from ({SIDE}) where n_a > 1 and n_b > 0")
two("ev_exists_not_exists", "error", "purchase", "  match: $u over 1d\n  condition: $a and not $b", f"select NAME, * from ({SIDE}) where n_a > 0 and not n_b > 0")
two("ev_n_of_events", "signup", "purchase", "  match: $u over 1d\n  condition: 2 of ($a, $b)", f"select NAME, * from ({SIDE}) where n_a > 0 and n_b > 0")
two("ev_join_theta", "click", "purchase", "    $a.network.sent_bytes > $b.network.sent_bytes\n  match: $u over 1d\n  condition: $a and $b",
    "select NAME, a.s as window_start, a.s + to_seconds(86400) as window_end, a.user_id as u, count(distinct a.event_id) as n_a, count(distinct b.event_id) as n_b from a join b on a.user_id = b.user_id and a.s = b.s and a.value > b.value group by all")
two("ev_after_48h", "signup", "purchase", "  match: $u over 48h after $a\n  outcome: $total = math.round(sum($b.network.sent_bytes), 3)\n  condition: $a and $b",
    "select NAME, a.ts as window_start, a.ts + to_hours(48) as window_end, a.user_id as u, round(sum(b.value), 3) as total, count(distinct a.event_id) as n_a, count(distinct b.event_id) as n_b from a join b on a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + to_hours(48) group by a.ts, a.user_id")
two("ev_before_2h", "error", "purchase", "  match: $u over 2h before $b\n  condition: $a and $b",
    "select NAME, b.ts - to_hours(2) as window_start, b.ts as window_end, a.user_id as u, count(distinct a.event_id) as n_a, count(distinct b.event_id) as n_b from a join b on a.user_id = b.user_id and a.ts < b.ts and a.ts >= b.ts - to_hours(2) group by b.ts, a.user_id")
two("ev_followed_by", "click", "error", "    $a followed by $b\n  match: $u over 1d\n  condition: $a and $b",
    "select NAME, a.s as window_start, a.s + to_seconds(86400) as window_end, a.user_id as u, count(distinct a.event_id) as n_a, count(distinct b.event_id) as n_b from a join b on a.user_id = b.user_id and a.s = b.s and a.ts < b.ts group by all")
two("ev_difference_join", "signup", "error", "    600 <= $b.metadata.event_timestamp.seconds - $a.metadata.event_timestamp.seconds\n  match: $u over 1d\n  condition: $a and $b",
    "select NAME, a.s as window_start, a.s + to_seconds(86400) as window_end, a.user_id as u, count(distinct a.event_id) as n_a, count(distinct b.event_id) as n_b from a join b on a.user_id = b.user_id and a.s = b.s and 600 <= floor(epoch(b.ts))::bigint - floor(epoch(a.ts))::bigint group by all")


def orders_binding(spark, sf_dir: str) -> dict[str, Binding]:
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    return {
        "o": Binding(orders, {"metadata.id": "o_orderkey", "metadata.event_timestamp": "o_orderdate", "principal.user.userid": "o_custkey", "network.sent_bytes": "o_totalprice", "metadata.event_type": "o_orderstatus"}, "o_orderkey", "o_orderdate"),
        "l": Binding(lines, {"metadata.id": "l_orderkey", "metadata.event_timestamp": "l_shipdate", "network.sent_bytes": "l_quantity", "metadata.event_type": "l_returnflag"}, "l_linenumber", "l_shipdate"),
    }


ORDERS = 'rule ev_orders_lineitem_join {\n  events: $o.metadata.event_type = "F" $l.metadata.event_type = "R" $o.metadata.id = $k $l.metadata.id = $k $l.network.sent_bytes > 45\n  match: $c = $o.principal.user.userid over 30d after $o\n  condition: $o and $l\n}'
QUERIES["ev_orders_lineitem_join"] = lambda spark, sf_dir: detect(ORDERS, orders_binding(spark, sf_dir))
ORACLES["ev_orders_lineitem_join"] = "select 'ev_orders_lineitem_join' as rule, o_orderdate as window_start, o_orderdate + interval 30 day as window_end, o_custkey as c, count(distinct o_orderkey) as n_o, count(distinct l_linenumber) as n_l from orders join lineitem on o_orderkey = l_orderkey where o_orderstatus = 'F' and l_returnflag = 'R' and l_quantity > 45 and l_shipdate > o_orderdate and l_shipdate <= o_orderdate + interval 30 day group by o_orderdate, o_custkey"

LEFT = 'rule ev_left_join_events {\n  events: $a.metadata.event_type = "signup" $b.metadata.event_type = "purchase"\n    join left $a with $b on $a.principal.user.userid = $b.principal.user.userid\n  outcome: $n = count($b.metadata.id)\n  condition: $a\n}'
QUERIES["ev_left_join_events"] = lambda spark, sf_dir: detect(LEFT, bind(spark, sf_dir))
ORACLES["ev_left_join_events"] = f"{BASE} select 'ev_left_join_events' as rule, a.event_id as a_id, b.event_id as b_id, count(b.event_id) as n, 1 as n_a, count(distinct b.event_id) as n_b from e a left join e b on a.user_id = b.user_id and b.event_type = 'purchase' where a.event_type = 'signup' group by all"

QUERIES["l_purchase_burst"] = QUERIES["ev_error_hourly_by_user"]
ORACLES["l_purchase_burst"] = ORACLES["ev_error_hourly_by_user"]


def cidr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made from user numbers, kept if they lie in a network."""
    from rulespark.functions.registry import in_cidr

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ip = F.concat_ws(".", F.lit("10"), (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 256).cast("string"), F.lit("7"))
    return events.select("event_id", ip.alias("ip")).filter(in_cidr(F.col("ip"), "10.16.0.0/12"))


QUERIES["ev_cidr_literal_table"] = cidr
ORACLES["ev_cidr_literal_table"] = "select event_id, '10.' || (user_id % 256) || '.' || (event_id % 256) || '.7' as ip from events where user_id % 256 between 16 and 31"


def sessions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespark.streaming.events import sessions

    return sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "6 hours")


QUERIES["st_session"] = sessions_query
ORACLES["st_session"] = """with p as (select *, lag(ts) over (partition by user_id order by ts) as before from events),
s as (select *, sum(case when before is null or ts >= before + interval 6 hour then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as k from p)
select min(ts) as session_start, max(ts) + interval 6 hour as session_end, user_id, count(*) as n from s group by user_id, k"""
