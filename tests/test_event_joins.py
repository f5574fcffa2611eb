import ipaddress

import pytest
from pyspark.sql import functions as F

from rulespark.functions.registry import in_cidr
from rulespark.operators.events import detect, security_events
from rulespark.plans.lexer import RuleError


def events(spark, rows):
    return security_events(spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"))


def test_ipv6(spark):
    texts = ["::", "::1", "2001:db8::1", "2001:DB8:0:0:1::", "fe80::1:2:3:4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "2001:db8:::1", "12345::", "10.0.0.1", "", None, "2001:db9::", ":1", "1:"]
    nets = ["2001:db8::/32", "::/0", "fe80::/10", "::/127", "10.0.0.0/8"]
    df = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", *[in_cidr(F.col("ip"), n).alias(str(k)) for k, n in enumerate(nets)])
    for row in df.collect():
        try:
            address = ipaddress.ip_address(row["ip"])
        except ValueError:
            address = None
        for k, n in enumerate(nets):
            net = ipaddress.ip_network(n)
            want = None if address is None or address.version != net.version else address in net
            assert row[str(k)] == want, (row["ip"], n)


@pytest.mark.parametrize("anchor,test", [("after $a", lambda a, b: 0 < b - a <= 7200), ("before $a", lambda a, b: -7200 <= b - a < 0)])
def test_anchored_intervals(spark, anchor, test):
    import datetime
    import random

    draw, start = random.Random(3), datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(seconds=draw.choice([0, 3600, 7200, 1, 7199, 14400]) + 3600 * draw.randint(0, 9)), draw.randint(0, 3), draw.choice("ab"), 1.0, None) for k in range(120)]
    found = detect(f'rule r {{ events: $a.metadata.event_type = "a" $b.metadata.event_type = "b" $a.principal.user.userid = $u $b.principal.user.userid = $u\n match: $u over 2h {anchor}\n condition: $a and $b }}', events(spark, rows)).collect()
    seconds = lambda t: (t - start).total_seconds()
    want = {}
    for a in rows:
        for b in rows:
            if a[3] == "a" and b[3] == "b" and a[2] == b[2] and test(seconds(a[1]), seconds(b[1])):
                want.setdefault((a[1], a[2]), set()).add(b[0])
    edge = "window_start" if "after" in anchor else "window_end"
    assert {(r[edge], r["u"]): r["n_b"] for r in found} == {k: len(v) for k, v in want.items()}


def test_untied_events_are_refused(spark):
    with pytest.raises(RuleError):
        detect('rule r { events: $a.metadata.event_type = "a" $b.metadata.event_type = "b"\n condition: $a and $b }', events(spark, []))
