"""Event rules on Structured Streaming: the batch plan of a rule under a watermark.

Rules of one event variable, and of several that share only match keys (they are counted side by side in one
aggregation), run as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.operators.events import Binding, Compiler, security_events
from rulespark.plans.event_rule import EventRule, parse


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """A file stream with event time as a timestamp (a watermark needs one with a zone)."""
    df = spark.readStream.schema(schema).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def detect_stream(rule: str | EventRule, events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Detections of closed windows; rows later than the delay are dropped by the watermark."""
    rule = parse(rule)[0] if isinstance(rule, str) else rule
    binding: Binding = security_events(events.withWatermark("ts", delay))
    compiler = Compiler(rule, binding)
    if not rule.match or rule.window.anchor or len(compiler.names) > 1 and not compiler.side_by_side():
        raise ValueError("a streaming rule has a plain match window, and its event variables share only match keys")
    return compiler.compile()


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id") -> DataFrame:
    """Sessions of a key: events no further apart than the gap.  Works on streams with a watermark, and on tables."""
    if not events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), key, "n")


def interval_join(left: DataFrame, right: DataFrame, hours: int = 48, delay: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Pairs of a key with right after left by at most so many hours; both sides of a stream get a watermark."""
    prepare = lambda d, p: (d.withColumn("ts", F.col("ts").cast("timestamp")) if not d.isStreaming else d.withWatermark("ts", delay)).select(*[F.col(c).alias(p + c) for c in ("event_id", "ts", key)])
    a, b = prepare(left, "a_"), prepare(right, "b_")
    return a.join(b, (F.col(f"a_{key}") == F.col(f"b_{key}")) & (F.col("b_ts") > F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"interval {hours} hours")))


def run_available(query: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Process what is there and return it as a table; for tests and backfills."""
    q = query.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return query.sparkSession.table(name)
