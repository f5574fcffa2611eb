"""Two-pass external shuffle into shards, in built-in expressions only.

Pass 1 counts the rows of each bucket: a seeded hash gives every record its shard (rendezvous: the shard
with the greatest hash of seed, id and shard number wins, so a further shard only takes rows to itself) and,
within the shard, a bucket small enough for memory.  Pass 2 moves each record once, to its bucket, puts the
bucket in a fixed order and Fisher-Yates-shuffles it; each draw is a hash of seed, shard, bucket and step, so the
result is the same whatever the partitions, the order of the input or the tasks that ran again.  The counts of
pass 1 give each bucket its place, so the slots of a shard have no gap.

A task gets several buckets, and holds at most 128 of them (megabytes) before Spark's aggregation goes over to sorting
and holds one.  Rows with the same id and the same text are interchangeable; where they fill a bucket beyond
`FULL` rows, they are numbered, in parts, and dealt over further buckets.

Defined cases: a null text has no bytes; null ids share the shard of the largest long; rows with equal id and
text are interchangeable and keep a slot each; extra columns go along; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import id_key, read, stored, text_of

SHARDS, SEED = 16, 20240229
#: Bytes of text and rows meant for a bucket; rows from which a bucket is divided; bytes of a task.
BUCKET_BYTES, BUCKET_ROWS, FULL, TASK_BYTES = 1 << 20, 1024, 16_384, 64 << 20


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing; the key and the number of shards decide."""
    weights = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("w"), F.lit(s).alias("s")) for s in range(shards)]
    return F.greatest(*weights)["s"]


def fisher_yates(n: Column, *seeds: Column) -> Column:
    """A permutation of 0 .. n - 1, inside out: each number goes to a drawn place, whose number moves to the end."""

    def step(done: Column, i: Column) -> Column:
        def put(j: Column) -> Column:
            last = F.when(j < i, F.array(F.get(done, j))).otherwise(F.array().cast("array<int>"))
            return F.concat(F.slice(done, F.lit(1), j), F.array(i), F.slice(done, j + 2, F.greatest(i - j - 1, F.lit(0))), last)

        draw = F.pmod(F.xxhash64(*seeds, i), i + 1).cast("int")
        return F.get(F.transform(F.array(draw), put), F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<int>"), step)


def _divided(rows: DataFrame, full: DataFrame, bucket_rows: int) -> DataFrame:
    """Rows of buckets that are too full, with a new bucket by the number of each row among its equals.

    Equals are counted by input partition first; which of them has which number makes no difference.
    """
    rows = rows.join(full, ["shard", "bucket"])
    own = ["shard", "bucket", "key", "h"]
    counted = rows.groupBy(*own, "origin").agg(F.count("*").alias("n"))
    ahead = counted.select(*own, "origin", (F.sum("n").over(W.partitionBy(*own).orderBy("origin")) - F.col("n")).alias("ahead"))
    place = F.row_number().over(W.partitionBy(*own, "origin").orderBy("size")) - 1
    rows = rows.withColumn("place", place).join(ahead, [*own, "origin"])
    # numbers above those of whole buckets: the first part keeps the bucket's own
    part = F.floor((F.col("ahead") + F.col("place")) / bucket_rows)
    return rows.withColumn("bucket", F.when(part == 0, F.col("bucket")).otherwise(F.abs(F.xxhash64("bucket", "key", "h", part)).bitwiseOR(F.lit(1 << 62))))


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, full_rows: int = FULL) -> DataFrame:
    """Struct `row` with the input's columns, size, shard, slot, grown_shard."""
    t = text_of(docs)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), id_key().alias("key"), F.xxhash64(t).alias("h"), (F.octet_length(t) + 1).cast("long").alias("size"), F.spark_partition_id().alias("origin"))
    total = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    size, number = total["size"] or 0, total["n"]
    buckets = max(1, -(-size // (shards * bucket_bytes)), -(-number // (shards * bucket_rows)))
    rows = rows.withColumn("shard", shard_of(F.col("key"), shards, seed)).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "key", "h"), F.lit(buckets)))
    counts = stored(rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")), "bucket-counts")
    full = counts.filter(F.col("n") > full_rows).select("shard", "bucket")
    if full.limit(1).count():
        dealt = _divided(rows, full, bucket_rows)
        rows = rows.join(full, ["shard", "bucket"], "left_anti").unionByName(dealt.select(*rows.columns))
        counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("offset"))
    # records of a bucket in a fixed order, then the seeded Fisher-Yates shuffle
    tasks = max(1, min(20_000, -(-size // TASK_BYTES)))
    mixed = rows.select("shard", "bucket", F.struct("key", "h", "size", "row").alias("record")).repartition(tasks, "shard", "bucket")
    mixed = mixed.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list("record")).alias("records")).join(offsets, ["shard", "bucket"])
    order = fisher_yates(F.size("records"), F.lit(seed + 2), F.col("shard"), F.col("bucket"))
    out = mixed.select("shard", "offset", "records", order.alias("order")).select("shard", "offset", "records", F.posexplode_outer("order").alias("at", "k"))
    out = out.select("shard", "offset", "at", F.get("records", F.col("k")).alias("r"))
    return out.select("r.row", "r.size", "shard", (F.col("offset") + F.col("at")).alias("slot"), shard_of(F.col("r.key"), shards + 1, seed).alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """One folder for each shard; files hold whole buckets in slot order."""
    done = shuffle(docs, shards, seed)
    done.select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).write.partitionBy("_shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return shuffle(docs).select(
        "row.doc_id", "size", F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))
