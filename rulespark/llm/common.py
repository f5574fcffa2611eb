"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, shared_dir, stored  # noqa: F401

#: Java regular expressions for runs of separators.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Everything ASCII but letters and digits; works on text of either case.
NON_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate tables for the Python operators: ASCII lower case, and the same with separators as spaces.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ALNUM_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def id_key(name: str = "doc_id") -> Column:
    """An id that joins null with null; null counts as the largest."""
    return F.coalesce(F.col(name).cast("long"), F.lit(9223372036854775807))


def words_by_space(text: Column) -> Column:
    """Words of a text that has no null; an empty array if it has no word."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


#: Bytes of an Arrow batch on its way to Python: two tasks of an executor hold several at once, on both sides.
ARROW_BYTES = 2 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The table; the session's Arrow batches are at most ARROW_BYTES from now on (Spark's own limit is 64 MB)."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name, None) in (None, "67108864b", "64m", "64MB"):
        conf.set(name, f"{ARROW_BYTES}b")
    return df


#: What operators keep in a Python worker from one task to the next, by operator; their modules enter it here.
KEPT: dict[str, dict] = {}


def others_go(operator: str) -> None:
    """Clear what the other operators kept in this worker."""
    for name, kept in KEPT.items():
        if name != operator:
            kept.clear()


def give_back() -> None:
    """Return free memory of this worker to the system: Arrow's pool and the C library hold on to their peaks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def lean(run, operator: str):
    """`run` for mapInArrow, by a worker that serves stage after stage: it holds what the operator of its task needs."""

    def task(batches):
        others_go(operator)
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def fresh(docs: DataFrame, name: str) -> str:
    """The name, with underscores until no column has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, broadcast_ids: int = 500_000) -> DataFrame:
    """The rows whose doc_id is not among `gone` (one column), in the columns they came in; null equals null.

    Few ids (8 bytes each, counted first) are broadcast, so the texts are not shuffled; more are joined by shuffle.
    """
    name = fresh(docs, "_gone")
    gone = stored(gone.toDF(name).distinct(), "gone-ids")
    few = gone.count() <= broadcast_ids
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].eqNullSafe(F.col(name)), "left_anti")
