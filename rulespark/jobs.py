"""Jobs that can be watched, stopped and limited in time, and work over rules one by one."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Job:
    name: str
    status: str = "waiting"  # waiting | running | done | failed | cancelled | timeout
    seconds: float = 0.0
    result: object = None
    error: str | None = None


class Tracker:
    """Runs functions as Spark job groups, one after another, and keeps what came of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jobs = spark, []
        self.group: str | None = None
        self.stopped = False

    def run(self, name: str, work: Callable[[], object], timeout: float | None = None) -> Job:
        """work() with its Spark jobs in a group; beyond `timeout` seconds they are cancelled."""
        job = Job(name, "running")
        self.jobs.append(job)
        sc, group = self.spark.sparkContext, uuid.uuid4().hex
        self.group, began, late = group, time.time(), threading.Event()

        def expire():
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(timeout, expire) if timeout else None
        sc.setJobGroup(group, name, True)
        try:
            if timer:
                timer.start()
            job.result, job.status = work(), "done"
        except Exception as e:  # whatever a job raises is its result
            job.status, job.error = "timeout" if late.is_set() else "cancelled" if self.stopped else "failed", f"{type(e).__name__}: {str(e)[:300]}"
        finally:
            if timer:
                timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)
            job.seconds, self.group = time.time() - began, None
        return job

    def cancel(self) -> None:
        """Stop the job that runs."""
        self.stopped = True
        if self.group:
            self.spark.sparkContext.cancelJobGroup(self.group)

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([(j.name, j.status, j.seconds, j.error) for j in self.jobs], "name string, status string, seconds double, error string")

    def statistics(self) -> dict:
        done = sum(j.status == "done" for j in self.jobs)
        return {"jobs": len(self.jobs), "done": done, "success_rate": 100.0 * done / len(self.jobs) if self.jobs else 0.0, "avg_seconds": sum(j.seconds for j in self.jobs) / len(self.jobs) if self.jobs else 0.0}


def each_rule(text: str, on_rule: Callable[[dict], object] | None = None, progress: Callable[[int], object] | None = None, cancelled: Callable[[], bool] | None = None, chunk: int | None = None) -> Iterator:
    """Parsed rows of a file's rules, one at a time or in lists of `chunk`; both callbacks see every rule, and `cancelled` ends it."""
    from rulespark.sources.rules import rule_rows

    held: list[dict] = []
    for n, row in enumerate(rule_rows("", text), 1):
        if cancelled and cancelled():
            return
        if on_rule:
            on_rule(row)
        if progress:
            progress(n)
        if not chunk:
            yield row
            continue
        held.append(row)
        if len(held) == chunk:
            yield held
            held = []
    if held:
        yield held


def map_rules(parsed: DataFrame, function: Callable[[dict], object], schema: str = "rule string, result string") -> DataFrame:
    """function(row) of every parsed rule on the executors, as text; an error gives null."""
    import pandas as pd

    def run(batches):
        for frame in batches:
            rows = []
            for row in frame.to_dict("records"):
                try:
                    rows.append((row["name"], str(function(row))))
                except Exception:  # a user's function
                    rows.append((row["name"], None))
            yield pd.DataFrame(rows, columns=["rule", "result"])

    return parsed.mapInPandas(run, schema)


def scaling(spark: SparkSession, work: Callable[[int], object], tasks: list[int]) -> list[tuple[int, float]]:
    """(tasks, seconds) of work(tasks): how a job gains from more of them."""
    out = []
    for n in tasks:
        began = time.time()
        work(n)
        out.append((n, time.time() - began))
    return out
