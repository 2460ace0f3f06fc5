"""A limit on how long a query may run: jobs of the block are cancelled when its time is over."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# How often jobs that start after the deadline are looked for, in seconds.
STEP = 0.2
_GROUP, _DESCRIPTION, _INTERRUPT = "spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"


class TimedOut(RuntimeError):
    """A query that did not end in time."""


@contextmanager
def limited(spark: SparkSession, seconds: float | None) -> Iterator[threading.Event]:
    """Run the block's Spark jobs as one group; if it is not over after `seconds`, cancel them and raise TimedOut.

    The group holds for this thread alone, so blocks in other threads go on. None sets no limit. The event handed out
    tells a block that catches errors of its own whether it is late.
    """
    over, late = threading.Event(), threading.Event()
    if seconds is None:
        yield late
        return
    context, group = spark.sparkContext, f"limited-{uuid.uuid4().hex}"

    def watch() -> None:
        if not over.wait(seconds):
            late.set()
            while not over.is_set():
                context.cancelJobGroup(group)
                over.wait(STEP)

    outer = {key: context.getLocalProperty(key) for key in (_GROUP, _DESCRIPTION, _INTERRUPT)}
    watcher = threading.Thread(target=watch, daemon=True)
    try:
        context.setJobGroup(group, f"at most {seconds:g} s", interruptOnCancel=True)
        watcher.start()
        yield late
    except Exception as error:
        if late.is_set():
            raise TimedOut(f"timed out after {seconds:g} s") from error
        raise
    finally:
        over.set()
        watcher.join()
        for key, value in outer.items():
            context.setLocalProperty(key, value)
