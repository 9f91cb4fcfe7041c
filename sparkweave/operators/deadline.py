"""Queries with a deadline: jobs that a block starts are cancelled when its time is over."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Timeout(RuntimeError):
    """The deadline passed; what was running is cancelled."""


@contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Cancel the jobs of the block after `seconds` and raise Timeout. Jobs of other threads go on."""
    tag, late = f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.interruptTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.addTag(tag)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise Timeout(f"stopped after {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)
    if late.is_set():
        raise Timeout(f"stopped after {seconds} seconds")
