"""The boundary to external model calls.

A transport is any picklable object with ``call(prompt) -> str`` that raises on failure. Calls run in
``mapInPandas``: retries back off exponentially, every call leaves an audit record, and a task that
runs again does the same work again, so sinks should be resumed by id (see ``joins.resume``).
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Transport(Protocol):
    def call(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class Echo:
    """An offline transport: answers are a function of the prompt alone; every nth hash fails."""

    prefix: str = "echo"
    fail_every: int = 0

    def call(self, prompt: str) -> str:
        h = int(hashlib.sha1(prompt.encode()).hexdigest()[:8], 16)
        if self.fail_every and h % self.fail_every == 0:
            raise RuntimeError("refused by the stub")
        return f"{self.prefix}:{h % 1000}"


@dataclass(frozen=True)
class Retry:
    attempts: int = 3
    longest: float = 30.0
    pace: float = 0.0

    def wait(self, attempt: int) -> float:
        return min(self.longest, 2.0**attempt)


def call_all(df: DataFrame, key: str, prompt: str, transport: Transport, retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, prompt, result, error, attempts): one audit row per input row; a null prompt is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, p in zip(pdf["key"], pdf["prompt"]):
                result, error, tried = None, None, 0
                if p is None:
                    error = "no prompt"
                else:
                    for tried in range(1, retry.attempts + 1):
                        try:
                            result, error = transport.call(p), None
                            break
                        except Exception as e:  # noqa: BLE001 - whatever a transport raises is recorded
                            error = f"{type(e).__name__}: {e}"
                            if tried < retry.attempts:
                                sleep(retry.wait(tried))
                    if retry.pace:
                        sleep(retry.pace)
                rows.append((k, p, result, error, tried))
            yield pd.DataFrame(rows, columns=["key", "prompt", "result", "error", "attempts"])

    made = df.select(F.col(key).cast("string").alias("key"), F.col(prompt).alias("prompt")).mapInPandas(run, "key string, prompt string, result string, error string, attempts int")
    return made.withColumnRenamed("key", key)
