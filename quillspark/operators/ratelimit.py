"""Token-bucket admission: in closed form over a table, and as a small limiter inside labeler tasks."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.ordered import running_max, with_position


def admission_times(requests: DataFrame, rpm: int | None, at: str, request_id: str, keys: Sequence[str] = ()) -> DataFrame:
    """``admitted_at`` (seconds) of blocking requests arriving at ``at`` (seconds), per limiter key.

    A bucket of ``rpm`` tokens refilled at ``rpm / 60`` per second. With T seconds per token and the i-th
    arrival a_i, the bucket's virtual finish time is max over j <= i of (a_j - jT) + (i + 1)T, a running
    maximum, and request i waits until that of request i-1 minus the burst allowance.
    """
    if not rpm:
        return requests.withColumn("admitted_at", F.col(at).cast("double"))
    step = 60.0 / rpm
    arrival = F.col(at).cast("double")
    placed = with_position(requests, keys, [at, request_id], "_i")
    shifted = running_max(placed, keys, [at, request_id], arrival - F.col("_i") * step, "_top")
    # The request's own term never exceeds its arrival, so the maximum may include it.
    earliest = F.col("_top") + F.col("_i") * step - (rpm - 1) * step
    return shifted.select(*requests.columns, F.greatest(arrival, earliest).alias("admitted_at"))


class TokenBucket:
    """Limiter of one task: its share of the job's budget. A share below one call starts with part of a token."""

    def __init__(self, rpm: float | None, clock=time.monotonic, sleep=time.sleep):
        self._start = float(rpm or 0)
        self._rate, self._capacity = self._start / 60.0, max(self._start, 1.0)
        self._clock, self._sleep = clock, sleep
        self.reset()

    def reset(self) -> None:
        self._tokens, self._seen = self._start, self._clock()

    def _refill(self) -> None:
        now = self._clock()
        self._tokens = min(self._capacity, self._tokens + (now - self._seen) * self._rate)
        self._seen = now

    def try_acquire(self, tokens: int = 1) -> bool:
        if not self._rate:
            return True
        self._refill()
        if self._tokens < tokens:
            return False
        self._tokens -= tokens
        return True

    def acquire(self, tokens: int = 1) -> None:
        while not self.try_acquire(tokens):
            self._sleep(min((tokens - self._tokens) / self._rate, 0.1))
