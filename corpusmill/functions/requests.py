"""Answers of rate-limited services: how long to wait before a request is sent again, and what a package may hold of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Retries, first and longest wait without a hint, buffer for unequal clocks, longest wait for a reset.
RETRIES, FIRST_WAIT, LONGEST_WAIT, SKEW, LONGEST_RESET = 5, 5.0, 60.0, 1.5, 3600.0


def retry_wait(status: Column, attempt: Column, now: Column, retry_after: Column, remaining: Column, reset_at: Column) -> Column:
    """Seconds to wait before attempt + 1 (attempts count from 0); null where no further one is due.

    Only 429 and 403 are tried again. The service's hints add up: Retry-After, and the time to the reset where nothing
    remains; a named reset makes either longer by SKEW. Without a wait of theirs it doubles from FIRST_WAIT. A reset
    beyond LONGEST_RESET means that the quota is spent: see quota_spent.
    """
    asked = F.greatest(F.coalesce(retry_after, F.lit(0.0)), F.lit(0.0))
    until = F.when(remaining == 0, F.greatest(F.coalesce(reset_at - now, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    hinted = asked + until
    own = F.least(F.lit(LONGEST_WAIT), FIRST_WAIT * F.pow(F.lit(2.0), attempt))
    wait = F.when(hinted > 0, hinted + F.when(reset_at.isNotNull(), SKEW).otherwise(0.0)).otherwise(own)
    due = status.isin(429, 403) & (attempt < RETRIES) & ~quota_spent(now, remaining, reset_at)
    return F.when(due, wait)


def quota_spent(now: Column, remaining: Column, reset_at: Column) -> Column:
    """Whether a reset lies too far off to wait for."""
    return F.coalesce((remaining == 0) & (reset_at - now > LONGEST_RESET), F.lit(False))


def paths_only(record: Column, field: str) -> Column:
    """The sorted keys of an object in a JSON record, its contents left behind; an empty list where there is none."""
    keys = F.json_object_keys(F.get_json_object(record, f"$.{field}"))
    return F.array_sort(F.coalesce(keys, F.array().cast("array<string>")))
