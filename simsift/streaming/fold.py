"""Ordered fold of call outcomes through a circuit breaker (one service).

States: CLOSED counts failures (successes do not reset the count) and opens
at the threshold; OPEN rejects until more than the recovery time has passed
since the last failure, then lets one call through (HALF_OPEN): its success
closes and clears, its failure opens again. Works on numpy arrays and jumps
from state change to state change instead of looping over calls.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

CLOSED, OPEN, HALF_OPEN = 0, 1, 2


class Breaker(NamedTuple):
    mode: int = CLOSED
    failures: int = 0
    last_failure: int = -1  # microseconds; -1 = none yet


def fold_calls(ts, ok, start: Breaker, threshold: int, recovery_us: int):
    """Fold calls sorted by time; returns (admitted, mode, failures) per call and the end state."""
    n = len(ts)
    admitted = np.ones(n, dtype=bool)
    modes = np.empty(n, dtype=np.int8)
    counts = np.empty(n, dtype=np.int64)
    failed_at = np.flatnonzero(~ok)
    mode, count, last = start
    i = 0
    while i < n:
        if mode == OPEN:
            # First call strictly later than last failure + recovery.
            j = i + int(np.searchsorted(ts[i:], last + recovery_us, side="right"))
            admitted[i:j], modes[i:j], counts[i:j] = False, OPEN, count
            if j == n:
                break
            if ok[j]:
                mode, count = CLOSED, 0
            else:
                count, last = count + 1, int(ts[j])
                mode = OPEN if count >= threshold else HALF_OPEN
            modes[j], counts[j] = mode, count
            i = j + 1
            continue
        first = int(np.searchsorted(failed_at, i))
        opening = first + max(threshold - count, 1) - 1
        opens = opening < len(failed_at)
        end = int(failed_at[opening]) + 1 if opens else n
        counts[i:end] = count + np.cumsum(~ok[i:end])
        modes[i:end] = CLOSED
        count = int(counts[end - 1])
        last_failed = opening if opens else len(failed_at) - 1
        if last_failed >= first:
            last = int(ts[failed_at[last_failed]])
        if opens:
            mode = OPEN
            modes[end - 1] = OPEN
        i = end
    return admitted, modes, counts, Breaker(mode, count, last)
