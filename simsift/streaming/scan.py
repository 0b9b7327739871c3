"""What a stretch of calls does to the breaker, whatever state it begins in.

A stretch's summary maps each possible state before it to the state after it, so that
stretches can be summarised apart and then chained like numbers in a prefix sum:

* closed with 0, 1, ... failures: one effect each;
* open since a last failure at L: the first call later than L + recovery is the probe, so the
  effect is constant between bounds on L. There is one bound per call that can be the probe and
  leads elsewhere than the one after it: at most two per failure within the recovery time
  after the stretch's first call. From the last bound on, all calls are rejected.

While the breaker stays open its failure count goes on from the one before: such effects
are relative. A breaker that has opened is never seen half open after a call.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd

from .fold import CLOSED, OPEN, Breaker

#: Columns of a summary's rows: closed = failures before, or -1 for a breaker open since before ``bound``.
COLUMNS = ["chunk", "first_ts", "closed", "bound", "mode", "relative", "failures", "last_failure"]
TYPES = (
    "chunk bigint, first_ts bigint, closed bigint, bound bigint, mode int, relative boolean, failures bigint, "
    "last_failure bigint"
)


class States(NamedTuple):
    """States after a stretch, as arrays; ``relative`` failures are added to those before."""

    mode: np.ndarray
    relative: np.ndarray
    failures: np.ndarray
    last: np.ndarray

    def take(self, at) -> States:
        return States(*(x[at] for x in self))


class Summary(NamedTuple):
    first_ts: int
    closed: States
    bounds: np.ndarray  # ascending; the effect of an L is that of the first bound above it
    opened: States


def _then(before: States, after: States) -> States:
    """after's states where they follow the changes of ``before`` row by row."""
    return States(
        after.mode, before.relative & after.relative,
        np.where(after.relative, before.failures + after.failures, after.failures), after.last,
    )


def _joined(*parts: States) -> States:
    return States(*map(np.concatenate, zip(*parts)))


def _merged(first_ts: int, bounds: np.ndarray, opened: States) -> tuple[np.ndarray, States]:
    """Without bounds beyond the first call; of equal bounds the first, of neighbours with the same effect the last."""
    bounds, firsts = np.unique(bounds, return_index=True)
    opened = opened.take(firsts)
    n = min(len(bounds), int(np.searchsorted(bounds, first_ts, "right")) + 1)
    bounds, opened = bounds[:n], opened.take(slice(n))
    keep = np.append(np.any([x[1:] != x[:-1] for x in opened], axis=0), True)
    return bounds[keep], opened.take(keep)


def summarise(ts: np.ndarray, ok: np.ndarray, threshold: int, recovery_us: int) -> Summary:
    """Summary of calls in their order.

    Two kinds of places follow from each other: the breaker opened (or stayed open) at the f-th failure,
    and it closed when r failures had passed. Each leads to one other place or to the stretch's
    end; doubling the steps leads all of them to their ends in a logarithmic number of rounds.
    """
    n, needed = len(ts), max(threshold, 1)
    failed = np.flatnonzero(~ok)
    k = len(failed)
    probe = np.searchsorted(ts, ts[failed] + recovery_us, "right")
    passed = np.searchsorted(failed, probe)  # failures before the probe; a failing probe is the next one
    at_end = probe == n
    closes = ~at_end & ok[np.minimum(probe, n - 1)]
    r = np.arange(k + 1)
    opening = r + needed - 1
    # places 0..k-1: open at failure f; k..2k: closed with r failures passed and none counted
    step = np.concatenate([
        np.where(at_end, np.arange(k), np.where(closes, k + passed, passed)), np.where(opening < k, opening, k + r),
    ])
    relative = np.concatenate([~closes, opening >= k])
    failures = np.concatenate([np.where(at_end | closes, 0, 1), np.where(opening < k, needed, 0)])
    while not np.array_equal(step, step[step]):
        failures = np.where(relative[step], failures + failures[step], failures[step])
        relative = relative & relative[step]
        step = step[step]
    shut = step >= k
    end = States(
        np.where(shut, CLOSED, OPEN), relative & ~shut, np.where(shut, k - (step - k), failures),
        np.where(shut, -1, ts[failed][np.minimum(step, k - 1)] if k else -1),
    )
    counted = np.arange(needed)
    opens_at = needed - counted - 1
    closed = end.take(np.where(opens_at < k, opens_at, k))
    start = States(closed.mode, np.zeros(needed, dtype=bool), np.full(needed, needed), closed.last)
    stays = States(np.full(needed, CLOSED), start.relative, counted + k, np.full(needed, -1))
    closed = States(*(np.where(opens_at < k, a, b) for a, b in zip(_then(start, closed), stays)))
    first = np.arange(min(n, int(np.searchsorted(ts, ts[0] + recovery_us, "right")) + 1))
    passed = np.searchsorted(failed, first)
    after = end.take(np.where(ok[first], k + passed, passed))
    probed = States(after.mode, ~ok[first], np.where(ok[first], 0, 1), after.last)
    return Summary(int(ts[0]), closed, *_merged(int(ts[0]), ts[first] - recovery_us, _then(probed, after)))


def applied(before: States, summary: Summary) -> States:
    """States after the stretch for states before it."""
    shut = before.mode == CLOSED
    at = np.searchsorted(summary.bounds, before.last, "right")
    rejected = ~shut & (at == len(summary.bounds))
    effects = _joined(summary.closed, summary.opened)
    index = np.where(shut, before.failures, len(summary.closed.mode) + np.minimum(at, len(summary.bounds) - 1))
    after = _then(before, effects.take(np.where(rejected, 0, index)))
    return States(*(np.where(rejected, a, b) for a, b in zip(before, after)))


def chained(first: Summary, second: Summary) -> Summary:
    """The summary of two stretches one after the other."""
    later = second.bounds > first.bounds[-1]
    bounds = np.concatenate([first.bounds, second.bounds[later]])
    opened = _joined(applied(first.opened, second), second.opened.take(later))
    return Summary(first.first_ts, applied(first.closed, second), *_merged(first.first_ts, bounds, opened))


def after(state: Breaker, summary: Summary) -> Breaker:
    one = States(*(np.array([x]) for x in (state.mode, False, state.failures, state.last_failure)))
    end = applied(one, summary)
    return Breaker(int(end.mode[0]), int(end.failures[0]), int(end.last[0]))


def to_rows(chunk: int, summary: Summary) -> pd.DataFrame:
    n = len(summary.closed.mode)
    both = _joined(summary.closed, summary.opened)
    return pd.DataFrame({
        "chunk": chunk, "first_ts": summary.first_ts,
        "closed": np.concatenate([np.arange(n), np.full(len(summary.bounds), -1)]),
        "bound": np.concatenate([np.zeros(n, dtype=np.int64), summary.bounds]),
        "mode": both.mode, "relative": both.relative, "failures": both.failures, "last_failure": both.last,
    })


def from_rows(rows: pd.DataFrame) -> Summary:
    """The summary whose rows these are, in any order."""

    def states(part: pd.DataFrame) -> States:
        return States(*(part[c].to_numpy() for c in ("mode", "relative", "failures", "last_failure")))

    shut, opened = rows[rows["closed"] >= 0].sort_values("closed"), rows[rows["closed"] < 0].sort_values("bound")
    return Summary(int(rows["first_ts"].iloc[0]), states(shut), opened["bound"].to_numpy(), states(opened))
